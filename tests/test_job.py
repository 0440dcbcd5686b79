"""The batch job end to end on the stand-in file and dictionary (written as CSV)."""
from blotter.plans import job
from blotter.plans.queries import EXCLUDED_YEAR, MONTH_RANGE, clean
from blotter.session import shared_dir
from blotter.sources.csv import write_csv
from blotter.sources.standin import raw_incidents, standin_recode_dim


def test_job_end_to_end(spark, sf):
    raw_csv, dict_csv, out = (shared_dir(spark, n) for n in ("job-raw", "job-dict", "job-out"))
    write_csv(raw_incidents(spark, sf, normalize=False), raw_csv)
    write_csv(standin_recode_dim(spark, sf), dict_csv)
    summary = job.run(spark, raw_csv, job.read_dictionary(spark, dict_csv), out, MONTH_RANGE, EXCLUDED_YEAR)
    assert summary["scored"] > 0 and 0 <= summary["accuracy"] <= 1
    got = spark.read.parquet(f"{out}/clean").drop("dr_no", "occ_date", "occ_year")
    want = clean(spark, sf)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    top = spark.read.parquet(f"{out}/report/top_crime").count()
    assert 0 < top <= 10
    for name in ("nulls", "distinct", "unmapped", "filter_counts"):
        assert spark.read.parquet(f"{out}/profile/{name}").count() > 0


def test_input_sized_settings(spark, sf):
    from blotter.session import cluster_conf, input_bytes
    n = input_bytes(spark, f"{sf}/lineitem.parquet")
    assert n > 10_000
    conf = cluster_conf(n, spark.sparkContext.defaultParallelism)
    assert int(conf["spark.sql.shuffle.partitions"]) == 2 * spark.sparkContext.defaultParallelism


def test_job_cli(spark, sf, capsys):
    import json
    raw_csv, dict_csv, out = (shared_dir(spark, n) for n in ("cli-raw", "cli-dict", "cli-out"))
    write_csv(raw_incidents(spark, sf, normalize=False), raw_csv)
    write_csv(standin_recode_dim(spark, sf).coalesce(1), dict_csv)
    from blotter.session import cluster_conf
    keys = list(cluster_conf(1, 1))
    saved = {k: spark.conf.get(k, None) for k in keys}
    try:   # the CLI sizes the (shared test) session to its input; put it back afterwards
        job.main(["--raw", raw_csv, "--dictionary", dict_csv, "--out", out,
                  "--month-range", *MONTH_RANGE, "--exclude-year", str(EXCLUDED_YEAR)])
    finally:
        for k, v in saved.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    summary = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert summary["scored"] > 0 and summary["itemsets"] >= 0
    assert spark.read.parquet(f"{out}/report/weekday_trend").count() == 7
