"""The streaming ingest: files arriving in two batches, two runs, one checkpoint."""
from pyspark.sql import functions as F

from blotter.operators.classify import split_flag
from blotter.plans.cleaning import clean_incidents
from blotter.session import shared_dir
from blotter.sources import layer
from blotter.sources.csv import write_csv
from blotter.sources.standin import raw_incidents, standin_recode_dim
from blotter.streaming.ingest import start_ingest


def _run(spark, src, out, ckpt, dim):
    q = start_ingest(spark, src, out, ckpt, dim)
    assert q.awaitTermination(600)
    assert q.exception() is None


def test_incremental_ingest_is_exactly_once(spark, sf):
    raw_text = raw_incidents(spark, sf, normalize=False)
    flag = split_flag(F.col("DR_NO").try_cast("long"), 50)
    src, out, ckpt = (shared_dir(spark, n) for n in ("landing", "layer", "ckpt"))
    dim = standin_recode_dim(spark, sf)

    write_csv(raw_text.filter(flag), f"{src}/batch=1")
    _run(spark, src, out, ckpt, dim)
    first = layer.read_layer(spark, out).count()

    write_csv(raw_text.filter(~flag), f"{src}/batch=2")
    _run(spark, src, out, ckpt, dim)          # only the new files are read
    _run(spark, src, out, ckpt, dim)          # nothing new: nothing added

    got = layer.read_layer(spark, out)
    want = clean_incidents(raw_incidents(spark, sf), dim)
    assert 0 < first < got.count()
    cols = want.columns
    assert got.select(cols).exceptAll(want).count() == 0
    assert want.exceptAll(got.select(cols)).count() == 0


def test_exchanged_header_columns_fail(spark, tmp_path):
    """A file whose header has two columns exchanged is refused, not read by position."""
    import pytest

    from blotter.plans.job import read_dictionary
    from blotter.schema import RAW
    from blotter.streaming.ingest import raw_stream
    names = list(RAW)
    names[8], names[9] = names[9], names[8]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text(",".join(names) + "\n" + ",".join(["1"] * len(names)) + "\n")
    q = raw_stream(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("swapped") \
        .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    with pytest.raises(Exception):
        q.awaitTermination(120)
    (tmp_path / "d.csv").write_text("raw,target,domain\nA,B,crime\n")
    with pytest.raises(Exception):
        read_dictionary(spark, str(tmp_path / "d.csv")).collect()
