"""Independent SQL (DuckDB dialect) for :mod:`blotter.plans.deep_queries`; parameters are spelled out here."""

from __future__ import annotations

from blotter.plans.oracle import _IN_TRAIN, EVENT_ITEMS_CTE, RAW, RAW_CTE, with_clean, with_raw
from blotter.plans.oracle import oracle_sql as base_sql


def deep_sql() -> dict[str, str]:
    q: dict[str, str] = {}
    cats = ["vict_sex", "vict_descent", "premis_desc", "weapon_desc", "location"]
    q["index_any"] = with_raw(" UNION ALL ".join(
        f"""SELECT '{c}' AS input, value, index, CASE WHEN index < size - 1 THEN index END AS slot, count FROM (
            SELECT {c} AS value, count(*) AS count, row_number() OVER (ORDER BY count(*) DESC, {c}) - 1 AS index,
                   count(*) OVER () AS size FROM raw_incidents WHERE {c} IS NOT NULL GROUP BY {c})""" for c in cats))
    kind = "CAST(mocodes AS BIGINT) % 50"
    q["csv_quarantine"] = with_raw(f"""SELECT 'clean' AS outcome, area_name AS detail, CAST(28 AS INTEGER) AS fields, count(*) AS lines
        FROM raw_incidents WHERE {kind} NOT IN (1, 2, 3, 4) GROUP BY area_name
        UNION ALL
        SELECT 'rejected', ['few', 'many', 'quote', 'empty'][{kind}], CAST([5, 30, 28, 1][{kind}] AS INTEGER), count(*)
        FROM raw_incidents WHERE {kind} IN (1, 2, 3, 4) GROUP BY ALL""")
    d = "try_strptime(date_occ, '%m-%d-%Y')"
    text = lambda *cs: " || '|' || ".join(f"coalesce(CAST({c} AS VARCHAR), '-')" for c in cs)
    q["incremental_report"] = with_clean(f"""
        SELECT 'top_crime' AS report, key, count FROM (SELECT {text('crm_cd_desc')} AS key, count(*) AS count FROM clean
            GROUP BY crm_cd_desc ORDER BY count DESC, crm_cd_desc LIMIT 10)
        UNION ALL SELECT 'count_by_sex', {text('vict_sex')}, count(*) FROM clean GROUP BY vict_sex
        UNION ALL SELECT 'age_sex_dist', {text('vict_age', 'vict_sex')}, count(*) FROM clean GROUP BY vict_age, vict_sex
        UNION ALL SELECT 'year_trend', CAST(year({d}) AS VARCHAR), count(*) FROM clean WHERE year({d}) <> 2001 GROUP BY year({d})
        UNION ALL SELECT 'month_trend', CAST(month({d}) AS VARCHAR), count(*) FROM clean
            WHERE {d} >= DATE '1995-01-01' AND {d} < DATE '1998-01-01' GROUP BY month({d})
        UNION ALL SELECT 'weekday_trend', dayname({d}), count(*) FROM clean WHERE {d} IS NOT NULL GROUP BY dayname({d})
        UNION ALL SELECT 'count_by_area_hispanic', {text('area_name')}, count(*) FROM clean
            WHERE vict_descent = 'Hispanic/Latin' GROUP BY area_name""")
    scorer = f"""WITH {RAW_CTE},
known AS (SELECT dr_no, premis_desc, vict_sex, status_desc, {_IN_TRAIN} AS in_train FROM raw_incidents),
fit AS (SELECT * FROM known WHERE in_train AND premis_desc IS NOT NULL),
codes AS (SELECT value, CAST(row_number() OVER (ORDER BY n DESC, value) - 1 AS INTEGER) AS index
          FROM (SELECT status_desc AS value, count(*) AS n FROM fit WHERE status_desc IS NOT NULL GROUP BY 1) t),
best AS (SELECT premis_desc, arg_max(index, (n, -index)) AS prediction
         FROM (SELECT k.premis_desc, c.index, count(*) AS n FROM fit k JOIN codes c ON k.status_desc = c.value GROUP BY ALL) t
         GROUP BY premis_desc),
test AS (SELECT dr_no, premis_desc, vict_sex, status_desc FROM known WHERE NOT in_train),"""
    rest = "dr_no NULLS FIRST, premis_desc NULLS FIRST, status_desc NULLS FIRST, vict_sex NULLS FIRST"
    q["permutation_importance"] = scorer + f"""
places AS (SELECT *, row_number() OVER (ORDER BY md5('to:' || coalesce(dr_no, '')), {rest}) AS i,
                  row_number() OVER (ORDER BY md5('from0:' || coalesce(dr_no, '')), {rest}) AS j FROM test),
dealt AS (SELECT a.premis_desc, a.status_desc, b.premis_desc AS dealt_premis FROM places a JOIN places b ON a.i = b.j),
plain AS (SELECT count(*) AS scored, count(*) FILTER (c.index = coalesce(b.prediction, 0)) AS correct
          FROM test t JOIN codes c ON t.status_desc = c.value LEFT JOIN best b USING (premis_desc) WHERE t.premis_desc IS NOT NULL),
mixed AS (SELECT count(*) AS scored, count(*) FILTER (c.index = coalesce(b.prediction, 0)) AS correct
          FROM dealt t JOIN codes c ON t.status_desc = c.value LEFT JOIN best b ON t.dealt_premis = b.premis_desc
          WHERE t.dealt_premis IS NOT NULL)
SELECT 'premis_desc' AS feature, p.scored, p.correct, m.correct AS permuted_correct,
       round(p.correct / p.scored - m.correct / m.scored, 6) AS importance FROM plain p, mixed m
UNION ALL SELECT 'vict_sex', scored, correct, correct, 0.0 FROM plain"""
    shares = f"""WITH {RAW_CTE},
known AS (SELECT premis_desc, status_desc = 'Invest Cont' AS positive, {_IN_TRAIN} AS in_train FROM raw_incidents WHERE premis_desc IS NOT NULL),
share AS (SELECT premis_desc, CAST(count(*) FILTER (positive) AS DOUBLE) / count(*) AS score FROM known WHERE in_train GROUP BY premis_desc),
scored AS (SELECT score, positive FROM known JOIN share USING (premis_desc) WHERE NOT in_train AND positive IS NOT NULL)"""
    q["auc"] = shares + """,
counts AS (SELECT score, count(*) FILTER (positive) AS pos, count(*) FILTER (NOT positive) AS neg FROM scored GROUP BY score),
pairs AS (SELECT sum(a.pos * b.neg * (CASE WHEN b.score < a.score THEN 2 WHEN b.score = a.score THEN 1 ELSE 0 END)) AS u FROM counts a, counts b)
SELECT CAST(sum(pos) AS BIGINT) AS positives, CAST(sum(neg) AS BIGINT) AS negatives, CAST(any_value(u) AS DOUBLE) AS twice_u,
       round(any_value(u) / (2.0 * sum(pos) * sum(neg)), 6) AS auc FROM counts, pairs"""
    q["calibration"] = shares + """
SELECT CAST(greatest(0, least(9, floor(score * 10))) AS INTEGER) AS bin, count(*) AS rows, count(*) FILTER (positive) AS positives,
       round(avg(score), 6) AS mean_score, round(avg(CASE WHEN positive THEN 1.0 ELSE 0.0 END), 6) AS positive_share
FROM scored GROUP BY 1"""
    q["condensed_itemsets"] = f"""WITH {EVENT_ITEMS_CTE},
wider AS (SELECT a.items, max(b.freq) AS above FROM itemsets a JOIN itemsets b
          ON len(b.item_list) > len(a.item_list) AND list_has_all(b.item_list, a.item_list) GROUP BY a.items)
SELECT items, freq, coalesce(above, 0) AS above, coalesce(above, 0) < freq AS closed, above IS NULL AS maximal
FROM itemsets LEFT JOIN wider USING (items)"""
    q["significant_rules"] = f"""WITH {EVENT_ITEMS_CTE},
held AS (SELECT list_sort([kind, weekday, week_part, half_day, value_band]) AS item_list FROM train),
tables AS (SELECT antecedent, consequent, (SELECT count(*) FROM held h WHERE list_has_all(h.item_list, r.antecedent_list) AND list_contains(h.item_list, r.consequent)) AS n_both,
                  (SELECT count(*) FROM held h WHERE list_has_all(h.item_list, r.antecedent_list)) AS n_antecedent,
                  (SELECT count(*) FROM held h WHERE list_contains(h.item_list, r.consequent)) AS n_consequent,
                  CAST((SELECT n FROM n_train) AS DOUBLE) AS n
           FROM rules r),
tested AS (SELECT *, CASE WHEN n_antecedent * n_consequent * (n - n_antecedent) * (n - n_consequent) > 0
                          THEN n * (n * n_both - CAST(n_antecedent AS DOUBLE) * n_consequent) * (n * n_both - CAST(n_antecedent AS DOUBLE) * n_consequent)
                               / (CAST(n_antecedent AS DOUBLE) * n_consequent * (n - n_antecedent) * (n - n_consequent)) END AS chi2 FROM tables)
SELECT antecedent, consequent, n_both, n_antecedent, n_consequent, round(n_both / n_antecedent, 6) AS confidence, round(chi2, 3) AS chi2,
       coalesce(chi2 >= 10.828, false) AS significant FROM tested"""
    base = base_sql()
    q["rule_predict_any"] = base["rule_predict"]
    unmapped, counts = base["recode_unmapped"].split("\nSELECT domain, value, count(*) AS n FROM pairs p")
    q["repair_suggestions"] = unmapped + """,
entries AS (SELECT DISTINCT domain, raw FROM keys),
unmapped AS (SELECT domain, value, count(*) AS n FROM pairs p""" + counts + """),
near AS (SELECT u.domain, u.value, u.n, k.raw AS suggestion, levenshtein(upper(u.value), upper(k.raw)) AS distance
         FROM unmapped u JOIN entries k ON u.domain = k.domain),
least AS (SELECT domain, value, min(distance) AS distance FROM near GROUP BY domain, value)
SELECT domain, value, n, suggestion, CAST(distance AS INTEGER) AS distance
FROM near JOIN least USING (domain, value, distance) WHERE distance <= 2"""
    whole = " || '|' || ".join(f"coalesce({c}, '')" for c in RAW)
    q["stratified_split"] = with_raw(f"""SELECT dr_no, status_desc,
        row_number() OVER (PARTITION BY status_desc ORDER BY CAST('0x' || substr(md5({whole}), 1, 15) AS BIGINT))
        <= count(*) OVER (PARTITION BY status_desc) * 80 // 100 AS in_train FROM raw_incidents""")
    q["clustered_area_dates"] = with_clean(f"""SELECT area_name, crm_cd_desc, count(*) AS count FROM clean
        WHERE area_name = 'NATION_3' AND {d} >= DATE '1995-01-01' AND {d} < DATE '1995-07-01' GROUP BY ALL""")
    q["top_location"] = with_raw("""SELECT location, count(*) AS count FROM raw_incidents WHERE location IS NOT NULL
        GROUP BY location ORDER BY count DESC, location LIMIT 10""")
    return q
