"""Independent SQL (DuckDB dialect) for every SQL-expressible registered query.

The stand-in incident table, the dictionaries and the cleaning rules are
restated here in plain SQL, codes, column lists and thresholds included; a query and its oracle share
the test tables alone.  Two-pass recoding is written as two sequential lookups (not as the
merged dictionary the library builds); frequent itemsets come from a
``GROUP BY CUBE`` (each basket holds one distinct item per column), rules
from self-joins of the itemsets.
"""

from __future__ import annotations

# --- fixed values: parameters of the queries, stated anew ---------------------
EXCLUDED_YEAR = 2001
MONTH_RANGE = ("1995-01-01", "1998-01-01")
TOP_K = 10
TRAIN_PERCENT = 80
MIN_SUPPORT, MIN_CONFIDENCE = 0.1, 0.5
INCIDENT_SUPPORT, INCIDENT_CONFIDENCE = 0.2, 0.5
HASH_WIDTH = 64
RAW = ["dr_no", "date_rptd", "date_occ", "time_occ", "area", "area_name", "rpt_dist_no", "part_1_2", "crm_cd", "crm_cd_desc", "mocodes",
       "vict_age", "vict_sex", "vict_descent", "premis_cd", "premis_desc", "weapon_used_cd", "weapon_desc", "status", "status_desc",
       "crm_cd_1", "crm_cd_2", "crm_cd_3", "crm_cd_4", "location", "cross_street", "lat", "lon"]
DROPPED = ["dr_no", "area", "rpt_dist_no", "part_1_2", "crm_cd", "mocodes", "premis_cd", "weapon_used_cd", "status",
           "crm_cd_1", "crm_cd_2", "crm_cd_3", "crm_cd_4", "cross_street"]
BASKET_COLUMNS = ["area_name", "crm_cd_desc", "premis_desc", "weapon_desc", "vict_descent"]

# --- fixed values: the dictionaries, as SQL of their own ---------------------
SEX_VALUES = "('F', 'Female'), ('M', 'Male'), ('X', 'Unknown')"

DESCENT_VALUES = """
    ('A', 'Other Asian'), ('B', 'Black'), ('C', 'Chinese'), ('D', 'Cambodian'), ('F', 'Filipino'),
    ('G', 'Guamanian'), ('H', 'Hispanic/Latin'), ('I', 'American Indian/Alaskan Native'),
    ('J', 'Japanese'), ('K', 'Korean'), ('L', 'Laotian'), ('O', 'Other'), ('P', 'Pacific Islander'),
    ('S', 'Samoan'), ('U', 'Hawaiian'), ('V', 'Vietnamese'), ('W', 'White'), ('X', 'Unknown'),
    ('Z', 'Asian Indian')"""

PREMISE1_VALUES = """
    ('ECONOMY', 'Commercial Area'), ('LARGE', 'Public Area'), ('MEDIUM', 'Residential Area'),
    ('PROMO', 'Commercial Area'), ('PROMO', 'Commercial Area'), ('null', 'Unknown'),
    ('Public Area', 'Public Area')"""

PREMISE2_VALUES = "('SMALL', 'Residential Area'), ('ECONOMY', 'Recreational Area')"


RAW_CTE = r"""
raw_incidents AS (
  SELECT
    CASE WHEN p.p_size = 47 AND l.l_linenumber = 7 THEN NULL
         WHEN p.p_size = 46 AND l.l_linenumber = 7 THEN 'T' || CAST(l.l_orderkey * 10 + l.l_linenumber AS VARCHAR)
         ELSE CAST(l.l_orderkey * 10 + l.l_linenumber AS VARCHAR) END AS dr_no,
    strftime(l.l_shipdate, '%m/%d/%Y %I:%M:%S %p') AS date_rptd,
    CASE WHEN p.p_size = 49 AND l.l_linenumber = 7 THEN '13/45/2000 12:00:00 AM'
         ELSE strftime(o.o_orderdate, '%m/%d/%Y %I:%M:%S %p') END AS date_occ,
    CAST(((l.l_partkey * 7 + l.l_linenumber) % 24) * 100 + l.l_suppkey % 60 AS VARCHAR) AS time_occ,
    CAST(c.c_nationkey AS VARCHAR) AS area,
    n.n_name AS area_name,
    CAST(c.c_nationkey * 100 + n.n_regionkey * 10 + l.l_linenumber AS VARCHAR) AS rpt_dist_no,
    CASE WHEN l.l_linestatus = 'F' THEN '1' ELSE '2' END AS part_1_2,
    CAST(l.l_partkey % 97 + 100 AS VARCHAR) AS crm_cd,
    CASE WHEN (l.l_orderkey + l.l_partkey) % 10 < 4 THEN upper(split_part(p.p_name, ' ', 1)) || ' GEAR'
         WHEN (l.l_orderkey + l.l_partkey) % 10 < 7 THEN upper(split_part(p.p_name, ' ', 1)) || ' ROD'
         ELSE upper(p.p_name) END AS crm_cd_desc,
    CAST(l.l_suppkey AS VARCHAR) AS mocodes,
    CASE WHEN p.p_size = 50 THEN 'X'
         ELSE CAST((l.l_orderkey + l.l_linenumber) % 60 - 3 AS VARCHAR) END AS vict_age,
    CASE WHEN o.o_orderstatus = 'P' AND l.l_linenumber = 7 THEN NULL
         WHEN o.o_orderstatus = 'P' AND l.l_linenumber = 6 THEN 'H'
         WHEN o.o_orderstatus = 'F' THEN 'F'
         WHEN o.o_orderstatus = 'O' THEN 'M' ELSE 'X' END AS vict_sex,
    CASE WHEN o.o_orderstatus = 'P' AND l.l_linenumber = 5 THEN NULL
         WHEN o.o_orderstatus = 'F' AND l.l_linenumber = 7 THEN 'null'
         WHEN (l.l_orderkey + l.l_partkey) % 10 < 4 THEN 'H'
         ELSE ['A', 'B', 'C', 'D', 'F', 'G', 'H', 'I', 'J', 'K', 'L', 'O', 'P', 'S', 'U', 'V', 'W', 'X', 'Z', '-'
              ][CAST(c.c_custkey % 20 AS INTEGER) + 1] END AS vict_descent,
    CAST(p.p_size + 500 AS VARCHAR) AS premis_cd,
    CASE WHEN o.o_orderstatus = 'P' AND l.l_linenumber = 4 THEN 'null'
         WHEN o.o_orderstatus = 'P' AND l.l_linenumber = 3 THEN NULL
         WHEN (l.l_orderkey + l.l_partkey) % 10 < 4 THEN 'ECONOMY'
         WHEN (l.l_orderkey + l.l_partkey) % 10 < 7 THEN 'MEDIUM'
         ELSE p.p_type END AS premis_desc,
    CASE WHEN o.o_orderstatus = 'P' AND l.l_linenumber = 1 THEN NULL
         WHEN (l.l_orderkey + l.l_partkey) % 10 < 4 THEN '111'
         WHEN (l.l_orderkey + l.l_partkey) % 10 < 7 THEN '122'
         ELSE CAST(CAST(regexp_extract(p.p_brand, '(\d+)', 1) AS INTEGER) + 100 AS VARCHAR) END AS weapon_used_cd,
    CASE WHEN o.o_orderstatus = 'P' AND l.l_linenumber = 2 THEN 'null'
         WHEN o.o_orderstatus = 'P' AND l.l_linenumber = 1 THEN NULL
         WHEN (l.l_orderkey + l.l_partkey) % 10 < 4 THEN 'BRAND#11'
         WHEN (l.l_orderkey + l.l_partkey) % 10 < 7 THEN 'BRAND#22'
         ELSE upper(p.p_brand) END AS weapon_desc,
    CASE WHEN l.l_suppkey % 5 = 0 THEN l.l_returnflag
         WHEN (l.l_orderkey + l.l_partkey) % 10 < 4 THEN 'A'
         WHEN (l.l_orderkey + l.l_partkey) % 10 < 7 THEN 'R'
         WHEN (l.l_orderkey + l.l_linenumber) % 60 - 3 >= 30 THEN 'N' ELSE 'R' END AS status,
    CASE status WHEN 'A' THEN 'Adult Arrest' WHEN 'R' THEN 'Invest Cont' ELSE 'Adult Other' END AS status_desc,
    CAST(l.l_partkey % 97 + 100 AS VARCHAR) AS crm_cd_1,
    CASE WHEN l.l_linenumber = 7 THEN CAST(l.l_partkey % 97 + 300 AS VARCHAR) END AS crm_cd_2,
    CAST(NULL AS VARCHAR) AS crm_cd_3,
    CAST(NULL AS VARCHAR) AS crm_cd_4,
    c.c_name AS location,
    CASE WHEN l.l_linenumber = 3 THEN 'STREET ' || CAST(l.l_suppkey AS VARCHAR) END AS cross_street,
    CASE WHEN p.p_size = 48 AND l.l_linenumber = 7 THEN 'n/a'
         ELSE CAST(CAST(33.7 + (c.c_custkey % 500) * 0.001 AS DECIMAL(8, 4)) AS VARCHAR) END AS lat,
    CAST(CAST(-118.6 + (c.c_custkey % 700) * 0.001 AS DECIMAL(9, 4)) AS VARCHAR) AS lon
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN part p ON l.l_partkey = p.p_partkey
)"""

DIM_CTE = f"""
dim_sex(raw, target) AS (VALUES {SEX_VALUES}),
dim_descent(raw, target) AS (VALUES {DESCENT_VALUES}),
dim_premise1(raw, target) AS (SELECT DISTINCT raw, target FROM (VALUES {PREMISE1_VALUES}) t(raw, target)),
dim_premise2(raw, target) AS (VALUES {PREMISE2_VALUES}),
dim_crime AS (
  SELECT DISTINCT upper(p_name) AS raw,
         upper(substr(split_part(p_name, ' ', 2), 1, 1)) || lower(substr(split_part(p_name, ' ', 2), 2)) AS target
  FROM part WHERE split_part(p_name, ' ', 2) <> 'gizmo'),
dim_weapon AS (
  SELECT DISTINCT upper(p_brand) AS raw,
         'Group ' || CAST(CAST(regexp_extract(p_brand, '(\\d+)', 1) AS INTEGER) % 8 AS VARCHAR) AS target
  FROM part
  UNION ALL SELECT 'null', 'Unknown')"""

RECODED_CTE = """
recoded AS (
  SELECT
    r.dr_no,
    regexp_replace(substr(r.date_occ, 1, 10), '/', '-', 'g') AS date_occ,
    substr(lpad(r.time_occ, 4, '0'), 1, 2) || ':' || substr(lpad(r.time_occ, 4, '0'), 3, 2) AS time_occ,
    r.area_name,
    coalesce(dc.target, r.crm_cd_desc) AS crm_cd_desc,
    TRY_CAST(r.vict_age AS INTEGER) AS vict_age,
    coalesce(ds.target, r.vict_sex) AS vict_sex,
    coalesce(dd.target, r.vict_descent) AS vict_descent,
    coalesce(p2.target, coalesce(p1.target, r.premis_desc)) AS premis_desc,
    coalesce(dw.target, r.weapon_desc) AS weapon_desc,
    r.status_desc, r.location, r.lat, r.lon
  FROM raw_incidents r
  LEFT JOIN dim_sex ds ON r.vict_sex = ds.raw
  LEFT JOIN dim_descent dd ON r.vict_descent = dd.raw
  LEFT JOIN dim_crime dc ON r.crm_cd_desc = dc.raw
  LEFT JOIN dim_premise1 p1 ON r.premis_desc = p1.raw
  LEFT JOIN dim_premise2 p2 ON coalesce(p1.target, r.premis_desc) = p2.raw
  LEFT JOIN dim_weapon dw ON r.weapon_desc = dw.raw
),
clean AS (
  SELECT date_occ, time_occ, area_name, crm_cd_desc, vict_age, vict_sex, vict_descent,
         premis_desc, weapon_desc, status_desc, location, lat, lon,
         strftime(try_strptime(date_occ, '%m-%d-%Y'), '%B') AS month,
         dayname(try_strptime(date_occ, '%m-%d-%Y')) AS day
  FROM recoded
  WHERE vict_age NOT IN (-2, -1, 0)
    AND vict_sex NOT IN ('null', 'H')
    AND vict_descent NOT IN ('null')
    AND premis_desc NOT IN ('null')
    AND weapon_desc NOT IN ('null')
)"""


def with_raw(body: str) -> str:
    return f"WITH {RAW_CTE}\n{body}"


def with_clean(body: str) -> str:
    return f"WITH {RAW_CTE},\n{DIM_CTE},\n{RECODED_CTE}\n{body}"


def _top(col: str) -> str:
    return with_clean(f"SELECT {col}, count(*) AS count FROM clean GROUP BY {col} "
                      f"ORDER BY count DESC, {col} ASC NULLS FIRST LIMIT {TOP_K}")


def _by_area(group: str) -> str:
    return with_clean(f"SELECT area_name, count(*) AS count FROM clean "
                      f"WHERE vict_descent = '{group}' GROUP BY area_name")


def _recode(column: str, join: str, target: str) -> str:
    return f"""WITH {RAW_CTE},
{DIM_CTE}
SELECT r.{column} AS raw, {target} AS recoded, count(*) AS count
FROM raw_incidents r {join}
GROUP BY ALL"""


_DATE = "try_strptime(regexp_replace(substr(date_occ, 1, 10), '/', '-', 'g'), '%m-%d-%Y')"
# Park-Miller steps of the key split, for non-negative keys.
_SPLIT = ("((((CAST({key} AS BIGINT) % 2147483647) * 48271 % 2147483647) * 48271 % 2147483647) % 100) < "
          + str(TRAIN_PERCENT))
# The incident number as a whole number: its own value, else the first 15 hex digits of its MD5.
_ROW_KEY = "coalesce(TRY_CAST(dr_no AS BIGINT), CAST('0x' || substr(md5(dr_no), 1, 15) AS BIGINT))"
_IN_TRAIN = "coalesce(" + _SPLIT.format(key=_ROW_KEY) + ", false)"

EVENT_ITEMS_CTE = f"""
ev AS (
  SELECT event_id,
         event_type AS kind,
         dayname(ts) AS weekday,
         CASE WHEN dayname(ts) IN ('Saturday', 'Sunday') THEN 'weekend' ELSE 'workday' END AS week_part,
         CASE WHEN hour(ts) < 12 THEN 'AM' ELSE 'PM' END AS half_day,
         CASE WHEN value < 20 THEN 'value<20' WHEN value < 50 THEN 'value20-50' ELSE 'value50+' END AS value_band,
         {_SPLIT.format(key='event_id')} AS is_train
  FROM events
),
train AS (SELECT * FROM ev WHERE is_train),
n_train AS (SELECT count(*) AS n FROM train),
itemsets AS (
  SELECT array_to_string(list_sort(list_filter([kind, weekday, week_part, half_day, value_band],
                                              lambda x: x IS NOT NULL)), ',') AS items,
         list_sort(list_filter([kind, weekday, week_part, half_day, value_band],
                               lambda x: x IS NOT NULL)) AS item_list,
         count(*) AS freq
  FROM train
  GROUP BY CUBE (kind, weekday, week_part, half_day, value_band)
  HAVING count(*) >= ceil({MIN_SUPPORT} * (SELECT n FROM n_train))
     AND NOT (kind IS NULL AND weekday IS NULL AND week_part IS NULL AND half_day IS NULL AND value_band IS NULL)
),
rules AS (
  SELECT array_to_string(list_filter(z.item_list, lambda x: x <> y.item), ',') AS antecedent,
         list_filter(z.item_list, lambda x: x <> y.item) AS antecedent_list,
         y.item AS consequent,
         z.freq * 1.0 / a.freq AS confidence,
         (z.freq * 1.0 / a.freq) / (c.freq * 1.0 / (SELECT n FROM n_train)) AS lift,
         z.freq * 1.0 / (SELECT n FROM n_train) AS support
  FROM itemsets z
  CROSS JOIN LATERAL (SELECT unnest(z.item_list) AS item) y
  JOIN itemsets a ON a.items = array_to_string(list_filter(z.item_list, lambda x: x <> y.item), ',')
  JOIN itemsets c ON c.items = y.item
  WHERE len(z.item_list) >= 2 AND z.freq * 1.0 / a.freq >= {MIN_CONFIDENCE}
)"""


def _incident_rules_cte() -> str:
    cols = ", ".join(BASKET_COLUMNS)
    no_placeholder = " AND ".join(f"{c} NOT IN ('Unknown', 'Other')" for c in BASKET_COLUMNS)
    null_all = " AND ".join(f"{c} IS NULL" for c in BASKET_COLUMNS)
    recoded_filtered = """SELECT * FROM recoded
  WHERE vict_age NOT IN (-2, -1, 0) AND vict_sex NOT IN ('null', 'H') AND vict_descent NOT IN ('null')
    AND premis_desc NOT IN ('null') AND weapon_desc NOT IN ('null')"""
    return f"""WITH {RAW_CTE},
{DIM_CTE},
{RECODED_CTE},
test AS (SELECT {_ROW_KEY} AS key, list_sort(list_distinct(list_filter([{cols}], lambda x: x IS NOT NULL))) AS item_list
         FROM ({recoded_filtered}) c WHERE {no_placeholder} AND NOT {_IN_TRAIN}),
train AS (SELECT {cols} FROM ({recoded_filtered}) c
          WHERE {no_placeholder} AND {_IN_TRAIN}),
n_train AS (SELECT count(*) AS n FROM train),
itemsets AS (
  SELECT array_to_string(list_sort(list_filter([{cols}], lambda x: x IS NOT NULL)), ',') AS items,
         list_sort(list_filter([{cols}], lambda x: x IS NOT NULL)) AS item_list,
         count(*) AS freq
  FROM train GROUP BY CUBE ({cols})
  HAVING count(*) >= ceil({INCIDENT_SUPPORT} * (SELECT n FROM n_train)) AND NOT ({null_all})
),
rules AS (
  SELECT array_to_string(list_filter(z.item_list, lambda x: x <> y.item), ',') AS antecedent,
         list_filter(z.item_list, lambda x: x <> y.item) AS antecedent_list,
         y.item AS consequent,
         z.freq * 1.0 / a.freq AS confidence,
         (z.freq * 1.0 / a.freq) / (c.freq * 1.0 / (SELECT n FROM n_train)) AS lift,
         z.freq * 1.0 / (SELECT n FROM n_train) AS support
  FROM itemsets z
  CROSS JOIN LATERAL (SELECT unnest(z.item_list) AS item) y
  JOIN itemsets a ON a.items = array_to_string(list_filter(z.item_list, lambda x: x <> y.item), ',')
  JOIN itemsets c ON c.items = y.item
  WHERE len(z.item_list) >= 2 AND z.freq * 1.0 / a.freq >= {INCIDENT_CONFIDENCE}
)"""


def oracle_sql() -> dict[str, str]:
    raw_cols = ", ".join(RAW)
    kept = [c for c in RAW if c not in DROPPED]
    clean_cols = ("date_occ, time_occ, area_name, crm_cd_desc, vict_age, vict_sex, vict_descent, "
                  "premis_desc, weapon_desc, status_desc, location, lat, lon, month, day")
    order_all = ", ".join(f"{c} ASC NULLS FIRST" for c in RAW)
    nulls = ", ".join(f"CAST(sum(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS {c}" for c in RAW)
    basket = ", ".join(BASKET_COLUMNS)
    no_placeholder = " AND ".join(f"{c} NOT IN ('Unknown', 'Other')" for c in BASKET_COLUMNS)
    start, end = MONTH_RANGE
    q: dict[str, str] = {}

    q["csv_roundtrip"] = with_raw(f"SELECT {raw_cols} FROM raw_incidents")
    q["clean_sink_roundtrip"] = with_clean(
        f"SELECT {clean_cols}, CAST(year(try_strptime(date_occ, '%m-%d-%Y')) AS INTEGER) AS occ_year FROM clean")
    q["clean_stream_roundtrip"] = q["clean_sink_roundtrip"]
    q["row_count"] = with_raw("SELECT count(*) AS row_count FROM raw_incidents")
    q["preview"] = with_raw(f"SELECT {raw_cols} FROM raw_incidents ORDER BY {order_all} LIMIT 20")
    q["select_cols"] = with_clean(f"SELECT {basket} FROM clean")
    q["drop_cols"] = with_raw(f"SELECT {', '.join(kept)} FROM raw_incidents")
    q["derive_cols"] = with_raw(f"""SELECT dr_no, TRY_CAST(vict_age AS INTEGER) AS vict_age,
        regexp_replace(substr(date_occ, 1, 10), '/', '-', 'g') AS date_occ,
        substr(lpad(time_occ, 4, '0'), 1, 2) || ':' || substr(lpad(time_occ, 4, '0'), 3, 2) AS time_occ,
        strftime({_DATE}, '%B') AS month, dayname({_DATE}) AS day
        FROM raw_incidents""")
    q["cast_int"] = with_raw("SELECT dr_no, vict_age AS vict_age_text, TRY_CAST(vict_age AS INTEGER) AS vict_age "
                             "FROM raw_incidents")
    q["cast_double"] = with_raw("SELECT dr_no, TRY_CAST(lat AS DOUBLE) AS lat, TRY_CAST(lon AS DOUBLE) AS lon "
                                "FROM raw_incidents")
    q["null_profile"] = with_raw(f"SELECT {nulls} FROM raw_incidents")
    q["distinct_values"] = with_raw(" UNION ".join(
        f"SELECT '{c}' AS column_name, {c} AS value FROM raw_incidents"
        for c in ["crm_cd_desc", "premis_desc", "weapon_desc", "status_desc"]))
    q["date_text_norm"] = with_raw("""SELECT dr_no,
        regexp_replace(substr(date_rptd, 1, 10), '/', '-', 'g') AS date_rptd,
        regexp_replace(substr(date_occ, 1, 10), '/', '-', 'g') AS date_occ FROM raw_incidents""")
    q["time_norm"] = """SELECT event_id, CAST(hour(ts) * 100 + minute(ts) AS VARCHAR) AS time_raw,
        substr(lpad(CAST(hour(ts) * 100 + minute(ts) AS VARCHAR), 4, '0'), 1, 2) || ':' ||
        substr(lpad(CAST(hour(ts) * 100 + minute(ts) AS VARCHAR), 4, '0'), 3, 2) AS time_occ FROM events"""
    q["parse_date"] = with_raw(f"""SELECT dr_no, strftime({_DATE}, '%Y-%m-%d') AS occ_date,
        CAST(year({_DATE}) AS INTEGER) AS year, CAST(month({_DATE}) AS INTEGER) AS month FROM raw_incidents""")
    q["month_day_names"] = with_raw(f"SELECT dr_no, strftime({_DATE}, '%B') AS month, dayname({_DATE}) AS day "
                                    "FROM raw_incidents")
    q["filter_not_in_int"] = with_raw("""SELECT TRY_CAST(vict_age AS INTEGER) AS vict_age, crm_cd_desc,
        regexp_replace(substr(date_occ, 1, 10), '/', '-', 'g') AS date_occ FROM raw_incidents
        WHERE TRY_CAST(vict_age AS INTEGER) NOT IN (-2, -1, 0)""")
    q["filter_not_in_str"] = with_clean("""SELECT vict_sex, vict_descent, premis_desc, weapon_desc FROM recoded
        WHERE vict_sex NOT IN ('null', 'H') AND vict_descent NOT IN ('null')
          AND premis_desc NOT IN ('null') AND weapon_desc NOT IN ('null')""")
    q["filter_rule_counts"] = with_clean("""SELECT
        CAST(count(*) FILTER (WHERE vict_age IS NULL OR vict_age IN (-2, -1, 0)) AS BIGINT) AS bad_age,
        CAST(count(*) FILTER (WHERE vict_sex IS NULL OR vict_sex IN ('null', 'H')) AS BIGINT) AS bad_sex,
        CAST(count(*) FILTER (WHERE vict_descent IS NULL OR vict_descent = 'null') AS BIGINT) AS bad_descent,
        CAST(count(*) FILTER (WHERE premis_desc IS NULL OR premis_desc = 'null') AS BIGINT) AS bad_premise,
        CAST(count(*) FILTER (WHERE weapon_desc IS NULL OR weapon_desc = 'null') AS BIGINT) AS bad_weapon,
        CAST(count(*) FILTER (WHERE vict_age NOT IN (-2, -1, 0) AND vict_sex NOT IN ('null', 'H')
            AND vict_descent <> 'null' AND premis_desc <> 'null' AND weapon_desc <> 'null') AS BIGINT) AS kept
        FROM recoded""")
    q["filter_placeholders"] = with_clean(f"SELECT {basket} FROM clean WHERE {no_placeholder}")

    q["recode_sex"] = _recode("vict_sex", "LEFT JOIN dim_sex d ON r.vict_sex = d.raw",
                              "coalesce(d.target, r.vict_sex)")
    q["recode_descent"] = _recode("vict_descent", "LEFT JOIN dim_descent d ON r.vict_descent = d.raw",
                                  "coalesce(d.target, r.vict_descent)")
    q["recode_crime"] = _recode("crm_cd_desc", "LEFT JOIN dim_crime d ON r.crm_cd_desc = d.raw",
                                "coalesce(d.target, r.crm_cd_desc)")
    q["recode_premise"] = _recode(
        "premis_desc",
        "LEFT JOIN dim_premise1 p1 ON r.premis_desc = p1.raw "
        "LEFT JOIN dim_premise2 p2 ON coalesce(p1.target, r.premis_desc) = p2.raw",
        "coalesce(p2.target, coalesce(p1.target, r.premis_desc))")
    q["recode_weapon"] = _recode("weapon_desc", "LEFT JOIN dim_weapon d ON r.weapon_desc = d.raw",
                                 "coalesce(d.target, r.weapon_desc)")
    premise_all = (f"SELECT raw, target FROM (VALUES {PREMISE1_VALUES}) t(raw, target)")
    q["recode_dim_profile"] = f"""WITH dim_all(domain, raw, target) AS (
        SELECT 'sex', * FROM (VALUES {SEX_VALUES}) t(raw, target)
        UNION ALL SELECT 'descent', * FROM (VALUES {DESCENT_VALUES}) t(raw, target)
        UNION ALL SELECT 'premise', * FROM ({premise_all})
        UNION ALL SELECT 'premise_pass2', * FROM (VALUES {PREMISE2_VALUES}) t(raw, target)
        UNION ALL SELECT 'weapon', 'null', 'Unknown'
        UNION ALL SELECT 'crime', upper(p_name),
               upper(substr(split_part(p_name, ' ', 2), 1, 1)) || lower(substr(split_part(p_name, ' ', 2), 2))
               FROM part WHERE split_part(p_name, ' ', 2) <> 'gizmo'
        UNION ALL SELECT 'weapon', upper(p_brand),
               'Group ' || CAST(CAST(regexp_extract(p_brand, '(\\d+)', 1) AS INTEGER) % 8 AS VARCHAR) FROM part)
        SELECT domain, count(*) AS entries, count(DISTINCT raw) AS keys, count(DISTINCT target) AS targets
        FROM dim_all GROUP BY domain"""
    q["recode_unmapped"] = f"""WITH {RAW_CTE},
{DIM_CTE},
keys(domain, raw) AS (
  SELECT 'sex', raw FROM dim_sex UNION ALL SELECT 'descent', raw FROM dim_descent
  UNION ALL SELECT 'crime', raw FROM dim_crime UNION ALL SELECT 'weapon', raw FROM dim_weapon
  UNION ALL SELECT 'premise', raw FROM dim_premise1 UNION ALL SELECT 'premise', raw FROM dim_premise2),
pairs(domain, value) AS (
  SELECT 'sex', vict_sex FROM raw_incidents UNION ALL SELECT 'descent', vict_descent FROM raw_incidents
  UNION ALL SELECT 'crime', crm_cd_desc FROM raw_incidents UNION ALL SELECT 'premise', premis_desc FROM raw_incidents
  UNION ALL SELECT 'weapon', weapon_desc FROM raw_incidents)
SELECT domain, value, count(*) AS n FROM pairs p
WHERE value IS NOT NULL AND NOT EXISTS (SELECT 1 FROM keys k WHERE k.domain = p.domain AND k.raw = p.value)
GROUP BY domain, value"""

    q["top_crime"] = _top("crm_cd_desc")
    q["top_weapon"] = _top("weapon_desc")
    q["top_area"] = _top("area_name")
    q["top_descent"] = _top("vict_descent")
    q["count_by_sex"] = with_clean("SELECT vict_sex, count(*) AS crime_count FROM clean GROUP BY vict_sex")
    q["age_dist"] = with_clean("SELECT vict_age, count(*) AS count FROM clean GROUP BY vict_age")
    q["age_sex_dist"] = with_clean("SELECT vict_age, vict_sex, count(*) AS count FROM clean GROUP BY ALL")
    q["year_trend"] = with_clean(f"""SELECT * FROM (
        SELECT CAST(year(try_strptime(date_occ, '%m-%d-%Y')) AS INTEGER) AS year, count(*) AS count
        FROM clean GROUP BY 1) t WHERE year <> {EXCLUDED_YEAR}""")
    q["month_trend"] = with_clean(f"""SELECT CAST(month(d) AS INTEGER) AS month, count(*) AS count
        FROM (SELECT CAST(try_strptime(date_occ, '%m-%d-%Y') AS DATE) AS d FROM clean) t
        WHERE d >= DATE '{start}' AND d < DATE '{end}' GROUP BY 1""")
    q["weekday_trend"] = with_clean("""SELECT dayname(try_strptime(date_occ, '%m-%d-%Y')) AS day_of_week,
        count(*) AS count FROM clean WHERE try_strptime(date_occ, '%m-%d-%Y') IS NOT NULL GROUP BY 1""")
    q["count_by_area_hispanic"] = _by_area("Hispanic/Latin")
    q["count_by_area_black"] = _by_area("Black")
    q["count_by_area_white"] = _by_area("White")
    q["area_by_group_wide"] = with_clean("""SELECT area_name,
        count(*) FILTER (WHERE vict_descent = 'Hispanic/Latin') AS n_hispanic_latin,
        count(*) FILTER (WHERE vict_descent = 'Black') AS n_black,
        count(*) FILTER (WHERE vict_descent = 'White') AS n_white
        FROM clean GROUP BY area_name""")
    q["basket_build"] = with_clean(f"""SELECT array_to_string(list_sort(list_distinct(list_filter(
        [{basket}], lambda x: x IS NOT NULL))), ',') AS items FROM clean WHERE {no_placeholder}""")

    q["incident_itemsets"] = (_incident_rules_cte()
                              + "\nSELECT items, CAST(len(item_list) AS INTEGER) AS size, freq FROM itemsets")
    q["incident_rules"] = (_incident_rules_cte() + """
SELECT antecedent, consequent, round(confidence, 6) AS confidence, round(lift, 6) AS lift,
       round(support, 6) AS support FROM rules""")
    q["incident_rule_predict"] = _incident_rules_cte() + """,
seen AS (SELECT DISTINCT item_list FROM test),
answers AS (SELECT s.item_list, string_agg(DISTINCT r.consequent, ',' ORDER BY r.consequent) AS prediction
            FROM seen s JOIN rules r ON list_has_all(s.item_list, r.antecedent_list)
                                    AND NOT list_contains(s.item_list, r.consequent) GROUP BY s.item_list)
SELECT t.key AS dr_no, array_to_string(t.item_list, ',') AS items, coalesce(a.prediction, '') AS prediction
FROM test t LEFT JOIN answers a ON t.item_list = a.item_list"""
    q["freq_itemsets"] = f"WITH {EVENT_ITEMS_CTE}\nSELECT items, CAST(len(item_list) AS INTEGER) AS size, freq FROM itemsets"
    q["assoc_rules"] = f"""WITH {EVENT_ITEMS_CTE}
SELECT antecedent, consequent, round(confidence, 6) AS confidence, round(lift, 6) AS lift,
       round(support, 6) AS support FROM rules"""
    q["rule_predict"] = f"""WITH {EVENT_ITEMS_CTE},
test AS (SELECT event_id, list_sort([kind, weekday, week_part, half_day, value_band]) AS item_list
         FROM ev WHERE NOT is_train),
hits AS (
  SELECT t.event_id, r.consequent FROM test t JOIN rules r
    ON list_has_all(t.item_list, r.antecedent_list) AND NOT list_contains(t.item_list, r.consequent))
SELECT t.event_id, array_to_string(t.item_list, ',') AS items,
       coalesce((SELECT string_agg(DISTINCT h.consequent, ',' ORDER BY h.consequent)
                 FROM hits h WHERE h.event_id = t.event_id), '') AS prediction
FROM test t"""

    q["key_split"] = with_raw(f"""SELECT dr_no, CASE WHEN {_IN_TRAIN} THEN 'train' ELSE 'test' END
        AS split FROM raw_incidents""")
    q["string_index"] = with_clean("""SELECT value, CAST(row_number() OVER (ORDER BY count DESC, value) - 1 AS INTEGER)
        AS index, count FROM (SELECT vict_descent AS value, count(*) AS count FROM clean
        WHERE vict_descent IS NOT NULL GROUP BY 1) t""")
    q["label_index"] = with_raw("""SELECT value, CAST(row_number() OVER (ORDER BY count DESC, value) - 1 AS INTEGER)
        AS index, count FROM (SELECT status_desc AS value, count(*) AS count FROM raw_incidents
        WHERE status_desc IS NOT NULL GROUP BY 1) t""")
    q["one_hot"] = with_clean("""SELECT value, index, CAST(n - 1 AS INTEGER) AS size,
        CAST(CASE WHEN index < n - 1 THEN index ELSE -1 END AS INTEGER) AS hot
        FROM (SELECT value, CAST(row_number() OVER (ORDER BY count DESC, value) - 1 AS INTEGER) AS index,
                     count(*) OVER () AS n
              FROM (SELECT vict_descent AS value, count(*) AS count FROM clean
                    WHERE vict_descent IS NOT NULL GROUP BY 1) t) u""")
    q["assemble"] = with_raw("""SELECT dr_no, CAST(TRY_CAST(vict_age AS INTEGER) AS DOUBLE) AS f_vict_age,
        CAST(TRY_CAST(crm_cd AS INTEGER) AS DOUBLE) AS f_crm_cd,
        CAST(TRY_CAST(premis_cd AS INTEGER) AS DOUBLE) AS f_premis_cd,
        CAST(TRY_CAST(weapon_used_cd AS INTEGER) AS DOUBLE) AS f_weapon_used_cd
        FROM raw_incidents
        WHERE TRY_CAST(vict_age AS INTEGER) IS NOT NULL AND TRY_CAST(crm_cd AS INTEGER) IS NOT NULL
          AND TRY_CAST(premis_cd AS INTEGER) IS NOT NULL AND TRY_CAST(weapon_used_cd AS INTEGER) IS NOT NULL""")
    casts = {c: f"TRY_CAST({c} AS INTEGER)" for c in ["vict_age", "crm_cd", "premis_cd", "weapon_used_cd"]}
    any_null = " OR ".join(f"{e} IS NULL" for e in casts.values())
    per = ", ".join(f"count(*) FILTER (WHERE {e} IS NULL) AS null_{c}" for c, e in casts.items())
    q["assemble_skipped"] = with_raw(f"""SELECT count(*) AS rows, count(*) FILTER (WHERE {any_null}) AS skipped,
        {per} FROM raw_incidents""")
    _classifier_sql(q)
    return q


def _classifier_sql(q: dict[str, str]) -> None:
    """Category codes, the assembled vector, the scored rows and the metrics."""
    cats = ["vict_sex", "vict_descent", "premis_desc", "weapon_desc", "location"]
    ints = ["vict_age", "crm_cd", "premis_cd", "rpt_dist_no", "weapon_used_cd"]
    known = " AND ".join(f"{c} IS NOT NULL" for c in cats)
    typed = " AND ".join(f"TRY_CAST({c} AS INTEGER) IS NOT NULL" for c in ints)

    def codes(column, rows):
        return f"""(SELECT value, CAST(row_number() OVER (ORDER BY n DESC, value) - 1 AS INTEGER) AS index, n,
            CAST(count(*) OVER () AS INTEGER) AS size
            FROM (SELECT {column} AS value, count(*) AS n FROM {rows} WHERE {column} IS NOT NULL GROUP BY 1) t)"""

    q["index_five"] = with_raw(" UNION ALL ".join(
        f"""SELECT '{c}' AS input, i.value, i.index, count(*) AS count
            FROM (SELECT * FROM raw_incidents WHERE {known}) r JOIN {codes(c, 'raw_incidents')} i ON r.{c} = i.value
            GROUP BY ALL""" for c in cats))
    q["address_hashed"] = with_raw(f"""SELECT location, count(*) AS count, CAST(1 AS BIGINT) AS slots,
        CAST({HASH_WIDTH} AS INTEGER) AS width, CAST(1 AS INTEGER) AS nonzero
        FROM raw_incidents WHERE location IS NOT NULL GROUP BY location""")
    indexed = cats[:-1]
    encoded = ["vict_sex", "vict_descent", "premis_desc"]     # the weapon text is indexed (and skips rows), but no input
    joins = " ".join(f"JOIN {codes(c, 'raw_incidents')} i_{c} ON r.{c} = i_{c}.value" for c in indexed)
    hot = ", ".join(f"CASE WHEN i_{c}.index < i_{c}.size - 1 THEN i_{c}.index ELSE -1 END AS hot_{c}" for c in encoded)
    width = " + ".join(f"i_{c}.size - 1" for c in encoded)
    numbers = ", ".join(f"CAST(TRY_CAST({c} AS INTEGER) AS DOUBLE) AS f_{c}" for c in ints)
    q["assemble_nine"] = with_raw(f"""SELECT dr_no, CAST({width} + 5 + {HASH_WIDTH} AS INTEGER) AS width, {numbers}, {hot},
        CAST(1 AS INTEGER) AS nonzero_location FROM raw_incidents r {joins} WHERE {known} AND {typed}""")
    seen = " AND ".join(f"{c} IN (SELECT {c} FROM train)" for c in [*indexed, "status_desc"])
    q["rf_scored_keys"] = f"""WITH {RAW_CTE},
train AS (SELECT * FROM raw_incidents WHERE {_IN_TRAIN} AND location IS NOT NULL)
SELECT dr_no, l.index AS label, TRY_CAST(vict_age AS INTEGER) AS vict_age, {', '.join(cats)}, status_desc
FROM raw_incidents r JOIN {codes('status_desc', 'train')} l ON r.status_desc = l.value
WHERE NOT {_IN_TRAIN} AND {known} AND {typed} AND {seen}"""
    baseline = f"""WITH {RAW_CTE},
known AS (SELECT premis_desc, status_desc, {_IN_TRAIN} AS in_train FROM raw_incidents WHERE premis_desc IS NOT NULL),
codes AS (SELECT * FROM {codes('status_desc', '(SELECT * FROM known WHERE in_train)')}),
best AS (SELECT premis_desc, arg_max(index, (n, -index)) AS prediction
         FROM (SELECT k.premis_desc, c.index, count(*) AS n FROM known k JOIN codes c ON k.status_desc = c.value
               WHERE in_train GROUP BY ALL) t GROUP BY premis_desc),
scored AS (SELECT c.index AS label, CAST(coalesce(b.prediction, 0) AS INTEGER) AS prediction
           FROM known k JOIN codes c ON k.status_desc = c.value LEFT JOIN best b ON k.premis_desc = b.premis_desc
           WHERE NOT in_train)"""
    q["baseline_accuracy"] = baseline + """
SELECT count(*) AS scored, CAST(sum(CASE WHEN label = prediction THEN 1 ELSE 0 END) AS BIGINT) AS correct,
       avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END) AS accuracy FROM scored"""
    q["baseline_confusion"] = baseline + "\nSELECT label, prediction, count(*) AS count FROM scored GROUP BY ALL"
