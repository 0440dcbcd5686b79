"""Stand-in incident data built from the driver's test tables.

No real incident file is available, so an incident table with the raw
layout (28 text columns) is derived from the TPC-H-like tables, one incident
per ``lineitem`` row (about 600k rows at sf0.1, close to the ~750k rows of a
real city file).  NULLs, the text ``null``, sentinel ages, bad age text and
invalid dates are injected by fixed rules so every cleaning rule has work.

Column mapping (raw name <- stand-in):

=================  ==========================================================
DR_NO              l_orderkey * 10 + l_linenumber; NULL when p_size = 47 and line 7,
                   a text number ``T...`` when p_size = 46 and line 7
Date Rptd          l_shipdate as ``MM/dd/yyyy hh:mm:ss a``
Date OCC           o_orderdate, same text; ``13/45/2000 ...`` when p_size = 49
                   and line 7
TIME OCC           unpadded HHMM digits from l_partkey, l_linenumber, l_suppkey
AREA / AREA NAME   c_nationkey / n_name
Crm Cd Desc        upper(p_name)             (64 values)
Vict Age           (l_orderkey + line) % 60 - 3; ``X`` when p_size = 50
Vict Sex           o_orderstatus F/O/P -> F/M/X; ``H`` and NULL on some P lines
Vict Descent       one of the 19 descent codes or ``-`` by c_custkey % 20;
                   NULL / ``null`` on some lines
Premis Desc        p_type; ``null`` / NULL on some P lines
Weapon Desc        upper(p_brand); ``null`` / NULL on some P lines
Status / Desc      by pattern and age; l_returnflag on a fifth of the rows
LOCATION           c_name (high cardinality)
LAT / LON          decimal text from c_custkey
=================  ==========================================================

Columns depend on one another through a pattern, (l_orderkey + l_partkey) % 10:
four in ten incidents are gear crimes with BRAND#11 on an ECONOMY premise and
descent ``H``, three in ten are rod crimes with BRAND#22 on a MEDIUM premise,
the rest follow the part.  So rules and a status classifier have something to find.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from blotter.schema import RAW_COLUMNS, normalize_names
from blotter.session import input_bytes
from blotter.sources.dims import DESCENT_CODES, SEX_CODES, recode_dim

RAW_TEXT_FORMAT = "MM/dd/yyyy hh:mm:ss a"

# Stand-in code letters: the 19 descent codes in dictionary order plus one unmapped code.
DESCENT_STANDIN_CODES = list(DESCENT_CODES) + ["-"]


#: Shares in which a raw file is written if the lineitem table has more bytes than ``ONE_TURN``.
TURNS, ONE_TURN = 4, 1 << 30


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _s(c: Column) -> Column:
    return c.cast("string")


def raw_incidents(spark: SparkSession, sf_dir: str, normalize: bool = True) -> DataFrame:
    """The raw incident table (all text), with snake_case names unless ``normalize=False``."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag",
        "l_linestatus", "l_shipdate")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    # nation has 25 rows at every scale: a fixed bound, safe to broadcast.
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")

    if normalize:  # the forest's bootstrap follows the order of the rows, and that the order of the joins
        j = (li.join(o, li.l_orderkey == o.o_orderkey)
               .join(c, o.o_custkey == c.c_custkey)
               .join(F.broadcast(n), c.c_nationkey == n.n_nationkey)
               .join(p, li.l_partkey == p.p_partkey))
    else:  # for a file: lineitem, the largest, is dealt anew twice and not three times, and never with the customers' columns
        placed = o.join(c, o.o_custkey == c.c_custkey).join(F.broadcast(n), c.c_nationkey == n.n_nationkey)
        j = li.join(p, li.l_partkey == p.p_partkey).join(placed, li.l_orderkey == o.o_orderkey)

    ln = F.col("l_linenumber")
    st = F.col("o_orderstatus")
    p_line = lambda k: (st == "P") & (ln == k)
    null = F.lit(None).cast("string")
    pattern = (F.col("l_orderkey") + F.col("l_partkey")) % 10
    first, second = pattern < 4, (pattern >= 4) & (pattern < 7)
    patterned = lambda a, b, c: F.when(first, a).when(second, b).otherwise(c)
    brand = patterned(F.lit("BRAND#11"), F.lit("BRAND#22"), F.upper("p_brand"))
    weapon = F.when(p_line(2), "null").when(p_line(1), null).otherwise(brand)
    kind = F.upper(F.split("p_name", " ")[0])
    age = (F.col("l_orderkey") + ln) % 60 - 3
    number = _s(F.col("l_orderkey") * 10 + ln)
    status = (F.when(F.col("l_suppkey") % 5 == 0, F.col("l_returnflag")).when(first, "A").when(second, "R")
               .otherwise(F.when(age >= 30, "N").otherwise("R")))
    code_of = lambda k: _s(F.col("l_partkey") % 97 + k)

    cols = {
        "DR_NO": F.when((F.col("p_size") == 47) & (ln == 7), null)
                  .when((F.col("p_size") == 46) & (ln == 7), F.concat(F.lit("T"), number)).otherwise(number),
        "Date Rptd": F.date_format("l_shipdate", RAW_TEXT_FORMAT),
        "Date OCC": F.when((F.col("p_size") == 49) & (ln == 7), F.lit("13/45/2000 12:00:00 AM"))
                     .otherwise(F.date_format("o_orderdate", RAW_TEXT_FORMAT)),
        "TIME OCC": _s(((F.col("l_partkey") * 7 + ln) % 24) * 100 + F.col("l_suppkey") % 60),
        "AREA": _s(F.col("c_nationkey")),
        "AREA NAME": F.col("n_name"),
        "Rpt Dist No": _s(F.col("c_nationkey") * 100 + F.col("n_regionkey") * 10 + ln),
        "Part 1-2": F.when(F.col("l_linestatus") == "F", "1").otherwise("2"),
        "Crm Cd": code_of(100),
        "Crm Cd Desc": patterned(F.concat(kind, F.lit(" GEAR")), F.concat(kind, F.lit(" ROD")), F.upper("p_name")),
        "Mocodes": _s(F.col("l_suppkey")),
        "Vict Age": F.when(F.col("p_size") == 50, F.lit("X"))
                     .otherwise(_s(age)),
        "Vict Sex": F.when(p_line(7), null).when(p_line(6), "H")
                     .when(st == "F", "F").when(st == "O", "M").otherwise("X"),
        "Vict Descent": F.when(p_line(5), null).when((st == "F") & (ln == 7), "null")
                         .when(first, "H")
                         .otherwise(F.element_at(F.array(*[F.lit(x) for x in DESCENT_STANDIN_CODES]),
                                                 (F.col("c_custkey") % 20 + 1).cast("int"))),
        "Premis Cd": _s(F.col("p_size") + 500),
        "Premis Desc": F.when(p_line(4), "null").when(p_line(3), null)
                        .otherwise(patterned(F.lit("ECONOMY"), F.lit("MEDIUM"), F.col("p_type"))),
        "Weapon Used Cd": F.when(p_line(1), null)
                           .otherwise(_s(F.regexp_extract(brand, r"(\d+)", 1).cast("int") + 100)),
        "Weapon Desc": weapon,
        "Status": status,
        "Status Desc": F.when(status == "A", "Adult Arrest").when(status == "R", "Invest Cont")
                        .otherwise("Adult Other"),
        "Crm Cd 1": code_of(100),
        "Crm Cd 2": F.when(ln == 7, code_of(300)).otherwise(null),
        "Crm Cd 3": null,
        "Crm Cd 4": null,
        "LOCATION": F.col("c_name"),
        "Cross Street": F.when(ln == 3, F.concat(F.lit("STREET "), _s(F.col("l_suppkey")))).otherwise(null),
        "LAT": F.when((F.col("p_size") == 48) & (ln == 7), F.lit("n/a")).otherwise(
            _s((F.lit(33.7).cast("decimal(3,1)") + (F.col("c_custkey") % 500) * F.lit(0.001).cast("decimal(4,3)"))
               .cast("decimal(8,4)"))),
        "LON": _s((F.lit(-118.6).cast("decimal(4,1)") + (F.col("c_custkey") % 700) * F.lit(0.001).cast("decimal(4,3)"))
                  .cast("decimal(9,4)")),
    }
    out = j.select(*[cols[name].alias(name) for name in RAW_COLUMNS])
    return normalize_names(out) if normalize else out


def in_turns(raw: DataFrame, sf_dir: str) -> list[DataFrame]:
    """All rows of a raw file (``normalize=False``), in shares to be written one after the other if they are many.

    What the joins of one share have shuffled is gone before the next one begins.  The shares go by a column that comes from
    lineitem alone, so their filter is applied where lineitem is read.
    """
    if input_bytes(raw.sparkSession, f"{sf_dir.rstrip('/')}/lineitem.parquet") <= ONE_TURN:
        return [raw]
    return [raw.filter(F.pmod(F.xxhash64("Mocodes"), F.lit(TURNS)) == i) for i in range(TURNS)]


# --- stand-in dictionaries -------------------------------------------------
# Premise: first and second pass, with a repeated key (same target), an
# identity entry, the text ``null``, and a second-pass key already handled
# by the first pass.  STANDARD stays unmapped.
PREMISE_PASS1 = [
    ("ECONOMY", "Commercial Area"),
    ("LARGE", "Public Area"),
    ("MEDIUM", "Residential Area"),
    ("PROMO", "Commercial Area"),
    ("PROMO", "Commercial Area"),
    ("null", "Unknown"),
    ("Public Area", "Public Area"),
]
PREMISE_PASS2 = [
    ("SMALL", "Residential Area"),
    ("ECONOMY", "Recreational Area"),
]


def standin_recode_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``recode_dim(domain, raw, target)`` for the stand-in vocabulary.

    ``sex`` and ``descent`` are the code dictionaries; ``crime`` maps each
    part name to its noun (64 -> 8, ``gizmo`` left unmapped) and ``weapon``
    each brand to one of eight groups, both derived by Spark from ``part``
    so they follow the data's vocabulary; ``premise`` / ``premise_pass2`` are
    the two fixed passes above.
    """
    part = table(spark, sf_dir, "part")
    noun = F.element_at(F.split("p_name", " "), 2)
    crime = (part.filter(noun != "gizmo")
                 .select(F.lit("crime").alias("domain"), F.upper("p_name").alias("raw"),
                         F.initcap(noun).alias("target")))
    brand_no = F.regexp_extract("p_brand", r"(\d+)", 1).cast("int")
    weapon = part.select(F.lit("weapon").alias("domain"), F.upper("p_brand").alias("raw"),
                         F.concat(F.lit("Group "), _s(brand_no % 8)).alias("target"))
    fixed = recode_dim(spark,
                       [("sex", k, v) for k, v in SEX_CODES.items()]
                       + [("descent", k, v) for k, v in DESCENT_CODES.items()]
                       + [("premise", k, v) for k, v in PREMISE_PASS1]
                       + [("premise_pass2", k, v) for k, v in PREMISE_PASS2]
                       + [("weapon", "null", "Unknown")])
    return fixed.unionByName(crime).unionByName(weapon)


# --- events basket for rule mining ------------------------------------------
def events_basket_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five item columns per event: type, weekday name, weekend flag, half of day, value band.

    Item texts are distinct across the five columns, so every basket holds
    five distinct items.
    """
    ev = table(spark, sf_dir, "events").select("event_id", "ts", "event_type", "value")
    day = F.date_format("ts", "EEEE")
    return ev.select(
        "event_id",
        F.col("event_type").alias("kind"),
        day.alias("weekday"),
        F.when(day.isin("Saturday", "Sunday"), "weekend").otherwise("workday").alias("week_part"),
        F.when(F.hour("ts") < 12, "AM").otherwise("PM").alias("half_day"),
        F.when(F.col("value") < 20, "value<20").when(F.col("value") < 50, "value20-50")
         .otherwise("value50+").alias("value_band"),
    )


EVENT_ITEM_COLUMNS = ["kind", "weekday", "week_part", "half_day", "value_band"]
