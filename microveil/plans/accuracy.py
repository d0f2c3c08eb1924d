"""Queries over complete domains and geographies off the spine, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from microveil.functions import bins
from microveil.operators import metrics
from microveil.plans.catalog import CHARACTERISTICS, GQ, _stats_sql, quartered
from microveil.plans.registry import query, with_people
from microveil.plans.views import BLOCKS_SQL, blocks, table

# Units of each block by its county number nk and its own number k, null where it belongs to none; a name twice gives two.
UNITS = [
    ("County", "substr(block, 1, 5)"),
    ("Tract", "substr(block, 1, 11)"),
    ("Urban block", "CASE WHEN k % 4 <> 0 THEN block END"),
    ("Rural block", "CASE WHEN k % 4 = 0 THEN block END"),
    ("Place", "CASE WHEN k % 5 <> 0 THEN lpad(cast(nk * 2 + k % 2 AS string), 7, '0') END"),
    ("ESD", "CASE WHEN k % 3 = 0 THEN lpad(cast(nk * 4 + k % 4 AS string), 7, '0') END"),
    ("SSD", "CASE WHEN k % 3 = 1 THEN lpad(cast(nk * 3 + k % 2 AS string), 7, '0') END"),
    ("USD", "CASE WHEN k % 3 = 2 THEN lpad(cast(nk AS string), 7, '0') END"),
    ("MCD", "lpad(cast(nk * 10 + k % 10 AS string), 10, '0')"),
    ("Fed AIR", "CASE WHEN k % 7 = 0 THEN lpad(cast(nk AS string), 4, '0') || 'R' END"),
    ("OTSA", "CASE WHEN nk % 4 = 0 THEN lpad(cast(nk * 3 AS string), 4, '0') || 'T' END"),
    ("ANVSA", "CASE WHEN k % 11 = 0 THEN lpad(cast(nk + 1000 AS string), 4, '0') || 'A' END"),
    ("ANVSA", "CASE WHEN k % 22 = 0 THEN lpad(cast(nk % 3 AS string), 4, '0') || 'B' END"),
    ("AIANNH", "CASE WHEN k % 7 = 0 THEN lpad(cast(nk AS string), 4, '0') || 'R' END"),
    ("AIANNH", "CASE WHEN k % 11 = 0 THEN lpad(cast(nk + 1000 AS string), 4, '0') || 'A' END"),
]
#: Units that no block belongs to.
EMPTY = [("Place", "9999999"), ("Place", "9999998"), ("ANVSA", "999ZB"), ("Tract", "99999999999"), ("County", "99999")]

GEOGRAPHIES = [
    metrics.Geography("County", 5, sizes=lambda h: bins.left_closed(h, (0, 250, 300)), complete=False),
    metrics.Geography("Tract", 11),
    metrics.Geography("Urban block", 15),
    metrics.Geography("Rural block", 15),
    metrics.Geography("Place", 7, sizes=lambda h: bins.left_closed(h, (0, 100, 150))),
    metrics.Geography("ESD", 7),
    metrics.Geography("SSD", 7),
    metrics.Geography("USD", 7),
    metrics.Geography("MCD", 10),
    metrics.Geography("Fed AIR", 5, base=36),
    metrics.Geography("OTSA", 5, base=36),
    metrics.Geography("ANVSA", 5, base=36, sizes=lambda h: bins.left_closed(h, (0, 20))),
    metrics.Geography("AIANNH", 5, base=36),
]

ETHNICITIES = ["hispanic", "not hispanic"]
RACES = ["white", "black", "asian", "other", "two or more"]
SEX_AGES = [f"{s} {a}" for s in ("male", "female") for a in ("0-17", "18-64", "65+")]
CATEGORIES = {
    "total": ["population"],
    "adult": ["population"],
    "ethnicity": ETHNICITIES,
    "race": RACES,
    "ethnicity and race": [f"{e} {r}" for e in ETHNICITIES for r in RACES],
    "sex and age": SEX_AGES,
    "races": [str(n) for n in range(1, 7)],
    "quarters": ["INST", "NONINST"],
    "over 75": ["population"],
}


def _twelve_sql() -> str:
    sql = lambda x: x.replace("AS string", "AS VARCHAR")
    walk = " UNION ALL ".join(f"SELECT block, '{g}' AS geography, {sql(u)} AS unit FROM b" for g, u in UNITS)
    empty = ", ".join(str(x) for x in EMPTY)
    labels = ", ".join(f"CASE WHEN ({c}) IS NOT NULL THEN concat_ws(' ', '{n}', {c}) END" for n, c in CHARACTERISTICS.items() if n in CATEGORIES).replace("AS STRING", "AS VARCHAR")
    cats = ", ".join(f"('{n} {v}')" for n, values in CATEGORIES.items() for v in values)
    sized = "CASE WHEN geography = 'County' THEN CASE WHEN total < 250 THEN '0' WHEN total < 300 THEN '250' ELSE '300' END WHEN geography = 'Place' THEN CASE WHEN total < 100 THEN '0' WHEN total < 150 THEN '100' ELSE '150' END WHEN geography = 'ANVSA' THEN CASE WHEN total < 20 THEN '0' ELSE '20' END END"
    percent = "100 * (CASE WHEN h = 0 AND m = 0 THEN 0.0::DOUBLE WHEN h = 0 THEN (m - h)::DOUBLE / ((h + m) / 2.0::DOUBLE) ELSE (m - h)::DOUBLE / h END)"
    return f"""{BLOCKS_SQL},
w AS (SELECT DISTINCT * FROM ({walk}) WHERE unit IS NOT NULL),
dom AS (SELECT DISTINCT geography, unit FROM w UNION VALUES {empty}),
lab AS (SELECT block, side, unnest(list_filter([{labels}], lambda x: x IS NOT NULL)) AS characteristic FROM (SELECT *, {GQ} AS gq FROM pp)),
n AS (SELECT geography, unit, characteristic, count(*) FILTER (side = 0) AS h, count(*) FILTER (side = 1) AS m FROM lab JOIN w USING (block) GROUP BY 1, 2, 3),
c AS (SELECT geography, unit, characteristic, coalesce(n.h, 0) AS h, coalesce(n.m, 0) AS m FROM dom CROSS JOIN (VALUES {cats}) k(characteristic) LEFT JOIN n USING (geography, unit, characteristic) WHERE geography <> 'County' OR n.h IS NOT NULL),
c2 AS (SELECT *, max(CASE WHEN characteristic = 'total population' THEN h END) OVER (PARTITION BY geography, unit) AS total FROM c),
c3 AS (SELECT *, m - h AS df, abs(m - h) AS ad, {percent} AS pd FROM c2),
e AS (SELECT *, 'all' AS size_class FROM c3 UNION ALL SELECT * FROM (SELECT *, {sized} AS size_class FROM c3) WHERE size_class IS NOT NULL)
{_stats_sql("geography, size_class, characteristic")}"""


def crosswalk(spark, d):
    """(block, geography, unit) of every block, many to many."""
    rows = F.explode(F.array(*[F.struct(F.lit(g).alias("geography"), F.expr(u).alias("unit")) for g, u in UNITS])).alias("x")
    return blocks(spark, d).select("block", rows).select("block", "x.*").where("unit IS NOT NULL")


@query(with_people(", " + _twelve_sql()))
def metric_all_geographies(spark, d):
    walk = crosswalk(spark, d)
    domain = walk.select("geography", "unit").unionByName(spark.createDataFrame(EMPTY, "geography string, unit string"))
    labels = {n: F.expr(CHARACTERISTICS[n]) for n in CATEGORIES if n != "quarters"} | {"quarters": bins.gq_institution(F.col("gq"))}
    return metrics.complete_catalogue(quartered(spark, d), "side", "block", walk, domain, GEOGRAPHIES, labels, CATEGORIES)


@query("""WITH v AS (SELECT c_nationkey, c_custkey % 17 AS v FROM customer),
s AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY v) AS i, count(*) OVER (PARTITION BY c_nationkey) AS n FROM v),
p(name, num, den) AS (VALUES ('p10', 1, 10), ('p50', 1, 2), ('p75', 3, 4)),
r AS (SELECT c_nationkey, name, avg(v) FILTER (i BETWEEN (n * num + den - 1) // den AND CASE WHEN n * num % den = 0 THEN n * num // den + 1 ELSE (n * num + den - 1) // den END) AS x FROM s, p GROUP BY 1, 2)
SELECT c_nationkey, max(x) FILTER (name = 'p10') AS p10, max(x) FILTER (name = 'p50') AS p50, max(x) FILTER (name = 'p75') AS p75 FROM r GROUP BY 1""")
def averaged_percentiles(spark, d):
    x = table(spark, d, "customer").select("c_nationkey", (F.col("c_custkey") % 17).alias("v"))
    return metrics.percentiles(x, ["c_nationkey"], {"p10": ("v", 0.1), "p50": ("v", 0.5), "p75": ("v", 0.75)}, "averaged")
