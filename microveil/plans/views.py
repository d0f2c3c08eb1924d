"""Person-like views over the driver's tables, in integer arithmetic only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FLAGS = ["white", "black", "asian", "hisp"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One person per order: pid, side (0 left, 1 right), block and the spine above it, sex, age, flags, pik, draw r."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    x = o.join(c, F.col("o_custkey") == F.col("c_custkey"))
    return x.selectExpr(
        "o_orderkey AS pid", "o_orderkey % 2 AS side",
        "lpad(cast(c_nationkey div 5 as string), 2, '0') || lpad(cast(c_nationkey as string), 3, '0') || lpad(cast((o_custkey % 40) div 10 as string), 6, '0') || lpad(cast(o_custkey % 40 as string), 4, '0') AS block",
        "((o_orderkey div 2) % 3) % 2 AS sex", "(o_orderkey * 37) % 91 AS age",
        "cast((o_orderkey div 2) % 10 < 7 as bigint) AS white", "cast((o_orderkey div 2) % 10 IN (7, 8) as bigint) AS black", "cast((o_orderkey div 2) % 10 = 9 as bigint) AS asian",
        "cast(((o_orderkey div 2) div 10) % 6 = 0 as bigint) AS hisp", "o_custkey AS pik", "(o_orderkey * 7919) % 1000003 AS r",
    ).withColumns({"state": F.substring("block", 1, 2), "county": F.substring("block", 1, 5), "tract": F.substring("block", 1, 11), "race": F.expr("concat(white, black, asian, hisp)")})


def left_right(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    p = people(spark, sf_dir)
    keep = F.when(F.row_number().over(Window.partitionBy("block", "pik").orderBy("r", "pid")) == 1, 1).otherwise(0)
    return p.where("side = 0"), p.where("side = 1").withColumn("keep", keep)


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every block there is, also where nobody lives: block, its county's number nk and its own number k."""
    c = table(spark, sf_dir, "customer").selectExpr("c_nationkey AS nk", "c_custkey % 40 AS k").distinct()
    return c.selectExpr("lpad(cast(nk div 5 as string), 2, '0') || lpad(cast(nk as string), 3, '0') || lpad(cast(k div 10 as string), 6, '0') || lpad(cast(k as string), 4, '0') AS block", "nk", "k")


#: The same for the oracle.
BLOCKS_SQL = """b AS (SELECT DISTINCT lpad(CAST(c_nationkey // 5 AS VARCHAR), 2, '0') || lpad(CAST(c_nationkey AS VARCHAR), 3, '0')
    || lpad(CAST((c_custkey % 40) // 10 AS VARCHAR), 6, '0') || lpad(CAST(c_custkey % 40 AS VARCHAR), 4, '0') AS block, c_nationkey AS nk, c_custkey % 40 AS k FROM customer)"""

#: The same views for the oracle: p (people), l and g (left, right), q (right with keep).
PEOPLE_SQL = """p AS (
  SELECT o_orderkey AS pid, o_orderkey % 2 AS side,
    lpad(CAST(c_nationkey // 5 AS VARCHAR), 2, '0') || lpad(CAST(c_nationkey AS VARCHAR), 3, '0') || lpad(CAST((o_custkey % 40) // 10 AS VARCHAR), 6, '0') || lpad(CAST(o_custkey % 40 AS VARCHAR), 4, '0') AS block,
    ((o_orderkey // 2) % 3) % 2 AS sex, (o_orderkey * 37) % 91 AS age,
    CAST((o_orderkey // 2) % 10 < 7 AS BIGINT) AS white, CAST((o_orderkey // 2) % 10 IN (7, 8) AS BIGINT) AS black, CAST((o_orderkey // 2) % 10 = 9 AS BIGINT) AS asian,
    CAST(((o_orderkey // 2) // 10) % 6 = 0 AS BIGINT) AS hisp, o_custkey AS pik, (o_orderkey * 7919) % 1000003 AS r
  FROM orders JOIN customer ON o_custkey = c_custkey),
pp AS (SELECT *, substr(block, 1, 2) AS state, substr(block, 1, 5) AS county, substr(block, 1, 11) AS tract, white::VARCHAR || black::VARCHAR || asian::VARCHAR || hisp::VARCHAR AS race FROM p),
l AS (SELECT * FROM pp WHERE side = 0), g AS (SELECT * FROM pp WHERE side = 1),
q AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY block, pik ORDER BY r, pid) = 1 THEN 1 ELSE 0 END AS keep FROM g)"""

AGEBIN_SQL = "CASE WHEN {0} <= 21 THEN {0} WHEN {0} < 25 THEN 22 WHEN {0} < 30 THEN 25 WHEN {0} < 35 THEN 30 WHEN {0} < 40 THEN 35 WHEN {0} < 45 THEN 40 WHEN {0} < 50 THEN 45 WHEN {0} < 55 THEN 50 WHEN {0} < 60 THEN 55 WHEN {0} < 62 THEN 60 WHEN {0} < 65 THEN 62 WHEN {0} < 67 THEN 65 WHEN {0} < 70 THEN 67 WHEN {0} < 75 THEN 70 WHEN {0} < 80 THEN 75 WHEN {0} < 85 THEN 80 ELSE 85 END"


def agebin_sql(x: str) -> str:
    return AGEBIN_SQL.format(x)
