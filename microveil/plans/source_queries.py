"""Queries that write the given tables in each format to the shared folder and read them back, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from microveil.functions import recode
from microveil.operators import models, tabulate
from microveil.plans.registry import query, with_people
from microveil.plans.views import people, table
from microveil.sources import readers, writers, zip_source

# sinks that survive a run that is repeated


@query("SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 2 = 0 THEN 'even' ELSE 'odd' END AS run FROM orders WHERE o_orderkey % 4 <> 3")
def append_twice(spark, d):
    """Two runs, one of which is tried three times, once without getting to its end."""
    folder = writers.shared_folder(spark, "append")
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey").where("o_orderkey % 4 <> 3")
    writers.append_once(o.where("o_orderkey % 2 = 0"), folder, "even", ["o_custkey"])
    writers.append_once(o.where("o_orderkey % 4 = 1"), folder, "odd", ["o_custkey"])
    o.where("o_orderkey % 2 = 1").write.parquet(f"{folder}/data/run=lost")  # has no manifest
    writers.append_once(o.where("o_orderkey % 2 = 1"), folder, "odd", ["o_custkey"])
    return writers.committed(spark, folder, "o_orderkey long, o_custkey long")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 2 = 0)")
def append_unfinished(spark, d):
    folder = writers.shared_folder(spark, "append")
    writers.append_once(table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey").where("o_orderkey % 2 = 0"), folder, "one", ["c_custkey"])
    return writers.unfinished(table(spark, d, "customer").select("c_custkey"), folder, ["c_custkey"])


# zip members


def _supplier_zips(spark, d):
    """A zip file for each nation of the suppliers with their fixed-width lines; its URI."""
    folder = writers.shared_folder(spark, "zips")
    s = table(spark, d, "supplier")
    line = F.concat(F.lpad(F.col("s_suppkey").cast("string"), 9, "0"), F.rpad("s_name", 25, " "), F.lpad(F.col("s_nationkey").cast("string"), 3, " "))
    nation = F.concat(F.lit("n"), F.col("s_nationkey").cast("string"))
    writers.zipped(s.select(nation.alias("nation"), "s_suppkey", line.alias("line")), folder, "nation", ["s_suppkey"])
    return folder


LAYOUT = [("s_suppkey", 1, 9, "bigint"), ("s_name", 10, 25, "string"), ("s_nationkey", 35, 3, "bigint")]


@query("SELECT s_suppkey, s_name, s_nationkey::BIGINT AS s_nationkey FROM supplier")
def zip_fixed_width(spark, d):
    return zip_source.fixed_width_members(spark, _supplier_zips(spark, d), r".*\.txt", LAYOUT).select("s_suppkey", "s_name", "s_nationkey")


@query("SELECT row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS n, s_suppkey FROM supplier WHERE s_nationkey = 3")
def zip_pushed_filter(spark, d):
    """Files that the filter rules out are no tasks."""
    x = zip_source.lines(spark, _supplier_zips(spark, d)).where(F.col("path").endswith("/n3.zip"))
    return x.select("n", F.substring("line", 1, 9).cast("bigint").alias("s_suppkey"))


# formats, written and read back


@query("SELECT c_custkey, c_name, c_nationkey::BIGINT AS c_nationkey FROM customer")
def csv_typed(spark, d):
    folder = writers.shared_folder(spark, "csv")
    table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment").write.option("header", True).csv(folder)
    return readers.typed_csv(spark, folder, {"c_custkey": "bigint", "c_name": "string", "c_nationkey": "bigint"})


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 > 0 THEN c_custkey * 2 END AS twice FROM customer")
def csv_tabs_and_nulls(spark, d):
    """Numbers that don't cast are null; another separator."""
    folder = writers.shared_folder(spark, "csv")
    c = table(spark, d, "customer")
    twice = F.when(F.col("c_custkey") % 3 > 0, (F.col("c_custkey") * 2).cast("string")).otherwise("none")
    c.select("c_custkey", twice.alias("twice")).write.option("header", True).option("sep", "\t").csv(folder)
    return readers.typed_csv(spark, folder, {"c_custkey": "bigint", "twice": "bigint"}, sep="\t")


@query("SELECT o_orderkey, o_custkey, o_orderkey % 5 AS county FROM orders")
def folders_by_county(spark, d):
    folder = writers.shared_folder(spark, "county")
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", (F.col("o_orderkey") % 5).alias("county"))
    writers.by_county(o, folder)
    return spark.read.parquet(folder).select("o_orderkey", "o_custkey", F.col("county").cast("long").alias("county"))


@query("SELECT r_name AS region, n_name AS line, row_number() OVER (PARTITION BY r_name ORDER BY n_name) AS place FROM nation JOIN region ON n_regionkey = r_regionkey")
def text_in_order(spark, d):
    """Ordered lines in a folder of text for each region, numbered as they are read."""
    from microveil.operators import lp

    folder = writers.shared_folder(spark, "text")
    x = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    writers.text_lines(x.select(F.col("r_name").alias("region"), F.col("n_name").alias("line")), folder, ["region"], ["line"])
    back = lp.ordered_text(spark, folder, by_folder=True).withColumn("region", F.replace(F.regexp_extract("file", "region=(.*)$", 1), F.lit("%20"), F.lit(" ")))
    return tabulate.ranked(back, ["region"], ["block", "at"], "place").select("region", "line", F.col("place").cast("long").alias("place"))


@query("SELECT s_suppkey, s_name FROM supplier")
def xml_both_ways(spark, d):
    folder = writers.shared_folder(spark, "xml")
    table(spark, d, "supplier").select("s_suppkey", "s_name").write.format("xml").option("rowTag", "supplier").save(folder)
    back = spark.read.format("xml").option("rowTag", "supplier").schema("s_suppkey bigint, s_name string").load(folder)
    return back.select("s_suppkey", "s_name")


# projections


@query("SELECT 'C_' || lpad(o_orderkey::VARCHAR, 15, '0') || '_x_' || CASE WHEN o_orderkey % 100 < 22 THEN o_orderkey % 100 WHEN o_orderkey % 100 < 25 THEN 22 ELSE 25 END || '_0' AS line FROM orders WHERE o_orderkey % 100 < 30")
def start_age_names(spark, d):
    k = F.col("o_orderkey")
    names = table(spark, d, "orders").where(k % 100 < 30).select(F.concat(F.lit("C_"), F.lpad(k.cast("string"), 15, "0"), F.lit("_x_"), (k % 100).cast("string"), F.lit("_0")).alias("line"))
    return names.select(models.start_age_binned().alias("line"))


@query("SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN o_orderkey WHEN 1 THEN o_orderkey WHEN 2 THEN NULL WHEN 3 THEN NULL ELSE -o_orderkey END::BIGINT AS value FROM orders")
def cleaned_integers(spark, d):
    k = F.col("o_orderkey")
    text = k.cast("string")
    raw = F.when(k % 5 == 0, F.concat(F.lit(' "'), text, F.lit('" '))).when(k % 5 == 1, F.concat(F.lit("“"), text, F.lit("”"))).when(k % 5 == 2, F.lit(" null")).when(k % 5 == 3, F.concat(text, F.lit("x"))).otherwise(F.concat(F.lit("-"), text))
    return table(spark, d, "orders").select("o_orderkey", recode.cleaned_int(raw).alias("value"))


@query("SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 0 END::BIGINT AS sex FROM customer")
def sex_codes(spark, d):
    raw = F.element_at(F.array(F.lit(" m"), F.lit("F "), F.lit("X"), F.lit(None)), (F.col("c_custkey") % 4 + 1).cast("int"))
    return table(spark, d, "customer").select("c_custkey", recode.sex_code(raw).cast("long").alias("sex"))


@query("SELECT c_custkey, lpad((c_custkey % 7)::VARCHAR, 2, '0') AS state, lpad((c_custkey * 31)::VARCHAR, 15, '0') AS geoid FROM customer")
def padded_codes(spark, d):
    """Codes that were read as numbers get their zeros back."""
    k = F.col("c_custkey")
    return table(spark, d, "customer").select("c_custkey", writers.padded_number(k % 7, 2).alias("state"), writers.padded_number(k * 31, 15).alias("geoid"))


@query("SELECT r_name AS file, count(*)::BIGINT AS lines, sum(length(n_name) + 1)::BIGINT AS bytes FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def file_inventory(spark, d):
    """Sizes and numbers of lines of the text files of a folder."""
    folder = writers.shared_folder(spark, "inventory")
    x = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    writers.text_lines(x.select(F.col("r_name").alias("region"), F.col("n_name").alias("line")), folder, ["region"], ["line"])
    files = writers.inventory(spark, folder).where("file LIKE 'part-%.txt'")
    region = F.replace(F.regexp_extract("path", "region=([^/]*)/", 1), F.lit("%20"), F.lit(" "))
    return files.groupBy(region.alias("file")).agg(F.sum("lines").cast("long").alias("lines"), F.sum("bytes").cast("long").alias("bytes"))


@query("SELECT p_partkey::VARCHAR AS p_partkey, p_brand FROM part")
def sniffed_separator(spark, d):
    folder = writers.shared_folder(spark, "sniffed")
    table(spark, d, "part").select("p_partkey", "p_brand").write.option("header", True).option("sep", "|").csv(folder)
    return readers.sniffed(spark, folder)


@query("SELECT n_nationkey::BIGINT AS n_nationkey, n_nationkey % 3 <> 1 AND n_nationkey > 1 AS complete FROM nation")
def lp_text_complete(spark, d):
    """Texts of as many lines as their number says, every third of which has lost its end."""
    k = F.col("n_nationkey").cast("long")
    lines = table(spark, d, "nation").select(k.alias("n_nationkey"), F.explode(F.sequence(F.lit(0).cast("long"), k)).alias("at"))
    text = F.when((F.col("at") == F.col("n_nationkey")) & (F.col("n_nationkey") % 3 != 1), "End ").otherwise("C_1")
    return readers.lp_complete(lines.withColumn("line", text), ["n_nationkey"], "at", least=3)


FLAGS7 = ["white", "black", "asian", "hisp", "aian", "nhopi", "sor"]
FLAG_SQL = {"white": "white", "black": "black", "asian": "asian", "hisp": "hisp", "aian": "CAST(pid % 7 = 0 AS BIGINT)", "nhopi": "CAST(pid % 11 = 0 AS BIGINT)", "sor": "CAST(pid % 13 = 0 AS BIGINT)"}


def _pivot_sql() -> str:
    code = " || ".join(f"({FLAG_SQL[f]})::VARCHAR" for f in FLAGS7)
    cells = ", ".join(f"nullif(count(*) FILTER (code = '{i:07b}'), 0)::BIGINT AS freq{i:07b}" for i in range(128))
    return f", c AS (SELECT block, {code} AS code FROM pp) SELECT block, {cells} FROM c GROUP BY block"


@query(with_people(_pivot_sql()))
def freq_pivot_full(spark, d):
    """All 128 combinations of seven flags by block."""
    p = people(spark, d).withColumns({f: F.expr(FLAG_SQL[f]) for f in FLAGS7})
    return tabulate.frequency_pivot(p, "block", FLAGS7)
