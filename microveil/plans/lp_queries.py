"""Queries over large constraint models and their text, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from microveil.operators import lp, models
from microveil.plans.catalog import ATTRS, LP_VARS, _cells
from microveil.plans.registry import query, with_people
from microveil.plans.views import people, table
from microveil.sources import writers

# Cells of every county: name, sexes, ages from and to, values of white; none: the whole range.
CELL_KINDS = [("P1", None, None, None, None), ("P12M", 1, None, None, None), ("P8W", None, None, None, "Y"), ("P8N", 0, 18, 64, "N")]
CELL_KINDS += [(f"P12A{lo}", None, lo, lo + 4, None) for lo in range(0, 90, 5)]
CELL_KINDS += [(f"PCT12S{s}A{a}", s, a, a, None) for s in (0, 1) for a in (0, 20, 45, 90)]
PERSON = ("sex", "age", "white", "black", "asian", "hisp")
FULL = {a: models.FULL[a] for a in PERSON}


def _kinds_sql() -> str:
    value = lambda x: "NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x)
    return ", ".join(f"('{k}', {value(s)}, {value(lo)}, {value(hi)}, {value(w)})" for k, s, lo, hi, w in CELL_KINDS)


def _flagged(spark, d):
    yes = {f: F.when(F.col(f) == 1, "Y").otherwise("N") for f in PERSON[2:]}
    p = people(spark, d).withColumns(yes)
    return p.select(F.col("county").alias("geo"), F.col("sex").cast("int").alias("sex"), F.col("age").cast("int").alias("age"), *PERSON[2:], F.col("pid").cast("string").alias("variable"))


def _county_cells(spark, d):
    """Every kind of cell in every county of the table."""
    county = table(spark, d, "nation").selectExpr("lpad(cast(n_nationkey div 5 as string), 2, '0') || lpad(cast(n_nationkey as string), 3, '0') AS geo")
    kinds = F.explode(F.array(*[F.struct(*[F.lit(v).cast(t).alias(n) for v, t, n in zip(k, ("string", "int", "int", "int", "string"), ("cell", "s", "lo", "hi", "w"), strict=True)]) for k in CELL_KINDS])).alias("k")
    x = county.select("geo", kinds).select("geo", "k.*")
    ages = F.when(F.col("lo").isNotNull(), F.sequence("lo", "hi"))
    none = F.lit(None).cast("array<string>")
    return x.select("geo", "cell", F.when(F.col("s").isNotNull(), F.array("s")).alias("sex"), ages.alias("age"), F.when(F.col("w").isNotNull(), F.array("w")).alias("white"), none.alias("black"), none.alias("asian"), none.alias("hisp"))


@query(with_people(f""", k(cell, s, lo, hi, w) AS (VALUES {_kinds_sql()})
SELECT county AS geo, cell AS constraint, count(*)::BIGINT AS n, sum(pid)::BIGINT AS ids FROM pp
JOIN k ON (s IS NULL OR sex = s) AND (lo IS NULL OR age BETWEEN lo AND hi) AND (w IS NULL OR (w = 'Y') = (white = 1)) GROUP BY ALL"""))
def lp_contained_terms(spark, d):
    found = lp.contained_terms(_county_cells(spark, d), _flagged(spark, d), PERSON, FULL)
    return found.groupBy("geo", "constraint").agg(F.count("*").alias("n"), F.sum(F.col("variable").cast("long")).alias("ids"))


@query(with_people("""SELECT county AS geo, 'P8' || s AS constraint, count(*)::BIGINT AS n, sum(pid)::BIGINT AS ids
FROM pp, (VALUES (0), (1)) k(s) WHERE sex = s AND white + black + asian >= 1 AND white + hisp >= 2 GROUP BY ALL"""))
def lp_two_plus_contained(spark, d):
    """Cells of each sex of people with two or more of the flags white and hisp."""
    cells = _county_cells(spark, d).where("cell IN ('P12M', 'P1')")
    cells = cells.withColumns({"sex": F.when(F.col("cell") == "P12M", F.array(F.lit(1))).otherwise(F.array(F.lit(0))), "cell": F.when(F.col("cell") == "P12M", "P81").otherwise("P80")})
    found = models.two_plus_terms(cells, _flagged(spark, d), ("sex", "age", "white", "hisp"), ("white", "hisp"))
    return found.groupBy("geo", "constraint").agg(F.count("*").alias("n"), F.sum(F.col("variable").cast("long")).alias("ids"))


TERMS_SQL = f"WITH {LP_VARS} SELECT '_C_P12_' || nk || '_' || v.geo || '_1' AS constraint, variable, 1.0::DOUBLE AS coefficient, value::DOUBLE AS rhs FROM v JOIN cells USING (geo)"


def _model_lines(spark, d, terms):
    """The LP text of the nations' cells, sums broken after so many terms."""
    c = _cells(spark, d)
    v = models.variables(c, ATTRS, ("white", "black"))
    return lp.lp_lines(lp.constraint_lines(c, models.terms(c, v, ATTRS), terms), v)


def _with_sides(out):
    return out["terms"].join(out["constraints"].select("file", "constraint", "rhs"), ["file", "constraint"]).select("constraint", "variable", "coefficient", "rhs")


@query(TERMS_SQL)
def lp_wrapped_text(spark, d):
    """Sums broken after three terms, read back from blocks of seven lines."""
    order = Window.partitionBy("geo").orderBy("section", "place", "first")
    x = _model_lines(spark, d, 3).withColumn("at", F.row_number().over(order))
    return _with_sides(lp.read_lp(x.select(F.col("geo").alias("file"), F.floor(F.col("at") / 7).alias("block"), "at", "line")))


@query(TERMS_SQL)
def lp_file_round_trip(spark, d):
    """The same through files, a folder of parts for each geography."""
    folder = writers.shared_folder(spark, "lp")
    lp.write_lp(_model_lines(spark, d, 5), folder)
    return _with_sides(lp.read_lp(lp.ordered_text(spark, folder, by_folder=True)))


@query(f"WITH {LP_VARS} SELECT 'binary' AS kind, geo, variable, NULL::DOUBLE AS lower, NULL::DOUBLE AS upper FROM v JOIN cells USING (geo) UNION ALL SELECT DISTINCT 'bound', v.geo, '__dummy', 0.0::DOUBLE, 0.0::DOUBLE FROM v")
def lp_bounds_and_kinds(spark, d):
    order = Window.partitionBy("geo").orderBy("section", "place", "first")
    x = _model_lines(spark, d, 4).withColumn("at", F.row_number().over(order))
    out = lp.read_lp(x.select(F.col("geo").alias("file"), F.floor(F.col("at") / 5).alias("block"), "at", "line"))
    no = F.lit(None).cast("double")
    kinds = out["kinds"].select("kind", F.col("file").alias("geo"), "variable", no.alias("lower"), no.alias("upper"))
    return kinds.unionByName(out["bounds"].select(F.lit("bound").alias("kind"), F.col("file").alias("geo"), "variable", "lower", "upper"))
