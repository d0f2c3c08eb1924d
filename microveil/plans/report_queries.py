"""Report tables over several releases and kinds of people, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from microveil.functions import bins
from microveil.operators import linkage, reports
from microveil.plans.catalog import BIN, FLAGGED, PLACES, REPORT_SLICES, SIZE_R, SPEC, _flagged, _paired, _shown
from microveil.plans.registry import query, with_people
from microveil.plans.source_queries import FLAG_SQL
from microveil.plans.views import agebin_sql, left_right, people


def _sized_sql(by: str, base: str, counts: list[str]) -> str:
    """Rows of t by ``by`` and population class."""
    sums = ", ".join(f"sum({c})::BIGINT AS {c}" for c in (base, *counts))
    shown = ", ".join(f"{_shown(f'sum({c})', f'sum({base})')} AS {c}_pct" for c in counts)
    sized = "(SELECT *, unnest(list_filter(['All', " + SIZE_R.format("size") + "], lambda x: x IS NOT NULL)) AS block_pop FROM t)"
    return f" SELECT {by}, block_pop, count(*)::BIGINT AS blocks, {sums}, {shown}, format('{{:,}}', round(sum({base}) / 1000.0)::BIGINT) AS thousands, {PLACES} FROM {sized} GROUP BY {by}, block_pop"


# Releases of the right file: as it is, with ages moved, with the sex of every fourth person changed.
RELEASES = {"rHDF": ("sex", "age"), "rMDF": ("sex", "(age + pid % 3) % 91"), "rSWAP": ("CASE WHEN pid % 4 = 0 THEN 1 - sex ELSE sex END", "age")}
L3 = "l3 AS (" + " UNION ALL ".join(f"SELECT pid, '{n}' || block AS block, sex, age, r FROM l" for n in RELEASES) + ")"
G3 = "g3 AS (" + " UNION ALL ".join(f"SELECT pid, '{n}' || block AS block, {s} AS sex, {a} AS age, r FROM g" for n, (s, a) in RELEASES.items()) + ")"
M1 = _paired("l3", "g3", "sex|age", "sex, age, r, pid", "sex DESC, age DESC, pid DESC")
M2 = _paired("(SELECT * FROM l3 WHERE (block, pid) NOT IN (SELECT block, left_id FROM m1)) l4", "(SELECT * FROM g3 WHERE (block, pid) NOT IN (SELECT block, right_id FROM m1)) g4", f"sex|{BIN}", "sex, age, r, pid", "sex DESC, age DESC, pid DESC")


def _releases(spark, d):
    """Both files with a copy for each release, told apart by the block's first letters."""
    a, b = left_right(spark, d)
    name = F.explode(F.array(*[F.lit(n) for n in RELEASES])).alias("release")
    sex, age = F.col("sex"), F.col("age")
    for n, (s, g) in RELEASES.items():
        sex = F.when(F.col("release") == n, F.expr(s)).otherwise(sex)
        age = F.when(F.col("release") == n, F.expr(g)).otherwise(age)
    block = F.concat("release", "block")
    x = a.select("pid", "block", "sex", "age", "r", name).withColumn("block", block).drop("release")
    y = b.select("pid", "block", "sex", "age", "r", name)
    return x, y.select("pid", block.alias("block"), sex.alias("sex"), age.alias("age"), "r")


@query(with_people(f", {L3}, {G3}, m1 AS {M1}, m2 AS {M2}, m AS (SELECT *, 1 AS flag FROM m1 UNION ALL SELECT *, 3 AS flag FROM m2), t AS (SELECT regexp_extract(b.block, '^[A-Za-z]+') AS release, b.block, n AS size, n AS pop, count(flag) FILTER (flag = 1) AS exact, count(flag) AS binage FROM (SELECT block, count(*) AS n FROM l3 GROUP BY 1) b LEFT JOIN m USING (block) GROUP BY ALL)" + _sized_sql("release", "pop", ["exact", "binage"])))
def report_agree_releases(spark, d):
    """Agreement by block population for each release, all linked at once."""
    stats = linkage.equal_stats(*_releases(spark, d), SPEC).where("n_left IS NOT NULL")
    exact, binned = F.coalesce("exact", F.lit(0)), F.coalesce("binage", F.lit(0))
    blocks = stats.select(F.regexp_extract("block", "^[A-Za-z]+", 0).alias("release"), F.col("n_left").alias("pop"), exact.alias("exact"), (exact + binned).alias("binage"))
    return reports.by_block_size(blocks, F.col("pop"), "pop", ["exact", "binage"], ["release"])


@query(FLAGGED + ", sl AS (" + " UNION ALL ".join(f"SELECT '{n}' AS slice, block, pf, cfl FROM y WHERE {c}" for n, c in REPORT_SLICES.items()) + "), sz AS (SELECT block, count(*) AS size FROM y GROUP BY 1), t AS (SELECT slice, block, size, count(*) AS pop, count(pf) AS put, count(cfl) AS conf FROM sl JOIN sz USING (block) GROUP BY ALL)" + _sized_sql("slice", "pop", ["put", "conf"]))
def report_reid_blockpop_types(spark, d):
    """Putative and confirmed matches by block population for each kind of people: modal, not modal, unique, without variability."""
    kinds = F.explode(F.array_compact(F.array(*[F.when(F.expr(c), F.lit(n)) for n, c in REPORT_SLICES.items()]))).alias("slice")
    x = _flagged(spark, d)
    sizes = x.groupBy("block").agg(F.count("*").alias("size"))
    blocks = x.select("block", "put", "conf", kinds).groupBy("block", "slice").agg(F.count("*").alias("pop"), F.count("put").alias("put"), F.count("conf").alias("conf"))
    return reports.by_block_size(blocks.join(sizes, "block"), F.col("size"), "pop", ["put", "conf"], ["slice"])


PANELS = {"a": "pid % 11 <> 0", "b": "true"}


def _panel_sql(panels: dict[str, str]) -> str:
    each = " UNION ALL ".join(f"SELECT '{n}' AS slice, pf, cfl FROM y WHERE {c}" for n, c in panels.items())
    return f", sl AS ({each}) SELECT slice, count(*)::BIGINT AS denom, count(pf)::BIGINT AS put, count(cfl)::BIGINT AS conf, {_shown('count(pf)', 'count(*)')} AS put_pct, {_shown('count(cfl)', 'count(*)')} AS conf_pct, {_shown('count(cfl)', 'count(pf)')} AS precision FROM sl GROUP BY 1"


@query(FLAGGED + _panel_sql(PANELS))
def report_reid_panels(spark, d):
    """Matches of the people of the commercial file (those with an id there) and of all."""
    x = _flagged(spark, d).withColumns({"put": F.col("put").isNotNull().cast("int"), "conf": F.col("conf").isNotNull().cast("int")})
    return reports.slice_rates(x, {n: F.expr(c) for n, c in PANELS.items()}, "put", "conf")


@query(FLAGGED + f", cm AS (SELECT DISTINCT l.pid FROM l JOIN q ON q.keep = 1 AND q.block = l.block AND q.pik = l.pik AND q.sex = l.sex AND {agebin_sql('q.age')} = {agebin_sql('l.age')})" + _panel_sql({"a": "pid % 11 <> 0", "b": "pid % 11 <> 0 AND pid IN (SELECT pid FROM cm)"}))
def report_reid_commercial(spark, d):
    """Panel a: people of the commercial file; panel b: those whose record there agrees with the truth on block, id, age group and sex."""
    _, b = left_right(spark, d)
    age = bins.age_bin(F.col("age"))
    truth = b.where("keep = 1").select("block", "pik", "sex", age.alias("_bin")).distinct()
    x = _flagged(spark, d).withColumn("_bin", age)
    agrees = x.join(truth, ["block", "pik", "sex", "_bin"], "left_semi").select("pid", F.lit(True).alias("agrees"))
    x = x.join(agrees, "pid", "left").withColumns({"put": F.col("put").isNotNull().cast("int"), "conf": F.col("conf").isNotNull().cast("int")})
    return reports.slice_rates(x, {"a": F.expr("pid % 11 <> 0"), "b": F.expr("pid % 11 <> 0 AND agrees")}, "put", "conf")


# Lower bounds of the age classes of tables by age groups and by single years.
P12_AGES = [0, 5, 10, 15, 18, 20, 21, 22, 25, 30, 35, 40, 45, 50, 55, 60, 62, 65, 67, 70, 75, 80, 85]
PCT12_AGES = [*range(100), 100, 105, 110]
ALONE_OF = "white + black + asian + aian + nhopi + sor"
# Everyone, the iterations A to I of a table, and people of a race alone or in combination, by seven flags.
ITERATIONS = {"": "true"}
ITERATIONS |= {letter: f"{ALONE_OF} = 1 AND {race} = 1" for letter, race in zip("ABCDEF", ("white", "black", "aian", "asian", "nhopi", "sor"), strict=True)}
ITERATIONS |= {"G": f"{ALONE_OF} > 1", "H": "hisp = 1", "I": f"{ALONE_OF} = 1 AND white = 1 AND hisp = 0"}
ITERATIONS |= {f" {race} in combination": f"{race} = 1" for race in ("white", "black", "aian", "asian", "nhopi", "sor")}


def _iterations_sql() -> str:
    flags = ", ".join(f"{x} AS {f}" for f, x in FLAG_SQL.items() if f in ("aian", "nhopi", "sor"))
    cases = {"P12": P12_AGES, "PCT12": PCT12_AGES}
    low = {t: "CASE " + " ".join(f"WHEN age >= {a} THEN {a}" for a in reversed(ages)) + " END" for t, ages in cases.items()}
    each = " UNION ALL ".join(f"SELECT county, '{t}{n}' AS \"table\", sex, {low[t]} AS age_from FROM y7 WHERE {c}" for t in cases for n, c in ITERATIONS.items())
    sets = "GROUPING SETS ((county, \"table\", sex, age_from), (county, \"table\", sex), (county, \"table\"))"
    return f", y7 AS (SELECT *, {flags} FROM pp), i7 AS ({each}) SELECT county, \"table\", sex, age_from::BIGINT AS age_from, count(*)::BIGINT AS n FROM i7 GROUP BY {sets}"


@query(with_people(_iterations_sql()))
def table_cells_iterations(spark, d):
    """Cells of the tables by sex and age, and by sex and single years, with all their iterations, in long form."""
    p = people(spark, d).withColumns({f: F.expr(FLAG_SQL[f]) for f in ("aian", "nhopi", "sor")})
    tables = [reports.table_cells(p, ["county"], ages, "sex", "age", {f"{t}{n}": F.expr(c) for n, c in ITERATIONS.items()}) for t, ages in (("P12", P12_AGES), ("PCT12", PCT12_AGES))]
    return tables[0].unionByName(tables[1]).select("county", F.col("group").alias("table"), "sex", F.col("age_from").cast("long").alias("age_from"), "n")
