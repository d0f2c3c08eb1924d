"""Containment joins, constraint text in parts and the LP grammar."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from microveil.operators import lp, models

TEXT = r"""\* a comment *\
\ another
skipped: a = 1
Maximize
 goal: 3 x1 - x2
  + 2.5
 y.3
Subject To
 c1: x1 + x2 +
 x4 - 2 x5 >= -3
 c2: 2 x1
 -

 .5e1 x2 \ in the middle
 = 4 \ trailing
c3: x1 + x9 <
 7
 c4: x1 - x9 >= -inf
Bounds
 0 <= x1 <= 4
 x2 <= 5.5
 -inf <= x4 <= 3
 x5 free
 7 >= x9
 y.3 = 2
Generals
 x1 x2
Binaries
x4
 x5 x9
End
junk: a + b = 1"""

WANT = {
    "constraints": {("c1", ">=", -3.0), ("c2", "=", 4.0), ("c3", "<=", 7.0), ("c4", ">=", float("-inf"))},
    "terms": {("c1", 1.0, "x1"), ("c1", 1.0, "x2"), ("c1", 1.0, "x4"), ("c1", -2.0, "x5"), ("c2", 2.0, "x1"), ("c2", -5.0, "x2"), ("c3", 1.0, "x1"), ("c3", 1.0, "x9"), ("c4", 1.0, "x1"), ("c4", -1.0, "x9")},
    "objectives": {("max", 3.0, "x1"), ("max", -1.0, "x2"), ("max", 2.5, "y.3")},
    "bounds": {("x1", 0.0, 4.0), ("x2", None, 5.5), ("x4", float("-inf"), 3.0), ("x5", float("-inf"), float("inf")), ("x9", None, 7.0), ("y.3", 2.0, 2.0)},
    "kinds": {("x1", "general"), ("x2", "general"), ("x4", "binary"), ("x5", "binary"), ("x9", "binary")},
}


@pytest.mark.parametrize("blocks", [1, 3, 40])
def test_grammar_over_blocks(spark, blocks):
    """Sections, statements and terms go on wherever a file is cut."""
    lines = TEXT.split("\n")
    rows = [(f, i * blocks // len(lines), i, x) for f in ("one", "two") for i, x in enumerate(lines)]
    out = lp.read_lp(spark.createDataFrame(rows, "file string, block long, at long, line string"))
    for name, want in WANT.items():
        got = [tuple(r) for r in out[name].collect()]
        assert {r[1:] for r in got if r[0] == "one"} == want, name
        assert len(got) == 2 * len(want)


def test_empty_text(spark):
    none = spark.createDataFrame([], "file string, block long, at long, line string")
    assert all(t.count() == 0 for t in lp.read_lp(none).values())


def random_model(rng):
    full = {"sex": (0, 1), "age": tuple(range(111)), "white": ("N", "Y"), "black": ("N", "Y")}
    some = lambda values: None if rng.random() < 0.3 else rng.sample(values, rng.randrange(1, len(values) + 1))
    cells = [(f"g{rng.randrange(3)}", f"c{i}", *[some(list(v)) for v in full.values()]) for i in range(40)]
    variables = [(f"g{rng.randrange(4)}", *[rng.choice(v) for v in full.values()], f"v{i}") for i in range(400)]
    return full, cells, variables


SET_SCHEMA = "geo string, cell string, sex array<int>, age array<int>, white array<string>, black array<string>"
VAR_SCHEMA = "geo string, sex int, age int, white string, black string, variable string"


def test_contained_terms_against_sets(spark):
    full, cells, variables = random_model(random.Random(1))
    c, v = spark.createDataFrame(cells, SET_SCHEMA), spark.createDataFrame(variables, VAR_SCHEMA)
    fits = lambda cell, var: all(s is None or x in s for s, x in zip(cell[2:], var[1:5], strict=True))
    want = {(x[0], x[1], y[5]) for x in cells for y in variables if x[0] == y[0] and fits(x, y)}
    got = [tuple(r) for r in lp.contained_terms(c, v, list(full), full).collect()]
    assert set(got) == want and len(got) == len(want)
    everywhere = {(x[0], x[1], y[5]) for x in cells for y in variables if fits(x, y)}
    assert {tuple(r) for r in models.terms(c, v, list(full), by_geo=False, full=full).collect()} == everywhere
    two = {(x[0], x[1], y[5]) for x in cells for y in variables if x[0] == y[0] and fits((*x[:4], None, None), y) and y[3] == y[4] == "Y"}
    assert {tuple(r) for r in models.two_plus_terms(c, v, list(full), ("white", "black"), full=full).collect()} == two


def test_cells_are_posted_under_their_rarest_attribute(spark):
    """A cell of the whole range meets variables under two values of its sex, not under thousands of tuples."""
    full = {k: models.FULL[k] for k in models.ATTRIBUTES}
    cell = spark.createDataFrame([("g", "P1")], "geo string, cell string").select("geo", "cell", *[F.lit(None).cast("array<int>" if a in ("sex", "age") else "array<string>").alias(a) for a in full])
    v = spark.createDataFrame([("g", 1, 30, *"YNNNNNN", "v")], "geo string, sex int, age int, " + ", ".join(f"{f} string" for f in models.FLAGS) + ", variable string")
    found = lp.contained_terms(cell, v, list(full), full)
    assert [tuple(r) for r in found.collect()] == [("g", "P1", "v")]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode") == 2  # a post for each value of one attribute of a cell, and a variable's posts


def test_long_sums_go_over_lines_and_files(spark, tmp_path):
    terms = spark.range(20_000).selectExpr("'g' AS geo", "'c' AS constraint", "concat('C_', lpad(id, 8, '0')) AS variable")
    terms = terms.unionByName(spark.createDataFrame([("g", "d", "C_1"), ("h", "c", "C_2")], terms.schema))
    cells = spark.createDataFrame([("g", "c", 7), ("g", "d", 0), ("h", "c", 1), ("h", "none", 3)], "geo string, cell string, value int")
    lines = lp.constraint_lines(cells, terms, 100)
    assert lines.agg(F.max(F.length("line"))).first()[0] < 2000
    lp.write_lp(lp.lp_lines(lines, terms), str(tmp_path / "lp"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        text = lp.ordered_text(spark, str(tmp_path / "lp"), by_folder=True)
        assert text.rdd.getNumPartitions() > 10
        out = lp.read_lp(text)
        got = {(r["constraint"], r["rhs"]): r["n"] for r in out["terms"].groupBy("file", "constraint").agg(F.count_distinct("variable").alias("n")).join(out["constraints"], ["file", "constraint"]).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == {("_C_c_g_1", 7.0): 20_000, ("_C_d_g_2", 0.0): 1, ("_C_c_h_1", 1.0): 1}
    assert out["kinds"].count() == 20_002
