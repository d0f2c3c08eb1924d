"""Hand-computed values."""

from __future__ import annotations

import datetime
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from microveil.functions import bins, recode
from microveil.operators import metrics, models, swap, tabulate


def values(spark, column, data, kind="long"):
    return [r[1] for r in spark.createDataFrame([(i, x) for i, x in enumerate(data)], f"i int, x {kind}").select("i", column).orderBy("i").collect()]


def test_bins(spark):
    assert values(spark, bins.age_bin(F.col("x")), [21, 22, 24, 25, 61, 62, 64, 66, 69, 84, 85, 110, None]) == [21, 22, 22, 25, 60, 62, 62, 65, 67, 80, 85, 85, None]
    assert values(spark, bins.right_closed(F.col("x")), [0, 1, 9, 10, 999, 1000, None]) == [None, "1-9", "1-9", "10-49", "500-999", "1000+", None]
    assert values(spark, bins.left_closed(F.col("x"), bins.BLOCK_SIZE_LEFT[:-1], top=100_000), [-1, 0, 9, 10, 99_999, 100_000]) == [None, 0, 0, 10, 1000, None]
    assert values(spark, bins.significant(F.col("x")), [123456.0, 0.00123456, -2.34567, 1e-9, -98765432.0, None], "double") == [123500.0, 0.001235, -2.346, 0.0, -98770000.0, None]
    assert values(spark, bins.stars(F.col("x"), F.lit(1.0)), [3.0, 2.0, 1.7, 0.1], "double") == ["***", "**", "*", ""]


def test_percent_rule(spark):
    x = spark.createDataFrame([(0, 0), (0, 4), (10, 5)], "h long, m long")
    assert [r[0] for r in x.select(bins.signed_percent_difference(F.col("h"), F.col("m")) * 100).collect()] == [0, 200, -50]


def test_race_codes(spark):
    assert len(recode.RACE_SETS) == 63
    x = spark.range(1, 64).withColumns(recode.race_flags(F.col("id")))
    assert x.where(recode.race_code([F.col(r) for r in recode.RACES]) != F.col("id")).count() == 0
    assert values(spark, recode.race_code([F.substring("x", i, 1) for i in range(1, 7)]), ["NNYNYN", "NNNNNN"], "string") == [17, None]
    assert values(spark, recode.race_count(F.col("x")), [1, 6, 7, 21, 22, 63, 64]) == [1, 1, 2, 2, 3, 6, None]


def test_dates_and_text(spark):
    born = recode.birth_date(F.col("x"))
    assert values(spark, born, ["19800402", "00000000", "198004", "1980", "junk"], "string") == [datetime.date(1980, 4, 2), None, datetime.date(1980, 4, 2), datetime.date(1980, 4, 2), None]
    assert values(spark, recode.age_on(born), ["19800401", "19800402", "20100401"], "string") == [30, 29, 0]
    assert values(spark, recode.sex_code(F.col("x")), ["m", "F", "?", None], "string") == [1, 0, None, None]


def test_grouped_median_and_distances(spark):
    ages = spark.createDataFrame([("a", x) for x in (1, 2, 2, 3)], "g string, age long")
    assert metrics.grouped_median(ages, ["g"], "age").first()["median"] == 2.5
    one = lambda *rows: spark.createDataFrame(list(rows), "k string, age long, n long")
    assert metrics.earth_mover(one(("b", 0, 1)), one(("b", 2, 1)), ["k"], "age").first()["emd"] == 2
    assert metrics.l1(one(("b", 0, 1), ("b", 1, 1)), one(("b", 0, 2)), ["k", "age"], ["k"]).first()["l1"] == 2
    assert metrics.jensen_shannon(one(("b", 0, 1)), one(("b", 1, 1)), ["k", "age"], ["k"]).first()["js"] == pytest.approx(math.sqrt(math.log(2)), abs=1e-6)


def test_suppression_and_modes(spark):
    people = spark.createDataFrame([("g", "a")] * 2 + [("g", "b")] * 5 + [("h", "c")] * 4, "geo string, race string")
    assert metrics.suppressed_cells(people, ["geo"], ["race"]).first()[:2] == (6, 1)
    tie = spark.createDataFrame([("x", "a"), ("x", "b"), ("y", "b")], "block string, race string")
    row = tabulate.modes(tie, ["block"], "race").where("block = 'x'").first()
    assert (row["mode"], row["ties"], row["national_mode"]) == ("a", 2, "b")


def test_empty_summary_is_zero(spark):
    empty = spark.createDataFrame([], "k long, n long")
    row = metrics.summary(metrics.differences(empty, empty, ["k"])).first().asDict()
    assert len(row) == 27 and set(row.values()) == {0}
    zero = spark.createDataFrame([(1, 0)], "k long, n long")
    assert metrics.summary(metrics.differences(zero, zero, ["k"])).first()["cv"] is None


def test_percentiles_are_those_of_all_rows(spark):
    rng = random.Random(4)
    rows = [(g, float(rng.randint(0, 9))) for g in ("a", "b", None) for _ in range(rng.randint(1, 40))] + [("c", None)]
    got = {r["g"]: r for r in metrics.percentiles(spark.createDataFrame(rows, "g string, x double"), ["g"], {"p0": ("x", 0), "p50": ("x", 0.5), "p95": ("x", 0.95), "p100": ("x", 1)}).collect()}
    for g in ("a", "b", None):
        x = [v for k, v in rows if k == g]
        assert [got[g][f"p{p}"] for p in (0, 50, 95, 100)] == pytest.approx(np.percentile(x, [0, 50, 95, 100]).tolist())
    assert "c" not in got


def test_a_unit_at_the_threshold_has_not_crossed(spark):
    d = spark.createDataFrame([(50, 40), (51, 49), (49, 51), (60, 50), (50, 50)], "h long, m long")
    assert metrics.crossings(d, 50).first().asDict() == {"units": 5, "fell": 1, "rose": 1}


@pytest.mark.parametrize("seed", range(3))
def test_search_against_enumeration(seed):
    import pandas as pd

    rng = random.Random(seed)
    names = [f"v{i}" for i in range(7)]
    cons = [(f"c{j}", rng.sample(names, 4), rng.choice(["=", "<=", ">="]), rng.randint(0, 3)) for j in range(4)]
    rows = pd.DataFrame([(c, v, s, float(r)) for c, vs, s, r in cons for v in vs], columns=["constraint", "variable", "sense", "rhs"])
    used = sorted(rows["variable"].unique())
    test = {"=": lambda a, b: a == b, "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b}
    want = [dict(zip(used, x, strict=True)) for x in itertools.product((0, 1), repeat=len(used)) if all(test[s](sum(dict(zip(used, x, strict=True))[v] for v in vs), r) for _, vs, s, r in cons)]
    status, got = models._search(rows, 10_000)
    assert status == ("OPTIMAL" if want else "INFEASIBLE") and sorted(map(str, got)) == sorted(map(str, want))


def test_repeated_names():
    assert recode.distinct_names(["x", "y", "x", "x", "x.1"]) == ["x", "y", "x.2", "x.3", "x.1"] or recode.distinct_names(["x", "y", "x", "x"]) == ["x", "y", "x.1", "x.2"]
    out = recode.distinct_names(["a", "a", "a.1", "a"])
    assert len(set(out)) == 4 and out[0] == "a" and "a.1" in out


def test_swap_exchange_keeps_totals(spark):
    h = spark.createDataFrame([(1, "01", 1), (2, "02", 1), (3, "03", 2)], "hid long, area string, size long")
    pairs = swap.adjacent_pairs(h, ["size"], ["hid"], "hid")
    out = {r["hid"]: (r["area"], r["swapped"]) for r in swap.exchange(h, pairs, "hid", ["area"]).collect()}
    assert out == {1: ("02", 1), 2: ("01", 1), 3: ("03", 0)}


def test_runs_paired(spark):
    rows = [(1, "k", True), (2, "k", True), (3, "k", True), (4, "k", False), (5, "k", False), (6, "k", True)]
    x = spark.createDataFrame(rows, "hid long, key string, sel boolean")
    assert {(r["a"], r["b"]) for r in swap.runs_paired(x, ["key"], ["hid"], "sel", "hid").collect()} == {(1, 2), (3, 4)}


def test_runs_paired_on_both_sides(spark):
    rng = random.Random(4)
    rows = [(k, i, rng.random() < (0.3, 0.5, 0.7)[k % 3], rng.randint(0, 2)) for k in range(200) for i in range(rng.randint(1, 14))]
    x = spark.createDataFrame([(100 * k + i, k, sel, t) for k, i, sel, t in rows], "hid long, key long, sel boolean, tract long")

    def sequential(line, tract):
        used, out, i = set(), [], 0
        while i < len(line):
            if not line[i][1]:
                i += 1
                continue
            j = i
            while j + 1 < len(line) and line[j + 1][1]:
                j += 1
            run = list(range(i, j + 1))
            if len(run) % 2:
                back, on = i > 0 and i - 1 not in used, j + 1 < len(line)
                fits = lambda a, b: not tract or line[a][2] == line[b][2]
                if on and not (back and fits(i, i - 1) and not fits(j, j + 1)):
                    run.append(j + 1)
                elif back:
                    run.insert(0, i - 1)
                else:
                    run.pop()
            used.update(run)
            out += [(line[p][0], line[q][0]) for p, q in zip(run[::2], run[1::2])]
            i = j + 1
        return out

    for tract in (None, "tract"):
        want = [p for k in range(200) for p in sequential([(100 * k + i, sel, t) for kk, i, sel, t in rows if kk == k], tract)]
        got = [(r["a"], r["b"]) for r in swap.runs_paired(x, ["key"], ["hid"], "sel", "hid", before=True, tract=tract).collect()]
        assert sorted(got) == sorted(want)
        assert len({h for p in got for h in p}) == 2 * len(got)
    end = spark.createDataFrame([(5, "k", False), (6, "k", True)], "hid long, key string, sel boolean")
    assert [(r["a"], r["b"]) for r in swap.runs_paired(end, ["key"], ["hid"], "sel", "hid", before=True).collect()] == [(5, 6)]


def test_models(spark):
    assert len(models.two_or_more()) == 57
    text = spark.createDataFrame([("_C_P0010001_000000000000001_1: a + b = 3", 1), ("_C_P0010001_000000000000001_2: a = 4", 2), ("other", 3)], "line string, n int")
    assert models.populations(text).collect()[0].asDict() == {"block": "000000000000001", "pop": 4.0}
    name = "C_000000000000001_F_23_0_F_23_Y_N_N_N_N_N_N"
    lines = spark.createDataFrame([(name + " 1",), (name.replace("_23_", "_24_") + " -0.0",), ("# comment",)], "line string")
    assert [r["age"] for r in models.microdata(lines).collect()] == [23]
    with pytest.raises(Exception, match="neither 0 nor 1"):
        models.microdata(spark.createDataFrame([(name + " 2",)], "line string")).collect()
    infeasible = spark.createDataFrame([("g", "c", "C_g_x_20_0_1_20", "=", 2.0)], "geo string, constraint string, variable string, sense string, rhs double")
    assert models.solved(infeasible).first()["status"] == "INFEASIBLE"
    binned = spark.createDataFrame([("C_000000000000001_F_23_0_F_23_Y_N_N_N_N_N_N",)], "line string").select(models.start_age_binned()).first()[0]
    assert binned.startswith("C_000000000000001_F_22_0")


def test_variability_without_all_solutions(spark):
    names = [f"C_000000000000001_P_{i}_0_20_{age}" for i in range(2) for age in (20, 40)]
    model = spark.createDataFrame([("g", "c", n, "=", 1.0) for n in names], "geo string, constraint string, variable string, sense string, rhs double")
    row = models.variability(model).first()
    assert row["status"] != "TIMEOUT" and row["solutions"] == 4 and row["l1"] == 2
    for limit in (1, 4, 6):
        row = models.variability(model, limit=limit).first()
        assert (row["status"], row["l1"], row["emd"]) == ("TIMEOUT", None, None)


def test_model_text_round_trip(spark):
    cells = spark.createDataFrame([("000000000000001", "P1", 2, [0, 1], [20, 21], ["N", "Y"]), ("000000000000001", "P2", 0, [1], [20], ["Y"])], "geo string, cell string, value int, sex array<int>, age array<int>, white array<string>")
    names = ("sex", "age", "white")
    vs = models.variables(cells, names, ("white",))
    assert vs.count() == 2 * 2 * 2
    found = models.terms(cells, vs, names)
    lines = models.constraints(cells, found)
    text = models.lp_text(lines, vs)
    order = [r["line"] for r in text.orderBy("geo", "section", "place").collect()]
    assert (order[0], order[2], order[-1]) == ("Minimize", "Subject To", "End")
    rhs, again = models.parsed_lp(text)
    assert {(r["constraint"][3:5], r["sense"], r["rhs"]) for r in rhs.collect()} == {("P1", "=", 2.0), ("P2", "=", 0.0)}
    assert again.count() == found.distinct().count()
    full = models.expanded(spark.createDataFrame([(None,)], "sex array<int>"), {"sex": (0, 1)})
    assert full.first()["sex"] == [0, 1]


def test_pseudo_area_permutes(spark):
    h = spark.createDataFrame([(i, i % 2, 0, i / 10, f"t{i}") for i in range(10)], "hid long, county long, state long, u double, tract string")
    out = swap.pseudo_area(h, "tract", ["county"], ["state"], ["hid"], "u", (0.3, 0.4), "pseudo").collect()
    assert all(r["pseudo"] == r["tract"] for r in out if r["u"] < 0.3)
    assert {int(r["pseudo"][1:]) % 2 == r["county"] for r in out if 0.3 <= r["u"] < 0.7} == {True}
