"""Complete domains, averaged percentiles, ranks over ranges, ordered swaps, appends that are repeated, zip members."""

from __future__ import annotations

import math
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from microveil.operators import metrics, swap, tabulate
from microveil.sources import readers, writers, zip_source

SPOTS = [metrics.Geography("Place", 4), metrics.Geography("Area", 3, base=36, sizes=lambda h: F.when(h >= 2, "big").otherwise("small")), metrics.Geography("Block", 2, complete=False)]


def test_units_without_people_count(spark):
    walk = [("b1", "Place", "0001"), ("b1", "Area", "0A1"), ("b1", "Area", "0A2"), ("b2", "Area", "0A1"), ("b1", "Block", "01"), ("b2", "Block", "02"), ("b3", "Place", "0777"), ("b2", "Elsewhere", "x"), (None, "Place", "0001"), ("b1", "Place", None)]
    domain = [("Place", "0001"), ("Place", "0002"), ("Place", "0003"), ("Area", "0A1"), ("Area", "0A2"), ("Area", "ZZZ"), ("Block", "01"), ("Block", "02"), ("Block", "03")]
    people = [("b1", 0, "m"), ("b1", 1, "m"), ("b1", 0, "f"), ("b2", 1, "f"), ("b3", 0, "f"), (None, 0, "f"), ("b9", 1, "m")]
    got = metrics.complete_catalogue(
        spark.createDataFrame(people, "block string, side int, sex string"), "side", "block",
        spark.createDataFrame(walk, "block string, geography string, unit string"), spark.createDataFrame(domain, "geography string, unit string"),
        SPOTS, {"total": F.lit("all"), "sex": F.col("sex")}, {"total": ["all"], "sex": ["m", "f", "x"]},
    )
    rows = {(r["geography"], r["size_class"], r["characteristic"]): r for r in got.collect()}
    place = rows["Place", "all", "total all"]  # 0001: 2 and 1; two empty places; b3's place is not in the domain
    assert (place["n"], place["mae"], place["median_diff"], place["mean_h"]) == (3, round(1 / 3, 6), 0.0, round(2 / 3, 6))
    assert rows["Area", "all", "sex x"]["n"] == 3 and rows["Area", "all", "sex x"]["max_diff"] == 0
    assert rows["Area", "big", "total all"]["n"] == 2 and rows["Area", "small", "total all"]["n"] == 1
    assert rows["Block", "all", "total all"]["n"] == 2 and ("Block", "all", "sex x") not in rows and rows["Block", "all", "sex m"]["n"] == 1
    assert len(rows) == 4 + 3 * 4 + 3


def test_units_that_are_no_codes_are_an_error(spark):
    df = spark.createDataFrame([("b", "Place", "12")], "block string, geography string, unit string")
    with pytest.raises(Exception, match="not a code of Place"):
        metrics.memberships(df, SPOTS, "block").collect()
    with pytest.raises(ValueError, match="52 bits"):
        metrics.Geography("long", 16)


def test_averaged_percentiles(spark):
    x = spark.createDataFrame([(g, float(v)) for g, n in (("a", 10), ("b", 7), ("c", 1)) for v in range(n)], "g string, v double")
    got = {r["g"]: r for r in metrics.percentiles(x, ["g"], {"p0": ("v", 0), "p50": ("v", 0.5), "p90": ("v", 0.9), "p1": ("v", 1)}, "averaged").collect()}
    assert [tuple(got[g])[1:] for g in "abc"] == [(0, 4.5, 8.5, 9), (0, 3, 6, 6), (0, 0, 0, 0)]


def test_ranks_over_ranges(spark):
    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.8 else rng.choice(["a", None]), rng.randrange(5), i) for i in range(900)]
    df = spark.createDataFrame(rows, "g string, v int, i long").repartition(4)
    got = tabulate.ranked(df, ["g"], ["v", "i"], "r").collect()
    want = {}
    for g, v, i in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1], r[2])):
        want[i] = want.get(("n", g), 0) + 1
        want["n", g] = want[i]
    assert len(got) == 900 and all(want[r["i"]] == r["r"] for r in got)


def test_pairs_one_after_the_other(spark):
    rng = random.Random(4)
    homes = [(k, f"area{k % 7}", None if k % 9 == 0 else k) for k in range(60)]
    pairs = [(rng.randrange(62), rng.randrange(60)) for _ in range(150)] + [(k, k + 1) for k in range(59)] * 17  # chains of a thousand
    state = {k: (a, h) for k, a, h in homes}
    for a, b in pairs:
        if a in state and b in state:
            state[a], state[b] = state[b], state[a]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "e long, a long, b long").unionByName(spark.createDataFrame([(9999, None, 3)], "e long, a long, b long"))
    got = swap.exchange_in_order(spark.createDataFrame(homes, "k long, area string, h long"), df, "k", ["area", "h"], "e").collect()
    assert {r["k"]: (r["area"], r["h"]) for r in got} == state and len(got) == 60


def test_binomial_draws(spark):
    cases = [(n, p, u / 50) for n in (0, 1, 5, 40, 3000) for p in (0.0, 0.2, 0.5, 0.97, 1.0) for u in range(0, 50, 7)]
    got = spark.createDataFrame(cases, "n int, p double, u double").select("n", "p", "u", swap.binomial(F.col("n"), F.col("p"), F.col("u")).alias("k")).collect()
    for n, p, u, k in got:
        if p in (0.0, 1.0) or n == 0:
            assert k == n * int(p)
            continue
        logs = [math.lgamma(n + 1) - math.lgamma(x + 1) - math.lgamma(n - x + 1) + x * math.log(p) + (n - x) * math.log(1 - p) for x in range(n + 1)]
        total = 0.0
        for x, lp in enumerate(logs):
            total += math.exp(lp)
            if total >= u - 1e-12:
                break
        assert abs(k - x) <= (1 if abs(total - u) < 1e-6 else 0)


def test_appends_that_are_repeated(spark, tmp_path):
    path = str(tmp_path / "out")
    schema = "unit string, v long"
    df = lambda *rows: spark.createDataFrame(list(rows), schema)
    assert writers.committed(spark, path, schema).count() == 0
    units = df(("a", 0), ("b", 0), ("c", 0)).select("unit")
    assert writers.unfinished(units, path, ["unit"]).count() == 3
    for _ in range(2):
        writers.append_once(df(("a", 1), ("a", 2)), path, "one", ["unit"])
    writers.append_once(df(("b", 3), ("c", 4)), path, "two", ["unit"])
    writers.append_once(df(("b", 3)), path, "two", ["unit"])  # a repeated run replaces what it wrote
    assert sorted(tuple(r) for r in writers.committed(spark, path, schema).collect()) == [("a", 1, "one"), ("a", 2, "one"), ("b", 3, "two")]
    assert [r[0] for r in writers.unfinished(units, path, ["unit"]).collect()] == ["c"]
    assert sorted(tuple(r) for r in writers.manifest(spark, path, "unit string").collect()) == [("a", 2, "one"), ("b", 1, "two")]

    @F.udf("long")
    def fails(v):
        raise ValueError("lost")

    with pytest.raises(Exception, match="lost"):
        writers.append_once(df(("a", 1)).withColumn("v", fails("v")), path, "one", ["unit"])
    assert [r[0] for r in writers.committed(spark, path, schema).select("run").distinct().collect()] == ["two"]  # until it is run again
    writers.append_once(df().limit(0), path, "two", ["unit"])
    assert writers.committed(spark, path, schema).count() == 0
    with pytest.raises(ValueError, match="folder"):
        writers.append_once(units, path, "a/b", ["unit"])


def test_zip_members_are_tasks(spark, tmp_path):
    (tmp_path / "z" / "deep").mkdir(parents=True)
    for name, where in (("one", "z"), ("two", "z/deep")):
        with zipfile.ZipFile(tmp_path / where / f"{name}.zip", "w", zipfile.ZIP_DEFLATED) as z:
            for m in ("a.txt", "b.txt", "c.dat"):
                z.writestr(m, "".join(f"{name}{m}{i}\n" for i in range(50_000 if m == "b.txt" else 3)))
            z.writestr("empty.txt", "")
            z.writestr("folder/", "")
    path = str(tmp_path / "z")
    all_ = zip_source.lines(spark, path)
    assert all_.rdd.getNumPartitions() == 8 and all_.count() == 2 * 50_006
    assert zip_source.lines(spark, path, r".*\.dat").rdd.getNumPartitions() == 2
    one = zip_source.lines(spark, path).where((F.col("member") == "b.txt") & F.col("path").endswith("two.zip") & (F.col("n") >= 49_998))
    assert sorted(r["line"] for r in one.collect()) == ["twob.txt49998", "twob.txt49999"]
    assert one.rdd.getNumPartitions() == 1  # the filter leaves one task
    assert zip_source.lines(spark, path).where("member IN ('a.txt', 'c.dat')").count() == 12
    assert zip_source.lines(spark, path).where("member = 'none'").count() == 0
    with pytest.raises(Exception, match="nowhere"):
        zip_source.lines(spark, str(tmp_path / "nowhere")).count()


def test_lines_of_other_encodings(spark, tmp_path):
    text = "\n".join([f"  {i:04d}é\"ñ,{'x' * (i % 50)}" for i in range(3000)] + ["", "last"])
    for name, encoding in (("l1", "ISO-8859-1"), ("u16", "UTF-16LE")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "f.txt").write_bytes(text.encode(encoding))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        latin = readers.encoded_lines(spark, str(tmp_path / "l1"), "ISO-8859-1")
        assert latin.rdd.getNumPartitions() > 3  # splits of one file
        want = sorted(x for x in text.split("\n") if x)
        assert sorted(r[0] for r in latin.collect()) == want
        assert sorted(r[0] for r in readers.encoded_lines(spark, str(tmp_path / "u16"), "UTF-16LE").collect()) == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    got = readers.read_fixed_width(spark, str(tmp_path / "l1"), [("n", 3, 4, "int"), ("c", 7, 1, "string")], "ISO-8859-1").where("n = 17").collect()
    assert [tuple(r) for r in got] == [(17, "é")]
