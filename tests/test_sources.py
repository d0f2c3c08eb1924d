"""Sources and sinks on small files."""

from __future__ import annotations

import zipfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from microveil.sources import readers, writers


def test_csv_and_fixed_width(spark, tmp_path):
    (tmp_path / "a.txt").write_text("#note\nA|B\n1|x\nbad|y\n")
    got = readers.typed_csv(spark, str(tmp_path / "a.txt"), {"A": "int"}, sep="|", comment="#").collect()
    assert [r[0] for r in got] == [1, None]
    (tmp_path / "b.txt").write_bytes("0001é 12\n0002x   \n".encode("latin-1"))
    got = readers.read_fixed_width(spark, str(tmp_path / "b.txt"), [("id", 1, 4, "int"), ("name", 5, 2, "string"), ("n", 7, 2, "int")], "ISO-8859-1").orderBy("id").collect()
    assert [tuple(r) for r in got] == [(1, "é", 12), (2, "x", None)]
    (tmp_path / "c.txt").write_text("a;b,c\n1;2,3\n")
    assert readers.sniffed(spark, str(tmp_path / "c.txt")).columns[0] in ("a", "a;b")


def test_containers(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("s1.csv", "1,2\n3,4\n")
        z.writestr("skip.bin", "x")
    got = readers.zip_members(spark, str(tmp_path / "z.zip"), r".*\.csv").orderBy("n").collect()
    assert [(r["member"], r["line"]) for r in got] == [("s1.csv", "1,2"), ("s1.csv", "3,4")]
    pd.DataFrame({"id": [1, 2], "name": ["a", "b"]}).to_stata(tmp_path / "d.dta", write_index=False)
    assert sorted(r["name"] for r in readers.stata(spark, str(tmp_path / "d.dta"), "id int, name string").collect()) == ["a", "b"]
    (tmp_path / "f.xml").write_text("<r><file><name>a</name><size>3</size></file><file><name>b</name><size>4</size></file></r>")
    assert readers.xml(spark, str(tmp_path / "f.xml"), "file", "name string, size long").agg(F.sum("size")).first()[0] == 7


def test_log_and_lp(spark):
    lines = ["Gurobi Optimizer version 8.1.1", "Optimize a model with 5 rows, 7 columns and 9 nonzeros", "Explored 0 nodes (3 simplex iterations) in 51.80 seconds", "Explored 2 nodes (4 simplex iterations) in 52.00 seconds"]
    log = spark.createDataFrame([("t", i, x) for i, x in enumerate(lines)], "t string, n int, line string")
    row = readers.solver_log(log, ["t"], "n").first()
    assert (row["version"], row["rows"], row["columns"], row["nonzeros"], row["nodes"], row["seconds"], row["presolve_rows"]) == ("8.1.1", "5", "7", "9", "2", "52.00", None)
    text = spark.createDataFrame([("a", 1, "Minimize"), ("a", 2, "End "), ("b", 1, "End"), ("b", 2, "x")], "t string, n int, line string")
    assert {r["t"]: r["complete"] for r in readers.lp_complete(text, ["t"], "n").collect()} == {"a": True, "b": False}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("c1", 2, "b"), ("c1", 1, "a"), ("c2", 1, "x")], "county string, n int, line string")
    writers.by_county(df, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).where("county = 'c1'").count() == 2
    writers.text_lines(df, str(tmp_path / "text"), ["county"], ["n"])
    assert next((tmp_path / "text/county=c1").glob("part-*")).read_text() == "a\nb\n"
    assert writers.table_text(df.select("county").limit(1), "pipe") == "county\nc1"
    assert "\\hline" in writers.table_text(df.limit(1)) and "<td>" in writers.table_text(df.limit(1), "html")
    with pytest.raises(ValueError):
        writers.table_text(df, limit=1)
    assert df.limit(1).select(writers.padded_number(F.lit(7), 3)).first()[0] == "007"
    old = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "p string, d string")
    new = spark.createDataFrame([("a", "1"), ("b", "9"), ("e", "3"), ("f", "4")], "p string, d string")
    assert {r["p"]: r["change"] for r in writers.snapshot_difference(old, new, "p", "d").collect()} == {"a": "same", "b": "changed", "c": "renamed from", "e": "renamed to", "f": "new"}


def test_inventory_knows_files_by_path(spark, tmp_path):
    for folder, lines in (("a", 1), ("b c+%", 3)):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "x.csv").write_text("line\n" * lines)
    got = sorted((r["path"].rsplit("/", 2)[1], r["file"], r["bytes"], r["lines"]) for r in writers.inventory(spark, str(tmp_path)).collect())
    assert got == [("a", "x.csv", 5, 1), ("b c+%", "x.csv", 15, 3)]


def test_fields_keep_their_width(spark):
    lines = spark.createDataFrame([(1, "AB,0012,7,x"), (2, "CD,0003,,y")], "n int, line string")
    new = spark.createDataFrame([(1, 2, 5), (1, 3, 123), (3, 1, 9)], "key int, place int, value int")
    got = {r["n"]: r["line"] for r in writers.field_overlay(lines, F.col("n"), new, "value").collect()}
    assert got == {1: "AB,0005,123,x", 2: "CD,0003,,y"}
    assert lines.limit(1).select(writers.placed(F.lit("abc000xyz"), 4, 3, F.lit(42))).first()[0] == "abc042xyz"
    assert lines.limit(1).select(writers.placed(F.lit("abc"), 2, 1, F.lit(None))).first()[0] == "abc"
    with pytest.raises(Exception, match="wider"):
        lines.select(writers.placed(F.lit("abc"), 2, 1, F.lit(10))).collect()


def test_database_both_ways(spark):
    url, driver = "jdbc:derby:memory:people;create=true", "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    df = spark.range(100).select(F.col("id"), (F.col("id") % 7).alias("n"), F.concat(F.lit("p"), F.col("id").cast("string")).alias("name")).toDF("ID", "N", "NAME")
    writers.jdbc(df, url, "people", driver)
    assert readers.jdbc(spark, url, "people", driver, split=("ID", 0, 100, 4)).where("n = 3").count() == 14
    assert readers.jdbc(spark, url, "(SELECT n, count(*) AS c FROM people GROUP BY n) q", driver).agg(F.sum("c")).first()[0] == 100


def test_xml_both_ways(spark, tmp_path):
    df = spark.createDataFrame([("a", 3, ["x", "y"]), ("b", 4, [])], "name string, size long, tag array<string>")
    writers.xml(df, str(tmp_path / "out.xml"), "file")
    got = readers.xml(spark, str(tmp_path / "out.xml"), "file", "name string, size long, tag array<string>").orderBy("name").collect()
    assert [(r["name"], r["size"], r["tag"] or []) for r in got] == [("a", 3, ["x", "y"]), ("b", 4, [])]


def test_folder_of_parts_has_one_header(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"part{i}.csv").write_text(f"a,b\n{i},x\n")
    assert sorted(r["a"] for r in readers.typed_csv(spark, str(tmp_path), {"a": "int"}).collect()) == [0, 1, 2]


def test_zip_files_are_streamed(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "big one.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("m.txt", "line\n" * 50_000)
    got = readers.zip_members(spark, str(tmp_path), r"m\.txt")
    assert got.count() == 50_000 and got.agg(F.max("n")).first()[0] == 49_999
    assert readers.zip_members(spark, str(tmp_path), "nothing").count() == 0


def test_zip_files_both_ways(spark, tmp_path):
    df = spark.createDataFrame([(s, i, f"{s}{i}é") for s in ("al", "de") for i in range(2500)], "state string, n int, line string")
    assert writers.zipped(df, str(tmp_path / "out"), "state", ["n"]) == {"al.zip": 2500, "de.zip": 2500}
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["al.zip", "de.zip"]
    got = readers.zip_members(spark, str(tmp_path / "out")).where("path LIKE '%de.zip'").orderBy("n").collect()
    assert [r["line"] for r in got] == [f"de{i}é" for i in range(2500)]


def test_workbook(spark, tmp_path):
    import xml.etree.ElementTree as ET

    df = spark.createDataFrame([("a & <b>", 1, 2.5), (None, None, None)], "name string, n long, x double")
    writers.workbook({"One": df, "T & wo": df.select("n")}, str(tmp_path / "b.xlsx"))
    with zipfile.ZipFile(tmp_path / "b.xlsx") as z:
        assert z.testzip() is None
        sheet = ET.fromstring(z.read("xl/worksheets/sheet1.xml"))
        names = [s.get("name") for s in ET.fromstring(z.read("xl/workbook.xml")).iter() if s.tag.endswith("sheet")]
    cells = [[("".join(c.itertext())) for c in row] for row in sheet[0]]
    assert cells == [["name", "n", "x"], ["a & <b>", "1", "2.5"], ["", "", ""]] and names == ["One", "T & wo"]
    with pytest.raises(ValueError):
        writers.workbook({"x": df}, str(tmp_path / "c.xlsx"), limit=1)
