"""Sources. Text is read by Spark; only container formats go through Python, file by file."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def typed_csv(spark: SparkSession, path: str, types: dict[str, str], sep: str = ",", comment: str | None = None) -> DataFrame:
    """Named columns of a CSV with header, read as text and cast; what does not cast is null. Only these columns are parsed."""
    raw = spark.read.option("header", True).option("sep", sep)
    raw = raw.option("comment", comment) if comment else raw
    return raw.csv(path).select(*[F.col(c).try_cast(t).alias(c) for c, t in types.items()])


def fixed_width(text: DataFrame, layout: Sequence[tuple[str, int, int, str]], line: str = "value") -> DataFrame:
    """Columns (name, start from 1, length, type) cut out of lines and trimmed; empty is null."""
    cell = lambda start, n: F.nullif(F.trim(F.substring(line, start, n)), F.lit(""))
    return text.select(*[cell(s, n).try_cast(t).alias(name) for name, s, n, t in layout])


#: Encodings in which a line ends with the byte of a line feed and nothing else has it.
BY_LINE = ("ISO-8859-1", "ISO-8859-15", "LATIN1", "LATIN-1", "US-ASCII", "ASCII", "WINDOWS-1252", "CP1252", "WINDOWS-1250", "IBM437", "CP437")


def encoded_lines(spark: SparkSession, path: str, encoding: str) -> DataFrame:
    """Lines (``value``) of text in an encoding, without empty ones.

    Files of single-byte encodings are split like any text. Others, such as UTF-16, come
    whole, as one row of bytes of 2 GB at most.
    """
    if encoding.upper() in BY_LINE:
        options = {"encoding": encoding, "sep": "\u0001", "quote": "", "escape": "\u0002", "maxCharsPerColumn": -1, "nullValue": "", "mode": "PERMISSIVE"}
        return spark.read.options(**options).schema("value string").csv(path).where("value IS NOT NULL AND value <> ''")
    return spark.read.format("binaryFile").load(path).select(F.explode(F.split(F.decode("content", encoding), r"\r?\n")).alias("value")).where("value <> ''")


def read_fixed_width(spark: SparkSession, path: str, layout: Sequence[tuple[str, int, int, str]], encoding: str = "UTF-8") -> DataFrame:
    """As above, from files; lines of other encodings than UTF-8 are decoded from bytes."""
    if encoding.upper() == "UTF-8":
        return fixed_width(spark.read.text(path), layout)
    return fixed_width(encoded_lines(spark, path, encoding), layout)


def segments_joined(first: DataFrame, rest: Sequence[DataFrame], keys: Sequence[str], missing: str | None = None) -> DataFrame:
    """Segments of a wide table aligned on the key by left joins; absent cells get ``missing``."""
    out = first
    for r in rest:
        out = out.join(r, list(keys), "left")
    return out.na.fill(missing) if missing is not None else out


def routed(geo: DataFrame, levels: Sequence[str] = ("040", "050", "140", "750", "101"), component: str = "00") -> DataFrame:
    """Rows of a geographic header at the wanted summary levels, whole areas only (component "00")."""
    return geo.where(F.col("SUMLEV").isin(*levels) & (F.col("GEOCOMP") == component))


def zip_members(spark: SparkSession, path: str, pattern: str = ".*") -> DataFrame:
    """(path, member, n, line) of the text members of zip files whose names match; one file is one task's unit.

    Tasks open the files themselves and read members as streams, so a file may have any size. Only
    where the file system is known to Spark's readers alone, files come as bytes, of 2 GB at most.
    """
    import re

    import pyarrow.fs

    want = re.compile(pattern)
    files = spark.read.format("binaryFile").load(path)
    first = files.select("path").first()
    try:
        pyarrow.fs.FileSystem.from_uri(first["path"]) if first else None
        by_path = True
    except (pa.ArrowInvalid, OSError, ValueError):
        by_path = False

    def opened(name: str, content):
        if not by_path:
            return io.BytesIO(content)
        system, place = pyarrow.fs.FileSystem.from_uri(name)
        return system.open_input_file(place)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for name, content in zip(p["path"], p["content"] if not by_path else [None] * len(p), strict=True):
                with opened(name, content) as raw_file, zipfile.ZipFile(raw_file) as z:
                    for m in z.namelist():
                        if want.fullmatch(m) and not m.endswith("/"):
                            with z.open(m) as f:
                                held = []
                                for n, raw in enumerate(f):
                                    held.append((name, m, n, raw.decode("utf-8", "replace").rstrip("\r\n")))
                                    if len(held) == 20_000:
                                        yield pd.DataFrame(held, columns=["path", "member", "n", "line"])
                                        held = []
                                if held:
                                    yield pd.DataFrame(held, columns=["path", "member", "n", "line"])

    columns = ["path"] if by_path else ["path", "content"]
    return files.select(*columns).mapInPandas(run, "path string, member string, n long, line string")


def _stat_file(spark: SparkSession, path: str, schema: str, reader: str) -> DataFrame:
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for content in p["content"]:
                if reader == "stata":
                    for chunk in pd.read_stata(io.BytesIO(content), chunksize=50_000):
                        yield chunk
                else:
                    with pd.read_sas(io.BytesIO(content), format="sas7bdat", chunksize=50_000, encoding="latin-1") as f:
                        yield from f

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, schema)


def stata(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return _stat_file(spark, path, schema, "stata")


def sas(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return _stat_file(spark, path, schema, "sas")


def sniffed(spark: SparkSession, path: str) -> DataFrame:
    """A delimited text file with header whose separator is the most frequent of tab, pipe, semicolon and comma in its first line."""
    head = spark.read.text(path).first()
    line = head[0] if head else ""
    return spark.read.option("header", True).option("sep", max("\t|;,", key=line.count)).csv(path)


def xml(spark: SparkSession, path: str, row_tag: str, schema: str | None = None) -> DataFrame:
    """Records of XML files, such as the file objects of a forensic listing."""
    r = spark.read.format("xml").option("rowTag", row_tag)
    return (r.schema(schema) if schema else r).load(path)


def jdbc(spark: SparkSession, url: str, table: str, driver: str, split: tuple[str, int, int, int] | None = None, properties: dict | None = None) -> DataFrame:
    """A table, or a query in parentheses with a name, of a database.

    ``split`` (numeric column, low, high, parts) reads it in that many ranges at once; filters and columns
    that the plan needs are pushed to the database.
    """
    given = {"driver": driver, **(properties or {})}
    if split is None:
        return spark.read.jdbc(url, table, properties=given)
    column, low, high, parts = split
    return spark.read.jdbc(url, table, column=column, lowerBound=low, upperBound=high, numPartitions=parts, properties=given)


def reconstructed_to_microdata(text: DataFrame, race_code, line: str = "value") -> DataFrame:
    """Lines "tract,block,sex,age,six Y/N race flags,Y/N hispanic" (ids of 11 and 15 digits) as columns of the microdata format.

    ``race_code`` gives the code of six flag columns. People are household members: RTYPE 1, GQTYPE 000.
    """
    part = F.split(F.substr(line, F.lit(29)), ",")
    flags = [F.trim(part[i]) for i in range(2, 8)]
    return text.where(F.col(line).rlike(r"^\d{11},\d{15},")).select(
        F.substring(line, 1, 2).alias("TABBLKST"), F.substring(line, 3, 3).alias("TABBLKCOU"), F.substring(line, 6, 6).alias("TABTRACTCE"), F.substring(line, 24, 1).alias("TABBLKGRPCE"), F.substring(line, 24, 4).alias("TABBLK"),
        F.when(part[0] == "male", "1").when(part[0] == "female", "2").alias("QSEX"), part[1].alias("QAGE"), F.lit("1").alias("RTYPE"), F.lit("000").alias("GQTYPE"), F.when(F.trim(part[8]) == "Y", "2").when(F.trim(part[8]) == "N", "1").alias("CENHISP"), F.lpad(race_code(flags).cast("string"), 2, "0").alias("CENRACE"),
    )


# Lines of the solver's log.
LOG_PATTERNS = {
    "version": r"Gurobi Optimizer version ([\d.]+)", "start": r"logging started (.*)$", "rows": r"Optimize a model with (\d+) rows", "columns": r"Optimize a model with \d+ rows, (\d+) columns",
    "nonzeros": r"Optimize a model with \d+ rows, \d+ columns and (\d+) nonzeros", "presolve_rows": r"Presolved: (\d+) rows", "presolve_columns": r"Presolved: \d+ rows, (\d+) columns", "presolve_nonzeros": r"Presolved: \d+ rows, \d+ columns, (\d+) nonzeros",
    "integer_vars": r"Variable types: \d+ continuous, (\d+) integer", "binary_vars": r"Variable types: \d+ continuous, \d+ integer \((\d+) binary\)", "simplex_iterations": r"Explored \d+ nodes \((\d+) simplex iterations\)", "seconds": r"simplex iterations\) in ([\d.]+) seconds", "nodes": r"Explored (\d+) nodes",
}


def solver_log(text: DataFrame, by: Sequence[str], order: str, line: str = "line", patterns: dict[str, str] = LOG_PATTERNS) -> DataFrame:
    """One record per log: each field from the last line that has it."""
    def last(p: str) -> Column:
        hit = F.regexp_extract(line, p, 1)
        return F.max_by(F.when(hit != "", hit), F.when(hit != "", F.col(order)))

    return text.groupBy(*by).agg(*[last(p).alias(k) for k, p in patterns.items()])


def lp_complete(text: DataFrame, by: Sequence[str], order: str, least: int = 1, line: str = "line") -> DataFrame:
    """Whether each LP text ends with End and has at least so many lines."""
    return text.where(F.trim(line) != "").groupBy(*by).agg(((F.max_by(F.trim(line), F.col(order)) == "End") & (F.count(F.lit(1)) >= least)).alias("complete"))
