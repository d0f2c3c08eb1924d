"""Sinks and small text reports."""

from __future__ import annotations

import math
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator, Sequence
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share; only a local session may do without that setting."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="shared")
    return f"{base}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """Materialised in the shared folder, for what is read more than once and costs more to make than to store."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession, "kept"))
    return df.checkpoint(eager=True)


def by_county(df: DataFrame, path: str, columns: Sequence[str] = ("county",), fmt: str = "parquet", mode: str = "overwrite") -> None:
    """One folder per county (and summary level); rows are dealt by the folder and a salt, so a large county is several files."""
    salt = F.pmod(F.xxhash64(*[c for c in df.columns]), F.lit(8))
    df.repartition(*[F.col(c) for c in columns], salt).write.mode(mode).partitionBy(*columns).format(fmt).option("header", True).save(path)


def appended(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    df.write.mode("append").format(fmt).save(path)


def _gone(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def append_once(df: DataFrame, path: str, run: str, units: Sequence[str], fmt: str = "parquet") -> None:
    """Appends the rows of a run such that running it again, after a failure or not, leaves them there once.

    Rows go to ``path``/data in a folder of their own, named by ``run``, which a repeated run replaces. When they are whole, the
    run's distinct ``units`` with their numbers of rows go to ``path``/manifest; until then ``committed`` does not see the run. Tasks that are tried
    again are dealt with by Spark's commit. Two runs of one name at the same time are the caller's to prevent.
    """
    if not re.fullmatch(r"[\w.-]+", run):
        raise ValueError(f"a run's name is a folder's: {run}")
    spark = df.sparkSession
    for part in ("manifest", "data"):  # what is left of an earlier try stops counting first
        _gone(spark, f"{path}/{part}/run={run}")
    df.write.mode("overwrite").format(fmt).save(f"{path}/data/run={run}")
    back = spark.read.format(fmt).schema(df.schema).load(f"{path}/data/run={run}")
    done = back.groupBy(*units).agg(F.count(F.lit(1)).alias("rows"))
    done.write.mode("overwrite").format("parquet").save(f"{path}/manifest/run={run}")


def manifest(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(units, rows, run) of all finished runs; ``schema`` is that of the units. Empty where nothing has been appended."""
    full = f"{schema}, rows long, run string"
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest")
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], full)
    return spark.read.schema(full).parquet(f"{path}/manifest")


def committed(spark: SparkSession, path: str, schema: str, fmt: str = "parquet") -> DataFrame:
    """The rows of finished runs, with ``run``; ``schema`` is that of the rows."""
    runs = [r["run"] for r in _runs(spark, f"{path}/manifest")]
    if not runs:
        return spark.createDataFrame([], f"{schema}, run string")
    # names of runs, a few bytes each; folders of other runs are not read
    return spark.read.format(fmt).schema(f"{schema}, run string").load(f"{path}/data").where(F.col("run").isin(runs))


def _runs(spark: SparkSession, folder: str) -> list[dict]:
    """Names of the runs whose folder is whole."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(path):
        return []
    whole = lambda p: system.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))
    return [{"run": s.getPath().getName()[len("run=") :]} for s in system.listStatus(path) if s.getPath().getName().startswith("run=") and whole(s.getPath())]


def unfinished(units: DataFrame, path: str, keys: Sequence[str]) -> DataFrame:
    """The rows of ``units`` whose keys no finished run has done."""
    spark = units.sparkSession
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in units.select(*keys).schema)
    runs = [r["run"] for r in _runs(spark, f"{path}/manifest")]
    done = manifest(spark, path, schema).where(F.col("run").isin(runs)) if runs else spark.createDataFrame([], schema)
    return units.join(done.select(*keys).distinct(), list(keys), "left_anti")


def text_lines(lines: DataFrame, path: str, by: Sequence[str], order: Sequence[str], line: str = "line") -> None:
    """Ordered lines of texts, one folder for each; a text is sorted inside its own partition."""
    out = lines.repartition(*by).sortWithinPartitions(*by, *order).select(*by, line)
    out.write.mode("overwrite").partitionBy(*by).text(path)


def padded_number(x: Column, width: int, decimals: int = 0) -> Column:
    """Digits with zeros in front; decimals without trailing zeros."""
    body = F.format_string("%d", x.cast("long")) if not decimals else F.regexp_replace(F.format_number(x, decimals), r",|(?<=\.\d{1,9})0+$|\.0*$", "")
    return F.lpad(body, width, "0")


def published_field(name: str, value: Column) -> Column:
    """A field of a published wide table as its files write it: always one decimal in CHARITER, CIFSN and in tables PCT and HCT; elsewhere two decimals lose a last zero."""
    if name in ("CHARITER", "CIFSN") or name.startswith(("PCT", "HCT")):
        return F.format_string("%.1f", value.cast("double"))
    text = value.cast("string")
    return F.when(text.rlike(r"^.+\.\d0$") & (F.length(text) > 3), F.substr(text, F.lit(1), F.length(text) - 1)).otherwise(text)


def overlay(base: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Columns of ``base`` replaced where ``new`` has a value; rows and other columns stay."""
    values = [c for c in new.columns if c not in keys and c in base.columns]
    n = new.select(*keys, *[F.col(c).alias(f"_n_{c}") for c in values])
    return base.join(n, list(keys), "left").select(*[F.coalesce(F.col(f"_n_{c}"), F.col(c)).alias(c) if c in values else F.col(c) for c in base.columns])


def table_text(df: DataFrame, kind: str = "latex", limit: int = 10_000) -> str:
    """A small result as LaTeX, HTML or pipe text; more than ``limit`` rows are an error, as a report is read by people."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"a report of more than {limit} rows")
    cells = [[("" if v is None else str(v)) for v in r] for r in rows]
    if kind == "latex":
        clean = lambda s: s.replace("\\", r"\textbackslash{}").replace("&", r"\&").replace("%", r"\%").replace("_", r"\_")
        body = [" & ".join(map(clean, r)) + r" \\" for r in [df.columns, *cells]]
        return "\n".join([r"\begin{tabular}{" + "l" * len(df.columns) + "}", r"\hline", body[0], r"\hline", *body[1:], r"\hline", r"\end{tabular}"])
    if kind == "html":
        import html

        line = lambda tag, r: "<tr>" + "".join(f"<{tag}>{html.escape(c)}</{tag}>" for c in r) + "</tr>"
        return "\n".join(["<table>", line("th", df.columns), *[line("td", r) for r in cells], "</table>"])
    return "\n".join("|".join(r) for r in [df.columns, *cells])


def inventory(spark, path: str) -> DataFrame:
    """Files below a folder with size and number of lines; a file is known by its whole path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.col("_metadata.file_path").alias("_p"), F.col("length").alias("bytes"))
    lines = spark.read.option("recursiveFileLookup", True).text(path).groupBy(F.col("_metadata.file_path").alias("_p")).agg(F.count(F.lit(1)).alias("lines"))
    named = files.join(lines, "_p", "left").select(F.url_decode(F.replace("_p", F.lit("+"), F.lit("%2B"))).alias("path"), "bytes", F.coalesce("lines", F.lit(0)).alias("lines"))
    return named.withColumn("file", F.regexp_extract("path", r"([^/]+)$", 1))


def placed(line: Column, start: int, length: int, value: Column, pad: str = "0") -> Column:
    """A fixed-width line with one field (start from 1) replaced, padded on the left to the same width; null values leave it, too long ones are an error."""
    text = value.cast("string")
    fits = F.when(F.length(text) <= length, F.lpad(text, length, pad)).otherwise(F.raise_error(F.lit(f"a value is wider than its {length} characters")))
    return F.when(text.isNull(), line).otherwise(F.concat(F.substring(line, 1, start - 1), fits, F.substr(line, F.lit(start + length))))


def field_overlay(lines: DataFrame, key: Column, new: DataFrame, field: str, sep: str = ",", line: str = "line") -> DataFrame:
    """Delimited lines with some fields replaced, each as wide as it was (zeros in front): ``new`` has key, place (from 1) and value.

    Other fields, and the lines' order columns, stay as they are.
    """
    values = new.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("place", F.col(field).cast("string")))).alias("_v"))
    parts = F.split(line, "\\" + sep if sep in "|.$" else sep)
    put = F.transform(parts, lambda x, i: F.coalesce(F.lpad(F.try_element_at("_v", i + 1), F.greatest(F.length(x), F.length(F.try_element_at("_v", i + 1))), F.lit("0")), x))
    joined = lines.withColumn("_key", key).join(values.withColumnRenamed("key", "_key"), "_key", "left")
    return joined.withColumn(line, F.when(F.col("_v").isNull(), F.col(line)).otherwise(F.array_join(put, sep))).select(*lines.columns)


def snapshot_difference(old: DataFrame, new: DataFrame, path: str, digest: str) -> DataFrame:
    """Files that are new, deleted, changed, renamed (same digest, other path) or same between two listings."""
    o, n = old.select(F.col(path).alias("p"), F.col(digest).alias("od")), new.select(F.col(path).alias("p"), F.col(digest).alias("nd"))
    both = o.join(n, "p", "full")
    gone, came = both.where("nd IS NULL").select(F.col("od").alias("d")).distinct(), both.where("od IS NULL").select(F.col("nd").alias("d")).distinct()
    moved = gone.join(came, "d").withColumn("_moved", F.lit(True))
    x = both.withColumn("d", F.coalesce("nd", "od")).join(moved, "d", "left")
    kind = F.when(F.col("od").isNull(), F.when(F.col("_moved"), "renamed to").otherwise("new")).when(F.col("nd").isNull(), F.when(F.col("_moved"), "renamed from").otherwise("deleted")).when(F.col("od") == F.col("nd"), "same").otherwise("changed")
    return x.select(F.col("p").alias(path), kind.alias("change"))


def xml(df: DataFrame, path: str, row_tag: str, root_tag: str = "rows") -> None:
    """Rows as XML records, such as the file objects of a forensic listing; nested columns become nested elements."""
    df.write.mode("overwrite").format("xml").option("rowTag", row_tag).option("rootTag", root_tag).save(path)


def jdbc(df: DataFrame, url: str, table: str, driver: str, mode: str = "append", properties: dict | None = None) -> None:
    """Rows into a table of a database, in parallel by partition."""
    df.write.jdbc(url, table, mode, {"driver": driver, **(properties or {})})


def zipped(lines: DataFrame, folder: str, by: str, order: Sequence[str], member: str = "lines.txt", line: str = "line") -> dict[str, int]:
    """One zip file for each value of ``by`` below a shared folder, with its lines in order in one member; lines by file name.

    Lines of a file are streamed by one task, which renames the file when it is whole, so a task that is tried again leaves no half file.
    """
    import pyarrow.fs

    system, place = pyarrow.fs.FileSystem.from_uri(folder if "://" in folder else Path(folder).resolve().as_uri())
    system.create_dir(place, recursive=True)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name = archive = out = raw = None
        n = 0

        def closed() -> pd.DataFrame:
            out.close()
            archive.close()
            raw.close()
            system.move(f"{place}/{name}.zip.{token}", f"{place}/{name}.zip")
            return pd.DataFrame({"file": [f"{name}.zip"], "lines": [n]})

        token = uuid.uuid4().hex
        for p in parts:
            for key, group in p.groupby("_by", sort=False):
                if key != name:
                    if name is not None:
                        yield closed()
                    name, n = key, 0
                    raw = system.open_output_stream(f"{place}/{name}.zip.{token}")
                    archive = zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED)
                    out = archive.open(member, "w", force_zip64=True)
                for text in group["_line"]:
                    out.write(f"{text}\n".encode())
                n += len(group)
        if name is not None:
            yield closed()

    dealt = lines.repartition(by).sortWithinPartitions(by, *order).select(F.col(by).cast("string").alias("_by"), F.col(line).alias("_line"))
    return {r["file"]: r["lines"] for r in dealt.mapInPandas(run, "file string, lines long").collect()}


def workbook(sheets: dict[str, DataFrame], path: str, limit: int = 10_000) -> None:
    """Small results as the sheets of an Excel file on the driver; more than ``limit`` rows in one are an error. Numbers are numbers, all else is text."""
    from xml.sax.saxutils import escape, quoteattr

    def cell(v) -> str:
        if v is None:
            return "<c/>"
        if isinstance(v, (int, float)) and not isinstance(v, bool) and math.isfinite(v):
            return f"<c><v>{v!r}</v></c>"
        return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>'

    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    package = "http://schemas.openxmlformats.org/package/2006"
    names = list(sheets)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        parts = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{kind}.worksheet+xml"/>' for i in range(1, len(names) + 1))
        z.writestr("[Content_Types].xml", f'<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/>{parts}</Types>')
        z.writestr("_rels/.rels", f'<Relationships xmlns="{package}/relationships"><Relationship Id="r1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name={quoteattr(n)} sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(names, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{package}/relationships">' + "".join(f'<Relationship Id="r{i}" Type="{rel}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(names) + 1)) + "</Relationships>")
        for i, df in enumerate(sheets.values(), 1):
            rows = df.limit(limit + 1).collect()
            if len(rows) > limit:
                raise ValueError(f"a sheet of more than {limit} rows")
            body = "".join("<row>" + "".join(map(cell, r)) + "</row>" for r in [df.columns, *rows])
            z.writestr(f"xl/worksheets/sheet{i}.xml", f'<worksheet xmlns="{main}"><sheetData>{body}</sheetData></worksheet>')
