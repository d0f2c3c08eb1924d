"""Zip members as a Spark data source: a member is a task, and filters on members and paths leave tasks out.

``spark.dataSource.register(ZipLines)``, then ``spark.read.format("zip_lines").option("pattern", ...).load(path)``, or
``lines(spark, path, pattern)``. Columns are path, member, n (line number from 0) and line. The driver
reads the central directories only, a few bytes a member; tasks seek to their member and stream it.
"""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringContains, StringEndsWith, StringStartsWith

SCHEMA = "path string, member string, n long, line string"


def _files(path: str) -> list[str]:
    """URIs of the zip files at a path: a file, or a folder and what is below it."""
    import pyarrow.fs

    system, place = _placed(path)
    info = system.get_file_info(place)
    if info.type == pyarrow.fs.FileType.NotFound:
        raise FileNotFoundError(path)
    root = path[: -len(place)] if "://" in path and path.endswith(place) else ""
    if info.type == pyarrow.fs.FileType.File:
        return [path]
    found = system.get_file_info(pyarrow.fs.FileSelector(place, recursive=True))
    return sorted(root + f.path for f in found if f.type == pyarrow.fs.FileType.File and f.extension == "zip")


def _placed(path: str):
    """The file system of a path or URI, and the path in it."""
    import pyarrow.fs

    if path.startswith("file:") or "://" not in path:
        return pyarrow.fs.LocalFileSystem(), re.sub(r"^file:(//)?", "", path)
    return pyarrow.fs.FileSystem.from_uri(path)


def _opened(path: str):
    system, place = _placed(path)
    return system.open_input_file(place)


@dataclass
class Member(InputPartition):
    path: str
    member: str


class ZipReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.pattern = options["path"], options.get("pattern", ".*")
        self.encoding, self.batch = options.get("encoding", "utf-8"), int(options.get("lines", 20_000))
        self.pushed: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes what is said of member and path alone; Spark looks at the rest."""
        for f in filters:
            known = isinstance(f, (EqualTo, In, StringStartsWith, StringEndsWith, StringContains))
            if known and f.attribute in (("member",), ("path",)):
                self.pushed.append(f)
            else:
                yield f

    @staticmethod
    def _holds(f: Filter, value: str) -> bool:
        if isinstance(f, EqualTo):
            return value == f.value
        if isinstance(f, In):
            return value in f.value
        if isinstance(f, StringStartsWith):
            return value.startswith(f.value)
        return value.endswith(f.value) if isinstance(f, StringEndsWith) else f.value in value

    def partitions(self) -> list[InputPartition]:
        want, out = re.compile(self.pattern), []
        for path in _files(self.path):
            if not all(self._holds(f, path) for f in self.pushed if f.attribute == ("path",)):
                continue
            with _opened(path) as raw, zipfile.ZipFile(raw) as z:
                names = [m for m in z.namelist() if want.fullmatch(m) and not m.endswith("/")]
            out += [Member(path, m) for m in names if all(self._holds(f, m) for f in self.pushed if f.attribute == ("member",))]
        return out or [Member("", "")]  # a reader has a partition at least

    def read(self, partition: Member) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        names, kinds = ["path", "member", "n", "line"], [pa.string(), pa.string(), pa.int64(), pa.string()]

        def batch(first: int, held: list[str]) -> pa.RecordBatch:
            columns = [[partition.path] * len(held), [partition.member] * len(held), range(first, first + len(held)), held]
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=names)

        with _opened(partition.path) as raw, zipfile.ZipFile(raw) as z, z.open(partition.member) as f:
            first, held = 0, []
            for line in f:
                held.append(line.decode(self.encoding, "replace").rstrip("\r\n"))
                if len(held) == self.batch:
                    yield batch(first, held)
                    first, held = first + len(held), []
            if held:
                yield batch(first, held)


class ZipLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return "zip_lines"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return ZipReader(self.options)


def lines(spark: SparkSession, path: str, pattern: str = ".*", encoding: str = "utf-8") -> DataFrame:
    """(path, member, n, line) of the members whose whole name matches ``pattern``, of a zip file or of all below a folder.

    Filters on ``member`` and ``path`` (equal, in a list, starts, ends, contains) are pushed down, where the session allows that for Python
    sources, which this turns on: members that they rule out are no tasks. Bytes that don't decode are replaced. Empty members and folders give no
    rows; a path that isn't there is an error. Paths are local ones or URIs of file systems that Arrow knows.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ZipLines)
    return spark.read.format("zip_lines").option("pattern", pattern).option("encoding", encoding).load(path)


def fixed_width_members(spark: SparkSession, path: str, pattern: str, layout, encoding: str = "latin-1") -> DataFrame:
    """Columns (name, start from 1, length, type) cut out of the lines of members, with path and member."""
    cell = lambda start, n: F.nullif(F.trim(F.substring("line", start, n)), F.lit(""))
    return lines(spark, path, pattern, encoding).select("path", "member", *[cell(s, n).try_cast(t).alias(name) for name, s, n, t in layout])
