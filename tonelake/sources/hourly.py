"""An archive of hours as a data source: one partition an hour, hours outside a filter are never opened, and a stream.

    spark.dataSource.register(HourlyArchive)
    spark.read.format("hourly_archive").load("hdfs://store/archive").filter("hour >= '2024-01-01'")

Below the path lies for each hour a file `2024-01-01-5.json.gz` or a folder `hour=2024-01-01-5` of gzip files; other
names are ignored.  Rows are (hour, file, line, broken).  Files are opened through pyarrow's file systems (local, HDFS,
S3, GCS) and read in blocks, so a task holds a block and not an hour.

Option broken: 'fail' (default) stops at a file that can't be read to its end; 'skip' keeps the lines before the break
and adds one row without a line whose `broken` holds the reason, so what was skipped can be counted.

As a stream, the offset is the last hour read; an hour is taken once, when option `delay` (0) later hours are there
already, so files that come late by no more than that are not missed.  Empty files and blank lines give no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan,
    LessThanOrEqual,
)
from pyspark.sql.types import StructType

NAME = re.compile(r"(?:hour=)?(\d{4}-\d{2}-\d{2})-(\d{1,2})(?:\.json\.gz)?$")
BLOCK = 1 << 20
SCHEMA = "hour timestamp, file string, line string, broken string"


class Hour(InputPartition):
    def __init__(self, at: datetime, files: list[str]):
        self.at, self.files = at, files


def _opened(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def found(path: str, keep=lambda at: True) -> list[Hour]:
    """The hours below a path that are to be kept, in order, with their files."""
    from pyarrow import fs

    system, root = _opened(path)
    out = []
    for entry in system.get_file_info(fs.FileSelector(root, allow_not_found=True)):
        name = NAME.match(entry.base_name)
        if name and int(name[2]) < 24 and keep(at := datetime.fromisoformat(name[1]) + timedelta(hours=int(name[2]))):
            inside = [entry] if entry.is_file else [f for f in system.get_file_info(fs.FileSelector(entry.path)) if f.is_file and not f.base_name.startswith(("_", "."))]
            out.append(Hour(at, sorted(f.path for f in inside)))
    return sorted(out, key=lambda h: h.at)


def _lines(system, path: str) -> Iterator[str]:
    with system.open_input_stream(path, compression="gzip") as stream:
        rest = b""
        while block := stream.read(BLOCK):
            *whole, rest = (rest + block).split(b"\n")
            yield from (x.decode("utf-8", "replace") for x in whole if x.strip())
        if rest.strip():
            yield rest.decode("utf-8", "replace")


def _read(path: str, broken: str, hour: Hour | None) -> Iterator[tuple]:
    system, _ = _opened(path)
    for file in hour.files if hour else ():  # without any hour there is one task that gets none
        try:
            for line in _lines(system, file):
                yield hour.at, file, line, None
        except OSError as e:  # pyarrow's codecs raise it for data that is cut or damaged
            if broken == "fail":
                raise
            yield hour.at, file, None, str(e)


class _Hours(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.broken, self.filters = options["path"], options.get("broken", "fail"), []

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual, In)) and f.attribute == ("hour",):
                self.filters.append(f)
            elif not (isinstance(f, IsNotNull) and f.attribute == ("hour",)):  # an hour is never null
                yield f

    def _keep(self, at: datetime) -> bool:
        plain = lambda x: x.replace(tzinfo=None) if x.tzinfo else x
        checks = {EqualTo: lambda v: at == plain(v), GreaterThan: lambda v: at > plain(v), GreaterThanOrEqual: lambda v: at >= plain(v),
                  LessThan: lambda v: at < plain(v), LessThanOrEqual: lambda v: at <= plain(v), In: lambda v: at in [plain(x) for x in v if x is not None]}
        return all(checks[type(f)](f.value) for f in self.filters)

    def partitions(self) -> list[Hour]:
        return found(self.path, self._keep)

    def read(self, partition: Hour) -> Iterator[tuple]:
        return _read(self.path, self.broken, partition)


class _NewHours(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path, self.broken, self.delay = options["path"], options.get("broken", "fail"), int(options.get("delay", 0))

    def initialOffset(self) -> dict:
        return {"after": ""}

    def latestOffset(self) -> dict:
        there = [h.at.isoformat() for h in found(self.path)]
        return {"after": there[-1 - self.delay] if len(there) > self.delay else ""}

    def partitions(self, start: dict, end: dict) -> list[Hour]:
        return found(self.path, lambda at: start["after"] < at.isoformat() <= end["after"])

    def read(self, partition: Hour) -> Iterator[tuple]:
        return _read(self.path, self.broken, partition)

    def commit(self, end: dict) -> None:
        """Nothing is kept: hours stay where they are."""


class HourlyArchive(DataSource):
    @classmethod
    def name(cls) -> str:
        return "hourly_archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> _Hours:
        return _Hours(dict(self.options))

    def streamReader(self, schema: StructType) -> _NewHours:
        return _NewHours(dict(self.options))


def hours(spark: SparkSession, path: str, broken: str = "fail") -> DataFrame:
    """The archive below a path as a table (hour, file, line, broken), with filters on the hour pushed into the source."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(HourlyArchive)
    return spark.read.format("hourly_archive").option("broken", broken).load(path)


def new_hours(spark: SparkSession, path: str, delay: int = 0, broken: str = "fail") -> DataFrame:
    """The same as a stream of the hours that appear."""
    spark.dataSource.register(HourlyArchive)
    return spark.readStream.format("hourly_archive").option("broken", broken).option("delay", str(delay)).load(path)
