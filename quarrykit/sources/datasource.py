"""Containers as a Spark data source: ``spark.read.format("containers")``.

Partitions are planned by bytes, so that a task has one large file or many small ones. Files outside
``paths`` are not opened, and of the others only the asked ``categories`` are walked. A file is read
by pages (see ``pages``), and one that cannot be opened or read is an error row.

With the option ``pushdown`` filters on path and category do the same. Spark 4.1 keeps one state of
pushed filters for all scans of a loaded table, so a table loaded that way must stand once in a plan;
that is why it has to be asked for.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from dataclasses import asdict, dataclass
from pathlib import PurePosixPath

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition

from quarrykit.sources import container
from quarrykit.sources.pages import FilePages

PARTITION_BYTES = 128 << 20
PARTITION_FILES = 4096
#: What a file weighs besides its bytes: opening it.
FILE_COST = 1 << 20


def place(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI as Hadoop writes it, ``file:/a b`` included."""
    if uri.startswith("/"):
        return pafs.LocalFileSystem(), uri
    if uri.startswith("file:/"):
        return pafs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def opens(uri: str) -> bool:
    """Whether this store opens without Spark."""
    try:
        fs, path = place(uri)
        return fs.get_file_info(path).type != pafs.FileType.NotFound
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return False


@dataclass
class Share(InputPartition):
    """Files of one task: (URI, size)."""

    files: list[tuple[str, int]]


class ContainerReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.folders, self.files = json.loads(options.get("folders", "[]")), json.loads(options.get("files", "[]"))
        if "path" in options:
            self.files, self.folders = ([*self.files, options["path"]], self.folders) if self._is_file(options["path"]) else (self.files, [*self.folders, options["path"]])
        self.suffix = options.get("suffix", ".blend")
        self.limits = container.Limits(**json.loads(options.get("limits", "{}")))
        self.bytes = int(options.get("partitionbytes", PARTITION_BYTES))
        asked = lambda name: frozenset(json.loads(options[name])) if name in options else None
        self.paths: frozenset[str] | None = asked("paths")
        self.categories: frozenset[str] | None = asked("categories")

    @staticmethod
    def _is_file(uri: str) -> bool:
        fs, path = place(uri)
        return fs.get_file_info(path).type == pafs.FileType.File

    def listed(self) -> Iterator[tuple[str, int, int]]:
        """(URI, size, time of the last change in nanoseconds) of the files."""
        for uri in self.files:
            fs, path = place(uri)
            info = fs.get_file_info(path)
            yield uri, info.size or 0, info.mtime_ns or 0
        for uri in self.folders:
            fs, path = place(uri)
            for info in fs.get_file_info(pafs.FileSelector(path, recursive=True)):
                below = info.path[len(path.rstrip("/")) + 1 :]
                hidden = any(p.startswith(("_", ".")) for p in PurePosixPath(below).parts)
                if info.type == pafs.FileType.File and below.endswith(self.suffix) and not hidden:
                    yield f"{uri.rstrip('/')}/{below}", info.size or 0, info.mtime_ns or 0

    def partitions(self) -> list[Share]:
        return self.shared([(uri, size) for uri, size, _ in self.listed()])

    def shared(self, files: list[tuple[str, int]]) -> list[Share]:
        """Files in shares of about as many bytes; the largest first, each by itself where it fills a share."""
        shares: list[Share] = []
        held, weight = [], 0
        for uri, size in sorted(files, key=lambda f: (-f[1], f[0])):
            if self.paths is not None and uri not in self.paths:
                continue
            cost = FILE_COST + (size if size <= self.limits.file_bytes else 0)  # one that is too large is not read
            if held and (weight + cost > self.bytes or len(held) >= PARTITION_FILES):
                shares.append(Share(held))
                held, weight = [], 0
            held.append((uri, size))
            weight += cost
        return [*shares, Share(held)] if held else shares or [Share([])]

    def read(self, partition: Share) -> Iterator[pa.RecordBatch]:
        for uri, size in partition.files:
            rows = self._rows(uri, size)
            if self.categories is not None:
                rows = [r for r in rows if r["category"] in self.categories]
            yield container.batch_of(uri, rows)

    def _rows(self, uri: str, size: int) -> list[dict]:
        if size > self.limits.file_bytes:
            return container.inspect(None, self.limits)
        try:
            fs, path = place(uri)
            with fs.open_input_file(path) as file:
                return container.inspect(FilePages(file), self.limits, self.categories)
        except OSError as e:
            return [{"category": "error", "name": "unreadable", "detail": type(e).__name__}]


class PushingReader(ContainerReader):
    """Takes filters from Spark."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes equality and membership of path and category; gives back the rest."""
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            name = getattr(f, "attribute", None)
            if values is None or name not in (("path",), ("category",)):
                yield f
            elif name == ("path",):
                self.paths = frozenset(values if self.paths is None else self.paths & values)
            else:
                self.categories = frozenset(values if self.categories is None else self.categories & values)


class ContainerStreamReader(DataSourceStreamReader):
    """Files as they arrive or change: an offset is a time, and a batch has the files last changed after one and up to the next.

    A file that changes comes again, which Spark's own file streams don't do. Files changed in the
    last ``settle`` seconds (a file may still be written) wait for the next batch; a file that is put in
    place later than that with an older time of change is not seen.
    """

    def __init__(self, options: dict[str, str]):
        self.of, self.settle = ContainerReader(options), float(options.get("settle", "2"))

    def initialOffset(self) -> dict:
        return {"ns": -1}

    def latestOffset(self) -> dict:
        upto = time.time_ns() - int(self.settle * 1e9)
        return {"ns": max((ns for _, _, ns in self.of.listed() if ns <= upto), default=-1)}

    def partitions(self, start: dict, end: dict) -> list[Share]:
        return self.of.shared([(uri, size) for uri, size, ns in self.of.listed() if start["ns"] < ns <= end["ns"]])

    def read(self, partition: Share) -> Iterator[pa.RecordBatch]:
        return self.of.read(partition)

    def commit(self, end: dict) -> None:
        pass


class ContainerSource(DataSource):
    """Options: ``path``, or JSON lists ``folders`` and ``files``; ``suffix`` of files in folders; JSON lists ``paths`` and ``categories``; ``limits`` as JSON; ``partitionBytes``; ``pushdown``."""

    @classmethod
    def name(cls) -> str:
        return "containers"

    def schema(self) -> str:
        return container.SCHEMA

    def reader(self, schema) -> ContainerReader:
        return (PushingReader if self.options.get("pushdown", "false").lower() == "true" else ContainerReader)(self.options)

    def streamReader(self, schema) -> ContainerStreamReader:
        return ContainerStreamReader(self.options)


def load(spark: SparkSession, folders: list[str], files: list[str], limits: container.Limits, suffix: str, categories: list[str] | None = None) -> DataFrame:
    """The source over folders and files."""
    spark.dataSource.register(ContainerSource)
    options = {"folders": json.dumps(folders), "files": json.dumps(files), "suffix": suffix, "limits": json.dumps(asdict(limits))}
    if categories is not None:
        options["categories"] = json.dumps(categories)
    return spark.read.format("containers").options(**options).load()
