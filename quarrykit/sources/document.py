"""One JSON document of all reports, as a Spark sink: ``df.write.format("inspection_document").save(path)``.

Rows are (kind, json): reports of files (kind ``file``) and of files in error (kind ``error``). Each
task writes its parts under names of its own; the commit joins those of the attempts that counted to
one document, in the order of the partitions, and renames it into place. A task that runs twice
leaves one copy, and a job that fails leaves no document. The joining copies parts by blocks.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from quarrykit import __version__
from quarrykit.sources.datasource import place

# The head of a document.
SCHEMA, LANG, TOOL = 1, "en", "quarrykit"
KINDS = {"file": "files", "error": "errors"}
BLOCK = 1 << 20


@dataclass
class Parts(WriterCommitMessage):
    """What an attempt wrote: (list of the document, path, number of rows)."""

    held: list[tuple[str, str, int]] = field(default_factory=list)


class DocumentWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite
        fs, at = place(path)
        if not overwrite and fs.get_file_info(at).type != pafs.FileType.NotFound:
            raise FileExistsError(path)
        self.folder = f"{at}.parts-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator) -> Parts:
        fs, _ = place(self.path)
        fs.create_dir(self.folder, recursive=True)
        out, counts, names = {}, {}, {}
        try:
            for row in iterator:
                name = KINDS[row["kind"]]
                if name not in out:
                    names[name], counts[name] = f"{self.folder}/{name}-{uuid.uuid4().hex}", 0
                    out[name] = fs.open_output_stream(names[name], compression=None)
                out[name].write((b",\n" if counts[name] else b"") + row["json"].encode())
                counts[name] += 1
        finally:
            for stream in out.values():
                stream.close()
        return Parts([(name, names[name], counts[name]) for name in out])

    def commit(self, messages: list[Parts | None]) -> None:
        fs, at = place(self.path)
        fs.create_dir(self.folder, recursive=True)
        draft = f"{self.folder}/document"
        parts = [p for m in messages if m is not None for p in m.held]
        with fs.open_output_stream(draft, compression=None) as out:
            head = {"tool": TOOL, "version": __version__, "schema": SCHEMA, "lang": LANG}
            out.write(json.dumps(head)[:-1].encode())
            for name in KINDS.values():
                out.write(f', "{name}": ['.encode())
                for k, (_, path, _) in enumerate(p for p in parts if p[0] == name):
                    out.write(b",\n" if k else b"\n")
                    with fs.open_input_stream(path, compression=None) as part:
                        while block := part.read(BLOCK):
                            out.write(block)
                out.write(b"]")
            out.write(b"}\n")
        fs.move(draft, at)
        fs.delete_dir(self.folder)

    def abort(self, messages: list[Parts | None]) -> None:
        fs, _ = place(self.path)
        if fs.get_file_info(self.folder).type != pafs.FileType.NotFound:
            fs.delete_dir(self.folder)


class DocumentSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "inspection_document"

    def schema(self) -> str:
        return "kind string, json string"

    def writer(self, schema, overwrite: bool) -> DocumentWriter:
        return DocumentWriter(self.options["path"], overwrite)


def write_document(reports: DataFrame, errors: DataFrame, path: str, overwrite: bool = False) -> None:
    """``reports`` and ``errors`` (path, json) as one document, each list by path."""
    spark = reports.sparkSession
    spark.dataSource.register(DocumentSink)
    rows = reports.select("path", F.lit("file").alias("kind"), "json").unionByName(errors.select("path", F.lit("error").alias("kind"), "json"))
    rows.orderBy("path").select("kind", "json").write.format("inspection_document").mode("overwrite" if overwrite else "append").save(path)
