"""Self-describing block containers (.blend files): a bounded, fault-tolerant reader.

A file is a header, length-prefixed blocks and an end mark; block ``DNA1`` says how the others
are laid out, and blocks refer to each other by old address. Each file is read in one task and
gives finding rows; a file that fails a check gives one error row and never fails the job.
Nothing inside is executed.
"""

from __future__ import annotations

import bisect
import codecs
import re
import struct
import time
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrykit.functions import tables as t
from quarrykit.functions.text import flag_names, version_display
from quarrykit.sources.pages import PAGE, Gunzip, Pages, TooLarge, Unpacked, Unzstd
from quarrykit.sources.pages import OutOfTime as Late

MAGIC = b"BLENDER"
# Block codes of linked files of other kinds.
FILE_CODES = {"IM": "image", "SO": "sound", "VF": "font", "CF": "cache_file", "MC": "movie_clip"}
CATEGORIES = ["text", "driver", "osl", "library", "filepath"]


@dataclass(frozen=True)
class Limits:
    """Caps of one inspection; each refuses a file or cuts a body, none is silent."""

    file_bytes: int = 2 << 30
    inflated_bytes: int = 4 << 30
    blocks: int = 4_000_000
    seconds: float = 60.0
    field_bytes: int = 64 << 20
    script_chars: int = 16 << 20
    path_bytes: int = 64 << 10


class Refused(ValueError):
    """A check failed; ``kind`` is not_a_blend or malformed."""

    def __init__(self, kind: str, message: str):
        super().__init__(message)
        self.kind = kind


def compression(content: bytes) -> str:
    if content[:2] == b"\x1f\x8b":
        return "gzip"
    if content[:4] == b"\x28\xb5\x2f\xfd":
        return "zstd"
    return "none" if content[:7] == MAGIC else "unknown"


def inflated(content, limits: Limits, late: float = float("inf")):
    """The container itself, sliced like bytes; a packed one is unpacked by pages under the size and time limits."""
    kind = compression(content[:7])
    if kind == "unknown":
        raise Refused("not_a_blend", "bad magic")
    if kind == "none":
        return content
    try:
        data = Unpacked(content, Gunzip if kind == "gzip" else Unzstd, limits.inflated_bytes, late)
    except TooLarge:
        raise Refused("malformed", "decompression bomb") from None
    except Late:
        raise
    except Exception as e:
        raise Refused("malformed", f"decompression failed: {e}") from e
    if data[:7] != MAGIC:
        raise Refused("not_a_blend", "bad magic inside the compressed stream")
    return data


@dataclass
class Header:
    pointer: int
    order: str
    version: str
    large: bool
    size: int


def header(data: bytes) -> Header:
    """Legacy (12 bytes) or format version 1 (17 bytes); every field is checked."""
    if len(data) < 12:
        raise Refused("not_a_blend", "short file")
    large = data[7:8].isdigit()
    if large:
        if data[7:9] != b"17":
            raise Refused("malformed", "bad header size")
        if len(data) < 17:
            raise Refused("not_a_blend", "short file")
        if data[9:10] != b"-":
            raise Refused("malformed", "bad pointer size")
        if data[10:12] != b"01":
            raise Refused("malformed", "bad format version")
        pointer, order, digits, size = 8, data[12:13], data[13:17], 17
        if order != b"v":
            raise Refused("malformed", "bad endian")
    else:
        if data[7:8] not in b"_-" or data[8:9] not in b"vV":
            raise Refused("malformed", "bad pointer size" if data[7:8] not in b"_-" else "bad endian")
        pointer, order, digits, size = (4 if data[7:8] == b"_" else 8), data[8:9], data[9:12], 12
    if not digits.isdigit():
        raise Refused("malformed", "bad version")
    return Header(pointer, "<" if order == b"v" else ">", str(int(digits)), large, size)


@dataclass(slots=True)
class Block:
    code: str
    sdna: int
    address: int
    count: int
    start: int
    size: int


class Blocks:
    """The block table in columns, forty bytes a block, looked up by code, by struct and by address."""

    def __init__(self) -> None:
        self.code, self.sdna, self.address, self.count, self.start, self.size = array("I"), array("i"), array("Q"), array("q"), array("q"), array("q")

    def add(self, code: bytes, sdna: int, address: int, count: int, start: int, size: int) -> None:
        self.code.append(int.from_bytes(code, "little"))
        self.sdna.append(sdna)
        self.address.append(address)
        self.count.append(count)
        self.start.append(start)
        self.size.append(size)

    def close(self) -> None:
        address = np.frombuffer(self.address, np.uint64) if self.address else np.zeros(0, np.uint64)
        self._order = np.argsort(address, kind="stable")
        self._sorted = array("Q", address[self._order].tobytes())

    def __len__(self) -> int:
        return len(self.code)

    def __getitem__(self, k: int) -> Block:
        return Block(self.code[k].to_bytes(4, "little").rstrip(b"\0").decode("latin-1"), self.sdna[k], self.address[k], self.count[k], self.start[k], self.size[k])

    def _those(self, column: array, kind: type, values: list[int]) -> Iterator[Block]:
        if len(self) and values:
            for k in np.flatnonzero(np.isin(np.frombuffer(column, kind), np.array(values, kind))).tolist():
                yield self[k]

    def coded(self, *codes: str) -> Iterator[Block]:
        return self._those(self.code, np.uint32, [int.from_bytes(c.encode().ljust(4, b"\0"), "little") for c in codes])

    def of_structs(self, numbers: list[int]) -> Iterator[Block]:
        return self._those(self.sdna, np.int32, numbers)

    def at(self, address: int) -> Block | None:
        """The last block with an address; none has address 0."""
        k = bisect.bisect_right(self._sorted, address) - 1
        return self[int(self._order[k])] if address and k >= 0 and self._sorted[k] == address else None


def blocks(data, head: Header, limits: Limits, late: float) -> Blocks:
    """The block table; payloads are skipped, declared lengths checked against the file."""
    shape = struct.Struct(head.order + ("4siQqq" if head.large else "4siQii" if head.pointer == 8 else "4siIii"))
    found, at = Blocks(), head.size
    while at < len(data):
        if len(data) - at < shape.size:
            if len(data) - at == 8 and data[at : at + 4] == b"ENDB":
                found.close()
                return found
            raise Refused("malformed", f"truncated at {at}")
        if not len(found) % 1024 and time.monotonic() > late:
            raise Late
        code, *rest = shape.unpack(data[at : at + shape.size])
        sdna, address, size, count = rest if head.large else (rest[2], rest[1], rest[0], rest[3])
        at += shape.size
        if size < 0 or size > len(data) - at:
            raise Refused("malformed", f"block length {size} {'is negative' if size < 0 else 'overruns the file'}")
        if code.startswith(b"ENDB"):
            found.close()
            return found
        found.add(code, sdna, address, count, at, size)
        if len(found) > limits.blocks:
            raise Refused("malformed", "too many blocks")
        at += size
    raise Refused("malformed", "no end mark")


class Container:
    """Blocks of one file with their fields."""

    def __init__(self, data: bytes | Pages, limits: Limits, late: float):
        self.data, self.limits, self.late = data, limits, late
        self.head = header(data[:17])
        self.blocks = blocks(data, self.head, limits, late)
        dna = next(self.blocks.coded("DNA1"), None)
        if dna is None:
            raise Refused("malformed", "no DNA1 block")
        if dna.size > limits.field_bytes:
            raise Refused("malformed", "bad DNA1: too large")
        try:
            self.layouts = self._layouts(data[dna.start : dna.start + dna.size])
        except (struct.error, IndexError, ValueError) as e:
            raise Refused("malformed", f"bad DNA1: {e}") from e
        self.by_name: dict[str, dict[str, tuple[int, int, str, str]]] = {}
        for name, fields in self.layouts:
            self.by_name.setdefault(name, fields)

    def _layouts(self, dna: bytes) -> list[tuple[str, dict[str, tuple[int, int, str, str]]]]:
        """By struct index: name, and offset, size, type and declared name of each field."""
        order, at = self.head.order, 4

        def section(mark: bytes) -> int:
            nonlocal at
            at += -at % 4
            if dna[at : at + 4] != mark:
                raise ValueError(f"{mark!r} expected")
            at += 4
            if mark == b"TLEN":
                return 0
            (n,) = struct.unpack_from(order + "I", dna, at)
            at += 4
            return n

        def strings(n: int) -> list[str]:
            nonlocal at
            out = []
            for _ in range(n):
                end = dna.index(b"\0", at)
                out.append(dna[at:end].decode("latin-1"))
                at = end + 1
            return out

        if dna[:4] != b"SDNA":
            raise ValueError("no SDNA")
        names = strings(section(b"NAME"))
        types = strings(section(b"TYPE"))
        section(b"TLEN")
        sizes = struct.unpack_from(f"{order}{len(types)}H", dna, at)
        at += 2 * len(types)
        out = []
        for _ in range(section(b"STRC")):
            kind, n = struct.unpack_from(order + "HH", dna, at)
            at += 4
            fields, offset = {}, 0
            for k in range(n):
                ftype, fname = struct.unpack_from(order + "HH", dna, at + 4 * k)
                name, size = names[fname], self.head.pointer if names[fname].startswith(("*", "(*")) else sizes[ftype]
                for d in re.findall(r"\[(\d+)\]", name):
                    size *= int(d)
                fields[re.sub(r"[*()]|\[\d+\]", "", name)] = (offset, size, types[ftype], name)
                offset += size
            at += 4 * n
            out.append((types[kind], fields))
        return out

    def of(self, name: str) -> Iterator[Block]:
        """Blocks of a struct, in file order."""
        return self.blocks.of_structs([k for k, (kind, _) in enumerate(self.layouts) if kind == name])

    def field(self, block: Block, *names: str) -> tuple[bytes, str] | None:
        """Bytes and declared name of the first field present; ``a.b`` goes into nested structs."""
        for name in names:
            fields, at = self.layouts[block.sdna][1], block.start
            for step in name.split("."):
                held = fields.get(step)
                if held is None:
                    break
                offset, size, kind, declared = held
                at += offset
                fields = self.by_name.get(kind, {})
            else:
                if at + size <= block.start + block.size:
                    return self.data[at : at + size], declared
        return None

    def number(self, block: Block, *names: str) -> int | None:
        held = self.field(block, *names)
        if held is None or held[1].startswith("*") or len(held[0]) not in (1, 2, 4, 8):
            return None
        return int.from_bytes(held[0], "little" if self.head.order == "<" else "big", signed=True)

    def target(self, block: Block, *names: str) -> Block | None:
        held = self.field(block, *names)
        if held is None or len(held[0]) != self.head.pointer:
            return None
        return self.blocks.at(int.from_bytes(held[0], "little" if self.head.order == "<" else "big"))

    def payload(self, block: Block, most: int) -> bytes:
        """A block's bytes, ``most`` of them at most."""
        return self.data[block.start : block.start + min(block.size, most)]

    def line(self, block: Block, room: int) -> tuple[str, int]:
        """A line up to its zero byte, and its length; of one longer than ``room`` characters only the length counts."""
        reader, parts, total = codecs.getincrementaldecoder("utf-8")("replace"), [], 0
        for at in range(block.start, block.start + block.size, PAGE):
            raw = self.data[at : min(at + PAGE, block.start + block.size)]
            said = reader.decode(raw.split(b"\0", 1)[0])
            total += len(said)
            if total <= room:
                parts.append(said)
            if b"\0" in raw:
                break
            self.check_time()
        said = reader.decode(b"", True)
        return "".join([*parts, said]), total + len(said)

    def path(self, block: Block, *names: str) -> str | None:
        """A path held in place or behind a pointer; empty and missing ones are null, over-long ones refuse the file."""
        held = self.field(block, *names)
        if held is None:
            return None
        raw = held[0]
        if held[1].startswith("*"):
            at = self.target(block, *names)
            if at is None:
                return None
            raw = self.payload(at, self.limits.path_bytes + 1)
        raw = raw.split(b"\0", 1)[0]
        if len(raw) > self.limits.path_bytes:
            raise Refused("malformed", "path too long")
        return raw.decode("utf-8", "replace") or None

    def id_name(self, block: Block) -> str:
        held = self.field(block, "id.name")
        return held[0].split(b"\0", 1)[0].decode("utf-8", "replace")[2:] if held else ""

    def check_time(self) -> None:
        if time.monotonic() > self.late:
            raise Late

    def body(self, block: Block) -> tuple[str, int, bool]:
        """Lines of a text in order, joined; length with the newlines, and whether it was cut."""
        parts: list[str] = []
        total, seen, line = 0, set(), self.target(block, "lines.first")
        while line is not None and line.address not in seen:
            seen.add(line.address)
            if not len(seen) % 64:
                self.check_time()
            at, said, n = self.target(line, "line"), "", 0
            if at is not None:
                declared = self.number(line, "len")
                if declared is not None and (declared < 0 or declared > at.size or declared > self.limits.field_bytes):
                    raise Refused("malformed", "string too long")
                said, n = self.line(at, self.limits.script_chars - total)
            total += n + (1 if parts else 0)
            if total > self.limits.script_chars:
                return "\n".join(parts), total, True
            parts.append(said)
            line = self.target(line, "next")
        return "\n".join(parts), total, False


_ROW = {"path": pa.string(), "category": pa.string(), "place": pa.int32(), "name": pa.string(), "body": pa.string(), "raw_path": pa.string(), "code": pa.int64(), "flags": pa.int64(), "size": pa.int64(), "address": pa.int64(), "truncated": pa.bool_(), "detail": pa.string(), "spent": pa.int64()}
SCHEMA = "path string, category string, place int, name string, body string, raw_path string, code bigint, flags bigint, size bigint, address bigint, truncated boolean, detail string, spent bigint"


_ORDER = ("text", "fcurve", "driver", "osl", "library", "filepath", "file", "error")


def _signed(address: int) -> int:
    return address - (1 << 64) if address >= 1 << 63 else address


def findings(box: Container, wanted: frozenset[str] | None = None) -> Iterator[dict]:
    """Rows of the wanted categories (all by default) in their fixed order; ``stage`` rows mark each one begun."""
    asked = lambda *names: wanted is None or not wanted.isdisjoint(names)
    yield {"category": "stage", "detail": "text"}
    for b in box.blocks.coded("TX") if asked("text") else ():
        box.check_time()
        body, size, cut = box.body(b)
        yield {"category": "text", "name": box.id_name(b) or "<unnamed>", "body": body, "raw_path": box.path(b, "filepath", "name"), "flags": box.number(b, "flags", "flag") or 0, "size": size, "truncated": cut}
    yield {"category": "stage", "detail": "driver"}
    for b in box.of("FCurve") if asked("fcurve") else ():
        at = box.target(b, "driver")
        if at is not None:
            index = box.number(b, "array_index")
            yield {"category": "fcurve", "address": _signed(at.address), "name": (box.path(b, "rna_path") or "<unknown property>") + (f"[{index}]" if index else "")}
    for b in box.of("ChannelDriver") if asked("driver") else ():
        box.check_time()
        held = box.field(b, "expression")
        expression = held[0].split(b"\0", 1)[0].decode("utf-8", "replace") if held else ""
        if expression.strip():
            kind = box.number(b, "type")
            yield {"category": "driver", "body": expression, "code": -1 if kind is None else kind, "flags": box.number(b, "flag") or 0, "address": _signed(b.address), "truncated": kind is None}
    yield {"category": "stage", "detail": "osl"}
    for b in box.of("NodeShaderScript") if asked("osl") else ():
        mode, code = box.number(b, "mode") or 0, box.target(b, "bytecode")
        digest = box.field(b, "bytecode_hash")
        yield {"category": "osl", "code": mode, "raw_path": box.path(b, "filepath") if mode == 1 else None, "size": code.size if code else 0, "detail": digest[0].split(b"\0", 1)[0].decode("latin-1") if digest else ""}
    yield {"category": "stage", "detail": "library"}
    for b in box.blocks.coded("LI") if asked("library") else ():
        if (path := box.path(b, "filepath", "name")):
            yield {"category": "library", "raw_path": path}
    yield {"category": "stage", "detail": "filepath"}
    for b in box.blocks.coded(*FILE_CODES) if asked("filepath") else ():
        if (path := box.path(b, "filepath", "name")):
            yield {"category": "filepath", "detail": FILE_CODES[b.code], "name": box.id_name(b), "raw_path": path}


def inspect(content: bytes | Pages | None, limits: Limits = Limits(), wanted: frozenset[str] | None = None) -> list[dict]:
    """All rows of one file, or of the wanted categories, ending with one ``file`` or ``error`` row; ``size`` of a null content is unknown."""
    began, rows, stage = time.monotonic(), [], "preflight"
    late = began + limits.seconds
    spent = lambda: {"spent": int(1000 * (time.monotonic() - began))}
    try:
        if content is None or len(content) > limits.file_bytes:
            raise Refused("malformed", "file too large")
        data = inflated(content, limits, late)
        box = Container(data, limits, late)
        about = {"category": "file", "name": box.head.version, "code": box.head.pointer, "size": len(box.blocks) + 1, "body": compression(content[:7])}
        try:
            for row in findings(box, wanted):
                if row["category"] == "stage":
                    stage = row["detail"]
                    box.check_time()
                else:
                    rows.append(row)
        except Late:
            return [*rows, about | spent() | {"truncated": True, "detail": stage}]
        return [*rows, about | spent() | {"truncated": False}]
    except Refused as e:
        return [{"category": "error", "name": e.kind, "detail": str(e)} | spent()]
    except Late:
        return [{"category": "error", "name": "malformed", "detail": "out of time before the blocks were read"} | spent()]
    except (MemoryError, RecursionError, struct.error, IndexError) as e:
        return [{"category": "error", "name": "malformed", "detail": type(e).__name__} | spent()]


def batch_of(path: str, rows: list[dict]) -> pa.RecordBatch:
    """A file's rows with their places: numbers that rise along the file, and are the same whichever categories were asked."""
    columns = {k: pa.array([r.get(k) for r in rows], ty) for k, ty in _ROW.items()}
    columns["path"] = pa.array([path] * len(rows), pa.string())
    counts = {c: k << 27 for k, c in enumerate(_ORDER)}
    places = []
    for r in rows:
        places.append(counts[r["category"]])
        counts[r["category"]] += 1
    columns["place"] = pa.array(places, pa.int32())
    return pa.RecordBatch.from_pydict(columns)


def inspect_rows(contents: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Findings of (path, content) rows, one after another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                yield batch_of(path.as_py(), inspect(content.as_py(), limits))

    return contents.select("path", "content").mapInArrow(run, SCHEMA)


def expanded(spark: SparkSession, targets: list[str], suffix: str = ".blend") -> tuple[list[str], list[str]]:
    """(folders, files) that targets name; only the targets themselves are looked up, in any store.

    A file named outright counts whatever its suffix; what a pattern meets counts by its suffix,
    unless the pattern is the only target. What lies in a folder that is taken anyway is left out.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    folders, files = [], []
    for target in targets:
        at = jvm.org.apache.hadoop.fs.Path(target)
        named = any(c in target for c in "*?[{")
        for status in at.getFileSystem(conf).globStatus(at) or []:
            path = status.getPath().toString()
            if status.isDirectory():
                folders.append(path.rstrip("/"))
            elif not named or path.endswith(suffix) or len(targets) == 1:
                files.append(path)
    within = lambda p, own: any(p.startswith(f + "/") for f in folders if f != own)
    kept = [f for f in dict.fromkeys(folders) if not within(f, f)]
    return kept, [f for f in dict.fromkeys(files) if not (f.endswith(suffix) and within(f, None))]


def read(spark: SparkSession, targets: str | list[str], limits: Limits = Limits(), suffix: str = ".blend", categories: list[str] | None = None) -> DataFrame:
    """Findings of all files that the targets (files, folders, patterns) name, each once; targets that name nothing give no rows.

    With ``categories`` only those are walked and returned.

    Files go through the ``containers`` data source, which reads what it needs of them; of a store
    that only Spark opens, whole contents are read. A file over the limit is an error row either way.
    """
    from quarrykit.sources import datasource

    folders, files = expanded(spark, [targets] if isinstance(targets, str) else targets, suffix)
    if not folders and not files:
        return spark.createDataFrame([], SCHEMA)
    if all(map(datasource.opens, [*folders, *files])):
        return datasource.load(spark, folders, files, limits, suffix, categories)
    binary = lambda: spark.read.format("binaryFile")
    parts = []
    if folders:
        parts.append(binary().option("pathGlobFilter", f"*{suffix}").option("recursiveFileLookup", True).load(folders))
    if files:
        parts.append(binary().load(files))
    found = reduce(DataFrame.unionByName, parts)
    most = min(limits.file_bytes, (1 << 31) - 1)
    large = found.where(F.col("length") > most).select("path", F.lit(None).cast("binary").alias("content"))
    rows = inspect_rows(found.where(F.col("length") <= most).select("path", "content").unionByName(large), limits)
    return rows if categories is None else rows.where(F.col("category").isin(categories))


def texts(rows: DataFrame) -> DataFrame:
    """Text blocks with decoded flags."""
    flags = F.col("flags")
    bit = lambda b: flags.bitwiseAND(1 << b) != 0
    return rows.where("category = 'text'").select("path", "place", "name", F.col("raw_path").alias("filepath"), "flags", flag_names(flags, t.TEXT_FLAGS).alias("flag_names"), bit(4).alias("is_autorun"), bit(2).alias("is_memory"), bit(3).alias("is_external"), F.col("size").alias("source_bytes"), "truncated", F.col("body").alias("source"))


def drivers(rows: DataFrame) -> DataFrame:
    """Drivers with their owner: a left join on the address, the last owner of an address winning."""
    owners = rows.where("category = 'fcurve'").groupBy("path", "address").agg(F.max_by("name", "place").alias("owner"))
    kind = F.when(F.col("code").between(0, len(t.DRIVER_TYPES) - 1), F.get(F.array(*(F.lit(n) for n in t.DRIVER_TYPES)), F.col("code").cast("int"))).otherwise(F.concat(F.lit("unknown("), F.col("code").cast("string"), F.lit(")")))
    found = rows.where("category = 'driver'").join(owners, ["path", "address"], "left")
    return found.select("path", "place", F.coalesce("owner", F.lit("<unattached driver>")).alias("owner"), "body", F.substring("body", 1, 256).alias("expression"), F.col("code").alias("driver_type"), kind.alias("driver_type_name"), "flags", flag_names(F.col("flags"), t.DRIVER_FLAGS).alias("flag_names"), (F.col("truncated") | (F.col("code") == 1)).alias("expression_is_evaluated"))


def nodes(rows: DataFrame) -> DataFrame:
    mode = F.coalesce(F.get(F.array(*(F.lit(n) for n in t.NODE_MODES)), F.col("code").cast("int")), F.concat(F.lit("unknown("), F.col("code").cast("string"), F.lit(")")))
    return rows.where("category = 'osl'").select("path", "place", F.col("code").alias("mode"), mode.alias("mode_name"), F.col("raw_path").alias("filepath"), F.col("size").alias("bytecode_bytes"), F.col("detail").alias("bytecode_hash"))


def libraries(rows: DataFrame) -> DataFrame:
    return rows.where("category = 'library'").select("path", "place", "raw_path")


def filepaths(rows: DataFrame) -> DataFrame:
    return rows.where("category = 'filepath'").select("path", "place", F.col("detail").alias("kind"), "name", F.col("raw_path").alias("file"))


def files(rows: DataFrame) -> DataFrame:
    """One row a readable file; a file that ran out of time says at which stage."""
    return rows.where("category = 'file'").select("path", F.col("name").alias("version"), version_display(F.col("name")).alias("version_display"), F.col("code").alias("pointer_size"), F.col("body").alias("compression"), F.col("size").alias("block_count"), F.lit(CATEGORIES).alias("categories_checked"), F.col("truncated").alias("timed_out"), F.col("detail").alias("timed_out_at"), "spent")


def errors(rows: DataFrame) -> DataFrame:
    return rows.where("category = 'error'").select("path", F.col("name").alias("kind"), F.col("detail").alias("message"))
