"""WARC archives: a writer with revisit records and a reader that salvages damaged files.

The reader checks each record (gzip member, version line, length, block digest). After a failed
check it searches for the next place where a valid record begins, inside what a member inflates
to and behind it, goes on from there and reports the bytes between as a quarantined gap. A gap
between records of one member has the member's place; its reason names the inflated bytes. In a
member that does not inflate to its end, a record without a block digest is not trusted.

Defined results: a null payload counts as empty; pages below LEAST bytes are never revisits;
rows that repeat the largest page_id of a payload are all responses; a row without a page_id is
archived without one and never the target of a revisit; control characters and spaces in a URL
are percent-encoded, a null URL is written as urn:qk:none; an empty table gives no archives.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrykit.llm import files
from quarrykit.llm.common import lookup
from quarrykit.session import shared_folder, stored

LEAST = 1000
ROLL_BYTES = 64 << 20  # an archive is closed beyond this size
MAX_TASKS = 10_000  # that archives are read in
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_UNSAFE = re.compile(r"[\x00-\x20\x7f-\x9f]")
_MAGIC = b"\x1f\x8b\x08"
_VERSION = re.compile(rb"WARC/[01]\.\d+\r?\n")
_HEAD_BYTES = 1 << 16  # read first for a record's headers, and doubled until they end
HOLD = 4 << 20  # inflated bytes of a member that are kept; a longer one is inflated again, record by record
STEP = 1 << 20  # bytes inflated at once


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One record; a revisit has the HTTP head only, with the full payload's digest and length."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    target = _UNSAFE.sub(lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url) if url else "urn:qk:none"
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:qk:page:{'none' if page_id is None else page_id}>",
        f"WARC-Target-URI: {target}",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: {_sha1(payload)}",
        f"WARC-Block-Digest: {_sha1(block)}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:qk:page:{refers_to}>", f"WARC-Profile: {_PROFILE}"]
    return "\r\n".join(head).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n"


# Digest algorithms of archives and their sizes in bytes.
_SIZES = {"md5": 16, "sha1": 20, "sha256": 32, "sha512": 64}


def read_digest(value: str | None) -> tuple[str, bytes] | None:
    """(algorithm, bytes) of ``name:text``, the text in base32 or hexadecimal of either case; None for anything else, which is no check."""
    name, _, text = (value or "").partition(":")
    name, text = name.strip().lower().replace("-", ""), text.strip().rstrip("=")
    size = _SIZES.get(name)
    if size and re.fullmatch(r"[0-9A-Fa-f]+", text) and len(text) == 2 * size:
        return name, bytes.fromhex(text)
    if size and re.fullmatch(r"[A-Za-z2-7]+", text) and len(text) == -(-size * 8 // 5):
        return name, base64.b32decode(text.upper() + "=" * (-len(text) % 8))
    return None


def differs(value: str | None, data: bytes) -> bool:
    """Whether a digest that can be read is not that of ``data``."""
    held = read_digest(value)
    return held is not None and hashlib.new(held[0], data).digest() != held[1]


def payload_of(headers: dict[str, str], block: bytes) -> bytes:
    """A block without its HTTP head, which blocks of type application/http have."""
    return block.partition(b"\r\n\r\n")[2] if headers.get("content-type", "").lower().startswith("application/http") else block


def _length(value: str) -> int | None:
    return int(value) if re.fullmatch(r"[0-9]{1,18}", value) else None


def _member(data: bytes, level: int = 3) -> bytes:
    squeeze = zlib.compressobj(level, zlib.DEFLATED, 31)
    return squeeze.compress(data) + squeeze.flush()


class Damaged(ValueError):
    """A check failed."""


class Short(Damaged):
    """The data ends before the record does; ``need`` bytes of it are wanted."""

    def __init__(self, why: str, need: int):
        super().__init__(why)
        self.need = need


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Headers, block and end of the record at ``at``; raises Damaged unless every check holds."""
    version = _VERSION.match(data, at)
    if not version:
        raise Damaged("no version line")
    end = data.find(b"\r\n\r\n", version.end() - 2)
    if end < 0:
        raise Short("headers do not end", len(data) - at + STEP)
    headers: dict[str, str] = {}
    name = ""
    for line in data[version.end() : end].split(b"\r\n"):
        text = bytes(line).decode("utf-8", "replace")
        if name and text[:1] in (" ", "\t"):  # a header folded over lines
            headers[name] = f"{headers[name]} {text.strip()}".strip()
            continue
        name, colon, value = text.partition(":")
        if not colon:
            raise Damaged("not a header line")
        name = name.strip().lower()
        headers[name] = value.strip()
    size = _length(headers.get("content-length", ""))
    if size is None:
        raise Damaged("no length")
    start = end + 4
    if len(data) < start + size + 4:
        raise Short("block is cut short", start + size + 4 - at)
    block = bytes(data[start : start + size])
    if data[start + size : start + size + 4] != b"\r\n\r\n":
        raise Damaged("block is cut short")
    if differs(headers.get("warc-block-digest"), block):
        raise Damaged("block digest differs")
    return headers, block, start + size + 4


class Member:
    """What the gzip member at ``at`` inflates to, in a window that moves on; its size, end and what broke it off are known from the start."""

    def __init__(self, source: files.Source, at: int):
        self._source, self._at = source, at
        self.size, self.why, held = 0, "", []
        offset = at
        for part, offset, why in self._inflate():
            self.size, self.why = self.size + len(part), why
            if self.size <= HOLD:
                held.append(part)
            else:
                held = []
        self.end = offset
        self._data, self._base = bytearray(b"".join(held)) if self.size <= HOLD else bytearray(), 0
        self._parts = None if self.size <= HOLD else self._inflate()

    def _inflate(self) -> Iterator[tuple[bytes, int, str]]:
        """(inflated bytes, offset behind what they came from, what broke off)."""
        stream, offset, left = zlib.decompressobj(31), self._at, b""
        while not stream.eof:
            if not left:
                left = self._source.read(offset, 1 << 15)
                if not left:
                    yield b"", offset, "member is cut short"
                    return
                offset += len(left)
            spare = stream.copy()
            try:
                part = stream.decompress(left, STEP)
            except zlib.error:
                out, k = [], 0
                try:  # what comes before the error
                    for k in range(len(left)):
                        out.append(spare.decompress(left[k : k + 1]))
                except zlib.error:
                    pass
                yield b"".join(out), offset - len(left) + k, "member does not inflate"
                return
            left = b"" if stream.eof else stream.unconsumed_tail
            yield part, offset - len(left) - len(stream.unused_data), ""

    def _fill(self, upto: int) -> None:
        """Hold the bytes up to a place, as far as there are any."""
        while self._parts is not None and self._base + len(self._data) < min(upto, self.size):
            part = next(self._parts, None)
            if part is None:
                break
            self._data += part[0]

    def drop(self, before: int) -> None:
        """Forget what stands before a place."""
        if self._parts is not None and before > self._base:
            del self._data[: before - self._base]
            self._base = before

    def record(self, at: int) -> tuple[dict[str, str], bytes, int]:
        """Headers, block and end of the record at a place; a length beyond the member fails before anything is held for it."""
        self._fill(at + _HEAD_BYTES)
        while True:
            try:
                headers, block, end = parse(self._data, at - self._base)
                return headers, block, end + self._base
            except Short as e:
                whole = self._base + len(self._data) >= self.size
                if whole or (str(e) == "block is cut short" and at + e.need > self.size):
                    raise Damaged(str(e)) from None
                self._fill(at + e.need)

    def version(self, at: int) -> int:
        """The next place from ``at`` on where a version line stands, or the size."""
        while True:
            found = _VERSION.search(self._data, at - self._base)
            if found:
                return self._base + found.start()
            held = self._base + len(self._data)
            if held >= self.size:
                return self.size
            at = max(at, held - 16)
            self.drop(at)
            self._fill(held + STEP)

    def where(self, n: int) -> int:
        """Offset in the file behind which ``n`` inflated bytes are there."""
        stream, offset = zlib.decompressobj(31), self._at
        while n > 0 and (part := self._source.read(offset, 1 << 10)):
            for k in range(len(part)):
                try:
                    n -= len(stream.decompress(part[k : k + 1]))
                except zlib.error:
                    return offset + k
                if n <= 0:
                    return offset + k + 1
            offset += len(part)
        return offset


def _inside(member: Member) -> Iterator[tuple[int, int, dict[str, str] | None, bytes]]:
    """Begin, end, headers and block of all records of a member; headers are None and the block a reason for gaps."""
    at, bad, why = 0, None, ""
    while at < member.size:
        try:
            headers, block, end = member.record(at)
            if member.why and read_digest(headers.get("warc-block-digest")) is None:
                raise Damaged("no digest in a broken member")
        except Damaged as e:
            if bad is None:
                bad, why = at, str(e)
            at = member.version(at + 1)
            continue
        if bad is not None:
            yield bad, at, None, why.encode()
            bad = None
        yield at, end, headers, block
        at = end
        member.drop(at)
    if bad is not None:
        yield bad, member.size, None, why.encode()


def _plain(source: files.Source, at: int) -> tuple[bytes, int]:
    """The bytes of the uncompressed record at ``at``."""
    head = source.read(at, _HEAD_BYTES)
    if not _VERSION.match(head):
        raise Damaged("no record begins here")
    while (end := head.find(b"\r\n\r\n")) < 0 and at + len(head) < source.size:
        head = source.read(at, 2 * len(head))
    m = re.search(rb"(?i)\r\ncontent-length:[ \t]*([0-9]{1,18})[ \t]*\r\n", head)
    if not m or not 0 <= m.start() < end:
        raise Damaged("no record begins here")
    size = end + 8 + int(m[1])
    if at + size > source.size:
        raise Damaged("block is cut short")
    return source.read(at, size), at + size


def salvage(source: files.Source) -> Iterator[tuple[str, int, int, dict[str, str], bytes]]:
    """("record" or "gap", offset, length, headers, block) over the whole file, in order."""
    at, bad, why, ahead = 0, None, "", {_MAGIC: 0, b"WARC/": 0}

    def following(offset: int) -> int:
        """The next place where a member or a record may begin."""
        for mark, known in ahead.items():
            if known < offset:
                found = source.find(mark, offset)
                ahead[mark] = source.size if found < 0 else found
        return min(ahead.values())

    while at < source.size:
        try:
            if source.read(at, len(_MAGIC)) != _MAGIC:
                data, end = _plain(source, at)
                headers, block, _ = parse(data)
                if bad is not None:
                    yield "gap", bad, at - bad, {"reason": why}, b""
                    bad = None
                yield "record", at, end - at, headers, block
                at = end
                continue
        except Damaged as e:
            if bad is None:
                bad, why = at, str(e)
            at = following(at + 1)
            continue
        member = Member(source, at)
        end, gaps, any_ = member.end, [], False
        if member.why:  # what comes behind the last good record belongs to the gap that follows
            last = max((stop for _, stop, headers, _ in _inside(member) if headers is not None), default=0)
            end, member = member.where(last), Member(source, at)
        for first, stop, headers, block in _inside(member):
            if headers is None:
                gaps.append({"reason": f"{block.decode()} (inflated bytes {first} to {stop})"})
                continue
            if bad is not None:
                yield "gap", bad, at - bad, {"reason": why}, b""
                bad = None
            yield from (("gap", at, end - at, g, b"") for g in gaps)
            gaps, any_ = [], True
            yield "record", at, end - at, headers, block
        if not any_:
            if bad is None:
                bad, why = at, member.why or (gaps[0]["reason"].partition(" (")[0] if gaps else "empty member")
            at = following(at + 1) if member.why else end
            continue
        if not member.why:
            yield from (("gap", at, end - at, g, b"") for g in gaps)
            at = end
        elif end < source.size:
            bad, why = end, member.why
            at = following(end)
        else:
            at = end
    if bad is not None:
        yield "gap", bad, source.size - bad, {"reason": why}, b""


def archive(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = LEAST, date: str = "1970-01-01T00:00:00Z", folder: str | None = None) -> DataFrame:
    """Write all pages to .warc.gz files of the shared folder; returns their manifest (file, records, bytes).

    Copies are found by digest on narrow rows, counted before the shuffle; the payloads
    themselves are shuffled only where the table of repeated digests is too large to broadcast.
    """
    spark = pages.sparkSession
    folder = folder or f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.encode(F.col(payload_col).cast("string"), "UTF-8"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    kept = rows.where(F.length("payload") >= least).groupBy("digest").agg(F.max("page_id").alias("keep"), F.count("*").alias("n")).where("n > 1 and keep is not null").select("digest", "keep")
    kept = stored(kept, "digests")
    chosen = lookup(rows, kept, ["digest"], F.col("page_id"))
    refers = F.when((F.length("payload") >= least) & (F.col("page_id").isNull() | (F.col("page_id") < F.col("keep"))), F.col("keep"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, held, size, count, seq = TaskContext.get().partitionId(), [], 0, 0, 0

        def flush() -> pa.RecordBatch:
            name = files.put(folder, f"part-{task:06d}-{seq:06d}.warc.gz", held)
            return pa.RecordBatch.from_pydict({"file": [name], "records": pa.array([count], pa.int64()), "bytes": pa.array([size], pa.int64())})

        for batch in batches:
            for page, url, payload, ref in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                held.append(_member(record(page, url, payload, ref, date)))
                size, count = size + len(held[-1]), count + 1
                if size >= ROLL_BYTES:
                    yield flush()
                    held, size, count, seq = [], 0, 0, seq + 1
        if held:
            yield flush()

    return stored(chosen.select("page_id", "url", "payload", refers.alias("ref")).mapInArrow(write, "file string, records bigint, bytes bigint"), "warc-manifest")


_ROWS = "file string, kind string, offset bigint, length bigint, page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, reason string, payload binary"


def _page_of(value: str | None) -> int | None:
    m = re.fullmatch(r"<urn:qk:page:(-?[0-9]{1,18})>", value or "")
    return int(m[1]) if m else None


def read_archives(manifest: DataFrame, *, file_col: str = "file", with_payload: bool = False) -> DataFrame:
    """Records and quarantined gaps of the archives named in ``manifest``; one task takes whole files, record by record."""
    schema = _ROWS if with_payload else _ROWS.removesuffix(", payload binary")
    names = [c.split()[0] for c in schema.split(", ")]

    def rows(file: str) -> Iterator[tuple]:
        source = files.Source(file)
        for kind, offset, length, headers, block in salvage(source):
            if kind == "gap":
                yield (file, kind, offset, length, None, None, None, None, None, None, headers["reason"], None)
                continue
            payload = payload_of(headers, block)
            revisit = headers.get("warc-type") == "revisit"
            digest = headers.get("warc-payload-digest")
            if not revisit and differs(digest, payload):
                yield (file, "gap", offset, length, None, None, None, None, None, None, "payload digest differs", None)
                continue
            held = read_digest(digest)
            sha = hashlib.sha1(payload).hexdigest() if not revisit else held[1].hex() if held and held[0] == "sha1" else None
            size = _length(headers.get("x-payload-length", "")) if revisit else len(payload)
            yield (file, kind, offset, length, _page_of(headers.get("warc-record-id")), headers.get("warc-target-uri"), size, sha, headers.get("warc-type"), _page_of(headers.get("warc-refers-to")), None, payload)
        source.close()

    types = [{"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}[c.split()[1]] for c in schema.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column(0).to_pylist():
                held, size = [], 0
                for row in rows(file):
                    held.append(row)
                    size += 200 + (len(row[-1] or b"") if with_payload else 0)
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in held], t) for i, t in enumerate(types)], names=names)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in held], t) for i, t in enumerate(types)], names=names)

    return manifest.select(file_col).repartition(min(MAX_TASKS, max(1, manifest.count())), file_col).mapInArrow(read, schema)
