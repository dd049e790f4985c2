"""Secret scans with a recursive decoding worklist.

Every text is searched for three kinds of secrets. Then encoded layers inside it (percent
escapes, \\u and \\x escapes, base64, gzip/zlib streams inside base64) are decoded, each
decoded layer is searched and unwrapped again, until no new layer appears. Layers seen before
in a document are not taken twice, which ends cycles. A finding inside a layer is reported at
the span of the original text that it came from, mapped back layer by layer: characters of percent
and \\u runs, and of base64, have places of their own, what a compressed stream inflates to has that
of the whole stream. Base64 is also joined over line breaks
and decoded from each of its four alignments, so whatever stands before it; if a run is not text
as a whole, each readable part of it is a layer.

Defined results: a null text counts as empty; an empty text has no spans and the digest of
the empty string; repeated rows are scanned one by one; other columns are not read. Bytes
that do not decode to text are replaced in percent runs and left out of base64.
"""

from __future__ import annotations

import base64
import bisect
import codecs
import hashlib
import re
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import unquote_to_bytes

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrykit.llm.common import parts, texts_of

KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")
_LEAST_ASSIGN = 12

#: An inflated layer is read in pieces of about PIECE bytes that end where no finding and no layer
#: can go on (_SAFE); a longer run is held whole, so memory grows with the longest run only.
PIECE = 1 << 20
FEED = 1 << 12  # compressed bytes taken at once
_SAFE = re.compile(r"[^\t\n\r\x20-\x7e]|(?<=[!#-&()*,.;<>?@\[-^`{-~])[\x20\t\r\n]|(?<=[A-Za-z0-9])\x20(?=[A-Za-z0-9])")

#: Runs that may hold escapes are taken whole, which keeps the search linear on long runs.
_URL_RUN = re.compile(r"[A-Za-z0-9+/_.=~:&?%-]+")
_PERCENT = re.compile(r"%[0-9A-Fa-f]{2}")
_VISIBLE_RUN = re.compile(r"[!-~]+")
_ESCAPED = re.compile(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|x([0-9A-Fa-f]{2}))")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
_WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]++(?:[\x20\t]*+[\r\n]++[\x20\t]*+[A-Za-z0-9+/_-]++)++={0,2}")
_BREAKS = re.compile(r"[\x20\t\r\n]+")
_START = re.compile(r"(?<=[/_-])[A-Za-z0-9+]|^.")

#: No secret is shorter, and no layer of one but inflated data, which is looked for by itself.
LEAST = 16
_READABLE = re.compile(rb"(?:[\t\n\r\x20-\x7e]|[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3})++")


def scan(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of each base finding: leftmost, non-overlapping within its kind."""
    found = [(m.start(), m.end(), 0) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= _LEAST_ASSIGN]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in _ACCESS.finditer(text)]
    found += [(m.start(), m.end(), 2) for m in _HEX.finditer(text)]
    found.sort(key=lambda x: (x[0], x[2]))
    return found


def _text(raw: bytes) -> str | None:
    """Decoded bytes as text, if they read as text."""
    try:
        out = raw.decode("utf-8")
    except UnicodeDecodeError:
        return None
    odd = sum(not (c.isprintable() or c in "\n\r\t") for c in out)
    return out if out and odd * 20 <= len(out) else None


def _cut(text: str) -> int:
    """The last place of ``text`` that no finding and no layer goes over; 0 if there is none."""
    for size in (FEED, len(text)):
        last = None
        for last in _SAFE.finditer(text, max(0, len(text) - size)):
            pass
        if last:
            return last.end()
    return 0


def _member(raw: bytes, at: int) -> int:
    """Window bits of the gzip or zlib stream that begins at ``at``, or 0."""
    if raw[at : at + 3] == b"\x1f\x8b\x08":
        return 31
    return 15 if len(raw) > at + 2 and raw[at] & 15 == 8 and int.from_bytes(raw[at : at + 2], "big") % 31 == 0 else 0


def _bytes(raw: bytes, at: int, ends: list[int]) -> Iterator[bytes]:
    """What the streams from ``at`` on inflate to, one behind the other, up to an error; their end goes to ``ends``."""
    while wbits := _member(raw, at):
        stream, before = zlib.decompressobj(wbits), at
        while not stream.eof and at < len(raw):
            left, spare = raw[at : at + FEED], stream.copy()
            at += len(left)
            try:
                while left:
                    if part := stream.decompress(left, PIECE):
                        yield part
                    left = stream.unconsumed_tail
                    spare = stream.copy() if left else spare
            except zlib.error:
                try:  # what comes before the error
                    for k in range(len(left)):
                        if part := spare.decompress(left[k : k + 1]):
                            yield part
                except zlib.error:
                    pass
                ends.append(before + 1)
                return
        if part := stream.flush():
            yield part
        at -= len(stream.unused_data)
    ends.append(at)


def _inflate(raw: bytes, at: int, ends: list[int]) -> Iterator[str]:
    """Text of the streams at ``at`` in pieces that no run goes over."""
    reader, held, size = codecs.getincrementaldecoder("utf-8")("replace"), [], 0
    for part in _bytes(raw, at, ends):
        text = reader.decode(part)
        size += len(text)
        cut = _cut(text) if size >= PIECE else 0
        if cut:
            yield "".join([*held, text[:cut]])
            held, size = [text[cut:]], len(text) - cut
        else:
            held.append(text)
    held.append(reader.decode(b"", True))
    if text := "".join(held):
        yield text


def _unescape(text: str) -> str:
    def one(m: re.Match) -> str:
        code = int(m[1] or m[2] or m[3], 16)
        return chr(code) if code < 0x110000 else m[0]

    return _ESCAPED.sub(one, text).encode("utf-16", "surrogatepass").decode("utf-16", "replace")


Locate = Callable[[int, int], tuple[int, int]]  # a span of a layer's text -> the span of the text that it came from


def _char_starts(raw: bytes) -> list[int]:
    """The byte at which each character of ``raw`` begins, decoded with replacement, and the end."""
    if raw.isascii():
        return list(range(len(raw) + 1))
    reader, starts, begin = codecs.getincrementaldecoder("utf-8")("replace"), [], 0
    for j in range(len(raw)):
        n = len(reader.decode(raw[j : j + 1]))
        if n:
            starts += [begin] * max(1, n - 1) + [j] * (n > 1)
            begin = j + 1 - len(reader.getstate()[0])
    starts += [begin] * len(reader.decode(b"", True))
    return [*starts, len(raw)]


def _by_table(table: Callable[[], list[int]]) -> Locate:
    """Spans by a table of places, one a character and one for the end, which is made at the first finding and kept."""
    held: list[list[int]] = []

    def locate(s: int, e: int) -> tuple[int, int]:
        if not held:
            held.append(table())
        return held[0][s], held[0][e]

    return locate


def _percent_places(run: str, start: int) -> Locate:
    def table() -> list[int]:
        begins, at = [], 0
        for m in [*_PERCENT.finditer(run), None]:
            begins += range(at, m.start() if m else len(run))
            if m:
                begins.append(m.start())
                at = m.end()
        begins.append(len(run))
        return [start + begins[c] for c in _char_starts(unquote_to_bytes(run))]

    return _by_table(table)


def _escape_places(run: str, start: int) -> Locate:
    def table() -> list[int]:
        units, at = [], 0  # (code, begin) of each code unit
        for m in [*_ESCAPED.finditer(run), None]:
            upto = m.start() if m else len(run)
            units += [(ord(c), at + i) for i, c in enumerate(run[at:upto])]
            if m:
                code = int(m[1] or m[2] or m[3], 16)
                units += [(code, m.start())] if code < 0x110000 else [(ord(c), m.start() + i) for i, c in enumerate(m[0])]
                at = m.end()
        begins = [b for k, (code, b) in enumerate(units) if not (k and 0xDC00 <= code <= 0xDFFF and 0xD800 <= units[k - 1][0] <= 0xDBFF)]
        return [start + b for b in [*begins, len(run)]]

    return _by_table(table)


def _byte_places(text: str) -> Locate:
    """Where characters stand among the UTF-8 bytes of a text."""
    if text.isascii():
        return lambda s, e: (s, e)

    def table() -> list[int]:
        codes = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
        return [0, *np.cumsum(1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000)).tolist()]

    return _by_table(table)


def layers(text: str) -> Iterator[tuple[int, int, str, Locate]]:
    """(start, end, decoded text, where a span of it came from) of each layer directly inside ``text``."""
    if "%" in text:
        for m in _URL_RUN.finditer(text):
            if _PERCENT.search(m[0]) and (out := unquote_to_bytes(m[0]).decode("utf-8", "replace")) != m[0]:
                yield m.start(), m.end(), out, _percent_places(m[0], m.start())
    if "\\" in text:
        for m in _VISIBLE_RUN.finditer(text):
            if "\\" in m[0] and (out := _unescape(m[0])) != m[0]:
                yield m.start(), m.end(), out, _escape_places(m[0], m.start())
    wrapped = [m.span() for m in _WRAPPED.finditer(text)] if "\n" in text or "\r" in text else []
    for start, end in wrapped:
        yield from _base64(text, start, end)
    k = 0
    for m in _BASE64.finditer(text):
        while k < len(wrapped) and wrapped[k][1] <= m.start():
            k += 1
        if k == len(wrapped) or m.start() < wrapped[k][0]:
            yield from _base64(text, *m.span())


def _base64(text: str, start: int, end: int) -> Iterator[tuple[int, int, str, Locate]]:
    """Layers of a base64 run, also of one that is wrapped over lines."""
    lines, first = [], start  # (begin in the text, begin in the joined run)
    joined, size = [], 0
    for gap in [*_BREAKS.finditer(text, start, end), None]:
        line = text[first : gap.start() if gap else end].rstrip("=")
        lines.append((first, size, len(line)))
        joined.append(line)
        size += len(line)
        first = gap.end() if gap else end
    if size < 20:
        return
    run = "".join(joined).translate(_URL_SAFE)
    begins = [b for _, b, _ in lines]

    def place(i: int) -> int:
        """Where the joined run's character ``i`` stands in the text."""
        at, begin, _ = lines[bisect.bisect_right(begins, i) - 1]
        return at + i - begin

    def places(out: str, shift: int, first: int) -> Locate:
        """Of a text that begins at byte ``first`` of what the run decodes to from character ``shift`` on."""

        bytes_of = _byte_places(out)

        def locate(s: int, e: int) -> tuple[int, int]:
            low, high = (first + x for x in bytes_of(s, e))
            return place(shift + low * 4 // 3), place(max(shift + low * 4 // 3, min(size, shift + -(-high * 4 // 3)) - 1)) + 1

        return locate

    whole: list[tuple[int, int]] = []  # runs that are text from end to end, as places of the joined run
    for at, begin, n in [*([(start, 0, size)] if len(lines) > 1 else []), *lines]:
        if n >= 20 and n % 4 != 1 and whole[:1] != [(0, size)]:
            if out := _text(_decode(run[begin : begin + n])):
                whole.append((begin, begin + n))
                close = place(begin + n - 1) + 1
                while close < end and text[close] == "=":
                    close += 1
                yield at, close, out, places(out, begin, 0)
    starts = [m.start() for m in _START.finditer("".join(joined))] + begins
    for shift in range(4):
        raw = _decode(run[shift:])
        for m in _READABLE.finditer(raw):
            if m.end() - m.start() < LEAST:
                continue
            a, b = shift + m.start() * 4 // 3, min(size, shift + -(-m.end() * 4 // 3))
            w, e = whole[max(0, bisect.bisect_right(whole, (a, size)) - 1)] if whole else (size, size)
            if not (w <= a and b <= e and (w - shift) % 4 == 0):
                out = m[0].decode("utf-8", "replace")
                yield place(a), end if b == size else place(b - 1) + 1, out, places(out, shift, m.start())
        heads = {(i - shift) // 4 * 3 for i in starts if i >= shift and (i - shift) % 4 == 0}
        heads.update(m.start() for m in re.finditer(rb"\x1f\x8b\x08", raw))
        done = 0
        for head in sorted(heads):
            if head >= done and _member(raw, head):
                ends: list[int] = []
                span = place(shift + head * 4 // 3), end  # compressed bytes have no places of their own
                for out in _inflate(raw, head, ends):
                    yield *span, out, lambda _s, _e, span=span: span
                done = ends[0] if ends else 0


def _decode(run: str) -> bytes:
    run = run[: len(run) - (len(run) % 4 == 1)]
    return base64.b64decode(run + "=" * (-len(run) % 4))


_URL_SAFE = str.maketrans("-_", "+/")


def decoded_findings(text: str) -> set[tuple[int, int, int]]:
    """Findings inside encoded layers, at the span of the original text that each came from."""
    found: set[tuple[int, int, int]] = set()
    seen: set[bytes] = set()
    # One generator for each layer that is open: a piece of a layer is dropped before the next is made.
    work: list[tuple[Iterator, Locate | None]] = [(layers(text), None)]
    while work:
        inside, outer = work[-1]
        layer = next(inside, None)
        if layer is None:
            work.pop()
            continue
        start, end, inner, within = layer
        locate = within if outer is None else lambda a, b, outer=outer, within=within: outer(*within(a, b))
        if outer is not None:
            start, end = outer(start, end)
        key = hashlib.blake2b(f"{start}:{end}:{inner}".encode("utf-8", "replace"), digest_size=16).digest()
        if key in seen:
            continue
        seen.add(key)
        found.update((*locate(s, e), kind) for s, e, kind in scan(inner))
        work.append((layers(inner), locate))
    return found


def _join(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in spans)


def report(text: str | None) -> tuple[int, int, int, str, str, int]:
    """n_assign, n_access, n_hex, base_sha256, all spans, number of spans that decoding added."""
    base = scan(text) if text else []
    extra = decoded_findings(text) - set(base) if text else set()
    every = sorted({*base, *extra}, key=lambda x: (x[0], x[2], x[1]))
    counts = [sum(k == i for _, _, k in base) for i in range(3)]
    return *counts, hashlib.sha256(_join(base).encode()).hexdigest(), _join(every), len(extra)


SCHEMA = "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_decoded bigint"
_TYPES = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())


def find_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document row with its findings; a narrow map, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, 1):
            rows = [report(t and t.decode("utf-8", "replace")) for t in texts_of(batch, 1)]
            columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(_TYPES)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_decoded"])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, SCHEMA)


def redact(text: str | None, mask: str = "[secret]") -> str | None:
    """The text with every finding's span replaced by ``mask``; overlapping spans become one."""
    if not text:
        return text
    spans = sorted((s, e) for s, e, _ in {*scan(text), *decoded_findings(text)})
    out, at = [], 0
    for s, e in spans:
        if s >= at:
            out += [text[at:s], mask]
        at = max(at, e)
    return "".join([*out, text[at:]]) if spans else text


def redacted_rows(docs: DataFrame, *, text_col: str = "text", length_col: str | None = "n_chars", mask: str = "[secret]") -> DataFrame:
    """All rows of ``docs`` with secrets in their text masked and the length column kept true; no shuffle."""
    at = docs.columns.index(text_col)
    count_at = docs.columns.index(length_col) if length_col in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, at):
            before = [t if t is None else t.decode("utf-8", "replace") for t in texts_of(batch, at)]
            after = [redact(t, mask) for t in before]
            columns = list(batch.columns)
            columns[at] = pa.array(after, batch.schema.field(at).type)
            if count_at is not None:
                columns[count_at] = pa.array([len(b) if a != b else n for a, b, n in zip(before, after, columns[count_at].to_pylist(), strict=True)], batch.schema.field(count_at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)
