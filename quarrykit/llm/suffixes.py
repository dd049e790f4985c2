"""Repeated bytes by prefix-free parsing.

Rolling hashes of eight bytes trigger the ends of phrases; a phrase overlaps the next by its trigger,
so no phrase's suffix is the beginning of another's. Which phrases occur more than once, with what
follows them, says which windows can: each window of WINDOW bytes stands for the least phrase that
begins in it, with the 72 bytes from there on (or, where triggers are too far apart, for its least run
of 64 bytes), equal windows stand for equal ones, and what occurs once is dropped. Windows in a row
with one such place travel as one stretch of text to a shuffle on it. There ``repeated`` brings them into corpus order: the
dictionary's suffixes are sorted, the parse's suffixes are sorted by doubling over phrases, and a
window's place is its phrase suffix's rank, then the rank of the parse behind it. Neighbours in that
order agree in as many bytes as the least of the parse's common prefixes between them says, so a
window is repeated if it agrees with a neighbour in all of its bytes.

Equal texts are told by their digests before anything else, and one of them stands for all. Stretches
that stand several times in one task go on once. A phrase that over HOT stretches share does not bring
them together: there each window travels alone, as a digest of 128 bits.

Defined results: null, empty and short texts (under WINDOW bytes) lose nothing; every row is a
document, also one that repeats another's doc_id or has none; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrykit.llm import wordhash
from quarrykit.llm.common import PART_BYTES, lookup, parts, texts_of
from quarrykit.session import stored

WINDOW = 200
TRIGGER = 8  # bytes of a trigger
HOT = 10_000
#: Bytes of text that are brought into corpus order in one go, in whole groups.
ORDERED = 1 << 20
#: Stretches that a task remembers to send equal ones once.
REMEMBERED = 500_000

_PLACE = (1 << 31) - 1
_NONE = np.uint64((1 << 64) - 1)
_ODD = 0xA0761D6478BD642F  # odd, so its powers have inverses among 64-bit numbers


@lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of _ODD and of its inverse."""
    out = []
    for base in (_ODD, pow(_ODD, -1, 1 << 64)):
        p = np.full(n, base, np.uint64)
        p[:1] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


class Hashes:
    """Hash of any stretch of some bytes in constant time: sums of mixed eight-byte values times powers."""

    def __init__(self, data: bytes, lane: int = 0):
        eights = wordhash._eights(data)[: max(0, len(data) - TRIGGER + 1)]
        self.at = wordhash.mix(eights ^ wordhash._key(lane, 2024))
        size = 1 << max(16, len(data).bit_length())  # few different sizes, so the powers are kept
        power, self._back = _powers(size)
        self.sums = np.zeros(len(self.at) + 1, np.uint64)
        np.cumsum(self.at * power[: len(self.at)], out=self.sums[1:])

    def of(self, start: np.ndarray, n: np.ndarray | int) -> np.ndarray:
        """Of the ``n`` bytes (TRIGGER or more) from each ``start`` on."""
        return wordhash.mix((self.sums[start + n - (TRIGGER - 1)] - self.sums[start]) * self._back[start])


class Shape(NamedTuple):
    """Sizes that follow from the window's."""

    window: int
    apart: int  # bytes from trigger to trigger on average
    longest: int  # bytes from a phrase's begin on that stand for a window
    gram: int


def shape(window: int) -> Shape:
    if window < 4 * TRIGGER:
        raise ValueError(f"window of {window} bytes: {4 * TRIGGER} or more are possible")
    return Shape(window, max(2, window // 12), window * 9 // 25, max(TRIGGER, window * 8 // 25))


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` values in a row, as long as ``values``; what is missing behind the end counts as none."""
    n = len(values)
    padded = np.full(-(-(n + width) // width) * width, _NONE)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    before = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], before[width - 1 : width - 1 + n])


class Stretches(NamedTuple):
    """Windows in a row that stand for one place: first window, their number, what they stand for, and the text they lie in."""

    start: np.ndarray
    edges: np.ndarray
    key: np.ndarray
    text: np.ndarray


def stretches(texts: list[bytes], hashed: Hashes, of: Shape) -> Stretches:
    ends = np.cumsum([len(t) for t in texts])
    sizes = np.diff(ends, prepend=0)
    n = int(ends[-1])
    begin = np.flatnonzero(hashed.at % np.uint64(of.apart) == 0)
    begin = begin[begin <= n - of.longest]
    names = np.zeros(n, np.uint64)
    values = np.full(n, _NONE)
    names[begin] = hashed.of(begin, of.longest)
    values[begin] = (names[begin] & ~np.uint64(_PLACE)) | begin.astype(np.uint64)
    least = _least(values, of.window - of.longest + 1)
    windows = np.maximum(sizes - of.window + 1, 0)
    text = np.repeat(np.arange(len(texts)), windows)
    at = np.repeat(ends - sizes - (np.cumsum(windows) - windows), windows) + np.arange(len(text))  # all windows
    least = least[at]
    place = (least & np.uint64(_PLACE)).astype(np.int64)
    bare = np.flatnonzero(least == _NONE)
    place[bare] = 0
    key = names[place]
    if len(bare):
        grams = np.full(n, _NONE)
        every = np.arange(max(0, n - of.gram + 1))
        found = hashed.of(every, of.gram)
        grams[: len(every)] = (found & ~np.uint64(_PLACE)) | every.astype(np.uint64)
        gram = (_least(grams, of.window - of.gram + 1)[at[bare]] & np.uint64(_PLACE)).astype(np.int64)
        place[bare] = -1 - gram
        key[bare] = wordhash.mix(found[gram])
    new = np.ones(len(at), bool)
    new[1:] = (text[1:] != text[:-1]) | (place[1:] != place[:-1])
    first = np.flatnonzero(new)
    return Stretches(at[first], np.diff(np.append(first, len(at))), key[first].view(np.int64), text[first])


def _slices(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> pa.Array:
    """Slices of bytes as an Arrow array."""
    offsets = np.concatenate([[0], np.cumsum(size)])
    taken = data[np.repeat(begin - offsets[:-1], size) + np.arange(offsets[-1])]
    return pa.Array.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(taken))])


def _sorted_ranks(strings: pa.Array) -> np.ndarray:
    """Rank of each string among the different ones: the suffix array of a dictionary, where the strings are its suffixes."""
    coded = strings.dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return rank[coded.indices.to_numpy()]


def _dense(keys: np.ndarray) -> np.ndarray:
    return np.unique(keys, return_inverse=True)[1].astype(np.int64)


class Parse:
    """Phrases of some texts and the order of the parse's suffixes."""

    def __init__(self, texts: list[bytes], of: Shape):
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        ends = np.cumsum([len(t) for t in texts])
        starts = np.concatenate([[0], ends[:-1]])
        hashed = Hashes(self.data.tobytes())
        triggers = np.flatnonzero(hashed.at % np.uint64(of.apart) == 0)
        owner = np.searchsorted(ends, triggers, "right")
        inside = (triggers > starts[owner]) & (triggers + TRIGGER <= ends[owner])
        self.begin = np.unique(np.concatenate([starts, triggers[inside]]))
        self.text = np.searchsorted(ends, self.begin, "right")
        m = len(self.begin)
        self.last = np.searchsorted(self.text, self.text, "right") - 1  # of each phrase's text
        closed = np.arange(m) == self.last
        self.stop = np.where(closed, ends[self.text], np.append(self.begin[1:], 0) + TRIGGER)
        self.bounds = np.append(self.begin, ends[-1])
        # A text's last phrase ends in a sign that is less than any byte.
        phrase = 2 * _sorted_ranks(_slices(self.data, self.begin, self.stop - self.begin)) + ~closed
        self.levels = [_dense(phrase) + 1]
        step = 1
        while step < of.window and self.levels[-1].max() < m:
            behind = np.arange(m) + step
            second = np.where(behind <= self.last, self.levels[-1][np.minimum(behind, m - 1)], 0)
            self.levels.append(_dense(self.levels[-1] * (m + 1) + second) + 1)
            step *= 2
        order = np.argsort(self.levels[-1], kind="stable")
        self.place = np.empty(m, np.int64)
        self.place[order] = np.arange(m)
        self.common = self._common(order[:-1], order[1:], of.window)

    def _common(self, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
        """Bytes in which the suffixes at phrases a and b agree; right up to ``most``."""
        x, y, first = a.copy(), b.copy(), a
        for k in range(len(self.levels) - 1, -1, -1):
            for _ in range(2):  # the highest level may fit more than once
                going = (x <= self.last[a]) & (y <= self.last[b])
                going[going] = self.levels[k][x[going]] == self.levels[k][y[going]]
                x = np.where(going, np.minimum(x + (1 << k), self.last[a] + 1), x)
                y = np.where(going, np.minimum(y + (1 << k), self.last[b] + 1), y)
        got = self.bounds[x] - self.bounds[first]
        left = np.flatnonzero((x <= self.last[a]) & (y <= self.last[b]) & (got < most))
        if len(left):
            p, q = x[left], y[left]
            room = np.minimum(np.minimum(self.stop[p] - self.begin[p], self.stop[q] - self.begin[q]), most)
            along = np.arange(int(room.max()))
            top = len(self.data) - 1
            differ = (self.data[np.minimum(self.begin[p][:, None] + along, top)] != self.data[np.minimum(self.begin[q][:, None] + along, top)]) | (along >= room[:, None])
            got[left] += np.where(differ.any(axis=1), differ.argmax(axis=1), room)
        return got

    def least_common(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Bytes in which the suffixes at two places of the order agree: the least between neighbours from low to high."""
        table, step = [self.common], 1
        while 2 * step <= len(self.common):
            table.append(np.minimum(table[-1][:-step], table[-1][step:]))
            step *= 2
        k = np.frexp(high - low)[1] - 1
        out = np.empty(len(low), np.int64)
        for level in np.unique(k).tolist():
            own = k == level
            out[own] = np.minimum(table[level][low[own]], table[level][high[own] - (1 << level)])
        return out


def repeated(texts: list[bytes], of: Shape) -> np.ndarray:
    """Of each window of each text in turn: whether another of them equals it."""
    sizes = np.array([len(t) for t in texts])
    windows = np.maximum(sizes - of.window + 1, 0)
    flags = np.zeros(int(windows.sum()), bool)
    if len(flags) < 2:
        return flags
    parse = Parse(texts, of)
    at = np.repeat(np.cumsum(sizes) - sizes - (np.cumsum(windows) - windows), windows) + np.arange(len(flags))
    phrase = np.searchsorted(parse.begin, at, "right") - 1
    size = np.minimum(parse.stop[phrase] - at, of.window)
    suffix = _sorted_ranks(_slices(parse.data, at, size))
    whole = size == of.window
    behind = np.where(whole, 0, parse.place[np.minimum(phrase + 1, len(parse.begin) - 1)])
    order = np.argsort(suffix * (len(parse.begin) + 1) + behind, kind="stable")  # corpus order
    a, b = order[:-1], order[1:]
    same = suffix[a] == suffix[b]
    ask = np.flatnonzero(same & ~whole[a])
    if len(ask):
        agree = parse.least_common(behind[a[ask]], behind[b[ask]]) + size[a[ask]] - TRIGGER
        same[ask] = agree >= of.window
    flags[a[same]] = True
    flags[b[same]] = True
    return flags


_PACKED = "id binary, packed binary"


def _identity(text: bytes) -> bytes:
    return hashlib.sha256(text).digest()


def _pack(window: int):
    """Texts with a window, each once in a task, with their digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze, seen = zstandard.ZstdCompressor(level=1), set()
        for batch in parts(batches, 0):
            held = {}
            for t in texts_of(batch, 0):
                if t is not None and len(t) >= window and (name := _identity(t)) not in seen:
                    seen.add(name)
                    held[name] = squeeze.compress(t)
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.binary())], names=["id", "packed"])

    return run


_SEEDS = "at bigint, key bigint, id binary, places bigint"


def _seeds(of: Shape):
    """What the windows of each text stand for. Rows meet on ``at``.

    What several texts of a piece stand for is repeated whatever other tasks say: its texts go under
    keys of their own, and under its own key one row, without them, with their number.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in parts(batches, 0):
            fresh = {}
            for t in texts_of(batch, 0):
                if t is not None and len(t) >= of.window and (name := _identity(t)) not in seen:
                    seen.add(name)
                    fresh[name] = t
            ids, texts = list(fresh), list(fresh.values())
            for first, held in wordhash.pieces(texts):
                found = stretches(held, Hashes(b"".join(held)), of)
                order = np.lexsort((found.text, found.key))
                key, text = found.key[order], found.text[order]
                heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
                places = np.repeat(np.diff(np.append(heads, len(key))), np.diff(np.append(heads, len(key))))
                once = np.concatenate([[True], (key[1:] != key[:-1]) | (text[1:] != text[:-1])])
                many = places > 1
                own = wordhash.mix(key.view(np.uint64) + wordhash.mix(text.astype(np.uint64) + np.uint64(first + 1))).view(np.int64)
                names = pa.array(ids[first : first + len(held)], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(np.where(many, own, key)[once]), pa.array(key[once]), names.take(pa.array(text[once])), pa.array(np.where(many, 2, 1)[once])], names=["at", "key", "id", "places"])
                lead = heads[many[heads]]
                yield pa.RecordBatch.from_arrays([pa.array(key[lead]), pa.array(key[lead]), pa.nulls(len(lead), pa.binary()), pa.array(places[lead])], names=["at", "key", "id", "places"])

    return run


_STRETCHES = "key bigint, more bigint, text binary, id binary, start int, edges int"


def _sent(of: Shape):
    """Stretches of windows whose phrase is repeated; what a task knows to be repeated has no text and a key of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor()
        known: dict[bytes, tuple | None] = {}
        rows: list[tuple] = []

        def add(name: bytes, key: int, more: int | None, text: bytes | None, place: tuple) -> None:
            before = known.get(name, 0)
            if before == 0:
                if len(known) >= REMEMBERED:
                    known.clear()
                known[name] = place
                rows.append((key, more, text, *place))
                return
            for p in (before, place) if before else (place,):
                rows.append((int.from_bytes(hashlib.blake2b(p[0] + p[1].to_bytes(8, "little"), digest_size=8).digest(), "little", signed=True), None, None, *p))
            known[name] = None

        for batch in parts(batches, 1, PART_BYTES // 4):
            ids, seeds, hot = batch.column("id").to_pylist(), batch.column("seeds"), batch.column("hot")
            texts = [open_.decompress(p) for p in batch.column("packed").to_pylist()]
            for first, held in wordhash.pieces(texts):
                joined = b"".join(held)
                hashed = Hashes(joined)
                found = stretches(held, hashed, of)
                base = np.concatenate([[0], np.cumsum([len(t) for t in held])])
                marks = np.searchsorted(found.text, np.arange(len(held) + 1))
                other = None
                for i in range(len(held)):
                    part = slice(marks[i], marks[i + 1])
                    own = np.flatnonzero(np.isin(found.key[part], seeds[first + i].values.to_numpy())) + marks[i]
                    warm = np.isin(found.key[own], hot[first + i].values.to_numpy())
                    for k, s, e, w in zip(found.key[own].tolist(), found.start[own].tolist(), found.edges[own].tolist(), warm.tolist(), strict=True):
                        at = s - int(base[i])
                        if not w:
                            text = joined[s : s + e + of.window - 1]
                            add(hashlib.blake2b(text, digest_size=16).digest(), k, None, text, (ids[first + i], at, e))
                            continue
                        other = other or Hashes(joined, 1)
                        each = np.arange(s, s + e)
                        for j, (a, b) in enumerate(zip(hashed.of(each, of.window).view(np.int64).tolist(), other.of(each, of.window).view(np.int64).tolist(), strict=True)):
                            add(a.to_bytes(8, "little", signed=True) + b.to_bytes(8, "little", signed=True), a, b, None, (ids[first + i], at + j, 1))
                yield _stretch_rows(rows)
                rows.clear()

    return run


_SENT_TYPES = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.int32())


def _stretch_rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(_SENT_TYPES)], names=["key", "more", "text", "id", "start", "edges"])


_FOUND = "id binary, start int, edges int"


def _judge(of: Shape):
    """(id, start, edges) of repeated windows; rows come sorted by key, and those of a key are judged together."""

    def judged(rows: list[tuple]) -> Iterator[tuple]:
        texts = [r for r in rows if r[2] is not None]
        if len(texts) > 1 or texts and texts[0][5] > 1:
            flags = repeated([r[2] for r in texts], of)
            at = 0
            for _, _, _, name, start, edges in texts:
                edge = np.flatnonzero(np.diff(np.concatenate([[0], flags[at : at + edges].view(np.int8), [0]])))
                for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                    yield name, start + a, b - a
                at += edges
        alone: dict[tuple, list] = {}
        for r in rows:
            if r[2] is None and r[1] is not None:
                alone.setdefault(r[:2], []).append(r[3:])
        for same in alone.values():
            if len(same) > 1:
                yield from same
        yield from (r[3:] for r in rows if r[1] is None and r[2] is None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in parts(batches, 2, ORDERED // 2):
            for r in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if size > ORDERED and r[0] != held[-1][0]:
                    yield _found(list(judged(held)))
                    held, size = [], 0
                held.append(r)
                size += len(r[2] or b"") + 64
        yield _found(list(judged(held)))

    return run


def _found(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.binary(), pa.int32(), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["id", "start", "edges"])


_CUT = "id binary, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary"


def _cut(of: Shape, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor()
        for batch in parts(batches, 1, PART_BYTES // 4):
            removed, spans, sha, kept = [], [], [], []
            for packed, starts, edges in zip(batch.column("packed").to_pylist(), batch.column("starts"), batch.column("edges"), strict=True):
                text = np.frombuffer(open_.decompress(packed), np.uint8)
                begin, n = starts.values.to_numpy(), edges.values.to_numpy()
                depth = np.zeros(len(text) + 1, np.int32)
                np.add.at(depth, begin, 1)
                np.add.at(depth, begin + n + of.window - 1, -1)
                gone = np.cumsum(depth[:-1]) > 0
                left = text[~gone].tobytes()
                removed.append(int(gone.sum()))
                spans.append(int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()))
                sha.append(hashlib.sha256(left).hexdigest())
                kept.append(left if with_text else None)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha, pa.string()), pa.array(kept, pa.binary())], names=["id", "n_removed", "n_spans", "kept_sha256", "kept"])

    return run


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in parts(batches, 1):
        texts = [t or b"" for t in texts_of(batch, 1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([_identity(t) for t in texts], pa.binary())], names=["doc_id", "n_bytes", "id"])


def repeats_of(held: DataFrame, of: Shape) -> DataFrame:
    """(id, start, edges): windows that occur elsewhere, of texts with what they stand for (``seeds``, ``hot``)."""
    sent = held.select("id", "packed", "seeds", "hot").mapInArrow(_sent(of), _STRETCHES)
    return sent.repartition("key").sortWithinPartitions("key").mapInArrow(_judge(of), _FOUND)


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, hot: int = HOT, with_text: bool = True) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) of each row; ``kept`` is null where nothing was removed, or without ``with_text``."""
    of = shape(window)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    seeds = rows.select("text").mapInArrow(_seeds(of), _SEEDS)
    # A text that several tasks have seen counts once; numbers without a text add up.
    met = seeds.groupBy("at", "key", "id").agg(F.max("places").alias("most"), F.sum("places").alias("total"))
    counted = met.withColumn("places", F.when(F.col("id").isNull(), F.col("total")).otherwise(F.col("most"))).withColumn("all", F.sum("places").over(Window.partitionBy("at")))
    seen = stored(counted.where("`all` > 1").select("at", "key", "id", "all"), "seeds")
    warm = stored(seen.where((F.col("at") == F.col("key")) & (F.col("all") > hot)).select("key", F.lit(True).alias("warm")).distinct(), "warm")
    of_text = lookup(seen.where("id is not null"), warm, ["key"], F.col("id")).groupBy("id").agg(F.collect_set("key").alias("seeds"), F.collect_set(F.when(F.col("warm"), F.col("key"))).alias("hot"))
    packed = rows.select("text").mapInArrow(_pack(window), _PACKED)
    held = stored(packed.join(of_text, "id").dropDuplicates(["id"]), "texts")
    found = repeats_of(held, of).groupBy("id").agg(F.collect_list("start").alias("starts"), F.collect_list("edges").alias("edges"))
    cut = held.select("id", "packed").join(found, "id").select("id", "packed", "starts", "edges").mapInArrow(_cut(of, with_text), _CUT)
    named = rows.mapInArrow(_named, "doc_id bigint, n_bytes bigint, id binary")
    copies = named.where(F.col("n_bytes") >= window).groupBy("id").agg(F.count("*").alias("copies")).where("copies > 1")
    facts = stored(cut.join(copies, "id", "full"), "cut")
    out = named.join(facts, "id", "left")
    copied = F.col("copies").isNotNull()  # all of it stands elsewhere
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select(
        "doc_id",
        "n_bytes",
        F.when(copied, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("bigint").alias("n_removed"),
        F.when(copied, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("bigint").alias("n_spans"),
        F.when(copied, nothing).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("id")))).alias("kept_sha256"),
        (F.when(copied, F.lit(b"")).otherwise(F.col("kept")) if with_text else F.lit(None).cast("binary")).alias("kept"),
    )
