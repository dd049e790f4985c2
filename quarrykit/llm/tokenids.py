"""Token ids in files of directly addressable codes.

An id is split into chunks of 8 bits. Level 0 holds every id's lowest chunk; a bitmap says which
ids go on, and their next chunks stand on level 1, and so on. A rank directory over each bitmap
turns a place on one level into its place on the next, so any id is read without decoding others.

File: magic, numbers of documents, tokens and levels, chunks of each level, document ids and
whether they are null, first token of each document, then for each level its chunks, bitmap and
rank directory; little-endian, sections padded to 8 bytes.

Defined results: a null text counts as empty and has the end id only; documents are in ascending
doc_id (null first), ties by text; repeated rows are stored one by one; an empty table gives no
files; other columns are not read.
"""

from __future__ import annotations

import itertools
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrykit.llm import files
from quarrykit.session import shared_folder, stored

MAGIC = b"QKDAC001"
CHUNK_BITS = 8
RANK_BITS = 512  # bits that one entry of the rank directory covers
ROLL_TOKENS = 3_000_000  # a file is closed beyond this many tokens
MEMO = 600_000  # pieces whose ids a worker remembers (about 200 bytes each); the most used half outlives an overflow
TOGETHER = 256  # new pieces that go to the library as one text
MAX_TASKS = 10_000  # that files are read in
CHARS = 4 << 20  # bytes of text that are encoded at once

#: A space and then what is white space in no script, at both ends.
_SEPARATE = re.compile(rb" [\x21-\x7e\xc3-\xe0\xe4-\xf4](?:.*(?:[\x21-\x7e]|[\xc3-\xdf][\x80-\xbf]|[\xe0\xe4-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}))?\Z", re.DOTALL)
#: A run of letters of ASCII and Latin-1.
_BARE = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+\Z")

#: Kinds of bytes: ASCII letters; other ASCII but the space; that which is visible and no apostrophe; white space but the space.
_LETTER, _OTHER, _MARK, _WHITE = 1, 2, 4, 8
_KINDS = bytes(_LETTER if chr(b).isalpha() else _OTHER | _MARK * (0x20 < b < 0x7F and b != 0x27) | _WHITE * (0x09 <= b <= 0x0D) if b != 0x20 else 0 for b in range(128)) + bytes(128)


def _pad(raw: bytes) -> bytes:
    return raw + b"\0" * (-len(raw) % 8)


def levels(ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(chunks, whether more follow) of each level."""
    out, rest = [], ids
    while True:
        more = rest >= 1 << CHUNK_BITS
        out.append(((rest & 255).astype(np.uint8), more))
        rest = rest[more] >> CHUNK_BITS
        if not len(rest):
            return out


def encode_file(doc_ids: list[int | None], counts: list[int], ids: np.ndarray) -> list[bytes]:
    found = levels(ids)
    parts = [MAGIC, struct.pack("<QQQ", len(doc_ids), len(ids), len(found)), np.array([len(c) for c, _ in found], "<u8").tobytes()]
    parts += [np.array([d or 0 for d in doc_ids], "<i8").tobytes(), _pad(np.array([d is None for d in doc_ids], np.uint8).tobytes()), np.concatenate([[0], np.cumsum(counts)]).astype("<u8").tobytes()]
    for chunks, more in found:
        bits = np.packbits(more, bitorder="little")
        bits = np.pad(bits, (0, -len(bits) % (RANK_BITS // 8)))
        ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(bits.reshape(-1, RANK_BITS // 8)).sum(axis=1, dtype=np.uint64))])
        parts += [_pad(chunks.tobytes()), bits.tobytes(), ranks.astype("<u8").tobytes()]
    return parts


class TokenFile:
    """Random access to a file's tokens and documents; reads only the sections that it needs."""

    def __init__(self, source: files.Source):
        self._source = source
        if source.read(0, 8) != MAGIC:
            raise ValueError("not a token file")
        self.n_docs, self.n_tokens, n_levels = struct.unpack("<QQQ", source.read(8, 24))
        sizes = np.frombuffer(source.read(32, 8 * n_levels), "<u8").tolist()
        at = 32 + 8 * n_levels
        ids = np.frombuffer(source.read(at, 8 * self.n_docs), "<i8")
        at += 8 * self.n_docs
        nulls = source.read(at, self.n_docs)
        self.doc_ids = [None if z else d for d, z in zip(ids.tolist(), nulls, strict=True)]
        at += self.n_docs + -self.n_docs % 8
        self.offsets = np.frombuffer(source.read(at, 8 * (self.n_docs + 1)), "<u8").astype(np.int64)
        at += 8 * (self.n_docs + 1)
        self._levels = []
        for size in sizes:
            blocks = -(-size // RANK_BITS)
            bits = at + size + -size % 8
            self._levels.append((at, bits, bits + blocks * RANK_BITS // 8))
            at = bits + blocks * RANK_BITS // 8 + 8 * (blocks + 1)

    def _rank(self, level: int, i: int) -> int:
        """Continuation bits before place i: a directory entry and the bits of one block."""
        _, bits, ranks = self._levels[level]
        block = i // RANK_BITS
        (before,) = struct.unpack("<Q", self._source.read(ranks + 8 * block, 8))
        part = int.from_bytes(self._source.read(bits + block * RANK_BITS // 8, RANK_BITS // 8), "little")
        return before + (part & ((1 << (i % RANK_BITS)) - 1)).bit_count()

    def token(self, i: int) -> int:
        """Token i of the file."""
        if not 0 <= i < self.n_tokens:
            raise IndexError(i)
        value = 0
        for level, (chunks, bits, _) in enumerate(self._levels):
            value |= self._source.read(chunks + i, 1)[0] << (CHUNK_BITS * level)
            if not self._source.read(bits + i // 8, 1)[0] >> (i % 8) & 1:
                break
            i = self._rank(level, i)
        return value

    def tokens(self, start: int, end: int) -> np.ndarray:
        """Tokens start to end, level by level: each level's part is one run of its chunks."""
        out, where = np.zeros(end - start, np.uint32), np.arange(end - start)
        for level, (chunks, bits, _) in enumerate(self._levels):
            if end <= start:
                break
            out[where] |= np.frombuffer(self._source.read(chunks + start, end - start), np.uint8).astype(np.uint32) << np.uint32(CHUNK_BITS * level)
            raw = np.frombuffer(self._source.read(bits + start // 8, end // 8 - start // 8 + 1), np.uint8)
            more = np.unpackbits(raw, bitorder="little")[start % 8 : start % 8 + end - start].astype(bool)
            where = where[more]
            start = self._rank(level, start)
            end = start + len(where)
        return out


def _byte_lengths(tokenizer, shape: dict) -> np.ndarray | None:
    """Bytes of text that each id stands for, if the vocabulary is one of bytes written as letters."""
    bytes_of = {t["content"]: len(t["content"].encode()) for t in shape.get("added_tokens", [])}
    out = np.zeros(tokenizer.get_vocab_size(), np.int64)
    for token, i in tokenizer.get_vocab().items():
        if i >= len(out):
            return None
        out[i] = bytes_of.get(token, len(token))
    return out


class Encoder:
    """A public tokenizer over whole texts.

    Byte-level pre-tokenizers never join what stands before a single space with what stands
    behind it, nor a word with the punctuation and line ends around it, so such texts are cut
    there, but never inside an added token. Pieces are told apart by their bytes (an Arrow
    dictionary of a chunk's pieces, and a dictionary of those met before), and only new ones are
    given to the library, many behind each other in one text, whose ids are dealt back by the
    bytes that they stand for; the ids are those of the whole text. Any other tokenizer is given
    the whole texts.
    """

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_str(spec)
        shape = json.loads(spec)
        before = shape.get("pre_tokenizer") or {}
        self._pieces = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not shape.get("normalizer") and not any(" " in t["content"] or t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in shape.get("added_tokens", []))
        self._added = [t["content"].encode() for t in shape.get("added_tokens", [])]
        self._lengths = _byte_lengths(self._tokenizer, shape) if self._pieces else None
        self._known: dict[bytes, int] = {}  # number of each piece met
        self._uses = np.zeros(0, np.int32)  # chunks that it was met in
        self._bounds = np.zeros(1, np.int64)  # where its ids begin, and the end
        self._ids = np.zeros(0, np.uint32)

    def _forget(self, keep: int) -> None:
        """Forget all but the ``keep`` pieces met in most chunks."""
        sizes, kept = np.diff(self._bounds), np.zeros(len(self._uses), bool)
        kept[np.argsort(self._uses, kind="stable")[max(0, len(kept) - keep) :]] = True
        pieces = list(itertools.compress(self._known, kept))
        self._known = {}  # its memory goes before the next is built
        self._known = dict(zip(pieces, range(len(pieces)), strict=True))
        self._ids = self._ids[np.repeat(kept, sizes)]
        self._bounds = np.concatenate([[0], np.cumsum(sizes[kept])])
        self._uses = self._uses[kept] // 2

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        out = []
        for i in range(0, len(texts), 2048):
            out += [np.array(e.ids, np.uint32) for e in self._tokenizer.encode_batch_fast(texts[i : i + 2048], add_special_tokens=False)]
        return out

    def _apart(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces, and how many each has."""
        ids = self._encode([p.decode("utf-8", "replace") for p in pieces])
        return np.concatenate([np.zeros(0, np.uint32), *ids]), np.array([len(x) for x in ids], np.int64)

    def _together(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The same for pieces that may stand behind each other: clean spaces begin them and no white space ends them, or words and line ends take turns."""
        if self._lengths is None:
            return self._apart(pieces)
        ids = np.concatenate([np.zeros(0, np.uint32), *self._encode([b"".join(pieces[i : i + TOGETHER]).decode("utf-8") for i in range(0, len(pieces), TOGETHER)])])
        ends, reached = np.cumsum([len(p) for p in pieces]), np.cumsum(self._lengths[ids])
        last = np.searchsorted(reached, ends)  # the last id of each piece
        if len(ids) and len(pieces) and last[-1] == len(ids) - 1 and np.array_equal(reached[last], ends):
            return ids, np.diff(last, prepend=-1)
        return self._apart(pieces)  # an id goes over a cut

    def _learn(self, pieces: list[bytes]) -> None:
        clean, bare, rest = [], [], []
        for p in pieces:
            (clean if _SEPARATE.match(p) else bare if _BARE.match(p) else rest).append(p)
        ids, sizes = self._together([x for p in bare for x in (p, b"\n")])
        words = np.arange(len(sizes)) % 2 == 0
        first, found = len(self._known), [self._together(clean), (ids[np.repeat(words, sizes)], sizes[words]), self._apart(rest)]
        self._known.update(zip(clean + bare + rest, range(first, first + len(pieces)), strict=True))
        self._uses = np.concatenate([self._uses, np.zeros(len(pieces), np.int32)])
        sizes = np.concatenate([n for _, n in found])
        self._bounds = np.concatenate([self._bounds, self._bounds[-1] + np.cumsum(sizes)])
        self._ids = np.concatenate([self._ids, *(i for i, _ in found)])

    def _look_up(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Number of each piece, -1 where it is not known, and the places of those."""
        numbers = np.fromiter(map(self._known.get, pieces, itertools.repeat(-1)), np.int64, len(pieces))
        return numbers, np.flatnonzero(numbers < 0)

    def _numbers(self, pieces: list[bytes]) -> np.ndarray:
        """Numbers of different pieces; new ones are learned."""
        numbers, missing = self._look_up(pieces)
        if len(missing) and len(self._known) + len(missing) > MEMO:
            self._forget(max(0, min(MEMO // 2, MEMO - len(pieces))))
            numbers, missing = self._look_up(pieces)
        if len(missing):
            new = [pieces[i] for i in missing.tolist()]
            self._learn(new)
            numbers[missing] = [self._known[p] for p in new]
        self._uses[numbers] += 1
        return numbers

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if not self._pieces:
            return self._encode(texts)
        held = [t.encode("utf-8", "replace") for t in texts]
        ends = np.cumsum([len(h) for h in held])
        joined = b"".join(held)
        if not joined:
            return [np.zeros(0, np.uint32) for _ in texts]
        begins = ends - [len(h) for h in held]
        cut = _boundaries(joined)
        for token in self._added:
            at = joined.find(token) if len(token) > 1 else -1
            while at >= 0:
                cut[at + 1 : at + len(token)] = False
                at = joined.find(token, at + 1)
        cut[begins[begins < ends]] = True
        cuts = np.flatnonzero(cut)
        data = [None, pa.py_buffer(np.append(cuts, len(joined))), pa.py_buffer(joined)]
        found = pa.Array.from_buffers(pa.large_binary(), len(cuts), data).dictionary_encode()
        numbers = self._numbers(found.dictionary.to_numpy(zero_copy_only=False).tolist())
        at = numbers[found.indices.to_numpy()]
        sizes = self._bounds[at + 1] - self._bounds[at]
        total = np.concatenate([[0], np.cumsum(sizes)])
        out = self._ids[np.repeat(self._bounds[at] - total[:-1], sizes) + np.arange(total[-1])]
        bounds = total[np.searchsorted(cuts, np.append(begins, len(joined)))]
        return [out[s:e] for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


_ENCODERS: dict[str, Encoder] = {}  # of this worker: the last tokenizer, with what it remembers from earlier tasks


def _encoder(spec: str) -> Encoder:
    if spec not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[spec] = Encoder(spec)
    return _ENCODERS[spec]


def _clean_spaces(raw: np.ndarray) -> np.ndarray:
    """Whether each byte is a single space with a character that is no white space, in any script, on both sides."""
    padded = np.concatenate([np.full(3, 0x20, np.uint8), raw, np.full(1, 0x20, np.uint8)])
    here, before, before2, before3, behind = padded[3:-1], padded[2:-2], padded[1:-3], padded[:-4], padded[4:]
    white_before = (before <= 0x20) | (before == 0x7F) | ((before >= 0x80) & ((before2 == 0xC2) | ((before3 >= 0xE1) & (before3 <= 0xE3))))
    white_behind = (behind <= 0x20) | (behind == 0x7F) | (behind == 0xC2) | ((behind >= 0xE1) & (behind <= 0xE3))
    return (here == 0x20) & ~white_before & ~white_behind


def _boundaries(joined: bytes) -> np.ndarray:
    """Whether a byte-level pre-tokenizer begins anew at each byte, as far as the bytes beside it tell.

    It does at clean spaces, between a letter and other ASCII, and before a letter behind other
    ASCII: not behind an apostrophe (contractions), and behind white space only where that is one
    character. Letters are those of ASCII and Latin-1; of others nothing is said.
    """
    raw, kinds = np.frombuffer(joined, np.uint8), np.frombuffer(joined.translate(_KINDS), np.uint8)
    begin = (kinds & _LETTER).view(bool)
    end = begin.copy()
    wide = np.flatnonzero(raw[:-1] == 0xC3)
    wide = wide[(raw[wide + 1] != 0x97) & (raw[wide + 1] != 0xB7)]
    begin[wide] = end[wide + 1] = True
    before = (kinds & _MARK) != 0  # what a letter stands apart from
    before[1:] |= ((kinds[1:] & _WHITE) != 0) & (end | before)[:-1]
    cut = _clean_spaces(raw)
    cut[1:] |= end[:-1] & ((kinds[1:] & _OTHER) != 0) | before[:-1] & begin[1:]
    return cut


def _chunks(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Runs of texts of about CHARS bytes."""
    first, size = 0, 0
    for i, n in enumerate(pc.binary_length(texts).to_pylist()):
        if i > first and size + n > CHARS:
            yield first, i
            first, size = i, 0
        size += n
    if len(texts):
        yield first, len(texts)


def write_tokens(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, folder: str | None = None) -> DataFrame:
    """Encode all documents and write token files in ascending doc_id; returns their manifest.

    One range shuffle on (doc_id, text's hash) puts the documents in order; the tokenizer's
    definition (a few megabytes) is broadcast. ``first`` is the number of tokens in all files before.
    """
    spark = docs.sparkSession
    folder = folder or f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    ordered = rows.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text").select("doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(spec.value)
        task, seq = TaskContext.get().partitionId(), 0
        ids, counts, parts = [], [], []

        def flush() -> pa.RecordBatch:
            name = files.put(folder, f"part-{task:06d}-{seq:06d}.dac", encode_file(ids, counts, np.concatenate(parts)))
            return pa.RecordBatch.from_pydict({"file": [name], "task": pa.array([task], pa.int32()), "seq": pa.array([seq], pa.int32()), "docs": pa.array([len(ids)], pa.int64()), "tokens": pa.array([sum(counts)], pa.int64())})

        end = np.array([end_id], np.uint32)
        total = 0
        for batch in batches:
            for first, last in _chunks(batch.column(1)):
                texts, docs = batch.column(1)[first:last].to_pylist(), batch.column(0)[first:last].to_pylist()
                for doc, got in zip(docs, encoder.encode(texts), strict=True):
                    ids.append(doc)
                    counts.append(len(got) + 1)
                    parts += [got, end]
                    total += len(got) + 1
                if total >= ROLL_TOKENS:
                    yield flush()
                    ids, counts, parts, total, seq = [], [], [], 0, seq + 1
        if ids:
            yield flush()

    written = stored(ordered.mapInArrow(write, "file string, task int, seq int, docs bigint, tokens bigint"), "token-manifest")
    # Running totals: of a task's files in its own partition, of whole tasks (one row each) in one.
    tasks = written.groupBy("task").agg(F.sum("tokens").alias("all"))
    before = tasks.withColumn("before", F.coalesce(F.sum("all").over(Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("all")
    within = F.coalesce(F.sum("tokens").over(Window.partitionBy("task").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return written.withColumn("within", within).join(before, "task").withColumn("first", F.col("before") + F.col("within")).drop("before", "within")


def read_documents(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                source = files.Source(file, block=1 << 16)
                held = TokenFile(source)
                crc, k = [], 0
                while k < held.n_docs:  # documents of about a million tokens at a time
                    e = max(k + 1, int(np.searchsorted(held.offsets, held.offsets[k] + 1_000_000, "right")) - 1)
                    start = int(held.offsets[k])
                    ids = held.tokens(start, int(held.offsets[e])).astype("<u4")
                    crc += [zlib.crc32(ids[int(held.offsets[j]) - start : int(held.offsets[j + 1]) - start].tobytes()) for j in range(k, e)]
                    k = e
                source.close()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(held.doc_ids, pa.int64()), pa.array(held.offsets[:-1] + first), pa.array(np.diff(held.offsets)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"]
                )

    return manifest.select("file", "first").repartition(min(MAX_TASKS, max(1, manifest.count())), "file").mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
