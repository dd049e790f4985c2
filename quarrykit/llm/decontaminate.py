"""Benchmark decontamination with one Aho-Corasick automaton.

The benchmark's word windows become patterns of one automaton, whose alphabet is the benchmark's
own words: each has two letters of its own, the first and the second from different alphabets, so
that nothing matches between words. Every document is normalised and scanned once, and hits are
mapped back to offsets of the original text.

Defined results: a null or empty text has no words and is never contaminated; an item without
id or words is ignored; an item repeated under one id counts once; the same window in several
items counts for each of them; repeated document rows are judged one by one; other columns
of either table are not read.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrykit.llm.common import free_name, lookup, parts, texts_of
from quarrykit.session import stored

WINDOW = 13
#: UTF-8 bytes of benchmark text that one automaton holds: 1 MB of words makes one of about 180
#: MB in each worker. A larger benchmark is scanned for in blocks of this size, each broadcast by
#: itself; no window is dropped.
BLOCK_BYTES = 1 << 20

_FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_FIRST_LETTER = 0x100
_OTHER = "\x01\x01"  # any word that the benchmark does not have
_AUTOMATA: dict = {}  # of this worker: the last block's automaton

SCHEMA = (
    "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean,"
    " item_ids array<string>, spans array<struct<start:bigint,end:bigint>>"
)


def words_of(text: bytes | str | None) -> list[bytes]:
    """Words of a text in UTF-8; bytes of other than word characters separate them."""
    raw = text.encode("utf-8", "replace") if isinstance(text, str) else text
    return raw.translate(_FOLD).split() if raw else []


def windows(items: list[tuple[int, str | None]], window: int = WINDOW) -> tuple[dict[bytes, str], dict[str, list[str]]]:
    """The two letters of each word, and the item ids of each pattern."""
    split = [(str(item), words_of(text)) for item, text in items if item is not None]
    vocabulary = sorted({w for _, words in split for w in words})
    side = max(1, int(np.ceil(np.sqrt(len(vocabulary)))))
    letters = {w: chr(_FIRST_LETTER + k // side) + chr(_FIRST_LETTER + side + k % side) for k, w in enumerate(vocabulary)}
    found: dict[str, set[str]] = {}
    for item, words in split:
        line = "".join([letters[w] for w in words])
        for i in range(max(1, len(words) - window + 1) if words else 0):
            found.setdefault(line[2 * i : 2 * (i + window)], set()).add(item)
    return letters, {k: sorted(v) for k, v in found.items()}


def _automaton(block) -> tuple[dict[bytes, str], object | None]:
    """The letters and the automaton of a broadcast block, built once a worker."""
    import ahocorasick

    key, letters, patterns = block.value
    if key not in _AUTOMATA:
        made = None
        if patterns:
            made = ahocorasick.Automaton()
            for pattern, items in patterns.items():
                made.add_word(pattern, (len(pattern) // 2, items))
            made.make_automaton()
        _AUTOMATA.clear()
        _AUTOMATA[key] = (letters, made)
    return _AUTOMATA[key]


def hits(words: list[bytes], letters: dict[bytes, str], automaton) -> tuple[set[int], set[str]]:
    """Indexes of the words inside any occurrence of a window, and the items these windows are of."""
    hit: set[int] = set()
    items: set[str] = set()
    if words and automaton is not None:
        for end, (size, owners) in automaton.iter("".join([letters.get(w, _OTHER) for w in words])):
            last = end // 2 + 1
            hit.update(range(last - size, last))
            items.update(owners)
    return hit, items


def _spans(text: str, hit: list[int]) -> list[dict]:
    """Runs of hit words as offsets of the original text."""
    at = [m.span() for m in _WORD.finditer(text)]
    out: list[dict] = []
    for k, i in enumerate(hit):
        if k and hit[k - 1] == i - 1:
            out[-1]["end"] = at[i][1]
        else:
            out.append({"start": at[i][0], "end": at[i][1]})
    return out


def _hit_texts(block):
    """The digest of each text with hits, the hit words and the items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, automaton = _automaton(block)
        for batch in parts(batches, 0):
            rows = []
            for text in texts_of(batch, 0):
                hit, items = hits(words_of(text), letters, automaton)
                if hit:
                    rows.append((hashlib.sha256(text).hexdigest(), np.array(sorted(hit), np.int32).tobytes(), "\0".join(sorted(items))))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.binary(), pa.string()))], names=["digest", "hit", "items"])

    return run


def _hits_of(batch: pa.RecordBatch, block, split: list[list[bytes]], found_at: int) -> list[tuple[list[int], list[str]]]:
    """Hits and items of each row: by scanning for the only block, or as the columns from ``found_at`` on have them."""
    if block is not None:
        automaton = _automaton(block)
        return [tuple(map(sorted, hits(words, *automaton))) for words in split]
    out = []
    for hit, items in zip(batch.column(found_at).to_pylist(), batch.column(found_at + 1).to_pylist(), strict=True):
        each = [np.frombuffer(h, np.int32) for h in hit or []]
        out.append((np.unique(np.concatenate(each)).tolist() if each else [], sorted({i for x in items or [] for i in x.split("\0")})))
    return out


def _report(block, share: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, 1):
            texts = texts_of(batch, 1)
            split = [words_of(t) for t in texts]
            found = _hits_of(batch, block, split, 2)
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column(0),
                    "n_words": pa.array([len(w) for w in split], pa.int64()),
                    "n_hit": pa.array([len(h) for h, _ in found], pa.int64()),
                    "n_items": pa.array([len(x) for _, x in found], pa.int64()),
                    "items_sha256": pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for _, x in found], pa.string()),
                    "contaminated": pa.array([bool(h) and share * len(h) >= len(w) for (h, _), w in zip(found, split, strict=True)], pa.bool_()),
                    "item_ids": pa.array([x for _, x in found], pa.list_(pa.string())),
                    "spans": pa.array([_spans(t.decode("utf-8", "replace"), h) if h else [] for t, (h, _) in zip(texts, found, strict=True)], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                }
            )

    return run


def _keep_clean(block, text_at: int, share: int, columns: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, text_at):
            split = [words_of(t) for t in texts_of(batch, text_at)]
            found = _hits_of(batch, block, split, columns)
            keep = pa.array([not (h and share * len(h) >= len(w)) for (h, _), w in zip(found, split, strict=True)], pa.bool_())
            yield batch.select(list(range(columns))).filter(keep)

    return run


def benchmark_blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> Iterator:
    """(number of blocks, broadcast block of windows), one after the other. The benchmark's size is measured first and sets their number."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col(id_col).alias("item"), F.col(text_col).cast("string").alias("text")).where("item is not null and text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // block_bytes))
    for k in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k)
        yield n, spark.sparkContext.broadcast((uuid.uuid4().hex, *windows([(r[0], r[1]) for r in part.toLocalIterator()], window)))


def _with_hits(rows: DataFrame, text_col: str, blocks: Iterator) -> tuple[DataFrame, object | None]:
    """``rows`` and the only block; or, of several, rows with the hits that each block has in their text, and None.

    Of each block only the hits are kept, by the digest of the text they are in, so the corpus is
    read once a block and never written.
    """
    text = F.col(text_col).cast("string")
    every = None
    for n, block in blocks:
        if n == 1:
            return rows, block
        found = rows.select(text.alias("text")).mapInArrow(_hit_texts(block), "digest string, hit binary, items string").dropDuplicates(["digest"])
        every = stored(found, "hits") if every is None else every.unionByName(stored(found, "hits"))
    digest, hit, items = free_name(rows, "_digest", "_hit", "_items")
    merged = every.groupBy(F.col("digest").alias(digest)).agg(F.collect_list("hit").alias(hit), F.collect_list("items").alias(items))  # a row a block
    return lookup(rows.withColumn(digest, F.sha2(text, 256)), stored(merged, "hits"), [digest], F.monotonically_increasing_id()).select(*rows.columns, hit, items), None


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    share: int = 20,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """One row a document row: words, hit words, items hit, spans in the original, verdict.

    Contaminated: ``n_hit > 0`` and ``share * n_hit >= n_words``. A narrow map, no shuffle, for a
    benchmark of one block; of several, the hits of each are looked up by text.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows, block = _with_hits(rows, "text", benchmark_blocks(benchmark, item_col, item_text_col, window, block_bytes))
    return rows.mapInArrow(_report(block, share), SCHEMA)


def clean_rows(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", window: int = WINDOW, share: int = 20, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, all columns as they are."""
    rows, block = _with_hits(docs, text_col, benchmark_blocks(benchmark, window=window, block_bytes=block_bytes))
    return rows.mapInArrow(_keep_clean(block, docs.columns.index(text_col), share, len(docs.columns)), docs.schema)
