"""Near-duplicate documents by min-max hashing.

Each permutation of a document's shingle set gives two values, its least and its greatest, so
half as many hashes are evaluated for a signature of a given length. Bands of ROWS values are
bucket keys. Texts with equal sets are one class from the start; inside each bucket classes are
compared with the bucket's most central class, and only members of different components that were
never compared, and that share enough with others to reach the threshold at all, are paired beyond
that. Every link is confirmed on the full sets, shingle by shingle on the words themselves; texts
count as of equal sets by 128 bits of each shingle.

With 48 bands of 6 values a pair at exactly 0.8 is missed with a probability of 5e-7.

Defined results: null and empty texts, and texts without words, have no shingles and link with
nothing; a text of fewer words than a shingle is one shingle; repeated rows of an id give one
output row each, and texts under one id count as linked; a row without an id links with
nothing, has no component and is kept; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrykit.llm import wordhash
from quarrykit.llm.common import PART_BYTES, parts, texts_of
from quarrykit.llm.components import components
from quarrykit.session import stored

BANDS, ROWS = 48, 6
_PERMUTATIONS = BANDS * ROWS // 2
_CHUNK = 4096
PARTS = 64


def _parameters() -> tuple[np.ndarray, np.ndarray]:
    seeds = wordhash.mix(np.arange(1, 2 * _PERMUTATIONS + 1, dtype=np.uint64))
    return (seeds[:_PERMUTATIONS] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (seeds[_PERMUTATIONS:] >> np.uint64(32)).astype(np.uint32)


_A, _B = _parameters()


def shingle_sets(texts: list[bytes | None], size: int) -> Iterator[tuple[np.ndarray, bytes]]:
    """Each text's set of shingle hashes, sorted, and a digest of the set (128 bits a shingle go in)."""
    for _, held in wordhash.pieces(texts):
        found = wordhash.words(held, lower=True)
        lanes = [wordhash.hashes(found, lane) for lane in (0, 1)]
        lanes[0] = wordhash.mix(lanes[0]) + lanes[1]
        grams = [wordhash.windows(lane, size) for lane in lanes]
        for s, e in zip(found.begins[:-1], found.begins[1:], strict=True):
            if e - s >= size:
                one, other = (g[s : e - size + 1] for g in grams)
            else:
                one, other = (wordhash.windows(lane[s:e], int(e - s), seed=1) if e > s else lane[:0] for lane in lanes)
            one, first = np.unique(one, return_index=True)
            yield one, hashlib.blake2b(one.tobytes() + other[first].tobytes(), digest_size=16).digest()


def exact_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """Each text's set of shingles as numbers that are equal, among these texts, exactly where the words are."""
    found = wordhash.words(texts, lower=True)
    codes = wordhash.codes(found)
    grams = wordhash.numbered(codes, size)
    short: dict[bytes, int] = {}
    out = []
    for s, e in zip(found.begins[:-1], found.begins[1:], strict=True):
        if e - s >= size:
            out.append(np.unique(grams[s : e - size + 1]))
        else:  # the whole sequence is one shingle, unlike any of more words
            own = codes[s:e].tobytes()
            out.append(np.array([-1 - short.setdefault(own, len(short))] if own else [], np.int64))
    return out


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """The bucket key of each band."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    low, high = np.full(_PERMUTATIONS, 0xFFFFFFFF, np.uint32), np.zeros(_PERMUTATIONS, np.uint32)
    for i in range(0, len(x), _CHUNK):
        values = _A[:, None] * x[None, i : i + _CHUNK]
        values += _B[:, None]
        np.minimum(low, values.min(axis=1), out=low)
        np.maximum(high, values.max(axis=1), out=high)
    signature = np.stack([low, high], axis=1).reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for j in range(ROWS):
        key = wordhash.mix(key * np.uint64(0x9E3779B97F4A7C15) + signature[:, j])
    return key.view(np.int64)


_SIGNED = "doc_id bigint, n bigint, digest binary, bands array<bigint>, packed binary"


def _sign(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1)
        for batch in parts(batches, 1):
            texts = texts_of(batch, 1)
            n, digests, bands, packed = [], [], [], []
            for text, (shingles, digest) in zip(texts, shingle_sets(texts, size), strict=True):
                some = len(shingles) > 0
                n.append(len(shingles))
                digests.append(digest if some else None)
                bands.append(band_keys(shingles) if some else None)
                packed.append(squeeze.compress(text) if some else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(packed, pa.binary())], names=["doc_id", "n", "digest", "bands", "packed"]
            )

    return run


def _confirm(size: int, share: int):
    """Of pairs (a, b, text a, text b): those whose sets, compared by their words, meet the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor()
        for batch in parts(batches, 3, PART_BYTES // 4):
            a, place, texts = batch.column("a").to_pylist(), {}, []
            for k, one in enumerate(a):  # a hub's text is taken once
                if one not in place:
                    place[one] = len(texts)
                    texts.append(open_.decompress(batch.column("left")[k].as_py()))
            sets = exact_sets(texts + [open_.decompress(p) for p in batch.column("right").to_pylist()], size)
            keep = []
            for one, right in zip(a, sets[len(texts) :], strict=True):
                left = sets[place[one]]
                both = len(np.intersect1d(left, right, assume_unique=True))
                keep.append(100 * both >= share * (len(left) + len(right) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _links(pairs: DataFrame, texts: DataFrame, size: int, share: int) -> DataFrame:
    """Confirmed pairs. Texts travel compressed; a hub's rows are split by Spark's skew join."""
    left = texts.select(F.col("doc_id").alias("a"), F.col("packed").alias("left"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("packed").alias("right"))
    filled = pairs.join(right, "b").join(left, "a").select("a", "b", "left", "right")
    return filled.mapInArrow(_confirm(size, share), "a bigint, b bigint")


def _common(texts: DataFrame, size: int) -> DataFrame:
    """(doc_id, c, h): how many of a text's shingles occur in another of ``texts``, in all and by PARTS hash parts.

    Two texts share at most the sum, over the parts, of the smaller count.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor()
        for batch in parts(batches, 1, PART_BYTES // 4):
            found = shingle_sets([open_.decompress(p) for p in batch.column("packed").to_pylist()], size)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([s.view(np.int64) for s, _ in found], pa.list_(pa.int64()))], names=["doc_id", "shingles"])

    rows = stored(texts.select("doc_id", "packed").mapInArrow(run, "doc_id bigint, shingles array<bigint>").select("doc_id", F.explode("shingles").alias("s")), "shingles")
    shared = stored(rows.groupBy("s").agg(F.count("*").alias("k")).where("k > 1").select("s"), "shared")
    counted = rows.join(shared, "s").groupBy("doc_id", F.pmod("s", F.lit(PARTS)).cast("int").alias("g")).agg(F.count("*").cast("int").alias("k"))
    held = counted.groupBy("doc_id").agg(F.sum("k").alias("c"), F.map_from_entries(F.collect_list(F.struct("g", "k"))).alias("m"))
    return held.select("doc_id", "c", F.transform(F.sequence(F.lit(0), F.lit(PARTS - 1)), lambda g: F.coalesce(F.try_element_at("m", g), F.lit(0))).alias("h"))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 5, share: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs``.

    Links: ``100 * intersection >= share * union`` of the sets of ``size`` consecutive words.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    signed = stored(rows.mapInArrow(_sign(size), _SIGNED), "signed")
    some = signed.where("digest is not null and doc_id is not null")
    # Classes of equal sets: one representative each; copies are counted before the shuffle.
    classes = stored(some.groupBy("digest").agg(F.min("doc_id").alias("rep")), "classes")
    reps = stored(
        some.join(classes.select("digest", F.col("rep").alias("doc_id")), ["digest", "doc_id"]).dropDuplicates(["digest", "doc_id"]).select("doc_id", "n", "bands", "packed"), "reps"
    )
    keys = reps.select("doc_id", "n", F.explode("bands").alias("key"))
    sizes = keys.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    members = stored(keys.join(sizes, "key"), "members")
    # A bucket's members are compared with the one that shares most buckets with most others: the
    # least edited copy of a group, whatever its id.
    scores = members.groupBy("doc_id").agg(F.sum("size").alias("score"))
    hubs = members.join(scores, "doc_id").groupBy("key").agg(F.max(F.struct("score", (-F.col("doc_id")).alias("id"), "n")).alias("hub"))
    hubs = stored(hubs.select("key", (-F.col("hub.id")).alias("a"), F.col("hub.n").alias("a_n")), "hubs")
    fits = f"least(n, a_n) * 100 >= {share} * greatest(n, a_n)"
    pairs = members.join(hubs, "key").where(f"doc_id <> a and {fits}").select(F.least("a", "doc_id").alias("a"), F.greatest("a", "doc_id").alias("b"))
    tried = stored(pairs.distinct(), "tried")
    texts = reps.select("doc_id", "packed")
    links = stored(_links(tried, texts, size, share), "links")
    labels = components(links)
    # Members of one bucket that are in different components and were not compared yet.
    large = members.where("size > 2").select("key", "doc_id", "n").join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    large = stored(large.select("key", "doc_id", "n", F.coalesce("label", "doc_id").alias("label")), "large")
    mixed = large.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("key")
    left = stored(large.join(mixed, "key"), "mixed")
    common = _common(left.select("doc_id").distinct().join(texts, "doc_id"), size)
    # An intersection holds no more than what each side shares with any of these texts at all.
    least = f"least(c, a_c) * {100 + share} >= {share} * (n + a_n)"
    closer = f"aggregate(zip_with(h, a_h, (x, y) -> least(x, y)), 0, (t, x) -> t + x) * {100 + share} >= {share} * (n + a_n)"
    left = left.join(common, "doc_id").where(f"c * 100 >= {share} * n")
    left = stored(left, "open")
    rest = (
        left.select("key", F.col("doc_id").alias("a"), F.col("n").alias("a_n"), F.col("c").alias("a_c"), F.col("h").alias("a_h"), F.col("label").alias("la"))
        .join(left.select("key", F.col("doc_id").alias("b"), "n", "c", "h", F.col("label").alias("lb")), "key")
        .where(f"a < b and la <> lb and {fits} and {least} and {closer}")
        .select("a", "b")
        .distinct()
        .join(tried, ["a", "b"], "left_anti")
    )
    more = stored(_links(rest, texts, size, share), "more")
    if not more.isEmpty():
        labels = components(links.union(more))
    named = stored(classes.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("digest", F.coalesce("label", "rep").alias("label")), "named")
    out = signed.select("doc_id", "n", "digest").join(named, "digest", "left")
    component = F.when(F.col("digest").isNull() | F.col("doc_id").isNull(), F.col("doc_id")).otherwise(F.col("label"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), (F.col("doc_id").isNull() | (F.col("doc_id") == component)).alias("kept"))
