"""Exact substring removal over a de Bruijn graph of token windows.

Windows of WINDOW consecutive words are the graph's edges, between runs of one word less. An edge
is repeated if its words occur at two places; its source is the first of them. Which edges can be
repeated is found first from sampled k-mers: every window is represented by its least 6-mer (its
minimizer), equal windows have equal minimizers, so windows whose minimizer occurs once in the
corpus are unique. Edges with one minimizer travel as one run to a shuffle on it, where each edge
finds its source. Runs that adjoin in a document and come from adjoining places of one source are
then compacted into paths, and each path's words are compared with those at its source's
coordinates, by 128-bit digests of the words themselves. Edges meet on hashes; should two different
ones have met, the comparison shows it, and all is done again with other hashes.

A passage that stands many times in one task goes on once: its other places are known repeats (the
task compares their words) and need no meeting, so that no minimizer gathers more rows than tasks.

Defined results: null, empty and short texts (under WINDOW words) lose nothing; rows that share a
doc_id are one document seen twice, and none counts as earlier than the other; a row without an
id is neither source nor copy; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrykit.llm import wordhash
from quarrykit.llm.common import PART_BYTES, parts, texts_of
from quarrykit.session import stored

WINDOW = 20
SEED = 6  # words of a sampled k-mer
MOST = SEED + 60  # the longest window: a run's edges are the bits of one number


def _minimizers(hashed: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and place of the least SEED-mer of each window of one document."""
    seed = min(SEED, window)
    grams = wordhash.windows(hashed, seed)
    span = np.lib.stride_tricks.sliding_window_view(grams, window - seed + 1)
    at = np.arange(len(span)) + span.argmin(axis=1)
    return grams[at], at


def _documents(texts: list[bytes | None], window: int, salt: int) -> Iterator[tuple[wordhash.Words, np.ndarray, list[tuple[int, int, int]]]]:
    """A piece's words, the hash of each, and (row, first, end) of the documents with a window."""
    for first, held in wordhash.pieces(texts):
        found = wordhash.words(held)
        yield found, wordhash.hashes(found, 0, salt), [(first + i, s, e) for i, (s, e) in enumerate(zip(found.begins[:-1].tolist(), found.begins[1:].tolist(), strict=True)) if e - s >= window]


def _span(words: list[bytes], start: int, n: int) -> bytes:
    return hashlib.blake2b(b" ".join(words[start : start + n]), digest_size=16).digest()


_PACKED = "doc_id bigint, n_words bigint, sha string, packed binary"


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text's words counted, hashed and compressed for the shuffle."""
    squeeze = zstandard.ZstdCompressor(level=1)
    for batch in parts(batches, 1):
        words = [(t or b"").split() for t in texts_of(batch, 1)]
        joined = [b" ".join(w) for w in words]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array([len(w) for w in words], pa.int64()),
                pa.array([hashlib.sha256(j).hexdigest() for j in joined], pa.string()),
                pa.array([squeeze.compress(j) for j in joined], pa.binary()),
            ],
            names=["doc_id", "n_words", "sha", "packed"],
        )


_SEEDS = "at bigint, key bigint, places int, docs array<bigint>"


def _seeds(window: int, salt: int):
    """Distinct minimizers of each piece: how often they occur there, and in which documents.

    Rows meet on ``at``. A minimizer seen twice in a piece is repeated whatever the others say:
    its documents go under a key of their own, and under its own key one row a task, without them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: set[int] = set()
        for batch in parts(batches, 1):
            ids = batch.column(0).to_numpy()
            for _, hashed, docs in _documents(texts_of(batch, 1), window, salt):
                keys, owner = [], []
                for row, s, e in docs:
                    seed, at = _minimizers(hashed[s:e], window)
                    new = np.concatenate([[True], at[1:] != at[:-1]])
                    keys.append(seed[new])
                    owner.append(np.full(int(new.sum()), ids[row], np.int64))
                if not keys:
                    continue
                key, doc = np.concatenate(keys).view(np.int64), np.concatenate(owner)
                order = np.lexsort((doc, key))
                key, doc = key[order], doc[order]
                first = np.concatenate([[True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])])
                starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
                places = np.diff(np.append(starts, len(key)))
                before = np.concatenate([[0], np.cumsum(first)])
                offsets = np.append(before[starts], before[-1]).astype(np.int32)
                key, doc, lead = key[starts], doc[first], doc[starts]
                many = places > 1
                own = wordhash.mix(key.view(np.uint64) + wordhash.mix(lead.view(np.uint64))).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.where(many, own, key)), pa.array(key), pa.array(np.where(many, 2, 1).astype(np.int32)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(doc))], names=["at", "key", "places", "docs"]
                )
                new_keys = [k for k in key[many].tolist() if k not in told]
                if new_keys:
                    told.update(new_keys)
                    n = len(new_keys)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(new_keys, pa.int64()), pa.array(new_keys, pa.int64()), pa.array(np.full(n, 2, np.int32)), pa.array([[]] * n, pa.list_(pa.int64()))], names=["at", "key", "places", "docs"]
                    )

    return run


_RUNS = "seed bigint, doc bigint, part bigint, start int, edges int, prints array<bigint>, from_doc bigint, from_pos int"


def _equal_before(found: wordhash.Words, at: np.ndarray, n: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Where ``asked``, whether the n words at a place equal those at the place before it in the list. Words stand one space apart."""
    out = np.zeros(len(at), bool)
    first, last = found.starts[at], found.ends[at + n - 1]
    for i in np.flatnonzero(asked & np.append(False, last[1:] - first[1:] == last[:-1] - first[:-1])).tolist():
        out[i] = found.joined[first[i] : last[i]] == found.joined[first[i - 1] : last[i - 1]]
    return out


def _runs(window: int, salt: int):
    """Runs of consecutive windows with one repeated minimizer, and the hash of each window.

    Of runs with equal words in one task only the earliest has to be judged. The others are
    repeats of it for certain; they go on without hashes, with their source and under a key of
    their own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor()
        known: dict[tuple, tuple[bytes, int, int]] = {}
        for batch in parts(batches, 2, PART_BYTES // 4):
            ids, rows_part, seeds = batch.column("doc_id").to_numpy(), batch.column("part").to_numpy(), batch.column("seeds")
            for found, hashed, docs in _documents([open_.decompress(p) for p in batch.column("packed").to_pylist()], window, salt):
                key, doc, part, pos, word, head, prints = [], [], [], [], [], [], []
                for row, s, e in docs:
                    seed, place = _minimizers(hashed[s:e], window)
                    at = np.flatnonzero(np.isin(seed.view(np.int64), seeds[row].values.to_numpy()))
                    if len(at):
                        new = np.ones(len(at), bool)
                        new[1:] = (at[1:] != at[:-1] + 1) | (place[at[1:]] != place[at[:-1]])
                        key.append(seed[at].view(np.int64))
                        doc.append(np.full(len(at), ids[row], np.int64))
                        part.append(np.full(len(at), rows_part[row], np.int64))
                        pos.append(at.astype(np.int32))
                        word.append(s + at)
                        head.append(new)
                        prints.append(wordhash.windows(hashed[s:e], window)[at].view(np.int64))
                if not key:
                    continue
                key, doc, part, pos, word, head, prints = (np.concatenate(x) for x in (key, doc, part, pos, word, head, prints))
                starts = np.flatnonzero(head)
                edges = np.diff(np.append(starts, len(head))).astype(np.int32)
                # Windows of a run overlap, so its first and last hash and its length say all.
                first, last = prints[starts], prints[starts + edges - 1]
                order = np.lexsort((pos[starts], doc[starts], edges, last, first, key[starts]))
                o = starts[order]
                first, last, edges = first[order], last[order], edges[order]
                same = np.zeros(len(o), bool)
                same[1:] = (key[o][1:] == key[o][:-1]) & (first[1:] == first[:-1]) & (last[1:] == last[:-1]) & (edges[1:] == edges[:-1])
                same[1:] &= (doc[o][1:] != doc[o][:-1]) | (pos[o][1:] != pos[o][:-1])  # rows that share an id are judged
                same = _equal_before(found, word[o], edges + (window - 1), same)
                leader = np.maximum.accumulate(np.where(same, 0, np.arange(len(o))))
                from_doc, from_pos = doc[o][leader], pos[o][leader]
                # Leaders of several: had this task an earlier one?
                for i in np.unique(leader[same]).tolist():
                    name = (int(key[o[i]]), int(first[i]), int(last[i]), int(edges[i]))
                    text = found.joined[found.starts[word[o[i]]] : found.ends[word[o[i]] + edges[i] + window - 2]]
                    here = (int(doc[o[i]]), int(pos[o[i]]))
                    held = known.get(name)
                    if held is not None and held[0] == text and held[1:] < here:
                        same[i], from_doc[i], from_pos[i] = True, held[1], held[2]
                    elif held is None or held[0] == text:
                        known[name] = (text, *here)
                own = wordhash.mix(doc[o].view(np.uint64) * np.uint64(31) + pos[o].astype(np.uint64)).view(np.int64)
                sizes = np.where(same, 0, edges)
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                take = np.repeat(o - offsets[:-1], sizes) + np.arange(offsets[-1])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.where(same, own, key[o])), pa.array(doc[o]), pa.array(part[o]), pa.array(pos[o]), pa.array(edges), pa.ListArray.from_arrays(pa.array(offsets), pa.array(prints[take])),
                        pa.array(from_doc, mask=~same), pa.array(from_pos, mask=~same),
                    ],
                    names=["seed", "doc", "part", "start", "edges", "prints", "from_doc", "from_pos"],
                )

    return run


_CHECKS = "array<struct<from_doc:bigint,from_pos:int,edges:int,digest:binary>>"
_CUT = f"doc_id bigint, sha string, n_removed bigint, kept_sha256 string, kept_text string, checks {_CHECKS}"
_CHECK_TYPE = pa.list_(pa.struct([("from_doc", pa.int64()), ("from_pos", pa.int32()), ("edges", pa.int32()), ("digest", pa.binary())]))


def _cut(window: int, single: bool, with_text: bool):
    """Remove the words under paths; what a path's words are goes on to be compared with its source."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor()
        for batch in parts(batches, 2, PART_BYTES // 4):
            removed, sha, kept, checks = [], [], [], []
            for packed, paths in zip(batch.column("packed").to_pylist(), batch.column("paths").to_pylist(), strict=True):
                words = open_.decompress(packed).split()
                gone, asked = np.zeros(len(words), bool), []
                for p in paths:
                    start, n = p["start"], p["edges"]
                    gone[start : start + n + window - 1] = True
                    if not p["known"]:
                        each = [(k, 1) for k in range(n)] if single else [(0, n)]
                        asked += [{"from_doc": p["from_doc"], "from_pos": p["from_pos"] + k, "edges": m, "digest": _span(words, start + k, m + window - 1)} for k, m in each]
                left = b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g])
                removed.append(int(gone.sum()))
                sha.append(hashlib.sha256(left).hexdigest())
                kept.append(left.decode("utf-8", "replace") if with_text else None)
                checks.append(asked)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("sha"), pa.array(removed, pa.int64()), pa.array(sha, pa.string()), pa.array(kept, pa.string()), pa.array(checks, _CHECK_TYPE)],
                names=["doc_id", "sha", "n_removed", "kept_sha256", "kept_text", "checks"],
            )

    return run


def _sources(window: int):
    """What stands at the asked coordinates of each source."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor()
        for batch in parts(batches, 1, PART_BYTES // 4):
            rows = []
            for doc, packed, spans in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                words = open_.decompress(packed).split()
                rows += [(doc, p["from_pos"], p["edges"], _span(words, p["from_pos"], p["edges"] + window - 1)) for p in spans]
            types = (pa.int64(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["from_doc", "from_pos", "edges", "digest"])

    return run


def judged_runs(held: DataFrame, window: int, salt: int) -> DataFrame:
    """(doc, part, start, mask, from_doc, shift, known): edges that start earlier elsewhere, a row for each run and source.

    ``held`` has packed documents and the repeated minimizers of each. Bit k of the mask is the
    edge at start + k, whose source stands at start + k + shift of from_doc. Runs meet their like
    by one shuffle on the minimizer, and edges are judged in the partitions that it made.
    """
    runs = held.select("doc_id", "part", "packed", "seeds").mapInArrow(_runs(window, salt), _RUNS).repartition("seed")
    edges = runs.select("seed", "doc", "part", "start", "edges", "from_doc", "from_pos", F.posexplode_outer("prints").alias("k", "print"))
    # Least (doc, pos) of equal edges: the source.
    of = Window.partitionBy("seed", "print")
    edges = edges.withColumn("source", F.min("doc").over(of)).withColumn("here", F.when(F.col("doc") == F.col("source"), F.col("start") + F.col("k")))
    edges = edges.withColumn("source_pos", F.min("here").over(of))
    known = F.col("print").isNull()
    edges = edges.where(known | (F.col("doc") != F.col("source")) | (F.col("start") + F.col("k") != F.col("source_pos")))
    bit = F.when(known, F.expr("shiftleft(1L, edges) - 1")).otherwise(F.expr("shiftleft(1L, k)"))
    shift = F.when(known, F.col("from_pos") - F.col("start")).otherwise(F.col("source_pos") - F.col("start") - F.col("k"))
    parted = edges.select("seed", "doc", "part", "start", bit.alias("bit"), F.when(known, F.col("from_doc")).otherwise(F.col("source")).alias("from_doc"), shift.alias("shift"), known.alias("known"))
    return parted.groupBy("seed", "doc", "part", "start", "from_doc", "shift", "known").agg(F.bit_or("bit").alias("mask")).drop("seed")


def paths(runs: DataFrame) -> DataFrame:
    """(doc, part, start, edges, from_doc, from_pos, known): maximal nonbranching paths of repeated edges.

    Consecutive bits of a run, and then runs of one document that adjoin or overlap and come from
    one source at one distance, are joined end to start. One shuffle on the document.
    """
    begins = F.expr("filter(sequence(0, length(bin(mask)) - 1), k -> (shiftright(mask, k) & 1) = 1 and (k = 0 or (shiftright(mask, k - 1) & 1) = 0))")
    cut = runs.repartition("doc", "part").select("doc", "part", "start", "mask", "from_doc", "shift", "known", F.explode(begins).alias("k"))
    rest = F.expr("shiftright(mask, k) + 1")  # its lowest bit is as high as ones were there
    cut = cut.select("doc", "part", "from_doc", "shift", "known", (F.col("start") + F.col("k")).alias("start"), F.bit_count(rest.bitwiseAND(-rest) - 1).cast("int").alias("edges"))
    along = Window.partitionBy("doc", "part", "from_doc", "shift", "known").orderBy("start", "edges")
    reach = F.max(F.col("start") + F.col("edges")).over(along.rowsBetween(Window.unboundedPreceding, -1))
    numbered = cut.withColumn("new", F.when(F.col("start") <= reach, 0).otherwise(1)).withColumn("path", F.sum("new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    joined = numbered.groupBy("doc", "part", "from_doc", "shift", "known", "path").agg(F.min("start").alias("start"), (F.max(F.col("start") + F.col("edges")) - F.min("start")).alias("edges"))
    return joined.select("doc", "part", "start", "edges", "from_doc", (F.col("start") + F.col("shift")).alias("from_pos"), "known")


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, with_text: bool = True) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept_text) for each row; kept_text is null where nothing was removed, or without ``with_text``."""
    if not 1 <= window <= MOST:
        raise ValueError(f"window of {window} words: 1 to {MOST} are possible")
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    salt = 0
    while (out := _attempt(rows, window, with_text, salt)) is None:
        salt += 1
    return out


def _attempt(rows: DataFrame, window: int, with_text: bool, salt: int) -> DataFrame | None:
    """The result, or None if hashes made different edges meet."""
    seeds = rows.where("doc_id is not null").mapInArrow(_seeds(window, salt), _SEEDS)
    seen = seeds.withColumn("all", F.sum("places").over(Window.partitionBy("at"))).where("`all` > 1")
    of_doc = seen.select("key", F.explode("docs").alias("doc_id")).groupBy("doc_id").agg(F.collect_set("key").alias("seeds"))
    packed = rows.mapInArrow(_pack, _PACKED)
    every = stored(packed.join(of_doc, "doc_id", "left").select("doc_id", "n_words", "sha", F.when(F.col("seeds").isNotNull(), F.col("packed")).alias("packed"), "seeds"), "packed")
    hot = every.where("seeds is not null")
    repeats = hot.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("sha").alias("a"), F.max("sha").alias("b")).agg(F.max("n"), F.max(F.col("a") < F.col("b"))).first()
    differ = bool(repeats[1])  # one id with different texts: they are told apart by a part of their digest
    hot = hot.withColumn("part", F.conv(F.substring("sha", 1, 15), 16, 10).cast("bigint") if differ else F.lit(0).cast("bigint"))
    path = F.struct("start", "edges", "from_doc", "from_pos", "known")
    found = paths(judged_runs(hot, window, salt)).groupBy("doc", "part").agg(F.collect_list(path).alias("paths"))
    once = hot.select("doc_id", "part", "sha", "packed")
    if (repeats[0] or 0) > 1:  # rows repeated under one id
        once = once.dropDuplicates(["doc_id", "sha"])
    held = once.join(found.withColumnRenamed("doc", "doc_id"), ["doc_id", "part"]).select("doc_id", "sha", "packed", "paths")
    cut = stored(held.mapInArrow(_cut(window, differ, with_text), _CUT), "cut")
    asked = cut.select(F.explode("checks").alias("c")).select("c.*").distinct()
    spans = asked.select("from_doc", "from_pos", "edges").distinct().groupBy(F.col("from_doc").alias("doc_id")).agg(F.collect_list(F.struct("from_pos", "edges")).alias("spans"))
    stand = once.join(spans, "doc_id").select("doc_id", "packed", "spans").mapInArrow(_sources(window), "from_doc bigint, from_pos int, edges int, digest binary")
    if not asked.join(stand, ["from_doc", "from_pos", "edges", "digest"], "left_anti").isEmpty():
        return None
    out = every.select("doc_id", "n_words", "sha").join(cut.drop("checks"), ["doc_id", "sha"], "left")
    return out.select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("bigint").alias("n_removed"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"), "kept_text")
