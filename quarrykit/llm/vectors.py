"""Near-duplicate vectors on a robust-pruned flat graph.

Vectors of a label are dealt over overlapping cluster shards. Each shard builds a graph by batched
insertion with robust pruning; the adjacency lists of a vector's shards are united into one index.
Every vector is then searched for in its nearest shard, on the united lists: the shard's vectors
and those that the lists lead to outside it. The search walks greedily from the medoid and widens
its range over neighbours in or near the threshold; each hit is verified by its cosine in double
precision. Recall is audited against brute force for every row whose id is divisible by 50. Below
RECALL, shards are made to overlap so far that linked vectors always meet, and compared without
the graph, which misses none.

Equal vectors of a label are one class from the start. Shards of more than TASK_BYTES (large groups
of near copies do not cluster further) are dealt over tasks by pairs of blocks, so that no task
holds more than two blocks and every pair still meets. A task returns one row a vector: how many
it links with and the least vector of its local component, never the pairs.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and
rows with a null label or id, link with nothing and are their own component; vectors of different
lengths do not link; repeated rows of an id count as copies of each other and give one row each,
and an id with several vectors is one node with the links of all;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrykit.llm.common import lookup
from quarrykit.llm.components import components
from quarrykit.session import stored

COSINE = 0.98
DEGREE = 24  # of the pruned graph
ALPHA = 1.2
BEAM = 48
ENTRIES = 8  # medoids that a search begins at
SLACK = 0.06  # the search goes on from neighbours so far below the threshold
SHARD_ROWS = 1000  # vectors that a cluster is meant to hold
MAX_CENTROIDS = 8192  # of all labels together; broadcast (4 MB at 64 dimensions)
FIT_ROWS, FIT_BYTES = 65_536, 32 << 20  # rows, and bytes of them, that centroids are fitted on at most, by hash of their id
OVERLAP = 0.05  # a vector also joins clusters whose centroid is so much less similar
TASK_BYTES = 2 << 20  # of vectors that a task takes before its shard is dealt out
MATRIX = 1 << 22  # numbers of a matrix of cosines that is held at once
AUDIT_EVERY = 50
RECALL = 0.999  # below it the exact way is taken
_QUERIES = 2048  # audit queries compared at once
_NONE = np.iinfo(np.int64).max


def _unit(values) -> np.ndarray | None:
    """The vector at length 1 in double precision, or None if it can't link."""
    if values is None or not len(values) or any(v is None for v in values):
        return None
    x = np.asarray(values, np.float64)
    top = np.abs(x).max()
    if not np.isfinite(x).all() or top == 0:
        return None
    x = x / top
    return x / np.sqrt(x @ x)


def _prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        units = [_unit(v) for v in batch.column(1).to_pylist()]
        labels = batch.column(2).to_pylist()
        ids = batch.column(0).to_pylist()
        keep = [u.tobytes() if u is not None and lab is not None and i is not None else None for u, lab, i in zip(units, labels, ids, strict=True)]
        digest = [None if k is None else hashlib.blake2b(f"{lab}:".encode() + k, digest_size=16).digest() for k, lab in zip(keep, labels, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(keep, pa.binary()), pa.array(digest, pa.binary())], names=["vec_id", "label", "unit", "digest"])


def _blocks(n: int, width: int) -> Iterator[slice]:
    """Rows in blocks of at most MATRIX / width."""
    step = max(1, MATRIX // max(1, width))
    return (slice(i, min(i + step, n)) for i in range(0, n, step))


def _kmeans(x: np.ndarray, k: int, rounds: int = 6) -> np.ndarray:
    """Spherical k-means; begins with evenly spaced rows."""
    c = x[np.linspace(0, len(x) - 1, k).astype(int)]
    for _ in range(rounds):
        near = np.concatenate([(x[at] @ c.T).argmax(axis=1) for at in _blocks(len(x), k)])
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        norm = np.sqrt((sums**2).sum(axis=1, keepdims=True))
        c = np.where(norm > 1e-9, sums / np.maximum(norm, 1e-9), c)
    return c


def centroids(classes: DataFrame) -> dict[tuple[int, int], np.ndarray]:
    """Centroids of each (label, length) with more rows than a shard; fitted on a bounded sample."""
    sizes = {(r["label"], r["dim"]): r["n"] for r in classes.groupBy("label", "dim").agg(F.count("*").alias("n")).where(f"n > {SHARD_ROWS}").orderBy(F.desc("n"), "label", "dim").limit(MAX_CENTROIDS // 2).collect()}
    total = sum(sizes.values())
    if not total:
        return {}
    wanted = {g: max(2, min(-(-n // SHARD_ROWS), MAX_CENTROIDS * n // total)) for g, n in sizes.items()}
    large = classes.join(F.broadcast(classes.sparkSession.createDataFrame([(*g,) for g in sizes], "label int, dim int")), ["label", "dim"])
    most = min(FIT_ROWS, max(1, FIT_BYTES // (8 * max(d for _, d in sizes))))
    rows = large.select("label", "dim", "unit", F.xxhash64("vec_id").alias("h"), "vec_id").orderBy("h", "vec_id").limit(most).collect()
    out = {}
    for g, k in wanted.items():
        x = np.array([np.frombuffer(r["unit"]) for r in rows if (r["label"], r["dim"]) == g])
        if len(x) >= 2:
            out[g] = _kmeans(x, min(k, len(x)))
    return out


def _assign(held, cosine: float, overlap: float | None):
    """The nearest cluster of each vector, and all that it joins: those about as near, or, without an ``overlap``, all whose own vectors may link with it.

    If y lies nearest to c and x at most d away from it, x is nearer to another centroid than to
    c by no more than d times the distance between the two.
    """
    apart = np.sqrt(2 - 2 * cosine) + 1e-9

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, dims = batch.column("label").to_numpy(), batch.column("dim").to_numpy()
            units = batch.column("unit").to_pylist()
            shards: list = [None] * len(units)
            home: list = [None] * len(units)
            for g in set(zip(labels.tolist(), dims.tolist(), strict=True)):
                at = np.flatnonzero((labels == g[0]) & (dims == g[1]))
                c = held.value.get(g)
                if c is None:
                    for i in at:
                        home[i], shards[i] = f"{g[0]}-{g[1]}-0", [f"{g[0]}-{g[1]}-0"]
                    continue
                for part in _blocks(len(at), len(c)):
                    near = np.array([np.frombuffer(units[i]) for i in at[part]]) @ c.T
                    best = near.argmax(axis=1)
                    behind = near.max(axis=1, keepdims=True) - near
                    close = behind <= (overlap if overlap is not None else apart * np.sqrt(np.maximum(0, 2 - 2 * (c[best] @ c.T))) + 1e-9)
                    for i, k, row in zip(at[part], best, close, strict=True):
                        home[i], shards[i] = f"{g[0]}-{g[1]}-{k}", [f"{g[0]}-{g[1]}-{j}" for j in np.flatnonzero(row)]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("unit"), batch.column("copies"), pa.array(home, pa.string()), pa.array(shards, pa.list_(pa.string()))], names=["vec_id", "unit", "copies", "home", "shards"])

    return run


def beam_search(x: np.ndarray, graph: np.ndarray, queries: np.ndarray, starts: np.ndarray, beam: int) -> np.ndarray:
    """Greedy search of many queries at once, each from the nearest of the starts: the nodes left in each beam (-1: none)."""
    n, q = len(x), len(queries)
    rows = np.arange(q)
    ids = np.full((q, beam), -1)
    sims = np.full((q, beam), -np.inf)
    k = min(ENTRIES, len(starts), beam)
    first = queries @ x[starts].T
    top = np.argpartition(-first, k - 1, axis=1)[:, :k]
    ids[:, :k], sims[:, :k] = starts[top], np.take_along_axis(first, top, 1)
    done = np.zeros((q, beam), bool)
    seen = np.zeros((q, n + 1), bool)  # the last column takes the graph's empty places
    seen[rows[:, None], ids[:, :k]] = seen[:, n] = True
    active = rows
    for _ in range(4 * beam):
        open_ = np.where(done[active] | (ids[active] < 0), -np.inf, sims[active])
        best = open_.argmax(axis=1)
        going = open_[np.arange(len(active)), best] > -np.inf
        active, best = active[going], best[going]
        if not len(active):
            break
        done[active, best] = True
        near = graph[ids[active, best]]
        near = np.where(near < 0, n, near)
        fresh = ~seen[active[:, None], near]
        seen[active[:, None], near] = True
        some = np.einsum("qrd,qd->qr", x[np.minimum(near, n - 1)], queries[active])
        some[~fresh] = -np.inf
        near = np.where(fresh, near, -1)
        all_sims, all_ids = np.hstack([sims[active], some]), np.hstack([ids[active], near])
        all_done = np.hstack([done[active], np.zeros(near.shape, bool)])
        top = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
        sims[active], ids[active], done[active] = (np.take_along_axis(a, top, 1) for a in (all_sims, all_ids, all_done))
    return ids


def robust_prune(x: np.ndarray, nodes: np.ndarray, pool: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """For each node, up to ``degree`` of its pool: the nearest first, those alpha-closer to a chosen one dropped."""
    pool = np.where(pool == nodes[:, None], -1, pool)
    pool = np.sort(pool, axis=1)
    pool[:, 1:][pool[:, 1:] == pool[:, :-1]] = -1
    vectors = x[np.maximum(pool, 0)]
    far = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("qcd,qd->qc", vectors, x[nodes])))
    far[pool < 0] = np.inf
    between = np.sqrt(np.maximum(0, 2 - 2 * np.matmul(vectors, vectors.transpose(0, 2, 1))))
    out, rows = np.full((len(nodes), degree), -1), np.arange(len(nodes))
    left = far.copy()
    for k in range(degree):
        best = left.argmin(axis=1)
        some = np.isfinite(left[rows, best])
        if not some.any():
            break
        out[some, k] = pool[rows[some], best[some]]
        left[(alpha * between[rows, best] <= far) & some[:, None]] = np.inf
        left[rows, best] = np.inf
    return out


def build_graph(x: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA, beam: int = BEAM) -> tuple[np.ndarray, int]:
    """Adjacency (-1: empty) and medoid, inserting batches that double in size."""
    n = len(x)
    medoid = int((x @ x.mean(axis=0)).argmax())
    graph = np.full((n, degree), -1)
    order = np.random.default_rng(7).permutation(n)
    order = np.concatenate([[medoid], order[order != medoid]])
    # The second time round the first nodes, too, choose among all others.
    for again in (False, True) if n > 1 else ():
        at = 0 if again else 1
        while at < n:
            batch = order[at : at + (256 if again else min(256, at))]
            pool = beam_search(x, graph, x[batch], np.array([medoid]), min(beam, n))
            graph[batch] = robust_prune(x, batch, np.hstack([pool, graph[batch]]), degree, alpha)
            # Edges back; nodes with more than fit are pruned again.
            src, dst = np.repeat(batch, degree), graph[batch].ravel()
            src, dst = src[dst >= 0], dst[dst >= 0]
            by = np.argsort(dst, kind="stable")
            src, dst = src[by], dst[by]
            targets, first, count = np.unique(dst, return_index=True, return_counts=True)
            for width in np.unique(np.minimum(count, 64)):
                some = np.flatnonzero(np.minimum(count, 64) == width)
                for i in range(0, len(some), 256):
                    part = some[i : i + 256]
                    new = src[first[part][:, None] + np.arange(width)]
                    graph[targets[part]] = robust_prune(x, targets[part], np.hstack([graph[targets[part]], new]), degree, alpha)
            at += len(batch)
    return graph, medoid


def _spread(labels: np.ndarray, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """The least label of each connected group of nodes."""
    while len(src):
        before = labels.copy()
        np.minimum.at(labels, src, labels[dst])
        np.minimum.at(labels, dst, labels[src])
        labels = np.minimum(labels, labels[labels]) if labels.max() < len(labels) else labels
        if (labels == before).all():
            break
    return labels


def range_search(x: np.ndarray, graph: list[np.ndarray], queries: np.ndarray, cosine: float, beam: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows of ``queries``, rows of ``x``) between which all that is in range is to be looked for.

    Along the graph's edges, in both directions, the range widens over neighbours in or near it;
    what hangs together so is one region. Every query walks greedily from the nearest medoids, of
    all vectors and of each region, and what it meets in or near its range joins its own region.
    Regions are compared with themselves.
    """
    width = max(1, *map(len, graph))
    square = np.full((len(x), width), -1)
    for i, near in enumerate(graph):
        square[i, : len(near)] = near
    src, dst = np.repeat(np.arange(len(x)), [len(g) for g in graph]), np.concatenate(graph).astype(int)
    sims = np.concatenate([np.einsum("ij,ij->i", x[src[at]], x[dst[at]]) for at in _blocks(len(src), x.shape[1])] or [np.zeros(0)])
    region = _spread(np.arange(len(x)), src[sims >= cosine - SLACK], dst[sims >= cosine - SLACK])
    by = np.argsort(region, kind="stable")
    starts = [int((x @ x.mean(axis=0)).argmax())]
    for group in np.split(by, np.flatnonzero(np.diff(region[by])) + 1):
        if len(group) > 1:
            starts.append(int(group[(x[group] @ x[group].mean(axis=0)).argmax()]))
    ends: list = [[], []]
    for begin in range(0, len(queries), 256):
        rows = queries[begin : begin + 256]
        found = beam_search(x, square, x[rows], np.unique(starts), min(beam, len(x)))
        near = np.einsum("qbd,qd->qb", x[np.maximum(found, 0)], x[rows])
        q, b = np.nonzero((found >= 0) & (near >= cosine - SLACK))
        ends[0].append(rows[q])
        ends[1].append(found[q, b])
    region = _spread(region, np.concatenate(ends[0]), np.concatenate(ends[1]))
    asks = np.zeros(len(x), bool)
    asks[queries] = True
    by = np.argsort(region, kind="stable")
    for group in np.split(by, np.flatnonzero(np.diff(region[by])) + 1):
        if len(group) > 1 and asks[group].any():
            yield group[asks[group]], group


def _vectors(frame: pd.DataFrame) -> np.ndarray:
    return np.array([np.frombuffer(u) for u in frame["unit"]])


def _index(frame: pd.DataFrame, cosine: float) -> pd.DataFrame:
    """Adjacency lists of one task's vectors, by id, and which of the neighbours are in or near the range."""
    x, ids = _vectors(frame), frame["vec_id"].to_numpy()
    graph, _ = build_graph(x)
    lists = [g[g >= 0] for g in graph]
    return pd.DataFrame({"vec_id": ids, "near": [ids[g] for g in lists], "close": [ids[g[x[g] @ x[i] >= cosine - SLACK]] for i, g in enumerate(lists)]})


def _find(cosine: float, beam: int | None):
    """Links of the vectors that ask in a task, by search, or without a ``beam`` by comparing all that is there."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        x, ids, copies = _vectors(frame), frame["vec_id"].to_numpy(), frame["copies"].to_numpy()
        block, asks, task = frame["block"].to_numpy(), np.flatnonzero(frame["ask"].to_numpy()), frame.iloc[0]
        two = task["i"] != task["j"]
        links = np.zeros(len(x), np.int64)
        named, lows = [ids], [ids]  # who hangs together with whom, region by region
        if beam is None:
            regions: Iterator = iter([(asks, np.arange(len(x)))])
        elif len(asks):
            place = {v: i for i, v in enumerate(ids.tolist())}
            regions = range_search(x, [np.array([place[v] for v in near if v in place], int) for near in frame["near"]], asks, cosine, beam)
        else:
            regions = iter(())
        for q, m in regions:
            nodes = np.union1d(q, m)
            low, at_q, at_m = ids[nodes].copy(), np.searchsorted(nodes, q), np.searchsorted(nodes, m)
            blocks, held, counted, changed = list(_blocks(len(q), len(m))), None, False, True
            while changed:
                changed = False
                for at in blocks:
                    if held is None or len(blocks) > 1:
                        held = (x[q[at]] @ x[m].T >= cosine) & (ids[q[at]][:, None] != ids[m])
                        if two:
                            held &= block[q[at]][:, None] != block[m]
                    if not counted:
                        links[q[at]] += held.astype(np.int64) @ copies[m]
                    # The least id met, from either side, until nothing changes.
                    mine = np.minimum(low[at_q[at]], np.where(held, low[at_m], _NONE).min(axis=1, initial=_NONE))
                    changed |= bool((mine != low[at_q[at]]).any())
                    low[at_q[at]] = mine
                    theirs = np.minimum(low[at_m], np.where(held, low[at_q[at]][:, None], _NONE).min(axis=0, initial=_NONE))
                    changed |= bool((theirs != low[at_m]).any())
                    low[at_m] = theirs
                counted = True
            moved = low != ids[nodes]
            named.append(ids[nodes][moved])
            lows.append(low[moved])
        vec, low = np.concatenate(named), np.concatenate(lows)
        count = np.concatenate([links, np.zeros(len(vec) - len(ids), np.int64)])
        told = (count > 0) | (vec != low)
        return pd.DataFrame({"vec_id": vec[told], "links": count[told], "low": low[told]})

    return run


def _brute(held, cosine: float):
    """Links of the audit's queries with a batch of vectors, label by label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q_ids, q_groups, q = held.value
        for batch in batches:
            groups = np.array([f"{lab}-{dim}" for lab, dim in zip(batch.column("label").to_pylist(), batch.column("dim").to_pylist(), strict=True)])
            ids, copies, units = batch.column("vec_id").to_numpy(), batch.column("copies").to_numpy(), batch.column("unit").to_pylist()
            counts = np.zeros(len(q_ids), np.int64)
            for g in set(q_groups.tolist()) & set(groups.tolist()):
                rows, asks = np.flatnonzero(groups == g), np.flatnonzero(q_groups == g)
                x = np.array([np.frombuffer(units[i]) for i in rows])
                for at in _blocks(len(asks), len(x)):
                    near = np.array([np.frombuffer(q[k]) for k in asks[at]]) @ x.T >= cosine
                    near &= q_ids[asks[at]][:, None] != ids[rows]
                    counts[asks[at]] += near.astype(np.int64) @ copies[rows]
            some = counts > 0
            yield pa.RecordBatch.from_arrays([pa.array(q_ids[some]), pa.array(counts[some])], names=["vec_id", "truth"])

    return run


def audit(rows: DataFrame, classes: DataFrame, found: DataFrame, cosine: float) -> float:
    """Share of the true links of the rows whose id is divisible by AUDIT_EVERY that were found; they are compared in blocks with all rows."""
    asked = rows.where(F.pmod("vec_id", F.lit(AUDIT_EVERY)) == 0).groupBy("digest").agg(F.count("*").alias("times"))
    queries = stored(classes.join(asked, "digest").select("vec_id", "label", "dim", "unit", "times"), "audit")
    n_blocks = max(1, -(-queries.count() // _QUERIES))
    true = got = 0
    for k in range(n_blocks):
        part = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)) == k)
        block = part.select("vec_id", "label", "dim", "unit").collect()
        held = classes.sparkSession.sparkContext.broadcast((np.array([r["vec_id"] for r in block], np.int64), np.array([f"{r['label']}-{r['dim']}" for r in block]), [bytes(r["unit"]) for r in block]))
        truth = classes.select("vec_id", "label", "dim", "unit", "copies").mapInArrow(_brute(held, cosine), "vec_id bigint, truth bigint").groupBy("vec_id").agg(F.sum("truth").alias("truth"))
        both = truth.join(part.select("vec_id", "times"), "vec_id").join(found, "vec_id", "left")
        row = both.agg(F.sum(F.col("truth") * F.col("times")).alias("t"), F.sum(F.least("truth", F.coalesce("links", F.lit(0))) * F.col("times")).alias("g")).first()
        true, got = true + (row["t"] or 0), got + (row["g"] or 0)
    return got / true if true else 1.0


def _tasks(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """Rows of shards with their task (shard, i, j): a row of block b of a large shard goes to every pair of blocks with b in it."""
    dealt = lookup(rows, sizes.where("blocks > 1"), ["shard"], F.col("vec_id")).withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.withColumn("i", F.least("block", "o")).withColumn("j", F.greatest("block", "o")).drop("blocks", "o")


def links(classes: DataFrame, cosine: float, overlap: float | None, beam: int | None, held) -> DataFrame:
    """(vec_id, links, low) of every vector that links with another class; without overlap and beam exactly, by comparison."""
    key = ["shard", "i", "j"]
    assigned = classes.select("vec_id", "label", "dim", "unit", "copies").mapInArrow(_assign(held, cosine, overlap), "vec_id bigint, unit binary, copies bigint, home string, shards array<string>")
    placed = stored(assigned, "placed")
    members = placed.select("vec_id", "unit", "copies", F.explode("shards").alias("shard"), "home").withColumn("ask", F.col("home") == F.col("shard")).drop("home")
    half = F.greatest(F.lit(128), F.lit(TASK_BYTES // 2) / F.max(F.length("unit")))
    sizes = stored(members.groupBy("shard").agg(F.when(F.count("*") > 2 * half, F.ceil(F.count("*") / half)).otherwise(1).cast("int").alias("blocks")), "shard-sizes")
    rows = members
    if beam is None:
        ready = _tasks(rows, sizes).withColumn("near", F.expr("cast(array() as array<bigint>)"))
    else:
        lists = _tasks(members.select("shard", "vec_id", "unit"), sizes).groupBy(*key).applyInPandas(lambda frame: _index(frame, cosine), "vec_id bigint, near array<bigint>, close array<bigint>")
        index = stored(lists.groupBy("vec_id").agg(*(F.array_distinct(F.flatten(F.collect_list(c))).alias(c) for c in ("near", "close"))), "graph-index")
        # Where the united lists lead outside a shard, in or near the range, takes part in its search, but does not ask there.
        led = placed.where("size(shards) > 1").select("vec_id", "shards").join(index, "vec_id").select(F.explode("shards").alias("shard"), "close").select("shard", F.explode("close").alias("vec_id")).distinct()
        outside = led.join(members.select("shard", "vec_id"), ["shard", "vec_id"], "left_anti").join(placed.select("vec_id", "unit", "copies"), "vec_id").withColumn("ask", F.lit(False))
        ready = _tasks(members.unionByName(outside).join(index.select("vec_id", "near"), "vec_id"), sizes)
    ready = stored(ready, "searchable")
    found = ready.groupBy(*key).applyInPandas(_find(cosine, beam), "vec_id bigint, links bigint, low bigint")
    return stored(found.groupBy("vec_id").agg(F.sum("links").alias("links"), F.collect_set("low").alias("low")), "vector-links")


def near_vectors(table: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = COSINE, beam: int | None = BEAM, overlap: float | None = OVERLAP) -> DataFrame:
    """(vec_id, n_links, component_id, kept, recall) for each row; recall is the audit's. Without ``beam`` and ``overlap`` the exact way is taken at once."""
    spark = table.sparkSession
    rows = table.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"), F.col(label_col).cast("int").alias("label"))
    rows = stored(rows.mapInArrow(_prepare, "vec_id bigint, label int, unit binary, digest binary"), "units")
    some = rows.where("digest is not null")
    classes = some.groupBy("digest").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("unit").alias("unit"))
    classes = stored(classes.withColumn("dim", (F.length("unit") / 8).cast("int")), "vector-classes")
    held = spark.sparkContext.broadcast(centroids(classes))
    for width, walk in ((overlap, beam), (None, None)):
        found = links(classes, cosine, width, walk, held)
        recall = audit(some, classes, found, cosine)
        if recall >= RECALL:
            break
    labels = components(found.select(F.col("vec_id").alias("a"), F.explode("low").alias("b")).where("a <> b"))
    named = classes.select("digest", "vec_id", "copies").join(found.select("vec_id", "links"), "vec_id", "left").join(labels.withColumnRenamed("node", "vec_id"), "vec_id", "left")
    named = stored(named.select("digest", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("label", "vec_id").alias("component")), "named-vectors")
    out = rows.select("vec_id", "digest").join(named, "digest", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"), F.lit(recall).alias("recall"))
