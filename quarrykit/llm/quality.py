"""Quality and toxicity decisions by hierarchical empirical Bayes.

A document classifier (logistic, on counts of telling words and on style) gives each document a
log likelihood ratio. Sites give the prior: a host's rate of bad documents is shrunk toward the
global rate, a path's rate toward its host's, each by a concentration that the method of moments
takes from how much the rates differ. A document's posterior adds the two on the logit scale.

The classifier is fitted on at most SAMPLE labelled rows (those with the least hash of their id)
and at most WORDS words a target; rates, shrinkage and decisions use all documents.

Defined results: a null or empty text has no evidence and gets its site's posterior; null hosts
and paths count as the empty string; without labels of both kinds for a target nothing is
rejected for it; of labels repeated for one document the worse counts; repeated document rows are
judged one by one; an empty table gives no rows; columns of the same names as those used here keep
their values.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrykit.llm import wordhash
from quarrykit.llm.common import PART_BYTES, free_name, lookup, parts, texts_of
from quarrykit.session import stored

SAMPLE = 20_000
WORDS = 256
RIDGE = 1.0
THRESHOLD = 0.5
TARGETS = ("low", "toxic")

#: Letters, digits and non-ASCII bytes make words; A-Z are lower-cased.
_FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))
_COMMON = b".,;:!?'\"()-"
_ODD = bytes(c for c in range(0x21, 0x7F) if not (chr(c).isalnum() or c in _COMMON))
_DIGITS = b"0123456789"
_UPPER = bytes(range(0x41, 0x5B))
STYLE = 8
BLOCK = 512  # words that the distinct share is taken over, so that it does not fall with length
PREFIXES = (4, 5, 6, 7)  # bytes; telling stems stand in many inflected words


def _distinct(words: np.ndarray) -> float:
    """Distinct share of consecutive blocks of BLOCK words: their mean over the whole text, a shorter last block counting by its words."""
    whole = len(words) // BLOCK * BLOCK
    blocks = np.sort(words[:whole].reshape(-1, BLOCK), axis=1)
    n = len(blocks) + int((blocks[:, 1:] != blocks[:, :-1]).sum()) + len(np.unique(words[whole:]))
    return n / max(1, len(words))


def _style(raw: bytes, words: np.ndarray) -> list[float]:
    """Style of one text; shares, so that length alone says little."""
    n, size = max(1, len(words)), max(1, len(raw))
    share = lambda chars: (len(raw) - len(raw.translate(None, chars))) / size
    repeats = float((words[1:] == words[:-1]).sum()) / n
    return [min(1.0, 10 * share(_ODD)), min(1.0, 10 * share(b"|")), min(1.0, 5 * repeats), share(_DIGITS), share(_UPPER), share(_COMMON), _distinct(words), math.log1p(n) / 10]


def _pieces(texts: list[bytes | str | None]) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray]]:
    """Texts a piece at a time; a row for whole words and one for each stem length, with each word's hash (0: too short); where texts begin."""
    for _, held in wordhash.pieces(texts):
        found = wordhash.words([h.translate(_FOLD) for h in held])
        yield held, np.vstack([wordhash.hashes(found), wordhash.prefix_hashes(found, PREFIXES)]).view(np.int64), found.begins


def _features(texts: list[bytes | str | None]) -> Iterator[tuple[list[float], np.ndarray]]:
    """Style of each text and the distinct hashes of its words and their stems."""
    for held, hashed, begins in _pieces(texts):
        for raw, s, e in zip(held, begins[:-1], begins[1:], strict=True):
            every = np.unique(hashed[:, s:e])
            yield _style(raw, hashed[0, s:e]), every[every != 0]


def _vectors(texts: list[bytes | str | None], vocabulary: np.ndarray) -> np.ndarray:
    """Style, then log counts of the vocabulary (sorted hashes)."""
    out, i, n = np.zeros((len(texts), STYLE + len(vocabulary))), 0, len(vocabulary)
    for held, hashed, begins in _pieces(texts):
        at = np.searchsorted(vocabulary, hashed)
        at[at == n] = 0
        at = np.where(vocabulary[at] == hashed, at, n) if n else at
        for raw, s, e in zip(held, begins[:-1], begins[1:], strict=True):
            if e > s:
                out[i, :STYLE] = _style(raw, hashed[0, s:e])
                if n:
                    out[i, STYLE:] = np.log1p(np.bincount(at[:, s:e].ravel(), minlength=n + 1)[:n])
            i += 1
    return out


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
    """Intercept and weights by Newton's method with a ridge; rows are taken in parts, in double precision."""
    n = x.shape[1] + 1
    w, ridge = np.zeros(n), np.full(n, RIDGE)
    ridge[0] = 1e-6
    for _ in range(30):
        curve, slope = np.diag(ridge), -ridge * w
        for i in range(0, len(x), 2048):
            part = np.hstack([np.ones((len(x[i : i + 2048]), 1)), x[i : i + 2048]])
            p = 1 / (1 + np.exp(-np.clip(part @ w, -30, 30)))
            curve += (part * (p * (1 - p))[:, None]).T @ part
            slope += part.T @ (y[i : i + 2048] - p)
        step = np.linalg.solve(curve, slope)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), w[1:]


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> dict:
    """The two classifiers. The ids of the sample are broadcast (at most ``sample`` rows), so texts are not shuffled."""
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), (1 - F.col("quality")).cast("int").alias("low"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and low is not null and toxic is not null")
    known = known.groupBy("doc_id").agg(F.max("low").alias("low"), F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(known), "doc_id")
    # Of several texts under one id the least is taken.
    chosen = stored(texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("low").alias("low"), F.max("toxic").alias("toxic")), "labelled")

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents with each word, by target, counted in each piece before the shuffle."""
        for batch in parts(batches, 1):
            low, toxic = batch.column("low").to_numpy(), batch.column("toxic").to_numpy()
            held = [w for _, w in _features(texts_of(batch, 1))]
            sizes = [len(h) for h in held]
            words, at = np.unique(np.concatenate(held), return_inverse=True) if held else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            count = lambda y: pa.array(np.bincount(at, np.repeat(y, sizes), minlength=len(words)).astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(words), count(np.ones(len(held))), count(low), count(toxic)], names=["word", "n", "low", "toxic"])

    counts = chosen.mapInArrow(present, "word bigint, n bigint, low bigint, toxic bigint").groupBy("word").agg(*(F.sum(c).alias(c) for c in ("n", "low", "toxic"))).where("n >= 5")
    counts = stored(counts, "words")
    n, *bad = chosen.agg(F.count("*"), *(F.sum(t) for t in TARGETS)).first()
    vocabulary: set[int] = set()
    for target, b in zip(TARGETS, bad, strict=True):
        if not n or not 0 < b < n:
            continue
        rate = b / n  # how far a word's share of bad documents lies from the rate, in standard deviations
        z = (F.col(target) - F.col("n") * rate) / F.sqrt(F.col("n") * rate * (1 - rate))
        vocabulary |= {r["word"] for r in counts.select("word", z.alias("z")).orderBy(F.desc("z"), "word").limit(WORDS).collect()}
    words = np.array(sorted(vocabulary), np.int64)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, 1, PART_BYTES // 4):
            x = _vectors(texts_of(batch, 1), words)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("low"), batch.column("toxic"), pa.array([r.astype(np.float32).tobytes() for r in x], pa.binary())], names=["doc_id", "low", "toxic", "x"])

    # At most ``sample`` vectors of STYLE + 2 x WORDS numbers, a partition at a time.
    x, known = np.zeros((n, STYLE + len(words)), np.float32), np.zeros((n, 3), np.int64)
    for i, r in enumerate(chosen.mapInArrow(vectors, "doc_id bigint, low int, toxic int, x binary").toLocalIterator()):
        x[i], known[i] = np.frombuffer(r["x"], np.float32), (r["doc_id"], r["low"], r["toxic"])
    order = np.argsort(known[:, 0], kind="stable")
    x, known = x[order], known[order]
    model: dict = {"words": words}
    for k, (target, b) in enumerate(zip(TARGETS, bad, strict=True), 1):
        if n and 0 < b < n:
            bias, w = _logistic(x, known[:, k].astype(float))
            model[target] = (bias - math.log(b / (n - b)), w)  # without the sample's own prior
    return model


def _scorer(model: dict, text_at: int, names: list[str]):
    """Append each target's log likelihood ratio; 0 without evidence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, text_at, PART_BYTES // 4):
            texts = texts_of(batch, text_at)
            scores = {t: np.zeros(len(texts)) for t in TARGETS}
            for i in range(0, len(texts), 512):
                x = _vectors(texts[i : i + 512], model["words"])
                some = np.array([bool(t) for t in texts[i : i + 512]])
                for t in TARGETS:
                    if t in model:
                        scores[t][i : i + 512] = np.where(some, np.clip(model[t][0] + x @ model[t][1], -30, 30), 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(scores[t]) for t in TARGETS)], names=[*batch.schema.names, *names])

    return run


def scored(docs: DataFrame, model: dict, *, text_col: str = "text", names: list[str] | None = None) -> DataFrame:
    """``docs`` with each target's log likelihood ratio, in columns ``names``."""
    names = names or free_name(docs, *(f"_llr_{t}" for t in TARGETS))
    wider = T.StructType([*docs.schema.fields, *(T.StructField(n, T.DoubleType()) for n in names)])
    return docs.mapInArrow(_scorer(model, docs.columns.index(text_col), names), wider)


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def _probability(logit: Column) -> Column:
    return 1 / (1 + F.exp(-logit))


def _shrunk(groups: DataFrame, target: str, toward: Column) -> Column:
    """A group's rate shrunk toward ``toward``; the concentration comes from the groups' variance."""
    n, rate = F.col("n"), F.col(target) / F.col("n")
    m = groups.agg(
        F.sum("n").alias("n"), F.count("*").alias("g"), F.sum(n * F.pow(rate - toward, 2)).alias("spread"), F.sum(n * toward * (1 - toward)).alias("noise"), F.sum(F.pow(n, 2)).alias("n2")
    ).first()
    # Between-group variance: what the spread exceeds binomial noise by; none means full pooling.
    mean_noise = (m["noise"] or 0) / max(1.0, m["n"] or 0)
    excess = ((m["spread"] or 0) - m["g"] * mean_noise) / max(1e-9, (m["n"] or 0) - (m["n2"] or 0) / max(1.0, m["n"] or 0)) if m["g"] > 1 else 0
    strength = min(1e9, max(1.0, mean_noise / excess - 1)) if excess > 1e-9 else 1e9
    return (F.col(target) + strength * toward) / (n + strength)


def site_rates(scores: DataFrame, labels: DataFrame) -> DataFrame:
    """Posterior rate of each target for every (host, path).

    ``scores`` has doc_id, host, path and the ratios. Labelled documents count as labelled, the
    others with the classifier's probability under the global rate. Groups are summed before
    the shuffle, so a host of a third of all rows is no burden.
    """
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), (1 - F.col("quality")).alias("k_low"), F.col("toxic").alias("k_toxic")).groupBy("doc_id").agg(F.max("k_low").alias("k_low"), F.max("k_toxic").alias("k_toxic"))
    base = known.agg(*(F.avg(f"k_{t}").alias(t) for t in TARGETS)).first()
    prior = {t: min(0.99, max(0.001, base[t] if base[t] is not None else 0.001)) for t in TARGETS}
    soft = [F.coalesce(F.col(f"k_{t}").cast("double"), _probability(F.col(f"_llr_{t}") + math.log(prior[t] / (1 - prior[t])))).alias(t) for t in TARGETS]
    paths = scores.join(known, "doc_id", "left").select("host", "path", *soft).groupBy("host", "path").agg(F.count("*").alias("n"), *(F.sum(t).alias(t) for t in TARGETS))
    paths = stored(paths, "paths")
    hosts = stored(paths.groupBy("host").agg(F.sum("n").alias("n"), *(F.sum(t).alias(t) for t in TARGETS)), "hosts")
    total = hosts.agg(F.sum("n").alias("n"), *(F.sum(t).alias(t) for t in TARGETS)).first()
    for t in TARGETS:
        rate = min(0.999, max(1e-4, (total[t] or 0) / max(1, total["n"] or 0)))
        hosts = hosts.withColumn(f"h_{t}", _shrunk(hosts, t, F.lit(rate)))
    joined = stored(lookup(paths, hosts.select("host", *(f"h_{t}" for t in TARGETS)), ["host"], F.col("path")), "sites")
    for t in TARGETS:
        joined = joined.withColumn(f"rate_{t}", F.greatest(F.lit(1e-4), F.least(F.lit(0.999), _shrunk(joined, t, F.col(f"h_{t}")))))
    return joined.select("host", "path", *(f"rate_{t}" for t in TARGETS))


def _judged(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, host: Column | None, path: Column | None, threshold: float) -> tuple[DataFrame, list[str]]:
    host = F.coalesce((F.col("source") if host is None else host).cast("string"), F.lit(""))
    path = F.coalesce((F.col("lang") if path is None else path).cast("string"), F.lit(""))
    model = fit(docs, labels, id_col=id_col, text_col=text_col)
    at_host, at_path, *ratios = free_name(docs, "_host", "_path", *(f"_llr_{t}" for t in TARGETS))
    rated = free_name(docs, *(f"_rate_{t}" for t in TARGETS))
    said = free_name(docs, *(f"_p_{t}" for t in TARGETS), "_rejected")
    keyed = docs.select(*docs.columns, host.alias(at_host), path.alias(at_path))
    scores = stored(scored(keyed, model, text_col=text_col, names=ratios), "scores")
    narrow = scores.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(at_host).alias("host"), F.col(at_path).alias("path"), *(F.col(n).alias(f"_llr_{t}") for n, t in zip(ratios, TARGETS, strict=True)))
    rates = stored(site_rates(narrow, labels), "rates")
    rates = rates.select(F.col("host").alias(at_host), F.col("path").alias(at_path), *(F.col(f"rate_{t}").alias(n) for n, t in zip(rated, TARGETS, strict=True)))
    out = lookup(scores, rates, [at_host, at_path], F.col(id_col))
    chance = [_probability(F.col(llr) + _logit(F.col(rate))) for llr, rate in zip(ratios, rated, strict=True)]
    out = out.select(*docs.columns, *(p.alias(n) for p, n in zip(chance, said[:-1], strict=True)))
    return out.withColumn(said[-1], F.greatest(*(F.col(n) for n in said[:-1])) >= threshold), said


def judge(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host: Column | None = None, path: Column | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with _p_low, _p_toxic and _rejected; such a name that ``docs`` has itself gets underscores behind it.

    Texts are read for the sample and for the scores, which are kept in the shared folder with
    the rows; they are shuffled only if the table of sites is too large to broadcast, and then
    with a salt.
    """
    return _judged(docs, labels, id_col, text_col, host, path, threshold)[0]


def accepted(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host: Column | None = None, path: Column | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that are not rejected, with its columns only."""
    out, said = _judged(docs, labels, id_col, text_col, host, path, threshold)
    return out.where(~F.col(said[-1])).select(*docs.columns)
