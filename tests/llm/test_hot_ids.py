"""Ids that a third of all rows share, and the classifier's score and decision against a plain computation."""

import collections
import math
import re

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from quarrykit.llm import packing, quality
from quarrykit.session import table

SF = "/root/testdata/sf0.001"


def test_packing_of_ids_with_a_third_of_all_rows(spark, monkeypatch):
    monkeypatch.setattr(packing, "PIECE_ROWS", 500)
    n = 30_000
    hot = F.when(F.col("id") % 3 == 0, None).when(F.col("id") % 3 == 1, 77).otherwise(F.col("id"))
    docs = spark.range(0, n, 1, 6).select(hot.alias("doc_id"), F.when(F.col("id") % 3 == 0, 40).otherwise(F.col("id") % 9).alias("size"))
    out = packing.pack(docs, text_col=None, length_col="size", budget=400).collect()
    assert collections.Counter((r["doc_id"], r["n_tokens"]) for r in out) == collections.Counter((r["doc_id"], r["size"]) for r in docs.collect())
    batches = collections.defaultdict(list)
    for r in out:
        batches[r["batch"]].append(r)
    for b in batches.values():
        assert len({r["padded_to"] for r in b}) == 1 and sorted(r["slot"] for r in b) == list(range(len(b)))
        assert len(b) * b[0]["padded_to"] <= 400
    fewest = sum(-(-c // max(1, 400 // max(1, high))) for high, c in collections.Counter(r["padded_to"] for r in out).items())
    assert len(batches) == fewest  # only a bucket's last batch is not full


def test_packing_counts_alike_rows_before_the_shuffle(spark):
    docs = spark.range(0, 30_000, 1, 6).select(F.lit(None).cast("bigint").alias("doc_id"), (F.col("id") % 2).alias("size"))
    plan = packing.pack(docs, text_col=None, length_col="size")._jdf.queryExecution().executedPlan().toString()
    (scan,) = set(re.findall(r"file:[^\s,\]]*packing-[0-9a-f]+", plan))
    assert spark.read.parquet(scan).count() == 2  # one row an id and length is what is dealt over groups


def test_near_duplicate_stage_with_one_id_in_number(spark):
    real = table(spark, SF, "documents")
    many = spark.range(0, 600, 1, 5).select(F.lit(-5).cast("bigint").alias("doc_id"), F.concat_ws(" ", F.lit("copy"), F.col("id") % 4, F.lit("of a text under one id")).alias("text"))
    for c, kind in real.dtypes:
        if c not in many.columns:
            many = many.withColumn(c, F.lit(None).cast(kind))
    docs = real.unionByName(many.select(*real.columns)).withColumn("_row", F.lit(3))
    out = corpus_pipeline.near_duplicates(spark, docs, SF)
    assert out.columns == docs.columns
    got, plain = collections.Counter(r["doc_id"] for r in out.collect()), collections.Counter(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, real, SF).collect())
    assert got == plain + collections.Counter({-5: 1})
    assert {r["_row"] for r in out.select("_row").distinct().collect()} == {3}


def style(raw, words):
    """The eight figures of a text's style, one by one."""
    count = lambda wanted: sum(map(wanted, raw)) / max(1, len(raw))
    common = b".,;:!?'\"()-"
    odd = lambda c: 0x21 <= c < 0x7F and not chr(c).isalnum() and c not in common
    blocks = [words[i : i + quality.BLOCK] for i in range(0, len(words), quality.BLOCK)]
    repeats = sum(a == b for a, b in zip(words, words[1:], strict=False)) / max(1, len(words))
    return [
        min(1.0, 10 * count(odd)), min(1.0, 10 * count(lambda c: c == 0x7C)), min(1.0, 5 * repeats), count(lambda c: 0x30 <= c <= 0x39), count(lambda c: 0x41 <= c <= 0x5A),
        count(lambda c: c in common), sum(len(set(b)) for b in blocks) / max(1, len(words)), math.log1p(max(1, len(words))) / 10,
    ]


def test_quality_score_and_decision_by_hand(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents").unionByName(table(spark, SF, "documents").limit(1).select(F.lit(-1).cast("bigint").alias("doc_id"), F.lit(None).cast("string").alias("text"), "lang", "source", "n_chars"))
    labels = table(spark, "/root/testdata/sf0.01", "labels")
    model = quality.fit(docs, labels)
    places = {int(w): k for k, w in enumerate(model["words"])}
    hashes: dict[bytes, list[int]] = {}

    def vector(text):
        raw = (text or "").encode()
        words = re.findall(rb"[a-z0-9\x80-\xff]+", raw.lower())
        x = np.zeros(quality.STYLE + len(places))
        if not raw:
            return x
        x[: quality.STYLE] = style(raw, words)
        for word in words:
            if word not in hashes:  # of the word and of its stems, each word by itself
                ((_, one, _),) = quality._pieces([word])
                hashes[word] = one[:, 0].tolist()
            for h in hashes[word]:
                if h in places:
                    x[quality.STYLE + places[h]] += 1
        x[quality.STYLE :] = np.log1p(x[quality.STYLE :])
        return x

    held = {r["doc_id"]: (r["text"], r["source"] or "", r["lang"] or "") for r in docs.collect()}
    made = {i: vector(t) for i, (t, _, _) in held.items()}
    whole = [h[0] for h in hashes.values()]
    assert len(set(whole)) == len(whole)
    known = collections.defaultdict(lambda: (0, 0))
    for r in labels.collect():
        known[r["doc_id"]] = tuple(map(max, known[r["doc_id"]], (1 - r["quality"], r["toxic"])))
    x = np.array([made[i].astype(np.float32) for i in known if i in made], np.float64)
    ratios = {}
    for k, target in enumerate(quality.TARGETS):
        y = np.array([v[k] for i, v in known.items() if i in made])
        bias, w = model[target]
        p = 1 / (1 + np.exp(-(bias + math.log(y.sum() / (len(y) - y.sum())) + x @ w)))
        # Where the penalised likelihood is greatest its slope is nought.
        assert abs((y - p).sum()) < 1e-3 and np.abs(x.T @ (y - p) - quality.RIDGE * w).max() < 1e-3
        ratios[target] = {i: float(np.clip(bias + v @ w, -30, 30)) if held[i][0] else 0.0 for i, v in made.items()}
    scores = spark.createDataFrame([(i, h, p, *(ratios[t][i] for t in quality.TARGETS)) for i, (_, h, p) in held.items()], "doc_id bigint, host string, path string, _llr_low double, _llr_toxic double")
    rates = {(r["host"], r["path"]): r for r in quality.site_rates(scores, labels).collect()}
    for r in quality.judge(docs, labels).collect():
        _, host, path = held[r["doc_id"]]
        chance = []
        for t in quality.TARGETS:
            rate = rates[host, path][f"rate_{t}"]
            chance.append(1 / (1 + math.exp(-(ratios[t][r["doc_id"]] + math.log(rate / (1 - rate))))))
        assert np.allclose(chance, [r["_p_low"], r["_p_toxic"]], atol=1e-6)
        assert r["_rejected"] == (max(chance) >= quality.THRESHOLD)
