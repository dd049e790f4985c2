"""Whitening, spelling variants and repeated bytes against brute force, with nulls, empties, ties, repeats and clashing columns."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np

from quarrykit.llm import spelling, suffixes, whitening

VECTORS = "vec_id bigint, embedding array<float>, label int, component string, n string"


def test_spectrum_slicing_finds_numbers_and_certifies_eigenpairs():
    rng = np.random.default_rng(0)
    for turn in range(12):
        d = int(rng.integers(2, 40))
        turned, _ = np.linalg.qr(rng.standard_normal((d, d)))
        values = np.sort(rng.choice([5.0, 3.0, 3.0 + 1e-9, 1.0, 0.0], d) if turn % 2 else rng.standard_normal(d) ** 2 * 10 ** rng.uniform(-3, 4))[::-1]
        matrix = turned @ np.diag(values) @ turned.T
        matrix = (matrix + matrix.T) / 2
        for shift in rng.uniform(-1, values[0] + 1, 5):
            assert whitening.above(matrix, shift) == (np.linalg.eigvalsh(matrix) > shift).sum()
        found, vectors = whitening.leading(matrix)
        k = len(found)
        assert k == min(16, (values > 1e-12 * values[0]).sum())
        assert np.allclose(found, values[:k], rtol=0, atol=1e-13 * values[0]) and np.abs(matrix @ vectors - vectors * found).max() < 1e-13 * values[0] and np.abs(vectors.T @ vectors - np.eye(k)).max() < 1e-14
    assert whitening.above(np.array([[0.0, 1.0], [1.0, 0.0]]), 0.0) == 1 and len(whitening.leading(np.zeros((3, 3)))[0]) == 0


def _vectors():
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 1 / (1 + k)) + (rng.random() if k < 2 else 0) for k in range(20)], i % 3, "x", "y") for i in range(300)]
    rows += [(i, rows[7][1], 0, None, None) for i in range(300, 400)] + [(7, rows[8][1], 0, "", ""), (None, rows[9][1], 0, "", "")]
    odd = [None, [], [1.0] * 19, [1.0] * 19 + [None], [1.0] * 19 + [math.nan], [math.inf] * 20, [3e38] * 20]
    return rows, rows + [(900 + k, v, 0, "", "") for k, v in enumerate(odd)]


def test_whitening(spark):
    good, every = _vectors()
    got = whitening.whiten(spark.createDataFrame(every, VECTORS).repartition(5)).toPandas()
    x = [[math.floor(64 * float(np.float32(c))) + 1000000 for c in v] for _, v, *_ in good]
    fit = sorted(set(map(tuple, x)))
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    exact = np.array([[n * c - s for c, s in zip(v, sums, strict=True)] for v in fit], float) / n
    values, vectors = np.linalg.eigh(exact.T @ exact / n)
    values, vectors = values[::-1][:16], vectors[:, ::-1][:, :16]
    assert sorted(map(repr, got[got.component == 1].vec_id.astype("Int64"))) == sorted(map(repr, got[got.component == 16].vec_id.astype("Int64"))) and len(got) == 16 * len(good) and set(got.n) == {n}
    held = collections.defaultdict(list)
    for r in got.itertuples():
        held[None if r.vec_id != r.vec_id else int(r.vec_id), r.component].append(r)
    signs = np.sign([next(held[0, k + 1][0].whitened for _ in "1") * ((np.array(x[0]) - np.array(sums) / n) @ vectors[:, k]) for k in range(16)])
    for (i, *_), own in zip(good, x, strict=True):
        deviation = sum((n * c - s) ** 2 for c, s in zip(own, sums, strict=True))
        want = (np.array([n * c - s for c, s in zip(own, sums, strict=True)]) / n) @ vectors / np.sqrt(values) * signs
        for k in range(16):
            (r,) = [r for r in held[i, k + 1] if r.deviation == deviation][:1]
            assert abs(r.whitened - want[k]) < 1e-9 and abs(r.explained - values[k] / np.trace(exact.T @ exact / n)) < 1e-12 and r.identity_error < 1e-9
    assert whitening.whiten(spark.createDataFrame([], VECTORS)).count() == 0
    assert whitening.whiten(spark.createDataFrame(good[7:8] * 3, VECTORS)).count() == 0
    two = whitening.whiten(spark.createDataFrame(good[:2], VECTORS)).collect()
    assert [r["component"] for r in two] == [1, 1] and abs(abs(two[0]["whitened"]) - 1) < 1e-12


def test_whitening_is_exact_where_products_go_beyond_64_bits(spark):
    rows = [(k, [float((k * 2654435761) % (1 << 46)), float(k)]) for k in range(50)]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"))
    x = [[math.floor(64 * c) + 1000000 for c in v] for _, v in rows]
    sums = [sum(c) for c in zip(*x, strict=True)]
    want = {k: sum((50 * c - s) ** 2 for c, s in zip(v, sums, strict=True)) for k, v in enumerate(x)}
    for r in got.collect():
        assert r["deviation"] == (want[r["vec_id"]] if want[r["vec_id"]] < 1 << 63 else None)


def _near(a, b):
    a, b = (a, b) if len(a) >= len(b) else (b, a)
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def test_acceptor_composes_to_the_near_pairs():
    r = random.Random(1)
    for _ in range(300):
        words = {"".join(r.choice("abc"[: r.randint(1, 3)]) for _ in range(r.randint(0, 6))) for _ in range(r.randint(1, 40))}
        acceptor = spelling.Acceptor(list(words))
        got = list(acceptor.composed())
        assert len(got) == len({frozenset(p) for p in got}) and {frozenset(p) for p in got} == {frozenset(p) for p in itertools.combinations(words, 2) if _near(*p)}
        assert set(acceptor.language(acceptor.start)) == words
    assert len(spelling.Acceptor([a + "xyz" + b for a in "abcd" for b in "ef"]).final) == 3  # equal states are one


def _spellings():
    r = random.Random(3)
    base = ["".join(r.choice("abé") for _ in range(r.randint(6, 10))) for _ in range(60)] + ["straße" + "n" * 4, "a" * 7, "a" * 8, "a" * 9, "ÀÉÎõüñçø", "x" * 3000]
    docs = []
    for i in range(120):
        words = [r.choice(base[: 5 + i % 60]) for _ in range(40)]
        words = [w[:3] + r.choice("abz") + w[4:] if r.random() < 0.1 else w.upper() if r.random() < 0.1 else w for w in words]
        docs.append((i, " ".join(words)))
    long = " ".join(base[k % len(base)] for k in range(20000))
    return docs + [(500, None), (501, ""), (502, long), (503, "12345 ,,"), (503, docs[0][1]), (None, docs[1][1]), (504, base[-1]), (505, "_" + base[0] + "9" + base[0])]


def _expected(docs):
    n = collections.Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}
    near = {w: [v for v in n if abs(len(v) - len(w)) < 2 and _near(v, w)] for w in n}
    form = {w: (lambda best: best if best and n[best] >= 10 * n[w] else None)(min(near[w], key=lambda v: (-n[v], v), default=None)) for w in n}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted(((w, form[w], root(w), n[w], len(near[w]), n.get(form[w])) for w in n), key=repr)


def test_spelling_variants(spark):
    docs = _spellings()
    frame = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id bigint, text string, word string, n int").repartition(4)
    want = _expected(docs)
    assert any(w[1] for w in want) and any(w[4] > 3 for w in want)
    for most in (spelling.GROUP_ROWS, 2):
        assert sorted(map(tuple, spelling.variants(frame, group_rows=most).collect()), key=repr) == want
    assert spelling.variants(frame.limit(0)).count() == 0


def test_roots_follow_long_chains(spark):
    chain = [(f"w{k:03}", f"w{k + 1:03}" if k < 40 else None) for k in range(41)] + [("alone", None)]
    got = {r["word"]: r["root"] for r in spelling.roots(spark.createDataFrame(chain, "word string, form string")).collect()}
    assert got == {f"w{k:03}": "w040" for k in range(40)}


def _texts(r, window):
    base = [bytes(r.choice(b"ab" if r.random() < 0.3 else bytes(range(97, 123))) for _ in range(r.randint(1, 600))) for _ in range(4)]
    base += [b"a" * r.randint(1, 900), b"\0" * 300, b"abc" * r.randint(1, 200), "é".encode() * 90]
    cut = lambda b: b[r.randint(0, len(b) // 2) :][: r.randint(1, len(b))]
    return [b"".join(cut(r.choice(base)) for _ in range(r.randint(1, 4))) for _ in range(r.randint(1, 12))]


def _repeated(texts, window):
    seen = collections.Counter(t[i : i + window] for t in texts for i in range(len(t) - window + 1))
    return [[seen[t[i : i + window]] > 1 for i in range(len(t) - window + 1)] for t in texts]


def test_corpus_order_finds_the_repeated_windows():
    r = random.Random(5)
    for _ in range(150):
        window = r.choice([32, 40, 64, 200])
        texts, of = _texts(r, window), suffixes.shape(window)
        assert suffixes.repeated(texts, of).tolist() == [f for t in _repeated(texts, window) for f in t]
        joined, stands, windows = b"".join(texts), {}, 0
        found = suffixes.stretches(texts, suffixes.Hashes(joined), of)
        for s, e, k in zip(found.start.tolist(), found.edges.tolist(), found.key.tolist(), strict=True):
            windows += e
            assert all(stands.setdefault(joined[i : i + window], k) == k for i in range(s, s + e))
        assert windows == sum(max(0, len(t) - window + 1) for t in texts)


def test_repeated_bytes(spark):
    r = random.Random(6)
    texts = [t.decode("utf-8", "replace") for _ in range(8) for t in _texts(r, 64)]
    docs = [(i, t) for i, t in enumerate(texts)] + [(900, None), (901, ""), (902, texts[0]), (902, texts[0]), (903, texts[1]), (903, texts[2]), (None, texts[3]), (None, "unlike others " * 3)]
    docs += [(904, " ".join(f"w{i * 7919 % 5003}" for i in range(9000)) + texts[4]), (905, "x" * 64), (906, "y" * 63), (907, "zq" * 40)]
    frame = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id bigint, text string, id string, start int").repartition(5)
    for window, hot in ((64, suffixes.HOT), (64, 2), (200, suffixes.HOT)):
        raw = [(t or "").encode() for _, t in docs]
        want = []
        for (i, _), t, flags in zip(docs, raw, _repeated(raw, window), strict=True):
            gone = np.zeros(len(t), bool)
            for k in np.flatnonzero(flags):
                gone[k : k + window] = True
            left = np.frombuffer(t, np.uint8)[~gone].tobytes()
            want.append((i, len(t), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.view(np.int8)])) == 1).sum()), hashlib.sha256(left).hexdigest()))
        got = suffixes.remove_repeats(frame, window=window, hot=hot).collect()
        assert sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got), key=repr) == sorted(want, key=repr)
        assert all(r["kept"] is None or hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"] for r in got)
    assert suffixes.remove_repeats(frame.limit(0)).count() == 0
