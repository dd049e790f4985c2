"""The pipeline operators against brute force, with nulls, empties, ties, repeats and clashing columns."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrykit.llm import chat, decontaminate, files, minhash, packing, quality, secrets, substrings, tokenids, vectors, warc
from quarrykit.session import table

SF = "/root/testdata/sf0.001"
LOWER = {i: i + 32 for i in range(65, 91)}
LONG = " ".join(f"w{i * 7919 % 5003}" for i in range(20000))
BASE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega one two three four five six"
NEAR = BASE + " seven"
ODD = [
    (1, BASE), (2, BASE), (3, NEAR), (4, "Unlike " + BASE[::-1]), (5, None), (6, ""), (7, " \t\n"), (8, LONG), (9, "one"), (10, "one two three"), (10, "one two three"),
    (None, BASE), (11, "start of it: " + BASE + " and an end"), (12, "naïve ⅷ " + BASE.upper()), (13, (BASE + "\n") * 3),
]


def odd(spark, extra="n_words"):
    """Documents with every awkward case, and a column whose name clashes."""
    rows = spark.createDataFrame([(i, t, "en", "s", 0, "x") for i, t in ODD], f"doc_id bigint, text string, lang string, source string, n_chars bigint, {extra} string")
    return rows.repartition(3)


def both(spark, extra="n_words"):
    real = table(spark, SF, "documents").withColumn(extra, F.lit("x"))
    return real.withColumn("doc_id", F.col("doc_id") + 1000).unionByName(odd(spark, extra))


def held(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def empty(spark):
    return spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_decontamination(spark):
    docs = both(spark)
    bench = [(r["item_id"], r["text"]) for r in table(spark, SF, "benchmark").collect()] + [(900, "one two three"), (901, None), (902, " "), (None, BASE), (903, BASE), (903, BASE)]
    items = spark.createDataFrame(bench, "item_id bigint, text string")
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    want = []
    for i, t in held(docs):
        words, hit, found = word.findall((t or "").translate(LOWER)), set(), set()
        for item, text in bench:
            w = word.findall((text or "").translate(LOWER))
            if item is None or not w:
                continue
            n = min(13, len(w))
            windows = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
            for k in range(len(words) - n + 1):
                if tuple(words[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    found.add(str(item))
        want.append((i, len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(words)))
    columns = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert rows(decontaminate.decontaminate(docs, items), *columns) == sorted(want, key=repr)
    assert rows(decontaminate.decontaminate(docs, items, block_bytes=3000), *columns) == sorted(want, key=repr)
    clean = collections.Counter(w[0] for w in want if not w[5])
    assert collections.Counter(r["doc_id"] for r in decontaminate.clean_rows(docs, items, block_bytes=3000).collect()) == clean
    clashing = docs.select("*", *(F.lit(c).alias(c) for c in ("_hit", "_items", "_digest", "_salt", "digest")))
    for size in (decontaminate.BLOCK_BYTES, 3000):
        left = decontaminate.clean_rows(clashing, items, block_bytes=size)
        assert left.columns == clashing.columns and {r["_hit"] for r in left.collect()} == {"_hit"} and left.count() == sum(clean.values())
    assert decontaminate.decontaminate(empty(spark), items).count() == 0
    assert decontaminate.decontaminate(docs, items.limit(0)).where("contaminated or n_hit > 0").count() == 0
    spans = {r["doc_id"]: r["spans"] for r in decontaminate.decontaminate(odd(spark), items).collect()}
    assert [ODD[12][1][s["start"] : s["end"]] for s in spans[11]] == [BASE]


def test_secrets(spark):
    import base64
    import gzip
    from urllib.parse import quote

    secret = 'password = "abcdefghijkl"'
    layered = {
        "url": quote(secret), "unicode": secret.replace("=", "\\u003d").replace(" ", "\\u0020"), "base64": base64.b64encode(secret.encode()).decode(), "twice": base64.b64encode(quote(secret).encode()).decode(),
        "gzip": base64.b64encode(gzip.compress(secret.encode() * 3)).decode(), "url of base64": quote(base64.b64encode(secret.encode()).decode(), safe=""),
    }
    part = {"url": quote(secret[:-1]), "unicode": layered["unicode"][:-1], "base64": base64.b64encode(secret[:-1].encode()).decode().rstrip("="), "twice": base64.b64encode(quote(secret[:-1]).encode()).decode().rstrip("="), "gzip": layered["gzip"], "url of base64": quote(base64.b64encode(secret[:-1].encode()).decode().rstrip("="), safe="")}
    for name, text in layered.items():
        found = secrets.report(f"é {text} end")
        spans = [tuple(map(int, x.split(":")[1:])) for x in found[4].split(",")]
        assert found[:3] == (0, 0, 0) and any(s == 2 and abs(e - 2 - len(part[name])) <= 1 for s, e in spans), (name, spans)
    # Spans point at what was encoded, wherever it stands in its layer.
    for word in ("x", "one two", "naïve ⅷ", "\U0001f600 "):
        inside = f"{word} {secret} tail of it"
        for text in (quote(inside), "".join(c if c == "\\" or c.isalnum() else f"\\u{u:04x}" if (u := ord(c)) < 65536 else "\\ud83d\\ude00" for c in inside), base64.b64encode(inside.encode()).decode(), base64.b64encode(quote(inside).encode()).decode(), quote(base64.b64encode(inside.encode()).decode(), safe="")):
            (span,) = {tuple(map(int, x.split(":")[1:])) for x in secrets.report(f"a {text} z")[4].split(",") if x.startswith("assign")}
            before, own = 2 + len(text) * len(f"{word} ".encode()) // (2 * len(inside.encode())), 2 + len(text)
            assert span[0] >= before and span[1] <= own - len(text) * 5 // (2 * len(inside)), (word, text, span)
            cut = f"a {text} z"[: span[0]] + f"a {text} z"[span[1] :]
            assert "assign" not in secrets.report(cut)[4], (word, cut)
    cases = ["token=secret:abcdefghijklmn", "Api_Key : 0123456789ab", "api-key=0123456789ab", "PASSWD='" + "x" * 11, "AKIA" + "A" * 14, "AKIA" + "A" * 13, "f" * 16, "f" * 15 + "F", "ſecret=abcdefghijkl", "a" * 200000, "%41" * 50000, "A" * 100001 + "%"]
    pattern = re.compile(r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII)
    docs = both(spark).unionByName(spark.createDataFrame([(500 + k, c, "", "", 0, "") for k, c in enumerate(cases)], odd(spark).schema))
    got = {}
    for r in secrets.find_secrets(docs).collect():
        got.setdefault(r["doc_id"], []).append(r)
    for i, t in held(docs):
        t = t or ""
        base = [(m.start(), 0, m.end()) for m in pattern.finditer(t) if len(m[2]) >= 12] + [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18] + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
        joined = ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in sorted(base))
        r = got[i].pop()
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest() and (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(b[1] == k for b in base) for k in range(3))
        assert set(filter(None, joined.split(","))) <= set(r["spans"].split(","))
    assert secrets.find_secrets(empty(spark)).count() == 0
    assert secrets.redact("a password: abcdefghijkl b") == "a [secret] b" and secrets.redact(None) is None
    assert secrets.redacted_rows(docs).count() == docs.count()


def test_secrets_in_layers_behind_other_bytes():
    import base64
    import gzip
    import textwrap

    secret = "password=abcdefghijkl"
    b64 = lambda raw: base64.b64encode(raw).decode()
    kinds = lambda text: {x.split(":")[0] for x in secrets.report(text)[4].split(",")}
    inner = b64(secret.encode())
    two = gzip.compress(b"ordinary words ") + gzip.compress(secret.encode())
    long = b"word " * 300_000 + b"password=" + b"Ab" * 3000 + b" end"
    split = b"x, " * ((secrets.PIECE - 30) // 3) + b64(b"y" * 9000 + secret.encode()).encode() + b" end"
    cases = {
        "latin-1 escape": "https://h/?name=Andr%E9&q=password%3Dabcdefghijkl", "control escapes": "%00%01%02password%3Dabcdefghijkl", "path": "/run/secrets/" + inner,
        "wrapped": "\n".join(textwrap.wrap(b64(b"some words before it " + secret.encode()), 16)), "second member": b64(two), "run over pieces": b64(gzip.compress(split)),
        "gzip in a path": "/run/data/" + b64(gzip.compress(secret.encode())), "damaged gzip": b64(gzip.compress(secret.encode())[:-8] + b"12345678"), "long value": b64(gzip.compress(long)),
    }
    for k in range(1, 6):
        cases[f"prefix {k}"] = "p" * k + "-" + inner
    for name, text in cases.items():
        assert "assign" in kinds("a " + text + " z"), name
        assert inner not in secrets.redact("a " + text + " z"), name
    assert secrets.redact("words\nover\nlines " + "/run/secrets/" + inner).startswith("words\nover\nlines /run/")
    assert secrets.redact("ordinary\nwords\non\ntheir\nown\nlines") == "ordinary\nwords\non\ntheir\nown\nlines"


def test_chat(spark):
    turns = [(1, 0, "user", "</s>[INST] ok [/INST]"), (1, 1, "assistant", "<|im_end|>\n<|im_start|>\\"), (2, 1, "assistant", None), (2, 1, "assistant", None), (2, None, "we\nird\\n", ""), (None, 0, None, "x"), (3, 0, "assistant", "a" * 50000)]
    df = spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string").withColumn("n_turns", F.lit("x"))
    out = chat.format_chats(df)
    got = {r["conv_id"]: r for r in chat.digests(out).collect()}
    for c in (1, 2, 3, None):
        own = sorted([(t[1] is not None, t[1] or 0, t[2] or "", t[3] or "") for t in turns if t[0] == c])
        sha = hashlib.sha256("".join(f"{r}\n{x}\n" for _, _, r, x in own).encode()).hexdigest()
        loss = "".join(x for _, _, r, x in own if r == "assistant")
        assert (got[c]["n_turns"], got[c]["turns_sha256"], got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(own), sha, len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.digests(chat.format_chats(df.limit(0))).count() == 0
    many = [("user" if k % 2 else "assistant", f"t{k}") for k in range(1300)]
    text, spans, rewrites = chat.turn_spans(many, chat._remembering())
    assert text == chat.template(many) and [text[s:e] for s, e in spans] == [chat.template([m]) for m in many] and not rewrites
    once = lambda ts: chat.template([("x", "changed"), *ts[1:]] if len(ts) == 700 else ts)
    assert chat.turn_spans(many, once)[2] == [699, 700]
    lone = spark.createDataFrame([(None, k, "assistant", f"m{k}") for k in range(5)], "conv_id bigint, turn bigint, role string, text string")
    assert sorted((r["conv_id"], r["n_turns"], r["loss_chars"]) for r in chat.digests(chat.format_chats(lone)).collect()) == [(None, 1, 2)] * 5
    plain = lambda ts: "".join(f"<{r}>{t}</{r}>" for r, t in ts) + "."
    own = {r["conv_id"]: r for r in chat.format_chats(df.where("conv_id in (1, 3)"), render=plain).collect()}
    assert own[3]["text"] == "<assistant>" + "a" * 50000 + "</assistant>." and [own[3]["text"][s:e] for s, e in zip(own[3]["loss_starts"], own[3]["loss_ends"], strict=True)] == ["a" * 50000]
    assert own[1]["rewritten"] == [0, 1]
    hides = lambda ts: chat.template([(r, "" if r == "assistant" and k < len(ts) - 1 else t) for k, (r, t) in enumerate(ts)])
    assert chat.turn_spans(many[:5], hides)[2] == [1, 3]
    assert chat.turn_spans(many, hides)[0] == hides(many)


def shingles(text, size):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


@pytest.mark.parametrize("size", [4, 5])
def test_minhash(spark, size):
    docs = both(spark, "kept")
    texts = held(docs)
    sets = [(i, shingles(t, size)) for i, t in texts]
    parent = {i: i for i, _ in sets if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    named = [(i, s) for i, s in sets if i is not None and s]
    where = collections.defaultdict(list)
    for k, (_, s) in enumerate(named):
        for g in s:
            where[g].append(k)
    for a, b in {(x, y) for g in where.values() for x in g for y in g if x < y}:
        n = len(named[a][1] & named[b][1])
        if 100 * n >= 80 * (len(named[a][1]) + len(named[b][1]) - n):
            x, y = root(named[a][0]), root(named[b][0])
            parent[max(x, y)] = min(x, y)
    want = sorted(((i, len(s), None if i is None else root(i), i is None or root(i) == i) for i, s in sets), key=repr)
    assert rows(minhash.near_duplicates(docs, size=size), "doc_id", "n_shingles", "component_id", "kept") == want
    assert minhash.near_duplicates(empty(spark)).count() == 0


def test_group_of_near_copies_is_one_component(spark):
    rng = np.random.default_rng(5)
    words = [f"w{k}" for k in range(150)]
    made = []
    for i in range(120):
        own = list(words)
        for at in rng.choice(150, int(rng.integers(0, 9)), replace=False):
            own[at] = f"x{i}-{at}"
        made.append((i, " ".join(own)))
    docs = spark.createDataFrame(made, "doc_id bigint, text string")
    sets = {i: shingles(t, 5) for i, t in made}
    label = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                n = len(sets[a] & sets[b])
                if label[b] < label[a] and 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
                    label[a], changed = label[b], True
    assert {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs).collect()} == label


def test_substrings(spark):
    docs = both(spark, "n_removed")
    texts = held(docs)
    split = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in texts]
    first = {}
    for i, w in split:
        if i is not None:
            for k in range(len(w) - 19):
                g = tuple(w[k : k + 20])
                first[g] = min(first.get(g, (i, k)), (i, k))
    want = []
    for i, w in split:
        gone = set()
        if i is not None:
            for k in range(len(w) - 19):
                if first[tuple(w[k : k + 20])] != (i, k):
                    gone |= set(range(k, k + 20))
        want.append((i, len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()))
    assert rows(substrings.remove_repeats(docs), "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(want, key=repr)
    assert substrings.remove_repeats(empty(spark)).count() == 0


def thue_morse(n):
    """Two strings of n letters that polynomial hashes modulo 2^64 do not tell apart, whatever their base."""
    bits = [bin(i).count("1") & 1 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_words_that_break_polynomial_hashes(spark):
    s, t = thue_morse(1024)
    docs = spark.createDataFrame([(1, f"one {s} two three"), (2, f"one {t} two three"), (3, f"{s} {BASE[:30]}"), (4, f"{t} {BASE[:30]}")], "doc_id bigint, text string")
    assert all(r["kept"] for r in minhash.near_duplicates(docs, size=4).collect())
    one, other = minhash.exact_sets([f"one {s} two three".encode(), f"one {t} two three".encode()], 4)
    assert not set(one.tolist()) & set(other.tolist())
    passage = " ".join(f"v{k}" for k in range(19))
    docs = spark.createDataFrame([(1, f"{passage} {s} end"), (2, f"{passage} {t} end")], "doc_id bigint, text string")
    assert [r["n_removed"] for r in substrings.remove_repeats(docs).collect()] == [0, 0]


def test_substring_paths_hot_and_branching(spark):
    rng = np.random.default_rng(4)
    passages = [" ".join(f"p{j}x{k}" for k in range(70)) for j in range(4)]
    made = []
    for i in range(400):
        body = [f"d{i}w{k}" for k in range(int(rng.integers(0, 40)))]
        for j in rng.choice(4, int(rng.integers(0, 4)), replace=True):
            cut = sorted(rng.choice(71, 2, replace=False).tolist())
            body += passages[j].split()[cut[0] : cut[1]] if rng.random() < 0.5 else passages[j].split()
        made.append((i, " ".join(body)))
    made += [(5, made[5][1]), (6, made[7][1] + " " + made[9][1])]  # an id with equal texts, and one with different texts
    docs = spark.createDataFrame(made, "doc_id bigint, text string").repartition(3)
    first = {}
    for i, t in made:
        w = t.split()
        for k in range(len(w) - 19):
            g = tuple(w[k : k + 20])
            first[g] = min(first.get(g, (i, k)), (i, k))
    want = []
    for i, t in made:
        w, gone = t.split(), set()
        for k in range(len(w) - 19):
            if first[tuple(w[k : k + 20])] != (i, k):
                gone |= set(range(k, k + 20))
        want.append((i, len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()))
    assert rows(substrings.remove_repeats(docs), "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(want, key=repr)
    with pytest.raises(ValueError):
        substrings.remove_repeats(docs, window=67)


def test_substrings_again_where_hashes_meet(spark, monkeypatch):
    """An attempt that finds other words at a source than at its copy gives nothing; the next salt is taken."""
    weak = substrings._attempt
    tried = []
    monkeypatch.setattr(substrings, "_attempt", lambda *a: tried.append(a[-1]) or (None if a[-1] == 0 else weak(*a)))
    docs = spark.createDataFrame([(1, " ".join(f"v{k}" for k in range(30))), (2, " ".join(f"v{k}" for k in range(30)))], "doc_id bigint, text string")
    assert sorted(r["n_removed"] for r in substrings.remove_repeats(docs).collect()) == [0, 30] and tried == [0, 1]


def test_packing(spark):
    docs = both(spark, "bucket")
    out = packing.pack(docs, budget=4096, group_rows=16).collect()
    assert sorted((r["doc_id"] or -1, r["n_tokens"]) for r in out) == sorted((i or -1, len((t or "").split())) for i, t in held(docs))
    batches = collections.defaultdict(list)
    for r in out:
        assert r["padded_to"] >= r["n_tokens"] and r["padding"] == r["padded_to"] - r["n_tokens"]
        batches[r["batch"]].append(r)
    for b in batches.values():
        assert len(b) == 1 or len(b) * b[0]["padded_to"] <= 4096
        assert len({r["padded_to"] for r in b}) == 1 and sorted(r["slot"] for r in b) == list(range(len(b)))
    assert packing.pack(empty(spark)).count() == 0
    import itertools

    assert len(batches) <= sum(-(-c // max(1, 4096 // max(1, high))) for high, c in collections.Counter(r["padded_to"] for r in out).items())  # only a bucket's last batch is not full
    rng = np.random.default_rng(3)
    for _ in range(60):  # the programme's padding is the least of all choices of bounds, and of equal ones the lowest
        n = int(rng.integers(1, 10))
        lengths = [(m, c) for m, c in zip(sorted(rng.choice(40, n, replace=False).tolist()), rng.integers(1, 6, n).tolist(), strict=True)]
        k = int(rng.integers(1, 6))
        pad = lambda bounds: sum((min(b for b in bounds if b >= m) - m) * c for m, c in lengths)
        every = [(*some, lengths[-1][0]) for some in itertools.combinations([m for m, _ in lengths[:-1]], min(k, n) - 1)]
        got = tuple(packing.best_bounds(lengths, k))
        assert pad(got) == min(map(pad, every)) and got in every
    assert packing.best_bounds([(m, 1) for m in range(200_000)], 8)[-1] == 199_999


def test_token_files(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    library = Tokenizer.from_file(path)
    one, other = thue_morse(1024)
    cases = [f"x {one} y", f"x {other} y", " a", "a ", "  a  b", "é à\u00a0ñ b", "<|endoftext|> x <|endoftext|>", "日本 語\u3000x y", "it's we'll\n\n x\ty", " ".join(f"q{k}é" for k in range(3000)), "\u0085 x \u2003y z", "a\x1f b"]
    encoder = tokenids.Encoder(open(path, encoding="utf-8").read())
    for _ in range(2):
        assert [x.tolist() for x in encoder.encode(cases)] == [library.encode(c, add_special_tokens=False).ids for c in cases]
    docs = both(spark, "start")
    manifest = tokenids.write_tokens(docs, path)
    got = tokenids.read_documents(manifest).collect()
    texts = sorted(((i is not None, i or 0, t or "") for i, t in held(docs)))
    assert collections.Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == collections.Counter(
        (i if some else None, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for some, i, t in texts for ids in [library.encode(t, add_special_tokens=False).ids + [0]]
    )
    starts = sorted((r["start"], r["n_tokens"], r["doc_id"]) for r in got)
    assert all(a[0] + a[1] == b[0] for a, b in zip(starts, starts[1:], strict=False)) and [s[2] for s in starts if s[2] is not None] == sorted(s[2] for s in starts if s[2] is not None)
    assert tokenids.read_documents(tokenids.write_tokens(empty(spark), path)).count() == 0
    held_file = tokenids.TokenFile(files.Source(manifest.collect()[0]["file"]))
    every = held_file.tokens(0, held_file.n_tokens)
    assert [held_file.token(i) for i in range(0, held_file.n_tokens, 997)] == every[::997].tolist()
    ids = np.array([0, 255, 256, 65535, 65536, 2**32 - 1] * 700, np.uint32)
    levels = tokenids.levels(ids)
    assert len(levels) == 4 and [len(c) for c, _ in levels] == [4200, 2800, 1400, 700]


def test_warc(spark, tmp_path):
    html = "<p>" + "é" * 2000
    pages = [(1, "http://a/\r\nX: y", html), (2, None, html), (5, "u", html), (3, "u", None), (4, "u", "x"), (6, "u", "x"), (7, "u", "WARC/1.1\r\n" * 500), (None, "u", html), (8, "u", "z" * 999), (9, "u", "z" * 999)]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string").withColumn("digest", F.lit("x"))
    manifest = warc.archive(df)
    got = {r["page_id"]: r for r in warc.read_archives(manifest).collect()}
    for i, _, h in pages:
        raw = (h or "").encode()
        target = 5 if raw == html.encode() and i != 5 else None
        r = got[i]
        assert (r["kind"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) == ("record", len(raw), hashlib.sha1(raw).hexdigest(), "response" if target is None else "revisit", target)
    assert warc.read_archives(warc.archive(df.limit(0))).count() == 0
    payloads = {r["page_id"]: bytes(r["payload"]) for r in warc.read_archives(manifest, with_payload=True).collect() if r["record_type"] == "response"}
    assert payloads[7] == b"WARC/1.1\r\n" * 500


def damaged(parts, spoil):
    raw = bytearray(b"".join(parts))
    spoil(raw)
    return bytes(raw)


@pytest.mark.parametrize("pack", [lambda r: r, warc._member])
@pytest.mark.parametrize("where", [0, 1, 2])
def test_salvage_recovers_what_follows(tmp_path, pack, where):
    plain = [warc.record(i, "http://x", (f"page {i} " * 40).encode(), None, "d") for i in range(4)]
    parts = [pack(r) for r in plain]
    starts = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    at = int(starts[where] + len(parts[where]) // 2)

    def spoil(raw):
        raw[at : at + 4] = b"\xff\xfe\xfd\xfc"

    (tmp_path / "x").write_bytes(damaged(parts, spoil))
    found = list(warc.salvage(files.Source(str(tmp_path / "x"), block=256)))
    ids = [warc._page_of(h["warc-record-id"]) for kind, _, _, h, _ in found if kind == "record"]
    gaps = [(o, n) for kind, o, n, _, _ in found if kind == "gap"]
    assert ids == [i for i in range(4) if i != where] and gaps == [(int(starts[where]), len(parts[where]))]
    (tmp_path / "y").write_bytes(b"".join(parts)[:-10])
    tail = list(warc.salvage(files.Source(str(tmp_path / "y"))))
    assert [k for k, *_ in tail] == ["record"] * 3 + ["gap"]


def test_salvage_inside_members(tmp_path):
    plain = [warc.record(i, "http://x", hashlib.sha512(b"%d" % i).hexdigest().encode() * 40, None, "d") for i in range(6)]
    sizes = np.cumsum([len(r) for r in plain])
    spoilt = bytearray(b"".join(plain))
    spoilt[int(sizes[1]) + 700] ^= 1  # record 2

    def read(raw):
        (tmp_path / "x").write_bytes(raw)
        found = list(warc.salvage(files.Source(str(tmp_path / "x"), block=256)))
        return [warc._page_of(h["warc-record-id"]) for kind, _, _, h, _ in found if kind == "record"], [(o, n, h["reason"]) for kind, o, n, h, _ in found if kind == "gap"]

    one = warc._member(bytes(spoilt))
    ids, gaps = read(one)
    assert ids == [0, 1, 3, 4, 5] and gaps == [(0, len(one), f"block digest differs (inflated bytes {sizes[1]} to {sizes[2]})")]
    for level in (3, 0):  # stored records are not found a second time
        whole = warc._member(b"".join(plain), level)
        ids, gaps = read(whole[: len(whole) * 3 // 4])
        assert ids == [0, 1, 2, 3] and len(gaps) == 1 and sum(gaps[0][:2]) == len(whole) * 3 // 4
    broken = bytearray(warc._member(b"".join(plain)))
    broken[len(broken) * 3 // 4 : len(broken) * 3 // 4 + 400] = b"\xff" * 400
    tail = warc._member(warc.record(7, "http://x", b"z", None, "d")) + warc.record(8, "http://x", b"z", None, "d")
    ids, gaps = read(bytes(broken) + tail)
    assert ids[:3] == [0, 1, 2] and ids[-2:] == [7, 8] and len(ids) == len(set(ids)) and len(gaps) == 1 and sum(gaps[0][:2]) == len(broken)
    assert read(tail + plain[0] + whole) == ([7, 8, 0, 0, 1, 2, 3, 4, 5], [])
    assert read(b"junk" + plain[0] + b"junk" + tail) == ([0, 7, 8], [(0, 4, "no record begins here"), (4 + len(plain[0]), 4, "no record begins here")])
    bare = re.sub(rb"WARC-Block-Digest: [^\r]*\r\n", b"", plain[0])
    wrong = warc._member(bare)[:-8] + b"12345678"
    assert read(wrong) == ([], [(0, len(wrong), "member does not inflate")])


@pytest.mark.parametrize("pack", [lambda r: r, warc._member])
def test_salvage_of_long_records(tmp_path, monkeypatch, pack):
    """Headers and members of any length, one record at a time; a length beyond the member is found out without holding it."""
    long = warc.record(1, "http://x", b"z" * 100, None, "d").replace(b"WARC-Date: d", b"WARC-Date: d\r\nX-Long: " + b"h" * 200_000)
    plain = [warc.record(0, "http://x", b"a" * 70_000, None, "d"), long, warc.record(2, "http://x", b"b" * 300_000, None, "d"), warc.record(3, "http://x", b"c", None, "d")]
    monkeypatch.setattr(warc, "HOLD", 1 << 16)
    monkeypatch.setattr(warc, "STEP", 1 << 12)

    def read(raw):
        (tmp_path / "x").write_bytes(raw)
        found = list(warc.salvage(files.Source(str(tmp_path / "x"), block=4096)))
        return [warc._page_of(h["warc-record-id"]) for kind, _, _, h, _ in found if kind == "record"], [h["reason"].partition(" (")[0] for kind, _, _, h, _ in found if kind == "gap"]

    assert read(b"".join(map(pack, plain))) == ([0, 1, 2, 3], [])
    assert read(pack(b"".join(plain))) == ([0, 1, 2, 3], [])
    wrong = re.sub(rb"(\r\nContent-Length: )\d+(\r\n\r\nHTTP)", rb"\g<1>999999999999\2", plain[2], count=1)
    assert wrong != plain[2] and read(pack(plain[0] + long + wrong + plain[3])) == ([0, 1, 3], ["block is cut short"])


def test_quality_on_held_out_labels(spark):
    base = "/root/testdata/sf0.1"
    docs, labels = table(spark, base, "documents"), table(spark, base, "labels")
    seen = labels.where("doc_id % 3 <> 0").withColumn("rejected", F.lit("x"))
    judged = quality.judge(docs.select("doc_id", "text", "source", "lang"), seen)
    out = judged.join(labels.where("doc_id % 3 = 0"), "doc_id").select("_rejected", ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad")).collect()
    right = sum(r["_rejected"] == r["bad"] for r in out) / len(out)
    clean = [r["_rejected"] for r in out if not r["bad"]]
    assert right >= 0.95 and sum(clean) <= 0.01 * len(clean), (right, sum(clean), len(clean))


def test_distinct_share_sees_the_whole_text():
    share = lambda text: next(quality._features([text]))[0][6]
    words = [f"w{k}" for k in range(512)]
    clean, junk = " ".join(words * 4), " ".join(words + ["junk"] * 1536)
    assert share(clean) == 1.0 and share(junk) == (512 + 3) / 2048
    assert share(" ".join(words + words[:8])) == 1.0 and share("a a b") == 2 / 3 and share("") == 0.0


def test_quality_odd_cases(spark):
    docs = odd(spark, "rejected")
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (3, None, 0), (None, 0, 1)], "doc_id bigint, quality int, toxic int")
    assert quality.judge(docs, labels).where("not _rejected").count() == len(ODD)
    assert quality.judge(docs, labels.limit(0)).where("not _rejected").count() == len(ODD)
    assert quality.judge(empty(spark), labels).count() == 0


def linked(made, cosine=0.98):
    """(id, links, component) by brute force over (id, vector, label)."""
    units = [(i, lab, vectors._unit(v)) for i, v, lab in made]
    near = [[j for j, (_, other, w) in enumerate(units) if j != k and u is not None and w is not None and lab == other and lab is not None and len(u) == len(w) and u @ w >= cosine] for k, (_, lab, u) in enumerate(units)]
    label = [i for i, _, _ in units]
    changed = True
    while changed:
        changed = False
        for k, of in enumerate(near):
            low = min([label[k], *(label[j] for j in of)])
            changed |= low < label[k]
            label[k] = low
    return sorted(zip([i for i, _, _ in units], map(len, near), label, strict=True))


def test_vectors(spark):
    rng = np.random.default_rng(2)
    made = []
    for i in range(1300):
        made.append((i, rng.normal(size=16).tolist(), i % 2))
    centre = rng.normal(size=16)
    for i in range(1300, 1500):  # a dense group of copies that are not equal
        made.append((i, (centre + rng.normal(size=16) * 0.08).tolist(), 0))
    made += [(1500, made[3][1], 1), (1501, [2 * x for x in made[3][1]], 1), (1502, None, 1), (1503, [0.0] * 16, 1), (1504, [float("nan")] * 16, 1), (1505, made[3][1], None), (1506, [1.0], 1), (1507, [], 1), (1508, [None] * 16, 1), (1509, made[3][1], 0), (1500, made[3][1], 1)]
    turn = lambda k: [float(np.cos(0.15 * k)), float(np.sin(0.15 * k)), *[0.0] * 14]
    made += [(1600 + (k * 7) % 20, turn(k), 3) for k in range(20)]  # a chain: each links with its neighbours only
    df = spark.createDataFrame(made, "vec_id bigint, embedding array<double>, label int").withColumn("kept", F.lit("x"))
    out = vectors.near_vectors(df)
    assert rows(out, "vec_id", "n_links", "component_id") == sorted(linked(made), key=repr)
    assert {r["recall"] for r in out.collect()} == {1.0} and all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in out.collect())
    assert vectors.near_vectors(df.limit(0)).count() == 0


@pytest.mark.parametrize("overlap, beam, task", [(0.05, 48, 2 << 20), (0.05, 48, 1 << 17), (0.0, 2, 2 << 20), (None, None, 1 << 17)])
def test_vectors_of_one_large_label(spark, monkeypatch, overlap, beam, task):
    """Several clusters, groups on their borders, large shards in blocks; without overlap and beam the exact way."""
    monkeypatch.setattr(vectors, "TASK_BYTES", task)
    rng = np.random.default_rng(9)
    made, i = [], 0
    while i < 4000:
        centre = rng.normal(size=12)
        for _ in range(int(rng.choice([1, 1, 1, 3, 9, 200], p=[0.5, 0.2, 0.1, 0.1, 0.09, 0.01]))):
            made.append((i, (centre + rng.normal(size=12) * rng.choice([0.01, 0.06, 0.1])).tolist(), 5))
            i += 1
    x = np.array([vectors._unit(v) for _, v, _ in made])
    near = (x @ x.T >= 0.98) & ~np.eye(len(x), dtype=bool)
    out = vectors.near_vectors(spark.createDataFrame(made, "vec_id bigint, embedding array<double>, label int").repartition(4), overlap=overlap, beam=beam).collect()
    links = {r["vec_id"]: r["n_links"] for r in out}
    recall = sum(min(links[k], n) for k, n in enumerate(near.sum(axis=1).tolist())) / near.sum()
    assert recall >= 0.99 and all(links[k] <= n for k, n in enumerate(near.sum(axis=1).tolist())) and len(out) == len(made)
    label = np.arange(len(x))
    while True:
        new = np.minimum(label, np.where(near, label, len(x)).min(axis=1))
        if (new == label).all():
            break
        label = new
    same = sum(r["component_id"] == label[r["vec_id"]] for r in out) / len(out)
    assert same >= 0.99 and (beam or (recall == 1.0 and same == 1.0)) and min(r["recall"] for r in out) >= 0.999


def contaminated(docs, bench):
    """Ids of documents of (id, text) that the contract's rule calls contaminated."""
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    items = [word.findall((t or "").translate(LOWER)) for i, t in bench if i is not None]
    windows = {tuple(w[k : k + min(13, len(w))]) for w in items if w for k in range(len(w) - min(13, len(w)) + 1)}
    sizes, out = {len(w) for w in windows}, set()
    for i, t in docs:
        words, hit = word.findall((t or "").translate(LOWER)), set()
        for n in sizes:
            for k in range(len(words) - n + 1):
                if tuple(words[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
        if hit and 20 * len(hit) >= len(words):
            out.add(i)
    return out


def test_pipeline_against_brute_force(spark):
    import corpus_pipeline

    base = "/root/testdata/sf0.001"
    docs = table(spark, base, "documents")
    judged = quality.judge(docs, table(spark, base, "labels")).where("not _rejected").collect()
    texts = {r["doc_id"]: r["text"] for r in judged}
    sets = {i: shingles(t, 5) for i, t in texts.items()}
    label = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                n = len(sets[a] & sets[b])
                if label[b] < label[a] and n and 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
                    label[a], changed = label[b], True
    left = {i: t for i, t in texts.items() if label[i] == i}
    bad = contaminated(left.items(), [(r["item_id"], r["text"]) for r in table(spark, base, "benchmark").collect()])
    masked = {i: secrets.redact(t) for i, t in left.items() if i not in bad}
    lengths = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in masked.items()}
    bounds = packing.best_bounds(sorted(collections.Counter(lengths.values()).items()))
    want = sorted((i, n, min(b for b in bounds if b >= n)) for i, n in lengths.items())
    out = corpus_pipeline.run(spark, base)
    assert rows(out, "doc_id", "n_tokens", "padded_to") == sorted(want, key=repr)
    assert any(masked[i] != left[i] for i in masked) and bad and len(left) < len(texts) < docs.count()
    # After the fourth stage: the texts themselves, masked, and their true lengths.
    step = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        step = stage(spark, step, base)
    chars = {r["doc_id"]: r["n_chars"] for r in docs.collect()}
    assert rows(step, "doc_id", "text", "n_chars") == sorted(((i, t, len(t) if t != left[i] else chars[i]) for i, t in masked.items()), key=repr)


CLASHING = ("_hit", "_items", "_digest", "_salt", "_row", "_host", "_path", "_llr_low", "_rate_toxic", "_p_low", "_rejected", "digest", "kept", "bucket", "low", "n", "r", "size", "before")


def test_stages_with_odd_rows_and_clashing_columns(spark, monkeypatch):
    import corpus_pipeline

    base = "/root/testdata/sf0.001"
    secret = "say password=abcdefghijkl now"
    docs = both(spark, "n_words").unionByName(spark.createDataFrame([(20, secret, None, None, 29, "x"), (21, secret + " again", "en", "s", 5, "x"), (21, None, "en", "s", 5, "x")], odd(spark).schema))
    docs = docs.select("*", *(F.concat(F.lit(c), F.coalesce(F.col("doc_id").cast("string"), F.lit("?"))).alias(c) for c in CLASHING))
    held = collections.Counter((r["doc_id"], r["text"]) for r in docs.collect())
    for spread in (None, 0):  # once with lookups joined by salt
        if spread is not None:
            monkeypatch.setattr("quarrykit.llm.common.lookup.__defaults__", (0,))
            monkeypatch.setattr(decontaminate.benchmark_blocks, "__defaults__", ("item_id", "text", 13, 3000))
        for name, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, docs.limit(0), base).columns == docs.columns, name
            out = stage(spark, docs, base)
            assert out.columns == docs.columns, name
            got = out.collect()
            assert all(r[c] == c + ("?" if r["doc_id"] is None else str(r["doc_id"])) for r in got for c in CLASHING), name
            ids = collections.Counter(r["doc_id"] for r in got)
            if name == "secret scans":
                assert ids == collections.Counter(i for i, _ in held.elements()) and {r["text"] for r in got if r["doc_id"] == 20} == {"say [secret] now"}
                assert [r["n_chars"] for r in got if r["doc_id"] == 20] == [16]
            else:
                assert all((r["doc_id"], r["text"]) in held for r in got), name
            if name == "MinHash near-dedup":
                assert max(n for i, n in ids.items() if i is not None) == 1 and ids[None] == 1 and ids[1] == 1 and not ids[2] and ids[5] == ids[6] == ids[7] == 1
            if name == "benchmark decontamination":
                bad = contaminated(held, [(r["item_id"], r["text"]) for r in table(spark, base, "benchmark").collect()])
                assert ids == collections.Counter(i for i, t in held.elements() if i not in bad)
        packed = corpus_pipeline.STAGES[-1][1](spark, docs, base).collect()
        assert collections.Counter(r["doc_id"] for r in packed) == collections.Counter(i for i, _ in held.elements())


def test_shrinkage_by_hand(spark):
    """Rates of hosts and paths against a plain computation on small groups."""
    rng = np.random.default_rng(8)
    made = [(i, f"h{i % 3}" if i % 7 else "lone", f"p{i % 2}", *rng.normal(0, 2, 2).tolist()) for i in range(120)]
    marks = [(i, int(i % 3 != 0 or i % 5 == 0), int(i % 11 == 0)) for i in range(0, 120, 2)] + [(0, 0, 1)]
    scores = spark.createDataFrame(made, "doc_id bigint, host string, path string, _llr_low double, _llr_toxic double")
    got = {(r["host"], r["path"]): (r["rate_low"], r["rate_toxic"]) for r in quality.site_rates(scores, spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int")).collect()}
    known = {}
    for i, q, t in marks:
        known[i] = tuple(map(max, known.get(i, (0, 0)), (1 - q, t)))

    def shrink(groups, toward):
        n = sum(c for c, _ in groups.values())
        noise = sum(c * toward[g] * (1 - toward[g]) for g, (c, _) in groups.items()) / n
        spread = sum(c * (b / c - toward[g]) ** 2 for g, (c, b) in groups.items())
        excess = (spread - len(groups) * noise) / (n - sum(c * c for c, _ in groups.values()) / n) if len(groups) > 1 else 0
        strength = min(1e9, max(1.0, noise / excess - 1)) if excess > 1e-9 else 1e9
        return {g: (b + strength * toward[g]) / (c + strength) for g, (c, b) in groups.items()}

    for k in (0, 1):
        prior = min(0.99, max(0.001, sum(v[k] for v in known.values()) / len(known)))
        bad = {r[0]: known[r[0]][k] if r[0] in known else 1 / (1 + np.exp(-(r[3 + k] + np.log(prior / (1 - prior))))) for r in made}
        sites, hosts = collections.defaultdict(lambda: [0, 0.0]), collections.defaultdict(lambda: [0, 0.0])
        for i, host, path, *_ in made:
            for group in (sites[host, path], hosts[host]):
                group[0] += 1
                group[1] += bad[i]
        rate = min(0.999, max(1e-4, sum(bad.values()) / len(made)))
        of_host = shrink(hosts, dict.fromkeys(hosts, rate))
        of_site = shrink(sites, {(h, p): of_host[h] for h, p in sites})
        assert {g: round(v[k], 9) for g, v in got.items()} == {g: round(min(0.999, max(1e-4, v)), 9) for g, v in of_site.items()}


def test_lookup_with_salt_is_the_same_join(spark):
    from quarrykit.llm.common import lookup

    left = spark.range(2000).select("id", F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), (F.col("id") % 50).cast("string"))).alias("key"))
    right = spark.createDataFrame([("hot", 1), ("k1", 2)], "key string, v int")
    small, large = (rows(lookup(left, right, ["key"], F.col("id"), most=n), "id", "key", "v") for n in (10**9, 0))
    assert small == large == rows(left.join(right, "key", "left"), "id", "key", "v")
