"""DuckDB SQL for the pipeline operators that SQL can express.

Tokenizer files (op4), decoding layers (op5), the fitted classifier (op9) and eigenvectors (op11)
have none: they are tested against the library, brute force and held-out labels.
op10's SQL gives the recall that the exact links have.
"""

from __future__ import annotations

from quarrykit.llm.chat import CONTROL, END, MIDDLE, START
from quarrykit.llm.packing import BUCKETS, GROUP_ROWS, TOKEN_BUDGET

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _packing() -> str:
    steps = ["d1 AS (SELECT j, m * c - s AS v, [m] AS bounds FROM b)"]
    for k in range(2, BUCKETS + 1):
        steps.append(
            f"d{k} AS (SELECT j, v, bounds FROM (SELECT b.j, p.v + b.m * (b.c - q.c) - (b.s - q.s) AS v, list_append(p.bounds, b.m) AS bounds,"
            f" row_number() OVER (PARTITION BY b.j ORDER BY p.v + b.m * (b.c - q.c) - (b.s - q.s), p.j) AS n"
            f" FROM d{k - 1} p JOIN b q ON p.j = q.j JOIN b ON b.j > p.j WHERE p.j >= {k - 1}) WHERE n = 1)"
        )
    last = " UNION ALL ".join(f"SELECT {k} AS k, bounds FROM d{k} WHERE j = (SELECT max(j) FROM b)" for k in range(1, BUCKETS + 1))
    return f"""
WITH n AS (SELECT doc_id, len({_WORDS}) AS n FROM documents),
h AS (SELECT n AS m, count(*) AS c, sum(n) AS s FROM n GROUP BY n),
b AS (SELECT row_number() OVER (ORDER BY m) AS j, m, sum(c) OVER (ORDER BY m) AS c, sum(s) OVER (ORDER BY m) AS s FROM h),
{", ".join(steps)},
best AS (SELECT bounds FROM ({last}) ORDER BY k DESC LIMIT 1),
u AS (SELECT unnest(bounds) AS high, unnest(range(len(bounds))) AS bucket FROM best),
t AS (SELECT bucket, high, coalesce(lag(high) OVER (ORDER BY bucket), -1) AS low, greatest(1, {TOKEN_BUDGET} // greatest(1, high)) AS batch FROM u),
g AS (SELECT t.*, greatest(1, CAST(ceil((SELECT count(*) FROM n WHERE n > low AND n <= high) / {GROUP_ROWS}) AS BIGINT)) AS groups FROM t),
p AS (SELECT doc_id, n, bucket, high, batch, ((((doc_id % 2147483648) + 2147483648) % 2147483648 * 1103515245) >> 8) % groups AS grp FROM n JOIN g ON n > low AND n <= high),
r AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY grp, doc_id, n) - 1 AS r FROM p)
SELECT doc_id, n AS n_tokens, bucket, CAST(high AS BIGINT) AS padded_to, CAST(high - n AS BIGINT) AS padding, bucket || '-' || CAST(r // batch AS BIGINT) AS batch, CAST(r % batch AS BIGINT) AS slot FROM r
"""


_DECONTAMINATE = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
iw AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[k:k + least(13, len(w)) - 1], ' ') AS s FROM
  (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS k FROM i WHERE len(w) > 0)),
dw AS (SELECT doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') AS s FROM
  (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
m AS (SELECT doc_id, dw.n, k, item_id FROM dw JOIN iw ON dw.s = iw.s AND dw.n = iw.n),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM m) GROUP BY doc_id),
o AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS sha FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(sha, sha256('')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated FROM d LEFT JOIN h ON d.doc_id = h.doc_id LEFT JOIN o ON d.doc_id = o.doc_id
"""

_WARC = """
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest, CASE WHEN n >= 1000 AND page_id < keep THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id < keep THEN keep END AS refers_to
FROM (SELECT page_id, h, strlen(h) AS n, max(page_id) OVER (PARTITION BY h) AS keep FROM (SELECT page_id, coalesce(html, '') AS h FROM pages))
"""


def _escaped(column: str) -> str:
    out = f"replace({column}, '\\', '\\\\')"
    for c in CONTROL:
        out = f"replace({out}, '{c}', '{c[0]}\\{c[1:]}')"
    return out


_CHAT = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, k, CASE k WHEN 0 THEN 'user' ELSE 'assistant' END, '</s>[INST] ok [/INST]' FROM range(2) r(k))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn)) AS loss_sha256,
  CAST(sum({len(START + MIDDLE + END)} + length(replace({_escaped("role")}, chr(10), '\\n')) + length({_escaped("text")})) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""

_REACH = """
e AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (SELECT a, b FROM e UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a)
"""

_MINHASH = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + least(4, len(w)) - 1], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(4, len(w)) + 2)) AS k FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS both_ FROM s x JOIN s y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * both_ >= 80 * (p.n + q.n - both_)),
{_REACH}
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id, d.doc_id <= coalesce(m, d.doc_id) AS kept
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN (SELECT a, min(b) AS m FROM reach GROUP BY a) r ON d.doc_id = r.a
"""

_SUBSTRINGS = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
g AS (SELECT doc_id, k, array_to_string(w[k:k + 19], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS k FROM d WHERE len(w) >= 20)),
r AS (SELECT doc_id, k FROM (SELECT doc_id, k, row_number() OVER (PARTITION BY s ORDER BY doc_id, k) AS n FROM g) WHERE n > 1),
x AS (SELECT DISTINCT doc_id, unnest(range(k, k + 20)) AS p FROM r),
w AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
k AS (SELECT w.doc_id, string_agg(word, ' ' ORDER BY w.p) AS kept FROM w LEFT JOIN x ON w.doc_id = x.doc_id AND w.p = x.p WHERE x.p IS NULL GROUP BY w.doc_id),
c AS (SELECT doc_id, count(*) AS n FROM x GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(c.n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k ON d.doc_id = k.doc_id LEFT JOIN c ON d.doc_id = c.doc_id
"""

_VECTORS = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
u AS (SELECT vec_id, label, e, sqrt(list_inner_product(e, e)) AS n FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id < b.vec_id WHERE list_inner_product(a.e, b.e) / (a.n * b.n) >= 0.98),
{_REACH}
SELECT vec_id, coalesce(c, 0) AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id, vec_id <= coalesce(m, vec_id) AS kept, CAST(1 AS DOUBLE) AS recall
FROM embeddings LEFT JOIN (SELECT a, count(*) AS c FROM e GROUP BY a) n ON vec_id = n.a LEFT JOIN (SELECT a, min(b) AS m FROM reach GROUP BY a) r ON vec_id = r.a
"""

# Bytes are two hexadecimal digits; windows are told by a 64-bit hash.
_SUFFIXES = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT r, i, hash(substr(h, 2 * i + 1, 400)) AS k FROM (SELECT r, h, unnest(range(length(h) // 2 - 199)) AS i FROM d)),
m AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY k) AS c FROM w) WHERE c > 1),
g AS (SELECT r, i, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + 200 THEN 0 ELSE 1 END AS new FROM m),
s AS (SELECT r, min(i) AS a, max(i) + 200 AS b FROM (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS n FROM g) GROUP BY r, n),
f AS (SELECT r, a, b, lag(b) OVER (PARTITION BY r ORDER BY a) AS before FROM s),
k AS (SELECT f.r, count(*) AS n_spans, sum(b - a) AS n_removed, string_agg(substr(h, 2 * coalesce(before, 0) + 1, 2 * (a - coalesce(before, 0))), '' ORDER BY a) || any_value(substr(h, 2 * last + 1)) AS kept
  FROM f JOIN d ON f.r = d.r JOIN (SELECT r, max(b) AS last FROM f GROUP BY r) l ON l.r = f.r GROUP BY f.r)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM d LEFT JOIN k ON d.r = k.r
"""

_SPELLING = r"""
WITH RECURSIVE t AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i))),
runs AS (SELECT doc_id, run, count(*) AS c FROM (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]{7,}')) AS run FROM documents) GROUP BY ALL),
b AS (SELECT run, c, flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''), lambda s: CASE WHEN unicode(s) < 128 THEN [CAST(unicode(s) AS BIGINT)] ELSE [CAST(192 + unicode(s) // 64 AS BIGINT), CAST(128 + unicode(s) % 64 AS BIGINT)] END)) AS b FROM runs),
h AS (SELECT run, c, xor(list_reduce(list_prepend(4294967295, b), lambda a, x: xor(a >> 8, t.t[(xor(a, x) & 255) + 1])), 4294967295) AS h FROM b, t),
v AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM (SELECT CASE WHEN h % 31 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, c FROM h) WHERE length(word) >= 7 GROUP BY word HAVING sum(c) >= 2),
x AS (SELECT word, i, left(word, i) || substr(word, i + 2) AS d FROM (SELECT word, unnest(range(length(word))) AS i FROM v)),
e AS (SELECT a.word, b.word AS near FROM x a JOIN x b ON a.d = b.d AND a.i = b.i AND a.word <> b.word UNION SELECT x.word, v.word FROM x JOIN v ON x.d = v.word UNION SELECT v.word, x.word FROM x JOIN v ON x.d = v.word),
k AS (SELECT e.word, e.near, v.n, row_number() OVER (PARTITION BY e.word ORDER BY v.n DESC, e.near) AS r, count(*) OVER (PARTITION BY e.word) AS n_near FROM e JOIN v ON v.word = e.near),
f AS (SELECT v.word, v.n, coalesce(k.n_near, 0) AS n_near, CASE WHEN k.n >= 10 * v.n THEN k.near END AS form, CASE WHEN k.n >= 10 * v.n THEN k.n END AS form_n FROM v LEFT JOIN k ON k.word = v.word AND k.r = 1),
g AS (SELECT word, form AS root, 1 AS d FROM f WHERE form IS NOT NULL UNION ALL SELECT g.word, f.form, d + 1 FROM g JOIN f ON f.word = g.root WHERE f.form IS NOT NULL)
SELECT f.word, f.form, coalesce(r.root, f.word) AS root, f.n, f.n_near, f.form_n FROM f LEFT JOIN (SELECT word, arg_max(root, d) AS root FROM g GROUP BY word) r ON f.word = r.word
"""

ORACLES: dict[str, str] = {
    "op1_packing": _packing(),
    "op2_decontaminate": _DECONTAMINATE,
    "op3_warc": _WARC,
    "op6_chat": _CHAT,
    "op7_minhash": _MINHASH,
    "op8_substrings": _SUBSTRINGS,
    "op10_vectors": _VECTORS,
    "op12_suffixes": _SUFFIXES,
    "op13_spelling": _SPELLING,
}
