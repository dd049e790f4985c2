"""Registered inventory queries over the given tables, and their DuckDB equivalents.

Documents stand for text blocks that do not parse, pages for bodies with quoted literals, page
URLs for linked paths, conversations for chains of text lines, integer columns for flags.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrykit.functions import literals, paths, text
from quarrykit.functions import tables as t
from quarrykit.jobs import inspect
from quarrykit.operators import identity, rollup, statements, syntax
from quarrykit.session import shared_folder, stored, table
from quarrykit.sources import container
from quarrykit.sources.container_writer import Writer, write_files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function as a query, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _list(names: list[str]) -> str:
    return ", ".join("'" + n.replace("'", "''") + "'" for n in names)


_HOSTS = sorted(set(t.TLDS) - set(t.NOT_TLDS))
BLOB = 32  # the data has no blob of 200 characters


@query(f"""
SELECT page_id, u AS url, h AS host,
  regexp_matches(h, '(?i)^[a-z0-9]([a-z0-9-]*[a-z0-9])?(\\.[a-z0-9-]+)+$') AND length(h) <= 253
    AND lower(regexp_extract(h, '[^.]*$')) IN ({_list(_HOSTS)}) AS is_host
FROM (SELECT page_id, u, regexp_extract(u, '://([^/:?#]+)', 1) AS h FROM
  (SELECT page_id, unnest(regexp_extract_all(url, '(?i)(?:https?|ftps?|file)://[^\\s''"<>|]{{3,}}')) AS u FROM pages))
""")
def literal_url_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URLs of a text, and whether their host reads as one."""
    found = table(spark, sf_dir, "pages").select("page_id", F.explode(literals.urls(F.col("url"))).alias("url"))
    host = F.regexp_extract("url", "://([^/:?#]+)", 1)
    return found.select("page_id", "url", host.alias("host"), literals.is_host(host).alias("is_host"))


_W = r"\p{L}\p{N}_"
_PATH_SQL = (
    "(length(s) <= 400 AND NOT contains(s, chr(10)) AND (regexp_matches(s, '^[a-zA-Z]:[\\\\/]') OR starts_with(s, '\\\\') OR starts_with(s, '~/') OR starts_with(s, '~\\') OR starts_with(s, '//')"
    " OR regexp_matches(s, '%[A-Za-z_]+%') OR regexp_matches(s, '^\\$\\{?[" + _W + "]') OR contains(s, '$HOME') OR contains(lower(s), '$env:')"
    " OR ((contains(s, '/') OR contains(s, '\\')) AND NOT starts_with(s, 'http') AND NOT starts_with(s, 'ftp') AND regexp_matches(s, '[" + _W + ".-]+[\\\\/][" + _W + ".-]')"
    " AND (NOT (contains(s, ' ') OR contains(s, chr(9))) OR regexp_matches(s, '^(/|\\\\|\\./|\\.\\\\)') OR regexp_matches(s, '[\\\\/][" + _W + " -]+\\.[A-Za-z0-9]{1,8}$')))))"
)
_COMMAND_SQL = "(" + " OR ".join(f"contains(lower(s), '{x}')" for x in t.TOOLS) + ")"
_BLOB_SQL = "(length(s) >= {least} AND (regexp_matches(s, '^[A-Za-z0-9+/=_-]+$') OR regexp_matches(s, '^(0x)?[0-9a-fA-F]+$')))"
_HOST_SQL = f"(regexp_matches(s, '(?i)^[a-z0-9]([a-z0-9-]*[a-z0-9])?(\\.[a-z0-9-]+)+$') AND length(s) <= 253 AND lower(regexp_extract(s, '[^.]*$')) IN ({_list(_HOSTS)}))"


@query(f"""
WITH c AS (SELECT page_id, c, trim(c, ' ' || chr(9) || chr(10) || chr(13)) AS s FROM (
    SELECT page_id, unnest(list_append(regexp_extract_all(html, '"([^"]*)"', 1), url)) AS c FROM pages)
  WHERE c <> '' AND length(c) <= 4096),
k AS (
  SELECT page_id, 'url' AS kind, unnest(regexp_extract_all(c, '(?i)(?:https?|ftps?|file)://[^\\s''"<>|]{{3,}}')) AS v FROM c
  UNION ALL SELECT page_id, 'blob', s FROM c WHERE {_BLOB_SQL.format(least=200)}
  UNION ALL SELECT page_id, 'command', s FROM c WHERE NOT {_BLOB_SQL.format(least=200)} AND {_COMMAND_SQL}
  UNION ALL SELECT page_id, 'host', s FROM c WHERE NOT {_BLOB_SQL.format(least=200)} AND {_HOST_SQL}
  UNION ALL SELECT page_id, 'path', s FROM c WHERE NOT {_BLOB_SQL.format(least=200)} AND NOT {_HOST_SQL} AND {_PATH_SQL})
SELECT page_id, kind, count(DISTINCT v) AS n_values, min(v) AS first_value FROM k GROUP BY ALL
""")
def literal_kinds_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of all quoted literals of a body and of its address."""
    quoted = F.regexp_extract_all("html", F.lit('"([^"]*)"'), F.lit(1))
    one = table(spark, sf_dir, "pages").select("page_id", F.explode(F.concat(quoted, F.array("url"))).alias("c"))
    found = one.select("page_id", F.explode(literals.literals(F.col("c"))).alias("l"))
    return found.groupBy("page_id", F.col("l.kind").alias("kind")).agg(F.countDistinct("l.value").alias("n_values"), F.min("l.value").alias("first_value"))


@query("""
SELECT doc_id, len(x) AS n_tokens, len(list_distinct(x)) AS n_distinct, coalesce(list_max(list_transform(x, lambda y: length(y))), 0) AS longest
FROM (SELECT doc_id, regexp_extract_all(text, '[^\\s''"]{4,}') AS x FROM documents)
""")
def fallback_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates for literals in bodies that do not parse."""
    x = table(spark, sf_dir, "documents").select("doc_id", literals.tokens(F.col("text")).alias("x"))
    longest = F.coalesce(F.array_max(F.transform("x", F.length)), F.lit(0)).cast("bigint")
    return x.select("doc_id", F.size("x").cast("bigint").alias("n_tokens"), F.size(F.array_distinct("x")).cast("bigint").alias("n_distinct"), longest.alias("longest"))


def _document_statements(spark: SparkSession, sf_dir: str, keys: list[str]) -> DataFrame:
    return statements.fallback_statements(table(spark, sf_dir, "documents").select(*keys, "text"), keys, "text", BLOB)


_BLOBS_CTE = f"""
WITH tok AS (SELECT doc_id, source, lang, unnest(regexp_extract_all(text, '[^\\s''"]{{4,}}')) AS s FROM documents),
b AS (SELECT DISTINCT doc_id, source, lang, substr(s, 1, 24) || '... (' || length(s) || ' chars)' AS e FROM tok WHERE length(s) <= 4096 AND {_BLOB_SQL.format(least=BLOB)})
"""


@query(_BLOBS_CTE + "SELECT doc_id, 'x_opaque_blob' AS key, 'alarming' AS severity, array_to_string(list_sort(list(e))[1:8], ';') AS evidence FROM b GROUP BY doc_id")
def opaque_blob_t32(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements of unparsed bodies, with a blob threshold of 32."""
    found = _document_statements(spark, sf_dir, ["doc_id"])
    names = F.array(*(F.lit(s) for s in t.SEVERITIES))
    return found.select("doc_id", "key", F.get(names, F.col("severity")).alias("severity"), F.array_join("evidence", ";").alias("evidence"))


# Spellings of a linked path, made from a page's address: share, drive, root, device and relative forms.
def _raw_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "://([^/:?#]+)", 1).alias("host"), F.regexp_extract("url", "://[^/]+/?(.*)", 1).alias("rest"))
    forms = [
        F.concat(F.lit("\\\\"), "host", F.lit("\\"), "rest"),
        F.concat(F.lit("//"), "rest"),
        F.concat(F.lit("C:\\"), "host", F.lit("\\"), "rest"),
        F.concat(F.lit("/srv/"), "host", F.lit("/"), "rest"),
        F.concat(F.lit("//../"), "rest"),
        F.concat(F.lit("\\\\?\\UNC\\"), "host", F.lit("\\"), "rest"),
        F.concat(F.lit("////?/d:/"), "rest"),
        F.concat(F.lit("a/./b/../"), "rest"),
        F.concat(F.lit("////"), "host", F.lit("/x/"), "rest"),
        F.concat(F.lit("a/../../"), "rest"),
    ]
    raw = F.lit(None).cast("string")
    for k, form in enumerate(forms):
        raw = F.when(F.col("page_id") % len(forms) == k, form).otherwise(raw)
    return p.select("page_id", "host", raw.alias("raw"))


_RAW_CTE = r"""
WITH p AS (SELECT page_id, regexp_extract(url, '://([^/:?#]+)', 1) AS host, regexp_extract(url, '://[^/]+/?(.*)', 1) AS rest FROM pages),
r AS (SELECT page_id, host, CASE page_id % 10 WHEN 0 THEN '\\' || host || '\' || rest WHEN 1 THEN '//' || rest WHEN 2 THEN 'C:\' || host || '\' || rest
  WHEN 3 THEN '/srv/' || host || '/' || rest WHEN 4 THEN '//../' || rest WHEN 5 THEN '\\?\UNC\' || host || '\' || rest WHEN 6 THEN '////?/d:/' || rest
  WHEN 7 THEN 'a/./b/../' || rest WHEN 8 THEN '////' || host || '/x/' || rest ELSE 'a/../../' || rest END AS raw, page_id % 10 AS k FROM p)
"""


@query(
    _RAW_CTE
    + """
SELECT page_id, raw, CASE WHEN k IN (0, 5, 8) THEN 'unc' WHEN k IN (2, 6) THEN 'drive' WHEN k = 3 THEN 'root' ELSE 'relative' END AS kind,
  CASE WHEN k IN (0, 5, 8) THEN host WHEN k = 2 THEN 'C' WHEN k = 6 THEN 'd' END AS host,
  k IN (6, 8) AS disguised, k IN (1, 4) AS is_relative FROM r
"""
)
def path_root_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Root kinds of linked paths in ten spellings."""
    c = paths.classify(F.col("raw"), F.lit("/srv/site"))
    kind = paths.root_kind(paths.normalised(F.col("raw")))
    return _raw_path(spark, sf_dir).select("page_id", "raw", kind["kind"].alias("kind"), kind["host"].alias("host"), c["disguised"].alias("disguised"), c["is_relative"].alias("is_relative"))


@query(
    _RAW_CTE
    + """,
n AS (SELECT page_id, raw, replace(CASE WHEN starts_with(raw, '//') THEN substr(raw, 3) ELSE raw END, '\\', '/') AS path FROM r),
s AS (SELECT page_id, i, CASE x WHEN '..' THEN -1 WHEN '' THEN 0 WHEN '.' THEN 0 ELSE 1 END AS d FROM
  (SELECT page_id, unnest(string_split(path, '/')) AS x, unnest(range(len(string_split(path, '/')))) AS i FROM n)),
w AS (SELECT page_id, sum(d) OVER (PARTITION BY page_id ORDER BY i) AS depth FROM s)
SELECT page_id, min(depth) < 0 AS escapes FROM w GROUP BY page_id
"""
)
def path_escape_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a path climbs above its start at any point."""
    return _raw_path(spark, sf_dir).select("page_id", paths.escapes_upward(paths.normalised(F.col("raw"))).alias("escapes"))


@query(
    _RAW_CTE
    + """
SELECT page_id, k = 3 AND rest <> '' AS inside_host, k = 3 AS inside_srv, k = 2 AS inside_drive FROM r JOIN p USING (page_id)
"""
)
def path_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lexical containment below a folder of the same host, below /srv and below a drive."""
    n = paths.normalised(F.col("raw"))
    return _raw_path(spark, sf_dir).select(
        "page_id",
        paths.contained(F.concat(F.lit("/srv/./"), "host"), n).alias("inside_host"),
        paths.contained(F.lit("/srv/x/.."), n).alias("inside_srv"),
        paths.contained(F.lit("c:\\"), n).alias("inside_drive"),
    )


_FLAGS_SQL = " || ".join([f"CASE WHEN (v >> {b}) & 1 = 1 THEN '{n},' ELSE '' END" for b, n in t.TEXT_FLAGS.items()] + [f"CASE WHEN (v >> {b}) & 1 = 1 THEN 'bit{b},' ELSE '' END" for b in range(32) if b not in t.TEXT_FLAGS])


@query(f"SELECT v, n, {_FLAGS_SQL} AS names FROM (SELECT CAST(l_quantity * l_linenumber * 37 AS BIGINT) AS v, count(*) AS n FROM lineitem GROUP BY 1)")
def bitflag_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of set bits, known ones first, then the others by number."""
    v = (F.col("l_quantity") * F.col("l_linenumber") * 37).cast("bigint")
    names = F.array_join(F.transform(text.flag_names(F.col("v"), t.TEXT_FLAGS), lambda n: F.concat(n, F.lit(","))), "")
    return table(spark, sf_dir, "lineitem").groupBy(v.alias("v")).agg(F.count("*").alias("n")).select("v", "n", names.alias("names"))


@query("SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS body, count(*) AS n_lines FROM conversations GROUP BY conv_id")
def text_reassembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a chain put together in order."""
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.expr("listagg(text, '\\n') within group (order by turn)").alias("body"), F.count("*").alias("n_lines"))


CAP = 2000


@query(f"""
SELECT conv_id, CAST(sum(CASE WHEN total <= {CAP} THEN 1 ELSE 0 END) AS BIGINT) AS kept_lines, bool_or(total > {CAP}) AS truncated FROM
  (SELECT conv_id, turn, sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn) AS total FROM conversations) GROUP BY conv_id
""")
def body_budget_truncation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that fit a body's size budget, by a running total that counts the joining newline."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    totals = table(spark, sf_dir, "conversations").select("conv_id", F.sum(F.length("text") + 1).over(w).alias("total"))
    return totals.groupBy("conv_id").agg(F.sum((F.col("total") <= CAP).cast("int")).alias("kept_lines"), F.bool_or(F.col("total") > CAP).alias("truncated"))


@query("""
WITH h AS (SELECT doc_id, sha256(text) AS sha FROM documents), f AS (SELECT sha, min(doc_id) AS first_doc, count(*) AS n FROM h GROUP BY sha HAVING count(*) > 1)
SELECT doc_id, h.sha AS sha256, first_doc, n AS n_copies, doc_id = first_doc AS is_first FROM h JOIN f ON h.sha = f.sha
""")
def identity_byte(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose bytes occur more than once, with the first that has them."""
    h = table(spark, sf_dir, "documents").select("doc_id", text.sha256_hex(F.col("text")).alias("sha256"))
    known = identity.first_seen(h, "sha256", "doc_id").where("n > 1")
    return h.join(known, "sha256").select("doc_id", "sha256", F.col("first").alias("first_doc"), F.col("n").alias("n_copies"), (F.col("doc_id") == F.col("first")).alias("is_first"))


@query("""
WITH m AS (SELECT page_id, sha256(regexp_replace(regexp_replace(html, '"[^"]*"', '""', 'g'), '>[^<]*<', '><', 'g')) AS shape FROM pages),
k AS (SELECT shape, min(page_id) AS first_page, count(*) AS n FROM m GROUP BY shape)
SELECT page_id, first_page, n AS n_alike FROM m JOIN k USING (shape)
""")
def identity_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies of one structure: an analogue by pattern, with quoted literals and text masked."""
    masked = F.regexp_replace(F.regexp_replace("html", '"[^"]*"', '""'), ">[^<]*<", "><")
    m = table(spark, sf_dir, "pages").select("page_id", text.sha256_hex(masked).alias("shape"))
    return m.join(identity.first_seen(m, "shape", "page_id"), "shape").select("page_id", F.col("first").alias("first_page"), F.col("n").alias("n_alike"))


_SHAPE_CTE = """
WITH m AS (SELECT page_id, url, sha256(html) AS sha, sha256(regexp_replace(regexp_replace(html, '"[^"]*"', '""', 'g'), '>[^<]*<', '><', 'g')) AS shape, regexp_extract_all(html, '"([^"]*)"', 1) AS x FROM pages),
f AS (SELECT shape, min(page_id) AS first_page FROM m GROUP BY shape)
"""


def _shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with the digest of their structure and their quoted literals."""
    masked = F.regexp_replace(F.regexp_replace("html", '"[^"]*"', '""'), ">[^<]*<", "><")
    return table(spark, sf_dir, "pages").select("page_id", "url", text.sha256_hex(F.col("html")).alias("sha256"), text.sha256_hex(masked).alias("structure_sha256"), F.regexp_extract_all("html", F.lit('"([^"]*)"'), F.lit(1)).alias("literals"))


@query(
    _SHAPE_CTE
    + """, j AS (SELECT m.page_id, f.first_page, r.x AS r, m.x AS c FROM m JOIN f ON m.shape = f.shape JOIN m r ON r.page_id = f.first_page),
d AS (SELECT page_id, r, c, unnest(range(1, least(len(r), len(c)) + 1)) AS i FROM j),
n AS (SELECT page_id, count(*) FILTER (WHERE r[i] <> c[i]) AS n_different, min(i) FILTER (WHERE r[i] <> c[i]) - 1 AS first_index FROM d GROUP BY page_id)
SELECT j.page_id, first_page, coalesce(n_different, 0) AS n_different, first_index FROM j LEFT JOIN n ON j.page_id = n.page_id
"""
)
def identity_literal_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Literals of a body compared place by place with those of the first body of its structure."""
    m = _shapes(spark, sf_dir)
    first = m.groupBy("structure_sha256").agg(F.min(F.struct("page_id", "literals")).alias("f"))
    both = m.join(first, "structure_sha256").select("page_id", F.col("f.page_id").alias("first_page"), identity.differences(F.col("f.literals"), F.col("literals")).alias("d"))
    return both.select("page_id", "first_page", F.size("d").cast("bigint").alias("n_different"), F.get("d", F.lit(0))["index"].cast("bigint").alias("first_index"))


@query(
    _SHAPE_CTE
    + """, e AS (SELECT m.page_id AS place, sha, m.shape, url, x, length(url) % 2 = 0 AS generated FROM m JOIN f ON m.page_id = f.first_page),
b AS (SELECT sha, max(place) AS place FROM e GROUP BY sha),
j AS (SELECT m.page_id, m.x, b.place AS by_bytes, s.place AS by_shape, coalesce(b.place, s.place) AS place FROM m LEFT JOIN b ON m.sha = b.sha LEFT JOIN e s ON m.shape = s.shape),
h AS (SELECT j.page_id, by_bytes, by_shape, e.url, e.generated, j.x AS c, e.x AS r FROM j LEFT JOIN e ON e.place = j.place)
SELECT page_id, CASE WHEN by_bytes IS NOT NULL THEN 'bytes' WHEN by_shape IS NOT NULL THEN 'structure' END AS evidence, url AS script_name,
  CASE WHEN by_bytes IS NULL AND by_shape IS NOT NULL THEN CAST(len(list_filter(range(1, least(len(r), len(c)) + 1), lambda i: r[i] <> c[i])) AS BIGINT) END AS n_different,
  by_bytes IS NOT NULL AND NOT generated AS clears FROM h
"""
)
def identity_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies matched to a table of known scripts (the first body of each structure), by bytes and else by structure."""
    m = _shapes(spark, sf_dir)
    listed = m.groupBy("structure_sha256").agg(F.min(F.struct("page_id", "sha256", "url", "literals")).alias("f"))
    known = listed.select(F.col("f.page_id").alias("place"), "f.sha256", F.col("f.url").alias("script_name"), "structure_sha256", "f.literals", (F.length("f.url") % 2 == 0).alias("generated"))
    found = identity.match(m, known)
    return found.select("page_id", "evidence", F.col("entry.script_name").alias("script_name"), F.when(F.col("differing_literals").isNotNull(), F.size("differing_literals")).cast("bigint").alias("n_different"), F.col("suppresses_escalation").alias("clears"))


# Entries of a known-script table over the customers: a form for each remainder, the problem that each must give.
_ENTRIES = [
    ("", None),
    (',"generated":true', None),
    (',"structure":{"scheme":1,"sha256":"@sha","literals":["a"]}', None),
    (',"structure":{"scheme":2,"sha256":"@sha","literals":["a"]}', "bad structure"),
    (',"structure":{"scheme":1,"sha256":"xyz","literals":["a"]}', "bad structure"),
    (',"structure":{"scheme":1,"sha256":"@sha"}', "bad structure"),
    (',"generated":"true"', "generated is not a boolean"),
    (',"generated":false,"structure":{"scheme":1,"sha256":"@sha","literals":[]}', "generated contradicts structure"),
    ("-notes", "missing field"),
    ("-digest", "not a digest"),
    ("-schema", "unusable table"),
    ("-json", "unusable table"),
]


@query(
    f"SELECT c_custkey, CASE c_custkey % {len(_ENTRIES)} "
    + " ".join(f"WHEN {k} THEN '{why}'" for k, (_, why) in enumerate(_ENTRIES) if why)
    + f" END AS problem, CASE WHEN c_custkey % {len(_ENTRIES)} <= 2 THEN sha256(c_name) END AS sha256, CASE WHEN c_custkey % {len(_ENTRIES)} <= 2 THEN c_custkey % {len(_ENTRIES)} <> 0 END AS generated FROM customer"
)
def known_entry_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known-script entries validated one by one: fields, digest, structure and the generated flag."""
    sha = text.sha256_hex(F.col("c_name"))
    fields = F.to_json(F.struct(F.upper(sha).alias("sha256"), F.col("c_name").alias("script_name"), F.lit(7).alias("byte_size"), *(F.lit("x").alias(c) for c in ("origin", "source_url", "fetched_on", "attested_by", "attested_on", "notes"))))
    body = F.substr(fields, F.lit(1), F.length(fields) - 1)
    k, entry = F.col("c_custkey") % len(_ENTRIES), F.concat(body, F.lit("}"))
    for i, (more, _) in enumerate(_ENTRIES):
        if more.startswith(","):
            entry = F.when(k == i, F.concat(body, F.replace(F.lit(more), F.lit("@sha"), sha), F.lit("}"))).otherwise(entry)
    entry = F.when(k == 8, F.replace(entry, F.lit(',"notes":"x"'), F.lit(""))).when(k == 9, F.replace(entry, F.upper(sha), F.lit("zz"))).otherwise(entry)
    value = F.concat(F.lit('{"schema":'), F.when(k == 10, "1").otherwise("2"), F.lit(',"entries":['), entry, F.when(k == 11, "]").otherwise("]}"))
    raw = table(spark, sf_dir, "customer").select("c_custkey", value.alias("value"))
    entries, problems = identity.known_entries(raw, keys=["c_custkey"])
    good = entries.select("c_custkey", F.lit(None).cast("string").alias("problem"), "sha256", "generated")
    return good.union(problems.select("c_custkey", "problem", F.lit(None).cast("string"), F.lit(None).cast("boolean")))


@query("""
WITH h AS (SELECT doc_id, lang, source, sha256(text) AS sha FROM documents)
SELECT sha AS sha256, doc_id, lang, source FROM (SELECT *, row_number() OVER (PARTITION BY sha ORDER BY doc_id DESC) AS n FROM h) WHERE n = 1
""")
def known_dedupe_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of entries under one key the last listed."""
    h = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", text.sha256_hex(F.col("text")).alias("sha256"))
    return identity.last_wins(h, "sha256", "doc_id").select("sha256", "doc_id", "lang", "source")


@query("""
SELECT o_orderkey, coalesce(c_name || CASE WHEN o_orderkey % 3 <> 0 THEN '[' || (o_orderkey % 3) || ']' ELSE '' END, '<unattached driver>') AS owner
FROM orders LEFT JOIN customer ON o_custkey = c_custkey
""")
def owner_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Owners looked up by address; an index only where it is not zero, a default where there is none."""
    owners = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    index = F.col("o_orderkey") % 3
    label = F.concat("c_name", F.when(index != 0, F.concat(F.lit("["), index.cast("string"), F.lit("]"))).otherwise(F.lit("")))
    return table(spark, sf_dir, "orders").join(owners, "o_custkey", "left").select("o_orderkey", F.coalesce(label, F.lit("<unattached driver>")).alias("owner"))


@query("""
WITH n AS (SELECT p_partkey, lower(replace(p_type, ' ', '.')) AS name FROM part), r AS (SELECT DISTINCT lower(string_split(p_type, ' ')[1]) AS entry FROM part
  UNION SELECT DISTINCT lower(array_to_string(string_split(p_type, ' ')[1:2], '.')) FROM part)
SELECT p_partkey, name, entry FROM n JOIN r ON name = entry OR starts_with(name, entry || '.')
""")
def rule_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dotted names joined to the entries that they equal or lie under."""
    part = table(spark, sf_dir, "part")
    words = F.split(F.lower("p_type"), " ")
    entries = part.select(words[0].alias("entry")).union(part.select(F.array_join(F.slice(words, 1, 2), "."))).distinct()
    named = part.select("p_partkey", F.array_join(words, ".").alias("name")).withColumn("entry", F.explode(F.array_distinct(statements.prefixes(F.col("name")))))
    return named.join(entries, "entry").select("p_partkey", "name", "entry")


_REASONS_CTE = (
    _BLOBS_CTE
    + """,
lib AS (SELECT page_id, 'src' || (page_id % 20) AS source, page_id % 97 = 0 AS is_unc, page_id % 13 = 0 AS drive FROM pages),
files AS (SELECT DISTINCT source FROM documents),
red AS (SELECT source, bool_or(is_unc) AS unc, bool_or(drive) AS drive FROM lib GROUP BY source),
amber AS (SELECT source, count(*) AS n FROM b GROUP BY source),
tier AS (SELECT f.source, coalesce(unc, false) AS unc, coalesce(drive, false) AS drive, n IS NOT NULL AS blob, f.source = 'src3' AS timed_out
  FROM files f LEFT JOIN red ON f.source = red.source LEFT JOIN amber ON f.source = amber.source)
"""
)


def _tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources as files: documents are their text blocks, pages the paths that they link."""
    docs = table(spark, sf_dir, "documents")
    found = rollup.statement_reasons(_document_statements(spark, sf_dir, ["source"]), ["source"]).withColumnRenamed("source", "path")
    linked = table(spark, sf_dir, "pages").select(F.concat(F.lit("src"), (F.col("page_id") % 20).cast("string")).alias("path"), "page_id")
    spelt = F.when(F.col("page_id") % 97 == 0, F.lit("\\\\host\\x")).when(F.col("page_id") % 13 == 0, F.lit("D:/x")).otherwise("//x/y")
    kinds = linked.select("path", paths.classify(spelt, F.lit("/srv")).alias("c"), "page_id").select("path", "c.is_unc", (F.col("c.has_drive_letter") | ((F.col("page_id") % 97 == 0) & (F.col("page_id") % 13 == 0))).alias("has_drive_letter"))
    reasons = found.unionByName(rollup.library_reasons(kinds)).withColumn("script", F.lit(None).cast("string"))
    files = docs.select(F.col("source").alias("path")).distinct().withColumn("timed_out", F.col("path") == "src3")
    return rollup.tiers(files, reasons)


@query(
    _REASONS_CTE
    + """
SELECT source, CASE WHEN unc THEN 'red' WHEN blob OR drive OR timed_out THEN 'amber' ELSE 'neutral' END AS tier,
  CASE WHEN timed_out THEN 'scan_timed_out ' ELSE '' END || CASE WHEN unc THEN 'library_unc ' ELSE
    CASE WHEN blob THEN 'x_opaque_blob ' ELSE '' END || CASE WHEN drive THEN 'library_drive_letter ' ELSE '' END END AS reasons FROM tier
"""
)
def tier_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tier and ordered reasons of each file; red drops amber, a timeout is always named."""
    shown = F.array_join(F.transform("reasons", lambda r: F.concat(r, F.lit(" "))), "")
    return _tiers(spark, sf_dir).select(F.col("path").alias("source"), "tier", shown.alias("reasons"))


@query(
    _REASONS_CTE
    + """
, x AS (SELECT CAST(replace(source, 'src', '') AS INT) % 4 AS lane, CASE WHEN unc THEN 'red' WHEN blob OR drive OR timed_out THEN 'amber' ELSE 'neutral' END AS tier FROM tier)
SELECT lane, count(*) FILTER (WHERE tier = 'neutral') AS neutral, count(*) FILTER (WHERE tier = 'amber') AS amber, count(*) FILTER (WHERE tier = 'red') AS red FROM x GROUP BY lane
"""
)
def tier_by_lane_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files by lane and tier."""
    lanes = _tiers(spark, sf_dir).withColumn("lane", (F.replace("path", F.lit("src"), F.lit("")).cast("int") % 4))
    return rollup.tally(lanes, "lane")


@query(
    _BLOBS_CTE
    + """, h AS (SELECT source, CASE WHEN EXISTS (SELECT 1 FROM b WHERE b.doc_id = d.doc_id) THEN 'x_opaque_blob' WHEN trim(text) = '' THEN 'empty' ELSE 'nothing notable' END AS headline FROM documents d),
c AS (SELECT source, headline, headline = 'x_opaque_blob' AS spotlight, count(*) AS blocks FROM h GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY source ORDER BY spotlight DESC, blocks DESC, headline) - 1 AS place FROM c
"""
)
def block_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of each file counted by what they do."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", (F.trim("text") == "").alias("empty"))
    told = statements.explanations(_document_statements(spark, sf_dir, ["doc_id"]), ["doc_id"])
    none = F.expr("cast(array() as array<struct<rank:int,key:string,evidence:array<string>>>)")
    h = rollup.headline(F.coalesce("statements", none), F.lit(False), F.col("empty"))
    lines = docs.join(told, "doc_id", "left").select("source", h.alias("h")).select("source", F.col("h.text").alias("headline"), "h.spotlight")
    return rollup.block_summary(lines, ["source"])


_DOC_FILE = """
, d AS (SELECT source, count(*) FILTER (WHERE doc_id IN (SELECT doc_id FROM b)) AS unexplained, count(*) FILTER (WHERE n_chars > 20000) AS unreadable, count(*) FILTER (WHERE lang = 'es' AND n_chars < 100) AS autorun FROM documents GROUP BY source)
"""


@query(
    _BLOBS_CTE
    + _DOC_FILE
    + """
SELECT source, CASE WHEN source = 'src3' THEN 'timed_out ' ELSE '' END || CASE WHEN unexplained > 0 THEN 'needs_human ' WHEN unreadable = 0 AND source <> 'src3' THEN 'looks_ordinary ' ELSE '' END
  || CASE WHEN unreadable > 0 THEN 'unreadable ' ELSE '' END || CASE WHEN autorun > 0 THEN 'autorun_present ' ELSE '' END AS steps FROM d
"""
)
def recommendation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Next steps for each file, in order."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars")
    loud = _document_statements(spark, sf_dir, ["doc_id"]).where(F.col("severity") == t.ALARMING).select("doc_id", F.lit(1).alias("loud")).distinct()
    count = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("int"))
    d = docs.join(loud, "doc_id", "left").groupBy("source").agg(
        count(F.col("loud") == 1).alias("unexplained"), count(F.col("n_chars") > 20000).alias("unreadable"), count((F.col("lang") == "es") & (F.col("n_chars") < 100)).alias("autorun")
    )
    steps = rollup.recommendations(F.col("unexplained"), F.lit(0), F.lit(False), F.col("unreadable"), F.col("autorun"), F.col("source") == "src3")
    return d.select("source", F.array_join(F.transform(steps, lambda s: F.concat(s, F.lit(" "))), "").alias("steps"))


@query(_BLOBS_CTE + "SELECT CASE WHEN (SELECT count(*) FROM documents WHERE n_chars > 1000000) > 0 THEN 2 WHEN (SELECT count(*) FROM b) > 0 THEN 1 ELSE 0 END AS exit_code")
def needs_attention_exit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exit code of a whole batch."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    found = _document_statements(spark, sf_dir, ["doc_id"]).select("doc_id", F.lit(True).alias("f")).distinct()
    files = docs.join(found, "doc_id", "left").select(F.coalesce("f", F.lit(False)).alias("has_findings"), F.lit(False).alias("timed_out"))
    return rollup.exit_code(files, docs.where("n_chars > 1000000").select(F.lit(2).alias("code")))


@query(_BLOBS_CTE + "SELECT source, lang, count(*) AS n_statements, 'alarming' AS severity, true AS obfuscated FROM (SELECT DISTINCT source, lang, doc_id FROM b) GROUP BY source, lang")
def severity_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loudest severity and whether anything hides, by source and language."""
    found = _document_statements(spark, sf_dir, ["doc_id", "source", "lang"])
    names = F.array(*(F.lit(s) for s in t.SEVERITIES))
    rolled = found.groupBy("source", "lang").agg(F.count("*").alias("n_statements"), F.max("severity").alias("s"), F.bool_or(F.col("key").isin(t.HIDING)).alias("obfuscated"))
    return rolled.select("source", "lang", "n_statements", F.get(names, F.col("s")).alias("severity"), "obfuscated")


@query("""
SELECT doc_id, replace(replace(text, chr(13), '\\x0d'), chr(10), '\\x0a') AS line, replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), '\\x0d') AS block,
  contains(text, chr(10)) OR contains(text, chr(13)) AS steering FROM documents
""")
def escape_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text made safe for one line and for a block of output."""
    c = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", text.printable_line(c).alias("line"), text.printable_block(c).alias("block"), text.is_steering(c).alias("steering"))


@query("""
WITH f AS (SELECT doc_id, replace(replace(text, chr(13), '\\x0d'), chr(10), '\\x0a') AS line, replace(replace(replace(text, chr(10), '\\n'), chr(13), '\\r'), chr(9), '\\t') AS flat FROM documents),
c AS (SELECT doc_id, line, replace(CASE WHEN length(flat) > 120 THEN substr(flat, 1, 120) || '...' ELSE flat END, '\\', '\\\\') AS x FROM f)
SELECT doc_id, CASE WHEN length(line) > 200 THEN substr(line, 1, 200) || '...' ELSE line END AS shown,
  CASE WHEN contains(x, chr(39)) AND NOT contains(x, '"') THEN '"' || x || '"' ELSE chr(39) || replace(x, chr(39), '\\' || chr(39)) || chr(39) END AS quoted FROM c
""")
def literal_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Literals as a report shows them, and as it quotes those that differ."""
    return table(spark, sf_dir, "documents").select("doc_id", text.show_literal(F.col("text")).alias("shown"), text.quote_literal(F.col("text")).alias("quoted"))


@query("SELECT doc_id, replace(replace(replace(text, chr(10), ''), chr(13), ''), chr(9), '') AS stripped FROM documents")
def printable_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text without control characters."""
    return table(spark, sf_dir, "documents").select("doc_id", text.without_controls(F.col("text")).alias("stripped"))


@query("""
SELECT source, array_to_string(list_sort(list_distinct(list(s)))[1:8], ' ') AS evidence FROM
  (SELECT source, unnest(regexp_extract_all(text, '[^\\s''"]{4,}')) AS s FROM documents) GROUP BY source
""")
def evidence_top8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first eight distinct tokens of each source; distinct before they are collected, eight of each task."""
    d = table(spark, sf_dir, "documents").select("source", F.explode(literals.tokens(F.col("text"))).alias("s")).distinct()
    first = d.withColumn("n", F.row_number().over(Window.partitionBy("source").orderBy("s"))).where(f"n <= {statements.EVIDENCE}")
    return first.groupBy("source").agg(F.array_join(F.sort_array(F.collect_list("s")), " ").alias("evidence"))


@query("SELECT o_orderkey, (o_orderkey // 100) || '.' || (o_orderkey % 100) AS version, 'v' || o_orderkey AS other FROM orders")
def version_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Version numbers as they are displayed; anything but digits stays."""
    raw = F.lpad(F.col("o_orderkey").cast("string"), 12, "0")
    return table(spark, sf_dir, "orders").select("o_orderkey", text.version_display(raw).alias("version"), text.version_display(F.concat(F.lit("v"), F.col("o_orderkey").cast("string"))).alias("other"))


@query("""
WITH c AS (SELECT page_id, unnest(x) AS c, unnest(range(len(x))) AS i FROM (SELECT page_id, regexp_extract_all(html, '[()\\[\\]{}]') AS x FROM pages)),
s AS (SELECT page_id, i, sum(CASE WHEN c IN ('(', '[', '{') THEN 1 ELSE -1 END) OVER (PARTITION BY page_id ORDER BY i) AS s FROM c),
m AS (SELECT page_id, s - least(0, min(s) OVER (PARTITION BY page_id ORDER BY i)) AS d FROM s)
SELECT pages.page_id, CAST(coalesce(max(d), 0) AS BIGINT) AS depth FROM pages LEFT JOIN m ON pages.page_id = m.page_id GROUP BY pages.page_id
""")
def nesting_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greatest bracket depth without parsing; closing ones never lead below zero."""
    return table(spark, sf_dir, "pages").select("page_id", text.max_nesting(F.col("html")).cast("bigint").alias("depth"))


# Driver expressions over a table's rows: a form for each remainder, the reason that each must get.
_EXPRESSIONS = [
    ("clamp(var, 0, {k})", "plain"),
    ("sin(frame / {k})", "plain"),
    ("bpy.data.{w}{k}", "attribute bpy.data.{w}{k}"),
    ("var ** {k}", "operator **"),
    ("log(var, 2, {k})", "arity log/3"),
    ("{k} + min()", "arity min/0"),
    ("[x for x in ({k}, 2)]", "syntax ListComp"),
    ("__import__('{w}{k}')", "function __import__"),
    ("{k} if var > 1 else -{k}", "plain"),
    ("  ", "empty"),
    ("sqrt(x={k})", "arguments sqrt"),
    ("{k} +", "syntax SyntaxError"),
    ("__name{k}", "dunder __name{k}"),
    ("a[{k}]", "syntax Subscript"),
    ("f{k}()(1)", "function ?"),
]
_E = len(_EXPRESSIONS)
_SIMPLE = [k for k, (_, why) in enumerate(_EXPRESSIONS) if why in ("plain", "empty")]

# Script bodies: a form for each remainder, the rules that must fire (a space between them), null if it does not parse.
_SCRIPTS = [
    ("import socket\ns = socket\ns.socket()\n# {k}", "x_network"),
    ("import subprocess as sp\nsp.Popen(['{w}{k}'])", "x_subprocess"),
    ("import base64\nexec(base64.b64decode('{w}{k}'))", "x_dynamic_code x_obfuscation"),
    ("getattr(__builtins__, 'e' + 'val')('{k}')", "x_assembled_name x_builtins_indirection x_indirect_call"),
    ("socket.default_value_set({k})", ""),
    ("import os\nos.makedirs('/srv/{w}{k}')", "x_makedirs"),
    ("f = open('{w}{k}.txt', 'w')", "x_file_write"),
    ("import pickle\npickle.loads(b'{k}')", "x_deserialise"),
    ("import bpy\nclass P(bpy.types.Panel):\n    n = {k}", "x_ui_panel"),
    ("x = 'cmd /c {w}{k}'", "x_living_off_land"),
    ("import ctypes  # {k}", "x_lowlevel"),
    ("def f(:\n  {w}{k}", None),
    ("import http.server  # {k}", "x_network_listen"),
    ("import os as o\no.system('{k}')", "x_subprocess"),
    ("__import__(name{k})", "x_dynamic_code"),
    ("__import__('{w}{k}')", "x_runtime_import"),
    ("import zlib\nzlib.decompress(b{k})", "x_decodes_data"),
    ("import base64\nself.p = base64.b64decode(b{k})\nexec(self.p)", "x_dynamic_code x_obfuscation"),
    ("import bpy\nbpy.app.handlers.load_post.append(f{k})", "x_handler_register"),
    ("from bpy.app.handlers import persistent as keep\n@keep\ndef f{k}(): pass\nimport bpy\nbpy.app.handlers.load_post.append(f{k})", "x_handler_persist"),
    ("p = '~/.ssh/id_rsa{k}'", "x_credentials"),
    ("import webbrowser\nwebbrowser.open('{w}{k}')", "x_opens_browser"),
    ("x = 'http' + '://{w}{k}'", "x_split_literal"),
    ("import bpy\nbpy.app.driver_namespace['{w}{k}'] = f", "x_driver_namespace"),
    ("import os\nos.remove('{w}{k}')", "x_file_delete"),
    ("compile('{k}', '', 'eval')", "x_compile_code"),
    ("i = getattr(__builtins__, '__import__')\ni('{w}{k}')", "x_builtins_indirection x_indirect_call"),
    ("import bpy\nbpy.utils.register_class(P{k})", "x_register"),
    ("import winreg  # {k}", "x_persistence"),
    ("x = '" + "QUJD" * 60 + "{k}'", "x_opaque_blob"),
]
_S = len(_SCRIPTS)


def _filled(form: str, key: str, word: str) -> str:
    return "'" + form.replace("'", "''").replace("\n", "' || chr(10) || '").replace("{k}", f"' || {key} || '").replace("{w}", f"' || {word} || '") + "'"


def _cases(forms: list[str | None], key: str, word: str) -> str:
    return f"CASE {key} % {len(forms)} " + " ".join(f"WHEN {k} THEN {_filled(f, key, word)}" for k, f in enumerate(forms) if f is not None) + " END"


def _form(forms: list[str | None], key: str, word: Column) -> Column:
    """The form of each row's remainder, with its key and a word of it filled in."""
    out = F.lit(None).cast("string")
    for k, f in enumerate(forms):
        filled = F.replace(F.replace(F.lit(f), F.lit("{k}"), F.col(key).cast("string")), F.lit("{w}"), word)
        out = F.when(F.col(key) % len(forms) == k, filled).otherwise(out)
    return out


_PART_WORD = "lower(split_part(p_name, ' ', 1))"


@query(f"SELECT p_partkey, {_cases([e for e, _ in _EXPRESSIONS], 'p_partkey', _PART_WORD)} AS expression, p_partkey % {_E} IN ({', '.join(map(str, _SIMPLE))}) AS is_simple, {_cases([w for _, w in _EXPRESSIONS], 'p_partkey', _PART_WORD)} AS reason FROM part")
def driver_simple(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expressions that the restricted evaluator takes, and the first objection to others; each distinct one parsed once."""
    expression = _form([e for e, _ in _EXPRESSIONS], "p_partkey", F.expr(_PART_WORD))
    rows = table(spark, sf_dir, "part").select("p_partkey", expression.alias("expression"))
    return syntax.classify_expressions(rows, "expression").select("p_partkey", "expression", "is_simple", "reason")


@query(f"SELECT p_partkey, {_cases([k or '' for _, k in _SCRIPTS], 'p_partkey', _PART_WORD)} AS keys, p_partkey % {_S} NOT IN ({', '.join(str(k) for k, (_, keys) in enumerate(_SCRIPTS) if keys is None)}) AS parsed FROM part")
def rule_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rules that each body fires, found through facts, grounding and the rule join; distinct bodies are parsed once."""
    source = _form([b for b, _ in _SCRIPTS], "p_partkey", F.expr(_PART_WORD))
    rows = table(spark, sf_dir, "part").select("p_partkey", source.alias("source")).withColumn("body", text.sha256_hex(F.col("source")))
    facts = stored(syntax.facts(rows), "facts")
    fired = statements.statements(facts).groupBy("body").agg(F.array_join(F.array_sort(F.collect_set("key")), " ").alias("keys"))
    parsed = facts.where("kind in ('parsed', 'unparsed')").select("body", (F.col("kind") == "parsed").alias("parsed"))
    return rows.join(fired, "body", "left").join(parsed, "body", "left").select("p_partkey", F.coalesce("keys", F.lit("")).alias("keys"), "parsed")


@query("""
WITH b AS (SELECT p_partkey, p_partkey % 4 AS k, p_size % 5 AS n FROM part),
f AS (SELECT *, CASE k WHEN 0 THEN 'call ' || n WHEN 1 THEN 'text' WHEN 2 THEN 'class' END AS shape, CASE k WHEN 0 THEN 'p' || p_partkey || '|q' WHEN 1 THEN 'v' || p_partkey || '|b' || p_partkey WHEN 2 THEN 'd' || p_partkey END AS literals FROM b)
SELECT p_partkey, min(p_partkey) OVER (PARTITION BY shape) AS first_alike, count(*) OVER (PARTITION BY shape) AS n_alike, literals FROM f WHERE shape IS NOT NULL
UNION ALL SELECT p_partkey, 0, 0, NULL FROM f WHERE shape IS NULL
""")
def structure_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies of equal syntax, whatever text stands in their literals, and those literals in order; null where a body does not parse."""
    form = F.lit("def f(:  # {k}")
    for k, body in enumerate(["f('p{k}', {n}, x='q')  # {k}", "a = 'v{k}'\nb = b'b{k}'", "class C:\n    'd{k}'"]):
        form = F.when(F.col("p_partkey") % 4 == k, F.lit(body)).otherwise(form)
    source = F.replace(F.replace(form, F.lit("{k}"), F.col("p_partkey").cast("string")), F.lit("{n}"), (F.col("p_size") % 5).cast("string"))
    rows = table(spark, sf_dir, "part").select("p_partkey", source.alias("source"))
    rows = stored(rows.withColumn("body", text.sha256_hex(F.col("source"))), "bodies")
    facts = stored(syntax.facts(rows), "facts")
    shape = facts.where("kind = 'structure'").select("body", F.col("value").alias("shape"))
    taken = facts.where("kind = 'literal'").groupBy("body").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "value"))), lambda x: x["value"]), "|").alias("literals"))
    held = stored(rows.select("p_partkey", "body").join(shape, "body", "left").join(taken, "body", "left"), "shapes")
    alike = identity.first_seen(held.where("shape is not null"), "shape", "p_partkey").select("shape", F.col("first").alias("first_alike"), F.col("n").alias("n_alike"))
    return held.join(alike, "shape", "left").select("p_partkey", F.coalesce(F.col("first_alike").cast("bigint"), F.lit(0)).alias("first_alike"), F.coalesce("n_alike", F.lit(0)).alias("n_alike"), "literals")


# A container for each customer: a script, a driver, a linked library, a shader node and an image, by its key.
_CUSTOMER_WORD = "lower(c_mktsegment)"
_LIBRARIES = ["//lib/{k}.blend", "//../{k}.blend", "D:/{k}.blend", "\\\\host{k}\\share\\x.blend"]
_L = len(_LIBRARIES) + 1  # one remainder has none


def _customer_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("bigint").alias("k"),
        F.col("c_nationkey").cast("int").alias("n"),
        _form([b for b, _ in _SCRIPTS], "c_custkey", F.expr(_CUSTOMER_WORD)).alias("body"),
        _form([e for e, _ in _EXPRESSIONS], "c_custkey", F.expr(_CUSTOMER_WORD)).alias("expression"),
        _form([*_LIBRARIES, None], "c_custkey", F.lit("")).alias("library"),
    )

    def write(batches):
        import pyarrow as pa

        for batch in batches:
            made = []
            for k, n, body, expression, library in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                box = Writer()
                box.text(f"{k}.py" if k % 2 else "notes", body, flags=16 if k % 7 == 0 else 4)
                box.driver(expression, kind=1 if n % 3 else 2, owner="" if k % 11 == 0 else f"location{k}", index=n % 3)
                if library:
                    box.library(library)
                if k % 6 < 2:
                    box.node(1 - k % 6, "C:/x.osl", "abc", b"\1\2\3" if k % 6 == 0 else None)
                if k % 2 == 0:
                    box.linked("IM", f"img{k}", f"//tex/{k}.png")
                made.append(box.to_bytes(version="300" if k % 2 else "405"))
            yield pa.RecordBatch.from_arrays([pa.array([str(k) for k in batch.column(0).to_pylist()]), pa.array(made, pa.binary())], names=["path", "content"])

    # The table is one small file; containers are made and read in as many tasks as there are cores, once.
    dealt = rows.repartition(spark.sparkContext.defaultParallelism, "k")
    return stored(container.inspect_rows(dealt.mapInArrow(write, "path string, content binary")), "containers")


def _having(key: str) -> str:
    """SQL: whether a customer's script fires a rule."""
    at = [str(k) for k, (_, keys) in enumerate(_SCRIPTS) if keys and key in keys.split()]
    return f"c_custkey % {_S} IN ({', '.join(at)})" if at else "false"


_BLANK = [str(k) for k, (e, _) in enumerate(_EXPRESSIONS) if not e.strip()]
_DRIVEN = f"(c_custkey % {_E} NOT IN ({', '.join(_BLANK)}) AND c_nationkey % 3 <> 0)"  # has a driver that is evaluated
_IMPORTING = f"({_DRIVEN} AND c_custkey % {_E} = {next(k for k, (e, _) in enumerate(_EXPRESSIONS) if e.startswith('__import__'))})"
_FIRED = {x for _, keys in _SCRIPTS for x in (keys or "").split()}
_LOUD = _FIRED & ({key for key, severity, _, _ in t.RULES if severity == t.ALARMING} | set(t.HIDING) | {"x_living_off_land", "x_persistence", "x_credentials"})
_QUIET = _FIRED & ({key for key, severity, _, _ in t.RULES if severity == t.BENIGN} | {"x_driver_namespace"})
_UNREAD = f"(c_custkey % {_S} = {next(k for k, (_, keys) in enumerate(_SCRIPTS) if keys is None)} AND (c_custkey % 7 = 0 OR c_custkey % 2 = 1))"


def _any(keys: set[str]) -> str:
    return "(" + " OR ".join(map(_having, sorted(keys))) + ")"


_REDS = {r: _having(r) for r in t.RED} | {"library_unc": f"c_custkey % {_L} = 3"}
_AMBERS = {r: _having(r) for r in t.REASONS if r.startswith("x_") and r not in t.RED and r not in _QUIET} | {
    "autorun_unrecognised": "c_custkey % 7 = 0",
    "unreadable_script": _UNREAD,
    "x_runtime_import": f"({_having('x_runtime_import')} OR {_IMPORTING})",
    "driver_not_simple": f"({_DRIVEN} AND c_custkey % {_E} NOT IN ({', '.join(map(str, _SIMPLE))}))",
    "osl_bytecode": "c_custkey % 6 = 0",
    "library_drive_letter": f"c_custkey % {_L} = 2",
}
_TOLD = " || ".join(f"CASE WHEN {'' if r in _REDS else 'NOT '}red AND {(_REDS | _AMBERS)[r]} THEN '{r} ' ELSE '' END" for r in t.REASONS if r in _REDS or r in _AMBERS)


@query(f"""
WITH c AS (SELECT *, {" OR ".join(_REDS.values())} AS red, {" OR ".join(_AMBERS.values())} AS amber, {_any(_LOUD)} OR c_custkey % {_L} IN (2, 3) AS human, {_UNREAD} AS unread FROM customer)
SELECT c_custkey, CASE WHEN red THEN 'red' WHEN amber THEN 'amber' ELSE 'neutral' END AS tier, {_TOLD} AS reasons,
  CASE WHEN human THEN 'needs_human ' WHEN NOT unread THEN 'looks_ordinary ' ELSE '' END || CASE WHEN unread THEN 'unreadable ' ELSE '' END || CASE WHEN c_custkey % 7 = 0 THEN 'autorun_present ' ELSE '' END AS steps,
  CASE WHEN c_custkey % 2 = 1 THEN '3.0' ELSE '4.5' END AS version FROM c
""")
def report_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tier, reasons and next steps of whole files, from texts, drivers, libraries and nodes together."""
    out = inspect.reports(spark, _customer_containers(spark, sf_dir))
    flat = lambda c: F.array_join(F.transform(c, lambda x: F.concat(x, F.lit(" "))), "")
    return out.select(F.col("path").cast("bigint").alias("c_custkey"), "tier", flat(F.col("reasons")).alias("reasons"), flat(F.col("steps")).alias("steps"), F.col("version_display").alias("version"))


@query(f"""
SELECT c_custkey, 'text' AS category, CASE WHEN c_custkey % 2 = 1 THEN c_custkey || '.py' ELSE 'notes' END AS name,
  CASE WHEN {_any(_LOUD)} THEN 'alarming' WHEN {_any(_FIRED - _LOUD - _QUIET)} THEN 'notable' WHEN {_any(_QUIET)} THEN 'benign' END AS severity, {_cases([k or '' for _, k in _SCRIPTS], "c_custkey", _CUSTOMER_WORD)} AS keys FROM customer
UNION ALL SELECT c_custkey, 'driver', CASE WHEN c_custkey % 11 = 0 THEN '<unattached driver>' ELSE 'location' || c_custkey || CASE WHEN c_nationkey % 3 <> 0 THEN '[' || (c_nationkey % 3) || ']' ELSE '' END END,
  CASE WHEN {_IMPORTING} THEN 'notable' END, CASE WHEN {_IMPORTING} THEN 'x_runtime_import' ELSE '' END FROM customer WHERE c_custkey % {_E} NOT IN ({", ".join(_BLANK)})
UNION ALL SELECT c_custkey, 'library', {_cases([*_LIBRARIES, None], "c_custkey", "''")}, NULL, '' FROM customer WHERE c_custkey % {_L} <> {_L - 1}
UNION ALL SELECT c_custkey, 'osl', CASE c_custkey % 6 WHEN 0 THEN 'NODE_SCRIPT_EXTERNAL' ELSE 'NODE_SCRIPT_INTERNAL' END, NULL, '' FROM customer WHERE c_custkey % 6 < 2
UNION ALL SELECT c_custkey, 'filepath', 'img' || c_custkey, NULL, '' FROM customer WHERE c_custkey % 2 = 0
""")
def report_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every finding of every file with its loudest severity and the rules that fired."""
    found = inspect.findings(inspect.inspection(spark, _customer_containers(spark, sf_dir)))
    keys = F.array_join(F.array_sort(F.transform("statements", lambda s: s["key"])), " ")
    return found.select(F.col("path").cast("bigint").alias("c_custkey"), "category", "name", "severity", keys.alias("keys"))


@query(f"""
SELECT c_custkey, CASE WHEN c_custkey % 11 = 0 THEN '<unattached driver>' ELSE 'location' || c_custkey || CASE WHEN c_nationkey % 3 <> 0 THEN '[' || (c_nationkey % 3) || ']' ELSE '' END END AS owner,
  {_cases([e for e, _ in _EXPRESSIONS], "c_custkey", _CUSTOMER_WORD)} AS expression, CASE WHEN c_nationkey % 3 <> 0 THEN 'DRIVER_TYPE_PYTHON' ELSE 'DRIVER_TYPE_SUM' END AS driver_type, c_nationkey % 3 <> 0 AS evaluated,
  CASE WHEN c_nationkey % 3 <> 0 THEN {_cases([w for _, w in _EXPRESSIONS], "c_custkey", _CUSTOMER_WORD)} END AS reason FROM customer WHERE c_custkey % {_E} NOT IN ({", ".join(_BLANK)})
""")
def driver_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drivers of containers with their owner, whether their expression is live, and what is said against it."""
    drivers = container.drivers(_customer_containers(spark, sf_dir))
    judged = syntax.classify_expressions(drivers, "body")
    return judged.select(F.col("path").cast("bigint").alias("c_custkey"), "owner", "expression", F.col("driver_type_name").alias("driver_type"), F.col("expression_is_evaluated").alias("evaluated"), F.when(F.col("expression_is_evaluated"), F.col("reason")).alias("reason"))


_BASES = ["/srv/site", "C:\\site", "\\\\nas\\share\\site", "site/x"]


@query(
    _RAW_CTE
    + r""",
w AS (SELECT r.page_id, r.raw, k, r.page_id // 10 % 4 AS b, CASE WHEN k IN (1, 4) THEN substr(r.raw, 3) ELSE r.raw END AS path FROM r),
s AS (SELECT page_id, raw, k, b, list_filter(string_split(replace(path, '\', '/'), '/'), lambda x: x NOT IN ('', '.')) AS parts FROM w),
j AS (SELECT *, CASE b WHEN 0 THEN ['srv', 'site'] WHEN 1 THEN ['site'] WHEN 2 THEN ['site'] ELSE ['site', 'x'] END AS base FROM s),
e AS (SELECT *, CASE k WHEN 1 THEN base || parts WHEN 4 THEN base[1:len(base) - 1] || parts[2:] WHEN 7 THEN base || ['a'] || parts[4:] WHEN 9 THEN base[1:len(base) - 1] || parts[4:] END AS held FROM j)
SELECT page_id, raw, CASE WHEN k IN (1, 4, 7, 9) THEN CASE b WHEN 0 THEN '/' WHEN 1 THEN 'C:\' WHEN 2 THEN '\\nas\share\' ELSE '' END || CASE WHEN b IN (1, 2) THEN array_to_string(held, '\') ELSE array_to_string(held, '/') END END AS resolved,
  k IN (4, 9) AS escapes_folder, k NOT IN (1, 7) AS notable FROM e
"""
)
def library_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linked paths laid on POSIX, Windows and relative bases, and whether they are worth a note."""
    base = F.get(F.array(*map(F.lit, _BASES)), (F.floor(F.col("page_id") / 10) % 4).cast("int"))
    c = paths.classify(F.col("raw"), base)
    return _raw_path(spark, sf_dir).select("page_id", "raw", c["resolved_path"].alias("resolved"), c["escapes_folder"].alias("escapes_folder"), c["notable"].alias("notable"))


@query("SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS body, length(string_agg(text, chr(10) ORDER BY turn)) AS source_bytes, conv_id % 3 = 0 AS is_autorun FROM conversations GROUP BY conv_id")
def container_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations written as containers, one each, and their text blocks read back."""
    chains = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("lines"))

    def write(batches):
        import pyarrow as pa

        for batch in batches:
            made = []
            for conv, lines in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                box = Writer()
                box.text(f"{conv}.py", "\n".join(lines), flags=16 if conv % 3 == 0 else 0)
                made.append(box.to_bytes(large=conv % 2 == 0))
            yield pa.RecordBatch.from_arrays([pa.array([str(c) for c in batch.column(0).to_pylist()]), pa.array(made, pa.binary())], names=["path", "content"])

    read = container.texts(container.inspect_rows(chains.mapInArrow(write, "path string, content binary")))
    return read.select(F.col("path").cast("bigint").alias("conv_id"), F.col("source").alias("body"), "source_bytes", "is_autorun")


def _written(name: str, body: str) -> bytes:
    box = Writer()
    box.text(name, body)
    return box.to_bytes()


_EMPTY = len(_written("page", ""))  # bytes of a container around its text
_MOST = 6000  # the limit on files below, in bytes


@query(f"""
WITH p AS (SELECT page_id, page_id % 6 AS k, replace(coalesce(html, ''), chr(10), ' ') AS body FROM pages),
s AS (SELECT *, CASE k WHEN 1 THEN {_EMPTY} + strlen(body) - 9 WHEN 3 THEN 4 + strlen(body) WHEN 4 THEN 0 ELSE {_EMPTY} + strlen(body) END AS size FROM p),
m AS (SELECT *, CASE WHEN size > {_MOST} THEN 'file too large' WHEN k = 1 THEN 'truncated at ' || ({_EMPTY} + strlen(body) - 24) WHEN k = 2 THEN 'no DNA1 block' WHEN k = 3 THEN 'bad magic' WHEN k = 4 THEN 'decompression bomb' WHEN k = 5 THEN 'block length -1 is negative' END AS message FROM s)
SELECT page_id, CASE WHEN message = 'bad magic' THEN 'not_a_blend' WHEN message IS NOT NULL THEN 'malformed' END AS kind, message, CASE WHEN message IS NULL THEN length(body) ELSE 0 END AS source_bytes FROM m
""")
def container_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written to files of their own, five of six damaged in one way each, and read by the data source: an error row or a text each."""

    def write(batches):
        import gzip

        import pyarrow as pa

        for batch in batches:
            made = []
            for k, body in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                sound = _written("page", body[:100] if k == 4 else body)
                made.append([sound, sound[:-9], sound.replace(b"DNA1", b"DNA2", 1), b"PK\3\4" + body.encode(), gzip.compress(sound), sound[:16] + b"\xff" * 4 + sound[20:]][k])
            names = [f"{p}.blend" for p in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(made, pa.binary())], names=["name", "content"])

    held = table(spark, sf_dir, "pages").select("page_id", (F.col("page_id") % 6).cast("int").alias("k"), F.replace(F.coalesce("html", F.lit("")), F.lit("\n"), F.lit(" ")).alias("body"))
    folder = f"{shared_folder(spark)}/refusals-{uuid.uuid4().hex}"
    write_files(held.repartition(spark.sparkContext.defaultParallelism, "page_id").mapInArrow(write, "name string, content binary"), folder)
    rows = stored(container.read(spark, folder, container.Limits(file_bytes=_MOST, inflated_bytes=500), categories=["text", "error"]), "refusals")
    page = F.regexp_extract("path", r"(\d+)\.blend$", 1).cast("bigint").alias("page_id")
    said = container.errors(rows).select(page, "kind", "message").withColumn("source_bytes", F.lit(0).cast("bigint"))
    none = F.lit(None).cast("string")
    return said.unionByName(container.texts(rows).select(page, none.alias("kind"), none.alias("message"), "source_bytes"))


_BUDGET = 100


@query(f"""
WITH f AS (SELECT o_orderkey, o_orderkey % 60 AS spent, CASE WHEN o_orderkey % 17 = 0 THEN 'library' END AS reader FROM orders),
l AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber <= 3 THEN 'text' ELSE 'driver' END AS stage, CAST(l_quantity AS BIGINT) AS ms, l_partkey % 97 = 0 AS late, l_suppkey % 5 = 0 AS notable FROM lineitem),
u AS (SELECT l.*, spent + sum(ms) OVER w <= {_BUDGET} AND NOT bool_or(late) OVER w AS kept FROM l JOIN f ON l_orderkey = o_orderkey WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber)),
p AS (SELECT l_orderkey, count(*) FILTER (WHERE kept) AS n_kept, bool_or(kept AND notable) AS notable, arg_min(stage, l_linenumber) FILTER (WHERE NOT kept) AS cut FROM u GROUP BY l_orderkey)
SELECT o_orderkey, coalesce(cut, reader) AS timed_out_at, coalesce(n_kept, 0) AS n_kept, CASE WHEN coalesce(notable, false) OR coalesce(cut, reader) IS NOT NULL THEN 'amber' ELSE 'neutral' END AS tier,
  CASE WHEN coalesce(cut, reader) IS NOT NULL THEN 'scan_timed_out ' ELSE '' END || CASE WHEN coalesce(notable, false) THEN 'osl_bytecode ' ELSE '' END AS reasons,
  CASE WHEN coalesce(cut, reader) IS NOT NULL THEN 'timed_out ' ELSE 'looks_ordinary ' END AS steps
FROM f LEFT JOIN p ON l_orderkey = o_orderkey
""")
def report_timeouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as files and their lines as bodies that take so many milliseconds: what one budget a file leaves of them, and what their report says."""
    key = F.col("o_orderkey").cast("string").alias("path")
    files = table(spark, sf_dir, "orders").select(key, (F.col("o_orderkey") % 60).alias("spent"), (F.col("o_orderkey") % 17 == 0).alias("timed_out"), F.when(F.col("o_orderkey") % 17 == 0, "library").alias("timed_out_at"))
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("path"), F.when(F.col("l_linenumber") <= 3, "text").otherwise("driver").alias("stage"), F.col("l_linenumber").alias("place"), F.col("l_quantity").cast("bigint").alias("ms"), (F.col("l_partkey") % 97 == 0).alias("late"), (F.col("l_suppkey") % 5 == 0).alias("notable")
    )
    files, lines = inspect.ledger(files, lines, _BUDGET)
    files, kept = stored(files, "files"), stored(lines.where("kept"), "kept")
    reasons = rollup.node_reasons(kept.where("notable").select("path", F.lit(1).alias("bytecode_bytes"))).withColumn("script", F.lit(None).cast("string"))
    out = files.drop("timed_out").join(rollup.tiers(files, reasons), "path").join(kept.groupBy("path").agg(F.count("*").alias("n_kept")), "path", "left")
    flat = lambda c: F.array_join(F.transform(c, lambda x: F.concat(x, F.lit(" "))), "")
    zero, no = F.lit(0), F.lit(False)
    steps = rollup.recommendations(zero, zero, no, zero, zero, F.col("timed_out"))
    return out.select(F.col("path").cast("bigint").alias("o_orderkey"), "timed_out_at", F.coalesce("n_kept", zero).cast("bigint").alias("n_kept"), "tier", flat(F.col("reasons")).alias("reasons"), flat(steps).alias("steps"))


@query(f"""
WITH u AS (SELECT page_id, url, regexp_extract(url, '://([^/:?#]+)', 1) AS host FROM pages),
l AS (SELECT page_id, 'url' AS kind, url AS value FROM u
  UNION SELECT page_id, 'host', host FROM u WHERE page_id % 3 <> 0 AND lower(regexp_extract(host, '[^.]*$')) IN ({_list(_HOSTS)})
  UNION SELECT page_id, 'command', 'curl -s ' || url FROM u WHERE page_id % 5 = 0
  UNION SELECT page_id, 'path', 'curl -s ' || url FROM u WHERE page_id % 15 IN (5, 10) AND regexp_matches(url, '[/\\\\][{_W} -]+[.][A-Za-z0-9]{{1,8}}$')
  UNION SELECT page_id, 'path', '/srv/' || page_id || '/x.bin' FROM u WHERE page_id % 3 <> 0)
SELECT page_id, CASE WHEN page_id % 3 <> 0 THEN 'alarming' END AS severity, string_agg(kind || ' ' || value, chr(10) ORDER BY CASE kind WHEN 'url' THEN 0 WHEN 'host' THEN 1 WHEN 'command' THEN 2 ELSE 3 END, value) AS literals
FROM l WHERE NOT (page_id % 3 = 0 AND kind = 'command') GROUP BY page_id
""")
def finding_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A script for each page, one of three of which does not parse: what its finding says of urls, hosts, commands and paths in its strings."""

    def write(batches):
        import pyarrow as pa

        for batch in batches:
            made = []
            for k, url, host in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                box = Writer()
                lines = ["import socket", f"get({url!r}, '{host}')", f"open('/srv/{k}/x.bin')"] if k % 3 else ["def f(:", f"get( {url!r} )"]
                box.text("page", "\n".join([*lines, f"run('curl -s {url}')" if k % 5 == 0 and k % 3 else ""]))
                made.append(box.to_bytes(large=k % 2 == 0))
            yield pa.RecordBatch.from_arrays([pa.array([str(k) for k in batch.column(0).to_pylist()]), pa.array(made, pa.binary())], names=["path", "content"])

    rows = table(spark, sf_dir, "pages").select("page_id", "url", F.regexp_extract("url", "://([^/:?#]+)", 1).alias("host")).repartition(spark.sparkContext.defaultParallelism, "page_id")
    of = inspect.inspection(spark, container.inspect_rows(rows.mapInArrow(write, "path string, content binary")))
    lines = F.array_join(F.transform("literals", lambda x: F.concat_ws(" ", x["kind"], x["value"])), "\n")
    return inspect.findings(of).select(F.col("path").cast("bigint").alias("page_id"), "severity", lines.alias("literals"))
