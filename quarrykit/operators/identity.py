"""Matching bodies to a table of known scripts, by bytes first and by structure second."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrykit.functions.text import is_sha256, without_controls

#: Bytes up to which the table of known scripts is broadcast.
MAX_BYTES = 32 << 20
REQUIRED = ("sha256", "script_name", "byte_size", "origin", "source_url", "fetched_on", "attested_by", "attested_on", "notes")
# Ceilings of a table of known scripts; beyond them the table, or the entry, is refused.
TABLE_BYTES, TABLE_ENTRIES, ENTRY_LITERALS = 8 << 20, 20_000, 200_000
SCHEMA, SCHEME = 2, "1"
NO_TABLE = -1  # the place of problems that are a whole table's


def load_known(spark: SparkSession, path: str, table_bytes: int = TABLE_BYTES) -> tuple[DataFrame, DataFrame]:
    """(entries, problems) of a JSON file ``{"schema": 2, "entries": [...]}``; see ``known_entries``. A file that is missing or too large is not read."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at)
    problem = "missing table" if not found else "table too large" if any(f.getLen() > table_bytes for f in found) else None
    raw = spark.read.text(path, wholetext=True) if problem is None else spark.createDataFrame([], "value string")
    entries, problems = known_entries(raw, table_bytes=table_bytes)
    return entries, problems if problem is None else spark.createDataFrame([(NO_TABLE, problem)], "place int, problem string")


def known_entries(raw: DataFrame, value: str = "value", keys: list[str] | None = None, table_bytes: int = TABLE_BYTES) -> tuple[DataFrame, DataFrame]:
    """(entries, problems) of JSON tables in a column, with the ``keys`` of their row; one bad entry spoils only itself, whatever it is.

    A table that is no JSON, has another schema or goes beyond a ceiling gives one problem and no
    entries. Entries are taken apart as variants, so an entry that is no object is one
    problem beside the others.
    """
    keys = keys or []
    kind = lambda v, at: F.expr(f"schema_of_variant(try_variant_get({v}, '{at}', 'variant'))")
    body = raw.select(*keys, F.octet_length(value).alias("bytes"), F.when(F.octet_length(value) <= table_bytes, F.expr(f"try_parse_json({value})")).alias("v"))
    body = body.select(*keys, "bytes", "v", F.expr("try_variant_get(v, '$.entries', 'array<variant>')").alias("listed"))
    fits = (kind("v", "$.schema") == "BIGINT") & (F.expr("try_variant_get(v, '$.schema', 'bigint')") == SCHEMA) & F.col("listed").isNotNull()
    unusable = F.when(F.col("bytes") > table_bytes, "table too large").when(~F.coalesce(fits, F.lit(False)), "unusable table").when(F.size("listed") > TABLE_ENTRIES, "too many entries")
    told = body.withColumn("unusable", unusable)
    each = told.where("unusable is null").select(*keys, F.posexplode("listed").alias("place", "e"))
    get = lambda at, cast="string": F.expr(f"try_variant_get(e, '$.{at}', '{cast}')")
    given = lambda at: F.coalesce(kind("e", f"$.{at}") != "VOID", F.lit(False))
    is_object = F.expr("schema_of_variant(e)").startswith("OBJECT")
    has_shape, is_flagged = given("structure"), given("generated")
    flat = each.select(*keys, "place", F.coalesce(is_object, F.lit(False)).alias("is_object"), *(get(c).alias(c) for c in REQUIRED), has_shape.alias("has_shape"), get("structure.scheme").alias("scheme"), get("structure.sha256").alias("shape"), get("structure.literals", "array<string>").alias("literals"), is_flagged.alias("is_flagged"), (kind("e", "$.generated") == "BOOLEAN").alias("flag_fits"), get("generated", "boolean").alias("flag"))
    shape = (F.col("scheme") == SCHEME) & is_sha256(F.col("shape")) & F.col("literals").isNotNull()
    problem = (
        F.when(~F.col("is_object"), "not an object")
        .when(F.exists(F.array(*(F.col(c) for c in REQUIRED)), lambda c: c.isNull()), "missing field")
        .when(~is_sha256(F.col("sha256")), "not a digest")
        .when(F.col("has_shape") & ~F.coalesce(shape, F.lit(False)), "bad structure")
        .when(F.col("has_shape") & (F.size("literals") > ENTRY_LITERALS), "too many literals")
        .when(F.col("is_flagged") & ~F.col("flag_fits"), "generated is not a boolean")
        .when(F.col("has_shape") & (F.coalesce("flag", F.lit(True)) == F.lit(False)), "generated contradicts structure")
    )
    checked = flat.withColumn("problem", problem)
    names = [c for c in REQUIRED if c not in ("sha256", "byte_size")]
    entries = checked.where("problem is null").select(
        *keys, "place", F.lower(F.trim("sha256")).alias("sha256"), F.expr("try_cast(byte_size as int)").alias("byte_size"), *(without_controls(F.col(c)).alias(c) for c in names), (F.coalesce("flag", F.lit(False)) | F.col("has_shape")).alias("generated"), F.when(F.col("has_shape"), F.lower("shape")).alias("structure_sha256"), F.when(F.col("has_shape"), F.col("literals")).alias("literals")
    )
    whole = told.where("unusable is not null").select(*keys, F.lit(NO_TABLE), "unusable")
    return entries, checked.where("problem is not null").select(*keys, "place", "problem").union(whole)


def warnings_of(problems: DataFrame, most: int = 20) -> list[str]:
    """Problems of a table of known scripts as lines of a report: the first few, and how many more there are."""
    held = problems.orderBy("place", "problem").limit(most).collect()
    lines = [f"known scripts: {r['problem']}" if r["place"] == NO_TABLE else f"known scripts: entry {r['place']}: {r['problem']}" for r in held]
    more = problems.count() - len(held) if len(held) == most else 0
    return [*lines, f"known scripts: {more} more problems"] if more else lines


def last_wins(entries: DataFrame, key: str, order: str) -> DataFrame:
    """One entry a key: the last listed. Counted by key before the shuffle, so repeated keys are no burden."""
    held = [c for c in entries.columns if c != key]
    return entries.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*held), F.col(order)).alias("_e")).select(key, "_e.*")


def differences(reference: Column, actual: Column) -> Column:
    """array<struct<index, reference, actual>> of places where two lists differ, over the shorter one."""
    n = F.least(F.size(reference), F.size(actual))
    pairs = F.arrays_zip(F.slice(reference, 1, n).alias("reference"), F.slice(actual, 1, n).alias("actual"))
    indexed = F.transform(pairs, lambda p, i: F.struct(i.alias("index"), p["reference"].alias("reference"), p["actual"].alias("actual")))
    return F.filter(indexed, lambda d: d["reference"] != d["actual"])


def match(bodies: DataFrame, known: DataFrame, *, sha_col: str = "sha256", structure_col: str = "structure_sha256", literals_col: str = "literals") -> DataFrame:
    """``bodies`` with evidence (bytes, structure or null), the entry and its differing literals.

    The table of known scripts is measured, as JSON, and broadcast up to MAX_BYTES; a larger one
    is joined by Spark's choice. A byte match suppresses escalation unless the entry was generated.
    """
    small = (known.agg(F.sum(F.length(F.to_json(F.struct(*known.columns))))).first()[0] or 0) <= MAX_BYTES
    hint = F.broadcast if small else (lambda d: d)
    entry = F.struct(*known.columns)
    by_bytes = hint(last_wins(known.select("sha256", "place", entry.alias("by_bytes")), "sha256", "place").select(F.col("sha256").alias(sha_col), "by_bytes"))
    by_shape = hint(last_wins(known.select("structure_sha256", "place", entry.alias("by_shape")), "structure_sha256", "place").select(F.col("structure_sha256").alias(structure_col), "by_shape"))
    joined = bodies.join(by_bytes, sha_col, "left").join(by_shape, structure_col, "left")
    found = F.coalesce("by_bytes", "by_shape")
    evidence = F.when(F.col("by_bytes").isNotNull(), "bytes").when(F.col("by_shape").isNotNull(), "structure")
    changed = F.when(evidence == "structure", differences(F.col("by_shape.literals"), F.col(literals_col)))
    clears = F.coalesce((evidence == "bytes") & ~F.col("by_bytes.generated"), F.lit(False))
    return joined.select(*bodies.columns, evidence.alias("evidence"), found.alias("entry"), changed.alias("differing_literals"), clears.alias("suppresses_escalation"))


def first_seen(rows: DataFrame, key: str, order: str) -> DataFrame:
    """(key, first, n): the first row of each key and how many there are."""
    return rows.groupBy(key).agg(F.min(order).alias("first"), F.count("*").alias("n"))
