"""Reasons, tiers, summaries and next steps: every rollup is one grouped aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrykit.functions import tables as t

RECOGNISED = 3


def ordered_reasons(reasons: Column) -> Column:
    """The distinct reasons in their fixed order."""
    return F.filter(F.array(*(F.lit(r) for r in t.REASONS)), lambda r: F.array_contains(reasons, r))


def statement_reasons(statements: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, tier, reason) that statements (keys, key, severity) stand for; benign ones give none."""
    red = F.col("key").isin(t.RED)
    return statements.where(red | (F.col("severity") >= t.NOTABLE)).select(*keys, F.when(red, "red").otherwise("amber").alias("tier"), F.col("key").alias("reason"))


def text_reasons(texts: DataFrame, statements: DataFrame, keys: list[str], path_col: str = "path") -> DataFrame:
    """(path, tier, reason, script) of text blocks.

    ``texts`` has parsed, autorun, name, cleared (a known release byte for byte) and label. A
    cleared block loses its amber reasons, never its red ones.
    """
    blind = F.col("parsed").eqNullSafe(F.lit(False)) & (F.col("is_autorun") | F.col("name").endswith(".py"))
    own = texts.select(*keys, F.explode(F.filter(F.array(F.when(blind, F.lit("unreadable_script")), F.when(F.col("is_autorun"), F.lit("autorun_unrecognised"))), lambda r: r.isNotNull())).alias("reason"))
    rows = statement_reasons(statements, keys).unionByName(own.withColumn("tier", F.lit("amber")))
    held = rows.join(texts.select(*keys, *([path_col] if path_col not in keys else []), "cleared", "label"), keys)
    return held.where("tier = 'red' or not cleared").select(path_col, "tier", "reason", F.when(F.col("cleared") & (F.col("tier") == "red"), F.col("label")).alias("script"))


def library_reasons(libraries: DataFrame) -> DataFrame:
    """(path, tier, reason): a share is red, a drive letter amber, anything else nothing."""
    found = F.filter(F.array(F.when(F.col("is_unc"), F.struct(F.lit("red").alias("tier"), F.lit("library_unc").alias("reason"))), F.when(F.col("has_drive_letter"), F.struct(F.lit("amber").alias("tier"), F.lit("library_drive_letter").alias("reason")))), lambda r: r.isNotNull())
    return libraries.select("path", F.explode(found).alias("r")).select("path", "r.tier", "r.reason")


def driver_reasons(drivers: DataFrame) -> DataFrame:
    """(path, tier, reason) of drivers whose expression is evaluated; an unknown is_simple counts as nothing."""
    return drivers.where("expression_is_evaluated and is_simple = false").select("path", F.lit("amber").alias("tier"), F.lit("driver_not_simple").alias("reason"))


def node_reasons(nodes: DataFrame) -> DataFrame:
    return nodes.where("bytecode_bytes > 0").select("path", F.lit("amber").alias("tier"), F.lit("osl_bytecode").alias("reason"))


def tiers(files: DataFrame, reasons: DataFrame, key: str = "path") -> DataFrame:
    """One row a file: tier, ordered reasons and recognised releases.

    ``files`` has the key and timed_out; ``reasons`` (key, tier, reason, script). Red drops amber
    reasons; a timeout is always named. Reasons are a fixed set, so a file of any size
    aggregates to a few values before the shuffle.
    """
    sets = reasons.groupBy(key).agg(
        F.collect_set(F.when(F.col("tier") == "red", F.col("reason"))).alias("red"),
        F.collect_set(F.when(F.col("tier") == "amber", F.col("reason"))).alias("amber"),
        F.slice(F.array_sort(F.collect_set("script")), 1, RECOGNISED).alias("scripts"),
    )
    joined = files.select(key, "timed_out").join(sets, key, "left")
    none = F.expr("cast(array() as array<string>)")
    red, amber = F.coalesce("red", none), F.concat(F.coalesce("amber", none), F.when(F.col("timed_out"), F.array(F.lit("scan_timed_out"))).otherwise(none))
    tier = F.when(F.size(red) > 0, "red").when(F.size(amber) > 0, "amber").otherwise("neutral")
    late = F.when(F.col("timed_out"), F.array(F.lit("scan_timed_out"))).otherwise(none)
    shown = F.when(tier == "red", F.concat(red, late)).otherwise(amber)
    return joined.select(key, tier.alias("tier"), ordered_reasons(shown).alias("reasons"), F.when(tier == "red", F.coalesce("scripts", none)).otherwise(none).alias("recognised"), "timed_out")


def tally(rows: DataFrame, lane: str, tier: str = "tier") -> DataFrame:
    """Files of each lane by tier."""
    return rows.groupBy(lane).pivot(tier, ["neutral", "amber", "red"]).count().na.fill(0, ["neutral", "amber", "red"])


def block_summary(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, headline, spotlight, blocks, place): what blocks do, spotlit ones first, then the commonest."""
    counted = rows.groupBy(*keys, "headline", "spotlight").agg(F.count("*").alias("blocks"))
    nested = counted.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct((~F.col("spotlight")).alias("quiet"), (-F.col("blocks")).alias("less"), "headline"))).alias("s"))
    return nested.select(*keys, F.posexplode("s").alias("place", "r")).select(*keys, "place", "r.headline", (~F.col("r.quiet")).alias("spotlight"), (-F.col("r.less")).alias("blocks"))


def headline(statements: Column, obfuscated: Column, empty: Column) -> Column:
    """struct<text, spotlight> of a block: its two loudest facts, else what hides, else what is notable, else the first benign one.

    ``statements`` is array<struct<rank, key, evidence>>, rank being minus the severity.
    """
    of = lambda severity, hiding: F.transform(F.filter(statements, lambda s: (s["rank"] == -severity) & (s["key"].isin(t.HIDING) == hiding)), lambda s: s["key"])
    loud, hidden = of(t.ALARMING, False), F.transform(F.filter(statements, lambda s: s["key"].isin(t.HIDING)), lambda s: s["key"])
    notable, benign = of(t.NOTABLE, False), of(t.BENIGN, False)
    two = lambda a: F.array_join(F.slice(a, 1, 2), ", ")
    make = lambda text, spot: F.struct(text.alias("text"), F.lit(spot).alias("spotlight"))
    return (
        F.when(empty, make(F.lit("empty"), False))
        .when(F.size(loud) > 0, make(F.concat(two(loud), F.when(obfuscated, F.lit(" and hidden")).otherwise(F.lit(""))), True))
        .when(F.size(hidden) > 0, make(F.get(hidden, F.lit(0)), True))
        .when(F.size(notable) > 0, make(two(notable), False))
        .when(F.size(benign) > 0, make(F.get(benign, F.lit(0)), False))
        .otherwise(make(F.lit("nothing notable"), False))
    )


def recommendations(unexplained: Column, explained: Column, escalating: Column, unreadable: Column, autorun: Column, timed_out: Column) -> Column:
    """Next steps in order, from counts and flags of one file."""
    needs_human = (unexplained > 0) | escalating
    lines = F.array(
        F.when(timed_out, F.lit("timed_out")),
        F.when(needs_human, F.lit("needs_human")).when(explained > 0, F.lit("known_release")).when((unreadable == 0) & ~timed_out, F.lit("looks_ordinary")),
        F.when(unreadable > 0, F.lit("unreadable")),
        F.when(autorun > 0, F.lit("autorun_present")),
    )
    return F.filter(lines, lambda x: x.isNotNull())


def exit_code(files: DataFrame, errors: DataFrame) -> DataFrame:
    """One row: the largest error code from 2 up, else 1 if a file needs attention, else 0."""
    codes = files.select(F.when(F.col("has_findings") | F.col("timed_out"), 1).otherwise(0).alias("c")).union(errors.where("code >= 2").select("code"))
    return codes.agg(F.coalesce(F.max("c"), F.lit(0)).alias("exit_code"))
