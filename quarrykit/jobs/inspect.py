"""The whole inspection: container rows to findings with their evidence, and to one report a file.

Bodies are analysed once each however often they occur, and travel by their digest; everything
after the syntax pass is joins and grouped aggregation. ``inspect_files.py`` runs it as a program.
"""

from __future__ import annotations

import argparse
import sys
from dataclasses import dataclass, field, replace
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrykit.functions import paths, text as shown
from quarrykit.functions import tables as t
from quarrykit.functions.text import sha256_hex
from quarrykit.operators import identity, rollup, statements, syntax
from quarrykit.operators.fact_store import FactStore
from quarrykit.session import bucketed, co_partitioned, stored
from quarrykit.sources import container
from quarrykit.sources.document import write_document


class Explained(NamedTuple):
    """What the syntax pass and the rules say of distinct bodies, by digest."""

    parsed: DataFrame  # (body, parsed)
    told: DataFrame  # (body, key, severity, evidence)
    shapes: DataFrame  # (body, structure_sha256, literals)
    named: DataFrame  # (body, named): literals with their kinds
    spent: DataFrame  # (body, ms, late)


def explain(bodies: DataFrame, *, ambient: bool = False, seconds: float = syntax.SECONDS, store: FactStore | None = None) -> Explained:
    """Of the distinct texts in ``source``; a body that takes longer than ``seconds`` has nothing but its time. With a ``store`` only bodies that it does not have are parsed."""
    distinct = stored(bodies.select(sha256_hex(F.col("source")).alias("body"), "source").where(F.trim("source") != "").dropDuplicates(["body"]), "bodies")
    facts = bucketed(syntax.facts(distinct, seconds=seconds, distinct=True) if store is None else store.facts(distinct, seconds=seconds), "facts", "body")
    parsed = facts.where("kind in ('parsed', 'unparsed')").select("body", (F.col("kind") == "parsed").alias("parsed"))
    failed = distinct.join(parsed.where("not parsed").select("body"), "body", "left_semi")
    with co_partitioned(bodies.sparkSession):
        told = stored(statements.statements(facts, ambient=ambient).unionByName(statements.fallback_statements(failed, ["body"])), "statements")
    taken = facts.where("kind = 'literal'").groupBy("body").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "value"))), lambda x: x["value"]).alias("literals"))
    shapes = facts.where("kind = 'structure'").select("body", F.col("value").alias("structure_sha256")).join(taken, "body", "left")
    return Explained(parsed, told, shapes, statements.named_literals(facts, failed), syntax.spent(facts))


NO_KNOWN = "sha256 string, script_name string, origin string, structure_sha256 string, literals array<string>, generated boolean, place int"


@dataclass
class Inspection:
    """Everything about the files of one run, as tables by (path, place)."""

    rows: DataFrame  # as the reader gave them
    files: DataFrame
    texts: DataFrame  # with parsed, evidence, entry, differing_literals, cleared, label and named
    told: DataFrame  # statements of texts
    drivers: DataFrame
    driver_told: DataFrame
    libraries: DataFrame
    nodes: DataFrame
    warnings: list[str] = field(default_factory=list)  # what could not be used of the table of known scripts


def ledger(files: DataFrame, parts: DataFrame, budget_ms: int) -> tuple[DataFrame, DataFrame]:
    """(files, parts) under one budget a file: what its reader took, then its parts one after another.

    ``files`` has path, spent, timed_out and timed_out_at; ``parts`` has path, stage, place, ms and
    late. A part is kept while the milliseconds of the file so far, its own included, are within the
    budget and none was late; the first that is not marks the file, and the earliest stage counts.
    """
    stage = F.array_position(F.array(*map(F.lit, container.CATEGORIES)), F.col("stage"))
    so_far = Window.partitionBy("path").orderBy("rank", "place")  # parts of one place count together
    rows = parts.withColumn("rank", stage).join(files.select("path", "spent"), "path")
    used = F.coalesce("spent", F.lit(0)) + F.sum(F.coalesce("ms", F.lit(0))).over(so_far)
    kept = (used <= budget_ms) & ~F.max(F.coalesce("late", F.lit(False))).over(so_far)
    judged = rows.withColumn("kept", kept)
    cut = judged.where("not kept").groupBy("path").agg(F.min_by("stage", "rank").alias("cut_at"))
    place = lambda c: F.array_position(F.array(*map(F.lit, container.CATEGORIES)), c)
    first = F.when(F.col("timed_out_at").isNull() | (place(F.col("cut_at")) < place(F.col("timed_out_at"))), F.col("cut_at")).otherwise(F.col("timed_out_at"))
    marked = files.join(cut, "path", "left")
    columns = [F.col("timed_out") | F.col("cut_at").isNotNull() if c == "timed_out" else F.when(F.col("cut_at").isNotNull(), first).otherwise(F.col("timed_out_at")) if c == "timed_out_at" else F.col(c) for c in files.columns]
    return marked.select(*(c.alias(n) for c, n in zip(columns, files.columns, strict=True))), judged.select(*parts.columns, "kept")


def inspection(spark: SparkSession, rows: DataFrame, *, known: DataFrame | None = None, base: Column | None = None, seconds: float = container.Limits().seconds, store: FactStore | None = None, warnings: list[str] | None = None) -> Inspection:
    """All tables of one run. ``seconds`` is the budget of a file for reading and explaining it together.

    Texts and drivers beyond the budget are left out and their file is marked: a text without its
    explanation would read as one with nothing to explain. What the reader found of other
    kinds stays.
    """
    rows = stored(rows, "findings")
    source = container.texts(rows).withColumn("body", sha256_hex(F.col("source")))
    of_text = explain(source, seconds=seconds, store=store)
    drivers = syntax.classify_expressions(container.drivers(rows), "body")
    drivers = drivers.withColumn("is_simple", F.when(F.col("expression_is_evaluated"), F.col("is_simple"))).withColumn("reason", F.when(F.col("expression_is_evaluated"), F.col("reason")))
    drivers = stored(drivers.withColumnRenamed("body", "source").withColumn("body", sha256_hex(F.col("source"))), "drivers")
    heavy = drivers.where("expression_is_evaluated and not is_simple")
    of_driver = explain(heavy, ambient=True, seconds=seconds, store=store)
    part = lambda found, stage, took: found.select("path", F.lit(stage).alias("stage"), "place", "body").join(took, "body", "left").select("path", "stage", "place", "ms", "late")
    heavy_spent = heavy.select("path", "place").join(part(heavy, "driver", of_driver.spent).drop("stage"), ["path", "place"])
    light = drivers.select("path", F.lit("driver").alias("stage"), "place").join(heavy_spent, ["path", "place"], "left").select("path", "stage", "place", "ms", "late")
    files, parts = ledger(container.files(rows), part(source, "text", of_text.spent).unionByName(light), int(1000 * seconds))
    files = stored(files.drop("spent"), "files")
    cut = stored(parts.where("not kept").select("path", "place"), "cut")
    texts = source.drop("source").join(cut, ["path", "place"], "left_anti").join(of_text.parsed, "body", "left").join(of_text.shapes, "body", "left").join(of_text.named, "body", "left")
    if known is None:
        known = spark.createDataFrame([], NO_KNOWN)
    texts = identity.match(texts.withColumn("sha256", F.col("body")), known)
    texts = stored(texts.withColumn("cleared", F.col("suppresses_escalation")).withColumn("label", F.concat_ws(" -- ", "entry.script_name", "entry.origin")), "texts")
    drivers = stored(drivers.join(cut, ["path", "place"], "left_anti").join(of_driver.named, "body", "left"), "drivers")
    libraries = container.libraries(rows).select("path", "place", paths.classify(F.col("raw_path"), F.lit("/") if base is None else base).alias("c")).select("path", "place", "c.*")
    driven = drivers.where("expression_is_evaluated and not is_simple").select("path", "place", "body").join(of_driver.told, "body")
    return Inspection(rows, files, texts, stored(texts.select("path", "place", "body").join(of_text.told, "body"), "told"), drivers, stored(driven, "driver-told"), libraries, container.nodes(rows), warnings or [])


def _blind() -> Column:
    return F.col("parsed").eqNullSafe(F.lit(False)) & (F.col("is_autorun") | F.col("name").endswith(".py"))


def tiers(of: Inspection) -> DataFrame:
    """Tier and ordered reasons of each file."""
    none = F.lit(None).cast("string")
    reasons = (
        rollup.text_reasons(of.texts, of.told.select("path", "place", "key", "severity"), ["path", "place"])
        .unionByName(rollup.library_reasons(of.libraries).withColumn("script", none))
        .unionByName(rollup.driver_reasons(of.drivers).withColumn("script", none))
        .unionByName(rollup.statement_reasons(of.driver_told, ["path"]).withColumn("script", none))
        .unionByName(rollup.node_reasons(of.nodes).withColumn("script", none))
    )
    return rollup.tiers(of.files, reasons)


def summaries(of: Inspection) -> DataFrame:
    """One row a readable file: header facts, counts, tier, reasons and next steps."""
    loud = of.told.where(F.col("severity") == t.ALARMING).select("path", "place").distinct().join(of.texts.select("path", "place", "cleared"), ["path", "place"])
    counts = [
        loud.groupBy("path").agg(F.count_if(~F.col("cleared")).alias("unexplained"), F.count_if("cleared").alias("explained")),
        of.texts.groupBy("path").agg(F.count("*").alias("texts"), F.count_if(_blind()).alias("unreadable"), F.count_if("is_autorun").alias("autorun")),
        of.libraries.groupBy("path").agg(F.count("*").alias("libraries"), F.bool_or(F.col("is_unc") | F.col("has_drive_letter")).alias("reaching")),
        of.drivers.groupBy("path").agg(F.count("*").alias("drivers")),
        of.driver_told.where(F.col("severity") == t.ALARMING).groupBy("path").agg(F.count("*").alias("loud_drivers")),
        of.nodes.groupBy("path").agg(F.count("*").alias("osl_nodes")),
    ]
    out = of.files.drop("timed_out").join(tiers(of), "path")
    for c in counts:
        out = out.join(c, "path", "left")
    out = out.na.fill(0).na.fill(False)
    steps = rollup.recommendations(F.col("unexplained"), F.col("explained"), F.col("reaching") | (F.col("loud_drivers") > 0), F.col("unreadable"), F.col("autorun"), F.col("timed_out"))
    found = (F.col("texts") + F.col("drivers") + F.col("osl_nodes") + F.col("libraries")) > 0
    said = F.array(*map(F.lit, of.warnings)).cast("array<string>")
    return out.withColumn("warnings", said).withColumn("has_findings", found).withColumn("needs_attention", found | F.col("timed_out")).withColumn("steps", steps)


def reports(spark: SparkSession, rows: DataFrame, *, known: DataFrame | None = None, base: Column | None = None, seconds: float = container.Limits().seconds) -> DataFrame:
    """One row a readable file; see ``summaries``."""
    return summaries(inspection(spark, rows, known=known, base=base, seconds=seconds))


def findings(of: Inspection) -> DataFrame:
    """One row a finding: (path, place, category, name, severity, statements, literals, details).

    ``statements`` are the rules that fired with their evidence, the loudest first; ``literals`` are
    the strings of a script that a reader can judge, with their kinds (url, host, command, path,
    blob); ``details`` is JSON with what else is known of this kind of finding, such as a text's identity and the
    literals in which it differs from the known script.
    """
    names = F.array(*(F.lit(s) for s in t.SEVERITIES))

    def told(rows: DataFrame, said: DataFrame, category: str, name: Column, details: Column) -> DataFrame:
        one = F.struct((-F.col("severity")).alias("rank"), "key", "evidence")
        grouped = said.groupBy("path", "place").agg(F.max("severity").alias("loudest"), F.array_sort(F.collect_list(one)).alias("s"))
        listed = F.transform("s", lambda x: F.struct(x["key"].alias("key"), F.get(names, -x["rank"]).alias("severity"), x["evidence"].alias("evidence")))
        strings = F.coalesce("named", no_literals) if "named" in rows.columns else no_literals
        held = rows.select("path", "place", name.alias("name"), strings.alias("literals"), details.alias("details")).join(grouped, ["path", "place"], "left")
        return held.select("path", "place", F.lit(category).alias("category"), "name", F.get(names, F.col("loudest")).alias("severity"), F.coalesce(listed, F.expr("cast(array() as array<struct<key:string,severity:string,evidence:array<string>>>)")).alias("statements"), "literals", "details")

    no_literals = F.expr("cast(array() as array<struct<kind:string,value:string>>)")
    whole = lambda *columns: F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    nothing = of.told.limit(0)
    identity_of = F.when(F.col("evidence").isNotNull(), F.struct("evidence", F.col("entry.script_name").alias("script_name"), F.col("entry.origin").alias("origin"), F.col("entry.generated").alias("generated"), "differing_literals"))
    text = told(of.texts, of.told, "text", F.col("name"), whole("filepath", "flags", "flag_names", "is_autorun", "is_memory", "is_external", "source_bytes", "truncated", "parsed", identity_of.alias("identity")))
    driver = told(of.drivers, of.driver_told, "driver", F.col("owner"), whole("expression", "driver_type", "driver_type_name", "flags", "flag_names", "is_simple", "reason", "expression_is_evaluated"))
    node = told(of.nodes, nothing, "osl", F.col("mode_name"), whole("filepath", "bytecode_bytes", "bytecode_hash"))
    library = told(of.libraries, nothing, "library", F.col("raw_path"), whole(*[c for c in of.libraries.columns if c not in ("path", "place", "raw_path")]))
    path = told(container.filepaths(of.rows), nothing, "filepath", F.col("name"), whole("kind", "file"))
    return text.union(driver).union(node).union(library).union(path)


def _ascii(text: Column) -> Column:
    """JSON with everything beyond ASCII escaped."""
    escape = lambda c: F.when(c.rlike(r"[^\x{0}-\x{7f}]"), F.regexp_replace(F.hex(F.encode(c, "UTF-16BE")), "(.{4})", "\\\\u$1")).otherwise(c)
    return F.when(text.rlike(r"[^\x{0}-\x{7f}]"), F.array_join(F.transform(F.split(text, ""), escape), "")).otherwise(text)


def _per_file(found: DataFrame) -> DataFrame:
    """All findings of each file in their order; a file's findings are one value, as the file was."""
    kept = F.struct("place", "category", "name", "severity", "statements", "literals", "details")
    return found.groupBy("path").agg(F.array_sort(F.collect_list(kept)).alias("found"))


def report_json(files: DataFrame, found: DataFrame | None = None, errors: DataFrame | None = None) -> DataFrame:
    """(path, json): each report as one line of ASCII JSON, with its findings, and one line for each file in error."""
    banner = F.struct("tier", "reasons", "recognised", "timed_out")
    about = ["path", F.col("version").alias("blender_version"), "pointer_size", "compression", "block_count", "categories_checked", "texts", "drivers", "osl_nodes", "libraries", "has_findings", "timed_out", "timed_out_at", banner.alias("banner"), "steps", "warnings"]
    if found is not None:
        files = files.join(_per_file(found), "path", "left")
        none = F.expr("cast(array() as array<struct<place:int,category:string,name:string,severity:string,statements:array<struct<key:string,severity:string,evidence:array<string>>>,literals:array<struct<kind:string,value:string>>,details:string>>)")
        about.append(F.coalesce("found", none).alias("findings"))
    out = files.select("path", _ascii(F.to_json(F.struct(*about), {"ignoreNullFields": "false"})).alias("json"))
    return out if errors is None else out.union(error_json(errors, "error"))


def error_json(errors: DataFrame, within: str | None = None) -> DataFrame:
    """(path, json) of files in error, by themselves or as one field."""
    said = F.struct("path", "kind", "message")
    return errors.select("path", _ascii(F.to_json(said if within is None else F.struct(said.alias(within)))).alias("json"))


def report_text(files: DataFrame, found: DataFrame, seconds: float = container.Limits().seconds) -> DataFrame:
    """(path, report): what a person reads, line by line; nothing from a file reaches a line unescaped."""
    line = lambda c: shown.printable_line(c)
    say = lambda form, *columns: F.format_string(form, *columns)
    late = F.when(F.col("timed_out"), say(f"PARTIAL: {seconds:g} s ran out while reading %s; what follows is incomplete", "timed_out_at"))
    head = [
        say("%s  [%s]", line(F.col("path")), "tier"),
        say("version %s, %s-byte pointers, compression %s, %s blocks", "version_display", F.col("pointer_size").cast("string"), "compression", F.col("block_count").cast("string")),
        late,
        F.when(F.size("reasons") > 0, F.concat(F.lit("because of "), shown.listed(F.col("reasons")))),
        F.when(F.size("recognised") > 0, F.concat(F.lit("recognised: "), line(shown.listed(F.col("recognised"))))),
    ]

    def one(f: Column) -> Column:
        title = F.concat(F.lit("  "), f["category"], F.lit(": "), shown.show_literal(f["name"]), F.coalesce(F.concat(F.lit(" ("), f["severity"], F.lit(")")), F.lit("")))
        rules = F.transform(f["statements"], lambda s: F.concat(F.lit("    "), s["key"], F.lit(": "), F.array_join(F.transform(s["evidence"], shown.show_literal), "; ")))
        known = F.from_json(F.get_json_object(f["details"], "$.identity"), "evidence string, script_name string, origin string, generated boolean, differing_literals array<struct<index:int,reference:string,actual:string>>")
        match = F.when(known["evidence"].isNotNull(), F.concat(F.lit("    known script "), line(known["script_name"]), F.lit(" of "), line(known["origin"]), F.lit(" by "), known["evidence"], F.when(known["generated"], F.lit(", generated")).otherwise(F.lit(""))))
        differ = F.transform(F.coalesce(known["differing_literals"], F.expr("cast(array() as array<struct<index:int,reference:string,actual:string>>)")), lambda d: F.concat(F.lit("    literal "), d["index"].cast("string"), F.lit(": "), shown.quote_literal(d["reference"]), F.lit(" became "), shown.quote_literal(d["actual"])))
        strings = F.transform(f["literals"], lambda x: F.concat(F.lit("    ["), x["kind"], F.lit("] "), shown.show_literal(x["value"])))
        return F.concat(F.array(title), rules, strings, F.filter(F.array(match), lambda m: m.isNotNull()), differ)

    per = files.join(_per_file(found), "path", "left")
    body = F.flatten(F.transform(F.coalesce("found", F.expr("cast(array() as array<struct<place:int,category:string,name:string,severity:string,statements:array<struct<key:string,severity:string,evidence:array<string>>>,literals:array<struct<kind:string,value:string>>,details:string>>)")), one))
    warned = F.transform("warnings", lambda w: F.concat(F.lit("warning: "), line(w)))
    lines = F.concat(F.filter(F.array(*head), lambda x: x.isNotNull()), warned, body, F.array(F.concat(F.lit("next: "), F.array_join("steps", ", ")), F.lit("An inventory, not a verdict.")))
    return per.select("path", F.array_join(lines, "\n").alias("report"))


def run(spark: SparkSession, argv: list[str]) -> int:
    """Inspect targets and write or print their reports; the exit code is the batch's."""
    parser = argparse.ArgumentParser(prog="inspect")
    parser.add_argument("targets", nargs="+")
    parser.add_argument("--json", action="store_true")
    parser.add_argument("--known")
    parser.add_argument("--facts", help="folder that keeps the facts of bodies from run to run")
    parser.add_argument("--seconds", type=float, default=container.Limits().seconds)
    parser.add_argument("--out", help="folder for the reports; without it they are printed as they come")
    parser.add_argument("--document", help="file for one JSON document of all reports and errors, in place of the others")
    args = parser.parse_args(argv)
    folders, files = container.expanded(spark, args.targets)
    if not folders and not files:
        print("no files matched", file=sys.stderr)
        return 3
    known, problems = identity.load_known(spark, args.known) if args.known else (None, None)
    warnings = identity.warnings_of(problems) if args.known else []
    store = FactStore(spark, args.facts) if args.facts else None
    of = inspection(spark, container.read(spark, args.targets, replace(container.Limits(), seconds=args.seconds)), known=known, seconds=args.seconds, store=store, warnings=warnings)
    told, found, errors = stored(summaries(of), "summaries"), findings(of), container.errors(of.rows)
    if args.document:
        write_document(report_json(told, found), error_json(errors), args.document, overwrite=True)
    lines = report_json(told, found, errors).select("json") if args.json else report_text(told, found, args.seconds).select("report")
    if args.out:
        lines.write.text(args.out)
    elif not args.document:
        for row in lines.toLocalIterator():
            print(row[0])
    codes = errors.select(F.lit(2).alias("code"))
    return rollup.exit_code(told.select("has_findings", "timed_out"), codes).first()["exit_code"]
