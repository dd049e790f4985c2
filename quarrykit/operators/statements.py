"""Facts joined to rules: statements with severity and evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrykit.functions import literals
from quarrykit.functions import tables as t
from quarrykit.session import bucketed

EVIDENCE = 8
_MARKED = {"x_living_off_land": t.TOOLS, "x_persistence": t.PERSISTENCE, "x_credentials": t.CREDENTIALS}


def evidence(column: Column) -> Column:
    """Distinct values in order, the first eight."""
    return F.slice(F.sort_array(F.collect_set(column)), 1, EVIDENCE)


def rules(spark: SparkSession) -> DataFrame:
    """(name, place, key, severity): a fixed table of about a hundred rows."""
    rows = [(name, place, key, severity) for key, severity, places, names in t.RULES for place in places.split() for name in names.split()]
    return spark.createDataFrame(rows, "name string, place string, key string, severity int")


def prefixes(name: Column) -> Column:
    """``a``, ``a.b`` and ``a.b.c`` of ``a.b.c``."""
    parts = F.split(name, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "."))


def prefix_join(rows: DataFrame, name: str, table: DataFrame, key: str = "name") -> DataFrame:
    """Rows with the entries of a small table that equal their dotted name or a dotted prefix of it."""
    return rows.withColumn("_prefix", F.explode(prefixes(F.col(name)))).join(F.broadcast(table.withColumnRenamed(key, "_entry")), F.col("_prefix") == F.col("_entry")).drop("_prefix", "_entry")


HANDLERS = "bpy.app.handlers."
_OPENS = ["open", "io.open", "codecs.open"]
_LOOKUPS = ["getattr", "setattr", "vars", "hasattr"]


def _root(name: Column) -> Column:
    return F.substring_index(name, ".", 1)


def _moved(name: Column, target: Column) -> Column:
    """``name`` with its root replaced."""
    return F.concat(target, F.substr(name, F.length(_root(name)) + 1))


def _unaliased(name: Column, aliases: Column) -> Column:
    """What a name stands for once plain rebindings are followed, a few hops at most."""
    step = lambda a, _: F.coalesce(_moved(a, F.try_element_at(aliases, _root(a))), a)
    return F.aggregate(F.sequence(F.lit(1), F.lit(t.ALIAS_HOPS)), name, step)


def _among(name: Column, entries: list[str]) -> Column:
    """Whether a dotted name equals one of the entries or lies under it."""
    return F.coalesce(F.exists(prefixes(name), lambda p: p.isin(entries)), F.lit(False))


def scopes(facts: DataFrame) -> DataFrame:
    """(body, bindings, aliases): imported names and rebindings of each body, the last of each counting."""
    last = facts.where("kind in ('binding', 'alias')").groupBy("body", "kind", "value").agg(F.max_by("extra", "place").alias("extra"))
    of = lambda kind: F.map_from_entries(F.collect_list(F.when(F.col("kind") == kind, F.struct("value", "extra"))))
    return last.groupBy("body").agg(of("binding").alias("bindings"), of("alias").alias("aliases"))


def calls(facts: DataFrame, ambient: bool = False) -> DataFrame:
    """Calls with ``plain``, what their name stands for, and ``resolved``: module-qualified, null if its root was never bound to a module.

    With ``ambient``, as in expressions that cannot import, every name counts as bound.
    """
    rows = facts.where("kind = 'call'").select("body", "place", "call", F.col("value").alias("written"), F.col("extra").alias("stem"), F.col("slot").cast("int").alias("stem_call"), "inside", "given_to")
    rows = rows.join(scopes(facts), "body", "left")
    plain = _unaliased(F.col("written"), F.col("aliases"))
    rows = rows.withColumn("plain", plain).withColumn("name", F.when(F.map_contains_key(F.coalesce("bindings", F.expr("cast(map() as map<string,string>)")), _root(F.col("written"))), F.col("written")).otherwise(F.col("plain")))
    bound = _moved(F.col("name"), F.try_element_at("bindings", _root(F.col("name"))))
    free = F.lit(True) if ambient else _root(F.col("name")).isin(t.BUILTIN_ROOTS)
    resolved = F.when(F.col("written") != "", F.coalesce(bound, F.when(free, F.col("name"))))
    shown = F.when(F.col("written") == resolved, F.col("written")).otherwise(F.concat("written", F.lit(" ("), resolved, F.lit(")")))
    return rows.select("body", "place", "call", "written", "stem", "stem_call", "inside", "given_to", "aliases", "plain", resolved.alias("resolved"), shown.alias("shown"))


def _is_builtins(kind: Column, value: Column, aliases: Column) -> Column:
    """Whether what is written names the builtins module: a plain name by what it stands for, a member by its own name."""
    last = F.substring_index(value, ".", -1)
    return F.when((kind == "name") & ~value.contains("."), _unaliased(value, aliases).isin(t.BUILTINS_NAMES)).when(kind.isin("name", "member"), last.isin(t.BUILTINS_NAMES)).otherwise(False)


def call_evidence(facts: DataFrame, made: DataFrame) -> DataFrame:
    """(body, key, severity, e) of what calls do with their arguments and with each other; all joins are on the body and a call's number."""
    args = facts.where("kind = 'arg'").select("body", "call", "slot", F.col("extra").alias("how"), "value", F.col("place").alias("at"))
    with_arg = made.select("body", "call", "written", "plain", "aliases").join(args, ["body", "call"])
    told = lambda rows, key, severity, e: rows.select("body", F.lit(key).alias("key"), F.lit(severity).alias("severity"), e.alias("e"))

    modes = with_arg.where(F.col("written").isin(_OPENS) & F.col("slot").isin("1", "mode") & (F.col("how") == "text")).groupBy("body", "call").agg(F.max_by("value", F.struct(F.col("slot") == "mode", "at")).alias("mode"))
    first = with_arg.where("slot = '0'").withColumn("to_builtins", _is_builtins(F.col("how"), F.col("value"), F.col("aliases")))
    imported = first.where(F.col("written").isin(t.RUNTIME_IMPORTS))
    looked_up = first.where(F.col("plain").isin(_LOOKUPS) & F.col("to_builtins"))
    assembled = with_arg.where(F.col("plain").isin(t.NAME_TAKING_CALLS) & F.col("slot").rlike("^[0-9]+$") & (F.col("how") == "joined"))

    # A call whose own function is the result of another call, written in place or bound to a name before.
    handed = first.where(F.col("plain").isin(t.RUNTIME_IMPORTS) | (F.col("plain").isin(t.INDIRECTION_CALLS) & F.col("to_builtins"))).select("body", "call")
    handed = handed.union(made.where(F.col("plain").isin(t.RUNTIME_IMPORTS)).select("body", "call")).distinct()
    results = facts.where("kind = 'result'").select("body", F.col("value").alias("target"), "call", F.col("place").alias("since"))
    tainted = results.join(handed, ["body", "call"]).select("body", F.col("target").alias("stem")).distinct()
    by_name = made.join(tainted, ["body", "stem"]).select("body", F.col("stem").alias("inner"))
    by_call = made.where("stem_call is not null").select("body", F.col("stem_call").alias("call")).join(made.where(F.col("plain").isin(t.INDIRECTION_CALLS)).select("body", "call", F.col("plain").alias("inner")), ["body", "call"])
    indirect = by_name.union(by_call.select("body", "inner"))

    # A decode inside an argument of a call that runs code, or bound to a name that stands there.
    decodes = made.where(_among(F.col("resolved"), t.DECODE_CALLS))
    runs = made.where(_among(F.col("resolved"), t.EXECUTING_CALLS)).select("body", "call", "written")
    inside = decodes.select("body", F.explode("given_to").alias("call"), F.col("place").alias("at"), F.concat("resolved", F.lit("()")).alias("source"))
    within = decodes.select("body", "resolved", F.col("place").alias("at"), F.explode(F.concat("inside", F.array("call"))).alias("call"))
    bound = results.join(within, ["body", "call"]).groupBy("body", "target").agg(F.min_by("resolved", F.struct(-F.col("since"), "at")).alias("resolved"))
    uses = facts.where("kind = 'use'").select("body", F.col("value").alias("target"), F.explode("given_to").alias("call"), F.col("place").alias("at"))
    uses = uses.join(bound, ["body", "target"]).select("body", "call", "at", F.concat(F.lit("name "), "target", F.lit(" from "), "resolved", F.lit("()")).alias("source"))
    linked = inside.unionByName(uses).join(runs, ["body", "call"]).groupBy("body", "call", "written").agg(F.min_by("source", "at").alias("source"))
    linked = linked.select("body", F.concat("written", F.lit("() runs "), "source").alias("e"))
    bodies = linked.select("body").distinct()
    plain_decodes = decodes.select("body", F.col("shown").alias("e"))

    return (
        told(modes.where(F.col("mode").rlike("[wax+]")), "x_file_write", t.NOTABLE, F.concat(F.lit("open for "), "mode"))
        .union(told(imported.where("how = 'text'"), "x_runtime_import", t.NOTABLE, F.concat("written", F.lit(" of "), "value")))
        .union(told(imported.where("how <> 'text'"), "x_dynamic_code", t.ALARMING, F.concat("written", F.lit(" of a computed name"))))
        .union(told(looked_up, "x_builtins_indirection", t.ALARMING, F.concat("written", F.lit(" on "), "value")))
        .union(told(assembled, "x_assembled_name", t.ALARMING, F.concat("written", F.lit(" of "), F.substring("value", 1, 40))))
        .union(told(indirect, "x_indirect_call", t.ALARMING, F.concat(F.lit("call of what "), "inner", F.lit(" gives"))))
        .union(told(linked.union(plain_decodes.join(bodies, "body", "left_semi")), "x_obfuscation", t.ALARMING, F.col("e")))
        .union(told(plain_decodes.join(bodies, "body", "left_anti"), "x_decodes_data", t.NOTABLE, F.col("e")))
    )


def handler_evidence(facts: DataFrame, made: DataFrame) -> DataFrame:
    """Handlers of a body by the strongest of three readings: a persistent function put into one, a persistent function beside one, any handler at all."""
    touched = facts.where("kind = 'attribute'").where(F.col("value").startswith(HANDLERS)).select("body", F.col("value").alias("e")).distinct()
    persistent = facts.where("kind = 'persistent'").select("body", F.col("value").alias("fn")).distinct()
    last = facts.where("kind = 'arg' and slot = 'last' and extra = 'name'").select("body", "call", F.col("value").alias("fn"))
    put = made.where(F.col("written").startswith(HANDLERS) & F.col("written").rlike(r"\.(append|insert)$")).join(last, ["body", "call"]).join(persistent, ["body", "fn"])
    ranked = (
        put.select("body", F.lit(0).alias("rank"), F.concat("fn", F.lit(" kept by "), F.regexp_extract("written", r"^(.*)\.", 1)).alias("e"))
        .union(persistent.join(touched.select("body").distinct(), "body", "left_semi").select("body", F.lit(1), F.concat("fn", F.lit(" is persistent"))))
        .union(touched.select("body", F.lit(2), "e"))
    )
    best = ranked.groupBy("body").agg(F.min("rank").alias("rank"))
    key = F.when(F.col("rank") < 2, "x_handler_persist").otherwise("x_handler_register")
    return ranked.join(best, ["body", "rank"]).select("body", key.alias("key"), F.lit(t.NOTABLE).alias("severity"), "e")


def text_evidence(facts: DataFrame) -> DataFrame:
    """What strings hold: marks of three lists, which the syntax pass met, and opaque blobs."""
    s = literals.stripped(F.col("value"))
    keys = F.create_map(*(x for m in dict.fromkeys(m for listed in _MARKED.values() for m in listed) for x in (F.lit(m), F.array(*(F.lit(k) for k, listed in _MARKED.items() if m in listed)))))
    told = lambda rows, key, e: rows.select("body", key.alias("key"), F.lit(t.ALARMING).alias("severity"), e.alias("e"))
    marks = facts.where("kind = 'mark'").select("body", "value", F.explode(F.try_element_at(keys, F.col("value"))).alias("rule"))
    blobs = facts.where("kind = 'string'").where((F.length("value") <= t.LITERAL_CHARS) & literals.is_blob(s))
    return told(marks, F.col("rule"), F.col("value")).union(told(blobs, F.lit("x_opaque_blob"), blob_evidence(s)))


def blob_evidence(blob: Column) -> Column:
    return F.concat(F.substring(blob, 1, 24), F.lit("... ("), F.length(blob).cast("string"), F.lit(" chars)"))


def statements(facts: DataFrame, *, ambient: bool = False) -> DataFrame:
    """(body, key, severity, evidence) for parsed bodies, one row a rule that fired.

    Facts that come bucketed by body, and calls, which are written so, meet without a shuffle; only
    what fired is dealt once more, to be put together.
    """
    made = bucketed(calls(facts, ambient), "calls", "body")
    # Names met in imports, bases and calls go through the rule table in one join.
    named = facts.where("kind in ('import', 'base')").select("body", F.col("kind").alias("met"), F.col("value").alias("name"), F.col("value").alias("e"))
    named = named.union(made.where("resolved is not null").select("body", F.lit("call"), "resolved", "shown"))
    by_rule = prefix_join(named, "name", rules(facts.sparkSession)).where("met = place").select("body", "key", "severity", "e")
    scopes_of = facts.where("kind = 'member'").select("body", "slot", "value", "extra").join(scopes(facts), "body", "left")
    members = scopes_of.where(_is_builtins(F.col("slot"), F.col("value"), F.col("aliases")))
    shown = F.concat(F.substring_index("value", ".", -1), "extra")
    done = bucketed(call_evidence(facts, made), "call-evidence", "body")
    whole = done.where("key = 'x_assembled_name'").groupBy("body").agg(F.collect_set("e").alias("a"))
    split = facts.where("kind = 'split'").select("body", F.col("value").alias("e")).join(whole, "body", "left").where(~F.coalesce(F.exists("a", lambda a: a.contains(F.substring(F.col("e"), 1, 40))), F.lit(False)))
    every = (
        by_rule.union(text_evidence(facts))
        .union(done)
        .union(members.select("body", F.lit("x_builtins_indirection"), F.lit(t.ALARMING), shown))
        .union(split.select("body", F.lit("x_split_literal"), F.lit(t.NOTABLE), "e"))
        .union(handler_evidence(facts, made))
        .union(facts.where("kind = 'attribute'").where(F.col("value").startswith("bpy.app.driver_namespace")).select("body", F.lit("x_driver_namespace"), F.lit(t.BENIGN), "value"))
    )
    return every.groupBy("body", "key", "severity").agg(evidence(F.col("e")).alias("evidence"))


def fallback_statements(bodies: DataFrame, keys: list[str], source_col: str = "source", least: int = t.BLOB_CHARS) -> DataFrame:
    """(keys, key, severity, evidence) of bodies that do not parse: only opaque blobs show there."""
    kept = F.filter(literals.tokens(F.col(source_col)), lambda x: (F.length(x) <= t.LITERAL_CHARS) & literals.is_blob(literals.stripped(x), least))
    blobs = bodies.select(*keys, F.explode(F.transform(kept, literals.stripped)).alias("s"))
    found = blobs.select(*keys, F.lit("x_opaque_blob").alias("key"), F.lit(t.ALARMING).alias("severity"), blob_evidence(F.col("s")).alias("e"))
    return found.groupBy(*keys, "key", "severity").agg(evidence(F.col("e")).alias("evidence"))


def explanations(statement_rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, max_severity, obfuscated, statements) with the loudest statement first."""
    return statement_rows.groupBy(*keys).agg(
        F.max("severity").alias("max_severity"),
        F.bool_or(F.col("key").isin(t.HIDING)).alias("obfuscated"),
        F.array_sort(F.collect_list(F.struct((-F.col("severity")).alias("rank"), "key", "evidence"))).alias("statements"),
    )


def named_literals(facts: DataFrame, failed: DataFrame, source_col: str = "source") -> DataFrame:
    """(body, named): literals that a reader can judge, by kind and then value, each once.

    Of parsed bodies all strings are looked at, of the bodies in ``failed`` (body, source) all tokens.
    """
    one = lambda found: F.explode(found).alias("l")
    parsed = facts.where("kind = 'string'").select("body", one(literals.literals(F.col("value"))))
    bare = failed.select("body", F.explode(literals.tokens(F.substring(source_col, 1, t.BODY_CHARS))).alias("token")).select("body", one(literals.literals(F.col("token"), bare=True)))
    sets = parsed.union(bare).groupBy("body").agg(F.array_sort(F.collect_set("l")).alias("l"))
    return sets.select("body", F.transform("l", lambda x: F.struct(x["kind"].alias("kind"), x["value"].alias("value"))).alias("named"))
