"""Lexical path classification as native columns; no file system is asked."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once; keeps nested expressions from multiplying."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda s: s != "")


def _is_drive(text: Column) -> Column:
    return text.rlike(r"^\p{L}:")


def _rest(parts: Column, n: int | Column = 2) -> Column:
    return F.slice(parts, n, F.greatest(F.size(parts), F.lit(1)))


def _device(parts: Column) -> Column:
    """Segments without a leading ``?`` or ``.``."""
    return F.when(F.get(parts, F.lit(0)).isin("?", "."), _rest(parts)).otherwise(parts)


def _unc(parts: Column) -> Column:
    return F.when(F.upper(F.get(parts, F.lit(0))) == "UNC", _rest(parts)).otherwise(parts)


def normalised(raw: Column) -> Column:
    """Without the marker ``//`` in front, and with forward slashes."""
    body = F.when(raw.startswith("//"), F.substr(raw, F.lit(3))).otherwise(raw)
    return F.replace(body, F.lit("\\"), F.lit("/"))


def root_kind(path: Column) -> Column:
    """struct<kind, host>: unc, drive, root or relative, from the spelling alone."""
    return let(path, lambda p: let(segments(p), lambda parts: let(_device(parts), lambda after: _root_kind(p, parts, after))))


def _root_kind(path: Column, parts: Column, after: Column) -> Column:
    make = lambda kind, host=None: F.struct(F.lit(kind).alias("kind"), (F.lit(None).cast("string") if host is None else host).alias("host"))
    first = F.get(parts, F.lit(0))
    device = F.coalesce(first.isin("?", "."), F.lit(False))
    device_drive = device & F.coalesce(_is_drive(F.get(after, F.lit(0))), F.lit(False))
    share = F.when(device, F.get(_unc(after), F.lit(0))).otherwise(first)
    letter = lambda text: F.substr(text, F.lit(1), F.lit(1))
    return (
        F.when(path.startswith("//") & device_drive, make("drive", letter(F.get(after, F.lit(0)))))
        .when(path.startswith("//"), make("unc", share))
        .when(_is_drive(path), make("drive", letter(path)))
        .when(path.startswith("/"), make("root"))
        .otherwise(make("relative"))
    )


def escapes_upward(path: Column) -> Column:
    """Whether some prefix climbs above where the path starts."""
    step = lambda s: F.when(s == "..", -1).when(s.isin("", "."), 0).otherwise(1)
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("low"))
    return F.aggregate(
        F.split(path, "/"), start, lambda a, s: F.struct((a["depth"] + step(s)).alias("depth"), F.least(a["low"], a["depth"] + step(s)).alias("low")), lambda a: a["low"] < 0
    )


def collapse(parts: Column) -> Column:
    """``.`` dropped and ``..`` taking its predecessor away, never above the root."""
    empty = F.expr("cast(array() as array<string>)")
    return F.aggregate(
        parts,
        empty,
        lambda a, s: F.when(s.isin("", "."), a).when(s == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(s))),
    )


def rooted(path: Column) -> Column:
    """struct<root, parts> of an absolute path, null where nothing fixed is named."""
    return let(path, lambda p: let(root_kind(p), lambda kind: let(segments(p), lambda parts: let(_device(parts), lambda after: _rooted(kind, parts, after)))))


def _rooted(kind: Column, parts: Column, after: Column) -> Column:
    share = F.when(F.get(parts, F.lit(0)).isin("?", "."), _unc(after)).otherwise(parts)
    first = F.get(after, F.lit(0))
    make = lambda root, rest: F.struct(root.alias("root"), rest.alias("parts"))
    return (
        F.when((kind["kind"] == "unc") & (F.size(share) > 0), make(F.concat(F.lit("//"), F.lower(kind["host"])), _rest(share)))
        .when((kind["kind"] == "drive") & (F.length(first) == 2), make(F.lower(first), _rest(after)))
        .when(kind["kind"] == "root", make(F.lit("/"), parts))
    )


def contained(base: Column, path: Column) -> Column:
    """Whether ``path`` lies below ``base`` by spelling; false means not established."""
    fold = lambda r: let(collapse(r["parts"]), lambda p: F.when(r["root"] == "/", p).otherwise(F.transform(p, F.lower)))
    below = lambda a, b: (F.size(a) > F.size(b)) & (F.slice(a, 1, F.greatest(F.size(b), F.lit(0))) == b)
    inside = let(
        rooted(path),
        lambda mine: let(rooted(F.replace(base, F.lit("\\"), F.lit("/"))), lambda yours: (mine["root"] == yours["root"]) & let(fold(mine), lambda a: let(fold(yours), lambda b: below(a, b)))),
    )
    return F.coalesce(inside, F.lit(False))


_ANCHOR = r"^([\\/]{2}[^\\/]+[\\/]+[^\\/]+|[A-Za-z]:)([\\/]?)(.*)$"  # of a Windows base: share or drive, whether it is rooted, the rest


def joined(base: Column, path: Column) -> Column:
    """``path`` laid on ``base`` by text; ``..`` stops at an anchor and stays in a relative base. A base with a drive or share is joined with backslashes."""
    windows = base.rlike(_ANCHOR)
    part = lambda k: F.regexp_extract(base, _ANCHOR, k)
    share = part(1).rlike(r"^[\\/]{2}")
    drive = F.concat(F.replace(part(1), F.lit("/"), F.lit("\\")), F.when(share | (part(2) != ""), F.lit("\\")).otherwise(F.lit("")))
    anchor = F.when(windows, drive).when(base.startswith("/"), F.lit("/")).otherwise(F.lit(""))
    rest = F.when(windows, F.replace(part(3), F.lit("\\"), F.lit("/"))).otherwise(base)
    kept = let(anchor != "", lambda fixed: _walked(F.concat(segments(rest), F.split(path, "/")), fixed))
    text = F.array_join(kept, "/")
    text = F.when(windows, F.array_join(kept, "\\")).otherwise(text)
    return F.when(anchor != "", F.concat(anchor, text)).when(text == "", ".").otherwise(text)


def _walked(parts: Column, fixed: Column) -> Column:
    """Segments with ``.`` dropped and ``..`` taking its predecessor; at the start it stays only where nothing is fixed."""
    empty = F.expr("cast(array() as array<string>)")
    last = lambda a: F.element_at(F.when(F.size(a) > 0, a).otherwise(F.array(F.lit(".."))), -1)
    return F.aggregate(
        parts,
        empty,
        lambda a, s: F.when(s.isin("", "."), a)
        .when((s == "..") & (F.size(a) > 0) & (last(a) != ".."), F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))))
        .when((s == "..") & fixed, a)
        .otherwise(F.concat(a, F.array(s))),
    )


def classify(raw: Column, base: Column) -> Column:
    """struct of everything said about one linked path; ``base`` is the folder of the file that links it."""
    return let(raw, lambda r: let(normalised(r), lambda path: let(root_kind(path), lambda kind: _classified(r, base, path, kind))))


def _classified(raw: Column, base: Column, path: Column, kind: Column) -> Column:
    marker, relative = raw.startswith("//"), kind["kind"] == "relative"
    unc, drive = kind["kind"] == "unc", kind["kind"] == "drive"
    escapes = relative & escapes_upward(path)
    return F.struct(
        raw.alias("raw_path"),
        F.when(relative, joined(base, path)).alias("resolved_path"),
        (marker & relative).alias("is_relative"),
        (~relative).alias("is_absolute"),
        escapes.alias("escapes_folder"),
        unc.alias("is_unc"),
        F.when(unc, kind["host"]).alias("unc_host"),
        drive.alias("has_drive_letter"),
        (marker & ~relative).alias("disguised"),
        (~relative & contained(base, path)).alias("absolute_inside_base"),
        (~relative | escapes).alias("notable"),
    )
