"""Escaping, flags, digests and other small text functions as native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarrykit.functions.tables import STEERING

_CLASS = "".join(f"\\x{{{lo:x}}}-\\x{{{hi:x}}}" for lo, hi in STEERING)
LINE = f"[{_CLASS}\\n\\r]"
BLOCK = f"[{_CLASS}\\r]"
LITERAL_WIDTH, QUOTED_WIDTH = 200, 120


def _escaped(text: Column, pattern: str) -> Column:
    """Each character of the class spelled out. Texts without one are passed through."""
    def one(c: Column) -> Column:
        digits = F.lower(F.conv(F.hex(F.encode(c, "UTF-16BE")), 16, 16))
        return F.when(c.rlike(pattern), F.when(F.length(digits) <= 2, F.concat(F.lit("\\x"), F.lpad(digits, 2, "0"))).otherwise(F.concat(F.lit("\\u"), F.lpad(digits, 4, "0")))).otherwise(c)

    return F.when(text.rlike(pattern), F.array_join(F.transform(F.split(text, ""), one), "")).otherwise(text)


def printable_line(text: Column) -> Column:
    """One field for one line of output: control, bidi and zero-width characters and line breaks made visible."""
    return _escaped(text, LINE)


def printable_block(text: Column) -> Column:
    """A body of several lines: CRLF becomes LF, a lone CR is made visible."""
    return _escaped(F.replace(text, F.lit("\r\n"), F.lit("\n")), BLOCK)


def clipped(text: Column, width: int) -> Column:
    return F.when(F.length(text) > width, F.concat(F.substring(text, 1, width), F.lit("..."))).otherwise(text)


def show_literal(text: Column) -> Column:
    """A literal for one line of a report: made visible first and cut afterwards, so that no escape is cut."""
    return clipped(printable_line(text), LITERAL_WIDTH)


def quote_literal(text: Column) -> Column:
    """A differing literal in quotes: line breaks and tabs spelled out, cut, then escaped like a Python string."""
    flat = text
    for raw, spelt in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        flat = F.replace(flat, F.lit(raw), F.lit(spelt))
    inner = printable_line(F.replace(clipped(flat, QUOTED_WIDTH), F.lit("\\"), F.lit("\\\\")))
    double = inner.contains("'") & ~inner.contains('"')
    return F.when(double, F.concat(F.lit('"'), inner, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(inner, F.lit("'"), F.lit("\\'")), F.lit("'")))


def listed(phrases: Column) -> Column:
    """``a``, ``a and b``, ``a, b and c``."""
    head = F.array_join(F.slice(phrases, 1, F.greatest(F.size(phrases) - 1, F.lit(0))), ", ")
    return F.when(F.size(phrases) < 2, F.array_join(phrases, "")).otherwise(F.concat(head, F.lit(" and "), F.element_at(phrases, -1)))


def is_steering(text: Column) -> Column:
    return text.rlike(LINE)


def without_controls(text: Column) -> Column:
    """Provenance fields: control characters and line separators removed."""
    return F.regexp_replace(text, r"[\x{0}-\x{1f}\x{7f}-\x{9f}\x{2028}\x{2029}]", "")


def flag_names(value: Column, names: dict[int, str], bits: int = 32) -> Column:
    """Names of the set bits in bit order, then ``bitN`` for those without a name."""
    v = value.cast("bigint")
    known = F.array(*(F.struct(F.lit(b).alias("b"), F.lit(n).alias("n")) for b, n in sorted(names.items())))
    others = F.array(*(F.lit(b) for b in range(bits) if b not in names))
    is_set = lambda b: F.getbit(v, b) == 1
    return F.concat(F.transform(F.filter(known, lambda x: is_set(x["b"])), lambda x: x["n"]), F.transform(F.filter(others, is_set), lambda b: F.concat(F.lit("bit"), b.cast("string"))))


def sha256_hex(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def is_sha256(text: Column) -> Column:
    return F.lower(F.trim(text)).rlike("^[0-9a-f]{64}$")


def version_display(version: Column) -> Column:
    """``279`` as 2.79, ``0405`` as 4.5; anything but digits stays."""
    n = version.try_cast("bigint")
    return F.when(version.rlike("^[0-9]+$"), F.concat_ws(".", F.floor(n / 100).cast("string"), (n % 100).cast("string"))).otherwise(version)


def max_nesting(text: Column) -> Column:
    """Greatest depth of brackets, without parsing; a closing one never leads below zero."""
    start = F.struct(F.lit(0).alias("d"), F.lit(0).alias("m"))
    step = lambda a, c: F.greatest(F.lit(0), a["d"] + F.when(c.isin("(", "[", "{"), 1).otherwise(-1))
    return F.aggregate(F.regexp_extract_all(text, F.lit(r"[()\[\]{}]"), F.lit(0)), start, lambda a, c: F.struct(step(a, c).alias("d"), F.greatest(a["m"], step(a, c)).alias("m")), lambda a: a["m"])
