"""Kinds of string literals as native columns: url, host, command, path, blob."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarrykit.functions.tables import BLOB_CHARS, HOST_CHARS, LITERAL_CHARS, NOT_TLDS, PATH_CHARS, TLDS, TOOLS

# What a literal must look like to be of a kind, and which kind goes first.
#: White space as Unicode has it, spelled out: Java's \s is ASCII.
SPACE = r"\t-\r\x1c-\x20\x85\xa0  -     　"
WORD = r"\p{L}\p{N}_"
URL = rf"(?i)(?:https?|ftps?|file)://[^{SPACE}'\"<>|]{{3,}}"
HOST = r"(?i)^[a-z0-9](?:[a-z0-9-]*[a-z0-9])?(?:\.[a-z0-9-]+)+$"
TOKEN = rf"[^{SPACE}'\"]{{4,}}"

KIND_RANK = {"url": 0, "host": 1, "command": 2, "path": 3, "blob": 4}


def stripped(text: Column) -> Column:
    """Without white space at both ends, as Unicode has it."""
    return F.regexp_replace(text, rf"^[{SPACE}]+|[{SPACE}]+$", "")


def urls(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(URL), F.lit(0))


def is_host(text: Column) -> Column:
    """A dotted name whose last label is a top-level domain and not a file extension."""
    suffix = F.lower(F.substring_index(text, ".", -1))
    allowed = sorted(set(TLDS) - set(NOT_TLDS))
    return text.rlike(HOST) & (F.length(text) <= HOST_CHARS) & suffix.isin(allowed)


def is_path(text: Column) -> Column:
    anchored = text.rlike(r"^[a-zA-Z]:[\\/]") | text.startswith("\\\\") | text.startswith("~/") | text.startswith("~\\") | text.startswith("//")
    variable = text.rlike(r"%[A-Za-z_]+%") | text.rlike(rf"^\$\{{?[{WORD}]") | text.contains("$HOME") | F.lower(text).contains("$env:")
    separated = (text.contains("/") | text.contains("\\")) & ~text.startswith("http") & ~text.startswith("ftp") & text.rlike(rf"[{WORD}.-]+[\\/][{WORD}.-]")
    spaced = text.contains(" ") | text.contains("\t")
    in_prose = text.rlike(r"^(?:/|\\|\./|\.\\)") | text.rlike(rf"[\\/][{WORD} -]+\.[A-Za-z0-9]{{1,8}}$")
    return (F.length(text) <= PATH_CHARS) & ~text.contains("\n") & (anchored | variable | (separated & (~spaced | in_prose)))


def is_command(text: Column) -> Column:
    low = F.lower(text)
    return F.exists(F.array(*(F.lit(t) for t in TOOLS)), lambda t: low.contains(t))


def is_blob(text: Column, least: int = BLOB_CHARS) -> Column:
    return (F.length(text) >= least) & (text.rlike(r"^[A-Za-z0-9+/=_-]+$") | text.rlike(r"^(?:0x)?[0-9a-fA-F]+$"))


def literals(text: Column, bare: bool = False, least: int = BLOB_CHARS) -> Column:
    """array<struct<rank, kind, value>> of one candidate. ``bare``: tokens of unparsed text, where a dotted name proves nothing."""
    s = stripped(text)
    one = lambda kind, value: F.struct(F.lit(KIND_RANK[kind]).alias("rank"), F.lit(kind).alias("kind"), value.alias("value"))
    none = F.expr("cast(array() as array<struct<rank:int,kind:string,value:string>>)")
    host = F.lit(False) if bare else is_host(s)
    found = F.concat(
        F.transform(urls(text), lambda u: one("url", u)),
        F.when(is_blob(s, least), F.array(one("blob", s))).otherwise(
            F.concat(
                F.when(is_command(s), F.array(one("command", s))).otherwise(none),
                F.when(host, F.array(one("host", s))).when(is_path(s), F.array(one("path", s))).otherwise(none),
            )
        ),
    )
    return F.when((text != "") & (F.length(text) <= LITERAL_CHARS), found).otherwise(none)


def tokens(text: Column) -> Column:
    """What stands for literals in a body that does not parse."""
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def sorted_distinct(found: Column) -> Column:
    """Literals by kind, then value, each once."""
    return F.array_sort(F.array_distinct(found))
