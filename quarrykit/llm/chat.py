"""Chat formatting by incremental rendering of a black-box template.

The template is any function from a list of (role, text) to a string. Successive prefixes of a
conversation are rendered and consecutive outputs compared: what the longer one adds is that
turn's span. A template whose output for a prefix is not itself a prefix of the next output
rewrites history, and the turn where it did so is reported.

Defined results: null texts and roles count as empty; turns are ordered by turn (null first),
then role and text, so ties and repeated rows have one order and stay separate turns; a row
without a conv_id is a conversation of one turn; an empty table gives no rows; other columns are
not read. One conversation is one output value, so it has to fit a task's memory.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Turn = tuple[str, str]

START, MIDDLE, END = "<|im_start|>", "\n", "<|im_end|>\n"
#: Control strings of common templates. Inside a text a backslash goes behind
#: their first character, after every backslash of the text itself has been doubled.
CONTROL = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_CONTROL = re.compile("|".join(re.escape(c) for c in CONTROL))
_UNESCAPE = re.compile(r"\\(.)", re.DOTALL)
_TURN = re.compile(re.escape(START) + r"(.*?)" + re.escape(MIDDLE) + r"(.*?)" + re.escape(END), re.DOTALL)


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: f"{m[0][0]}\\{m[0][1:]}", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def _escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\n")  # no control string has n in second place


def _unescape_role(role: str) -> str:
    return _UNESCAPE.sub(lambda m: "\n" if m[1] == "n" else m[1], role)


def template(turns: list[Turn]) -> str:
    """The library's own template: each turn between markers, its role on the first line."""
    return "".join(f"{START}{_escape_role(r)}{MIDDLE}{escape(t)}{END}" for r, t in turns)


def _remembering() -> Callable[[list[Turn]], str]:
    """The library's template for the prefixes of one conversation, each turn rendered once."""
    held: dict[Turn, str] = {}

    def render(turns: list[Turn]) -> str:
        for t in turns[-1:]:
            held.setdefault(t, template([t]))
        return "".join([held[t] for t in turns])

    return render


def turn_spans(turns: list[Turn], render: Callable[[list[Turn]], str]) -> tuple[str, list[tuple[int, int]], list[int]]:
    """The output, each turn's span in it, and the turns at which earlier output changed.

    Every prefix is rendered and compared with the one before, so the work grows with the square
    of a conversation's turns: nothing less tells whether a template that is only called rewrites
    history somewhere.
    """
    out, spans, rewrites = render([]), [], []
    for k in range(len(turns)):
        after = render(turns[: k + 1])
        if after.startswith(out):
            at = len(out)
        else:
            rewrites.append(k)
            at = next((i for i, (a, b) in enumerate(zip(out, after, strict=False)) if a != b), min(len(out), len(after)))
        spans.append((at, len(after)))
        out = after
    return out, spans, rewrites


#: Two texts that no template changes, unlike at both ends and with nothing of each other.
PROBES = ("qxjzq", "wvkyw")


def said_span(text: str, turns: list[Turn], k: int, render: Callable[[list[Turn]], str]) -> tuple[int, int] | None:
    """Where turn ``k`` is said in the whole output ``text`` of any template; None if that can't be told.

    The conversation is rendered with two probes in its place: what both outputs begin and end with
    is not the turn's. It has to stand around the turn in ``text`` as well, and each probe has to come
    out once and unchanged, which a template that says a turn twice does not do. A turn
    that leaves no trace has an empty span.
    """
    one, two = (render([*turns[:k], (turns[k][0], probe), *turns[k + 1 :]]) for probe in PROBES)
    if one == two:
        return 0, 0
    head = _agree(one, two)
    tail = min(_agree(one[::-1], two[::-1]), min(len(one), len(two)) - head)
    if one[head : len(one) - tail] != PROBES[0] or two[head : len(two) - tail] != PROBES[1]:
        return None
    end = len(text) - tail
    return (head, end) if end >= head and text[:head] == one[:head] and text[end:] == one[len(one) - tail :] else None


def _agree(a: str, b: str) -> int:
    """Characters in which two texts begin alike."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[low:middle] == b[low:middle] else (low, middle - 1)
    return low


def content_spans(text: str, spans: list[tuple[int, int]]) -> list[tuple[str, int, int]]:
    """Role and span of the content inside each turn's span, for the library's own template."""
    out = []
    for start, end in spans:
        m = _TURN.match(text, start, end)
        out.append((_unescape_role(m[1]), m.start(2), m.end(2)) if m else ("", start, end))
    return out


def read_back(text: str) -> list[Turn]:
    """Turns from a formatted text alone."""
    return [(_unescape_role(m[1]), unescape(m[2])) for m in _TURN.finditer(text)]


SCHEMA = "conv_id bigint, n_turns bigint, text string, turn_starts array<bigint>, turn_ends array<bigint>, loss_starts array<bigint>, loss_ends array<bigint>, rewritten array<int>, unsure array<int>"


def _groups(frames: Iterable[pd.DataFrame]) -> Iterator[tuple[int | None, list[Turn]]]:
    """Conversations of a partition sorted by conv_id, one at a time; a row without conv_id is one by itself."""
    key, turns, begun = None, [], False
    for frame in frames:
        for c, null, role, text in zip(frame["c"], frame["n"], frame["role"], frame["text"], strict=True):
            at = None if null else int(c)
            if begun and (at is None or at != key):
                yield key, turns
                turns = []
            key, begun = at, True
            turns.append((role, text))
    if begun:
        yield key, turns


def _format(frames: Iterable[pd.DataFrame], loss_role: str, render: Callable[[list[Turn]], str] | None) -> Iterator[pd.DataFrame]:
    names = ["conv_id", "n_turns", "text", "turn_starts", "turn_ends", "loss_starts", "loss_ends", "rewritten", "unsure"]
    rows, size = [], 0
    for key, turns in _groups(frames):
        text, spans, rewrites = turn_spans(turns, render or _remembering())
        unsure = []
        if render:
            found = [(k, said_span(text, turns, k, render)) for k, (role, _) in enumerate(turns) if role == loss_role]
            loss, unsure = [span for _, span in found if span], [k for k, span in found if span is None]
        else:
            loss = [(s, e) for role, s, e in content_spans(text, spans) if role == loss_role]
        rows.append((key, len(turns), text, [s for s, _ in spans], [e for _, e in spans], [s for s, _ in loss], [e for _, e in loss], rewrites, unsure))
        size += len(text)
        if size > 8 << 20:
            yield pd.DataFrame(rows, columns=names).astype({"conv_id": "Int64"})
            rows, size = [], 0
    if rows:
        yield pd.DataFrame(rows, columns=names).astype({"conv_id": "Int64"})


def format_chats(turns: DataFrame, *, loss_role: str = "assistant", render: Callable[[list[Turn]], str] | None = None) -> DataFrame:
    """One row a conversation: formatted text, span of each turn, loss mask, turns that rewrote history and turns whose text can't be told apart.

    The mask of a template that is only called comes from probes (``said_span``); turns in ``unsure``
    are not in it.

    ``render`` is any template, a function from turns to text that tasks can unpickle; without it
    the library's own is used, which alone escapes control strings. One shuffle on conv_id; a
    task streams its sorted conversations and holds one at a time.
    """
    rows = turns.select(
        F.coalesce(F.col("conv_id").cast("bigint"), F.lit(0)).alias("c"),
        F.col("conv_id").isNull().alias("n"),
        F.col("turn").cast("bigint").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    alone = F.when(F.col("n"), F.xxhash64("turn", "role", "text")).otherwise(F.lit(0))  # rows without a conversation are dealt out
    dealt = rows.withColumn("d", alone).repartition("c", "n", "d").sortWithinPartitions("c", "n", "turn", "role", "text").drop("d")
    return dealt.mapInPandas(partial(_format, loss_role=loss_role, render=render), SCHEMA)


def digests(formatted: DataFrame) -> DataFrame:
    """What a consumer reads back from formatted texts and loss masks."""

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for key, text, starts, ends in zip(frame["conv_id"], frame["text"], frame["loss_starts"], frame["loss_ends"], strict=True):
                turns = read_back(text)
                loss = unescape("".join(text[s:e] for s, e in zip(starts, ends, strict=True)))
                sha = hashlib.sha256()
                for role, said in turns:
                    sha.update(f"{role}\n{said}\n".encode("utf-8", "replace"))
                rows.append((None if pd.isna(key) else int(key), len(turns), sha.hexdigest(), len(loss), hashlib.sha256(loss.encode("utf-8", "replace")).hexdigest(), len(text)))
            yield pd.DataFrame(rows, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]).astype({"conv_id": "Int64"})

    return formatted.select("conv_id", "text", "loss_starts", "loss_ends").mapInPandas(
        run, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    )
