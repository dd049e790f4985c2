"""Spelling variants by finite-state composition.

Two words are near if one edit of a code point turns one into the other. The vocabulary's minimised
acceptor A is composed with the one-edit transducer E and with A again; what A . E . A accepts are
the near pairs. The composition is enumerated for one set of initial states at a time: words go to
tasks by what stands around a region of theirs in which the edit may lie (its first half, its
second half), and in each task the acceptor of the regions is built, minimised, and composed. The
edit of a pair stands at the first code point in which the two differ, so each pair belongs to one
region and comes out once.

A task needs the words of one initial state together. Where more than GROUP_ROWS words share one,
its region is halved for them, down to a region of one code point, in which words differ in nothing
else; so no group is larger than the alphabet or GROUP_ROWS.

Defined results: a null or empty text has no words; rows that repeat a doc_id are read one by one,
and a null doc_id is written as an empty string before the colon; no vocabulary gives no rows; other
columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrykit.llm.common import parts, texts_of
from quarrykit.session import stored

LEAST_LETTERS, LEAST_COUNT, RATIO = 7, 2, 10
NOISE = 31  # one run in so many loses a code point
GROUP_ROWS = 50_000
#: Different words that a task holds before it hands their counts on.
HELD = 200_000

_LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))
#: A shorter run cannot become a word, since it only loses code points.
_RUN = re.compile(f"[a-zÀ-ÿ]{{{LEAST_LETTERS},}}")


def counted(texts: list[bytes | None], ids: list[int | None], counts: Counter) -> None:
    """Add the words of some documents to ``counts``."""
    for i, text in zip(ids, texts, strict=True):
        if not text:
            continue
        start = zlib.crc32(f"{'' if i is None else i}:".encode())
        for run, n in Counter(_RUN.findall(text.translate(_LOWER).decode("utf-8", "replace"))).items():
            h = zlib.crc32(run.encode(), start)
            if not h % NOISE:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
                if len(run) < LEAST_LETTERS:
                    continue
            counts[run] += n


def _emitted(counts: Counter) -> pa.RecordBatch:
    out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])
    counts.clear()
    return out


def vocabulary(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): words of the whole texts with their occurrences; counted in each task before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in parts(batches, 1):
            counted(texts_of(batch, 1), batch.column(0).to_pylist(), counts)
            if len(counts) >= HELD:
                yield _emitted(counts)
        yield _emitted(counts)

    said = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "word string, n bigint")
    return said.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


class Acceptor:
    """Minimal acceptor of some strings; states without a choice are passed over, so edges bear strings.

    States are numbers. ``after[q]`` has the strings that lead from q to an end, by first letter and
    without it; equal states are one, as minimisation asks, so each is met once in a composition.
    """

    def __init__(self, words: list[str]):
        self.final: list[bool] = []
        self.edges: list[tuple[tuple[str, int], ...]] = []
        self.after: list[dict[str, set[str]]] = []
        self._known: dict[tuple, int] = {}
        words = sorted(words)
        path: list[tuple[int, bool, list]] = [(0, not words[0] if words else False, [])]  # (depth, final, edges) along the last word
        last = ""
        for word in words:
            shared = 0
            for a, b in zip(last, word, strict=False):
                if a != b:
                    break
                shared += 1
            self._close(path, last, shared)
            if word:
                path.append((len(word), True, []))
            last = word
        self._close(path, last, 0)
        self.start = self._state(path[0][1], path[0][2])

    def _close(self, path: list, word: str, depth: int) -> None:
        """Finish the states deeper than ``depth``."""
        while path[-1][0] > depth:
            low, final, edges = path.pop()
            if path[-1][0] < depth:
                path.append((depth, False, []))
            path[-1][2].append((word[path[-1][0] : low], self._state(final, edges)))

    def _state(self, final: bool, edges: list[tuple[str, int]]) -> int:
        key = (final, tuple(edges))
        if key not in self._known:
            self._known[key] = len(self.final)
            self.final.append(final)
            self.edges.append(key[1])
            self.after.append({label[0]: {label[1:] + rest for rest in self.language(to)} for label, to in edges})
        return self._known[key]

    def language(self, q: int) -> Iterator[str]:
        """Strings that lead from ``q`` to an end."""
        if self.final[q]:
            yield ""
        for first, rests in self.after[q].items():
            for rest in rests:
                yield first + rest

    def edits(self, q: int) -> Iterator[tuple[str, str]]:
        """Pairs of the composition whose edit is made at ``q``: one letter for another, or one left out, the last of its run."""
        letters = sorted(self.after[q])
        for k, a in enumerate(letters):
            mine = self.after[q][a]
            for b in letters[k + 1 :]:
                for rest in mine & self.after[q][b]:
                    yield a + rest, b + rest
            if self.final[q] and "" in mine:
                yield a, ""
            for b in letters:
                if b != a:
                    theirs = self.after[q][b]
                    few, many = ({b + rest for rest in theirs}, mine) if len(theirs) < len(mine) else (mine, None)
                    for rest in few & many if many is not None else [r for r in few if r and r[0] == b and r[1:] in theirs]:
                        yield a + rest, rest

    def composed(self) -> Iterator[tuple[str, str]]:
        """All pairs of A . E . A, each once, the longer string first."""
        made: dict[int, list[tuple[str, str]]] = {}
        work = [(self.start, "")]
        while work:
            q, before = work.pop()
            if q not in made:
                made[q] = list(self.edits(q))
            for x, y in made[q]:
                yield before + x, before + y
            work += [(to, before + label) for label, to in self.edges[q] if self.edges[to]]


def _regions(words: DataFrame, low: Column, high: Column, length: Column) -> DataFrame:
    """Rows with the region [low, high) of a word among words of ``length`` code points, or of one more."""
    end = F.when(F.col("size") > length, high + 1).otherwise(high)
    return words.select(
        "word", "n", "size", length.alias("length"), low.alias("low"), high.alias("high"),
        F.substr("word", F.lit(1), low).alias("before"), F.substr("word", end + 1, F.col("size")).alias("behind"), F.substr("word", low + 1, end - low).alias("part"),
    )


_KEY = ["length", "low", "high", "before", "behind"]


def regions(words: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Each word in the regions in which an edit of it may lie; initial states with too many words have theirs halved."""
    sized = words.withColumn("size", F.length("word"))
    # A word meets those of its own length and longer by one, and those shorter by one.
    lengths = sized.withColumn("length", F.explode(F.array("size", F.col("size") - 1))).where(F.col("length") >= LEAST_LETTERS)
    half = F.expr("(length - 1) div 2").cast("int")
    halves = F.array(F.struct(F.lit(0).alias("low"), half.alias("high")), F.struct(half.alias("low"), F.col("length").alias("high")))
    cut = lengths.withColumn("r", F.explode(halves))
    todo = _regions(cut, F.col("r.low"), F.col("r.high"), F.col("length"))
    done = None
    while True:
        large = todo.where("high - low > 1").groupBy(*_KEY).count().where(F.col("count") > group_rows).select(*_KEY)
        large = stored(large, "large")
        if large.isEmpty():
            return todo if done is None else done.unionByName(todo)
        kept = todo.join(large, _KEY, "left_anti").select(todo.columns)
        done = kept if done is None else done.unionByName(kept)
        middle = F.expr("(low + high) div 2").cast("int")
        split = todo.join(large, _KEY, "left_semi").withColumn("r", F.explode(F.array(F.struct("low", middle.alias("high")), F.struct(middle.alias("low"), "high"))))
        todo = _regions(split, F.col("r.low"), F.col("r.high"), F.col("length"))


_PAIRS = "a string, a_n bigint, b string, b_n bigint"


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[str], list[int]]]:
    """(key, parts, counts) of each initial state; rows come sorted by key."""
    key, texts, counts = None, [], []
    for batch in batches:
        for *own, part, n in zip(*(batch.column(c).to_pylist() for c in (*_KEY, "part", "n")), strict=True):
            if own != key:
                if len(texts) > 1:
                    yield key, texts, counts
                key, texts, counts = own, [], []
            texts.append(part)
            counts.append(n)
    if len(texts) > 1:
        yield key, texts, counts


def _compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    for (length, low, high, before, behind), texts, counts in _groups(batches):
        size, n, last = high - low, dict(zip(texts, counts, strict=True)), high == length
        for x, y in Acceptor(texts).composed():
            # Two of the longer words meet where their own length is the measure; what is
            # left out behind a region belongs to the next one.
            if len(y) == size and (len(x) == size or last or x[:-1] != y):
                rows.append((before + x + behind, n[x], before + y + behind, n[y]))
        if len(rows) > 50_000:
            yield _pairs(rows)
            rows = []
    yield _pairs(rows)


def _pairs(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.string(), pa.int64(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["a", "a_n", "b", "b_n"])


def near_pairs(words: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(a, a_n, b, b_n): each pair of near words of ``words`` (word, n) once."""
    placed = regions(words, group_rows).select(*_KEY, "part", "n")
    return placed.repartition(*_KEY).sortWithinPartitions(*_KEY).mapInArrow(_compose, _PAIRS)


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): forms followed to the last one by pointer jumping; counts rise tenfold a step, so chains are short."""
    held = stored(forms.where("form is not null").select("word", F.col("form").alias("root")), "roots")
    while True:
        far = held.select(F.col("word").alias("root"), F.col("root").alias("far"))
        jumped = stored(held.join(far, "root", "left").select("word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")), "roots")
        held = jumped.select("word", "root")
        if jumped.where("moved").isEmpty():
            return held


def variants(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", group_rows: int = GROUP_ROWS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each word of the vocabulary."""
    words = stored(vocabulary(docs, id_col=id_col, text_col=text_col), "vocabulary")
    pairs = stored(near_pairs(words, group_rows), "pairs")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")).unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("near_n")))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), "near")).alias("best"))
    joined = words.join(best, "word", "left")
    large = -F.col("best.m") >= RATIO * F.col("n")
    formed = stored(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(large, F.col("best.near")).alias("form"), F.when(large, -F.col("best.m")).alias("form_n")), "forms")
    return formed.join(roots(formed), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
