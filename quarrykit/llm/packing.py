"""Packing into length buckets that minimise padding.

The histogram of all lengths goes to the driver (a count for each length that occurs, so it grows
with how long texts get and not with how many there are), dynamic programming picks the bucket
bounds with the least padding of all, and batches under a token budget form inside each bucket.

Defined results: null and empty texts have length 0 and fall in the first bucket; a text longer
than the budget is a batch of its own, never cut; repeated rows are placed one by one; ties in
the programming go to the lower bound; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrykit.llm.common import WORD
from quarrykit.session import stored

BUCKETS = 8
TOKEN_BUDGET = 16_384
#: Rows that are numbered together: a bucket is dealt over as many groups as it needs.
GROUP_ROWS = 2048
#: Rows of one id and length (rows without an id, say) that a task unfolds at once.
PIECE_ROWS = 65_536


def histogram(lengths: DataFrame) -> list[tuple[int, int, int]]:
    """(length, rows, most rows of one id) of each length that occurs, ascending; ``lengths`` has a row an id and length, with its count."""
    return sorted((r["n"], r["c"], r["most"]) for r in lengths.groupBy("n").agg(F.sum("c").alias("c"), F.max("c").alias("most")).collect())


def best_bounds(lengths: list[tuple[int, int]], buckets: int = BUCKETS) -> list[int]:
    """Upper bounds of at most ``buckets`` buckets with the least total padding.

    With C rows and S words up to a length, a bucket from i to j costs m(j) * (C(j) - C(i)) -
    (S(j) - S(i)). In m(j) that is a line for each i, whose slopes fall as i grows, so the best i
    for growing j is read off their lower envelope: one pass over the lengths for each bucket.
    """
    n = len(lengths)
    if not n:
        return []
    m, count, total = [0], [0], [0]
    for length, c in lengths:
        m.append(length)
        count.append(count[-1] + c)
        total.append(total[-1] + length * c)
    best = [m[j] * count[j] - total[j] for j in range(n + 1)]
    back: list[list[int]] = []
    for k in range(2, min(buckets, n) + 1):
        now, frm = list(best), [0] * (n + 1)
        lines: list[tuple[int, int, int]] = []  # (rows before, cost with words before, i): value at m is cost - m * rows
        at = 0
        for j in range(k, n + 1):
            c, d = count[j - 1], best[j - 1] + total[j - 1]
            # The last line goes if the new one takes over before the last one does.
            while len(lines) - at > 1 and (d - lines[-2][1]) * (lines[-1][0] - lines[-2][0]) <= (lines[-1][1] - lines[-2][1]) * (c - lines[-2][0]):
                lines.pop()
            lines.append((c, d, j - 1))
            while at + 1 < len(lines) and lines[at + 1][1] - m[j] * lines[at + 1][0] < lines[at][1] - m[j] * lines[at][0]:
                at += 1
            now[j], frm[j] = lines[at][1] - m[j] * lines[at][0] + m[j] * count[j] - total[j], lines[at][2]
        best = now
        back.append(frm)
    bounds, j = [], n
    for frm in reversed(back):
        bounds.append(m[j])
        j = frm[j]
    bounds.append(m[j])
    return bounds[::-1]


def pack(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str | None = "text", length_col: str | None = None, buckets: int = BUCKETS, budget: int = TOKEN_BUDGET, group_rows: int = GROUP_ROWS
) -> DataFrame:
    """One row a document row: its length, bucket, padded length, batch and place in the batch.

    Lengths come from ``length_col`` or are word counts of ``text_col``; they are computed once
    and kept in the shared folder. Rows of a bucket are dealt over groups by a hash of the id and
    numbered there; the rows of the groups before are added, so batches fill across groups, only
    the last of a bucket is not full, and no bucket meets in one task. Rows of one id and length
    are alike here: they are counted before the shuffle, numbered as one row and unfolded after
    it, so neither rows without an id nor an id of a third of all rows gather in a task.
    """
    spark = docs.sparkSession
    n = F.coalesce(F.col(length_col).cast("bigint"), F.lit(0)) if length_col else F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)).cast("bigint"), F.lit(0))
    lengths = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), n.alias("n"))
    lengths = stored(lengths.groupBy("doc_id", "n").agg(F.count("*").alias("c")), "packing")
    found = histogram(lengths)
    counts = [(m, c) for m, c, _ in found]
    bounds = best_bounds(counts, buckets)
    rows, low = [], -1
    for k, high in enumerate(bounds):
        of = sum(c for m, c in counts if low < m <= high)
        rows.append((k, low, high, max(1, budget // max(1, high)), max(1, -(-of // group_rows))))
        low = high
    table = spark.createDataFrame(rows, "bucket int, low bigint, high bigint, batch_rows bigint, groups bigint")
    index = F.lit(0)
    for high in bounds[:-1]:  # at most BUCKETS - 1 comparisons
        index = index + (F.col("n") > high).cast("int")
    placed = lengths.withColumn("bucket", index).join(F.broadcast(table), "bucket")
    mixed = F.pmod(F.coalesce("doc_id", "n"), F.lit(1 << 31)) * F.lit(1103515245)
    placed = placed.withColumn("grp", F.pmod(F.shiftright(mixed, 8), F.col("groups")))
    sizes = stored(placed.groupBy("bucket", "grp").agg(F.sum("c").alias("size")), "groups")
    before = sizes.select("bucket", "grp", F.coalesce(F.sum("size").over(Window.partitionBy("bucket").orderBy("grp").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    earlier = Window.partitionBy("bucket", "grp").orderBy("doc_id", "n").rowsBetween(Window.unboundedPreceding, -1)
    numbered = placed.withColumn("r", F.coalesce(F.sum("c").over(earlier), F.lit(0)))
    placed = numbered.join(before, ["bucket", "grp"]).withColumn("r", F.col("before") + F.col("r"))
    placed = placed.withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("c") - 1, F.lit(PIECE_ROWS))))
    if max((most for *_, most in found), default=0) > PIECE_ROWS:
        placed = placed.repartition("doc_id", "n", "piece")
    placed = placed.withColumn("k", F.explode(F.sequence(F.col("piece"), F.least(F.col("piece") + PIECE_ROWS, F.col("c")) - 1)))
    placed = placed.withColumn("r", F.col("r") + F.col("k"))
    return placed.select(
        "doc_id",
        F.col("n").alias("n_tokens"),
        F.col("bucket").cast("bigint").alias("bucket"),
        F.col("high").alias("padded_to"),
        (F.col("high") - F.col("n")).alias("padding"),
        F.concat_ws("-", F.col("bucket").cast("string"), F.floor(F.col("r") / F.col("batch_rows")).cast("string")).alias("batch"),
        (F.col("r") % F.col("batch_rows")).cast("bigint").alias("slot"),
    )
