"""Helpers of the pipeline operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of op7, op8 and op1: runs of anything but space and \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"

#: Bytes up to which a lookup table is broadcast; larger ones are joined with salt.
LOOKUP_BYTES = 16 << 20
SALTS = 16
#: Bytes of text that a task takes out of an Arrow batch at once.
PART_BYTES = 2 << 20

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lower_ascii(column: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(column, UPPER, UPPER.lower())


def parts(batches: Iterator[pa.RecordBatch], text_at: int, size: int = PART_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in slices whose texts have about ``size`` bytes together; a longer text stands alone."""
    for batch in batches:
        sums = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text_at)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        first = 0
        while first < len(sums):
            before = int(sums[first - 1]) if first else 0
            last = max(first + 1, int(np.searchsorted(sums, before + size, "right")))
            yield batch.slice(first, last - first)
            first = last


def texts_of(batch: pa.RecordBatch, at: int) -> list[bytes | None]:
    """A text column as UTF-8 bytes, whatever they hold."""
    return batch.column(at).cast(pa.binary()).to_pylist()


def free_name(docs: DataFrame, *names: str) -> list[str]:
    """The names, each lengthened until no column of ``docs`` has it in any case."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def measured(df: DataFrame) -> int:
    """Bytes of a table: 8 a value and the length of its strings, also of those in arrays."""
    texts = [(F.col(f"`{c}`"), kind) for c, kind in df.dtypes if "string" in kind or "binary" in kind]
    strings = [F.sum(F.octet_length(c) if kind in ("string", "binary") else F.aggregate(F.transform(c, F.octet_length), F.lit(0), lambda t, x: t + x + 8)) for c, kind in texts]
    row = df.agg(F.count("*"), *strings).first()
    return row[0] * 8 * len(df.columns) + sum(x or 0 for x in row[1:])


def lookup(left: DataFrame, right: DataFrame, keys: list[str], spread: Column, most: int = LOOKUP_BYTES) -> DataFrame:
    """Left join with a table that has one row a key; ``left`` may hold a third of its rows under one key.

    The right side is measured first. Small ones are broadcast; others are joined on the
    key and a salt taken from ``spread``, so that a hot key is dealt over SALTS tasks.
    """
    if measured(right) <= most:
        return left.join(F.broadcast(right), keys, "left")
    (salt,) = free_name(left, "_salt")
    salted = left.withColumn(salt, F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    copies = right.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, [*keys, salt], "left").drop(salt)
