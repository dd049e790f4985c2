"""Session helpers shared by every job: reading tables, the shared folder, cutting lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` under ``sf_dir``; any URI that Spark can read will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    A folder of our own is made only in local mode, where the session names none (tests).
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            return held.get()
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("name a folder that driver and executors share in spark.checkpoint.dir")
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(folder)
        folder = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return folder.rstrip("/")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as parquet in the shared folder and read it back.

    Cuts the lineage like a checkpoint, but stays columnar and compressed, so a lost
    executor costs no recomputation and later reads prune columns.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, label: str, key: str) -> DataFrame:
    """``stored``, dealt by ``key`` into as many buckets as the session has shuffle partitions and sorted in them.

    Joins and groupings on the key, or on it with others, then need no shuffle, however many of them
    read the table; plan them within ``co_partitioned``. The bucket layout is known to the session's
    catalog only, under a name of its own that is given up at once.
    """
    spark = df.sparkSession
    name, n = f"{label.replace('-', '_')}_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartition(n, key).write.bucketBy(n, key).sortBy(key).option("compression", "zstd").option("path", f"{shared_folder(spark)}/{name}").saveAsTable(name)
    held = spark.table(name).select("*")
    held.schema  # resolved before the name goes
    spark.sql(f"DROP TABLE {name}")
    return held


@contextmanager
def co_partitioned(spark: SparkSession) -> Iterator[None]:
    """Plans made and run inside take a table that is dealt by one key of a join as dealt for the join."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)
