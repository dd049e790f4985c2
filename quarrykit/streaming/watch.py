"""Containers as they arrive: findings of new files, and reports of files that have changed."""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quarrykit.jobs import inspect
from quarrykit.operators.fact_store import FactStore
from quarrykit.session import shared_folder
from quarrykit.sources import container, datasource


def watch(spark: SparkSession, folder: str, out: str, limits: container.Limits = container.Limits(), label: str = "watch") -> StreamingQuery:
    """Write the findings of files that are new since the last run; stops when there are none left.

    The checkpoint in the shared folder remembers files, so none is inspected twice or left out.
    """
    rows = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("pathGlobFilter", "*.blend").option("recursiveFileLookup", True).load(folder)
    found = container.inspect_rows(rows, limits)
    return found.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{shared_folder(spark)}/{label}-stream").trigger(availableNow=True).start()


def watch_reports(
    spark: SparkSession, folder: str, out: str, *, known: DataFrame | None = None, known_version: str = "", limits: container.Limits = container.Limits(), store: FactStore | None = None, label: str = "watch-reports", settle: float = 2.0
) -> StreamingQuery:
    """The whole inspection of files as they arrive or change; what comes out is each file whose report differs from its last one.

    ``out`` has a folder a micro-batch (path, tier, reasons, recognised, timed_out_at, steps, error,
    known_version) and is the state at once: a file's last row in it is what it is compared with. A
    batch that runs again writes its own folder anew and looks at earlier ones only, so a restart
    neither loses nor doubles a row. Files come from the ``containers`` source, which gives a changed file again. With another ``known_version`` a file that is seen again comes out even
    if its report is the same.
    """
    told = ["tier", "reasons", "recognised", "timed_out_at", "steps", "error", "known_version"]
    schema = "path string, tier string, reasons array<string>, recognised array<string>, timed_out_at string, steps array<string>, error string, known_version string"

    def one(batch: DataFrame, n: int) -> None:
        of = inspect.inspection(spark, batch, known=known, seconds=limits.seconds, store=store)
        good = inspect.summaries(of).withColumn("error", F.lit(None).cast("string"))
        none = lambda kind: F.lit(None).cast(kind)
        bad = container.errors(of.rows).select("path", *(none("string" if c in ("tier", "timed_out_at") else "array<string>").alias(c) for c in told[:5]), F.col("kind").alias("error"))
        now = good.select("path", *told[:-1]).unionByName(bad).withColumn("known_version", F.lit(known_version))
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{out}/batch=*")
        found = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at) or []
        earlier = [p for p in (s.getPath().toString() for s in found) if int(p.rsplit("=", 1)[1]) < n]
        if earlier:
            held = spark.read.schema(f"{schema}, batch bigint").option("basePath", out).parquet(*earlier)
            last = held.groupBy("path").agg(F.max_by(F.struct(*told), "batch").alias("last"))
            now = now.join(last, "path", "left").where(~F.struct(*told).eqNullSafe(F.col("last"))).drop("last")
        now.write.mode("overwrite").parquet(f"{out}/batch={n}")

    spark.dataSource.register(datasource.ContainerSource)
    options = {"folders": json.dumps([folder]), "limits": json.dumps(asdict(limits)), "settle": str(settle)}
    rows = spark.readStream.format("containers").options(**options).load()
    return rows.writeStream.foreachBatch(one).option("checkpointLocation", f"{shared_folder(spark)}/{label}-stream").trigger(availableNow=True).start()
