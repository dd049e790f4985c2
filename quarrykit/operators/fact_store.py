"""Facts of bodies kept from run to run, so that a body is parsed once ever.

A store is a folder with one folder a version of the syntax pass. Under it each run that met new
bodies adds one folder, written whole and then renamed, so that a run that fails or is repeated leaves
nothing half. Two runs at a time may both parse a body; readers take the facts of the run that
sorts first. Bodies whose time ran out are not kept, and are tried again.
"""

from __future__ import annotations

import hashlib
import inspect
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrykit.operators import syntax
from quarrykit.session import stored


def version() -> str:
    """Digest of what facts depend on: the pass itself and its fixed values."""
    return hashlib.sha256(inspect.getsource(syntax).encode() + inspect.getsource(syntax.t).encode()).hexdigest()[:16]


class FactStore:
    """``facts(bodies)`` has what ``syntax.facts`` would give; ``parsed`` counts the bodies that the last call had to parse."""

    def __init__(self, spark: SparkSession, folder: str, label: str | None = None):
        self.spark, self.folder = spark, f"{folder.rstrip('/')}/facts-{label or version()}"
        self.parsed = 0

    def _fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def held(self) -> DataFrame | None:
        """All facts of the store with the run that added them, or None where there are none."""
        fs, at = self._fs(f"{self.folder}/run=*")
        if not (fs.globStatus(at) or []):
            return None
        schema = f"{syntax.FACTS}, run string"
        return self.spark.read.schema(schema).option("basePath", self.folder).parquet(f"{self.folder}/run=*")

    def facts(self, bodies: DataFrame, *, seconds: float = syntax.SECONDS) -> DataFrame:
        """Facts of distinct bodies (body, source): stored ones by a join, new ones parsed and added."""
        held, columns = self.held(), [c.split()[0] for c in syntax.FACTS.split(", ")]
        if held is None:
            new, old = bodies, None
        else:
            # A body's facts come from one run; of each body the store has one row of kind took.
            owner = held.where("kind = 'took'").groupBy("body").agg(F.min("run").alias("run"))
            owner = stored(owner.join(bodies.select("body"), "body", "left_semi"), "known-bodies")
            new, old = bodies.join(owner, "body", "left_anti"), held.join(owner, ["body", "run"], "left_semi").select(columns)
        found = stored(syntax.facts(new, seconds=seconds, distinct=True), "facts")
        self.parsed = found.where("kind = 'took'").count()
        if self.parsed:
            self._add(found.join(found.where("kind = 'late'").select("body"), "body", "left_anti").select(columns))
        return found if old is None else stored(old.unionByName(found), "facts")

    def _add(self, facts: DataFrame) -> None:
        run = f"{uuid.uuid4().hex}"
        draft = f"{self.folder}/.draft-{run}"
        facts.write.option("compression", "zstd").parquet(draft)
        fs, at = self._fs(draft)
        if not fs.rename(at, self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/run={run}")):
            raise OSError(f"the facts of a run could not be added to {self.folder}")
