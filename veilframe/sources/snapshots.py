"""Entity datasets on shared storage: versioned directories and a commit log.

``<root>/<entity>/v000001`` holds one version of an entity. ``<root>/commits`` is an append-only
log of (entity, version); the highest version of an entity is the current one. A replacement
writes a new version and then commits it, so a path that is being read is never overwritten and a
job that dies half-way leaves the old version in force. An append adds files to the current
version, which readers already under way do not see.

Several writers may share a root. Each reads the log anew before it writes; a new version's folder
can be made by one of them only; and a write that finds that the version it built on is no longer
the current one fails with ``VersionConflict`` instead of losing rows.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.registry import ENTITY_ORDER, entity


def read_entity(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Scan a plain parquet folder of an entity with its declared schema and column order."""
    ent = entity(name)
    return spark.read.schema(ent.schema).parquet(path).select(*ent.columns)


class VersionConflict(RuntimeError):
    """Another writer has replaced the entity, or is about to."""


class SnapshotStore:
    """One dataset root, raw or masked, holding the five entities."""

    COMMIT = "entity STRING, version INT"

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")
        self._known: dict[str, int] = {}

    def _commits(self) -> DataFrame:
        return self.spark.read.schema(self.COMMIT).json(f"{self.root}/commits")

    def version(self, name: str) -> int:
        """The version of an entity that this store reads, 0 where it was never written."""
        entity(name)
        if not self._known:
            self.refresh()
        return self._known[name]

    def _unmoved(self, name: str) -> int:
        """The version read so far, if it still is the current one."""
        before = self.version(name)
        self.refresh()
        if self._known[name] != before:
            raise VersionConflict(f"{name}: version {before} was read, {self._known[name]} is current")
        return before

    def refresh(self) -> None:
        """Read the commit log: one line per replacement ever made."""
        self._known = dict.fromkeys(ENTITY_ORDER, 0)
        try:
            rows = self._commits().groupBy("entity").agg(F.max("version").alias("version")).collect()
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return
        self._known.update({r["entity"]: r["version"] for r in rows})

    def path(self, name: str, version: int) -> str:
        return f"{self.root}/{name}/v{version:06d}"

    def read(self, name: str) -> DataFrame:
        version = self.version(name)
        if version == 0:
            return self.spark.createDataFrame([], entity(name).schema)
        return read_entity(self.spark, self.path(name, version), name)

    def read_all(self) -> dict[str, DataFrame]:
        return {name: self.read(name) for name in ENTITY_ORDER}

    def replace(self, name: str, df: DataFrame) -> int:
        """Write a new version and make it current. ``df`` may read the old version.

        A folder that a dead writer left uncommitted is in the way until ``clear_unfinished`` removes it.
        """
        version = self._unmoved(name) + 1
        try:
            self._project(name, df).write.mode("errorifexists").parquet(self.path(name, version))
        except AnalysisException as error:
            if error.getCondition() != "PATH_ALREADY_EXISTS":
                raise
            raise VersionConflict(f"{name}: version {version} is being written") from error
        commit = self.spark.createDataFrame([(name, version)], self.COMMIT)
        commit.coalesce(1).write.mode("append").json(f"{self.root}/commits")
        self._known[name] = version
        return version

    def append(self, name: str, df: DataFrame) -> None:
        """Add rows to the current version, whoever wrote it; fails if it is replaced meanwhile."""
        self.refresh()
        version = self._known[name]
        if version == 0:
            self.replace(name, df)
            return
        self._project(name, df).write.mode("append").parquet(self.path(name, version))
        self._unmoved(name)

    def clear_unfinished(self, name: str) -> None:
        """Remove what a dead writer left of the next version."""
        self.refresh()
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name, self._known[name] + 1))
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def reset(self) -> None:
        """Make every entity empty, as a new version with the declared schema."""
        for name in ENTITY_ORDER:
            self.replace(name, self.spark.createDataFrame([], entity(name).schema))

    def _project(self, name: str, df: DataFrame) -> DataFrame:
        """The explicit column list of a write, cast to the declared types."""
        return df.select(*[F.col(f.name).cast(f.dtype).alias(f.name) for f in entity(name).fields])
