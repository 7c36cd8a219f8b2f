"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

# Settings the operators rely on; all of them are plain Spark options.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
}


def build_session(app: str = "veilframe", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_LOCAL_SCRATCH: list[str] = []


def scratch_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below the shared folder the cluster names in ``spark.checkpoint.dir``.

    Only where that is unset and one process does all the work, as in a local test, a temporary
    folder of this machine is used; executors elsewhere would not see it.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _LOCAL_SCRATCH:
            _LOCAL_SCRATCH.append(tempfile.mkdtemp(prefix="veilframe-"))
        shared = _LOCAL_SCRATCH[0]
    return f"{shared.rstrip('/')}/veilframe/{purpose}-{uuid.uuid4().hex}"


_PASSING: ContextVar[list[str] | None] = ContextVar("passing", default=None)
FILE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def passing_scratch(spark: SparkSession) -> Iterator[None]:
    """Give disk back early: what ``materialize`` writes inside is deleted on leaving, unless it is to stay, and
    each query run inside deletes its shuffle files when it ends.

    Nothing that reads such a table may run later. What a block inside a block writes is the inner one's.
    """
    made: list[str] = []
    before, token = spark.conf.get(FILE_CLEANUP, None), _PASSING.set(made)
    spark.conf.set(FILE_CLEANUP, "true")
    try:
        yield
    finally:
        _PASSING.reset(token)
        if before is None:
            spark.conf.unset(FILE_CLEANUP)
        elif before != "true":
            spark.conf.set(FILE_CLEANUP, before)
        for path in made:
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def materialize(df: DataFrame, purpose: str, compression: str = "snappy", stays: bool = False) -> DataFrame:
    """Write a frame to the shared scratch folder and read it back.

    For results that several later steps read: it is computed once, survives lost executors, and
    the planner knows its size when it chooses a join. Columns can be pruned when it is read.
    ``stays`` keeps it where ``passing_scratch`` deletes the others.
    """
    spark = df.sparkSession
    path = scratch_dir(spark, purpose)
    if not stays and (made := _PASSING.get()) is not None:
        made.append(path)
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)
