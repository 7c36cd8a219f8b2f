"""Retention that is carried out: old rows, documents and batch folders are removed from storage, beside running readers.

``compact_log`` merges the files of a message log whose ids lie at or below a mark, and drops what retention does not keep.
The mark is an id that every stream over the log has passed (``bus_tail`` reads by id and never goes back below its
offset), so a stream that runs beside it loses nothing and sees nothing twice. Files that hold higher ids are not touched.
The new files are complete before the old ones go; one compaction of a log runs at a time.

``retain_batches`` removes the folders of all but the latest batches, ``retain_documents`` the recordings beyond the newest.
Both look at names only. What is removed is gone: each returns what it removed.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.operators.reads import RECORDINGS_KEEP, keep_last
from veilframe.sources.messages import read_messages


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def last_rows(keep: int) -> Callable[[DataFrame], DataFrame]:
    """Retention of the ``keep`` highest ids."""
    return lambda rows: keep_last(rows, keep)


def compact_log(spark: SparkSession, log: str, passed: int, keep: Callable[[DataFrame], DataFrame] | None = None, files: int = 1) -> int:
    """Merge the log's files whose ids are all at most ``passed`` and keep of all its rows those that ``keep`` gives; returns rows dropped.

    Rows above ``passed`` stay whatever ``keep`` says: a reader may not have come to them.
    """
    messages = read_messages(spark, log)
    per_file = messages.withColumn("file", F.input_file_name()).groupBy("file").agg(F.max("id").alias("high"))
    old = [r["file"] for r in per_file.where(F.col("high") <= passed).collect()]  # one name a file of the log
    if not old:
        return 0
    rows = read_messages(spark, log)
    kept = keep(rows).select("id") if keep else rows.select("id")
    there = read_messages(spark, log).withColumn("file", F.input_file_name())
    there = there.join(per_file.where(F.col("high") <= passed).select("file"), "file", "left_semi").drop("file")
    before = there.count()
    fresh = f"{log.rstrip('/')}/_compacting-{uuid.uuid4().hex}"
    # a compaction that died between its last two steps left rows twice
    once = there.join(kept, "id", "left_semi").select(*rows.columns).dropDuplicates(["id"])
    once.repartitionByRange(files, "id").write.parquet(fresh)
    after = spark.read.schema(rows.schema).parquet(fresh).count()
    folder, fs = _fs(spark, fresh)
    for status in fs.listStatus(folder):
        if status.getPath().getName().endswith(".parquet"):
            fs.rename(status.getPath(), spark._jvm.org.apache.hadoop.fs.Path(f"{log.rstrip('/')}/{status.getPath().getName()}"))
    for name in old:
        path, _ = _fs(spark, name)
        fs.delete(path, False)
    fs.delete(folder, True)
    return before - after


def retain_batches(spark: SparkSession, out: str, keep: int = 2) -> list[int]:
    """Remove the ``batch=`` folders before the latest ``keep``; two leave a reader of the last result undisturbed."""
    path, fs = _fs(spark, out)
    if not fs.exists(path):
        return []
    found = [(int(m.group(1)), s.getPath()) for s in fs.listStatus(path) if (m := re.fullmatch(r"batch=(\d+)", s.getPath().getName()))]
    gone = sorted(found, key=lambda x: x[0])[: max(len(found) - keep, 0)]
    for _, folder in gone:
        fs.delete(folder, True)
    return [n for n, _ in gone]


def retain_documents(spark: SparkSession, root: str, keep: int = RECORDINGS_KEEP) -> int:
    """Remove all recording documents but the ``keep`` whose names come last; returns how many went."""
    names = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(root).select("path")
    newest = names.orderBy(F.desc("path")).limit(keep)
    gone = 0
    for r in names.join(newest, "path", "left_anti").toLocalIterator():
        path, fs = _fs(spark, r["path"])
        gone += fs.delete(path, False)
    return gone
