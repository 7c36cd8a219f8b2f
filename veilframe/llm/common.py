"""What several operators share: views of the input, scratch tables, size-checked joins, components.

Every operator first selects the columns it needs under names of its own, so that further columns
of the input, whatever they are called, never clash with what it computes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilframe.session import materialize

# Rows of at most about 40 bytes: a set of up to this many keys may be broadcast, a larger one is joined by shuffle.
BROADCAST_ROWS = 1 << 18


def column(name: str) -> Column:
    """A column by its exact name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id bigint, text): only these two; a NULL text counts as the empty text."""
    return docs.select(column(id_col).cast("bigint").alias("doc_id"), F.coalesce(column(text_col).cast("string"), F.lit("")).alias("text"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def saved(df: DataFrame, purpose: str, compression: str = "snappy") -> DataFrame:
    """A table in the shared scratch folder: computed once, survives lost executors, has a known size."""
    return materialize(df, f"llm-{purpose}", compression)


def discard(*frames: DataFrame) -> None:
    """Delete scratch tables whose last reader has run."""
    for frame in frames:
        spark = frame.sparkSession
        for file in frame.inputFiles()[:1]:
            path = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small(keys: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """The saved key set, with a broadcast hint only if its counted rows are within the limit."""
    return F.broadcast(keys) if keys.limit(limit + 1).count() <= limit else keys


def prefix_sums(totals: DataFrame, part: str, value: str, out: str) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the rows with a smaller ``part``, a unique number such as a task's.

    First within groups of 4096 parts, then over the groups' sums: no window holds more than 4096 of up to 2^24 rows.
    ``totals`` is read twice, so it should be a saved table. An empty table gives none; a NULL value adds nothing.
    """
    before = (Window.unboundedPreceding, -1)
    rows = totals.withColumn("_group", F.shiftright(part, 12))
    groups = rows.groupBy("_group").agg(F.sum(value).alias("_sum"))
    far = groups.select("_group", F.coalesce(F.sum("_sum").over(Window.orderBy("_group").rowsBetween(*before)), F.lit(0)).alias("_far"))
    near = F.coalesce(F.sum(value).over(Window.partitionBy("_group").orderBy(part).rowsBetween(*before)), F.lit(0))
    return rows.withColumn("_near", near).join(far, "_group").select(*totals.columns, (F.col("_near") + F.col("_far")).alias(out))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the smallest id of each connected component, for every node that has an edge.

    Each round every node takes the smallest label among its own and its neighbours', and then the
    label of its label, so that long chains shrink by half. Labels are written each round and the
    rounds end when none changes. The minimum is combined before the shuffle, whatever a node's degree.
    """
    pairs = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where(F.col("x") != F.col("y"))
    both = saved(pairs.union(pairs.select("y", "x")).distinct(), "edges")
    labels = saved(both.groupBy("x").agg(F.min("y").alias("m")).select(F.col("x").alias("node"), F.least("x", "m").alias("root")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("y"), "root"), "y").groupBy("x").agg(F.min("root").alias("near"))
        step = labels.join(near, F.col("node") == F.col("x"), "left").select("node", "root", F.least("root", "near").alias("next"))
        up = labels.select(F.col("node").alias("next"), F.col("root").alias("jump"))
        step = saved(step.join(up, "next", "left").select("node", "root", F.least("next", "jump").alias("next")), "labels")
        discard(labels)
        labels = step.select("node", F.col("next").alias("root"))
        if step.where(F.col("next") != F.col("root")).isEmpty():
            discard(both)
            return labels
