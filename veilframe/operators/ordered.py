"""Order-dependent reductions that never put a table, or a hot key, into one task.

A running sum, a position or a "latest value so far" needs an order, and a plain window sorts all
rows of a key in one task. That is right for keys of ordinary size and wrong for a key that holds a
third of a table. ``ordered_scan`` counts keys first (combined before the shuffle). Ordinary keys
get the plain window. Hot keys, and a scan without keys, work on the order column's bits: rows are
scanned within buckets of 2**21 consecutive order values, bucket summaries within groups of 2**21
buckets, group summaries within the key. Sixty-three bits are three times twenty-one, so where the
order column is unique within a key no window partition ever holds more than 2**21 rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilframe.session import materialize

BITS = 21
HOT_ROWS = 1 << BITS


def ordered_scan(
    df: DataFrame,
    order: str,
    value: Column,
    out: str,
    keys: Sequence[str] = (),
    kind: str = "sum",
    inclusive: bool = True,
    tie: Column | None = None,
    hot_rows: int = HOT_ROWS,
    bits: int = BITS,
) -> DataFrame:
    """Add ``out``: the running sum or minimum, or the latest non-NULL, of ``value`` along ``order``.

    ``order`` is a non-negative bigint column, ``keys`` are non-NULL columns. ``inclusive`` counts
    the row itself. ``tie`` orders rows that share an order value. With keys, the list of hot keys
    is written to the scratch folder: at most one key per ``hot_rows`` rows, usually none.
    """
    if kind not in ("sum", "last", "min"):
        raise ValueError("kind must be sum, last or min")
    keys = list(keys)
    rows = df.withColumn("_v", value)
    by = [F.col(order)]
    if tie is not None:
        rows = rows.withColumn("_tie", tie)
        by.append(F.col("_tie"))
    until = 0 if inclusive else -1

    def over(v: str, window, end: int) -> Column:
        window = window.rowsBetween(Window.unboundedPreceding, end)
        if kind == "sum":
            return F.coalesce(F.sum(v).over(window), F.lit(0))
        if kind == "min":
            return F.min(v).over(window)
        return F.last(v, ignorenulls=True).over(window)

    def combine(near: str, far: str) -> Column:
        if kind == "sum":
            return F.col(near) + F.coalesce(far, F.lit(0))
        if kind == "min":
            return F.least(near, far)
        return F.coalesce(near, far)

    def summary(frame: DataFrame, group: list[str], along: Column) -> DataFrame:
        total = F.max_by("_v", F.when(F.col("_v").isNotNull(), along))
        if kind != "last":
            total = F.sum("_v") if kind == "sum" else F.min("_v")
        return frame.groupBy(*group).agg(total.alias("_v"))

    if keys:
        counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
        hot = materialize(counts.where(F.col("_n") > hot_rows).select(*keys), "hot-keys")
        if hot.isEmpty():
            scanned = rows.withColumn(out, over("_v", Window.partitionBy(*keys).orderBy(*by), until))
            return scanned.select(*df.columns, out)
        # the planner knows the size of the written list: it is broadcast only while it is small
        rows = rows.join(hot.withColumn("_hot", F.lit(True)), keys, "left")
        rows = rows.withColumn("_b0", F.when(F.col("_hot"), F.shiftright(order, bits)))
        rows = rows.repartition(*keys, "_b0")
        heavy = rows.where(F.col("_hot"))
    else:
        rows = heavy = rows.withColumn("_b0", F.shiftright(order, bits))

    buckets = summary(heavy, [*keys, "_b0"], F.struct(*by) if tie is not None else F.col(order))
    buckets = buckets.withColumn("_b1", F.shiftright("_b0", bits))
    groups = summary(buckets, [*keys, "_b1"], F.col("_b0"))
    far = groups.select(
        *keys, "_b1", over("_v", Window.partitionBy(*keys).orderBy("_b1"), -1).alias("_far")
    )
    near = over("_v", Window.partitionBy(*keys, "_b1").orderBy("_b0"), -1).alias("_near")
    offsets = (
        buckets.select(*keys, "_b0", "_b1", near)
        .join(far, [*keys, "_b1"])
        .select(*keys, "_b0", combine("_near", "_far").alias("_offset"))
    )
    window = Window.partitionBy(*keys, "_b0").orderBy(*by)
    scanned = rows.withColumn("_local", over("_v", window, until))
    scanned = scanned.join(offsets, [*keys, "_b0"], "left" if keys else "inner")
    return scanned.select(*df.columns, combine("_local", "_offset").alias(out))


def positions(
    df: DataFrame, order: str, out: str = "position", keys: Sequence[str] = ()
) -> DataFrame:
    """Add the 1-based position of each row along a unique ``order``, per key or overall."""
    return ordered_scan(df, order, F.lit(1).cast("bigint"), out, keys)


def kth_occurrence(df: DataFrame, keys: Sequence[str], order: str, out: str = "k") -> DataFrame:
    """Number the rows that share a key, in order of a unique id. A hot key is split by id."""
    return positions(df, order, out, keys)


def allocate_ids(new_rows: DataFrame, existing: DataFrame, order: str) -> DataFrame:
    """Give new rows dense ids that continue from the highest existing one."""
    last = existing.agg(F.coalesce(F.max("id"), F.lit(0))).scalar()
    numbered = positions(new_rows, order, out="_position")
    rest = [c for c in new_rows.columns if c != "id"]
    return numbered.select((last + F.col("_position")).cast("bigint").alias("id"), *rest)
