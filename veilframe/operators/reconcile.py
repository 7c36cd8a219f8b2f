"""What differs between two copies of a table, found by digests of id ranges instead of a join of all ids.

Each range of ids is reduced, where it is scanned, to its number of rows and to an order-free digest of them. Ranges whose
digests are equal on both sides are done with; only those that differ are looked at again in narrower ranges, and only
rows of the narrowest ranges that differ meet in a join. Two equal copies shuffle one row a range and no ids.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.registry import ENTITY_ORDER, entity as lookup
from veilframe.session import materialize
from veilframe.sources.position_index import prune

LEVELS = (24, 12)  # bits of the ids in a range, from the widest range to the narrowest
ONLY_LEFT, ONLY_RIGHT, CHANGED = "only left", "only right", "changed"


def _row_hash(columns: Sequence[str]) -> Column:
    """A 64-bit hash of a row. A NULL is told from an empty text, and every value stands in its own column."""
    return F.xxhash64(*[x for c in columns for x in (F.col(c).isNull(), F.col(c))])


def range_digests(rows: DataFrame, columns: Sequence[str], bits: int) -> DataFrame:
    """(run, n, mixed, added) of each range of 2**bits ids: rows, exclusive or and sum of their hashes."""
    hashed = rows.select(F.shiftright("id", bits).alias("run"), _row_hash(columns).alias("h"))
    return hashed.groupBy("run").agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor("h").alias("mixed"), F.sum(F.col("h").bitwiseAND((1 << 32) - 1)).alias("added")
    )


def _differing(left: DataFrame, right: DataFrame, columns: Sequence[str], bits: int) -> DataFrame:
    """The ranges, written down, whose digests differ or that one side lacks."""
    sides = [range_digests(df, columns, bits).withColumn("side", F.lit(s)) for s, df in ((1, left), (2, right))]
    per = sides[0].unionByName(sides[1]).groupBy("run").agg(F.count(F.lit(1)).alias("sides"), *[F.count_distinct(c).alias(c) for c in ("n", "mixed", "added")])
    unlike = (F.col("sides") == 1) | (F.col("n") > 1) | (F.col("mixed") > 1) | (F.col("added") > 1)
    return materialize(per.where(unlike).select("run"), "differing")


def differences(left: DataFrame, right: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(id, difference): ids that one side lacks, or whose rows are not the same in ``columns``. Ids are unique on each side."""
    columns = ["id", *[c for c in columns if c != "id"]]
    for bits in LEVELS:
        runs = _differing(left, right, columns, bits)
        left, right = prune(left, runs, bits=bits), prune(right, runs, bits=bits)
    sides = [df.select("id", F.lit(s).alias("side"), _row_hash(columns).alias("h")) for s, df in ((ONLY_LEFT, left), (ONLY_RIGHT, right))]
    per = sides[0].unionByName(sides[1]).groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min("h").alias("low"), F.max("h").alias("high"), F.min("side").alias("side"))
    found = per.where((F.col("n") == 1) | (F.col("low") != F.col("high")))
    return found.select("id", F.when(F.col("n") == 1, F.col("side")).otherwise(F.lit(CHANGED)).alias("difference"))


def missing(left: DataFrame, right: DataFrame) -> DataFrame:
    """The ids of the left side that the right side lacks."""
    found = differences(left.select("id"), right.select("id"), ["id"])
    return found.where(F.col("difference") == ONLY_LEFT).select("id")


def reconcile(left: Mapping[str, DataFrame], right: Mapping[str, DataFrame]) -> DataFrame:
    """(entity, only_left, only_right, changed) for every entity: all zero where the copies are the same."""
    def count(what: str) -> Column:
        return F.count_if(F.col("difference") == what).alias(what.replace(" ", "_"))

    parts = []
    for name in ENTITY_ORDER:
        found = differences(left[name], right[name], lookup(name).columns)
        parts.append(found.agg(count(ONLY_LEFT), count(ONLY_RIGHT), count(CHANGED)).select(F.lit(name).alias("entity"), "only_left", "only_right", "changed"))
    return reduce(DataFrame.unionByName, parts)
