"""Exact top-k search by distributed histogram selection.

Vectors are packed into blocks of whole numbers. Every query block meets every candidate block, a team of
query blocks and a chunk of candidate blocks at a time, and all scores are worked out. A pass counts, for
each query, the scores in equal bins of its present range; the counts of all tasks are added, and the bin
that holds the kth score becomes the next range. When bins are one wide, the kth score is known: a last
pass lets through what lies above it and, among scores equal to it, the smallest ids. Nothing is
approximated, and no pass emits pairs. A pass shuffles each query block once a chunk and each candidate
block once a team, in the narrowest whole numbers that hold it; no vector or range goes through the driver.

Defined results: vectors that are NULL, have a NULL id, or hold NULL or non-finite components take no
part; a shorter vector counts as padded with zeros; scores beyond 64 bits stop at its limits; a query
never finds its own id; repeated rows are candidates each, and ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilframe.llm.common import column, discard, saved

BLOCK = 2048  # vectors in a block
CHUNK = 8  # candidate blocks that meet one team
TEAM = 8  # query blocks in a team, fewer where that leaves too few tasks
BINS = 256
LIMIT = (1 << 63) - 1


def blocks(vectors: DataFrame, purpose: str) -> DataFrame:
    """(block, ids, values, n, dims, top, norm): whole vectors of one input task, at most BLOCK in each row.

    Values are whole numbers of ``narrowest(top)``, or decimal text where one is larger than 64 bits; ``top`` is the
    largest size of a component, ``norm`` the largest length of a vector.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, made = TaskContext.get().partitionId() << 20, 0
        ids: list[int] = []
        rows: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            nonlocal made
            dims = max((len(r) for r in rows), default=0)
            matrix = np.zeros((len(rows), dims))
            for i, r in enumerate(rows):
                matrix[i, : len(r)] = r
            top = float(np.abs(matrix).max()) if matrix.size else 0.0
            values = matrix.astype(narrowest(top)).tobytes() if top < 2**62 else ",".join(str(int(v)) for v in matrix.ravel()).encode()
            norm = float(np.sqrt((matrix**2).sum(1)).max()) if matrix.size else 0.0
            made += 1
            block = [base | made, np.array(ids, np.int64).tobytes(), values, len(rows), dims, top, norm]
            ids.clear()
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array([v]) for v in block], names=["block", "ids", "values", "n", "dims", "top", "norm"])

        for batch in batches:
            for i, v in zip(batch.column("id").to_pylist(), batch.column("v"), strict=True):
                values = v.values
                if values.null_count:
                    continue
                row = np.floor(values.to_numpy(zero_copy_only=False).astype(float))
                if np.isfinite(row).all():
                    ids.append(i)
                    rows.append(row)
                    if len(rows) == BLOCK:
                        yield flush()
        if rows:
            yield flush()

    return saved(vectors.mapInArrow(run, "block long, ids binary, values binary, n long, dims long, top double, norm double"), purpose)


def narrowest(top: float) -> type:
    """The narrowest whole numbers that hold components up to ``top`` in size."""
    return next((kind for kind in (np.int8, np.int16, np.int32) if top <= np.iinfo(kind).max), np.int64)


def matrix(values: bytes, n: int, dims: int, top: float) -> np.ndarray:
    if top < 2**62:
        return np.frombuffer(values, narrowest(top)).reshape(n, dims)
    return np.array([int(v) for v in values.decode().split(",")], object).reshape(n, dims)


def products(a: np.ndarray, b: np.ndarray, bound: float) -> np.ndarray:
    """Exact inner products: in floats where sums of ``bound`` fit them, else in wider whole numbers."""
    dims = min(a.shape[1], b.shape[1])
    a, b = a[:, :dims], b[:, :dims]
    if bound < 2**24:
        return (a.astype(np.float32) @ b.astype(np.float32).T).astype(np.int64)
    if bound < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if bound < 2**62:
        return a.astype(np.int64) @ b.astype(np.int64).T
    exact = a.astype(object) @ b.astype(object).T
    return np.clip(exact, -LIMIT - 1, LIMIT).astype(np.int64)


def top_k(queries: DataFrame, candidates: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 64.0) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest inner products of floor(scale * x) for each query row."""

    def whole(df: DataFrame) -> DataFrame:
        vector = column(vector_col).cast("array<double>")
        return df.select(column(id_col).cast("bigint").alias("id"), F.transform(vector, lambda x: x * scale).alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull())

    left, right = blocks(whole(queries), "queries"), blocks(whole(candidates), "candidates")
    spark = left.sparkSession
    sizes = [df.agg(F.count(F.lit(1)), F.max("norm"), F.sum("n")).first() for df in (left, right)]
    if not sizes[0][0] or not sizes[1][0]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    # no score, and no sum on the way to one, is larger than the product of the lengths
    bound = float(sizes[0][1]) * float(sizes[1][1]) * 1.000001
    chunks = -(-sizes[1][2] // (CHUNK * BLOCK))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    teams = min(sizes[0][0], max(-(-sizes[0][2] // (TEAM * BLOCK)), -(-tasks // chunks)))
    # a query's range: lowest score, width of a bin, how many are still sought in it, whether all are wanted
    low = -min(int(bound) + 1, LIMIT + 1)
    width = 1
    while width * BINS < 2 * -low:
        width *= BINS
    state = left.select("block", F.transform(F.sequence(F.lit(1), F.col("n").cast("int")), lambda _: F.struct(F.lit(low).cast("decimal(20,0)").alias("low"), F.lit(k).cast("bigint").alias("left"))).alias("state"))
    state = saved(state, "ranges")
    while True:
        counts = histograms(met(left, right, state, teams, chunks), bound, width)
        after = saved(narrowed(counts, state, width), "ranges")
        discard(state)
        state = after
        if width == 1:
            break
        width //= BINS
    found = selected(met(left, right, state, teams, chunks), bound, k)
    best = Window.partitionBy("block", "at").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def met(left: DataFrame, right: DataFrame, state: DataFrame, teams: int, chunks: int) -> DataFrame:
    """Query blocks with their ranges, and candidate blocks (``state`` NULL): those of one team and chunk in a row, queries first.

    The size of a table of ranges says nothing, since equal ranges take no room on disk: never broadcast.
    """
    def dealt(df: DataFrame, own: str, n_own: int, other: str, n_other: int) -> DataFrame:
        every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_other - 1).cast("bigint")))
        return df.withColumn(own, F.pmod(F.xxhash64("block"), F.lit(n_own))).withColumn(other, every)

    asked = dealt(left.join(state.hint("merge"), "block"), "team", teams, "chunk", chunks)
    offered = dealt(right.withColumn("state", F.lit(None).cast(state.schema["state"].dataType)), "chunk", chunks, "team", teams)
    both = asked.unionByName(offered).withColumn("side", F.col("state").isNull().cast("int"))
    return both.repartition("team", "chunk").sortWithinPartitions("team", "chunk", "side")


class Asked:
    """A query block: what is compared, and the counts that a pass adds up."""

    def __init__(self, row: dict, bound: float):
        self.block, self.ids, self.values = row["block"], np.frombuffer(row["ids"], np.int64), values_of(row)
        self.low = np.array([int(s["low"]) for s in row["state"]], object if bound >= 2**61 else np.int64)
        self.total = np.zeros((len(self.ids), BINS), np.int64)


def values_of(row: dict) -> np.ndarray:
    return matrix(row["values"], row["n"], row["dims"], row["top"])


def cells(batches: Iterator[pa.RecordBatch], bound: float) -> Iterator[tuple[list[Asked], dict | None]]:
    """A cell's query blocks with each of its candidate blocks, and with None when it ends."""
    now, asked = None, []
    for batch in batches:
        for i in range(batch.num_rows):
            [row] = batch.slice(i, 1).to_pylist()
            if now != (row["team"], row["chunk"]):
                yield asked, None
                now, asked = (row["team"], row["chunk"]), []
            if row["state"] is not None:
                asked.append(Asked(row, bound))
            else:
                yield asked, row
    yield asked, None


def histograms(pairs: DataFrame, bound: float, width: int) -> DataFrame:
    """(block, at, bin, n): for the query in place ``at``, how many scores lie in each bin of its range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for asked, row in cells(batches, bound):
            ids, values = (None, None) if row is None else (np.frombuffer(row["ids"], np.int64), values_of(row))
            for q in asked:
                if row is None:
                    at, bins = np.nonzero(q.total)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(at), q.block, np.int64)), pa.array(at.astype(np.int64)), pa.array(bins.astype(np.int64)), pa.array(q.total[at, bins])], names=["block", "at", "bin", "n"]
                    )
                    continue
                bins = products(q.values, values, bound).astype(q.low.dtype, copy=False) - q.low[:, None]
                bins >>= width.bit_length() - 1  # widths are powers of two
                inside = (bins >= 0) & (bins < BINS)
                if np.isin(q.ids, ids).any():
                    inside &= q.ids[:, None] != ids[None, :]
                bins += np.arange(len(bins))[:, None] * BINS
                q.total += np.bincount(bins[inside].astype(np.int64, copy=False), minlength=q.total.size).reshape(q.total.shape)

    counted = pairs.mapInArrow(run, "block long, at long, bin long, n long")
    return counted.groupBy("block", "at", "bin").agg(F.sum("n").alias("n"))


def narrowed(counts: DataFrame, state: DataFrame, width: int) -> DataFrame:
    """For each query the bin that holds the score it seeks: its new range, and what is left to seek there.

    A query with fewer candidates than it seeks keeps its lowest bin, below which there is none.
    """
    bins = Window.partitionBy("block", "at").orderBy(F.desc("bin"))
    total = counts.withColumn("upto", F.sum("n").over(bins))
    places = state.select("block", F.posexplode("state").alias("at", "s")).select("block", F.col("at").cast("bigint").alias("at"), "s")
    per = total.join(places.hint("merge"), ["block", "at"]).groupBy("block", "at").agg(
        F.max(F.when(F.col("upto") >= F.col("s.left"), F.struct("bin", (F.col("s.left") - F.col("upto") + F.col("n")).alias("left")))).alias("hit"),
        F.min(F.struct("bin", (F.col("s.left") - F.col("upto") + F.col("n")).alias("left"))).alias("all"),
    )
    here = F.coalesce("hit", "all")
    low = (F.col("s.low") + F.coalesce(here["bin"], F.lit(0)).cast("decimal(20,0)") * F.lit(width).cast("decimal(20,0)")).cast("decimal(20,0)")
    moved = places.join(per.hint("merge"), ["block", "at"], "left").select("block", F.struct("at", low.alias("low"), F.coalesce(here["left"], F.col("s.left")).alias("left")).alias("r"))
    # at most BLOCK queries in a block
    ordered = moved.groupBy("block").agg(F.sort_array(F.collect_list("r")).alias("r"))
    return ordered.select("block", F.transform("r", lambda r: F.struct(r["low"].alias("low"), r["left"].alias("left"))).alias("state"))


def selected(pairs: DataFrame, bound: float, k: int) -> DataFrame:
    """Every pair above its query's kth score, and of those equal to it each block's smallest ids, as many as are sought."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for asked, row in cells(batches, bound):
            if row is None:
                continue
            ids = np.frombuffer(row["ids"], np.int64)
            order = np.argsort(ids, kind="stable")
            ids, values = ids[order], values_of(row)[order]
            for q in asked:
                scores, counted = products(q.values, values, bound), q.ids[:, None] != ids[None, :]
                kth = np.array([max(int(low), -LIMIT - 1) for low in q.low], np.int64)[:, None]
                equal = counted & (scores == kth)
                equal &= np.cumsum(equal, 1) <= k
                at, found = np.nonzero(equal | (counted & (scores > kth)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(at), q.block, np.int64)), pa.array(at.astype(np.int64)), pa.array(q.ids[at]), pa.array(ids[found]), pa.array(scores[at, found])],
                    names=["block", "at", "query_id", "vec_id", "score"],
                )

    return pairs.mapInArrow(run, "block long, at long, query_id long, vec_id long, score long")
