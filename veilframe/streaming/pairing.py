"""Pairing requests with replies as they come, with the open requests in a table on the shared folder.

    <state>/open/batch=7    requests that wait, and echoes whose request may still come
    <state>/mark/batch=7    the latest time seen
    <out>/batch=7           (request_id, reply_id), each request once

An echo is given out in the batch it comes in. A request without one stays open until its time is over by the watermark
(the latest time seen, less the lateness allowed), an echo without a request until the watermark has passed it. Along one key, in order of time and id, an echo answers the oldest request that is
still open, and a request stops waiting ``timeout`` seconds after it was sent. Requests are numbered, and of each echo it is
counted how many requests came before it (U) and how many have stopped waiting (L): running sums, split for hot keys by
``ordered_scan``. The number of requests done with then goes, echo by echo, from q to min(max(q, L) + 1, U). Such steps
combine to one of the same kind, so a key of many echoes is cut into chunks: each is summed up by itself, the chunks' first
numbers follow from the sums, and each is walked by itself. An echo then meets its request by (key, number).

Each batch reads what the one before it left and writes folders of its own, so a batch that is run again writes the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.functions.text import canonical_json
from veilframe.operators.ordered import ordered_scan
from veilframe.session import materialize

CHUNK_BITS = 16  # echoes of one key that one task walks
EVENTS = "is_request BOOLEAN, id BIGINT, at_ms BIGINT, key STRING"
FAR = 1 << 60


def events_of(messages: DataFrame) -> DataFrame:
    """Requests and echoes under the digest of their canonical JSON; a message without a time is older than all others."""
    is_request = F.col("sender") == "test"
    echo = F.to_json(F.try_variant_get(F.try_parse_json("body"), "$.echo", "variant"))
    key = F.md5(F.when(is_request, canonical_json(F.col("body"))).otherwise(echo))
    return messages.where(F.col("sender").isin("test", "prod")).select(
        is_request.alias("is_request"), "id", F.coalesce(F.unix_millis("created_at"), F.lit(0)).alias("at_ms"), key.alias("key")
    )


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each echo that answers, with the number of its request; echoes come sorted by key, chunk and place."""
    current, done = None, 0
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("key", "chunk", "id", "gone", "before", "entry")]
        out: list[tuple[str, int, int]] = []
        for key, chunk, number, gone, before, entry in zip(*columns, strict=True):
            if (key, chunk) != current:
                current, done = (key, chunk), entry or 0
            done = max(done, gone)
            if done < before:
                out.append((key, done, number))
                done += 1
        yield pa.record_batch([pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.int64())], ["key", "k", "reply_id"])


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a chunk's echoes make of q together: min(max(q + a, b), c)."""
    out: dict[tuple[str, int], tuple[int, int, int]] = {}
    for batch in batches:
        for key, chunk, gone, before in zip(*[batch.column(c).to_pylist() for c in ("key", "chunk", "gone", "before")], strict=True):
            a, b, c = out.get((key, chunk), (0, -FAR, FAR))
            out[key, chunk] = a + 1, max(b, gone) + 1, min(max(c, gone) + 1, before)
    yield pa.record_batch(
        [pa.array([k[0] for k in out], pa.string()), pa.array([k[1] for k in out], pa.int64()), *[pa.array([v[i] for v in out.values()], pa.int64()) for i in range(3)]], ["key", "chunk", "a", "b", "c"]
    )


def _entries(sums: pd.DataFrame) -> pd.DataFrame:
    """The number with which each chunk of one key begins: one row for 2**CHUNK_BITS echoes."""
    sums, entries, done = sums.sort_values("chunk"), [], 0
    for a, b, c in zip(sums["a"], sums["b"], sums["c"], strict=True):
        entries.append(done)
        done = min(max(done + a, b), c)
    return sums[["key", "chunk"]].assign(entry=entries)


def match(events: DataFrame, timeout_ms: int) -> tuple[DataFrame, DataFrame]:
    """(requests numbered by key, echoes with the number of the request they answer), for events in any order.

    Returned as (key, k, request_id, at_ms) and (key, k, reply_id).
    """
    request = F.col("is_request")
    ends = events.where(request).select(F.lit(0).alias("kind"), "id", (F.col("at_ms") + timeout_ms + 1).alias("ms"), "key")
    timeline = events.select(F.when(request, 1).otherwise(2).alias("kind"), "id", F.col("at_ms").alias("ms"), "key").unionByName(ends)
    # at one moment waiting ends first, then messages go by id
    place = F.struct((F.col("kind") != 0).alias("message"), F.col("id").alias("id"), F.col("kind").alias("kind"))
    worth = F.when(F.col("kind") == 1, F.lit(1)).when(F.col("kind") == 0, F.lit(1 << 32)).otherwise(F.lit(0)).cast("bigint")
    counted = ordered_scan(timeline, "ms", worth, "sums", ["key"], tie=place)
    low = F.col("sums").bitwiseAND((1 << 32) - 1)
    counted = materialize(counted.where(F.col("kind") != 0).select("key", "kind", "id", "ms", low.alias("before"), F.shiftright("sums", 32).alias("gone")), "pair-counts")
    requests = counted.where(F.col("kind") == 1).select("key", (F.col("before") - 1).alias("k"), F.col("id").alias("request_id"), F.col("ms").alias("at_ms"))

    # an echo before which no request came answers nothing and moves nothing
    echoes = counted.where((F.col("kind") == 2) & (F.col("before") > 0)).drop("kind")
    placed = ordered_scan(echoes, "ms", F.lit(1).cast("bigint"), "nth", ["key"], tie=F.col("id"))
    placed = materialize(placed.withColumn("chunk", F.shiftright(F.col("nth") - 1, CHUNK_BITS)), "pair-echoes")
    by_chunk = ["key", "chunk"]
    many = placed.where(F.col("chunk") > 0).select(F.col("key")).distinct()
    if many.isEmpty():
        begun = placed.withColumn("entry", F.lit(0).cast("bigint"))
    else:
        cut = placed.join(many, "key", "left_semi").repartition(*by_chunk).sortWithinPartitions(*by_chunk, "nth")
        sums = cut.select("key", "chunk", "gone", "before").mapInArrow(_sums, "key string, chunk long, a long, b long, c long")
        entries = sums.groupBy("key").applyInPandas(_entries, "key string, chunk long, entry long")
        begun = placed.join(entries, by_chunk, "left")
    sorted_echoes = begun.repartition(*by_chunk).sortWithinPartitions(*by_chunk, "nth")
    return requests, sorted_echoes.select("key", "chunk", "id", "gone", "before", "entry").mapInArrow(_walk, "key string, k long, reply_id long")


def _kept(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def pair_batch(messages: DataFrame, state: str, out: str, batch_id: int, timeout: int, lateness: int) -> None:
    """Pair the messages of a batch with each other and with what is open, and let go of what has waited too long."""
    spark = messages.sparkSession
    events, unreadable = events_of(messages), F.col("key").isNull()
    seen = spark.createDataFrame([], "at_ms BIGINT")
    if batch_id:
        events = events.unionByName(_kept(spark, f"{state}/open/batch={batch_id - 1}", EVENTS))
        seen = _kept(spark, f"{state}/mark/batch={batch_id - 1}", "at_ms BIGINT")
    events = materialize(events.dropDuplicates(["is_request", "id"]), "pair-events")
    high = events.select("at_ms").union(seen).agg(F.coalesce(F.max("at_ms"), F.lit(0))).first()[0]
    mark = high - lateness * 1000

    requests, answers = match(events.where(~unreadable), timeout * 1000)
    answers = materialize(answers, "pair-answers")
    decided = materialize(requests.join(answers, ["key", "k"], "left").select("key", "request_id", "at_ms", "reply_id"), "pairs")
    over = F.col("reply_id").isNotNull() | (F.col("at_ms") + timeout * 1000 < mark)
    never = events.where(F.col("is_request") & unreadable).select(F.col("id").alias("request_id"), F.lit(None).cast("bigint").alias("reply_id"))
    decided.where(over).select("request_id", "reply_id").unionByName(never).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
    waiting = decided.where(~over).select(F.lit(True).alias("is_request"), F.col("request_id").alias("id"), "at_ms", "key")
    early = events.where(~F.col("is_request") & ~unreadable & (F.col("at_ms") >= mark)).join(answers.select(F.col("reply_id").alias("id")), "id", "left_anti")
    waiting.unionByName(early.select(*waiting.columns)).write.mode("overwrite").parquet(f"{state}/open/batch={batch_id}")
    spark.createDataFrame([(high,)], "at_ms BIGINT").coalesce(1).write.mode("overwrite").parquet(f"{state}/mark/batch={batch_id}")
    for folder in ("open", "mark"):  # this batch may be run again, the one before it no more
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{state}/{folder}/batch={batch_id - 2}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
