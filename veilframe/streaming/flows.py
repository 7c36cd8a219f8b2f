"""Continuous copy, answering, loading, pairing and monitoring.

Every sink is keyed by a stable id, so a batch that is replayed after a failure writes nothing
twice. Late replies are still loaded; only the pairing view, which models a waiting requester, has
a time limit.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.readwriter import DataStreamWriter

from veilframe.functions.masks import mask_table
from veilframe.operators.audit import bus_aggregates, row_counts
from veilframe.operators.bus import REPLY_ID_BASE, answer_requests, load_replies, reply_messages, summarize_loads
from veilframe.operators.loads import MISSING_PARENT, accepted, constraint_report, decide_load
from veilframe.operators.traces import is_fault, trace_filter
from veilframe.plans.retention import retain_batches
from veilframe.registry import ENTITY_ORDER, MESSAGE_SCHEMA, entity as lookup
from veilframe.session import materialize
from veilframe.sources.bus_tail import tail
from veilframe.sources.messages import append_messages, mark_read, normalise_messages
from veilframe.sources.position_index import PositionIndex
from veilframe.sources.snapshots import SnapshotStore
from veilframe.sources.traces import parse_trace
from veilframe.streaming.cycles import cycle_batch
from veilframe.streaming.pairing import pair_batch

# Seconds between automatic copies and how long a requester waits.
DEFAULT_INTERVAL = 60
MIN_INTERVAL = 10
MAX_INTERVAL = 3600
REPLY_TIMEOUT = 180
PATIENCE = 86_400  # seconds that a child waits for its parent
REPLY_LATENESS = 60  # seconds that a message may come after later ones


# The tables to answer from, or a function that opens them anew for each batch.
Tables = Mapping[str, DataFrame] | Callable[[], Mapping[str, DataFrame]]


def _triggered(writer: DataStreamWriter, interval: int | None) -> DataStreamWriter:
    """Every ``interval`` seconds, clamped; None takes what is there and stops."""
    if interval is None:
        return writer.trigger(availableNow=True)
    seconds = min(max(interval, MIN_INTERVAL), MAX_INTERVAL)
    return writer.trigger(processingTime=f"{seconds} seconds")


def _start(
    stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, interval: int | None
) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return _triggered(writer, interval).start()


def within(rows: DataFrame, batch: DataFrame, key: str, of: str = "id") -> DataFrame:
    """The rows whose ``of`` lies in the range of the batch's keys: the bound prunes files, however long the history."""
    low, high = batch.agg(F.min(key), F.max(key)).first()
    return rows.where(F.col(of).between(low, high)) if low is not None else rows.limit(0)


def _left_over(spark: SparkSession, folder: str, batch_id: int, schema: str) -> DataFrame:
    """What the batch before left below ``folder``."""
    try:
        return spark.read.schema(schema).parquet(f"{folder}/batch={batch_id - 1}")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _still_in_time(patience: int) -> Column:
    return F.unix_seconds(F.col("_since")) > F.unix_seconds(F.current_timestamp()) - patience


def copy_batch(
    batch: DataFrame, entity: str, store: SnapshotStore, rejects: str | None = None, batch_id: int = 0,
    waiting: str | None = None, patience: int = PATIENCE,
) -> None:
    """Append the rows of a batch that the masked copy lacks, that keep its rules and whose parent it has.

    Of rows that share an id the first that may be loaded stays. With a ``waiting`` folder, masked rows whose parent
    has not come are tried again with each batch for ``patience`` seconds. What is skipped for good goes, with its
    reason, to ``rejects``; a replayed batch writes its own folders there again.
    """
    ent = lookup(entity)
    store.refresh()
    rows = mask_table(batch.select(*ent.columns), entity).withColumn("_since", F.current_timestamp())
    if waiting and batch_id:
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ent.schema) + ", _since TIMESTAMP"
        rows = _left_over(batch.sparkSession, waiting, batch_id, schema).unionByName(rows)
    report = materialize(constraint_report(rows.withColumn("_arrival", F.monotonically_increasing_id()), entity), "stream-rows")
    parents = within(store.read(ent.parent), report, ent.parent_key) if ent.parent else None
    decided = materialize(decide_load(report, within(store.read(entity), report, "id"), entity, "_arrival", parents), "stream-load")
    store.append(entity, accepted(decided, entity))
    skipped = decided.where(F.col("outcome") == "skipped")
    if waiting:
        early = (F.col("reason") == MISSING_PARENT) & _still_in_time(patience)
        skipped = materialize(skipped.withColumn("_early", early), "stream-skipped")
        skipped.where("_early").select(*ent.columns, "_since").write.mode("overwrite").parquet(f"{waiting}/batch={batch_id}")
        skipped = skipped.where("NOT _early")
        retain_batches(batch.sparkSession, waiting)
    if rejects:
        skipped.select(*ent.columns, "reason").write.mode("overwrite").parquet(f"{rejects}/batch={batch_id}")


def stream_masked_copy(
    stream: DataFrame, entity: str, store: SnapshotStore, checkpoint: str, interval: int | None = DEFAULT_INTERVAL,
    rejects: str | None = None, waiting: str | None = None, patience: int = PATIENCE,
) -> StreamingQuery:
    """Continuous masked append of an entity's new rows. Rows that wait and rows that are rejected are kept beside the
    checkpoint unless folders are named."""
    beside = checkpoint.rstrip("/")
    rejects, waiting = rejects or f"{beside}-rejects", waiting or f"{beside}-waiting"
    return _start(stream, lambda batch, n: copy_batch(batch, entity, store, rejects, n, waiting, patience), checkpoint, interval)


def _existing_messages(batch: DataFrame, path: str) -> DataFrame:
    spark = batch.sparkSession
    try:
        return spark.read.schema(MESSAGE_SCHEMA).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MESSAGE_SCHEMA)


def answer_batch(
    batch: DataFrame, tables: Tables, replies: str, recipient: str = "prod", marks: str | None = None, index: PositionIndex | None = None
) -> None:
    """Answer the requests of a batch once each, also one that was delivered twice.

    The reply's id follows from the request's. ``tables``, where it is a function, is called for each
    batch, so that rows written since the stream began are found. An ``index`` is brought up to date by
    the files written since, so that a batch reads what it asks for and not all ids above its lowest mark.
    """
    requests = normalise_messages(batch.where(F.col("recipient") == recipient)).dropDuplicates(["id"])
    requests = materialize(requests, "stream-requests")
    written = within(_existing_messages(batch, replies), requests.select((F.col("id") + REPLY_ID_BASE).alias("id")), "id")
    fresh = requests.join(written.select((F.col("id") - REPLY_ID_BASE).alias("id")), "id", "left_anti")
    answers = answer_requests(fresh, tables() if callable(tables) else tables, index=index)
    append_messages(reply_messages(answers, F.current_timestamp()), replies)
    if marks:
        mark_read(requests, marks)


def stream_answer(
    messages: DataFrame, tables: Tables, replies: str, checkpoint: str,
    interval: int | None = DEFAULT_INTERVAL, marks: str | None = None, index: PositionIndex | None = None,
) -> StreamingQuery:
    """The producer: every request addressed to it gets one masked reply, and is marked as read in ``marks``."""
    return _start(messages, lambda batch, _: answer_batch(batch, tables, replies, marks=marks, index=index), checkpoint, interval)


def load_batch(
    batch: DataFrame, store: SnapshotStore, log: str | None = None, batch_id: int = 0, marks: str | None = None, patience: int = PATIENCE
) -> None:
    """Load the ok replies of a batch, parents first.

    With a ``log`` folder, each batch leaves there what became of every reply (``report``), and the replies
    with a child whose parent has not come yet (``waiting``), which the next batches try again: rows
    that are there by then only count as conflicts. After ``patience`` seconds a reply is tried no more and its rows
    without a parent are named in ``given_up``.
    """
    spark = batch.sparkSession
    store.refresh()
    replies = normalise_messages(batch.where(F.col("sender") == "prod"))
    kept = spark.createDataFrame([], "id BIGINT, _since TIMESTAMP")
    if log and batch_id:
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in MESSAGE_SCHEMA) + ", _since TIMESTAMP"
        left = _left_over(spark, f"{log}/waiting", batch_id, schema)
        kept = left.select("id", "_since")
        replies = replies.unionByName(left.drop("_since")).dropDuplicates(["id"])
    replies = materialize(replies, "stream-replies")
    decided = load_replies(replies, store.read_all())
    for name in ENTITY_ORDER:
        store.append(name, accepted(decided[name], name))
    if marks:
        mark_read(replies, marks)
    if log:
        summarize_loads(decided, "reply_id").write.mode("overwrite").parquet(f"{log}/report/batch={batch_id}")
        early = reduce(DataFrame.unionByName, [
            d.where(F.col("reason") == MISSING_PARENT).select(F.col("reply_id"), F.lit(name).alias("entity"), F.col("id").cast("string").alias("row_id"))
            for name, d in decided.items()
        ])
        early = materialize(early.join(kept.withColumnRenamed("id", "reply_id"), "reply_id", "left").withColumn("_since", F.coalesce("_since", F.current_timestamp())), "stream-early")
        in_time = early.where(_still_in_time(patience))
        early.where(~_still_in_time(patience)).select("reply_id", "entity", "row_id").write.mode("overwrite").parquet(f"{log}/given_up/batch={batch_id}")
        again = replies.join(in_time.groupBy(F.col("reply_id").alias("id")).agg(F.min("_since").alias("_since")), "id").select(*replies.columns, "_since")
        again.write.mode("overwrite").parquet(f"{log}/waiting/batch={batch_id}")
        retain_batches(spark, f"{log}/waiting")


def stream_load(
    messages: DataFrame, store: SnapshotStore, checkpoint: str, interval: int | None = DEFAULT_INTERVAL, log: str | None = None,
    marks: str | None = None, patience: int = PATIENCE,
) -> StreamingQuery:
    """The consumer: replies become rows of the masked copy. Late replies count like any other. The log of loads is kept
    beside the checkpoint unless a folder is named."""
    log = log or f"{checkpoint.rstrip('/')}-loads"
    return _start(messages, lambda batch, n: load_batch(batch, store, log, n, marks, patience), checkpoint, interval)


def stream_pairing(
    messages: DataFrame, out: str, checkpoint: str, timeout: int = REPLY_TIMEOUT, interval: int | None = DEFAULT_INTERVAL,
    state: str | None = None, lateness: int = REPLY_LATENESS,
) -> StreamingQuery:
    """Each request once: with the reply that came within the timeout, or with NULL once it is over.

    Requests and echoes meet under the digest of their canonical JSON. Among identical ones the oldest open request
    gets the next echo, so a reply answers one request. What is open is kept below ``state``, beside ``out`` by default.
    """
    kept = state or f"{out.rstrip('/')}-open"
    return _start(messages, lambda batch, n: pair_batch(batch, kept, out, n, timeout, lateness), checkpoint, interval)


def close_pairing(emitted: DataFrame, requests: DataFrame) -> DataFrame:
    """Stop waiting: requests the stream has not decided yet stay without a reply."""
    waiting = requests.where(F.col("sender") == "test").select(F.col("id").alias("request_id"))
    left = waiting.join(emitted, "request_id", "left_anti")
    return emitted.select("request_id", "reply_id").unionByName(left.withColumn("reply_id", F.lit(None).cast("bigint")))


def stream_changes(
    spark: SparkSession, log: str, marks: str, out: str, checkpoint: str, interval: int | None = DEFAULT_INTERVAL
) -> StreamingQuery:
    """Follow the bus: each batch's changes (``tail``) in a folder of its own below ``out``, written again if it is run again."""
    def each(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return _start(tail(spark, log, marks), each, checkpoint, interval)


def live_bus_stats(messages: DataFrame) -> DataFrame:
    """Running counters of the log, leaks included: one row in complete mode."""
    return messages.agg(*bus_aggregates())


def _keep_latest(stats: DataFrame, out: str, checkpoint: str, interval: int | None) -> StreamingQuery:
    """Write a small running result after each batch, as one file in the batch's own folder below ``out``; older ones go."""
    def each(batch: DataFrame, batch_id: int) -> None:
        batch.coalesce(1).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        retain_batches(batch.sparkSession, out)

    writer = stats.writeStream.outputMode("complete").foreachBatch(each).option("checkpointLocation", checkpoint)
    return _triggered(writer, interval).start()


def latest(spark: SparkSession, out: str) -> DataFrame:
    """The running result after the last batch."""
    kept = spark.read.parquet(out)
    return kept.where(F.col("batch") == kept.agg(F.max("batch")).scalar()).drop("batch")


def stream_leak_monitor(messages: DataFrame, out: str, checkpoint: str, interval: int | None = DEFAULT_INTERVAL) -> StreamingQuery:
    """Keep the counters, a single row, in a shared folder."""
    return _keep_latest(live_bus_stats(messages), out, checkpoint, interval)


def stream_counts(
    ticks: DataFrame, tables: Callable[[], Mapping[str, DataFrame]], out: str, checkpoint: str,
    interval: int | None = DEFAULT_INTERVAL,
) -> StreamingQuery:
    """Append row counts of the entities with the time they were taken, once per batch.

    A replayed batch overwrites its own folder.
    """
    def each(batch: DataFrame, batch_id: int) -> None:
        snapshot = row_counts(dict(tables())).withColumn("at", F.current_timestamp())
        snapshot.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return _start(ticks, each, checkpoint, interval)


def live_trace_stats(lines: DataFrame) -> DataFrame:
    """Per agent: events, finished cycles, tool calls, faults and the model that answered last."""
    events = trace_filter(parse_trace(lines))
    answer = (F.col("type") == "message_end") & F.col("model").isNotNull()
    return events.groupBy("agent").agg(
        F.count(F.lit(1)).alias("events"),
        F.count_if(F.col("type") == "agent_end").alias("cycles"),
        F.count_if(F.col("type") == "tool_execution_start").alias("tools"),
        F.count_if(is_fault()).alias("errors"),
        F.max_by("model", F.when(answer, F.col("seq"))).alias("model"),
    )


def stream_trace(lines: DataFrame, out: str, checkpoint: str, interval: int | None = DEFAULT_INTERVAL) -> StreamingQuery:
    """Keep the counters, one row per agent, in a shared folder."""
    return _keep_latest(live_trace_stats(lines), out, checkpoint, interval)


def stream_cycles(lines: DataFrame, state: str, out: str, checkpoint: str, interval: int | None = DEFAULT_INTERVAL) -> StreamingQuery:
    """Follow traces: cycles that end and changes of the model, in a folder a batch below ``out``."""
    return _start(lines, lambda batch, n: cycle_batch(parse_trace(batch), state, out, n), checkpoint, interval)
