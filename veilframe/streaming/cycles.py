"""Cycles of agents and changes of their model, batch by batch, with what is still open in a table on the shared folder.

    <state>/open/batch=7       per agent: the cycle under way, its figures so far, and the model that answered last
    <out>/cycles/batch=7       the cycles that ended in the batch: the next one had begun
    <out>/models/batch=7       the answers with another model than the one before

A batch is reduced to cycles by the same scan as a whole trace (``trace_cycles``), which splits an agent with very many
events over tasks; what a keyed state machine would see event by event is one row an agent here. The first part of a batch
goes on with the open cycle, the others are numbered after it. Events come in order of ``seq`` from batch to batch, as
an agent writes them. A batch that is run again reads what the one before it left and writes the same.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.operators.traces import model_changes, trace_cycles
from veilframe.session import materialize

CYCLE = "agent STRING, cycle BIGINT, first_seq BIGINT, last_seq BIGINT, events BIGINT, tools BIGINT, errors BIGINT, ended BOOLEAN"
OPEN = f"{CYCLE}, seen_at TIMESTAMP, model STRING, model_seq BIGINT"
CHANGE = "agent STRING, seq BIGINT, model STRING, previous STRING"


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def cycle_batch(events: DataFrame, state: str, out: str, batch_id: int) -> None:
    """Take a batch of parsed events into the cycles and models of their agents."""
    spark = events.sparkSession
    events = materialize(events.select("agent", "seq", "seen_at", "type", "role", "is_error", "model"), "cycle-events")
    before = materialize(_read(spark, f"{state}/open/batch={batch_id - 1}", OPEN) if batch_id else spark.createDataFrame([], OPEN), "cycles-open")

    # counted within the batch, where 0 is what goes on; then after the cycle under way
    fresh = trace_cycles(events).join(before.select("agent", F.col("cycle").alias("under_way")), "agent", "left")
    fresh = fresh.withColumn("cycle", F.col("cycle") + F.coalesce("under_way", F.lit(0))).drop("under_way")
    columns = ["agent", "cycle", "first_seq", "last_seq", "events", "tools", "errors", "ended"]
    cycles = fresh.select(*columns).unionByName(before.select(*columns)).groupBy("agent", "cycle").agg(
        F.min("first_seq").alias("first_seq"), F.max("last_seq").alias("last_seq"),
        *[F.sum(c).cast("bigint").alias(c) for c in ("events", "tools", "errors")], F.bool_or("ended").alias("ended"),
    )
    cycles = materialize(cycles, "cycles")
    last = cycles.groupBy("agent").agg(F.max("cycle").alias("cycle"))
    cycles.join(last, ["agent", "cycle"], "left_anti").select(*columns).write.mode("overwrite").parquet(f"{out}/cycles/batch={batch_id}")

    answered = F.col("model").isNotNull() & (F.col("type") == "message_end") & (F.col("role") == "assistant")
    # the model a batch begins with stands before all its answers, whose numbers make room for it
    first = before.where(F.col("model").isNotNull()).select(
        "agent", F.lit(0).cast("bigint").alias("seq"), F.lit("message_end").alias("type"), F.lit("assistant").alias("role"), "model"
    )
    answers = events.where(answered).select("agent", (F.col("seq") + 1).alias("seq"), "type", "role", "model").unionByName(first)
    changes = model_changes(answers).where(F.col("seq") > 0).select("agent", (F.col("seq") - 1).alias("seq"), "model", "previous")
    changes.write.mode("overwrite").parquet(f"{out}/models/batch={batch_id}")

    # a plain maximum finds the last answer; only the winners are joined back
    newest = events.groupBy("agent").agg(F.max("seen_at").alias("seen_now"), F.max(F.when(answered, F.col("seq"))).alias("seq"))
    models = events.where(answered).select("agent", "seq", F.col("model").alias("model_now")).join(newest.select("agent", "seq"), ["agent", "seq"], "left_semi")
    newest = newest.join(models, ["agent", "seq"], "left").select("agent", "seen_now", "model_now", F.col("seq").alias("seq_now"))
    held = before.select("agent", "seen_at", "model", "model_seq")
    under_way = cycles.join(last, ["agent", "cycle"], "left_semi").join(held, "agent", "left").join(newest, "agent", "left")
    under_way.select(
        *columns, F.coalesce("seen_now", "seen_at").alias("seen_at"), F.coalesce("model_now", "model").alias("model"), F.coalesce("seq_now", "model_seq").alias("model_seq")
    ).write.mode("overwrite").parquet(f"{state}/open/batch={batch_id}")
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{state}/open/batch={batch_id - 2}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def open_cycles(spark: SparkSession, state: str) -> DataFrame:
    """The cycle under way of each agent, with the time of its last event and the model that answered last."""
    kept = _read(spark, f"{state}/open", f"{OPEN}, batch INT")
    return kept.where(F.col("batch") == kept.agg(F.max("batch")).scalar()).drop("batch")


def all_cycles(spark: SparkSession, state: str, out: str) -> DataFrame:
    """Every cycle, ended or under way, as ``trace_cycles`` gives them for the whole trace."""
    columns = ["agent", "cycle", "first_seq", "last_seq", "events", "tools", "errors", "ended"]
    return _read(spark, f"{out}/cycles", CYCLE).select(*columns).unionByName(open_cycles(spark, state).select(*columns))


def all_model_changes(spark: SparkSession, out: str) -> DataFrame:
    return _read(spark, f"{out}/models", CHANGE).select("agent", "seq", "model", "previous")


def idle_agents(spark: SparkSession, state: str, seconds: int) -> DataFrame:
    """The cycles under way that have had no event for so long, by the latest event of any agent."""
    under_way = open_cycles(spark, state)
    latest = under_way.agg(F.max("seen_at")).scalar()
    return under_way.where(F.unix_micros(latest) - F.unix_micros("seen_at") > seconds * 1_000_000)
