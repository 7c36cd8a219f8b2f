"""Reductions of agent traces and run recordings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.operators.ordered import ordered_scan

# Event types a trace keeps.
KEPT_TYPES = ("agent_start", "tool_execution_start", "tool_execution_end", "message_end", "agent_end", "error")


def trace_filter(events: DataFrame) -> DataFrame:
    """The event types that count; of messages only the assistant's."""
    return events.where(
        F.col("type").isin(*KEPT_TYPES) & ((F.col("type") != "message_end") | (F.col("role") == "assistant"))
    )


def is_fault():
    return (F.col("type") == "error") | F.col("is_error")


def trace_cycles(events: DataFrame, order: str = "seq") -> DataFrame:
    """Cycles of each agent: events, tool calls and faults from one start to the next.

    Events before an agent's first start are cycle 0.
    """
    start = F.when(F.col("type") == "agent_start", 1).otherwise(0).cast("bigint")
    numbered = ordered_scan(events, order, start, "cycle", keys=["agent"])
    return numbered.groupBy("agent", "cycle").agg(
        F.min(order).alias("first_seq"),
        F.max(order).alias("last_seq"),
        F.count(F.lit(1)).alias("events"),
        F.count_if(F.col("type") == "tool_execution_start").alias("tools"),
        F.count_if(is_fault()).alias("errors"),
        F.coalesce(F.bool_or(F.col("type") == "agent_end"), F.lit(False)).alias("ended"),
    )


def _answers(events: DataFrame) -> DataFrame:
    return events.where(
        (F.col("type") == "message_end") & (F.col("role") == "assistant") & F.col("model").isNotNull()
    )


def model_changes(events: DataFrame, order: str = "seq") -> DataFrame:
    """Answers whose model differs from the agent's answer before: (agent, seq, model, previous)."""
    answers = _answers(events).select("agent", order, "model")
    known = ordered_scan(answers, order, F.col("model"), "previous", keys=["agent"], kind="last", inclusive=False)
    return known.where(~F.col("model").eqNullSafe(F.col("previous")))


def agent_summary(events: DataFrame, messages: DataFrame, order: str = "seq") -> DataFrame:
    """Per agent: finished cycles (the producer's), replies handled (the consumer's), faults, model.

    The latest model is found by its sequence number, a plain maximum, and read by joining the few
    winners back, so no string is carried through the aggregation of a hot agent.
    """
    counts = events.groupBy("agent").agg(
        F.count_if((F.col("type") == "agent_end") & (F.col("agent") == "prod")).alias("cycles"),
        F.count_if(is_fault()).alias("errors"),
        F.max(
            F.when(
                (F.col("type") == "message_end") & (F.col("role") == "assistant") & F.col("model").isNotNull(),
                F.col(order),
            )
        ).alias(order),
    )
    models = _answers(events).select("agent", order, "model")
    latest = models.join(counts.select("agent", order), ["agent", order]).select("agent", "model")
    handled = (
        messages.where((F.col("recipient") == "test") & F.col("consumed_at").isNotNull())
        .groupBy(F.col("recipient").alias("agent"))
        .agg(F.count(F.lit(1)).alias("handled"))
    )
    return (
        counts.drop(order)
        .join(latest, "agent", "left")
        .join(handled, "agent", "left")
        .select("agent", "cycles", F.coalesce("handled", F.lit(0)).alias("handled"), "errors", "model")
    )


def recording_headers(events: DataFrame, facts: DataFrame) -> DataFrame:
    """Headers of recordings: what is known of each run, with its length and number of events."""
    size = events.groupBy("rec_id").agg(
        F.max("t_ms").alias("duration_ms"), F.count(F.lit(1)).alias("event_count")
    )
    return facts.join(size, "rec_id", "left").select(
        "rec_id", "started_at", F.coalesce("duration_ms", F.lit(0)).alias("duration_ms"), "params", "model",
        "verdict", "summary", F.coalesce("event_count", F.lit(0)).alias("event_count"),
    )
