"""Trace lines and run recordings as JSON files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORDING_DOCUMENT = (
    "id STRING, startedAt STRING, durationMs BIGINT, params STRING, prodModel STRING, "
    "verdict STRING, summary STRING, eventCount BIGINT, "
    "events ARRAY<STRUCT<t: BIGINT, event: STRING, data: STRING>>"
)
HEADER = (
    "rec_id STRING, started_at STRING, duration_ms BIGINT, params STRING, model STRING, "
    "verdict STRING, summary STRING, event_count BIGINT"
)
EVENT = "rec_id STRING, t_ms BIGINT, event STRING, data STRING"


def parse_trace(lines: DataFrame, column: str = "line") -> DataFrame:
    """Typed trace events out of JSON lines; blank and unparsable lines are dropped.

    Columns already on the frame (who sent it, when, in what order) are kept.
    """
    doc = F.try_parse_json(F.col(column))

    def text(path: str):
        return F.try_variant_get(doc, path, "string")

    provider, model = text("$.message.provider"), text("$.message.model")
    kept = [F.col(c) for c in lines.columns if c != column]
    return lines.where(doc.isNotNull()).select(
        *kept,
        text("$.type").alias("type"),
        text("$.toolName").alias("tool_name"),
        F.coalesce(F.try_variant_get(doc, "$.isError", "boolean"), F.lit(False)).alias("is_error"),
        text("$.error").alias("error"),
        text("$.message.role").alias("role"),
        F.when(
            F.length(model) > 0,
            F.concat(F.when(F.length(provider) > 0, F.concat(provider, F.lit("/"))).otherwise(F.lit("")), model),
        ).alias("model"),
        F.to_json(F.try_variant_get(doc, "$.args", "variant")).alias("args"),
        F.to_json(F.try_variant_get(doc, "$.result", "variant")).alias("result"),
        F.to_json(F.try_variant_get(doc, "$.message", "variant")).alias("message"),
    )


def read_trace(spark: SparkSession, path: str) -> DataFrame:
    return parse_trace(spark.read.text(path).withColumnRenamed("value", "line"))


def write_recordings(headers: DataFrame, events: DataFrame, root: str) -> None:
    """Headers and events as JSON lines.

    One line per event, not one document per run: a run of any length is written by many tasks.
    """
    headers.write.mode("append").json(f"{root}/headers")
    events.write.mode("append").json(f"{root}/events")


def read_recordings(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Headers and events; lines that are not JSON are skipped."""
    headers = spark.read.schema(HEADER).option("mode", "DROPMALFORMED").json(f"{root}/headers")
    events = spark.read.schema(EVENT).option("mode", "DROPMALFORMED").json(f"{root}/events")
    return headers, events


def read_recording_documents(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Recordings kept as one JSON document per file; unreadable files are skipped."""
    docs = (
        spark.read.schema(RECORDING_DOCUMENT)
        .options(multiLine="true", mode="DROPMALFORMED")
        .json(path)
        .where(F.col("id").isNotNull())
    )
    headers = docs.select(
        F.col("id").alias("rec_id"), F.col("startedAt").alias("started_at"),
        F.col("durationMs").alias("duration_ms"), "params", F.col("prodModel").alias("model"),
        "verdict", "summary", F.col("eventCount").alias("event_count"),
    )
    events = docs.select(F.col("id").alias("rec_id"), F.explode("events").alias("e")).select(
        "rec_id", F.col("e.t").alias("t_ms"), F.col("e.event").alias("event"), F.col("e.data").alias("data")
    )
    return headers, events
