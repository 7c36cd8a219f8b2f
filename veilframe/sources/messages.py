"""The message log: an append-only table of JSON documents between two parties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.operators.ordered import positions
from veilframe.registry import MESSAGE_SCHEMA


def read_messages(spark: SparkSession, path: str, stream: bool = False, **options) -> DataFrame:
    reader = (spark.readStream if stream else spark.read).schema(MESSAGE_SCHEMA).options(**options)
    return normalise_messages(reader.parquet(path))


MARK_SCHEMA = "id BIGINT, consumed_at TIMESTAMP"


def mark_read(messages: DataFrame, marks: str) -> None:
    """Note that messages have been read. The log of marks is append-only; noting it twice does no harm."""
    messages.select("id", F.current_timestamp().alias("consumed_at")).write.mode("append").parquet(marks)


def with_marks(messages: DataFrame, marks: str) -> DataFrame:
    """Messages with the time of their first mark, where they carry none themselves."""
    read = messages.sparkSession.read.schema(MARK_SCHEMA).parquet(marks)
    first = read.groupBy("id").agg(F.min("consumed_at").alias("_read_at"))
    joined = messages.join(first, "id", "left")
    return joined.withColumn("consumed_at", F.coalesce("consumed_at", "_read_at")).select(*messages.columns)


def normalise_messages(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in MESSAGE_SCHEMA])


def parse_body(messages: DataFrame) -> DataFrame:
    """Typed request and reply fields of a body. Malformed JSON gives NULLs, never an error.

    Ids may travel as JSON strings, so every number is read through a variant cast.
    """
    body = F.try_parse_json(F.col("body"))

    def field(path: str, kind: str) -> Column:
        return F.try_variant_get(body, path, kind)

    return messages.withColumns(
        {
            "entity": field("$.entity", "string"),
            "limit": field("$.limit", "bigint"),
            "customer_id": field("$.customer_id", "bigint"),
            "account_id": field("$.account_id", "bigint"),
            "since_id": field("$.since_id", "bigint"),
            "ok": field("$.ok", "boolean"),
            "error": field("$.error", "string"),
            "echo": F.to_json(field("$.echo", "variant")),
            "n_rows": F.size(F.coalesce(field("$.rows", "array<variant>"), F.array().cast("array<variant>"))).cast("bigint"),
        }
    )


def send_messages(
    log: DataFrame, bodies: DataFrame, sender: str, recipient: str, order: str, created_at: Column
) -> DataFrame:
    """New log rows for ``bodies`` (a ``body`` column); ids continue from the log's highest.

    ``order`` is a unique bigint column that fixes the order in which ids are given.
    """
    last = log.agg(F.coalesce(F.max("id"), F.lit(0))).scalar()
    numbered = positions(bodies, order, out="position")
    return numbered.select(
        (last + F.col("position")).alias("id"),
        F.lit(sender).alias("sender"),
        F.lit(recipient).alias("recipient"),
        F.col("body"),
        created_at.cast("timestamp").alias("created_at"),
        F.lit(None).cast("timestamp").alias("consumed_at"),
    )


def append_messages(messages: DataFrame, path: str) -> None:
    """Bodies repeat the names of their columns in every row: zstd takes half the room of the default."""
    normalise_messages(messages).write.mode("append").parquet(path, compression="zstd")
