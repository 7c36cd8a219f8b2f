"""Scoped, paged and masked reads; request validation; inbox and retention reads."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.functions.masks import JS_WHITESPACE, mask_table
from veilframe.functions.text import REQUEST_KEYS
from veilframe.registry import ENTITY_ORDER, entity as lookup

# Read limits.
DEFAULT_LIMIT = 10
MAX_REQUEST_ROWS = 500
MAX_LOCAL_ROWS = 200
# How much is kept.
HISTORY_KEEP = 500
TRACE_KEEP = 300
LOG_KEEP = 200
RECORDINGS_KEEP = 30
# Lines of a seeding log that show a raw sample.
RAW_SAMPLE = "Sample customer|ssn="


def scope_filter(df: DataFrame, entity: str, params: Mapping[str, object]) -> DataFrame:
    """Equality on the entity's own scope column; other scope parameters are ignored.

    NULL and '' count as absent. Only registry filter columns can be filtered on, so a filter can
    not probe a sensitive column.
    """
    for param, column in lookup(entity).filters.items():
        value = params.get(param)
        if value is not None and value != "":
            df = df.where(F.col(column) == F.lit(value).cast("bigint"))
    return df


def ignored_params(entity: str, params: Mapping[str, object]) -> list[str]:
    """Scope parameters that were given but do not apply to the entity."""
    own = lookup(entity).filters
    return [
        p for p in ("customer_id", "account_id")
        if params.get(p) not in (None, "") and p not in own
    ]


def since_filter(df: DataFrame, since_id: int | None) -> DataFrame:
    return df if since_id is None else df.where(F.col("id") > since_id)


def clamp_limit(limit: Column, default: int = DEFAULT_LIMIT, most: int = MAX_REQUEST_ROWS) -> Column:
    return F.least(F.greatest(F.coalesce(limit, F.lit(default)), F.lit(1)), F.lit(most))


def _clamped(limit: int | None, most: int) -> int:
    return min(max(DEFAULT_LIMIT if limit is None else limit, 1), most)


def first_n_by_id(df: DataFrame, n: int) -> DataFrame:
    return df.orderBy("id").limit(n)


def query_masked(
    df: DataFrame,
    entity: str,
    limit: int | None = None,
    customer_id: int | None = None,
    account_id: int | None = None,
    since_id: int | None = None,
) -> DataFrame:
    """The masked read: scope, then first rows by id, then mask what is returned and nothing else."""
    rows = df.select(*lookup(entity).columns)
    rows = scope_filter(rows, entity, {"customer_id": customer_id, "account_id": account_id})
    rows = first_n_by_id(since_filter(rows, since_id), _clamped(limit, MAX_REQUEST_ROWS))
    return mask_table(rows, entity)


def query_local(df: DataFrame, entity: str, limit: int | None = None) -> DataFrame:
    """First rows by id of a masked-side entity, at most 200."""
    return first_n_by_id(df.select(*lookup(entity).columns), _clamped(limit, MAX_LOCAL_ROWS))


# Non-negative whole numbers as JSON or text may carry them: plain digits, hexadecimal, or with an exponent.
WHOLE_NUMBER = r"^[+]?0*([0-9]{1,19})([.]0*)?$"
HEX_NUMBER = r"^0[xX]0*([0-9a-fA-F]{1,16})$"
EXPONENT_NUMBER = r"^[+]?([0-9]+[.]?[0-9]*|[.][0-9]+)[eE][+-]?[0-9]{1,3}$"


def whole_number(text: Column) -> Column:
    """The number a text stands for, NULL where it is none, not whole, negative or beyond 64 bits."""
    bare = F.regexp_replace(text, f"^[{JS_WHITESPACE}]+|[{JS_WHITESPACE}]+$", "")
    scientific = F.when(bare.rlike(EXPONENT_NUMBER), bare).try_cast("decimal(38,18)")
    return F.coalesce(
        F.regexp_extract(bare, WHOLE_NUMBER, 1).try_cast("bigint"),
        F.conv(F.nullif(F.regexp_extract(bare, HEX_NUMBER, 1), F.lit("")), 16, 10).try_cast("bigint"),
        F.when(scientific == F.floor(scientific), scientific).try_cast("bigint"),
    )


def clean_request(requests: DataFrame, body: str = "body") -> DataFrame:
    """Validate a table of request bodies.

    Adds ``entity``, the four numbers, ``request`` (what would be sent on) and ``error`` (the first
    thing wrong, NULL when clean). NULL, '' and unknown keys are dropped; numbers may come as text.
    The body is parsed once per row.
    """
    doc = F.col("_doc")
    raw = {key: F.try_variant_get(doc, f"$.{key}", "string") for key in REQUEST_KEYS}
    name = F.try_variant_get(doc, "$.entity", "string")
    opened = requests.withColumn("_doc", F.try_parse_json(F.col(body)))
    read = opened.select(
        *requests.columns,
        F.when(name.isin(*ENTITY_ORDER), name).alias("entity"),
        *[raw[key].alias(f"_{key}") for key in REQUEST_KEYS],
        *[whole_number(raw[key]).alias(key) for key in REQUEST_KEYS],
    )
    errors = [F.when(F.col("entity").isNull(), F.lit(f"entity must be one of {', '.join(ENTITY_ORDER)}"))]
    for key in REQUEST_KEYS:
        bad = (F.col(f"_{key}") != "") & F.col(key).isNull()
        errors.append(F.when(bad, F.lit(f"{key} must be a non-negative integer")))
    # least and greatest skip NULL: an absent limit stays absent
    limit = F.when(
        F.col("limit").isNotNull(), F.least(F.greatest("limit", F.lit(1)), F.lit(MAX_REQUEST_ROWS))
    )
    checked = read.select(
        *requests.columns, "entity", limit.alias("limit"), "customer_id", "account_id", "since_id",
        F.coalesce(*errors).alias("error"),
    )
    request = F.to_json(F.struct("entity", *REQUEST_KEYS))
    return checked.withColumn("request", F.when(F.col("error").isNull(), request))


def pending(messages: DataFrame, recipient: str) -> DataFrame:
    """Unread messages for a recipient."""
    return messages.where((F.col("recipient") == recipient) & F.col("consumed_at").isNull())


def pending_counts(messages: DataFrame) -> DataFrame:
    """(recipient, pending): unread messages of each recipient that has any."""
    unread = messages.where(F.col("consumed_at").isNull())
    return unread.groupBy("recipient").agg(F.count(F.lit(1)).alias("pending"))


def next_unread(messages: DataFrame) -> DataFrame:
    """The oldest unread message of each recipient.

    One row per recipient and task crosses the shuffle; no other body does.
    """
    unread = messages.where(F.col("consumed_at").isNull())
    oldest = unread.groupBy("recipient").agg(F.min_by(F.struct(*messages.columns), "id").alias("m"))
    return oldest.select("m.*")


def scrub_log_lines(lines: DataFrame, column: str = "line") -> DataFrame:
    """Drop blank lines and lines that show a raw sample."""
    text = F.col(column)
    return lines.where((F.length(F.regexp_replace(text, f"[{JS_WHITESPACE}]+", "")) > 0) & ~text.rlike(RAW_SAMPLE))


def keep_last(df: DataFrame, n: int, order: str = "id") -> DataFrame:
    """The newest ``n`` rows: what a bounded log retains."""
    return df.orderBy(F.desc(order)).limit(n)


def history(messages: DataFrame, n: int = HISTORY_KEEP) -> DataFrame:
    """The newest messages, oldest first."""
    return keep_last(messages, n).orderBy("id")


def list_recordings(headers: DataFrame) -> DataFrame:
    """Headers, newest first, without events."""
    return headers.drop("events").orderBy(F.desc("started_at"), F.desc("rec_id"))


def retain_recordings(headers: DataFrame, keep: int = RECORDINGS_KEEP) -> DataFrame:
    """Mark each recording kept (the newest by id) or dropped.

    The border is the lowest kept id, one value read from a top-k, so no full sort is needed.
    """
    newest = headers.select("rec_id").orderBy(F.desc("rec_id")).limit(keep)
    border = newest.agg(F.min("rec_id")).scalar()
    return headers.withColumn("kept", F.col("rec_id") >= border)
