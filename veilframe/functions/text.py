"""Scalar helpers: JSON, leak detection, formatting, check digits, trace summaries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilframe.functions.masks import JS_WHITESPACE

# Shapes of raw identifiers, unanchored, as the leak check defines them.
SSN_SHAPE = "[0-9]{3}-[0-9]{2}-[0-9]{4}"
CARD_SHAPE = "[0-9]{16}"
# Keys a request may carry besides its entity, in order.
REQUEST_KEYS = ("limit", "customer_id", "account_id", "since_id")
# Replay speeds.
REPLAY_SPEEDS = (1, 2, 5, 10, 20)


def canonical_json(c: Column) -> Column:
    """JSON with sorted keys at every depth; malformed input gives NULL."""
    return F.to_json(F.try_parse_json(c))


def json_rows_len(body: Column) -> Column:
    """Length of ``rows`` when it is an array, else 0."""
    rows = F.get_json_object(body, "$.rows")
    return F.coalesce(F.json_array_length(rows), F.lit(0)).cast("bigint")


def has_raw_identifier(text: Column) -> Column:
    """True where text holds a dashed SSN or a run of sixteen digits."""
    return text.rlike(SSN_SHAPE) | text.rlike(CARD_SHAPE)


def redact_url_credentials(url: Column) -> Column:
    """Hide what stands between '//' and the last '@' of the line."""
    # replaces the first match only: '^' pins it and the lazy prefix finds the first '//'
    return F.regexp_replace(url, "^(?s)(.*?)//(?-s).*@", "$1//…@")


def format_ms(ms: Column) -> Column:
    """'12.3s' below a minute, '4m 5s' from there on."""
    # One decimal of the *binary* quotient, as a double prints it: 0.15 is a little less than its
    # tie and rounds down, 0.25 is exact and rounds up. The sign of the exact remainder decides;
    # splitting the quotient into a float and a rest keeps every product below exact.
    x = ms.cast("double") / 1000.0
    hi = x.cast("float").cast("double")
    k = F.floor(ms / 100)
    remainder = (hi * 20.0 - (2 * k + 1).cast("double")) + (x - hi) * 20.0
    up = (ms % 100 > 50) | ((ms % 100 == 50) & (remainder >= 0))
    tenths = k + F.when(up, 1).otherwise(0)
    short = F.concat(
        F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit("s")
    )
    long = F.concat(
        F.floor(ms / 60000).cast("string"), F.lit("m "),
        F.floor((ms % 60000 + 500) / 1000).cast("string"), F.lit("s"),
    )
    return F.when(ms < 60000, short).otherwise(long)


def clip(text: Column, n: int) -> Column:
    """Keep ``n`` characters and say how many were cut."""
    s = F.coalesce(text, F.lit(""))
    size = F.length(s)
    return F.when(
        size > n,
        F.concat(
            F.substring(s, 1, n), F.lit(" …(+"), (size - n).cast("string"), F.lit(" chars)")
        ),
    ).otherwise(s)


def luhn_check_digit(first15: Column) -> Column:
    """The sixteenth digit that makes a number pass the Luhn check."""
    total = F.lit(0)
    for i in range(1, 16):
        d = F.substring(first15, i, 1).cast("int")
        if i % 2:  # counted from the right, the first of fifteen digits is doubled
            d = d * 2
            d = F.when(d > 9, d - 9).otherwise(d)
        total = total + d
    return (10 - total % 10) % 10


def replay_offset(t_ms: Column, speed: int) -> Column:
    """Where an event lies when a recording is replayed ``speed`` times as fast."""
    if speed not in REPLAY_SPEEDS:
        raise ValueError(f"speed must be one of {', '.join(map(str, REPLAY_SPEEDS))}")
    return t_ms.cast("double") / F.lit(float(speed))


def scope_text(body: Column) -> Column:
    """A request's known parameters as 'k=v k=v', without its entity."""
    request = F.try_parse_json(body)
    parts = []
    for key in REQUEST_KEYS:
        value = F.try_variant_get(request, f"$.{key}", "string")
        parts.append(F.when(value.isNotNull(), F.concat(F.lit(f"{key}="), value)))
    return F.concat_ws(" ", *parts)


def run_summary_text(
    verdict: Column, n_checks: Column, duration_ms: Column, reason: Column, aborted: Column
) -> Column:
    """One line for a run: PASS with checks and duration, FAIL with the reason, or ABORTED."""
    took = format_ms(duration_ms)
    return (
        F.when(aborted, F.concat(F.lit("ABORTED by the user after "), took))
        .when(
            verdict == "pass",
            F.concat_ws(" · ", F.lit("PASS"), F.concat(n_checks.cast("string"), F.lit(" checks")), took),
        )
        .otherwise(F.concat_ws(" · ", F.lit("FAIL"), reason))
    )


def summarize_tool_result(result: Column) -> Column:
    """A tool result (JSON text) in one line."""
    r = F.try_parse_json(result)
    details = F.try_variant_get(r, "$.details", "variant")

    def text(path: str) -> Column:
        return F.try_variant_get(r, path, "string")

    count_kind = F.schema_of_variant(F.try_variant_get(r, "$.details.count", "variant"))
    to, sender = text("$.details.to"), text("$.details.from")
    message_id = text("$.details.id")
    body = F.to_json(F.try_variant_get(r, "$.details.body", "variant"))
    pieces = F.try_variant_get(r, "$.content", "array<variant>")
    texts = F.filter(pieces, lambda p: F.try_variant_get(p, "$.type", "string") == "text")
    first_text = F.try_variant_get(F.get(texts, F.lit(0)), "$.text", "string")

    def truthy(c: Column) -> Column:
        return F.coalesce(~c.isin("", "0", "false"), F.lit(False))

    has_details = details.isNotNull()
    return (
        F.when(
            has_details & count_kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"),
            F.concat(text("$.details.count"), F.lit(" row(s) [masked]")),
        )
        .when(
            has_details & truthy(message_id) & truthy(to),
            F.concat(F.lit("message #"), message_id, F.lit(" → "), to),
        )
        .when(
            has_details & sender.isNotNull() & body.isNotNull(),
            F.concat(
                F.lit("message #"), F.coalesce(message_id, F.lit("undefined")), F.lit(" from "), sender,
                F.lit(": "), clip(body, 300),
            ),
        )
        .when(has_details & truthy(text("$.details.empty")), F.lit("no message (idle)"))
        .otherwise(clip(F.coalesce(first_text, F.to_json(r), result), 300))
    )


def message_parts(message: Column, kind: str) -> Column:
    """The non-blank 'thinking' or 'text' pieces of a message (JSON text), in order."""
    if kind not in ("thinking", "text"):
        raise ValueError("kind must be thinking or text")
    content = F.try_variant_get(F.try_parse_json(message), "$.content", "array<variant>")

    def piece_type(p: Column) -> Column:
        return F.try_variant_get(p, "$.type", "string")

    def own(p: Column) -> Column:
        return piece_type(p).isin("thinking", "reasoning") if kind == "thinking" else piece_type(p) == "text"

    def value(p: Column) -> Column:
        plain = F.try_variant_get(p, "$.text", "string")
        if kind == "text":
            return plain
        return F.coalesce(F.try_variant_get(p, "$.thinking", "string"), plain)

    values = F.transform(F.filter(content, own), value)
    kept = F.filter(values, lambda s: F.length(F.regexp_replace(s, f"[{JS_WHITESPACE}]+", "")) > 0)
    return F.coalesce(kept, F.array().cast("array<string>"))
