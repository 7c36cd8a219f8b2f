"""Counts, watermarks, leak scans, mask-pattern audits and the transfer verdict."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.functions.masks import HIDDEN, HIDDEN_CARD, REDACTED_LINE
from veilframe.functions.text import has_raw_identifier, json_rows_len
from veilframe.registry import ENTITY_ORDER

# What a masked value looks like, as the audit checks it. (?s) and \z make '.' and the
# end of the value mean what they mean in the database that defines the patterns.
PATTERNS: dict[str, dict[str, str]] = {
    "customers": {
        "ssn": r"(?s)^\*{3}-\*{2}-[0-9]{4}\z",
        "email": r"(?s)^.\*{3}@",
        "last_name": r"(?s)^.\*{3}\z",
        "phone": r"(?s)^\*{3}-\*{3}-[0-9]{4}\z",
    },
    "accounts": {
        "account_number": r"(?s)^\*{4}[0-9]{4}\z",
        "routing_number": r"(?s)^\*{4}[0-9]{4}\z",
    },
    "cards": {"card_number": r"(?s)^[0-9]{4} \*{4} \*{4} [0-9]{4}\z"},
}
CONSTANTS: dict[str, dict[str, str]] = {
    "cards": {"cvv": HIDDEN},
    "addresses": {"line1": REDACTED_LINE},
}
# The audit of all thirteen columns, which also accepts what a mask makes of a short or empty value.
FULL_PATTERNS: dict[str, dict[str, str]] = {
    "customers": {
        "ssn": r"^\*{3}-\*{2}-([0-9]{1,4}|\*{4})\z",
        "email": r"(?s)^(.\*{3}@[^@]+|\*{3}@\*{3})\z",
        "last_name": r"(?s)^.?\*{3}\z",
        "phone": r"^\*{3}-\*{3}-([0-9]{4}|\*{0,4})\z",
    },
    "addresses": {
        "line1": r"^\*{4} \[redacted\]\z",
        "line2": r"^\*{3}\z",
        "postal_code": r"(?s)^.{0,2}\*{3}\z",
    },
    "accounts": {
        "account_number": r"^\*{4}([0-9]{4}|\*{0,4})\z",
        "routing_number": r"^\*{4}([0-9]{4}|\*{0,4})\z",
    },
    "cards": {
        "card_number": r"^([0-9]{4} \*{4} \*{4} [0-9]{4}|\*{4} \*{4} \*{4} \*{4})\z",
        "cardholder_name": r"^([^\s]* \*{3}|\*{3} \*{3})\z",
        "cvv": r"^\*{3}\z",
    },
}
# The checks of a transfer.
CHECKS = (
    "every request got a reply",
    "nothing left unread on the bus",
    "no raw SSN or card number crossed the wire",
    "test holds the same row counts as prod",
    "every sensitive column in test is masked",
)
AUDITED = ("customers", "accounts", "cards", "addresses")


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def watermark(df: DataFrame) -> DataFrame:
    """The highest id, 0 for an empty table: one row."""
    return df.agg(F.coalesce(F.max("id"), F.lit(0)).alias("watermark"))


def entity_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(entity, n), one row per table."""
    return _union(
        [tables[e].agg(F.count(F.lit(1)).alias("n")).select(F.lit(e).alias("entity"), "n") for e in ENTITY_ORDER]
    )


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """One row, one count per entity."""
    return entity_counts(tables).agg(*[F.sum(F.when(F.col("entity") == e, F.col("n"))).alias(e) for e in ENTITY_ORDER])


def count_diff(raw: DataFrame | dict, masked: DataFrame | dict) -> DataFrame:
    """Per entity: rows on both sides, whether they are equal, and 'name masked/raw'."""
    sides = [
        entity_counts(raw).select("entity", F.col("n").alias("raw_rows"), F.lit(0).alias("masked_rows")),
        entity_counts(masked).select("entity", F.lit(0).alias("raw_rows"), F.col("n").alias("masked_rows")),
    ]
    both = _union(sides).groupBy("entity").agg(
        F.sum("raw_rows").alias("raw_rows"), F.sum("masked_rows").alias("masked_rows")
    )
    return both.withColumns(
        {
            "equal": F.col("raw_rows") == F.col("masked_rows"),
            "detail": F.format_string("%s %d/%d", "entity", "masked_rows", "raw_rows"),
        }
    )


def bus_aggregates() -> list[Column]:
    """Every bus figure, to be computed in one pass over the log."""
    sender, body = F.col("sender"), F.col("body")
    return [
        F.count(F.lit(1)).alias("messages"),
        F.count_if(sender == "test").alias("requests"),
        F.count_if(sender == "prod").alias("replies"),
        F.count_if(F.col("consumed_at").isNull()).alias("pending"),
        F.coalesce(F.sum(F.when(sender == "prod", json_rows_len(body)).otherwise(0)), F.lit(0)).alias("rows_shipped"),
        F.count_if(has_raw_identifier(body)).alias("leaks"),
    ]


def bus_stats(messages: DataFrame) -> DataFrame:
    return messages.agg(*bus_aggregates())


def leak_count(texts: DataFrame, column: str = "body") -> DataFrame:
    return texts.agg(F.count_if(has_raw_identifier(F.col(column))).alias("leaks"))


def leak_rows(texts: DataFrame, key: str, column: str) -> DataFrame:
    """Keys of the texts that hold a raw identifier."""
    return texts.where(has_raw_identifier(F.col(column))).select(key)


def _unmasked(entity: str) -> Column:
    """NULL never counts: a comparison with NULL is not true."""
    tests = [~F.col(c).rlike(p) for c, p in PATTERNS.get(entity, {}).items()]
    tests += [F.col(c) != v for c, v in CONSTANTS.get(entity, {}).items()]
    return reduce(Column.__or__, tests)


def mask_audit(masked: dict[str, DataFrame]) -> DataFrame:
    """Per audited table: rows with a value outside the reference's nine patterns."""
    return _union(
        [
            masked[e].agg(F.count(F.lit(1)).alias("rows_checked"), F.count_if(_unmasked(e)).alias("unmasked"))
            .select(F.lit(e).alias("entity"), "rows_checked", "unmasked")
            for e in AUDITED
        ]
    )


def mask_audit_full(masked: dict[str, DataFrame]) -> DataFrame:
    """Per sensitive column, all thirteen: rows that no mask could have produced."""
    frames = []
    for e, patterns in FULL_PATTERNS.items():
        tests = {c: ~F.col(c).rlike(p) for c, p in patterns.items()}
        if e == "customers":
            dob = F.col("date_of_birth")
            tests["date_of_birth"] = (F.month(dob) != 1) | (F.dayofmonth(dob) != 1)
        one_pass = masked[e].agg(*[F.count_if(t).alias(c) for c, t in tests.items()])
        frames.append(
            one_pass.unpivot([], list(tests), "column_name", "unmasked").select(
                F.lit(e).alias("entity"), "column_name", "unmasked"
            )
        )
    return _union(frames)


def verify_transfer(
    messages: DataFrame, raw: dict[str, DataFrame], masked: dict[str, DataFrame]
) -> DataFrame:
    """The five checks of a transfer: (check_no, name, ok, detail).

    Each source is reduced to a few figures in one pass; the figures, some twenty rows, are then
    put side by side and judged.
    """
    stats = bus_stats(messages).select("requests", "replies", "pending", "leaks")
    figures = _union(
        [
            stats.unpivot([], stats.columns, "figure", "n"),
            entity_counts(raw).select(F.concat(F.lit("raw_"), "entity").alias("figure"), "n"),
            *[
                masked[e].agg(F.count(F.lit(1)).alias("n")).select(F.lit(f"masked_{e}").alias("figure"), "n")
                for e in ENTITY_ORDER if e not in AUDITED
            ],
            # the audit counts the rows it looks at, so the masked side is scanned once
            mask_audit(masked).select(
                F.inline(
                    F.array(
                        F.struct(F.concat(F.lit("masked_"), "entity").alias("figure"), F.col("rows_checked").alias("n")),
                        F.struct(F.concat(F.lit("bad_"), "entity").alias("figure"), F.col("unmasked").alias("n")),
                    )
                )
            ),
        ]
    )
    names = ["requests", "replies", "pending", "leaks"]
    names += [f"{side}_{e}" for side in ("raw", "masked") for e in ENTITY_ORDER]
    names += [f"bad_{e}" for e in AUDITED]
    one = figures.agg(*[F.sum(F.when(F.col("figure") == n, F.col("n"))).alias(n) for n in names])

    def text(name: str) -> Column:
        return F.col(name).cast("string")

    def all_of(conditions: list[Column]) -> Column:
        return reduce(Column.__and__, conditions)

    same = all_of([F.col(f"raw_{e}") == F.col(f"masked_{e}") for e in ENTITY_ORDER])
    counts = F.concat_ws(
        ", ", *[F.concat(F.lit(f"{e} "), text(f"masked_{e}"), F.lit("/"), text(f"raw_{e}")) for e in ENTITY_ORDER]
    )
    clean = all_of([F.col(f"bad_{e}") == 0 for e in AUDITED])
    faults = F.concat_ws(
        ", ", *[F.when(F.col(f"bad_{e}") > 0, F.concat(text(f"bad_{e}"), F.lit(f" unmasked {e}"))) for e in AUDITED]
    )
    checked = F.concat(
        F.concat_ws(", ", *[F.concat(text(f"masked_{e}"), F.lit(f" {e}")) for e in AUDITED]), F.lit(" checked")
    )
    verdicts = [
        (
            (F.col("requests") > 0) & (F.col("requests") == F.col("replies")),
            F.concat(text("requests"), F.lit(" requests / "), text("replies"), F.lit(" replies")),
        ),
        (F.col("pending") == 0, F.concat(text("pending"), F.lit(" pending"))),
        (F.col("leaks") == 0, F.concat(text("leaks"), F.lit(" leak(s)"))),
        (same, counts),
        (clean, F.when(clean, checked).otherwise(faults)),
    ]
    checks = F.array(
        *[
            F.struct(
                F.lit(i + 1).alias("check_no"), F.lit(CHECKS[i]).alias("name"), ok.alias("ok"), detail.alias("detail")
            )
            for i, (ok, detail) in enumerate(verdicts)
        ]
    )
    return one.select(F.inline(checks))


def verdict(checks: DataFrame) -> DataFrame:
    """'pass' when every check holds, with the failing ones named."""
    failing = F.sort_array(F.collect_list(F.when(~F.col("ok"), F.struct("check_no", "name", "detail"))))
    named = F.transform(failing, lambda c: F.concat(c["name"], F.lit(" ("), c["detail"], F.lit(")")))
    return checks.agg(
        F.when(F.every("ok"), F.lit("pass")).otherwise(F.lit("fail")).alias("verdict"),
        F.count(F.lit(1)).alias("n_checks"),
        F.array_join(named, "; ").alias("failed"),
    )


def seed_summary(tables: dict[str, DataFrame]) -> DataFrame:
    """Per table: rows and the range of their ids."""
    return _union(
        [
            tables[e].agg(
                F.count(F.lit(1)).alias("new_rows"), F.min("id").alias("min_id"), F.max("id").alias("max_id")
            ).select(F.lit(e).alias("entity"), "new_rows", "min_id", "max_id")
            for e in ENTITY_ORDER
        ]
    )
