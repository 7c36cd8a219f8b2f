"""Column masks as native expressions, the per-entity dispatch and SQL registration.

Every mask treats NULL, missing and '' alike where the rule says so, never raises on dirty
input and returns a value that still fits the column it came from.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilframe.registry import entity as lookup

# Whitespace as the ECMAScript \s class defines it. Java's own \s is ASCII only and
# its Unicode variant adds U+0085, so the class is spelled out.
JS_WHITESPACE = (
    r" \t\n\x0B\f\r\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
)
REDACTED_LINE = "**** [redacted]"
HIDDEN = "***"
HIDDEN_CARD = "**** **** **** ****"


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def _present(c: Column) -> Column:
    return F.length(c.cast("string")) > 0


def digits(c: Column) -> Column:
    """Only the ASCII digits; NULL becomes ''."""
    return F.regexp_replace(_text(c), "[^0-9]", "")


def tail(c: Column, keep: int) -> Column:
    """Star every digit but the last ``keep``; all stars when there are no more than that."""
    d = digits(c)
    n = F.length(d)
    stars = F.lit("*")
    return F.when(n <= keep, F.repeat(stars, n)).otherwise(
        F.concat(F.repeat(stars, n - keep), F.right(d, F.lit(keep)))
    )


def _last_four(c: Column) -> Column:
    """The last four characters of ``tail(c, 4)`` without building the starred prefix."""
    d = digits(c)
    n = F.length(d)
    return F.when(n <= 4, F.repeat(F.lit("*"), n)).otherwise(F.right(d, F.lit(4)))


def mask_surname(c: Column) -> Column:
    return F.concat(F.substring(_text(c), 1, 1), F.lit(HIDDEN))


def mask_email(c: Column) -> Column:
    """Initial and domain; anything without a name and a domain around its first '@' is hidden."""
    name = F.split_part(_text(c), F.lit("@"), F.lit(1))
    domain = F.split_part(_text(c), F.lit("@"), F.lit(2))
    return F.when(
        (F.length(name) > 0) & (F.length(domain) > 0),
        F.concat(F.substring(name, 1, 1), F.lit("***@"), domain),
    ).otherwise(F.lit("***@***"))


def mask_phone(c: Column) -> Column:
    return F.concat(F.lit("***-***-"), _last_four(c))


def mask_ssn(c: Column) -> Column:
    """Last four digits, or as many as there are: a short value is shown, unlike in a phone."""
    last = F.right(digits(c), F.lit(4))
    return F.concat(F.lit("***-**-"), F.coalesce(F.nullif(last, F.lit("")), F.lit("****")))


def year_only(c: Column) -> Column:
    """First of January of the year; unparsable or NULL becomes 1900-01-01."""
    return F.coalesce(F.trunc(c.try_cast("date"), "year"), F.lit("1900-01-01").cast("date"))


def redact_line(c: Column) -> Column:
    return F.lit(REDACTED_LINE)


def presence_mask(c: Column) -> Column:
    """'***' where there was something, NULL where there was nothing."""
    return F.when(_present(c), F.lit(HIDDEN))


def mask_postal(c: Column) -> Column:
    return F.concat(F.substring(_text(c), 1, 2), F.lit(HIDDEN))


def mask_account_no(c: Column) -> Column:
    return F.concat(F.lit("****"), _last_four(c))


def mask_card(c: Column) -> Column:
    d = digits(c)
    return F.when(
        F.length(d) >= 8,
        F.concat(F.left(d, F.lit(4)), F.lit(" **** **** "), F.right(d, F.lit(4))),
    ).otherwise(F.lit(HIDDEN_CARD))


def mask_holder(c: Column) -> Column:
    """First whitespace-separated token; a leading space gives an empty one."""
    first = F.regexp_extract(c.cast("string"), f"^[^{JS_WHITESPACE}]*", 0)
    return F.when(_present(c), F.concat(first, F.lit(" ***"))).otherwise(F.lit("*** ***"))


def constant_mask(c: Column) -> Column:
    return F.lit(HIDDEN)


def pass_through(c: Column) -> Column:
    return c


MASKS: dict[str, dict[str, Callable[[Column], Column]]] = {
    "customers": {
        "last_name": mask_surname,
        "email": mask_email,
        "phone": mask_phone,
        "ssn": mask_ssn,
        "date_of_birth": year_only,
    },
    "addresses": {"line1": redact_line, "line2": presence_mask, "postal_code": mask_postal},
    "accounts": {"account_number": mask_account_no, "routing_number": mask_account_no},
    "cards": {
        "card_number": mask_card,
        "cardholder_name": mask_holder,
        "cvv": constant_mask,
    },
    "transactions": {},
}


def mask_table(df: DataFrame, entity: str, strict: bool = False) -> DataFrame:
    """Apply an entity's masks in one projection.

    Columns the registry does not know stay as they are: masking is not a schema firewall.
    ``strict`` is the firewall: exactly the registry columns, absent ones added as NULL and then
    masked, everything else dropped.
    """
    ent = lookup(entity)
    if strict:
        known = set(df.columns)
        df = df.select(
            *[
                F.col(f.name) if f.name in known else F.lit(None).cast(f.dtype).alias(f.name)
                for f in ent.fields
            ]
        )
    masked = {}
    for name, mask in MASKS[entity].items():
        if name in df.columns:
            value = mask(F.col(name))
            # a date that arrived as text leaves as text
            if mask is year_only and isinstance(df.schema[name].dataType, T.StringType):
                value = value.cast("string")
            masked[name] = value
    return df.withColumns(masked) if masked else df


def masked_only_views(
    frames: dict[str, DataFrame], prefix: str = "masked_"
) -> dict[str, DataFrame]:
    """Register masked, strictly projected views of every entity and nothing raw."""
    out = {}
    for name, df in frames.items():
        out[name] = mask_table(df, name, strict=True)
        out[name].createOrReplaceTempView(f"{prefix}{name}")
    return out


# SQL bodies of the same rules, for sessions that mask from SQL text.
_SQL_DIGITS = "regexp_replace(coalesce(x, ''), '[^0-9]', '')"
_SQL_LAST_FOUR = (
    f"CASE WHEN length({_SQL_DIGITS}) <= 4 THEN repeat('*', length({_SQL_DIGITS})) "
    f"ELSE right({_SQL_DIGITS}, 4) END"
)
SQL_MASKS: dict[str, tuple[str, str]] = {
    "mask_digits": ("STRING", _SQL_DIGITS),
    "mask_surname": ("STRING", "left(coalesce(x, ''), 1) || '***'"),
    "mask_email": (
        "STRING",
        "CASE WHEN split_part(x, '@', 1) <> '' AND split_part(x, '@', 2) <> '' "
        "THEN left(x, 1) || '***@' || split_part(x, '@', 2) ELSE '***@***' END",
    ),
    "mask_phone": ("STRING", f"'***-***-' || {_SQL_LAST_FOUR}"),
    "mask_ssn": (
        "STRING",
        f"'***-**-' || coalesce(nullif(right({_SQL_DIGITS}, 4), ''), '****')",
    ),
    "mask_year_only": (
        "DATE",
        "coalesce(trunc(try_cast(x AS DATE), 'year'), DATE '1900-01-01')",
    ),
    "mask_line": ("STRING", f"'{REDACTED_LINE}'"),
    "mask_presence": ("STRING", "CASE WHEN length(x) > 0 THEN '***' END"),
    "mask_postal": ("STRING", "left(coalesce(x, ''), 2) || '***'"),
    "mask_account_no": ("STRING", f"'****' || {_SQL_LAST_FOUR}"),
    "mask_card": (
        "STRING",
        f"CASE WHEN length({_SQL_DIGITS}) >= 8 THEN left({_SQL_DIGITS}, 4) || ' **** **** ' "
        f"|| right({_SQL_DIGITS}, 4) ELSE '{HIDDEN_CARD}' END",
    ),
    "mask_holder": (
        "STRING",
        f"CASE WHEN length(x) > 0 THEN regexp_extract(x, r'^[^{JS_WHITESPACE}]*', 0) || ' ***' "
        "ELSE '*** ***' END",
    ),
    "mask_constant": ("STRING", "'***'"),
}


def register_sql_masks(spark: SparkSession) -> list[str]:
    """Create a temporary SQL function per mask. Catalyst inlines them: no Python, no UDF call."""
    for name, (returns, body) in SQL_MASKS.items():
        spark.sql(
            f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(x STRING) RETURNS {returns} RETURN {body}"
        )
    return list(SQL_MASKS)
