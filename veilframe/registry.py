"""Entity registry: the one place that knows columns, order, scope filters, parents and rules.

Reads project through it, masks are looked up by it, loads are validated against it, so the
raw side, the masked side and the message log cannot drift apart.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# The entities in foreign-key order.
ENTITY_ORDER = ("customers", "addresses", "accounts", "cards", "transactions")

# Enumerated domains.
ENUMS = {
    "account_type": ("checking", "savings", "credit"),
    "card_brand": ("visa", "mastercard", "amex"),
    "txn_direction": ("debit", "credit"),
    "entity_status": ("active", "frozen", "closed"),
}


@dataclass(frozen=True)
class Column:
    """One declared column: Spark type plus the constraints a load must respect."""

    name: str
    dtype: T.DataType
    sql_type: str
    nullable: bool = False
    enum: str | None = None
    char: int | None = None
    between: tuple[int, int] | None = None


@dataclass(frozen=True)
class Entity:
    name: str
    fields: tuple[Column, ...]
    filters: dict[str, str]
    parent: str | None = None
    parent_key: str | None = None

    @property
    def columns(self) -> list[str]:
        return [f.name for f in self.fields]

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(f.name, f.dtype, True) for f in self.fields])


def _key(name: str) -> Column:
    return Column(name, T.LongType(), "bigint")


def _text(name: str, nullable: bool = False) -> Column:
    return Column(name, T.StringType(), "text", nullable=nullable)


def _enum(name: str, enum: str) -> Column:
    return Column(name, T.StringType(), enum, enum=enum)


def _time(name: str) -> Column:
    return Column(name, T.TimestampType(), "timestamp with time zone")


def _money(name: str, precision: int) -> Column:
    return Column(name, T.DecimalType(precision, 2), "numeric")


def _small(name: str, between: tuple[int, int] | None = None) -> Column:
    return Column(name, T.ShortType(), "smallint", between=between)


ENTITIES: dict[str, Entity] = {
    "customers": Entity(
        "customers",
        (
            _key("id"), _text("first_name"), _text("last_name"), _text("email"), _text("phone"),
            _text("ssn"), Column("date_of_birth", T.DateType(), "date"), _time("created_at"),
        ),
        {"customer_id": "id"},
    ),
    "addresses": Entity(
        "addresses",
        (
            _key("id"), _key("customer_id"), _text("line1"), _text("line2", nullable=True),
            _text("city"), _text("state"), _text("postal_code"), _text("country"),
        ),
        {"customer_id": "customer_id"}, "customers", "customer_id",
    ),
    "accounts": Entity(
        "accounts",
        (
            _key("id"), _key("customer_id"), _text("account_number"), _text("routing_number"),
            _enum("account_type", "account_type"), _money("balance", 14),
            Column("currency", T.StringType(), "character(3)", char=3),
            _enum("status", "entity_status"), _time("opened_at"),
        ),
        {"customer_id": "customer_id"}, "customers", "customer_id",
    ),
    "cards": Entity(
        "cards",
        (
            _key("id"), _key("account_id"), _text("card_number"), _text("cardholder_name"),
            _enum("brand", "card_brand"), _small("expiry_month", (1, 12)), _small("expiry_year"),
            _text("cvv"), _enum("status", "entity_status"),
        ),
        {"account_id": "account_id"}, "accounts", "account_id",
    ),
    "transactions": Entity(
        "transactions",
        (
            _key("id"), _key("account_id"), _time("occurred_at"), _money("amount", 12),
            _enum("direction", "txn_direction"), _text("merchant"), _text("category"),
            _text("description", nullable=True),
        ),
        {"account_id": "account_id"}, "accounts", "account_id",
    ),
}

MESSAGE_SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("sender", T.StringType()),
        T.StructField("recipient", T.StringType()),
        T.StructField("body", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("consumed_at", T.TimestampType()),
    ]
)


def entity(name: str) -> Entity:
    """Look an entity up; an unknown name is an error, never a silent pass-through."""
    try:
        return ENTITIES[name]
    except KeyError:
        raise ValueError(f"Unknown entity: {name}") from None


def children_of(name: str) -> list[Entity]:
    return [e for e in ENTITIES.values() if e.parent == name]
