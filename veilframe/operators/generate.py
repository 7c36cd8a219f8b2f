"""A related bank dataset of any size, derived from customer ids.

Every value is a function of (seed, row key, column), so any partition can be made anywhere, again,
and alike. Row keys are built from the parent's key and the child's place, names are recomputed from
the customer id instead of being joined, and ids are dense positions along the row keys.
"""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.functions.text import luhn_check_digit
from veilframe.operators.ordered import positions
from veilframe.registry import ENTITY_ORDER, entity as lookup
from veilframe.session import materialize

# Merchants with their categories.
MERCHANTS = {
    "Amazon": "shopping", "Whole Foods": "groceries", "Shell": "fuel", "Netflix": "subscriptions",
    "Uber": "transport", "Starbucks": "dining", "Delta Air Lines": "travel", "CVS Pharmacy": "health",
    "Home Depot": "home", "Spotify": "subscriptions", "Target": "shopping", "Chipotle": "dining",
}
# Card brands with the first digits of their numbers.
BRANDS = (("visa", "4"), ("mastercard", "5"), ("amex", "37"))

FIRST_NAMES = (
    "Ada", "Ben", "Carla", "David", "Elena", "Felix", "Grace", "Hugo", "Ines", "Jonas",
    "Kira", "Liam", "Mona", "Noah", "Olga", "Pavel", "Rosa", "Simon", "Tara", "Viktor",
)
LAST_NAMES = (
    "Abbott", "Brandt", "Castro", "Dahl", "Evans", "Fischer", "Garcia", "Hansen", "Ivanov", "Jensen",
    "Keller", "Lopez", "Moreau", "Novak", "Olsen", "Petrov", "Quinn", "Rossi", "Silva", "Turner",
)
CITIES = (
    ("Austin", "TX"), ("Boston", "MA"), ("Chicago", "IL"), ("Denver", "CO"), ("Eugene", "OR"),
    ("Fresno", "CA"), ("Georgetown", "DE"), ("Houston", "TX"), ("Ithaca", "NY"), ("Juneau", "AK"),
)
STREETS = ("Oak St", "Main St", "Hill Rd", "Lake Ave", "Park Blvd", "River Rd", "Elm St", "Mill Ln")
MAIL_DOMAINS = ("mail.example.com", "post.example.org", "inbox.example.net")

DRAWN_DIGITS = 15  # hexadecimal
DAY = 86400
SIX_YEARS = 6 * 365 * DAY
MONTH = 30 * DAY


def draw(key: Column, seed: int, salt: int, n: Column | int) -> Column:
    """A repeatable number in [0, n): the first sixty bits of the MD5 of seed, key and salt, so no period is ever seen."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string"), F.lit(f":{salt}")))
    return F.conv(F.left(digest, F.lit(DRAWN_DIGITS)), 16, 10).cast("bigint") % n


def _pick(values: tuple, key: Column, seed: int, salt: int) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (draw(key, seed, salt, len(values)) + 1).cast("int"))


def _padded(key: Column, seed: int, salt: int, width: int) -> Column:
    return F.lpad(draw(key, seed, salt, 10**width).cast("string"), width, "0")


def _before(now: int, seconds: Column) -> Column:
    return F.timestamp_seconds(F.lit(now) - seconds)


def _children(df: DataFrame, n: Column, most: int, parent_key: str, key: str) -> DataFrame:
    """``n`` rows per parent, keyed ``parent_key * most + place``."""
    each = df.withColumn("_place", F.explode(F.sequence(F.lit(0), F.lit(most - 1))))
    return each.where(F.col("_place") < n).withColumn(key, F.col(parent_key) * most + F.col("_place")).drop("_place")


def customer_ids(spark: SparkSession, n: int, start: int = 0) -> DataFrame:
    """Ids of ``n`` new customers after ``start``."""
    return spark.range(start + 1, start + n + 1)


def generate_bank(
    ids: DataFrame, now: datetime, seed: int = 42, start: Mapping[str, int] | None = None
) -> dict[str, DataFrame]:
    """Customers with the given (unique, positive) ids and everything under them.

    ``start`` gives the highest id present per entity, for appends.
    """
    start = dict(start or {})
    epoch = int((now - datetime(1970, 1, 1)).total_seconds())
    cid = F.col("customer_id")

    first = _pick(FIRST_NAMES, cid, seed, 1)
    last = _pick(LAST_NAMES, cid, seed, 2)
    people = ids.select(F.col("id").alias("customer_id"))
    customers = people.select(
        cid.alias("id"),
        first.alias("first_name"),
        last.alias("last_name"),
        F.lower(F.concat(first, F.lit("."), last, F.lit("@"), _pick(MAIL_DOMAINS, cid, seed, 3))).alias("email"),
        F.concat_ws("-", _padded(cid, seed, 4, 3), _padded(cid, seed, 5, 3), _padded(cid, seed, 6, 4)).alias("phone"),
        F.concat_ws("-", _padded(cid, seed, 7, 3), _padded(cid, seed, 8, 2), _padded(cid, seed, 9, 4)).alias("ssn"),
        F.date_sub(_before(epoch, F.lit(0)).cast("date"), (draw(cid, seed, 10, 67 * 365) + 18 * 365 + 5).cast("int")).alias("date_of_birth"),
        _before(epoch, draw(cid, seed, 11, SIX_YEARS)).alias("created_at"),
    )

    key = F.col("_key")
    addresses = _numbered(_children(people, draw(cid, seed, 20, 2) + 1, 2, "customer_id", "_key"), "addresses", start)
    city = draw(key, seed, 24, len(CITIES))
    addresses = addresses.select(
        "id", "customer_id",
        F.concat((draw(key, seed, 21, 9999) + 1).cast("string"), F.lit(" "), _pick(STREETS, key, seed, 22)).alias("line1"),
        F.when(
            draw(key, seed, 23, 3) == 2,
            F.concat(F.lit("Apt "), (draw(key, seed, 26, 40) + 1).cast("string")),
        ).alias("line2"),
        F.element_at(F.array(*[F.lit(c) for c, _ in CITIES]), (city + 1).cast("int")).alias("city"),
        F.element_at(F.array(*[F.lit(s) for _, s in CITIES]), (city + 1).cast("int")).alias("state"),
        _padded(key, seed, 25, 5).alias("postal_code"),
        F.lit("US").alias("country"),
    )

    # keys are numbered before anything is derived from them, so that no values go through the sort
    accounts = _numbered(_children(people, draw(cid, seed, 30, 3) + 1, 3, "customer_id", "_key"), "accounts", start)
    accounts = materialize(accounts.select("id", "_key", "customer_id"), "accounts")
    status = draw(key, seed, 35, 5)
    accounts = accounts.select(
        "id", "_key", "customer_id",
        _padded(key, seed, 31, 9).alias("account_number"),
        _padded(key, seed, 32, 9).alias("routing_number"),
        _pick(("checking", "savings", "credit"), key, seed, 33).alias("account_type"),
        ((draw(key, seed, 34, 12_200_001) - 200_000).cast("decimal(20,0)") / 100).cast("decimal(14,2)").alias("balance"),
        F.lit("USD").alias("currency"),
        F.when(status < 3, "active").when(status == 3, "frozen").otherwise("closed").alias("status"),
        (MONTH + draw(key, seed, 36, SIX_YEARS - MONTH)).alias("_age"),
    )

    held = accounts.select(F.col("id").alias("account_id"), "customer_id", "_key", "_age")
    held = held.withColumnRenamed("_key", "_account")
    account = F.col("_account")

    cards = _numbered(_children(held, draw(account, seed, 40, 3), 2, "_account", "_key"), "cards", start)
    brand = draw(key, seed, 41, 3)
    prefix = F.element_at(F.array(*[F.lit(p) for _, p in BRANDS]), (brand + 1).cast("int"))
    number = F.left(F.concat(prefix, _padded(key, seed, 42, 7), _padded(key, seed, 43, 7)), F.lit(15))
    cards = cards.withColumn("_number", number).select(
        "id", "account_id",
        F.concat("_number", luhn_check_digit(F.col("_number")).cast("string")).alias("card_number"),
        F.upper(F.concat(first, F.lit(" "), last)).alias("cardholder_name"),
        F.element_at(F.array(*[F.lit(b) for b, _ in BRANDS]), (brand + 1).cast("int")).alias("brand"),
        (draw(key, seed, 44, 12) + 1).cast("smallint").alias("expiry_month"),
        (draw(key, seed, 45, 6) + 2026).cast("smallint").alias("expiry_year"),
        _padded(key, seed, 46, 3).alias("cvv"),
        F.when(draw(key, seed, 47, 3) < 2, "active").otherwise("frozen").alias("status"),
    )

    transactions = _numbered(_children(held, draw(account, seed, 50, 16) + 5, 20, "_account", "_key"), "transactions", start)
    merchant = draw(key, seed, 52, len(MERCHANTS))
    name = F.element_at(F.array(*[F.lit(m) for m in MERCHANTS]), (merchant + 1).cast("int"))
    category = F.element_at(F.array(*[F.lit(c) for c in MERCHANTS.values()]), (merchant + 1).cast("int"))
    transactions = transactions.select(
        "id", "account_id",
        _before(epoch, draw(key, seed, 51, F.col("_age") + 1)).alias("occurred_at"),
        ((draw(key, seed, 53, 119_851) + 150).cast("decimal(20,0)") / 100).cast("decimal(12,2)").alias("amount"),
        F.when(draw(key, seed, 54, 4) < 3, "debit").otherwise("credit").alias("direction"),
        name.alias("merchant"),
        category.alias("category"),
        F.concat(name, F.lit(" purchase")).alias("description"),
    )

    made = {
        "customers": customers,
        "addresses": addresses,
        "accounts": accounts.withColumn("opened_at", _before(epoch, F.col("_age"))),
        "cards": cards,
        "transactions": transactions,
    }
    return {name: made[name].select(*lookup(name).columns) for name in ENTITY_ORDER}


def _numbered(rows: DataFrame, name: str, start: Mapping[str, int]) -> DataFrame:
    """Dense ids along the row keys, after the highest id present."""
    return positions(rows, "_key", "_position").withColumn("id", F.col("_position") + start.get(name, 0))
