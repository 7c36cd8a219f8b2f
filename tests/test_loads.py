from pyspark.sql import functions as F

from tests.conftest import rows
from veilframe.functions.masks import mask_table
from veilframe.operators import loads
from veilframe.registry import entity
from veilframe.sources.fixtures import bank_tables

GOOD = {
    "customer_id": "1", "account_number": "****1", "routing_number": "****2", "account_type": "savings", "balance": "1.50",
    "currency": "USD", "status": "active", "opened_at": "2024-01-01T00:00:00.000Z",
}


def accounts(spark, *changes):
    columns = entity("accounts").columns
    data = []
    for arrival, change in enumerate(changes):
        row = {**GOOD, **change}
        data.append((arrival, *[row.get(c) for c in columns]))
    return spark.createDataFrame(data, "arrival BIGINT, " + ", ".join(f"{c} STRING" for c in columns))


def test_every_row_is_decided(spark):
    incoming = accounts(
        spark,
        {"id": "10"}, {"id": "10"},                       # repeated in the batch
        {"id": "7"},                                      # present already
        {"id": "11", "customer_id": "99"},                # no parent
        {"id": "12", "status": None}, {"id": "13", "account_type": "loan"},
        {"id": "14", "balance": "1234567890123.00"}, {"id": "15", "currency": "USDX"},
        {"id": "x"}, {"id": "7", "customer_id": "99"},    # the conflict comes before the parent
        {"id": "16", "customer_id": "99"}, {"id": "16"},  # the first fails, the second gets in
        {"id": "17", "currency": "US"},
    )
    existing = spark.createDataFrame([(7,)], "id BIGINT")
    parents = spark.createDataFrame([(1,)], "id BIGINT")
    found = rows(loads.classify_load(incoming, existing, "accounts", "arrival", parents).select("arrival", "outcome", "reason"), "arrival")
    lost = "parent row missing (FK)"
    assert found == [
        (0, "inserted", None), (1, "conflict", None), (2, "conflict", None), (3, "skipped", lost),
        (4, "skipped", 'null value in column "status" of relation "accounts" violates not-null constraint'),
        (5, "skipped", 'invalid input value for enum account_type: "loan"'), (6, "skipped", "numeric field overflow"),
        (7, "skipped", "value too long for type character(3)"), (8, "skipped", 'invalid input syntax for type bigint: "x"'),
        (9, "conflict", None), (10, "skipped", lost), (11, "inserted", None), (12, "inserted", None),
    ]
    summary = loads.load_summary(loads.classify_load(incoming, existing, "accounts", "arrival", parents)).first()
    assert summary["received"] == summary["inserted"] + summary["conflicts"] + summary["skipped"] == 13


def test_expiry_month(spark):
    columns = entity("cards").columns
    row = ("1", "1", "x", "A", "visa", "13", "2027", "***", "active")
    report = loads.constraint_report(spark.createDataFrame([row], columns), "cards")
    assert "cards_expiry_month_check" in report.first()["reason"]


def test_insert_if_absent_takes_the_first(spark):
    incoming = accounts(spark, {"id": "1", "currency": "EUR"}, {"id": "1"}, {"id": "2"})
    typed = loads.constraint_report(incoming, "accounts")
    out = loads.insert_if_absent(typed, spark.createDataFrame([(2,)], "id BIGINT"), "accounts", "arrival")
    assert [(r["id"], r["currency"]) for r in out.collect()] == [(1, "EUR")]


def test_upsert_and_cascade(spark, sf_dir):
    tables = bank_tables(spark, sf_dir)
    raw = tables["customers"]
    masked = mask_table(raw, "customers")
    old = raw.where("id < 20").unionByName(raw.where("id = 1").withColumn("id", F.lit(10**9).cast("bigint")))
    new = loads.upsert(old, masked, "customers")
    assert new.count() == raw.count() + 1
    assert new.where("id < 20 AND ssn NOT LIKE '***-%'").count() == 0

    left = loads.cascade_delete(tables, "customers", raw.where("id <= 50").select("id"))
    accounts_left = left["accounts"]
    assert left["customers"].where("id <= 50").count() == 0
    assert accounts_left.where("customer_id <= 50").count() == 0
    for name in ("cards", "transactions"):
        assert loads.missing_parents(left[name], accounts_left, "account_id").count() == 0
