import datetime as dt

import pytest
from pyspark.sql import functions as F

from veilframe.functions import masks as M
from veilframe.functions import text as X
from veilframe.sources.fixtures import bank


def one(spark, value, mask):
    return spark.createDataFrame([(value,)], "v STRING").select(mask(F.col("v")).alias("m")).first()["m"]


def test_customer_row(spark):
    df = spark.createDataFrame(
        [("Demo", "Customer", "123-45-6789", "demo@example.com", "5551234567", "1990-05-17", "sensitive text")],
        "first_name STRING, last_name STRING, ssn STRING, email STRING, phone STRING, date_of_birth STRING, unexpected STRING",
    )
    row = M.mask_table(df, "customers").first().asDict()
    assert row == {
        "first_name": "Demo", "last_name": "C***", "ssn": "***-**-6789", "email": "d***@example.com",
        "phone": "***-***-4567", "date_of_birth": "1990-01-01", "unexpected": "sensitive text",
    }
    assert df.first()["ssn"] == "123-45-6789"


def test_card_row(spark):
    df = spark.createDataFrame([("4111111111111234", "123", "Demo Customer")], "card_number STRING, cvv STRING, cardholder_name STRING")
    assert tuple(M.mask_table(df, "cards").first()) == ("4111 **** **** 1234", "***", "Demo ***")


def test_transactions_and_unexpected_columns_pass(spark):
    df = spark.createDataFrame([(10, "sensitive text")], "amount INT, memo STRING")
    assert tuple(M.mask_table(df, "transactions").first()) == (10, "sensitive text")


def test_unknown_entity(spark):
    with pytest.raises(ValueError, match="Unknown entity"):
        M.mask_table(spark.range(1), "not-a-table")


def test_strict_is_a_firewall(spark):
    df = spark.createDataFrame([(1, "x")], "id BIGINT, memo STRING")
    row = M.mask_table(df, "customers", strict=True).first().asDict()
    assert "memo" not in row
    assert (row["phone"], row["last_name"], row["email"]) == ("***-***-", "***", "***@***")
    assert row["date_of_birth"] == dt.date(1900, 1, 1)


@pytest.mark.parametrize(
    "mask, value, expected",
    [
        (M.mask_surname, None, "***"), (M.mask_surname, "", "***"), (M.mask_surname, "Z", "Z***"),
        (M.mask_email, "a@b@c", "a***@b"), (M.mask_email, "@x", "***@***"), (M.mask_email, "x@", "***@***"), (M.mask_email, None, "***@***"),
        (M.mask_phone, "12", "***-***-**"), (M.mask_phone, "", "***-***-"), (M.mask_phone, "1234", "***-***-****"), (M.mask_phone, "12345", "***-***-2345"),
        (M.mask_ssn, "12", "***-**-12"), (M.mask_ssn, "", "***-**-****"), (M.mask_ssn, None, "***-**-****"),
        (M.presence_mask, "", None), (M.presence_mask, None, None), (M.presence_mask, "Apt 3", "***"),
        (M.mask_postal, "9", "9***"), (M.mask_postal, None, "***"),
        (M.mask_card, "1234567", "**** **** **** ****"), (M.mask_card, "4111-1111", "4111 **** **** 1111"),
        (M.mask_holder, " LEAD", " ***"), (M.mask_holder, "A B", "A ***"), (M.mask_holder, "A\u0085B C", "A\u0085B ***"), (M.mask_holder, "", "*** ***"),
        (M.mask_holder, "\U0001f600 X", "\U0001f600 ***"), (M.digits, "١a1-2", "12"), (M.redact_line, None, "**** [redacted]"),
        (M.year_only, "2001-02-03", dt.date(2001, 1, 1)), (M.year_only, "soon", dt.date(1900, 1, 1)), (M.year_only, None, dt.date(1900, 1, 1)),
    ],
)
def test_edges(spark, mask, value, expected):
    assert one(spark, value, mask) == expected


def test_tail(spark):
    assert one(spark, "12-34", lambda c: M.tail(c, 4)) == "****"
    assert one(spark, "123456", lambda c: M.tail(c, 4)) == "**3456"


def test_types_are_kept(spark, sf_dir):
    for name in M.MASKS:
        raw = bank(spark, sf_dir, name)
        kept = {f.name: f.dataType for f in M.mask_table(raw, name).schema}
        assert kept == {f.name: f.dataType for f in raw.schema}


def test_sql_functions_agree(spark, sf_dir):
    M.register_sql_masks(spark)
    cards = bank(spark, sf_dir, "cards")
    both = cards.select(
        M.mask_card(F.col("card_number")).alias("a"), F.call_function("mask_card", F.col("card_number")).alias("b"),
        M.mask_holder(F.col("cardholder_name")).alias("c"), F.call_function("mask_holder", F.col("cardholder_name")).alias("d"),
    )
    assert both.where("a <> b OR c <> d").count() == 0


def test_views_hold_masked_rows_only(spark, sf_dir):
    M.masked_only_views({"customers": bank(spark, sf_dir, "customers").withColumn("memo", F.lit("x"))}, prefix="t_")
    view = spark.table("t_customers")
    assert "memo" not in view.columns
    assert view.where("ssn NOT LIKE '***-**-%'").count() == 0


@pytest.mark.parametrize("ms, expected", [(0, "0.0s"), (150, "0.1s"), (250, "0.3s"), (350, "0.3s"), (450, "0.5s"), (59999, "60.0s"), (60000, "1m 0s"), (125500, "2m 6s")])
def test_format_ms(spark, ms, expected):
    assert spark.range(1).select(X.format_ms(F.lit(ms).cast("bigint")).alias("t")).first()["t"] == expected


def test_url_and_clip(spark):
    assert one(spark, "postgresql://u:p@h/db", X.redact_url_credentials) == "postgresql://…@h/db"
    assert one(spark, "http://h/x", X.redact_url_credentials) == "http://h/x"
    assert one(spark, "abcdef", lambda c: X.clip(c, 4)) == "abcd …(+2 chars)"


def test_canonical_json(spark):
    assert one(spark, '{"b":{"d":1,"c":[2,{"z":1,"y":2}]},"a":5.0}', X.canonical_json) == '{"a":5,"b":{"c":[2,{"y":2,"z":1}],"d":1}}'
    assert one(spark, "{broken", X.canonical_json) is None


def test_replay_speed(spark):
    with pytest.raises(ValueError):
        X.replay_offset(F.lit(1), 3)
