import json
import random

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from veilframe.functions.masks import mask_table
from veilframe.operators import bus, reads
from veilframe.registry import entity
from veilframe.sources.fixtures import bank_tables
from veilframe.sources.messages import parse_body, send_messages

LOG = "id BIGINT, sender STRING, recipient STRING, body STRING, created_at TIMESTAMP, consumed_at TIMESTAMP"


def message(spark, *records):
    full = [(i, s, "prod" if s == "test" else "test", b, None, None) for i, s, b in records]
    return spark.createDataFrame(full, LOG).withColumn("created_at", F.timestamp_seconds("id"))


def test_pairing_by_kth_occurrence(spark):
    ask = '{"entity":"cards","limit":5}'
    log = message(
        spark, (1, "test", ask), (2, "test", '{"limit":5,"entity":"cards"}'), (3, "prod", '{"ok":true,"rows":[],"echo":{"limit":5,"entity":"cards"}}'),
        (4, "prod", '{"ok":true,"rows":[],"echo":' + ask + "}"), (5, "test", ask), (6, "test", "{broken"), (7, "test", '{"entity":"accounts"}'),
        (8, "prod", '{"ok":true}'),
    )
    assert rows(bus.pair_requests(log).select("request_id", "reply_id", "round_trip_ms"), "request_id") == [
        (1, 3, 2000), (2, 4, 2000), (5, None, None), (6, None, None), (7, None, None)
    ]


def test_reset_is_seen(spark):
    before = message(spark, (8, "test", "{}"), (9, "test", "{}"))
    after = message(spark, (1, "test", "{}"))
    assert rows(bus.bus_changes(before, after).select("change", "id"), "change") == [("message", 1), ("reset", None)]


def test_bodies_are_read_through_variants(spark):
    parsed = parse_body(message(spark, (1, "test", '{"entity":"cards","since_id":"3"}'), (2, "test", "nope"), (3, "test", "[1]")))
    assert rows(parsed.select("id", "entity", "since_id"), "id") == [(1, "cards", 3), (2, None, None), (3, None, None)]


@pytest.mark.parametrize(
    "body, limit, error",
    [
        ('{"entity":"cards","limit":0}', 1, None), ('{"entity":"cards","limit":600}', 500, None), ('{"entity":"cards"}', None, None),
        ('{"entity":"cards","limit":""}', None, None), ('{"entity":"cards","limit":"7"}', 7, None), ('{"entity":"cards","limit":5.0}', 5, None),
        ('{"entity":"cards","limit":-1}', None, "limit must be a non-negative integer"),
        ('{"entity":"cards","limit":1.5}', None, "limit must be a non-negative integer"),
        ('{"entity":"cards","since_id":null,"x":1}', None, None),
        ('{"entity":"nope"}', None, "entity must be one of customers, addresses, accounts, cards, transactions"),
        ("[1]", None, "entity must be one of customers, addresses, accounts, cards, transactions"),
    ],
)
def test_clean_request(spark, body, limit, error):
    row = reads.clean_request(spark.createDataFrame([(body,)], "body STRING")).first()
    assert (row["limit"], row["error"]) == (limit, error)


def test_ignored_scope():
    assert reads.ignored_params("cards", {"customer_id": 3, "account_id": 1}) == ["customer_id"]


def brute_answer(tables, body):
    """Rows of one request by scanning everything."""
    ent = entity(body["entity"])
    out = tables[ent.name]
    for param, column in ent.filters.items():
        if param in body:
            out = [r for r in out if r[column] == body[param]]
    out = sorted((r for r in out if r["id"] > body.get("since_id", -1)), key=lambda r: r["id"])
    return [r["id"] for r in out[: min(max(body.get("limit", 10), 1), 500)]]


def test_answers_match_brute_force(spark, sf_dir):
    frames = bank_tables(spark, sf_dir)
    tables = {n: [r.asDict() for r in df.select("id", next(iter(entity(n).filters.values()))).collect()] for n, df in frames.items()}
    rng = random.Random(3)
    asks = []
    for i in range(120):
        name = rng.choice(list(frames))
        body = {"entity": name, "limit": rng.choice([0, 1, 9, 40, 500])}
        if rng.random() < 0.5:
            body["since_id"] = rng.choice(tables[name])["id"] + rng.randint(-2, 2)
        if rng.random() < 0.5:
            body[next(iter(entity(name).filters))] = rng.randint(1, 160)
        asks.append((i, "test", json.dumps(body)))
    asks += [(200, "test", asks[0][2]), (201, "test", '{"entity":"customers","since_id":999999}'), (202, "test", "{broken")]
    answers = {r["request_id"]: r for r in bus.answer_requests(message(spark, *asks), frames).collect()}
    assert len(answers) == len(asks)
    for i, _, text in asks[:-1]:
        reply = json.loads(answers[i]["body"])
        wanted = brute_answer(tables, json.loads(text))
        assert [r["id"] for r in reply["rows"]] == wanted, text
        assert reply["echo"] == json.loads(text)
        assert answers[i]["n_rows"] == len(wanted)
        assert (answers[i]["first_id"], answers[i]["last_id"]) == ((wanted[0], wanted[-1]) if wanted else (None, None))
    assert json.loads(answers[202]["body"]) == {"ok": False, "error": bus.UNKNOWN_ENTITY, "echo": None}


def test_only_reachable_ids_are_kept(spark):
    ids = spark.range(0, 100 * 4096, 4).select(F.lit("cards").alias("entity"), F.lit(-1).cast("bigint").alias("scope"), F.col("id").alias("place"))
    marks = spark.createDataFrame([("cards", -1, 40 * 4096 + 5), ("cards", -1, -1)], "entity STRING, scope BIGINT, place BIGINT")
    kept = bus._reachable(ids, marks)
    for mark in (40 * 4096 + 5, -1):
        after = [r["place"] for r in ids.where(F.col("place") > mark).orderBy("place").limit(500).collect()]
        assert kept.where(F.col("place").isin(after)).count() == 500
    assert kept.count() <= 4 * 1024


def test_replies_carry_masked_rows_that_load_again(spark, sf_dir):
    frames = bank_tables(spark, sf_dir)
    asks = message(spark, (1, "test", '{"entity":"customers","limit":500}'), (2, "test", '{"entity":"addresses","limit":500}'))
    replies = bus.reply_messages(bus.answer_requests(asks, frames), F.current_timestamp())
    empty = {n: df.limit(0) for n, df in frames.items()}
    decided = bus.load_replies(replies, empty, ["customers", "addresses"])
    loaded = bus.accepted(decided["customers"], "customers")
    wanted = mask_table(frames["customers"], "customers")
    assert loaded.exceptAll(wanted).count() == 0 and wanted.exceptAll(loaded).count() == 0
    assert bus.summarize_loads(decided).agg(F.sum("skipped")).first()[0] == 0


def test_sent_ids_continue(spark):
    log = message(spark, (41, "test", "{}"))
    sent = send_messages(log, spark.range(3).withColumn("body", F.lit("{}")), "test", "prod", "id", F.lit("2024-01-01"))
    assert [r["id"] for r in sent.orderBy("id").collect()] == [42, 43, 44]
