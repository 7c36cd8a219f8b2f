"""Cases in which rows, replies or pairs were once lost, doubled or refused."""

import datetime as dt
import json
import warnings

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from veilframe.functions.masks import mask_table
from veilframe.operators import bus, reads
from veilframe.plans import sync
from veilframe.registry import MESSAGE_SCHEMA, entity
from veilframe.sources.fixtures import bank_tables
from veilframe.sources.messages import with_marks
from veilframe.sources.snapshots import SnapshotStore, VersionConflict
from veilframe.streaming import flows

AT = dt.datetime(2024, 1, 1)
ASK = '{"entity":"customers","limit":5}'
ECHO = '{"ok":true,"entity":"customers","rows":[],"echo":' + ASK + "}"


def log(spark, *messages):
    """(id, is request, seconds) of equal requests and their echoes."""
    data = [(i, *(("test", "prod", ASK) if ask else ("prod", "test", ECHO)), AT + dt.timedelta(seconds=s), None) for i, ask, s in messages]
    return spark.createDataFrame(data, MESSAGE_SCHEMA)


def test_stray_echo_moves_no_pair(spark):
    messages = log(spark, (1, False, 0), (2, True, 1), (3, False, 2), (4, False, 3), (5, True, 4), (6, True, 5), (7, False, 6))
    pairs = bus.pair_requests(messages).select("request_id", "reply_id")
    assert rows(pairs, "request_id") == [(2, 3), (5, 7), (6, None)]


@pytest.mark.parametrize("files", [[(1, 6)], [(1, 2), (3, 4), (5, 6)]])
def test_each_reply_answers_one_of_equal_requests(spark, tmp_path, files):
    messages = log(spark, (1, True, 0), (2, True, 1), (3, True, 2), (4, False, 3), (5, False, 4), (6, False, 5))
    source, out = str(tmp_path / "source"), str(tmp_path / "pairs")
    for low, high in files:
        messages.where(F.col("id").between(low, high)).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(MESSAGE_SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    flows.stream_pairing(stream, out, str(tmp_path / "c"), interval=None).awaitTermination()
    closed = flows.close_pairing(spark.read.schema("request_id BIGINT, reply_id BIGINT").parquet(out), messages)
    assert rows(closed, "request_id") == [(1, 4), (2, 5), (3, 6)]


def test_rows_of_a_long_reply_keep_their_order(spark):
    def reply(ids):
        row = {"customer_id": "1", "account_type": "checking", "account_number": "****1234", "balance": "1.00", "currency": "EUR", "status": "open", "opened_at": "2024-01-01", "created_at": "2024-01-01T00:00:00.000Z", "updated_at": "2024-01-01T00:00:00.000Z"}
        return json.dumps({"ok": True, "entity": "accounts", "rows": [{**row, "id": str(i)} for i in ids]})

    data = [(1, "prod", "test", reply(range(1, 601)), AT, None), (2, "prod", "test", reply([600]), AT, None)]
    got = bus.reply_rows(bus.parse_replies(spark.createDataFrame(data, MESSAGE_SCHEMA)))
    assert got.count() == 601 == got.select("arrival").distinct().count()
    last = got.orderBy(F.desc("arrival")).first()
    assert (last.reply_id, last.arrival.place) == (2, 0)


@pytest.mark.parametrize(
    ("sent", "read"),
    [("9223372036854775807", 2**63 - 1), ("9223372036854775808", None), ("1e3", 1000), ("0x10", 16), ("00012.0", 12), ("1.5", None), ("-1", None), (" 7 ", 7), ("1e-1", None), ("abc", None)],
)
def test_numbers_of_requests(spark, sent, read):
    body = json.dumps({"entity": "customers", "since_id": sent})
    got = reads.clean_request(spark.createDataFrame([(body,)], "body string")).first()
    assert got.since_id == read and (got.error is None) == (read is not None)


def test_blank_lines_hold_any_white_space(spark):
    lines = spark.createDataFrame([(" ",), (" \t",), ("x",)], "line string")
    assert rows(reads.scrub_log_lines(lines)) == [("x",)]


def test_copies_have_no_page_cap(spark, tmp_path):
    ids = spark.range(1, 250 * 30 + 1)
    assert sync.page_plan(ids, "transactions").count() == 251
    assert sync.page_plan(ids, "transactions", max_pages=200).count() == 200


def test_ids_go_on_and_a_cap_is_told(spark, sf_dir, tmp_path):
    raw = {n: df.where("id <= 3") if n == "customers" else df.limit(0) for n, df in bank_tables(spark, sf_dir).items()}
    store, path = SnapshotStore(spark, str(tmp_path / "masked")), str(tmp_path / "log")
    store.reset()
    for _ in range(2):
        sync.copy_paged(raw, store, log=path)
    ids = spark.read.parquet(path).select("id")
    assert ids.count() == ids.distinct().count() > 0 and store.read("customers").count() == 3
    more = {**raw, "customers": bank_tables(spark, sf_dir)["customers"].select(F.explode(F.sequence(F.lit(0), F.lit(9))).alias("k"), "*").withColumn("id", F.col("id") * 10 + F.col("k") + 10).drop("k")}
    with warnings.catch_warnings(record=True) as told:
        warnings.simplefilter("always")
        sync.copy_paged(more, store, max_pages=1, log=path)
    assert any("customers" in str(w.message) for w in told)


def test_two_stores_lose_nothing(spark, sf_dir, tmp_path):
    masked = mask_table(bank_tables(spark, sf_dir)["customers"], "customers")
    one, two = (SnapshotStore(spark, str(tmp_path / "root")) for _ in range(2))
    one.replace("customers", masked.where("id <= 10"))
    assert two.read("customers").count() == 10
    one.replace("customers", masked.where("id <= 20"))
    with pytest.raises(VersionConflict):
        two.replace("customers", masked.where("id <= 5"))
    two.append("customers", masked.where("id BETWEEN 21 AND 30"))
    assert SnapshotStore(spark, str(tmp_path / "root")).read("customers").count() == 30
    masked.limit(1).write.parquet(one.path("customers", one.version("customers") + 1))  # a writer that died
    with pytest.raises(VersionConflict):
        one.replace("customers", masked)
    one.clear_unfinished("customers")
    assert one.replace("customers", masked) == 3


def test_stream_copy_checks_rows_and_keeps_rejects(spark, sf_dir, tmp_path):
    store, raw = SnapshotStore(spark, str(tmp_path / "masked")), bank_tables(spark, sf_dir)
    store.replace("customers", mask_table(raw["customers"], "customers"))
    sound = raw["accounts"].where("id <= 5")
    bad = raw["accounts"].where("id = 6").withColumns({"customer_id": F.lit(None).cast("bigint"), "account_type": F.lit("loan")})
    flows.copy_batch(sound.unionByName(sound).unionByName(bad), "accounts", store, str(tmp_path / "rejects"))
    assert rows(store.read("accounts").select("id"), "id") == [(i,) for i in range(1, 6)]
    assert [r.id for r in spark.read.parquet(str(tmp_path / "rejects")).collect()] == [6]


def test_request_delivered_twice_in_a_batch_and_fresh_tables(spark, sf_dir, tmp_path):
    tables, replies = bank_tables(spark, sf_dir), str(tmp_path / "replies")
    ask = spark.createDataFrame([(i, "test", "prod", '{"entity":"customers","since_id":3,"limit":2}', AT, None) for i in (1, 1)], MESSAGE_SCHEMA)
    few = {**tables, "customers": tables["customers"].where("id <= 3")}
    state = {"now": few}
    flows.answer_batch(ask, lambda: state["now"], replies)
    state["now"] = tables
    flows.answer_batch(ask.withColumn("id", F.col("id") + 1), lambda: state["now"], replies)
    got = [(r.id - bus.REPLY_ID_BASE, len(json.loads(r.body)["rows"])) for r in spark.read.parquet(replies).collect()]
    assert sorted(got) == [(1, 0), (2, 2)]


def test_child_that_comes_before_its_parent_is_tried_again(spark, sf_dir, tmp_path):
    tables = {n: mask_table(df, n) for n, df in bank_tables(spark, sf_dir).items()}

    def reply(number, name, df):
        doc = bus.row_documents(df, name).select(F.concat(F.lit(f'{{"ok":true,"entity":"{name}","rows":['), F.array_join(F.array("doc"), ","), F.lit("]}")).alias("body"))
        return doc.select(F.lit(number).cast("bigint").alias("id"), F.lit("prod").alias("sender"), F.lit("test").alias("recipient"), "body", F.lit(AT).alias("created_at"), F.lit(None).cast("timestamp").alias("consumed_at"))

    address = tables["addresses"].orderBy("id").limit(1)
    owner = tables["customers"].join(address.select(F.col("customer_id").alias("id")), "id", "left_semi")
    store, path = SnapshotStore(spark, str(tmp_path / "masked")), str(tmp_path / "loads")
    store.reset()
    flows.load_batch(reply(1, "addresses", address), store, path, 0)
    assert store.read("addresses").isEmpty()
    flows.load_batch(reply(2, "customers", owner.select(*entity("customers").columns)), store, path, 1)
    assert store.read("addresses").count() == 1 == store.read("customers").count()
    report = spark.read.parquet(f"{path}/report").where("batch = 0").first()
    assert (report.reply_id, report.received, report.inserted, report.skipped) == (1, 1, 0, 1)
    assert spark.read.schema(MESSAGE_SCHEMA).parquet(f"{path}/waiting/batch=1").isEmpty()


def test_nothing_is_left_unread_after_answers_and_loads(spark, sf_dir, tmp_path):
    marks, replies = str(tmp_path / "marks"), str(tmp_path / "replies")
    asks = spark.createDataFrame([(i, "test", "prod", '{"entity":"customers","limit":2}', AT, None) for i in (1, 2)], MESSAGE_SCHEMA)
    store = SnapshotStore(spark, str(tmp_path / "masked"))
    store.reset()
    for _ in range(2):  # a replayed batch marks again
        flows.answer_batch(asks, bank_tables(spark, sf_dir), replies, marks=marks)
    answers = spark.read.schema(MESSAGE_SCHEMA).parquet(replies)
    everything = asks.unionByName(answers)
    assert with_marks(everything, marks).where("consumed_at IS NULL").count() == 2
    flows.load_batch(answers, store, marks=marks)
    read = with_marks(everything, marks)
    assert read.count() == 4 and reads.next_unread(read).isEmpty() and reads.pending(read, "prod").isEmpty()
