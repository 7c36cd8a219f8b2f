import datetime as dt

from pyspark.sql import functions as F

from tests.conftest import rows
from veilframe.functions.masks import mask_table
from veilframe.operators import bus
from veilframe.registry import MESSAGE_SCHEMA, entity
from veilframe.sources.fixtures import bank_tables, fixture
from veilframe.sources.snapshots import SnapshotStore
from veilframe.streaming import flows


def stream(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_copy_survives_restart_and_replay(spark, sf_dir, tmp_path):
    raw = bank_tables(spark, sf_dir)
    store = SnapshotStore(spark, str(tmp_path / "masked"))
    store.replace("customers", mask_table(raw["customers"], "customers"))
    source, checkpoint = str(tmp_path / "source"), str(tmp_path / "check")
    accounts = raw["accounts"]
    accounts.where("id <= 500").repartition(2).write.parquet(source)
    flows.stream_masked_copy(stream(spark, source, entity("accounts").schema), "accounts", store, checkpoint, None).awaitTermination()
    assert store.read("accounts").count() == 500
    accounts.where("id > 500").repartition(2).write.mode("append").parquet(source)
    flows.stream_masked_copy(stream(spark, source, entity("accounts").schema), "accounts", store, checkpoint, None).awaitTermination()
    flows.copy_batch(accounts, "accounts", store)  # the whole input once more
    wanted = mask_table(accounts, "accounts")
    assert store.read("accounts").exceptAll(wanted).isEmpty() and wanted.exceptAll(store.read("accounts")).isEmpty()


def test_orphans_do_not_cross(spark, sf_dir, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "masked"))
    raw = bank_tables(spark, sf_dir)
    store.replace("customers", mask_table(raw["customers"].where("id <= 10"), "customers"))
    flows.copy_batch(raw["addresses"], "addresses", store)
    assert store.read("addresses").where("customer_id > 10").isEmpty()
    assert not store.read("addresses").isEmpty()


def test_each_request_is_answered_once(spark, sf_dir, tmp_path):
    tables = bank_tables(spark, sf_dir)
    replies, source = str(tmp_path / "replies"), str(tmp_path / "source")
    requests = fixture(spark, sf_dir, "request_bodies").where("id < 60")
    requests.repartition(2).write.parquet(source)
    flows.stream_answer(stream(spark, source, MESSAGE_SCHEMA), tables, replies, str(tmp_path / "c"), None).awaitTermination()
    flows.answer_batch(requests, tables, replies)  # a replayed batch
    out = spark.read.parquet(replies)
    assert out.count() == 60 == out.select("id").distinct().count()
    assert out.agg(F.min("id")).first()[0] == bus.REPLY_ID_BASE


def test_late_reply_is_unpaired_but_loaded(spark, tmp_path):
    at = dt.datetime(2024, 1, 1)
    ask = '{"entity":"customers","limit":%d}'
    row = '{"id":"%d","first_name":"A","last_name":"B***","email":"a***@b","phone":"***-***-1234","ssn":"***-**-1234","date_of_birth":"1990-01-01","created_at":"2024-01-01T00:00:00.000Z"}'
    reply = '{"ok":true,"entity":"customers","rows":[' + row + '],"echo":' + ask + "}"

    def seconds(n):
        return at + dt.timedelta(seconds=n)

    log = [
        (1, "test", "prod", ask % 1, seconds(0), None), (2, "prod", "test", reply % (1, 1), seconds(20), None),
        (3, "test", "prod", ask % 3, seconds(30), None), (4, "prod", "test", reply % (2, 3), seconds(30 + 181), None),
        (5, "test", "prod", ask % 5, seconds(4000), None), (6, "prod", "test", reply % (3, 5), seconds(4001), None),
    ]
    messages = spark.createDataFrame(log, MESSAGE_SCHEMA)
    source, out = str(tmp_path / "source"), str(tmp_path / "pairs")
    for low in (1, 3, 5):  # files in order of arrival
        messages.where(F.col("id").between(low, low + 1)).coalesce(1).write.mode("append").parquet(source)
    flows.stream_pairing(stream(spark, source, MESSAGE_SCHEMA), out, str(tmp_path / "c"), interval=None).awaitTermination()
    closed = flows.close_pairing(spark.read.schema("request_id BIGINT, reply_id BIGINT").parquet(out), messages)
    assert rows(closed, "request_id") == [(1, 2), (3, None), (5, 6)]

    store = SnapshotStore(spark, str(tmp_path / "masked"))
    store.reset()
    flows.stream_load(stream(spark, source, MESSAGE_SCHEMA), store, str(tmp_path / "d"), None).awaitTermination()
    assert rows(store.read("customers").select("id"), "id") == [(1,), (2,), (3,)]
