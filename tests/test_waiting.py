"""Children that come before their parents wait, are loaded once these come, and are given up when their time is over."""

import pytest

from veilframe.functions.masks import mask_table
from veilframe.registry import MESSAGE_SCHEMA, entity
from veilframe.sources.fixtures import bank_tables
from veilframe.sources.snapshots import SnapshotStore
from veilframe.streaming import flows


@pytest.fixture(scope="module")
def raw(spark, sf_dir):
    return bank_tables(spark, sf_dir)


def ids(df):
    return sorted(r.id for r in df.select("id").collect())


def test_copied_children_wait_for_their_parents(spark, raw, tmp_path):
    store, source, checkpoint = SnapshotStore(spark, str(tmp_path / "masked")), str(tmp_path / "source"), str(tmp_path / "check")
    people = mask_table(raw["customers"], "customers")
    accounts = raw["accounts"].where("id <= 40")
    store.replace("customers", people.where("id % 2 = 0"))

    def run(rows, patience=1000):
        rows.coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(entity("accounts").schema).option("maxFilesPerTrigger", 1).parquet(source)
        flows.stream_masked_copy(stream, "accounts", store, checkpoint, None, patience=patience).awaitTermination()

    run(accounts.where("id <= 20"))
    first = ids(accounts.where("id <= 20 AND customer_id % 2 = 0"))
    assert ids(store.read("accounts")) == first
    waiting = spark.read.parquet(f"{checkpoint}-waiting")
    assert sorted(first + ids(waiting)) == ids(accounts.where("id <= 20")) and {r.account_number[:4] for r in waiting.collect()} == {"****"}
    store.append("customers", people.where("id % 4 = 1"))
    run(accounts.where("id > 20"))
    known = accounts.where("customer_id % 4 <> 3")
    assert ids(store.read("accounts")) == ids(known)
    # the rest is given up with the reason once its time is over
    run(accounts.limit(0), patience=-1)
    rejects = spark.read.parquet(f"{checkpoint}-rejects")
    assert ids(rejects) == ids(accounts.where("customer_id % 4 = 3")) and rejects.where("reason LIKE '%FK%'").count() == rejects.count()
    assert ids(store.read("accounts")) == ids(known)


def test_replies_are_given_up_in_the_end(spark, tmp_path):
    store, log = SnapshotStore(spark, str(tmp_path / "masked")), str(tmp_path / "loads")
    store.reset()
    row = '{"id":"7","customer_id":"1","line1":"x","city":"c","state":"s","postal_code":"p","country":"US"}'
    lost = spark.createDataFrame([(1, "prod", "test", f'{{"ok":true,"entity":"addresses","rows":[{row}]}}', None, None)], MESSAGE_SCHEMA)
    for n in range(2):
        flows.load_batch(lost if n == 0 else lost.limit(0), store, log, n)
    assert spark.read.parquet(f"{log}/waiting/batch=1").count() == 1 and spark.read.parquet(f"{log}/given_up").isEmpty()
    for n in (2, 3):
        flows.load_batch(lost.limit(0), store, log, n, patience=-1)
    assert [tuple(r) for r in spark.read.parquet(f"{log}/given_up").select("reply_id", "entity", "row_id").collect()] == [(1, "addresses", "7")]
    assert spark.read.parquet(f"{log}/waiting/batch=3").isEmpty()
