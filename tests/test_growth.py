"""Steps whose cost used to grow faster than it had to: inputs worked out again, rows shuffled for a decision, few files."""

import os
from datetime import datetime

import pyarrow.parquet as pq
import pytest

from checks import queries
from checks.queries import QUERIES
from tests.conftest import rows
from veilframe import session
from veilframe.operators import bus, generate, loads
from veilframe.plans import sync
from veilframe.registry import ENTITY_ORDER, MESSAGE_SCHEMA
from veilframe.sources.fixtures import bank_tables
from veilframe.sources.snapshots import SnapshotStore


class Stop(Exception):
    pass


def plan(df, capsys) -> str:
    capsys.readouterr()
    df.explain()
    return capsys.readouterr().out


@pytest.mark.parametrize("name", ["J3_missing_by_digests", "J3_missing_ids", "A5_reconcile"])
def test_results_read_transactions_that_were_written_once(spark, sf_dir, capsys, name):
    assert "Window" not in plan(QUERIES[name](spark, sf_dir), capsys)


@pytest.mark.parametrize("name, step", [("C1_sync_baseline", "sync_baseline"), ("C2_sync_delta", "sync_delta")])
def test_copies_read_transactions_that_were_written_once(spark, sf_dir, capsys, monkeypatch, name, step):
    seen = []

    def stop(raw, store):
        seen.append(raw)
        raise Stop

    monkeypatch.setattr(queries.sync, step, stop)
    with pytest.raises(Stop):
        QUERIES[name](spark, sf_dir)
    assert "Window" not in plan(seen[0]["transactions"], capsys)


def test_only_ids_met_before_are_joined_to_the_rows(spark, monkeypatch):
    written = {}

    def spy(df, purpose, *rest):
        written[purpose] = df
        return df

    monkeypatch.setattr(loads, "materialize", spy)
    report = spark.createDataFrame(
        [(1, 10, None), (2, 10, None), (3, 11, None), (4, 12, None), (5, 13, "bad"), (6, 13, None)], "arrival BIGINT, id BIGINT, reason STRING"
    )
    for column in loads.lookup("customers").columns[1:]:
        report = report.withColumn(column, loads.F.lit(None).cast("string"))
    existing = spark.createDataFrame([(12,), (99,)], "id BIGINT")
    found = rows(loads.decide_load(report, existing, "customers", "arrival").select("arrival", "outcome"), "arrival")
    assert found == [(1, "inserted"), (2, "conflict"), (3, "inserted"), (4, "conflict"), (5, "skipped"), (6, "inserted")]
    assert rows(written["met-ids"].select("id"), "id") == [(10,), (12,)]


def test_reply_rows_are_read_as_text_in_one_go(spark):
    body = '{"ok":true,"entity":"customers","rows":[{"id":"7","ssn":{"a":1},"email":null,"phone":5,"x":1},3,null,{"id":[2],"last_name":"B"}]}'
    empty = '{"ok":true,"entity":"customers","rows":[]}'
    messages = spark.createDataFrame([(i, "prod", "test", b, None, None) for i, b in enumerate((body, empty, '{"ok":false}', "{", None))], MESSAGE_SCHEMA)
    texts = bus.reply_row_texts(bus.reply_rows(bus.parse_replies(messages)))
    got = bus.typed_reply_rows(texts, "customers").select("arrival.place", "id", "ssn", "email", "phone", "last_name")
    assert rows(got, "place") == [
        (0, "7", '{"a":1}', None, "5", None), (1, None, None, None, None, None), (2, None, None, None, None, None), (3, "[2]", None, None, None, "B"),
    ]


def test_inputs_of_streams_are_cut_by_rows_and_come_in_two_batches(spark, monkeypatch):
    monkeypatch.setattr(queries, "FILE_ROWS", 10)
    path = queries.as_files(spark.range(100), "numbers")
    assert len(spark.read.parquet(path).inputFiles()) == 12
    batches = []
    stream = queries._stream(spark, path, spark.range(1).schema)
    stream.writeStream.foreachBatch(lambda df, n: batches.append(df.count())).trigger(availableNow=True).option(
        "checkpointLocation", queries.scratch_dir(spark, "check")
    ).start().awaitTermination()
    assert len(batches) == 2 and sum(batches) == 100


def test_replies_are_written_by_the_tasks_that_make_them(spark, sf_dir, monkeypatch):
    def dealt(*_args, **_more):
        raise AssertionError("dealt out anew")

    def stop(*_args, **_more):
        raise Stop

    monkeypatch.setattr(queries, "as_files", dealt)
    monkeypatch.setattr(queries.flows, "stream_load", stop)
    with pytest.raises(Stop):
        QUERIES["T3_stream_load"](spark, sf_dir)


def test_accounts_are_numbered_once(spark, capsys):
    made = generate.generate_bank(generate.customer_ids(spark, 50), datetime(2026, 1, 1))
    assert "Window" not in plan(made["accounts"], capsys)
    cards = plan(made["cards"], capsys)
    assert "md5" not in cards[cards.index("Window"):].split("Project")[0]


def test_a_copy_keeps_only_what_is_read_later(spark, sf_dir, tmp_path):
    raw = {n: df.where("id <= 3") if n == "customers" else df.limit(0) for n, df in bank_tables(spark, sf_dir).items()}
    store, path, shared = SnapshotStore(spark, str(tmp_path / "masked")), tmp_path / "log", spark.conf.get("spark.checkpoint.dir") + "/veilframe"
    before = set(os.listdir(shared)) if os.path.isdir(shared) else set()
    summary = sync.copy_paged(raw, store, log=str(path))
    left = {n.rsplit("-", 1)[0] for n in set(os.listdir(shared)) - before}
    assert left == {f"load-{n}" for n in ENTITY_ORDER}
    assert spark.conf.get(session.FILE_CLEANUP, None) in (None, "false")
    assert summary.where("entity = 'customers'").first()["inserted"] == 3 and store.read("customers").count() == 3
    files = [pq.ParquetFile(f).metadata for f in path.glob("*.parquet")]
    assert {m.row_group(0).column(3).compression for m in files if m.num_row_groups} == {"ZSTD"}


def test_many_positions_are_not_broadcast(spark, sf_dir, monkeypatch):
    """Whatever little room positions take on disk; rows cross the shuffle to their cell typed, and are written as JSON behind it."""
    tables = {n: df for n, df in bank_tables(spark, sf_dir).items() if n in ("customers", "accounts")}
    data = [(i, "test", "prod", f'{{"entity":"{n}","since_id":{i * 7},"limit":40}}', None, None) for i, n in enumerate(["customers", "accounts"] * 4)]
    requests = spark.createDataFrame(data, MESSAGE_SCHEMA)
    few = rows(bus.answer_requests(requests, tables), "request_id")
    monkeypatch.setattr(bus, "PLANNED_ROWS", 0)
    many = bus.answer_requests(requests, tables)
    text = many._jdf.queryExecution().executedPlan().toString()
    assert rows(many, "request_id") == few and sum(r[4] for r in few) > 0
    assert text.count("BroadcastHashJoin") == 0
    assert "of_customers" in text[text.index("REPARTITION"):]  # what makes the rows of the shuffle to the cells stands below it
