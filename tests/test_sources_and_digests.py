"""The bus as a stream of changes, recordings as documents, copies compared by digests, raw values found by value."""

import json
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from veilframe.operators import generate, reconcile, value_leaks
from veilframe.registry import MESSAGE_SCHEMA
from veilframe.session import scratch_dir
from veilframe.sources import bus_tail, messages, recording_writer
from veilframe.sources.traces import read_recording_documents
from veilframe.streaming import flows


# ---------------------------------------------------------------- J9
def test_tail_over_restarts_a_reset_and_a_replay(spark, tmp_path):
    log, marks, out, checkpoint = (str(tmp_path / n) for n in ("log", "marks", "out", "check"))
    spark.createDataFrame([], messages.MARK_SCHEMA).write.parquet(marks)
    path = spark._jvm.org.apache.hadoop.fs.Path(log)

    def run(ids, read=(), anew=False):
        if anew:
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        rows = spark.createDataFrame([(i, "test", "prod", "{}", None, None) for i in ids], MESSAGE_SCHEMA)
        messages.append_messages(rows.repartition(2), log)
        if read:
            messages.mark_read(spark.createDataFrame([(i,) for i in read], "id long"), marks)
        flows.stream_changes(spark, log, marks, out, checkpoint, None).awaitTermination()
        kept = spark.read.parquet(out)
        last = kept.where(F.col("batch") == kept.agg(F.max("batch")).scalar())
        return sorted((r.change, r.id or 0, r.consumed_at is not None) for r in last.collect())

    assert run(range(1, 6)) == [("message", i, False) for i in range(1, 6)]
    assert run([6, 7], read=[2, 3]) == [("consumed", 2, True), ("consumed", 3, True), ("message", 6, False), ("message", 7, False)]
    assert run([1, 2], anew=True) == [("message", 1, False), ("message", 2, False), ("reset", 0, False)]
    assert run([3]) == [("message", 3, False)]


def test_tail_reads_only_files_of_the_range(spark, tmp_path):
    log = str(tmp_path / "log")
    for low in (0, 100, 200):
        messages.append_messages(spark.range(low + 1, low + 101).selectExpr("id", "'test' sender", "'prod' recipient", "'' body", "null created_at", "timestamp'2024-01-01' consumed_at").coalesce(1), log)
    reader = bus_tail.TailReader(log)
    assert reader.latestOffset() == {"last": 300}
    (part,) = reader.partitions({"last": 150}, {"last": 250})
    assert len(part.files) == 2
    rows = pa.Table.from_batches(list(reader.read(part)))
    assert sorted(rows.column("id").to_pylist()) == list(range(151, 251))
    assert {v.isoformat() for v in rows.column("consumed_at").to_pylist()} == {"2024-01-01T00:00:00+00:00"}
    assert reader.partitions({"last": 300}, {"last": 300}) == [] and bus_tail.TailReader(str(tmp_path / "none")).latestOffset() == {"last": 0}


# ---------------------------------------------------------------- S9
def test_documents_of_any_shape(spark, tmp_path):
    root = str(tmp_path / "docs")
    headers = spark.createDataFrame(
        [("a/1", "2024", 5, "{}", "m", "pass", 's "q"', 3), ("empty", None, None, None, None, None, None, None)],
        "rec_id string, started_at string, duration_ms long, params string, model string, verdict string, summary string, event_count long",
    )
    hot = [("hot", k, "trace", f"line {k}\n\\ü") for k in range(3000)]
    events = spark.createDataFrame([("a/1", 3, "x", None), ("a/1", 1, "y", '{"k":1}'), ("a/1", 1, "a", "z"), *hot], "rec_id string, t_ms long, event string, data string")
    recording_writer.write_recording_documents(headers, events.repartition(7), root)
    recording_writer.write_recording_documents(headers, events.repartition(3), root)  # again
    names = sorted(p.name for p in (tmp_path / "docs").iterdir() if not p.name.startswith((".", "_")))
    assert names == ["a%2F1.json", "empty.json", "hot.json"]
    assert json.loads((tmp_path / "docs" / "a%2F1.json").read_text()) == {
        "id": "a/1", "startedAt": "2024", "durationMs": 5, "params": "{}", "prodModel": "m", "verdict": "pass", "summary": 's "q"', "eventCount": 3,
        "events": [{"t": 1, "event": "a", "data": "z"}, {"t": 1, "event": "y", "data": '{"k":1}'}, {"t": 3, "event": "x"}],
    }
    back_headers, back = read_recording_documents(spark, root)
    assert back_headers.count() == 3 and back.where("rec_id = 'hot'").count() == 3000
    assert back.exceptAll(events.select(*back.columns)).isEmpty()


def test_an_aborted_job_leaves_no_document(spark, tmp_path):
    root = str(tmp_path / "docs")
    lines = spark.range(20).select(F.col("id").cast("string").alias("rec_id"), F.lit("{}").alias("line"), F.lit(True).alias("is_header"))
    spark.dataSource.register(recording_writer.RecordingDocuments)
    with pytest.raises(Exception, match="stop here"):
        bad = lines.withColumn("line", F.when(F.col("rec_id") == "13", F.raise_error(F.lit("stop here"))).otherwise(F.col("line")))
        bad.repartition(4).write.format("recording_documents").mode("append").save(root)
    assert not list((tmp_path / "docs").glob("*.json")) and not list((tmp_path / "docs" / "_pending").glob("*"))


# ---------------------------------------------------------------- J3, A5
def test_differences(spark):
    rng = random.Random(4)
    left = {rng.randrange(1 << 27): str(rng.randrange(50)) for _ in range(4000)}
    right = {i: v for i, v in left.items() if i % 31}
    changed = rng.sample(sorted(right), 40)
    right.update({i: right[i] + "x" for i in changed} | {5: "new", (1 << 27) + 9: "far"})
    schema = "id long, v string, other string"
    frames = [spark.createDataFrame([(i, v, None) for i, v in side.items()], schema) for side in (left, right)]
    got = {r.id: r.difference for r in reconcile.differences(*frames, ["v", "other"]).collect()}
    wanted = {i: "only left" for i in left.keys() - right.keys()} | {i: "only right" for i in right.keys() - left.keys()} | dict.fromkeys(changed, "changed")
    assert got == wanted
    assert {r.id for r in reconcile.missing(*frames).collect()} == left.keys() - right.keys()
    # a NULL is no empty text, and values do not slide from one column into the next
    one, two = (spark.createDataFrame([(1, *x), (2, *y)], schema) for x, y in ((("a", None), (None, "b")), (("a", ""), ("b", None))))
    assert reconcile.differences(one, two, ["v", "other"]).count() == 2


def test_equal_copies_shuffle_no_ids(spark, monkeypatch):
    """Where no range differs, every later scan is of nothing."""
    rows = spark.range(0, 300_000).withColumn("v", F.col("id") * 7)
    seen = []
    real = reconcile.prune
    monkeypatch.setattr(reconcile, "prune", lambda rows, runs, **k: seen.append(runs.count()) or real(rows, runs, **k))
    found = reconcile.differences(rows.repartition(3), rows.repartition(5), ["v"])
    assert found.isEmpty() and seen == [0, 0, 0, 0]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Range" not in plan and "LocalRelation" in plan


# ---------------------------------------------------------------- A4
def test_values_in_any_spelling(spark):
    raw = {
        "customers": spark.createDataFrame([("123-45-6789",), ("12",), (None,)], "ssn string"),
        "accounts": spark.createDataFrame([("000123456", "987654321")], "account_number string, routing_number string"),
        "cards": spark.createDataFrame([("4111 1111 1111 1111",), ("4999999999999999999999",)], "card_number string"),
    }
    bodies = {
        1: "ssn 123456789.", 2: "123 45-6789", 3: "x1234567890y", 4: "123--456789", 5: "4111-1111-1111-1111", 6: "41111111111111112", 7: "***-**-6789", 8: None, 9: "",
        10: "987654321 000123456", 11: "12 and 1234", 12: "123.45.6789", 13: "4999999999999999999999", 14: "1234567891 23456789",
    }
    df = spark.createDataFrame(list(bodies.items()), "id long, body string").repartition(3)
    got = sorted((r.id, r.column_name) for r in value_leaks.leaks_by_value(df, raw).collect())
    ssn, card = "customers.ssn", "cards.card_number"
    assert got == sorted(
        [(1, ssn), (2, ssn), (3, ssn), (5, card), (6, card), (10, "accounts.account_number"), (10, "accounts.routing_number"), (13, card), (14, ssn)]
    )
    assert value_leaks.leaks_by_value(df, {n: d.limit(0) for n, d in raw.items()}).isEmpty()


def test_a_full_filter_loses_nothing(spark, monkeypatch):
    monkeypatch.setattr(value_leaks, "MOST_BITS", 15)
    cards = spark.range(20_000).select(F.format_string("4%015d", F.col("id") * 7).alias("card_number"))
    none = spark.createDataFrame([], "ssn string, account_number string, routing_number string")
    raw = {"customers": none, "accounts": none, "cards": cards}
    bodies = spark.range(50).select("id", F.format_string("no 4%015d.", F.col("id")).alias("body"))
    assert {r.id for r in value_leaks.leaks_by_value(bodies, raw).collect()} == {i for i in range(50) if i % 7 == 0}


# ---------------------------------------------------------------- G1
def test_draws_have_no_period(spark):
    period = 2**31 - 1
    keys = spark.range(1, 400).select(F.col("id").alias("a"), (F.col("id") + period).alias("b"))
    same = keys.where(generate.draw(F.col("a"), 42, 4, 10**9) == generate.draw(F.col("b"), 42, 4, 10**9))
    assert same.isEmpty()
    spread = spark.range(6000).groupBy(generate.draw(F.col("id"), 1, 2, 6).alias("d")).count().collect()
    assert len(spread) == 6 and all(850 < r["count"] < 1150 for r in spread)
