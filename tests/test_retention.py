"""Retention beside running readers: logs are compacted, batch folders and documents removed, and streams lose nothing."""

from pyspark.sql import functions as F

from veilframe.plans import retention
from veilframe.registry import MESSAGE_SCHEMA
from veilframe.sources import messages
from veilframe.streaming import flows


def test_a_stream_beside_compaction_loses_nothing(spark, tmp_path):
    log, marks, out, checkpoint = (str(tmp_path / n) for n in ("log", "marks", "out", "check"))
    spark.createDataFrame([], messages.MARK_SCHEMA).write.parquet(marks)

    def send(low, high):
        rows = spark.range(low, high).selectExpr("id", "'test' sender", "'prod' recipient", "concat('b', id) body", "null created_at", "null consumed_at")
        messages.append_messages(rows.coalesce(1), log)

    def files():
        return sorted(p.name for p in (tmp_path / "log").glob("*.parquet"))

    for low in (1, 21, 41):
        send(low, low + 20)
    flows.stream_changes(spark, log, marks, out, checkpoint, None).awaitTermination()
    send(61, 81)  # not streamed yet
    assert retention.compact_log(spark, log, 60, retention.last_rows(50)) == 30
    assert len(files()) == 2 and sorted(r.id for r in messages.read_messages(spark, log).collect()) == list(range(31, 81))
    flows.stream_changes(spark, log, marks, out, checkpoint, None).awaitTermination()
    assert retention.compact_log(spark, log, 80) == 0 and len(files()) == 1
    send(81, 91)
    flows.stream_changes(spark, log, marks, out, checkpoint, None).awaitTermination()
    seen = [r.id for r in spark.read.parquet(out).collect()]
    assert sorted(seen) == list(range(1, 91))
    assert {r.body for r in messages.read_messages(spark, log).collect()} == {f"b{i}" for i in range(31, 91)}
    # a compaction that died before it removed the old files
    first = messages.read_messages(spark, log).where("id <= 80")
    first.coalesce(1).write.mode("append").parquet(log)
    retention.compact_log(spark, log, 80)
    assert messages.read_messages(spark, log).count() == 60
    assert retention.compact_log(spark, log, 5) == 0


def test_batch_folders_go_and_the_result_stays(spark, tmp_path):
    source, out = str(tmp_path / "source"), str(tmp_path / "out")
    for k in range(4):
        spark.createDataFrame([(k, "test", "prod", "123-45-6789", None, None)], MESSAGE_SCHEMA).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(MESSAGE_SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    flows.stream_leak_monitor(stream, out, str(tmp_path / "check"), None).awaitTermination()
    assert sorted(p.name for p in (tmp_path / "out").glob("batch=*")) == ["batch=2", "batch=3"]
    assert flows.latest(spark, out).select("messages", "leaks").first()[:] == (4, 4)
    assert retention.retain_batches(spark, str(tmp_path / "nowhere")) == []


def test_the_newest_documents_stay(spark, tmp_path):
    for k in range(7):
        (tmp_path / f"r{k}.json").write_text("{}")
    (tmp_path / "other.txt").write_text("x")
    assert retention.retain_documents(spark, str(tmp_path), keep=3) == 4
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == ["other.txt", "r4.json", "r5.json", "r6.json"]
