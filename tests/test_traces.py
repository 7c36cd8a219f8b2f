import json

from pyspark.sql import functions as F

from tests.conftest import rows
from veilframe.operators import reads, traces
from veilframe.sources import traces as files

LINES = [
    ("prod", '{"type":"agent_start"}'), ("prod", '{"type":"tool_execution_start","toolName":"query_masked"}'),
    ("prod", '{"type":"message_end","message":{"role":"assistant","provider":"p","model":"m1","content":[]}}'),
    ("test", '{"type":"agent_start"}'), ("prod", '{"type":"agent_end"}'), ("prod", "{broken"), ("prod", ""),
    ("prod", '{"type":"agent_start"}'), ("prod", '{"type":"message_end","message":{"role":"assistant","provider":"p","model":"m1"}}'),
    ("prod", '{"type":"message_end","message":{"role":"assistant","model":"m2"}}'), ("prod", '{"type":"error","error":"x"}'),
    ("prod", '{"type":"message_end","message":{"role":"user"}}'), ("prod", '{"type":"other"}'),
]


def events(spark):
    df = spark.createDataFrame([(i, a, line) for i, (a, line) in enumerate(LINES)], "seq BIGINT, agent STRING, line STRING")
    return files.parse_trace(df)


def test_cycles_models_and_filter(spark):
    e = events(spark)
    assert e.count() == len(LINES) - 2
    assert rows(traces.trace_cycles(e).select("agent", "cycle", "events", "tools", "errors", "ended"), "agent", "cycle") == [
        ("prod", 1, 4, 1, 0, True), ("prod", 2, 6, 0, 1, False), ("test", 1, 1, 0, 0, False)
    ]
    assert rows(traces.model_changes(e).select("seq", "model", "previous"), "seq") == [(2, "p/m1", None), (9, "m2", "p/m1")]
    kept = [r["seq"] for r in traces.trace_filter(e).orderBy("seq").collect()]
    assert 11 not in kept and 12 not in kept and 10 in kept


def test_trace_files(spark, tmp_path):
    path = tmp_path / "t.jsonl"
    path.write_text("\n".join(line for _, line in LINES))
    assert files.read_trace(spark, str(path)).count() == len(LINES) - 2


def test_recording_documents(spark, tmp_path):
    good = {"id": "r1", "startedAt": "2024", "durationMs": 5, "verdict": "pass", "events": [{"t": 1, "event": "log", "data": "a"}, {"t": 4, "event": "run", "data": "b"}]}
    (tmp_path / "r1.json").write_text(json.dumps(good, indent=1))
    (tmp_path / "r2.json").write_text("{ not json")
    headers, found = files.read_recording_documents(spark, str(tmp_path))
    assert [r["rec_id"] for r in headers.collect()] == ["r1"]
    assert rows(found.select("t_ms", "event"), "t_ms") == [(1, "log"), (4, "run")]


def test_retention(spark):
    headers = spark.range(40).select(F.format_string("r%02d", "id").alias("rec_id"))
    assert reads.retain_recordings(headers).where("kept").count() == 30
    lines = spark.createDataFrame([("ok",), ("  ",), ("Sample customer (RAW)",), ("a ssn=1",)], "line STRING")
    assert rows(reads.scrub_log_lines(lines)) == [("ok",)]
