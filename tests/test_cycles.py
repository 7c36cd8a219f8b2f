"""Cycles and model changes of a streamed trace: batches, a restart and a replay give what the whole trace gives."""

import datetime as dt
import json
import random

from veilframe.operators import traces
from veilframe.session import scratch_dir
from veilframe.sources.traces import parse_trace
from veilframe.streaming import cycles, flows

START = dt.datetime(2024, 1, 1)


def lines(n, seed=3):
    rng, out = random.Random(seed), []
    for k in range(n):
        agent = "prod" if rng.random() < 0.8 else "test"
        kind = rng.choice(["agent_start", "agent_end", "tool_execution_start", "error", "message_end", "message_end"])
        doc = {"type": kind}
        if kind == "message_end":
            doc["message"] = {"role": rng.choice(["assistant", "assistant", "user"]), "model": rng.choice(["a", "b"]) if rng.random() < 0.9 else ""}
        out.append((k, agent, START + dt.timedelta(seconds=k), json.dumps(doc) if rng.random() < 0.95 else "{broken"))
    return out


def test_batches_equal_the_whole_trace(spark):
    schema = "seq long, agent string, seen_at timestamp, line string"
    rows = lines(180)
    state, out = scratch_dir(spark, "open"), scratch_dir(spark, "cycles")
    # batches of very different sizes, one of them empty, one run twice
    for n, (low, high) in enumerate([(0, 1), (1, 70), (70, 70), (70, 75), (75, 180)]):
        batch = parse_trace(spark.createDataFrame(rows[low:high], schema).repartition(3))
        for _ in range(2 if n == 3 else 1):
            cycles.cycle_batch(batch, state, out, n)
    whole = parse_trace(spark.createDataFrame(rows, schema))

    def same(a, b):
        return sorted(map(tuple, a.collect()), key=str) == sorted(map(tuple, b.select(*a.columns).collect()), key=str)

    assert same(cycles.all_cycles(spark, state, out), traces.trace_cycles(whole))
    assert same(cycles.all_model_changes(spark, out), traces.model_changes(whole))
    last = {r.agent: r for r in cycles.open_cycles(spark, state).collect()}
    assert {a: r.model for a, r in last.items()} == {
        a: [json.loads(x)["message"]["model"] for _, g, _, x in rows if g == a and '"assistant"' in x and '"model": ""' not in x and x[-1] == "}" and x != "{broken"][-1] for a in last
    }
    assert {r.agent for r in cycles.idle_agents(spark, state, 0).collect()} == {min(last, key=lambda a: last[a].seen_at)}


def test_the_stream_restarts(spark, tmp_path):
    schema = "seq long, agent string, seen_at timestamp, line string"
    rows, source = lines(60, seed=9), str(tmp_path / "source")
    state, out, checkpoint = (str(tmp_path / n) for n in ("state", "out", "check"))
    for low in (0, 30):
        spark.createDataFrame(rows[low : low + 30], schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        flows.stream_cycles(stream, state, out, checkpoint, None).awaitTermination()
    whole = traces.trace_cycles(parse_trace(spark.createDataFrame(rows, schema)))
    got = cycles.all_cycles(spark, state, out)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, whole.select(*got.columns).collect()))
