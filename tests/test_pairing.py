"""Pairing in a stream: equal requests, hot keys cut into chunks, timeouts, replays and batches, against one plain loop."""

import datetime as dt
import random
from collections import defaultdict
from functools import partial

import pytest

from veilframe.operators.ordered import ordered_scan
from veilframe.registry import MESSAGE_SCHEMA
from veilframe.session import scratch_dir
from veilframe.streaming import pairing

START = dt.datetime(2024, 1, 1)


def plain(events, timeout_ms):
    """{request: reply} by going through all events in order with a queue for each body."""
    queues, pairs = defaultdict(list), {}
    for at, number, is_request, key in sorted(events):
        if is_request:
            queues[key].append((number, at + timeout_ms))
            continue
        while queues[key] and queues[key][0][1] < at:
            queues[key].pop(0)
        if queues[key]:
            pairs[queues[key].pop(0)[0]] = number
    return pairs


def some_events(seed, n, hot=0.6):
    rng, out = random.Random(seed), []
    for number in range(1, n + 1):
        key = "hot" if rng.random() < hot else f"k{rng.randrange(8)}"
        out.append((number * 1000 + rng.randrange(3) * 1000, number, rng.random() < 0.5, key))
    return out


@pytest.mark.parametrize("bits", [16, 2])
def test_match_equals_a_plain_loop(spark, monkeypatch, bits):
    monkeypatch.setattr(pairing, "CHUNK_BITS", bits)
    monkeypatch.setattr(pairing, "ordered_scan", partial(ordered_scan, hot_rows=40, bits=14))
    events = some_events(bits, 400)
    df = spark.createDataFrame([(r, i, a, k) for a, i, r, k in events], pairing.EVENTS).repartition(5)
    requests, answers = pairing.match(df, 15_000)
    got = {r.request_id: r.reply_id for r in requests.join(answers, ["key", "k"]).collect()}
    assert got == plain(events, 15_000) and len(got) > 50


def test_batches_and_replays(spark):
    """Whatever the batches, each request is given out once; a batch that is run again changes nothing."""
    events = some_events(7, 150)
    messages = [
        (i, "test" if r else "prod", "x", f'{{"entity":"{k}"}}' if r else f'{{"echo":{{"entity":"{k}"}}}}', START + dt.timedelta(milliseconds=a), None) for a, i, r, k in sorted(events)
    ]
    messages.insert(60, (999, "test", "x", "not json", START, None))
    state, out = scratch_dir(spark, "open"), scratch_dir(spark, "pairs")
    for n, begin in enumerate(range(0, 160, 50)):
        batch = spark.createDataFrame(messages[begin : begin + 50], MESSAGE_SCHEMA)
        for _ in range(2 if n == 2 else 1):
            pairing.pair_batch(batch, state, out, n, 15, 5)
    rows = spark.read.parquet(out).collect()
    wanted = plain(events, 15_000)
    assert len(rows) == len({r.request_id for r in rows})
    assert {r.request_id: r.reply_id for r in rows if r.reply_id is not None} == wanted
    left = {r.id for r in spark.read.parquet(f"{state}/open/batch=3").where("is_request").collect()}
    requests = {i for _, i, r, _ in events if r} | {999}
    assert left | {r.request_id for r in rows} == requests and not left & {r.request_id for r in rows}
    last = max(a for a, *_ in events)
    assert left == {i for a, i, r, _ in events if r and i not in wanted and a + 15_000 >= last - 5000}


def test_a_request_may_come_after_its_reply(spark):
    state, out = scratch_dir(spark, "open"), scratch_dir(spark, "pairs")
    reply = (2, "prod", "x", '{"echo":{"entity":"a"}}', START + dt.timedelta(seconds=2), None)
    request = (1, "test", "x", '{"entity":"a"}', START, None)
    for n, row in enumerate((reply, request)):
        pairing.pair_batch(spark.createDataFrame([row], MESSAGE_SCHEMA), state, out, n, 180, 60)
    assert [(r.request_id, r.reply_id) for r in spark.read.parquet(out).collect()] == [(1, 2)]
