"""The bucketed scan against a plain computation, with buckets and hot keys small enough to matter."""

import random

from pyspark.sql import functions as F

from tests.conftest import rows
from veilframe.operators.ordered import allocate_ids, ordered_scan, positions


def data():
    rng = random.Random(7)
    ids = rng.sample(range(0, 5000), 300) + [2**45 + 3, 2**50, 2**62]
    return [(i, "hot" if rng.random() < 0.7 else f"k{i % 9}", rng.choice([None, "a", "b"]), rng.randint(0, 5)) for i in ids]


def brute(records, keyed, kind, inclusive):
    state, out = {}, []
    for i, key, word, number in sorted(records):
        k = key if keyed else ""
        if kind == "sum":
            before = state.get(k, 0)
            state[k] = before + number
        else:
            before = state.get(k)
            state[k] = word if word is not None else before
        out.append((i, state[k] if inclusive else before))
    return out


def test_scans_match_brute_force(spark):
    records = data()
    df = spark.createDataFrame(records, "id BIGINT, key STRING, word STRING, number BIGINT").repartition(5)
    for keyed in (False, True):
        for kind, column in (("sum", "number"), ("last", "word")):
            for inclusive in (True, False):
                for hot_rows in (20, 10**6):
                    found = ordered_scan(
                        df, "id", F.col(column), "out", ["key"] if keyed else [], kind, inclusive, hot_rows=hot_rows, bits=3
                    )
                    assert rows(found.select("id", "out"), "id") == brute(records, keyed, kind, inclusive)


def test_ties_put_rows_before_marks(spark):
    df = spark.createDataFrame([(5, 1), (5, 0), (3, 1), (9, 0)], "id BIGINT, is_row BIGINT")
    found = ordered_scan(df, "id", F.col("is_row"), "pos", tie=-F.col("is_row"), bits=2)
    assert rows(found, "id", F.desc("is_row")) == [(3, 1, 1), (5, 1, 2), (5, 0, 2), (9, 0, 2)]


def test_positions_and_ids(spark):
    df = spark.range(0, 1000, 7)
    assert rows(positions(df, "id").select("position"), "position") == [(i,) for i in range(1, 144)]
    new = allocate_ids(df.withColumnRenamed("id", "place"), spark.range(10), "place")
    assert rows(new, "id")[0] == (10, 0)
    assert rows(allocate_ids(df.withColumnRenamed("id", "place"), spark.range(0), "place"), "id")[0] == (1, 0)
