"""Raw values in message bodies, found by value: however they are spaced or dashed, and whatever they look like.

The digits of the raw columns go into a Bloom filter of at most 2**27 bits (16 MB), which goes to the tasks. There every
window of digits in a body (digits that follow each other directly, or after one blank or dash) as long as a raw value is
looked up in it. The few windows that may be raw values meet the raw columns in a join, which alone decides; however full
the filter is, nothing is lost.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.session import materialize

# The columns whose digits are looked for.
RAW_COLUMNS = {"customers": ("ssn",), "accounts": ("account_number", "routing_number"), "cards": ("card_number",)}
LEAST_DIGITS, MOST_DIGITS = 9, 18  # shorter values are no identifiers; longer ones are looked for by their first digits
MOST_BITS = 27
PROBES = 4
BITMAP_BITS = 15  # of a bitmap that Spark's bitmap functions build


def raw_values(raw: Mapping[str, DataFrame]) -> DataFrame:
    """(column_name, digits, size, number), each value once."""
    parts = []
    for name, columns in RAW_COLUMNS.items():
        for c in columns:
            digits = F.left(F.regexp_replace(c, "[^0-9]", ""), F.lit(MOST_DIGITS))
            parts.append(raw[name].select(F.lit(f"{name}.{c}").alias("column_name"), digits.alias("digits")))
    values = reduce(DataFrame.unionByName, parts).where(F.length("digits") >= LEAST_DIGITS).distinct()
    return values.select("*", F.length("digits").cast("long").alias("size"), F.col("digits").cast("long").alias("number"))


def _places(numbers: np.ndarray, size: np.ndarray | int, bits: int) -> np.ndarray:
    """The filter's bits for each number, one row a probe."""
    x = numbers.astype(np.uint64) * np.uint64(32) + np.asarray(size, np.uint64)
    rows = []
    for _ in range(PROBES):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9FB21C651E98DF25)
        x = (x ^ (x >> np.uint64(28))) * np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        rows.append((x >> np.uint64(64 - bits)).astype(np.int64))
    return np.stack(rows)


def bloom(values: DataFrame) -> tuple[np.ndarray, int]:
    """The filter as bytes, and its number of bits as a power of two: about 12 bits a value, MOST_BITS at most."""
    bits = min(max(int(values.count() * 12).bit_length(), BITMAP_BITS), MOST_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers, size = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("number", "size"))
            yield pa.record_batch([pa.array(_places(numbers, size, bits).ravel())], ["place"])

    places = values.select("number", "size").mapInArrow(run, "place long")
    maps = places.groupBy(F.shiftright("place", BITMAP_BITS).alias("part")).agg(F.bitmap_construct_agg(F.col("place").bitwiseAND((1 << BITMAP_BITS) - 1)).alias("map"))
    filled = np.zeros((1 << (bits - BITMAP_BITS), 1 << (BITMAP_BITS - 3)), np.uint8)
    for r in maps.toLocalIterator():  # at most 2**(bits - 15) bitmaps of 4 kB
        filled[r["part"], : len(r["map"])] = np.frombuffer(r["map"], np.uint8)
    return filled.ravel(), bits


def digit_windows(texts: pa.Array, sizes: list[int], filled: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, size, number) of the windows of digits that the filter may hold."""
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    held = texts.buffers()[2]
    data = np.frombuffer(held, np.uint8)[offsets[0] : offsets[-1]] if held is not None and held.size else np.zeros(0, np.uint8)
    digit = (data >= 48) & (data <= 57)
    at = np.flatnonzero(digit)
    text = np.searchsorted(offsets - offsets[0], at, "right") - 1
    value = data[at].astype(np.int64) - 48
    # a digit goes on from the one before it where nothing, or one blank or dash, lies between, in the same text
    step = np.diff(at, prepend=-9)
    between = data[np.maximum(at - 1, 0)]
    joined = (step == 1) | ((step == 2) & ((between == 32) | (between == 45)))
    joined &= text == np.concatenate([[-1], text[:-1]])
    run = np.cumsum(~joined)
    out = []
    for size in sizes:
        n = len(at) - size + 1
        if n <= 0:
            continue
        begin = np.flatnonzero(run[:n] == run[size - 1 :])
        number = np.zeros(len(begin), np.int64)
        for k in range(size):
            number = number * 10 + value[begin + k]
        place = _places(number, size, bits)
        hit = ((filled[place >> 3] >> (place & 7).astype(np.uint8)) & 1).all(0)
        out.append(np.stack([text[begin[hit]], np.full(hit.sum(), size), number[hit]], 1))
    found = np.concatenate(out) if out else np.zeros((0, 3), np.int64)
    return found[:, 0], found[:, 1], found[:, 2]


def leaks_by_value(messages: DataFrame, raw: Mapping[str, DataFrame], key: str = "id", column: str = "body") -> DataFrame:
    """(key, column_name, digits) of every raw value in a body, once a body. NULL and empty bodies hold none."""
    values = materialize(raw_values(raw), "raw-values")
    sizes = sorted(r["size"] for r in values.select("size").distinct().collect())  # at most ten
    filled, bits = bloom(values)
    shared = messages.sparkSession.sparkContext.broadcast(filled)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, size, number = digit_windows(batch.column("body"), sizes, shared.value, bits)
            yield pa.record_batch([batch.column("key").take(pa.array(text)), pa.array(size), pa.array(number)], ["key", "size", "number"])

    kind = messages.select(key).schema[0].dataType.simpleString()
    bodies = messages.where(F.col(column).rlike("[0-9]")).select(F.col(key).alias("key"), F.col(column).alias("body"))
    maybe = bodies.mapInArrow(run, f"key {kind}, size long, number long").distinct()
    return maybe.join(values, ["size", "number"]).select(F.col("key").alias(key), "column_name", "digits")
