"""Terms of texts as bytes, and query sets dealt into blocks of a proven size.

A term is a maximal run of ASCII letters, digits and characters beyond ASCII; only A-Z is lower-cased. In UTF-8 every byte
of a character beyond ASCII is 128 or more, so terms are found byte by byte, without decoding.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import column, saved
from veilframe.llm.words import flat

GAP = 32
FOLD = np.full(256, GAP, np.uint8)  # the byte itself inside terms, lower case for A-Z, else a gap
for low, high in ((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF)):
    FOLD[low : high + 1] = np.arange(low, high + 1)
FOLD[0x41:0x5B] = FOLD[0x61:0x7B]


def folded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one row of bytes with a gap before, between and after them, and where these gaps are."""
    data, offsets = flat(texts)
    return np.insert(FOLD[data], offsets, GAP), offsets + np.arange(len(offsets))


def bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of each term in folded bytes, which begin and end with a gap."""
    edges = np.flatnonzero(np.diff((data != GAP).view(np.int8)))
    return edges[::2] + 1, edges[1::2] + 1


def terms_of(text: str) -> list[bytes]:
    data, _ = folded(pa.array([text]))
    return data.tobytes().split()


def blocks(items: DataFrame, most_bytes: int, most_rows: int, id_col: str = "item_id", text_col: str = "text") -> tuple[DataFrame, int]:
    """(item_id string, text, block) of all items with text, saved, and the number of blocks.

    Rows of one item share a block. No block passes both bounds twice over, unless it is a single item's: the number of
    blocks is doubled until that holds, so a caller may collect any one block.
    """
    rows = saved(items.select(column(id_col).cast("string").alias("item_id"), column(text_col).cast("string").alias("text")).where(F.length("text") > 0), "items")
    whole = rows.agg(F.sum(F.octet_length("text")), F.count(F.lit(1))).first()
    count = max(1, -(-(whole[0] or 0) // most_bytes), -(-whole[1] // most_rows))
    while True:
        dealt = rows.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(count)).cast("int"))
        sizes = dealt.groupBy("block").agg(F.sum(F.octet_length("text")).alias("b"), F.count(F.lit(1)).alias("n"), F.min("item_id").alias("lo"), F.max("item_id").alias("hi"))
        if count == 1 or sizes.where(((F.col("b") > 2 * most_bytes) | (F.col("n") > 2 * most_rows)) & (F.col("lo") != F.col("hi"))).isEmpty():
            return dealt, count
        count *= 2
