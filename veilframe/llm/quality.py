"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Each text becomes ten statistics: a logarithm of its size and log-odds of shares, each drawn towards
an ordinary level by a few pseudo-counts, so that a text of one word is not an outlier. Each class
has a mean and a covariance, shrunk towards the pooled one and towards a multiple of the identity; a
score is the logistic of the difference of the two Mahalanobis log densities, worked out with the
inverse Cholesky factors that are computed once.

Fitted on a sample of labelled rows bounded by ``train_rows`` (chosen by a hash of the id); every
text is scored whole. Defined results: NULL texts count as empty, which have statistics like any other
text; NULL labels and ids teach nothing; a repeated label counts again; where a class has no labelled
row, or the table is empty, the score is the share of class 1 among labels, or one half.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilframe.llm.common import column
from veilframe.llm.words import SPACE, flat, slices, word_hashes, words

NAMES = ("words", "word_bytes", "upper", "symbols", "digits", "marks", "lines", "distinct", "repeats", "packed")
TRAIN_ROWS = 100_000
PSEUDO = 20  # bytes or words of ordinary text that every text is counted with
ORDINARY = (0.03, 0.005, 0.005, 0.003)  # their shares of the kinds below
KINDS = np.zeros((4, 256), bool)  # upper case, symbols, digits, exclamation and the like
KINDS[0, 65:91] = True
KINDS[1, [ord(c) for c in "#$%&*+/<=>@\\^_`{|}~[]"]] = True
KINDS[2, 48:58] = True
KINDS[3, [ord(c) for c in "!?"]] = True


def statistics(array: pa.Array) -> np.ndarray:
    """The statistics of each text, one row per text."""
    parts = slices(pa.RecordBatch.from_arrays([array], names=["text"]), "text")
    return np.concatenate([np.zeros((0, len(NAMES))), *(few_statistics(p.column("text")) for p in parts)])


def few_statistics(array: pa.Array) -> np.ndarray:
    n = len(array)
    data, offsets = flat(array)
    size = np.diff(offsets)

    def count(flags: np.ndarray) -> np.ndarray:
        sums = np.r_[0, np.cumsum(flags, dtype=np.int64)]
        return sums[offsets[1:]] - sums[offsets[:-1]]

    text, starts, ends = words(data, offsets)
    n_words = np.bincount(text, minlength=n)
    hashes = word_hashes(data, starts, ends)
    order = np.lexsort((hashes, text))
    new = np.ones(len(order), bool)
    new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (text[order][1:] != text[order][:-1])
    distinct = np.bincount(text[order][new], minlength=n)
    same = np.zeros(len(text), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (text[1:] == text[:-1])
    repeats = np.bincount(text[same], minlength=n)
    full = size - count(SPACE[data])
    raw = data.tobytes()
    packed = np.array([len(zlib.compress(raw[a:b], 1)) for a, b in zip(offsets[:-1], offsets[1:], strict=True)], float)

    def odds(part: np.ndarray, whole: np.ndarray, usual: float) -> np.ndarray:
        return np.log((part + PSEUDO * usual) / (np.maximum(whole - part, 0) + PSEUDO * (1 - usual)))

    shares = [odds(count(kind[data]), full, usual) for kind, usual in zip(KINDS, ORDINARY, strict=True)]
    return np.column_stack(
        [
            np.log(n_words + PSEUDO), np.log((full + 5 * PSEUDO) / (n_words + PSEUDO)), *shares, odds(count(data == 10), size, 0.01),
            odds(distinct, n_words, 0.9), odds(repeats, n_words, 0.01), np.log((packed + 5 * PSEUDO) / (size + 10 * PSEUDO)),
        ]
    )


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def statistics_of(array: pa.Array) -> pa.Array:
    found = statistics(array)
    return pa.ListArray.from_arrays(np.arange(0, found.size + 1, len(NAMES), dtype=np.int32), found.ravel()) if len(array) else pa.array([], pa.list_(pa.float64()))


@dataclass
class Discriminant:
    """Class means, inverse Cholesky factors and log determinants; ``even`` where there is nothing to compare."""

    means: list[np.ndarray] | None = None
    inverses: list[np.ndarray] | None = None
    logs: list[float] | None = None
    even: float = 0.5

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.means is None:
            return np.full(len(x), self.even)
        densities = [log - 0.5 * (((x - m) @ inv.T) ** 2).sum(1) for m, inv, log in zip(self.means, self.inverses, self.logs, strict=True)]
        return 1 / (1 + np.exp(-np.clip(densities[1] - densities[0], -36, 36)))


def held_out(doc_id: Column) -> Column:
    """One fold of three by the id's checksum; it teaches nothing."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", train_rows: int = TRAIN_ROWS) -> Discriminant:
    """Fit the two classes from sums that Spark adds up: counts, sums and sums of products."""
    known = labels.select(column(id_col).cast("bigint").alias("id"), column(label_col).cast("int").alias("y"))
    known = known.where(F.col("id").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("id")))
    rows = known.count()
    if rows > train_rows:
        known = known.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int((1 << 30) * train_rows / rows))
    # at most about train_rows pairs of numbers
    found = docs.select(column(id_col).cast("bigint").alias("id"), F.coalesce(column(text_col).cast("string"), F.lit("")).alias("text"))
    found = found.join(F.broadcast(known), "id").select("y", statistics_of("text").alias("x"))
    d = len(NAMES)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    x = [F.col("x")[i] for i in range(d)]
    sums = found.groupBy("y").agg(
        F.count(F.lit(1)).alias("n"), F.array(*[F.sum(v) for v in x]).alias("s"), F.array(*[F.sum(x[i] * x[j]) for i, j in pairs]).alias("p")
    ).collect()  # two rows
    by = {r["y"]: r for r in sums}
    total = sum(r["n"] for r in sums)
    if len(by) < 2:
        return Discriminant(even=0.5 if not total else by[1]["n"] / total if 1 in by else 0.0)
    means, spreads, counts = [], [], []
    for y in (0, 1):
        n, mean = by[y]["n"], np.array(by[y]["s"]) / by[y]["n"]
        products = np.zeros((d, d))
        for (i, j), p in zip(pairs, by[y]["p"], strict=True):
            products[i, j] = products[j, i] = p / n
        means.append(mean)
        spreads.append(products - np.outer(mean, mean))
        counts.append(n)
    pooled = sum(n * s for n, s in zip(counts, spreads, strict=True)) / total
    level = np.trace(pooled) / d + 1e-6
    inverses, logs = [], []
    for n, s in zip(counts, spreads, strict=True):
        near = 0.05 + 0.9 * d / (d + n)
        shrunk = 0.99 * ((1 - near) * s + near * pooled) + 0.01 * level * np.eye(d)
        factor = np.linalg.cholesky(shrunk)
        inverses.append(np.linalg.inv(factor))
        logs.append(float(np.log(n / total) - np.log(np.diag(factor)).sum()))
    return Discriminant(means, inverses, logs)


def score(text: Column, model: Discriminant) -> Column:
    """The probability-like score of class 1 of each whole text."""

    @F.arrow_udf(T.DoubleType())
    def scored(array: pa.Array) -> pa.Array:
        return pa.array(model.scores(statistics(array)), pa.float64())

    return scored(F.coalesce(text.cast("string"), F.lit("")))


def keep_good(docs: DataFrame, model: Discriminant, text_col: str = "text", at: float = 0.5) -> DataFrame:
    """The rows that score at least ``at``, with all their columns as they were."""
    row = F.struct(*[column(c) for c in docs.columns]).alias("row")
    return docs.select(row, score(column(text_col), model).alias("score")).where(F.col("score") >= at).select("row.*")
