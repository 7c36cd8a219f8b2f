"""Ranked lexical search: an Aho-Corasick automaton of all item terms counts term frequencies straight from the texts.

Every pattern is a term between two gaps, so only whole terms match. The automaton's outputs are term numbers; a table of
term to items turns a document's counts into scores. The documents are scanned twice and nothing is stored about them:
the first scan sums, per task, in how many documents each item term occurs, the number of documents and of terms; with
these the second scores every document for every item, and each task hands on its best ``k`` documents per item.

The automaton goes to the tasks by broadcast. Items are dealt into blocks of at most about ``BLOCK_BYTES`` of text and
``BLOCK_ITEMS`` items (a longer item is a block of its own); more items mean more blocks, each with its two scans.

Defined results: a NULL or empty text, of a document or an item, has no terms; an item without terms has no rows. Rows that
share an item id, NULL as well, are one item with the terms of all of them. Repeated documents rank each by itself, equal
scores by ascending id, a missing id last. A text of any length is scanned in pieces cut at gaps. Empty tables give no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilframe.llm.common import texts
from veilframe.llm.terms import GAP, blocks, bounds, folded, terms_of
from veilframe.llm.words import slices

BLOCK_BYTES = 1 << 20
BLOCK_ITEMS = 1 << 12
PIECE = 4 << 20  # bytes of text that the automaton reads at once
CELLS = 1 << 21  # (document, term, item) triples that are added up at once
DOCS, TERMS = -1, -2  # the first scan's rows for the number of documents with terms, and of terms


@dataclass
class Vocabulary:
    """The terms of a block of items and, per term, the items that hold it and how often."""

    items: list[str | None]
    terms: list[bytes]
    first: np.ndarray  # where a term's items begin
    item: np.ndarray
    times: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple[str | None, str]]) -> Vocabulary:
        held: dict[str | None, Counter] = {}
        for name, text in rows:
            held.setdefault(name, Counter()).update(terms_of(text))
        items = list(held)
        terms = sorted(set(chain.from_iterable(held.values())))
        number = {t: i for i, t in enumerate(terms)}
        entries = np.array([(number[t], i, n) for i, name in enumerate(items) for t, n in held[name].items()], np.int64).reshape(-1, 3)
        entries = entries[np.lexsort((entries[:, 1], entries[:, 0]))]
        return cls(items, terms, np.searchsorted(entries[:, 0], np.arange(len(terms) + 1)), entries[:, 1], entries[:, 2])

    def automaton(self) -> ahocorasick.Automaton:
        machine = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for i, term in enumerate(self.terms):
            machine.add_word(f" {term.decode('latin-1')} ", i)
        machine.make_automaton()
        return machine


def pieces(data: np.ndarray) -> Iterator[tuple[int, str]]:
    """(where it begins, piece) of folded bytes, one character a byte; neighbours share the gap between them."""
    text, begin = data.tobytes().decode("latin-1"), 0
    while begin < len(text) - 1:
        end = text.find(chr(GAP), min(begin + PIECE, len(text) - 1))
        yield begin, text[begin : end + 1]
        begin = end


def term_counts(batch: pa.RecordBatch, machine: ahocorasick.Automaton, terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, term, times) of the item terms in a batch, and the number of all terms of each document."""
    data, gaps = folded(batch.column("text"))
    starts, _ = bounds(data)
    length = np.diff(np.searchsorted(starts, gaps))
    found = [np.zeros(0, np.int64)]
    for begin, piece in pieces(data):
        hits = np.fromiter(chain.from_iterable(machine.iter(piece)), np.int64).reshape(-1, 2)
        found.append((np.searchsorted(gaps, hits[:, 0] + begin, "left") - 1) * terms + hits[:, 1])
    pair, times = np.unique(np.concatenate(found), return_counts=True)
    return pair // max(terms, 1), pair % max(terms, 1), times, length


def search(docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): each item's ``k`` best documents with a score above 0."""
    rows = texts(docs, id_col, text_col)
    dealt, count = blocks(items, BLOCK_BYTES, BLOCK_ITEMS, item_col, item_text)
    best = None
    for block in range(count):
        words = Vocabulary.of([(r.item_id, r.text) for r in dealt.where(F.col("block") == block).collect()])
        if not words.terms:
            continue
        part = _best_of_tasks(rows, words, k)
        best = part if best is None else best.union(part)
    if best is None:
        best = rows.limit(0).select(F.lit("").alias("item_id"), "doc_id", F.lit(0).cast("bigint").alias("score"))
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select(F.col("item_id").cast(items.select(f"`{item_col}`").schema[0].dataType), "rank", "doc_id", "score")


def _best_of_tasks(rows: DataFrame, words: Vocabulary, k: int) -> DataFrame:
    sc, sizes = rows.sparkSession.sparkContext, len(words.terms)
    shared = sc.broadcast(words)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, holding, totals = shared.value.automaton(), np.zeros(sizes, np.int64), np.zeros(2, np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                _, term, _, length = term_counts(part, machine, sizes)
                holding += np.bincount(term, minlength=sizes)
                totals += (np.count_nonzero(length), length.sum())
        yield pa.record_batch([pa.array(np.r_[np.arange(sizes), DOCS, TERMS]), pa.array(np.r_[holding, totals])], ["term", "n"])

    counted = rows.mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    got = {r.term: r.n for r in counted.collect()}  # one row a term of the block, and two
    n_docs, n_terms = got.get(DOCS, 0), got.get(TERMS, 0)
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * got.get(t, 0) + 1))) for t in range(sizes)], np.int64)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value
        machine, n_items = vocabulary.automaton(), len(vocabulary.items)
        kept = np.zeros((0, 4), np.int64)  # item, score, id is missing, id
        least = np.ones(n_items, np.int64)  # what a document must score to be among an item's best
        for batch in batches:
            for part in slices(batch, "text"):
                doc, term, times, length = term_counts(part, machine, sizes)
                m = 75 + (25 * length * n_docs) // max(n_terms, 1)
                worth = weight[term] * ((1_000_000_000 * times) // (1000 * times + 12 * m[doc]))
                scores = np.zeros(part.num_rows * n_items, np.int64)
                reach = np.cumsum(np.diff(vocabulary.first)[term])
                begin = 0
                while begin < len(doc):
                    end = max(int(np.searchsorted(reach, (reach[begin - 1] if begin else 0) + CELLS, "right")), begin + 1)
                    fan = np.diff(vocabulary.first)[term[begin:end]]
                    at = np.arange(fan.sum()) - np.repeat(np.cumsum(fan) - fan, fan) + np.repeat(vocabulary.first[term[begin:end]], fan)
                    np.add.at(scores, np.repeat(doc[begin:end], fan) * n_items + vocabulary.item[at], np.repeat(worth[begin:end], fan) * vocabulary.times[at])
                    begin = end
                scores = scores.reshape(-1, n_items)
                doc, item = np.nonzero(scores >= least)
                ids = part.column("doc_id")
                missing = np.asarray(ids.is_null(), np.int64)
                ids = ids.fill_null(0).to_numpy(zero_copy_only=False)
                kept = np.concatenate([kept, np.stack([item, scores[doc, item], missing[doc], ids[doc]], 1)])
                kept = kept[np.lexsort((kept[:, 3], kept[:, 2], -kept[:, 1], kept[:, 0]))]
                begins = np.searchsorted(kept[:, 0], np.arange(n_items))
                kept = kept[np.arange(len(kept)) - begins[kept[:, 0]] < k]
                begins, ends = np.searchsorted(kept[:, 0], np.arange(n_items)), np.searchsorted(kept[:, 0], np.arange(n_items), "right")
                full = ends - begins == k
                least[full] = kept[ends[full] - 1, 1]
        names = pa.array([vocabulary.items[i] for i in kept[:, 0]], pa.string())
        yield pa.record_batch([names, pa.array(kept[:, 3], mask=kept[:, 2] > 0), pa.array(kept[:, 1])], ["item_id", "doc_id", "score"])

    return rows.mapInArrow(score, "item_id string, doc_id long, score long")
