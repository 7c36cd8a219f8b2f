"""Benchmark decontamination: an FM-index over each shard of the training texts, searched for the items' windows.

A window is ``length`` consecutive words of an item, or all words of a shorter one. A shard is at most about ``SHARD_BYTES``
of texts in one task: its words become numbers, their suffixes are sorted into an ``FMIndex``, every window is searched
backwards through the index, and its places are located by sampled suffix positions. The words of all places are merged
into spans to remove. A place counts only where the words' bytes are the window's, whatever their hashes.

Nothing is shuffled: documents are indexed where they are read. The windows go to the tasks by broadcast; items are dealt
into blocks of at most about ``BLOCK_BYTES`` of text, and more blocks mean more rounds of indexing over the same rows.

Defined results: a NULL or empty text has no words; a NULL document id or repeated row is a row as any other; an item
without words has no windows; rows that share an item id are one item with the windows of each row; an item without id is
an item, with NULL among the ids. A text longer than a shard is indexed in pieces that share ``length`` - 1 words. Empty
tables give no rows, or no hits. Other columns, whatever they are called, are carried along by ``decontaminate``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import column
from veilframe.llm.fm_index import FMIndex
from veilframe.llm.terms import GAP, blocks, bounds, folded, terms_of
from veilframe.llm.words import flat, slices, word_hashes

WINDOW = 10
SHARD_BYTES = 4 << 20
SHARD_ROWS = 1 << 16
BLOCK_BYTES = 1 << 20
BLOCK_ITEMS = 1 << 16
ROWS_AT_ONCE = 1 << 20  # places that are located at once

SPANS = "array<struct<start:int,end:int,word:int,words:int>>"


@dataclass
class Windows:
    """The distinct windows of a block of items, and the items that hold each."""

    items: list[str | None]
    bytes: np.ndarray  # of all words, one after the other
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    by_length: dict[int, tuple[np.ndarray, np.ndarray]]  # words in a window: (window numbers, word numbers)
    first: np.ndarray  # where a window's items begin
    holders: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple[str | None, str]], length: int) -> Windows:
        word_number: dict[bytes, int] = {}
        number: dict[tuple[int, ...], int] = {}
        item_number: dict[str | None, int] = {}
        holds = set()
        for name, text in rows:
            item = item_number.setdefault(name, len(item_number))
            words = [word_number.setdefault(w, len(word_number)) for w in terms_of(text)]
            for begin in range(max(len(words) - length + 1, min(len(words), 1))):
                window = tuple(words[begin : begin + length])
                holds.add((number.setdefault(window, len(number)), item))
        data, offsets = flat(pa.array(list(word_number), pa.large_binary()))
        lengths = np.array([len(w) for w in number], np.int64)
        windows = list(number)
        grouped = {}
        for size in np.unique(lengths):
            chosen = np.flatnonzero(lengths == size)
            grouped[int(size)] = (chosen, np.array([windows[i] for i in chosen], np.int64))
        pairs = np.array(sorted(holds), np.int64).reshape(-1, 2)
        first = np.searchsorted(pairs[:, 0], np.arange(len(number) + 1))
        return cls(list(item_number), data, offsets[:-1], offsets[1:], word_hashes(data, offsets[:-1], offsets[1:]), grouped, first, pairs[:, 1])


def _same_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, windows: Windows, words: np.ndarray) -> np.ndarray:
    """Whether the bytes of each word are those of the window word with that number."""
    size = ends - starts
    same = size == windows.ends[words] - windows.starts[words]
    size = np.where(same, size, 0)
    begin = np.cumsum(size) - size
    at = np.arange(size.sum()) - np.repeat(begin, size)
    differ = data[at + np.repeat(starts, size)] != windows.bytes[at + np.repeat(windows.starts[words], size)]
    wrong = np.r_[0, np.cumsum(differ)]
    return same & (wrong[begin + size] == wrong[begin])


def _places(data: np.ndarray, gaps: np.ndarray, starts: np.ndarray, ends: np.ndarray, windows: Windows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, number of words, window) of each place in a shard where a window occurs."""
    nothing = np.zeros((0, 3), np.int64)
    if not len(starts):
        return nothing[:, 0], nothing[:, 1], nothing[:, 2]
    hashes = word_hashes(data, starts, ends)
    distinct, symbols = np.unique(hashes, return_inverse=True)
    doc = np.searchsorted(gaps, starts, "right") - 1
    sequence = np.zeros(len(starts) + len(gaps) - 1, np.int64)
    sequence[np.arange(len(starts)) + doc] = symbols + 1
    doc_begins = np.searchsorted(starts, gaps[:-1]) + np.arange(len(gaps) - 1)
    index = FMIndex(sequence)
    near = np.minimum(np.searchsorted(distinct, windows.hashes), len(distinct) - 1)
    symbol_of = np.where(distinct[near] == windows.hashes, near + 1, 0)
    found = [nothing]
    for size, (numbers, words) in windows.by_length.items():
        phrases = symbol_of[words]
        whole = np.flatnonzero((phrases > 0).all(1))
        low, high = index.search(phrases[whole])
        times = np.maximum(high - low, 0)
        reach = np.cumsum(times)
        begin = 0
        while begin < len(whole):
            end = max(int(np.searchsorted(reach, (reach[begin - 1] if begin else 0) + ROWS_AT_ONCE, "right")), begin + 1)
            some = times[begin:end]
            rows = np.arange(some.sum()) - np.repeat(np.cumsum(some) - some, some) + np.repeat(low[begin:end], some)
            place = index.locate(rows)
            word = place - (np.searchsorted(doc_begins, place, "right") - 1)
            which = np.repeat(whole[begin:end], some)
            pair, back = np.unique((word[:, None] + np.arange(size)) * len(windows.hashes) + words[which], return_inverse=True)
            at, wanted = pair // len(windows.hashes), pair % len(windows.hashes)
            right = _same_words(data, starts[at], ends[at], windows, wanted)[back.reshape(-1, size)].all(1)
            found.append(np.stack([word, np.full(len(word), size), numbers[which]], 1)[right])
            begin = end
    word, size, window = np.concatenate(found).T
    return word, size, window


def _pieces(data: np.ndarray, overlap: int) -> Iterator[tuple[int, np.ndarray]]:
    """(where it begins, piece) of a folded text: neighbours share ``overlap`` words."""
    begin, size = 0, SHARD_BYTES
    while begin + 2 * size < len(data):
        end = begin + size + int(np.argmax(data[begin + size :] == GAP))
        piece = data[begin : end + 1]
        starts, _ = bounds(piece)
        if len(starts) <= overlap:
            size *= 2
            continue
        yield begin, piece
        begin += int(starts[-overlap]) - 1 if overlap else end - begin
    yield begin, data[begin:]


def _search(batch: pa.RecordBatch, windows: Windows, length: int) -> pa.RecordBatch:
    """The batch with the windows' hits added to those it has already."""
    rows = batch.num_rows
    data, gaps = folded(batch.column("text"))
    known = batch.column("spans").to_pylist()
    hits, owners, n_words, base = [], [np.zeros((0, 2), np.int64)], np.zeros(rows, np.int64), 0
    several = rows == 1 and len(data) > 2 * SHARD_BYTES
    for begin, piece in _pieces(data, length - 1) if several else [(0, data)]:
        ends_of_docs = np.array([0, len(piece) - 1]) if several else gaps
        starts, ends = bounds(piece)
        word, size, window = _places(piece, ends_of_docs, starts, ends, windows)
        first = np.searchsorted(starts, ends_of_docs)
        doc = np.searchsorted(ends_of_docs, starts, "right") - 1
        edge = np.bincount(word, minlength=len(starts) + 1) - np.bincount(word + size, minlength=len(starts) + 1)
        for d in range(rows):
            for span in known[d] or ():
                lo, hi = np.clip([span["word"] - base, span["word"] + span["words"] - base], 0, first[d + 1] - first[d]) + first[d]
                edge[lo] += 1
                edge[hi] -= 1
        hit = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
        hits.append(np.stack([doc[hit], hit - first[doc[hit]] + base, starts[hit] + begin, ends[hit] + begin], 1))
        owners.append(np.unique(np.stack([doc[word], window], 1), axis=0))
        n_words = np.diff(first) + base
        base += max(len(starts) - (length - 1), 0)
    hit, owner = np.concatenate(hits), np.unique(np.concatenate(owners), axis=0)
    if several:
        hit = hit[np.unique(hit[:, 1], return_index=True)[1]]
    # runs of neighbouring words; places of bytes become places of code points within the text
    doc, word, start, end = hit.T
    opens = np.r_[True, (doc[1:] != doc[:-1]) | (word[1:] != word[:-1] + 1)] if len(hit) else np.zeros(0, bool)
    closes = np.r_[opens[1:], True] if len(hit) else opens
    points = np.r_[0, np.cumsum((np.insert(flat(batch.column("text"))[0], flat(batch.column("text"))[1], GAP) & 0xC0) != 0x80)] if len(hit) else np.zeros(1, np.int64)
    owner_doc = doc[opens]
    at = points[gaps[owner_doc] + 1] if len(hit) else owner_doc
    runs = np.flatnonzero(opens)
    sizes = np.diff(np.r_[runs, len(hit)])
    spans = pa.StructArray.from_arrays(
        [pa.array(points[start[opens]] - at, pa.int32()), pa.array(points[end[closes]] - at, pa.int32()), pa.array(word[opens], pa.int32()), pa.array(sizes, pa.int32())],
        ["start", "end", "word", "words"],
    )
    spans = pa.ListArray.from_arrays(pa.array(np.searchsorted(owner_doc, np.arange(rows + 1)), pa.int32()), spans)
    names = [set(n or ()) for n in batch.column("item_ids").to_pylist()]
    for d, window in owner:
        names[d].update(windows.items[i] for i in windows.holders[windows.first[window] : windows.first[window + 1]])
    values = {
        "n_words": pa.array(n_words, pa.int64()), "n_hit": pa.array(np.bincount(doc, minlength=rows), pa.int64()), "spans": spans,
        "item_ids": pa.array([sorted(n, key=lambda x: (x is None, x)) for n in names], pa.list_(pa.string())),
    }
    return pa.record_batch([values.get(name, batch.column(i)) for i, name in enumerate(batch.schema.names)], batch.schema.names)


def contamination(docs: DataFrame, items: DataFrame, carried: list[Column], text: str = "text", length: int = WINDOW, item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(carried columns, text, n_words, n_hit, spans, item_ids) for every row: what of its text occurs in which items.

    A span's ``start`` and ``end`` are code points of the text, end exclusive; ``word`` and ``words`` say which words it holds.
    """
    empty = [F.lit(0).cast("bigint").alias("n_words"), F.lit(0).cast("bigint").alias("n_hit"), F.array().cast(SPANS).alias("spans"), F.array().cast("array<string>").alias("item_ids")]
    found = docs.select(*carried, F.coalesce(column(text).cast("string"), F.lit("")).alias("text"), *empty)
    dealt, count = blocks(items, BLOCK_BYTES, BLOCK_ITEMS, item_col, item_text)
    for block in range(count):
        shared = docs.sparkSession.sparkContext.broadcast(Windows.of([(r.item_id, r.text) for r in dealt.where(F.col("block") == block).collect()], length))

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, "text", SHARD_BYTES, SHARD_ROWS):
                    yield _search(part, shared.value, length)

        found = found.mapInArrow(search, found.schema)
    return found


def without(text: Column, spans: Column) -> Column:
    """The text without the spans."""
    def kept(i: Column) -> Column:
        begin = F.coalesce(F.get(spans, i - 1)["end"], F.lit(0))
        return F.substr(text, begin + 1, F.coalesce(F.get(spans, i)["start"], F.length(text)) - begin)

    return F.array_join(F.transform(F.sequence(F.lit(0), F.size(spans)), kept), "")


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text", length: int = WINDOW) -> DataFrame:
    """The rows with all their columns, and without the words that occur in windows of the items."""
    found = contamination(docs, items, [F.struct(*[column(c) for c in docs.columns]).alias("row")], text, length)
    clean = F.when(F.size("spans") == 0, F.col("row").getField(text)).otherwise(without(F.col("text"), F.col("spans")))
    return found.select(*[clean.alias(c) if c == text else F.col("row").getField(c).alias(c) for c in docs.columns])
