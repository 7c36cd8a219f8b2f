"""Concatenate and cut: token streams of all documents laid end to end and cut into fixed windows.

First pass: each input task tokenises its documents once, closes each with an end id, and notes where in
the task's own stream it begins. The tasks' totals are then summed in order, which turns those places
into global ones without sorting or shuffling a document. Second pass: each document is cut where its
global range crosses a multiple of the window. Windows that lie within one task's stream are whole there;
those that cross into the next are boundary records, at most two a task, and only they are shuffled.

Only the last window can be short: it is padded, unless its length is a power of two.

Token ids equal those of the ``tokenizers`` file ``byte_bpe_50k.json`` by its defaults, without added ids:
``<|endoftext|>`` inside a text is one id of its own. They are worked out with the same vocabulary as ranks, piece by piece with a memory of
frequent pieces, which takes a fifth of the time; tests hold the two against each other.

Defined results: a NULL text counts as empty and still has its end id; NULL ids pass through; repeated
rows are packed each; documents lie in the order in which they are read; an empty table has no sequence.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import prefix_sums, saved, small, texts
from veilframe.llm.words import slices

WINDOW = 1024
END_ID = 0
MARK, MARK_ID = "<|endoftext|>", 50256  # the one added token of the tokenizer file
RANKS = "byte_bpe_50k.tiktoken"
REMEMBERED = 300_000  # pieces whose ids a worker keeps

# A space next to other white space, or at an end of the text: elsewhere every space begins a piece of its own.
BLANK = r"\t-\r \x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
UNEASY = rf"^ | $|[{BLANK}] | [{BLANK}]"


@cache
def encoding(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("pieces", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@cache
def memory(path: str) -> dict[str, np.ndarray]:
    return {}


def encode(array: pa.Array, path: str) -> list[np.ndarray]:
    """The token ids of each text, a mark in it taken as ordinary text.

    A text without uneasy spaces is split before each space: the tokenizer's own pieces never cross
    such a border, so the ids of the parts, one after the other, are the ids of the text.
    """
    encoder, known = encoding(path), memory(path)
    if len(known) > REMEMBERED:
        known.clear()
    uneasy = pc.match_substring_regex(array, UNEASY).to_numpy(zero_copy_only=False)
    found: list[np.ndarray | None] = [None] * len(array)
    for i in np.flatnonzero(uneasy):
        found[i] = np.array(encoder.encode_ordinary(array[int(i)].as_py()), np.uint16)
    calm = np.flatnonzero(~uneasy)
    if not len(calm):
        return found
    split = pc.split_pattern(array.take(pa.array(calm)), " ")
    offsets = split.offsets.to_numpy()
    parts = split.values.slice(offsets[0], offsets[-1] - offsets[0])
    offsets = offsets - offsets[0]
    coded = parts.dictionary_encode()
    ids = []
    for part in coded.dictionary.to_pylist():
        one = known.get(part)
        if one is None:
            one = known[part] = np.array(encoder.encode_ordinary(" " + part), np.uint16)
        ids.append(one)
    # the first part of a text has no space before it
    codes = coded.indices.to_numpy().astype(np.int64)
    codes[offsets[:-1]] = len(ids) + np.arange(len(calm))
    ids += [np.array(encoder.encode_ordinary(p), np.uint16) for p in parts.take(pa.array(offsets[:-1])).to_pylist()]
    lengths = np.array([len(x) for x in ids])
    begins = np.cumsum(lengths) - lengths
    each = lengths[codes]
    ends = np.cumsum(each)
    stream = np.concatenate(ids)[np.repeat(begins[codes] - (ends - each), each) + np.arange(each.sum())]
    bounds = np.r_[0, ends][offsets]
    for k, i in enumerate(calm):
        found[i] = stream[bounds[k] : bounds[k + 1]]
    return found


def token_ids(array: pa.Array, path: str) -> list[np.ndarray]:
    """The token ids of each text: what lies between its marks is encoded as a text of its own."""
    if not pc.any(pc.match_substring(array, MARK)).as_py():
        return encode(array, path)
    split = pc.split_pattern(array, MARK)
    offsets = split.offsets.to_numpy()
    coded = encode(split.values.slice(offsets[0], offsets[-1] - offsets[0]), path)
    offsets = offsets - offsets[0]
    mark = np.array([MARK_ID], np.uint16)
    return [np.concatenate([x for ids in coded[a:b] for x in (mark, ids)][1:]) for a, b in zip(offsets, offsets[1:])]


def token_streams(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """First pass: (part, start, doc_id, n, ids): each document's ids as 16-bit numbers, and its place in the stream of its task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file = path or public_tokenizers.path(RANKS)  # where this worker has it
        part, at = TaskContext.get().partitionId(), 0
        for batch in (part for whole in batches for part in slices(whole, "text")):
            ids = [np.append(x, np.uint16(END_ID)) for x in token_ids(batch.column("text"), file)]
            n = np.array([len(x) for x in ids], np.int64)
            starts = at + np.cumsum(n) - n
            at += int(n.sum())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(n), part, np.int64)), pa.array(starts), batch.column("doc_id"), pa.array(n), pa.array([x.tobytes() for x in ids], pa.binary())],
                names=["part", "start", "doc_id", "n", "ids"],
            )

    return saved(texts(docs, id_col, text_col).mapInArrow(run, "part long, start long, doc_id long, n long, ids binary"), "tokens", compression="zstd")


def placed(streams: DataFrame) -> DataFrame:
    """Each document with ``at``, its global place, and the range [base, until) of its task's stream."""
    totals = saved(streams.groupBy("part").agg(F.max(F.col("start") + F.col("n")).alias("total")), "totals")
    bases = saved(prefix_sums(totals, "part", "total", "base"), "bases")
    spans = bases.select("part", "base", (F.col("base") + F.col("total")).alias("until"))
    return streams.join(small(spans), "part").select("doc_id", "n", "ids", (F.col("base") + F.col("start")).alias("at"), "base", "until")


def cut(batch: dict, i: int, window: int) -> Iterator[tuple[int, int, int, int, np.ndarray]]:
    """(start in the document, length, sequence, offset there, ids) of each piece of a document."""
    ids, at, n = np.frombuffer(batch["ids"][i], np.uint16), batch["at"][i], batch["n"][i]
    start = 0
    while start < n:
        sequence, offset = divmod(at + start, window)
        length = min(window - offset, n - start)
        yield start, length, sequence, offset, ids[start : start + length]
        start += length


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, boundary boolean"


def pack(docs: DataFrame, window: int = WINDOW, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece; ``boundary`` marks pieces of windows that two or more tasks share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, out = batch.to_pydict(), []
            for i in range(batch.num_rows):
                low, high = rows["base"][i], rows["until"][i]
                for start, length, sequence, offset, ids in cut(rows, i, window):
                    shared = sequence * window < low or (sequence + 1) * window > high
                    out.append((rows["doc_id"][i], start, length, zlib.crc32(ids.astype("<u4").tobytes()), rows["n"][i], sequence, offset, shared))
            kinds = [pa.int64()] * 7 + [pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names=[p.split()[0] for p in PIECES.split(", ")])

    return placed(token_streams(docs, path, id_col, text_col)).mapInArrow(run, PIECES)


def sequences(docs: DataFrame, window: int = WINDOW, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(sequence_id, tokens, padding): the windows themselves, 16-bit little-endian ids without the padding."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_windows: dict[int, list[tuple[int, bytes]]] = {}
        filled: dict[int, int] = {}

        def out(rows: list[tuple[int, int, bytes, bool]]) -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.bool_())
            return pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate(kinds)], names=["sequence_id", "offset", "tokens", "whole"])

        for batch in batches:
            rows, done = batch.to_pydict(), []
            for i in range(batch.num_rows):
                for _, length, sequence, offset, ids in cut(rows, i, window):
                    open_windows.setdefault(sequence, []).append((offset, ids.tobytes()))
                    filled[sequence] = filled.get(sequence, 0) + length
                    if filled[sequence] == window:
                        done.append((sequence, 0, b"".join(b for _, b in sorted(open_windows.pop(sequence))), True))
                        del filled[sequence]
            yield out(done)
        yield out([(s, o, b, False) for s, parts in open_windows.items() for o, b in parts])

    cuts = saved(placed(token_streams(docs, path, id_col, text_col)).mapInArrow(run, "sequence_id long, offset long, tokens binary, whole boolean"), "windows")
    # at most window pieces in a group
    shared = cuts.where(~F.col("whole")).groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "tokens"))).alias("p"))
    joined = shared.select("sequence_id", F.aggregate("p", F.lit(b""), lambda a, p: F.concat(a, p["tokens"])).alias("tokens"))
    length = (F.octet_length("tokens") / 2).cast("int")
    power = F.bit_count(length) == 1
    return cuts.where("whole").select("sequence_id", "tokens").unionByName(joined).withColumn("padding", F.when(power, 0).otherwise(window - length))
