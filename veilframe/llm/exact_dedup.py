"""Exact dedup by Patricia tries that own each distinct text.

Every input task first inserts its texts, as full byte strings, into a compressed radix trie of its
own, so that a group of copies leaves the task once. When the trie passes its budget the largest
subtree below the root is spilled: its owners go to the shared table and the subtree is forgotten; a
later copy simply starts anew. What is left is partitioned by length and content hash and inserted
into one trie for each (length, hash): the terminal nodes hold the owner, so texts of one length and
hash that differ in any byte are still told apart.

Defined results: a NULL text counts as empty; a NULL id is smaller than any other; of rows that repeat
both id and text exactly one stays; an empty table gives an empty result; other columns pass through.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilframe.llm.common import column, saved

TRIE_BYTES = 32 << 20  # that a task's trie and its owners take before a subtree is spilled
STEP = 512  # rows whose texts are taken out of an Arrow batch at once


class Node:
    __slots__ = ("edge", "children", "owner")

    def __init__(self, edge: bytes):
        self.edge, self.children, self.owner = edge, {}, None


def common_prefix(edge: bytes, key: bytes, at: int) -> int:
    """How many bytes of the edge agree with the key from ``at``, by halving."""
    low, high = 0, min(len(edge), len(key) - at)
    while low < high:
        middle = (low + high + 1) // 2
        if edge[:middle] == key[at : at + middle]:
            low = middle
        else:
            high = middle - 1
    return low


class Trie:
    """A compressed radix trie over byte strings; ``insert`` gives the terminal node of a string."""

    def __init__(self):
        self.root, self.sizes = Node(b""), {}

    def insert(self, key: bytes) -> Node:
        node, at = self.root, 0
        while at < len(key):
            child = node.children.get(key[at])
            if child is None:
                leaf = node.children[key[at]] = Node(key[at:])
                # the edge, the owner's key and, in whole rows, the text once more
                self.sizes[key[0]] = self.sizes.get(key[0], 0) + 3 * len(key) - at + 1000
                return leaf
            if key.startswith(child.edge, at):
                node, at = child, at + len(child.edge)
                continue
            n = common_prefix(child.edge, key, at)
            middle = node.children[key[at]] = Node(child.edge[:n])
            child.edge = child.edge[n:]
            middle.children[child.edge[0]] = child
            node, at = middle, at + n
        return node

    def owners(self, node: Node | None = None) -> Iterator[list]:
        stack = [node or self.root]
        while stack:
            top = stack.pop()
            stack.extend(top.children.values())
            if top.owner is not None:
                yield top.owner

    def spill(self) -> Iterator[list]:
        """Take the largest subtree below the root out of the trie and give its owners."""
        byte = max(self.sizes, key=self.sizes.get)
        del self.sizes[byte]
        yield from self.owners(self.root.children.pop(byte))


def better(new: tuple, old: tuple, largest: bool) -> bool:
    """Whether (id, row) takes over; a NULL id never does from one that is set; ties go to the first row."""
    if new[0] is None or old[0] is None:
        return old[0] is None and (new[0] is not None or new[1] < old[1])
    return (new[0], -new[1]) > (old[0], -old[1]) if largest else new < old


FOUND = [
    T.StructField("row_key", T.LongType()), T.StructField("doc_id", T.LongType()), T.StructField("rep", T.LongType()),
    T.StructField("length", T.LongType()), T.StructField("hash", T.LongType()), T.StructField("copies", T.LongType()), T.StructField("sha", T.StringType()),
]
TEXT = T.StructField("text", T.BinaryType())


def texts_of(batch: pa.RecordBatch, text_col: str | None) -> list[bytes]:
    """The texts of a batch: a column of their own, or a field of the whole rows, so that they travel once."""
    if text_col is None:
        return batch.column("text").to_pylist()
    return pc.fill_null(pc.struct_field(batch.column("row"), text_col).cast(pa.string()), "").cast(pa.binary()).to_pylist()


def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (batch.slice(j, STEP) for batch in batches for j in range(0, batch.num_rows, STEP))


def local_owners(df: DataFrame, id_col: str, text_col: str, largest: bool, whole_rows: bool, trie_bytes: int) -> DataFrame:
    """One table of two kinds of rows. Members (copies NULL): each row and the first row of its text in its task.

    Owners: each distinct text of a task (or of what it spilled) with the row that would stay, and how many rows share it.
    """
    schema = T.StructType([*FOUND, T.StructField("row", T.StructType(df.schema.fields)) if whole_rows else TEXT])
    row = F.struct(*[column(c) for c in df.columns]).alias("row")
    text = F.coalesce(column(text_col).cast("string"), F.lit("")).cast("binary").alias("text")
    source = df.select(column(id_col).cast("bigint").alias("doc_id"), row if whole_rows else text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 33
        trie, n, kind = Trie(), 0, None

        def out(columns: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([x.cast(t) if x.type != t else x for x, t in zip(columns, kind.types, strict=True)], schema=kind)

        def owners(found: Iterator[list]) -> Iterator[pa.RecordBatch]:
            part: list[list] = []
            for owner in found:
                part.append(owner)
                if len(part) == 512:
                    yield flush(part)
                    part = []
            if part:
                yield flush(part)

        def flush(part: list[list]) -> pa.RecordBatch:
            # owner: [(id, row), rep, copies, sha, text, row of the table]
            columns = [
                pa.array([o[0][1] for o in part], pa.int64()), pa.array([o[0][0] for o in part], pa.int64()), pa.array([o[1] for o in part], pa.int64()),
                pa.array([len(o[4]) for o in part], pa.int64()), pa.array([int.from_bytes(bytes.fromhex(o[3][:16]), "big", signed=True) for o in part], pa.int64()),
                pa.array([o[2] for o in part], pa.int64()), pa.array([o[3] for o in part]),
            ]
            return out([*columns, pa.concat_arrays([o[5] for o in part]) if whole_rows else pa.array([o[4] for o in part], pa.binary())])

        for batch in steps(batches):
            if kind is None:
                fields = [("row_key", pa.int64()), ("doc_id", pa.int64()), ("rep", pa.int64()), ("length", pa.int64()), ("hash", pa.int64()), ("copies", pa.int64()), ("sha", pa.string())]
                kind = pa.schema([*fields, ("row", batch.schema.field("row").type) if whole_rows else ("text", pa.binary())])
            ids, rows = batch.column("doc_id").to_pylist(), batch.column("row") if whole_rows else None
            reps, shas = [], []
            for i, key in enumerate(texts_of(batch, text_col if whole_rows else None)):
                node, me = trie.insert(key), (ids[i], base | (n + i))
                if node.owner is None:
                    node.owner = [me, me[1], 1, hashlib.sha256(key).hexdigest(), key, rows.take(pa.array([i])) if whole_rows else None]
                else:
                    node.owner[2] += 1
                    if better(me, node.owner[0], largest):
                        node.owner[0] = me
                        if whole_rows:
                            node.owner[5] = rows.take(pa.array([i]))
                reps.append(node.owner[1])
                shas.append(node.owner[3])
                if sum(trie.sizes.values()) > trie_bytes:
                    yield from owners(trie.spill())
            size = len(ids)
            empty = [pa.nulls(size, t) for t in kind.types]
            members = [pa.array(range(base | n, (base | n) + size), pa.int64()), pa.array(ids, pa.int64()), pa.array(reps, pa.int64()), *empty[3:6], pa.array(shas), *empty[7:]]
            n += size
            yield out(members)
        if kind is not None:
            yield from owners(trie.owners())

    return saved(source.mapInArrow(run, schema), "exact-owners")


def by_content(found: DataFrame) -> DataFrame:
    """The owners of all tasks, those of one length and content hash together and in a row."""
    return found.where(F.col("copies").isNotNull()).repartition("length", "hash").sortWithinPartitions("length", "hash")


def merged(batches: Iterator[pa.RecordBatch], largest: bool, text_col: str | None = None) -> Iterator[list[list]]:
    """For each (length, hash), its terminals: [owner (id, row), all copies, reps that share it, row of the table]."""
    trie, at = Trie(), None
    whole_rows = text_col is not None
    for batch in steps(batches):
        length, content, ids, keys, reps, copies = (batch.column(c).to_pylist() for c in ("length", "hash", "doc_id", "row_key", "rep", "copies"))
        rows = batch.column("row") if whole_rows else None
        for i, text in enumerate(texts_of(batch, text_col)):
            if at != (length[i], content[i]):
                if at is not None:
                    yield list(trie.owners())
                trie, at = Trie(), (length[i], content[i])
            node, me = trie.insert(text), (ids[i], keys[i])
            kept = rows.take(pa.array([i])) if whole_rows else None
            if node.owner is None:
                node.owner = [me, copies[i], [reps[i]], kept]
            else:
                node.owner[1] += copies[i]
                node.owner[2].append(reps[i])
                if better(me, node.owner[0], largest):
                    node.owner[0], node.owner[3] = me, kept
    if at is not None:
        yield list(trie.owners())


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    largest = keep == "largest"
    found = local_owners(docs, id_col, text_col, largest, False, trie_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for owners in merged(batches, largest):
            flat = [(rep, o[0][0], o[0][1], o[1]) for o in owners for rep in o[2]]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*flat, strict=True)], names=["rep", "keep_id", "keep_row", "group_size"])

    groups = by_content(found).select("length", "hash", "doc_id", "row_key", "rep", "copies", "text").mapInArrow(run, "rep long, keep_id long, keep_row long, group_size long")
    members = found.where(F.col("copies").isNull()).select("row_key", "doc_id", "rep", "sha")
    return members.join(saved(groups, "exact-groups"), "rep").select(
        "doc_id", "keep_id", "group_size", (F.col("row_key") == F.col("keep_row")).alias("kept"), F.col("sha").alias("text_sha256")
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """The rows that stay, with all their columns as they were."""
    largest = keep == "largest"
    found = local_owners(docs, id_col, text_col, largest, True, trie_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part: list = []
        for owners in merged(batches, largest, text_col):
            part.extend(o[3] for o in owners)
            if len(part) >= 512:
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(part)], names=["row"])
                part = []
        if part:
            yield pa.RecordBatch.from_arrays([pa.concat_arrays(part)], names=["row"])

    kept = by_content(found).select("length", "hash", "doc_id", "row_key", "rep", "copies", "row")
    kept = kept.mapInArrow(run, T.StructType([T.StructField("row", T.StructType(docs.schema.fields))]))
    return kept.select("row.*")
