"""Near-duplicate classes by ProbMinHash over weighted five-word shingles.

A shingle weighs as often as it occurs in its text. The elements of a text arrive as Poisson processes
whose rates are their weights: the nth arrival of a shingle comes an exponential step after the one
before, and falls on a random place of the signature; a place keeps its earliest arrival. Shingles whose next
arrival is later than every place's earliest one take no further part. Two signatures agree in a place
with the probability Jaccard similarity of the texts, which for texts without repeated shingles is plain
Jaccard similarity.

Signatures are cut into bands. Texts that share a band are candidates; pairs are checked on their whole
texts. First every text is compared with its bucket's first text, and verified links make components.
Then buckets that still hold two or more components compare what lies in different ones, in blocks of
bounded size: pairs whose signatures may reach the threshold are checked exactly inside the task, each in
the first bucket that both share, and only links leave it. So most of a bucket of thousands of close
copies costs one comparison each, no list of pairs is made, and no link between different components is lost.

Words are lower-cased and split at ASCII white space; a text of fewer than five words is one shingle; a
text without words is only ever like texts equal to it. Equal texts are one node.

Defined results: a NULL text counts as empty; a NULL id is smaller than any other but never names a
class that has another; repeated rows are members each; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import column, components, discard, saved, small
from veilframe.llm.words import flat, mix, slices, word_hashes, words

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 36, 6  # a pair at 0.8 shares no band once in 55,000
PLACES = BANDS * ROWS
# Agreeing places below which a pair at 0.8 falls once in a million: mean less 4.75 standard deviations.
LEAST = int(SIMILARITY * PLACES - 4.75 * np.sqrt(PLACES * SIMILARITY * (1 - SIMILARITY)))
BLOCK = 256  # texts of a bucket in one block
WORD_STEP = np.uint64(0xD6E8FEB86659FD93)


def shingles(array: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle, count) of each distinct shingle of each text, by text and shingle."""
    data, offsets = flat(pc.utf8_lower(array))
    text, starts, ends = words(data, offsets)
    hashes = word_hashes(data, starts, ends)
    n_words = np.bincount(text, minlength=len(array))
    if not len(hashes):
        none = np.zeros(0, np.int64)
        return none, none.astype(np.uint64), none
    # windows of five words; one that leaves its text counts only where the text is shorter than that
    padded = np.r_[hashes, np.zeros(WORDS - 1, np.uint64)]
    left = (np.cumsum(n_words)[text] - np.arange(len(text))).astype(np.int64)  # words of the text from here on
    total = np.zeros(len(hashes), np.uint64)
    for i in range(WORDS):
        total = mix(total * WORD_STEP + np.where(left > i, padded[i : i + len(hashes)], np.uint64(0)))
    first = np.r_[True, text[1:] != text[:-1]]
    use = (left >= WORDS) | first
    text, total = text[use], total[use]
    order = np.lexsort((total, text))
    text, total = text[order], total[order]
    new = np.flatnonzero(np.r_[True, (total[1:] != total[:-1]) | (text[1:] != text[:-1])])
    return text[new], total[new], np.diff(np.r_[new, len(total)])


def signatures(n: int, text: np.ndarray, shingle: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The signature of each of n texts: in each place the shingle that arrives there first (0 where none does)."""
    earliest = np.full(n * PLACES, np.inf)
    holder = np.zeros(n * PLACES, np.uint64)
    at, key, rate, time = text, shingle, count.astype(float), np.zeros(len(text))
    step = np.uint64(0)
    while len(at):
        step += np.uint64(1)
        draw = mix(key ^ mix(np.full(1, step, np.uint64)))
        time = time - np.log1p(-(draw >> np.uint64(11)).astype(float) / 2.0**53) / rate
        place = at * PLACES + ((mix(draw) >> np.uint64(32)) * np.uint64(PLACES) >> np.uint64(32)).astype(np.int64)
        np.minimum.at(earliest, place, time)
        won = earliest[place] == time
        holder[place[won]] = key[won]
        latest = earliest.reshape(n, PLACES).max(1)
        on = time < latest[at]
        at, key, rate, time = at[on], key[on], rate[on], time[on]
    return holder.reshape(n, PLACES)


def weigh(text: str) -> tuple[np.ndarray, np.ndarray, frozenset | None]:
    """The weighted set of one text: its distinct shingles in order, their counts, and the plain set if all count once."""
    _, shingle, count = shingles(pa.array([text], pa.string()))
    return shingle, count, frozenset(shingle.tolist()) if (count == 1).all() else None


remembered = lru_cache(maxsize=1024)(weigh)


def weighed(text: str) -> tuple[np.ndarray, np.ndarray, frozenset | None]:
    """What ``weigh`` gives, kept for texts of ordinary length."""
    return remembered(text) if len(text) < 1 << 12 else weigh(text)


def similarity(a: tuple[np.ndarray, np.ndarray, frozenset | None], b: tuple[np.ndarray, np.ndarray, frozenset | None]) -> float:
    """The probability Jaccard similarity of two weighted sets; of plain ones it is Jaccard similarity."""
    if a[2] is not None and b[2] is not None:
        shared = len(a[2] & b[2])
        return shared / max(len(a[2]) + len(b[2]) - shared, 1)
    common, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(common):
        return 0.0
    x, y = a[1][i].astype(float), b[1][j].astype(float)
    only_x, only_y = a[1].sum() - x.sum(), b[1].sum() - y.sum()
    # 1 / sum over all elements e of max(x_e / x_i, y_e / y_i), with elements by the ratio of their weights
    ratio = x / y
    order = np.argsort(ratio)
    x, y, ratio = x[order], y[order], ratio[order]
    above = only_x + np.cumsum(x[::-1])[::-1]  # of ratios from this one on
    below = only_y + np.cumsum(y) - y
    return float((1 / (above / x + below / y)).sum())


def sketch(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, doc_id, sha, bands, signature): one row per input row, all of bounded size.

    Bands are NULL for texts without words. Of a signature one byte a place is kept.
    """
    text = F.coalesce(column(text_col).cast("string"), F.lit(""))
    source = docs.select(column(id_col).cast("bigint").alias("doc_id"), F.unhex(F.sha2(text, 256)).alias("sha"), text.alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 33
        for whole in batches:
            for batch in slices(whole, "text"):
                n = batch.num_rows
                found = signatures(n, *shingles(batch.column("text")))
                key = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (n, 1))
                for r in range(ROWS):
                    key = mix(key * WORD_STEP + found[:, r::ROWS])
                lists = pa.ListArray.from_arrays(np.arange(0, n * BANDS + 1, BANDS, dtype=np.int32), key.view(np.int64).ravel())
                bands = pc.if_else(pa.array(found.any(1)), lists, pa.scalar(None, lists.type))
                small_bytes = (mix(found) & np.uint64(255)).astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(at, at + n)), batch.column("doc_id"), batch.column("sha"), bands, pa.array([x.tobytes() for x in small_bytes], pa.binary())],
                    names=["row", "doc_id", "sha", "bands", "signature"],
                )
                at += n

    return saved(source.mapInArrow(run, "row long, doc_id long, sha binary, bands array<long>, signature binary"), "sketches", compression="zstd")


def node_texts(docs: DataFrame, nodes: DataFrame, shas: DataFrame, text_col: str) -> DataFrame:
    """(node, text) of the given nodes. Only their texts are kept by the scan while the nodes are few, and one copy of each."""
    text = F.coalesce(column(text_col).cast("string"), F.lit(""))
    wanted = saved(nodes.join(shas, "node"), "wanted")
    found = docs.select(F.unhex(F.sha2(text, 256)).alias("sha"), text.alias("text")).join(small(wanted), "sha")
    return saved(found.groupBy("node").agg(F.first("text").alias("text")), "node-texts", compression="zstd")


def verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """(a, b, similarity) of the pairs of texts that reach the threshold, worked out on whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            found = [similarity(weighed(x.as_py()), weighed(y.as_py())) for x, y in zip(batch.column("text_a"), batch.column("text_b"), strict=True)]
            keep = [i for i, s in enumerate(found) if s >= threshold]
            yield pa.RecordBatch.from_arrays(
                [pa.array([a[i] for i in keep], pa.int64()), pa.array([b[i] for i in keep], pa.int64()), pa.array([found[i] for i in keep], pa.float64())], names=["a", "b", "similarity"]
            )

    # the popular side (a) comes last: its texts are joined, not shuffled once more with every pair
    both = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b").join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long, similarity double")


def left_links(buckets: DataFrame, sketches: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """(a, b): links between texts of one bucket that were in different components.

    ``buckets`` are (key, node, part). Of each bucket the component with most members is at home, and is compared with
    the others only from their side. Members are dealt to blocks of about BLOCK by a hash, those at home and the others
    apart. A group is a block at home with one of others, or a pair of blocks of others, so a text at home is copied once
    for each block of others, however many are at home. Components that a group has linked are not compared again in it.
    """
    sizes = buckets.groupBy("key", "part").agg(F.count(F.lit(1)).alias("n"))
    mixed = sizes.groupBy("key").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("parts"), F.max(F.struct("n", "part")).alias("top")).where(F.col("parts") > 1)
    mixed = mixed.select(
        "key", F.col("top.part").alias("home"), F.ceil(F.col("top.n") / BLOCK).cast("int").alias("homes"), F.ceil((F.col("n") - F.col("top.n")) / BLOCK).cast("int").alias("others")
    )
    mixed = saved(mixed, "mixed")
    at_home = F.col("part") == F.col("home")
    block = F.pmod(F.xxhash64("node"), F.when(at_home, F.col("homes")).otherwise(F.col("others"))).cast("int")
    members = buckets.join(mixed, "key").withColumn("mine", F.when(at_home, block).otherwise(block + F.col("homes")))
    first, last = F.col("homes"), F.col("homes") + F.col("others") - 1
    met = F.explode(F.sequence(F.when(at_home, first).otherwise(F.lit(0)), last))
    dealt = members.select("key", "node", "part", "mine", "homes", met.alias("other")).select(
        "key", "node", "part", "mine", (F.col("mine") < F.col("homes")).alias("at_home"), F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high")
    )
    rows = dealt.join(sketches.select("node", "bands", "signature"), "node").join(texts, "node").repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")

    def compared(key: int, low: int, high: int, group: list[tuple]) -> list[tuple[int, int]]:
        nodes, parts, mine, home = (np.array([g[i] for g in group]) for i in (0, 1, 2, 6))
        bands = np.array([g[3] for g in group], np.int64)
        marks = np.frombuffer(b"".join(g[4] for g in group), np.uint8).reshape(len(group), PLACES)
        across = home.any()
        root: dict[int, int] = {}

        def of(part: int) -> int:
            while (up := root.get(part, part)) != part:
                root[part] = part = root.get(up, up)
            return part

        links = []
        for i in np.flatnonzero(~home):
            agreeing = (marks == marks[i]).sum(1)
            # each pair once: others with those at home, others of one block by node, of two blocks by block
            meets = home if across else nodes > nodes[i] if low == high else mine > mine[i]
            likely = (agreeing >= LEAST) & (parts != parts[i]) & meets
            for j in sorted(np.flatnonzero(likely), key=lambda j: -agreeing[j]):
                shared = bands[i] == bands[j]
                if of(parts[j]) == of(parts[i]) or bands[i][shared.argmax()] != key:  # only in the first bucket that both share
                    continue
                if similarity(weighed(group[i][5]), weighed(group[j][5])) >= threshold:
                    root[of(parts[j])] = of(parts[i])
                    links.append((int(nodes[i]), int(nodes[j])))
        return links

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, group = None, []

        def out() -> pa.RecordBatch:
            links = compared(*now, group) if len(group) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], names=["a", "b"])

        for batch in batches:
            cols = batch.to_pydict()
            for i in range(batch.num_rows):
                at = (cols["key"][i], cols["low"][i], cols["high"][i])
                if at != now:
                    if now is not None:
                        yield out()
                    now, group = at, []
                group.append(tuple(cols[c][i] for c in ("node", "part", "mine", "bands", "signature", "text", "at_home")))
        if now is not None:
            yield out()

    return rows.select("key", "low", "high", "node", "part", "mine", "at_home", "bands", "signature", "text").mapInArrow(run, "a long, b long")


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = SIMILARITY) -> DataFrame:
    """(row, doc_id, sha, class_id, class_rows, kept): one row per input row.

    ``class_id`` is the smallest id of the class; that row stays (of rows that repeat it, the first). The bands and the
    least agreement are worked out for ``SIMILARITY``, so a lower ``threshold`` is refused: it would lose links.
    """
    if threshold < SIMILARITY:
        raise ValueError(f"the bands find pairs of a similarity of {SIMILARITY} or more, not of {threshold}")
    rows = sketch(docs, id_col, text_col)
    # one node per distinct text: the first of its rows
    nodes = rows.groupBy("sha").agg(F.min("row").alias("node"))
    shas = saved(nodes, "nodes")
    sketches = saved(rows.join(shas.select(F.col("node").alias("row")), "row").select(F.col("row").alias("node"), "bands", "signature").where(F.col("bands").isNotNull()), "node-sketches")
    keys = sketches.select("node", F.explode("bands").alias("key"))
    # most buckets hold one text and go no further
    full = saved(keys.groupBy("key").agg(F.min("node").alias("leader"), F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select("key", "leader"), "buckets")
    members = saved(keys.join(small(full), "key"), "bucket-members")
    stars = saved(members.where(F.col("node") != F.col("leader")).select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct(), "stars")
    wanted = stars.select(F.col("a").alias("node")).union(stars.select("b")).distinct()
    texts = node_texts(docs, wanted, shas, text_col)
    links = saved(verified(stars, texts, threshold).select("a", "b"), "links")
    parts = components(links)
    buckets = members.join(parts.select("node", "root"), "node", "left").select("key", "node", F.coalesce("root", "node").alias("part"))
    more = saved(left_links(saved(buckets, "bucket-parts"), sketches, texts, threshold), "links")
    if not more.isEmpty():
        parts = components(links.union(more))
    discard(texts, sketches, stars)
    root = F.coalesce("root", "node")
    classes = shas.join(parts, "node", "left").select("sha", root.alias("part"))
    placed = saved(rows.join(classes, "sha").select("row", "doc_id", "sha", "part"), "placed")
    first = placed.groupBy("part").agg(
        F.count(F.lit(1)).alias("class_rows"), F.min("doc_id").alias("class_id"), F.min(F.struct(F.col("doc_id").isNull().alias("unset"), "doc_id", "row")).alias("kept")
    )
    return placed.join(first.select("part", "class_id", "class_rows", F.col("kept.row").alias("kept_row")), "part").select(
        "row", "doc_id", "sha", "class_id", "class_rows", (F.col("row") == F.col("kept_row")).alias("kept")
    )


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = SIMILARITY) -> DataFrame:
    """One row of each class stays, with all its columns as they were.

    The few (id, content) that go are taken out of the table by a join; the many that stay are not shuffled.
    Of rows that repeat both id and content, which no join can tell apart, one stays.
    """
    per = near_classes(docs, id_col, text_col, threshold).groupBy("doc_id", "sha").agg(F.bool_or("kept").alias("kept"), F.count(F.lit(1)).alias("n"))
    per = saved(per.where(~F.col("kept") | (F.col("n") > 1)), "near-decisions")
    text = F.coalesce(column(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.struct(*[column(c) for c in docs.columns]).alias("row"), column(id_col).cast("bigint").alias("id"), F.unhex(F.sha2(text, 256)).alias("content"))

    def among(keys: DataFrame, how: str) -> DataFrame:
        keys = small(keys)
        return rows.join(keys, rows["id"].eqNullSafe(keys["doc_id"]) & (rows["content"] == keys["sha"]), how)

    stay = among(per.select("doc_id", "sha"), "left_anti").select("row.*")
    twice = per.where("kept").select("doc_id", "sha")
    if twice.isEmpty():
        return stay
    return stay.unionAll(among(twice, "left_semi").groupBy("id", "content").agg(F.first("row").alias("row")).select("row.*"))
