"""Sharding by balanced label propagation, in DataFrame operations only.

Documents of equal text are linked. A group that is larger than half a shard is split beforehand into
chunks by a hash of the row, since it could not stay whole; a chunk is what wants to be together. Every
linked document starts in a shard by hash. In each round, a chunk's documents are counted by shard, and
those outside its fullest shard ask to move there; requests between two shards are granted as far as
others ask for the way back and the target's quota leaves room. Grants are drawn by a hash of the chunk,
shard and round, so all of a chunk's documents in a shard move together. Documents without links then
fill the room that is left. The last step lays all documents out by shard, free ones at both ends, and
cuts that order into equal counts: law ``rows``. It moves only as many as counts differ by.

What the driver sees is at most shards squared numbers; the tables hold narrow rows (no text).

Defined results: a NULL text counts as empty; NULL and repeated ids and repeated rows are documents like
any other; an empty table has no rows; with fewer documents than shards some shards stay empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilframe.llm.common import column, discard, prefix_sums, saved

SHARDS = 24
ROUNDS = 6
CHUNK_SHARE = 2  # a chunk holds at most about one part in so many of a shard


def unit(*parts: Column | str) -> Column:
    """A number in [0, 1) that depends on the values alone."""
    return F.pmod(F.xxhash64(*[F.lit(p) if isinstance(p, str) else p for p in parts]), F.lit(1 << 40)) / float(1 << 40)


def documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, doc_id, size, text_crc32, content): narrow rows, numbered as they are written."""
    text = F.coalesce(column(text_col).cast("string"), F.lit(""))
    narrow = docs.select(
        F.monotonically_increasing_id().alias("row"), column(id_col).cast("bigint").alias("doc_id"),
        (F.octet_length(text) + 8).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.substring(F.sha2(text, 256), 1, 32).alias("content"),
    )
    return saved(narrow, "shard-documents")


def chunked(narrow: DataFrame, limit: int) -> DataFrame:
    """The linked rows with their chunk: groups of one text, split by hash where they pass the limit."""
    sizes = saved(narrow.groupBy("content").agg(F.count(F.lit(1)).alias("members")).where(F.col("members") > 1), "group-sizes")
    chunks = F.ceil(F.col("members") / limit)
    part = F.pmod(F.xxhash64("row"), chunks)
    linked = narrow.select("row", "content").join(sizes, "content")
    return linked.select("row", F.xxhash64("content", part).alias("chunk"))


def requests(nodes: DataFrame) -> DataFrame:
    """(chunk, shard, n, goal): how many of a chunk's rows a shard holds, and the chunk's fullest shard (ties by hash, so that they spread)."""
    held = nodes.groupBy("chunk", "shard").agg(F.count(F.lit(1)).alias("n"))
    goals = held.groupBy("chunk").agg(F.max(F.struct("n", F.xxhash64("chunk", "shard").alias("tie"), "shard")).alias("top"))
    return held.join(goals.select("chunk", F.col("top.shard").alias("goal")), "chunk")


def propagate(nodes: DataFrame, shards: int, quota: int, rounds: int) -> DataFrame:
    """Move linked rows towards their chunk's fullest shard, round by round, within the quotas."""
    for number in range(rounds):
        held = saved(requests(nodes), "requests")
        moves = held.where(F.col("shard") != F.col("goal"))
        asked = {(r["shard"], r["goal"]): r["n"] for r in moves.groupBy("shard", "goal").agg(F.sum("n").alias("n")).collect()}  # at most shards squared
        if not asked:
            break
        granted = grants(asked, counted(nodes), shards, quota)
        chance = F.create_map(*[F.lit(x) for (a, b), p in granted.items() for x in (a * shards + b, p)])
        drawn = unit(F.col("chunk"), F.col("shard"), F.lit(number)) < F.coalesce(F.element_at(chance, F.col("shard") * shards + F.col("goal")), F.lit(0.0))
        going = saved(moves.where(drawn).select("chunk", "shard", "goal"), "grants")
        after = saved(nodes.join(going, ["chunk", "shard"], "left").select("row", "chunk", F.coalesce("goal", "shard").alias("shard")), "labels")
        discard(nodes, held, going)
        nodes = after
    return nodes


def counted(nodes: DataFrame) -> dict[int, int]:
    return {r["shard"]: r["n"] for r in nodes.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a shard


def filling(counts: dict[int, int], shards: int, total: int) -> Column:
    """A shard for a free row, drawn in proportion to the room that linked rows have left."""
    room = [max(0.0, total / shards - counts.get(s, 0)) for s in range(shards)]
    whole, upto, drawn = sum(room) or 1.0, 0.0, F.lit(shards - 1)
    bounds = []
    for r in room:
        upto += r / whole
        bounds.append(upto)
    for s in reversed(range(shards)):
        drawn = F.when(unit(F.col("row"), F.lit("free")) < bounds[s], s).otherwise(drawn)
    return drawn.cast("int")


def grants(asked: dict[tuple[int, int], int], counts: dict[int, int], shards: int, quota: int) -> dict[tuple[int, int], float]:
    """The share of each kind of move that is granted: swaps in full, the rest as far as the target has room."""
    share = {}
    for (a, b), n in asked.items():
        swaps = min(n, asked.get((b, a), 0))
        share[a, b] = [n, swaps]
    for b in range(shards):
        more = {a: n - s for (a, to), (n, s) in share.items() if to == b}
        room, wanted = max(0, quota - counts.get(b, 0)), sum(more.values())
        for a, n in more.items():
            share[a, b][1] += n * min(1.0, room / wanted) if wanted else 0
    return {k: s / n for k, (n, s) in share.items()}


def cut_links(placed: DataFrame, link: str = "content") -> DataFrame:
    """(linked, cut): rows linked to another, and those outside their group's fullest shard."""
    held = placed.groupBy(link, "shard").agg(F.count(F.lit(1)).alias("n"))
    groups = held.groupBy(link).agg(F.sum("n").alias("members"), F.max("n").alias("top")).where(F.col("members") > 1)
    return groups.agg(F.coalesce(F.sum("members"), F.lit(0)).alias("linked"), F.coalesce(F.sum(F.col("members") - F.col("top")), F.lit(0)).alias("cut"))


def shard(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, content): shards of equal counts, at most one apart."""
    narrow = documents(docs, id_col, text_col)
    total = narrow.count()
    chunks = saved(chunked(narrow, max(2, total // (shards * CHUNK_SHARE))), "chunks")
    start = F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int").alias("shard")
    nodes = propagate(saved(chunks.select("row", "chunk", start), "labels"), shards, -(-total // shards), rounds)
    free = narrow.join(chunks.select("row"), "row", "left_anti").select("row", F.lit(None).cast("bigint").alias("chunk"), filling(counted(nodes), shards, total).alias("shard"))
    # free rows stand at both ends of a shard, so that they are what the even cut moves over a border
    tie = F.xxhash64("row")
    zone = F.when(F.col("chunk").isNotNull(), 1).otherwise(F.pmod(tie, F.lit(2)) * 2)
    order = ("shard", "zone", "chunk", "tie")
    ordered = nodes.unionByName(free).withColumns({"tie": tie, "zone": zone}).repartitionByRange(*order).sortWithinPartitions(*order)
    places = saved(ordered.select("row", F.monotonically_increasing_id().alias("place")), "places")
    part, within = F.shiftright("place", 33), F.col("place").bitwiseAND((1 << 33) - 1)
    spread = places.select("row", part.alias("part"), within.alias("within"))
    totals = saved(spread.groupBy("part").agg((F.max("within") + 1).alias("n")), "totals")
    bases = prefix_sums(totals, "part", "n", "base").select("part", "base")
    position = spread.join(bases, "part").select("row", (F.col("base") + F.col("within")).alias("position"))
    # shard s holds the positions from ceil(s * total / shards)
    exact = F.expr(f"position * {shards} div {max(total, 1)}")
    first = F.expr(f"(shard * {total} + {shards - 1}) div {shards}")
    found = position.withColumn("shard", exact).withColumn("slot", F.col("position") - first)
    return narrow.join(found, "row").select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot"), "content")
