"""Conversation structure repair: the cheapest edits that make the roles alternate, found in linear space.

Rows are kept (0), re-roled to user or assistant (3) or deleted (4, which blank and repeated rows must be); empty turns are
inserted anywhere (3); a row that stays though its text is cut off adds 3. The initials of the roles must then read
``(s?(ua)+)?``. Four states say what has been put out: nothing, system, user, assistant. Among the cheapest edits the ones
whose initials (Delete, Insert, Keep, Re-role) come first in ASCII are chosen.

Hirschberg's scheme finds them: a forward vector of four costs from the beginning and a backward one from the end meet in
the middle, the crossing state of least cost is chosen, and both halves are solved in the same way, so nothing but the two
vectors is held. A forward vector also ranks the edits that lead to its states: borders lie right behind a row's own edit, so
edits up to one border have as many such letters, none begins another, and of several cheapest crossings the one of
lowest rank begins the least whole string.

The same scheme deals with conversations of any length: rows are sorted over all tasks by conversation, turn, role and digest,
and cut into chunks of at most ``CHUNK`` rows. A chunk is a step of 4 x 4 costs; only the steps of conversations of several
chunks are gathered (one in ``CHUNK`` of their rows), the states at the chunks' borders chosen, and each chunk solved by itself.

Defined results: NULL roles and texts count as empty; NULL turns come first; rows of one turn go by role, then by the MD5 of
the text; repeated rows are all there, and all but the first are duplicates; rows without a conversation id are one
conversation. Texts of any length are read once. Empty tables give no rows. Other columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import column, saved

CHUNK_BITS = 12
SPACES = " \t\n\x0b\f\r"
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
ROLES = ("system", "user", "assistant")
SOUND, BLANK, DUPLICATE, TRUNCATED = range(4)
REROLE, DELETE, INSERT, CUT_OFF = 3, 4, 3, 3
FAR = 1 << 60

Step = tuple[list[list[int]], list[list[int]]]  # from state, to state: cost, and the order of the edits among those from one state


def follows(state: int) -> int:
    """The role that may be put out next by an insertion or re-roling."""
    return ASSISTANT if state == USER else USER


def inserted(state: int, times: int) -> int:
    for _ in range(times):
        state = follows(state)
    return state


def row_edits(kind: int) -> dict[tuple[int, int], tuple[int, str]]:
    """(from, to) -> (cost, edits): the best insertions and the row's own edit, by class of row (initial + 4 x fault)."""
    initial, fault = kind % 4, kind // 4
    best: dict[tuple[int, int], tuple[int, str]] = {}
    for state, times in product(range(4), range(3)):
        at, kept = inserted(state, times), CUT_OFF * (fault == TRUNCATED)
        ways = [(at, DELETE, "D")]
        if fault not in (BLANK, DUPLICATE):
            ways.append((follows(at), REROLE + kept, "R"))
            role = initial + 1
            if role == SYSTEM and at == NOTHING or role in (USER, ASSISTANT) and role == follows(at):
                ways.append((role, kept, "K"))
        for to, cost, letter in ways:
            way = (INSERT * times + cost, "I" * times + letter)
            best[state, to] = min(best.get((state, to), way), way)
    return best


EDITS = [row_edits(kind) for kind in range(16)]
CLOSING = {NOTHING: (0, ""), SYSTEM: (2 * INSERT, "II"), USER: (INSERT, "I"), ASSISTANT: (0, "")}


def step_of(edits: dict[tuple[int, int], tuple[int, str]]) -> Step:
    cost = [[edits.get((s, t), (FAR, ""))[0] for t in range(4)] for s in range(4)]
    order = [[sorted(e for (a, _), (_, e) in edits.items() if a == s).index(edits[s, t][1]) if (s, t) in edits else 0 for t in range(4)] for s in range(4)]
    return cost, order


STEPS = [step_of(edits) for edits in EDITS]


def forward(steps: list[Step], begin: int, end: int, state: int) -> tuple[list[int], list[int]]:
    """The least cost from ``state`` at ``begin`` to each state at ``end``, and the rank of the least edits among the four."""
    cost, rank = [FAR] * 4, [0] * 4
    cost[state] = 0
    for at in range(begin, end):
        step, order = steps[at]
        best = [min((cost[s] + step[s][t], rank[s], order[s][t]) for s in range(4)) for t in range(4)]
        cost = [b[0] for b in best]
        ranked = sorted(range(4), key=lambda t: best[t][1:])
        rank = [ranked.index(t) for t in range(4)]
    return cost, rank


def backward(steps: list[Step], begin: int, end: int, state: int) -> list[int]:
    """The least cost from each state at ``begin`` to ``state`` at ``end``."""
    cost = [FAR] * 4
    cost[state] = 0
    for at in range(end - 1, begin - 1, -1):
        step = steps[at][0]
        cost = [min(step[s][t] + cost[t] for t in range(4)) for s in range(4)]
    return cost


def crossings(steps: list[Step], first: int, last: int) -> list[int]:
    """The state at each border, from ``first`` before all steps to ``last`` behind them."""
    states = [first] + [last] * len(steps)
    parts = [(0, len(steps))]
    while parts:
        begin, end = parts.pop()
        if end - begin < 2:
            continue
        middle = (begin + end) // 2
        there, rank = forward(steps, begin, middle, states[begin])
        back = backward(steps, middle, end, states[end])
        states[middle] = min(range(4), key=lambda s: (there[s] + back[s], rank[s]))
        parts += [(begin, middle), (middle, end)]
    return states


def last_state(steps: list[Step]) -> int:
    cost, rank = forward(steps, 0, len(steps), NOTHING)
    return min(range(4), key=lambda s: (cost[s] + CLOSING[s][0], rank[s]))


@dataclass
class Repaired:
    """``turns``: (conv_id, position, part, role, text), what is left, in order of position and part.
    ``report``: (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit), a row a conversation."""

    turns: DataFrame
    report: DataFrame


def repair(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> Repaired:
    digest = F.md5("text")
    rows = turns.select(
        column(conv).alias("conv_id"), column(turn).cast("bigint").alias("turn"), F.coalesce(column(role).cast("string"), F.lit("")).alias("role"), F.coalesce(column(text).cast("string"), F.lit("")).alias("text")
    ).select("*", digest.alias("digest"), F.monotonically_increasing_id().alias("equal"))
    # equal rows are interchangeable: the last sort key only keeps many of them from one task
    keys = ["conv_id", "turn", "role", "digest", "equal"]
    rows = saved(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("equal").withColumn("position", F.monotonically_increasing_id()), "turns")

    first = rows.groupBy("conv_id", "role", "digest").agg(F.min("position").alias("position")).select("position", F.lit(True).alias("fresh"))
    inked = F.rtrim("text", F.lit(SPACES))
    initial = F.substring("role", 1, 1)
    kind = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    narrow = rows.select("conv_id", "position", kind.alias("kind"), (inked == "").alias("blank"), F.right(inked, F.lit(1)).isin(".", "!", "?").alias("ended"))
    fault = F.when(F.col("blank"), BLANK).when(F.col("fresh").isNull(), DUPLICATE).when(~F.col("ended"), TRUNCATED).otherwise(SOUND)
    classed = narrow.join(first, "position", "left").select("conv_id", "position", (F.col("kind") + 4 * fault).cast("int").alias("kind"))
    chunk = F.shiftright("position", CHUNK_BITS)
    packed = classed.groupBy("conv_id", chunk.alias("chunk")).agg(F.sort_array(F.collect_list(F.struct("position", "kind"))).alias("rows"))
    chunks = saved(packed.select("conv_id", "chunk", F.col("rows.position").alias("positions"), F.col("rows.kind").alias("kinds")), "chunks")

    several = chunks.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select(F.col("conv_id").alias("long_id"))
    long = chunks.join(several, F.col("conv_id").eqNullSafe(F.col("long_id")), "left_semi")
    steps = long.select("conv_id", "chunk", "kinds").mapInPandas(_steps, f"conv_id {chunks.schema['conv_id'].dataType.simpleString()}, chunk long, cost array<long>, rank array<long>")
    borders = steps.groupBy("conv_id").applyInPandas(_borders, "chunk long, border_of string, first int, last int, closes boolean")
    of = F.coalesce(F.col("conv_id").cast("string"), F.lit(""))
    joined = chunks.join(borders.withColumnRenamed("chunk", "c"), (F.col("chunk") == F.col("c")) & (of == F.col("border_of")), "left")
    edits = "array<struct<position:long,before:array<string>,edit:string,role:string>>"
    solved = saved(
        joined.select("conv_id", "chunk", "positions", "kinds", "first", "last", "closes")
        .mapInPandas(_solve, f"conv_id {chunks.schema['conv_id'].dataType.simpleString()}, chunk long, audit string, cost long, edits {edits}, closing array<string>, kinds array<int>"),
        "edits",
    )
    return Repaired(_turns(rows, solved), _report(rows, solved))


def _steps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        ways = [[forward([STEPS[k] for k in kinds], 0, len(kinds), s) for s in range(4)] for kinds in batch["kinds"]]
        yield batch[["conv_id", "chunk"]].assign(cost=[sum((w[0] for w in way), []) for way in ways], rank=[sum((w[1] for w in way), []) for way in ways])


def _borders(steps: pd.DataFrame) -> pd.DataFrame:
    """The states at the borders of one conversation's chunks."""
    steps = steps.sort_values("chunk")
    square = [([list(c[i : i + 4]) for i in (0, 4, 8, 12)], [list(r[i : i + 4]) for i in (0, 4, 8, 12)]) for c, r in zip(steps["cost"], steps["rank"], strict=True)]
    states = crossings(square, NOTHING, last_state(square))
    name = steps["conv_id"].iloc[0]
    of = "" if pd.isna(name) else str(name)
    return pd.DataFrame({"chunk": steps["chunk"].to_numpy(), "border_of": of, "first": states[:-1], "last": states[1:], "closes": [False] * (len(states) - 2) + [True]})


def _solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The edits of each chunk between its borders; a chunk without borders is a whole conversation."""
    for batch in batches:
        out = []
        for kinds, positions, first, last, closes in zip(batch["kinds"], batch["positions"], batch["first"], batch["last"], batch["closes"], strict=True):
            steps, whole = [STEPS[k] for k in kinds], pd.isna(first)
            first, last = (NOTHING, last_state(steps)) if whole else (int(first), int(last))
            states = crossings(steps, first, last)
            cost, audit, edits = 0, "", []
            for i, kind in enumerate(kinds):
                price, letters = EDITS[kind][states[i], states[i + 1]]
                cost, audit = cost + price, audit + letters
                before = [ROLES[inserted(states[i], n) - 1] for n in range(1, len(letters))]
                edits.append({"position": positions[i], "before": before, "edit": letters[-1], "role": ROLES[states[i + 1] - 1] if letters[-1] == "R" else None})
            closing = []
            if whole or closes:
                cost, audit = cost + CLOSING[last][0], audit + CLOSING[last][1]
                closing = [ROLES[inserted(last, n) - 1] for n in range(1, len(CLOSING[last][1]) + 1)]
            out.append((audit, cost, edits, closing))
        yield batch[["conv_id", "chunk"]].assign(audit=[o[0] for o in out], cost=[o[1] for o in out], edits=[o[2] for o in out], closing=[o[3] for o in out], kinds=batch["kinds"])


def _turns(rows: DataFrame, solved: DataFrame) -> DataFrame:
    empty = F.lit("")
    edits = solved.select("conv_id", F.explode("edits").alias("e")).select("conv_id", "e.*")
    before = edits.select("conv_id", "position", F.posexplode("before").alias("part", "role")).select("conv_id", "position", "part", "role", empty.alias("text"))
    stay = edits.where(F.col("edit") != "D").select("position", F.size("before").alias("part"), F.col("role").alias("new_role"))
    stay = rows.join(stay, "position").select("conv_id", "position", "part", F.coalesce("new_role", "role").alias("role"), "text")
    end = F.element_at("edits", -1)["position"]
    behind = solved.select("conv_id", end.alias("position"), F.posexplode("closing").alias("part", "role")).select("conv_id", "position", (F.col("part") + 8).alias("part"), "role", empty.alias("text"))
    return before.union(stay).union(behind)


def _report(rows: DataFrame, solved: DataFrame) -> DataFrame:
    legal = [0 * 4 + 1, 1 * 4 + 2, 2 * 4 + 1]
    kinds = F.col("kinds")

    def faults(which: int) -> Column:
        return F.size(F.filter(kinds, lambda k: F.shiftright(k, 2) == which)).cast("bigint")

    pairs = F.zip_with(F.slice(kinds, 1, F.size(kinds) - 1), F.slice(kinds, 2, F.size(kinds)), lambda a, b: (a % 4) * 4 + b % 4)
    inner = F.size(F.filter(pairs, lambda p: ~p.isin(legal))).cast("bigint")
    parts = solved.select(
        "conv_id", "cost", *[faults(w).alias(n) for w, n in ((BLANK, "blank"), (DUPLICATE, "duplicate"), (TRUNCATED, "truncated"))], inner.alias("inner"),
        F.struct("chunk", "audit", (F.element_at("kinds", 1) % 4).alias("head"), (F.element_at("kinds", -1) % 4).alias("tail")).alias("part"),
    )
    told = parts.groupBy("conv_id").agg(*[F.sum(c).alias(c) for c in ("cost", "blank", "duplicate", "truncated", "inner")], F.sort_array(F.collect_list("part")).alias("parts"))
    borders = F.zip_with(F.slice("parts", 1, F.size("parts") - 1), F.slice("parts", 2, F.size("parts")), lambda a, b: a["tail"] * 4 + b["head"])
    told = told.select(
        "conv_id", "blank", "duplicate", "truncated", (F.col("inner") + F.size(F.filter(borders, lambda p: ~p.isin(legal)))).alias("illegal"),
        "cost", F.array_join("parts.audit", "").alias("audit"),
    )
    each = rows.groupBy("conv_id", "turn").agg(F.lit(1).alias("one")).groupBy(F.col("conv_id").alias("id")).agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("bigint").alias("gaps")
    )
    return told.join(each, F.col("conv_id").eqNullSafe(F.col("id"))).select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")


def digests(turns: DataFrame) -> DataFrame:
    """(conv_id, sha256) of the turns of ``repair`` as ``role:text`` lines; a conversation streams through its task."""
    kind = turns.schema["conv_id"].dataType.simpleString()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, running, out = None, None, []
        for batch in batches:
            for conv, role, text in zip(batch.column("conv_id").to_pylist(), batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if running is None or conv != current:
                    if running is not None:
                        out.append((current, running.hexdigest()))
                    current, running = conv, hashlib.sha256()
                else:
                    running.update(b"\n")
                running.update(f"{role}:{text}".encode())
            if out:
                yield pa.record_batch([pa.array([o[0] for o in out], batch.schema.field("conv_id").type), pa.array([o[1] for o in out])], ["conv_id", "sha256"])
                out = []
        if running is not None:
            yield pa.record_batch([pa.array([current], batch.schema.field("conv_id").type), pa.array([running.hexdigest()])], ["conv_id", "sha256"])

    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "position", "part")
    return ordered.select("conv_id", "role", "text").mapInArrow(digest, f"conv_id {kind}, sha256 string")
