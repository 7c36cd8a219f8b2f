"""Mixing sources to target weights by soft membership, in DataFrame operations only.

A word model fitted on the labelled table gives every document its probabilities of belonging to each
domain; over the labelled texts they add up to the domains' sizes. A document's rate is how often it is
wanted; the expected tokens of a domain are the sum over documents of rate, tokens and probability. Rates start at one and follow the projected gradient of the
least squares between expected and wanted tokens, each domain measured against its size and each
document against its length, under which a step of one never overshoots; rates stay between zero and
``most``. A step needs one number per domain from all documents, added up by Spark. Rates become whole copies by a hash.

Tokens are the words of the text, split at white space; the model looks at which words a text has, with
their case and marks, not how often. It is fitted on at most about ``train_rows`` labelled documents, chosen by a hash of the
id; everything else covers all rows.

Defined results: a NULL text counts as empty, has one token (so that it has a rate) and, like every text
without evidence, the shares that are left when telling words are accounted for; a domain without a labelled
text in ``docs`` has probability 0 everywhere (without any labelled text, all are equal); NULL labels and ids teach nothing; a domain that no text belongs to leaves
its target unmet; rows that repeat id and text share their rate and copies; an empty table stays empty.
"""

from __future__ import annotations

from math import inf, log

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import column, saved, small

BUCKETS = 1 << 17  # words are counted by a hash of so many values
TRAIN_ROWS = 20_000
STEPS = 60
CALIBRATION_STEPS = 20
CLOSE = 1e-4  # of all tokens
MOST = 4.0
FEW = 0.001  # of all tokens: a smaller domain is measured as if it had so many
PULL = 5  # words with which a bucket's count in a domain is drawn to what its count in all lets expect
SURE = 6.0  # standard deviations by which a count must differ from the expected one to be evidence
LENGTH = 400  # words from which the evidence of further ones counts by the square root


def words_of(text: Column) -> Column:
    return F.split(text, r"\s+")


def bucket(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, sha, text): what tells rows apart, whatever else the table holds."""
    text = F.coalesce(column(text_col).cast("string"), F.lit(""))
    return docs.select(column(id_col).cast("bigint").alias("id"), F.sha2(text, 256).alias("sha"), text.alias("text"))


def word_model(docs: DataFrame, labelled: DataFrame, domains: list[str], id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS) -> tuple[DataFrame, dict[str, float]]:
    """(bucket, w_0, w_1, ...) of the buckets that tell domains apart: the log of how often a domain has a bucket's words against what is expected; and the domains' shares."""
    known = labelled.select(column(id_col).cast("bigint").alias("id"), column("domain").alias("domain")).where(F.col("id").isNotNull() & F.col("domain").isin(domains))
    rows = known.count()
    if rows > train_rows:
        known = known.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int((1 << 30) * train_rows / rows))
    # at most about train_rows ids
    texts = keyed(docs, id_col, text_col).join(F.broadcast(known), "id").dropDuplicates(["domain", "sha"])
    of = {d: F.col("domain") == d for d in domains}
    counts = texts.select("domain", F.explode(F.array_distinct(words_of(F.col("text")))).alias("word")).groupBy(bucket(F.col("word")).alias("bucket")).agg(
        *[F.count(F.when(of[d], 1)).alias(f"n_{k}") for k, d in enumerate(domains)]
    )
    counts = saved(counts, "word-counts")
    # of the labelled texts that are there, not of the whole label table: earlier stages may have taken a domain away
    found = {r["domain"]: r["count"] for r in texts.groupBy("domain").count().collect()}  # one row a domain
    totals = counts.agg(*[F.coalesce(F.sum(f"n_{k}"), F.lit(0)) for k in range(len(domains))]).first()
    everything = sum(totals)
    n = [F.col(f"n_{k}") for k in range(len(domains))]
    expected = [sum(n, F.lit(0)) * (t / max(everything, 1)) for t in totals]

    def weight(k: int) -> Column:
        clear = F.abs(n[k] - expected[k]) > SURE * F.sqrt(expected[k] + 1)
        return F.when(clear, F.log((n[k] + PULL) / (expected[k] + PULL))).otherwise(0.0).alias(f"w_{k}")

    weights = [weight(k) for k in range(len(domains))]
    here = [d for d in domains if d in found] or domains
    shares = {d: (found.get(d, 0) + 1) / (sum(found.values()) + len(here)) if d in here else 0.0 for d in domains}
    telling = saved(counts.select("bucket", *weights).where(" or ".join(f"w_{k} <> 0" for k in range(len(domains)))), "word-weights")
    return telling, calibrated(evidence(texts, telling, len(domains), "id"), shares)


def evidence(docs: DataFrame, model: DataFrame, domains: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, sha, tokens, e_0, e_1, ...): one row per input row. Words are weighed and added up where they are read."""
    rows = keyed(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id())
    split = rows.select("row", "id", "sha", words_of(F.col("text")).alias("ws"))
    # counted before the words are dealt out, not once more for each of them
    split = split.withColumn("n", F.size("ws") - F.size(F.filter("ws", lambda w: w == "")))
    word = split.select("row", "id", "sha", "n", F.explode(F.array_distinct("ws")).alias("word")).withColumn("bucket", bucket(F.col("word")))
    k = range(domains)
    real = F.col("word") != ""
    # the model has at most BUCKETS rows
    sums = word.join(F.broadcast(model), "bucket", "left").groupBy("row", "id", "sha", "n").agg(
        *[F.coalesce(F.sum(F.when(real, F.col(f"w_{i}"))), F.lit(0.0)).alias(f"s_{i}") for i in k]
    )
    dampened = F.when(F.col("n") > LENGTH, F.sqrt(LENGTH / F.col("n"))).otherwise(1.0)
    return sums.select("id", "sha", F.greatest("n", F.lit(1)).alias("tokens"), *[(F.col(f"s_{i}") * dampened).alias(f"e_{i}") for i in k])


def weighed(shares: list[float]) -> list[Column]:
    """The probabilities of the domains from the evidence, if a text without any has these."""
    logs = [F.col(f"e_{i}") + (log(p) if p else -inf) for i, p in enumerate(shares)]
    top = F.greatest(*logs) if len(logs) > 1 else logs[0]
    parts = [F.exp(x - top) for x in logs]
    return [p / sum(parts[1:], parts[0]) for p in parts]


def calibrated(seen: DataFrame, shares: dict[str, float]) -> dict[str, float]:
    """The shares to give a text without evidence so that the labelled texts' probabilities add up to the domains' shares.

    Words speak for a domain where they stand, not against it where they are missing; with the plain shares a
    domain with telling words would be counted in its texts and again in all others. Newton's steps, a few sums each.
    """
    here = [d for d in shares if shares[d]]
    if len(here) < 2:
        return shares
    names = list(shares)
    at = [names.index(d) for d in here]
    seen = saved(seen.select(*[f"e_{i}" for i in range(len(names))]), "evidence")
    wanted = np.array([shares[d] for d in here])
    b = np.log(wanted)
    for _ in range(CALIBRATION_STEPS):
        now = np.zeros(len(names))
        now[at] = np.exp(b)
        p = weighed([float(x) for x in now])
        sums = seen.select(*[p[i].alias(f"p_{i}") for i in at]).agg(
            F.count(F.lit(1)), *[F.sum(f"p_{i}") for i in at], *[F.sum(F.col(f"p_{i}") * F.col(f"p_{j}")) for i in at for j in at]
        ).first()
        if not sums[0]:
            return shares
        mean = np.array(sums[1 : 1 + len(at)]) / sums[0]
        both = np.array(sums[1 + len(at) :]).reshape(len(at), len(at)) / sums[0]
        if np.abs(mean - wanted).max() < CLOSE / 10:
            break
        # the first domain is held; the rest move by at most two, so that far starts do not run away
        slope = np.diag(mean)[1:, 1:] - both[1:, 1:] + 1e-12 * np.eye(len(at) - 1)
        b[1:] += np.clip(np.linalg.solve(slope, (wanted - mean)[1:]), -2.0, 2.0)
        b -= np.log(np.exp(b).sum())
    return {d: float(np.exp(b[here.index(d)])) if d in here else 0.0 for d in names}


def memberships(docs: DataFrame, model: DataFrame, shares: dict[str, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, sha, tokens, p_0, p_1, ...): one row per input row."""
    return evidence(docs, model, len(shares), id_col, text_col).select("id", "sha", "tokens", *[p.alias(f"p_{i}") for i, p in enumerate(weighed(list(shares.values())))])


def bounded(members: DataFrame, targets: dict[str, float], at_most: tuple[str, ...]) -> dict[str, float]:
    """The targets, but of the domains named no more than there is now: their shares go down or stay; the others share the rest as they would."""
    now = members.agg(*[F.coalesce(F.sum(F.col("tokens") * F.col(f"p_{i}")), F.lit(0.0)) for i in range(len(targets))]).first()
    total, wanted = sum(now), sum(targets.values())
    held = {d: min(targets[d] / wanted, n / total) for d, n in zip(targets, now, strict=True) if d in at_most} if total else {}
    rest = sum(w for d, w in targets.items() if d not in held)
    if not held or not rest:
        return targets
    return {d: held[d] if d in held else (1 - sum(held.values())) * w / rest for d, w in targets.items()}


def fit_rates(members: DataFrame, targets: dict[str, float], most: float = MOST, steps: int = STEPS) -> tuple[DataFrame, list[dict]]:
    """The memberships with their rates, and for each step how far each domain's share is from its target."""
    k = range(len(targets))
    weights = [w / sum(targets.values()) for w in targets.values()]

    def expected(frame: DataFrame, rate: Column) -> list[float]:
        return list(frame.agg(*[F.coalesce(F.sum(F.col("tokens") * rate * F.col(f"p_{i}")), F.lit(0.0)) for i in k]).first())

    state = members.withColumn("rate", F.lit(1.0))
    rate = F.col("rate")
    now = expected(state, rate)
    total = sum(now)
    if not total:
        return state, []
    size = [max(m, FEW * total) for m in now]
    history = []
    for step in range(1, steps + 1):
        gap = [(t - w * total) / total for t, w in zip(now, weights, strict=True)]
        history.append(dict(zip(targets, gap, strict=True)))
        if max(map(abs, gap)) < CLOSE or (len(history) > 2 and max(abs(a - b) for a, b in zip(history[-1].values(), history[-2].values(), strict=True)) < CLOSE / 100):
            break
        slope = sum((F.col(f"p_{i}") * (gap[i] * total / size[i]) for i in k), F.lit(0.0))
        rate = F.least(F.lit(most), F.greatest(F.lit(0.0), rate - slope))
        if step % 6 == 0:  # keeps the expression short
            state = saved(state.withColumn("rate", rate), "rates")
            rate = F.col("rate")
        now = expected(state, rate)
    return state.withColumn("rate", rate), history


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS, most: float = MOST, at_most: tuple[str, ...] = ()) -> DataFrame:
    """(id, sha, tokens, p_0, p_1, ..., rate, copies): one row per input row; the targets of the domains ``at_most`` are upper bounds."""
    model, shares = word_model(docs, labelled, list(targets), id_col, text_col, train_rows)
    members = saved(memberships(docs, model, shares, id_col, text_col), "memberships")
    rates, _ = fit_rates(members, bounded(members, targets, at_most) if at_most else targets, most)
    drawn = F.pmod(F.xxhash64("id", "sha"), F.lit(1 << 40)) / float(1 << 40)
    return rates.withColumn("copies", (F.floor("rate") + F.when(drawn < F.col("rate") - F.floor("rate"), 1).otherwise(0)).cast("int"))


def apply_mix(docs: DataFrame, mixed: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row as often as its copies say, with all its columns as they were."""
    changed = small(saved(mixed.where(F.col("copies") != 1).select("id", "sha", "copies").distinct(), "copies"))
    text = F.coalesce(column(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.struct(*[column(c) for c in docs.columns]).alias("row"), column(id_col).cast("bigint").alias("key"), F.sha2(text, 256).alias("content"))
    found = rows.join(changed, rows["key"].eqNullSafe(changed["id"]) & (rows["content"] == changed["sha"]), "left").select("row", F.coalesce("copies", F.lit(1)).alias("copies"))
    return found.where(F.col("copies") > 0).select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select("row.*")
