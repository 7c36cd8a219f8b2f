"""Mixing, sharding and the quality classifier against plain Python and numpy on small inputs; odd rows through the pipeline."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from veilframe.llm import mixing, quality, sharding
from veilframe.llm.common import prefix_sums, saved, table


def spark_hash(text: str) -> int:
    """xxhash64 as Spark has it: seed 42, signed."""
    h = xxhash.xxh64_intdigest(text.encode(), 42)
    return h - (1 << 64) if h >= 1 << 63 else h


# ---------------------------------------------------------------- 5 mixing
def plain_memberships(docs, domain_of, domains):
    """{id: probabilities} by counting words in dictionaries; shares without evidence by scaling until they fit."""
    def buckets(text):
        return [spark_hash(w) % mixing.BUCKETS for w in sorted(set(re.split(r"\s+", text)) - {""})]

    blank = spark_hash("") % mixing.BUCKETS
    labelled = {(domain_of[i], t) for i, t in docs if i in domain_of}
    counts = {d: Counter() for d in domains}
    for d, t in labelled:
        counts[d].update(buckets(t) + ([blank] if "" in re.split(r"\s+", t) else []))
    totals = {d: sum(counts[d].values()) for d in domains}
    weight = {}
    for b in set().union(*counts.values()):
        n = sum(counts[d][b] for d in domains)
        for d in domains:
            expected = n * totals[d] / sum(totals.values())
            if abs(counts[d][b] - expected) > mixing.SURE * math.sqrt(expected + 1):
                weight[b, d] = math.log((counts[d][b] + mixing.PULL) / (expected + mixing.PULL))

    def evidence(text):
        n = len([w for w in re.split(r"\s+", text) if w])
        damp = math.sqrt(mixing.LENGTH / n) if n > mixing.LENGTH else 1.0
        return damp * np.array([sum(weight.get((b, d), 0.0) for b in buckets(text)) for d in domains])

    found = Counter(d for d, _ in labelled)
    wanted = np.array([(found[d] + 1) / (len(labelled) + len(domains)) for d in domains])
    seen, b = np.array([evidence(t) for _, t in sorted(labelled)]), np.log(wanted)

    def posterior(e):
        p = np.exp(e + b - (e + b).max(-1, keepdims=True))
        return p / p.sum(-1, keepdims=True)

    for _ in range(5000):
        b = b + np.log(wanted / posterior(seen).mean(0))
        b -= np.log(np.exp(b).sum())
    return {i: posterior(evidence(t)) for i, t in docs}


def test_memberships_and_rates_equal_plain_python(spark):
    rng = np.random.default_rng(5)
    plain, marked = [f"w{k}" for k in range(60)], {"a": ["apple", "acorn", "ash"], "b": ["birch", "bean"], "c": []}
    docs, domain_of = [], {}
    for i in range(900):
        d = "abc"[rng.choice(3, p=[0.5, 0.2, 0.3])]
        own = list(rng.choice(marked[d], 2)) if marked[d] and rng.random() < 0.8 else []
        docs.append((i, "  ".join([*rng.choice(plain, rng.integers(1, 12)), *own]) + ("\n" if i % 7 == 0 else "")))
        if i % 3:
            domain_of[i] = d
    docs.append((900, " ".join(["apple"] + list(rng.choice(plain, 900)))))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    labelled = spark.createDataFrame(list(domain_of.items()), "doc_id long, domain string")
    targets = {"a": 0.45, "b": 0.25, "c": 0.3}
    got = {r.id: r for r in mixing.mix(df, labelled, targets).collect()}
    wanted = plain_memberships(docs, domain_of, list(targets))
    assert max(np.abs(np.array([got[i].p_0, got[i].p_1, got[i].p_2]) - p).max() for i, p in wanted.items()) < 2e-4
    # the same projected gradient on plain arrays
    ids = sorted(got)
    p, tokens = np.array([[got[i].p_0, got[i].p_1, got[i].p_2] for i in ids]), np.array([got[i].tokens for i in ids], float)
    rate, goal = np.ones(len(ids)), np.array(list(targets.values())) * tokens.sum()
    size = tokens @ p
    for _ in range(mixing.STEPS):
        rate = np.clip(rate - p @ (((tokens * rate) @ p - goal) / size), 0, mixing.MOST)
    assert np.abs((tokens * rate) @ p - goal).max() / tokens.sum() < 1e-2
    assert np.abs(rate - np.array([got[i].rate for i in ids])).max() < 0.05


# ---------------------------------------------------------------- 3 and 7, places in a global order
def test_prefix_sums(spark):
    rng = random.Random(5)
    parts = sorted({rng.randrange(40_000) for _ in range(600)} | {4095, 4096, 8191, 8192, 1 << 23})
    rows = [(p, rng.choice([None, 0, 1, rng.randrange(1 << 40)])) for p in parts]
    wanted, at = {}, 0
    for p, n in rows:
        wanted[p], at = at, at + (n or 0)
    totals = saved(spark.createDataFrame(rng.sample(rows, len(rows)), "part long, n long"), "totals")
    assert {r.part: r.base for r in prefix_sums(totals, "part", "n", "base").collect()} == wanted
    assert prefix_sums(totals.limit(0), "part", "n", "base").isEmpty()


# ---------------------------------------------------------------- 7 sharding
def test_propagation_cuts_fewer_links_than_a_hash(spark):
    rng = np.random.default_rng(7)
    texts = [f"text {k}" for k in rng.integers(0, 900, 4000)] + ["the hot text"] * 2000 + [f"alone {k}" for k in range(2000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    got = sharding.shard(docs, shards=8)
    start = got.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(8)))
    linked, cut = sharding.cut_links(got).first()
    assert linked == sharding.cut_links(start).first()[0] == sum(n for n in Counter(texts).values() if n > 1)
    assert cut < 0.5 * sharding.cut_links(start).first()[1]
    rows = got.collect()
    held = defaultdict(Counter)
    for r in rows:
        held[texts[r.doc_id]][r.shard] += 1
    assert cut == sum(sum(c.values()) - max(c.values()) for c in held.values() if sum(c.values()) > 1)
    # a text of less than half a shard lies in one shard, but for what the even cut moves
    small = [c for t, c in held.items() if 1 < sum(c.values()) and t != "the hot text"]
    assert sum(len(c) == 1 for c in small) > 0.85 * len(small)
    assert set(Counter(r.shard for r in rows).values()) == {1000}


# ---------------------------------------------------------------- 8 quality
def plain_statistics(text):
    raw = text.encode()
    found, full = re.findall(rb"[^\t\n\x0b\x0c\r ]+", raw), len(re.sub(rb"[\t\n\x0b\x0c\r ]", b"", raw))

    def odds(part, whole, usual):
        return math.log((part + quality.PSEUDO * usual) / (max(whole - part, 0) + quality.PSEUDO * (1 - usual)))

    kinds = [rb"[A-Z]", rb"[#$%&*+/<=>@\\^_`{|}~\[\]]", rb"[0-9]", rb"[!?]"]
    return [
        math.log(len(found) + 20), math.log((full + 100) / (len(found) + 20)), *[odds(len(re.findall(k, raw)), full, u) for k, u in zip(kinds, quality.ORDINARY, strict=True)],
        odds(raw.count(b"\n"), len(raw), 0.01), odds(len(set(found)), len(found), 0.9), odds(sum(a == b for a, b in zip(found, found[1:], strict=False)), len(found), 0.01),
        math.log((len(zlib.compress(raw, 1)) + 100) / (len(raw) + 200)),
    ]


def test_scores_equal_numpy(spark, sf_dir):
    """The discriminant by numpy's own covariances, determinants and solves on statistics counted text by text."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    x = np.array([plain_statistics(t) for _, t in rows])
    known = {r.doc_id: r.quality for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 3 != 1}
    y = np.array([known.get(i, -1) for i, _ in rows])
    n, d = [(y == c).sum() for c in (0, 1)], x.shape[1]
    spread = [np.cov(x[y == c].T, bias=True) for c in (0, 1)]
    pooled = sum(k * s for k, s in zip(n, spread, strict=True)) / sum(n)
    logs = []
    for c in (0, 1):
        near = 0.05 + 0.9 * d / (d + n[c])
        cov = 0.99 * ((1 - near) * spread[c] + near * pooled) + 0.01 * (np.trace(pooled) / d + 1e-6) * np.eye(d)
        off = x - x[y == c].mean(0)
        logs.append(math.log(n[c] / sum(n)) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * (off * np.linalg.solve(cov, off.T).T).sum(1))
    wanted = 1 / (1 + np.exp(-np.clip(logs[1] - logs[0], -36, 36)))
    model = quality.train(docs, labels)
    got = {(r.doc_id, r.text or ""): r.s for r in docs.select("doc_id", "text", quality.score(F.col("text"), model).alias("s")).collect()}
    assert max(abs(got[r] - w) for r, w in zip(rows, wanted, strict=True)) < 1e-6


# ---------------------------------------------------------------- the pipeline on odd rows
@pytest.mark.parametrize("copies", [1, 40])
def test_odd_rows_through_all_stages(spark, tmp_path, copies):
    """NULLs in every column, empty, blank and very long texts, repeated rows and columns with clashing names."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, row string, key long, copies string"
    long_text = " ".join(f"word{k % 4000}" for k in range(40_000))
    base = [
        (1, "A plain text of a few words, and some more of them.", "en", "s", 1, "r", 2, "c"), (None, None, None, None, None, None, None, None), (2, "", "en", "s", 0, "r", 2, "c"),
        (3, " \n\t ", None, None, 3, None, None, None), (4, long_text, "en", "s", 9, "r", 2, "c"), (None, "no id", "en", "s", 1, "r", 2, "c"), (5, "a <|endoftext|> b", "en", "s", 1, "r", 2, "c"),
    ]
    docs = spark.createDataFrame(base * copies, schema)
    spark.createDataFrame([(1, 1, 0), (4, 0, None), (None, 1, 1), (9, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = saved(stage(spark, docs, str(tmp_path)), name)
        assert docs.columns == [c.split()[0] for c in schema.split(", ")], name
    left = Counter(r.text or "" for r in docs.collect())
    assert left["A plain text of a few words, and some more of them."] == 1 and set(left.values()) == {1}
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert sum(r.length for r in packed) == sum({(r.doc_id, r.doc_tokens, r.start): r.length for r in packed}.values()) and all(0 < r.length <= 1024 for r in packed)
