"""The dealt operators on small fixtures: against brute force, round trips and held-out rows, and on odd input."""

import hashlib
import itertools
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from checks.compare import compare, connect
from veilframe.llm import chat, exact_dedup, language, mixing, near_dedup, packing, quality, secrets, sharding, topk
from veilframe.llm.queries import ORACLES, QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, sha string, kept string"


def words(seed: int, n: int) -> list[str]:
    rng = np.random.default_rng(seed)
    return ["".join(rng.choice(list("abcdefghijklmnop"), 5)) for _ in range(n)]


@pytest.fixture(scope="module")
def odd(spark):
    """NULLs in every column, empty and very long texts, ties, repeated rows, and columns named like inner ones."""
    long_text = " ".join(words(1, 30_000))
    base = " ".join(words(2, 120))
    near = base.rsplit(" ", 3)[0] + " other ending words"
    rows = [
        (1, base, "en", "a", 1, "r", "s", "k"), (2, base, "en", "a", 1, "r", "s", "k"), (3, near, None, None, None, None, None, None), (None, base, "en", "a", 1, "x", "y", "z"),
        (4, None, "en", "a", 0, "r", "s", "k"), (5, "", "en", "a", 0, "r", "s", "k"), (None, None, None, None, None, None, None, None), (6, long_text, "en", "a", 9, "r", "s", "k"),
        (7, "one", "en", "a", 3, "r", "s", "k"), (7, "one", "en", "a", 3, "r", "s", "k"), (7, "two", "en", "a", 3, "r", "s", "k"), (8, "  \n\t ", "en", "a", 5, "r", "s", "k"),
    ]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def plain(df):
    return [tuple(r) for r in df.collect()]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, sf_dir, name):
    assert compare(spark, connect(sf_dir), QUERIES[name], ORACLES[name], sf_dir) is None


# ---------------------------------------------------------------- 1 exact dedup
def test_trie_keeps_strings_apart():
    rng = np.random.default_rng(0)
    keys = [bytes(rng.integers(97, 99, rng.integers(0, 9), dtype=np.uint8)) for _ in range(2000)]
    trie, seen = exact_dedup.Trie(), Counter(keys)
    for key in keys:
        node = trie.insert(key)
        node.owner = [key, (node.owner or [None, 0])[1] + 1]
    assert {k: n for k, n in trie.owners()} == dict(seen)


@pytest.mark.parametrize("budget", [1, 1 << 20])
def test_exact_dedup_odd_rows(spark, odd, empty, budget):
    got = exact_dedup.exact_groups(odd, keep="largest", trie_bytes=budget).collect()
    texts = [r.text or "" for r in odd.collect()]
    assert len(got) == len(texts)
    assert Counter(r.text_sha256 for r in got) == Counter(hashlib.sha256(t.encode()).hexdigest() for t in texts)
    by = {}
    for r in got:
        by.setdefault(r.text_sha256, []).append(r)
    for group in by.values():
        ids = [r.doc_id for r in group if r.doc_id is not None]
        assert {r.keep_id for r in group} == {max(ids) if ids else None} and {r.group_size for r in group} == {len(group)} and sum(r.kept for r in group) == 1
    stay = exact_dedup.exact_dedup(odd, keep="largest", trie_bytes=budget)
    assert stay.schema == odd.schema and stay.count() == len(by)
    assert {r.doc_id for r in stay.collect()} == {2, 3, 5, 6, 7, 8}
    smallest = exact_dedup.exact_dedup(odd, trie_bytes=budget).collect()
    assert {r.doc_id for r in smallest} == {1, 3, 4, 6, 7, 8}
    assert exact_dedup.exact_groups(empty).count() == 0 and exact_dedup.exact_dedup(empty).count() == 0


# ---------------------------------------------------------------- 2 top-k
def brute(vectors, k):
    whole = [(i, [int(np.floor(64 * x)) for x in v]) for i, v in vectors if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, q in whole:
        if i % 20 == 0:
            found = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(q, c)))), j) for j, c in whole if j != i)[:k]
            out += [(i, rank + 1, j, -s) for rank, (s, j) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("scale", [1.0, 1e6, 1e17])
def test_topk_ties_and_odd_vectors(spark, scale):
    rng = np.random.default_rng(3)
    vectors = [(int(i), [float(x) * scale for x in rng.integers(-2, 3, 4)]) for i in range(90)]
    vectors += [(100, [1.0, 1.0]), (101, None), (102, [1.0, None, 1.0, 1.0]), (103, [float("nan")] * 4), (104, [float("inf"), 0.0, 0.0, 0.0]), (None, [1.0] * 4)]
    vectors += [(200 + i, [1.0 * scale] * 4) for i in range(60)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").withColumn("block", F.lit("x")).repartition(3)
    got = topk.top_k(df.where("vec_id % 20 = 0"), df, 20)
    assert sorted(plain(got)) == brute(vectors, 20)


def test_topk_few_candidates(spark):
    df = spark.createDataFrame([(0, [0.5]), (1, [0.25]), (20, [1.0])], "vec_id long, embedding array<double>")
    assert sorted(plain(topk.top_k(df.where("vec_id % 20 = 0"), df, 20))) == brute([(0, [0.5]), (1, [0.25]), (20, [1.0])], 20)
    assert topk.top_k(df.limit(0), df, 20).count() == 0


def test_topk_broadcasts_no_vectors(spark):
    """Many teams and chunks, every pair of blocks in one of them; nothing that grows goes through the driver."""
    vectors = [(i, [float(i % 7), float(i % 11) - 5]) for i in range(400)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").repartition(5)
    left, right = (topk.blocks(d.select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x * 64).alias("v")), "test") for d in (df, df))
    one = F.struct(F.lit(0).cast("decimal(20,0)").alias("low"), F.lit(1).cast("bigint").alias("left"))
    state = left.select("block", F.array_repeat(one, F.col("n").cast("int")).alias("state"))
    met = topk.met(left, right, state, 3, 4)
    pairs = met.where("side = 0").select("team", "chunk", F.col("block").alias("q")).join(met.where("side = 1").select("team", "chunk", "block"), ["team", "chunk"])
    assert pairs.count() == pairs.select("q", "block").distinct().count() == left.count() * right.count()
    got = topk.top_k(df.where("vec_id % 20 = 0"), df, 20)
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(plain(got)) == brute(vectors, 20)


# ---------------------------------------------------------------- 3 packing
TRICKY = [
    "", "  a b  c", "a  b", " lead", "trail ", "x\ty  z\n\n q", "it's we'll 'S   nb  sp", "<|endoftext|> hi", "日本語 テキスト", "a  b", "\n \n", "a \n b", "é è  ê", " ",
    "1234 567  89\r\n x", "\u0085 k", "k\u001c z", "a" * 3000, "one two. Three\nfour (five) six!! $$$ x_y",
]


def reference_ids(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    return [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_ids_equal_the_tokenizer_file(spark, sf_dir):
    import public_tokenizers

    texts = TRICKY + [r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = packing.encode(pa.array(texts), public_tokenizers.path(packing.RANKS))
    assert [list(map(int, x)) for x in got] == reference_ids(texts)


def check_pieces(pieces, texts):
    want = Counter((i, zlib.crc32(np.array([*ids, 0], "<u4").tobytes()), len(ids) + 1) for (i, _), ids in zip(texts, reference_ids([t or "" for _, t in texts])))
    assert sum(p.length for p in pieces) == sum(n * k for (_, _, n), k in want.items())
    sequences = {}
    for p in pieces:
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
    assert sorted(sequences) == list(range(len(sequences)))
    short = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        short += at < 1024
        assert at <= 1024
    assert short <= 1
    whole = Counter((p.doc_id, p.ids_crc32, p.doc_tokens) for p in pieces if p.length == p.doc_tokens)
    assert all(want[k] >= n for k, n in whole.items())


def test_packing_odd_rows(spark, odd, empty):
    check_pieces(packing.pack(odd).collect(), [(r.doc_id, r.text) for r in odd.collect()])
    windows = packing.sequences(odd).collect()
    assert sum(len(w.tokens) for w in windows) == 2 * sum(p.length for p in packing.pack(odd).collect())
    assert all(len(w.tokens) // 2 + w.padding in (1024, 1 << (len(w.tokens) // 2).bit_length() - 1) for w in windows)
    assert packing.pack(empty).count() == 0 and packing.sequences(empty).count() == 0


def test_marks_are_the_tokenizers_by_default(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    mark = "<|endoftext|>"
    texts = TRICKY + [mark, mark * 3, f"a {mark} b", f"{mark} x", f"x  {mark}", f"é {mark}\n\n {mark}  z", f"<|endoftext {mark}|>", "plain"]
    want = [e.ids for e in Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode_batch(texts, add_special_tokens=False)]
    got = packing.token_ids(pa.array(texts), public_tokenizers.path(packing.RANKS))
    assert [list(map(int, x)) for x in got] == want and [64, 220, 50256, 275] in want
    pieces = packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)).collect()
    sums = {i: (len(ids) + 1, zlib.crc32(np.array([*ids, 0], "<u4").tobytes())) for i, ids in enumerate(want)}
    assert all(p.doc_tokens == sums[p.doc_id][0] and (p.length < p.doc_tokens or p.ids_crc32 == sums[p.doc_id][1]) for p in pieces)
    assert {p.doc_id for p in pieces} == set(sums)


# ---------------------------------------------------------------- 4 near duplicates
def test_similarity_is_probability_jaccard():
    rng = np.random.default_rng(5)
    for _ in range(50):
        x, y = rng.integers(0, 4, 12), rng.integers(0, 4, 12)
        if not x.any() or not y.any():
            continue
        want = sum(1 / sum(max(a / x[i], b / y[i]) for a, b in zip(x, y)) for i in range(12) if x[i] and y[i])
        sets = [(np.flatnonzero(v).astype(np.uint64), v[v > 0], None) for v in (x, y)]
        assert abs(near_dedup.similarity(*sets) - want) < 1e-9


def test_signatures_estimate_the_similarity():
    a, b = words(7, 400), words(8, 400)
    texts = [" ".join(a), " ".join(a[:360] + b[:40]), " ".join(a + a[:50])]
    weighed = [near_dedup.weigh(t) for t in texts]
    found = near_dedup.signatures(3, *near_dedup.shingles(pa.array(texts)))
    for i, j in itertools.combinations(range(3), 2):
        assert abs((found[i] == found[j]).mean() - near_dedup.similarity(weighed[i], weighed[j])) < 0.12


def classes(docs):
    """By brute force over all pairs of different texts."""
    texts = sorted({t or "" for _, t in docs})
    sets = [near_dedup.weigh(t) for t in texts]
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        if near_dedup.similarity(sets[i], sets[j]) >= 0.8:
            parent[root(i)] = root(j)
    groups = {}
    for i, t in docs:
        groups.setdefault(root(texts.index(t or "")), []).append(i)
    return Counter(tuple(sorted(map(str, g))) for g in groups.values())


def test_near_classes_against_all_pairs(spark, odd, empty):
    rng = np.random.default_rng(9)
    family = words(10, 150)
    docs = [(r.doc_id, r.text) for r in odd.collect()]
    for i in range(100, 160):  # one family of many distances, in buckets with several components
        copy = list(family)
        for at in rng.choice(150, rng.integers(0, 7), replace=False):
            copy[at] = f"changed{i}"
        docs.append((i, " ".join(copy)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = near_dedup.near_classes(df).collect()
    groups = {}
    for r in got:
        groups.setdefault((r.class_id, r.class_rows), []).append(str(r.doc_id))
    assert Counter(tuple(sorted(g)) for g in groups.values()) == classes(docs)
    stay = near_dedup.near_dedup(odd)
    assert stay.schema == odd.schema and Counter(r.doc_id for r in stay.collect()) == Counter([1, 4, 6, 7, 7, 8])
    assert near_dedup.near_classes(empty).count() == 0 and near_dedup.near_dedup(empty).count() == 0


# ---------------------------------------------------------------- 5 mixing
def test_rates_meet_targets(spark):
    rows = [(i, str(i), 100, *((0.9, 0.1) if i % 4 else (0.2, 0.8))) for i in range(4000)]
    members = spark.createDataFrame(rows, "id long, sha string, tokens long, p_0 double, p_1 double")
    rates, history = mixing.fit_rates(members, {"a": 0.6, "b": 0.4})
    total = 400_000
    for i, w in enumerate((0.6, 0.4)):
        got = rates.agg(F.sum(F.col("rate") * F.col("tokens") * F.col(f"p_{i}"))).first()[0]
        assert abs(got / total - w) < 1e-3
    assert rates.agg(F.min("rate")).first()[0] >= 0 and max(map(abs, history[-1].values())) < max(map(abs, history[0].values()))


def test_mixing_odd_rows(spark, odd, empty):
    labelled = spark.createDataFrame([(1, "x"), (3, "y"), (6, "y"), (None, "x"), (2, None)], "doc_id long, domain string")
    targets = {"x": 0.5, "y": 0.5}
    mixed = mixing.mix(odd, labelled, targets).collect()
    assert len(mixed) == odd.count() and all(m.rate >= 0 and abs(m.p_0 + m.p_1 - 1) < 1e-9 for m in mixed)
    applied = mixing.apply_mix(odd, mixing.mix(odd, labelled, targets))
    assert applied.schema == odd.schema and applied.count() == sum(m.copies for m in mixed)
    assert mixing.mix(empty, labelled, targets).count() == 0


def test_shares_are_those_of_labelled_texts_in_docs(spark):
    """Labels of documents that earlier stages removed say nothing about those that are left."""
    docs = spark.createDataFrame([(i, f"plain text {i}") for i in range(40)], "doc_id long, text string")
    labelled = spark.createDataFrame([(i, "x" if i < 30 else "y") for i in range(40)] + [(i, "z") for i in range(100, 200)], "doc_id long, domain string")
    targets = {"x": 0.7, "y": 0.3, "z": 0.0}
    _, shares = mixing.word_model(docs, labelled, list(targets))
    assert shares["z"] == 0 and abs(shares["x"] - 31 / 42) < 1e-9 and abs(sum(shares.values()) - 1) < 1e-9
    mixed = mixing.mix(docs, labelled, targets).collect()
    assert all(m.p_2 == 0 and abs(m.p_0 + m.p_1 - 1) < 1e-9 for m in mixed)
    _, alone = mixing.word_model(docs, labelled.where("domain = 'z'"), ["x", "y"])
    assert alone == {"x": 0.5, "y": 0.5}


# ---------------------------------------------------------------- 6 secrets
ASSIGN = re.compile(secrets.PATTERNS[0][1])


def base_spans(text):
    found = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m.group(2)) >= 12]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m.group()) >= 18]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", text) if len(m.group()) >= 16]
    return sorted(found)


def test_secret_spans(spark, odd, empty):
    random_key = "Zq8kX2vTn0LwYb7RrJm4HsD1c"
    texts = [
        'Token="abcdefghijkl"', "password: short secret=0123456789abcdef0123 end", "AKIAABCDEFGHIJKLMN AKIA123 x", "é😀 api-key = 'QQQQQQQQQQQQ' API_KEY:zzzzzzzzzzzz", "token=secret: abcdefghijklmnop",
        "deadbeefdeadbeef", "deadbeef", f"see {random_key} here", "the_quick_brown_fox_jumps", None, "", "apikey=" + "a" * 5000,
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("spans", F.lit("mine")).withColumn("runs", F.lit(1))
    ordinary = spark.createDataFrame([(" ".join(words(i, 4)).replace(" ", "_"), False) for i in range(300)] + [(w, False) for w in ("the_quick_brown", "jumps_over_lazy")] * 20, "text string, random boolean")
    samples = ordinary.unionByName(secrets.random_strings(spark, 2000))
    got = {r.doc_id: [(s.start, s.rank, s.end, s.kind) for s in r.spans] for r in secrets.find_secrets(df, samples).collect()}
    for i, text in enumerate(texts):
        assert [s for s in got[i] if s[3] != "markov"] == base_spans(text or ""), text
    assert [s[3] for s in got[7]] == ["markov"] and texts[7][got[7][0][0] : got[7][0][2]] == random_key and not got[8]
    assert secrets.find_secrets(odd, samples).count() == odd.count() and secrets.find_secrets(empty, samples).count() == 0
    assert secrets.find_secrets(df, samples.where("random")).count() == len(texts)


# ---------------------------------------------------------------- 7 sharding
def test_shards_are_even_and_keep_copies_together(spark, odd, empty):
    docs = spark.createDataFrame([(i, f"text {i // 3 if i < 600 else i} {'hot' if i >= 900 else ''}" if i < 900 else "hot") for i in range(1300)], "doc_id long, text string")
    got = sharding.shard(docs, shards=6).collect()
    counts = Counter(r.shard for r in got)
    assert max(counts.values()) - min(counts.values()) <= 1 and len(counts) == 6
    for s in counts:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(counts[s]))
    together = {}
    for r in got:
        if r.doc_id < 600:
            together.setdefault(r.doc_id // 3, set()).add(r.shard)
    assert sum(len(s) == 1 for s in together.values()) > 180
    for r in sharding.shard(odd, shards=24).collect():
        assert r.slot >= 0 and 0 <= r.shard < 24 and r.size >= 8
    assert sharding.shard(odd).count() == odd.count() and sharding.shard(empty).count() == 0


# ---------------------------------------------------------------- 8 quality
def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op8_quality_classifier"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    assert len(got) > 50 and sum(r.predicted == r.quality for r in got) >= 0.97 * len(got)


def test_quality_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1), (3, 1), (6, 0), (7, 0), (None, 1), (2, None)], "doc_id long, quality int")
    for model in (quality.train(odd, labels), quality.train(odd, labels.limit(0)), quality.train(empty, labels), quality.train(odd, labels.where("quality = 1"))):
        scores = [r[0] for r in odd.select(quality.score(F.col("text"), model)).collect()]
        assert len(scores) == odd.count() and all(0 <= s <= 1 for s in scores)
        assert quality.keep_good(odd, model).schema == odd.schema and quality.keep_good(empty, model).count() == 0


# ---------------------------------------------------------------- 9 language
def test_languages_by_all_evidence(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = language.train(docs)
    assert set(model.names) == {"de", "en", "es", "fr"}
    text = {r.lang: r.text[:600] for r in docs.where("length(text) > 600").collect()}
    rows = [(i * 10 + k, f"http://{lang}.site.{lang}/p{k}", f'<html lang="{lang}"><body><p>{text[lang]}</p></body></html>') for i, lang in enumerate(sorted(text)) for k in range(5)]
    rows += [(100, "http://de.site.de/x", "<p></p>"), (101, None, None), (None, "", ""), (102, "notaurl", f"<script>{text['en']}</script><p>{text['fr']}")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("mine")).withColumn("e", F.lit(1))
    got = {r.page_id: r for r in language.identify(pages, model).collect()}
    assert all(got[i * 10 + k].lang == lang for i, lang in enumerate(sorted(text)) for k in range(5))
    assert got[100].lang == "de" and got[102].lang == "fr" and all(0 < r.confidence <= 1 for r in got.values()) and len(got) == len(rows)
    assert language.identify(pages.limit(0), model).count() == 0
    assert language.train(docs.limit(0)) is None and {r.lang for r in language.identify(pages, None).collect()} == {None}


# ---------------------------------------------------------------- 10 chats
def test_chats_round_trip(spark):
    texts = ["</turn>", "<turn:user>", "<next/>", r"<\next/>", r"a\<\\/turn>", "<", "", None, "plain", "x<turn:", r"\### Assistant: </turn> ok"]
    roles = ["user", "assistant", "user", "user", "assistant", "a<b>%3C", None, "assistant", "assistant", "", "user"]
    rows = [(1, k, roles[k], t) for k, t in enumerate(texts)] + [(2, None, "assistant", "b"), (2, None, "assistant", "a"), (None, 1, "user", "x"), (None, 1, "user", "x"), (3, 1, "user", "y"), (3, 1, "user", "y")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("ts", F.lit(1)).withColumn("formatted", F.lit("f")).repartition(4)
    back = chat.read_chats(chat.format_chats(turns)).collect()
    by = {r.conv_id: r for r in back}
    assert [(t.role, t.text) for t in by[1].turns] == [(roles[k] or "", t or "") for k, t in enumerate(texts)]
    assert by[1].loss_text == "".join(t or "" for t, r in zip(texts, roles) if r == "assistant") and by[1].formatted.count("</turn>") == len(list(itertools.groupby(r or "" for r in roles)))
    assert [t.text for t in by[2].turns] == ["a", "b"] and len(by[3].turns) == 2 and sum(r.conv_id is None for r in back) == 2
    assert chat.format_chats(turns.limit(0)).count() == 0
