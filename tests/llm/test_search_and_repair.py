"""Decontamination, conversation repair and lexical search: against brute force, in small blocks and pieces, and on odd input."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from veilframe.llm import decontaminate, lexical, repair
from veilframe.llm.fm_index import FMIndex

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return [t.translate(LOWER) for t in TERM.findall(text or "")]


@pytest.fixture(scope="module")
def words():
    rng = np.random.default_rng(5)
    return [f"{w}{i % 7}" for i, w in enumerate(["Ab", "été", "ß", "日本", "İx", "naïve", "k", "Zz", "x", "q"] * 4)], rng


@pytest.fixture(scope="module")
def docs(spark, words):
    pool, rng = words
    gaps = [" ", "\n", ", ", "--", "\x00", "[", "`"]
    rows = [(i, "".join(w + gaps[rng.integers(len(gaps))] for w in rng.choice(pool, rng.integers(1, 80))), "row", "t") for i in range(80)]
    rows += [(i + 100, rows[i][1], None, None) for i in range(20)] + [(None, rows[0][1], None, None), (200, None, "r", "w"), (201, "", "r", "w"), (202, " \n-", "r", "w"), (203, " ".join(rng.choice(pool, 20_000)), "r", "w"), (5, rows[5][1], "row", "t")]
    return spark.createDataFrame(rows, "doc_id long, text string, row string, spans string").repartition(5)


@pytest.fixture(scope="module")
def items(spark, docs, words):
    pool, rng = words
    texts = [r.text for r in docs.where(F.length("text") < 900).collect()]
    rows = []
    for i in range(30):
        some = terms(texts[rng.integers(len(texts))])
        begin = rng.integers(max(len(some) - 5, 1))
        rows.append((i, "; ".join(some[begin : begin + rng.integers(1, 30)]).upper() if i % 3 else " ".join(rng.choice(pool, rng.integers(1, 15))), "item"))
    rows += [(3, "ab0 ÉTÉ1", "x"), (None, rows[1][1], "x"), (40, None, "x"), (41, "  ", "x"), (42, "k6 k6 k6", "x"), (43, "nowhere", "x")]
    return spark.createDataFrame(rows, "item_id long, text string, score string").repartition(3)


# ---------------------------------------------------------------- 11 decontamination
def windows_of(items):
    out = set()
    for r in items.collect():
        w = terms(r.text)
        out |= {(tuple(w[i : i + 10]), r.item_id) for i in range(max(len(w) - 9, min(len(w), 1)))}
    return out


def brute_hits(text, windows):
    w, hit, held = terms(text), set(), set()
    for window, item in windows:
        for i in range(len(w) - len(window) + 1):
            if tuple(w[i : i + len(window)]) == window:
                hit |= set(range(i, i + len(window)))
                held.add(item)
    return len(w), hit, held


@pytest.mark.parametrize("block_bytes", [1 << 20, 300])
def test_decontamination_equals_brute_force(spark, docs, items, monkeypatch, block_bytes):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block_bytes)
    windows = windows_of(items)
    found = decontaminate.contamination(docs, items, [F.col("doc_id")]).collect()
    assert len(found) == docs.count()
    for r in found:
        n, hit, held = brute_hits(r.text, windows)
        assert (r.n_words, r.n_hit, set(r.item_ids)) == (n, len(hit), {None if i is None else str(i) for i in held})
        marked = [w for s in r.spans for w in range(s["word"], s["word"] + s["words"])]
        assert marked == sorted(hit)
        assert [terms(r.text[s["start"] : s["end"]]) for s in r.spans] == [terms(r.text)[s["word"] : s["word"] + s["words"]] for s in r.spans]
    assert sum(r.n_hit > 0 for r in found) > 20


def test_decontaminated_rows_keep_their_columns(spark, docs, items):
    clean = decontaminate.decontaminate(docs, items)
    assert clean.columns == docs.columns and clean.count() == docs.count()
    found = {(r.doc_id, r.text): r for r in decontaminate.contamination(docs, items, [F.col("doc_id")]).collect()}
    pairs = docs.select("doc_id", "text").collect()
    left = Counter((r.doc_id, r.text, r.row) for r in clean.collect())
    for r in pairs:
        cut, at = "", 0
        for s in found[r.doc_id, r.text or ""].spans:
            cut, at = cut + r.text[at : s["start"]], s["end"]
        wanted = None if r.text is None else cut + r.text[at:]
        assert any(k[:2] == (r.doc_id, wanted) for k in left)


def test_long_texts_in_pieces(words, monkeypatch):
    """A text cut into pieces has the hits it has whole, also where a window crosses a cut, and hits known before are kept."""
    pool, rng = words
    text = " ".join(rng.choice(pool[:6], 900))
    w = terms(text)
    rows = [("a", " ".join(w[i : i + 14])) for i in range(0, 880, 37)] + [("b", " ".join(w[5:8]))]
    windows = decontaminate.Windows.of(rows, 10)
    names = ["text", "n_words", "n_hit", "spans", "item_ids"]
    span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("word", pa.int32()), ("words", pa.int32())])
    batch = pa.record_batch([pa.array([text]), pa.array([0]), pa.array([0]), pa.array([[]], pa.list_(span)), pa.array([[]], pa.list_(pa.string()))], names)
    whole = decontaminate._search(batch, windows, 10)
    monkeypatch.setattr(decontaminate, "SHARD_BYTES", 150)
    assert decontaminate._search(batch, windows, 10).to_pydict() == whole.to_pydict()
    one_by_one = batch
    for r in rows:
        one_by_one = decontaminate._search(one_by_one, decontaminate.Windows.of([r], 10), 10)
    assert one_by_one.to_pydict() == whole.to_pydict()


def test_equal_hashes_are_no_hits(monkeypatch):
    monkeypatch.setattr(decontaminate, "word_hashes", lambda data, starts, ends: np.zeros(len(starts), np.uint64))
    data, gaps = decontaminate.folded(pa.array(["one two three", "two one"]))
    starts, ends = decontaminate.bounds(data)
    word, size, _ = decontaminate._places(data, gaps, starts, ends, decontaminate.Windows.of([("a", "one two"), ("b", "two one")], 10))
    assert sorted(zip(word.tolist(), size.tolist(), strict=True)) == [(0, 2), (3, 2)]


def test_fm_index():
    rng = np.random.default_rng(1)
    for trial in range(60):
        texts = [rng.integers(1, rng.integers(2, 6), rng.integers(0, 40)) for _ in range(rng.integers(1, 5))] * (1 + trial % 2)
        sequence = np.concatenate([np.r_[t, 0] for t in texts]).astype(np.int64)
        if not sequence.max():
            continue
        index = FMIndex(sequence)
        for m in (1, 2, 4):
            phrases = rng.integers(1, sequence.max() + 1, (8, m))
            for p, low, high in zip(phrases, *index.search(phrases), strict=True):
                wanted = [i for i in range(len(sequence) - m + 1) if (sequence[i : i + m] == p).all()]
                assert sorted(index.locate(np.arange(low, high))) == wanted


def test_nothing_to_decontaminate(docs, items):
    assert decontaminate.contamination(docs.limit(0), items, [F.col("doc_id")]).count() == 0
    assert all(r.n_hit == 0 and not r.spans and not r.item_ids for r in decontaminate.contamination(docs, items.limit(0), [F.col("doc_id")]).collect())


# ---------------------------------------------------------------- 12 conversation repair
def plain_repair(kinds):
    """(cost, audit) by one table over all rows and states, with the edits spelled out."""
    follow = {0: 2, 1: 2, 2: 3, 3: 2}
    best = {0: (0, ""), 1: (6, "II"), 2: (3, "I"), 3: (0, "")}
    for kind in reversed(kinds):
        initial, fault = kind % 4, kind // 4
        cut = 3 * (fault == 3)
        without = {}
        for s in range(4):
            ways = [(4 + best[s][0], "D" + best[s][1])]
            if fault not in (1, 2):
                t = follow[s]
                ways.append((3 + cut + best[t][0], "R" + best[t][1]))
                if (initial, s) in ((0, 0), (1, 0), (1, 1), (1, 3), (2, 2)):
                    ways.append((cut + best[initial + 1][0], "K" + best[initial + 1][1]))
            without[s] = min(ways)
        best = {}
        for s in range(4):
            ways, at = [without[s]], s
            for n in (1, 2, 3):
                at = follow[at]
                ways.append((3 * n + without[at][0], "I" * n + without[at][1]))
            best[s] = min(ways)
    return best[0]


def audit_of(kinds):
    steps = [repair.STEPS[k] for k in kinds]
    last = repair.last_state(steps)
    states = repair.crossings(steps, 0, last)
    letters = [repair.EDITS[k][a, b] for k, a, b in zip(kinds, states, states[1:], strict=False)]
    return sum(c for c, _ in letters) + repair.CLOSING[last][0], "".join(e for _, e in letters) + repair.CLOSING[last][1]


def test_hirschberg_finds_the_least_of_the_cheapest_edits():
    rng = np.random.default_rng(2)
    for _ in range(1500):
        kinds = [int(k) for k in rng.choice([0, 1, 1, 2, 2, 3, 5, 6, 9, 10, 12, 13, 14, 15], rng.integers(0, 24))]
        assert audit_of(kinds) == plain_repair(kinds)
    assert all(re.fullmatch("[DIKR]*", audit_of([k])[1]) for k in range(16))


def expected(rows):
    """The contract in plain Python, for rows (turn, role, text) of one conversation."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
    seen, kinds = set(), []
    for _, role, text in rows:
        inked = text.rstrip(" \t\n\x0b\f\r")
        fault = 1 if not inked else 2 if (role, text) in seen else 3 if inked[-1] not in ".!?" else 0
        seen.add((role, text))
        kinds.append("sua".find(role[:1] or "?") % 4 + 4 * fault)
    cost, audit = plain_repair(kinds)
    state, at, lines = 0, 0, []
    for letter in audit:
        role, text = ("user" if state != 2 else "assistant"), ""
        if letter != "I":
            _, own, text = rows[at]
            role, at = (own if letter == "K" else role), at + 1
        if letter != "D":
            lines.append(f"{role}:{text}")
            state = 1 + "sua".index(role[0])
    turns = [r[0] for r in rows if r[0] is not None]
    initials = [r[1][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    n = Counter(k // 4 for k in kinds)
    return gaps, n[1], n[2], n[3], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


@pytest.mark.parametrize("bits", [12, 2])
def test_repair_equals_plain_python(spark, monkeypatch, bits):
    """Odd rows, a conversation with a third of all rows, and chunks of four rows give what one pass over a list gives."""
    monkeypatch.setattr(repair, "CHUNK_BITS", bits)
    rng = np.random.default_rng(3)
    texts = ["Yes.", "no", "", " \n\x0b", "why?  ", "So!", "long " * 3000 + ".", " ", "ends。"]
    roles = ["user", "assistant", "system", "tool", "", None, "user", "assistant"]
    rows = [
        (None if c == 19 else int(c), None if rng.random() < 0.1 else int(rng.integers(-3, 30)), roles[rng.integers(8)], None if rng.random() < 0.05 else texts[rng.integers(9)] + str(rng.integers(4)) * int(rng.integers(2)), "p", 1)
        for c in np.r_[rng.integers(0, 20, 240), np.full(120, 4)]
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, position string, kind int").repartition(6)
    done = repair.repair(df)
    digests = {r.conv_id: r.sha256 for r in repair.digests(done.turns).collect()}
    nothing = hashlib.sha256(b"").hexdigest()
    got = {r.conv_id: (*tuple(r)[1:], digests.get(r.conv_id, nothing)) for r in done.report.collect()}
    grouped = defaultdict(list)
    for conv, turn, role, text, _, _ in rows:
        grouped[conv].append((turn, role or "", text or ""))
    assert got == {conv: expected(r) for conv, r in grouped.items()}


def test_nothing_to_repair(spark):
    done = repair.repair(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    assert done.report.count() == 0 and done.turns.count() == 0 and repair.digests(done.turns).count() == 0


# ---------------------------------------------------------------- 13 lexical search
def plain_search(docs, items, k):
    held = [(r.doc_id, Counter(terms(r.text))) for r in docs.collect()]
    held = [(i, c) for i, c in held if c]
    n_docs, n_terms = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    wanted = defaultdict(Counter)
    for r in items.collect():
        wanted[r.item_id].update(terms(r.text))
    out = []
    for item, own in wanted.items():
        ranked = []
        for doc, c in held:
            m = 75 + 25 * sum(c.values()) * n_docs // n_terms
            score = sum(n * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t, n in own.items() if c[t])
            if score:
                ranked.append((-score, doc is None, doc or 0))
        out += [(item, rank, None if missing else doc, -score) for rank, (score, missing, doc) in enumerate(sorted(ranked)[:k], 1)]
    return out


@pytest.mark.parametrize("block_bytes", [1 << 20, 200])
def test_search_equals_plain_python(docs, items, monkeypatch, block_bytes):
    monkeypatch.setattr(lexical, "BLOCK_BYTES", block_bytes)
    got = [tuple(r) for r in lexical.search(docs, items, 7).collect()]
    assert sorted(got, key=str) == sorted(plain_search(docs, items, 7), key=str)


def test_pieces_lose_no_terms(monkeypatch):
    monkeypatch.setattr(lexical, "PIECE", 11)
    text = "one two three four five six seven eight nine ten " * 20
    words = lexical.Vocabulary.of([("a", "one ten seven three four")])
    batch = pa.record_batch([pa.array(["", text, "ten"])], ["text"])
    doc, term, times, length = lexical.term_counts(batch, words.automaton(), len(words.terms))
    assert length.tolist() == [0, 200, 1]
    assert {(int(d), words.terms[t].decode()): int(n) for d, t, n in zip(doc, term, times, strict=True)} == {**{(1, w): 20 for w in ("one", "ten", "seven", "three", "four")}, (2, "ten"): 1}


def test_nothing_to_search(docs, items):
    assert lexical.search(docs.limit(0), items).count() == 0
    assert lexical.search(docs, items.limit(0)).count() == 0
