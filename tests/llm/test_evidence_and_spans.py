"""Language evidence without a page's own, against leaving pages out one by one; spans beside base spans; similarity bounds."""

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.test_operators import classes
from veilframe.llm import language, near_dedup, secrets
from veilframe.llm.common import table


def left_out(pages, model):
    """{page: posterior} with every sum taken over the other pages, one page at a time."""
    html = pa.array([re.sub(r"<[^>]*>", " ", p[2] or "") for p in pages])
    e = model.evidence(html)
    t = np.exp(e - e.max(1, keepdims=True))
    t /= t.sum(1, keepdims=True)
    host = [re.sub(r"^\w+://|/.*$", "", p[1] or "") if "://" in (p[1] or "") else "" for p in pages]
    numeric = [re.fullmatch(r"[0-9.]+", h) for h in host]
    suffix = ["" if x else h.rpartition(".")[2] if "." in h else "" for h, x in zip(host, numeric, strict=True)]
    parts = [h.split(".") for h in host]
    domain = [
        h if x else "" if len(p) < 2 else ".".join(p[-3:]) if len(p) > 2 and len(p[-1]) == 2 and p[-2] in language.SECOND_LEVEL else ".".join(p[-2:])
        for h, x, p in zip(host, numeric, parts, strict=True)
    ]
    declared = [(re.findall(r'<html lang="(\w+)', p[2] or "") or [""])[0] for p in pages]
    out = []
    for i in range(len(pages)):
        others = [j for j in range(len(pages)) if j != i]

        def total(values, i=i, others=others):
            same = [j for j in others if values[j] == values[i]]
            return t[same].sum(0), len(same)

        share = (t[others].sum(0) + 1) / (len(others) + len(model.names))
        d, dn = total(domain)
        h, hn = total(host)
        prior = np.log((h + language.SMOOTH * (d + language.SMOOTH * share) / (dn + language.SMOOTH)) / (hn + language.SMOOTH))
        logs = e[i] + prior
        for values in (declared, suffix):
            if values[i]:
                logs = logs + np.log((total(values)[0] + language.DOUBT * share) / share)
        p = np.exp(logs - logs.max())
        out.append(p / p.sum())
    return out


def test_a_page_is_no_evidence_for_itself(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = language.train(docs)
    text = {r.lang: r.text[:500] for r in docs.where("length(text) > 500").collect()}
    rows = [(f"http://a.one.com/{k}", f'<html lang="en"><p>{text["en"]}</p></html>') for k in range(60)]
    rows += [(f"http://b.zwei.de/{k}", f"<p>{text['de'][k:]}</p>") for k in range(9)] + [(f"http://w.site.co.uk/{k}", f"<p>{text['en'][k:]}</p>") for k in range(3)]
    mixed = " ".join(text["en"].split()[:3] + text["fr"].split()[:4])
    rows += [("http://alone.rare.fr/x", f"<p>{mixed}</p>"), ("http://other.site.co.uk/", f"<p>{text['fr'][:40]}</p>"), ("http://10.0.0.1/x", "<p>la</p>"), ("http://10.0.0.2/x", "<p></p>")]
    rows += [(None, None), ("", ""), ("nowhere", f"<p>{text['es'] * 300}</p>"), ("nowhere", f"<p>{text['es'] * 300}</p>")]
    pages = [(k, *r) for k, r in enumerate(rows)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("t", F.lit("x")).repartition(3)
    got = {r.page_id: r for r in language.identify(df, model).collect()}
    for (k, *_), p in zip(pages, left_out(pages, model), strict=True):
        assert abs(got[k].confidence - p.max()) < 1e-6, k
        assert p[model.names.index(got[k].lang)] > p.max() - 1e-6
    # a rare suffix and a host of its own leave a page to its text and the languages' shares
    alone = got[len(pages) - 8]
    assert alone.host == "alone.rare.fr" and alone.lang == alone.text_lang


def test_what_base_spans_leave_of_a_run_is_scored(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    samples = secrets.samples_of(docs, table(spark, sf_dir, "labels"))
    rest = "Zq8kX2vTn0LwYb7RrJmX"
    texts = [f"see sk_live_4f3c2b1a9d8e7f60{rest} here", f"{rest}4f3c2b1a9d8e7f60{rest}", f"token={rest}", "ordinary_words_4f3c2b1a9d8e7f60_and_more_words_here", f"4f3c2b1a9d8e7f60{rest[:9]}"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [(s["kind"], s["start"], s["end"]) for s in r.spans] for r in secrets.find_secrets(df, samples).collect()}
    assert got[0] == [("hex", 12, 28), ("markov", 28, 48)]
    assert got[1] == [("markov", 0, 20), ("hex", 20, 36), ("markov", 36, 56)]
    assert got[2] == [("assign", 0, 26)] and got[3] == [("hex", 15, 31)] and got[4] == [("hex", 0, 16)]


def test_held_out_keys_and_identifiers(spark, sf_dir):
    """Keys made by other rules than the samples', and identifiers of words that no sample holds."""
    rng = np.random.default_rng(11)
    letters = list("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")
    keys = ["".join(rng.choice(letters, 28)) for _ in range(150)]
    docs = table(spark, sf_dir, "documents")
    samples = secrets.samples_of(docs, table(spark, sf_dir, "labels"))
    known = {r.text for r in samples.where("not random").collect()}
    words = sorted({w for r in table(spark, sf_dir, "conversations").collect() for w in re.findall("[a-z]{4,12}", r.text.lower())} - known)
    names = ["_".join(rng.choice(words, 4)) for _ in range(300)]
    rows = [(i, f"x {k} y") for i, k in enumerate(keys)] + [(1000 + i, f"x {n} y") for i, n in enumerate(names)]
    found = secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string"), samples).where(F.size("spans") > 0).collect()
    hits = {r.doc_id for r in found if any(s["kind"] == "markov" for s in r.spans)}
    recall, false = sum(i < 1000 for i in hits) / len(keys), sum(i >= 1000 for i in hits)
    assert recall >= 0.95 and false <= 3, (recall, false)


def test_a_similarity_below_the_bands_is_refused(spark):
    with pytest.raises(ValueError, match="0.8"):
        near_dedup.near_classes(spark.createDataFrame([], "doc_id long, text string"), threshold=0.6)


@pytest.mark.parametrize("block", [3, 256])
def test_families_in_many_blocks_keep_every_link(spark, monkeypatch, block):
    """Copies at many distances, whose buckets hold several components at home and beside it, in blocks of a few texts."""
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    rng = np.random.default_rng(21)
    docs = []
    for family in range(3):
        base = [f"f{family}w{k}" for k in range(130)]
        for i in range(45):
            copy = list(base)
            for at in rng.choice(130, rng.integers(0, 9), replace=False):
                copy[at] = f"x{family}y{i}z{at}"
            docs.append((family * 100 + i, " ".join(copy)))
    got = near_dedup.near_classes(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()
    groups = Counter(tuple(sorted(str(r.doc_id) for r in got if r.class_id == c)) for c in {r.class_id for r in got})
    assert groups == classes(docs)
