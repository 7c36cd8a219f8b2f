"""The pipeline's stages, each on what the one before it kept."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_operators import check_pieces, classes
from veilframe.llm import mixing
from veilframe.llm.common import saved, table
from veilframe.llm.queries import domains_of


def test_stages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    names = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        kept[name] = saved(stage(spark, docs, sf_dir), name)
        before, docs = docs, kept[name]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "exact_dedup", "near_dedup", "mixing", "packing"]
    assert all(kept[n].columns == names for n in list(kept)[:-1])
    rows = {n: kept[n].collect() for n in kept}
    good = {r.doc_id: r.quality for r in table(spark, sf_dir, "labels").collect()}
    dropped = {r.doc_id for r in table(spark, sf_dir, "documents").collect()} - {r.doc_id for r in rows["quality_classifier"]}
    assert sum(good.get(i) == 1 for i in dropped) <= 1 and sum(good.get(i) == 0 for i in dropped) >= 0.9 * sum(q == 0 for q in good.values())
    largest = {}
    for r in rows["quality_classifier"]:
        largest[r.text] = max(r.doc_id, largest.get(r.text, -1))
    assert sorted(largest.values()) == sorted(r.doc_id for r in rows["exact_dedup"])
    groups = classes([(r.doc_id, r.text) for r in rows["exact_dedup"]])
    stay = {str(r.doc_id) for r in rows["near_dedup"]}
    assert len(stay) == len(rows["near_dedup"]) and all(len(stay & set(g)) == 1 for g in groups)
    assert {r.doc_id for r in rows["mixing"]} <= {r.doc_id for r in rows["near_dedup"]}
    assert max(Counter(r.doc_id for r in rows["mixing"]).values()) <= 5
    check_pieces(rows["packing"], [(r.doc_id, r.text) for r in rows["mixing"]])
    assert before.count() == len(rows["mixing"])


def test_mixing_reaches_its_targets(spark):
    """Expected shares after mixing, on what the stages before it keep; fewer labelled texts leave too many words untold (README)."""
    sf_dir = "/root/testdata/sf0.1"
    docs = table(spark, sf_dir, "documents")
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = saved(stage(spark, docs, sf_dir), name)
    mixed = saved(mixing.mix(docs, domains_of(table(spark, sf_dir, "labels")), corpus_pipeline.TARGETS), "mixed")
    tokens = F.col("rate") * F.col("tokens")
    *got, total = mixed.agg(*[F.sum(tokens * F.col(f"p_{i}")) for i in range(len(corpus_pipeline.TARGETS))], F.sum(tokens)).first()
    assert all(abs(t / total - want) < 0.01 for t, want in zip(got, corpus_pipeline.TARGETS.values(), strict=True))


@pytest.mark.parametrize(("one_in", "least", "most"), [(50, 0.95, 1.05), (10, 0.0, 0.4), (4, 0.0, 0.15)])
def test_mixing_other_mixes(spark, tmp_path, one_in, least, most):
    """Toxic shares go down to the target and never up, whatever the corpus's own mix; clean documents stay."""
    toxic = {i for i in range(3000) if i % one_in == 0}
    docs = spark.createDataFrame([(i, f"{'vile rot' if i in toxic else 'fair day'} and w{i} so on") for i in range(3000)], "doc_id long, text string")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(3000)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = Counter(r.doc_id for r in corpus_pipeline.mix_domains(spark, docs, str(tmp_path)).collect())
    assert all(got[i] >= 1 for i in range(3000) if i not in toxic)
    assert least <= sum(got[i] for i in toxic) / len(toxic) <= most
    assert sum(got[i] for i in toxic) / sum(got.values()) < 0.04


def test_empty_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = saved(stage(spark, docs, sf_dir), name)
    assert docs.count() == 0
