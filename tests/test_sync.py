from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from veilframe.functions.masks import mask_table
from veilframe.operators import audit, generate, loads
from veilframe.plans import full_run as runs
from veilframe.plans import sync
from veilframe.plans.full_run import full_run
from veilframe.registry import ENTITY_ORDER, entity
from veilframe.sources.fixtures import bank_tables
from veilframe.sources.snapshots import SnapshotStore


def same(a, b):
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_baseline_twice_is_once_and_delta_adds_the_rest(spark, sf_dir, tmp_path):
    raw = bank_tables(spark, sf_dir)
    store = SnapshotStore(spark, str(tmp_path / "a"))
    for name in ENTITY_ORDER:
        top = raw[name].agg(F.max("id")).first()[0]
        store.replace(name, mask_table(raw[name].where(F.col("id") <= top // 2), name))
    sync.sync_delta(raw, store)
    after = store.read_all()
    assert audit.count_diff(raw, after).where("NOT equal").isEmpty()
    assert sync.delta_summary(raw, after).agg(F.sum("added")).first()[0] == 0
    whole = SnapshotStore(spark, str(tmp_path / "b"))
    sync.sync_baseline(raw, whole)
    sync.sync_baseline(raw, whole)
    assert whole.version("cards") == 2
    assert SnapshotStore(spark, str(tmp_path / "b")).version("cards") == 2
    for name in ("customers", "cards"):
        assert same(whole.read(name), after[name])
    whole.reset()
    assert whole.read("cards").isEmpty()


@pytest.mark.parametrize("n, size, expected", [(6, 3, [(0, 0, 3), (1, 3, 3), (2, 6, 0)]), (5, 3, [(0, 0, 3), (1, 3, 2)]), (0, 3, [(0, 0, 0)])])
def test_pages_end_with_a_short_one(spark, n, size, expected):
    plan = sync.page_plan(spark.range(1, n + 1), "customers", size)
    assert rows(plan.select("page", "since_id", "page_rows"), "page") == expected


def test_page_cap(spark):
    assert sync.page_plan(spark.range(1, 101), "customers", 3, max_pages=4).count() == 4


def test_top_n_with_a_hot_parent(spark):
    df = spark.range(1, 2001).withColumn("p", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50))
    found = rows(sync.top_n_per_parent(df, "p", 4).where("p = 0").select("id"), "id")
    assert found == [(3,), (6,), (9,), (12,)]


def test_generated_bank_is_sound(spark):
    now = datetime(2026, 1, 1)
    made = generate.generate_bank(generate.customer_ids(spark, 400), now)
    n = {e: made[e].count() for e in ENTITY_ORDER}
    assert n["customers"] == 400
    assert 1.3 < n["addresses"] / 400 < 1.7 and 1.8 < n["accounts"] / 400 < 2.2
    assert 0.8 < n["cards"] / n["accounts"] < 1.2 and 11 < n["transactions"] / n["accounts"] < 14
    for name in ENTITY_ORDER:
        ids = made[name].agg(F.min("id"), F.max("id"), F.count_distinct("id")).first()
        assert tuple(ids) == (1, n[name], n[name])
        assert loads.constraint_report(made[name], name).where("reason IS NOT NULL").isEmpty()
        parent = entity(name).parent
        if parent:
            assert loads.missing_parents(made[name], made[parent], entity(name).parent_key).isEmpty()
    assert made["cards"].where("NOT luhn_check(card_number)").isEmpty()
    assert made["accounts"].where("opened_at > '2025-12-02' OR opened_at < '2020-01-01'").isEmpty()
    shares = dict(made["transactions"].groupBy("direction").count().collect())
    assert 0.7 < shares["debit"] / n["transactions"] < 0.8
    more = generate.generate_bank(generate.customer_ids(spark, 5, 400), now, start=n)
    assert more["accounts"].agg(F.min("id")).first()[0] == n["accounts"] + 1
    assert more["customers"].join(made["customers"], ["first_name", "last_name", "ssn"]).isEmpty()


def test_full_run_passes(spark, tmp_path):
    steps, summary = full_run(spark, str(tmp_path / "run"), customers=3)
    assert [r["status"] for r in steps.orderBy("step_no").collect()] == ["done"] * 3
    row = summary.first()
    assert row["verdict"] == "pass" and row["summary"].startswith("PASS · 5 checks · ")


def test_full_run_reports_the_first_failure(spark, tmp_path, monkeypatch):
    # nothing is copied, so the counts differ and no request was made
    no_rows = spark.createDataFrame([], "entity STRING, inserted BIGINT, received BIGINT")
    monkeypatch.setattr(runs, "copy_paged", lambda *args, **kwargs: no_rows)
    steps, summary = full_run(spark, str(tmp_path / "run"), customers=3)
    assert [r["status"] for r in steps.orderBy("step_no").collect()] == ["done", "done", "failed"]
    text = summary.first()["summary"]
    assert text.startswith("FAIL · every request got a reply") and "customers 0/3" in text


def test_audits_tell_raw_from_masked(spark, sf_dir):
    raw = bank_tables(spark, sf_dir)
    masked = {n: mask_table(df, n) for n, df in raw.items()}
    assert audit.mask_audit_full(masked).agg(F.sum("unmasked")).first()[0] == 0
    assert audit.mask_audit_full(raw).where("unmasked = 0").isEmpty()
    newline = masked["customers"].limit(1).withColumn("ssn", F.lit("***-**-1234\n"))
    assert audit.mask_audit({**masked, "customers": newline}).where("entity = 'customers'").first()["unmasked"] == 1
