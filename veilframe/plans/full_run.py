"""The full run: reset, seed, copy, optionally append and sync, verify, verdict."""

from __future__ import annotations

import time
from collections.abc import Callable
from datetime import datetime

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.functions.text import run_summary_text
from veilframe.operators.audit import verdict, verify_transfer, watermark
from veilframe.operators.generate import customer_ids, generate_bank
from veilframe.plans.sync import copy_paged
from veilframe.registry import ENTITY_ORDER, MESSAGE_SCHEMA
from veilframe.sources.messages import read_messages
from veilframe.sources.snapshots import SnapshotStore

STEPS = "step_no INT, name STRING, status STRING, detail STRING"


class RunFailed(Exception):
    """A step of a run did not hold."""


def seed_raw(
    raw: SnapshotStore, customers: int | DataFrame, now: datetime, seed: int = 42, append: bool = False
) -> None:
    """Fill the raw side, or add customers whose ids continue from the highest present.

    ``customers`` is a number, or a frame of ids to take.
    """
    spark = raw.spark
    start = {e: watermark(raw.read(e)).first()[0] if append else 0 for e in ENTITY_ORDER}
    ids = customers if isinstance(customers, DataFrame) else customer_ids(spark, customers, start["customers"])
    for name, rows in generate_bank(ids, now, seed, start).items():
        if append:
            raw.append(name, rows)
        else:
            raw.replace(name, rows)


def reset_dataset(raw: SnapshotStore, masked: SnapshotStore, log: str, customers: int | DataFrame, now: datetime) -> None:
    """Empty the masked side, clear the log and reseed the raw side."""
    masked.reset()
    raw.spark.createDataFrame([], MESSAGE_SCHEMA).write.mode("overwrite").parquet(log)
    seed_raw(raw, customers, now)


def full_run(
    spark: SparkSession,
    root: str,
    customers: int | DataFrame = 5,
    append: int = 0,
    now: datetime = datetime(2026, 1, 1),
    max_pages: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Run every step below ``root``; the first failure ends the run.

    Returns the steps (step_no, name, status, detail) and one summary row (verdict, summary).
    """
    raw, masked, log = SnapshotStore(spark, f"{root}/raw"), SnapshotStore(spark, f"{root}/masked"), f"{root}/log"
    started = time.monotonic()
    state = {"checks": 0}

    def reset() -> str:
        reset_dataset(raw, masked, log, customers, now)
        return "raw side reseeded, masked side empty, log empty"

    def copy(round_no: int) -> str:
        loaded = copy_paged(raw.read_all(), masked, max_pages, log=log)
        rows = loaded.select(F.format_string("%s %d/%d", "entity", "inserted", "received").alias("t")).collect()
        return ", ".join(sorted(r["t"] for r in rows))

    def grow() -> str:
        seed_raw(raw, append, now, append=True)
        return f"{append} customers appended"

    def verify() -> str:
        checks = verify_transfer(read_messages(spark, log), raw.read_all(), masked.read_all())
        result = verdict(checks).first()
        state["checks"] = result["n_checks"]
        if result["verdict"] != "pass":
            raise RunFailed(result["failed"])
        return f"{result['n_checks']} checks hold"

    plan: list[tuple[str, Callable[[], str]]] = [
        ("reset: clear log, empty masked side, seed raw side", reset),
        ("copy: every entity in pages", lambda: copy(0)),
    ]
    if append:
        plan += [
            ("append new customers to the raw side", grow),
            ("incremental sync: only the new rows cross", lambda: copy(1)),
        ]
    plan.append(("verify the transfer", verify))

    steps, failure = [], None
    for number, (name, action) in enumerate(plan):
        if failure is not None:
            steps.append((number, name, "pending", ""))
            continue
        try:
            steps.append((number, name, "done", action()))
        except (RunFailed, PySparkException) as error:
            failure = str(error)
            steps.append((number, name, "failed", failure))

    outcome = spark.createDataFrame(
        [("fail" if failure else "pass", state["checks"], int((time.monotonic() - started) * 1000), failure)],
        "verdict STRING, n_checks INT, duration_ms BIGINT, reason STRING",
    )
    summary = outcome.select(
        "verdict",
        run_summary_text(
            F.col("verdict"), F.col("n_checks"), F.col("duration_ms"), F.col("reason"), F.lit(False)
        ).alias("summary"),
    )
    return spark.createDataFrame(steps, STEPS), summary
