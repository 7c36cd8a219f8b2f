"""Time the headline queries and print one JSON line.

    BENCH_SF_DIR  driver tables (default /root/testdata/sf0.1)
    BENCH_CPUS    local cores (default 8)

Inputs are derived from the driver tables and written once, outside the timing, as the entity
datasets and the message log a job would find on shared storage.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.functions.masks import mask_table
from veilframe.functions.text import has_raw_identifier
from veilframe.operators import audit, bus, reconcile, traces, value_leaks
from veilframe.plans import sync
from veilframe.registry import ENTITY_ORDER
from veilframe.session import build_session, materialize, scratch_dir
from veilframe.sources.fixtures import bank_tables, driver_table, fixture
from veilframe.sources.position_index import PositionIndex
from veilframe.sources.snapshots import SnapshotStore
from veilframe.sources.traces import parse_trace
from veilframe.streaming import flows

# Bounds of the two queries that are mostly jobs; they stand in the output.
COPIED_IDS, ANSWERED_IDS = 2_000, 5_000
SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def drain(df: DataFrame) -> None:
    """Compute every row and column without keeping them."""
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = build_session(
        "bench", f"local[{CPUS}]",
        **{
            "spark.sql.shuffle.partitions": CPUS, "spark.ui.enabled": "false",
            "spark.driver.memory": "16g", "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")

    def stored(df: DataFrame, name: str) -> DataFrame:
        return materialize(df.repartition(int(CPUS)), name)

    raw = {n: stored(df, f"raw-{n}") for n, df in bank_tables(spark, SF_DIR).items()}
    masked = {n: mask_table(df, n) for n, df in raw.items()}
    log = stored(fixture(spark, SF_DIR, "bus_messages"), "log")
    trace = stored(parse_trace(fixture(spark, SF_DIR, "trace_lines")), "trace")
    requests = log.where(F.col("recipient") == "prod")
    half = SnapshotStore(spark, scratch_dir(spark, "half"))
    for name in ENTITY_ORDER:
        top = raw[name].agg(F.max("id")).first()[0]
        half.replace(name, masked[name].where(F.col("id") <= top // 2))
    half_tables = half.read_all()

    def baseline() -> None:
        sync.sync_baseline(raw, SnapshotStore(spark, scratch_dir(spark, "baseline")))

    def delta() -> None:
        for name in ENTITY_ORDER:
            drain(sync.delta_rows(raw[name], half_tables[name], name))

    def upsert() -> None:
        for name in ENTITY_ORDER:
            drain(sync.baseline_snapshot(raw[name], half_tables[name], name))

    def slices() -> None:
        for df in sync.slice_copy(raw, 50).values():
            drain(df)

    def answer() -> None:
        drain(bus.answer_requests(requests, raw))

    def leaks() -> None:
        for table, column in (("documents", "text"), ("pages", "html"), ("conversations", "text")):
            drain(driver_table(spark, SF_DIR, table).agg(F.count_if(has_raw_identifier(F.col(column)))))

    def stream_copy() -> None:
        store = SnapshotStore(spark, scratch_dir(spark, "t1-store"))
        store.replace("customers", masked["customers"])
        path = scratch_dir(spark, "t1-source")
        raw["accounts"].write.parquet(path)
        source = spark.readStream.schema(raw["accounts"].schema).parquet(path)
        flows.stream_masked_copy(source, "accounts", store, scratch_dir(spark, "t1"), None).awaitTermination()

    def stream_answer() -> None:
        path = scratch_dir(spark, "t2-source")
        requests.where(F.col("id") <= ANSWERED_IDS).write.parquet(path)
        source = spark.readStream.schema(requests.schema).parquet(path)
        flows.stream_answer(source, lambda: raw, scratch_dir(spark, "t2-replies"), scratch_dir(spark, "t2"), None, index=PositionIndex(spark, scratch_dir(spark, "positions"))).awaitTermination()

    timed = {
        "P6_mask_transactions": lambda: drain(masked["transactions"]),
        "P6_mask_cards": lambda: drain(masked["cards"]),
        "P6_mask_customers": lambda: drain(masked["customers"]),
        "J1_customer_account_card": lambda: drain(sync.customer_account_card(masked)),
        "J2_slice_copy": slices,
        "J8_pair_requests": lambda: drain(bus.pair_requests(log)),
        "J10_answer_requests": answer,
        "A3_bus_stats": lambda: drain(audit.bus_stats(log)),
        "A6_mask_audit": lambda: drain(audit.mask_audit(masked)),
        "A7_verify_transfer": lambda: drain(audit.verify_transfer(log, raw, masked)),
        "C1_sync_baseline": baseline,
        "C1_upsert": upsert,
        "C2_sync_delta": delta,
        "W1_top_n_per_parent": lambda: drain(sync.top_n_per_parent(raw["transactions"], "account_id", 5)),
        "W2_page_plan": lambda: drain(sync.page_plan(raw["transactions"], "transactions", max_pages=None)),
        "W5_trace_cycles": lambda: drain(traces.trace_cycles(trace)),
        "C3_copy_paged": lambda: drain(sync.copy_paged({n: df.where(F.col("id") <= COPIED_IDS) for n, df in raw.items()}, SnapshotStore(spark, scratch_dir(spark, "paged")))),
        "A4_leaks_by_value": lambda: drain(value_leaks.leaks_by_value(log, raw)),
        "A5_reconcile": lambda: drain(reconcile.reconcile(masked, half_tables)),
        "T1_stream_masked_copy": stream_copy,
        "T2_stream_answer": stream_answer,
        "leak_scans": leaks,
    }

    only = set(sys.argv[1:])
    seconds = {}
    for name, run in timed.items():
        if only and name not in only:
            continue
        started = time.perf_counter()
        run()
        seconds[name] = round(time.perf_counter() - started, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    rows = raw["cards"].count() + raw["customers"].count()
    result = {
        "metric": "total_query_seconds",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "bounds": {"C3_copy_paged": f"ids up to {COPIED_IDS}", "T1_stream_masked_copy": "accounts", "T2_stream_answer": f"request ids up to {ANSWERED_IDS}"},
        "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
    }
    # transactions have no masked column; cards and customers show what masks cost
    if "P6_mask_cards" in seconds and "P6_mask_customers" in seconds:
        result["mask_rows_per_sec"] = round(rows / (seconds["P6_mask_cards"] + seconds["P6_mask_customers"]))
    print(json.dumps(result))


if __name__ == "__main__":
    main()
