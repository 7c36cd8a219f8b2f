"""One query per operator, each over the whole driver tables (or inputs derived from them)."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilframe.functions import masks as M
from veilframe.functions import text as X
from veilframe.functions.canonical import canonical_json_exact
from veilframe.operators import audit, bus, generate, loads, reads, reconcile, traces, value_leaks
from veilframe.operators.ordered import allocate_ids, kth_occurrence
from veilframe.plans import full_run as runs
from veilframe.plans import retention, sync
from veilframe.registry import ENTITY_ORDER, MESSAGE_SCHEMA, entity
from veilframe.session import materialize, scratch_dir
from veilframe.sources import messages as log
from veilframe.sources import recording_writer, snapshots, traces as trace_files
from veilframe.sources.fixtures import bank, bank_tables, driver_table, fixture
from veilframe.sources.position_index import PositionIndex
from veilframe.streaming import cycles, flows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
NOW = datetime(2026, 1, 1)


def portable(df: DataFrame) -> DataFrame:
    """Results with time-zone-free stamps, whatever zone the session runs in."""
    return df.select(
        *[
            F.col(f"`{f.name}`").cast("timestamp_ntz").alias(f.name) if isinstance(f.dataType, T.TimestampType) else F.col(f"`{f.name}`")
            for f in df.schema
        ]
    )


def query(name: str) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = lambda spark, sf: portable(fn(spark, sf))
        return fn

    return register


def written_once(tables: dict[str, DataFrame], *names: str) -> dict[str, DataFrame]:
    """Inputs for queries that read them several times. Transactions are numbered by a window over whole
    rows: they are worked out and written once, not shuffled anew for every use."""
    return {n: materialize(df, f"input-{n}") if n in (names or ("transactions",)) else df for n, df in tables.items()}


def mask_all(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    return {n: M.mask_table(df, n) for n, df in tables.items()}


def masked_tables(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    return mask_all(bank_tables(spark, sf))


def lower_half(df: DataFrame) -> DataFrame:
    """An earlier state of a table: ids up to half the highest."""
    return df.where(F.col("id") <= df.agg(F.floor(F.max("id") / 2)).scalar())


def earlier(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    return {n: lower_half(df) for n, df in tables.items()}


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def digests(tables: dict[str, DataFrame]) -> DataFrame:
    """(entity, id, digest) of every row, to compare whole tables of different shapes at once."""
    def text(f) -> object:
        return F.coalesce(F.col(f.name).cast("string"), F.lit("~"))

    return union(
        [
            portable(df).select(
                F.lit(n).alias("entity"), "id",
                F.md5(F.concat_ws("|", *[text(f) for f in entity(n).fields])).alias("digest"),
            )
            for n, df in tables.items()
        ]
    )


def store_at(spark: SparkSession, purpose: str) -> snapshots.SnapshotStore:
    return snapshots.SnapshotStore(spark, scratch_dir(spark, purpose))


FILE_ROWS = 1 << 20


def as_files(df: DataFrame, purpose: str, files: int = 4, order: str = "id") -> str:
    """Write an input as files by id range, to be streamed file by file: a few, or as many times that as keep them small."""
    path = scratch_dir(df.sparkSession, purpose)
    df.repartitionByRange(files * max(1, -(-df.count() // (files * FILE_ROWS))), order).write.parquet(path)
    return path


def in_turn(df: DataFrame, purpose: str, parts: int = 4, order: str = "id") -> str:
    """Write an input one range after the other, as it would come in, so that the files' order is the events'."""
    path, top = scratch_dir(df.sparkSession, purpose), df.agg(F.max(order)).first()[0] + 1
    for k in range(parts):
        part = df.where((F.col(order) >= top * k // parts) & (F.col(order) < top * (k + 1) // parts))
        part.coalesce(1).write.mode("append").parquet(path)
    return path


# ---------------------------------------------------------------- scans, sources, sinks
def _read_entity(name: str) -> None:
    @query(f"S1_read_entity_{name}")
    def run(spark, sf):
        path = scratch_dir(spark, "entity")
        bank(spark, sf, name).write.parquet(path)
        return snapshots.read_entity(spark, path, name)


for _name in ENTITY_ORDER:
    _read_entity(_name)


@query("S2_query_local")
def _(spark, sf):
    return reads.query_local(M.mask_table(bank(spark, sf, "cards"), "cards"), "cards", 1000)


@query("S3_read_messages")
def _(spark, sf):
    path = scratch_dir(spark, "messages")
    log.append_messages(fixture(spark, sf, "bus_messages"), path)
    return log.read_messages(spark, path)


@query("S4_parse_body")
def _(spark, sf):
    parsed = log.parse_body(fixture(spark, sf, "bus_messages"))
    return parsed.select("id", "entity", "limit", "since_id", "customer_id", "account_id", "ok", "error", "echo", "n_rows")


@query("S4_parse_unsound_body")
def _(spark, sf):
    parsed = log.parse_body(fixture(spark, sf, "request_bodies"))
    return parsed.select("id", "entity", "since_id", "customer_id", "account_id", "ok", "n_rows")


@query("S5_send_message")
def _(spark, sf):
    customers = bank(spark, sf, "customers")
    body = F.to_json(F.struct(F.lit("accounts").alias("entity"), F.lit(500).alias("limit"), F.col("id").alias("customer_id")))
    bodies = customers.select("id", body.alias("body"))
    sent = log.send_messages(
        fixture(spark, sf, "bus_messages"), bodies, "test", "prod", "id", F.lit("2024-03-01 00:00:00")
    )
    return sent


@query("S6_append_masked")
def _(spark, sf):
    masked = M.mask_table(bank(spark, sf, "accounts"), "accounts")
    store = store_at(spark, "append")
    store.replace("accounts", lower_half(masked))
    arrivals = masked.withColumn("arrival", F.col("id"))
    sync.append_masked(arrivals, store, "accounts", "arrival")
    sync.append_masked(arrivals, store, "accounts", "arrival")
    return store.read("accounts")


@query("S7_upsert_masked")
def _(spark, sf):
    raw = bank(spark, sf, "customers")
    top = raw.agg(F.max("id")).scalar()
    # the old copy holds every customer under two ids: one to be replaced, one that stays
    old = raw.unionByName(raw.withColumn("id", F.col("id") + top))
    store = store_at(spark, "upsert")
    store.replace("customers", old)
    store.replace("customers", sync.baseline_snapshot(raw, store.read("customers"), "customers"))
    return store.read("customers")


@query("S8_read_trace")
def _(spark, sf):
    parsed = trace_files.parse_trace(fixture(spark, sf, "trace_lines"))
    return parsed.select("seq", "agent", "seen_at", "type", "tool_name", "is_error", "error", "role", "model", "args")


def _facts(spark, sf) -> DataFrame:
    """What is known of each recorded run."""
    ids = driver_table(spark, sf, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"))
    return ids.select(
        F.concat(F.lit("rec-"), F.lpad(F.col("conv_id").cast("string"), 9, "0")).alias("rec_id"),
        F.concat(F.lit("2024-01-"), F.lpad((F.col("conv_id") % 28 + 1).cast("string"), 2, "0")).alias("started_at"),
        F.concat(F.lit('{"seed":'), F.col("turns").cast("string"), F.lit("}")).alias("params"),
        F.lit("emulated").alias("model"),
        F.when(F.col("conv_id") % 7 == 0, "fail").otherwise("pass").alias("verdict"),
        F.concat(F.col("turns").cast("string"), F.lit(" turns")).alias("summary"),
    )


def _headers(spark, sf) -> DataFrame:
    return traces.recording_headers(fixture(spark, sf, "recording_events"), _facts(spark, sf))


@query("S9_recordings")
def _(spark, sf):
    root = scratch_dir(spark, "recordings")
    trace_files.write_recordings(_headers(spark, sf), fixture(spark, sf, "recording_events"), root)
    _, events = trace_files.read_recordings(spark, root)
    return events


@query("S9_recording_headers_file")
def _(spark, sf):
    root = scratch_dir(spark, "recordings")
    trace_files.write_recordings(_headers(spark, sf), fixture(spark, sf, "recording_events"), root)
    headers, _events = trace_files.read_recordings(spark, root)
    return headers


@query("S9_recording_documents")
def _(spark, sf):
    root = scratch_dir(spark, "documents")
    recording_writer.write_recording_documents(_headers(spark, sf), fixture(spark, sf, "recording_events"), root)
    headers, events = trace_files.read_recording_documents(spark, root)
    return events.join(headers, "rec_id")


def _new_ids(spark, sf) -> DataFrame:
    """Ids of customers to be generated: one per driver customer."""
    return driver_table(spark, sf, "customer").select((F.col("c_custkey") + 1).alias("id"))


@query("S10_reset_dataset")
def _(spark, sf):
    raw, masked = store_at(spark, "raw"), store_at(spark, "masked")
    masked.replace("cards", M.mask_table(bank(spark, sf, "cards"), "cards"))
    path = scratch_dir(spark, "log")
    log.append_messages(fixture(spark, sf, "bus_messages"), path)
    runs.reset_dataset(raw, masked, path, _new_ids(spark, sf), NOW)
    counts = audit.count_diff(raw.read_all(), masked.read_all()).drop("detail")
    return counts.withColumn("log_rows", log.read_messages(spark, path).agg(F.count(F.lit(1))).scalar())


# ---------------------------------------------------------------- projections and filters
@query("P1_scope_filter")
def _(spark, sf):
    return reads.scope_filter(bank(spark, sf, "accounts"), "accounts", {"customer_id": 7, "account_id": 3})


@query("P2_since_filter")
def _(spark, sf):
    return reads.since_filter(bank(spark, sf, "addresses"), 100)


@query("P3_clamp_limit")
def _(spark, sf):
    events = driver_table(spark, sf, "events")
    asked = F.when(F.col("event_id") % 10 != 0, F.col("event_id") % 900 - 50)
    return events.select("event_id", reads.clamp_limit(asked).alias("limit"))


@query("P4_clean_request")
def _(spark, sf):
    cleaned = reads.clean_request(fixture(spark, sf, "request_bodies"))
    return cleaned.select("id", "entity", "limit", "customer_id", "account_id", "since_id", "error", "request")


P5_PARAMS = {
    "customers": {"limit": 500, "since_id": 20},
    "addresses": {"limit": 500, "customer_id": 4},
    "accounts": {"limit": 500, "customer_id": 8, "since_id": 10},
    "cards": {"limit": 600, "since_id": 500},
    "transactions": {"account_id": 33},
}


def _query_masked(name: str) -> None:
    @query(f"P5_query_masked_{name}")
    def run(spark, sf):
        return reads.query_masked(bank(spark, sf, name), name, **P5_PARAMS[name])

    @query(f"P6_mask_{name}")
    def whole(spark, sf):
        return M.mask_table(bank(spark, sf, name), name)


for _name in ENTITY_ORDER:
    _query_masked(_name)


@query("P7_pending")
def _(spark, sf):
    return reads.pending_counts(fixture(spark, sf, "bus_messages"))


@query("P8_trace_filter")
def _(spark, sf):
    return traces.trace_filter(_trace(spark, sf)).select("seq", "agent", "type")


@query("P9_scrub_log_lines")
def _(spark, sf):
    docs = driver_table(spark, sf, "documents")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    sample = F.when(F.col("doc_id") % 5 == 0, F.lit("Sample customer ")).when(F.col("doc_id") % 7 == 0, F.lit("ssn=")).otherwise(F.lit(""))
    lines = lines.withColumn("line", F.when(F.col("line_no") == 0, F.concat(sample, "line")).otherwise(F.col("line")))
    kept = reads.scrub_log_lines(lines)
    return kept.groupBy("doc_id").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.length("line")).alias("chars"))


@query("P10_masked_only_views")
def _(spark, sf):
    M.masked_only_views(bank_tables(spark, sf), prefix="safe_")
    return spark.sql(
        "SELECT a.status, count(*) AS n, count(DISTINCT c.ssn) AS ssns, max(a.account_number) AS top_account "
        "FROM safe_customers c JOIN safe_accounts a ON a.customer_id = c.id GROUP BY a.status"
    )


# ---------------------------------------------------------------- masks one by one
MASK_CASES = {
    "M1_digits": ("customers", "phone", M.digits),
    "M2_tail": ("accounts", "account_number", lambda c: M.tail(c, 4)),
    "M3_mask_surname": ("customers", "last_name", M.mask_surname),
    "M4_mask_email": ("customers", "email", M.mask_email),
    "M5_mask_phone": ("customers", "phone", M.mask_phone),
    "M6_mask_ssn": ("customers", "ssn", M.mask_ssn),
    "M7_year_only": ("customers", "date_of_birth", M.year_only),
    "M8_redact_line": ("addresses", "line1", M.redact_line),
    "M9_presence_mask": ("addresses", "line2", M.presence_mask),
    "M10_mask_postal": ("addresses", "postal_code", M.mask_postal),
    "M11_mask_account_no": ("accounts", "account_number", M.mask_account_no),
    "M12_mask_card": ("cards", "card_number", M.mask_card),
    "M13_mask_holder": ("cards", "cardholder_name", M.mask_holder),
    "M14_constant_mask": ("cards", "cvv", M.constant_mask),
    "M15_pass_through": ("transactions", "description", M.pass_through),
}


def _mask_case(key: str) -> None:
    name, column, mask = MASK_CASES[key]

    @query(key)
    def run(spark, sf):
        return bank(spark, sf, name).select("id", mask(F.col(column)).alias("masked"))


for _key in MASK_CASES:
    _mask_case(_key)


@query("U1_register_sql_masks")
def _(spark, sf):
    M.register_sql_masks(spark)
    bank(spark, sf, "customers").createOrReplaceTempView("u1_customers")
    return spark.sql(
        "SELECT id, mask_surname(last_name) AS last_name, mask_email(email) AS email, mask_phone(phone) AS phone, "
        "mask_ssn(ssn) AS ssn, mask_year_only(CAST(date_of_birth AS STRING)) AS date_of_birth FROM u1_customers"
    )


# ---------------------------------------------------------------- joins
@query("J1_customer_account_card")
def _(spark, sf):
    return sync.customer_account_card(bank_tables(spark, sf))


@query("J1_customer_account_card_masked")
def _(spark, sf):
    return sync.customer_account_card(masked_tables(spark, sf))


def _slice(name: str) -> None:
    @query(f"J2_slice_{name}")
    def run(spark, sf):
        return sync.slice_copy(bank_tables(spark, sf), 50)[name]


for _name in ENTITY_ORDER:
    _slice(_name)


@query("J3_missing_ids")
def _(spark, sf):
    raw = written_once({"transactions": bank(spark, sf, "transactions")})["transactions"]
    held = raw.where(F.col("account_id") % 10 != 0)
    return loads.missing_ids(raw, held)


@query("J3_missing_by_digests")
def _(spark, sf):
    raw = written_once({"transactions": bank(spark, sf, "transactions")})["transactions"]
    return reconcile.missing(raw, raw.where(F.col("account_id") % 10 != 0))


@query("J4_insert_if_absent")
def _(spark, sf):
    accounts = M.mask_table(bank(spark, sf, "accounts"), "accounts")
    first = accounts.withColumn("arrival", F.col("id") * 2)
    again = accounts.withColumns({"arrival": F.col("id") * 2 - 1, "status": F.lit("closed")}).where(F.col("customer_id") % 2 == 0)
    return loads.insert_if_absent(first.unionByName(again), lower_half(accounts), "accounts", "arrival")


@query("J5_fk_violations")
def _(spark, sf):
    return loads.fk_violations(
        bank(spark, sf, "transactions"), lower_half(bank(spark, sf, "accounts")), "transactions"
    ).select("id", "account_id", "reason")


@query("J6_constraint_report_accounts")
def _(spark, sf):
    return loads.constraint_report(fixture(spark, sf, "dirty_accounts"), "accounts").select("arrival", "reason")


@query("J6_constraint_report_cards")
def _(spark, sf):
    return loads.constraint_report(fixture(spark, sf, "dirty_cards"), "cards").select("arrival", "expiry_month", "reason")


@query("J6_classified_load")
def _(spark, sf):
    return _dirty_load(spark, sf).select("arrival", "outcome", "reason")


def _dirty_load(spark, sf) -> DataFrame:
    return loads.classify_load(
        fixture(spark, sf, "dirty_accounts"), lower_half(bank(spark, sf, "accounts")), "accounts", "arrival",
        bank(spark, sf, "customers"),
    )


@query("J7_cascade_delete")
def _(spark, sf):
    tables = bank_tables(spark, sf)
    gone = tables["customers"].where(F.col("email") == "nodomain")
    return audit.entity_counts(loads.cascade_delete(tables, "customers", gone))


@query("J8_pair_requests")
def _(spark, sf):
    return bus.pair_requests(fixture(spark, sf, "bus_messages"))


@query("J9_bus_changes")
def _(spark, sf):
    current = fixture(spark, sf, "bus_messages")
    previous = lower_half(current).withColumn("consumed_at", F.when(F.col("id") % 5 != 0, F.col("consumed_at")))
    return bus.bus_changes(previous, current)


def _answers(spark, sf, name: str) -> DataFrame:
    requests = reads.pending(fixture(spark, sf, name).withColumn("consumed_at", F.lit(None).cast("timestamp")), "prod")
    tables = bank_tables(spark, sf)
    answers = bus.answer_requests(requests, tables)
    return answers.select("request_id", "ok", "entity", "n_rows", "first_id", "last_id", F.md5("body").alias("body_md5"))


@query("J9_stream_changes")
def _(spark, sf):
    """The log as it was, then after a restart as it is, with marks for what has been read meanwhile."""
    current = fixture(spark, sf, "bus_messages")
    path, marks, out, checkpoint = (scratch_dir(spark, n) for n in ("log", "marks", "changes", "j9"))
    before = lower_half(current)
    late = F.col("id") % 5 == 0
    spark.createDataFrame([], log.MARK_SCHEMA).write.parquet(marks)
    for part, read in (
        (before.withColumn("consumed_at", F.when(~late, F.col("consumed_at"))), None),
        (current.join(before.select("id"), "id", "left_anti"), before.where(late & F.col("consumed_at").isNotNull())),
    ):
        log.append_messages(part, path)
        if read is not None:
            read.select("id", "consumed_at").write.mode("append").parquet(marks)
        flows.stream_changes(spark, path, marks, out, checkpoint, None).awaitTermination()
    return spark.read.parquet(out).select("change", "id", "consumed_at")


@query("J10_answer_requests")
def _(spark, sf):
    return _answers(spark, sf, "bus_messages")


@query("J10_answer_scoped_requests")
def _(spark, sf):
    return _answers(spark, sf, "request_bodies")


@query("J11_load_replies")
def _(spark, sf):
    messages = fixture(spark, sf, "bus_messages").where(F.col("sender") == "prod")
    decided = bus.load_replies(messages, earlier(mask_all(written_once(bank_tables(spark, sf)))))
    return union([d.select(F.lit(n).alias("entity"), "reply_id", "id", "outcome", "reason") for n, d in decided.items()])


@query("J11_load_mixed_replies")
def _(spark, sf):
    """Replies of which rows are new, there already, or without a parent: some customers never come."""
    lost = F.col("id") % 37 == 0
    raw = written_once(bank_tables(spark, sf))
    there = earlier(mask_all(raw))
    there["customers"] = there["customers"].where(~lost)
    raw["customers"] = raw["customers"].where(~lost)
    decided = bus.load_replies(_replies_of(raw), there)
    return union([df.select(F.lit(n).alias("entity"), "id", "outcome", "reason") for n, df in decided.items()])


@query("J11_reply_outcomes")
def _(spark, sf):
    return bus.reply_outcomes(fixture(spark, sf, "bus_messages").where(F.col("sender") == "prod"))


# ---------------------------------------------------------------- aggregations
@query("A1_row_counts")
def _(spark, sf):
    return audit.row_counts(bank_tables(spark, sf))


@query("A2_watermark")
def _(spark, sf):
    return union([audit.watermark(df).select(F.lit(n).alias("entity"), "watermark") for n, df in bank_tables(spark, sf).items()])


@query("A3_bus_stats")
def _(spark, sf):
    return audit.bus_stats(fixture(spark, sf, "bus_messages"))


@query("A4_leak_count")
def _(spark, sf):
    return audit.leak_count(fixture(spark, sf, "bus_messages"))


@query("A5_count_diff")
def _(spark, sf):
    raw = written_once(bank_tables(spark, sf))
    return audit.count_diff(raw, earlier(raw))


@query("A5_differences")
def _(spark, sf):
    """A copy that lacks rows, has rows of its own and holds others with another status."""
    cards = M.mask_table(bank(spark, sf, "cards"), "cards")
    top = cards.agg(F.max("id")).scalar()
    own = cards.where(F.col("id") % 89 == 1).withColumn("id", F.col("id") + top)
    changed = F.when(F.col("id") % 83 == 0, "closed").otherwise(F.col("status"))
    copy = cards.where(F.col("id") % 97 != 0).withColumn("status", changed).unionByName(own)
    return reconcile.differences(cards, copy, entity("cards").columns)


@query("A5_reconcile")
def _(spark, sf):
    masked = mask_all(written_once(bank_tables(spark, sf)))
    return reconcile.reconcile(masked, earlier(masked))


@query("A4_leaks_by_value")
def _(spark, sf):
    """Messages with masked values, and with raw ones that are spaced, dashed or bare."""
    raw = bank_tables(spark, sf)
    card = F.col("card_number")
    spaced = F.concat(F.left(card, F.lit(4)), F.lit(" "), F.substring(card, 5, 4), F.lit("-"), F.substring(card, 9, 8))
    card = F.when(F.col("id") % 3 == 0, spaced).when(F.col("id") % 3 == 1, card).otherwise("4000 **** **** 1234")
    ssn = F.when(F.col("id") % 2 == 0, F.replace("ssn", F.lit("-"), F.lit(""))).otherwise(F.concat(F.lit("***-**-"), F.right("ssn", F.lit(4))))
    number = F.when(F.col("id") % 5 == 0, F.concat("account_number", F.lit(" "), "routing_number")).otherwise(F.concat(F.lit("****"), F.right("account_number", F.lit(4))))
    bodies = union([
        raw["cards"].select((F.col("id") * 4).alias("id"), F.concat(F.lit('{"note":"card '), card, F.lit(', since 2024-01-01"}')).alias("body")),
        raw["customers"].select((F.col("id") * 4 + 1).alias("id"), F.concat(F.lit("ssn "), ssn, F.lit(".")).alias("body")),
        raw["accounts"].select((F.col("id") * 4 + 2).alias("id"), F.concat(F.lit("from "), number, F.lit(" to 12")).alias("body")),
    ])
    return value_leaks.leaks_by_value(bodies, raw)


@query("A6_mask_audit")
def _(spark, sf):
    return audit.mask_audit(masked_tables(spark, sf))


@query("A6_mask_audit_raw")
def _(spark, sf):
    return audit.mask_audit(bank_tables(spark, sf))


@query("A6_mask_audit_full")
def _(spark, sf):
    return audit.mask_audit_full(masked_tables(spark, sf))


@query("A7_verify_transfer")
def _(spark, sf):
    raw = bank_tables(spark, sf)
    return audit.verify_transfer(fixture(spark, sf, "bus_messages"), raw, masked_tables(spark, sf))


@query("A7_verdict")
def _(spark, sf):
    raw = bank_tables(spark, sf)
    return audit.verdict(audit.verify_transfer(fixture(spark, sf, "bus_messages"), raw, raw)).select("verdict", "n_checks")


@query("A8_load_summary")
def _(spark, sf):
    return loads.load_summary(_dirty_load(spark, sf).withColumn("entity", F.lit("accounts")), "entity")


@query("A8_load_summary_per_reply")
def _(spark, sf):
    messages = fixture(spark, sf, "bus_messages").where(F.col("sender") == "prod")
    decided = bus.load_replies(messages, earlier(mask_all(written_once(bank_tables(spark, sf)))))
    return bus.summarize_loads(decided, "reply_id").drop("reason")


@query("A9_seed_summary")
def _(spark, sf):
    return audit.seed_summary(bank_tables(spark, sf))


def _trace(spark, sf) -> DataFrame:
    return trace_files.parse_trace(fixture(spark, sf, "trace_lines"))


@query("A10_agent_summary")
def _(spark, sf):
    return traces.agent_summary(_trace(spark, sf), fixture(spark, sf, "bus_messages"))


@query("A11_recording_header")
def _(spark, sf):
    return _headers(spark, sf)


# ---------------------------------------------------------------- windows
@query("W1_top_n_per_parent")
def _(spark, sf):
    return sync.top_n_per_parent(bank(spark, sf, "transactions"), "account_id", 3)


@query("W2_page_plan")
def _(spark, sf):
    return sync.page_plan(bank(spark, sf, "transactions"), "transactions", max_pages=None)


@query("W2_page_plan_customers")
def _(spark, sf):
    return sync.page_plan(bank(spark, sf, "customers"), "customers")


@query("W3_next_unread")
def _(spark, sf):
    return reads.next_unread(fixture(spark, sf, "bus_messages"))


@query("W4_kth_occurrence")
def _(spark, sf):
    events = driver_table(spark, sf, "events").select(F.col("event_id").alias("id"), "event_type")
    return kth_occurrence(events, ["event_type"], "id")


@query("W5_trace_cycles")
def _(spark, sf):
    return traces.trace_cycles(_trace(spark, sf))


@query("W6_model_changes")
def _(spark, sf):
    return traces.model_changes(_trace(spark, sf))


# ---------------------------------------------------------------- sort, limit, top-k
@query("L1_first_n_by_id")
def _(spark, sf):
    return reads.first_n_by_id(bank(spark, sf, "transactions"), 30)


@query("L2_history")
def _(spark, sf):
    return reads.history(fixture(spark, sf, "bus_messages"))


@query("L3_keep_last")
def _(spark, sf):
    return reads.keep_last(_trace(spark, sf).select("seq", "agent", "type"), reads.TRACE_KEEP, "seq")


@query("L4_retain_recordings")
def _(spark, sf):
    return reads.retain_recordings(_facts(spark, sf)).select("rec_id", "kept")


@query("L3_compacted_log")
def _(spark, sf):
    """A log of which the newest messages are kept while a stream follows it."""
    path, marks, out, checkpoint = (scratch_dir(spark, n) for n in ("log", "marks", "changes", "l3"))
    spark.createDataFrame([], log.MARK_SCHEMA).write.parquet(marks)
    messages = fixture(spark, sf, "bus_messages")
    before = lower_half(messages)
    for part in (before, messages.join(before.select("id"), "id", "left_anti")):
        log.append_messages(part, path)
        flows.stream_changes(spark, path, marks, out, checkpoint, None).awaitTermination()
        passed = spark.read.parquet(out).where("change = 'message'").agg(F.max("id")).first()[0]
        retention.compact_log(spark, path, passed, retention.last_rows(reads.HISTORY_KEEP))
    return log.read_messages(spark, path)


@query("L4_retained_documents")
def _(spark, sf):
    root = scratch_dir(spark, "documents")
    recording_writer.write_recording_documents(_headers(spark, sf), fixture(spark, sf, "recording_events"), root)
    retention.retain_documents(spark, root)
    return trace_files.read_recording_documents(spark, root)[0]


@query("L5_list_recordings")
def _(spark, sf):
    return reads.list_recordings(_headers(spark, sf))


# ---------------------------------------------------------------- scalar functions
@query("F1_canonical_json")
def _(spark, sf):
    messages = fixture(spark, sf, "bus_messages").where(F.col("sender") == "test")
    doc = F.concat(F.lit('{"z":[3,{"b":1,"a":'), F.col("id").cast("string"), F.lit("}],\"m\":"), "body", F.lit("}"))
    return messages.select("id", X.canonical_json(doc).alias("canonical"))


@query("F1_canonical_json_exact")
def _(spark, sf):
    """Requests in documents with keys beyond the basic plane, fractions, a negative zero and long numbers."""
    messages = fixture(spark, sf, "bus_messages").where(F.col("sender") == "test")
    number = F.col("id").cast("string")
    doc = F.concat(
        F.lit('{"\ufffd":1e21,"\U0001f600":'), number, F.lit('.50,"z":-0.0,"big":12345678901234567890,"m":'), "body", F.lit(',"id":'), number, F.lit("}")
    )
    return messages.select("id", canonical_json_exact(doc).alias("canonical"))


@query("F2_json_rows_len")
def _(spark, sf):
    return fixture(spark, sf, "bus_messages").select("id", X.json_rows_len(F.col("body")).alias("n_rows"))


@query("F3_has_raw_identifier")
def _(spark, sf):
    return fixture(spark, sf, "bus_messages").select("id", X.has_raw_identifier(F.col("body")).alias("leak"))


def _leak_scan(table: str, keys: list[str], column: str) -> None:
    @query(f"leak_scan_{table}")
    def run(spark, sf):
        return driver_table(spark, sf, table).where(X.has_raw_identifier(F.col(column))).select(*keys)


_leak_scan("documents", ["doc_id"], "text")
_leak_scan("pages", ["page_id"], "html")
_leak_scan("conversations", ["conv_id", "turn"], "text")


@query("F4_redact_url_credentials")
def _(spark, sf):
    url = F.when(F.col("page_id") % 2 == 0, F.regexp_replace("url", "//", "//user:p@ss@")).otherwise(F.col("url"))
    return driver_table(spark, sf, "pages").select("page_id", X.redact_url_credentials(url).alias("url"))


@query("F5_format_ms")
def _(spark, sf):
    ms = (F.col("event_id") * 37 % 200000).cast("bigint")
    return driver_table(spark, sf, "events").select("event_id", X.format_ms(ms).alias("text"))


@query("F6_clip")
def _(spark, sf):
    return driver_table(spark, sf, "documents").select("doc_id", X.clip(F.col("text"), 600).alias("clipped"))


@query("F7_summarize_tool_result")
def _(spark, sf):
    ends = _trace(spark, sf).where(F.col("type") == "tool_execution_end")
    return ends.select("seq", X.summarize_tool_result(F.col("result")).alias("summary"))


@query("F8_message_parts")
def _(spark, sf):
    ends = _trace(spark, sf).where(F.col("type") == "message_end")
    return ends.select(
        "seq",
        F.array_join(X.message_parts(F.col("message"), "thinking"), "|").alias("thinking"),
        F.array_join(X.message_parts(F.col("message"), "text"), "|").alias("text"),
    )


@query("F9_luhn_check_digit")
def _(spark, sf):
    whole = bank(spark, sf, "cards").where(F.length("card_number") == 16)
    return whole.select("id", X.luhn_check_digit(F.left("card_number", F.lit(15))).cast("bigint").alias("digit"))


@query("F10_replay_offset")
def _(spark, sf):
    events = fixture(spark, sf, "recording_events")
    return events.select("rec_id", "t_ms", *[X.replay_offset(F.col("t_ms"), s).alias(f"at_{s}x") for s in X.REPLAY_SPEEDS])


@query("F11_run_summary_text")
def _(spark, sf):
    facts = _headers(spark, sf)
    return facts.select(
        "rec_id",
        X.run_summary_text(
            F.col("verdict"), F.col("event_count"), F.col("duration_ms") * 20, F.col("summary"), F.col("rec_id").endswith("5")
        ).alias("text"),
    )


@query("F12_scope_text")
def _(spark, sf):
    sound = reads.clean_request(fixture(spark, sf, "request_bodies")).where(F.col("error").isNull())
    return sound.select("id", X.scope_text(F.col("request")).alias("scope"))


# ---------------------------------------------------------------- copies and generation
@query("C1_sync_baseline")
def _(spark, sf):
    raw, store = written_once(bank_tables(spark, sf)), store_at(spark, "baseline")
    sync.sync_baseline(raw, store)
    sync.sync_baseline(raw, store)
    return digests(store.read_all())


def _half_synced(spark, raw: dict[str, DataFrame]) -> snapshots.SnapshotStore:
    store = store_at(spark, "delta")
    for name, df in mask_all(raw).items():
        store.replace(name, lower_half(df))
    return store


@query("C2_delta_summary")
def _(spark, sf):
    raw = written_once(bank_tables(spark, sf))
    return sync.delta_summary(raw, earlier(raw))


@query("C2_sync_delta")
def _(spark, sf):
    raw = written_once(bank_tables(spark, sf))
    store = _half_synced(spark, raw)
    sync.sync_delta(raw, store)
    sync.sync_delta(raw, store)
    return digests(store.read_all())


@query("C3_copy_paged")
def _(spark, sf):
    raw = {n: materialize(df, f"raw-{n}", "zstd") for n, df in bank_tables(spark, sf).items()}
    return sync.copy_paged(raw, store_at(spark, "paged"), max_pages=None)


@query("C4_full_run")
def _(spark, sf):
    """What was copied of each entity, and whether each check of the transfer holds."""
    raw, masked, path = bank_tables(spark, sf), store_at(spark, "run"), scratch_dir(spark, "log")
    stored = {n: materialize(df, f"raw-{n}", "zstd") for n, df in raw.items()}
    copied = sync.copy_paged(stored, masked, max_pages=None, log=path)
    checks = audit.verify_transfer(log.read_messages(spark, path), stored, masked.read_all())
    none = F.lit(None).cast("bigint")
    return copied.select(F.lit("copy").alias("part"), F.col("entity").alias("name"), "received", "inserted", "skipped", F.lit(None).cast("boolean").alias("ok")).unionByName(
        checks.select(F.lit("check").alias("part"), "name", none.alias("received"), none.alias("inserted"), none.alias("skipped"), "ok")
    )


def _generated(name: str) -> None:
    @query(f"G1_generate_{name}")
    def run(spark, sf):
        return generate.generate_bank(_new_ids(spark, sf), NOW)[name]


for _name in ENTITY_ORDER:
    _generated(_name)


@query("G2_allocate_ids")
def _(spark, sf):
    cards = bank(spark, sf, "cards").withColumn("place", F.col("id"))
    return allocate_ids(cards, bank(spark, sf, "transactions"), "place").select("id", "account_id", "place")


# ---------------------------------------------------------------- streams, run until the input is used up
def _stream(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Half of the files in each batch, two at least."""
    files = len(spark.read.schema(schema).parquet(path).inputFiles())
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max(2, -(-files // 2))).parquet(path)


def _stream_at_once(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All files in one batch: these were written side by side, so their order is no event order."""
    return spark.readStream.schema(schema).parquet(path)


@query("T1_stream_masked_copy")
def _(spark, sf):
    store = store_at(spark, "streamed")
    store.reset()
    for name, raw in bank_tables(spark, sf).items():
        source = _stream(spark, as_files(raw, name), entity(name).schema)
        flows.stream_masked_copy(source, name, store, scratch_dir(spark, "t1"), None).awaitTermination()
    return digests(store.read_all())


@query("T2_stream_answer")
def _(spark, sf):
    tables = {n: materialize(df, n) for n, df in bank_tables(spark, sf).items()}
    path = as_files(fixture(spark, sf, "request_bodies"), "requests")
    replies = scratch_dir(spark, "replies")
    source = _stream(spark, path, MESSAGE_SCHEMA)
    index = PositionIndex(spark, scratch_dir(spark, "positions"))
    flows.stream_answer(source, tables, replies, scratch_dir(spark, "t2"), None, index=index).awaitTermination()
    written = log.read_messages(spark, replies)
    return written.select((F.col("id") - bus.REPLY_ID_BASE).alias("request_id"), F.md5("body").alias("body_md5"))


def _replies(spark, sf) -> DataFrame:
    return _replies_of(bank_tables(spark, sf))


def _replies_of(tables: dict[str, DataFrame]) -> DataFrame:
    """Replies that bring up to twenty rows of an entity each."""
    parts = []
    for i, name in enumerate(ENTITY_ORDER):
        docs = bus.row_documents(tables[name], name)
        pages = docs.groupBy(F.floor(F.col("id") / 20).alias("page")).agg(F.array_sort(F.collect_list(F.struct("id", "doc"))).alias("rows"))
        body = F.concat(F.lit(f'{{"ok":true,"entity":"{name}","rows":['), F.array_join("rows.doc", ","), F.lit("]}"))
        parts.append(pages.select((F.col("page") * 5 + i).alias("id"), body.alias("body")))
    return union(parts).select(
        "id", F.lit("prod").alias("sender"), F.lit("test").alias("recipient"), "body",
        F.lit("2024-03-01 00:00:00").cast("timestamp").alias("created_at"), F.lit(None).cast("timestamp").alias("consumed_at"),
    )


@query("T3_stream_load")
def _(spark, sf):
    store = store_at(spark, "loaded")
    store.reset()
    # a child that comes before its parent is skipped, so the replies arrive in one batch
    path = scratch_dir(spark, "replies")
    _replies(spark, sf).write.parquet(path)
    source = _stream_at_once(spark, path, MESSAGE_SCHEMA)
    flows.stream_load(source, store, scratch_dir(spark, "t3"), None).awaitTermination()
    return digests(store.read_all())


@query("T4_stream_pairing")
def _(spark, sf):
    messages = fixture(spark, sf, "bus_messages")
    path, out = in_turn(messages, "messages"), scratch_dir(spark, "pairs")
    flows.stream_pairing(_stream(spark, path, MESSAGE_SCHEMA), out, scratch_dir(spark, "t4"), interval=None).awaitTermination()
    emitted = spark.read.schema("request_id BIGINT, reply_id BIGINT").parquet(out)
    return flows.close_pairing(emitted, messages)


@query("T5_stream_leak_monitor")
def _(spark, sf):
    path = as_files(fixture(spark, sf, "bus_messages"), "messages")
    out = scratch_dir(spark, "monitor")
    flows.stream_leak_monitor(_stream(spark, path, MESSAGE_SCHEMA), out, scratch_dir(spark, "t5"), None).awaitTermination()
    return flows.latest(spark, out)


@query("T6_stream_counts")
def _(spark, sf):
    raw = bank_tables(spark, sf)
    path, out = as_files(fixture(spark, sf, "bus_messages"), "messages"), scratch_dir(spark, "counts")
    flows.stream_counts(_stream(spark, path, MESSAGE_SCHEMA), lambda: raw, out, scratch_dir(spark, "t6"), None).awaitTermination()
    return spark.read.parquet(out).select("batch", *ENTITY_ORDER)


@query("T7_stream_trace")
def _(spark, sf):
    lines = fixture(spark, sf, "trace_lines")
    path = as_files(lines, "traces", order="seq")
    out = scratch_dir(spark, "trace-stats")
    flows.stream_trace(_stream(spark, path, lines.schema), out, scratch_dir(spark, "t7"), None).awaitTermination()
    return flows.latest(spark, out)


def _streamed_cycles(spark, sf) -> tuple[str, str]:
    lines = fixture(spark, sf, "trace_lines")
    path = in_turn(lines, "traces", order="seq")
    state, out = scratch_dir(spark, "cycles-open"), scratch_dir(spark, "cycles")
    flows.stream_cycles(_stream(spark, path, lines.schema), state, out, scratch_dir(spark, "t7"), None).awaitTermination()
    return state, out


@query("T7_stream_cycles")
def _(spark, sf):
    return cycles.all_cycles(spark, *_streamed_cycles(spark, sf))


@query("T7_stream_model_changes")
def _(spark, sf):
    return cycles.all_model_changes(spark, _streamed_cycles(spark, sf)[1])
