"""Baseline and delta copies, slices and paging."""

from __future__ import annotations

import warnings
from collections.abc import Mapping
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilframe.functions.masks import mask_table
from veilframe.operators.bus import (
    answer_requests, load_replies, reply_messages, summarize_loads,
)
from veilframe.operators.audit import watermark
from veilframe.operators.loads import accepted, insert_if_absent, upsert
from veilframe.operators.ordered import positions
from veilframe.registry import ENTITY_ORDER, entity as lookup
from veilframe.session import materialize, passing_scratch, scratch_dir
from veilframe.sources.messages import append_messages, read_messages
from veilframe.sources.snapshots import SnapshotStore

# Rows per page of a paged copy.
PAGE_ROWS = {"customers": 500, "addresses": 500, "accounts": 500, "cards": 500, "transactions": 30}
MAX_PER_PARENT = 500
SALTS = 16


def top_n_per_parent(df: DataFrame, key: str, n: int = MAX_PER_PARENT) -> DataFrame:
    """The first n rows of each parent by id.

    A parent is first cut to n rows within each of sixteen slices of its ids, so whatever a parent
    holds, the window that decides sees at most 16 * n of its rows.
    """
    slice_of = F.pmod(F.xxhash64("id"), F.lit(SALTS))
    sliced = df.withColumn("_slice", slice_of)
    within = Window.partitionBy(key, "_slice").orderBy("id")
    cut = sliced.withColumn("_rn", F.row_number().over(within)).where(F.col("_rn") <= n)
    overall = Window.partitionBy(key).orderBy("id")
    return (
        cut.withColumn("_rn", F.row_number().over(overall)).where(F.col("_rn") <= n).select(*df.columns)
    )


def slice_copy(raw: Mapping[str, DataFrame], customers: int = 5) -> dict[str, DataFrame]:
    """The first customers and everything under them, masked.

    At most 500 customers, 500 addresses and accounts each, 500 cards and transactions per account:
    both key sets that are broadcast have that bound (500 and 250,000 ids). What children hang on is
    written once, not worked out again for each of them.
    """
    n = min(max(customers, 1), 500)
    out = {"customers": materialize(raw["customers"].orderBy("id").limit(n), "slice-customers")}
    chosen = F.broadcast(out["customers"].select(F.col("id").alias("customer_id")))
    for name in ("addresses", "accounts"):
        out[name] = top_n_per_parent(raw[name].join(chosen, "customer_id", "left_semi"), "customer_id")
    out["accounts"] = materialize(out["accounts"], "slice-accounts")
    held = F.broadcast(out["accounts"].select(F.col("id").alias("account_id")))
    for name in ("cards", "transactions"):
        out[name] = top_n_per_parent(raw[name].join(held, "account_id", "left_semi"), "account_id")
    return {name: mask_table(df.select(*lookup(name).columns), name) for name, df in out.items()}


def customer_account_card(tables: Mapping[str, DataFrame], n: int = 10) -> DataFrame:
    """The boundary check: customers with accounts and, where there are any, cards.

    Ordered by customer id, ties by account and card, so the ten rows are always the same. Every
    customer with an account gives a row and so does every account, so n rows come from the first n
    such customers and the first n of their accounts: only ids are joined in full, and what is
    broadcast has n rows.
    """
    customers, accounts, cards = tables["customers"], tables["accounts"], tables["cards"]
    owners = (
        customers.select(F.col("id").alias("customer_id"))
        .join(accounts.select("customer_id"), "customer_id", "left_semi")
        .orderBy("customer_id").limit(n)
    )
    people = customers.select(F.col("id").alias("customer_id"), "last_name", "ssn", "email")
    held = accounts.select("customer_id", F.col("id").alias("account_id"), "account_number")
    heads = held.join(F.broadcast(owners), "customer_id", "left_semi").orderBy("customer_id", "account_id").limit(n)
    named = heads.join(people.join(F.broadcast(owners), "customer_id", "left_semi"), "customer_id")
    plastic = (
        cards.select("account_id", F.col("id").alias("card_id"), "card_number")
        .join(F.broadcast(heads.select("customer_id", "account_id")), "account_id")
        .orderBy("customer_id", "account_id", "card_id").limit(n)
        .drop("customer_id")
    )
    return (
        named.join(plastic, "account_id", "left")
        .orderBy("customer_id", "account_id", "card_id")
        .limit(n)
        .select(
            F.col("customer_id").alias("id"), "last_name", "ssn", "email", "account_number", "card_number",
            "account_id", "card_id",
        )
    )


def _page_counts(places: DataFrame, size: Column, starts: DataFrame, max_pages: int | None, keys: list[str]) -> DataFrame:
    """The pages of positioned ids: each page's first, last and number of ids, and the id it starts after.

    The last id of a full page is also what the next page starts after, so each such row is counted
    in both and one aggregation yields the whole plan.
    """
    page = F.floor((F.col("position") - 1) / size)
    own = F.struct(page.alias("page"), F.col("id"), F.lit(None).cast("bigint").alias("since_id"))
    following = F.struct(
        (page + 1).alias("page"), F.lit(None).cast("bigint").alias("id"), F.col("id").alias("since_id")
    )
    ends_page = F.col("position") % size == 0
    entries = places.select(
        *keys, F.inline(F.when(ends_page, F.array(own, following)).otherwise(F.array(own)))
    )
    start = starts.select(
        *keys, F.lit(0).cast("bigint").alias("page"), F.lit(None).cast("bigint").alias("id"), "since_id"
    )
    plan = entries.unionByName(start)
    if max_pages is not None:
        plan = plan.where(F.col("page") < max_pages)
    return plan.groupBy(*keys, "page").agg(
        F.max("since_id").alias("since_id"), F.count("id").alias("page_rows"),
        F.min("id").alias("first_id"), F.max("id").alias("last_id"),
    ).withColumn("next_since_id", F.coalesce("last_id", "since_id"))


def page_plan(
    rows: DataFrame, entity: str, batch: int | None = None, since: int = 0, max_pages: int | None = None
) -> DataFrame:
    """The requests a paged copy makes: (page, since_id, page_rows, first_id, last_id, next_since_id).

    Pages are full until the last, which is short and possibly empty: that is how a copy learns it
    is done.
    """
    size = F.lit(batch or PAGE_ROWS[entity])
    places = positions(rows.where(F.col("id") > since).select("id"), "id")
    starts = rows.sparkSession.range(1).select(F.lit(since).cast("bigint").alias("since_id"))
    return _page_counts(places, size, starts, max_pages, [])


def page_plans(
    raw: Mapping[str, DataFrame], since: Mapping[str, int], max_pages: int | None = None
) -> DataFrame:
    """The page plans of several entities in one count: the columns of ``page_plan`` and ``entity``.

    The ids of all entities are positioned together, by entity; an entity of many rows is split by
    its ids as any hot key is.
    """
    names = [name for name in ENTITY_ORDER if name in since]
    ids = reduce(DataFrame.unionByName, [
        raw[name].where(F.col("id") > since[name]).select(F.lit(name).alias("entity"), "id") for name in names
    ])
    size = F.element_at(F.create_map(*[F.lit(x) for name in names for x in (name, PAGE_ROWS[name])]), F.col("entity"))
    spark = ids.sparkSession
    starts = spark.createDataFrame([(name, since[name]) for name in names], "entity STRING, since_id BIGINT")
    return _page_counts(positions(ids, "id", keys=["entity"]), size, starts, max_pages, ["entity"])


def baseline_snapshot(raw: DataFrame, old: DataFrame, entity: str) -> DataFrame:
    """The masked side after a baseline: every raw row masked, inserted or replaced by id."""
    return upsert(old, mask_table(raw.select(*lookup(entity).columns), entity), entity)


def sync_baseline(raw: Mapping[str, DataFrame], store: SnapshotStore) -> dict[str, int]:
    """Make the masked side a full masked mirror, entity by entity. Safe to repeat.

    A first baseline is a pure scan, mask and write: nothing is shuffled.
    """
    versions = {}
    for name in ENTITY_ORDER:
        if store.version(name) == 0:
            new = mask_table(raw[name].select(*lookup(name).columns), name)
        else:
            new = baseline_snapshot(raw[name], store.read(name), name)
        versions[name] = store.replace(name, new)
    return versions


def delta_rows(raw: DataFrame, masked: DataFrame, entity: str) -> DataFrame:
    """Raw rows above the masked side's highest id, masked.

    The watermark is a scalar subquery, so the bound reaches the raw scan and prunes row groups.
    An id above the highest cannot be present, so no join against the masked side is needed.
    """
    mark = masked.agg(F.coalesce(F.max("id"), F.lit(0))).scalar()
    rows = raw.select(*lookup(entity).columns).where(F.col("id") > mark)
    return mask_table(rows, entity)


def delta_summary(raw: Mapping[str, DataFrame], masked: Mapping[str, DataFrame]) -> DataFrame:
    """(entity, watermark, added) of a delta, without writing it."""
    out = None
    for name in ENTITY_ORDER:
        mark = masked[name].agg(F.coalesce(F.max("id"), F.lit(0))).scalar()
        part = raw[name].where(F.col("id") > mark).agg(F.count(F.lit(1)).alias("added")).select(
            F.lit(name).alias("entity"), mark.alias("watermark"), "added"
        )
        out = part if out is None else out.unionByName(part)
    return out


def sync_delta(raw: Mapping[str, DataFrame], store: SnapshotStore) -> None:
    """Append what is new on the raw side, masked, in foreign-key order."""
    for name in ENTITY_ORDER:
        store.append(name, delta_rows(raw[name], store.read(name), name))


def append_masked(rows: DataFrame, store: SnapshotStore, entity: str, order: str) -> None:
    """Sink: insert masked rows that are not there yet; repeating a write adds nothing."""
    store.append(entity, insert_if_absent(rows, store.read(entity), entity, order))


def page_requests(plan: DataFrame, last_ids: Mapping[str, int]) -> DataFrame:
    """The request messages of page plans, an entity's from its even id on. The reply to each takes the next number."""
    def of(values: Mapping[str, int]) -> Column:
        return F.element_at(F.create_map(*[F.lit(x) for name in last_ids for x in (name, values[name])]), F.col("entity"))

    body = F.to_json(F.struct(F.col("entity"), F.col("since_id"), of(PAGE_ROWS).alias("limit")))
    return plan.select(
        (of(last_ids) + F.col("page") * 2 + 1).cast("bigint").alias("id"),
        F.lit("test").alias("sender"), F.lit("prod").alias("recipient"), body.alias("body"),
        F.current_timestamp().alias("created_at"), F.current_timestamp().alias("consumed_at"),
    )


def highest_id(spark: SparkSession, log: str) -> int:
    """The highest id of a message log, made even; 0 where there is no log yet."""
    try:
        top = read_messages(spark, log).agg(F.max("id")).first()[0] or 0
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return 0
    return top + top % 2


def copy_paged(
    raw: Mapping[str, DataFrame],
    store: SnapshotStore,
    max_pages: int | None = None,
    log: str | None = None,
) -> DataFrame:
    """A delta copy through requests and replies: the load summary of each entity.

    All pages of all entities are asked for at once, numbered entity by entity; each starts where the
    one before it ends. Requests and replies are written to the message log (``log``, or the scratch
    folder) before they are loaded, and each entity is in the masked copy before its children come.
    Message ids continue from the log's highest. Under a cap on pages, a warning says which entities
    have more.
    """
    spark = store.spark
    path = log or scratch_dir(spark, "log")
    known = store.read_all()
    marks = reduce(DataFrame.unionByName, [
        watermark(known[name]).select(F.lit(name).alias("entity"), "watermark") for name in ENTITY_ORDER
    ])
    since = {r["entity"]: r["watermark"] for r in marks.collect()}
    with passing_scratch(spark):
        plan = materialize(page_plans(raw, since, max_pages), "page-plan")
        full = F.count_if(F.element_at(F.create_map(*[F.lit(x) for pair in PAGE_ROWS.items() for x in pair]), F.col("entity")) == F.col("page_rows"))
        made = {r["entity"]: r for r in plan.groupBy("entity").agg(F.count(F.lit(1)).alias("pages"), full.alias("full")).collect()}
        first_id = last_id = highest_id(spark, path)
        last_ids = {}
        for name in ENTITY_ORDER:
            last_ids[name] = last_id
            pages = made[name]["pages"] if name in made else 0
            last_id += 2 * pages
            if max_pages is not None and pages >= max_pages and made[name]["full"] == pages:
                warnings.warn(f"{name}: there may be more rows than {max_pages} pages hold", stacklevel=2)
        requests = materialize(page_requests(plan, last_ids), "page-requests")
        answers = answer_requests(requests, raw, kinds=[(name, False) for name in ENTITY_ORDER])
        replies = reply_messages(answers, F.current_timestamp(), base=1).withColumn("consumed_at", F.current_timestamp())
        append_messages(requests.unionByName(replies), path)
    # written once, in the log; ids of this copy are above all that were there
    written = read_messages(spark, path).where((F.col("id") > first_id) & (F.col("id") <= last_id) & (F.col("sender") == "prod"))
    decided = load_replies(written, known)
    for name in ENTITY_ORDER:
        store.append(name, accepted(decided[name], name))
    return summarize_loads(decided)
