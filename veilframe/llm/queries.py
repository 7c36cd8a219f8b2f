"""The dealt operators over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.llm import chat, decontaminate, exact_dedup, language, lexical, mixing, near_dedup, packing, quality, repair, secrets, sharding, topk
from veilframe.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return register


@query(
    "op1_exact_dedup",
    """
    SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept,
      sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
    """,
)
def op1(spark: SparkSession, sf: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf, "documents"), keep="largest")


@query(
    "op10_chat_formatting",
    r"""
    WITH all_turns AS (
      SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
    ), marked AS (
      SELECT *, regexp_replace(text, '<(\\*)(turn:|/turn>|next/>)', '<\\\1\2', 'g') AS body,
        replace(replace(replace(role, '%', '%25'), '<', '%3C'), '>', '%3E') AS name,
        lag(role) OVER w IS DISTINCT FROM role AS opens, lead(role) OVER w IS DISTINCT FROM role AS closes
      FROM all_turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)
    )
    SELECT conv_id, count(*) AS n_turns,
      sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
      CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
      sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
      CAST(sum(length(body) + CASE WHEN opens THEN 7 + length(name) ELSE 7 END + CASE WHEN closes THEN 7 ELSE 0 END) AS BIGINT) AS formatted_chars
    FROM marked GROUP BY conv_id
    """,
)
def op10(spark: SparkSession, sf: str) -> DataFrame:
    tricky = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", tricky), (-7, 1, "assistant", tricky)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf, "conversations").select("conv_id", F.col("turn").cast("bigint").alias("turn"), "role", "text").unionByName(extra)
    back = chat.read_chats(chat.format_chats(turns))
    line = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return back.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(F.array_join(line, ""), 256).alias("turns_sha256"),
        F.length("loss_text").cast("bigint").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


@query("op8_quality_classifier")
def op8(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    model = quality.train(docs, table(spark, sf, "labels"))
    scored = docs.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), quality.score(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


@query(
    "op2_exact_topk",
    """
    WITH v AS (
      SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS w FROM embeddings
      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), scored AS (
      SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.w, c.w), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
    ), ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
    SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
    """,
)
def op2(spark: SparkSession, sf: str) -> DataFrame:
    vectors = table(spark, sf, "embeddings")
    return topk.top_k(vectors.where(F.col("vec_id") % 20 == 0), vectors, 20)


@query("op3_packing")
def op3(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(table(spark, sf, "documents"))


@query("op7_sharding")
def op7(spark: SparkSession, sf: str) -> DataFrame:
    return sharding.shard(table(spark, sf, "documents")).withColumn("grown_shard", F.lit(None).cast("int"))


@query("op4_prob_minhash")
def op4(spark: SparkSession, sf: str) -> DataFrame:
    return near_dedup.near_classes(table(spark, sf, "documents")).select("doc_id", "class_id", "class_rows", "kept")


DOMAINS = {"clean": 0.84, "toxic": 0.13, "low": 0.03}


def domains_of(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) of the labelled table."""
    quality_is, toxic_is = F.col("quality"), F.coalesce(F.col("toxic"), F.lit(0))
    return labels.select("doc_id", F.when(quality_is == 0, "low").when((quality_is == 1) & (toxic_is == 1), "toxic").when(quality_is == 1, "clean").alias("domain"))


@query("op5_soft_mixing")
def op5(spark: SparkSession, sf: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf, "documents"), domains_of(table(spark, sf, "labels")), DOMAINS)
    named = [F.col(f"p_{i}").alias(f"p_{d}") for i, d in enumerate(DOMAINS)]
    return mixed.select(F.col("id").alias("doc_id"), "tokens", *named, "rate", "copies")


@query("op6_secret_scan")
def op6(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    found = secrets.find_secrets(docs, secrets.samples_of(docs, table(spark, sf, "labels")))
    kinds = [k for k, _, _, _ in secrets.PATTERNS]
    kind_of = F.transform("spans", lambda s: s["kind"])
    counts = [(F.size("spans") - F.size(F.array_remove(kind_of, k))).cast("bigint").alias(f"n_{k}") for k in kinds]
    base = F.filter("spans", lambda s: s["kind"] != "markov")
    return found.select("doc_id", *counts, F.sha2(secrets.written(base), 256).alias("base_sha256"), secrets.written(F.col("spans")).alias("spans"))


@query("op9_language_id")
def op9(spark: SparkSession, sf: str) -> DataFrame:
    model = language.train(table(spark, sf, "documents"))
    return language.identify(table(spark, sf, "pages"), model)


# Fixed values of the contracts: the characters of a term, and the letters that are lower-cased.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
LOWERED = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


@query(
    "op13_lexical_search",
    f"""
    WITH d AS (
      SELECT doc_id, row_number() OVER () AS r, list_transform(regexp_extract_all(coalesce(text, ''), '{TERM}'), lambda t: translate(t, {LOWERED})) AS ts FROM documents
    ), totals AS (SELECT count(*) FILTER (len(ts) > 0) AS n_docs, sum(len(ts))::BIGINT AS n_terms FROM d
    ), items AS (
      SELECT item_id, term, count(*) AS times
      FROM (SELECT item_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '{TERM}')), {LOWERED}) AS term FROM benchmark) GROUP BY ALL
    ), tf AS (
      SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(ts) AS n, unnest(ts) AS term FROM d) WHERE term IN (SELECT term FROM items) GROUP BY ALL
    ), w AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, totals GROUP BY term
    ), scored AS (
      SELECT item_id, r, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms)))) AS BIGINT) AS score
      FROM tf JOIN w USING (term) JOIN items USING (term), totals GROUP BY item_id, r, doc_id
    ), ranked AS (
      SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0
    )
    SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20
    """,
)
def op13(spark: SparkSession, sf: str) -> DataFrame:
    return lexical.search(table(spark, sf, "documents"), table(spark, sf, "benchmark"), 20)


WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@query(
    "op11_decontamination",
    f"""
    WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), {LOWERED}), '{WORD}') AS w FROM documents
    ), b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), {LOWERED}), '{WORD}') AS w FROM benchmark
    ), windows AS (
      SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS phrase
      FROM b, unnest(range(1, greatest(len(w) - 8, 2))) AS t(i) WHERE len(w) > 0
    ), grams AS (
      SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS phrase
      FROM d, (SELECT DISTINCT n FROM windows), unnest(range(1, greatest(len(w) - n + 2, 1))) AS t(i)
    ), found AS (SELECT r, item_id, n, i FROM grams JOIN windows USING (n, phrase)
    ), words AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT DISTINCT r, n, i FROM found), unnest(range(i, i + n)) AS t(j) GROUP BY r
    ), held AS (
      SELECT r, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS names FROM (SELECT DISTINCT r, item_id FROM found) GROUP BY r
    )
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
      sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN words USING (r) LEFT JOIN held USING (r)
    """,
)
def op11(spark: SparkSession, sf: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf, "documents"), table(spark, sf, "benchmark"), [F.col("doc_id").cast("bigint").alias("doc_id")])
    names = F.array_join(F.array_sort("item_ids"), ",")
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("bigint").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


def damaged(turns: DataFrame) -> DataFrame:
    """Conversations with rows dropped, emptied, cut off, repeated and given to the user, as CRC-32 of ``conv_id:turn`` decides."""
    name = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    hit = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.crc32(name) % 20).alias("hit")).where(F.col("hit") != 0)
    text = F.when(F.col("hit") == 1, "").when(F.col("hit") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    times = F.explode(F.array_repeat(F.lit(1), F.when(F.col("hit") == 3, 2).otherwise(1)))
    return hit.select("conv_id", "turn", F.when(F.col("hit") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), times.alias("one")).drop("one")


@query(
    "op12_conversation_repair",
    r"""
    WITH RECURSIVE crc AS (
      SELECT list_transform(range(256), lambda x: list_reduce(range(8), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, x)) AS tab
    ), named AS (
      SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name
      FROM conversations
    ), coded AS (
      SELECT named.*, xor(list_reduce(list_transform(range(1, length(name) + 1), lambda i: CAST(ascii(name[i]) AS BIGINT)),
        lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1]), 4294967295), 4294967295) % 20 AS hit FROM named, crc
    ), damaged AS (
      SELECT conv_id, turn, CASE hit WHEN 4 THEN 'user' ELSE role END AS role,
        CASE hit WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
      FROM coded, unnest(CASE hit WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END)
    ), numbered AS (
      SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS i,
        regexp_replace(text, '[ 	-
]+$', '') AS inked, left(role, 1) AS initial FROM damaged
    ), classed AS (
      SELECT *, CASE WHEN inked = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN right(inked, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
        lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM numbered
    ), least_edits AS (
      SELECT conv_id, max(i) + 1 AS i, [{'c': 0, 'a': ''}, {'c': 6, 'a': 'II'}, {'c': 3, 'a': 'I'}, {'c': 0, 'a': ''}] AS v FROM classed GROUP BY conv_id
      UNION ALL
      SELECT conv_id, i, list_transform([1, 2, 3, 4], lambda s: list_min([
        u[s], {'c': 3 + u[[3, 3, 4, 3][s]].c, 'a': 'I' || u[[3, 3, 4, 3][s]].a}, {'c': 6 + u[[4, 4, 3, 4][s]].c, 'a': 'II' || u[[4, 4, 3, 4][s]].a}]))
      FROM (
        SELECT r.conv_id, r.i, list_transform([1, 2, 3, 4], lambda s: list_min([
          {'c': 4 + v[s].c, 'a': 'D' || v[s].a},
          CASE WHEN fault NOT IN ('blank', 'duplicate') THEN {'c': 3 + CASE fault WHEN 'truncated' THEN 3 ELSE 0 END + v[[3, 3, 4, 3][s]].c, 'a': 'R' || v[[3, 3, 4, 3][s]].a} END,
          CASE WHEN fault NOT IN ('blank', 'duplicate') AND (initial = 's' AND s = 1 OR initial = 'u' AND s <> 3 OR initial = 'a' AND s = 3) THEN
            {'c': CASE fault WHEN 'truncated' THEN 3 ELSE 0 END + v[CASE initial WHEN 's' THEN 2 WHEN 'u' THEN 3 ELSE 4 END].c, 'a': 'K' || v[CASE initial WHEN 's' THEN 2 WHEN 'u' THEN 3 ELSE 4 END].a} END])) AS u
        FROM least_edits e JOIN classed r ON r.conv_id IS NOT DISTINCT FROM e.conv_id AND r.i = e.i - 1
      )
    ), chosen AS (SELECT conv_id, v[1].c AS cost, v[1].a AS audit FROM least_edits WHERE i = 1
    ), letters AS (
      SELECT conv_id, k, audit[k] AS edit, count(*) FILTER (audit[k] <> 'I') OVER w AS i, count(*) FILTER (audit[k] <> 'D') OVER w AS put
      FROM chosen, unnest(range(1, length(audit) + 1)) AS t(k) WINDOW w AS (PARTITION BY conv_id ORDER BY k)
    ), laid AS (
      SELECT l.*, r.role, r.text, bool_or(put = 1 AND edit = 'K' AND initial = 's') OVER (PARTITION BY l.conv_id) AS opened
      FROM letters l LEFT JOIN classed r ON r.conv_id IS NOT DISTINCT FROM l.conv_id AND r.i = l.i AND l.edit <> 'I' WHERE edit <> 'D'
    ), repaired AS (
      SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (put - CASE WHEN opened THEN 1 ELSE 0 END) % 2 = 1 THEN 'user' ELSE 'assistant' END
        || ':' || CASE edit WHEN 'I' THEN '' ELSE text END, chr(10) ORDER BY k) AS lines FROM laid GROUP BY conv_id
    ), told AS (
      SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
        count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (i > 1 AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM classed GROUP BY conv_id
    )
    SELECT o.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
      CAST(coalesce(cost, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(lines, '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN told t ON t.conv_id IS NOT DISTINCT FROM o.conv_id
      LEFT JOIN chosen c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN repaired r ON r.conv_id IS NOT DISTINCT FROM o.conv_id
    """,
)
def op12(spark: SparkSession, sf: str) -> DataFrame:
    turns = table(spark, sf, "conversations")
    done = repair.repair(damaged(turns))
    ids = turns.select(F.col("conv_id").alias("original")).distinct()
    told = ids.join(done.report, F.col("original").eqNullSafe(F.col("conv_id")), "left").drop("conv_id")
    told = told.join(repair.digests(done.turns), F.col("original").eqNullSafe(F.col("conv_id")), "left")
    numbers = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return told.select(
        F.col("original").alias("conv_id"), *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256")
    )
