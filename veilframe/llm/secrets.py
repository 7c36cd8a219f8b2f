"""Secret scan: fixed patterns, and strings that look drawn rather than written, in DataFrame operations only.

Two first-order Markov models of characters, one of random strings and one of ordinary identifiers, are
fitted on labelled samples. Every long run of key characters in a text that no pattern has claimed is
scored by the sum of its characters' log-likelihood ratios, and is a secret if that passes the
threshold, which is set so high that hardly any ordinary sample does. Positions are worked out from the
lengths of what lies between matches: code points, end exclusive.

Defined results: a NULL text counts as empty and has no spans; NULL and repeated ids and repeated rows
are rows like any other; samples that are NULL or shorter than two characters teach nothing; without
samples of both kinds only the patterns find anything.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.llm.common import column, saved

# The base patterns, the group whose length counts, and that least length.
PATTERNS = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),  # maximal runs of hex digits, of which shorter ones would be dropped
)
SHORTEST = 16  # characters of a run that is scored
RUN = r"[A-Za-z0-9+/_=-]{16,}"
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
LEAST = 12.0  # natural-log odds below which no run is reported
QUANTILE = 0.9999  # of the ordinary samples' scores, another lower bound
DRAWN = 20.0  # pairs with which what follows a character is drawn to that
TRAIN_DOCS = 400
RANDOM_SAMPLES = 6_000


def matches(text: Column, pattern: str, group: int, least: int) -> Column:
    """array<struct<start,end>> of the leftmost non-overlapping matches whose group is long enough."""
    # what a match leaves of the text, and the matches, make up the text again
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    zipped = F.arrays_zip(whole.alias("m"), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("g"), F.slice(F.split(text, pattern, -1), 1, F.size(whole)).alias("gap"))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("found"))

    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["m"])
        span = F.array(F.struct(start.alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(F.length(x["g"]) >= least, F.concat(acc["found"], span)).otherwise(acc["found"]).alias("found"))

    none = F.array().cast("array<struct<start:int,end:int>>")
    return F.when(text.rlike(pattern), F.aggregate(zipped, zero, add)["found"]).otherwise(none)


def pairs_of(word: Column) -> Column:
    """The neighbouring characters of a string, one pair a row."""
    return F.explode(F.transform(F.sequence(F.lit(1), F.length(word) - 1), lambda i: F.substring(word, i, F.lit(2))))


def markov_ratios(samples: DataFrame) -> DataFrame | None:
    """(pair, ratio) for every pair of the alphabet: the log of how much likelier random strings go on like that.

    ``samples`` are (text, random boolean). What follows a character is drawn to how often characters come at
    all. None without samples of both kinds.
    """
    spark = samples.sparkSession
    letters = spark.range(len(ALPHABET)).select(F.substring(F.lit(ALPHABET), (F.col("id") + 1).cast("int"), F.lit(1)).alias("c"))
    counted = samples.where(F.length("text") > 1).select("random", pairs_of(F.col("text")).alias("pair")).groupBy("pair").agg(
        F.count(F.when(F.col("random"), 1)).alias("r"), F.count(F.when(~F.col("random"), 1)).alias("o")
    )
    counted = saved(counted, "pair-counts")
    totals = counted.agg(F.sum("r"), F.sum("o")).first()
    if not totals[0] or not totals[1]:
        return None
    # the square of the alphabet
    second = F.transform(F.sequence(F.lit(1), F.lit(len(ALPHABET))), lambda i: F.substring(F.lit(ALPHABET), i, F.lit(1)))
    grid = letters.select(F.col("c").alias("first"), F.explode(second).alias("second")).withColumn("pair", F.concat("first", "second"))
    grid = grid.join(counted, "pair", "left").select("first", "second", "pair", *[F.coalesce(n, F.lit(0)).alias(n) for n in ("r", "o")])
    firsts = grid.groupBy("first").agg(F.sum("r").alias("rf"), F.sum("o").alias("of"))
    seconds = grid.groupBy("second").agg(F.sum("r").alias("rs"), F.sum("o").alias("os"))

    def likely(n: str, follows: str, comes: str, total: int) -> Column:
        alone = (F.col(comes) + 0.5) / (total + 0.5 * len(ALPHABET))
        return F.log((F.col(n) + DRAWN * alone) / (F.col(follows) + DRAWN))

    ratio = likely("r", "rf", "rs", totals[0]) - likely("o", "of", "os", totals[1])
    return saved(grid.join(firsts, "first").join(seconds, "second").select("pair", ratio.alias("ratio")), "markov")


def scored(runs: DataFrame, ratios: DataFrame, *keys: str) -> DataFrame:
    """The sum of the ratios of each run's pairs, by the keys that name a run."""
    pairs = runs.select(*keys, pairs_of(F.col("run")).alias("pair"))
    return pairs.join(F.broadcast(ratios), "pair").groupBy(*keys).agg(F.sum("ratio").alias("score"))  # the square of the alphabet


def samples_of(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_docs: int = TRAIN_DOCS) -> DataFrame:
    """Labelled samples: words of documents labelled good, alone and joined as identifiers and constants are, and strings drawn at random.

    At most about ``train_docs`` documents, chosen by a hash of the id. What the patterns match is taken out first.
    """
    spark = docs.sparkSession
    good = labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("id")).distinct()
    rows = good.count()
    if rows > train_docs:
        good = good.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int((1 << 30) * train_docs / rows))
    # at most about train_docs ids; only their texts are looked at
    chosen = docs.select(column(id_col).cast("bigint").alias("id"), F.coalesce(column(text_col).cast("string"), F.lit("")).alias("text")).join(F.broadcast(good), "id")
    text = F.col("text")
    for _, pattern, _, _ in PATTERNS:
        text = F.regexp_replace(text, pattern, " ")
    words = chosen.select(text.alias("text")).select(F.regexp_extract_all("text", F.lit(r"[A-Za-z0-9+/_=-]{2,}"), F.lit(0)).alias("ws"))
    joined = F.transform(F.sequence(F.lit(1), F.size("ws") - 1), lambda i: F.concat(F.get("ws", i - 1), F.when(i % 2 == 0, "_").otherwise("-"), F.get("ws", i)))
    ordinary = words.where(F.size("ws") > 1).select(F.explode(F.concat("ws", joined, F.transform(joined, F.upper))).alias("text"), F.lit(False).alias("random"))
    return ordinary.unionByName(random_strings(spark))


def random_strings(spark: SparkSession, count: int = RANDOM_SAMPLES) -> DataFrame:
    """Strings as keys are made: hex, base64, and upper-case letters and digits, from digests of numbers."""
    digest = F.sha2(F.col("id").cast("string"), 256)
    plain = F.base64(F.unhex(digest))
    kinds = F.array(F.substring(digest, 1, 40), F.substring(plain, 1, 40), F.upper(F.regexp_replace(plain, "[+/=a-f]", "")))
    return spark.range(count).select(F.get(kinds, (F.col("id") % 3).cast("int")).alias("text"), F.lit(True).alias("random"))


def threshold(samples: DataFrame, ratios: DataFrame) -> float:
    """What hardly any long ordinary sample reaches, and never less than LEAST."""
    long_ones = samples.where(~F.col("random") & (F.length("text") >= 16)).select(F.col("text").alias("run")).distinct()
    top = scored(long_ones, ratios, "run").agg(F.percentile_approx("score", QUANTILE, 100_000)).first()[0]
    return max(LEAST, top if top is not None else LEAST)


def pieces(run: Column, taken: Column) -> Column:
    """What the taken spans, in order of start, leave of a run: the pieces of at least SHORTEST characters."""
    inside = F.filter(taken, lambda b: (b["start"] < run["end"]) & (run["start"] < b["end"]))
    stop = F.struct(run["end"].alias("start"), run["end"].alias("end"))
    borders = F.concat(F.transform(inside, lambda b: F.struct(b["start"].alias("start"), b["end"].alias("end"))), F.array(stop))

    def add(acc: Column, b: Column) -> Column:
        cut = F.struct(acc["at"].alias("start"), b["start"].alias("end"), F.substring(run["run"], acc["at"] - run["start"] + 1, b["start"] - acc["at"]).alias("run"))
        found = F.when(b["start"] - acc["at"] >= SHORTEST, F.concat(acc["found"], F.array(cut))).otherwise(acc["found"])
        return F.struct(F.greatest(acc["at"], b["end"]).alias("at"), found.alias("found"))

    zero = F.struct(run["start"].alias("at"), F.array().cast("array<struct<start:int,end:int,run:string>>").alias("found"))
    return F.aggregate(borders, zero, add)["found"]


def find_secrets(docs: DataFrame, samples: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, doc_id, spans): one row per input row; spans are array<struct<start,end,kind,rank>> in order of start, then kind."""
    text = F.coalesce(column(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), column(id_col).cast("bigint").alias("doc_id"), text.alias("text"))

    def named(rank: int, kind: str, pattern: str, group: int, least: int) -> Column:
        found = matches(F.col("text"), pattern, group, least)
        return F.transform(found, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind")))

    base_spans = F.concat(*[named(rank, *p) for rank, p in enumerate(PATTERNS)])
    runs = F.transform(matches(F.col("text"), RUN, 0, SHORTEST), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.substring(F.col("text"), s["start"] + 1, s["end"] - s["start"]).alias("run")))
    base = saved(rows.select("row", "doc_id", base_spans.alias("base"), runs.alias("runs")), "secret-spans")
    samples = saved(samples, "samples")
    ratios = markov_ratios(samples)
    if ratios is None:
        return base.select("row", "doc_id", F.array_sort("base").alias("spans"))
    each = base.select("row", F.explode(F.flatten(F.transform("runs", lambda r: pieces(r, F.array_sort("base"))))).alias("r")).select("row", "r.start", "r.end", "r.run")
    drawn = scored(each, ratios, "row", "start", "end").where(F.col("score") > threshold(samples, ratios))
    more = drawn.groupBy("row").agg(F.collect_list(F.struct("start", F.lit(len(PATTERNS)).alias("rank"), "end", F.lit("markov").alias("kind"))).alias("more"))
    return base.join(more, "row", "left").select("row", "doc_id", F.array_sort(F.when(F.col("more").isNull(), F.col("base")).otherwise(F.concat("base", "more"))).alias("spans"))


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
