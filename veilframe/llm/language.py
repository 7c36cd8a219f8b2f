"""Language of web pages by Bayesian fusion of evidence.

Four kinds of evidence meet in one posterior: the likelihood of the page's text under byte-trigram
models of the languages; the language that the markup declares; the address suffix; and the prior of the
page's host. How telling a declaration or suffix is, and what a host tends to publish, is not assumed but
added up by grouped aggregation from the text evidence of all pages: a suffix or declaration by its
share of each language, a host smoothed towards its domain, which is smoothed towards all pages, a declaration or
suffix towards the languages' shares. A page never counts as evidence for itself: its own part is taken out of all
four sums.

The trigram models are fitted on at most about ``train_rows`` rows whose language is known, chosen by a
hash of the id; every page is read whole, without script, style, comments, navigation and tags.

Defined results: NULL html and url count as empty; a page without text, declaration or host leans on
what remains, in the end on the languages' shares among all pages; ties go to the first language in
order; rows without a known language teach nothing, and without any such row the language is NULL; NULL
and repeated ids and repeated rows are pages each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilframe.llm.common import column, saved, small
from veilframe.llm.words import flat, mix, slices

BUCKETS = 1 << 15  # trigrams are counted by a hash of so many values
TRAIN_ROWS = 4_000
STRENGTH = 40.0  # trigrams that a whole text counts for at most: neighbouring ones are not independent
SMOOTH = 5.0  # pages with which a host is drawn to its domain, and a domain to all
DOUBT = 1.0  # pages, of the languages' shares, that every declaration and suffix is counted with
# Labels that with a country's make one suffix.
SECOND_LEVEL = ("ac", "co", "com", "edu", "gov", "net", "org")
DOMAIN = rf"([^.]+\.(?:(?:{'|'.join(SECOND_LEVEL)})\.[a-z]{{2}}|[^.]+))$"
ADDRESS = r"^[0-9.]+$"
HIDDEN = r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<nav\b.*?</nav\s*>|<!--.*?-->|<[^>]*>|&#?\w+;"


def trigrams(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of each three bytes in a row of each lower-cased text; other than letters count as one space."""
    array = pc.replace_substring_regex(pc.utf8_lower(array), r"[^\p{L}]+", " ")
    data, offsets = flat(array)
    if len(data) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code = data[:-2].astype(np.uint64) | data[1:-1].astype(np.uint64) << np.uint64(8) | data[2:].astype(np.uint64) << np.uint64(16)
    at = np.arange(len(code))
    text = np.searchsorted(offsets, at, "right") - 1
    inside = at + 3 <= offsets[text + 1]
    return text[inside], (mix(code[inside]) % np.uint64(BUCKETS)).astype(np.int64)


class Languages:
    """The languages in order and the log likelihood of each bucket in each."""

    def __init__(self, names: list[str], logs: np.ndarray):
        self.names, self.logs = names, logs

    def evidence(self, array: pa.Array) -> np.ndarray:
        """Log likelihoods of each text, weakened to STRENGTH trigrams; zeros for a text without any."""
        text, found = trigrams(array)
        n = np.bincount(text, minlength=len(array))
        sums = np.column_stack([np.bincount(text, row[found], len(array)) for row in self.logs])
        return sums * (np.minimum(n, STRENGTH) / np.maximum(n, 1))[:, None]


def train(rows: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", train_rows: int = TRAIN_ROWS) -> Languages | None:
    """Count trigrams by language, in each task and then over all."""
    known = rows.select(column(id_col).alias("id"), F.lower(column(lang_col).cast("string")).alias("lang"), column(text_col).cast("string").alias("text"))
    known = known.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    n = known.count()
    if not n:
        return None
    if n > train_rows:
        known = known.where(F.pmod(F.xxhash64("id", F.substring("text", 1, 32)), F.lit(1 << 30)) < int((1 << 30) * train_rows / n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in (part for whole in batches for part in slices(whole, "text")):
            langs = batch.column("lang").dictionary_encode()
            text, found = trigrams(batch.column("text"))
            of = langs.indices.to_numpy()[text]
            for i, name in enumerate(langs.dictionary.to_pylist()):
                counts[name] = counts.get(name, 0) + np.bincount(found[of == i], minlength=BUCKETS)
        for name, c in counts.items():
            some = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(some)), pa.array(some), pa.array(c[some])], names=["lang", "bucket", "n"])

    counted = known.select("lang", "text").mapInArrow(run, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found = counted.collect()  # at most BUCKETS numbers a language
    names = sorted({r["lang"] for r in found})
    if not names:
        return None
    counts = np.zeros((len(names), BUCKETS))
    for r in found:
        counts[names.index(r["lang"]), r["bucket"]] = r["n"]
    return Languages(names, np.log((counts + 0.5) / (counts + 0.5).sum(1, keepdims=True)))


def add_up(rows: DataFrame, n: int, *keys: str) -> DataFrame:
    """The pages of each key by language, from their text evidence."""
    return rows.groupBy(*keys).agg(F.array(*[F.sum(F.col("t")[i]) for i in range(n)]).alias("sums"), F.sum(F.lit(1.0)).alias("n"))


def plus(a: Column, b: Column, scale: float = 1.0) -> Column:
    return F.zip_with(a, b, lambda x, y: x + scale * y)


def identify(pages: DataFrame, model: Languages | None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, lang, confidence, text_lang, declared, suffix, host): one row per page."""
    url, html = (F.coalesce(column(c).cast("string"), F.lit("")) for c in (url_col, html_col))
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    narrow = pages.select(
        column(id_col).cast("bigint").alias("page_id"), host.alias("host"), 
        F.when(host.rlike(ADDRESS), "").otherwise(F.regexp_extract(host, r"\.([^.]+)$", 1)).alias("suffix"),
        F.when(host.rlike(ADDRESS), host).otherwise(F.regexp_extract(host, DOMAIN, 1)).alias("domain"),
        F.lower(F.regexp_extract(html, r"""(?i)<html\b[^>]*?\slang\s*=\s*["']?([a-z]{2,3})""", 1)).alias("declared"), html.alias("html"),
    )
    if model is None:
        none = F.lit(None)
        return narrow.select("page_id", none.cast("string").alias("lang"), none.cast("double").alias("confidence"), none.cast("string").alias("text_lang"), "declared", "suffix", "host")

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def evidence(array: pa.Array) -> pa.Array:
        parts = slices(pa.RecordBatch.from_arrays([array], names=["html"]), "html")
        found = np.concatenate([np.zeros((0, len(model.names))), *(model.evidence(pc.replace_substring_regex(p.column("html"), HIDDEN, " ")) for p in parts)])
        return pa.ListArray.from_arrays(np.arange(0, found.size + 1, len(model.names), dtype=np.int32), found.ravel())

    n = len(model.names)
    read = narrow.select("page_id", "host", "suffix", "domain", "declared", evidence("html").alias("e"))
    odds = F.transform("e", lambda x: F.exp(x - F.array_max("e")))
    rows = saved(read.withColumn("odds", odds).withColumn("t", F.transform("odds", lambda x: x / F.aggregate("odds", F.lit(0.0), lambda a, y: a + y))).drop("odds"), "page-evidence")
    everything = add_up(rows, n).first()  # one row
    pages_all = everything["n"] or 0.0
    counted = F.array(*[F.lit(s if pages_all else 0.0) for s in everything["sums"]])

    def other(sums: Column) -> Column:
        """What the other pages add up to; a rest of rounding is none."""
        return F.zip_with(sums, F.col("t"), lambda x, y: F.greatest(x - y, F.lit(0.0)))

    # the languages' shares among the other pages
    shares = F.transform(other(counted), lambda x: (x + 1) / (pages_all - 1 + n))

    def sums_of(name: str) -> DataFrame:
        return small(saved(add_up(rows.where(F.col(name) != ""), n, name).select(name, F.col("sums").alias(f"{name}_sums")), f"{name}-evidence"))

    def telling(name: str) -> Column:
        """log P(value | language) of a declaration or suffix, but for what all languages have in common."""
        logs = F.zip_with(other(F.col(f"{name}_sums")), F.col("share"), lambda x, s: F.log((x + DOUBT * s) / s))
        return F.when(F.col(f"{name}_sums").isNotNull(), logs).otherwise(F.array(*[F.lit(0.0)] * n))

    domains = add_up(rows, n, "domain").select("domain", F.col("sums").alias("domain_sums"), F.col("n").alias("domain_n"))
    hosts = saved(add_up(rows, n, "host", "domain").join(domains, "domain").select("host", F.col("sums").alias("host_sums"), F.col("n").alias("host_n"), "domain_sums", "domain_n"), "hosts")
    joined = rows.join(small(hosts), "host").join(sums_of("declared"), "declared", "left").join(sums_of("suffix"), "suffix", "left").withColumn("share", shares)
    domain = F.transform(plus(other(F.col("domain_sums")), F.col("share"), SMOOTH), lambda x: x / (F.col("domain_n") - 1 + SMOOTH))
    prior = F.transform(plus(other(F.col("host_sums")), domain, SMOOTH), lambda x: F.log(x / (F.col("host_n") - 1 + SMOOTH)))
    total = plus(plus(plus(F.col("e"), prior), telling("declared")), telling("suffix"))
    names = F.array(*[F.lit(x) for x in model.names])

    def best(values: Column) -> Column:
        return F.element_at(names, F.array_position(values, F.array_max(values)).cast("int"))

    result = joined.select("page_id", total.alias("total"), "e", "declared", "suffix", "host")
    spread = F.aggregate(F.transform("total", lambda x: F.exp(x - F.array_max("total"))), F.lit(0.0), lambda a, y: a + y)
    return result.select("page_id", best(F.col("total")).alias("lang"), (1 / spread).alias("confidence"), best(F.col("e")).alias("text_lang"), "declared", "suffix", "host")
