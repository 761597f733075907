"""Quality rules with verdicts for hosts, with DataFrame functions only.

Base rules judge each document: too few words, or too many words in repeated 3-word windows. Failures are summed by host (here the
``source`` column); each host's failure rate is shrunk by a beta prior fitted to all hosts by the method of moments, so that hosts
with few documents move towards the general rate. Hosts with a shrunk rate above ``HOST_LIMIT`` are rejected, and that verdict is
joined back: a document is kept if it passes the base rules and its host is not rejected.

Window counts are taken inside the row, by sorting the hashes of the windows with their positions: no word is shuffled. Counts of
hosts are partially aggregated before their shuffle; the features, a few numbers a row, are written once and read twice.

Edge cases: null texts count as empty: 0 words, so they fail; a null host is a host of its own; repeated rows count as often as
they come; with a single host, or hosts that all have one rate, the prior is as strong as ``MAX_PRIOR`` documents. Very long texts
are read whole, inside their row; a host at exactly ``HOST_LIMIT`` is not rejected; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, words

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
HOST_LIMIT = 0.5
#: Bounds of the prior's weight, in documents.
MIN_PRIOR, MAX_PRIOR = 1.0, 1000.0
SYMBOLS = "#*$%&|<>"


def _repeats(windows: Column) -> Column:
    """Words in windows of three that occur twice or more, from the sorted array of (hash, position)."""
    n = F.size(windows)
    twice = F.filter(
        F.transform(windows, lambda x, i: F.when(((i > 0) & (F.get(windows, i - 1)["h"] == x["h"])) | ((i < n - 1) & (F.get(windows, i + 1)["h"] == x["h"])), x["p"])),
        lambda p: p.isNotNull(),
    )
    covered = F.aggregate(
        F.array_sort(twice),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).cast("int").alias("last")),
        lambda s, p: F.struct((s["n"] + F.least(F.lit(3), p - s["last"])).alias("n"), p.alias("last")),
    )
    return covered["n"]


def features(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """``key, host`` and the base numbers of every document."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    symbols = F.length(t) - F.length(F.translate(t, SYMBOLS, ""))
    white = F.length(t) - F.length(F.translate(t, " \t\n\x0b\x0c\r", ""))
    base = docs.select(F.col(key).alias("doc_id"), F.col(host).alias("host"), words(F.col(text)).alias("w"), lines.alias("lines"), symbols.cast("long").alias("n_symbols"), (F.length(t) - white).cast("long").alias("word_chars"))
    hashed = base.select(
        "doc_id", "host", F.size("w").cast("long").alias("n_words"), "word_chars", "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("w") >= 3, F.transform(F.sequence(F.lit(0), F.size("w") - 3), lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)))).otherwise(F.array().cast("array<long>")).alias("g"),
    )
    windows = F.when(F.size(F.array_distinct("g")) == F.size("g"), F.lit(None)).otherwise(F.array_sort(F.transform("g", lambda h, i: F.struct(h.alias("h"), i.cast("int").alias("p")))))
    placed = hashed.withColumn("s", windows).drop("g")
    n_repeat = F.when(F.col("s").isNull(), F.lit(0)).otherwise(_repeats(F.col("s"))).cast("long")
    return placed.select("doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", n_repeat.alias("n_repeat_words"))


def host_verdicts(judged: DataFrame) -> DataFrame:
    """``host, host_docs, host_failed, host_rate`` (shrunk) of every host."""
    hosts = judged.groupBy("host").agg(F.count("*").alias("host_docs"), F.sum(F.col("base_failed").cast("long")).alias("host_failed"))
    rate = F.col("host_failed") / F.col("host_docs")
    m = hosts.agg(F.sum("host_failed").alias("f"), F.sum("host_docs").alias("n"), F.avg(rate).alias("m"), F.var_pop(rate).alias("v"), F.avg(1 / F.col("host_docs")).alias("inv"))
    # method of moments: the variance of rates beyond that of sampling gives the prior's weight
    mean = F.try_divide(F.col("f"), F.col("n"))
    spread = F.col("m") * (1 - F.col("m"))
    extra = F.col("v") - spread * F.col("inv")
    weight = F.when(extra <= 0, F.lit(MAX_PRIOR)).otherwise(F.greatest(F.lit(MIN_PRIOR), F.least(F.lit(MAX_PRIOR), F.try_divide(spread, extra) - 1)))
    prior = m.select(mean.alias("prior_mean"), F.coalesce(weight, F.lit(MAX_PRIOR)).alias("prior_weight")).first()
    mean_v, weight_v = prior["prior_mean"] or 0.0, prior["prior_weight"]
    return hosts.withColumn("host_rate", (F.col("host_failed") + F.lit(mean_v * weight_v)) / (F.col("host_docs") + F.lit(weight_v)))


def apply_rules(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """doc_id, the base numbers, ``base_failed``, ``host_rate`` and ``kept`` of every document."""
    base = features(docs, key, text, host)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    judged = materialize(base.withColumn("base_failed", failed), "rules-features")
    hosts = host_verdicts(judged)
    joined = judged.join(hosts.withColumnRenamed("host", "_host"), F.col("host").eqNullSafe(F.col("_host")))
    kept = ~F.col("base_failed") & (F.col("host_rate") <= HOST_LIMIT)
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.round("host_rate", 6).alias("host_rate"), kept.alias("kept"))
