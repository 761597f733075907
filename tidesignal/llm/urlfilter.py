"""URL filters against dated lists, with DataFrame functions only.

List entries (list, pattern, action, effective date) become validity intervals: an entry of a list holds for its pattern until the
list's next entry for it. A pattern is a domain, which also covers its subdomains, or ``host/segment`` with the first segment of
the path. Each capture is judged by the entries active at its fetch date: an active ``allow`` beats an active ``block``; ``clear``
ends either.

The as-of join is an equality join. A verdict depends only on (host, segment, fetch date), so captures are reduced to their distinct
triples first, which takes care of hot hosts; a triple is expanded to its candidate patterns, intervals to the months they touch,
and the two meet on (pattern, month), with the exact dates as a filter. Verdicts are joined back to all captures.

Patterns are counted beforehand. Those that one in ``HOT`` candidates or more asks for, as top-level domains are, number at most ``HOT``
for that reason, so they are broadcast: candidates for a hot pattern that no entry names are dropped before the shuffle, and those
for a hot one that is named are spread over ``SALTS`` parts, to each of which its intervals are copied.

Edge cases: a null or unreadable url is ``invalid`` and not kept; a null fetch date or one before all entries finds no entry and is
``clean``; of several entries of one list, pattern and date the greatest action (clear, block, allow) holds; entries with nulls are
ignored; repeated captures are returned as often as they come; with an empty list all captures are clean; an empty table of captures
gives an empty result. Very long urls are read whole; only the host and the first segment of the path take part. Other columns of captures and
entries are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_HOST = r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)"
_SEGMENT = r"^[a-z][a-z0-9+.-]*://[^/?#]*/([^/?#]+)"

#: A pattern is hot if one in so many candidates asks for it, and is spread over so many parts.
HOT, SALTS = 1000, 64


def host_of(url: Column) -> Column:
    return F.rtrim(F.regexp_extract(F.lower(F.trim(F.coalesce(url, F.lit("")))), _HOST, 1), F.lit("."))


def segment_of(url: Column) -> Column:
    return F.regexp_extract(F.lower(F.trim(F.coalesce(url, F.lit("")))), _SEGMENT, 1)


def _rank(action: Column) -> Column:
    return F.when(action == "allow", 3).when(action == "block", 2).when(action == "clear", 1)


def intervals(entries: DataFrame) -> DataFrame:
    """``list, pattern, action, valid_from, valid_to`` (exclusive, null while it still holds) of entries that block or allow."""
    clean = entries.select("list", F.lower("pattern").alias("pattern"), _rank(F.col("action")).alias("rank"), F.col("effective").cast("date").alias("valid_from")).where("list is not null and pattern is not null and rank is not null and valid_from is not null")
    days = clean.groupBy("list", "pattern", "valid_from").agg(F.max("rank").alias("rank"))
    following = F.lead("valid_from").over(Window.partitionBy("list", "pattern").orderBy("valid_from"))
    return days.withColumn("valid_to", following).where("rank > 1").withColumn("action", F.when(F.col("rank") == 3, "allow").otherwise("block")).drop("rank")


def judge(captures: DataFrame, entries: DataFrame, key: str = "page_id", url: str = "url", fetched: str = "fetch_date") -> DataFrame:
    """``key, url, host, fetch_date, verdict, rule`` (the deciding pattern) and ``kept`` of every capture."""
    seen = captures.select(F.col(key), F.col(url).alias("url"), F.col(fetched).cast("date").alias("fetch_date"), host_of(F.col(url)).alias("host"), segment_of(F.col(url)).alias("segment"))
    cases = seen.where((F.col("host") != "") & F.col("fetch_date").isNotNull()).select("host", "segment", "fetch_date").distinct()
    labels = F.split("host", r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    paths = F.when(F.col("segment") != "", F.array(F.concat_ws("/", "host", "segment"))).otherwise(F.array().cast("array<string>"))
    asked = cases.select("*", F.explode(F.array_distinct(F.concat(domains, paths))).alias("pattern"), F.trunc("fetch_date", "month").alias("month"))

    last, candidates = asked.agg(F.max("fetch_date"), F.count("*")).first()
    valid = intervals(entries)
    counts = asked.groupBy("pattern").count().where(F.col("count") * HOT >= candidates).select("pattern")
    hot = counts.join(valid.select("pattern", F.lit(True).alias("_named")).distinct(), "pattern", "left").select("pattern", F.lit(True).alias("_hot"), "_named")
    hot = F.broadcast(hot)  # at most HOT patterns: their shares add up to one
    asked = asked.join(hot, "pattern", "left").where("_hot is null or _named")
    asked = asked.withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64("host", "segment", "fetch_date"), F.lit(SALTS))).otherwise(F.lit(0)).cast("int")).drop("_hot", "_named")
    if last is not None:
        end = F.least(F.date_sub(F.coalesce("valid_to", F.lit(last) + 1), 1), F.lit(last))
        valid = valid.where(F.col("valid_from") <= F.lit(last)).withColumn("month", F.explode(F.sequence(F.trunc("valid_from", "month"), F.trunc(F.greatest(end, F.col("valid_from")), "month"), F.expr("interval 1 month"))))
    else:
        valid = valid.where("false").withColumn("month", F.col("valid_from"))
    parts = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    valid = valid.join(hot.select("pattern", "_hot"), "pattern", "left").withColumn("_salt", F.explode(parts)).drop("_hot")
    active = asked.join(valid, ["pattern", "month", "_salt"]).where((F.col("fetch_date") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("fetch_date") < F.col("valid_to"))))
    verdicts = active.groupBy("host", "segment", "fetch_date").agg(F.min(F.when(F.col("action") == "allow", F.col("pattern"))).alias("_allow"), F.min(F.when(F.col("action") == "block", F.col("pattern"))).alias("_block"))
    joined = seen.join(verdicts, ["host", "segment", "fetch_date"], "left")
    verdict = F.when(F.col("host") == "", "invalid").when(F.col("_allow").isNotNull(), "allowed").when(F.col("_block").isNotNull(), "blocked").otherwise("clean")
    return joined.select(key, F.col("url").alias(url), "host", "fetch_date", verdict.alias("verdict"), F.coalesce("_allow", "_block").alias("rule"), (~verdict.isin("invalid", "blocked")).alias("kept"))
