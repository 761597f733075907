"""Mixing sources to target weights, with DataFrame functions only.

Temperature mixing: the weight of a source is its token share to the power of an exponent, normalised. The exponent is bisected
over a grid of 1/1024 between 0 (all sources alike) and 1 (natural shares): the largest one that meets the target entropy, or the
smallest one that keeps every source within the repetition limit, whichever is larger. A budget of tokens turns weights into
quotas, and quotas are realised as block permutations: the documents of a source are dealt by hash into blocks; each epoch visits
the blocks and the documents of a block in an order of its own; an epoch stops where the quota is used up.

Running token sums are taken within (source, epoch, block) only, on top of the blocks' totals, so a source with a third of all
rows is spread over its blocks. The number of blocks of a source grows with its tokens. Only the sums over sources for each trial
exponent reach the driver.

Edge cases: a null source is a source of its own; null and empty texts have no tokens, and they are visited like any other row
(their source gets one epoch where it has no tokens at all). Repeated rows are visited as often as they come; rows of one doc_id are
ordered by their tokens, then by a hash of their text. Very long texts are counted whole, and a document is never split: a source ends
with the document that reaches its quota. Other columns are left out, or stand in the struct ``row``; an empty table gives an empty
mixture. From 2e11 tokens a source on, blocks grow with the source (8e12 tokens: 8 million a block).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

GRID = 1024
#: Tokens of a block, about; the most blocks a source is dealt into.
BLOCK_TOKENS, MAX_BLOCKS = 200_000, 1 << 20


def n_tokens(text: Column) -> Column:
    """Words of a text, counted without building them."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _digest(seed: int, *parts: Column) -> Column:
    """Hexadecimal digest that shuffles rows the same way in any engine."""
    return F.md5(F.concat_ws("/", F.lit(str(seed)), *(p.cast("string") for p in parts)))


def _number(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, 7), 16, 10).cast("int")


def token_shares(docs: DataFrame, tokens: Column, source: str) -> DataFrame:
    """``source, docs, tokens`` of every source."""
    return docs.groupBy(F.col(source).alias("source")).agg(F.count("*").alias("docs"), F.sum(tokens).alias("tokens"))


def _trials(shares: DataFrame, exponents: list[int]) -> dict[int, tuple[float, float, float]]:
    """Entropy, epochs for each token of budget in the most repeated source, and least budget that visits every source in full, for each
    exponent k/GRID: one job for all of them."""
    w = F.pow(F.col("tokens").cast("double"), F.col("k") / F.lit(float(GRID)))
    rows = (
        shares.where("tokens > 0").select("tokens", F.explode(F.array(*(F.lit(k) for k in exponents))).alias("k")).withColumn("w", w)
        .groupBy("k").agg(F.sum("w").alias("z"), F.sum(F.col("w") * F.log("w")).alias("wl"), F.max(F.col("w") / F.col("tokens")).alias("most"), F.max(F.col("tokens") / F.col("w")).alias("full"))
        .collect()
    )
    return {r["k"]: (math.log(r["z"]) - r["wl"] / r["z"], r["most"] / r["z"], r["full"] * r["z"]) for r in rows}


def choose_exponent(shares: DataFrame, entropy_gain: float, max_epochs: float, budget: float | None = None) -> tuple[int, float]:
    """Exponent k of k/GRID and the token budget.

    The target entropy lies ``entropy_gain`` of the way from the natural entropy to that of equal weights. Without a ``budget``
    the smallest is taken that visits every source at least once in full. A ``budget`` of more than ``max_epochs`` times all tokens
    can't be had within the limit at any exponent; it is cut to that. The bracket of the bisection is cut into GRID ** 0.5 parts a step.
    """
    shares = shares.cache()
    step = math.isqrt(GRID)
    seen = _trials(shares, list(range(0, GRID + 1, step)))
    if seen:
        if budget:
            budget = min(float(budget), max_epochs * shares.agg(F.sum("tokens")).first()[0])
        target = seen[GRID][0] + entropy_gain * (seen[0][0] - seen[GRID][0])
        even = lambda k: seen[k][0] >= target - 1e-9  # noqa: E731  falls with k
        within = lambda k: seen[k][1] * (budget or seen[k][2]) <= max_epochs + 1e-9  # noqa: E731  rises with k
        k = max(x for x in seen if even(x))
        if k < GRID:
            seen |= _trials(shares, list(range(k + 1, k + step)))
            k = max(x for x in seen if even(x))
        if not within(k):
            far = min((x for x in seen if within(x)), default=GRID)
            near = max((x for x in seen if x < far), default=0)
            if far - near > 1:
                seen |= _trials(shares, list(range(near + 1, far)))
            k = min((x for x in seen if within(x)), default=GRID)
        budget = float(budget or seen[k][2])
    shares.unpersist()
    return (k, budget) if seen else (GRID, 0.0)


def quotas(shares: DataFrame, k: int, budget: float) -> DataFrame:
    """``source, tokens, docs, weight, quota`` (whole tokens) of every source."""
    w = F.when(F.col("tokens") > 0, F.pow(F.col("tokens").cast("double"), F.lit(k / GRID))).otherwise(F.lit(0.0))
    z = shares.agg(F.sum(w).alias("z")).first()["z"] or 1.0
    return shares.withColumn("weight", w / F.lit(z)).withColumn("quota", F.greatest(F.round(F.col("weight") * F.lit(budget)).cast("long"), F.lit(0)))


def mix(docs: DataFrame, entropy_gain: float = 0.25, max_epochs: float = 4.0, budget: float | None = None, source: str = "source", text: str = "text", key: str = "doc_id", seed: int = 0, with_row: bool = False) -> DataFrame:
    """One row for each visit: ``key``, ``source``, ``epoch``, ``block``, ``tokens`` and ``place``, the order in the mixture.

    ``with_row``: also ``row``, a struct of all columns of the document, whatever their names.
    """
    row = [F.struct(*docs.columns).alias("row")] if with_row else []
    slim = materialize(docs.select(key, source, n_tokens(F.col(text)).alias("_tokens")), "mix-tokens")
    shares = token_shares(slim, F.col("_tokens"), source)
    k, total = choose_exponent(shares, entropy_gain, max_epochs, budget)
    plan = (
        quotas(shares, k, total)
        .withColumn("epochs", F.when(F.col("tokens") > 0, F.ceil(F.col("quota") / F.col("tokens"))).otherwise(F.lit(1)).cast("int"))
        .withColumn("blocks", F.least(F.lit(MAX_BLOCKS), F.col("tokens") / F.lit(float(BLOCK_TOKENS)) + 1).cast("int"))
        .select(F.col("source").alias("_source"), "quota", "epochs", "blocks", F.col("tokens").alias("_total"))
    )

    def deal(rows: DataFrame) -> DataFrame:
        return rows.join(plan, rows[source].eqNullSafe(plan["_source"])).drop("_source").withColumn("_block", (_number(_digest(seed, F.col(key))) % F.col("blocks")).cast("int"))

    dealt = deal(docs.select(key, source, *row, n_tokens(F.col(text)).alias("_tokens")) if row else slim)
    # where each block of each epoch starts
    totals = deal(slim).groupBy(F.col(source).alias("_s"), "_block").agg(F.sum("_tokens").alias("t"), F.first("quota").alias("quota"), F.first("epochs").alias("epochs"), F.first("_total").alias("_total"))
    visits = totals.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.greatest(F.col("epochs") - 1, F.lit(0)))))
    order = Window.partitionBy("_s", "epoch").orderBy(_digest(seed, F.col("epoch"), F.col("_block")), "_block")
    starts = visits.withColumn("start", F.col("epoch") * F.col("_total") + F.sum("t").over(order) - F.col("t")).where((F.col("start") <= F.col("quota")) | (F.col("_total") == 0))
    begin = starts.select("_s", F.col("_block").alias("_b"), "epoch", "start")
    rows = dealt.join(begin, dealt[source].eqNullSafe(begin["_s"]) & (dealt["_block"] == begin["_b"])).drop("_s", "_b")
    ties = [F.xxhash64(F.col("row")[text])] if row else []  # of rows that repeat a key
    inside = Window.partitionBy(source, "epoch", "_block").orderBy(_digest(seed, F.col("epoch"), F.col(key)), key, "_tokens", *ties)
    before = F.coalesce(F.sum("_tokens").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    used = rows.withColumn("_before", F.col("start") + before).where((F.col("_before") < F.col("quota")) | ((F.col("_before") == F.col("quota")) & (F.col("_tokens") == 0)) | (F.col("_total") == 0))
    place = F.when(F.col("quota") > 0, F.col("_before") / F.col("quota")).otherwise(F.lit(0.0))
    return used.select(F.col(key), *["row"][: len(row)], F.col(source).alias("source"), F.col("epoch").cast("int").alias("epoch"), F.col("_block").alias("block"), F.col("_tokens").alias("tokens"), F.round(place, 9).alias("place"))
