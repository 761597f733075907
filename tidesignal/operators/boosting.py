"""Boosted regression trees on gradients that a query can state, with validation rows and early stop inside the fit.

A round writes each row's gradient and curvature at its current score, fits one regression tree to their ratio with the curvature as
weight (so a leaf is a Newton step), and adds ``rate`` times the tree. Trees are read back as rows of their nodes; scoring is an expression
over columns. Rows flagged as validation train no tree; the fit ends when ``patience`` rounds have not improved their loss, and
keeps the rounds up to the best one. Rows and scores stay distributed: what reaches the driver is the nodes of a tree and one loss a round.

Gradients come as whole cross-sections for ranking: the rows of one time stamp go to one task, pairs are weighed there by what
swapping them would change in the group's discounted gain.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .cluster import _folder

#: Rows of a group whose pairs are looked at together.
ROWS_AT_ONCE = 1024


@dataclass(frozen=True)
class Node:
    feature: int
    threshold: float
    left: int
    right: int
    value: float
    gain: float


@dataclass
class Boosted:
    names: list[str]
    base: float
    rate: float
    trees: list[list[Node]] = field(default_factory=list)
    #: Validation loss before the first and after each round that was tried.
    losses: list[float] = field(default_factory=list)

    def _tree(self, nodes: list[Node], at: int = 0) -> Column:
        n = nodes[at]
        if n.left < 0:
            return F.lit(n.value)
        return F.when(F.col(self.names[n.feature]) <= n.threshold, self._tree(nodes, n.left)).otherwise(self._tree(nodes, n.right))

    def score(self) -> Column:
        """The model as an expression over its features."""
        out = F.lit(self.base)
        for t in self.trees:
            out = out + F.lit(self.rate) * self._tree(t)
        return out

    def importances(self) -> list[tuple[str, int, float]]:
        """(name, splits, gain): how many nodes split on a feature, and its share of the gain of all splits, each weighed by its rows."""
        splits, gain = [0] * len(self.names), np.zeros(len(self.names))
        for n in (n for t in self.trees for n in t if n.left >= 0):
            splits[n.feature] += 1
            gain[n.feature] += n.gain
        return [(x, splits[k], float(gain[k] / gain.sum()) if gain.sum() else 0.0) for k, x in enumerate(self.names)]


def _nodes(model, folder: str) -> list[Node]:
    """The nodes of a fitted tree, from the table that it is saved as; gains are weighed by the rows of a node."""
    path = f"{folder}/tree-{uuid.uuid4().hex}"
    model.save(path)
    from pyspark.sql import SparkSession

    rows = SparkSession.getActiveSession().read.parquet(f"{path}/data").orderBy("id").collect()  # at most 2 ** (depth + 1)
    return [Node(r["split"]["featureIndex"], r["split"]["leftCategoriesOrThreshold"][0] if r["leftChild"] >= 0 else 0.0, r["leftChild"], r["rightChild"], r["prediction"], max(r["gain"], 0.0) * r["rawCount"]) for r in rows]


def fit(df: DataFrame, names: list[str], gradients: Callable[[DataFrame], DataFrame], loss: Callable[[DataFrame], float], base: float = 0.0, validation: str | None = None, rounds: int = 20, depth: int = 3, rate: float = 0.1, patience: int = 3, bins: int = 64) -> Boosted:
    """``gradients`` adds ``_g`` (downhill) and ``_h`` to rows with ``_score``; ``loss`` of such rows is lower for better scores."""
    folder, model = _folder(df.sparkSession), Boosted(names, base, rate)
    flagged = df.withColumn("_held", F.coalesce(F.col(validation).cast("boolean"), F.lit(False)) if validation else F.lit(False)).withColumn("_score", F.lit(base))
    assembler, tree = VectorAssembler(inputCols=names, outputCol="_x", handleInvalid="skip"), DecisionTreeRegressor(featuresCol="_x", labelCol="_t", weightCol="_h", maxDepth=depth, maxBins=bins, seed=7)

    def keep(rows: DataFrame) -> DataFrame:
        path = f"{folder}/scores-{uuid.uuid4().hex}"
        rows.write.parquet(path)
        return df.sparkSession.read.schema(rows.schema).parquet(path)

    rows = keep(flagged)
    model.losses.append(loss(rows.where("_held")) if validation else 0.0)
    best = 0
    for k in range(rounds):
        moved = gradients(rows.where("not _held")).where("_h > 0").select(*names, "_h", (F.col("_g") / F.col("_h")).alias("_t"))
        if moved.isEmpty():
            break
        model.trees.append(_nodes(tree.fit(assembler.transform(moved)), folder))
        rows = keep(rows.withColumn("_score", F.col("_score") + F.lit(rate) * model._tree(model.trees[-1])))
        if validation:
            model.losses.append(loss(rows.where("_held")))
            if model.losses[-1] < model.losses[best]:
                best = k + 1
            elif k + 1 - best >= patience:
                break
    if validation:
        model.trees = model.trees[:best]
    return model


def regression(df: DataFrame, names: list[str], label: str = "y", **kw) -> Boosted:
    """Squared error; starts from the mean of the training rows."""
    held = F.coalesce(F.col(kw["validation"]).cast("boolean"), F.lit(False)) if kw.get("validation") else F.lit(False)
    base = df.where(~held).agg(F.avg(label)).first()[0] or 0.0
    error = lambda rows: rows.agg(F.avg((F.col(label) - F.col("_score")) ** 2)).first()[0] or 0.0
    return fit(df.where(F.col(label).isNotNull()), names, lambda rows: rows.withColumn("_g", F.col(label) - F.col("_score")).withColumn("_h", F.lit(1.0)), error, base=float(base), **kw)


def _gains(label: np.ndarray) -> np.ndarray:
    return 2.0**label - 1


def _discounts(score: np.ndarray) -> np.ndarray:
    """Discount of each row's place in order of score, equal scores in the order they come."""
    out = np.empty(len(score))
    out[np.argsort(-score, kind="stable")] = 1 / np.log2(np.arange(len(score)) + 2)
    return out


def lambdas(label: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Downhill gradient and curvature of a group's rows from all pairs of unlike labels, without holding all pairs at once."""
    g, h, gain, at = np.zeros(len(label)), np.zeros(len(label)), _gains(label), _discounts(score)
    most = (np.sort(gain)[::-1] / np.log2(np.arange(len(gain)) + 2)).sum()
    if most <= 0:
        return g, h
    for a in range(0, len(label), ROWS_AT_ONCE):
        s = slice(a, a + ROWS_AT_ONCE)
        better = label[s, None] > label[None, :]
        wrong = 1 / (1 + np.exp(np.clip(score[s, None] - score[None, :], -50, 50)))
        pull = better * wrong * np.abs((gain[s, None] - gain) * (at[s, None] - at)) / most
        bend = pull * (1 - wrong)
        g[s] += pull.sum(1)
        h[s] += bend.sum(1)
        g -= pull.sum(0)
        h += bend.sum(0)
    return g, h


def ndcg(label: np.ndarray, score: np.ndarray) -> float:
    gain = _gains(label)
    most = (np.sort(gain)[::-1] / np.log2(np.arange(len(gain)) + 2)).sum()
    return float((gain * _discounts(score)).sum() / most) if most > 0 else 1.0


def mean_ndcg(rows: DataFrame, group: str, key: str, label: str, score: str) -> float:
    """Mean over groups of the discounted gain of the order by score, as a share of the best order's."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key)
        return pd.DataFrame({"n": [ndcg(pdf[label].to_numpy(float), pdf[score].to_numpy(float))]})

    got = rows.select(group, key, label, score).groupBy(group).applyInPandas(run, "n double").agg(F.avg("n")).first()[0]
    return 0.0 if got is None else float(got)


def ranking(df: DataFrame, names: list[str], group: str, key: str = "symbol", label: str = "label", **kw) -> Boosted:
    """Order within groups: ``label`` are grades from 0, higher is better; rows without one take no part."""
    known = df.where(F.col(label).isNotNull())

    def gradients(rows: DataFrame) -> DataFrame:
        schema = T.StructType([*rows.schema.fields, T.StructField("_g", T.DoubleType()), T.StructField("_h", T.DoubleType())])

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(key, ignore_index=True)
            pdf["_g"], pdf["_h"] = lambdas(pdf[label].to_numpy(float), pdf["_score"].to_numpy(float))
            return pdf

        return rows.groupBy(group).applyInPandas(run, schema)

    return fit(known, names, gradients, lambda rows: -mean_ndcg(rows, group, key, label, "_score"), **kw)
