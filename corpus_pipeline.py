"""From raw documents to token ids: five stages, each on all that its predecessor kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet in the shared folder and reads it back
as the next stage's documents. All but the last return the columns of ``documents``.

Edge cases: a null or empty text is scored like any other, stays in the near-duplicate stage, is not cut, and ends as null ids or no ids;
a row with a null doc_id is in no class and is not cut; repeated rows of a kept doc_id stay, and are visited and encoded as often as
they come; of equal classes and passages the smallest doc_id keeps its text; a null source is a source of its own; very long texts go
through whole; columns beyond those of ``documents`` are carried along, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidesignal.llm import chunks, gam, jaccard, mixing, pieces
from tidesignal.llm.common import materialize, table
from tidesignal.llm.queries import piece_model


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model accepts."""
    return gam.reject(docs, gam.fit(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class at a Jaccard similarity of 0.8 over five-word shingles."""
    return jaccard.keep_one(docs, n=5, num=4, den=5)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its text without passages that an earlier document has; ``n_chars`` follows the text."""
    return chunks.dedup(docs, report=False).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at tempered weights: each document once at least, those of raised sources again in part."""
    return mixing.mix(docs, entropy_gain=0.25, max_epochs=4.0, with_row=True).select("row.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens of every document of the mixture."""
    return pieces.encode_texts(docs, piece_model())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("passages", passages),
    ("mixture", mixture),
    ("tokens", tokens),
]

#: Trained models, components and piece lattices have no SQL form; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
