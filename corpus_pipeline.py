"""A pipeline from raw documents to token ids.

STAGES run one after another over `documents`, each over all that the one before kept; the last returns ids in place of
mixing's documents. run() does the same and deletes each stage's tables once
the next one's result is written.

Every stage takes nulls in any column, empty and very long texts, repeated rows, ties, empty tables and further columns,
as its docstring says; all but the last return the columns that they were given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm import bpe, exact_dedup, mixing, partenum
from loomline.llm.common import cut, drop_scratch, prefix, scratch_path, scratch_scope, vocabulary
from loomline.llm.queries import THRESHOLD, documents, quality_scores


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject. A null text is scored as an empty one; repeated rows share their score and fate; without labels all stay."""
    aside = {c: prefix(*docs.columns) + c for c in docs.columns if c.lower() == "score"}  # a score of the caller's own
    scored = quality_scores(spark, docs.withColumnsRenamed(aside), sf_dir, [aside.get(c, c) for c in docs.columns])
    return scored.where(F.col("score") >= THRESHOLD).select(*[F.col(aside.get(c, c)).alias(c) for c in docs.columns])


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id; null counts as empty, a null id is smaller than any, of rows that share id and text one stays."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links by five words and 0.8 connect the one with the smallest id; three words and 0.9 are op5's alone. Documents without words, and those with a null id, link with nothing and stay; rows that share an id stay or go together."""
    own = prefix(*docs.columns) + "stay"
    stay = partenum.components(docs, k=5, num=80).where("component_id <=> doc_id").select(F.col("doc_id").alias(own)).distinct()
    return docs.join(stay, F.col("doc_id").eqNullSafe(F.col(own)), "left_semi").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them: those without words as their source's rate says, a null source as a source of its own; rows that share id and source share their fate."""
    return mixing.emit(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each document that the mix holds, a row each; a null or empty text has none."""
    ids = bpe.encode(docs, vocabulary("byte_bpe_multi_50k.tiktoken"))
    return ids.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [("quality", keep_quality), ("exact_dedup", drop_copies), ("ngram_join", drop_near_copies), ("mix", mix_sources), ("bpe", encode)]
#: Neither the classifier nor the tokenizer can be said in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = documents(spark, sf_dir), None
    for name, stage in STAGES[:-1]:
        with scratch_scope(spark) as keep:  # what a stage left behind goes when its result is written, and the result before it
            path = scratch_path(spark, name)
            keep.add(path)
            docs = cut(stage(spark, docs, sf_dir), name, path)
        if last:
            drop_scratch(spark, last)
        last = path
    return STAGES[-1][1](spark, docs, sf_dir)
