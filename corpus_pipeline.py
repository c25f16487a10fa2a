"""Corpus pipeline: language ID, line dedup, near-dedup, decontamination, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, written as Parquet and reread as the next stage's docs;
all but the last return the columns of `documents`. Stages decide on rows, not on ids: null and repeated doc_ids are
documents of their own wherever their texts differ, and of rows that are equal in both one stays in near-dedup. Other
columns than those of `documents` are left behind; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import decontamination, language_id, line_dedup, minhash, packing, queries
from lectern.llm.common import materialize, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
MIN_LANGUAGE_SHARE = 0.5


def _text_hash() -> Column:
    text = F.coalesce(F.col("text"), F.lit(""))
    return F.xxhash64(text, F.length(text))


def _with(docs: DataFrame, decided: DataFrame) -> DataFrame:
    """docs whose doc_id and text are those of a row of decided (doc_id, text_hash)."""
    keyed = docs.withColumn("text_hash", _text_hash())
    rows = decided.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    return keyed.join(rows, F.equal_null("doc_id", "_id") & (F.col("text_hash") == F.col("_hash")), "left_semi").select(*COLUMNS)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without letters and those in which no language holds half of the letters; sets lang as predicted."""
    model = language_id.train(docs.where(~language_id.held_out()))
    found = language_id.identify(docs, model, carry=("source", "n_chars", "text"))
    kept = found.where((F.col("lang_pred") != language_id.UND) & (F.col("score") >= MIN_LANGUAGE_SHARE))
    return kept.select("doc_id", "text", F.col("lang_pred").alias("lang"), "source", "n_chars")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops recurring template lines; n_chars follows the text."""
    kept = line_dedup.line_dedup(docs.select(*COLUMNS))
    return kept.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one of the smallest doc_id; of rows equal in doc_id and text one stays."""
    # nodes are numbers of distinct rows: in order of doc_id, then of the text's hash, nulls last
    keyed = docs.select(*COLUMNS, _text_hash().alias("text_hash"))
    distinct = keyed.groupBy("doc_id", "text_hash").agg(F.count("*").alias("n"))
    odd = materialize(
        distinct.groupBy("doc_id").agg(
            F.count("*").alias("texts"), F.max("n").alias("n")
        ).where("texts > 1 or n > 1 or doc_id is null").select("doc_id"),
        "odd-ids",
    )
    if odd.isEmpty():
        kept = minhash.near_duplicates(docs).where("kept")
        return docs.join(kept.select(F.col("doc_id").alias("_id")), F.col("doc_id") == F.col("_id"), "left_semi").select(*COLUMNS)
    node = F.xxhash64("doc_id", "text_hash")
    nodes = materialize(
        minhash.near_duplicates(keyed.select(node.alias("doc_id"), "text")).select(
            F.col("doc_id").alias("node"), F.col("component_id").alias("component")
        ).distinct(),
        "nodes",
    )
    named = distinct.withColumn("node", node).join(nodes, "node")
    stays = named.groupBy("component").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "text_hash")).alias("r")
    ).select("r.doc_id", "r.text_hash")
    chosen = materialize(_with(docs, stays), "chosen")
    # repeated rows: few, as only ids that were found odd can have them
    on = F.equal_null(chosen["doc_id"], odd["doc_id"])
    once = chosen.join(odd, on, "left_semi").withColumn("text_hash", _text_hash()).dropDuplicates(["doc_id", "text_hash"]).select(*COLUMNS)
    return chosen.join(odd, on, "left_anti").select(*COLUMNS).unionByName(once)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the benchmark contaminates."""
    return _with(docs, decontamination.judged(docs, table(spark, sf_dir, "benchmark")).where("not contaminated"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences."""
    return packing.best_fit_packing(docs, queries.tokenizer_path("byte_bpe_50k.json"), queries.tokenizer_path("byte_bpe_50k.tiktoken"))


STAGES = [
    ("language ID", language),
    ("line dedup", lines),
    ("near-dedup", near_duplicates),
    ("decontamination", decontaminated),
    ("packing", packed),
]
ORACLE_SQL = None  # language models, shingle components and tokenizers are not SQL; tests hold the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
