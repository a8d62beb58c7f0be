"""Corpus pipeline: toxicity, quality, near-duplicates, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; the caller
(:func:`run`, or whoever drives ``STAGES``) writes it as Parquet and hands the
reread table to the next stage. All but the last return the columns of
``docs`` as they came. Labels are read from ``sf_dir``.

A document is a row: each is judged by its own values, whatever other rows
have its id, and a row without an id like any other. Rows without words are no
near-duplicates of anything. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside.llm import jaccard_join, packing, quality, toxicity
from quayside.llm.lookup import marked
from quayside.llm.queries import table, tokenizer_file
from quayside.llm.scratch import ship_package, stored

#: Near copies of the stage; op3's own query has four words and 85.
SHINGLE_WORDS, SHINGLE_PERCENT = 5, 80


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose CRF score stays below the threshold; scored and filtered in one pass over whole rows."""
    ship_package(spark)
    return toxicity.without_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained views keep; scored and filtered in one pass over whole rows."""
    ship_package(spark)
    return quality.good_rows(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, Jaccard 0.8).

    It is the one with the smallest id, then the smallest text hash. Rows that
    share an id but not their words stay or go by their own words. Of rows
    with the same id and text one stays. Rows without an id stay.
    """
    ship_package(spark)
    found = stored(jaccard_join.jaccard_classes(docs, n_words=SHINGLE_WORDS, percent=SHINGLE_PERCENT), "components")
    key = ["doc_id", "__text_hash"]  # a name that documents don't have
    found = found.withColumnRenamed("text_hash", "__text_hash")
    kept = docs.withColumn("__text_hash", F.xxhash64(F.col("text").cast("string")))
    copies = stored(found.where("not kept").select(*key).distinct(), "copies")
    repeated = stored(found.where("kept and n_shingles > 0 and doc_id is not null").groupBy(*key).count().where("count > 1").select(*key), "repeated")
    # only rows that may be among these are joined, and shuffled, by the key
    kept = marked(kept, copies.unionByName(repeated), key, "__near")
    others = kept.where("not __near").select(docs.columns)
    kept = kept.where("__near").join(copies, key, "left_anti")
    once = kept.join(repeated, key, "left_semi")
    row = F.struct(*docs.columns)
    first = once.groupBy(*key).agg(F.min_by(row, F.to_json(row)).alias("row")).select("row.*")
    return others.unionByName(kept.join(repeated, key, "left_anti").select(docs.columns)).unionByName(first)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces of the documents that are left."""
    ship_package(spark)
    return packing.best_fit_packing(docs, tokenizer_file("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("quality_classifier", quality_stage),
    ("ngram_jaccard_join", near_duplicate_stage),
    ("best_fit_packing", packing_stage),
]

#: Fitted models and a tokenizer decide the rows, which SQL cannot express; tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage's output is written to shared scratch and read back."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
