"""The registered queries of this subpackage, on the synthetic tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from .scratch import ship_package

LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
LLM_ORACLE: dict[str, str] = {}


def register(name: str):
    def deco(fn):
        @wraps(fn)
        def query(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return fn(spark, sf_dir)

        LLM_QUERIES[name] = query
        return query
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


@register("op6_token_files")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .scratch import scratch_path
    from .token_files import read_token_files, write_token_files

    path = scratch_path(spark, "token_files")
    write_token_files(table(spark, sf_dir, "documents"), path, tokenizer_file("byte_bpe_50k.json"))
    return read_token_files(spark, path)


@register("op4_best_fit_packing")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import best_fit_packing

    return best_fit_packing(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


@register("op9_toxicity")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score_held_out

    return (score_held_out(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
            .select("doc_id", "held_out", "score", "predicted", "n_toxic_tokens"))


@register("op10_language_id")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import identify_held_out

    return identify_held_out(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.tiktoken"))


@register("op2_quality_classifier")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import score, train

    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))


@register("op3_jaccard_join")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"))


@register("op7_near_vectors")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_vectors import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"))


@register("op8_license_scan")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license_scan import MARKS, scan

    return scan(table(spark, sf_dir, "documents"), marks=MARKS)


def _op8_oracle() -> str:
    from .license_scan import MARKS, oracle_sql

    return oracle_sql(marks=MARKS)


LLM_ORACLE["op8_license_scan"] = _op8_oracle()


@register("op1_sentencepiece")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sentencepiece_lattice import decode, encode

    from pyspark.sql import functions as F

    model = tokenizer_file("piece_bpe_32k.model")
    decoded = decode(encode(table(spark, sf_dir, "documents"), model), model)
    return decoded.select("doc_id", "n_pieces", "ids_crc32", F.octet_length("text").cast("bigint").alias("decoded_bytes"),
                          F.xxhash64("text").alias("decoded_hash"))


@register("op5_bm25_search")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .bm25 import search

    docs = table(spark, sf_dir, "documents")
    return search(docs, docs.where(F.col("doc_id") % 20 == 0).withColumnRenamed("doc_id", "query_id"))


def _op5_oracle() -> str:
    from .bm25 import oracle_sql

    return oracle_sql()


LLM_ORACLE["op5_bm25_search"] = _op5_oracle()


@register("op11_conversation_repair")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .conversation_repair import damaged, repair

    return repair(damaged(table(spark, sf_dir, "conversations")))


@register("op12_periodic_runs")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .periodic_runs import run_digests

    return run_digests(table(spark, sf_dir, "documents"))


@register("op13_source_mix")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .source_mix import mix

    return mix(table(spark, sf_dir, "documents")).select("doc_id", "source", "size", "source_size", "target", "taken")


def _op13_oracle() -> str:
    from .source_mix import oracle_sql

    return oracle_sql()


LLM_ORACLE["op13_source_mix"] = _op13_oracle()
