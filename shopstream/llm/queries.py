"""The registered queries of this package: thin forms that read whole tables of a data folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sha256_of_ids(ids) -> Column:
    return F.sha2(F.array_join(ids, ","), 256)


def op1_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .urls import filter_urls

    rules = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]
    return filter_urls(_table(spark, sf_dir, "pages"), rules)


def op2_rabitq(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vectors import near_vectors

    return near_vectors(_table(spark, sf_dir, "embeddings"))


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import held_out, learn, predict

    docs = _table(spark, sf_dir, "documents")
    found = predict(docs, learn(docs.where(~held_out())))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op4_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lines import dedupe_lines

    found = dedupe_lines(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_exact", "n_near", F.sha2("kept", 256).alias("kept_sha256"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe import encode

    return encode(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, digest=True)


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan

    found = scan(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score")


def op7_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring import dedupe

    return dedupe(_table(spark, sf_dir, "documents"), digest=True)


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contamination

    found = contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), _sha256_of_ids("items").alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"), percent=85)


def op10_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .resample import select

    good = _table(spark, sf_dir, "labels").where("quality = 1 and toxic = 0")
    return select(_table(spark, sf_dir, "documents"), good)


def op11_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pivots import top_products

    return top_products(_table(spark, sf_dir, "embeddings"), 5, every=50)


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .conversations import damage, repair

    return repair(damage(_table(spark, sf_dir, "conversations")), _table(spark, sf_dir, "conversations"))


def op13_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ranked import search

    return search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), 10)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_urls": op1_urls,
        "op2_rabitq": op2_rabitq,
        "op3_langid": op3_langid,
        "op4_lines": op4_lines,
        "op4_every_line": op4_lines,
        "op5_bpe": op5_bpe,
        "op6_licenses": op6_licenses,
        "op7_substring": op7_substring,
        "op8_decontaminate": op8_decontaminate,
        "op9_minhash": op9_minhash,
        "op10_resample": op10_resample,
        "op11_pivots": op11_pivots,
        "op12_repair": op12_repair,
        "op13_lexical": op13_lexical,
    }


def oracle_sql() -> dict[str, str]:
    from .sql import ORACLES

    return ORACLES
