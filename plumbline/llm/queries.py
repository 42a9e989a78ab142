"""One query for each operator, over its whole table, and SQL where it can be said in SQL.

Operators are imported by their queries, so that a missing library concerns its own alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import table, tokenizer_file


def op1_mtree_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm import mtree

    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return mtree.top_k(vectors, vectors.where(F.col("vec_id") % 100 == 0))


def op2_sentencepiece_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm import sentencepiece_dropout

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sentencepiece_dropout.encode(docs, tokenizer_file("piece_bpe_32k.model"), carry=("doc_id",))


def op3_zstd_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm import language

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = language.held_out(F.col("doc_id"))
    known = language.learn(docs.where(~out))
    return language.predict(docs.select("doc_id", "text", out.alias("held_out")), known, carry=("doc_id", "held_out"))


def op4_wavelet_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm import wavelet

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return wavelet.round_trip(docs, tokenizer_file("word_bpe_49k.json"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm import secrets

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return secrets.scan(docs, tokenizer_file("byte_bpe_50k.tiktoken"), carry=("doc_id",))


def op6_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm import url_rules

    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_rules.judge(pages).select("page.page_id", "host", "path", "rule", "pattern_rule", "verdict")


def op7_simhash_vp_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm import simhash

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return simhash.classes(docs).select("doc_id", simhash.hex_digits().alias("fingerprint"), "component_id")


def op8_pareto_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm import mixing

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    made = mixing.copies(docs.select("doc_id", "source", "text"))
    return made.select("doc.doc_id", "size", "source_size", "target", (F.col("n_copies") * F.col("size")).alias("taken"))


def op9_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm import pii

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.detect(docs, carry=("doc_id",))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm import quality

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return quality.judge(docs, carry=("doc_id",))


def op11_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm import warc

    return warc.listing(warc.archive(table(spark, sf_dir, "pages").select("page_id", "url", "html")))


def op12_ball_tree_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm import hard_negatives

    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows, F.col("vec_id") % 50 == 0, label=label)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm import filter_audit

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return filter_audit.audit(docs, table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"))


def queries() -> dict:
    return {
        "op1_mtree_top_k": op1_mtree_top_k,
        "op2_sentencepiece_dropout": op2_sentencepiece_dropout,
        "op3_zstd_language": op3_zstd_language,
        "op4_wavelet_shards": op4_wavelet_shards,
        "op5_secret_scan": op5_secret_scan,
        "op6_url_rules": op6_url_rules,
        "op7_simhash_vp_trees": op7_simhash_vp_trees,
        "op8_pareto_mixing": op8_pareto_mixing,
        "op9_disclosure": op9_disclosure,
        "op10_quality_rules": op10_quality_rules,
        "op11_warc_archive": op11_warc_archive,
        "op12_ball_tree_negatives": op12_ball_tree_negatives,
        "op13_filter_audit": op13_filter_audit,
    }


def oracle_sql() -> dict[str, str]:
    from plumbline.llm import oracles

    return oracles.SQL
