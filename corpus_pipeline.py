"""The training-data pipeline: five stages, each written as Parquet before the next reads it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import mixing, pii, quality, sentencepiece_dropout, simhash
from plumbline.llm.common import table, tokenizer_file, written


#: Words that the last stage keeps in a task: the stages before it leave it little memory.
KNOWN_WORDS = 1 << 16


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a base rule, or whose source is rejected, go. A null or empty
    text fails; a null source is a source; repeated rows are judged alike and all stay or
    go; an empty table stays empty; all columns pass, whatever their names."""
    return quality.kept(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays (five words, similarity 0.8): that
    of the smallest id, null ids last. Repeated rows are one class, texts without words
    another; rows of one id and different texts are told apart; an empty table stays empty;
    all columns pass."""
    return simhash.representatives(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Entities and the terms that disclose them are replaced in the texts, and n_chars
    follows. No row goes; a null text stays null; repeated rows are treated alike; other
    columns pass."""
    return pii.sanitised(docs, length="n_chars" if "n_chars" in docs.columns else None)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document stands as often as the mix takes it, three times at most, or not at
    all; a text without words is not taken. Null is a source, the last; rows that repeat an
    id are taken together; all columns pass."""
    return mixing.mixed(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The texts as SentencePiece ids with merge dropout, other ids for each copy that the
    mix takes. A null or empty text has none; a table without the columns carried along
    gives the others; an empty table gives an empty result."""
    carry = tuple(c for c in ("doc_id", "lang", "source") if c in docs.columns)
    return sentencepiece_dropout.encode(docs, tokenizer_file("piece_bpe_32k.model"), carry=carry, copies=True, most=KNOWN_WORDS)


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_duplicates),
    ("PII", personal_data),
    ("mixing sources to target weights", source_mix),
    ("SentencePiece encoding and decoding", token_ids),
]

#: The stages hash, search and tokenize in ways that SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        docs = written(stage(spark, docs, sf_dir), f"stage{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
