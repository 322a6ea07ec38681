"""A corpus from documents: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import decontaminate, passages, sentencepiece, simhash, toxicity
from graphloom.llm._shared import materialize
from graphloom.llm.queries import MODEL_FILE, table


def _measured(docs: DataFrame) -> DataFrame:
    """n_chars follows the text."""
    return docs.withColumn("n_chars", F.length("text").cast("bigint")).select(docs.columns) if "n_chars" in docs.columns else docs


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the tagger takes for toxic go; the rest stay as they are.

    Each row is judged by its own text. Null and empty texts, null and repeated ids stay like any clean
    row; without labels of both classes nothing is learnt and nothing goes.
    """
    labels = table(spark, sf_dir, "labels")
    field = toxicity.fit(docs, labels)
    return toxicity.keep_clean(docs, field)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five words a shingle, a similarity of 0.8 or more) the smallest doc_id stays.

    One row of each group: rows are told by id and text, null ids come last, and null and empty texts are
    one group (see simhash.without_near_copies).
    """
    return simhash.without_near_copies(docs, words_per_shingle=5, at_least=0.8)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document holds are cut out; every row stays.

    Rows with a null id, null and empty texts stay as they are; texts that share an id are documents of
    their own (see passages.without_repeats).
    """
    return _measured(passages.without_repeats(docs))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds a passage of a benchmark item go, whatever their id; null and empty texts stay."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) of every row left; a null text has no tokens."""
    return sentencepiece.encode(docs, MODEL_FILE)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("substring_dedup", cut_repeats),
    ("benchmark_decontamination", drop_leaks),
    ("sentencepiece", tokenize),
]

#: The stages learn, hash and align: SQL can't express them, and tests hold them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
