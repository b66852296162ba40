"""A corpus pipeline: documents to packed training sequences, a table between any two stages.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage
before it kept. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerfold.llm import dedup_exact, dedup_minhash, mixing, packing, quality
from ledgerfold.llm.queries import WEIGHTS, domain_of
from ledgerfold.llm.scratch import deleted, stored_at, temporary
from ledgerfold.llm.tokens import public_tokenizer
from ledgerfold.sources.shipping import ship

#: Share of the tokens that are left when sources are mixed, in percent.
MIXED_PERCENT = 80


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it is fitted on labelled documents of docs.

    Null and empty texts, null sources and languages are judged like others (as empty
    ones); a probability at the threshold is kept; rows that repeat an id are each judged
    by their own text. An empty table gives none. All columns stay, whatever their names.
    """
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest doc_id.

    A null text is an empty one, a null id is the smallest. Of rows that are equal in
    both, one stays, that whose columns as JSON come first. An empty table gives none; all columns stay.
    """
    return dedup_exact.keep_first_copies(docs)


def distinct_enough(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-duplicates (five-word shingles, similarity 0.8 or more) the document with the smallest doc_id.

    Texts without words, null ones too, are near nothing and stay. Rows that repeat an id stay or
    go together: they stay if one of them does. An empty table gives none; all columns stay.
    """
    return dedup_minhash.keep_one_of_each(docs, words=5, percent=80)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A seeded selection whose sources have target weights.

    Null sources and languages are names of their own, texts without words stay, rows
    that repeat an id (null ids too) are drawn together with the prefix. An empty table gives none; all columns stay.
    """
    return mixing.keep_drawn(docs, domain_of(F.col("source")), WEIGHTS, MIXED_PERCENT)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens.

    A null or empty text is its end token, every row a document of its own, whatever its id. An empty table gives none.
    """
    return packing.packed(docs, public_tokenizer(), 2048, 1).drop("ids").withColumnRenamed("id", "doc_id")


def _shipped(stage):
    return lambda spark, docs, sf_dir: stage(ship(spark), docs, sf_dir)


STAGES = [
    ("quality classifier", _shipped(good_quality)),
    ("exact dedup", _shipped(distinct_texts)),
    ("MinHash near-dedup", _shipped(distinct_enough)),
    ("mixing sources to target weights", _shipped(mixed)),
    ("packing", _shipped(packed)),
]

#: SQL can't express a classifier that is fitted here, sketches or a tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents.

    Each stage's result is a table. What a stage stored on the way is deleted at its
    end, and the table that it worked on when its own is written, so that no more than
    two of them are kept at a time; the last one stays, for the caller to read.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES:
        with temporary(spark):
            docs, path = stored_at(stage(spark, docs, sf_dir), lasting=True)
        if before is not None:
            deleted(spark, before)
        before = path
    return docs
