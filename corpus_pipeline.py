"""A training corpus from the documents: each stage reads what the stage before it has written.

Toxic documents go, one document of each group of near-duplicates stays, personal data is masked, sources are mixed to
their target weights, and the result is packed into sequences. All stages but the last return the columns of documents.

What holds for every stage: a null text is taken as empty and stays null where texts are kept, texts of any length are taken
whole, null ids are ids like others, repeated rows are rows of their own unless the stage says otherwise, further columns
pass through whatever their names, and an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from stowage.llm import mixing, pii, simhash, toxicity
from stowage.llm.common import read_table, scratch_path, ship, text_rows
from stowage.llm.packing import pack_documents
from stowage.llm.tokens import WORD_BPE
from stowage.session import configure

# Words of a shingle of the near-duplicate stage, and the bits of 64 within which fingerprints name likely pairs. Prefixes
# name all others, so the bits decide about time and about no link.
WORDS = 5
MAX_BITS = 3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold, by a classifier fitted on the labelled ones of them. Equal texts stay or go
    together; without labels of both kinds all stay."""
    ship(configure(spark))
    labels = read_table(spark, sf_dir, "labels")
    return toxicity.reject(spark, docs, toxicity.learn(text_rows(docs), labels))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of near-duplicates, which are texts of similar sets of shingles.

    SimHash names likely pairs and an exact join of the sets' prefixes all others; the texts of a pair decide. Repeated rows
    are near-duplicates, as are all texts without words; null ids come after all others.
    """
    ship(configure(spark))
    return simhash.keep_one(docs, WORDS, MAX_BITS)


def mask_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind and the number of characters as it is then."""
    ship(configure(spark))
    hidden = pii.mask(spark, docs)
    return hidden.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all, once or twice. A null source is a source of its own."""
    ship(configure(spark))
    return mixing.apply(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, repeated ones too, with their places in sequences; an empty text is its end alone."""
    ship(configure(spark))
    return pack_documents(docs, WORD_BPE)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("pii", mask_private),
    ("mixing", mix_sources),
    ("best_fit_packing", pack),
]

# Classifiers, tries and packing are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents of ``sf_dir``, each result written to the shared folder and read again."""
    docs = read_table(configure(spark), sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
