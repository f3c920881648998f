"""The dealt operators over the whole tables, as the driver calls them."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession, functions as F

from stowage.llm import embedding_dedup, fill_in_middle, fingerprints, hmm, merkle, mixing, pii, quality, toxicity
from stowage.llm.common import read_table, scratch_path, ship
from stowage.llm.packing import pack_documents
from stowage.llm.simhash import near_duplicates
from stowage.llm.sql import fill_in_middle_sql, merkle_sql
from stowage.llm.token_counts import count_tokens
from stowage.llm.token_store import checksums, read_tokens, write_tokens
from stowage.llm.tokens import BYTE_BPE, WORD_BPE
from stowage.session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(function):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return function(ship(configure(spark)), sf_dir)

        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return function

    return register


@query("op1_pii")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(pii.find_private(spark, read_table(spark, sf_dir, "documents")))


@query("op2_best_fit_packing")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read_table(spark, sf_dir, "documents"), WORD_BPE)


@query("op4_token_store")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = write_tokens(read_table(spark, sf_dir, "documents"), WORD_BPE, scratch_path(spark, "tokens"))
    return checksums(read_tokens(spark, folder))


@query("op5_token_counts")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(spark, read_table(spark, sf_dir, "documents"), BYTE_BPE)


@query("op10_simhash")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))


@query("op7_embedding_dedup")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(spark, read_table(spark, sf_dir, "embeddings"))


@query("op3_toxicity")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = read_table(spark, sf_dir, "labels")
    return toxicity.score_documents(spark, read_table(spark, sf_dir, "documents"), labels)


@query("op9_hidden_markov")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Texts of like length are walked side by side, which takes many of them.
    ship(spark, 8_000)
    return hmm.score_documents(spark, read_table(spark, sf_dir, "documents"))


@query("op6_fingerprints")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_edited(spark, read_table(spark, sf_dir, "documents"))


@query("op8_mixing")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(read_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "rate", "copies")


@query("op11_merkle_manifest", merkle_sql())
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(read_table(spark, sf_dir, "documents"), presented={"text": merkle.lowered_where_divisible()})


@query("op12_quality_outliers")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(read_table(spark, sf_dir, "documents"))


@query("op13_fill_in_middle", fill_in_middle_sql())
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = fill_in_middle.restore(fill_in_middle.transform(read_table(spark, sf_dir, "documents")))
    digests = [F.sha2(F.col(name).cast("binary"), 256).alias(f"{name}_sha256") for name in ("output", "restored")]
    return moved.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


QUERIES["pipeline"] = corpus_pipeline.run
