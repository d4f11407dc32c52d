"""The registered queries of this package."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gaugework.llm import (
    divergence,
    fingerprints,
    forest,
    harmonic,
    merkle,
    mixing,
    secrets,
    shards,
    simhash,
    spans,
    token_files,
    toxicity,
    vptree,
)
from gaugework.llm.tables import read
from gaugework.session import fresh_dir


def op1_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's toxicity, learned from the labels that are not held out."""
    return toxicity.scored_documents(read(spark, folder, "documents"), read(spark, folder, "labels"))


def op2_sentence_spans(spark: SparkSession, folder: str) -> DataFrame:
    """Every document without the sentences of spans that stand somewhere before."""
    return spans.without_repeats(read(spark, folder, "documents"))


def op3_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's ids written as flat files and read back."""
    out = fresh_dir(spark, "token-files")
    token_files.write_token_files(read(spark, folder, "documents"), out)
    return token_files.read_token_files(spark, out)


def op4_imatch(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprints of every text and of its edited text."""
    return fingerprints.fingerprint_edits(read(spark, folder, "documents"))


def op5_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    return simhash.near_duplicates(read(spark, folder, "documents"))


def op6_pareto_mix(spark: SparkSession, folder: str) -> DataFrame:
    """What a mix of sources by weight takes of every document."""
    return mixing.mix_report(read(spark, folder, "documents"))


def op7_vantage_points(spark: SparkSession, folder: str) -> DataFrame:
    """The ten nearest vectors of every hundredth one."""
    vectors = read(spark, folder, "embeddings")
    return vptree.nearest(vectors, vectors.where("vec_id % 100 = 0"))


def op8_hypergeometric_shards(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's place in 24 shards whose row counts differ by one at most."""
    return shards.shard_documents(read(spark, folder, "documents"))


def op9_harmonic_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Every piece of every document in sequences of 2,048 ids."""
    return harmonic.pack(read(spark, folder, "documents"))


def op10_secret_network(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets in every document, by patterns and by the network."""
    return secrets.scan_documents(read(spark, folder, "documents"))


def op11_projection_forest(spark: SparkSession, folder: str) -> DataFrame:
    """Links and component of every vector, by cosine within its label."""
    return forest.near_duplicates(read(spark, folder, "embeddings"))


def op12_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's leaf, proof and folded root; half of the documents without their line feeds."""
    return merkle.tampered_manifest(read(spark, folder, "documents"))


def op13_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    """Distances of the sources of each language, and the terms that stand out in each."""
    return divergence.divergence(read(spark, folder, "documents"))


QUERIES = {
    query.__name__: query
    for query in (
        op1_toxicity,
        op2_sentence_spans,
        op3_token_files,
        op4_imatch,
        op5_simhash,
        op6_pareto_mix,
        op7_vantage_points,
        op8_hypergeometric_shards,
        op9_harmonic_packing,
        op10_secret_network,
        op11_projection_forest,
        op12_merkle_manifest,
        op13_source_divergence,
    )
}
ORACLES: dict[str, str] = {
    op12_merkle_manifest.__name__: merkle.SQL,
    op13_source_divergence.__name__: divergence.SQL,
}
