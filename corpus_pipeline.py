"""A training corpus from raw documents: five stages, each over all that the one before kept.

Toxic documents go, then copies, then near copies; the sources are mixed to tempered weights, and the mix is encoded.
Each stage is written as Parquet and read again, in the shared folder of the session.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tilerain.llm import exact_dedup, mixing, pair_bpe, simhash, toxicity
from tilerain.llm.common import stored, table

#: Most passes over a source in the mix for one over the largest source.
PASSES = 2.0


def toxic_removed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator doesn't reject."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def copies_removed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the smallest id."""
    return exact_dedup.without_copies(docs)


def near_copies_removed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies (five-word shingles, similarity of 0.8 or more), the document with the smallest id."""
    return simhash.one_of_each_group(docs)


def sources_mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them. The budget lets the largest source pass once, so no document is lost;
    smaller ones pass up to PASSES times. A document that is taken twice is there twice."""
    return mixing.mixed(docs, passes=PASSES)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each document of the mix."""
    return pair_bpe.round_trip_digests(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxic_removed), ("exact dedup", copies_removed), ("SimHash near-dedup", near_copies_removed),
    ("mixing sources to target weights", sources_mixed), ("BPE encoding and decoding", encoded)]

#: Toxicity scores, fingerprints, the search for the exponent and the merges are no SQL; brute force checks them in tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over the documents of a folder."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
