"""The registered queries of this subpackage: thin digests of what the operators return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file; every machine has the package."""
    import public_tokenizers
    return public_tokenizers.path(name)


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@_query
def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import quality_rules_counted
    trusted = table(spark, sf_dir, "labels").where("quality = 1")
    return quality_rules_counted(table(spark, sf_dir, "documents"), trusted)


@_query
def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard_digest
    return shard_digest(table(spark, sf_dir, "documents"))


@_query
def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import n_words
    from .mixing import mix
    out = mix(table(spark, sf_dir, "documents"), n_words(F.col("text")))
    return out.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


def _op7_sql() -> str:
    from .mixing import SQL
    return SQL


ORACLES["op7_mixing"] = _op7_sql()


@_query
def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_files import read_token_files, write_token_files
    return read_token_files(write_token_files(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json")))


@_query
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import language_digest
    return language_digest(table(spark, sf_dir, "documents"))


@_query
def op10_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_cnn import quality_digest
    return quality_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@_query
def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import jaccard_components
    return jaccard_components(table(spark, sf_dir, "documents"))


@_query
def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import remove_spans, repeated_spans
    docs = table(spark, sf_dir, "documents")
    return remove_spans(docs, repeated_spans(docs)).select("doc_id", "n_words", "n_removed", "kept_sha256")


@_query
def op4_spherical_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .spherical_caps import near_duplicates
    return near_duplicates(table(spark, sf_dir, "embeddings"))


@_query
def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sentencepiece_codec import codec_digest
    return codec_digest(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


@_query
def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_alignment import alignment_digest
    return alignment_digest(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"),
                            tokenizer_path("piece_bpe_32k.model"))


@_query
def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fill_in_middle import fim_digest
    return fim_digest(table(spark, sf_dir, "documents"))


def _op12_sql() -> str:
    from .fill_in_middle import SQL
    return SQL


ORACLES["op12_fill_in_middle"] = _op12_sql()


@_query
def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity_digest
    return toxicity_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
