"""A corpus pipeline: five stages, each an operator of ``loadstats.llm`` whose decisions take effect.

1. language ID: documents in no known language go.
2. n-gram Jaccard join: one document of each group of near copies stays, the smallest id.
3. substring dedup: words in 50-word passages that an earlier document has are cut out.
4. mixing: the documents that weighted fair queueing takes, as often as it takes them.
5. SentencePiece: the ids of each text, checked by decoding them.

Each stage gets its predecessor's rows, written as Parquet and read again; all but the
last return the columns of documents.

* NULL or letterless texts go in stage 1. A text that stage 3 empties stays, empty, until
  the mix, which takes documents with words only.
* NULL ids pass all stages and are not compared in 2 and 3; repeated ids are one document
  in 2. Columns beside doc_id, text, lang, source and n_chars pass through unread.
* An empty table gives an empty result in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loadstats.llm import jaccard_join, language_id, mixing, sentencepiece_codec, substring_dedup
from loadstats.llm.common import n_words, saved, table
from loadstats.llm.queries import tokenizer_path

MIN_SCORE = 0.3     # of documents in a learned language none scored below 0.38, random letters reached 0.28

#: Rank-order profiles and N-best segmentation have no SQL form; tests hold the rows
#: against a brute-force version.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    profiles = language_id.learn_profiles(docs)
    judged = language_id.identify(docs, profiles, pred="_lang_pred", score="_lang_score")
    known = (F.col("_lang_pred") != language_id.UNKNOWN) & (F.col("_lang_score") >= MIN_SCORE)
    return judged.where(known).select(*[f"`{c}`" for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.one_of_each(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    less = substring_dedup.without_spans(docs, substring_dedup.repeated_spans(docs))
    if "n_chars" not in docs.columns:
        return less
    return less.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"]))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs, n_words(F.col("text")))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = tokenizer_path("piece_bpe_32k.model")
    coded = sentencepiece_codec.encode(docs.select("doc_id", "source", "text"), model)
    coded = sentencepiece_codec.decode(coded, model)
    return coded.select("doc_id", "source", F.size("ids").cast("long").alias("n_pieces"), "ids",
                        F.round(F.get("scores", F.lit(0)), 6).alias("best_score"),
                        F.size("scores").cast("long").alias("n_best"),
                        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))


STAGES = [
    ("op2_language_id", identify_language),
    ("op3_jaccard_join", drop_near_copies),
    ("op8_substring_dedup", cut_repeated_passages),
    ("op7_mixing", mix_sources),
    ("op1_sentencepiece", encode_pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline_{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
