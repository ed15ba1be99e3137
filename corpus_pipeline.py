"""From raw documents to token ids: harmless, distinct and clean of benchmark items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packlake.llm import byte_bpe, common, decontaminate, simhash, toxicity


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learn from the labelled documents still there, and drop what scores as toxic.

    Null, empty and very long texts are scored like others (without known words: as the share of toxic labels); repeated
    rows all stay or all go; other columns, of any names, stay. Without labels of both classes nothing goes unless that
    share reaches the threshold. Empty tables give empty ones.
    """
    index = toxicity.Index(*toxicity.examples(docs, common.table(spark, sf_dir, "labels")))
    return toxicity.keep_harmless(docs, index)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents alike by 0.8 or more of their five-word shingles, keep that of the smallest id.

    Null and empty texts are one text; of repeated rows one stays; other columns, of any names, stay. Rows without an id
    yield to rows with one. Empty tables give empty ones.
    """
    return simhash.keep_one(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item, also with other names and numbers.

    Null and empty texts stay; repeated rows all stay or all go; other columns, of any names, stay. An empty benchmark or
    an empty table changes nothing.
    """
    return decontaminate.clean(docs, common.table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document, and whether they decode to its text: (doc_id, lang, source, n_tokens, ids, lossless).

    Null texts count as empty ones, which have no ids; repeated rows stay; other columns are not carried on. Empty tables
    give empty ones.
    """
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        rank_file = f.read()
    mine = docs.select("doc_id", "lang", "source", F.coalesce("text", F.lit("")).alias("text"))
    both = byte_bpe.round_trip(mine, rank_file, public_tokenizers.PATTERN)
    n_tokens = (F.octet_length("ids") / 4).cast("long")
    return both.select("doc_id", "lang", "source", n_tokens.alias("n_tokens"), "ids", (F.col("decoded") == F.col("text").cast("binary")).alias("lossless"))


STAGES = [
    ("toxicity", without_toxic),
    ("simhash_near_dedup", without_near_duplicates),
    ("benchmark_decontamination", without_benchmark),
    ("byte_bpe", encoded),
]

#: SQL has neither the search for neighbours nor the encoding; the tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each on all that the one before it kept."""
    docs = common.table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = common.checkpoint(docs)
    return docs
