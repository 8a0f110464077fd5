"""From raw documents to token ids: quality rules, line dedup, near-duplicate removal, mixing, BPE.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but
the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plinth.llm import byte_bpe, line_runs, mixing, ngram_join, quality_votes
from plinth.llm.common import documents, staged

# Embeds an EM fit, a seeded knapsack choice and a tokenizer: checked against brute force in tests/llm.
ORACLE_SQL = None

# The stage's own figures; op2_ngram_join keeps those of its contract (4 words, 85 %).
NEAR_GRAM, NEAR_PERCENT = 5, 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the voted quality rules keep."""
    return quality_votes.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that a smaller doc_id holds; n_chars follows the text."""
    out = line_runs.dedup_lines(docs, counts=("lines_before", "lines_dropped"))
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest doc_id of each group that links by 5-word shingles, Jaccard 80 % or more."""
    return ngram_join.keep_one(docs, gram=NEAR_GRAM, percent=NEAR_PERCENT)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them."""
    return mixing.mix(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per document of the mixture: its ids, and whether decoding gives the text back."""
    vocabulary = byte_bpe.Vocabulary.read(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    encoded = byte_bpe.encode(docs.withColumn("both", F.struct("doc_id", "source")), vocabulary, public_tokenizers.PATTERN, id_col="both", digest=True)
    return encoded.select("both.doc_id", "both.source", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded_sha256")


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates),
          ("source_mix", source_mix), ("token_ids", token_ids)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
