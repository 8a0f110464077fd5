"""The registered queries of this package: name -> (function, oracle SQL or None)."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plinth.llm import (byte_bpe, embedding_forest, licenses, line_runs, mixing, ngram_join, periodic_runs, phrases, piece_bpe, quality_votes,
                        sharding, token_files, warc)
from plinth.llm.common import documents
from plinth.llm.oracles import ORACLES  # noqa: F401

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.tiktoken")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")
SHARD_BYTES = 1 << 20
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(documents(spark, sf_dir))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(documents(spark, sf_dir))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = warc.write_archive(documents(spark, sf_dir, "pages"))
    return warc.page_digests(warc.captures(warc.read_records(spark, path)))


def op4_extendible_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(documents(spark, sf_dir), SHARD_BYTES)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return line_runs.dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(WORD_BPE, encoding="utf-8") as file:
        manifest = token_files.write_tokens(documents(spark, sf_dir), file.read(), end_id=1)
    return token_files.read_tokens(manifest)


def op7_embedding_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_forest.near_vectors(documents(spark, sf_dir, "embeddings"))


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = byte_bpe.Vocabulary.read(BYTE_BPE)
    return byte_bpe.digests(byte_bpe.encode(documents(spark, sf_dir), vocabulary, public_tokenizers.PATTERN), vocabulary)


def op10_quality_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_votes.judge(documents(spark, sf_dir))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return periodic_runs.digests(periodic_runs.find_runs(periodic_runs.with_planted_runs(docs)))


def op12_piece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = piece_bpe.Model.read(PIECE_BPE)
    return piece_bpe.digests(piece_bpe.encode(documents(spark, sf_dir), model), model)


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(documents(spark, sf_dir))


QUERIES = {name: fn for name, fn in list(globals().items()) if name.startswith("op") and name[2].isdigit()}
