"""The registered queries and the pipeline over whole small tables, against brute force or oracle SQL."""

import glob

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from plinth.llm import quality_votes
from plinth.llm.common import documents
from tests.llm import brute
from tools.compare import compare, oracle_connection

SF = "/root/testdata/sf0.001"
NAMES = {int(n[2:].split("_")[0]): n for n in entry.queries() if n.startswith("op") and n[2].isdigit()}


def table(name, columns):
    return duckdb.sql(f"SELECT {columns} FROM '{SF}/{name}.parquet'").fetchall()


def rows(df, columns):
    return sorted(map(tuple, df.select(*columns.split()).collect()), key=repr)


EXPECTED = {
    2: ("doc_id n_shingles component_id", lambda: brute.components(table("documents", "doc_id, text"))),
    3: ("page_id payload_bytes payload_digest record_type refers_to", lambda: brute.warc(table("pages", "page_id, html"))),
    6: ("doc_id start n_tokens ids_crc32", lambda: brute.token_rows(table("documents", "doc_id, text"))),
    9: ("doc_id n_tokens ids_sha256 decoded_sha256", lambda: brute.bpe(table("documents", "doc_id, text"))),
    11: ("doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256", lambda: [brute.run_row(d, t) for d, t in table("documents", "doc_id, text")]),
    12: ("doc_id n_tokens ids_sha256 decoded_sha256", lambda: brute.pieces(table("documents", "doc_id, text"))),
    13: ("lang rank phrase a l r n score", lambda: brute.phrase_rows(table("documents", "text, lang"))),
    10: ("doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed", lambda: [(d, *brute.quality_base(t)) for d, t in table("documents", "doc_id, text")]),
}


def test_all_operators_and_the_pipeline_are_registered():
    assert sorted(NAMES) == list(range(1, 14)) and "pipeline" in entry.queries() and glob.glob(f"{SF}/*.parquet")


@pytest.mark.parametrize("number", sorted(EXPECTED))
def test_query_equals_brute_force(spark, number):
    columns, expected = EXPECTED[number]
    assert rows(entry.queries()[NAMES[number]](spark, SF), columns) == sorted(expected(), key=repr)


@pytest.mark.parametrize("name", [n for n in NAMES.values() if n in entry.oracle_sql()])
def test_query_equals_oracle(spark, name):
    status, n, _ = compare(spark, oracle_connection(SF), name, entry.queries()[name], entry.oracle_sql()[name], SF)
    assert status == "ok" and n > 0


def test_pipeline_stages_equal_brute_force(spark):
    docs = documents(spark, SF)
    judged = {r["doc_id"]: r["kept"] for r in quality_votes.judge(docs).collect()}
    good = docs
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        good = stage(spark, good, SF)
        seen[name] = good.collect()
        good = spark.createDataFrame(seen[name], good.schema)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert good.columns == docs.columns
    texts = dict(table("documents", "doc_id, text"))
    kept = [(d, texts[d]) for d in sorted(texts) if judged[d]]
    assert sorted(r["doc_id"] for r in seen["quality_rules"]) == [d for d, _ in kept]
    cleaned = sorted((d, t) for d, _, _, t in brute.line_dedup(kept))
    assert sorted((r["doc_id"], r["text"]) for r in seen["line_dedup"]) == cleaned
    single = [d for d, _, c in brute.components(cleaned, 5, 80) if d == c]
    assert sorted(r["doc_id"] for r in seen["near_duplicates"]) == sorted(single)
    cleaned = dict(cleaned)
    total, taken = sum(len(cleaned[d].split()) for d in single), sum(len(r["text"].split()) for r in seen["source_mix"])
    assert {r["doc_id"] for r in seen["source_mix"]} <= set(single) and 1.4 * total <= taken <= 1.6 * total
    expected = brute.bpe([(r["doc_id"], r["text"]) for r in seen["source_mix"]])
    assert sorted((r["doc_id"], r["n_tokens"], brute.sha(" ".join(map(str, r["ids"])).encode()), r["decoded_sha256"]) for r in seen["token_ids"]) == sorted(expected)
