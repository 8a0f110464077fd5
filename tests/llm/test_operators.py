"""Each operator against its brute-force version, over hard small tables."""

import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from plinth.llm import byte_bpe, embedding_forest, licenses, line_runs, mixing, ngram_join, quality_votes, sharding, token_files, warc
from tests.llm import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, size long, kept string"


def texts():
    rng = random.Random(5)
    words = ["of", "the", "Ärger", "naïve", "x1", "42", "don't", "#tag", "public", "license", "General", "all", "rights", "reserved", "CC", "by", "日本語", "…"]
    base = [rng.choice(words) + str(rng.randrange(400)) for _ in range(120)]
    out = [None, "", "   \n\t ", "one", "one two three", "one two three", "ONE two three four", "line of words here\nLine of Words Here \nshort\nshort",
           "  line of words here\nother", "CC-BY cc by General Public\nLicense", "All rights reserved. all  RIGHTS reserved",
           "Licensed under the Apache License, Version 2.0.", "é" * 3000, "a" * 5000 + " " + "b" * 700, "\x00\x1f null   bytes x", " ".join(base) * 40]
    for k in range(24):
        copy = list(base)
        for _ in range(k % 7):
            copy[rng.randrange(120)] = rng.choice(words)
        out.append(" ".join(copy))
    for _ in range(30):
        out.append("\n".join(" ".join(rng.choice(words) for _ in range(rng.randrange(1, 30))) for _ in range(rng.randrange(1, 9))))
    return out + out[:6] + [" ".join(base)] * 5


def rows():
    out = [(i * 3 + 1, t) for i, t in enumerate(texts())]
    return out + [(None, "one two three"), (7, "one two three"), (None, None), (7, "one two three")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", (None, "a", "b")[n % 3] if n % 2 else "a", 5, "k", 9, "x") for n, (i, t) in enumerate(rows())], SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def same(df, expected):
    assert sorted(map(tuple, df.collect()), key=repr) == sorted(expected, key=repr)


def test_license_scan(docs, nothing):
    out = licenses.scan_licenses(docs)
    same(out.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"), [(i, *brute.license_base(t)) for i, t in rows()])
    found = {r["doc_id"]: r for r in out.where("doc_id IS NOT NULL").collect()}
    apache = next(i for i, t in rows() if t and "Apache" in t)
    assert found[apache]["labels"] == "apache-2.0" and found[apache]["score"] == 1.0
    assert licenses.scan_licenses(nothing).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_license_search_equals_comparison_with_every_template(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(30)]
    made = [licenses.Template(f"t{k}", tuple(rng.sample(vocabulary, rng.randrange(3, 12))), rng.choice([60, 75, 80, 100])) for k in range(12)]
    index = licenses.Index(made, {w.encode(): rng.randrange(9) for w in vocabulary}, 16)
    for _ in range(300):
        held = sorted({index.order[w.encode()] for w in rng.choices(vocabulary, k=rng.randrange(1, 25)) if w.encode() in index.order})
        every = {(k, len(index.members[k] & set(held))) for k in range(len(made)) if len(index.members[k] & set(held)) >= index.overlap[k]}
        assert set(index.search(held)) == every


def test_ngram_join(docs, nothing):
    same(ngram_join.jaccard_components(docs), brute.components(rows()))
    assert ngram_join.jaccard_components(nothing).count() == 0
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    found = brute.components(rows())
    same(kept.select("doc_id"), [(i,) for i, n, _ in found if not n] + [(c,) for c in {c for _, n, c in found if n}])


def test_ngram_join_blocks_and_frequent_shingles(spark, monkeypatch):
    rng = random.Random(2)
    base = [f"w{i}" for i in range(60)]
    made = []
    for k in range(150):
        copy = list(base)
        for _ in range(rng.randrange(0, 5)):
            copy[rng.randrange(60)] = f"v{rng.randrange(50)}"
        made.append((k, " ".join(copy)))
    for name, value in {"LIST_BLOCK": 16, "SET_BLOCK": 8, "FREQUENT_FROM": 3, "BATCH_FROM": 1}.items():
        monkeypatch.setattr(ngram_join, name, value)
    same(ngram_join.jaccard_components(spark.createDataFrame(made, "doc_id long, text string").repartition(3)), brute.components(made))


def test_bitmap_bounds_the_difference_from_below():
    rng = np.random.default_rng(0)
    for n, m in [(10, 12), (100, 130), (64, 65), (1000, 1100)]:
        a = rng.integers(0, 2**63, n, dtype=np.uint64)
        b = np.concatenate([a[: n // 2], rng.integers(0, 2**63, m - n // 2, dtype=np.uint64)])
        x, y = ngram_join.parity(a), ngram_join.parity(b)
        assert ngram_join.differing(int.from_bytes(x, "little"), 8 * len(x), int.from_bytes(y, "little"), 8 * len(y)) <= len(set(a) ^ set(b))


def test_warc(spark):
    pages = [(1, "http://a", "x"), (5, "http://b", "x"), (2, None, "é\r\n\r\nWARC/1.1\r\n"), (3, "u\r\nX: y", None), (9, "u", ""), (None, "v", "x"), (None, "v", "only"),
             (4, "w", "z" * 200_000), (4, "w", "z" * 200_000), (6, "w", "z" * 200_000)]
    df = spark.createDataFrame([(*p, "clash", 1) for p in pages], "page_id long, url string, html string, digest string, owner int")
    path = warc.write_archive(df)
    records = warc.read_records(spark, path)
    assert records.count() == 3 * len(pages)
    same(warc.page_digests(warc.captures(records)), brute.warc([(p, h) for p, _, h in pages]))
    assert warc.page_digests(warc.captures(warc.read_records(spark, warc.write_archive(df.limit(0))))).count() == 0


def test_extendible_shards(docs, nothing, spark):
    for limit in (200, 2_000, 1 << 30):
        out = sharding.shards(docs, limit).collect()
        assert len(out) == len(rows())
        held = {}
        for r in out:
            held.setdefault((r["shard"], r["page"]), []).append(r)
        for group in held.values():
            total = sum(r["text_bytes"] for r in group)
            assert total == group[0]["shard_bytes"] and (total <= limit or len(group) == 1 or all(r["text_bytes"] == 0 for r in group[1:]))
        leaves = {r["shard"] for r in out}
        assert not any(a != b and b.startswith(a) for a in leaves for b in leaves)
    assert sharding.shards(nothing, 10).count() == 0
    many = spark.range(400).select(F.lit(3).cast("long").alias("doc_id"), F.lit("twelve bytes").alias("text"))
    pages = sharding.shards(many, 100).groupBy("shard", "page").agg(F.sum("text_bytes").alias("n")).collect()
    assert sum(p["n"] for p in pages) == 4800 and max(p["n"] for p in pages) <= 100


def test_line_dedup(docs, nothing, spark):
    out = line_runs.dedup_lines(docs, batches=3, counts=("before", "dropped"))
    assert out.columns == docs.columns + ["before", "dropped"]
    # rows that repeat an id count as one document
    same(out.select("doc_id", "before", "dropped", "text"), brute.line_dedup(rows()))
    assert line_runs.dedup_lines(nothing).count() == 0
    for batches, fan_in in ((1, 2), (7, 3)):
        same(line_runs.dedup_lines(docs, batches=batches, fan_in=fan_in).select("doc_id", "n_lines", "n_dropped", "text"), brute.line_dedup(rows()))


def test_token_files(docs, nothing, spark):
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file:
        tokenizer = file.read()
    manifest = token_files.write_tokens(docs, tokenizer, 1, parts=3)
    same(token_files.read_tokens(manifest), brute.token_rows(rows()))
    assert token_files.read_tokens(token_files.write_tokens(nothing, tokenizer, 1, parts=2)).count() == 0
    with pytest.raises(ValueError):
        token_files.mounted("hdfs://host/folder")


def test_embedding_forest(spark):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((30, 16))
    vectors = [(c + 0.12 * rng.standard_normal(16)).astype(np.float32).tolist() for c in np.repeat(centres, 8, axis=0)]
    vectors += [vectors[0]] * 5 + [[0.0] * 16, None, [float("nan")] + [1.0] * 15, [1.0] * 3, [None] + [1.0] * 15, [2 * x for x in vectors[3]]]
    table = [(i * 2, v) for i, v in enumerate(vectors)]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in table], "vec_id long, embedding array<float>, key string, size int")
    found = {r["vec_id"]: r for r in embedding_forest.near_vectors(df, leaf=20).collect()}
    good = [(i, np.array(v, dtype=float)) for i, v in table if v and len(v) == 16 and None not in v and np.isfinite(v).all() and any(v)]
    links = {(i, j) for i, v in good for j, w in good if i != j and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= 0.9}
    exact = {i: sum(a == i for a, _ in links) for i, _ in table}
    assert all(found[i]["n_links"] <= exact[i] for i in exact) and sum(r["n_links"] for r in found.values()) >= 0.9 * len(links)
    assert all(found[i]["component_id"] == i and found[i]["kept"] for i, _ in table if not exact[i])
    assert embedding_forest.near_vectors(df.limit(0)).count() == 0


def test_mixing(docs, nothing):
    out = mixing.mixed(docs).collect()
    again = mixing.mixed(docs.repartition(3)).collect()
    assert sorted(map(tuple, out), key=repr) == sorted(map(tuple, again), key=repr) and len(out) == len(rows())
    sources = {}
    for r in out:
        assert r["taken"] <= 2 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
        sources.setdefault(r["source"], []).append(r)
    for group in sources.values():
        assert sum(r["size"] for r in group) == group[0]["source_size"]
        assert abs(sum(r["taken"] for r in group) - group[0]["target"]) <= max(r["size"] for r in group)
    assert mixing.mixed(nothing).count() == 0
    mixture = mixing.mix(docs)
    assert mixture.columns == docs.columns


def test_targets_and_subsets():
    got = mixing.targets({"a": 100, "b": 100, None: 10})
    assert got["a"] == 200 and got[None] == 20 and got["b"] == pytest.approx(95)
    rng = np.random.default_rng(1)
    for _ in range(60):
        sizes = np.unique(rng.integers(1, 30, 5))
        counts = rng.integers(0, 4, len(sizes))
        goal = int(rng.integers(0, 1 + (sizes * counts).sum()))
        sums = {0}
        for s, c in zip(sizes, counts):
            sums = {x + int(s) * k for x in sums for k in range(c + 1)}
        taken = mixing.closest_subset(sizes, counts, goal)
        assert (taken >= 0).all() and (taken <= counts).all()
        reached = int((sizes * taken).sum())
        assert reached <= goal and goal - reached <= max(1, sizes.max())


def test_byte_bpe(docs, nothing):
    vocabulary = byte_bpe.Vocabulary.read(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    encoded = byte_bpe.encode(docs, vocabulary, public_tokenizers.PATTERN)
    same(byte_bpe.digests(encoded, vocabulary), brute.bpe(rows()))
    assert byte_bpe.digests(byte_bpe.encode(nothing, vocabulary, public_tokenizers.PATTERN), vocabulary).count() == 0
    rng = random.Random(3)
    pairs = vocabulary.pairs()
    for _ in range(40):
        piece = "".join(rng.choice("abcdeéß日 ́") for _ in range(rng.randrange(1, 300))).encode()
        assert vocabulary.merge_matrix([piece])[0] == vocabulary.merge_long(piece, pairs)


def test_quality_votes(docs, nothing):
    out = quality_votes.judge(docs)
    same(out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"), [(i, *brute.quality_base(t)) for i, t in rows()])
    assert not any(r["kept"] and r["base_failed"] for r in out.collect())
    kept = quality_votes.keep_good(docs)
    assert kept.columns == docs.columns and kept.count() == out.where("kept").count()
    assert quality_votes.judge(nothing).count() == 0


def test_posteriors_follow_reliable_rules():
    rng = random.Random(0)
    counts = {}
    for _ in range(4000):
        good = rng.random() < 0.8
        pattern = 0
        for accuracy in (0.95, 0.9, 0.9, 0.85, 0.9, 0.6, 0.55):
            right = rng.random() < accuracy
            pattern = pattern * 3 + (0 if good == right else 1)
        counts[pattern] = counts.get(pattern, 0) + 1
    found = quality_votes.posteriors(counts)
    assert found[0] > 0.99 and found[sum(3**k for k in range(7))] < 0.01
    assert quality_votes.posteriors({}) == {}
