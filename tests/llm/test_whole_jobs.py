"""Places where a stage or a query once did less than the whole job."""

import collections
import re

import numpy as np
import public_tokenizers

import corpus_pipeline
from plinth.llm import embedding_forest, line_runs, mixing, ngram_join, token_files
from tests.llm import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def kept_by_brute_force(rows, gram, percent):
    """[(id, text)] -> ids of the smallest document of each group of linked ones."""
    split = [re.findall(r"[^\x20\x09-\x0D]+", t.translate(brute.LOWER)) for _, t in rows]
    sets = [{tuple(w[i:i + gram]) for i in range(max(1, len(w) - gram + 1))} for w in split]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if group[i] != group[j] and 100 * common >= percent * len(sets[i] | sets[j]):
                group = [group[j] if g == group[i] else g for g in group]
    members = collections.defaultdict(list)
    for g, (i, _) in zip(group, rows):
        members[g].append(i)
    return sorted(min(m) for m in members.values())


def test_near_duplicate_stage_links_five_words_at_eighty_percent(spark):
    page = [f"w{i}" for i in range(1000)]
    rows = [(1, " ".join(page))]
    for doc, added in ((2, 180), (3, 245), (4, 260)):
        rows.append((doc, " ".join(page + [f"d{doc}n{i}" for i in range(added)])))
    rows += [(k, " ".join(f"p{k}q{i}" for i in range(100 + k))) for k in range(20, 30)]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], SCHEMA).repartition(3)
    kept = sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "").collect())
    assert kept == kept_by_brute_force(rows, 5, 80) == [1, 4, *range(20, 30)]
    # the query's own figures stay: there all four pages stand apart
    assert (ngram_join.GRAM, ngram_join.PERCENT) == (4, 85) and kept_by_brute_force(rows, 4, 85) == [i for i, _ in rows]


def test_mixture_takes_every_size_by_its_share():
    sizes = np.unique(np.random.default_rng(3).integers(20, 3000, 800))  # one document of each size
    counts, goal = np.ones(len(sizes), dtype=np.int64), int(sizes.sum()) * 4 // 10
    assert goal > mixing.DP_WORDS
    picks = np.array([mixing.closest_subset(sizes, counts, goal, seed) for seed in range(100)])
    assert ((picks * sizes).sum(axis=1) == goal).all()  # the budget is met to the word
    parts = [part.mean() for part in np.array_split(picks, 8, axis=1)]  # from the shortest to the longest
    assert all(0.35 < share < 0.45 for share in parts) and picks.mean(axis=0).max() < 0.7
    assert (mixing.closest_subset(sizes, counts, goal, 5) == picks[5]).all()


def test_gaps_above_the_knapsack_are_closed_too():
    rng = np.random.default_rng(0)
    for seed in range(40):
        sizes = np.unique(rng.integers(50_000, 900_000, 30))
        counts = rng.integers(1, 3, len(sizes))
        goal = int((sizes * counts).sum()) // 3
        taken = mixing.closest_subset(sizes, counts, goal, seed)
        left = goal - int((sizes * taken).sum())
        assert (taken >= 0).all() and (taken <= counts).all() and 0 <= left
        assert left < sizes[counts > taken].min()  # no document left would still fit


def test_keep_one_drops_rows_and_not_ids(spark):
    words = " ".join(f"w{i}" for i in range(30))
    rows = [(1, words), (2, words), (2, "another text of its own stays here"), (3, words.upper()), (None, words), (None, "null id alone"),
            (7, "twice the same row"), (7, "twice the same row"), (8, None), (8, None), (9, "")]
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in rows], SCHEMA).repartition(3)
    kept = sorted(((r["doc_id"], r["text"]) for r in ngram_join.keep_one(docs, gram=5, percent=80).collect()), key=repr)
    assert kept == sorted([(1, words), (2, "another text of its own stays here"), (None, "null id alone"), (7, "twice the same row"),
                           (8, None), (8, None), (9, "")], key=repr)
    only_null = docs.where("doc_id IS NULL").unionByName(docs.where("doc_id IS NULL"))
    assert ngram_join.keep_one(only_null).count() == 2 and ngram_join.keep_one(docs.limit(0)).count() == 0
    clash = docs.withColumn("hash", docs["doc_id"]).withColumn("key", docs["text"])
    assert ngram_join.keep_one(clash).columns == clash.columns and ngram_join.keep_one(clash).count() == len(kept)


def test_mix_takes_equal_ids_one_by_one(spark):
    rows = [(i, "one two three", "a") for i in range(400)] + [(None, "five words are in here", "b")] * 1000 + [(5, "x y", "a"), (5, "p q r s", "a")]
    docs = spark.createDataFrame([(i, t, "en", s, 1) for i, t, s in rows], SCHEMA).repartition(4)
    plan = mixing.mixed(docs).collect()
    taken = collections.Counter()
    for r in plan:
        taken[r["source"]] += r["taken"]
    targets = {r["source"]: r["target"] for r in plan}
    assert all(abs(taken[s] - targets[s]) <= 5 for s in targets) and 2 * 5000 > taken["b"] > 0
    mixture = mixing.mix(docs)
    words = collections.Counter()
    for r in mixture.select("source", "text").collect():
        words[r["source"]] += len(r["text"].split())
    assert words == taken and mixture.columns == docs.columns
    assert mixing.mix(docs.limit(0)).count() == 0


def test_vectors_of_each_length_link(spark):
    table = [(1, [1.0, 0.0, 0.0]), (2, [1.0, 0.0, 0.0]), (3, [1.0, 0.05, 0.0]), (4, [1.0, 0.0]), (5, [1.0, 0.01]), (6, [0.0, 1.0]), (7, [1.0]), (8, [2.0]),
             (9, [-1.0]), (10, [1.0, None]), (11, []), (12, None)]
    df = spark.createDataFrame(table, "vec_id long, embedding array<float>")
    found = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_forest.near_vectors(df).collect()}
    assert found == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (1, 4), 5: (1, 4), 6: (0, 6), 7: (1, 7), 8: (1, 7), 9: (0, 9), 10: (0, 10), 11: (0, 11), 12: (0, 12)}


def test_token_files_of_any_vocabulary(spark):
    texts = ["ab cd", "It's DON'T  x\ty", "ŸÉ İ naïve ſ ΣΑΣ 日本 é̈", "a <|endoftext|>b <|ENDOFTEXT|>", "", "\x1c\x85 x\x00y", "p(i)=3.14; 'S 'll"]
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        with open(public_tokenizers.path(name), encoding="utf-8") as file:
            vocabulary = file.read()
        encoder, whole = token_files.text_encoder(vocabulary, "<u2", 1), token_files.WholeTexts(vocabulary, "<u2", 1)
        assert (type(encoder) is token_files.ChunkEncoder) == (name == "word_bpe_49k.json")
        assert encoder.encode([t.encode() for t in texts]) == whole.encode([t.encode() for t in texts])


def test_lines_of_texts_of_one_id_and_many_lines(spark):
    many = "\n".join(f"a line of number {i % 30000}" for i in range(40000))
    docs = spark.createDataFrame([(1, many), (2, many + "\nonly the second text has it"), (3, "x\n" + many[:50]), (3, "y\na line of number 7"), (None, many)],
                                 "doc_id long, text string")
    found = {(r.doc_id, r.n_lines): (r.n_dropped, r.text) for r in line_runs.dedup_lines(docs).collect()}
    assert found[(1, 40000)] == (0, many) and found[(None, 40000)] == (0, many)
    assert found[(2, 40001)] == (40000, "only the second text has it")
    assert found[(3, 2)] == (1, "y") and found[(3, 4)][1].startswith("x")
