"""Findings of round 4, on small inputs that showed them."""

import numpy as np

from plinth.llm import embedding_forest, ngram_join


def test_unrelated_texts_that_share_a_phrase_are_no_candidates(spark):
    """Their bitmaps once differed in so few cells that clusters grew together, and whole clusters went to every pair of their blocks."""
    shingler = ngram_join.Shingler(5)
    phrase = next(p for i in range(1000) if shingler.shingles((p := f"as we said in {i}".encode()).split())[0] < 1 << 58).decode()
    for words in (127, 255, 999):
        texts = [" ".join([phrase, *(f"t{k}w{i}" for i in range(words))]) for k in range(80)]
        docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(2)
        lists = ngram_join.short_lists(docs, "text", 5, 80, {})
        assert lists.selectExpr("explode(tokens) AS token").groupBy("token").count().where("count = 80").count() == 1  # all meet in one list
        assert ngram_join.candidate_edges(lists, 80).isEmpty()


def clouds(n):
    """Vectors around a few hundred centres: some pairs reach a cosine of 0.9."""
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((n // 8, 16))
    return centres[rng.integers(0, len(centres), n)] + 0.35 * rng.standard_normal((n, 16))


def test_vectors_travel_once_to_a_subtree_and_reach_the_same_leaves(monkeypatch):
    """They once travelled to every leaf by themselves."""
    monkeypatch.setattr(embedding_forest, "SUBTREE", 400)
    vectors = embedding_forest.unit(clouds(3000))
    tree = embedding_forest.Tree(vectors, len(vectors), np.random.default_rng(1), 30, 0.06)
    leaves = {node: set(rows) for rows, node in tree.place(vectors, tree.top(), whole=True)}
    cells = list(tree.place(vectors, tree.top(), whole=False))
    assert sum(len(rows) for rows, _ in cells) < 0.7 * sum(map(len, leaves.values()))
    below = {node: set(rows[at]) for rows, cell in cells for at, node in tree.place(vectors[rows], cell, whole=True)}
    assert below == leaves


def test_forest_links_in_subtrees_and_blocks(spark, monkeypatch):
    """Leaves larger than two blocks, small subtrees and vectors of one direction give the links of brute force."""
    monkeypatch.setattr(embedding_forest, "SUBTREE", 300)
    monkeypatch.setattr(embedding_forest, "BLOCK", 40)
    vectors = np.concatenate([clouds(600), np.outer(np.arange(1, 101), np.ones(16))]).astype(np.float32)
    near = (unit := embedding_forest.unit(vectors)) @ unit.T >= 0.9
    label = np.arange(len(vectors))
    while ((new := np.where(near, label, len(label)).min(axis=1)) != label).any():
        label = new
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>").repartition(3)
    found = embedding_forest.near_vectors(df, leaf=200).orderBy("vec_id").collect()
    assert [r["component_id"] for r in found] == label.tolist()
    assert [r["n_links"] for r in found] == (near.sum(axis=1) - 1).tolist()
