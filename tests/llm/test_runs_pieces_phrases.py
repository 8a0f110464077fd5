"""Periodic runs, SentencePiece encoding and phrases against brute force and the library."""

import random

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from plinth.llm import periodic_runs, phrases, piece_bpe
from tests.llm import brute

SCHEMA = "doc_id long, text string, lang string, words string, n long, phrase string"
MODEL = public_tokenizers.path("piece_bpe_32k.model")


def frame(spark, rows):
    return spark.createDataFrame([(d, t, lang, "w", 3, "p") for d, t, lang in rows], SCHEMA).repartition(3)


def odd_rows():
    rng = random.Random(9)
    words = ["red", "blue", "Ärger", "日本", "x1"]
    out = [None, "", " \n\t ", "one", "a " * 24, "a " * 23, "a b " * 12 + "a", "b " + "a b c d e f g h " * 3, "x" * 4000, "ab " * 9000]
    for _ in range(80):
        parts = []
        for _ in range(rng.randrange(5)):
            block = [rng.choice(words) for _ in range(rng.randrange(1, 12))]
            parts += block * rng.randrange(1, 7) + block[:rng.randrange(len(block))]
        out.append(rng.choice([" ", "\n", "\x0b "]).join(parts))
    rows = [(i, t, "en") for i, t in enumerate(out)]
    return rows + rows[:6] + [(None, "a " * 30, None)]


def same(df, expected):
    assert sorted(map(tuple, df.collect()), key=repr) == sorted(expected, key=repr)


def test_runs_equal_brute_force(spark):
    docs = frame(spark, odd_rows())
    rows = [r for r in odd_rows() if r[0] is not None]
    found = periodic_runs.find_runs(periodic_runs.with_planted_runs(docs.where("doc_id IS NOT NULL")))
    same(periodic_runs.digests(found), [brute.run_row(d, t) for d, t, _ in rows])
    null = periodic_runs.digests(periodic_runs.find_runs(periodic_runs.with_planted_runs(docs.where("doc_id IS NULL")))).collect()
    assert [(r["n_runs"], r["start"], r["length"], r["period"]) for r in null] == [(1, 0, 30, 1)]
    assert periodic_runs.digests(periodic_runs.find_runs(periodic_runs.with_planted_runs(docs.limit(0)))).count() == 0
    assert periodic_runs.with_planted_runs(docs).columns == docs.columns


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=60), max_size=4), st.integers(1, 20), st.integers(2, 4))
def test_runs_of_small_alphabets(words, least_words, least_periods):
    assert periodic_runs.runs_of(words, least_words, least_periods) == [brute.periodic_runs(w, least_words, least_periods) for w in words]


def test_runs_of_one_long_text():
    words = [b"x", b"y", b"z"] * 40_000
    assert periodic_runs.runs_of([words], 24, 3) == [[(0, 120_000, 3)]]


def test_pieces_equal_the_library(spark):
    rng = random.Random(2)
    model = piece_bpe.Model.read(MODEL)
    odd = [None, "", "▁", "  a", " " * 37, "x" * 900, "<s></s><0x41>", "\x00", "a▁b \n  c\r\n", "—" * 90, "naïve 日本語 😀‍ x", "=-" * 70]
    odd += ["".join(rng.choice(sorted(model.ids)).replace("▁", " ") for _ in range(9)) for _ in range(200)]
    odd += ["".join(rng.choice("aeinst er  \n\tÉ中😀▁.,'=-") for _ in range(40)) for _ in range(200)]
    rows = [(i, t, "en") for i, t in enumerate(odd)] + [(None, "twice", "en")] * 2
    docs = frame(spark, rows)
    encoded = piece_bpe.encode(docs, model)
    same(piece_bpe.digests(encoded, model), brute.pieces([(d, t) for d, t, _ in rows]))
    texts = {r["doc_id"]: r["text"] for r in encoded.where("doc_id > 1").select("doc_id", piece_bpe.decoder(spark, model)("ids").alias("text")).collect()}
    assert texts == {d: t.replace("▁", " ") for d, t, _ in rows if d is not None and d > 1}
    assert piece_bpe.digests(piece_bpe.encode(docs.limit(0), model), model).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab the in\n ▁.=-1é中\r"), max_size=80))
def test_pieces_of_any_text(text):
    if "encoder" not in CACHE:
        CACHE.update(encoder=piece_bpe.Encoder(piece_bpe.Model.read(MODEL)), library=sentencepiece.SentencePieceProcessor(model_file=MODEL))
    ids = memoryview(CACHE["encoder"].encode(text)).cast("I").tolist()
    assert ids == CACHE["library"].encode(text, add_bos=True, add_eos=True)


CACHE: dict = {}


def test_other_models_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2 as schema

    model = schema.ModelProto()
    with open(MODEL, "rb") as data:
        model.ParseFromString(data.read())
    model.normalizer_spec.remove_extra_whitespaces = True
    (tmp_path / "other.model").write_bytes(model.SerializeToString())
    with pytest.raises(ValueError):
        piece_bpe.Model.read(str(tmp_path / "other.model"))


def phrase_texts():
    rng = random.Random(4)
    words = ["the", "of", "New", "york", "city", "Ärger", "日本", "x-1"]
    out = [(None, "en"), ("", "en"), (" . ,;\n", None), ("new york city hall. " * 40, "en"), ("a a a a a a " * 20, "de"), ("Ärger\tmit  日本\r" * 35, None)]
    for k in range(700):
        out.append((" ".join(rng.choice(words) + rng.choice(["", "", "", ",", ".\n"]) for _ in range(rng.randrange(60))), (None, "en", "de", "und")[k % 4]))
    return out


@pytest.mark.parametrize("slice_bytes", [200, phrases.SLICE_BYTES])
def test_phrases_equal_brute_force(spark, monkeypatch, slice_bytes):
    monkeypatch.setattr(phrases, "SLICE_BYTES", slice_bytes)  # many shards and one
    rows = phrase_texts()
    docs = frame(spark, [(i, t, lang) for i, (t, lang) in enumerate(rows)])
    columns = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    expected = brute.phrase_rows(rows)
    assert len(expected) > 20
    same(phrases.collocations(docs).select(*columns), expected)


def test_phrases_of_other_limits_and_empty_tables(spark):
    rows = phrase_texts()
    docs = frame(spark, [(i, t, lang) for i, (t, lang) in enumerate(rows)])
    columns = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    same(phrases.collocations(docs, longest=3, least=12, inside_percent=60, most=7).select(*columns), brute.phrase_rows(rows, 3, 12, 60, 7))
    same(phrases.collocations(docs, longest=6, least=40).select(*columns), brute.phrase_rows(rows, 6, 40))
    assert phrases.collocations(docs.limit(0)).count() == 0
    assert phrases.collocations(frame(spark, [(1, None, None), (2, "", "en")])).count() == 0


def test_scores_pass_64_bits(spark):
    big = spark.createDataFrame([("en", 1, "a", 10 ** 17), ("en", 1, "b", 10 ** 17), ("en", 2, "a b", 9 * 10 ** 16)], phrases.COUNTED)
    sums = spark.createDataFrame([("en", 10 ** 18)], "lang string, n_words long")
    assert phrases.scored(big, sums, 80, 10).first()["score"] == 900000
