"""Rows that earlier versions lost."""

from plinth.operators.bucketing import capacity_buckets
from plinth.operators.order_stats import numbered
from plinth.operators.text_checks import repeated_runs
from plinth.operators.translate import translate_column
from plinth.sources.json_tables import damaged_lines, read_json
from plinth.streaming import snapshots


def test_half_damaged_json_lines(spark, tmp_path):
    (tmp_path / "a.json").write_text("\n".join(['{"x": %d}' % i for i in range(40)] + ['{"x": '] * 60))
    (tmp_path / "b.json").write_text('{"x":\n' * 3 + '{"x": 7}\n')
    (tmp_path / "c.json").write_text('[\n{"x": 90},\n{"x": 91}\n]')
    rows = read_json(spark, str(tmp_path))["data"]
    assert sorted(r.x for r in rows.collect()) == sorted([*range(40), 7, 90, 91])
    assert tuple(damaged_lines(spark, str(tmp_path)).first()) == (63, 104)


def test_month_over_two_micro_batches(spark, tmp_path):
    source, log = str(tmp_path / "in"), str(tmp_path / "out")
    old = spark.createDataFrame([(9, "2024-01-01"), (8, "2024-02-01")], "k int, month string")
    snapshots.replace_months(old, log)
    for k in (1, 2):
        spark.createDataFrame([(k, "2024-01-01")], "k int, month string").coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(old.schema).option("maxFilesPerTrigger", 1).parquet(source)
    snapshots.stream_months(stream, log, str(tmp_path / "state"), run=1).awaitTermination()
    assert sorted(r.k for r in snapshots.read_months(spark, log).collect()) == [1, 2, 8]


def test_buckets_cover_missing_and_huge_prices(spark):
    rows = [("a", None)] * 20 + [("a", -5.0)] * 5 + [("a", 5e13)] * 5 + [("a", float(i)) for i in range(70)]
    found = capacity_buckets(spark.createDataFrame(rows, "place string, p double"), ["place"], "p", 10)
    assert sum(r["rows"] for r in found.collect()) == 100


def test_numbering_keeps_missing_keys(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), (3.0, 3), (1.0, 4)], "k double, t int")
    assert [(r.row_no, r.t) for r in numbered(df, "k", ["t"]).orderBy("row_no").collect()] == [(1, 1), (2, 2), (3, 4), (4, 3)]


def test_repeated_runs_of_large_ids(spark):
    text = "one two three four five six seven"
    for ids in ((2**40 + 1, 1), (2**42 + 1, 1), (2, 1)):
        pars = spark.createDataFrame([(i, 0, text) for i in ids], "doc_id long, par int, text string")
        assert [r.doc_id for r in repeated_runs(pars).collect()] == [max(ids)]


def test_long_translations_stay_whole(spark):
    df = spark.createDataFrame([("Word",)], "c string")
    assert len(translate_column(df, "c", {"word": "x" * 3000}).first().c) == 3000
