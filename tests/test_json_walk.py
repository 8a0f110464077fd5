"""Documents of every shape, walked into tables; expected tables are stated by hand."""

import json

import pytest

from plinth.sources import json_walk

SHAPES = {
    "records": ([{"a": 1, "b": {"c": "x"}}, {"a": 2.5}], {"t": [(1.0, "x"), (2.5, None)]}),
    "mixed list": ([1, "q"], {"t": [("1",), ("q",)]}),
    "envelope of a list": ({"meta": 1, "data": [{"a": 1}]}, {"t": [(1,)]}),
    "envelope of an object": ({"result": {"rows": [{"a": 1}, {"a": 2}]}}, {"t": [(1,), (2,)]}),
    "an empty envelope is passed over": ({"data": [], "rows": [{"a": 3}]}, {"t": [(3,)]}),
    "lists beside scalars": ({"total": 2, "Ads List": [{"a": 1}], "b": [{"c": 1}, {"c": 2}]}, {"ads_list": [(1,)], "b": [(1,), (2,)]}),
    "columns": ({"a": [1, 2, None], "b": ["x", "y", "z"], "n": 7}, {"t": [(1, "x"), (2, "y"), (None, "z")]}),
    "columns of unequal length are tables of their own": ({"a": [1, 2], "b": ["x"]}, {"a": [(1,), (2,)], "b": [("x",)]}),
    "index": ({"2020": {"v": 1}, "2021": {"w": 2}}, {"t": [("2020", 1, None), ("2021", None, 2)]}),
    "objects among scalars": ({"n": 1, "p": {"a": 1}, "q": {"b": [{"c": 5}]}}, {"p": [(1,)], "q": [], "b": [(5,)]}),
    "one record": ({"a": 1, "b": []}, {"t": [(1, [])]}),
    "names of any kind": ([{"it's": 1, 'say "it\'s"': 2, "VOID": 3, "2020": 4, "a.b": 5, "A": 6, "a": 7}], {"t": [(4, 6, 3, 7, 5, 1, 2)]}),
    "nothing": ([], {}), "null": (None, {}), "scalar": (5, {}), "no keys": ({}, {}),
}


def walked(spark, *documents):
    rows = [(f"f{i}", "t", json.dumps(d)) for i, d in enumerate(documents)]
    docs = spark.createDataFrame(rows, "file string, name string, text string").selectExpr("file", "name", "parse_json(text) AS document")
    return json_walk.tables(json_walk.walk(docs))


@pytest.mark.parametrize("name", SHAPES)
def test_shape(spark, name):
    document, expected = SHAPES[name]
    found = {k: sorted((tuple(r)[:-1] for r in df.collect()), key=repr) for k, df in walked(spark, document).items()}
    assert found == {k: sorted(rows, key=repr) for k, rows in expected.items() if rows}


def test_deep_nesting_ends_as_a_record(spark):
    deep = {"data": {"data": {"data": {"data": {"data": {"x": 1}}, "y": 2}}}}
    (df,) = walked(spark, deep).values()
    assert [tuple(r)[:-1] for r in df.collect()] == [(1, 2)] and df.columns[:-1] == ["data_data_x", "y"]


def test_index_of_many_keys_gives_rows(spark):
    index = {f"k{i}": {"v": i, **({"odd": True} if i % 2 else {})} for i in range(100_000)}
    (df,) = walked(spark, index).values()
    assert df.columns == ["key", "odd", "v", "source_file"]
    r = df.selectExpr("count(DISTINCT key)", "sum(v)", "count_if(odd)").first()
    assert tuple(r) == (100_000, sum(range(100_000)), 50_000)


def test_same_names_of_other_shapes_stay_apart(spark):
    found = walked(spark, [{"a": 1, "b": 2, "c": 3}], [{"x": 9}], [{"a": 4, "b": 5}])
    assert {k: (df.columns[:-1], df.count()) for k, df in found.items()} == {"t": (["a", "b", "c"], 2), "t__2": (["x"], 1)}


def test_files_of_lines_and_of_one_document(spark, tmp_path):
    (tmp_path / "pretty one.json").write_text(json.dumps({"meta": 1, "rows": [{"v": 1}, {"v": 2}]}, indent=1))
    (tmp_path / "lines.jsonl").write_text('{"v": 3}\n\n{"v": 4}\n{"v": \n')
    (tmp_path / "late.json").write_text('{"v":\n' + "".join(f'{{"v": {i}}}\n' for i in range(1000)))
    (tmp_path / "half.json").write_text('{"v":\n{"v": 8}\n{"w\n')
    (tmp_path / "empty.json").write_text("")
    (tmp_path / "one line.json").write_text('{"n": 1, "data": [{"v": 5}, {"v": 6}, {"v": 7}]}')
    tables, manifest = json_walk.read_json_tables(spark, str(tmp_path))
    facts = {r.file.rsplit("/", 1)[1]: (r.lines, r.damaged, r.whole) for r in manifest.collect()}
    assert facts == {"pretty%20one.json": (11, 0, True), "lines.jsonl": (3, 1, False), "late.json": (1001, 1, False), "half.json": (3, 2, False), "one%20line.json": (1, 0, False)}
    assert {k: df.count() for k, df in tables.items()} == {"pretty_one": 2, "lines": 2, "late": 1000, "half": 1, "one_line": 3}
