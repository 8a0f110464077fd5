"""Folders of mixed files: every readable row, and a manifest of what failed."""

import json

from plinth.sources import files, folders


def test_mixed_folder(spark, tmp_path):
    folder = tmp_path / "in"
    for name, text in {
        "2023/prices.csv": "date;region;price\n2023-01;A;1 000,5\n2023-02;B;900\n",
        "2024/prices.json": json.dumps({"data": [{"date": "2024-01", "region": "A", "price": 7}], "n": 1}),
        "2025/prices.csv": "id,other\n1,x\n",
        "notes.csv": 'name,text\na,"two\nlines, ""quoted"""\nb,c\n',
        "feed.jsonl": '{"v": 1}\n{"v"\n{"v": 2}\n',
        "broken.json": "{not json at all",
        "empty.csv": "", "only_names.csv": "a,b\n",
        ".hidden/x.csv": "a,b\n1,2\n", "~$lock.csv": "a,b\n1,2\n", "readme.md": "# no data\n",
    }.items():
        (folder / name).parent.mkdir(parents=True, exist_ok=True)
        (folder / name).write_text(text)
    for name, columns in {"one": "id, id * 2.5 AS area", "two": "id, uuid() AS t, id AS w"}.items():
        spark.range(50).selectExpr(*columns.split(", ")).coalesce(2).write.parquet(str(folder / f"{name}.parquet"))
    (folder / "bad.parquet").write_bytes(b"PAR1" + b"\0" * 50)
    tables, manifest = folders.read_folder(spark, str(folder))
    got = {k: (sorted(df.columns), df.count()) for k, df in tables.items()}
    assert {k: v for k, v in got.items() if v[1]} == {
        "prices": (["date", "price", "region"], 3), "prices__2": (["id", "other"], 1), "notes": (["name", "text"], 2), "feed": (["v"], 2),
        "one": (["area", "id"], 50), "two": (["id", "t", "w"], 50)}
    assert sorted(r.price for r in tables["prices"].collect()) == [7.0, 900.0, 1000.5]
    assert {r.text for r in tables["notes"].collect()} == {'two\nlines, "quoted"', "c"}
    facts = {r.path.rsplit("/", 1)[1]: (r.rows, r.damaged, r.failed) for r in manifest.collect() if "part-" not in r.path and "prices" not in r.path}
    assert facts == {"notes.csv": (2, 0, False), "feed.jsonl": (2, 1, False), "broken.json": (0, 1, True), "empty.csv": (0, 0, True),
                     "only_names.csv": (0, 0, True), "bad.parquet": (0, 0, True)}
    assert manifest.where("path LIKE '%part-%' AND NOT failed").selectExpr("sum(rows)").first()[0] == 100


def test_folder_without_data(spark, tmp_path):
    (tmp_path / "readme.md").write_text("nothing")
    tables, manifest = folders.read_folder(spark, str(tmp_path))
    assert tables == {} and manifest.count() == 0


def test_quoted_line_breaks(spark, tmp_path):
    (tmp_path / "a.csv").write_text('x,y\n1,"a\nb;c"\n2,"say ""hi"""\n')
    (tmp_path / "b.csv").write_text("x;y\n3;d\n")
    rows = files.read_delimited(spark, str(tmp_path), clean=False).collect()
    assert sorted((r.x, r.y) for r in rows) == [("1", "a\nb;c"), ("2", 'say "hi"'), ("3", "d")]
