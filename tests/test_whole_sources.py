"""Files and offers that earlier readers lost or passed as whole."""

import json

from plinth.operators.pages import embedded_offers
from plinth.sources import files


def test_half_read_parquet_file_is_failed(spark, tmp_path):
    folder = tmp_path / "in"
    for name in ("whole", "_under/also", "half", "none"):
        spark.range(200_000).selectExpr("id", "uuid() AS t").coalesce(1).write.option("parquet.block.size", 1 << 20).parquet(str(tmp_path / "w" / name))
        target = folder / f"{name}.parquet"
        target.parent.mkdir(parents=True, exist_ok=True)
        data = bytearray(next((tmp_path / "w" / name).glob("part*.parquet")).read_bytes())
        if name == "half":
            data[len(data) // 2:len(data) // 2 + 200_000] = b"\xff" * 200_000
        target.write_bytes(data[:1000] if name == "none" else data)
    rows, manifest = files.read_parquet_folder(spark, str(folder))
    found = {r.path.rsplit("/", 1)[1]: (r.rows, r.failed) for r in manifest.collect()}
    assert found["whole.parquet"] == found["also.parquet"] == (200_000, False)
    assert found["none.parquet"] == (0, True) and found["half.parquet"][0] < 200_000 and found["half.parquet"][1]


def test_each_file_has_its_separator(spark, tmp_path):
    (tmp_path / "a 1.csv").write_text("x;y\n1;2\n3;4\n")
    (tmp_path / "b.csv").write_text("y,x\n6,5\n\n8,7\n")
    rows = files.read_delimited(spark, str(tmp_path), clean=False).collect()
    assert sorted((r.x, r.y) for r in rows) == [("1", "2"), ("3", "4"), ("5", "6"), ("7", "8")]


def test_offers_at_any_depth(spark):
    offer = lambda i: {"id": i, "params": [{"key": "p"}], "location": {"city": "c"}, "title": "t"}
    payloads = [{"offers": [offer(1)]}, {"listing": {"ads": [{"x": offer(2)}, offer(3)]}}, [offer(4)], offer(5), {"a": [[[offer(6)]]]}, {"id": 7}]
    pages = spark.createDataFrame([(k, f"<script>{json.dumps(p)}</script>") for k, p in enumerate(payloads)], "page_id long, html string")
    assert sorted(r.id for r in embedded_offers(pages).collect()) == ["1", "2", "3", "4", "5", "6"]
    assert embedded_offers(pages.limit(0)).count() == 0
