"""Results and plans that held on small tables only."""

import time

from pyspark.sql import functions as F

import workload.catalog  # noqa: F401
from plinth.operators import asof
from workload.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.01"


def unsteady(df, name):
    """A column that differs each time it is computed, as the last bits of a mean may."""
    return df.withColumn(name, F.udf(time.perf_counter, "double").asNondeterministic()())


def test_asof_rows_are_not_joined_back_by_their_values(spark):
    rows = spark.createDataFrame([("a", "2024-05-01"), ("a", "2024-05-01"), ("b", None), (None, "2024-05-01")], "k string, t string")
    left = unsteady(rows.withColumn("t", F.to_date("t")), "value")
    right = spark.createDataFrame([("a", "2024-04-25", 1.0), ("a", "2024-05-20", 2.0)], "k string, d string, v double").withColumn("d", F.to_date("d"))
    near = asof.nearest(left, right, ["k"], "t", "d", "v", 20).collect()
    assert sorted((r.k or "", r.base) for r in near if r.base) == [("a", 1.0), ("a", 1.0)] and len(near) == 4
    back = asof.backward(left, right, ["k"], "t", "d", "v", 20).collect()
    assert sorted((r.k or "", r.rate, str(r.rate_date)) for r in back if r.rate) == [("a", 1.0, "2024-04-25")] * 2 and len(back) == 4


def test_equal_rows_stay_as_many(spark):
    left = spark.createDataFrame([("a", 1)] * 3, "k string, x int").withColumn("t", F.to_date(F.lit("2024-05-01")))
    right = left.select("k", F.col("t").alias("d"), F.lit(5.0).alias("v")).limit(1)
    assert [r.base for r in asof.nearest(left, right, ["k"], "t", "d", "v", 20).collect()] == [5.0] * 3


def test_mixed_folder_with_splits_without_rows(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        got = QUERIES["src_14_mixed_folder_failures"](spark, SF).first()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert (got.rows, got.failed) == (1500 + 15000 + 25, 2)


def test_parameters_of_an_advert_are_looked_up_once(spark):
    from plinth.operators import listings as L
    from workload.listing_queries import ads
    plan = L.advert_rows(ads(spark, SF))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_position") == len({"price", "market", "market_type", *L.NUMERIC_PARAMS, *L.LABEL_PARAMS})


def test_close_values_meet_in_no_window(spark):
    """A hundred thousand values within a millionth of each other: exact, and ordered only within a part of their cell."""
    from plinth.operators.order_stats import quantiles
    df = spark.range(100_000).select((F.lit(1.0) + F.col("id") * 1e-12).alias("v"))
    found = quantiles(df, [], {"v": {"m": 0.5, "q": 0.123}})
    want = df.agg(F.percentile("v", 0.5), F.percentile("v", 0.123)).first()
    got = found.first()
    assert abs(got.m - want[0]) < 1e-15 and abs(got.q - want[1]) < 1e-15
    windows = [line for line in found._jdf.queryExecution().analyzed().toString().splitlines() if "windowspecdefinition" in line and "v#" in line]
    assert windows and all("sub#" in line for line in windows if " v#" in line.split("windowspecdefinition")[1])



def offers(spark):
    """Two sources share a dwelling, one repeats its own, and rows without a source do so too."""
    rows = [(1, "A", 100.0), (2, "B", 100.0), (3, "A", 100.0), (4, "A", 300.0), (5, "A", 300.0), (6, None, 300.0), (7, None, 300.0), (8, None, 300.0),
            (9, "A", 500.0), (10, "B", None)]
    return spark.createDataFrame(rows, "listing_id int, source string, price_usd double").select(
        "*", F.lit("sale").alias("kind"), F.lit("F").alias("property"), F.lit("r").alias("region"), F.lit("d").alias("district"),
        F.lit(2.0).alias("rooms"), F.lit(50.0).alias("total_area"), (F.col("price_usd") / 50).alias("sqm_usd"))


def test_rows_are_looked_up_only_for_groups_repeated_in_one_source(spark):
    from plinth.operators import quality as Q
    rows = Q.with_duplicate_keys(offers(spark))
    groups = Q.duplicate_groups(rows)
    assert sorted((r.price_key, r.copies, r.sourced, r.crossed) for r in groups.collect()) == [(100.0, 3, 3, True), (300.0, 5, 2, False), (500.0, 1, 1, False)]
    assert sorted(r.listing_id for r in Q.drop_cross_source(rows, groups).collect()) == [1, 4, 5, 6, 7, 8, 9, 10]


def test_audit_reads_its_rows_once(spark):
    from plinth.operators import quality as Q
    made = spark.sparkContext.accumulator(0)

    def seen(x):
        made.add(1)
        return x
    rows = offers(spark).withColumn("listing_id", F.udf(seen, "int").asNondeterministic()("listing_id"))
    clean, findings = Q.audit(rows, known=F.lit(True))
    found = {r.code: r.affected for r in findings.collect()}
    assert (found["cross_source"], found["repeat"]) == (2, 1 + 2) and clean.count() == 8 and made.value == 10


def test_outliers_read_the_listings_once(spark):
    for name in ("qa_06_log_mad_outliers", "qa_02_cross_source_duplicates"):
        assert "l_orderkey" not in QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()


def test_advert_rows_are_compiled_to_small_methods(spark):
    """The JVM never optimises a method of more than 8,000 bytes."""
    df = QUERIES["lst_10_pool_sources"](spark, SF)
    df.collect()
    plan = df._jdf.queryExecution()
    debug = getattr(getattr(spark.sparkContext._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
    codes = debug.codegenStringSeq(plan.executedPlan()).iterator()
    sizes = []
    while codes.hasNext():
        sizes.append(codes.next()._3().maxMethodCodeSize())
    assert sizes and max(sizes) < 8000


def test_runs_are_shuffled_once_and_counted_by_hash(spark):
    from plinth.operators import text_checks as T
    same = "one two three four five six"
    for ids in ([5, -3, None], ["b", "a", None], [2**62, -2**61 - 1, 7], [9, 4, 6]):
        order = sorted(ids, key=lambda i: (i is not None, i if i is not None else 0))
        docs = spark.createDataFrame([(i, f"{i} x y z v w\nq {same} {same}") for i in ids], f"doc_id {'string' if 'a' in ids else 'long'}, text string")
        found = T.repeated_runs(T.paragraphs(docs))
        assert sorted((str(r.doc_id), r.par, r.run, str(r.first_doc), r.first_par) for r in found.collect()) == sorted(
            (str(i), 1, "q one two three four five", str(order[0]), 1) for i in order[1:])
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "SortAggregate" not in plan and "ReusedExchange" in plan


def test_issues_without_details_are_the_same(spark):
    from plinth.operators import text_checks as T
    from workload.text_queries import PHRASES, pars
    p = pars(spark, "/root/testdata/sf0.001")
    by = lambda df: {(r.doc_id, r.par, r.code): r["count"] for r in df.groupBy("doc_id", "par", "code").count().collect()}
    assert by(T.issues(p, PHRASES)) == by(T.issues(p, PHRASES, details=False))


def test_buckets_read_their_rows_once(spark):
    from plinth.operators.bucketing import capacity_buckets
    made = spark.sparkContext.accumulator(0)

    def seen(x):
        made.add(1)
        return x
    rows = spark.range(0, 200, 1, 2).select(F.lit("a").alias("place"), F.udf(seen, "double").asNondeterministic()(F.col("id").cast("double")).alias("p"))
    found = capacity_buckets(rows, ["place"], "p", 50).collect()
    assert sum(r.rows for r in found) == 200 and max(r.rows for r in found) <= 50 and made.value == 200


def test_pages_are_made_by_tasks_of_a_fixed_number_of_listings(spark, monkeypatch):
    from workload import listing_queries as Q
    monkeypatch.setattr(Q, "PAGED_ROWS", 5000)
    df = Q.explode_pages(spark, SF)
    shuffled = [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning(" in line]
    for by in ("page", "id"):
        assert [f", {60000 // 5000 + 1})" in line for line in shuffled if f"hashpartitioning({by}#" in line] == [True]
    assert not any("hashpartitioning(kind" in line and "id#" in line.split(")")[0] for line in shuffled)
    from tools.compare import oracle_connection
    con = oracle_connection(SF)
    assert sorted(map(tuple, df.collect())) == sorted(con.execute(ORACLES["src_21_explode_pages"]).fetchall())


def test_lines_are_parsed_once_and_no_path_or_name_is_worked_out_for_each(spark, tmp_path):
    from plinth.sources import json_walk
    spark.range(100).selectExpr("if(id % 10 = 0, '{\"id\"', to_json(named_struct('id', id))) AS value").repartition(2).write.text(str(tmp_path / "t"))
    docs, _ = json_walk.documents(spark, str(tmp_path / "t"))
    plan = json_walk.walk(docs)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert sum(line.count("parseJson") for line in plan) == 1 and not any("variant_get" in line for line in plan)
    joined = next(at for at, line in enumerate(plan) if "Join Inner" in line)
    assert joined < max(at for at, line in enumerate(plan) if "regexp_extract(" in line)
