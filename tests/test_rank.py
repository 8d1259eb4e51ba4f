import numpy as np
from pyspark.sql import functions as F

from attrition.operators.rank import (distinct_counts, mid_ranks, prefix_sums, prefix_sums_naive,
                                      quantile_values, row_ids)


def test_prefix_sums_equal_naive_window(spark):
    rng = np.random.default_rng(1)
    rows = [(str(k), float(v), int(n)) for k in "abc" for v, n in
            zip(rng.choice(200, 60, replace=False), rng.integers(1, 9, 60))]
    d = spark.createDataFrame(rows, "k string, v double, n long")
    two = prefix_sums(d, ["k"], "v", ["n"], partitions=7, maxes=["v"]).orderBy("k", "v").collect()
    naive = prefix_sums_naive(d, ["k"], "v", ["n"], maxes=["v"]).orderBy("k", "v").collect()
    assert [tuple(r) for r in two] == [tuple(r) for r in naive]
    auto = prefix_sums(d, ["k"], "v", ["n"], maxes=["v"]).orderBy("k", "v").collect()  # AQE-sized ranges
    assert [tuple(r) for r in auto] == [tuple(r) for r in naive]


def test_prefix_sums_unchanged_under_repartition(spark):
    d = spark.range(0, 500).select((F.col("id") % 97).cast("double").alias("v"), F.lit(1).alias("n")) \
        .groupBy("v").agg(F.sum("n").alias("n"))
    base = {r["v"]: r["cum_n"] for r in prefix_sums(d, [], "v", ["n"]).collect()}
    for parts in (1, 7, 200):
        other = {r["v"]: r["cum_n"] for r in prefix_sums(d.repartition(parts), [], "v", ["n"],
                                                          partitions=parts).collect()}
        assert other == base


def test_mid_ranks_with_ties(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (2.0,), (3.0,), (None,)], "x double")
    got = {r["value"]: r["mid_rank"] for r in mid_ranks(df, ["x"]).collect()}
    assert got == {1.0: 1.0, 2.0: 2.5, 3.0: 4.0}


def test_quantiles_type7_match_numpy(spark):
    rng = np.random.default_rng(7)
    vals = np.round(rng.normal(size=301), 1)
    df = spark.createDataFrame([(float(v),) for v in vals], "x double")
    d = distinct_counts(df, ["x"])
    q = quantile_values(prefix_sums(d, ["variable"], "value", ["n"]), ["variable"], "value", "n",
                        {"a": 0.1, "b": 0.25, "c": 0.5, "e": 0.99}).first()
    for name, p in {"a": 0.1, "b": 0.25, "c": 0.5, "e": 0.99}.items():
        assert abs(q[name] - np.quantile(vals, p)) < 1e-12


def test_row_ids_consecutive(spark):
    df = spark.createDataFrame([(f"k{i:03d}",) for i in range(50)], "key string").repartition(5)
    out = row_ids(df, order_by="key").collect()
    ids = {r["key"]: r["id_client"] for r in out}
    assert ids["k000"] == "CLIENT_1" and ids["k049"] == "CLIENT_50"
    assert len(set(ids.values())) == 50


def test_tukey_hinges_match_five_number_summary(spark):
    from attrition.operators.rank import tukey_hinges

    def fivenum(x):
        x = np.sort(x)
        n = len(x)
        n4 = np.floor((n + 3) / 2) / 2
        d = np.array([1, n4, (n + 1) / 2, n + 1 - n4, n]) - 1
        return 0.5 * (x[np.floor(d).astype(int)] + x[np.ceil(d).astype(int)])

    rng = np.random.default_rng(0)
    for n in (1, 2, 5, 10, 11, 64):
        x = np.round(rng.normal(size=n), 1)
        df = spark.createDataFrame([(float(v),) for v in x], "x double")
        p = prefix_sums(distinct_counts(df, ["x"]), ["variable"], "value", ["n"])
        h = tukey_hinges(p, ["variable"], "value", "n").first()
        f = fivenum(x)
        assert (h["lower_hinge"], h["upper_hinge"]) == (f[1], f[3])


def test_row_ids_without_key_follow_scan_order(spark):
    df = spark.range(0, 1000, numPartitions=7)
    out = row_ids(df).collect()
    ids = {r["id"]: int(r["id_client"].split("_")[1]) for r in out}
    assert sorted(ids.values()) == list(range(1, 1001))
    assert all(ids[i] == i + 1 for i in range(1000))   # range scan order


def test_prefix_sums_over_many_keys_and_nulls(spark):
    """Keys within a partition, across several, null keys and values; every partition count gives the window's result."""
    rng = np.random.default_rng(3)
    rows = [(None if k == 7 else k, None if k % 2 else f"s{k}", float(v), int(n), None if n == 3 else int(n))
            for k in range(12) for size in [400 if k in (2, 7) else rng.integers(1, 6)]
            for v, n in zip(rng.choice(1000, size, replace=False), rng.integers(1, 9, size))]
    d = spark.createDataFrame(rows, "a int, b string, v double, n long, m int")
    want = sorted(map(tuple, prefix_sums_naive(d, ["a", "b"], "v", ["n", "m"], maxes=["v", "n"]).collect()), key=repr)
    for parts in (1, 5, 40, None):
        got = prefix_sums(d, ["a", "b"], "v", ["n", "m"], partitions=parts, maxes=["v", "n"])
        assert sorted(map(tuple, got.collect()), key=repr) == want, parts
    none = prefix_sums(d.limit(0), ["a", "b"], "v", ["n"], maxes=["v"])
    assert none.columns == [*d.columns, "cum_n", "prev_v"] and none.collect() == []


def test_prefix_sums_hold_in_small_batches(spark):
    d = spark.range(0, 300).select((F.col("id") % 3).alias("k"), F.col("id").cast("double").alias("v"), F.lit(2).alias("n"))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = prefix_sums(d, ["k"], "v", ["n"], partitions=4, maxes=["v"]).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert all(r.cum_n == 2 * (int(r.v) // 3) and r.prev_v == (r.v - 3 if r.v >= 3 else None) for r in got) and len(got) == 300


def test_prefix_sums_shuffle_once(spark):
    d = spark.range(0, 50).select(F.col("id").cast("double").alias("v"), F.lit(1).alias("n"))
    plan = prefix_sums(d, [], "v", ["n"])._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "Window" not in plan  # the one shuffle is behind the checkpoint


def test_ranges_are_as_many_as_the_rows_need(spark, monkeypatch):
    from attrition.operators import rank
    monkeypatch.setattr(rank, "RANGE_ROWS", 10)
    p = rank.prefix_sums(spark.range(35).selectExpr("id as v", "id + 1 as n").repartition(8), [], "v", ["n"])
    assert p.rdd.getNumPartitions() == 4
    assert [(r.v, r.cum_n) for r in p.orderBy("v").collect()] == [(v, v * (v + 1) // 2) for v in range(35)]
    assert rank.prefix_sums(spark.range(0).selectExpr("id as v", "id as n"), [], "v", ["n"]).count() == 0
