from pyspark.sql import functions as F

from attrition.operators import split as SP


def test_split_partition_of_rows(spark):
    df = spark.range(0, 2000).select(F.concat(F.lit("C"), F.col("id").cast("string")).alias("cid"),
                                     (F.col("id") % 4 == 0).cast("int").alias("y"))
    s = SP.split_train_test(df, "cid", 0.8, 123)
    n_train = s.filter("is_train").count()
    assert 0.75 < n_train / 2000 < 0.85
    train = s.filter("is_train")
    test = SP.anti_split(df, train, "cid")
    assert test.count() + n_train == 2000
    assert test.join(train, "cid").count() == 0
    # stable under repartitioning
    again = SP.split_train_test(df.repartition(13), "cid", 0.8, 123).filter("is_train")
    assert again.join(train, "cid", "left_anti").count() == 0


def test_stratified_split_exact_shares(spark):
    df = spark.range(0, 1000).select(F.col("id").cast("string").alias("cid"),
                                     (F.col("id") % 4 == 0).cast("int").alias("y"))
    s = SP.split_train_test(df, "cid", 0.8, 123, stratify="y")
    got = {r["y"]: r["n"] for r in s.filter("is_train").groupBy("y").agg(F.count("*").alias("n")).collect()}
    assert got == {1: 200, 0: 600}


def test_sample_and_folds(spark):
    df = spark.range(0, 300).select(F.col("id").cast("string").alias("cid"), F.lit(1).alias("Churn"))
    smp = SP.sample_n(df, "cid", 1000, drop="^churn$")
    assert smp.count() == 300 and smp.columns == ["cid"]
    assert SP.sample_n(df, "cid", 10).count() == 10
    folds = SP.kfold_assign(df, "cid", 10, 7)
    assert {r["fold"] for r in folds.select("fold").distinct().collect()} == set(range(10))


def test_rows_without_an_id_are_in_one_half_and_one_fold(spark):
    df = spark.createDataFrame([(None, "a"), (1, "a"), (None, "b"), (2, None), (None, None)], "id long, cls string")
    for stratify in (None, "cls"):
        split = SP.split_train_test(df, "id", 0.8, stratify=stratify)
        train, test = split.where("is_train"), split.where("not is_train")
        assert train.count() + test.count() == 5
        if stratify is None:
            assert SP.anti_split(split, train, "id").count() == test.count()
    assert [r.fold for r in SP.kfold_assign(df, "id", 10).collect() if r.fold is None or not 0 <= r.fold < 10] == []
    assert SP.sample_n(df, "id", 5).count() == 5
