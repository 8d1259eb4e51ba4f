"""Plan audit: rank work never runs as one global window over row-level or
distinct-value data; scans read only the needed columns."""
from pyspark.sql import functions as F

from attrition.operators import evaluate as EV
from attrition.operators import profile as P
from attrition.operators import stat_tests as ST
from attrition.sources.fixture import customers_raw

from .conftest import SF_SMALL


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _data(spark):
    return spark.range(0, 3000).select((F.col("id") % 17).cast("double").alias("x"),
                                       (F.col("id") % 101).cast("double").alias("z"),
                                       (F.col("id") % 3 == 0).cast("int").alias("y"))


def test_keyed_rank_operators_have_no_single_partition_exchange(spark):
    df = _data(spark)
    for out in (ST.mann_whitney(df, ["x", "z"], "y", with_p=False), P.profile_numeric(df, ["x", "z"]),
                ST.spearman_matrix(df, ["x", "z"]),
                ST.chi_square(df.select(F.col("x").cast("string").alias("x"), "y"), ["x"], "y", with_p=False)):
        assert "SinglePartition" not in _plan(out)


def test_auc_reads_range_partitions_without_a_window(spark):
    """Running sums come from a pass over the checkpointed range partitions: no window, and no shuffle but that of the final one-row sum."""
    df = _data(spark)
    two = _plan(EV.auc(df, "x", "y"))
    naive = _plan(EV.auc(df, "x", "y", method="window"))
    assert "MapInArrow" in two and "windowspecdefinition" not in two and "rangepartitioning" not in two and "hashpartitioning" not in two
    assert "windowspecdefinition(s#" in naive


def test_fixture_scan_is_pruned_and_filtered(spark):
    plan = _plan(customers_raw(spark, SF_SMALL))
    assert "ReadSchema: struct<o_custkey:bigint,o_orderdate:timestamp_ntz>" in plan
    assert "PushedFilters: [IsNotNull(o_custkey)]" in plan
    assert "c_name" not in plan and "o_totalprice" not in plan   # unused columns never read
