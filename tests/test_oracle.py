"""Registered queries vs their DuckDB oracle SQL on the smallest tables."""
import hashlib
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

from .conftest import SF_SMALL

FAST = ["customers_raw", "prepare_features", "encode_profiles", "profile_columns", "profile_numeric",
        "category_by_target", "chi_square", "mann_whitney", "spearman_matrix", "qq_points", "risk_segments",
        "split_stratified", "roc_curve", "auc", "youden_threshold", "classification_metrics", "scorecard",
        "validation_report", "score_rejects", "row_ids", "scan_csv", "mid_ranks", "value_segments",
        "scan_json_profiles"]


def _norm(v):
    if v is None:
        return "NULL"
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else f"{round(v, 6):.6f}"
    return str(v)


def _digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return hashlib.md5("\n".join(sorted("|".join(_norm(r[i]) for i in order) for r in rows)).encode()).hexdigest()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ["customer", "orders"]:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(SF_SMALL, t)}.parquet')")
    return c


@pytest.mark.parametrize("name", FAST)
def test_query_matches_oracle(spark, con, name):
    sdf = entry.queries()[name](spark, SF_SMALL)
    srows = [tuple(r) for r in sdf.collect()]
    rel = con.execute(entry.oracle_sql()[name])
    dcols = [d[0] for d in rel.description]
    drows = rel.fetchall()
    assert sorted(sdf.columns) == sorted(dcols)
    assert len(srows) == len(drows)
    assert _digest(sdf.columns, srows) == _digest(dcols, drows)


def test_every_query_has_callable_and_entry_runs(spark):
    qs, sqls = entry.queries(), entry.oracle_sql()
    assert set(sqls) <= set(qs)
    assert entry.entry(spark).count() > 0
