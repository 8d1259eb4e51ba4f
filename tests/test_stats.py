import math
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from attrition.functions import stats as S
from attrition.operators import stat_tests as ST


def test_tails_known_values():
    assert S.chi2_sf(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-9)
    assert S.chi2_sf(5.991464547107979, 2) == pytest.approx(0.05, abs=1e-9)
    assert S.chi2_sf(0.0, 3) == 1.0
    assert S.chi2_sf(1e4, 2) < 1e-300 or S.chi2_sf(1e4, 2) == 0.0
    assert S.normal_two_sided(1.959963984540054) == pytest.approx(0.05, abs=1e-12)
    assert S.normal_quantile(0.975) == pytest.approx(1.959963984540054, abs=1e-9)
    assert 0.0 <= S.kolmogorov_sf(0.1, 100) <= 1.0


def test_chi_square_matches_manual(spark):
    rows = [("a", 1)] * 10 + [("a", 0)] * 20 + [("b", 1)] * 25 + [("b", 0)] * 5 + [("c", 0)] * 7
    df = spark.createDataFrame(rows, "v string, y int")
    r = ST.chi_square(df, ["v"], "y").first()
    obs = np.array([[20, 10], [5, 25], [7, 0]], dtype=float)
    exp = obs.sum(1, keepdims=True) * obs.sum(0, keepdims=True) / obs.sum()
    stat = ((obs - exp) ** 2 / exp).sum()
    assert r["statistic"] == pytest.approx(stat, abs=1e-6)
    assert r["df"] == 2
    assert r["cramers_v"] == pytest.approx(math.sqrt(stat / (obs.sum() * 1)), abs=1e-6)
    assert r["p_value"] == pytest.approx(math.exp(-stat / 2), rel=1e-9)  # df 2 closed form


def test_mann_whitney_u_is_pair_count(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 15, 120).astype(float)
    y = rng.integers(0, 2, 120)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(x, y)], "x double, y int")
    r = ST.mann_whitney(df, ["x"], "y").first()
    x0, x1 = x[y == 0], x[y == 1]
    u0 = sum((a > b) + 0.5 * (a == b) for a, b in product(x0, x1))
    assert r["u"] == pytest.approx(u0, abs=1e-9)
    assert r["median0"] == pytest.approx(np.median(x0)) and r["median1"] == pytest.approx(np.median(x1))
    assert r["p_value"] == pytest.approx(S.normal_two_sided(r["z"]), rel=1e-5)


def test_spearman_matches_numpy_ranks(spark):
    rng = np.random.default_rng(5)
    a = rng.integers(0, 10, 80).astype(float)
    b = a * 0.5 + rng.integers(0, 6, 80)
    df = spark.createDataFrame([(float(p), float(q)) for p, q in zip(a, b)], "a double, b double")
    r = ST.spearman_matrix(df, ["a", "b"]).first()

    def mid(v):
        order = np.argsort(v, kind="mergesort")
        ranks = np.empty(len(v))
        ranks[order] = np.arange(1, len(v) + 1)
        for u in np.unique(v):
            ranks[v == u] = ranks[v == u].mean()
        return ranks
    assert r["coef"] == pytest.approx(np.corrcoef(mid(a), mid(b))[0, 1], abs=1e-6)


def test_normality_moments(spark):
    rng = np.random.default_rng(11)
    x = rng.exponential(size=400)
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    r = ST.normality(df, ["x"]).first()
    m = x - x.mean()
    skew = (m ** 3).mean() / (m ** 2).mean() ** 1.5
    kurt = (m ** 4).mean() / (m ** 2).mean() ** 2 - 3
    assert r["skew"] == pytest.approx(skew, abs=1e-5)
    assert r["kurt"] == pytest.approx(kurt, abs=1e-5)
    ks = ST.ks_normal(df, ["x"]).first()
    assert 0 < ks["ks"] < 1 and ks["ks_p"] < 0.05


def test_qq_points_monotone(spark):
    df = spark.range(0, 1000).select((F.col("id") % 37).cast("double").alias("x"))
    pts = ST.qq_points(df, ["x"], k=9).orderBy("p").collect()
    assert len(pts) == 9
    assert all(a["empirical"] <= b["empirical"] and a["theoretical"] < b["theoretical"]
               for a, b in zip(pts, pts[1:]))


def test_normal_cdf_expression(spark):
    z = np.concatenate([np.linspace(-40, 40, 20_001), [0.0, 7.07106781186547, -7.07106781186547, 7.0711]])
    rows = spark.createDataFrame([(float(x),) for x in z] + [(None,)], "z double").select("z", S.normal_cdf_expr(F.col("z")).alias("p")).collect()
    assert max(abs(r.p - S.normal_cdf(r.z)) for r in rows if r.z is not None) < 1e-14
    assert [r.p for r in rows if r.z is None] == [None]


def test_lilliefors_p_is_that_of_fitted_normals(spark):
    """Over normal samples whose mean and sd are fitted, p is uniform; Kolmogorov's own p is far too large there."""
    rng = np.random.default_rng(5)
    for n in (20, 60, 400):
        x = np.sort(rng.normal(3, 2, (2000, n)), axis=1)
        z = (x - x.mean(axis=1, keepdims=True)) / x.std(axis=1, ddof=1, keepdims=True)
        phi = 0.5 * (1 + np.vectorize(math.erf)(z / math.sqrt(2)))
        i = np.arange(n)
        ks = np.maximum(np.abs(i / n - phi), np.abs((i + 1) / n - phi)).max(axis=1)
        p = np.array([r.p for r in spark.createDataFrame([(float(k), float(n)) for k in ks], "k double, n double").select(S.lilliefors_p(F.col("k"), F.col("n")).alias("p")).collect()])
        for level in (0.01, 0.05, 0.1, 0.3, 0.5):
            assert abs((p <= level).mean() - level) < 0.035, (n, level)
    edge = spark.createDataFrame([(None, 50.0), (0.2, 4.0), (5.0, 50.0), (0.0, 50.0)], "k double, n double").select(S.lilliefors_p(F.col("k"), F.col("n")).alias("p")).collect()
    assert [r.p for r in edge] == [None, None, 0.0, 1.0]


def plain_spearman(x, y):
    both = ~(np.isnan(x) | np.isnan(y))
    x, y = x[both], y[both]
    if len(x) < 2:
        return None
    ranks = [np.array([(v < w).sum() + ((v == w).sum() + 1) / 2 for w in v]) for v in (x, y)]
    return None if ranks[0].std() == 0 or ranks[1].std() == 0 else round(float(np.corrcoef(*ranks)[0, 1]), 5)


def test_spearman_of_many_columns_with_and_without_nulls(spark):
    rng = np.random.default_rng(2)
    n, k = 300, 12
    x = np.round(rng.normal(size=(n, k)) + rng.normal(size=(n, 1)), 1)
    x[:, 3] = 7.0  # constant
    x[: n // 3, 5] = x[0, 5]  # a value that a third of all rows hold
    x[rng.random((n, k)) < 0.2] += 0
    holes = [2, 8]
    for c in holes:
        x[rng.random(n) < 0.3, c] = np.nan
    x[:, 11] = np.nan
    cols = [f"a|{i}" for i in range(k)]
    df = spark.createDataFrame([tuple(None if np.isnan(v) else float(v) for v in row) for row in x], ", ".join(f"`{c}` double" for c in cols))
    got = {(r.var1, r.var2): None if r.coef is None else round(r.coef, 5) for r in spearman(df, cols)}
    want = {(cols[i], cols[j]): plain_spearman(x[:, i], x[:, j]) for i in range(k) for j in range(i + 1, k)}
    assert {p: c for p, c in got.items() if c is not None} == pytest.approx({p: c for p, c in want.items() if c is not None}, abs=2e-5)
    assert {p for p, c in want.items() if c is not None} == {p for p, c in got.items() if c is not None}


def spearman(df, cols):
    return ST.spearman_matrix(df, cols).collect()


def test_spearman_ranks_each_column_once(spark):
    """40 columns without nulls: two shuffles of rows x columns and no pairs of rows."""
    df = spark.range(0, 400).select(*[F.pmod(F.xxhash64("id", F.lit(i)), F.lit(50 + i)).cast("double").alias(f"c{i}") for i in range(40)])
    rows = spearman(df, df.columns)
    assert len(rows) == 40 * 39 // 2 and all(abs(r.coef) < 0.3 for r in rows)
