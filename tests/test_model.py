import math
from itertools import combinations

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from attrition.operators import encode as E
from attrition.operators import explain as X
from attrition.operators import model as M
from attrition.sources.fixture import customers_raw

from .conftest import SF_SMALL

FEATS = ["tenure", "MonthlyCharges", "Partner", "Contract_Month_to_month", "PaymentMethod_Electronic_check"]


@pytest.fixture(scope="module")
def trained(spark):
    df = E.prepare_features(customers_raw(spark, SF_SMALL)).cache()
    m = M.train_gbt(df, FEATS, "Churn", {"rounds": 4, "max_depth": 3, "subsample": 1.0,
                                         "colsample_bytree": 1.0})
    return df, m


def _brute_force_shap(forest, x, d):
    def value(S):
        total = 0.0
        for t, tr in enumerate(forest.trees):
            def rec(node):
                left, right = tr["left"][node], tr["right"][node]
                if left < 0:
                    return tr["value"][node]
                f = tr["feature"][node]
                if f in S:
                    return rec(left if x[f] <= tr["threshold"][node] else right)
                cl, cr = tr["count"][left], tr["count"][right]
                return (cl * rec(left) + cr * rec(right)) / (cl + cr)
            total += forest.weights[t] * rec(0)
        return total
    phi = np.zeros(d)
    players = list(range(d))
    for j in players:
        others = [p for p in players if p != j]
        for k in range(len(others) + 1):
            w = math.factorial(k) * math.factorial(d - k - 1) / math.factorial(d)
            for S in combinations(others, k):
                phi[j] += w * (value(set(S) | {j}) - value(set(S)))
    return phi, value(set())


def test_staged_last_round_and_shap_additivity(spark, trained):
    df, m = trained
    margin = m.transform(df).select("customerID", vector_to_array("rawPrediction")[1].alias("m"))
    staged = M.staged_scores(df, m, FEATS, "customerID").filter("round = 4")
    diff = margin.join(staged, margin.customerID == staged.id).select(F.max(F.abs(F.col("m") - F.col("margin"))))
    assert diff.first()[0] < 1e-9
    wide = X.shap_wide(df, m, FEATS, "customerID")
    d2 = margin.join(wide, margin.customerID == wide.id).select(F.max(F.abs(F.col("m") - F.col("margin"))))
    assert d2.first()[0] < 1e-9


def test_shap_equals_brute_force_shapley(spark, trained):
    df, m = trained
    forest = M.Forest.from_table(M.tree_table(m))
    paths = X.leaf_paths(forest)
    X_rows = np.array([[r[f] for f in FEATS] for r in df.select(*FEATS).limit(12).collect()], dtype=float)
    phi, base = X.shap_kernel(X_rows, paths, len(FEATS))
    for i in range(len(X_rows)):
        exact, v0 = _brute_force_shap(forest, X_rows[i], len(FEATS))
        assert np.allclose(phi[i], exact, atol=1e-10)
        assert base == pytest.approx(v0, abs=1e-10)


def _polynomial_shap(X, paths, d):
    """The formula row by row and leaf by leaf, without tables."""
    phi = np.zeros((len(X), d))
    for feats, lo, hi, r, v in paths:
        D = len(feats)
        for n, x in enumerate(X):
            o = [float(lo[j] < x[f] <= hi[j]) for j, f in enumerate(feats)]
            for j, f in enumerate(feats):
                coef = np.poly1d([1.0])
                for i in range(D):
                    if i != j:
                        coef = coef * np.poly1d([o[i], r[i]])
                c = coef.coeffs[::-1]
                phi[n, f] += v * (o[j] - r[j]) * sum(math.factorial(e) * math.factorial(D - 1 - e) / math.factorial(D) * c[e] for e in range(len(c)))
    return phi


def test_shap_tables_of_deep_trees(spark):
    """Depth 7 with features that repeat on a path, against the formula."""
    rng = np.random.default_rng(4)

    def grow(nodes, depth, n):
        at = len(nodes)
        nodes.append(None)
        if depth == 7 or n < 2 or depth > 3 and rng.random() < 0.2:
            nodes[at] = (-1, -1, -1, 0.0, rng.normal(), n)
            return at
        k = int(rng.integers(1, n)) if n > 1 else 1
        f, t = int(rng.integers(0, 9)), float(rng.normal())
        left = grow(nodes, depth + 1, k)
        nodes[at] = (left, grow(nodes, depth + 1, n - k), f, t, 0.0, n)
        return at

    trees = []
    for _ in range(2):
        nodes = []
        grow(nodes, 0, 5000)
        trees.append({k: np.array(v) for k, v in zip(("left", "right", "feature", "threshold", "value", "count"), zip(*nodes))})
    forest = M.Forest(np.array([1.0, 0.3]), trees)
    paths, rows = X.leaf_paths(forest), rng.normal(size=(5, 9))
    phi, base = X.shap_kernel(rows, paths, 9)
    assert max(len(p[0]) for p in paths) >= 5
    assert np.allclose(phi, _polynomial_shap(rows, paths, 9), atol=1e-12)
    assert np.allclose(base + phi.sum(axis=1), forest.staged_margins(rows)[:, -1], atol=1e-10)


def test_importance_shares(spark, trained):
    _, m = trained
    imp = M.feature_importance(m, FEATS).collect()
    assert sum(r["gain"] for r in imp) == pytest.approx(1.0, abs=1e-5)
    mllib = M.gbt_stage(m).featureImportances.toArray()
    for r in imp:
        assert r["gain"] == pytest.approx(mllib[FEATS.index(r["feature"])], abs=1e-5)


def test_select_rounds_best_is_argmax(spark, trained):
    df, m = trained
    staged = M.staged_scores(df, m, FEATS, "customerID", keep=["Churn"])
    r = M.select_rounds(staged, "Churn").collect()
    best = [x for x in r if x["best"]]
    assert len(best) == 1 and best[0]["mean_auc"] == max(x["mean_auc"] for x in r)


def test_crossvalidator_tuning_form(spark, trained):
    from attrition.operators import split as SP
    df, _ = trained
    folded = SP.kfold_assign(df, "customerID", 2, 7)
    grid = {"max_depth": [2, 3], "eta": [0.1], "subsample": [1.0], "colsample_bytree": [1.0]}
    out = M.tune_gbt_cv(folded, FEATS, "Churn", grid, fold_col="fold", rounds=2).collect()
    assert len(out) == 2 and sum(r["is_best"] for r in out) == 1
    best = [r for r in out if r["is_best"]][0]
    assert best["mean_auc"] == max(r["mean_auc"] for r in out)


def test_margin_counts_equal_counted_rows(spark, trained):
    """Counted in the tasks, over many batches and with runs handed on early, the margins are those of the rows."""
    df, m = trained
    staged = M.staged_scores(df, m, FEATS, "customerID", keep=["Churn"])
    want = {(r["round"], r.margin): (r.n, r.n_pos) for r in staged.groupBy("round", "margin").agg(F.count("*").alias("n"), F.sum("Churn").alias("n_pos")).collect()}
    got = {(r["round"], r.margin): (r.n, r.n_pos) for r in M.margin_counts(df.repartition(3), m, FEATS, "Churn").collect()}
    assert got == want
    assert M.choose_rounds(M.margin_counts(df, m, FEATS, "Churn")).orderBy("round").collect() == M.select_rounds(staged, "Churn").orderBy("round").collect()
    assert M.margin_counts(df.limit(0), m, FEATS, "Churn").count() == 0


def test_margin_counts_merge_runs():
    rng = np.random.default_rng(1)
    counts, rows = M.MarginCounts(), []
    for _ in range(20):
        margins, positive = rng.integers(0, 9, (50, 3)) / 8.0, rng.integers(0, 2, 50)
        counts.add(1, margins, positive)
        rows.append((margins, positive))
    assert counts.held == sum(len(np.unique(np.concatenate([m[:, r] for m, _ in rows]))) for r in range(3))
    positive = np.concatenate([p for _, p in rows])
    for fold, r, values, n, n_pos in counts.take():
        all_margins = np.concatenate([m[:, r - 1] for m, _ in rows])
        assert fold == 1 and [(v, (all_margins == v).sum(), positive[all_margins == v].sum()) for v in np.unique(all_margins)] == list(zip(values, n, n_pos))
    assert counts.held == 0 and not list(counts.take())


@pytest.fixture(scope="module")
def folded(trained):
    from attrition.operators import split as SP
    return SP.kfold_assign(trained[0], "customerID", 2, 7)


GRID = {"max_depth": [2, 3], "eta": [0.1], "subsample": [1.0], "colsample_bytree": [1.0]}


def test_search_is_taken_up_where_it_stood(spark, folded, monkeypatch):
    from attrition.session import scratch_path
    root = scratch_path(spark, "search-test")
    fitted, real = [], M.train_gbt

    def counting(df, features, target, params, *rest):
        fitted.append(params["max_depth"])
        if len(fitted) == 3:
            raise RuntimeError("ended")
        return real(df, features, target, params, *rest)

    monkeypatch.setattr(M, "train_gbt", counting)
    run = dict(max_rounds=3, patience=2, parallelism=1, root=root)
    with pytest.raises(RuntimeError):
        M.tune_gbt(folded, FEATS, "Churn", GRID, **run)
    monkeypatch.setattr(M, "train_gbt", lambda *a: fitted.append("again") or real(*a))
    first = M.tune_gbt(folded, FEATS, "Churn", GRID, **run).collect()
    assert fitted.count("again") == 1  # three of four results were there: the pool finished the point after the failure
    assert M.tune_gbt(folded, FEATS, "Churn", GRID, **run).collect() == first and fitted.count("again") == 1
    M.tune_gbt(folded.where("tenure > 1"), FEATS, "Churn", GRID | {"max_depth": [2]}, **run).collect()
    assert fitted.count("again") == 3  # other rows: nothing is taken over
    assert len(first) == 2 and sum(r["is_best"] for r in first) == 1


def test_search_equals_separate_fits(spark, folded):
    got = M.tune_gbt(folded, FEATS, "Churn", GRID, max_rounds=3, patience=20, parallelism=4).collect()
    for row, depth in zip(got, GRID["max_depth"], strict=True):
        means = np.zeros(3)
        for f in (0, 1):
            m = M.train_gbt(folded.where(F.col("fold") != f), FEATS, "Churn", {"max_depth": depth, "eta": 0.1, "subsample": 1.0, "colsample_bytree": 1.0, "rounds": 3})
            rounds = M.select_rounds(M.staged_scores(folded.where(F.col("fold") == f), m, FEATS, "customerID", keep=["Churn"]), "Churn", digits=None).collect()
            means += np.array([r["mean_auc"] for r in sorted(rounds, key=lambda r: r["round"])]) / 2
        assert row["max_depth"] == depth and row["mean_auc"] == pytest.approx(means.max()) and row["best_round"] == means.argmax() + 1


def test_patience_and_ties_of_the_search(spark):
    grid = {"max_depth": [3, 4, 5], "eta": [0.1], "subsample": [1.0], "colsample_bytree": [1.0]}
    aucs = {3: [0.5, 0.6, 0.6, 0.6, 0.9], 4: [0.5, 0.7, 0.7, 0.6, 0.6], 5: [0.7, 0.5, 0.5, 0.5, 0.5]}
    rows = [(r + 1, a + d, name, f) for name, p in M.grid_points(grid) for r, a in enumerate(aucs[p["max_depth"]]) for f, d in ((0, -0.1), (1, 0.1))]
    got = M.best_rounds(spark.createDataFrame(rows, M.RESULTS), grid, patience=2).collect()
    assert [(r["max_depth"], r["best_round"], round(r["mean_auc"], 6), r["is_best"]) for r in got] == [(3, 2, 0.6, False), (4, 2, 0.7, True), (5, 1, 0.7, False)]


def test_no_forest_is_left_behind(spark, trained):
    import glob

    from attrition.session import checkpoint_root
    before = set(glob.glob(f"{checkpoint_root(spark).removeprefix('file:')}/attrition-scratch/gbt-model-*"))
    M.forest_of(trained[1])
    assert set(glob.glob(f"{checkpoint_root(spark).removeprefix('file:')}/attrition-scratch/gbt-model-*")) == before


def test_node_ids_are_not_stored_and_the_trees_are_the_same(spark, trained):
    df, _ = trained
    pipe = M.gbt_estimator(FEATS, "Churn", {"rounds": 3, "max_depth": 4})
    assert not pipe.getStages()[-1].getCacheNodeIds()
    found = [pipe.copy({pipe.getStages()[-1].cacheNodeIds: c}).fit(df).stages[-1].toDebugString.split("\n", 1)[1] for c in (False, True)]
    assert found[0] == found[1]


def test_search_rows_read_their_table_once(spark):
    from attrition.plans import training as TR
    from attrition.plans.catalog import prepared
    rows = TR.search_rows(prepared(spark, SF_SMALL), 2)
    assert "orders" not in rows._jdf.queryExecution().optimizedPlan().toString() and not rows.isEmpty()
    assert "o_custkey" not in rows._jdf.queryExecution().optimizedPlan().toString()
