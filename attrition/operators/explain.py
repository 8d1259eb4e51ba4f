"""Per-customer attributions (TreeSHAP, path-dependent) on the MLlib margin.

Driver side (bounded by the model): every leaf becomes a path record —
distinct path features with the interval (lo, hi] a row must fall in to
follow the path, the product r_j of child/parent training counts for each,
and the leaf value times the tree weight.

For a leaf with D distinct features and row indicators o_j,
    φ_j = v · (o_j − r_j) · Σ_e e!(D−1−e)!/D! · c_e,
c_e = coefficient of t^e in Π_{i≠j}(r_i + o_i·t); base = Σ v · Π r_i.
A row enters by its D indicators only, so a leaf's attributions are a table
of 2^D rows, worked out once in a worker (at most 2^(2·depth) · depth numbers
a tree); a row is a lookup by its bit mask (``mapInPandas``, Arrow batches).
Additivity: base + Σ_j φ_j equals the row's margin (rawPrediction[1]).
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attrition.operators.model import Forest, forest_of
from attrition.session import checkpoint_root, ship_package


def leaf_paths(forest: Forest) -> list:
    """[(features, lo, hi, r, value)] for every leaf of every tree."""
    out = []
    for t, tr in enumerate(forest.trees):
        w = forest.weights[t]

        def walk(node, bounds):
            left, right = tr["left"][node], tr["right"][node]
            if left < 0:
                feats = sorted(bounds)
                lo = np.array([bounds[f][0] for f in feats], dtype=np.float64)
                hi = np.array([bounds[f][1] for f in feats], dtype=np.float64)
                r = np.array([bounds[f][2] for f in feats], dtype=np.float64)
                out.append((np.array(feats, dtype=np.int64), lo, hi, r, w * tr["value"][node]))
                return
            f, thr = int(tr["feature"][node]), float(tr["threshold"][node])
            cl, cr = tr["count"][left], tr["count"][right]
            tot = cl + cr
            rl, rr = (cl / tot, cr / tot) if tot > 0 else (0.5, 0.5)
            lo, hi, r = bounds.get(f, (-np.inf, np.inf, 1.0))
            walk(left, {**bounds, f: (lo, min(hi, thr), r * rl)})
            walk(right, {**bounds, f: (max(lo, thr), hi, r * rr)})

        walk(0, {})
    return out


def leaf_table(r: np.ndarray, v: float) -> np.ndarray:
    """Attributions of a leaf's D features (columns) for every bit mask of indicators (rows; bit j is o_j)."""
    D = len(r)
    o = (np.arange(1 << D)[:, None] >> np.arange(D) & 1).astype(np.float64)
    weights = np.array([math.factorial(e) * math.factorial(D - 1 - e) / math.factorial(D) for e in range(D)])
    out = np.empty_like(o)
    for j in range(D):
        coef = np.zeros((1 << D, D))
        coef[:, 0] = 1.0
        for i in range(D):
            if i != j:
                raised = coef[:, :-1] * o[:, [i]]
                coef *= r[i]
                coef[:, 1:] += raised
        out[:, j] = v * (o[:, j] - r[j]) * (coef @ weights)
    return out


class LeafTables:
    """All leaves of a forest: path features, intervals and attribution tables."""

    def __init__(self, paths: list):
        self.base = sum(v * float(np.prod(r)) for _, _, _, r, v in paths)
        self.leaves = [(feats, lo, hi, 1 << np.arange(len(feats)), leaf_table(r, v)) for feats, lo, hi, r, v in paths if len(feats)]

    def attributions(self, X: np.ndarray) -> np.ndarray:
        """rows × features."""
        phi = np.zeros(X.shape)
        for feats, lo, hi, bits, table in self.leaves:
            xs = X[:, feats]
            phi[:, feats] += table[((xs > lo) & (xs <= hi)) @ bits]
        return phi


def shap_kernel(X: np.ndarray, paths: list, d: int):
    """(phi: rows × d, base: float) for one batch of rows of d features."""
    tables = LeafTables(paths)
    return tables.attributions(np.asarray(X, dtype=np.float64)[:, :d]), tables.base


_TABLES: dict = {}


def leaf_tables(key: str, paths: list) -> LeafTables:
    """One set of tables for the life of a Python worker; only the last forest's are kept."""
    if key not in _TABLES:
        _TABLES.clear()
        _TABLES[key] = LeafTables(paths)
    return _TABLES[key]


def shap_wide(df: DataFrame, model, features, id_col: str) -> DataFrame:
    """id, base, margin, values array, shap array (feature order)."""
    ship_package(df.sparkSession)
    forest = model if isinstance(model, Forest) else forest_of(model, df.sparkSession)
    paths, key = leaf_paths(forest), uuid.uuid4().hex
    feats = list(features)
    base_df = df.select(F.col(id_col).cast("string").alias("id"),
                        *[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in feats])

    def run(batches):
        tables = leaf_tables(key, paths)
        for pdf in batches:
            if pdf.empty:
                continue
            X = pdf[feats].to_numpy(dtype=np.float64)
            phi = tables.attributions(X)
            yield pd.DataFrame({"id": pdf["id"].to_numpy(), "base": tables.base,
                                "margin": tables.base + phi.sum(axis=1),
                                "values": list(X), "shap": list(phi)})

    return base_df.mapInPandas(run, "id string, base double, margin double, values array<double>, "
                                    "shap array<double>")


def shap_values(df: DataFrame, model, features, id_col: str, top: int | None = None) -> DataFrame:
    """id, feature, value, shap — long table, one row per (customer, feature);
    ``top`` keeps the features with the largest mean |shap|."""
    wide = shap_wide(df, model, features, id_col)
    keep = list(enumerate(features))
    if top:
        # the kernel is the expensive part: its arrays are written once; one aggregation of the array
        # elements ranks the features, and only the kept ones are exploded
        checkpoint_root(df.sparkSession)
        wide = wide.checkpoint()
        means = wide.agg(*[F.avg(F.abs(F.col("shap")[i])).alias(f"m{i}") for i, _ in keep]).first()
        keep = sorted(keep, key=lambda k: (-(means[f"m{k[0]}"] or 0.0), k[1]))[:top]
    rows = F.array(*[F.struct(F.lit(f).alias("feature"), F.col("values")[i].alias("value"), F.col("shap")[i].alias("shap")) for i, f in keep])
    return wide.select("id", F.inline(rows))


def shap_summary(shap: DataFrame, top: int | None = 10) -> DataFrame:
    """feature, mean_abs, rank (by mean |shap| desc) — top ``top``."""
    g = shap.groupBy("feature").agg(F.avg(F.abs("shap")).alias("mean_abs"))
    out = g.orderBy(F.col("mean_abs").desc(), F.col("feature").asc())
    out = out.limit(top) if top else out
    w = Window.orderBy(F.col("mean_abs").desc(), F.col("feature").asc())  # ≤ #features rows
    return out.select("feature", F.round("mean_abs", 6).alias("mean_abs"), F.row_number().over(w).alias("rank"))


def shap_points(shap: DataFrame) -> DataFrame:
    """id, feature, value, shap, value_scaled (min–max per feature, for the
    summary plot colour). Per-feature min/max are a grouped aggregate joined
    back by broadcast (one row per feature)."""
    mm = shap.groupBy("feature").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    j = shap.join(F.broadcast(mm), "feature")
    scaled = F.when(F.col("hi") > F.col("lo"), (F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo"))) \
        .otherwise(F.lit(0.0))
    return j.select("id", "feature", "value", "shap", scaled.alias("value_scaled"))
