"""Range scaling and feature assembly (§2.7).

The fitted scaler is a small table ``(feature, lo, hi)`` — one row per
feature — learned in ONE aggregation on the training rows only. Applying it
is column arithmetic (no shuffle, nulls pass, out-of-range values are not
clipped; a constant column maps to 0).
"""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fit_range_scaler(df: DataFrame, cols) -> DataFrame:
    """feature, lo, hi (min and max of each column, one pass)."""
    cols = list(cols)
    aggs = []
    for i, c in enumerate(cols):
        aggs += [F.min(F.col(c).cast("double")).alias(f"lo{i}"), F.max(F.col(c).cast("double")).alias(f"hi{i}")]
    stack = ", ".join(f"'{c}', lo{i}, hi{i}" for i, c in enumerate(cols))
    return df.agg(*aggs).selectExpr(f"stack({len(cols)}, {stack}) AS (feature, lo, hi)")


def scaler_params(scaler) -> dict:
    """{feature: (lo, hi)}: the fitted table is one row per feature."""
    if isinstance(scaler, dict):
        return scaler
    return {r["feature"]: (r["lo"], r["hi"]) for r in scaler.collect()}


def apply_range_scaler(df: DataFrame, scaler, cols=None) -> DataFrame:
    """(x − lo)/(hi − lo) for every scaled column; hi = lo → 0."""
    params = scaler_params(scaler)
    cols = set(cols or params)

    def scaled(c):
        lo, hi = params[c]
        if lo is None or hi is None:
            return F.col(c).cast("double").alias(c)
        if hi == lo:
            return F.when(F.col(c).isNull(), F.lit(None).cast("double")).otherwise(F.lit(0.0)).alias(c)
        return ((F.col(c).cast("double") - F.lit(lo)) / F.lit(hi - lo)).alias(c)

    return df.select(*[scaled(c) if c in cols and c in params else F.col(c) for c in df.columns])


def assemble_matrix(df: DataFrame, features, out: str = "features", keep=()) -> DataFrame:
    """Ordered dense vector of ``features`` with null → 0."""
    filled = df.select(*keep, *[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in features],
                       *[c for c in df.columns if c not in set(features) and c not in set(keep)])
    return VectorAssembler(inputCols=list(features), outputCol=out, handleInvalid="keep").transform(filled)
