"""The reference's offline flow as one composed Spark run.

per-customer table (written once) → exploration reports → prepared feature
table → fit (split, scaler, weight, GBT, threshold) → evaluation on the test
split → importance and attributions → artefacts. Every report is a DataFrame
written as parquet under ``out_dir/reports/<name>``; nothing is collected
except the small fitted objects.

    python -m attrition.plans.offline /root/testdata/sf0.01 <out_dir>
"""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession

from attrition.config import FEATURES
from attrition.operators import encode as E
from attrition.operators import evaluate as EV
from attrition.operators import explain as XP
from attrition.operators import model as M
from attrition.operators import profile as P
from attrition.operators import stat_tests as ST
from attrition.plans import training as TR
from attrition.plans.oracle_sql import CATS, NUMS
from attrition.sources import io as IO
from attrition.sources.fixture import customers_raw


def exploration(raw: DataFrame) -> dict:
    ex = E.explore_recode(raw)
    return {
        "profile_columns": P.profile_columns(raw),
        "frequency_churn": P.frequency_table(ex, "Churn"),
        "profile_categorical": P.profile_categorical(ex, CATS),
        "profile_numeric": P.profile_numeric(raw, NUMS),
        "normality": ST.normality(raw, NUMS),
        "qq_points": ST.qq_points(raw, NUMS),
        "spearman": ST.spearman_matrix(raw, NUMS),
        "category_by_target": P.category_by_target(ex, CATS, "Churn"),
        "proportions_churn_no": P.condition_proportions(ex, "Churn = 'No'", CATS),
        "proportions_churn_yes": P.condition_proportions(ex, "Churn = 'Yes'", CATS),
        "chi_square": ST.chi_square(ex, CATS, "Churn"),
        "mann_whitney": ST.mann_whitney(ex, NUMS, "Churn", positive="Yes"),
    }


def evaluation(fit: TR.Fitted) -> dict:
    art = fit.artifacts
    scored = TR.scored(fit.test, art)
    pred = EV.apply_threshold(scored, "proba", art.threshold)
    auc = EV.auc(scored, "proba", "Churn")
    return {
        "roc_curve": EV.roc_curve(scored, "proba", "Churn"),
        "auc": auc,
        "confusion_matrix": EV.confusion_matrix(pred, "pred", "Churn"),
        "classification_metrics": EV.classification_metrics(pred, "pred", "Churn"),
        "scorecard": EV.scorecard(pred, "pred", "Churn", auc),
        "feature_importance": M.feature_importance(art.model, art.features, top=10),
        "shap_summary": XP.shap_summary(XP.shap_values(fit.test, art.model, art.features, "customerID")),
    }


def run_offline(spark: SparkSession, sf_dir: str, out_dir: str, params: dict | None = None,
                tune: dict | None = None) -> TR.Fitted:
    """``tune``: arguments of ``training.fit_tuned`` ({"folds": 10} searches the full grid); without it ``params`` are fitted."""
    # one pass over orders: the per-customer table is written once and every
    # report, the encoding and the fit read it (lineage cut at a shared table)
    IO.sink_table(customers_raw(spark, sf_dir), f"{out_dir}/raw", mode="overwrite")
    raw = spark.read.parquet(f"{out_dir}/raw")
    for name, df in exploration(raw).items():
        IO.sink_table(df, f"{out_dir}/reports/{name}", mode="overwrite")
    encoding = E.learn_features(raw)
    prepared = E.prepare_features(raw, encoding=encoding)
    IO.sink_table(prepared, f"{out_dir}/prepared", mode="overwrite")
    table = spark.read.parquet(f"{out_dir}/prepared")
    if tune:
        fit, search = TR.fit_tuned(table, **tune)
        IO.sink_table(search, f"{out_dir}/reports/tune_gbt", mode="overwrite")
    else:
        fit = TR.fit_model(table, params)
    fit.artifacts.encoding = encoding
    for name, df in evaluation(fit).items():
        IO.sink_table(df, f"{out_dir}/reports/{name}", mode="overwrite")
    IO.save_artifacts(spark, f"{out_dir}/artifacts", fit.artifacts)
    return fit


if __name__ == "__main__":
    from attrition.session import get_spark
    _spark = get_spark()
    _fit = run_offline(_spark, sys.argv[1], sys.argv[2])
    print(f"threshold={_fit.artifacts.threshold:.4f} features={len(FEATURES)} -> {sys.argv[2]}")
    _spark.stop()
