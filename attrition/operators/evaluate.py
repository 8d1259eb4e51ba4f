"""ROC, AUC, threshold choice and classification metrics (§2.6).

Everything rank-based goes through one pre-aggregation to distinct scores
and the two-phase prefix sum — never a global ``Window.orderBy``.
The metric operators work on the one-row confusion table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attrition.config import BAND_GREEN, BAND_YELLOW, SCORECARD_INDICATORS
from attrition.operators.rank import prefix_sums, prefix_sums_naive


def _score_counts(df: DataFrame, score: str, label: str, positive=1) -> DataFrame:
    return df.filter(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(
        F.col(score).cast("double").alias("s")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.when(F.col(label) == positive, 1).otherwise(0)).alias("n_pos"))


def _roc_counts(df: DataFrame, score: str, label: str, positive=1) -> DataFrame:
    """threshold, hit, pass_, P, Q: positives above and negatives at most the
    threshold, and the class totals, as counts (nothing rounded yet)."""
    d = _score_counts(df, score, label, positive)
    p = prefix_sums(d, [], "s", ["n", "n_pos"], maxes=["s"])
    # class totals and the +inf end row read the checkpointed table, not the input again
    tot = p.agg(F.sum("n_pos").alias("P"), (F.sum("n") - F.sum("n_pos")).alias("Q"))
    P, Q = tot.select("P").scalar(), tot.select("Q").scalar()
    neg_below = F.col("cum_n") - F.col("cum_n_pos")
    thr = F.when(F.col("prev_s").isNull(), F.lit(float("-inf"))) \
        .otherwise((F.col("prev_s") + F.col("s")) / 2.0)
    rows = p.select(thr.alias("threshold"), (P - F.col("cum_n_pos")).alias("hit"), neg_below.alias("pass_"),
                    P.alias("P"), Q.alias("Q"))
    n_neg = F.sum("n") - F.sum("n_pos")
    top = p.agg(F.lit(float("inf")).alias("threshold"), F.lit(0).cast("long").alias("hit"), n_neg.alias("pass_"),
                F.sum("n_pos").alias("P"), n_neg.alias("Q"))
    return rows.unionByName(top)


def roc_curve(df: DataFrame, score: str, label: str, positive=1) -> DataFrame:
    """threshold, tpr, fpr, sensitivity, specificity — one row per distinct
    score (threshold = midpoint with the previous distinct score, −∞ first)
    plus the +∞ end point. A row is predicted positive when score > threshold."""
    c = _roc_counts(df, score, label, positive)
    out = c.select("threshold", F.try_divide("hit", "P").alias("sensitivity"), F.try_divide("pass_", "Q").alias("specificity"))
    return out.select(
        "threshold", F.round("sensitivity", 6).alias("tpr"), F.round(1 - F.col("specificity"), 6).alias("fpr"),
        F.round("sensitivity", 6).alias("sensitivity"), F.round("specificity", 6).alias("specificity"))


def auc(df: DataFrame, score: str, label: str, positive=1, method: str = "two_phase") -> DataFrame:
    """auc, n_pos, n_neg via mid-ranks: (ΣR₊ − n₊(n₊+1)/2)/(n₊n₋)."""
    d = _score_counts(df, score, label, positive)
    pre = prefix_sums(d, [], "s", ["n"]) if method == "two_phase" else prefix_sums_naive(d, [], "s", ["n"])
    mr = F.col("cum_n") + (F.col("n") + 1) / 2.0
    g = pre.agg(F.sum(F.col("n_pos") * mr).alias("r1"), F.sum("n_pos").alias("n1"),
                (F.sum("n") - F.sum("n_pos")).alias("n0"))
    n1, n0 = F.col("n1").cast("double"), F.col("n0").cast("double")  # products leave bigint
    return g.select(F.round(F.try_divide(F.col("r1") - n1 * (n1 + 1) / 2.0, n1 * n0), 6).alias("auc"),
                    n1.cast("long").alias("n_pos"), n0.cast("long").alias("n_neg"))


def youden_threshold(df: DataFrame, score: str, label: str, positive=1) -> DataFrame:
    """threshold, sensitivity, specificity, j: argmax of J = sens + spec − 1
    (ties → lowest threshold). Distributed top-1 over the ROC rows; compared
    exactly, as hit·Q + pass·P in decimals, and rounded only in the output."""
    c = _roc_counts(df, score, label, positive)
    d = {k: F.col(k).cast("decimal(19,0)") for k in ("hit", "pass_", "P", "Q")}
    best = c.withColumn("_j", d["hit"] * d["Q"] + d["pass_"] * d["P"]) \
        .orderBy(F.col("_j").desc_nulls_last(), F.col("threshold").asc()).limit(1)
    sens, spec = F.try_divide("hit", "P"), F.try_divide("pass_", "Q")
    return best.select("threshold", F.round(sens, 6).alias("sensitivity"), F.round(spec, 6).alias("specificity"),
                       F.round(sens + spec - 1, 6).alias("j"))


def apply_threshold(df: DataFrame, score: str, t, out: str = "pred") -> DataFrame:
    """``score >= t`` → 1 else 0 (``t`` a number or a Column)."""
    tc = t if isinstance(t, Column) else F.lit(float(t))
    return df.withColumn(out, F.when(F.col(score) >= tc, 1).otherwise(0))


def confusion_matrix(df: DataFrame, pred: str, label: str, positive=1) -> DataFrame:
    """tp, fp, tn, fn (positive = ``positive``) in one aggregation."""
    p, y = F.col(pred) == positive, F.col(label) == positive
    return df.agg(F.count_if(p & y).alias("tp"), F.count_if(p & ~y).alias("fp"),
                  F.count_if(~p & ~y).alias("tn"), F.count_if(~p & y).alias("fn"))


METRICS = ["accuracy", "kappa", "sensitivity", "specificity", "ppv", "npv", "precision", "recall",
           "f1", "prevalence", "detection_rate", "detection_prevalence", "balanced_accuracy",
           "no_information_rate", "mcnemar_statistic"]


def metric_columns(cm: DataFrame) -> DataFrame:
    """Wide one-row table of every metric (division by zero → null)."""
    tp, fp, tn, fn = (F.col(c).cast("double") for c in ("tp", "fp", "tn", "fn"))
    n = tp + fp + tn + fn
    d = F.try_divide
    acc = d(tp + tn, n)
    sens, spec = d(tp, tp + fn), d(tn, tn + fp)
    ppv, npv = d(tp, tp + fp), d(tn, tn + fn)
    pe = d((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn), n * n)
    return cm.select(
        acc.alias("accuracy"), d(acc - pe, 1 - pe).alias("kappa"), sens.alias("sensitivity"),
        spec.alias("specificity"), ppv.alias("ppv"), npv.alias("npv"), ppv.alias("precision"),
        sens.alias("recall"), d(2 * ppv * sens, ppv + sens).alias("f1"), d(tp + fn, n).alias("prevalence"),
        d(tp, n).alias("detection_rate"), d(tp + fp, n).alias("detection_prevalence"),
        ((sens + spec) / 2).alias("balanced_accuracy"),
        d(F.greatest(tp + fn, fp + tn), n).alias("no_information_rate"),
        d((F.abs(fp - fn) - 1) * (F.abs(fp - fn) - 1), fp + fn).alias("mcnemar_statistic"))


def classification_metrics(df: DataFrame, pred: str, label: str, positive=1) -> DataFrame:
    """metric, value (rounded to 6) — long form of ``metric_columns``."""
    wide = metric_columns(confusion_matrix(df, pred, label, positive))
    stack = ", ".join(f"'{m}', {m}" for m in METRICS)
    return wide.selectExpr(f"stack({len(METRICS)}, {stack}) AS (metric, value)") \
        .select("metric", F.round("value", 6).alias("value"))


def pct_text(v: Column) -> Column:
    """R ``paste0(round(v * 100, 1), "%")``: no trailing '.0'."""
    return F.concat(F.regexp_replace(F.round(v * 100, 1).cast("string"), r"\.0$", ""), F.lit("%"))


def scorecard(df: DataFrame, pred: str, label: str, auc_df: DataFrame, positive=1) -> DataFrame:
    """indicator, value, pct, band, position — five indicators rounded to 3,
    band ≥ 0.80 green / ≥ 0.65 yellow / else red, positions by value."""
    wide = metric_columns(confusion_matrix(df, pred, label, positive))
    a = auc_df.select("auc").scalar()
    vals = [a, F.col("accuracy"), F.col("recall"), F.col("precision"), F.col("f1")]
    structs = [F.struct(F.lit(name).alias("indicator"), F.round(v, 3).alias("value"))
               for name, v in zip(SCORECARD_INDICATORS, vals)]
    long = wide.select(F.inline(F.array(*structs)))
    band = F.when(F.col("value") >= BAND_GREEN, "green").when(F.col("value") >= BAND_YELLOW, "yellow") \
        .otherwise("red")
    pos = F.row_number().over(Window.orderBy(F.col("value").asc_nulls_first(), F.col("indicator").asc()))
    return long.select("indicator", "value", pct_text(F.col("value")).alias("pct"), band.alias("band"),
                       pos.alias("position"))
