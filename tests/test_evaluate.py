import numpy as np
import pytest
from pyspark.sql import functions as F

from attrition.operators import evaluate as EV


@pytest.fixture(scope="module")
def scores(spark):
    rng = np.random.default_rng(9)
    y = rng.integers(0, 2, 400)
    s = np.round(y * 0.3 + rng.random(400), 2)
    return spark.createDataFrame([(float(a), int(b)) for a, b in zip(s, y)], "s double, y int")


def test_auc_equals_u_statistic(scores):
    pdf = scores.toPandas()
    pos, neg = pdf.s[pdf.y == 1].to_numpy(), pdf.s[pdf.y == 0].to_numpy()
    u = sum(((p > n) + 0.5 * (p == n)) for p in pos for n in neg)
    a = EV.auc(scores, "s", "y").first()
    assert a["auc"] == pytest.approx(u / (len(pos) * len(neg)), abs=1e-6)
    assert EV.auc(scores, "s", "y", method="window").first()["auc"] == a["auc"]
    flipped = EV.auc(scores.withColumn("s", -F.col("s")), "s", "y").first()["auc"]
    assert flipped == pytest.approx(1 - a["auc"], abs=1e-6)


def test_roc_monotone_and_youden(scores):
    roc = EV.roc_curve(scores, "s", "y").orderBy("threshold").collect()
    assert roc[0]["threshold"] == float("-inf") and roc[-1]["threshold"] == float("inf")
    assert (roc[0]["tpr"], roc[0]["fpr"]) == (1.0, 1.0) and (roc[-1]["tpr"], roc[-1]["fpr"]) == (0.0, 0.0)
    assert all(a["tpr"] >= b["tpr"] and a["fpr"] >= b["fpr"] for a, b in zip(roc, roc[1:]))
    best = max(r["sensitivity"] + r["specificity"] - 1 for r in roc)
    y = EV.youden_threshold(scores, "s", "y").first()
    assert y["j"] == pytest.approx(best, abs=1e-6)


def test_metrics_division_by_zero_is_null(spark):
    df = spark.createDataFrame([(0, 0), (0, 0)], "pred int, y int")
    m = {r["metric"]: r["value"] for r in EV.classification_metrics(df, "pred", "y").collect()}
    assert m["accuracy"] == 1.0 and m["sensitivity"] is None and m["ppv"] is None


def test_scorecard_bands(spark, scores):
    pred = EV.apply_threshold(scores, "s", 0.6)
    card = EV.scorecard(pred, "pred", "y", EV.auc(scores, "s", "y")).collect()
    assert len(card) == 5
    for r in card:
        band = "green" if r["value"] >= 0.8 else "yellow" if r["value"] >= 0.65 else "red"
        assert r["band"] == band and r["pct"].endswith("%")
    assert sorted(r["position"] for r in card) == [1, 2, 3, 4, 5]
