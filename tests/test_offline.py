from attrition.plans.offline import run_offline
from attrition.session import scratch_path
from attrition.sources import io as IO

from .conftest import SF_SMALL


def test_offline_run_writes_reports_and_artifacts(spark):
    out = scratch_path(spark, "offline-test")
    fit = run_offline(spark, SF_SMALL, out, {"rounds": 3, "max_depth": 2})
    card = spark.read.parquet(f"{out}/reports/scorecard").collect()
    assert len(card) == 5
    assert spark.read.parquet(f"{out}/reports/chi_square").count() == 11
    loaded = IO.load_artifacts(spark, f"{out}/artifacts")
    assert loaded.threshold == fit.artifacts.threshold and loaded.features == fit.artifacts.features
