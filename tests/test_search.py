"""The registered searches do their whole job."""
import pytest

from attrition.config import CV_FOLDS, EARLY_STOP_ROUNDS, GRID_FULL, MAX_ROUNDS
from attrition.operators import model as M
from attrition.plans import catalog

from .conftest import SF_SMALL


@pytest.mark.parametrize("name", ["train_tuned", "tune_gbt"])
def test_registered_search_covers_the_whole_grid(spark, monkeypatch, name):
    class Asked(Exception):
        pass

    asked = {}

    def asking(df, features, target, grid, **run):
        asked.update(run, points=len(M.grid_points(grid)), grid=grid, folds=df.select("fold").distinct().count())
        raise Asked

    monkeypatch.setattr(M, "tune_gbt", asking)
    with pytest.raises(Asked):
        catalog.QUERIES[name](spark, SF_SMALL)
    assert asked["points"] == 108 and asked["grid"] == GRID_FULL
    assert (asked["folds"], asked["max_rounds"], asked["patience"]) == (CV_FOLDS, MAX_ROUNDS, EARLY_STOP_ROUNDS)
