"""Raw customer table → fitted artefacts (the offline flow of the reference).

prepare → hash split → range scaler fit on train only → positive-class
weight (#neg/#pos on train) → GBT → decision threshold (Youden) → artefacts.

Threshold choice: ``threshold_on="holdout"`` (default) picks it on a hash
slice of the training rows that a first model does not see, so the test set
stays untouched for evaluation; the final model is then fitted on ALL training rows; ``"test"`` mimics the reference, which picks
and evaluates on the same test rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attrition.config import CV_FOLDS, EARLY_STOP_ROUNDS, FEATURES, GRID_FULL, MAX_ROUNDS, SPLIT_SEED
from attrition.operators import encode as E
from attrition.operators import evaluate as EV
from attrition.operators import model as M
from attrition.operators import profile as P
from attrition.operators import scale as SC
from attrition.operators import split as SP
from attrition.operators.score import Artifacts
from attrition.session import checkpoint_root

HOLDOUT_SEED = 124


@dataclass
class Fitted:
    artifacts: Artifacts
    train: DataFrame      # scaled training rows (model fit set)
    test: DataFrame       # scaled test rows
    weight: float


def scored(df: DataFrame, art: Artifacts, out: str = "proba") -> DataFrame:
    return M.positive_probability(art.model.transform(df.fillna(0, subset=list(art.features))), out)


def fit_model(prepared: DataFrame, params: dict | None = None, id_col: str = "customerID",
              target: str = "Churn", threshold_on: str = "holdout", features=tuple(FEATURES), train=None) -> Fitted:
    """``train``: ``M.train_gbt`` if none is given, or ``M.train_counted`` to fit as the search does."""
    feats = list(features)
    # the prepared table (one row per customer) is read by several passes below
    checkpoint_root(prepared.sparkSession)
    prepared = prepared.checkpoint()
    split = SP.split_train_test(prepared, id_col, 0.8, SPLIT_SEED)
    train_all = split.filter("is_train")
    test = split.filter(~F.col("is_train"))
    scaler = SC.scaler_params(SC.fit_range_scaler(train_all, feats))  # one row per feature
    x_train = SC.apply_range_scaler(train_all, scaler, feats)
    x_test = SC.apply_range_scaler(test, scaler, feats)
    if threshold_on == "holdout":
        flagged = SP.split_train_test(x_train, id_col, 0.8, HOLDOUT_SEED, out="_fit")
        fit_set, pick_set = flagged.filter("_fit"), flagged.filter(~F.col("_fit"))
    else:
        fit_set, pick_set = x_train, x_test
    def fit_on(rows):
        weight = class_weight(rows, target)
        rows = M.with_class_weight(rows, target, weight).persist(StorageLevel.MEMORY_AND_DISK)
        model = (train or M.train_gbt)(rows, feats, target, params, weight="w")
        rows.unpersist()
        return model, weight

    model, weight = fit_on(fit_set)
    art = Artifacts(model=model, features=feats, scaler=scaler)
    yt = EV.youden_threshold(scored(pick_set, art), "proba", target).first()
    art.threshold = float(yt["threshold"]) if yt is not None else 0.5
    if threshold_on == "holdout":  # the slice has served: fit on all of train
        art.model, weight = fit_on(x_train)
    return Fitted(artifacts=art, train=x_train, test=x_test, weight=float(weight))


def class_weight(rows: DataFrame, target: str) -> float:
    """#neg / #pos from the counts (one-row aggregate), not from the rounded report; 1 without positives."""
    n = P.class_weight(rows, target).first()
    return n["n_neg"] / n["n_pos"] if n["n_pos"] else 1.0


def fit_tuned(prepared: DataFrame, grid: dict | None = None, folds: int = CV_FOLDS, max_rounds: int = MAX_ROUNDS,
              patience: int = EARLY_STOP_ROUNDS, id_col: str = "customerID", target: str = "Churn",
              features=tuple(FEATURES), parallelism: int = 4, root: str | None = None) -> tuple:
    """(Fitted, search table): the per-round k-fold search on the scaled training rows (by default the
    full ``GRID_FULL`` × ``CV_FOLDS`` × ``MAX_ROUNDS``), then ``fit_model`` with the winning point at its
    best round. With a ``root`` (a shared folder) a search that was ended is taken up again."""
    feats = list(features)
    rows = search_rows(prepared, folds, id_col, target, feats)
    search = M.tune_gbt(rows, feats, target, grid or GRID_FULL, fold_col="fold", weight="w",
                        max_rounds=max_rounds, patience=patience, parallelism=parallelism, root=root)
    best = search.filter("is_best").first()  # one row of a table bounded by the grid
    params = {n: best[n] for n in M.GRID_NAMES} | {"rounds": best["best_round"]}
    return fit_model(prepared, params, id_col, target, features=feats, train=M.train_counted), search


def search_rows(prepared: DataFrame, folds: int = CV_FOLDS, id_col: str = "customerID", target: str = "Churn",
                features=tuple(FEATURES)) -> DataFrame:
    """The scaled training rows with their fold and class weight, as the search reads them."""
    checkpoint_root(prepared.sparkSession)
    prepared = prepared.checkpoint()  # read for the scaler, the weight and the rows
    train = SP.split_train_test(prepared, id_col, 0.8, SPLIT_SEED).filter("is_train")
    scaled = SC.apply_range_scaler(train, SC.scaler_params(SC.fit_range_scaler(train, list(features))), list(features))
    return M.with_class_weight(SP.kfold_assign(scaled, id_col, folds), target, class_weight(scaled, target))


_CACHE: dict = {}


def fitted_for(spark, sf_dir: str, raw_fn, params: dict | None = None) -> Fitted:
    """Fit once per (session, data dir) — registered queries share the model. The artefacts keep the training table's
    encoding, so that what is scored with them is prepared without another pass for its levels."""
    key = (spark.sparkContext.applicationId, sf_dir, tuple(sorted((params or {}).items())))
    if key not in _CACHE:
        raw = raw_fn(spark, sf_dir)
        encoding = E.learn_features(raw)
        fit = fit_model(E.prepare_features(raw, encoding=encoding), params)
        fit.artifacts.encoding = encoding
        _CACHE[key] = fit
    return _CACHE[key]
