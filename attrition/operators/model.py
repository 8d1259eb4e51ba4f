"""Boosted trees with MLlib (§2.7): train, tune, per-round scores, importance.

The learner is ``GBTClassifier`` (logistic loss): distributed histogram
aggregation per tree level, rounds sequential. Its margin m gives
probability 1/(1 + e^(−2m)) — MLlib's convention, stated here because an
XGBoost margin would use e^(−m).

The fitted trees are read back as a node table (``tree_table``) from the
model's own saved data; its size is bounded by rounds × 2^(depth+1), so it
may be collected and broadcast to tasks (staged scores, SHAP).
"""

from __future__ import annotations

import hashlib
import itertools
from concurrent.futures import ThreadPoolExecutor, wait
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attrition.operators import boost as B
from attrition.operators.rank import prefix_sums
from attrition.session import drop_scratch, scratch_path, ship_package

DEFAULT_PARAMS = {"max_depth": 3, "eta": 0.1, "subsample": 0.8, "colsample_bytree": 0.8, "rounds": 20}


def gbt_estimator(features, target: str, params: dict | None = None, weight: str | None = None,
                  seed: int = 123) -> Pipeline:
    p = {**DEFAULT_PARAMS, **(params or {})}
    assembler = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep")
    # a row's way down a shallow tree costs less than node ids stored and read again at every level; the trees are the same
    gbt = GBTClassifier(labelCol=target, featuresCol="features", lossType="logistic",
                        maxDepth=int(p["max_depth"]), stepSize=float(p["eta"]),
                        subsamplingRate=float(p["subsample"]),
                        featureSubsetStrategy=str(float(p["colsample_bytree"])),
                        maxIter=int(p["rounds"]), seed=seed, cacheNodeIds=False)
    if weight:
        gbt.setWeightCol(weight)
    return Pipeline(stages=[assembler, gbt])


def with_class_weight(df: DataFrame, target: str, weight: float, out: str = "w") -> DataFrame:
    """Positive rows get ``weight`` (= #neg / #pos on train), others 1."""
    return df.withColumn(out, F.when(F.col(target) == 1, F.lit(float(weight))).otherwise(F.lit(1.0)))


def train_gbt(df: DataFrame, features, target: str, params: dict | None = None,
              weight: str | None = None, seed: int = 123) -> PipelineModel | B.Trees:
    """Fit assembler + GBT on ``df`` (nulls in features → 0 beforehand). On the counted rows of a search, which have
    their features, target and weight in them, the same trees are fitted in one task."""
    if isinstance(df, B.Part):
        return df.fit({**DEFAULT_PARAMS, **(params or {})}, seed)
    filled = df.fillna(0, subset=list(features))
    return gbt_estimator(features, target, params, weight, seed).fit(filled)


def train_counted(df: DataFrame, features, target: str, params: dict | None = None,
                  weight: str | None = None, seed: int = 123) -> PipelineModel:
    """``train_gbt`` by the learner of the search: one task on counted rows, given as MLlib's model. Rows that are too
    many for a task are fitted by MLlib."""
    spark, p = df.sparkSession, {**DEFAULT_PARAMS, **(params or {})}
    table = B.binned(df, features, target, None, weight)
    if not table:
        return train_gbt(df, features, target, p, weight, seed)
    pipe, shared, path = gbt_estimator(features, target, p, weight, seed), B.Shared(spark, table), scratch_path(spark, "gbt-model")
    try:
        B.write_model(spark, train_gbt(shared.whole(), features, target, p, weight, seed), table.cuts, pipe.getStages()[-1], path)
        return PipelineModel([pipe.getStages()[0], GBTClassificationModel.load(path)])
    finally:
        shared.drop()
        drop_scratch(spark, path)


def gbt_stage(model) -> GBTClassificationModel:
    return model.stages[-1] if isinstance(model, PipelineModel) else model


def positive_probability(scored: DataFrame, out: str = "proba") -> DataFrame:
    from pyspark.ml.functions import vector_to_array
    return scored.withColumn(out, vector_to_array("probability")[1])


def tune_gbt_cv(df: DataFrame, features, target: str, grid: dict, fold_col: str = "fold",
                weight: str | None = None, rounds: int = 20, parallelism: int = 2, seed: int = 123) -> DataFrame:
    """MLlib ``CrossValidator`` form (AUC at the last round only):
    max_depth, eta, subsample, colsample_bytree, mean_auc, is_best; the first
    grid point with the strictly greatest mean AUC wins."""
    pipe = gbt_estimator(features, target, {"rounds": rounds}, weight, seed)
    gbt = pipe.getStages()[-1]
    names = ["max_depth", "eta", "subsample", "colsample_bytree"]
    points = list(itertools.product(*[grid[n] for n in names]))
    maps = []
    for md, eta, ss, cs in points:
        maps.append({gbt.maxDepth: int(md), gbt.stepSize: float(eta), gbt.subsamplingRate: float(ss),
                     gbt.featureSubsetStrategy: str(float(cs))})
    ev = BinaryClassificationEvaluator(labelCol=target, rawPredictionCol="rawPrediction",
                                       metricName="areaUnderROC")
    k = df.select(fold_col).distinct().count()  # folds are 0..k-1 (kfold_assign)
    cv = CrossValidator(estimator=pipe, estimatorParamMaps=maps, evaluator=ev, foldCol=fold_col,
                        numFolds=k, parallelism=parallelism, seed=seed)
    model = cv.fit(df.fillna(0, subset=list(features)))
    aucs = list(model.avgMetrics)
    best = max(range(len(aucs)), key=lambda i: (aucs[i], -i))
    rows = [(int(md), float(eta), float(ss), float(cs), float(round(a, 6)), i == best)
            for i, ((md, eta, ss, cs), a) in enumerate(zip(points, aucs))]
    return df.sparkSession.createDataFrame(
        rows, "max_depth int, eta double, subsample double, colsample_bytree double, mean_auc double, is_best boolean")


GRID_NAMES = ["max_depth", "eta", "subsample", "colsample_bytree"]
RESULTS = "round int, auc double, point string, fold int"


def grid_points(grid: dict) -> list:
    """[(name, params)] in grid order; the name is the key of a point's results."""
    points = [dict(zip(GRID_NAMES, values, strict=True)) for values in itertools.product(*[grid[n] for n in GRID_NAMES])]
    return [("-".join(f"{n}={p[n]:g}" for n in GRID_NAMES), p) for p in points]


def search_path(df: DataFrame, root: str, features, target: str, fold_col: str, weight: str | None, max_rounds: int, seed: int,
                patience: int | None) -> str:
    """Folder of the search's results: one for each state of the rows and each setting that a result depends on, so
    that a search never takes up results of another one."""
    digest = df.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*features, target, fold_col, *([weight] if weight else [])).cast("decimal(38,0)"))).first()
    key = repr((list(features), target, fold_col, weight, max_rounds, seed, patience, tuple(digest)))
    return f"{root.rstrip('/')}/search-{hashlib.md5(key.encode()).hexdigest()}"


def search_results(spark: SparkSession, path: str) -> DataFrame:
    """round, auc, point, fold of every (point, fold), as far as it is done. A result is one file, which its job's commit
    puts in place, so a search that was ended leaves whole rounds only."""
    try:
        return spark.read.schema(RESULTS).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], RESULTS)


BLOCK = 30  # rounds that the folds of a point are fitted before their means are looked at; then twice as many


def stop_round(by_fold: list, patience: int) -> int | None:
    """The round at which ``_stopped`` ends the scan of these folds' AUCs, or a later one if means are equal but for rounding."""
    best = last = None
    for r, aucs in enumerate(zip(*by_fold), 1):
        known = [a for a in aucs if a is not None]
        mean = sum(known) / len(known) if known else None
        if best is None or mean is not None and mean > best - 1e-12:
            last = r
        if r - last >= patience:
            return r
        best = max((x for x in (best, mean) if x is not None), default=None)
    return None


def search_gbt(df: DataFrame, features, target: str, grid: dict, fold_col: str = "fold", weight: str | None = None,
               max_rounds: int = 100, seed: int = 123, parallelism: int = 4, root: str | None = None, patience: int | None = None) -> str:
    """Fits every grid point without every fold and stores the held-out AUC after each round under ``root`` (a
    shared folder; a fresh one if none is given). What is stored there already is not fitted again: a search that was
    ended goes on where it stood. Returns the folder of the results.

    One fit gives all rounds of a (point, fold); up to ``parallelism`` fits, of any points and folds, are submitted at
    a time. With ``patience`` a point ends after so many rounds without gain of the folds' mean, as ``best_rounds``
    does not look further. The rows are binned and counted once and each fit is one task on them; if they are too many
    for that, each fit is MLlib's, at ``max_rounds``.
    """
    spark = df.sparkSession
    rows = df.select(*features, target, fold_col, *([weight] if weight else [])).persist(StorageLevel.MEMORY_AND_DISK)
    shared = None
    try:
        path = search_path(rows, root or scratch_path(spark, "search"), features, target, fold_col, weight, max_rounds, seed, patience)
        stored: dict = {}
        for r in search_results(spark, path).groupBy("point", "fold").agg(F.sort_array(F.collect_list(F.struct("round", "auc"))).alias("a")).toLocalIterator():
            stored[r.point, r.fold] = [x.auc for x in r.a]  # at most grid x folds x rounds
        folds = sorted(r[0] for r in rows.select(fold_col).distinct().collect() if r[0] is not None)  # k values

        def ended(name, upto):
            got = [stored.get((name, f), []) for f in folds]
            return all(len(g) >= upto for g in got) and (upto >= max_rounds or patience is not None and stop_round([g[:upto] for g in got], patience) is not None)

        points = grid_points(grid)
        steps = [max_rounds]
        while patience is not None and (block := BLOCK << len(steps) - 1) < max_rounds:
            steps.insert(-1, block)
        todo = [(name, params) for name, params in points if not any(ended(name, upto) for upto in steps)]
        table = B.binned(rows, features, target, fold_col, weight) if todo else None
        if table:
            shared = B.Shared(spark, table)
            rows.unpersist()
        else:
            steps = [max_rounds]

        def fit(name, params, f, upto, start):
            """Rounds up to ``upto`` of a (point, fold); what was fitted."""
            if len(stored.get((name, f), [])) >= upto:
                return start
            params = params | {"rounds": upto}
            if shared:
                model = train_gbt(shared.without(f).after(start), features, target, params, weight, seed)
                stored[name, f] = model.aucs
                return model
            model = train_gbt(rows.where(F.col(fold_col) != f), features, target, params, weight, seed)
            held = margin_counts(rows.where(F.col(fold_col) == f), model, features, target)
            round_aucs(held, []).coalesce(1).write.mode("overwrite").parquet(f"{path}/point={name}/fold={f}")
            stored[name, f] = [None] * upto
            return None

        def store(name):
            """The results that a point has so far, a file for each fold."""
            got = [(r, a, f) for f in folds for r, a in enumerate(stored.get((name, f), []), 1)]
            if got:
                spark.createDataFrame(got, "round int, auc double, fold int").coalesce(1).write.mode("overwrite").partitionBy("fold").parquet(f"{path}/point={name}")

        def point(task):
            name, params = task
            found = dict.fromkeys(folds)
            for upto in steps:
                running = {f: fits.submit(fit, name, params, f, upto, found[f]) for f in folds}
                wait(running.values())
                if shared:
                    store(name)
                found = {f: r.result() for f, r in running.items()}
                if ended(name, upto):
                    break

        with ThreadPoolExecutor(max(1, parallelism)) as fits, ThreadPoolExecutor(max(1, parallelism)) as several:
            list(several.map(point, todo))
    finally:
        rows.unpersist()
        if shared:
            shared.drop()
    return path


def best_rounds(results: DataFrame, grid: dict, patience: int = 20) -> DataFrame:
    """max_depth, eta, subsample, colsample_bytree, best_round, mean_auc, is_best: per point the AUC of each round
    averaged over the folds, its first greatest before ``patience`` rounds without gain; the strictly greatest point
    wins, of equal ones the first in grid order. At most grid x rounds rows are ordered."""
    points = grid_points(grid)
    order = results.sparkSession.createDataFrame([(name, i, int(p["max_depth"]), *(float(p[n]) for n in GRID_NAMES[1:])) for i, (name, p) in enumerate(points)],
                                                 "point string, place int, max_depth int, eta double, subsample double, colsample_bytree double")
    means = results.groupBy("point", "round").agg(F.avg("auc").alias("mean_auc"))
    best = _stopped(means, ["point"], patience).groupBy("point").agg(F.max(F.struct("mean_auc", (-F.col("round")).alias("r"))).alias("b"))
    found = order.join(best, "point").select("place", *GRID_NAMES, (-F.col("b.r")).alias("best_round"), F.col("b.mean_auc").alias("mean_auc"))
    first = Window.orderBy(F.col("mean_auc").desc(), "place")  # one row a grid point
    return found.withColumn("is_best", F.row_number().over(first) == 1).orderBy("place").drop("place")


def tune_gbt(df: DataFrame, features, target: str, grid: dict, fold_col: str = "fold", weight: str | None = None,
             max_rounds: int = 100, patience: int = 20, seed: int = 123, parallelism: int = 4, root: str | None = None) -> DataFrame:
    """Grid search with k-fold validation after every round: ``search_gbt``, then ``best_rounds`` of its results.
    With a ``root`` the search can be taken up again and shared by sessions."""
    path = search_gbt(df, features, target, grid, fold_col, weight, max_rounds, seed, parallelism, root, patience)
    return best_rounds(search_results(df.sparkSession, path), grid, patience)


# ----------------------------------------------------------------------------- node table

def tree_table(model, spark: SparkSession | None = None, path: str | None = None) -> DataFrame:
    """tree, weight, node, prediction, raw_count, gain, left, right, feature,
    threshold — read from the model's saved data (a Spark job over a table
    bounded by rounds × nodes)."""
    gbt = gbt_stage(model)
    # the active session is thread-local: callers in worker threads pass theirs
    spark = spark or SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    path = path or scratch_path(spark, "gbt-model")
    gbt.write().overwrite().save(path)
    data = spark.read.parquet(f"{path}/data")
    weights = spark.createDataFrame([(i, float(w)) for i, w in enumerate(gbt.treeWeights)],
                                    "tree int, weight double")
    nd = data.select(F.col("treeID").alias("tree"), "nodeData.*")
    nodes = nd.select(
        "tree", F.col("id").alias("node"), F.col("prediction"), F.col("rawCount").alias("raw_count"),
        F.col("gain"), F.col("leftChild").alias("left"), F.col("rightChild").alias("right"),
        F.col("split.featureIndex").alias("feature"),
        F.when(F.col("leftChild") >= 0, F.col("split.leftCategoriesOrThreshold")[0]).alias("threshold"))
    return nodes.join(F.broadcast(weights), "tree")


def forest_of(model, spark: SparkSession | None = None) -> "Forest":
    """The model's trees as arrays; the saved copy that they are read from is deleted again."""
    spark = spark or SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    path = scratch_path(spark, "gbt-model")
    try:
        return Forest.from_table(tree_table(model, spark, path))
    finally:
        drop_scratch(spark, path)


@dataclass
class Forest:
    """Numpy arrays of all trees (bounded: rounds × 2^(depth+1) nodes)."""

    weights: np.ndarray
    trees: list  # per tree: dict of arrays indexed by node id

    @staticmethod
    def from_table(tt: DataFrame) -> "Forest":
        pdf = tt.toPandas()
        trees, weights = [], []
        for t, g in pdf.groupby("tree", sort=True):
            n = int(g["node"].max()) + 1
            arr = {k: np.full(n, v, dtype=dt) for k, v, dt in
                   [("left", -1, np.int64), ("right", -1, np.int64), ("feature", -1, np.int64),
                    ("threshold", 0.0, np.float64), ("value", 0.0, np.float64), ("count", 0.0, np.float64)]}
            idx = g["node"].to_numpy()
            arr["left"][idx] = g["left"].to_numpy()
            arr["right"][idx] = g["right"].to_numpy()
            arr["feature"][idx] = g["feature"].to_numpy()
            arr["threshold"][idx] = g["threshold"].fillna(0.0).to_numpy()
            arr["value"][idx] = g["prediction"].to_numpy()
            arr["count"][idx] = g["raw_count"].to_numpy()
            trees.append(arr)
            weights.append(float(g["weight"].iloc[0]))
        return Forest(np.array(weights), trees)

    def leaf_values(self, X: np.ndarray, t: int) -> np.ndarray:
        tr = self.trees[t]
        idx = np.zeros(X.shape[0], dtype=np.int64)
        rows = np.arange(X.shape[0])
        while True:
            internal = tr["left"][idx] >= 0
            if not internal.any():
                break
            f = np.where(internal, tr["feature"][idx], 0)
            go_left = X[rows, f] <= tr["threshold"][idx]
            nxt = np.where(go_left, tr["left"][idx], tr["right"][idx])
            idx = np.where(internal, nxt, idx)
        return tr["value"][idx]

    def staged_margins(self, X: np.ndarray) -> np.ndarray:
        """rows × rounds matrix of cumulative margins."""
        contrib = np.stack([self.weights[t] * self.leaf_values(X, t) for t in range(len(self.trees))], axis=1)
        return np.cumsum(contrib, axis=1)


def staged_scores(df: DataFrame, model, features, id_col: str, keep=()) -> DataFrame:
    """id, [keep...], round, margin — margin after each boosting round.

    The forest (bounded) is shipped to tasks in the closure; rows stream
    through ``mapInPandas`` in Arrow batches, all trees evaluated
    vectorised per batch.
    """
    ship_package(df.sparkSession)
    forest = model if isinstance(model, Forest) else forest_of(model, df.sparkSession)
    feats, keep = list(features), list(keep)
    base = df.select(F.col(id_col).cast("string").alias("id"), *keep,
                     *[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in feats])
    keep_schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields if f.name in keep)
    schema = "id string, " + (keep_schema + ", " if keep_schema else "") + "round int, margin double"

    def run(batches):
        for pdf in batches:
            if pdf.empty:
                continue
            m = forest.staged_margins(pdf[feats].to_numpy(dtype=np.float64))
            k = m.shape[1]
            out = {"id": np.repeat(pdf["id"].to_numpy(), k)}
            for c in keep:
                out[c] = np.repeat(pdf[c].to_numpy(), k)
            out["round"] = np.tile(np.arange(1, k + 1, dtype=np.int32), len(pdf))
            out["margin"] = m.reshape(-1)
            yield pd.DataFrame(out)

    return base.mapInPandas(run, schema)


COUNTED = 1_000_000  # distinct margins that a task holds before it hands them on


class MarginCounts:
    """(fold, round, margin) -> rows and positives of the rows met so far, as sorted runs of distinct margins."""

    def __init__(self):
        self.runs, self.held = {}, 0

    def add(self, fold, margins: np.ndarray, positive: np.ndarray) -> None:
        """One row a customer, one column a round."""
        for r in range(margins.shape[1]):
            values, at = np.unique(margins[:, r], return_inverse=True)
            run = values, np.bincount(at, minlength=len(values)), np.bincount(at, weights=positive, minlength=len(values)).astype(np.int64)
            if (fold, r) in self.runs:
                run = self.merged(self.runs[fold, r], run)
                self.held -= len(self.runs[fold, r][0])
            self.runs[fold, r] = run
            self.held += len(run[0])

    @staticmethod
    def merged(one: tuple, other: tuple) -> tuple:
        values, at = np.unique(np.concatenate([one[0], other[0]]), return_inverse=True)
        n, n_pos = (np.zeros(len(values), dtype=np.int64) for _ in range(2))
        for total, k in ((n, 1), (n_pos, 2)):
            np.add.at(total, at, np.concatenate([one[k], other[k]]))
        return values, n, n_pos

    def take(self):
        """All runs, which are then forgotten."""
        for (fold, r), (values, n, n_pos) in self.runs.items():
            yield fold, r + 1, values, n, n_pos
        self.runs, self.held = {}, 0


def margin_counts(df: DataFrame, model, features, label: str, fold: str | None = None) -> DataFrame:
    """[fold], round, margin, n, n_pos: distinct margins after each round and their rows and positives.

    ``model`` is one model (or ``Forest``), or with ``fold`` a mapping from fold to the one that did not see it. Rows
    are counted in the tasks, batch by batch, so what is shuffled grows with the distinct margins, of which there are
    at most as many as combinations of leaves, and never with rows x rounds. Rows without a label count as negative.
    """
    spark = df.sparkSession
    ship_package(spark)
    forests = {k: m if isinstance(m, Forest) else forest_of(m, spark) for k, m in (model.items() if fold else [(None, model)])}
    base = df.select(*([F.col(fold).cast("int").alias("fold")] if fold else []), F.coalesce((F.col(label) == 1).cast("int"), F.lit(0)).alias("pos"),
                     *[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f"x{i}") for i, f in enumerate(features)])
    first = 2 if fold else 1

    def run(batches):
        import pyarrow as pa

        counts = MarginCounts()

        def rows():
            for f, r, values, n, n_pos in counts.take():
                columns = [pa.array(np.full(len(values), f, dtype=np.int32))] if fold else []
                columns += [pa.array(np.full(len(values), r, dtype=np.int32)), pa.array(values), pa.array(n.astype(np.int64)), pa.array(n_pos)]
                yield pa.RecordBatch.from_arrays(columns, names=[*(["fold"] if fold else []), "round", "margin", "n", "n_pos"])

        for b in batches:
            if not b.num_rows:
                continue
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in b.columns[first:]])
            positive = b.column(first - 1).to_numpy(zero_copy_only=False)
            which = b.column(0).to_numpy(zero_copy_only=False) if fold else None
            for f, forest in forests.items():
                mine = which == f if fold else slice(None)
                if len(x[mine]):
                    counts.add(f, forest.staged_margins(x[mine]), positive[mine])
            if counts.held >= COUNTED:
                yield from rows()
        yield from rows()

    found = base.mapInArrow(run, ("fold int, " if fold else "") + "round int, margin double, n long, n_pos long")
    return found.groupBy(*(["fold"] if fold else []), "round", "margin").agg(F.sum("n").alias("n"), F.sum("n_pos").alias("n_pos"))


def round_aucs(counts: DataFrame, keys) -> DataFrame:
    """keys, round, auc of ``margin_counts``: exact, from mid-ranks of the distinct margins."""
    keys = [*keys, "round"]
    p = prefix_sums(counts, keys, "margin", ["n"])
    mr = F.col("cum_n") + (F.col("n") + 1) / 2.0
    g = p.groupBy(*keys).agg(F.sum(F.col("n_pos") * mr).alias("r1"), F.sum("n_pos").alias("n1"),
                             (F.sum("n") - F.sum("n_pos")).alias("n0"))
    n1, n0 = F.col("n1").cast("double"), F.col("n0").cast("double")  # products leave bigint
    return g.select(*keys, F.try_divide(F.col("r1") - n1 * (n1 + 1) / 2.0, n1 * n0).alias("auc"))


def _stopped(means: DataFrame, keys, patience: int) -> DataFrame:
    """The rounds of ``means`` (keys, round, mean_auc) up to the one that makes ``patience`` without gain; later ones
    would not be run. A window holds one key's rounds."""
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    by_round = w.orderBy("round")
    r = means.withColumn("_before", F.max("mean_auc").over(by_round.rowsBetween(Window.unboundedPreceding, -1)))
    r = r.withColumn("_gain", F.when(F.col("_before").isNull() | (F.col("mean_auc") > F.col("_before")), F.col("round")))
    r = r.withColumn("_last", F.max("_gain").over(by_round.rowsBetween(Window.unboundedPreceding, 0)))
    r = r.withColumn("_stop", F.min(F.when(F.col("round") - F.col("_last") >= patience, F.col("round"))).over(w))
    return r.where(F.col("_stop").isNull() | (F.col("round") <= F.col("_stop"))).drop("_before", "_gain", "_last", "_stop")


def choose_rounds(counts: DataFrame, fold: str | None = None, patience: int = 20, digits: int | None = 6) -> DataFrame:
    """round, mean_auc, best of ``margin_counts``: AUC per (fold, round), averaged over folds; the best round is the
    first argmax, scanning stops after ``patience`` rounds without gain. ``digits=None`` leaves the means unrounded."""
    means = round_aucs(counts, [fold] if fold else []).groupBy("round").agg(F.avg("auc").alias("mean_auc"))
    live = _stopped(means, [], patience)  # at most as many rows as rounds
    first = Window.orderBy(F.col("mean_auc").desc_nulls_last(), "round")
    return live.select("round", (F.round("mean_auc", digits) if digits is not None else F.col("mean_auc")).alias("mean_auc"),
                       (F.row_number().over(first) == 1).alias("best"))


def select_rounds(staged: DataFrame, label: str, fold: str | None = None, patience: int = 20,
                  digits: int | None = 6) -> DataFrame:
    """``choose_rounds`` of rows of ``staged_scores`` that are at hand; from a model ``margin_counts`` needs less."""
    keys = ([fold] if fold else []) + ["round"]
    counts = staged.filter(F.col("margin").isNotNull()).groupBy(*keys, "margin").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("n_pos"))
    return choose_rounds(counts, fold, patience, digits)


def feature_importance(model, features, top: int | None = None) -> DataFrame:
    """feature, gain, cover, frequency (shares summing to 1), pct, rank —
    from the node table: gain = Σ gain·raw_count, cover = Σ raw_count,
    frequency = number of splits, per feature."""
    tt = tree_table(model).filter(F.col("left") >= 0)
    names = F.create_map(*[x for i, f in enumerate(features) for x in (F.lit(i), F.lit(f))])
    g = tt.groupBy("feature").agg(F.sum(F.col("gain") * F.col("raw_count")).alias("g"),
                                  F.sum("raw_count").alias("c"), F.count(F.lit(1)).alias("k"))
    tot = g.agg(F.sum("g").alias("tg"), F.sum("c").alias("tc"), F.sum("k").alias("tk"))
    tg, tc, tk = (tot.select(c).scalar() for c in ("tg", "tc", "tk"))
    w = Window.orderBy(F.col("gain").desc(), F.col("feature").asc())  # ≤ #features rows
    out = g.select(names[F.col("feature")].alias("feature"), F.try_divide(F.col("g"), tg).alias("gain"),
                   F.try_divide(F.col("c").cast("double"), tc).alias("cover"),
                   F.try_divide(F.col("k").cast("double"), tk).alias("frequency"))
    out = out.select("*", F.row_number().over(w).alias("rank"))
    out = out.select("feature", F.round("gain", 6).alias("gain"), F.round("cover", 6).alias("cover"),
                     F.round("frequency", 6).alias("frequency"),
                     F.concat(F.regexp_replace(F.round(F.col("gain") * 100, 1).cast("string"), r"\.0$", ""),
                              F.lit("%")).alias("pct"), "rank")
    return out.filter(F.col("rank") <= top) if top else out
