"""Boosted trees on arrays: the fits of a grid search, each in one task (§2.7).

A search fits some thousand models on the same rows. MLlib runs several jobs for every level of every tree; here the
rows are binned and counted once (``binned``), the counted rows are broadcast, and one task grows all trees of one
(point, fold) and takes the AUC of the held-out rows after each of them. More tasks run on more cores.

The trees are those of MLlib's ``GBTClassifier`` (logistic loss, variance, at most 32 bins from the quantiles of the
fold's training rows, features drawn anew for each node, the first of equal splits). Equal binned rows are one counted
row: a sample of n of them is binomial, and with ``subsample`` below 1 it is another sample than MLlib's, which
follows the partitions. Quantiles are taken from all rows, MLlib takes them from some 10,000.

``binned`` gives nothing if the counted rows are more than a task may hold; the search then fits with MLlib.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from attrition.session import ship_package

MAX_BINS = 32          # MLlib's default
GROUPS = 6_000_000     # counted rows that a task may hold, at some 100 bytes each
VALUES = 4_000_000     # distinct (feature, value, fold, class) that the driver may hold
CLASSES = 1_000        # distinct (label, weight)
CODES = 256            # bins of features counted together
CHUNK = 1 << 15        # rows that are routed and counted at a time
TIE = 1e-10            # gains that differ by less are equal


# ----------------------------------------------------------------------------- bins

def cut_points(values: np.ndarray, weights: np.ndarray, bins: int = MAX_BINS) -> np.ndarray:
    """MLlib's thresholds of one feature: between all distinct values (sorted), or where their weights come closest to
    equal shares."""
    middle = (values[:-1] + values[1:]) / 2.0
    if len(middle) <= bins - 1:
        return middle
    stride = weights.sum() / bins
    found, target, so_far = [], stride, np.cumsum(weights)
    at = 0
    while True:
        # the first value from here on whose successor is further from the target than it is itself
        k = max(at, int(np.searchsorted(so_far, target, side="right")) - 1)
        while k < len(middle) and abs(so_far[k] - target) >= abs(so_far[k + 1] - target):
            k += 1
        if k >= len(middle):
            return np.array(found)
        found.append(middle[k])
        target += stride
        at = k + 1


@dataclass
class Binned:
    """The counted rows of a search: each distinct (fold, class, bins of the features) once."""

    folds: list
    classes: list                     # (label, weight)
    cuts: list                        # per feature: the thresholds of all folds
    fold_cuts: list                   # per fold and feature: the thresholds from the rows without it
    fold: np.ndarray
    cls: np.ndarray                   # place in ``classes``
    codes: list                       # per feature: thresholds below the value; one more than all of them for NaN
    n: np.ndarray


def spread_of(sizes) -> list:
    """(word, factor, radix) of columns packed into as few bigints as they need."""
    spread, word, factor = [], 0, 1
    for radix in sizes:
        if factor * radix >= 1 << 62:
            word, factor = word + 1, 1
        spread.append((word, factor, radix))
        factor *= radix
    return spread


def binned(df: DataFrame, features, target: str, fold_col: str | None, weight: str | None) -> Binned | None:
    """The rows of ``df`` (with a fold, if there are folds) binned and counted; None if they are too many for one task,
    or not as the learner asks for (MLlib's own fit then says what is wrong)."""
    import pyarrow as pa

    if not fold_col:
        df, fold_col = df.withColumn("_all", F.lit(0)), "_all"
    folds = sorted(r[0] for r in df.select(fold_col).distinct().collect() if r[0] is not None)  # k values
    whole = fold_col == "_all"
    if len(folds) < (1 if whole else 2) or not all(isinstance(df.schema[c].dataType, NumericType) for c in (*features, target, *([weight] if weight else []))):
        return None
    ship_package(df.sparkSession)
    xs = [F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features]
    base = df.where(F.col(fold_col).isNotNull()).select(
        (F.array_position(F.array(*[F.lit(f) for f in folds]), F.col(fold_col)) - 1).cast("int").alias("fold"),
        F.col(target).cast("double").alias("y"), (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("w"),
        *[x.alias(f"x{i}") for i, x in enumerate(xs)])
    classes = [(r.y, r.w) for r in base.groupBy("y", "w").count().limit(CLASSES + 1).collect()]
    if len(classes) > CLASSES or not all(y in (0.0, 1.0) and w is not None and 0 <= w < math.inf for y, w in classes):
        return None
    classes.sort()

    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("feature"), F.nanvl(F.col(f"x{i}"), F.lit(0.0)).alias("value"))
                                for i in range(len(xs))])).alias("c")
    counted = base.select("fold", "y", "w", cells).groupBy("c.feature", "c.value", "fold", "y", "w").count()
    values = counted.limit(VALUES + 1).toArrow()
    if values.num_rows > VALUES:
        return None
    feature, value, fold, y, w, n = (c.to_numpy() for c in values.columns)
    order = np.lexsort((y, w, fold, value, feature))
    feature, value, fold, weights, n = feature[order], value[order], fold[order], (w * n)[order], n[order]
    fold_cuts = []
    for k in range(len(folds)):
        mine = fold != (None if whole else k)
        rows = int(n[mine & (feature == 0)].sum())
        of_fold = []
        for i in range(len(xs)):
            some = mine & (feature == i)
            distinct, at = np.unique(value[some], return_inverse=True)
            of_fold.append(cut_points(distinct, np.bincount(at, weights=weights[some], minlength=len(distinct)), min(MAX_BINS, rows)))
        fold_cuts.append(of_fold)
    cuts = [np.unique(np.concatenate([c[i] for c in fold_cuts])) for i in range(len(xs))]
    spread = spread_of([len(folds), len(classes), *(len(c) + 2 for c in cuts)])
    words = spread[-1][0] + 1
    names = [f"k{i}" for i in range(words)]

    def code(batches):
        pairs = np.array(classes)
        for b in batches:
            if not b.num_rows:
                continue
            c = [x.to_numpy(zero_copy_only=False) for x in b.columns]
            cls = np.zeros(b.num_rows, dtype=np.int64)
            for k, (label, wt) in enumerate(pairs):
                cls[(c[1] == label) & (c[2] == wt)] = k
            columns = [c[0].astype(np.int64), cls]
            columns += [np.where(np.isnan(x), len(cut) + 1, np.searchsorted(cut, x)) for x, cut in zip(c[3:], cuts)]
            packed = [np.zeros(b.num_rows, dtype=np.int64) for _ in range(words)]
            for col, (word, factor, _) in zip(columns, spread):
                packed[word] += col * factor
            first, at = distinct_rows([*zip(packed, [1 << 62] * words)])
            yield pa.RecordBatch.from_arrays([*(pa.array(p[first]) for p in packed), pa.array(np.bincount(at).astype(np.int64))], names=[*names, "n"])

    groups = base.mapInArrow(code, ", ".join(f"{k} long" for k in names) + ", n long").groupBy(*names).agg(F.sum("n").alias("n"))
    found = groups.limit(GROUPS + 1).toArrow()
    if found.num_rows > GROUPS:
        return None
    packed = [found.column(k).to_numpy() for k in names]
    order = np.lexsort(packed[::-1])
    columns = [(packed[word] // factor % radix).astype(np.min_scalar_type(radix))[order] for word, factor, radix in spread]
    return Binned(folds, classes, cuts, fold_cuts, columns[0], columns[1], columns[2:], found.column("n").to_numpy()[order])


def distinct_rows(columns) -> tuple:
    """(first, at) of the distinct rows of ``columns`` ((values, radix), the first one counts most), in their order."""
    key, size = columns[0]
    for values, radix in columns[1:]:
        if size * radix >= 1 << 62:
            found, key = np.unique(key, return_inverse=True)
            size = len(found)
            if size * radix >= 1 << 62:
                found, values = np.unique(values, return_inverse=True)
                radix = len(found)
        key = key * radix + values
        size *= radix
    _, first, at = np.unique(key, return_index=True, return_inverse=True)
    return first, at


# ----------------------------------------------------------------------------- one fit

@dataclass
class Trees:
    """A fit: trees, their weights, and the AUC of the held-out rows after each of them."""

    trees: list = field(default_factory=list)
    weights: list = field(default_factory=list)
    aucs: list = field(default_factory=list)


class Rows:
    """The counted rows as one fold's fit sees them: with its own bins, training rows before held-out rows."""

    def __init__(self, table: Binned, fold: int):
        """``fold``: -1 if none is held out."""
        d = len(table.cuts)
        cuts = table.fold_cuts[fold]
        held = (table.fold == fold).astype(np.int64)
        bins = np.empty((len(held), d), dtype=np.uint8)
        for i, (all_cuts, mine) in enumerate(zip(table.cuts, cuts)):
            into = np.searchsorted(mine, np.concatenate([[-np.inf], all_cuts]), side="right")
            nan = np.searchsorted(mine, 0.0), len(mine)  # it is filled with 0 for a fit and above every threshold when scored
            in_train, in_held = (np.array([*into, x], dtype=np.uint8) for x in nan)
            code = table.codes[i]
            bins[:, i] = in_train[code]
            if nan[0] != nan[1] and (odd := (held == 1) & (code == len(all_cuts) + 1)).any():
                bins[odd, i] = in_held[-1]
        cls = table.cls.astype(np.int64)
        first, at = distinct_rows([(held, 2), (cls, len(table.classes)), *((bins[:, i], len(c) + 1) for i, c in enumerate(cuts))])
        self.n = np.bincount(at, weights=table.n).astype(np.int64)
        self.bins, cls, held = np.ascontiguousarray(bins[first]), cls[first], held[first]
        self.train = int((held == 0).sum())
        label, weight = (np.array(x, dtype=np.float64) for x in zip(*table.classes))
        self.sign, self.weight = label[cls] * 2 - 1, weight[cls]
        positive = self.weight[:self.train][self.weight[:self.train] > 0]
        self.least = float(positive.min()) / 2 if len(positive) else 0.0  # less than this is a rounding error
        self.cuts, self.d = cuts, d
        self.features = [i for i in range(d) if len(cuts[i])]
        self.packs = self._packs()

    def _packs(self) -> list:
        """Features whose bins are counted together: (code of each training row, codes, code -> is it left of a split)."""
        packs = []
        for i in sorted(self.features, key=lambda i: (-len(self.cuts[i]), i)):
            size = len(self.cuts[i]) + 1
            fits = [p for p in packs if p[1] * size <= CODES]
            if fits:
                fits[0][0].append(i)
                fits[0][1] *= size
            else:
                packs.append([[i], size])
        offset = dict(zip(self.features, np.cumsum([0, *(len(self.cuts[i]) for i in self.features)])))
        self.splits = sum(len(self.cuts[i]) for i in self.features)
        self.split_feature = np.repeat(self.features, [len(self.cuts[i]) for i in self.features]).astype(np.int64)
        self.split_bin = np.concatenate([np.arange(len(self.cuts[i])) for i in self.features] or [[]]).astype(np.int64)
        out = []
        for some, codes in packs:
            code, each = np.zeros(self.train, dtype=np.int64), np.arange(codes)
            places, left = [], []
            for i in some:
                size = len(self.cuts[i]) + 1
                code = code * size + self.bins[:self.train, i]
            factor = codes
            for i in some:
                size = len(self.cuts[i]) + 1
                factor //= size
                b = each // factor % size
                places.append(offset[i] + np.arange(size - 1))
                left.append(b[:, None] <= np.arange(size - 1))
            out.append((code, codes, np.concatenate(places), np.concatenate(left, axis=1).astype(np.float64)))
        return out


def auc_of(margin: np.ndarray, n: np.ndarray, n_pos: np.ndarray) -> float | None:
    """Exact AUC from mid-ranks of the distinct margins; None without positives or without negatives."""
    _, at = np.unique(margin, return_inverse=True)
    n, n_pos = np.bincount(at, weights=n), np.bincount(at, weights=n_pos)
    n1, n0 = n_pos.sum(), n.sum() - n_pos.sum()
    if not (n1 and n0):
        return None
    r1 = (n_pos * (np.cumsum(n) - n + (n + 1) / 2.0)).sum()
    return float((r1 - n1 * (n1 + 1) / 2.0) / (n1 * n0))


def grow(rows: Rows, target: np.ndarray, count: np.ndarray, depth: int, per_node: int, rng) -> tuple:
    """One regression tree of ``target`` over the training rows, ``count`` of each: (tree, node of every row)."""
    w = rows.weight[:rows.train] * count
    s = w * target
    at = np.zeros(len(rows.n), dtype=np.int64)
    tree = {"left": [-1], "right": [-1], "feature": [-1], "bin": [0], "value": [0.0]}
    total = [(w.sum(), s.sum())]
    if total[0][0]:
        tree["value"][0] = total[0][1] / total[0][0]
    open_nodes, route = [0], None
    for _ in range(depth if rows.splits else 0):
        m = len(open_nodes)
        place = np.full(len(tree["left"]), m)
        place[open_nodes] = np.arange(m)
        sums = [[np.zeros((m + 1) * codes) for _, codes, _, _ in rows.packs] for _ in range(2)]
        for a in range(0, len(at), CHUNK):
            if route:
                step(rows, at, a, route)
            b = min(a + CHUNK, rows.train)
            if a >= b:
                continue
            here, wt, st = place[at[a:b]], w[a:b], s[a:b]
            for k, (code, codes, _, _) in enumerate(rows.packs):
                key = here * codes
                key += code[a:b]
                sums[0][k] += np.bincount(key, wt, (m + 1) * codes)
                sums[1][k] += np.bincount(key, st, (m + 1) * codes)
        route = None
        sides = np.empty((2, 2, m, rows.splits))  # summed on both sides: a difference would make equal leaves unequal
        for k, (_, codes, places, is_left) in enumerate(rows.packs):
            for j in (0, 1):
                cells = sums[j][k][:m * codes].reshape(m, codes)
                sides[0, j][:, places], sides[1, j][:, places] = cells @ is_left, cells @ (1 - is_left)
        (wl, sl), (wr, sr) = sides
        wt, st = (np.array([total[i][j] for i in open_nodes])[:, None] for j in (0, 1))
        valid = (wl > rows.least) & (wr > rows.least)
        if per_node < rows.d:
            drawn = np.zeros((m, rows.d), dtype=bool)
            np.put_along_axis(drawn, rng.random((m, rows.d)).argsort(axis=1)[:, :per_node], True, axis=1)
            valid &= drawn[:, rows.split_feature]
        with np.errstate(divide="ignore", invalid="ignore"):
            parts = sl * sl / wl + sr * sr / wr
            gain = np.where(valid, parts - st * st / wt, -np.inf)
            best = gain.max(axis=1)
            close = gain >= (best - TIE * np.abs(best))[:, None]
        chosen = close.argmax(axis=1)  # the first one
        each = np.arange(m)
        ok = valid[each, chosen] & (best > 1e-12 * np.where(valid, parts, 0.0)[each, chosen])
        if not ok.any():
            break
        nxt = []
        for j in np.flatnonzero(ok):
            i, c = open_nodes[j], chosen[j]
            tree["left"][i], tree["right"][i] = len(tree["left"]), len(tree["left"]) + 1
            tree["feature"][i], tree["bin"][i] = int(rows.split_feature[c]), int(rows.split_bin[c])
            for cw, cs in ((wl[j, c], sl[j, c]), (wr[j, c], sr[j, c])):
                nxt.append(len(tree["left"]))
                total.append((cw, cs))
                for name, v in (("left", -1), ("right", -1), ("feature", -1), ("bin", 0), ("value", cs / cw)):
                    tree[name].append(v)
        route, open_nodes = way(tree), nxt
    if route:
        for a in range(0, len(at), CHUNK):
            step(rows, at, a, route)
    types = {"left": np.int32, "right": np.int32, "feature": np.int16, "bin": np.uint8, "value": np.float64}
    return {k: np.array(v, dtype=types[k]) for k, v in tree.items()}, at


def way(tree: dict) -> tuple:
    """feature, bin and children of each node, as ``step`` takes them; a leaf leads to itself."""
    left, right, feature, split = (np.asarray(tree[k], dtype=np.int64) for k in ("left", "right", "feature", "bin"))
    stay = np.arange(len(left))
    return np.maximum(feature, 0), split, np.stack([np.where(left < 0, stay, left), np.where(left < 0, stay, right)], axis=1).ravel()


def leaves(rows: Rows, tree: dict, depth: int) -> np.ndarray:
    """The leaf of every row."""
    at, route = np.zeros(len(rows.n), dtype=np.int64), way(tree)
    for a in range(0, len(at), CHUNK):
        for _ in range(depth if tree["left"][0] >= 0 else 0):
            step(rows, at, a, route)
    return at


def step(rows: Rows, at: np.ndarray, a: int, route: tuple) -> None:
    """The rows of a chunk go one level down."""
    feature, split, child = route
    here = at[a:a + CHUNK]
    some = rows.bins[a:a + CHUNK]
    x = some.ravel()[np.arange(len(here)) * rows.d + feature[here]]
    at[a:a + CHUNK] = child[here * 2 + (x > split[here])]


def node_stats(rows: Rows, tree: dict, at: np.ndarray, target: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Per node: sampled rows, and the sums of weight, weight x target, weight x target squared over them."""
    w, size = rows.weight[:rows.train] * count, len(tree["left"])
    stats = np.stack([np.bincount(at[:rows.train], x, size) for x in (count, w, w * target, w * target * target)], axis=1)
    for i in range(size - 1, -1, -1):
        if tree["left"][i] >= 0:
            stats[i] = stats[tree["left"][i]] + stats[tree["right"][i]]
    return stats


def fit(rows: Rows, depth: int, eta: float, subsample: float, colsample: float, rounds: int, seed: int, start: Trees | None = None,
        stats: bool = False) -> Trees:
    """Trees up to ``rounds``, with the AUC of the held-out rows after each; those of ``start`` are taken over."""
    t, per_node = rows.train, math.ceil(colsample * rows.d)
    sign, n = rows.sign[:t], rows.n[:t]
    held_n, held_pos = rows.n[t:], rows.n[t:] * (rows.sign[t:] > 0)
    many = np.flatnonzero(n > 1)
    margin = np.zeros(len(rows.n))
    found = Trees([*start.trees], [*start.weights], [*start.aucs]) if start else Trees()
    for tree, weight in zip(found.trees, found.weights):
        margin += weight * tree["value"][leaves(rows, tree, depth)]
    for r in range(len(found.trees), rounds):
        rng = np.random.default_rng([seed, r])
        count = n
        if subsample < 1:
            count = (rng.random(t) < subsample).astype(np.int64)
            count[many] = rng.binomial(n[many], subsample)
        target = 4 * sign / (1 + np.exp(2 * sign * margin[:t])) if r else sign
        tree, at = grow(rows, target, count, depth, per_node, rng)
        if stats:
            tree["stats"] = node_stats(rows, tree, at, target, count)
        found.trees.append(tree)
        found.weights.append(eta if r else 1.0)
        margin += found.weights[-1] * tree["value"][at]
        found.aucs.append(auc_of(margin[t:], held_n, held_pos))
    return found


# ----------------------------------------------------------------------------- the fits of a search

class Shared:
    """The counted rows of a search, on every executor."""

    def __init__(self, spark: SparkSession, table: Binned):
        self.context, self.folds = spark.sparkContext, table.folds
        self.table = self.context.broadcast(table)

    def without(self, fold) -> Part:
        return Part(self, self.folds.index(fold))

    def whole(self) -> Part:
        return Part(self, -1)

    def drop(self) -> None:
        self.table.destroy()


@dataclass
class Part:
    """The counted rows without one fold, which is held out; ``start``: what was fitted on them before."""

    rows: Shared
    fold: int
    start: Trees | None = None

    def after(self, start: Trees | None) -> Part:
        return Part(self.rows, self.fold, start)

    def fit(self, params: dict, seed: int) -> Trees:
        """A job of one task."""
        table, fold, start = self.rows.table, self.fold, self.start
        args = (int(params["max_depth"]), float(params["eta"]), float(params["subsample"]), float(params["colsample_bytree"]), int(params["rounds"]), seed)
        return self.rows.context.parallelize([fold], 1).map(lambda f: fit(Rows(table.value, f), *args, start, f < 0)).collect()[0]


# ----------------------------------------------------------------------------- as MLlib's model

NODES = ("treeID int, nodeData struct<id: int, prediction: double, impurity: double, impurityStats: array<double>, rawCount: bigint, gain: double, "
         "leftChild: int, rightChild: int, split: struct<featureIndex: int, leftCategoriesOrThreshold: array<double>, numCategories: int>>")


def write_model(spark: SparkSession, found: Trees, cuts: list, gbt, path: str) -> None:
    """A whole fit in the form in which MLlib saves the model of the estimator ``gbt``."""
    def metadata(kind, uid, params, **more):
        return json.dumps({"class": f"org.apache.spark.ml.{kind}", "timestamp": int(time.time() * 1000), "sparkVersion": spark.version, "uid": uid,
                           "paramMap": {p.name: v for p, v in gbt._paramMap.items() if p.name in params},
                           "defaultParamMap": {p.name: v for p, v in gbt._defaultParamMap.items() if p.name in params}, **more})

    every = {p.name for p in gbt.params}
    of_tree = every - {"lossType", "validationTol", "stepSize", "maxIter", "subsamplingRate", "featureSubsetStrategy", "rawPredictionCol", "probabilityCol"}
    top = metadata("classification.GBTClassificationModel", gbt.uid, every, numFeatures=len(cuts), numTrees=len(found.trees))
    spark.createDataFrame([(top,)], "value string").coalesce(1).write.text(f"{path}/metadata")
    trees = [(t, metadata("regression.DecisionTreeRegressionModel", f"dtr_{uuid.uuid4().hex[:12]}", of_tree), float(w)) for t, w in enumerate(found.weights)]
    spark.createDataFrame(trees, "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{path}/treesMetadata")
    nodes = []
    for t, tree in enumerate(found.trees):
        count, w, s, q = tree["stats"].T
        some = np.where(w > 0, w, 1.0)
        impurity = np.maximum(q / some - (s / some) ** 2, 0.0)
        for i, (left, right, f, b, value) in enumerate(zip(*(tree[k].tolist() for k in ("left", "right", "feature", "bin", "value")))):
            gain = float(impurity[i] - (w[left] * impurity[left] + w[right] * impurity[right]) / some[i]) if left >= 0 else -1.0
            split = (f, [float(cuts[f][b])], -1) if left >= 0 else (-1, [], -1)
            nodes.append((t, (i, value, float(impurity[i]), [float(w[i]), float(s[i]), float(q[i])], int(count[i]), gain, left, right, split)))
    spark.createDataFrame(nodes, NODES).coalesce(1).write.parquet(f"{path}/data")
