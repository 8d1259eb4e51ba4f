"""Global ranks without a single-task window (§2.6).

A ``Window.orderBy(x)`` with no partition key pulls every row into one task.
``prefix_sums`` instead shuffles the (pre-aggregated) rows once:

1. they are range-partitioned by ``(keys, order)``, sorted inside each
   partition and tagged with its id; the result is checkpointed to the shared
   checkpoint directory, because range bounds are sampled and partitions must
   not change between the passes below (and a lost executor must not recompute
   others);
2. a key's rows lie in one run of partitions, so a partition needs nothing from
   the ones before it but the sums of its own first key: each gives one row
   (first key, last key, the sums of the last key), and the driver adds up these
   P rows in order, whatever the number of keys;
3. a second pass over the checkpoint reads each partition in order, in Arrow
   batches, and adds running sums from there: no window, no join, no shuffle.

Callers pre-aggregate to one row per distinct value first, so a value held
by a third of all rows is a single row here.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attrition.session import checkpoint_root, ship_package


RANGE_ROWS = 100_000  # rows of a range partition


def distinct_counts(df: DataFrame, cols, label: str | None = None, positive=1) -> DataFrame:
    """(variable, value, n[, n_pos]) for numeric ``cols``; nulls dropped.

    Unpivot + one partial aggregate: the shuffle carries one row per distinct
    (variable, value) per input split.
    """
    sel = [F.col(c).cast("double").alias(c) for c in cols]
    ids = []
    if label is not None:
        sel.append(F.when(F.col(label) == positive, 1).otherwise(0).alias("_pos"))
        ids = ["_pos"]
    long = df.select(*sel).unpivot(ids, list(cols), "variable", "value").filter(F.col("value").isNotNull())
    aggs = [F.count(F.lit(1)).alias("n")]
    if label is not None:
        aggs.append(F.sum("_pos").alias("n_pos"))
    return long.groupBy("variable", "value").agg(*aggs)


def prefix_sums(d: DataFrame, keys, order: str, measures, partitions: int | None = None,
                maxes=()) -> DataFrame:
    """``d`` plus ``cum_<m>``: sum of the whole number ``m`` over rows with the same keys and a
    strictly smaller ``order`` value (exclusive prefix). ``order`` must be
    unique within keys (pre-aggregate first). For each column in ``maxes``,
    ``prev_<m>`` is the running max over those earlier rows (for ``m`` =
    ``order`` that is the previous distinct value — a lag without a global
    window)."""
    keys, measures, maxes = list(keys), list(measures), list(maxes)
    types = {f.name: f.dataType for f in d.schema.fields}
    bad = [m for m in measures if not isinstance(types[m], T.IntegralType)]
    if bad:
        raise TypeError(f"counts are summed, {bad} are not whole numbers")
    spark = d.sparkSession
    checkpoint_root(spark)
    ship_package(spark)
    # range sampling and the checkpoint write both read ``d``: compute it once
    d_cached = d.persist(StorageLevel.MEMORY_AND_DISK)
    # as many ranges as the rows need: a default of hundreds makes tasks x ranges tiny files of a few thousand rows
    partitions = partitions or max(1, -(-d_cached.count() // RANGE_ROWS))
    ranged = d_cached.coalesce(partitions).repartitionByRange(partitions, *keys, order)
    r = ranged.sortWithinPartitions(*keys, order).withColumn("_pid", F.spark_partition_id())
    r = r.checkpoint(eager=True)
    d_cached.unpersist()

    def ends(batches):
        pid, first, state = None, None, Running(keys, measures, maxes)
        for b in batches:
            if b.num_rows:
                if pid is None:
                    pid, first = b.column("_pid")[0].as_py(), state.key(b, 0)
                state.add(b)
        if pid is not None:
            yield pa.RecordBatch.from_arrays([pa.array([pid], pa.int32()), pa.array([pickle.dumps((first, state.last, state.sums, state.tops))], pa.binary())], names=["pid", "ends"])

    found = r.select("_pid", *dict.fromkeys([*keys, *measures, *maxes])).mapInArrow(ends, "pid int, ends binary").collect()  # one row a partition
    start, carried = {}, None
    for pid, row in sorted((x["pid"], x["ends"]) for x in found):
        first, last, sums, tops = pickle.loads(row)
        if carried is not None and carried[0] == first:
            start[pid] = carried
            if last == first:
                sums = [x + y for x, y in zip(sums, carried[1])]
                tops = [max((x for x in pair if x is not None), default=None) for pair in zip(tops, carried[2])]
        carried = last, sums, tops

    def run(batches):
        state = Running(keys, measures, maxes)
        for k, b in enumerate(x for x in batches if x.num_rows):
            if not k:
                state.begin(start.get(b.column("_pid")[0].as_py()))
            added = state.add(b)
            keep = [n for n in b.schema.names if n != "_pid"]
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in keep], *added], names=[*keep, *out])

    out = [f"cum_{m}" for m in measures] + [f"prev_{m}" for m in maxes]
    schema = T.StructType([*d.schema.fields, *[T.StructField(f"cum_{m}", T.LongType()) for m in measures], *[T.StructField(f"prev_{m}", types[m]) for m in maxes]])
    return r.mapInArrow(run, schema)


class Running:
    """Sums and maxima over the rows of one key met so far, where equal keys follow each other."""

    def __init__(self, keys, measures, maxes):
        self.keys, self.measures, self.maxes = keys, measures, maxes
        self.last, self.sums, self.tops = None, [0] * len(measures), [None] * len(maxes)

    def begin(self, state) -> None:
        if state is not None:
            self.last, self.sums, self.tops = state[0], list(state[1]), list(state[2])

    def key(self, b, i: int) -> tuple:
        return tuple(b.column(k)[i].as_py() for k in self.keys)

    def add(self, b) -> list:
        """Per measure the sum, per maximum the greatest value, of the rows of the same key before each row of ``b``."""
        new = np.zeros(b.num_rows, dtype=bool)
        new[0] = self.last is None or self.key(b, 0) != self.last
        for k in self.keys:
            c = b.column(k)
            same = pc.or_(pc.fill_null(pc.equal(c[1:], c[:-1]), False), pc.and_(c[1:].is_null(), c[:-1].is_null()))
            new[1:] |= ~same.to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(new)
        group = np.cumsum(new)  # 0: the key that was met before this batch
        self.last, out = self.key(b, b.num_rows - 1), []
        for i, m in enumerate(self.measures):
            x = pc.fill_null(b.column(m).cast(pa.int64()), 0).to_numpy(zero_copy_only=False)
            total = np.cumsum(x)
            before = total - x
            base = np.concatenate([[-self.sums[i]], before[starts]])  # what the sum was where the key began
            out.append(pa.array(before - base[group]))
            self.sums[i] = int(total[-1] - base[group[-1]])
        for i, m in enumerate(self.maxes):
            values, seen, tops = b.column(m).to_pylist(), self.tops[i], []
            for v, fresh in zip(values, new, strict=True):
                seen = None if fresh else seen
                tops.append(seen)
                seen = v if seen is None or v is not None and v > seen else seen
            self.tops[i] = seen
            out.append(pa.array(tops, b.schema.field(m).type))
        return out


def prefix_sums_naive(d: DataFrame, keys, order: str, measures, maxes=()) -> DataFrame:
    """Same result with one window per key — the single-task baseline for benches."""
    w = (Window.partitionBy(*keys) if keys else Window).orderBy(order) \
        .rowsBetween(Window.unboundedPreceding, -1)
    return d.select(*d.columns, *[F.coalesce(F.sum(m).over(w), F.lit(0)).alias(f"cum_{m}")
                                  for m in measures],
                    *[F.max(m).over(w).alias(f"prev_{m}") for m in maxes])


def rank_summary(p: DataFrame, keys, order: str, quantiles=(), hinges=(), extra=None) -> DataFrame:
    """Several rank statistics per key in ONE join + aggregation over a
    prefix-summed distinct-value table (``cum_<c>`` beside each count ``c``).

    * ``quantiles``: (name, count_col, q) — type-7 quantile (R default,
      DuckDB ``quantile_cont``) of the rows weighted by ``count_col``;
    * ``hinges``: (prefix, count_col) — Tukey's hinges ``<prefix>lower_hinge``
      and ``<prefix>upper_hinge`` (five-number summary: with
      n4 = floor((n+3)/2)/2, the mean of the order statistics at floor/ceil
      of n4 and of n + 1 − n4, 1-based);
    * ``extra``: {name: aggregate Column} over the same rows.

    The order statistic with 0-based index i is the value whose
    [cum, cum + n) interval contains i — no value map, no global window.
    Group sizes are joined back; the planner broadcasts them where they are few (variables).
    """
    keys, quantiles, hinges, extra = list(keys), list(quantiles), list(hinges), dict(extra or {})
    if not keys:  # one global group: join on a constant key (no cross join)
        p, keys = p.withColumn("_all", F.lit(0)), ["_all"]
    counts = sorted({c for _, c, _ in quantiles} | {c for _, c in hinges})
    tot = p.groupBy(*keys).agg(*[F.sum(c).alias(f"_N_{c}") for c in counts])
    j = p.join(tot, keys)
    picks, post = {}, {}
    for name, c, q in quantiles:
        def h(n, q=q):
            return (n - 1) * F.lit(float(q))
        picks[f"_{name}_lo"] = (c, lambda n, h=h: F.floor(h(n)))
        picks[f"_{name}_hi"] = (c, lambda n, h=h: F.least(F.floor(h(n)) + 1, n - 1))
        n_c = F.col(f"_N_{c}")
        post[name] = F.col(f"_{name}_lo") + (h(n_c) - F.floor(h(n_c))) * \
            (F.col(f"_{name}_hi") - F.col(f"_{name}_lo"))
    for prefix, c in hinges:
        def n4(n):
            return F.floor((n + 3) / 2) / 2
        picks[f"_{prefix}l1"] = (c, lambda n, n4=n4: F.floor(n4(n)) - 1)
        picks[f"_{prefix}l2"] = (c, lambda n, n4=n4: F.ceil(n4(n)) - 1)
        picks[f"_{prefix}u1"] = (c, lambda n, n4=n4: F.floor(n + 1 - n4(n)) - 1)
        picks[f"_{prefix}u2"] = (c, lambda n, n4=n4: F.ceil(n + 1 - n4(n)) - 1)
        post[f"{prefix}lower_hinge"] = (F.col(f"_{prefix}l1") + F.col(f"_{prefix}l2")) / 2
        post[f"{prefix}upper_hinge"] = (F.col(f"_{prefix}u1") + F.col(f"_{prefix}u2")) / 2
    aggs = []
    for name, (c, fn) in picks.items():
        cum, i = F.col(f"cum_{c}"), fn(F.col(f"_N_{c}"))
        aggs.append(F.max(F.when((cum <= i) & (i < cum + F.col(c)), F.col(order))).alias(name))
    aggs += [F.first(f"_N_{c}").alias(f"_N_{c}") for c in counts]
    g = j.groupBy(*keys).agg(*aggs, *[e.alias(n) for n, e in extra.items()])
    return g.select(*[k for k in keys if k != "_all"], *[v.alias(k) for k, v in post.items()], *extra)


def quantile_values(p: DataFrame, keys, order: str, count_col: str, probs: dict) -> DataFrame:
    """Type-7 quantiles per key (keys..., one column per prob name);
    see ``rank_summary``."""
    return rank_summary(p, keys, order, quantiles=[(n, count_col, q) for n, q in probs.items()])


def order_stats(p: DataFrame, keys, order: str, count_col: str, index_fns: dict) -> DataFrame:
    """Order statistics per key from a prefix-summed distinct-value table.

    ``index_fns`` maps an output name to a function of the group size column
    returning a 0-based index Column; the value whose [cum, cum + n) interval
    holds that index is returned. One aggregation; group sizes are joined back.
    """
    keys = list(keys)
    cum = F.col(f"cum_{count_col}")
    tot = p.groupBy(*keys).agg(F.sum(count_col).alias("_N"))
    j = p.join(tot, keys)
    aggs = []
    for name, fn in index_fns.items():
        i = fn(F.col("_N"))
        aggs.append(F.max(F.when((cum <= i) & (i < cum + F.col(count_col)), F.col(order))).alias(name))
    return j.groupBy(*keys).agg(*aggs)


def tukey_hinges(p: DataFrame, keys, order: str, count_col: str) -> DataFrame:
    """keys..., lower_hinge, upper_hinge (box-plot statistics); see ``rank_summary``."""
    return rank_summary(p, keys, order, hinges=[("", count_col)])


def mid_ranks(df: DataFrame, cols) -> DataFrame:
    """variable, value, n, mid_rank: average rank of each distinct value
    (ties share the mean of their positions), ranks 1..N per variable."""
    d = distinct_counts(df, cols)
    p = prefix_sums(d, ["variable"], "value", ["n"])
    return p.select("variable", "value", F.col("n").cast("long").alias("n"),
                    (F.col("cum_n") + (F.col("n") + 1) / 2.0).alias("mid_rank"))


def row_ids(df: DataFrame, order_by: str | None = None, prefix: str = "CLIENT_",
            out: str = "id_client") -> DataFrame:
    """``prefix`` + 1..n.

    With ``order_by`` (should be unique): a two-phase row number in key order.
    Without a key, input order is undefined on Spark; the number follows the
    partition index, then the position inside the partition (for a file scan:
    the file's row order). The tagged rows are materialised ONCE in a reliable
    checkpoint, and both the per-partition counts (≤ #partitions rows) and the
    result read that copy: a shuffle, join or sort below may deal rows
    differently each time it runs, so counting and numbering must not run it twice.
    """
    if order_by is not None:
        d = df.withColumn("_one", F.lit(1))
        p = prefix_sums(d, [], order_by, ["_one"])
        return p.withColumn(out, F.concat(F.lit(prefix), (F.col("cum__one") + 1).cast("string"))) \
            .drop("_one", "cum__one")
    checkpoint_root(df.sparkSession)
    tagged = df.withColumn("_pid", F.spark_partition_id()).withColumn("_mono", F.monotonically_increasing_id()).checkpoint()
    counts = tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_c"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)  # ≤ #partitions rows
    offsets = counts.select("_pid", F.coalesce(F.sum("_c").over(w), F.lit(0)).alias("_off"))
    pos = F.col("_mono") - F.shiftleft(F.col("_pid").cast("long"), 33)
    j = tagged.join(F.broadcast(offsets), "_pid")
    return j.withColumn(out, F.concat(F.lit(prefix), (F.col("_off") + pos + 1).cast("string"))) \
        .drop("_pid", "_mono", "_off")
