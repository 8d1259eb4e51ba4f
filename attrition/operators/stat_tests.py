"""Statistical tests (§2.4), all variables at once.

* contingency tests: unpivot → one groupBy(variable, level, target); the
  statistic uses χ² = N·(Σ O²/(r·c) − 1), which needs only the non-empty
  cells, so no dense (level × class) grid is built;
* rank tests: distinct values per (variable, value) → two-phase prefix sum
  (``rank.prefix_sums``) → mid-ranks; medians read off the same prefix sums;
* moments: one aggregation pass.

p-values are computed by pandas UDFs on the result rows (one per variable).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attrition.functions import stats as S
from attrition.operators.profile import long_strings
from attrition.operators.rank import distinct_counts, prefix_sums, quantile_values, rank_summary
from attrition.session import checkpoint_root, ship_package


def _cells(df: DataFrame, cols, target: str) -> DataFrame:
    long = long_strings(df, cols, ids=[target]) \
        .filter(F.col("value").isNotNull() & F.col(target).isNotNull())
    return long.groupBy("variable", F.col("value").alias("level"), F.col(target).cast("string").alias("cls")) \
        .agg(F.count(F.lit(1)).alias("o"))


def chi_square(df: DataFrame, cols, target: str, with_p: bool = True) -> DataFrame:
    """variable, statistic, df, p_value, cramers_v, cramers_v_adj, n (no
    continuity correction; V plain and bias-corrected)."""
    c = _cells(df, cols, target)
    # row totals: a window per (variable, level) holds ≤ #classes cells; column
    # totals are a grouped aggregate (#variables × #classes rows; the planner compares sizes)
    # so no task ever holds all levels of a variable
    col_tot = c.groupBy("variable", "cls").agg(F.sum("o").alias("cc"))
    c = c.select("*", F.sum("o").over(Window.partitionBy("variable", "level")).alias("r")) \
        .join(col_tot, ["variable", "cls"])
    g = c.groupBy("variable").agg(
        F.sum("o").alias("n"),
        F.sum(F.col("o").cast("double") / F.col("r") * F.col("o") / F.col("cc")).alias("s"),
        F.count_distinct("level").alias("nr"),
        F.count_distinct("cls").alias("nc"),
    )
    n, nr, nc = F.col("n").cast("double"), F.col("nr").cast("double"), F.col("nc").cast("double")  # products leave bigint
    stat = n * (F.col("s") - 1)
    m = F.least(nr - 1, nc - 1)
    phi2 = stat / n
    # try_divide: a single-level variable or a one-row table gives null, not an ANSI error
    phi2c = F.greatest(F.lit(0.0), phi2 - F.try_divide((nc - 1) * (nr - 1), n - 1))
    rc = nr - F.try_divide((nr - 1) * (nr - 1), n - 1)
    kc = nc - F.try_divide((nc - 1) * (nc - 1), n - 1)
    out = g.select(
        "variable",
        F.round(stat, 6).alias("statistic"),
        ((nr - 1) * (nc - 1)).cast("long").alias("df"),
        F.round(F.sqrt(F.try_divide(stat, n * m)), 6).alias("cramers_v"),
        F.round(F.sqrt(F.try_divide(phi2c, F.least(kc - 1, rc - 1))), 6).alias("cramers_v_adj"),
        n.cast("long").alias("n"),
        stat.alias("_stat"),
    )
    if with_p:
        ship_package(df.sparkSession)
        out = out.withColumn("p_value", S.chi2_pvalue(F.col("_stat"), F.col("df").cast("double")))
    return out.drop("_stat")


def level_goodness_of_fit(df: DataFrame, cols, target: str, with_p: bool = True) -> DataFrame:
    """variable, level, n, statistic, df, p_value: one-sample χ² of the
    target shares within each level against equal shares."""
    c = _cells(df, cols, target)
    classes = c.groupBy("variable").agg(F.count_distinct("cls").alias("k"))
    g = c.groupBy("variable", "level").agg(F.sum("o").alias("n"), F.sum(F.col("o").cast("double") * F.col("o")).alias("s2"))
    # one row per variable: bounded by the number of columns tested
    g = g.join(F.broadcast(classes), "variable")
    stat = F.col("k") / F.col("n") * F.col("s2") - F.col("n")
    out = g.select("variable", "level", F.col("n").cast("long").alias("n"),
                   F.round(stat, 6).alias("statistic"), (F.col("k") - 1).cast("long").alias("df"),
                   stat.alias("_stat"))
    if with_p:
        ship_package(df.sparkSession)
        out = out.withColumn("p_value", S.chi2_pvalue(F.col("_stat"), F.col("df").cast("double")))
    return out.drop("_stat")


def mann_whitney(df: DataFrame, cols, target: str, positive=1, with_p: bool = True) -> DataFrame:
    """variable, u, rank_biserial, z, p_value, median0, median1, n0, n1.

    U is for the negative class (target ≠ positive); z uses the tie-corrected
    variance and a 0.5 continuity correction; rank_biserial = 2U/(n0·n1) − 1.
    """
    d = distinct_counts(df.filter(F.col(target).isNotNull()), cols, label=target, positive=positive)
    p = prefix_sums(d, ["variable"], "value", ["n", "n_pos"])
    p = p.select("*", (F.col("n") - F.col("n_pos")).alias("n_neg"),
                 (F.col("cum_n") - F.col("cum_n_pos")).alias("cum_n_neg"),
                 (F.col("cum_n") + (F.col("n") + 1) / 2.0).alias("mr"))
    # rank sums, tie term and both class medians in one aggregation
    g = rank_summary(p, ["variable"], "value",
                     quantiles=[("median0", "n_neg", 0.5), ("median1", "n_pos", 0.5)],
                     extra={"n_all": F.sum("n"), "n1": F.sum("n_pos"),
                            "R0": F.sum(F.col("n_neg") * F.col("mr")),
                            "ties": F.sum(F.pow(F.col("n").cast("double"), F.lit(3.0)) - F.col("n"))})
    N, n1 = F.col("n_all").cast("double"), F.col("n1").cast("double")  # products leave bigint
    n0 = N - n1
    u = F.col("R0") - n0 * (n0 + 1) / 2.0
    mu = n0 * n1 / 2.0
    sigma = F.sqrt(n0 * n1 / 12.0 * ((N + 1) - F.try_divide(F.col("ties"), N * (N - 1))))
    z = F.try_divide(u - mu - F.signum(u - mu) * 0.5, sigma)
    out = g.select(
        "variable", F.round(u, 6).alias("u"), F.round(F.try_divide(2 * u, n0 * n1) - 1, 6).alias("rank_biserial"),
        F.round(z, 6).alias("z"), F.round("median0", 6).alias("median0"),
        F.round("median1", 6).alias("median1"), n0.cast("long").alias("n0"), n1.cast("long").alias("n1"),
        z.alias("_z"))
    if with_p:
        ship_package(df.sparkSession)
        out = out.withColumn("p_value", S.normal_pvalue(F.col("_z")))
    return out.drop("_z")


def spearman_matrix(df: DataFrame, cols) -> DataFrame:
    """var1, var2, coef for every pair, on pairwise-complete rows.

    Columns without nulls are ranked once each: a row becomes a vector of centred mid-ranks, and all pairs come from
    one sum of outer products (``_gram``). Only pairs with a column that has nulls are ranked by themselves, on the
    rows that have both (``_pairwise``).
    """
    cols = list(cols)
    holes = df.agg(*[F.count_if(F.col(c).isNull()).alias(f"c{i}") for i, c in enumerate(cols)]).first()
    whole = [c for i, c in enumerate(cols) if not holes[f"c{i}"]]
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    out = []
    if len(whole) > 1:
        out.append(_gram(df, whole))
    rest = [p for p in pairs if not set(p) <= set(whole)]
    if rest:
        out.append(_pairwise(df, rest))
    if not out:
        return df.sparkSession.createDataFrame([], "var1 string, var2 string, coef double")
    return out[0] if len(out) == 1 else out[0].unionByName(out[1])


def _gram(df: DataFrame, cols) -> DataFrame:
    """Coefficients of columns without nulls. Rows are numbered in a reliable checkpoint; each value gets its rank by a
    join on (column, value), whose hot values the planner splits, and a row's ranks come together by its number: two
    shuffles of rows x columns. The sums of products are added up in the tasks (columns x columns numbers each)."""
    import pyarrow as pa

    k = len(cols)
    checkpoint_root(df.sparkSession)
    base = df.select(F.monotonically_increasing_id().alias("_row"), *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(cols)]).checkpoint()
    long = base.unpivot(["_row"], [f"x{i}" for i in range(k)], "variable", "value")
    d = long.groupBy("variable", "value").agg(F.count(F.lit(1)).alias("n"))
    rows = base.count()
    ranks = prefix_sums(d, ["variable"], "value", ["n"]).select(
        "variable", "value", (F.col("cum_n") + (F.col("n") + 1) / 2.0 - (rows + 1) / 2.0).alias("r"))  # their mean is (rows + 1) / 2
    at = F.substring("variable", 2, 9).cast("int")
    vectors = long.join(ranks, ["variable", "value"]).groupBy("_row").agg(F.array_sort(F.collect_list(F.struct(at.alias("i"), "r"))).alias("v"))

    def products(batches):
        total = np.zeros((k, k))
        for b in batches:
            if b.num_rows:
                m = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
                total += m.T @ m
        i, j = np.triu_indices(k)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], names=["i", "j", "s"])

    sums = vectors.select(F.transform("v", lambda x: x["r"]).alias("v")).mapInArrow(products, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s"))
    own = sums.where("i = j")  # one row a column
    x, y = own.select(F.col("i").alias("xi"), F.col("s").alias("sx")), own.select(F.col("j").alias("yj"), F.col("s").alias("sy"))
    names = F.array(*[F.lit(c) for c in cols])
    return (sums.where("i < j").join(x, F.col("i") == F.col("xi")).join(y, F.col("j") == F.col("yj"))
            .select(names[F.col("i")].alias("var1"), names[F.col("j")].alias("var2"),
                    F.round(F.try_divide(F.col("s"), F.sqrt(F.col("sx")) * F.sqrt(F.col("sy"))), 6).alias("coef")))


def _pairwise(df: DataFrame, pairs) -> DataFrame:
    """Coefficients of ``pairs``, each on the rows that have both values. Rows are first reduced to distinct (pair, x, y)
    with a weight, so a value held by a third of the rows becomes few rows; mid-ranks of x and y within each pair come
    from one prefix-sum pass (keys: pair, side)."""
    structs = [F.struct(F.lit(f"{i}").alias("pair"), F.col(a).cast("double").alias("x"),
                        F.col(b).cast("double").alias("y")) for i, (a, b) in enumerate(pairs)]
    pp = df.select(F.inline(F.array(*structs))) \
        .filter(F.col("x").isNotNull() & F.col("y").isNotNull()) \
        .groupBy("pair", "x", "y").agg(F.count(F.lit(1)).alias("w"))
    # read by the rank job and by the final join: written once, nothing left cached
    checkpoint_root(df.sparkSession)
    pp = pp.checkpoint()
    both = pp.select("pair", "w", F.inline(F.array(F.struct(F.lit("x").alias("side"), F.col("x").alias("value")),
                                                   F.struct(F.lit("y").alias("side"), F.col("y").alias("value")))))
    sides = both.groupBy("pair", "side", "value").agg(F.sum("w").alias("n"))
    ranks = prefix_sums(sides, ["pair", "side"], "value", ["n"]) \
        .select("pair", "side", "value", (F.col("cum_n") + (F.col("n") + 1) / 2.0).alias("mr"))
    rx = ranks.filter(F.col("side") == "x").select("pair", F.col("value").alias("x"), F.col("mr").alias("rx"))
    ry = ranks.filter(F.col("side") == "y").select("pair", F.col("value").alias("y"), F.col("mr").alias("ry"))
    j = pp.join(rx, ["pair", "x"]).join(ry, ["pair", "y"])
    w = F.col("w")
    g = j.groupBy("pair").agg(
        F.sum(w).alias("wsum"), F.sum(w * F.col("rx")).alias("sx"), F.sum(w * F.col("ry")).alias("sy"),
        F.sum(w * F.col("rx") * F.col("rx")).alias("sxx"), F.sum(w * F.col("ry") * F.col("ry")).alias("syy"),
        F.sum(w * F.col("rx") * F.col("ry")).alias("sxy"))
    W = F.col("wsum")
    cov = F.col("sxy") - F.col("sx") * F.col("sy") / W
    vx = F.col("sxx") - F.col("sx") * F.col("sx") / W
    vy = F.col("syy") - F.col("sy") * F.col("sy") / W
    first, second = (F.array(*[F.lit(p[i]) for p in pairs]) for i in (0, 1))
    at = F.col("pair").cast("int")
    return g.select(first[at].alias("var1"), second[at].alias("var2"),
                    F.round(F.try_divide(cov, F.sqrt(F.greatest(vx, F.lit(0.0)) * F.greatest(vy, F.lit(0.0)))), 6).alias("coef"))


def normality(df: DataFrame, cols) -> DataFrame:
    """variable, n, skew, kurt, jb, jb_p — Jarque–Bera from population
    skewness and excess kurtosis, one aggregation pass (p = e^(−JB/2), χ²₂)."""
    long = df.select(*[F.col(c).cast("double").alias(c) for c in cols]) \
        .unpivot([], list(cols), "variable", "value").filter(F.col("value").isNotNull())
    g = long.groupBy("variable").agg(F.count(F.lit(1)).alias("n"), F.skewness("value").alias("s"),
                                     F.kurtosis("value").alias("k"))
    jb = F.col("n") / 6.0 * (F.col("s") * F.col("s") + F.col("k") * F.col("k") / 4.0)
    return g.select("variable", F.col("n").cast("long").alias("n"), F.round("s", 6).alias("skew"),
                    F.round("k", 6).alias("kurt"), F.round(jb, 6).alias("jb"),
                    F.round(F.exp(-jb / 2.0), 6).alias("jb_p"))


def ks_normal(df: DataFrame, cols) -> DataFrame:
    """variable, n, ks, ks_p: Kolmogorov–Smirnov distance between the ECDF and a normal with the sample mean and sd, and
    its p-value by Lilliefors' distribution, which holds for a mean and sd fitted to the same rows.

    ECDF from the prefix sums over distinct values; the normal CDF is a column expression. The moments come from the
    same prefix table, the squares around the mean. A constant column, or one of fewer than five rows, has no p.
    """
    checkpoint_root(df.sparkSession)
    p = prefix_sums(distinct_counts(df, cols), ["variable"], "value", ["n"])
    mean = p.groupBy("variable").agg(F.sum("n").alias("_tot"), (F.sum(F.col("value") * F.col("n")) / F.sum("n")).alias("mu"))
    p = p.join(F.broadcast(mean), "variable")  # one row per variable
    sd = p.groupBy("variable").agg(
        F.sqrt(F.try_divide(F.sum(F.col("n") * (F.col("value") - F.col("mu")) ** 2), F.first("_tot") - 1)).alias("sd"))
    p = p.join(F.broadcast(sd), "variable").withColumn("phi", S.normal_cdf_expr(F.try_divide(F.col("value") - F.col("mu"), F.col("sd"))))
    lo = F.abs(F.col("cum_n") / F.col("_tot") - F.col("phi"))
    hi = F.abs((F.col("cum_n") + F.col("n")) / F.col("_tot") - F.col("phi"))
    g = p.groupBy("variable").agg(F.first("_tot").alias("n_obs"), F.max(F.greatest(lo, hi)).alias("ks"))
    return g.select("variable", F.col("n_obs").cast("long").alias("n"), F.round("ks", 6).alias("ks"),
                    F.round(S.lilliefors_p(F.col("ks"), F.col("n_obs").cast("double")), 6).alias("ks_p"))


def qq_points(df: DataFrame, cols, k: int = 99) -> DataFrame:
    """variable, p, theoretical, empirical at p = i/(k+1), i = 1..k:
    standard-normal quantile vs the type-7 sample quantile."""
    probs = {f"q{i}": i / (k + 1) for i in range(1, k + 1)}
    d = distinct_counts(df, cols)
    q = quantile_values(prefix_sums(d, ["variable"], "value", ["n"]), ["variable"], "value", "n", probs)
    theo = F.create_map(*[x for i in range(1, k + 1)
                          for x in (F.lit(i), F.lit(S.normal_quantile(i / (k + 1))))])
    long = q.select("variable", F.posexplode(F.array(*[F.col(n) for n in probs])).alias("i0", "empirical"))
    i = F.col("i0") + 1
    return long.select("variable", F.round(i / float(k + 1), 6).alias("p"),
                       F.round(theo[i], 6).alias("theoretical"), F.round("empirical", 6).alias("empirical"))
