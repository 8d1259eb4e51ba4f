"""Registered queries: ``QUERIES[name](spark, sf_dir) -> DataFrame`` and the
equivalent DuckDB SQL in ``ORACLES[name]``.

Every query starts from ``customers_raw`` over the whole ``customer`` and
``orders`` tables, so its work grows with them.
"""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attrition.config import (CONTINUOUS_FEATURES, CV_FOLDS, DECISION_POSITIVE, EARLY_STOP_ROUNDS, FEATURES, GRID_FULL,
                              LABEL_NEGATIVE, LABEL_POSITIVE, MAX_ROUNDS, SAMPLE_SEED, SAMPLE_SIZE, SCORECARD_INDICATORS, SERVICE_COLS,
                              SPLIT_SEED, STATUS_NEGATIVE, STATUS_POSITIVE)
from attrition.functions.stats import DALLAL, STEPHENS, normal_quantile
from attrition.operators import encode as E
from attrition.operators import evaluate as EV
from attrition.operators import explain as XP
from attrition.operators import model as M
from attrition.operators import profile as P
from attrition.operators import scale as SC
from attrition.operators import score as SCO
from attrition.operators import sketch as SK
from attrition.operators import split as SP
from attrition.operators import stat_tests as ST
from attrition.operators.rank import distinct_counts, prefix_sums, quantile_values, row_ids
from attrition.operators.rank import mid_ranks as _mid_ranks
from attrition.plans import training as TR
from attrition.plans.oracle_sql import (CATS, EXPLORED, FEATURE_LIST, NUMS, PREPARED, fold_expr, split_flag,
                                        sql, unpivot)
from attrition.session import checkpoint_root, scratch_path
from attrition.sources import io as IO
from attrition.sources import requests as RQ
from attrition.sources.fixture import customers_raw

QUERIES: dict = {}
ORACLES: dict = {}


def register(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


def explored(spark, sf):
    return E.explore_recode(customers_raw(spark, sf))


def prepared(spark, sf, encoding=None):
    return E.prepare_features(customers_raw(spark, sf), encoding=encoding)


# ----------------------------------------------------------------------------- §2.1 / fixture

register("customers_raw", sql("SELECT * FROM customers_raw"))(customers_raw)

# ----------------------------------------------------------------------------- §2.2


@register("drop_columns", sql(
    "SELECT * EXCLUDE (customerID, " + ", ".join(SERVICE_COLS) + ") FROM customers_raw"))
def q_drop_columns(spark, sf):
    return E.drop_columns(customers_raw(spark, sf), ["customerID", *SERVICE_COLS])


@register("drop_matching", sql("SELECT * EXCLUDE (Churn) FROM prepared", EXPLORED, PREPARED))
def q_drop_matching(spark, sf):
    return E.drop_matching(prepared(spark, sf), "^churn$")


@register("select_by_type", sql("SELECT tenure, MonthlyCharges, TotalCharges FROM explored", EXPLORED))
def q_select_by_type(spark, sf):
    return E.select_by_type(explored(spark, sf), "numeric", target="Churn")


@register("feature_projection", sql(f"SELECT customerID, {FEATURE_LIST} FROM prepared",
                                    EXPLORED, PREPARED))
def q_feature_projection(spark, sf):
    return E.feature_projection(prepared(spark, sf), FEATURES, keep=["customerID"])


@register("recode_binary_int", sql(
    "SELECT customerID, CASE SeniorCitizen WHEN 0 THEN 'No' WHEN 1 THEN 'Yes' END AS SeniorCitizen "
    "FROM customers_raw"))
def q_recode_binary_int(spark, sf):
    return E.recode_binary_int(customers_raw(spark, sf), "SeniorCitizen").select("customerID", "SeniorCitizen")


@register("recode_gender", sql(
    "SELECT customerID, CASE WHEN gender = 'Male' THEN 'Yes' ELSE 'No' END AS gender FROM customers_raw"))
def q_recode_gender(spark, sf):
    return E.recode_gender(customers_raw(spark, sf)).select("customerID", "gender")


def _yn(c):
    return f"CASE WHEN {c} IS NULL THEN NULL WHEN {c} = 'Yes' THEN 1 ELSE 0 END AS {c}"


@register("recode_yes_no", sql(
    "SELECT customerID, gender, " + ", ".join(_yn(c) for c in
                                           ["SeniorCitizen", "Partner", "Dependents"]) +
    ", tenure, " + _yn("PhoneService") + ", MultipleLines, InternetService, Contract, " +
    _yn("PaperlessBilling") + ", PaymentMethod, MonthlyCharges, TotalCharges, " + _yn("Churn") +
    ", ServiceSup FROM explored", EXPLORED))
def q_recode_yes_no(spark, sf):
    return E.recode_yes_no(explored(spark, sf))


@register("coalesce_services", sql("SELECT * FROM explored", EXPLORED))
def q_coalesce_services(spark, sf):
    return explored(spark, sf)


_OH_LEVELS = {
    "MultipleLines": ["No", "No phone service", "Yes"],
    "InternetService": ["DSL", "Fiber optic", "No"],
    "Contract": ["Month-to-month", "One year", "Two year"],
    "PaymentMethod": ["Bank transfer (automatic)", "Credit card (automatic)", "Electronic check",
                      "Mailed check"],
    "ServiceSup": ["No", "No internet service", "Yes"],
}


def _oh_sql(rename: bool) -> str:
    cols = []
    for c, levels in _OH_LEVELS.items():
        for lv in levels:
            name = f"{c}_{lv}"
            if rename:
                name = E.LEVEL_RENAMES.get(name, name)
            cols.append(f'CASE WHEN {c} = \'{lv}\' THEN 1 ELSE 0 END AS "{name}"')
    return ("SELECT * EXCLUDE (MultipleLines, InternetService, Contract, PaymentMethod, ServiceSup), "
            + ", ".join(cols) + " FROM explored")


@register("one_hot", sql(_oh_sql(False), EXPLORED))
def q_one_hot(spark, sf):
    return E.one_hot(explored(spark, sf), list(_OH_LEVELS))


@register("rename_levels", sql(_oh_sql(True), EXPLORED))
def q_rename_levels(spark, sf):
    return E.rename_levels(E.one_hot(explored(spark, sf), list(_OH_LEVELS)))


@register("no_internet_flag", sql(
    "SELECT * EXCLUDE (ServiceSup_No_internet_service, InternetService_No, TotalCharges, "
    "MultipleLines_No_phone_service), CASE WHEN ServiceSup_No_internet_service = 1 AND "
    "InternetService_No = 1 THEN 1 ELSE 0 END AS No_Internet_Service FROM oh",
    EXPLORED, f"oh AS ({_oh_sql(True)})"))
def q_no_internet_flag(spark, sf):
    return E.no_internet_flag(E.rename_levels(E.one_hot(explored(spark, sf), list(_OH_LEVELS))))


@register("prepare_features", sql("SELECT * FROM prepared", EXPLORED, PREPARED))
def q_prepare_features(spark, sf):
    return prepared(spark, sf)


@register("prepare_stored_encoding", sql("SELECT * FROM prepared", EXPLORED, PREPARED))
def q_prepare_stored_encoding(spark, sf):
    """Raw customers prepared by an encoding saved with the artefacts and loaded again; no level is learned from them."""
    path = scratch_path(spark, "artifacts")
    art = replace(fitted(spark, sf).artifacts, encoding=E.learn_features(customers_raw(spark, sf)))
    IO.save_artifacts(spark, path, art)
    return E.prepare_features(customers_raw(spark, sf), encoding=IO.load_encoding(spark, path))


def profiles_input(raw):
    """Stand-in form profiles from the raw table (form vocabulary, 0/1 binaries)."""
    yes = lambda c: F.when(F.col(c) == "Yes", 1).otherwise(0)
    slug = lambda c: F.regexp_replace(F.regexp_replace(F.col(c), r"\s*\(automatic\)", ""), "[ -]", "_")
    merged = E.coalesce_services(raw, SERVICE_COLS)
    return merged.select(
        "customerID",
        F.when(F.col("gender") == "Male", 1).otherwise(0).alias("gender"),
        "SeniorCitizen", yes("Partner").alias("Partner"), yes("Dependents").alias("Dependents"),
        "tenure", "MonthlyCharges", yes("PaperlessBilling").alias("PaperlessBilling"),
        slug("Contract").alias("Contract"), slug("PaymentMethod").alias("PaymentMethod"),
        yes("PhoneService").alias("PhoneService"),
        F.when(F.col("MultipleLines") == "Yes", "Yes").otherwise("No").alias("MultipleLines"),
        slug("InternetService").alias("InternetService"),
        F.when(F.col("ServiceSup") == "Yes", "Yes").otherwise("No").alias("ServiceSup"))


@register("encode_profiles", sql(f"SELECT customerID, {FEATURE_LIST} FROM prepared", EXPLORED, PREPARED))
def q_encode_profiles(spark, sf):
    return E.encode_profiles(profiles_input(customers_raw(spark, sf)), keep=["customerID"])


@register("missing_flags", sql(
    "SELECT customerID, tenure, coalesce(TotalCharges, 0) AS TotalCharges, "
    "CAST(TotalCharges IS NULL AS INTEGER) AS TotalCharges_missing FROM customers_raw"))
def q_missing_flags(spark, sf):
    raw = customers_raw(spark, sf).select("customerID", "tenure", "TotalCharges")
    flagged = E.missing_flags(raw, "flag", ["TotalCharges"])
    return E.missing_flags(flagged, "zero", ["TotalCharges"])


@register("safe_numeric", sql(
    "SELECT customerID, coalesce(TRY_CAST(txt AS DOUBLE), 0.0) AS txt FROM ("
    "SELECT customerID, CASE WHEN TotalCharges IS NULL THEN ' ' WHEN tenure % 7 = 0 THEN 'n/a' "
    "ELSE CAST(TotalCharges AS VARCHAR) END AS txt FROM customers_raw)"))
def q_safe_numeric(spark, sf):
    raw = customers_raw(spark, sf)
    txt = raw.select("customerID", F.when(F.col("TotalCharges").isNull(), " ")
                     .when(F.col("tenure") % 7 == 0, "n/a")
                     .otherwise(F.col("TotalCharges").cast("string")).alias("txt"))
    return E.safe_numeric(txt, ["txt"])


@register("condition_filter", sql("SELECT * FROM explored WHERE Churn = 'Yes'", EXPLORED))
def q_condition_filter(spark, sf):
    return E.condition_filter(explored(spark, sf), "Churn = 'Yes'")


# ----------------------------------------------------------------------------- §2.3

_RAW_TYPES = {c: "character" for c in ["customerID", "gender", "Partner", "Dependents",
                                       "PhoneService", "MultipleLines", "InternetService",
                                       *SERVICE_COLS, "Contract", "PaperlessBilling",
                                       "PaymentMethod", "Churn"]}
_RAW_TYPES.update({"SeniorCitizen": "integer", "tenure": "integer", "MonthlyCharges": "numeric",
                   "TotalCharges": "numeric"})


def _profile_columns_sql():
    types = " ".join(f"WHEN '{c}' THEN '{t}'" for c, t in _RAW_TYPES.items())
    body = f"""SELECT variable, CASE variable {types} END AS type,
  CAST(sum(CASE WHEN value IS NULL THEN k ELSE 0 END) AS BIGINT) AS missing_count,
  round(sum(CASE WHEN value IS NULL THEN k ELSE 0 END) * 100.0 / sum(k), 6) AS missing_percent,
  CAST(count(*) AS BIGINT) AS unique_count,
  round(count(*) / sum(k), 6) AS unique_rate
FROM (SELECT variable, value, count(*) AS k FROM long GROUP BY variable, value) GROUP BY variable"""
    return sql(body, f"long AS ({unpivot('customers_raw', list(_RAW_TYPES))})")


@register("profile_columns", _profile_columns_sql())
def q_profile_columns(spark, sf):
    return P.profile_columns(customers_raw(spark, sf))


def _shape_sql():
    names = "; ".join(["customerID [character]"] + [
        f"{f} [{'numeric' if f == 'MonthlyCharges' else 'integer'}]" for f in FEATURES] + ["Churn [integer]"])
    return sql(f"""SELECT 'rows' AS item, CAST(count(*) AS VARCHAR) AS value FROM prepared
UNION ALL SELECT * FROM (VALUES ('columns', '23'), ('numeric', '21'), ('categorical', '1'),
  ('features_recognised', '21 / 21'), ('ignored_columns', '1'), ('ignored_names', 'Churn'),
  ('names', '{names}')) t(item, value)""", EXPLORED, PREPARED)


@register("shape_summary", _shape_sql())
def q_shape_summary(spark, sf):
    return P.shape_summary(prepared(spark, sf), features=FEATURES, id_col="customerID", target="Churn")


@register("duplicate_rows", sql(
    f"SELECT CAST(sum(k) AS BIGINT) AS n_rows, CAST(count(*) AS BIGINT) AS n_distinct, "
    f"CAST(sum(k - 1) AS BIGINT) AS n_excess FROM (SELECT count(*) AS k FROM prepared "
    f"GROUP BY {FEATURE_LIST}, Churn)", EXPLORED, PREPARED))
def q_duplicate_rows(spark, sf):
    return P.duplicate_rows(prepared(spark, sf), [*FEATURES, "Churn"])


@register("frequency_table", sql(
    "SELECT level, CAST(n AS BIGINT) AS n, round(n * 100.0 / sum(n) OVER (), 6) AS pct, "
    "CASE WHEN level IS NOT NULL THEN round(n * 100.0 / sum(CASE WHEN level IS NOT NULL THEN n END) "
    "OVER (), 6) END AS pct_valid FROM (SELECT Churn AS level, count(*) AS n FROM explored GROUP BY Churn)",
    EXPLORED))
def q_frequency_table(spark, sf):
    return P.frequency_table(explored(spark, sf), "Churn")


@register("profile_categorical", sql(
    """SELECT variable, level, CAST(total AS BIGINT) AS total, CAST(freq AS BIGINT) AS freq,
  round(freq * 100.0 / total, 6) AS ratio, rank FROM (
  SELECT variable, value AS level, count(*) AS freq,
         sum(count(*)) OVER (PARTITION BY variable) AS total,
         CAST(row_number() OVER (PARTITION BY variable ORDER BY count(*) DESC, value ASC NULLS LAST) AS INTEGER) AS rank
  FROM long GROUP BY variable, value) WHERE rank <= 10""",
    EXPLORED, f"long AS ({unpivot('explored', [c for c in CATS])})"))
def q_profile_categorical(spark, sf):
    return P.profile_categorical(explored(spark, sf), CATS, top=10)


def _r6(x, name):
    return f"round(CAST({x} AS DOUBLE), 6) AS {name}"


@register("profile_numeric", sql(
    f"""SELECT l.variable, CAST(count(l.value) AS BIGINT) AS n, {_r6('min(l.value)', 'min')},
  {_r6('any_value(q.q1)', 'q1')}, {_r6('avg(l.value)', 'mean')},
  {_r6('quantile_cont(l.value, 0.5)', 'median')}, {_r6('any_value(q.q3)', 'q3')},
  {_r6('max(l.value)', 'max')},
  CAST(count(*) FILTER (WHERE l.value = 0) AS BIGINT) AS zero,
  CAST(count(*) FILTER (WHERE l.value < 0) AS BIGINT) AS minus,
  CAST(count(*) FILTER (WHERE l.value < h.lh - 1.5 * (h.uh - h.lh)
                           OR l.value > h.uh + 1.5 * (h.uh - h.lh)) AS BIGINT) AS outlier
FROM long l JOIN q USING (variable) JOIN h USING (variable) WHERE l.value IS NOT NULL GROUP BY l.variable""",
    f"long AS ({unpivot('customers_raw', NUMS, cast='DOUBLE')})",
    "q AS (SELECT variable, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 "
    "FROM long WHERE value IS NOT NULL GROUP BY variable)",
    # Tukey hinges (five-number summary): mean of order statistics at floor/ceil of n4 and n+1-n4
    "ranked AS (SELECT variable, value, row_number() OVER (PARTITION BY variable ORDER BY value) AS rn, "
    "count(*) OVER (PARTITION BY variable) AS nn FROM long WHERE value IS NOT NULL)",
    "h AS (SELECT variable, (max(CASE WHEN rn = floor(floor((nn + 3) / 2) / 2) THEN value END) + "
    "max(CASE WHEN rn = ceil(floor((nn + 3) / 2) / 2) THEN value END)) / 2 AS lh, "
    "(max(CASE WHEN rn = floor(nn + 1 - floor((nn + 3) / 2) / 2) THEN value END) + "
    "max(CASE WHEN rn = ceil(nn + 1 - floor((nn + 3) / 2) / 2) THEN value END)) / 2 AS uh "
    "FROM ranked GROUP BY variable)"))
def q_profile_numeric(spark, sf):
    return P.profile_numeric(customers_raw(spark, sf), NUMS)


@register("profile_sketches", sql(f"""SELECT variable, count(value) AS n, count(*) - count(value) AS missing, CAST(count(*) FILTER (WHERE value = 0) AS BIGINT) AS zero,
  CAST(count(*) FILTER (WHERE value < 0) AS BIGINT) AS minus, round(min(value), 6) AS min, round(max(value), 6) AS max, round(avg(value), 6) AS mean,
  true AS quartiles_within, true AS distinct_within FROM ({unpivot('customers_raw', NUMS, cast='DOUBLE')}) GROUP BY variable"""))
def q_profile_sketches(spark, sf):
    """Profiles kept by partition, one of them read again, then merged: exact facts, and whether the quartiles' ranks and
    the distinct counts are within the sketches' error."""
    df = customers_raw(spark, sf).withColumn("part", (F.substring("customerID", 2, 20).cast("long") % 5).cast("int"))
    path = scratch_path(spark, "profiles")
    SK.store_profiles(df, NUMS, path, "part")
    SK.store_profiles(df.where("part = 3"), NUMS, path, "part")
    found = SK.stored_profile(spark, path)
    long = df.select(*[F.col(c).cast("double").alias(c) for c in NUMS]).unpivot([], NUMS, "variable", "value").where("value is not null")
    e = SK.rank_error()
    seen = long.join(F.broadcast(found.select("variable", "q1", "median", "q3")), "variable").groupBy("variable").agg(  # one row a variable
        *[F.avg((F.col("value") <= F.col(q)).cast("double")).alias(f"{q}_to") for q in ("q1", "median", "q3")],
        *[F.avg((F.col("value") < F.col(q)).cast("double")).alias(f"{q}_from") for q in ("q1", "median", "q3")], F.count_distinct("value").alias("d"))
    within = F.lit(True)
    for q, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75)):  # a value that many rows hold has all their ranks
        within = within & (F.col(f"{q}_to") >= p - e) & (F.col(f"{q}_from") <= p + e)
    return found.join(seen, "variable").select(
        "variable", "n", "missing", "zero", "minus", F.round("min", 6).alias("min"), F.round("max", 6).alias("max"), F.round("mean", 6).alias("mean"),
        within.alias("quartiles_within"), (F.abs(F.col("unique_count") / F.col("d") - 1) <= 0.08).alias("distinct_within"))


@register("category_by_target", sql(
    """SELECT variable, value AS level, Churn AS target, CAST(count(*) AS BIGINT) AS n,
  round(count(*) / sum(count(*)) OVER (PARTITION BY variable, value), 6) AS share
FROM long GROUP BY variable, value, Churn""",
    EXPLORED, f"long AS ({unpivot('explored', [c for c in CATS], ids=['Churn'])})"))
def q_category_by_target(spark, sf):
    return P.category_by_target(explored(spark, sf), CATS, "Churn")


_PROP_BY = ["SeniorCitizen", "Dependents", "Partner", "MultipleLines", "InternetService",
            "Contract", "PaymentMethod"]
_Z = P.WILSON_Z


@register("condition_proportions", sql(
    f"""SELECT variable, level, CAST(n AS BIGINT) AS n, CAST(k AS BIGINT) AS k, round(k / n, 6) AS prop,
  round(((k / n) + {_Z}^2 / (2 * n)) / (1 + {_Z}^2 / n)
        - {_Z} * sqrt((k / n) * (1 - k / n) / n + {_Z}^2 / (4 * n * n)) / (1 + {_Z}^2 / n), 6) AS lo,
  round(((k / n) + {_Z}^2 / (2 * n)) / (1 + {_Z}^2 / n)
        + {_Z} * sqrt((k / n) * (1 - k / n) / n + {_Z}^2 / (4 * n * n)) / (1 + {_Z}^2 / n), 6) AS hi
FROM (SELECT variable, value AS level, count(*) AS n, sum(hit) AS k FROM long GROUP BY variable, value)""",
    EXPLORED, "hits AS (SELECT *, CASE WHEN Churn = 'Yes' THEN 1 ELSE 0 END AS hit FROM explored)",
    f"long AS ({unpivot('hits', _PROP_BY, ids=['hit'])})"))
def q_condition_proportions(spark, sf):
    return P.condition_proportions(explored(spark, sf), "Churn = 'Yes'", _PROP_BY)


@register("top_n", sql(
    "SELECT customerID, MonthlyCharges, tenure FROM customers_raw "
    "ORDER BY MonthlyCharges DESC, customerID ASC LIMIT 5"))
def q_top_n(spark, sf):
    raw = customers_raw(spark, sf).select("customerID", "MonthlyCharges", "tenure")
    return P.top_n(raw, ["MonthlyCharges"], 5, tiebreak=["customerID"])


RISK_FLAGS = {
    "senior": "SeniorCitizen = 'Yes'",
    "alone": "Partner = 'No' AND Dependents = 'No'",
    "fibre": "InternetService = 'Fiber optic'",
    "monthly": "Contract = 'Month-to-month'",
    "echeck": "PaymentMethod = 'Electronic check'",
}


def _risk_sql():
    flags = ", ".join(f"CASE WHEN {e} THEN 1 ELSE 0 END AS {k}" for k, e in RISK_FLAGS.items())
    names = ", ".join(RISK_FLAGS)
    return sql(f"""SELECT {names}, CAST(GROUPING({names}) AS BIGINT) AS gid,
  CAST(sum(n) AS BIGINT) AS n, CAST(sum(k) AS BIGINT) AS k, round(sum(k) / sum(n), 6) AS rate,
  round((sum(k) / sum(n)) / (SELECT sum(k) / sum(n) FROM combos), 6) AS lift
FROM combos GROUP BY CUBE ({names})""", EXPLORED,
        f"base AS (SELECT {flags}, CASE WHEN Churn = 'Yes' THEN 1 ELSE 0 END AS hit FROM explored)",
        f"combos AS (SELECT {names}, count(*) AS n, sum(hit) AS k FROM base GROUP BY {names})")


@register("risk_segments", _risk_sql())
def q_risk_segments(spark, sf):
    return P.risk_segments(explored(spark, sf), RISK_FLAGS, "Churn", positive="Yes")


# ----------------------------------------------------------------------------- §2.4


_LONG_CATS = f"long AS ({unpivot('explored', CATS, ids=['Churn'])})"
_CELLS = ("cells AS (SELECT variable, value AS level, Churn AS cls, count(*) AS o FROM long "
          "WHERE value IS NOT NULL AND Churn IS NOT NULL GROUP BY variable, value, Churn)")


@register("chi_square", sql(
    """SELECT variable, round(n * (s - 1), 6) AS statistic, CAST((nr - 1) * (nc - 1) AS BIGINT) AS df,
  round(sqrt(n * (s - 1) / (n * least(nr - 1, nc - 1))), 6) AS cramers_v,
  round(sqrt(greatest(0.0, (s - 1) - (nc - 1) * (nr - 1) / (n - 1.0))
        / least((nc - (nc - 1) * (nc - 1) / (n - 1.0)) - 1, (nr - (nr - 1) * (nr - 1) / (n - 1.0)) - 1)), 6)
    AS cramers_v_adj,
  CAST(n AS BIGINT) AS n
FROM (SELECT variable, sum(o) AS n, sum(o * o / (r * cc)) AS s, count(DISTINCT level) AS nr,
             count(DISTINCT cls) AS nc
      FROM (SELECT *, sum(o) OVER (PARTITION BY variable, level) AS r,
                   sum(o) OVER (PARTITION BY variable, cls) AS cc FROM cells) GROUP BY variable)""",
    EXPLORED, _LONG_CATS, _CELLS))
def q_chi_square(spark, sf):
    return ST.chi_square(explored(spark, sf), CATS, "Churn", with_p=False)


def _p_sql(oracle, column, x, df=""):
    """``oracle`` with p_value, the χ² tail at ``x`` (put beside ``column``): a sum for even df; for odd df the normal tails, by
    Simpson's rule over 400 steps, and a sum. ``df`` is given where the oracle has none."""
    inner = oracle.replace(column, f"{column}, {x} AS x{', ' + df + ' AS df' if df else ''}", 1)
    return f"""SELECT * EXCLUDE (x, zz, two{", df" if df else ""}), round(greatest(0, CASE WHEN x <= 0 THEN 1
    WHEN df % 2 = 0 THEN exp(-x / 2) * (SELECT sum(exp(k * ln(x / 2) - lgamma(k + 1))) FROM range(0, 60) t(k) WHERE k < df / 2)
    ELSE two + coalesce((SELECT sum(exp((k - 0.5) * ln(x) - x / 2 - k * ln(2) - lgamma(k + 0.5) + 0.5 * ln(2))) FROM range(1, 60) t(k) WHERE k <= (df - 1) / 2), 0) END), 6) AS p_value
  FROM (SELECT *, 1 - zz / 600.0 / sqrt(2 * pi()) * (SELECT sum(CASE WHEN i IN (0, 400) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END
      * exp(-0.5 * power(zz * i / 400.0, 2))) FROM range(0, 401) t(i)) AS two
    FROM (SELECT *, least(sqrt(greatest(x, 0)), 10) AS zz FROM ({inner})))"""


@register("chi_square_pvalues", _p_sql(ORACLES["chi_square"], "round(n * (s - 1), 6) AS statistic", "n * (s - 1)"))
def q_chi_square_pvalues(spark, sf):
    """Full test output with p-values (χ² tail by a pandas UDF on the result rows)."""
    return ST.chi_square(explored(spark, sf), CATS, "Churn").withColumn("p_value", F.round("p_value", 6))


@register("level_goodness_of_fit", sql(
    """SELECT variable, level, CAST(sum(o) AS BIGINT) AS n,
  round(any_value(kk.k) / sum(o) * sum(o * o) - sum(o), 6) AS statistic, CAST(any_value(kk.k) - 1 AS BIGINT) AS df
FROM cells JOIN (SELECT variable, count(DISTINCT cls) AS k FROM cells GROUP BY variable) kk USING (variable)
GROUP BY variable, level""", EXPLORED, _LONG_CATS, _CELLS))
def q_level_goodness_of_fit(spark, sf):
    return ST.level_goodness_of_fit(explored(spark, sf), CATS, "Churn", with_p=False)


@register("level_goodness_of_fit_pvalues", _p_sql(ORACLES["level_goodness_of_fit"], "round(any_value(kk.k) / sum(o) * sum(o * o) - sum(o), 6) AS statistic",
                                                  "any_value(kk.k) / sum(o) * sum(o * o) - sum(o)"))
def q_level_goodness_of_fit_pvalues(spark, sf):
    return ST.level_goodness_of_fit(explored(spark, sf), CATS, "Churn").withColumn("p_value", F.round("p_value", 6))


_LONG_NUM_Y = f"long AS ({unpivot('explored', NUMS, ids=['Churn'], cast='DOUBLE')})"


@register("mann_whitney", sql(
    """SELECT variable, round(u, 6) AS u, round(2 * u / (n0 * n1) - 1, 6) AS rank_biserial,
  round((u - n0 * n1 / 2.0 - sign(u - n0 * n1 / 2.0) * 0.5)
        / sqrt(n0 * n1 / 12.0 * ((nn + 1) - ties / (nn * (nn - 1.0)))), 6) AS z,
  round(median0, 6) AS median0, round(median1, 6) AS median1,
  CAST(n0 AS BIGINT) AS n0, CAST(n1 AS BIGINT) AS n1
FROM (SELECT a.*, t.ties, r0 - n0 * (n0 + 1) / 2.0 AS u FROM (
        SELECT variable, count(*) AS nn, sum(y) AS n1, count(*) - sum(y) AS n0,
               sum(CASE WHEN y = 0 THEN mr ELSE 0 END) AS r0,
               quantile_cont(value, 0.5) FILTER (WHERE y = 0) AS median0,
               quantile_cont(value, 0.5) FILTER (WHERE y = 1) AS median1
        FROM r GROUP BY variable) a
      JOIN (SELECT variable, sum(c * c * c - c) AS ties
            FROM (SELECT variable, value, count(*) AS c FROM r GROUP BY variable, value) GROUP BY variable) t
      USING (variable))""",
    EXPLORED, _LONG_NUM_Y,
    "r AS (SELECT variable, value, CASE WHEN Churn = 'Yes' THEN 1 ELSE 0 END AS y, "
    "rank() OVER (PARTITION BY variable ORDER BY value) + "
    "(count(*) OVER (PARTITION BY variable, value) - 1) / 2.0 AS mr "
    "FROM long WHERE value IS NOT NULL AND Churn IS NOT NULL)"))
def q_mann_whitney(spark, sf):
    return ST.mann_whitney(explored(spark, sf), NUMS, "Churn", positive="Yes", with_p=False)


_MW_Z = "(u - n0 * n1 / 2.0 - sign(u - n0 * n1 / 2.0) * 0.5)\n        / sqrt(n0 * n1 / 12.0 * ((nn + 1) - ties / (nn * (nn - 1.0))))"


@register("mann_whitney_pvalues", _p_sql(ORACLES["mann_whitney"], f"round({_MW_Z}, 6) AS z", f"power({_MW_Z}, 2)", "1"))
def q_mann_whitney_pvalues(spark, sf):
    return ST.mann_whitney(explored(spark, sf), NUMS, "Churn", positive="Yes").withColumn("p_value", F.round("p_value", 6))


def _pairs_sql(cols):
    parts = []
    for i, a in enumerate(cols):
        for b in cols[i + 1:]:
            parts.append(f"SELECT '{a}|{b}' AS pair, CAST({a} AS DOUBLE) AS x, CAST({b} AS DOUBLE) AS y "
                         f"FROM customers_raw WHERE {a} IS NOT NULL AND {b} IS NOT NULL")
    return "pp AS (" + " UNION ALL ".join(parts) + ")"


@register("spearman_matrix", sql(
    """SELECT split_part(pair, '|', 1) AS var1, split_part(pair, '|', 2) AS var2, round(corr(rx, ry), 6) AS coef
FROM (SELECT pair,
        rank() OVER (PARTITION BY pair ORDER BY x) + (count(*) OVER (PARTITION BY pair, x) - 1) / 2.0 AS rx,
        rank() OVER (PARTITION BY pair ORDER BY y) + (count(*) OVER (PARTITION BY pair, y) - 1) / 2.0 AS ry
      FROM pp) GROUP BY pair""", _pairs_sql(NUMS)))
def q_spearman_matrix(spark, sf):
    return ST.spearman_matrix(customers_raw(spark, sf), NUMS)


_LONG_NUM = f"long AS ({unpivot('customers_raw', NUMS, cast='DOUBLE')})"


@register("normality", sql(
    """SELECT variable, CAST(n AS BIGINT) AS n, round(sk, 6) AS skew, round(ku, 6) AS kurt,
  round(n / 6.0 * (sk * sk + ku * ku / 4.0), 6) AS jb, round(exp(-(n / 6.0 * (sk * sk + ku * ku / 4.0)) / 2.0), 6) AS jb_p
FROM (SELECT variable, any_value(n) AS n, avg(power(value - mu, 3)) / power(avg(power(value - mu, 2)), 1.5) AS sk,
             avg(power(value - mu, 4)) / power(avg(power(value - mu, 2)), 2) - 3 AS ku
      FROM long JOIN (SELECT variable, count(*) AS n, avg(value) AS mu FROM long WHERE value IS NOT NULL
                      GROUP BY variable) m USING (variable)
      WHERE value IS NOT NULL GROUP BY variable)""", _LONG_NUM))
def q_normality(spark, sf):
    return ST.normality(customers_raw(spark, sf), NUMS)


def _lilliefors_sql():
    a, shift, b, c, d, e = DALLAL
    polys = " ".join(f"WHEN s <= {top} THEN " + " + ".join(f"({k}) * power(s, {i})" for i, k in enumerate(ks)) for top, ks in STEPHENS)
    return f"""CASE WHEN n >= 5 THEN least(1, greatest(0, CASE WHEN low > 0.1 THEN CASE {polys} ELSE 0 END ELSE low END)) END FROM (
  SELECT *, exp(({a}) * k * k * (m + {shift}) + {b} * k * sqrt(m + {shift}) + ({c}) + {d} / sqrt(m) + {e} / m) AS low, (sqrt(n) - 0.01 + 0.85 / sqrt(n)) * ks AS s
  FROM (SELECT *, CASE WHEN n > 100 THEN ks * power(n / 100.0, 0.49) ELSE ks END AS k, least(n, 100) AS m FROM kolmogorov))"""


@register("ks_normal", sql("SELECT variable, CAST(n AS BIGINT) AS n, round(ks, 6) AS ks, round(p, 6) AS ks_p FROM (SELECT variable, n, ks, " + _lilliefors_sql().replace(" END FROM", " END AS p FROM", 1) + ")",
                           _LONG_NUM, """moments AS (SELECT variable, count(*) AS n, avg(value) AS mu, stddev_samp(value) AS sd FROM long WHERE value IS NOT NULL GROUP BY variable),
steps AS (SELECT variable, n, (value - mu) / sd AS z, count(*) AS k, sum(count(*)) OVER (PARTITION BY variable ORDER BY value) AS cum
          FROM long JOIN moments USING (variable) WHERE value IS NOT NULL GROUP BY variable, value, n, mu, sd),
-- the normal CDF by Simpson's rule over 400 steps from 0 to z
cdf AS (SELECT variable, n, z, k, cum, 0.5 + z / 1200.0 / sqrt(2 * pi()) * sum(CASE WHEN i IN (0, 400) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * exp(-0.5 * power(z * i / 400.0, 2))) AS phi
        FROM steps CROSS JOIN range(0, 401) t(i) GROUP BY variable, n, z, k, cum),
kolmogorov AS (SELECT variable, n, max(greatest(abs((cum - k) / n - phi), abs(cum / n - phi))) AS ks FROM cdf GROUP BY variable, n)"""))
def q_ks_normal(spark, sf):
    return ST.ks_normal(customers_raw(spark, sf), NUMS)


_QQ_K = 99


def _qq_sql():
    probs = ", ".join(f"{i / (_QQ_K + 1)!r}" for i in range(1, _QQ_K + 1))
    theo = ", ".join(f"({i}, {normal_quantile(i / (_QQ_K + 1))!r})" for i in range(1, _QQ_K + 1))
    return sql(f"""SELECT variable, round(i / {float(_QQ_K + 1)}, 6) AS p, round(t, 6) AS theoretical,
  round(empirical, 6) AS empirical
FROM (SELECT variable, unnest(range(1, {_QQ_K + 1})) AS i, unnest(qs) AS empirical
      FROM (SELECT variable, quantile_cont(value, [{probs}]) AS qs FROM long WHERE value IS NOT NULL
            GROUP BY variable)) JOIN (VALUES {theo}) th(i, t) USING (i)""", _LONG_NUM)


@register("qq_points", _qq_sql())
def q_qq_points(spark, sf):
    return ST.qq_points(customers_raw(spark, sf), NUMS, k=_QQ_K)


# ----------------------------------------------------------------------------- §2.5 / §2.7 scaler


FOLD_SEED = 7
_SPLIT = f"splitted AS (SELECT *, {split_flag(SPLIT_SEED)} AS is_train FROM prepared)"


def split_prepared(spark, sf):
    return SP.split_train_test(prepared(spark, sf), "customerID", 0.8, SPLIT_SEED)


@register("split_train_test", sql("SELECT customerID, Churn, is_train FROM splitted", EXPLORED, PREPARED, _SPLIT))
def q_split_train_test(spark, sf):
    return split_prepared(spark, sf).select("customerID", "Churn", "is_train")


@register("split_stratified", sql(
    f"""SELECT customerID, Churn, row_number() OVER (PARTITION BY Churn ORDER BY
      md5('{SPLIT_SEED}:' || customerID) || customerID) <= ceil(0.8 * count(*) OVER (PARTITION BY Churn)) AS is_train
FROM prepared""", EXPLORED, PREPARED))
def q_split_stratified(spark, sf):
    df = SP.split_train_test(prepared(spark, sf), "customerID", 0.8, SPLIT_SEED, stratify="Churn")
    return df.select("customerID", "Churn", "is_train")


@register("anti_split", sql("SELECT * EXCLUDE (is_train) FROM splitted WHERE NOT is_train",
                            EXPLORED, PREPARED, _SPLIT))
def q_anti_split(spark, sf):
    df = prepared(spark, sf)
    train = SP.split_train_test(df, "customerID", 0.8, SPLIT_SEED).filter("is_train")
    return SP.anti_split(df, train, "customerID")


@register("sample_n", sql(
    f"SELECT * EXCLUDE (Churn) FROM prepared ORDER BY md5('{SAMPLE_SEED}:' || customerID), customerID "
    f"LIMIT {SAMPLE_SIZE}", EXPLORED, PREPARED))
def q_sample_n(spark, sf):
    return SP.sample_n(prepared(spark, sf), "customerID", SAMPLE_SIZE, SAMPLE_SEED, drop="^Churn$")


@register("kfold_assign", sql(f"SELECT customerID, {fold_expr(FOLD_SEED, 10)} AS fold FROM prepared",
                              EXPLORED, PREPARED))
def q_kfold_assign(spark, sf):
    return SP.kfold_assign(prepared(spark, sf), "customerID", 10, FOLD_SEED).select("customerID", "fold")


_NULL_IDS = """loose AS (SELECT *, CASE WHEN CAST(substr(customerID, 2) AS BIGINT) % 9 = 0 THEN NULL ELSE customerID END AS loose_id FROM prepared)"""


@register("split_null_ids", sql(f"""SELECT customerID, is_train, fold, NOT is_train AS in_test FROM (
  SELECT customerID, {split_flag(SPLIT_SEED, 0.8, "coalesce(loose_id, '')")} AS is_train, {fold_expr(7, 10, "coalesce(loose_id, '')")} AS fold FROM loose)""",
                                EXPLORED, PREPARED, _NULL_IDS))
def q_split_null_ids(spark, sf):
    """Every ninth customer without an id: each row is in one half, one fold, and in the rest of its half only."""
    df = prepared(spark, sf).select("customerID", F.when(F.substring("customerID", 2, 20).cast("long") % 9 != 0, F.col("customerID")).alias("loose_id"))
    both = SP.kfold_assign(SP.split_train_test(df, "loose_id", 0.8, SPLIT_SEED), "loose_id", 10, FOLD_SEED)
    rest = SP.anti_split(both, both.where("is_train"), "loose_id").select(F.col("customerID").alias("_rest"))
    return both.join(rest, F.col("customerID") == F.col("_rest"), "left").select("customerID", "is_train", "fold", F.col("_rest").isNotNull().alias("in_test"))


@register("class_weight", sql(
    "SELECT CAST(count(*) FILTER (WHERE Churn <> 1) AS BIGINT) AS n_neg, "
    "CAST(count(*) FILTER (WHERE Churn = 1) AS BIGINT) AS n_pos, "
    "round(count(*) FILTER (WHERE Churn <> 1) / count(*) FILTER (WHERE Churn = 1), 6) AS weight "
    "FROM splitted WHERE is_train", EXPLORED, PREPARED, _SPLIT))
def q_class_weight(spark, sf):
    return P.class_weight(split_prepared(spark, sf).filter("is_train"), "Churn", positive=1)


def _scaler_sql():
    parts = [f"SELECT '{f}' AS feature, CAST(min({f}) AS DOUBLE) AS lo, CAST(max({f}) AS DOUBLE) AS hi "
             f"FROM splitted WHERE is_train" for f in FEATURES]
    return " UNION ALL ".join(parts)


@register("fit_range_scaler", sql(_scaler_sql(), EXPLORED, PREPARED, _SPLIT))
def q_fit_range_scaler(spark, sf):
    return SC.fit_range_scaler(split_prepared(spark, sf).filter("is_train"), FEATURES)


def _apply_scaler_sql():
    cols = []
    for f in FEATURES:
        lo, hi = f"(SELECT lo FROM sc WHERE feature = '{f}')", f"(SELECT hi FROM sc WHERE feature = '{f}')"
        cols.append(f"round(CASE WHEN {hi} = {lo} THEN CASE WHEN {f} IS NULL THEN NULL ELSE 0.0 END "
                    f"ELSE ({f} - {lo}) / ({hi} - {lo}) END, 6) AS {f}")
    return sql(f"SELECT customerID, {', '.join(cols)} FROM splitted WHERE NOT is_train",
               EXPLORED, PREPARED, _SPLIT, f"sc AS ({_scaler_sql()})")


@register("apply_range_scaler", _apply_scaler_sql())
def q_apply_range_scaler(spark, sf):
    df = split_prepared(spark, sf)
    scaler = SC.fit_range_scaler(df.filter("is_train"), FEATURES)
    scaled = SC.apply_range_scaler(df.filter(~F.col("is_train")), scaler, FEATURES)
    return scaled.select("customerID", *[F.round(f, 6).alias(f) for f in FEATURES])


@register("assemble_matrix", sql("SELECT customerID, Churn, CAST(unnest(range(0, " + str(len(FEATURES)) + ")) AS INTEGER) AS position, "
                                 "unnest([" + ", ".join(f"CAST({f} AS DOUBLE)" for f in FEATURES) + "]) AS value FROM prepared", EXPLORED, PREPARED))
def q_assemble_matrix(spark, sf):
    """The feature vectors, entry by entry."""
    m = SC.assemble_matrix(prepared(spark, sf), FEATURES, keep=["customerID"])
    return m.select("customerID", "Churn", F.posexplode(vector_to_array("features")).alias("position", "value"))


# ----------------------------------------------------------------------------- §2.6 metrics
# Oracle-tested on a deterministic synthetic score (no model), over the test split.

_SCORE_SQL = "((72 - tenure) * 200 + CAST(floor(MonthlyCharges) AS INTEGER)) / 15000.0"
_TEST = f"test AS (SELECT customerID, Churn AS label, {_SCORE_SQL} AS score FROM splitted WHERE NOT is_train)"
_ROC_ROWS = """roc AS (
  SELECT CASE WHEN prev IS NULL THEN CAST('-inf' AS DOUBLE) ELSE (prev + s) / 2.0 END AS threshold,
         round(((SELECT sum(n_pos) FROM d) - cum_pos) / (SELECT sum(n_pos) FROM d), 6) AS sensitivity,
         round((cum_n - cum_pos) / (SELECT sum(n) - sum(n_pos) FROM d), 6) AS specificity
  FROM (SELECT s, coalesce(sum(n) OVER w, 0) AS cum_n, coalesce(sum(n_pos) OVER w, 0) AS cum_pos,
               lag(s) OVER (ORDER BY s) AS prev
        FROM d WINDOW w AS (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
  UNION ALL SELECT CAST('inf' AS DOUBLE), 0.0, 1.0)"""
_D = "d AS (SELECT score AS s, count(*) AS n, sum(label) AS n_pos FROM test GROUP BY score)"
_METRIC_CTES = (EXPLORED, PREPARED, _SPLIT, _TEST)


def synthetic_scores(spark, sf):
    df = split_prepared(spark, sf).filter(~F.col("is_train"))
    score = ((72 - F.col("tenure")) * 200 + F.floor("MonthlyCharges").cast("int")) / 15000.0
    return df.select("customerID", F.col("Churn").alias("label"), score.alias("score"))


@register("roc_curve", sql(
    "SELECT threshold, sensitivity AS tpr, round(1 - specificity, 6) AS fpr, sensitivity, specificity FROM roc",
    *_METRIC_CTES, _D, _ROC_ROWS))
def q_roc_curve(spark, sf):
    return EV.roc_curve(synthetic_scores(spark, sf), "score", "label")


_AUC_SQL = sql(
    """SELECT round((sum(CASE WHEN label = 1 THEN mr ELSE 0 END) - n1 * (n1 + 1) / 2.0) / (n1 * n0), 6) AS auc,
  CAST(n1 AS BIGINT) AS n_pos, CAST(n0 AS BIGINT) AS n_neg
FROM (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS mr,
             sum(label) OVER () AS n1, count(*) OVER () - sum(label) OVER () AS n0 FROM test)
GROUP BY n1, n0""", *_METRIC_CTES)


@register("auc", _AUC_SQL)
def q_auc(spark, sf):
    return EV.auc(synthetic_scores(spark, sf), "score", "label")


def q_auc_window(spark, sf):
    """Same AUC through the single-task window: a baseline for the bench and the tests, not a registered query."""
    return EV.auc(synthetic_scores(spark, sf), "score", "label", method="window")


@register("youden_threshold", sql(
    """SELECT threshold, round(hit / p, 6) AS sensitivity, round(pass / q, 6) AS specificity, round(hit / p + pass / q - 1, 6) AS j
FROM (SELECT CASE WHEN prev IS NULL THEN CAST('-inf' AS DOUBLE) ELSE (prev + s) / 2.0 END AS threshold,
             p - cum_pos AS hit, cum_n - cum_pos AS pass, p, q
      FROM (SELECT s, coalesce(sum(n) OVER w, 0) AS cum_n, coalesce(sum(n_pos) OVER w, 0) AS cum_pos,
                   lag(s) OVER (ORDER BY s) AS prev, sum(n_pos) OVER () AS p, sum(n - n_pos) OVER () AS q
            FROM d WINDOW w AS (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
      UNION ALL SELECT CAST('inf' AS DOUBLE), 0, sum(n - n_pos), sum(n_pos), sum(n - n_pos) FROM d)
ORDER BY hit * q + pass * p DESC, threshold ASC LIMIT 1""", *_METRIC_CTES, _D))
def q_youden_threshold(spark, sf):
    return EV.youden_threshold(synthetic_scores(spark, sf), "score", "label")


_PRED = "pred AS (SELECT *, CASE WHEN score >= 0.5 THEN 1 ELSE 0 END AS pred FROM test)"
_CM = ("cm AS (SELECT count(*) FILTER (WHERE pred = 1 AND label = 1) AS tp, "
       "count(*) FILTER (WHERE pred = 1 AND label <> 1) AS fp, "
       "count(*) FILTER (WHERE pred <> 1 AND label <> 1) AS tn, "
       "count(*) FILTER (WHERE pred <> 1 AND label = 1) AS fn FROM pred)")


def scored_predictions(spark, sf):
    return EV.apply_threshold(synthetic_scores(spark, sf), "score", 0.5)


@register("apply_threshold", sql("SELECT customerID, label, score, pred FROM pred", *_METRIC_CTES, _PRED))
def q_apply_threshold(spark, sf):
    return scored_predictions(spark, sf)


@register("confusion_matrix", sql("SELECT * FROM cm", *_METRIC_CTES, _PRED, _CM))
def q_confusion_matrix(spark, sf):
    return EV.confusion_matrix(scored_predictions(spark, sf), "pred", "label")


_WIDE = """wide AS (SELECT
  (tp + tn) / NULLIF(n, 0) AS accuracy,
  ((tp + tn) / NULLIF(n, 0) - pe) / NULLIF(1 - pe, 0) AS kappa,
  tp / NULLIF(tp + fn, 0) AS sensitivity, tn / NULLIF(tn + fp, 0) AS specificity,
  tp / NULLIF(tp + fp, 0) AS ppv, tn / NULLIF(tn + fn, 0) AS npv,
  tp / NULLIF(tp + fp, 0) AS precision, tp / NULLIF(tp + fn, 0) AS recall,
  2 * (tp / NULLIF(tp + fp, 0)) * (tp / NULLIF(tp + fn, 0))
    / NULLIF((tp / NULLIF(tp + fp, 0)) + (tp / NULLIF(tp + fn, 0)), 0) AS f1,
  (tp + fn) / NULLIF(n, 0) AS prevalence, tp / NULLIF(n, 0) AS detection_rate,
  (tp + fp) / NULLIF(n, 0) AS detection_prevalence,
  ((tp / NULLIF(tp + fn, 0)) + (tn / NULLIF(tn + fp, 0))) / 2 AS balanced_accuracy,
  greatest(tp + fn, fp + tn) / NULLIF(n, 0) AS no_information_rate,
  (abs(fp - fn) - 1) * (abs(fp - fn) - 1) / NULLIF(fp + fn, 0) AS mcnemar_statistic
FROM (SELECT CAST(tp AS DOUBLE) tp, CAST(fp AS DOUBLE) fp, CAST(tn AS DOUBLE) tn, CAST(fn AS DOUBLE) fn,
             CAST(tp + fp + tn + fn AS DOUBLE) AS n,
             ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn))
               / NULLIF(CAST((tp + fp + tn + fn) * (tp + fp + tn + fn) AS DOUBLE), 0) AS pe
      FROM cm))"""


@register("classification_metrics", sql(
    " UNION ALL ".join(f"SELECT '{m}' AS metric, round({m}, 6) AS value FROM wide" for m in EV.METRICS),
    *_METRIC_CTES, _PRED, _CM, _WIDE))
def q_classification_metrics(spark, sf):
    return EV.classification_metrics(scored_predictions(spark, sf), "pred", "label")


def _scorecard_sql():
    auc_val = ("(SELECT round((sum(CASE WHEN label = 1 THEN mr ELSE 0 END) - n1 * (n1 + 1) / 2.0) / (n1 * n0), 6) "
               "FROM (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS mr, "
               "sum(label) OVER () AS n1, count(*) OVER () - sum(label) OVER () AS n0 FROM test) GROUP BY n1, n0)")
    vals = [auc_val, "accuracy", "recall", "precision", "f1"]
    rows = " UNION ALL ".join(f"SELECT '{i}' AS indicator, round({v}, 3) AS value FROM wide" for i, v in zip(SCORECARD_INDICATORS, vals))
    return sql(f"""SELECT indicator, value,
  regexp_replace(CAST(round(value * 100, 1) AS VARCHAR), '\\.0$', '') || '%' AS pct,
  CASE WHEN value >= 0.8 THEN 'green' WHEN value >= 0.65 THEN 'yellow' ELSE 'red' END AS band,
  CAST(row_number() OVER (ORDER BY value ASC NULLS FIRST, indicator ASC) AS INTEGER) AS position
FROM ({rows})""", *_METRIC_CTES, _PRED, _CM, _WIDE)


@register("scorecard", _scorecard_sql())
def q_scorecard(spark, sf):
    s = scored_predictions(spark, sf)
    return EV.scorecard(s, "pred", "label", EV.auc(s, "score", "label"))


# ----------------------------------------------------------------------------- §2.7 learning
# Model-dependent results have no SQL oracle (MLlib training); rows-only
# checks here, properties in tests/ (SHAP additivity, staged = model margin).


MODEL_PARAMS = {"max_depth": 3, "eta": 0.1, "subsample": 0.8, "colsample_bytree": 0.8, "rounds": 20}


def fitted(spark, sf):
    return TR.fitted_for(spark, sf, customers_raw, MODEL_PARAMS)


@register("train_gbt")
def q_train_gbt(spark, sf):
    """Fit on the train split; test-set positive-class probabilities."""
    fit = fitted(spark, sf)
    s = TR.scored(fit.test, fit.artifacts)
    return s.select("customerID", "Churn", F.round("proba", 6).alias("proba"))


@register("tune_gbt")
def q_tune_gbt(spark, sf):
    """The search with all points of ``config.GRID_FULL``, folds, rounds and patience."""
    rows = TR.search_rows(prepared(spark, sf), CV_FOLDS)
    return M.tune_gbt(rows, FEATURES, "Churn", GRID_FULL, weight="w", max_rounds=MAX_ROUNDS, patience=EARLY_STOP_ROUNDS,
                      parallelism=fits_at_once(spark), root=search_root(spark))


def fits_at_once(spark):
    """A fit of the search is one task."""
    return max(8, spark.sparkContext.defaultParallelism)


def search_root(spark):
    """One shared folder, so that the searches of ``tune_gbt`` and ``train_tuned`` over the same rows are one."""
    return f"{checkpoint_root(spark).rstrip('/')}/attrition-scratch/searches"


@register("train_tuned")
def q_train_tuned(spark, sf):
    """Fit with the winner of the search over the whole ``config.GRID_FULL`` at its best round; test-set positive-class
    probabilities. What ``tune_gbt`` has fitted is taken over."""
    fit, _ = TR.fit_tuned(prepared(spark, sf), GRID_FULL, parallelism=fits_at_once(spark), root=search_root(spark))
    return TR.scored(fit.test, fit.artifacts).select("customerID", "Churn", F.round("proba", 6).alias("proba"))


@register("staged_scores")
def q_staged_scores(spark, sf):
    fit = fitted(spark, sf)
    return M.staged_scores(fit.test, fit.artifacts.model, FEATURES, "customerID", keep=["Churn"])


@register("select_rounds")
def q_select_rounds(spark, sf):
    fit = fitted(spark, sf)
    return M.choose_rounds(M.margin_counts(fit.test, fit.artifacts.model, FEATURES, "Churn"), patience=20)


# Two trees written out, so that what reads trees has an exact oracle: (tree, weight, node, left, right, feature, threshold, value, rows).
FIXED_TREES = [
    (0, 1.0, 0, 1, 2, "tenure", 12.0, 0.0, 96.0), (0, 1.0, 1, 3, 4, "Contract_Month_to_month", 0.5, 0.0, 32.0),
    (0, 1.0, 2, -1, -1, None, None, -0.5, 64.0), (0, 1.0, 3, -1, -1, None, None, -0.25, 8.0), (0, 1.0, 4, -1, -1, None, None, 0.75, 24.0),
    (1, 0.5, 0, 1, 2, "MonthlyCharges", 70.0, 0.0, 96.0), (1, 0.5, 1, -1, -1, None, None, -0.125, 48.0),
    (1, 0.5, 2, 3, 4, "tenure", 40.0, 0.0, 48.0), (1, 0.5, 3, -1, -1, None, None, 0.5, 36.0), (1, 0.5, 4, -1, -1, None, None, -0.375, 12.0)]
_TREES = """trees AS (SELECT customerID, Churn, CASE WHEN tenure <= 12 THEN CASE WHEN Contract_Month_to_month <= 0.5 THEN -0.25 ELSE 0.75 END ELSE -0.5 END AS t0,
  0.5 * CASE WHEN MonthlyCharges <= 70 THEN -0.125 WHEN tenure <= 40 THEN 0.5 ELSE -0.375 END AS t1 FROM prepared),
staged AS (SELECT customerID AS id, Churn, CAST(1 AS INTEGER) AS round, CAST(t0 AS DOUBLE) AS margin FROM trees
  UNION ALL SELECT customerID, Churn, 2, CAST(t0 + t1 AS DOUBLE) FROM trees)"""


def fixed_forest(spark):
    rows = [(t, w, n, v, c, 0.0, left, right, FEATURES.index(f) if f else -1, x) for t, w, n, left, right, f, x, v, c in FIXED_TREES]
    return M.Forest.from_table(spark.createDataFrame(rows, "tree int, weight double, node int, prediction double, raw_count double, gain double, "
                                                           "left int, right int, feature int, threshold double"))


@register("staged_scores_trees", sql("SELECT * FROM staged", EXPLORED, PREPARED, _TREES))
def q_staged_scores_trees(spark, sf):
    """The margins of all customers after each of two fixed trees."""
    return M.staged_scores(prepared(spark, sf), fixed_forest(spark), FEATURES, "customerID", keep=["Churn"])


@register("margin_counts", sql(f"""SELECT fold, round, margin, count(*) AS n, CAST(sum(Churn) AS BIGINT) AS n_pos
FROM staged JOIN (SELECT customerID, {fold_expr(7, 3)} AS fold FROM prepared) ON id = customerID GROUP BY fold, round, margin""", EXPLORED, PREPARED, _TREES))
def q_margin_counts(spark, sf):
    """Distinct margins by fold and round, counted in the tasks."""
    df = SP.kfold_assign(prepared(spark, sf), "customerID", 3, FOLD_SEED)
    return M.margin_counts(df, {f: fixed_forest(spark) for f in range(3)}, FEATURES, "Churn", fold="fold")


@register("choose_rounds", sql("""SELECT round, round(auc, 6) AS mean_auc, auc = max(auc) OVER () AND round = min(round) FILTER (WHERE auc = top) OVER () AS best FROM (
  SELECT *, max(auc) OVER () AS top FROM (
    SELECT round, (sum(CASE WHEN Churn = 1 THEN r END) - sum(Churn) * (sum(Churn) + 1) / 2.0) / (sum(Churn) * sum(1 - Churn)) AS auc
    FROM (SELECT *, rank() OVER (PARTITION BY round ORDER BY margin) + (count(*) OVER (PARTITION BY round, margin) - 1) / 2.0 AS r FROM staged) GROUP BY round))""",
                               EXPLORED, PREPARED, _TREES))
def q_choose_rounds(spark, sf):
    """AUC after each of the two trees, and the better round."""
    return M.choose_rounds(M.margin_counts(prepared(spark, sf), fixed_forest(spark), FEATURES, "Churn"))


# Shapley's definition for the two features of each fixed tree: what the tree gives with both, one or none of them known.
_SHAP_TREES = """known AS (SELECT customerID, tenure, MonthlyCharges, Contract_Month_to_month AS monthly,
    CASE WHEN tenure <= 12 THEN CASE WHEN Contract_Month_to_month <= 0.5 THEN -0.25 ELSE 0.75 END ELSE -0.5 END AS both0,
    CASE WHEN tenure <= 12 THEN 0.5 ELSE -0.5 END AS t0, CASE WHEN Contract_Month_to_month <= 0.5 THEN -0.25 ELSE 0.75 END / 3.0 - 1.0 / 3.0 AS c0, -1.0 / 6.0 AS none0,
    CASE WHEN MonthlyCharges <= 70 THEN -0.0625 WHEN tenure <= 40 THEN 0.25 ELSE -0.1875 END AS both1,
    CASE WHEN tenure <= 40 THEN 0.25 ELSE -0.1875 END / 2.0 - 0.03125 AS t1, CASE WHEN MonthlyCharges <= 70 THEN -0.0625 ELSE 0.140625 END AS m1, 0.0390625 AS none1
  FROM prepared),
shap AS (
  SELECT customerID AS id, 'tenure' AS feature, CAST(tenure AS DOUBLE) AS value, CAST((both0 - c0 + t0 - none0) / 2 + (both1 - m1 + t1 - none1) / 2 AS DOUBLE) AS shap FROM known
  UNION ALL SELECT customerID, 'Contract_Month_to_month', CAST(monthly AS DOUBLE), CAST((both0 - t0 + c0 - none0) / 2 AS DOUBLE) FROM known
  UNION ALL SELECT customerID, 'MonthlyCharges', CAST(MonthlyCharges AS DOUBLE), CAST((both1 - t1 + m1 - none1) / 2 AS DOUBLE) FROM known)"""


@register("shap_values_trees", sql("SELECT id, feature, value, round(shap, 6) AS shap FROM shap", EXPLORED, PREPARED, _SHAP_TREES))
def q_shap_values_trees(spark, sf):
    """Attributions of all customers on the two fixed trees, features with the largest ones first."""
    return XP.shap_values(prepared(spark, sf), fixed_forest(spark), FEATURES, "customerID", top=3).withColumn("shap", F.round("shap", 6))


@register("shap_summary_trees", sql("SELECT feature, round(avg(abs(shap)), 6) AS mean_abs, CAST(row_number() OVER (ORDER BY avg(abs(shap)) DESC) AS INTEGER) AS rank FROM shap GROUP BY feature",
                                    EXPLORED, PREPARED, _SHAP_TREES))
def q_shap_summary_trees(spark, sf):
    return XP.shap_summary(XP.shap_values(prepared(spark, sf), fixed_forest(spark), FEATURES, "customerID", top=3), top=3)


@register("shap_points_trees", sql("""SELECT id, feature, value, round(shap, 6) AS shap,
  round(CASE WHEN max(value) OVER (PARTITION BY feature) > min(value) OVER (PARTITION BY feature)
    THEN (value - min(value) OVER (PARTITION BY feature)) / (max(value) OVER (PARTITION BY feature) - min(value) OVER (PARTITION BY feature)) ELSE 0 END, 6) AS value_scaled FROM shap""",
                                   EXPLORED, PREPARED, _SHAP_TREES))
def q_shap_points_trees(spark, sf):
    points = XP.shap_points(XP.shap_values(prepared(spark, sf), fixed_forest(spark), FEATURES, "customerID", top=3))
    return points.select("id", "feature", "value", F.round("shap", 6).alias("shap"), F.round("value_scaled", 6).alias("value_scaled"))


@register("feature_importance")
def q_feature_importance(spark, sf):
    return M.feature_importance(fitted(spark, sf).artifacts.model, FEATURES, top=10)


@register("shap_values")
def q_shap_values(spark, sf):
    fit = fitted(spark, sf)
    return XP.shap_values(fit.test, fit.artifacts.model, FEATURES, "customerID", top=10)


@register("shap_summary")
def q_shap_summary(spark, sf):
    fit = fitted(spark, sf)
    return XP.shap_summary(XP.shap_values(fit.test, fit.artifacts.model, FEATURES, "customerID"), top=10)


# ----------------------------------------------------------------------------- §2.8 scoring contract
# Stand-in scoring input: the prepared features with injected bad values and a
# differently-cased id column (as an upload or API payload would carry).

def dirty_input(spark, sf, encoding=None):
    df = prepared(spark, sf, encoding)
    k = F.substring("customerID", 2, 20).cast("long")
    return df.select(
        F.col("customerID").alias("Customer_ID"),
        *[(F.when(k % 50 == 0, F.lit(-1)).otherwise(F.col(f)) if f == "tenure" else
           F.when(k % 70 == 0, F.lit(0.0)).otherwise(F.col(f)) if f == "MonthlyCharges" else
           F.when(k % 90 == 0, F.lit(2)).otherwise(F.col(f)) if f == "gender" else
           F.when(k % 110 == 0, F.lit(None).cast("int")).otherwise(F.col(f)) if f == "Partner" else
           F.col(f)).alias(f) for f in FEATURES],
        F.lit("x").alias("note"))


def _dirty_sql():
    cols = []
    for f in FEATURES:
        if f == "tenure":
            cols.append("CASE WHEN k % 50 = 0 THEN -1 ELSE tenure END AS tenure")
        elif f == "MonthlyCharges":
            cols.append("CASE WHEN k % 70 = 0 THEN 0.0 ELSE MonthlyCharges END AS MonthlyCharges")
        elif f == "gender":
            cols.append("CASE WHEN k % 90 = 0 THEN 2 ELSE gender END AS gender")
        elif f == "Partner":
            cols.append("CASE WHEN k % 110 = 0 THEN NULL ELSE Partner END AS Partner")
        else:
            cols.append(f)
    return ("dirty AS (SELECT customerID AS Customer_ID, " + ", ".join(cols) + ", 'x' AS note FROM "
            "(SELECT *, CAST(substr(customerID, 2) AS BIGINT) AS k FROM prepared))")


_DIRTY = (EXPLORED, PREPARED, _dirty_sql())
_BINARY = [f for f in FEATURES if f not in CONTINUOUS_FEATURES]


def _bin_bad(f):
    return f"({f} IS NULL OR {f} NOT IN (0, 1))"


@register("validate_schema", sql(
    "SELECT * FROM (VALUES ('Contract_Two_year', 'missing'), ('note', 'extra')) t(\"column\", status) "
    "UNION ALL SELECT * FROM (VALUES " + ", ".join(f"('{f}', 'ok')" for f in FEATURES if f != "Contract_Two_year")
    + ") u(\"column\", status) UNION ALL SELECT 'rows' AS \"column\", CAST(count(*) AS VARCHAR) AS status FROM dirty",
    *_DIRTY))
def q_validate_schema(spark, sf):
    df = dirty_input(spark, sf).drop("Contract_Two_year")
    rows = df.agg(F.lit("rows").alias("column"), F.count(F.lit(1)).cast("string").alias("status"))
    return SCO.validate_schema(df, FEATURES).unionByName(rows)


@register("validate_tenure", sql("SELECT Customer_ID, tenure, coalesce(tenure < 0, false) AS tenure_invalid FROM dirty",
                                 *_DIRTY))
def q_validate_tenure(spark, sf):
    return SCO.validate_tenure(dirty_input(spark, sf)).select("Customer_ID", "tenure", "tenure_invalid")


@register("validate_charges", sql(
    "SELECT Customer_ID, MonthlyCharges, coalesce(MonthlyCharges <= 0, false) AS charges_invalid FROM dirty", *_DIRTY))
def q_validate_charges(spark, sf):
    return SCO.validate_charges(dirty_input(spark, sf)).select("Customer_ID", "MonthlyCharges", "charges_invalid")


@register("validate_binary", sql(
    "SELECT Customer_ID, concat_ws(',', " + ", ".join(f"CASE WHEN {_bin_bad(f)} THEN '{f}' END" for f in _BINARY)
    + ") AS invalid_columns FROM dirty", *_DIRTY))
def q_validate_binary(spark, sf):
    df = SCO.validate_binary(dirty_input(spark, sf), _BINARY)
    return df.select("Customer_ID", F.concat_ws(",", "invalid_columns").alias("invalid_columns"))


@register("validation_report", sql(
    "SELECT 'tenure' AS rule, 'tenure' AS column, CAST(count(*) FILTER (WHERE tenure < 0) AS BIGINT) AS n_bad FROM dirty "
    "UNION ALL SELECT 'MonthlyCharges', 'MonthlyCharges', CAST(count(*) FILTER (WHERE MonthlyCharges <= 0) AS BIGINT) "
    "FROM dirty UNION ALL " + " UNION ALL ".join(
        f"SELECT 'binary', '{f}', CAST(count(*) FILTER (WHERE {_bin_bad(f)}) AS BIGINT) FROM dirty" for f in _BINARY),
    *_DIRTY))
def q_validation_report(spark, sf):
    return SCO.validation_report(dirty_input(spark, sf), FEATURES)


@register("resolve_id", sql("SELECT CAST(Customer_ID AS VARCHAR) AS id_client, tenure FROM dirty", *_DIRTY))
def q_resolve_id(spark, sf):
    return SCO.resolve_id(dirty_input(spark, sf)).select("id_client", "tenure")


@register("row_ids", sql(
    "SELECT 'CLIENT_' || CAST(row_number() OVER (ORDER BY customerID) AS VARCHAR) AS id_client, customerID "
    "FROM prepared", EXPLORED, PREPARED))
def q_row_ids(spark, sf):
    return row_ids(prepared(spark, sf).select("customerID"), order_by="customerID")


@register("row_ids_keyless", sql(
    """SELECT variant, count(*) AS n, count(*) AS n_ids, count(*) AS n_customers, CAST(1 AS BIGINT) AS lowest, count(*) AS highest
FROM prepared, (VALUES ('shuffled'), ('joined'), ('sorted'), ('scored upload')) t(variant) GROUP BY variant""", EXPLORED, PREPARED))
def q_row_ids_keyless(spark, sf):
    """Ids without a key behind a shuffle, a join and a sort, and through the upload scorer: every row once, ids 1..n."""
    base = prepared(spark, sf)
    n = F.substring("id_client", 8, 20).cast("long")

    def facts(df, variant, customer="customerID"):
        return df.agg(F.lit(variant).alias("variant"), F.count(F.lit(1)).alias("n"), F.count_distinct("id_client").alias("n_ids"),
                      F.count_distinct(customer).alias("n_customers"), F.min(n).alias("lowest"), F.max(n).alias("highest"))

    one = base.select(F.col("customerID"))
    joined = one.join(base.select(F.col("customerID").alias("other"), "tenure"), F.col("customerID") == F.col("other"))
    # the scorer keeps the id only, so ids stand for customers there
    upload = SCO.score_upload(base.drop("customerID").repartition(7, "tenure"), fitted(spark, sf).artifacts).select(F.col("ID_CLIENT").alias("id_client"))
    return (facts(row_ids(one.repartition("customerID")), "shuffled")
            .unionByName(facts(row_ids(joined), "joined")).unionByName(facts(row_ids(one.orderBy("customerID")), "sorted"))
            .unionByName(facts(upload, "scored upload", "id_client")))


def _reasons_sql():
    parts = ["CASE WHEN tenure < 0 THEN 'tenure' END",
             "CASE WHEN MonthlyCharges <= 0 THEN 'MonthlyCharges' END"]
    parts += [f"CASE WHEN {_bin_bad(f)} THEN 'binary:{f}' END" for f in _BINARY]
    return "concat_ws(',', " + ", ".join(parts) + ")"


@register("score_rejects", sql(
    f"SELECT id_client, reasons FROM (SELECT CAST(Customer_ID AS VARCHAR) AS id_client, {_reasons_sql()} AS reasons "
    "FROM dirty) WHERE reasons <> ''", *_DIRTY))
def q_score_rejects(spark, sf):
    """Quarantine mode: the reject table (id and reasons) of a dirty batch."""
    art = fitted(spark, sf).artifacts
    _, rejected = SCO.score_batch(dirty_input(spark, sf, art.encoding), art, mode="quarantine")
    return rejected.select("id_client", F.concat_ws(",", "reasons").alias("reasons"))


@register("score_batch")
def q_score_batch(spark, sf):
    """Quarantine mode: scored rows of a dirty batch (bad rows excluded)."""
    art = fitted(spark, sf).artifacts
    scored_rows, _ = SCO.score_batch(dirty_input(spark, sf, art.encoding), art, mode="quarantine")
    return scored_rows


_HOLES = "holes AS (SELECT * REPLACE (CASE WHEN CAST(substr(Customer_ID, 2) AS BIGINT) % 60 = 1 THEN NULL ELSE tenure END AS tenure) FROM dirty)"
_BAD_ROW = "coalesce(tenure < 0, false) OR coalesce(MonthlyCharges <= 0, false) OR " + " OR ".join(_bin_bad(f) for f in _BINARY)


@register("score_policies", sql(f"""SELECT policy, mode, count(*) FILTER (WHERE mode = 'strict' AND rule IS NULL OR mode = 'quarantine' AND NOT bad) AS n_scored,
  count(*) FILTER (WHERE mode = 'quarantine' AND bad) AS n_rejected, coalesce(any_value(rule), '') AS refused, true AS sound
FROM (SELECT *, ({_BAD_ROW}) OR (policy = 'reject' AND (tenure IS NULL OR MonthlyCharges IS NULL)) AS bad FROM holes CROSS JOIN (VALUES ('scaled_zero'), ('raw_zero'), ('reject')) p(policy))
CROSS JOIN (VALUES ('quarantine', NULL), ('strict', 'tenure')) m(mode, rule) GROUP BY policy, mode""", *_DIRTY, _HOLES))
def q_score_policies(spark, sf):
    """Both modes with each null policy over input with bad and null values: how many rows are scored and put aside, what
    refuses the strict batch, and whether probabilities, classes and decisions go together."""
    art = fitted(spark, sf).artifacts
    df = dirty_input(spark, sf).withColumn("tenure", F.when(F.substring("Customer_ID", 2, 20).cast("long") % 60 != 1, F.col("tenure")))
    out = []
    for policy in ("scaled_zero", "raw_zero", "reject"):
        good, bad = SCO.score_batch(df, art, mode="quarantine", null_policy=policy)
        p, cls = F.col("churn_proba"), F.col("churn_class")
        sound = p.between(0, 1) & ((cls == 1) == (F.col("decision") == DECISION_POSITIVE)) & ((cls == 1) == (p >= art.threshold) | (F.abs(p - art.threshold) <= 0.00005))
        facts = good.agg(F.count(F.lit(1)).alias("n_scored"), F.bool_and(sound).alias("sound")).join(bad.agg(F.count(F.lit(1)).alias("n_rejected")))  # one row each
        out.append(facts.select(F.lit(policy).alias("policy"), F.lit("quarantine").alias("mode"), "n_scored", "n_rejected", F.lit("").alias("refused"), "sound"))
        try:
            n, refused = SCO.score_batch(df, art, mode="strict", null_policy=policy)[0].count(), ""
        except SCO.ValidationError as e:
            n, refused = 0, str(e).rsplit(" ", 1)[-1]
        out.append(spark.range(1).select(F.lit(policy).alias("policy"), F.lit("strict").alias("mode"), F.lit(n).cast("long").alias("n_scored"),
                                         F.lit(0).cast("long").alias("n_rejected"), F.lit(refused).alias("refused"), F.lit(True).alias("sound")))
    return reduce(lambda a, b: a.unionByName(b), out)


@register("score_upload")
def q_score_upload(spark, sf):
    """Upload path: CSV written from the features (with 'NA' and junk tokens),
    scanned as text, scored leniently."""
    path = scratch_path(spark, "upload")
    art = fitted(spark, sf).artifacts
    df = dirty_input(spark, sf, art.encoding)
    k = F.substring("Customer_ID", 2, 20).cast("long")
    txt = df.select("Customer_ID", *[
        (F.when(k % 13 == 0, F.lit("NA")).when(k % 17 == 0, F.lit("abc")).otherwise(F.col(f).cast("string"))
         if f == "MonthlyCharges" else F.col(f).cast("string")).alias(f) for f in FEATURES], "note")
    IO.sink_table(txt, path, fmt="csv")
    up = IO.scan_upload(spark, path, columns=txt.columns)
    return SCO.score_upload(up, art)


def synthetic_decisions(spark, sf):
    return scored_predictions(spark, sf).select(
        "customerID", F.round("score", 4).alias("churn_proba"), F.col("pred").alias("churn_class"))


@register("decision_labels", sql(
    "SELECT customerID, round(score, 4) AS churn_proba, pred AS churn_class, round(round(score, 4) * 100, 2) AS proba_pct, "
    f"CASE WHEN pred = 1 THEN '{STATUS_POSITIVE}' ELSE '{STATUS_NEGATIVE}' END AS status, "
    f"CASE WHEN pred = 1 THEN '{LABEL_POSITIVE}' ELSE '{LABEL_NEGATIVE}' END AS class_label FROM pred", *_METRIC_CTES, _PRED))
def q_decision_labels(spark, sf):
    return SCO.decision_labels(synthetic_decisions(spark, sf))


# ----------------------------------------------------------------------------- §2.1 sources / sinks

@register("scan_csv", sql("SELECT * FROM customers_raw"))
def q_scan_csv(spark, sf):
    """Round trip: the raw table written as header CSV, scanned with its schema."""
    raw = customers_raw(spark, sf)
    path = scratch_path(spark, "raw-csv")
    IO.sink_table(raw, path, fmt="csv")
    return IO.scan_csv(spark, path, raw.schema)


def _scan_upload_sql():
    cols = ["CAST(Customer_ID AS VARCHAR) AS Customer_ID"]
    for f in FEATURES:
        if f == "tenure":
            cols.append("CASE WHEN k % 11 = 0 THEN NULL ELSE CAST(tenure AS VARCHAR) END AS tenure")
        else:
            cols.append(f"CAST({f} AS VARCHAR) AS {f}")
    return sql("SELECT " + ", ".join(cols) + " FROM (SELECT *, CAST(substr(Customer_ID, 2) AS BIGINT) AS k FROM dirty)",
               *_DIRTY)


@register("scan_upload", _scan_upload_sql())
def q_scan_upload(spark, sf):
    path = scratch_path(spark, "upload-scan")
    df = dirty_input(spark, sf).select("Customer_ID", *[F.col(f).cast("string").alias(f) for f in FEATURES])
    k = F.substring("Customer_ID", 2, 20).cast("long")
    df = df.withColumn("tenure", F.when(k % 11 == 0, F.lit(" NA ")).otherwise(F.concat(F.lit(" "), "tenure")))
    IO.sink_table(df, path, fmt="csv")
    return IO.scan_upload(spark, path, columns=df.columns)


def _scan_json_sql():
    bad = "k % 37 = 0"
    cols = [f"CASE WHEN {bad} THEN NULL ELSE CAST(Customer_ID AS VARCHAR) END AS customerID"]
    cols += [f"CASE WHEN {bad} THEN NULL ELSE CAST({f} AS VARCHAR) END AS {f}" for f in FEATURES]
    cols.append(f"CASE WHEN {bad} THEN substr('{{\"customerID\":\"' || Customer_ID || '\",\"gender\":', 1, 25) "
                "END AS _corrupt_record")
    return sql("SELECT " + ", ".join(cols) + " FROM (SELECT *, CAST(substr(Customer_ID, 2) AS BIGINT) AS k FROM dirty)",
               *_DIRTY)


@register("scan_json_profiles", _scan_json_sql())
def q_scan_json_profiles(spark, sf):
    """Profiles written as JSON lines (every 37th record truncated), read back
    with a permissive schema: malformed records kept in _corrupt_record."""
    path = scratch_path(spark, "profiles-json")
    df = dirty_input(spark, sf)
    k = F.substring("Customer_ID", 2, 20).cast("long")
    js = F.to_json(F.struct(F.col("Customer_ID").alias("customerID"), *FEATURES))
    df.select(F.when(k % 37 == 0, F.substring(js, 1, 25)).otherwise(js).alias("value")).write.text(path)
    return IO.scan_json_profiles(spark, path, FEATURES, multi_line=False)


@register("sink_table", sql("SELECT * FROM prepared", EXPLORED, PREPARED))
def q_sink_table(spark, sf):
    path = scratch_path(spark, "prepared")
    IO.sink_table(prepared(spark, sf), path)
    return spark.read.parquet(path)


@register("sink_predictions")
def q_sink_predictions(spark, sf):
    path = scratch_path(spark, "predictions")
    preds = SCO.score_upload(dirty_input(spark, sf), fitted(spark, sf).artifacts)
    IO.sink_predictions(preds, path, run_date="2026-01-01")
    schema = T.StructType([T.StructField(n, t) for n, t in [
        ("ID_CLIENT", T.StringType()), ("Churn_Proba", T.DoubleType()), ("Churn_Class", T.IntegerType()),
        ("Commentaire", T.StringType()), ("run_date", T.StringType())]])
    return spark.read.schema(schema).option("header", True).csv(path)


@register("save_artifacts", sql(_scaler_sql(), EXPLORED, PREPARED, _SPLIT))
def q_save_artifacts(spark, sf):
    """Round trip of the artefacts; returns the stored scaler, in feature order."""
    path = scratch_path(spark, "artifacts")
    IO.save_artifacts(spark, path, fitted(spark, sf).artifacts)
    folder = IO.published_set(spark, path)
    stored = spark.read.parquet(f"{folder}/scaler").join(spark.read.parquet(f"{folder}/features"), "feature")
    return stored.orderBy("pos").select("feature", "lo", "hi")


@register("load_artifacts")
def q_load_artifacts(spark, sf):
    """Saved then loaded artefacts score the test rows like the in-memory ones."""
    path = scratch_path(spark, "artifacts")
    art = fitted(spark, sf).artifacts
    IO.save_artifacts(spark, path, art)
    loaded = IO.load_artifacts(spark, path)
    test = dirty_input(spark, sf)
    scored_rows, _ = SCO.score_batch(test, loaded, mode="quarantine")
    return scored_rows.select("id_client", "churn_proba", F.lit(loaded.threshold).alias("threshold"))


# ----------------------------------------------------------------------------- §2.10 streaming

@register("score_stream")
def q_score_stream(spark, sf):
    """JSON-lines files of profiles → streaming scorer (availableNow) → scored
    and reject tables; returns the scored rows read back."""
    from attrition.streaming.score_stream import read_profile_stream, score_stream
    root = scratch_path(spark, "stream")
    src = f"{root}/in"
    df = dirty_input(spark, sf)
    k = F.substring("Customer_ID", 2, 20).cast("long")
    js = F.to_json(F.struct(F.col("Customer_ID").alias("customerID"), *FEATURES))
    df.select(F.when(k % 37 == 0, F.substring(js, 1, 25)).otherwise(js).alias("value")) \
        .repartition(4).write.text(src)
    q = score_stream(read_profile_stream(spark, src, FEATURES, max_files=2), fitted(spark, sf).artifacts,
                     f"{root}/scored", f"{root}/rejected", f"{root}/checkpoint")
    q.awaitTermination()
    return spark.read.parquet(f"{root}/scored")


# ----------------------------------------------------------------------------- §2.8, §2.10 requests
# Stand-in bodies: seven customers a request, written as JSON with the faults that a request may have.

def request_lines(spark, sf, encoding=None):
    """(r, body): by the request's number, some without ids, with text tenures, booleans, only null tenures or a
    missing feature, some a single object, some cut off; beside the bad values of ``dirty_input``."""
    df = dirty_input(spark, sf, encoding)
    k = F.substring("Customer_ID", 2, 20).cast("long")
    r = F.floor(k / 7)

    def part(name, value):
        return F.concat(F.lit(f'"{name}":'), value, F.lit(","))

    def number(c):
        return F.coalesce(F.col(c).cast("string"), F.lit("null"))

    flag = F.when(F.col("Partner") == 1, F.lit("true")).when(F.col("Partner") == 0, F.lit("false")).otherwise(F.lit("null"))
    rest = F.to_json(F.struct(*[f for f in FEATURES if f not in ("tenure", "Partner", "Contract_Two_year")], "note"))
    one = F.concat(
        F.lit("{"), F.when(r % 11 == 0, F.lit("")).otherwise(part("Customer_ID", F.concat(F.lit('"'), "Customer_ID", F.lit('"')))),
        part("tenure", F.when(r % 31 == 0, F.lit("null")).when(r % 13 == 0, F.concat(F.lit('"'), F.col("tenure").cast("string"), F.lit('"'))).otherwise(number("tenure"))),
        part("Partner", F.when(r % 17 == 0, flag).otherwise(number("Partner"))),
        F.when(r % 29 == 0, F.lit("")).otherwise(part("Contract_Two_year", number("Contract_Two_year"))), F.substring(rest, 2, 100_000))
    # seven objects a request: a group is bounded
    g = df.groupBy(r.alias("r")).agg(F.transform(F.array_sort(F.collect_list(F.struct(k.alias("k"), one.alias("o")))), lambda x: x["o"]).alias("o"))
    body = F.concat(F.lit("["), F.concat_ws(",", "o"), F.lit("]"))
    return g.select("r", F.when(F.col("r") % 19 == 0, F.substring(body, 1, 40)).when(F.col("r") % 23 == 0, F.col("o")[0]).otherwise(body).alias("body"))


def _requests_sql(body):
    binary_bad = " OR ".join(_bin_bad(f) for f in _BINARY)
    named = ", ".join(f"CASE WHEN bool_or({_bin_bad(f)}) THEN '{f}' END" for f in _BINARY)
    return sql(body, *_DIRTY, f"""rq AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY r ORDER BY k) - 1 AS INTEGER) AS pos
  FROM (SELECT *, CAST(floor(k / 7) AS BIGINT) AS r FROM (SELECT *, CAST(substr(Customer_ID, 2) AS BIGINT) AS k FROM dirty))),
rows_in AS (SELECT * FROM rq WHERE pos = 0 OR r % 23 <> 0 OR r % 19 = 0),
verdict AS (
  SELECT r, CASE WHEN r % 19 = 0 THEN 0 ELSE count(*) END AS n_rows,
    CASE WHEN r % 19 = 0 THEN 'invalid_json' WHEN r % 29 = 0 THEN 'missing_columns'
         WHEN r % 31 = 0 OR r % 13 = 0 OR bool_or(tenure < 0) THEN 'tenure' WHEN bool_or(MonthlyCharges <= 0) THEN 'MonthlyCharges'
         WHEN bool_or({binary_bad}) THEN 'binary' END AS rule,
    concat_ws(',', {named}) AS bad_binary
  FROM rows_in GROUP BY r)""")


@register("request_verdicts", _requests_sql("""SELECT 'r' || CAST(r AS VARCHAR) AS request, CAST(n_rows AS BIGINT) AS n_rows, rule IS NULL AS accepted, rule,
  CASE rule WHEN 'missing_columns' THEN 'Contract_Two_year' WHEN 'binary' THEN bad_binary WHEN 'tenure' THEN rule WHEN 'MonthlyCharges' THEN rule ELSE '' END AS columns
FROM verdict"""))
def q_request_verdicts(spark, sf):
    """One verdict a request: typed values, the first rule that fails and the columns at fault."""
    bodies = request_lines(spark, sf).select(F.concat(F.lit("r"), F.col("r").cast("string")).alias("request"), "body")
    v = RQ.request_verdicts(RQ.parse_requests(bodies))
    return v.select("request", "n_rows", "accepted", "rule", F.concat_ws(",", "columns").alias("columns"))


_ACCEPTED = _requests_sql("""SELECT 'r' || CAST(r AS VARCHAR) AS request, pos,
  CASE WHEN r % 11 = 0 THEN 'CLIENT_' || CAST(pos + 1 AS VARCHAR) ELSE Customer_ID END AS id_client, CAST(tenure AS DOUBLE) AS tenure,
  CAST(MonthlyCharges AS DOUBLE) AS "MonthlyCharges", CAST(Partner AS DOUBLE) AS "Partner"
FROM rows_in WHERE r IN (SELECT r FROM verdict WHERE rule IS NULL)""")


@register("json_requests", _ACCEPTED)
def q_json_requests(spark, sf):
    """Typed rows and ids of the accepted requests."""
    bodies = request_lines(spark, sf).select(F.concat(F.lit("r"), F.col("r").cast("string")).alias("request"), "body")
    rows = RQ.parse_requests(bodies)
    return RQ.accepted_rows(rows, RQ.request_verdicts(rows)).select("request", "pos", "id_client", "tenure", "MonthlyCharges", "Partner")


_SCORED_REQUESTS = _requests_sql("""SELECT count(*) AS n_rows, count(DISTINCT r) AS n_requests, CAST(sum(pos) AS BIGINT) AS positions, true AS sound,
  (SELECT count(*) FROM verdict WHERE rule IS NOT NULL) AS n_refused FROM rows_in WHERE r IN (SELECT r FROM verdict WHERE rule IS NULL)""")


def _scored_facts(scored, verdicts, art):
    """Whether the scored rows are those of the accepted requests, with probabilities and classes that go together."""
    p, cls = F.col("churn_proba"), F.col("churn_class")
    sound = p.between(0, 1) & F.col("version_model").eqNullSafe(F.lit(art.version)) & ((cls == 1) == (F.col("decision") == DECISION_POSITIVE)) \
        & ((cls == 1) == (p >= art.threshold) | (F.abs(p - art.threshold) <= 0.00005))
    return scored.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("request").alias("n_requests"), F.sum(F.col("pos").cast("long")).alias("positions"),
                      F.bool_and(sound).alias("sound"), F.lit(verdicts.where(~F.col("accepted")).count()).alias("n_refused"))


@register("score_requests", _SCORED_REQUESTS)
def q_score_requests(spark, sf):
    """Requests scored in a batch: all rows of the accepted ones, none of the others."""
    art = fitted(spark, sf).artifacts
    bodies = request_lines(spark, sf, art.encoding).select(F.concat(F.lit("r"), F.col("r").cast("string")).alias("request"), "body")
    return _scored_facts(*RQ.score_requests(bodies, art), art)


@register("score_request_stream", _SCORED_REQUESTS)
def q_score_request_stream(spark, sf):
    """The same requests as lines of files, through the stream."""
    from attrition.streaming.score_stream import score_request_stream
    root = scratch_path(spark, "requests")
    art = fitted(spark, sf).artifacts
    request_lines(spark, sf, art.encoding).repartition(4, "r").select(F.col("body").alias("value")).write.text(f"{root}/in")
    source = RQ.request_bodies(spark, f"{root}/in", per_line=True, stream=True, max_files=2)
    score_request_stream(source, art, f"{root}/scored", f"{root}/verdicts", f"{root}/checkpoint").awaitTermination()
    return _scored_facts(spark.read.parquet(f"{root}/scored"), spark.read.parquet(f"{root}/verdicts"), art)


# ----------------------------------------------------------------------------- additions (§2.3, §2.6)


@register("mid_ranks", sql(
    """SELECT variable, value, CAST(count(*) AS BIGINT) AS n,
  any_value(rk) + (count(*) - 1) / 2.0 AS mid_rank
FROM (SELECT variable, value, rank() OVER (PARTITION BY variable ORDER BY value) AS rk
      FROM long WHERE value IS NOT NULL) GROUP BY variable, value""", _LONG_NUM))
def q_mid_ranks(spark, sf):
    return _mid_ranks(customers_raw(spark, sf), NUMS)


@register("condition_proportions_no", sql(
    f"""SELECT variable, level, CAST(n AS BIGINT) AS n, CAST(k AS BIGINT) AS k, round(k / n, 6) AS prop,
  round(((k / n) + {_Z}^2 / (2 * n)) / (1 + {_Z}^2 / n)
        - {_Z} * sqrt((k / n) * (1 - k / n) / n + {_Z}^2 / (4 * n * n)) / (1 + {_Z}^2 / n), 6) AS lo,
  round(((k / n) + {_Z}^2 / (2 * n)) / (1 + {_Z}^2 / n)
        + {_Z} * sqrt((k / n) * (1 - k / n) / n + {_Z}^2 / (4 * n * n)) / (1 + {_Z}^2 / n), 6) AS hi
FROM (SELECT variable, value AS level, count(*) AS n, sum(hit) AS k FROM long GROUP BY variable, value)""",
    EXPLORED, "hits AS (SELECT *, CASE WHEN Churn = 'No' THEN 1 ELSE 0 END AS hit FROM explored)",
    f"long AS ({unpivot('hits', _PROP_BY, ids=['hit'])})"))
def q_condition_proportions_no(spark, sf):
    """Profile of customers who stayed (condition Churn = 'No')."""
    return P.condition_proportions(explored(spark, sf), "Churn = 'No'", _PROP_BY)


@register("value_segments", sql(
    """SELECT new_premium, old_economical, CAST(GROUPING(new_premium, old_economical) AS BIGINT) AS gid,
  CAST(sum(n) AS BIGINT) AS n, CAST(sum(k) AS BIGINT) AS k, round(sum(k) / sum(n), 6) AS rate,
  round((sum(k) / sum(n)) / (SELECT sum(k) / sum(n) FROM combos), 6) AS lift
FROM combos GROUP BY CUBE (new_premium, old_economical)""", EXPLORED,
    "med AS (SELECT quantile_cont(tenure, 0.5) AS mt, quantile_cont(MonthlyCharges, 0.5) AS mc FROM explored)",
    "base AS (SELECT CASE WHEN tenure < (SELECT mt FROM med) AND MonthlyCharges > (SELECT mc FROM med) "
    "THEN 1 ELSE 0 END AS new_premium, CASE WHEN tenure > (SELECT mt FROM med) AND MonthlyCharges < "
    "(SELECT mc FROM med) THEN 1 ELSE 0 END AS old_economical, CASE WHEN Churn = 'Yes' THEN 1 ELSE 0 END AS hit "
    "FROM explored)",
    "combos AS (SELECT new_premium, old_economical, count(*) AS n, sum(hit) AS k FROM base "
    "GROUP BY new_premium, old_economical)"))
def q_value_segments(spark, sf):
    """"New premium" (tenure below its median, charge above its median) and
    "old economical" (the reverse) — attrition rate and lift; cut points are
    the exact medians (two-phase prefix sums), passed as scalar subqueries."""
    ex = explored(spark, sf)
    med = quantile_values(prefix_sums(distinct_counts(ex, ["tenure", "MonthlyCharges"]), ["variable"], "value",
                                      ["n"]), ["variable"], "value", "n", {"m": 0.5})
    mt = med.filter(F.col("variable") == "tenure").select("m").scalar()
    mc = med.filter(F.col("variable") == "MonthlyCharges").select("m").scalar()
    flags = {"new_premium": (F.col("tenure") < mt) & (F.col("MonthlyCharges") > mc),
             "old_economical": (F.col("tenure") > mt) & (F.col("MonthlyCharges") < mc)}
    return P.risk_segments(ex, flags, "Churn", positive="Yes")


@register("shap_points")
def q_shap_points(spark, sf):
    """Summary-plot data: attribution with the feature value min–max scaled per feature."""
    fit = fitted(spark, sf)
    return XP.shap_points(XP.shap_values(fit.test, fit.artifacts.model, FEATURES, "customerID", top=10))
