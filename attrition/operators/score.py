"""Scoring contract (§2.8): validate, resolve ids, scale, score, label.

Validation and scoring are narrow transformations (no shuffle); the model
and the scaler travel to tasks as part of the plan. Two batch modes:

* ``strict`` — any bad row fails the batch with a report, and so does an
  empty input (for requests with typed values, see ``sources.requests``);
  checks run in this order: schema, tenure, charges, binary features;
* ``quarantine`` — good rows are scored, bad rows go to a reject table with
  their reasons.

Null policy for the two continuous features (the reference differs by entry
point): ``scaled_zero`` (null passes the checks, becomes 0 after scaling),
``raw_zero`` (0 before scaling), ``reject``.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attrition.config import (COMMENT_NEGATIVE, COMMENT_POSITIVE, CONTINUOUS_FEATURES,
                              DECISION_NEGATIVE, DECISION_POSITIVE, DEFAULT_THRESHOLD, FEATURES,
                              ID_ALIASES, ID_PREFIX, LABEL_NEGATIVE, LABEL_POSITIVE, MODEL_VERSION,
                              STATUS_NEGATIVE, STATUS_POSITIVE)
from attrition.operators.rank import row_ids
from attrition.operators.scale import apply_range_scaler

class ValidationError(ValueError):
    def __init__(self, message: str, report=None):
        super().__init__(message)
        self.report = report


@dataclass
class Artifacts:
    model: object
    features: list = field(default_factory=lambda: list(FEATURES))
    scaler: dict = field(default_factory=dict)  # feature → (lo, hi)
    threshold: float = DEFAULT_THRESHOLD
    version: str = MODEL_VERSION
    encoding: object = None  # encode.Encoding of the training table, to prepare raw rows without re-learning levels


# ----------------------------------------------------------------------------- schema and ids

def validate_schema(df: DataFrame, features, id_col: str | None = None) -> DataFrame:
    """column, status ∈ {missing, extra, ok}: set differences of the schema
    (no job runs)."""
    spark = df.sparkSession
    id_col = id_col if id_col is not None else resolve_id_column(df)
    cols = set(df.columns)
    rows = [(f, "missing") for f in features if f not in cols]
    rows += [(c, "extra") for c in df.columns if c not in set(features) and c != id_col]
    rows += [(f, "ok") for f in features if f in cols]
    return spark.createDataFrame(rows, "column string, status string")


def resolve_id_column(df: DataFrame, aliases=tuple(ID_ALIASES)) -> str | None:
    """First column, in table order, whose lower-cased name is an alias."""
    for c in df.columns:
        if c.lower() in aliases:
            return c
    return None


def resolve_id(df: DataFrame, aliases=tuple(ID_ALIASES), out: str = "id_client",
               order_by: str | None = None) -> DataFrame:
    """``df`` + ``out`` (string): the id column cast to string, or
    ``CLIENT_1..n`` when there is none."""
    c = resolve_id_column(df, aliases)
    if c is not None:
        return df.withColumn(out, F.col(c).cast("string"))
    return row_ids(df, order_by=order_by, prefix=ID_PREFIX, out=out)


# ----------------------------------------------------------------------------- row rules

_NUMERIC_DTYPES = {"tinyint", "smallint", "int", "bigint", "float", "double"}


def _is_number(t: str) -> bool:
    return t in _NUMERIC_DTYPES or t.startswith("decimal")


def _num(c: str, types: dict | None = None) -> Column:
    """Column as double: a plain cast for numeric inputs, 1 and 0 for true and false;
    text is parsed with ``try_cast`` (unparsable → null); other types go through their text."""
    t = (types or {}).get(c, "string")
    if _is_number(t):
        return F.col(c).cast("double")
    if t == "boolean":
        return F.col(c).cast("int").cast("double")
    if t == "string":
        return F.col(c).try_cast("double")
    return F.col(c).cast("string").try_cast("double")


def _not_numeric(c: str, types: dict | None = None, text: str = "refuse") -> Column:
    """``text="refuse"``: only numbers are numbers, as in the scoring request; ``"parse"``: so is text that reads as one."""
    if text == "refuse":
        return F.lit(False) if _is_number((types or {}).get(c, "string")) else F.col(c).isNotNull()
    return F.col(c).isNotNull() & _num(c, types).isNull()


def tenure_bad(c: str = "tenure", types: dict | None = None, text: str = "refuse") -> Column:
    return _not_numeric(c, types, text) | (_num(c, types) < 0)


def charges_bad(c: str = "MonthlyCharges", types: dict | None = None, text: str = "refuse") -> Column:
    return _not_numeric(c, types, text) | (_num(c, types) <= 0)


def binary_bad(c: str, types: dict | None = None, text: str = "refuse") -> Column:
    """Null, or not 0 or 1; of texts only "0" and "1" count, unless they are parsed."""
    if text == "refuse" and (types or {}).get(c, "string") == "string":
        return ~F.coalesce(F.col(c).isin("0", "1"), F.lit(False))
    return F.col(c).isNull() | ~F.coalesce(_num(c, types).isin(0.0, 1.0), F.lit(False))


def validate_tenure(df: DataFrame, col: str = "tenure", out: str = "tenure_invalid", text: str = "refuse") -> DataFrame:
    """``df`` + boolean: not a number or < 0 (null allowed)."""
    return df.withColumn(out, F.coalesce(tenure_bad(col, dict(df.dtypes), text), F.lit(False)))


def validate_charges(df: DataFrame, col: str = "MonthlyCharges", out: str = "charges_invalid", text: str = "refuse") -> DataFrame:
    """``df`` + boolean: not a number or ≤ 0 (null allowed)."""
    return df.withColumn(out, F.coalesce(charges_bad(col, dict(df.dtypes), text), F.lit(False)))


def validate_binary(df: DataFrame, cols, out: str = "invalid_columns", text: str = "refuse") -> DataFrame:
    """``df`` + array of the binary columns that are null or not 0/1."""
    types = dict(df.dtypes)
    arr = F.array_compact(F.array(*[F.when(binary_bad(c, types, text), F.lit(c)) for c in cols]))
    return df.withColumn(out, arr)


def reasons(df: DataFrame, features, null_policy: str = "scaled_zero", text: str = "refuse") -> Column:
    """Array of reasons for one row, rules in the reference's order."""
    cont = [c for c in CONTINUOUS_FEATURES if c in features]
    binary = [f for f in features if f not in cont]
    types = dict(df.dtypes)
    parts = []
    if "tenure" in cont:
        parts.append(F.when(tenure_bad("tenure", types, text), F.lit("tenure")))
    if "MonthlyCharges" in cont:
        parts.append(F.when(charges_bad("MonthlyCharges", types, text), F.lit("MonthlyCharges")))
    if null_policy == "reject":
        parts += [F.when(F.col(c).isNull(), F.lit(f"{c}:null")) for c in cont]
    parts += [F.when(binary_bad(c, types, text), F.lit(f"binary:{c}")) for c in binary]
    return F.array_compact(F.array(*parts))


def validation_report(df: DataFrame, features=tuple(FEATURES), text: str = "refuse") -> DataFrame:
    """rule, column, n_bad — one aggregation of count_ifs, unpivoted."""
    cont = [c for c in CONTINUOUS_FEATURES if c in features]
    binary = [f for f in features if f not in cont]
    types = dict(df.dtypes)
    checks = []
    if "tenure" in cont:
        checks.append(("tenure", "tenure", tenure_bad("tenure", types, text)))
    if "MonthlyCharges" in cont:
        checks.append(("MonthlyCharges", "MonthlyCharges", charges_bad("MonthlyCharges", types, text)))
    checks += [("binary", c, binary_bad(c, types, text)) for c in binary]
    wide = df.agg(*[F.count_if(F.coalesce(e, F.lit(False))).alias(f"c{i}") for i, (_, _, e) in enumerate(checks)])
    stack = ", ".join(f"'{r}', '{c}', c{i}" for i, (r, c, _) in enumerate(checks))
    return wide.selectExpr(f"stack({len(checks)}, {stack}) AS (rule, column, n_bad)") \
        .select("rule", "column", F.col("n_bad").cast("long").alias("n_bad"))


# ----------------------------------------------------------------------------- scoring

def _model_inputs(df: DataFrame, art: Artifacts, null_policy: str) -> DataFrame:
    feats = art.features
    types = dict(df.dtypes)
    x = df.select("*", *[_num(f, types).alias(f"_x_{f}") for f in feats])
    if null_policy == "raw_zero":
        x = x.select("*", *[F.coalesce(F.col(f"_x_{f}"), F.lit(0.0)).alias(f"_r_{f}") for f in feats])
        src = "_r_"
    else:
        src = "_x_"
    scaled = apply_range_scaler(x.select("*", *[F.col(f"{src}{f}").alias(f"_s_{f}") for f in feats]),
                                {f"_s_{f}": art.scaler[f] for f in feats if f in art.scaler})
    # after scaling every remaining null becomes 0 (matrix fill)
    return scaled.select("*", *[F.coalesce(F.col(f"_s_{f}"), F.lit(0.0)).alias(f"_m_{f}") for f in feats])


def _predict(x: DataFrame, art: Artifacts, keep=()) -> DataFrame:
    """id_client + ``keep`` + model columns; ``_p`` = probability of the positive class."""
    inp = x.select("id_client", *keep, *[F.col(f"_m_{f}").alias(f) for f in art.features])
    return art.model.transform(inp).withColumn("_p", vector_to_array("probability")[1])


def score_rows(good: DataFrame, art: Artifacts, null_policy: str = "scaled_zero", keep=()) -> DataFrame:
    """``keep`` + id_client, churn_proba (4 decimals), churn_class (unrounded probability ≥ threshold), decision,
    version_model of rows that passed the checks."""
    p = _predict(_model_inputs(good, art, null_policy), art, keep)
    cls = F.when(F.col("_p") >= F.lit(float(art.threshold)), 1).otherwise(0)
    return p.select(
        *keep, "id_client", F.round("_p", 4).alias("churn_proba"), cls.alias("churn_class"),
        F.when(cls == 1, F.lit(DECISION_POSITIVE)).otherwise(F.lit(DECISION_NEGATIVE)).alias("decision"),
        F.lit(art.version).alias("version_model"))


def score_batch(df: DataFrame, art: Artifacts, mode: str = "strict", null_policy: str = "scaled_zero",
                id_order: str | None = None, text: str = "refuse"):
    """(scored, rejected).

    scored: the columns of ``score_rows``.
    rejected: id_client, reasons (quarantine mode; empty in strict mode).
    ``text="parse"`` lets text that reads as a number pass for one.
    """
    missing = [f for f in art.features if f not in df.columns]
    if missing:
        raise ValidationError(f"missing feature columns: {missing}",
                              validate_schema(df, art.features))
    with_id = resolve_id(df, order_by=id_order)
    checked = with_id.withColumn("_reasons", reasons(with_id, art.features, null_policy, text))
    if mode == "strict":
        broken = {k: F.array_contains("_reasons", k) for k in CONTINUOUS_FEATURES}
        broken |= {"null": F.exists("_reasons", lambda r: r.endswith(":null")), "binary": F.exists("_reasons", lambda r: r.startswith("binary:"))}
        first = checked.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(c).alias(k) for k, c in broken.items()]).first()  # emptiness and every rule
        if first["n"] == 0:
            raise ValidationError("empty input")
        bad = next((k for k in broken if first[k]), None)
        if bad is not None:
            raise ValidationError(f"validation failed: rule {bad}", validation_report(df, art.features, text))
        good = checked
        rejected = df.sparkSession.createDataFrame([], "id_client string, reasons array<string>")
    elif mode == "quarantine":
        good = checked.filter(F.size("_reasons") == 0)  # of an empty input, nothing: looking first would run it twice
        rejected = checked.filter(F.size("_reasons") > 0).select("id_client", F.col("_reasons").alias("reasons"))
    else:
        raise ValueError(f"unknown mode {mode!r}")
    return score_rows(good, art, null_policy), rejected


def score_upload(df: DataFrame, art: Artifacts, id_order: str | None = None) -> DataFrame:
    """ID_CLIENT, Churn_Proba, Churn_Class (int), Commentaire — lenient:
    no bounds checks, unparsable or null features → 0 before scaling."""
    missing = [f for f in art.features if f not in df.columns]
    if missing:
        raise ValidationError(f"missing feature columns: {missing}", validate_schema(df, art.features))
    with_id = resolve_id(df, order_by=id_order)
    p = _predict(_model_inputs(with_id, art, "raw_zero"), art)
    pos = F.col("_p") >= F.lit(float(art.threshold))
    return p.select(F.col("id_client").alias("ID_CLIENT"), F.round("_p", 4).alias("Churn_Proba"),
                    F.when(pos, 1).otherwise(0).alias("Churn_Class"),
                    F.when(pos, F.lit(COMMENT_POSITIVE)).otherwise(F.lit(COMMENT_NEGATIVE)).alias("Commentaire"))


def decision_labels(df: DataFrame, proba: str = "churn_proba", cls: str = "churn_class") -> DataFrame:
    """``df`` + proba_pct (2 decimals), status text, class label."""
    pos = F.col(cls) == 1
    return df.select("*", F.round(F.col(proba) * 100, 2).alias("proba_pct"),
                     F.when(pos, F.lit(STATUS_POSITIVE)).otherwise(F.lit(STATUS_NEGATIVE)).alias("status"),
                     F.when(pos, F.lit(LABEL_POSITIVE)).otherwise(F.lit(LABEL_NEGATIVE)).alias("class_label"))
