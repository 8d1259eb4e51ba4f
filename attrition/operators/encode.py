"""Schema-driven column work (§2.2): recodes, one-hot, feature preparation.

Data-dependent schemas (which string columns are Yes/No, which levels a
one-hot column has) cannot live in one lazy plan, so they are two-phase:
``learn_encoding`` runs one distributed distinct over all candidate
columns (Yes/No candidates reduced to three values first, one-hot levels
collected only under a size guard) and returns a small ``Encoding``; the
transform is then a single projection of ``when`` expressions (no shuffle).
At scoring time a stored ``Encoding`` replaces phase one.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attrition.config import (DEFAULT, LEVEL_RENAMES, NO_INTERNET, PREP_DROPPED,
                              TRAIN_DROPPED, ChurnConfig)

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
                 T.DoubleType, T.DecimalType)
CATEGORICAL_TYPES = (T.StringType, T.BooleanType)


# ---------------------------------------------------------------- projections

def drop_columns(df: DataFrame, cols) -> DataFrame:
    return df.drop(*cols)


def drop_matching(df: DataFrame, pattern: str, ignore_case: bool = True) -> DataFrame:
    """Drop every column whose name matches ``pattern`` (e.g. ``^Churn$``)."""
    rx = re.compile(pattern, re.IGNORECASE if ignore_case else 0)
    return df.drop(*[c for c in df.columns if rx.search(c)])


def columns_of_type(df: DataFrame, kind: str, exclude=()) -> list:
    types = NUMERIC_TYPES if kind == "numeric" else CATEGORICAL_TYPES
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, types) and f.name not in set(exclude)]


def select_by_type(df: DataFrame, kind: str, target: str | None = None) -> DataFrame:
    """Project the numeric or categorical columns, minus the target."""
    return df.select(*columns_of_type(df, kind, exclude=[target] if target else []))


def feature_projection(df: DataFrame, features, keep=()) -> DataFrame:
    """Strict, ordered projection to the feature list (missing → error)."""
    missing = [f for f in features if f not in df.columns]
    if missing:
        raise ValueError(f"missing feature columns: {missing}")
    return df.select(*keep, *features)


# ---------------------------------------------------------------- recodes

def slug_level(name: str) -> str:
    """Generic rename rule: drop ' (automatic)', spaces and hyphens → '_'."""
    return re.sub(r"[ \-]+", "_", re.sub(r"\s*\(automatic\)", "", name))


def rename_levels(df: DataFrame, mapping: dict | None = None) -> DataFrame:
    mapping = LEVEL_RENAMES if mapping is None else mapping
    present = {k: v for k, v in mapping.items() if k in df.columns}
    return df.withColumnsRenamed(present) if present else df


def recode_binary_int(df: DataFrame, col: str, labels=("No", "Yes")) -> DataFrame:
    """0/1 integer → labels[0]/labels[1]; anything else (and null) → null."""
    c = F.col(col)
    return df.withColumn(col, F.when(c == 0, F.lit(labels[0])).when(c == 1, F.lit(labels[1])))


def recode_gender(df: DataFrame, col: str = "gender", positive: str = "Male") -> DataFrame:
    """``positive`` → Yes, other non-null → No (so Male = 1 after recode_yes_no)."""
    c = F.col(col)
    return df.withColumn(col, F.when(c.isNull(), F.lit(None).cast("string"))
                         .when(c == positive, F.lit("Yes")).otherwise(F.lit("No")))


def coalesce_services(df: DataFrame, cols, out: str = "ServiceSup",
                      none_level: str = NO_INTERNET, yes: str = "Yes", no: str = "No",
                      drop: bool = True) -> DataFrame:
    """Row-wise merge: all = none_level → none_level; any = yes → yes; else no."""
    all_none = reduce(lambda a, b: a & b, [F.col(c) == none_level for c in cols])
    any_yes = reduce(lambda a, b: a | b, [F.col(c) == yes for c in cols])
    merged = F.when(all_none, F.lit(none_level)).when(any_yes, F.lit(yes)).otherwise(F.lit(no))
    df = df.withColumn(out, merged)
    return df.drop(*cols) if drop else df


def yes_no_expr(c: str, yes: str = "Yes") -> Column:
    col = F.col(c)
    return F.when(col.isNull(), F.lit(None).cast("int")) \
        .when(col == yes, F.lit(1)).otherwise(F.lit(0))


def no_internet_flag(df: DataFrame, service_none: str = "ServiceSup_No_internet_service",
                     internet_none: str = "InternetService_No",
                     out: str = "No_Internet_Service", drop=tuple(PREP_DROPPED)) -> DataFrame:
    a = F.col(service_none) if service_none in df.columns else F.lit(0)
    b = F.col(internet_none) if internet_none in df.columns else F.lit(0)
    df = df.withColumn(out, F.when((a == 1) & (b == 1), F.lit(1)).otherwise(F.lit(0)))
    return df.drop(*[c for c in drop if c in df.columns])


# ---------------------------------------------------------------- two-phase encoding

@dataclass
class Encoding:
    """Phase-one result: Yes/No columns and the one-hot vocabulary."""

    yes_no_cols: list = field(default_factory=list)
    vocab: dict = field(default_factory=dict)


_OTHER = "\u0000other"


def learn_encoding(df: DataFrame, yes_no_candidates=None, one_hot_cols=(),
                   yes: str = "Yes", no: str = "No") -> Encoding:
    """Phase one of the data-dependent encodings, in ONE distributed job.

    Yes/No candidates are mapped to {yes, no, other} (≤ 3 distinct values per
    column), one-hot columns keep their levels; both are unpivoted into
    (variable, value) and reduced by one distinct (partial aggregation, no
    single task holds a column). The driver receives one row per level, as many
    as the encoded table will have columns; ``one_hot_long`` is the form for
    columns with more levels than a table can have columns.
    """
    if yes_no_candidates is None:
        yes_no_candidates = columns_of_type(df, "categorical")
    cands, one_hot_cols = list(yes_no_candidates), list(one_hot_cols)
    if not cands and not one_hot_cols:
        return Encoding()
    sel = []
    for i, c in enumerate(cands):
        v = F.col(c).cast("string")
        sel.append(F.when(v.isNull(), F.lit(None).cast("string")).when(v.isin(yes, no), v)
                   .otherwise(F.lit(_OTHER)).alias(f"yn{i}"))
    sel += [F.col(c).cast("string").alias(f"oh{i}") for i, c in enumerate(one_hot_cols)]
    names = [f"yn{i}" for i in range(len(cands))] + [f"oh{i}" for i in range(len(one_hot_cols))]
    levels = df.select(*sel).unpivot([], names, "variable", "value") \
        .filter(F.col("value").isNotNull()).distinct()
    found: dict = {}
    for r in levels.collect():  # one job; as many rows as the result gets columns
        found.setdefault(r["variable"], []).append(r["value"])
    yn = [c for i, c in enumerate(cands)
          if found.get(f"yn{i}") and set(found[f"yn{i}"]) <= {yes, no}]
    vocab = {c: sorted(found.get(f"oh{i}", [])) for i, c in enumerate(one_hot_cols)}
    return Encoding(yes_no_cols=yn, vocab=vocab)


def recode_yes_no(df: DataFrame, yes: str = "Yes", no: str = "No",
                  columns: list | None = None) -> DataFrame:
    """Every string column whose non-null values are all in {yes, no} → 1/0.

    Null stays null; all-null columns and other columns are untouched.
    ``columns`` (a stored decision) skips the qualifying aggregation.
    """
    if columns is None:
        columns = learn_encoding(df, yes=yes, no=no).yes_no_cols
    cols = set(columns)
    return df.select(*[yes_no_expr(c, yes).alias(c) if c in cols else F.col(c)
                       for c in df.columns])


def one_hot(df: DataFrame, cols, vocab: dict | None = None, null_level: bool = False,
            drop: bool = True) -> DataFrame:
    """One 0/1 column ``<var>_<level>`` per level (levels sorted), source dropped.

    ``vocab`` fixes the levels (scoring); otherwise ``learn_encoding`` learns
    them in one distributed distinct. ``null_level`` adds ``<var>_NA``.
    """
    if vocab is None:
        vocab = learn_encoding(df, yes_no_candidates=[], one_hot_cols=list(cols)).vocab
    new = []
    for c in cols:
        for level in vocab.get(c, []):
            new.append(F.when(F.col(c) == level, F.lit(1)).otherwise(F.lit(0)).alias(f"{c}_{level}"))
        if null_level:
            new.append(F.when(F.col(c).isNull(), F.lit(1)).otherwise(F.lit(0)).alias(f"{c}_NA"))
    keep = [F.col(c) for c in df.columns if not (drop and c in set(cols))]
    return df.select(*keep, *new)


def one_hot_long(df: DataFrame, cols, id_col: str) -> DataFrame:
    """Sparse one-hot form for any number of levels: (id, variable, level), one
    row per set flag; nothing goes to the driver."""
    sel = [F.col(id_col)] + [F.col(c).cast("string").alias(c) for c in cols]
    return df.select(*sel).unpivot([id_col], list(cols), "variable", "level").filter(F.col("level").isNotNull())


def explore_recode(df: DataFrame, cfg: ChurnConfig = DEFAULT) -> DataFrame:
    """The exploration-stage table: services merged, SeniorCitizen as No/Yes."""
    df = coalesce_services(df, list(cfg.service_cols), out=cfg.service_out)
    return recode_binary_int(df, "SeniorCitizen")


def _learn(recoded: DataFrame, cfg: ChurnConfig) -> Encoding:
    cand = [c for c in columns_of_type(recoded, "categorical") if c != cfg.id_col]
    return learn_encoding(recoded, yes_no_candidates=cand, one_hot_cols=list(cfg.one_hot))


def learn_features(df: DataFrame, cfg: ChurnConfig = DEFAULT) -> Encoding:
    """The encoding ``prepare_features`` would learn from ``df``, to be stored."""
    return _learn(recode_gender(explore_recode(df, cfg), "gender"), cfg)


def prepare_features(df: DataFrame, cfg: ChurnConfig = DEFAULT,
                     encoding: Encoding | None = None, keep_id: bool = True) -> DataFrame:
    """Raw 21-column table → id + 21 features + target (0/1), in model order.

    Narrow transformations only; phase one (skipped when ``encoding`` is
    given) is one aggregation producing a single row.
    """
    df = recode_gender(explore_recode(df, cfg), "gender")
    if encoding is None:
        encoding = _learn(df, cfg)
    df = recode_yes_no(df, columns=encoding.yes_no_cols)
    df = one_hot(df, list(cfg.one_hot), vocab=encoding.vocab)
    df = rename_levels(df)
    df = no_internet_flag(df)
    df = df.drop(*[c for c in TRAIN_DROPPED if c in df.columns])
    for f in cfg.features:  # a level absent from the data still yields its column
        if f not in df.columns:
            df = df.withColumn(f, F.lit(0))
    head = [cfg.id_col] if keep_id and cfg.id_col in df.columns else []
    return df.select(*head, *cfg.features, F.col(cfg.target).cast("int").alias(cfg.target))


# ---------------------------------------------------------------- scoring-side encoders

def encode_profiles(df: DataFrame, cfg: ChurnConfig = DEFAULT, keep=()) -> DataFrame:
    """Categorical profiles (form values) → the 21 numeric features.

    Binary inputs are 0/1 (gender: 1 = Male, the training encoding);
    Contract, PaymentMethod, MultipleLines, InternetService, ServiceSup carry
    the form's level names. No internet forces both ServiceSup flags to 0;
    no phone forces MultipleLines_No to 0 (as in the training table).
    """
    def eq(c, v):
        return F.when(F.col(c) == v, F.lit(1)).otherwise(F.lit(0))

    no_net = F.col("InternetService") == "No"
    has_phone = F.col("PhoneService").cast("int") == 1
    cols = {
        "gender": F.col("gender").cast("int"),
        "SeniorCitizen": F.col("SeniorCitizen").cast("int"),
        "Partner": F.col("Partner").cast("int"),
        "Dependents": F.col("Dependents").cast("int"),
        "tenure": F.col("tenure").cast("int"),
        "PhoneService": F.col("PhoneService").cast("int"),
        "PaperlessBilling": F.col("PaperlessBilling").cast("int"),
        "MonthlyCharges": F.col("MonthlyCharges").cast("double"),
        "MultipleLines_No": F.when(has_phone & (F.col("MultipleLines") == "No"), F.lit(1))
        .otherwise(F.lit(0)),
        "InternetService_DSL": eq("InternetService", "DSL"),
        "InternetService_Fiber_optic": eq("InternetService", "Fiber_optic"),
        "Contract_Month_to_month": eq("Contract", "Month_to_month"),
        "Contract_One_year": eq("Contract", "One_year"),
        "Contract_Two_year": eq("Contract", "Two_year"),
        "PaymentMethod_Bank_transfer": eq("PaymentMethod", "Bank_transfer"),
        "PaymentMethod_Credit_card": eq("PaymentMethod", "Credit_card"),
        "PaymentMethod_Electronic_check": eq("PaymentMethod", "Electronic_check"),
        "PaymentMethod_Mailed_check": eq("PaymentMethod", "Mailed_check"),
        "ServiceSup_No": F.when((F.col("ServiceSup") == "No") & ~no_net, F.lit(1)).otherwise(F.lit(0)),
        "ServiceSup_Yes": F.when((F.col("ServiceSup") == "Yes") & ~no_net, F.lit(1)).otherwise(F.lit(0)),
        "No_Internet_Service": F.when(no_net, F.lit(1)).otherwise(F.lit(0)),
    }
    return df.select(*keep, *[cols[f].alias(f) for f in cfg.features])


def missing_flags(df: DataFrame, policy: str, cols) -> DataFrame:
    """Null policy per entry point: 'zero' fills 0, 'keep' leaves null,
    'flag' adds ``<col>_missing`` 0/1 columns beside the originals."""
    if policy == "keep":
        return df
    if policy == "zero":
        return df.fillna(0, subset=list(cols))
    if policy == "flag":
        return df.select("*", *[F.col(c).isNull().cast("int").alias(f"{c}_missing") for c in cols])
    raise ValueError(f"unknown null policy {policy!r}")


def safe_numeric(df: DataFrame, cols, fill: float | None = 0.0) -> DataFrame:
    """Text → double; unparsable and null → ``fill`` (null when fill is None)."""
    def conv(c):
        v = F.col(c).try_cast("double")
        return (F.coalesce(v, F.lit(float(fill))) if fill is not None else v).alias(c)
    cs = set(cols)
    return df.select(*[conv(c) if c in cs else F.col(c) for c in df.columns])


def condition_filter(df: DataFrame, cond) -> DataFrame:
    return df.filter(F.expr(cond) if isinstance(cond, str) else cond)
