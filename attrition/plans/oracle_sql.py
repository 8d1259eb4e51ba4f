"""DuckDB SQL building blocks for the oracles (same semantics as the Spark plans)."""

from __future__ import annotations

from attrition.config import FEATURES, SERVICE_COLS
from attrition.sources.fixture import with_raw

CATS = ["gender", "SeniorCitizen", "Partner", "Dependents", "PhoneService", "MultipleLines",
        "InternetService", "Contract", "PaperlessBilling", "PaymentMethod", "ServiceSup"]
NUMS = ["tenure", "MonthlyCharges", "TotalCharges"]

_all_none = " AND ".join(f"{c} = 'No internet service'" for c in SERVICE_COLS)
_any_yes = " OR ".join(f"{c} = 'Yes'" for c in SERVICE_COLS)

EXPLORED = f"""explored AS (
  SELECT customerID, gender,
    CASE SeniorCitizen WHEN 0 THEN 'No' WHEN 1 THEN 'Yes' END AS SeniorCitizen,
    Partner, Dependents, tenure, PhoneService, MultipleLines, InternetService, Contract,
    PaperlessBilling, PaymentMethod, MonthlyCharges, TotalCharges, Churn,
    CASE WHEN {_all_none} THEN 'No internet service' WHEN {_any_yes} THEN 'Yes' ELSE 'No' END AS ServiceSup
  FROM customers_raw)"""


def _b(expr: str, name: str) -> str:
    return f"CASE WHEN {expr} THEN 1 ELSE 0 END AS {name}"


PREPARED = f"""prepared AS (
  SELECT customerID,
    {_b("gender = 'Male'", "gender")},
    {_b("SeniorCitizen = 'Yes'", "SeniorCitizen")},
    {_b("Partner = 'Yes'", "Partner")},
    {_b("Dependents = 'Yes'", "Dependents")},
    tenure,
    {_b("PhoneService = 'Yes'", "PhoneService")},
    {_b("PaperlessBilling = 'Yes'", "PaperlessBilling")},
    MonthlyCharges,
    {_b("MultipleLines = 'No'", "MultipleLines_No")},
    {_b("InternetService = 'DSL'", "InternetService_DSL")},
    {_b("InternetService = 'Fiber optic'", "InternetService_Fiber_optic")},
    {_b("Contract = 'Month-to-month'", "Contract_Month_to_month")},
    {_b("Contract = 'One year'", "Contract_One_year")},
    {_b("Contract = 'Two year'", "Contract_Two_year")},
    {_b("PaymentMethod = 'Bank transfer (automatic)'", "PaymentMethod_Bank_transfer")},
    {_b("PaymentMethod = 'Credit card (automatic)'", "PaymentMethod_Credit_card")},
    {_b("PaymentMethod = 'Electronic check'", "PaymentMethod_Electronic_check")},
    {_b("PaymentMethod = 'Mailed check'", "PaymentMethod_Mailed_check")},
    {_b("ServiceSup = 'No'", "ServiceSup_No")},
    {_b("ServiceSup = 'Yes'", "ServiceSup_Yes")},
    {_b("ServiceSup = 'No internet service' AND InternetService = 'No'", "No_Internet_Service")},
    {_b("Churn = 'Yes'", "Churn")}
  FROM explored)"""

FEATURE_LIST = ", ".join(FEATURES)


def split_flag(seed: int = 123, p: float = 0.8, id_col: str = "customerID") -> str:
    """DuckDB form of the deterministic hash split predicate."""
    cut = format(int(p * 2 ** 32), "08x")
    return f"(substr(md5(CAST({seed} AS VARCHAR) || ':' || {id_col}), 1, 8) < '{cut}')"


def fold_expr(seed: int, k: int, id_col: str = "customerID") -> str:
    return (f"CAST(CAST(('0x' || substr(md5(CAST({seed} AS VARCHAR) || ':' || {id_col}), 1, 8)) "
            f"AS BIGINT) % {k} AS INTEGER)")


def unpivot(table: str, cols, ids=(), cast: str | None = "VARCHAR", value: str = "value") -> str:
    """UNION ALL unpivot to (ids..., variable, value)."""
    idsel = "".join(f"{i}, " for i in ids)
    parts = []
    for c in cols:
        v = f"CAST({c} AS {cast})" if cast else c
        parts.append(f"SELECT {idsel}'{c}' AS variable, {v} AS {value} FROM {table}")
    return "\n  UNION ALL ".join(parts)


def sql(body: str, *ctes: str) -> str:
    return with_raw(body, *ctes)
