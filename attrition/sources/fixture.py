"""The telco-shaped customer view over the star-schema test tables.

``customers_raw`` builds one row per customer from ``customer`` left-joined to
a per-customer aggregate of ``orders``: tenure from first/last order,
attrition from recency of the last order against the latest order date in
the table, contract from order count; the other attributes from key
arithmetic. The Spark plan and the DuckDB SQL text below compute the same
rows, so every oracle can start from the same CTE.

Plan shape: ``orders`` is reduced to one row per customer with a partial
(map-side) aggregate, so a customer holding a third of all orders costs one
partial row per input split; the latest order date is a scalar subquery
(one value); the join is on the customer key, on which the aggregate is
already hash-partitioned.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# FIXED VALUES — rules of the fixture (see FIXTURES.md §2).
CHURN_RECENCY_DAYS = 270
TENURE_CAP = 72
SEGMENT_NO_INTERNET = "MACHINERY"
SEGMENTS_DSL = ("FURNITURE", "BUILDING")
SERVICE_MODULI = (3, 4, 5, 6, 7, 8)
PAYMENT_LEVELS = ("Bank transfer (automatic)", "Credit card (automatic)",
                  "Electronic check", "Mailed check")

RAW_COLUMNS = [
    "customerID", "gender", "SeniorCitizen", "Partner", "Dependents", "tenure",
    "PhoneService", "MultipleLines", "InternetService", "OnlineSecurity",
    "OnlineBackup", "DeviceProtection", "TechSupport", "StreamingTV",
    "StreamingMovies", "Contract", "PaperlessBilling", "PaymentMethod",
    "MonthlyCharges", "TotalCharges", "Churn",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def customers_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """21-column raw customer table (see module docstring)."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate")
    cust = table(spark, sf_dir, "customer").select(
        "c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")

    latest = orders.select(F.max("o_orderdate")).scalar()
    per_cust = orders.groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("n_orders"),
        F.min("o_orderdate").alias("first_order"),
        F.max("o_orderdate").alias("last_order"),
    )
    j = cust.join(per_cust, cust.c_custkey == per_cust.o_custkey, "left")

    k, nk = F.col("c_custkey"), F.col("c_nationkey")
    seg = F.col("c_mktsegment")
    no_order = F.col("n_orders").isNull()
    span_days = F.datediff(F.to_date("last_order"), F.to_date("first_order"))
    tenure = F.when(no_order, F.lit(0)).otherwise(
        F.least(F.lit(TENURE_CAP), F.floor(span_days / F.lit(30.0)).cast("int"))).cast("int")
    monthly = F.round(F.lit(18.25) + F.abs(F.col("c_acctbal")) % F.lit(100.0), 2)

    def yes_no(cond):
        return F.when(cond, F.lit("Yes")).otherwise(F.lit("No"))

    services = [
        F.when(seg == SEGMENT_NO_INTERNET, F.lit("No internet service"))
        .otherwise(yes_no(k % m == 0)).alias(name)
        for name, m in zip(["OnlineSecurity", "OnlineBackup", "DeviceProtection",
                            "TechSupport", "StreamingTV", "StreamingMovies"], SERVICE_MODULI)
    ]
    pay = F.element_at(F.array(*[F.lit(p) for p in PAYMENT_LEVELS]), (nk % 4).cast("int") + 1)

    out = j.select(
        F.concat(F.lit("C"), k.cast("string")).alias("customerID"),
        F.when(k % 2 == 0, F.lit("Male")).otherwise(F.lit("Female")).alias("gender"),
        F.when(k % 6 == 0, F.lit(1)).otherwise(F.lit(0)).alias("SeniorCitizen"),
        yes_no(nk % 2 == 0).alias("Partner"),
        yes_no(k % 10 < 3).alias("Dependents"),
        tenure.alias("tenure"),
        F.when(k % 10 == 9, F.lit("No")).otherwise(F.lit("Yes")).alias("PhoneService"),
        F.when(k % 10 == 9, F.lit("No phone service"))
        .when(k % 4 < 2, F.lit("Yes")).otherwise(F.lit("No")).alias("MultipleLines"),
        F.when(seg == SEGMENT_NO_INTERNET, F.lit("No"))
        .when(seg.isin(*SEGMENTS_DSL), F.lit("DSL"))
        .otherwise(F.lit("Fiber optic")).alias("InternetService"),
        *services,
        F.when(no_order | (F.col("n_orders") <= 9), F.lit("Month-to-month"))
        .when(F.col("n_orders") <= 12, F.lit("One year"))
        .otherwise(F.lit("Two year")).alias("Contract"),
        yes_no(k % 5 < 3).alias("PaperlessBilling"),
        pay.alias("PaymentMethod"),
        monthly.alias("MonthlyCharges"),
        F.when(no_order | (F.datediff(F.to_date(latest), F.to_date("last_order"))
                           > CHURN_RECENCY_DAYS),
               F.lit("Yes")).otherwise(F.lit("No")).alias("Churn"),
    )
    out = out.withColumn(
        "TotalCharges",
        F.when(F.col("tenure") == 0, F.lit(None).cast("double"))
        .otherwise(F.round(F.col("tenure") * F.col("MonthlyCharges"), 2)),
    )
    return out.select(*RAW_COLUMNS)


# DuckDB text of the same view; every oracle begins with ``WITH customers_raw AS (...)``.
CUSTOMERS_RAW_SQL = f"""
per_cust AS (
  SELECT o_custkey, count(*) AS n_orders, min(o_orderdate) AS first_order,
         max(o_orderdate) AS last_order
  FROM orders GROUP BY o_custkey
),
latest AS (SELECT max(o_orderdate) AS mx FROM orders),
cj AS (
  SELECT c.c_custkey AS k, c.c_nationkey AS nk, c.c_acctbal AS bal, c.c_mktsegment AS seg,
         p.n_orders, p.first_order, p.last_order, (SELECT mx FROM latest) AS mx
  FROM customer c LEFT JOIN per_cust p ON c.c_custkey = p.o_custkey
),
cten AS (
  SELECT *,
    CAST(CASE WHEN n_orders IS NULL THEN 0
         ELSE least({TENURE_CAP}, CAST(floor(date_diff('day', CAST(first_order AS DATE),
                                                 CAST(last_order AS DATE)) / 30.0) AS INTEGER))
         END AS INTEGER) AS tenure,
    round(18.25 + abs(bal) % 100.0, 2) AS monthly
  FROM cj
),
customers_raw AS (
  SELECT
    'C' || CAST(k AS VARCHAR) AS customerID,
    CASE WHEN k % 2 = 0 THEN 'Male' ELSE 'Female' END AS gender,
    CASE WHEN k % 6 = 0 THEN 1 ELSE 0 END AS SeniorCitizen,
    CASE WHEN nk % 2 = 0 THEN 'Yes' ELSE 'No' END AS Partner,
    CASE WHEN k % 10 < 3 THEN 'Yes' ELSE 'No' END AS Dependents,
    tenure,
    CASE WHEN k % 10 = 9 THEN 'No' ELSE 'Yes' END AS PhoneService,
    CASE WHEN k % 10 = 9 THEN 'No phone service' WHEN k % 4 < 2 THEN 'Yes' ELSE 'No' END AS MultipleLines,
    CASE WHEN seg = 'MACHINERY' THEN 'No' WHEN seg IN ('FURNITURE', 'BUILDING') THEN 'DSL'
         ELSE 'Fiber optic' END AS InternetService,
    CASE WHEN seg = 'MACHINERY' THEN 'No internet service' WHEN k % 3 = 0 THEN 'Yes' ELSE 'No' END AS OnlineSecurity,
    CASE WHEN seg = 'MACHINERY' THEN 'No internet service' WHEN k % 4 = 0 THEN 'Yes' ELSE 'No' END AS OnlineBackup,
    CASE WHEN seg = 'MACHINERY' THEN 'No internet service' WHEN k % 5 = 0 THEN 'Yes' ELSE 'No' END AS DeviceProtection,
    CASE WHEN seg = 'MACHINERY' THEN 'No internet service' WHEN k % 6 = 0 THEN 'Yes' ELSE 'No' END AS TechSupport,
    CASE WHEN seg = 'MACHINERY' THEN 'No internet service' WHEN k % 7 = 0 THEN 'Yes' ELSE 'No' END AS StreamingTV,
    CASE WHEN seg = 'MACHINERY' THEN 'No internet service' WHEN k % 8 = 0 THEN 'Yes' ELSE 'No' END AS StreamingMovies,
    CASE WHEN n_orders IS NULL OR n_orders <= 9 THEN 'Month-to-month'
         WHEN n_orders <= 12 THEN 'One year' ELSE 'Two year' END AS Contract,
    CASE WHEN k % 5 < 3 THEN 'Yes' ELSE 'No' END AS PaperlessBilling,
    CASE nk % 4 WHEN 0 THEN 'Bank transfer (automatic)' WHEN 1 THEN 'Credit card (automatic)'
         WHEN 2 THEN 'Electronic check' ELSE 'Mailed check' END AS PaymentMethod,
    monthly AS MonthlyCharges,
    CASE WHEN tenure = 0 THEN NULL ELSE round(tenure * monthly, 2) END AS TotalCharges,
    CASE WHEN n_orders IS NULL
           OR date_diff('day', CAST(last_order AS DATE), CAST(mx AS DATE)) > {CHURN_RECENCY_DAYS}
         THEN 'Yes' ELSE 'No' END AS Churn
  FROM cten
)"""


def with_raw(body: str, *ctes: str) -> str:
    """Prefix an oracle query with the shared customers_raw CTE (and more CTEs)."""
    extra = "".join(f",\n{c}" for c in ctes)
    return f"WITH {CUSTOMERS_RAW_SQL.strip()}{extra}\n{body}"
