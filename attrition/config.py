"""Column roles and the fixed values the scoring contract depends on.

``ChurnConfig`` names the columns an operator works on, so every operator
runs on any customer table whose roles are given here, not only on the
telco layout.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# ---------------------------------------------------------------------------
# FIXED VALUES — these must equal the reference for results to agree.
# ---------------------------------------------------------------------------

# The 21 model features, in model order.
FEATURES = [
    "gender", "SeniorCitizen", "Partner", "Dependents", "tenure", "PhoneService",
    "PaperlessBilling", "MonthlyCharges", "MultipleLines_No", "InternetService_DSL",
    "InternetService_Fiber_optic", "Contract_Month_to_month", "Contract_One_year",
    "Contract_Two_year", "PaymentMethod_Bank_transfer", "PaymentMethod_Credit_card",
    "PaymentMethod_Electronic_check", "PaymentMethod_Mailed_check", "ServiceSup_No",
    "ServiceSup_Yes", "No_Internet_Service",
]
# Features validated as numbers with bounds; every other feature must be 0 or 1.
CONTINUOUS_FEATURES = ["tenure", "MonthlyCharges"]

# The six add-on service columns merged into ServiceSup.
SERVICE_COLS = [
    "OnlineSecurity", "OnlineBackup", "DeviceProtection", "TechSupport",
    "StreamingTV", "StreamingMovies",
]
NO_INTERNET = "No internet service"

# Columns turned into one 0/1 column per level.
ONE_HOT_COLS = ["MultipleLines", "InternetService", "Contract", "PaymentMethod", "ServiceSup"]

# Renames applied to one-hot column names (spaces, hyphen and "(automatic)" removed).
LEVEL_RENAMES = {
    "MultipleLines_No phone service": "MultipleLines_No_phone_service",
    "ServiceSup_No internet service": "ServiceSup_No_internet_service",
    "PaymentMethod_Bank transfer (automatic)": "PaymentMethod_Bank_transfer",
    "PaymentMethod_Credit card (automatic)": "PaymentMethod_Credit_card",
    "PaymentMethod_Electronic check": "PaymentMethod_Electronic_check",
    "PaymentMethod_Mailed check": "PaymentMethod_Mailed_check",
    "InternetService_Fiber optic": "InternetService_Fiber_optic",
    "Contract_Month-to-month": "Contract_Month_to_month",
    "Contract_One year": "Contract_One_year",
    "Contract_Two year": "Contract_Two_year",
}

# Columns dropped after the one-hot step, and the one dropped before training.
PREP_DROPPED = [
    "ServiceSup_No_internet_service", "InternetService_No", "TotalCharges",
    "MultipleLines_No_phone_service",
]
TRAIN_DROPPED = ["MultipleLines_Yes"]

# Accepted names (lower-cased) of the customer id column, in priority order.
ID_ALIASES = ["customerid", "customer_id", "id_client", "id", "client_id"]
ID_PREFIX = "CLIENT_"

# Scoring output texts and defaults.
DEFAULT_THRESHOLD = 0.5
MODEL_VERSION = "1.2.0"
DECISION_POSITIVE = "Churn"
DECISION_NEGATIVE = "Non Churn"
COMMENT_POSITIVE = "Client susceptible de churner"
COMMENT_NEGATIVE = "Client peu susceptible de churner"
STATUS_POSITIVE = "Risque Churn"
STATUS_NEGATIVE = "Client Fidèle"
LABEL_POSITIVE = "Churn"
LABEL_NEGATIVE = "Stable"

# Scorecard indicators (in this order) and colour bands.
SCORECARD_INDICATORS = [
    "AUC (pouvoir discriminant)",
    "Précision globale",
    "Détection des churners (Rappel)",
    "Précision sur les alertes (Précision)",
    "Score équilibré (F1)",
]
BAND_GREEN = 0.80
BAND_YELLOW = 0.65

# Tuning grid and search budget.
GRID_FULL = {
    "max_depth": [3, 4, 5, 7],
    "eta": [0.01, 0.05, 0.1],
    "subsample": [0.7, 0.8, 0.9],
    "colsample_bytree": [0.7, 0.8, 0.9],
}
CV_FOLDS = 10
MAX_ROUNDS = 100
EARLY_STOP_ROUNDS = 20
SPLIT_SEED = 123
SPLIT_TRAIN_SHARE = 0.8
SAMPLE_SEED = 2026
SAMPLE_SIZE = 1000
# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class ChurnConfig:
    """Column roles of a customer table."""

    id_col: str = "customerID"
    target: str = "Churn"
    positive: str = "Yes"
    numeric: tuple = ("tenure", "MonthlyCharges", "TotalCharges")
    categorical: tuple = (
        "gender", "SeniorCitizen", "Partner", "Dependents", "PhoneService",
        "MultipleLines", "InternetService", "Contract", "PaperlessBilling",
        "PaymentMethod", "ServiceSup",
    )
    service_cols: tuple = tuple(SERVICE_COLS)
    service_out: str = "ServiceSup"
    one_hot: tuple = tuple(ONE_HOT_COLS)
    features: tuple = tuple(FEATURES)
    continuous: tuple = tuple(CONTINUOUS_FEATURES)
    vocab: dict = field(default_factory=dict)

    @property
    def binary_features(self) -> list:
        return [f for f in self.features if f not in self.continuous]


DEFAULT = ChurnConfig()
