"""The subscriber table: names, types and roles of its columns."""

from __future__ import annotations

from pyspark.sql import types as T

KEY = "customerID"
TARGET = "Churn"
LEFT = "Yes"
STAYED = "No"
SCORE = "Probability_Churn"
FLAG = "Prediction_Churn"
BAND = "Banda_Riesgo"

# The categorical features, in feature order.
CATEGORIES = [
    "gender",
    "Partner",
    "Dependents",
    "PhoneService",
    "MultipleLines",
    "InternetService",
    "OnlineSecurity",
    "OnlineBackup",
    "DeviceProtection",
    "TechSupport",
    "StreamingTV",
    "StreamingMovies",
    "Contract",
    "PaperlessBilling",
    "PaymentMethod",
]

# The numeric features, in feature order.
MEASURES = ["SeniorCitizen", "tenure", "MonthlyCharges", "TotalCharges"]

# TotalCharges is text on arrival because new subscribers carry a blank.
SUBSCRIBER = T.StructType(
    [T.StructField(KEY, T.StringType()), T.StructField("gender", T.StringType())]
    + [T.StructField("SeniorCitizen", T.IntegerType())]
    + [T.StructField(c, T.StringType()) for c in CATEGORIES if c != "gender"]
    + [
        T.StructField("tenure", T.IntegerType()),
        T.StructField("MonthlyCharges", T.DoubleType()),
        T.StructField("TotalCharges", T.StringType()),
        T.StructField(TARGET, T.StringType()),
    ]
)

# Risk bands, most urgent first.
HIGH, MEDIUM, LOW = "Riesgo Alto", "Riesgo Medio", "Riesgo Bajo"
BANDS = [HIGH, MEDIUM, LOW]
HIGH_ABOVE = 0.70
MEDIUM_FROM = 0.50


def text_columns(schema: T.StructType, without: tuple[str, ...] = (KEY,)) -> list[str]:
    """Every text column but the key: what gets indexed as a category."""
    return [
        f.name
        for f in schema.fields
        if isinstance(f.dataType, T.StringType) and f.name not in without
    ]


def numeric_columns(schema: T.StructType) -> list[str]:
    return [f.name for f in schema.fields if isinstance(f.dataType, T.NumericType)]
