"""The 21-column subscriber table, built from the customer and orders tables."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.functions.hashing import uniform_sql
from holdfast.functions.numbers import cents
from holdfast.schema import KEY, LEFT, STAYED, SUBSCRIBER, TARGET
from holdfast.sources.readers import table

# Order status of the last order as the contract it stands for.
CONTRACTS = {"F": "Month-to-month", "O": "One year", "P": "Two year"}

# Market segment as internet service.
INTERNET = {
    "AUTOMOBILE": "Fiber optic",
    "BUILDING": "Fiber optic",
    "FURNITURE": "DSL",
    "HOUSEHOLD": "DSL",
    "MACHINERY": "No",
}

# Columns that have no source and are drawn from the key.
DRAWN = [
    "gender",
    "Partner",
    "Dependents",
    "PhoneService",
    "MultipleLines",
    "OnlineSecurity",
    "OnlineBackup",
    "DeviceProtection",
    "TechSupport",
    "StreamingTV",
    "StreamingMovies",
    "PaperlessBilling",
]

# Order status and priority, in the order of their codes.
STATUSES = ["F", "O", "P"]
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]

INACTIVE_DAYS = 365

# Microseconds of an order's date and time, with or without time zone.
MICROS = """date_diff(cast(o_orderdate as date), date'1970-01-01') * 86400000000
    + (hour(o_orderdate) * 3600 + minute(o_orderdate) * 60) * 1000000L
    + cast(extract(second from o_orderdate) * 1000000 as bigint)"""


def _lookup(column: str, values: dict[str, str]) -> str:
    cases = " ".join(f"when '{k}' then '{v}'" for k, v in values.items())
    return f"case {column} {cases} end"


def _draw(name: str) -> str:
    """A fair draw from the key: a digest below 8... is a uniform number below one half."""
    yes, no = ("Female", "Male") if name == "gender" else ("Yes", "No")
    return f"if(md5(concat('{name}:', key)) < '8', '{yes}', '{no}')"


# Columns of the subscriber table over (key, tenure, total, last_..., c_mktsegment, inactive).
COLUMNS = {
    KEY: "key",
    "SeniorCitizen": f"if({uniform_sql('key', 'senior')} < 0.16D, 1, 0)",
    "tenure": "tenure",
    "MonthlyCharges": "coalesce(total div ((tenure + 1) * 1000) / 100D, 0D)",
    "TotalCharges": "if(tenure = 0, ' ', cast(cast(total / 100BD as decimal(22,2)) as string))",
    "Contract": f"coalesce({_lookup('last_status', CONTRACTS)}, 'Month-to-month')",
    "InternetService": _lookup("c_mktsegment", INTERNET),
    "PaymentMethod": "last_priority",
    TARGET: f"if(coalesce(inactive, true), '{LEFT}', '{STAYED}')",
} | {name: _draw(name) for name in DRAWN}


def snapshot(orders: DataFrame) -> Column:
    """Date of the newest order, a scalar subquery over a single column."""
    return orders.agg(F.max("o_orderdate")).scalar()


def order_history(orders: DataFrame) -> DataFrame:
    """One row per customer with orders: span, total in cents and traits of the last order.

    A customer with very many orders is reduced before the shuffle, in the map tasks. The
    last order is the largest of (date, key, codes) as one number: a buffer of fixed width,
    so Spark hashes customers instead of sorting the table by them.
    """
    status = F.coalesce(
        F.array_position(F.array(*map(F.lit, STATUSES)), F.col("o_orderstatus")), F.lit(0)
    )
    priority = F.coalesce(
        F.array_position(F.array(*map(F.lit, PRIORITIES)), F.col("o_orderpriority")), F.lit(0)
    )
    code = (status * 10 + priority).cast("decimal(2,0)")
    place = F.expr(MICROS).cast("decimal(17,0)") * F.lit(Decimal(10) ** 19)
    latest = place + F.coalesce("o_orderkey", F.lit(0)).cast("decimal(19,0)")
    packed = (latest.cast("decimal(36,0)") * F.lit(Decimal(100)) + code).cast("decimal(38,0)")
    history = orders.groupBy("o_custkey").agg(
        F.min("o_orderdate").alias("first_order"),
        F.max("o_orderdate").alias("last_order"),
        F.sum(cents(F.col("o_totalprice"))).alias("total"),
        F.max(packed).alias("last"),
    )
    # Never negative, also for orders before 1970.
    last = F.pmod(F.col("last"), F.lit(100)).cast("int")
    return history.select(
        "o_custkey",
        "first_order",
        "last_order",
        "total",
        _label(STATUSES, F.floor(last / 10).cast("int")).alias("last_status"),
        _label(PRIORITIES, last % 10).alias("last_priority"),
    )


def _label(labels: list[str], code: Column) -> Column:
    """The label with this code, counted from 1; null for code 0."""
    return F.when(code > 0, F.element_at(F.array(*map(F.lit, labels)), code))


# Whole months from the first to the last order. Every 97th customer is made brand-new,
# so that blanks exist at every size.
TENURE = """cast(if(last_order is null or c_custkey % 97 = 0, 0,
    (year(last_order) - year(first_order)) * 12 + month(last_order) - month(first_order)) as int)"""


def subscribers(spark: SparkSession, sf_dir: str, as_of: Column | None = None) -> DataFrame:
    """Subscriber table at `as_of` (default: date of the newest order).

    Unused columns cost nothing: Catalyst prunes them back into the Parquet scans.
    """
    orders = table(spark, sf_dir, "orders")
    as_of = snapshot(orders) if as_of is None else as_of
    joined = table(spark, sf_dir, "customer").join(
        order_history(orders), F.col("c_custkey") == F.col("o_custkey"), "left"
    )
    inactive = F.col("last_order") < as_of - F.expr(f"interval {INACTIVE_DAYS} days")
    return (
        joined.withColumns(
            {
                "key": F.col("c_custkey").cast("string"),
                "tenure": F.expr(TENURE),
                "inactive": inactive,
            }
        )
        .selectExpr(*(f"{COLUMNS[f.name]} as {f.name}" for f in SUBSCRIBER.fields))
    )
