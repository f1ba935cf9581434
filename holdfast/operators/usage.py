"""Billing, usage and complaint tables: joins, repairs and features per subscriber."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from holdfast.functions.numbers import money_sum
from holdfast.schema import KEY

# The kinds of usage events.
EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]

# Words that mark a complaint text, per language.
COMPLAINT_WORDS = {
    "en": ["awful", "broken", "idiot", "problem", "slow", "stupid", "worthless"],
    "es": ["horrible", "roto", "idiota", "problema", "lento", "estúpido", "inútil"],
    "de": ["furchtbar", "kaputt", "idiot", "problem", "langsam", "dumm", "wertlos"],
    "fr": ["affreux", "cassé", "idiot", "problème", "lent", "stupide", "inutile"],
}


def billing_by_customer(orders: DataFrame) -> DataFrame:
    """(o_custkey, n_orders, billed)."""
    return orders.groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("n_orders"), money_sum(F.col("o_totalprice")).alias("billed")
    )


def usage_by_user(events: DataFrame, types: Sequence[str] = EVENT_TYPES) -> DataFrame:
    """Per user: events in all and per type, share of errors, spend and the `k` property."""
    n = F.count(F.lit(1))
    k = F.get_json_object("props", "$.k").try_cast("int")
    return events.withColumn("k", k).groupBy("user_id").agg(
        n.alias("n_events"),
        *(F.count_if(F.col("event_type") == t).alias(f"n_{t}") for t in types),
        (F.count_if(F.col("event_type") == "error") / n).alias("error_share"),
        money_sum(F.col("value")).alias("usage_value"),
        F.sum("k").alias("k_total"),
        F.max("k").alias("k_max"),
    )


def usage_by_day(events: DataFrame) -> DataFrame:
    """(user_id, usage_day, n_events, usage_value)."""
    return events.groupBy("user_id", F.col("ts").cast("date").alias("usage_day")).agg(
        F.count(F.lit(1)).alias("n_events"), money_sum(F.col("value")).alias("usage_value")
    )


def customer_view(
    customer: DataFrame, nation: DataFrame, region: DataFrame, orders: DataFrame, events: DataFrame
) -> DataFrame:
    """One row per customer with place, billing and usage.

    Both fact tables are reduced to one row per customer before they are joined, so a
    customer with very many orders or events weighs no more than any other. Spark picks
    the join per side from measured sizes.
    """
    places = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    usage = events.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n_events"), money_sum(F.col("value")).alias("usage_value")
    )
    return (
        customer.join(places, F.col("c_nationkey") == F.col("n_nationkey"), "left")
        .join(billing_by_customer(orders), F.col("c_custkey") == F.col("o_custkey"), "left")
        .join(usage, F.col("c_custkey") == F.col("user_id"), "left")
        .select(
            F.col("c_custkey").cast("string").alias(KEY),
            F.col("n_name").alias("nation"),
            F.col("r_name").alias("region"),
            F.col("c_mktsegment").alias("segment"),
            F.coalesce("n_orders", F.lit(0)).alias("n_orders"),
            F.coalesce("billed", F.lit(0.0)).alias("billed"),
            F.coalesce("n_events", F.lit(0)).alias("n_events"),
            F.coalesce("usage_value", F.lit(0.0)).alias("usage_value"),
        )
    )


def keep_latest(df: DataFrame, same: Sequence[Column], row_id: str) -> DataFrame:
    """One row per distinct `same`: the one with the largest `row_id`, which must be unique.

    Copies meet as (digest, id) pairs that are reduced before the shuffle; a text copied
    into a third of the table is never gathered in one place.
    """
    digest = F.sha2(F.to_json(F.struct(*(c.alias(f"c{i}") for i, c in enumerate(same)))), 256)
    latest = df.groupBy(digest.alias("digest")).agg(F.max(row_id).alias(row_id))
    return df.join(latest.select(row_id), row_id, "left_semi")


def billing_month(date: Column, cycle_day: int = 1) -> Column:
    """First day of the billing month of a date, for cycles that start on `cycle_day`."""
    return F.trunc(F.date_sub(date.cast("date"), cycle_day - 1), "MM")


def billing_cycles(orders: DataFrame, cycle_day: int = 1) -> DataFrame:
    """(o_custkey, month, n_orders, billed): an unbroken run of months per customer.

    Bills are moved to their cycle's month; months without a bill between two others
    appear with zeros.
    """
    billed = orders.groupBy(
        "o_custkey", billing_month(F.col("o_orderdate"), cycle_day).alias("start")
    ).agg(F.count(F.lit(1)).alias("n"), money_sum(F.col("o_totalprice")).alias("amount"))
    # One row per customer and calendar month reaches the window, however many bills there are.
    following = F.lead("start").over(Window.partitionBy("o_custkey").orderBy("start"))
    until = F.coalesce(F.add_months(F.col("following"), -1), F.col("start"))
    months = F.sequence(F.col("start"), until, F.expr("interval 1 month"))
    real = F.col("month") == F.col("start")
    return (
        billed.withColumn("following", following)
        .withColumn("month", F.explode(months))
        .select(
            "o_custkey",
            "month",
            F.when(real, F.col("n")).otherwise(0).alias("n_orders"),
            F.when(real, F.col("amount")).otherwise(0.0).alias("billed"),
        )
    )


def cycle_days(daily: DataFrame) -> DataFrame:
    """(o_custkey, cycle_day): the day of the month around which a customer's bills fall.

    Days lie on a circle of 31. A day's weight is the number of bills on it and on its two
    neighbours; the heaviest day wins, of equally heavy ones that with the most bills of its own,
    then the smallest. `daily` holds (o_custkey, billed_on, n), so a customer weighs 31 rows,
    however many bills there are.
    """
    counts = daily.groupBy("o_custkey", F.dayofmonth("billed_on").alias("dom")).agg(
        F.sum("n").alias("n")
    )
    near = F.array(
        *(
            F.struct(
                (F.pmod(F.col("dom") - 1 + F.lit(k), F.lit(31)) + 1).alias("day"),
                (F.col("n") if k == 0 else F.lit(0).cast("bigint")).alias("own"),
            )
            for k in (-1, 0, 1)
        )
    )
    weights = (
        counts.select("o_custkey", "n", F.inline(near))
        .groupBy("o_custkey", "day")
        .agg(F.sum("n").alias("weight"), F.sum("own").alias("own"))
    )
    best = F.max(F.struct("weight", "own", (-F.col("day")).alias("less")))
    return weights.groupBy("o_custkey").agg((-best["less"]).cast("int").alias("cycle_day"))


def repaired_cycles(orders: DataFrame, early: int = 3) -> DataFrame:
    """(o_custkey, cycle_day, month, n_orders, billed): bills by cycles that start on a day of
    each customer's own, estimated from the bills.

    A bill up to `early` days before its cycle's first day belongs to the cycle that is about to
    start. A cycle bears the month of its first day; where a month is shorter than the cycle day,
    its last day takes that part. Bills without customer or date are left out. Bills are
    reduced to one row per customer and day before anything is joined.
    """
    known = orders.where(F.col("o_custkey").isNotNull() & F.col("o_orderdate").isNotNull())
    daily = known.groupBy("o_custkey", F.col("o_orderdate").cast("date").alias("billed_on")).agg(
        F.count(F.lit(1)).alias("n"), money_sum(F.col("o_totalprice")).alias("amount")
    )
    due = F.date_add("billed_on", early)
    starts = F.least(F.col("cycle_day"), F.dayofmonth(F.last_day(due)))
    month = F.trunc(F.when(F.dayofmonth(due) >= starts, due).otherwise(F.add_months(due, -1)), "MM")
    return (
        daily.join(cycle_days(daily), "o_custkey")
        .groupBy("o_custkey", "cycle_day", month.alias("month"))
        .agg(F.sum("n").alias("n_orders"), money_sum(F.col("amount")).alias("billed"))
    )


def as_of_features(
    orders: DataFrame, events: DataFrame, cutoffs: Sequence[str], days: int = 30
) -> DataFrame:
    """Per customer and cutoff: what orders and events strictly before it say, and silence after.

    All cutoffs are answered in one pass over each table: a row adds to every cutoff that it lies
    before, inside the partial aggregate, so nothing is copied per cutoff and a customer
    with very many rows is reduced before the shuffle. label = 1 when there is neither order
    nor event in [cutoff, cutoff + days). Customers without anything before a cutoff have no
    row for it.
    """
    moments = [F.lit(c).cast("timestamp") for c in cutoffs]
    ends = [m + F.expr(f"interval {days} days") for m in moments]

    def told(table: DataFrame, key: str, at: str, amount: str) -> DataFrame:
        sums = []
        for i, (moment, end) in enumerate(zip(moments, ends)):
            before = F.col(at) < moment
            ahead = (F.col(at) >= moment) & (F.col(at) < end)
            sums += [
                F.count_if(before).alias(f"n{i}"),
                money_sum(F.when(before, F.col(amount))).alias(f"amount{i}"),
                F.max(F.when(before, F.col(at))).alias(f"last{i}"),
                F.count_if(ahead).alias(f"ahead{i}"),
            ]
        parts = [
            F.struct(*(F.col(f"{c}{i}").alias(c) for c in ("n", "amount", "last", "ahead")))
            for i in range(len(moments))
        ]
        wide = table.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("customer"))
        return wide.agg(*sums).select("customer", F.array(*parts).alias("told"))

    billed = told(orders, "o_custkey", "o_orderdate", "o_totalprice").withColumnRenamed(
        "told", "billed"
    )
    used = told(events, "user_id", "ts", "value").withColumnRenamed("told", "used")
    both = billed.join(used, "customer", "full").select(
        "customer", "billed", "used",
        F.posexplode(F.array(*moments)).alias("place", "cutoff"),
    )
    order, event = F.col("billed")[F.col("place")], F.col("used")[F.col("place")]

    def count(of: Column) -> Column:
        return F.coalesce(of, F.lit(0)).cast("bigint")

    def age(last: Column) -> Column:
        return F.date_diff(F.col("cutoff").cast("date"), last.cast("date"))

    silent = (count(order["ahead"]) + count(event["ahead"])) == 0
    return both.select(
        "customer",
        F.col("cutoff").cast("date").alias("cutoff"),
        count(order["n"]).alias("n_orders"),
        F.coalesce(order["amount"], F.lit(0.0)).alias("billed"),
        age(order["last"]).alias("days_since_order"),
        count(event["n"]).alias("n_events"),
        F.coalesce(event["amount"], F.lit(0.0)).alias("usage_value"),
        age(event["last"]).alias("days_since_event"),
        silent.cast("int").alias("label"),
    ).where((F.col("n_orders") > 0) | (F.col("n_events") > 0))


def look_ahead_labels(
    orders: DataFrame, days: int = 30, cutoff: Column | None = None
) -> DataFrame:
    """Per customer: what was known at the cutoff, and whether they were silent afterwards.

    label = 1 when there is no order in (cutoff, cutoff + days]. Only customers with an
    order up to the cutoff appear. The default cutoff lies `days` before the newest order.
    """
    span = F.expr(f"interval {days} days")
    if cutoff is None:
        cutoff = orders.agg((F.max("o_orderdate") - span).alias("cutoff")).scalar()
    at = orders.withColumn("cutoff", cutoff)
    known = F.col("o_orderdate") <= F.col("cutoff")
    ahead = (F.col("o_orderdate") > F.col("cutoff")) & (
        F.col("o_orderdate") <= F.col("cutoff") + span
    )
    last = F.max(F.when(known, F.col("o_orderdate")))
    return (
        at.groupBy("o_custkey")
        .agg(
            F.count_if(known).alias("n_orders"),
            money_sum(F.when(known, F.col("o_totalprice"))).alias("billed"),
            F.date_diff(F.max("cutoff").cast("date"), last.cast("date")).alias("days_since_order"),
            F.when(F.count_if(ahead) == 0, 1).otherwise(0).alias("label"),
        )
        .where(F.col("n_orders") > 0)
    )


def revenue_per_user(df: DataFrame, segment: str) -> DataFrame:
    """Average revenue per distinct subscriber in each segment."""
    users = F.count_distinct(KEY)
    return df.groupBy(segment).agg(
        users.alias("users"),
        money_sum(F.col("MonthlyCharges")).alias("revenue"),
        F.try_divide(money_sum(F.col("MonthlyCharges")), users).alias("arpu"),
    )


def complaint_features(
    documents: DataFrame, words: Mapping[str, Sequence[str]] = COMPLAINT_WORDS
) -> DataFrame:
    """Per text: words, complaint words of its language, and their share.

    Words are runs of letters and digits of any script. A language that is not listed has
    no complaint words. Whole texts, no prefixes; one pass finds all words of the language, and
    only those found are listed.
    """
    text = F.lower("text")

    def one_of(known: Sequence[str]) -> str:
        return rf"(?<![\p{{L}}\p{{N}}])(?:{'|'.join(known)})(?![\p{{L}}\p{{N}}])"

    found = F.array().cast("array<string>")
    for lang, known in words.items():
        hits = F.regexp_extract_all(text, F.lit(one_of(known)), F.lit(0))
        found = F.when(F.col("lang") == lang, hits).otherwise(found)
    listed = documents.select(
        "doc_id",
        "source",
        F.regexp_count("text", F.lit(r"[\p{L}\p{N}]+")).alias("n_tokens"),
        found.alias("hits"),
    )
    return listed.select(
        "doc_id",
        "source",
        "n_tokens",
        F.size("hits").alias("n_complaint_words"),
        F.size(F.array_distinct("hits")).alias("n_distinct_words"),
        F.try_divide(F.size("hits"), "n_tokens").alias("word_share"),
    )
