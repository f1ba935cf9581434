"""The same reports as DuckDB SQL over the same tables.

Column names, category lists and the lookup tables of the derived subscriber table are shared
with the library; rules for numbers, words and money are written out here.
"""

from __future__ import annotations

from holdfast.schema import CATEGORIES, MEASURES, SUBSCRIBER, TARGET, numeric_columns
from holdfast.sources.subscribers import CONTRACTS, DRAWN, INTERNET
from holdfast.operators.usage import EVENT_TYPES

ALL_COLUMNS = [f.name for f in SUBSCRIBER.fields]
NUMERIC = numeric_columns(SUBSCRIBER)
TEXT = [c for c in ALL_COLUMNS if c not in NUMERIC]
INDEXED = [*CATEGORIES, TARGET]


def uniform(key: str, salt: str) -> str:
    return (
        f"(('0x' || substr(md5('{salt}:' || {key}), 1, 8))::UBIGINT / 4294967296.0::DOUBLE)"
    )


def _case(column: str, values: dict[str, str]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items()) + " END"


def _drawn(name: str) -> str:
    yes, no = ("Female", "Male") if name == "gender" else ("Yes", "No")
    draw = uniform("c_custkey::VARCHAR", name)
    return f"CASE WHEN {draw} < 0.5::DOUBLE THEN '{yes}' ELSE '{no}' END"


def _subscriber_column(name: str) -> str:
    senior = uniform("c_custkey::VARCHAR", "senior")
    expressions = {
        "customerID": "c_custkey::VARCHAR",
        "SeniorCitizen": f"CASE WHEN {senior} < 0.16::DOUBLE THEN 1 ELSE 0 END::INTEGER",
        "tenure": "months::INTEGER",
        "MonthlyCharges": "coalesce((((total * 100)::BIGINT // ((months + 1) * 1000))"
        " / 100.0::DOUBLE), 0.0)::DOUBLE",
        "TotalCharges": "CASE WHEN months = 0 THEN ' ' ELSE total::VARCHAR END",
        "Contract": f"coalesce({_case('last_status', CONTRACTS)}, 'Month-to-month')",
        "InternetService": _case("c_mktsegment", INTERNET),
        "PaymentMethod": "last_priority",
        "Churn": "CASE WHEN last_order IS NULL OR last_order <"
        " (SELECT max(o_orderdate) FROM orders) - INTERVAL 365 DAY THEN 'Yes' ELSE 'No' END",
    }
    expression = expressions[name] if name in expressions else _drawn(name)
    return f'{expression} AS "{name}"'


A_NUMBER = r"^[ \t\r\n]*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?[ \t\r\n]*$"

SUBSCRIBERS = f"""
history AS (
  SELECT o_custkey, min(o_orderdate) AS first_order, max(o_orderdate) AS last_order,
         sum(o_totalprice::DECIMAL(18,2)) AS total,
         arg_max(o_orderstatus, row(o_orderdate, o_orderkey)) AS last_status,
         arg_max(o_orderpriority, row(o_orderdate, o_orderkey)) AS last_priority
  FROM orders GROUP BY o_custkey),
customers AS (
  SELECT *, CASE WHEN first_order IS NULL OR c_custkey % 97 = 0 THEN 0
                 ELSE (year(last_order) - year(first_order)) * 12
                      + month(last_order) - month(first_order) END AS months
  FROM customer LEFT JOIN history ON c_custkey = o_custkey),
subscribers AS (
  SELECT {", ".join(_subscriber_column(c) for c in ALL_COLUMNS)} FROM customers),
cleaned AS (
  SELECT * REPLACE (coalesce(CASE WHEN regexp_matches("TotalCharges", '{A_NUMBER}')
                             THEN TRY_CAST("TotalCharges" AS DOUBLE) END, 0.0::DOUBLE)
                    AS "TotalCharges")
  FROM subscribers),
medianed AS (
  SELECT * REPLACE (coalesce(TRY_CAST("TotalCharges" AS DOUBLE),
                    (SELECT quantile_disc(TRY_CAST("TotalCharges" AS DOUBLE), 0.5)
                     FROM subscribers)) AS "TotalCharges")
  FROM subscribers),
gaps AS (
  SELECT * REPLACE (CASE WHEN "customerID"::BIGINT % 50 <> 0 THEN "PaymentMethod" END
                      AS "PaymentMethod",
                    CASE WHEN "customerID"::BIGINT % 70 <> 0 THEN "MonthlyCharges" END
                      AS "MonthlyCharges")
  FROM subscribers),
drawn AS (
  SELECT *, 0.1::DOUBLE + 0.3::DOUBLE * {uniform('"customerID"', "base")}
            + CASE WHEN "InternetService" = 'Fiber optic' AND "Contract" = 'Month-to-month'
                   THEN 0.3::DOUBLE + 0.2::DOUBLE * {uniform('"customerID"', "bump")}
                   ELSE 0.0::DOUBLE END AS p
  FROM cleaned),
scored AS (
  SELECT * EXCLUDE (p), least(greatest(p, 0.0::DOUBLE), 1.0::DOUBLE) AS "Probability_Churn",
         CASE WHEN p >= 0.5::DOUBLE THEN 1 ELSE 0 END::INTEGER AS "Prediction_Churn",
         CASE WHEN p > 0.7::DOUBLE THEN 'Riesgo Alto'
              WHEN p >= 0.5::DOUBLE THEN 'Riesgo Medio' ELSE 'Riesgo Bajo' END AS "Banda_Riesgo"
  FROM drawn),
bands AS (
  SELECT * FROM (VALUES (0, 'Riesgo Alto'), (1, 'Riesgo Medio'), (2, 'Riesgo Bajo'))
  AS b(place, "Banda_Riesgo")),
summary AS (
  SELECT "Banda_Riesgo", count("customerID") AS "Total_Clientes",
         sum("MonthlyCharges"::DECIMAL(28,6))::DOUBLE AS "MRR_Total",
         round_even(avg("tenure"), 1) AS "Tenure_Promedio"
  FROM scored GROUP BY "Banda_Riesgo"),
report AS (
  SELECT "Banda_Riesgo", "Total_Clientes", "MRR_Total", "Tenure_Promedio",
         '$' || format('{{:,.2f}}', "MRR_Total") AS "MRR_Total_USD"
  FROM bands LEFT JOIN summary USING ("Banda_Riesgo") ORDER BY place),
labelled AS (
  SELECT *, CASE WHEN "Churn" = 'Yes' THEN 1 ELSE 0 END AS label FROM scored),
leavers AS (SELECT * FROM cleaned WHERE "Churn" = 'Yes')
"""


def sql(body: str, *ctes: str) -> str:
    return f"WITH {', '.join([SUBSCRIBERS.strip(), *ctes])}\n{body}"


def _labels(source: str, columns: list[str]) -> str:
    """(column, label, n, index) for each of `columns`."""
    counts = " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", "{c}" AS label, count(*) AS n FROM {source}
            WHERE "{c}" IS NOT NULL GROUP BY "{c}" """
        for c in columns
    )
    return f"""labels_of AS (
      SELECT *, (row_number() OVER (PARTITION BY "column" ORDER BY n DESC, label) - 1)::DOUBLE
             AS "index" FROM ({counts}))"""


def _index(column: str, alias: str = "s") -> str:
    return f"""coalesce(
      (SELECT "index" FROM labels_of l WHERE l."column" = '{column}'
       AND l.label = {alias}."{column}"),
      (SELECT count(*) FROM labels_of l WHERE l."column" = '{column}')::DOUBLE)"""


def _text_profile(c: str) -> str:
    counts = f"""(SELECT "{c}" AS v, count(*) AS n FROM subscribers
                 WHERE "{c}" IS NOT NULL GROUP BY "{c}")"""
    return f"""SELECT '{c}' AS "column", (SELECT sum(n)::BIGINT FROM {counts}) AS "count",
      (SELECT count(*) FROM {counts}) AS "unique",
      (SELECT v FROM {counts} ORDER BY n DESC, v LIMIT 1) AS top,
      (SELECT max(n) FROM {counts}) AS freq, NULL::DOUBLE AS mean, NULL::DOUBLE AS std,
      NULL::DOUBLE AS "min", NULL::DOUBLE AS q25, NULL::DOUBLE AS q50, NULL::DOUBLE AS q75,
      NULL::DOUBLE AS "max" """


def _numeric_profile(c: str, source: str, digits: int, text: bool = True) -> str:
    def r(expression: str) -> str:
        return f"round_even(({expression})::DOUBLE, {digits})"

    blank = 'NULL::BIGINT AS "unique", NULL::VARCHAR AS top, NULL::BIGINT AS freq,' if text else ""
    x = f'"{c}"::DOUBLE'

    def quartile(p: float) -> str:
        # quantile_cont weighs both neighbours, which can miss a half by one bit;
        # the reports start from the nearer neighbour, as pandas does.
        at = f"((count({x}) - 1) * {p})"
        low = f"list_sort(list({x}))[floor({at})::BIGINT + 1]"
        high = f"list_sort(list({x}))[ceil({at})::BIGINT + 1]"
        part = f"({at} - floor({at}))::DOUBLE"
        return r(
            f"CASE WHEN {part} < 0.5 THEN {low} + ({high} - {low}) * {part}"
            f" ELSE {high} - ({high} - {low}) * (1 - {part}) END"
        )

    return f"""SELECT '{c}' AS "column", count({x}) AS "count", {blank}
      {r(f"avg({x})")} AS mean, {r(f"stddev_samp({x})")} AS std, {r(f"min({x})")} AS "min",
      {quartile(0.25)} AS q25, {quartile(0.5)} AS q50, {quartile(0.75)} AS q75,
      {r(f"max({x})")} AS "max" FROM {source}"""


def _counts_by(category: str) -> str:
    return sql(
        f"""SELECT "{category}", "Churn", count(*) AS n FROM cleaned
        WHERE "{category}" IS NOT NULL GROUP BY ALL"""
    )


def _box(source: str, group: str, column: str, digits: int) -> str:
    names = ("q1", "median", "q3", "whisker_lo", "whisker_hi")
    shown = ", ".join(f"round_even({n}, {digits}) AS {n}" for n in names)
    return sql(
        f"SELECT grp, {shown}, outliers FROM ends",
        f"""box AS (
          SELECT "{group}" AS grp, quantile_cont("{column}", 0.25) AS q1,
                 quantile_cont("{column}", 0.5) AS median, quantile_cont("{column}", 0.75) AS q3
          FROM {source} GROUP BY "{group}")""",
        f"""ends AS (
          SELECT grp, q1, median, q3,
            min("{column}") FILTER (WHERE "{column}" BETWEEN q1 - 1.5::DOUBLE * (q3 - q1)
                                    AND q3 + 1.5::DOUBLE * (q3 - q1)) AS whisker_lo,
            max("{column}") FILTER (WHERE "{column}" BETWEEN q1 - 1.5::DOUBLE * (q3 - q1)
                                    AND q3 + 1.5::DOUBLE * (q3 - q1)) AS whisker_hi,
            count(*) FILTER (WHERE "{column}" < q1 - 1.5::DOUBLE * (q3 - q1)
                             OR "{column}" > q3 + 1.5::DOUBLE * (q3 - q1)) AS outliers
          FROM box JOIN {source} ON "{group}" = grp GROUP BY grp, q1, median, q3)""",
    )


def _type(column: str) -> str:
    kind = SUBSCRIBER[column].dataType.simpleString()
    return "double" if column == "TotalCharges" else kind


def _head(n: int = 5) -> str:
    first = f"""head AS (SELECT *, row_number() OVER (ORDER BY "customerID") AS rn
             FROM subscribers QUALIFY rn <= {n})"""
    rows = " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", """
        + ", ".join(
            f"""(SELECT "{c}"::VARCHAR FROM head WHERE rn = {i}) AS row{i}"""
            for i in range(1, n + 1)
        )
        for c in ALL_COLUMNS
    )
    return sql(rows, first)


FEATURE_LIST = ", ".join(
    [f'"{c}"::DOUBLE AS "{c}"' for c in MEASURES]
    + [f'{_index(c)} AS "{c}_index"' for c in CATEGORIES]
)

# Rows of the 30 per cent that no model learns from, with what a certificate says of each.
_TEST = f"""{uniform('"customerID"', "split42")} >= 0.7::DOUBLE"""
CERTIFIED = sql(
    f"""SELECT "customerID", CASE WHEN "Churn" = 'Yes' THEN 1 ELSE 0 END::INTEGER AS label,
    true AS probability_agrees, true AS prediction_agrees FROM subscribers WHERE {_TEST}"""
)


def _moments() -> str:
    """Totals of every feature over the leavers that a model learns from."""
    features = [f'"{c}"::DOUBLE AS "{c}"' for c in MEASURES]
    features += [f'{_index(c)} AS "{c}_index"' for c in CATEGORIES]
    names = [*MEASURES, *(f"{c}_index" for c in CATEGORIES)]
    rows = f"""learned AS (SELECT {", ".join(features)} FROM medianed s
               WHERE "Churn" = 'Yes' AND NOT ({_TEST}))"""
    each = " UNION ALL ".join(
        f"""SELECT '{n}' AS feature, sum("{n}"::DECIMAL(38,6))::DOUBLE AS observed,
        true AS agrees FROM learned"""
        for n in names
    )
    return sql(each, _labels("medianed", CATEGORIES), rows)


# The second day arrives with gaps; its indexes are those of the first day's labels.
_SECOND = """second AS (
  SELECT * REPLACE (coalesce(TRY_CAST("TotalCharges" AS DOUBLE),
                    (SELECT quantile_disc(TRY_CAST("TotalCharges" AS DOUBLE), 0.5) FROM gaps))
                    AS "TotalCharges")
  FROM gaps WHERE "MonthlyCharges" IS NOT NULL)"""

AS_OF = """
  WITH cutoffs(cutoff) AS (VALUES (DATE '2001-05-01'), (DATE '2001-07-02'), (DATE '2024-01-16')),
  everyone AS (SELECT o_custkey AS customer FROM orders UNION SELECT user_id FROM events),
  told AS (
    SELECT customer, cutoff,
      (SELECT count(*) FROM orders WHERE o_custkey = customer AND o_orderdate < cutoff) AS n_orders,
      (SELECT sum(o_totalprice::DECIMAL(28,6)) FROM orders
       WHERE o_custkey = customer AND o_orderdate < cutoff) AS billed,
      (SELECT max(o_orderdate)::DATE FROM orders
       WHERE o_custkey = customer AND o_orderdate < cutoff) AS last_order,
      (SELECT count(*) FROM events WHERE user_id = customer AND ts < cutoff) AS n_events,
      (SELECT sum(value::DECIMAL(28,6)) FROM events
       WHERE user_id = customer AND ts < cutoff) AS usage_value,
      (SELECT max(ts)::DATE FROM events WHERE user_id = customer AND ts < cutoff) AS last_event,
      (SELECT count(*) FROM orders WHERE o_custkey = customer
       AND o_orderdate >= cutoff AND o_orderdate < cutoff + INTERVAL 30 DAY)
      + (SELECT count(*) FROM events WHERE user_id = customer
       AND ts >= cutoff AND ts < cutoff + INTERVAL 30 DAY) AS ahead
    FROM everyone, cutoffs)
  SELECT customer, cutoff, n_orders, coalesce(billed, 0)::DOUBLE AS billed,
    date_diff('day', last_order, cutoff)::INTEGER AS days_since_order, n_events,
    coalesce(usage_value, 0)::DOUBLE AS usage_value,
    date_diff('day', last_event, cutoff)::INTEGER AS days_since_event,
    CASE WHEN ahead = 0 THEN 1 ELSE 0 END::INTEGER AS label
  FROM told WHERE n_orders > 0 OR n_events > 0"""

REPAIRED = """
  WITH bills AS (
    SELECT o_custkey, o_orderdate::DATE AS billed_on, o_totalprice::DECIMAL(28,6) AS amount
    FROM orders WHERE o_custkey IS NOT NULL AND o_orderdate IS NOT NULL),
  weights AS (
    SELECT o_custkey, day, count(*) AS weight,
      count(*) FILTER (WHERE dayofmonth(billed_on) = day) AS own
    FROM bills, range(1, 32) AS days(day)
    WHERE least((dayofmonth(billed_on) - day + 31) % 31, (day - dayofmonth(billed_on) + 31) % 31) <= 1
    GROUP BY ALL),
  cycles AS (
    SELECT o_custkey, day::INTEGER AS cycle_day FROM weights
    QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY weight DESC, own DESC, day) = 1),
  due AS (
    SELECT o_custkey, cycle_day, amount, (billed_on + 3)::DATE AS due FROM bills JOIN cycles
    USING (o_custkey)),
  placed AS (
    SELECT o_custkey, cycle_day, amount,
      date_trunc('month', CASE WHEN dayofmonth(due) >= least(cycle_day, dayofmonth(last_day(due)))
                               THEN due ELSE due - INTERVAL 1 MONTH END)::DATE AS month
    FROM due)
  SELECT o_custkey, cycle_day, month, count(*) AS n_orders, sum(amount)::DOUBLE AS billed
  FROM placed GROUP BY ALL"""

POINTS = 'SELECT "customerID", "tenure", "MonthlyCharges", "Banda_Riesgo" FROM scored'

AUC = sql(
    """SELECT round_even((sum(r) FILTER (WHERE label = 1)
         - count(*) FILTER (WHERE label = 1) * (count(*) FILTER (WHERE label = 1) + 1) / 2.0)
       / (count(*) FILTER (WHERE label = 1)::DOUBLE
          * count(*) FILTER (WHERE label = 0)::DOUBLE), 10) AS auc
    FROM (SELECT label, rank() OVER (ORDER BY "Probability_Churn")
            + (count(*) OVER (PARTITION BY "Probability_Churn") - 1) / 2.0::DOUBLE AS r
          FROM labelled)"""
)

ORACLE: dict[str, str] = {
    "csv_scan_inferred": sql("SELECT * FROM subscribers"),
    "csv_scan_declared": sql("SELECT * FROM subscribers"),
    "csv_scan_reordered": sql("SELECT * FROM subscribers"),
    "csv_scan_tokens": sql("SELECT * FROM gaps"),
    "result_sink_roundtrip": sql("SELECT * FROM report"),
    "table_shape": sql(
        f"SELECT count(*) AS n_rows, {len(ALL_COLUMNS)}::INTEGER AS n_columns FROM subscribers"
    ),
    "schema_listing": sql(
        " UNION ALL ".join(
            f"""SELECT {i}::INTEGER AS ordinal, '{c}' AS name, '{_type(c)}' AS type,
            count("{c}") AS known FROM cleaned"""
            for i, c in enumerate(ALL_COLUMNS)
        )
    ),
    "profile_all": sql(
        " UNION ALL ".join(
            [_text_profile(c) for c in TEXT]
            + [_numeric_profile(c, "subscribers", 4) for c in NUMERIC]
        )
    ),
    "profile_numeric": sql(_numeric_profile("TotalCharges", "cleaned", 2, text=False)),
    "missing_counts": sql(
        " UNION ALL ".join(
            f"""SELECT '{c}' AS "column", count(*) FILTER (WHERE "{c}" IS NULL) AS missing
            FROM gaps"""
            for c in ALL_COLUMNS
        )
    ),
    "missing_counts_wide": sql(
        """SELECT count(*) FILTER (WHERE "MonthlyCharges" IS NULL) AS "MonthlyCharges",
        count(*) FILTER (WHERE TRY_CAST("TotalCharges" AS DOUBLE) IS NULL) AS "TotalCharges"
        FROM subscribers"""
    ),
    "missing_after_median": sql(
        """SELECT count(*) FILTER (WHERE "MonthlyCharges" IS NULL) AS "MonthlyCharges",
        count(*) FILTER (WHERE "TotalCharges" IS NULL) AS "TotalCharges" FROM medianed"""
    ),
    "head_transposed": _head(),
    "clean_zero": sql("SELECT * FROM cleaned"),
    "clean_median": sql("SELECT * FROM medianed"),
    "median_exact": sql(
        """SELECT quantile_cont("tenure"::DOUBLE, 0.5) AS median FROM leavers"""
    ),
    "median_charges_by_churn": sql(
        """SELECT "Churn", 0.5::DOUBLE AS p,
        round_even(quantile_cont("MonthlyCharges", 0.5), 6) AS value FROM cleaned GROUP BY ALL"""
    ),
    "median_discrete": sql(
        """SELECT quantile_disc(TRY_CAST("TotalCharges" AS DOUBLE), 0.5) AS median
        FROM subscribers"""
    ),
    "incomplete_rows": sql(
        """SELECT count(*) FILTER (WHERE TRY_CAST("TotalCharges" AS DOUBLE) IS NOT NULL) AS kept,
        count(*) FILTER (WHERE TRY_CAST("TotalCharges" AS DOUBLE) IS NULL) AS dropped
        FROM subscribers"""
    ),
    "complete_rows": sql(
        """SELECT "customerID", "tenure", "MonthlyCharges",
        TRY_CAST("TotalCharges" AS DOUBLE) AS "TotalCharges" FROM gaps
        WHERE "MonthlyCharges" IS NOT NULL AND TRY_CAST("TotalCharges" AS DOUBLE) IS NOT NULL"""
    ),
    "model_scored_customers": sql(
        """SELECT "customerID",
        CASE WHEN "customerID"::BIGINT % 10 <> 0 THEN "Churn" END AS "Churn", 1::INTEGER AS is_scored
        FROM subscribers"""
    ),
    "risk_band_summary": sql("SELECT * FROM report"),
    "mrr_at_risk": sql(
        """SELECT high AS mrr_high, medium AS mrr_medium, both_bands AS mrr_at_risk,
          '$' || format('{:,.2f}', both_bands) AS mrr_at_risk_usd
        FROM (SELECT
          coalesce(sum(m) FILTER (WHERE "Banda_Riesgo" = 'Riesgo Alto'), 0)::DOUBLE AS high,
          coalesce(sum(m) FILTER (WHERE "Banda_Riesgo" = 'Riesgo Medio'), 0)::DOUBLE AS medium,
          coalesce(sum(m) FILTER (WHERE "Banda_Riesgo" <> 'Riesgo Bajo'), 0)::DOUBLE AS both_bands
          FROM (SELECT "MonthlyCharges"::DECIMAL(28,6) AS m, "Banda_Riesgo" FROM scored))"""
    ),
    "scored_customers": sql("SELECT * FROM scored"),
    "scored_preview": sql(
        """SELECT "customerID", "Contract", "MonthlyCharges", "Probability_Churn",
        "Prediction_Churn" FROM scored ORDER BY "customerID" LIMIT 5"""
    ),
    "critical_customers": sql(
        """SELECT "customerID", "InternetService", "Contract" FROM subscribers
        WHERE "InternetService" = 'Fiber optic' AND "Contract" = 'Month-to-month'"""
    ),
    "band_counts": sql(
        """SELECT "Banda_Riesgo", n FROM bands LEFT JOIN
        (SELECT "Banda_Riesgo", count(*) AS n FROM scored GROUP BY ALL)
        USING ("Banda_Riesgo") ORDER BY place"""
    ),
    "band_mrr_bars": sql(
        """SELECT "Banda_Riesgo", avg("MRR_Total") AS "MRR_Total" FROM report GROUP BY ALL"""
    ),
    "leaver_rows": sql("""SELECT "customerID", "tenure", "Churn" FROM leavers"""),
    "churn_by_contract": _counts_by("Contract"),
    "churn_by_internet": _counts_by("InternetService"),
    "churn_by_support": _counts_by("TechSupport"),
    "leaving_rate": sql(
        """SELECT count(*) AS customers, count(*) FILTER (WHERE "Churn" = 'Yes') AS leavers,
        count(*) FILTER (WHERE "Churn" = 'Yes') / count(*)::DOUBLE AS leaving_rate FROM cleaned"""
    ),
    "leaving_rate_by_contract": sql(
        """SELECT "Contract", count(*) AS customers,
        count(*) FILTER (WHERE "Churn" = 'Yes') AS leavers,
        count(*) FILTER (WHERE "Churn" = 'Yes') / count(*)::DOUBLE AS leaving_rate
        FROM cleaned GROUP BY "Contract" """
    ),
    "leaver_tenure_histogram": sql(
        """SELECT bin::INTEGER AS bin, lo, hi, count("tenure") AS n
        FROM edges LEFT JOIN leavers
          ON "tenure" >= lo AND ("tenure" < hi OR (bin = 29 AND "tenure" = hi))
        GROUP BY bin, lo, hi""",
        """ends AS (SELECT min("tenure")::DOUBLE AS low, max("tenure")::DOUBLE AS high
                    FROM leavers)""",
        """edges AS (SELECT range AS bin, low + range * ((high - low) / 30) AS lo,
             CASE WHEN range = 29 THEN high ELSE low + (range + 1) * ((high - low) / 30) END AS hi
             FROM range(30), ends)""",
    ),
    "leaver_tenure_density": sql(
        """SELECT range::INTEGER AS point, round_even(low + range * ((high - low) / 199), 6) AS x,
          round_even(sum(exp(-0.5 * ((low + range * ((high - low) / 199) - "tenure") / h) ** 2))
            * (high - low) / 30 / (h * sqrt(2 * pi())), 6) AS y
        FROM range(200), stats, leavers GROUP BY range, low, high, h""",
        """stats AS (SELECT min("tenure")::DOUBLE AS low, max("tenure")::DOUBLE AS high,
             stddev_samp("tenure") * count(*) ** -0.2 AS h FROM leavers)""",
    ),
    "charges_box_by_churn": _box("cleaned", "Churn", "MonthlyCharges", 6),
    "score_box_by_contract": _box("scored", "Contract", "Probability_Churn", 9),
    "chart_reference_lines": sql(
        """SELECT 'median tenure of leavers' AS line, quantile_cont("tenure"::DOUBLE, 0.5) AS at
        FROM leavers UNION ALL SELECT 'high risk', 0.7::DOUBLE"""
    ),
    "tenure_charges_grid": sql(
        """SELECT "Banda_Riesgo", floor("tenure" / 6.0::DOUBLE) * 6.0::DOUBLE AS x_lo,
        floor("MonthlyCharges" / 10.0::DOUBLE) * 10.0::DOUBLE AS y_lo, count(*) AS n
        FROM scored GROUP BY ALL"""
    ),
    "tenure_charges_points": sql(POINTS),
    "tenure_charges_sample": sql(
        f"""{POINTS} WHERE {uniform('"customerID"', "points")} < 0.1::DOUBLE"""
    ),
    "categorical_columns": sql(
        " UNION ALL ".join(
            f"""SELECT '{c}' AS "column", count(DISTINCT "{c}") AS labels FROM cleaned"""
            for c in INDEXED
        )
    ),
    "category_labels": sql("SELECT * FROM labels_of", _labels("cleaned", INDEXED)),
    "category_labels_ranked": sql("SELECT * FROM labels_of", _labels("cleaned", INDEXED)),
    "payment_index_joined": sql(
        f"""SELECT "customerID", "PaymentMethod",
        {_index("PaymentMethod")} AS "PaymentMethod_index" FROM gaps s""",
        _labels("gaps", ["PaymentMethod"]),
    ),
    "category_index": sql(
        f"""SELECT "customerID", {", ".join(f'{_index(c)} AS "{c}_index"' for c in INDEXED)}
        FROM cleaned s""",
        _labels("cleaned", INDEXED),
    ),
    "assembled_features": sql(
        f"""SELECT "customerID", {FEATURE_LIST} FROM medianed s""",
        _labels("medianed", CATEGORIES),
    ),
    "label_column": sql(
        f"""SELECT "customerID", {_index("Churn")}::INTEGER AS label FROM cleaned s""",
        _labels("cleaned", ["Churn"]),
    ),
    "train_test_split": sql(
        f"""SELECT "customerID", CASE WHEN {uniform('"customerID"', "split42")} < 0.7::DOUBLE
        THEN 'train' ELSE 'test' END AS part FROM subscribers"""
    ),
    "model_scores_certified": CERTIFIED,
    "forest_scores_certified": CERTIFIED,
    "boosted_scores_certified": CERTIFIED,
    "model_bands_certified": sql(
        """SELECT count(*) AS customers, sum("MonthlyCharges"::DECIMAL(28,6))::DOUBLE AS mrr,
        true AS bands_agree FROM subscribers"""
    ),
    "model_beats_null": sql(
        f"""SELECT count(*) AS n_rows, count(*) FILTER (WHERE "Churn" = 'Yes') AS n_ones,
        true AS beats_null FROM subscribers WHERE NOT ({_TEST})"""
    ),
    "model_moments": _moments(),
    "median_approx_certified": sql(
        """SELECT count(TRY_CAST("TotalCharges" AS DOUBLE)) AS n_known, true AS is_median,
        true AS is_element FROM subscribers"""
    ),
    "median_fill_certified": sql(
        """SELECT count(TRY_CAST("TotalCharges" AS DOUBLE)) AS n_known, true AS is_median,
        true AS is_element,
        count(*) FILTER (WHERE TRY_CAST("TotalCharges" AS DOUBLE) IS NULL) AS n_filled,
        1::BIGINT AS n_values FROM subscribers"""
    ),
    "preparation_reloaded": sql(
        f"""SELECT "customerID", {FEATURE_LIST} FROM medianed s""",
        _labels("medianed", CATEGORIES),
    ),
    "daily_feature_layer": sql(
        f"""SELECT "customerID", {FEATURE_LIST} FROM second s""",
        _labels("subscribers", CATEGORIES),
        _SECOND,
    ),
    "daily_model_scored": sql("SELECT *, true AS certified FROM second", _SECOND),
    "billing_cycles_repaired": REPAIRED,
    "as_of_features": AS_OF,
    "auc_exact": AUC,
    "auc_evaluator": AUC,
    "recall_threshold": sql(
        """SELECT t AS threshold, tp, fp, fn, tn, tp / (tp + fn)::DOUBLE AS recall,
          tp / (tp + fp)::DOUBLE AS "precision"
        FROM (SELECT t, count(*) FILTER (WHERE label = 1 AND "Probability_Churn" >= t) AS tp,
                count(*) FILTER (WHERE label = 0 AND "Probability_Churn" >= t) AS fp,
                count(*) FILTER (WHERE label = 1 AND "Probability_Churn" < t) AS fn,
                count(*) FILTER (WHERE label = 0 AND "Probability_Churn" < t) AS tn
              FROM cut, labelled GROUP BY t)""",
        """ranked AS (SELECT "Probability_Churn" AS s,
             sum(label) OVER (ORDER BY "Probability_Churn" DESC) AS found,
             sum(label) OVER () AS every FROM labelled)""",
        "cut AS (SELECT max(s) AS t FROM ranked WHERE found / every::DOUBLE >= 0.8::DOUBLE)",
    ),
    "daily_layer_readback": sql("SELECT * FROM scored"),
    "customer_view": """
        SELECT c_custkey::VARCHAR AS "customerID", n_name AS nation, r_name AS region,
          c_mktsegment AS segment,
          (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n_orders,
          coalesce((SELECT sum(o_totalprice::DECIMAL(28,6)) FROM orders
                    WHERE o_custkey = c_custkey), 0)::DOUBLE AS billed,
          (SELECT count(*) FROM events WHERE user_id = c_custkey) AS n_events,
          coalesce((SELECT sum(value::DECIMAL(28,6)) FROM events
                    WHERE user_id = c_custkey), 0)::DOUBLE AS usage_value
        FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey
          LEFT JOIN region ON n_regionkey = r_regionkey""",
    "complaints_deduplicated": """
        SELECT doc_id, source, lang, n_chars FROM documents
        QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id DESC) = 1""",
    "billing_cycles": """
        WITH bills AS (
          SELECT o_custkey, date_trunc('month', (o_orderdate::DATE - 4))::DATE AS month,
                 count(*) AS n, sum(o_totalprice::DECIMAL(28,6)) AS amount
          FROM orders GROUP BY ALL),
        months AS (
          SELECT o_custkey, unnest(generate_series(min(month)::TIMESTAMP, max(month)::TIMESTAMP,
                 INTERVAL 1 MONTH))::DATE AS month FROM bills GROUP BY o_custkey)
        SELECT o_custkey, month, coalesce(n, 0) AS n_orders,
               coalesce(amount, 0)::DOUBLE AS billed
        FROM months LEFT JOIN bills USING (o_custkey, month)""",
    "look_ahead_labels": """
        WITH cut AS (SELECT max(o_orderdate) - INTERVAL 30 DAY AS moment FROM orders),
        past AS (
          SELECT o_custkey, count(*) AS n_orders,
                 sum(o_totalprice::DECIMAL(28,6))::DOUBLE AS billed,
                 max(o_orderdate)::DATE AS last_order
          FROM orders WHERE o_orderdate <= (SELECT moment FROM cut) GROUP BY o_custkey),
        ahead AS (
          SELECT DISTINCT o_custkey FROM orders, cut
          WHERE o_orderdate > moment AND o_orderdate <= moment + INTERVAL 30 DAY)
        SELECT o_custkey, n_orders, billed,
               date_diff('day', last_order, (SELECT moment::DATE FROM cut))::INTEGER
                 AS days_since_order,
               CASE WHEN o_custkey IN (SELECT o_custkey FROM ahead) THEN 0 ELSE 1 END AS label
        FROM past""",
    "arpu_by_internet": sql(
        """SELECT "InternetService", count(DISTINCT "customerID") AS users,
        sum("MonthlyCharges"::DECIMAL(28,6))::DOUBLE AS revenue,
        round_even(sum("MonthlyCharges"::DECIMAL(28,6))::DOUBLE
                   / count(DISTINCT "customerID"), 6) AS arpu
        FROM cleaned GROUP BY "InternetService" """
    ),
    "complaint_text_features": """
        WITH known(lang, words) AS (VALUES
          ('en', ['awful', 'broken', 'idiot', 'problem', 'slow', 'stupid', 'worthless']),
          ('es', ['horrible', 'roto', 'idiota', 'problema', 'lento', 'estúpido', 'inútil']),
          ('de', ['furchtbar', 'kaputt', 'idiot', 'problem', 'langsam', 'dumm', 'wertlos']),
          ('fr', ['affreux', 'cassé', 'idiot', 'problème', 'lent', 'stupide', 'inutile'])),
        tokens AS (
          SELECT doc_id, source, lang,
            regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents),
        hits AS (
          SELECT t.*, list_filter(w, lambda x: list_contains(coalesce(words, []), x)) AS h
          FROM tokens t LEFT JOIN known USING (lang))
        SELECT doc_id, source, len(w)::INTEGER AS n_tokens, len(h)::INTEGER AS n_complaint_words,
               len(list_distinct(h))::INTEGER AS n_distinct_words,
               len(h) / nullif(len(w), 0)::DOUBLE AS word_share
        FROM hits""",
    "usage_by_user": f"""
        SELECT user_id, count(*) AS n_events,
          {", ".join(f"count(*) FILTER (WHERE event_type = '{t}') AS n_{t}" for t in EVENT_TYPES)},
          count(*) FILTER (WHERE event_type = 'error') / count(*)::DOUBLE AS error_share,
          sum(value::DECIMAL(28,6))::DOUBLE AS usage_value,
          sum((props->>'$.k')::INTEGER)::BIGINT AS k_total,
          max((props->>'$.k')::INTEGER) AS k_max
        FROM events GROUP BY user_id""",
    "usage_by_day": """
        SELECT user_id, ts::DATE AS usage_day, count(*) AS n_events,
          sum(value::DECIMAL(28,6))::DOUBLE AS usage_value
        FROM events GROUP BY ALL""",
}

# The same rows by another way.
ORACLE["category_index_joined"] = ORACLE["category_index"]
