"""Quality rules: a learned decision list over text statistics, as Spark expressions.

Sequential covering on labelled rows: a rule grows by the threshold test with the largest
gain until it covers no good row or no test helps, is pruned on rows kept aside, and the
rows that it covers are set aside before the next rule. Each test of a turn is counted by
one aggregate over all candidate tests. The list becomes an ordered CASE expression: the
first rule that fits rejects; what none fits is kept.

Cases: null texts have no words. A statistic that would divide by zero is 0. Without
labelled rows of both kinds the list is empty and only the base rules count. Repeated rows
get the same verdict; a repeated label counts once per row. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.llm.text import WORD
from holdfast.llm.sampling import picked
from holdfast.session import cut_lineage

SYMBOLS = r"[^#*$%&|<>]+"

STATISTICS = (
    "n_words",
    "mean_word",
    "symbol_share",
    "dup_line_share",
    "repeat_share",
    "capital_share",
    "distinct_share",
    "short_line_share",
    "digit_share",
    "mark_share",
)


@dataclass(frozen=True)
class Covering:
    """`sample` bounds the labelled rows that are learned from (about, by hash of the id);
    `cuts` thresholds are tried per statistic; `tests` bounds a rule's length and `rules`
    the list's. A rule must be right for `precision` of the rows it covers, on rows kept aside,
    and cover `support` of them at least.
    """

    sample: int = 8000
    cuts: int = 12
    tests: int = 3
    rules: int = 8
    precision: float = 0.9
    support: int = 5
    window: int = 8


@dataclass(frozen=True)
class Test:
    """`column` above (or at most) `cut`."""

    column: str
    above: bool
    cut: float

    def expression(self) -> Column:
        c = F.col(self.column)
        return c > self.cut if self.above else c <= self.cut


def _count(others: str) -> Column:
    """How many characters are left when runs of `others` go."""
    return F.length(F.regexp_replace("text", others, ""))


# Words in windows that occur at least twice: windows are hashed, equal hashes are neighbours
# after sorting, and the places of repeated windows are merged into the words they cover.
_REPEATED = """
aggregate(
    sort_array(transform(
        filter(ordered, (w, i) ->
            w.hash = get(ordered, i - 1).hash or w.hash = get(ordered, i + 1).hash),
        w -> w.at)),
    named_struct('words', 0L, 'upto', 0),
    (s, at) -> named_struct(
        'words', s.words + (at + {n} - greatest(at, s.upto)), 'upto', at + {n}),
    s -> s.words)
"""


def statistics(docs: DataFrame, text_column: str = "text", window: int = 8) -> DataFrame:
    """`docs` as a struct `row`, with base counts and the statistics that rules are made of."""
    text = F.coalesce(F.col("text"), F.lit(""))
    packed = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"),
        F.col(text_column).alias("text"),
    )
    split = packed.withColumn("text", text).withColumns(
        {
            "words": F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), ""),
            "lines": F.filter(F.split("text", "\n"), lambda s: s.rlike(WORD)),
        }
    )
    # get() looks one element up; slice() would copy the array for every window.
    next_words = ", ".join(f"get(marks, i + {k})" for k in range(1, window))
    hashes = f"transform(marks, (m, i) -> xxhash64(m, {next_words}))"
    counted = (
        split.withColumn("marks", F.expr("transform(words, w -> xxhash64(w))"))
        .withColumn("every", F.expr(hashes))
        # The last places begin no whole window.
        .withColumn(
            "hashes",
            F.expr(
                f"if(size(every) < {window}, cast(array() as array<bigint>),"
                f" slice(every, 1, size(every) - {window - 1}))"
            ),
        )
        .withColumns(
            {
                "n_words": F.size("words").cast("bigint"),
                "word_chars": F.length(F.array_join("words", "")).cast("bigint"),
                "n_symbols": _count(SYMBOLS).cast("bigint"),
                "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint"),
                "n_distinct": F.size(F.array_distinct("marks")),
                "n_lines": F.size("lines"),
                "n_short": F.size(F.filter("lines", lambda s: F.length(s) < 30)),
                "ordered": F.when(
                    F.size(F.array_distinct("hashes")) < F.size("hashes"),
                    F.sort_array(
                        F.transform(
                            "hashes", lambda h, i: F.struct(h.alias("hash"), i.alias("at"))
                        )
                    ),
                ),
                "n_capitals": _count("[^A-Z]+"),
                "n_digits": _count("[^0-9]+"),
                "n_marks": _count("[^!?]+"),
            }
        )
        .drop("words", "lines", "marks", "every", "hashes")
    )
    repeated = F.expr(_REPEATED.format(n=window))
    every = counted.withColumn("n_repeat_words", F.coalesce(repeated, F.lit(0)).cast("bigint"))

    def share(a: str, b: str) -> Column:
        return F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))

    # As the output of a generator, the statistics are made once per row: no filter on them
    # can be pushed below, where it would repeat their expressions.
    made = F.struct(
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        share("word_chars", "n_words").alias("mean_word"),
        share("n_symbols", "word_chars").alias("symbol_share"),
        share("n_dup_lines", "n_lines").alias("dup_line_share"),
        share("n_repeat_words", "n_words").alias("repeat_share"),
        share("n_capitals", "word_chars").alias("capital_share"),
        share("n_distinct", "n_words").alias("distinct_share"),
        share("n_short", "n_lines").alias("short_line_share"),
        share("n_digits", "word_chars").alias("digit_share"),
        share("n_marks", "word_chars").alias("mark_share"),
        base_failed().alias("base_failed"),
    )
    return every.select("row", F.inline(F.array(made)))


def base_failed() -> Column:
    """Too few words, or over 30 % of them in repeated windows."""
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def _cuts(rows: DataFrame, how: Covering) -> dict[str, list[float]]:
    """Thresholds per statistic: evenly spread quantiles and the far ends."""
    at = [(i + 0.5) / how.cuts for i in range(how.cuts)]
    at = sorted({0.002, 0.01, *at, 0.99, 0.998})
    found = rows.agg(*(F.percentile_approx(c, at, 10_000).alias(c) for c in STATISTICS)).first()
    return {c: sorted({float(x) for x in found[c] or []}) for c in STATISTICS}


def _bins(cuts: dict[str, list[float]]) -> Column:
    """Per statistic, how many thresholds the value is above."""

    def number(c: str, at: list[float]) -> Column:
        return F.size(F.filter(F.array(*map(F.lit, at)), lambda cut: F.col(c) > cut))

    return F.array(
        *(F.struct(F.lit(c).alias("column"), number(c, at).alias("bin")) for c, at in cuts.items())
    )


def _both(rows: DataFrame) -> tuple[int, int]:
    """Bad and good rows."""
    return tuple(rows.agg(F.count_if("bad"), F.count_if(~F.col("bad"))).first())


def _counts(rows: DataFrame, cuts: dict[str, list[float]]) -> dict[Test, tuple[int, int]]:
    """For every candidate test, how many bad and good rows pass it: one aggregate."""
    parts = (
        rows.select("bad", F.inline("bins"))
        .groupBy("column", "bin")
        .agg(F.count_if("bad").alias("p"), F.count_if(~F.col("bad")).alias("n"))
        .collect()
    )
    tests = {}
    for column, at in cuts.items():
        own = [(r["bin"], r["p"], r["n"]) for r in parts if r["column"] == column]
        for i, cut in enumerate(at):
            for above in (True, False):
                hit = [(p, n) for b, p, n in own if (b > i) == above]
                tests[Test(column, above, cut)] = (sum(p for p, _ in hit), sum(n for _, n in hit))
    return tests


def _all(tests: list[Test]) -> Column:
    return reduce(lambda a, b: a & b, (t.expression() for t in tests), F.lit(True))


def _gain(before: tuple[int, int], after: tuple[int, int]) -> float:
    """Bad rows kept, times the information gained about each."""
    p0, n0 = before
    p, n = after
    if not p or not p0:
        return 0.0
    return p * (log2(p / (p + n)) - log2(p0 / (p0 + n0)))


def learn(labelled: DataFrame, how: Covering = Covering()) -> list[list[Test]]:
    """Rules, in order, from rows with the statistics, `bad` and `aside` (both boolean).

    Everything that reaches the driver is a count per candidate test.
    """
    known = cut_lineage(labelled)
    cuts = _cuts(known.where("not aside"), how)
    known = cut_lineage(known.withColumn("bins", _bins(cuts)))
    grow, aside = known.where("not aside"), known.where("aside")
    rules: list[list[Test]] = []
    while len(rules) < how.rules and any(cuts.values()):
        rule: list[Test] = []
        now = _both(grow)
        while now[1] and len(rule) < how.tests:
            counts = _counts(grow.where(_all(rule)), cuts)
            best = max(counts, key=lambda t: (_gain(now, counts[t]), -t.cut, t.column, t.above))
            if _gain(now, counts[best]) <= 0:
                break
            rule.append(best)
            now = counts[best]
        if not rule:
            break
        # Every beginning of the rule is a candidate for the pruned rule.
        kept = []
        for n in range(1, len(rule) + 1):
            bad, good = _both(aside.where(_all(rule[:n])))
            kept.append(((bad - good) / max(bad + good, 1), -n, bad, good))
        _, n, bad, good = max(kept)
        rule = rule[:-n]
        if bad < how.support or bad < how.precision * (bad + good):
            break
        rules.append(rule)
        grow, aside = grow.where(~_all(rule)), aside.where(~_all(rule))
    return rules


def verdict(rules: list[list[Test]]) -> Column:
    """True unless a rule fits; the rules are tried in order."""
    if not rules:
        return F.lit(True)
    case = F.when(_all(rules[0]), F.lit(False))
    for rule in rules[1:]:
        case = case.when(_all(rule), F.lit(False))
    return case.otherwise(F.lit(True))


def labelled_rows(
    docs: DataFrame,
    labels: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    how: Covering = Covering(),
) -> DataFrame:
    """Statistics of a bounded sample of the labelled documents, by hash of their ids."""
    known = labels.select(F.col(id_column).alias("id"), F.col("quality").alias("quality"))
    known = picked(
        known.where("id is not null and quality is not null"), how.sample, "id", seed=3
    )
    texts = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    stats = statistics(texts.join(known, "id"), "text", how.window)
    # What the base rules reject anyway teaches nothing.
    return stats.where(~F.col("base_failed")).select(
        *STATISTICS,
        (F.col("row.quality") == 0).alias("bad"),
        (F.pmod(F.xxhash64("row.id", F.lit(7)), F.lit(3)) == 0).alias("aside"),
    )


def quality(
    docs: DataFrame,
    labels: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    how: Covering = Covering(),
) -> DataFrame:
    """`row` (all columns of `docs`), base counts, statistics, `base_failed` and `kept`."""
    rules = learn(labelled_rows(docs, labels, id_column, text_column, how), how)
    stats = statistics(docs, text_column, how.window)
    return stats.withColumn("kept", ~F.col("base_failed") & verdict(rules))
