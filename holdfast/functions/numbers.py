"""Numbers out of text, missing values, rounding and money text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed pattern: what counts as a number in text. Type suffixes ("1.0d") and
# digit groups ("1,000") do not.
NUMBER = r"^[ \t\r\n]*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?[ \t\r\n]*$"

# Fixed pattern: how text spells an infinite number.
INFINITE = r"^[+-]?(?i:inf|infinity)$"


def nan_to_null(c: Column) -> Column:
    """NaN sorts above every number in Spark, so it must go before any comparison."""
    return F.nullif(c, F.lit(float("nan")))


def parse_number(c: Column) -> Column:
    """Text to double; whatever is not a plain decimal number becomes null.

    Numbers beyond the range of a double are not numbers either, unless spelled as infinite.
    """
    number = c.try_cast("double")
    finite = F.abs(number) < float("inf")
    return F.when((c.rlike(NUMBER) & finite) | c.rlike(INFINITE), number)


def to_double(c: Column) -> Column:
    """Spark's own cast to double, with null instead of an error on bad text."""
    return c.try_cast("double")


def fill(c: Column, value: Column) -> Column:
    """`value` in place of null and of NaN."""
    return F.coalesce(nan_to_null(c), value)


def cents(c: Column) -> Column:
    """An amount of money as a whole number of cents."""
    return F.rint(c * 100).cast("bigint")


def money_sum(c: Column, places: int = 6) -> Column:
    """Sum of amounts as they are, to `places` decimals, the same for every partitioning.

    NaN counts as missing. An infinite amount makes the sum infinite, two of opposite signs NaN.
    The sum has 38 digits; what is beyond them is an error under ANSI rules and null without,
    never a wrapped number.
    """
    amount = nan_to_null(c.cast("double"))
    endless = F.abs(amount) == float("inf")
    finite = F.when(~endless, amount).cast(f"decimal(38,{places})")
    return F.coalesce(F.sum(F.when(endless, amount)), F.sum(finite).cast("double"))


def money_text(c: Column) -> Column:
    """12345.6 as ``$12,345.60``."""
    return F.concat(F.lit("$"), F.format_number(c, 2))


def round_even(c: Column, digits: int) -> Column:
    """Halves go to the even neighbour: 0.25 gives 0.2, 0.35 gives 0.4."""
    return F.bround(c, digits)
