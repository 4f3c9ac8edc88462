"""Exact first and second moments of expenses, in cells that merge in any order.

Amounts are whole cents below 10^18, so a square has up to 36 digits and a sum of
squares may pass the 38 that a decimal holds. Each amount is therefore split into
a high and a low half of 30 bits, and the three kinds of products are summed
apart. No sum can overflow below 10^19 rows, and equal rows give equal cells
whatever their order or partitioning.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledger_spark.functions.parsing import as_double

# The outlier distance and the small-expense bound.
OUTLIER_DEVIATIONS = 2
SMALL_EXPENSE = -500

_HALF = 30
_WHOLE = "decimal(38,0)"
_SUMS = ("expenses", "square_high", "square_cross", "square_low", "small_expenses")
MOMENTS = (*_SUMS, "largest_expense")


def moment_measures(small: float = SMALL_EXPENSE) -> list[Column]:
    """Aggregates over transaction rows; ``expense_sum`` and ``rows`` belong to the rollup."""
    expense = F.when(F.col("amount") < 0, F.col("amount"))
    cents = (F.abs(expense) * 100).cast("bigint")
    high, low = F.shiftright(cents, _HALF), cents.bitwiseAND(F.lit((1 << _HALF) - 1))

    def total(product: Column, name: str) -> Column:
        return F.sum(product.cast("decimal(28,0)")).alias(name)

    return [
        F.count(expense).alias("expenses"),
        total(high * high, "square_high"),
        total(high * low, "square_cross"),
        total(low * low, "square_low"),
        F.count_if(expense > small).alias("small_expenses"),
        F.min(expense).alias("largest_expense"),
    ]


def merged_moments() -> list[Column]:
    """The same aggregates over cells."""
    return [*[F.sum(c).alias(c) for c in _SUMS], F.min("largest_expense").alias("largest_expense")]


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _quotient(a: Column, b: Column) -> Column:
    """Whole part of a / b for whole numbers that are not negative; null where it has over 32 digits."""
    return _let(F.struct(a.alias("a"), b.alias("b")), lambda p: F.try_divide(p["a"] - p["a"] % p["b"], p["b"]).cast(_WHOLE))


def _whole_root(y: Column) -> Column:
    """Whole part of the square root: a double is near enough for one step of Newton's method to come within one."""

    def nearer(root: Column) -> Column:
        return F.when(root > 0, _quotient(root + _quotient(y, root), F.lit(2).cast(_WHOLE))).otherwise(root)

    def settled(root: Column) -> Column:
        above = (root + 1) * (root + 1) <= y
        return F.when(root * root > y, root - 1).when(above, root + 1).otherwise(root)

    return _let(_let(F.floor(F.sqrt(as_double(y))).cast(_WHOLE), nearer), settled)


def with_spread(cells: DataFrame) -> DataFrame:
    """Replace the moments by mean, sample deviation and the bound of unusual expenses.

    An expense of x cents among n with sum S and sum of squares Q is unusual if it
    is more than two sample deviations above the mean size, which is
    n x - S > sqrt(4 n (n Q - S^2) / (n - 1)). The left side is whole, so the root
    may be cut to its whole part R, and the test becomes x > floor((S + R) / n).
    ``large_bound`` is that number as an amount: lower amounts are unusual. All of
    this is done in whole numbers of 38 digits, which suffices as long as n times
    the root mean square stays below 5 10^18 cents; beyond that the bound is
    rounded like any double, but still the same for equal rows.
    """
    n = F.col("expenses").cast("decimal(20,0)")
    count = as_double(F.col("expenses"))
    others = F.nullif(count - 1, F.lit(0.0))
    total = (-F.col("expense_sum") * 100).cast(_WHOLE)
    power = lambda bits: F.lit(1 << bits).cast("decimal(20,0)")
    square = F.try_add(
        F.try_add(
            F.try_multiply(F.col("square_high"), power(2 * _HALF)),
            F.try_multiply(F.col("square_cross"), power(_HALF + 1)),
        ),
        F.col("square_low"),
    )
    spread = _let(total, lambda s: F.try_subtract(F.try_multiply(n, square), F.try_multiply(s, s)))
    rough = (
        as_double(F.col("square_high")) * float(1 << 2 * _HALF)
        + as_double(F.col("square_cross")) * float(1 << _HALF + 1)
        + as_double(F.col("square_low"))
    )
    variance = (rough - as_double(total) * as_double(total) / count) / others
    variance = F.when(variance < 0, F.lit(0.0)).otherwise(variance)
    cells = cells.withColumn("__spread", spread)
    exact = as_double(F.col("__spread")) / (count * others)
    cells = cells.withColumns(
        {
            "expense_mean": as_double(F.col("expense_sum")) / F.nullif(count, F.lit(0.0)),
            "expense_stddev": F.sqrt(F.coalesce(exact, variance)) / 100.0,
        }
    )
    factor = F.lit(OUTLIER_DEVIATIONS**2).cast("decimal(4,0)")
    scaled = F.try_multiply(F.col("__spread"), factor)
    radicand = _let(scaled, lambda y: F.try_add(y, _quotient(y, F.nullif(n - 1, F.lit(0).cast("decimal(20,0)")))))
    limit = _quotient(total + _let(radicand, _whole_root), n)
    near = -F.ceil(100.0 * (F.col("expense_mean") - float(OUTLIER_DEVIATIONS) * F.col("expense_stddev")))
    cents = F.coalesce(limit, near.cast(_WHOLE)).cast("decimal(35,0)")
    bound = (-cents * F.lit("0.01").cast("decimal(2,2)")).cast("decimal(38,2)")
    return cells.withColumn("large_bound", bound).drop("square_high", "square_cross", "square_low", "__spread")
