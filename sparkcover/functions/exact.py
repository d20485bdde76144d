"""Order-free sums of doubles (A9): binned whole-number accumulation.

A plain floating-point sum depends on the order in which a shuffle delivers its values. Here
every value is cut into signed digits of 24 bits at fixed binary places; the digits of one
place are whole numbers, so their sums (plain hash aggregates of bigint, pre-reduced before
the shuffle) are exact in any order. The digit sums are then carried into one number, which
is rounded once, to the nearest double, ties to even: what an exact sum would give.

The places that matter follow from the smallest and largest magnitude of the values; bigint
digit sums hold 2^39 values.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIGIT = 24
_BASE = 1 << DIGIT
_LEAST_BIT = -1074  # the last bit of the smallest doubles
_WHOLE = "decimal(38,0)"


def _scaled(x: Column, power: int) -> Column:
    """``x * 2**power``, in two steps: one factor alone may be beyond a double's range."""
    half = power // 2
    return x * F.lit(2.0**half) * F.lit(2.0 ** (power - half))


class ExactSum:
    """Exact sums of values that are 0 or between ``least`` and ``most`` in magnitude."""

    def __init__(self, least: float | None, most: float | None):
        if not most:
            self.low = self.high = 0
            return
        self.low = max(math.frexp(least)[1] - 53, _LEAST_BIT) // DIGIT
        self.high = max(self.low, (math.frexp(most)[1] - 1) // DIGIT)

    @classmethod
    def of_column(cls, df: DataFrame, col: str) -> ExactSum:
        """The places that the finite values of a column need: one small aggregate."""
        size = F.abs(F.col(col).cast("double"))
        finite = size < F.lit(math.inf)  # NaN counts as larger than all numbers
        row = df.agg(
            F.min(F.when(finite & (size > 0), size)).alias("least"), F.max(F.when(finite, size)).alias("most")
        ).first()
        return cls(row["least"], row["most"])

    @property
    def places(self) -> range:
        return range(self.low, self.high + 1)

    def partials(self, x: Column, name: str) -> list[Column]:
        """The aggregates to group by: a digit sum per place, and a sum of what isn't finite."""
        x = x.cast("double")
        size = F.abs(x)
        finite = size < F.lit(math.inf)
        sums = []
        for n, place in enumerate(self.places):
            t = _scaled(size, -DIGIT * place)
            # all steps are exact; from 2^77 on the digit holds no bit of x
            above = F.floor(t / F.lit(float(_BASE))).cast("double") * F.lit(float(_BASE))
            digit = F.when(finite & (t < F.lit(2.0**77)), F.floor(t - above)).when(x.isNotNull(), F.lit(0))
            sums.append(F.sum(F.when(x < 0, -digit).otherwise(digit).cast("bigint")).alias(f"{name}_{n}"))
        return [*sums, F.sum(F.when(x.isNotNull() & ~finite, x)).alias(f"{name}_beyond")]

    def total(self, name: str) -> Column:
        """The sum that the aggregates of ``partials`` stand for; null where there was no value."""
        sums = F.array(*[F.col(f"{name}_{n}") for n, _ in enumerate(self.places)])
        n_all = len(self.places) + 1

        def carried(digits: Column) -> Column:
            """Digits in [0, 2^24), the highest first, behind a signed rest."""
            begin = F.struct(F.lit(0).cast("bigint").alias("rest"), F.array().cast("array<bigint>").alias("out"))
            done = F.aggregate(
                digits,
                begin,
                lambda a, s: F.struct(
                    F.shiftright(a["rest"] + s, DIGIT).alias("rest"),
                    F.concat(F.array((a["rest"] + s).bitwiseAND(F.lit(_BASE - 1))), a["out"]).alias("out"),
                ),
            )
            return F.transform(F.array(done), lambda d: F.concat(F.array(d["rest"]), d["out"]))[0]

        def rounded(digits: Column) -> Column:
            """The double nearest to non-negative carried digits."""
            first = F.array_position(F.transform(digits, lambda d: d > 0), True).cast("int")

            def from_first(i: Column) -> Column:
                # four digits from the first that isn't 0 have at least 73 bits; the rest only breaks ties
                top = F.aggregate(
                    F.slice(digits, i, 4),
                    F.lit(0).cast(_WHOLE),
                    lambda a, d: (a * F.lit(_BASE).cast("decimal(8,0)") + d.cast("decimal(20,0)")).cast(_WHOLE),
                )
                more = F.exists(F.slice(digits, i + 4, n_all), lambda d: d > 0)
                even = (top % F.lit(2).cast("decimal(1,0)")) == 0
                whole = (top + F.when(more & even, F.lit(1)).otherwise(F.lit(0)).cast("decimal(1,0)")).cast("double")
                below = F.greatest(F.lit(n_all) - (i + 3), F.lit(0))  # digits under the lowest one taken
                halves = [
                    F.array(*[F.lit(2.0**f(DIGIT * (self.low + k))) for k in range(n_all)])
                    for f in (lambda p: p // 2, lambda p: p - p // 2)
                ]
                return whole * halves[0][below] * halves[1][below]

            return F.when(first == 0, F.lit(0.0)).otherwise(F.transform(F.array(first), from_first)[0])

        def signed(digits: Column) -> Column:
            negative = digits[0] < 0
            flipped = carried(F.transform(sums, lambda s: -s))
            return F.when(negative, -rounded(flipped)).otherwise(rounded(digits))

        finite = F.transform(F.array(carried(sums)), signed)[0]
        whole = F.when(F.col(f"{name}_0").isNotNull(), finite)
        return F.coalesce(F.col(f"{name}_beyond"), whole)
