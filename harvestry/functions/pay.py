"""Pay rules as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Zloty to euro, working days a year, and the bounds between what counts as daily, euro, zloty and an error.
RATE, DAYS, DAILY, YEARLY, ERROR = 0.2342, 220, 5_000, 20_000, 1_500_000


def number(c: Column) -> Column:
    """c, null where it is NaN, which counts as missing everywhere."""
    return F.when(~F.isnan(c.cast("double")), c)


def euros(country: Column, low: Column, high: Column) -> tuple[Column, Column]:
    """Both ends of a pay range in euro: for Poland by the larger end's size, unchanged elsewhere; rounded half to even."""
    low, high = number(low), number(high)
    ref = F.greatest(low, high)  # skips nulls

    def end(v: Column) -> Column:
        v = v.cast("double")
        yearly, daily = F.bround(v * RATE, 0), F.bround(v * DAYS * RATE, 0)
        polish = F.when(ref > ERROR, F.lit(None)).when(ref >= YEARLY, yearly).when(ref < DAILY, daily).otherwise(F.bround(v, 0))
        return F.when(F.lower(country) == "pl", polish).otherwise(F.bround(v, 0)).cast("int")

    return end(low), end(high)


def middle(low: Column, high: Column) -> Column:
    """The range's middle, half to even; null if an end lacks."""
    return F.bround((number(low).cast("double") + number(high).cast("double")) / 2, 0).cast("int")


def whole(c: Column) -> Column:
    """A number out of text, cut to an integer; null for what is none."""
    return c.try_cast("double").try_cast("int")
