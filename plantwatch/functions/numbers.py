"""Number helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def report_round(value: Column, digits: int) -> Column:
    """Round a double for a report, halves away from zero.

    The value passes through DECIMAL(38, 9) first, so that the last-bit noise which a distributed
    sum picks up cannot flip a decimal tie. Values too large for the decimal are rounded directly.
    """
    as_decimal = F.round(value.try_cast("decimal(38,9)"), digits).cast("double")
    return F.coalesce(as_decimal, F.round(value.cast("double"), digits))


def safe_ratio(numerator: Column, denominator: Column) -> Column:
    """numerator / denominator, 0 where the denominator is 0 or NULL."""
    return F.coalesce(F.try_divide(numerator.cast("double"), denominator.cast("double")), F.lit(0.0))


def known(value: Column) -> Column:
    """NaN counts as unknown."""
    return F.nanvl(value.cast("double"), F.lit(None).cast("double"))
