"""Process instruments: nominal values and deviations from them."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantwatch.functions.numbers import report_round
from plantwatch.functions.rules import deviation_pct
from plantwatch.functions.texts import strip, to_number

NOMINAL_TEXTS = ("variable", "variable_medicion", "unit", "desde", "hasta")


def union_sheets(sheets: Mapping[tuple[str, str], DataFrame]) -> DataFrame:
    """One table of all sheets, each tagged with its (equipment, regime)."""
    tagged = [
        sheet.withColumn("equipment_id", F.lit(equipment)).withColumn("regime", F.lit(regime))
        for (equipment, regime), sheet in sheets.items()
    ]
    return reduce(lambda a, b: a.unionByName(b), tagged)


def load_nominals(sheets: Mapping[tuple[str, str], DataFrame]) -> DataFrame:
    """Clean nominal values from one text table per (equipment, regime).

    A row needs a tag and a numeric nominal value; other texts are trimmed and may be empty.
    """
    rows = union_sheets({key: sheet.dropna(how="all") for key, sheet in sheets.items()})
    nominal = to_number(F.col("nominal_value").cast("string"))
    tag = strip(F.col("tag").cast("string"))
    cleaned = rows.select(
        "equipment_id",
        "regime",
        tag.alias("tag"),
        *[
            F.coalesce(strip(F.col(c).cast("string")), F.lit("")).alias(c)
            for c in NOMINAL_TEXTS
            if c in rows.columns
        ],
        nominal.alias("nominal_value"),
    )
    return cleaned.filter(F.col("nominal_value").isNotNull() & ~F.col("tag").isin("", "nan"))


def attach_nominals(readings: DataFrame, nominals: DataFrame, value: str = "value") -> DataFrame:
    """Readings with the nominal value of their tag and regime and the deviation from it.

    The join keys are whatever of equipment, regime and tag both sides have. Nominal values grow
    with the number of instruments, so nothing is forced to broadcast: Spark does it when the
    measured size allows and splits hot tags in the shuffled join otherwise.
    """
    keys = [k for k in ("equipment_id", "regime", "tag") if k in nominals.columns and k in readings.columns]
    exact = F.col(value).cast("double")
    return (
        readings.join(nominals, keys)
        .withColumn("deviation_pct", deviation_pct(exact, F.col("nominal_value")))
        .withColumn(value, report_round(exact, 3))
    )
