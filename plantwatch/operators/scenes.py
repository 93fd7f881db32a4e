"""Scenes of a colour and a thermal picture: matching files, pixel statistics, labels, chat rows.

Pictures arrive as pixel arrays: `celsius`, and `r`, `g`, `b` from 0 to 255. Every operator works on
one row at a time, so a picture is the largest thing a task holds.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plantwatch.functions.jsontext import label_json
from plantwatch.functions.rules import fire_size, hotspot_intensity, image_name, scene_id

# Limits of the pixel rules.
FIRE_C = 60.0
HOT_C = 100.0
SMOKE_MAX_SATURATION = 0.18
SMOKE_MIN_BRIGHTNESS = 0.55
SMOKE_SHARE = 0.05
DARK_MEAN, BRIGHT_MEAN, FLAT_STD = 30.0, 220.0, 15.0

# Label fields in their order, category of scenes with fire.
LABEL_FIELDS = (
    "fire_present", "thermal_hotspot_intensity", "fire_size", "smoke_visible", "image_quality_limited",
)
FIRE_CATEGORY = "Fire"

SCENE_KEY = ("category", "stem")

CHAT_SCHEMA = T.ArrayType(
    T.StructType(
        [
            T.StructField("role", T.StringType()),
            T.StructField(
                "content",
                T.ArrayType(
                    T.StructType(
                        [
                            T.StructField("type", T.StringType()),
                            T.StructField("image", T.StringType()),
                            T.StructField("text", T.StringType()),
                        ]
                    )
                ),
            ),
        ]
    )
)


def match_scenes(rgb: DataFrame, thermal: DataFrame, tiff: DataFrame) -> DataFrame:
    """Scenes present in all three listings; each side brings its own path column."""
    keys = list(SCENE_KEY)
    return tiff.join(rgb, keys).join(thermal, keys)


def thermal_stats(scenes: DataFrame) -> DataFrame:
    """Add `max_c` and `pct_hot`, the share of pixels above 100 °C. Unknown pixels do not count; a
    picture without a known pixel has neither."""
    pixels = F.filter("celsius", lambda c: c.isNotNull() & ~F.isnan(c))
    known = scenes.withColumn("_known", pixels)
    hot = F.size(F.filter("_known", lambda c: c > HOT_C))
    return (
        known.withColumn("max_c", F.array_max("_known"))
        .withColumn("pct_hot", F.try_divide(hot, F.size("_known")) * 100.0)
        .drop("_known")
    )


def _pixels() -> Column:
    return F.arrays_zip("r", "g", "b")


def smoke_fraction(scenes: DataFrame) -> DataFrame:
    """Add `smoke_share`, the share of bright pixels with little colour."""

    def smoky(p: Column) -> Column:
        high, low = F.greatest(p["r"], p["g"], p["b"]), F.least(p["r"], p["g"], p["b"])
        return (high - low < high * SMOKE_MAX_SATURATION) & (high > 255 * SMOKE_MIN_BRIGHTNESS)

    share = F.try_divide(F.size(F.filter(_pixels(), smoky)), F.size("r"))
    return scenes.withColumn("smoke_share", share)


def quality_limited(scenes: DataFrame) -> DataFrame:
    """Add `gray_mean`, `gray_std` and `quality_limited`: too dark, too bright or too flat."""
    zero = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("q"))

    def add(total: Column, p: Column) -> Column:
        gray = (p["r"] + p["g"] + p["b"]) / 3.0
        return F.struct((total["s"] + gray).alias("s"), (total["q"] + gray * gray).alias("q"))

    summed = scenes.withColumn("_sums", F.aggregate(_pixels(), zero, add))
    count = F.size("r")
    mean = F.try_divide(F.col("_sums.s"), count)
    variance = F.greatest(F.try_divide(F.col("_sums.q"), count) - F.col("gray_mean") * F.col("gray_mean"), F.lit(0.0))
    limited = (
        (F.col("gray_mean") < DARK_MEAN) | (F.col("gray_mean") > BRIGHT_MEAN) | (F.col("gray_std") < FLAT_STD)
    )
    return (
        summed.withColumn("gray_mean", mean)
        .withColumn("gray_std", F.sqrt(variance))
        .withColumn("quality_limited", limited)
        .drop("_sums")
    )


def pixel_stats_arrow(scenes: DataFrame) -> DataFrame:
    """The statistics of the three operators above in one pass of numpy over Arrow batches.

    Use it for large pictures, where interpreting an expression per pixel costs more than the
    transfer. Gives the same columns.
    """
    @F.pandas_udf("max_c double, pct_hot double, smoke_share double, gray_mean double, gray_std double")
    def stats(celsius: pd.Series, r: pd.Series, g: pd.Series, b: pd.Series) -> pd.DataFrame:
        rows = []
        for heat, red, green, blue in zip(celsius, r, g, b):
            heat = np.asarray(heat, dtype=float)
            heat = heat[~np.isnan(heat)]
            red, green, blue = (np.asarray(c, dtype=float) for c in (red, green, blue))
            bands = np.stack([red, green, blue])
            high = bands.max(axis=0)
            smoky = (np.ptp(bands, axis=0) < high * SMOKE_MAX_SATURATION) & (high > 255 * SMOKE_MIN_BRIGHTNESS)
            gray = (red + green + blue) / 3.0
            rows.append(
                (
                    heat.max() if heat.size else None,
                    (heat > HOT_C).mean() * 100.0 if heat.size else None,
                    smoky.mean() if smoky.size else None,
                    gray.mean() if gray.size else None,
                    gray.std() if gray.size else None,
                )
            )
        return pd.DataFrame(rows, columns=["max_c", "pct_hot", "smoke_share", "gray_mean", "gray_std"])

    limited = (
        (F.col("gray_mean") < DARK_MEAN) | (F.col("gray_mean") > BRIGHT_MEAN) | (F.col("gray_std") < FLAT_STD)
    )
    return (
        scenes.withColumn("_stats", stats("celsius", "r", "g", "b"))
        .select("*", "_stats.*")
        .drop("_stats")
        .withColumn("quality_limited", limited)
    )


def build_labels(scenes: DataFrame, large_pictures: bool = False) -> DataFrame:
    """Add the five label fields and the statistics behind them.

    Without fire the size is "none" and smoke is not claimed. A hottest pixel between 60 and 100 °C
    gives fire of size "none".
    """
    if large_pictures:
        measured = pixel_stats_arrow(scenes)
    else:
        measured = quality_limited(smoke_fraction(thermal_stats(scenes)))
    fire = F.col("max_c") > FIRE_C
    return measured.withColumns(
        {
            "fire_present": fire,
            "thermal_hotspot_intensity": hotspot_intensity(F.col("max_c")),
            "fire_size": F.when(fire.isNull(), None).when(fire, fire_size(F.col("pct_hot"))).otherwise("none"),
            "smoke_visible": F.when(fire.isNull(), None).otherwise(fire & (F.col("smoke_share") > SMOKE_SHARE)),
            "image_quality_limited": F.col("quality_limited"),
        }
    )


def label_mismatch(labelled: DataFrame) -> DataFrame:
    """Scenes whose folder says something else than the pixels."""
    return labelled.filter((F.col("category") == FIRE_CATEGORY) != F.col("fire_present"))


def label_rows(labelled: DataFrame) -> DataFrame:
    """Scene id, category, the picture paths there are, and label text, one row per scene."""
    paths = {"rgb_path": "rgb_path", "thermal_path": "thermal_path", "tiff_path": "thermal_tiff_path"}
    return labelled.select(
        scene_id(F.col("category"), F.col("stem")).alias("scene_id"),
        "category",
        *[F.col(c).alias(name) for c, name in paths.items() if c in labelled.columns],
        label_json(LABEL_FIELDS).alias("label_json"),
    )


def label_distribution(labelled: DataFrame) -> DataFrame:
    """(field, value, n) over the label fields."""
    texts = labelled.select(*[F.col(c).cast("string").alias(c) for c in LABEL_FIELDS])
    return (
        texts.unpivot([], list(LABEL_FIELDS), "field", "value")
        .groupBy("field", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def build_chat_rows(rows: DataFrame, system_text: str, user_text: str) -> DataFrame:
    """Training rows: system text, a user turn with both pictures and a question, the label as answer.

    `rows` has `scene_id` and `label_json`; `scene_id` and `split` are kept.
    """

    def content(kind: str, value: Column) -> Column:
        empty = F.lit(None).cast("string")
        image, text = (value, empty) if kind == "image" else (empty, value)
        return F.struct(F.lit(kind).alias("type"), image.alias("image"), text.alias("text"))

    def message(role: str, *parts: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), F.array(*parts).alias("content"))

    scene = F.col("scene_id")
    messages = F.array(
        message("system", content("text", F.lit(system_text.strip()))),
        message(
            "user",
            content("image", image_name(scene, "rgb")),
            content("image", image_name(scene, "thermal")),
            content("text", F.lit(user_text)),
        ),
        message("assistant", content("text", F.col("label_json"))),
    )
    kept = [c for c in ("scene_id", "split") if c in rows.columns]
    return rows.select(*kept, messages.cast(CHAT_SCHEMA).alias("messages"))
