"""Image quality: exposure and sharpness from pixels, flags from both and from notes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.functions import fixed


def exposure_flags(mean: Column, share: Column) -> Column:
    """The flags of an image's mean brightness and its share of bright pixels."""
    return F.array_compact(F.array(F.when(mean <= fixed.LOW_LIGHT_MEAN, "low-light"), F.when((mean >= fixed.GLARE_MEAN) | (share >= fixed.GLARE_SHARE), "glare")))


def pixel_exposure(pixels: DataFrame, key: str = "image_id") -> DataFrame:
    """key, mean, bright_share, flags of a table of pixels (key, x, y, lum)."""
    sums = pixels.groupBy(key).agg(F.avg("lum").alias("mean"), F.avg(F.when(F.col("lum") >= fixed.BRIGHT, 1.0).otherwise(0.0)).alias("bright_share"))
    return sums.withColumn("flags", exposure_flags(F.col("mean"), F.col("bright_share")))


def _measures(grey: np.ndarray) -> tuple[float, float, float]:
    """Mean, share of bright pixels, and variance of the Laplacian over inner pixels of an image (0 where there are none), by shifted arrays."""
    if not grey.size:
        return 0.0, 0.0, 0.0
    edge = 4 * grey[1:-1, 1:-1] - grey[:-2, 1:-1] - grey[2:, 1:-1] - grey[1:-1, :-2] - grey[1:-1, 2:] if min(grey.shape) >= 3 else np.zeros((0, 0))
    return float(grey.mean()), float((grey >= fixed.BRIGHT).mean()), float(edge.var()) if edge.size else 0.0


def grid_signals(images: DataFrame, key: str = "image_id") -> DataFrame:
    """key, mean, bright_share, variance, flags, blurred of images (key, width, lum: an array of brightness, row by row), without a shuffle.

    All but the key are null where the array is null, empty or no whole number of rows.
    """
    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for name, width, lum in frame.itertuples(index=False):
                fits = lum is not None and len(lum) > 0 and width > 0 and len(lum) % int(width) == 0
                rows.append((name, *(_measures(np.asarray(lum, np.float64).reshape(-1, int(width))) if fits else (None,) * 3)))
            yield pd.DataFrame(rows, columns=[key, "mean", "bright_share", "variance"])

    # Halves and wholes of a brightness alike; a missing width is no width, and a missing cell has no brightness.
    cells = F.when(~F.exists("lum", lambda v: v.isNull()), F.col("lum").cast("array<double>")).alias("lum")
    made = images.select(key, F.coalesce(F.col("width"), F.lit(0)).alias("width"), cells).mapInPandas(work, f"`{key}` {dict(images.dtypes)[key]}, mean double, bright_share double, variance double")
    return made.withColumns({"flags": F.when(F.col("mean").isNotNull(), exposure_flags(F.col("mean"), F.col("bright_share"))), "blurred": F.col("variance") < fixed.BLUR_VARIANCE})


def pixel_grids(pixels: DataFrame, key: str = "image_id") -> DataFrame:
    """key, width, lum: a table of pixels (key, x, y, lum) as one array an image, row by row; one shuffle. An image that lacks pixels has fewer than its rows need."""
    held = pixels.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("y", "x", "lum"))).alias("_cells"), (F.max("x") - F.min("x") + 1).cast("int").alias("width"))
    return held.select(key, "width", F.transform("_cells", lambda c: c["lum"]).alias("lum"))


def pixel_sharpness(pixels: DataFrame, key: str = "image_id") -> DataFrame:
    """key, variance and blurred (see ``grid_signals``) of a table of pixels (key, x, y, lum)."""
    return grid_signals(pixel_grids(pixels, key), key).select(key, "variance", "blurred")


def image_signals(images: DataFrame) -> DataFrame:
    """path, mean, bright_share, variance of decoded images (Spark's image source), an image at a time."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, h, w, n, data in frame.itertuples(index=False):
                px = np.frombuffer(data, np.uint8).reshape(h, w, n).astype(np.float64)
                grey = px[:, :, 0] if n == 1 else px[:, :, 2] * 0.299 + px[:, :, 1] * 0.587 + px[:, :, 0] * 0.114
                rows.append((path, *_measures(grey)))
            yield pd.DataFrame(rows, columns=["path", "mean", "bright_share", "variance"])

    flat = images.select("image.origin", "image.height", "image.width", "image.nChannels", "image.data")
    return flat.mapInPandas(work, "path string, mean double, bright_share double, variance double")


def merge_flags(blurred: Column, exposure: Column, notes: Column) -> tuple[Column, Column, Column]:
    """(flags, each once and by its first source; the same with the source; whether there is any)."""
    measured = F.array_union(F.when(blurred, F.array(F.lit("blur"))).otherwise(F.array().cast("array<string>")), exposure)
    flags = F.array_union(measured, notes)
    sourced = F.transform(flags, lambda f: F.struct(f.alias("flag"), F.when(F.array_contains(measured, f), "heuristic").otherwise("model").alias("source")))
    return flags, sourced, F.size(flags) > 0
