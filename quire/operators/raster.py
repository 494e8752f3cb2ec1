"""Ink, thresholds and gaps of page rasters.

A raster is a row with ``pixels``, an array of grey values 0 to 255.  The
relational form keeps one count for each image and grey value; the Arrow form
does the same for whole images in numpy and suits large ones.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def grey_histogram(images: DataFrame, *keys: str, pixels: str = "pixels") -> DataFrame:
    return images.select(*keys, F.explode(pixels).alias("bin")).withColumn("bin", F.col("bin").cast("int")).groupBy(*keys, "bin").agg(F.count("*").alias("n"))


def otsu_threshold(histogram: DataFrame, *keys: str) -> DataFrame:
    """``threshold`` and ``ink_ratio``: the grey value that parts dark from light best, and the share at or below it.

    The lowest of equal values counts.  An image of a single grey value has the
    threshold zero.  Sums are kept exact as integers up to the last division.
    """
    upto = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    out = histogram.withColumns({"n1": F.sum("n").over(upto), "s1": F.sum(F.col("bin") * F.col("n")).over(upto), "total": F.sum("n").over(whole), "s": F.sum(F.col("bin") * F.col("n")).over(whole)})
    gap = (F.col("total") * F.col("s1") - F.col("n1") * F.col("s")).cast("double")
    spread = F.when(F.col("n1") < F.col("total"), gap * gap / (F.col("n1") * (F.col("total") - F.col("n1"))).cast("double"))
    best = out.withColumn("spread", spread).groupBy(*keys).agg(
        F.max(F.when(F.col("spread") > 0, F.struct("spread", (-F.col("bin")).alias("order"), "n1"))).alias("best"),
        F.max("total").alias("total"),
        F.sum(F.when(F.col("bin") == 0, F.col("n")).otherwise(0)).alias("black"),
    )
    ink = F.coalesce("best.n1", "black") / F.col("total")
    return best.select(*keys, F.coalesce(-F.col("best.order"), F.lit(0)).alias("threshold"), ink.alias("ink_ratio"))


def ink_ratio(images: DataFrame, *keys: str, pixels: str = "pixels") -> DataFrame:
    """``threshold`` and ``ink_ratio`` of each image; an image without pixels has zero ink."""
    found = otsu_threshold(grey_histogram(images, *keys, pixels=pixels), *keys)
    out = images.select(*keys).distinct().join(found, list(keys), "left")
    return out.withColumns({"threshold": F.coalesce("threshold", F.lit(0)), "ink_ratio": F.coalesce("ink_ratio", F.lit(0.0))})


def otsu(pixels: np.ndarray) -> tuple[int, float]:
    """Threshold and ink ratio of one image."""
    counts = np.bincount(pixels.ravel(), minlength=256).astype(np.int64)
    total = int(counts.sum())
    if not total:
        return 0, 0.0
    n1 = counts.cumsum()
    s1 = (counts * np.arange(256)).cumsum()
    inside = (n1 > 0) & (n1 < total)
    gap = (total * s1 - n1 * s1[-1]).astype(np.float64)
    spread = np.where(inside, gap * gap / np.where(inside, n1 * (total - n1), 1), 0)
    at = int(spread.argmax()) if spread.max() > 0 else 0
    return at, float(n1[at]) / total


@F.pandas_udf(T.StructType([T.StructField("ink_ratio", T.DoubleType()), T.StructField("threshold", T.IntegerType())]))
def image_ink(data: pd.Series, channels: pd.Series) -> pd.DataFrame:
    """Ink of decoded images (``image.data``, ``image.nChannels``), their channels ordered blue, green, red."""
    out = []
    for raw, n in zip(data, channels, strict=True):
        px = np.frombuffer(raw or b"", np.uint8)
        if n and n >= 3 and len(px):
            px = px.reshape(-1, int(n))[:, :3].astype(np.float64) @ np.array([0.114, 0.587, 0.299])
            px = np.rint(px).astype(np.uint8)
        t, ratio = otsu(px)
        out.append((ratio, t))
    return pd.DataFrame(out, columns=["ink_ratio", "threshold"])


def projection_split(profile: DataFrame, *keys: str, at: str = "pos", ink: str = "ink") -> DataFrame:
    """Splits pages at the widest gap of a profile: ink counts by row or column.

    Positions with less than five, or five hundredths of the largest count, are
    low; the longest run of them, the earliest among equals, is a gap if it spans
    three positions and three hundredths of the page.  Returns ``split``,
    ``first`` and ``second`` (start and size; null if ten positions or fewer) of
    the pages that have one.  One shuffle by page, none if the rows of a page lie
    together; no join, since a profile may be far larger than its estimate and
    must never be broadcast.
    """
    page, order = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy(at)
    sized = profile.withColumns({"size": F.max(at).over(page) + 1, "most": F.max(ink).over(page)})
    low = sized.where((F.col("most") > 0) & (F.col(ink) < F.greatest(F.lit(5), F.floor(F.col("most") * 0.05))))
    runs = low.withColumn("run", F.col(at) - F.row_number().over(order)).groupBy(*keys, "run", "size").agg(F.count("*").alias("length"), F.min(at).alias("start"))
    best = runs.groupBy(*keys, "size").agg(F.max(F.struct("length", (-F.col("start")).alias("order"))).alias("gap"))
    best = best.where(F.col("gap.length") >= F.greatest(F.lit(3), F.floor(F.col("size") * 0.03)))
    middle = F.floor((2 * -F.col("gap.order") + F.col("gap.length") - 1) / 2)
    out = best.withColumn("split", middle).withColumn("pad", F.floor(F.col("size") * 0.01))
    cut, resume = F.greatest(F.lit(0), F.col("split") - F.col("pad")), F.least(F.col("size"), F.col("split") + F.col("pad"))
    part = lambda a, b: F.when(b - a > 10, F.struct(a.cast("int").alias("start"), (b - a).cast("int").alias("size")))
    return out.select(*keys, F.col("size").cast("int").alias("size"), F.col("split").cast("int").alias("split"), part(F.lit(0), cut).alias("first"), part(resume, F.col("size")).alias("second"))


def grey(rgb: np.ndarray) -> np.ndarray:
    """Grey values of a height x width x 3 array in red, green, blue order."""
    return np.rint(rgb.astype(np.float64) @ np.array([0.299, 0.587, 0.114])).astype(np.uint8)


def profile_of(pixels: np.ndarray, axis: int) -> np.ndarray:
    """Ink counts by row (axis 1) or column (axis 0) of a grey image, the rarer of dark and light being ink."""
    t, _ = otsu(pixels)
    light = pixels > t
    ink = ~light if light.mean() * 255 > 127 else light
    return ink.sum(axis=axis)


def fit_within(width: int, height: int, most: tuple[int, int] = (400, 400)) -> tuple[int, int]:
    """Size of an image scaled down, never up, to fit."""
    scale = min(most[0] / width, most[1] / height, 1.0)
    return int(width * scale), int(height * scale)


def fitted(width: Column, height: Column, most: tuple[int, int] = (400, 400)) -> Column:
    """The same of columns: ``w`` and ``h`` of images scaled down, never up, to fit."""
    scale = F.least(F.lit(float(most[0])) / width, F.lit(float(most[1])) / height, F.lit(1.0))
    return F.struct((width * scale).cast("int").alias("w"), (height * scale).cast("int").alias("h"))


def shrink(pixels: np.ndarray, most: tuple[int, int] = (400, 400)) -> np.ndarray:
    """The image scaled down by averaging areas."""
    height, width = pixels.shape[:2]
    w, h = fit_within(width, height, most)
    if (w, h) == (width, height):
        return pixels
    rows, cols = np.linspace(0, height, h + 1), np.linspace(0, width, w + 1)
    sums = np.pad(pixels.astype(np.float64).cumsum(0).cumsum(1), [(1, 0), (1, 0)] + [(0, 0)] * (pixels.ndim - 2))

    def at(table: np.ndarray, edges: np.ndarray, axis: int) -> np.ndarray:
        low = np.floor(edges).astype(int)
        high = np.minimum(low + 1, table.shape[axis] - 1)
        part = (edges - low).reshape([-1 if a == axis else 1 for a in range(table.ndim)])
        return table.take(low, axis) * (1 - part) + table.take(high, axis) * part

    table = at(at(sums, rows, 0), cols, 1)
    area = np.diff(np.diff(table, axis=0), axis=1) / ((height / h) * (width / w))
    return np.clip(np.rint(area), 0, 255).astype(np.uint8)

