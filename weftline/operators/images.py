"""Frames as arrays of pixel rows: scene changes, colour channels, perceptual hashes; and least squares over rows."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, DoubleType

from weftline.functions import arrays as V
from weftline.functions import numbers as N
from weftline.operators.ordering import frame


def change_by_correlation(frames: DataFrame, histogram: str, order_by: Sequence[str], partition_by: Sequence[str] = (), name: str = "correlation") -> DataFrame:
    """Frames but the first of each film, with the correlation of their histogram and the first frame's."""
    w = frame(order_by, partition_by)
    held = frames.withColumn("_first", F.first(histogram).over(w.rowsBetween(W.unboundedPreceding, 0))).withColumn("_later", F.lag(F.lit(1)).over(w))
    doubles = lambda c: F.transform(F.col(c), lambda x: x.cast("double"))
    return held.where("_later = 1").withColumn(name, V.histogram_correlation(doubles("_first"), doubles(histogram))).drop("_first", "_later")


def change_by_blocks(frames: DataFrame, means: str, order_by: Sequence[str], partition_by: Sequence[str] = (), name: str = "change") -> DataFrame:
    """Frames but the first, with the absolute difference of each block's mean from the frame before."""
    held = frames.withColumn("_before", F.lag(means).over(frame(order_by, partition_by)))
    return held.where("_before IS NOT NULL").withColumn(name, F.zip_with("_before", means, lambda a, b: F.abs(b - a))).drop("_before")


def channels(pixels: Column) -> Column:
    """Hue, saturation, intensity, luma and two chroma values of pixels of 0 to 255: array<array<array<double>>>."""

    def one(p: Column) -> Column:
        rgb = F.transform(p, lambda x: x / 255.0)
        return F.concat(N.rgb_to_hsi(rgb), N.rgb_to_ycbcr(rgb))

    return V.deep_map(pixels, 2, one)


@pandas_udf(ArrayType(DoubleType()))
def moment_hash(images: pd.Series) -> pd.Series:
    """Hu's seven moments of each channel, channel by channel, for array<array<array<double>>>."""

    def one(image) -> list[float]:
        x = np.array([[np.asarray(p, float) for p in row] for row in image])
        return np.concatenate([V.hu(x[:, :, c]) for c in range(x.shape[2])]).tolist()

    return images.map(one)


def least_squares(df: DataFrame, features: Sequence[str], label: str, ridge: float = 0.0) -> tuple[float, list[float]]:
    """(intercept, weights) from one pass of sums of products; the driver solves a system of as many rows as features."""
    names = ["_one", *features]
    held = df.withColumn("_one", F.lit(1.0))
    products = [F.sum(F.col(a).cast("double") * F.col(b).cast("double")).alias(f"p{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if j >= i]
    sums = held.agg(*products, *[F.sum(F.col(a).cast("double") * F.col(label).cast("double")).alias(f"y{i}") for i, a in enumerate(names)]).first()
    n = len(names)
    m = np.array([[sums[f"p{min(i, j)}_{max(i, j)}"] for j in range(n)] for i in range(n)]) + ridge * np.eye(n)
    w = np.linalg.lstsq(m, np.array([sums[f"y{i}"] for i in range(n)]), rcond=None)[0]
    return float(w[0]), w[1:].tolist()


def predict(features: Sequence[Column], intercept: float, weights: Sequence[float]) -> Column:
    out = F.lit(intercept)
    for c, w in zip(features, weights, strict=True):
        out = out + c * w
    return out
