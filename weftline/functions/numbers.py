"""Number functions as column expressions; exact to the range that each states."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

# Unit names, digits, and the coefficients of ITU-R BT.601 / BT.709.
SIZE_UNITS = ("Byte", "KiB", "MiB", "GiB", "TiB", "PiB", "EiB", "ZiB", "YiB")
DIGITS = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
LUMINANCE = (0.2126, 0.7152, 0.0722)
YCBCR = ((65.481, 128.553, 24.966, 16.0), (-37.797, -74.203, 112.0, 128.0), (112.0, -93.786, -18.214, 128.0))


def reciprocal(c: Column) -> Column:
    return F.lit(1.0) / c


def min_max(a: Column, b: Column) -> Column:
    """struct(low, high)."""
    return F.struct(F.least(a, b).alias("low"), F.greatest(a, b).alias("high"))


def clamp(c: Column, low: float = 0, high: float = 1) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def luminance(r: Column, g: Column, b: Column) -> Column:
    return r * LUMINANCE[0] + g * LUMINANCE[1] + b * LUMINANCE[2]


def multinomial(ks: Column) -> Column:
    """(sum of ks)! / product of k! as a double; every factor is a whole number, so results below 2**53 are exact."""

    def grow(acc: Column, k: Column) -> Column:
        places = F.filter(F.sequence(F.lit(0).cast("long"), F.greatest(k.cast("long"), F.lit(0).cast("long"))), lambda j: j > 0)
        value = F.aggregate(places, acc["v"], lambda v, j: F.round(v * (acc["n"] + j) / j))
        return F.struct((acc["n"] + k.cast("long")).alias("n"), value.alias("v"))

    return F.aggregate(ks, F.struct(F.lit(0).cast("long").alias("n"), F.lit(1.0).alias("v")), grow, lambda a: a["v"])


def unique_permutations(word: Column) -> Column:
    """Number of distinct orders of a word's characters."""
    chars = F.filter(F.split(word, ""), lambda c: c != "")
    return multinomial(F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda x: x == c)).cast("long")))


def fibonacci(n: Column) -> Column:
    """The n-th number from 0, 1, 1, 2 on, exact up to n = 182."""
    big = "decimal(38,0)"
    start = F.struct(F.lit(0).cast(big).alias("a"), F.lit(1).cast(big).alias("b"))
    steps = F.filter(F.sequence(F.lit(0), n.cast("int")), lambda i: i > 0)
    return F.aggregate(steps, start, lambda s, _: F.struct(s["b"].alias("a"), (s["a"] + s["b"]).cast(big).alias("b")), lambda s: s["a"])


def fibonacci_numbers(spark: SparkSession, count: int) -> DataFrame:
    """n, value of the first numbers."""
    return spark.range(count).select(F.col("id").alias("n"), fibonacci(F.col("id")).alias("value"))


def halvings(n: Column) -> Column:
    """n, n // 2, n // 4 and so on while positive."""
    return F.filter(F.transform(F.sequence(F.lit(0), F.lit(62)), lambda i: _div_power(n, i)), lambda x: x > 0)


def _div_power(n: Column, i: Column) -> Column:
    return F.call_function("shiftright", n.cast("long"), i)


def is_power(n: Column, base: int) -> Column:
    """Whether n is base to a power of one or more."""
    if base < 2:
        raise ValueError("base must be 2 or more")
    left = F.aggregate(F.sequence(F.lit(1), F.lit(63)), n.cast("long"), lambda a, _: F.when((a > 1) & (a % base == 0), _div(a, base)).otherwise(a))
    return F.when(n <= 0, F.raise_error(F.lit("n must be positive"))).otherwise((n > 1) & (left == 1))


def byte_size(c: Column) -> Column:
    """struct(value, unit) in powers of 1024."""
    x = c.cast("double")
    k = F.size(F.filter(F.sequence(F.lit(1), F.lit(len(SIZE_UNITS))), lambda i: x >= F.pow(F.lit(1024.0), i)))
    units = F.array(*[F.lit(u) for u in SIZE_UNITS])
    return F.struct((x / F.pow(F.lit(1024.0), k)).alias("value"), F.get(units, F.least(k, F.lit(len(SIZE_UNITS) - 1))).alias("unit"))


def byte_size_text(c: Column, places: int = 3) -> Column:
    s = byte_size(c)
    return F.when(s["unit"] == SIZE_UNITS[0], F.format_string("%.0f %s", s["value"], s["unit"])).otherwise(F.format_string(f"%.{places}f %s", s["value"], s["unit"]))


def primes(spark: SparkSession, stop: int) -> DataFrame:
    """n: primes below stop; composites are generated from their divisors and taken away by an anti join."""
    root = int(max(stop, 0) ** 0.5) + 1
    multiples = spark.range(2, root + 1).where(F.col("id") * F.col("id") < stop).select(F.explode(F.sequence(F.col("id") * F.col("id"), F.lit(stop - 1), F.col("id"))).alias("n"))
    return spark.range(2, max(stop, 2)).select(F.col("id").alias("n")).join(multiples, "n", "left_anti")


def triangle_number(n: Column) -> Column:
    return F.shiftright(n * (n + 1), 1)


def digit_sum(n: Column) -> Column:
    return digit_sum_base(n.cast("string"), 10)


def digit_sum_base(text: Column, base: int) -> Column:
    """Sum of the digits of a number written in a base up to 36."""
    digits = F.filter(F.split(F.lower(text), ""), lambda c: c != "")
    return F.aggregate(digits, F.lit(0).cast("long"), lambda s, c: s + F.conv(c, base, 10).cast("long"))


def to_base(n: Column, base: int) -> Column:
    """n written in a base from 2 to 62, lower case before upper case."""
    if not 2 <= base <= len(DIGITS):
        raise ValueError(f"base must be from 2 to {len(DIGITS)}")
    start = F.struct(F.abs(n.cast("long")).alias("rest"), F.lit("").alias("text"))

    def step(s: Column, _: Column) -> Column:
        digit = F.substr(F.lit(DIGITS), (s["rest"] % base + 1).cast("int"), F.lit(1))
        return F.struct(_div(s["rest"], base).alias("rest"), F.when(s["rest"] > 0, F.concat(digit, s["text"])).otherwise(s["text"]).alias("text"))

    text = F.aggregate(F.sequence(F.lit(1), F.lit(63)), start, step, lambda s: s["text"])
    return F.when(n == 0, F.lit(DIGITS[0])).when(n < 0, F.concat(F.lit("-"), text)).otherwise(text)


def _div(a: Column, b: int) -> Column:
    """Whole division of longs without a detour over doubles."""
    return F.call_function("div", a, F.lit(b).cast("long"))


def factorial(n: Column) -> Column:
    """n!, exact up to n = 33."""
    big = "decimal(38,0)"
    steps = F.filter(F.sequence(F.lit(0), n.cast("int")), lambda i: i > 0)
    return F.aggregate(steps, F.lit(1).cast(big), lambda a, i: (a * i.cast("decimal(4,0)")).cast(big))


def ceil_div(a: Column, b: Column) -> Column:
    return F.ceil(a / b).cast("long")


def integer_root(n: Column) -> Column:
    """The largest r with r * r <= n, for n below 2**62."""
    r = F.floor(F.sqrt(n.cast("double"))).cast("long")
    return F.when(r * r > n, r - 1).when((r + 1) * (r + 1) <= n, r + 1).otherwise(r)


def product(values: Column, start: float = 1) -> Column:
    return F.aggregate(values, F.lit(float(start)), lambda a, x: a * x)


def rgb_to_ycbcr(rgb: Column) -> Column:
    """Digital Y'CbCr (0 to 255) of an array of three values from 0 to 1."""
    return F.array(*[rgb[0] * a + rgb[1] * b + rgb[2] * c + d for a, b, c, d in YCBCR])


def rgb_to_hsi(rgb: Column) -> Column:
    """Hue (radians), saturation and intensity of an array of three values from 0 to 1; hue and saturation of greys are 0."""
    r, g, b = (rgb[i].cast("double") for i in range(3))
    across = F.sqrt((r - g) * (r - g) + (r - b) * (g - b))
    theta = F.acos(clamp(F.try_divide(r - (g + b) / 2, across), -1.0, 1.0))
    intensity = (r + g + b) / 3
    hue = F.when(across == 0, F.lit(0.0)).when(b <= g, theta).otherwise(2 * F.pi() - theta)
    return F.array(hue, F.coalesce(1 - F.try_divide(F.least(r, g, b), intensity), F.lit(0.0)), intensity)


def rectangle_ratio(corners: np.ndarray, center: np.ndarray, focal: float | None = None) -> float:
    """Ratio of a rectangle's sides, seen in perspective, after Zhang and He, "Whiteboard scanning and image enhancement" (2007).

    corners: in pixels, one way round; the side from the first to the last is divided by that from the first to the second. center: the principal point. The rectangle's two directions are
    the kernels that make its corners meet: scales s of the corners' rays with s0 r0 - s1 r1 + s2 r2 - s3 r3 = 0 give its sides
    s1 r1 - s0 r0 and s3 r3 - s0 r0 in the camera's frame, up to the focal length, which follows from their right angle.
    """
    rays = np.column_stack([np.asarray(corners, float) - center, np.ones(4)])
    scale = np.append(1.0, np.linalg.solve(np.column_stack([rays[1], -rays[2], rays[3]]), rays[0]))
    across, down = scale[1] * rays[1] - scale[0] * rays[0], scale[3] * rays[3] - scale[0] * rays[0]
    if np.allclose([across[2], down[2]], 0, atol=1e-8):  # seen straight on
        return float(np.linalg.norm(down[:2]) / np.linalg.norm(across[:2]))
    square = focal * focal if focal else -(across[:2] @ down[:2]) / (across[2] * down[2])
    ratio = (down[:2] @ down[:2] + square * down[2] ** 2) / (across[:2] @ across[:2] + square * across[2] ** 2)
    return float(np.sqrt(ratio)) if ratio >= 0 else -1.0


@pandas_udf(DoubleType())
def rectangle_ratios(corners: pd.Series, center: pd.Series) -> pd.Series:
    """Column form: corners is an array of eight numbers, center of two."""
    return pd.Series([rectangle_ratio(np.asarray(c, float).reshape(4, 2), np.asarray(p, float)) for c, p in zip(corners, center, strict=True)])
