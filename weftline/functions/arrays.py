"""Vector, matrix and nested-array functions on array columns.

Everything that a fold or a zip can say stays in the JVM. Eigenvectors, triangular systems, assignment, Viterbi paths and
image moments are NumPy on Arrow batches, one row a problem.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, DoubleType, IntegerType


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def inner(a: Column, b: Column) -> Column:
    """Dot product over the shorter length."""
    n = F.least(F.size(a), F.size(b))
    return total(F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(inner(a, a))


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(inner(a, b), norm(a) * norm(b))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), 2))))


def outer(a: Column, b: Column) -> Column:
    return F.transform(a, lambda x: F.transform(b, lambda y: x.cast("double") * y.cast("double")))


def mat_vec(m: Column, v: Column) -> Column:
    return F.transform(m, lambda row: inner(row, v))


def quadratic(m: Column, v: Column) -> Column:
    """v' M v."""
    return inner(v, mat_vec(m, v))


def log_trace(m: Column) -> Column:
    return total(F.transform(m, lambda row, i: F.ln(F.get(row, i))))


def histogram_correlation(a: Column, b: Column) -> Column:
    """Pearson correlation of two histograms of one size; flat ones raise."""

    def centered(h: Column) -> Column:
        return F.transform(h, lambda v: v - total(h) / F.size(h))

    x, y = centered(a), centered(b)
    scale = F.sqrt(inner(x, x) * inner(y, y))
    return F.when(F.size(a) != F.size(b), F.raise_error(F.lit("histograms differ in size"))).when(scale == 0, F.raise_error(F.lit("a histogram is flat"))).otherwise(inner(x, y) / scale)


def hamming(a: Column, b: Column) -> Column:
    """Places where two arrays differ."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: ~x.eqNullSafe(y)), lambda d: d)).cast("long")


def sign_planes(values: Column, dimensions: int) -> list[Column]:
    """The signs of so many places of an array of numbers as three bits a place (0 or NaN, above 0 or NaN, below 0; none: null), 64 places a long: columns."""
    sign = lambda i: F.signum(F.get(values, F.lit(i)))
    planes = (lambda x: (x == 0) | F.isnan(x), lambda x: (x > 0), lambda x: (x < 0))
    bit = lambda plane, i: F.when(plane(sign(i)), F.lit(1 << (i % 64) if i % 64 < 63 else -(1 << 63)).cast("long")).otherwise(F.lit(0).cast("long"))
    out = []
    for at in range(0, dimensions, 64):
        for plane in planes:
            bits = [bit(plane, i) for i in range(at, min(at + 64, dimensions))]
            out.append(reduce(lambda a, b: a.bitwiseOR(b), bits))
    return out


def differing_planes(a: list[Column], b: list[Column]) -> Column:
    """Places at which two rows' sign planes differ."""
    apart = [x.bitwiseXOR(y) for x, y in zip(a, b, strict=True)]
    counts = [F.bit_count(reduce(lambda u, v: u.bitwiseOR(v), apart[i : i + 3])) for i in range(0, len(apart), 3)]
    return reduce(lambda u, v: u + v, counts, F.lit(0)).cast("long")


def hamming_packed(a: Column, b: Column) -> Column:
    """Differing bits of arrays of whole numbers."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, n: s + n).cast("long")


def scatter(mask: Column, data: Column, default: Column) -> Column:
    """The k-th datum in the k-th true place, default elsewhere."""
    rank = lambda i: F.size(F.filter(F.slice(mask, F.lit(1), i + 1), lambda m: m))
    return F.transform(mask, lambda m, i: F.when(m, F.get(data, rank(i) - 1)).otherwise(default))


def length_mask(length: Column, most: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: i < length)


def top_k(values: Column, k: int, largest: bool = False) -> Column:
    """array<struct(value, index)> of the k smallest (or largest); of ties the lower index first."""
    if k < 1:
        raise ValueError("k must be 1 or more")
    keyed = F.transform(values, lambda v, i: F.struct((-v if largest else v).alias("o"), i.alias("index"), v.alias("value")))
    return F.transform(F.slice(F.array_sort(keyed), 1, k), lambda s: F.struct(s["value"].alias("value"), s["index"].alias("index")))


def stochastic(values: Column) -> Column:
    """Values over the sum of their absolutes; zeros alone raise."""
    whole = total(F.transform(values, F.abs))
    return F.when(whole == 0, F.raise_error(F.lit("a row of zeros"))).otherwise(F.transform(values, lambda v: v / whole))


def shifted_exp(values: Column) -> Column:
    top = F.array_max(values)
    return F.transform(values, lambda v: F.exp(v - top))


def split_blocks(m: Column, height: int, width: int) -> Column:
    """Blocks of a matrix, row by row, each flattened: array<array>."""
    rows, cols = F.size(m), F.size(F.get(m, 0))
    ok = (rows % height == 0) & (cols % width == 0)
    down, across = F.sequence(F.lit(0), (rows / height).cast("int") - 1), F.sequence(F.lit(0), (cols / width).cast("int") - 1)
    blocks = F.flatten(F.transform(down, lambda y: F.transform(across, lambda x: F.flatten(F.transform(F.slice(m, y * height + 1, height), lambda row: F.slice(row, x * width + 1, width))))))
    return F.when(ok, blocks).otherwise(F.raise_error(F.lit("the matrix does not divide into blocks")))


def join_blocks(blocks: Column, per_row: int, height: int, width: int) -> Column:
    """The inverse of split_blocks."""
    rows = F.sequence(F.lit(0), (F.size(blocks) / per_row * height).cast("int") - 1)

    def row(y: Column) -> Column:
        first = (F.floor(y / height) * per_row).cast("int")
        return F.flatten(F.transform(F.slice(blocks, first + 1, per_row), lambda b: F.slice(b, (y % height) * width + 1, width)))

    return F.transform(rows, row)


def windows_2d(m: Column, height: int, width: int, step_y: int = 1, step_x: int = 1) -> Column:
    """array<struct(y, x, window)> of all windows, row by row."""
    last_y, last_x = F.size(m) - height, F.size(F.get(m, 0)) - width

    def places(last: Column, step: int) -> Column:
        return F.when(last >= 0, F.sequence(F.lit(0), last, F.lit(step))).otherwise(F.array().cast("array<int>"))

    cut = lambda y, x: F.transform(F.slice(m, y + 1, height), lambda row: F.slice(row, x + 1, width))
    return F.flatten(F.transform(places(last_y, step_y), lambda y: F.transform(places(last_x, step_x), lambda x: F.struct(y.alias("y"), x.alias("x"), cut(y, x).alias("window")))))


def deep_map(values: Column, depth: int, f: Callable[[Column], Column]) -> Column:
    """f at the leaves of arrays nested `depth` deep."""
    return F.transform(values, f if depth == 1 else lambda v: deep_map(v, depth - 1, f))


def outer_fold(values: Column, depth: int, f: Callable[[Column], Column]) -> Column:
    """f over the innermost arrays, then over the arrays of its results, outwards."""
    return f(values if depth == 1 else F.transform(values, lambda v: outer_fold(v, depth - 1, f)))


def map_chain(values: Column, functions: Sequence[Callable[[Column], Column]]) -> Column:
    """All functions, one after the other, on each element."""
    for f in functions:
        values = F.transform(values, f)
    return values


def zip_map(functions: Sequence[Callable[[Column], Column]], values: Column) -> Column:
    """The k-th function on the k-th element."""
    return F.array(*[f(F.get(values, k)) for k, f in enumerate(functions)])


def star_map(pairs: Column, f: Callable[[Column, Column], Column]) -> Column:
    """f over the first two fields of structs."""
    return F.transform(pairs, lambda p: f(p["a"], p["b"]))


def powerset(values: Column) -> Column:
    """All subsets of an array of at most 16 elements, smallest first, in order of places."""
    bits = F.sequence(F.lit(0), F.call_function("shiftleft", F.lit(1), F.size(values)) - 1)
    has = lambda s, i: F.call_function("shiftright", s, i).bitwiseAND(F.lit(1)) == 1
    places = F.sequence(F.lit(0), F.greatest(F.size(values) - 1, F.lit(0)))
    sets = F.transform(bits, lambda s: F.struct(F.bit_count(s).alias("n"), F.filter(places, lambda i: has(s, i)).alias("at")))
    return F.transform(F.array_sort(sets), lambda s: F.transform(s["at"], lambda i: F.get(values, i)))


# ---- dense linear algebra, one problem a row


def _matrix(x) -> np.ndarray:
    return np.array([np.asarray(r, float) for r in x])


@pandas_udf(ArrayType(ArrayType(DoubleType())))
def stationary(matrices: pd.Series) -> pd.Series:
    """The limit of the powers of a right stochastic matrix with one closed class: every row is the stationary vector."""

    def one(x):
        m = _matrix(x)
        if not np.allclose(m.sum(axis=1), 1):
            raise ValueError("not a right stochastic matrix")
        n = len(m)
        system = np.vstack([m.T - np.eye(n), np.ones(n)])
        v = np.linalg.lstsq(system, np.r_[np.zeros(n), 1.0], rcond=None)[0]
        return np.tile(v, (n, 1)).tolist()

    return matrices.map(one)


def viterbi(emit: Sequence[np.ndarray], trans: Sequence[np.ndarray]) -> list[int]:
    """States of the best path; one emission vector a step and one matrix a transition, of any sizes. Of ties the lower state."""
    score, back = np.asarray(emit[0], float), []
    for e, t in zip(emit[1:], trans, strict=True):
        reach = score[:, None] + t
        back.append(reach.argmax(axis=0))
        score = reach.max(axis=0) + e
    path = [int(score.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


@pandas_udf(ArrayType(IntegerType()))
def viterbi_path(emit: pd.Series, trans: pd.Series, first: pd.Series) -> pd.Series:
    """emit array<array> (steps, states), trans array<array>, first array: additive scores."""

    def one(e, t, f):
        rows, m = [np.asarray(r, float) for r in e], _matrix(t)
        if not rows:
            return []
        rows[0] = rows[0] + np.asarray(f, float)
        return viterbi(rows, [m] * (len(rows) - 1))

    return pd.Series([one(*x) for x in zip(emit, trans, first, strict=True)])


@pandas_udf(ArrayType(IntegerType()))
def viterbi_ragged(emit: pd.Series, trans: pd.Series) -> pd.Series:
    """emit array<array> of any widths, trans array<array<array>> between them."""
    return pd.Series([viterbi([np.asarray(r, float) for r in e], [_matrix(m) for m in t]) for e, t in zip(emit, trans, strict=True)])


def assignment(cost: np.ndarray) -> float:
    """Least total of a matching of rows to columns, by shortest augmenting paths with potentials."""
    cost = cost if len(cost) <= len(cost[0]) else cost.T
    n, m = cost.shape
    owner, row_price, col_price = np.full(m, -1), np.zeros(n), np.zeros(m)
    for free in range(n):
        reach, via, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
        row, column = free, -1
        while row >= 0:
            if column >= 0:
                done[column] = True
            slack = cost[row] - row_price[row] - col_price
            better = ~done & (slack < reach)
            reach[better], via[better] = slack[better], column
            column = int(np.where(done, np.inf, reach).argmin())
            step = reach[column]
            row_price[free] += step
            row_price[owner[done]] += step
            col_price[done] -= step
            reach[~done] -= step
            row = int(owner[column])
        while column >= 0:  # flip the path
            before = int(via[column])
            owner[column] = free if before < 0 else owner[before]
            column = before
    taken = np.flatnonzero(owner >= 0)
    return float(cost[owner[taken], taken].sum())


@pandas_udf(DoubleType())
def assignment_cost(costs: pd.Series) -> pd.Series:
    return costs.map(lambda c: assignment(_matrix(c)))


def _substituted(m: np.ndarray, v: np.ndarray, order: range) -> np.ndarray:
    """The solution by substitution, one unknown after the other in the given order: n steps of one product each."""
    x = np.zeros(len(v))
    for i in order:
        x[i] = (v[i] - m[i] @ x) / m[i, i]
    return x


@pandas_udf(ArrayType(DoubleType()))
def solve_lower(matrices: pd.Series, vectors: pd.Series) -> pd.Series:
    """Solutions of lower triangular systems by forward substitution; what stands above the diagonal is not read."""
    return pd.Series([_substituted(np.tril(_matrix(m)), np.asarray(v, float), range(len(v))).tolist() for m, v in zip(matrices, vectors, strict=True)])


@pandas_udf(ArrayType(DoubleType()))
def solve_upper(matrices: pd.Series, vectors: pd.Series) -> pd.Series:
    """Solutions of upper triangular systems by backward substitution."""
    return pd.Series([_substituted(np.triu(_matrix(m)), np.asarray(v, float), range(len(v) - 1, -1, -1)).tolist() for m, v in zip(matrices, vectors, strict=True)])


def rotated(factor: np.ndarray, vector: np.ndarray, sign: float) -> np.ndarray:
    """The factor of L L' + sign * x x' by n plane rotations (sign 1) or hyperbolic ones (sign -1), each of which takes one entry of x into a column: O(n^2)."""
    low, x = np.tril(factor).astype(float), np.array(vector, float)
    for k in range(len(x)):
        square = low[k, k] ** 2 + sign * x[k] ** 2
        if square <= 0:
            raise ValueError("the downdated matrix is not positive definite")
        cos, sin = low[k, k] / np.sqrt(square), x[k] / np.sqrt(square)
        low[k:, k], x[k:] = cos * low[k:, k] + sign * sin * x[k:], cos * x[k:] - sin * low[k:, k]
    return low


@pandas_udf(ArrayType(ArrayType(DoubleType())))
def cholesky_update(factors: pd.Series, vectors: pd.Series, signs: pd.Series) -> pd.Series:
    """Column form of :func:`rotated`."""
    return pd.Series([rotated(_matrix(m), np.asarray(x, float), s).tolist() for m, x, s in zip(factors, vectors, signs, strict=True)])


def above_all() -> Column:
    """A number above every whole number."""
    return F.lit(float("inf"))


def random_triangular(key: Column, size: int, lower: Column | bool = True, seed: int = 0) -> Column:
    """A size * size matrix of numbers above 0 and below 1 on and below (or above) the diagonal, drawn by a seeded hash of the key and the place; zeros elsewhere."""
    side = F.sequence(F.lit(0), F.lit(size - 1))
    lower = F.lit(lower) if isinstance(lower, bool) else lower
    draw = lambda i, j: (F.pmod(F.xxhash64(F.lit(seed), key, i, j), F.lit((1 << 53) - 1)) + 1).cast("double") / (1 << 53)
    return F.transform(side, lambda i: F.transform(side, lambda j: F.when((i == j) | ((i > j) == lower), draw(i, j)).otherwise(F.lit(0.0))))


# ---- images as arrays of rows


def gray(pixels: Column) -> Column:
    """Whole-number mean of each pixel's channels, for array<array<array<int>>>."""
    return deep_map(pixels, 2, lambda p: F.floor(F.aggregate(p, F.lit(0).cast("long"), lambda s, x: s + x) / F.size(p)).cast("int"))


def histogram(values: Column, levels: int) -> Column:
    """Counts of the levels 0 to levels - 1 in one pass over a sorted copy."""
    held = F.array_sort(values)
    upto = lambda v: F.size(F.filter(held, lambda x: x <= v)).cast("long")
    return F.transform(F.sequence(F.lit(0), F.lit(levels - 1)), lambda v: upto(v) - upto(v - 1))


def block_mean_bits(m: Column, per_side: int) -> Column:
    """Bits as '0' and '1': whether the mean of each of per_side * per_side blocks is the median of the means at least."""
    rows, cols = F.size(m), F.size(F.get(m, 0))
    height, width = (rows / per_side).cast("int"), (cols / per_side).cast("int")
    side = F.sequence(F.lit(0), F.lit(per_side - 1))
    area = lambda y, x: F.flatten(F.transform(F.slice(m, y * height + 1, height), lambda row: F.slice(row, x * width + 1, width)))
    means = F.flatten(F.transform(side, lambda y: F.transform(side, lambda x: F.aggregate(area(y, x), F.lit(0.0), lambda s, v: s + v) / (height * width))))
    ordered, n = F.array_sort(means), per_side * per_side
    median = (F.get(ordered, F.lit((n - 1) // 2)) + F.get(ordered, F.lit(n // 2))) / 2
    return F.array_join(F.transform(means, lambda v: F.when(v >= median, F.lit("1")).otherwise(F.lit("0"))), "")


def hu(image: np.ndarray) -> np.ndarray:
    """Hu's seven moment invariants of one channel, from complex moments c(p, q) of the normalised image."""
    w = np.asarray(image, float)
    mass = w.sum()
    if mass <= 0:
        raise ValueError("an image without mass")
    y, x = np.mgrid[: w.shape[0], : w.shape[1]]
    z = (x - (w * x).sum() / mass) + 1j * (y - (w * y).sum() / mass)
    c = lambda p, q: (z**p * np.conj(z) ** q * w).sum() / mass ** ((p + q) / 2 + 1)
    c11, c20, c21, c30 = c(1, 1).real, c(2, 0), c(2, 1), c(3, 0)
    lift = c30 * np.conj(c21) ** 3
    turn = c20 * np.conj(c21) ** 2
    return np.array([c11, abs(c20) ** 2, abs(c30) ** 2, abs(c21) ** 2, lift.real, turn.real, lift.imag])


@pandas_udf(ArrayType(DoubleType()))
def hu_moments(images: pd.Series) -> pd.Series:
    return images.map(lambda m: hu(_matrix(m)).tolist())
