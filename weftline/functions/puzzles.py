"""Sudoku boards as arrays of whole numbers, 0 for an open cell."""

from __future__ import annotations

from math import isqrt

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, IntegerType


def solve(board: list[int]) -> list[int] | None:
    """Exact cover by masks: the open cell with the fewest candidates is tried first."""
    side = isqrt(len(board))
    box = isqrt(side)
    full = (1 << side) - 1
    units = [(r, c, r // box * box + c // box) for r in range(side) for c in range(side)]
    used = [[0] * side for _ in range(3)]
    for cell, v in enumerate(board):
        if v:
            bit = 1 << (v - 1)
            for k, u in enumerate(units[cell]):
                if used[k][u] & bit:
                    return None
                used[k][u] |= bit
    out = list(board)

    def search() -> bool:
        best, choice = side + 1, None
        for cell, v in enumerate(out):
            if not v:
                r, c, b = units[cell]
                free = full & ~(used[0][r] | used[1][c] | used[2][b])
                if free.bit_count() < best:
                    best, choice = free.bit_count(), (cell, free)
        if choice is None:
            return True
        cell, free = choice
        while free:
            bit = free & -free
            free ^= bit
            out[cell] = bit.bit_length()
            for k, u in enumerate(units[cell]):
                used[k][u] |= bit
            if search():
                return True
            for k, u in enumerate(units[cell]):
                used[k][u] &= ~bit
            out[cell] = 0
        return False

    return out if search() else None


@pandas_udf(ArrayType(IntegerType()))
def solved(boards: pd.Series) -> pd.Series:
    """The first solution, or null."""
    return boards.map(lambda b: solve([int(x) for x in b]))


def is_valid(board: Column, side: int = 9) -> Column:
    """Whether every row, column and box holds each symbol once."""
    box = isqrt(side)
    places = [[r * side + c for c in range(side)] for r in range(side)]
    places += [[r * side + c for r in range(side)] for c in range(side)]
    places += [[(y + r) * side + x + c for r in range(box) for c in range(box)] for y in range(0, side, box) for x in range(0, side, box)]
    want = F.array(*[F.lit(v) for v in range(1, side + 1)])
    out = F.size(board) == side * side
    for unit in places:
        out = out & (F.array_sort(F.array(*[F.get(board, k) for k in unit])) == want)
    return F.coalesce(out, F.lit(False))
