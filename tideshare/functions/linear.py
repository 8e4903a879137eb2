"""Small dense linear algebra inside a row: matrices are arrays of rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tideshare.functions.numbers import array_sum, let


def dot(a: Column, b: Column) -> Column:
    return array_sum(F.zip_with(a, b, lambda x, y: x * y))


def axpy(a: Column, x: Column, y: Column) -> Column:
    """``y + a x``"""
    return F.zip_with(x, y, lambda u, v: v + a * u)


def largest(a: Column) -> Column:
    """Largest absolute value."""
    return F.array_max(F.transform(a, lambda v: F.abs(v)))


def solve(matrix: Column, rhs: Column) -> Column:
    """Solutions of a positive definite system by Gauss-Jordan steps, one fold over the pivots.

    ``rhs`` holds one array of right sides per row, and so does the result. A pivot of zero gives
    nulls.
    """
    n = F.size(matrix)

    def eliminate(rows: Column, i: Column) -> Column:
        pivot = let(F.element_at(rows, i), lambda r: let(
            F.when(F.element_at(r, i) != 0, F.element_at(r, i)), lambda p: F.transform(r, lambda v: v / p)))
        return let(pivot, lambda p: F.transform(rows, lambda row, j: F.when(j == i - 1, p).otherwise(
            let(F.element_at(row, i), lambda f: F.zip_with(row, p, lambda a, b: a - f * b)))))

    whole = F.zip_with(matrix, rhs, lambda a, b: F.concat(a, b))
    return F.aggregate(F.sequence(F.lit(1), n), whole, eliminate,
                       lambda rows: F.transform(rows, lambda r: F.slice(r, n + 1, F.size(r) - n)))
