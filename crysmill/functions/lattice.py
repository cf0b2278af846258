"""3x3 lattice algebra as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def at(m: Column, i: int, j: int) -> Column:
    return F.get(F.get(m, i), j)


def determinant(m: Column) -> Column:
    a = lambda i, j: at(m, i, j)
    return a(0, 0) * (a(1, 1) * a(2, 2) - a(1, 2) * a(2, 1)) - a(0, 1) * (a(1, 0) * a(2, 2) - a(1, 2) * a(2, 0)) + a(0, 2) * (a(1, 0) * a(2, 1) - a(1, 1) * a(2, 0))


def volume(m: Column) -> Column:
    """Volume of a full 3x3 cell, null where it has none."""
    v = F.abs(determinant(m))
    full = (F.size(m) == 3) & F.forall(m, lambda r: r.isNotNull() & (F.size(r) == 3))
    return F.when(full & (v > 1e-9) & ~F.isnan(v), v)


def cross(m: Column, i: int, j: int) -> list[Column]:
    return [at(m, i, (k + 1) % 3) * at(m, j, (k + 2) % 3) - at(m, i, (k + 2) % 3) * at(m, j, (k + 1) % 3) for k in range(3)]


def inverse(m: Column) -> Column:
    """Inverse of a 3x3 matrix (rows are vectors); null where it is singular."""
    d = determinant(m)
    cof = [cross(m, 1, 2), cross(m, 2, 0), cross(m, 0, 1)]
    return F.when(F.abs(d) > 1e-12, F.array(*[F.array(*[cof[j][i] / d for j in range(3)]) for i in range(3)]))


def cosines(m: Column) -> list[Column]:
    """|cos| of the three angles between the vectors."""

    def dot(i: int, j: int) -> Column:
        return sum((at(m, i, k) * at(m, j, k) for k in range(1, 3)), at(m, i, 0) * at(m, j, 0))

    return [F.abs(dot(i, j)) / F.sqrt(dot(i, i) * dot(j, j)) for i, j in ((1, 2), (0, 2), (0, 1))]
