"""Symmetric matrices as tables of tiles: products by block joins, and the positive part by a polynomial iteration.

A matrix is a table (i, j, a) of its tiles with i <= j, ``a`` the bytes of float64 rows. A product sends each tile to the places of
the result that need it; a task adds up one place at a time over sorted rows, so it holds three tiles whatever the size of the
matrix, and a lost executor costs its places of one product.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.stages import drop, materialize

#: Rows and columns of a tile.
TILE = 512
#: Eigenvalues below this share of the norm may keep a wrong sign: it bounds the relative error of the positive part.
SMALLEST = 1e-10
_ARROW = {"int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "binary": pa.binary()}


@dataclass(frozen=True)
class Grid:
    """How ``size`` rows are cut into tiles."""

    size: int
    tile: int = TILE

    @property
    def count(self) -> int:
        return -(-self.size // self.tile)

    def width(self, i: int) -> int:
        return min(self.tile, self.size - i * self.tile)

    def read(self, buffer: object, i: int, j: int) -> np.ndarray:
        return np.frombuffer(buffer).reshape(self.width(i), self.width(j))


def streamed(df: DataFrame, f: Callable[[Iterator[list]], Iterable[list]], schema: str) -> DataFrame:
    """``f`` over the rows of each partition, as lists of values (bytes as buffers); it yields blocks of rows as lists of columns."""
    fields = [part.split() for part in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[list]:
            for b in batches:
                raw = [pa.types.is_binary(t) or pa.types.is_large_binary(t) for t in b.schema.types]
                for k in range(b.num_rows):
                    yield [c[k].as_buffer() if r else c[k].as_py() for c, r in zip(b.columns, raw)]

        for out in f(rows()):
            yield pa.RecordBatch.from_arrays([pa.array(v, _ARROW[t]) for v, (_, t) in zip(out, fields)], names=[n for n, _ in fields])

    return df.mapInArrow(run, schema)


def gathered(df: DataFrame, keys: list[str], order: list[str], f: Callable[[tuple, Iterator[list]], Iterable[list]], schema: str) -> DataFrame:
    """``f(key, rows)`` of each group, whose rows come one after another in order; ``keys`` are the first columns."""
    n = len(keys)

    def run(rows: Iterator[list]) -> Iterator[list]:
        for key, group in groupby(rows, lambda r: tuple(r[:n])):
            yield from f(key, group)

    return streamed(df.repartition(*keys).sortWithinPartitions(*keys, *order), run, schema)


def whole(tiles: DataFrame) -> DataFrame:
    """(r, c, flip, a): the tiles of both halves; where ``flip``, ``a`` is to be transposed."""
    half = F.struct(F.col("i").alias("r"), F.col("j").alias("c"), F.lit(False).alias("flip"))
    other = F.struct(F.col("j").alias("r"), F.col("i").alias("c"), F.lit(True).alias("flip"))
    return tiles.select(F.explode(F.when(F.col("i") < F.col("j"), F.array(half, other)).otherwise(F.array(half))).alias("p"), "a").select("p.r", "p.c", "p.flip", "a")


def oriented(grid: Grid, buffer: object, r: int, c: int, flip: bool) -> np.ndarray:
    return grid.read(buffer, c, r).T if flip else grid.read(buffer, r, c)


def product(p: DataFrame, q: DataFrame, grid: Grid, alpha: float = 1.0, plus: DataFrame | None = None, beta: float = 0.0) -> DataFrame:
    """alpha p q + beta plus, for symmetric matrices whose product is symmetric too (they commute)."""
    left = whole(p).select(F.col("r").alias("i"), F.explode(F.sequence("r", F.lit(grid.count - 1))).alias("j"), F.col("c").alias("k"), F.lit(0).alias("side"), "flip", "a")
    right = whole(q).select(F.explode(F.sequence(F.lit(0), "c")).alias("i"), F.col("c").alias("j"), F.col("r").alias("k"), F.lit(1).alias("side"), "flip", "a")
    rows = left.union(right)
    if plus is not None:
        rows = rows.union(plus.select("i", "j", F.lit(-1).alias("k"), F.lit(0).alias("side"), F.lit(False).alias("flip"), "a"))

    def add(key: tuple, group: Iterator[list]) -> Iterator[list]:
        i, j = key
        total, first = np.zeros((grid.width(i), grid.width(j))), None
        for _, _, k, side, flip, a in group:
            if k < 0:
                total += beta * grid.read(a, i, j)
            elif side == 0:
                first = oriented(grid, a, i, k, flip)
            else:
                total += alpha * (first @ oriented(grid, a, k, j, flip))
        if i == j:
            total = (total + total.T) / 2
        yield [[i], [j], [total.tobytes()]]

    return gathered(rows, ["i", "j"], ["k", "side"], add, "i int, j int, a binary")


def norm(tiles: DataFrame) -> float:
    """The Frobenius norm, which bounds every eigenvalue."""

    def square(rows: Iterator[list]) -> Iterator[list]:
        for i, j, a in rows:
            yield [[(1 + (i < j)) * float(np.square(np.frombuffer(a)).sum())]]

    got = streamed(tiles.select("i", "j", "a"), square, "sq double").agg(F.sum("sq")).first()[0]
    return float(np.sqrt(got or 0.0))


def positive(b: DataFrame, grid: Grid, smallest: float = SMALLEST) -> DataFrame:
    """The positive part of a written symmetric matrix, (b + |b|) / 2 with |b| = sign(b) b.

    The matrix sign comes from the Newton-Schulz iteration s (3 - s^2) / 2, scaled in each step for the range [l, 1] that the
    absolute eigenvalues are known to fill, so that its length does not depend on the matrix: some 30 steps of two products. No
    decomposition is made. Eigenvalues below ``smallest`` of the norm count as either sign.
    """
    scale = norm(b)
    if scale == 0:
        return b
    s, c, low = b, 1 / scale, smallest
    while 1 - low > 1e-13:
        mu = float(np.sqrt(3 / (1 + low + low * low)))
        new = materialize(product(s, product(s, s, grid), grid, -0.5 * (mu * c) ** 3, s, 1.5 * mu * c), "sign")
        if s is not b:
            drop(s)
        s, c, low = new, 1.0, mu * low * (3 - mu * mu * low * low) / 2
    out = materialize(product(s, b, grid, 0.5, b, 0.5), "positive")
    drop(s)
    return out
