"""Exact similarity join of unit vectors: all pairs of a layer whose correlation is at least c or at most -c.

Vectors and their opposites are one direction. A bounded number of directions, the pivots, cut a layer into cells: each vector belongs to the
pivot that is nearest by angle, and a cell's radius is its largest angle. By the triangle inequality a vector can only be within
``acos(c)`` of members of a cell whose pivot is within ``acos(c)`` plus the cell's radius, so it visits those cells and no other. Of
two cells only members of the first visit the other, so every pair is made once. Visitors and members of a cell meet in
pairs of blocks of at most BLOCK rows, so a cell of any size, also of equal vectors, is many tasks.

Nodes of one series can travel as one row with the list of their names (:func:`classes`); then pairs of rows stand for all pairs of their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.series import units
from ..plans.stages import materialize

#: Pivots of a layer, at most; rows of a block; angle by which rounding may be off.
PIVOTS, BLOCK, SLACK = 512, 2048, 1e-7
#: Names in a row of equal series, about; names of a block; names of a task, about: as many fit the dictionary of a Parquet column.
LIST, NAMES, TASK = 256, 16384, 65536
_NODES = ", nodes array<string>"


def _vectors(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _angles(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.minimum(np.abs(x @ pivots.T), 1.0))


def _by_layer(batch: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray]]:
    layer = np.asarray(batch.column("layer").to_pylist(), object)
    for name in sorted(set(layer.tolist())):
        yield name, np.flatnonzero(layer == name)


def classes(packed: DataFrame, size: int = LIST) -> DataFrame:
    """(layer, node, u, nodes): nodes of equal series v, dealt to rows of about ``size`` names each; node is the first of them.

    Units are made behind the shuffle: values as measured take fewer bytes. Series of one hash count as one where lists are cut.
    """
    packed = packed.select("layer", "node", "v", F.xxhash64("v").alias("h"))
    often = packed.groupBy("layer", "h").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > size)
    packed = packed.join(F.broadcast(often), ["layer", "h"], "left")  # at most one row for each ``size`` nodes
    part = F.coalesce(F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / size)), F.lit(0))
    rows = packed.groupBy("layer", "v", part.alias("part")).agg(F.min("node").alias("node"), F.collect_list("node").alias("nodes"))
    return units(rows).filter("u is not null").select("layer", "node", "u", "nodes")


def _rest(packed: DataFrame) -> list[str]:
    return [c for c in packed.columns if c == "nodes"]


def cells(packed: DataFrame) -> tuple[DataFrame, dict[str, np.ndarray], dict[str, np.ndarray]]:
    """(layer, node, u, cell, and nodes where there are) written; pivots and radii of each layer's cells. Pivots are vectors with the least hash, about sqrt(n) of a layer."""
    rest = _rest(packed)
    packed = packed.filter("u is not null").select("layer", "node", "u", *rest)
    n = {r.layer: r.n for r in packed.groupBy("layer").agg(F.count(F.lit(1)).alias("n")).collect()}
    want = {k: min(PIVOTS, math.isqrt(v) + 1) for k, v in n.items()}
    hashed = F.pmod(F.xxhash64("node"), F.lit(1 << 30))
    share = F.coalesce(F.element_at(F.create_map(*(x for k in n for x in (F.lit(k), F.lit(2 * want[k] / n[k])))), F.col("layer")), F.lit(0.0)) if n else F.lit(0.0)
    few = packed.filter(hashed < share * (1 << 30)).select("layer", "u", hashed.alias("h"), "node").collect()
    pivots = {}
    for layer in n:
        own = [np.array(r.u) for r in sorted((r for r in few if r.layer == layer), key=lambda r: (r.h, r.node))[: want[layer]]]
        pivots[layer] = np.array(own) if own else np.zeros((0, 0))
    for layer in [k for k, v in pivots.items() if not len(v)]:  # a small layer that the share of hashes has missed
        pivots[layer] = np.array([packed.filter(F.col("layer") == layer).first().u])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, cell, angle = _vectors(b.column("u")), np.zeros(b.num_rows, np.int32), np.zeros(b.num_rows)
            for layer, at in _by_layer(b):
                a = _angles(x[at], pivots[layer])
                cell[at], angle[at] = a.argmin(1), a.min(1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell), pa.array(angle)], names=[*b.schema.names, "cell", "angle"])

    dealt = materialize(packed.mapInArrow(assign, f"layer string, node string, u array<double>{_NODES if rest else ''}, cell int, angle double"), "cells")
    radius = {k: np.full(len(v), -math.inf) for k, v in pivots.items()}
    for r in dealt.groupBy("layer", "cell").agg(F.max("angle").alias("r")).collect():
        radius[r.layer][r.cell] = r.r
    return dealt.select("layer", "node", "u", "cell", *rest), pivots, radius


def visits(dealt: DataFrame, pivots: dict[str, np.ndarray], radius: dict[str, np.ndarray], least: float) -> DataFrame:
    """(layer, node, u, own, cell, and nodes where there are): each vector at its own and every later cell that may hold one with abs(c) of at least ``least``."""
    reach, rest = math.acos(min(least, 1.0)) + SLACK, _rest(dealt)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, own = _vectors(b.column("u")), np.asarray(b.column("cell"))
            to: list = [None] * b.num_rows
            for layer, at in _by_layer(b):
                near = _angles(x[at], pivots[layer]) <= reach + radius[layer][None]
                near &= np.arange(near.shape[1])[None] >= own[at][:, None]
                for i, row in zip(at, near):
                    to[i] = np.flatnonzero(row)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("layer", "node", "u", *rest, "cell")), pa.array(to, pa.list_(pa.int32()))], names=["layer", "node", "u", *rest, "own", "to"])

    return dealt.mapInArrow(run, f"layer string, node string, u array<double>{_NODES if rest else ''}, own int, to array<int>").select("layer", "node", "u", "own", F.explode("to").alias("cell"), *rest)


def candidate_pairs(packed: DataFrame, least: float, block: int = BLOCK) -> DataFrame:
    """(layer, m, x, n, y): every pair that the cells do not rule out, once; names m and n, vectors x and y.

    Rows of :func:`classes` also meet themselves and give their names as ms and ns.
    """
    rest = _rest(packed)
    dealt, pivots, radius = cells(packed)
    left = visits(dealt, pivots, radius, least)  # not written: what is dealt out below is the same once more
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / block), F.ceil(F.sum(F.size("nodes")) / NAMES) if rest else F.lit(1)).cast("int")
    names = F.sum(F.size("nodes") if rest else F.lit(1))
    size = dealt.groupBy("layer", "cell").agg(blocks.alias("rights"), names.alias("nr")).join(left.groupBy("layer", "cell").agg(blocks.alias("lefts"), names.alias("nl")), ["layer", "cell"])
    size = materialize(size, "blocks")  # at most PIVOTS rows a layer
    tasks = size.agg(F.ceil(F.sum(F.expr("nl * rights + nr * lefts")) / TASK)).first()[0] or 1
    size = F.broadcast(size.drop("nl", "nr"))
    salt = lambda node, of: F.pmod(F.xxhash64(node, F.lit(7)), F.col(of)).cast("int")
    a = left.join(size, ["layer", "cell"]).select("layer", "cell", salt("node", "lefts").alias("lb"), F.explode(F.sequence(F.lit(0), F.col("rights") - 1)).alias("rb"), F.col("node").alias("m"), F.col("u").alias("x"), "own", *(F.col(c).alias("ms") for c in rest))
    b = dealt.join(size, ["layer", "cell"]).select("layer", "cell", F.explode(F.sequence(F.lit(0), F.col("lefts") - 1)).alias("lb"), salt("node", "rights").alias("rb"), F.col("node").alias("n"), F.col("u").alias("y"), *(F.col(c).alias("ns") for c in rest))
    key = ["layer", "cell", "lb", "rb"]
    many = max(tasks, int(packed.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # stated, or few bytes with many pairs would be put together in few tasks
    met = a.repartition(many, *key).join(b.repartition(many, *key), key).filter("own < cell or m <= n" if rest else "own < cell or m < n")
    return met.select("layer", "m", "x", "n", "y", *(c for c in ("ms", "ns") if rest))
