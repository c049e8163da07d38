"""Operator 11: embedding whitening by Spark MLlib's ``computeSVD`` on centred distributed rows.

Vectors are put on a grid, x = floor(64 c) + 1000000, so that sums are whole numbers. The fit list is each distinct x once. Its sums by
dimension and its size n are exact; a row is centred as (n x - S) / n, where n x - S is a whole number, so centring loses
nothing before the division. MLlib multiplies the centred rows (a distributed Gram matrix by tree aggregation) and gives singular
values and right singular vectors; an eigenvalue of the covariance is the square of a singular value over n. The
total variance does not come from them: it is the exact sum of the squared deviations (n x - S)^2 over n^3.

The driver holds one model of dimension x components numbers and MLlib's Gram matrix (dimension squared); rows are
whitened where they lie.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_stage, materialize, table

#: Cells of a unit and where they begin; components that are kept; least singular value beside the largest (below it rounding decides).
CELLS, ORIGIN, COMPONENTS, LEAST = 64, 1_000_000, 16, 3e-7
#: Cells beyond which a coordinate stays at the edge, so that x is a long; whole numbers up to which int64 products are safe.
EDGE, SAFE = 1 << 61, 1 << 62
#: Rows of vectors worked on at once.
ROWS = 2048


@dataclass
class Whitening:
    """Fit of the vectors of one length: size of the fit list, sums by dimension, eigenvalues, unit eigenvectors as columns, total variance."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    total: float
    identity_error: float = 0.0


def on_grid(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """``df`` with its vectors as x, long; rows whose vector is null or holds null or non-finite entries are dropped."""
    good = F.forall(vector, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    cell = lambda c: F.greatest(F.least(F.floor(c.cast("double") * CELLS), F.lit(EDGE)), F.lit(-EDGE)) + ORIGIN
    return df.filter(F.col(vector).isNotNull() & good).withColumn("x", F.transform(vector, cell))


def _arrays(column: pa.Array) -> Iterator[np.ndarray]:
    """The vectors of a column, all of one length, as blocks of rows."""
    for lo in range(0, len(column), ROWS):
        part = column.slice(lo, ROWS)
        yield part.flatten().to_numpy(zero_copy_only=False).reshape(len(part), -1)


def moved(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - S, exact: int64 where that is wide enough, else Python's whole numbers."""
    most = int(np.abs(x).max(initial=0)) * n + max(map(abs, sums), default=0)
    s = np.array(sums, np.int64 if most < SAFE else object)
    return (x if most < SAFE else x.astype(object)) * n - s


def deviations(d: np.ndarray) -> list[int]:
    """Sum of squares of each row of whole numbers, exact."""
    if d.dtype != object and int(np.abs(d).max(initial=0)) ** 2 * max(d.shape[1], 1) >= SAFE:
        d = d.astype(object)
    return [int(v) for v in (d * d).sum(1)]


def _centred(d: np.ndarray, n: int) -> np.ndarray:
    return (d / n).astype(np.float64)


def _sums(fit: DataFrame) -> list[int]:
    """Exact sums by dimension: each task adds up its rows, and the parts of all tasks are decimals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: list[int] = []
        for b in batches:
            for x in _arrays(b.column(0)):
                wide = x if int(np.abs(x).max(initial=0)) < SAFE // ROWS else x.astype(object)
                total = [a + int(v) for a, v in zip(total or [0] * x.shape[1], wide.sum(0))]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(map(str, total), pa.string())], names=["place", "part"])

    parts = fit.select("x").mapInArrow(run, "place int, part string").groupBy("place").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("s"))
    return [int(r.s) for r in parts.orderBy("place").collect()]


def _matrix(rows: DataFrame) -> RowMatrix:
    """A distributed matrix of the column ``v`` (array of doubles), made on the JVM side."""
    return RowMatrix(MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector("v").alias("v")), "v"))


def _mapped(fit: DataFrame, f) -> DataFrame:
    """(v array<double>) of ``f(block)`` for each row of ``fit``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in _arrays(b.column(0)):
                v = f(x)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, v.size + 1, v.shape[1]), pa.int32()), pa.array(np.ascontiguousarray(v).ravel()))
                yield pa.RecordBatch.from_arrays([flat], names=["v"])

    return fit.select("x").mapInArrow(run, "v array<double>")


def fit(vectors: DataFrame, components: int = COMPONENTS) -> dict[int, Whitening]:
    """A whitening for each length of the vectors in ``x`` (see :func:`on_grid`); one of several lengths has a fit of each.

    Components whose singular value is below LEAST of the largest are left out: rounding alone would decide them. So a length whose
    vectors are all equal, and vectors of no entries, have none.
    """
    distinct = materialize(vectors.select("x").distinct(), "whitening-fit")
    out: dict[int, Whitening] = {}
    for size, n in distinct.filter("size(x) > 0").groupBy(F.size("x")).agg(F.count(F.lit(1))).collect():
        one = distinct.filter(F.size("x") == size)
        sums = _sums(one)
        total = _mapped(one, lambda x: np.array([[float(d)] for d in deviations(moved(x, n, sums))])).agg(F.sum(F.element_at("v", 1))).first()[0]
        if not total:
            out[size] = Whitening(n, sums, np.zeros(0), np.zeros((size, 0)), 0.0)
            continue
        found = _matrix(_mapped(one, lambda x: _centred(moved(x, n, sums), n))).computeSVD(size, False, LEAST)
        s = found.s.toArray()[:components]
        model = Whitening(n, sums, s * s / n, found.V.toArray()[:, : len(s)], total / n**3)
        mean = np.array(_matrix(_mapped(one, lambda x: project(x, model))).computeColumnSummaryStatistics().mean())
        gram = _matrix(_mapped(one, lambda x: project(x, model) - mean)).computeGramianMatrix().toArray()
        model.identity_error = float(np.abs(gram / n - np.eye(len(s))).max())
        out[size] = model
    drop_stage(distinct)
    return out


def project(x: np.ndarray, m: Whitening) -> np.ndarray:
    """Whitened rows: centred, on each component, over the root of its eigenvalue."""
    return _centred(moved(x, m.n, m.sums), m.n) @ m.vectors / np.sqrt(m.values)


def whiten(df: DataFrame, models: dict[int, Whitening], vector: str = "embedding") -> DataFrame:
    """``df`` with n, deviation decimal(38,0) (null beyond it), whitened, explained (arrays over components) and identity_error.

    Rows that :func:`on_grid` drops are dropped; repeated rows are whitened each. Columns of these names are replaced, others pass through; vectors of a
    length that the models do not know have nulls; no rows give no rows.
    """
    own = ("n", "deviation", "whitened", "explained", "identity_error", "x")
    rest = [c for c in df.columns if c not in own]
    rows = on_grid(df.select(*rest), vector)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(b.num_columns - 1)
            size = np.asarray(x.value_lengths()) if len(x) else np.zeros(0, int)
            n, dev, white, part, off = ([None] * len(x) for _ in range(5))
            for k in np.unique(size):
                if (m := models.get(int(k))) is None:
                    continue
                at = np.flatnonzero(size == k)
                explained = (m.values / m.total).tolist() if m.total else []
                lo = 0
                for block in _arrays(x.take(pa.array(at))):
                    whole = deviations(moved(block, m.n, m.sums))
                    for i, d, w in zip(at[lo : lo + len(block)].tolist(), whole, project(block, m).tolist()):
                        n[i], dev[i], white[i], part[i], off[i] = m.n, d if d < 10**38 else None, w, explained, m.identity_error
                    lo += len(block)
            doubles = pa.list_(pa.float64())
            new = [pa.array(n, pa.int64()), pa.array([None if d is None else str(d) for d in dev], pa.string()), pa.array(white, doubles), pa.array(part, doubles), pa.array(off, pa.float64())]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *new], names=[*b.schema.names[:-1], *own[:-1]])

    types = "".join(f", {c}" for c in ("n long", "deviation string", "whitened array<double>", "explained array<double>", "identity_error double"))
    head = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, head + types).withColumn("deviation", F.col("deviation").cast("decimal(38,0)"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    found = whiten(rows, fit(on_grid(rows)))
    each = found.select("vec_id", "n", F.expr("try_cast(deviation as bigint)").alias("deviation"), "identity_error", F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "c"))
    return each.select("vec_id", (F.col("at") + 1).cast("int").alias("component"), "n", "deviation", F.col("c.whitened").alias("whitened"), F.col("c.explained").alias("explained"), "identity_error")


QUERIES = {"op11_whitening": op11_whitening}
