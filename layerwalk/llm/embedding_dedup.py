"""Operator 1: embedding near-dedup over an inverted multi-index.

Each half of the unit vectors has its own codebook; the product of both is a grid of cells, and every vector is indexed
in its nearest cell. A query visits cells in the order of a lower bound of the distance it would need to have a
neighbour there: in each half, the distance to the plane between its own centroid and the cell's. The multi-sequence
traversal walks both sorted lists of bounds and stops at a bound that is calibrated to the target recall of two vectors
that are just at the threshold. Found pairs are verified by cosine in double precision.

All vectors are queries. A task takes the rows of a (label, cell): those that live there and those that visit. The
grid grows with the rows of the largest label, so that cells stay at about ``CELL`` rows until ``MOST_CODES``; the rows of a cell
beyond a block meet in pairs of blocks, so that a hot label or cell is dealt over many tasks. A block pair returns counts
of links and a spanning forest of them, never all pairs. Vectors travel as they are stored (32 bits a component where
they are floats). Exact copies collapse to one row first and count by their number. Each length has an index of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import connected_components, drop_stage, group_bounds, grouped, local_components, materialize, partitions, table

THRESHOLD = 0.98
#: Rows that codebooks and the bound are fitted on, at most; rows aimed at in a cell; centroids of a codebook, at most.
SAMPLE, CELL, MOST_CODES = 8192, 2000, 1024
#: Components in a block of a cell, and rows compared at once.
BLOCK_VALUES, TILE = 1 << 20, 1024
TARGET_RECALL = 0.9999


def unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit rows in double precision, and which rows have a direction (finite, not zero)."""
    x = np.asarray(x, np.float64)
    top = np.abs(x).max(1, initial=0)
    ok = np.isfinite(top) & (top > 0)
    x = np.where(ok[:, None], x, 1.0) / np.where(ok, top, 1.0)[:, None]
    return x / np.sqrt((x * x).sum(1))[:, None], ok


def _codebook(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """k-means from evenly spread rows; an empty cluster keeps its centroid."""
    c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        near = ((c * c).sum(1) - 2 * x @ c.T).argmin(1)
        for j in range(k):
            if (near == j).any():
                c[j] = x[near == j].mean(0)
    return c


def bounds(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Own centroid of each half-vector, and the squared distance to the plane towards each other centroid."""
    d = (c * c).sum(1) - 2 * x @ c.T
    own = d.argmin(1)
    apart = np.sqrt(np.maximum(((c[:, None, :] - c[None]) ** 2).sum(2), 1e-12))
    gap = np.maximum(d - d[np.arange(len(x)), own][:, None], 0) / (2 * apart[own])
    gap[np.arange(len(x)), own] = 0
    return own, gap * gap


class MultiIndex:
    """Codebooks of both halves and the bound at which a traversal stops."""

    def __init__(self, sample: np.ndarray, codes: int, threshold: float, recall: float):
        self.half = sample.shape[1] // 2
        codes = max(1, min(codes, len(sample)))
        self.books = [_codebook(sample[:, : self.half], codes), _codebook(sample[:, self.half :], codes)]
        rng = np.random.default_rng(17)
        turn = rng.standard_normal(sample.shape)
        turn -= (turn * sample).sum(1)[:, None] * sample
        turn /= np.maximum(np.sqrt((turn * turn).sum(1)), 1e-12)[:, None]
        near = threshold * sample + np.sqrt(1 - threshold**2) * turn
        (_, gu), (_, gw) = self.bounds(sample)
        (i, _), (j, _) = self.bounds(near)
        rows = np.arange(len(sample))
        self.stop = float(min(np.quantile(gu[rows, i] + gw[rows, j], recall) * 1.25 + 1e-9, 2 - 2 * threshold))

    def bounds(self, x: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        return [bounds(x[:, : self.half], self.books[0]), bounds(x[:, self.half :], self.books[1])]

    def traverse(self, gu: np.ndarray, gw: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Multi-sequence traversal of one query: its first codes nearest first, each with its second codes in reach."""
        order = np.argsort(gw, kind="stable")
        ranked = gw[order]
        for i in np.argsort(gu, kind="stable"):
            if gu[i] > self.stop:
                return
            yield int(i), order[: np.searchsorted(ranked, self.stop - gu[i], "right")]


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each (id, label, vector) row: length, a 128-bit hash and the bytes of its vector, null where it links with nothing."""
    for batch in batches:
        vectors = batch.column(2)
        kind = vectors.type.value_type.to_pandas_dtype()
        body: list[bytes | None] = [None] * batch.num_rows
        size = np.asarray(pc.fill_null(pc.list_value_length(vectors), 0)).astype(np.int32)
        use = np.flatnonzero((size > 0) & np.asarray(batch.column(1).is_valid()))
        for dim in np.unique(size[use]):
            rows = use[size[use] == dim]
            flat = vectors.take(pa.array(rows)).flatten()
            holes = np.asarray(flat.is_null()).reshape(-1, dim).any(1)
            x = np.asarray(flat.fill_null(0)).astype(kind).reshape(-1, dim) + kind(0)  # no negative zeros
            ok = np.isfinite(x).all(1) & (x != 0).any(1) & ~holes
            for r, v in zip(rows[ok].tolist(), x[ok], strict=True):
                body[r] = v.tobytes()
        h = [None if x is None else xxhash.xxh3_128_intdigest(x) for x in body]
        high, low = ([None if x is None else ((x >> k) & 0xFFFFFFFFFFFFFFFF) - (1 << 63) for x in h] for k in (64, 0))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(size), pa.array(high, pa.int64()), pa.array(low, pa.int64()), pa.array(body, pa.binary())], names=["vec_id", "label", "dim", "h1", "h2", "x"])


def _units(body: pa.Array, dim: int, kind: type) -> np.ndarray:
    return unit(np.frombuffer(b"".join(body.to_pylist()), kind).reshape(-1, dim))[0]


def _fit(reps: DataFrame, kind: type, threshold: float, recall: float) -> dict[int, MultiIndex]:
    """An index for each length in a sample of at most SAMPLE rows. Vectors of another length, or of one component, share one cell."""
    rows, most = reps.groupBy("label").agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n"), F.max("n")).first()
    if not rows:
        return {}
    some = reps.select("rep", "dim", "x").filter(F.pmod(F.xxhash64("rep"), F.lit(max(1, rows // SAMPLE))) == 0)
    got = some.orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).collect()
    out = {}
    for dim in {r.dim for r in got if r.dim > 1}:
        x = unit(np.array([np.frombuffer(r.x, kind) for r in got if r.dim == dim]))[0]
        out[dim] = MultiIndex(x, min(MOST_CODES, round((most / CELL) ** 0.5), len(x) // 8), threshold, recall)
    return out


def link_embeddings(vectors: DataFrame, threshold: float = THRESHOLD, recall: float = TARGET_RECALL, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row with an id.

    Two vectors link when their labels are equal and not null, their lengths are equal and their cosine is at least
    ``threshold``. Vectors that are null, empty, zero, or that hold null or non-finite components link with nothing; so
    do rows with a null label. Rows repeated under one id count once (the smallest label, then the smallest vector).
    Rows without an id are left out, other columns ignored, and no rows give no rows.
    """
    spark = vectors.sparkSession
    single = vectors.schema[vec_col].dataType.elementType.typeName() == "float"
    kind, array = (np.float32, "array<float>") if single else (np.float64, "array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vec_col).cast(array).alias("vec")).filter("vec_id is not null")
    all_, ids = rows.agg(F.count("vec_id"), F.count_distinct("vec_id")).first()
    if ids < all_:
        rows = rows.groupBy("vec_id").agg(F.min(F.struct("label", "vec")).alias("r")).select("vec_id", "r.label", "r.vec")
    label = F.when(F.col("label").isNotNull(), F.xxhash64("label")).alias("label")
    rows = materialize(rows.select("vec_id", label, "vec").mapInArrow(_read, "vec_id long, label long, dim int, h1 long, h2 long, x binary"), "vectors")
    same = ["label", "dim", "h1", "h2"]
    reps = rows.filter("h1 is not null").groupBy(*same).agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("x").alias("x"))
    reps = materialize(reps, "vectors")
    index = _fit(reps, kind, threshold, recall)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Home cell and other visited cells of each representative."""
        for batch in batches:
            dims = np.asarray(batch.column(1))
            home, visits = np.zeros(len(dims), np.int64), [[]] * len(dims)
            for dim in set(dims.tolist()) & set(index):
                own = np.flatnonzero(dims == dim)
                for lo in range(0, len(own), TILE):
                    at = own[lo : lo + TILE]
                    m = index[dim]
                    (iu, gu), (iw, gw) = m.bounds(_units(batch.column(2).take(pa.array(at)), dim, kind))
                    home[at] = iu * MOST_CODES + iw
                    for r, k in enumerate(at.tolist()):
                        visits[k] = [c for i, js in m.traverse(gu[r], gw[r]) for c in (i * MOST_CODES + js).tolist() if c != home[k]]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(home), pa.array(visits, pa.list_(pa.int64()))], names=["rep", "dim", "label", "home", "visits"])

    placed = materialize(reps.select("rep", "dim", "x", "label").mapInArrow(place, "rep long, dim int, label long, home long, visits array<long>"), "places")
    seen = placed.select("rep", "label", "dim", F.explode(F.concat(F.array(F.struct(F.col("home").alias("cell"), F.lit(1).alias("member"))), F.transform("visits", lambda c: F.struct(c.alias("cell"), F.lit(0).alias("member"))))).alias("c"))
    seen = seen.select("rep", "label", "dim", "c.*")
    cell = ["label", "dim", "cell"]
    blocks = F.ceil(F.count(F.lit(1)) * F.col("dim") / BLOCK_VALUES).cast("int").alias("nb")
    hot = materialize(seen.groupBy(*cell).agg(blocks).filter("nb > 1"), "cells")
    if hot.isEmpty():
        seen = seen.withColumn("bi", F.lit(0)).withColumn("bj", F.lit(0)).withColumn("mine", F.lit(0))
    else:
        seen = seen.join(hot, cell, "left").withColumn("nb", F.coalesce("nb", F.lit(1)))
        seen = seen.withColumn("mine", F.pmod(F.xxhash64("rep", F.lit(1)), "nb").cast("int")).withColumn("other", F.explode(F.expr("sequence(0, nb - 1)")))
        seen = seen.withColumn("bi", F.least("mine", "other")).withColumn("bj", F.greatest("mine", "other"))
    key = [*cell, "bi", "bj"]
    seen = seen.select(*key, "mine", "member", "rep").join(reps.select("rep", "copies", "x"), "rep")  # vectors come last
    dealt = seen.select(*key, "mine", "member", "rep", "copies", "x").repartition(partitions(spark), *key).sortWithinPartitions(*key, "mine", "member", "rep")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per row: (a, null, links found) and forest edges (a, b, 0)."""
        for got in grouped(batches, key):
            cut = group_bounds(*(np.asarray(got[c]) for c in key))
            for lo, hi in zip(cut[:-1], cut[1:], strict=True):
                part = got.slice(lo, hi - lo)
                dim, own, bi, bj = (part[c][0].as_py() for c in ("dim", "cell", "bi", "bj"))
                rep, copies, member, mine = (np.asarray(part[c]) for c in ("rep", "copies", "member", "mine"))
                if hi - lo < 2 or not member.any():
                    continue
                x = _units(part["x"], dim, kind)
                p, q = _pairs(x, member > 0, None if bi == bj else mine == bi, threshold)
                if not len(p):
                    continue
                if dim in index:  # a member and a visitor that visit each other's cells are found twice: the smaller cell counts
                    m = index[dim]
                    v = np.where(member[p] > 0, q, p)  # the visitor, or a second member
                    far, back = np.flatnonzero(member[v] == 0), np.zeros(len(p), bool)
                    some, at = np.unique(np.concatenate([p[far], q[far]]), return_inverse=True)
                    if len(some):
                        (iu, gu), (iw, gw) = m.bounds(x[some])
                        home = iu * MOST_CODES + iw
                        i, j = at[: len(far)], at[len(far) :]
                        i, j = np.where(member[p[far]] > 0, i, j), np.where(member[p[far]] > 0, j, i)  # member, visitor
                        back[far] = (gu[i, iu[j]] + gw[i, iw[j]] <= m.stop) & (home[j] < own)
                    count = ~back
                else:
                    count = np.ones(len(p), bool)
                links = np.bincount(np.concatenate([p[count], q[count]]), np.concatenate([copies[q[count]], copies[p[count]]]), hi - lo).astype(np.int64)
                has = np.flatnonzero(links)
                root = local_components(hi - lo, p, q)
                apart = np.flatnonzero(root != np.arange(hi - lo))
                a, b = np.concatenate([rep[has], rep[apart]]), np.concatenate([np.full(len(has), -1), rep[root[apart]]])
                n = np.concatenate([links[has], np.zeros(len(apart), np.int64)])
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b, mask=n > 0), pa.array(n)], names=["a", "b", "n"])

    found = materialize(dealt.mapInArrow(verify, "a long, b long, n long"), "links")
    for stage in (placed, hot):
        drop_stage(stage)
    links = found.filter("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    comps = connected_components(found.filter("b is not null").select("a", "b"), "embedding").withColumnRenamed("node", "rep")
    of = reps.select(*same, "rep", "copies").join(links, "rep", "left").join(comps, "rep", "left")
    of = of.select(*same, F.coalesce("component", "rep").alias("component"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    done = rows.select("vec_id", *same).join(of, same, "left")
    component = F.coalesce("component", "vec_id")
    return done.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (component == F.col("vec_id")).alias("kept"))


def _pairs(x: np.ndarray, member: np.ndarray, side: np.ndarray | None, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Linked (p, q) with a member among them: p < q, or of two blocks p on the one ``side`` and q on the other."""
    ps, qs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    left, right = (np.arange(len(x)),) * 2 if side is None else (np.flatnonzero(side), np.flatnonzero(~side))
    for lo in range(0, len(left), TILE):
        a = left[lo : lo + TILE]
        for at in range(lo if side is None else 0, len(right), TILE):
            b = right[at : at + TILE]
            p, q = np.nonzero(x[a] @ x[b].T >= threshold - 1e-12)
            p, q = a[p], b[q]
            ok = member[p] | member[q]
            if side is None:
                ok &= p < q
            p, q = p[ok], q[ok]
            ok = (x[p] * x[q]).sum(1) >= threshold
            ps.append(p[ok])
            qs.append(q[ok])
    return np.concatenate(ps), np.concatenate(qs)


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_embeddings(table(spark, sf_dir, "embeddings"))


QUERIES = {"op1_embedding_dedup": op1_embedding_dedup}
#: Brute force in double precision within each label.
ORACLE_SQL = {
    "op1_embedding_dedup": r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), p AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98
), c AS (
  SELECT vec_id AS id, vec_id AS root FROM embeddings
  UNION SELECT p.b, c.root FROM c JOIN p ON p.a = c.id
)
SELECT e.vec_id, coalesce(l.n, 0)::BIGINT AS n_links, m.component_id, m.component_id = e.vec_id AS kept
FROM embeddings e LEFT JOIN (SELECT a, count(*) AS n FROM p GROUP BY a) l ON l.a = e.vec_id
JOIN (SELECT id, min(root) AS component_id FROM c GROUP BY id) m ON m.id = e.vec_id
"""
}
