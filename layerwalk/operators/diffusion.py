"""Centralities and damped diffusion.

Two strategies give the same nodes, numbers and errors: ``local`` solves a graph of at most DENSE_NODES nodes in one task
with numpy (a larger one raises ValueError), ``distributed`` works by joins and sums over the edges, whose lineage is cut by
written tables. Diffusion is a linear system, which ``distributed`` solves in Krylov subspaces (see ``krylov``), so raw weights with row sums
over 1 and a damping of 1 are as good as normalised ones.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.stages import drop, materialize
from . import krylov

#: Nodes of a graph up to which a dense solve in one task is chosen; what a series may leave out.
DENSE_NODES, TOLERANCE = 5000, 1e-10


def _matrix(pdf: pd.DataFrame) -> tuple[list[str], np.ndarray]:
    names = sorted(set(pdf.src) | set(pdf.dst))
    at = {n: i for i, n in enumerate(names)}
    a = np.zeros((len(names), len(names)))
    np.add.at(a, (pdf.src.map(at).to_numpy(), pdf.dst.map(at).to_numpy()), pdf.w.to_numpy())
    return names, a


def _dense(edges: DataFrame, f, schema: str) -> DataFrame:
    one = edges.select(F.lit("g").alias("graph"), "src", "dst", "w").withColumn("graph", F.concat("graph", F.lit("")))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return f(*_matrix(pdf))

    return one.groupBy("graph").applyInPandas(run, schema)


def node_count(edges: DataFrame) -> int:
    return edges.select(F.explode(F.array("src", "dst")).alias("n")).distinct().count()


def _pick(edges: DataFrame, strategy: str) -> tuple[DataFrame, bool]:
    """The edges, and whether they are for joins. To count nodes, the edges are written once and read again."""
    if strategy not in ("auto", "local", "distributed"):
        raise ValueError(f"unknown strategy {strategy!r}")
    edges = materialize(edges.select("src", "dst", "w"), "edges")
    if strategy == "distributed":
        return edges, True
    large = node_count(edges) > DENSE_NODES
    if large and strategy == "local":
        raise ValueError(f"more than {DENSE_NODES} nodes are no dense matrix; take the distributed strategy")
    return edges, large


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()


def _has(edges: DataFrame, node: str) -> bool:
    return not edges.filter((F.col("src") == node) | (F.col("dst") == node)).isEmpty()


def _steps(r: float, tol: float) -> int:
    """Terms of a series of ratio r after which at most ``tol`` is left out."""
    if not 0 <= r < 1:
        raise ValueError("r must be in [0, 1)")
    return 0 if r == 0 else max(1, int(np.ceil(np.log(tol * (1 - r)) / np.log(r))) - 1)


def series(edges: DataFrame, start: str, r: float, steps: int | None = None, backward: bool = False, every: int = 5, tol: float = TOLERANCE) -> DataFrame:
    """(node, score) of sum over k of r^k times the k-step weight from ``start`` (or, backward, to it).

    With row sums of at most 1 the terms after r^k leave out at most r^(k + 1) / (1 - r): without ``steps`` as many are summed as
    ``tol`` asks, or fewer once the last term is small enough. A series that has not converged then raises ValueError.
    """
    last = steps if steps is not None else _steps(r, tol)
    a, b = ("dst", "src") if backward else ("src", "dst")
    e = materialize(edges.select(F.col(a).alias("node"), F.col(b).alias("to"), "w"), "edges")
    spark = edges.sparkSession
    now = spark.createDataFrame([(start, 1.0)], "node string, x double")
    total = now
    both_before = None
    for k in range(1, last + 1):
        now = now.join(e, "node").groupBy(F.col("to").alias("node")).agg((r * F.sum(F.col("x") * F.col("w"))).alias("x"))
        total = total.union(now).groupBy("node").agg(F.sum("x").alias("x"))
        if k % every == 0 or k == last:
            both = now.withColumn("part", F.lit(0)).union(total.withColumn("part", F.lit(1)))
            before, both = both_before, materialize(both, "series")
            if before is not None:
                drop(before)
            both_before = both
            now, total = both.filter("part = 0").drop("part"), both.filter("part = 1").drop("part")
            left = (now.agg(F.sum(F.abs("x"))).first()[0] or 0.0) * r / (1 - r) if steps is None else 0.0
            if steps is None and left <= tol:
                break
            if k == last and left > 1e3 * tol:
                raise ValueError("the series does not converge; normalise the rows")
    return total.select("node", F.col("x").alias("score"))


def _damping(r: float) -> None:
    if not 0 <= r <= 1:
        raise ValueError("r must be in [0, 1]")


def _reached(a: np.ndarray, start: int) -> np.ndarray:
    """Places that ``start`` reaches by non-zero entries, itself included."""
    seen = np.zeros(len(a), bool)
    now = np.array([start])
    seen[start] = True
    while len(now):
        now = np.flatnonzero((a[now] != 0).any(0) & ~seen)
        seen[now] = True
    return np.flatnonzero(seen)


def _damped(a: np.ndarray, start: int, r: float, steps: int | None) -> np.ndarray:
    """x of (I - r A^T) x = e_start over what ``start`` reaches, 0 elsewhere; with ``steps``, so many terms of the series."""
    own = _reached(a, start)
    e = np.zeros(len(own))
    e[np.searchsorted(own, start)] = 1
    m = r * a[np.ix_(own, own)].T
    if steps is None:
        whole = np.eye(len(own)) - m
        if np.linalg.cond(whole, 1) > 1e13:
            raise ValueError("the matrix I - r A is singular")
        x = np.linalg.solve(whole, e)
    else:
        x = now = e
        for _ in range(steps):
            now = m @ now
            x = x + now
    out = np.zeros(len(a))
    out[own] = x
    return out


def _solved(edges: DataFrame, f: Callable[[list[str], np.ndarray], pd.DataFrame]) -> DataFrame:
    """(node, score) of ``f`` of the dense matrix, written; a ValueError inside the task is raised here."""

    def run(names: list[str], a: np.ndarray) -> pd.DataFrame:
        try:
            return f(names, a).assign(error=None)
        except ValueError as e:
            return pd.DataFrame({"node": [None], "score": [None], "error": [str(e)]})

    out = materialize(_dense(edges, run, "node string, score double, error string"), "solution")
    if failed := out.filter("error is not null").first():
        raise ValueError(failed.error)
    return out.drop("error")


def _diffused(edges: DataFrame, nodes: DataFrame, start: str, r: float, steps: int | None, backward: bool = False) -> DataFrame:
    """(node, score) of all ``nodes`` by joins; backward: along the edges' other direction."""
    if steps is not None:
        one = nodes.join(series(edges, start, r, steps, backward), "node", "left")
        return one.select("node", F.coalesce("score", F.lit(0.0)).alias("score"))
    if backward:
        edges = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")
    return krylov.solve(edges, nodes, nodes.select("node", (F.col("node") == start).cast("double").alias("b")), r)


def local_neighbourhood(edges: DataFrame, node: str, r: float = 0.7, strategy: str = "auto", steps: int | None = None) -> DataFrame:
    """(node, score) of all nodes: damped diffusion from a node, the solution s of (I - r A^T) s = e_node; 0 for nodes that it does not reach.

    With ``steps``, so many terms of the series instead. A node that is not in the graph, r outside [0, 1] or a singular system raise ValueError.
    """
    _damping(r)
    edges, joins = _pick(edges, strategy)
    if not _has(edges, node):
        raise ValueError(f"no node {node!r}")
    if joins:
        nodes = materialize(nodes_of(edges), "nodes")
        return _diffused(edges, nodes, node, r, steps)
    return _solved(edges, lambda names, a: pd.DataFrame({"node": names, "score": _damped(a, names.index(node), r, steps)}))


def start_to_end(edges: DataFrame, start: str, end: str, r: float = 0.7, strategy: str = "auto", steps: int | None = None) -> DataFrame:
    """(node, score): expected damped visits of each node on ways from start that reach end, without end itself.

    With Q = r A and end taken out, G = (I - Q)^-1 and h = G q_end, a node scores h_i G[start, i] / h_start. Both
    vectors are solved for, nothing is inverted: h first, then G's row over the nodes from which end can be reached (the others score 0). With
    ``steps``, both are so many terms of their series. Equal or missing ends, an end that start cannot reach, r outside
    [0, 1] or a singular system raise ValueError.
    """
    _damping(r)
    if start == end:
        raise ValueError("start and end are the same node")
    edges, joins = _pick(edges, strategy)
    if not _has(edges, start) or not _has(edges, end):
        raise ValueError("start or end is not a node")
    if not joins:

        def solve(names: list[str], a: np.ndarray) -> pd.DataFrame:
            j, i = names.index(end), names.index(start)
            a[j] = 0
            h = _damped(a.T, j, r, steps)
            if abs(h[i]) < 1e-15:
                raise ValueError("end cannot be reached from start")
            live = h != 0
            live[j] = False
            g = _damped(np.where(live[:, None] & live[None], a, 0), i, r, steps)
            return pd.DataFrame({"node": names, "score": h * g / h[i]}).drop(index=j)

        return _solved(edges, solve)
    nodes = materialize(nodes_of(edges), "nodes")
    out = edges.filter(F.col("src") != end)
    h = materialize(_diffused(out, nodes, end, r, steps, backward=True).withColumnRenamed("score", "h").filter(F.col("node") != end), "hitting")
    top = h.filter(F.col("node") == start).first()
    if top is None or abs(top.h) < 1e-15:
        raise ValueError("end cannot be reached from start")
    live = h.filter("h <> 0").select("node")
    inner = out.join(live.withColumnRenamed("node", "src"), "src", "left_semi").join(live.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst", "w")
    inner = materialize(inner, "edges")
    g = _diffused(inner, nodes, start, r, steps).withColumnRenamed("score", "g")
    return h.join(g, "node").select("node", (F.col("h") * F.col("g") / top.h).alias("score"))


def pagerank(edges: DataFrame, damping: float = 0.85, iterations: int = 1000, tol: float = 1e-6, strategy: str = "auto") -> DataFrame:
    """(node, score): weighted PageRank; rows are normalised, dangling mass spreads evenly; stops below N * tol."""
    edges = edges.filter("w <> 0")
    edges, joins = _pick(edges, strategy)
    if joins:
        return _ranked(edges, damping, iterations, tol)

    def solve(names: list[str], a: np.ndarray) -> pd.DataFrame:
        n = len(names)
        out = a.sum(1)
        p = np.divide(a, out[:, None], out=np.zeros_like(a), where=out[:, None] > 0)
        x = np.full(n, 1 / n)
        for _ in range(iterations):
            new = damping * (x @ p + x[out <= 0].sum() / n) + (1 - damping) / n
            done = np.abs(new - x).sum() < n * tol
            x = new
            if done:
                break
        return pd.DataFrame({"node": names, "score": x})

    return _dense(edges, solve, "node string, score double")


def _ranked(edges: DataFrame, damping: float, iterations: int, tol: float) -> DataFrame:
    """PageRank as one join and one sum a round; each round is a written table."""
    total = F.sum("w").over(W.partitionBy("src"))
    e = materialize(edges.withColumn("p", F.col("w") / total).select(F.col("src").alias("node"), F.col("dst").alias("to"), "p"), "edges")
    nodes = e.select("node").union(e.select("to")).distinct().join(e.select("node", F.lit(False).alias("dead")).distinct(), "node", "left")
    nodes = materialize(nodes.withColumn("dead", F.coalesce("dead", F.lit(True))), "nodes")
    n = nodes.count()
    x = nodes.withColumn("x", F.lit(1.0 / max(n, 1)))
    for _ in range(iterations):
        lost = x.agg(F.sum(F.when(F.col("dead"), F.col("x")))).first()[0] or 0.0
        into = x.join(e, "node").groupBy(F.col("to").alias("node")).agg(F.sum(F.col("x") * F.col("p")).alias("got"))
        new = x.join(into, "node", "left").select("node", "dead", F.col("x").alias("old"), (damping * (F.coalesce("got", F.lit(0.0)) + lost / n) + (1 - damping) / n).alias("x"))
        new = materialize(new, "rank")
        moved = new.agg(F.sum(F.abs(F.col("x") - F.col("old")))).first()[0] or 0.0
        x = new.drop("old")
        if moved < n * tol:
            break
    return x.select("node", F.col("x").alias("score"))


def undirected(edges: DataFrame) -> DataFrame:
    """Each pair of nodes with an edge in either direction, both ways; of two weights that of the larger end's edge counts."""
    one = edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), F.struct("src", "w").alias("x")).groupBy("a", "b").agg(F.max("x").alias("x"))
    one = one.select("a", "b", F.col("x.w").alias("w"))
    return one.select(F.col("a").alias("src"), F.col("b").alias("dst"), "w").union(one.filter("a <> b").select("b", "a", "w"))


def eigenvector(edges: DataFrame, iterations: int = 1000, tol: float = 1e-6, weighted: bool = True, strategy: str = "auto") -> DataFrame:
    """(node, score): in-edge eigenvector centrality by shifted power iteration, of length 1.

    If it does not converge, that of the undirected graph; if that does not either, 1 for all.
    """
    e = edges.filter("w <> 0")
    e = e if weighted else e.withColumn("w", F.lit(1.0))
    e, joins = _pick(e, strategy)
    for graph in (e, undirected(e)):
        found = materialize(_leading(graph, iterations, tol) if joins else _leading_dense(graph, iterations, tol), "power")
        if tol <= 0 or found.filter("score is null").isEmpty():
            return found
    return found.select("node", F.lit(1.0).alias("score"))


def _leading_dense(e: DataFrame, iterations: int, tol: float) -> DataFrame:
    """Scores, or nulls if they do not converge."""

    def solve(names: list[str], a: np.ndarray) -> pd.DataFrame:
        n = len(names)
        x = np.full(n, 1 / n)
        for _ in range(iterations):
            new = x + x @ a
            new = new / (np.sqrt((new * new).sum()) or 1)
            done = np.abs(new - x).sum() < n * tol
            x = new
            if done:
                break
        else:
            if tol > 0:
                x = np.full(n, None, object)
        return pd.DataFrame({"node": names, "score": x})

    return _dense(e, solve, "node string, score double")


def _leading(edges: DataFrame, iterations: int, tol: float) -> DataFrame:
    """Scores, or nulls if they do not converge; each round is a written table."""
    e = materialize(edges.select(F.col("src").alias("node"), F.col("dst").alias("to"), "w"), "edges")
    nodes = materialize(e.select("node").union(e.select("to")).distinct(), "nodes")
    n = nodes.count()
    x = nodes.withColumn("x", F.lit(1.0 / max(n, 1)))
    for _ in range(iterations):
        into = x.join(e, "node").groupBy(F.col("to").alias("node")).agg(F.sum(F.col("x") * F.col("w")).alias("got"))
        raw = materialize(x.join(into, "node", "left").select("node", F.col("x").alias("old"), (F.col("x") + F.coalesce("got", F.lit(0.0))).alias("x")), "power")
        length = (raw.agg(F.sum(F.col("x") * F.col("x"))).first()[0] or 0.0) ** 0.5 or 1.0
        moved = raw.agg(F.sum(F.abs(F.col("x") / length - F.col("old")))).first()[0] or 0.0
        x = raw.select("node", (F.col("x") / length).alias("x"))
        if moved < n * tol:
            break
    else:
        if tol > 0:
            x = nodes.withColumn("x", F.lit(None).cast("double"))
    return x.select("node", F.col("x").alias("score"))


def degree_centrality(edges: DataFrame) -> DataFrame:
    """(node, degree): number of edges in and out."""
    return edges.filter("w <> 0").select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


def drop_shadows(scores: DataFrame) -> DataFrame:
    """Without nodes whose name ends with ``neg``; ranks and scores stay as they are."""
    return scores.filter(~F.col("node").endswith("neg"))


def centralities(edges: DataFrame, damping: float = 0.85) -> DataFrame:
    """(node, pagerank, eigenvector) of the nodes that are no shadows."""
    p = pagerank(edges, damping).withColumnRenamed("score", "pagerank")
    return drop_shadows(p.join(eigenvector(edges).withColumnRenamed("score", "eigenvector"), "node"))


def normalise_rows(edges: DataFrame) -> DataFrame:
    """Weights clipped at 0, each row divided by its sum."""
    e = edges.select("src", "dst", F.greatest("w", F.lit(0.0)).alias("w")).filter("w > 0")
    s = e.groupBy("src").agg(F.sum("w").alias("s"))
    return e.join(s, "src").select("src", "dst", (F.col("w") / F.col("s")).alias("w"))


