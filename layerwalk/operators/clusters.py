"""Clusterings of graphs and how much two of them agree."""

from __future__ import annotations

import math
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import node_type
from ..plans.stages import drop, materialize
from . import krylov

#: Nodes of a graph up to which its matrix is dense in one task; rows that k-means draws its first centres from.
DENSE_NODES, SEEDS = 2000, 10_000
#: Large graphs whose jobs run at once: a round of one is many short jobs that leave most cores idle.
GRAPHS_AT_ONCE = 4


def from_matrix(spark: SparkSession, matrix: object, names: list[str] | None = None, graph: str = "g") -> DataFrame:
    """Edges (graph, src, dst, w) of a small square matrix: a pandas frame with equal index and columns, or an array with names."""
    if isinstance(matrix, pd.DataFrame):
        if set(matrix.index) != set(matrix.columns) or matrix.shape[0] != matrix.shape[1]:
            raise ValueError("index and columns must hold the same nodes")
        names, a = [str(x) for x in matrix.index], matrix[matrix.index].to_numpy(float)
    else:
        a = np.asarray(matrix, float)
        if a.ndim != 2 or a.shape[0] != a.shape[1]:
            raise ValueError("the matrix must be square")
        names = [str(x) for x in (names if names is not None else range(len(a)))]
        if len(names) != len(a):
            raise ValueError("one name is needed for each row")
    i, j = np.nonzero(np.nan_to_num(a))
    return spark.createDataFrame([(graph, names[x], names[y], float(a[x, y])) for x, y in zip(i, j, strict=True)], "graph string, src string, dst string, w double")


def label_frame(labels: DataFrame, label: str = "cluster", graph: str | None = None) -> DataFrame:
    """(graph, node, cluster) of a frame that has these columns, or lacks ``graph`` and gets it as given."""
    missing = {"node", label} - set(labels.columns)
    if missing:
        raise ValueError(f"labels lack {sorted(missing)}")
    if "graph" not in labels.columns:
        if graph is None:
            raise ValueError("a graph name is needed")
        labels = labels.withColumn("graph", F.lit(graph))
    return labels.select("graph", "node", F.col(label).alias("cluster"))


def affinity(edges: DataFrame, symmetrize: str = "max", clip_negative: bool = True, remove_isolated: bool = True, add_self_loops: bool = False) -> DataFrame:
    """Symmetric edges (graph, src, dst, w) without diagonal: larger, mean or smaller of both directions, or as they are."""
    e = edges.filter("src <> dst").select("graph", "src", "dst", (F.greatest("w", F.lit(0.0)) if clip_negative else F.col("w")).alias("w"))
    if symmetrize != "none":
        how = {"max": F.greatest, "min": F.least}.get(symmetrize)
        if how is None and symmetrize != "mean":
            raise ValueError(f"unknown symmetrize {symmetrize!r}")
        back = e.select("graph", F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("w").alias("v"))
        both = e.join(back, ["graph", "src", "dst"], "full")
        w, v = F.coalesce("w", F.lit(0.0)), F.coalesce("v", F.lit(0.0))
        e = both.select("graph", "src", "dst", (how(w, v) if how else (w + v) / 2).alias("w"))
    e = e.filter("w <> 0")
    if remove_isolated:
        live = e.groupBy("graph", "src").agg(F.sum("w").alias("s")).filter("s > 0").select("graph", "src")
        e = e.join(live, ["graph", "src"], "left_semi").join(live.withColumnRenamed("src", "dst"), ["graph", "dst"], "left_semi").select("graph", "src", "dst", "w")
    if add_self_loops:
        e = e.union(e.select("graph", "src", F.col("src").alias("dst"), F.lit(1e-12).alias("w")).distinct())
    return e


def _laplacian(pdf: pd.DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    names = sorted(set(pdf.src) | set(pdf.dst))
    at = {n: i for i, n in enumerate(names)}
    a = np.zeros((len(names),) * 2)
    np.add.at(a, (pdf.src.map(at).to_numpy(), pdf.dst.map(at).to_numpy()), pdf.w.to_numpy())
    d = np.maximum(a.sum(1), 1e-12) ** -0.5
    return names, a, np.eye(len(names)) - d[:, None] * a * d[None]


def _first_centres(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k-means++: each centre with a probability that grows with the square of its distance from the others."""
    c = x[[rng.integers(len(x))]]
    while len(c) < k:
        d = ((x[:, None] - c[None]) ** 2).sum(2).min(1)
        c = np.vstack([c, x[rng.choice(len(x), p=d / d.sum()) if d.sum() > 0 else rng.integers(len(x))]])
    return c


def _sums(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Of each centre: sums and number of its rows, and their squared distances (k, dim + 2)."""
    d = ((x[:, None] - c[None]) ** 2).sum(2)
    lab = d.argmin(1)
    out = np.zeros((len(c), x.shape[1] + 2))
    np.add.at(out, lab, np.column_stack([x, np.ones(len(x)), d[np.arange(len(x)), lab]]))
    return out


def _lloyd(sums, starts: list[np.ndarray], rounds: int) -> np.ndarray:
    """Centres of the best of several runs; ``sums(list of centres)`` gives :func:`_sums` of each over all rows."""
    now, live = list(starts), list(range(len(starts)))
    cost = np.full(len(starts), math.inf)
    for _ in range(rounds):
        if not live:
            break
        got = sums([now[i] for i in live])
        still = []
        for i, s in zip(live, got, strict=True):
            n = s[:, -2:-1]
            new = np.where(n > 0, s[:, :-2] / np.maximum(n, 1), now[i])
            cost[i] = s[:, -1].sum()
            if not np.allclose(new, now[i]):
                still.append(i)
                now[i] = new
        live = still
    for i, s in zip(live, sums([now[i] for i in live]) if live else [], strict=True):
        cost[i] = s[:, -1].sum()
    best = 0
    for i in range(1, len(starts)):
        best = i if cost[i] < cost[best] - 1e-12 else best
    return now[best]


def kmeans(x: np.ndarray, k: int, seed: int = 42, n_init: int = 20, rounds: int = 100) -> np.ndarray:
    """Labels of the best of n_init runs from k-means++ starts."""
    rng = np.random.default_rng(seed)
    c = _lloyd(lambda cs: [_sums(x, c) for c in cs], [_first_centres(x, k, rng) for _ in range(n_init)], rounds)
    return ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)


def kmeans_rows(rows: DataFrame, k: int, seed: int = 42, n_init: int = 20, rounds: int = 100) -> DataFrame:
    """(node, cluster) of (node, v array<double>): as :func:`kmeans`, with sums that each task makes of its rows for all runs at once.

    First centres are drawn from the SEEDS rows with the least hash of their node (all, by node, where there are no more); every round
    covers all rows. Only centres and sums reach the driver.
    """
    few = rows.orderBy(F.xxhash64("node"), "node").limit(SEEDS).collect()
    x = np.array([r.v for r in sorted(few, key=lambda r: r.node)])
    rng = np.random.default_rng(seed)
    dim = x.shape[1]

    def sums(cs: list[np.ndarray]) -> list[np.ndarray]:
        got = krylov.products(rows.select("node", "v"), lambda c: np.stack([_sums(c["v"], one) for one in cs]), len(cs) * k * (dim + 2))
        return list(got.reshape(len(cs), k, dim + 2))

    c = _lloyd(sums, [_first_centres(x, k, rng) for _ in range(n_init)], rounds)
    out = krylov.mapped(rows.select("node", "v"), lambda r: {"c": ((r["v"][:, None] - c[None]) ** 2).sum(2).argmin(1)[:, None].astype(float)}, ("c",))
    return out.select("node", F.col("c")[0].cast("int").alias("cluster"))


def _unit_rows(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.sqrt((v**2).sum(1)), 1e-12)[:, None]


def _normalised(one: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges weighted w / sqrt(d_src d_dst), and (node, strength); the Laplacian is the identity less these."""
    both = one.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    d = both.join(one.groupBy(F.col("src").alias("node")).agg(F.sum("w").alias("strength")), "node", "left").select("node", F.coalesce("strength", F.lit(0.0)).alias("strength"))
    d = materialize(d, "strengths")
    root = lambda end: d.select(F.col("node").alias(end), F.sqrt(F.greatest("strength", F.lit(1e-12))).alias(f"{end}_root"))
    e = one.join(root("src"), "src").join(root("dst"), "dst").select("src", "dst", (F.col("w") / F.col("src_root") / F.col("dst_root")).alias("w"))
    return materialize(e, "affinity"), d


def _sized(edges: DataFrame, strategy: str) -> tuple[DataFrame, DataFrame, list[str]]:
    """Edges of the graphs that one task takes, all edges written, and the graphs that joins take."""
    if strategy not in ("auto", "local", "distributed"):
        raise ValueError(f"unknown strategy {strategy!r}")
    edges = materialize(edges.select("graph", "src", "dst", "w"), "graphs")
    if strategy == "local":
        return edges, edges, []
    n = edges.select("graph", F.explode(F.array("src", "dst")).alias("node")).distinct().groupBy("graph").count()
    large = [r.graph for r in (n if strategy == "distributed" else n.filter(F.col("count") > DENSE_NODES)).orderBy("graph").collect()]
    return edges.filter(~F.col("graph").isin(large)) if large else edges, edges, large


def _of_each(large: list[str], one: Callable) -> list:
    """``one(graph)`` of every large graph, in order; their jobs share the cluster."""
    with ThreadPoolExecutor(GRAPHS_AT_ONCE) as pool:
        return list(pool.map(one, large))


def spectral(edges: DataFrame, k: int, seed: int = 42, n_init: int = 20, strategy: str = "auto") -> DataFrame:
    """(graph, node, cluster, strength) of symmetric non-negative edges; a graph needs at least k >= 2 nodes.

    A graph of at most DENSE_NODES nodes is a dense matrix in one task (``strategy`` local: any); for a larger one (distributed: any)
    eigenvectors come from block Krylov subspaces over the edges, and k-means adds up partial sums: no matrix and no
    list of nodes is in one place. Both ways give the same clusters where the k-th eigenvalue stands apart.
    """
    if k < 2:
        raise ValueError("k must be at least 2")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names, a, lap = _laplacian(pdf)
        if len(names) < k:
            raise ValueError(f"{len(names)} nodes are fewer than {k} clusters")
        vec = _unit_rows(np.linalg.eigh(lap)[1][:, :k])
        return pd.DataFrame({"graph": pdf.graph.iloc[0], "node": names, "cluster": kmeans(vec, k, seed, n_init), "strength": a.sum(1)})

    schema = "graph string, node string, cluster int, strength double"
    small, every, large = _sized(edges, strategy)
    out = small.groupBy("graph").applyInPandas(run, schema)

    def clustered(graph: str) -> DataFrame:
        e, d = _normalised(every.filter(F.col("graph") == graph))
        if d.count() < k:
            raise ValueError(f"{d.count()} nodes are fewer than {k} clusters")
        _, vectors = krylov.leading(e, d.select("node"), k)
        rows = materialize(krylov.mapped(vectors, lambda c: {"v": _unit_rows(c["v"])}, ("v",)), "embedding")
        found = materialize(kmeans_rows(rows, k, seed, n_init).join(d, "node").select(F.lit(graph).alias("graph"), "node", "cluster", "strength"), "clusters")
        for used in (e, d, vectors, rows):
            drop(used)
        return found

    for found in _of_each(large, clustered):
        out = out.union(found)
    return out


def eigengap(edges: DataFrame, k_max: int = 12, strategy: str = "auto") -> DataFrame:
    """(graph, k, eigenvalues): clusters by the largest gap among the first min(k_max, n - 1) eigenvalues of L_sym; strategies as in :func:`spectral`."""

    def gaps(val: np.ndarray) -> int:
        return int(np.argmax(np.diff(val))) + 1

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names, _, lap = _laplacian(pdf)
        if len(names) < 3:
            raise ValueError("a graph needs at least three nodes")
        val = np.linalg.eigvalsh(lap)[: max(2, min(k_max, len(names) - 1)) + 1]
        return pd.DataFrame({"graph": [pdf.graph.iloc[0]], "k": [gaps(val)], "eigenvalues": [list(val)]})

    schema = "graph string, k int, eigenvalues array<double>"
    small, every, large = _sized(edges, strategy)
    out = small.groupBy("graph").applyInPandas(run, schema)

    def values(graph: str) -> tuple:
        e, d = _normalised(every.filter(F.col("graph") == graph))
        n = d.count()
        if n < 3:
            raise ValueError("a graph needs at least three nodes")
        val = 1 - krylov.leading(e, d.select("node"), max(2, min(k_max, n - 1)) + 1)[0]
        drop(e)
        drop(d)
        return graph, gaps(val), [float(v) for v in val]

    rows = _of_each(large, values)
    return out.union(edges.sparkSession.createDataFrame(rows, schema)) if rows else out


def cluster(edges: DataFrame, k: int, method: str | Callable[..., DataFrame] = "spectral", **options: object) -> DataFrame:
    """Clusters every graph of the frame by ``spectral`` or a user's function of (edges, k)."""
    if callable(method):
        return method(edges, k, **options)
    if method != "spectral":
        raise ValueError(f"unknown method {method!r}")
    return spectral(edges, k, **options)


def contingency(labels: DataFrame, label: str = "cluster") -> DataFrame:
    """(graph_a, graph_b, a, b, n, na, nb, total): cells of every pair of graphs over their common nodes."""
    x = labels.select(F.col("graph").alias("graph_a"), "node", F.col(label).cast("string").alias("a"))
    y = labels.select(F.col("graph").alias("graph_b"), "node", F.col(label).cast("string").alias("b"))
    c = x.join(y, "node").groupBy("graph_a", "graph_b", "a", "b").agg(F.count(F.lit(1)).alias("n"))
    key = ["graph_a", "graph_b"]
    na = c.groupBy(*key, "a").agg(F.sum("n").alias("na"))
    nb = c.groupBy(*key, "b").agg(F.sum("n").alias("nb"))
    total = c.groupBy(*key).agg(F.sum("n").alias("total"))
    return c.join(na, [*key, "a"]).join(nb, [*key, "b"]).join(total, key)


def mutual_information(labels: DataFrame, label: str = "cluster", min_common: int = 2) -> DataFrame:
    """(graph_a, graph_b, common, mi, nmi): in nats; nmi over the mean of both entropies, 1 for two single clusters.

    Pairs of fewer than ``min_common`` common nodes have nulls.
    """
    c = contingency(labels, label)
    key = ["graph_a", "graph_b", "total"]
    p = F.col("n") / F.col("total")
    mi = c.groupBy(*key).agg(F.sum(p * F.log(F.col("n") * F.col("total") / (F.col("na") * F.col("nb")))).alias("mi"))
    ent = lambda col: c.select(*key, col[-1], col).distinct().groupBy(*key).agg((-F.sum(F.col(col) / F.col("total") * F.log(F.col(col) / F.col("total")))).alias(f"h{col}"))
    m = mi.join(ent("na"), key).join(ent("nb"), key)
    mean = (F.col("hna") + F.col("hnb")) / 2
    enough = F.col("total") >= min_common
    return m.select("graph_a", "graph_b", F.col("total").alias("common"), F.when(enough, F.greatest("mi", F.lit(0.0))).alias("mi"), F.when(enough, F.when(mean < 1e-12, 1.0).otherwise(F.col("mi") / mean)).alias("nmi"))


def _expected_mi(na: np.ndarray, nb: np.ndarray, n: int) -> float:
    """Exact expectation of the mutual information of labelings with these cluster sizes (hypergeometric model)."""
    lg = np.array([math.lgamma(i + 1) for i in range(n + 1)])
    out = 0.0
    for a in na:
        for b in nb:
            k = np.arange(max(1, a + b - n), min(a, b) + 1)
            lp = lg[a] + lg[b] + lg[n - a] + lg[n - b] - lg[n] - lg[k] - lg[a - k] - lg[b - k] - lg[n - a - b + k]
            out += float((k / n * np.log(n * k / (a * b)) * np.exp(lp)).sum())
    return out


def adjusted_mutual_information(labels: DataFrame, label: str = "cluster") -> DataFrame:
    """(graph_a, graph_b, ami): mutual information beyond chance over the mean entropy beyond chance."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        n = int(pdf.total.iloc[0])
        a, b = pdf.drop_duplicates("a").na.to_numpy(), pdf.drop_duplicates("b").nb.to_numpy()
        mi = float((pdf.n / n * np.log(pdf.n * n / (pdf.na * pdf.nb))).sum())
        h = [-float((x / n * np.log(x / n)).sum()) for x in (a, b)]
        e = _expected_mi(a, b, n)
        den = sum(h) / 2 - e
        one = len(a) == len(b) == 1 or len(a) == len(b) == n
        return pd.DataFrame({"graph_a": [pdf.graph_a.iloc[0]], "graph_b": [pdf.graph_b.iloc[0]], "ami": [1.0 if one else (mi - e) / (den if abs(den) > 1e-15 else 1e-15)]})

    return contingency(labels, label).groupBy("graph_a", "graph_b").applyInPandas(run, "graph_a string, graph_b string, ami double")


def square(pairs: DataFrame, value: str) -> DataFrame:
    """Pairs as a matrix: one row a graph, one column a graph."""
    return pairs.groupBy("graph_a").pivot("graph_b").agg(F.first(value)).orderBy("graph_a")


def composition(labels: DataFrame, members: int = 5) -> DataFrame:
    """(graph, cluster, n, percent, n_basis, n_rna, n_histone, n_other, sample): size and node types of every cluster."""
    t = labels.withColumn("type", node_type(F.col("node")))
    c = t.groupBy("graph", "cluster").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("type") == "basis").alias("n_basis"), F.count_if(F.col("type") == "RNA").alias("n_rna"),
        F.count_if(F.col("type").startswith("K")).alias("n_histone"), F.count_if(F.col("type") == "other").alias("n_other"), F.slice(F.sort_array(F.collect_list("node")), 1, members).alias("sample"),
    )
    whole = c.groupBy("graph").agg(F.sum("n").alias("whole"))
    return c.join(F.broadcast(whole), "graph").select("graph", "cluster", "n", (100.0 * F.col("n") / F.col("whole")).alias("percent"), "n_basis", "n_rna", "n_histone", "n_other", "sample")


def closest_to_basis(positions: DataFrame, basis: list[str]) -> DataFrame:
    """(basis, node, distance): the nearest other node of each basis node in a layout (node, x, y); ties by name."""
    b = positions.filter(F.col("node").isin(basis)).select(F.col("node").alias("basis"), F.col("x").alias("bx"), F.col("y").alias("by"))
    o = positions.filter(~F.col("node").isin(basis))
    d = F.hypot(F.col("x") - F.col("bx"), F.col("y") - F.col("by"))
    m = o.crossJoin(F.broadcast(b)).groupBy("basis").agg(F.min(F.struct(d.alias("d"), F.col("node").alias("n"))).alias("m"))
    return m.select("basis", F.col("m.n").alias("node"), F.col("m.d").alias("distance"))
