"""Layers joined by names into one transition graph, and its shadow copy that tracks negative correlation.

Edges are (src, dst, w) between composed names ``node_layer``; merged basis nodes have their plain name. ``src_layer``
and ``dst_layer`` (null for merged basis nodes) ride along, so names are never parsed. So does ``sw``, the signed weight,
from which the shadow graph takes its signs without a second pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..functions.names import SHADOW, gene_part, is_basis
from .layers import Graph, dot, layer_graphs, n_times, pack

COLUMNS = ["src", "src_layer", "dst", "dst_layer", "w", "sw"]


def contains_pairs(packed: DataFrame, order: list[str] | None = None, same_gene: bool = True) -> DataFrame:
    """(layer_a, a, u, layer_b, b, v): pairs of layers i < j in ``order`` where the gene of a is a substring of b.

    The substring test runs as an equi-join: b is expanded to its distinct substrings of the lengths that genes have,
    so no nested loop is needed. Without ``same_gene`` all pairs are made.
    """
    order = order or sorted(r.layer for r in packed.select("layer").distinct().collect())
    ord_of = F.coalesce(*[F.when(F.col("layer") == x, i) for i, x in enumerate(order)])
    p = packed.withColumn("ord", ord_of).filter("ord is not null")
    a = p.select(F.col("layer").alias("layer_a"), F.col("node").alias("a"), F.col("u"), F.col("ord").alias("i"), gene_part(F.col("node")).alias("gene"))
    b = p.select(F.col("layer").alias("layer_b"), F.col("node").alias("b"), F.col("u").alias("v"), F.col("ord").alias("j"))
    if not same_gene:
        return a.drop("gene").join(b, F.col("i") < F.col("j")).drop("i", "j")
    sizes = sorted(r.n for r in a.select(F.length("gene").alias("n")).distinct().collect())
    if not sizes:
        return a.join(b, F.lit(False)).drop("gene", "i", "j")
    parts = F.array_distinct(F.flatten(F.array(*[F.when(F.length("b") >= n, F.expr(f"transform(sequence(1, length(b) - {n} + 1), k -> substring(b, k, {n}))")).otherwise(F.array().cast("array<string>")) for n in sizes])))
    return a.join(b.withColumn("gene", F.explode(parts)), "gene").filter("i < j").drop("gene", "i", "j")


def inter_edges(packed: DataFrame, kernel: str | K.Kernel = "absolute", sigma: float | None = None, n: float | None = None, order: list[str] | None = None, same_gene: bool = True, threshold: float | None = None) -> DataFrame:
    """Edges between layers, both directions, with the correlation itself as ``sw`` (none: 0)."""
    pairs = contains_pairs(packed, order, same_gene)
    times = n_times(packed)
    c = F.coalesce(dot(F.col("u"), F.col("v"), times), F.lit(float("nan"))) if times else F.lit(float("nan"))
    e = pairs.select("layer_a", "a", "layer_b", "b", K.apply(kernel, c, sigma, n).alias("w"), F.nanvl(c, F.lit(0.0)).alias("sw")).filter("not isnan(w)")
    if threshold is not None:
        e = e.filter(F.col("w") >= threshold)
    x, y = F.concat_ws("_", "a", "layer_a"), F.concat_ws("_", "b", "layer_b")
    one = e.select(x.alias("src"), F.col("layer_a").alias("src_layer"), y.alias("dst"), F.col("layer_b").alias("dst_layer"), "w", "sw")
    two = e.select(y.alias("src"), F.col("layer_b").alias("src_layer"), x.alias("dst"), F.col("layer_a").alias("dst_layer"), "w", "sw")
    return one.unionByName(two)


def _merged(node: Column, layer: Column, many: bool) -> tuple[Column, Column]:
    if not many:
        return F.concat_ws("_", node, layer), layer
    return F.when(is_basis(node), node).otherwise(F.concat_ws("_", node, layer)), F.when(~is_basis(node), layer)


def multigraph(intra: DataFrame, inter: DataFrame, n_layers: int) -> DataFrame:
    """Layer edges and edges between layers in one graph; with several layers, basis copies merge by sums, without self-loops.

    Signed weights are summed beside the weights; edges without a ``sign`` count as positive.
    """
    signed = F.col("w") * F.col("sign") if "sign" in intra.columns else F.col("w")
    many = n_layers > 1
    s, sl = _merged(F.col("src"), F.col("layer"), many)
    d, dl = _merged(F.col("dst"), F.col("layer"), many)
    e = intra.select(s.alias("src"), sl.alias("src_layer"), d.alias("dst"), dl.alias("dst_layer"), "w", signed.alias("sw"))
    if many:
        e = e.filter(~(is_basis(F.col("src")) & (F.col("src") == F.col("dst"))))
        e = e.groupBy("src", "src_layer", "dst", "dst_layer").agg(F.sum("w").alias("w"), F.sum("sw").alias("sw"))
    return e.unionByName(inter).select(*COLUMNS)


def layer_transitions(multi: DataFrame, alpha: float = 0.1) -> DataFrame:
    """Positive weights of each source scaled to 1 - alpha within its layer and with basis nodes, to alpha across layers.

    A source without one of the classes keeps a row sum of alpha or 1 - alpha.
    """
    if not 0 <= alpha <= 1:
        raise ValueError("alpha must be in [0, 1]")
    inter = F.coalesce(F.col("src_layer") != F.col("dst_layer"), F.lit(False))
    m = multi.filter("w > 0").withColumn("inter", inter)
    total = F.sum("w").over(W.partitionBy("src", "inter"))
    return m.withColumn("w", F.col("w") / total * F.when(F.col("inter"), alpha).otherwise(1 - alpha)).filter("w > 0").select(*COLUMNS)


def row_sums(edges: DataFrame) -> DataFrame:
    """(min_sum, max_sum, mean_sum, stochastic) over the sources with a positive sum."""
    s = edges.groupBy("src").agg(F.sum("w").alias("s")).filter("s > 0")
    return s.agg(F.min("s").alias("min_sum"), F.max("s").alias("max_sum"), F.avg("s").alias("mean_sum"), F.coalesce(F.bool_and(F.abs(F.col("s") - 1) <= 1e-8 + 1e-5), F.lit(True)).alias("stochastic"))


def shadow(regular: DataFrame) -> DataFrame:
    """Regular and shadow nodes: edges of positive sign stay on their side, those of negative sign change it.

    Basis nodes have no shadow: nothing leads from shadows to them, and negative edges to them vanish. Edges of sign 0
    vanish, and weights are not scaled again, so row sums may be below 1.
    """
    e = regular.withColumn("s", F.signum("sw")).filter("s <> 0")
    b, c = F.col("src_layer").isNull(), F.col("dst_layer").isNull()
    neg = lambda x: F.concat(x, F.lit(SHADOW))
    arms = F.explode(F.array(
        F.when(F.col("s") > 0, F.struct(F.col("src").alias("a"), F.col("dst").alias("b"))),
        F.when((F.col("s") < 0) & ~c, F.struct(F.col("src").alias("a"), neg(F.col("dst")).alias("b"))),
        F.when((F.col("s") > 0) & ~b & ~c, F.struct(neg(F.col("src")).alias("a"), neg(F.col("dst")).alias("b"))),
        F.when((F.col("s") < 0) & ~b & ~c, F.struct(neg(F.col("src")).alias("a"), F.col("dst").alias("b"))),
    ))
    e = e.select("src_layer", "dst_layer", "w", arms.alias("x")).filter("x is not null")
    return e.select(F.col("x.a").alias("src"), "src_layer", F.col("x.b").alias("dst"), "dst_layer", "w")


def build(m: DataFrame, g: Graph | None = None, kind: str = "shadow", alpha: float = 0.1, inter: str | K.Kernel = "absolute", inter_sigma: float | None = None, inter_n: float | None = None, order: list[str] | None = None, **layer: object) -> DataFrame:
    """Graph of all layers of measurements: ``plain`` sums, ``transitions`` or ``shadow``; ``layer`` goes to layer_graphs."""
    if kind not in ("plain", "transitions", "shadow"):
        raise ValueError(f"unknown kind {kind!r}")
    g = g or layer_graphs(m, **layer)
    if kind == "shadow" and "sign" not in g.edges.columns:
        raise ValueError("a shadow graph needs the signs of its edges")
    packed = pack(m)
    order = order or sorted(r.layer for r in packed.select("layer").distinct().collect())
    plain = multigraph(g.edges, inter_edges(packed, inter, inter_sigma, inter_n, order), len(order))
    if kind == "plain":
        return plain
    regular = layer_transitions(plain, alpha)
    return regular if kind == "transitions" else shadow(regular)


def clustering_graph(m: DataFrame, g: Graph, method: str = "absolute", n_power: float = 20, sigma: float = 0.05, threshold: float = 0.0, alpha: float = 0.1) -> DataFrame:
    """Transitions whose edges between layers weigh at least ``threshold`` by a named kernel; no layers give no edges."""
    packed = pack(m)
    inter = inter_edges(packed, method, sigma, n_power, threshold=threshold)
    n = packed.select("layer").distinct().count()
    return layer_transitions(multigraph(g.edges, inter, n), alpha)


def top_neighbours(edges: DataFrame, node: str, k: int = 3, incoming: bool = False) -> DataFrame:
    """(node, neighbour, w): the k strongest neighbours of a node."""
    a, b = ("dst", "src") if incoming else ("src", "dst")
    return edges.filter(F.col(a) == node).select(F.col(a).alias("node"), F.col(b).alias("neighbour"), "w").orderBy(F.desc(F.round("w", 9)), "neighbour").limit(k)
