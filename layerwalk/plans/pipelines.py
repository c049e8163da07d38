"""End-to-end questions: from measurements to ranked tables."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import clusters, genes, multilayer, precision, walks
from ..operators.layers import Graph, layer_graphs, percentile_graph
from .stages import materialize
from ..sources.tables import combine_layers


@dataclass
class Settings:
    """Parameters of a run; layers may override ``sigma``."""

    kernel: str = "exponential_abs"
    sigma: float = 0.05
    n_power: float | None = None
    threshold: float = 0.01
    start: str = "e3"
    end: str = "e5"
    kind: str = "shadow"
    alpha: float = 1e-5
    inter: str = "absolute"
    restart: float = 0.0
    n_walks: int = 1000
    min_weight: float = 1e-3
    seed: int = 0
    extra: dict = field(default_factory=dict)


def graph(m: DataFrame, s: Settings) -> tuple[Graph, DataFrame]:
    g = layer_graphs(m, s.kernel, s.sigma, s.n_power, s.threshold, s.start, s.end)
    return g, multilayer.build(m, g, s.kind, s.alpha, s.inter)


def start_to_end(m: DataFrame, s: Settings) -> dict[str, DataFrame]:
    """Walks from start to end until ``n_walks`` succeed: walks, statistics, visits, neighbours of both ends."""
    _, edges = graph(m, s)
    w = walks.walks_until(edges, s.start, s.end, s.n_walks, s.restart, s.min_weight, seed=s.seed)
    return {"walks": w, "statistics": walks.walk_statistics(w), "visits": walks.visit_counts(w), "from_start": multilayer.top_neighbours(edges, s.start), "into_end": multilayer.top_neighbours(edges, s.end, incoming=True)}


def histone_to_rna(m: DataFrame, start: str, s: Settings) -> dict[str, DataFrame]:
    """Walks from a histone node to any RNA node until ``n_walks`` succeed: endpoints by gene, normalised, with their stage ranks."""
    _, edges = graph(m, s)
    w = walks.walks_to_set(edges, start, "rna", s.n_walks, s.restart, s.min_weight, s.seed)
    ends = genes.endpoint_genes(w.filter("success"), m.filter(F.col("layer") != "rna_ai").select("node"))
    return {"walks": w, "endpoints": ends.join(genes.stage_ranking(m).withColumnRenamed("gene", "gene_name"), "gene_name", "left")}


def endpoints(m: DataFrame, a: str, b: str, s: Settings) -> DataFrame:
    """Visit tallies of walks to either of two endpoints."""
    _, edges = graph(m, s)
    return walks.endpoint_tallies(walks.walks_to_endpoints(edges, a, b, s.n_walks, 100_000, s.min_weight, s.restart, s.seed))


def combined_clusters(m: DataFrame, s: Settings, k: int = 5, lam: float = 0.2) -> dict[str, DataFrame]:
    """All layers as one: precision graph, walks, spectral clusters, their composition and the strongest edges.

    ``visited``: clusters with the visits of their nodes on successful walks.
    """
    edges = materialize(precision.lasso_graphs(combine_layers(m), lam, s.threshold, s.start, s.end).edges, "precision")  # solved once
    e = clusters.affinity(edges.select(F.col("layer").alias("graph"), "src", "dst", "w"), "mean")
    lab = clusters.spectral(e, k)
    w = walks.walks_to_target(edges, s.start, s.end, s.n_walks, s.restart, s.min_weight, s.seed)
    visits = walks.visit_counts(w).select("node", "visits")
    visited = lab.join(visits, "node", "left").withColumn("visits", F.coalesce("visits", F.lit(0)))
    return {"clusters": lab, "visited": visited, "composition": clusters.composition(lab), "walks": w, "strongest": percentile_graph(edges)}
