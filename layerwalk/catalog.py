"""The registered queries over the driver tables, each with its DuckDB counterpart where SQL can express it.

All use the mapping of ``layerwalk.sources.star``. Doubles are rounded to six places in both engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import kernels as K
from .functions import names as N
from .operators import clusters, diffusion, genes, layers, manifest, metrics, multilayer, plotdata, precision, projection, walkers, walks
from .plans import pipelines
from .plans.stages import materialize
from .sources import tables
from .sources.star import measurements, part_series

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

#: Common table expressions of the oracle: measurements, unit vectors, correlations, the default graph.
PRELUDE = """
m AS (
  SELECT CASE l_returnflag WHEN 'R' THEN 'rna_ai' WHEN 'A' THEN 'k9me2' ELSE 'k20me3' END AS layer,
    CASE WHEN l_returnflag = 'R' THEN p_brand ELSE p_brand || '*' || p_type END AS node, (year(l_shipdate) - 1995)::INT AS t, sum(l_quantity) AS v
  FROM lineitem JOIN part ON p_partkey = l_partkey WHERE year(l_shipdate) BETWEEN 1995 AND 1999 GROUP BY ALL
), f AS (
  SELECT n.layer, n.node, s.t, coalesce(m.v, 0) AS v FROM (SELECT DISTINCT layer, node FROM m) n CROSS JOIN (SELECT DISTINCT t FROM m) s LEFT JOIN m USING (layer, node, t)
), z AS (
  SELECT layer, node, t, v, (v - avg(v) OVER w) / nullif(stddev_samp(v) OVER w, 0) AS z FROM f WINDOW w AS (PARTITION BY layer, node)
), u AS (SELECT layer, node, t, z / 2 AS u FROM z WHERE z IS NOT NULL
), ub AS (
  SELECT * FROM u UNION ALL
  SELECT l.layer, 'e' || (i + 1), k::INT, ((i = k)::INT - 0.2) / sqrt(0.8) FROM (SELECT DISTINCT layer FROM f) l, range(5) a(i), range(5) b(k)
), cn AS (
  SELECT a.layer, a.node AS src, b.node AS dst, sum(a.u * b.u) AS c FROM u a JOIN u b ON a.layer = b.layer AND a.t = b.t AND a.node <> b.node GROUP BY ALL
), cb AS (
  SELECT a.layer, a.node AS src, b.node AS dst, sum(a.u * b.u) AS c FROM ub a JOIN ub b ON a.layer = b.layer AND a.t = b.t AND a.node <> b.node GROUP BY ALL
), e0 AS (SELECT layer, src, dst, exp(-(1 - abs(c)) / 0.05) AS w, sign(c)::INT AS sign FROM cb
), e AS (SELECT * FROM e0 WHERE w >= 0.01 AND src NOT IN ('e1', 'e2', 'e4') AND dst NOT IN ('e1', 'e2', 'e4')
), n AS (SELECT DISTINCT layer, node FROM f UNION SELECT DISTINCT layer, node FROM ub)
"""
MULTI = """
, ie AS (
  SELECT a.node || '_' || a.layer AS src, a.layer AS sl, b.node || '_' || b.layer AS dst, b.layer AS dl, sum(a.u * b.u) AS c
  FROM u a JOIN u b ON a.t = b.t AND a.layer < b.layer AND contains(b.node, split_part(a.node, '*', 1)) GROUP BY a.node, a.layer, b.node, b.layer
), ii AS (SELECT src, sl, dst, dl, c FROM ie UNION ALL SELECT dst, dl, src, sl, c FROM ie
), named AS (
  SELECT CASE WHEN src LIKE 'e_' THEN src ELSE src || '_' || layer END AS src, CASE WHEN src NOT LIKE 'e_' THEN layer END AS sl,
    CASE WHEN dst LIKE 'e_' THEN dst ELSE dst || '_' || layer END AS dst, CASE WHEN dst NOT LIKE 'e_' THEN layer END AS dl, w, w * sign AS sw FROM e
), g AS (
  SELECT src, sl, dst, dl, sum(w) AS w, sum(sw) AS sw FROM named WHERE NOT (src = dst) GROUP BY ALL
  UNION ALL SELECT src, sl, dst, dl, abs(c), c FROM ii
), ga AS (
  SELECT src, sl, dst, dl, sw, w / sum(w) OVER (PARTITION BY src, coalesce(sl <> dl, false)) * CASE WHEN coalesce(sl <> dl, false) THEN 0.5 ELSE 0.5 END AS w FROM g WHERE w > 0
), sh AS (
  SELECT src, dst, w FROM ga WHERE sw > 0
  UNION ALL SELECT src, dst || '_neg', w FROM ga WHERE sw < 0 AND dl IS NOT NULL
  UNION ALL SELECT src || '_neg', dst || '_neg', w FROM ga WHERE sw > 0 AND sl IS NOT NULL AND dl IS NOT NULL
  UNION ALL SELECT src || '_neg', dst, w FROM ga WHERE sw < 0 AND sl IS NOT NULL AND dl IS NOT NULL
)
"""


def query(name: str, sql: str | None = None, multi: bool = False, more: str = "", plain: bool = False, recursive: bool = False) -> Callable[[Query], Query]:
    """Registers a query; ``sql`` follows the prelude, with ``more`` common table expressions between."""

    def add(f: Query) -> Query:
        _QUERIES[name] = f
        if sql:
            ctes = "" if plain else PRELUDE + (MULTI if multi else "") + (f", {more}" if more else "")
            _SQL[name] = sql if plain else f"WITH {'RECURSIVE ' if recursive else ''}{ctes}\n{sql}"
        return f

    return add


def _r(*cols: str) -> list:
    return [(F.round(c, 6) + 0.0).alias(c) for c in cols]


def _graph(s: SparkSession, d: str) -> layers.Graph:
    return layers.layer_graphs(measurements(s, d))


def _plain(s: SparkSession, d: str) -> layers.Graph:
    return layers.layer_graphs(measurements(s, d), basis=False)


def _multi(s: SparkSession, d: str, kind: str = "transitions") -> DataFrame:
    return multilayer.build(measurements(s, d), kind=kind, alpha=0.5)


#: The graph of parts, all pairs.
_PARTS = """WITH m AS (SELECT l_returnflag AS layer, l_partkey::VARCHAR AS node, year(l_shipdate) - 1995 AS t, sum(l_quantity) AS v FROM lineitem WHERE year(l_shipdate) BETWEEN 1995 AND 1999 GROUP BY ALL),
f AS (SELECT n.layer, n.node, s.t, coalesce(m.v, 0) AS v FROM (SELECT DISTINCT layer, node FROM m) n CROSS JOIN (SELECT DISTINCT t FROM m) s LEFT JOIN m USING (layer, node, t)),
z AS (SELECT layer, node, t, (v - avg(v) OVER w) / nullif(stddev_samp(v) OVER w, 0) / 2 AS u FROM f WINDOW w AS (PARTITION BY layer, node)),
p AS (SELECT layer, node, list(u ORDER BY t) AS u FROM z WHERE u IS NOT NULL GROUP BY ALL),
c AS (SELECT a.layer, a.node AS src, b.node AS dst, list_sum(list_transform(range(1, len(a.u) + 1), lambda i: a.u[i] * b.u[i])) AS c FROM p a JOIN p b ON a.layer = b.layer AND a.node < b.node)
"""


# -- sources, naming, standardisation --------------------------------------------------------------------------------


@query("row_standardize", "SELECT layer, node, t, v AS value, round(z, 6) + 0.0 AS z FROM z")
def _(s, d):
    return layers.standardize_rows(measurements(s, d)).select("layer", "node", "t", "value", *_r("z"))


@query("layer_naming", """SELECT k AS file, CASE WHEN lower(k) LIKE '%rna%' THEN 'rna_ai' WHEN lower(k) LIKE '%k9me2%' THEN 'k9me2' WHEN lower(k) LIKE '%k20me3%' THEN 'k20me3' WHEN lower(k) LIKE '%k27me3%' THEN 'k27me3' ELSE k END AS layer,
  CASE WHEN k LIKE '%k9me2%' THEN 'k9me2' WHEN k LIKE '%k20me3%' THEN 'k20me3' WHEN k LIKE '%rna%' THEN 'rna_ai' ELSE k END AS endpoint_layer
FROM (SELECT DISTINCT p_name || CASE p_partkey % 6 WHEN 0 THEN '_RNA_ai' WHEN 1 THEN '_k9me2' WHEN 2 THEN '_K20me3_rna' WHEN 3 THEN '_k27me3' WHEN 4 THEN '_K9ME2' ELSE '' END AS k FROM part)""", plain=True)  # fmt: skip
def _(s, d):
    p = s.read.parquet(f"{d}/part.parquet")
    tail = F.element_at(F.array(*map(F.lit, ("_RNA_ai", "_k9me2", "_K20me3_rna", "_k27me3", "_K9ME2", ""))), (F.col("p_partkey") % 6 + 1).cast("int"))
    k = p.select(F.concat("p_name", tail).alias("file")).distinct()
    return k.select("file", N.canonical_layer(F.col("file")).alias("layer"), N.canonical_layer(F.col("file"), "endpoint").alias("endpoint_layer"))


@query("source_labels", """WITH k AS (SELECT DISTINCT 'overlap_filtered_' || CASE p_size % 3 WHEN 0 THEN 'rna_' || p_size ELSE lower(p_brand) END || '_m_v2.csv' AS f FROM part),
l AS (SELECT f, regexp_extract(f, '^overlap_filtered_(.+)_m_v2\\.csv$', 1) AS t FROM k),
b AS (SELECT f, CASE WHEN contains(t, 'rna') THEN 'RNA' ELSE upper(t[1]) || t[2:] END AS label FROM l)
SELECT f AS file_name, CASE WHEN row_number() OVER (PARTITION BY label ORDER BY f) = 1 THEN label ELSE label || '_' || regexp_replace(f, '\\.csv$', '') END AS label FROM b""", plain=True)  # fmt: skip
def _(s, d):
    p = s.read.parquet(f"{d}/part.parquet")
    t = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("rna_"), F.col("p_size"))).otherwise(F.lower("p_brand"))
    return tables.source_labels(p.select(F.concat(F.lit("overlap_filtered_"), t, F.lit("_m_v2.csv")).alias("file_name")).distinct())


@query("integer_labels", """SELECT k AS label, coalesce(try_cast(k AS DOUBLE) % 1 = 0, false) AS is_integer, coalesce(try_cast(k AS DOUBLE), try_cast(list_last(regexp_extract_all(k, '(-?\\d+(?:\\.\\d+)?)', 1)) AS DOUBLE)) AS t
FROM (SELECT DISTINCT CASE p_size % 4 WHEN 0 THEN p_size::VARCHAR WHEN 1 THEN p_size || '.5' WHEN 2 THEN 'day ' || p_size || '.0' ELSE p_type END AS k FROM part)""", plain=True)  # fmt: skip
def _(s, d):
    z = F.col("p_size").cast("string")
    k = F.when(F.col("p_size") % 4 == 0, z).when(F.col("p_size") % 4 == 1, F.concat(z, F.lit(".5"))).when(F.col("p_size") % 4 == 2, F.concat(F.lit("day "), z, F.lit(".0"))).otherwise(F.col("p_type"))
    k = s.read.parquet(f"{d}/part.parquet").select(k.alias("label")).distinct()
    return k.select("label", N.is_integer_like(F.col("label")).alias("is_integer"), N.time_of_label(F.col("label")).alias("t"))


@query("time_axis", """WITH k AS (SELECT DISTINCT p_size AS pos, 'day ' || p_size || CASE WHEN p_size % 2 = 0 THEN '.5 h' ELSE '' END AS label FROM part)
SELECT label, pos, list_last(regexp_extract_all(label, '(-?\\d+(?:\\.\\d+)?)', 1))::DOUBLE AS t FROM k""", plain=True)  # fmt: skip
def _(s, d):
    z = F.col("p_size")
    k = s.read.parquet(f"{d}/part.parquet").select(z.alias("pos"), F.concat(F.lit("day "), z.cast("string"), F.when(z % 2 == 0, ".5 h").otherwise("")).alias("label")).distinct()
    return genes.time_axis(k).select("label", "pos", "t")


@query("combined_layers", "SELECT 'combined' AS layer, node || '_' || layer AS node, t, v AS value, round(z, 6) + 0.0 AS z FROM z")
def _(s, d):
    return layers.standardize_rows(tables.combine_layers(measurements(s, d))).select("layer", "node", "t", "value", *_r("z"))


@query("top_variance_nodes", "SELECT node, round(var_samp(v), 6) + 0.0 AS variance FROM f WHERE layer = 'k9me2' GROUP BY node ORDER BY round(var_samp(v), 9) DESC, node LIMIT 20")
def _(s, d):
    return precision.top_variance(measurements(s, d), "k9me2", 20).select("node", *_r("variance"))


# -- kernels ---------------------------------------------------------------------------------------------------------

_KERNEL_SQL = {
    "power": ("pow(abs(0.5 * (c + 1)), 30)", dict(kernel="power", n=30)), "gauss_shifted": ("exp(-0.5 * pow((1 - 0.5 * (c + 1)) / 0.05, 2))", dict(kernel="gaussian_shifted", sigma=0.05)),
    "exp_shifted": ("exp(-(1 - 0.5 * (c + 1)) / 0.05)", dict(kernel="exponential_shifted", sigma=0.05)), "gauss_abs": ("exp(-0.5 * pow((1 - abs(c)) / 0.05, 2))", dict(kernel="gaussian_abs", sigma=0.05)),
    "exp_abs": ("exp(-(1 - abs(c)) / 0.01)", dict(kernel="exponential_abs", sigma=0.01)), "abs": ("abs(c)", dict(kernel="absolute")),
}


def _kernel_query(name: str, sql: str, args: dict) -> None:
    @query(f"kernel_{name}", f"SELECT layer, src, dst, round({sql}, 6) + 0.0 AS w FROM cn WHERE src < dst")
    def _(s, d):
        c = layers.correlations(layers.pack(measurements(s, d)))
        return c.select("layer", "src", "dst", K.apply(args["kernel"], F.col("c"), args.get("sigma"), args.get("n")).alias("w")).select("layer", "src", "dst", *_r("w"))


for _name, (_sql, _args) in _KERNEL_SQL.items():
    _kernel_query(_name, _sql, _args)


@query("kernel_corr_sign", "SELECT layer, src, dst, sign(c)::INT AS sign, CASE WHEN c > 0.1 THEN 1 WHEN c < -0.1 THEN -1 ELSE 0 END AS thresholded FROM cn WHERE src < dst")
def _(s, d):
    c = layers.correlations(layers.pack(measurements(s, d)))
    return c.select("layer", "src", "dst", K.sign(F.col("c")).alias("sign"), K.thresholded_sign(F.col("c")).alias("thresholded"))


# -- layer graphs ----------------------------------------------------------------------------------------------------


def _edges(g: layers.Graph) -> DataFrame:
    return g.edges.select("layer", "src", "dst", *_r("w"), "sign")


@query("top_strength_nodes", "SELECT layer, src AS node, round(sum(w), 6) + 0.0 AS strength FROM e GROUP BY layer, src ORDER BY round(sum(w), 9) DESC, layer, node LIMIT 20")
def _(s, d):
    t = _graph(s, d).edges.groupBy("layer", F.col("src").alias("node")).agg(F.sum("w").alias("strength"))
    return t.orderBy(F.desc(F.round("strength", 9)), "layer", "node").limit(20).select("layer", "node", *_r("strength"))


@query("layer_graph_exp", "SELECT layer, src, dst, round(exp(-(1 - abs(c)) / 0.05), 6) + 0.0 AS w, sign(c)::INT AS sign FROM cn WHERE exp(-(1 - abs(c)) / 0.05) >= 0.01")
def _(s, d):
    return _edges(_plain(s, d))


@query("layer_graph_gauss", "SELECT layer, src, dst, round(exp(-0.5 * pow((1 - abs(c)) / 0.05, 2)), 6) + 0.0 AS w, sign(c)::INT AS sign FROM cn WHERE exp(-0.5 * pow((1 - abs(c)) / 0.05, 2)) >= 0.01")
def _(s, d):
    return _edges(layers.layer_graphs(measurements(s, d), "gaussian_abs", 0.05, basis=False))


@query("layer_graph_power", """SELECT layer, src, dst, round(pow(abs(0.5 * (c + 1)), 30), 6) + 0.0 AS w, sign(c)::INT AS sign FROM cb WHERE pow(abs(0.5 * (c + 1)), 30) >= 0.01
UNION ALL SELECT DISTINCT layer, node, node, 1.0, 1 FROM ub""")  # fmt: skip
def _(s, d):
    return _edges(layers.layer_graphs(measurements(s, d), "power", None, 30, start=None, end=None))


@query("layer_graph_basis_e3_e5", "SELECT layer, src, dst, round(w, 6) + 0.0 AS w, sign FROM e")
def _(s, d):
    return _edges(_graph(s, d))


@query("part_graph", _PARTS + ", e AS (SELECT layer, src, dst, exp(-(1 - abs(c)) / 0.0025) AS w, sign(c)::INT AS sign FROM c)\nSELECT layer, src, dst, round(w, 6) + 0.0 AS w, sign FROM e WHERE w >= 0.01 UNION ALL SELECT layer, dst, src, round(w, 6) + 0.0, sign FROM e WHERE w >= 0.01", plain=True)
def _(s, d):
    g = layers.layer_graphs(part_series(s, d), "exponential_abs", 0.0025, basis=False, prune=True, digits=6)
    return g.edges.select("layer", "src", "dst", "w", "sign")


@query("negative_graph", "SELECT layer, src, dst, round(exp(-0.5 * pow((1 - abs(c)) / 0.5, 2)), 6) + 0.0 AS w, sign(c)::INT AS sign FROM cn WHERE c < -0.3")
def _(s, d):
    return _edges(layers.negative_graphs(measurements(s, d)))


@query("zero_corr_adjacency", "SELECT layer, src, dst, round(pow(abs(0.5 * (c + 1)), 4), 6) + 0.0 AS w, sign(c)::INT AS sign FROM cn")
def _(s, d):
    return _edges(layers.adjacency(measurements(s, d), "power", 4))


@query("transition_weighted", "SELECT layer, src, dst, round(w / sum(w) OVER (PARTITION BY layer, src), 6) + 0.0 AS w FROM e")
def _(s, d):
    return layers.transition(_graph(s, d).edges).select("layer", "src", "dst", *_r("w"))


@query("transition_unweighted", "SELECT layer, src, dst, round(1.0::DOUBLE / count(*) OVER (PARTITION BY layer, src), 6) + 0.0 AS w FROM e")
def _(s, d):
    return layers.transition(_graph(s, d).edges, True).select("layer", "src", "dst", *_r("w"))


_STRONG = """st AS (SELECT n.layer, n.node, coalesce(sum(x.w), 0) AS x FROM n LEFT JOIN (SELECT layer, src AS node, w FROM e WHERE w >= 0.2 UNION ALL SELECT layer, dst, w FROM e WHERE w >= 0.2) x USING (layer, node) GROUP BY ALL),
rk AS (SELECT layer, node, row_number() OVER (PARTITION BY layer ORDER BY round(x, 9) DESC, node) AS k FROM st)"""


@query("top_strength_subgraph", "SELECT e.layer, src, dst, round(w, 6) + 0.0 AS w FROM e JOIN rk a ON a.layer = e.layer AND a.node = src AND a.k <= 15 JOIN rk b ON b.layer = e.layer AND b.node = dst AND b.k <= 15 WHERE w >= 0.2", more=_STRONG)
def _(s, d):
    return layers.strength_subgraph(_graph(s, d), 0.2, 15).edges.select("layer", "src", "dst", *_r("w"))


@query("forced_node_subgraph", "SELECT layer, node FROM rk WHERE k <= 15 OR node IN ('e1', 'e3', 'Brand#11')", more=_STRONG)
def _(s, d):
    return layers.strength_subgraph(_graph(s, d), 0.2, 15, ["e1", "e3", "Brand#11"]).nodes.select("layer", "node")


@query("degree_subgraph", """SELECT layer, node FROM (SELECT n.layer, n.node, row_number() OVER (PARTITION BY n.layer ORDER BY coalesce(x.d, 0) DESC, n.node) AS k FROM n LEFT JOIN (SELECT layer, src AS node, count(*) AS d FROM e WHERE w >= 0.05 GROUP BY ALL) x USING (layer, node)) WHERE k <= 12 OR node IN ('e3', 'e5')""")
def _(s, d):
    return layers.degree_subgraph(_graph(s, d), 0.05, 12, ("e3", "e5")).nodes.select("layer", "node")


@query("strongest_undirected", "SELECT layer, least(src, dst) AS a, greatest(src, dst) AS b, round(max(w), 6) + 0.0 AS w FROM e GROUP BY ALL")
def _(s, d):
    return layers.strongest_undirected(_graph(s, d).edges).select("layer", "a", "b", *_r("w"))


@query("percentile90_graph", "SELECT layer, src, dst, round(w, 6) + 0.0 AS w FROM e JOIN (SELECT layer, quantile_cont(w, 0.9) AS cut FROM e GROUP BY layer) q USING (layer) WHERE w > cut + 1e-12")
def _(s, d):
    return layers.percentile_graph(_graph(s, d).edges).select("layer", "src", "dst", *_r("w"))


_DEGREES = """dg AS (SELECT n.layer, n.node, coalesce(o.c, 0) AS o, coalesce(i.c, 0) AS i FROM n LEFT JOIN (SELECT layer, src AS node, count(*) AS c FROM e GROUP BY ALL) o USING (layer, node) LEFT JOIN (SELECT layer, dst AS node, count(*) AS c FROM e GROUP BY ALL) i USING (layer, node))"""


@query("degree_extremes", """SELECT layer, max(o) AS max_out, first(node ORDER BY o DESC, node) AS max_out_node, min(o) AS min_out, first(node ORDER BY o, node) AS min_out_node,
max(i) AS max_in, first(node ORDER BY i DESC, node) AS max_in_node, min(i) AS min_in, first(node ORDER BY i, node) AS min_in_node FROM dg GROUP BY layer""", more=_DEGREES)  # fmt: skip
def _(s, d):
    return layers.degree_extremes(_graph(s, d))


@query("graph_statistics", """SELECT layer, count(DISTINCT a) AS n, round(min(w), 6) + 0.0 AS min_w, round(max(w), 6) + 0.0 AS max_w, round(avg(w), 6) + 0.0 AS mean_w, round(median(w), 6) + 0.0 AS median_w FROM dense GROUP BY layer""",
       more="dense AS (SELECT x.layer, x.node AS a, y.node AS b, coalesce(c.c, 0) AS w FROM (SELECT DISTINCT layer, node FROM f) x JOIN (SELECT DISTINCT layer, node FROM f) y USING (layer) LEFT JOIN cn c ON c.layer = x.layer AND c.src = x.node AND c.dst = y.node)")
def _(s, d):
    p = layers.pack(measurements(s, d))
    e = layers.mirror(layers.correlations(p).select("layer", "src", "dst", F.col("c").alias("w")))
    return layers.graph_statistics(layers.Graph(e, p.select("layer", "node"))).select("layer", "n", *_r("min_w", "max_w", "mean_w", "median_w"))


@query("basis_attach_topk", """SELECT layer, src, dst, round(w, 6) + 0.0 AS w, sign FROM (
  SELECT layer, src, dst, w, sign FROM e WHERE src NOT LIKE 'e_' AND dst NOT LIKE 'e_' UNION ALL
  SELECT layer, src, dst, 1.0, CASE WHEN c < 0 THEN -1 ELSE 1 END FROM tk WHERE k <= 3 UNION ALL SELECT layer, dst, src, 1.0, CASE WHEN c < 0 THEN -1 ELSE 1 END FROM tk WHERE k <= 3)""",
       more="tk AS (SELECT *, row_number() OVER (PARTITION BY layer, src ORDER BY round(c, 12) DESC, dst) AS k FROM cb WHERE src LIKE 'e_' AND dst NOT LIKE 'e_')")
def _(s, d):
    m = measurements(s, d)
    return _edges(layers.attach_basis(layers.layer_graphs(m), layers.pack(m)))


# -- multilayer graphs -----------------------------------------------------------------------------------------------


@query("inter_layer_substring_join", "SELECT src, dst, round(abs(c), 6) + 0.0 AS w FROM ii", multi=True)
def _(s, d):
    return multilayer.inter_edges(layers.pack(measurements(s, d))).select("src", "dst", *_r("w"))


@query("inter_layer_kernel_threshold", "SELECT src, dst, round(pow(abs(0.5 * (c + 1)), 20), 6) + 0.0 AS w FROM ii WHERE pow(abs(0.5 * (c + 1)), 20) >= 0.05", multi=True)
def _(s, d):
    return multilayer.inter_edges(layers.pack(measurements(s, d)), "power", n=20, threshold=0.05).select("src", "dst", *_r("w"))


@query("multigraph", "SELECT src, dst, round(w, 6) + 0.0 AS w FROM g", multi=True)
def _(s, d):
    return _multi(s, d, "plain").select("src", "dst", *_r("w"))


@query("multigraph_alpha", "SELECT src, dst, round(w, 6) + 0.0 AS w FROM ga", multi=True)
def _(s, d):
    return _multi(s, d).select("src", "dst", *_r("w"))


@query("shadow_multigraph", "SELECT src, dst, round(w, 6) + 0.0 AS w FROM sh", multi=True)
def _(s, d):
    return _multi(s, d, "shadow").select("src", "dst", *_r("w"))


@query("row_sum_check", "SELECT round(min(s), 6) + 0.0 AS min_sum, round(max(s), 6) + 0.0 AS max_sum, round(avg(s), 6) + 0.0 AS mean_sum, bool_and(abs(s - 1) <= 1.001e-5) AS stochastic FROM (SELECT sum(w) AS s FROM ga GROUP BY src)", multi=True)
def _(s, d):
    return multilayer.row_sums(_multi(s, d)).select(*_r("min_sum", "max_sum", "mean_sum"), "stochastic")


@query("clustering_multigraph", """SELECT src, dst, round(w / sum(w) OVER (PARTITION BY src, x) * CASE WHEN x THEN 0.1 ELSE 0.9 END, 6) + 0.0 AS w FROM (
  SELECT src, dst, w, coalesce(sl <> dl, false) AS x FROM g WHERE NOT (coalesce(sl <> dl, false) AND w < 0.3))""", multi=True)  # fmt: skip
def _(s, d):
    m = measurements(s, d)
    return multilayer.clustering_graph(m, layers.layer_graphs(m), "absolute", threshold=0.3).select("src", "dst", *_r("w"))


@query("top_neighbours", "SELECT 'e3' AS node, dst AS neighbour, round(w, 6) + 0.0 AS w FROM ga WHERE src = 'e3' ORDER BY round(ga.w, 9) DESC, dst LIMIT 5", multi=True)
def _(s, d):
    return multilayer.top_neighbours(_multi(s, d), "e3", 5).select("node", "neighbour", *_r("w"))


# -- metrics ---------------------------------------------------------------------------------------------------------

_K = "k AS (SELECT n.layer, n.node, coalesce(sum(e.w), 0) AS k FROM n LEFT JOIN e ON e.layer = n.layer AND e.src = n.node GROUP BY ALL)"


@query("mean_degree", "SELECT layer, round(avg(k), 6) + 0.0 AS mean_degree FROM k GROUP BY layer", more=_K)
def _(s, d):
    return metrics.mean_degree(_graph(s, d)).select("layer", *_r("mean_degree"))


@query("isolated_nodes", "SELECT layer, count(*) FILTER (WHERE abs(k) <= 0.01) AS isolated FROM k GROUP BY layer", more=_K)
def _(s, d):
    return metrics.isolated_nodes(_graph(s, d))


@query("sparsity", "SELECT layer, round(1 - coalesce(m, 0) / (c * (c - 1))::DOUBLE, 6) + 0.0 AS sparsity FROM (SELECT layer, count(*) AS c FROM n GROUP BY layer) LEFT JOIN (SELECT layer, count(*) FILTER (WHERE w > 0.01) AS m FROM e GROUP BY layer) USING (layer)")
def _(s, d):
    return metrics.sparsity(_graph(s, d)).select("layer", *_r("sparsity"))


_TRI = """tri AS (SELECT a.layer, a.src AS node, sum(a.w * b.w * c.w) AS num FROM e a JOIN e b ON b.layer = a.layer AND b.src = a.dst AND b.dst <> a.src JOIN e c ON c.layer = a.layer AND c.src = b.dst AND c.dst = a.src GROUP BY ALL),
den AS (SELECT layer, src AS node, pow(sum(w), 2) - sum(w * w) AS den FROM e GROUP BY ALL), top AS (SELECT layer, max(w) AS top FROM e GROUP BY layer)"""


@query("clustering_coefficient", "SELECT layer, round(avg(CASE WHEN den > 1e-15 THEN coalesce(num, 0) / den / top ELSE 0 END), 6) + 0.0 AS clustering FROM n LEFT JOIN tri USING (layer, node) LEFT JOIN den USING (layer, node) LEFT JOIN top USING (layer) GROUP BY layer", more=_TRI)
def _(s, d):
    return metrics.clustering_coefficient(_graph(s, d)).select("layer", *_r("clustering"))


@query("clustering_coefficient_directed", """SELECT layer, round(avg(CASE WHEN den > 1e-15 THEN coalesce(num, 0) / den / top ELSE 0 END), 6) + 0.0 AS clustering FROM (SELECT DISTINCT layer, node FROM f) LEFT JOIN dnum USING (layer, node) LEFT JOIN dden USING (layer, node)
LEFT JOIN (SELECT graph AS layer, max(w) AS top FROM tr GROUP BY graph) USING (layer) GROUP BY layer""",
       more="""tr AS (SELECT layer AS graph, src, dst, w / sum(w) OVER (PARTITION BY layer, src) AS w FROM (SELECT layer, src, dst, exp(-(1 - abs(c)) / 0.05) AS w FROM cn) WHERE w >= 0.01),
dnum AS (SELECT a.graph AS layer, a.src AS node, sum(a.w * b.w * c.w) AS num FROM tr a JOIN tr b ON b.graph = a.graph AND b.src = a.dst AND b.dst <> a.src JOIN tr c ON c.graph = a.graph AND c.src = b.dst AND c.dst = a.src GROUP BY ALL),
dden AS (SELECT a.layer, a.node, a.o * coalesce(b.i, 0) - coalesce(c.x, 0) AS den FROM (SELECT graph AS layer, src AS node, sum(w) AS o FROM tr GROUP BY ALL) a LEFT JOIN (SELECT graph AS layer, dst AS node, sum(w) AS i FROM tr GROUP BY ALL) b USING (layer, node)
  LEFT JOIN (SELECT a.graph AS layer, a.src AS node, sum(a.w * b.w) AS x FROM tr a JOIN tr b ON b.graph = a.graph AND b.src = a.dst AND b.dst = a.src GROUP BY ALL) c USING (layer, node))""")  # fmt: skip
def _(s, d):
    g = _plain(s, d)
    return metrics.clustering_coefficient(layers.Graph(layers.transition(g.edges), g.nodes)).select("layer", *_r("clustering"))


_FIT = """kp AS (SELECT *, min(k) OVER w AS lo, max(k) OVER w AS hi, count(*) OVER w AS c FROM k WHERE k > 0 WINDOW w AS (PARTITION BY layer)),
bn AS (SELECT layer, c, log10(avg(k)) AS x, log10(count(*) / c::DOUBLE) AS y FROM kp GROUP BY layer, c, CASE WHEN hi > lo THEN least(floor((k - lo) / (hi - lo) * 10), 9) ELSE 0 END)"""


@query("scale_free_fit", "SELECT layer, round(regr_r2(y, x), 6) + 0.0 AS r2, round(regr_slope(y, x), 6) + 0.0 AS slope, c AS n_points FROM bn GROUP BY layer, c", more=f"{_K}, {_FIT}")
def _(s, d):
    return metrics.scale_free_fit(_graph(s, d)).select("layer", *_r("r2", "slope"), "n_points")


def _sweep_sql(weight: str, values: str) -> dict[str, str]:
    """SQL of all metrics of every layer at every value of ``param``, and what it builds on."""
    return {
        "sql": """SELECT layer, param, round(md, 6) + 0.0 AS mean_degree, iso AS isolated, round(1 - coalesce(m, 0) / (c * (c - 1))::DOUBLE, 6) + 0.0 AS sparsity, round(cl, 6) + 0.0 AS clustering, round(r2, 6) + 0.0 AS r2, slope_sign, n_points FROM (
  SELECT layer, param, avg(k) AS md, count(*) FILTER (WHERE abs(k) <= 0.01) AS iso, count(*) AS c, avg(CASE WHEN den > 1e-15 THEN coalesce(num, 0) / den / top ELSE 0 END) AS cl
  FROM swk LEFT JOIN swt USING (layer, node, param) LEFT JOIN swtop USING (layer, param) GROUP BY ALL)
LEFT JOIN (SELECT layer, param, count(*) FILTER (WHERE w > 0.01) AS m FROM sw GROUP BY ALL) USING (layer, param)
LEFT JOIN (SELECT layer, param, CASE WHEN c >= 3 THEN regr_r2(y, x) END AS r2, CASE WHEN c >= 3 THEN sign(regr_slope(y, x))::DOUBLE END AS slope_sign, c AS n_points FROM swb GROUP BY layer, param, c) USING (layer, param)""",
        "more": f"""ps AS (SELECT unnest({values})::DOUBLE AS param), sw AS (SELECT * FROM (SELECT layer, src, dst, param, {weight} AS w FROM cn, ps) WHERE w >= 0.01),
swk AS (SELECT x.layer, x.node, p.param, coalesce(sum(s.w), 0) AS k, coalesce(sum(s.w), 0) ** 2 - coalesce(sum(s.w * s.w), 0) AS den FROM (SELECT DISTINCT layer, node FROM f) x CROSS JOIN ps p LEFT JOIN sw s ON s.layer = x.layer AND s.src = x.node AND s.param = p.param GROUP BY ALL),
swt AS (SELECT a.layer, a.src AS node, a.param, sum(a.w * b.w * c.w) AS num FROM sw a JOIN sw b ON b.layer = a.layer AND b.param = a.param AND b.src = a.dst AND b.dst <> a.src
  JOIN sw c ON c.layer = a.layer AND c.param = a.param AND c.src = b.dst AND c.dst = a.src GROUP BY ALL),
swtop AS (SELECT layer, param, max(w) AS top FROM sw GROUP BY ALL),
swp AS (SELECT *, min(k) OVER w AS lo, max(k) OVER w AS hi, count(*) OVER w AS c FROM swk WHERE k > 0 WINDOW w AS (PARTITION BY layer, param)),
swb AS (SELECT layer, param, c, log10(avg(k)) AS x, log10(count(*) / c::DOUBLE) AS y FROM swp GROUP BY layer, param, c, CASE WHEN hi > lo THEN least(floor((k - lo) / (hi - lo) * 10), 9) ELSE 0 END)""",
    }


def _swept(t):
    return t.select("layer", "param", *_r("mean_degree"), "isolated", *_r("sparsity", "clustering", "r2"), "slope_sign", "n_points")


@query("sigma_sweep_metrics", **_sweep_sql("exp(-(1 - abs(c)) / param)", "[i / 2500 for i in range(1, 51)]"))
def _(s, d):
    return _swept(metrics.sweep(measurements(s, d), "exponential_abs", "sigma", [i / 2500 for i in range(1, 51)]))


@query("power_sweep_metrics", **_sweep_sql("abs(0.5 * (c + 1)) ** param", "range(10, 41)"))
def _(s, d):
    return _swept(metrics.sweep(measurements(s, d), "power", "n", [float(n) for n in range(10, 41)]))


@query("symmetry_check", "SELECT layer, true AS is_symmetric, 0.0::DOUBLE AS max_asymmetry FROM e GROUP BY layer")
def _(s, d):
    return metrics.symmetry(_graph(s, d).edges).select("layer", "is_symmetric", *_r("max_asymmetry"))


@query("element_range", "SELECT layer, 0.0::DOUBLE AS min_w, round(max(w), 6) + 0.0 AS max_w, round(max(w), 6) + 0.0 AS range_w, false AS has_nan, false AS has_inf FROM e GROUP BY layer")
def _(s, d):
    return metrics.element_range(_graph(s, d)).select("layer", *_r("min_w", "max_w", "range_w"), "has_nan", "has_inf")


# -- centrality and diffusion ----------------------------------------------------------------------------------------

_NODES = "nn AS (SELECT src AS node FROM ga UNION SELECT dst FROM ga)"


@query("pagerank_fixed_iters", "SELECT node, round(x, 6) + 0.0 AS score FROM pr WHERE i = 40", multi=True, recursive=True,
       more=f"""{_NODES}, nc AS (SELECT count(*) AS c FROM nn), pm AS (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS p FROM ga),
dn AS (SELECT node, node NOT IN (SELECT src FROM pm) AS dead FROM nn),
pr AS (SELECT 0 AS i, node, 1.0::DOUBLE / c AS x FROM nn, nc UNION ALL
  SELECT i, node, 0.85 * (sum(x) + sum(y) / max(c)) + 0.15 / max(c) FROM (
    SELECT pr.i + 1 AS i, pm.dst AS node, pr.x * pm.p AS x, 0.0::DOUBLE AS y FROM pr JOIN pm ON pm.src = pr.node WHERE pr.i < 40
    UNION ALL SELECT pr.i + 1, nn.node, 0.0, CASE WHEN dn.dead THEN pr.x ELSE 0 END FROM pr JOIN dn USING (node), nn WHERE pr.i < 40), nc GROUP BY i, node)""")  # fmt: skip
def _(s, d):
    return diffusion.pagerank(_multi(s, d), iterations=40, tol=0.0).select("node", *_r("score"))


@query("eigenvector_fixed_iters", "SELECT node, round(x / sqrt(sum(x * x) OVER ()), 6) + 0.0 AS score FROM ev WHERE i = 30", multi=True, recursive=True,
       more=f"""{_NODES}, ev AS (SELECT 0 AS i, node, 1.0::DOUBLE AS x FROM nn UNION ALL
  SELECT i, node, sum(x) FROM (SELECT i + 1 AS i, node, x FROM ev WHERE i < 30 UNION ALL SELECT ev.i + 1, ga.dst, ev.x * ga.w FROM ev JOIN ga ON ga.src = ev.node WHERE i < 30) GROUP BY i, node)""")  # fmt: skip
def _(s, d):
    return diffusion.eigenvector(_multi(s, d), iterations=30, tol=0.0).select("node", *_r("score"))


@query("degree_centrality", "SELECT node, count(*) AS degree FROM (SELECT src AS node FROM ga UNION ALL SELECT dst FROM ga) GROUP BY node", multi=True)
def _(s, d):
    return diffusion.degree_centrality(_multi(s, d))


@query("centralities")
def _(s, d):
    return diffusion.centralities(_multi(s, d, "shadow"))


_SERIES = """SELECT 0 AS i, '{start}' AS node, 1.0::DOUBLE AS x UNION ALL SELECT q.i + 1, {to}, 0.7 * sum(q.x * a.w) FROM {name} q JOIN {edges} a ON a.{by} = q.node WHERE q.i < 80 GROUP BY q.i, {to}"""


@query("local_neighbourhood", "SELECT nn.node, round(coalesce(sum(x), 0), 6) + 0.0 AS score FROM nn LEFT JOIN sr ON sr.node = nn.node GROUP BY nn.node", multi=True, recursive=True,
       more=f"{_NODES}, sr AS ({_SERIES.format(start='Brand#11_rna_ai', to='a.dst', name='sr', edges='ga', by='src')})")
def _(s, d):
    return diffusion.local_neighbourhood(_multi(s, d), "Brand#11_rna_ai").select("node", *_r("score"))


@query("start_to_end_path", """SELECT nn.node, round(coalesce(h.x, 0) * coalesce(f.x, 0) / (SELECT sum(x) FROM bw WHERE node = 'e3'), 6) + 0.0 AS score FROM nn
LEFT JOIN (SELECT node, sum(x) AS x FROM fw GROUP BY node) f ON f.node = nn.node LEFT JOIN (SELECT node, sum(x) AS x FROM bw GROUP BY node) h ON h.node = nn.node WHERE nn.node <> 'e5'""", multi=True, recursive=True,
       more=f"""{_NODES}, inn AS (SELECT * FROM ga WHERE src <> 'e5' AND dst <> 'e5'), out5 AS (SELECT * FROM ga WHERE src <> 'e5'),
fw AS ({_SERIES.format(start='e3', to='a.dst', name='fw', edges='inn', by='src')}), bw AS ({_SERIES.format(start='e5', to='a.src', name='bw', edges='out5', by='dst')})""")  # fmt: skip
def _(s, d):
    return diffusion.start_to_end(_multi(s, d), "e3", "e5").select("node", *_r("score"))


#: At this damping the series of raw weights, whose rows sum to more than 1, still converges, so that SQL can sum it.
_RAW = 0.004


@query("local_neighbourhood_raw", "SELECT nn.node, round(coalesce(sum(x), 0), 6) + 0.0 AS score FROM nn LEFT JOIN sr ON sr.node = nn.node GROUP BY nn.node", multi=True, recursive=True,
       more=f"{_NODES}, sr AS ({_SERIES.replace('0.7', str(_RAW)).replace('80', '60').format(start='e3', to='a.dst', name='sr', edges='g', by='src')})")
def _(s, d):
    return diffusion.local_neighbourhood(_multi(s, d, "plain"), "e3", r=_RAW, strategy="distributed").select("node", *_r("score"))


@query("local_neighbourhood_distributed", "SELECT nn.node, round(coalesce(sum(x), 0), 6) + 0.0 AS score FROM nn LEFT JOIN sr ON sr.node = nn.node GROUP BY nn.node", multi=True, recursive=True,
       more=f"{_NODES}, sr AS ({_SERIES.format(start='e3', to='a.dst', name='sr', edges='ga', by='src')})")
def _(s, d):
    return diffusion.local_neighbourhood(_multi(s, d), "e3", strategy="distributed").select("node", *_r("score"))


_GENE_TIME = "gt AS (SELECT layer, split_part(node, '*', 1) AS gene, avg(x) AS mean_time FROM (SELECT layer, node, sum(abs(v) * t) / nullif(sum(abs(v)), 0) AS x FROM f GROUP BY ALL) GROUP BY ALL)"


@query("cluster_comparison", """SELECT gene, round(sc, 6) + 0.0 AS score, round(sc * CASE WHEN max(x) OVER () > min(x) OVER () THEN 0.5 + 0.5 * (x - min(x) OVER ()) / (max(x) OVER () - min(x) OVER ()) ELSE 1 END, 6) + 0.0 AS score_weighted,
  round(h.mean_time, 6) + 0.0 AS histone_time, round(r.mean_time, 6) + 0.0 AS rna_time, c AS n_nodes FROM cs
LEFT JOIN (SELECT gene, mean_time FROM gt WHERE layer = 'k9me2') h USING (gene) LEFT JOIN (SELECT gene, mean_time FROM gt WHERE layer = 'rna_ai') r USING (gene)""", recursive=True,
       more=f"""{_GENE_TIME}, l9 AS (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS w FROM e WHERE layer = 'k9me2'), sr AS ({_SERIES.format(start='Brand#11*STANDARD', to='a.dst', name='sr', edges='l9', by='src')}),
ln AS (SELECT src AS node FROM l9 UNION SELECT dst FROM l9),
cs AS (SELECT s.gene, s.sc, s.c, coalesce(x.x, 0) AS x FROM (
  SELECT split_part(node, '*', 1) AS gene, avg(sc) AS sc, count(*) AS c FROM (SELECT ln.node, coalesce(sum(sr.x), 0) AS sc FROM ln LEFT JOIN sr USING (node) WHERE ln.node NOT LIKE 'e_' GROUP BY ln.node) GROUP BY 1) s
  SEMI JOIN (SELECT DISTINCT node AS gene FROM f WHERE layer = 'rna_ai') USING (gene) LEFT JOIN (SELECT node AS gene, avg(abs(v)) AS x FROM f WHERE layer = 'rna_ai' GROUP BY node) x USING (gene))""")  # fmt: skip
def _(s, d):
    m = measurements(s, d)
    g = layers.layer_graphs(m)
    nodes = m.select("layer", "node").distinct().select(F.concat_ws("_", "node", "layer").alias("node"))
    out = genes.cluster_comparison(g.edges.filter("layer = 'k9me2'"), "Brand#11*STANDARD", nodes, m, "k9me2")
    return out.select("gene", *_r("score", "score_weighted", "histone_time", "rna_time"), "n_nodes")


@query("pagerank_distributed", "SELECT node, round(x, 6) + 0.0 AS score FROM pr WHERE i = 60", multi=True, recursive=True,
       more=f"""{_NODES}, nc AS (SELECT count(*) AS c FROM nn), pm AS (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS p FROM ga),
pr AS (SELECT 0 AS i, node, 1.0::DOUBLE / c AS x FROM nn, nc UNION ALL
  SELECT i, node, 0.85 * sum(x) + 0.15 / max(c) FROM (
    SELECT pr.i + 1 AS i, pm.dst AS node, pr.x * pm.p AS x FROM pr JOIN pm ON pm.src = pr.node WHERE pr.i < 60
    UNION ALL SELECT pr.i + 1, nn.node, CASE WHEN pr.node IN (SELECT src FROM pm) THEN 0 ELSE pr.x / c END FROM pr, nn, nc WHERE pr.i < 60), nc GROUP BY i, node)""")  # fmt: skip
def _(s, d):
    return diffusion.pagerank(_multi(s, d), iterations=1000, tol=1e-11, strategy="distributed").select("node", *_r("score"))


@query("eigenvector_distributed", "SELECT node, round(x / sqrt(sum(x * x) OVER ()), 6) + 0.0 AS score FROM ev WHERE i = 140", multi=True, recursive=True,
       more=f"""{_NODES}, ev AS (SELECT 0 AS i, node, 1.0::DOUBLE AS x FROM nn UNION ALL
  SELECT i, node, sum(x) FROM (SELECT i + 1 AS i, node, x FROM ev WHERE i < 140 UNION ALL SELECT ev.i + 1, ga.dst, ev.x * ga.w FROM ev JOIN ga ON ga.src = ev.node WHERE i < 140) GROUP BY i, node)""")  # fmt: skip
def _(s, d):
    return diffusion.eigenvector(_multi(s, d), iterations=1000, tol=1e-10, strategy="distributed").select("node", *_r("score"))


@query("start_to_end_distributed", """SELECT nn.node, round(coalesce(h.x, 0) * coalesce(f.x, 0) / (SELECT sum(x) FROM bw WHERE node = 'e3'), 6) + 0.0 AS score FROM nn
LEFT JOIN (SELECT node, sum(x) AS x FROM fw GROUP BY node) f ON f.node = nn.node LEFT JOIN (SELECT node, sum(x) AS x FROM bw GROUP BY node) h ON h.node = nn.node WHERE nn.node <> 'e5'""", multi=True, recursive=True,
       more=f"""{_NODES}, inn AS (SELECT * FROM ga WHERE src <> 'e5' AND dst <> 'e5'), out5 AS (SELECT * FROM ga WHERE src <> 'e5'),
fw AS ({_SERIES.format(start='e3', to='a.dst', name='fw', edges='inn', by='src')}), bw AS ({_SERIES.format(start='e5', to='a.src', name='bw', edges='out5', by='dst')})""")  # fmt: skip
def _(s, d):
    return diffusion.start_to_end(_multi(s, d), "e3", "e5", strategy="distributed").select("node", *_r("score"))


@query("scores_on_positions", "SELECT node || '_' || layer AS node, round(max(v), 6) + 0.0 AS score FROM f WHERE layer = 'rna_ai' GROUP BY node, layer")
def _(s, d):
    m = measurements(s, d)
    sc = m.filter("layer = 'rna_ai'").select("node", F.col("value").alias("score"))
    return genes.scores_on_positions(sc, m.select(F.concat_ws("_", "node", "layer").alias("node")).distinct(), "rna_ai").select("node", *_r("score"))


_NET = """sc AS (SELECT src AS node, sum(w) / 1000 AS k FROM e WHERE layer = 'k9me2' GROUP BY src ORDER BY round(sum(w) / 1000, 9) DESC, src LIMIT 20),
ne AS (SELECT src AS a, dst AS b, w FROM e WHERE layer = 'k9me2' AND src < dst AND src IN (SELECT node FROM sc) AND dst IN (SELECT node FROM sc))"""


@query("centrality_network_nodes", "SELECT node, round((k - min(k) OVER ()) / (max(k) OVER () - min(k) OVER ()), 6) + 0.0 AS scaled, round(500 + 2200 * (k - min(k) OVER ()) / (max(k) OVER () - min(k) OVER ()), 6) + 0.0 AS size FROM sc", more=_NET)
def _(s, d):
    return _network(s, d)[0].select("node", *_r("scaled", "size"))


@query("centrality_network_edges", "SELECT a, b, round(w, 6) + 0.0 AS w, round(0.6 + 3 * (w - min(w) OVER ()) / (max(w) OVER () - min(w) OVER ()), 6) + 0.0 AS width FROM ne", more=_NET)
def _(s, d):
    return _network(s, d)[1].select("a", "b", *_r("w", "width"))


def _network(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = _graph(s, d).edges.filter("layer = 'k9me2'")
    return plotdata.centrality_network(e.groupBy(F.col("src").alias("node")).agg((F.sum("w") / 1000).alias("score")), layers.strongest_undirected(e))


# -- genes -----------------------------------------------------------------------------------------------------------


@query("mean_expression_time", "SELECT layer, gene, round(mean_time, 6) + 0.0 AS mean_time FROM gt", more=_GENE_TIME)
def _(s, d):
    return genes.expression_time(measurements(s, d)).select("layer", "gene", *_r("mean_time"))


@query("gene_trajectories", "SELECT layer, split_part(node, '*', 1) AS gene, t, round(avg(v), 6) + 0.0 AS value FROM f GROUP BY ALL")
def _(s, d):
    return genes.trajectories(measurements(s, d)).select("layer", "gene", "t", *_r("value"))


@query("topn_shared_trajectories", """SELECT split_part(node, '*', 1) AS gene, layer, t, round(avg(v), 6) + 0.0 AS value FROM f WHERE layer IN ('k9me2', 'rna_ai')
  AND split_part(node, '*', 1) IN (SELECT gene FROM gt WHERE layer = 'rna_ai' ORDER BY round(mean_time, 9) DESC, gene LIMIT 10) GROUP BY ALL""", more=_GENE_TIME)  # fmt: skip
def _(s, d):
    m = measurements(s, d)
    sc = genes.expression_time(m).filter("layer = 'rna_ai'").select("gene", F.col("mean_time").alias("score"))
    return genes.top_shared(sc, m, ("k9me2", "rna_ai"), 10).select("gene", "layer", "t", *_r("value"))


@query("coverage", """SELECT g.gene, coalesce(string_agg(l.layer, ',' ORDER BY l.layer) FILTER (WHERE h.gene IS NOT NULL), '') AS found, coalesce(string_agg(l.layer, ',' ORDER BY l.layer) FILTER (WHERE h.gene IS NULL), '') AS missing
FROM (SELECT DISTINCT p_brand AS gene FROM part UNION SELECT r_name FROM region) g CROSS JOIN (SELECT DISTINCT layer FROM f) l LEFT JOIN (SELECT DISTINCT layer, split_part(node, '*', 1) AS gene FROM f) h ON h.gene = g.gene AND h.layer = l.layer GROUP BY g.gene""")  # fmt: skip
def _(s, d):
    g = s.read.parquet(f"{d}/part.parquet").select(F.col("p_brand").alias("gene")).union(s.read.parquet(f"{d}/region.parquet").select("r_name"))
    return genes.coverage(g, measurements(s, d))


@query("stage_ranking", "SELECT gene, " + ", ".join(f"max(t::VARCHAR) FILTER (WHERE k = {k}) AS stage_rank_{k}, round(max(v) FILTER (WHERE k = {k}), 6) + 0.0 AS stage_rank_{k}_expression" for k in range(1, 6))
       + " FROM (SELECT node AS gene, t, v, row_number() OVER (PARTITION BY node ORDER BY v DESC, t) AS k FROM f WHERE layer = 'rna_ai') GROUP BY gene")
def _(s, d):
    r = genes.stage_ranking(measurements(s, d))
    return r.select("gene", *[c for k in range(1, 6) for c in (F.col(f"stage_rank_{k}"), *_r(f"stage_rank_{k}_expression"))])


@query("endpoint_normalization", """SELECT b.gene AS gene_name, c AS walk_count, round(100.0::DOUBLE * c / sum(c) OVER (), 6) + 0.0 AS percentage, coalesce(h, 0) AS histone_count, round(c / greatest(coalesce(h, 0), 1)::DOUBLE, 6) + 0.0 AS normalized_count
FROM (SELECT p_brand AS gene, count(*) AS c FROM part GROUP BY p_brand) b LEFT JOIN (SELECT g.p_brand AS gene, count(*) AS h FROM (SELECT DISTINCT p_brand FROM part) g JOIN (SELECT DISTINCT node FROM f WHERE layer <> 'rna_ai') x ON contains(x.node, g.p_brand) GROUP BY 1) h USING (gene)""")  # fmt: skip
def _(s, d):
    ends = s.read.parquet(f"{d}/part.parquet").select(F.concat("p_brand", F.lit("_rna_ai")).alias("end_node"))
    out = genes.endpoint_genes(ends, measurements(s, d).filter("layer <> 'rna_ai'").select("node"))
    return out.select("gene_name", "walk_count", *_r("percentage"), "histone_count", *_r("normalized_count"))


# -- clusterings -----------------------------------------------------------------------------------------------------


def _affinity_edges(s: SparkSession, d: str) -> DataFrame:
    return layers.transition(_plain(s, d).edges).select(F.col("layer").alias("graph"), "src", "dst", "w")


_TR = "tr AS (SELECT layer AS graph, src, dst, w / sum(w) OVER (PARTITION BY layer, src) AS w FROM (SELECT layer, src, dst, exp(-(1 - abs(c)) / 0.05) AS w FROM cn) WHERE w >= 0.01)"


def _affinity_query(how: str, sql: str) -> None:
    @query(f"affinity_{how}", f"SELECT a.graph, a.src, a.dst, round({sql}, 6) + 0.0 AS w FROM tr a JOIN tr b ON b.graph = a.graph AND b.src = a.dst AND b.dst = a.src", more=_TR)
    def _(s, d):
        return clusters.affinity(_affinity_edges(s, d), how).select("graph", "src", "dst", *_r("w"))


for _how, _sql in (("max", "greatest(a.w, b.w)"), ("mean", "(a.w + b.w) / 2"), ("min", "least(a.w, b.w)")):
    _affinity_query(_how, _sql)


def _labels(s: SparkSession, d: str) -> DataFrame:
    e = s.read.parquet(f"{d}/embeddings.parquet")
    a = e.select(F.lit("label").alias("graph"), F.col("vec_id").cast("string").alias("node"), F.col("label").cast("int").alias("cluster"))
    first = F.when(F.col("embedding")[0] > 0, 1).otherwise(0) + F.when(F.col("embedding")[1] > 0, 2).otherwise(0)
    return a.union(e.select(F.lit("octant"), F.col("vec_id").cast("string"), first.cast("int")))


_CT = """WITH lb AS (SELECT vec_id, label AS a, (embedding[1] > 0)::INT + 2 * (embedding[2] > 0)::INT AS b FROM embeddings),
x AS (SELECT 'label' AS graph, vec_id, a::INT AS c FROM lb UNION ALL SELECT 'octant', vec_id, b FROM lb),
ct AS (SELECT x.graph AS graph_a, y.graph AS graph_b, x.c AS a, y.c AS b, count(*) AS n FROM x JOIN x y USING (vec_id) GROUP BY ALL),
mm AS (SELECT *, sum(n) OVER (PARTITION BY graph_a, graph_b, a) AS na, sum(n) OVER (PARTITION BY graph_a, graph_b, b) AS nb, sum(n) OVER (PARTITION BY graph_a, graph_b) AS tot FROM ct),
mi AS (SELECT graph_a, graph_b, max(tot)::BIGINT AS common, sum(n / tot * ln(n * tot / (na * nb))) AS mi FROM mm GROUP BY ALL),
h AS (SELECT graph, -sum(p * ln(p)) AS h FROM (SELECT graph, count(*) / sum(count(*)) OVER (PARTITION BY graph) AS p FROM x GROUP BY graph, c) GROUP BY graph)
"""


@query("mutual_information", _CT + "SELECT graph_a, graph_b, common, round(greatest(mi, 0), 6) + 0.0 AS mi FROM mi", plain=True)
def _(s, d):
    return clusters.mutual_information(_labels(s, d)).select("graph_a", "graph_b", "common", *_r("mi"))


@query("normalized_mutual_information", _CT + "SELECT graph_a, graph_b, round(mi / ((a.h + b.h) / 2), 6) + 0.0 AS nmi FROM mi JOIN h a ON a.graph = graph_a JOIN h b ON b.graph = graph_b", plain=True)
def _(s, d):
    return clusters.mutual_information(_labels(s, d)).select("graph_a", "graph_b", *_r("nmi"))


@query("cluster_composition", """SELECT layer AS graph, cluster, count(*) AS n, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (PARTITION BY layer), 6) + 0.0 AS percent, count(*) FILTER (WHERE length(x) = 2 AND x LIKE 'e%') AS n_basis,
  count(*) FILTER (WHERE upper(x) LIKE '%RNA%') AS n_rna, count(*) FILTER (WHERE regexp_matches(upper(x), '_K[0-9]+ME[0-9]+$')) AS n_histone FROM (SELECT layer, node || '_' || layer AS x, (length(node) % 3)::INT AS cluster FROM (SELECT DISTINCT layer, node FROM f)) GROUP BY layer, cluster""")  # fmt: skip
def _(s, d):
    n = measurements(s, d).select("layer", "node").distinct().select(F.col("layer").alias("graph"), F.concat_ws("_", "node", "layer").alias("node"), (F.length("node") % 3).cast("int").alias("cluster"))
    return clusters.composition(n).select("graph", "cluster", "n", *_r("percent"), "n_basis", "n_rna", "n_histone")


@query("spectral_clusters")
def _(s, d):
    return clusters.spectral(clusters.affinity(_affinity_edges(s, d)), 4)


@query("spectral_clusters_distributed")
def _(s, d):
    return clusters.spectral(clusters.affinity(_affinity_edges(s, d)), 4, strategy="distributed")


@query("eigengap_distributed")
def _(s, d):
    return clusters.eigengap(clusters.affinity(_affinity_edges(s, d)), 4, strategy="distributed")


@query("eigengap")
def _(s, d):
    return clusters.eigengap(clusters.affinity(_affinity_edges(s, d)))


@query("adjusted_mutual_information")
def _(s, d):
    return clusters.adjusted_mutual_information(_labels(s, d))


# -- projection and plot data ----------------------------------------------------------------------------------------


@query("pca_covariance", "SELECT a.t AS i, b.t AS j, round(covar_samp(a.z, b.z), 6) + 0.0 AS cov FROM z a JOIN z b USING (layer, node) WHERE a.t <= b.t AND a.z IS NOT NULL GROUP BY ALL")
def _(s, d):
    return projection.covariance(layers.pack(measurements(s, d)), 5).select("i", "j", *_r("cov"))


@query("pca_projection")
def _(s, d):
    return projection.projection_map(layers.pack(measurements(s, d)), 5)[0].select("layer", "node", *_r("pc1", "pc2", "pc3"))


@query("ideal_trajectory_points", """SELECT step, t::INT AS t, round(CASE WHEN sd > 0 THEN (v - 0.2) / sd ELSE v - 0.2 END, 6) + 0.0 AS z FROM (SELECT *, sqrt(sum(pow(v - 0.2, 2)) OVER (PARTITION BY step) / 5) AS sd FROM (
  SELECT step, t, CASE WHEN seg = t THEN 1 - fr WHEN seg + 1 = t THEN fr ELSE 0 END AS v FROM (SELECT step, step // 50 AS seg, (step % 50) / CASE WHEN step // 50 = 3 THEN 49.0::DOUBLE ELSE 50.0::DOUBLE END AS fr FROM range(200) r(step)), range(5) q(t)))""", plain=True)  # fmt: skip
def _(s, d):
    return projection.ideal_points(s).select("step", F.posexplode("z").alias("t", "z")).select("step", "t", *_r("z"))


@query("score_scaling", "SELECT node, round(x, 6) + 0.0 AS scaled, round(4 + 18 * x, 6) + 0.0 AS radius FROM (SELECT node, (sqrt(k) - min(sqrt(k)) OVER ()) / (max(sqrt(k)) OVER () - min(sqrt(k)) OVER ()) AS x FROM (SELECT src || '_' || layer AS node, sum(w) / 1000 AS k FROM e WHERE src NOT LIKE 'e_' GROUP BY ALL))")
def _(s, d):
    k = _graph(s, d).edges.filter(~N.is_basis(F.col("src"))).groupBy(F.concat_ws("_", "src", "layer").alias("node")).agg((F.sum("w") / 1000).alias("score"))
    return plotdata.scale_scores(k).select("node", *_r("scaled", "radius"))


@query("visit_marker_sizes", """SELECT node, c AS visits, round(4 + 26 * (c - 0.1) / (max(c) FILTER (WHERE node NOT IN ('Brand#11')) OVER () - 0.1 + 1e-10), 6) + 0.0 AS size FROM (SELECT p_brand AS node, count(*) AS c FROM part GROUP BY p_brand)""", plain=True)
def _(s, d):
    v = s.read.parquet(f"{d}/part.parquet").groupBy(F.concat("p_brand", F.when(F.col("p_size") % 2 == 0, "_neg").otherwise("")).alias("node")).agg(F.count(F.lit(1)).alias("visits"))
    return plotdata.visit_sizes(v, "Brand#11", "e5").select("node", "visits", *_r("size"))


@query("path_segments", """WITH p AS (SELECT l_orderkey AS s, row_number() OVER o - 1 AS pos, l_partkey || CASE WHEN l_quantity > 25 THEN '_neg' ELSE '' END AS node, l_quantity > 25 AS neg, lead(l_quantity > 25) OVER o AS nneg, lead(l_partkey || CASE WHEN l_quantity > 25 THEN '_neg' ELSE '' END) OVER o AS nx
  FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity, l_suppkey) AS rn FROM lineitem) WINDOW o AS (PARTITION BY l_orderkey ORDER BY rn)),
q AS (SELECT *, neg <> nneg AS cross_ FROM p WHERE nx IS NOT NULL), r AS (SELECT *, coalesce(cross_ <> lag(cross_) OVER w OR cross_, false) AS st FROM q WINDOW w AS (PARTITION BY s ORDER BY pos)),
g AS (SELECT *, sum(coalesce(st, false)::INT) OVER (PARTITION BY s ORDER BY pos) AS segment FROM r)
SELECT s AS simulation, segment::BIGINT AS segment, bool_or(cross_) AS is_transition, first(node ORDER BY pos) AS first, last(nx ORDER BY pos) AS last, count(*) + 1 AS nodes FROM g GROUP BY s, segment""", plain=True)  # fmt: skip
def _(s, d):
    li = s.read.parquet(f"{d}/lineitem.parquet")
    node = F.concat(F.col("l_partkey").cast("string"), F.when(F.col("l_quantity") > 25, "_neg").otherwise(""))
    path = F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity", "l_suppkey", node.alias("node")))), lambda x: x["node"])
    return plotdata.path_segments(li.groupBy(F.col("l_orderkey").alias("simulation")).agg(path.alias("path")))


@query("endpoint_bias", "SELECT p_brand AS node, count(*) FILTER (WHERE p_size > 25) AS tally_a, count(*) FILTER (WHERE p_size <= 25) AS tally_b, CASE WHEN count(*) FILTER (WHERE p_size > 25) >= count(*) FILTER (WHERE p_size <= 25) THEN 'A' ELSE 'B' END AS side FROM part GROUP BY p_brand", plain=True)
def _(s, d):
    p = s.read.parquet(f"{d}/part.parquet").groupBy(F.concat("p_brand", F.when(F.col("p_partkey") % 2 == 0, "_neg").otherwise("")).alias("node"))
    return plotdata.endpoint_bias(p.agg(F.count_if(F.col("p_size") > 25).alias("tally_a"), F.count_if(F.col("p_size") <= 25).alias("tally_b")))


@query("heatmap_boundaries", "SELECT layer, (sum(c) OVER (ORDER BY layer) - c)::BIGINT AS first, (sum(c) OVER (ORDER BY layer) - 1)::BIGINT AS last FROM (SELECT layer, count(*) AS c FROM n GROUP BY layer)")
def _(s, d):
    return plotdata.heatmap_boundaries(_graph(s, d).nodes)


# -- walks -----------------------------------------------------------------------------------------------------------


@query("walk_transition_table", "SELECT src, dst, round(p, 6) + 0.0 AS p, round(sum(p) OVER (PARTITION BY src ORDER BY dst ROWS UNBOUNDED PRECEDING), 6) + 0.0 AS cum FROM (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS p FROM ga WHERE w > 0.001)", multi=True)
def _(s, d):
    return walks.prepare(_multi(s, d)).select("src", "dst", *_r("p", "cum"))


@query("absorption_probability", """SELECT node, round(x, 6) + 0.0 AS probability FROM (SELECT nn.node, CASE WHEN nn.node = 'e5' THEN 1.0 ELSE coalesce(sum(ab.x), 0) END AS x FROM nn LEFT JOIN ab ON ab.node = nn.node GROUP BY nn.node)""", multi=True, recursive=True,
       more="""pp AS (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS p FROM ga WHERE w > 0.001), nn AS (SELECT src AS node FROM pp UNION SELECT dst FROM pp),
ab AS (SELECT 0 AS i, 'e5' AS node, 1.0::DOUBLE AS x UNION ALL SELECT ab.i + 1, pp.src, 0.7 * sum(ab.x * pp.p) FROM ab JOIN pp ON pp.dst = ab.node WHERE pp.src <> 'e5' AND ab.i < 40 GROUP BY ab.i, pp.src)""")  # fmt: skip
def _(s, d):
    return walks.absorption(_multi(s, d), ["e5"], 0.3, 0.001, 40).select("node", *_r("probability"))


@query("absorption_probability_distributed", """SELECT node, round(x, 6) + 0.0 AS probability FROM (SELECT nn.node, CASE WHEN nn.node = 'e5' THEN 1.0 ELSE coalesce(sum(ab.x), 0) END AS x FROM nn LEFT JOIN ab ON ab.node = nn.node GROUP BY nn.node)""", multi=True, recursive=True,
       more="""pp AS (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS p FROM ga WHERE w > 0.001), nn AS (SELECT src AS node FROM pp UNION SELECT dst FROM pp),
ab AS (SELECT 0 AS i, 'e5' AS node, 1.0::DOUBLE AS x UNION ALL SELECT ab.i + 1, pp.src, 0.7 * sum(ab.x * pp.p) FROM ab JOIN pp ON pp.dst = ab.node WHERE pp.src <> 'e5' AND ab.i < 40 GROUP BY ab.i, pp.src)""")  # fmt: skip
def _(s, d):
    return walks.absorption(_multi(s, d), ["e5"], 0.3, 0.001, 40, strategy="distributed").select("node", *_r("probability"))


@query("expected_visits", "SELECT node, round(sum(x) / 20, 6) + 0.0 AS frequency FROM vi GROUP BY node HAVING sum(x) > 0", multi=True, recursive=True,
       more="""pp AS (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS p FROM ga), 
vi AS (SELECT 0 AS i, 'e3' AS node, 1.0::DOUBLE AS x UNION ALL SELECT i, node, sum(x) FROM (
  SELECT vi.i + 1 AS i, pp.dst AS node, 0.9 * vi.x * pp.p AS x FROM vi JOIN pp ON pp.src = vi.node WHERE vi.i < 19
  UNION ALL SELECT vi.i + 1, 'e3', CASE WHEN vi.node IN (SELECT src FROM pp) THEN 0.1 ELSE 1.0 END * vi.x FROM vi WHERE vi.i < 19) GROUP BY i, node)""")  # fmt: skip
def _(s, d):
    return walks.expected_visits(_multi(s, d), "e3", 0.1, 20).select("node", *_r("frequency"))


@query("expected_visits_distributed", "SELECT node, round(sum(x) / 20, 6) + 0.0 AS frequency FROM vi GROUP BY node HAVING sum(x) > 0", multi=True, recursive=True,
       more="""pp AS (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS p FROM ga), 
vi AS (SELECT 0 AS i, 'e3' AS node, 1.0::DOUBLE AS x UNION ALL SELECT i, node, sum(x) FROM (
  SELECT vi.i + 1 AS i, pp.dst AS node, 0.9 * vi.x * pp.p AS x FROM vi JOIN pp ON pp.src = vi.node WHERE vi.i < 19
  UNION ALL SELECT vi.i + 1, 'e3', CASE WHEN vi.node IN (SELECT src FROM pp) THEN 0.1 ELSE 1.0 END * vi.x FROM vi WHERE vi.i < 19) GROUP BY i, node)""")  # fmt: skip
def _(s, d):
    return walks.expected_visits(_multi(s, d), "e3", 0.1, 20, strategy="distributed").select("node", *_r("frequency"))


@query("walks_to_target")
def _(s, d):
    return walks.walk_statistics(walks.walks_until(_multi(s, d, "shadow"), "e3", "e5", 1000, 0.0005))


@query("walks_partitioned")
def _(s, d):
    return walks.walk_statistics(walkers.simulate(_multi(s, d), "e3", (F.col("node") == "e5").cast("int"), 10_000, 0.3))


@query("walks_slow")
def _(s, d):
    edges = materialize(layers.layer_graphs(measurements(s, d), "absolute", None).edges, "edges")
    each = []
    for layer in ("k20me3", "k9me2", "rna_ai"):
        _, stats, top = walks.slow_walks(edges.filter(F.col("layer") == layer), "e3", "e5", 1000, 0.0005)
        each.append(top.crossJoin(F.broadcast(stats)).withColumn("layer", F.lit(layer)))
    return each[0].union(each[1]).union(each[2])


@query("walks_to_set")
def _(s, d):
    m = measurements(s, d)
    w = walks.walks_to_set(multilayer.build(m, kind="shadow", alpha=0.5), "Brand#11*STANDARD_k9me2", "rna", 10_000)
    return genes.endpoint_genes(w.filter("success"), m.filter("layer <> 'rna_ai'").select("node"))


@query("walks_two_endpoints")
def _(s, d):
    return walks.endpoint_tallies(walks.walks_to_endpoints(_multi(s, d), "e3", "e5", 10_000, max_steps=100_000, restart=0.05))


@query("diffusion_visits")
def _(s, d):
    return walks.diffusion_visits(_multi(s, d), "e3", 1000, 100)


@query("walk_segments")
def _(s, d):
    return plotdata.path_segments(walks.shortest_walks(walks.walks_until(_multi(s, d, "shadow"), "e3", "e5", 1000, 0.0005), 20))


# -- precision graphs, pipelines -------------------------------------------------------------------------------------


@query("spd_lasso_edges")
def _(s, d):
    return precision.lasso_graphs(measurements(s, d), 0.2).edges


@query("spd_shadow_multigraph")
def _(s, d):
    m = measurements(s, d)
    return multilayer.build(m, precision.lasso_graphs(m, 0.2), "shadow", 0.5)


@query("walks_thinned")
def _(s, d):
    w = walks.walks_to_set(_multi(s, d, "shadow"), "Brand#11*STANDARD_k9me2", "rna", 1000)
    ends = w.groupBy("end_node").agg(F.count(F.lit(1)).alias("n"))
    return walks.sample_walks(walks.thin_walks(w, ends), 20).select("simulation", "steps", "end_node")


@query("spd_lambda_sweep")
def _(s, d):
    return precision.lambda_sweep(measurements(s, d), [i / 25 for i in range(1, 26)], gamma=0.01, eta=0.5, max_iter=100)


@query("spd_least_squares_sweep")
def _(s, d):
    return precision.least_squares_sweep(measurements(s, d), [i / 25 for i in range(1, 26)])


@query("walk_examples")
def _(s, d):
    return walks.example_walks(walks.walks_until(_multi(s, d, "shadow"), "e3", "e5", 1000, 0.0005))


@query("spd_spectrum")
def _(s, d):
    return precision.spectrum(_graph(s, d))


@query("spd_symmetry_report")
def _(s, d):
    return precision.symmetry_report(measurements(s, d), "rna_ai", lam=0.2)


@query("spd_hyper_sweep")
def _(s, d):
    return precision.hyper_sweep(measurements(s, d), "rna_ai", [0.05, 0.2], iters=[100, 500])


@query("pipeline_start_to_end")
def _(s, d):
    return pipelines.start_to_end(measurements(s, d), pipelines.Settings(n_walks=1000, alpha=0.5, restart=0.0005))["visits"]


@query("pipeline_histone_to_rna")
def _(s, d):
    return pipelines.histone_to_rna(measurements(s, d), "Brand#11*STANDARD_k9me2", pipelines.Settings(n_walks=10_000, alpha=0.5))["endpoints"]


@query("pipeline_combined_clusters")
def _(s, d):
    return pipelines.combined_clusters(measurements(s, d), pipelines.Settings(n_walks=10_000, restart=0.05))["visited"]


# -- manifest --------------------------------------------------------------------------------------------------------


def _paths(s: SparkSession, d: str) -> DataFrame:
    u = F.regexp_replace(F.regexp_replace("url", "^https?://", ""), r"[?#].*$", "")
    return s.read.parquet(f"{d}/pages.parquet").select(F.concat(F.regexp_replace(u, "/+$", ""), F.lit(".html")).alias("path")).distinct()


_MANIFEST = """WITH p AS (SELECT DISTINCT regexp_replace(regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', ''), '/+$', '') || '.html' AS path FROM pages),
q AS (SELECT path, split_part(path, '/', -1) AS filename, CASE WHEN contains(path, '/') THEN replace(regexp_replace(path, '/[^/]*$', ''), '/', ' / ') ELSE '' END AS "group" FROM p),
t AS (SELECT *, list_filter(regexp_split_to_array(regexp_replace(filename, '\\.[^.]*$', ''), '[_\\-\\s]+'), lambda w: w <> '') AS ws FROM q),
mf AS (SELECT CASE WHEN len(ws) = 0 THEN 'Untitled Plot' ELSE array_to_string(list_transform(ws, lambda w: CASE WHEN length(w) <= 3 THEN upper(w) ELSE upper(w[1]) || lower(w[2:]) END), ' ') END AS title, path, "group", filename FROM t)
"""


@query("manifest", _MANIFEST + 'SELECT title, path, "group", filename FROM mf', plain=True)
def _(s, d):
    return manifest.manifest(_paths(s, d))


@query("manifest_search", _MANIFEST + """SELECT title, path, "group", filename FROM mf WHERE contains(lower(concat_ws(' ', title, path, "group")), 'blog')""", plain=True)
def _(s, d):
    return manifest.search(manifest.manifest(_paths(s, d)), "Blog ")


@query("manifest_groups", _MANIFEST + 'SELECT "group", count(*) AS n FROM mf GROUP BY "group"', plain=True)
def _(s, d):
    return manifest.group_counts(manifest.manifest(_paths(s, d)))


@query("prettify_titles", """SELECT DISTINCT p_name AS stem, array_to_string(list_transform(list_filter(regexp_split_to_array(p_name || '_' || lower(p_brand), '[_\\-\\s]+'), lambda w: w <> ''), lambda w: CASE WHEN length(w) <= 3 THEN upper(w) ELSE upper(w[1]) || lower(w[2:]) END), ' ') AS title FROM part""", plain=True)
def _(s, d):
    p = s.read.parquet(f"{d}/part.parquet")
    return p.select(F.col("p_name").alias("stem"), N.prettify(F.concat_ws("_", "p_name", F.lower("p_brand"))).alias("title")).distinct()


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)

