"""Formulas, invariants and equivalences of the graph operators on small fixtures."""

import io
import json
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from layerwalk.functions import kernels as K
from layerwalk.functions import names as N
from layerwalk.operators import clusters, diffusion, krylov, layers, manifest, metrics, multilayer, plotdata, precision, projection, selection, simjoin, tiles, walkers, walks
from layerwalk.sources import star, tables

SERIES = {"g1": [0, 1, 2, 3], "g2": [1, 1, 1, 1], "g3": [2, 0, -1, -2]}


def long(spark, series, layer="rna_ai"):
    return spark.createDataFrame([(layer, n, t, float(v)) for n, vs in series.items() for t, v in enumerate(vs)], "layer string, node string, t int, value double")


def random_layers(spark, seed=0, genes=6, loci=3, times=5):
    rng = np.random.default_rng(seed)
    rows = [("rna_ai", f"G{g}", t, float(v)) for g in range(genes) for t, v in enumerate(rng.standard_normal(times))]
    for layer in ("k20me3", "k9me2"):
        rows += [(layer, f"G{g}*{k}", t, float(v)) for g in range(genes) for k in range(loci) for t, v in enumerate(rng.standard_normal(times))]
    return spark.createDataFrame(rows, "layer string, node string, t int, value double")


def weights(df):
    return {(r.src, r.dst): r.w for r in df.collect()}


@pytest.fixture(scope="module")
def graph(spark):
    m = random_layers(spark).cache()
    edges = multilayer.build(m, kind="transitions", alpha=0.4, sigma=0.2).cache()
    return m, edges


@pytest.mark.parametrize(("method", "args", "near", "far"), [("power", {"n_power": 4}, 0.0625, 5.588536770582653e-09), ("gaussian_abs", {"sigma": 0.2}, 3.726653172078671e-06, 0.9962691511465483), ("exponential_abs", {"sigma": 0.2}, 0.006737946999085467, 0.9171705373661581)])
def test_kernels_with_a_constant_series(spark, method, args, near, far):
    w = weights(layers.adjacency(long(spark, SERIES), method, **args).edges)
    assert np.isclose(w["g1", "g2"], near) and np.isclose(w["g2", "g3"], near) and np.isclose(w["g1", "g3"], far)
    assert all(a != b and np.isclose(w[a, b], w[b, a]) for a, b in w)


def test_kernels_respond_to_their_parameters(spark):
    one = spark.range(1).select(*[K.apply(k, F.lit(0.98), sigma=s, n=n).alias(f"{k}{i}") for k in K.KERNELS for i, (s, n) in enumerate([(0.05, 10), (0.2, 20)])]).first()
    for k in K.KERNELS:
        assert (one[f"{k}0"] != one[f"{k}1"]) == (k != "absolute")
    assert spark.range(1).select(K.apply(lambda c: c * 2, F.lit(0.5), sigma=3, n=4)).first()[0] == 1.0
    with pytest.raises(ValueError):
        K.apply("nothing", F.lit(1.0))
    for k, s in (("exponential_abs", 0.05), ("gaussian_abs", 0.05)):
        c = K.inverse_threshold(k, 0.01, s)
        assert np.isclose(spark.range(1).select(K.apply(k, F.lit(c), sigma=s)).first()[0], 0.01)


def test_standardised_rows_and_basis(spark):
    z = layers.standardize_rows(random_layers(spark)).groupBy("layer", "node").agg(F.avg("z").alias("m"), F.sum(F.col("z") ** 2).alias("s")).collect()
    assert all(abs(r.m) < 1e-9 and abs(r.s - 4) < 1e-9 for r in z)
    assert layers.standardize_rows(long(spark, SERIES)).filter("node = 'g2' and z is not null").count() == 0
    b = {r.node: r for r in layers.basis_rows(long(spark, SERIES).select("layer")).collect()}
    assert np.allclose(b["e1"].z, [2, -0.5, -0.5, -0.5, -0.5]) and np.isclose(np.sum(np.square(b["e4"].u)), 1)


def test_layer_graph_thresholds_and_basis(spark):
    m = random_layers(spark, 1)
    g = layers.layer_graphs(m, sigma=0.3, threshold=0.05)
    e = g.edges.collect()
    assert all(r.w >= 0.05 and r.src != r.dst for r in e) and not {"e1", "e2", "e4"} & {r.src for r in e}
    assert g.nodes.filter(N.is_basis(F.col("node"))).count() == 15
    free = layers.layer_graphs(m, sigma=0.3, threshold=0.05, start=None, end=None).edges
    assert {"e1", "e2", "e3", "e4", "e5"} <= {r.src for r in free.collect()}
    assert layers.layer_graphs(m, "power", None, 4).edges.filter("src = dst and w = 1").count() > 0
    assert layers.negative_graphs(m).edges.filter("sign >= 0").count() == 0
    packed = layers.pack(m)
    t = layers.attach_basis(g, packed, 2, 0.7)
    assert t.edges.filter(N.is_basis(F.col("src"))).groupBy("layer", "src").count().filter("count <> 2").count() == 0
    assert layers.attach_basis(g, packed, action="remove").nodes.filter(N.is_basis(F.col("node"))).count() == 0
    with pytest.raises(ValueError):
        layers.attach_basis(g, packed, action="toggle")


def test_statistics_count_implicit_zeros(spark):
    g = layers.layer_graphs(random_layers(spark, 2), sigma=0.2, threshold=0.2)
    nodes = sorted(r.node for r in g.nodes.filter("layer = 'k9me2'").collect())
    a = np.zeros((len(nodes),) * 2)
    for r in g.edges.filter("layer = 'k9me2'").collect():
        a[nodes.index(r.src), nodes.index(r.dst)] = r.w
    s = layers.graph_statistics(g).filter("layer = 'k9me2'").first()
    assert np.allclose([s.min_w, s.max_w, s.mean_w, s.median_w], [a.min(), a.max(), a.mean(), np.median(a)])
    k = a.sum(1)
    top = a.max()
    num, den = np.einsum("ij,jl,li->i", a, a, a), k**2 - (a**2).sum(1)
    c = np.where(den > 1e-15, num / np.where(den > 1e-15, den, 1) / top, 0).mean()
    one = lambda df: df.filter("layer = 'k9me2'").first()
    assert np.isclose(one(metrics.clustering_coefficient(g)).clustering, c) and np.isclose(one(metrics.mean_degree(g)).mean_degree, k.mean())
    assert one(metrics.isolated_nodes(g)).isolated == (k <= 0.01).sum()
    n = len(nodes)
    assert np.isclose(one(metrics.sparsity(g)).sparsity, 1 - (a > 0.01).sum() / (n * (n - 1))) and one(metrics.symmetry(g.edges)).is_symmetric


def test_transitions_and_shadow_rows(spark, graph):
    m, edges = graph
    sums = {r.src: r.s for r in edges.groupBy("src").agg(F.sum("w").alias("s")).collect()}
    assert all(min(abs(s - x) for x in (1, 0.4, 0.6)) < 1e-9 for s in sums.values())
    sh = multilayer.build(m, kind="shadow", alpha=0.4, sigma=0.2).collect()
    assert not any(r.src.endswith("_neg") and r.dst in N.BASIS or r.dst in {f"{b}_neg" for b in N.BASIS} for r in sh)
    by = {}
    for r in sh:
        by[r.src] = by.get(r.src, 0) + r.w
    assert all(s <= sums[k.removesuffix("_neg")] + 1e-9 for k, s in by.items())
    with pytest.raises(ValueError):
        multilayer.layer_transitions(edges, 2)
    with pytest.raises(ValueError):
        multilayer.build(m, kind="other")


def test_substring_join_equals_nested_loops(spark):
    p = layers.pack(spark.createDataFrame([(la, n, t, float((t * 7 + len(n)) % 5)) for la, ns in {"a": ["B1*x", "B", "Q*B1"], "b": ["B1*y", "B10*z", "XB1", "B"], "c": ["B10"]}.items() for n in ns for t in range(4)], "layer string, node string, t int, value double"))
    got = {(r.layer_a, r.a, r.layer_b, r.b) for r in multilayer.contains_pairs(p).collect()}
    nodes = [(r.layer, r.node) for r in p.collect()]
    assert got == {(x, a, y, b) for x, a in nodes for y, b in nodes if x < y and a.split("*")[0] in b}
    assert multilayer.contains_pairs(p, same_gene=False).count() == 3 * 4 + 3 + 4


def test_diffusion_strategies_agree_with_an_inverse(graph):
    _, edges = graph
    e = edges.collect()
    names = sorted({r.src for r in e} | {r.dst for r in e})
    a = np.zeros((len(names),) * 2)
    for r in e:
        a[names.index(r.src), names.index(r.dst)] = r.w
    near = np.linalg.inv(np.eye(len(names)) - 0.7 * a)[names.index("e3")]
    got = {r.node: r.score for r in diffusion.local_neighbourhood(edges, "e3").collect()}
    assert np.allclose([got[n] for n in names], near)
    far = {r.node: r.score for r in diffusion.local_neighbourhood(edges, "e3", r=0.2, strategy="distributed", steps=8).collect()}
    assert np.allclose([far.get(n, 0) for n in names], np.linalg.inv(np.eye(len(names)) - 0.2 * a)[names.index("e3")], atol=1e-5)
    j = names.index("e5")
    keep = [i for i in range(len(names)) if i != j]
    g = np.linalg.inv(np.eye(len(keep)) - 0.7 * a[np.ix_(keep, keep)])
    h = g @ (0.7 * a[keep, j])
    s = [names[i] for i in keep].index("e3")
    got = {r.node: r.score for r in diffusion.start_to_end(edges, "e3", "e5").collect()}
    assert np.allclose([got[names[i]] for i in keep], h * g[s] / h[s]) and "e5" not in got
    with pytest.raises(ValueError):
        diffusion.start_to_end(edges, "e3", "e3")
    assert np.isclose(diffusion.pagerank(edges).agg(F.sum("score")).first()[0], 1)


def test_walks_match_absorption(graph):
    _, edges = graph
    p = {r.node: r.probability for r in walks.absorption(edges, ["e5"], 0.1, 0.001, 400).collect()}
    w = walks.walks_to_target(edges, "e3", "e5", 2000, 0.1)
    s = walks.walk_statistics(w).first()
    assert s.n == 2000 and abs(s.n_success / 2000 - p["e3"]) < 4 * (p["e3"] * (1 - p["e3"]) / 2000) ** 0.5 + 1e-9
    assert [r.path for r in w.orderBy("simulation").collect()] == [r.path for r in walks.walks_to_target(edges, "e3", "e5", 2000, 0.1).repartition(3).orderBy("simulation").collect()]
    assert w.filter("success and end_node <> 'e5'").count() == 0
    t = walks.endpoint_tallies(walks.walks_to_endpoints(edges, "e3", "e5", 300, restart=0.05))
    assert np.isclose(t.agg(F.sum(F.col("p_a") + F.col("p_b"))).first()[0], 1)
    v = {r.node: r.frequency for r in walks.diffusion_visits(edges, "e3", 3000, 20).collect()}
    x = {r.node: r.frequency for r in walks.expected_visits(edges, "e3", 0.1, 20).collect()}
    assert max(abs(v.get(n, 0) - x[n]) for n in x) < 0.02 and np.isclose(sum(v.values()), 1)
    steps = [r.steps for r in w.filter("success").orderBy("steps").collect()]
    got = {r.kind: r.steps for r in walks.example_walks(w).collect()}
    assert got == {"shortest": steps[0], "median": steps[(len(steps) + 1) // 2 - 1], "longest": steps[-1]}
    with pytest.raises(ValueError):
        walks.walks_to_endpoints(edges, "e3", "e3", 10)
    with pytest.raises(ValueError):
        walks.walks_to_target(edges, "nowhere", "e5")


def test_precision_solver_is_symmetric_positive_and_descends():
    x = np.random.default_rng(0).standard_normal((40, 8))
    x[:, 1] = x[:, 0] + 0.3 * x[:, 1]
    omega, loss = precision.solve(x, 0.1, max_iter=100, gamma=0.001, return_omega=True)
    assert np.allclose(omega, omega.T) and np.linalg.eigvalsh(omega).min() > 0 and loss[-1] < loss[0]
    q, _ = precision.solve(x, 0.1, max_iter=100, gamma=0.001)
    assert q[0, 1] > 0.2 and np.isfinite(q).all()
    b, tau2 = precision.lasso_columns(x, 1e9)
    assert np.allclose(b, np.diag(1 / tau2))


def test_column_lassos_meet_their_optimality_conditions_and_do_not_depend_on_blocks():
    x = np.random.default_rng(1).standard_normal((7, 30))
    x[:, 4] = 0
    x[:, 9] = x[:, 8]
    b, tau2 = precision.lasso(x, np.arange(30), 0.3, tol=1e-10)
    slope = x.T @ (x - x @ b) / 7
    np.fill_diagonal(slope, 0)
    assert np.abs(slope).max() <= 0.3 + 1e-8 and np.allclose(slope[b != 0], 0.3 * np.sign(b[b != 0])) and (np.diag(b) == 0).all()
    parts = [precision.lasso(x, np.arange(f, min(f + 7, 30)), 0.3, tol=1e-10) for f in range(0, 30, 7)]
    assert np.allclose(np.hstack([p[0] for p in parts]), b, atol=1e-12) and np.allclose(np.concatenate([p[1] for p in parts]), tau2)


def _tiles(spark, a, grid):
    t = grid.tile
    rows = [(i, j, bytearray(np.ascontiguousarray(a[i * t : i * t + t, j * t : j * t + t]).tobytes())) for i in range(grid.count) for j in range(i, grid.count)]
    return spark.createDataFrame(rows, "i int, j int, a binary")


def _dense(df, grid):
    out, t = np.zeros((grid.size, grid.size)), grid.tile
    for r in df.collect():
        a = grid.read(bytes(r.a), r.i, r.j)
        out[r.i * t : r.i * t + len(a), r.j * t : r.j * t + a.shape[1]] = a
        out[r.j * t : r.j * t + a.shape[1], r.i * t : r.i * t + len(a)] = a.T
    return out


def test_positive_part_of_tiles(spark):
    rng, grid = np.random.default_rng(2), tiles.Grid(19, 8)
    a = rng.standard_normal((19, 19))
    a = a + a.T
    a[:3], a[:, :3] = 0, 0
    both = _dense(tiles.product(_tiles(spark, a, grid), _tiles(spark, a, grid), grid, 2.0, _tiles(spark, a, grid), -1.0), grid)
    assert np.allclose(both, 2 * a @ a - a)
    val, vec = np.linalg.eigh(a)
    got = _dense(tiles.positive(_tiles(spark, a, grid), grid, 1e-7), grid)
    assert np.allclose(got, (vec * np.maximum(val, 0)) @ vec.T, atol=1e-6)
    nothing = _tiles(spark, np.zeros((3, 3)), tiles.Grid(3, 8))
    assert (_dense(tiles.positive(nothing, tiles.Grid(3, 8)), tiles.Grid(3, 8)) == 0).all()


def test_tiled_precision_equals_the_dense_solver(spark, monkeypatch):
    x = np.random.default_rng(3).standard_normal((6, 21))
    rows = spark.createDataFrame([(f"n{i:02d}", [float(v) for v in x[:, i]]) for i in range(21)], "node string, z array<double>").repartition(3)

    def positive(b, grid, smallest):  # the iteration has its own test
        val, vec = np.linalg.eigh(_dense(b, grid))
        return tiles.materialize(_tiles(spark, (vec * np.maximum(val, 0)) @ vec.T, grid), "positive")

    monkeypatch.setattr(tiles, "positive", positive)
    for gamma, rounds in ((0.001, 3), (0.05, 2)):
        q, losses = precision.solve(x, 0.2, gamma, 20.0, rounds)
        state, got = precision.tiled(rows, 0.2, gamma, 20.0, rounds, tile=8)
        np.fill_diagonal(q, 0)
        dense = np.zeros_like(q)
        for r in state.edges(0.01).collect():
            dense[int(r.src[1:]), int(r.dst[1:])] = r.w * r.sign
        omega, _ = precision.solve(x, 0.2, gamma, 20.0, rounds, return_omega=True)
        plain = sum(np.square(x[:, j] + np.delete(x, j, 1) @ np.delete(omega[:, j], j) / omega[j, j]).sum() for j in range(21))
        assert np.isclose(precision.least_squares(x, omega), plain) and np.isclose(state.least_squares(), plain)
        assert np.allclose(losses, got, rtol=1e-9) and np.allclose(dense, np.where(np.abs(q) >= 0.01, q, 0), atol=1e-9)
    monkeypatch.setattr(precision, "LOCAL_NODES", 20)
    m = spark.createDataFrame([("x", f"n{i:02d}", t, float(x[t, i])) for i in range(21) for t in range(6)], "layer string, node string, t int, value double")
    large = {(r.src, r.dst): r.w * r.sign for r in precision.lasso_graphs(m, 0.2, 0.01, None, None, 0.001, max_iter=1).edges.collect()}
    monkeypatch.setattr(precision, "LOCAL_NODES", 21)
    small = {(r.src, r.dst): r.w * r.sign for r in precision.lasso_graphs(m, 0.2, 0.01, None, None, 0.001, max_iter=1).edges.collect()}
    assert large.keys() == small.keys() and all(abs(large[k] - small[k]) < 1e-9 for k in small)


def test_sweep_equals_single_graphs(spark):
    m = random_layers(spark, 5)
    got = {(r.layer, r.param): r for r in metrics.sweep(m, "gaussian_abs", "sigma", [0.1, 0.3], threshold=0.05).collect()}
    for s in (0.1, 0.3):
        g = layers.layer_graphs(m, "gaussian_abs", s, threshold=0.05, basis=False)
        for r in metrics.table(g).collect():
            x = got[r.layer, s]
            assert np.allclose([x.mean_degree, x.isolated, x.sparsity, x.clustering], [r.mean_degree, r.isolated, r.sparsity, r.clustering])
    lam = precision.lambda_sweep(m, [0.2, 0.9], max_iter=10).collect()
    assert len(lam) == 6 and all(r.loss is not None for r in lam)
    ls = precision.least_squares_sweep(m, [0.2, 0.9], max_iter=10).collect()
    assert len(ls) == 6 and all(r.least_squares > 0 for r in ls)


def test_labels_and_matrices(spark):
    a = clusters.from_matrix(spark, np.array([[0, 1.0], [0.5, 0]]), ["x", "y"])
    assert sorted((r.src, r.dst, r.w) for r in a.collect()) == [("x", "y", 1.0), ("y", "x", 0.5)]
    lab = spark.createDataFrame([("x", 1)], "node string, cluster int")
    assert clusters.label_frame(lab, graph="g").first().graph == "g"
    for bad in (lambda: clusters.from_matrix(spark, np.zeros((2, 3))), lambda: clusters.from_matrix(spark, np.zeros((2, 2)), ["x"]), lambda: clusters.label_frame(lab), lambda: clusters.label_frame(lab, "other", "g")):
        with pytest.raises(ValueError):
            bad()
    pos = spark.createDataFrame([("e1", 0.0, 0.0), ("a", 1.0, 0.0), ("b", 0.0, 1.0), ("c", 3.0, 3.0)], "node string, x double, y double")
    assert clusters.closest_to_basis(pos, ["e1"]).first().node == "a"


def test_clusters_and_agreement(spark):
    e = [("g", f"{s}{i}", f"{s}{j}", 1.0) for s in "ab" for i in range(5) for j in range(5) if i != j] + [("g", "a0", "b0", 0.05)]
    df = spark.createDataFrame(e, "graph string, src string, dst string, w double")
    a = clusters.affinity(df)
    lab = clusters.cluster(a, 2)
    assert len({(r.node[0], r.cluster) for r in lab.collect()}) == 2 and clusters.eigengap(a).first().k == 2
    other = lab.withColumn("graph", F.lit("h")).withColumn("cluster", 1 - F.col("cluster"))
    single = lab.withColumn("graph", F.lit("s")).withColumn("cluster", F.lit(0))
    both = lab.select("graph", "node", "cluster").union(other.select("graph", "node", "cluster")).union(single.select("graph", "node", "cluster"))
    mi = {(r.graph_a, r.graph_b): r for r in clusters.mutual_information(both).collect()}
    assert np.isclose(mi["g", "h"].nmi, 1) and np.isclose(mi["g", "h"].mi, np.log(2)) and np.isclose(mi["s", "s"].nmi, 1) and np.isclose(mi["g", "s"].mi, 0)
    ami = {(r.graph_a, r.graph_b): r.ami for r in clusters.adjusted_mutual_information(both).collect()}
    assert np.isclose(ami["g", "h"], 1) and abs(ami["g", "s"]) < 1e-9
    assert clusters.square(clusters.mutual_information(both), "nmi").columns == ["graph_a", "g", "h", "s"]
    for bad in (lambda: clusters.spectral(a, 1), lambda: clusters.affinity(df, "sum"), lambda: clusters.cluster(a, 2, "other")):
        with pytest.raises(ValueError):
            bad()


def test_projection_equals_numpy(spark):
    packed = layers.pack(random_layers(spark, 3))
    x = np.array([r.z for r in packed.collect()])
    pca = projection.fit(packed, 5)
    val = np.linalg.svd(x - x.mean(0))[1] ** 2
    assert np.allclose(pca.ratio, (val / val.sum())[:3]) and np.allclose(pca.mean, x.mean(0))
    pts = projection.ideal_points(spark)
    assert pts.count() == 200 and np.allclose(pts.filter("step = 0").first().z, [2, -0.5, -0.5, -0.5, -0.5]) and np.allclose(pts.filter("step = 199").first().z, [-0.5, -0.5, -0.5, -0.5, 2])


def test_plot_data(spark):
    s = spark.createDataFrame([("a", 1.0), ("b", 0.25), ("c", 0.0), ("e3", 0.04), ("d", float("nan"))], "node string, score double")
    got = {r.node: r for r in plotdata.scale_scores(s).collect()}
    assert got["a"].scaled == 1 and np.isclose(got["b"].scaled, 1) and got["c"].scaled == 0 and got["e3"].radius == 12 and "d" not in got
    with pytest.raises(ValueError):
        plotdata.scale_scores(s, "other")
    w = spark.createDataFrame([(1, ["a", "b", "b_neg", "c_neg", "d"])], "simulation long, path array<string>")
    seg = [(r.first, r.last, r.is_transition) for r in plotdata.path_segments(w).orderBy("segment").collect()]
    assert seg == [("a", "b", False), ("b", "b_neg", True), ("b_neg", "c_neg", False), ("c_neg", "d", True)]


def test_csv_layers_and_bundle(spark, tmp_path):
    for name, head in (("x_RNA_ai", "gene_name"), ("y_k9me2", "Unnamed: 0")):
        (tmp_path / f"{name}.csv").write_text(f"{head},0,1,1.5,2\nG1,1,2,9,3\nG2,3,2,9,1\n")
    m = tables.read_layers(spark, str(tmp_path))
    assert {(r.layer, r.node, r.t, r.value) for r in m.filter("node = 'G1'").collect()} == {(la, "G1", t, float(t + 1)) for la in ("rna_ai", "k9me2") for t in range(3)}
    with pytest.raises(ValueError):
        tables.read_layers(spark, str(tmp_path), marks="k27")
    raw = tables.bundle({"path": tmp_path, "arr": np.arange(3), "nested": {"t": (1, 2)}}, {"visits": spark.createDataFrame([("a", 0.2)], "node string, visit double")}, "<html>")
    z = zipfile.ZipFile(io.BytesIO(raw))
    assert json.loads(z.read("parameters.json")) == {"path": str(tmp_path), "arr": [0, 1, 2], "nested": {"t": [1, 2]}} and z.read("visits.csv").decode().split() == ["node,visit", "a,0.2"]
    (tmp_path / "sub" / "deep").mkdir(parents=True)
    (tmp_path / "sub" / "deep" / "top_ranked-genes.html").write_text("x")
    r = manifest.manifest(manifest.site_files(spark, str(tmp_path))).first()
    assert tuple(r) == ("TOP Ranked Genes", "sub/deep/top_ranked-genes.html", "sub / deep", "top_ranked-genes.html")
    assert json.loads(manifest.manifest_json(manifest.manifest(manifest.site_files(spark, str(tmp_path))), "now").first()[0])["total_plots"] == 1


def test_every_query_is_registered_with_matching_names():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) >= 80


def test_diffusion_strategies_give_the_same_rows_and_errors(spark):
    rows = [("a", "b", 0.5), ("b", "c", 1.0), ("c", "a", 0.3), ("a", "c", 0.5), ("d", "a", 1.0), ("e", "d", 1.0)]
    edges = spark.createDataFrame(rows, "src string, dst string, w double")
    for r in (0.0, 0.7, 0.95):
        one, two = ({x.node: x.score for x in diffusion.local_neighbourhood(edges, "a", r=r, strategy=k).collect()} for k in ("local", "distributed"))
        assert set(one) == set(two) == set("abcde") and all(abs(one[n] - two[n]) < 1e-8 for n in one) and one["e"] == two["e"] == 0
    one, two = ({x.node: x.score for x in diffusion.start_to_end(edges, "a", "c", r=0.9, strategy=k).collect()} for k in ("local", "distributed"))
    assert set(one) == set(two) == set("abde") and all(abs(one[n] - two[n]) < 1e-8 for n in one)
    for k in ("local", "distributed"):
        with pytest.raises(ValueError):
            diffusion.local_neighbourhood(edges, "nope", strategy=k)
        with pytest.raises(ValueError):
            diffusion.start_to_end(edges, "a", "nope", strategy=k)
        for r in (-0.1, 1.5):
            with pytest.raises(ValueError, match="r must be"):
                diffusion.local_neighbourhood(edges, "a", r=r, strategy=k)
        ring = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0), ("c", "a", 1.0), ("c", "d", 0.0)], "src string, dst string, w double")
        with pytest.raises(ValueError, match="singular"):
            diffusion.local_neighbourhood(ring, "a", r=1.0, strategy=k)
        with pytest.raises(ValueError, match="reached"):
            diffusion.start_to_end(edges, "a", "e", strategy=k)
    one, two = ({x.node: x.score for x in diffusion.local_neighbourhood(edges, "a", r=0.9, strategy=k, steps=3).collect()} for k in ("local", "distributed"))
    assert one == pytest.approx(two, abs=1e-12) and one["b"] == pytest.approx(0.9 * 0.5 + 0.9**3 * 0.5 * 0.3 * 0.5)


@pytest.mark.parametrize(("seed", "r", "scale"), [(1, 0.7, 2.0), (2, 1.0, 0.9), (3, 0.95, 4.0)])
def test_diffusion_of_raw_weights_equals_a_dense_solve(spark, seed, r, scale):
    rng = np.random.default_rng(seed)
    n = 9
    a = rng.random((n, n)) * (rng.random((n, n)) < 0.4) * scale
    a[0, 3] = 0.2
    a[n - 1] = a[n - 2, : n - 2] = 0  # the last node leads nowhere, the one before only to the last two
    assert a.sum(1).max() > 1
    names = [f"n{i}" for i in range(n)]
    edges = spark.createDataFrame([(names[i], names[j], float(a[i, j])) for i in range(n) for j in range(n) if a[i, j]] + [("n0", "n8", 0.0)], "src string, dst string, w double")
    e = np.zeros(n)
    e[0] = 1
    want = np.linalg.solve(np.eye(n) - r * a.T, e)
    for k in ("local", "distributed"):
        got = {x.node: x.score for x in diffusion.local_neighbourhood(edges, "n0", r=r, strategy=k).collect()}
        np.testing.assert_allclose([got[x] for x in names], want, rtol=1e-9, atol=1e-9 * np.abs(want).max())
    one, two = ({x.node: x.score for x in diffusion.start_to_end(edges, "n0", "n3", r=r, strategy=k).collect()} for k in ("local", "distributed"))
    assert one == pytest.approx(two, rel=1e-8, abs=1e-9 * max(map(abs, one.values()))) and set(one) == set(names) - {"n3"}


def test_leading_eigenvectors_of_repeated_values(spark):
    rng = np.random.default_rng(5)
    a = rng.random((12, 12))
    a = a + a.T
    a[:6, 6:] = a[6:, :6] = 0
    a[6:, 6:] = a[:6, :6]  # every value twice
    names = [f"n{i:02d}" for i in range(12)]
    edges = spark.createDataFrame([(names[i], names[j], float(a[i, j])) for i in range(12) for j in range(12) if a[i, j]], "src string, dst string, w double")
    value, vectors = krylov.leading(edges, edges.select(F.col("src").alias("node")).distinct(), 4, spare=1, cycle=9)
    v = np.array([x.v for x in vectors.orderBy("node").collect()])
    np.testing.assert_allclose(value, np.sort(np.linalg.eigvalsh(a))[::-1][:4], atol=1e-9)
    np.testing.assert_allclose(a @ v, v * value, atol=1e-8)
    np.testing.assert_allclose(v.T @ v, np.eye(4), atol=1e-10)


def test_large_graphs_are_no_dense_matrix(spark, monkeypatch):
    monkeypatch.setattr(diffusion, "DENSE_NODES", 3)
    edges = spark.createDataFrame([("a", "b", 1.0), ("c", "d", 1.0)], "src string, dst string, w double")
    for f in (lambda: diffusion.local_neighbourhood(edges, "a", strategy="local"), lambda: walks.absorption(edges, ["b"], 0.1, 0.0, 5, "local"), lambda: walks.expected_visits(edges, "a", 0.1, 5, "local")):
        with pytest.raises(ValueError, match="dense"):
            f()


def test_eigenvector_falls_back_to_the_undirected_graph(spark):
    chain = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0), ("c", "d", 1.0)], "src string, dst string, w double")
    for k in ("local", "distributed"):
        got = {x.node: x.score for x in diffusion.eigenvector(chain, iterations=60, tol=1e-9, strategy=k).collect()}
        assert np.isclose(got["a"], got["d"], atol=1e-4) and np.isclose(got["b"], got["c"], atol=1e-4) and got["b"] > got["a"] > 0.3


def test_walks_go_on_until_enough_succeed(spark):
    edges = spark.createDataFrame([("a", "b", 0.2), ("a", "z", 0.8), ("q", "a", 1.0)], "src string, dst string, w double")
    w = walks.walks_until(edges, "a", "b", 40, restart=0.0).collect()
    assert sum(x.success for x in w) == 40 and len(w) > 100 and sorted(x.simulation for x in w) == list(range(len(w))) and max(w, key=lambda x: x.simulation).success
    few = walks.walks_until(edges, "a", "b", 40, restart=0.0, budget=2).collect()
    assert len(few) == 80 and sum(x.success for x in few) < 40
    for pair in (("b", "a"), ("a", "q"), ("nope", "b")):
        with pytest.raises(ValueError, match="no walk"):
            walks.walks_until(edges, *pair)
    w, stats, top = walks.slow_walks(edges, "a", "b", 10, restart=0.0)
    assert stats.first().n_success == 10 and [x.node for x in top.collect()] == ["a", "b"]


def test_symmetry_report_of_the_most_varying_nodes(spark):
    rng = np.random.default_rng(5)
    m = spark.createDataFrame([("x", f"n{i}", t, float(rng.standard_normal() * (i + 1))) for i in range(8) for t in range(5)], "layer string, node string, t int, value double")
    r = precision.symmetry_report(m, "x", 6, lam=0.2).first()
    assert r.n_nodes == 6 and r.is_symmetric and r.max_asymmetry < 1e-6 and not r.has_nan


def _as_partition(rows):
    groups = {}
    for r in rows:
        groups.setdefault((r.graph, r.cluster), set()).add(r.node)
    return {(g, frozenset(v)) for (g, _), v in groups.items()}


def test_spectral_clusters_by_joins_equal_the_dense_ones(spark):
    rng = np.random.default_rng(12)
    rows = []
    for g, sizes in (("one", (7, 6, 5)), ("two", (8, 8))):
        of = np.repeat(np.arange(len(sizes)), sizes)
        for i in range(len(of)):
            for j in range(i):
                w = float(rng.random() * (1.0 if of[i] == of[j] else 0.03 if g == "one" else 0.0))
                rows += [(g, f"n{i:02d}", f"n{j:02d}", w), (g, f"n{j:02d}", f"n{i:02d}", w)] if w else []
    edges = spark.createDataFrame(rows, "graph string, src string, dst string, w double")
    one, two = (clusters.spectral(edges, 2, strategy=s).collect() for s in ("local", "distributed"))
    assert _as_partition(one) == _as_partition(two) and sorted((r.graph, r.node, round(r.strength, 9)) for r in one) == sorted((r.graph, r.node, round(r.strength, 9)) for r in two)
    assert {len(x) for g, x in _as_partition(two) if g == "two"} == {8}
    one, two = ({r.graph: r for r in clusters.eigengap(edges, k_max=5, strategy=s).collect()} for s in ("local", "distributed"))
    assert all(one[g].k == two[g].k == k and np.allclose(one[g].eigenvalues, two[g].eigenvalues, atol=1e-8) for g, k in (("one", 3), ("two", 2)))
    with pytest.raises(ValueError):
        clusters.spectral(edges.filter("graph = 'two' and src < 'n01' and dst < 'n02'"), 3, strategy="distributed")


def test_large_graphs_take_their_rounds_side_by_side(spark, monkeypatch):
    import threading

    rng = np.random.default_rng(5)
    rows = []
    for g in ("one", "two"):
        for i in range(12):
            for j in range(i):
                w = float(rng.random() * (1.0 if i // 6 == j // 6 else 0.02))
                rows += [(g, f"n{i:02d}", f"n{j:02d}", w), (g, f"n{j:02d}", f"n{i:02d}", w)]
    edges = spark.createDataFrame(rows, "graph string, src string, dst string, w double")
    both, leading = threading.Barrier(2, timeout=120), krylov.leading
    monkeypatch.setattr(krylov, "leading", lambda *a: both.wait() >= 0 and leading(*a))  # one alone would wait in vain
    one, two = (clusters.spectral(edges, 2, strategy=s).collect() for s in ("local", "distributed"))
    assert _as_partition(one) == _as_partition(two)
    assert sorted((r.graph, r.node, round(r.strength, 9)) for r in one) == sorted((r.graph, r.node, round(r.strength, 9)) for r in two)


def test_kmeans_rows_equal_kmeans(spark):
    rng = np.random.default_rng(13)
    x = np.concatenate([rng.normal(c, 0.3, (20, 3)) for c in (-2, 0, 2)])
    rows = spark.createDataFrame([(f"n{i:02d}", [float(v) for v in r]) for i, r in enumerate(x)], "node string, v array<double>").repartition(3)
    got = {r.node: r.cluster for r in clusters.kmeans_rows(rows, 3, n_init=5).collect()}
    assert [got[f"n{i:02d}"] for i in range(60)] == clusters.kmeans(x, 3, n_init=5).tolist()


@pytest.mark.parametrize("block", [2048, 7])
def test_similarity_join_equals_all_pairs_and_makes_few(spark, block):
    rng = np.random.default_rng(21)
    x = rng.normal(size=(700, 5))
    x = np.concatenate([x, np.repeat(x[:1], 60, 0), -x[1:20], [[1, 1, 1, 1, 1]]])  # a hot direction, opposites, a constant series
    rows = [("one" if i % 5 else "two", f"n{i:03d}", t, float(v)) for i, r in enumerate(x) for t, v in enumerate(r)]
    packed = layers.pack(spark.createDataFrame(rows, "layer string, node string, t int, value double")).cache()
    every = layers.correlations(packed).cache()
    least = K.inverse_threshold("exponential_abs", 0.01, 0.0025)
    pairs = simjoin.candidate_pairs(packed, least, block)
    c = layers.dot(F.col("x"), F.col("y"), 5)
    got = {(r.layer, *sorted((r.m, r.n))) for r in pairs.filter(F.abs(c) >= least).collect()}
    assert got == {(r.layer, r.src, r.dst) for r in every.filter(F.abs("c") >= least).collect()} and len(got) > 1000
    assert pairs.count() == pairs.select("layer", F.least("m", "n"), F.greatest("m", "n")).distinct().count() < every.count() / 4
    long_ = spark.createDataFrame([r for r in rows if r[1] < "n100"], "layer string, node string, t int, value double")
    one, two = (layers.layer_graphs(long_, "gaussian_abs", 0.01, prune=p).edges.select("layer", "src", "dst", F.round("w", 9)).collect() for p in (True, False))
    assert sorted(map(tuple, one)) == sorted(map(tuple, two))


def test_copies_of_a_series_are_compared_once(spark, monkeypatch):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(30, 5))
    rows = [("a", f"n{i:02d}c{c:02d}", t, float(v)) for i, x in enumerate(base) for c in range(40 if i else 3) for t, v in enumerate(x)]
    long_ = spark.createDataFrame(rows, "layer string, node string, t int, value double")
    met = []
    pairs = simjoin.candidate_pairs
    monkeypatch.setattr(simjoin, "candidate_pairs", lambda *a: met.append(pairs(*a)) or met[-1])
    one = layers.layer_graphs(long_, "exponential_abs", 0.02, basis=False, prune=True).edges
    two = layers.layer_graphs(long_, "exponential_abs", 0.02, basis=False, prune=False).edges
    one, two = (sorted((r.src, r.dst, round(r.w, 9), r.sign) for r in e.collect()) for e in (one, two))
    assert one == two and len(one) > 29 * 40 * 39
    assert met[0].count() <= 30 * 31 / 2
    rows = simjoin.classes(layers.pack(long_), 16).select("node", "nodes").collect()  # long lists are cut, no name is lost
    assert sorted(x for r in rows for x in r.nodes) == sorted({x for x, _, _, _ in one}) and 60 < len(rows) and all(r.node == min(r.nodes) for r in rows)


def test_edges_of_copies_come_in_runs(spark):
    rng = np.random.default_rng(5)
    rows = [("a", f"n{i:02d}c{c:02d}", t, float(v)) for i, x in enumerate(rng.normal(size=(30, 5))) for c in range(40) for t, v in enumerate(x)]
    long_ = spark.createDataFrame(rows, "layer string, node string, t int, value double")
    got = layers.layer_graphs(long_, "exponential_abs", 0.02, basis=False, prune=True).edges.collect()
    for column in ("src", "w"):  # what a Parquet file holds in few bytes
        assert 1 + sum(a[column] != b[column] for a, b in zip(got, got[1:])) <= len(got) / 39
    one, two = (sorted(map(tuple, layers.layer_graphs(long_, "exponential_abs", 0.02, basis=False, prune=p, digits=6).edges.collect())) for p in (True, False))
    assert one == two == sorted((r.layer, r.src, r.dst, round(r.w, 6), r.sign) for r in got) and len(one) >= 30 * 40 * 39


def test_part_series_of_odd_line_items(spark, tmp_path):
    items = [(1, "A", 2.0, 1995), (1, "A", 3.0, 1995), (1, "A", 4.0, 1999), (1, "R", None, 1997), (2, "A", 1.0, 1996), (2, "A", 9.0, 1994), (2, "A", 9.0, 2000), (None, "A", 5.0, 1999), (3, None, 5.0, 1999), (4, "N", 7.0, None)]
    df = spark.createDataFrame(items, "l_partkey long, l_returnflag string, l_quantity double, y int").selectExpr("l_partkey", "l_returnflag", "l_quantity", "make_timestamp(y, 12, 31, 23, 59, 59) AS l_shipdate")
    df.write.parquet(f"{tmp_path}/lineitem.parquet")
    series = star.part_series(spark, str(tmp_path))
    assert {(r.layer, r.node): r.v for r in series.collect()} == {("A", "1"): [5.0, 0.0, 0.0, 4.0], ("A", "2"): [0.0, 1.0, 0.0, 0.0], ("R", "1"): [0.0] * 4}  # 1998 has no line item
    assert layers.pack(series)._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 0  # it was shuffled once, before it was written
    df.filter("false").write.parquet(f"{tmp_path}/none/lineitem.parquet")
    assert star.part_series(spark, f"{tmp_path}/none").count() == 0


def test_tasks_of_a_similarity_join_grow_with_its_names(spark, monkeypatch):
    rows = [("a", f"n{i}c{c}", t, float((i + t * t) % 7)) for i in range(7) for c in range(60) for t in range(4)]
    packed = layers.pack(spark.createDataFrame(rows, "layer string, node string, t int, value double"))
    monkeypatch.setattr(simjoin, "TASK", 50)
    one = layers.correlations_above(packed, 0.9)
    assert one.rdd.getNumPartitions() >= 8 > int(spark.conf.get("spark.sql.shuffle.partitions"))
    every = layers.correlations(packed).filter("abs(c) >= 0.9")
    assert one.select("src", "dst").exceptAll(every.select("src", "dst")).isEmpty() and one.count() == every.count() > 7 * 60 * 59 / 2 - 1


def test_similarity_join_of_little(spark):
    for series in ({}, {"a": [1, 1, 1]}, {"a": [0, 1, 2]}, {"a": [0, 1, 2], "b": [2, 1, 0], "c": [5, 5, 5]}):
        m = long(spark, series) if series else spark.createDataFrame([], "layer string, node string, t int, value double")
        assert layers.correlations_above(layers.pack(m), 0.9).count() == (1 if len(series) == 3 else 0)


def test_order_statistics_equal_a_sort(spark):
    rng = np.random.default_rng(31)
    values = {"a": rng.normal(size=4000), "b": np.repeat([1.0, -2.0, 5.0], 700), "c": np.concatenate([rng.random(50) * 1e-300, [1e308, -1e308, 0.0]]), "d": np.array([3.0])}
    df = spark.createDataFrame([(k, float(v)) for k, vs in values.items() for v in vs] + [("a", None), ("e", None)], "layer string, w double").repartition(4)
    ranks = {k: sorted({1, len(v) // 3 + 1, (len(v) + 1) // 2, len(v), len(v) + 1}) for k, v in values.items()} | {"e": [1], "none": [1]}
    got = selection.order_statistics(df, "layer", "w", ranks)
    assert got == {(k, r): np.sort(v)[r - 1] for k, v in values.items() for r in ranks[k] if r <= len(v)}
    cuts = selection.quantile_cuts(df, "layer", "w", 0.9)
    want = {r.layer: r.q for r in df.filter("w is not null").groupBy("layer").agg(F.percentile("w", F.lit(0.9)).alias("q")).collect()}
    assert cuts == want and selection.quantile_cuts(df.limit(0), "layer", "w", 0.5) == {}


def test_first_rows_of_each_group(spark):
    rng = np.random.default_rng(32)
    rows = [(f"l{i % 3}", f"n{i:04d}", int(rng.integers(20))) for i in range(900)]
    df = spark.createDataFrame(rows, "layer string, node string, x int")
    got = {(r.layer, r.node) for r in selection.first_rows(df, ["layer"], [F.desc("x"), F.col("node")], 50, "node").collect()}
    assert got == {r[:2] for k in range(3) for r in sorted((r for r in rows if r[0] == f"l{k}"), key=lambda r: (-r[2], r[1]))[:50]}


@pytest.mark.parametrize("side", [512, 3])
def test_clustering_of_asymmetric_weights_and_hubs(spark, monkeypatch, side):
    monkeypatch.setattr(metrics, "SIDE", side)
    rng = np.random.default_rng(33)
    n = 25
    a = rng.normal(size=(n, n)) * (rng.random((n, n)) < 0.3)
    a[0, 1:], a[1:, 0] = rng.random(n - 1), rng.random(n - 1)  # a hub
    a[n - 1] = a[:, n - 1] = 0
    names = [f"n{i:02d}" for i in range(n)]
    nodes = spark.createDataFrame([("l", x) for x in names], "layer string, node string")
    edges = spark.createDataFrame([("l", names[i], names[j], float(a[i, j])) for i in range(n) for j in range(n) if a[i, j]], "layer string, src string, dst string, w double")
    m = np.abs(a)
    np.fill_diagonal(m, 0)
    want = []
    for i in range(n):
        pairs = [(j, k) for j in range(n) for k in range(n) if j != k and i not in (j, k)]
        num, den = sum(m[i, j] * m[j, k] * m[k, i] for j, k in pairs), sum(m[i, j] * m[k, i] for j, k in pairs)
        want.append(num / den / m.max() if den > 0 else 0)
    g = layers.Graph(edges, nodes)
    assert metrics.clustering_coefficient(g).first().clustering == pytest.approx(np.mean(want), rel=1e-12)
    hub = layers.Graph(spark.range(1, 3001).select(F.lit("l").alias("layer"), F.explode(F.array(F.struct(F.lit("h").alias("s"), F.concat(F.lit("x"), "id").alias("d")), F.struct(F.concat(F.lit("x"), "id").alias("s"), F.lit("h").alias("d")))).alias("e"), F.lit(1.0).alias("w")).select("layer", F.col("e.s").alias("src"), F.col("e.d").alias("dst"), "w"), nodes)
    assert metrics.ordered_pairs(hub.edges, ["layer"]).agg(F.max("later")).first()[0] == 1  # no wedge begins at the hub


def test_walks_to_a_set_go_on_until_enough_succeed(spark):
    edges = spark.createDataFrame([("a", "b", 0.5), ("a", "dead", 0.5), ("b", "X_rna", 1.0), ("a", "y_RNA", 0.01)], "src string, dst string, w double")
    w = walks.walks_to_set(edges, "a", "rna", 200).collect()
    assert sum(r.success for r in w) == 200 < len(w) and w[-1].success and {r.end_node for r in w if r.success} == {"X_rna", "y_RNA"}
    assert all(r.path[0] == "a" and r.path[-1] == r.end_node and len(r.path) == r.steps and r.unique_nodes == len(set(r.path)) for r in w)
    with pytest.raises(ValueError):
        walks.walks_to_set(edges, "a", "nothing", 5)


def test_expectations_by_joins_equal_the_dense_ones(spark):
    rows = [("a", "b", 0.5), ("b", "c", 1.0), ("c", "a", 0.3), ("a", "c", 0.5), ("d", "a", 1.0), ("c", "dead", 0.6), ("e", "d", 1.0)]
    edges = spark.createDataFrame(rows, "src string, dst string, w double")
    for targets in (["b"], ["b", "dead"], ["nope"], []):
        one, two = ({r.node: r.probability for r in walks.absorption(edges, targets, 0.1, 0.0, 7, k).collect()} for k in ("local", "distributed"))
        assert one == pytest.approx(two, abs=1e-12) and set(two) == set("abcde") | {"dead"}
    for steps in (1, 2, 9):
        one, two = ({r.node: r.frequency for r in walks.expected_visits(edges, "a", 0.2, steps, k).collect()} for k in ("local", "distributed"))
        assert one == pytest.approx(two, abs=1e-12) and sum(two.values()) == pytest.approx(1)


def test_walkers_over_joins_take_the_same_walks(spark):
    rng = np.random.default_rng(41)
    names = [f"n{i:02d}" for i in range(12)]
    rows = [(names[i], names[j], float(rng.random())) for i in range(11) for j in range(12) if rng.random() < 0.3]
    rows += [("n00", f"m{k:03d}", 0.02 * float(rng.random()) + 0.002) for k in range(60)] + [(f"m{k:03d}", "n01", 1.0) for k in range(0, 60, 2)]  # a hub, and dead ends
    edges = spark.createDataFrame(rows, "src string, dst string, w double")
    for restart, most in ((0.1, 1000), (0.0, 6)):
        one = walks.simulate(edges, ["n00"], {1: ["n11"], 2: ["n10"]}, 150, restart, max_steps=most, seed=3, first=20).collect()
        goal = F.when(F.col("node") == "n11", 1).when(F.col("node") == "n10", 2)
        two = walkers.simulate(edges, "n00", goal, 150, restart, max_steps=most, seed=3, first=20).collect()
        assert sorted(map(tuple, one)) == sorted(map(tuple, two)) and {r.code for r in two} >= ({1, -1} if restart else {1, -2})
    with pytest.raises(ValueError):
        walkers.simulate(edges, "nowhere", F.lit(0), 5, 0.1)


def test_slots_hold_every_edge_about_twice(spark):
    edges = spark.createDataFrame([("a", f"x{k:04d}", 0.5 if k == 0 else 0.5 / 499) for k in range(500)], "src string, dst string, w double")
    table, nodes = walkers.slots(edges, F.lit(0), 0.0)
    s = table.groupBy("slot").agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)), F.sum("n")).first()
    assert s[0] == 500 and s[1] <= 1000 and nodes.count() == 501
