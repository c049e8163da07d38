"""Sparse positive-definite precision graphs: column lassos, then a primal-dual proximal iteration.

Layers of at most LOCAL_NODES nodes take one task each; larger ones are tables of tiles (``tiled``), with the same iteration: the lassos
are dealt to tasks by blocks of columns, the projection is a polynomial iteration of tiled products, and gradients and losses go by
the residuals X (I + off(Omega) T), which have as many rows as there are times.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.names import BASIS
from ..plans.stages import drop, materialize
from . import metrics, tiles
from .layers import Graph, basis_rows, pack
from .tiles import Grid

CLIP, TAU_FLOOR = 1e6, 1e-6
#: Nodes of a layer that one task solves; coefficients that a lasso task holds at a time.
LOCAL_NODES, COEFFICIENTS = 2000, 1 << 22


def finite(a: np.ndarray, clip: float = CLIP) -> np.ndarray:
    return np.clip(np.nan_to_num(a, nan=0.0, posinf=clip, neginf=-clip), -clip, clip)


def project(omega: np.ndarray, floor: float = 1e-6) -> np.ndarray:
    """Nearest symmetric matrix with eigenvalues of at least ``floor``."""
    val, vec = np.linalg.eigh((omega + omega.T) / 2)
    return (vec * np.maximum(val, floor)) @ vec.T


def lasso(x: np.ndarray, at: np.ndarray, lam: float, rounds: int = 10_000, tol: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients (p, targets) of the lassos of the columns ``at`` on all others (1/2n loss, no intercept), and tau^2 of residuals.

    Cyclic coordinate descent runs over the targets at once and ends for each on its own, so a target's result does not depend on the others;
    the fits ``x @ b`` follow each step, so a round takes n * p products a target.
    """
    n, p = x.shape
    own = (x * x).mean(0)
    b, fit = np.zeros((p, len(at))), np.zeros((n, len(at)))
    open_ = np.arange(len(at))
    for _ in range(rounds):
        y, part_b, part_fit = x[:, at[open_]], b[:, open_], fit[:, open_]
        move = np.zeros(len(open_))
        for k in range(p):
            if own[k] <= 0:
                continue
            part = x[:, k] @ (y - part_fit) / n + own[k] * part_b[k]
            new = np.sign(part) * np.maximum(np.abs(part) - lam, 0) / own[k]
            new[at[open_] == k] = 0
            step = new - part_b[k]
            if step.any():
                move = np.maximum(move, np.abs(step))
                part_fit += np.outer(x[:, k], step)
                part_b[k] = new
        b[:, open_], fit[:, open_] = part_b, part_fit
        open_ = open_[move >= tol]
        if not len(open_):
            break
    return b, np.clip(((x[:, at] - x @ b) ** 2).mean(0), TAU_FLOOR, CLIP)


def lasso_columns(x: np.ndarray, lam: float) -> tuple[np.ndarray, np.ndarray]:
    """Start: column j of Omega from the lasso of x_j on the others, and tau^2."""
    b, tau2 = lasso(x, np.arange(x.shape[1]), lam)
    omega = -b / tau2
    np.fill_diagonal(omega, 1 / tau2)
    return finite(omega), tau2


def _loss(omega: np.ndarray, gram: np.ndarray, tau2: np.ndarray) -> float:
    """Sum over j of the squared residual of x_j + tau_j X_-j Omega_-j,j, by the Gram matrix."""
    off = omega * np.sqrt(tau2)
    np.fill_diagonal(off, 0)
    both = np.eye(len(gram)) + off
    return float((both * (gram @ both)).sum())


def _penalty(omega: np.ndarray, tau2: np.ndarray, lam: float) -> float:
    off = np.abs(omega)
    np.fill_diagonal(off, 0)
    return float(lam * (off * np.sqrt(tau2)).sum())


def _gradient(omega: np.ndarray, gram: np.ndarray, tau2: np.ndarray) -> np.ndarray:
    tau = np.sqrt(tau2)
    off = omega * tau
    np.fill_diagonal(off, 0)
    g = 2 * tau * (gram @ (np.eye(len(gram)) + off))
    np.fill_diagonal(g, 0)
    return g


def _prox(v: np.ndarray, tau2: np.ndarray, lam: float, eta: float) -> np.ndarray:
    out = np.sign(v) * np.maximum(np.abs(v) - tau2 * lam / eta, 0)
    np.fill_diagonal(out, 1 / tau2)
    return out


def solve(x: np.ndarray, lam: float = 0.01, gamma: float = 0.02, eta: float = 20.0, max_iter: int = 500, return_omega: bool = False) -> tuple[np.ndarray, list[float]]:
    """Omega, or the scaled graph Q = -T Omega T with T = diag(tau), and the losses of the iterations."""
    x = finite(np.asarray(x, float))
    gram = x.T @ x
    omega, tau2 = lasso_columns(x, lam)
    omega = project(omega)
    u = np.zeros_like(omega)
    losses = [_loss(omega, gram, tau2) + _penalty(omega, tau2, lam)]
    grad = _gradient(omega, gram, tau2)
    for _ in range(max_iter):
        new = finite(project(omega - gamma * u - gamma * grad))
        grad_new = _gradient(new, gram, tau2)
        v = finite(u + eta * (2 * new - omega + gamma * (grad - grad_new)))
        u = finite(v - eta * _prox(v / eta, tau2, lam, eta))
        omega, grad = new, grad_new
        losses.append(_loss(omega, gram, tau2) + _penalty(omega, tau2, lam))
        if len(losses) > 2 and abs(losses[-1] - losses[-2]) < 1e-6:
            break
    if return_omega:
        return omega, losses
    t = np.sqrt(tau2)
    return -(t[:, None] * omega * t[None]), losses


class Tiled:
    """The solver's state for one layer as tables: tiles (i, j, w, u) of Omega and the dual, and strips (s, x, tau2, r, loss) of columns.

    ``r`` are the residuals X (I + off(Omega) T) of the strip's columns, n rows. A task holds a few tiles or, in the lassos, X and
    COEFFICIENTS numbers.
    """

    def __init__(self, rows: DataFrame, lam: float, tile: int = tiles.TILE, smallest: float = tiles.SMALLEST):
        """rows: (node, z) of the layer, z not null, all of one length."""
        self.lam, self.smallest = lam, smallest
        # a place for each node in the order of names: its place in its range of the sort, after the rows of the ranges before
        made = materialize(rows.select("node", "z").orderBy("node").withColumn("at", F.monotonically_increasing_id()), "precision")
        part = F.shiftright("at", 33)
        sizes = {r.part: r.n for r in made.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()}
        first, total = [], 0
        for k in sorted(sizes):
            first.append((k, total))
            total += sizes[k]
        before = F.broadcast(made.sparkSession.createDataFrame(first, "part long, first long"))
        place = (F.col("first") + F.col("at") - F.shiftleft(part, 33)).cast("int")
        self.nodes = made.withColumn("part", part).join(before, "part").select(place.alias("at"), "node", "z")
        self.grid, self.n = Grid(total, tile), made.select(F.size("z")).first()[0]
        started = materialize(self._lassos(), "precision")
        tau2 = started.filter("i < 0").select(F.col("j").alias("s"), F.col("w").alias("tau2"))
        self.strips = self._x().join(tau2, "s").select("s", "x", "tau2")
        self.state: DataFrame | None = None
        new, strips = self._project(started.filter("i >= 0"))
        grid = self.grid

        def begin(rows: Iterator[list]) -> Iterator[list]:
            for r, c, flip, a in rows:
                w = np.ascontiguousarray(tiles.oriented(grid, a, r, c, flip))
                yield [[r], [c], [w.tobytes()], [np.zeros_like(w).tobytes()]]

        self._keep(tiles.streamed(tiles.whole(new), begin, "i int, j int, w binary, u binary"), strips)
        for df in (new, started):
            drop(df)

    def _keep(self, state: DataFrame, strips: DataFrame) -> None:
        """Takes new tables, the strips already written, and deletes those that nothing reads any more."""
        state = materialize(state, "precision")
        for old in (self.state, self.strips) if self.state is not None else ():
            drop(old)
        self.state, self.strips = state, strips

    def _x(self) -> DataFrame:
        """(s, x): the columns of X of each strip, n rows of the strip's width."""
        grid, n = self.grid, self.n

        def cut(key: tuple, rows: Iterator[list]) -> Iterator[list]:
            x = np.array([z for _, _, z in rows], float).reshape(grid.width(key[0]), n)
            yield [[key[0]], [np.ascontiguousarray(finite(x).T).tobytes()]]

        return tiles.gathered(self.nodes.select((F.col("at") / grid.tile).cast("int").alias("s"), "at", "z"), ["s"], ["at"], cut, "s int, x binary")

    def _lassos(self) -> DataFrame:
        """(i, j, w) tiles of the start, not symmetric, and with i = -1 the tau^2 of strip j; a task takes the targets of a strip."""
        grid, n, lam = self.grid, self.n, self.lam
        rows = self._x().select(F.explode(F.sequence(F.lit(0), F.lit(grid.count - 1))).alias("j"), F.col("s").alias("k"), "x")

        def fit(key: tuple, group: Iterator[list]) -> Iterator[list]:
            j = key[0]
            x = np.concatenate([np.frombuffer(v).reshape(n, -1) for _, _, v in group], axis=1)
            at = np.arange(j * grid.tile, j * grid.tile + grid.width(j))
            found, tau2 = [], np.zeros(len(at))
            some = max(1, COEFFICIENTS // grid.size)
            for first in range(0, len(at), some):
                b, tau2[first : first + some] = lasso(x, at[first : first + some], lam)
                k, c = np.nonzero(b)  # at most some n of them a target where the lasso has settled
                found.append((k, c + first, b[k, c]))
            k, c, v = (np.concatenate(f) for f in zip(*found))
            yield [[-1], [j], [tau2.tobytes()]]
            for i in range(grid.count):
                w = np.zeros((grid.width(i), len(at)))
                here = (k >= i * grid.tile) & (k < i * grid.tile + grid.width(i))
                w[k[here] - i * grid.tile, c[here]] = -v[here] / tau2[c[here]]
                if i == j:
                    np.fill_diagonal(w, 1 / tau2)
                yield [[i], [j], [finite(w).tobytes()]]

        return tiles.gathered(rows, ["j"], ["k"], fit, "i int, j int, w binary")

    def _project(self, a: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Written (i, j, a), i <= j, of the nearest positive matrix of the tiles (i, j, w), and the written strips that belong to it."""
        grid, floor = self.grid, 1e-6
        keyed = a.select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), (F.col("i") > F.col("j")).alias("flip"), F.col("w").alias("a"))

        def even(key: tuple, rows: Iterator[list]) -> Iterator[list]:
            i, j = key
            total = sum(tiles.oriented(grid, a, i, j, flip) for _, _, flip, a in rows)
            total = (total + total.T) / 2 - floor * np.eye(len(total)) if i == j else total / 2
            yield [[i], [j], [np.ascontiguousarray(total).tobytes()]]

        b = materialize(tiles.gathered(keyed, ["i", "j"], ["flip"], even, "i int, j int, a binary"), "precision")
        part = tiles.positive(b, grid, self.smallest)

        def lift(rows: Iterator[list]) -> Iterator[list]:
            for i, j, a in rows:
                w = grid.read(a, i, j)
                yield [[i], [j], [finite(w + floor * np.eye(len(w)) if i == j else w).tobytes()]]

        new = materialize(tiles.streamed(part.select("i", "j", "a"), lift, "i int, j int, a binary"), "precision")
        strips = materialize(self._residuals(new), "precision")
        drop(part)
        drop(b)
        return new, strips

    def _residuals(self, new: DataFrame) -> DataFrame:
        """The strips for a new Omega, with their part of the loss and the penalty."""
        grid, n, lam = self.grid, self.n, self.lam
        own = self.strips.select(F.col("s").alias("c"), "tau2")
        met = tiles.whole(new).join(self.strips.select(F.col("s").alias("r"), "x"), "r").join(own, "c").select("r", "c", "flip", "a", "x", "tau2")

        def multiply(rows: Iterator[list]) -> Iterator[list]:
            for r, c, flip, a, x, tau2 in rows:
                off = tiles.oriented(grid, a, r, c, flip) * np.sqrt(np.frombuffer(tau2))
                if r == c:
                    np.fill_diagonal(off, 0)
                yield [[c], [r], [(np.frombuffer(x).reshape(n, -1) @ off).tobytes()], [lam * float(np.abs(off).sum())]]

        parts = tiles.streamed(met, multiply, "s int, i int, part binary, loss double")
        none = F.lit(None).cast("binary")
        rows = self.strips.select("s", F.lit(-1).alias("i"), none.alias("part"), F.lit(0.0).alias("loss"), "x", "tau2").union(parts.select("s", "i", "part", "loss", none, none))

        def add(key: tuple, group: Iterator[list]) -> Iterator[list]:
            *_, x, tau2 = next(group)
            r, loss = np.frombuffer(x).copy(), 0.0
            for _, _, part, penalty, *_ in group:
                r += np.frombuffer(part)
                loss += penalty
            yield [[key[0]], [x.to_pybytes()], [tau2.to_pybytes()], [r.tobytes()], [loss + float(r @ r)]]

        return tiles.gathered(rows, ["s"], ["i"], add, "s int, x binary, tau2 binary, r binary, loss double")

    def loss(self) -> float:
        return float(self.strips.agg(F.sum("loss")).first()[0])

    def least_squares(self) -> float:
        """:func:`least_squares` of the present Omega: parts X Omega of the tiles are added up by strip, then divided by the diagonal."""
        grid, n = self.grid, self.n
        met = self.state.select("i", "j", "w").join(self.strips.select(F.col("s").alias("i"), "x"), "i").select("j", "i", "w", "x")

        def multiply(rows: Iterator[list]) -> Iterator[list]:
            for j, i, w, x in rows:
                a = grid.read(w, i, j)
                diagonal = np.diag(a).tobytes() if i == j else None
                yield [[j], [i], [(np.frombuffer(x).reshape(n, -1) @ a).tobytes()], [diagonal]]

        def add(key: tuple, group: Iterator[list]) -> Iterator[list]:
            total, diagonal = 0.0, None
            for _, _, part, own in group:
                total = total + np.frombuffer(part).reshape(n, -1)
                diagonal = diagonal if own is None else np.frombuffer(own).copy()
            yield [[float(np.square(total / diagonal).sum())]]

        parts = tiles.streamed(met, multiply, "j int, i int, part binary, diagonal binary")
        return float(tiles.gathered(parts, ["j"], ["i"], add, "loss double").agg(F.sum("loss")).first()[0])

    def _met(self) -> DataFrame:
        """(i, j, w, u, xi, tau2, r): the tiles with what their gradient takes, r the residuals of strip j."""
        left = self.strips.select(F.col("s").alias("i"), F.col("x").alias("xi"))
        return self.state.join(left, "i").join(self.strips.select(F.col("s").alias("j"), "tau2", "r"), "j").select("i", "j", "w", "u", "xi", "tau2", "r")

    def step(self, gamma: float, eta: float) -> None:
        """One iteration: the projected step of Omega, then that of the dual."""
        grid, n, lam = self.grid, self.n, self.lam

        def gradient(i: int, j: int, x: object, tau2: np.ndarray, r: object) -> np.ndarray:
            g = 2 * np.sqrt(tau2) * (np.frombuffer(x).reshape(n, -1).T @ np.frombuffer(r).reshape(n, -1))
            if i == j:
                np.fill_diagonal(g, 0)
            return g

        def down(rows: Iterator[list]) -> Iterator[list]:
            for i, j, w, u, x, tau2, r in rows:
                g = gradient(i, j, x, np.frombuffer(tau2), r)
                yield [[i], [j], [(grid.read(w, i, j) - gamma * grid.read(u, i, j) - gamma * g).tobytes()]]

        new, strips = self._project(tiles.streamed(self._met(), down, "i int, j int, w binary"))
        other = strips.select(F.col("s").alias("j"), F.col("r").alias("after"))
        met = self._met().join(other, "j").join(tiles.whole(new).select(F.col("r").alias("i"), F.col("c").alias("j"), "flip", "a"), ["i", "j"])

        def dual(rows: Iterator[list]) -> Iterator[list]:
            for i, j, w, u, x, tau2, r, after, flip, a in rows:
                t = np.frombuffer(tau2)
                now = tiles.oriented(grid, a, i, j, flip)
                change = gradient(i, j, x, t, r) - gradient(i, j, x, t, after)
                v = finite(grid.read(u, i, j) + eta * (2 * now - grid.read(w, i, j) + gamma * change))
                prox = np.sign(v) * np.maximum(np.abs(v / eta) - t * lam / eta, 0)
                if i == j:
                    np.fill_diagonal(prox, 1 / t)
                yield [[i], [j], [np.ascontiguousarray(now).tobytes()], [finite(v - eta * prox).tobytes()]]

        met = met.select("i", "j", "w", "u", "xi", "tau2", "r", "after", "flip", "a")
        self._keep(tiles.streamed(met, dual, "i int, j int, w binary, u binary"), strips)
        drop(new)

    def edges(self, threshold: float) -> DataFrame:
        """(src, dst, w, sign) of Q = -T Omega T with diagonal 0, abs(Q) at least ``threshold``."""
        grid = self.grid
        met = self.state.join(self.strips.select(F.col("s").alias("i"), F.col("tau2").alias("ti")), "i").join(self.strips.select(F.col("s").alias("j"), F.col("tau2").alias("tj")), "j")

        def cut(rows: Iterator[list]) -> Iterator[list]:
            for i, j, w, ti, tj in rows:
                q = np.nan_to_num(-(np.sqrt(np.frombuffer(ti))[:, None] * grid.read(w, i, j) * np.sqrt(np.frombuffer(tj))))
                if i == j:
                    np.fill_diagonal(q, 0)
                for first in range(0, len(q), 64):
                    part = q[first : first + 64]
                    a, b = np.nonzero(np.abs(part) >= threshold)
                    yield [a + first + i * grid.tile, b + j * grid.tile, np.abs(part[a, b]), np.sign(part[a, b]).astype(int)]

        found = tiles.streamed(met.select("i", "j", "w", "ti", "tj"), cut, "a bigint, b bigint, w double, sign int")
        src, dst = (self.nodes.select(F.col("at").cast("long").alias(k), F.col("node").alias(n)) for k, n in (("a", "src"), ("b", "dst")))
        return found.join(src, "a").join(dst, "b").select("src", "dst", "w", "sign")


def tiled(rows: DataFrame, lam: float = 0.01, gamma: float = 0.02, eta: float = 20.0, max_iter: int = 500, tile: int = tiles.TILE, smallest: float = tiles.SMALLEST) -> tuple[Tiled, list[float]]:
    """:func:`solve` for one layer's (node, z) in tiles: the final state, whose ``edges`` are the graph, and the losses of the iterations."""
    state = Tiled(rows, lam, tile, smallest)
    losses = [state.loss()]
    for _ in range(max_iter):
        state.step(gamma, eta)
        losses.append(state.loss())
        if len(losses) > 2 and abs(losses[-1] - losses[-2]) < 1e-6:
            break
    return state, losses


def _problems(packed: DataFrame, lams: list[float]) -> tuple[DataFrame, list[str]]:
    """The rows of layers that a task solves, once a lambda as ``param`` and dealt to as many partitions as problems, and the larger layers."""
    sizes = {r.layer: r["count"] for r in packed.groupBy("layer").count().collect()}
    large = sorted(k for k, v in sizes.items() if v > LOCAL_NODES)
    small = packed.filter(~F.col("layer").isin(large)) if large else packed
    # the rows are few and the work is not, so their number is set, lest they be put together
    return small.select("*", F.explode(F.array(*[F.lit(float(v)) for v in lams])).alias("param")).repartition(max(1, (len(sizes) - len(large)) * len(lams)), "layer", "param"), large


def _solved(packed: DataFrame, lams: list[float], threshold: float, gamma: float, eta: float, max_iter: int, tile: int = tiles.TILE) -> DataFrame:
    """(layer, param, src, dst, w, sign) of each layer's precision graph at each lambda, and a row with src and dst '' and the final loss as w."""
    packed = packed.filter("z is not null").select("layer", "node", "z")
    small, large = _problems(packed, lams)
    schema = "layer string, param double, src string, dst string, w double, sign int"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node")
        q, loss = solve(np.array(pdf.z.tolist(), float).T, pdf.param.iloc[0], gamma, eta, max_iter)
        q = np.nan_to_num(q)
        np.fill_diagonal(q, 0)
        i, j = np.nonzero(np.abs(q) >= threshold)
        names = pdf.node.to_numpy()
        out = pd.DataFrame({"src": [*names[i], ""], "dst": [*names[j], ""], "w": [*np.abs(q[i, j]), loss[-1]], "sign": [*np.sign(q[i, j]).astype(int), 0]})
        return out.assign(layer=pdf.layer.iloc[0], param=pdf.param.iloc[0])

    out = small.groupBy("layer", "param").applyInPandas(run, schema)
    for layer in large:
        for lam in lams:
            state, losses = tiled(packed.filter(F.col("layer") == layer), lam, gamma, eta, max_iter, tile)
            at = [F.lit(layer).alias("layer"), F.lit(float(lam)).alias("param")]
            last = packed.sparkSession.range(1).select(*at, F.lit("").alias("src"), F.lit("").alias("dst"), F.lit(losses[-1]).alias("w"), F.lit(0).alias("sign"))
            out = out.unionByName(state.edges(threshold).select(*at, "src", "dst", "w", "sign")).unionByName(last)
    return out


def lasso_graphs(m: DataFrame, lam: float = 0.01, threshold: float = 0.01, start: str | None = "e3", end: str | None = "e5", gamma: float = 0.02, eta: float = 20.0, max_iter: int = 500) -> Graph:
    """Graph of each layer from its sparse precision matrix: abs(Q) at least ``threshold``, diagonal 0, with signs.

    Basis nodes are added unless start and end are both None; edges of basis nodes that are neither go as in
    ``layer_graphs``. Constant series are left out of the solver and stay as isolated nodes.
    """
    packed = pack(m)
    if start is not None or end is not None:
        packed = packed.unionByName(basis_rows(packed))
    edges = _solved(packed, [lam], threshold, gamma, eta, max_iter).filter("src <> ''").drop("param")
    if {start, end} & set(BASIS):
        out = [b for b in BASIS if b not in (start, end)]
        edges = edges.filter(~F.col("src").isin(out) & ~F.col("dst").isin(out))
    return Graph(edges, packed.select("layer", "node"))


def lambda_sweep(m: DataFrame, lams: list[float], threshold: float = 0.01, gamma: float = 0.02, eta: float = 20.0, max_iter: int = 500) -> DataFrame:
    """Metrics of every layer's precision graph at every lambda: the metrics of ``metrics.sweep`` and the final loss."""
    solved = materialize(_solved(pack(m), lams, threshold, gamma, eta, max_iter), "precision")
    nodes = pack(m).select("layer", "node", F.explode(F.array(*[F.lit(float(v)) for v in lams])).alias("param"))
    out = metrics.table(Graph(solved.filter("src <> ''").drop("sign"), nodes), ("layer", "param"))
    return out.join(solved.filter("src = ''").select("layer", "param", F.col("w").alias("loss")), ["layer", "param"], "left")


def least_squares(x: np.ndarray, omega: np.ndarray) -> float:
    """Sum over j of the squared residual of x_j + X_-j Omega_-j,j / Omega_jj."""
    return float(np.square(finite(np.asarray(x, float)) @ (omega / np.diag(omega))).sum())


def least_squares_sweep(m: DataFrame, lams: list[float], gamma: float = 0.01, eta: float = 0.5, max_iter: int = 100) -> DataFrame:
    """(layer, param, least_squares) of every layer's precision matrix at every lambda, without the penalty."""
    packed = pack(m).filter("z is not null").select("layer", "node", "z")
    small, large = _problems(packed, lams)
    schema = "layer string, param double, least_squares double"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.array(pdf.sort_values("node").z.tolist(), float).T
        omega, _ = solve(x, pdf.param.iloc[0], gamma, eta, max_iter, return_omega=True)
        return pd.DataFrame({"layer": [pdf.layer.iloc[0]], "param": [pdf.param.iloc[0]], "least_squares": [least_squares(x, omega)]})

    out = small.groupBy("layer", "param").applyInPandas(run, schema)
    far = [(layer, float(lam), tiled(packed.filter(F.col("layer") == layer), lam, gamma, eta, max_iter)[0].least_squares()) for layer in large for lam in lams]
    return out.unionByName(m.sparkSession.createDataFrame(far, schema)) if far else out


def top_variance(m: DataFrame, layer: str, n: int = 60) -> DataFrame:
    """(node, variance): the n nodes of a layer whose values vary most."""
    v = m.filter(F.col("layer") == layer).groupBy("node").agg(F.var_samp("value").alias("variance"))
    return v.orderBy(F.desc(F.round("variance", 9)), "node").limit(n)


def symmetry_report(m: DataFrame, layer: str, top_n: int = 60, lam: float = 0.01, gamma: float = 0.02, eta: float = 20.0, max_iter: int = 500) -> DataFrame:
    """One row for the precision graph of the ``top_n`` nodes of a layer that vary most: whether it is symmetric, and its range."""
    top = top_variance(m, layer, top_n).select("node")
    g = lasso_graphs(m.filter(F.col("layer") == layer).join(top, "node", "left_semi").select("layer", "node", "t", "value"), lam, 0.0, None, None, gamma, eta, max_iter)
    g = Graph(materialize(g.edges, "precision"), g.nodes)
    size = g.nodes.groupBy("layer").agg(F.count(F.lit(1)).alias("n_nodes"))
    return size.join(metrics.symmetry(g.edges), "layer", "left").join(metrics.element_range(g), "layer", "left")


def hyper_sweep(m: DataFrame, layer: str, lams: list[float], gammas: list[float] = [0.02], etas: list[float] = [20.0], iters: list[int] = [100], top_n: int = 60) -> DataFrame:  # noqa: B006
    """One row for each combination: status, losses, best iteration, whether losses fall; failures are rows too."""
    import itertools

    top = top_variance(m, layer, top_n)
    x = pack(m.filter(F.col("layer") == layer).join(top.select("node"), "node", "left_semi").select("layer", "node", "t", "value")).filter("z is not null").select("node", "z")
    grid = m.sparkSession.createDataFrame([(i, *map(float, c[:3]), int(c[3])) for i, c in enumerate(itertools.product(lams, gammas, etas, iters))], "combo int, lam double, gamma double, eta double, max_iter int")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node")
        c = pdf.iloc[0]
        row = {"status": "ok", "lam": c.lam, "gamma": c.gamma, "eta": c.eta, "max_iter": int(c.max_iter), "first_loss": np.nan, "final_loss": np.nan, "min_loss": np.nan, "best_iter": -1, "monotone": False, "error": None}
        try:
            _, loss = solve(np.array(pdf.z.tolist(), float).T, c.lam, c.gamma, c.eta, int(c.max_iter))
            row |= {"first_loss": loss[0], "final_loss": loss[-1], "min_loss": min(loss), "best_iter": int(np.argmin(loss)), "monotone": bool((np.diff(loss) <= 1e-9).all())}
        except Exception as e:  # a failed combination is a result
            row |= {"status": "failed", "error": str(e)[:200]}
        return pd.DataFrame([row])

    schema = "status string, lam double, gamma double, eta double, max_iter int, first_loss double, final_loss double, min_loss double, best_iter int, monotone boolean, error string"
    out = grid.crossJoin(F.broadcast(x)).groupBy("combo").applyInPandas(run, schema)
    return out.withColumn("is_best", F.row_number().over(W.orderBy(F.desc("status"), "final_loss", "lam", "gamma", "eta", "max_iter")) == 1)


def spectrum(g: Graph, atol: float = 1e-8) -> DataFrame:
    """(layer, min_eigenvalue, is_psd, condition) of the symmetrised dense matrices."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names = sorted(set(pdf.src) | set(pdf.dst))
        at = {n: i for i, n in enumerate(names)}
        a = np.zeros((len(names),) * 2)
        np.add.at(a, (pdf.src.map(at).to_numpy(), pdf.dst.map(at).to_numpy()), pdf.w.to_numpy())
        val = np.linalg.eigvalsh((a + a.T) / 2)
        pos = val[val > atol]
        return pd.DataFrame({"layer": [pdf.layer.iloc[0]], "min_eigenvalue": [val.min()], "is_psd": [bool(val.min() >= -atol)], "condition": [pos.max() / pos.min() if len(pos) else np.inf]})

    return g.edges.select("layer", "src", "dst", "w").groupBy("layer").applyInPandas(run, "layer string, min_eigenvalue double, is_psd boolean, condition double")
