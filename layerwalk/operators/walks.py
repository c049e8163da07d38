"""Monte-Carlo walks over a sparse graph, and their exact expectations.

Walkers are rows of a range; each task steps its walkers together over shared edge arrays. The numbers of a walker come
from a counter hash of (seed, walk, step), so results do not depend on how walkers are dealt to tasks. Attempts are
bounded: a batch of walks is simulated, and those that fail are told apart; :func:`walks_until` adds batches until enough
have succeeded or a stated budget of attempts is spent. A task keeps the steps of a round as two arrays and cuts them into paths at the end.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.stages import drop, materialize

MAX_STEPS = 100_000
#: Bytes of edge arrays that may be broadcast.
MOST_BYTES = 512 << 20
SCHEMA = "simulation long, start_node string, path array<string>, steps int, success boolean, unique_nodes int, end_node string, code int"


def prepare(edges: DataFrame, min_weight: float = 0.001) -> DataFrame:
    """(src, dst, p, cum): weights above ``min_weight`` as probabilities of each row and their running sum by dst."""
    e = edges.filter(F.col("w") > min_weight)
    w = W.partitionBy("src")
    e = e.withColumn("p", F.col("w") / F.sum("w").over(w))
    return e.select("src", "dst", "p", F.sum("p").over(w.orderBy("dst").rowsBetween(W.unboundedPreceding, 0)).alias("cum"))


class Csr:
    """Neighbours and running probabilities of every node."""

    def __init__(self, src: list[str], dst: list[str], p: np.ndarray):
        self.names = sorted(set(src) | set(dst))
        self.at = {n: i for i, n in enumerate(self.names)}
        s, d = np.array([self.at[x] for x in src], int), np.array([self.at[x] for x in dst], int)
        order = np.lexsort((d, s))
        s, self.to, p = s[order], d[order], np.asarray(p, float)[order]
        self.ptr = np.searchsorted(s, np.arange(len(self.names) + 1))
        self.cum = np.cumsum(p)
        self.base = np.append(0.0, self.cum)[self.ptr[:-1]]
        self.total = np.append(0.0, self.cum)[self.ptr[1:]] - self.base

    def step(self, at: np.ndarray, x: np.ndarray) -> np.ndarray:
        """The neighbour of each place that a uniform number picks; -1 where there is none."""
        k = np.searchsorted(self.cum, self.base[at] + x * self.total[at], "right")
        k = np.clip(k, self.ptr[at], np.maximum(self.ptr[at + 1] - 1, self.ptr[at]))
        has = self.ptr[at + 1] > self.ptr[at]
        return np.where(has, self.to[np.minimum(k, len(self.to) - 1)] if len(self.to) else -1, -1)


def uniform(seed: int, walk: np.ndarray, step: int, stream: int) -> np.ndarray:
    """Numbers in [0, 1) of counters (splitmix64)."""
    u = np.uint64
    with np.errstate(over="ignore"):
        x = walk.astype(u) * u(0x9E3779B97F4A7C15) + u(step) * u(0xD1342543DE82EF95) + u(stream) * u(0xA0761D6478BD642F) + u(seed & 0xFFFFFFFF) * u(0xE7037ED1A0B428DB)
        for shift, mul in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> u(shift))) * u(mul)
        x = x ^ (x >> u(31))
    return (x >> u(11)).astype(float) / (1 << 53)


def _graph(edges: DataFrame, min_weight: float) -> Csr:
    e = edges.filter(F.col("w") > min_weight).select("src", "dst", "w")
    n = e.count()
    if n * 64 > MOST_BYTES:
        raise ValueError(f"{n} edges are more than a walker task may hold; raise min_weight")
    pdf = e.toPandas()
    return Csr(list(pdf.src), list(pdf.dst), pdf.w.to_numpy())


def simulate(edges: DataFrame | Csr, starts: list[str] | None, targets: list[str] | dict[int, list[str]], n_walks: int, restart: float, min_weight: float = 0.001, max_steps: int = MAX_STEPS, seed: int = 0, first: int = 0) -> DataFrame:
    """Walks that end at a target (code > 0), by a restart (code -1), at a dead end (0) or after max_steps (-2).

    At each step a walker first looks whether it stands on a target, then aborts with probability ``restart``, then moves.
    ``targets`` may give codes to lists of nodes; a lower code is looked at first. Without ``starts`` each walk begins
    at a random node. A start on a target succeeds in one step. Walks are numbered from ``first`` on.
    """
    spark: SparkSession = SparkSession.active()
    g = edges if isinstance(edges, Csr) else _graph(edges, min_weight)
    targets = targets if isinstance(targets, dict) else {1: targets}
    code_of = np.zeros(len(g.names), int)
    for code in sorted(targets, reverse=True):
        for t in targets[code]:
            if t in g.at:
                code_of[g.at[t]] = code
    begin = [g.at[s] for s in (starts if starts is not None else g.names) if s in g.at]
    if not begin:
        raise ValueError("no start node is in the graph")
    begin = np.array(begin)
    shared = spark.sparkContext.broadcast((g, code_of, begin))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, code_of, begin = shared.value
        for batch in batches:
            walk = batch.column(0).to_numpy()
            n = len(walk)
            if not n:
                continue
            at = begin[(uniform(seed, walk, 0, 7) * len(begin)).astype(int)]
            who, where = [np.arange(n)], [at.copy()]
            code = np.full(n, -2)
            live = np.arange(n)
            for step in range(1, max_steps + 1):
                hit = code_of[at[live]]
                code[live[hit > 0]] = hit[hit > 0]
                live = live[hit == 0]
                if restart > 0:
                    stop = uniform(seed, walk[live], step, 1) < restart
                    code[live[stop]] = -1
                    live = live[~stop]
                to = g.step(at[live], uniform(seed, walk[live], step, 2))
                code[live[to < 0]] = 0
                live, to = live[to >= 0], to[to >= 0]
                at[live] = to
                who.append(live.astype(np.int32))
                where.append(to.astype(np.int32))
                if not len(live):
                    break
            # places of all walkers by walker, then step
            by = np.concatenate(who)
            order = np.argsort(by, kind="stable")
            place, steps = np.concatenate(where)[order], np.bincount(by, minlength=n)
            end = np.cumsum(steps)
            pair = np.unique(by[order].astype(np.int64) * len(g.names) + place)
            names = pa.array(g.names, pa.string())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(walk), names.take(pa.array(place[end - steps])), pa.ListArray.from_arrays(pa.array(np.append(0, end), pa.int32()), names.take(pa.array(place))), pa.array(steps, pa.int32()),
                    pa.array(code > 0), pa.array(np.bincount(pair // len(g.names), minlength=n), pa.int32()), names.take(pa.array(at)), pa.array(code, pa.int32()),
                ],
                names=["simulation", "start_node", "path", "steps", "success", "unique_nodes", "end_node", "code"],
            )

    return spark.range(first, first + n_walks, 1, max(1, min(n_walks // 256, 4096))).mapInArrow(run, SCHEMA)


def reachable(g: Csr, start: str) -> np.ndarray:
    """Which nodes a walk from ``start`` can come to."""
    seen = np.zeros(len(g.names), bool)
    new = np.array([g.at[start]])
    while len(new):
        seen[new] = True
        n = g.ptr[new + 1] - g.ptr[new]
        to = np.unique(g.to[np.repeat(g.ptr[new] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))])
        new = to[~seen[to]]
    return seen


def walks_until(edges: DataFrame, start: str, target: str | Callable[[str], bool], n_success: int = 100, restart: float = 0.001, min_weight: float = 0.001, max_steps: int = MAX_STEPS, seed: int = 0, budget: int = 1000) -> DataFrame:
    """All attempts, by number, up to the one that is the ``n_success``-th success.

    ``target`` is a node, or says of each node's name whether it is one. A start or target that is no node, or a target that no walk can come to, raises ValueError. After ``budget`` attempts
    for each success wanted, those made are returned, with fewer successes.
    """
    g = _graph(edges, min_weight)
    goals = [n for n in g.names if (target(n) if callable(target) else n == target)]
    if start not in g.at or not reachable(g, start)[[g.at[n] for n in goals]].any():
        raise ValueError(f"no walk comes from {start!r} to {'a target' if callable(target) else repr(target)}")
    made, found, parts = 0, 0, []
    while found < n_success and made < budget * n_success:
        size = n_success - found if not made else int(1.2 * (n_success - found) * made / max(found, 1)) + 1
        size = min(size, 8 * max(made, n_success), budget * n_success - made)
        part = materialize(simulate(g, [start], goals, size, restart, min_weight, max_steps, seed, made), "walks")
        parts.append(part)
        made += size
        found += part.filter("success").count()
    every = parts[0]
    for part in parts[1:]:
        every = every.union(part)
    last = every.filter("success").orderBy("simulation").limit(n_success).agg(F.max("simulation")).first()[0]
    return every.filter(F.col("simulation") <= last) if found >= n_success else every


#: Weights that a slow walk steps over, at least; nodes of its report.
SLOW_WEIGHT, SLOW_TOP = 0.1, 15


def slow_walks(edges: DataFrame, start: str, target: str, n_success: int = 100, restart: float = 0.001, seed: int = 0, **more) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Walks over weights above SLOW_WEIGHT until ``n_success`` succeed: the walks, one row of statistics, and the SLOW_TOP most visited nodes.

    ``more`` goes to :func:`walks_until`.
    """
    w = materialize(walks_until(edges, start, target, n_success, restart, SLOW_WEIGHT, seed=seed, **more), "walks")
    return w, walk_statistics(w), visit_counts(w).orderBy(F.desc("visits"), "node").limit(SLOW_TOP)


def walks_to_target(edges: DataFrame, start: str, target: str, n_walks: int = 100, restart: float = 0.001, min_weight: float = 0.001, seed: int = 0) -> DataFrame:
    return simulate(edges, [start], [target], n_walks, restart, min_weight, seed=seed)


def walks_to_set(edges: DataFrame, start: str, part: str = "rna", n_success: int = 100, restart: float = 0.0, min_weight: float = 0.001, seed: int = 0, **more) -> DataFrame:
    """Walks until ``n_success`` have come to any node whose name holds ``part``, ignoring case; ``more`` goes to :func:`walks_until`."""
    return walks_until(edges, start, lambda name: part.lower() in name.lower(), n_success, restart, min_weight, seed=seed, **more)


def walks_to_endpoints(edges: DataFrame, a: str, b: str, n_walks: int, max_steps: int = 1000, min_weight: float = 1e-4, restart: float = 0.5, seed: int = 0, start_nodes: list[str] | None = None) -> DataFrame:
    """Walks from random starts to a (code 1, looked at first) or b (code 2); both must differ."""
    if a == b:
        raise ValueError("the endpoints are the same")
    if n_walks <= 0 or max_steps <= 0 or not 0 <= restart <= 1:
        raise ValueError("n_walks and max_steps must be positive, restart in [0, 1]")
    return simulate(edges, start_nodes, {1: [a], 2: [b]}, n_walks, restart, min_weight, max_steps, seed)


def visit_counts(walks: DataFrame) -> DataFrame:
    """(node, visits, is_shadow) over the paths of successful walks."""
    v = walks.filter("success").select(F.explode("path").alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("visits"))
    return v.withColumn("is_shadow", F.col("node").contains("_neg"))


def endpoint_tallies(walks: DataFrame) -> DataFrame:
    """(node, tally_a, tally_b, total, p_a, p_b): visits on the ways to either endpoint, and shares of all visits."""
    v = walks.filter("success").select("code", F.explode("path").alias("node"))
    t = v.groupBy("node").agg(F.count_if(F.col("code") == 1).alias("tally_a"), F.count_if(F.col("code") == 2).alias("tally_b"))
    t = t.withColumn("total", F.col("tally_a") + F.col("tally_b"))
    whole = t.agg(F.sum("total").alias("whole"))
    return t.crossJoin(F.broadcast(whole)).select("node", "tally_a", "tally_b", "total", (F.col("tally_a") / F.col("whole")).alias("p_a"), (F.col("tally_b") / F.col("whole")).alias("p_b"))


def walk_statistics(walks: DataFrame) -> DataFrame:
    """Number of walks and successes, and least, largest, mean, median and standard deviation of successful steps."""
    s = F.when(F.col("success"), F.col("steps"))
    return walks.agg(F.count(F.lit(1)).alias("n"), F.count_if("success").alias("n_success"), F.min(s).alias("min_steps"), F.max(s).alias("max_steps"), F.avg(s).alias("mean_steps"), F.percentile(s, F.lit(0.5)).alias("median_steps"), F.stddev_pop(s).alias("std_steps"))


def diffusion_visits(edges: DataFrame, start: str, n_walks: int = 100, max_steps: int = 100, restart: float = 0.1, unweighted: bool = False, seed: int = 0) -> DataFrame:
    """(node, frequency): shares of visits of walkers that are set back to ``start`` at a restart or a dead end."""
    e = edges.withColumn("w", F.lit(1.0)) if unweighted else edges
    g = _graph(e, 0.0)
    if start not in g.at:
        raise ValueError(f"no node {start!r}")
    shared = edges.sparkSession.sparkContext.broadcast(g)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g = shared.value
        for pdf in batches:
            walk = pdf.id.to_numpy()
            at = np.full(len(walk), g.at[start])
            seen = np.bincount(at, minlength=len(g.names))
            for step in range(1, max_steps):
                to = g.step(at, uniform(seed, walk, step, 2))
                to = np.where((uniform(seed, walk, step, 1) < restart) | (to < 0), g.at[start], to)
                at = to
                seen += np.bincount(at, minlength=len(g.names))
            i = np.flatnonzero(seen)
            yield pd.DataFrame({"node": [g.names[k] for k in i], "n": seen[i]})

    v = edges.sparkSession.range(0, n_walks, 1, max(1, min(n_walks // 256, 4096))).mapInPandas(run, "node string, n long").groupBy("node").agg(F.sum("n").alias("n"))
    whole = F.broadcast(v.agg(F.sum("n").alias("whole")))
    return v.crossJoin(whole).select("node", (F.col("n") / F.col("whole")).alias("frequency"))


def _rounds(x: DataFrame, step: Callable[[DataFrame], DataFrame], steps: int, every: int = 5) -> Iterator[DataFrame]:
    """x after each of ``steps`` rounds; each fifth is written and the one before it deleted once it is read."""
    kept = None
    for k in range(1, steps + 1):
        x = step(x)
        if k % every == 0 or k == steps:
            old, kept = kept, materialize(x, "rounds")
            x = kept
            if old is not None:
                drop(old)
        yield x


def absorption(edges: DataFrame, targets: list[str], restart: float, min_weight: float, steps: int, strategy: str = "auto") -> DataFrame:
    """(node, probability): exact chance that a walk from each node ends at a target within ``steps`` moves.

    Strategies as in ``diffusion``: a dense matrix in one task, or a vector table that goes against the edges, round by round.
    """
    from .diffusion import _dense, _pick, nodes_of

    p, joins = _pick(prepare(edges, min_weight).select("src", "dst", F.col("p").alias("w")), strategy)
    if not joins:

        def solve(names: list[str], a: np.ndarray) -> pd.DataFrame:
            goal = np.isin(names, targets)
            h = goal.astype(float)
            for _ in range(steps):
                h = np.where(goal, 1.0, (1 - restart) * (a @ h))
            return pd.DataFrame({"node": names, "probability": h})

        return _dense(p, solve, "node string, probability double")
    nodes = materialize(nodes_of(p), "nodes")
    goal = nodes.filter(F.col("node").isin(targets)).select("node", F.lit(1.0).alias("h"))
    inner = materialize(p.filter(~F.col("src").isin(targets)), "edges")

    def back(h: DataFrame) -> DataFrame:
        to = h.withColumnRenamed("node", "dst").join(inner, "dst").groupBy(F.col("src").alias("node")).agg(((1 - restart) * F.sum(F.col("w") * F.col("h"))).alias("h"))
        return to.union(goal)

    h = goal
    for h in _rounds(goal, back, steps):
        pass
    return nodes.join(h, "node", "left").select("node", F.coalesce("h", F.lit(0.0)).alias("probability"))


def expected_visits(edges: DataFrame, start: str, restart: float, steps: int, strategy: str = "auto") -> DataFrame:
    """(node, frequency): exact share of the visits of :func:`diffusion_visits` walkers, over places 0 to steps - 1.

    Strategies as in :func:`absorption`. A dead end is an edge back to ``start``, so its mass is carried on, and all mass is 1 in every round.
    """
    from .diffusion import _dense, _has, _pick

    p, joins = _pick(prepare(edges, 0.0).select("src", "dst", F.col("p").alias("w")), strategy)
    if not _has(p, start):
        raise ValueError(f"no node {start!r}")
    if not joins:

        def solve(names: list[str], a: np.ndarray) -> pd.DataFrame:
            e = np.zeros(len(names))
            e[names.index(start)] = 1
            x, total = e.copy(), e.copy()
            dead = a.sum(1) <= 0
            for _ in range(steps - 1):
                x = (1 - restart) * (x @ a + x[dead].sum() * e) + restart * x.sum() * e
                total += x
            return pd.DataFrame({"node": names, "frequency": total / steps})

        return _dense(p, solve, "node string, frequency double").filter("frequency > 0")
    dead = p.select(F.col("dst").alias("src")).distinct().join(p.select("src").distinct(), "src", "left_anti")
    whole = materialize(p.union(dead.select("src", F.lit(start), F.lit(1.0))), "edges")

    def forth(x: DataFrame) -> DataFrame:
        moved = x.filter("x > 0").join(whole, F.col("node") == F.col("src")).groupBy(F.col("dst").alias("node")).agg(((1 - restart) * F.sum(F.col("w") * F.col("x"))).alias("x"))
        more = moved.union(x.agg(F.lit(start).alias("node"), (restart * F.sum("x")).alias("x"))).groupBy("node").agg(F.sum("x").alias("x"))
        both = x.select("node", F.lit(0.0).alias("x"), F.col("total")).union(more.select("node", "x", F.col("x").alias("total")))
        return both.groupBy("node").agg(F.sum("x").alias("x"), F.sum("total").alias("total"))

    x = edges.sparkSession.createDataFrame([(start, 1.0, 1.0)], "node string, x double, total double")
    for x in _rounds(x, forth, steps - 1, 3):
        pass
    return x.filter("total > 0").select("node", (F.col("total") / steps).alias("frequency"))


def shortest_walks(walks: DataFrame, n: int) -> DataFrame:
    """The n shortest successful walks; ties by number."""
    return walks.filter("success").orderBy("steps", "simulation").limit(n)


def example_walks(walks: DataFrame) -> DataFrame:
    """(kind, simulation, steps, path): the shortest, median and longest successful walk; ties by number."""
    w = walks.filter("success").select("simulation", "steps", "path")
    ranked = w.select("simulation", "steps", F.row_number().over(W.orderBy("steps", "simulation")).alias("k"), F.count(F.lit(1)).over(W.partitionBy(F.lit(0))).alias("n"))
    kind = F.explode(F.array(F.when(F.col("k") == 1, "shortest"), F.when(F.col("k") == F.floor((F.col("n") + 1) / 2), "median"), F.when(F.col("k") == F.col("n"), "longest")))
    pick = ranked.select("simulation", kind.alias("kind")).filter("kind is not null")
    return w.join(F.broadcast(pick), "simulation").select("kind", "simulation", "steps", "path")


def sample_walks(walks: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n successful walks in a fixed random order."""
    return walks.filter("success").orderBy(F.xxhash64("simulation", F.lit(seed)), "simulation").limit(n)


def thin_walks(walks: DataFrame, counts: DataFrame, seed: int = 0) -> DataFrame:
    """Each walk is kept with probability 1 / count of its end node (``counts``: end_node, n; at least 1)."""
    w = walks.join(counts, "end_node", "left").withColumn("n", F.greatest(F.coalesce("n", F.lit(1)), F.lit(1)))
    draw = F.pmod(F.xxhash64("simulation", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    return w.filter(draw < 1.0 / F.col("n")).drop("n")
