"""Walkers as messages over a partitioned adjacency, for graphs that no task can hold.

The running probabilities of a node with d edges are cut into d slots of equal width, and an edge is a row of each slot that it
overlaps (at most twice as many rows as edges). A walker's number u picks the slot, so a step is an equality join on (node, slot) and a range
check among the two rows that a slot holds on average; the edges of a hub are spread over its slots, and so are the walkers
on it. The adjacency is written in buckets of (node, slot), so a round moves walkers only.

Numbers are those of ``walks.simulate``, so both give the same walks. Each ROUNDS steps the walkers are written with the nodes
they came to; these tables together are the paths. No node or edge passes through the driver.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.stages import folder, materialize
from .walks import MAX_STEPS, prepare, uniform

#: Steps between two written tables of walkers.
ROUNDS = 4


def slots(edges: DataFrame, goal: Column, min_weight: float = 0.001) -> tuple[DataFrame, DataFrame]:
    """Adjacency (node, slot, lo, hi, to, degree, goal) and nodes (node, degree, goal): degree and goal are those of the node that a row leads to.

    goal: a number over the column ``node``, above 0 for a target.
    """
    e = materialize(prepare(edges, min_weight), "steps")
    d = e.groupBy("src").agg(F.count(F.lit(1)).cast("int").alias("degree"))
    names = e.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    nodes = names.join(d.withColumnRenamed("src", "node"), "node", "left").select("node", F.coalesce("degree", F.lit(0)).alias("degree"), F.coalesce(goal, F.lit(0)).cast("int").alias("goal"))
    nodes = materialize(nodes, "nodes")
    last = F.lead("dst").over(W.partitionBy("src").orderBy("dst")).isNull()
    e = e.withColumn("hi", F.when(last, 2.0).otherwise(F.col("cum"))).withColumn("lo", F.lag("cum", 1, 0.0).over(W.partitionBy("src").orderBy("dst")))
    e = e.join(d, "src")
    slot = lambda x: F.least(F.floor(F.col(x) * F.col("degree")), F.col("degree") - 1).cast("int")
    e = e.select(F.col("src").alias("node"), F.explode(F.sequence(slot("lo"), slot("hi"))).alias("slot"), "lo", "hi", F.col("dst").alias("to"))
    return e.join(nodes.withColumnRenamed("node", "to"), "to").select("node", "slot", "lo", "hi", "to", "degree", "goal"), nodes


def _bucketed(df: DataFrame) -> DataFrame:
    """``df`` as a table in buckets of (node, slot) in the shared folder."""
    spark = df.sparkSession
    name = f"adjacency_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(n, "node", "slot").sortBy("node", "slot").option("path", folder(spark, "adjacency")).saveAsTable(name)
    return spark.table(name)


def _draw(walkers: DataFrame, seed: int, step: int, restart: float) -> DataFrame:
    """Adds u, the number that picks the edge, and stop, whether the walk is given up before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            walk = b.column("simulation").to_numpy()
            stop = uniform(seed, walk, step, 1) < restart if restart > 0 else np.zeros(len(walk), bool)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(uniform(seed, walk, step, 2)), pa.array(stop)], names=[*b.schema.names, "u", "stop"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in walkers.schema.fields)
    return walkers.mapInArrow(run, schema + ", u double, stop boolean")


def simulate(edges: DataFrame, start: str, goal: Column, n_walks: int, restart: float, min_weight: float = 0.001, max_steps: int = MAX_STEPS, seed: int = 0, first: int = 0) -> DataFrame:
    """The rows of ``walks.simulate`` for walks from one start: a number ``goal`` over the column ``node``, above 0 for targets, is the code of success.

    A start that is no node raises ValueError. Takes a join for each step of the longest walk, so it is for graphs beyond a
    broadcast only.
    """
    table, nodes = slots(edges, goal, min_weight)
    begin = nodes.filter(F.col("node") == start).first()
    if begin is None:
        raise ValueError("no start node is in the graph")
    table = _bucketed(table)
    spark = edges.sparkSession
    live = spark.range(first, first + n_walks).select(
        F.col("id").alias("simulation"), F.lit(start).alias("at"), F.lit(begin.degree).alias("degree"), F.lit(begin.goal).alias("goal"), F.lit(None).cast("int").alias("code"),
        F.array(F.struct(F.lit(1).alias("step"), F.lit(start).alias("node"))).alias("new"),
    )
    written = []
    step = 0
    while step < max_steps:
        now = live
        for _ in range(min(ROUNDS, max_steps - step)):
            step += 1
            now = _draw(now, seed, step, restart)
            code = F.coalesce("code", F.when(F.col("goal") > 0, F.col("goal")).when(F.col("stop"), -1).when(F.col("degree") == 0, 0))
            slot = F.when(code.isNull(), F.floor(F.col("u") * F.col("degree")).cast("int"))
            now = now.select("simulation", "at", "degree", "goal", code.alias("code"), "new", "u", slot.alias("slot")).alias("w")
            met = now.join(table.alias("t"), (F.col("w.at") == F.col("t.node")) & (F.col("w.slot") == F.col("t.slot")) & (F.col("u") >= F.col("lo")) & (F.col("u") < F.col("hi")), "left")
            came = F.col("t.to").isNotNull()
            pick = lambda a, b: F.when(came, F.col(a)).otherwise(F.col(b))
            now = met.select(
                "simulation", pick("t.to", "w.at").alias("at"), pick("t.degree", "w.degree").alias("degree"), pick("t.goal", "w.goal").alias("goal"), "code",
                F.when(came, F.array_append("new", F.struct(F.lit(step + 1).alias("step"), F.col("t.to").alias("node")))).otherwise(F.col("new")).alias("new"),
            )
        written.append(materialize(now, "walkers"))
        live = written[-1].filter("code is null")
        if live.isEmpty():
            break
        live = live.withColumn("new", F.filter("new", lambda x: F.lit(False)))
    every = written[0]
    for part in written[1:]:
        every = every.union(part)
    walk = every.select("simulation", "code", F.explode_outer("new").alias("x")).groupBy("simulation").agg(F.max("code").alias("code"), F.sort_array(F.collect_list("x")).alias("x"))
    path = F.transform("x", lambda x: x["node"])
    code = F.coalesce("code", F.lit(-2))
    return walk.select(
        "simulation", F.element_at(path, 1).alias("start_node"), path.alias("path"), F.size("x").alias("steps"), (code > 0).alias("success"), F.size(F.array_distinct(path)).alias("unique_nodes"),
        F.element_at(path, -1).alias("end_node"), code.alias("code"),
    )
