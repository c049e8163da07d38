"""Shared plumbing of the ``llm`` subpackage: materialised stages, row-group streaming, components.

Nothing here collects rows of a corpus: the driver only sees scalars and bounded model parameters.
"""

from __future__ import annotations

import ctypes
import re
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``, or where it is unset one of our own in local mode."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/layerwalk-stages"
    return root.rstrip("/")


def materialize(df: DataFrame, what: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet to the shared folder and read it back.

    A lost executor then costs only its own tasks, never the stages before. Shuffle files of plans written before are of
    no more use; Spark deletes those of a plan that the driver has collected, which by itself may take half an hour.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/layerwalk-{what}-{uuid.uuid4().hex}"
    spark.sparkContext._jvm.System.gc()
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stage(df: DataFrame) -> None:
    """Delete the files of a stage made by :func:`materialize` that nothing reads any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/layerwalk-" in folder:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def unused(name: str, df: DataFrame) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def bounded_sample(sizes: DataFrame, rows: int, size: int) -> DataFrame:
    """(doc_id) of at most ``rows`` of (doc_id, size) in the order of a hash of doc_id, as long as all that are taken have at most ``size`` together.

    One that would go beyond is passed over, never cut.
    """
    first = sizes.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).collect()
    taken, held = [], 0
    for r in first:
        if held + (r['size'] or 0) <= size:
            taken.append((r.doc_id,))
            held += r['size'] or 0
    return sizes.sparkSession.createDataFrame(taken, "doc_id long")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, which gives what its task has freed back to the system at the end: workers live on, and would keep it beside what the next stages hold."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
            if trim:
                trim(0)

    return whole


def grouped(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of whole groups out of batches sorted by ``keys``; several small groups come in one table.

    Groups must be bounded by the caller (it splits hot keys into blocks), so memory is too.
    """
    rest: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = pa.Table.from_batches([batch])
        now = now if rest is None else pa.concat_tables([rest, now])
        last = [now.column(k)[-1].as_py() for k in keys]
        same = np.ones(now.num_rows, bool)
        for k, v in zip(keys, last, strict=True):
            same &= np.asarray(now.column(k)) == v
        cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        if cut:
            yield now.slice(0, cut).combine_chunks()
        rest = now.slice(cut)
    if rest is not None and rest.num_rows:
        yield rest.combine_chunks()


def group_bounds(*columns: np.ndarray) -> np.ndarray:
    """Offsets at which the sorted key columns change, with 0 and the length."""
    n = len(columns[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.append(np.flatnonzero(new), n)


def local_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest reachable index of each of ``n`` nodes over the undirected edges (a, b), by min-label and jumping."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def connected_components(edges: DataFrame, what: str) -> DataFrame:
    """(node, component) of all nodes in ``edges`` (a long, b long): the smallest node reachable.

    Alternating large-star and small-star rounds (Kiveris et al., SoCC 2014): each keeps the edge count
    bounded by the last, a hub's minimum is a partially aggregated ``min`` and its edges sit on the side of an
    inner join that adaptive execution may split. Each round is a written table; the loop ends when a round
    changes nothing. Self-loops, repeats and null ends in ``edges`` are ignored; no edges give no rows.
    """
    lo, hi = F.least("a", "b"), F.greatest("a", "b")
    now = edges.filter("a <> b").select(hi.alias("u"), lo.alias("v")).distinct()
    now = materialize(now, f"{what}-edges")

    def mark(e: DataFrame) -> tuple:
        r = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        return tuple(r)

    seen = mark(now)
    while seen[0]:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        big = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = big.groupBy("u").agg(F.min("v").alias("m"))
        star = big.join(low, "u")
        star = star.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        new = materialize(star.filter("u <> v").distinct(), f"{what}-edges")
        drop_stage(now)
        now, before, seen = new, seen, mark(new)
        if seen == before:
            break
    return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).union(now.select("v", "v").distinct())
