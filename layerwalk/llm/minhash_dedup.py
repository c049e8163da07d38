"""Operator 7: MinHash near-dedup by a signature-coordinate inverted join.

1. One pass over the texts gives each document the size and a 104-bit fingerprint of its shingle set, ``PREFIX``
   64-bit MinHash coordinates to post under and ``WIDTH`` further coordinates of eight bits to count collisions on.
   Documents of one set collapse to the smallest id (rows linked with certainty); texts are not kept.
2. Every representative is posted under its prefix coordinates. Lists of one are dropped by a partially aggregated
   count. Longer lists are dealt out in blocks of bounded size, each posting once.
3. In a block, collisions are counted over the skipped coordinates of the signature. Pairs with at least ``MATCHES``
   collisions are candidates; a block emits a maximum spanning forest of them, never all pairs.
4. Forest pairs are confirmed on the full shingle sets of both whole texts; components come from confirmed links.
5. Blocks of a long list then meet in pairs, but only rows of different components need to: blocks are made by component,
   and two blocks of one component never meet. So a large group of near copies, which its blocks and the list's first postings
   have joined, meets only what is left. Candidates between components are confirmed as before.
6. Where a forest pair failed, other candidates of its candidate component may still join the parts. The members of
   such a component meet again, with their texts and dealt in the same way: every candidate pair between different parts is
   confirmed on full sets inside the task, and one link for each two parts comes out. So no link that could join two
   components is left out, and no list of pairs grows with the square of a group.

A pair at the threshold is missed with a probability of about 1e-6 (no prefix coordinate in common: 0.25**10) plus
1e-6 (fewer than MATCHES collisions: 4.8 standard deviations).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import textbuf as tb
from .common import connected_components, drop_stage, group_bounds, grouped, materialize, partitions, released, table

SIZE, PER_CENT = 5, 75
PREFIX, WIDTH = 10, 192
#: Rows in a block of a list, and of a candidate component that is searched again.
BLOCK, MEET = 1024, 256
#: Mean collisions at the threshold (0.75 and chance agreement of a byte) less 4.8 standard deviations.
MATCHES = int(WIDTH * (0.75 + 0.25 / 256) - 4.8 * (WIDTH * 0.1875) ** 0.5)

_POST = tb.numbers(3, PREFIX) | np.uint64(1)
_SKIP = (tb.numbers(4, WIDTH) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_SET = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("post", pa.list_(pa.int64())), ("sig", pa.binary())])


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        for lo, hi, data, off in tb.runs(texts):
            h, t = tb.shingles(data, off, SIZE)
            n = np.zeros(hi - lo, np.int64)
            s1, s2 = np.zeros(hi - lo, np.int64), np.zeros(hi - lo, np.int64)
            post, sig = np.zeros((hi - lo, PREFIX), np.int64), np.zeros((hi - lo, WIDTH), np.uint8)
            if len(h):
                d, dt = tb.distinct(h, t)
                n = np.bincount(dt, minlength=hi - lo)
                has = np.flatnonzero(n)
                at = group_bounds(dt)[:-1]
                s1[has] = np.add.reduceat(tb.mix(d + np.uint64(11)), at).view(np.int64)
                s2[has] = np.add.reduceat(tb.mix(d ^ np.uint64(0x5DEECE66D5DEECE)), at).view(np.int64)
                for k in range(PREFIX):
                    post[has, k] = tb.mix(np.minimum.reduceat(tb.mix(d * _POST[k]), at) + np.uint64(k)).view(np.int64)
                low = (tb.mix(d) >> np.uint64(32)).astype(np.uint32)
                for k in range(WIDTH):
                    m = np.minimum.reduceat(low * _SKIP[k], at)
                    sig[has, k] = (m * np.uint32(0x9E3779B1) ^ (m >> np.uint32(7))) >> np.uint32(24)
            yield pa.RecordBatch.from_arrays(
                [
                    ids.slice(lo, hi - lo).cast(pa.int64()), pa.array(n), pa.array(s1), pa.array(s2),
                    pa.ListArray.from_arrays(pa.array(np.arange(0, (hi - lo + 1) * PREFIX, PREFIX, dtype=np.int32)), pa.array(post.ravel())),
                    pa.array([x.tobytes() for x in sig], pa.binary()),
                ],
                schema=_SET,
            )


def _counts(sig: np.ndarray) -> np.ndarray:
    """Collisions of every pair of rows, by coordinate (one byte each, at most 255 coordinates)."""
    n = len(sig)
    got = np.zeros((n, n), np.uint8)
    for c in np.ascontiguousarray(sig.T):
        got += c[:, None] == c[None, :]
    return got


def _forest(got: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """A maximum spanning forest (Prim) over pairs of at least ``least`` collisions."""
    n = len(got)
    left = np.ones(n, bool)
    best, parent = np.zeros(n, np.int16), np.zeros(n, np.int64)
    out = []
    for _ in range(n):
        i = int(np.argmax(np.where(left, best, -1)))
        if best[i] >= least:
            out.append((parent[i], i))
        left[i] = False
        row = got[i]
        up = row > best
        best[up], parent[up] = row[up], i
    return (np.array(x, np.int64) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 2


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The candidate forest (a, b) of each block pair."""
    for got in grouped(batches, ["key", "bi", "bj"]):
        rep = np.asarray(got["rep"])
        sig = np.frombuffer(b"".join(got["sig"].to_pylist()), np.uint8).reshape(len(rep), WIDTH)
        at = group_bounds(*(np.asarray(got[c]) for c in ("key", "bi", "bj")))
        size = np.diff(at)
        a, b = [], []
        two = at[:-1][size == 2]
        for lo in range(0, len(two), 1 << 14):  # most lists
            x = two[lo : lo + (1 << 14)]
            x = x[(sig[x] == sig[x + 1]).sum(1) >= MATCHES]
            a.append(x)
            b.append(x + 1)
        for g in np.flatnonzero(size > 2):
            m = _counts(sig[at[g] : at[g + 1]])
            np.fill_diagonal(m, 0)
            i, j = _forest(m, MATCHES)
            a.append(i + at[g])
            b.append(j + at[g])
        if a:
            a, b = rep[np.concatenate(a)], rep[np.concatenate(b)]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])


def _cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidates (a, b) between components: a spanning forest over the components of each block pair."""
    for got in grouped(batches, ["part", "bi", "bj"]):
        rep, comp = np.asarray(got["rep"]), np.asarray(got["comp"])
        at = group_bounds(*(np.asarray(got[c]) for c in ("part", "bi", "bj")))
        a, b = [], []
        for lo, hi in zip(at[:-1], at[1:], strict=True):
            own = comp[lo:hi]
            if (own == own[0]).all():
                continue
            sig = np.frombuffer(b"".join(got["sig"][lo:hi].to_pylist()), np.uint8).reshape(hi - lo, WIDTH)
            m = _counts(sig)
            same = own[:, None] == own[None]
            if not ((m >= MATCHES) & ~same).any():
                continue
            m[same] = 255  # what is joined comes first
            np.fill_diagonal(m, 0)
            i, j = _forest(m, MATCHES)
            new = own[i] != own[j]
            a.append(i[new] + lo)
            b.append(j[new] + lo)
        if a:
            a, b = rep[np.concatenate(a)], rep[np.concatenate(b)]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])


def between(members: DataFrame, size: int) -> DataFrame:
    """(part, bi, bj, rep, comp): rows of a part dealt to pairs of blocks, so that any two of different ``comp`` meet.

    A component of at least ``size`` rows has blocks of its own, which never meet each other; smaller ones share blocks. Parts
    of one component are left out.
    """
    sizes = materialize(members.groupBy("part", "comp").agg(F.count(F.lit(1)).alias("n")), "sizes")
    big = sizes.filter(F.col("n") >= size).select("part", "comp", F.ceil(F.col("n") / size).cast("int").alias("own"))
    off = F.coalesce(F.sum("own").over(W.partitionBy("part").orderBy("comp").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).cast("int")
    big = big.withColumn("off", off)  # at most one row for each ``size`` members
    part = sizes.groupBy("part").agg(F.count(F.lit(1)).alias("comps"), F.coalesce(F.sum(F.when(F.col("n") >= size, F.ceil(F.col("n") / size))), F.lit(0)).cast("int").alias("first"), F.ceil(F.coalesce(F.sum(F.when(F.col("n") < size, F.col("n"))), F.lit(0)) / size).cast("int").alias("pool"))
    part = part.filter("comps > 1").drop("comps")
    m = members.join(part, "part").join(big, ["part", "comp"], "left")
    pure = F.col("own").isNotNull()
    m = m.withColumn("pure", pure).withColumn("off", F.coalesce("off", "first")).withColumn("own", F.coalesce("own", "pool"))
    m = m.withColumn("mine", (F.col("off") + F.pmod(F.xxhash64("rep"), "own")).cast("int"))
    m = m.withColumn("other", F.explode(F.expr("filter(sequence(0, first + pool - 1), j -> not pure or j < off or j >= off + own)")))
    return m.select("part", F.least("mine", "other").alias("bi"), F.greatest("mine", "other").alias("bj"), "rep", "comp")


def _join_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A confirmed link (a, b) for each two parts of a candidate component that have one in this block pair."""
    for got in grouped(batches, ["part", "bi", "bj"]):
        rep, comp = np.asarray(got["rep"]), np.asarray(got["comp"])
        at = group_bounds(*(np.asarray(got[c]) for c in ("part", "bi", "bj")))
        a, b = [], []
        for lo, hi in zip(at[:-1], at[1:], strict=True):
            own = comp[lo:hi]
            if (own == own[0]).all():
                continue
            sig = np.frombuffer(b"".join(got["sig"][lo:hi].to_pylist()), np.uint8).reshape(hi - lo, WIDTH)
            near = np.triu(_counts(sig) >= MATCHES) & (own[:, None] != own[None])
            sets: list[np.ndarray] = []
            for _, _, data, off in tb.runs(got["text"].slice(lo, hi - lo)):
                h, t = tb.distinct(*tb.shingles(data, off, SIZE))
                sets += np.split(h, np.searchsorted(t, np.arange(1, len(off) - 1)))
            size = np.array([len(x) for x in sets])
            for i in np.flatnonzero(near.any(1)):
                js = np.flatnonzero(near[i])
                js = js[(100 * np.minimum(size[js], size[i]) >= PER_CENT * np.maximum(size[js], size[i]))]
                if not len(js):
                    continue
                many = np.concatenate([sets[j] for j in js])
                spot = np.minimum(np.searchsorted(sets[i], many), size[i] - 1)
                ends = np.cumsum(size[js])
                both = np.add.reduceat((sets[i][spot] == many).astype(np.int64), ends - size[js])
                js = js[100 * both >= PER_CENT * (size[i] + size[js] - both)]
                a.append(np.full(len(js), i + lo))
                b.append(js + lo)
        if a:
            a, b = np.concatenate(a), np.concatenate(b)
            pair = np.stack([np.minimum(comp[a], comp[b]), np.maximum(comp[a], comp[b])], 1)
            one = np.unique(pair, axis=0, return_index=True)[1]
            yield pa.RecordBatch.from_arrays([pa.array(rep[a[one]]), pa.array(rep[b[one]])], names=["a", "b"])


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        na, nb, both = tb.jaccard_parts(batch.column(2), batch.column(3), SIZE)
        ok = (100 * both >= PER_CENT * (na + nb - both)) & (na > 0)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ok)], names=["a", "b", "linked"])


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row with an id.

    Texts are lower-cased (A-Z) and cut into words at 0x20 and 0x09-0x0D; a set holds the distinct runs of five words,
    or the whole sequence of a shorter text. Rows link when 100 * intersection >= 75 * union. Null, empty and blank
    texts have no shingles and link with nothing. Rows repeated under one id count once (their smallest
    fingerprint decides ties); rows without an id are left out; other columns are ignored. No rows give no rows.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).filter("doc_id is not null")
    sets = materialize(docs.mapInArrow(released(_signatures), "doc_id long, n_shingles long, s1 long, s2 long, post array<long>, sig binary"), "sets")
    one = sets.groupBy("n_shingles", "s1", "s2").agg(F.min("doc_id").alias("rep"), F.first("post").alias("post"), F.first("sig").alias("sig"))
    reps = materialize(one.filter("n_shingles > 0"), "reps")

    posts = reps.select("rep", F.explode("post").alias("key"))
    lists = posts.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    posts = posts.join(lists, "key").select("key", "rep", F.ceil(F.col("n") / BLOCK).cast("int").alias("nb"))
    posts = posts.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("nb")).cast("int"))
    posts = materialize(posts, "posts")
    dealt = posts.select("key", F.col("block").alias("bi"), F.col("block").alias("bj"), "rep").join(reps.select("rep", "sig"), "rep")
    dealt = dealt.select("key", "bi", "bj", "rep", "sig").repartition(partitions(spark), "key", "bi", "bj").sortWithinPartitions("key", "bi", "bj", "rep")
    forest = materialize(dealt.mapInArrow(released(_candidates), "a long, b long").distinct(), "forest")
    # the first posting of a list stands for it: blocks of one group are joined through it
    long = posts.filter("nb > 1")
    hot = not long.isEmpty()
    if hot:
        first = long.groupBy("key").agg(F.min("rep").alias("a"))
        star = long.select("key", "rep").join(first, "key").filter("a <> rep").select("a", F.col("rep").alias("b")).distinct()
        star = star.join(reps.select(F.col("rep").alias("a"), F.col("sig").alias("sa")), "a").join(reps.select(F.col("rep").alias("b"), F.col("sig").alias("sb")), "b")
        star = star.select("a", "b", "sa", "sb").mapInArrow(released(_alike), "a long, b long")
        forest = materialize(forest.union(star).distinct(), "forest")
    links = _confirmed(docs, forest)
    comps = connected_components(links.filter("linked").select("a", "b"), "minhash")
    if hot:
        members = long.select(F.col("key").alias("part"), "rep").join(comps.withColumnRenamed("node", "rep"), "rep", "left").select("part", "rep", F.coalesce("component", "rep").alias("comp"))
        met = between(materialize(members, "members"), BLOCK).join(reps.select("rep", "sig"), "rep")
        met = met.select("part", "bi", "bj", "rep", "comp", "sig").repartition(partitions(spark), "part", "bi", "bj").sortWithinPartitions("part", "bi", "bj", "rep")
        cross = materialize(met.mapInArrow(released(_cross), "a long, b long").distinct(), "forest")
        links = materialize(links.union(_confirmed(docs, cross)), "confirmed")
        comps = connected_components(links.filter("linked").select("a", "b"), "minhash")
    if not links.filter("not linked").isEmpty():
        more = _missing_links(spark, docs, reps, links, comps)
        comps = connected_components(links.filter("linked").select("a", "b").union(more), "minhash-joined")
    for stage in (posts, forest):
        drop_stage(stage)
    own = sets.groupBy("doc_id").agg(F.min(F.struct("n_shingles", "s1", "s2")).alias("s")).select("doc_id", "s.*")
    of = reps.select("n_shingles", "s1", "s2", "rep").join(comps.withColumnRenamed("node", "rep"), "rep", "left")
    of = of.select("n_shingles", "s1", "s2", F.coalesce("component", "rep").alias("component"))
    return own.join(of, ["n_shingles", "s1", "s2"], "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"), (F.coalesce("component", "doc_id") == F.col("doc_id")).alias("kept")
    )


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) with enough collisions of their signatures."""
    for batch in batches:
        sa, sb = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, WIDTH) for i in (2, 3))
        near = pa.array((sa == sb).sum(1) >= MATCHES)
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(near), batch.column(1).filter(near)], names=["a", "b"])


def _confirmed(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, linked) of candidate pairs, on the full sets of both whole texts."""
    pairs = pairs.join(docs.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a")
    pairs = pairs.join(docs.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b")
    links = pairs.select("a", "b", "ta", "tb").mapInArrow(released(_confirm), "a long, b long, linked boolean")
    return materialize(links.groupBy("a", "b").agg(F.max("linked").alias("linked")), "confirmed")


def _missing_links(spark: SparkSession, docs: DataFrame, reps: DataFrame, links: DataFrame, comps: DataFrame) -> DataFrame:
    """Confirmed links between the parts of candidate components in which a forest pair failed and the ends stayed apart."""
    wide = connected_components(links.select("a", "b"), "candidate").withColumnRenamed("component", "part")
    both = wide.join(comps, "node", "left").select(F.col("node").alias("rep"), "part", F.coalesce("component", "node").alias("comp"))
    met = between(materialize(both, "parts"), MEET).join(reps.select("rep", "sig"), "rep").join(docs.select(F.col("doc_id").alias("rep"), "text"), "rep")
    met = met.select("part", "bi", "bj", "rep", "comp", "sig", "text")
    met = met.repartition(partitions(spark), "part", "bi", "bj").sortWithinPartitions("part", "bi", "bj", "rep")
    return materialize(met.mapInArrow(released(_join_parts), "a long, b long"), "joined")


def op7_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op7_minhash_dedup": op7_minhash_dedup}
#: Exact: every pair that shares a shingle is compared, and components are followed to the end.
ORACLE_SQL = {
    "op7_minhash_dedup": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(ws) < 5 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i:i + 4], ' ') END AS sh
  FROM w, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS r(i) WHERE len(ws) > 0
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id
  JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 75 * (x.n + y.n - count(*))
), c AS (
  SELECT doc_id AS id, doc_id AS root FROM documents
  UNION SELECT p.b, c.root FROM c JOIN p ON p.a = c.id
)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.component_id, m.component_id = d.doc_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT id, min(root) AS component_id FROM c GROUP BY id) m ON m.id = d.doc_id
"""
}
