"""Operator 6: benchmark decontamination by SimHash windows and multi-index Hamming blocks.

For every benchmark item, windows of as many words as the item has slide over each whole document, word by word (a shorter
document is one window). A window's 128-bit SimHash over its five-word shingles is looked up in the tables of the items of
that size: the bits are cut into eight blocks, and each has a table from its value to the items with it. By
the pigeonhole principle a fingerprint within ``RADIUS`` bits agrees with the query in at least one block up to RADIUS // 8
bits, so the items under the values near the query's, block by block, hold all of them. They are compared in all bits, and
those within the radius verified by the exact weighted Jaccard similarity of both shingle multisets (weight:
occurrences).

Similarity 0.75 of windows of R and S shingles needs 3 (R + S) / 7 common ones. Windows with fewer shingles of items
of their size are below it whatever their fingerprint and are skipped before fingerprinting. The index of a bounded
part of the benchmark is broadcast; a larger benchmark takes more parts one after the other, each over all documents.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textbuf as tb
from .common import group_bounds, materialize, released, table

SIZE, LEAST = 5, 0.75
BITS, BLOCKS = 128, 8
#: Expected distance of two windows at the threshold, and 4.7 standard deviations more.
_ANGLE = float(np.arccos(2 * LEAST / (1 + LEAST)) / np.pi)
RADIUS = int(BITS * _ANGLE + 4.7 * (BITS * _ANGLE * (1 - _ANGLE)) ** 0.5)
#: Characters of benchmark text in one broadcast part.
PART_CHARS = 4_000_000


def fingerprints(h: np.ndarray) -> np.ndarray:
    """SimHash of each row of shingle hashes, as eight blocks of 16 bits; an even vote gives 0."""
    both = np.stack([tb.mix(h), tb.mix(h ^ np.uint64(0x6A09E667F3BCC909))], -1)
    votes = np.unpackbits(both.view(np.uint8), axis=-1).sum(1, dtype=np.int32)
    return np.packbits(2 * votes > h.shape[1], axis=-1).view(np.uint16)


_MASKS = np.arange(1 << 16, dtype=np.uint16)
#: What two values of a block that are near differ in.
_MASKS = _MASKS[np.bitwise_count(_MASKS) <= RADIUS // BLOCKS]


class Blocks:
    """Tables of the fingerprints of items: for each block the values that occur, and the items under each."""

    def __init__(self, marks: np.ndarray):
        self.marks = marks
        self.tables = []
        for block in marks.T:
            order = np.argsort(block, kind="stable").astype(np.int32)
            values, first = np.unique(block[order], return_index=True)
            self.tables.append((values, np.append(first, len(order)), order))

    def near(self, mark: np.ndarray) -> np.ndarray:
        """Items within RADIUS of a fingerprint, out of those that some block leads to."""
        found = np.zeros(len(self.marks), bool)
        for value, (values, first, order) in zip(mark, self.tables, strict=True):
            if len(values) <= len(_MASKS):  # fewer values occur than are near
                hit = np.flatnonzero(np.bitwise_count(values ^ value) <= RADIUS // BLOCKS)
            else:
                near = _MASKS ^ value
                hit = np.minimum(np.searchsorted(values, near), len(values) - 1)
                hit = hit[values[hit] == near]
            n = first[hit + 1] - first[hit]
            if len(hit):
                found[order[np.repeat(first[hit] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]] = True
        items = np.flatnonzero(found)
        return items[np.bitwise_count(self.marks[items] ^ mark).sum(1, dtype=np.int32) <= RADIUS]


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard of two multisets of hashes."""
    x, n = np.unique(a, return_counts=True)
    y, m = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    shared = int(np.minimum(n[i], m[j]).sum())
    return shared / (len(a) + len(b) - shared)


class Index:
    """Items of one benchmark part: the sizes of items that hold each shingle, and tables of fingerprints by size."""

    def __init__(self, ids: list[int], texts: list[str]):
        h, of = tb.shingles(*tb.buffers(pa.array(texts, pa.string())), SIZE)
        cut = np.searchsorted(of, np.arange(len(ids) + 1))
        size = np.diff(cut)
        self.classes: dict[int, tuple] = {}
        for s in np.unique(size[size > 0]).tolist():
            rows = np.flatnonzero(size == s)
            own = h[cut[rows][:, None] + np.arange(s)]
            self.classes[s] = ([ids[r] for r in rows], own, Blocks(fingerprints(own)))
        both = np.unique(np.stack([h, size[of].astype(np.uint64)], 1), axis=0) if len(h) else np.zeros((0, 2), np.uint64)
        self.keys, self.first = np.unique(both[:, 0], return_index=True)
        self.first, self.sizes = np.append(self.first, len(both)), both[:, 1].astype(np.int64)

    def search(self, h: np.ndarray, text: np.ndarray) -> Iterator[tuple[int, int, float, int]]:
        """(text, item, best similarity, first word of the window) over shingles sorted by text."""
        if not len(self.keys) or not len(h):
            return
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        hits = np.flatnonzero(self.keys[at] == h)
        # places of shingles of items, by size of the items
        n = self.first[at[hits] + 1] - self.first[at[hits]]
        place = np.repeat(hits, n)
        size = self.sizes[np.repeat(self.first[at[hits]] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
        order = np.argsort(size, kind="stable")
        place, size = place[order], size[order]
        begin, end = np.searchsorted(text, text), np.searchsorted(text, text, "right")  # of each shingle's text
        cut = group_bounds(size)
        for lo, hi in zip(cut[:-1], cut[1:], strict=True):
            s, p = int(size[lo]), place[lo:hi]
            short = end[p] - begin[p] < s  # texts that are one window
            for rows, window in ((p[~short], s), (p[short], 0)):
                yield from self._windows(h, text, rows, s, window, begin, end)

    def _windows(self, h: np.ndarray, text: np.ndarray, p: np.ndarray, s: int, window: int, begin: np.ndarray, end: np.ndarray) -> Iterator[tuple[int, int, float, int]]:
        """Windows of ``window`` shingles (0: whole texts) with enough shingles ``p`` of items of ``s`` against these items."""
        if not len(p):
            return
        ids, own, blocks = self.classes[s]
        if window:
            need = -(-2 * 3 * s // 7)
            if len(p) < need:
                return
            a, b = p[: len(p) - need + 1], p[need - 1 :]  # the first and last of `need` in a row
            ok = (b - a < s) & (text[a] == text[b])
            a, b = a[ok], b[ok]
            low, high = np.maximum(b - s + 1, begin[a]), np.minimum(a, end[a] - s)
            n = np.maximum(high - low + 1, 0)
            start = np.unique(np.repeat(low - (np.cumsum(n) - n), n) + np.arange(int(n.sum())))
            length = np.full(len(start), s)
        else:
            start, n = np.unique(begin[p], return_counts=True)
            length = end[start] - start
            ok = 7 * n >= 3 * (length + s)
            start, length = start[ok], length[ok]
        best: dict[tuple[int, int], tuple[float, int]] = {}
        seen: dict[bytes, np.ndarray] = {}  # passages repeat: each fingerprint is looked up once
        for lo in range(0, len(start), 4096):
            part, long = start[lo : lo + 4096], length[lo : lo + 4096]
            rows = [h[i : i + k] for i, k in zip(part.tolist(), long.tolist(), strict=True)]
            marks = fingerprints(np.stack(rows)) if window else np.concatenate([fingerprints(r[None]) for r in rows])
            for w, (r, mark) in enumerate(zip(rows, marks, strict=True)):
                key = mark.tobytes()
                if key not in seen:
                    seen[key] = blocks.near(mark)
                for i in seen[key]:
                    sim = similarity(r, own[i])
                    if sim >= LEAST:
                        pair, word = (int(text[part[w]]), ids[i]), int(part[w] - begin[part[w]])
                        if sim > best.get(pair, (0.0, 0))[0]:
                            best[pair] = (sim, word)
        yield from ((t, i, sim, word) for (t, i), (sim, word) in best.items())


def _parts(benchmark: DataFrame) -> Iterator[tuple[Index, bool]]:
    """The index of each part, and whether it is the last."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text")).filter("item_id is not null and text is not null")
    n = max(1, -(-(items.agg(F.sum(F.length("text"))).first()[0] or 0) // PART_CHARS))
    for k in range(n):
        got = sorted({(r.item_id, r.text) for r in items.filter(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k).collect()})
        yield Index([i for i, _ in got], [t for _, t in got]), k == n - 1


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, similarity, start_word): each benchmark item found in a document, with its best window.

    Texts are lower-cased (A-Z) and cut into words at 0x20 and 0x09-0x0D. Of equal windows the first counts. A document with
    fewer shingles than an item is one window. An item of
    under five words is one shingle, its whole sequence, which only a text of these words alone has. Null or empty
    texts and items match nothing; rows without an id are left out. Of items or documents repeated under one id the best
    window counts, of equals the first. Other columns are ignored; no rows give no rows.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null and text is not null")
    every = None
    for index, last in _parts(benchmark):
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                out = defaultdict(list)
                ids = batch.column(0)
                for lo, _, data, off in tb.runs(batch.column(1)):
                    for t, item, sim, word in index.search(*tb.shingles(data, off, SIZE)):
                        out["doc_id"].append(ids[lo + t].as_py())
                        out["item_id"].append(item)
                        out["similarity"].append(sim)
                        out["start_word"].append(word)
                yield pa.RecordBatch.from_arrays([pa.array(out[c], k) for c, k in (("doc_id", pa.int64()), ("item_id", pa.int64()), ("similarity", pa.float64()), ("start_word", pa.int64()))], names=["doc_id", "item_id", "similarity", "start_word"])

        found = docs.mapInArrow(released(run), "doc_id long, item_id long, similarity double, start_word long")
        if not last:  # only one part's index is held at a time
            found = materialize(found, "leaks")
            shared.destroy()
        every = found if every is None else every.union(found)
    best = F.max(F.struct("similarity", (-F.col("start_word")).alias("w")))
    return every.groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", F.col("b.similarity").alias("similarity"), (-F.col("b.w")).alias("start_word"))


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item; rows without doc_id stay. Columns as they are."""
    return docs.join(find_leaks(docs, benchmark).select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op6_decontaminate": op6_decontaminate}
_WORDS = r"list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
#: Brute force: every window of an item's size in every document that shares a shingle with it.
ORACLE_SQL = {
    "op6_decontaminate": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
ds AS (
  SELECT doc_id, i, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 4], ' ') END AS s
  FROM d, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS r(i) WHERE len(w) > 0
), bs AS (
  SELECT item_id, s, count(*) AS n, sum(count(*)) OVER (PARTITION BY item_id) AS size FROM (
    SELECT item_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 4], ' ') END AS s
    FROM b, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS r(i) WHERE len(w) > 0) GROUP BY item_id, s
), pair AS (SELECT DISTINCT doc_id, item_id, size FROM ds JOIN bs USING (s)),
n AS (SELECT doc_id, count(*) AS n FROM ds GROUP BY doc_id),
win AS (SELECT doc_id, item_id, size, least(n, size) AS wide, k FROM pair JOIN n USING (doc_id), unnest(range(1, greatest(n - size::BIGINT, 0) + 2)) AS r(k)),
c AS (
  SELECT win.doc_id, win.item_id, k, size, wide, ds.s, count(*) AS m FROM win JOIN ds ON ds.doc_id = win.doc_id AND ds.i >= k AND ds.i < k + size
  SEMI JOIN bs ON bs.item_id = win.item_id AND bs.s = ds.s GROUP BY ALL
), sim AS (
  SELECT doc_id, item_id, k, c.size + wide AS total, sum(least(m, n))::BIGINT AS shared FROM c JOIN bs USING (item_id, s) GROUP BY ALL
)
SELECT doc_id, item_id, max(shared / (total - shared)::DOUBLE) AS similarity, (arg_max(k, shared * 1000000 - k) - 1)::BIGINT AS start_word
FROM sim WHERE shared >= 0.75 * (total - shared) GROUP BY doc_id, item_id
"""
}
