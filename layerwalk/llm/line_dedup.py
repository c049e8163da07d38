"""Operator 3: line dedup over a sharded minimal perfect hash.

1. One pass cuts the texts into lines and makes the 128-bit hash of each distinct long key of a document. A partially
   aggregated count gives every distinct hash its number of documents and its largest document.
2. All distinct hashes are dealt to shards of bounded size. Each shard builds a minimal perfect hash over its hashes
   (levels of bit arrays, Limasset et al., SEA 2017: at each level the hashes that have a place alone stay there, the others go on
   to the next; a hash's rank among the set bits is its slot) with arrays in slot order: fingerprint, count and
   keeper. A shard is one row of bytes.
3. Documents send one packet of line hashes to each shard they touch. Packets of a shard are dealt over many tasks;
   each task gets the shard's row first and probes its arrays: whether a line goes is read from the count there. No line
   is joined with a line, and no task needs more than one shard. Dropped hashes then meet the whole text once, where
   the kept lines are written.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textbuf as tb
from .common import group_bounds, grouped, materialize, partitions, released, table, unused

LEAST_CHARS, LEAST_DOCS = 40, 5
#: Keys aimed at in a shard; bits a key at a level of the perfect hash, and levels.
SHARD_KEYS, LEVEL_BITS, LEVELS = 1 << 16, 2, 48
_SALTS = tb.numbers(5, LEVELS)


def line_key(line: bytes) -> bytes:
    """The line without blanks (0x20, 0x09-0x0D) at either end and with A-Z lower-cased."""
    return line.strip(tb.SPACE).lower()


def _long_lines(text: str | None, least: int) -> Iterator[tuple[int, bytes]]:
    for i, line in enumerate((text or "").encode("utf-8", "surrogatepass").split(b"\n")):
        if len(line) >= least:
            key = line_key(line)
            if len(key) >= least and (key.isascii() or len(key.decode("utf-8", "surrogatepass")) >= least):
                yield i, key


def _hash(key: bytes) -> tuple[int, int]:
    h = xxhash.xxh3_128_intdigest(key)
    return h >> 64, h & 0xFFFFFFFFFFFFFFFF


def _signed(x: list[int]) -> pa.Array:
    return pa.array(np.array(x, np.uint64).view(np.int64))


def _keys(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b, docs = [], [], []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            for x, y in {_hash(k) for _, k in _long_lines(text.as_py(), least)}:
                a.append(x)
                b.append(y)
                docs.append(doc)
        yield pa.RecordBatch.from_arrays([_signed(a), _signed(b), pa.array(docs, pa.int64())], names=["h1", "h2", "doc_id"])


# -- the perfect hash of one shard ---------------------------------------------------------------------------------


def _places(h1: np.ndarray, h2: np.ndarray, level: int, bits: int) -> np.ndarray:
    return (tb.mix(tb.mix(h1 ^ _SALTS[level]) + h2) % np.uint64(bits)).astype(np.int64)


def build_shard(h1: np.ndarray, h2: np.ndarray, count: np.ndarray, keeper: np.ndarray) -> bytes:
    """The perfect hash of distinct (h1, h2) and, in slot order, fingerprints (32 bits), counts and keepers.

    Hashes that no level tells apart (none in practice) get the last slots and follow the arrays as a short list.
    """
    n = len(h1)
    left, sizes, planes, slots = np.arange(n), [], [], []
    while len(left) and len(sizes) < LEVELS:
        bits = max(8, -(-LEVEL_BITS * len(left) // 8) * 8)
        at = _places(h1[left], h2[left], len(sizes), bits)
        alone = np.bincount(at, minlength=bits) == 1
        sizes.append(bits)
        planes.append(np.packbits(alone, bitorder="little"))
        own = alone[at]
        slots.append(left[own][np.argsort(at[own])])
        left = left[~own]
    order = np.concatenate([*slots, left]) if n else left
    arrays = [tb.mix(h2[order] ^ h1[order]).astype(np.uint32), np.minimum(count[order], 0xFFFFFFFF).astype(np.uint32), keeper[order].astype(np.int64)]
    more = np.stack([h1[left], h2[left]])
    head = np.array([n, len(left), len(sizes), *sizes], np.int64)
    return b"".join(x.tobytes() for x in (head, *arrays, more, *planes))


class Shard:
    """Probes of a built shard."""

    def __init__(self, raw: bytes):
        self.n, n_more, levels = (int(x) for x in np.frombuffer(raw, np.int64, 3))
        self.sizes = np.frombuffer(raw, np.int64, levels, 24).tolist()
        at = 24 + 8 * levels
        self.mark, self.count = (np.frombuffer(raw, np.uint32, self.n, at + 4 * self.n * k) for k in (0, 1))
        self.keeper = np.frombuffer(raw[at + 8 * self.n : at + 16 * self.n], np.int64)
        at += 16 * self.n
        more = np.frombuffer(raw[at : at + 16 * n_more], np.uint64).reshape(2, -1)
        self.more = [(a, b, self.n - n_more + i) for i, (a, b) in enumerate(more.T)]
        at += 16 * n_more
        self.planes, self.ranks, seen = [], [], 0
        for bits in self.sizes:
            plane = np.unpackbits(np.frombuffer(raw, np.uint8, bits // 8, at), bitorder="little")
            self.planes.append(plane.view(bool))
            self.ranks.append(np.cumsum(plane, dtype=np.int32) + (seen - 1))
            seen += int(plane.sum())
            at += bits // 8

    def probe(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Slot of each hash, or -1 where the fingerprint there is another's."""
        slot = np.full(len(h1), -1)
        left = np.arange(len(h1))
        for level, bits in enumerate(self.sizes):
            at = _places(h1[left], h2[left], level, bits)
            hit = self.planes[level][at]
            slot[left[hit]] = self.ranks[level][at[hit]]
            left = left[~hit]
            if not len(left):
                break
        for a, b, i in self.more:
            slot[(h1 == a) & (h2 == b)] = i
        wrong = (slot >= 0) & (self.mark[slot] != tb.mix(h2 ^ h1).astype(np.uint32)) if self.n else slot >= 0
        slot[wrong] = -1
        return slot


def _shards(batches: Iterator[pa.RecordBatch], salts: dict[int, int]) -> Iterator[pa.RecordBatch]:
    """Built shards, one row for each salt of theirs."""
    for got in grouped(batches, ["shard"]):
        shard = np.asarray(got["shard"])
        cut = group_bounds(shard)
        h1, h2 = (np.asarray(got[c]).view(np.uint64) for c in ("h1", "h2"))
        n, keeper = np.asarray(got["n"]), np.asarray(got["keeper"])
        for i, j in zip(cut[:-1], cut[1:], strict=True):
            body, m = build_shard(h1[i:j], h2[i:j], n[i:j], keeper[i:j]), salts.get(int(shard[i]), 1)
            for k in range(m):
                yield pa.RecordBatch.from_arrays([pa.array([shard[i]], pa.int64()), pa.array([k], pa.int64()), pa.array([body], pa.binary())], names=["shard", "salt", "body"])


def _shard_of(h1: np.ndarray, shards: int) -> np.ndarray:
    return (h1 >> np.uint64(40)).astype(np.int64) % shards


def _packets(batches: Iterator[pa.RecordBatch], shards: int, salts: dict[int, int], least: int) -> Iterator[pa.RecordBatch]:
    """One row for each document and shard: the hashes of its distinct long keys, 16 bytes a key."""
    for batch in batches:
        out = defaultdict(list)
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            found = {_hash(k) for _, k in _long_lines(text.as_py(), least)}
            if not found:
                continue
            pack = np.array(sorted(found), np.uint64)
            to = _shard_of(pack[:, 0], shards)
            for s in np.unique(to):
                out["shard"].append(int(s))
                out["salt"].append(doc % salts.get(int(s), 1))
                out["doc_id"].append(doc)
                out["body"].append(np.ascontiguousarray(pack[to == s]).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(out["shard"], pa.int64()), pa.array(out["salt"], pa.int64()), pa.array(out["doc_id"], pa.int64()), pa.array(out["body"], pa.binary())], names=["shard", "salt", "doc_id", "body"])


def _probe(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (shard, salt, doc_id) with the shard's own row, of a null doc_id, before its packets.

    Out come the hashes (16 bytes each) whose count reaches ``least`` and that another document keeps.
    """
    now, shard = None, None
    for batch in batches:
        docs, packs = [np.zeros(0, np.int64)], [np.zeros((0, 2), np.uint64)]  # of what is lost
        of, doc, body = batch.column(0).to_numpy(), batch.column(2), batch.column(3)
        heads = np.flatnonzero(np.asarray(doc.is_null()))
        cut = group_bounds(of, np.cumsum(np.asarray(doc.is_null())))
        for lo, hi in zip(cut[:-1], cut[1:], strict=True):  # runs of packets of a shard, after its row if that is here
            if lo in heads:
                now, shard = Shard(body[lo].as_py()), of[lo]
                lo += 1
            if lo == hi or now is None or shard != of[lo]:
                continue
            pack = np.frombuffer(b"".join(body.slice(lo, hi - lo).to_pylist()), np.uint64).reshape(-1, 2)
            own = np.repeat(doc.slice(lo, hi - lo).to_numpy(), np.asarray(pc.binary_length(body.slice(lo, hi - lo))) // 16)
            slot = now.probe(pack[:, 0], pack[:, 1])
            lost = (slot >= 0) & (now.count[slot] >= least) & (now.keeper[slot] != own)
            docs.append(own[lost].astype(np.int64))
            packs.append(pack[lost])
        docs, packs = np.concatenate(docs), np.concatenate(packs)
        cut = group_bounds(docs)
        yield pa.RecordBatch.from_arrays([pa.array(docs[cut[:-1]]), pa.array([packs[i:j].tobytes() for i, j in zip(cut[:-1], cut[1:], strict=True)], pa.binary())], names=["doc_id", "lost"])


def drop_lines(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """The rows of ``docs`` with ``text`` rewritten and the columns n_lines and n_dropped (long) added.

    A text is cut at \\n (null or empty: one empty line). Lines whose key has at least ``least_chars`` code points and
    is found in at least ``least_docs`` documents go, except from the largest doc_id that holds it, where all its
    lines stay. Rows that share a doc_id are one document to the counts, and all are rewritten; a row without a
    doc_id counts for nothing and is left as it is. A text that loses nothing is unchanged, null as well. Other
    columns pass through; no rows give no rows.
    """
    spark, gone = docs.sparkSession, unused("_lost", docs)
    for c in ("n_lines", "n_dropped"):
        docs = docs.drop(c)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null")
    keys = texts.mapInArrow(released(lambda it: _keys(it, least_chars)), "h1 long, h2 long, doc_id long")
    found = keys.groupBy("h1", "h2").agg(F.count_distinct("doc_id").alias("n"), F.max("doc_id").alias("keeper"))
    if docs.select("doc_id").schema[0].dataType.simpleString() not in ("bigint", "int"):
        raise TypeError("doc_id must be an integer")
    found = materialize(found, "lines")
    parts = partitions(spark)
    shards = max(1, -(-found.count() // SHARD_KEYS))
    made = found.withColumn("shard", F.expr(f"cast(shiftrightunsigned(h1, 40) % {shards} as bigint)"))
    # a shard that holds a frequent line gets many packets: it is copied, and its packets are dealt over the copies
    loads = made.groupBy("shard").agg(F.sum("n").alias("n"))
    fair = max(1, (loads.agg(F.sum("n")).first()[0] or 0) // (2 * parts))
    salts = {r.shard: -(-r.n // fair) for r in loads.filter(F.col("n") > fair).collect()}  # at most two a partition
    made = made.repartition(min(shards, parts), "shard").sortWithinPartitions("shard")
    made = made.select("shard", "h1", "h2", "n", "keeper").mapInArrow(released(lambda it: _shards(it, salts)), "shard long, salt long, body binary")
    made = made.select("shard", "salt", F.lit(None).cast("long").alias("doc_id"), "body")
    sent = texts.mapInArrow(released(lambda it: _packets(it, shards, salts, least_chars)), "shard long, salt long, doc_id long, body binary")
    met = made.union(sent).repartition(parts, "shard", "salt").sortWithinPartitions("shard", "salt", F.asc_nulls_first("doc_id"))
    lost = met.mapInArrow(released(lambda it: _probe(it, least_docs)), "doc_id long, lost binary").distinct().groupBy("doc_id").agg(F.collect_list("lost").alias(gone))
    out = docs.join(lost, "doc_id", "left").select(*docs.columns, gone)
    names, at = out.columns, out.columns.index("text")

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, fewer, new = [], [], []
            for t, lost in zip(batch.column(at), batch.column(len(names) - 1), strict=True):
                t, lost = t.as_py(), lost.as_py()
                total = (t or "").count("\n") + 1
                dropped = 0
                if lost:
                    lost = {tuple(x) for part in lost for x in np.frombuffer(part, np.uint64).reshape(-1, 2).tolist()}
                    out_lines = {i for i, k in _long_lines(t, least_chars) if _hash(k) in lost}
                    dropped = len(out_lines)
                    t = "\n".join(x for i, x in enumerate(t.split("\n")) if i not in out_lines)
                new.append(t)
                n.append(total)
                fewer.append(dropped)
            cols = [pa.array(new, pa.string()) if i == at else batch.column(i) for i in range(len(names) - 1)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(n, pa.int64()), pa.array(fewer, pa.int64())], names=[*names[:-1], "n_lines", "n_dropped"])

    schema = out.drop(gone).withColumn("n_lines", F.lit(0).cast("long")).withColumn("n_dropped", F.lit(0).cast("long")).schema
    return out.mapInArrow(released(rewrite), schema)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = drop_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


QUERIES = {"op3_line_dedup": op3_line_dedup}
ORACLE_SQL = {
    "op3_line_dedup": r"""
WITH l AS (
  SELECT doc_id, i, ls[i] AS line, translate(regexp_replace(ls[i], '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents), unnest(range(1, len(ls) + 1)) AS r(i)
), f AS (
  SELECT k, max(doc_id) AS keeper FROM l WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5
)
SELECT l.doc_id, count(*) AS n_lines, count(*) FILTER (WHERE f.k IS NOT NULL AND f.keeper <> l.doc_id) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE f.k IS NULL OR f.keeper = l.doc_id), '')) AS kept_sha256
FROM l LEFT JOIN f ON l.k = f.k GROUP BY l.doc_id
"""
}
