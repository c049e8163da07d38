"""Operator 8: language-model scoring from a log-frequency Bloom filter (Talbot and Osborne, 2007).

Training. Each task packs the word and bigram counts of its documents by segment of a 64-bit hash and sends one row a
segment, sorted, with words as full hashes and bigrams as 32 bits within their segment. Segments merge independently:
exact word counts stay in a packed table; quantised counts of words and bigrams go into the segment's part of the
filter, where an n-gram of level q = 1 + floor(log_B count) is a member under each of the levels 1..q. N-grams
seen once are members under level 1.

Scoring. The filter has ``BITS`` bits an n-gram at any size and stays a table of segments: runs of documents send packets
of their distinct n-grams to the groups of segments that hold them, and the levels come back to the run. So no
task or broadcast holds more than a bounded part of the filter. Repeated membership probes give a level, its mean count, and with it
p(w | v) = L * min(1, c(v w) / c(v)) + (1 - L) * (c(w) + 1) / (N + V + 1) for every token, with an end token in each
text. The exact base score looks words up in two steps: a broadcast table of the most frequent words, of bounded size,
and for the rest packets of hashes sent to the segment that holds their exact counts.
"""

from __future__ import annotations

import math
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textbuf as tb
from .common import drop_stage, group_bounds, grouped, materialize, partitions, table

_U = np.uint64
#: Base of the count levels; hashes a level; bits an n-gram in the filter.
BASE, HASHES, BITS = 1.5, 3, 14
#: Levels that the histogram of word counts tells apart.
LEVELS = 80
#: Words in the broadcast table of exact counts, at most; weight of bigrams.
FREQUENT, BIGRAM_WEIGHT = 1 << 19, 0.6
#: Bytes of text that ask the filter at once; bits of a segment's number within its group.
PROBE_BYTES, GROUP = 1 << 22, 3
#: Hash of the end token; words never hash to it (their hashes are odd).
END = _U(0)


def tokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text of each token: the words of a text, then its end."""
    start, end, text = tb.words(data, off)
    h = tb.span_hashes(data, start, end) | _U(1)
    n = len(off) - 1
    per = np.bincount(text, minlength=n) + 1
    last = np.cumsum(per) - 1
    out = np.full(int(per.sum()), END)
    is_word = np.ones(len(out), bool)
    is_word[last] = False
    out[is_word] = h
    return out, np.repeat(np.arange(n), per)


def bigrams(h: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Hash of each token with the one before it in its text; a first token follows the end."""
    before = np.empty_like(h)
    before[:1] = END
    before[1:] = np.where(text[1:] == text[:-1], h[:-1], END)
    return tb.mix(before * _U(0x9E3779B97F4A7C15) + tb.mix(h))


def ngrams(data: np.ndarray, off: np.ndarray, sb: int) -> tuple[np.ndarray, ...]:
    """Of a run of texts: place and text of each token, the distinct places with each token's number among them, the number of
    each token's bigram among the distinct ones, and segment and 32 bits of all distinct n-grams, words before bigrams."""
    h, text = tokens(data, off)
    place = _word_place(h)
    u, word = np.unique(place, return_inverse=True)
    two, pair = np.unique(bigrams(h, text), return_inverse=True)
    seg, low = _pair_place(two, sb)
    return place, text, u, word, pair, np.concatenate([_segment(u, sb), seg]), np.concatenate([word_low(u), low])


def segment_bits(parts: int) -> int:
    """Segments are a power of two that follows the shuffle partitions, so that one stays small at any size."""
    return max(6, (8 * parts - 1).bit_length())


def _segment(h: np.ndarray, sb: int) -> np.ndarray:
    return (h >> _U(64 - sb)).astype(np.int64)


def _pair_place(two: np.ndarray, sb: int) -> tuple[np.ndarray, np.ndarray]:
    """Segment of a bigram and 32 bits within it."""
    return _segment(two, sb), ((two >> _U(32 - sb)) & _U(0xFFFFFFFF)).astype(np.uint32)


_WORD_SPREAD = _U(0xD6E8FEB86659FD93)


def _word_place(h: np.ndarray) -> np.ndarray:
    """A bijection of word hashes whose upper bits deal words to segments."""
    return tb.mix(h * _WORD_SPREAD)


def held_out(ids: list[int], mod: int, rest: int) -> np.ndarray:
    return np.array([zlib.crc32(str(i).encode()) % mod == rest for i in ids], bool)


def _count(batches: Iterator[pa.RecordBatch], mod: int, rest: int, sb: int) -> Iterator[pa.RecordBatch]:
    """(segment, words, counts, bigrams, counts) rows of training documents, in runs of bounded size."""
    words: list[np.ndarray] = []
    pairs: list[np.ndarray] = []
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        w, nw = np.unique(_word_place(np.concatenate(words)), return_counts=True)
        p, np_ = np.unique(np.concatenate(pairs) >> _U(32 - sb), return_counts=True)
        n = 1 << sb
        cw, cp = (np.searchsorted(x >> _U(s), np.arange(n + 1, dtype=_U)) for x, s in ((w, 64 - sb), (p, 32)))
        low = (p & _U(0xFFFFFFFF)).astype(np.uint32)
        nw, np_ = nw.astype(np.uint32), np_.astype(np.uint32)
        cols = [[x[c[s] : c[s + 1]].tobytes() for s in range(n)] for x, c in ((w, cw), (nw, cw), (low, cp), (np_, cp))]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n, dtype=np.int32)), *(pa.array(c, pa.binary()) for c in cols)], names=["segment", "w", "nw", "p", "np"])

    for batch in batches:
        keep = pa.array(~held_out(batch.column(0).to_pylist(), mod, rest))
        for _, _, data, off in tb.runs(batch.column(1).filter(keep)):
            h, text = tokens(data, off)
            words.append(h)
            pairs.append(bigrams(h, text))
            size += len(h)
            if size > 2_000_000:
                yield from flush()
                words, pairs, size = [], [], 0
    if size:
        yield from flush()


def _merge(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, c = np.concatenate(keys), np.concatenate(counts).astype(np.int64)
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    at = group_bounds(k)[:-1] if len(k) else np.zeros(0, np.int64)
    return k[at], np.add.reduceat(c, at) if len(k) else c


def level(counts: np.ndarray) -> np.ndarray:
    """Quantised count: 1 + floor(log_BASE count), at most 255."""
    return np.minimum(1 + np.floor(np.log(np.maximum(counts, 1)) / math.log(BASE) + 1e-9), 255).astype(np.int64)


#: Mean count that stands for each level (level 0: none).
LEVEL_COUNT = np.array([0.0] + [(BASE ** (q - 1) + max(BASE ** (q - 1), BASE**q - 1)) / 2 for q in range(1, 256)])


class LogBloom:
    """Probes of the filter: bits of segment s fill the bytes [s * width, (s + 1) * width)."""

    def __init__(self, bits: np.ndarray, segments: int):
        self.bits, self.width = bits, len(bits) // segments

    @staticmethod
    def places(seg: np.ndarray, low: np.ndarray, q: np.ndarray | int, k: int, width: int) -> np.ndarray:
        x = tb.mix((low.astype(_U) << _U(20)) + np.asarray(q, _U) * _U(64) + _U(k))
        return seg * (8 * width) + ((x >> _U(16)) % _U(8 * width)).astype(np.int64)

    def levels(self, seg: np.ndarray, low: np.ndarray) -> np.ndarray:
        """The highest level up to which an n-gram is a member of all."""
        out = np.zeros(len(seg), np.int64)
        live = np.arange(len(seg))
        for q in range(1, 256):
            for k in range(HASHES):
                at = self.places(seg[live], low[live], q, k, self.width)
                live = live[(self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 != 0]
                if not len(live):
                    return out
            out[live] = q
        return out


def fill(seg_width: int, low: np.ndarray, counts: np.ndarray) -> bytes:
    """The bits of one segment with its n-grams under all their levels."""
    on = np.zeros(8 * seg_width, bool)
    q = level(counts)
    live = np.arange(len(low))
    n = 1
    while len(live):
        for k in range(HASHES):
            on[LogBloom.places(np.zeros(len(live), np.int64), low[live], n, k, seg_width)] = True
        n += 1
        live = live[q[live] >= n]
    return np.packbits(on, bitorder="little").tobytes()


def word_low(place: np.ndarray) -> np.ndarray:
    """32 bits of a word, apart from those of bigrams."""
    return (tb.mix(place ^ _U(0xA5A5A5A5)) >> _U(32)).astype(np.uint32)


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merged segments: packed exact word counts, packed counts of bigrams, totals and a histogram of levels."""
    for got in grouped(batches, ["segment"]):
        seg = np.asarray(got["segment"])
        cut = group_bounds(seg)
        for lo, hi in zip(cut[:-1], cut[1:], strict=True):
            part = {c: got[c][lo:hi].to_pylist() for c in ("w", "nw", "p", "np")}
            w, nw = _merge([np.frombuffer(x, _U) for x in part["w"]], [np.frombuffer(x, np.uint32) for x in part["nw"]])
            p, n2 = _merge([np.frombuffer(x, np.uint32) for x in part["p"]], [np.frombuffer(x, np.uint32) for x in part["np"]])
            hist = np.bincount(np.minimum(level(nw), LEVELS - 1), minlength=LEVELS)
            yield pa.RecordBatch.from_arrays(
                [pa.array([seg[lo]], pa.int32()), pa.array([w.tobytes()], pa.binary()), pa.array([nw.tobytes()], pa.binary()), pa.array([p.tobytes()], pa.binary()), pa.array([np.minimum(n2, 0xFFFFFFFF).astype(np.uint32).tobytes()], pa.binary()),
                 pa.array([int(nw.sum())]), pa.array([len(w)]), pa.array([len(w) + len(p)]), pa.array([hist.tolist()], pa.list_(pa.int64()))],
                names=["segment", "w", "nw", "p", "np", "total", "words", "grams", "hist"],
            )


def train(docs: DataFrame, mod: int = 7, rest: int = 2) -> dict:
    """The model of all texts whose crc32(doc_id as text) mod ``mod`` is not ``rest``.

    ``segments`` is a written table: of each segment the exact counts of its words and its bits of the filter; ``frequent``
    (at most FREQUENT words with exact counts), ``total`` and ``distinct`` are held for broadcast.
    """
    spark = docs.sparkSession
    sb = segment_bits(partitions(spark))
    sent = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null").mapInArrow(lambda it: _count(it, mod, rest, sb), "segment int, w binary, nw binary, p binary, np binary")
    dealt = sent.repartition(partitions(spark), "segment").sortWithinPartitions("segment")
    schema = "segment int, w binary, nw binary, p binary, np binary, total long, words long, grams long, hist array<long>"
    counted = materialize(dealt.mapInArrow(_segments, schema), "ngrams")
    sums = counted.agg(F.sum("total"), F.sum("words"), F.sum("grams"), *(F.sum(F.col("hist")[q]) for q in range(LEVELS))).first()
    total, distinct, grams, *hist = (int(x or 0) for x in sums)
    hist = np.array(hist)
    above = np.append(np.cumsum(hist[::-1])[::-1], 0)
    least = int(np.argmax(above <= FREQUENT))  # all words from this level on fit
    width = max(64, BITS * grams >> (sb + 3))

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s, w, nw, p, n2 in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                w, nw, p, n2 = np.frombuffer(w, _U), np.frombuffer(nw, np.int64), np.frombuffer(p, np.uint32), np.frombuffer(n2, np.uint32)
                bits = fill(width, np.concatenate([word_low(w), p]), np.concatenate([nw, n2]))
                often = np.minimum(level(nw), LEVELS - 1) >= least
                cols = [bits, w.tobytes(), nw.tobytes(), w[often].tobytes(), nw[often].tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), *(pa.array([x], pa.binary()) for x in cols)], names=["segment", "bits", "w", "nw", "often", "n_often"])

    built = materialize(counted.select("segment", "w", "nw", "p", "np").mapInArrow(parts, "segment int, bits binary, w binary, nw binary, often binary, n_often binary"), "filter")
    drop_stage(counted)
    w, nw = [np.zeros(0, _U)], [np.zeros(0, np.int64)]
    for r in built.select("often", "n_often").collect():  # bounded by FREQUENT
        w.append(np.frombuffer(r.often, _U))
        nw.append(np.frombuffer(r.n_often, np.int64))
    w, nw = np.concatenate(w), np.concatenate(nw)
    order = np.argsort(w)
    return {"segments": built.select("segment", "bits", "w", "nw"), "frequent": (w[order], nw[order]), "total": total, "distinct": distinct, "sb": sb}


def find(keys: np.ndarray, sorted_keys: np.ndarray) -> np.ndarray:
    """Index of each key in the sorted keys, or -1."""
    if not len(sorted_keys):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return np.where(sorted_keys[at] == keys, at, -1)


def _packed(data: np.ndarray, off: np.ndarray) -> bytes:
    return zstandard.compress(np.array([len(off)], np.int64).tobytes() + off.astype(np.int64).tobytes() + data.tobytes(), 3)


def _unpacked(body: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zstandard.decompress(body)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    return np.frombuffer(raw, np.uint8, -1, 8 + 8 * n) if len(raw) > 8 + 8 * n else np.zeros(0, np.uint8), np.frombuffer(raw, np.int64, n, 8)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbered runs of documents: their ids and compressed texts."""
    run = TaskContext.get().partitionId() << 40
    for batch in batches:
        for lo, hi, data, off in tb.runs(batch.column(1), PROBE_BYTES):
            ids = pa.ListArray.from_arrays(pa.array([0, hi - lo], pa.int32()), batch.column(0).slice(lo, hi - lo))
            yield pa.RecordBatch.from_arrays([pa.array([run], pa.int64()), ids, pa.array([_packed(data, off)], pa.binary())], names=["run", "ids", "body"])
            run += 1


def _ask(batches: Iterator[pa.RecordBatch], sb: int) -> Iterator[pa.RecordBatch]:
    """A packet from each run to each group of segments: its distinct n-grams there, sorted by segment."""
    for batch in batches:
        for run, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            *_, seg, low = ngrams(*_unpacked(body.as_py()), sb)
            order = np.argsort(seg, kind="stable")
            seg, low = seg[order], low[order]
            cut = group_bounds(seg >> GROUP)
            own = (seg & ((1 << GROUP) - 1)).astype(np.uint8)
            n = len(cut) - 1
            bodies = [[x[i:j].tobytes() for i, j in zip(cut[:-1], cut[1:], strict=True)] for x in (own, low)]
            yield pa.RecordBatch.from_arrays(
                [pa.array((seg[cut[:-1]] >> GROUP).astype(np.int32)), pa.array(np.full(n, run, np.int64)), pa.array(np.zeros(n, np.int32)), *(pa.array(x, pa.binary()) for x in bodies)],
                names=["group", "run", "segment", "own", "low"],
            )


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Levels of each packet, in its order. A group's parts of the filter (run -1), by segment, come before its packets."""
    group, part, bloom = -1, [], None
    for batch in batches:
        out: list[bytes] = []
        asked = np.asarray(batch.column(1)) >= 0
        for g, run, own, low in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3), batch.column(4), strict=True):
            if run < 0:
                if g != group:
                    group, part, bloom = g, [], None
                part.append(np.frombuffer(low.as_py(), np.uint8))
                continue
            low = np.frombuffer(low.as_py(), np.uint32)
            if g != group:  # nothing was learnt
                out.append(bytes(len(low)))
                continue
            if bloom is None:
                bloom = LogBloom(np.concatenate(part), len(part))
            out.append(bloom.levels(np.frombuffer(own.as_py(), np.uint8).astype(np.int64), low).astype(np.uint8).tobytes())
        keep = pa.array(asked)
        yield pa.RecordBatch.from_arrays([batch.column(1).filter(keep), batch.column(0).filter(keep), pa.array(out, pa.binary())], names=["run", "group", "levels"])


def _with_levels(docs: DataFrame, model: dict) -> tuple[DataFrame, list[DataFrame]]:
    """(run, group, ids, body): each run of documents (group -1), and after it the levels of its n-grams by group; and the stages it reads."""
    spark, sb = docs.sparkSession, model["sb"]
    n = partitions(spark)
    runs = materialize(docs.mapInArrow(_runs, "run long, ids array<long>, body binary"), "runs")
    schema = "group int, run long, segment int, own binary, low binary"
    asked = runs.select("run", "body").mapInArrow(lambda it: _ask(it, sb), schema)
    parts = model["segments"].select(F.shiftright("segment", GROUP).alias("group"), F.lit(-1).cast("long").alias("run"), "segment", F.lit(None).cast("binary").alias("own"), F.col("bits").alias("low"))
    met = parts.union(asked).repartition(n, "group").sortWithinPartitions("group", "run", "segment")
    none = F.lit(None).cast("array<long>").alias("ids")
    levels = materialize(met.mapInArrow(_answer, "run long, group int, levels binary"), "levels")
    every = runs.select("run", F.lit(-1).alias("group"), "ids", "body").union(levels.select("run", "group", none, F.col("levels").alias("body")))
    return every.repartition(n, "run").sortWithinPartitions("run", "group"), [runs, levels]


def score_texts(docs: DataFrame, model: dict, mod: int = 7, rest: int = 2) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row with a doc_id.

    A null or empty text has one token, its end. Rows repeated under one doc_id are scored each. Without any training
    text every count is zero. Rows without a doc_id are left out; other columns are ignored; no rows give no rows.
    """
    spark = docs.sparkSession
    total, distinct, sb = model["total"], model["distinct"], model["sb"]
    whole = math.log10(total + distinct + 1)
    shared = spark.sparkContext.broadcast(model["frequent"])

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, bytes, np.ndarray]]:
        """Ids and texts of each run with the levels of its n-grams, by segment."""
        own, levels = None, []
        for batch in batches:
            for group, ids, body in zip(batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                if group >= 0:
                    levels.append(np.frombuffer(body.as_py(), np.uint8))
                    continue
                if own is not None:
                    yield *own, np.concatenate(levels)
                own, levels = (ids.values, body.as_py()), []
        if own is not None:
            yield *own, np.concatenate(levels)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of documents (segment null) and packets of rare words (segment, hashes, number of the row from ``row`` on)."""
        often, n_often = shared.value
        log_often = np.log10(n_often + 1.0)
        row = TaskContext.get().partitionId() << 40
        for ids, body, levels in units(batches):
            ids = ids.to_pylist()
            out = held_out(ids, mod, rest)
            ids = np.array(ids, np.int64)
            packets: dict[int, list] = defaultdict(list)
            place, text, u, back, pair, seg, low = ngrams(*_unpacked(body), sb)
            q = np.empty(len(seg), np.int64)
            q[np.argsort(seg, kind="stable")] = levels
            c1, c2 = LEVEL_COUNT[q[: len(u)]], LEVEL_COUNT[q[len(u) :]][pair]
            at = find(u, often)
            now = c1[back]
            end = c1[np.searchsorted(u, _word_place(np.array([END])))[0]]
            before = np.append(end, now[:-1])
            before[np.append(True, text[1:] != text[:-1])] = end
            p = BIGRAM_WEIGHT * np.minimum(1.0, c2 / np.maximum(before, np.maximum(c2, 1))) + (1 - BIGRAM_WEIGHT) * np.minimum(1.0, (now + 1) / (total + distinct + 1))
            first = np.searchsorted(text, np.arange(len(ids)))
            got = at[back]
            base = np.add.reduceat(np.where(got >= 0, log_often[got] if len(log_often) else 0.0, 0.0), first)
            known = np.add.reduceat((got >= 0).astype(np.int64), first)
            rare = np.flatnonzero(got < 0)
            if len(rare):
                for s, x in _split(place[rare], text[rare], sb):
                    packets[s].append(x)
            doc, flag, n, sc = ids, out, np.bincount(text, minlength=len(ids)), np.add.reduceat(np.log10(p), first)
            seg, pdoc, pkey = [], [], []
            for s, x in packets.items():
                seg.append(s)
                pkey.append(np.concatenate([a for a, _ in x]).tobytes())
                pdoc.append(np.concatenate([b for _, b in x]).astype(np.uint32).tobytes())
            m, k = len(doc), len(seg)
            none = pa.nulls
            yield pa.RecordBatch.from_arrays(
                [pa.concat_arrays([none(m, pa.int32()), pa.array(seg, pa.int32())]), pa.concat_arrays([pa.array(doc), none(k, pa.int64())]), pa.concat_arrays([pa.array(flag), none(k, pa.bool_())]),
                 pa.concat_arrays([pa.array(n.astype(np.int64)), none(k, pa.int64())]), pa.concat_arrays([pa.array(known), none(k, pa.int64())]), pa.concat_arrays([pa.array(base), none(k, pa.float64())]),
                 pa.concat_arrays([pa.array(sc), none(k, pa.float64())]), pa.concat_arrays([none(m, pa.binary()), pa.array(pkey, pa.binary())]), pa.concat_arrays([none(m, pa.binary()), pa.array(pdoc, pa.binary())]),
                 pa.concat_arrays([pa.array(np.arange(m) + row), pa.array(np.full(k, row, np.int64))])],
                names=["segment", "doc_id", "held_out", "n_tokens", "n_known", "base", "score", "keys", "rows", "row"],
            )
            row += m

    schema = "segment int, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, keys binary, rows binary, row long"
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null")
    dealt, spent = _with_levels(docs, model)
    scored = materialize(dealt.mapInArrow(score, schema), "scores")
    for stage in spent:
        drop_stage(stage)

    exact = model["segments"].select("segment", F.col("w").alias("keys"), F.col("nw").alias("rows"), F.lit(-1).cast("long").alias("row"))
    asked = scored.filter("segment is not null").select("segment", "keys", "rows", "row")
    met = exact.union(asked).repartition(partitions(spark), "segment").sortWithinPartitions("segment", "row")

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The segment's exact counts come before its packets; sums by document of each packet."""
        w, n, own = np.zeros(0, _U), np.zeros(0, np.int64), -1
        for batch in batches:
            for segment, keys, rows, row in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), batch.column(3).to_pylist(), strict=True):
                if row < 0:
                    w, n, own = np.frombuffer(keys.as_py(), _U), np.frombuffer(rows.as_py(), np.int64), segment
                    continue
                if segment != own:  # a segment without training words
                    continue
                at = find(np.frombuffer(keys.as_py(), _U), w)
                hit = at >= 0
                if hit.any():
                    r, back = np.unique(np.frombuffer(rows.as_py(), np.uint32)[hit], return_inverse=True)
                    yield pa.RecordBatch.from_arrays([pa.array(r.astype(np.int64) + row), pa.array(np.bincount(back)), pa.array(np.bincount(back, np.log10(n[at[hit]] + 1.0)))], names=["row", "known", "part"])

    rare = met.mapInArrow(look_up, "row long, known long, part double").groupBy("row").agg(F.sum("known").alias("known"), F.sum("part").alias("part"))
    done = scored.filter("segment is null").join(rare, "row", "left")
    return done.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("part", F.lit(0.0)) - F.col("n_tokens") * F.lit(whole)).alias("base_score"), "score",
    )


def _split(place: np.ndarray, row: np.ndarray, sb: int) -> Iterator[tuple[int, tuple[np.ndarray, np.ndarray]]]:
    seg = _segment(place, sb)
    order = np.argsort(seg, kind="stable")
    seg, place, row = seg[order], place[order], row[order]
    cut = group_bounds(seg)
    for lo, hi in zip(cut[:-1], cut[1:], strict=True):
        yield int(seg[lo]), (place[lo:hi], row[lo:hi])


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_texts(docs, train(docs))


QUERIES = {"op8_lm_score": op8_lm_score}
