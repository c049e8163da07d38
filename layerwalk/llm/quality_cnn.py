"""Operator 2: quality classifier, a byte-level convolutional network in numpy.

A text is cut into overlapping chunks of ``CHUNK`` bytes that cover the whole of it. In a chunk, learned byte vectors
run under learned filters of ``WIDTH`` bytes at every ``STRIDE`` and are max-pooled. Of each filter's chunk maxima the
largest, the smallest and the mean over all chunks are kept, beside its mean rectified response, and one logistic unit
combines them into the probability of label 1. Only the bytes of the text are inputs.

Training runs Adam on a sample of at most ``SAMPLE`` labelled rows and ``SAMPLE_BYTES``, for a fixed number of steps. Training and scoring read
every byte of a text; chunks go through the layer in slices, so that memory does not follow the length of texts.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textbuf as tb
from .common import bounded_sample, released, table

#: Bytes of a chunk and of a filter, and between the positions of a filter; sizes of a byte vector and of the layer.
CHUNK, WIDTH, STRIDE, DIM, FILTERS = 512, 8, 4, 6, 40
#: Labelled rows that a model is fitted on, at most; steps, texts a step, and chunks that training holds at once.
SAMPLE, SAMPLE_BYTES, STEPS, BATCH, SLICE = 3000, 64_000_000, 700, 32, 256
THRESHOLD = 0.3
#: A chunk begins this many bytes after the last, so that every window of WIDTH bytes lies in one.
HOP = CHUNK - WIDTH + STRIDE


def _windows(codes: np.ndarray) -> np.ndarray:
    """(chunks, positions, WIDTH) byte codes of rows of CHUNK codes."""
    return np.lib.stride_tricks.sliding_window_view(codes, WIDTH, axis=1)[:, ::STRIDE]


def chunk_codes(data: np.ndarray) -> np.ndarray:
    """Rows of CHUNK codes that cover a text; the last one ends with it. Code 256 fills a text of under CHUNK bytes."""
    if len(data) < CHUNK:
        data = np.append(data.astype(np.int16), np.full(CHUNK - len(data), 256, np.int16))
    at = np.minimum(np.arange(-(-(len(data) - CHUNK) // HOP) + 1) * HOP, len(data) - CHUNK)
    return np.lib.stride_tricks.sliding_window_view(data, CHUNK)[at].astype(np.int16)


@dataclass
class Net:
    vectors: np.ndarray  # (257, DIM)
    filters: np.ndarray  # (WIDTH * DIM, FILTERS)
    bias: np.ndarray  # (FILTERS,)
    weights: np.ndarray  # (4 * FILTERS,)
    offset: np.ndarray  # (1,)

    def params(self) -> list[np.ndarray]:
        return [self.vectors, self.filters, self.bias, self.weights, self.offset]


def new_net() -> Net:
    rng = np.random.default_rng(2)
    f = np.float32
    return Net((rng.standard_normal((257, DIM)) * 0.5).astype(f), (rng.standard_normal((WIDTH * DIM, FILTERS)) * (WIDTH * DIM) ** -0.5).astype(f), np.zeros(FILTERS, f), np.zeros(4 * FILTERS, f), np.zeros(1, f))


def pooled(peak: np.ndarray, mean: np.ndarray, first: np.ndarray, per: np.ndarray) -> np.ndarray:
    """What is combined for each text, of the maxima and means of its chunks."""
    return np.concatenate([np.maximum.reduceat(peak, first), np.minimum.reduceat(peak, first), np.add.reduceat(peak, first) / per, np.add.reduceat(mean, first) / per], 1)


def _layer(net: Net, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows, their vectors, and rectified responses (chunks, positions, FILTERS) of chunks."""
    win = _windows(codes)
    n, p = win.shape[:2]
    x = net.vectors[win].reshape(n * p, WIDTH * DIM)
    return win, x, np.maximum(x @ net.filters + net.bias, 0).reshape(n, p, FILTERS)


def gradient(net: Net, texts: list[np.ndarray], y: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean log loss of whole texts and its gradient by the parameters. A second pass over the slices carries it back."""
    codes = [chunk_codes(t) for t in texts]
    per = np.array([len(c) for c in codes])
    of, first = np.repeat(np.arange(len(texts)), per), np.cumsum(per) - per
    codes = np.concatenate(codes)
    cuts = range(0, len(codes), SLICE)
    kept, peak, mean = None, np.empty((len(codes), FILTERS), np.float32), np.empty((len(codes), FILTERS), np.float32)
    for lo in cuts:
        kept = _layer(net, codes[lo : lo + SLICE])
        peak[lo : lo + SLICE], mean[lo : lo + SLICE] = kept[2].max(1), kept[2].mean(1)
    per = per.astype(np.float32)[:, None]
    h = pooled(peak, mean, first, per)
    z = np.clip(h @ net.weights + net.offset, -30, 30)
    d = ((1 / (1 + np.exp(-z)) - y) / len(y)).astype(np.float32)
    dh = d[:, None] * net.weights
    top, low, avg, all_ = (dh[:, k * FILTERS : (k + 1) * FILTERS] for k in range(4))
    g_v, g_f, g_b = np.zeros((257, DIM)), np.zeros_like(net.filters), np.zeros_like(net.bias)
    for lo in cuts:
        win, x, r = kept if len(cuts) == 1 else _layer(net, codes[lo : lo + SLICE])
        t, (n, p) = of[lo : lo + SLICE], win.shape[:2]
        tip = peak[lo : lo + SLICE]
        dpeak = (tip == h[t, :FILTERS]) * top[t] + (tip == h[t, FILTERS : 2 * FILTERS]) * low[t] + (avg / per)[t]
        dr = (all_ / (p * per))[t][:, None, :] * (r > 0)
        spot = r.argmax(1)[:, None]
        np.put_along_axis(dr, spot, np.take_along_axis(dr, spot, 1) + (dpeak * (tip > 0))[:, None], 1)
        dr = dr.reshape(n * p, FILTERS).astype(np.float32)
        g_f += x.T @ dr
        g_b += dr.sum(0)
        dx, flat = (dr @ net.filters.T).reshape(-1, DIM), win.reshape(-1)
        g_v += np.stack([np.bincount(flat, dx[:, k], 257) for k in range(DIM)], 1)
    loss = float(np.mean(np.logaddexp(0, z) - y * z))
    return loss, [g_v.astype(np.float32), g_f, g_b, h.T @ d, d.sum(keepdims=True)]


def fit(texts: list[bytes], labels: np.ndarray) -> Net:
    """A net fitted by Adam; with one label only, a constant."""
    net = new_net()
    y = np.asarray(labels, np.float32)
    if not len(y) or y.min() == y.max():
        net.offset[:] = 0 if not len(y) else (4 if y[0] else -4)
        return net
    rng = np.random.default_rng(3)
    sides = [np.flatnonzero(y == 0), np.flatnonzero(y == 1)]
    prior = float(np.log(len(sides[1]) / len(sides[0])))
    m, v = ([np.zeros_like(p) for p in net.params()] for _ in range(2))
    for step in range(1, STEPS + 1):
        pick = np.concatenate([rng.choice(s, BATCH // 2) for s in sides])
        _, found = gradient(net, [np.frombuffer(texts[d], np.uint8) for d in pick], y[pick])
        found[3] += 1e-4 * net.weights
        rate = 0.02 * (1 - step / (STEPS + 1)) + 1e-4
        for q, g, a, b in zip(net.params(), found, m, v, strict=True):
            a *= 0.9
            a += 0.1 * g
            b *= 0.99
            b += 0.01 * g * g
            q -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-7)
    net.offset += np.float32(prior)  # steps saw both labels equally often
    return net


def score(net: Net, data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Probabilities of a run of texts; chunks go through the layer in slices of bounded size."""
    out = np.zeros(len(off) - 1)
    chunks = [chunk_codes(data[i:j]) for i, j in zip(off[:-1], off[1:], strict=True)]
    per = np.array([len(c) for c in chunks])
    codes = np.concatenate(chunks)
    # WIDTH is twice STRIDE: a window is two steps of STRIDE bytes: one product gives what each step adds as first and as second of a window
    both = np.concatenate([net.filters[: STRIDE * DIM], net.filters[STRIDE * DIM :]], 1)
    tops, means = np.empty((len(codes), FILTERS), np.float32), np.empty((len(codes), FILTERS), np.float32)
    for lo in range(0, len(codes), 128):
        c = codes[lo : lo + 128]
        part = (np.take(net.vectors, c.ravel(), 0).reshape(-1, STRIDE * DIM) @ both).reshape(len(c), CHUNK // STRIDE, 2 * FILTERS)
        r = part[:, :-1, :FILTERS] + part[:, 1:, FILTERS:]
        r += net.bias
        np.maximum(r, 0, out=r)
        tops[lo : lo + 128] = r.max(1)
        means[lo : lo + 128] = np.full(r.shape[1], 1 / r.shape[1], np.float32) @ r
    h = pooled(tops.astype(np.float64), means.astype(np.float64), np.cumsum(per) - per, per[:, None])
    out[:] = 1 / (1 + np.exp(-np.clip(h @ net.weights.astype(np.float64) + float(net.offset[0]), -30, 30)))
    return out


def train(docs: DataFrame, labels: DataFrame, mod: int = 5, rest: int = 0) -> Net:
    """Fitted on at most SAMPLE labelled rows of SAMPLE_BYTES of text together whose crc32(doc_id as text) mod ``mod`` is not ``rest``.

    Rows with a null label or id are left out; of several labels of a document the largest counts, of several rows
    the largest text. Without labelled rows, or with one label only, every score is a constant.
    """
    ours = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % mod != rest
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ours).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("quality"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null")
    sizes = text.join(F.broadcast(known.select("doc_id")), "doc_id", "left_semi").groupBy("doc_id").agg(F.max(F.octet_length("text")).alias("size"))
    known = known.join(F.broadcast(bounded_sample(sizes, SAMPLE, SAMPLE_BYTES)), "doc_id", "left_semi")
    rows = text.join(F.broadcast(known), "doc_id").groupBy("doc_id", "quality").agg(F.max(F.coalesce("text", F.lit(""))).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = sorted({r["doc_id"]: r for b in batches for r in b.to_pylist()}.values(), key=lambda r: r["doc_id"])
        net = fit([r["text"].encode("utf-8", "surrogatepass") for r in got], np.array([int(r["quality"] > 0) for r in got]))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(net.params())], pa.binary())], names=["net"])

    # one task fits the bounded sample, so that a lost executor only repeats it
    got = rows.repartition(1).mapInArrow(released(run), "net binary").first()
    return Net(*pickle.loads(got.net)) if got else fit([], np.zeros(0))


def score_texts(docs: DataFrame, net: Net) -> DataFrame:
    """``docs`` with ``score`` double added (0 to 1, higher: label 1 likelier), for every row.

    Null and empty texts have the score of one empty chunk. A column ``score`` is replaced, others pass through.
    """
    docs = docs.drop("score")
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [np.zeros(0)]
            for _, _, data, off in tb.runs(batch.column(at)):
                got.append(score(net, data, off))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(got))], names=[*batch.schema.names, "score"])

    return docs.mapInArrow(released(run), docs.withColumn("score", F.lit(0.0)).schema)


def op2_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_texts(docs.select("doc_id", "text"), train(docs, table(spark, sf_dir, "labels")))
    out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return scored.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op2_quality_cnn": op2_quality_cnn}
