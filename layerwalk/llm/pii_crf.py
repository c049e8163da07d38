"""Operator 10: personal data by patterns and a skip-chain conditional random field.

Base spans are found by four patterns in every whole text and are fixed evidence. A text is then a sequence of tokens
(runs of letters, digits and ``. _ % + @ / -``), each labelled none, email, ip, card, phone or secret by a linear
chain with skip edges. A token that could name an entity (it holds a digit or @, is as long as a key, or repeats the name
part of an address in the text) has a key: letters and digits without case or punctuation, the name part of an address, or
the last seven digits of a longer number. Skip edges join the first token of a key to all others of it, so edges grow with the text
and a label is two edges away from any mention. Loopy message passing over chain and skip edges goes on until the messages
settle. Tokens that come out labelled and that no base span meets become added spans of their kind.

What repeated mentions say:

- The shape of a token is one piece of evidence however often the token stands in a text: each of k mentions has a k-th of
  it. What stands before a mention is evidence of its own, so a mention without telling words is neutral.
- A skip edge costs nothing where both ends agree, whatever the label, and the sum of both labels' penalties where they do not
  (that of none is 0). So many mentions of a key are as likely to be labelled as one, and one telling mention labels all.
- Chain potentials say how labels stand beside each other; with none on either side they are 0. Other tokens than candidates are none,
  so they carry no message and take no part.

Weights of features, chain and skip edges are learned together by pseudo-likelihood: each token's label given those of its
neighbours, which is one softmax regression. It is fitted on whole texts of a bounded sample of documents, labelled by the base
spans, assignments to a credential's name, well-known beginnings of keys and repeats of what is labelled, and on generated texts with repeated
entities and with repeated numbers and checksums that are none.
"""

from __future__ import annotations

import pickle
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textbuf as tb
from .common import bounded_sample, table

#: The patterns of the base spans, in the order of kinds. (Digit runs are possessive, so matching is linear.)
PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"),
    "card": re.compile(r"[0-9](?:[\x20-]?[0-9])++"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
KINDS = [*PATTERNS, "secret"]
NONE, SECRET, LABELS = 0, 5, 6
#: Documents that the field is fitted on and their bytes, at most, and generated examples beside them.
SAMPLE, SAMPLE_BYTES, MADE = 1500, 32_000_000, 400
#: Messages settle when none moves by more; rounds after which those of a graph that swings are taken as they are; least belief in an added label.
SETTLED, ROUNDS, SURE = 1e-7, 500, 0.5
#: Potentials are raised to this power for labelling, so that the best labelling of a text decides and not how many others come near it: of
#: those there are the more, the more mentions there are.
COLD = 8.0
#: Names of credentials.
NAMES = "token secret password passwd pwd apikey api_key api-key access_key access-key auth_token auth-token access_token client_secret private_key".split()
#: Public beginnings of access keys and tokens.
PREFIXES = "AKIA ASIA ghp_ gho_ ghs_ github_pat_ glpat- sk_live_ sk_test_ rk_live_ xoxb- xoxp- AIza".split()
_PREFIXED = re.compile(rf"(?:{'|'.join(map(re.escape, PREFIXES))})[A-Za-z0-9_-]{{14,}}")
_ASSIGNED = re.compile(rf"(?i)(?<![a-z])(?:{'|'.join(NAMES)})[\"']?\s{{0,3}}[:=]\s{{0,3}}[\"']?([A-Za-z0-9+/_-]{{16,}})")
_DIGITS = re.compile(r"[^0-9]")
_KEY = re.compile(r"[^0-9a-z]")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
_ANY_DIGIT = re.compile("[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i & 1:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches; a match can only begin in the run of name characters before an @."""
    out, at = [], 0
    while True:
        sign = text.find("@", at)
        if sign < 0:
            return out
        start = sign
        while start > (out[-1][1] if out else 0) and _LOCAL.match(text, start - 1, start):
            start -= 1
        m = PATTERNS["email"].match(text, start) if start < sign else None
        if m:
            out.append(m.span())
            at = m.end()
        else:
            at = sign + 1


def _part(x: str) -> bool:
    x = x.lstrip("0")
    return len(x) < 3 or len(x) == 3 and int(x) <= 255


def base_spans(text: str) -> tuple[list[list[tuple[int, int]]], list[tuple[int, int]]]:
    """Spans of each kind of PATTERNS, and matches that failed their check."""
    out: list[list[tuple[int, int]]] = [[], [], [], []]
    failed: list[tuple[int, int]] = []
    if "@" in text:
        out[0] = _emails(text)
    if _ANY_DIGIT.search(text):
        for m in PATTERNS["ip"].finditer(text):
            (out[1] if all(map(_part, m[0].split("."))) else failed).append(m.span())
        for m in PATTERNS["card"].finditer(text):
            d = _DIGITS.sub("", m[0])
            if len(d) >= 13:
                (out[2] if 16 <= len(d) <= 19 and luhn(d) else failed).append(m.span())
        if "+" in text:
            for m in PATTERNS["phone"].finditer(text):
                (out[3] if 8 <= len(_DIGITS.sub("", m[0])) <= 15 else failed).append(m.span())
    return out, failed


# -- tokens and features -------------------------------------------------------------------------------------------

_IN_TOKEN = np.zeros(256, bool)
_IN_TOKEN[128:] = True
_IN_TOKEN[[ord(c) for c in "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ._%+@/-"]] = True
#: Classes of bytes whose counts in a token are features.
_DIGIT, _UPPER, _LOWER, _HEX, _SIGN, _FIRST = range(6)
_CLASS = np.zeros((256, 6), bool)
_CLASS[48:58, _DIGIT] = _CLASS[65:91, _UPPER] = _CLASS[97:123, _LOWER] = _CLASS[64, _SIGN] = True
_CLASS[[ord(c) for c in "0123456789abcdefABCDEF"], _HEX] = True
_CLASS[:, _FIRST] = (np.arange(256) & 192) != 128  # bytes that begin a code point
_NAMES = None


def name_hashes() -> np.ndarray:
    global _NAMES
    if _NAMES is None:
        _NAMES = np.sort(tb.span_hashes(*(lambda d, o: (d, o[:-1], o[1:]))(*tb.buffers(pa.array(NAMES)))))
    return _NAMES


class Tokens:
    """Tokens of a run of texts: byte places, text numbers, code point places, features and candidates."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        self.data, self.off = data, off
        self.start, self.end, self.text = tb.words(data, off, _IN_TOKEN)
        n = np.zeros((len(self.start), 6))
        for k in range(6):  # one class at a time: a text of any length takes a few times its bytes
            sums = np.zeros(len(data) + 1, np.int32)
            np.cumsum(_CLASS[:, k][data], out=sums[1:])
            n[:, k] = sums[self.end] - sums[self.start]
        self.points = sums  # code points before each byte, of the whole run
        length = np.maximum(n[:, _FIRST], 1)
        self.candidate = (n[:, _DIGIT] > 0) | (n[:, _SIGN] > 0) | (length >= 16)
        h = tb.span_hashes(data, self.start, self.end)
        names = name_hashes()
        named = names[np.minimum(np.searchsorted(names, h), len(names) - 1)] == h
        # a credential's name within the two tokens before, and a = or : right before
        before = np.zeros(len(h), bool)
        for k in (1, 2):
            before[k:] |= named[:-k] & (self.text[k:] == self.text[:-k])
        gap = np.zeros(len(h), bool)
        if len(h):
            sign = np.append(0, np.cumsum((data == 61) | (data == 58)))
            gap[1:] = (sign[self.start[1:]] > sign[self.end[:-1]]) & (self.text[1:] == self.text[:-1]) & (self.start[1:] - self.end[:-1] <= 6)
        digits = n[:, _DIGIT]
        key = (length >= 16) & (digits > 0) & (n[:, _UPPER] + n[:, _LOWER] > 0) & (n[:, _SIGN] == 0)
        self.x = np.stack(
            [np.ones(len(h)), digits / length, np.minimum(digits, 20) / 10, n[:, _HEX] / length, np.minimum(length, 40) / 20, (digits > 0) & (n[:, _UPPER] + n[:, _LOWER] > 0), n[:, _SIGN] > 0, length >= 16, key, before & gap & (length >= 8), before & gap & key, before],
            1,
        ).astype(np.float64)


N_ALONE, N_FEATURES = 9, 14  # shape of the token alone; then what stands before it; a failed match, and a key's beginning, are shape too
SHAPE = np.array([True] * N_ALONE + [False] * 3 + [True] * 2)


def skip_key(token: str) -> str:
    """What repeated or similar tokens have in common, or nothing."""
    token = token.strip("._%+@/-").lower()
    if "@" in token:
        token = token.split("@", 1)[0]
    elif len(token) >= 7 and not token.strip("0123456789.-/") and token.count(".") != 3:
        return "#" + _DIGITS.sub("", token)[-7:]
    elif token.count(".") == 3 and not token.strip("0123456789."):
        return token
    key = _KEY.sub("", token)
    return key if len(key) >= 5 and (_ANY_DIGIT.search(key) or len(key) >= 16 or "." in token or "_" in token) else ""


class Field:
    """The graph of a run of texts: candidate tokens, labels fixed by base spans, chain and skip edges, features."""

    def __init__(self, texts: list[str | None], data: np.ndarray, off: np.ndarray):
        t = self.tokens = Tokens(data, off)
        n = len(t.start)
        self.base: list[list[list[tuple[int, int]]]] = []
        label, refuted = np.full(n, -1), np.zeros(n, bool)
        first = np.searchsorted(t.text, np.arange(len(texts) + 1))
        zero = t.points[off]
        self.begin, self.finish = t.points[t.start] - zero[t.text], t.points[t.end] - zero[t.text]
        for i, text in enumerate(texts):
            base, failed = base_spans(text) if text and ("@" in text or _ANY_DIGIT.search(text)) else ([[], [], [], []], [])
            self.base.append(base)
            lo, hi = first[i], first[i + 1]
            starts, ends = self.begin[lo:hi], self.finish[lo:hi]
            for spans, put in [(failed, None), *((b, k + 1) for k, b in enumerate(base))]:
                for s, e in spans:
                    a, b = lo + np.searchsorted(ends, s, "right"), lo + np.searchsorted(starts, e)
                    if put is None:
                        refuted[a:b] = True
                    else:
                        label[a:b] = np.where(label[a:b] < 0, put, label[a:b])
        refuted &= label < 0
        candidate = np.flatnonzero(t.candidate | (label >= 0))
        # name parts of addresses make candidates of the words that repeat them
        locals_ = {i: {text[s:e].split("@", 1)[0].lower() for s, e in self.base[i][0]} for i, text in enumerate(texts) if self.base[i][0]}
        more = [k for i, names in locals_.items() for k in range(first[i], first[i + 1]) if label[k] < 0 and self.finish[k] - self.begin[k] >= 5 and self.word(k).strip("._%+-").lower() in names]
        candidate = np.union1d(candidate, np.array(more, int)).astype(int)
        self.live = candidate
        first_of: dict[tuple[int, str], int] = {}
        a, b = [], []
        prefixed = np.zeros(len(candidate), bool)
        size = np.ones(len(candidate))
        for at, k in enumerate(candidate.tolist()):
            word = self.word(k)
            prefixed[at] = t.start[k] + 18 <= t.end[k] and _PREFIXED.match(word) is not None
            if key := skip_key(word):
                head = first_of.setdefault((int(t.text[k]), key), at)
                if head != at:
                    a.append(head)
                    b.append(at)
        self.skips = (np.array(a, int), np.array(b, int))
        np.add.at(size, self.skips[0], 1)
        size[self.skips[1]] = size[self.skips[0]]
        next_ = np.flatnonzero((np.diff(candidate) == 1) & (t.text[candidate[1:]] == t.text[candidate[:-1]])) if len(candidate) else np.zeros(0, int)
        self.chain = (next_, next_ + 1)
        self.label = label[candidate]
        self.x = np.column_stack([t.x[candidate], refuted[candidate], prefixed])
        self.x[:, SHAPE] /= size[:, None]

    def word(self, k: int) -> str:
        return self.tokens.data[self.tokens.start[k] : self.tokens.end[k]].tobytes().decode("utf-8", "replace")


# -- inference -----------------------------------------------------------------------------------------------------


def beliefs(emit: np.ndarray, edges: list[tuple[np.ndarray, np.ndarray, np.ndarray]], rounds: int = ROUNDS) -> np.ndarray:
    """Beliefs of each node over the labels by sum-product messages, over all edges at once in each round, until they settle.

    emit: (n, labels) log potentials. edges: (a, b, log potentials by label of a and of b) of each sort of edge. Messages over
    skip edges are damped by half, in logarithms. On a forest the beliefs are the marginals.
    """
    emit = emit - emit.max(1, keepdims=True, initial=-1e300)
    m = emit.shape[1]
    sorts = []
    for k, (a, b, psi) in enumerate(edges):
        sorts.append([a, b, np.exp(psi - psi.max()), np.full((len(a), m), -np.log(m)), np.full((len(a), m), -np.log(m)), 0.5 if k else 0.0])

    def gathered() -> np.ndarray:
        whole = emit.copy()
        for a, b, _, to_b, to_a, _ in sorts:
            np.add.at(whole, b, to_b)
            np.add.at(whole, a, to_a)
        return whole

    for _ in range(rounds):
        whole, moved = gathered(), 0.0
        for s in sorts:
            a, b, pot, to_b, to_a, damp = s
            if not len(a):
                continue
            new = []
            for up, by in ((whole[a] - to_a, pot), (whole[b] - to_b, pot.T)):
                x = np.exp(up - up.max(1, keepdims=True)) @ by
                new.append(np.log(np.maximum(x / x.sum(1, keepdims=True), 1e-300)))
            new = [damp * old + (1 - damp) * x for old, x in zip((to_b, to_a), new)]
            moved = max(moved, *(float(np.abs(old - x).max()) for old, x in zip((to_b, to_a), new)))
            s[3], s[4] = new
        if moved < SETTLED:
            break
    whole = gathered()
    out = np.exp(whole - whole.max(1, keepdims=True, initial=-1e300))
    return out / out.sum(1, keepdims=True)


def skip_potential(penalty: np.ndarray) -> np.ndarray:
    """Log potentials of a skip edge: none where its ends agree, else both labels' penalties."""
    out = -(penalty[:, None] + penalty[None])
    np.fill_diagonal(out, 0)
    return out


# -- fitting -------------------------------------------------------------------------------------------------------


def made_examples() -> list[str]:
    """Texts with entities, each told once and repeated up to eight times without context, beside numbers, words and checksums that repeat as often
    and are none."""
    rng = np.random.default_rng(10)
    alphabet = {"hex": "0123456789abcdef", "any": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"}
    word = lambda n, a: "".join(rng.choice(list(a), n))
    number = lambda n: word(n, "0123456789")
    out = []
    for i in range(MADE):
        plain = lambda: " ".join(word(int(rng.integers(2, 9)), "etaoinshrdlu") for _ in range(int(rng.integers(2, 8))))
        key = word(int(rng.integers(18, 48)), alphabet["hex" if i % 2 else "any"])
        quote, equals = ("\"", "'", "")[i % 3], (" = ", "=", ": ")[i // 3 % 3]
        name, line = f"{word(4, 'etaoin')}.{word(5, 'shrdlu')}", number(7)
        told, again = [
            (f"{NAMES[i % len(NAMES)]}{equals}{quote}{key}{quote}", key), (f"+{rng.integers(1, 99)} {number(2)} {line}", line), (f"{name}@{word(6, 'shrdlu')}.org", name),
            (f"{NAMES[i % len(NAMES)]}{equals}{quote}{key}{quote}", key), (x := f"{PREFIXES[i // 5 % len(PREFIXES)]}{word(24, alphabet['any'])}", x),
        ][i % 5]
        sums, order = word(int(rng.choice([32, 40, 64])), alphabet["hex"]), number(int(rng.integers(7, 17)))
        parts = [told] + [again] * int(rng.integers(0, 9) if i % 4 else 0)
        parts += [f"{('commit', 'sha256', 'id', 'see')[i // 4 % 4]} {sums}"] + [sums] * int(rng.integers(0, 4)) + [order] * int(rng.integers(1, 6)) + [word(22, "etaoinshrdlu"), f"in {rng.integers(1900, 2030)}"]
        out.append(" ".join(f"{plain()} {parts[k]}" for k in rng.permutation(len(parts))))
    return out


def _labels(field: Field, texts: list[str]) -> np.ndarray:
    """Labels of the candidates: base spans, keys by their beginning or assigned to a credential's name, and repeats of any of these."""
    y = np.maximum(field.label, NONE)
    t = field.tokens
    begin = field.begin[field.live]
    cut = np.searchsorted(t.text[field.live], np.arange(len(texts) + 1))
    for i, text in enumerate(texts):
        for m in _ASSIGNED.finditer(text):
            k = cut[i] + bisect_right(begin[cut[i] : cut[i + 1]], m.start(1)) - 1
            if k >= cut[i] and y[k] == NONE and _ANY_DIGIT.search(m[1]):
                y[k] = SECRET
    y[(field.x[:, -1] > 0) & (y == NONE)] = SECRET
    a, b = field.skips
    np.maximum.at(y, a, np.where(y[a] == NONE, y[b], NONE))
    y[b] = np.where(y[b] == NONE, y[a], y[b])
    return y


def fit(texts: list[str]) -> dict:
    """Weights of features, chain potentials and skip penalties from whole texts labelled by :func:`_labels`.

    Each token that no base span fixes is a row: its features, the labels before and after it in the chain, and for each label by how many
    skip neighbours more have it than have not (within two).
    """
    rows, ys = [], []
    every = pa.array([*texts, *made_examples()], pa.string())
    for lo, hi, data, off in tb.runs(every):
        part = [x.as_py() for x in every.slice(lo, hi - lo)]
        f = Field(part, data, off)
        y = _labels(f, part)
        before, after, more = np.zeros(len(y)), np.zeros(len(y)), np.zeros((len(y), LABELS))
        before[f.chain[1]], after[f.chain[0]] = y[f.chain[0]], y[f.chain[1]]
        for a, b in (f.skips, f.skips[::-1]):
            np.add.at(more, a, 2.0 * np.eye(LABELS)[y[b]] - 1)
        free = f.label < 0
        rows.append(np.column_stack([np.round(f.x, 2), before, after, np.clip(more, -2, 2)])[free])
        ys.append(y[free])
    x, back = np.unique(np.concatenate(rows), axis=0, return_inverse=True)
    n = np.zeros((len(x), LABELS))
    np.add.at(n, (back.ravel(), np.concatenate(ys)), 1)
    return _pseudo_fit(x, n)


def _pseudo_fit(rows: np.ndarray, n: np.ndarray, ridge: float = 0.1, rounds: int = 600) -> dict:
    """Accelerated steps on the penalised log loss of counted labels; what belongs to the label none is held at zero, penalties are not negative."""
    x, side, more = rows[:, :N_FEATURES], rows[:, N_FEATURES : N_FEATURES + 2].astype(int), rows[:, N_FEATURES + 2 :]
    total = n.sum(1, keepdims=True)
    weight = np.minimum(total, 50.0) / np.maximum(total, 1)  # a shape that is everywhere does not drown the others
    n, total = n * weight, total * weight
    before, after = np.eye(LABELS)[side[:, 0]], np.eye(LABELS)[side[:, 1]]
    every = np.column_stack([x, before, after, more])
    rate = 1 / (0.5 * np.linalg.norm((every * total).T @ every, 2) + ridge)
    now = [np.zeros((N_FEATURES, LABELS)), np.zeros((LABELS, LABELS)), np.zeros(LABELS)]
    ahead, t = [v.copy() for v in now], 1.0
    for _ in range(rounds):
        w, chain, penalty = ahead
        z = x @ w + before @ chain + after @ chain.T + more * penalty
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        d = total * p - n
        steps = [x.T @ d + ridge * w, before.T @ d + (after.T @ d).T + ridge * chain, (more * d).sum(0) + ridge * penalty]
        new = [v - rate * g for v, g in zip(ahead, steps)]
        new[0][:, NONE] = new[1][:, NONE] = new[1][NONE] = new[2][NONE] = 0
        new[2] = np.maximum(new[2], 0)
        t, last = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        ahead, now = [v + (last - 1) / t * (v - o) for v, o in zip(new, now)], new
    return {"w": now[0], "chain": now[1], "skip": now[2]}


def train(docs: DataFrame) -> dict:
    """Fitted in one task on the whole texts of at most SAMPLE documents of SAMPLE_BYTES together that hold an @ or digit, and on generated texts.

    Of rows repeated under one doc_id the largest text counts; without any such text the generated ones are all.
    """
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).filter("doc_id is not null and text rlike '[@0-9]'")
    sizes = text.groupBy("doc_id").agg(F.max(F.octet_length("text")).alias("size"))
    rows = text.join(F.broadcast(bounded_sample(sizes, SAMPLE, SAMPLE_BYTES)), "doc_id", "left_semi").groupBy("doc_id").agg(F.max("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = [r["text"] for r in sorted((r for b in batches for r in b.to_pylist()), key=lambda r: r["doc_id"])]
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(texts))], pa.binary())], names=["model"])

    got = rows.repartition(1).mapInArrow(run, "model binary").first()
    return pickle.loads(got.model) if got else fit([])


def all_spans(texts: list[str | None], data: np.ndarray, off: np.ndarray, model: dict) -> Iterator[list[tuple[str, int, int, bool]]]:
    """(kind, start, end, base) of each text, by kind and start."""
    f = Field(texts, data, off)
    emit = f.x @ model["w"]
    fixed = f.label >= 0
    emit[fixed] = -30.0
    emit[fixed, f.label[fixed]] = 0.0  # base spans stay
    p = beliefs(COLD * emit, [(*f.chain, COLD * model["chain"]), (*f.skips, COLD * skip_potential(model["skip"]))])
    p[:, NONE] = np.where(fixed, 1.0, p[:, NONE])
    found = np.flatnonzero(p[:, NONE] < 1 - SURE)
    kind = p[found, 1:].argmax(1)
    at = f.live[found]
    of = f.tokens.text[at]
    cut = np.searchsorted(of, np.arange(len(texts) + 1))
    for i in range(len(texts)):
        out = [(KINDS[k], s, e, True) for k, spans in enumerate(f.base[i]) for s, e in spans]
        if cut[i] < cut[i + 1]:
            for j in range(cut[i], cut[i + 1]):
                word, s = f.word(at[j]), int(f.begin[at[j]])
                core = word.strip("._%+@/-")
                s += len(word) - len(word.lstrip("._%+@/-"))
                if core and not any(a < s + len(core) and s < b for spans in f.base[i] for a, b in spans[max(0, bisect_right(spans, (s, s)) - 1) : bisect_right(spans, (s, s)) + 1]):
                    out.append((KINDS[kind[j]], s, s + len(core), False))
            out.sort(key=lambda x: (KINDS.index(x[0]), x[1]))
        yield out


def find_private(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, spans array<struct<kind, start, end, base>>) of every row: by kind (KINDS), then start.

    ``base`` says whether a pattern found the span; the field adds the others. Places are in code points, ends exclusive.
    Null and empty texts have no spans. Repeated rows are treated each; other columns are ignored; no rows give no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind, start, end, base, sizes = [], [], [], [], [0]
            for lo, hi, data, off in tb.runs(batch.column(1)):
                for spans in all_spans(batch.column(1).slice(lo, hi - lo).to_pylist(), data, off, model):
                    for k, s, e, b in spans:
                        kind.append(k)
                        start.append(s)
                        end.append(e)
                        base.append(b)
                    sizes.append(len(kind))
            spans = pa.StructArray.from_arrays([pa.array(kind, pa.string()), pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(base, pa.bool_())], ["kind", "start", "end", "base"])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), spans)], names=["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, spans array<struct<kind: string, start: long, end: long, base: boolean>>")


def op10_pii_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = find_private(docs, train(docs))
    line = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    base = F.filter("spans", lambda x: x["base"])
    counts = [F.expr(f"cast(size(filter(spans, x -> x.base and x.kind = '{k}')) as bigint) as n_{k}") for k in PATTERNS]
    return found.select("doc_id", *counts, F.sha2(line(base).cast("binary"), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"))


QUERIES = {"op10_pii_crf": op10_pii_crf}
