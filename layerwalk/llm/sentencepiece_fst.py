"""Operator 9: SentencePiece encoding and decoding as a weighted finite-state transducer.

The vocabulary file is compiled once a worker into one transducer, the composition of three:

- the normaliser: the identity on characters, blanks become U+2581, with one put before a text;
- the pieces: a tree of states with an arc for each character; where a piece ends, an arc without input goes back to the
  root, writes the piece and weighs minus its score (the tree is determinised, so that one state knows all pieces that end there);
- byte fallback: an arc from the root over a character that is no piece, written as the pieces of its UTF-8 bytes.

It is composed with each text as the search goes along: a composed state is a place in the text and a state of the
pieces. The encoding is the path of least weight in the tropical semiring (minimum, plus). In a model of type unigram that is all. In
one of type BPE the root also remembers the last piece, and a piece whose text the model would have merged otherwise
across the border to the last one weighs infinity (:meth:`Transducer.clash`: the ranks of both pieces' own merges are followed
down). Of the paths to a place in the text one is finite, so a place needs to keep one last piece only.

No piece holds a blank after another character, so no finite path leaves a word for the next within a piece. Texts are
composed word by word; the distinct words of a run of texts take their paths together, place by place in arrays.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import textbuf as tb
from .common import released, table

BLANK = "▁"
#: Paths kept by a worker, at most.
KEPT_WORDS, KEPT_PAIRS = 1 << 19, 1 << 20
#: Bytes of text in a run whose distinct words take their paths together.
RUN_BYTES = 1 << 21
#: Code points of a word that is searched along with others, at most, and places of such words held at once.
LONGEST, HELD = 1 << 12, 1 << 20
_NOT_BLANK = np.arange(256) != 32
INFINITY = float("inf")
#: Weight of a byte fallback arc.
FALLBACK = 1e4


def _fields(raw: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of the fields of a protocol buffer message."""
    i = 0

    def varint() -> int:
        nonlocal i
        out = shift = 0
        while True:
            b = raw[i]
            i += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while i < len(raw):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind == 2:
            n = varint()
            yield tag >> 3, raw[i : i + n]
            i += n
        else:
            n = 8 if kind == 1 else 4
            yield tag >> 3, raw[i : i + n]
            i += n


class Table:
    """Numbers by non-negative keys, found for many keys at once: open addressing, at most half full."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.used, self.keys, self.values = 0, np.full(1 << 10, -1, np.int64), np.zeros(1 << 10, np.int32)
        self.add(keys, values)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (tb.mix(keys.view(np.uint64)) & np.uint64(len(self.keys) - 1)).astype(np.int64)

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """New distinct keys."""
        if 2 * (self.used + len(keys)) > len(self.keys):
            old = self.keys >= 0
            keys, values = np.append(self.keys[old], keys), np.append(self.values[old], values)
            size = 1 << (4 * len(keys)).bit_length()
            self.used, self.keys, self.values = 0, np.full(size, -1, np.int64), np.zeros(size, np.int32)
        self.used += len(keys)
        slot = self._slots(keys)
        while len(keys):
            free = self.keys[slot] < 0
            self.keys[slot[free]] = keys[free]  # of several keys at one slot the last stays
            done = self.keys[slot] == keys
            self.values[slot[done]] = values[done]
            keys, values, slot = keys[~done], values[~done], (slot[~done] + 1) & (len(self.keys) - 1)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Value of each key, or -1."""
        slot = self._slots(keys)
        at = self.keys[slot]
        out = np.where(at == keys, self.values[slot], -1)
        todo = np.flatnonzero((at != keys) & (at >= 0))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & (len(self.keys) - 1)
            at = self.keys[slot[todo]]
            hit = at == keys[todo]
            out[todo[hit]] = self.values[slot[todo[hit]]]
            todo = todo[~hit & (at >= 0)]
        return out


class Transducer:
    """The compiled vocabulary of a SentencePiece model file (type unigram or BPE, identity normaliser)."""

    def __init__(self, raw: bytes):
        self.pieces: list[str] = []
        self.scores: list[float] = []
        kinds: list[int] = []
        self.bpe, self.prefix, self.squeeze, self.escape = False, True, True, True
        chars = b""
        for number, value in _fields(raw):
            if number == 1:
                piece = {1: b"", 2: b"\0\0\0\0", 3: 1} | dict(_fields(value))
                self.pieces.append(piece[1].decode())
                self.scores.append(struct.unpack("<f", piece[2])[0])
                kinds.append(piece[3])
            elif number == 2:
                self.bpe = dict(_fields(value)).get(3, 1) == 2
            elif number == 3:
                spec = dict(_fields(value))
                chars = spec.get(2, b"")
                self.prefix, self.squeeze, self.escape = (bool(spec.get(k, 1)) for k in (3, 4, 5))
        if chars or not self.escape:
            raise ValueError("only the identity normaliser with escaped blanks is compiled")
        self.unknown = kinds.index(2)
        self.bytes = [-1] * 256
        for i, (p, k) in enumerate(zip(self.pieces, kinds, strict=True)):
            if k == 6:
                self.bytes[int(p[3:5], 16)] = i
        self.byte_of = {i: b for b, i in enumerate(self.bytes) if i >= 0}
        self.control = {i for i, k in enumerate(kinds) if k == 3}
        self.id = {p: i for i, (p, k) in enumerate(zip(self.pieces, kinds, strict=True)) if k in (1, 4)}
        #: Of a BPE model, the two pieces whose merge makes a piece; a single character is its own.
        self.halves: dict[int, tuple[int, int]] = {}
        if self.bpe:  # a piece that merging cannot make is on no path
            made = {}
            for p, i in self.id.items():
                parts, halves = self._merged(p)
                if parts == [p]:
                    made[p] = i
                    self.halves[i] = halves or (i, i)
            if not all(c in made for p in made for c in p):
                raise ValueError("every character of a BPE model's pieces must be a piece")
            self.id = made
        self._order()
        self._compile()
        across = any(BLANK in p.lstrip(BLANK) for p in self.id)
        #: A word is a run of blanks with what follows up to the next blank; without that property, the whole text.
        self.word = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+") if not across else re.compile("(?s).+")
        #: Whether a run of texts can be cut into words by its bytes alone.
        self.by_words = not across and self.prefix and not self.squeeze
        self._outputs = None
        self.words: dict[str, tuple[int, ...]] = {}
        self.pairs: dict[int, float] = {}

    # -- the normaliser -----------------------------------------------------------------------------------------

    def normalise(self, text: str) -> str:
        if self.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
        if not text:
            return ""
        return (BLANK if self.prefix else "") + text.replace(" ", BLANK)

    # -- the pieces ---------------------------------------------------------------------------------------------

    def _compile(self) -> None:
        """States of the determinised piece tree, as [next state by character, state to go on from, arcs].

        A state is the longest end of the text so far that begins a piece; where it has no arc for a character, the
        search goes on from its own longest such end. Its arcs are the pieces that end here, the longest first: (length, piece, weight).
        """
        self.root: list = [{}, None, ()]
        queue: list[tuple[list, list, str]] = []
        for p, i in self.id.items():
            state = self.root
            for c in p:
                state = state[0].setdefault(c, [{}, self.root, ()])
            state[2] = ((len(p), i, -self.scores[i]),)
        queue = [self.root]
        for state in queue:  # by length
            for c, after in state[0].items():
                on = state[1]
                while on is not None and c not in on[0]:
                    on = on[1]
                if on is not None:
                    after[1] = on[0][c]
                    after[2] += after[1][2]
                queue.append(after)

    def _order(self) -> None:
        """Whether every piece comes after its halves, as in a trained model."""
        self.ordered = all(len(self.pieces[h]) == 1 or self.scores[h] >= self.scores[i] for i, both in self.halves.items() for h in both if h != i)

    def _merged(self, text: str) -> tuple[list[str], tuple[int, int] | None]:
        """``text`` merged pair by pair, the best score first and the leftmost of equals, and the two sides of the last merge."""
        parts, halves = list(text), None
        ids, scores = self.id, self.scores
        while len(parts) > 1:
            best, at = -INFINITY, -1
            for i in range(len(parts) - 1):
                k = ids.get(parts[i] + parts[i + 1])
                if k is not None and scores[k] > best:
                    best, at = scores[k], i
            if at < 0:
                break
            halves = (ids.get(parts[at], -1), ids.get(parts[at + 1], -1))
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts, halves

    def clash(self, a: int, b: int) -> float:
        """Weight that the memory of last piece ``a`` adds to piece ``b``: 0, or infinity if the model merges across their border.

        The pieces at the border are undone from the outside, the latest merge of both first. If the two that meet there
        have a merge that comes before all merges undone so far, the model would have taken it. Of equal scores the
        leftmost merge comes first: one inside ``a`` before the border, one inside ``b`` after it. That holds where no piece comes
        before its halves; for a model where one does, both pieces are merged again.
        """
        pieces, scores, halves, ids = self.pieces, self.scores, self.halves, self.id
        if not self.ordered:
            return 0.0 if self._merged(pieces[a] + pieces[b])[0] == [pieces[a], pieces[b]] else INFINITY
        # the next merge across the border counts if it precedes the earliest merge undone on either side
        before_a = before_b = -INFINITY
        while True:
            k = ids.get(pieces[a] + pieces[b])
            if k is not None and scores[k] > before_a and scores[k] >= before_b:
                return INFINITY
            left, right = halves[a], halves[b]
            whole_a, whole_b = left[0] == a, right[0] == b
            if whole_a and whole_b:
                return 0.0
            if not whole_a and (whole_b or scores[a] < scores[b]):
                before_a, a = max(before_a, scores[a]), left[1]
            else:
                before_b, b = max(before_b, scores[b]), right[0]

    # -- composition and shortest path --------------------------------------------------------------------------

    def _path(self, word: str) -> list[int]:
        """Outputs of the shortest path through the composition with ``word``: piece ids, or ~code point where no piece fits."""
        root, bpe, pairs, clash = self.root, self.bpe, self.pairs, self.clash
        if len(pairs) >= KEPT_PAIRS:
            pairs.clear()
        cost, last, came = [0.0], [-1], [0]
        state, at = root, 0
        for c in word:
            after = state[0].get(c)
            while after is None and state is not root:
                state = state[1]
                after = state[0].get(c)
            least, piece, begin = INFINITY, -1, at
            if after is not None:
                state = after
                for size, k, weight in after[2]:
                    start = at + 1 - size
                    weight += cost[start]
                    if weight < least:
                        before = last[start]
                        if bpe and before >= 0:
                            both = before << 32 | k
                            more = pairs.get(both)
                            if more is None:
                                more = pairs[both] = clash(before, k)
                            if more:
                                continue
                        least, piece, begin = weight, k, start
                        if bpe:  # the other paths to this place weigh infinity
                            break
            if c not in self.id and cost[at] + FALLBACK < least:
                least, piece, begin = cost[at] + FALLBACK, ~ord(c), at
            at += 1
            cost.append(least)
            last.append(piece)
            came.append(begin)
        out = []
        while at:
            out.append(last[at])
            at = came[at]
        return out[::-1]

    def _ids(self, word: str) -> tuple[int, ...]:
        path = self._path(word)
        if min(path) >= 0:
            return tuple(path)
        out: list[int] = []
        for k in path:
            if k >= 0:
                out.append(k)
            elif self.bytes[0] >= 0:
                out += [self.bytes[b] for b in chr(~k).encode("utf-8", "surrogatepass")]
            else:
                out.append(self.unknown)
        return tuple(out)

    def _word_ids(self, w: str, words: dict[str, tuple[int, ...]]) -> tuple[int, ...]:
        got = words.get(w)
        if got is None:
            got = self._ids(w)
            if len(w) <= 64:
                if len(words) >= KEPT_WORDS:
                    words.clear()
                words[w] = got
        return got

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        for w in self.word.findall(self.normalise(text or "")):
            out += self._word_ids(w, self.words)
        return out

    def _arrays(self) -> None:
        """The states of :meth:`_compile` by number in arrays, and the arcs over characters in a hash table."""
        number, states = {id(self.root): 0}, [self.root]
        keys, after = [], []
        for i, state in enumerate(states):
            for c, to in state[0].items():
                number[id(to)] = len(states)
                states.append(to)
                keys.append(i << 21 | ord(c))
                after.append(number[id(to)])
        n = len(states)
        self.on = np.array([number[id(x[1])] if x[1] is not None else 0 for x in states], np.int32)
        own = np.zeros(n, np.int32)  # length of the piece that a state is, or 0
        depth = np.zeros(n, np.int32)
        for (i, _), j in zip((divmod(k, 1 << 21) for k in keys), after, strict=True):
            depth[j] = depth[i] + 1
        self.piece, self.weight = np.full(n, -1, np.int64), np.full(n, INFINITY)
        for i, x in enumerate(states):
            if x[2] and x[2][0][0] == depth[i]:
                own[i], self.piece[i], self.weight[i] = x[2][0]
        self.size = own
        #: The longest state that is a piece and ends the text where a state does, and the next shorter one.
        self.ends, self.shorter = np.where(own > 0, np.arange(n), -1), np.full(n, -1)
        for i in range(1, n):  # by length
            self.shorter[i] = self.ends[self.on[i]]
            if self.ends[i] < 0:
                self.ends[i] = self.shorter[i]
        self.arcs = Table(np.array(keys, np.int64), np.array(after, np.int32))
        self.memory = Table(np.zeros(0, np.int64), np.zeros(0, np.int32))

    def _clashes(self, before: np.ndarray, k: np.ndarray) -> np.ndarray:
        """:meth:`clash` of many pairs, from a table of bounded size."""
        key = before.astype(np.int64) << 32 | k
        got = self.memory.find(key)
        new = np.unique(key[got < 0])
        if len(new):
            if self.memory.used + len(new) > KEPT_PAIRS:
                self.memory = Table(np.zeros(0, np.int64), np.zeros(0, np.int32))
            self.memory.add(new, np.array([self.clash(x >> 32, x & 0xFFFFFFFF) > 0 for x in new.tolist()], np.int32))
            got[got < 0] = self.memory.find(key[got < 0])
        return got > 0

    def _paths(self, codes: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """:meth:`_path` of many words, given by code points and offsets and sorted from the longest on: pieces, and number of each word's."""
        long = np.diff(off)
        n, wide = len(long), int(long[0]) + 1
        cost, last, came = np.full((n, wide), INFINITY), np.full((n, wide), -1), np.zeros((n, wide), np.int32)
        cost[:, 0] = 0.0
        state = np.zeros(n, np.int64)
        for j in range(wide - 1):
            m = int(np.searchsorted(-long, -j))  # words that are longer than j
            c = codes[off[:m] + j].astype(np.int64)
            now, after, todo = state[:m].copy(), np.full(m, -1), np.arange(m)
            while len(todo):
                got = self.arcs.find(now[todo] << 21 | c[todo])
                after[todo] = got
                todo = todo[(got < 0) & (now[todo] > 0)]
                now[todo] = self.on[now[todo]]
            state[:m] = np.maximum(after, 0)
            arc = np.where(after >= 0, self.ends[state[:m]], -1)
            least, piece, begin = np.full(m, INFINITY), np.full(m, -1), np.zeros(m, np.int64)
            todo = np.flatnonzero(arc >= 0)
            while len(todo):
                e = arc[todo]
                k, start = self.piece[e], j + 1 - self.size[e]
                w, before = cost[todo, start] + self.weight[e], last[todo, start]
                better = w < least[todo]
                if self.bpe:
                    ask = np.flatnonzero(better & (before >= 0))
                    better[ask[self._clashes(before[ask], k[ask])]] = False
                to = todo[better]
                least[to], piece[to], begin[to] = w[better], k[better], start[better]
                arc[todo] = self.shorter[e]
                todo = todo[(arc[todo] >= 0) & ~(better & self.bpe)]  # of a BPE model the other paths to this place weigh infinity
            one = self.arcs.find(c)
            alone = np.flatnonzero(((one < 0) | (self.piece[one] < 0)) & (cost[:m, j] + FALLBACK < least))
            least[alone], piece[alone], begin[alone] = cost[alone, j] + FALLBACK, ~c[alone], j
            cost[:m, j + 1], last[:m, j + 1], came[:m, j + 1] = least, piece, begin
        at, rows, steps = long.copy(), np.arange(n), []
        while len(rows):
            steps.append((rows, last[rows, at[rows]]))
            at[rows] = came[rows, at[rows]]
            rows = rows[at[rows] > 0]
        per = np.bincount(np.concatenate([r for r, _ in steps]), minlength=n)
        ends = np.cumsum(per)
        out = np.zeros(int(ends[-1]), np.int64)
        for k, (r, x) in enumerate(steps):
            out[ends[r] - 1 - k] = x
        return out, per

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of all texts in one array, and the offsets of each text: every distinct word of a run takes its path once."""
        out, sizes = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for lo, hi, data, off in tb.runs(texts, RUN_BYTES):
            odd = self._odd(data, off)
            if not odd.any():
                ids, n = self._run(data, off)
            else:
                part, flag = texts.slice(lo, hi - lo), pa.array(odd)
                (a, na), (b, nb) = self._each(part.filter(flag).to_pylist()), self._run(*tb.buffers(part.filter(pa.array(~odd))))
                n = np.zeros(hi - lo, np.int64)
                n[odd], n[~odd] = na, nb
                begin = np.zeros(hi - lo, np.int64)
                begin[odd], begin[~odd] = np.cumsum(na) - na, len(a) + np.cumsum(nb) - nb
                ids = np.append(a, b)[np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
            out.append(ids)
            sizes.append(n)
        return np.concatenate(out), np.append(0, np.cumsum(np.concatenate(sizes)))

    def _odd(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Texts that cannot be cut into words by their blanks alone: those that hold the normaliser's own blank, or all."""
        odd = np.full(len(off) - 1, not self.by_words)
        if self.by_words and len(data) > 2:
            a, b, c = BLANK.encode()
            odd[np.searchsorted(off, np.flatnonzero((data[:-2] == a) & (data[1:-1] == b) & (data[2:] == c)), "right") - 1] = True
        return odd

    def _each(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        ids = [self.encode(t) for t in texts]
        return np.array([i for x in ids for i in x], np.int32), np.array([len(x) for x in ids], np.int64)

    def _run(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        start, end, text = tb.words(data, off, _NOT_BLANK)
        n = len(off) - 1
        # blanks before each word; the normaliser puts one before a text. Blanks at the end of a text are a word of their own
        first = np.ones(len(start), bool)
        first[1:] = text[1:] != text[:-1]
        before = np.where(first, off[text] - 1, np.append(0, end[:-1]))
        last_end = off[:-1] - 1  # of a text without words
        last_end = last_end.copy()
        last_end[text] = end
        tail = np.flatnonzero((off[1:] > off[:-1]) & (off[1:] > np.maximum(last_end, off[:-1])))
        start, end, text = np.append(start, off[tail + 1]), np.append(end, off[tail + 1]), np.append(text, tail)
        blanks = start - np.append(before, last_end[tail])
        order = np.argsort(text, kind="stable")
        start, end, text, blanks = start[order], end[order], text[order], blanks[order]
        key = tb.mix(tb.span_hashes(data, start, end, tb.EXACT) + blanks.astype(np.uint64))
        _, one, which = np.unique(key, return_index=True, return_inverse=True)
        flat, size = self._distinct(data, start[one], end[one], blanks[one])
        per = size[which]
        at = np.repeat((np.cumsum(size) - size)[which] - (np.cumsum(per) - per), per) + np.arange(int(per.sum()))
        return flat[at], np.bincount(text, per, n).astype(np.int64)

    def _distinct(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, blanks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of words (spans of bytes after so many blanks), and the number of each word's."""
        if self._outputs is None:
            self._outputs = self._output_table()
            self._arrays()
        n = end - start
        at = np.append(0, np.cumsum(n))
        raw = data[np.repeat(start - at[:-1], n) + np.arange(int(at[-1]))]
        chars = np.append(0, np.cumsum((raw & 0xC0) != 0x80))[at]
        chars = np.diff(chars)
        long = chars + blanks
        codes = np.full(int(long.sum()), ord(BLANK), np.uint32)
        off = np.append(0, np.cumsum(long))
        first = np.append(0, np.cumsum(chars))
        codes[np.repeat(off[:-1] + blanks - first[:-1], chars) + np.arange(int(first[-1]))] = np.frombuffer(raw.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
        order = np.argsort(-long, kind="stable")
        size = np.zeros(len(long), np.int64)
        flat = []
        lo = 0
        while lo < len(order):
            top = int(long[order[lo]])
            if top > LONGEST:  # one word takes its path by itself
                w = order[lo : lo + 1]
                ids = np.array(self._ids("".join(map(chr, codes[off[w[0]] : off[w[0] + 1]].tolist()))), np.int64)
                per = np.array([len(ids)])
            else:  # words of half to all of a length together
                hi = int(np.searchsorted(-long[order], -(top // 2), "left")) if top > 16 else len(order)
                w = order[lo : max(hi, lo + 1)][: max(1, HELD // top)]
                own = np.append(0, np.cumsum(long[w]))
                ids, per = self._paths(codes[np.repeat(off[w] - own[:-1], long[w]) + np.arange(int(own[-1]))], own)
                if len(ids) and ids.min() < 0:
                    ids, per = self._with_bytes(ids, per)
            lo += len(w)
            size[w] = per
            flat.append(ids)
        # from the order by length back to the order of the words
        flat = np.concatenate(flat) if flat else np.zeros(0, np.int64)
        begin = np.zeros(len(long), np.int64)
        begin[order] = np.cumsum(size[order]) - size[order]
        ends = np.append(0, np.cumsum(size))
        return flat[np.repeat(begin - ends[:-1], size) + np.arange(int(ends[-1]))].astype(np.int32), size

    def _with_bytes(self, ids: np.ndarray, per: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte fallback arcs of paths written out."""
        of = np.repeat(np.arange(len(per)), per)
        put = [[self.unknown] if self.bytes[0] < 0 else [self.bytes[b] for b in chr(~k).encode("utf-8", "surrogatepass")] for k in ids[ids < 0].tolist()]
        n = np.ones(len(ids), np.int64)
        n[ids < 0] = list(map(len, put))
        out = np.repeat(ids, n)
        out[out < 0] = [i for x in put for i in x]
        return out, np.bincount(np.repeat(of, n), minlength=len(per))

    # -- decoding: the inverse transducer ------------------------------------------------------------------------

    def _output_table(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bytes that each piece decodes to: all of them, and place and number of each piece's."""
        made = [b"" if i in self.control else (" \u2047 " if i == self.unknown else p.replace(BLANK, " ")).encode("utf-8", "surrogatepass") for i, p in enumerate(self.pieces)]
        for i, b in self.byte_of.items():
            made[i] = bytes([b])
        size = np.fromiter(map(len, made), np.int64, len(made))
        return np.frombuffer(b"".join(made), np.uint8), np.cumsum(size) - size, size

    def decode_all(self, ids: np.ndarray, off: np.ndarray) -> pa.Array:
        """Texts of runs of pieces that :meth:`encode_all` made."""
        if self._outputs is None:
            self._outputs = self._output_table()
            self._arrays()
        flat, begin, size = self._outputs
        per = size[ids]
        ends = np.append(0, np.cumsum(per))
        data = flat[np.repeat(begin[ids] - ends[:-1], per) + np.arange(int(ends[-1]))]
        at = ends[off]
        if self.prefix:  # the blank before a text goes
            some = np.flatnonzero(at[1:] > at[:-1])
            lead = some[data[at[some]] == 32]
            keep = np.ones(len(data), bool)
            keep[at[lead]] = False
            data = data[keep]
            gone = np.zeros(len(off), np.int64)
            gone[lead + 1] = 1
            at = at - np.cumsum(gone)
        return pa.Array.from_buffers(pa.large_string(), len(off) - 1, [None, pa.py_buffer(at.astype(np.int64).tobytes()), pa.py_buffer(data.tobytes())])

    def decode(self, ids: list[int]) -> str:
        out: list[str] = []
        run = bytearray()
        for i in ids:
            if i in self.byte_of:
                run.append(self.byte_of[i])
                continue
            if run:
                out.append(run.decode("utf-8", "replace"))
                run = bytearray()
            if i == self.unknown:
                out.append(" ⁇ ")
            elif i not in self.control:
                out.append(self.pieces[i])
        if run:
            out.append(run.decode("utf-8", "replace"))
        text = "".join(out).replace(BLANK, " ")
        return text[1:] if self.prefix and text.startswith(" ") else text


@lru_cache(maxsize=2)
def compiled(raw: bytes) -> Transducer:
    return Transducer(raw)


def default_model() -> str:
    """Place of the installed public vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _read(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode_texts(docs: DataFrame, model: str | None = None) -> DataFrame:
    """``docs`` with piece_ids array<int> and decoded string added, for every row.

    ``model`` is the vocabulary file, read by the driver (half a MB, sent with the tasks). Null and empty texts have no
    pieces and decode to the empty string. ``decoded`` is decoded from the ids; it equals the text unless the text
    holds U+2581, which reads as a blank. Columns of these two names are replaced, others pass through.
    """
    raw = _read(model or default_model())
    docs = docs.drop("piece_ids", "decoded")
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fst = compiled(raw)
        for batch in batches:
            for lo, hi, _, _ in tb.runs(batch.column(at), RUN_BYTES):
                part = batch.slice(lo, hi - lo)
                ids, off = fst.encode_all(part.column(at))
                back = fst.decode_all(ids, off).cast(pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(ids)), back], names=[*part.schema.names, "piece_ids", "decoded"])

    from pyspark.sql import types as T

    schema = T.StructType([*docs.schema.fields, T.StructField("piece_ids", T.ArrayType(T.IntegerType(), False)), T.StructField("decoded", T.StringType())])
    return docs.mapInArrow(released(run), schema)


def digest(docs: DataFrame, model: str | None = None) -> DataFrame:
    """(doc_id, n_pieces, ids_sha256, decoded_sha256, n_decoded, round_trip) of each row; see :func:`encode_texts`.

    ids_sha256 is over the ids joined by commas; round_trip says whether decoding gives back the text (null: empty).
    """
    from pyspark.sql import functions as F

    text = F.coalesce("text", F.lit(""))
    return encode_texts(docs.select("doc_id", "text"), model).select(
        "doc_id", F.size("piece_ids").cast("long").alias("n_pieces"), F.sha2(F.array_join(F.col("piece_ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"), F.length("decoded").cast("long").alias("n_decoded"), (F.col("decoded") == text).alias("round_trip"),
    )


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(table(spark, sf_dir, "documents"))


QUERIES = {"op9_sentencepiece": op9_sentencepiece}
