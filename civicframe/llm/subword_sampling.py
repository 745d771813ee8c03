"""SentencePiece encoding and decoding: distinct sampled segmentations by Gumbel top-k.

A text's lattice of pieces is a chain of small lattices, one for each stretch that no piece of the
vocabulary crosses (words with their leading spaces, runs of other characters). Exact backward
weights of each stretch give every edge its conditional probability, so a whole segmentation is drawn
by walking edges. Sampling without replacement is a best-first search over sets of segmentations: a
set's key is the largest Gumbel-perturbed log-probability within it. Popping a set draws its best
member, and the rest of the set is split by the first edge that differs; each part gets a Gumbel of
its own mass, truncated at its parent's. Masses are kept as logarithms, that of what leaves a path as
the sum of the other edges, so no set is too small to be drawn: the first k members popped are k
segmentations without replacement, in order; the next key is the threshold of their inclusion
probabilities. Parts far down a text are kept together and split only when they are popped.

All randomness is a hash of (seed, row key, draw, stretch, step). The vocabulary is a SentencePiece
model file, read on the driver and broadcast; a piece of merge rank r weighs (r + 2.7) ** -alpha and
characters without a piece fall back to bytes. Spaces are kept as they are; decoding gives the text back.

Null and empty texts have the one empty segmentation, with log-probability 0 and inclusion 1. A text
with fewer than k segmentations has all of them, with inclusion 1. Null keys count as one key.
Repeated rows with equal keys and texts get equal samples; of samples with equal values the one drawn
first is first. Texts of any length are read whole. An empty table gives an empty table. Other columns
stay; a new column whose name is taken gets a _ behind its name.
"""

from __future__ import annotations

import heapq
import math
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from civicframe.llm.common import free_name, table
from civicframe.llm.shingles import by_bytes

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SAMPLES, ALPHA, SEED = 2, 1.0, 3
#: Splits of a set that are made at once; what lies further down is one set until it is popped.
NEAR = 48
#: Bytes of lattices that a worker keeps, and of texts that it takes at once.
KEPT, AT_ONCE = 64 << 20, 1 << 18
#: Bytes of an edge, a node and a stretch (with its text and places in dictionaries), about.
EDGE, NODE, STRETCH = 24, 8, 220
FINE, COARSE = r" *(?:[^\W\d_²]+|(?:[\d_²]|[^\w ])+)| +", r" *[^ ]+| +"
SAMPLED = "array<struct<ids: array<int>, log_prob: double, inclusion: double>>"
BUCKET_BITS = 17
_STEP, _ALL = np.uint64(0x2545F4914F6CDD1D), (1 << 64) - 1
_M1, _M2, _M3, _M4 = (np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93))


def load_vocabulary(path: str = MODEL, alpha: float = ALPHA) -> dict:
    """Pieces by id (spaces for the mark) and, by the hashes of pieces and their beginnings, ids (-1: only a beginning) and logarithms of weights."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = model.get_piece_size()
    pieces = [model.id_to_piece(i) for i in range(size)]
    plain = [p.replace("▁", " ") for p in pieces]
    table_of: dict = {}
    first_byte = next((i for i in range(size) if model.is_byte(i)), None)
    for i, p in enumerate(plain):
        if not p or model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            continue
        score = model.get_score(i)
        rank = -score if -1e8 < score <= 0 else size
        table_of[p] = (i, -alpha * math.log(rank + 2.7))
    for p in list(table_of):
        for n in range(1, len(p)):
            table_of.setdefault(p[:n], (-1, 0.0))
    hashes, ids, weights = [], [], []
    for p, (i, w) in table_of.items():
        h = 0
        for c in p:
            h = (h * int(_STEP) + ord(c) + 1) % (1 << 64)
        hashes.append(h * int(_M3) % (1 << 64))
        ids.append(i)
        weights.append(w)
    order = np.argsort(np.array(hashes, np.uint64))
    if len(set(hashes)) < len(hashes):
        raise ValueError("two strings of the vocabulary have one hash")
    fine = re.compile(FINE)
    whole = all(fine.fullmatch(p) for p, (i, _) in table_of.items() if i >= 0)
    raw = [bytes([i - first_byte]) if first_byte is not None and first_byte <= i < first_byte + 256 else p.encode("utf-8") for i, p in enumerate(plain)]
    buckets = np.searchsorted(np.array(hashes, np.uint64)[order] >> np.uint64(64 - BUCKET_BITS), np.arange((1 << BUCKET_BITS) + 1, dtype=np.uint64))
    decoding = {"bytes": np.frombuffer(b"".join(raw), np.uint8), "byte_start": np.cumsum([0] + [len(r) for r in raw]), "buckets": buckets.astype(np.int64), "crowd": int(np.diff(buckets).max())}
    arrays = decoding | {"hashes": np.array(hashes, np.uint64)[order], "ids": np.array(ids, np.int64)[order], "weights": np.array(weights)[order]}
    return arrays | {"plain": plain, "first_byte": first_byte, "pattern": FINE if whole else COARSE, "longest": max(map(len, table_of), default=1), "size": size, "byte_weight": -alpha * math.log(size + 2.7)}


def mixed_bits(h: np.ndarray, n) -> np.ndarray:
    """A hash of 64-bit numbers h and n."""
    with np.errstate(over="ignore"):
        h = (h + np.asarray(n).astype(np.uint64) * _M3) ^ _M4
        h = (h ^ (h >> np.uint64(30))) * _M1
        h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


def mixed_number(h: int, n: int) -> int:
    """mixed_bits of one number."""
    h = ((h + n * 0x9E3779B97F4A7C15) & _ALL) ^ 0xD6E8FEB86659FD93
    h = ((h ^ (h >> 30)) * 0xBF58476D1CE4E5B9) & _ALL
    h = ((h ^ (h >> 27)) * 0x94D049BB133111EB) & _ALL
    return h ^ (h >> 31)


def uniform_number(h: int) -> float:
    """uniform of one number."""
    return ((h >> 11) + 0.5) * 2.0**-53


def uniform(h: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) from hashes, the same everywhere."""
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


class Lattices:
    """Edges of stretches' lattices in flat arrays: node -> first edge, edge -> (share up to it, end, piece, log share, log share of the node's other edges).

    All lattices of a batch are built together: pieces are looked up by rolling hashes, one length at
    a time and only where some piece goes on, and backward weights go from the ends inwards.
    """

    def __init__(self, vocabulary: dict, room: int = 1 << 12):
        self.v = vocabulary
        self.chunks, self.nodes, self.edges = 0, 0, 0
        self.chunk_node, self.chunk_len = np.zeros(room, np.int64), np.zeros(room, np.int32)
        self.first = np.zeros(room * 8, np.int64)
        self.upto, self.log, self.other = np.zeros(room * 16), np.zeros(room * 16, np.float32), np.zeros(room * 16, np.float32)
        self.end, self.piece = np.zeros(room * 16, np.int32), np.zeros(room * 16, np.int32)

    def size(self) -> int:
        """Bytes, about."""
        return self.edges * EDGE + self.nodes * NODE + self.chunks * STRETCH

    @staticmethod
    def _put(a: np.ndarray, at: int, values: np.ndarray) -> np.ndarray:
        if at + len(values) > len(a):
            grown = np.zeros(max(at + len(values), len(a) * 3 // 2), a.dtype)
            grown[:at] = a[:at]
            a = grown
        a[at : at + len(values)] = values
        return a

    def add_all(self, chunks: list[str]) -> None:
        """Lattices of new stretches, with the next numbers."""
        for at in range(0, len(chunks), 20_000):
            self._add(chunks[at : at + 20_000])

    def _add(self, chunks: list[str]) -> None:
        v = self.v
        size = np.fromiter(map(len, chunks), np.int64, len(chunks))
        codes = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        total = len(codes)
        stop = np.repeat(np.cumsum(size), size)  # where each character's stretch ends
        starts, ends, ids, weights = [], [], [], []
        at, h = np.arange(total), np.zeros(total, np.uint64)
        single = np.zeros(total, bool)
        for n in range(1, v["longest"] + 1):
            h = h * _STEP + codes[at + n - 1] + np.uint64(1)
            known, slot = self._find(h)
            at, h = at[known], h[known]
            found = v["ids"][slot] >= 0
            starts.append(at[found])
            ends.append(at[found] + n)
            ids.append(v["ids"][slot[found]])
            weights.append(v["weights"][slot[found]])
            if n == 1:
                single[at[found]] = True
            inside = at + n < stop[at]
            at, h = at[inside], h[inside]
            if not len(at):
                break
        bare = np.flatnonzero(~single)  # characters without a piece: their bytes
        if len(bare):
            c = codes[bare].astype(np.int64)
            n_bytes = 1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF)
            starts.append(bare)
            ends.append(bare + 1)
            ids.append(np.where(n_bytes == 1, v["first_byte"] + c, v["size"] + c))
            weights.append(v["byte_weight"] * n_bytes)
        # edges by node, longer pieces first
        start, end = np.concatenate(starts[::-1]), np.concatenate(ends[::-1])
        order = np.argsort(start, kind="stable")
        start, end = start[order], end[order]
        piece, weight = np.concatenate(ids[::-1])[order], np.concatenate(weights[::-1])[order]
        first = np.searchsorted(start, np.arange(total + 1))
        value, back = self._backward(start, end, weight, first, stop, size)
        log, other, upto = self._shares(value - back[start], first[:-1], np.diff(first))
        upto[first[1:] - 1] = 2.0
        begin = stop - np.repeat(size, size)
        c0, n0, e0 = self.chunks, self.nodes, self.edges
        # node i of a stretch is n0 + its start + i; the edges of all nodes follow each other
        self.chunk_node = self._put(self.chunk_node, c0, n0 + np.cumsum(size) - size)
        self.chunk_len = self._put(self.chunk_len, c0, size)
        self.first = self._put(self.first, n0, e0 + first)
        self.upto, self.piece = self._put(self.upto, e0, upto), self._put(self.piece, e0, piece)
        self.log, self.other = self._put(self.log, e0, log), self._put(self.other, e0, other)
        self.end = self._put(self.end, e0, end - begin[start])
        self.chunks, self.nodes, self.edges = c0 + len(chunks), n0 + total, e0 + len(start)

    def _find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which hashes are of the vocabulary, and the places of those: the leading bits lead to a few to compare."""
        h = h * _M3  # spreads the leading bits
        known, bucket = self.v["hashes"], (h >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
        first, last = self.v["buckets"][bucket], self.v["buckets"][bucket + 1]
        slot = np.full(len(h), -1)
        for i in range(self.v["crowd"]):
            open_ = np.flatnonzero((first + i < last) & (slot < 0))
            if not len(open_):
                break
            hit = open_[known[first[open_] + i] == h[open_]]
            slot[hit] = first[hit] + i
        found = np.flatnonzero(slot >= 0)
        return found, slot[found]

    def _backward(self, start, end, weight, first, stop, size) -> tuple[np.ndarray, np.ndarray]:
        """Logarithms: of each edge's weight times that of all ways from its end on, and of a node's sum of these."""
        total = len(stop)
        back, value = np.zeros(total + 1), np.zeros(len(start))
        left = stop - np.arange(total)  # characters from the node to the end of its stretch
        longest = int(size.max())
        by_left = np.argsort(left, kind="stable")
        bounds = np.searchsorted(left[by_left], np.arange(1, longest + 2))
        for n in range(longest):
            nodes = by_left[bounds[n] : bounds[n + 1]]
            counts = first[nodes + 1] - first[nodes]
            begins = np.cumsum(counts) - counts
            edge = np.repeat(first[nodes] - begins, counts) + np.arange(int(counts.sum()))
            to = end[edge]
            x = weight[edge] + np.where(to == stop[start[edge]], 0.0, back[to])
            value[edge] = x
            top = np.maximum.reduceat(x, begins)
            back[nodes] = top + np.log(np.add.reduceat(np.exp(x - np.repeat(top, counts)), begins))
        return value, back

    @staticmethod
    def _shares(x: np.ndarray, first: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(log share, log share of the node's other edges, share up to here) of edges with log shares x; of each node the first edge and how many.

        Of an edge that has nearly all of its node the others are summed up, as one minus its share would lose them.
        """
        own = x > -0.01
        x = np.minimum(x, 0.0)
        rest = np.where(own, -np.inf, x)
        top = np.maximum.reduceat(rest, first)
        top[np.isinf(top)] = 0.0
        with np.errstate(divide="ignore"):
            others = top + np.log(np.add.reduceat(np.exp(rest - np.repeat(top, counts)), first))
            other = np.where(own, np.repeat(others, counts), np.log1p(-np.exp(np.minimum(x, -0.01))))
        log = np.where(own, np.log1p(-np.exp(np.minimum(other, -0.7))), x)
        running = np.cumsum(np.exp(log))
        before = running[first] - np.exp(log[first])
        return log, other, running - np.repeat(before, counts)

    def beside(self, edge: int, banned: tuple) -> float:
        """Log share of what leaves an edge's node neither by it nor by the banned ones."""
        node = int(np.searchsorted(self.first[: self.nodes], edge, "right")) - 1
        rest = [float(self.log[e]) for e in range(int(self.first[node]), int(self.first[node + 1])) if e != edge and e not in banned]
        return float(np.logaddexp.reduce(rest)) if rest else -math.inf

    def edges_at(self, chunk: int, at: int) -> range:
        node = self.chunk_node[chunk] + at
        return range(int(self.first[node]), int(self.first[node + 1]))

    def walk(self, chunks: np.ndarray, hashes: np.ndarray, at: np.ndarray | None = None):
        """(edge of every step in order, number of steps of each stretch): one draw for each stretch given."""
        n = len(chunks)
        now = np.zeros(n, np.int32) if at is None else at.astype(np.int32)
        node, size = self.chunk_node[chunks], self.chunk_len[chunks]
        active = np.arange(n) if at is None else np.flatnonzero(now < size)
        steps, taken = np.zeros(n, np.int64), []
        while len(active):
            here = now[active]
            e = self.first[node[active] + here]
            u = uniform(mixed_bits(hashes[active], here))
            beyond = np.flatnonzero(u >= self.upto[e])
            while len(beyond):
                e[beyond] += 1
                beyond = beyond[u[beyond] >= self.upto[e[beyond]]]
            taken.append((active, e))
            here = self.end[e]
            now[active] = here
            steps[active] += 1
            active = active[here < size[active]]
        starts = np.cumsum(steps) - steps
        out = np.empty(int(steps.sum()), np.int64)
        for i, (who, e) in enumerate(taken):
            out[starts[who] + i] = e
        return out, steps


def _gumbel(u):
    return -np.log(-np.log(u))


def _truncated(mass: np.ndarray, bound: float, u: np.ndarray) -> np.ndarray:
    """Gumbels at log-mass mass, at most bound."""
    return -np.logaddexp(-bound, -(mass + _gumbel(u)))


def _least_of(bound: float, drawn: float) -> float:
    """_truncated of one number that has been drawn."""
    low, high = min(bound, drawn), max(bound, drawn)
    return low - math.log1p(math.exp(low - high))


class Sampler:
    def __init__(self, vocabulary: dict, k: int, seed: int, kept: int | None = None):
        self.v, self.k, self.seed, self.kept = vocabulary, k, seed, kept or KEPT
        self.pattern = re.compile(vocabulary["pattern"])
        self._forget()

    def _forget(self) -> None:
        self.lattices, self.of = Lattices(self.v), {}

    def _split(self, text: str, fresh: list) -> list[int]:
        """The numbers of a text's stretches; new ones go to fresh."""
        if not text:
            return []
        found, of = self.pattern.findall(" " + text), self.of
        got = list(map(of.get, found))
        if None in got:
            for i, n in enumerate(got):
                if n is None:
                    chunk = found[i]
                    n = of.get(chunk)
                    if n is None:
                        n = of[chunk] = len(of)
                        fresh.append(chunk)
                    got[i] = n
        return got

    def sample(self, texts: list[str], keys: list[int]) -> list[list[tuple]]:
        """For each text up to k (ids, log-probability, inclusion), best perturbed value first."""
        if self.lattices.size() > self.kept:
            self._forget()
        fresh: list = []
        split = [self._split(t, fresh) for t in texts]
        lat = self.lattices
        lat.add_all(fresh)
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        chunks = np.fromiter(chain.from_iterable(split), np.int64, int(sizes.sum()))
        ends = np.cumsum(np.append(0, sizes))
        of_doc = np.repeat(np.arange(len(texts)), sizes)
        place = np.arange(len(chunks)) - ends[of_doc]
        base = mixed_bits(np.asarray(keys, np.int64).view(np.uint64), self.seed)
        edges, steps = lat.walk(chunks, mixed_bits(base[of_doc], place))
        logs = lat.log[edges].astype(np.float64)
        at = np.cumsum(np.append(0, steps))[ends]
        docs = [_Doc(self, chunks[ends[i] : ends[i + 1]], base[i], edges[at[i] : at[i + 1]], steps[ends[i] : ends[i + 1]], logs[at[i] : at[i + 1]]) for i in range(len(texts))]
        for draw in range(1, self.k):
            cut = np.full(len(texts), 1 << 60)
            start = np.zeros(len(chunks), np.int32)
            for i, doc in enumerate(docs):
                if doc.pop():
                    cut[i] = doc.chunk
                    start[ends[i] + doc.chunk] = lat.end[doc.pick]
            again = np.flatnonzero(place >= cut[of_doc])
            edges, steps = lat.walk(chunks[again], mixed_bits(mixed_bits(base, draw)[of_doc[again]], place[again]), start[again])
            logs = lat.log[edges].astype(np.float64)
            of = of_doc[again]
            bounds = np.searchsorted(of, np.arange(len(texts) + 1))
            at = np.cumsum(np.append(0, steps))[bounds]
            for i, doc in enumerate(docs):
                if cut[i] < 1 << 60:
                    doc.accept(edges[at[i] : at[i + 1]], steps[bounds[i] : bounds[i + 1]], logs[at[i] : at[i + 1]])
        return [doc.result() for doc in docs]


class _Doc:
    """The search of one text."""

    def __init__(self, sampler: Sampler, chunks, base, edges, steps, logs):
        self.s, self.chunks, self.base, self.draws, self.found, self.heap = sampler, chunks, int(base), 0, [], []
        self._take(edges, steps, logs, -math.log(-math.log(self._uniform(-1))), 0, ())

    def _uniform(self, kind: int, at=None):
        self.draws += 1
        if at is None:
            return uniform_number(mixed_number(mixed_number(self.base, kind * 1000 - self.draws), 0))
        return uniform(mixed_bits(np.uint64(mixed_number(self.base, kind * 1000 - self.draws)), at))

    def _take(self, edges, steps, logs, value: float, begin: int, banned: tuple) -> None:
        """Keeps a drawn path and splits the rest of its set: paths equal up to step begin, there none of banned."""
        self.found.append((edges, steps, logs))
        if begin >= len(edges):
            return
        which, stop = len(self.found) - 1, min(len(edges), begin + NEAR)
        left = self.s.lattices.other[edges[begin:stop]].astype(np.float64)
        if banned:
            left[0] = self.s.lattices.beside(int(edges[begin]), banned)
        before = float(logs[:begin].sum()) + np.append(0.0, np.cumsum(logs[begin:stop]))
        free = np.flatnonzero(left > -np.inf)
        if len(free):
            values = _truncated(before[free] + left[free], value, self._uniform(-2, free))
            for j in self._best(values):
                t = int(free[j])
                heapq.heappush(self.heap, (-float(values[j]), self.draws, begin + t, which, (banned if t == 0 else ()) + (int(edges[begin + t]),), True))
        if stop < len(edges):  # whatever differs further down
            rest = float(logs[stop:].sum())
            if rest < 0:
                drawn = float(before[-1]) + math.log(-math.expm1(rest)) - math.log(-math.log(self._uniform(-3)))
                g = _least_of(value, drawn)
                heapq.heappush(self.heap, (-g, self.draws, stop, which, (), False))

    def _best(self, values) -> list[int]:
        """Which parts can still be popped or be the threshold: one more than samples are missing."""
        n = self.s.k - len(self.found) + 1
        return (np.argpartition(-values, n - 1)[:n] if n < len(values) else np.arange(len(values))).tolist()

    def pop(self) -> bool:
        """Takes the best set; chooses the edge by which its best path leaves the path that it was split from."""
        while self.heap and not self.heap[0][-1]:
            self._open_rest()
        if not self.heap:
            return False
        g, _, at, which, banned, _ = heapq.heappop(self.heap)
        lat, (edges, steps, _) = self.s.lattices, self.found[which]
        ends = np.cumsum(steps)
        self.chunk = int(np.searchsorted(ends, at, "right"))
        head = int(ends[self.chunk] - steps[self.chunk])
        pos = int(lat.end[edges[at - 1]]) if at > head else 0
        choices = [e for e in lat.edges_at(int(self.chunks[self.chunk]), pos) if e not in banned]
        logs = lat.log[choices].astype(np.float64)
        w = np.cumsum(np.exp(logs - logs.max()))
        self.pick = choices[min(int(np.searchsorted(w / w[-1], self._uniform(-4))), len(choices) - 1)]
        self.popped = (-g, at, head, which, banned)
        return True

    def accept(self, tail, tail_steps, tail_logs) -> None:
        """The popped set's best path, with what was drawn after the edge chosen."""
        value, at, head, which, banned = self.popped
        edges, steps, logs = self.found[which]
        path = np.concatenate([edges[:at], [self.pick], tail])
        steps = np.concatenate([steps[: self.chunk], [at - head + 1 + int(tail_steps[0])], tail_steps[1:]])
        logs = np.concatenate([logs[:at], [float(self.s.lattices.log[self.pick])], tail_logs])
        self._take(path, steps, logs, value, at, banned)

    def _open_rest(self) -> None:
        """A set that was kept together: its parts, of which the best has the set's own value."""
        g, _, begin, which, _, _ = heapq.heappop(self.heap)
        edges, _, logs = self.found[which]
        p = logs[begin:]
        left = self.s.lattices.other[edges[begin:]].astype(np.float64)
        free = np.flatnonzero(left > -np.inf)
        mass = float(logs[:begin].sum()) + (np.cumsum(p) - p)[free] + left[free]
        drawn = mass + _gumbel(self._uniform(-5, free))
        values = _conditioned(drawn, -g)
        values[drawn.argmax()] = -g
        for j in self._best(values):
            t = begin + int(free[j])
            heapq.heappush(self.heap, (-float(values[j]), self.draws, t, which, (int(edges[t]),), True))

    def result(self) -> list[tuple]:
        while self.heap and not self.heap[0][-1]:
            self._open_rest()
        lat, size = self.s.lattices, self.s.v["size"]
        threshold = -self.heap[0][0] if self.heap else -math.inf
        out = []
        for edges, _, logs in self.found:
            ids, log = lat.piece[edges], float(logs.sum())
            if len(ids) and ids.max() >= size:
                ids = expanded(ids, self.s.v)
            out.append((ids, log, 1.0 if threshold == -math.inf else -math.expm1(-math.exp(min(700.0, log - threshold)))))
        return out


def _conditioned(g: np.ndarray, bound: float) -> np.ndarray:
    """Gumbels given that the largest of them is bound."""
    top = g.max()
    v = bound - g + np.log1p(-np.exp(np.minimum(g - top, -1e-12)))
    return bound - np.maximum(v, 0) - np.log1p(np.exp(-np.abs(v)))


def expanded(ids: np.ndarray, v: dict) -> np.ndarray:
    """Characters without a piece as byte pieces."""
    out: list = []
    for i in ids.tolist():
        out += [i] if i < v["size"] else [v["first_byte"] + b for b in chr(i - v["size"]).encode("utf-8", "surrogatepass")]
    return np.array(out, np.int32)


def decode_all(ids: np.ndarray, bounds: np.ndarray, v: dict) -> pa.Array:
    """The texts of piece ids, text i being that of ids[bounds[i]:bounds[i + 1]]."""
    size = v["byte_start"][ids + 1] - v["byte_start"][ids]
    ends = np.cumsum(np.append(0, size))
    data = v["bytes"][np.repeat(v["byte_start"][ids] - ends[:-1], size) + np.arange(ends[-1])]
    starts = ends[bounds]
    full = starts[:-1] < starts[1:]
    mark = starts[:-1][full]
    mark = mark[data[mark] == 32]  # the mark that encoding puts before a text
    keep = np.ones(len(data), bool)
    keep[mark] = False
    gone = np.cumsum(np.append(0, ~keep))
    offsets = pa.py_buffer((starts - gone[starts]).astype(np.int64).tobytes())
    return pa.Array.from_buffers(pa.large_string(), len(bounds) - 1, [None, offsets, pa.py_buffer(data[keep].tobytes())])


def decode(ids, v: dict) -> str:
    """The text of piece ids."""
    return decode_all(np.asarray(ids, np.int64), np.array([0, len(ids)]), v)[0].as_py()


def _nested(found: list[list[tuple]]) -> pa.Array:
    """Samples as an Arrow column of type SAMPLED."""
    flat = [x for one in found for x in one]
    ids = np.concatenate([x[0] for x in flat]) if flat else np.zeros(0, np.int32)
    ends = np.cumsum([0] + [len(x[0]) for x in flat]).astype(np.int32)
    inner = pa.StructArray.from_arrays(
        [pa.ListArray.from_arrays(pa.array(ends), pa.array(ids.astype(np.int32))), pa.array([x[1] for x in flat], pa.float64()), pa.array([x[2] for x in flat], pa.float64())],
        ["ids", "log_prob", "inclusion"],
    )
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0] + [len(one) for one in found]).astype(np.int32)), inner)


def _round_trips(found: list[list[tuple]], texts: pa.Array, v: dict) -> pa.Array:
    """Whether every sample of a text decodes to it."""
    samples = [x[0] for one in found for x in one]
    bounds = np.cumsum([0] + [len(x) for x in samples])
    counts = [len(one) for one in found]
    texts = texts.cast(pa.large_string()).take(pa.array(np.repeat(np.arange(len(found)), counts)))
    same = pc.equal(decode_all(np.concatenate(samples).astype(np.int64), bounds, v), texts).to_numpy(zero_copy_only=False)
    return pa.array(np.logical_and.reduceat(same, np.cumsum(counts) - counts))


def sample_segmentations(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SAMPLES, seed: int = SEED, alpha: float = ALPHA,
    model: str = MODEL, out: str = "segmentations", keep_text: bool = True, check: str | None = None, kept: int | None = None,
) -> DataFrame:
    """Adds the column out (SAMPLED): up to k distinct segmentations, in the order of their perturbed values.

    check names a boolean column for whether decoding each of them gives the text (null: empty) back. kept bounds the
    bytes of lattices that a worker keeps; more of them save time where workers have the memory, and change no result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(load_vocabulary(model, alpha))
    own = [c for c in docs.columns if keep_text or c != text_col]
    key, text, *names = free_name(docs, "row_key", "row_text", out, *([check] if check else []))
    rows = docs.select(*[F.col(f"`{c}`") for c in own], F.xxhash64(id_col).alias(key), F.col(text_col).alias(text))
    schema = T.StructType([docs.schema[c] for c in own]).add(names[0], T._parse_datatype_string(SAMPLED))
    if check:
        schema = schema.add(names[1], "boolean")

    def run(batches):
        sampler = Sampler(shared.value, k, seed, kept)
        for batch in batches:
            for part in by_bytes(batch, len(own) + 1, AT_ONCE):
                texts = pc.fill_null(part.column(len(own) + 1), "")
                found = sampler.sample(texts.to_pylist(), part.column(len(own)).to_pylist())
                more = [_round_trips(found, texts, shared.value)] if check else []
                yield pa.RecordBatch.from_arrays([*part.columns[: len(own)], _nested(found), *more], schema.names)

    return rows.mapInArrow(run, schema)


def decoded(df: DataFrame, ids_col: str, out: str = "decoded", model: str = MODEL) -> DataFrame:
    """Adds the text of a column of piece ids (of which neither the column nor an id is null)."""
    shared = df.sparkSession.sparkContext.broadcast(load_vocabulary(model))
    schema = T.StructType(list(df.schema.fields)).add(*free_name(df, out), "string")
    place = df.columns.index(ids_col)

    def run(batches):
        for batch in batches:
            sizes = np.cumsum(pc.list_value_length(batch.column(place)).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + AT_ONCE, "right")))
                part = batch.slice(at, to - at)
                ids = part.column(place)
                bounds = ids.offsets.to_numpy()
                texts = decode_all(ids.values.to_numpy()[bounds[0] : bounds[-1]], bounds - bounds[0], shared.value)
                yield pa.RecordBatch.from_arrays([*part.columns, texts.cast(pa.string())], schema.names)
                at = to

    return df.mapInArrow(run, schema)


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    s = F.col("segmentations")
    return sample_segmentations(docs, keep_text=False, check="round_trip", kept=4 * KEPT).select(
        "doc_id", F.size(s).alias("n_samples"),
        F.transform(s, lambda x: F.size(x["ids"]).cast("long")).alias("n_pieces"),
        F.transform(s, lambda x: F.round(x["log_prob"], 4)).alias("log_prob"),
        F.transform(s, lambda x: x["inclusion"]).alias("inclusion"),
        F.transform(s, lambda x: F.xxhash64(x["ids"])).alias("ids_hash"),
        "round_trip",
    )


def encoded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pipeline stage: the documents' columns without the text, with the ids of each sample.

    Every row stays, repeated ones too; null and empty texts get the empty segmentation, and a column that is named
    segmentations already keeps its name (ours gets a _ behind it). Workers keep fewer lattices than elsewhere, as the
    executor's memory also holds what the stages before have left.
    """
    return sample_segmentations(docs, id_col, text_col, keep_text=False, kept=KEPT // 4)
