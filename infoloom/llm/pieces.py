"""SentencePiece encoding and decoding with Gumbel top-k sampling without replacement (operator 1).

A text's pieces form a lattice over its characters. No piece of a SentencePiece model with white-space splitting crosses
the start of a word, so the lattice is a chain of word lattices, and each distinct word's is built once a batch.
A search tree over the chain is explored best first: the perturbed value of a subtree, the largest
Gumbel-perturbed log-probability of its segmentations, is drawn from the top down, so the agenda's maximum is always an
exact bound and every pop leads to the next sample without waste.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import release, slices
from .near_dup import mixed

SPACE = "▁"
SHORT = 48  # characters of a word up to which probabilities stay in range without rescaling
FIRST = 259  # id of the first piece after the special and byte pieces
SCALE = 300.0  # per character; cancels within a word, as all its segmentations have the same characters
GAMMA = np.uint64(0x9E3779B97F4A7C15)
MASK64 = (1 << 64) - 1
BASE = np.uint64(0xD6E8FEB86659FD93)
FIELDS = ("first", "final", "length", "piece", "upto", "logp", "other")
STORE_EDGES = 1_500_000  # of the words whose lattices a worker keeps between batches (about 50 MB)


@dataclass(frozen=True)
class Vocabulary:
    """Pieces by id. Weights follow Zipf's law in the order of merges: ``1 / (rank + 2.7)``, normalized.

    A character without a piece of its own is written as its UTF-8 byte pieces and weighs as much as the last piece.
    """

    pieces: tuple[str, ...]

    @property
    def weights(self) -> np.ndarray:
        rank = np.arange(len(self.pieces), dtype=np.float64) - FIRST
        w = 1.0 / (np.maximum(rank, 0.0) + 2.7)
        w[:FIRST] = 0.0
        return w / w.sum()


def load(spark: SparkSession, path: str) -> Vocabulary:
    """Read the pieces of a model file on the driver; they travel to the executors with the tasks (about 0.5 MB)."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return Vocabulary(tuple(model.id_to_piece(i) for i in range(model.get_piece_size())))


@dataclass
class Lattices:
    """Edges of the lattices of distinct words. Nodes are characters, with one end node after each word."""

    first: np.ndarray  # first edge of each node, and one past the last
    final: np.ndarray  # whether a node ends a word
    length: np.ndarray  # characters that an edge covers
    piece: np.ndarray  # piece id, or -1 - code point where bytes are written
    upto: np.ndarray  # cumulative conditional probability within the node
    logp: np.ndarray
    other: np.ndarray  # probability of the node's other edges, summed where it is small and not taken from 1


class Sampler:
    """Builds lattices and draws segmentations; one a worker process and vocabulary."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.pieces = vocabulary.pieces
        weights = vocabulary.weights
        self.fallback = float(weights[-1])
        children: dict[tuple[int, str], int] = {}
        piece_at, weight_at = [-1], [0.0]
        for i, piece in enumerate(vocabulary.pieces[FIRST:], FIRST):
            node = 0
            for c in piece:
                nxt = children.get((node, c))
                if nxt is None:
                    nxt = children[node, c] = len(piece_at)
                    piece_at.append(-1)
                    weight_at.append(0.0)
                node = nxt
            piece_at[node], weight_at[node] = i, float(weights[i])
        chars = sorted({c for _, c in children})
        self.classes = np.zeros(0x110000, np.int64)
        self.classes[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        width = len(chars) + 1
        number = {c: i + 1 for i, c in enumerate(chars)}
        keys = np.array([n * width + number[c] for n, c in children], np.int64)
        order = np.argsort(keys)
        self.keys, self.next = keys[order], np.array(list(children.values()), np.int64)[order]
        # the transitions over the commonest characters also stand in a dense table
        common = np.bincount(keys % width, minlength=width).argsort()[::-1][:96]
        self.column = np.full(width, -1, np.int64)
        self.column[common] = np.arange(len(common))
        self.dense = np.zeros((len(piece_at), len(common) + 1), np.int32)
        held = self.column[self.keys % width] >= 0
        self.dense[self.keys[held] // width, self.column[self.keys[held] % width]] = self.next[held]
        self.piece_at, self.weight_at = np.array(piece_at, np.int64), np.array(weight_at)
        self.longest = max(map(len, vocabulary.pieces[FIRST:]))
        written = [b""] * 3 + [bytes([i]) for i in range(FIRST - 3)] + [p.replace(SPACE, " ").encode() for p in vocabulary.pieces[FIRST:]]
        self.written = np.frombuffer(b"".join(written), np.uint8)
        self.size = np.array([len(x) for x in written], np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self._forget()
        self.powers = np.multiply.accumulate(np.full(64, BASE))

    def _rare(self, node: np.ndarray, cls: np.ndarray) -> np.ndarray:
        """Transitions over characters outside the dense table."""
        key = node * len(self.column) + cls
        i = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[i] == key, self.next[i], 0)

    def lattices(self, cps: np.ndarray, sizes: np.ndarray) -> tuple[Lattices, np.ndarray]:
        """Lattices of distinct words, and the first node of each.

        ``cps`` holds the words' code points with a place after each word for its end.
        """
        starts = np.cumsum(sizes + 1) - sizes - 1
        ends = starts + sizes
        # a space is written as the marker; the marker itself has no piece and goes as bytes
        cls = self.classes[cps]
        cls[cps == 32] = self.classes[ord(SPACE)]
        cls[cps == ord(SPACE)] = 0
        cls[ends] = 0  # no walk goes over the end of a word
        col = self.column[cls]
        rare = bool(((col < 0) & (cls > 0)).any())
        end_of = np.repeat(ends, sizes + 1)
        total = len(cps)
        src, pid, weight = [], [], []
        inner = np.ones(total, bool)
        inner[ends] = False
        live = np.flatnonzero(inner)
        node = np.zeros(len(live), np.int64)
        table, columns = self.dense.ravel(), self.dense.shape[1]
        several = np.zeros(total + 1, np.int64)  # edges of each node, counted one place on
        for step in range(self.longest):
            at = live + step
            c = col[at]
            to = table[node * columns + c]  # the last column, which -1 reads, leads nowhere
            if rare:
                odd = np.flatnonzero((c < 0) & (cls[at] > 0))
                to[odd] = self._rare(node[odd], cls[at[odd]])
            ok = np.flatnonzero(to)
            if step == 0:
                single = np.zeros(len(live), bool)
                single[ok] = self.piece_at[to[ok]] >= 0
                bare = live[~single]
                cp = cps[bare].astype(np.int64)
                src.append(bare)
                pid.append(np.where(cp < 128, cp + 3, -1 - cp))
                weight.append(np.full(len(bare), self.fallback * SCALE))
                several[bare + 1] += 1
            if not len(ok):
                break
            live, node = live[ok], to[ok].astype(np.int64)
            got = self.piece_at[node]
            done = np.flatnonzero(got >= 0)
            here = live[done]
            src.append(here)
            pid.append(got[done])
            weight.append(self.weight_at[node[done]] * SCALE ** (step + 1))
            several[here + 1] += 1
        # edges in the order of their nodes, of a node shorter ones first: each goes straight to its place
        first = np.cumsum(several)
        free = first[:-1].copy()
        edges = int(first[-1])
        source, length, piece, w = np.empty(edges, np.int64), np.empty(edges, np.int16), np.empty(edges, np.int32), np.empty(edges)
        for i, (here, p, x) in enumerate(zip(src, pid, weight, strict=True)):
            to = free[here]
            free[here] = to + 1
            source[to], length[to], piece[to], w[to] = here, max(1, i), p, x
        mass = np.zeros(total)
        mass[ends] = 1.0
        prob = np.zeros(len(source))
        small = np.repeat(sizes <= SHORT, sizes + 1)
        # backward sums, level by level from the ends of all short words at once
        edges = np.flatnonzero(small[source])
        level = (end_of[source[edges]] - source[edges]).astype(np.uint8)
        by_level = np.argsort(level, kind="stable")
        edges = edges[by_level]
        bounds = np.searchsorted(level[by_level], np.arange(1, SHORT + 2))
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            e = edges[a:b]
            if not len(e):
                continue
            part = w[e] * mass[source[e] + length[e]]
            begin = np.flatnonzero(np.concatenate([[True], source[e[1:]] != source[e[:-1]]]))
            sums = np.add.reduceat(part, begin)
            mass[source[e[begin]]] = sums
            prob[e] = part / np.repeat(sums, np.diff(np.append(begin, len(e))))
        for i in np.flatnonzero(sizes > SHORT):
            self._long(int(starts[i]), int(ends[i]), first, length, w, prob)
        run = np.concatenate([[0.0], np.cumsum(prob)])
        upto = run[1:] - run[first[source]]
        final = several[1:] == 0
        upto[first[1:][~final] - 1] = 2.0  # whatever the rounding, the last edge of a node ends it
        large = prob > 0.5
        rest = np.zeros(total)
        if len(prob):
            rest[~final] = np.add.reduceat(np.where(large, 0.0, prob), first[:-1][~final])
        other = np.where(large, rest[source], 1.0 - prob)
        with np.errstate(divide="ignore"):
            return Lattices(first, final, length, piece, upto, np.log(prob), other), starts

    @staticmethod
    def _empty(nodes: int = 1 << 16, edges: int = 1 << 18) -> Lattices:
        whole = (np.zeros(nodes + 1, np.int64), np.zeros(nodes, bool), np.zeros(edges, np.int16), np.zeros(edges, np.int32))
        return Lattices(*whole, *(np.zeros(edges) for _ in FIELDS[4:]))

    def numbered(self, cps: np.ndarray, starts: np.ndarray) -> tuple[Lattices, np.ndarray]:
        """Lattices that hold all the words that begin at ``starts``, and the first node of each.

        Words are told apart by 64-bit hashes. Those of earlier batches are taken from the store, which starts anew
        when it is full and else grows by half.
        """
        if self.used[1] > STORE_EDGES:
            self._forget()
        sizes = np.diff(np.append(starts, len(cps)))
        rel = np.arange(len(cps)) - np.repeat(starts, sizes)
        if int(sizes.max()) > len(self.powers):
            self.powers = np.multiply.accumulate(np.full(2 * int(sizes.max()), BASE))
        hashes = mixed(np.add.reduceat((cps.astype(np.uint64) + np.uint64(1)) * self.powers[rel], starts) ^ sizes.astype(np.uint64))
        kinds, sample, which = np.unique(hashes, return_index=True, return_inverse=True)
        node = np.full(len(kinds), -1, np.int64)
        for have, at in self.known:
            i = np.minimum(np.searchsorted(have, kinds), len(have) - 1)
            met = have[i] == kinds
            node[met] = at[i[met]]
        new = np.flatnonzero(node < 0)
        if len(new):
            size = sizes[sample[new]]
            begin = np.cumsum(size + 1) - size - 1
            take = np.repeat(starts[sample[new]] - begin, size + 1) + np.arange(int(size.sum()) + len(size))
            fresh = cps[np.minimum(take, len(cps) - 1)]
            fresh[begin + size] = 0
            lat, first = self.lattices(fresh, size)
            nodes, edges = self.used
            more = (nodes + len(lat.final), edges + len(lat.length))
            self._room(*more)
            self.store.first[nodes : more[0] + 1] = lat.first + edges
            self.store.final[nodes : more[0]] = lat.final
            for f in FIELDS[2:]:
                getattr(self.store, f)[edges : more[1]] = getattr(lat, f)
            self.used = more
            node[new] = first + nodes
            self.known.append((kinds[new], node[new]))
            # sorted runs are merged as they come to be of like size, so there are few of them
            while len(self.known) > 1 and len(self.known[-1][0]) * 2 > len(self.known[-2][0]):
                (h2, n2), (h1, n1) = self.known.pop(), self.known.pop()
                h, n = np.concatenate([h1, h2]), np.concatenate([n1, n2])
                order = np.argsort(h, kind="stable")
                self.known.append((h[order], n[order]))
        return self.store, node[which]

    def _room(self, nodes: int, edges: int) -> None:
        """Enlarge the store to hold so many nodes and edges. Either may run out first; neither ever shrinks."""
        have = (len(self.store.final), len(self.store.length))
        if nodes <= have[0] and edges <= have[1]:
            return
        grown = self._empty(*(n if m <= n else m * 3 // 2 for m, n in zip((nodes, edges), have, strict=True)))
        upto = (self.used[0] + 1, self.used[0], *[self.used[1]] * len(FIELDS[2:]))
        for f, n in zip(FIELDS, upto, strict=True):
            getattr(grown, f)[:n] = getattr(self.store, f)[:n]
        self.store = grown

    def _forget(self) -> None:
        self.store, self.used = self._empty(), (0, 0)
        self.known: list[tuple[np.ndarray, np.ndarray]] = []

    @staticmethod
    def _long(start: int, end: int, first: np.ndarray, length: np.ndarray, w: np.ndarray, prob: np.ndarray) -> None:
        """The same for a long word, with the masses ahead rescaled as they are passed."""
        ahead = [1.0]  # masses of the nodes after the current one, nearest first
        for at in range(end - 1, start - 1, -1):
            a, b = int(first[at]), int(first[at + 1])
            part = [w[e] * ahead[length[e] - 1] for e in range(a, b)]
            total = sum(part)
            prob[a:b] = np.array(part) / total
            ahead = [1.0, *(x / total for x in ahead[:15])]

    def draw(self, lat: Lattices, node: np.ndarray, base: np.ndarray, sample: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Segment words at the nodes: edges in word order, first edge of each word (and the end), log-probabilities."""
        n = len(node)
        logp, count = np.zeros(n), np.zeros(n, np.int64)
        live, cur = np.arange(n), node.copy()
        taken: list[tuple[np.ndarray, np.ndarray]] = []
        step = 0
        while len(live):
            u = uniform(base[live], sample, step)
            e = lat.first[cur]
            more = np.flatnonzero(u > lat.upto[e])
            while len(more):
                e[more] += 1
                more = more[u[more] > lat.upto[e[more]]]
            taken.append((live, e))
            logp[live] += lat.logp[e]
            count[live] += 1
            cur = cur + lat.length[e]
            ok = ~lat.final[cur]
            live, cur = live[ok], cur[ok]
            step += 1
        offsets = np.concatenate([[0], np.cumsum(count)])
        out = np.empty(offsets[-1], np.int64)
        for t, (who, e) in enumerate(taken):
            out[offsets[who] + t] = e
        return out, offsets, logp

    def rest(self, lat: Lattices, edges: np.ndarray, offsets: np.ndarray, logp: np.ndarray) -> np.ndarray:
        """Probability of each drawn word's other segmentations, to full precision also where it is tiny."""
        out = -np.expm1(logp)
        near = np.flatnonzero(out < 1e-6)
        if len(near):  # up to a millionth, whatever parts from the word leaves it with a chance of about 1 before it
            width = offsets[near + 1] - offsets[near]
            begin = np.cumsum(width) - width
            at = np.arange(width.sum()) + np.repeat(offsets[near] - begin, width)
            out[near] = np.add.reduceat(lat.other[edges[at]], begin)
        return out

    def redraw(self, lat: Lattices, node: int, banned: list[tuple[int, ...]], base: int, sample: int) -> tuple[tuple[int, ...], float] | None:
        """Segment one word otherwise than ``banned``, by its distribution over the rest; None if there is no other.

        The second value is the probability of what then is left.
        """
        left = _Rest(lat, node)
        group = tuple(banned)
        if not left(group, 0):
            return None
        out: list[int] = []
        a, b = lat.first[node : node + 2].tolist()
        while a < b:
            q = np.exp(lat.logp[a:b]).tolist()
            step = len(out)
            for e, own in left.heads(group, step).items():
                q[e - a] *= left(own, step + 1)
            last = max(i for i, x in enumerate(q) if x)
            u, i = uniform_one(base, sample, 1_000_000 + step) * sum(q), 0
            while i < last and (u >= q[i] or not q[i]):
                u -= q[i]
                i += 1
            out.append(a + i)
            group = tuple(s for s in group if s[step] == a + i)
            node += int(lat.length[a + i])
            a, b = lat.first[node : node + 2].tolist()
        return tuple(out), left((*banned, tuple(out)), 0)

    def ids(self, lat: Lattices, edges: np.ndarray) -> np.ndarray:
        """Piece ids of edges, with bytes written out."""
        piece = lat.piece[edges]
        odd = np.flatnonzero(piece < 0)
        if not len(odd):
            return piece.astype(np.int32)
        coded = [[3 + b for b in chr(-1 - int(p)).encode("utf-8")] for p in piece[odd]]
        width = np.ones(len(piece), np.int64)
        width[odd] = [len(c) for c in coded]
        out = np.repeat(piece, width)
        at = (np.cumsum(width) - width)[odd]
        for i, c in zip(at.tolist(), coded, strict=True):
            out[i : i + len(c)] = c
        return out.astype(np.int32)

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        """What piece ids stand for in UTF-8: markers become spaces, byte pieces bytes, and the leading space goes."""
        size = self.size[ids]
        shift = np.cumsum(size)
        if not len(shift):
            return b""
        at = np.repeat(self.begin[ids] - shift + size, size) + np.arange(shift[-1])
        return self.written[at].tobytes()[1:]

    def decode(self, ids: np.ndarray) -> str:
        """The text of piece ids; bytes that are no UTF-8 become replacement characters."""
        return self.decode_bytes(ids).decode("utf-8", "replace")


def split_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts, each but an empty one after a space; where words begin; and each text's number of words.

    A word takes the spaces before it; a line feed stands alone, and so do spaces before one or at the end.
    """
    full = [" " + t if t else "" for t in texts]
    cps = np.frombuffer("".join(full).encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(cps):
        return cps, np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
    upto = np.concatenate([[0], np.cumsum(np.array(list(map(len, full)), np.int64))])
    line, space = cps == 10, cps == 32
    begins = line.copy()
    begins[1:] |= line[:-1] | (space[1:] & ~space[:-1])
    begins[upto[:-1][upto[:-1] < upto[1:]]] = True
    starts = np.flatnonzero(begins)
    return cps, starts, np.diff(np.searchsorted(starts, upto))


def uniform_one(base: int, sample: int, step: int) -> float:
    """:func:`uniform` for a single number."""
    x = (base + int(GAMMA) * ((sample << 32) + step + 1 & 0xFFFFFFFFFFFF)) & MASK64
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & MASK64
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & MASK64
    return (((x ^ (x >> 31)) >> 11) + 0.5) * 2.0**-53


def uniform(base: np.ndarray, sample: int, step: int) -> np.ndarray:
    """Numbers in (0, 1) that depend on the row's key, the word's place, the sample and the step alone."""
    x = mixed(base + np.uint64(int(GAMMA) * ((sample << 32) + step + 1 & 0xFFFFFFFFFFFF) & MASK64))
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


class _Rest:
    """Probability of a word's segmentations but some, by sums of what parts from them and so without cancellation."""

    def __init__(self, lat: Lattices, node: int) -> None:
        self.lat, self.node = lat, node
        self.known: dict[tuple[tuple[tuple[int, ...], ...], int], float] = {}

    @staticmethod
    def heads(group: tuple[tuple[int, ...], ...], step: int) -> dict[int, tuple[tuple[int, ...], ...]]:
        """The segmentations of a group by their edge at a step."""
        out: dict[int, tuple[tuple[int, ...], ...]] = {}
        for s in group:
            out[s[step]] = (*out.get(s[step], ()), s)
        return out

    def __call__(self, group: tuple[tuple[int, ...], ...], step: int) -> float:
        """The chance, after the edges before ``step`` that all of ``group`` share, of a segmentation outside it."""
        if not group:
            return 1.0
        got = self.known.get((group, step))
        if got is not None:
            return got
        head = group[0]
        fork = step if len(group) > 1 else len(head)  # all of a group are of one word, so none is the beginning of another
        while fork < len(head) and all(s[fork] == head[fork] for s in group):
            fork += 1
        value = 0.0
        if fork < len(head):
            heads = self.heads(group, fork)
            node = self.node + int(self.lat.length[list(head[:fork])].sum())
            a, b = self.lat.first[node : node + 2].tolist()
            p = np.exp(self.lat.logp[a:b]).tolist()
            value = sum(x if a + i not in heads else x * self(heads[a + i], fork + 1) for i, x in enumerate(p))
        self.known[group, fork] = value
        for at in range(fork - 1, step - 1, -1):
            value = float(self.lat.other[head[at]]) + math.exp(self.lat.logp[head[at]]) * value
            self.known[group, at] = value
        return value


@dataclass
class _Path:
    """A sampled segmentation of one document: the words before ``fork`` are the parent's."""

    fork: int
    parent: int
    own: tuple[int, ...]  # edges of the word at the fork
    value: float
    logp: float = 0.0
    values: np.ndarray | None = None  # perturbed bounds of the subtrees that part from it at each word after the fork
    word_logp: np.ndarray | None = None
    edges: np.ndarray | None = None
    offsets: np.ndarray | None = None
    residue: list[tuple[float, int, list]] = field(default_factory=list)


def _bound(loc: np.ndarray, cap: np.ndarray | float, u: np.ndarray) -> np.ndarray:
    """Gumbel variables with the given locations, conditioned to stay below ``cap``."""
    with np.errstate(divide="ignore"):
        return -np.logaddexp(-cap, np.log(-np.log(u)) - loc)


def _bound_one(loc: float, cap: float, u: float) -> float:
    """:func:`_bound` for a single number."""
    a, b = -cap, math.log(-math.log(u)) - loc
    return -(max(a, b) + math.log1p(math.exp(-abs(a - b))))


class _Search:
    """The agendas of a batch of documents. (A class, not closures that call themselves: those would outlive their batch.)"""

    def __init__(self, sampler: Sampler, lat: Lattices, node: np.ndarray, base: np.ndarray, ends: np.ndarray) -> None:
        self.sampler, self.lat, self.node, self.base, self.ends = sampler, lat, node, base, ends

    def settle(self, todo: list[tuple[int, _Path]], paths: list[list[_Path]], sample: int) -> None:
        """Draw the words after the forks of all documents' new paths at once."""
        lat, node, base, ends = self.lat, self.node, self.base, self.ends
        spans = [(int(ends[d]) + p.fork + 1, int(ends[d + 1])) for d, p in todo]
        width = np.array([b - a for a, b in spans], np.int64)
        begin = np.cumsum(width) - width
        at = np.arange(width.sum()) - np.repeat(begin, width) + np.repeat(np.array([a for a, _ in spans], np.int64), width)
        edges, offsets, logp = self.sampler.draw(lat, node[at], base[at], sample)
        run = np.concatenate([[0.0], np.cumsum(logp)])
        head = np.zeros(len(todo))
        for i, (d, p) in enumerate(todo):
            if p.fork >= 0:
                head[i] = self.prefix(paths[d], p.parent, p.fork) + float(lat.logp[list(p.own)].sum())
        which = np.repeat(np.arange(len(todo)), width)
        before = head[which] + run[:-1] - run[begin][which]
        with np.errstate(divide="ignore"):
            loc = before + np.log(self.sampler.rest(lat, edges, offsets, logp))
        caps = np.array([p.value for _, p in todo])
        values = _bound(loc, caps[which], uniform(base[at], sample, 2_000_000))
        for i, (_, p) in enumerate(todo):
            a, b = int(begin[i]), int(begin[i] + width[i])
            p.values, p.word_logp = values[a:b].copy(), logp[a:b]
            p.offsets = offsets[a : b + 1] - offsets[a]
            p.edges = edges[offsets[a] : offsets[b]]
            p.logp = head[i] + float(run[b] - run[a])

    @staticmethod
    def word_edges(paths: list[_Path], i: int, w: int) -> tuple[int, ...]:
        p = paths[i]
        while w < p.fork:
            p = paths[p.parent]
        if w == p.fork:
            return p.own
        j = w - p.fork - 1
        return tuple(p.edges[p.offsets[j] : p.offsets[j + 1]].tolist())

    def prefix(self, paths: list[_Path], i: int, w: int) -> float:
        """Log-probability of the words before ``w`` on a path."""
        p, total = paths[i], 0.0
        while p.fork >= 0 and w <= p.fork:
            p = paths[p.parent]
        total = float(p.word_logp[: w - p.fork - 1].sum()) if w > p.fork else 0.0
        if p.fork >= 0:
            total += float(self.lat.logp[list(p.own)].sum()) + self.prefix(paths, p.parent, p.fork)
        return total

    def all_edges(self, paths: list[_Path], i: int, upto: int) -> list[np.ndarray]:
        """Edges of the words before ``upto`` on a path."""
        p = paths[i]
        while p.fork >= 0 and upto <= p.fork:
            p = paths[p.parent]
        parts = []
        if p.fork >= 0:
            parts = [*self.all_edges(paths, p.parent, p.fork), np.array(p.own, np.int64)]
        return [*parts, p.edges[: p.offsets[max(0, upto - p.fork - 1)]]]

    @staticmethod
    def best(paths: list[_Path]) -> tuple[float, int, int, int]:
        """The largest value on a document's agenda: value, path, word, and which residue (-1: a fresh fork)."""
        top = (-np.inf, -1, -1, -1)
        for i, p in enumerate(paths):
            if len(p.values):
                j = int(np.argmax(p.values))
                if p.values[j] > top[0]:
                    top = (float(p.values[j]), i, p.fork + 1 + j, -1)
            for r, (v, w, _) in enumerate(p.residue):
                if v > top[0]:
                    top = (v, i, w, r)
        return top


def sample_batch(sampler: Sampler, keys: list[str], texts: list[str], k: int) -> list[list[tuple[np.ndarray, float, float, float]]]:
    """For each text, up to ``k`` distinct segmentations in falling perturbed order.

    A segmentation is its piece ids, log-probability, perturbed log-probability, and log inclusion probability
    against the next perturbed value (0 where every segmentation has been given).
    """
    cps, starts, sizes = split_words(texts)
    out: list[list[tuple[np.ndarray, float, float, float]]] = [[] for _ in texts]
    if not len(starts):
        for i in range(len(texts)):
            out[i].append((np.zeros(0, np.int32), 0.0, 0.0, 0.0))
        return out
    lat, node = sampler.numbered(cps, starts)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    seeds = np.array([xxhash.xxh3_64_intdigest(x) for x in keys], np.uint64)
    doc = np.repeat(np.arange(len(texts)), sizes)
    place = np.arange(len(node)) - ends[:-1][doc]
    base = mixed(seeds[doc] + GAMMA * (place.astype(np.uint64) + np.uint64(1)))

    search = _Search(sampler, lat, node, base, ends)
    filled = [d for d in range(len(texts)) if sizes[d]]
    paths: list[list[_Path]] = [[] for _ in texts]
    roots = -np.log(-np.log(uniform(mixed(seeds), 0, 3_000_000)))
    todo = [(d, _Path(-1, -1, (), float(roots[d]))) for d in filled]
    search.settle(todo, paths, 0)
    for d, p in todo:
        paths[d].append(p)
    for sample in range(1, k):
        todo = []
        for d in filled:
            while len(paths[d]) == sample:
                value, i, w, r = search.best(paths[d])
                if value == -np.inf:
                    break
                p = paths[d][i]
                at = int(ends[d]) + w
                if r < 0:
                    p.values[w - p.fork - 1] = -np.inf
                    banned = [search.word_edges(paths[d], i, w)]
                else:
                    _, _, banned = p.residue.pop(r)
                drawn = sampler.redraw(lat, int(node[at]), banned, int(base[at]), sample)
                if drawn is None:
                    continue
                fresh, left = drawn
                banned = [*banned, fresh]
                if left > 0:
                    loc = search.prefix(paths[d], i, w) + math.log(left)
                    p.residue.append((_bound_one(loc, value, uniform_one(int(base[at]), sample, 2_500_000)), w, banned))
                new = _Path(w, i, fresh, value)
                todo.append((d, new))
                break
        if not todo:
            break
        search.settle(todo, paths, sample)
        for d, p in todo:
            paths[d].append(p)
    for d in range(len(texts)):
        if not sizes[d]:
            out[d].append((np.zeros(0, np.int32), 0.0, 0.0, 0.0))
            continue
        kappa = search.best(paths[d])[0] if len(paths[d]) == k else -np.inf
        for i, p in enumerate(paths[d]):
            ids = sampler.ids(lat, np.concatenate(search.all_edges(paths[d], i, int(sizes[d]))))
            with np.errstate(divide="ignore", over="ignore"):
                inclusion = 0.0 if kappa == -np.inf else float(np.log(-np.expm1(-np.exp(p.logp - kappa))))
            if inclusion == -np.inf:  # the exponential underflows; its argument is its own limit
                inclusion = p.logp - kappa
            out[d].append((ids, p.logp, p.value, inclusion))
    return out


_SAMPLERS: dict[int, Sampler] = {}


def _sampler(vocabulary: Vocabulary) -> Sampler:
    key = hash(vocabulary.pieces)
    if key not in _SAMPLERS:
        _SAMPLERS.clear()
        _SAMPLERS[key] = Sampler(vocabulary)
    return _SAMPLERS[key]


def sample_encodings(
    docs: DataFrame, model_path: str, k: int = 3, digest: bool = False, batch_chars: int = 300_000, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Distinct sampled segmentations of each text, without replacement: one row a document row and sample.

    Returns ``doc_id, sample, ids, n_tokens, log_prob, perturbed, log_inclusion, decodes``: piece ids (or their SHA-256
    as 32-bit little-endian numbers with ``digest``), the segmentation's log-probability, its
    Gumbel-perturbed value by which samples are ordered from 0, the log of its inclusion probability given the next
    perturbed value, and whether the ids decode to the text. The draws depend on the row's id and text alone,
    whatever the partitions. A text with fewer than ``k`` segmentations gives all of them, with log inclusion 0.

    A null or empty text has the one empty segmentation. Rows with equal id and text get equal
    samples; a null id is a key as any other. An empty table gives an empty result; other columns are not read.
    """
    vocabulary = load(docs.sparkSession, model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = _sampler(vocabulary)
        names = ["doc_id", "sample", "ids", "n_tokens", "log_prob", "perturbed", "log_inclusion", "decodes"]
        kind = pa.string() if digest else pa.list_(pa.int32())
        for batch in batches:
            a = 0
            while a < batch.num_rows:
                texts, chars = [], 0
                while a + len(texts) < batch.num_rows and (not texts or chars < batch_chars):
                    texts.append(batch.column(1)[a + len(texts)].as_py() or "")
                    chars += len(texts[-1])
                own = batch.slice(a, len(texts))
                a += len(texts)
                keys = ["" if x is None else str(x) for x in own.column(0).to_pylist()]
                who, rows = [], []
                for i, found in enumerate(sample_batch(sampler, keys, texts, k)):
                    raw = texts[i].encode()
                    for s, (ids, logp, value, inclusion) in enumerate(found):
                        who.append(i)
                        form = hashlib.sha256(ids.astype("<i4").tobytes()).hexdigest() if digest else ids
                        rows.append((s, form, len(ids), logp, value, inclusion, sampler.decode_bytes(ids) == raw))
                columns = list(zip(*rows, strict=True))
                kinds = [pa.int32(), kind, pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.bool_()]
                yield pa.RecordBatch.from_arrays(
                    [own.column(0).take(pa.array(who)), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names=names
                )
        release()

    id_type = docs.schema[id_col].dataType.simpleString()
    form = "string" if digest else "array<int>"
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run,
        f"doc_id {id_type}, sample int, ids {form}, n_tokens long, log_prob double, perturbed double, log_inclusion double, decodes boolean",
    )


def decode_ids(rows: DataFrame, model_path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Add the text of a column of piece ids; null ids give a null text, no ids an empty one.

    Bytes that are no UTF-8 become replacement characters. Rows are read alone, 512 at a time, so repeated ones repeat their result and a
    long one is decoded whole; a column named ``out_col`` is replaced, all others pass through; an empty table gives an empty result.
    """
    vocabulary = load(rows.sparkSession, model_path)
    names = [c for c in rows.columns if c != out_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = _sampler(vocabulary)
        for batch in slices(batches):
            lists = batch.column(batch.schema.get_field_index(ids_col)).to_pylist()
            texts = [None if x is None else sampler.decode(np.array(x, np.int32)) for x in lists]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(texts, pa.string())], names=[*names, out_col])

    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in names)
    return rows.select(*names).mapInArrow(run, f"{schema}, `{out_col}` string")
