"""SentencePiece encoding and decoding with sampled segmentations.

All segmentations of a text into pieces of a vocabulary form a lattice. Its edges are weighted by the
pieces' ranks (log weight = -sharpness * log(rank + 2); a byte-pair vocabulary has ranks, not
probabilities), which gives each segmentation a probability. The operator draws k distinct
segmentations without replacement: each carries its log probability plus Gumbel noise, and a
best-first (A*) search over the perturbed lattice finds the k largest sums. The search goes top-down:
the root's maximum is drawn first. Which edge carries a node's maximum doesn't depend on the maximum and is drawn by the
edges' probabilities; the other edges' noise, drawn where it can still matter, is conditioned on lying below it. So the first path
follows the maxima, and each later one leaves an earlier path at the edge with the
largest conditioned value of all that are still open. The (k + 1)-th value is the threshold that gives
each drawn segmentation its inclusion score, log(1 - exp(-exp(log p - threshold))).

The noise is a hash of the row's key, the number of the path and the place in the text, so results
don't depend on partitions or batches. A text is cut into units (a word with the spaces before it, of at most
512 bytes) that no piece crosses; the sampling of all units of a block of texts runs in step, in numpy. Texts of over 512 KiB are sampled in parts of
256 KiB, whose lattices are made one at a time, so memory beside the text and its ids is bounded.

Defined results: null and empty texts have one segmentation, without pieces. Rows without key share one seed of their own. A text with fewer than k
segmentations yields those it has. Characters outside the vocabulary become byte pieces, so decode(encode(x)) == x for every
text. Equal rows get equal results. Whole texts are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import hash_short_runs, mix, prepare, slices

#: Log weights are -SHARPNESS * log(rank + 2).
SHARPNESS = 1.0
#: A branch is open only where the path so far has at least this log probability: that a later one is among the largest has a probability of the order of
#: exp(_OPEN), which is less than a step of the noise's 52 bits.
_OPEN = -40.0
#: The most bytes of a unit.
_LONGEST = 512
_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_TABLE_BITS = 22


@dataclass
class Vocabulary:
    """Pieces with spaces in place of their mark; weight by id; the ids of bytes."""

    pieces: list[str]
    weights: np.ndarray
    bytes_: list[int]
    raw: list[bytes] = field(default_factory=list)

    @staticmethod
    def load(path: str) -> Vocabulary:
        from sentencepiece import SentencePieceProcessor

        p = SentencePieceProcessor(model_file=path)
        n = p.get_piece_size()
        pieces = [p.id_to_piece(i).replace("▁", " ") for i in range(n)]
        special = [p.is_control(i) or p.is_unknown(i) or p.is_unused(i) or p.is_byte(i) for i in range(n)]
        bytes_ = [p.piece_to_id(f"<0x{i:02X}>") for i in range(256)]
        rank = np.array([-p.get_score(i) for i in range(n)])
        rank[(rank < 0) | (rank > n)] = n
        weights = -SHARPNESS * np.log(rank + 2)
        raw = [b"" if s else x.encode() for x, s in zip(pieces, special, strict=True)]
        for b, i in enumerate(bytes_):
            raw[i] = bytes((b,))
        return Vocabulary(["" if s else x for x, s in zip(pieces, special, strict=True)], weights, bytes_, raw)

    def tables(self):
        """Hashes of pieces and their ids, in order of the hash; of the hashes' slots which are taken, and the place of one that takes it."""
        if not hasattr(self, "_tables"):
            self.longest = max(map(len, self.pieces))
            ids = [i for i, x in enumerate(self.pieces) if x]
            h = np.array([_hash_string(self.pieces[i]) for i in ids], np.uint64)
            order = np.argsort(h)
            h = h[order]
            slot = (h * _Q) >> np.uint64(64 - _TABLE_BITS)
            taken, place = np.zeros(1 << _TABLE_BITS, bool), np.zeros(1 << _TABLE_BITS, np.int32)
            taken[slot], place[slot] = True, np.arange(len(h))
            self._tables = h, np.array(ids, np.int32)[order], taken, place
        return self._tables

    def decode(self, ids) -> str:
        return b"".join(map(self.raw.__getitem__, ids))[1:].decode(errors="replace")


def _hash_string(s: str) -> int:
    x = 0
    for c in s:
        x = (x * int(_P) + ord(c) + 1) % (1 << 64)
    return x


class Lattice:
    """The lattices of units, end to end: nodes are characters and the end of each unit; edges are sorted by the node they leave, the longest piece first.

    Of a node: edge, the first of its edges (-1 at the end of a unit), and count, how many it has. Of an edge: dst, its node's end; piece (a character outside the vocabulary: -1 - its place in odd); logp, its log probability among its node's edges; cum, the
    sum of the probabilities of those up to it.
    """

    def __init__(self, units: list[str], v: Vocabulary) -> None:
        hashes, ids, taken, places = v.tables()
        lengths = np.array([len(u) for u in units], np.int32)
        chars = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), "<u4")
        self.first = (np.cumsum(lengths + 1) - lengths - 1).astype(np.int32)  # node of each unit's start
        unit = np.repeat(np.arange(len(units), dtype=np.int32), lengths)
        at = np.arange(len(chars), dtype=np.int32)
        left = np.cumsum(lengths, dtype=np.int32)[unit] - at  # characters to the unit's end
        values = chars.astype(np.uint64) + np.uint64(1)
        n_edges = np.zeros(len(chars), np.int32)
        h, rest = np.zeros(len(chars), np.uint64), left
        found = []  # by length of piece: characters, pieces, how many shorter ones begin there
        for n in range(1, v.longest + 1):
            h = h * _P + (values if n == 1 else values[at + np.int32(n - 1)])
            slot = (h * _Q) >> np.uint64(64 - _TABLE_BITS)
            hit = np.flatnonzero(taken[slot])
            x, where = h[hit], places[slot[hit]]
            ok = hashes[where] == x
            other = np.flatnonzero(~ok)  # not a piece, or one whose slot is another's
            where[other] = np.minimum(np.searchsorted(hashes, x[other]), len(hashes) - 1)
            ok[other] = hashes[where[other]] == x[other]
            got, piece = at[hit[ok]], ids[where[ok]]
            if n == 1:
                known = np.zeros(len(chars), bool)
                known[got] = True
                unknown = np.flatnonzero(~known).astype(np.int32)
                self.odd = chars[unknown]  # characters that become bytes
                got, piece = np.concatenate([got, unknown]), np.concatenate([piece, -1 - np.arange(len(unknown), dtype=np.int32)])
            if len(got):
                found.append((n, got, piece, n_edges[got]))
                n_edges[got] += 1
            more = np.flatnonzero(rest > n)
            if not len(more):
                break
            at, h, rest = at[more], h[more], rest[more]
        total = len(chars) + len(units)
        node = np.arange(len(chars), dtype=np.int32) + unit
        count = np.zeros(total, np.int32)
        count[node] = n_edges
        edge = (np.cumsum(count) - count).astype(np.int32)
        m = int(n_edges.sum())
        src, self.dst, self.piece, far = np.empty(m, np.int32), np.empty(m, np.int32), np.empty(m, np.int32), np.empty(m, np.int32)
        for n, got, piece, nth in found:
            s = node[got]
            e = edge[s] + n_edges[got] - 1 - nth
            src[e], self.dst[e], self.piece[e], far[e] = s, s + n, piece, left[got]
        width = np.where(self.odd < 0x80, 1, np.where(self.odd < 0x800, 2, np.where((self.odd >= 0xDC80) & (self.odd < 0xDD00), 1, np.where(self.odd < 0x10000, 3, 4))))
        w = v.weights[np.maximum(self.piece, 0)]
        back = np.flatnonzero(self.piece < 0)
        w[back] = -1.5 * SHARPNESS * np.log(len(v.pieces) + 2) * width[-1 - self.piece[back]]
        # log of the weights of all paths from each node to its unit's end, nodes nearest to the end first
        beta = np.zeros(total)
        top = int(lengths.max(initial=0))
        by_left = np.argsort(far.astype(np.uint16), kind="stable")
        cut = np.concatenate([[0], np.cumsum(np.bincount(far, minlength=top + 1)[1:])])
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            e = by_left[a:b]
            s = src[e]
            x = w[e] + beta[self.dst[e]]
            starts = np.flatnonzero(np.diff(s, prepend=-1))
            most = np.maximum.reduceat(x, starts)
            x -= np.repeat(most, np.diff(starts, append=len(e)))
            beta[s[starts]] = most + np.log(np.add.reduceat(np.exp(x, out=x), starts))
        self.logp = w + beta[self.dst] - beta[src]
        # running sums within nodes, from running sums over all edges; the last edge of a node takes what rounding leaves
        sums = np.cumsum(np.exp(self.logp))
        self.cum = sums - np.concatenate([[0.0], sums])[edge[src]]
        self.cum[(edge + count - 1)[count > 0]] = 2.0
        self.count = count.astype(np.int16)
        self.edge = np.where(count > 0, edge, -1).astype(np.int32)

    def after(self, base: Lattice) -> Lattice:
        """This lattice behind another, in the room behind that one's arrays, which its next caller may write over."""
        out = object.__new__(Lattice)
        n, e, o = np.int32(len(base.count)), np.int32(len(base.dst)), len(base.odd)
        piece = np.where(self.piece < 0, self.piece - o, self.piece)
        room = base.__dict__.setdefault("room", {})
        for name, own in {"first": self.first + n, "dst": self.dst + n, "edge": np.where(self.edge < 0, self.edge, self.edge + e), "piece": piece, "odd": self.odd, "count": self.count, "logp": self.logp, "cum": self.cum}.items():
            old = getattr(base, name)
            size = len(old) + len(own)
            if name not in room or len(room[name]) < size:
                room[name] = np.empty(len(old) + 2 * len(own) + 1024, old.dtype)
                room[name][: len(old)] = old
            room[name][len(old) : size] = own
            setattr(out, name, room[name][:size])
        return out


def _uniform(h: np.ndarray) -> np.ndarray:
    """Numbers between 0 and 1, both excluded, from 52 bits of hashes."""
    return ((mix(h) >> np.uint64(12)).astype(np.float64) + 0.5) * (1.0 / (1 << 52))


def _gumbel(h: np.ndarray) -> np.ndarray:
    return -np.log(-np.log(_uniform(h)))


_STEP = np.uint64(0xD6E8FEB86659FD93)


def _draw(lat: Lattice, token: np.ndarray, node: np.ndarray, key: np.ndarray):
    """Follows one edge after the other from each node to its unit's end, each drawn by its probability. Yields for each round its tokens and edges."""
    step = 0
    while True:
        edge = lat.edge[node]
        live = np.flatnonzero(edge >= 0)
        if not len(live):
            return
        if len(live) < len(node):
            token, edge, key = token[live], edge[live], key[live]
        u = _uniform(key + np.uint64(step))
        on = np.flatnonzero(u > lat.cum[edge])
        many, u = on, u[on]
        while len(many):
            edge[many] += 1
            on = np.flatnonzero(u > lat.cum[edge[many]])
            many, u = many[on], u[on]
        yield token, edge
        node = lat.dst[edge]
        step = (step + int(_STEP)) % (1 << 64)


@dataclass
class _Part:
    """Tokens of texts that are drawn together: each one's text, start node and number within its text. Tokens of a text lie together."""

    lat: Lattice
    of: np.ndarray
    node: np.ndarray
    place: np.ndarray


@dataclass
class _Drawn:
    """One segmentation of the texts of a part: edges in order, where each token's begin (and the end), log probability before each edge of the first ones."""

    edge: np.ndarray
    offset: np.ndarray


@dataclass
class _Open:
    """Branches that stay open: text, perturbed value, and the path, part, edge number and edge at which they leave."""

    text: np.ndarray
    value: np.ndarray
    path: np.ndarray
    part: np.ndarray
    event: np.ndarray
    edge: np.ndarray

    def at(self, which: np.ndarray) -> _Open:
        return _Open(*(getattr(self, c)[which] for c in self.__dataclass_fields__))

    @staticmethod
    def all_of(some: list[_Open]) -> _Open:
        return _Open(*(np.concatenate([getattr(x, c) for x in some]) for c in _Open.__dataclass_fields__))

    def best(self, k: int) -> np.ndarray:
        """Indices of the k largest of each text, by falling value within it."""
        order = np.argsort(self.text, kind="stable")
        heads = np.flatnonzero(np.diff(self.text[order], prepend=-1))
        value, out = self.value[order], []
        for _ in range(k):
            if not len(heads):
                break
            top = np.maximum.reduceat(value, heads)
            at = np.flatnonzero(value == np.repeat(top, np.diff(heads, append=len(value))))
            at = at[np.searchsorted(at, heads)]  # the first of equal ones
            at = at[top > -np.inf]
            out.append(order[at])
            value[at] = -np.inf
        return np.concatenate(out) if out else np.zeros(0, np.int64)


def _spans(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Indices of ranges, one after the other."""
    return np.arange(int(n.sum())) + np.repeat(start - (np.cumsum(n) - n), n)


def _siblings(lat: Lattice, s: int, p: int, text: np.ndarray, event: np.ndarray, chosen: np.ndarray, src: np.ndarray, before: np.ndarray, value: np.ndarray, salt: np.ndarray) -> _Open:
    """The other edges of the nodes (src) of drawn edges, with values. The drawn edge carries the node's maximum, that of its path; each other one's value is
    Gumbel noise around its log probability, given that it lies below."""
    n = lat.count[src].astype(np.int64)
    edge, row = _spans(lat.edge[src], n).astype(np.int32), np.repeat(np.arange(len(src)), n)
    other = np.flatnonzero(edge != chosen[row])
    edge, row = edge[other], row[other]
    mean = before[row] + lat.logp[edge]
    e = -np.log(_uniform(salt[row] + edge_numbers(lat, src[row], edge) * np.uint64(0xA0761D6478BD642F)))
    g = mean - np.logaddexp(mean - value[row], np.log(e))
    return _Open(text[row], g, np.full(len(row), s), np.full(len(row), p), event[row], edge)


def edge_numbers(lat: Lattice, src: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """The number of an edge among its node's, from 1 on."""
    return (edge - lat.edge[src] + 1).astype(np.uint64)


def _sample(parts, m: int, n: int, key: np.ndarray, k: int) -> tuple[list[list[_Drawn]], list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """k paths of n texts through m parts (parts(p) gives a part). Returns the paths by path and part; which texts have each path; values; log probabilities; thresholds."""
    paths: list[list[_Drawn]] = []
    lives, values, logps = [], np.full((k, n), -np.inf), np.full((k, n), -np.inf)
    none = np.zeros(0, np.int64)
    open_ = _Open(none, none.astype(float), none, none, none, none)
    for s in range(k):
        b_path, b_part, b_event, b_edge = np.full(n, -1), np.full(n, -1), np.zeros(n, np.int64), np.zeros(n, np.int64)
        if s == 0:
            live, value = np.ones(n, bool), _gumbel(key + np.uint64(0x5851F42D4C957F2D))
        else:
            first = open_.best(1)
            top = open_.at(first)
            live, value = np.zeros(n, bool), np.full(n, -np.inf)
            live[top.text], value[top.text] = True, top.value
            b_path[top.text], b_part[top.text], b_event[top.text], b_edge[top.text] = top.path, top.part, top.event, top.edge
            open_ = open_.at(np.delete(np.arange(len(open_.text)), first))
        more = [open_]
        so_far = np.zeros(n)  # log probability of the parts before
        drawn_parts = []
        for p in range(m):
            part = parts(p)
            lat, of, node = part.lat, part.of, part.node
            tokens = np.arange(len(of))
            first_token = np.searchsorted(of, np.arange(n + 1))
            at = np.full(n, -1)  # the token that holds a text's branch
            here = np.flatnonzero(live & (b_part == p))
            for q in np.unique(b_path[here]).tolist():
                mine = here[b_path[here] == q]
                at[mine] = np.searchsorted(paths[q][p].offset, b_event[mine], "right") - 1
            todo = live[of] & (b_part[of] <= p) & (tokens >= at[of])
            todo &= (b_part[of] < p) | (at[of] >= 0)
            drawn = np.flatnonzero(todo)
            begin = node[drawn].copy()
            mid = np.flatnonzero(drawn == at[of[drawn]])
            begin[mid] = lat.dst[b_edge[of[drawn[mid]]]]
            salt = mix(key[of[drawn]] + np.uint64((s + 1) * 0x2545F4914F6CDD1D % (1 << 64)) + part.place[drawn].astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))
            rounds = list(_draw(lat, drawn, begin, salt))
            counts = np.zeros(len(of), np.int64)  # edges of each token
            for tok, _ in rounds:
                counts[tok] += 1
            ahead = np.zeros(len(of), np.int64)  # edges of a token that come before its drawn ones
            old = np.flatnonzero(live[of] & ((b_part[of] > p) | (b_part[of] == p) & (tokens < at[of])))
            for q in np.unique(b_path[of[old]]).tolist():
                mine = old[b_path[of[old]] == q]
                counts[mine] = np.diff(paths[q][p].offset)[mine]
            for q in np.unique(b_path[here]).tolist():
                mine = here[b_path[here] == q]
                ahead[at[mine]] = b_event[mine] - paths[q][p].offset[at[mine]] + 1
            counts += ahead
            offset = np.concatenate([[0], np.cumsum(counts)])
            edge = np.empty(offset[-1], np.int32)
            for q in np.unique(b_path[live & (b_part >= p)]).tolist():  # what a path shares with the one it leaves
                mine = np.flatnonzero(live & (b_part >= p) & (b_path == q))
                a = paths[q][p].offset[first_token[mine]]
                z = np.where(b_part[mine] == p, b_event[mine], paths[q][p].offset[first_token[mine + 1]])
                edge[_spans(offset[first_token[mine]], z - a)] = paths[q][p].edge[_spans(a, z - a)]
            edge[offset[at[here]] + ahead[at[here]] - 1] = b_edge[here]
            base = offset[:-1] + ahead
            for r, (tok, e) in enumerate(rounds):
                edge[base[tok] + r] = e
            drawn_parts.append(_Drawn(edge, offset))
            sums = np.concatenate([[0.0], np.cumsum(lat.logp[edge])])
            text_at = offset[first_token]
            # siblings stay open where the path so far is not too unlikely: among the first edges of each text
            last_open = offset[:-1] + ahead
            started = so_far[of[drawn]] + sums[last_open[drawn]] - sums[text_at[of[drawn]]] > _OPEN
            early = drawn[started]
            if len(early):
                n_own = (counts - ahead)[early]
                event = _spans(last_open[early], n_own)
                tok = np.repeat(early, n_own)
                text = of[tok]
                before = so_far[text] + sums[event] - sums[text_at[text]]
                src = np.where(event > offset[tok], lat.dst[edge[np.maximum(event - 1, 0)]], node[tok])
                ok = np.flatnonzero((before > _OPEN) & (lat.count[src] > 1))
                if len(ok):
                    event, tok, text, before, src = event[ok], tok[ok], text[ok], before[ok], src[ok]
                    noise = mix(key[text] + np.uint64((s + 1) * 0x9E6C63D0876A9A47 % (1 << 64)) + part.place[tok].astype(np.uint64) * np.uint64(0x9FB21C651E98DF25)) + (event - offset[tok]).astype(np.uint64) * _STEP
                    more.append(_siblings(lat, s, p, text, event, edge[event], src, before, value[text], mix(noise)))
            so_far += sums[text_at[1:]] - sums[text_at[:-1]]
        paths.append(drawn_parts)
        lives.append(live)
        values[s], logps[s] = value, np.where(live, so_far, -np.inf)
        open_ = _Open.all_of(more)
        open_ = open_.at(open_.best(k + 1))  # only the best k + 1 of each text can still matter
    threshold = np.full(n, -np.inf)
    np.maximum.at(threshold, open_.text, open_.value)
    return paths, lives, values, logps, threshold


#: Bytes of text that are sampled together; a longer text is sampled in parts of about as many. With the units kept below, this sets the memory of a Python process.
_AT_ONCE = 1 << 18
#: Units whose lattice a process keeps: those of the first texts it gets, as common words come soon.
_KEPT_UNITS = 50_000
_SLOTS = 20


@dataclass
class _Kept:
    """Units by hash: their numbers in the lattice. slots finds most of them by the first bits of the hash."""

    v: Vocabulary
    hashes: np.ndarray
    numbers: np.ndarray
    lat: Lattice
    slots: np.ndarray | None = None

    def find(self, h: np.ndarray) -> np.ndarray:
        """The number of each unit, or -1."""
        if self.slots is None:
            self.slots = np.zeros(1 << _SLOTS, np.int32)
            self.slots[self.hashes >> np.uint64(64 - _SLOTS)] = np.arange(len(self.hashes))
        at = self.slots[h >> np.uint64(64 - _SLOTS)]
        out = np.where(self.hashes[at] == h, self.numbers[at], -1)
        rest = np.flatnonzero(out < 0)
        at = np.minimum(np.searchsorted(self.hashes, h[rest]), len(self.hashes) - 1)
        out[rest] = np.where(self.hashes[at] == h[rest], self.numbers[at], -1)
        return out


_kept: dict[int, _Kept] = {}


def _units(data: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Where units begin in bytes of texts that begin at `texts`: at runs of spaces, line ends and what follows these. Units of over _LONGEST bytes are cut between characters."""
    before = np.concatenate([[10], data[:-1]]).astype(np.uint8)
    new = (data == 10) | (before == 10) | (data == 32) & (before != 32)
    new[texts] = True
    starts = np.flatnonzero(new)
    size = np.diff(starts, append=len(data))
    if size.max(initial=0) > _LONGEST:
        more = []
        for a, n in zip(starts[size > _LONGEST].tolist(), size[size > _LONGEST].tolist(), strict=True):
            cut = np.arange(a + _LONGEST, a + n, _LONGEST)
            for _ in range(3):
                cut = np.where((data[cut] & 0xC0) == 0x80, cut - 1, cut)
            more.append(cut)
        starts = np.sort(np.concatenate([starts, *more]))
    return starts


def _part(data: np.ndarray, starts: np.ndarray, v: Vocabulary, of: np.ndarray, place: np.ndarray, kept: _Kept | None, keep: bool) -> _Part:
    """The lattices of the units of a block of bytes that begin at starts, after those kept, which grow if keep. Units are told apart by hashes of 64 bits."""
    ends = np.append(starts[1:], len(data))
    h = hash_short_runs(data, starts, ends)
    unit = kept.find(h) if kept else np.full(len(h), -1)
    miss = np.flatnonzero(unit < 0)
    known = len(kept.hashes) if kept else 0
    lat = kept.lat if kept else None
    if len(miss):
        fresh, one, of_fresh = np.unique(h[miss], return_index=True, return_inverse=True)
        raw = data.tobytes()
        lat = Lattice([raw[a:b].decode(errors="surrogateescape") for a, b in zip(starts[miss[one]].tolist(), ends[miss[one]].tolist(), strict=True)], v)
        lat = lat.after(kept.lat) if kept else lat
        unit[miss] = known + of_fresh
        if keep and known + len(fresh) <= _KEPT_UNITS:
            names = np.concatenate([kept.hashes, fresh]) if kept else fresh
            numbers = np.concatenate([kept.numbers, np.arange(known, known + len(fresh))]) if kept else np.arange(len(fresh))
            order = np.argsort(names)
            _kept.clear()
            _kept[id(v)] = _Kept(v, names[order], numbers[order], lat)
    return _Part(lat, of, lat.first[unit], place)


@dataclass
class Sampled:
    """k segmentations of some texts: by path, ids one after the other, and where each text's begin; which texts have the path; the numbers by path and text."""

    ids: list[np.ndarray]
    offsets: list[np.ndarray]
    live: list[np.ndarray]
    logp: np.ndarray
    value: np.ndarray
    log_inclusion: np.ndarray


def _ids_of(lat: Lattice, edge: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of pieces along edges, and how many each edge gives."""
    ids = lat.piece[edge]
    back = np.flatnonzero(ids < 0)
    width = np.ones(len(ids), np.int64)
    if not len(back):
        return ids, width
    odd = [[v.bytes_[b] for b in chr(c).encode(errors="surrogateescape")] for c in lat.odd[-1 - ids[back]].tolist()]
    width[back] = [len(x) for x in odd]
    out = np.repeat(ids, width)
    out[np.repeat(ids < 0, width)] = [i for x in odd for i in x]
    return out, width


def sample(data: np.ndarray, ends: np.ndarray, key: np.ndarray, v: Vocabulary, k: int) -> Sampled:
    """Draws segmentations of texts that lie end to end in data (ends: where each ends); each text that isn't empty begins with a space."""
    n = len(ends)
    begin = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    starts = np.empty(0, np.int64)
    if len(data):
        starts = _units(data, begin[ends > begin])
    of = np.searchsorted(ends, starts, "right")
    place = np.arange(len(of)) - np.searchsorted(of, of)
    cuts = [0]  # parts of a long text: whole units of about _AT_ONCE bytes
    while len(data) - (starts[cuts[-1]] if len(starts) else 0) > 2 * _AT_ONCE:
        cuts.append(int(np.searchsorted(starts, starts[cuts[-1]] + _AT_ONCE)))
    cuts.append(len(starts))
    held: dict[int, _Part] = {}
    kept, m = _kept.get(id(v)), len(cuts) - 1

    def part(p: int) -> _Part:
        if p not in held:
            held.clear()
            a, b = cuts[p], cuts[p + 1]
            if a == b:
                lat = Lattice([" "], v)
                held[p] = _Part(lat, of[a:b], np.zeros(0, np.int32), place[a:b])
            else:
                z = starts[b] if b < len(starts) else len(data)
                held[p] = _part(data[starts[a] : z], starts[a:b] - starts[a], v, of[a:b], place[a:b], kept, m == 1)
        return held[p]

    paths, live, values, logps, threshold = _sample(part, m, n, key, k)
    ids, offsets = [[] for _ in range(k)], [np.zeros(n + 1, np.int64) for _ in range(k)]
    for p in range(m):
        one = part(p)
        first_token = np.searchsorted(one.of, np.arange(n + 1))
        for s in range(k):
            got, width = _ids_of(one.lat, paths[s][p].edge, v)
            ids[s].append(got)
            offsets[s] += np.concatenate([[0], np.cumsum(width)])[paths[s][p].offset[first_token]]
    return Sampled([np.concatenate(x).astype(np.int32) for x in ids], offsets, live, logps, values, _log_inclusion(logps, threshold[None]))


def _log_inclusion(logp: np.ndarray, threshold: np.ndarray) -> np.ndarray:
    """log(1 - exp(-exp(logp - threshold))), 0 where there is no threshold"""
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        x = logp - threshold
        out = np.where(x < -30, x, np.log(-np.expm1(-np.exp(np.minimum(x, 700.0)))))
    return np.where(threshold == -np.inf, 0.0, out)


@dataclass
class Segmentation:
    ids: np.ndarray
    logp: float
    value: float
    log_inclusion: float


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts that aren't empty with a space before each, end to end, and where each ends."""
    data = np.frombuffer(b"".join(b" " + t if t else b"" for t in texts), np.uint8)
    return data, np.cumsum([len(t) + 1 if t else 0 for t in texts], dtype=np.int64)


def _keys(ids: list[int | None], seed: int) -> np.ndarray:
    """A hash of each row's key; rows without one have one of their own."""
    missing = np.array([x is None for x in ids], bool)
    h = mix(np.array([((x or 0) + seed * 0x9E3779B9) % (1 << 64) for x in ids], np.uint64) + np.uint64(1))
    return np.where(missing, mix(h ^ np.uint64(0x6A09E667F3BCC909)), h)


def segment(texts: list[str | None], keys: list[int | None], v: Vocabulary, k: int, seed: int = 0) -> Iterator[list[Segmentation]]:
    """For each text its drawn segmentations, the one with the largest value first."""
    got = sample(*_joined([(t or "").encode() for t in texts]), _keys(keys, seed), v, k)
    for i in range(len(texts)):
        yield [Segmentation(got.ids[s][got.offsets[s][i] : got.offsets[s][i + 1]], float(got.logp[s, i]), float(got.value[s, i]), float(got.log_inclusion[s, i])) for s in range(k) if got.live[s][i]]


def _each(batches, v: Vocabulary, k: int, seed: int):
    """For slices of batches: ids of rows, the bytes that were sampled with their ends, and what was drawn."""
    for part, texts in slices(batches, "text", _AT_ONCE):
        ids = part.column(part.schema.get_field_index("doc_id")).to_pylist()
        data, ends = _joined([t or b"" for t in texts])
        yield ids, data, ends, sample(data, ends, _keys(ids, seed), v, k)


def _bytes_of(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"))


def encode(docs: DataFrame, vocabulary: Vocabulary, k: int = 2, seed: int = 0) -> DataFrame:
    """One row (doc_id, sample, ids, logp, value, log_inclusion) for each drawn segmentation of each row's text."""
    prepare(docs.sparkSession)

    def run(batches):
        for ids, _, _, got in _each(batches, vocabulary, k, seed):
            for s in range(k):
                own = np.flatnonzero(got.live[s])
                # a text without this path has no ids, so those of the others lie end to end
                lists = pa.ListArray.from_arrays(pa.array(np.append(got.offsets[s][own], len(got.ids[s])), pa.int32()), pa.array(got.ids[s]))
                rows = [pa.array([ids[i] for i in own.tolist()], pa.int64()), pa.array(np.full(len(own), s, np.int32)), lists, *[pa.array(x[s][own]) for x in (got.logp, got.value, got.log_inclusion)]]
                yield pa.RecordBatch.from_arrays(rows, names=["doc_id", "sample", "ids", "logp", "value", "log_inclusion"])

    return _bytes_of(docs).mapInArrow(run, "doc_id long, sample int, ids array<int>, logp double, value double, log_inclusion double")


def decode(encoded: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Adds text, decoded from ids; null ids give null."""
    prepare(encoded.sparkSession)
    from pyspark.sql.types import StringType

    @F.pandas_udf(StringType())
    def text(ids: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else vocabulary.decode(x) for x in ids], dtype=object)

    return encoded.withColumn("text", text("ids"))


def digests(docs: DataFrame, vocabulary: Vocabulary, k: int = 2, seed: int = 0) -> DataFrame:
    """As encode, with each segmentation's number of pieces and the SHA-256 of its ids (little-endian, 32 bits) in place of ids, and whether decoding gave the text back."""
    prepare(docs.sparkSession)

    def run(batches):
        raw = np.frombuffer(b"".join(vocabulary.raw), np.uint8)
        size = np.array([len(x) for x in vocabulary.raw], np.int64)
        first = np.cumsum(size) - size
        for ids, data, ends, got in _each(batches, vocabulary, k, seed):
            begin = np.concatenate([[0], ends[:-1]])
            for s in range(k):
                own = np.flatnonzero(got.live[s])
                a, z = got.offsets[s][:-1][own], got.offsets[s][1:][own]
                ids_le = got.ids[s].astype("<i4").tobytes()
                sha = [hashlib.sha256(ids_le[4 * x : 4 * y]).hexdigest() for x, y in zip(a.tolist(), z.tolist(), strict=True)]
                n = size[got.ids[s]]
                text = raw[_spans(first[got.ids[s]], n)]
                at = np.concatenate([[0], np.cumsum(n)])
                same = at[z] - at[a] == ends[own] - begin[own]
                if same.all():  # decoded texts lie as the given ones do
                    want = data[_spans(begin[own], ends[own] - begin[own])] if len(own) < len(ids) else data
                    wrong = np.flatnonzero(want != text)
                    same[np.searchsorted(at[z], wrong, "right")] = False
                else:
                    same = np.array([text[at[x] : at[y]].tobytes() == data[b:e].tobytes() for x, y, b, e in zip(a, z, begin[own], ends[own], strict=True)], bool)
                rows = [pa.array([ids[i] for i in own.tolist()], pa.int64()), pa.array(np.full(len(own), s, np.int32)), pa.array(z - a), pa.array(sha, pa.string()), pa.array(same), *[pa.array(x[s][own]) for x in (got.logp, got.value, got.log_inclusion)]]
                yield pa.RecordBatch.from_arrays(rows, names=["doc_id", "sample", "n_pieces", "ids_sha256", "decoded", "logp", "value", "log_inclusion"])

    return _bytes_of(docs).mapInArrow(run, "doc_id long, sample int, n_pieces long, ids_sha256 string, decoded boolean, logp double, value double, log_inclusion double")
