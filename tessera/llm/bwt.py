"""Burrows-Wheeler transforms of string collections, and their merging.

A shard's strings are sorted by suffix once, on their own. Merging doesn't sort suffixes again: it
refines an interleave, the order in which the shards' rows alternate. It starts with the shards one after the other;
each round reads the shards' transforms in the order of the interleave and deals the rows stably by the symbol read, after which the
interleave is right for one more symbol of context. A boundary between neighbouring rows that appears in
round h means that their common prefix has h - 1 symbols, so the rounds also give the common prefixes;
rows without a boundary after `depth` rounds form a repeated interval of at least that length.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Shard:
    """text: all strings, each followed by a 0; suffix: positions in text by suffix order; last: the symbol before each."""

    text: np.ndarray
    suffix: np.ndarray
    last: np.ndarray


def build(strings: list[np.ndarray]) -> Shard:
    """Sorts the suffixes of strings of symbols from 1 on. Ends of strings sort before all symbols, and by string among themselves."""
    n = sum(len(s) + 1 for s in strings)
    text = np.zeros(n, np.int64)
    at = 0
    for s in strings:
        text[at : at + len(s)] = s
        at += len(s) + 1
    return _sorted(text)


def build_equal(strings: np.ndarray) -> Shard:
    """As build, for strings of one length as the rows of a matrix."""
    return _sorted(np.concatenate([strings, np.zeros((len(strings), 1), strings.dtype)], axis=1).ravel().astype(np.int64))


def _sorted(text: np.ndarray) -> Shard:
    n = len(text)
    ends = np.flatnonzero(text == 0)
    # ranks by prefixes whose length doubles; an end differs from every other end, so none reaches into the next string
    rank = text + len(ends)
    rank[ends] = np.arange(len(ends))
    step = 1
    while True:
        order = np.argsort(rank, kind="stable")
        r = rank[order]
        new = np.concatenate([[True], r[1:] != r[:-1]])
        if new.all():
            break
        dense = np.empty(n, np.int64)
        dense[order] = np.cumsum(new) - 1
        following = np.zeros(n, np.int64)
        following[: max(n - step, 0)] = dense[step:] + 1
        rank = dense * (n + 1) + following
        step *= 2
    before = np.empty(n, np.int64)
    before[1:] = text[:-1]
    before[0] = 0
    return Shard(text, order, before[order])


def merge(shards: list[Shard], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The interleave after at most depth rounds: the shard of each row, its place in that shard's order, and
    for each row the length of the prefix that it shares with the row before, counted up to depth."""
    sizes = [len(s.last) for s in shards]
    base = np.cumsum([0, *sizes])[:-1]
    n = sum(sizes)
    last = np.concatenate([s.last for s in shards])
    small = last.astype(np.uint16) if last.max(initial=0) < 1 << 16 else last
    z = np.repeat(np.arange(len(shards)), sizes)
    ends = np.repeat(np.arange(len(shards)), [int((s.text == 0).sum()) for s in shards])
    block = np.zeros(n, np.int64)
    found = np.full(n, -1, np.int64)  # the round in which the boundary before a row appeared
    found[:1] = 0
    for h in range(1, depth + 1):
        place = _places(z, len(shards))
        symbols = small[base[z] + place]
        order = np.argsort(symbols, kind="stable")
        dealt, of = symbols[order], block[order]
        edge = np.ones(n, bool)
        edge[1:] = (dealt[1:] != dealt[:-1]) | (of[1:] != of[:-1]) | (dealt[1:] == 0)  # ends all differ
        z = z[order]
        z[: len(ends)] = ends  # an end's place follows from its string alone
        fresh = edge & (found < 0)
        found[fresh] = h
        block = np.cumsum(edge)
        if edge.all():
            break
    common = np.where(found < 0, depth, np.maximum(found - 1, 0))
    return z, _places(z, len(shards)), common


def _places(z: np.ndarray, shards: int) -> np.ndarray:
    place = np.empty(len(z), np.int64)
    for k in range(shards):
        own = np.flatnonzero(z == k)
        place[own] = np.arange(len(own))
    return place


def repeated(common: np.ndarray, depth: int) -> np.ndarray:
    """Which rows share a prefix of depth symbols with a neighbour: those in repeated intervals."""
    same = common >= depth
    same[:1] = False
    out = same.copy()
    out[:-1] |= same[1:]
    return out
