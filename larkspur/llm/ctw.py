"""The numeric core of context-tree weighting over bytes, vectorised.

A context is the bytes before a position, the nearest first; a gram is a context
of full depth and the byte that follows, packed into one integer with the
nearest context byte highest.  A byte is coded by eight binary decisions, each
with a context tree of its own.  At a context s a decision's zeros and ones have
the Krichevsky-Trofimov probability KT(s); the weighted probability is
W(s) = KT(s) / 2 + product of W over the longer contexts / 2, and W(s) = KT(s) at
full depth.  A decision is predicted by mixing all depths with the weights that
training leaves: a(s) = KT(s) / 2 / W(s) for s itself, 1 - a(s) for what is longer.
A context that training never saw predicts as the next shorter one.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

HALF = np.log(0.5)
#: Stands before and behind a text: a byte that no text in UTF-8 holds.
END = 255
_TABLE = 1 << 12
_STEPS = np.arange(_TABLE, dtype=np.float64)
_LOG_GAMMA_HALF = 0.5 * np.log(np.pi) + np.r_[0, np.cumsum(np.log(_STEPS[:-1] + 0.5))]  # log gamma(n + 1/2)
_LOG_FACTORIAL = np.r_[0, np.cumsum(np.log(_STEPS[1:]))]  # log gamma(n + 1)


def _stirling(x: np.ndarray) -> np.ndarray:
    return (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + 1 / (12 * x) - 1 / (360 * x**3)


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """log of the Krichevsky-Trofimov probability of a sequence with these counts."""

    def gamma(n: np.ndarray, table: np.ndarray, shift: float) -> np.ndarray:
        return np.where(n < _TABLE, table[np.minimum(n, _TABLE - 1)], _stirling(np.maximum(n, 1) + shift))

    return gamma(zeros, _LOG_GAMMA_HALF, 0.5) + gamma(ones, _LOG_GAMMA_HALF, 0.5) - gamma(zeros + ones, _LOG_FACTORIAL, 1.0) - np.log(np.pi)


@dataclass
class Depth:
    """Grams cut to one depth (sorted, distinct), and for each of the eight decisions the node of every gram."""

    grams: np.ndarray
    count: np.ndarray
    nodes: list[np.ndarray] = field(default_factory=list)  # gram -> node
    first: list[np.ndarray] = field(default_factory=list)  # node -> its first gram
    total: list[np.ndarray] = field(default_factory=list)
    ones: list[np.ndarray] = field(default_factory=list)
    log_w: list[np.ndarray] = field(default_factory=list)
    log_a: list[np.ndarray] = field(default_factory=list)


def depth(grams: np.ndarray, count: np.ndarray) -> Depth:
    held = Depth(grams, count)
    symbol = (grams & np.uint64(255)).astype(np.int64)
    for b in range(8):
        name = (grams >> np.uint64(8 - b)) if b else grams >> np.uint64(8)
        start = np.r_[True, name[1:] != name[:-1]] if len(grams) else np.zeros(0, bool)
        first = np.flatnonzero(start)
        held.first.append(first)
        held.nodes.append(np.cumsum(start) - 1)
        held.total.append(np.add.reduceat(count, first) if len(first) else count)
        held.ones.append(np.add.reduceat(count * ((symbol >> (7 - b)) & 1), first) if len(first) else count)
    return held


def shorten(held: Depth) -> tuple[Depth, np.ndarray]:
    """The grams with one context byte less, and where each gram went."""
    cut = ((held.grams >> np.uint64(16)) << np.uint64(8)) | (held.grams & np.uint64(255))
    short, at = np.unique(cut, return_inverse=True)
    return depth(short, np.bincount(at, held.count, len(short)).astype(np.int64)), at


def weigh(held: Depth, below: list[np.ndarray] | None) -> None:
    """Fill in W and a; below: for each decision the summed log W of the longer contexts of every node, None at full depth."""
    for b in range(8):
        kt = log_kt(held.total[b] - held.ones[b], held.ones[b])
        if below is None:
            held.log_w.append(kt)
            held.log_a.append(np.zeros(len(kt)))
        else:
            w = np.logaddexp(kt, below[b]) + HALF
            held.log_w.append(w)
            held.log_a.append(HALF + kt - w)


def gathered(longer: Depth, shorter: Depth, at: np.ndarray) -> list[np.ndarray]:
    """For each decision, the summed log W of the longer contexts of every node of the shorter depth."""
    return [np.bincount(shorter.nodes[b][at[longer.first[b]]], longer.log_w[b], len(shorter.total[b])) for b in range(8)]


def grow(grams: np.ndarray, count: np.ndarray, full: int, least: int) -> tuple[list[Depth], list[np.ndarray]]:
    """The depths full, full - 1, ..., least of sorted grams, and the places from each to the next."""
    depths, ups = [depth(grams, count)], []
    weigh(depths[0], None)
    for _ in range(full - least):
        short, at = shorten(depths[-1])
        weigh(short, gathered(depths[-1], short, at))
        depths.append(short)
        ups.append(at)
    return depths, ups


@dataclass
class Mixture:
    """The state of the eight predictions of every gram on the way from the root to longer contexts."""

    done: np.ndarray  # (8, grams) probability gathered so far
    rest: np.ndarray  # weight of the contexts still to come
    last: np.ndarray  # prediction of the longest context seen

    @classmethod
    def start(cls, n: int) -> Mixture:
        return cls(np.zeros((8, n)), np.ones((8, n)), np.full((8, n), 0.5))

    def step(self, b: int, total: np.ndarray, hits: np.ndarray, log_a: np.ndarray) -> None:
        """total and hits: a node's count and its count of the gram's own bit; a node without counts ends the path."""
        seen = total > 0
        kt = np.where(seen, (hits + 0.5) / (total + 1.0), self.last[b])
        a = np.where(seen, np.exp(log_a), 1.0)
        self.done[b] += self.rest[b] * a * kt
        self.rest[b] *= 1 - a
        self.last[b] = kt

    def take(self, at: np.ndarray) -> Mixture:
        return Mixture(self.done[:, at], self.rest[:, at], self.last[:, at])

    def log10(self) -> np.ndarray:
        return np.log10(self.done + self.rest * self.last).sum(0)


def walk(mixture: Mixture, depths: list[Depth], ups: list[np.ndarray]) -> Mixture:
    """Carry a mixture over the grams of the shortest depth on to those of the longest."""
    for i in range(len(depths) - 1, -1, -1):
        held = depths[i]
        for b in range(8):
            bit = ((held.grams >> np.uint64(7 - b)) & np.uint64(1)).astype(bool)
            node = held.nodes[b]
            ones, total = held.ones[b][node], held.total[b][node]
            mixture.step(b, total, np.where(bit, ones, total - ones), held.log_a[b][node])
        if i:
            mixture = mixture.take(ups[i - 1])
    return mixture


@dataclass
class Crown:
    """The nodes of the shortest depths as sorted tables: name (context and decision) to counts and weight."""

    names: list[np.ndarray]
    total: list[np.ndarray]
    ones: list[np.ndarray]
    log_a: list[np.ndarray]

    @staticmethod
    def name(grams: np.ndarray, b: int) -> np.ndarray:
        """A decision's node: the context, then 1 and the bits decided so far."""
        symbol = grams & np.uint64(255)
        return ((grams >> np.uint64(8)) << np.uint64(8)) | np.uint64(1 << b) | (symbol >> np.uint64(8 - b))

    @classmethod
    def of(cls, depths: list[Depth]) -> Crown:
        """From the depths 0, 1, ... in this order."""
        parts = []
        for held in depths:
            names = np.concatenate([cls.name(held.grams[held.first[b]], b) for b in range(8)])
            order = np.argsort(names)
            parts.append((names[order], *[np.concatenate(x)[order] for x in (held.total, held.ones, held.log_a)]))
        return cls(*map(list, zip(*parts, strict=True)))

    def mixture(self, grams: np.ndarray) -> Mixture:
        """The mixture of grams whose contexts have the greatest depth held here."""
        out = Mixture.start(len(grams))
        top = len(self.names) - 1
        for d in range(top + 1):
            cut = ((grams >> np.uint64(8 * (top - d) + 8)) << np.uint64(8)) | (grams & np.uint64(255))
            names, total, ones, log_a = self.names[d], self.total[d], self.ones[d], self.log_a[d]
            for b in range(8):
                if not len(names):
                    continue
                want = self.name(cut, b)
                at = np.minimum(np.searchsorted(names, want), len(names) - 1)
                here = names[at] == want
                n = np.where(here, total[at], 0)
                k = np.where(here, ones[at], 0)
                bit = ((grams >> np.uint64(7 - b)) & np.uint64(1)).astype(bool)
                out.step(b, n, np.where(bit, k, n - k), log_a[at])
        return out


def grams_of(text: np.ndarray, full: int) -> np.ndarray:
    """The gram at every position of a text and at its end; before and behind the text lie END bytes."""
    long = np.concatenate([np.full(full, END, np.uint8), text, np.full(1, END, np.uint8)]).astype(np.uint64)
    n = len(text) + 1
    out = long[full:].copy()
    for d in range(1, full + 1):
        out |= long[full - d : full - d + n] << np.uint64(8 * (full - d + 1))
    return out
