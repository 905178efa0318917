"""Numerical core of context-tree weighting over bytes (numpy only, no Spark).

A *gram* is a uint64: the coded byte in the low eight bits and the bytes before it, most recent first, in the
bits above, so ``gram & mask(d)`` names the pair (context of length d, byte). Each byte is coded as eight binary
decisions; decision ``i`` is taken at a node named by the context and the byte's first ``i`` bits, and every such node
position owns a context tree of its own (the binary decomposition). In each tree a node of depth d has

    Pw = 1/2 Pe(n0, n1) + 1/2 prod(Pw of its children),        Pw = Pe at the largest depth,

with Pe the Krichevsky-Trofimov probability of the node's zeros and ones. The prediction mixes the KT estimates of the
path's depths with weights ``w = 1/2 Pe / Pw``. A context not met in training ends the path: the remaining
weight goes to the deepest one that was met, so every decision's two probabilities sum to one.

The tree is cut into storeys. Below a cut, the subtrees are handled independently of each other (``subtree_sums``, ``gram_scores``);
between two cuts likewise, with what lies below given as sums (``subtree_sums`` again, ``storey``); the top, at most 256**root
rows, in one place (``crown``).
"""

from __future__ import annotations

import numpy as np

LOG_HALF = np.log(0.5)
_SMALL = np.zeros(1)


def mask(depth: int) -> np.uint64:
    return np.uint64((1 << (8 * (depth + 1))) - 1)


def grams(flat: np.ndarray, depth: int) -> np.ndarray:
    """The gram at each byte of ``flat``; the first ``depth`` positions are to be padding."""
    out = flat.astype(np.uint64)
    for j in range(1, depth + 1):
        out[j:] |= flat[:-j].astype(np.uint64) << np.uint64(8 * j)
    return out


def _ln_gamma_half(n: np.ndarray) -> np.ndarray:
    """ln Gamma(n + 1/2) by Stirling's series after a shift of eight."""
    z = n + 8.5
    out = (z - 0.5) * np.log(z) - z + 0.9189385332046727 + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5)
    low = n + 0.5
    product = low.copy()
    for k in range(1, 8):
        product *= low + k
    return out - np.log(product)


def _ln_factorial(n: np.ndarray) -> np.ndarray:
    z = n + 9.0
    out = (z - 0.5) * np.log(z) - z + 0.9189385332046727 + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5)
    product = n + 1.0
    for k in range(2, 9):
        product = product * (n + k)
    return out - np.log(product)


def _table(f, limit: int = 4096):
    known: list[np.ndarray] = []

    def look_up(n: np.ndarray) -> np.ndarray:
        if not known:
            known.append(f(np.arange(limit, dtype=float)))
        small = n < limit
        if small.all():
            return known[0][n]
        out = np.empty(len(n))
        out[small] = known[0][n[small]]
        out[~small] = f(n[~small].astype(float))
        return out

    return look_up


ln_gamma_half, ln_factorial = _table(_ln_gamma_half), _table(_ln_factorial)


def ln_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """ln of the KT probability of a sequence with so many zeros and ones."""
    return ln_gamma_half(zeros) + ln_gamma_half(ones) - ln_factorial(zeros + ones) - np.log(np.pi)


def merged(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and the sum of each one's counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


class Levels:
    """The distinct (context, byte) rows of each depth from ``low`` to ``high`` with their training counts."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, low: int, high: int):
        self.low, self.high = low, high
        self.keys, self.counts, self.up = {high: keys}, {high: counts}, {}
        for d in range(high - 1, low - 1, -1):
            short = self.keys[d + 1] & mask(d)
            self.keys[d], self.up[d + 1] = np.unique(short, return_inverse=True)
            self.counts[d] = np.bincount(self.up[d + 1], self.counts[d + 1], len(self.keys[d])).astype(np.int64)

    def nodes(self, d: int, i: int):
        """Of decision i at depth d: each row's node, the nodes' first rows, zeros and ones, and each row's bit."""
        keys = self.keys[d]
        prefix = keys >> np.uint64(8 - i)
        new = np.r_[True, prefix[1:] != prefix[:-1]]
        first = np.flatnonzero(new)
        bit = ((keys >> np.uint64(7 - i)) & np.uint64(1)).astype(np.int64)
        total = np.add.reduceat(self.counts[d], first)
        ones = np.add.reduceat(self.counts[d] * bit, first)
        return np.cumsum(new) - 1, first, total - ones, ones, bit


def weigh(levels: Levels, i: int, below: np.ndarray | None = None) -> tuple[dict, np.ndarray]:
    """Bottom-up for decision i. below: for rows of the largest depth, sums of ln Pw of the children beyond the cut;
    without it that depth is the tree's end. Returns for each depth (row's seen, weight, KT probability of the row's
    bit), and, for rows of the least depth, ln Pw at each node's first row (else 0)."""
    found, carried = {}, below
    for d in range(levels.high, levels.low - 1, -1):
        node, first, zeros, ones, bit = levels.nodes(d, i)
        pe = ln_kt(zeros, ones)
        if carried is None:
            pw = pe
        else:
            children = np.add.reduceat(carried, first)
            pw = np.logaddexp(LOG_HALF + pe, LOG_HALF + children)
        w = np.ones(len(first)) if carried is None else np.exp(LOG_HALF + pe - pw)
        seen = zeros + ones > 0
        kt = (np.where(bit == 1, ones[node], zeros[node]) + 0.5) / ((zeros + ones)[node] + 1.0)
        found[d] = seen[node], w[node], kt
        at_first = np.zeros(len(node))
        at_first[first] = np.where(seen, pw, 0.0)
        carried = np.bincount(levels.up[d], at_first, len(levels.keys[d - 1])) if d > levels.low else at_first
    return found, carried


def descend(levels: Levels, found: dict, start: tuple[np.ndarray, np.ndarray, np.ndarray]):
    """Top-down: start has, for each row of the least depth, what the depths above give: probability so far, the weight
    that is left, the deepest KT estimate. Returns the same three for rows of the largest depth."""
    sure, left, kt = start
    for d in range(levels.low, levels.high + 1):
        if d > levels.low:
            up = levels.up[d]
            sure, left, kt = sure[up], left[up], kt[up]
        seen, w, own = found[d]
        kt = np.where(seen, own, kt)
        w = np.where(seen, w, 1.0)
        sure, left = sure + left * w * kt, left * (1.0 - w)
    return sure, left, kt


def subtree_sums(keys: np.ndarray, counts: np.ndarray, depth: int, root: int, below: np.ndarray | None = None):
    """Below the cut: (context, byte) rows of depth root - 1, their counts, and for each of the eight decisions the sum of
    ln Pw of the subtrees' roots. Sums over disjoint sets of subtrees add up. below: the sums of a cut at depth + 1, if there is one."""
    levels = Levels(keys, counts, root, depth)
    rows, up = np.unique(levels.keys[root] & mask(root - 1), return_inverse=True)
    sums = np.empty((8, len(rows)))
    for i in range(8):
        sums[i] = np.bincount(up, weigh(levels, i, None if below is None else below[i])[1], len(rows))
    return rows, np.bincount(up, levels.counts[root], len(rows)).astype(np.int64), sums


def crown(rows: np.ndarray, counts: np.ndarray, sums: np.ndarray, root: int):
    """Above the cut: for each row and decision (probability so far, weight left, deepest KT estimate), as [3, 8, rows]."""
    levels, out = Levels(rows, counts, 0, root - 1), np.empty((3, 8, len(rows)))
    for i in range(8):
        found, _ = weigh(levels, i, sums[i])
        n = len(levels.keys[0])
        out[:, i] = descend(levels, found, (np.zeros(n), np.ones(n), np.full(n, 0.5)))
    return out


def storey(rows: np.ndarray, counts: np.ndarray, sums: np.ndarray, high: int, low: int, above: np.ndarray, top: np.ndarray):
    """Depths low to high, between two cuts: what crown gives, for rows of depth high, from what it (or a storey) gives for the rows above."""
    levels, out = Levels(rows, counts, low, high), np.empty((3, 8, len(rows)))
    at = np.searchsorted(above, levels.keys[low] & mask(low - 1))
    for i in range(8):
        found, _ = weigh(levels, i, sums[i])
        out[:, i] = descend(levels, found, tuple(top[k, i][at] for k in range(3)))
    return out


def gram_scores(keys: np.ndarray, counts: np.ndarray, depth: int, root: int, rows: np.ndarray, top: np.ndarray) -> np.ndarray:
    """log10 of the probability of each gram's byte after its context."""
    levels, out = Levels(keys, counts, root, depth), np.zeros(len(keys))
    at = np.searchsorted(rows, levels.keys[root] & mask(root - 1))
    for i in range(8):
        found, _ = weigh(levels, i)
        sure, left, kt = descend(levels, found, tuple(top[k, i][at] for k in range(3)))
        out += np.log10(sure + left * kt)
    return out
