"""DartMinHash: fast weighted minwise signatures.

Darts are thrown at the plane of weight and rank. Where they fall depends on the
element only, so all sets see the same darts; a set holds the darts of its
elements that lie below its weights. Each dart belongs to one of k coordinates and
a coordinate's signature is its dart of least rank. Two sets agree in a coordinate
with the probability of their weighted Jaccard similarity. (Christiani, 2020.)
"""

from __future__ import annotations

import numpy as np

from autuario.llm.words import mix

#: Cumulative probabilities of 0, 1, 2, ... darts in a region of area 1 (Poisson).
_POISSON = np.cumsum(np.exp(-1.0) / np.cumprod(np.concatenate([[1.0], np.arange(1.0, 20.0)])))
#: Ranks have so many fractional bits in a signature; the bits above hold the whole part, those below the dart.
_FRACTION, _DART = 20, 24
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def _unit(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(11)).astype(np.float64) * 2.0**-53


def _throw(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, start: np.ndarray, limit: np.ndarray, k: int, least: np.ndarray) -> None:
    """Lower ``least[doc * k + coordinate]`` to the least dart with a rank from the set's start to its limit.

    Regions are [2^v - 1, 2^(v+1) - 1) in weight by 2^-v in rank, hence of area 1,
    and only those below an element's weight and in its set's ranks are visited.
    """
    level = 0
    own_limit, own_start = limit[doc], start[doc]
    whole = bool(len(weight)) and weight.min() >= 1
    while True:
        low, width = 2.0**level - 1, 2.0**level
        height = 1 / width
        at = np.flatnonzero(weight > low) if level or not whole else np.arange(len(weight))
        if not len(at):
            return
        row = int(own_start[at].min() / height)
        while len(at):
            at = at[own_limit[at] > row * height]
            now = at[own_start[at] < (row + 1) * height]
            if not len(at):
                break
            tag = np.uint64((level << 48) | (row + 1))
            cell = mix(element[now] ^ mix(np.array([tag], np.uint64)))
            chance = _unit(cell)
            on, m = np.flatnonzero(chance >= _POISSON[0]), 0
            while len(on):
                dart = mix(cell[on] + np.uint64((m + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
                where = now[on]
                rank = (row + _unit(mix(dart + np.uint64(1)))) * height
                hit = rank < own_limit[where]
                if level or not whole:
                    hit &= low + _unit(mix(dart + np.uint64(2))) * width < weight[where]
                where, dart, rank = where[hit], dart[hit], rank[hit]
                value = (np.minimum(rank, 2.0**19) * 2.0**_FRACTION).astype(np.uint64) << np.uint64(_DART)
                value |= dart & np.uint64(2**_DART - 1)
                np.minimum.at(least, doc[where] * k + ((dart >> np.uint64(32)) % np.uint64(k)).astype(np.int64), value)
                m += 1
                on = on[chance[on] >= _POISSON[m]] if m < len(_POISSON) else on[:0]
            row += 1
        level += 1


def signatures(doc: np.ndarray, element: np.ndarray, weight: np.ndarray | None, n: int, k: int) -> np.ndarray:
    """The signatures of ``n`` sets: an (n, k) array, all EMPTY for a set without elements.

    ``doc`` (0..n-1, any order), ``element`` (64-bit hash) and ``weight`` describe the
    sets; without weights each counts 1 and repeats change nothing. Weights need a
    scale at which a usual one is about 1; zero and negative ones don't count.
    """
    least = np.full(n * k, EMPTY, np.uint64)
    w = np.ones(len(doc)) if weight is None else weight.astype(np.float64)
    total = np.bincount(doc, np.maximum(w, 0), n)
    darts = k * np.log(k) + 2 * k
    limit = darts / np.maximum(total, 1e-300)
    limit[total <= 0] = 0
    start, part = np.zeros(n), np.arange(len(doc))
    while True:
        _throw(doc[part], element[part], w[part], start, limit, k, least)
        open_ = (least.reshape(n, k) == EMPTY).any(axis=1) & (total > 0)
        if not open_.any():
            return least.reshape(n, k)
        start = np.where(open_, limit, np.inf)  # sets with an empty coordinate go on where they stopped
        limit = limit * 1.4
        part = np.flatnonzero(open_[doc])
