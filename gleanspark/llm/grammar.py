"""Re-Pair grammars of many token sequences at once.

Re-Pair replaces a pair of symbols that occurs often by a new symbol, again and again; the new symbols
are the rules of a grammar that writes the sequence. Here a round replaces, in all sequences of a block
together, every pair that outranks both its neighbours, so a grammar needs a few rounds instead of one
pass a rule.
"""

from __future__ import annotations

import numpy as np
import pandas as pd

from .kernel import mix

_A = np.uint64(0xC2B2AE3D27D4EB4F)
_B = np.uint64(0x165667B19E3779F9)


def _select(rank: np.ndarray) -> np.ndarray:
    """Places of pairs that outrank their neighbours; of a run of equal ones every second place."""
    n = len(rank)
    edge = np.flatnonzero(np.concatenate([[True], rank[1:] != rank[:-1]]))
    size = np.diff(np.append(edge, n))
    value = rank[edge]
    left = np.concatenate([[0], value[:-1]]).astype(np.uint64)
    right = np.concatenate([value[1:], [0]]).astype(np.uint64)
    top = (value > 0) & (value > left) & (value > right)
    run = np.repeat(np.arange(len(edge)), size)
    return np.flatnonzero(top[run] & ((np.arange(n) - edge[run]) % 2 == 0))


def _merge(h: np.ndarray, doc: np.ndarray, weight: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    h, weight = h.copy(), weight.copy()
    h[at] = mix(h[at] * _A + h[at + 1] * _B)
    weight[at] += weight[at + 1]
    keep = np.ones(len(h), bool)
    keep[at + 1] = False
    return h[keep], doc[keep], weight[keep]


def repair(h: np.ndarray, doc: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Grammar of each sequence: its length, the size of its grammar (start rule and rules), and symbols covered by rules of 8 and more.

    Rounds go on until no pair of any sequence can be replaced twice.
    """
    length = np.bincount(doc, minlength=n_docs)
    rules = np.zeros(n_docs, np.int64)
    final = np.zeros(n_docs, np.int64)
    covered = np.zeros(n_docs, np.int64)
    weight = np.ones(len(h), np.int64)
    while len(h) > 1:
        pair = mix(h[:-1] * _A + h[1:] * _B)
        same = doc[1:] == doc[:-1]
        own = pair ^ mix(doc[:-1].astype(np.uint64) + np.uint64(1))
        codes, uniq = pd.factorize(own)
        often = np.bincount(codes[same], minlength=len(uniq))[codes]
        often[~same] = 0
        rank = np.where(often >= 2, (np.minimum(often, (1 << 20) - 1).astype(np.uint64) << np.uint64(40)) | (pair >> np.uint64(24)), np.uint64(0))
        at = _select(rank)
        used = np.bincount(codes[at], minlength=len(uniq))
        at = at[used[codes[at]] >= 2]
        done = np.bincount(doc[at], minlength=n_docs)
        rules += np.bincount(doc[at[np.unique(codes[at], return_index=True)[1]]], minlength=n_docs)
        # Sequences that no longer change leave the block.
        idle = done[doc] == 0
        if idle.any():
            final += np.bincount(doc[idle], minlength=n_docs)
            covered += np.bincount(doc[idle], weights=np.where(weight[idle] >= 8, weight[idle], 0), minlength=n_docs).astype(np.int64)
        if not len(at):
            h = h[:0]
            break
        mask = ~idle
        at = (np.cumsum(mask) - 1)[at]
        h, doc, weight = _merge(h[mask], doc[mask], weight[mask], at)
    if len(h):
        final += np.bincount(doc, minlength=n_docs)
        covered += np.bincount(doc, weights=np.where(weight >= 8, weight, 0), minlength=n_docs).astype(np.int64)
    return length, final + 2 * rules, covered


def phrases(h: np.ndarray, doc: np.ndarray, rounds: int = 8) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Phrases of each sequence that come out alike wherever the same passage stands: hash, sequence, symbols.

    The pairs to replace are ranked by their hashes alone, so two sequences that share a passage replace the
    same pairs in it and get the same rules, but for a few at its ends. ``rounds`` sets how long the passages are that are
    compared (some 25 symbols for 8 rounds); it cuts nothing off, since the phrases of any number of rounds make up the sequence.
    """
    weight = np.ones(len(h), np.int64)
    for r in range(rounds):
        if len(h) < 2:
            break
        rank = mix(h[:-1] * _A + h[1:] * _B + np.uint64(r)) >> np.uint64(1) | np.uint64(1)
        rank[doc[1:] != doc[:-1]] = 0
        h, doc, weight = _merge(h, doc, weight, _select(rank))
    return h, doc, weight
