"""Byte-pair encoding under a public rank file, in two ways.

``count_symbols`` merges a linked list of symbols through a priority queue and counts what survives.
``encode_sorted`` walks the trie of many words at once: each trie node holds the last token of the
encoding of the prefix it stands for, and a prefix shared by many words is computed once.
"""

from __future__ import annotations

import base64
import heapq
from array import array

import numpy as np

from . import kernel

#: Pieces kept between blocks by one worker; beyond it the cache starts afresh (results stay the same).
CACHE = 400_000


class Ranks:
    """Mergeable ranks and what is derived from them on demand."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.rank = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.token = {r: t for t, r in self.rank.items()}
        self.suffixes = {t[i:] for t in self.rank for i in range(len(t))}
        self._split: dict[int, tuple[int, int] | None] = {}
        self._meets: dict[tuple[int, int], bool] = {}

    # -- linked list and priority queue

    def merge(self, piece: bytes, below: int | None = None) -> list[int]:
        """Token ids of one piece; with ``below``, only merges of a smaller rank are made."""
        rank = self.rank
        n = len(piece)
        sym: list[bytes | None] = [piece[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            r = rank.get(piece[i : i + 2])
            if r is not None and (below is None or r < below):
                heap.append((r, i, 2))
        heapq.heapify(heap)
        while heap:
            r, i, size = heapq.heappop(heap)
            a = sym[i]
            if a is None or (j := after[i]) >= n or len(a) + len(sym[j]) != size:
                continue
            both = a + sym[j]
            if rank.get(both) != r:
                continue
            sym[i], sym[j] = both, None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                self._push(heap, sym, i, k, below)
            if (h := before[i]) >= 0:
                self._push(heap, sym, h, i, below)
        return [rank[s] for s in sym if s is not None]

    def _push(self, heap, sym, i, j, below):
        both = sym[i] + sym[j]
        r = self.rank.get(both)
        if r is not None and (below is None or r < below):
            heapq.heappush(heap, (r, i, len(both)))

    # -- last tokens of prefixes

    def halves(self, t: int) -> tuple[int, int] | None:
        """The two tokens whose merge made t; None for a single byte."""
        if t not in self._split:
            b = self.token[t]
            parts = self.merge(b, t) if len(b) > 1 else []
            self._split[t] = (parts[0], parts[1]) if len(parts) == 2 else None
        return self._split[t]

    def meets(self, a: int, b: int) -> bool:
        """Whether a and b stay two tokens when they stand side by side.

        Walk back in time: undo the younger of the two tokens at the seam and see whether the
        pair then at the seam would have merged before the merge that was undone.
        """
        known = self._meets.get((a, b))
        if known is None:
            known = self._meets[a, b] = self._seam(a, b)
        return known

    def _seam(self, a: int, b: int) -> bool:
        token, rank = self.token, self.rank
        x, y, until = a, b, 1 << 62
        while True:
            r = rank.get(token[x] + token[y])
            if r is not None and r < until:
                return False
            left, right = self.halves(x), self.halves(y)
            if left is None and right is None:
                return True
            # Of equal merges the left one is made first, so the right one is the younger.
            if left is not None and (right is None or x > y):
                x, until = left[1], x
            else:
                y, until = right[0], y + 1

    def encode_sorted(self, words: list[bytes]) -> list[bytes]:
        """Ids (as int32 bytes) of each of the distinct words, which must be sorted.

        Sorted words are the trie's leaves in depth-first order, so the path from the root to the
        current leaf is one stack, and the next word keeps the part of it that it shares.
        """
        vocabulary, suffixes, meets = self.rank, self.suffixes, self.meets
        last: list[int] = [-1]
        size: list[int] = [0]
        out: list[bytes] = []
        old = b""
        for w in words:
            n, keep = len(w), 0
            top = min(n, len(old))
            if old[:top] == w[:top]:
                keep = top
            else:
                while old[keep] == w[keep]:
                    keep += 1
            del last[keep + 1 :], size[keep + 1 :]
            for d in range(keep + 1, n + 1):
                # Tokens that end here, the longest that meets its forerunner being the one.
                ends = []
                s = d - 1
                while s >= 0 and (suffix := w[s:d]) in suffixes:
                    if (t := vocabulary.get(suffix)) is not None:
                        ends.append((t, s))
                    s -= 1
                for t, s in reversed(ends):
                    if (s == 0 and (d == 1 or self.halves(t) is not None)) or (s and meets(last[s], t)):
                        last.append(t)
                        size.append(d - s)
                        break
            ids = array("i")
            d = n
            while d:
                ids.append(last[d])
                d -= size[d]
            ids.reverse()
            out.append(ids.tobytes())
            old = w
        return out


_loaded: dict[str, Ranks] = {}
_counts: dict[str, dict[str, int]] = {}
_ids: dict[str, dict[str, bytes]] = {}


def load(path: str) -> Ranks:
    if path not in _loaded:
        _loaded[path] = Ranks(path)
    return _loaded[path]


def _known(caches: dict[str, dict], path: str) -> dict:
    """The pieces that this worker has met, by their own characters, never by a hash of them."""
    known = caches.setdefault(path, {})
    if len(known) > CACHE:
        known.clear()
    return known


def count_tokens(texts: list[str | None], path: str) -> np.ndarray:
    """Tokens of each text: every distinct piece is merged once and weighted by its frequency."""
    some, whose = kernel.parts(texts, kernel.PIECE_BORDER)
    out = np.zeros(len(some), np.int64)
    for lo, hi in kernel.blocks(some):
        joined, at, stop, cp, first = kernel.pieces(some[lo:hi])
        if not len(at):
            continue
        codes, place = kernel.distinct(cp, at, stop)
        known, ranks = _known(_counts, path), load(path)
        per = np.empty(len(place), np.int64)
        for i, (s, t) in enumerate(zip(at[place].tolist(), stop[place].tolist())):
            x = joined[s:t]
            n = known.get(x)
            if n is None:
                b = x.encode()
                n = known[x] = 1 if b in ranks.rank else len(ranks.merge(b))
            per[i] = n
        total = np.concatenate([[0], np.cumsum(per[codes])])
        out[lo:hi] = np.diff(total[first])
    return _sums(out, whose, len(texts))


def _sums(of_parts: np.ndarray, whose: np.ndarray, n: int) -> np.ndarray:
    """What the parts of each of ``n`` texts have together."""
    if len(of_parts) == n:
        return of_parts
    out = np.zeros(n, np.int64)
    np.add.at(out, whose, of_parts)
    return out


def encode(texts: list[str | None], path: str) -> tuple[np.ndarray, np.ndarray]:
    """Flat token ids of all texts, and how many each text has."""
    some, whose = kernel.parts(texts, kernel.PIECE_BORDER)
    flats, sizes = [], np.zeros(len(some), np.int64)
    for lo, hi in kernel.blocks(some):
        joined, at, stop, cp, first = kernel.pieces(some[lo:hi])
        if not len(at):
            continue
        codes, place = kernel.distinct(cp, at, stop)
        known = _known(_ids, path)
        xs = [joined[s:t] for s, t in zip(at[place].tolist(), stop[place].tolist())]
        if new := [x for x in xs if x not in known]:
            fresh = sorted((x.encode(), x) for x in new)
            known.update(zip([x for _, x in fresh], load(path).encode_sorted([w for w, _ in fresh])))
        pool_of = [known[x] for x in xs]
        pool = np.frombuffer(b"".join(pool_of), np.int32)
        n = np.fromiter(map(len, pool_of), np.int64, len(pool_of)) >> 2
        start = np.cumsum(n) - n
        each = n[codes]
        total = np.concatenate([[0], np.cumsum(each)])
        flats.append(pool[np.arange(total[-1]) + np.repeat(start[codes] - total[:-1], each)])
        sizes[lo:hi] = np.diff(total[first])
    return (np.concatenate(flats) if flats else np.empty(0, np.int32)), _sums(sizes, whose, len(texts))
