"""Text kernels over whole Arrow batches.

Each works on the concatenation of a block of texts and finds every run, piece or word of it
with a fixed number of numpy passes, so no Python code runs per character or per word.
Blocks end at document borders; a text longer than a block is a block of its own, never cut.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd

#: Characters per block: small enough for its arrays to stay in cache, large enough to hide Python's overhead.
BLOCK = 1 << 19

_place: list[np.ndarray] = [np.empty(0, np.uint64)]


def blocks(texts: list[str | None], size: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of ``texts`` with about ``size`` characters each."""
    begin = held = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if held and held + n > size:
            yield begin, i
            begin, held = i, 0
        held += n + 1
    if begin < len(texts):
        yield begin, len(texts)


def parts(texts: list[str | None], border: re.Pattern, size: int = BLOCK) -> tuple[list[str | None], np.ndarray]:
    """``texts`` with each one much longer than a block cut where ``border`` matches, and the text of each part.

    A cut is made after the first character of a match, so ``border`` names two characters that never belong together.
    A run without such a place is not cut.
    """
    if all(t is None or len(t) <= 2 * size for t in texts):
        return texts, np.arange(len(texts))
    out: list[str | None] = []
    whose: list[int] = []
    for i, t in enumerate(texts):
        begin = 0
        while t is not None and len(t) - begin > 2 * size and (m := border.search(t, begin + size)):
            out.append(t[begin : m.start() + 1])
            whose.append(i)
            begin = m.start() + 1
        out.append(t[begin:] if begin else t)
        whose.append(i)
    return out, np.array(whose)


def _places(n: int) -> np.ndarray:
    """A fixed random odd number for each of the places 0..n-1 of a span."""
    if len(_place[0]) < n:
        at = np.arange(max(n, BLOCK), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x1F83D9ABFB41BD6B)
        _place[0] = mix(at) | np.uint64(1)
    return _place[0]


def span_hashes(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span values[begin:end], equal for equal contents wherever they stand. Spans are in order and don't overlap.

    Multilinear: each place of a span has a random multiplier of its own, so, unlike powers of one multiplier, no pattern of
    contents makes the terms cancel. Where a hash stands for the contents themselves, ``same_spans`` compares these.
    """
    if not len(begin):
        return np.empty(0, np.uint64)
    size = end - begin
    longest = int(size.max())
    inside = np.arange(len(values), dtype=np.int32)
    inside[begin[0] :] -= np.repeat(begin.astype(np.int32), np.diff(np.append(begin, len(values))))
    # What stands between spans is in no sum, so its place doesn't matter.
    np.minimum(inside, longest - 1, out=inside)
    terms = _places(longest)[inside]
    terms *= values + np.uint8(1) if values.dtype != np.uint8 else values.astype(np.uint16) + np.uint16(1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(terms, out=total[1:])
    return mix((total[end] - total[begin]) ^ (size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))


def same_spans(values: np.ndarray, begin: np.ndarray, end: np.ndarray, codes: np.ndarray, place: np.ndarray) -> bool:
    """Whether every span holds just what the span at ``place`` of its code holds."""
    if not len(begin):
        return True
    size = end - begin
    if not np.array_equal(size, size[place][codes]):
        return False
    # Every character is compared with the one as far into the model; those between spans are left out afterwards.
    other = np.arange(begin[0], len(values), dtype=np.int32)
    other += np.repeat((begin[place][codes] - begin).astype(np.int32), np.diff(np.append(begin, len(values))))
    np.minimum(other, len(values) - 1, out=other)
    unlike = np.flatnonzero(values[other] != values[begin[0] :]) + begin[0]
    return not (unlike < end[np.searchsorted(begin, unlike, side="right") - 1]).any()


def distinct(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code of each span's contents, and the place of one span of each code.

    Spans are met by hash and their contents compared; where two contents have one hash, codes come from the contents.
    """
    codes, uniq = pd.factorize(span_hashes(values, begin, end))
    place = np.empty(len(uniq), np.int64)
    place[codes] = np.arange(len(codes))
    if not same_spans(values, begin, end, codes, place):
        seen: dict[bytes, int] = {}
        codes = np.fromiter((seen.setdefault(values[x:y].tobytes(), len(seen)) for x, y in zip(begin.tolist(), end.tolist())), np.int64, len(begin))
        place = np.empty(len(seen), np.int64)
        place[codes] = np.arange(len(codes))
    return codes, place


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


# --- pieces of the byte-level BPE's split pattern -------------------------------------------

OTHER, LETTER, NUMBER, SPACE, END = range(5)
#: Code points with the Unicode property White_Space.
WHITE_SPACE = (9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
_classes: list[np.ndarray] = []


def classes() -> np.ndarray:
    """The class of every code point."""
    if not _classes:
        kind = {"L": LETTER, "N": NUMBER}
        table = np.fromiter((kind.get(unicodedata.category(chr(i))[0], OTHER) for i in range(0x110000)), np.uint8, 0x110000)
        table[list(WHITE_SPACE)] = SPACE
        _classes.append(table)
    return _classes[0]


#: Where a long text can be cut without changing its pieces: before white space that follows anything else.
PIECE_BORDER = re.compile("[^{0}][{0}]".format("".join(map(chr, WHITE_SPACE))))


def pieces(texts: list[str | None]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Split texts as the pattern of the byte-level BPE does.

    Returns the joined texts, each piece's begin and end in it, the code points, and for
    each text the number of pieces before it (one entry more than texts).
    """
    joined = "\n".join(t or "" for t in texts) + "\n"
    cp = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    lengths = np.fromiter((len(t) if t else 0 for t in texts), np.int64, len(texts))
    ends = np.cumsum(lengths + 1) - 1
    cls = classes()[cp]
    cls[ends] = END
    start = np.ones(len(cp), bool)
    np.not_equal(cls[1:], cls[:-1], out=start[1:])
    start[ends] = True
    # A white-space run gives its last character to what follows, if anything does.
    last = np.flatnonzero((cls[:-1] == SPACE) & (cls[1:] != SPACE) & (cls[1:] != END))
    start[last] = True
    start[last[cp[last] == 32] + 1] = False
    # 's 't 'm 'd 're 've 'll, where the apostrophe begins a piece and stands alone.
    q = np.flatnonzero(cp == 39)
    if len(q):
        q = q[start[q] & (cls[q] == OTHER) & (cls[q + 1] == LETTER)]
        one = q[np.isin(cp[q + 1], [ord(c) for c in "stmd"])]
        start[one + 1] = False
        start[one + 2] = True
        two = q[cls[np.minimum(q + 2, len(cp) - 1)] == LETTER]
        a, b = cp[two + 1], cp[two + 2]
        two = two[((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))]
        start[two + 1] = False
        start[two + 3] = True
    at = np.flatnonzero(start)
    stop = np.append(at[1:], len(cp))
    keep = cls[at] != END
    at, stop = at[keep], stop[keep]
    return joined, at, stop, cp, np.concatenate([[0], np.searchsorted(at, ends)])


# --- words and shingles ----------------------------------------------------------------------

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123), 95]] = True


#: Where a long text can be cut without changing its words.
WORD_BORDER = re.compile(r"[^A-Za-z0-9_\u0080-\U0010ffff][\x00-\x7f]")


def words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The longest runs of ASCII letters, digits and underscores of the lower-cased texts: bytes, begins, ends, and each word's text."""
    raw = [(t or "").lower().encode("utf-8", "surrogatepass") for t in texts]
    b = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    inside = _WORD[b]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edge = np.concatenate([[0], edge])
    begin, end = edge[0::2], edge[1::2]
    ends = np.cumsum(np.fromiter((len(r) + 1 for r in raw), np.int64, len(raw)))
    return b, begin, end, np.searchsorted(ends, begin, side="right")


_LOW = np.uint64((1 << 48) - 1)


def shingle_keys(texts: list[str | None], k: int) -> np.ndarray:
    """Sorted distinct keys (text's place << 48 | 48-bit hash of k consecutive words, or of all words if they are fewer) of at most 65,536 texts."""
    some, whose = parts(texts, WORD_BORDER)
    hashes, docs = [], []
    for lo, hi in blocks(some):
        b, begin, end, at = words(some[lo:hi])
        hashes.append(span_hashes(b, begin, end))
        docs.append(whose[at + lo])
    h, doc = (np.concatenate(x) if x else np.empty(0, np.uint64) for x in (hashes, docs))
    if not len(h):
        return np.empty(0, np.uint64)
    n = max(0, len(h) - k + 1)
    acc = h[:n].copy()
    for j in range(1, k):
        acc = mix(acc) + h[j : j + n]
    whole = doc[:n] == doc[len(h) - n :]
    key = (doc[:n][whole].astype(np.uint64) << np.uint64(48)) | (mix(acc[whole]) & _LOW)
    first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    count = np.diff(np.append(first, len(h)))
    first, count = first[count < k], count[count < k]
    if len(first):
        # The number of words is part of the hash, so that none equals a shingle of k words but by chance.
        acc = h[first] + count.astype(np.uint64)
        for j in range(1, k - 1):
            more = count > j
            acc[more] = mix(acc[more]) + h[first[more] + j]
        key = np.concatenate([key, (doc[first].astype(np.uint64) << np.uint64(48)) | (mix(mix(acc)) & _LOW)])
    key.sort()
    return key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key


def shared_shingles(left: list[str], right: list[str], k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each pair of texts the different shingles that both have, and that either has. Decided on the words themselves, without hashes.

    A text of fewer than k words has one shingle of all its words.
    """
    m = len(left)
    b, begin, end, at = words([*left, *right])
    if not len(begin):
        return np.zeros(m, np.int64), np.zeros(m, np.int64)
    code, _ = distinct(b, begin, end)
    count = np.bincount(at, minlength=2 * m)
    first = np.cumsum(count) - count
    # Short texts are filled up with a word that no text has, so that all shingles have k words.
    lack = np.where((count > 0) & (count < k), k - count, 0)
    fill = np.repeat(first + count, lack)
    word, doc = np.insert(code.astype(np.int64) + 1, fill, 0), np.insert(at, fill, np.repeat(np.arange(2 * m), lack))
    n = max(0, len(word) - k + 1)
    key = word[:n]
    for j in range(1, k):
        # A pair of codes is one number and gets a new, small code.
        key = pd.factorize(key * (int(word.max()) + 1) + word[j : j + n])[0].astype(np.int64)
    whole = doc[:n] == doc[len(word) - n :]
    key, doc = key[whole], doc[:n][whole]
    wide = int(key.max()) + 1 if len(key) else 1
    one = np.unique(doc * wide + key)
    side, shingle = one // wide, one % wide
    pair = np.concatenate([np.where(side < m, side, side - m) * wide + shingle])
    pair.sort()
    twice = pair[1:][pair[1:] == pair[:-1]]
    shared = np.bincount(twice // wide, minlength=m)
    return shared, np.bincount(pair // wide, minlength=m) - shared
