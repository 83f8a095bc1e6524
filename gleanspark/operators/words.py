"""Terms and tokens of whole texts in Arrow stages: the rules of ``functions.text``, with each different word taken apart once."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanspark.session import ship_package

_WORD = re.compile(r"[A-Za-z_$][A-Za-z0-9_$]*")
_HUMP = re.compile(r"([a-z0-9])([A-Z])")
_APART = re.compile(r"[_$ ]+")


@lru_cache(maxsize=1 << 17)
def _terms_of(word: str) -> tuple[str, ...]:
    parts = [p.lower() for p in _APART.split(_HUMP.sub(r"\1 \2", word)) if len(p) > 2]
    return (word.lower(), *parts) if len(parts) > 1 else (word.lower(),)


def terms(text: str) -> list[str]:
    return [t for w in _WORD.findall(text) for t in _terms_of(w)]


def _each(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else terms(t) for t in texts.to_pylist()], pa.list_(pa.string()))


#: Bytes of text that are looked at together.
PART = 4 << 20

#: Kinds of bytes: letters, the other beginnings of a word, digits, blanks, and those inside a character.
_LETTER, _MARK, _DIGIT, _BLANK, _INSIDE = 1, 2, 3, 4, 5
_KIND = np.zeros(256, np.uint8)
for _kind, _bytes in ((_LETTER, b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"), (_MARK, b"_$"), (_DIGIT, b"0123456789"), (_BLANK, b" \t\r\n"), (_INSIDE, bytes(range(0x80, 0xC0)))):
    _KIND[list(_bytes)] = _kind


def _parts(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The texts in parts: their bytes, the kinds of these, and the places where a text begins and where the last ends. Null has no bytes."""
    if not len(texts):
        return
    texts = texts.cast(pa.large_string()).fill_null("")
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if at[-1] else np.zeros(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(at, at[i] + PART, "right")) - 1)
        own = data[at[i] : at[j]]
        yield own, _KIND[own], at[i : j + 1] - at[i]
        i = j


def _runs(there: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs begin and end; none goes on from one text into the next."""
    first = there.copy()
    first[1:] &= ~there[:-1]
    cut = begins[begins < len(there)]
    first[cut] = there[cut]
    last = there.copy()
    last[:-1] &= ~there[1:]
    cut = cut[cut > 0] - 1
    last[cut] = there[cut]
    return np.nonzero(first)[0], np.nonzero(last)[0] + 1


def _tokens(texts: pa.Array) -> pa.Array:
    out = [np.zeros(0, np.int64)]
    for _data, kind, at in _parts(texts):
        weight = (kind == 0).astype(np.int64) + (kind == _MARK)
        weight[_runs(kind == _LETTER, at[:-1])[0]] = 1
        a, z = _runs(kind == _DIGIT, at[:-1])
        weight[a] = -(-(z - a) // 3)
        sums = np.concatenate([[0], np.cumsum(weight)])[at]
        out.append(np.diff(sums))
    return pa.array(np.concatenate(out), mask=texts.is_null().to_numpy(zero_copy_only=False))


def with_tokens(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``tokens``, or puts them in place of what is there: ``token_proxy`` of a text."""
    ship_package(df.sparkSession)
    return df.withColumn("tokens", F.arrow_udf(_tokens, "bigint")(F.col(text)))


def with_terms(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``terms``: those of a text, in order."""
    ship_package(df.sparkSession)
    return df.withColumn("terms", F.arrow_udf(_each, "array<string>")(F.col(text)))
