"""The names that a text defines: by a keyword (JVM-side), and in the manner of C (an Arrow stage with Python's re)."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanspark.functions import text as X
from gleanspark.session import ship_package

#: Blanks and line ends as the rule counts them.
_BLANK = r"\t\n\x0b\x0c\r \xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
_ENDS = "\n\r\u2028\u2029"
#: Characters that may stand in a head, as far as they go, and the parenthesis after them.
_RUN = re.compile(rf"[A-Za-z0-9_*{_BLANK}]++\(?")
#: What no head may hold: a word that begins with a digit, a star right after a word, a blank after a star.
_BAD = re.compile(rf"(?<![A-Za-z0-9_])[0-9]|[A-Za-z0-9_]\*|\*[{_BLANK}]")
_BEGIN = re.compile(rf"(?:\A|(?<=[{_ENDS}]))[A-Za-z_*]")
_NAME = re.compile(rf"([A-Za-z_][A-Za-z0-9_]*+)[{_BLANK}]*+\(\Z")


def c_symbols(text: str) -> list[str]:
    r"""Different names before a parenthesis, in order: words or stars from a line's begin, then the name, and no semicolon up to a line's end.

    The rule is ``^(?:[A-Za-z_]\w*\s+|\*)+\**([A-Za-z_]\w*)\s*\([^;]*$`` over many lines: a match goes on to the last line end before the
    next semicolon, and the search continues there. A head holds no other parenthesis, so each is looked at once and nothing backtracks.
    """
    out: dict[str, None] = {}
    begin, semicolon = 0, -2
    for run in _RUN.finditer(text):
        a, b = run.span()
        if text[b - 1] != "(" or b <= begin or not _BEGIN.search(text, max(a, begin), b):
            continue
        bad = -1
        for m in _BAD.finditer(text, a, b):
            bad = m.start()
        m = _BEGIN.search(text, max(a, begin, bad + 1), b)
        name = m and _NAME.search(text, m.start(), b)
        if not name or name.start() == m.start():
            continue
        if semicolon != -1 and semicolon < b:
            semicolon = text.find(";", b)
        stop = len(text) if semicolon == -1 else max(text.rfind(e, b, semicolon) for e in _ENDS)
        if stop >= 0:
            out[name[1]] = None
            begin = stop
    return list(out)


def _each(texts: pa.Array) -> pa.Array:
    return pa.array([[] if t is None else c_symbols(t) for t in texts.to_pylist()], pa.list_(pa.string()))


def with_defines(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``defines``: the different names that a text defines, those by a keyword first."""
    ship_package(df.sparkSession)
    c_names = F.arrow_udf(_each, "array<string>")
    return df.withColumn("defines", F.array_distinct(F.concat(X.keyword_symbols(F.col(text)), c_names(F.col(text)))))
