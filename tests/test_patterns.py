import re

import pytest
from pyspark.sql import functions as F

from gleanspark.functions import text as X
from gleanspark.plans import oracle

#: White space and word borders as the fixed patterns mean them.
JS = {r"\s": "[\t\n\x0b\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"}
LINES = [
    "export\u00a0function f", "functioné", "éfunction f", "export async\tdef g", "classes", "class", "\u00a0class A", "\ufeffconst x = 1", "let\u2003y", "enum\x0bE", "type$", "interface-x", "fn_", "def  name(x)", "const $a_b1 = 2", "var\u00a0z",
    "import a from 'b'", "éimport 'c'", "import\u00a0'd'", "require ( 'e' )", "export * from 'f'", "  from a.b\u00a0import c", "from x import\u00e9", "from .a import b",
]


def plain(pattern):
    return re.compile(pattern.replace(r"\s", JS[r"\s"]), re.ASCII)


@pytest.mark.parametrize("pattern", [X.DECLARATION, X.DEFINED_NAME, *X.IMPORT_PATTERNS])
def test_patterns_mean_the_same_on_the_jvm(spark, pattern):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(LINES)], "i int, line string").select("i", F.col("line").rlike(X.jvm(pattern)).alias("m"))
    assert {r.i for r in df.collect() if r.m} == {i for i, x in enumerate(LINES) if plain(pattern).search(x)}


def test_both_spellings_are_one():
    assert oracle.STOP_WORDS == list(X.STOP_WORDS) and oracle.SOURCE_EXT == X.SOURCE_EXT and X.CODE_EXT == f"{oracle.SOURCE_EXT}|{oracle.MORE_CODE_EXT}"
    assert (oracle.DECLARATION, oracle.DEFINED_NAME, oracle.IMPORTS, oracle.IMPORT_EXT) == (X.DECLARATION, X.DEFINED_NAME, X.IMPORT_PATTERNS, X.IMPORT_EXT)


def test_declarations_after_any_white_space(spark):
    lines = ["\u00a0class A", "\ufefffn f", "int main(a) {", "\u00a0int main(a) {", "int\u00a0main (a", "classé", "class"]
    got = [r.m for r in spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, line string").orderBy("i").select(X.is_declaration(F.col("line")).alias("m")).collect()]
    assert got == [True, True, True, False, True, True, True]
