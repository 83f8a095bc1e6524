import random
import re

from pyspark.sql import functions as F

from gleanspark.functions import text as X
from gleanspark.operators import ingest
from gleanspark.operators.symbols import c_symbols, with_defines

WORD, BLANK, END = r"[A-Za-z0-9_]", r"[\t\n\x0b\x0c\r \xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]", r"[\n\r\u2028\u2029]"
RULE = re.compile(rf"(?:\A|(?<={END}))(?:[A-Za-z_]{WORD}*{BLANK}+|\*)+\**([A-Za-z_]{WORD}*){BLANK}*\([^;]*(?:\Z|(?={END}))")
CODE = "static int run(struct s *p) {\n  return 1;\n}\nint proto(int a);\nvoid *make(int n)\n{\n  go(n);\n}\nstruct node { int x; };\nelse if (a) {\n"


def brute(text):
    return list(dict.fromkeys(m[1] for m in RULE.finditer(text)))


def test_c_names_follow_the_rule():
    assert c_symbols(CODE) == brute(CODE) == ["run", "make", "if"]
    rng = random.Random(3)
    for alphabet in ("a1_ *(;\n", "ab (\n", "a* (;\r\n\u2028\u00e9", "x (;\n\ufeff\xa0"):
        for _ in range(20_000):
            t = "".join(rng.choices(alphabet, k=rng.randint(0, 14)))
            assert c_symbols(t) == brute(t), repr(t)


def test_no_backtracking():
    assert c_symbols("word word\n" * 100_000) == [] and c_symbols("*" * 500_000 + " (") == [] and c_symbols("a f(\n" * 100_000) == ["f"] and c_symbols("a f(;\n" * 50_000) == []


def test_both_halves(spark):
    df = with_defines(spark.createDataFrame([(1, CODE), (2, ""), (3, "def f(x):\n"), (4, "int twice(a)\nint twice(b)\n")], "k long, text string"))
    assert {r.k: r.defines for r in df.collect()} == {1: ["s", "node", "run", "make", "if"], 2: [], 3: ["f"], 4: ["twice"]}


def test_folded_chunks_have_their_defines(spark):
    text = CODE + "  x\n" * 8 + "long tail(int z) {\n}\n"
    files = spark.createDataFrame([(1, "o/r", "a.c", 0, text, 1)], "file_id long, repo_id string, path string, file_ord long, text string, tokens long")
    chunks = ingest.chunk_files(files)
    keyword = {r.id: r.k for r in chunks.select("id", X.keyword_symbols(F.col("text")).alias("k")).collect()}
    rows = chunks.collect()
    assert {r.id: r.defines for r in rows} == {r.id: list(dict.fromkeys([*keyword[r.id], *brute(r.text)])) for r in rows}
    # the last lines are folded into the chunk before, whose names are those of its whole text
    assert "tail" in rows[-1].text and rows[-1].id != f"a.c#{rows[-1].start_line}-{rows[-1].end_line}"
