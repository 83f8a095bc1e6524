import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gleanspark.functions import text as X
from gleanspark.operators import dense, ingest, measure
from gleanspark.operators.retrieval import Retrieval, clean_anchors, clean_questions

PY = "import os\n\n\nclass A:\n    def f(self):\n        pass\n\n" + "\n".join(f"x{i} = {i}" for i in range(170)) + "\ndef g():\n    return 1\n"
C = "#include <x.h>\nint proto(int a);\nstatic int run(struct s *p) {\n  return 1;\n}\n\nelse if (a) {\n"


def chunk_by_rules(text):
    """The folding rules, line by line."""
    lines = text.split("\n")
    decl = re.compile(X.DECLARATION)
    c_decl = re.compile(r"^(?:[A-Za-z_]\w*\s+|\*)+\**[A-Za-z_]\w*\s*\([^;]*$")
    cuts = [0] + [i for i in range(1, len(lines)) if lines[i] and (decl.search(lines[i].lstrip()) or (not lines[i][0].isspace() and c_decl.search(lines[i])))]
    edges = sorted({c for a, b in zip(cuts, [*cuts[1:], len(lines)]) for c in range(a, b, ingest.MAX_LINES)})
    out = []
    for a, b in zip(edges, [*edges[1:], len(lines)]):
        if b - a < ingest.MIN_LINES and out:
            out[-1][1] = b
        elif "".join(lines[a:b]).strip():
            out.append([a, b, b])
    return [(a, e, e0, "\n".join(lines[a:e])) for a, e, e0 in out]


TEXTS = [PY, C, "", "\n\n\n", "x", "\n" * 10 + "def a():\n" + "  y\n" * 3 + "\n" * 200 + "def b():\n", "a\n" * 300, "word " * 20_000 + "(", "\r\n".join(["def a():", "  b", "class C:", *["  d"] * 7])]


@pytest.fixture(scope="module")
def files(spark):
    rows = [(i, "o/r", f"d/f{i}.py", i, t, 1) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "file_id long, repo_id string, path string, file_ord long, text string, tokens long")


def test_chunks_follow_the_rules(files):
    got = {}
    for r in ingest.chunk_files(files).orderBy("file_id", "chunk_ord").collect():
        got.setdefault(r.file_id, []).append((r.start_line, r.end_line, int(r.id.rsplit("-", 1)[1]), r.text))
    assert got == {i: chunk_by_rules(t) for i, t in enumerate(TEXTS) if chunk_by_rules(t)}


def test_structural_definition(spark):
    pattern = re.compile(r"^(?:[A-Za-z_][A-Za-z0-9_]*\s+|\*)+\**[A-Za-z_][A-Za-z0-9_]*\s*\([^;]*$")
    import itertools

    lines = ["".join(p) for n in range(1, 7) for p in itertools.product("a1 *(;", repeat=n)]
    df = spark.createDataFrame([(x,) for x in lines], "line string").select("line", X.structural_definition(F.col("line")).alias("m"))
    assert all(r.m == bool(pattern.search(r.line)) for r in df.collect())


def test_terms(spark):
    t = "revalidateOnFocus __init__ getX HTTPServer snake_case_name"
    df = spark.createDataFrame([(t,), ("",), (None,)], "t string").select(X.terms(F.col("t")).alias("w")).collect()
    assert df[0].w == "revalidateonfocus revalidate focus __init__ getx httpserver snake_case_name snake case name".split()
    assert df[1].w == [] and df[2].w is None
    q = spark.createDataFrame([("how does theFoo do the foo foo?",)], "q string").select(X.question_terms(F.col("q")).alias("w")).first().w
    assert q == ["thefoo", "foo"]


@pytest.mark.parametrize(("path", "want"), [("a/b/../c", "a/c"), ("./a", "a"), ("../a", "../a"), ("a/..", "."), ("a/./b/", "a/b/"), ("a/../../b", "../b")])
def test_normal_path(spark, path, want):
    assert spark.range(1).select(X.normal_path(F.lit(path))).first()[0] == want


def test_imports(spark):
    ts = 'import { a } from "./b";\nimport "./side.js"\nconst c = require("@/lib/c");\nexport * from "../top"\nimport react from "react"\nimport self from "./a"'
    rows = [(1, "o/r", "src/a.ts", ts), (2, "o/r", "src/b/index.ts", ""), (3, "o/r", "src/side.js", ""), (4, "o/r", "src/lib/c.tsx", "from pkg.mod import x\n  from . import y"), (5, "o/r", "top.js", ""), (6, "o/r", "pkg/mod.py", ""), (7, "o/r", "src/lib/__init__.py", "import"), (8, "o/x", "top.ts", "")]
    df = spark.createDataFrame(rows, "file_id long, repo_id string, path string, text string")
    specs = {(r.path, r.spec) for r in ingest.import_specs(df).collect()}
    assert ("src/a.ts", "react") in specs and ("src/lib/c.tsx", "pkg.mod") in specs and len(specs) == 8
    got = {(r.src, r.dst) for r in ingest.import_edges(df).where("variant = 'all'").collect()}
    assert got == {("src/a.ts", "src/b/index.ts"), ("src/a.ts", "src/side.js"), ("src/a.ts", "src/lib/c.tsx"), ("src/a.ts", "top.js"), ("src/lib/c.tsx", "pkg/mod.py"), ("src/lib/c.tsx", "src/lib/__init__.py")}


def test_filters_and_coverage(spark):
    rows = [(1, "o/r", "a.TS", "12345"), (2, "o/r", "node_modules/x.js", "123"), (3, "o/r", "CHANGELOG.md", "1234567"), (4, "o/r", "run.sh", "😀"), (5, "o/r", "data.json", "{}"), (6, "o/r", "big.py", "x" * 200_001), (7, "o/e", "x.json", "{}")]
    df = spark.createDataFrame(rows, "file_id long, repo_id string, path string, text string").withColumns({"file_ord": F.col("file_id"), "tokens": F.lit(1)})
    assert [r.file_id for r in ingest.source_files(df).collect()] == [1]
    cov = {r.repo_id: (r.seen_units, r.indexed_units, r.pct) for r in ingest.coverage(df).collect()}
    assert cov["o/r"][:2] == (5 + 7 + 2 + 200_001, 5) and cov["o/e"] == (0, 0, 100.0)
    assert [(r.ext, r.units) for r in ingest.skipped_by_ext(df).orderBy("place").collect()] == [("py", 200_001), ("md", 7), ("sh", 2)]
    assert [tuple(r) for r in ingest.size_gate(df, 4).collect()] == [("o/r", 5, True)]


@pytest.fixture(scope="module")
def world(spark):
    # chain f0 -> f1 -> f2 -> f3; only f0 matches the question
    texts = ["alpha alpha beta", "gamma", "gamma", "gamma", "filler text"]
    files = spark.createDataFrame([(i, "o/r", f"f{i}.ts", i, (f'import "./f{i + 1}"\n' if i < 3 else "") + t, 10) for i, t in enumerate(texts)], "file_id long, repo_id string, path string, file_ord long, text string, tokens long")
    chunks = spark.createDataFrame(
        [(10 * i + k, i, "o/r", f"f{i}.ts", k, 5 * k, 5 * k + 5, t if k == 0 else "other words", ["Alpha"] if i == 0 and k == 0 else [], 4 + i) for i, t in enumerate(texts) for k in range(2)],
        "chunk_key long, file_id long, repo_id string, path string, chunk_ord int, start_line int, end_line int, text string, defines array<string>, tokens long",
    )
    cases = spark.createDataFrame([("O/R ", "where is alpha?", "should-pass", None), ("o/r", "where is alpha?", "should-pass", None), ("o/r", "the of", None, "x")], "slug string, question string, expectation string, quarantined string")
    return Retrieval(files, chunks, clean_questions(cases))


def test_tiers(world):
    rows = world.ordered.where("variant = 'all'").orderBy("pos").collect()
    assert [(r.path, r.tier, r.hop) for r in rows] == [("f0.ts", 0, 0), ("f0.ts", 1, 0), ("f1.ts", 1, 1), ("f1.ts", 1, 1), ("f2.ts", 1, 2), ("f2.ts", 1, 2)]
    assert rows[0].reason == "matched: alpha" and rows[1].reason == "same file as a match" and rows[-1].reason == "2 hops from a match"
    assert [r.cum for r in rows] == [4, 8, 13, 18, 24, 30]
    assert all(r.score < rows[0].score for r in rows[1:])


def test_pack_stops_at_the_first_miss(world):
    assert world.packed(12).where("kept AND variant = 'all'").count() == 2
    near = world.near_misses(3).where("variant = 'all'").orderBy("place").collect()
    assert [(r.path, r.chunk_key) for r in near] == [("f0.ts", 0), ("f0.ts", 1)]
    report = {r.question: r for r in world.report(12).where("variant = 'all'").collect()}
    assert report["where is alpha?"].selected_tokens == 8 and report["where is alpha?"].dropped_files == 4
    assert report["the of"].selected_tokens == 0 and report["the of"].reduction_pct == 100.0
    assert world.context(4).where("variant = 'all'").first().context == "QUESTION: where is alpha?\n\n--- f0.ts:0-5 ---\nalpha alpha beta"


def bisect(t, ceiling, step=64):
    lo, hi, p = 0, ceiling, 1
    while hi - lo > step:
        mid = (lo + hi) // 2
        p += 1
        lo, hi = (lo, mid) if mid >= t else (mid, hi)
    return hi, p + 1


@settings(max_examples=20, deadline=None)
@given(st.integers(1, 500_000))
def test_bisection_brackets(t):
    hi, _ = bisect(t, 500_000)
    assert t <= hi < t + 64


def test_minimum(spark, world):
    anchors = clean_anchors(spark.createDataFrame([("o/r", "where is alpha?", "./f1.ts", 1), ("o/r", "where is alpha?", "f2.ts", 7), ("o/r", "where is alpha?", None, 1)], "slug string, question string, path string, line int"))
    depths = measure.anchor_depth(world, anchors)
    assert {(r.path, r.depth) for r in depths.where("variant = 'all'").collect()} == {("f1.ts", 13), ("f2.ts", 30)}
    m = measure.minimum_budget(world, depths).where("variant = 'all'").first()
    assert (m.found, m.exact_tokens, m.min_budget, m.probes, m.tokens_used) == (True, 30, 50, 2, 30)
    assert {r.budget: r.found for r in measure.recall(depths, (12, 13, 40)).where("variant = 'all'").collect()} == {12: 0, 13: 1, 40: 2}
    assert measure.monotone_violations(depths).count() == 0
    lost = measure.anchor_depth(world, clean_anchors(spark.createDataFrame([("o/r", "where is alpha?", "f4.ts", 1)], "slug string, question string, path string, line int")))
    m = measure.minimum_budget(world, lost).where("variant = 'all'").first()
    assert (m.found, m.min_budget, m.probes) == (False, None, 1)


def test_grep(world):
    g = {r.question: r for r in measure.grep_baseline(world).collect()}
    assert (g["where is alpha?"].best_term, g["where is alpha?"].best_files, g["where is alpha?"].best_tokens) == ("alpha", 1, 10)
    assert g["the of"].best_term is None and g["the of"].best_tokens == 0


def test_dense(spark):
    import numpy as np

    v = np.random.default_rng(2).normal(size=(700, 8)).astype("float32")
    v[5] = v[4]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(None, [1.0] * 8), (900, None)], "vec_id long, embedding array<float>")
    got = {}
    for r in dense.dense_rank(df, "vec_id % 20 = 0", 4).orderBy("question_id", "place").collect():
        got.setdefault(r.question_id, []).append(r.vec_id)
    d = v.astype(float) @ v.astype(float).T
    np.fill_diagonal(d, -np.inf)
    assert got == {i: sorted(range(700), key=lambda j: (-d[i, j], j))[:4] for i in range(0, 700, 20)}


def test_quality(spark):
    rows = [("o/r", "a.py", 0, 80, ["x"]), ("o/r", "a.py", 0, 6, []), ("o/r", "b.py", 0, 10, ["y"]), ("o/r", "b.ts", 2, 90, [])]
    q = measure.chunk_quality(spark.createDataFrame(rows, "repo_id string, path string, start_line int, end_line int, defines array<string>")).first()
    assert (q.n, q.upper_median_lines, q.pct_forced, q.pct_with_symbol) == (4, 80, 25.0, 50.0)
