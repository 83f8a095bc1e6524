import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from gleanspark.llm import splitting


def blocks(text):
    lines = text.split("\n")
    blank = [x.strip(" \t\r") == "" for x in lines]
    return [0] + [i for i in range(1, len(lines)) if not blank[i] and blank[i - 1] and lines[i][0] not in " \t"], len(lines)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "", " b", "\tc", "\r", "é", "  ", "x\r"]), max_size=30).map("\n".join), min_size=1, max_size=5))
def test_blocks(texts):
    heads, counts = splitting.line_blocks(texts)
    for t, h, n in zip(texts, heads, counts):
        assert (h.tolist(), n) == blocks(t)


@settings(max_examples=500, deadline=None)
@given(st.lists(st.integers(1, 25), min_size=1, max_size=12), st.integers(2, 20), st.integers(0, 19))
def test_cut(sizes, limit, overlap):
    overlap = min(overlap, limit - 1)
    bounds = np.concatenate([[0], np.cumsum(sizes)])[:-1].tolist()
    n = sum(sizes)
    pieces = splitting.cut(bounds, np.arange(n + 1), limit, overlap)
    assert pieces[0][0] == 0 and pieces[-1][1] == n
    at = 0
    for k, (s, e, fresh, kind) in enumerate(pieces):
        assert e - s <= limit and fresh == at and e > fresh
        if k:
            assert s == max(pieces[k - 1][0], at - overlap)
            assert (at in bounds) == (kind != "hard") or kind == "hard"
        at = e
    must = {bounds[i] for i in range(1, len(sizes)) if sizes[i - 1] <= limit and sizes[i] <= limit < sizes[i - 1] + sizes[i]}
    assert {f for _, _, f, kind in pieces if kind == "forced"} == must


def test_units_of_any_weight():
    weight = np.concatenate([[0], np.cumsum([5, 1, 30, 2, 2])])
    pieces = splitting.cut([0, 3], weight, 10, 1)
    assert pieces[0][:2] == (0, 2) and (2, 3) in [(p[2], p[1]) for p in pieces] and pieces[-1][1] == 5


def test_files(spark):
    long = "\n".join(["x"] * 5 + [""] + ["y"] * 5)
    rows = [(1, "a.PY", long), (1, "a.PY", long), (2, "b.py", "short"), (3, "c.txt", long), (4, "d.py", None), (5, None, long), (6, "noext", long), (None, "e.py", long), (7, "f.py", ""), (8, "g.py", "z" * 100_000 + "\n" * 20)]
    files = spark.createDataFrame(rows, "file_id long, path string, text string").selectExpr("*", "'py' AS ext", "1 AS max_lines", "0 AS piece_no")
    limits = spark.createDataFrame([("py", 6, 1), ("py", 9, 1), ("ts", None, 1)], "ext string, max_lines int, overlap_lines int")
    got = splitting.split_files(files, limits).orderBy("file_id", "piece_no").collect()
    assert [(r.start_line, r.end_line, r.cut_line, r.cut_kind) for r in got if r.file_id == 1] == [(0, 6, 0, "start"), (5, 11, 6, "forced")]
    assert got[1].text == "\n".join(long.split("\n")[5:11]) and {r.file_id for r in got} == {1, 8}
    assert [tuple(r) for r in splitting.forced_cuts(files, limits).collect()] == [(1, 6)]
    assert splitting.split_files(files.limit(0), limits).count() == 0 and splitting.split_files(files, limits.limit(0)).count() == 0
