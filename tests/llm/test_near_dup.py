import random
import re

import pytest

from gleanspark.llm import near_dup

WORDS = [f"w{i}" for i in range(400)]


def shingles(t, k):
    w = re.findall("[a-z0-9_]+", t.lower())
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def brute(rows, k, threshold, least):
    s = {(kind, i): shingles(t, k) for kind, i, t in rows if t and i is not None}
    s = {x: v for x, v in s.items() if len(v) >= least}
    out = set()
    for (ka, a), x in s.items():
        for (kb, b), y in s.items():
            if ka == kb and a < b and len(x & y) >= threshold * len(x | y) - 1e-12:
                out.add((ka, a, b))
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    out, n = [], 0
    boiler = " ".join(rng.choices(WORDS, k=60))
    for _ in range(60):
        base = rng.choices(WORDS, k=rng.randint(60, 160))
        for _ in range(rng.choice([1, 1, 3])):
            edit = list(base)
            for _ in range(rng.randint(0, 12)):
                edit[rng.randrange(len(edit))] = rng.choice(WORDS)
            n += 1
            out.append(("chunk" if n % 3 else "file", n, (boiler + " " if n % 2 else "") + " ".join(edit)))
    copy = " ".join(rng.choices(WORDS, k=90))
    out += [("chunk", 1000 + i, copy) for i in range(60)]
    # one chain of texts that all agree closely: a node that never shrinks
    core = rng.choices(WORDS, k=200)
    out += [("file", 2000 + i, " ".join(core[:-1] + [f"end{i}"])) for i in range(50)]
    return out + [out[0], ("chunk", 5000, None), ("chunk", 5001, ""), ("file", None, copy), ("chunk", 5002, "few words here")]


def test_pairs_equal_brute_force(spark, rows):
    df = spark.createDataFrame(rows, "kind string, id long, text string").selectExpr("*", "0 AS node", "'x' AS sig", "1 AS n")
    links, members = near_dup.similarity_join(df, k=3, threshold=0.6, min_shingles=40)
    got = {tuple(r) for r in near_dup.record_pairs(links, members).collect()}
    assert got == brute(rows, 3, 0.6, 40)


def test_groups_are_components(spark, rows):
    df = spark.createDataFrame(rows, "kind string, id long, text string")
    got = {(r.record_kind, r.id): r.group_id for r in near_dup.near_duplicate_groups(df).collect()}
    pairs = brute(rows, 5, 0.8, 1)
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for k, a, b in pairs:
        x, y = find((k, a)), find((k, b))
        parent[max(x, y)] = min(x, y)
    assert got == {x: find(x)[1] for x in list(parent)}


def test_components_of_a_chain(spark):
    e = spark.createDataFrame([("c", i, i + 1) for i in range(40)] + [("f", 5, 9)], "kind string, a long, b long")
    got = {(r.kind, r.id): r.root for r in near_dup.components(e).collect()}
    assert all(got["c", i] == 0 for i in range(1, 41)) and got["f", 9] == 5


def test_empty(spark):
    df = spark.createDataFrame([], "kind string, id long, text string")
    links, members = near_dup.similarity_join(df)
    assert links.count() == 0 and near_dup.record_pairs(links, members).count() == 0
    assert near_dup.near_duplicate_groups(df).count() == 0
