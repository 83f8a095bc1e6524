import collections
import math
import random
import re

import pytest

from gleanspark.llm import distinctive


def terms(parts):
    out = collections.Counter()
    for s in parts:
        for w in re.findall("[A-Za-z]+", s):
            out.update(x.lower() for x in re.sub("([a-z])([A-Z])", r"\1 \2", w).split())
    return out


ROWS = [
    (1, "fooBar foo_bar HTTPServer aB x", ["getValue", None]), (1, "fooBar foo_bar HTTPServer aB x", ["getValue", None]), (2, None, None), (3, "", ["a", "b"]), (4, "zeta zeta zeta common", []), (5, "common É fooÉbar 1a2b", ["x"]),
    (6, "common " * 3000, None), (None, "lost", None), (7, "tie tock", None),
]


@pytest.fixture(scope="module")
def chunks(spark):
    return spark.createDataFrame(ROWS, "chunk_key long, text string, defines array<string>").selectExpr("*", "'c' AS term", "0 AS tf", "1 AS rank")


@pytest.fixture(scope="module")
def truth():
    return {k: terms([t or "", *[x for x in (d or []) if x]]) for k, t, d in ROWS if k is not None}


def dfr(tf, length, average, f, n):
    t, m = tf * math.log2(1 + average / length), f / n
    return (math.log2(1 + m) + t * math.log2((1 + m) / m)) / (t + 1)


def test_scores(spark, chunks, truth):
    got = distinctive.score_terms(chunks).collect()
    assert {(r.chunk_key, r.term): r.tf for r in got} == {(k, t): n for k, c in truth.items() for t, n in c.items()}
    n, cf = len(truth), sum(truth.values(), collections.Counter())
    average = sum(map(sum, (c.values() for c in truth.values()))) / n
    for r in got:
        assert r.n_all == n and r.n_records == sum(r.term in c for c in truth.values())
        assert r.score == pytest.approx(dfr(r.tf, sum(truth[r.chunk_key].values()), average, cf[r.term], n))
    tied = [r.term for r in sorted(got, key=lambda r: r.rank) if r.chunk_key == 7]
    assert tied == ["tie", "tock"]


def test_only_some_records_are_scored_against_all(spark, chunks):
    probes = spark.createDataFrame([(4,), (4,), (99,), (None,), (2,)], "chunk_key long")
    some = {(r.chunk_key, r.term): r.score for r in distinctive.score_terms(chunks, probes).collect()}
    every = {(r.chunk_key, r.term): r.score for r in distinctive.score_terms(chunks).where("chunk_key = 4").collect()}
    assert some == pytest.approx(every)
    assert [tuple(r) for r in distinctive.leading_terms(chunks, probes).collect()] == [(4, "zeta")]


def test_rare_and_common_terms_are_ranked_together(spark, chunks, truth, monkeypatch):
    every = sorted(map(tuple, distinctive.score_terms(chunks).collect()))
    for common in (0, 2, 3):  # terms in more than all, half and a third of the records
        monkeypatch.setattr(distinctive, "COMMON", common)
        assert sorted(map(tuple, distinctive.score_terms(chunks).collect())) == every


def test_the_weight_decides_whatever_the_ranking(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choices([a + b for a in "abcdefgh" for b in "xyzuv"], [1 + j % 7 * j for j in range(40)], k=rng.randint(1, 60))), None) for i in range(60)]
    df = spark.createDataFrame(rows, "chunk_key long, text string, defines array<string>")
    tf = {i: collections.Counter(t.split()) for i, t, _ in rows}
    n = collections.Counter(t for c in tf.values() for t in c)
    want = {(i, min(c, key=lambda t: (-c[t] * math.log(60 / n[t]), t))) for i, c in tf.items()}
    got = {tuple(r) for r in distinctive.leading_terms(df, df).collect()}
    assert got == want
    first = {(r.chunk_key, r.term) for r in distinctive.score_terms(df).where("rank = 1").collect()}
    assert first != want  # the ranking alone would not do


def test_empty(spark, chunks):
    probes = spark.createDataFrame([(4,)], "chunk_key long")
    assert distinctive.score_terms(chunks.limit(0)).count() == 0
    assert distinctive.leading_terms(chunks.limit(0), probes).count() == 0
    assert distinctive.leading_terms(chunks, probes.limit(0)).count() == 0
