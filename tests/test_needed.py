import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_blocks import tables  # noqa: F401

from gleanspark.functions import text as X
from gleanspark.operators import blocks, ingest, measure, words
from gleanspark.operators import retrieval as R
from gleanspark.plans import queries


@pytest.mark.parametrize("most", [250_000, 0], ids=["blocks", "joins for what is too large"])
def test_tokens_of_the_least_budget_equal_those_of_the_order(spark, tables, monkeypatch, most):  # noqa: F811
    for name, value in (("MOST", most), ("PART", 7), ("ASKED", 2)):
        monkeypatch.setattr(blocks, name, value)
    asked = [(r.repo_id, r.question) for r in tables[2].collect()]
    at = lambda i: "f%d.%s" % (i, "md" if i % 5 == 4 else "ts")
    lines = [(*a, at((7 * i + k) % 30), 1 + (3 * i + 5 * k) % 24) for i, a in enumerate(asked[1:]) for k in range(1 + i % 2)]
    anchors = spark.createDataFrame(lines, "repo_id string, question string, path string, line long")
    joined = R.Retrieval(*tables, joined=True)
    want = measure.minimum_budget(joined, measure.anchor_depth(joined, anchors), 4).select(*R.KEY, "tokens_used")
    of = lambda df: {tuple(x)[:3]: x.tokens_used for x in df.collect()}
    got = of(measure.minimum_used(R.Retrieval(*tables), anchors, 4))
    assert got == of(want) and len({x for x in got.values() if x is not None}) > 2 and None in got.values()
    one = of(measure.minimum_used(R.Retrieval(*tables, variants=("all",)), anchors, 4))
    assert one == {k: x for k, x in got.items() if k[0] == "all"}


@pytest.mark.parametrize("depth,ceiling,want", [(0, 10, 10), (11, 10, None), (100, 1000, 125), (0, 1000, 62), (1000, 1000, 1000), (1, 64, 64), (2**63 - 1, 10, None)])
def test_bisection(depth, ceiling, want):
    assert blocks.least_budget(depth, ceiling, 64) == want


def test_the_order_is_not_written_to_compare_with_vectors(spark, monkeypatch):
    for part in ("ordered", "scored"):
        monkeypatch.setattr(R.Retrieval, part, property(lambda self: 1 / 0))
    assert queries.QUERIES["dense_against_selector"](spark, "/root/testdata/sf0.001").count() > 0


def test_tokens_by_bytes_are_those_of_the_expression(spark, monkeypatch):
    monkeypatch.setattr(words, "PART", 40)
    texts = ["", None, "7", "abc", "def12345 x", "1234 é1z😀 _$a\t\r\n", "a" * 90 + "1" * 91, "日本 3.14 fooBar_1"]
    df = words.with_tokens(spark.createDataFrame([(t, -1) for t in texts], "text string, tokens long")).withColumn("want", X.token_proxy(F.col("text")))
    assert all(r.tokens == r.want for r in df.collect())
    assert [words._tokens(pa.array([t], pa.string())).to_pylist() for t in texts] == [[r.want] for r in df.collect()] and words._tokens(pa.array([], pa.string())).to_pylist() == []
    part = pa.array([*texts, *texts])
    assert words._tokens(part.slice(3, 9)).to_pylist() == words._tokens(part).to_pylist()[3:12]


def test_imports_found_before_give_the_same_edges(spark, tables):  # noqa: F811
    edges = lambda files: sorted(map(tuple, ingest.import_edges(files).collect()))
    assert edges(ingest.with_specs(tables[0])) == edges(tables[0]) != []
