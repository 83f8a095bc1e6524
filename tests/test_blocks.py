import random

import pytest
from pyspark.sql import functions as F

from gleanspark.functions import text as X
from gleanspark.operators import blocks, words
from gleanspark.operators import retrieval as R


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(3)
    pool = ["alpha", "betaGamma", "delta", "eps_zeta", "eta", "theta", "x1"]
    text = lambda i: (f'import "./f{i - 2}"\n' if i > 1 else "") + " ".join(rng.choice(pool) for _ in range(rng.randint(0, 12)))
    path = lambda i: f"f{i}.md" if i % 5 == 4 else f"f{i}.ts"
    files = [(i, f"o/r{i % 2}", path(i), i, text(i), 10) for i in range(30)]
    chunks = [(None if k == 77 else 500 - k, k // 4, f"o/r{k // 4 % 2}", path(k // 4), k % 4, 5 * (k % 4), 5 * (k % 4) + 5, text(k // 4), [rng.choice(["Alpha", "eta", None])], rng.choice([0, 3, 3, 8])) for k in range(120)]
    cases = [(f"o/r{i % 2}", f"where is {rng.choice(pool)} or {rng.choice(pool)} {i}?", None, None) for i in range(9)]
    return (
        spark.createDataFrame(files, "file_id long, repo_id string, path string, file_ord long, text string, tokens long"),
        spark.createDataFrame(chunks, "chunk_key long, file_id long, repo_id string, path string, chunk_ord int, start_line int, end_line int, text string, defines array<string>, tokens long"),
        R.clean_questions(spark.createDataFrame(cases, "slug string, question string, expectation string, quarantined string")),
    )


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*R.KEY, *cols).collect()), key=repr)


@pytest.mark.parametrize("most", [250_000, 0], ids=["blocks", "joins for what is too large"])
def test_blocks_equal_joins(tables, monkeypatch, most):
    for name, value in (("MOST", most), ("PART", 7), ("ASKED", 2), ("ROWS", 5)):
        monkeypatch.setattr(blocks, name, value)
    joined, met = R.Retrieval(*tables, joined=True), R.Retrieval(*tables)
    assert (met.rest is None) == (most > 0)
    assert rows(met.hops, "path", "hop") == rows(joined.hops, "path", "hop") and joined.hops.count() > 20
    assert rows(met.expanded, "chunk_key", "hop", "score") == rows(joined.expansion, "chunk_key", "hop", "score")
    cols = ["chunk_key", "tier", "hop", "reason", "pos", "cum"]
    assert rows(met.places, *cols) == rows(joined.ordered, *cols) and met.places.where("tier = 0").count() > 20


def test_terms_by_words_are_those_of_the_expression(spark):
    texts = ["revalidateOnFocus __init__ getX HTTPServer snake_case_name $a $ab$cd$efg aBc_DEF1Gh éclair x9Yzz", "", None, "a" * 3000 + "_" + "b" * 3000]
    df = words.with_terms(spark.createDataFrame([(t,) for t in texts], "text string")).withColumn("want", X.terms(F.col("text")))
    assert all(r.terms == r.want for r in df.collect())


def test_imports_are_looked_for_once_by_their_word(spark):
    from gleanspark.operators import ingest

    df = spark.createDataFrame([("o/r", "a.ts", "ximport 'no'; import 'yes'\n_require('no') require('yes2'); import1 'no'")], "repo_id string, path string, text string")
    found = ingest.import_specs(df)
    assert [r.spec for r in found.collect()] == ["yes", "yes2"]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == len(X.IMPORT_PATTERNS)
