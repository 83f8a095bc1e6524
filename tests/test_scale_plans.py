import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleanspark.operators import dense, measure
from gleanspark.operators import retrieval as R


def test_running_totals_equal_one_sort(spark):
    rng = random.Random(4)
    rows = [("all", "o/r", "q", i, i % 3, 0, i, rng.choice([0, 3, 7, 7, 50]), rng.choice([0.5, 1.0, 2.5])) for i in range(600)] + [("code", "o/r", "q", 1, 0, 0, 1, 5, 1e-40)]
    df = spark.createDataFrame(rows, "variant string, repo_id string, question string, file_id int, tier int, chunk_ord int, chunk_key int, tokens long, score double")
    df = df.withColumns({"worth": F.col("score"), "tie": F.col("score"), "density": F.coalesce(F.try_divide("score", "tokens"), F.lit(float("inf")))})
    w = Window.partitionBy(*R.KEY).orderBy("tier", F.desc("density"), F.desc("tie"), *R.PLACE)
    want = df.select("variant", "chunk_key", F.row_number().over(w).alias("pos"), F.sum("tokens").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("cum"))
    got = R.running_totals(df).select("variant", "chunk_key", "pos", "cum")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_places_of_a_listing(spark):
    n = 300
    repos = spark.range(n).select(F.concat(F.lit("o/r"), "id").alias("slug"), F.lit("q").alias("question"), F.lit(None).cast("string").alias("note"), F.current_timestamp().alias("indexed_at"))
    files = spark.range(n).select(F.concat(F.lit("o/r"), "id").alias("repo_id"), F.lit("a.py").alias("path"), (F.col("id") * 37 % 90).alias("tokens"))
    chunks = files.select("repo_id")
    rows = measure.repo_listing(repos, files, chunks).collect()
    want = sorted(rows, key=lambda r: (r.tokens, r.repo_id))
    assert [r.place for r in want] == list(range(1, n + 1))


def test_few_questions_still_make_many_pairs_of_blocks(spark):
    v = spark.range(3000).select(F.col("id").alias("vec_id"), F.array(F.rand(1).cast("float"), F.rand(2).cast("float")).alias("embedding"))
    plan = dense.dense_rank(v, "vec_id = 7", 3)
    assert plan.count() == 3 and "qb" in plan._jdf.queryExecution().toString() and "[qb#" in plan._jdf.queryExecution().toString()


@pytest.fixture(scope="module")
def ratios(spark):
    files = spark.createDataFrame([(i, "o/r", f"f{i}.ts", i, t, 10) for i, t in enumerate(["alpha beta", "alpha", "other"])], "file_id long, repo_id string, path string, file_ord long, text string, tokens long")
    chunks = spark.createDataFrame([(i, i, "o/r", f"f{i}.ts", 0, 0, 5, t, [], 4) for i, t in enumerate(["alpha beta", "alpha", "other"])], "chunk_key long, file_id long, repo_id string, path string, chunk_ord int, start_line int, end_line int, text string, defines array<string>, tokens long")
    cases = R.clean_questions(spark.createDataFrame([("o/r", q, None, None) for q in ("where is alpha?", "and beta?", "the of", "alpha lost?")], "slug string, question string, expectation string, quarantined string"))
    r = R.Retrieval(files, chunks, cases)
    anchors = R.clean_anchors(spark.createDataFrame([("o/r", "where is alpha?", "f0.ts", 1), ("o/r", "alpha lost?", "f2.ts", 1)], "slug string, question string, path string, line int"))
    depths = measure.anchor_depth(r, anchors)
    return r, depths, measure.minimum_budget(r, depths)


def test_ratio_is_withheld(ratios):
    r, depths, minimum = ratios
    rows = {x.question: x for x in measure.grep_ratio(r, depths, minimum, 100).where("variant = 'all'").collect()}
    assert rows["where is alpha?"].at_minimum and rows["where is alpha?"].withheld is None and rows["where is alpha?"].ratio > 1
    assert (rows["and beta?"].withheld, rows["and beta?"].ratio, rows["and beta?"].bound_tokens) == ("no anchors", None, 4)
    assert rows["the of"].withheld == "nothing selected" and rows["alpha lost?"].withheld == "not retrieved"
    cost = {x.question: tuple(x)[2:] for x in measure.token_cost(r, 100).collect()}
    assert cost["and beta?"] == (30, "beta", 10, 4) and cost["the of"] == (30, None, 0, 0)
    assert {x.path for x in measure.best_files(r).where("question = 'where is alpha?'").collect()} == {"f0.ts", "f1.ts"}


def test_marks_and_dense(spark, ratios):
    r, _, minimum = ratios
    marked = r.ordered.where("variant = 'all' AND question = 'where is alpha?' AND path = 'f1.ts'")
    assert [tuple(x) for x in measure.anchors_of_marked(marked).collect()] == [("o/r", "where is alpha?", "f1.ts", 1)]
    need = spark.createDataFrame([("o/r", "where is alpha?", 9), ("o/r", "alpha lost?", None)], "repo_id string, question string, min_tokens long")
    assert {x.question: x.winner for x in measure.dense_against_selector(minimum, need).collect()} == {"where is alpha?": "selector", "alpha lost?": None}
