import pytest

from gleanspark.llm import arrow, distinctive, generated, lookalike, near_dup, splitting, tokens


def results(spark):
    texts = ["alpha beta gamma " * (i % 7) + f"w{i} fooBar" + "\n\nblock" * (i % 5) for i in range(60)] + [None, ""]
    docs = spark.createDataFrame([(i, t, "o/r", f"src/f{i}.py", None) for i, t in enumerate(texts)], "doc_id long, text string, slug string, path string, defines array<string>")
    limits = spark.createDataFrame([("py", 3, 1)], "ext string, max_lines int, overlap_lines int")
    links, members = near_dup.similarity_join(docs.selectExpr("'c' AS kind", "doc_id AS id", "text"), k=2, threshold=0.5)
    frames = {
        "terms": distinctive.score_terms(docs, key="doc_id"), "ids": tokens.encode_corpus(docs), "kinds": generated.kinds(docs.withColumnRenamed("doc_id", "file_id")), "forms": lookalike.canonical_texts(docs),
        "pieces": splitting.split_files(docs.withColumnRenamed("doc_id", "file_id"), limits), "links": links, "members": members,
    }
    return {k: sorted(map(repr, f.collect())) for k, f in frames.items()}


@pytest.mark.parametrize("most", [1, 3000])
def test_results_do_not_depend_on_the_size_of_batches(spark, monkeypatch, most):
    whole = results(spark)
    monkeypatch.setattr(arrow, "BATCH_BYTES", most)
    assert results(spark) == whole


def test_each_key_once(spark):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (2, None), (2, None), (None, "x"), (3, "c")], "k long, t string")
    assert sorted(map(tuple, arrow.once(df, "k").collect())) == [(1, "a"), (2, None), (3, "c")]
    assert arrow.once(df.limit(0), "k").count() == 0
