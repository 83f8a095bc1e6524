import io
import json
import tarfile

import pytest
from pyspark.sql import functions as F

from gleanspark.operators import ingest
from gleanspark.plans import analyze as A
from gleanspark.sources import archive
from gleanspark.streaming import first_deliveries, tokens_by_window


def tarball(files):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:gz") as tar:
        for name, body in files:
            info = tarfile.TarInfo(name)
            info.size = len(body)
            tar.addfile(info, io.BytesIO(body))
        folder = tarfile.TarInfo("top/dir/")
        folder.type = tarfile.DIRTYPE
        tar.addfile(folder)
    return out.getvalue()


def test_archives(spark, tmp_path):
    long = "top/" + "d/" * 80 + "x.py"
    (tmp_path / "a.tar.gz").write_bytes(tarball([("top/a.py", "é".encode()), (long, b"x"), ("stray", b"no"), ("top/bad.c", b"\xff")]))
    (tmp_path / "b.tar.gz").write_bytes(tarball([]))
    rows = archive.read_archives(spark, str(tmp_path / "*.tar.gz")).orderBy("file_ord").collect()
    assert [(r.path, r.text) for r in rows] == [("a.py", "é"), (long[4:], "x"), ("bad.c", "�")]


def test_fixtures_and_sinks(spark, tmp_path):
    doc = {"slug": "O/r", "question": "q", "budget": 5, "repo": {"slug": "O/r", "files": [{"path": "a", "text": "t", "tokens": 1, "imports": []}], "chunks": [{"id": "a#0-1", "path": "a", "startLine": 0, "endLine": 1, "text": "t", "defines": ["d"], "tokens": 1}], "naiveTokens": 1}}
    (tmp_path / "f.json").write_text(json.dumps(doc))
    fx = archive.read_fixtures(spark, str(tmp_path / "f.json"))
    files, chunks = archive.fixture_files(fx), archive.fixture_chunks(fx)
    assert files.first().repo_id == "o/r" and chunks.first().end_line == 1
    archive.write_index(files.drop("imports"), str(tmp_path / "index"))
    assert spark.read.parquet(str(tmp_path / "index")).where("repo_id = 'o/r'").count() == 1


@pytest.mark.parametrize(("body", "message"), [
    ("{", "no JSON"), ("[]", "as text"), ({"slug": 1, "question": "q"}, "as text"), ({"slug": "a/b", "question": "  ", "budget": 500}, "no words"), ({"slug": "a/b", "question": "x" * 501, "budget": 500}, "more than 500"),
    ({"slug": "a/b", "question": "q", "budget": 99}, "budget"), ({"slug": "a/b", "question": "q", "budget": "x"}, "budget"), ({"slug": "ab", "question": "q", "budget": 500}, "owner/name"),
])
def test_bad_requests(body, message):
    with pytest.raises(A.BadRequest, match=message) as e:
        A.parse(body)
    assert e.value.status == 400


def test_good_request():
    r = A.parse({"slug": "a/b", "question": " q ", "budget": "500.9", "anchors": [{"path": "p", "line": 3.7}, {"path": 1, "line": 2}, None, {"path": "p", "line": float("nan")}] + [{"path": "z", "line": 1}] * 30})
    assert (r.question, r.budget, len(r.anchors), r.anchors[0]) == ("q", 500, 20, ("p", 3))
    assert A.slug_from("https://host.example/a/b.git") == "a/b" and A.slug_from("nonsense") is None


def test_analyze(spark):
    files = spark.createDataFrame([(1, "a/b", "x.py", 1, "def alpha(): pass", 6), (2, "a/b", "y.md", 2, "alpha notes", 2)], "file_id long, repo_id string, path string, file_ord long, text string, tokens long")
    chunks = files.select(F.col("file_id").alias("chunk_key"), "file_id", "repo_id", "path", F.lit(0).alias("chunk_ord"), F.lit(0).alias("start_line"), F.lit(1).alias("end_line"), "text", F.array().cast("array<string>").alias("defines"), "tokens")
    more = chunks.withColumns({"chunk_key": F.col("chunk_key") + 10, "text": F.lit("nothing here"), "chunk_ord": F.lit(1)})
    req = A.parse({"slug": "a/b", "question": "where is alpha?", "budget": 100, "withMinimum": True, "includeMarkdown": False, "anchors": [{"path": "x.py", "line": 1}]})
    out = A.analyze(req, files, chunks.unionByName(more))
    assert {r.path for r in out["kept"].collect()} == {"x.py"}
    assert out["minimum"].first().source == "user-marked" and out["minimum"].first().exact_tokens == 6
    assert out["report"].first().naive_tokens == 6 and out["grep"].first().best_term == "alpha"
    assert (out["ratio"].first().at_minimum, out["ratio"].first().withheld) == (True, None) and "dense" not in out
    free = A.analyze(A.parse({"slug": "a/b", "question": "where is alpha?", "budget": 100}), files, chunks, dense=spark.createDataFrame([("a/b", "where is alpha?", 3), ("a/b", "other", 4)], "repo_id string, question string, min_tokens long"))
    assert free["ratio"].first().withheld == "nothing selected" and free["ratio"].first().bound_tokens == 0 and [r.min_tokens for r in free["dense"].collect()] == [3]
    big = files.withColumn("text", F.lit("x" * 150_000)).crossJoin(spark.range(20)).drop("id")
    with pytest.raises(A.RepoTooLarge) as e:
        A.gated(big)
    assert e.value.status == 413
    assert ingest.size_gate(files).first().refused is False


def test_stream(spark, tmp_path):
    rows = [(1, "o/r", "a b", "2024-01-01 00:00:00"), (1, "o/r", "a b", "2024-01-03 00:00:00"), (2, "O/R ", None, "2024-01-02 00:00:00"), (3, "o/r", "c", "2024-06-01 00:00:00")]
    spark.createDataFrame(rows, "file_id long, slug string, text string, at string").select("file_id", "slug", "text", F.to_timestamp("at").alias("indexed_at")).write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema("file_id long, slug string, text string, indexed_at timestamp").parquet(str(tmp_path / "in"))
    for df, name in ((first_deliveries(src), "once"), (tokens_by_window(src), "windows")):
        q = df.writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert spark.table("once").count() == 3
    assert [(r.n_files, r.tokens) for r in spark.table("windows").collect()] == [(3, 4)]
