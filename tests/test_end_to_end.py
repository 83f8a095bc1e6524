import io
import json
import tarfile

import pytest
from pyspark.sql import functions as F

from gleanspark.operators import ingest, measure
from gleanspark.operators.retrieval import Retrieval, clean_questions
from gleanspark.plans import analyze as A
from gleanspark.sources import archive

FILES = {
    "src/walk.ts": 'import { Grid } from "./grid";\n\nexport function walkGrid(grid: Grid) {\n  // visits every cell\n  for (const c of grid.cells) {\n    visit(c);\n  }\n}\n',
    "src/grid.ts": "export class Grid {\n  cells = [];\n  constructor() {}\n  rows() {}\n  cols() {}\n  size() {}\n}\n",
    "lib/fill.c": "#include <stdlib.h>\n\nstatic int fill_cells(struct grid *g) {\n  int i = 0;\n  while (i < g->n) i++;\n  g->full = 1;\n  return i;\n}\n",
    "node_modules/x/y.js": "export const walkGrid = 1\n", "notes.txt": "walkGrid", "docs/a.md": "# How cells are visited\nwalkGrid does it\n", "run.sh": "echo cells\n",
}


def pack(path, files):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:gz") as tar:
        for name, text in files.items():
            info = tarfile.TarInfo(f"top-1234/{name}")
            info.size = len(text.encode())
            tar.addfile(info, io.BytesIO(text.encode()))
    path.write_bytes(out.getvalue())


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("archives")
    pack(folder / "Grid.tar.gz", FILES)
    pack(folder / "empty.tar.gz", {})
    return archive.index_archives(spark, str(folder / "*.tar.gz"), F.concat(F.lit("o/"), F.regexp_extract("archive", r"([^/]+)\.tar\.gz$", 1)))


def test_from_archives_to_an_answer(index):
    files, chunks = index
    assert {r.path for r in files.collect()} == {"src/walk.ts", "src/grid.ts", "lib/fill.c", "docs/a.md"}
    names = {r.path: r.defines for r in chunks.collect() if r.defines}
    assert names["lib/fill.c"] == ["grid", "fill_cells"] and "walkGrid" in names["src/walk.ts"] and names["src/grid.ts"][0] == "Grid"
    assert chunks.select("chunk_key").distinct().count() == chunks.count() and chunks.where("tokens IS NULL OR repo_id <> 'o/grid'").count() == 0
    req = A.parse({"slug": "o/Grid", "question": "where does walkGrid visit cells?", "budget": 5000, "withMinimum": True, "anchors": [{"path": "src/grid.ts", "line": 1}]})
    out = A.analyze(req, files, chunks)
    kept = [r.path for r in out["kept"].collect()]
    assert kept[0] == "src/walk.ts" and "src/grid.ts" in kept
    assert out["minimum"].first().found and out["context"].first().context.startswith("QUESTION: where does walkGrid visit cells?")


def test_fixtures_go_round(spark, index, tmp_path):
    files, chunks = index
    cases = clean_questions(spark.createDataFrame([("o/grid", "where does walkGrid visit cells?", None, None)], "slug string, question string, expectation string, quarantined string"))
    r = Retrieval(files, chunks, cases)
    asked = cases.select("repo_id", "question", F.lit(5000).alias("budget"), F.lit(None).cast("string").alias("note"))
    docs = archive.fixtures(files, chunks, asked, measure.grep_baseline(r), ingest.coverage(files), ingest.skipped_by_ext(files), measure.missed_by_grep(r, 5000), measure.best_files(r))
    archive.write_fixtures(docs, str(tmp_path / "fx"))
    back = spark.read.schema(archive.FIXTURE_SCHEMA).json(str(tmp_path / "fx"))
    one = back.first()
    assert (one.slug, one.budget, len(one.repo.files), one.repo.files[0].path) == ("o/grid", 5000, 4, files.orderBy("file_ord").first().path)
    assert one.repo.naiveTokens == files.agg(F.sum("tokens")).first()[0] and one.grep.bestFiles and one.repo.coverage.pct == 100.0
    want = {(x.id, x.start_line, x.end_line, tuple(x.defines)) for x in chunks.collect()}
    assert {(c.id, c.startLine, c.endLine, tuple(c.defines)) for c in one.repo.chunks} == want
    again = archive.fixture_chunks(back)
    assert {r.id for r in again.collect()} == {i for i, *_ in want}


def test_dense_results_are_written(spark, tmp_path):
    ranks = spark.createDataFrame([("o/r", "q", "a.py", 3, 2), ("o/r", "q", "b.py", 1, None)], "repo_id string, question string, path string, line long, rank long")
    least = spark.createDataFrame([("o/r", "q", False, None, ["a.py"])], "repo_id string, question string, reached boolean, min_tokens long, top_paths array<string>")
    archive.write_dense(ranks, least, str(tmp_path / "d"), "mean of words")
    (line,) = [x for p in (tmp_path / "d").glob("part-*") for x in p.read_text().splitlines()]
    doc = json.loads(line)
    assert doc["key"] == "o/r|q" and doc["reached"] is False and [r.get("rank") for r in doc["ranks"]] == [2, None] and doc["topPaths"] == ["a.py"]


def test_a_repository_above_the_gate_is_refused(spark, tmp_path):
    pack(tmp_path / "big.tar.gz", {f"f{i}.py": "x" * 199_000 for i in range(13)})
    with pytest.raises(ValueError, match="big"):
        archive.index_archives(spark, str(tmp_path / "big.tar.gz"))
