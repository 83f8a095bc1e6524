"""Repository archives (gzipped tar) as rows of files, and the index and fixture formats."""

from __future__ import annotations

import io
import tarfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanspark.functions import text as X
from gleanspark.operators import ingest
from gleanspark.session import cut_lineage, ship_package

FIXTURE_SCHEMA = """
slug string, question string, budget bigint, note string,
repo struct<slug string, ref string,
  files array<struct<path string, text string, tokens bigint, imports array<string>>>,
  chunks array<struct<id string, path string, startLine int, endLine int, text string, defines array<string>, tokens bigint>>,
  naiveTokens bigint, coverage struct<indexedBytes bigint, seenBytes bigint, pct double, skippedByExt map<string, bigint>>>,
grep struct<naiveTokens bigint, naiveFiles bigint, bestTokens bigint, bestFiles array<string>, bestTerm string, missedByGrep array<string>>
"""


def members(content: bytes) -> Iterator[tuple[int, str, str]]:
    """(order, path without its first folder, text) of an archive's regular files.

    Bytes that are not UTF-8 become replacement characters. Long names of either extension are read.
    """
    with tarfile.open(fileobj=io.BytesIO(content), mode="r:*") as tar:
        n = 0
        for m in tar:
            rel = m.name.split("/", 1)[1] if "/" in m.name else ""
            if m.isreg() and rel:
                yield n, rel, tar.extractfile(m).read().decode("utf-8", "replace")
                n += 1


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """archive, file_ord, path, text of every archive under a path or glob; an archive is read by one task.

    An archive that cannot be read raises: part of a repository is never indexed in silence.
    """
    ship_package(spark)

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, content in zip(b["path"], b["content"]):
                rows = list(members(content))
                if rows:
                    out = pd.DataFrame(rows, columns=["file_ord", "path", "text"])
                    out.insert(0, "archive", name)
                    yield out

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(unpack, "archive string, file_ord bigint, path string, text string")


def read_fixtures(spark: SparkSession, path: str) -> DataFrame:
    """One row a repository document, by the fixed schema."""
    return spark.read.schema(FIXTURE_SCHEMA).json(path, multiLine=True)


def fixture_files(fixtures: DataFrame) -> DataFrame:
    f = fixtures.select(F.lower("slug").alias("repo_id"), F.posexplode("repo.files").alias("file_ord", "f"))
    return f.select("repo_id", F.col("file_ord").cast("bigint").alias("file_ord"), "f.*")


def fixture_chunks(fixtures: DataFrame) -> DataFrame:
    c = fixtures.select(F.lower("slug").alias("repo_id"), F.posexplode("repo.chunks").alias("chunk_pos", "c"))
    return c.select("repo_id", "chunk_pos", "c.id", "c.path", F.col("c.startLine").alias("start_line"), F.col("c.endLine").alias("end_line"), "c.text", "c.defines", "c.tokens")


def repository_files(archived: DataFrame, repo_of: Column | str = "archive") -> DataFrame:
    """file_id, repo_id, path, file_ord, text, tokens: the files of archives as the engine's operators read them.

    ``repo_of`` gives the repository of a row; by default the archive's name without folders and ``.tar.gz``. A file's id is a hash of
    its repository and path.
    """
    name = F.regexp_replace(F.substring_index("archive", "/", -1), r"\.(tar\.gz|tgz|tar)$", "") if isinstance(repo_of, str) and repo_of == "archive" else repo_of
    repo = F.lower(F.trim(F.col(name) if isinstance(name, str) else name))
    text = F.coalesce("text", F.lit(""))
    return archived.select(F.xxhash64(repo, "path").alias("file_id"), repo.alias("repo_id"), "path", F.col("file_ord").cast("bigint").alias("file_ord"), text.alias("text"), X.token_proxy(text).alias("tokens"))


def repository_chunks(files: DataFrame) -> DataFrame:
    """The chunks of files, as ``Retrieval`` and ``analyze`` read them: chunk_key (a hash of repository and chunk id), repo_id, tokens and all that ``chunk_files`` gives."""
    cut = ingest.chunk_files(files).join(files.select("file_id", "repo_id"), "file_id")
    return cut.select(F.xxhash64("repo_id", "id").alias("chunk_key"), "file_id", "repo_id", "id", "path", "chunk_ord", "start_line", "end_line", "text", "defines", X.token_proxy(F.col("text")).alias("tokens"))


def index_archives(spark: SparkSession, path: str, repo_of: Column | str = "archive") -> tuple[DataFrame, DataFrame]:
    """The source files and the chunks of every archive under a path: filtered, refused above the size gate, and cut. Both are written once."""
    files = cut_lineage(ingest.source_files(repository_files(read_archives(spark, path), repo_of)))
    worst = ingest.size_gate(files).where("refused").orderBy("repo_id").limit(5).collect()
    if worst:
        raise ValueError("above the size gate: " + ", ".join(f"{r.repo_id} ({r.source_units})" for r in worst))
    return files, cut_lineage(repository_chunks(files))


def fixtures(files: DataFrame, chunks: DataFrame, questions: DataFrame, grep: DataFrame, coverage: DataFrame, skipped: DataFrame, missed: DataFrame, best: DataFrame) -> DataFrame:
    """One document a repository and question by the fixed schema, from the engine's own frames.

    ``questions`` has repo_id, question, budget, note; ``missed`` and ``best`` have repo_id, question, path. A repository's files and chunks are one
    document by definition, so this is for repositories within the size gate.
    """
    low = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("ord", c.alias("x")))), lambda z: z.x)
    imports = X.import_specifiers(F.col("text"))
    f = files.select("repo_id", F.struct("file_ord", "file_id").alias("ord"), F.struct("path", "text", "tokens", imports.alias("imports")).alias("f"), "tokens").groupBy("repo_id").agg(low(F.col("f")).alias("files"), F.sum("tokens").alias("naiveTokens"))
    one = F.struct("id", "path", F.col("start_line").alias("startLine"), F.col("end_line").alias("endLine"), "text", "defines", "tokens")
    c = chunks.join(files.select("file_id", "file_ord"), "file_id").select("repo_id", F.struct("file_ord", "file_id", "chunk_ord").alias("ord"), one.alias("c")).groupBy("repo_id").agg(low(F.col("c")).alias("chunks"))
    s = skipped.groupBy("repo_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("ext", "units")))).alias("skippedByExt"))
    share = coverage.join(s, "repo_id", "left").select("repo_id", F.struct(F.col("indexed_units").alias("indexedBytes"), F.col("seen_units").alias("seenBytes"), "pct", F.coalesce("skippedByExt", F.expr("cast(map() AS map<string, bigint>)")).alias("skippedByExt")).alias("coverage"))
    paths = lambda d, n: d.groupBy("repo_id", "question").agg(F.array_sort(F.collect_set("path")).alias(n))
    empty = F.array().cast("array<string>")
    g = grep.join(paths(best, "b"), ["repo_id", "question"], "left").join(paths(missed, "m"), ["repo_id", "question"], "left").select(
        "repo_id", "question", F.struct(F.col("naive_tokens").alias("naiveTokens"), F.col("naive_files").alias("naiveFiles"), F.col("best_tokens").alias("bestTokens"), F.coalesce("b", empty).alias("bestFiles"), F.col("best_term").alias("bestTerm"), F.coalesce("m", empty).alias("missedByGrep")).alias("grep")
    )
    repo = f.join(c, "repo_id", "left").join(share, "repo_id", "left").select("repo_id", F.struct(F.col("repo_id").alias("slug"), F.lit("HEAD").alias("ref"), "files", "chunks", "naiveTokens", "coverage").alias("repo"))
    return questions.join(repo, "repo_id").join(g, ["repo_id", "question"], "left").select(F.col("repo_id").alias("slug"), "question", F.col("budget").cast("bigint").alias("budget"), "note", "repo", "grep")


def write_fixtures(documents: DataFrame, path: str) -> None:
    """One JSON document a line."""
    documents.write.mode("overwrite").json(path)


def write_dense(ranks: DataFrame, minimum: DataFrame, path: str, model: str) -> None:
    """What a ranking by vectors needs, a JSON document a question: key, model, reached, minTokens, ranks of the anchors, topPaths."""
    per = ranks.groupBy("repo_id", "question").agg(F.array_sort(F.collect_list(F.struct("path", "line", "rank"))).alias("ranks"))
    rows = minimum.join(per, ["repo_id", "question"], "left").select(F.concat_ws("|", "repo_id", "question").alias("key"), F.lit(model).alias("model"), "reached", F.col("min_tokens").alias("minTokens"), "ranks", F.col("top_paths").alias("topPaths"))
    rows.write.mode("overwrite").json(path)


def write_index(df: DataFrame, path: str, key: str = "repo_id", salt: int = 16) -> None:
    """Parquet in one folder a repository, so that a question about one reads one.

    Rows of a repository are written by up to ``salt`` tasks, dealt by a hash of the row, so a large repository is not one task's.
    """
    part = F.pmod(F.xxhash64(*[c for c, t in df.dtypes if not t.startswith("map")]), F.lit(salt))
    df.repartition(key, part).write.mode("overwrite").partitionBy(key).parquet(path)


def write_context(contexts: DataFrame, path: str) -> None:
    """One text file a question."""
    contexts.select("context").write.mode("overwrite").option("lineSep", "\n").text(path)
