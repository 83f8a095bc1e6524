"""Token counts, their totals, and the encoding of a corpus, under a public tokenizer."""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bpe
from .arrow import clean_slug, column, map_batches, raw

#: The rank file: a parameter of every function that counts or encodes, by default what this setting of the environment names.
RANKS = os.environ.get("GLEANSPARK_RANKS", "/opt/tokenizers/byte_bpe_50k.tiktoken")

#: Spellings of one language, by the form used in totals.
LANGUAGES = {
    "python": "py", "pyi": "py", "typescript": "ts", "tsx": "ts", "javascript": "js", "jsx": "js", "mjs": "js", "cjs": "js",
    "golang": "go", "rust": "rs", "h": "c", "markdown": "md", "english": "en", "french": "fr", "german": "de", "spanish": "es",
}


def language(c: Column) -> Column:
    """One form of a language's name or of a file's extension; null for a null or blank one."""
    low = F.lower(F.trim(c))
    known = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.when(low != "", F.coalesce(F.try_element_at(known, low), low))


def extension(path: Column) -> Column:
    """The part of a path after its last dot, lower-cased; null without one."""
    ext = F.regexp_extract(path, r"\.([^.]*)$", 1)
    return F.when(path.contains("."), F.lower(ext))


def with_token_count(df: DataFrame, text: str = "text", out: str = "n_tokens", ranks: str = RANKS) -> DataFrame:
    """Replace the column ``text`` by the number of its tokens; 0 for null and empty texts."""
    keep = [c for c in df.columns if c != text]
    fields = [df.schema[c] for c in keep]

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        n = bpe.count_tokens(column(b, text), ranks)
        return pa.RecordBatch.from_arrays([*(raw(b, c) for c in keep), pa.array(n, pa.int64())], [*keep, out])

    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), f"`{out}` bigint"])
    return map_batches(df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`")), run, ddl)


def file_tokens(files: DataFrame, ranks: str = RANKS) -> DataFrame:
    """file_id, slug, language, recorded_tokens, n_tokens: each file once, counted afresh.

    A file delivered twice (one file_id) keeps the facts of its latest delivery. Tokens are counted
    before the rows of a file meet, so no text is shuffled. A row without file_id is no file.
    """
    rows = with_token_count(
        files.where(F.col("file_id").isNotNull()).select(
            "file_id", clean_slug(F.col("slug")).alias("slug"), language(extension(F.col("path"))).alias("language"),
            F.col("tokens").cast("bigint").alias("recorded_tokens"), F.col("indexed_at").cast("timestamp_ntz").alias("at"), "text",
        ),
        ranks=ranks,
    )
    best = F.max(F.struct("at", "n_tokens", "recorded_tokens", "slug", "language")).alias("m")
    return rows.groupBy("file_id").agg(best).select("file_id", "m.slug", "m.language", "m.recorded_tokens", "m.n_tokens")


def repo_domains(repos: DataFrame) -> DataFrame:
    """slug, code_domain: the domain of a repository by its latest indexing that names one."""
    at = F.col("indexed_at").cast("timestamp_ntz")
    named = repos.where(F.col("code_domain").isNotNull() & F.col("slug").isNotNull())
    return named.groupBy(clean_slug(F.col("slug")).alias("slug")).agg(F.max(F.struct(at.alias("a"), F.col("code_domain"))).alias("m")).select("slug", "m.code_domain")


def totals(rows: DataFrame, kind: str, dimensions: dict[str, str]) -> DataFrame:
    """record_kind, dimension, value, n_records, n_tokens: exact sums over each of the given columns.

    Every row is expanded to one (dimension, value) pair per dimension and summed before the
    shuffle, so a hot value costs one row per task. Rows without a value are the null value's.
    """
    pairs = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(c).alias("value")) for d, c in dimensions.items()])
    flat = rows.select("n_tokens", F.inline(pairs))
    return flat.groupBy("dimension", "value").agg(F.count("*").alias("n_records"), F.sum("n_tokens").alias("n_tokens")).select(F.lit(kind).alias("record_kind"), "dimension", "value", "n_records", "n_tokens")


def token_budget(files: DataFrame, repos: DataFrame, documents: DataFrame, ranks: str = RANKS) -> DataFrame:
    """Usable tokens of files by slug, language and code_domain, and of documents by source, lang and code_domain.

    Null and empty texts count as records of 0 tokens; empty tables give no rows; extra columns are not read.
    """
    counted = file_tokens(files, ranks).join(repo_domains(repos), "slug", "left")
    docs = with_token_count(documents.select(clean_slug(F.col("source")).alias("source"), language(F.col("lang")).alias("lang"), "code_domain", "text"), ranks=ranks)
    return totals(counted, "file", {"slug": "slug", "language": "language", "code_domain": "code_domain"}).unionByName(
        totals(docs, "document", {"source": "source", "lang": "lang", "code_domain": "code_domain"})
    )


def encode_corpus(documents: DataFrame, id_col: str = "doc_id", text: str = "text", ranks: str = RANKS) -> DataFrame:
    """Token ids of every text, without special tokens; null and empty texts have the empty list.

    One narrow stage: no row moves, every row is kept (rows of one id too). Other columns are not read.
    """
    dtype = documents.schema[id_col].dataType.simpleString()

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        flat, sizes = bpe.encode(column(b, text), ranks)
        offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
        return pa.RecordBatch.from_arrays([raw(b, id_col), pa.ListArray.from_arrays(offsets, pa.array(flat, pa.int32()))], [id_col, "ids"])

    return map_batches(documents.select(id_col, text), run, f"`{id_col}` {dtype}, ids array<int>")
