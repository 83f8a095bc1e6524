"""Files in: filters, gate, coverage, chunks, imports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleanspark.functions import text as X

from .symbols import with_defines

#: Fixed values.
MAX_FILE_UNITS = 200_000
MAX_SOURCE_UNITS = 2_500_000
MAX_LINES = 80
MIN_LINES = 6


def latest(df: DataFrame, key: str) -> DataFrame:
    """One row of each key: the latest delivery, of equals the one with more recorded tokens."""
    order = F.struct(F.col("indexed_at"), F.coalesce(F.col("tokens"), F.lit(-1)))
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("r")).select(key, *[F.col(f"r.{c}").alias(c) for c in rest])


def clean_files(repo_files: DataFrame) -> DataFrame:
    """file_id, repo_id, path, file_ord, text (never null), tokens: each file once, names and paths in one form."""
    one = latest(repo_files.select("file_id", "slug", "path", "file_ord", "text", "tokens", "indexed_at"), "file_id")
    text = F.coalesce("text", F.lit(""))
    return one.select("file_id", X.clean_slug(F.col("slug")).alias("repo_id"), X.clean_path(F.col("path")).alias("path"), "file_ord", text.alias("text"), X.token_proxy(text).alias("tokens"))


def clean_chunks(chunks: DataFrame) -> DataFrame:
    """chunk_key, file_id, repo_id, path, chunk_ord, start_line, end_line, text, defines, tokens: each chunk once, lines in order."""
    one = latest(chunks.select("chunk_key", "file_id", "slug", "id", "path", "chunk_ord", "start_line", "end_line", "text", "defines", "tokens", "indexed_at"), "chunk_key")
    text = F.coalesce("text", F.lit(""))
    return one.select(
        "chunk_key", "file_id", X.clean_slug(F.col("slug")).alias("repo_id"), "id", X.clean_path(F.col("path")).alias("path"), "chunk_ord", F.least("start_line", "end_line").alias("start_line"), F.greatest("start_line", "end_line").alias("end_line"),
        text.alias("text"), F.coalesce("defines", F.array().cast("array<string>")).alias("defines"), X.token_proxy(text).alias("tokens"),
    )


def with_fate(files: DataFrame) -> DataFrame:
    """Adds units, seen (counts for coverage) and indexed (passes every filter)."""
    p = F.col("path")
    units = X.utf16_units(F.col("text"))
    seen = X.is_code(p) & ~X.in_skipped_dir(p)
    indexed = X.is_source(p) & ~X.in_skipped_dir(p) & ~X.is_skipped_file(p) & (units <= MAX_FILE_UNITS)
    return files.withColumns({"units": units, "seen": F.coalesce(seen, F.lit(False)), "indexed": F.coalesce(indexed, F.lit(False))})


def source_files(files: DataFrame) -> DataFrame:
    return with_fate(files).where("indexed").drop("seen", "indexed", "units")


def size_gate(files: DataFrame, limit: int = MAX_SOURCE_UNITS) -> DataFrame:
    """repo_id, source_units, refused: repositories above the limit are refused whole, before anything costly."""
    sums = with_fate(files.select("repo_id", "path", "text")).where("indexed").groupBy("repo_id").agg(F.sum("units").alias("source_units"))
    return sums.withColumn("refused", F.col("source_units") > limit)


def coverage(files: DataFrame) -> DataFrame:
    """repo_id, seen_units, indexed_units, pct: how much of the code is indexed; 100 where there is none."""
    f = with_fate(files.select("repo_id", "path", "text"))
    sums = f.groupBy("repo_id").agg(F.sum(F.when(F.col("seen"), F.col("units")).otherwise(0)).alias("seen_units"), F.sum(F.when(F.col("seen") & F.col("indexed"), F.col("units")).otherwise(0)).alias("indexed_units"))
    return sums.withColumn("pct", F.coalesce(F.try_divide(F.col("indexed_units") * F.lit(100.0), F.col("seen_units")), F.lit(100.0)))


def skipped_by_ext(files: DataFrame, top: int = 6) -> DataFrame:
    """repo_id, ext, units, place: the extensions most of which was seen and not indexed."""
    f = with_fate(files.select("repo_id", "path", "text")).where("seen AND NOT indexed")
    sums = f.groupBy("repo_id", F.lower(X.extension(F.col("path"))).alias("ext")).agg(F.sum("units").alias("units"))
    place = F.row_number().over(Window.partitionBy("repo_id").orderBy(F.desc("units"), "ext"))
    return sums.withColumn("place", place).where(F.col("place") <= top)


def variants(df: DataFrame) -> DataFrame:
    """Rows once for the variant 'all' and once for 'code', which leaves Markdown out."""
    both = F.when(F.col("path").endswith(".md"), F.array(F.lit("all"))).otherwise(F.array(F.lit("all"), F.lit("code")))
    return df.withColumn("variant", F.explode(both))


def lines(files: DataFrame) -> DataFrame:
    """file_id, path, ln, line."""
    return files.select("file_id", "path", F.posexplode(F.split("text", "\n", -1)).alias("ln", "line"))


def declaration_lines(files: DataFrame) -> DataFrame:
    return lines(files).where((F.col("ln") > 0) & X.is_declaration(F.col("line"))).select("file_id", "ln")


def _blank(c):
    return ~c.rlike(f"[^{X.WHITE}]")


def segments(files: DataFrame) -> DataFrame:
    """file_id, path, idx, start_line, end_line, blank: files cut at declarations, and every MAX_LINES lines within a run.

    One window sort by (file, line) serves both running sums.
    """
    w = Window.partitionBy("file_id", "path").orderBy("ln").rowsBetween(Window.unboundedPreceding, 0)
    head = (F.col("ln") == 0) | X.is_declaration(F.col("line"))
    flagged = lines(files).select("file_id", "path", "ln", head.alias("head"), _blank(F.col("line")).alias("blank"))
    begun = flagged.withColumn("begin", F.max(F.when(F.col("head"), F.col("ln"))).over(w))
    cut = begun.withColumn("idx", F.sum(F.when((F.col("ln") - F.col("begin")) % MAX_LINES == 0, 1).otherwise(0)).over(w))
    return cut.groupBy("file_id", "path", "idx").agg(F.min("ln").alias("start_line"), (F.max("ln") + 1).alias("end_line"), F.min("blank").alias("blank"))


def chunk_files(files: DataFrame) -> DataFrame:
    """file_id, path, chunk_ord, id, start_line, end_line, text, defines: small segments folded into the chunk before, blank ones dropped.

    A segment begins a chunk if it isn't blank and has MIN_LINES lines or is the file's first such; shorter ones
    extend the chunk before; a longer blank one is skipped. The id keeps the end before folding; text and defines are those after it.
    """
    by_file = Window.partitionBy("file_id", "path")
    w = by_file.orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    size = F.col("end_line") - F.col("start_line")
    first = F.min(F.when(~F.col("blank"), F.col("idx"))).over(by_file)
    s = segments(files).withColumn("push", ~F.col("blank") & ((size >= MIN_LINES) | (F.col("idx") == first)))
    s = s.withColumn("chunk", F.sum(F.col("push").cast("int")).over(w)).where((F.col("chunk") > 0) & (F.col("push") | (size < MIN_LINES)))
    head = F.when(F.col("push"), F.col("start_line"))
    spans = s.groupBy("file_id", "path", "chunk").agg(F.max(head).alias("start_line"), F.max("end_line").alias("end_line"), F.max(F.when(F.col("push"), F.col("end_line"))).alias("end0"))
    cut = F.array_join(F.slice(F.split("text", "\n", -1), F.col("start_line") + 1, F.col("end_line") - F.col("start_line")), "\n")
    chunks = spans.join(files.select("file_id", "text"), "file_id").select(
        "file_id", "path", (F.col("chunk") - 1).cast("int").alias("chunk_ord"), F.concat(F.col("path"), F.lit("#"), F.col("start_line"), F.lit("-"), F.col("end0")).alias("id"), "start_line", "end_line", cut.alias("text")
    )
    return with_defines(chunks)


def line_grep(files: DataFrame, needle: str) -> DataFrame:
    """file_id, path, line (from 1), shown (the first 100 characters) of the lines that hold the text, by case."""
    hit = lines(files.where(F.col("text").contains(needle))).where(F.col("line").contains(needle))
    return hit.select("file_id", "path", (F.col("ln") + 1).alias("line"), F.substring(F.trim("line"), 1, 100).alias("shown"))


def import_specs(files: DataFrame) -> DataFrame:
    """repo_id, path, spec; of ``with_specs`` nothing is looked for again."""
    # Outer, since Spark puts filters that look for the specifiers again, twice, before a plain explode.
    found = F.col("specs") if "specs" in files.columns else X.import_specifiers(F.col("text"))
    return files.select("repo_id", "path", F.explode_outer(found).alias("spec")).where("spec IS NOT NULL")


def with_specs(files: DataFrame) -> DataFrame:
    """repo_id, path, tokens, specs: files with what they import in place of their texts."""
    return files.select("repo_id", "path", "tokens", X.import_specifiers(F.col("text")).alias("specs"))


def import_edges(files: DataFrame) -> DataFrame:
    """repo_id, variant, src, dst: which file imports which, by the first candidate path that exists."""
    there = variants(files.select("repo_id", "path")).distinct()
    wanted = variants(import_specs(files)).select("repo_id", "variant", F.col("path").alias("src"), "spec", X.import_base(F.col("path"), F.col("spec")).alias("base")).where(F.col("base").isNotNull())
    tries = wanted.select("repo_id", "variant", "src", "spec", F.posexplode(X.import_candidates(F.col("base"))).alias("place", "path"))
    found = tries.join(there, ["repo_id", "variant", "path"]).groupBy("repo_id", "variant", "src", "spec").agg(F.min_by("path", "place").alias("dst"))
    return found.where("src <> dst").select("repo_id", "variant", "src", "dst").distinct()
