"""Deliveries that keep arriving."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanspark.functions import text as X


def first_deliveries(stream: DataFrame, key: str = "file_id", at: str = "indexed_at", late: str = "31 days") -> DataFrame:
    """Each key once within the time by which a delivery may be late; state older than that is dropped."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def tokens_by_window(stream: DataFrame, at: str = "indexed_at", late: str = "31 days", width: str = "7 days") -> DataFrame:
    """begin, repo_id, n_files, tokens (by the proxy count) of the files delivered in each window of time."""
    rows = stream.select(F.col(at), X.clean_slug(F.col("slug")).alias("repo_id"), X.token_proxy(F.coalesce("text", F.lit(""))).alias("tokens"))
    agg = rows.withWatermark(at, late).groupBy(F.window(at, width), "repo_id").agg(F.count("*").alias("n_files"), F.sum("tokens").alias("tokens"))
    return agg.select(F.col("window.start").alias("begin"), "repo_id", "n_files", "tokens")
