"""Files that import each other, made from the given tables by a rule of their ids, with the chunks and questions that belong to them.

File i belongs to repository made/r(i mod 20) and imports file i - 20, in one of four ways and under one of five kinds of path by its id. So each
repository is a chain, and imports lead to files directly, by a suffix, by an index file, by a package, and over folders up and down.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REPOS = 20


def _repo(n: Column) -> Column:
    return F.concat(F.lit("made/r"), F.pmod(n, F.lit(REPOS)).cast("string"))


def path_of(i: Column) -> Column:
    """The path of file i; every ninth has an extension that is seen but not indexed, or is a change log."""
    name, kind = F.concat(F.lit("m"), i.cast("string")), F.pmod(i, F.lit(5))
    odd = F.when(i % 2 == 0, F.concat(F.lit("src/"), name, F.lit(".sh"))).otherwise(F.concat(F.lit("src/"), name, F.lit("/CHANGELOG.md")))
    plain = (
        F.when(kind == 0, F.concat(F.lit("src/"), name, F.lit(".ts"))).when(kind == 1, F.concat(F.lit("src/"), name, F.lit("/index.js"))).when(kind == 2, F.concat(F.lit("src/"), name, F.lit("/__init__.py")))
        .when(kind == 3, F.concat(F.lit("src/deep/"), name, F.lit(".mjs"))).otherwise(F.concat(F.lit("src/"), name, F.lit(".md")))
    )
    return F.when(i % 9 == 8, odd).otherwise(plain)


def import_of(i: Column) -> Column:
    """The line by which file i imports file i - REPOS, as seen from its own folder."""
    k = i - REPOS
    kind, name = F.pmod(k, F.lit(5)), F.concat(F.lit("m"), k.cast("string"))
    own = F.pmod(i, F.lit(5))
    folder = F.when(i % 9 == 8, F.when(i % 2 == 0, F.lit("./")).otherwise(F.lit("../"))).when((own == 1) | (own == 2), F.lit("../")).when(own == 3, F.lit(".././")).otherwise(F.lit("./"))
    there = F.when(kind == 3, F.concat(F.lit("deep/"), name)).when(kind == 4, F.concat(name, F.lit(".md"))).otherwise(name)
    near = F.concat(folder, there)
    return (
        F.when(i % 4 == 0, F.concat(F.lit('import { a } from "'), near, F.lit('";'))).when(i % 4 == 1, F.concat(F.lit("const b = require('"), near, F.lit("');")))
        .when((i % 4 == 2) & (kind != 4), F.concat(F.lit("from "), F.replace(F.concat(F.lit("src/"), there), F.lit("/"), F.lit(".")), F.lit(" import c"))).otherwise(F.concat(F.lit('export * from "@/'), there, F.lit('"')))
    )


def files(clean: DataFrame) -> DataFrame:
    i = F.col("file_id")
    text = F.concat(import_of(i), F.lit("\n"), F.col("text"))
    return clean.where("file_id IS NOT NULL").select("file_id", _repo(i).alias("repo_id"), path_of(i).alias("path"), "file_ord", text.alias("text"), "tokens")


def chunks(clean: DataFrame) -> DataFrame:
    i = F.col("file_id")
    return clean.where("file_id IS NOT NULL").withColumns({"repo_id": _repo(i), "path": path_of(i)})


def questions(clean: DataFrame) -> DataFrame:
    """Each different question once, asked of the repository of its length."""
    one = clean.groupBy("question").agg(F.max("expectation").alias("expectation"), F.max("quarantined").alias("quarantined"), F.first("qterms").alias("qterms"))
    return one.select(_repo(F.length("question")).alias("repo_id"), "question", "expectation", "quarantined", "qterms")
