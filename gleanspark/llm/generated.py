"""Generated, minified, vendored and data files among source files."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import grammar, kernel
from .arrow import clean_slug, column, map_batches, once, raw
from .tokens import extension

#: Words of the languages' own, kept apart from names in the grammar of shapes. Types are names: which one stands
#: in a place says nothing of how the place was written.
KEYWORDS = (
    "and async auto await break case catch class const continue crate def default defer delete do elif else enum "
    "except export extends extern final finally fn for from func function go if impl implements import in include inline interface "
    "is lambda let loop map match mod module mut namespace new nil none not null or package pass private pub public raise range "
    "require return self sizeof static struct super switch template this throw trait true try type typedef typeof "
    "union unsafe use using var virtual volatile where while with yield"
).split()

_COMMENT = r"^[ \t]*(?://+|#+(?!include|define|if|endif|pragma)|/\*+|\*|--|;+|<!--|\"\"\"|''')[ \t!]*"
#: A comment that says a tool wrote the file: the tool is named as its maker, or the file as not to be edited.
MARK = re.compile(
    _COMMENT
    + r"(?:[^\n]*?(?:@generated\b|auto-?generated\b|code generated by|(?:automatically|machine)[ -](?:generated|made|written|produced)|generated (?:by|from|with)\b[^\n]*(?:\.[a-z]+|compiler|generator|tool)|"
    r"do not (?:edit|modify)\b|please do not modify|changes? will be (?:lost|overwritten)|(?:do not touch|begin [\w.-]+ output)\W[^\n]*(?:output of|output|source:)|(?:wurde|automatisch)[^\n]*(?:erzeugt|generiert)|"
    r"(?:produit|généré|genere)[a-z]* par\b|(?:generado|producido) por\b|no (?:editar|modificar)))",
    re.I | re.M,
)
#: A comment that says the file was taken from another project.
TAKEN = re.compile(
    _COMMENT
    + r"[^\n]*?(?:\bvendored\b|\bupstream\s*:|fixes go upstream|copied (?:verbatim )?from \w|imported from the \w|snapshot of \w|synced (?:by|from|with)|bundled here|local patches|part of [\w.-]+, version|"
    r"! ?[\w.-]+ v?\d+\.\d+[^\n]*\(c\)|\(c\) [\w.-]+ authors)",
    re.I | re.M,
)
#: A licence line that names the project the file belongs to.
OWNER = re.compile(
    _COMMENT + r"(?:(?P<a>[\w.-]+) is free software\b|This file (?:belongs to|is part of) (?P<b>[\w.-]+?)\.?[ \t]*(?:\*/|-->)?\r?$|Copyright (?:\(c\) )?(?:\d{4} )?(?:by )?the (?P<c>[\w.-]+) (?:contributors|authors|project)|(?P<d>[\w.-]+) project[ \t]*(?:\*/|-->)?\r?$)",
    re.I | re.M,
)
#: Folders that hold other projects' files.
VENDOR_DIR = r"(?i)(^|/)(_?vendor(ed)?|third[_-]?party|3rd[_-]?party|node_modules|bower_components|jspm_packages|external(s|_deps)?|extern|deps|pods|carthage|godeps|site-packages|dist-packages|subprojects|submodules|contrib|_workspace)/"
#: A file name with a version of three numbers.
VERSIONED = r"-v?\d+\.\d+\.\d+[^/]*$"
#: Folders and file names that tools write to.
GENERATED_PATH = r"(?i)(^|/)(gen|autogen|auto-gen|__generated__|generated|codegen-out)/|\.(g|gen|generated|pb|pb2|designer|autogen)\.[a-z]+$|_(pb2|generated|gen)\.[a-z]+$|(^|/)zz_generated"

_TOKEN = np.zeros(256, np.uint8)
_TOKEN[[*range(48, 58)]] = 2
_TOKEN[[*range(65, 91), *range(97, 123), 95, *range(128, 256)]] = 1
_TOKEN[[9, 10, 11, 12, 13, 32]] = 3


def _word(w: str) -> int:
    b = np.frombuffer(w.encode(), np.uint8)
    return int(kernel.span_hashes(b, np.array([0]), np.array([len(b)]))[0])


_known: list[np.ndarray] = []


def tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code tokens: hash, shape hash, text, bytes, whether a number, whether a keyword.

    A token is a run of letters, digits and underscores or any other single byte that isn't blank. Its shape
    is itself for keywords and signs, one symbol for all names, one for all numbers.
    """
    rows = [t.encode("utf-8", "surrogatepass") for t in texts]
    b = np.frombuffer(b"\n".join(rows) + b"\n", np.uint8)
    cls = _TOKEN[b]
    word = (cls == 1) | (cls == 2)
    start = cls != 3
    start[1:] &= ~(word[1:] & word[:-1])
    begin = np.flatnonzero(start)
    after = np.ones(len(b) + 1, bool)
    after[:-1] = ~word
    stop = begin + 1
    w = word[begin]
    turn = np.flatnonzero(~word)
    stop[w] = turn[np.searchsorted(turn, begin[w])]
    h = kernel.span_hashes(b, begin, stop)
    if not _known:
        _known.append(np.sort(np.array([_word(k) for k in KEYWORDS], np.uint64)))
    at = np.minimum(np.searchsorted(_known[0], h), len(_known[0]) - 1)
    keyword = _known[0][at] == h
    number = w & (cls[begin] == 2)
    shape = np.where(number, np.uint64(1), np.where(w & ~keyword, np.uint64(2), h))
    ends = np.cumsum(np.fromiter((len(r) + 1 for r in rows), np.int64, len(rows)))
    return h, shape, np.searchsorted(ends, begin, side="right"), stop - begin, number, keyword


_MARK_HINTS = ("generat", "do not edit", "not modify", "will be lost", "overwritten", "do not touch", "machine", "begin ", "erzeugt", "generiert", "produit", "généré", "genere", " por ", "no editar", "no modificar", "automatically")
_TAKEN_HINTS = ("vendored", "upstream", "copied", "imported from", "snapshot of", "synced", "bundled", "local patches", "part of", "(c)")
_OWNER_HINTS = ("is free software", "this file ", "copyright ", " project")


def _says(pattern: re.Pattern, hints: tuple[str, ...], low: str, text: str) -> bool:
    return any(h in low for h in hints) and pattern.search(text) is not None


def measure(texts: list[str], projects: list[str]) -> dict[str, np.ndarray | list]:
    """The evidence in each text; ``projects`` is each file's project name, for the licence line."""
    n = len(texts)
    h, shape, doc, size, number, keyword = tokens(texts)
    count = lambda m, weights=None: np.bincount(doc[m], weights=None if weights is None else weights[m], minlength=n).astype(float)
    total = np.maximum(np.bincount(doc, minlength=n), 1)
    length, exact, _ = grammar.repair(h, doc, n)
    _, shaped, covered = grammar.repair(shape, doc, n)
    chars = np.maximum(np.bincount(doc, weights=size, minlength=n), 1)
    every = np.ones(len(doc), bool)
    lines = np.fromiter((t.count("\n") + 1 for t in texts), np.int64, n)
    sizes = np.fromiter(map(len, texts), np.int64, n)
    name = (size > 0) & ~number & ~keyword & (shape == 2)
    ph, pd_, pw = grammar.phrases(h, doc)
    cut = np.searchsorted(pd_, np.arange(n + 1))
    foreign, taken, mark = [], [], []
    for t, own in zip(texts, projects):
        low = t.lower()
        foreign.append(bool(own) and any(h in low for h in _OWNER_HINTS) and any(m[m.lastgroup].lower() != own for m in OWNER.finditer(t)))
        taken.append(_says(TAKEN, _TAKEN_HINTS, low, t))
        mark.append(_says(MARK, _MARK_HINTS, low, t))
    return {
        "n": length, "exact": exact / total, "shaped": shaped / total, "covered": covered / total,
        "numbers": count(number) / total, "keywords": count(keyword) / total, "names": count(name) / total,
        "name_size": count(name, size) / np.maximum(count(name), 1), "long": count(size >= 40, size) / chars,
        "blank": 1 - count(every, size) / np.maximum(np.fromiter((len(t.encode("utf-8", "surrogatepass")) for t in texts), np.int64, n), 1),
        "line": sizes / lines, "mark": mark, "taken": taken, "foreign": foreign,
        "phrases": ph, "weights": pw, "cut": cut,
    }


_NUMBERS = ("n", "exact", "shaped", "covered", "numbers", "keywords", "names", "name_size", "long", "blank", "line")
_FLAGS = ("mark", "taken", "foreign")


def evidence(files: DataFrame) -> DataFrame:
    """file_id, slug, path and the evidence in each file's text; each file once. Null texts count as empty."""
    dtype = files.schema["file_id"].dataType.simpleString()

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t or "" for t in column(b, "text")]
        projects = [(s or "").rsplit("/", 1)[-1] for s in column(b, "slug")]
        parts = [measure(texts[lo:hi], projects[lo:hi]) for lo, hi in kernel.blocks(texts)]
        sizes = np.concatenate([np.diff(m["cut"]) for m in parts])
        offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
        flat = {c: np.concatenate([m[c] for m in parts]) for c in ("phrases", "weights")}
        return pa.RecordBatch.from_arrays(
            [
                *(raw(b, c) for c in ("file_id", "slug", "path")), *(pa.array(np.concatenate([m[c] for m in parts]).astype(float)) for c in _NUMBERS), *(pa.array([x for m in parts for x in m[c]], pa.bool_()) for c in _FLAGS),
                pa.ListArray.from_arrays(offsets, pa.array(flat["phrases"].view(np.int64))), pa.ListArray.from_arrays(offsets, pa.array(flat["weights"].astype(np.int32))),
            ], ["file_id", "slug", "path", *_NUMBERS, *_FLAGS, "phrases", "weights"],
        )

    ddl = ", ".join([f"file_id {dtype}, slug string, path string", *(f"{c} double" for c in _NUMBERS), *(f"{c} boolean" for c in _FLAGS), "phrases array<bigint>, weights array<int>"])
    path = F.regexp_replace(F.trim(F.replace(F.col("path"), F.lit("\\"), F.lit("/"))), r"^(\./)+", "")
    rows = files.select("file_id", clean_slug(F.col("slug")).alias("slug"), path.alias("path"), "text")
    return map_batches(once(rows, "file_id"), run, ddl)


def name_keys(path: Column) -> Column:
    """Keys of a file name: each of its words, of any script and length, so that a copy with a changed name is still met; the name itself where it has none."""
    base = F.substring_index(path, "/", -1)
    apart = F.regexp_replace(F.regexp_replace(base, r"(?<=.)\.[^.]*$", ""), r"([\p{Ll}\p{N}])(\p{Lu})", "$1 $2")
    words = F.array_distinct(F.transform(F.regexp_extract_all(apart, F.lit(r"([\p{L}\p{M}\p{N}]+)"), F.lit(1)), F.lower))
    return F.when(F.size(words) > 0, F.transform(words, lambda x: F.xxhash64(x))).when(path.isNotNull(), F.array(F.xxhash64(F.lower(base))))


def shared_rules(measured: DataFrame) -> DataFrame:
    """file_id, shared: the share of a file under rules that a file of like name in another repository has too.

    A rule and a word of the file's name are one key; the least and the greatest repository of a key (as hashes of their slugs) say
    whether repositories share it. Both are kept per task before the shuffle, so a rule that stands in very
    many files is a row a task. Shared keys are a small part of all; they are written first, so Spark knows their size.
    """
    from gleanspark.session import cut_lineage

    parts = F.arrays_zip(F.col("phrases").alias("p"), F.col("weights").alias("w"))
    keyed = measured.where(F.col("slug").isNotNull()).select("file_id", F.xxhash64("slug").alias("repo"), "n", F.explode(name_keys(F.col("path"))).alias("word"), parts.alias("parts"))
    keyed = keyed.select("file_id", "repo", "n", "word", F.inline("parts")).select("file_id", "repo", "n", "word", F.xxhash64("p", "word").alias("key"), "w")
    common = cut_lineage(keyed.groupBy("key").agg(F.min("repo").alias("a"), F.max("repo").alias("b")).where("a <> b").select("key"))
    return keyed.join(common, "key").groupBy("file_id", "word", "n").agg(F.sum("w").alias("w")).groupBy("file_id").agg(F.max(F.col("w") / F.col("n")).alias("shared"))


#: The size of a grammar of shapes, as a share of the symbols, that tells few rules from many: 0.44 for SIZE symbols, falling by this power.
#: Hand-written code needs a larger one at every length, since it repeats itself more the longer it is, but never so much.
FEW, SIZE, POWER = 0.44, 125.0, -0.385


def by_grammar() -> dict[str, Column]:
    """What grammars alone say of a file, by the measures of ``evidence`` and ``shared_rules``.

    - few_rules: a few rules over shapes (names, types and numbers taken alike) write three quarters of it and more;
    - blob: near-incompressible: hardly a rule over the tokens themselves, and a tenth of it in literals of 40 characters and more;
    - shared: half of it is under rules that a file of like name in another repository has too.
    """
    few = (F.col("shaped") <= FEW * F.pow(F.greatest(F.col("n"), F.lit(1.0)) / SIZE, F.lit(POWER))) & (F.col("covered") > 0.75)
    return {"few_rules": few, "blob": (F.col("long") > 0.1) & (F.col("exact") > 0.9), "shared": F.col("shared") >= 0.5}


def kinds(files: DataFrame) -> DataFrame:
    """file_id, kind and the measures it rests on, of every file; kind is null for hand-written source.

    - generated or data: a few rules over shapes write it (data if it is numbers without the language's words), or a comment or
      the path says that a tool wrote it; data too if it is near-incompressible literals, or numbers without the language's words
      (their share with an allowance for few symbols);
    - vendored: most of it is under rules that a file of like name in another repository has too, or it stands in a folder for other
      projects' code, its name carries a release, a comment says where it was taken from or names another project as owner;
    - minified: hardly any blanks, and names of a letter or two (the mean length with an allowance for few names).

    Grammars decide first; notices and paths only add files. Prose (md) is no source and only its folder can make it vendored. Null and empty texts
    have no evidence but their path. Rows of one file_id are one file; a null slug or path gives no evidence.
    """
    from gleanspark.session import cut_lineage

    m = cut_lineage(evidence(files))
    m = m.drop("phrases", "weights").join(shared_rules(m), "file_id", "left").withColumn("shared", F.coalesce("shared", F.lit(0.0)))
    path, code = F.col("path"), F.coalesce(extension(F.col("path")) != "md", F.lit(True))
    signs = {k: code & v for k, v in by_grammar().items()}
    minified = code & (F.col("name_size") + 5 / F.sqrt(1 + F.col("names") * F.col("n")) < 3.6) & (F.col("blank") < 0.09)
    said = code & (path.rlike(VERSIONED) | F.col("taken") | F.col("foreign"))
    table = code & (F.col("numbers") > 0.1 + 1 / F.sqrt(F.greatest(F.col("n"), F.lit(1.0)))) & (F.col("keywords") < 0.02)
    numbers = (F.col("numbers") > 0.1) & (F.col("keywords") < 0.02) & ~F.col("mark")
    kind = (
        F.when(signs["shared"] | path.rlike(VENDOR_DIR) | said, "vendored").when(minified, "minified")
        .when(signs["blob"] | (signs["few_rules"] | table) & numbers, "data").when(signs["few_rules"] | code & (F.col("mark") | path.rlike(GENERATED_PATH)), "generated")
    )
    grammar_says = F.when(signs["few_rules"], "few_rules").when(signs["blob"], "blob").when(signs["shared"], "shared")
    return m.select("file_id", "slug", "path", kind.alias("kind"), grammar_says.alias("grammar"), F.col("n").cast("bigint").alias("n_tokens"), "exact", "shaped", "covered", "shared")


def not_handwritten(files: DataFrame) -> DataFrame:
    """file_id of the files that nobody of their repository wrote by hand as source."""
    return kinds(files).where(F.col("kind").isNotNull()).select(F.col("file_id").cast("bigint").alias("file_id"))
