"""Column expressions over source text: terms, token proxy, declarations, imports, paths.

All are built-in Spark SQL expressions, so they stay inside generated code and need no Python worker.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words left out of a question.
STOP_WORDS = (
    "how does do the this that what when where why which who is are was were and or but for with from into onto on in at to of it its work works working use used uses get set make made "
    "can will would should there here than then all any some not you your way doing done"
).split()

#: Extensions that are indexed, and those that count as code at all.
SOURCE_EXT = "ts|tsx|js|jsx|mjs|cjs|py|go|rs|java|rb|php|md|c|h|cc|cpp|cxx|hpp|cu|cuh|cs|kt|swift|scala|m|mm"
CODE_EXT = SOURCE_EXT + "|sh|bash|zsh|pl|lua|r|jl|dart|ex|exs|erl|hs|ml|clj|vue|svelte|sql|proto"
#: Folders and files that are never indexed.
SKIP_DIR = "(^|/)(node_modules|[.]git|[.]github|dist|build|out|vendor|[.]next|coverage|__pycache__|test|tests|__tests__|fixtures|examples?)/"
SKIP_FILE = "(^|/)(CONTRIBUTING|CHANGELOG|CODE_OF_CONDUCT|SECURITY|LICENSE|MIGRATION)[.]md$"
#: Words that begin a declaration.
DECLARATION = r"^(export\s+)?(async\s+)?(function|class|const|let|var|interface|type|enum|def|struct|impl|fn|func|package|public|private|protected|typedef|template|namespace)\b"
#: Suffixes tried for an import, in this order.
IMPORT_EXT = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".py")
#: The shapes of import statements; the specifier is group 1.
IMPORT_PATTERNS = (
    r"""\bimport\s+[^'"]*?from\s*['"]([^'"]+)['"]""",
    r"""\bimport\s*['"]([^'"]+)['"]""",
    r"""\brequire\s*\(\s*['"]([^'"]+)['"]\s*\)""",
    r"""\bexport\s+[^'"]*?from\s*['"]([^'"]+)['"]""",
    r"""(?m)^\s*from\s+([\w.]+)\s+import\b""",
)
#: The names that a keyword defines; the name is group 1 or 2.
DEFINED_NAME = r"\b(?:function|class|interface|type|enum|def|struct|fn|func|impl|typedef)\s+([A-Za-z_$][\w$]*)|\b(?:const|let|var)\s+([A-Za-z_$][\w$]*)"

#: What counts as white space, within the brackets of a class.
WHITE = r"\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"


def jvm(pattern: str) -> str:
    r"""A fixed pattern for the JVM, where \s lacks the no-break space and others, and \b counts letters of all scripts as parts of words (up to Java 18).

    A word at the begin of a pattern is looked for first and its border after it, for then the JVM skips to it instead of testing each place.
    """
    word = "[A-Za-z0-9_]"
    if "|" not in pattern:
        pattern = re.sub(r"^\\b([a-z]{4,})", rf"\1(?<!{word}\1)", pattern)
    return pattern.replace(r"\s", f"[{WHITE}]").replace(r"\b", f"(?:(?<!{word})(?={word})|(?<={word})(?!{word}))")


def clean_slug(c: Column) -> Column:
    return F.lower(F.trim(c))


def clean_path(c: Column) -> Column:
    """Slashes one way, no leading ./"""
    return F.regexp_replace(F.replace(F.trim(c), F.lit("\\"), F.lit("/")), "^([.]/)+", "")


def utf16_units(c: Column) -> Column:
    """Length in UTF-16 units, which is what the limits count."""
    return (F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("bigint")


def token_proxy(c: Column) -> Column:
    """A deterministic stand-in for a tokenizer's count: words, numbers by up to three digits, and signs."""
    return F.regexp_count(c, F.lit("[A-Za-z]+|[0-9]{1,3}|[^A-Za-z0-9 \t\r\n]")).cast("bigint")


def terms(c: Column) -> Column:
    """Identifiers, lower-cased, each followed by its parts (of camelCase and snake_case) if it has several longer than two."""
    word = F.regexp_extract_all(c, F.lit("[A-Za-z_$][A-Za-z0-9_$]*"), F.lit(0))

    def parts(t: Column) -> Column:
        apart = F.split(F.regexp_replace(t, "([a-z0-9])([A-Z])", "$1 $2"), "[_$ ]+")
        return F.transform(F.filter(apart, lambda z: F.length(z) > 2), F.lower)

    # Only a word with a capital, an underscore or a dollar sign can have several parts.
    plain = lambda t: (F.lower(t) == t) & ~F.contains(t, F.lit("_")) & ~F.contains(t, F.lit("$"))
    both = F.transform(word, lambda t: F.struct(F.lower(t).alias("w"), F.when(plain(t), F.array().cast("array<string>")).otherwise(parts(t)).alias("p")))
    return F.flatten(F.transform(both, lambda s: F.when(F.size(s.p) > 1, F.concat(F.array(s.w), s.p)).otherwise(F.array(s.w))))


def question_terms(c: Column) -> Column:
    """Different terms of a question in order of first occurrence, without stop words."""
    return F.filter(F.array_distinct(terms(c)), lambda t: ~t.isin(*STOP_WORDS))


def extension(path: Column) -> Column:
    return F.substring_index(path, ".", -1)


def is_source(path: Column) -> Column:
    return path.rlike(f"(?i)[.]({SOURCE_EXT})$")


def is_code(path: Column) -> Column:
    return path.rlike(f"(?i)[.]({CODE_EXT})$")


def in_skipped_dir(path: Column) -> Column:
    return path.rlike(f"(?i){SKIP_DIR}")


def is_skipped_file(path: Column) -> Column:
    return path.rlike(f"(?i){SKIP_FILE}")


def structural_definition(line: Column) -> Column:
    """A C-like definition at column 0: words, a name, an open parenthesis, no semicolon after it.

    The test is made on the part before the first parenthesis, step by step, so that no regular expression
    recurses per word on long lines.
    """
    head = F.substring_index(line, "(", 1)
    tail = F.substring(line, F.length(head) + 1, F.length(line))
    return (
        line.contains("(") & ~tail.contains(";")
        & head.rlike(rf"^[A-Za-z_*][A-Za-z0-9_*{WHITE}]*$") & ~head.rlike(rf"(^|[*{WHITE}])[0-9]") & ~head.rlike(jvm(r"[A-Za-z0-9_]\*|\*\s")) & head.rlike(rf"[*{WHITE}][A-Za-z_][A-Za-z0-9_]*[{WHITE}]*$")
    )


def is_declaration(line: Column) -> Column:
    """Whether a line (not the first of its file) begins a declaration."""
    body = F.regexp_replace(line, jvm(r"^\s+"), "")
    indented = line.rlike(jvm(r"^\s"))
    return (F.length(line) > 0) & (body.rlike(jvm(DECLARATION)) | (~indented & structural_definition(line)))


def import_specifiers(text: Column) -> Column:
    """Different specifiers that a file imports, pattern by pattern."""
    return F.array_distinct(F.concat(*[F.regexp_extract_all(text, F.lit(jvm(p)), F.lit(1)) for p in IMPORT_PATTERNS]))


def keyword_symbols(text: Column) -> Column:
    """Different names that a text defines by a keyword."""
    one, two = (F.regexp_extract_all(text, F.lit(jvm(DEFINED_NAME)), F.lit(g)) for g in (1, 2))
    return F.array_distinct(F.filter(F.zip_with(one, two, lambda a, b: F.when(a != "", a).otherwise(b)), lambda x: x != ""))


def normal_path(p: Column) -> Column:
    """Resolve . and .. of a relative path; an empty result is '.'."""
    steps = F.filter(F.split(p, "/"), lambda z: ~z.isin("", "."))
    empty = F.array().cast("array<string>")
    up = lambda a, z: (z == "..") & (F.size(a) > 0) & (F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit("")) != "..")
    kept = F.aggregate(steps, empty, lambda a, z: F.when(up(a, z), F.slice(a, 1, F.size(a) - 1)).otherwise(F.concat(a, F.array(z))))
    joined = F.array_join(kept, "/")
    return F.when(joined == "", ".").otherwise(F.when(p.endswith("/"), F.concat(joined, F.lit("/"))).otherwise(joined))


def folder(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit("."))


def import_base(path: Column, spec: Column) -> Column:
    """The path an import points at before suffixes are tried; null for packages."""
    return (
        F.when(spec.startswith("."), normal_path(F.concat(folder(path), F.lit("/"), spec)))
        .when(spec.startswith("@/"), normal_path(F.concat(F.lit("src/"), F.substring(spec, 3, F.length(spec)))))
        .when(spec.contains(".") & ~spec.contains("/"), F.replace(spec, F.lit("."), F.lit("/")))
    )


def import_candidates(base: Column) -> Column:
    """Paths to try for an import, in order."""
    tries = [base]
    for e in IMPORT_EXT:
        tries += [F.concat(base, F.lit(e)), F.concat(base, F.lit(f"/index{e}")), F.concat(base, F.lit(f"/__init__{e}"))]
    return F.array(*tries)
