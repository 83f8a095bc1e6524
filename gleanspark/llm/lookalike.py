"""One form for texts that look the same.

Each character is mapped to the plainest one drawn like it: letters and signs by the public table of confusable characters (as ICU,
which Spark ships, holds it), full-width and half-width forms, spaces and hyphens by rule. The mapped texts are grouped in SQL under the
accent-sensitive Unicode collation, which takes composed and combining accents for the same and ignores invisible characters.
What that collation ignores although a reader sees it (digits of different scripts, some vowel marks, joined pictures) is
told apart by an exact comparison inside its classes.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanspark.session import cut_lineage

from .arrow import column, map_batches, raw
from .near_dup import block_pairs, expanded

#: Hyphens and dashes drawn like the hyphen.
HYPHENS = "‐‑‒–−⁃˗﹣➖Ⲻ֊﹘"
#: Invisible characters besides controls and those of the category Cf.
INVISIBLE = "\u034f\u115f\u1160\u17b4\u17b5\u180b\u180c\u180d\u3164\uffa0"

_PLAIN = re.compile(r"[\t\n\r\x0c\x20-\x7e]*")
_PICTURE = "[\U0001F000-\U0001FAFF\u2600-\u27BF]"
#: A joiner between two pictures, and the tags of a flag: invisible characters that change what is seen.
_SEEN = re.compile(f"(?<={_PICTURE})\ufe0f?(\u200d)(?={_PICTURE})|(?<=\U0001F3F4)([\U000E0020-\U000E007E]+\U000E007F)")
_tables: dict[str, dict[str, str]] = {}


def confusables(spark: SparkSession) -> dict[str, str]:
    """Characters drawn like another one, each with the plainest of them, from the public table in ICU.

    The table gives each character a prototype. Kept are single letters, digits and signs with a single prototype, or with that of an ASCII
    character; accents stay. Of several ASCII characters with one prototype (I, l, 1 and |) the one of the character's own kind is taken.
    """
    icu = spark.sparkContext._jvm.com.ibm.icu
    version = icu.lang.UCharacter.getUnicodeVersion().toString()
    if version not in _tables:
        checker = getattr(icu.text, "SpoofChecker$Builder")().build()
        chars = [chr(i) for i in range(0x21, 0x110000) if unicodedata.category(chr(i))[0] in "LNPS" and unicodedata.normalize("NFD", chr(i)) == chr(i)]
        prototype = dict(zip(chars, checker.getSkeleton("\n".join(chars)).split("\n"), strict=True))
        plain: dict[str, list[str]] = {}
        for c in chars:
            if c.isascii():
                plain.setdefault(prototype[c], []).append(c)

        def kind(c: str) -> int:
            return 0 if c.isupper() else 1 if c.islower() else 2 if c.isdigit() else 3

        def plainest(c: str) -> str:
            same = plain.get(prototype[c], [])
            alike = [x for x in same if kind(x) == kind(c)]
            return (alike or [x for x in same if x.islower()] or same or [prototype[c]])[0]

        table = {c: plainest(c) for c in chars if not c.isascii()}
        _tables[version] = {c: x for c, x in table.items() if x != c and len(x) == 1}
    return _tables[version]


class Looks:
    """How texts look, under a table of confusable characters."""

    def __init__(self, letters: dict[str, str]):
        self.letters = letters
        self._mapped, self._seen, self._bare = _Lazy(self._map), _Lazy(self._see), _Lazy(self._base)

    def _map(self, c: str) -> str:
        tag = unicodedata.decomposition(c).split(" ")[0]
        if c in HYPHENS:
            return "-"
        if unicodedata.category(c) == "Zs":
            return " "
        if tag in ("<wide>", "<narrow>", "<noBreak>"):
            return unicodedata.normalize("NFD", unicodedata.normalize("NFKC", c)).translate(self._mapped)
        return self.letters.get(c, c)

    @staticmethod
    def _see(c: str) -> str:
        kind, code = unicodedata.category(c), ord(c)
        gone = kind == "Cf" or c in INVISIBLE or 0xFE00 <= code <= 0xFE0F or 0xE0100 <= code <= 0xE01EF or (kind == "Cc" and c not in "\t\n\r\x0b\x0c\x85")
        return "" if gone else c

    def _base(self, c: str) -> str:
        return "" if unicodedata.category(c)[0] == "M" else self._see(c)

    def mapped(self, text: str | None) -> str | None:
        """The text, its accents apart, with each character mapped to the plainest one drawn like it."""
        if text is None or _PLAIN.fullmatch(text):
            return text
        return unicodedata.normalize("NFD", text).translate(self._mapped)

    def shown(self, mapped: str | None) -> str | None:
        """What a reader sees of a mapped text: accents composed, and no invisible character but where it changes what is seen."""
        if mapped is None or _PLAIN.fullmatch(mapped):
            return mapped
        parts = [x for x in _SEEN.split(mapped) if x is not None]
        return unicodedata.normalize("NFC", "".join(x if x == "\u200d" or "\U000E0020" <= x[:1] <= "\U000E007F" else x.translate(self._seen) for x in parts))

    def fold(self, text: str | None) -> str | None:
        return self.shown(self.mapped(text))

    def base(self, mapped: str) -> str:
        """A mapped text without accents and invisible characters: equal wherever the collation finds two texts equal by either."""
        return mapped if _PLAIN.fullmatch(mapped) else mapped.translate(self._bare)


class _Lazy(dict):
    """str.translate's table, filled as characters are met."""

    def __init__(self, of):
        super().__init__()
        self.of = of

    def __missing__(self, code: int) -> str:
        out = self[code] = self.of(chr(code))
        return out


def _looks(documents: DataFrame) -> Looks:
    return Looks(confusables(documents.sparkSession))


def with_looks(documents: DataFrame) -> DataFrame:
    """doc_id, text, mapped, shown."""
    dtype, letters = documents.schema["doc_id"].dataType.simpleString(), documents.sparkSession.sparkContext.broadcast(_looks(documents).letters)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        looks = Looks(letters.value)
        mapped = [looks.mapped(t) for t in column(b, "text")]
        return pa.RecordBatch.from_arrays([raw(b, "doc_id"), raw(b, "text"), pa.array(mapped, pa.string()), pa.array(list(map(looks.shown, mapped)), pa.string())], ["doc_id", "text", "mapped", "shown"])

    return map_batches(documents.select("doc_id", "text"), run, f"doc_id {dtype}, text string, mapped string, shown string")


def _suspects(documents: DataFrame) -> DataFrame:
    """doc_id, text, mapped, shown of the documents that share their bare letters with a different text.

    Texts that the collation takes for equal, and that look equal, have the same letters without accents and invisible characters, so no class
    is parted here; texts that differ in an accent do meet, and are parted by the collation. Only two hashes a document
    are grouped: a text that very many documents share is two numbers a task.
    """
    dtype, letters = documents.schema["doc_id"].dataType.simpleString(), documents.sparkSession.sparkContext.broadcast(_looks(documents).letters)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        looks = Looks(letters.value)
        k = [int.from_bytes(hashlib.blake2b(looks.base(looks.mapped(t)).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True) for t in column(b, "text")]
        return pa.RecordBatch.from_arrays([raw(b, "doc_id"), raw(b, "h"), pa.array(k, pa.int64())], ["doc_id", "h", "k"])

    known = documents.where(F.col("text").isNotNull())
    seen = cut_lineage(map_batches(known.select("doc_id", F.xxhash64("text").alias("h"), "text"), run, f"doc_id {dtype}, h bigint, k bigint"))
    many = seen.groupBy("k").agg(F.min("h").alias("a"), F.max("h").alias("b")).where("a <> b").select("k")
    # Written first, so Spark knows its size and reads the texts without moving the others where it is small.
    ids = cut_lineage(seen.join(many, "k", "left_semi").select("doc_id").distinct())
    return with_looks(documents.join(ids, "doc_id", "left_semi"))


def classes(documents: DataFrame) -> DataFrame:
    """doc_id, text, canonical: the documents that may have look-alikes, each with its class's canonical text.

    Mapped texts are grouped under the accent- and case-sensitive Unicode collation; members of such a class that a reader
    can tell apart part again. The canonical member is the least of what is seen, by code points, and it is joined back by the same collation.
    """
    return documents.sparkSession.sql(
        """
        WITH one AS (SELECT DISTINCT mapped, shown FROM {suspects}),
             class AS (SELECT mapped COLLATE UNICODE AS form, shown, min(shown) AS canonical FROM one GROUP BY mapped COLLATE UNICODE, shown)
        SELECT d.doc_id, d.text, c.canonical
        FROM {suspects} d JOIN class c ON d.mapped COLLATE UNICODE = c.form AND d.shown = c.shown
        """,
        suspects=cut_lineage(_suspects(documents)),
    )


def canonical_texts(documents: DataFrame) -> DataFrame:
    """doc_id, canonical: one consistent form of every text.

    Texts that look the same get the same form and all others different ones. Null stays null, empty stays empty, and rows of one doc_id
    each keep theirs. A document without look-alikes has what is seen of its mapped text, which is the form its class would have.
    """
    alike = classes(documents).select("doc_id", "text", "canonical").distinct()
    seen = with_looks(documents).select("doc_id", "text", "shown")
    return seen.join(alike, ["doc_id", "text"], "left").select("doc_id", F.coalesce("canonical", "shown").alias("canonical"))


def lookalike_pairs(documents: DataFrame) -> DataFrame:
    """doc_id_a < doc_id_b whose texts look the same but are not the same characters; blank texts are left out.

    Pairs come from the operator's classes. Equal texts of a class are one variant, known by the text itself; variants are paired in blocks
    and then written out for their documents, so a form that very many documents share is no task's, and its copies never meet.
    """
    blank = r"^[\s\p{Z}\p{C}]*$"
    rows = classes(documents).where(~F.col("text").rlike(blank) & ~F.col("canonical").rlike(blank)).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    variants = rows.groupBy("canonical", "text").agg(F.min("doc_id").alias("rep"))
    named = variants.join(variants.groupBy("canonical").agg(F.min("rep").alias("kind"), F.count("*").alias("m")), "canonical").where("m > 1")
    reps = cut_lineage(named.select("text", "canonical", "kind", "rep", "m"))
    links = block_pairs(reps.select("kind", F.col("rep").alias("id"), "m"), ["kind"], "m").select("kind", F.col("x.id").alias("a"), F.col("y.id").alias("b"))
    members = rows.join(reps, ["canonical", "text"]).select("kind", "rep", F.col("doc_id").alias("id")).distinct()
    return expanded(links, cut_lineage(members)).where("x <> y").select(F.least("x", "y").alias("doc_id_a"), F.greatest("x", "y").alias("doc_id_b")).distinct()
