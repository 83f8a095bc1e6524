"""Questions against chunks: BM25, the two tiers, one priority order, and prefixes of it that fit a budget.

Everything is keyed by (variant, repo_id, question), so many questions, budgets and corpus variants are one
job. Ties break by (file_id, chunk_ord, chunk_key), which stands for archive order.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleanspark.functions import text as X
from gleanspark.session import cut_lineage

from . import blocks, ingest
from .words import with_terms

#: Fixed values of the ranking.
K1, B = 1.5, 0.75
NOISE_FLOOR = 0.35
SEEDS = 12
SIBLING_WEIGHT, HOP_DECAY = 0.6, 0.45
DEFINITION_BOOST = 1.4
NEAR_MISSES = 25

KEY = ["variant", "repo_id", "question"]
PLACE = ["file_id", "chunk_ord", "chunk_key"]


def clean_questions(cases: DataFrame) -> DataFrame:
    """repo_id, question, expectation, quarantined, qterms: each case once."""
    one = cases.where(F.col("slug").isNotNull() & F.col("question").isNotNull()).groupBy(X.clean_slug(F.col("slug")).alias("repo_id"), "question").agg(F.max("expectation").alias("expectation"), F.max("quarantined").alias("quarantined"))
    return one.withColumn("qterms", X.question_terms(F.col("question")))


def clean_anchors(anchors: DataFrame) -> DataFrame:
    """repo_id, question, path, line: each anchor once."""
    return anchors.select(X.clean_slug(F.col("slug")).alias("repo_id"), "question", X.clean_path(F.col("path")).alias("path"), F.col("line").cast("bigint").alias("line")).where("path IS NOT NULL AND line IS NOT NULL").distinct()


def covers(chunk_from: str = "start_line", chunk_to: str = "end_line") -> Column:
    """Whether a chunk holds an anchor's line, which counts from 1."""
    return (F.col(chunk_from) <= F.col("line") - 1) & (F.col("line") - 1 < F.col(chunk_to))


def running_totals(rows: DataFrame) -> DataFrame:
    """Adds pos and cum, the place and the running sum of tokens in each key's order: tier, density, tie, place in the archive.

    A key may have a great part of all rows, so none is sorted whole. Rows are dealt into ranges of density (eight an octave, so a few
    hundred a key at most), which are summed before they move; each range is ordered on its own and starts from the sums of those before it.
    """
    octave = F.log2(F.greatest(F.col("density"), F.lit(1e-30)))
    rows = rows.withColumn("range", F.when(F.col("density") == float("inf"), F.lit(-10_000)).otherwise(F.floor(octave * -8)).cast("int"))
    before = Window.partitionBy(*KEY).orderBy("tier", "range").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*KEY, "tier", "range").agg(F.count("*").alias("n"), F.sum("tokens").alias("t"))
    start = sums.select(*KEY, "tier", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"), F.coalesce(F.sum("t").over(before), F.lit(0)).alias("t0"))
    w = Window.partitionBy(*KEY, "tier", "range").orderBy(F.desc("density"), F.desc("tie"), *PLACE)
    inside = rows.withColumns({"n1": F.row_number().over(w), "t1": F.sum("tokens").over(w.rowsBetween(Window.unboundedPreceding, 0))})
    met = inside.join(start, [*KEY, "tier", "range"]).withColumns({"pos": F.col("n0") + F.col("n1"), "cum": F.col("t0") + F.col("t1")})
    return met.drop("worth", "tie", "range", "n0", "t0", "n1", "t1")


def tokenized(chunks: DataFrame) -> DataFrame:
    """Chunks with their terms in place of their texts: what an index keeps of them."""
    return with_terms(chunks).drop("text")


@dataclass
class Retrieval:
    """The stages of answering ``questions`` from ``chunks``, each a DataFrame; what several stages read is written once when first used.

    ``index`` is what ``tokenized`` gave for these chunks before; then nothing is tokenized again.
    """

    files: DataFrame
    chunks: DataFrame
    questions: DataFrame
    index: DataFrame | None = None
    #: Whether everything is joined, as it is for repositories too large to be held by a task; else those are ``rest``, and the others are met in blocks.
    joined: bool = False
    #: The variants that blocks are made for.
    variants: tuple[str, ...] = blocks.VARIANTS

    @cached_property
    def rest(self) -> Retrieval | None:
        """The same over the repositories that no task can hold whole, if there are any."""
        many = blocks.large(self.lengths)
        if many.isEmpty():
            return None
        only = lambda df: df.join(many, "repo_id", "left_semi")
        return Retrieval(only(self.files), only(self.chunks), only(self.questions), only(self.tokenized), joined=True)

    @cached_property
    def blocks(self) -> blocks.Blocks:
        few = (lambda df: df.join(self.rest.lengths.select("repo_id").distinct(), "repo_id", "left_anti")) if self.rest else (lambda df: df)
        weights = [SIBLING_WEIGHT, *[SIBLING_WEIGHT * HOP_DECAY**h for h in (1, 2)]]
        return blocks.Blocks(few(self.tokenized), few(self.question_terms), {"k1": K1, "b": B, "boost": DEFINITION_BOOST, "floor": NOISE_FLOOR, "weights": weights}, self.variants)

    @cached_property
    def best(self) -> DataFrame:
        return self.blocks.best(SEEDS)

    @cached_property
    def tokenized(self) -> DataFrame:
        """The chunks without their texts, with their terms: each tokenized once, however many questions follow."""
        return self.index if self.index is not None else cut_lineage(tokenized(self.chunks))

    @cached_property
    def lengths(self) -> DataFrame:
        """chunk_key, repo_id, path and the number of terms."""
        return self.tokenized.select("chunk_key", "repo_id", "path", F.size("terms").cast("bigint").alias("len"))

    @cached_property
    def corpus(self) -> DataFrame:
        """variant, repo_id: number of chunks and their average length."""
        return ingest.variants(self.lengths).groupBy("variant", "repo_id").agg(F.count("*").alias("n_chunks"), F.avg("len").alias("avg_len"))

    @cached_property
    def question_terms(self) -> DataFrame:
        return self.questions.select("repo_id", "question", F.posexplode("qterms").alias("term_pos", "term"))

    @cached_property
    def postings(self) -> DataFrame:
        """repo_id, chunk_key, path, term, tf of the terms that a question of the repository asks for."""
        asked = self.question_terms.select("repo_id", "term").distinct()
        # Joined by repository and term together: no repository, however large, is one task's.
        hits = self.tokenized.select("repo_id", "chunk_key", "path", F.explode("terms").alias("term")).join(asked, ["repo_id", "term"], "left_semi")
        return hits.groupBy("repo_id", "chunk_key", "path", "term").agg(F.count("*").alias("tf"))

    @cached_property
    def document_frequency(self) -> DataFrame:
        return ingest.variants(self.postings).groupBy("variant", "repo_id", "term").agg(F.count("*").alias("df"))

    @cached_property
    def scored(self) -> DataFrame:
        """Every chunk that has a question's term, with its score and the terms it has in question order."""
        # A repository's figures are joined to its terms, never to its chunks, so that no join has the repository alone as key.
        facts = self.document_frequency.join(self.corpus, ["variant", "repo_id"])
        rows = ingest.variants(self.postings).join(facts, ["variant", "repo_id", "term"])
        rows = rows.join(self.lengths.select("chunk_key", "len"), "chunk_key").join(self.question_terms, ["repo_id", "term"])
        n, df, tf = F.col("n_chunks"), F.col("df"), F.col("tf")
        idf = F.log(1 + (n - df + 0.5) / (df + 0.5))
        average = F.when(F.col("avg_len") == 0, 1.0).otherwise(F.col("avg_len"))
        part = idf * (tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("len") / average)))
        listed = F.array_sort(F.collect_list(F.struct("term_pos", part.alias("part"), "term")))
        per = rows.groupBy(*KEY, "chunk_key").agg(listed.alias("hits"))
        sums = per.select(*KEY, "chunk_key", F.aggregate("hits", F.lit(0.0), lambda a, x: a + x.part).alias("raw"), F.transform("hits", lambda x: x.term).alias("matched"))
        facts = self.tokenized.select("chunk_key", "file_id", "chunk_ord", "path", "start_line", "end_line", "tokens", "defines")
        full = sums.join(facts, "chunk_key").join(self.questions.select("repo_id", "question", "qterms"), ["repo_id", "question"])
        boost = F.when(F.arrays_overlap(F.transform("defines", F.lower), "qterms"), DEFINITION_BOOST).otherwise(1.0)
        # Five later stages read the scores; they are written once.
        return cut_lineage(full.withColumn("score", F.col("raw") * boost).drop("raw", "defines", "qterms"))

    @cached_property
    def direct(self) -> DataFrame:
        return self.scored.where(F.col("score") > NOISE_FLOOR)

    @cached_property
    def saturation(self) -> DataFrame:
        return self.direct.groupBy(*KEY).agg(F.sum("tokens").alias("saturation_tokens"))

    @cached_property
    def seeds(self) -> DataFrame:
        """Files of the best direct chunks."""
        if not self.joined:
            few = self.best.select(*KEY, F.explode("paths").alias("path"))
            return few.unionByName(self.rest.seeds) if self.rest else few
        place = F.row_number().over(Window.partitionBy(*KEY).orderBy(F.desc("score"), *PLACE))
        return self.direct.withColumn("place", place).where(F.col("place") <= SEEDS).select(*KEY, "path").distinct()

    @cached_property
    def edges(self) -> DataFrame:
        return cut_lineage(ingest.import_edges(self.files))

    @cached_property
    def hops(self) -> DataFrame:
        """Files within two imports of a seed, either way, with the fewest hops."""
        e = self.edges
        both = e.select("variant", "repo_id", F.col("src").alias("path"), F.col("dst").alias("to")).unionByName(e.select("variant", "repo_id", F.col("dst").alias("path"), F.col("src").alias("to"))).distinct()
        step = lambda frontier, h: frontier.join(both, ["variant", "repo_id", "path"]).select(*KEY, F.col("to").alias("path"), F.lit(h).alias("hop")).distinct()
        zero = self.seeds.withColumn("hop", F.lit(0))
        one = step(self.seeds, 1)
        two = step(one.select(*KEY, "path"), 2)
        return zero.unionByName(one).unionByName(two).groupBy(*KEY, "path").agg(F.min("hop").alias("hop"))

    @cached_property
    def expansion(self) -> DataFrame:
        """Chunks of reached files that are not direct, scored below every direct one."""
        weakest = self.direct.groupBy(*KEY).agg(F.min("score").alias("weakest"))
        near = self.hops.join(weakest, KEY)
        facts = ingest.variants(self.tokenized.select("chunk_key", "repo_id", "file_id", "chunk_ord", "path", "start_line", "end_line", "tokens"))
        reached = facts.join(near, ["variant", "repo_id", "path"]).join(self.direct.select(*KEY, "chunk_key"), [*KEY, "chunk_key"], "left_anti")
        # Weights are numbers of the plan: powers taken by another library could differ in the last bit and part equal densities.
        weight = reduce(lambda w, h: w.when(F.col("hop") == h, SIBLING_WEIGHT * HOP_DECAY**h), (1, 2), F.when(F.col("hop") == 0, SIBLING_WEIGHT))
        return reached.withColumns({"score": F.col("weakest") * weight, "weight": weight}).drop("weakest")

    @cached_property
    def ordered(self) -> DataFrame:
        """Both tiers in the one order that does not depend on a budget, with the running sum of tokens."""
        cols = [*KEY, "chunk_key", "file_id", "chunk_ord", "path", "start_line", "end_line", "tokens", "score", "hop", "tier", "worth", "tie", "reason"]
        some = F.array_join(F.slice("matched", 1, 3), ", ")
        first = self.direct.select("*", F.lit(0).alias("hop"), F.lit(0).alias("tier"), F.col("score").alias("worth"), F.col("score").alias("tie"), F.concat(F.lit("matched: "), some).alias("reason")).select(*cols)
        how = F.when(F.col("hop") == 0, "same file as a match").when(F.col("hop") == 1, "imported by / imports a match").otherwise(F.concat(F.col("hop"), F.lit(" hops from a match")))
        then = self.expansion.select("*", F.lit(1).alias("tier"), F.col("weight").alias("worth"), F.lit(0.0).alias("tie"), how.alias("reason")).select(*cols)
        # Per token; a chunk without tokens is worth the most, as a division by zero would say. The weakest score is a factor of all of a key's
        # expansion, so it is left out of their order, where it could only part equals by its rounding.
        density = F.coalesce(F.try_divide(F.col("worth"), F.col("tokens")), F.lit(float("inf")))
        return cut_lineage(running_totals(cut_lineage(first.unionByName(then).withColumn("density", density))))

    @cached_property
    def expanded(self) -> DataFrame:
        """Key, chunk_key, hop, score of ``expansion``."""
        cols = [*KEY, "chunk_key", "hop", "score"]
        few = self.blocks.placed(self.hops, self.best, direct=False).select(*cols)
        return few.unionByName(self.rest.expansion.select(*cols)) if self.rest else few

    @cached_property
    def places(self) -> DataFrame:
        """Key, chunk_key, tier, hop, reason, pos, cum of ``ordered``, which is not written for it."""
        cols = [*KEY, "chunk_key", "tier", "hop", "reason", "pos", "cum"]
        few = self.blocks.placed(self.hops, self.best, direct=True).select(*cols)
        return few.unionByName(self.rest.ordered.select(*cols)) if self.rest else few

    def packed(self, budget: int | Column) -> DataFrame:
        """The order with ``kept``: the longest prefix whose tokens fit; it stops at the first miss."""
        return self.ordered.withColumn("kept", F.col("cum") <= budget)

    def near_misses(self, budget: int) -> DataFrame:
        """The best of the direct matches, and of their files' other chunks, that did not fit."""
        place = F.row_number().over(Window.partitionBy(*KEY).orderBy(F.desc("score"), "pos"))
        return self.packed(budget).where("NOT kept AND hop = 0").withColumn("place", place).where(F.col("place") <= NEAR_MISSES)

    @cached_property
    def repo_totals(self) -> DataFrame:
        f = ingest.variants(self.files.select("repo_id", "path", "tokens")).groupBy("variant", "repo_id").agg(F.sum("tokens").alias("naive_tokens"), F.count("*").alias("n_files"))
        c = ingest.variants(self.tokenized.select("repo_id", "path")).groupBy("variant", "repo_id").agg(F.count("*").alias("n_chunks"))
        return f.join(c, ["variant", "repo_id"], "left")

    def report(self, budget: int) -> DataFrame:
        """One row a question: what was selected and what that saves."""
        kept = F.col("kept")
        sums = self.packed(budget).groupBy(*KEY).agg(F.sum(F.when(kept, F.col("tokens")).otherwise(0)).alias("selected_tokens"), F.sum(kept.cast("bigint")).alias("kept_chunks"), F.count_distinct(F.when(kept, F.col("path"))).alias("kept_files"))
        asked = self.repo_totals.join(self.questions.select("repo_id", "question"), "repo_id").join(sums, KEY, "left").join(self.saturation, KEY, "left")
        used, naive = F.coalesce("selected_tokens", F.lit(0)), F.col("naive_tokens")
        return asked.select(
            *KEY, naive, used.alias("selected_tokens"), F.when(naive == 0, 0.0).otherwise((naive - used) / F.greatest(naive, F.lit(1)) * 100).alias("reduction_pct"),
            F.coalesce("saturation_tokens", F.lit(0)).alias("saturation_tokens"), (F.col("n_files") - F.coalesce("kept_files", F.lit(0))).alias("dropped_files"), (F.coalesce("n_chunks", F.lit(0)) - F.coalesce("kept_chunks", F.lit(0))).alias("dropped_chunks"),
        )

    def context(self, budget: int) -> DataFrame:
        """question, context: the kept chunks as one text, best first."""
        kept = self.packed(budget).where("kept").join(self.chunks.select("chunk_key", "text"), "chunk_key")
        one = F.concat(F.lit("--- "), F.col("path"), F.lit(":"), F.col("start_line"), F.lit("-"), F.col("end_line"), F.lit(" ---\n"), F.col("text"))
        parts = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "pos", one.alias("t"))))
        return kept.groupBy(*KEY).agg(parts.alias("p")).select(*KEY, F.concat(F.lit("QUESTION: "), F.col("question"), F.lit("\n\n"), F.array_join(F.transform("p", lambda x: x.t), "\n\n")).alias("context"))
