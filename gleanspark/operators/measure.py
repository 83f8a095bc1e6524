"""Measures of retrieval: recall, minimum budgets, baselines, sweeps and corpus profiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleanspark.functions import text as X
from gleanspark.session import cut_lineage

from . import ingest
from .retrieval import KEY, Retrieval, covers

#: Fixed values.
BUDGETS = (1000, 4000, 8000, 16000, 32000)
SEARCH_STEP = 64

#: Parts into which a repository's files are dealt where they meet something of the repository's.
SALT = 16


def anchor_depth(r: Retrieval, anchors: DataFrame) -> DataFrame:
    """Key, path, line, depth: the tokens of the shortest prefix of the order that holds an anchor; null if none does."""
    asked = anchors.join(r.repo_totals.select("variant", "repo_id"), "repo_id").join(r.questions.select("repo_id", "question"), ["repo_id", "question"])
    rows = r.ordered.select(*KEY, "path", "start_line", "end_line", "cum")
    held = asked.join(rows, [*KEY, "path"]).where(covers()).groupBy(*KEY, "path", "line").agg(F.min("cum").alias("depth"))
    return asked.join(held, [*KEY, "path", "line"], "left").select(*KEY, "path", "line", "depth")


def recall(depths: DataFrame, budgets: tuple[int, ...] = BUDGETS) -> DataFrame:
    """Key, budget, found, total, pct: a budget holds an anchor if the prefix that holds it fits."""
    each = depths.withColumn("budget", F.explode(F.array(*[F.lit(b) for b in budgets])))
    sums = each.groupBy(*KEY, "budget").agg(F.sum(F.coalesce(F.col("depth") <= F.col("budget"), F.lit(False)).cast("bigint")).alias("found"), F.count("*").alias("total"))
    return sums.withColumn("pct", F.col("found") * 100.0 / F.col("total"))


def budget_sweep(r: Retrieval, depths: DataFrame) -> DataFrame:
    """variant, budget, mean_pct, n_questions over the questions that are not quarantined."""
    fit = r.questions.where("quarantined IS NULL").select("repo_id", "question")
    return recall(depths).join(fit, ["repo_id", "question"], "left_semi").groupBy("variant", "budget").agg(F.avg("pct").alias("mean_pct"), F.count("*").alias("n_questions"))


def _steps(top: int) -> tuple[int, ...]:
    steps, b = [], 200
    while b <= top:
        steps.append(b)
        b = -(-b * 135 // 100)
    return tuple(steps)


def _drops(found: DataFrame) -> DataFrame:
    w = Window.partitionBy(*KEY).orderBy("budget")
    return found.withColumn("before", F.lag("found").over(w)).where("found < before").select(*KEY, "budget", "found", "before")


def monotone_violations(depths: DataFrame, top: int = 120_000) -> DataFrame:
    """Budgets at which fewer depths fit than at the one before; by definition there is none, so this says nothing about the packing."""
    return _drops(recall(depths, _steps(top)))


def found_by_packing(r: Retrieval, anchors: DataFrame, budgets: tuple[int, ...]) -> DataFrame:
    """Key, budget, found, at the budgets up to the repository's size: anchors that a chunk kept at that budget holds, as ``packed`` says."""
    asked = anchors.join(r.repo_totals.select("variant", "repo_id", "naive_tokens"), "repo_id").join(r.questions.select("repo_id", "question"), ["repo_id", "question"])
    each = asked.withColumn("budget", F.explode(F.array(*[F.lit(b) for b in budgets]))).where("budget <= naive_tokens")
    # Packed anew for each budget: what is kept at one says nothing of what is kept at the next.
    kept = reduce(DataFrame.unionByName, [r.packed(b).where("kept").select(*KEY, "path", "start_line", "end_line", F.lit(b).alias("budget")) for b in budgets])
    held = asked.join(kept, [*KEY, "path"]).where(covers()).select(*KEY, "path", "line", "budget").distinct().withColumn("held", F.lit(1))
    return each.join(held, [*KEY, "path", "line", "budget"], "left").groupBy(*KEY, "budget").agg(F.count("held").alias("found"))


def packing_violations(r: Retrieval, anchors: DataFrame, top: int = 120_000) -> DataFrame:
    """Budgets at which the packing holds fewer anchors than at the one before; there should be none."""
    return _drops(found_by_packing(r, anchors, _steps(top)))


def minimum_budget(r: Retrieval, depths: DataFrame, step: int = SEARCH_STEP) -> DataFrame:
    """Key, found, exact_tokens, min_budget, tokens_used, probes.

    The order does not depend on the budget, so the least budget that holds every anchor is the largest of the
    anchors' depths. ``min_budget`` and ``probes`` are what a bisection down to ``step`` from the repository's
    size would report; it is arithmetic on that number.
    """
    need = depths.groupBy(*KEY).agg(F.max("depth").alias("t"), F.sum(F.col("depth").isNull().cast("int")).alias("lost"))
    rows = need.join(r.repo_totals.select("variant", "repo_id", F.col("naive_tokens").alias("ceiling")), ["variant", "repo_id"])
    found = (F.col("lost") == 0) & (F.col("t") <= F.col("ceiling"))
    state = F.expr(
        f"""aggregate(sequence(1, 60), named_struct('lo', 0L, 'hi', ceiling, 'p', 1L),
            (s, i) -> if(s.hi - s.lo > {step}, if((s.lo + s.hi) div 2 >= t,
                named_struct('lo', s.lo, 'hi', (s.lo + s.hi) div 2, 'p', s.p + 1L), named_struct('lo', (s.lo + s.hi) div 2, 'hi', s.hi, 'p', s.p + 1L)), s))"""
    )
    rows = rows.withColumn("found", found).withColumn("s", F.when(F.col("found"), state))
    settled = rows.select(*KEY, "found", F.when(F.col("found"), F.col("t")).alias("exact_tokens"), F.col("s.hi").alias("min_budget"), F.coalesce(F.col("s.p") + 1, F.lit(1)).alias("probes"))
    used = settled.where("found").join(r.ordered.select(*KEY, "cum"), KEY).where("cum <= min_budget").groupBy(*KEY).agg(F.max("cum").alias("tokens_used"))
    return settled.join(used, KEY, "left")


def minimum_used(r: Retrieval, anchors: DataFrame, step: int = SEARCH_STEP) -> DataFrame:
    """Key, tokens_used of ``minimum_budget``, of the variants of ``r``. The order is made in blocks and not written; repositories too large for a block are joined."""
    key = ["repo_id", "question"]
    totals = r.repo_totals.where(F.col("variant").isin(*r.variants)).select("variant", "repo_id", "naive_tokens")
    asked = cut_lineage(anchors.join(r.questions.select(*key), key).groupBy(*key).agg(F.collect_list(F.struct("path", "line")).alias("anchors")).join(totals.groupBy("repo_id").agg(F.collect_list(F.struct("variant", "naive_tokens")).alias("ceilings")), "repo_id"))
    used = r.blocks.needed(r.hops, r.best, asked, step)
    if r.rest:
        used = used.unionByName(minimum_budget(r.rest, anchor_depth(r.rest, anchors), step).select(*KEY, "tokens_used"))
    return asked.select(*key, F.explode("ceilings.variant").alias("variant")).join(used, KEY, "left").select(*KEY, "tokens_used")


def grep_hits(r: Retrieval, variant: str = "all") -> DataFrame:
    """repo_id, question, term_pos, term, path, tokens: files that hold a question's term anywhere, by any case.

    A file meets the different terms asked of its repository as one row, so its text is never copied per term;
    the terms it holds then meet their questions. The terms are written first, so Spark knows their size and broadcasts them if they
    are small; else a repository's files are dealt into ``SALT`` parts and its terms given to each.
    """
    asked = r.question_terms.where(F.length("term") > 3)
    files = r.files if variant == "all" else r.files.where("path NOT LIKE '%.md'")
    wanted = cut_lineage(asked.groupBy("repo_id").agg(F.collect_set("term").alias("terms")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)))))
    held = files.withColumn("salt", F.pmod(F.xxhash64("path"), F.lit(SALT)).cast("int")).join(wanted, ["repo_id", "salt"]).withColumn("low", F.lower("text")).select("repo_id", "path", "tokens", F.expr("explode(filter(terms, t -> contains(low, t)))").alias("term"))
    return held.join(asked, ["repo_id", "term"]).select("repo_id", "question", "term_pos", "term", "path", "tokens")


def grep_baseline(r: Retrieval, variant: str = "all") -> DataFrame:
    """repo_id, question, naive_files, naive_tokens (any term), best_term, best_files, best_tokens (the rarest term)."""
    return _grep_baseline(r, grep_hits(r, variant))


def best_files(r: Retrieval, variant: str = "all") -> DataFrame:
    """repo_id, question, path of the files that the rarest term reaches."""
    hits = cut_lineage(grep_hits(r, variant))
    best = _grep_baseline(r, hits).select("repo_id", "question", F.col("best_term").alias("term"))
    return hits.join(best, ["repo_id", "question", "term"]).select("repo_id", "question", "path")


def token_cost(r: Retrieval, budget: int) -> DataFrame:
    """repo_id, question, all_tokens, best_term, grep_tokens, selected_tokens: what a question costs by the whole repository, by the rarest term and by selection."""
    grep = grep_baseline(r).select("repo_id", "question", "best_term", F.col("best_tokens").alias("grep_tokens"))
    chosen = r.report(budget).where("variant = 'all'").select("repo_id", "question", F.col("naive_tokens").alias("all_tokens"), "selected_tokens")
    return chosen.join(grep, ["repo_id", "question"]).select("repo_id", "question", "all_tokens", "best_term", "grep_tokens", "selected_tokens")


def grep_ratio(r: Retrieval, depths: DataFrame, minimum: DataFrame, budget: int) -> DataFrame:
    """variant, repo_id, question, ratio, at_minimum, withheld, bound_tokens: the advantage over the rarest term, or why none is given.

    The ratio divides by the tokens of the minimum where one was found, else by those selected at ``budget``. It is withheld where
    nothing was selected, where no anchors are known, and where not all of them were retrieved. Where no anchors are known, bound_tokens
    is the saturation of the selection, an upper bound of what it can need.
    """
    full = recall(depths, (budget,)).select(*KEY, "pct")
    rows = r.report(budget).select(*KEY, "selected_tokens", "saturation_tokens").join(full, KEY, "left").join(minimum.select(*KEY, "found", "tokens_used"), KEY, "left")
    hits = reduce(DataFrame.unionByName, [grep_baseline(r, v).select(F.lit(v).alias("variant"), "repo_id", "question", "best_tokens") for v in ("all", "code")])
    rows = rows.join(hits, KEY)
    at = F.coalesce(F.col("found") & (F.col("tokens_used") > 0), F.lit(False))
    why = F.when(at, F.lit(None).cast("string")).when(F.col("selected_tokens") == 0, "nothing selected").when(F.col("pct").isNull(), "no anchors").when(F.col("pct") < 100, "not retrieved")
    ratio = F.when(why.isNull(), F.try_divide(F.col("best_tokens") * 1.0, F.when(at, F.col("tokens_used")).otherwise(F.col("selected_tokens"))))
    return rows.select(*KEY, ratio.alias("ratio"), at.alias("at_minimum"), why.alias("withheld"), F.when(F.col("pct").isNull(), F.col("saturation_tokens")).alias("bound_tokens"))


def anchors_of_marked(marked: DataFrame) -> DataFrame:
    """repo_id, question, path, line: the anchor that marking a chunk sets, on its first line, which counts from 1."""
    return marked.select("repo_id", "question", "path", (F.col("start_line") + 1).cast("bigint").alias("line"))


def dense_against_selector(minimum: DataFrame, dense: DataFrame) -> DataFrame:
    """repo_id, question, selector_tokens, dense_tokens, winner: which ranking needs fewer tokens for all anchors; null where neither reaches them."""
    mine = minimum.where("variant = 'all'").select("repo_id", "question", F.col("tokens_used").alias("selector_tokens"))
    both = mine.join(dense.select("repo_id", "question", F.col("min_tokens").alias("dense_tokens")), ["repo_id", "question"])
    a, b = F.col("selector_tokens"), F.col("dense_tokens")
    winner = F.when(a.isNull() & b.isNull(), None).when(b.isNull() | (a < b), "selector").when(a.isNull() | (b < a), "dense").otherwise("tie")
    return both.withColumn("winner", winner)


def _grep_baseline(r: Retrieval, hits: DataFrame) -> DataFrame:
    union = hits.select("repo_id", "question", "path", "tokens").distinct().groupBy("repo_id", "question").agg(F.count("*").alias("naive_files"), F.sum("tokens").alias("naive_tokens"))
    per = hits.groupBy("repo_id", "question", "term", "term_pos").agg(F.count("*").alias("n"), F.sum("tokens").alias("best_tokens"))
    place = F.row_number().over(Window.partitionBy("repo_id", "question").orderBy("n", "term_pos"))
    best = per.withColumn("place", place).where("place = 1").select("repo_id", "question", F.col("term").alias("best_term"), F.col("n").alias("best_files"), "best_tokens")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return r.questions.select("repo_id", "question").join(union, ["repo_id", "question"], "left").join(best, ["repo_id", "question"], "left").select("repo_id", "question", zero("naive_files"), zero("naive_tokens"), "best_term", zero("best_files"), zero("best_tokens"))


def missed_by_grep(r: Retrieval, budget: int) -> DataFrame:
    """Key, path: files that the selection reached and the rarest term does not."""
    chosen = r.packed(budget).where("kept AND variant = 'all'").select("repo_id", "question", "path").distinct()
    return chosen.join(best_files(r), ["repo_id", "question", "path"], "left_anti")


def markdown_effect(minimum: DataFrame) -> DataFrame:
    """repo_id, question, with_md, code_only, change_pct, verdict: the minimum with and without Markdown."""
    side = lambda v, n: minimum.where(F.col("variant") == v).select("repo_id", "question", F.col("tokens_used").alias(n))
    both = side("all", "with_md").join(side("code", "code_only"), ["repo_id", "question"], "full")
    verdict = F.when(F.col("with_md").isNull() & F.col("code_only").isNotNull(), "NOW FOUND").when(F.col("with_md").isNotNull() & F.col("code_only").isNull(), "NOW LOST").otherwise("-")
    return both.select("repo_id", "question", "with_md", "code_only", F.try_divide((F.col("with_md") - F.col("code_only")) * 100.0, F.col("with_md")).alias("change_pct"), verdict.alias("verdict"))


def minimum_against_grep(r: Retrieval, minimum: DataFrame) -> DataFrame:
    """repo_id, question, naive_tokens, tokens, grep_tokens, ratio, share: the selector's minimum and the best grep.

    Where the anchors are never found the whole repository counts as needed.
    """
    mine = minimum.where("variant = 'all'").join(r.repo_totals.where("variant = 'all'").select("repo_id", "naive_tokens"), "repo_id")
    rows = mine.join(grep_baseline(r).select("repo_id", "question", F.col("best_tokens").alias("grep_tokens")), ["repo_id", "question"])
    tokens = F.coalesce("tokens_used", "naive_tokens")
    return rows.select("repo_id", "question", "found", "naive_tokens", tokens.alias("tokens"), "grep_tokens", F.try_divide(F.col("grep_tokens") * 1.0, tokens).alias("ratio"), F.try_divide(F.col("grep_tokens") * 1.0, "naive_tokens").alias("share"))


def selectivity(against: DataFrame) -> DataFrame:
    """solved, n, mean_share, mean_ratio, mean_tokens: whether the advantage follows how selective the words are."""
    return against.groupBy((F.coalesce("ratio", F.lit(0.0)) > 1).alias("solved")).agg(F.count("*").alias("n"), F.avg("share").alias("mean_share"), F.avg("ratio").alias("mean_ratio"), F.avg("naive_tokens").alias("mean_tokens"))


def chunk_quality(chunks: DataFrame) -> DataFrame:
    """repo_id, n, upper_median_lines, pct_forced (exactly MAX_LINES), pct_with_symbol."""
    size = (F.col("end_line") - F.col("start_line")).cast("bigint")
    rows = chunks.where("start_line IS NOT NULL AND end_line IS NOT NULL").select("repo_id", size.alias("size"), (F.size("defines") > 0).alias("named"))
    counts = rows.groupBy("repo_id", "size").agg(F.count("*").alias("m"), F.sum(F.col("named").cast("bigint")).alias("k"))
    # The upper median from the counts by size, which are few, not from a list of all sizes.
    w = Window.partitionBy("repo_id").orderBy("size").rowsBetween(Window.unboundedPreceding, 0)
    run = counts.withColumns({"below": F.sum("m").over(w), "n": F.sum("m").over(Window.partitionBy("repo_id"))})
    return run.groupBy("repo_id").agg(
        F.max("n").alias("n"), F.min(F.when(F.col("below") > F.floor(F.col("n") / 2), F.col("size"))).alias("upper_median_lines"),
        (F.sum(F.when(F.col("size") == ingest.MAX_LINES, F.col("m")).otherwise(0)) * 100.0 / F.sum("m")).alias("pct_forced"), (F.sum("k") * 100.0 / F.sum("m")).alias("pct_with_symbol"),
    )


def symbols_by_ext(chunks: DataFrame, top: int = 4) -> DataFrame:
    """repo_id, ext, n, pct_with_symbol of each repository's most frequent extensions (as written)."""
    per = chunks.groupBy("repo_id", X.extension(F.col("path")).alias("ext")).agg(F.count("*").alias("n"), (F.sum((F.size("defines") > 0).cast("bigint")) * 100.0 / F.count("*")).alias("pct_with_symbol"))
    return per.withColumn("place", F.row_number().over(Window.partitionBy("repo_id").orderBy(F.desc("n"), "ext"))).where(F.col("place") <= top)


def repo_listing(repos: DataFrame, files: DataFrame, chunks: DataFrame) -> DataFrame:
    """repo_id, question, note (of the latest indexing), n_files, n_chunks, tokens, code_tokens, place: the smallest first, of equals by name.

    The place is found without sorting all repositories in one task: those of fewer tokens are counted per number of tokens.
    """
    order = F.struct("indexed_at", F.coalesce("question", F.lit("")), F.coalesce("note", F.lit("")))
    last = repos.where(F.col("slug").isNotNull()).groupBy(X.clean_slug(F.col("slug")).alias("repo_id")).agg(F.max_by(F.struct("question", "note"), order).alias("r")).select("repo_id", "r.question", "r.note")
    code = F.when(F.col("path").endswith(".md"), 0).otherwise(F.col("tokens"))
    f = files.groupBy("repo_id").agg(F.count("*").alias("n_files"), F.sum("tokens").alias("tokens"), F.sum(code).alias("code_tokens"))
    c = chunks.groupBy("repo_id").agg(F.count("*").alias("n_chunks"))
    zero = lambda n: F.coalesce(n, F.lit(0)).alias(n)
    listed = cut_lineage(last.join(f, "repo_id", "left").join(c, "repo_id", "left").select("repo_id", "question", "note", zero("n_files"), zero("n_chunks"), zero("tokens"), zero("code_tokens")))
    # Ranges of tokens, sixteen an octave: few, whatever the number of repositories.
    ranged = listed.withColumn("range", F.floor(F.log2(F.col("tokens") + 1) * 16).cast("int"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    start = ranged.groupBy("range").agg(F.count("*").alias("n")).select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"))
    inside = ranged.withColumn("n1", F.row_number().over(Window.partitionBy("range").orderBy("tokens", "repo_id")))
    return inside.join(start, "range").withColumn("place", F.col("n0") + F.col("n1")).drop("range", "n0", "n1")


def landing_repo(listing: DataFrame, least: int = 8000) -> DataFrame:
    """The smallest repository with more than ``least`` tokens, else the smallest of all."""
    return listing.orderBy((F.col("tokens") <= least).cast("int"), "tokens", "repo_id").limit(1).select("repo_id", "tokens")


def markdown_share(files: DataFrame) -> DataFrame:
    md = F.sum(F.when(F.col("path").endswith(".md"), F.col("tokens")).otherwise(0))
    return files.groupBy("repo_id").agg(F.sum("tokens").alias("tokens"), F.coalesce(F.try_divide(md * 100.0, F.sum("tokens")), F.lit(0.0)).alias("markdown_pct"))
