"""The order of a repository's chunks for its questions, made of whole repositories and blocks of questions in numpy.

A repository's chunks are kept with the asked terms they hold as numbers (places in its sorted list of asked terms), and each task gets one
repository's chunks with a block of its questions. So no row of a question and a chunk moves or is joined; those that a query returns leave as
arrays and become rows in the JVM. All numbers are made by the same operations in the same order as in ``retrieval``.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanspark.session import cut_lineage, ship_package

from . import ingest

#: Chunks of a repository in a part while their terms are looked up, questions in a block, and rows in an array.
PART, ASKED, ROWS = 8192, 64, 8192
#: Repositories of more chunks are left to ``retrieval``'s joins, since a task holds one repository.
MOST = 250_000

PLACE = ["file_id", "chunk_ord", "chunk_key"]
LINES = ["start_line", "end_line"]
VARIANTS = ("all", "code")


def large(lengths: DataFrame) -> DataFrame:
    """repo_id of the repositories above ``MOST``."""
    return cut_lineage(lengths.groupBy("repo_id").count().where(F.col("count") > MOST).select("repo_id"))


def _parts(df: DataFrame, most: int, name: str) -> DataFrame:
    """repo_id, ``name``: the number of parts, of the few repositories that have several."""
    return df.groupBy("repo_id").agg(F.ceil(F.count("*") / most).cast("int").alias(name)).where(F.col(name) > 1)


def _lists(values: np.ndarray, owner: np.ndarray, n: int, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(n + 1)), pa.int32()), pa.array(values, kind))


def _looked_up(_key, asked: pa.Table, chunks: pa.Table) -> pa.Table:
    """Chunks with the numbers of the asked terms in them, how often each is there, and those of the asked terms that they define."""
    if not asked.num_rows or not chunks.num_rows:
        return _INDEX.empty_table()
    words = asked.column("asked").combine_chunks().flatten()
    chunks, out = chunks.combine_chunks(), {}
    for name in ("terms", "defines"):
        lists = chunks.column(name).combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        owner = np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        at = pc.index_in(lists.flatten(), value_set=words).fill_null(-1).to_numpy(zero_copy_only=False)
        there = at >= 0
        both, n = np.unique(owner[there] * np.int64(len(words)) + at[there], return_counts=True)
        owner, at = np.divmod(both, max(1, len(words)))
        out[name] = _lists(at, owner, len(lists), pa.int32())
        out[name + "_n"] = _lists(n, owner, len(lists), pa.int32())
    return pa.table([*[chunks.column(c).cast(_INDEX.field(c).type) for c in ("repo_id", *PLACE, "path", *LINES, "tokens", "len")], out["terms"], out["terms_n"], out["defines"]], schema=_INDEX)


_INDEX = pa.schema([("repo_id", pa.string()), *[(c, pa.int64()) for c in PLACE], ("path", pa.string()), *[(c, pa.int64()) for c in LINES], ("tokens", pa.int64()), ("len", pa.int64()), ("at", pa.list_(pa.int32())), ("tf", pa.list_(pa.int32())), ("defs", pa.list_(pa.int32()))])
_INDEX_SQL = "repo_id string, file_id bigint, chunk_ord bigint, chunk_key bigint, path string, start_line bigint, end_line bigint, tokens bigint, len bigint, at array<int>, tf array<int>, defs array<int>"


class _Scores:
    """One repository's chunks, and the scores of its questions over them."""

    def __init__(self, chunks: pa.Table, k1: float, b: float, boost: float, floor: float) -> None:
        chunks = chunks.combine_chunks()
        # In the order that decides between equals.
        chunks = chunks.take(pc.sort_indices(chunks, sort_keys=[(c, "ascending") for c in PLACE], null_placement="at_start")).combine_chunks()
        self.chunks, self.k1, self.b, self.boost, self.floor = chunks, k1, b, boost, floor
        col = lambda c: (lambda x: x.chunk(0) if isinstance(x, pa.ChunkedArray) else x)(chunks.column(c).combine_chunks())
        self.len, self.key = (col(c).fill_null(0).to_numpy(zero_copy_only=False) for c in ("len", "chunk_key"))
        self.nameless = col("chunk_key").is_null().to_numpy(zero_copy_only=False)
        self.tokens = col("tokens").fill_null(0).to_numpy(zero_copy_only=False)
        self.path = col("path")
        # A chunk with an unknown line holds none.
        self.start, self.end = (col(c).fill_null(none).to_numpy(zero_copy_only=False) for c, none in zip(LINES, (2**63 - 1, -(2**63))))
        names = self.path.dictionary_encode()
        codes = names.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        self.of_path, self.path_code = np.argsort(codes, kind="stable"), {p: i for i, p in enumerate(names.dictionary.to_pylist())}
        self.codes = codes[self.of_path]
        code = ~pc.ends_with(self.path, ".md").fill_null(False).to_numpy(zero_copy_only=False)
        self.member = {"all": np.ones(len(code), bool), "code": code}
        self.term_at, self.term_row, self.term_tf = self._turned(col("at"), col("tf"))
        self.def_at, self.def_row, _ = self._turned(col("defs"), None)

    @staticmethod
    def _turned(lists: pa.ListArray, more: pa.ListArray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        at, row = lists.flatten().to_numpy().astype(np.int64), np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
        order = np.argsort(at, kind="stable")
        return at[order], row[order], None if more is None else more.flatten().to_numpy()[order].astype(np.float64)

    def of(self, variant: str, terms: list[dict], average: float | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The rows above the floor with their scores, and for each the first three places of the terms it has, as one number."""
        n, member = len(self.len), self.member[variant]
        raw, hit, seen, which = np.zeros(n), np.zeros(n, bool), np.zeros(n, np.int8), np.zeros(n, np.int64)
        boosted = np.zeros(n, bool)
        average = average or 1.0
        for i, t in enumerate(terms):
            a, z = np.searchsorted(self.def_at, [t["id"], t["id"] + 1])
            boosted[self.def_row[a:z]] = True
            idf = t["idf_" + variant]
            if idf is None:
                continue
            a, z = np.searchsorted(self.term_at, [t["id"], t["id"] + 1])
            row, tf = self.term_row[a:z], self.term_tf[a:z]
            raw[row] += idf * (tf * (self.k1 + 1) / (tf + self.k1 * (1 - self.b + self.b * self.len[row] / average)))
            hit[row] = True
            some = row[seen[row] < 3]
            which[some] = which[some] * (len(terms) + 1) + i + 1
            seen[some] += 1
        score = raw * np.where(boosted, self.boost, 1.0)
        rows = np.nonzero(hit & member & (score > self.floor) & ~self.nameless)[0]
        return rows, score[rows], which[rows]

    def at(self, path: str) -> np.ndarray:
        """The rows of a path."""
        code = self.path_code.get(path)
        return self.of_path[:0] if code is None else self.of_path[slice(*np.searchsorted(self.codes, [code, code + 1]))]

    def order(self, variant: str, q: dict, hops: list[dict], weights: np.ndarray) -> tuple[np.ndarray, ...]:
        """Rows and scores of the direct tier, rows, hops and weights of the expansion, the places of both in their one order, and the terms that the direct ones have."""
        rows, score, which = self.of(variant, q["q"], q[f"avg_len_{variant}"])
        spans = [(self.at(h["path"]), h["hop"]) for h in hops]
        more = np.concatenate([np.zeros(0, np.int64), *[own for own, _ in spans]])
        hop = np.repeat(np.array([h for _, h in spans], np.int64), [len(own) for own, _ in spans])
        taken = np.zeros(len(self.len), bool)
        taken[rows] = True
        kept = self.member[variant][more] & ~taken[more]
        more, hop = more[kept], hop[kept]
        weight, none = weights[hop], np.zeros(len(more))
        # Equals go by their rows, which are in the order of places; a chunk without tokens is worth the most.
        tokens, worth = (np.concatenate(y) for y in ((self.tokens[rows], self.tokens[more]), (score, weight)))
        density = np.where(tokens == 0, np.inf, worth / np.where(tokens == 0, 1, tokens))
        row, tier, tie = np.concatenate([rows, more]), np.repeat([0, 1], [len(rows), len(more)]), np.concatenate([score, none])
        return rows, score, more, hop, weight, np.lexsort((row, -tie, -density, tier)), which


def _reason(code: int, words: list[str]) -> str:
    out = []
    while code:
        code, i = divmod(code, len(words) + 1)
        out.append(words[i - 1])
    return "matched: " + ", ".join(reversed(out))


#: The depth of what no prefix holds.
NEVER = np.int64(2**63 - 1)


def least_budget(depth: int, ceiling: int, step: int) -> int | None:
    """The budget at which a bisection from ``ceiling`` down to ``step`` ends, if all that is wanted is held from ``depth`` on; null if the ceiling does not hold it."""
    if depth > ceiling:
        return None
    lo, hi = 0, ceiling
    while hi - lo > step:
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if mid >= depth else (mid, hi)
    return hi


class Blocks:
    """``retrieval``'s seeds, expansion and order for repositories of up to ``MOST`` chunks."""

    def __init__(self, tokenized: DataFrame, question_terms: DataFrame, fixed: dict, variants: tuple[str, ...] = VARIANTS) -> None:
        spark = tokenized.sparkSession
        ship_package(spark)
        self.fixed, self.variants = fixed, variants
        asked = cut_lineage(question_terms.groupBy("repo_id").agg(F.array_sort(F.collect_set("term")).alias("asked")))
        rows = tokenized.select("repo_id", *[F.col(c).cast("bigint").alias(c) for c in PLACE], "path", *[F.col(c).cast("bigint").alias(c) for c in LINES], "tokens", F.size("terms").cast("bigint").alias("len"), "terms", F.transform("defines", F.lower).alias("defines"))
        sums = ingest.variants(rows.select("repo_id", "path", "len")).groupBy("variant", "repo_id").agg(F.count("*").alias("n_chunks"), F.avg("len").alias("avg_len"))
        several = cut_lineage(_parts(rows, PART, "n"))
        part = lambda df: df.join(F.broadcast(several), "repo_id", "left").withColumn("n", F.coalesce("n", F.lit(1)))
        dealt = part(rows.join(asked.select("repo_id"), "repo_id", "left_semi")).withColumn("part", F.pmod(F.xxhash64("chunk_key"), "n")).drop("n")
        words = part(asked).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("n") - 1).cast("array<bigint>"))).drop("n")
        self.index = cut_lineage(words.groupBy("repo_id", "part").cogroup(dealt.groupBy("repo_id", "part")).applyInArrow(_looked_up, _INDEX_SQL))
        found = ingest.variants(self.index.select("repo_id", "path", F.explode("at").alias("id"))).groupBy("variant", "repo_id", "id").agg(F.count("*").alias("df"))
        n, df = F.col("n_chunks"), F.col("df")
        idf = found.join(sums, ["variant", "repo_id"]).select("variant", "repo_id", "id", F.log(1 + (n - df + 0.5) / (df + 0.5)).alias("idf"))
        of = lambda v, c: F.max(F.when(F.col("variant") == v, F.col(c))).alias(f"{c}_{v}")
        known = idf.groupBy("repo_id", "id").agg(*[of(v, "idf") for v in VARIANTS])
        numbers = asked.select("repo_id", F.posexplode("asked").alias("id", "term"))
        each = question_terms.join(numbers, ["repo_id", "term"]).join(known, ["repo_id", "id"], "left")
        terms = each.groupBy("repo_id", "question").agg(F.array_sort(F.collect_list(F.struct("term_pos", "term", "id", *[f"idf_{v}" for v in VARIANTS]))).alias("q"))
        self.questions = cut_lineage(terms.join(sums.groupBy("repo_id").agg(*[of(v, "avg_len") for v in VARIANTS]), "repo_id"))
        self.several = cut_lineage(_parts(self.questions, ASKED, "n"))

    def _met(self, questions: DataFrame, fn: Callable, kinds: pa.Schema, schema: str) -> DataFrame:
        """``fn`` of a block of a repository's questions, as dicts, and the repository's chunks."""
        part = lambda df: df.join(F.broadcast(self.several), "repo_id", "left").withColumn("n", F.coalesce("n", F.lit(1)))
        left = part(questions).withColumn("block", F.pmod(F.xxhash64("question"), "n")).drop("n")
        right = part(self.index).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("n") - 1).cast("array<bigint>"))).drop("n")
        fixed = self.fixed

        def run(_key, q: pa.Table, c: pa.Table) -> pa.Table:
            if not q.num_rows or not c.num_rows:
                return kinds.empty_table()
            return fn(q.to_pylist(), _Scores(c, *(fixed[x] for x in ("k1", "b", "boost", "floor"))))

        return left.groupBy("repo_id", "block").cogroup(right.groupBy("repo_id", "block")).applyInArrow(run, schema)

    def best(self, seeds: int) -> DataFrame:
        """variant, repo_id, question, paths (of the best direct chunks), weakest (of the direct scores)."""
        variants = self.variants

        def fn(questions: list[dict], s: _Scores) -> pa.Table:
            out = []
            for q in questions:
                for v in variants:
                    rows, score, _ = s.of(v, q["q"], q[f"avg_len_{v}"])
                    if len(rows):
                        # Only what reaches the last place is sorted; rows are in the order of places.
                        least = np.partition(score, -min(seeds, len(score)))[-min(seeds, len(score))]
                        some = np.nonzero(score >= least)[0]
                        top = rows[some[np.argsort(-score[some], kind="stable")[:seeds]]]
                        out.append({"variant": v, "repo_id": q["repo_id"], "question": q["question"], "paths": list(dict.fromkeys(s.path.take(pa.array(top)).to_pylist())), "weakest": float(score.min())})
            return pa.Table.from_pylist(out, _BEST)

        return cut_lineage(self._met(self.questions, fn, _BEST, "variant string, repo_id string, question string, paths array<string>, weakest double"))

    def _near(self, hops: DataFrame, best: DataFrame) -> DataFrame:
        """repo_id, question, near: of each variant the reached paths with their hops, and the weakest direct score."""
        key = ["variant", "repo_id", "question"]
        near = hops.groupBy(*key).agg(F.collect_list(F.struct("path", "hop")).alias("hops")).join(best.select(*key, "weakest"), key)
        return near.groupBy("repo_id", "question").agg(F.collect_list(F.struct("variant", "hops", "weakest")).alias("near"))

    def needed(self, hops: DataFrame, best: DataFrame, asked: DataFrame, step: int) -> DataFrame:
        """Key, tokens_used: of the prefix that ``measure.minimum_budget`` finds by bisection, where it holds all of a question's anchors.

        ``asked`` is repo_id, question, anchors (path, line), ceilings (variant, naive_tokens). No row of the order leaves a task.
        """
        weights = np.array(self.fixed["weights"])

        def fn(questions: list[dict], s: _Scores) -> pa.Table:
            out = []
            for q in questions:
                ceilings = {x["variant"]: x["naive_tokens"] for x in q["ceilings"]}
                for x in q["near"]:
                    if x["variant"] not in ceilings:
                        continue
                    rows, _, more, _, _, order, _ = s.order(x["variant"], q, x["hops"], weights)
                    row = np.concatenate([rows, more])[order]
                    cum, depth = np.cumsum(s.tokens[row]), np.full(len(s.len), NEVER)
                    depth[row] = cum
                    held = [depth[own[(s.start[own] <= line - 1) & (line - 1 < s.end[own])]].min(initial=NEVER) for own, line in ((s.at(a["path"]), a["line"]) for a in q["anchors"])]
                    top = least_budget(int(max(held)), ceilings[x["variant"]], step)
                    if top is not None:
                        out.append({"variant": x["variant"], "repo_id": q["repo_id"], "question": q["question"], "tokens_used": int(cum[cum <= top].max())})
            return pa.Table.from_pylist(out, _NEEDED)

        key = ["repo_id", "question"]
        return self._met(self.questions.join(self._near(hops, best), key).join(asked, key), fn, _NEEDED, "variant string, repo_id string, question string, tokens_used bigint")

    def placed(self, hops: DataFrame, best: DataFrame, direct: bool) -> DataFrame:
        """Key, chunk_key, tier, hop, reason, score, pos, cum of the order, or of its expansion alone."""
        near, weights = self._near(hops, best), np.array(self.fixed["weights"])

        def fn(questions: list[dict], s: _Scores) -> pa.Table:
            heads, parts = [], []
            for q in questions:
                words = [t["term"] for t in q["q"]]
                for x in q["near"]:
                    v = x["variant"]
                    rows, score, more, hop, weight, order, which = s.order(v, q, x["hops"], weights)
                    row, tier = np.concatenate([rows, more]), np.repeat([0, 1], [len(rows), len(more)])
                    cum, pos = np.cumsum(s.tokens[row[order]]), np.arange(1, len(order) + 1)
                    first = 0 if direct else len(rows)
                    codes_of, said = np.unique(which, return_inverse=True) if direct else (np.zeros(0, np.int64), np.zeros(len(rows), np.int64))
                    reasons = [*REASONS, *[_reason(int(c), words) for c in codes_of]]
                    values = (s.key[row], s.nameless[row], tier, np.concatenate([np.zeros(len(rows), np.int64), hop]), np.concatenate([said + len(REASONS), hop]), np.concatenate([score, x["weakest"] * weight]))
                    for i in range(first, len(order), ROWS):
                        o = order[i : i + ROWS]
                        parts.append([*[y[o] for y in values], pos[i : i + ROWS], cum[i : i + ROWS]])
                        heads.append((v, q["repo_id"], q["question"], reasons))
            if not heads:
                return _PLACED.empty_table()
            key, nameless, *rest = (np.concatenate(y) for y in zip(*parts))
            kinds = _PLACED.field("rows").type.value_type
            flat = pa.StructArray.from_arrays([pa.array(key, mask=nameless), *[pa.array(y.astype(kinds.field(i + 1).type.to_pandas_dtype())) for i, y in enumerate(rest)]], fields=list(kinds))
            offsets = np.concatenate([[0], np.cumsum([len(y[0]) for y in parts])])
            return pa.table([*[pa.array(list(y), _PLACED.field(i).type) for i, y in enumerate(zip(*heads))], pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat, type=_PLACED.field("rows").type)], schema=_PLACED)

        row = "chunk_key: bigint, tier: int, hop: int, why: int, score: double, pos: bigint, cum: bigint"
        met = self._met(self.questions.join(near, ["repo_id", "question"]), fn, _PLACED, f"variant string, repo_id string, question string, reasons array<string>, rows array<struct<{row}>>")
        return met.select("variant", "repo_id", "question", "reasons", F.inline("rows")).withColumn("reason", F.col("reasons")[F.col("why")]).drop("reasons", "why")


REASONS = ["same file as a match", "imported by / imports a match", "2 hops from a match"]
_KEY = [(c, pa.string()) for c in ("variant", "repo_id", "question")]
_NEEDED = pa.schema([*_KEY, ("tokens_used", pa.int64())])
_BEST = pa.schema([*_KEY, ("paths", pa.list_(pa.string())), ("weakest", pa.float64())])
_ROW = pa.struct([("chunk_key", pa.int64()), ("tier", pa.int32()), ("hop", pa.int32()), ("why", pa.int32()), ("score", pa.float64()), ("pos", pa.int64()), ("cum", pa.int64())])
_PLACED = pa.schema([*_KEY, ("reasons", pa.list_(pa.string())), ("rows", pa.list_(_ROW))])
