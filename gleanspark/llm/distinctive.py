"""How distinctive a term is of a record: divergence from randomness.

Statistics are summed per block of texts before anything moves. The statistics of common terms, those in more than one
of ``COMMON`` records, are given to every task: there are at most ``COMMON`` times as many of them as a record has
different terms on average, however large the collection is. Only rare terms are joined with theirs, and what they
bring back meets the record's other terms, which stay one compact row a record. Scores and ranks are then made per
record, in Arrow batches.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleanspark.session import cut_lineage

from . import kernel
from .arrow import column, map_batches, once, raw

#: A term in more than one of so many records is common.
COMMON = 1000

_LOWER = np.zeros(256, bool)
_LOWER[97:123] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True


def term_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str], np.ndarray]:
    """Per text its distinct terms and their counts: text, term code, the terms, count; sorted by text.

    Terms are the runs of ASCII letters, cut where a lower-case letter is followed by an upper-case one,
    then lower-cased.
    """
    raws = [t.encode("utf-8", "surrogatepass") for t in texts]
    b = np.frombuffer(b"\n".join(raws) + b"\n", np.uint8)
    lower, upper = _LOWER[b], _UPPER[b]
    letter = lower | upper
    start = letter.copy()
    start[1:] &= ~letter[:-1] | (lower[:-1] & upper[1:])
    stop = letter.copy()
    stop[:-1] &= ~letter[1:] | (lower[:-1] & upper[1:])
    begin, end = np.flatnonzero(start), np.flatnonzero(stop) + 1
    low = b | (upper.astype(np.uint8) << 5)
    codes, place = kernel.distinct(low, begin, end)
    whole = low.tobytes()
    terms = [whole[x:y].decode() for x, y in zip(begin[place].tolist(), end[place].tolist())]
    ends = np.cumsum(np.fromiter((len(r) + 1 for r in raws), np.int64, len(raws)))
    doc = np.searchsorted(ends, begin, side="right")
    key, n = np.unique(doc * max(1, len(terms)) + codes, return_counts=True)
    return key // max(1, len(terms)), key % max(1, len(terms)), terms, n


#: Where a long text can be cut without changing its terms.
TERM_BORDER = re.compile(r"[^A-Za-z][\x00-\U0010ffff]")


def counted(texts: list[str]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, list[str], np.ndarray]]:
    """``term_counts`` of blocks of texts, with the range of each block. A very long text is counted in parts."""
    for lo, hi in kernel.blocks(texts):
        if hi - lo > 1 or len(texts[lo]) <= 2 * kernel.BLOCK:
            yield lo, hi, *term_counts(texts[lo:hi])
            continue
        total: Counter = Counter()
        for part in kernel.parts([texts[lo]], TERM_BORDER)[0]:
            _, code, terms, n = term_counts([part])
            total.update(dict(zip((terms[c] for c in code.tolist()), n.tolist())))
        yield lo, hi, np.zeros(len(total), np.int64), np.arange(len(total)), list(total), np.fromiter(total.values(), np.int64, len(total))


def texts_once(records: DataFrame, key: str, text: str, defines: str) -> DataFrame:
    """k, t: each record's text and items of ``defines`` as one text, each key once; null keys and items are left out.

    Rows of one key must have the same text.
    """
    whole = F.concat_ws("\n", F.col(text), F.array_join(F.coalesce(F.col(defines), F.array().cast("array<string>")), "\n"))
    return once(records.select(F.col(key).alias("k"), whole.alias("t")), "k")


def term_statistics(texts: DataFrame) -> DataFrame:
    """term, n_records, n_occurrences over all texts, and in the row of the null term the number of texts and of all occurrences."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        whole = column(b, "t")
        names, records, sums = [pa.array([None], pa.string())], [np.array([len(whole)])], [np.zeros(1, np.int64)]
        for _, _, _, code, terms, n in counted(whole):
            names.append(pa.array(terms, pa.string()))
            records.append(np.bincount(code, minlength=len(terms)))
            sums.append(np.bincount(code, weights=n, minlength=len(terms)).astype(np.int64))
        sums[0] = np.array([sum(int(s.sum()) for s in sums)])
        return pa.RecordBatch.from_arrays([pa.concat_arrays(names), pa.array(np.concatenate(records), pa.int64()), pa.array(np.concatenate(sums), pa.int64())], ["term", "r", "o"])

    return map_batches(texts, run, "term string, r bigint, o bigint").groupBy("term").agg(F.sum("r").alias("n_records"), F.sum("o").alias("n_occurrences"))


def dfr(tf: np.ndarray, length: np.ndarray, average: float, n_occurrences: np.ndarray, n: int) -> np.ndarray:
    """Geometric information content times Laplace after-effect gain, on length-normalised frequency."""
    tfn = tf * np.log2(1.0 + average / length)
    mean = n_occurrences / float(max(1, n))
    content = np.log2(1.0 + mean) + tfn * np.log2((1.0 + mean) / mean)
    return content / (tfn + 1.0)


def _lists(values: pa.Array, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), values)


def _posted(texts: DataFrame, common: list[str], dtype: str) -> DataFrame:
    """k, len, codes and tfs of the common terms, terms and counts of the rare ones; one row a text."""
    known = texts.sparkSession.sparkContext.broadcast(common)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        whole = column(b, "t")
        length, many, few = (np.zeros(len(whole), np.int64) for _ in range(3))
        codes, tfs, terms_, counts = [], [], [pa.array([], pa.string())], []
        at = {t: i for i, t in enumerate(known.value)}
        for lo, hi, doc, code, terms, n in counted(whole):
            place = np.fromiter((at.get(t, -1) for t in terms), np.int64, len(terms))[code]
            length[lo:hi] = np.bincount(doc, weights=n, minlength=hi - lo)
            rare = place < 0
            many[lo:hi], few[lo:hi] = np.bincount(doc[~rare], minlength=hi - lo), np.bincount(doc[rare], minlength=hi - lo)
            codes.append(place[~rare])
            tfs.append(n[~rare])
            terms_.append(pa.array(terms, pa.string()).take(pa.array(code[rare])))
            counts.append(n[rare])
        flat = lambda x: pa.array(np.concatenate(x) if x else np.empty(0, np.int64), pa.int32())
        return pa.RecordBatch.from_arrays([raw(b, "k"), pa.array(length), _lists(flat(codes), many), _lists(flat(tfs), many), _lists(pa.concat_arrays(terms_), few), _lists(flat(counts), few)], ["k", "len", "codes", "tfs", "terms", "counts"])

    return map_batches(texts, run, f"k {dtype}, len bigint, codes array<int>, tfs array<int>, terms array<string>, counts array<int>")


def score_terms(records: DataFrame, only: DataFrame | None = None, key: str = "chunk_key", text: str = "text", defines: str = "defines") -> DataFrame:
    """key, term, tf, n_records, n_all, score, rank: every term of every record (or of the keys in ``only``).

    Terms are those of the text and of the items of ``defines``. Statistics always cover all records. Ranks go by score, ties by term. Null texts
    and items give no terms, and a record without terms has no rows. Rows of one key are one record; they must have the same text.
    """
    dtype = records.schema[key].dataType.simpleString()
    stats = cut_lineage(term_statistics(texts_once(records, key, text, defines)))
    total = stats.where("term IS NULL").first()
    n, words = (int(total.n_records), int(total.n_occurrences)) if total else (0, 0)
    # At most COMMON * (different terms a record) rows, whatever n is.
    common = sorted(tuple(r) for r in stats.where(F.col("term").isNotNull() & (F.col("n_records") * COMMON > n)).collect())
    asked = records if only is None else records.join(only.select(F.col(key)).where(F.col(key).isNotNull()).distinct(), key, "left_semi")
    posted = cut_lineage(_posted(texts_once(asked, key, text, defines), [t for t, _, _ in common], dtype))
    rare = posted.select("k", F.inline(F.arrays_zip(F.col("terms").alias("term"), F.col("counts").alias("tf")))).join(stats, "term")
    back = rare.groupBy("k").agg(F.collect_list(F.struct("term", "tf", "n_records", "n_occurrences")).alias("rare"))
    known = records.sparkSession.sparkContext.broadcast(common)
    average = words / max(1, n)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        names, n_common = [t for t, _, _ in known.value], len(known.value)
        stat = np.array([(r, o) for _, r, o in known.value], np.int64).reshape(-1, 2)
        length = raw(b, "len").to_numpy(zero_copy_only=False)
        many, codes, tfs = raw(b, "codes"), raw(b, "codes").flatten().to_numpy(), raw(b, "tfs").flatten().to_numpy()
        few = raw(b, "rare")
        struct = few.flatten()
        row = np.concatenate([np.repeat(np.arange(b.num_rows), x.value_lengths().fill_null(0).to_numpy()) for x in (many, few)])
        unique = struct.field("term").dictionary_encode()
        code = np.concatenate([codes, n_common + unique.indices.to_numpy()])
        every = names + unique.dictionary.to_pylist()
        tf, r, o = (np.concatenate([x, struct.field(c).to_numpy()]).astype(np.int64) for x, c in ((tfs, "tf"), (stat[codes, 0], "n_records"), (stat[codes, 1], "n_occurrences")))
        score = dfr(tf, length[row], average, o, n)
        by_name = np.empty(len(every), np.int64)
        by_name[np.array(sorted(range(len(every)), key=every.__getitem__), np.int64)] = np.arange(len(every))
        order = np.lexsort((by_name[code], -score, row))
        row, code = row[order], code[order]
        begin = np.searchsorted(row, np.arange(b.num_rows))
        rank = np.arange(len(row)) - begin[row] + 1
        return pa.RecordBatch.from_arrays(
            [
                raw(b, "k").take(pa.array(row)), pa.array(every, pa.string()).take(pa.array(code)), pa.array(tf[order]), pa.array(r[order]), pa.array(np.full(len(row), n, np.int64)), pa.array(score[order]), pa.array(rank.astype(np.int32)),
            ], [key, "term", "tf", "n_records", "n_all", "score", "rank"],
        )

    met = posted.select("k", "len", "codes", "tfs").join(back, "k", "left").withColumn("rare", F.coalesce("rare", F.expr("cast(array() AS array<struct<term: string, tf: int, n_records: bigint, n_occurrences: bigint>>)")))
    return map_batches(met, run, f"`{key}` {dtype}, term string, tf bigint, n_records bigint, n_all bigint, score double, rank int")


def leading_terms(records: DataFrame, probes: DataFrame) -> DataFrame:
    """chunk_key, term: of each probed record the term with the highest tf * ln(N / n), found along the operator's ranking.

    A record's terms are taken in the order of their rank until no later one can weigh more than the best so far: what follows weighs
    at most (the largest tf there) * ln(N / the least n there). So the ranking decides what is looked at, and the answer is exact
    whatever the ranking. Of equals the first by name; a record without terms, or unknown, has no row.
    """
    scored = score_terms(records, probes)
    weight = F.col("tf") * F.log(F.col("n_all") / F.col("n_records"))
    ranked = Window.partitionBy("chunk_key").orderBy("rank")
    before, after = ranked.rowsBetween(Window.unboundedPreceding, -1), ranked.rowsBetween(0, Window.unboundedFollowing)
    most = F.max("tf").over(after) * F.log(F.col("n_all") / F.min("n_records").over(after))
    seen = scored.withColumn("weight", weight).withColumns({"best": F.max("weight").over(before), "most": most})
    # Rounding must not end the search early, and equals must be met for the tie by name.
    near = seen.where(F.col("best").isNull() | (F.col("most") >= F.col("best") * (1 - 1e-9)))
    place = F.row_number().over(Window.partitionBy("chunk_key").orderBy(F.desc("weight"), "term"))
    return near.withColumn("b", place).where("b = 1").select(F.col("chunk_key").cast("bigint").alias("chunk_key"), "term")
