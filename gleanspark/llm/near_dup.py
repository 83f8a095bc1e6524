"""Near-duplicate records: a chosen-path set similarity join.

Records are sets of word shingles. Several independent trees are grown over them. In a node, a few
coordinates of a minwise signature are chosen by a hash of the node, and records that agree in a chosen
coordinate go to the same child, so similar records stay together along many paths while others part.
A node with few records is compared exhaustively; a node that stops shrinking holds records that agree
nearly everywhere and is compared exhaustively too, cut into blocks of ``BLOCK`` records, each pair of blocks
on its own, so no task compares more than a block with a block. Candidates are thinned by their signatures
and decided by the shingle sets themselves.

Records with one and the same set are one class and enter the trees once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanspark.session import cut_lineage

from . import kernel
from .arrow import column, map_batches, raw

#: Coordinates of a signature; a byte of each is kept.
COORDINATES = 64
#: Records of a node or class that meet in one group; more are cut into blocks, and every pair of blocks is a group.
BLOCK = 512
_rng = np.random.default_rng(20240501)
_XOR = _rng.integers(0, 1 << 32, COORDINATES, dtype=np.uint32)
_MUL = _rng.integers(0, 1 << 31, COORDINATES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def sketches(texts: list[str | None], k: int, roots: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each text: distinct shingles, two hashes of their set, the signature's bytes, a bit of each, and its root nodes.

    A root node is one of the first ``roots`` coordinates with its whole value.
    """
    n = len(texts)
    counts, ident = np.zeros(n, np.int64), np.zeros((n, 2), np.uint64)
    sig, nodes = np.zeros((n, COORDINATES), np.uint8), np.zeros((n, roots), np.uint64)
    bits = np.zeros(n, np.uint64)
    for lo, hi in kernel.blocks(texts):
        for a in range(lo, hi, 65_536):
            b = min(hi, a + 65_536)
            key = kernel.shingle_keys(texts[a:b], k)
            if not len(key):
                continue
            doc = (key >> np.uint64(48)).astype(np.int64)
            at = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
            who = doc[at] + a
            counts[who] = np.diff(np.append(at, len(key)))
            h = kernel.mix((key & kernel._LOW) + np.uint64(0x51ED270B))
            ident[who, 0] = np.add.reduceat(h, at)
            ident[who, 1] = np.bitwise_xor.reduceat(kernel.mix(h), at)
            low = h.astype(np.uint32)
            for j in range(COORDINATES):
                least = np.minimum.reduceat((low ^ _XOR[j]) * _MUL[j], at)
                sig[who, j] = (least ^ (least >> np.uint32(11)) ^ (least >> np.uint32(22))).astype(np.uint8)
                bits[who] |= ((least * np.uint32(0x9E3779B1)) >> np.uint32(31)).astype(np.uint64) << np.uint64(j)
                if j < roots:
                    nodes[who, j] = kernel.mix(least.astype(np.uint64) | (np.uint64(j + 1) << np.uint64(32)))
    return counts, ident, sig, bits, nodes


def sketch(records: DataFrame, k: int, min_shingles: int, roots: int) -> DataFrame:
    """kind, id, n, h1, h2, sig, bits, nodes of the records with at least ``min_shingles`` different shingles."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        counts, ident, sig, bits, nodes = sketches(column(b, "text"), k, roots)
        keep = np.flatnonzero(counts >= max(1, min_shingles))
        take = pa.array(keep)
        flat = nodes[keep].view(np.int64).reshape(-1)
        return pa.RecordBatch.from_arrays(
            [
                raw(b, "kind").take(take), raw(b, "id").take(take), pa.array(counts[keep].astype(np.int32)), pa.array(ident[keep, 0].view(np.int64)), pa.array(ident[keep, 1].view(np.int64)),
                pa.array([s.tobytes() for s in sig[keep]], pa.binary()), pa.array(bits[keep].view(np.int64)), pa.ListArray.from_arrays(pa.array(np.arange(len(keep) + 1, dtype=np.int32) * roots), pa.array(flat)),
            ], ["kind", "id", "n", "h1", "h2", "sig", "bits", "nodes"],
        )

    return map_batches(records, run, "kind string, id bigint, n int, h1 bigint, h2 bigint, sig binary, bits bigint, nodes array<bigint>")


def verified(pairs: DataFrame, records: DataFrame, k: int, threshold: float) -> DataFrame:
    """kind, a, b, similarity of the pairs whose shingle sets reach the threshold.

    Texts of the pairs' records alone are fetched. Shingles are compared by their words, not by hashes, and in whole
    numbers: with s shared and u in either, s >= threshold * u.
    """
    ids = pairs.select("kind", F.explode(F.array("a", "b")).alias("id")).distinct()
    texts = records.join(ids, ["kind", "id"], "left_semi").dropDuplicates(["kind", "id"])
    left, right = texts.withColumnRenamed("id", "a").withColumnRenamed("text", "ta"), texts.withColumnRenamed("id", "b").withColumnRenamed("text", "tb")
    both = pairs.join(left, ["kind", "a"]).join(right, ["kind", "b"]).select("kind", "a", "b", "ta", "tb")

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        ta, tb = column(b, "ta"), column(b, "tb")
        n = len(ta)
        shared, either = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for lo, hi in kernel.blocks([x + y for x, y in zip(ta, tb)]):
            shared[lo:hi], either[lo:hi] = kernel.shared_shingles(ta[lo:hi], tb[lo:hi], k)
        j = shared / np.maximum(either, 1)
        keep = np.flatnonzero((either > 0) & (j >= threshold - 1e-12))
        take = pa.array(keep)
        return pa.RecordBatch.from_arrays([*(raw(b, c).take(take) for c in ("kind", "a", "b")), pa.array(j[keep])], ["kind", "a", "b", "similarity"])

    return map_batches(both, run, "kind string, a bigint, b bigint, similarity double")


def _children(node: str, branches: int) -> str:
    """SQL for the child nodes of ``node``: coordinates chosen by its hash, with the record's bytes there.

    The coordinates of one node are different: the first comes from the hash, the next ones follow at odd steps.
    """
    first = f"pmod(xxhash64({node}, 17), {COORDINATES})"
    step = f"(2 * pmod(xxhash64({node}, 31), {COORDINATES // 2}) + 1)"
    child = "xxhash64({n}, {i}, substring(sig, cast({j} as int) + 1, 1))"
    return "array(" + ", ".join(child.format(n=node, i=i, j=f"pmod({first} + {i} * {step}, {COORDINATES})") for i in range(branches)) + ")"


def _may_match(x: str, y: str, threshold: float, deviations: float = 4.0) -> str:
    """SQL for whether two records (with n and bits) can be similar.

    A set can't share more than the smaller one holds; and of the signatures' bits, which agree with
    probability (1 + J) / 2, not too few may agree: ``deviations`` standard deviations below the mean.
    """
    p = (1 + threshold) / 2
    most = int(COORDINATES * (1 - p) + deviations * (COORDINATES * p * (1 - p)) ** 0.5)
    return f"(least({x}n, {y}n) >= {threshold} * greatest({x}n, {y}n) - 1e-9 AND bit_count({x}bits ^ {y}bits) <= {most})"


def _pairs_in(list_col: str, threshold: float) -> str:
    """SQL for the pairs of a sorted list of records (id, n, bits) that may be similar."""
    later = f"filter(slice({list_col}, i + 2, size({list_col})), y -> {_may_match('x.', 'y.', threshold)})"
    return f"flatten(transform({list_col}, (x, i) -> transform({later}, y -> struct(x.id AS a, y.id AS b))))"


def block_pairs(rows: DataFrame, keys: list[str], size: str, block: int | None = None) -> DataFrame:
    """Every pair of different records of one group once, as structs ``x`` and ``y`` of the other columns, in blocks.

    ``rows`` has the group's keys, an ``id`` that is unique in the group, and the group's number of records in ``size``. A group of more than
    ``block`` records is dealt into blocks by a hash of the id; each pair of blocks is a key of the join, so its
    tasks hold two blocks, however large the group is.
    """
    b = BLOCK if block is None else block
    n = F.ceil(F.col(size) / F.lit(b)).cast("int")
    other = [c for c in rows.columns if c not in keys and c != size]
    dealt = rows.withColumn("_n", n).withColumn("_b", F.pmod(F.xxhash64("id"), F.col("_n")).cast("int"))
    x = dealt.select(*keys, F.struct(*other).alias("x"), F.col("_b").alias("_bx"), F.explode(F.sequence("_b", F.col("_n") - 1)).alias("_by"))
    y = dealt.select(*keys, F.struct(*other).alias("y"), F.explode(F.sequence(F.lit(0), "_b")).alias("_bx"), F.col("_b").alias("_by"))
    return x.join(y, [*keys, "_bx", "_by"]).where("_bx < _by OR x.id < y.id").select(*keys, "x", "y")


def candidates(reps: DataFrame, threshold: float, branches: int, leaf: int, stall: float, depth: int) -> DataFrame:
    """kind, a, b (a < b): the pairs of class representatives that meet in a node compared exhaustively."""
    level = reps.select("kind", "id", "n", "bits", F.explode("nodes").alias("node"), F.lit(None).cast("bigint").alias("above"))
    found: list[DataFrame] = []
    for at in range(depth + 1):
        size = level.groupBy("kind", "node").agg(F.count("*").alias("m"), F.min("above").alias("above")).where("m > 1")
        done = F.col("m") <= leaf
        stuck = ~done & (F.lit(at == depth) | F.coalesce(F.col("m") >= stall * F.col("above"), F.lit(False)))
        kept = level.drop("above").join(size, ["kind", "node"])
        small = kept.where(done).groupBy("kind", "node").agg(F.sort_array(F.collect_set(F.struct("id", "n", "bits"))).alias("ids"))
        # Each level's pairs are written at once, so that no plan spans more than one level.
        found.append(cut_lineage(small.select("kind", F.expr(f"inline({_pairs_in('ids', threshold)})")).distinct()))
        large = cut_lineage(kept.where(~done).withColumn("stuck", stuck))
        state = {r.stuck: r.n for r in large.groupBy("stuck").agg(F.count("*").alias("n")).collect()}
        if state.get(True):
            met = block_pairs(large.where("stuck").select("kind", "node", "id", "n", "bits", "m").distinct(), ["kind", "node"], "m")
            found.append(met.where(_may_match("x.", "y.", threshold)).select("kind", F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct())
        if not state.get(False):
            break
        level = large.where("not stuck").join(reps.select("kind", "id", "sig"), ["kind", "id"]).select("kind", "id", "n", "bits", F.expr(f"explode({_children('node', branches)})").alias("node"), F.col("m").alias("above"))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.distinct()


def estimated(pairs: DataFrame, reps: DataFrame, threshold: float, deviations: float = 4.0) -> DataFrame:
    """The pairs whose signatures don't rule them out: agreement at most ``deviations`` standard deviations below the threshold."""
    least = int(np.floor(COORDINATES * threshold - deviations * np.sqrt(COORDINATES * threshold * (1 - threshold))))
    x, y = (reps.select("kind", F.col("id").alias(c), F.col("sig").alias(f"s{c}")) for c in "ab")
    # Bytes that agree are the zero bytes of the two signatures' bitwise difference, taken eight at a time.
    words = [f"(cast(conv(hex(substring(sa, {i}, 4)), 16, 10) as bigint) ^ cast(conv(hex(substring(sb, {i}, 4)), 16, 10) as bigint))" for i in range(1, COORDINATES, 4)]
    agree = " + ".join(f"transform(array({w}), d -> if(d & 255 = 0, 1, 0) + if(d & 65280 = 0, 1, 0) + if(d & 16711680 = 0, 1, 0) + if(d & 4278190080 = 0, 1, 0))[0]" for w in words)
    return pairs.join(x, ["kind", "a"]).join(y, ["kind", "b"]).where(F.expr(agree) >= max(0, least)).select("kind", "a", "b")


def similarity_join(records: DataFrame, k: int = 5, threshold: float = 0.8, min_shingles: int = 1, trees: int = 6, branches: int = 2, leaf: int = 24, stall: float = 0.75, depth: int = 10) -> tuple[DataFrame, DataFrame]:
    """Links between the classes of equal sets, and each record's class.

    ``records`` has kind, id and text; records of different kinds never meet; rows of one (kind, id) are one
    record. Returns links (kind, a, b, similarity) between representatives a < b, and members (kind, id, rep).
    Null and empty texts, and those with fewer different shingles than ``min_shingles``, are in neither.
    """
    rows = records.where(F.col("id").isNotNull()).select("kind", F.col("id").cast("bigint").alias("id"), "text")
    roots = trees * branches
    made = sketch(rows.where(F.col("text").isNotNull()), k, min_shingles, roots)
    drawn = cut_lineage(made)
    reps = cut_lineage(drawn.groupBy("kind", "n", "h1", "h2").agg(F.min("id").alias("id"), F.min(F.struct("sig", "bits", "nodes")).alias("s")).select("kind", "id", "n", "h1", "h2", "s.sig", "s.bits", "s.nodes"))
    met = candidates(reps, threshold, branches, leaf, stall, depth)
    likely = cut_lineage(estimated(met, reps, threshold))
    links = verified(likely, rows, k, threshold)
    members = drawn.select("kind", "id", "n", "h1", "h2").distinct().join(reps.select("kind", "n", "h1", "h2", F.col("id").alias("rep")), ["kind", "n", "h1", "h2"]).select("kind", "id", "rep")
    return links, members


def expanded(links: DataFrame, members: DataFrame) -> DataFrame:
    """kind, x, y for every record x of a class ``a`` and y of a class ``b`` that ``links`` (kind, a, b) joins; members has kind, rep, id.

    A large class is dealt into blocks and a link to it is joined with each block on its own, so no task holds a class.
    """
    large = members.groupBy("kind", "rep").agg(F.count("*").alias("m")).where(F.col("m") > BLOCK).select("kind", "rep", F.ceil(F.col("m") / BLOCK).cast("int").alias("_n"))
    one = F.coalesce("_n", F.lit(1))
    dealt = members.join(large, ["kind", "rep"], "left").select("kind", "rep", "id", F.pmod(F.xxhash64("id"), one).cast("int").alias("_b"))
    across = links.select("kind", "a", "b").distinct()
    for side, out in (("a", "x"), ("b", "y")):
        across = across.join(large.withColumnRenamed("rep", side), ["kind", side], "left").withColumn("_b", F.explode(F.sequence(F.lit(0), one - 1))).drop("_n")
        across = across.join(dealt.withColumnsRenamed({"rep": side, "id": out}), ["kind", side, "_b"]).drop("_b")
    return across.select("kind", "x", "y")


def record_pairs(links: DataFrame, members: DataFrame) -> DataFrame:
    """record_kind, id_a < id_b: the links and the equal sets, written out for every record of the classes.

    The pairs inside a class come from pairs of its blocks. The two kinds of pairs have no row in common and links
    are different, so nothing is made distinct at the end.
    """
    sizes = members.groupBy("kind", "rep").agg(F.count("*").alias("m")).where("m > 1")
    inside = block_pairs(members.join(sizes, ["kind", "rep"]), ["kind", "rep"], "m").select("kind", F.col("x.id").alias("x"), F.col("y.id").alias("y"))
    pairs = inside.unionByName(expanded(links, members))
    return pairs.select(F.col("kind").alias("record_kind"), F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """kind, id, root: connected components of edges (kind, a, b), by alternating star contraction.

    Each round is two aggregations over the edges, so a hub costs no more than its edges; the number of
    rounds grows with the logarithm of the longest chain. Raises if ``rounds`` don't suffice.
    """
    e = edges.select("kind", F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    e = cut_lineage(e)
    before = None
    for _ in range(rounds):
        # Large star: link the larger neighbours of each node to the least of its neighbourhood.
        both = e.select("kind", F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select("kind", F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("kind", "u").agg(F.min("v").alias("m")).select("kind", "u", F.least("u", "m").alias("m"))
        big = both.join(least, ["kind", "u"]).where("v > u").select("kind", F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        # Small star: link the smaller neighbours of each node, and itself, to the least of them.
        low = big.groupBy("kind", "a").agg(F.min("b").alias("m"))
        joined = big.join(low, ["kind", "a"])
        e = cut_lineage(joined.select("kind", F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("kind", "a", F.col("m").alias("b"))).where("a <> b").distinct())
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("kind", "a", "b").cast("decimal(20,0)")).alias("h")).first()
        if now == before:
            return e.select("kind", F.col("a").alias("id"), F.col("b").alias("root"))
        before = now
    raise RuntimeError("components did not settle")


def near_duplicate_groups(records: DataFrame, **options) -> DataFrame:
    """record_kind, id, group_id, n_links of every record similar or equal to another one.

    group_id is the least id of the records joined by chains of links; n_links counts the record's links to
    classes of other sets, and to one more if its own set has several records.
    """
    links, members = similarity_join(records, **options)
    links = cut_lineage(links)
    root = components(links)
    degree = links.select("kind", F.explode(F.array("a", "b")).alias("rep")).groupBy("kind", "rep").agg(F.count("*").alias("d"))
    crowd = members.groupBy("kind", "rep").agg(F.count("*").alias("m"))
    return (
        members.join(crowd, ["kind", "rep"]).join(degree, ["kind", "rep"], "left").join(root.withColumnRenamed("id", "rep"), ["kind", "rep"], "left")
        .where("m > 1 OR d IS NOT NULL")
        .select(F.col("kind").alias("record_kind"), "id", F.coalesce("root", "rep").alias("group_id"), (F.coalesce("d", F.lit(0)) + F.when(F.col("m") > 1, 1).otherwise(0)).cast("bigint").alias("n_links"))
    )
