"""Filling containers of fixed capacity with items of varying length."""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanspark.session import ship_package

from . import tokens

#: Items that one task packs together. Every group leaves at most a few containers partly empty,
#: so the larger it is the less is wasted; it does not depend on the data.
GROUP = 65_536


def _filled(room: int, left: list[int], k: int) -> int:
    """How much of ``room`` the k least of the sorted sizes ``left`` can fill, taking the largest that fits again and again."""
    got = 0
    while k and room:
        k = bisect_right(left, room, 0, k)
        if not k or not (v := left[k - 1]):
            break
        first = bisect_left(left, v, 0, k)
        n = min(k - first, room // v)
        got += n * v
        room -= n * v
        k = first
    return got


def _least_cost(size: int, capacities: list[int], left: list[int], k: int) -> int:
    """The capacity to open for an item: of least expected waste per token that it is expected to hold.

    What a container of each capacity would hold besides is tried out on the sizes still to be placed, and it counts as
    cut down to the least capacity that holds that. Of equals the longest is taken.
    """
    best = (0.0, 0)
    for c in capacities[bisect_left(capacities, size) :]:
        held = size + _filled(c - size, left, k)
        waste = capacities[bisect_left(capacities, held)] - held
        cost = (waste / max(1, held), -c)
        if not best[1] or cost < best:
            best = cost
    return -best[1]


def best_fit(sizes: np.ndarray, capacities: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Variable-capacity best fit, longest items first.

    Each piece goes into the open container it leaves least room in. Where none has room, the capacity of
    least expected waste is opened, given the sizes still to be placed (``_least_cost``).
    At the end each container is cut down to the least permitted length that holds its contents.

    Returns for each piece its item, its number in the item, its tokens and its container, and then
    the size of each container.
    """
    capacities = sorted(set(capacities))
    top = capacities[-1]
    full = sizes // top
    rest = sizes - full * top
    whole = np.repeat(np.arange(len(sizes)), full)
    loose = np.flatnonzero((rest > 0) | (sizes == 0))
    loose = loose[np.argsort(-rest[loose], kind="stable")]
    item = np.concatenate([whole, loose])
    count = np.concatenate([np.full(len(whole), top, np.int64), rest[loose]])
    begin = np.cumsum(full) - full
    number = np.concatenate([np.arange(len(whole)) - begin[whole], full[loose]])

    place = np.empty(len(item), np.int64)
    place[: len(whole)] = np.arange(len(whole))
    used = [top] * len(whole)
    room: dict[int, list[int]] = {}
    mask, left, k = 0, rest[loose][::-1].tolist(), len(loose)
    for p, s in enumerate(rest[loose].tolist(), len(whole)):
        k -= 1
        fits = mask >> s
        if fits:
            r = s + (fits & -fits).bit_length() - 1
            stack = room[r]
            b = stack.pop()
            if not stack:
                mask &= ~(1 << r)
        else:
            r = _least_cost(s, capacities, left, k) if len(capacities) > 1 else top
            b = len(used)
            used.append(0)
        used[b] += s
        place[p] = b
        r -= s
        stack = room.setdefault(r, [])
        stack.append(b)
        if len(stack) == 1:
            mask |= 1 << r
    final = np.asarray(capacities)[np.searchsorted(capacities, np.asarray(used, np.int64))] if used else np.empty(0, np.int64)
    return item, number, count, place, final


def pack(items: DataFrame, packings: dict[str, list[int]], id_col: str = "doc_id", size_col: str = "n_tokens", group: int = GROUP, n_items: int | None = None) -> DataFrame:
    """Containers of every packing: packing, container_no, container_size, id, piece_no, first_token, n_tokens.

    ``packings`` names the permitted lengths of each packing. An item is cut only where it is longer
    than the longest of them; null and negative sizes count as 0; an item of size 0 gets a container
    too. Items are dealt by a hash of their id into groups of about ``group``, each packed by one task,
    so no task's work grows with the data; ``n_items`` is their number where the caller knows it.
    """
    n_groups = max(1, -(-(items.count() if n_items is None else n_items) // group))
    dtype = items.schema[id_col].dataType.simpleString()

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["s", "i"], ascending=[False, True], kind="stable")
        ids, sizes = pdf["i"].to_numpy(), pdf["s"].to_numpy(np.int64)
        out = []
        for name, capacities in packings.items():
            item, number, count, place, final = best_fit(sizes, capacities)
            out.append(pd.DataFrame({
                "packing": name, "container_no": place * n_groups + key[0], "container_size": final[place],
                id_col: ids[item], "piece_no": number, "first_token": number * max(capacities), "n_tokens": count,
            }))
        return pd.concat(out)

    ship_package(items.sparkSession)
    dealt = items.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("i"), F.greatest(F.lit(0), F.coalesce(F.col(size_col).cast("bigint"), F.lit(0))).alias("s"),
        F.pmod(F.xxhash64(F.col(id_col)), F.lit(n_groups)).alias("g"),
    )
    schema = f"packing string, container_no bigint, container_size bigint, `{id_col}` {dtype}, piece_no bigint, first_token bigint, n_tokens bigint"
    return dealt.groupBy("g").applyInPandas(run, schema)


#: The most context windows that are read.
WINDOWS = 1000


def window_packings(windows: DataFrame) -> dict[str, list[int]]:
    """A packing for each capacity alone, and ``joint`` with all of them permitted together.

    ``windows`` is the fixed table of a few context windows; more than ``WINDOWS`` different ones are an error. Nulls and capacities below 1
    are left out. A name with several capacities has a packing for each, named with the capacity; so has one named ``joint``.
    """
    rows = windows.where(F.col("capacity") > 0).select(F.coalesce(F.col("window_name").cast("string"), F.lit("window")).alias("name"), F.col("capacity").cast("bigint").alias("c")).distinct().orderBy("c", "name").limit(WINDOWS + 1).collect()
    if len(rows) > WINDOWS:
        raise ValueError(f"more than {WINDOWS} context windows")
    names = [r.name for r in rows]
    single = {(r.name if names.count(r.name) == 1 and r.name != "joint" else f"{r.name}:{r.c}"): [int(r.c)] for r in rows}
    return single | ({"joint": sorted({int(r.c) for r in rows})} if rows else {})


def pack_documents(documents: DataFrame, windows: DataFrame, ranks: str = tokens.RANKS) -> DataFrame:
    """Every document, measured in tokens, in containers of each capacity and of all capacities jointly.

    A null or empty text has size 0 and still gets a container. No documents or no windows: no rows.
    """
    packings = window_packings(windows)
    sized = tokens.with_token_count(documents.select("doc_id", "text"), ranks=ranks)
    if not packings:
        return sized.where(F.lit(False)).selectExpr("'' AS packing", "0L AS container_no", "0L AS container_size", "doc_id", "0L AS piece_no", "0L AS first_token", "n_tokens")
    return pack(sized, packings, n_items=documents.count())


def packing_checks(documents: DataFrame, windows: DataFrame, ranks: str = tokens.RANKS, group: int = GROUP) -> DataFrame:
    """packing, n_documents, wrong_documents, overfull, near_bound: what must hold of ``pack_documents``, counted anew.

    A document is wrong if its pieces don't have its tokens, each once, or if it is cut although the longest capacity holds it. near_bound says
    that all containers together are at most a hundredth longer than the tokens, but for one container of each size in each group.
    """
    packings = window_packings(windows)
    placed = pack_documents(documents, windows, ranks)
    top = F.create_map(*[F.lit(x) for k, v in packings.items() for x in (k, max(v))]) if packings else F.lit(None).cast("map<string,int>")
    spare = F.create_map(*[F.lit(x) for k, v in packings.items() for x in (k, sum(v))]) if packings else F.lit(None).cast("map<string,int>")
    n_groups = max(1, -(-documents.count() // group))
    each = placed.groupBy("packing", "doc_id").agg(F.sum("n_tokens").alias("held"), F.count("*").alias("n"), F.count_distinct("piece_no").alias("d"), F.max("piece_no").alias("last"))
    sized = tokens.with_token_count(documents.select("doc_id", "text"), ranks=ranks)
    need = F.greatest(F.lit(1), F.ceil(F.col("n_tokens") / F.try_element_at(top, F.col("packing"))))
    wrong = (F.col("held") != F.col("n_tokens")) | (F.col("n") != need) | (F.col("d") != need) | (F.col("last") != need - 1)
    docs = each.join(sized, "doc_id").groupBy("packing").agg(F.count("*").alias("n_documents"), F.sum(wrong.cast("bigint")).alias("wrong_documents"))
    boxes = placed.groupBy("packing", "container_no", "container_size").agg(F.sum("n_tokens").alias("used"))
    near = F.sum("container_size") <= 1.01 * F.sum("used") + n_groups * F.try_element_at(spare, F.col("packing"))
    full = boxes.groupBy("packing").agg(F.sum((F.col("used") > F.col("container_size")).cast("bigint")).alias("overfull"), near.alias("near_bound"))
    return docs.join(full, "packing")


def packing_fill(placed: DataFrame) -> DataFrame:
    """packing, container_size, n_containers, n_tokens, unused_pct of the containers of each size."""
    boxes = placed.groupBy("packing", "container_no", "container_size").agg(F.sum("n_tokens").alias("used"))
    return boxes.groupBy("packing", "container_size").agg(F.count("*").alias("n_containers"), F.sum("used").alias("n_tokens"), (100 - F.sum("used") * 100.0 / F.sum("container_size")).alias("unused_pct"))
