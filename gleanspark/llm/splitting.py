"""Cutting oversized texts at natural boundaries."""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel
from .arrow import column, map_batches, once
from .tokens import extension


def line_blocks(texts: list[str | None]) -> tuple[list[np.ndarray], np.ndarray]:
    """For each text the lines that begin a block, and its number of lines.

    A block begins at line 0 and at each non-blank line after a blank one that does not begin with a
    space or tab. Blank is a line of nothing but spaces, tabs and carriage returns.
    """
    rows = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    b = np.frombuffer(b"\n".join(rows) + b"\n", np.uint8)
    ends = np.flatnonzero(b == 10)
    begins = np.concatenate([[0], ends[:-1] + 1])
    seen = np.concatenate([[0], np.cumsum((b != 32) & (b != 9) & (b != 13) & (b != 10))])
    full = seen[ends] > seen[begins]
    first = b[begins]
    text_ends = np.cumsum(np.fromiter((len(r) + 1 for r in rows), np.int64, len(rows))) - 1
    last_line = np.searchsorted(ends, text_ends)
    first_line = np.concatenate([[0], last_line[:-1] + 1])
    head = full & (first != 32) & (first != 9)
    head[1:] &= ~full[:-1]
    head[first_line] = True
    at = np.flatnonzero(head)
    cuts = np.searchsorted(at, first_line)
    return [x - f for x, f in zip(np.split(at, cuts[1:]), first_line)], last_line - first_line + 1


def cut(bounds: list[int], weight: np.ndarray, limit: int, overlap: int) -> list[tuple[int, int, int, str]]:
    """Pieces (first unit, end, first new unit, kind of cut before it) of a text of len(weight) - 1 units.

    ``weight`` holds prefix sums of the units' sizes and ``bounds`` the sorted units where a block begins.
    From a piece's first unit, binary search gives the last boundary under the limit; the next piece steps
    back from there by ``overlap`` units. Where two neighbouring blocks each fit but not together, the search
    ends at the border between them, since no piece can hold both ('forced'). Without a boundary in reach the
    cut is made at the limit ('hard').
    """
    n = len(weight) - 1
    if weight[n] <= limit:
        return [(0, n, 0, "start")]
    edges = [*bounds, n]
    size = [int(weight[b] - weight[a]) for a, b in zip(edges, edges[1:])]
    forced = [edges[i] for i in range(1, len(size)) if size[i - 1] <= limit and size[i] <= limit < size[i - 1] + size[i]]
    out: list[tuple[int, int, int, str]] = []
    begin = fresh = 0
    kind = "start"
    while True:
        reach = int(np.searchsorted(weight, weight[begin] + limit, side="right")) - 1
        f = bisect_right(forced, fresh)
        wall = forced[f] if f < len(forced) else n
        stop = min(reach, wall)
        if stop >= n:
            out.append((begin, n, fresh, kind))
            return out
        at = edges[bisect_right(edges, stop) - 1]
        if at > fresh:
            after = "forced" if at == wall else "natural"
        else:
            # A unit above the limit by itself stands alone.
            at, after = max(reach, fresh + 1), "hard"
        out.append((begin, at, fresh, kind))
        # Step back by the overlap, but leave room for something new.
        begin = max(begin, at - overlap)
        while begin < at and weight[at + 1 if at < n else n] - weight[begin] > limit:
            begin += 1
        fresh, kind = at, after


def split_files(files: DataFrame, limits: DataFrame, with_text: bool = True) -> DataFrame:
    """file_id, piece_no, start_line, end_line, cut_line, cut_kind (and text) of every file above its limit.

    Lines are counted from 0, end_line is exclusive; cut_line is the first line that the piece before does
    not have. Files without text, without a limit for their extension, or within it have no pieces. Of a
    limit given twice for one extension the smaller counts. Rows of one file_id are one file, known by one of
    them before anything is cut.
    """
    few = limits.where(F.col("max_lines") > 0).groupBy(F.lower(F.col("ext")).alias("ext")).agg(F.min("max_lines").cast("int").alias("max_lines"), F.min("overlap_lines").cast("int").alias("overlap_lines"))
    over = (
        once(files.where(F.col("text").isNotNull()).select("file_id", extension(F.col("path")).alias("ext"), "text"), "file_id")
        .join(few, "ext")
        .where(F.length("text") - F.length(F.replace("text", F.lit("\n"))) >= F.col("max_lines"))
        .select("file_id", "max_lines", F.greatest(F.lit(0), F.coalesce("overlap_lines", F.lit(0))).alias("overlap_lines"), "text")
    )
    dtype = files.schema["file_id"].dataType.simpleString()

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        ids, most, laps, texts = (column(b, c) for c in ("file_id", "max_lines", "overlap_lines", "text"))
        rows: list[tuple] = []
        for lo, hi in kernel.blocks(texts):
            heads, counts = line_blocks(texts[lo:hi])
            for i in range(lo, hi):
                n = int(counts[i - lo])
                lines = texts[i].split("\n") if with_text else ()
                for k, (s, e, fresh, kind) in enumerate(cut(heads[i - lo].tolist(), np.arange(n + 1), most[i], min(laps[i], most[i] - 1))):
                    rows.append((ids[i], k, s, e, fresh, kind, *(("\n".join(lines[s:e]),) if with_text else ())))
        kinds = [b.schema.field("file_id").type, pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.string()]
        names = ["file_id", "piece_no", "start_line", "end_line", "cut_line", "cut_kind", "text"][: 7 if with_text else 6]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows) if rows else [()] * len(names), kinds)], names)

    ddl = f"file_id {dtype}, piece_no int, start_line int, end_line int, cut_line bigint, cut_kind string" + ", text string" * with_text
    return map_batches(over, run, ddl)


def forced_cuts(files: DataFrame, limits: DataFrame) -> DataFrame:
    """file_id, cut_line of the cuts that no splitting can avoid: blocks that fit alone but not with the one before."""
    pieces = split_files(files, limits, with_text=False)
    return pieces.where(F.col("cut_kind") == "forced").select(F.col("file_id").cast("bigint").alias("file_id"), "cut_line")
