"""Arrow-batched Python stages."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanspark.session import cut_lineage, ship_package

#: Bytes of a batch that a function is given at once; one row more than that is a batch of its own.
BATCH_BYTES = 32 << 20


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """``df.mapInArrow`` with a function of one batch; empty batches never reach it, and large ones in parts of about ``BATCH_BYTES``."""

    ship_package(df.sparkSession)
    most = BATCH_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            step = max(1, min(b.num_rows, b.num_rows * most // max(1, b.nbytes)))
            for at in range(0, b.num_rows, step):
                yield fn(b.slice(at, step))

    return df.mapInArrow(run, schema)


def once(rows: DataFrame, key: str) -> DataFrame:
    """Each key's rows once: of several the least by its other columns. Rows without a key are left out.

    Only keys that stand in several rows move, and are broadcast if Spark finds them small; all other rows stay where they are read.
    """
    known, rest = rows.where(F.col(key).isNotNull()), [c for c in rows.columns if c != key]
    several = cut_lineage(known.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(key))
    least = known.join(several, key, "left_semi").groupBy(key).agg(F.min(F.struct(*rest)).alias("r")).select(key, *[F.col("r")[c].alias(c) for c in rest])
    return known.join(several, key, "left_anti").select(key, *rest).unionByName(least)


def column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def raw(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def clean_slug(c) -> "F.Column":
    """A repository's slug without the variants of letter case and blanks."""
    return F.lower(F.trim(c))
