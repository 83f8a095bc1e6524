"""Session helpers shared by every operator."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and written tables.

    A cluster names it in ``spark.checkpoint.dir``. Where that is unset a folder of our own is made, but only if all tasks run on this
    machine: with executors elsewhere each would write to its own disk, so there it is an error.
    """
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path:
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="gleanspark-checkpoint-")
        sc.setCheckpointDir(path)
    return path


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared checkpoint folder and read it back from there.

    A written table survives the loss of any executor, is compressed, and its columns are
    pruned by what reads it, which a checkpoint of rows is not. It is deleted when the application ends.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/gleanspark-{uuid.uuid4().hex}"
    df.write.parquet(path)
    try:
        jvm, jsc = spark.sparkContext._jvm, spark.sparkContext._jsc
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(jsc.hadoopConfiguration()).deleteOnExit(at)
    except AttributeError:
        pass  # a session without a JVM of its own; whoever runs it clears the folder
    return spark.read.schema(df.schema).parquet(path)


def ship_package(spark: SparkSession) -> None:
    """Give this package to the executors' Python workers, once per context, so that no path must be set on them."""
    sc = spark.sparkContext
    if getattr(sc, "_gleanspark_shipped", False):
        return
    root = Path(__file__).resolve().parent
    out = Path(tempfile.mkdtemp(prefix="gleanspark-package-")) / "gleanspark.zip"
    with zipfile.ZipFile(out, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"gleanspark/{p.relative_to(root)}")
    sc.addPyFile(str(out))
    sc._gleanspark_shipped = True
