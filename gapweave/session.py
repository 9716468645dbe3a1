"""Session-level helpers: lineage cuts and size checks."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Make sure reliable checkpoints have a folder.

    The cluster names it in ``spark.checkpoint.dir``. Only a local master, as
    used in tests, falls back to a temporary folder.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        sc.setCheckpointDir(shared)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="gapweave-ckpt-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and drop its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fits(df: DataFrame, max_rows: int) -> bool:
    """True when ``df`` has at most ``max_rows`` rows.

    A plain count: partial counts are all that moves. ``limit(n).count()``
    would first send up to n rows of every partition to one task.
    """
    return df.count() <= max_rows


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors of a cluster where it is not installed."""
    import os
    import shutil

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="gapweave-zip-"), "gapweave"), "zip", root, "gapweave")
    spark.sparkContext.addPyFile(archive)
