"""The shared scratch folder that tables and checkpoints are written to."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Where none is set, local mode takes a
    temporary folder of its own; elsewhere it is one in the warehouse, if that isn't on a machine's own disk."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        alone = master.startswith("local") and "cluster" not in master
        warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
        if not alone and warehouse.startswith(("file:", "/")):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        root = tempfile.mkdtemp(prefix="tesserine-") if alone else f"{warehouse}/tesserine-scratch"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def ensure_checkpoints(spark: SparkSession) -> None:
    """Makes DataFrame.checkpoint() usable; it writes to the shared folder."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(scratch_dir(spark))
