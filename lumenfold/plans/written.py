"""Tables that cut lineage: reliable checkpoints in the folder the cluster names."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def written(df: DataFrame) -> DataFrame:
    """``df`` written once and read back; it survives lost executors. Only a session of one machine gets a folder of its own."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None and (not context.master.startswith("local") or context.master.startswith("local-cluster")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="lumenfold-"))
    return df.checkpoint()
