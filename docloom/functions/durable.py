"""Tables that keep their partitions and outlive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def _folder(sc) -> str:
    """The checkpoint folder, which executors share. Only a session on one machine may do without the setting."""
    if not sc.getCheckpointDir():
        if shared := sc.getConf().get("spark.checkpoint.dir"):
            sc.setCheckpointDir(shared)
        elif sc.master.startswith("local["):
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="docloom-"))
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return sc.getCheckpointDir()


def written(df: DataFrame) -> DataFrame:
    """df as a compressed table in the checkpoint folder: for wide rows whose partitions and order don't matter, of which readers want some columns only."""
    path = f"{_folder(df.sparkSession.sparkContext).rstrip('/')}/written-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def kept(df: DataFrame) -> DataFrame:
    """df checkpointed in the folder that executors share (spark.checkpoint.dir): rows stay in their partitions and order, whoever reads them again.

    Only a session on one machine may do without the setting.
    """
    _folder(df.sparkSession.sparkContext)
    return df.checkpoint()
