"""Session settings that the operators need."""

from __future__ import annotations

import os
import re
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def workers_find_package(spark: SparkSession) -> None:
    """Puts the folder of this package on the path of Python workers, which may start elsewhere than the driver."""
    root, env = str(Path(__file__).resolve().parent.parent), spark.sparkContext.environment
    path = env.get("PYTHONPATH") or os.environ.get("PYTHONPATH", "")
    if root not in path.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, path) if x)


def kept(df: DataFrame) -> DataFrame:
    """``df`` computed once and checkpointed, so that several plans read it and a lost executor costs no recomputation.

    The folder is that of ``spark.checkpoint.dir``; where it is unset, a session that runs in one process gets a folder of
    its own, and a cluster is an error, as a folder of one machine would lose rows.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        where = context.getConf().get("spark.checkpoint.dir", None) or df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not where and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(where or tempfile.mkdtemp(prefix="driftwell-"))
    return df.checkpoint()


def keyed(df: DataFrame, *by: str) -> DataFrame:
    """``df`` dealt by keys to as many tasks as shuffles have, whatever its bytes: for work that takes long per row, which
    few tasks would hold up where small partitions are merged."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)
