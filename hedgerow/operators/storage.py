"""Keeps a table's rows where several readers would compute them again."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def stored(table: DataFrame) -> DataFrame:
    """The table's rows, computed once and kept in the shared checkpoint folder; they outlive lost executors.

    The folder is ``spark.checkpoint.dir``. Where that is unset, a local session, whose executors are the driver itself,
    gets a folder of its own; on a cluster that is an error.
    """
    sc = table.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="hedgerow-")
        sc.setCheckpointDir(folder)
    return table.checkpoint()
