"""What the library asks of a session."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def checkpoint_folder(spark: SparkSession) -> None:
    """Leave the folder that spark.checkpoint.dir names; where none is set, as in tests, set one."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not named and not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(named or "file://" + tempfile.mkdtemp(prefix="tessera-"))
