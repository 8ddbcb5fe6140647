"""Results that are worked out once, written where all executors can read them."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame


def fixed(df: DataFrame) -> DataFrame:
    """``df`` checkpointed: its values, floating point ones to the last digit, are the same at every later use.

    The folder is the session's ``spark.checkpoint.dir``; only where driver and executors are one process may it be made here.
    """
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="panelfx-"))
    return df.checkpoint()
