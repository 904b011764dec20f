"""The folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A new folder below the one that the cluster names in ``spark.checkpoint.dir``.

    Only where that setting is absent and Spark runs in one process, a temporary folder is used and kept for the session;
    on a cluster that would be a folder of one machine, so it is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not root:
        root = spark.conf.get("kerngrain.shared.dir", None) or "file://" + tempfile.mkdtemp(prefix="kerngrain-")
        spark.conf.set("kerngrain.shared.dir", root)
    return f"{root.rstrip('/')}/kerngrain-{uuid.uuid4().hex}"
