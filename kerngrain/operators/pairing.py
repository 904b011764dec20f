"""Pairing of enter and exit events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def paired(events: DataFrame) -> DataFrame:
    """Exits (kind) with the path of the enter of their process right before them.

    An enter overwrites the one before and an exit clears it, so a path is at hand only if the row before is an enter.
    """
    by = Window.partitionBy("cluster", "node_id", "boot_id", "pid").orderBy("observed_at_ns", "event_id")
    rows = events.withColumns({"before_": F.lag("kind").over(by), "path_": F.lag("path").over(by)})
    return rows.where("kind = 'exit' and before_ = 'enter'").withColumn("path", F.col("path_")).drop("before_", "path_")


def attempts(events: DataFrame) -> DataFrame:
    """Of exits with a path those that failed, as events of attempted opens, which normalize takes."""
    return paired(events).where("ret < 0").withColumn("event_type", F.lit("kernel.file.open_attempt"))
