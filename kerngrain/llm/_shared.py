"""Things the training-data operators share: tables in the cluster's shared folder, optional columns, folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_dir


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """Write df as Parquet to the shared folder and read it again.

    This cuts the lineage: a lost executor costs the tasks that read the table, not those that made it. The
    written table also has a known size, so Spark broadcasts it in joins only if it is below the threshold.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that written() made, once all that was derived from them is itself written."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t.written_at)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def crc_fold(col: Column, n: int) -> Column:
    """crc32 of the id as decimal text, modulo n; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")), F.lit(n)).cast("int")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, stem: str) -> str:
    """stem, or stem with underscores after it, so that no column of df has that name."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem
