"""Fresh folders for tables written in the session's shared folder."""

import uuid

from pyspark.sql import DataFrame, SparkSession

from pairlake.session import checkpoint_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage by a table in the shared folder: columnar, compressed and
    read column by column, where a checkpoint keeps whole rows."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)
