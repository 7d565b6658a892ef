"""Tables that several parts of one query read: written once to the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

FOLDER = "spark.checkpoint.dir"
#: Rows and bytes of an Arrow batch at most, but for a longer row: by rows alone, a batch of whole texts has no bound.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 512, "spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20}


def small_batches(spark: SparkSession) -> None:
    """Holds the session's Arrow batches to BATCH, so that tasks in Python hold no more however large the table is."""
    for name, most in BATCH.items():
        own = spark.conf.get(name).removesuffix("b")
        if not own.isdigit() or not 0 < int(own) <= most:
            spark.conf.set(name, str(most))


def once(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, computed now and read from Parquet by all that follows, lost executors or not.

    The folder is that of spark.checkpoint.dir; only in local mode may it be one of this machine's.
    """
    spark = df.sparkSession
    folder = spark.conf.get(FOLDER, None) or spark.sparkContext.getConf().get(FOLDER)
    if not folder:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError(f"{FOLDER} must name a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='folioscope-')}"
        spark.conf.set(FOLDER, folder)
    path = f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
