"""Comments and the upload queue as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from folioscope.operators import queue as Q
from folioscope.operators import reports as O

COMMENT_SCHEMA = "pair_id long, key string, comment string, seq long"


def upserted(stream: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Keep the last comment of each (pair_id, key) in versions under `table`; latest() reads the newest.

    Each batch is merged with the version before it and written beside it, so a batch that runs again after a
    failure writes the same version, and readers never see half of one.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.filter(F.col("key").rlike(O.COMMENT_KEY)).select("pair_id", "key", "comment", "seq")
        if number:
            rows = rows.unionByName(spark.read.schema(COMMENT_SCHEMA).parquet(f"{table}/version={number - 1}"))
        last = rows.groupBy("pair_id", "key").agg(F.max_by("comment", "seq").alias("comment"), F.max("seq").alias("seq"))
        last.write.mode("overwrite").parquet(f"{table}/version={number}")
        if number > 1:  # the version before stays for a batch that runs again, and for readers
            old = spark._jvm.org.apache.hadoop.fs.Path(f"{table}/version={number - 2}")
            old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, table: str) -> DataFrame:
    """The newest version of an upserted() table."""
    rows = spark.read.parquet(table)
    newest = rows.agg(F.max("version").alias("version"))
    return rows.join(F.broadcast(newest), "version", "left_semi").select("pair_id", "key", "comment", "seq")


def queue(files: DataFrame) -> DataFrame:
    """The upload queue of a stream of (filename, length): PDFs, the first of each name."""
    return files.filter(F.lower("filename").endswith(".pdf")).dropDuplicates(["filename"])


def sessions(events: DataFrame, idle: str = "2 hours", late: str = "10 minutes") -> DataFrame:
    """(user_id, begin, end, n): spells of activity that end after `idle` without an event."""
    spell = F.session_window("ts", idle)
    return events.withWatermark("ts", late).groupBy(spell.alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("begin"), F.col("w.end").alias("end"), "n")


def labelled(queue_rows: DataFrame) -> DataFrame:
    """A static queue's rows with their labels by order of arrival."""
    return Q.numbered(queue_rows, "arrived", "_place").withColumn("label", F.concat(F.lit("AFS "), "_place")).drop("_place")
