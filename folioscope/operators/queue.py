"""The upload queue and files: numbering by arrival, checks of paths, types for download, stored and cleared tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Types by extension, and the type of any other file.
MIME = {
    "pdf": "application/pdf",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "txt": "text/plain",
}
OTHER = "application/octet-stream"
#: Ranges in which rows are numbered side by side.
RANGES = 64


def numbered(rows: DataFrame, order: str, name: str) -> DataFrame:
    """rows with a gapless number from 1 in the order of one column of numbers or times.

    The order is cut into RANGES at quantiles; rows are numbered within their range, and the counts of the ranges
    before are added. The driver sees RANGES quantiles and counts, whatever the number of rows.
    """
    value = F.col(order).cast("double")
    quantiles = rows.select(F.percentile_approx(value, [k / RANGES for k in range(1, RANGES)], 10_000)).first()[0] or []
    at = F.size(F.filter(F.array(*map(F.lit, quantiles)), lambda x: x <= value)) if quantiles else F.lit(0)
    ranged = rows.withColumn("_range", at)
    counts = dict(ranged.groupBy("_range").count().collect())
    before = [sum(n for r, n in counts.items() if r < k) for k in range(len(quantiles) + 1)]
    place = F.row_number().over(Window.partitionBy("_range").orderBy(order))
    return ranged.withColumn(name, place + F.element_at(F.array(*map(F.lit, before)), F.col("_range") + 1)).drop("_range")


def mime(name: Column) -> Column:
    """The type under which a file is sent, by its extension."""
    found = F.lower(F.regexp_extract(name, r"\.([^./\\]+)$", 1))
    return F.coalesce(*[F.when(found == k, v) for k, v in MIME.items()], F.lit(OTHER))


def absolute(folder: Column) -> Column:
    """Whether a folder may be written to: rooted, and no way up in it."""
    return F.coalesce(F.startswith(F.trim(folder), F.lit("/")) & ~F.contains(folder, F.lit("..")), F.lit(False))


def downloadable(path: Column, allowed: str) -> Column:
    """Whether a path lies in the allowed folder, whatever the case, without a way up."""
    return F.coalesce(F.startswith(F.lower(path), F.lit(allowed.rstrip("/").lower() + "/")) & ~F.contains(path, F.lit("..")), F.lit(False))


def files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, length, content) of PDFs, read anew; paths that do not exist are left out."""
    return spark.read.format("binaryFile").option("ignoreMissingFiles", True).option("pathGlobFilter", "*.[pP][dD][fF]").load(paths).select("path", "length", "content")


def two_files(spark: SparkSession, first: str, second: str) -> DataFrame:
    """(side, path, length, content) of exactly two PDFs; anything else is an error before work begins."""
    if not all(x and x.lower().endswith(".pdf") for x in (first, second)):
        raise ValueError("two PDFs are needed")
    side = lambda n, path: files(spark, [path]).withColumn("side", F.lit(n))
    return side(1, first).unionByName(side(2, second)).select("side", "path", "length", "content")


def engagement(spark: SparkSession, record: dict[str, str]) -> DataFrame:
    """A row of the form's ten fields; missing ones are empty."""
    names = ["parent", "client", "engagement_name", "engagement_number", "financial_year_start", "financial_year_end", "prepared_by", "director", "manager", "objective"]
    return spark.createDataFrame([tuple(str(record.get(n) or "") for n in names)], ", ".join(f"{n} string" for n in names))


def stored(uploads: DataFrame, folder: str) -> str:
    """Writes (filename, length, content) under a name that no other upload has; returns the path."""
    path = f"{folder.rstrip('/')}/{uuid.uuid4().hex}"
    uploads.write.parquet(path)
    return path


def cleared(table: DataFrame, path: str) -> None:
    """Leaves an empty table of the same columns at a path."""
    table.sparkSession.createDataFrame([], table.schema).write.mode("overwrite").parquet(path)
