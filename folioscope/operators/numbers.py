"""Reconciling the numbers of two texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.functions import similarity as S
from folioscope.functions import text as T


def reconciled(texts: DataFrame) -> DataFrame:
    """in_both, only1, only2 (by value), their counts and both similarities, for (pair_id, text1, text2)."""
    rows = texts.select("pair_id", T.numbers(F.col("text1")).alias("n1"), T.numbers(F.col("text2")).alias("n2"))
    return rows.select(
        "pair_id",
        T.by_value(F.array_intersect("n1", "n2")).alias("in_both"),
        T.by_value(F.array_except("n1", "n2")).alias("only1"),
        T.by_value(F.array_except("n2", "n1")).alias("only2"),
        F.size("n1").cast("long").alias("count1"),
        F.size("n2").cast("long").alias("count2"),
        T.rounded(S.jaccard(F.col("n1"), F.col("n2"), 1.0) * 100, 1).alias("similarity_pct"),
        T.rounded(S.dice(F.col("n1"), F.col("n2")) * 100, 1).alias("dice_pct"),
    )


def sheet(reconciliation: DataFrame) -> DataFrame:
    """(pair_id, row_no, only_in_AFS1, only_in_AFS2, in_both): the three lists side by side, padded with "" ."""
    zipped = F.arrays_zip(F.col("only1"), F.col("only2"), F.col("in_both"))
    rows = reconciliation.select("pair_id", F.posexplode(zipped).alias("row_no", "r"))
    pad = lambda c: F.coalesce(F.col(f"r.{c}"), F.lit(""))
    return rows.select("pair_id", F.col("row_no").cast("long").alias("row_no"), pad("only1").alias("only_in_AFS1"), pad("only2").alias("only_in_AFS2"), pad("in_both").alias("in_both"))
