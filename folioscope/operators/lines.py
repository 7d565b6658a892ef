"""Operators on lines: merging, the token index, matching and what follows from it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions import fixed as X
from folioscope.functions import lines as L
from folioscope.functions import text as T
from folioscope.sources.scratch import small_batches

DIFF_SCHEMA = "seq int, status string, line1 string, line2 string, similarity double, num_diff array<string>, word_diff array<struct<word:string,tag:string>>"


def merged(lines: Column) -> Column:
    """Wrapped lines joined: a line that begins in lower case continues one of 15 characters or more that has no end.

    A line equal to the merged one before it, whatever the case, is dropped first. Lines of which none continues or
    equals the one before it stay as they are, unfolded.
    """

    def joins(last: Column, line: Column) -> Column:
        return F.substring(line, 1, 1).rlike(r"^\p{Ll}") & ~last.rlike(X.LINE_END) & (F.length(last) >= X.WRAPPED_CHARS)

    def equal(last: Column, line: Column) -> Column:
        # First letters of ASCII tell most lines apart; those of other scripts may change with what follows them.
        a, b = F.substring(last, 1, 1), F.substring(line, 1, 1)
        return ((F.lower(a) == F.lower(b)) | ~T.is_ascii(a) | ~T.is_ascii(b)) & (F.lower(last) == F.lower(line))

    def step(state: Column, line: Column) -> Column:
        done, last, open_ = state["done"], F.get(state["last"], 0), F.size(state["last"]) > 0
        now = lambda done, last: F.struct(done.alias("done"), last.alias("last"))
        return (
            F.when(open_ & equal(last, line), now(done, state["last"]))
            .when(open_ & joins(last, line), now(done, F.array(F.concat(last, F.lit(" "), line))))
            .otherwise(now(F.concat(done, state["last"]), F.array(line)))
        )

    kind = "array<string>"
    start = F.struct(F.array().cast(kind).alias("done"), F.array().cast(kind).alias("last"))

    def folds(held: Column) -> Column:
        rest = F.greatest(F.size(held) - 1, F.lit(0))
        return F.exists(F.zip_with(F.slice(held, F.lit(1), rest), F.slice(held, F.lit(2), rest), lambda x, y: equal(x, y) | joins(x, y)), lambda met: met)

    fold = lambda held: F.element_at(F.transform(F.array(T.folded(held, start, step, "done", kind)), lambda s: F.concat(s["done"], s["last"])), 1)
    return F.element_at(F.transform(F.array(lines), lambda held: F.when(folds(held), fold(held)).otherwise(held)), 1)


#: Rows and characters of a batch of results, about.
OUT_ROWS, OUT_CHARS = 4_096, 1 << 20


def compared(texts: DataFrame, engine: str = "a", keys: tuple[str, ...] = ("pair_id",)) -> DataFrame:
    """The keys and rows of DIFF_SCHEMA for every pair of texts, (*keys, text1, text2).

    Cleaning and merging run in the JVM; the greedy matching, whose every step depends on the ones before, takes a
    pair at a time in Python. Pairs are dealt over a set number of tasks: their work is in the matching, not in
    their bytes, by which adaptive execution would gather them in a few. A task holds a batch of pairs and one of results.
    """
    spark = texts.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    lines = texts.select(*keys, merged(T.lines_of(F.col("text1"))).alias("lines1"), merged(T.lines_of(F.col("text2"))).alias("lines2"))
    small_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        named, rows, chars = [], [], 0
        for batch in batches:
            kinds = [batch.schema.field(k).type for k in range(len(keys))]
            for at in range(batch.num_rows):
                *own, lines1, lines2 = (c[at].as_py() for c in batch.columns)
                found = L.matched(lines1, lines2, engine)
                named += [(*own, seq) for seq in range(len(found))]
                rows += found
                chars += sum(map(len, lines1)) + sum(map(len, lines2))
                if len(rows) >= OUT_ROWS or chars >= OUT_CHARS:
                    yield _batch(keys, kinds, named, rows)
                    named, rows, chars = [], [], 0
        if rows:
            yield _batch(keys, kinds, named, rows)

    schema = ", ".join(f"{c} {texts.schema[c].dataType.simpleString()}" for c in keys)
    return lines.repartition(tasks, *keys).mapInArrow(run, f"{schema}, {DIFF_SCHEMA}")


def _batch(keys: tuple[str, ...], kinds: list[pa.DataType], named: list[tuple], rows: list[dict]) -> pa.RecordBatch:
    """Rows of matching in the columns of DIFF_SCHEMA, after their keys."""
    words = [w for r in rows for w in r["word_diff"]]
    ends = pa.array(np.cumsum([0, *(len(r["word_diff"]) for r in rows)]), pa.int32())
    word, tag = (pa.array([w[k] for w in words], pa.string()) for k in (0, 1))
    text = {c: pa.array([r[c] for r in rows], pa.string()) for c in ("status", "line1", "line2")}
    columns = dict(zip((*keys, "seq"), (pa.array(x, t) for x, t in zip(zip(*named, strict=True), (*kinds, pa.int32()), strict=True)), strict=True)) | text
    columns |= {"similarity": pa.array([r["similarity"] for r in rows], pa.float64()), "num_diff": pa.array([r["num_diff"] for r in rows], pa.list_(pa.string()))}
    columns |= {"word_diff": pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([word, tag], ["word", "tag"]))}
    return pa.RecordBatch.from_pydict(columns)


def status_counts(diff: DataFrame, *keys: str) -> DataFrame:
    """n_same, n_changed, n_added, n_removed, n_total, pct_same and pct_affected of each key."""
    n = {s: F.count_if(F.col("status") == s) for s in ("same", "changed", "added", "removed")}
    total = F.count(F.lit(1))
    return diff.groupBy(*keys).agg(
        *[n[s].alias(f"n_{s}") for s in n],
        total.alias("n_total"),
        T.rounded(n["same"] / F.greatest(total, F.lit(1)) * 100, 1).alias("pct_same"),
        T.rounded((n["changed"] + n["added"] + n["removed"]) / F.greatest(total, F.lit(1)) * 100, 1).alias("pct_affected"),
    )


def index_entries(lines: DataFrame) -> DataFrame:
    """(pair_id, side, ord, key): the keys under which each line is found."""
    rows = lines.select("pair_id", "side", "ord", T.normalise(T.decomposed(F.col("line"))).alias("norm"))
    rows = rows.select("pair_id", "side", "ord", T.tokens(F.col("norm")).alias("tokens"))
    return rows.select("pair_id", "side", "ord", F.explode(T.index_keys(F.col("tokens"))).alias("key"))


def candidates(lines: DataFrame, most: int = L.CANDIDATES) -> DataFrame:
    """(pair_id, ord2, ord1): for each second line the lowest first lines that share an index key with it.

    The lowest of all are among the lowest of each key, so a key keeps no more, in each task before the shuffle already: a
    join by key meets a row for each.
    """
    keyed = index_entries(lines)
    lowest = F.row_number().over(Window.partitionBy("pair_id", "key").orderBy("ord"))
    first = keyed.filter("side = 1").withColumn("n", lowest).filter(F.col("n") <= most).groupBy("pair_id", "key").agg(F.collect_list("ord").alias("ords"))
    second = keyed.filter("side = 2").select("pair_id", "key", F.col("ord").alias("ord2"))
    hits = second.join(first, ["pair_id", "key"]).groupBy("pair_id", "ord2").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ords")))).alias("found"))
    return hits.select("pair_id", "ord2", F.explode(F.slice("found", 1, most)).alias("ord1"))


#: Characters of a pair's first side up to which one task's row holds its index; longer pairs are joined by key.
WHOLE = 1 << 20


def candidates_in_pairs(lines: DataFrame, most: int = L.CANDIDATES) -> DataFrame:
    """candidates() of lines (pair_id, sides, ord, line) of pairs that no partition parts and whose lines follow each other there.

    A pair's index is held while its lines are looked up, so pairs must be short. sides are bits: a line of 3 is on both.
    """
    rows = lines.select("pair_id", "ord", "sides", T.normalise(T.decomposed(F.col("line"))).alias("norm"))
    small_batches(lines.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: tuple[list[int], list[int], list[int]] = ([], [], [])
        pair, held = None, []

        def made() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["pair_id", "ord2", "ord1"])
            for c in out:
                c.clear()
            return batch

        def ended() -> Iterator[pa.RecordBatch]:
            for place, places in L.near(held, most):
                for column, values in zip(out, ([pair] * len(places), [place] * len(places), places), strict=True):
                    column += values
                if len(out[0]) >= OUT_ROWS:
                    yield made()

        for batch in batches:
            for own, *line in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own != pair:
                    yield from ended()
                    pair, held = own, []
                held.append(line)
        yield from ended()
        yield made()

    return rows.mapInArrow(run, "pair_id long, ord2 long, ord1 long")
