"""Hard negatives by distributed radix selection.

Rows are scored against anchors by integer inner products. For each anchor and positive a window of scores is allowed;
the score of the last negative to keep is found digit by digit: tasks count the scores of the window in a histogram over
the next digit (those alone that agree in the digits found so far), histograms are summed, and the bucket that holds
the last one fixes the digit. When all digits are known, a last pass gathers the rows above that score, and of those
at it the smallest ids that are still wanted, so that ties of any number never meet in one place.

Anchors are dealt to tiles of ANCHORS; the rows, in packed blocks, stream past each tile's anchors.

Defined cases: rows without an id, a label or a finite vector take no part; a vector without components has score 0
with all; shorter vectors count as if zeros followed; rows that share an id are rows of their own, and one anchor's
row may be the positive of another with its id; an anchor without positives, or a window without rows, gives no row; an
empty table gives an empty result; extra columns are ignored. Scores that no long can hold raise ValueError.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm import vectors as V
from folioscope.llm.common import arrow_map, drop_written, written

#: Fixed values of the contract: positives of an anchor, negatives of a positive, and their scores in hundredths of the positive's.
POSITIVES, NEGATIVES, LEAST, MOST = 5, 3, 50, 95
#: Anchors of a tile, anchors whose scores are held at once, bits of a digit.
ANCHORS, HELD, DIGIT = 4096, 256, 8


def _blocks(batches, width: int, dtype: str, size: int):
    """Packed blocks of some rows: ids, row keys, labels and the components times 256, rounded down."""
    held, n = [], 0

    def block():
        row, ids, labels = (np.concatenate([b.column(k).to_numpy(zero_copy_only=False) for b in held]) for k in range(3))
        x = np.concatenate([V.matrix(b.column(3), dtype, width) for b in held])
        parts = [row.astype(np.int64), ids.astype(np.int64), labels.astype(np.int32), np.floor(x * 256)]
        return pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary()) for a in parts], ["rows", "ids", "labels", "v"])

    for batch in batches:
        at = 0
        while at < batch.num_rows:
            part = batch.slice(at, size - n)
            held.append(part)
            n += part.num_rows
            at += part.num_rows
            if n == size:
                yield block()
                held, n = [], 0
    if held:
        yield block()


class Tile:
    """A tile's anchors and their windows: the state of each is (lo, hi, prefix) for each of its positives."""

    def __init__(self, batch: pa.RecordBatch, width: int, dtype: str, exact: type):
        get = lambda name: batch.column(batch.schema.get_field_index(name))
        self.row, self.label = (get(c).to_numpy(zero_copy_only=False) for c in ("row", "label"))
        self.x = np.floor(V.matrix(get("v"), dtype, width) * 256).astype(exact)
        self.exact, self.width = exact, width
        state = get("state").to_pylist()
        self.windows = np.array(state, np.int64).reshape(len(state), -1, 4) if state and state[0] is not None else None

    def scores(self, block: dict):
        """(first anchor, scores of some anchors with all rows of the block, row keys, ids, labels)."""
        row, ids, labels = (np.frombuffer(block[c], t) for c, t in (("rows", np.int64), ("ids", np.int64), ("labels", np.int32)))
        y = np.frombuffer(block["v"], np.float64).reshape(len(row), self.width).astype(self.exact)
        for k in range(0, len(self.row), HELD):
            yield k, (self.x[k : k + HELD] @ y.T).astype(np.int64), row, ids, labels


def _least(owner: np.ndarray, score: np.ndarray, ids: np.ndarray, row: np.ndarray, most: int) -> tuple[np.ndarray, ...]:
    """Of each owner the rows of the highest scores, ties to smaller ids, `most` of them."""
    order = np.lexsort((row, ids, -score, owner))
    own = owner[order]
    starts = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else np.zeros(0, np.int64)
    keep = order[np.arange(len(own)) - np.repeat(starts, np.diff(np.append(starts, len(own)))) < most]
    return owner[keep], score[keep], ids[keep], row[keep]


def _merge(found: list[tuple], most: int) -> tuple[np.ndarray, ...]:
    return _least(*(np.concatenate(x) for x in zip(*found, strict=True)), most)


def _positives(anchors, blocks, width: int, dtype: str, exact: type):
    tile = Tile(anchors, width, dtype, exact)
    best = tuple(np.zeros(0, np.int64) for _ in range(4))
    for block in blocks:
        found = [best]
        for k, s, row, ids, labels in tile.scores(block):
            same = (labels[None, :] == tile.label[k : k + HELD, None]) & (row[None, :] != tile.row[k : k + HELD, None])
            s = np.where(same, s, np.iinfo(np.int64).min)
            if s.shape[1] > POSITIVES:  # what is below a block's own last positive is none
                same &= s >= np.partition(s, -POSITIVES, axis=1)[:, -POSITIVES, None]
            a, r = np.nonzero(same)
            found.append(_least(a + k, s[a, r], ids[r], row[r], POSITIVES))
        best = _merge(found, POSITIVES)
    yield pa.RecordBatch.from_arrays([pa.array(tile.row[best[0]]), pa.array(best[3]), pa.array(best[2]), pa.array(best[1])], ["anchor", "positive", "positive_id", "score"])


def _inside(tile: Tile, block: dict):
    """The rows of other labels within any window: (anchor, positive's number, hi - score, row's id, row)."""
    for k, s, row, ids, labels in tile.scores(block):
        w = tile.windows[k : k + HELD]
        some = (labels[None, :] != tile.label[k : k + HELD, None]) & (s >= w[:, :, 0].min(axis=1)[:, None]) & (s <= w[:, :, 1].max(axis=1)[:, None])
        a, r = np.nonzero(some)
        score = s[a, r]
        for p in range(w.shape[1]):
            lo, hi = w[a, p, 0], w[a, p, 1]
            at = np.flatnonzero((score >= lo) & (score <= hi))
            yield a[at] + k, p, hi[at] - score[at], ids[r[at]], row[r[at]]


def _histograms(anchors, blocks, width: int, dtype: str, exact: type, shift: int):
    tile = Tile(anchors, width, dtype, exact)
    n, p = tile.windows.shape[:2]
    counts = np.zeros((n * p) << DIGIT, np.int64)
    for block in blocks:
        for a, k, below, _, _ in _inside(tile, block):
            own = (below >> (shift + DIGIT)) == tile.windows[a, k, 2]
            at = ((a[own] * p + k) << DIGIT) + ((below[own] >> shift) & ((1 << DIGIT) - 1))
            cells, n_rows = np.unique(at, return_counts=True)
            counts[cells] += n_rows
    # Of a window, the buckets after the one that reaches what is wanted here cannot hold the last one wanted of all.
    counts = counts.reshape(n * p, 1 << DIGIT)
    wanted = np.cumsum(counts, axis=1) - counts < tile.windows[:, :, 3].reshape(-1, 1)
    counts = np.where(wanted, counts, 0).reshape(-1)
    cells = np.flatnonzero(counts)
    window = cells >> DIGIT
    yield pa.RecordBatch.from_arrays([pa.array(tile.row[window // p]), pa.array((window % p).astype(np.int32)), pa.array((cells & ((1 << DIGIT) - 1)).astype(np.int32)), pa.array(counts[cells])], ["anchor", "p", "digit", "n"])


def _gathered(anchors, blocks, width: int, dtype: str, exact: type):
    tile = Tile(anchors, width, dtype, exact)
    p = tile.windows.shape[1]
    none = tuple(np.zeros(0, np.int64) for _ in range(4))
    best = none
    for block in blocks:
        found = [best]
        for a, k, below, ids, row in _inside(tile, block):
            keep = below <= tile.windows[a, k, 2]
            found.append((a[keep] * p + k, -below[keep], ids[keep], row[keep]))
        best = _merge(found, NEGATIVES)
    window = best[0]
    hi = tile.windows[window // p, window % p, 1]
    yield pa.RecordBatch.from_arrays([pa.array(tile.row[window // p]), pa.array((window % p).astype(np.int32)), pa.array(best[2]), pa.array(best[1] + hi), pa.array(best[3])], ["anchor", "p", "negative_id", "score", "negative"])


def mined(table: DataFrame, anchor_step: int = 50) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of all anchors and positives."""
    label = F.col("label").cast("int")
    moved = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    rows, dtype = V.rows_of(table.filter(F.col("label").isNotNull()), moved.alias("label"))
    width = V.width_of(rows, dtype)
    biggest = _biggest(rows, dtype)
    if biggest * biggest * max(1, width) >= 1 << 63:
        raise ValueError("scores of these vectors do not fit a long")
    exact = np.float64 if biggest * biggest * max(1, width) < 1 << 53 else np.int64
    anchors = rows.filter(F.col("vec_id") % anchor_step == 0)
    tiles = max(1, -(-anchors.count() // ANCHORS))
    blocks = written(arrow_map(rows, _blocks, "rows binary, ids binary, labels binary, v binary", width, dtype, V.block_rows(width)), "vector-blocks")
    # Each block meets the anchors of every tile, in one group of the tile's work.
    theirs = blocks.withColumn("grp", F.pmod(F.xxhash64("rows"), F.lit(V.GROUPS)).cast("int")).withColumn("tile", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))))
    theirs = V.stream_rows(theirs.withColumn("kind", F.lit(1)))

    def asked(own: DataFrame) -> DataFrame:
        dealt = own.withColumn("tile", F.pmod(F.xxhash64("row"), F.lit(tiles))).withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(V.GROUPS - 1))))
        return V.stream_rows(dealt.withColumn("kind", F.lit(0)))

    near = V.streamed(asked(anchors), theirs, _positives, "anchor long, positive long, positive_id long, score long", width, dtype, exact)
    place = F.row_number().over(Window.partitionBy("anchor").orderBy(F.desc("score"), "positive_id", "positive")) - 1
    near = near.withColumn("p", place).filter(F.col("p") < POSITIVES)
    # What the shares allow in whole numbers; nothing where the positive's score is below zero.
    lo, hi = (F.expr(f"(cast(score as decimal(20,0)) * {share} + {more}) div 100") for share, more in ((LEAST, 99), (MOST, 0)))
    windows = near.filter("score >= 0").select("anchor", "p", "positive_id", F.col("score").alias("positive_score"), lo.alias("lo"), hi.alias("hi")).filter("lo <= hi")
    windows = written(windows.withColumn("prefix", F.lit(0).cast("long")).withColumn("wanted", F.lit(NEGATIVES).cast("long")), "windows")
    widest = windows.agg(F.max(F.col("hi") - F.col("lo"))).first()[0] or 0
    shift = max(0, -(-int(widest).bit_length() // DIGIT) - 1) * DIGIT
    while True:
        counts = V.streamed(asked(_with_windows(anchors, windows)), theirs, _histograms, "anchor long, p int, digit int, n long", width, dtype, exact, shift)
        before, windows = windows, written(_refined(windows, counts, shift), "windows")
        drop_written(before)
        if shift == 0:
            break
        shift -= DIGIT
    found = V.streamed(asked(_with_windows(anchors, windows)), theirs, _gathered, "anchor long, p int, negative_id long, score long, negative long", width, dtype, exact)
    rank = F.row_number().over(Window.partitionBy("anchor", "p").orderBy(F.desc("score"), "negative_id", "negative"))
    found = found.withColumn("rank", rank).filter(F.col("rank") <= NEGATIVES)
    ids = anchors.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    return found.join(windows.select("anchor", "p", "positive_id", "positive_score"), ["anchor", "p"]).join(ids, "anchor").select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", F.col("score").alias("negative_score"),
    )


def _tops(batches, dtype: str):
    for batch in batches:
        top = max((float(np.abs(np.floor(np.frombuffer(x, dtype).astype(np.float64) * 256)).max(initial=0)) for x in batch.column(0).to_pylist()), default=0.0)
        yield pa.RecordBatch.from_arrays([pa.array([top])], ["top"])


def _biggest(rows: DataFrame, dtype: str) -> int:
    return int(arrow_map(rows.select("v"), _tops, "top double", dtype).agg(F.max("top")).first()[0] or 0)


def _with_windows(anchors: DataFrame, windows: DataFrame) -> DataFrame:
    """Anchors with the windows of their positives in order; places without one allow no score."""
    one = F.array("lo", "hi", "prefix", "wanted")
    packed = windows.groupBy(F.col("anchor").alias("row")).agg(F.map_from_entries(F.collect_list(F.struct("p", one.alias("w")))).alias("ws"))
    none = F.array(*[F.lit(x).cast("long") for x in (1, 0, 0, 0)])
    state = F.flatten(F.array(*[F.coalesce(F.element_at("ws", F.lit(p)), none) for p in range(POSITIVES)]))
    return anchors.join(packed.select("row", state.alias("state")), "row")


def _refined(windows: DataFrame, counts: DataFrame, shift: int) -> DataFrame:
    """The windows with a digit more: the one whose bucket holds the last row wanted, or the last bucket if there are too few."""
    sums = counts.groupBy("anchor", "p", "digit").agg(F.sum("n").alias("n"))
    upto = Window.partitionBy("anchor", "p").orderBy("digit")
    sums = sums.withColumn("upto", F.sum("n").over(upto))
    reached = sums.join(windows.select("anchor", "p", "wanted"), ["anchor", "p"]).filter(F.col("upto") >= F.col("wanted"))
    first = reached.groupBy("anchor", "p").agg(F.min(F.struct("digit", F.col("upto") - F.col("n"))).alias("at"))
    digit, above = F.col("at")["digit"].cast("long"), F.col("at").getField("col2")
    few = F.col("at").isNull()
    return windows.join(first, ["anchor", "p"], "left").select(
        "anchor", "p", "positive_id", "positive_score", "lo", "hi",
        F.when(few, F.shiftright(F.col("hi") - F.col("lo"), shift)).otherwise(F.col("prefix") * (1 << DIGIT) + digit).alias("prefix"),
        # With too few rows every one is wanted: no later bucket can reach this number.
        F.when(few, F.lit(1 << 62)).otherwise(F.col("wanted") - above).alias("wanted"),
    )


def op12(spark, sf_dir: str) -> DataFrame:
    return mined(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE_SQL = f"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
a AS (SELECT * FROM v WHERE vec_id % 50 = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label AS own, v.vec_id AS other_id, v.label AS label, CAST(list_inner_product(a.q, v.q) AS BIGINT) AS score FROM a JOIN v ON a.vec_id <> v.vec_id),
p AS (SELECT anchor_id, other_id AS positive_id, score FROM s WHERE label = own QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= {POSITIVES})
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.other_id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND s.label <> s.own AND {LEAST} * p.score <= 100 * s.score AND 100 * s.score <= {MOST} * p.score
WINDOW w AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id)
QUALIFY row_number() OVER w <= {NEGATIVES}
"""
