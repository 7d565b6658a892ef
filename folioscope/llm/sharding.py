"""K-d tree partitioning of documents into shards of equal bytes.

Each node of the tree is split along its widest metadata dimension at the weighted median (of UTF-8 bytes; for an
odd number of shards, at the matching share). Medians are distributed, in one pass over the metadata for each level of
the tree: a task sorts the rows of each open node in each dimension and keeps points of them, each with the bytes up to
it, POINTS of a dimension for all nodes together; points are merged and thinned FAN at a time, and the driver gets LAST
such summaries at most, of a size that no table sets. A cut lies between two points, so it misses its goal by a few points' bytes at most. No row moves until
shards are known.

The dimensions are taken from the text, so that equal texts share a point of the space: byte length, first and
second character, word density; ties within a dimension are ordered by a checksum of the text and then by a number
that each row has of its own, so equal texts lie side by side and are parted only where a cut falls among them, which is how
a group larger than a shard is spread, repeated rows included.

Defined cases: a null text has no bytes, checksum 0 and size 16; null doc_ids and repeated rows are rows like others; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.common import arrow_map, written

SHARDS, OVERHEAD = 40, 16
#: Points of a dimension in a summary, for all open nodes together; summaries that are merged at once, and that the
#: driver gets at most; rows that a task sorts at once.
POINTS, FAN, LAST, CHUNK = 1 << 14, 16, 4, 1 << 18
#: Metadata dimensions, each a long below 2**30.
DIMENSIONS = ("d_size", "d_first", "d_second", "d_density")
#: Rows that one task numbers at a time.
SLOT_ROWS = 50_000


@dataclass
class Node:
    """A leaf while dimension is None."""

    shards: range
    dimension: int | None = None
    cut: tuple[int, int] = (0, 0)  # rows go left up to this key and, of rows with this key, this number
    left: "Node | None" = None
    right: "Node | None" = None


def metadata(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    n = F.octet_length(text).cast("long")
    # Long, as 100,000 times the spaces of a text of 21,475 words is more than an int holds.
    spaces = (F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))).cast("long")
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (n + OVERHEAD).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.least(n, F.lit((1 << 30) - 1)).alias("d_size"),
        F.ascii(text).cast("long").alias("d_first"),
        F.ascii(F.substring(text, 2, 1)).cast("long").alias("d_second"),
        F.when(n > 0, (spaces * 100000 / n).cast("long")).otherwise(0).alias("d_density"),
        F.monotonically_increasing_id().alias("tie"),
    )


class Rows:
    """A batch of metadata() as arrays; keys order rows by a dimension, then by checksum."""

    def __init__(self, batch: pa.RecordBatch):
        get = lambda name: batch.column(batch.schema.get_field_index(name))
        self.tie = get("tie").to_numpy()
        self.size = get("size").to_numpy()
        crc = get("text_crc32").to_numpy()
        self.keys = [get(d).to_numpy() * (1 << 32) + crc for d in DIMENSIONS]

    def leaves(self, node: Node, at: np.ndarray | None = None, out: np.ndarray | None = None) -> np.ndarray:
        """The first shard of each row's leaf."""
        if at is None:
            at, out = np.arange(len(self.size)), np.zeros(len(self.size), np.int32)
        if node.dimension is None:
            out[at] = node.shards.start
            return out
        key = self.keys[node.dimension][at]
        below = (key < node.cut[0]) | ((key == node.cut[0]) & (self.tie[at] <= node.cut[1]))
        self.leaves(node.left, at[below], out)
        self.leaves(node.right, at[~below], out)
        return out


def thinned(key: np.ndarray, tie: np.ndarray, weight: np.ndarray, points: int) -> tuple[np.ndarray, ...]:
    """At most about so many points in order, each with the weight of all rows after the point before it."""
    order = np.lexsort((tie, key))
    key, tie, weight = key[order], tie[order], weight[order]
    ends = np.cumsum(weight)
    if not len(ends):
        return key, tie, weight
    step = np.floor((ends - weight / 2) * (points / ends[-1])).astype(np.int64)
    last = np.flatnonzero(np.append(step[1:] != step[:-1], True))
    return key[last], tie[last], np.diff(np.append(0.0, ends[last]))


SUMMARY = "place int, keys binary, ties binary, weights binary"


def _rows_of(found: dict[int, list[tuple]], points: int):
    """A row for each place, that is, node and dimension: its points merged and thinned."""
    for place, parts in found.items():
        made = thinned(*(np.concatenate(x) for x in zip(*parts, strict=True)), points)
        yield pa.RecordBatch.from_arrays([pa.array([place], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in made)], ["place", "keys", "ties", "weights"])


def _summaries(batches, root: Node, leaves: list[int], points: int):
    found: dict[int, list[tuple]] = {}
    held, n = [], 0

    def chunk():
        leaf, tie, size, *keys = (np.concatenate(x) for x in zip(*held, strict=True))
        for k, own in enumerate(leaves):
            at = np.flatnonzero(leaf == own)
            for d, key in enumerate(keys):
                if len(at):
                    found.setdefault(k * len(DIMENSIONS) + d, []).append(thinned(key[at], tie[at], size[at].astype(np.float64), points))

    for batch in batches:
        rows = Rows(batch)
        held.append((rows.leaves(root), rows.tie, rows.size, *rows.keys))
        n += batch.num_rows
        if n >= CHUNK:
            chunk()
            held, n = [], 0
    if held:
        chunk()
    yield from _rows_of(found, points)


def _points(place, *columns):
    return place, tuple(np.frombuffer(x, t) for x, t in zip(columns, (np.int64, np.int64, np.float64), strict=True))


def _merged(batches, points: int):
    found: dict[int, list[tuple]] = {}
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            place, own = _points(*row)
            found.setdefault(place, []).append(own)
    yield from _rows_of(found, points)


def summaries(rows: DataFrame, root: Node, leaves: list[int]) -> dict[int, tuple[np.ndarray, ...]]:
    """The points of each place, merged FAN at a time and on the driver last."""
    points = max(64, POINTS // len(leaves))
    parts = arrow_map(rows, _summaries, SUMMARY, root, leaves, points)
    n = rows.rdd.getNumPartitions()
    while n > LAST:
        n = -(-n // FAN)
        parts = arrow_map(parts.repartition(n), _merged, SUMMARY, points)
    found: dict[int, list[tuple]] = {}
    for row in parts.collect():
        place, own = _points(*row)
        found.setdefault(place, []).append(own)
    out = {}
    for place, own in found.items():
        key, tie, weight = (np.concatenate(x) for x in zip(*own, strict=True))
        order = np.lexsort((tie, key))
        out[place] = key[order], tie[order], weight[order]
    return out


def _leaves(node: Node) -> list[Node]:
    return [node] if node.dimension is None else _leaves(node.left) + _leaves(node.right)


def tree(rows: DataFrame, shards: int = SHARDS) -> Node:
    """The k-d tree over rows of metadata(); a node's width is that of the middle nine tenths of its bytes."""
    root = Node(range(shards))
    spread = None
    while open_nodes := [x for x in _leaves(root) if len(x.shards) > 1]:
        found = summaries(rows, root, [x.shards.start for x in open_nodes])
        if not found:
            return root
        of = lambda k, d: found.get(k * len(DIMENSIONS) + d, (np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(1)))  # noqa: E731, B023
        # Each dimension is measured by the spread of all rows, which the first pass has seen.
        spread = spread or [max(1, int((of(0, d)[0][-1] >> 32) - (of(0, d)[0][0] >> 32))) for d in range(len(DIMENSIONS))]
        for k, node in enumerate(open_nodes):
            wide = []
            for d in range(len(DIMENSIONS)):
                key, _, weight = of(k, d)
                reach = np.cumsum(weight)
                ends = [int(key[min(len(key) - 1, np.searchsorted(reach, reach[-1] * q))]) >> 32 for q in (0.05, 0.95)]
                wide.append((ends[1] - ends[0]) / spread[d])
            node.dimension = int(np.argmax(wide))
            key, tie, weight = of(k, node.dimension)
            reach = np.cumsum(weight)
            at = int(np.argmin(np.abs(reach - reach[-1] * (len(node.shards) // 2) / len(node.shards))))
            node.cut = int(key[at]), int(tie[at])
            node.left = Node(range(node.shards.start, node.shards.start + len(node.shards) // 2))
            node.right = Node(range(node.left.shards.stop, node.shards.stop))
    return root


def _assigned(batches, root: Node):
    for batch in batches:
        rows = Rows(batch)
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), pa.array(rows.tie), pa.array(rows.leaves(root), pa.int32())], ["doc_id", "size", "text_crc32", "tie", "shard"])


def sharded(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row."""
    rows = written(metadata(docs), "shard-metadata")
    rows = arrow_map(rows, _assigned, "doc_id long, size long, text_crc32 long, tie long, shard int", tree(rows, shards))
    # Slots: rows are numbered within blocks of a shard, and blocks are numbered by sums of their counts.
    most = rows.groupBy("shard").count().agg(F.max("count")).first()[0] or 0
    rows = rows.withColumn("block", F.pmod(F.xxhash64("tie"), F.lit(max(1, -(-most // SLOT_ROWS) * 8))).cast("int"))
    counts = rows.groupBy("shard", "block").count()
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "block", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("shard", "block").orderBy("doc_id", "text_crc32", "tie"))
    return rows.withColumn("inside", inside).join(offsets, ["shard", "block"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("inside") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def op2(spark, sf_dir: str) -> DataFrame:
    return sharded(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
