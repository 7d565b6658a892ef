"""Vectors as packed bytes, and a set of query rows that meets all vectors in blocks.

Queries are dealt to tiles of a set size. A tile's queries go to each of its groups of blocks, and blocks stream past them
one at a time: a task holds the queries of one tile and a single block, however many rows there are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from folioscope.llm.common import arrow_map, written

#: Bytes of a block's vectors and rows of one at most; groups of blocks that a tile's work is dealt over.
BLOCK_BYTES, BLOCK_ROWS, GROUPS = 1 << 21, 4096, 16

STREAM = "tile long, grp int, kind int, row long, vec_id long, label int, v binary, state array<long>, leaf int, block int, ids binary, rows binary, labels binary, extra binary"
_NAMES = [c.split()[0] for c in STREAM.split(", ")]


def finite(vector: Column) -> Column:
    """True for a vector that is there and has neither null nor infinite nor undefined components."""
    return vector.isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))


def _pack(batches, names: list[str]):
    for batch in batches:
        lists = batch.column(batch.num_columns - 1)
        values, at = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
        numbers = values.to_numpy(zero_copy_only=False)
        ends = ((at - at[0]) * numbers.itemsize).astype(np.int32)
        v = pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(np.ascontiguousarray(numbers).tobytes())])
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], v], names)


def rows_of(table: DataFrame, *columns: Column, vector: str = "embedding") -> tuple[DataFrame, str]:
    """(row, vec_id, *columns, v) of all rows with an id and a finite vector, written; and the type of v's components.

    row tells rows apart that share an id; it is fixed as the table is written.
    """
    kind = table.schema[vector].dataType
    narrow = isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType)
    v = F.col(vector) if narrow else F.col(vector).cast("array<double>")
    some = table.filter(F.col("vec_id").isNotNull() & finite(v)).select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), *columns, v.alias("v"))
    names = some.columns
    schema = ", ".join(f"{c} {'binary' if c == 'v' else some.schema[c].dataType.simpleString()}" for c in names)
    return written(arrow_map(some, _pack, schema, names), "vectors"), "f4" if narrow else "f8"


def matrix(column: pa.Array, dtype: str, width: int) -> np.ndarray:
    """The vectors of a binary column as rows of doubles; shorter ones end in zeros."""
    raw = column.to_pylist()
    size = np.dtype(dtype).itemsize
    if all(len(x) == width * size for x in raw):
        return np.frombuffer(b"".join(raw), dtype).reshape(len(raw), width).astype(np.float64)
    out = np.zeros((len(raw), width))
    for k, x in enumerate(raw):
        out[k, : len(x) // size] = np.frombuffer(x, dtype)
    return out


def width_of(rows: DataFrame, dtype: str) -> int:
    return (rows.agg(F.max(F.octet_length("v"))).first()[0] or 0) // np.dtype(dtype).itemsize


def block_rows(width: int) -> int:
    return min(BLOCK_ROWS, max(32, BLOCK_BYTES // (8 * max(1, width))))


def stream_rows(df: DataFrame) -> DataFrame:
    """df with all columns of STREAM, null where it has none."""
    types = dict(c.split() for c in STREAM.split(", "))
    return df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(types[c]).alias(c) for c in _NAMES])


def streamed(queries: DataFrame, blocks: DataFrame, make: Callable, schema: str, *args) -> DataFrame:
    """Both in the form of STREAM: each (tile, grp) gets its queries, kind 0, and then its blocks, kind 1.

    make(queries, blocks, *args) gets the queries as one batch and the blocks one by one, and yields record batches.
    """

    def run(batches: Iterator[pa.RecordBatch], *rest):
        rows = (batch.slice(k, 1) for batch in batches for k in range(batch.num_rows))
        ahead = next(rows, None)
        value = lambda row, name: row.column(row.schema.get_field_index(name))[0].as_py()
        while ahead is not None:
            own = value(ahead, "tile"), value(ahead, "grp")
            held = []
            while ahead is not None and value(ahead, "kind") == 0 and (value(ahead, "tile"), value(ahead, "grp")) == own:
                held.append(ahead)
                ahead = next(rows, None)

            def blocks_of():
                nonlocal ahead
                while ahead is not None and value(ahead, "kind") == 1 and (value(ahead, "tile"), value(ahead, "grp")) == own:  # noqa: B023
                    yield {name: value(ahead, name) for name in ("row", "leaf", "block", "v", "ids", "rows", "labels", "extra")}
                    ahead = next(rows, None)

            theirs = blocks_of()
            if held:
                yield from make(pa.Table.from_batches(held).combine_chunks().to_batches()[0], theirs, *rest)
            for _ in theirs:  # blocks without queries
                pass

    both = queries.unionByName(blocks)
    # A set number of tasks: their work is in the products, not in the bytes by which adaptive execution would gather them.
    tasks = int(both.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = both.repartition(tasks, "tile", "grp").sortWithinPartitions("tile", "grp", "kind", "leaf", "block")
    return arrow_map(dealt, run, schema, *args)
