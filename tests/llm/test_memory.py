"""What operators hold in memory at once."""

import pyarrow as pa
from pyspark.sql import functions as F

from folioscope.llm import common


def test_batches_of_long_rows_are_small(spark):
    """Rows of 100 KB, as packed rows have: some MB are moved at once, and none is lost."""

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["rows", "size"])

    rows = spark.range(0, 600, 1, 1).select("id", F.repeat(F.lit("x"), 100_000).alias("text"))
    got = common.arrow_map(rows, sizes, "rows long, size long").collect()
    assert sum(r.rows for r in got) == 600 and max(r.size for r in got) < common.BYTES + 200_000


def test_a_task_gives_its_memory_back(spark, monkeypatch):
    """Also one that fails or is not read to its end."""
    done = []
    monkeypatch.setattr(common, "trimmed", lambda: done.append(1))
    held = []

    class Frame:
        sparkSession = spark

        def mapInArrow(self, run, schema):
            held.append(run)

    common.arrow_map(Frame(), lambda batches: batches, "n long")
    batch = pa.RecordBatch.from_arrays([pa.array([1])], ["n"])
    assert list(held[0](iter([batch]))) == [batch] and done == [1]
    part = held[0](iter([batch, batch]))
    next(part)
    part.close()
    assert done == [1, 1]
