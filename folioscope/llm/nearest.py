"""Nearest neighbours by inner product: stable projections of few dimensions, indexed by a kd-tree.

The largest inner product becomes the smallest distance: a row x gets a further component sqrt(M^2 - |x|^2), M the longest
row, and a query is scaled to length M and gets a zero. Both are projected on DIMENSIONS random normal directions.
A projected distance r of two points with distance d has r^2/d^2 distributed as chi-square, so a row that is nearer than
the worst of the neighbours found so far, at d, lies beyond r with a probability that falls with r^2/d^2. Buckets of
the kd-tree are verified from the nearest projected one on, and a query stops once no farther bucket could hold a nearer row
but with a probability under 1 - SURE: the stopping test. Rows are verified on their original vectors.

The tree's upper levels are fitted on SAMPLE rows and send every row to a leaf; leaves are dealt into blocks, each with the
lower levels of its own. Queries of a leaf search one of its blocks first, for a bound; with that bound the test says which
leaves they need, and their blocks stream past the queries. Equal vectors are one entry, with the smallest ids of its rows
and all of its queries asked once, so copies cost nothing.

Defined cases: rows without an id and vectors that are null, zero, without components or not finite (their squared length
too) take no part; shorter vectors count as if zeros followed; rows that share an id are rows of their own, so that a
query may find its id in another row; fewer candidates than asked for are all returned; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm import vectors as V
from folioscope.llm.common import arrow_map, written

#: Neighbours of a query; dimensions of the projection (even); certainty of the stopping test; seed of the directions.
NEAREST, DIMENSIONS, SURE, SEED = 20, 8, 0.95, 7
#: Rows that the upper tree is fitted on, leaves of it at most, rows of a bucket, queries of a tile and those searched at once.
SAMPLE, LEAVES, BUCKET, QUERIES, HELD = 1 << 13, 256, 64, 2048, 512
#: Nearest buckets of a block that are verified before the bound is looked at again.
WAVES = (4, 16)
#: A vector that more than one in so many queries have is dealt over as many tasks when results go back to its queries.
HOT = 256


def chi_square_bound(sure: float = SURE, dimensions: int = DIMENSIONS) -> float:
    """Below it lies a chi-square variable with this probability; closed form for an even number of dimensions."""
    def below(x: float) -> float:
        term, total = 1.0, 1.0
        for i in range(1, dimensions // 2):
            term *= x / 2 / i
            total += term
        return 1 - math.exp(-x / 2) * total

    low, high = 0.0, 1000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if below(mid) < sure else (low, mid)
    return high


@dataclass
class Space:
    """What tasks need of the index: the directions, the longest length, the upper tree and its leaves' boxes."""

    width: int
    dtype: str
    longest: float
    directions: np.ndarray
    depth: int = 0
    split: np.ndarray | None = None  # the dimension and the cut of each inner node of the upper tree
    cut: np.ndarray | None = None
    boxes: np.ndarray | None = None  # of each leaf the least and the largest projection, in each dimension

    def of_rows(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.longest**2 - (x * x).sum(axis=1), 0))
        return x @ self.directions[:-1] + rest[:, None] * self.directions[-1]

    def of_queries(self, x: np.ndarray) -> np.ndarray:
        return (x * (self.longest / np.sqrt((x * x).sum(axis=1)))[:, None]) @ self.directions[:-1]

    def leaves(self, p: np.ndarray) -> np.ndarray:
        node = np.zeros(len(p), np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (p[np.arange(len(p)), self.split[node]] > self.cut[node])
        return node - ((1 << self.depth) - 1)


def fitted(p: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Dimension and cut of the inner nodes: medians along the widest dimension."""
    split, cut = np.zeros((1 << depth) - 1, np.int64), np.zeros((1 << depth) - 1)
    parts = {0: p}
    for node in range((1 << depth) - 1):
        own = parts.pop(node)
        if len(own):
            split[node] = int(np.argmax(own.max(axis=0) - own.min(axis=0)))
            cut[node] = np.median(own[:, split[node]])
        right = own[:, split[node]] > cut[node]
        parts[2 * node + 1], parts[2 * node + 2] = own[~right], own[right]
    return split, cut


def box_distances(p: np.ndarray, boxes: np.ndarray) -> np.ndarray:
    """Squared distance of each point to each box (boxes: number, two, dimensions)."""
    out = np.zeros((len(p), len(boxes)))
    for d in range(p.shape[1]):
        x = p[:, d, None]
        out += np.maximum(np.maximum(boxes[None, :, 0, d] - x, x - boxes[None, :, 1, d]), 0) ** 2
    return out


def _placed(batches, space: Space, queries: bool):
    for batch in batches:
        p = (space.of_queries if queries else space.of_rows)(V.matrix(batch.column(2), space.dtype, space.width))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(space.leaves(p).astype(np.int32))], ["row", "vec_id", "v", "leaf"])


def _projected(batches, space: Space):
    for batch in batches:
        p = space.of_rows(V.matrix(batch.column(0), space.dtype, space.width))
        yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in p], pa.binary())], ["p"])


def _norms(batches, dtype: str):
    for batch in batches:
        raw = [np.frombuffer(x, dtype).astype(np.float64) for x in batch.column(2).to_pylist()]
        with np.errstate(over="ignore"):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([float((x * x).sum()) for x in raw])], ["row", "vec_id", "v", "squared"])


def order_of(p: np.ndarray) -> np.ndarray:
    """The points in the order of a kd-tree whose buckets have BUCKET points each, the last one what is left."""
    done, open_ = [], [np.arange(len(p))]
    while open_:
        own = open_.pop()
        if len(own) <= BUCKET:
            done.append(own)
            continue
        d = int(np.argmax(p[own].max(axis=0) - p[own].min(axis=0)))
        half = -(-len(own) // BUCKET) // 2 * BUCKET or BUCKET
        own = own[np.argpartition(p[own, d], half - 1)]
        open_ += [own[half:], own[:half]]
    return np.concatenate(done)


def _blocks(batches, space: Space):
    """A row for each (leaf, block) of sorted rows (leaf, block, row, vec_id, v): in kd-order, with the boxes of buckets."""
    held: list[tuple[int, int, pa.RecordBatch]] = []

    def made():
        leaf, block, _ = held[0]
        rows = pa.Table.from_batches([b for _, _, b in held]).combine_chunks().to_batches()[0]
        x = V.matrix(rows.column(4), space.dtype, space.width)
        p = space.of_rows(x)
        order = order_of(p)
        boxes = np.array([[q.min(axis=0), q.max(axis=0)] for k in range(0, len(p), BUCKET) if len(q := p[order[k : k + BUCKET]])])
        row, ids = (rows.column(k).to_numpy()[order].astype(np.int64) for k in (2, 3))
        binary = [pa.array([a.tobytes()], pa.binary()) for a in (row, ids, x[order].astype(space.dtype), boxes)]
        low, high = boxes[:, 0].min(axis=0), boxes[:, 1].max(axis=0)
        kind = pa.list_(pa.float64())
        return pa.RecordBatch.from_arrays([pa.array([leaf], pa.int32()), pa.array([block], pa.int32()), *binary, pa.array([low.tolist()], kind), pa.array([high.tolist()], kind)], ["leaf", "block", "rows", "ids", "v", "extra", "low", "high"])

    for batch in batches:
        leaf, block = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        cuts = np.flatnonzero((leaf[1:] != leaf[:-1]) | (block[1:] != block[:-1])) + 1
        for a, b in zip([0, *cuts], [*cuts, len(leaf)], strict=True):
            if held and held[0][:2] != (leaf[a], block[a]):
                yield made()
                held.clear()
            held.append((leaf[a], block[a], batch.slice(a, b - a)))
    if held:
        yield made()


class Search:
    """Some queries and the best entries that each has found."""

    def __init__(self, batch: pa.RecordBatch, space: Space, most: int):
        get = lambda name: batch.column(batch.schema.get_field_index(name))
        self.space, self.most, self.limit = space, most, chi_square_bound()
        self.row = get("row").to_numpy()
        self.x = V.matrix(get("v"), space.dtype, space.width)
        self.length = np.sqrt((self.x * self.x).sum(axis=1))
        self.p = space.of_queries(self.x)
        # An earlier search's bound, as the bits of a double.
        state = get("state").to_pylist()
        self.floor = np.array([x[0] if x else np.float64(-np.inf).view(np.int64) for x in state], np.int64).view(np.float64)
        self.found = tuple(np.zeros(0, t) for t in (np.int64, np.float64, np.int64, np.int64))  # query, score, id, row
        self.worst = self.floor.copy()

    def reach(self, at: np.ndarray | slice) -> np.ndarray:
        """The squared projected distance from which the test lets a query stop."""
        m = self.space.longest
        far = np.maximum(2 * m * m - 2 * m / self.length[at] * self.worst[at], 0)
        return np.where(np.isfinite(self.worst[at]), self.limit * far * (1 + 1e-9) + 1e-12 * m * m, np.inf)

    def block(self, block: dict) -> None:
        ids, rows = (np.frombuffer(block[c], np.int64) for c in ("ids", "rows"))
        x = np.frombuffer(block["v"], self.space.dtype).reshape(len(ids), -1).astype(np.float64)
        boxes = np.frombuffer(block["extra"], np.float64).reshape(-1, 2, self.p.shape[1])
        for k in range(0, len(self.row), HELD):
            self._some(np.arange(k, min(k + HELD, len(self.row))), ids, rows, x, boxes)

    def _some(self, own: np.ndarray, ids: np.ndarray, rows: np.ndarray, x: np.ndarray, boxes: np.ndarray) -> None:
        far = box_distances(self.p[own], boxes)
        order = np.argsort(far, axis=1)
        start = 0
        for stop in (*WAVES, len(boxes)):
            stop = min(stop, len(boxes))
            if stop <= start:
                continue
            wave = order[:, start:stop]
            need = np.take_along_axis(far, wave, axis=1) < self.reach(own)[:, None]
            start = stop
            if not need.any():
                return
            scores = np.full((len(own), wave.shape[1], BUCKET), -np.inf)
            for bucket in np.unique(wave[need]).tolist():
                q, slot = np.nonzero(need & (wave == bucket))
                part = x[bucket * BUCKET : (bucket + 1) * BUCKET]
                scores[q, slot, : len(part)] = self.x[own[q]] @ part.T
            self._take(own, scores.reshape(len(own), -1), (wave[:, :, None] * BUCKET + np.arange(BUCKET)).reshape(len(own), -1), ids, rows, x)

    def _take(self, own, scores, column, ids, rows, x) -> None:
        # Products of a matrix may differ in the last bits by place; what may be among the best is scored again, in one way.
        slack = 1e-12 * self.space.longest * self.length[own]
        least = self.worst[own]
        if scores.shape[1] > self.most:
            least = np.maximum(least, np.partition(scores, -self.most, axis=1)[:, -self.most])
        q, c = np.nonzero((scores > -np.inf) & (scores >= (least - slack)[:, None]))
        if not len(q):
            return
        at = column[q, c]
        exact = np.concatenate([(self.x[own[q[k : k + 65536]]] * x[at[k : k + 65536]]).sum(axis=1) for k in range(0, len(q), 65536)])
        query, score, id_, row = (np.concatenate(z) for z in zip(self.found, (own[q], exact, ids[at], rows[at]), strict=True))
        order = np.lexsort((row, id_, -score, query))
        query = query[order]
        starts = np.flatnonzero(np.append(True, query[1:] != query[:-1]))
        place = np.arange(len(query)) - np.repeat(starts, np.diff(np.append(starts, len(query))))
        keep = place < self.most
        self.found = query[keep], score[order][keep], id_[order][keep], row[order][keep]
        last = place == self.most - 1
        self.worst[query[last]] = np.maximum(self.floor[query[last]], score[order][last])

    def result(self, need: bool) -> pa.RecordBatch:
        query, score, ids, row = self.found
        n = len(self.row)
        at = pa.array(np.searchsorted(query, np.arange(n + 1)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(at, pa.array(a)) for a in (score, ids, row)]
        if need:
            far = box_distances(self.p, self.space.boxes) < self.reach(slice(None))[:, None]
            leaves = pa.array([np.flatnonzero(x).astype(np.int32).tolist() for x in far], pa.list_(pa.int32()))
        else:
            leaves = pa.nulls(n, pa.list_(pa.int32()))
        bound = pa.array(self.worst.view(np.int64))
        return pa.RecordBatch.from_arrays([pa.array(self.row), *lists, leaves, bound], ["query", "scores", "ids", "rows", "need", "bound"])


RESULT = "query long, scores array<double>, ids array<long>, rows array<long>, need array<int>, bound long"


def _search(queries, blocks, space: Space, most: int, need: bool):
    own = Search(queries, space, most)
    for block in blocks:
        own.block(block)
    yield own.result(need)


def searched(table: DataFrame, nearest: int = NEAREST, step: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: the nearest rows of every row whose id `step` divides."""
    rows, dtype = V.rows_of(table)
    some = arrow_map(rows, _norms, "row long, vec_id long, v binary, squared double", dtype)
    some = some.filter("squared > 0 and squared < double('inf')")
    most = nearest + 1  # a query's own row is found too
    # Entries: vectors, each with its rows of the smallest ids.
    place = F.row_number().over(Window.partitionBy("v").orderBy("vec_id", "row"))
    few = some.withColumn("_place", place).filter(F.col("_place") <= most)
    entries = few.groupBy("v").agg(F.sort_array(F.collect_list(F.struct("vec_id", "row"))).alias("members"), F.max("squared").alias("squared"))
    entries = written(entries.select(F.col("members")[0]["row"].alias("row"), F.col("members")[0]["vec_id"].alias("vec_id"), "v", "members", "squared"), "entries")
    n, squared = entries.agg(F.count(F.lit(1)), F.max("squared")).first()
    width = V.width_of(entries, dtype)
    rng = np.random.default_rng(SEED)
    space = Space(width, dtype, math.sqrt(squared or 0.0), rng.standard_normal((width + 1, DIMENSIONS)))
    size = V.block_rows(width)
    depth = min(int(math.log2(LEAVES)), max(0, math.ceil(math.log2(max(1, n) / size))))
    sample = arrow_map(entries.select("v", "row").orderBy(F.xxhash64("row")).limit(SAMPLE).select("v"), _projected, "p binary", space).collect() if depth else []
    space.depth = depth
    space.split, space.cut = fitted(np.array([np.frombuffer(r.p) for r in sample]).reshape(-1, DIMENSIONS), depth)
    # Every entry goes to a leaf, and a leaf's entries are dealt into blocks.
    placed = written(arrow_map(entries.select("row", "vec_id", "v"), _placed, "row long, vec_id long, v binary, leaf int", space, False), "placed")
    counts = dict(placed.groupBy("leaf").count().collect())
    deal = F.array(*[F.lit(max(1, -(-counts.get(k, 0) // size))) for k in range(1 << depth)])
    dealt = placed.withColumn("block", F.pmod(F.xxhash64("row"), F.element_at(deal, F.col("leaf") + 1)).cast("int")).select("leaf", "block", "row", "vec_id", "v")
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(tasks, "leaf", "block").sortWithinPartitions("leaf", "block", "row")
    schema = "leaf int, block int, rows binary, ids binary, v binary, extra binary, low array<double>, high array<double>"
    blocks = written(arrow_map(dealt, _blocks, schema, space), "vector-blocks")
    space.boxes = np.full((1 << depth, 2, DIMENSIONS), np.nan)
    sides = [f(F.col(c)[d]) for c, f in (("low", F.min), ("high", F.max)) for d in range(DIMENSIONS)]
    for leaf, *ends in blocks.groupBy("leaf").agg(*sides).collect():
        space.boxes[leaf] = np.array(ends).reshape(2, DIMENSIONS)

    # Queries: vectors again, dealt to tiles by the leaf that they lie in.
    asking = some.filter(F.col("vec_id") % step == 0)
    classes = asking.groupBy("v").agg(F.min("row").alias("row"), F.count(F.lit(1)).alias("n"))
    classes = written(arrow_map(classes.select("row", F.col("n").alias("vec_id"), "v"), _placed, "row long, vec_id long, v binary, leaf int", space, True), "queries")
    per_leaf = dict(classes.groupBy("leaf").count().collect())
    spread = F.array(*[F.lit(max(1, -(-per_leaf.get(k, 0) // QUERIES))) for k in range(1 << depth)])
    asked = classes.withColumn("tile", F.col("leaf") + F.lit(1 << depth) * F.pmod(F.xxhash64("row"), F.element_at(spread, F.col("leaf") + 1))).drop("vec_id")
    tiles = asked.select("tile", "leaf").distinct()
    grp = F.pmod(F.xxhash64("leaf", "block"), F.lit(V.GROUPS)).cast("int")
    directory = blocks.select("leaf", "block")
    # First a block of the leaf itself, or of the first leaf where that has none.
    home = directory.filter("block = 0")
    first = tiles.join(home.withColumn("home", F.lit(True)), "leaf", "left").select("tile", F.when(F.col("home"), F.col("leaf")).otherwise(F.lit(min(counts, default=0))).alias("leaf"), F.lit(0).alias("block"))
    first = written(first, "first")

    def stream(queries: DataFrame, pairs: DataFrame, need: bool) -> DataFrame:
        theirs = V.stream_rows(pairs.join(blocks, ["leaf", "block"]).withColumn("kind", F.lit(1)))
        return V.streamed(V.stream_rows(queries.withColumn("kind", F.lit(0))), theirs, _search, RESULT, space, most, need)

    bounds = written(stream(asked.withColumn("grp", F.lit(0)), first.withColumn("grp", F.lit(0)), True), "bounds")
    # Then the blocks of all leaves that the test does not rule out.
    own = asked.join(bounds.select(F.col("query").alias("row"), "need", F.array("bound").alias("state")), "row")
    needs = own.select("tile", F.explode("need").alias("leaf")).distinct()
    pairs = needs.join(directory, "leaf").join(first, ["tile", "leaf", "block"], "left_anti").withColumn("grp", grp)
    groups = own.drop("need").withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(V.GROUPS - 1))))
    rest = stream(groups, pairs, False)

    hits = bounds.unionByName(rest).select("query", F.explode(F.arrays_zip("scores", "ids", "rows")).alias("hit")).select("query", F.col("hit.scores").alias("score"), F.col("hit.ids").alias("id"), F.col("hit.rows").alias("row"))
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id", "row"))
    best = hits.withColumn("_place", place).filter(F.col("_place") <= most)
    # Entries become rows again.
    near = best.join(entries.select("row", "members"), "row")
    ordered = F.flatten(F.collect_list(F.transform("members", lambda m: F.struct((-F.col("score")).alias("far"), m["vec_id"].alias("vec_id"), m["row"].alias("row")))))
    near = near.groupBy(F.col("query").alias("row")).agg(F.slice(F.sort_array(ordered), 1, most).alias("near"))
    answers = classes.select("row", "v", F.col("vec_id").alias("n")).join(near, "row").drop("row")
    # Back to the queries; vectors that many of them share are dealt over HOT tasks.
    total = classes.agg(F.sum("vec_id")).first()[0] or 0
    hot = answers.filter(F.col("n") > total / HOT).select("v").withColumn("hot", F.lit(True))
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("row"), F.lit(HOT))).otherwise(F.lit(0)).cast("int")
    queries = asking.join(F.broadcast(hot), "v", "left").select("row", F.col("vec_id").alias("query_id"), "v", salt.alias("salt"))
    salts = F.when(F.col("n") > total / HOT, F.lit(HOT - 1)).otherwise(F.lit(0))
    out = queries.join(answers.withColumn("salt", F.explode(F.sequence(F.lit(0), salts))), ["v", "salt"])
    others = F.slice(F.filter("near", lambda x: x["row"] != F.col("row")), 1, nearest)
    return out.select("query_id", F.posexplode(others).alias("at", "x")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.far")).alias("score"))


def op11(spark, sf_dir: str) -> DataFrame:
    return searched(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


#: What an exact search returns; the search here finds nearly all of it.
EXACT_SQL = f"""
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0)
SELECT q.vec_id AS query_id, CAST(row_number() OVER w AS INTEGER) AS rank, v.vec_id, list_inner_product(q.e, v.e) AS score
FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0
WINDOW w AS (PARTITION BY q.vec_id ORDER BY list_inner_product(q.e, v.e) DESC, v.vec_id)
QUALIFY row_number() OVER w <= {NEAREST}
"""
