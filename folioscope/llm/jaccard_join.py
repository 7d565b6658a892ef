"""N-gram Jaccard join with token-group matrices.

Documents with equal shingle sets are one class. Two classes can only reach the threshold if they share a token of
their prefixes (the first n - ceil(0.75 n) + 1 tokens of a set in a common order, rare tokens first), so:

1. All tokens are dealt into buckets in packed arrays, and the buckets answer to each class which of its tokens other
   classes have too, and how many have them: that is the order. Tokens of a single class come first and need no list,
   so a class with enough of them drops out here. Prefixes are dealt again, and a bucket lists the classes that share
   a token, each with the number of its tokens before that: two classes whose first common token it is can share no
   more than what follows.
2. Every class is first held against one center, the smallest class that any of its lists has. Those that link
   form groups of similar documents.
3. What then still lies in different groups of one list is a query and a group. A group's members are stored in
   blocks, each with the union of its tokens and a matrix of which member holds which. A query's overlap with any
   member is bounded twice, by counts of tokens per column of CELLS columns (a block's counts are the most of any
   member) before any set is moved, then by its tokens in the union; only blocks that can qualify are opened.

Every pair that shares a prefix token is thus verified exactly or already connected; links lead to components by
min-label propagation with pointer jumping. Copies are never paired; a hot center's queries are salted.

Defined cases: null texts and texts without words have an empty set, n_shingles 0, and link with nothing; texts of
one to four words have one shingle; repeated rows are one class; an empty table gives an empty result; extra
columns are ignored; long texts are read whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import BASE, Rolling, arrow_map, bytes_of, chunks, drop_written, fresh, mix, power_pair, release, written

WORDS, PERCENT = 5, 75
#: Members of a group's block; queries of a center that one task is given.
BLOCK, QUERIES = 64, 1000
#: Rounds of stars go on while more than this share of their pairs link.
JOINED = 0.25
#: Columns in which tokens are counted for the first bound, and the most tokens of a set for which it is used.
CELLS, COUNTED = 1024, 100_000
#: Tokens that a task gathers before it deals them out.
PACK = 1 << 20

_STEP = [np.uint64(pow(BASE, 7 * k + 3, 1 << 64)) for k in range(WORDS)]


def shingle_sets(column) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    raw, at = bytes_of(column)
    n = len(at) - 1
    if not len(raw):
        return [np.zeros(0, np.uint64)] * n
    low = np.where((raw >= 0x41) & (raw <= 0x5A), raw + 0x20, raw).astype(np.uint8)
    word = ~((low == 0x20) | ((low >= 0x09) & (low <= 0x0D)))
    begins, ends = word.copy(), word.copy()
    begins[1:] &= ~word[:-1]
    ends[:-1] &= ~word[1:]
    edges = at[1:-1][(at[1:-1] > 0) & (at[1:-1] < len(raw))]
    begins[edges] |= word[edges]
    ends[edges - 1] |= word[edges - 1]
    start, stop = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    first = np.searchsorted(start, at)
    hashes = Rolling(low, *power_pair(len(low) + 1)).spans(start, stop)
    size = max(0, len(hashes) - WORDS + 1)
    with np.errstate(over="ignore"):
        joined = np.zeros(size, np.uint64)
        for k in range(WORDS):
            joined += hashes[k : size + k] * _STEP[k]
    joined = mix(joined)
    out = []
    for k in range(n):
        a, b = first[k], first[k + 1]
        if b - a >= WORDS:
            own = np.sort(joined[a : b - WORDS + 1])
            out.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
        elif b > a:
            with np.errstate(over="ignore"):
                total = np.uint64(b - a)
                for j in range(a, b):
                    total += hashes[j] * _STEP[j - a]
            out.append(mix(np.array([total], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def class_of(tokens: np.ndarray) -> np.int64:
    """Names a set: 64 bits, always used together with its size."""
    import xxhash

    return np.uint64(xxhash.xxh3_64_intdigest(tokens.tobytes())).view(np.int64)


def need(n: int) -> int:
    """The least overlap of a set of n tokens with any that it links with."""
    return -(-PERCENT * n // 100)


def _classes(batches):
    for batch in batches:
        for part in chunks(batch, "text", 1 << 20):
            sets = shingle_sets(part.column(1))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array([class_of(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int32())], ["key", "doc_id", "ref", "n"])


def _rows(bucket: np.ndarray, buckets: int):
    """An order by bucket that keeps what is in it in order; the buckets that have anything, and where each begins."""
    order = np.argsort(bucket.astype(np.uint16 if buckets <= 1 << 16 else np.int64), kind="stable")
    own = bucket[order]
    starts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    return order, own[starts], np.append(starts, len(own))


def _packed(names, starts, columns) -> list[pa.Array]:
    """For each bucket the bytes of its part of each column."""
    pairs = list(zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True))
    return [pa.array([c[a:b].tobytes() for a, b in pairs], pa.binary()) for c in columns]


def _by_class(bucket: np.ndarray, buckets: int, entries: tuple, owner: np.ndarray, table: tuple):
    """Packed rows: the entries of a bucket in order of their classes, and each class once with its number of entries.

    owner: the class of each entry, as an index, rising; table: what is told of each class.
    """
    order, names, starts = _rows(bucket, buckets)
    owner = owner[order]
    new = np.concatenate([[True], owner[1:] != owner[:-1]])
    new[starts[:-1]] = True
    first = np.flatnonzero(new)
    counts = np.diff(np.append(first, len(owner))).astype(np.int32)
    told = [np.asarray(c)[owner[first]] for c in table]
    return names, [*_packed(names, starts, [e[order] for e in entries]), *_packed(names, np.searchsorted(first, starts), [*told, counts])]


_TABLE = (np.int64, np.int32, np.int32, np.int32)
TOKENS = "bucket int, tokens binary, refs binary, sizes binary, places binary, counts binary"
SHARED = "bucket int, source int, tokens binary, often binary, refs binary, sizes binary, places binary, counts binary"
PREFIXES = "bucket int, tokens binary, refs binary, sizes binary, positions binary"
LISTS = "list long, ref long, n int, pos int"


def _tokens(batches, buckets: int):
    """The tokens of each class, dealt by what a bucket's count leaves of their hash; a token there is its upper half.

    Two tokens of a bucket with the same upper half count as one, in a place of their class's order.
    """
    seen, sets, refs, held = set(), [], [], 0

    def dealt():
        token = np.concatenate(sets)
        sizes = np.array([len(x) for x in sets], np.int32)
        owner = np.repeat(np.arange(len(sets)), sizes)
        bucket = (token % np.uint64(buckets)).astype(np.int64)
        upper = (token >> np.uint64(32)).astype(np.uint32)
        # Sets are in the order of their hashes: equal upper halves follow one another.
        same = np.zeros(len(token), bool)
        near = np.flatnonzero((upper[1:] == upper[:-1]) & (owner[1:] == owner[:-1])) + 1
        for k in near.tolist():
            j = k - 1
            while j >= 0 and upper[j] == upper[k] and owner[j] == owner[k]:
                same[k] |= bucket[j] == bucket[k]
                j -= 1
        places = (sizes - np.bincount(owner, weights=same, minlength=len(sets))).astype(np.int32)
        keep = ~same
        names, columns = _by_class(bucket[keep], buckets, (upper[keep],), owner[keep], (np.array(refs, np.int64), sizes, places))
        return pa.RecordBatch.from_arrays([pa.array(names.astype(np.int32)), *columns], ["bucket", "tokens", "refs", "sizes", "places", "counts"])

    for batch in batches:
        for part in chunks(batch, "text", 1 << 20):
            for own in shingle_sets(part.column(1)):
                if len(own) and (ref := int(class_of(own))) not in seen:
                    seen.add(ref)
                    sets.append(own)
                    refs.append(ref)
                    held += len(own)
            if held >= PACK:
                yield dealt()
                sets, refs, held = [], [], 0
    if sets:
        yield dealt()


def _buckets(batches):
    """(bucket, columns) of each bucket; the rows of a bucket follow one another."""
    now, held = None, []
    for batch in batches:
        for bucket, *packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if bucket != now and held:
                yield now, list(zip(*held, strict=True))
                held = []
            now = bucket
            held.append(packed)
    if held:
        yield now, list(zip(*held, strict=True))


def _array(packed, kind) -> np.ndarray:
    return np.frombuffer(b"".join(packed), kind)


def often(counts: np.ndarray) -> np.ndarray:
    """How many classes have a token, in eighths of a power of two."""
    return np.minimum(np.round(8 * np.log2(counts)), 255).astype(np.uint8)


def _shared(batches, buckets: int):
    """Answers to the classes: which of their tokens others have too, and how many do."""
    for source, (tokens, *table) in _buckets(batches):
        token = _array(tokens, np.uint32)
        ref, size, place, counts = (_array(x, t) for x, t in zip(table, _TABLE, strict=True))
        owner = np.repeat(np.arange(len(ref)), counts)
        order = np.lexsort((ref[owner], token))
        token, owner = token[order], owner[order]
        new = np.concatenate([[True], token[1:] != token[:-1]])
        keep = new | np.concatenate([[True], ref[owner[1:]] != ref[owner[:-1]]])
        token, owner, new = token[keep], owner[keep], new[keep]
        have = np.diff(np.append(np.flatnonzero(new), len(token)))
        many = np.repeat(have > 1, have)
        if not many.any():
            continue
        token, owner, share = token[many], owner[many], often(np.repeat(have, have)[many])
        order = np.argsort(ref[owner], kind="stable")
        token, owner, share = token[order], owner[order], share[order]
        # A class that several tasks have dealt has several numbers here: one of them stands for all.
        own = ref[owner]
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        number = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(own))))
        table = tuple(c[owner[first]] for c in (ref, size, place))
        to = (mix(own.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
        names, columns = _by_class(to, buckets, (token, share), number, table)
        yield pa.RecordBatch.from_arrays([pa.array(names.astype(np.int32)), pa.array(np.full(len(names), source, np.int32)), *columns], ["bucket", "source", "tokens", "often", "refs", "sizes", "places", "counts"])


def _prefixes(batches, buckets: int):
    """The prefix of each class: tokens that no other class has come first and are left out, then the rarest."""
    for _, (source, tokens, shares, *table) in _buckets(batches):
        token, share = _array(tokens, np.uint32), _array(shares, np.uint8)
        ref, size, place, counts = (_array(x, t) for x, t in zip(table, _TABLE, strict=True))
        bucket = np.repeat(np.array(source, np.int64), [len(x) // 4 for x in tokens])
        owner = np.repeat(np.arange(len(ref)), counts)
        order = np.lexsort((token, bucket, share, ref[owner]))
        token, bucket, owner = token[order], bucket[order], owner[order]
        own = ref[owner]
        first = np.concatenate([[True], own[1:] != own[:-1]])
        starts = np.flatnonzero(first)
        lengths = np.diff(np.append(starts, len(own)))
        rank = np.arange(len(own)) - np.repeat(starts, lengths)
        n = size[owner].astype(np.int64)
        pos = place[owner] - np.repeat(lengths, lengths) + rank
        keep = pos <= n + (-PERCENT * n // 100)
        token, bucket, own, n, pos = token[keep], bucket[keep], own[keep], n[keep], pos[keep]
        if not len(own):
            continue
        order, names, starts = _rows(bucket, buckets)
        columns = _packed(names, starts, [token[order], own[order], n[order].astype(np.int32), pos[order].astype(np.int32)])
        yield pa.RecordBatch.from_arrays([pa.array(names.astype(np.int32)), *columns], ["bucket", "tokens", "refs", "sizes", "positions"])


def _lists(batches):
    """The distinct lists of classes that share a token: a row for each member, with the list's name and the tokens before it."""
    for _, columns in _buckets(batches):
        token, ref, size, pos = (_array(x, t) for x, t in zip(columns, (np.uint32, np.int64, np.int32, np.int32), strict=True))
        order = np.lexsort((ref, token))
        token, ref, size, pos = token[order], ref[order], size[order], pos[order]
        starts = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        lengths = np.diff(np.append(starts, len(token)))
        many = lengths > 1
        starts, lengths = starts[many], lengths[many]
        total = np.concatenate([[np.uint64(0)], np.cumsum(mix(ref.view(np.uint64)))])
        with np.errstate(over="ignore"):
            names = mix(total[starts + lengths] - total[starts] + lengths.astype(np.uint64))
        # Of the tokens that the same classes share the first in the order of tokens stands for all.
        order = np.lexsort((pos[starts], names))
        names, first = np.unique(names[order], return_index=True)
        if not len(names):
            continue
        starts, lengths = starts[order][first], lengths[order][first]
        at = np.repeat(starts - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names.view(np.int64), lengths)), pa.array(ref[at]), pa.array(size[at]), pa.array(pos[at])], ["list", "ref", "n", "pos"])


def counted(tokens: np.ndarray) -> bytes:
    """Tokens per column; a set too large to count takes any."""
    if len(tokens) > COUNTED:
        return np.full(CELLS, 255, np.uint8).tobytes()
    return np.minimum(np.bincount((tokens >> np.uint64(40)).astype(np.int64) % CELLS, minlength=CELLS), 255).astype(np.uint8).tobytes()


def _sets(batches, cells: bool):
    """ref and n with the counts, or with the tokens, of each class."""
    seen = set()  # rows that stand twice come to the same task
    name, make = ("cells", counted) if cells else ("tokens", np.ndarray.tobytes)
    for batch in batches:
        for part in chunks(batch, "text", 1 << 20):
            refs = part.column(0).to_pylist()
            some = [k for k, r in enumerate(refs) if not (r in seen or seen.add(r))]
            sets = shingle_sets(part.column(1).take(pa.array(some, pa.int64())))
            yield pa.RecordBatch.from_arrays([pa.array([refs[k] for k in some], pa.int64()), pa.array([len(s) for s in sets], pa.int32()), pa.array([make(s) for s in sets], pa.binary())], ["ref", "n", name])


def _block_counts(batches):
    """The most of any member in each column, and the least size; rows come sorted by group and block."""
    now, most, least = None, None, 0
    for batch in batches:
        for group, block, n, cells in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            own = np.frombuffer(cells, np.uint8)
            if (group, block) == now:
                most, least = np.maximum(most, own), min(least, n)
                continue
            if now is not None:
                yield _block_row(now, most, least)
            now, most, least = (group, block), own, n
    if now is not None:
        yield _block_row(now, most, least)


def _block_row(now, most, least):
    return pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int64()), pa.array([now[1]], pa.int32()), pa.array([least], pa.int32()), pa.array([most.tobytes()], pa.binary())], ["g", "block", "least", "most"])


def _bounded(batches):
    """The (g, block, ref) of queries whose counts allow an overlap that links."""
    for batch in batches:
        cells, most = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, CELLS) for k in (4, 6))
        n, least = (batch.column(k).to_numpy().astype(np.int64) for k in (3, 5))
        # A count of 255 stands for any: where both sides have it, the column bounds nothing.
        top = np.minimum(cells, most)
        top = np.where((top == 255).any(1), 1 << 40, top.sum(1, dtype=np.int64))
        # 100 * i >= 75 * (n + m - i) for a member of m tokens, and m is `least` or more.
        good = ((100 + PERCENT) * top >= PERCENT * (n + least)) & (100 * top >= PERCENT * n)
        yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(good)) for k in range(3)], ["g", "block", "ref"])


def _qualified(asked: DataFrame, members: DataFrame, counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of asked (g, block, ref) what the counts allow, and the members (g, block, ref) of the blocks it opens."""
    blocks = members.join(asked.select("g", "block").distinct(), ["g", "block"], "left_semi").join(counts, "ref").select("g", "block", "n", "cells")
    blocks = arrow_map(blocks.repartition("g", "block").sortWithinPartitions("g", "block"), _block_counts, "g long, block int, least int, most binary")
    rows = asked.join(counts, "ref").join(blocks, ["g", "block"]).select("g", "block", "ref", "n", "cells", "least", "most")
    good = written(arrow_map(rows, _bounded, "g long, block int, ref long"), "asked")
    return good, members.join(good.select("g", "block").distinct(), ["g", "block"], "left_semi").select("g", "block", "ref")


def _matched(batches):
    """A link of each query (role 1) to a member (role 0) of its block, if any; rows come sorted by block and role."""
    now, members, names, table, out = None, [], [], None, []
    for batch in batches:
        for group, block, role, ref, tokens in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (group, block) != now:
                now, members, names, table = (group, block), [], [], None
            own = np.frombuffer(tokens, np.uint64)
            if role == 0:
                members.append(own)
                names.append(ref)
                continue
            if not members:
                raise ValueError("a query came without its block")
            if table is None:
                # The token-group matrix: the union of the block's tokens, and for each the members that hold it.
                every, owner = np.concatenate(members), np.repeat(np.arange(len(members)), [len(m) for m in members])
                order = np.argsort(every, kind="stable")
                every, owner = every[order], owner[order]
                first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
                table = every[first], np.append(first, len(every)), owner, np.array([len(m) for m in members])
            union, first, owner, sizes = table
            spot = np.minimum(np.searchsorted(union, own), len(union) - 1)
            spot = spot[union[spot] == own]
            if len(spot) < need(len(own)):
                continue
            lengths = first[spot + 1] - first[spot]
            at = np.repeat(first[spot] - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())
            shared = np.bincount(owner[at], minlength=len(sizes))
            found = np.flatnonzero(100 * shared >= PERCENT * (sizes + len(own) - shared))
            if len(found):  # a block's members are connected already
                out.append((ref, names[found[0]]))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], ["a", "b"])
            out = []


def _links(asked: DataFrame, members: DataFrame, texts: DataFrame) -> DataFrame:
    """The links between queries and members of their blocks, both (g, block, ref), as (a, b).

    texts: (ref, text) of the classes that take part, whose sets are made again from it.
    """
    work = members.withColumn("role", F.lit(0)).unionByName(asked.withColumn("role", F.lit(1)))
    sets = written(arrow_map(texts, _sets, "ref long, n int, tokens binary", False), "sets")
    rows = work.join(sets.select("ref", "tokens"), "ref").select("g", "block", "role", "ref", "tokens")
    out = written(arrow_map(rows.repartition("g", "block").sortWithinPartitions("g", "block", "role"), _matched, "a long, b long").distinct(), "links")
    drop_written(sets)
    return out


def components(edges: DataFrame) -> DataFrame:
    """(ref, comp): the smallest ref reachable by edges (a, b), for every ref of an edge. Distributed min labels."""
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    labels = written(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("ref"), F.least("a", "b").alias("comp")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("ref", "b"), "b").groupBy(F.col("a").alias("ref")).agg(F.min("comp").alias("near"))
        better = labels.join(near, "ref").select("ref", "comp", F.least("comp", "near").alias("next"))
        jump = labels.select(F.col("ref").alias("next"), F.col("comp").alias("far"))
        after = written(better.join(jump, "next").select("ref", F.least("next", "far").alias("comp"), (F.least("next", "far") != F.col("comp")).alias("moved")), "labels")
        done = after.filter("moved").limit(1).count() == 0
        drop_written(labels)
        labels = after.select("ref", "comp")
        labels.scratch_path = after.scratch_path
        if done:
            drop_written(both)
            return labels


def _spread(lists: DataFrame, groups: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The members (g, block, ref) of all groups; the rows of lists that span groups; each list's largest group."""
    member = lists.select("ref").distinct().join(groups, "ref", "left").select("ref", F.coalesce("comp", "ref").alias("g"))
    sizes = member.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    member = written(member.join(sizes, "g").select("g", F.pmod(F.xxhash64("ref"), F.col("blocks")).cast("int").alias("block"), "ref"), "members")
    spread = lists.join(member, "ref")
    open_lists = spread.groupBy("list").agg(F.min("g").alias("lo"), F.max("g").alias("hi")).filter("lo < hi").select("list")
    spread = written(spread.join(open_lists, "list", "left_semi"), "spread")
    parts = spread.groupBy("list", "g").agg(F.count(F.lit(1)).alias("k"), F.min(F.struct("ref", "block", "n", "pos")).alias("at"))
    largest = parts.groupBy("list").agg(F.max_by(F.struct("g", "at"), F.struct("k", "g")).alias("to"))
    return member, spread, largest.select("list", F.col("to.g").alias("largest"), F.col("to.at.block").alias("to_block"), F.col("to.at.n").alias("to_n"), F.col("to.at.pos").alias("to_pos"))


def _stars(spread: DataFrame, largest: DataFrame) -> DataFrame:
    """(g, block, ref): each class outside of its list's largest group, with a block of that; two blocks a class."""
    rows = spread.join(largest, "list").filter((F.col("g") != F.col("largest")) & _fits(F.col("n"), F.col("pos"), F.col("to_n"), F.col("to_pos")))
    to = F.struct(F.col("largest").alias("g"), F.col("to_block").alias("block"))
    best = rows.groupBy("ref").agg(F.min(to).alias("lo"), F.max(to).alias("hi"))
    return best.select("ref", F.explode(F.array("lo", "hi")).alias("to")).select("to.g", "to.block", "ref").distinct()


def _across(spread: DataFrame, largest: DataFrame) -> DataFrame:
    """(g, block, ref): every class of a list with each block of another group that the list has.

    The query is the class outside of its list's largest group; between two such groups, of the smaller one.
    """
    query = spread.join(largest, "list").filter("g <> largest").select("list", F.col("ref").alias("q"), F.col("g").alias("qg"), F.col("n").alias("qn"), (F.col("n") - F.col("pos")).alias("left"), "largest")
    blocks = spread.groupBy("list", "g", "block").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.max(F.col("n") - F.col("pos")).alias("most"))
    near = (100 * F.col("hi") >= PERCENT * F.col("qn")) & (100 * F.col("qn") >= PERCENT * F.col("lo"))
    near &= (100 + PERCENT) * F.least("left", "most").cast("long") >= PERCENT * (F.col("qn") + F.col("lo")).cast("long")
    pairs = query.join(blocks, "list").filter((F.col("g") != F.col("qg")) & ((F.col("g") == F.col("largest")) | (F.col("qg") < F.col("g"))) & near)
    return pairs.select("g", "block", F.col("q").alias("ref")).distinct()


def _fits(n, pos, m, other):
    """Whether sets of n and m tokens of which pos and other come before the first common one can share enough."""
    return (100 + PERCENT) * F.least(n - pos, m - other).cast("long") >= PERCENT * (n + m).cast("long")


def _connected(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, doc_id, ref, n) of every row; ref, n, comp of each class, with its smallest id and its first row's key.

    The first row is the one with the smallest id, by key where ids repeat; rows without an id come last.
    """
    spark = docs.sparkSession
    docs = docs.select(F.xxhash64("doc_id", "text").alias("key"), "text", F.col("doc_id").cast("long").alias("doc_id"))
    rows = written(arrow_map(docs, _classes, "key long, doc_id long, ref long, n int"), "classes")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def dealt(rows: DataFrame, make, out: str, *args) -> DataFrame:
        return arrow_map(rows.repartition(buckets, "bucket").sortWithinPartitions("bucket"), make, out, *args)

    shared = written(dealt(arrow_map(docs, _tokens, TOKENS, buckets), _shared, SHARED, buckets), "shared")
    release(spark)
    found = dealt(dealt(shared, _prefixes, PREFIXES, buckets), _lists, LISTS)
    lists = written(found.groupBy("list", "ref").agg(F.min("n").alias("n"), F.min("pos").alias("pos")), "lists")
    drop_written(shared)
    release(spark)
    # One text of each class that is in a list; its set is made again from the text.
    at = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("at")
    first = rows.filter("n > 0").groupBy("ref", "n").agg(F.min("doc_id").alias("doc_id"), F.min("key").alias("key"), at)
    wanted = first.join(lists.select("ref").distinct(), "ref", "left_semi").select("key", "ref")
    counts = written(arrow_map(docs.select("key", "text").join(wanted, "key").select("ref", "text"), _sets, "ref long, n int, cells binary", True), "counts")
    release(spark)

    def links(asked: DataFrame, members: DataFrame) -> DataFrame:
        """Verified links; only the texts of classes that take part are moved."""
        refs = asked.select("ref").unionByName(members.select("ref")).distinct()
        return _links(asked, members, docs.select("key", "text").join(wanted.join(refs, "ref", "left_semi"), "key").select("ref", "text"))

    # One center for each class: the smallest class of its lists that is not too long or too short for it.
    heads = lists.groupBy("list").agg(F.min_by(F.struct("ref", "n", "pos"), "ref").alias("head"))
    tried = written(
        lists.join(heads, "list").filter((F.col("ref") != F.col("head.ref")) & _fits(F.col("n"), F.col("pos"), F.col("head.n"), F.col("head.pos"))).groupBy("ref").agg(F.min("head.ref").alias("center")),
        "centers",
    )
    # The first bound is by pair here: a center is a block without salt. Salts follow, for what is left.
    pairs = tried.select(F.col("center").alias("g"), F.lit(0).alias("block"), "ref")
    centers = tried.select(F.col("center").alias("g"), F.lit(0).alias("block"), F.col("center").alias("ref")).distinct()
    close, _ = _qualified(pairs, centers, counts)
    salts = close.groupBy("g").count().select("g", F.ceil(F.col("count") / QUERIES).cast("int").alias("salts"))
    asked = close.select("g", "ref").join(salts, "g").select("g", F.pmod(F.xxhash64("ref"), F.col("salts")).cast("int").alias("block"), "ref")
    held = salts.select("g", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("block"), F.col("g").alias("ref"))
    near = links(asked, held)
    release(spark)

    # Groups are the components so far. In rounds, each class tries the largest groups of its lists, which joins what
    # belongs together with a pair for each class; when a round joins little, what still spans groups is tried in full.
    stars = True
    while stars is not None:
        groups = components(near)
        member, spread, largest = _spread(lists, groups)
        pairs = _stars(spread, largest) if stars else _across(spread, largest)
        asked, opened = _qualified(pairs, member, counts)
        new = links(asked, opened)
        stars = None if not stars else new.count() > JOINED * asked.count()
        # What is connected already is kept as one edge for each class.
        near = groups.select(F.col("ref").alias("a"), F.col("comp").alias("b")).unionByName(new)
        drop_written(spread)
        release(spark)
    found = components(near)
    for done in (lists, counts, tried):
        drop_written(done)
    return rows, first.join(found, "ref", "left").select("ref", "n", "doc_id", "at", F.coalesce("comp", "ref").alias("comp"))


def joined(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    rows, named = _connected(docs)
    lowest = named.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    named = named.join(lowest, "comp").select("ref", "n", "component_id")
    return rows.join(named, ["ref", "n"], "left").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def op3(spark, sf_dir: str) -> DataFrame:
    return joined(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component stays: of the smallest id, or without an id where no row has one.

    Rows are known by a hash of id and text; of rows that have both in common one stays, whatever their number. Rows
    without words are components of their own, so all of them stay.
    """
    rows, named = _connected(docs)
    best = named.groupBy("comp").agg(F.min("at").alias("at")).select(F.col("at.key").alias("key"))
    found = rows.groupBy("key").agg(F.max("n").alias("n"), F.count(F.lit(1)).alias("copies"))
    alone = found.filter("n = 0").select("key", F.lit(False).alias("many"))
    kept = written(found.filter("n > 0").join(best, "key", "left_semi").select("key", (F.col("copies") > 1).alias("many")).unionByName(alone), "kept")
    key = fresh("_row", docs)
    keyed = docs.withColumn(key, F.xxhash64("doc_id", "text"))
    of = lambda many: keyed.join(kept.filter(F.col("many") == many).select(F.col("key").alias(key)), key, "left_semi")
    once = of(False).select(*docs.columns)
    if kept.filter("many").limit(1).count() == 0:
        return once
    # Repeated rows may differ in other columns: the least of them stays, found in each task before rows are moved.
    rest = F.to_json(F.struct(F.lit(0).alias("_"), *[c for c in docs.columns if c not in ("doc_id", "text")]))
    repeated = of(True).groupBy(key).agg(F.min_by(F.struct(*docs.columns), rest).alias(key + "s"))
    return once.unionByName(repeated.select(key + "s.*"))
