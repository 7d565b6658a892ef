"""Exact substring dedup by prefix-free parsing: suffix arrays of dictionary and parse give corpus order.

1. The first parse. A rolling hash marks triggers: of every GAP neighbouring positions the one with the least hash of
   SEED bytes. All windows of `length` bytes whose first GAP positions have the same trigger make a span. Equal windows
   stand at the same place of spans with the same core, the bytes that all windows of a trigger share. Spans are dealt
   by their core: one that occurs twice is covered whole, one whose core occurs once has no repeated window. What is
   left are places whose core is shared by different spans.
2. Cores with more than HOT such places are parsed again with a smaller gap, in rounds, until no core is hot: windows
   that leave the shared text get cores of their own and drop out.
3. The second parse. The spans of some whole cores at a time are cut at triggers into short phrases. The dictionary of
   distinct phrases gets a suffix array, the parse (each span as the ranks of its phrases) another; together they put
   all windows into the order of the corpus, and windows that agree with a neighbour, byte by byte, repeat.
4. All of it gives intervals, which are joined with the texts. Where shorter windows were looked for before, longer ones
   are looked for only in their intervals: all parts of a repeated window repeat.

Hashes only choose what is compared, but in step 1, where spans are equal if their core's and their own hash agree, 128
bits of two different functions. Rows of a core or span that a third of all texts hold are sent once by each task and
pack: further spans of a core that a pack has already sent are not dealt by core but go straight on to step 2.

Defined cases: null and empty texts keep nothing and lose nothing (the hash is that of no bytes); texts shorter
than a window are left as they are; repeated rows repeat each other and lose all their windows; very long texts
are parsed in pieces; an empty table gives an empty result; extra columns are ignored by `removed`, kept by `stage`.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import Rolling, arrow_map, bytes_of, chunks, fresh, mix, power_pair, release, written

LENGTH = 400
#: Positions that share a trigger, and the bytes that the rolling hash covers.
GAP, SEED = 160, 16
#: Places of a core that are ordered together at most, and the parts into which each span of a hotter core is cut.
HOT, PARTS = 2048, 8
#: Text bytes that are parsed at once, spans that a task gathers before it deals them out, span bytes that are ordered at once.
PIECE, PACK, ORDERED = 1 << 19, 1 << 18, 1 << 20
#: Bytes of the second parse's triggers, one of so many positions.
SHORT, EVERY = 8, 16
#: Passages: bytes of a window, positions that share a trigger, and the words that a removed passage exceeds.
PASSAGE, PASSAGE_GAP, PASSAGE_WORDS = 200, 80, 50

_PLACE = np.uint64((1 << 23) - 1)
PACKED = "kind int, bucket int, core binary, phrase binary, key binary, lo binary, size binary, many binary, several binary"
#: kind 0: bytes lo to hi of a text repeat; kind 1: windows lo to hi have a core that other spans have too.
FOUND = "kind int, core long, key long, lo int, hi int"
_TYPES = (np.uint64, np.uint64, np.int64, np.int32, np.int16, np.bool_, np.bool_)


def _rolling(raw: np.ndarray) -> Rolling:
    return Rolling(raw, *power_pair(len(raw) + 1))


def _pieces(raw: np.ndarray, at: np.ndarray, length: int):
    """(bytes, text starts, base): slices of one text longer than PIECE overlap by a window."""
    if len(at) == 2 and len(raw) > PIECE + length:
        for base in range(0, len(raw) - length + 1, PIECE):
            part = raw[base : base + PIECE + length - 1]
            yield part, np.array([0, len(part)]), base
    else:
        yield raw, at, 0


def _segments(raw: np.ndarray, at: np.ndarray, los: list, his: list, length: int):
    """(bytes, segment starts, row and first place of each segment): the bytes of wanted windows alone, about PIECE at a time.

    los, his: for each text the first and last windows to parse. Those that meet are one segment, long ones several.
    """
    row = np.repeat(np.arange(len(los)), [len(x) for x in los])
    lo = np.maximum(np.concatenate([np.zeros(0, np.int64), *los]).astype(np.int64), 0)
    hi = np.minimum(np.concatenate([np.zeros(0, np.int64), *his]).astype(np.int64), np.diff(at)[row] - length)
    row, lo, hi = (x[lo <= hi] for x in (row, lo, hi))
    if not len(row):
        return
    order = np.lexsort((lo, row))
    lo, hi = (x[order] + at[row[order]] for x in (lo, hi))
    row = row[order]
    first = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (lo[1:] > np.maximum.accumulate(hi)[:-1] + 1)]))
    row, lo, hi = row[first], lo[first], np.maximum.reduceat(hi, first)
    parts = (hi - lo) // PIECE + 1
    nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    row, lo, hi = (np.repeat(x, parts) for x in (row, lo, hi))
    lo += nth * PIECE
    hi = np.minimum(hi, lo + PIECE - 1)
    sizes = hi - lo + length
    data = memoryview(np.ascontiguousarray(raw))
    start, ends = 0, np.cumsum(sizes)
    while start < len(lo):
        stop = max(start + 1, int(np.searchsorted(ends, ends[start] - sizes[start] + PIECE, side="right")))
        part = np.frombuffer(b"".join([data[a : a + n] for a, n in zip(lo[start:stop].tolist(), sizes[start:stop].tolist(), strict=True)]), np.uint8)
        yield part, np.concatenate([[0], np.cumsum(sizes[start:stop])]), row[start:stop], lo[start:stop] - at[row[start:stop]]
        start = stop


def _spans(raw: np.ndarray, at: np.ndarray, length: int, gap: int) -> tuple[np.ndarray, ...]:
    """The spans of texts laid end to end: core, hash of the bytes, text, first and last window of each."""
    n = len(raw) - SEED + 1
    none = np.zeros(0, np.int64)
    empty = none.view(np.uint64), none.view(np.uint64), none, none, none
    gap = min(gap, length - SEED + 1)
    if n < gap:
        return empty
    rolling = _rolling(raw)
    least = (rolling.each(SEED) & ~_PLACE) | np.arange(n, dtype=np.uint64)
    width = 1
    while 2 * width <= gap:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if gap > width:
        least = np.minimum(least[: len(least) - gap + width], least[gap - width :])
    begins = np.concatenate([[True], least[1:] != least[:-1]])
    begins[at[:-1][at[:-1] < len(least)]] = True
    lo = np.flatnonzero(begins)
    text = np.searchsorted(at, lo, side="right") - 1
    hi = np.minimum(np.append(lo[1:], len(least)) - 1, at[text + 1] - length)
    lo, hi, text = (x[lo <= hi] for x in (lo, hi, text))
    if not len(lo):
        return empty
    trigger = (least[lo] & _PLACE).astype(np.int64)
    core = rolling.spans(trigger, trigger + length - gap + 1)
    data = memoryview(np.ascontiguousarray(raw))
    own = np.fromiter((xxhash.xxh3_64_intdigest(data[a:b]) for a, b in zip(lo.tolist(), (hi + length).tolist(), strict=True)), np.uint64, len(lo))
    return core, own, text, lo - at[text], hi - at[text]


def _deal(core, phrase, key, lo, size, buckets: int):
    """Packed rows: each core once (kind 0), with marks if its span, or other spans of it, occur here too; places of
    spans that have occurred here (kind 1); the first places of a core's further spans (kind 2)."""
    order = np.lexsort((phrase, core))
    core, phrase, key, lo, size = core[order], phrase[order], key[order], lo[order], size[order]
    new_core = np.concatenate([[True], core[1:] != core[:-1]])
    first = new_core | np.concatenate([[True], phrase[1:] != phrase[:-1]])
    many = (np.diff(np.append(np.flatnonzero(first), len(core))) > 1)[np.cumsum(first) - 1]
    group = np.cumsum(new_core) - 1
    several = (np.bincount(group, weights=first) > 1)[group]
    further = first & ~new_core
    # A further span that occurred more often here repeats, and goes on as a partner all the same.
    at = np.concatenate([np.flatnonzero(new_core), np.flatnonzero(~first | (further & many)), np.flatnonzero(further)])
    kind = np.repeat([0, 1, 2], [new_core.sum(), (~first | (further & many)).sum(), further.sum()])
    bucket = (np.where(kind == 0, core[at], key[at].view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
    both = bucket * 3 + kind
    order = np.argsort(both, kind="stable")
    at = at[order]
    names, starts = np.unique(both[order], return_index=True)
    columns = [np.asarray(a, t)[at] for a, t in zip((core, phrase, key, lo, size, many, several), _TYPES, strict=True)]
    ends = np.append(starts[1:], len(at)).tolist()
    pack = [pa.array([c[a:b].tobytes() for a, b in zip(starts.tolist(), ends, strict=True)], pa.binary()) for c in columns]
    return pa.RecordBatch.from_arrays([pa.array(names % 3, pa.int32()), pa.array(names // 3, pa.int32()), *pack], ["kind", "bucket", "core", "phrase", "key", "lo", "size", "many", "several"])


def _parse(batches, length: int, gap: int, buckets: int, some: bool):
    """The spans of (key, text) rows; with `some`, of the windows that the lists los and his name."""
    held, n = [], 0
    for batch in batches:
        for part in chunks(batch, "text", PIECE):
            keys = part.column(0).to_numpy(zero_copy_only=False)
            if some:
                pieces = _segments(*bytes_of(part.column(1)), part.column(2).to_pylist(), part.column(3).to_pylist(), length)
            else:
                pieces = ((raw, at, np.arange(len(at) - 1), np.full(len(at) - 1, base)) for raw, at, base in _pieces(*bytes_of(part.column(1)), length))
            for raw, at, row, base in pieces:
                core, phrase, text, lo, hi = _spans(raw, at, length, gap)
                if len(core):
                    held.append((core, phrase, keys[row[text]], lo + base[text], hi - lo))
                    n += len(core)
                if n >= PACK:
                    yield _deal(*(np.concatenate(x) for x in zip(*held, strict=True)), buckets)
                    held, n = [], 0
    if held:
        yield _deal(*(np.concatenate(x) for x in zip(*held, strict=True)), buckets)


def _found(kind: int, core, key, lo, hi):
    """Rows of FOUND, some thousand at a time."""
    for k in range(0, len(key), 1 << 16):
        s = slice(k, k + (1 << 16))
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key[s]), kind, np.int32)), pa.array(core[s].view(np.int64)), pa.array(key[s]), pa.array(lo[s].astype(np.int32)), pa.array(hi[s].astype(np.int32))], ["kind", "core", "key", "lo", "hi"])


def _settled(held, length: int):
    """A bucket's spans: those that occur twice, and one place of each span of a core that has several."""
    core, phrase, key, lo, size, many, several = (np.frombuffer(b"".join(x[k] for x in held), t) for k, t in enumerate(_TYPES))
    order = np.lexsort((phrase, core))
    core, phrase, key, lo, size, many, several = (a[order] for a in (core, phrase, key, lo, size, many, several))
    new_core = np.concatenate([[True], core[1:] != core[:-1]])
    new = new_core | np.concatenate([[True], phrase[1:] != phrase[:-1]])
    at = np.flatnonzero(new)
    twice = (np.diff(np.append(at, len(core))) > 1) | np.maximum.reduceat(many, at)
    done = twice[np.cumsum(new) - 1]
    yield from _found(0, core[done], key[done], lo[done], lo[done] + size[done] + length)
    group = np.cumsum(new_core) - 1
    spans = np.bincount(group[at])
    other = np.maximum.reduceat(several, np.flatnonzero(new_core))
    single = np.bincount(group[at], weights=~twice) > 0
    goes = at[(other | ((spans > 1) & single))[group[at]]]
    yield from _found(1, core[goes], key[goes], lo[goes], lo[goes] + size[goes])


def _repeats(batches, length: int):
    now, held = None, []
    for batch in batches:
        for kind, bucket, *arrays in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if kind:
                core, _, key, lo, size = (np.frombuffer(arrays[k], _TYPES[k]) for k in range(5))
                yield from _found(kind - 1, core, key, lo, lo + size + (length if kind == 1 else 0))
                continue
            if bucket != now and held:
                yield from _settled(held, length)
                held = []
            now = bucket
            held.append(arrays)
    if held:
        yield from _settled(held, length)


def _ranks(key: np.ndarray) -> np.ndarray:
    """The rank of each value among the distinct ones."""
    order = np.argsort(key)
    own = key[order]
    out = np.empty(len(key), np.int64)
    out[order] = np.cumsum(np.concatenate([[0], own[1:] != own[:-1]]))
    return out


def _suffix_ranks(rank: np.ndarray, rest: np.ndarray, depth: int) -> np.ndarray:
    """The order of suffixes by prefix doubling. rank: order by the first `depth` symbols; rest: symbols to a suffix's end.

    A suffix that ends comes before those that go on; equal suffixes have equal ranks. A rank is the number of
    suffixes that are less, so a round moves only those that are not told apart yet and have symbols left.
    """
    counts = np.bincount(rank)
    open_ = np.flatnonzero((counts > 1)[rank])
    rank = (np.cumsum(counts) - counts)[rank]
    while len(open_):
        follows = np.zeros(len(open_), np.int64)
        inner = np.flatnonzero(rest[open_] > depth)
        follows[inner] = rank[open_[inner] + depth] + 1
        key = rank[open_] * (len(rank) + 1) + follows
        order = np.argsort(key)
        open_, key = open_[order], key[order]
        group = rank[open_]
        begins = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        sizes = np.diff(np.append(begins, len(key)))
        outer = np.maximum.accumulate(np.where(np.concatenate([[True], group[1:] != group[:-1]]), np.arange(len(key)), 0))
        rank[open_] = group + np.repeat(begins, sizes) - outer
        depth *= 2
        open_ = open_[np.repeat((sizes > 1) & (np.maximum.reduceat(rest[open_], begins) > depth), sizes)]
    return rank


def _words(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position, as numbers in byte order; zeros follow the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray(len(data) + 1, ">u8", padded, strides=(1,)).astype(np.uint64)


def repeated(spans: list[bytes], length: int) -> list[np.ndarray]:
    """For each span, which of its windows (by start) stand anywhere else in these spans."""
    flags, windows = _repeated(spans, length)
    return np.split(flags, np.cumsum(windows)[:-1])


def _repeated(spans: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """The flags of all windows, span after span, and the windows of each span.

    Spans are cut at triggers into phrases, each ending with the next trigger; the last ends with the span. As no
    suffix of a phrase that is longer than a trigger is the beginning of another, windows are in order when sorted by
    what is left of their phrase, in the dictionary's suffix array, and then by what follows, in the parse's.
    """
    raw = np.frombuffer(b"".join(spans), np.uint8)
    sizes = np.array([len(x) for x in spans])
    ends = np.cumsum(sizes)
    starts = ends - sizes
    words = _words(raw)
    trigger = np.flatnonzero(mix(words[:-1]) % np.uint64(EVERY) == 0)
    span = np.searchsorted(ends, trigger, side="right")
    trigger = trigger[trigger + SHORT <= ends[span]]
    cut = np.zeros(len(raw), bool)
    cut[trigger] = cut[starts[sizes > 0]] = True
    begin = np.flatnonzero(cut)  # of each phrase of the parse
    span = np.searchsorted(ends, begin, side="right")
    last = np.append(span[1:] != span[:-1], True)
    stop = np.where(last, ends[span], np.append(begin[1:], 0) + SHORT)

    data = raw.tobytes()
    numbers: dict[bytes, int] = {}
    phrase = np.array([numbers.setdefault(data[a:b], len(numbers)) for a, b in zip(begin.tolist(), stop.tolist(), strict=True)])
    lengths = np.array([len(x) for x in numbers])
    ahead = np.concatenate([[0], np.cumsum(lengths)])
    dictionary = np.frombuffer(b"".join(numbers), np.uint8)
    rest = np.repeat(ahead[1:], lengths) - np.arange(len(dictionary))
    shown = np.minimum(rest, 8)
    first = _words(dictionary)[:-1] >> (8 * (8 - shown)).astype(np.uint64) << (8 * (8 - shown)).astype(np.uint64)
    rank = _ranks(first)
    some = np.empty(len(rank), np.int64)
    some[rank] = shown
    if np.any(some[rank] != shown):  # a suffix that ends looks like one that goes on with zeros
        rank = _ranks(rank * 9 + shown)
    suffix = _suffix_ranks(rank, rest, 8)

    left = np.searchsorted(begin, ends[span], side="left") - np.arange(len(begin))  # phrases to the span's end
    follows = _suffix_ranks(_ranks(suffix[ahead[phrase]]), left, 1)
    follows = np.where(last, 0, np.append(follows[1:], 0) + 1)

    windows = np.maximum(sizes - length + 1, 0)
    where = np.repeat(starts - np.concatenate([[0], np.cumsum(windows)[:-1]]), windows) + np.arange(windows.sum())
    own = np.searchsorted(begin, where, side="right") - 1
    key = suffix[ahead[phrase[own]] + where - begin[own]] * (len(begin) + 1) + follows[own]
    order = np.argsort(key)
    a, b = where[order[:-1]], where[order[1:]]
    same = np.arange(len(a))
    for k in [*range(0, length - 8, 8), length - 8]:
        same = same[words[a[same] + k] == words[b[same] + k]]
    out = np.zeros(len(where), bool)
    out[order[same]] = True
    out[order[same + 1]] = True
    return out, windows


def _cut_spans(batches, length: int):
    """A row for each wanted span: core, key, place and bytes."""
    for batch in batches:
        for part in chunks(batch, "text", PIECE):
            raw, at = bytes_of(part.column(1))
            data = raw.tobytes()
            cores, keys, places, spans = [], [], [], []
            for k, (key, los, his, own) in enumerate(zip(*(part.column(c).to_pylist() for c in (0, 2, 3, 4)), strict=True)):
                cores += own
                keys += [key] * len(los)
                places += los
                spans += [data[at[k] + a : at[k] + b + length] for a, b in zip(los, his, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(cores, pa.int64()), pa.array(keys, pa.int64()), pa.array(places, pa.int32()), pa.array(spans, pa.binary())], ["core", "key", "lo", "span"])


def _ordered(batches, length: int):
    """The repeated windows of spans that come sorted by core, some whole cores at a time."""

    def done(held):
        flags, windows = _repeated([x[2] for x in held], length)
        starts = np.cumsum(windows) - windows
        first = np.zeros(len(flags) + 1, bool)
        first[starts] = first[-1] = True
        before = np.concatenate([[False], flags[:-1]])
        begins = np.flatnonzero(flags & (first[:-1] | ~before))
        stops = np.flatnonzero(flags & (first[1:] | ~np.append(flags[1:], False)))
        span = np.repeat(np.arange(len(held)), windows)[begins]
        shift = np.array([x[1] for x in held])[span] - starts[span]
        key = np.array([x[0] for x in held], np.int64)[span]
        yield from _found(0, np.zeros(len(key), np.int64), key, begins + shift, stops + shift + length)

    now, held, size = None, [], 0
    for batch in batches:
        for core, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if core != now and size >= ORDERED:
                yield from done(held)
                held, size = [], 0
            now = core
            held.append(row)
            size += len(row[2])
    if held:
        yield from done(held)


def _by_key(batches, merge: bool):
    """A row for each key: its intervals in order, with those that meet made one if `merge`, else with their cores.

    Rows come sorted by key; the last key of what has come waits for the next batch.
    """

    def rows(key, lo, hi, core):
        order = np.lexsort((lo, key))
        key, lo, hi, core = key[order], lo[order], hi[order], core[order]
        if merge:
            first = np.concatenate([[True], key[1:] != key[:-1]])
            # Rising ends within a key: keys are told apart by an offset beyond any end.
            number = np.cumsum(first) - 1
            span = int(hi.max()) + 1
            reach = np.maximum.accumulate(hi + number * span) - number * span
            at = np.flatnonzero(first | np.concatenate([[True], lo[1:] > reach[:-1]]))
            key, lo, hi = key[at], lo[at], np.maximum.reduceat(hi, at)
        at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        ends = np.append(at, len(key)).astype(np.int32)
        lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int64())) for x in ((lo, hi) if merge else (lo, hi, core))]
        return pa.RecordBatch.from_arrays([pa.array(key[at]), *lists], ["key", "los", "his", *([] if merge else ["cores"])])

    held, n = [], 0
    for batch in batches:
        held.append(tuple(batch.column(k).to_numpy().astype(np.int64) for k in range(4)))
        n += batch.num_rows
        if n >= 1 << 16:
            now = [np.concatenate(x) for x in zip(*held, strict=True)]
            cut = int(np.searchsorted(now[0], now[0][-1]))
            if cut:
                yield rows(*(x[:cut] for x in now))
            held = [tuple(x[cut:] for x in now)]
            n = len(held[0][0])
    if held:
        yield rows(*(np.concatenate(x) for x in zip(*held, strict=True)))


def _listed(found: DataFrame, merge: bool) -> DataFrame:
    rows = found.select("key", "lo", "hi", "core").repartition("key").sortWithinPartitions("key")
    return arrow_map(rows, _by_key, "key long, los array<long>, his array<long>" + ("" if merge else ", cores array<long>"), merge)


def repeats(docs: DataFrame, length: int = LENGTH, gap: int = GAP, within: DataFrame | None = None) -> DataFrame:
    """(key, los, his): the merged byte intervals of each text of docs (key, text) that repeat anywhere.

    within: such intervals of windows that are no longer, outside which nothing repeats.
    """
    spark = docs.sparkSession
    buckets = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))

    def parse(rows: DataFrame, gap: int, some: bool) -> tuple[DataFrame, DataFrame]:
        """What repeats, and what goes on."""
        packed = arrow_map(rows, _parse, PACKED, length, gap, buckets, some).repartition(buckets, "bucket").sortWithinPartitions("bucket")
        out = written(arrow_map(packed, _repeats, FOUND, length), "parse")
        release(spark)
        return out.filter("kind = 0"), out.filter("kind = 1")

    def texts(places: DataFrame) -> DataFrame:
        # A row that stands twice sends its windows twice; all of them repeat.
        return docs.join(_listed(places, False), "key").select("key", "text", "los", "his", "cores")

    if within is None:
        done, open_ = parse(docs, gap, False)
    else:
        wide = within.select("key", F.expr(f"filter(arrays_zip(los, his), x -> x.his - x.los >= {length})").alias("wide")).filter("size(wide) > 0")
        windows = wide.select("key", F.col("wide.los").alias("los"), F.expr(f"transform(wide.his, x -> x - {length})").alias("his"))
        docs = written(docs.join(windows, "key").select("key", "text", "los", "his"), "wide")
        release(spark)
        done, open_ = parse(docs, gap, True)
        docs = docs.select("key", "text")
    cold = []
    while True:
        hot = written(open_.groupBy("core").agg(F.count(F.lit(1)).alias("places")).filter(F.col("places") > HOT).select("core"), "hot")
        if gap == 1 or hot.isEmpty():
            cold.append(open_)
            break
        cold.append(open_.join(hot, "core", "left_anti"))
        gap = max(1, gap // PARTS)
        more, open_ = parse(texts(open_.join(hot, "core", "left_semi")), gap, True)
        done = done.unionByName(more)
    places = cold[0]
    for more in cold[1:]:
        places = places.unionByName(more)
    spans = arrow_map(texts(places), _cut_spans, "core long, key long, lo int, span binary", length)
    # By a number: few bytes are much work, so parts are not to be put together by their bytes.
    ordered = written(arrow_map(spans.repartition(buckets, "core").sortWithinPartitions("core"), _ordered, FOUND, length), "ordered")
    release(spark)
    return _listed(done.unionByName(ordered), True)


def _without(data: bytes, los: list | None, his: list | None, words: int = -1) -> bytes:
    """The bytes that are left when the intervals of more than so many words are cut."""
    long = [(a, b) for a, b in zip(los or (), his or (), strict=True) if words < 0 or len(data[a:b].split()) > words]
    if not long:
        return data
    los, his = zip(*long, strict=True)
    return b"".join(data[a:b] for a, b in zip([0, *his], [*los, len(data)], strict=True))


def _cut(batches, words: int | None):
    for batch in batches:
        for part in chunks(batch, "text", PIECE):
            raw, at = bytes_of(part.column(1))
            raw = raw.tobytes()
            sizes, gone, spans, digests, kept = [], [], [], [], []
            for k, (los, his) in enumerate(zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)):
                data = raw[at[k] : at[k + 1]]
                left = _without(data, los, his)
                sizes.append(len(data))
                gone.append(len(data) - len(left))
                spans.append(len(los or ()))
                digests.append(hashlib.sha256(left).hexdigest())
                kept.append(left.decode("utf-8", "ignore"))
            out = [part.column(0), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.int64()), pa.array(digests, pa.string()), pa.array(kept, pa.string())]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text"]
            if words is not None:
                lists = zip(part.column(4).to_pylist(), part.column(5).to_pylist(), strict=True)
                texts = [_without(raw[at[k] : at[k + 1]], los, his, words).decode("utf-8", "ignore") for k, (los, his) in enumerate(lists)]
                out.append(pa.array(texts, pa.string()))
                names.append("text_without_passages")
            yield pa.RecordBatch.from_arrays(out, names)


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.xxhash64("doc_id", "text").alias("key"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def removed(docs: DataFrame, length: int = LENGTH, passages: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row, and the text that is left.

    The text lacks what a cut leaves of a split character; the hash is of all bytes. With `passages`, also
    text_without_passages: the whole text but for the passages of more than PASSAGE_WORDS words that `stage` removes.
    """
    rows = _keyed(docs)
    texts = rows.select("key", "text")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text string"
    if not passages:
        found = rows.join(repeats(texts, length), "key", "left").select("doc_id", "text", "los", "his")
        return arrow_map(found, _cut, schema, None)
    short = written(repeats(texts, PASSAGE, PASSAGE_GAP), "passages")
    release(docs.sparkSession)
    long = repeats(texts, length, within=short if length >= PASSAGE else None)
    both = long.join(short.toDF("key", "short_los", "short_his"), "key", "full")
    found = rows.join(both, "key", "left").select("doc_id", "text", "los", "his", "short_los", "short_his")
    return arrow_map(found, _cut, schema + ", text_without_passages string", PASSAGE_WORDS)


def op1(spark, sf_dir: str) -> DataFrame:
    return removed(spark.read.parquet(f"{sf_dir}/documents.parquet"), passages=True)


def _rewritten(batches, place: int, chars: int | None, words: int):
    """Texts without their passages of more than so many words."""
    for batch in batches:
        for part in chunks(batch, "text", PIECE):
            columns = list(part.columns)
            texts = []
            for text, los, his in zip(columns[place].to_pylist(), columns[-2].to_pylist(), columns[-1].to_pylist(), strict=True):
                texts.append(text if text is None or not los else _without(text.encode(), los, his, words).decode("utf-8", "ignore"))
            columns[place] = pa.array(texts, pa.string())
            if chars is not None:
                columns[chars] = pa.array([None if t is None else len(t) for t in texts], columns[chars].type)
            yield pa.RecordBatch.from_arrays(columns[:-2], part.schema.names[:-2])


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages of more than PASSAGE_WORDS words that repeat; n_chars follows the text."""
    columns = docs.columns
    key, los, his = (fresh(x, docs) for x in ("_key", "_los", "_his"))
    keyed = docs.withColumn(key, F.xxhash64("doc_id", "text"))
    found = repeats(keyed.select(F.col(key).alias("key"), "text"), PASSAGE, PASSAGE_GAP).toDF(key, los, his)
    rows = keyed.join(found, key, "left").select(*(F.col(f"`{c}`") for c in columns), los, his)
    place, chars = columns.index("text"), columns.index("n_chars") if "n_chars" in columns else None
    return arrow_map(rows, _rewritten, docs.schema, place, chars, PASSAGE_WORDS)
