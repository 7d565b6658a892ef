"""Phrase collocations by level-wise passes over the texts.

Pass k counts phrases of k words. A phrase is counted only where both of its parts of k - 1 words are frequent: what is
frequent of the pass before goes to the tasks as a bitmap of a fixed number of bits, so it never grows with the
table; a bit that two phrases share lets some phrase through that its exact count then drops. Tasks count some megabytes of
text at a time and send each phrase once, with its count, which Spark sums before and after the shuffle. Scores need
only the tables of frequent phrases, as parts are at least as frequent as the whole.

Defined cases: null and empty texts have no words; a null lang is `und`, together with rows that say so; repeated rows
count each time; an empty table gives an empty result; extra columns are ignored; texts are counted whole.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.common import Rolling, arrow_map, bytes_of, drop_written, mix, power_pair, written

#: Fixed values of the contract: words of a phrase, its least count, scores as parts of so many, the share of a longer phrase that hides it.
LONGEST, LEAST, SCALE, HIDDEN, TOP = 4, 30, 2_000_000, 80, 2000
#: Bits of the bitmap of frequent phrases (8 MB); bytes of text that a task counts at once.
BITS, TEXT = 1 << 26, 8 << 20

#: What a byte is: 0 part of a word, 1 white space within a piece, 2 an end of a piece.
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def hashes(words: pa.Array) -> np.ndarray:
    data, at = bytes_of(words)
    return Rolling(data, *power_pair(len(data))).spans(at[:-1], at[1:])


def extended(so_far: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of a phrase with a word more; it begins with its language's."""
    with np.errstate(over="ignore"):
        return mix(so_far * np.uint64(0x9E3779B97F4A7C15) + word)


def grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first place of each distinct key, the number of each place's key, and how often each occurs."""
    own, distinct = pd.factorize(keys)
    where = np.empty(len(distinct), np.int64)
    where[own[::-1]] = np.arange(len(keys) - 1, -1, -1)
    return where, own, np.bincount(own, minlength=len(distinct))


class Words:
    """The words of some texts in order, each with its text's language and its piece."""

    def __init__(self, texts: pa.Array, langs: pa.Array):
        data, at = bytes_of(texts)
        kind = _KIND[data]
        word = kind == 0
        first = np.zeros(len(data) + 1, bool)
        first[at] = True
        start = np.flatnonzero(word & (first[:-1] | ~np.append(False, word[:-1])))
        stop = np.flatnonzero(word & (first[1:] | ~np.append(word[1:], False))) + 1
        text = np.searchsorted(at, start, side="right") - 1
        # Both grow from text to text and from piece to piece, so equal sums are the same piece of the same text.
        self.piece = np.cumsum(kind == 2)[start] + text if len(start) else np.zeros(0, np.int64)
        ends = np.append(0, np.cumsum(stop - start)).astype(np.int32)
        words = pa.Array.from_buffers(pa.string(), len(start), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(_LOWER[data[word]].tobytes())]).dictionary_encode()
        self.number, self.vocabulary = words.indices.to_numpy().astype(np.int64), words.dictionary
        codes = langs.dictionary_encode()
        self.lang, self.langs = codes.indices.to_numpy()[text] if len(start) else np.zeros(0, np.int64), codes.dictionary

    def keys(self, places: np.ndarray, size: int) -> pa.Array:
        """lang, a tab and the words of the phrases that start at these places."""
        parts = [self.vocabulary.take(pa.array(self.number[places + j])) for j in range(size)]
        phrase = pc.binary_join_element_wise(*parts, " ") if size > 1 else parts[0]
        return pc.binary_join_element_wise(self.langs.take(pa.array(self.lang[places])), phrase, "\t")


def frequent(found: np.ndarray, bits: np.ndarray) -> np.ndarray:
    at = found & np.uint64(8 * len(bits) - 1)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def counts_of(texts: pa.Array, langs: pa.Array, size: int, maps: list[np.ndarray]) -> tuple[pa.Array, np.ndarray]:
    """The phrases of `size` words and their counts; maps: the frequent phrases of each smaller size, as bitmaps."""
    words = Words(texts, langs)
    n = len(words.number)
    if size > 1:
        by_word, by_lang = hashes(words.vocabulary), hashes(words.langs)
    # The number of the phrase of so many words at each place, -1 if a piece ends before or a part is not frequent.
    at = words.lang * max(1, len(words.vocabulary)) + words.number
    places, many = np.arange(n), len(words.langs) * max(1, len(words.vocabulary))
    for k in range(1, size + 1):
        if k > 1:
            places = np.flatnonzero((at[:-1] >= 0) & (at[1:] >= 0) & (words.piece[: max(0, n - 1)] == words.piece[1:]))
            at = at[places] * many + at[places + 1]
        where, own, counts = grouped(at)
        first, many = places[where], len(where)
        if k == size:
            return words.keys(first, k), counts
        found = by_lang[words.lang[first]]
        for j in range(k):
            found = extended(found, by_word[words.number[first + j]])
        ok = frequent(found, maps[k - 1])
        at = np.full(n, -1, np.int64)
        at[places] = np.where(ok[own], own, -1)
    raise ValueError(size)


def _count(batches, size: int, maps: list, most: int):
    bitmaps = [np.frombuffer(m.value, np.uint8) for m in maps]
    held, n = [], 0

    def out():
        table = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        keys, counts = counts_of(table.column(0), table.column(1), size, bitmaps)
        counts = counts.astype(np.int64)
        for k in range(0, len(keys), 1 << 16):
            yield pa.RecordBatch.from_arrays([keys.slice(k, 1 << 16), pa.array(counts[k : k + (1 << 16)])], ["key", "f"])

    for batch in batches:
        held.append(batch)
        n += batch.nbytes
        if n >= most:
            yield from out()
            held, n = [], 0
    if held:
        yield from out()


def _positions(batches, bits: int):
    for batch in batches:
        keys = batch.column(0).to_pylist()
        lang, words = zip(*(k.rsplit("\t", 1) for k in keys), strict=True)
        found, parts = hashes(pa.array(lang)), [w.split(" ") for w in words]
        for j in range(max(map(len, parts))):
            some = np.array([k for k, w in enumerate(parts) if len(w) > j])
            found[some] = extended(found[some], hashes(pa.array([parts[k][j] for k in some.tolist()])))
        yield pa.RecordBatch.from_arrays([pa.array((found & np.uint64(bits - 1)).astype(np.int64) + 1)], ["at"])


def bitmap(table: DataFrame) -> bytes:
    """The keys of a table of frequent phrases as bits, of a size that no table sets."""
    at = arrow_map(table.select("key"), _positions, "at long", BITS)
    rows = at.groupBy(F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits")).collect()
    out = np.zeros(BITS // 8, np.uint8)
    for bucket, bits in rows:
        out[(bucket - 1) * len(bits) : bucket * len(bits)] = np.frombuffer(bits, np.uint8)
    return out.tobytes()


def phrase_of(key: Column) -> Column:
    return F.substring_index(key, "\t", -1)


def levels(docs: DataFrame, longest: int = LONGEST, least: int = LEAST) -> tuple[list[DataFrame], DataFrame]:
    """(key, f) of the frequent phrases of each size, written; and (lang, n) of all words."""
    texts = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))
    context = docs.sparkSession.sparkContext
    found, maps, words = [], [], None
    for size in range(1, longest + 1):
        counted = arrow_map(texts, _count, "key string, f long", size, list(maps), TEXT).groupBy("key").agg(F.sum("f").alias("f"))
        if size == 1:
            every = written(counted, "words")
            words = written(every.groupBy(_lang_of(F.col("key")).alias("lang")).agg(F.sum("f").alias("n")), "totals")
            found.append(written(every.filter(F.col("f") >= least), "phrases"))
            drop_written(every)
        else:
            found.append(written(counted.filter(F.col("f") >= least), "phrases"))
        if size < longest:
            maps.append(context.broadcast(bitmap(found[-1])))
    return found, words


def _lang_of(key: Column) -> Column:
    return F.substring(key, F.lit(1), F.length(key) - F.length(phrase_of(key)) - 1)


def ranked(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the first phrases of each language."""
    found, words = levels(docs, longest, least)
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    candidates = found[1]
    for more in found[2:]:
        candidates = candidates.unionByName(more)
    candidates = candidates.select("key", F.col("f").alias("a"), _lang_of(F.col("key")).alias("lang"), phrase_of(F.col("key")).alias("phrase"))
    parts = candidates.withColumn("w", F.split("phrase", " "))
    part = lambda first, size: F.concat_ws("\t", "lang", F.array_join(F.slice("w", first, size), " "))
    # The counts of both parts of every cut.
    cuts = parts.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("w") - 1)))
    cuts = cuts.select("key", "a", "k", part(F.lit(1), F.col("k")).alias("left"), part(F.col("k") + 1, F.size("w") - F.col("k")).alias("right"))
    left, right = every.select(F.col("key").alias("left"), F.col("f").alias("l")), every.select(F.col("key").alias("right"), F.col("f").alias("r"))
    score = F.expr(f"(cast(a as decimal(20,0)) * {SCALE}) div (cast(l as decimal(20,0)) + r)")
    cuts = cuts.join(left, "left").join(right, "right").withColumn("score", score)
    lowest = cuts.groupBy("key").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    # The most frequent longer phrase that has a candidate's words within it.
    size = F.size("w")
    inner = parts.filter(size > 2).withColumn("s", F.explode(F.sequence(F.lit(2), size - 1))).withColumn("at", F.explode(F.sequence(F.lit(1), size - F.col("s") + 1)))
    longer = inner.select(part(F.col("at"), F.col("s")).alias("key"), F.col("a").alias("f")).groupBy("key").agg(F.max("f").alias("longer"))
    shown = candidates.join(longer, "key", "left").filter(F.expr(f"longer is null or cast(longer as decimal(20,0)) * 100 < cast(a as decimal(20,0)) * {HIDDEN}"))
    shown = shown.join(lowest, "key").select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    first = shown.withColumn("rank", rank).filter(F.col("rank") <= top)
    return first.join(words, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13(spark, sf_dir: str) -> DataFrame:
    return ranked(spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "lang"))


_UPPER, _LOW = "".join(map(chr, range(65, 91))), "".join(map(chr, range(97, 123)))
_GRAMS = " UNION ALL ".join(
    f"SELECT lang, {k} AS size, {" || ' ' || ".join(f'w[i + {j}]' for j in range(k))} AS phrase FROM (SELECT *, unnest(range(1, len(w) - {k - 2})) AS i FROM pieces)" for k in range(1, LONGEST + 1)
)
ORACLE_SQL = rf"""
WITH split AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOW}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
pieces AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM split),
f AS (SELECT lang, size, phrase, count(*) AS f FROM ({_GRAMS}) GROUP BY ALL),
total AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE size = 1 GROUP BY lang),
c AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE size > 1 AND f >= {LEAST}),
cut AS (SELECT *, array_to_string(w[1:k], ' ') AS first_, array_to_string(w[k + 1:size], ' ') AS rest FROM (SELECT *, unnest(range(1, size)) AS k FROM c)),
scored AS (SELECT cut.lang, cut.phrase, cut.a, k, x.f AS l, y.f AS r, CAST((CAST(a AS HUGEINT) * {SCALE}) // (CAST(x.f AS HUGEINT) + y.f) AS BIGINT) AS score
  FROM cut JOIN f x ON x.lang = cut.lang AND x.phrase = first_ AND x.size = k JOIN f y ON y.lang = cut.lang AND y.phrase = rest AND y.size = cut.size - k),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_ AS (SELECT lang, array_to_string(w[p:p + s - 1], ' ') AS phrase, max(a) AS longer
  FROM (SELECT *, unnest(range(1, size - s + 2)) AS p FROM (SELECT *, unnest(range(2, size)) AS s FROM c WHERE size > 2)) GROUP BY ALL),
shown AS (SELECT lowest.* FROM lowest LEFT JOIN inner_ USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < {HIDDEN} * a)
SELECT lang, CAST(row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS BIGINT) AS rank, phrase, a, l, r, n, score
FROM shown JOIN total USING (lang) QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= {TOP}
"""
