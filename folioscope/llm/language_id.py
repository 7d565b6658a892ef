"""Language identification with one bit-sliced Bloom filter for all languages.

A table entry is a mask of languages; an n-gram's mask is the AND of its entries under each hash, so one lookup
names all languages that hold the n-gram. A document is decided by its hits per language (popcounts of bit
columns), corrected for the false positives that each language's filling implies.

Training: n-grams of a bounded sample, TRAIN_DOCS documents a language in expectation, are counted on the
executors; the KEEP most frequent of each language go into the filter.

Defined cases: null texts and texts without a letter are "und" with score 0; ties go to the first language in
alphabetical order; with nothing to learn from, every text is "und"; repeated rows are decided alike; extra
columns are ignored; long texts are read whole.
"""

from __future__ import annotations

import sys
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.common import arrow_map, chunks, mix

GRAM = 4
TRAIN_DOCS, KEEP = 2000, 20_000
#: Entries of the filter (a power of two) and hashes of an n-gram.
ENTRIES, HASHES = 1 << 19, 2
_FACTORS = mix(np.arange(11, 11 + GRAM, dtype=np.uint64))
_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(sys.maxunicode + 1)), bool))
    return _LETTER[0]


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all n-grams, the text of each (ascending), and which texts have a letter.

    Texts are lower-cased; each run of other characters counts as one space; GRAM - 1 marks precede a text.
    """
    pad = "\0" * (GRAM - 1)
    joined = "".join(pad + (t or "").replace("\0", " ").lower() for t in texts) + "\0"
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    letter, mark = _letters()[codes], codes == 0
    keep = letter | mark
    keep[1:] |= letter[:-1]
    codes = np.where(letter, codes, np.where(mark, 0, 32))[keep].astype(np.uint64)
    begins = codes == 0
    text = np.cumsum(begins) // (GRAM - 1) - 1
    n = len(codes) - GRAM + 1
    with np.errstate(over="ignore"):
        out = codes[:n] * _FACTORS[0]
        for k in range(1, GRAM):
            out = out + codes[k : n + k] * _FACTORS[k]
    good = ~begins[GRAM - 1 :]
    own = text[GRAM - 1 :][good]
    has = np.bincount(text[:-1][codes[:-1] > 32], minlength=len(texts))[: len(texts)] > 0
    return mix(out[good]), own, has


def _count(batches):
    for batch in batches:
        for part in chunks(batch, "text", 2 << 20):
            langs = part.column(2).to_pylist()
            found, own, _ = grams(part.column(1).to_pylist())
            names = sorted(set(langs))
            number = np.array([names.index(x) for x in langs])[own]
            for k, name in enumerate(names):
                values, counts = np.unique(found[number == k], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(values), pa.string()), pa.array(values.view(np.int64)), pa.array(counts, pa.int64())], ["lang", "gram", "n"])


class Filter:
    def __init__(self, langs: list[str], members: dict[str, np.ndarray]):
        self.langs = langs
        self.slices = np.zeros((-(-max(1, len(langs)) // 64), ENTRIES), np.uint64)
        for k, lang in enumerate(langs):
            for at in self.places(members[lang]):
                self.slices[k // 64][at] |= np.uint64(1 << (k % 64))
        filled = [np.count_nonzero(self.slices[k // 64] >> np.uint64(k % 64) & np.uint64(1)) / ENTRIES for k in range(len(langs))]
        self.false = np.array([f**HASHES for f in filled])

    @staticmethod
    def places(found: np.ndarray) -> list[np.ndarray]:
        return [(found >> np.uint64(20 * k) & np.uint64(ENTRIES - 1)).astype(np.int64) for k in range(HASHES)]

    def decide(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        found, own, has = grams(texts)
        n = np.maximum(np.bincount(own, minlength=len(texts)), 1)
        share = np.zeros((len(texts), len(self.langs)))
        places = self.places(found)
        for word, table in enumerate(self.slices):
            masks = table[places[0]]
            for at in places[1:]:
                masks &= table[at]
            for k in range(64 * word, min(64 * word + 64, len(self.langs))):
                hits = np.bincount(own, weights=masks >> np.uint64(k % 64) & np.uint64(1), minlength=len(texts))
                share[:, k] = np.clip((hits / n - self.false[k]) / (1 - self.false[k]), 0, 1)
        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts))
        best, total = share.argmax(1), share.sum(1)
        score = np.where(has & (total > 0), share.max(1) / np.maximum(total, 1e-12), 0.0)
        return [self.langs[b] if h else "und" for b, h in zip(best, has, strict=True)], score


def train(docs: DataFrame) -> Filter:
    """The filter, from rows (text, lang) to learn from; what reaches the driver is KEEP n-grams a language."""
    rows = docs.filter("lang is not null and text is not null")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return Filter([], {})
    share = F.lit(0.0)
    for lang, n in sizes.items():
        share = F.when(F.col("lang") == lang, min(1.0, TRAIN_DOCS / n)).otherwise(share)
    some = rows.filter(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < share * (1 << 30)).select("doc_id", "text", "lang")
    counts = arrow_map(some, _count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    top = counts.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).filter(F.col("place") <= KEEP)
    members: dict[str, list[int]] = {k: [] for k in sizes}
    for lang, gram in top.select("lang", "gram").toPandas().itertuples(index=False):
        members[lang].append(gram)
    return Filter(sorted(sizes), {k: np.array(v, np.int64).view(np.uint64) for k, v in members.items()})


def _decide(batches, model: Filter):
    for batch in batches:
        for part in chunks(batch, "text", 1 << 20):
            langs, scores = model.decide(part.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])


def predicted(docs: DataFrame, model: Filter) -> DataFrame:
    """doc_id, lang_pred, score of every row; only the text is looked at."""
    return arrow_map(docs.select("doc_id", "text"), _decide, "doc_id long, lang_pred string, score double", model)


def op6(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    out = predicted(docs, train(docs.filter(~held)))
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score")
