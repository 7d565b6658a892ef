"""Benchmark decontamination by latent semantic retrieval.

Documents are cut into overlapping passages, twice as long as the longest benchmark item and half of that apart, so
that any occurrence of an item lies within one passage. Passages are TF-IDF vectors over the benchmark's words
(other words cannot add to a product with an item); IDF is counted over all documents. A distributed randomised
SVD gives the latent space: each task adds its passages' share of Y = A'A R for a random matrix R, the shares are
summed by parts of the terms, and from Y and R alone the right singular vectors and singular values of A follow (the
single-pass form for A'A: with L the Cholesky factor of R'Y, Y/L' has the vectors on its left and the values, once more
squared, in its middle). A also has the items' own rows, with as much weight as all passages together, so that an item
which is seldom copied keeps a direction. A passage and an item are a candidate pair if their cosine in that space
reaches COSINE; candidates are then verified by the longest common subsequence of their words and by the item's answer,
its last words. Items are searched in blocks, each with a space of its own that has a dimension for each item and
OVERSAMPLE more; some blocks share a pass over the documents.

Defined cases: null and empty texts and items match nothing; items repeated under other ids each match; several
occurrences in one document are one row with the best; an empty table gives an empty result; extra columns are
ignored; long texts are read whole.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import arrow_map, fresh
from folioscope.llm.license_scan import Words, _hashes, _slices, _tables, firsts_of

#: Words in a larger share of the documents carry no weight, but for each item's rarest words.
MAX_DF, RAREST = 0.02, 8
COSINE = 0.3
#: Shares of an item's words, in order, that must be found: alone, or with so much of the answer.
LCS_ALONE, LCS_WITH_ANSWER, ANSWER = 0.8, 0.6, 0.6
ANSWER_WORDS = 5
#: Dimensions beyond one for each item; items of a block, and their distinct words (a longer item is a block of its own);
#: blocks that share a pass; singular values below this share of the largest are noise.
OVERSAMPLE, ITEMS, TERMS, SHARED, SMALL = 56, 256, 1 << 14, 8, 1e-5
#: Parts in which sums over terms are added up; rows of a sparse product at once, and cells of a table of passages and words.
PARTS, RUN, CELLS = 32, 512, 1 << 22

_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text: str | None) -> list[bytes]:
    low = (text or "").encode()
    return _WORD.findall(low.translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))))


def lcs(masks: dict[int, int], size: int, other: list[int]) -> int:
    """Length of the longest common subsequence: of a word list given by its positions' bit masks, and another."""
    full = (1 << size) - 1
    row = full
    for w in other:
        if hit := row & masks.get(w, 0):
            row = ((row + hit) | (row - hit)) & full
    return size - row.bit_count()


class Benchmark:
    """Items, their vocabulary and what a search needs of them; small enough to go with every task."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.items = [(i, w) for i, t in rows if (w := words_of(t))]
        self.vocabulary = sorted({w for _, ws in self.items for w in ws})
        number = {w: k for k, w in enumerate(self.vocabulary)}
        self.numbers = [[number[w] for w in ws] for _, ws in self.items]
        self.stride = max((len(ws) for _, ws in self.items), default=1)
        hashes = _hashes([w.decode("utf-8", "surrogateescape") for w in self.vocabulary]) if self.vocabulary else np.zeros(0, np.uint64)
        self.order = np.argsort(hashes)
        self.sorted_hashes = hashes[self.order]
        self.firsts = firsts_of(self.sorted_hashes)
        self.longest = max((len(w) for w in self.vocabulary), default=0)
        self.idf = self.basis = self.values = None

    @property
    def finder(self):
        return type("Terms", (Words,), {"order": self.order, "sorted_hashes": self.sorted_hashes, "longest": self.longest, "firsts": self.firsts})

    @property
    def rank(self) -> int:
        return min(len(self.vocabulary), len(self.items) + OVERSAMPLE)

    def vectors(self, owner: np.ndarray, vocab: np.ndarray):
        """Unit TF-IDF rows in sparse form: (row's owner, its first pair), and of each pair the term and weight."""
        keep = self.idf[vocab] > 0
        pairs, tf = np.unique(owner[keep].astype(np.int64) * len(self.vocabulary) + vocab[keep], return_counts=True)
        row, term = pairs // max(1, len(self.vocabulary)), pairs % max(1, len(self.vocabulary))
        weight = self.idf[term] * (1 + np.log(tf))
        starts = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else np.zeros(0, np.int64)
        if len(row):
            norm = np.sqrt(np.add.reduceat(weight**2, starts))
            weight = weight / np.repeat(norm, np.diff(np.append(starts, len(row))))
        return row[starts], starts, term, weight.astype(np.float32)

    def passages(self, words: Words):
        """The passages that weighty hits lie in: owner = text * span + passage, and the hits' words."""
        span = int(words.number.max()) // self.stride + 2 if len(words.number) else 1
        some = np.flatnonzero(self.idf[words.vocab] > 0)
        second = words.number[some] // self.stride
        owner = words.text[some].astype(np.int64) * span + second
        before = np.flatnonzero(second > 0)
        return span, np.concatenate([owner, owner[before] - 1]), words.vocab[np.concatenate([some, some[before]])]


def projected(starts: np.ndarray, term: np.ndarray, weight: np.ndarray, onto: np.ndarray) -> np.ndarray:
    """For each row the weighted sum of its terms' rows of onto: some rows at a time, a term of each in every step."""
    out = np.zeros((len(starts), onto.shape[1]), np.float32)
    onto, size = np.ascontiguousarray(onto), np.diff(np.append(starts, len(term)))
    order = np.argsort(-size, kind="stable")
    buffer = np.empty((RUN, onto.shape[1]), np.float32)
    for k in range(0, len(order), RUN):
        rows = order[k : k + RUN]
        at, have = starts[rows], size[rows]
        own = np.zeros((len(rows), onto.shape[1]), np.float32)
        longer = np.searchsorted(-have, -np.arange(have[0]), side="left").tolist()  # rows that have more than so many terms
        for j, m in enumerate(longer):
            here = at[:m] + j
            step = np.take(onto, term[here], axis=0, out=buffer[:m], mode="clip")
            step *= weight[here, None]
            own[:m] += step
        out[rows] = own
    return out


def _tabled(batches, benches: list[Benchmark]):
    """(block, bench, rows, words) of each piece of a batch and each block."""
    for part in _slices(batches):
        for k, bench in enumerate(benches):
            for _, words in _tables([part], finder=bench.finder):
                yield k, bench, part, words


def _frequencies(batches, benches: list[Benchmark]):
    totals, n = [np.zeros(len(x.vocabulary), np.int64) for x in benches], 0
    for k, bench, part, words in _tabled(batches, benches):
        size = len(bench.vocabulary)
        totals[k] += np.bincount(np.unique(words.text.astype(np.int64) * size + words.vocab) % size, minlength=size)
        n += part.num_rows if k == 0 else 0
    for k, total in enumerate(totals):
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(total) + 1, k, np.int32)), pa.array(range(-1, len(total)), pa.int32()), pa.array([n, *total.tolist()], pa.int64())], ["block", "word", "n"])


def _random(bench: Benchmark) -> np.ndarray:
    return np.random.default_rng(11).standard_normal((len(bench.vocabulary), bench.rank), np.float32)


def _gram(starts, term, weight, omega: np.ndarray, out: np.ndarray) -> None:
    """Adds A'A omega of some rows to out."""
    if len(starts):
        rows = projected(starts, term, weight, omega)
        of = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(term))))
        order = np.argsort(term, kind="stable")
        term, weight, of = term[order], weight[order], of[order]
        first = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]]))
        out[term[first]] += projected(first, of, weight, rows)


def _range(batches, benches: list[Benchmark]):
    omegas = [_random(x) for x in benches]
    outs = [np.zeros_like(x) for x in omegas]
    for k, bench, _, words in _tabled(batches, benches):
        _, owner, vocab = bench.passages(words)
        _, starts, term, weight = bench.vectors(owner, vocab)
        _gram(starts, term, weight, omegas[k], outs[k])
    for k, out in enumerate(outs):
        for j, part in enumerate(np.array_split(out, PARTS)):
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([k * PARTS + j], pa.int32()), pa.array([part.tobytes()], pa.binary())], ["place", "part"])


def _summed(batches):
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for place, part in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            own = np.frombuffer(part.as_buffer(), np.float32).astype(np.float64)
            sums[place] = sums[place] + own if place in sums else own
    for place, own in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([place], pa.int32()), pa.array([own.tobytes()], pa.binary())], ["place", "part"])


def decomposed(sums: np.ndarray, omega: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Right singular vectors and singular values of A from Y = A'A omega alone."""
    omega = omega.astype(np.float64)
    shift = 1e-10 * max(np.linalg.norm(sums), 1e-300)  # keeps the factor defined; taken off the values again
    shifted = sums + shift * omega
    core = omega.T @ shifted
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    good = values > values.max() * 1e-12
    left, middle, _ = np.linalg.svd(shifted @ (vectors[:, good] / np.sqrt(values[good])), full_matrices=False)
    return left, np.sqrt(np.maximum(middle**2 - shift, 0))


def blocks_of(rows: list[tuple[int, str]]) -> list[Benchmark]:
    """Items in order, in blocks of ITEMS items and TERMS distinct words at most."""
    cut, held, vocabulary = [], [], set()
    for i, text in rows:
        words = set(words_of(text))
        if held and (len(held) == ITEMS or len(vocabulary | words) > TERMS):
            cut.append(held)
            held, vocabulary = [], set()
        held.append((i, text))
        vocabulary |= words
    return [x for rows in [*cut, held] if (x := Benchmark(rows)).vocabulary]


def fit(docs: DataFrame, benches: list[Benchmark]) -> None:
    """IDF and latent space of each block from all documents; the driver gets sums whose size the items set."""
    rows = arrow_map(docs, _frequencies, "block int, word int, n long", benches).groupBy("block", "word").agg(F.sum("n").alias("n")).collect()
    n = {(r["block"], r["word"]): r["n"] for r in rows}
    for b, bench in enumerate(benches):
        total = n.get((b, -1), 0)
        df = np.array([n.get((b, k), 0) for k in range(len(bench.vocabulary))])
        weighty = df <= MAX_DF * total
        for ws in bench.numbers:
            weighty[sorted(set(ws), key=lambda w: (df[w], w))[:RAREST]] = True
        bench.idf = np.where(weighty, np.log((total + 1) / (df + 1)) + 1, 0.0)
    shares = arrow_map(docs, _range, "place int, part binary", benches)
    parts = {r["place"]: np.frombuffer(r["part"], np.float64) for r in arrow_map(shares.repartition(PARTS, "place"), _summed, "place int, part binary").collect()}
    for b, bench in enumerate(benches):
        omega = _random(bench)
        cut = np.array_split(np.zeros(len(bench.vocabulary)), PARTS)
        sums = np.concatenate([parts[b * PARTS + j].reshape(-1, bench.rank) if b * PARTS + j in parts else np.zeros((len(x), bench.rank)) for j, x in enumerate(cut)])
        owner = np.repeat(np.arange(len(bench.numbers)), [len(x) for x in bench.numbers])
        _, starts, term, weight = bench.vectors(owner, np.concatenate([np.array(x) for x in bench.numbers]))
        own = np.zeros_like(sums)
        _gram(starts, term, weight, omega, own)
        vectors, bench.values = decomposed(sums + max(1.0, np.linalg.norm(sums) / max(np.linalg.norm(own), 1e-9)) * own, omega)
        bench.basis = np.ascontiguousarray(vectors[:, bench.values > SMALL * bench.values.max(initial=0)], np.float32)


class Finder:
    """What a task needs to search for a block's items."""

    def __init__(self, bench: Benchmark):
        self.bench = bench
        owner = np.repeat(np.arange(len(bench.numbers)), [len(x) for x in bench.numbers])
        self.having, starts, term, weight = bench.vectors(owner, np.concatenate([np.array(x) for x in bench.numbers]))
        latent = projected(starts, term, weight, bench.basis)
        self.latent = latent / np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-9)
        self.sizes = np.array([len(x) for x in bench.numbers])
        self.starts, self.words = np.cumsum(self.sizes) - self.sizes, np.concatenate([np.array(x) for x in bench.numbers])
        self.masks, self.answers = [], []
        for ws in bench.numbers:
            for out, part in ((self.masks, ws), (self.answers, ws[-ANSWER_WORDS:])):
                bits: dict[int, int] = {}
                for k, w in enumerate(part):
                    bits[w] = bits.get(w, 0) | 1 << k
                out.append((bits, len(part)))

    def found(self, words: Words) -> dict[tuple[int, int], tuple]:
        """(text, item) -> (share in order, its place, share of the answer, cosine) of verified candidates."""
        bench = self.bench
        span, own, vocab = bench.passages(words)
        passages, starts, term, weight = bench.vectors(own, vocab)
        rows = projected(starts, term, weight, bench.basis)
        rows /= np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)
        close = rows @ self.latent.T
        best: dict[tuple[int, int], tuple] = {}
        place = words.text.astype(np.int64) * (span * bench.stride) + words.number
        row, col = np.nonzero(close >= COSINE)
        text, number = np.divmod(passages[row].astype(np.int64), span)
        base = (text * span + number) * bench.stride
        begin = np.searchsorted(place, base)
        # Beyond a text's last passage lies the next text.
        end = np.minimum(np.searchsorted(place, base + 2 * bench.stride), np.searchsorted(words.text, text, side="right"))
        items = self.having[col]
        for k in np.flatnonzero(self.bounds(words.vocab, row, begin, end, items) >= LCS_WITH_ANSWER * self.sizes[items]).tolist():
            a, item, key = int(begin[k]), int(items[k]), (int(text[k]), int(items[k]))
            seen = words.vocab[a : end[k]].tolist()
            bits, size = self.masks[item]
            share = lcs(bits, size, seen)
            if share < LCS_WITH_ANSWER * size:
                continue
            answer = lcs(*self.answers[item], seen) / self.answers[item][1]
            if share >= LCS_ALONE * size or answer >= ANSWER:
                found = (share / size, -int(words.number[a]), answer, float(close[row[k], col[k]]))
                if best.get(key, (0,)) < found:
                    best[key] = found
        return best

    def bounds(self, vocab: np.ndarray, passage: np.ndarray, begin: np.ndarray, end: np.ndarray, items: np.ndarray) -> np.ndarray:
        """For each pair of a passage (rising) and an item, how many of the item's words the passage has: no less than they share in order."""
        out = np.zeros(len(items), np.int64)
        new = np.flatnonzero(np.concatenate([[True], passage[1:] != passage[:-1]])) if len(passage) else np.zeros(0, np.int64)
        own = np.cumsum(np.bincount(new, minlength=len(passage))) - 1
        step = max(1, CELLS // len(self.bench.vocabulary))
        for k in range(0, len(new), step):
            some = new[k : k + step]
            has = np.zeros((len(some), len(self.bench.vocabulary)), bool)
            for j, (a, b) in enumerate(zip(begin[some].tolist(), end[some].tolist(), strict=True)):
                has[j, vocab[a:b]] = True
            pairs = slice(int(some[0]), int(new[k + step]) if k + step < len(new) else len(items))
            size = self.sizes[items[pairs]]
            first = np.cumsum(size) - size
            at = np.arange(size.sum()) + np.repeat(self.starts[items[pairs]] - first, size)
            out[pairs] = np.add.reduceat(has[np.repeat(own[pairs] - k, size), self.words[at]], first, dtype=np.int64)
        return out


def _search(batches, benches: list[Benchmark]):
    finders = [Finder(x) for x in benches]
    for b, bench, part, words in _tabled(batches, benches):
        if best := finders[b].found(words):
            ids = part.column(0).to_pylist()
            out = [(ids[t], bench.items[i][0], s, a, c, -n) for (t, i), (s, n, a, c) in sorted(best.items())]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64()), strict=True)], ["doc_id", "item_id", "lcs", "answer", "cosine", "first_word"])


SCHEMA = "doc_id long, item_id long, lcs double, answer double, cosine double, first_word long"


def matches(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id") -> DataFrame:
    """A row for each document and item that it holds: the item's share found in order, of its answer, the cosine.

    Items are searched in blocks, SHARED of them in each pass over all documents.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), "text")
    rows = [(r["item_id"], r["text"]) for r in benchmark.filter("text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").orderBy("item_id", "text").collect()]
    benches = blocks_of(rows)
    out = spark.createDataFrame([], SCHEMA)
    for k in range(0, len(benches), SHARED):
        some = benches[k : k + SHARED]
        fit(docs, some)
        found = arrow_map(docs, _search, SCHEMA, some)
        out = out.unionByName(found) if k else found
    return out


def op8(spark, sf_dir: str) -> DataFrame:
    return matches(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no item of the benchmark."""
    key = fresh("_key", docs)
    keyed = docs.withColumn(key, F.xxhash64("doc_id", "text"))
    found = matches(keyed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), key).select(F.col("doc_id").alias(key)).distinct()
    return keyed.join(found, key, "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
