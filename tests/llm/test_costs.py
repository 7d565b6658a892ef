"""What keeps the cost of the operators down, without a change of their results."""

import random

import numpy as np
import pyarrow.parquet as pq

from folioscope.llm import decontam, license_scan

SF = "/root/testdata/sf0.001"


def test_only_passages_with_enough_words_are_verified(monkeypatch):
    """A passage without the item's words needs no common subsequence, and the bound loses no match."""
    table = pq.read_table(f"{SF}/benchmark.parquet", columns=["item_id", "text"]).to_pylist()
    (bench,) = decontam.blocks_of([(r["item_id"], r["text"]) for r in table if r["text"] is not None])
    bench.idf = np.ones(len(bench.vocabulary))
    bench.basis = np.linalg.qr(np.random.default_rng(3).standard_normal((len(bench.vocabulary), 64)))[0].astype(np.float32)
    batches = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_batches()
    calls, found, true = [], [], decontam.lcs

    def counted(masks, size, other):
        calls.append(size)
        return true(masks, size, other)

    monkeypatch.setattr(decontam, "lcs", counted)
    for batch in decontam._search(batches, [bench]):
        found += batch.to_pylist()
    few = len(calls)
    calls.clear()
    monkeypatch.setattr(decontam.Finder, "bounds", lambda self, vocab, passage, begin, end, items: self.sizes[items], raising=False)
    every = [r for batch in decontam._search(batches, [bench]) for r in batch.to_pylist()]
    assert found and found == every and few < len(calls) / 4


def test_products_of_sparse_rows():
    r = np.random.default_rng(5)
    for rows in (0, 1, 7, 1500):
        size = r.integers(1, 40, rows)
        starts = np.cumsum(size) - size
        term, weight = r.integers(0, 90, size.sum()), r.standard_normal(size.sum()).astype(np.float32)
        onto = np.asfortranarray(r.standard_normal((90, 12)).astype(np.float32))
        dense = np.zeros((rows, 90))
        np.add.at(dense, (np.repeat(np.arange(rows), size), term), weight)
        assert np.allclose(decontam.projected(starts, term, weight, onto), dense @ onto, atol=1e-4)
        out = np.zeros((90, 12), np.float32)
        decontam._gram(starts, term, weight, onto, out)
        assert np.allclose(out, dense.T @ (dense @ onto), rtol=1e-3, atol=1e-2)


def test_words_are_looked_up_by_their_upper_bits():
    """Hashes that agree in their upper bits are told apart."""
    r = random.Random(4)
    top = [r.getrandbits(16) << 48 for _ in range(3)]
    hashes = np.array(sorted({t | r.getrandbits(48) for t in top for _ in range(5)} | {0, 2**64 - 1}), np.uint64)
    kind = type("Terms", (license_scan.Words,), {"sorted_hashes": hashes, "firsts": license_scan.firsts_of(hashes)})
    asked = np.array([*hashes.tolist(), *(t | r.getrandbits(48) for t in top), 1, 2**64 - 2], np.uint64)
    hit, spot = kind._looked_up(kind, asked)
    assert hit.tolist() == list(range(len(hashes))) and spot.tolist() == list(range(len(hashes)))
