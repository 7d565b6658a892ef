"""Each operator against brute force on small tables with nulls, empty and repeated rows, ties and clashing columns."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from folioscope.llm import (
    decontam,
    html_extract,
    jaccard_join,
    language_id,
    license_scan,
    quality_rules,
    sharding,
    sp_codec,
    suffix_dedup,
    warc,
)

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key long, ref string, kept boolean, _key int"
R = random.Random(5)
VOCABULARY = ["".join(R.choice("abcdefgilmnorst") for _ in range(R.randint(2, 9))) for _ in range(900)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCABULARY) + ("." if k % 11 == 10 else "") + ("\n" if k % 37 == 36 else "") for k in range(n))


def edited(text, every, seed):
    r = random.Random(seed)
    return " ".join("zz" + w if k % every == every - 1 else w for k, w in enumerate(text.split(" "))) + r.choice(["", " end"])


@pytest.fixture(scope="module")
def texts():
    base = [prose(R.randint(5, 400), k) for k in range(40)]
    passage = prose(90, 999)
    out = [*base, None, "", "   \n\t", "one", "One", "two words here now", "é" * 500, "a" * 1500, "ab " * 700, prose(12_000, 77)]
    out += [base[3]] * 5 + [base[4].upper()] + [edited(base[k], 40, k) for k in range(12)] + [edited(base[k], 25, k + 50) for k in range(6)]
    out += [prose(30, 200 + k) + " " + passage + " " + prose(20, 300 + k) for k in range(6)]
    return out


def table(spark, texts):
    rows = [(k, t, "en" if k % 2 else "de", f"s{k % 3}", len(t or ""), 1, "r", False, 7) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def docs(spark, texts):
    return table(spark, texts)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def repeats_of(data, length=400):
    """For each text, a flag for every byte that a repeated string of so many bytes covers."""
    starts = {}
    for k, b in enumerate(data):
        for p in range(len(b) - length + 1):
            starts.setdefault(b[p : p + length], []).append((k, p))
    gone = [bytearray(len(b)) for b in data]
    for places in starts.values():
        if len(places) > 1:
            for k, p in places:
                gone[k][p : p + length] = b"\1" * length
    return gone


def assert_removed(rows, texts):
    data = [(t or "").encode() for t in texts]
    gone = repeats_of(data)
    got = {r.doc_id: r for r in rows}
    for k, b in enumerate(data):
        left = bytes(x for x, g in zip(b, gone[k], strict=True) if not g)
        spans = len(re.findall(b"\1+", bytes(gone[k])))
        assert (got[k].n_bytes, got[k].n_removed, got[k].n_spans, got[k].kept_sha256) == (len(b), sum(gone[k]), spans, hashlib.sha256(left).hexdigest()), k
        assert got[k].text == left.decode("utf-8", "ignore")
    return sum(map(sum, gone))


def test_suffix_dedup(docs, texts):
    assert assert_removed(suffix_dedup.removed(docs).collect(), texts) > 5000


def test_suffix_dedup_hot_cores(spark, monkeypatch):
    """A passage in many different surroundings: its cores are parsed again with smaller gaps."""
    monkeypatch.setattr(suffix_dedup, "HOT", 4)
    passage, other = prose(140, 31), prose(80, 32)
    texts = [prose(20 + k % 7, 400 + k) + " " + (passage if k % 3 else passage[: 500 + 9 * k] + other) + prose(15, 700 + k) for k in range(40)]
    assert assert_removed(suffix_dedup.removed(table(spark, texts)).collect(), texts) > 10_000


@pytest.mark.parametrize("alphabet", ["ab", "abcdefghij klmno", "\0\1a", "é中\n "])
def test_windows_in_corpus_order(alphabet):
    """The suffix arrays of dictionary and parse find the windows that brute force finds."""
    r = random.Random(len(alphabet))
    for length in (9, 40, 130):
        parts = ["".join(r.choice(alphabet) for _ in range(r.choice([1, 30, 200]))) for _ in range(6)] + ["", alphabet * 60, "a" * 300]
        spans = ["".join(r.choice(parts) for _ in range(r.randint(0, 4))).encode() for _ in range(40)]
        seen = {}
        for x in spans:
            for p in range(len(x) - length + 1):
                seen[x[p : p + length]] = seen.get(x[p : p + length], 0) + 1
        got = suffix_dedup.repeated(spans, length)
        assert [f.tolist() for f in got] == [[seen[x[p : p + length]] > 1 for p in range(len(x) - length + 1)] for x in spans]


def test_suffix_dedup_empty(empty):
    assert suffix_dedup.removed(empty).collect() == [] and suffix_dedup.stage(None, empty, "").collect() == []


def test_suffix_dedup_pieces(spark, monkeypatch):
    """A text longer than a piece is parsed in pieces; here pieces are one megabyte and texts repeat within them."""
    long = prose(400_000, 1)
    assert len(long) > suffix_dedup.PIECE
    got = {r.doc_id: r for r in suffix_dedup.removed(table(spark, [long, long[:300_000] + prose(50, 2), "x"])).collect()}
    assert got[0].n_removed >= 300_000 and got[1].n_removed >= 300_000 and got[0].n_spans == 1 and got[2].n_removed == 0


def test_suffix_dedup_stage(docs, texts):
    """Passages of more than PASSAGE_WORDS words in repeated bytes go; everything else stays."""
    out = suffix_dedup.stage(None, docs, "")
    assert out.columns == docs.columns
    rows = {r.doc_id: r for r in out.collect()}
    assert len(rows) == len(texts) and rows[40].text is None and rows[41].text == ""
    data = [(t or "").encode() for t in texts]
    cut = 0
    for k, (b, gone) in enumerate(zip(data, repeats_of(data, suffix_dedup.PASSAGE), strict=True)):
        left, at = b"", 0
        for m in re.finditer(b"\1+", bytes(gone)):
            if len(b[m.start() : m.end()].split()) > suffix_dedup.PASSAGE_WORDS:
                left, at, cut = left + b[at : m.start()], m.end(), cut + 1
        assert (rows[k].text or "") == (left + b[at:]).decode("utf-8", "ignore"), k
    assert cut > 10


def test_suffix_dedup_passages(spark, docs, texts, tmp_path):
    """The query also tells the text without repeated passages of over 50 words, which may be shorter than its 400 bytes."""
    passage = prose(56, 998)
    assert 200 < len(passage) < suffix_dedup.LENGTH and len(passage.split()) > suffix_dedup.PASSAGE_WORDS + 3
    every = [*texts, *(prose(25, 800 + k) + " " + passage + " " + prose(25, 900 + k) for k in range(4))]
    table(spark, every).write.parquet(f"{tmp_path}/documents.parquet")
    rows = suffix_dedup.op1(spark, str(tmp_path)).collect()
    assert_removed(rows, every)
    got = {r.doc_id: r.text_without_passages for r in rows}
    stage = {r.doc_id: r.text for r in suffix_dedup.stage(spark, table(spark, every), "").collect()}
    assert got == {k: t or "" for k, t in stage.items()}
    for k in range(len(texts), len(every)):
        assert passage[1:-1] not in got[k] and got[k].startswith(prose(25, 800 + k - len(texts))[:100]) and len(got[k]) > 200
    assert all(r.n_removed == 0 for r in rows if r.doc_id >= len(texts))


def test_suffix_dedup_narrowed_windows(spark, monkeypatch):
    """Long windows looked for in the intervals of short ones alone, with hot cores and segments in several parts."""
    monkeypatch.setattr(suffix_dedup, "HOT", 4)
    monkeypatch.setattr(suffix_dedup, "PIECE", 300)
    passage, other = prose(140, 31), prose(80, 32)
    texts = [prose(20 + k % 7, 400 + k) + " " + (passage if k % 3 else passage[: 300 + 9 * k] + other) + prose(15, 700 + k) for k in range(30)]
    rows = suffix_dedup.removed(table(spark, [*texts, None, "", texts[0]]), passages=True).collect()
    assert assert_removed(rows, [*texts, None, "", texts[0]]) > 10_000


def sets_of(texts):
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        yield {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def test_jaccard_join(docs, texts):
    sets = list(sets_of(texts))
    parent = list(range(len(sets)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    links = 0
    for a, b in itertools.combinations(range(len(sets)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            links += 1
            parent[max(root(a), root(b))] = min(root(a), root(b))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.joined(docs).collect()}
    assert got == {k: (len(s), root(k)) for k, s in enumerate(sets)} and links > 20


def test_jaccard_stage_keeps_one(spark):
    same = prose(80, 1)
    rows = [(5, same, "en"), (2, same.upper(), "de"), (9, prose(60, 2), "en"), (None, prose(70, 3), "x"), (7, None, None)]
    out = jaccard_join.stage(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string"), "").collect()
    assert sorted((r.doc_id or -1) for r in out) == [-1, 2, 7, 9]


def test_token_bound_never_drops_a_link():
    import numpy as np

    r = np.random.default_rng(1)
    for n in (3, 40, 700):
        a = np.unique(r.integers(0, 1 << 63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[: -(-len(a) * 9 // 10)], r.integers(0, 1 << 63, n // 20).astype(np.uint64)]))
        x, y = (np.frombuffer(jaccard_join.counted(s), np.uint8) for s in (a, b))
        assert np.minimum(x, y).sum() >= len(np.intersect1d(a, b))


def test_sharding(docs, texts):
    rows = sharding.sharded(docs.select("doc_id", "text"), 7).collect()
    sizes = {k: len((t or "").encode()) + 16 for k, t in enumerate(texts)}
    assert {r.doc_id: r["size"] for r in rows} == sizes and {r.law for r in rows} == {"bytes"} and {r.grown_shard for r in rows} == {None}
    assert all(r.text_crc32 == zlib.crc32((texts[r.doc_id] or "").encode()) for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r)
    assert set(by) <= set(range(7)) and all(sorted(x.slot for x in v) == list(range(len(v))) for v in by.values())


def test_sharding_balance_under_copies(spark):
    texts = [prose(60, 1)] * 300 + [prose(R.randint(20, 90), 500 + k) for k in range(600)]
    rows = sharding.sharded(table(spark, texts).select("doc_id", "text"), 8).groupBy("shard").agg(F.sum("size").alias("s")).collect()
    sizes = [r.s for r in rows]
    assert len(sizes) == 8 and max(sizes) - min(sizes) <= 3 * max(len(t) + 16 for t in texts)


def test_license_scan(docs, spark):
    cases = ["Permission is granted under the MIT License.", "under  THE mit\nlicense under the mit license", "Licensed under the Apache License, Version 2.0.", "Licensed under CC BY-NC 4.0.", "This work is licensed under the GNU General Public License, version 3.", "under the mitt license", None, "", "apache license version 2x", "undér the mit license"]
    want = [("mit", 1, 3), ("mit", 2, 0), ("apache-2", 1, 3), ("cc-by-nc", 1, 2), ("", 0, None), ("", 0, None), ("", 0, None), ("", 0, None), ("", 0, None), ("", 0, None)]
    many = cases + [prose(50, k) for k in range(60)]
    got = {r.doc_id: r for r in license_scan.scanned(table(spark, many)).collect()}
    assert [(got[k].base_labels, got[k].n_base, got[k].first_word) for k in range(10)] == want
    assert got[4].labels == "gpl-3" and got[1].last_word == 4 and all(0 <= r.score <= 1 for r in got.values())
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    assert all(got[k].n_words == len(word.findall(low(t))) for k, t in enumerate(many))
    assert all(got[k].labels == "" for k in range(10, len(many)))


def test_license_texts(spark):
    """Sentences of full licence texts give their labels, with punctuation and lines as they are published."""
    texts = [
        'The above copyright notice and this permission notice shall be included in all\ncopies or substantial portions of the Software.',
        "Redistributions of source code must retain the above copyright notice, this\n   list of conditions and the following disclaimer.",
        'Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.',
        "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.",
        "This is free and unencumbered software released into the public domain.",
        "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at",
        "The above notice shall be included; copies of the list appear in the public documentation.",
    ]
    got = {r.doc_id: r.labels for r in license_scan.scanned(table(spark, texts + [prose(60, k) for k in range(50)])).collect()}
    assert [got[k] for k in range(7)] == ["mit", "bsd", "isc", "gpl-3", "unlicense", "mpl-2", ""]
    assert all(not got[k] for k in range(7, 57))


def test_language_id(spark):
    r = random.Random(3)
    parts = {"en": ["the", "ing", "tion", "wh", "ed", "of"], "fr": ["eau", "oi", "que", "é", "les", "ou"], "de": ["sch", "ung", "ich", "ü", "der", "ein"]}
    make = lambda lang: " ".join("".join(r.choice(parts[lang]) for _ in range(r.randint(1, 3))) for _ in range(40))
    rows = [(k, make(lang), lang) for k, lang in enumerate(["en", "fr", "de"] * 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(df.filter("doc_id < 120"))
    odd = spark.createDataFrame([(1000, None), (1001, ""), (1002, "12 + 3"), (1003, "a")], "doc_id long, text string")
    got = {x.doc_id: x for x in language_id.predicted(df.filter("doc_id >= 120").select("doc_id", "text").unionByName(odd), model).collect()}
    held = rows[120:]
    assert sum(got[k].lang_pred == lang for k, _, lang in held) >= 0.97 * len(held)
    assert [got[k].lang_pred for k in (1000, 1001, 1002)] == ["und"] * 3 and got[1003].lang_pred in parts
    nothing = language_id.train(df.filter("lang is null"))
    assert language_id.predicted(df, nothing).first().lang_pred == "und"


def test_quality_rules(docs, texts):
    got = {r.doc_id: r for r in quality_rules.judged(docs.select("doc_id", "text")).collect()}
    for k, t in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        counts = {}
        for x in windows:
            counts[x] = counts.get(x, 0) + 1
        covered = {i + j for i, x in enumerate(windows) if counts[x] > 1 for j in range(3)}
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered))
        assert (got[k].n_words, got[k].word_chars, got[k].n_symbols, got[k].n_dup_lines, got[k].n_repeat_words) == want, k
        assert got[k].base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w)) and not (got[k].kept and got[k].base_failed)
    assert got[0].kept or got[0].base_failed


def test_quality_stage(spark, docs):
    out = quality_rules.stage(spark, docs, "")
    assert out.columns == docs.columns and 0 < out.count() < docs.count()
    junk = "\n".join(" | ".join(VOCABULARY[k : k + 9]) for k in range(0, 90, 9))
    two = spark.createDataFrame([(1, junk), (2, prose(120, 4))], "doc_id long, text string")
    assert [r.doc_id for r in quality_rules.stage(spark, two, "").collect()] == [2]


LINES = {
    "Home About Contact Products": True, "Read more »": True, "Page 1 2 3": True, "1 2 3 4 5 6 Next": True, "« Zurück Weiter »": True, "Lire la suite de cet article ici.": True,
    "HELLO!! NOW!! BUY!!": True, "a | b | c | d": True, "$$$ ### a": True, "go " * 14: True, "Alle Rechte vorbehalten.": True, "Impressum": True, "A" * 5000 + " b": False,
    "": False, " \t": False, "It was.": False, "The rooms 1 2 3 were open to all.": False, "A plain line of prose that goes on over its end and": False, "He said: “No”": False,
    "Introduction to the field of study": False, "The director met Anna Maria Berger in New York and Boston and then went": False,
}


def test_quality_lines(spark):
    """Single lines, and texts of which failing lines alone are taken; blank lines stay."""
    lines = list(LINES)
    rows = quality_rules.judged(spark.createDataFrame([(k, x) for k, x in enumerate(lines)], "doc_id long, text string")).collect()
    assert {lines[r.doc_id]: r.n_lines_removed == 1 for r in rows} == LINES
    body = [prose(36, 70), "", "Home About Contact Products", prose(36, 71), "  ", "Read more »", ""]
    left = "\n".join([body[0], "", body[3], "  ", ""])
    docs = spark.createDataFrame([(1, "\n".join(body), 3, 5), (2, prose(60, 72), None, 6), (2, prose(60, 72), None, 6), (3, None, 1, 7)], "doc_id long, text string, n_chars int, kept int")
    got = sorted(tuple(r) for r in quality_rules.stage(spark, docs, "").collect())
    assert got == [(1, left, len(left), 5)] + [(2, prose(60, 72), None, 6)] * 2


def test_decontamination(spark, texts):
    items = [prose(R.randint(14, 50), 700 + k) for k in range(30)]
    bench = spark.createDataFrame([(k, t) for k, t in enumerate(items)] + [(98, None), (99, "")], "item_id long, text string")
    many, want = list(texts), set()
    for k, t in enumerate(items[:25]):
        w = t.split()
        if k % 3 == 1:
            w = [x for j, x in enumerate(w) if j % 9 != 4]
        if k % 3 == 2:
            w = [x if j % 8 != 3 else "qq" for j, x in enumerate(w)]
        want.add((len(many), k))
        many.append(prose(R.randint(0, 300), 800 + k) + " " + " ".join(w).upper() + " " + prose(R.randint(0, 200), 900 + k))
    found = decontam.matches(table(spark, many), bench).collect()
    got = {(r.doc_id, r.item_id) for r in found}
    recall = len(got & want) / len(want)
    # The brute force: every item against every document, by common subsequences of all windows.
    truth = set()
    for d, t in enumerate(many):
        seen = decontam.words_of(t)
        for k, item in enumerate(items):
            ws = decontam.words_of(item)
            bits = {}
            for j, x in enumerate(ws):
                bits[x] = bits.get(x, 0) | 1 << j
            if len(set(ws) & set(seen)) >= 0.8 * len(set(ws)) and any(decontam.lcs(bits, len(ws), seen[p : p + 2 * len(ws)]) >= 0.8 * len(ws) for p in range(0, max(1, len(seen) - len(ws) + 1))):
                truth.add((d, k))
    assert recall >= 0.9 and len(got & truth) >= 0.9 * len(truth) and all(d >= len(texts) or (d, k) in truth for d, k in got)


def test_singular_vectors_of_one_pass():
    """Vectors and values from Y = A'A R are those of A's own decomposition."""
    import numpy as np

    r = np.random.default_rng(3)
    a = r.standard_normal((300, 12)) @ np.diag(2.0 ** -np.arange(12)) @ r.standard_normal((12, 90))
    omega = r.standard_normal((90, 40)).astype(np.float32)
    vectors, values = decontam.decomposed(a.T @ a @ omega, omega)
    _, want, rows = np.linalg.svd(a, full_matrices=False)
    assert np.allclose(values[:8], want[:8], rtol=1e-3)
    assert np.allclose(np.abs(np.sum(vectors[:, :6] * rows[:6].T, axis=0)), 1, atol=1e-3)


def test_decontamination_of_many_items(spark, monkeypatch):
    """Several blocks of items; what was planted by edits is found, what was not is left alone."""
    monkeypatch.setattr(decontam, "ITEMS", 100)
    r = random.Random(17)
    items = [prose(r.randint(15, 45), 5000 + k) for k in range(600)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    docs, want = [prose(r.randint(50, 300), 9000 + k) for k in range(60)], set()
    for k in range(0, 600, 4):
        w = items[k].split()
        if k % 3 == 1:
            w = [x for j, x in enumerate(w) if j % 9 != 4]
        if k % 3 == 2:
            w = [x if j % 8 != 3 else "qq" for j, x in enumerate(w)]
        want.add((len(docs), k))
        docs.append(prose(r.randint(0, 200), 7000 + k) + " " + " ".join(w) + " " + prose(r.randint(0, 99), 8000 + k))
    got = {(x.doc_id, x.item_id) for x in decontam.matches(table(spark, docs), bench).collect()}
    assert len(got & want) >= 0.95 * len(want) and len(got - want) <= 0.05 * len(want) and all(d >= 60 for d, _ in got)


def test_decontamination_stage(spark, tmp_path):
    item = prose(30, 1)
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = table(spark, [prose(50, 2) + " " + item + " tail", prose(90, 3), None, ""])
    out = decontam.stage(spark, docs, str(tmp_path))
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == [1, 2, 3]


def test_sentencepiece(docs, texts):
    model = sp_codec.public_model()
    library = sp_codec.codec(model).library
    got = {r.doc_id: r for r in sp_codec.encoded(docs, model).collect()}
    digests = {r.doc_id: r for r in sp_codec.digested(docs, model).collect()}
    for k, t in enumerate(texts):
        ids = library.encode(t or "")
        assert got[k].ids == ids and got[k].decoded == library.decode(ids)
        data = (t or "").encode()
        spans = list(zip(got[k].starts, got[k].stops, strict=True))
        assert b"".join(data[a:b] for a, b in spans) == data  # spans tile the original bytes
        for i, (a, b) in zip(ids, spans, strict=True):
            piece = library.id_to_piece(i)
            if not library.is_byte(i):
                assert data[a:b].decode().replace(" ", "▁") in (piece, piece.removeprefix("▁"))
        assert digests[k].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() and digests[k].n_span_bytes == len(data)


@pytest.mark.parametrize(("trained", "read"), [("0.01", "0.01"), ("0.01", "0.1")])
def test_html_of_the_test_pages(spark, trained, read):
    """Every page against its article, read by plain patterns, also on a table that the trees were not trained on."""
    import html

    pages = spark.read.parquet(f"/root/testdata/sf{read}/pages.parquet")
    want = {}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)(</article>|$)", re.sub(r"(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->", "", r.html or ""), re.S)
        want[r.page_id] = " ".join(html.unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", inner[1]))).split()) if inner else ""
    model = html_extract.train(spark.read.parquet(f"/root/testdata/sf{trained}/pages.parquet"))
    got = {r.page_id: r.text for r in html_extract.extracted(pages, model).collect()}
    right = sum(got[k] == t for k, t in want.items())
    assert len(got) == len(want) and right >= 0.99 * len(want), f"{right} of {len(want)}"


def test_html_of_short_paragraphs_and_odd_rows(spark):
    """Short first and last paragraphs and headings stay; references are read in each piece of text by itself."""
    text = " ".join(prose(60, 8).split())
    nav, foot = "<nav><ul><li><a href='/a'>Home</a></li><li><a href='/b'>News</a></li></ul></nav>", "<footer>&copy; me</footer></body></html>"
    cases = [
        (f"<article><h1>One</h1><p>Les.</p><p>{text}</p><p>{text}</p><p>That.</p></article>", f"One Les. {text} {text} That."),
        (f"<h1>Title here now</h1><div class='content'><p>{text}</p><p>{text}</p><p>Ends so.</p></div><div class='comments'><p>first!</p></div>", f"Title here now {text} {text} Ends so."),
        (f"<article><p>{text} a <b>&am</b>p;lt; b &amp;lt; c</p></article>", f"{text} a &amp;lt; b &lt; c"),
        ("<article>" + f"<p>{text}</p>" * 3000 + "</article>", " ".join([text] * 3000)),
    ]
    rows = [(k // 2, "u", page(nav + h + foot), "x", 1) for k, (h, _) in enumerate(cases) for _ in range(2)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    got = sorted((r.n_chars, r.text) for r in html_extract.extracted(df, html_extract.fit([prose(60, k) for k in range(30)])).collect())
    assert got == sorted((len(t), t) for _, t in cases for _ in range(2))


def test_html_of_held_out_layouts():
    """Words of main text on layouts that were not trained on."""
    model = html_extract.fit([prose(60, k) for k in range(40)])
    hit = found = wanted = 0
    for source in html_extract.layouts([prose(50, 900 + k) for k in range(40)], 150, seed=991):
        page = html_extract.Page(source)
        truth = " ".join(t for t, y in zip(page.text, html_extract.labelled(page), strict=True) if t and y).split()
        text = page.main_text(model.odds(page.features())).split()
        left = list(truth)
        for w in text:
            if w in left:
                left.remove(w)
                hit += 1
        found, wanted = found + len(text), wanted + len(truth)
    print("held-out layouts: precision", round(hit / found, 4), "recall", round(hit / wanted, 4))
    assert hit >= 0.95 * found and hit >= 0.95 * wanted


@pytest.mark.parametrize("trim", [False, True])
@pytest.mark.parametrize("rule", ["nfkc", "nmt_nfkc_cf"])
def test_character_map(rule, trim):
    """With a compiled character map, the own normaliser's text, ids and decoding are the library's."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    made = sentencepiece.SentencePieceNormalizer(rule_name=rule)
    spec = sentencepiece_model_pb2.ModelProto.FromString(made.serialized_model_proto()).normalizer_spec
    proto = sentencepiece_model_pb2.ModelProto.FromString(sp_codec.public_model())
    proto.normalizer_spec.precompiled_charsmap = spec.precompiled_charsmap
    proto.normalizer_spec.remove_extra_whitespaces = trim
    own = sp_codec.Codec(proto.SerializeToString())
    assert own.map is not None
    r = random.Random(4)
    pool = ["ﬁ", "①", "ｶﾞ", "Ａ", "é", "e\u0301", "½", " ", "  ", "\u3000", "\t", "\n", "ß", "İ", "中", "한", "a", "Bc", "…", "\u200b", "▁", "😀", "ﷺ", "\u00a0"]
    texts = ["", " ", "   ", *pool, *("".join(r.choice(pool) for _ in range(r.randint(1, 60))) for _ in range(300)), *(prose(40, k) for k in range(5))]
    for text, (ids, spans) in zip(texts, own.encoded(texts), strict=True):
        assert ids == own.library.encode(text), text
        data = text.encode()
        assert b"".join(data[a:b] for a, b in spans) == (data if ids else b"")
        for (a, b), piece in zip(spans, own.library.encode(text, out_type=str), strict=True):
            if a < b and not piece.startswith("<0x"):
                data[a:b].decode()  # spans of whole pieces do not split characters


def page(body):
    return f"<!DOCTYPE html><html><head><title>t</title><script>var a='<p>no</p>';</script></head><body>{body}"


def test_html_extraction(spark):
    text = prose(120, 5).replace("\n", " ")
    cases = [
        (page(f"<nav><ul><li><a href='/a'>Home</a></li><li><a href='/b'>News</a></li></ul></nav><!-- x --><div class='ad'>Buy now, cheap.</div><article><h1>Title one</h1><p><b>{text}<br><p>Fish &amp; chips&nbsp;now.</article><footer>&copy; me</footer>"), f"Title one {text} Fish & chips now."),
        (page(f"<header><a href='/'>Site</a></header><main><h1>Other</h1><p>{text}</p></main><aside class='sidebar'><h3>More</h3><ul><li><a href='/q'>x y</a></li></ul></aside><section class='comments'><p>first!</p></section><footer>bye</footer></body></html>"), f"Other {text}"),
        (None, ""), ("", ""), ("<html><body></body></html>", ""), ("<<<>>< p", None),
    ]
    df = spark.createDataFrame([(k, f"u{k}", h, "x") for k, (h, _) in enumerate(cases)], "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in html_extract.extracted(df, html_extract.fit([prose(60, k) for k in range(30)])).collect()}
    for k, (_, want) in enumerate(cases):
        if want is not None:
            assert got[k].text == " ".join(want.split())
        assert got[k].n_chars == len(got[k].text) and got[k].url == f"u{k}"


def test_html_decoding_never_contradicts():
    import numpy as np

    p = html_extract.Page("<div><p>a b</p><div><p>c</p></div></div>")
    odds = np.array([1.0 if t == "#" else -9.0 for t in p.tag])
    assert p.main_text(odds) == ""
    assert p.main_text(np.ones(len(p.tag))) == "a b c"


def test_warc(spark, tmp_path):
    big = "<p>" + prose(300, 1) + "é</p>"
    rows = [(1, "http://a/1", big), (2, "http://a/2\r\nX: y", big), (7, None, big), (3, "u", "short"), (4, "u", "short"), (5, "u", None), (6, "u", ""), (8, "u", "WARC/1.1\r\n\r\n" + big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = {r.page_id: r for r in warc.archived(pages, f"file://{tmp_path}/w", keep_source=True).collect()}
    for k, _, html in rows:
        data = (html or "").encode()
        assert (got[k].payload_bytes, got[k].payload_digest) == (len(data), hashlib.sha1(data).hexdigest())
    assert {k: (r.record_type, r.refers_to) for k, r in got.items() if r.record_type == "revisit"} == {1: ("revisit", 7), 2: ("revisit", 7)}
    import gzip
    import pathlib

    found = 0
    for f in pathlib.Path(tmp_path, "w").glob("*.warc.gz"):
        whole = gzip.decompress(f.read_bytes())
        assert whole == gzip.decompress(pathlib.Path(str(f).replace(".warc.gz", ".mono.gz")).read_bytes())
        found += whole.count(b"WARC-Record-ID")
    assert found == len(rows)


def test_empty_tables(spark, empty):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    model = sp_codec.public_model()
    bench = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(0, prose(20, 1))], "item_id long, text string")
    for out in (
        suffix_dedup.removed(empty), jaccard_join.joined(empty), sharding.sharded(empty), license_scan.scanned(empty), quality_rules.stage(spark, empty, ""),
        language_id.predicted(empty, language_id.train(empty)), decontam.matches(empty, bench), decontam.matches(empty, some), sp_codec.digested(empty, model),
        warc.archived(pages), html_extract.extracted(pages),
    ):
        assert out.count() == 0


def test_language_id_of_odd_tables(spark):
    """Columns with names of the operator's own, ties, nulls, one language and none."""
    rows = [(k, t, lang, False, 9, "x") for k, (t, lang) in enumerate([("the cat and the dog", "en"), ("der hund und die katze", "de"), (None, "en"), ("", "de"), ("123 456", None), ("the dog", "en"), ("die katze", "de"), ("the dog", "en")] * 12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, held_out boolean, score int, lang_pred string")
    got = {r.doc_id: r for r in language_id.predicted(docs, language_id.train(docs)).collect()}
    assert set(got) == set(range(96)) and all((got[k].lang_pred == "und") == (t is None or not any(c.isalpha() for c in t)) for k, t, *_ in rows)
    assert all(0 <= r.score <= 1 for r in got.values())
    # Equal texts are told alike, and a table without languages gives none.
    assert len({got[k].lang_pred for k, t, *_ in rows if t == "the dog"}) == 1
    none = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language_id.predicted(none, language_id.train(none)).collect()} == {"und"}


def test_warc_of_odd_tables(spark, tmp_path):
    """Null ids and urls, equal payloads at the limit, columns with names of the operator's own; two reads of one result."""
    big, small = "x" * 1000, "y" * 999
    rows = [(1, None, big, "d", 5), (2, "http://a/é b", big, None, 5), (3, "u", small, "d", 5), (4, "u", small, "d", 5), (5, "u", None, "d", None), (6, "u", "", "d", None), (7, "u", big, "d", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string, refers_to int").repartition(3)
    found = warc.archived(pages, f"file://{tmp_path}/archives")
    for _ in range(2):
        got = {r.page_id: (r.payload_bytes, r.record_type, r.refers_to) for r in found.collect()}
        assert got == {1: (1000, "revisit", 7), 2: (1000, "revisit", 7), 3: (999, "response", None), 4: (999, "response", None), 5: (0, "response", None), 6: (0, "response", None), 7: (1000, "response", None)}
    names = {r.archive for r in found.collect()}
    files = {x.name for x in (tmp_path / "archives").iterdir() if not x.name.startswith(".")}
    assert files == names | {n + ".idx" for n in names}


def test_html_of_null_ids(spark):
    rows = [(None, None, page("<article><h1>T</h1><p>Some words of a text here.</p></article>")), (1, None, None), (None, "u", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted((r.url or "", r.n_chars) for r in html_extract.extracted(df).collect())
    assert len(got) == 3 and sum(n > 0 for _, n in got) <= 1


def test_sharding_of_repeated_rows(spark):
    """Rows that agree in all columns, and rows without an id, are spread as well."""
    rows = [(7, "the same row of the table over and over")] * 3000 + [(None, prose(30, 1))] * 800 + [(None, None)] * 200 + [(k, prose(40, k)) for k in range(398)]
    out = sharding.sharded(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 40).collect()
    by = {}
    for x in out:
        by.setdefault(x.shard, []).append(x)
    mean, largest = sum(x["size"] for x in out) / 40, max(x["size"] for x in out)
    assert len(out) == len(rows) and sorted(by) == list(range(40)) and all(sorted(x.slot for x in v) == list(range(len(v))) for v in by.values())
    assert all(abs(sum(x["size"] for x in v) - mean) <= 1.5 * largest for v in by.values())


def test_sharding_laws(spark):
    """Each shard's bytes are near the mean, sizes and checksums are those of the texts, slots have no gaps."""
    r = random.Random(8)
    texts = [None, "", *(prose(r.randint(1, 60), 3000 + k) for k in range(1500)), *([prose(40, 5)] * 700)]
    rows = sharding.sharded(table(spark, texts).select("doc_id", "text"), 40).collect()
    assert sorted(x.doc_id for x in rows) == list(range(len(texts))) and {x.law for x in rows} == {"bytes"}
    by = {}
    for x in rows:
        data = (texts[x.doc_id] or "").encode()
        assert (x["size"], x.text_crc32, x.grown_shard) == (len(data) + 16, zlib.crc32(data), None)
        by.setdefault(x.shard, []).append(x)
    mean, largest = sum(x["size"] for x in rows) / 40, max(x["size"] for x in rows)
    assert sorted(by) == list(range(40)) and all(sorted(x.slot for x in v) == list(range(len(v))) for v in by.values())
    assert all(abs(sum(x["size"] for x in v) - mean) <= 1.5 * largest for v in by.values())


def test_sharding_of_texts_with_many_words(spark):
    """100,000 times the spaces of a text of 25,000 words does not fit an int."""
    texts = ["a " * 25_000, "b c", None, "d " * 40]
    out = {r.doc_id: r for r in sharding.sharded(table(spark, texts).select("doc_id", "text"), 2).collect()}
    assert len(out) == 4 and max(r["size"] for r in out.values()) == 50_016
