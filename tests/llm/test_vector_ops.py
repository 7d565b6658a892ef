"""Nearest neighbours, hard negatives and collocations against exact SQL and plain code, on whole and on odd tables."""

import random

import duckdb
import numpy as np
import pytest

from folioscope.llm import collocations, hard_negatives, nearest, vectors

SF = "/root/testdata/sf0.001"
EMBEDDINGS = "vec_id long, embedding array<float>, label int, row long, tile string, v int"
INF, NAN = float("inf"), float("nan")


def odd_vectors(n=420):
    """Copies, ties, zeros, nulls and what is not finite; some coordinates are whole, so that scores tie."""
    r = random.Random(3)
    rows = []
    for k in range(n):
        v = [r.choice([-1.0, 0.0, 0.5, 1.0]) if k % 3 else r.gauss(0, 1) for _ in range(6)]
        if k % 5 == 0:
            v = [0.5, -0.25, 0.5, 1.0, 0.0, 0.75]  # a third of all rows and more
        if k % 5 == 0 or k % 7 == 0:
            v = v if k % 35 else [float(np.float32(0.3 * (k % 4)))] * 6
        rows.append((k, v, k % 4, 1, "t", 2))
    rows += [(n, None, 1, 1, "t", 2), (n + 1, [0.0] * 6, 1, 1, "t", 2), (n + 2, [1.0, None, 1.0, 1.0, 1.0, 1.0], 1, 1, "t", 2), (n + 3, [1.0, NAN, 1.0, 1.0, 1.0, 1.0], 1, 1, "t", 2)]
    rows += [(n + 4, [INF, 1.0, 1.0, 1.0, 1.0, 1.0], 1, 1, "t", 2), (n + 5, [1.0] * 6, None, 1, "t", 2), (None, [1.0] * 6, 1, 1, "t", 2)]
    return rows


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    path = f"{tmp_path_factory.mktemp('odd')}"
    spark.createDataFrame(odd_vectors(), EMBEDDINGS).repartition(4).write.parquet(f"{path}/embeddings.parquet")
    return path


def sql(path, text, table="embeddings"):
    con = duckdb.connect()
    files = f"{path}/{table}.parquet/*.parquet" if "testdata" not in path else f"{path}/{table}.parquet"
    con.execute(f"create view {table} as select * from '{files}'")
    return con.sql(text).fetchall()


def as_lists(rows):
    out = {}
    for query, rank, vec, score in sorted(tuple(r) for r in rows):
        out.setdefault(query, []).append((rank, vec, score))
    return out


@pytest.mark.parametrize("small", [False, True])
def test_nearest(spark, odd, monkeypatch, small):
    """Equal on a table of copies and ties, where the test of the search cannot rule out what it does not know."""
    if small:  # more leaves, blocks, tiles and buckets
        monkeypatch.setattr(vectors, "BLOCK_ROWS", 40)
        monkeypatch.setattr(nearest, "QUERIES", 4)
    got, want = as_lists(nearest.op11(spark, odd).collect()), as_lists(sql(odd, nearest.EXACT_SQL.replace("FROM embeddings", "FROM embeddings WHERE vec_id IS NOT NULL").replace("\n  WHERE embedding", " AND embedding")))
    assert got.keys() == want.keys() and len(got) > 15
    hits = sum(len({v for _, v, _ in got[q]} & {v for _, v, _ in want[q]}) for q in want) / sum(map(len, want.values()))
    assert hits >= 0.97
    for q in want:
        assert [r for r, _, _ in got[q]] == list(range(1, 21))
        order = [(-s, v) for _, v, s in got[q]]
        assert order == sorted(order) and q not in {v for _, v, _ in got[q]}
    if not small:
        assert {q: [v for _, v, _ in x] for q, x in got.items()} == {q: [v for _, v, _ in x] for q, x in want.items()}


def test_nearest_recall(spark):
    sf = "/root/testdata/sf0.1"
    got, want = as_lists(nearest.op11(spark, sf).collect()), as_lists(sql(sf, nearest.EXACT_SQL))
    assert got.keys() == want.keys() and all(len(x) == 20 for x in got.values())
    recall = np.mean([len({v for _, v, _ in got[q]} & {v for _, v, _ in want[q]}) / 20 for q in want])
    assert recall >= 0.95
    best = {(q, v): s for q, x in want.items() for _, v, s in x}
    assert all(abs(best.get((q, v), s) - s) < 1e-12 for q, x in got.items() for _, v, s in x)


def test_nearest_of_few_rows(spark):
    """Repeated ids are rows of their own; fewer candidates than asked for; none at all; other component types."""
    rows = [(20, [1.0, 0.0]), (20, [1.0, 0.0]), (3, [2.0]), (40, [])]
    got = nearest.searched(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted(tuple(r) for r in got) == [(20, 1, 3, 2.0), (20, 1, 3, 2.0), (20, 2, 20, 1.0), (20, 2, 20, 1.0)]
    assert nearest.searched(spark.createDataFrame([(20, [1])], "vec_id int, embedding array<int>")).collect() == []
    assert nearest.searched(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


def test_chi_square():
    x = np.random.default_rng(1).standard_normal((200_000, nearest.DIMENSIONS))
    assert abs(((x * x).sum(axis=1) < nearest.chi_square_bound()).mean() - nearest.SURE) < 0.003


def test_kd_order():
    p = np.random.default_rng(2).standard_normal((1000, 3))
    order = nearest.order_of(p)
    assert sorted(order) == list(range(1000))
    wide = [np.ptp(p[order[k : k + 64]], axis=0).max() for k in range(0, 960, 64)]
    assert np.mean(wide) < 0.7 * np.ptp(p, axis=0).max()
    assert sorted(nearest.order_of(np.zeros((200, 3)))) == list(range(200))


@pytest.mark.parametrize("small", [False, True])
def test_hard_negatives(spark, odd, monkeypatch, small):
    if small:
        monkeypatch.setattr(vectors, "BLOCK_ROWS", 32)
        monkeypatch.setattr(hard_negatives, "ANCHORS", 3)
        monkeypatch.setattr(hard_negatives, "HELD", 2)
    got = sorted(tuple(r) for r in hard_negatives.op12(spark, odd).collect())
    text = hard_negatives.ORACLE_SQL.replace("WHERE label IS NOT NULL", "WHERE vec_id IS NOT NULL AND label IS NOT NULL")
    assert got == sorted(sql(odd, text)) and len(got) > 30


def test_hard_negatives_of_the_test_table(spark):
    assert sorted(tuple(r) for r in hard_negatives.op12(spark, SF).collect()) == sorted(sql(SF, hard_negatives.ORACLE_SQL))


def test_hard_negatives_of_few_rows(spark):
    rows = [(50, [1.0, 1.0], 1), (50, [1.0, 1.0], 1), (1, [1.0, 0.5], 2), (1, [1.0, 0.5], 2), (2, [9.0], 2), (3, [], 2), (100, [-1.0, 0.0], 5)]
    got = hard_negatives.mined(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    # Each of the rows 50 is the other's positive; both rows 1 score 98304 of 131072.
    assert sorted(tuple(r) for r in got) == [(50, 50, 1, 1, 131072, 98304)] * 2 + [(50, 50, 2, 1, 131072, 98304)] * 2
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert hard_negatives.mined(empty).collect() == []
    assert hard_negatives.mined(spark.createDataFrame([(7, [1.0], 1)], "vec_id long, embedding array<double>, label int")).collect() == []
    # Whole numbers beyond what a double holds exactly.
    big = [(50, [8e6 + 1.0], 1), (1, [8e6 + 3.0], 1), (2, [7e6 + 1.0], 2), (3, [7e6 + 2.0], 2)]
    got = hard_negatives.mined(spark.createDataFrame(big, "vec_id long, embedding array<double>, label int")).collect()
    assert [(r.negative_id, r.negative_score) for r in sorted(got, key=lambda r: r["rank"])] == [(k, (256 * (7_000_000 + k - 1)) * (256 * 8_000_001)) for k in (3, 2)]
    with pytest.raises(ValueError):
        hard_negatives.mined(spark.createDataFrame([(50, [1e9], 1)], "vec_id long, embedding array<double>, label int"))


def test_collocations_of_odd_texts(spark, tmp_path):
    r = random.Random(9)
    words = ["New", "york", "CITY", "of", "é", "İstanbul", "x1", "中文", "the", "and so"]
    texts = [" ".join(r.choice(words) + r.choice(["", "", "", ",", ".", "\n", "\t", "  ", "?!"]) for _ in range(r.randint(1, 90))) for _ in range(160)]
    texts += [None, "", "  .. \n", "new york city of the", "the the the the the the"] + ["Same row, the same. Row the same"] * 40 + ["long text of words " * 9000]
    rows = [(k, t, [None, "und", "en", "d\te"][k % 4], "key", 1) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, key string, f int").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in collocations.op13(spark, str(tmp_path)).collect())
    assert got == sorted(sql(str(tmp_path), collocations.ORACLE_SQL, "documents")) and len(got) > 5


def test_collocations_of_full_bitmaps(spark, monkeypatch):
    """Bits that phrases share let more phrases through, but change no row."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = sorted(tuple(r) for r in collocations.ranked(docs).collect())
    assert want == sorted(sql(SF, collocations.ORACLE_SQL, "documents"))
    monkeypatch.setattr(collocations, "BITS", 1 << 15)
    monkeypatch.setattr(collocations, "TEXT", 1 << 12)
    assert sorted(tuple(r) for r in collocations.ranked(docs).collect()) == want


def test_collocations_without_rows(spark):
    assert collocations.ranked(spark.createDataFrame([], "text string, lang string")).collect() == []
