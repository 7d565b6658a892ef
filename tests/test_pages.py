"""Page alignment, numbers and sheets against golden cases."""

import random
import time

import pandas as pd
from pyspark.sql import functions as F

from folioscope.functions import similarity as S
from folioscope.functions import text as T
from folioscope.operators import numbers as N
from folioscope.operators import pages as P
from folioscope.operators import reports as O


def test_greedy_assignment(spark):
    sims = spark.createDataFrame([(1, 0, 0, 0.9), (1, 0, 1, 0.4), (1, 1, 0, 0.95), (1, 1, 1, 0.35), (1, 2, 0, 0.1)], "pair_id long, i1 int, i2 int, sim double")
    pages = spark.createDataFrame([(1, 1, k) for k in range(3)], "pair_id long, side int, page_no int")
    got = [(r.i1, r.i2, r.sim) for r in P.assigned(sims, pages).orderBy("i1").collect()]
    assert got == [(0, 0, 0.9), (1, 1, 0.35), (2, -1, 0.0)]


def test_blank_pages_align(spark):
    pages = spark.createDataFrame([(1, 1, 0, ""), (1, 2, 0, "")], "pair_id long, side int, page_no int, text string")
    assert [(r.i2, r.sim) for r in P.aligned(pages).collect()] == [(0, 0.5)]


def test_reconciled(spark):
    df = spark.createDataFrame([(1, "1.0 then 1 and 2 3", "x 2 3 4 10"), (2, "", None)], "pair_id long, text1 string, text2 string")
    rows = {r.pair_id: r for r in N.reconciled(df).collect()}
    assert rows[1].in_both == ["2", "3"] and rows[1].only1 == ["1.0", "1"] and rows[1].only2 == ["4", "10"] and rows[1].similarity_pct == 33.3
    assert rows[2].similarity_pct == 100.0 and rows[2].dice_pct == 100.0
    sheet = [(r.only_in_AFS1, r.only_in_AFS2, r.in_both) for r in N.sheet(N.reconciled(df)).orderBy("row_no").collect()]
    assert sheet == [("1.0", "4", "2"), ("1", "10", "3")]


def test_rounding(spark):
    row = spark.createDataFrame([(2.25, 1.015)], "a double, b double").select(T.rounded(F.col("a"), 1).alias("a"), T.rounded(F.col("b"), 2).alias("b")).first()
    assert (row.a, row.b) == (2.2, 1.01)


def test_gestalt():
    assert (S.gestalt("", ""), S.gestalt("a", ""), S.gestalt("abcd", "bcde")) == (1.0, 0.0, 0.75)


def test_comment_keys(spark):
    df = spark.createDataFrame([(1, k, f"c{n}", n) for n, k in enumerate(["changed:1", "page:3", "overall:summary", "overall", "changed:1"])] + [(1, "page:9", "  ", 9)], "pair_id long, key string, comment string, seq long")
    assert {r.key: r.comment for r in O.latest_comments(df).collect()} == {"changed:1": "c4", "page:3": "c1", "overall:summary": "c2"}


def test_assignment_of_many_pages(spark):
    """Equal to a plain loop on random scores; the time is linear in the pages."""
    r = random.Random(3)
    pages, scored, want = [], [], set()
    for pair, n in enumerate([1, 2, 17, 40, 300, 20_000]):
        taken = set()
        for i in range(n):
            pages.append((pair, 1, i))
            best, at = 0.0, -1
            for j in range(max(0, i - 8), i + 9):
                if r.random() < (0.5 if n < 1000 else 0.15):
                    s = r.choice([0.2, 0.3, 0.4, 0.5, 0.9])
                    scored.append((pair, i, j, s))
                    if s > 0.3 and s > best and j not in taken:
                        best, at = s, j
            taken.add(at)
            want.add((pair, i, at, best))
    sims = spark.createDataFrame(pd.DataFrame(scored, columns=["pair_id", "i1", "i2", "sim"]), "pair_id long, i1 int, i2 int, sim double")
    rows = spark.createDataFrame(pd.DataFrame(pages, columns=["pair_id", "side", "page_no"]), "pair_id long, side int, page_no int")
    begin = time.time()
    got = [tuple(x) for x in P.assigned(sims, rows).collect()]
    assert len(got) == len(want) and set(got) == want and time.time() - begin < 60


def test_pages_are_built_once(spark):
    """All that a page report reads of the documents is written before."""
    from folioscope.plans import catalog

    plan = catalog.QUERIES["page_diffs"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "documents.parquet" not in plan and "pages-" in plan


def test_anchors_are_compared_for_the_best_alone(spark):
    """Equal to scoring all near pages, with pages that move, repeat, tie, or have no words; one row at most goes on for a first page."""
    r = random.Random(5)
    heads = ["", "total revenue of the group", "notes to the accounts", "total revenue", "a" * 130, "statement of cash flows 2019", "été ﬁne", "total expenses of the group"]
    rows = []
    for pair in range(40):
        n = r.choice([1, 3, 12, 30])
        for side in (1, 2):
            rows += [(pair, side, k, r.choice(heads) + "\n" + " ".join(r.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(r.randint(0, 3)))) for k in range(n - r.randint(0, min(2, n - 1)))]
    pages = spark.createDataFrame(rows, "pair_id long, side int, page_no int, text string")
    near = P.band(P.fingerprints(pages)).select("pair_id", "i1", "i2", S.jaccard(F.col("words1"), F.col("words2"), 0.0).alias("words"), "anchor1", "anchor2")
    scored = near.select("pair_id", "i1", "i2", (0.5 * S.gestalt_of("anchor1", "anchor2") + 0.5 * F.col("words")).alias("sim"))
    want = sorted(map(tuple, P.assigned(scored, pages).collect()))
    assert sorted(map(tuple, P.aligned(pages).collect())) == want and len({x[2] for x in want}) > 20
    best = P.best_of(near)
    assert best.count() == sum(x[2] >= 0 for x in want) < near.count() / 3
    assert "gestalt_of" not in P.aligned(pages)._jdf.queryExecution().executedPlan().toString()
