"""Queries on pairs of texts: what a task does with a pair against the joins of single lines, on odd documents."""

import random

import pytest

from pyspark.sql import functions as F

from folioscope.functions import text as T
from folioscope.operators import lines as L
from folioscope.plans import catalog
from folioscope.plans import text_queries as Q
from folioscope.sources import revisions as R


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Documents that share an id, empty and null ones, lines that repeat, lines that are not ASCII."""
    r = random.Random(7)
    words = ["the", "total", "of", "Net", "12,345", "7", "été", "ﬁne", "​x", "a\tb", "", "--", "2019"]
    text = lambda n: "\n".join(r.choice(["the total of the 12 345 group", "Page 3", " ".join(r.choice(words) for _ in range(r.randint(0, 30)))]) for _ in range(n))
    docs = [(k // 2 if k < 8 else k, text(r.randint(1, 60))) for k in range(30)] + [(40, ""), (41, None), (42, "\n\n"), (43, "the\n" * 120), (5, text(3)), (-3, text(30))]
    folder = str(tmp_path_factory.mktemp("odd"))
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    return folder


@pytest.mark.parametrize("whole", [-1, 400, 1 << 20])
def test_line_candidates(spark, odd, monkeypatch, whole):
    """Pairs taken whole, and those joined by key, give the rows of the join of all keys."""
    monkeypatch.setattr(L, "WHOLE", whole)
    got = sorted(map(tuple, catalog.QUERIES["line_candidates"](spark, odd).collect()))
    assert got == sorted(map(tuple, L.candidates(R.revision_lines(spark, odd)).collect())) and len(got) > 3000


def test_keys_of_short_pairs_are_not_dealt(spark):
    """A short pair is one row of one shuffle: no key of a line is joined or shuffled."""
    rows = L.candidates_in_pairs(R.common_lines(R.gathered(spark, "/root/testdata/sf0.001")))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan


def joined(spark, folder):
    """The lines of both revisions by their place, by a join of all lines."""
    lines = R.revision_lines(spark, folder)
    side = lambda n: lines.filter(F.col("side") == n).select("pair_id", "ord", F.col("line").alias(f"l{n}"))
    return side(1).join(side(2), ["pair_id", "ord"], "full")


def ordered(rows):
    return sorted(map(tuple, rows.collect()), key=repr)


def test_places(spark, odd):
    """Documents that share an id meet each other's lines too."""
    want = joined(spark, odd)
    assert ordered(R.places(R.gathered(spark, odd), True)) == ordered(want)
    assert ordered(R.places(R.gathered(spark, odd), False)) == ordered(want.filter("l1 is not null and l2 is not null"))


def test_equal_lines_score_as_empty_ones(spark, odd):
    """Scores and status of all lines, none of them held back."""
    rows = joined(spark, odd).filter("l1 is not null and l2 is not null").withColumns({"added": F.lit(False), "removed": F.lit(False)})
    rows = rows.withColumns({f"whole{n}": T.normalise(T.decomposed(F.col(f"l{n}")), False) for n in "12"})
    want = Q._scored(rows).select("pair_id", "ord", T.rounded(F.col("score"), 4).alias("score"), "status")
    got = ordered(catalog.QUERIES["line_score_status"](spark, odd))
    assert got == ordered(want) and {x[3] for x in got} == {"same", "changed"}


@pytest.mark.parametrize("name", ["line_score_status", "summary_table", "page_status_flag", "page_pct_band"])
def test_lines_of_one_place_are_not_joined(spark, name):
    plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
