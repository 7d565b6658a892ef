"""Highlighting: the index against all pairs, on documents of every kind of match."""

import random
import time

import pytest

from folioscope.operators import pages as P

SPECS, LINES = "doc_id long, spec_no long, spec string", "doc_id long, page_no int, bucket int, line string"


def marked(line, spec):
    """Whether a spec marks a line, by the stated rules alone."""
    t, n = line.lower(), spec.strip().lower()
    if len(n) < 4:
        return False
    lw, nw = {x for x in t.split(" ") if x}, {x for x in n.split(" ") if x}
    shared, longest, shortest = len(lw & nw), max(len(lw), len(nw)), min(len(lw), len(nw))
    if longest and shared / longest >= 0.85 and 0.55 <= shortest / longest < 0.75:
        return False
    within = n[:40] in t or (len(t[:40]) >= 6 and t[:40] in n[:40]) or (len(t) >= 12 and t in n)
    return within or (len(lw) >= 4 and shared / len(lw) >= 0.8 and len(lw) / longest >= 0.3)


def made(seed, n_lines, n_specs):
    r = random.Random(seed)
    words = ["total", "net", "Revenue", "of", "the", "group", "12,345", "été", "Straße", "𝒳y", "a", "in", "loss", "note", "7"]
    text = lambda: " ".join(r.choice(words) for _ in range(r.randint(0, 14)))
    specs = [text() if r.random() < 0.8 else " " + text() + "  " for _ in range(n_specs)] + ["abc", "", "    ", "tota", "TOTAL NET"]
    lines = [text() for _ in range(n_lines // 2)]
    while len(lines) < n_lines:
        s = r.choice(specs)
        cut = sorted((r.randint(0, len(s)), r.randint(0, len(s))))
        lines.append(r.choice([s, s.upper(), s[cut[0] : cut[1]], text() + s, s + " " + text(), " ".join(reversed(s.split(" ")))]))
    return lines, specs


@pytest.mark.parametrize("pairs", [0, 700, 10**9])
def test_highlighted(spark, pairs):
    rows, wanted, want = [], [], set()
    for doc in range(6):
        lines, specs = made(doc, 40, 12 + doc)
        rows += [(doc, k % 3, k, x) for k, x in enumerate(lines)]
        wanted += [(doc, k, x) for k, x in enumerate(specs)]
        want |= {(doc, k % 3, k, x, min(hits)) for k, x in enumerate(lines) if (hits := [s for s, y in enumerate(specs) if marked(x, y)])}
    rows.append((99, 0, 0, "a document without specs"))
    got = P.highlighted(spark.createDataFrame(rows, LINES), spark.createDataFrame(wanted, SPECS), pairs)
    assert {tuple(r) for r in got.collect()} == want and len(want) > 100


def test_large_document(spark):
    """20,000 lines and 5,000 specs: the index meets about as many pairs as match, not 100 million."""
    r = random.Random(1)
    vocabulary = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(3, 9))) for _ in range(4000)]
    lines = [" ".join(r.choice(vocabulary) for _ in range(9)) for _ in range(20_000)]
    specs = [lines[r.randrange(20_000)] if k % 2 else " ".join(r.choice(vocabulary) for _ in range(9)) for k in range(5_000)]
    rows = spark.createDataFrame([(1, k // 50, k % 50, x) for k, x in enumerate(lines)], LINES)
    wanted = spark.createDataFrame([(1, k, x) for k, x in enumerate(specs)], SPECS)
    texts = rows.selectExpr("doc_id", "line as t", "struct(page_no, bucket) as at")
    n = P.paired(texts, wanted.withColumnRenamed("spec", "n")).count()
    begin = time.time()
    got = {(r.page_no * 50 + r.bucket, r.spec_no) for r in P.highlighted(rows, wanted).collect()}
    first = {}
    for k, x in enumerate(specs):
        first.setdefault(x, k)
    assert got == {(k, first[x]) for k, x in enumerate(lines) if x in first} and n < 600_000 and time.time() - begin < 120


def test_small_documents_are_dealt_once(spark):
    """Lines and specs of small documents take one shuffle each, by document."""
    from folioscope.plans import catalog

    plan = catalog.QUERIES["highlight_match"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(") == 2
