"""Golden cases and properties of line comparison, and its relational forms against the plain ones."""

import random
import time
import tracemalloc
from difflib import SequenceMatcher

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioscope.functions import lines as P
from folioscope.functions import similarity as S
from folioscope.functions import text as T
from folioscope.operators import lines as L
from tests.test_diff_queries import words_apart


@pytest.mark.parametrize(
    ("text", "found"),
    [("6 835", {"6", "835"}), ("total 66 710 and 2024", {"66", "710", "2024"}), ("R217", set()), ("R1,234,567", {"234567"}), ("1,234.56", {"1234.56"}), ("1.234.567", set()), ("12.5%", {"12.5"}), ("note 12a", set()), ("2024", set()), ("Revenue\n835\nCosts", set())],
)
def test_numbers(spark, text, found):
    assert P.numbers(text) == found
    row = spark.createDataFrame([(text,)], "t string").select(T.numbers(F.col("t")).alias("n"), T.numbers(F.col("t"), "line").alias("b")).first()
    assert set(row.n) == found and set(row.b) == P.numbers(text, by_line=True)


@pytest.mark.parametrize(
    ("a", "b", "score", "status"),
    [
        ("TOTAL ASSETS", "Total  assets", 1.0, "same"),
        ("Revenue R1,234,567", "Revenue: R1234567", 0.9143, "same"),
        ("Total revenue for the year 12,345", "Total revenue for the year 12,346", 0.9097, "changed"),
        ("Trade receivables 500", "Trade receivables 900", 0.8924, "changed"),
        ("The directors are responsible for the statements", "The directors are accountable for the statements", 0.875, "same"),
        ("Revenue increased by 5 percent", "Revenue decreased by 5 percent", 0.9733, "same"),
        ("used by the group under standard IAS Consolidated", "used by the group under standard IAS Consolidated and also Separate Financial Statements", 0.7153, "same"),
        ("The group recognises revenue when control passes", "The group recognises revenue when control passes for 2,500 contracts", 0.8276, "same"),
    ],
)
def test_score_and_status(a, b, score, status):
    x, y = P.line(a, "a"), P.line(b, "a")
    got = P.score(y, x, "a")
    assert round(got, 4) == score and P.status(x, y, got) == status


def test_unlike_lines_do_not_match():
    assert [r["status"] for r in P.matched(["Inventory"], ["Goodwill impairment"])] == ["added", "removed"]


def test_edit_distance_of_receivables():
    x, y = P.line("trade receivables 500", "b"), P.line("trade receivables 900", "b")
    assert round(1 - P._edit(x.compared, y.compared) / 21, 6) == 0.952381


def test_word_diff():
    got = P.word_diff("Total revenue was 12,345 Rand", "total revenue is 12,346 Rand net")
    assert got == [("Total", "same"), ("revenue", "same"), ("was", "removed"), ("12,345", "removed"), ("is", "added"), ("12,346", "added"), ("Rand", "same"), ("net", "added")]


def test_merge(spark):
    text = "This is a long wrapped\nline continues here\nNext Heading\nnext heading\nshort one.\nlower after stop"
    row = spark.createDataFrame([(text,)], "t string").select(L.merged(T.lines_of(F.col("t"))).alias("m")).first()
    assert row.m == ["This is a long wrapped line continues here", "Next Heading", "short one.", "lower after stop"]


@pytest.mark.parametrize(("line", "noise"), [("2024", True), ("(1234)", True), ("- 40 -", True), ("Page 3 of 10", True), ("page 3", True), ("12345", False), ("abc", True), ("-----", True), ("", True)])
def test_noise(spark, line, noise):
    assert spark.createDataFrame([(line,)], "t string").select(T.is_noise(F.col("t"))).first()[0] is noise


WORDS = st.lists(st.sampled_from("alpha beta gamma delta omega 12 345 rand net Total".split()), min_size=0, max_size=9).map(" ".join)


@settings(max_examples=60, deadline=None)
@given(st.lists(WORDS, max_size=7), st.lists(WORDS, max_size=7), st.sampled_from("ab"))
def test_every_line_is_accounted_for(first, second, engine):
    rows = P.matched(first, second, engine)
    n = lambda *kinds: sum(r["status"] in kinds for r in rows)
    assert n("same", "changed", "added") == len(second) and n("same", "changed", "removed") == len(first)


@settings(max_examples=80, deadline=None)
@given(WORDS, WORDS)
def test_word_diff_rebuilds_both_sides(a, b):
    got = P.word_diff(a, b)
    assert [w for w, t in got if t != "added"] == a.split()
    assert [w.lower() for w, t in got if t != "removed"] == b.lower().split()


def slow_match(first, second, engine):
    """Matching as described, without bounds or shortcuts."""
    x, y = [P.line(t, engine) for t in first], [P.line(t, engine) for t in second]
    used, out = set(), []
    for line in y:
        hits = [k for k, o in enumerate(x) if set(o.keys) & set(line.keys) and k not in used] or [k for k in range(len(x)) if k not in used]
        best, at = 0.0, -1
        for k in hits[:40]:
            s = P.score(line, x[k], engine)
            if s > best:
                best, at = s, k
        if at >= 0 and best >= S.RELATED:
            used.add(at)
            out.append((x[at].text, line.text, round(best, 4)))
        else:
            out.append(("", line.text, 0.0))
    return out


def test_bounds_change_nothing():
    r = random.Random(2)
    words = "alpha beta gamma delta omega 12 345 rand net Total sum of all parts".split()
    for _ in range(120):
        first, second = ([" ".join(r.choice(words) for _ in range(r.randint(1, 9))) for _ in range(r.randint(0, 12))] for _ in range(2))
        got = [(q["line1"], q["line2"], q["similarity"]) for q in P.matched(first, second) if q["status"] != "removed"]
        assert got == slow_match(first, second, "a")


def test_compared_rows(spark):
    df = spark.createDataFrame([(1, "Alpha beta gamma\nRemoved line here", "alpha  beta gamma\nBrand new words"), (2, None, "")], "pair_id long, text1 string, text2 string")
    rows = {(r.pair_id, r.status) for r in L.compared(df).collect()}
    assert rows == {(1, "same"), (1, "added"), (1, "removed")}


def test_free_places():
    r = random.Random(4)
    free, left = P.Free(300), list(range(300))
    for _ in range(300):
        assert free.some(7) == left[:7] and free.first(120) == next((k for k in left if k >= 120), 300)
        gone = r.choice(left)
        assert gone in free
        free.take(gone)
        left.remove(gone)
        assert gone not in free
    assert free.some(3) == [] and free.first() == 300


def test_lines_without_keys_in_common_take_linear_time():
    """Every second line falls back to the first free lines, and takes one: the places taken must not be walked again."""
    n = 6000
    first = [f"{k:05d}x note on the accounts of the year" for k in range(n)]
    second = [f"y{k:05d}x note on the accounts of the year" for k in range(n)]
    begin = time.time()
    rows = P.matched([x.replace(" ", "") for x in first], [x.replace(" ", "") for x in second], "b")
    assert len(rows) == n and all(x["status"] in ("same", "changed") for x in rows) and time.time() - begin < 60


def test_word_diff_of_long_lines():
    """Equal to the first of the best scripts on random lines; memory does not grow with the product of the lengths."""
    r = random.Random(6)
    for _ in range(400):
        words = "abcdeFGH"[: r.choice([1, 2, 4, 8])]
        a, b = (" ".join(r.choice(words) for _ in range(r.randint(0, 12))) for _ in range(2))
        assert P.word_diff(a, b) == words_apart(a, b), (a, b)
    old = [f"w{r.randrange(900)}" for _ in range(6000)]
    new = [w if r.random() < 0.8 else f"w{r.randrange(900)}" for w in old]
    tracemalloc.start()
    got = P.word_diff(" ".join(old), " ".join(new))
    top = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [w for w, t in got if t != "added"] == old and [w for w, t in got if t == "added"] and top < 12 << 20


def test_merge_of_long_texts(spark):
    """Blocks of the fold leave no trace: equal to a plain loop, in linear time."""
    r = random.Random(9)
    pieces = ["This is a long wrapped line", "continues here and on", "Next Heading of it.", "NEXT HEADING OF IT.", "short one", "Ends with a stop here."]
    texts = ["\n".join(r.choice(pieces) for _ in range(n)) for n in (0, 1, 255, 256, 257, 513, 60_000)] + ["\n".join(["Same line again"] * 700), "Begins like this one\n" + "\n".join(["goes on in lower case"] * 900)]
    want = []
    for text in texts:
        done = []
        for x in text.split("\n") if text else []:
            if done and done[-1].lower() == x.lower():
                continue
            if done and done[-1][-1] not in ".!?;:" and x[0].islower() and len(done[-1]) >= 15:
                done[-1] += " " + x
            else:
                done.append(x)
        want.append(done)
    df = spark.createDataFrame(list(enumerate(texts)), "k long, t string")
    begin = time.time()
    got = {q.k: q.m for q in df.select("k", L.merged(T.lines_of(F.col("t"))).alias("m")).collect()}
    assert [got[k] for k in range(len(texts))] == want and time.time() - begin < 60


def test_free_places_of_a_list():
    r = random.Random(5)
    free, places = P.Free(200), sorted(r.sample(range(200), 120))
    left = list(places)
    for _ in range(120):
        assert free.among(places, 9) == left[:9]
        k = left.pop(r.randrange(min(9, len(left))))
        free.take(k)
    assert free.among(places, 9) == [] == places


def test_lines_with_one_key_in_common_take_linear_time():
    """All lines begin with one word: each second line meets some of them, not all."""
    n = 20_000
    first = [f"note {k:06d}" for k in range(n)]
    begin = time.time()
    rows = P.matched(first, first, "a")
    assert [x["status"] for x in rows] == ["same"] * n and [x["line1"] for x in rows] == first and time.time() - begin < 90


def test_candidates_of_a_hot_key(spark):
    rows = [(1, s, k, f"note {k % 3} {k}") for s in (1, 2) for k in range(300)]
    df = spark.createDataFrame(rows, "pair_id long, side int, ord int, line string")
    got = {}
    for q in L.candidates(df).collect():
        got.setdefault(q.ord2, set()).add(q.ord1)
    keys = {k: {"note", f"note{k % 3}", f"{k % 3}{k}"} for k in range(300)}
    assert got == {k: set(sorted(j for j in range(300) if keys[j] & keys[k])[:40]) for k in range(300)}


def _lines_of_words(seed, n, words):
    r = random.Random(seed)
    return [" ".join(r.choice(words) for _ in range(r.randrange(1, n))) for _ in range(40)]


def test_blocks_are_those_of_difflib():
    """Short and long texts, few letters, edits and texts that have little in common."""
    r = random.Random(11)
    true = lambda a, b: SequenceMatcher(None, a, b, autojunk=False).ratio()
    for k in range(1500):
        letters = "abcdefgh"[: r.choice([1, 2, 3, 8])]
        a = "".join(r.choice(letters) for _ in range(r.choice([5, 40, 250])))
        b = "".join(c if r.random() < 0.95 else r.choice(["", "xy", "a"]) for c in a) if k % 2 else "".join(r.choice(letters) for _ in range(r.choice([5, 40, 250])))
        assert S.gestalt(a, b) == (true(a, b) if a and b else float(a == b)), (a, b)
    lines = _lines_of_words(3, 90, ["the", "group", "then", "assets", "of", "12,345", "liabilities", "other"])
    for a, b in zip(lines, lines[1:] + lines[:1], strict=True):
        assert S.gestalt(a, b) == true(a, b) and S.gestalt(a, a.replace("the", "that")) == true(a, a.replace("the", "that"))


def test_long_lines_are_searched_once():
    """Not for each block, letter by letter."""
    r = random.Random(2)
    a = " ".join("".join(r.choice("etaoinshrdlu") for _ in range(r.randrange(2, 9))) for _ in range(4000))
    b = a.replace("the", "that")
    begin = time.process_time()
    assert 0.97 < S.gestalt(b, a) < 1 and time.process_time() - begin < 2


def test_copies_are_not_scored(monkeypatch):
    asked = []
    monkeypatch.setattr(P, "score", lambda x, y, engine: asked.append(1) or 0.0)
    lines = ["The directors are responsible", "Total assets 1,234", "the directors are RESPONSIBLE", "Cash 12", "Grundstück"]
    for engine in "ab":
        got = P.matched(lines, [x.upper() for x in lines], engine)
        assert [r["line1"] for r in got] == lines and not asked


def test_batches_have_a_bound(spark):
    """By rows alone a batch of whole texts grew with the partition, and results came a pair at a time."""
    for name in ("maxRecordsPerBatch", "maxBytesPerBatch"):
        spark.conf.unset(f"spark.sql.execution.arrow.{name}")
    rows = [(k, f"Total {k} of the ledger\nCash", f"Total {k} of that ledger\nCash\nNew line") for k in range(3000)]
    out = L.compared(spark.createDataFrame(rows, "pair_id long, text1 string, text2 string"))
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 512
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").removesuffix("b")) <= 4 << 20
    assert out.groupBy("pair_id").count().groupBy("count").count().collect() == [(3, 3000)]


def test_a_diff_is_made_once(spark):
    from folioscope.plans import catalog

    for name in ("highlight_specs", "text_report"):
        plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("MapIn") <= 1, name



def _repeating(seed, size):
    """A text of sentences that repeat, and the same with other words in each."""
    r = random.Random(seed)
    words = ["".join(r.choice("etaoin") for _ in range(r.randrange(2, 8))) for _ in range(9)]
    unit = " ".join(r.choice(words) for _ in range(14)) + " the ledger. "
    a = (unit * (size // len(unit) + 1))[:size]
    return a, a.replace("the", "that").replace(words[0], words[1], 3)


def test_text_that_repeats_is_searched_by_ranks():
    for k in range(12):
        a, b = _repeating(k, 1500)
        assert S.in_blocks(a, b) == sum(x.size for x in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks())
    a, b = "a" * 199 + "b", "c" + "a" * 150 + "d" + "a" * 48
    assert S.in_blocks(a, b) == sum(x.size for x in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks())


def test_text_that_repeats_takes_little_time():
    """Its common runs grow with the square of its length; over 50 s went into them here."""
    a = " ".join("the" if k % 7 == 6 else "thndedor" for k in range(1200))
    begin = time.process_time()
    assert 0.97 < S.gestalt(a, a.replace("the", "that")) < 0.98 and time.process_time() - begin < 5


def test_texts_are_derived_whole(spark, tmp_path):
    """A document's revision needs no shuffle of its lines; ids that repeat or are missing are pairs as before."""
    from folioscope.sources import revisions as R

    r = random.Random(4)
    text = lambda: "\n".join(r.choice(["the cash 12", "", "The Group", "é 9 the", "  x"]) for _ in range(r.randrange(1, 40)))
    rows = [(k // 2 if k % 5 else None, text()) for k in range(60)] + [(-7, text()), (900, None), (901, ""), (902, "\n"), (1 << 40, text())]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for sf_dir in (str(tmp_path), "/root/testdata/sf0.001"):
        got, want = R.revised_texts(spark, sf_dir), R.texts(R.revision_lines(spark, sf_dir))
        assert got.schema.simpleString() == want.schema.simpleString()
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) != []
    plan = R.revised_texts(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan


def test_the_index_has_what_lines_ask_for():
    """Keys of lines without a copy at first, all others once a line with copies can take none of them."""
    r = random.Random(8)
    words = "alpha beta gamma delta omega 12 345 rand".split()
    for _ in range(150):
        first, second = ([" ".join(r.choice(words) for _ in range(r.randint(1, 4))) for _ in range(r.randint(0, 25))] for _ in range(2))
        got = [(q["line1"], q["line2"], q["similarity"]) for q in P.matched(first, second * 2) if q["status"] != "removed"]
        assert got == slow_match(first, second * 2, "a")


@pytest.mark.parametrize("second", ["İx equal", "i̇x equal", "ΣΑΣ of all", "σας of all", "x equal", "and more", "ǆ more", "𝐚 more", "Page one", ""])
def test_only_texts_that_need_it_are_folded(spark, second):
    """A line that equals or continues the one before it is met whatever its first letter; others leave the text as it is."""
    from pyspark.sql import functions as F

    for first in ("İx equal", "ΣΑΣ of all", "X EQUAL", "A line of text without an end", "Ends. here."):
        df = spark.createDataFrame([([first, second, "Last line"],)], "x array<string>")
        got, lower, small = df.select(L.merged(F.col("x")), F.lower(F.lit(first)) == F.lower(F.lit(second)), F.lit(second).rlike(r"^\p{Ll}")).first()
        joined = small and len(first) >= 15 and first[-1] not in ".!?;:"
        assert got == ([first, "Last line"] if lower else [f"{first} {second}", "Last line"] if joined else [first, second, "Last line"])
    plan = df.select(L.merged(F.col("x")))._jdf.queryExecution().optimizedPlan().toString()
    assert "exists(" in plan


@pytest.mark.parametrize("engine", ["a", "b"])
def test_no_candidate_is_left_out(engine):
    """The best line may be any of those that share a key, or of all that are free, not one of the first 40 alone."""
    first = [f"note {'abcdefghij'[k % 10] * 9} {'klmnopqrst'[k // 10] * 9} of the year" for k in range(100)]
    for change in (lambda x: x + " end", lambda x: "xx" + x.replace(" ", "")):
        second = [change(x) for x in reversed(first)]
        kept = first if change("") == " end" else [x.replace(" ", "") for x in first]
        rows = P.matched(kept, second, engine)
        assert [(q["line1"], q["line2"]) for q in rows] == list(zip(reversed(kept), second, strict=True))


@pytest.mark.parametrize("engine", ["a", "b"])
def test_matching_of_many_lines(engine):
    """Every line of a key compared, with all ties, against the rules alone."""
    r = random.Random(12)
    words = "alpha beta gamma 12 345 Total of, all é 𝒳y !!!".split()
    for _ in range(8):
        first, second = ([" ".join(r.choice(words) for _ in range(r.randint(1, 5))) for _ in range(90)] for _ in range(2))
        second += r.choices(first, k=20)
        x, y = [P.line(t, engine) for t in first], [P.line(t, engine) for t in second]
        free, want = dict(enumerate(x)), []
        for one in y:
            hits = list(dict.fromkeys(k for key in one.keys for k in free if key in free[k].keys))
            scores = [(P.score(one, free[k], engine), k) for k in (sorted(hits) if engine == "a" else hits) or free]
            best = max((s for s, _ in scores), default=0.0)
            at = next((k for s, k in scores if s == best), -1) if best >= S.RELATED else -1
            want.append((free.pop(at).text, one.text, round(best, 4)) if at >= 0 else ("", one.text, 0.0))
        assert [(q["line1"], q["line2"], q["similarity"]) for q in P.matched(first, second, engine) if q["status"] != "removed"] == want
