"""Queries on single texts: cleaning, counting, scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.functions import similarity as S
from folioscope.functions import text as T
from folioscope.operators import lines as L
from folioscope.operators import numbers as N
from folioscope.plans import common as C
from folioscope.sources import revisions as R

QUERIES: dict = {}
ORACLE: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def _docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


def _list(column: str, ranked: str) -> str:
    """A list ordered by value, then by where it stood."""
    return f"list_transform(list_sort(list_transform({column}, lambda q: struct_pack(v := CAST(q AS DOUBLE), i := list_position({ranked}, q), s := q))), lambda q: q.s)"


_TEXTS = f"""
WITH {C.REVISION},
texts AS (SELECT pair_id, coalesce(string_agg(line, chr(10) ORDER BY ord) FILTER (side = 1), '') AS text1,
                 coalesce(string_agg(line, chr(10) ORDER BY ord) FILTER (side = 2), '') AS text2 FROM rev GROUP BY pair_id),
nums AS (SELECT pair_id, {C.numbers("text1")} AS n1, {C.numbers("text2")} AS n2 FROM texts),
sets AS (SELECT *, list_filter(n1, lambda q: list_contains(n2, q)) AS both_, list_filter(n1, lambda q: NOT list_contains(n2, q)) AS o1,
                list_filter(n2, lambda q: NOT list_contains(n1, q)) AS o2 FROM nums),
cmp AS (SELECT pair_id, {_list("both_", "n1")} AS in_both, {_list("o1", "n1")} AS only1, {_list("o2", "n2")} AS only2,
               CAST(len(n1) AS BIGINT) AS count1, CAST(len(n2) AS BIGINT) AS count2,
               {C.rounded("CASE WHEN len(n1) + len(n2) = 0 THEN 1.0 ELSE CAST(len(both_) AS DOUBLE) / (len(n1) + len(n2) - len(both_)) END * 100", 1)} AS similarity_pct,
               {C.rounded("CASE WHEN len(n1) + len(n2) = 0 THEN 1.0 ELSE CAST(2 * len(both_) AS DOUBLE) / (len(n1) + len(n2)) END * 100", 1)} AS dice_pct
        FROM sets)"""


def _texts(spark, sf_dir):
    return R.revised_texts(spark, sf_dir)


@query("number_compare", f"{_TEXTS} SELECT pair_id, array_to_string(in_both, ' ') AS in_both, array_to_string(only1, ' ') AS only1, array_to_string(only2, ' ') AS only2, count1, count2, similarity_pct FROM cmp")
def number_compare(spark, sf_dir):
    out = N.reconciled(_texts(spark, sf_dir))
    return out.select("pair_id", *[F.array_join(c, " ").alias(c) for c in ("in_both", "only1", "only2")], "count1", "count2", "similarity_pct")


@query("number_dice", f"{_TEXTS} SELECT pair_id, dice_pct FROM cmp")
def number_dice(spark, sf_dir):
    return N.reconciled(_texts(spark, sf_dir)).select("pair_id", "dice_pct")


@query(
    "number_sheet",
    f"""{_TEXTS}
SELECT pair_id, CAST(i - 1 AS BIGINT) AS row_no, coalesce(only1[i], '') AS "only_in_AFS1", coalesce(only2[i], '') AS "only_in_AFS2", coalesce(in_both[i], '') AS in_both
FROM (SELECT *, unnest(range(1, greatest(len(in_both), len(only1), len(only2)) + 1)) AS i FROM cmp)""",
)
def number_sheet(spark, sf_dir):
    return N.sheet(N.reconciled(_texts(spark, sf_dir)))


@query("numbers_by_line", f"SELECT doc_id, array_to_string({C.numbers_by_line('text')}, ' ') AS numbers FROM documents")
def numbers_by_line(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.array_join(T.numbers(F.col("text"), "line"), " ").alias("numbers"))


@query("split_lines", f"SELECT doc_id, CAST(i - 1 AS INTEGER) AS line_no, {C.strip('ls[i]')} AS line FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))")
def split_lines(spark, sf_dir):
    rows = _docs(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return rows.select("doc_id", "line_no", T.strip(F.col("line")).alias("line"))


@query("noise_filter", f"WITH {C.REVISION}, s AS (SELECT pair_id, side, ord, {C.strip('line')} AS line FROM rev) SELECT pair_id, side, ord, line FROM s WHERE NOT {C.noise('line')}")
def noise_filter(spark, sf_dir):
    rows = R.revision_lines(spark, sf_dir).select("pair_id", "side", "ord", T.strip(F.col("line")).alias("line"))
    return rows.filter(~T.is_noise(F.col("line")))


@query("normalise_lines", f"WITH {C.REVISION}, n AS (SELECT pair_id, side, ord, {C.normalise('line')} AS norm FROM rev) SELECT *, {C.canonical('norm')} AS canon FROM n")
def normalise_lines(spark, sf_dir):
    rows = R.revision_lines(spark, sf_dir)
    rows = rows.select("pair_id", "side", "ord", T.normalise(T.decomposed(F.col("line"))).alias("norm"))
    return rows.withColumn("canon", T.canonical(F.col("norm")))


@query("decomposed_lines")
def decomposed_lines(spark, sf_dir):
    """All languages: compatibility decomposition before normalising."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return rows.select("doc_id", "line_no", T.normalise(T.decomposed(F.col("line"))).alias("norm"))


@query("doc_type", "SELECT doc_id, CAST(length(coalesce(text, '')) AS BIGINT) AS n_chars, CASE WHEN length(coalesce(text, '')) < 100 THEN 'scanned (no OCR)' ELSE 'digital' END AS doc_type FROM documents")
def doc_type(spark, sf_dir):
    n = F.length(F.coalesce("text", F.lit(""))).cast("long")
    return _docs(spark, sf_dir).select("doc_id", n.alias("n_chars"), F.when(n < 100, "scanned (no OCR)").otherwise("digital").alias("doc_type"))


@query("doc_years", "SELECT doc_id, array_to_string(y, ' ') AS years, list_max(y) AS primary_year FROM (SELECT doc_id, list_sort(list_distinct(list_transform(regexp_extract_all(text, '(?:19|20)\\d{2}'), lambda q: CAST(q AS INTEGER)))) AS y FROM documents)")
def doc_years(spark, sf_dir):
    y = T.years(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", F.array_join(y.cast("array<string>"), " ").alias("years"), F.array_max(y).alias("primary_year"))


@query("word_count", r"SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda q: q <> '')) AS BIGINT) AS n_words FROM documents")
def word_count(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.size(T.words(F.col("text"))).cast("long").alias("n_words"))


@query("word_count_b", f"SELECT doc_id, CAST(coalesce(list_sum(list_transform({C.clean_lines('text')}, lambda q: len(list_filter(string_split(q, ' '), lambda w: w <> '')))), 0) AS BIGINT) AS n_words FROM documents")
def word_count_b(spark, sf_dir):
    lines = T.lines_of(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", F.aggregate(lines, F.lit(0).cast("long"), lambda a, x: a + F.size(T.tokens(x))).alias("n_words"))


@query("page_text", f"WITH {C.REVISION} SELECT pair_id, side, page_no, string_agg(line, chr(10) ORDER BY ord) AS text FROM rev GROUP BY ALL")
def page_text(spark, sf_dir):
    return R.pages(R.revision_lines(spark, sf_dir))


_PAGES = f"WITH {C.REVISION}, pages_ AS (SELECT pair_id, side, page_no, string_agg(line, chr(10) ORDER BY ord) AS text FROM rev GROUP BY ALL)"


@query("page_anchor", f"{_PAGES} SELECT pair_id, side, page_no, left(lower(array_to_string(list_slice(list_filter({C.clean_lines('text')}, lambda q: length(q) > 8), 1, 3), ' ')), 120) AS anchor FROM pages_")
def page_anchor(spark, sf_dir):
    return R.pages(R.revision_lines(spark, sf_dir)).select("pair_id", "side", "page_no", T.anchor(F.col("text")).alias("anchor"))


@query("page_vocabulary", f"{_PAGES} SELECT pair_id, side, page_no, CAST(len(list_distinct(regexp_extract_all(lower(text), '[a-z]{{4,}}'))) AS BIGINT) AS n_words FROM pages_")
def page_vocabulary(spark, sf_dir):
    return R.pages(R.revision_lines(spark, sf_dir)).select("pair_id", "side", "page_no", F.size(T.vocabulary(F.col("text"))).cast("long").alias("n_words"))


_TOKENS = "list_filter(string_split({x}, ' '), lambda q: q <> '')"


@query(
    "token_bigrams",
    f"""WITH {C.REVISION}, t AS (SELECT pair_id, side, ord, list_filter(string_split({C.normalise("line")}, ' '), lambda q: q <> '') AS t FROM rev),
u AS (SELECT pair_id, side, ord, t[1] AS key FROM t WHERE len(t) > 0 UNION SELECT pair_id, side, ord, t[i] || t[i + 1] FROM (SELECT *, unnest(range(1, len(t))) AS i FROM t))
SELECT * FROM u""",
)
def token_bigrams(spark, sf_dir):
    return L.index_entries(R.revision_lines(spark, sf_dir))


@query(
    "scalar_functions",
    r"""SELECT page_id, CASE WHEN length(url) <= 20 THEN url ELSE left(url, 20) || '…' END AS short_url,
       CASE WHEN trim(regexp_replace(url, '[\\/*?:"<>|]', '_', 'g')) = '' THEN 'AFS' ELSE trim(regexp_replace(url, '[\\/*?:"<>|]', '_', 'g')) END AS file_name,
       replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS escaped,
       CAST(length(html) // 1024 AS INTEGER) AS kb, round_even(length(html) * 130 / 72.0, 0) AS pixels FROM pages""",
)
def scalar_functions(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.select(
        "page_id",
        T.shortened(F.col("url"), 20).alias("short_url"),
        T.file_safe(F.col("url")).alias("file_name"),
        T.html_escaped(F.col("html")).alias("escaped"),
        (F.length("html") / 1024).cast("int").alias("kb"),
        F.rint(F.length("html") * 130 / F.lit(72.0)).alias("pixels"),
    )


@query("formatting", "SELECT o_orderkey, format('{:.4f}', o_totalprice) AS f4, format('{:.3f}', " + C.rounded("o_totalprice / 1000", 3) + ") AS f3, " + C.rounded("o_totalprice / 7", 1) + " AS r1, " + C.rounded("o_totalprice / 7", 3) + " AS r3 FROM orders")
def formatting(spark, sf_dir):
    price = F.col("o_totalprice")
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.format_string("%.4f", price).alias("f4"), F.format_string("%.3f", T.rounded(price / 1000, 3)).alias("f3"), T.rounded(price / 7, 1).alias("r1"), T.rounded(price / 7, 3).alias("r3"))


_NUMBERED = f"""WITH {C.REVISION}, both_ AS (
  SELECT a.pair_id, a.ord, {{}} AS n1, {{}} AS n2, a.line AS l1, b.line AS l2 FROM rev a JOIN rev b ON a.pair_id = b.pair_id AND a.ord = b.ord AND a.side = 1 AND b.side = 2)"""


def _aligned_lines(spark, sf_dir):
    return _at_one_place(R.revision_lines(spark, sf_dir))


def _at_one_place(lines):
    first = lines.filter("side = 1").select("pair_id", "ord", F.col("line").alias("l1"))
    return first.join(lines.filter("side = 2").select("pair_id", "ord", F.col("line").alias("l2")), ["pair_id", "ord"])


@query("line_num_diff", _NUMBERED.format(C.numbers("a.line"), C.numbers("b.line")) + " SELECT pair_id, ord, array_to_string(list_sort(list_concat(list_filter(n1, lambda q: NOT list_contains(n2, q)), list_filter(n2, lambda q: NOT list_contains(n1, q)))), ' ') AS num_diff FROM both_")
def line_num_diff(spark, sf_dir):
    rows = _aligned_lines(spark, sf_dir).select("pair_id", "ord", T.numbers(F.col("l1")).alias("n1"), T.numbers(F.col("l2")).alias("n2"))
    either = F.array_union(F.array_except("n1", "n2"), F.array_except("n2", "n1"))
    return rows.select("pair_id", "ord", F.array_join(F.array_sort(either), " ").alias("num_diff"))


_SCORE_B = f"""WITH {C.REVISION}, both_ AS (
  SELECT a.pair_id, a.ord, {C.normalise("a.line")} AS norm1, {C.normalise("b.line")} AS norm2, {C.normalise("a.line", False)} AS whole1, {C.normalise("b.line", False)} AS whole2, {C.numbers("a.line")} AS n1, {C.numbers("b.line")} AS n2
  FROM rev a JOIN rev b ON a.pair_id = b.pair_id AND a.ord = b.ord AND a.side = 1 AND b.side = 2),
can AS (SELECT *, {C.canonical("whole1")} AS canon1, {C.canonical("whole2")} AS canon2 FROM both_),
sim AS (SELECT *, CASE WHEN greatest(length(canon1), length(canon2)) = 0 THEN 1.0 ELSE 1.0 - CAST({C.levenshtein("canon1", "canon2")} AS DOUBLE) / greatest(length(canon1), length(canon2)) END AS sim,
               list_sort(n1) = list_sort(n2) AS agree FROM can),
sc AS (SELECT *, CASE WHEN len(n1) > 0 AND len(n2) > 0 THEN greatest(0.0, least(1.0, sim + CASE WHEN agree THEN 0.04 ELSE -0.06 END)) ELSE sim END AS score,
              list_distinct(list_filter(string_split(norm1, ' '), lambda q: q <> '')) AS w1, list_distinct(list_filter(string_split(norm2, ' '), lambda q: q <> '')) AS w2,
              CASE WHEN length(norm1) <= length(norm2) THEN norm1 ELSE norm2 END AS shorter, CASE WHEN length(norm1) <= length(norm2) THEN norm2 ELSE norm1 END AS longer FROM sim),
st AS (SELECT pair_id, ord, {C.rounded("score", 4)} AS score, CASE WHEN norm1 = norm2 OR canon1 = canon2 OR score >= 0.94 OR (agree AND score >= 0.8) THEN 'same'
  WHEN agree AND len(w1) >= 4 AND len(w2) >= len(w1) AND CAST(len(list_intersect(w1, w2)) AS DOUBLE) / len(w1) >= 0.85 AND CAST(len(w1) AS DOUBLE) / len(w2) >= 0.55 THEN 'same'
  WHEN length(shorter) >= 40 AND NOT regexp_matches(shorter, '[.!?]$') AND starts_with(longer, shorter) THEN 'same' ELSE 'changed' END AS status FROM sc)"""
PLACED = f"""{_SCORE_B},
placed AS (SELECT pair_id, ord, status FROM st UNION ALL SELECT pair_id, ord, CASE side WHEN 1 THEN 'removed' ELSE 'added' END FROM rev r WHERE NOT EXISTS (SELECT 1 FROM st s WHERE s.pair_id = r.pair_id AND s.ord = r.ord))"""


@query("line_score_status", f"{_SCORE_B} SELECT * FROM st")
def line_score_status(spark, sf_dir):
    """Edit-distance score and gates of the lines that stand at the same place of both sides.

    Canonical lines keep bare stamps here, as they do where edit distance matches lines.
    """
    rows = _scored(_both(spark, sf_dir, False))
    return rows.select("pair_id", "ord", T.rounded(F.col("score"), 4).alias("score"), "status")


def _both(spark, sf_dir, alone):
    """(pair_id, ord, added, removed, l1, l2, whole1, whole2): both lines of each place, and what is left of them normalised.

    Lines that are equal, which most are, score as two empty ones do, and so do those that stand alone: nothing of them is held.
    """
    rows = R.places(R.gathered(spark, sf_dir), alone)
    held = lambda c: F.when(F.col("l1") != F.col("l2"), F.col(c)).otherwise("")
    rows = rows.select("pair_id", "ord", F.col("l1").isNull().alias("added"), F.col("l2").isNull().alias("removed"), held("l1").alias("l1"), held("l2").alias("l2"))
    whole = [T.normalise(T.decomposed(F.col(f"l{n}")), False).alias(f"whole{n}") for n in "12"]
    # A generator stands between the two steps of cleaning, or the first would be repeated for each use in the second.
    return rows.select(F.inline(F.array(F.struct("*", *whole))))


def _scored(rows):
    """Rows of _both with score and status."""
    made = [(f"norm{n}", T.without_stamp(F.col(f"whole{n}"))) for n in "12"] + [(f"canon{n}", T.canonical(F.col(f"whole{n}"))) for n in "12"] + [(f"n{n}", T.numbers(F.col(f"l{n}"))) for n in "12"]
    rows = rows.select("pair_id", "ord", "added", "removed", *[c.alias(t) for t, c in made])
    rows = rows.withColumn("score", S.with_numbers(S.levenshtein(F.col("canon1"), F.col("canon2")), F.col("n1"), F.col("n2"), True))
    return rows.withColumn("status", S.status(*[F.col(c) for c in ("norm1", "norm2", "canon1", "canon2", "n1", "n2", "score")]))


def placed(spark, sf_dir):
    """(pair_id, ord, status): the lines of both revisions by their place, where one side may have none."""
    rows = _scored(_both(spark, sf_dir, True))
    return rows.select("pair_id", "ord", F.when(F.col("removed"), "removed").when(F.col("added"), "added").otherwise(F.col("status")).alias("status"))


@query("line_gestalt")
def line_gestalt(spark, sf_dir):
    """Gestalt score of the lines at the same place, second side first."""
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = _at_one_place(R.revision_lines(spark, sf_dir)).repartition(tasks, "pair_id", "ord")  # long lines are the work, not the bytes
    rows = rows.withColumn("norm1", T.normalise(T.decomposed(F.col("l1")))).withColumn("norm2", T.normalise(T.decomposed(F.col("l2"))))
    score = S.with_numbers(S.gestalt_of("norm2", "norm1"), T.numbers(F.col("l1")), T.numbers(F.col("l2")), False)
    return rows.select("pair_id", "ord", T.rounded(score, 4).alias("score"))
