"""Queries on pairs of texts: merging, candidates, matching, page alignment."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from folioscope.functions import similarity as S
from folioscope.functions import text as T
from folioscope.operators import lines as L
from folioscope.operators import pages as P
from folioscope.operators import reports as O
from folioscope.plans import common as C
from folioscope.sources import revisions as R
from folioscope.sources.scratch import once

QUERIES: dict = {}
ORACLE: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def _lines(spark, sf_dir):
    return R.revision_lines(spark, sf_dir)


def _diff(spark, sf_dir, engine="a"):
    return L.compared(R.revised_texts(spark, sf_dir), engine)


_MERGED = f"""WITH {C.REVISION},
texts AS (SELECT pair_id, side, string_agg(line, chr(10) ORDER BY ord) AS text FROM rev GROUP BY ALL),
cl AS (SELECT pair_id, side, {C.clean_lines("text")} AS ls FROM texts),
merged AS (SELECT pair_id, side, CASE WHEN len(ls) = 0 THEN [] ELSE list_reduce(list_transform(ls, lambda q: [q]), lambda acc, x:
    CASE WHEN lower(acc[-1]) = lower(x[1]) THEN acc
         WHEN NOT regexp_matches(acc[-1], '[.!?;:]$') AND regexp_matches(x[1], '^\\p{{Ll}}') AND length(acc[-1]) >= 15
         THEN list_concat(acc[1:len(acc) - 1], [acc[-1] || ' ' || x[1]])
         ELSE list_concat(acc, x) END) END AS m FROM cl)"""


@query("merge_lines", f"{_MERGED} SELECT pair_id, side, CAST(i - 1 AS INTEGER) AS line_no, m[i] AS line FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM merged)")
def merge_lines(spark, sf_dir):
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "line"))), lambda x: x["line"]), "\n")
    rows = _lines(spark, sf_dir).groupBy("pair_id", "side").agg(text.alias("text"))
    return rows.select("pair_id", "side", F.posexplode(L.merged(T.lines_of(F.col("text")))).alias("line_no", "line"))


_KEYS = f"""WITH {C.REVISION},
t AS (SELECT pair_id, side, ord, list_filter(string_split({C.normalise("line")}, ' '), lambda q: q <> '') AS t FROM rev),
keys AS (SELECT pair_id, side, ord, t[1] AS key FROM t WHERE len(t) > 0 UNION SELECT pair_id, side, ord, t[i] || t[i + 1] FROM (SELECT *, unnest(range(1, len(t))) AS i FROM t)),
hits AS (SELECT b.pair_id, b.ord AS ord2, list_sort(list(DISTINCT a.ord)) AS found FROM keys a JOIN keys b ON a.pair_id = b.pair_id AND a.key = b.key AND a.side = 1 AND b.side = 2 GROUP BY ALL)"""


@query("line_candidates", f"{_KEYS} SELECT pair_id, ord2, unnest(found[1:40]) AS ord1 FROM hits")
def line_candidates(spark, sf_dir):
    """A short pair is taken by one task, which holds its index; the keys of long ones are dealt and joined."""
    docs = R.gathered(spark, sf_dir).withColumn("size", F.sum(F.length("text")).over(Window.partitionBy("pair_id")))
    short, long = (docs.filter(x).select("pair_id", "text") for x in (F.col("size") <= L.WHOLE, F.col("size") > L.WHOLE))
    return L.candidates_in_pairs(R.common_lines(short)).unionByName(L.candidates(R.lines_of(long)))


@query("line_diff_a")
def line_diff_a(spark, sf_dir):
    return _diff(spark, sf_dir)


@query("line_diff_b")
def line_diff_b(spark, sf_dir):
    return _diff(spark, sf_dir, "b").drop("word_diff")


@query("diff_by_status")
def diff_by_status(spark, sf_dir):
    return _diff(spark, sf_dir).filter(F.col("status").isin("changed", "added", "removed")).select("pair_id", "seq", "status", "line1", "line2")


@query("removed_lines")
def removed_lines(spark, sf_dir):
    return O.line_sheet(_diff(spark, sf_dir), "removed")


@query("changed_words")
def changed_words(spark, sf_dir):
    diff = _diff(spark, sf_dir).filter("status = 'changed'")
    return diff.select("pair_id", "seq", *[F.transform(F.filter("word_diff", _tag(t)), lambda x: x["word"]).alias(t) for t in ("removed", "added")])


def _tag(name: str):
    return lambda x: x["tag"] == name


_PAGES = f"""WITH {C.REVISION}, pages_ AS (SELECT pair_id, side, page_no, string_agg(line, chr(10) ORDER BY ord) AS text FROM rev GROUP BY ALL),
v AS (SELECT pair_id, side, page_no, list_distinct(regexp_extract_all(lower(text), '[a-z]{{4,}}')) AS w FROM pages_),
band AS (SELECT a.pair_id, a.page_no AS i1, b.page_no AS i2, a.w AS w1, b.w AS w2 FROM v a JOIN v b ON a.pair_id = b.pair_id AND a.side = 1 AND b.side = 2 AND b.page_no BETWEEN a.page_no - 8 AND a.page_no + 8),
scored AS (SELECT pair_id, i1, i2, len(list_intersect(w1, w2)) AS both_, len(w1) + len(w2) - len(list_intersect(w1, w2)) AS either_ FROM band),
sims AS (SELECT pair_id, i1, i2, CASE WHEN either_ = 0 THEN 0.0 ELSE CAST(both_ AS DOUBLE) / either_ END AS sim FROM scored)"""


def _pages(spark, sf_dir):
    return R.pages(_lines(spark, sf_dir))


@query("page_band_join", f"{_PAGES} SELECT pair_id, i1, i2 FROM band")
def page_band_join(spark, sf_dir):
    return P.band(_pages(spark, sf_dir).select("pair_id", "side", "page_no")).select("pair_id", "i1", "i2")


@query("page_jaccard", f"{_PAGES} SELECT pair_id, i1, i2, {C.rounded('sim', 6)} AS sim FROM sims")
def page_jaccard(spark, sf_dir):
    near = P.band(P.fingerprints(_pages(spark, sf_dir)).select("pair_id", "side", "page_no", "words"))
    return near.select("pair_id", "i1", "i2", T.rounded(S.jaccard(F.col("words1"), F.col("words2"), 0.0), 6).alias("sim"))


@query("page_alignment")
def page_alignment(spark, sf_dir):
    return P.aligned(_pages(spark, sf_dir))


_ALIGNED = f"""{_PAGES},
firsts AS (SELECT pair_id, list(page_no ORDER BY page_no) AS firsts FROM pages_ WHERE side = 1 GROUP BY pair_id),
near AS (SELECT pair_id, list(struct_pack(i1 := i1, i2 := i2, sim := sim) ORDER BY i1, i2) AS near FROM sims WHERE sim > 0.30 GROUP BY pair_id),
folded AS (SELECT pair_id, list_reduce(list_concat([[struct_pack(i1 := -1, i2 := -2, sim := CAST(0 AS DOUBLE))]], list_transform(firsts, lambda i: [struct_pack(i1 := i, i2 := -1, sim := CAST(0 AS DOUBLE))])),
    lambda acc, x: list_concat(acc, [list_reduce(list_concat([x[1]], list_filter(coalesce(near, []), lambda q: q.i1 = x[1].i1 AND NOT list_contains(list_transform(acc, lambda d: d.i2), q.i2))),
      lambda best, q: CASE WHEN q.sim > best.sim THEN q ELSE best END)])) AS r FROM firsts LEFT JOIN near USING (pair_id)),
alignment AS (SELECT pair_id, r.i1 AS i1, r.i2 AS i2, {C.rounded("r.sim", 3)} AS sim FROM (SELECT pair_id, unnest(r[2:]) AS r FROM folded))"""


@query("page_alignment_words", f"{_ALIGNED} SELECT pair_id, i1, i2, sim FROM alignment")
def page_alignment_words(spark, sf_dir):
    """Alignment by vocabulary alone, which SQL can say too."""
    return P.aligned(_pages(spark, sf_dir), structural=False)


@query("alignment_counts", f"{_ALIGNED} SELECT pair_id, CAST(count(*) FILTER (i2 >= 0) AS BIGINT) AS matched, CAST(count(*) FILTER (i2 < 0) AS BIGINT) AS unmatched FROM alignment GROUP BY pair_id")
def alignment_counts(spark, sf_dir):
    rows = page_alignment_words(spark, sf_dir)
    return rows.groupBy("pair_id").agg(F.count_if(F.col("i2") >= 0).alias("matched"), F.count_if(F.col("i2") < 0).alias("unmatched"))


@query("paired_pages", f"{_ALIGNED} SELECT pair_id, i1, i2 FROM alignment WHERE i2 >= 0")
def paired_pages(spark, sf_dir):
    return page_alignment_words(spark, sf_dir).filter("i2 >= 0").select("pair_id", "i1", "i2")


@query("unmatched_pages", f"{_ALIGNED} SELECT a.pair_id, a.i1 AS page1, CAST(len({C.clean_lines('p.text')}) AS BIGINT) AS removed FROM alignment a JOIN pages_ p ON a.pair_id = p.pair_id AND a.i1 = p.page_no AND p.side = 1 WHERE a.i2 < 0")
def unmatched_pages(spark, sf_dir):
    """First-side pages without a partner; all their lines count as removed."""
    pages = _pages(spark, sf_dir)
    matched = P.aligned(pages, structural=False).filter("i2 >= 0").select("pair_id", F.col("i1").alias("page_no"))
    rest = pages.filter("side = 1").join(matched, ["pair_id", "page_no"], "left_anti")
    return rest.select("pair_id", F.col("page_no").alias("page1"), F.size(T.lines_of(F.col("text"))).cast("long").alias("removed"))


def _page_text(pages, side):
    return pages.filter(F.col("side") == side).select("pair_id", F.col("page_no").alias(f"i{side}"), F.col("text").alias(f"text{side}"))


def _page_lines(pages, alignment):
    """The line diffs of each aligned pair of pages: (pair_id, i1) and the columns of a diff."""
    both = alignment.filter("i2 >= 0").join(_page_text(pages, 1), ["pair_id", "i1"]).join(_page_text(pages, 2), ["pair_id", "i2"])
    return L.compared(both.select("pair_id", "i1", "text1", "text2"), keys=("pair_id", "i1"))


def _aligned_pages(spark, sf_dir):
    """Pages and their alignment, both computed once: five steps of a page report read the pages."""
    pages = once(_pages(spark, sf_dir), "pages")
    return pages, once(P.aligned(pages), "alignment")


def _page_diffs(spark, sf_dir):
    """The comparison of each aligned pair of pages, then the unmatched pages."""
    pages, alignment = _aligned_pages(spark, sf_dir)
    return _page_rows(pages, alignment, _page_lines(pages, alignment))


def _page_rows(pages, alignment, lines):
    text = lambda side: _page_text(pages, side)
    counts = L.status_counts(lines, "pair_id", "i1")
    # Texts are asked for by pages without a partner alone.
    own = text(1).join(alignment.filter("i2 < 0").select("pair_id", "i1"), ["pair_id", "i1"], "left_semi")
    rows = alignment.join(counts, ["pair_id", "i1"], "left").join(own, ["pair_id", "i1"], "left")
    unmatched = F.col("i2") < 0
    return rows.select(
        "pair_id",
        (F.col("i1") + 1).alias("page1"),
        F.when(~unmatched, F.col("i2") + 1).alias("page2"),
        F.col("sim").alias("align_sim"),
        *[F.coalesce(f"n_{s}", F.lit(0)).alias(s) for s in ("same", "changed", "added")],
        F.when(unmatched, F.size(T.lines_of(F.col("text1"))).cast("long")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("removed"),
        F.coalesce("n_total", F.lit(0)).alias("total_lines"),
        F.coalesce("pct_same", F.lit(0.0)).alias("pct_same"),
        unmatched.alias("unmatched"),
    )


def page_issue_rows(spark, sf_dir):
    pages, alignment = _aligned_pages(spark, sf_dir)
    return _issue_rows(alignment, _page_lines(pages, alignment))


def _issue_rows(alignment, lines):
    """The first issues of each aligned pair of pages, as many as a report shows, with all columns of a diff."""
    rows = O.first_issues(lines, ["pair_id", "i1"]).join(alignment.select("pair_id", "i1", "i2"), ["pair_id", "i1"])
    return rows.withColumn("page1", F.col("i1") + 1).withColumn("page2", F.col("i2") + 1)


@query("api_document")
def api_document(spark, sf_dir):
    from folioscope.operators import numbers as N

    pages, alignment = _aligned_pages(spark, sf_dir)
    lines = once(_page_lines(pages, alignment), "page-lines")
    pages2 = pages.filter("side = 2").groupBy("pair_id").agg(F.count(F.lit(1)).alias("pages2"))
    rows = _page_rows(pages, alignment, lines).join(pages2, "pair_id", "left").fillna(0, ["pages2"])
    return O.api_document(once(_diff(spark, sf_dir), "diff"), N.reconciled(R.revised_texts(spark, sf_dir)), rows, _issue_rows(alignment, lines))


@query("page_pair")
def page_pair(spark, sf_dir):
    """The third pair of pages of each comparison, looked up by its place."""
    rows = _page_diffs(spark, sf_dir).withColumn("pair_index", F.row_number().over(Window.partitionBy("pair_id").orderBy("page1")) - 1)
    return rows.filter("pair_index = 2").select("pair_id", "pair_index", "page1", "page2", "same", "changed", "added", "removed")


@query("sheet_page_alignment")
def sheet_page_alignment(spark, sf_dir):
    from folioscope.plans.report_queries import comments

    return O.alignment_sheet(_page_diffs(spark, sf_dir), O.latest_comments(comments(spark, sf_dir)))


@query("page_diffs")
def page_diffs(spark, sf_dir):
    rows = _page_diffs(spark, sf_dir)
    issues = F.col("changed") + F.col("added") + F.col("removed")
    return rows.withColumn("flag", O.issues_flag(issues)).withColumn("band", O.pct_band(F.col("pct_same"))).withColumn("badge", O.badge(F.col("unmatched"), issues))


@query("page_diff_counts")
def page_diff_counts(spark, sf_dir):
    return _page_diffs(spark, sf_dir).filter("not unmatched").select("pair_id", "page1", "page2", "same", "changed", "added", "removed", "total_lines", "pct_same")


@query("page_issues")
def page_issues(spark, sf_dir):
    return page_issue_rows(spark, sf_dir).select("pair_id", "page1", "page2", "seq", "status", "line1", "line2", "place")


@query("status_counts")
def status_counts(spark, sf_dir):
    return _diff(spark, sf_dir).groupBy("pair_id", "status").agg(F.count(F.lit(1)).alias("n"))


@query("doc_pct_same")
def doc_pct_same(spark, sf_dir):
    counts = L.status_counts(_diff(spark, sf_dir, "b"), "pair_id")
    return counts.select("pair_id", F.when(F.col("n_total") == 0, 100.0).otherwise(F.col("pct_same")).alias("pct_same"))


@query("pct_affected")
def pct_affected(spark, sf_dir):
    return L.status_counts(_diff(spark, sf_dir), "pair_id").select("pair_id", "pct_affected")


_WORDS = """words_ AS (SELECT l_orderkey AS doc_id, CAST(l_linenumber % 2 AS INTEGER) AS page_no, 'item' || l_partkey AS text, CAST(l_partkey % 500 AS DOUBLE) AS left_,
   CAST(l_partkey % 500 + 40 AS DOUBLE) AS right_, CAST(800 - l_suppkey % 97 * 8 - l_linenumber AS DOUBLE) AS top_, l_linenumber AS seq FROM lineitem),
placed AS (SELECT *, top_ - 9 AS bottom_, CAST(round_even((842.0 - top_) / 5, 0) * 5 AS INTEGER) AS bucket FROM words_),
built AS (SELECT doc_id, page_no, bucket, string_agg(text, ' ' ORDER BY left_, seq, text) AS line, min(left_) * (130 / 72.0) - 2 AS x0, max(right_) * (130 / 72.0) + 2 AS x1,
   min(842.0 - top_) * (130 / 72.0) - 2 AS y0, max(842.0 - bottom_) * (130 / 72.0) + 2 AS y1 FROM placed GROUP BY ALL)"""


@query("lines_from_words", f"WITH {_WORDS} SELECT doc_id, page_no, bucket, line FROM built")
def lines_from_words(spark, sf_dir):
    return P.lines_of_words(R.words(spark, sf_dir)).select("doc_id", "page_no", "bucket", "line")


@query("highlight_boxes", f"WITH {_WORDS} SELECT doc_id, page_no, bucket, " + ", ".join(f"{C.rounded(c, 4)} AS {c}" for c in ("x0", "x1", "y0", "y1")) + " FROM built")
def highlight_boxes(spark, sf_dir):
    return P.lines_of_words(R.words(spark, sf_dir)).select("doc_id", "page_no", "bucket", *[T.rounded(F.col(c), 4).alias(c) for c in ("x0", "x1", "y0", "y1")])


_SPECS = """specs AS (SELECT l_orderkey AS doc_id, CAST(l_linenumber AS INTEGER) AS spec_no, 'item' || l_partkey AS spec FROM lineitem),
b0 AS (SELECT l.doc_id, l.page_no, l.bucket, l.line, s.spec_no, lower(l.line) AS t, lower(trim(s.spec)) AS n FROM built l JOIN specs s USING (doc_id) WHERE length(trim(s.spec)) >= 4),
b1 AS (SELECT *, list_distinct(list_filter(string_split(t, ' '), lambda q: q <> '')) AS lw, list_distinct(list_filter(string_split(n, ' '), lambda q: q <> '')) AS nw FROM b0),
b2 AS (SELECT *, len(lw) AS a, len(nw) AS b, len(list_intersect(lw, nw)) AS sh FROM b1),
hit AS (SELECT * FROM b2 WHERE NOT (CAST(sh AS DOUBLE) / greatest(a, b) >= 0.85 AND CAST(least(a, b) AS DOUBLE) / greatest(a, b) >= 0.55 AND CAST(least(a, b) AS DOUBLE) / greatest(a, b) < 0.75)
  AND (contains(t, left(n, 40)) OR (length(left(t, 40)) >= 6 AND contains(left(n, 40), left(t, 40))) OR (length(t) >= 12 AND contains(n, t))
       OR (a >= 4 AND CAST(sh AS DOUBLE) / a >= 0.80 AND CAST(a AS DOUBLE) / greatest(a, b) >= 0.30)))"""


@query("highlight_match", f"WITH {_WORDS}, {_SPECS} SELECT doc_id, page_no, bucket, line, min(spec_no) AS spec_no FROM hit GROUP BY ALL")
def highlight_match(spark, sf_dir):
    specs = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("spec_no"), F.concat(F.lit("item"), "l_partkey").alias("spec"))
    # Words are dealt by document: their lines and the specs of those meet where they are.
    words = R.words(spark, sf_dir).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id")
    return P.highlighted(P.lines_of_words(words).select("doc_id", "page_no", "bucket", "line"), specs)


@query("highlight_specs")
def highlight_specs(spark, sf_dir):
    return O.highlight_specs(_diff(spark, sf_dir))


@query("comparison_overview")
def comparison_overview(spark, sf_dir):
    """One row for each pair: alignment, line counts and number similarity together."""
    from folioscope.operators import numbers as N

    texts = R.revised_texts(spark, sf_dir)
    counts = L.status_counts(L.compared(texts), "pair_id")
    numbers = N.reconciled(texts).select("pair_id", "count1", "count2", "similarity_pct")
    matched = P.aligned(_pages(spark, sf_dir)).groupBy("pair_id").agg(F.count_if(F.col("i2") >= 0).alias("pages_matched"), F.count_if(F.col("i2") < 0).alias("pages_unmatched"))
    return numbers.join(counts, "pair_id", "left").join(matched, "pair_id", "left")
