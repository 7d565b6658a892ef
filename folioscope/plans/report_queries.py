"""Queries for reports, comments and the upload queue."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from folioscope.functions import text as T
from folioscope.operators import lines as L
from folioscope.operators import numbers as N
from folioscope.operators import pages as P
from folioscope.operators import queue as U
from folioscope.operators import reports as O
from folioscope.plans import common as C
from folioscope.plans import text_queries as Q
from folioscope.sources import pdf as X
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


def comments(spark, sf_dir):
    """(pair_id, key, comment, seq): comment writes, made from the event stream's rows."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    kind = F.when(F.col("user_id") % 3 == 0, "page:").when(F.col("user_id") % 3 == 1, "changed:").otherwise("note-")
    text = F.when(F.col("event_id") % 5 == 0, "  ").otherwise(F.concat(F.col("event_type"), F.lit(" "), F.col("event_id")))
    return e.select((F.col("user_id") % 50).alias("pair_id"), F.concat(kind, F.col("event_id") % 7).alias("key"), text.alias("comment"), F.col("event_id").alias("seq"))


_COMMENTS = """comments_ AS (SELECT user_id % 50 AS pair_id, CASE user_id % 3 WHEN 0 THEN 'page:' WHEN 1 THEN 'changed:' ELSE 'note-' END || (event_id % 7) AS key,
   CASE WHEN event_id % 5 = 0 THEN '  ' ELSE event_type || ' ' || event_id END AS comment, event_id AS seq FROM events),
valid AS (SELECT * FROM comments_ WHERE regexp_full_match(lower(key), '(changed|page|overall):[0-9a-z_\\-]*')),
latest AS (SELECT pair_id, key, arg_max(comment, seq) AS comment FROM valid GROUP BY ALL),
saved AS (SELECT * FROM latest WHERE trim(comment) <> '')"""


@query("valid_comment_key", f"WITH {_COMMENTS} SELECT pair_id, key, comment, seq FROM valid")
def valid_comment_key(spark, sf_dir):
    return comments(spark, sf_dir).filter(F.col("key").rlike(O.COMMENT_KEY))


@query("comments_saved", f"WITH {_COMMENTS} SELECT * FROM saved")
def comments_saved(spark, sf_dir):
    return O.latest_comments(comments(spark, sf_dir))


@query("comments_join", f"WITH {_COMMENTS}, pages_ AS (SELECT DISTINCT user_id % 50 AS pair_id, event_id % 11 AS page FROM events) SELECT p.pair_id, p.page, coalesce(s.comment, '') AS auditor_comment FROM pages_ p LEFT JOIN saved s ON p.pair_id = s.pair_id AND s.key = 'page:' || p.page")
def comments_join(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/events.parquet").select((F.col("user_id") % 50).alias("pair_id"), (F.col("event_id") % 11).alias("page")).distinct()
    return O.with_comments(pages, F.concat(F.lit("page:"), "page"), O.latest_comments(comments(spark, sf_dir)))


def uploads(spark, sf_dir):
    """(upload_no, filename, content_type, length): files offered to the queue, made from orders."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    suffix = F.when(F.col("o_orderkey") % 4 == 0, ".txt").when(F.col("o_orderkey") % 4 == 1, ".PDF").otherwise(".pdf")
    return o.select(F.col("o_orderkey").alias("upload_no"), F.concat(F.lit("report"), F.col("o_custkey"), suffix).alias("filename"), F.when(F.col("o_orderkey") % 9 == 0, "text/plain").otherwise("application/pdf").alias("content_type"), (F.col("o_totalprice")).cast("long").alias("length"))


_QUEUE = """up AS (SELECT o_orderkey AS upload_no, 'report' || o_custkey || CASE o_orderkey % 4 WHEN 0 THEN '.txt' WHEN 1 THEN '.PDF' ELSE '.pdf' END AS filename,
   CASE WHEN o_orderkey % 9 = 0 THEN 'text/plain' ELSE 'application/pdf' END AS content_type, CAST(trunc(o_totalprice) AS BIGINT) AS length_ FROM orders),
queue AS (SELECT filename, min(upload_no) AS upload_no, arg_min(length_, upload_no) AS length_ FROM up WHERE lower(filename) LIKE '%.pdf' AND lower(content_type) LIKE '%pdf%' GROUP BY filename)"""


def _queue(spark, sf_dir):
    accepted = uploads(spark, sf_dir).filter(F.lower("filename").endswith(".pdf") & F.lower("content_type").contains("pdf"))
    return accepted.groupBy("filename").agg(F.min("upload_no").alias("upload_no"), F.min_by("length", "upload_no").alias("length"))


@query("queue_dedupe", f"WITH {_QUEUE} SELECT filename, upload_no FROM queue")
def queue_dedupe(spark, sf_dir):
    """The first upload of each file name that is a PDF by name and type."""
    return _queue(spark, sf_dir).select("filename", "upload_no")


@query("queue_status", f"WITH {_QUEUE} SELECT filename, upload_no, CAST(length_ // 1024 AS INTEGER) AS kb, 'AFS ' || row_number() OVER (ORDER BY upload_no) AS label FROM queue")
def queue_status(spark, sf_dir):
    """Queue rows with size in whole KB and a label by order of arrival."""
    rows = U.numbered(_queue(spark, sf_dir), "upload_no", "place")
    return rows.select("filename", "upload_no", (F.col("length") / 1024).cast("int").alias("kb"), F.concat(F.lit("AFS "), "place").alias("label"))


_PATHS = """paths AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN '/' WHEN 1 THEN '/Shared/Reports/' WHEN 2 THEN '/shared/reports/../' WHEN 3 THEN '../' ELSE '/shared/reports/' END
   || 'file' || o_custkey || CASE o_custkey % 6 WHEN 0 THEN '.pdf' WHEN 1 THEN '.DOCX' WHEN 2 THEN '.xlsx' WHEN 3 THEN '.txt' WHEN 4 THEN '.bin' ELSE '' END AS path FROM orders)"""


@query(
    "download_rules",
    f"""WITH {_PATHS}, e AS (SELECT *, lower(regexp_extract(path, '\\.([^./]+)$', 1)) AS ext FROM paths)
SELECT o_orderkey, path, starts_with(path, '/') AND NOT contains(path, '..') AS absolute, starts_with(lower(path), '/shared/reports/') AND NOT contains(path, '..') AS allowed,
  CASE ext """ + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in U.MIME.items()) + f" ELSE '{U.OTHER}' END AS mime FROM e",
)
def download_rules(spark, sf_dir):
    """Which paths may be written to and sent, and as what type."""
    pick = lambda column, names: F.element_at(F.array(*map(F.lit, names)), (F.col(column) % len(names) + 1).cast("int"))
    folder = pick("o_orderkey", ["/", "/Shared/Reports/", "/shared/reports/../", "../", "/shared/reports/"])
    path = F.concat(folder, F.lit("file"), "o_custkey", pick("o_custkey", [".pdf", ".DOCX", ".xlsx", ".txt", ".bin", ""]))
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", path.alias("path"))
    return rows.select("o_orderkey", "path", U.absolute(F.col("path")).alias("absolute"), U.downloadable(F.col("path"), "/shared/reports").alias("allowed"), U.mime(F.col("path")).alias("mime"))


@query("extract_ready", f"WITH {_QUEUE} SELECT CAST(count(*) AS BIGINT) AS queued, bool_and(length_ > 0) AS all_read, count(*) >= 2 AS comparable FROM queue")
def extract_ready(spark, sf_dir):
    return _queue(spark, sf_dir).agg(F.count(F.lit(1)).alias("queued"), F.bool_and(F.col("length") > 0).alias("all_read"), (F.count(F.lit(1)) >= 2).alias("comparable"))


def _stats(spark, sf_dir):
    """Counts of each page of the revisions, line by line at the same place: (pair_id, page, issues, pct, unmatched)."""
    n, same = F.count(F.lit(1)), F.count_if(F.col("status") == "same")
    pages = Q.placed(spark, sf_dir).groupBy("pair_id", F.floor(F.col("ord") / (2 * R.PAGE_LINES)).cast("int").alias("page"))
    return pages.agg((n - same).alias("issues"), T.rounded(same / n * 100, 1).alias("pct"), F.bool_and(F.col("status").isin("added", "removed")).alias("unmatched"))


_STATS = f"""{Q.PLACED}, stats AS (SELECT pair_id, CAST(ord // {2 * R.PAGE_LINES} AS INTEGER) AS page, CAST(count(*) FILTER (status <> 'same') AS BIGINT) AS issues,
   {C.rounded("CAST(count(*) FILTER (status = 'same') AS DOUBLE) / count(*) * 100", 1)} AS pct, bool_and(status IN ('added', 'removed')) AS unmatched FROM placed GROUP BY ALL)"""


@query("page_status_flag", f"{_STATS} SELECT pair_id, page, CASE WHEN issues = 0 THEN 'OK' WHEN issues > 5 THEN '!!' ELSE '!' END AS flag FROM stats")
def page_status_flag(spark, sf_dir):
    return _stats(spark, sf_dir).select("pair_id", "page", O.issues_flag(F.col("issues")).alias("flag"))


@query("page_pct_band", f"{_STATS} SELECT pair_id, page, CASE WHEN pct = 100 THEN 'ok' WHEN pct >= 70 THEN '~' ELSE '!!' END AS band FROM stats")
def page_pct_band(spark, sf_dir):
    return _stats(spark, sf_dir).select("pair_id", "page", O.pct_band(F.col("pct")).alias("band"))


@query("page_badge", f"{_STATS} SELECT pair_id, page, CASE WHEN unmatched THEN 'unmatched' WHEN issues = 0 THEN 'identical' ELSE 'changed' END AS badge FROM stats")
def page_badge(spark, sf_dir):
    return _stats(spark, sf_dir).select("pair_id", "page", O.badge(F.col("unmatched"), F.col("issues")).alias("badge"))


@query("summary_table", f"{Q.PLACED}, c AS (SELECT pair_id, status, CAST(count(*) AS BIGINT) AS n FROM placed GROUP BY ALL) SELECT pair_id, status, n, {C.rounded('CAST(n AS DOUBLE) / greatest(sum(n) OVER (PARTITION BY pair_id), 1) * 100', 1)} AS pct FROM c")
def summary_table(spark, sf_dir):
    return O.summary(Q.placed(spark, sf_dir).groupBy("pair_id", "status").agg(F.count(F.lit(1)).alias("n")))


@query("numbered_changes", f"{Q.PLACED} SELECT pair_id, ord, row_number() OVER (PARTITION BY pair_id ORDER BY ord) AS place FROM placed WHERE status = 'changed'")
def numbered_changes(spark, sf_dir):
    place = F.row_number().over(Window.partitionBy("pair_id").orderBy("ord"))
    return Q.placed(spark, sf_dir).filter("status = 'changed'").select("pair_id", "ord", place.cast("long").alias("place"))


@query("sheet_comments", f"WITH {_COMMENTS} SELECT pair_id, row_number() OVER (PARTITION BY pair_id ORDER BY key) AS row_no, key, comment FROM saved")
def sheet_comments(spark, sf_dir):
    return O.comment_sheet(O.latest_comments(comments(spark, sf_dir)))


def _diff(spark, sf_dir):
    return L.compared(R.revised_texts(spark, sf_dir))


@query("sheet_summary")
def sheet_summary(spark, sf_dir):
    texts = R.revised_texts(spark, sf_dir)
    counts = L.status_counts(L.compared(texts), "pair_id")
    numbers = N.reconciled(texts).select("pair_id", "similarity_pct")
    return counts.join(numbers, "pair_id").select("pair_id", *[F.col(f"n_{s}").cast("string").alias(s) for s in ("same", "changed", "added", "removed")], F.format_string("%.1f", "similarity_pct").alias("num_similarity_pct"))


@query("sheet_changed_lines")
def sheet_changed_lines(spark, sf_dir):
    return O.changed_sheet(_diff(spark, sf_dir), O.latest_comments(comments(spark, sf_dir)))


@query("sheet_added_lines")
def sheet_added_lines(spark, sf_dir):
    return O.line_sheet(_diff(spark, sf_dir), "added")


@query("text_report")
def text_report(spark, sf_dir):
    diff = once(_diff(spark, sf_dir), "diff")
    return O.text_report(diff, L.status_counts(diff, "pair_id"))


@query("session_json", f"WITH {_COMMENTS} SELECT pair_id, CAST(count(*) AS BIGINT) AS n, min(key) AS first_key FROM saved GROUP BY pair_id")
def session_json(spark, sf_dir):
    """A pair's comments written as one JSON document and read again; what can't be read counts as empty."""
    saved = O.latest_comments(comments(spark, sf_dir))
    stored = saved.groupBy("pair_id").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("key", "comment")))).alias("json"))
    found = stored.select("pair_id", F.coalesce(F.from_json("json", "map<string,string>"), F.create_map().cast("map<string,string>")).alias("m"))
    return found.select("pair_id", F.size("m").cast("long").alias("n"), F.array_min(F.map_keys("m")).alias("first_key"))


def _scanned(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return X.words_in(X.rendered(docs))


def _scanned_lines(spark, sf_dir):
    return X.scanned_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


@query("scan_words")
def scan_words(spark, sf_dir):
    """Documents laid out as PDFs, and the words that the scan finds in them."""
    return _scanned(spark, sf_dir).select("doc_id", "page_no", "seq", "text", "left", "top")


@query("scan_lines_b")
def scan_lines_b(spark, sf_dir):
    """The scan's lines without noise, with their words counted and their numbers, for each document."""
    held = _scanned_lines(spark, sf_dir).select("doc_id", F.transform("lines", lambda x: T.strip(x["line"])).alias("lines"))
    held = held.select("doc_id", F.filter("lines", lambda x: ~T.is_noise(x)).alias("lines")).filter(F.size("lines") > 0)
    words = F.aggregate("lines", F.lit(0).cast("long"), lambda n, x: n + F.size(T.tokens(x)))
    out = held.select("doc_id", words.alias("word_count"), F.array_join("lines", "\n").alias("text"))
    return out.select("doc_id", "word_count", F.array_sort(T.numbers(F.col("text"), "line")).alias("unique_numbers"))


@query("highlight_scan")
def highlight_scan(spark, sf_dir):
    """Each scanned line of a document's first revision that a change of the second marks, with its box."""
    lines = _scanned_lines(spark, sf_dir).select("doc_id", F.explode("lines").alias("r")).select("doc_id", "r.*")
    boxes = [T.rounded(F.col(c), 4).alias(c) for c in ("x0", "x1", "y0", "y1")]
    built = once(lines.select("doc_id", "page_no", "bucket", "line", *boxes), "scanned-lines")
    diff = L.compared(R.revised_texts(spark, sf_dir))
    specs = O.highlight_specs(diff).filter("side = 1").select(F.col("pair_id").alias("doc_id"), F.col("seq").alias("spec_no"), F.col("line_text").alias("spec"))
    # Boxes go with their lines.
    return P.highlighted(built, once(specs, "specs")).select("doc_id", "page_no", "bucket", "line", "spec_no", "x0", "x1", "y0", "y1")
