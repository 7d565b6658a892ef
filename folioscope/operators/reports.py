"""Report tables: sheets, summaries, page views, comments and the capped API document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions import text as T
from folioscope.functions.fixed import API_ISSUES, API_LINES, API_NUMBERS, COMMENT_KEY, LEAST_CHARS


def summary(counts: DataFrame) -> DataFrame:
    """(pair_id, status, n, pct) of long counts (pair_id, status, n), the share in its pair's total."""
    total = F.sum("n").over(Window.partitionBy("pair_id"))
    return counts.select("pair_id", "status", "n", T.rounded(F.col("n") / F.greatest(total, F.lit(1)) * 100, 1).alias("pct"))


def issues_flag(issues: Column) -> Column:
    return F.when(issues == 0, "OK").when(issues > 5, "!!").otherwise("!")


def pct_band(pct: Column) -> Column:
    return F.when(pct == 100, "ok").when(pct >= 70, "~").otherwise("!!")


def badge(unmatched: Column, issues: Column) -> Column:
    return F.when(unmatched, "unmatched").when(issues == 0, "identical").otherwise("changed")


def latest_comments(comments: DataFrame) -> DataFrame:
    """The last comment of each (pair_id, key) by seq, for valid keys and comments that are not blank."""
    valid = comments.filter(F.col("key").rlike(COMMENT_KEY))
    last = valid.groupBy("pair_id", "key").agg(F.max_by("comment", "seq").alias("comment"))
    return last.filter(T.strip(F.col("comment")) != "")


def with_comments(rows: DataFrame, key: Column, comments: DataFrame) -> DataFrame:
    """rows with auditor_comment: the comment under `key`, or ""."""
    keyed = rows.withColumn("_key", key)
    found = comments.select("pair_id", F.col("key").alias("_key"), F.col("comment").alias("_comment"))
    return keyed.join(found, ["pair_id", "_key"], "left").withColumn("auditor_comment", F.coalesce("_comment", F.lit(""))).drop("_key", "_comment")


def changed_sheet(diff: DataFrame, comments: DataFrame) -> DataFrame:
    """Changed lines with their place among a pair's changed lines, and the comment under changed:<place>."""
    place = F.row_number().over(Window.partitionBy("pair_id").orderBy("seq"))
    rows = diff.filter("status = 'changed'").withColumn("row_no", place.cast("long"))
    rows = with_comments(rows, F.concat(F.lit("changed:"), F.col("row_no")), comments)
    return rows.select("pair_id", "row_no", F.col("line1").alias("AFS_1_line"), F.col("line2").alias("AFS_2_line"), F.format_string("%.4f", F.col("similarity")).alias("similarity"), F.array_join("num_diff", ", ").alias("number_changes"), "auditor_comment")


def line_sheet(diff: DataFrame, status: str) -> DataFrame:
    line = "line2" if status == "added" else "line1"
    return diff.filter(F.col("status") == status).select("pair_id", "seq", F.col(line).alias("line"))


def highlight_specs(diff: DataFrame) -> DataFrame:
    """(pair_id, side, seq, line_text, changed_words): what a snapshot of either side marks."""
    tagged = lambda tag: F.transform(F.filter("word_diff", lambda x: x["tag"] == tag), lambda x: x["word"])
    whole = F.array().cast("array<string>")
    words = lambda tag: F.when(F.col("status") == "changed", tagged(tag)).otherwise(whole).alias("changed_words")
    mark = lambda side, status, line, tag: F.when(F.col("status").isin("changed", status), F.struct(F.lit(side).alias("side"), F.col(line).alias("line_text"), words(tag)))
    # Both sides of a row at once: the diff is not made again for each.
    rows = diff.select("pair_id", "seq", F.explode(F.array_compact(F.array(mark(1, "removed", "line1", "removed"), mark(2, "added", "line2", "added")))).alias("m"))
    return rows.select("pair_id", "m.side", "seq", "m.line_text", "m.changed_words").filter(F.length("line_text") >= LEAST_CHARS)


def first_issues(diff: DataFrame, keys: list[str], most: int = API_ISSUES) -> DataFrame:
    """The first lines of each group that are not the same."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("seq"))
    return diff.filter("status <> 'same'").withColumn("place", place).filter(F.col("place") <= most)


def _listed(rows: DataFrame, keys: list[str], order: str, name: str, *fields: Column) -> DataFrame:
    """The rows of each key as an array of structs in order."""
    kept = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("_order"), F.struct(*fields).alias("_row")))), lambda x: x["_row"])
    return rows.groupBy(*keys).agg(kept.alias(name))


def api_document(diff: DataFrame, numbers: DataFrame, page_diffs: DataFrame, page_issues: DataFrame) -> DataFrame:
    """(pair_id, document): the JSON document of each pair, with true counts and totals and capped lists.

    page_diffs and page_issues: rows of plans' page comparisons, keyed by pair_id and page1.
    """
    tagged = F.transform("word_diff", lambda x: F.struct(x["word"].alias("w"), x["tag"].alias("t"))).alias("wordDiff")
    i = F.col("place").alias("i")
    kept = first_issues(diff, ["pair_id", "status"], API_LINES)
    of = lambda status: kept.filter(F.col("status") == status)
    n = {s: F.count_if(F.col("status") == s).alias(s) for s in ("same", "changed", "added", "removed")}
    counts = diff.groupBy("pair_id").agg(F.struct(*n.values(), F.count(F.lit(1)).alias("total")).alias("counts"))
    numbered = numbers.select(
        "pair_id",
        F.struct(
            F.col("similarity_pct").alias("simPct"),
            *[F.slice(c, 1, API_NUMBERS).alias(t) for c, t in (("in_both", "inBoth"), ("only1", "onlyAfs1"), ("only2", "onlyAfs2"))],
            F.col("count1").alias("countAfs1"),
            F.col("count2").alias("countAfs2"),
        ).alias("numCmp"),
    )
    issues = _listed(page_issues, ["pair_id", "page1"], "seq", "diffs", F.col("status"), F.col("line1"), F.col("line2"), F.col("num_diff").alias("numDiff"), tagged)
    fields = (("page1", "pageAfs1"), ("page2", "pageAfs2"), ("align_sim", "alignSim"), ("pct_same", "pctSame"), ("same", "same"), ("changed", "changed"), ("added", "added"), ("removed", "removed"))
    pages = _listed(
        page_diffs.withColumn("k", F.row_number().over(Window.partitionBy("pair_id").orderBy("page1")) - 1).join(issues, ["pair_id", "page1"], "left"),
        ["pair_id"],
        "page1",
        "pageDiffs",
        F.col("k"),
        *[F.col(c).alias(t) for c, t in fields],
        (F.col("changed") + F.col("added") + F.col("removed")).alias("issues"),
        F.coalesce("diffs", F.array()).alias("diffs"),
    )
    alignment = page_diffs.groupBy("pair_id").agg(F.struct(F.count_if(~F.col("unmatched")).alias("matched"), F.count_if("unmatched").alias("unmatched"), F.count(F.lit(1)).alias("afs1Pages"), F.max("pages2").alias("afs2Pages")).alias("alignment"))
    out = numbered.join(counts, "pair_id", "left").join(alignment, "pair_id", "left").join(pages, "pair_id", "left")
    out = out.join(_listed(of("changed"), ["pair_id"], "seq", "changedLines", i, F.col("line1"), F.col("line2"), F.col("similarity").alias("sim"), F.col("num_diff").alias("numDiff"), tagged), "pair_id", "left")
    for status, line in (("added", "line2"), ("removed", "line1")):
        out = out.join(_listed(of(status), ["pair_id"], "seq", f"{status}Lines", i, F.col(line).alias("line")), "pair_id", "left")
    lists = [F.coalesce(c, F.array()).alias(c) for c in ("changedLines", "addedLines", "removedLines", "pageDiffs")]
    totals = [F.coalesce(f"counts.{s}", F.lit(0)).alias(f"total{s.title()}") for s in ("changed", "added", "removed")]
    document = F.struct(F.lit(True).alias("success"), "counts", "alignment", F.lit("AFS 1").alias("afs1Label"), F.lit("AFS 2").alias("afs2Label"), *lists, "numCmp", *totals)
    return out.select("pair_id", F.to_json(document, {"ignoreNullFields": "false"}).alias("document"))


def alignment_sheet(page_diffs: DataFrame, comments: DataFrame) -> DataFrame:
    """The pages of each pair as text cells, with the comment under page:<place from 0>."""
    place = F.row_number().over(Window.partitionBy("pair_id").orderBy("page1"))
    rows = with_comments(page_diffs.withColumn("pair", place), F.concat(F.lit("page:"), F.col("pair") - 1), comments)
    cell = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias
    return rows.select(
        "pair_id", cell("pair")("pair"), cell("page1")("afs1_page"), cell("page2")("afs2_page"), F.format_string("%.3f", "align_sim").alias("align_similarity"),
        F.format_string("%.1f", "pct_same").alias("pct_same"), *[cell(c)(c) for c in ("same", "changed", "added", "removed")], "auditor_comment",
    )


def comment_sheet(comments: DataFrame) -> DataFrame:
    """(pair_id, row_no, key, comment): each pair's comments in the order of their keys."""
    place = F.row_number().over(Window.partitionBy("pair_id").orderBy("key"))
    return comments.select("pair_id", place.cast("long").alias("row_no"), "key", "comment")


def text_report(diff: DataFrame, counts: DataFrame) -> DataFrame:
    """(pair_id, section, seq, line): the plain report, to be written in that order."""
    head = counts.select("pair_id", F.lit(0).alias("section"), F.lit(0).alias("seq"), F.format_string("Same %d  Changed %d  Added %d  Removed %d", "n_same", "n_changed", "n_added", "n_removed").alias("line"))
    body = diff.filter("status <> 'same'").select(
        "pair_id",
        F.when(F.col("status") == "changed", 1).when(F.col("status") == "added", 2).otherwise(3).alias("section"),
        "seq",
        F.when(F.col("status") == "changed", F.concat(F.lit("- "), "line1", F.lit("\n+ "), "line2")).when(F.col("status") == "added", F.concat(F.lit("+ "), "line2")).otherwise(F.concat(F.lit("- "), "line1")).alias("line"),
    )
    return head.unionByName(body)
