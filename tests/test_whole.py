"""Queries work on all rows of their tables, not on a convenient part."""

import unicodedata

from folioscope.functions import lines as P
from folioscope.functions import similarity as S
from folioscope.plans import catalog


def written_docs(spark, tmp_path):
    rows = [(k, f"Note {k} of the whole\nGrundstück {k} für alle Zähler\nTotal {k}345 at year end\nLast of the lines", lang) for k, lang in enumerate(["en", "de", "fr", None])]
    spark.createDataFrame([*rows, (9, None, "en")], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_documents_of_every_language(spark, tmp_path):
    at = written_docs(spark, tmp_path)
    for name in ("line_diff_a", "line_diff_b", "page_alignment", "page_diffs", "comparison_overview", "sheet_summary", "text_report", "api_document"):
        assert {r.pair_id for r in catalog.QUERIES[name](spark, at).select("pair_id").collect()} == {0, 1, 2, 3}, name
    words = catalog.QUERIES["scan_words"](spark, at).collect()
    assert {w.doc_id for w in words} == {0, 1, 2, 3} and {"Grundstück", "für"} <= {w.text for w in words if w.doc_id == 1}
    assert {r.doc_id for r in catalog.QUERIES["scan_lines_b"](spark, at).collect()} == {0, 1, 2, 3}


def test_issues_of_every_page(spark, tmp_path):
    text = "\n".join(f"Item {k} of the ledger holds {k}77 units of word{k}" for k in range(400))
    spark.createDataFrame([(5, text, "en")], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    diffs = {r.page1: r for r in catalog.QUERIES["page_diffs"](spark, str(tmp_path)).collect()}
    issues = catalog.QUERIES["page_issues"](spark, str(tmp_path)).collect()
    per_page = {k: sum(r.page1 == k for r in issues) for k in diffs}
    assert len(diffs) == 40 and per_page == {k: 0 if r.unmatched else min(25, r.changed + r.added + r.removed) for k, r in diffs.items()}
    assert len(issues) > 25 and all((r.pair_id, r.page2) == (5, diffs[r.page1].page2) for r in issues)


def test_gestalt_of_lines_in_any_script(spark, tmp_path):
    lines = ["Grundstück für alle", "Ärger ① und ﬁnanzen", "Баланс за год", "資産合計 2024 年", "plain ascii line", "the last of them"] * 4
    spark.createDataFrame([(1, "\n".join(lines), "de")], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    norm = lambda x: unicodedata.normalize("NFKD", x).lower()
    edit = {1: str.upper, 2: lambda x: x + " amended", 3: lambda x: x.replace("the", "that"), 5: lambda x: x.translate(str.maketrans("0123456789", "1234567890"))}
    want = {}
    for n, line in enumerate(lines):
        k = (31 + n) % 11
        if k:
            other = edit.get(k, str)(line)
            a, b = P.numbers(line), P.numbers(other)
            if not (a and b):  # numbers of both sides move the score
                want[2 * n] = round(S.gestalt(norm(other), norm(line)), 4)
    got = {r.ord: r.score for r in catalog.QUERIES["line_gestalt"](spark, str(tmp_path)).collect()}
    assert len(got) == sum((31 + n) % 11 != 0 for n in range(len(lines)))
    assert {k: got[k] for k in want} == want and len(want) > 15
