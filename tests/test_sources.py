"""Readers, writers and streams."""

import zipfile
import zlib

from pyspark.sql import functions as F

from folioscope.operators import pages as P
from folioscope.sources import pdf, sheets
from folioscope.streaming import comments as C


def make_pdf(lines, flate=True):
    content = "BT /F1 12 Tf 72 700 Td " + " ".join(f"({x}) Tj 0 -20 Td" for x in lines) + " ET"
    data = zlib.compress(content.encode()) if flate else content.encode()
    head = b"<< /Length %d %s>>" % (len(data), b"/Filter /FlateDecode " if flate else b"")
    return b"%PDF-1.4\n1 0 obj << /Type /Page /MediaBox [0 0 612 792] /Contents 2 0 R >> endobj\n2 0 obj " + head + b"\nstream\n" + data + b"\nendstream endobj\n%%EOF"


def test_pdf_words(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(make_pdf(["Total revenue 12,345", "Net \\(loss\\) 7"]))
    (tmp_path / "b.PDF").write_bytes(make_pdf(["Plain one"], flate=False))
    (tmp_path / "c.pdf").write_bytes(b"not a pdf")
    (tmp_path / "d.txt").write_bytes(make_pdf(["ignored"]))
    words = pdf.scan_words(spark, str(tmp_path))
    lines = P.lines_of_words(pdf.with_doc_id(words).withColumn("seq", F.col("seq")), 792.0)
    assert sorted(r.line for r in lines.collect()) == ["Net (loss) 7", "Plain one", "Total revenue 12,345"]
    assert {r.page_h for r in words.collect()} == {792.0}


def test_rendered_words_come_back(spark):
    docs = spark.createDataFrame([(1, "Alpha (beta) gamma\nRé 12,5"), (2, None)], "doc_id long, text string")
    words = pdf.words_in(pdf.rendered(docs)).orderBy("page_no", "seq").collect()
    assert [w.text for w in words if w.doc_id == 1] == ["Alpha", "(beta)", "gamma", "Ré", "12,5"]


def test_document(spark, tmp_path):
    sheets.write_document("Paper", {"Lines": spark.range(5)}, str(tmp_path / "d.docx"), 2)
    with zipfile.ZipFile(tmp_path / "d.docx") as z:
        text = z.read("word/document.xml").decode()
    assert "Lines (5)" in text and text.count("<w:tr>") == 3


def test_workbook(spark, tmp_path):
    full = spark.createDataFrame([("a<b", "1"), ("é", None)], "x string, y string")
    sheets.write_workbook({"Summary": full, "Empty": full.filter("false"), "More": full}, str(tmp_path / "w.xlsx"))
    with zipfile.ZipFile(tmp_path / "w.xlsx") as z:
        assert "Empty" not in z.read("xl/workbook.xml").decode() and "a&lt;b" in z.read("xl/worksheets/sheet2.xml").decode()
    assert [sheets.column_name(k) for k in (0, 25, 26, 701, 702)] == ["A", "Z", "AA", "ZZ", "AAA"]


def test_comment_stream(spark, tmp_path):
    source = tmp_path / "in"
    write = lambda rows: spark.createDataFrame(rows, C.COMMENT_SCHEMA).coalesce(1).write.mode("append").parquet(str(source))
    run = lambda: C.upserted(spark.readStream.schema(C.COMMENT_SCHEMA).parquet(str(source)), str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination()
    write([(1, "page:1", "old", 1), (1, "bad key", "x", 2)])
    run()
    write([(1, "page:1", "new", 5), (2, "changed:1", "other", 3)])
    run()
    assert {(r.pair_id, r.key, r.comment) for r in C.latest(spark, str(tmp_path / "t")).collect()} == {(1, "page:1", "new"), (2, "changed:1", "other")}


def test_entry_runs(spark):
    import __spark_entry__ as e

    assert e.entry(spark).limit(3).count() == 3
    assert set(e.oracle_sql()) <= set(e.queries())


def foreign_pdf(objects):
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj %s endobj\n" % (k, body) for k, body in objects) + b"%%EOF"


def shown(key, text):
    content = b"BT /F1 10 Tf 50 700 Td (%s) Tj ET" % text
    return key, b"<< /Length %d >>\nstream\n%s\nendstream" % (len(content), content)


def test_pages_in_tree_order():
    """Pages written in another order, nested nodes, boxes and resources of nodes above, a node that holds itself, a page outside."""
    page = lambda parent, content, more=b"": b"<< /Type /Page /Parent %d 0 R /Contents %d 0 R %s>>" % (parent, content, more)
    objects = [
        (10, page(2, 20, b"/MediaBox [0 0 100 50] ")), (11, page(3, 21)), (12, page(3, 22)),
        (3, b"<< /Type /Pages /Parent 2 0 R /Kids 4 0 R /Count 2 >>"), (4, b"[12 0 R 11 0 R 3 0 R]"),
        (2, b"<< /Type /Pages /MediaBox [0 0 300 400] /Resources << /Font << /F1 5 0 R >> >> /Kids [3 0 R 10 0 R] /Count 3 >>"),
        (5, b"<< /Type /Font /ToUnicode 6 0 R >>"), (6, b"<< >>\nstream\nbeginbfchar <41> <0058> <42> <0059> endbfchar\nendstream"),
        (1, b"<< /Type /Catalog /Pages 2 0 R >>"), (13, page(99, 23)), shown(20, b"AB"), shown(21, b"BA"), shown(22, b"BB"), shown(23, b"AA"),
    ]
    got = [(w, h, [x[0] for x in words]) for w, h, words in pdf.read(foreign_pdf(objects))]
    assert got == [(300, 400, ["YY"]), (300, 400, ["YX"]), (100, 50, ["XY"]), (595, 842, ["AA"])]


def test_operators_of_a_page_are_read_by_patterns_made_once(monkeypatch):
    """Not by a pattern looked up for each token; and the words are those of the lines."""
    from folioscope.sources import pdf

    calls, true = [], pdf.re.fullmatch
    monkeypatch.setattr(pdf.re, "fullmatch", lambda *a, **k: calls.append(1) or true(*a, **k))
    lines = [f"item ({k}) \\ of 12.5 Übung" for k in range(300)]
    ((_, _, words),) = pdf.read(pdf.make([lines]))
    assert [w[0] for w in words] == " ".join(lines).split() and len(calls) < 50


def test_scanned_lines_are_those_of_the_words(spark):
    """Lines made where the document is equal those of all its words, dealt by line; ids that repeat or are missing too."""
    import random

    r = random.Random(4)
    part = lambda: r.choice(["the cash", "12,345", "(a) b\\", "well-known", "é  €", "\t", "-", "x" * 120, "of all the accounts of the year and more of them"])
    text = lambda: "\n".join(" ".join(part() for _ in range(r.randint(0, 9))) for _ in range(r.randint(0, 130)))
    docs = spark.createDataFrame([(k // 2, text()) for k in range(8)] + [(None, "a b"), (None, "c"), (90, None), (91, "")], "doc_id long, text string")
    got = pdf.scanned_lines(docs).selectExpr("doc_id", "explode(lines) as r").select("doc_id", "r.*")
    want = P.lines_of_words(pdf.words_in(pdf.rendered(docs)))
    rows = lambda df: sorted(map(str, df.select("doc_id", "page_no", "bucket", "line", "x0", "x1", "y0", "y1").collect()))
    assert rows(got) == rows(want) and len(rows(got)) > 200


def test_strings_of_one_line(spark):
    """Strings shown apart stand in one line by their places; a font's negative size runs backwards."""
    stream = b"BT /F1 10 Tf 300 700 Td (second part) Tj -200 1 Td (first) Tj ET BT /F1 -10 Tf 200 500 Td (b a) Tj ET"
    pages = pdf.read(b"1 0 obj << /Type /Page /Contents 2 0 R /MediaBox [0 0 595 842] >> endobj 2 0 obj <<>> stream\n" + stream + b"\nendstream endobj")
    data = b"1 0 obj << /Type /Page /Contents 2 0 R /MediaBox [0 0 595 842] >> endobj 2 0 obj <<>> stream\n" + stream + b"\nendstream endobj"
    words = spark.createDataFrame([(1, n, k, *w) for n, (_, _, ws) in enumerate(pages) for k, w in enumerate(ws)], "doc_id long, page_no int, seq int, text string, left double, right double, top double, bottom double")
    want = P.lines_of_words(words).orderBy("page_no", "bucket").collect()
    assert pdf.lines_in([data]) == [tuple(r)[1:] for r in want] and {"first second part", "a b"} == {r.line for r in want}


def test_wrapping_is_that_of_textwrap():
    import random
    import textwrap

    r = random.Random(3)
    lines = ["".join(r.choice("ab- \t c—é　\x1f\xa0.x") for _ in range(r.randint(0, 260))) for _ in range(500)]
    lines += [" ".join("w" * r.randint(0, r.choice([5, 12, 95])) for _ in range(r.randint(0, 60))) for _ in range(2000)]
    assert all(pdf.wrapped(x, 90) == (textwrap.wrap(x, 90) or [""]) for x in lines)
