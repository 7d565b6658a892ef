"""Writing report tables: workbooks by the standard library, text in order, JSON documents."""

from __future__ import annotations

import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame

#: Rows of a workbook's sheet at most: the format's own limit.
SHEET_ROWS = 1_048_575


def column_name(k: int) -> str:
    """0 is A, 26 is AA."""
    name = ""
    k += 1
    while k:
        k, rest = divmod(k - 1, 26)
        name = chr(65 + rest) + name
    return name


def write_workbook(sheets: dict[str, DataFrame], path: str) -> None:
    """A workbook of text cells, a sheet for each table; empty tables but the first are left out.

    Rows come to the driver one partition at a time and go straight into the file.
    """
    names = []
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as book:
        for name, table in sheets.items():
            rows = table.toLocalIterator()
            first = next(rows, None)
            if first is None and names:
                continue
            names.append(name)
            with book.open(f"xl/worksheets/sheet{len(names)}.xml", "w") as f:
                f.write(b'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>')
                f.write(_row(1, table.columns))
                number = 1
                while first is not None:
                    number += 1
                    if number > SHEET_ROWS + 1:
                        raise ValueError(f"{name} has more rows than a sheet can hold")
                    f.write(_row(number, ["" if x is None else str(x) for x in first]))
                    first = next(rows, None)
                f.write(b"</sheetData></worksheet>")
        listed = "".join(f'<sheet name="{escape(n[:31])}" sheetId="{k}" r:id="rId{k}"/>' for k, n in enumerate(names, 1))
        book.writestr("xl/workbook.xml", f'<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>{listed}</sheets></workbook>')
        related = "".join(f'<Relationship Id="rId{k}" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in range(1, len(names) + 1))
        book.writestr("xl/_rels/workbook.xml.rels", f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{related}</Relationships>')
        book.writestr("_rels/.rels", '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        types = "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for k in range(1, len(names) + 1))
        book.writestr("[Content_Types].xml", f'<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{types}</Types>')


def _row(number: int, cells: list[str]) -> bytes:
    made = "".join(f'<c r="{column_name(k)}{number}" t="inlineStr"><is><t xml:space="preserve">{escape("".join(c for c in x if c >= " " or c in "\t\n"))}</t></is></c>' for k, x in enumerate(cells))
    return f'<row r="{number}">{made}</row>'.encode()


def write_text(report: DataFrame, path: str) -> None:
    """The lines of a text report in order, a file for each range of pairs."""
    report.repartitionByRange("pair_id").sortWithinPartitions("pair_id", "section", "seq").select("line").write.mode("overwrite").text(path)


def write_json(documents: DataFrame, path: str) -> None:
    """A JSON document on each line."""
    documents.select("document").write.mode("overwrite").text(path)


def write_document(title: str, sections: dict[str, DataFrame], path: str, most: int = 200) -> None:
    """A word-processor document: a heading and a table for each section, with its first rows and its true count."""
    para = lambda x, style="": f"<w:p>{f'<w:pPr><w:pStyle w:val="{style}"/></w:pPr>' if style else ''}<w:r><w:t xml:space=\"preserve\">{escape(x)}</w:t></w:r></w:p>"
    cells = lambda row: "<w:tr>" + "".join(f"<w:tc>{para('' if x is None else str(x))}</w:tc>" for x in row) + "</w:tr>"
    body = [para(title, "Title")]
    for name, table in sections.items():
        rows = table.limit(most).collect()
        body.append(para(f"{name} ({table.count()})", "Heading1"))
        body.append(f"<w:tbl>{cells(table.columns)}{''.join(map(cells, rows))}</w:tbl>")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", f'<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{"".join(body)}</w:body></w:document>')
        z.writestr("_rels/.rels", '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>')
        z.writestr("[Content_Types].xml", '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>')
