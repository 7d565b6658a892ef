"""Words of PDF files, read with the standard library: positioned text of uncompressed and Flate content streams.

Fonts with simple encodings and with ToUnicode maps are read; encrypted files and other filters give no words. A
file that cannot be read is a document without pages, never an error.
"""

from __future__ import annotations

import re
import textwrap
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions import fixed as X
from folioscope.sources.scratch import small_batches

WORDS = "path string, filename string, page_no int, page_w double, page_h double, seq int, text string, left double, right double, top double, bottom double"

_OBJECT = re.compile(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj", re.S)
_STREAM = re.compile(rb"stream\r?\n(.*?)\r?\n?endstream", re.S)
_OPERATOR = re.compile(rb"\((?:[^\\()]++|\\.)*+\)|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s/\[\]()<>]+|[-+]?\d*\.?\d+|[A-Za-z'\"*]+", re.S)
_NAME, _PLAIN = re.compile(rb"[A-Za-z'\"*]+"), re.compile(rb"[-+]?\d*\.?\d+")
_WORD, _ESCAPED = re.compile(r"\S+"), re.compile(rb"\\([0-7]{1,3}|.)", re.S)
#: Operators that numbers before them matter to.
_NUMBERED = (b"Tf", b"TL", b"Td", b"TD", b"Tm")
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _decoded(body: bytes) -> bytes:
    m = _STREAM.search(body)
    if not m:
        return b""
    if b"FlateDecode" in body[: m.start()]:
        return zlib.decompressobj().decompress(m[1])
    return b"" if b"/Filter" in body[: m.start()] else m[1]


def _literal(token: bytes) -> bytes:
    if token[:1] == b"<":
        digits = re.sub(rb"\s", b"", token[1:-1])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())

    def one(m):
        x = m[1]
        return bytes([int(x, 8) & 255]) if x.isdigit() else _ESCAPES.get(x, x)

    return _ESCAPED.sub(one, token[1:-1]) if b"\\" in token else token[1:-1]


def _to_unicode(cmap: bytes) -> tuple[int, dict[int, str]]:
    text = lambda h: bytes.fromhex(h.decode()).decode("utf-16-be", "replace")
    out, width = {}, 1
    for block in re.findall(rb"beginbfchar(.*?)endbfchar", cmap, re.S):
        for a, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block):
            out[int(a, 16)], width = text(b), len(a) // 2
    for block in re.findall(rb"beginbfrange(.*?)endbfrange", cmap, re.S):
        for a, b, c in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block):
            width = len(a) // 2
            for k in range(int(a, 16), min(int(b, 16), int(a, 16) + 65535) + 1):
                out[k] = text(b"%0*x" % (len(c), int(c, 16) + k - int(a, 16)))
    return width, out


def _words(content: bytes, fonts: dict[bytes, tuple[int, dict[int, str]]]) -> Iterator[tuple[str, float, float, float, float]]:
    """(text, left, right, top, bottom) of the words that a content stream shows, of estimated widths."""
    for shown, left, step, top, bottom in _shown(content, fonts):
        for m in _WORD.finditer(shown):
            yield m[0], left + m.start() * step, left + m.end() * step, top, bottom


def _shown(content: bytes, fonts: dict[bytes, tuple[int, dict[int, str]]]) -> Iterator[tuple[str, float, float, float, float]]:
    """(text, left, width of a character, top, bottom) of each string that a content stream shows."""
    stack, size, font, line, at, leading = [], 12.0, (1, {}), (0.0, 0.0), [0.0, 0.0], 0.0
    scale = 1.0

    def show(raw: bytes) -> tuple[str, float, float, float, float]:
        width, table = font
        if width == 1 and not table:
            shown = raw.decode("cp1252", "ignore")
        else:
            codes = [int.from_bytes(raw[k : k + width], "big") for k in range(0, len(raw), width)]
            shown = "".join(table.get(c, "") if table else bytes([c]).decode("cp1252", "ignore") for c in codes)
        left, step = at[0], 0.5 * size * scale
        at[0] += len(shown) * step
        return shown, left, step, at[1] + 0.7 * size * scale, at[1] - 0.2 * size * scale

    for m in _OPERATOR.finditer(content):
        token = m[0]
        if not _NAME.fullmatch(token):
            stack.append(token)
            continue
        nums = [float(x) for x in stack if _PLAIN.fullmatch(x)] if token in _NUMBERED else []
        if token == b"BT":
            line, scale, at = (0.0, 0.0), 1.0, [0.0, 0.0]
        elif token == b"Tf" and nums:
            size = nums[-1]
            font = fonts.get(next((x for x in stack if x[:1] == b"/"), b""), (1, {}))
        elif token == b"TL" and nums:
            leading = nums[-1]
        elif token in (b"Td", b"TD") and len(nums) >= 2:
            line = line[0] + nums[-2] * scale, line[1] + nums[-1] * scale
            leading = -nums[-1] if token == b"TD" else leading
            at = list(line)
        elif token == b"Tm" and len(nums) >= 6:
            scale, line = abs(nums[-3]) or 1.0, (nums[-2], nums[-1])
            at = list(line)
        elif token in (b"T*", b"'", b'"'):
            line = line[0], line[1] - leading * scale
            at = list(line)
        if token in (b"Tj", b"TJ", b"'", b'"'):
            text = b""
            for x in stack:
                if x[:1] in (b"(", b"<"):
                    text += _literal(x)
                elif token == b"TJ" and re.fullmatch(rb"[-+]?\d*\.?\d+", x) and float(x) < -200:
                    text += b" " * font[0] if font[0] == 1 else b""
            yield show(text)
        stack = []


_PAGE, _TREE = re.compile(rb"/Type\s*/Page\b(?!s)"), re.compile(rb"/Type\s*/Pages\b")
_KIDS = re.compile(rb"/Kids\s*(\[[^\]]*\]|\d+\s+\d+\s+R)")


def pages_of(objects: dict[int, bytes]) -> Iterator[tuple[bytes, bytes, bytes]]:
    """Pages in the order of the page tree: the page, and the nodes that its box and its resources stand in.

    Both may be inherited from the nodes above. Pages that no tree holds follow in the order of the file.
    """
    refs = lambda raw: [int(x) for x in re.findall(rb"(\d+)\s+\d+\s+R", raw)]

    def kids(body: bytes) -> list[int]:
        m = _KIDS.search(body)
        if not m:
            return []
        # The list may be an object of its own.
        return refs(objects.get(refs(m[1])[0], b"")) if m[1][:1] != b"[" else refs(m[1])

    trees = {k: kids(body) for k, body in objects.items() if _TREE.search(body)}
    below = {kid for found in trees.values() for kid in found}
    seen: set[int] = set()
    # Nodes still to visit, the next one last; a node is visited once, so a tree that holds itself ends.
    open_ = [(k, objects[k], objects[k]) for k in sorted(trees, reverse=True) if k not in below]
    while open_:
        key, box, resources = open_.pop()
        body = objects.get(key, b"")
        if key in seen:
            continue
        seen.add(key)
        box = body if b"/MediaBox" in body else box
        resources = body if b"/Resources" in body else resources
        if key in trees:
            open_ += [(kid, box, resources) for kid in reversed(trees[key])]
        elif body:
            yield body, box, resources
    for key, body in objects.items():
        if key not in seen and _PAGE.search(body):
            yield body, body, body


def read(data: bytes, found=_words) -> list[tuple[float, float, list[tuple]]]:
    """(width, height, words) of each page, or what else is found in its content; a document that cannot be read has none."""
    objects = {int(k): body for k, body in _OBJECT.findall(data)}
    for body in list(objects.values()):  # objects that stand in compressed object streams
        if b"/ObjStm" in body:
            first, n = (int(re.search(rb"/%s\s+(\d+)" % k, body)[1]) for k in (b"First", b"N"))
            plain = _decoded(body)
            heads = [int(x) for x in plain[:first].split()[: 2 * n]]
            for j in range(0, len(heads), 2):
                end = first + heads[j + 3] if j + 3 < len(heads) else len(plain)
                objects.setdefault(heads[j], plain[first + heads[j + 1] : end])
    refs = lambda raw: [int(x) for x in re.findall(rb"(\d+)\s+\d+\s+R", raw)]

    def follow(key: bytes, body: bytes) -> bytes:
        m = re.search(rb"/%s\s*(<<.*?>>|\[[^\]]*\]|\d+\s+\d+\s+R)" % key, body, re.S)
        if not m:
            return b""
        return objects.get(refs(m[1])[0], b"") if re.fullmatch(rb"\d+\s+\d+\s+R", m[1]) else m[1]

    out = []
    for body, own_box, own_resources in pages_of(objects):
        box = [float(x) for x in re.findall(rb"[-+]?\d*\.?\d+", (re.search(rb"/MediaBox\s*\[([^\]]*)\]", own_box) or [b"", b""])[1])]
        resources = follow(b"Resources", own_resources) or own_resources
        fonts = {}
        for name, ref in re.findall(rb"(/[^\s/<>\[\]]+)\s+(\d+)\s+\d+\s+R", follow(b"Font", resources) or resources):
            cmap = re.search(rb"/ToUnicode\s+(\d+)", objects.get(int(ref), b""))
            fonts[name] = _to_unicode(_decoded(objects.get(int(cmap[1]), b""))) if cmap else (1, {})
        contents = re.search(rb"/Contents\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", body)
        content = b"\n".join(_decoded(objects.get(k, b"")) for k in refs(contents[1])) if contents else b""
        width, height = (box[2] - box[0], box[3] - box[1]) if len(box) == 4 else (595.0, 842.0)
        out.append((width, height, list(found(content, fonts))))
    return out


def scan_words(spark: SparkSession, path: str) -> DataFrame:
    """The words of every PDF under `path`; a file is a row of the scan, so files spread over tasks."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][dD][fF]").option("recursiveFileLookup", "true").load(path)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, data in frame.itertuples(index=False):
                try:
                    pages = read(bytes(data))
                except (ValueError, KeyError, IndexError, TypeError, zlib.error):
                    pages = []
                rows = [(name, name.rpartition("/")[2], n, w, h, k, *word) for n, (w, h, words) in enumerate(pages) for k, word in enumerate(words)]
                if rows:
                    yield pd.DataFrame(rows, columns=[c.split()[0] for c in WORDS.split(", ")])

    return files.select("path", "content").mapInPandas(run, WORDS)


def with_doc_id(words: DataFrame) -> DataFrame:
    return words.withColumn("doc_id", F.xxhash64("path"))


def make(pages: list[list[str]]) -> bytes:
    """A plain PDF: a page for each list of lines, in one built-in font."""

    def shown(line: str) -> bytes:
        return b"(" + re.sub(rb"([\\()])", rb"\\\1", line.encode("cp1252", "replace")) + b") Tj 0 -14 Td"

    kids = b" ".join(b"%d 0 R" % (4 + 2 * k) for k in range(len(pages)))
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [%s] /Count %d >>" % (kids, len(pages)), b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>"]
    for k, lines in enumerate(pages):
        content = zlib.compress(b"BT /F1 10 Tf 50 790 Td " + b" ".join(map(shown, lines)) + b" ET")
        objects.append(b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 595 842] /Resources << /Font << /F1 3 0 R >> >> /Contents %d 0 R >>" % (5 + 2 * k))
        objects.append(b"<< /Length %d /Filter /FlateDecode >>\nstream\n%s\nendstream" % (len(content), content))
    out, places = bytearray(b"%PDF-1.4\n"), []
    for k, body in enumerate(objects, 1):
        places.append(len(out))
        out += b"%d 0 obj %s endobj\n" % (k, body)
    start = len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1) + b"".join(b"%010d 00000 n \n" % p for p in places)
    return bytes(out + b"trailer << /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF" % (len(objects) + 1, start))


def wrapped(line: str, width: int) -> list[str]:
    """textwrap.wrap(), where a line without words is one empty line; lines that have words and single spaces alone are cut at those."""
    if not line.isprintable():
        return textwrap.wrap(line, width) or [""]
    if len(line) <= width:
        return [line.rstrip()]
    if "-" in line or "  " in line or line[0] == " ":
        return textwrap.wrap(line, width) or [""]
    out, at = [], 0
    while len(line) - at > width:
        end = line.rfind(" ", at, at + width + 1)
        if end < 0:
            return textwrap.wrap(line, width)
        out.append(line[at:end])
        at = end + 1
    return [*out, line[at:].rstrip()] if at < len(line) else out


def laid_out(text: str | None, lines_per_page: int = 50, width: int = 90) -> bytes:
    """A text as a PDF."""
    lines = [x for line in (text or "").split("\n") for x in wrapped(line, width)]
    return make([lines[k : k + lines_per_page] for k in range(0, len(lines), lines_per_page)])


def rendered(texts: DataFrame, lines_per_page: int = 50, width: int = 90) -> DataFrame:
    """(doc_id, content): each text of (doc_id, text) laid out as a PDF."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"doc_id": frame["doc_id"], "content": [laid_out(text, lines_per_page, width) for text in frame["text"]]})

    return texts.select("doc_id", "text").mapInPandas(run, "doc_id long, content binary")


LINES = "page_no int, bucket int, line string, x0 double, x1 double, y0 double, y1 double"


def lines_in(files: list[bytes], page_height: float = 842.0) -> list[tuple]:
    """Rows of LINES, in order of page and bucket: operators.pages.lines_of_words() of the words of all files, as if of one document.

    What is shown at once stands in one bucket, so its words need no sorting where nothing else does.
    """
    placed: dict[tuple[int, int], list[tuple]] = {}
    for data in files:
        try:
            pages = read(data, _shown)
        except (ValueError, KeyError, IndexError, TypeError, zlib.error):
            pages = []
        for n, (_, _, strings) in enumerate(pages):
            seq = 0
            for text, left, step, top, bottom in strings:
                if words := text.split():
                    placed.setdefault((n, int(round((page_height - top) / X.GRID) * X.GRID)), []).append((words, text, left, step, top, bottom, seq))
                    seq += len(words)
    scale, out = X.DPI / 72.0, []
    for (n, bucket), held in sorted(placed.items()):
        if len(held) == 1 and held[0][3] > 0:
            words, text, left, step = held[0][:4]
            low, high = left + (len(text) - len(text.lstrip())) * step, left + len(text.rstrip()) * step
        else:
            each = sorted((left + m.start() * step, seq + k, m[0], left + m.end() * step) for _, text, left, step, _, _, seq in held for k, m in enumerate(_WORD.finditer(text)))
            words, low, high = [x[2] for x in each], each[0][0], max(x[3] for x in each)
        y0, y1 = min(page_height - x[4] for x in held), max(page_height - x[5] for x in held)
        out.append((n, bucket, " ".join(words), low * scale - X.MARGIN, high * scale + X.MARGIN, y0 * scale - X.MARGIN, y1 * scale + X.MARGIN))
    return out


def scanned_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, lines): each text of (doc_id, text) laid out as a PDF, read again, and its words put into lines (LINES).

    A document's words never leave its task; texts that share an id are lines of one document.
    """
    small_batches(docs.sparkSession)
    names = [c.split()[0] for c in LINES.split(", ")]
    kinds = [pa.int32(), pa.int32(), pa.string(), *[pa.float64()] * 4]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, ends = [], [0]
            for texts in batch.column(1):
                rows += lines_in([laid_out(text) for text in texts.as_py()])
                ends.append(len(rows))
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * len(kinds), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, names))], ["doc_id", "lines"])

    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = docs.repartition(tasks, "doc_id").groupBy("doc_id").agg(F.collect_list(F.coalesce("text", F.lit(""))).alias("texts"))
    return held.mapInArrow(run, f"doc_id long, lines array<struct<{', '.join(':'.join(c.split()) for c in LINES.split(', '))}>>")


def words_in(contents: DataFrame) -> DataFrame:
    """The words of PDFs held as (doc_id, content)."""
    schema = "doc_id long, page_no int, page_h double, seq int, text string, left double, right double, top double, bottom double"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for doc_id, data in frame.itertuples(index=False):
                try:
                    pages = read(bytes(data))
                except (ValueError, KeyError, IndexError, TypeError, zlib.error):
                    pages = []
                rows = [(doc_id, n, h, k, *word) for n, (_, h, words) in enumerate(pages) for k, word in enumerate(words)]
                if rows:
                    yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    return contents.select("doc_id", "content").mapInPandas(run, schema)
