"""Sources of words: text laid out on a grid, and records printed to pages.

``text_documents`` sets a text in a fixed pitch, 60 lines to a page, so that every operator on
words runs on tables of plain text. ``printed_*`` print the records of parsed documents with
the geometry of the three layouts; reading them back must give the records (see extract).
``pdf_words`` reads files where a decoder is installed and reports a status where none is.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.operators.document import Words
from tallyfold.operators.layout import Documents

LINES_PER_PAGE, LINE_PITCH, TOP, CHAR, GLYPH_HEIGHT = 60, 12.0, 40.0, 6.0, 10.0
GRID_WIDTH, GRID_HEIGHT = 6000.0, 800.0

_PIECE = re.compile("[^ ]+")


def set_on_grid(text: str | None) -> Words:
    """Words of a text: line n is at page n div 60, the word at character c of it at x = 6 c; a null text has one page without words."""
    words = Words(pages=1)
    for n, line in enumerate(text.split("\n") if text else ()):
        page, y = n // LINES_PER_PAGE, (n % LINES_PER_PAGE) * LINE_PITCH + TOP
        for m in _PIECE.finditer(line):
            words.add(page, m.group(), m.start() * CHAR, y, m.end() * CHAR, y + GLYPH_HEIGHT)
        words.pages = page + 1
    return words


def _grid(batch: pa.RecordBatch) -> Iterator[tuple[object, Words]]:
    for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
        yield doc, set_on_grid(text)


def text_documents(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Documents:
    """Texts as documents on the grid."""
    return Documents(df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), _grid, GRID_HEIGHT, "text")


def text_pages(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """pages of the texts on the grid; a null text has one page without words."""
    n = F.greatest(F.lit(1), F.ceil(F.size(F.split(F.coalesce(text, F.lit("")), "\n")) / LINES_PER_PAGE)).cast("int")
    return df.select(F.col(doc_id).alias("doc_id"), F.explode(F.sequence(F.lit(0), n - 1)).alias("page")).select("doc_id", "page", F.lit(GRID_WIDTH).alias("width"), F.lit(GRID_HEIGHT).alias("height"))


# The geometry of printed documents, in points on A4.
WIDTH, HEIGHT = 595.0, 842.0
TITLE_Y, LABEL_Y, LABEL2_Y, PARTY_Y, TABLE_Y, NEXT_TABLE_Y, FOOT_Y = 66.0, 100.0, 140.0, 178.0, 256.0, 136.0, 786.0
ROW_PITCH, BODY_BOTTOM, SIZE, NARROW = 18.4, 446.0, 8.0, 2.4
FIRST_ROWS = int((BODY_BOTTOM - TABLE_Y) / ROW_PITCH)
NEXT_ROWS = int((BODY_BOTTOM - NEXT_TABLE_Y) / ROW_PITCH)

_BLANKS = re.compile(r"[ \t\r\n]+")


def clean(text: str | None) -> str | None:
    """Blanks collapsed; None if nothing is left."""
    return (_BLANKS.sub(" ", text).strip(" ") or None) if text else None


def _printed(value: float | None) -> str | None:
    return None if value is None or not math.isfinite(value) else f"{value:,.2f}"


def row_page(n: int) -> int:
    return 0 if n < FIRST_ROWS else (n - FIRST_ROWS) // NEXT_ROWS + 1


def row_y(n: int) -> float:
    return TABLE_Y + ROW_PITCH * (n + 1) if n < FIRST_ROWS else NEXT_TABLE_Y + ROW_PITCH * ((n - FIRST_ROWS) % NEXT_ROWS + 1)


class Sheet(Words):
    """Pages that are being printed: cells of text at a place, left- or right-aligned."""

    __slots__ = ()

    def cell(self, page: int, x: float, y: float, text: str | None, right: bool = False) -> None:
        if text is None:
            return
        left = x - len(text) * NARROW if right else x
        at = 0
        for word in text.split(" "):
            x0 = left + at * NARROW
            self.add(page, word, x0, y - SIZE, x0 + len(word) * NARROW, y + 0.3 * SIZE)
            at += len(word) + 1

    def labelled(self, y: float, *fields: tuple[float, str, str | None]) -> None:
        """Labels in a row, each with its value beneath it."""
        for x, label, value in fields:
            self.cell(0, x, y, label)
            self.cell(0, x, y + 11, clean(value))

    def party(self, x: float, heading: str, party: dict | None) -> None:
        """A heading with up to four lines beneath it, close together; missing ones leave no gap, and without any there is no heading."""
        party = party or {}
        name, vendor, tax, location = (clean(party.get(k)) for k in ("name", "vendor_id", "tax_registration", "location"))
        lines = [s for s in (name, vendor and f"Account {vendor}", tax and f"Tax reg. {tax}", location) if s]
        if lines:
            self.cell(0, x, PARTY_Y, heading)
        for n, line in enumerate(lines):
            self.cell(0, x, PARTY_Y + 13 + 12 * n, line)

    def table(self, title: str, heads: list[tuple[float, str, bool]], rows: list[list[tuple[float, str | None, bool]]], tail: list[tuple[float, str | None, bool, int]]) -> None:
        """Rows over as many pages as they need, on each the title, the folio and the headings; then the cells after the last row."""
        n = len(rows)
        last = row_page(n + 4)
        self.cell(0, 57, TABLE_Y - 10, "ITEMS")
        self.cell(0, 317, TABLE_Y - 10, "ITEMS")
        for page in range(last + 1):
            self.cell(page, 101, TITLE_Y, title)
            self.cell(page, 480, FOOT_Y, f"Page {page + 1} of {last + 1}")
            for x, text, right in heads:
                self.cell(page, x, NEXT_TABLE_Y if page else TABLE_Y, text, right)
        for k, row in enumerate(rows):
            page, y = row_page(k), row_y(k)
            for x, text, right in row:
                self.cell(page, x, y, text, right)
        for x, text, right, after in tail:
            self.cell(row_page(n + after), x, row_y(n + after), text, right)
        self.pages = last + 1


INVOICE_COLUMNS = (("quantity", 324.0), ("unit_price", 404.0), ("net_amount", 453.0), ("tax_rate", 475.0), ("line_total", 536.0))
ORDER_COLUMNS = (("quantity", 332.0), ("unit_price", 404.0), ("net_amount", 453.0))


def _items(lines: list[dict] | None, columns: tuple[tuple[str, float], ...]) -> list[list[tuple]]:
    """Printed rows of line items: number, description, unit, then figures right-aligned under their headings."""
    out = []
    for x in lines or ():
        x = x or {}
        number = x.get("line_number")
        row = [(57, None if number is None else str(number), False), (82, clean(x.get("description")), False), (272, clean(x.get("unit_of_measure")), False)]
        out.append([*row, *((at, _printed(x.get(name)), True) for name, at in columns)])
    return out


def print_invoice(r: dict) -> Words:
    sheet, totals = Sheet(), r["totals"] or {}
    sheet.labelled(LABEL_Y, (57, "INVOICE NUMBER", r["document_id"]), (170, "ISSUE DATE", r["issue_date"]), (278, "DUE DATE", r["due_date"]), (386, "CURRENCY", r["currency"]), (476, "TERMS", r["payment_terms"]))
    sheet.labelled(LABEL2_Y, (57, "PURCHASE ORDER REFERENCE", r["po_reference"]))
    sheet.party(57, "SELLER", r["seller"])
    sheet.party(317, "BILL TO", r["buyer"])
    heads = [(57, "LN", False), (82, "DESCRIPTION", False), (272, "UOM", False), (324, "QTY", True), (404, "UNIT PRICE", True), (453, "NET", True), (475, "VAT%", True), (536, "LINE TOTAL", True)]
    tail = [(x, t, right, n) for n, at, label, field in ((1, 435, "SUBTOTAL", "subtotal"), (2, 435, "VAT TOTAL", "tax_total"), (3, 410, "TOTAL DUE", "grand_total")) for x, t, right in ((at, label, False), (540, _printed(totals.get(field)), True))]
    sheet.table("COMMERCIAL INVOICE", heads, _items(r["lines"], INVOICE_COLUMNS), tail)
    return sheet


def print_order(r: dict) -> Words:
    sheet = Sheet()
    sheet.labelled(LABEL_Y, (57, "PO NUMBER", r["document_id"]), (170, "ORDER DATE", r["order_date"]), (278, "DELIVERY BY", r["delivery_date"]), (386, "REQUISITION", r["requisition_number"]), (476, "CURRENCY", r["currency"]))
    sheet.labelled(LABEL2_Y, (57, "PAYMENT TERMS", r["payment_terms"]), (278, "CONTRACT REFERENCE", r["contract_reference"]))
    sheet.party(57, "SUPPLIER", r["vendor"])
    heads = [(57, "ITEM", False), (82, "DESCRIPTION", False), (272, "UOM", False), (332, "ORDERED", True), (404, "UNIT PRICE", True), (453, "NET", True)]
    sheet.table("PURCHASE ORDER", heads, _items(r["lines"], ORDER_COLUMNS), [(410, "ORDER VALUE EUR", False, 1), (540, _printed(r["order_value"]), True, 1)])
    return sheet


def print_contract(r: dict) -> Words:
    sheet, terms = Sheet(), clean(r["payment_terms"])
    sheet.labelled(LABEL_Y, (57, "CONTRACT REFERENCE", r["document_id"]), (170, "EFFECTIVE DATE", r["effective_date"]), (278, "EXPIRY DATE", r["expiry_date"]), (386, "GOVERNING LAW", r["governing_law"]))
    sheet.party(57, "COUNTERPARTY", r["counterparty"])
    rates = [[(57, clean(x.get("description")), False), (300, clean(x.get("unit_of_measure")), False), (480, _printed(x.get("max_unit_price")), True)] for x in (y or {} for y in r["rate_schedule"] or ())]
    tail = [(57, terms and f"Clause 7 Invoices are settled on {terms} terms and not before.", False, 1), (57, "Clause 8 Renewal is by agreement in writing.", False, 2)]
    sheet.table("MASTER SUPPLY AGREEMENT", [(57, "ITEM DESCRIPTION", False), (300, "UOM", False), (480, "MAXIMUM UNIT RATE", True)], rates, tail)
    return sheet


def scanned(words: Words) -> Words:
    """A copy of a document of which only pictures are left: its pages, without a word."""
    return Words(pages=words.pages)


#: Of each table: how its records are printed, and the columns that takes.
PRINTERS: dict[str, tuple[Callable[[dict], Words], tuple[str, ...]]] = {
    "invoices": (print_invoice, ("document_id", "issue_date", "due_date", "currency", "payment_terms", "po_reference", "seller", "buyer", "lines", "totals")),
    "purchase_orders": (print_order, ("document_id", "order_date", "delivery_date", "requisition_number", "currency", "payment_terms", "contract_reference", "vendor", "lines", "order_value")),
    "contracts": (print_contract, ("document_id", "effective_date", "expiry_date", "governing_law", "payment_terms", "counterparty", "rate_schedule")),
}


def printed_documents(df: DataFrame, table: str, doc_id: str = "row_id", changed: Callable[[Words], Words] | None = None) -> Documents:
    """Records of a table as printed documents; ``changed`` may print over them, as a fault of the file would."""
    printer, columns = PRINTERS[table]

    def printed(batch: pa.RecordBatch) -> Iterator[tuple[object, Words]]:
        for row in batch.to_pylist():
            words = printer(row)
            yield row["_id"], changed(words) if changed else words

    return Documents(df.select(F.col(doc_id).alias("_id"), *columns), printed, HEIGHT)


# Files. A decoder of PDF is used where one is installed; without it every file is a row that says so.


def _decoder():  # noqa: ANN202
    try:
        import pymupdf
    except ImportError:
        return None
    return pymupdf


def _files(spark: SparkSession, folder: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", "true").load(folder)
    return files.select(F.regexp_replace(F.regexp_extract("path", r"([^/]+)\z", 1), r"(?i)\.pdf\z", "").alias("doc_id"), "path", "content")


def pdf_files(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, path) of all PDF files below a folder, by name; the files are not read, and those of no bytes are not there."""
    return _files(spark, folder).select("doc_id", "path").orderBy("doc_id", "path")


def words_of_pdf(content: bytes) -> Words:
    """Words of one file; a file that gives none says why in ``status``."""
    decoder = _decoder()
    if decoder is None:
        return Words(status="NO_DECODER")
    words = Words()
    try:
        with decoder.open(stream=content, filetype="pdf") as file:
            for n, page in enumerate(file):
                if not n:
                    words.height = float(page.rect.height)
                words.pages = n + 1
                for w in page.get_text("words"):
                    words.add(n, w[4], *map(float, w[:4]))
    except Exception as e:  # noqa: BLE001 - a broken file is a row, not a failed job
        return Words(status=f"UNREADABLE: {type(e).__name__}")
    return words


def _decoded(batch: pa.RecordBatch) -> Iterator[tuple[object, Words]]:
    for doc, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
        yield doc, words_of_pdf(content or b"")


def pdf_documents(spark: SparkSession, folder: str) -> Documents:
    """All PDF files below a folder as documents, for every operator on documents: reading, checking, citing, searching."""
    return Documents(_files(spark, folder).select("doc_id", "content"), _decoded)


PDF_SCHEMA = "path string, status string, page int, word_no bigint, text string, x0 double, y0 double, x1 double, y1 double"


def _decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = [c.split()[0] for c in PDF_SCHEMA.split(", ")]
    for pdf in batches:
        out: list[tuple] = []
        for path, content in zip(pdf["path"], pdf["content"]):
            w = words_of_pdf(bytes(content))
            out += [(path, "OK", page, k, *x) for k, (page, *x) in enumerate(zip(w.page, w.text, w.x0, w.y0, w.x1, w.y1))]
            if not len(w):
                out.append((path, w.status or "NO_TEXT_LAYER", *[None] * 7))
        yield pd.DataFrame(out, columns=columns)


def pdf_words(spark: SparkSession, folder: str) -> DataFrame:
    """Words of all PDF files below a folder, or one row with the reason where a file gives none."""
    return _files(spark, folder).select("path", "content").mapInPandas(_decode, PDF_SCHEMA)


CROP_SCHEMA = "path string, page int, status string, png binary"


def _cut_out(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    decoder = _decoder()
    for pdf in batches:
        out = []
        for r in pdf.itertuples(index=False):
            if decoder is None:
                out.append((r.path, r.page, "NO_DECODER", None))
                continue
            try:
                with decoder.open(stream=bytes(r.content), filetype="pdf") as file:  # a copy in memory
                    page = file[int(r.page)]
                    if r.outlined:
                        page.draw_rect(decoder.Rect(r.x0, r.y0, r.x1, r.y1), color=(1, 0, 0), width=0.8)
                    clip = decoder.Rect(r.cx0, r.cy0, r.cx1, r.cy1)
                    out.append((r.path, r.page, "OK", page.get_pixmap(matrix=decoder.Matrix(r.zoom, r.zoom), clip=clip).tobytes("png")))
            except Exception as e:  # noqa: BLE001 - a broken file is a row, not a failed job
                out.append((r.path, r.page, f"UNREADABLE: {type(e).__name__}", None))
        yield pd.DataFrame(out, columns=["path", "page", "status", "png"])


def pdf_crops(spark: SparkSession, folder: str, rectangles: DataFrame, zoom: float = 2.5, outlined: bool = False) -> DataFrame:
    """(path, page, status, png) for crop rectangles (path, page, x0, y0, x1, y1, cx0, cy0, cx1, cy1), as ``lookup.crop`` gives them.

    outlined: the hit itself (x0 to y1) is outlined in red, on a copy in memory; files are only read, never changed.
    """
    asked = rectangles.select("path", "page", *(f"{c}{f}" for c in ("", "c") for f in ("x0", "y0", "x1", "y1")))
    return asked.join(_files(spark, folder).select("path", "content"), "path").withColumns({"zoom": F.lit(zoom), "outlined": F.lit(outlined)}).mapInPandas(_cut_out, CROP_SCHEMA)


def priced_lines(spec: list[tuple[str, str, float, float, float]]) -> list[dict]:
    """Line items that agree with themselves, of (description, unit, quantity, price, rate of tax)."""
    out = []
    for n, (description, unit, quantity, price, rate) in enumerate(spec, 1):
        net = round(quantity * price, 2)
        out.append({"line_number": n, "description": description, "unit_of_measure": unit, "quantity": float(quantity), "unit_price": price, "net_amount": net, "tax_rate": rate, "line_total": round(net * (1 + rate / 100), 2)})
    return out


def catalogue_lines(catalogue: list[tuple[str, str, float]], count: int, start: int = 0, rate: float = 24.0) -> list[dict]:
    """``count`` priced lines from a catalogue of (description, unit, price), from entry ``start`` on and around."""
    return priced_lines([(*catalogue[(start + n) % len(catalogue)][:2], 2 + (start + 3 * n) % 9, catalogue[(start + n) % len(catalogue)][2], rate) for n in range(count)])
