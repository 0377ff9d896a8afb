"""Structured records read from printed documents, with the place of every field.

One pass over each document: overlaid words are dropped, rows formed, furniture set apart, the
layout recognised, and the record read by the reader of that layout (``operators.document``).

Defined cases: see ``operators.document``; a document that cannot be read is a row with its
status and nulls. A missing currency of an invoice or order is EUR and flagged.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.operators import document
from tallyfold.operators.document import Words
from tallyfold.operators.layout import Documents

LINE = "struct<line_number:int,description:string,unit_of_measure:string,quantity:double,unit_price:double,net_amount:double,tax_rate:double,line_total:double,tax_amount:double>"
PARTY = "struct<name:string,vendor_id:string,tax_registration:string,location:string>"
POSITION = "struct<field_path:string,page:int,x0:double,y0:double,x1:double,y1:double>"
#: Fields of a read record in order, with their types.
RECORD = {
    "page_count": "int", "document_type": "string", "source_system": "string", "document_id": "string", "currency": "string", "currency_defaulted": "boolean", "payment_terms": "string",
    "seller": PARTY, "buyer": PARTY, "vendor": PARTY, "counterparty": PARTY, "issue_date": "string", "due_date": "string", "order_date": "string", "delivery_date": "string",
    "effective_date": "string", "expiry_date": "string", "po_reference": "string", "contract_reference": "string", "requisition_number": "string", "governing_law": "string",
    "lines": f"array<{LINE}>", "rate_schedule": "array<struct<description:string,unit_of_measure:string,max_unit_price:double>>", "totals": "struct<subtotal:double,tax_total:double,grand_total:double>",
    "order_value": "double", "removed_duplicates": "array<struct<line_number:int,description:string,page:int,words:int,reason:string>>",
}


def records(docs: Documents) -> DataFrame:
    """(doc_id, status, *RECORD, positions): every document read whole, whatever its layout."""
    height, names = docs.height, tuple(RECORD)

    def run(words: Words) -> Iterator[tuple]:
        status, record, positions = document.read(words, height)
        yield status, *map(record.get, names), positions

    return docs.map(run, f"status string, {', '.join(f'{n} {t}' for n, t in RECORD.items())}, positions array<{POSITION}>")


def positions(read: DataFrame) -> DataFrame:
    """(doc_id, document_id, field_path, page, bounding_box): the place of every located field of read records."""
    one = read.select("doc_id", "document_id", F.explode("positions").alias("p"))
    return one.select("doc_id", "document_id", "p.field_path", "p.page", F.struct("p.x0", "p.y0", "p.x1", "p.y1").alias("bounding_box"))


def located(docs: Documents) -> DataFrame:
    """(doc_id, field_path, value, page, x0, y0, x1, y1): every field of a document that has a place, with its value as text."""
    height = docs.height

    def run(words: Words) -> Iterator[tuple]:
        _, record, positions = document.read(words, height)
        for path, *place in positions:
            yield path, document.value_at(record, path), *place

    return docs.map(run, "field_path string, value string, page int, x0 double, y0 double, x1 double, y1 double")


def printed_lines(docs: Documents, header: tuple[str, ...], stop: str) -> DataFrame:
    """(doc_id, ord, *line, page, y0): line items of one table as printed, before repeats are removed."""
    height, end = docs.height, re.compile(stop, re.I)

    def run(words: Words) -> Iterator[tuple]:
        for k, x in enumerate(document.Document(words, height).lines(header, end), 1):
            yield k, *x.record, x.page, x.y0

    return docs.map(run, f"ord int, {LINE[7:-1].replace(':', ' ').replace(',', ', ')}, page int, y0 double")
