"""From positioned words to rows, pages and documents.

``Documents`` is a relation with one row per document and the way its words are got from such
a row: set from a text, printed from a record, or gathered from the flat relation
``words(doc_id, page, word_no, text, x0, y0, x1, y1)`` with pages counted from 0 and the origin
at the top left. Operators run over it in Arrow batches, each document where it lies: only
``of_words`` shuffles, once, and everything after it stays in the partition of the document,
which is bounded by what a document holds.

Defined cases: see ``operators.document``; a document without words is a row with status
NO_TEXT_LAYER, one of an unknown layout with UNKNOWN_LAYOUT; rows with the same id are
documents of their own, but for ``of_words``, where equal ids are one document; an empty
relation gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyfold.operators.document import Document, Words, single
from tallyfold.sources.tables import by_key

WORD = "array<struct<page:int,word_no:bigint,text:string,x0:double,y0:double,x1:double,y1:double>>"


def _words_of_structs(batch: pa.RecordBatch) -> Iterator[tuple[object, Words]]:
    """(id, words) of a batch (doc_id, words array<struct>): columns of all words at once, cut by document."""
    column = batch.column(1)
    flat = column.flatten()
    fields = {f.name: flat.field(i) for i, f in enumerate(flat.type)}
    lists = {name: fields[name].to_pylist() for name in ("page", "text", "x0", "y0", "x1", "y1")}
    at = 0
    for doc, size in zip(batch.column(0).to_pylist(), column.value_lengths().to_pylist()):
        yield doc, Words(*(values[at : at + (size or 0)] for values in lists.values()))
        at += size or 0


@dataclass(frozen=True)
class Documents:
    """df: one row per document, its id in the first column; words: (id, words) of each row of a batch."""

    df: DataFrame
    words: Callable[[pa.RecordBatch], Iterator[tuple[object, Words]]]
    height: float | None = None
    text: str | None = None

    @staticmethod
    def of_words(words: DataFrame, height: float | None = None) -> Documents:
        """Documents gathered from the flat relation of words, in the order of extraction; one shuffle by document."""
        word = F.struct("word_no", "page", "text", "x0", "y0", "x1", "y1")
        gathered = by_key(words, "doc_id").groupBy("doc_id").agg(F.array_sort(F.collect_list(word)).alias("words"))
        return Documents(gathered, _words_of_structs, height)

    @property
    def id_type(self) -> str:
        return self.df.schema.fields[0].dataType.simpleString()

    def holding(self, needles: Iterable[str]) -> Documents:
        """Those that may hold all needles: on documents set from texts the test reaches the scan, others stay as they are."""
        if self.text is None:
            return self
        df = self.df
        for n in needles:
            df = df.where(F.contains(self.text, F.lit(n)))
        return replace(self, df=df)

    def map(self, run: Callable[[Words], Iterable[tuple]], columns: str) -> DataFrame:
        """(doc_id, *columns): the rows that ``run`` gives for each document."""
        schema = T.StructType.fromDDL(f"doc_id {self.id_type}, {columns}")
        arrow = pa.schema([(f.name, _arrow(f.dataType)) for f in schema.fields])
        words_of = self.words

        def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [(doc, *row) for doc, words in words_of(batch) for row in run(words)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

        return self.df.mapInArrow(mapped, schema)

    def flat(self) -> DataFrame:
        """The flat relation of words (without the number of extraction, which is their order)."""
        return self.map(lambda w: zip(w.page, w.text, w.x0, w.y0, w.x1, w.y1), "page int, text string, x0 double, y0 double, x1 double, y1 double")


def _arrow(kind: T.DataType) -> pa.DataType:
    if isinstance(kind, T.ArrayType):
        return pa.list_(_arrow(kind.elementType))
    if isinstance(kind, T.StructType):
        return pa.struct([(f.name, _arrow(f.dataType)) for f in kind.fields])
    return {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}[kind.simpleString()]


def rows(docs: Documents) -> DataFrame:
    """(doc_id, page, page_row_no, text, top, x0, y0, x1, y1): printed rows from top to bottom; top is the height of a row's first word."""

    def run(words: Words) -> Iterator[tuple]:
        doc = Document(words)
        page, n = None, 0
        for row, text in zip(doc.all_rows, doc.texts):
            box = words.box(row)
            page, n = box[0], n + 1 if box[0] == page else 0
            yield page, n, text, words.y0[row[0]], *box[1:]

    return docs.map(run, "page int, page_row_no int, text string, top double, x0 double, y0 double, x1 double, y1 double")


def texts(docs: Documents) -> DataFrame:
    """(doc_id, page_count, text, rows, furniture): the text of each document with words, pages in order and without page furniture; page_count by its words."""
    height = docs.height

    def run(words: Words) -> Iterator[tuple]:
        doc = Document(words, height)
        if doc.all_rows:
            yield 1 + words.page[doc.all_rows[-1][0]], "\n".join(doc.text), doc.text, doc.furniture

    return docs.map(run, "page_count int, text string, rows array<string>, furniture array<string>")


def status(docs: Documents) -> DataFrame:
    """(doc_id, page_count, status, document_type): OK, NO_TEXT_LAYER or UNKNOWN_LAYOUT; never an error."""

    def run(words: Words) -> Iterator[tuple]:
        doc = Document(words)
        kind = doc.kind()
        yield doc.page_count, "OK" if kind else "UNKNOWN_LAYOUT" if doc.all_rows else words.status or "NO_TEXT_LAYER", kind

    return docs.map(run, "page_count int, status string, document_type string")


def deduplicated(docs: Documents) -> DataFrame:
    """(doc_id, words, dropped): words that count, and repeats of one at the same place (overlaid text layers)."""
    def run(words: Words) -> Iterator[tuple]:
        kept, repeats = single(words)
        yield len(kept), repeats

    return docs.map(run, "words bigint, dropped bigint")
