"""Finding text and values by where they are printed.

A lookup runs over ``Documents`` (see layout) and gives hits (doc_id, page, text, x0, y0, x1,
y1); nothing is shuffled or joined, since the words of a document are all at hand.

Defined cases: no match gives no row, never an error; an empty needle matches nothing; see
``operators.document`` for what is found.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.operators import document
from tallyfold.operators.document import Document, Hit, Words
from tallyfold.operators.layout import Documents

# Distances in points.
CROP_X, CROP_Y = 4.0, 1.5

HIT = "page int, text string, x0 double, y0 double, x1 double, y1 double"
Find = Callable[[Words], Iterable[Hit]]


def literal(needle: str) -> Find:
    return lambda words: (hit for _, hit in document.literal(words, needle))


def pattern(regex: str) -> Find:
    compiled = re.compile(regex)
    return lambda words: document.pattern(words, compiled)


def word(text: str) -> Find:
    return lambda words: ((t, words.page[k], words.x0[k], words.y0[k], words.x1[k], words.y1[k]) for k, t in enumerate(words.text) if t == text)


def _row(hit: Hit) -> tuple:
    return hit[1], hit[0], *hit[2:]


def search(docs: Documents, needle: str, page: int | None = None) -> DataFrame:
    """(doc_id, page_row_no, *hit) of a literal search: contiguous words of one row, case-sensitive, on all pages or one.

    Texts without the needle's words are not scanned.
    """

    def run(words: Words) -> Iterator[tuple]:
        return ((number, *_row(h)) for number, h in document.literal(words, needle) if page is None or h[1] == page)

    return docs.holding(needle.split()).map(run, f"page_row_no int, {HIT}")


def search_pattern(docs: Documents, regex: str, page: int | None = None) -> DataFrame:
    """Words in which a regular expression is found."""
    find = pattern(regex)
    return docs.map(lambda w: (_row(h) for h in find(w) if page is None or h[1] == page), HIT)


def first_hit(docs: Documents, find: Find) -> DataFrame:
    """The first hit of each document, by page and place."""

    def run(words: Words) -> Iterator[tuple]:
        if hits := sorted(find(words), key=lambda h: (h[1], h[3], h[2])):
            yield _row(hits[0])

    return docs.map(run, HIT)


def value_beside(docs: Documents, find: Find, direction: str = "right") -> DataFrame:
    """The value right of or below the first hit of a label on each page."""
    return docs.map(lambda w: (_row(h) for h in document.beside(w, find(w), direction)), HIT)


def below_labels(docs: Documents, labels: list[str]) -> DataFrame:
    """(doc_id, label, page, text, x0, y0, x1, y1): values printed beneath labels, left-aligned to them."""
    height = docs.height

    def run(words: Words) -> Iterator[tuple]:
        doc = Document(words, height)
        for label in labels:
            if (found := doc.below(label)) is not None:
                yield label, found[1][0], found[0], *found[1][1:]

    return docs.map(run, f"label string, {HIT}")


def first_row(docs: Documents, *needles: str) -> DataFrame:
    """(doc_id, row_no): the first row, from 1, containing all needles in any order and case."""
    height = docs.height

    def run(words: Words) -> Iterator[tuple]:
        at = Document(words, height).row_with(*needles)
        if at is not None:
            yield (at + 1,)

    return docs.map(run, "row_no int")


def widened_rows(docs: Documents, find: Find, width: float | None = None) -> DataFrame:
    """Each hit widened to all words at its height, x clamped to the page; a hit without any stays as it is."""
    return docs.map(lambda w: (_row(document.widened(w, h, width)) for h in find(w)), HIT)


def measured(hits: DataFrame) -> DataFrame:
    """Adds width and height of each hit, and a line that describes it; pages count from 0 there."""
    whole = lambda c: F.bround(c, 0).cast("bigint").cast("string")
    place = F.concat(whole("x0"), F.lit(","), whole("y0"), F.lit(" "), whole("x1"), F.lit(","), whole("y1"))
    line = F.concat(F.lit("page "), F.col("page").cast("string"), F.lit("  '"), F.col("text"), F.lit("'  ["), place, F.lit("]"))
    return hits.withColumns({"width": F.col("x1") - F.col("x0"), "height": F.col("y1") - F.col("y0"), "description": line})


def crop(hits: DataFrame, pages: DataFrame | tuple[float, float], padding: float = CROP_X, vertical: float = CROP_Y) -> DataFrame:
    """Adds the crop rectangle of each hit (cx0, cy0, cx1, cy1), clamped to the page.

    pages: (doc_id, page, width, height), or the width and height of all pages.
    """
    if isinstance(pages, tuple):
        one = hits.withColumns({"width": F.lit(pages[0]), "height": F.lit(pages[1])})
    else:
        one = hits.join(pages.select("doc_id", "page", "width", "height"), ["doc_id", "page"])
    return one.withColumns({
        "cx0": F.greatest(F.lit(0.0), F.col("x0") - padding), "cy0": F.greatest(F.lit(0.0), F.col("y0") - vertical),
        "cx1": F.least(F.col("width"), F.col("x1") + padding), "cy1": F.least(F.col("height"), F.col("y1") + vertical),
    }).drop("width", "height")
