"""Queries on the words of plain texts, set on a grid, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.functions import numbers, text
from tallyfold.operators import layout, lookup
from tallyfold.sources import words as W
from tallyfold.sources.tables import spread, table

NEEDLE, LABEL, KEY = "credit note of", "waybill", r"^(INV|PO|CTR)-[0-9]"


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents").select("doc_id", "text"))


def _documents(spark: SparkSession, d: str) -> layout.Documents:
    return W.text_documents(_texts(spark, d))


def _with_key(spark: SparkSession, d: str) -> layout.Documents:
    """Documents in which a business key may stand at the beginning of a word; the rest is not scanned."""
    return W.text_documents(_texts(spark, d).where(F.col("text").rlike(KEY.lstrip("^"))))


def document_words(spark: SparkSession, d: str) -> DataFrame:
    return _documents(spark, d).flat()


def row_cluster(spark: SparkSession, d: str) -> DataFrame:
    return layout.rows(_documents(spark, d)).select("doc_id", "page", "page_row_no", "text", F.col("top").alias("y0"))


def document_text(spark: SparkSession, d: str) -> DataFrame:
    return layout.texts(_documents(spark, d)).select("doc_id", "page_count", "text")


def bounding_boxes(spark: SparkSession, d: str) -> DataFrame:
    return layout.rows(_documents(spark, d)).drop("text", "top")


def parse_figures(spark: SparkSession, d: str) -> DataFrame:
    """Distinct words that are figures, with their value and count."""
    w = _documents(spark, d).flat().groupBy("text").agg(F.count(F.lit(1)).alias("n"))
    return w.select("text", numbers.figure(F.col("text")).alias("value"), "n").where("value is not null")


def first_row_containing(spark: SparkSession, d: str) -> DataFrame:
    return lookup.first_row(_documents(spark, d), "line", "is above")


def literal_search(spark: SparkSession, d: str) -> DataFrame:
    return lookup.search(_documents(spark, d), NEEDLE)


def pattern_search(spark: SparkSession, d: str) -> DataFrame:
    return lookup.search_pattern(_with_key(spark, d), KEY)


def reference_scan(spark: SparkSession, d: str) -> DataFrame:
    """The first business key of each document."""
    return lookup.first_hit(_with_key(spark, d), lookup.pattern(KEY)).select("doc_id", "page", "text")


def value_beside_right(spark: SparkSession, d: str) -> DataFrame:
    return lookup.value_beside(_documents(spark, d).holding([LABEL]), lookup.word(LABEL), "right")


def value_beside_below(spark: SparkSession, d: str) -> DataFrame:
    return lookup.value_beside(_documents(spark, d).holding(["INVOICE"]), lookup.word("INVOICE"), "below")


def row_widening(spark: SparkSession, d: str) -> DataFrame:
    return lookup.widened_rows(_with_key(spark, d), lookup.pattern(KEY), W.GRID_WIDTH)


def crop_rectangles(spark: SparkSession, d: str) -> DataFrame:
    hits = lookup.search_pattern(_with_key(spark, d), KEY)
    return lookup.crop(hits, (W.GRID_WIDTH, W.GRID_HEIGHT)).select("doc_id", "page", "text", "cx0", "cy0", "cx1", "cy1")


def hit_descriptions(spark: SparkSession, d: str) -> DataFrame:
    hits = lookup.search_pattern(_with_key(spark, d), KEY)
    return lookup.measured(hits).select("doc_id", "page", "width", "height", "description")


def row_crops(spark: SparkSession, d: str) -> DataFrame:
    """The crop rectangle of the whole row of each hit, with the text of the row."""
    rows = lookup.widened_rows(_with_key(spark, d), lookup.pattern(KEY), W.GRID_WIDTH)
    return lookup.crop(rows, (W.GRID_WIDTH, W.GRID_HEIGHT)).select("doc_id", "page", "text", "cx0", "cy0", "cx1", "cy1")


def text_pages(spark: SparkSession, d: str) -> DataFrame:
    return W.text_pages(_texts(spark, d))


def text_layer_status(spark: SparkSession, d: str) -> DataFrame:
    return layout.status(_documents(spark, d)).drop("document_type")


def scalar_functions(spark: SparkSession, d: str) -> DataFrame:
    """Slugs, masked digits, valid paths, positions and party lines of the evidence's values and paths."""
    e = table(spark, d, "evidence_items")
    return e.select(
        "row_id", text.slug(F.col("value")).alias("slug"), text.masked_digits(F.col("value")).alias("masked"), text.valid_path(F.col("field_path")).alias("valid_path"),
        text.described_position(F.col("page"), F.col("bounding_box.x0"), F.col("bounding_box.y0")).alias("position"), text.after_dot(F.col("field_path")).alias("after_dot"), numbers.printed(F.col("bounding_box.x1")).alias("printed"),
    )


QUERIES = {f.__name__: f for f in (
    document_words, row_cluster, document_text, bounding_boxes, parse_figures, first_row_containing, literal_search, pattern_search, reference_scan, value_beside_right, value_beside_below,
    row_widening, crop_rectangles, row_crops, hit_descriptions, text_pages, text_layer_status, scalar_functions,
)}

_W = r"""
ln AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS s, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents WHERE text IS NOT NULL),
pc AS (SELECT doc_id, line, unnest(string_split(s, ' ')) AS t, generate_subscripts(string_split(s, ' '), 1) AS k FROM ln),
at AS (SELECT *, coalesce(sum(length(t) + 1) OVER (PARTITION BY doc_id, line ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c FROM pc),
words AS (SELECT doc_id, CAST(line // 60 AS INTEGER) AS page, line, k, t AS text, CAST(c * 6 AS DOUBLE) AS x0, CAST((line % 60) * 12 + 40 AS DOUBLE) AS y0, CAST((c + length(t)) * 6 AS DOUBLE) AS x1, CAST((line % 60) * 12 + 50 AS DOUBLE) AS y1 FROM at WHERE t <> ''),
rows AS (SELECT doc_id, page, line, CAST(row_number() OVER (PARTITION BY doc_id, page ORDER BY line) - 1 AS INTEGER) AS page_row_no, string_agg(text, ' ' ORDER BY k) AS text, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM words GROUP BY doc_id, page, line),
pages AS (SELECT doc_id, CAST(unnest(range(CAST(greatest(1, ceil(len(string_split(coalesce(text, ''), chr(10))) / 60)) AS BIGINT))) AS INTEGER) AS page, 6000.0::DOUBLE AS width, 800.0::DOUBLE AS height FROM documents)
"""
_W = _W.replace("at AS (", "placed AS (").replace("FROM at WHERE", "FROM placed WHERE")
_FIG = "regexp_replace(trim(text), '(?i)^(EUR|USD|GBP|SEK|NOK|DKK|CHF|INR|€|\\$|£|₹)\\s*([\\d(-])', '\\2')"

ORACLE = {
    "document_words": f"WITH {_W} SELECT doc_id, page, text, x0, y0, x1, y1 FROM words",
    "row_cluster": f"WITH {_W} SELECT doc_id, page, page_row_no, text, y0 FROM rows",
    "document_text": f"WITH {_W} SELECT doc_id, CAST(max(page) + 1 AS INTEGER) AS page_count, string_agg(text, chr(10) ORDER BY line) AS text FROM rows WHERE NOT (doc_id, line) IN (SELECT doc_id, line FROM furniture) GROUP BY doc_id",
    "bounding_boxes": f"WITH {_W} SELECT doc_id, page, page_row_no, x0, y0, x1, y1 FROM rows",
    "parse_figures": f"WITH {_W}, f AS (SELECT text, {_FIG} AS p, count(*) AS n FROM words GROUP BY text) SELECT text, TRY_CAST(replace(p, ',', '') AS DOUBLE) AS value, n FROM f WHERE regexp_matches(p, '^-?[\\d,]+\\.?\\d*$') AND TRY_CAST(replace(p, ',', '') AS DOUBLE) IS NOT NULL",
    "first_row_containing": f"WITH {_W}, n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS row_no FROM rows WHERE NOT (doc_id, line) IN (SELECT doc_id, line FROM furniture)) SELECT doc_id, CAST(min(row_no) AS INTEGER) AS row_no FROM n WHERE contains(lower(text), 'line') AND contains(lower(text), 'is above') GROUP BY doc_id",
    "literal_search": f"WITH {_W}, s AS (SELECT *, lead(text) OVER w AS t2, lead(text, 2) OVER w AS t3, lead(x1, 2) OVER w AS e FROM words WINDOW w AS (PARTITION BY doc_id, line ORDER BY k)) SELECT s.doc_id, s.page, r.page_row_no, '{NEEDLE}' AS text, s.x0, s.y0, s.e AS x1, s.y1 FROM s JOIN rows r USING (doc_id, line) WHERE s.text = 'credit' AND t2 = 'note' AND t3 = 'of'",
    "pattern_search": f"WITH {_W} SELECT doc_id, page, text, x0, y0, x1, y1 FROM words WHERE regexp_matches(text, '{KEY}')",
    "reference_scan": f"WITH {_W} SELECT doc_id, page, text FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line, k) AS rn FROM words WHERE regexp_matches(text, '{KEY}')) WHERE rn = 1",
    "value_beside_right": f"""WITH {_W}, a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY line, k) AS rn FROM words WHERE text = '{LABEL}') WHERE rn = 1),
c AS (SELECT a.doc_id, a.page, w.text, w.x0, w.y0, w.x1, w.y1, min(w.x0) OVER (PARTITION BY a.doc_id, a.page) AS f FROM a JOIN words w ON w.doc_id = a.doc_id AND w.line = a.line AND w.x0 > a.x1)
SELECT doc_id, page, string_agg(text, ' ' ORDER BY x0) AS text, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM c WHERE x0 - f < 140 GROUP BY doc_id, page""",
    "value_beside_below": f"""WITH {_W}, a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY line, k) AS rn FROM words WHERE text = 'INVOICE') WHERE rn = 1),
c AS (SELECT a.doc_id, a.page, w.text, w.x0, w.y0, w.x1, w.y1, first_value(w.x0) OVER o AS f, first_value(w.y0) OVER o AS fy FROM a JOIN words w ON w.doc_id = a.doc_id AND w.page = a.page AND w.y0 > a.y1 AND abs(w.x0 - a.x0) < 26 AND w.y0 - a.y1 < 22
  WINDOW o AS (PARTITION BY a.doc_id, a.page ORDER BY w.y0, w.x0))
SELECT doc_id, page, string_agg(text, ' ' ORDER BY x0) AS text, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM c WHERE y0 = fy AND x0 - f < 140 GROUP BY doc_id, page""",
    "row_widening": f"WITH {_W} SELECT w.doc_id, w.page, r.text, greatest(0, r.x0 - 8) AS x0, r.y0 - 8 AS y0, least(6000, r.x1 + 8) AS x1, r.y1 + 8 AS y1 FROM words w JOIN rows r USING (doc_id, line) WHERE regexp_matches(w.text, '{KEY}')",
    "crop_rectangles": f"WITH {_W} SELECT doc_id, page, text, greatest(0, x0 - 4) AS cx0, greatest(0, y0 - 1.5) AS cy0, least(6000, x1 + 4) AS cx1, least(800, y1 + 1.5) AS cy1 FROM words WHERE regexp_matches(text, '{KEY}')",
    "hit_descriptions": f"WITH {_W} SELECT doc_id, page, x1 - x0 AS width, y1 - y0 AS height, 'page ' || page || '  ''' || text || '''  [' || CAST(x0 AS BIGINT) || ',' || CAST(y0 AS BIGINT) || ' ' || CAST(x1 AS BIGINT) || ',' || CAST(y1 AS BIGINT) || ']' AS description FROM words WHERE regexp_matches(text, '{KEY}')",
    "row_crops": f"WITH {_W} SELECT w.doc_id, w.page, r.text, greatest(0, greatest(0, r.x0 - 8) - 4) AS cx0, greatest(0, r.y0 - 9.5) AS cy0, least(6000, least(6000, r.x1 + 8) + 4) AS cx1, least(800, r.y1 + 9.5) AS cy1 FROM words w JOIN rows r USING (doc_id, line) WHERE regexp_matches(w.text, '{KEY}')",
    "text_pages": f"WITH {_W} SELECT doc_id, page, width, height FROM pages",
}
_FURNITURE = """, banded AS (
  SELECT r.doc_id, r.line, CAST(round_even(r.y0, 0) AS BIGINT) || '|' || regexp_replace(r.text, '[0-9]+', '#', 'g') AS shape FROM rows r JOIN (SELECT doc_id FROM rows GROUP BY doc_id HAVING max(page) >= 1) m USING (doc_id) WHERE NOT (r.y0 > 96 AND r.y0 < 704)
), furniture AS (SELECT doc_id, line FROM banded JOIN (SELECT doc_id, shape FROM banded GROUP BY ALL HAVING count(*) > 1) s USING (doc_id, shape))"""
for _k in ("document_text", "first_row_containing"):
    ORACLE[_k] = ORACLE[_k].replace(_W, _W + _FURNITURE, 1)
ORACLE["text_layer_status"] = f"""WITH {_W}, heads AS (SELECT doc_id, upper(string_agg(h, chr(10) ORDER BY page)) AS h FROM (SELECT doc_id, page, left(string_agg(text, chr(10) ORDER BY line), 400) AS h FROM rows GROUP BY doc_id, page) GROUP BY doc_id)
SELECT p.doc_id, CAST(max(page) + 1 AS INTEGER) AS page_count, CASE WHEN any_value(h.h) IS NULL THEN 'NO_TEXT_LAYER' WHEN contains(any_value(h.h), 'COMMERCIAL INVOICE') OR contains(any_value(h.h), 'PURCHASE ORDER') OR contains(any_value(h.h), 'MASTER SUPPLY AGREEMENT') THEN 'OK' ELSE 'UNKNOWN_LAYOUT' END AS status
FROM pages p LEFT JOIN heads h USING (doc_id) GROUP BY p.doc_id"""
ORACLE["scalar_functions"] = r"""
SELECT row_id, left(regexp_replace(value, '[^\p{L}\p{N}]', '_', 'g'), 30) AS slug, regexp_replace(value, '[0-9]+', '#', 'g') AS masked, regexp_full_match(field_path, '[A-Za-z_][A-Za-z0-9_]*(\[[0-9]+\])?(\.[A-Za-z_][A-Za-z0-9_]*(\[[0-9]+\])?)*') AS valid_path,
  'p' || (page + 1) || ' [' || CAST(round_even(bounding_box.x0, 0) AS BIGINT) || ',' || CAST(round_even(bounding_box.y0, 0) AS BIGINT) || ']' AS position, trim(regexp_replace(field_path, '^[^.]*\.', '')) AS after_dot, format('{:,.2f}', bounding_box.x1) AS printed FROM evidence_items"""
