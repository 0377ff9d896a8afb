"""Queries on fields, citations and packs, with their SQL."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.operators import evidence as E
from tallyfold.operators import render
from tallyfold.sources.tables import table

_INVOICE = ("document_id", "document_type", "source_system", "source_file", "page_count", "currency", "payment_terms", "seller", "buyer", "issue_date", "due_date", "po_reference", "lines", "totals")

_ORDER = ("document_id", "document_type", "source_system", "source_file", "page_count", "currency", "payment_terms", "vendor", "order_date", "delivery_date", "contract_reference", "requisition_number", "lines", "order_value")
_CONTRACT = ("document_id", "document_type", "source_system", "source_file", "page_count", "payment_terms", "counterparty", "effective_date", "expiry_date", "governing_law", "rate_schedule")
#: All documents that evidence is cited from; a document_id names one document whatever its table
_TABLES = {"invoices": (*_INVOICE, "removed_duplicates"), "purchase_orders": _ORDER, "contracts": _CONTRACT}


def _first(spark: SparkSession, d: str, name: str, columns: tuple[str, ...]) -> DataFrame:
    """Each document once, as first delivered."""
    df = table(spark, d, name)
    return df.where("document_id is not null").groupBy(F.col("document_id").alias("k")).agg(F.min_by(F.struct(*columns), F.struct("ingested_at", "row_id")).alias("x")).select("k", "x.*")


def _union(parts: Iterable[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def field_paths(spark: SparkSession, d: str) -> DataFrame:
    """Every field of the documents of all three types, with what was removed from them."""
    return _union(E.fields(table(spark, d, name).select("row_id", *columns), ["row_id"]).select(F.lit(name).alias("table_name"), "row_id", "field_path", "value") for name, columns in _TABLES.items())


def _cited(spark: SparkSession, d: str) -> DataFrame:
    """All evidence cited again from the documents themselves, whatever their type; deleted ones can still be cited."""
    asked = table(spark, d, "evidence_items").select("row_id", "pack_id", "ord", "document_id", "document_type", "field_path", "confidence", "note")
    # distinct paths per document: of 5.7 million fields at scale 1 only those asked for are shuffled
    paths = asked.where("document_id is not null").groupBy(F.col("document_id").alias("k")).agg(F.collect_set("field_path").alias("asked_paths"))
    of = _union(E.fields(_first(spark, d, name, columns).join(paths, "k"), ["k"], wanted="asked_paths") for name, columns in _TABLES.items()).withColumnRenamed("k", "document_id")
    return E.cite(asked, of)


def cite_fields(spark: SparkSession, d: str) -> DataFrame:
    return _cited(spark, d).where("present").select("row_id", "document_type", "document_id", "field_path", "value")


def try_cite_absent(spark: SparkSession, d: str) -> DataFrame:
    return _cited(spark, d).where("not present").select("row_id", "document_type", "document_id", "field_path", "note")


def _packs(spark: SparkSession, d: str) -> DataFrame:
    return E.packs(table(spark, d, "evidence_items").where("pack_id is not null"))


def evidence_packs(spark: SparkSession, d: str) -> DataFrame:
    return _packs(spark, d).select("pack_id", "n_items", "n_located", "weakest_confidence", F.array_join("documents", ",").alias("documents"), F.array_join("sources", ",").alias("sources"))


def integrity_hash(spark: SparkSession, d: str) -> DataFrame:
    return _packs(spark, d).select("pack_id", "integrity_hash")


def integrity_hash_json(spark: SparkSession, d: str) -> DataFrame:
    return E.json_hashed(_packs(spark, d))


def pack_markdown(spark: SparkSession, d: str) -> DataFrame:
    return render.pack_markdown(_packs(spark, d).withColumn("conclusion", F.lit("Checked against the source documents.")))


def pack_json(spark: SparkSession, d: str) -> DataFrame:
    return render.pack_json(_packs(spark, d).withColumn("conclusion", F.lit(None).cast("string")))


def item_descriptions(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "evidence_items")
    return df.select("row_id", E.described(df).alias("description"))


QUERIES = {f.__name__: f for f in (field_paths, cite_fields, try_cite_absent, evidence_packs, integrity_hash, integrity_hash_json, pack_markdown, pack_json, item_descriptions)}

_D = lambda x: f"regexp_replace(regexp_replace(CAST(CAST(CAST({x} AS VARCHAR) AS DECIMAL(24,6)) AS VARCHAR), '0+$', ''), '\\.$', '')"
_SCALARS = ("document_id", "document_type", "source_system", "source_file", "currency", "payment_terms", "issue_date", "due_date", "po_reference")


def _fields(src: str, key: str) -> str:
    parts = [f"SELECT {key}, '{c}' AS field_path, {c} AS value FROM {src}" for c in _SCALARS]
    parts.append(f"SELECT {key}, 'page_count', CAST(page_count AS VARCHAR) FROM {src}")
    parts += [f"SELECT {key}, '{p}.{c}', {p}.{c} FROM {src} WHERE {p} IS NOT NULL" for p in ("seller", "buyer") for c in ("name", "vendor_id", "tax_registration", "location")]
    parts += [f"SELECT {key}, 'totals.{c}', {_D('totals.' + c)} FROM {src} WHERE totals IS NOT NULL" for c in ("subtotal", "tax_total", "grand_total")]
    lines = f"(SELECT {key}, unnest(lines) AS l, generate_subscripts(lines, 1) - 1 AS i FROM {src})"
    parts += [f"SELECT {key}, 'lines[' || i || '].{c}', {'CAST(l.line_number AS VARCHAR)' if c == 'line_number' else 'l.' + c} FROM {lines} WHERE l IS NOT NULL" for c in ("line_number", "description", "unit_of_measure")]
    parts += [f"SELECT {key}, 'lines[' || i || '].{c}', {_D('l.' + c)} FROM {lines} WHERE l IS NOT NULL" for c in ("quantity", "unit_price", "net_amount", "tax_rate", "tax_amount", "line_total")]
    return " UNION ALL ".join(parts)


def _other_fields(src: str, key: str, scalars: tuple[str, ...], party: str, items: str, texts: tuple[str, ...], figures: tuple[str, ...]) -> str:
    parts = [f"SELECT {key}, '{c}' AS field_path, CAST({c} AS VARCHAR) AS value FROM {src}" for c in scalars]
    parts += [f"SELECT {key}, '{party}.{c}', {party}.{c} FROM {src} WHERE {party} IS NOT NULL" for c in ("name", "vendor_id", "tax_registration", "location")]
    each = f"(SELECT {key}, unnest({items}) AS l, generate_subscripts({items}, 1) - 1 AS i FROM {src})"
    parts += [f"SELECT {key}, '{items}[' || i || '].{c}', {f'CAST(l.{c} AS VARCHAR)' if c in texts else _D('l.' + c)} FROM {each} WHERE l IS NOT NULL" for c in texts + figures]
    return " UNION ALL ".join(parts)


def _order_fields(src: str, key: str) -> str:
    scalars = ("document_id", "document_type", "source_system", "source_file", "page_count", "currency", "payment_terms", "order_date", "delivery_date", "contract_reference", "requisition_number")
    lines = _other_fields(src, key, scalars, "vendor", "lines", ("line_number", "description", "unit_of_measure"), ("quantity", "unit_price", "net_amount", "tax_rate", "tax_amount", "line_total"))
    return f"{lines} UNION ALL SELECT {key}, 'order_value', {_D('order_value')} FROM {src}"


def _contract_fields(src: str, key: str) -> str:
    scalars = ("document_id", "document_type", "source_system", "source_file", "page_count", "payment_terms", "effective_date", "expiry_date", "governing_law")
    return _other_fields(src, key, scalars, "counterparty", "rate_schedule", ("description", "unit_of_measure"), ("max_unit_price",))


def _invoice_fields(src: str, key: str) -> str:
    removed = f"(SELECT {key}, unnest(removed_duplicates) AS l, generate_subscripts(removed_duplicates, 1) - 1 AS i FROM {src})"
    parts = [f"SELECT {key}, 'removed_duplicates[' || i || '].{c}', CAST(l.{c} AS VARCHAR) FROM {removed} WHERE l IS NOT NULL" for c in ("line_number", "description", "page", "words", "reason")]
    return " UNION ALL ".join([_fields(src, key), *parts])


_OF = {"invoices": _invoice_fields, "purchase_orders": _order_fields, "contracts": _contract_fields}
_FIRST = lambda t: f"(SELECT *, document_id AS k FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY ingested_at, row_id) AS rn FROM {t} WHERE document_id IS NOT NULL) WHERE rn = 1)"
_CITED = f"""
fields AS ({" UNION ALL ".join(f"SELECT k AS document_id, field_path, value, true AS present FROM ({of(_FIRST(t), 'k')})" for t, of in _OF.items())}),
cited AS (SELECT e.row_id, e.document_type, e.document_id, e.field_path, f.value, coalesce(f.present, false) AND regexp_full_match(e.field_path, '[A-Za-z_][A-Za-z0-9_]*(\\[[0-9]+\\])?(\\.[A-Za-z_][A-Za-z0-9_]*(\\[[0-9]+\\])?)*') AS present
  FROM evidence_items e LEFT JOIN fields f ON f.document_id = e.document_id AND f.field_path = e.field_path)
"""
_T = lambda x: f"coalesce('\"' || replace(replace(CAST({x} AS VARCHAR), '\\', '\\\\'), '\"', '\\\"') || '\"', 'null')"
_NUM = lambda x: f"coalesce(CAST(TRY_CAST(CAST({x} AS VARCHAR) AS DECIMAL(24,6)) AS VARCHAR), 'null')"
_CANON = f"""'{{"bounding_box":' || CASE WHEN bounding_box IS NULL THEN 'null' ELSE '[' || {_NUM('bounding_box.x0')} || ',' || {_NUM('bounding_box.y0')} || ',' || {_NUM('bounding_box.x1')} || ',' || {_NUM('bounding_box.y1')} || ']' END ||
 ',"confidence":' || {_NUM('confidence')} || ',"document_id":' || {_T('document_id')} || ',"document_type":' || {_T('document_type')} || ',"field_path":' || {_T('field_path')} || ',"note":' || {_T('note')} ||
 ',"page":' || coalesce(CAST(page AS VARCHAR), 'null') || ',"source_system":' || {_T('source_system')} || ',"value":' || {_T('value')} || '}}'"""

_TWO = lambda x: f"CAST(CAST(round(TRY_CAST(CAST({x} AS VARCHAR) AS DECIMAL(24,6)), 2) AS DECIMAL(24,2)) AS VARCHAR)"
#: A double as both engines print it in JSON; NaN is text there.
_DOUBLE = lambda x: f"CASE WHEN isnan({x}) THEN '\"NaN\"' ELSE CAST({x} AS VARCHAR) END"
_REPR = lambda x: f"CASE WHEN {x} IS NULL THEN 'null' WHEN isnan({x}) THEN 'NaN' ELSE CAST({x} AS VARCHAR) END"
#: Text in JSON with everything beyond ASCII escaped.
_ASCII = lambda x: f"coalesce('\"' || array_to_string(list_transform(string_split(replace(replace({x}, '\\', '\\\\'), '\"', '\\\"'), ''), lambda ch: CASE WHEN ord(ch) > 126 THEN printf('\\u%04x', ord(ch)) ELSE ch END), '') || '\"', 'null')"
_NONE = lambda x: f"coalesce(CAST({x} AS VARCHAR), 'None')"
_PACKED = f"""
e AS (SELECT *, {_CANON} AS c FROM evidence_items WHERE pack_id IS NOT NULL),
d AS (SELECT pack_id, document_id, min(ord) AS o FROM e WHERE document_id IS NOT NULL GROUP BY ALL),
dd AS (SELECT pack_id, string_agg(document_id, ', ' ORDER BY o, document_id) AS documents, string_agg({_T('document_id')}, ',' ORDER BY o, document_id) AS document_list FROM d GROUP BY pack_id),
ss AS (SELECT pack_id, string_agg(source_system, ', ' ORDER BY source_system) AS sources, string_agg({_T('source_system')}, ',' ORDER BY source_system) AS source_list FROM (SELECT DISTINCT pack_id, source_system FROM e WHERE source_system IS NOT NULL) GROUP BY pack_id),
ii AS (
  SELECT pack_id, left(sha256('[' || string_agg(c, ',' ORDER BY ord, c) || ']'), 16) AS integrity_hash, min(confidence) FILTER (WHERE NOT isnan(confidence)) AS weakest_confidence,
    string_agg('| ' || {_NONE('source_system')} || ' | ' || {_NONE('document_id')} || ' | `' || {_NONE('field_path')} || '` | ' || {_NONE('value')} || ' | ' || coalesce({_TWO('confidence')}, '-') || ' |', chr(10) ORDER BY ord, c) AS rows,
    string_agg('{{"source_system":' || {_T('source_system')} || ',"document_id":' || {_T('document_id')} || ',"document_type":' || {_T('document_type')} || ',"field_path":' || {_T('field_path')} || ',"value":' || {_T('value')} || ',"confidence":' || coalesce({_DOUBLE('confidence')}, 'null') ||
      ',"page":' || coalesce(CAST(page AS VARCHAR), 'null') || ',"bounding_box":' || CASE WHEN bounding_box IS NULL THEN 'null' ELSE '{{"x0":' || coalesce({_DOUBLE('bounding_box.x0')}, 'null') || ',"y0":' || coalesce({_DOUBLE('bounding_box.y0')}, 'null') || ',"x1":' || coalesce({_DOUBLE('bounding_box.x1')}, 'null') || ',"y1":' || coalesce({_DOUBLE('bounding_box.y1')}, 'null') || '}}' END ||
      ',"note":' || {_T('note')} || '}}', ',' ORDER BY ord, c) AS items
  FROM e GROUP BY pack_id
),
p AS (SELECT ii.*, coalesce(dd.documents, '') AS documents, coalesce(dd.document_list, '') AS document_list, coalesce(ss.sources, '') AS sources, coalesce(ss.source_list, '') AS source_list FROM ii LEFT JOIN dd USING (pack_id) LEFT JOIN ss USING (pack_id))
"""

ORACLE = {
    "field_paths": " UNION ALL ".join(f"SELECT '{t}' AS table_name, row_id, field_path, value FROM ({of(t, 'row_id')})" for t, of in _OF.items()),
    "cite_fields": f"WITH {_CITED} SELECT row_id, document_type, document_id, field_path, value FROM cited WHERE present",
    "try_cite_absent": f"WITH {_CITED} SELECT row_id, document_type, document_id, field_path, '{E.ABSENT}' AS note FROM cited WHERE NOT present",
    "evidence_packs": """
WITH d AS (SELECT pack_id, document_id, min(ord) AS o FROM evidence_items WHERE pack_id IS NOT NULL AND document_id IS NOT NULL GROUP BY ALL),
dd AS (SELECT pack_id, string_agg(document_id, ',' ORDER BY o, document_id) AS documents FROM d GROUP BY pack_id)
SELECT e.pack_id, CAST(count(*) AS INTEGER) AS n_items, CAST(count(bounding_box) AS INTEGER) AS n_located, min(confidence) FILTER (WHERE NOT isnan(confidence)) AS weakest_confidence, coalesce(any_value(dd.documents), '') AS documents,
  coalesce((SELECT string_agg(s, ',' ORDER BY s) FROM (SELECT DISTINCT source_system AS s FROM evidence_items x WHERE x.pack_id = e.pack_id AND source_system IS NOT NULL)), '') AS sources
FROM evidence_items e LEFT JOIN dd USING (pack_id) WHERE e.pack_id IS NOT NULL GROUP BY e.pack_id""",
    "integrity_hash": f"""
WITH c AS (SELECT pack_id, ord, {_CANON} AS c FROM evidence_items WHERE pack_id IS NOT NULL)
SELECT pack_id, left(sha256('[' || string_agg(c, ',' ORDER BY ord, c) || ']'), 16) AS integrity_hash FROM c GROUP BY pack_id""",
    "item_descriptions": """
SELECT row_id, source_system || '/' || document_id || '  ' || field_path || ' = ' || coalesce(value, 'None') ||
  CASE WHEN confidence IS NULL THEN '' ELSE '  (conf ' || coalesce(printf('%.2f', CAST(round(TRY_CAST(CAST(confidence AS VARCHAR) AS DECIMAL(24,6)), 2) AS DOUBLE)), 'null') || ')' END AS description FROM evidence_items""",
    "pack_markdown": f"""
WITH {_PACKED}
SELECT p.pack_id, '### Evidence pack ' || p.pack_id || chr(10) || chr(10) || '**Conclusion.** Checked against the source documents.' || chr(10) || chr(10) || 'Documents: ' || documents || chr(10) || 'Sources: ' || sources ||
  coalesce(chr(10) || 'Weakest citation confidence: ' || {_TWO('weakest_confidence')}, '') || chr(10) || chr(10) || '| Source | Document | Field | Value | Confidence |' || chr(10) || '| --- | --- | --- | --- | --- |' || chr(10) || rows || chr(10) || chr(10) ||
  'Integrity hash `' || integrity_hash || '`' AS markdown FROM p""",
    "pack_json": f"""
WITH {_PACKED}
SELECT pack_id, '{{"pack_id":' || {_T('pack_id')} || ',"conclusion":null,"documents":[' || document_list || '],"sources":[' || source_list || '],"weakest_confidence":' || coalesce({_DOUBLE('weakest_confidence')}, 'null') || ',"integrity_hash":"' || integrity_hash || '","items":[' || items || ']}}' AS pack FROM p""",
    "integrity_hash_json": f"""
WITH c AS (SELECT pack_id, ord, {_CANON} AS c, '{{"bounding_box": ' || CASE WHEN bounding_box IS NULL THEN 'null' ELSE '[' || {_REPR('bounding_box.x0')} || ', ' || {_REPR('bounding_box.y0')} || ', ' || {_REPR('bounding_box.x1')} || ', ' || {_REPR('bounding_box.y1')} || ']' END ||
  ', "confidence": ' || {_REPR('confidence')} || ', "document_id": ' || {_ASCII('document_id')} || ', "document_type": ' || {_ASCII('document_type')} || ', "field_path": ' || {_ASCII('field_path')} || ', "note": ' || {_ASCII('note')} || ', "page": ' || coalesce(CAST(page AS VARCHAR), 'null') ||
  ', "source_system": ' || {_ASCII('source_system')} || ', "value": ' || {_ASCII('value')} || '}}' AS j FROM evidence_items WHERE pack_id IS NOT NULL)
SELECT pack_id, left(sha256('[' || string_agg(j, ', ' ORDER BY ord, c) || ']'), 16) AS integrity_hash FROM c GROUP BY pack_id""",
}
