"""Queries on references, nested records and column profiles, with their SQL."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.operators import nested, orphans, profile
from tallyfold.sources.tables import spread, table


def _references(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    invoices, orders, contracts, evidence = (table(spark, d, t) for t in ("invoices", "purchase_orders", "contracts", "evidence_items"))
    refs = orphans.references([
        orphans.References("invoices", invoices, "po_reference", ("PO",)),
        orphans.References("purchase_orders", orders, "contract_reference", ("CTR",)),
        orphans.References("evidence_items", evidence, "document_id", ("PO", "CTR", "INV")),
    ])
    there = orphans.parents([
        orphans.Parents("INV", invoices),
        orphans.Parents("PO", orders, deleted="deleted_at"),
        orphans.Parents("CTR", contracts, deleted="deleted_at"),
    ])
    return refs, there


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    found = orphans.find_orphans(*_references(spark, d))
    return found.select("ref_table", F.date_format("at", "yyyy-MM").alias("ref_month"), "row_id")


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_report(orphans.find_orphans(*_references(spark, d)))


def p2_runs(spark: SparkSession, d: str) -> DataFrame:
    return orphans.key_runs(_references(spark, d)[1]).select("kind", "run_start", "run_end", "keys")


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    return nested.shred(spread(table(spark, d, "raw_records").select("record_id", "raw")))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return nested.children(_nodes(spark, d)).select("record_id", "child", "parent_ord", "ord")


def p3_records(spark: SparkSession, d: str) -> DataFrame:
    return nested.records(_nodes(spark, d))


def p3_objects(spark: SparkSession, d: str) -> DataFrame:
    return nested.objects(_nodes(spark, d))


def p3_bridge(spark: SparkSession, d: str) -> DataFrame:
    return nested.bridge(_nodes(spark, d))


def _flat(child: str) -> Callable[[SparkSession, str], DataFrame]:
    """The flat table, linked by record and ordinals; the identities of its rows are in p3_bridge."""
    return lambda spark, d: nested.flat(_nodes(spark, d), child).drop("node_id", "parent_id")


#: Tables of p5_profile: the column that identifies a row, and that of its load, if there is one; their SQL says nothing of these two
PROFILED = {
    "invoices": ("row_id", "load_id"), "purchase_orders": ("row_id", "load_id"), "evidence_items": ("row_id", "load_id"),
    "contracts": ("row_id", None), "raw_records": ("record_id", None), "documents": ("doc_id", None),
}
#: All tables; p5_profile_all and p5_shift_all have every column of them
EVERY = PROFILED | {"given_names": (None, None)}
LOADED = [name for name, (_, load) in PROFILED.items() if load]


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    asked: dict[str, list[tuple[str, str]]] = {}
    for name, column in profile.FORMS:
        asked.setdefault(name, []).append((column, f"`{column}`"))
    cells = reduce(DataFrame.unionByName, (profile.cells(table(spark, d, name), name, picked) for name, picked in asked.items()))
    return profile.findings(cells, profile.FORMS, form_only={"purchase_orders"}, no_shift={"po_reference"})


def _all_cells(spark: SparkSession, d: str, names: Iterable[str], keys: bool = True) -> DataFrame:
    """Every column of tables, fields of structs and arrays included; without ``keys``, all but those that identify rows and loads."""
    return reduce(DataFrame.unionByName, (profile.all_cells(table(spark, d, n), n, () if keys else EVERY[n][:1], EVERY[n][1], load_too=keys) for n in names))


def _profiled(cells: DataFrame) -> DataFrame:
    return profile.profile(profile.with_validity(profile.value_counts(cells), profile.FORMS))


def p5_profile(spark: SparkSession, d: str) -> DataFrame:
    return _profiled(_all_cells(spark, d, PROFILED, keys=False))


def p5_profile_all(spark: SparkSession, d: str) -> DataFrame:
    """p5_profile with the columns that its SQL has not: identities, loads, given names."""
    return _profiled(_all_cells(spark, d, EVERY))


def _shifted(cells: DataFrame) -> DataFrame:
    counts = profile.categories(profile.with_validity(cells, profile.FORMS))
    return profile.shifts(counts).select("table_name", "column_name", "load_id", "n_valid", F.round("distance", 6).alias("distance"), F.round("psi", 4).alias("psi"), F.round("chi2", 3).alias("chi2"))


def p5_shift(spark: SparkSession, d: str) -> DataFrame:
    """Change of distribution of the columns of the tables that come in loads."""
    return _shifted(_all_cells(spark, d, LOADED, keys=False))


def p5_shift_all(spark: SparkSession, d: str) -> DataFrame:
    """p5_shift with the columns that its SQL has not: identities and loads."""
    return _shifted(_all_cells(spark, d, LOADED))


QUERIES = {
    "p2_found": p2_found, "p2_report": p2_report, "p2_runs": p2_runs,
    "p3_found": p3_found, "p3_records": p3_records, "p3_objects": p3_objects, "p3_bridge": p3_bridge,
    "p3_lines": _flat("lines"), "p3_totals": _flat("totals"), "p3_rate_schedule": _flat("rate_schedule"), "p3_allocations": _flat("allocations"),
    "p5_found": p5_found, "p5_profile": p5_profile, "p5_shift": p5_shift, "p5_profile_all": p5_profile_all, "p5_shift_all": p5_shift_all,
}

_REFS = r"""
refs AS (
  SELECT 'invoices' AS ref_table, row_id, po_reference AS ref, ingested_at AS seen_at FROM invoices WHERE regexp_matches(po_reference, '\APO-[0-9]{11}\z')
  UNION ALL
  SELECT 'purchase_orders', row_id, contract_reference, ingested_at FROM purchase_orders WHERE regexp_matches(contract_reference, '\ACTR-[0-9]{6}\z')
  UNION ALL
  SELECT 'evidence_items', row_id, document_id, ingested_at FROM evidence_items
  WHERE regexp_matches(document_id, '\A(PO-[0-9]{11}|CTR-[0-9]{6}|INV-2025-[0-9]{8})\z')
),
there AS (
  SELECT document_id, min(ingested_at) AS first_at, min(deleted_at) AS deleted_at FROM (
    SELECT document_id, ingested_at, CAST(NULL AS TIMESTAMP) AS deleted_at FROM invoices
    UNION ALL SELECT document_id, ingested_at, deleted_at FROM purchase_orders
    UNION ALL SELECT document_id, ingested_at, deleted_at FROM contracts) GROUP BY document_id
),
found AS (
  SELECT r.*, CASE WHEN t.document_id IS NULL THEN 'missing' WHEN t.first_at > r.seen_at THEN 'late' WHEN t.deleted_at <= r.seen_at THEN 'deleted' END AS reason
  FROM refs r LEFT JOIN there t ON t.document_id = r.ref
)
"""

_CELLS = r"""
cells AS (
  SELECT 'invoices' AS table_name, 'payment_terms' AS column_name, load_id, row_id, payment_terms AS value,
         regexp_matches(payment_terms, '\ANet ([1-9]|[1-9][0-9]|1[01][0-9]|120)\z') AS valid, payment_terms AS bin FROM invoices
  UNION ALL
  SELECT 'purchase_orders', 'payment_terms', load_id, row_id, payment_terms, regexp_matches(payment_terms, '\ANet ([1-9]|[1-9][0-9]|1[01][0-9]|120)\z'), payment_terms FROM purchase_orders
  UNION ALL
  SELECT 'invoices', 'po_reference', load_id, row_id, po_reference, regexp_matches(po_reference, '\APO-[0-9]{11}\z'), po_reference FROM invoices
  UNION ALL
  SELECT 'evidence_items', 'confidence', load_id, row_id, CAST(confidence AS VARCHAR), confidence BETWEEN 0 AND 1,
         CASE WHEN confidence BETWEEN 0 AND 1 THEN CAST(CAST(least(floor(confidence * 10), 9) AS INTEGER) AS VARCHAR) END FROM evidence_items
),
counted AS (
  SELECT * FROM cells WHERE table_name <> 'purchase_orders'
),
by_bin AS (SELECT table_name, column_name, load_id, bin, count(*) AS n FROM counted WHERE valid GROUP BY ALL),
whole AS (SELECT table_name, column_name, bin, sum(n) AS all_n FROM by_bin GROUP BY ALL),
grid AS (
  SELECT l.table_name, l.column_name, l.load_id, w.bin, coalesce(b.n, 0) / l.load_n AS p, w.all_n / t.all_n AS q, l.load_n
  FROM (SELECT table_name, column_name, load_id, sum(n) AS load_n FROM by_bin WHERE load_id IS NOT NULL GROUP BY ALL) l
  JOIN whole w USING (table_name, column_name)
  JOIN (SELECT table_name, column_name, sum(all_n) AS all_n FROM whole GROUP BY ALL) t USING (table_name, column_name)
  LEFT JOIN by_bin b ON b.table_name = l.table_name AND b.column_name = l.column_name AND b.load_id = l.load_id AND b.bin = w.bin
)
"""

_PARTY = ("name", "vendor_id", "tax_registration", "location")
_LINE_TEXT, _LINE_NUMBER = ("description", "unit_of_measure"), ("line_number", "quantity", "unit_price", "net_amount", "tax_rate", "tax_amount", "line_total")
_HEAD = ("document_id", "document_type", "source_system", "source_file", "payment_terms")
#: Of each table: columns of texts, of numbers and of times, and arrays with their fields of texts and of numbers
_COLUMNS = {
    "invoices": (
        (*_HEAD, "currency", "issue_date", "due_date", "po_reference", *(f"{p}.{c}" for p in ("seller", "buyer") for c in _PARTY)), ("page_count", "totals.subtotal", "totals.tax_total", "totals.grand_total"), ("ingested_at",),
        {"lines": (_LINE_TEXT, _LINE_NUMBER), "removed_duplicates": (("description", "reason"), ("line_number", "page", "words"))},
    ),
    "purchase_orders": (
        (*_HEAD, "currency", "order_date", "delivery_date", "contract_reference", "requisition_number", *(f"vendor.{c}" for c in _PARTY)), ("page_count", "order_value"), ("ingested_at", "deleted_at"), {"lines": (_LINE_TEXT, _LINE_NUMBER)},
    ),
    "evidence_items": (
        ("pack_id", "source_system", "document_id", "document_type", "field_path", "value", "note"), ("ord", "confidence", "page", *(f"bounding_box.{c}" for c in ("x0", "y0", "x1", "y1"))), ("created_at", "ingested_at"), {},
    ),
    "contracts": (
        (*_HEAD, "effective_date", "expiry_date", "governing_law", *(f"counterparty.{c}" for c in _PARTY)), ("page_count",), ("deleted_at", "ingested_at"), {"rate_schedule": (("description", "unit_of_measure"), ("max_unit_price",))},
    ),
    "raw_records": (("feed", "document_type", "raw"), (), ("received_at",), {}),
    "documents": (("text", "lang", "source", "kind", "about_id"), ("n_chars",), ("received_at",), {}),
}


def _cells_of(t: str) -> str:
    """SQL of (table_name, column_name, load_id, t, x): one row per cell, with its text or its number."""
    texts, numbers, times, arrays = _COLUMNS[t]
    load = PROFILED[t][1] or "CAST(NULL AS INTEGER)"
    one = lambda name, text, number, src=t: f"SELECT '{t}' AS table_name, '{name}' AS column_name, {load if src == t else 'load_id'} AS load_id, {text} AS t, {number} AS x FROM {src}"
    none, no_number = "CAST(NULL AS VARCHAR)", "CAST(NULL AS DOUBLE)"
    parts = [one(c, c, no_number) for c in texts] + [one(c, none, f"CAST({c} AS DOUBLE)") for c in numbers] + [one(c, none, f"CAST(epoch_us({c}) AS DOUBLE)") for c in times]
    for a, (inner_texts, inner_numbers) in arrays.items():
        parts.append(one(a, none, f"CAST(len({a}) AS DOUBLE)"))
        src = f"(SELECT {load} AS load_id, unnest({a}) AS l FROM {t})"
        parts += [one(f"{a}[].{c}", f"l.{c}", no_number, src) for c in inner_texts] + [one(f"{a}[].{c}", none, f"CAST(l.{c} AS DOUBLE)", src) for c in inner_numbers]
    return " UNION ALL ".join(parts)


_COUNTS = rf"""
every AS ({" UNION ALL ".join(_cells_of(t) for t in PROFILED)}),
counts AS (
  SELECT *, CASE WHEN t IS NULL AND x IS NULL THEN NULL
    WHEN column_name = 'payment_terms' AND table_name IN ('invoices', 'purchase_orders') THEN regexp_matches(t, '\ANet ([1-9]|[1-9][0-9]|1[01][0-9]|120)\z')
    WHEN column_name = 'po_reference' THEN regexp_matches(t, '\APO-[0-9]{{11}}\z') WHEN column_name = 'confidence' THEN x BETWEEN 0 AND 1 ELSE true END AS valid
  FROM (SELECT table_name, column_name, load_id, t, x, count(*) AS n FROM every GROUP BY ALL)
)
"""

_MARKS = "".join(f"\\x{{{ord(c):x}}}" for c in nested.MARKS)
_STEPS = rf"((?:\[\d+\]|\.\"?\d+\"?|\.(?:{'|'.join(nested.HOLDERS)}))*)"
#: SQL of found(record_id, child, parent_ord, ord, value): children of records by their paths; JSON kept as text is opened once more.
_TREE = rf"""
texts AS (SELECT record_id, regexp_replace(raw, '^[{_MARKS}]+|[{_MARKS}]+$', '', 'g') AS j FROM raw_records WHERE raw IS NOT NULL),
roots AS (SELECT record_id, CASE WHEN json_type(j) = 'VARCHAR' THEN trim(json_extract_string(j, '$')) ELSE j END AS j FROM texts WHERE json_valid(j)),
outer_tree AS (SELECT r.record_id, t.* FROM roots r, LATERAL (SELECT * FROM json_tree(r.j)) t WHERE json_valid(r.j) AND json_type(r.j) IN ('OBJECT', 'ARRAY')),
inner_texts AS (SELECT record_id, id, fullkey, trim(json_extract_string(value, '$')) AS j FROM outer_tree WHERE type = 'VARCHAR' AND left(trim(json_extract_string(value, '$')), 1) IN ('{{', '[')),
nodes AS (
  SELECT record_id, id * 1000000 AS o, CAST(parent AS BIGINT) * 1000000 AS up, key, value, type, substr(fullkey, 2) AS path FROM outer_tree
  UNION ALL SELECT i.record_id, i.id * 1000000 + t.id + 1, i.id * 1000000 + t.parent + 1, t.key, t.value, t.type, substr(i.fullkey, 2) || substr(t.fullkey, 2) FROM inner_texts i, LATERAL (SELECT * FROM json_tree(i.j)) t WHERE json_valid(i.j)
),
named AS (
  SELECT *, coalesce(nullif(regexp_extract(path, '\.(allocations){_STEPS}$', 1), ''), nullif(regexp_extract(path, '\.(lines|totals|rate_schedule){_STEPS}$', 1), '')) AS child FROM nodes WHERE type = 'OBJECT' AND len(json_keys(value)) > 0
),
holders AS (SELECT DISTINCT n.record_id, n.o FROM named n JOIN nodes c ON c.record_id = n.record_id AND c.up = n.o AND c.type IN ('OBJECT', 'ARRAY') AND (c.key = n.child OR c.key IN ({', '.join(f"'{h}'" for h in nested.HOLDERS)}))),
children AS (
  SELECT n.* FROM named n ANTI JOIN holders h ON h.record_id = n.record_id AND h.o = n.o
  WHERE n.child IS NOT NULL AND NOT len(list_filter(json_keys(n.value), lambda k: NOT regexp_full_match(k, '[0-9]+'))) = 0
),
tops AS (SELECT *, row_number() OVER (PARTITION BY record_id, child ORDER BY o) AS ord FROM children WHERE child <> 'allocations'),
found AS (
  SELECT record_id, child, 0 AS parent_ord, ord, value FROM tops
  UNION ALL SELECT a.record_id, 'allocations', l.ord, row_number() OVER (PARTITION BY a.record_id, l.ord ORDER BY a.o), a.value FROM children a JOIN tops l ON l.record_id = a.record_id AND l.child = 'lines' AND starts_with(a.path, l.path) AND substr(a.path, length(l.path) + 1, 1) IN ('.', '[') WHERE a.child = 'allocations'
)
"""
_JT = lambda x: f"json_extract_string(value, '$.{x}')"
_JF = lambda x: f"TRY_CAST(regexp_replace(regexp_replace(json_extract_string(value, '$.{x}'), '^[^0-9(-]+', ''), '[, ]', '', 'g') AS DOUBLE)"


def _flat_sql(child: str, columns: str) -> str:
    return f"WITH {_TREE} SELECT record_id, CAST(parent_ord AS INTEGER) AS parent_ord, CAST(ord AS INTEGER) AS ord, {columns} FROM found WHERE child = '{child}'"


ORACLE = {
    "p2_found": f"WITH {_REFS} SELECT ref_table, strftime(seen_at, '%Y-%m') AS ref_month, row_id FROM found WHERE reason IS NOT NULL",
    "p2_report": f"WITH {_REFS} SELECT ref_table, strftime(seen_at, '%Y-%m') AS ref_month, reason, count(*) AS orphans, count(DISTINCT ref) AS keys FROM found WHERE reason IS NOT NULL GROUP BY ALL",
    "p2_runs": r"""
WITH k AS (
  SELECT DISTINCT CASE WHEN document_id LIKE 'PO%' THEN 'PO' WHEN document_id LIKE 'CTR%' THEN 'CTR' ELSE 'INV' END AS kind,
         CAST(regexp_extract(document_id, '([0-9]+)\z', 1) AS BIGINT) AS key FROM (
    SELECT document_id FROM invoices UNION ALL SELECT document_id FROM purchase_orders UNION ALL SELECT document_id FROM contracts)
  WHERE regexp_matches(document_id, '\A(PO-[0-9]{11}|CTR-[0-9]{6}|INV-2025-[0-9]{8})\z')),
i AS (SELECT kind, key, key // 1048576 AS b, key - row_number() OVER (PARTITION BY kind, key // 1048576 ORDER BY key) AS island FROM k)
SELECT kind, min(key) AS run_start, max(key) AS run_end, count(*) AS keys FROM i GROUP BY kind, b, island
""",
    "p5_found": f"""WITH {_CELLS}
SELECT table_name, column_name, load_id, row_id, 'form' AS finding FROM cells WHERE value IS NOT NULL AND NOT valid
UNION ALL
SELECT table_name, column_name, load_id, CAST(0 AS BIGINT), 'nulls' FROM counted WHERE load_id IS NOT NULL
GROUP BY table_name, column_name, load_id HAVING count(*) FILTER (WHERE value IS NULL) / count(*) > 0.25
UNION ALL
SELECT table_name, column_name, load_id, CAST(0 AS BIGINT), 'shift' FROM grid WHERE column_name <> 'po_reference'
GROUP BY table_name, column_name, load_id HAVING sum(abs(p - q)) / 2 > 0.4
""",
    "p5_profile": f"""WITH {_COUNTS}
SELECT table_name, column_name, load_id, CAST(sum(n) AS BIGINT) AS n_rows, CAST(coalesce(sum(n) FILTER (WHERE valid IS NULL), 0) AS BIGINT) AS n_nulls, count(*) FILTER (WHERE valid IS NOT NULL) AS n_distinct, min(t) AS min_text, max(t) AS max_text,
  min(x) AS min_number, max(x) AS max_number, CAST(min(length(t)) AS INTEGER) AS min_length, CAST(max(length(t)) AS INTEGER) AS max_length, CAST(coalesce(sum(n) FILTER (WHERE NOT valid), 0) AS BIGINT) AS n_violations, max(n) FILTER (WHERE valid IS NOT NULL) AS n_mode
FROM counts GROUP BY table_name, column_name, load_id""",
    "p5_shift": rf"""WITH {_COUNTS},
named AS (SELECT *, CASE WHEN column_name = 'confidence' THEN CAST(least(floor(x * 10), 9) AS INTEGER)::DOUBLE ELSE x END AS y FROM counts WHERE valid AND table_name IN ('invoices', 'purchase_orders', 'evidence_items')),
whole AS (SELECT table_name, column_name, t, y, sum(n) AS all_n FROM named GROUP BY ALL),
rules AS (SELECT table_name, column_name, count(*) AS vals, sum(all_n) AS total, min(y) FILTER (WHERE isfinite(y)) AS least, max(y) FILTER (WHERE isfinite(y)) AS most FROM whole GROUP BY ALL),
placed AS (
  SELECT c.table_name, c.column_name, c.load_id, c.n, CASE WHEN vals <= {profile.MOST_VALUES} OR w.all_n >= total * {profile.OWN_SHARE} THEN coalesce(c.t, CAST(c.y AS VARCHAR))
    WHEN c.t IS NULL THEN 'range ' || CASE WHEN NOT isfinite(c.y) THEN 'none' WHEN most > least THEN CAST(CAST(least(floor((c.y - least) / ((most - least) / {profile.RANGES})), {profile.RANGES - 1}) AS INTEGER) AS VARCHAR) ELSE '0' END
    ELSE 'form ' || left(md5(regexp_replace(regexp_replace(c.t, '\p{{L}}+', 'a', 'g'), '[0-9]+', '9', 'g')), 1) END AS bin
  FROM named c JOIN rules USING (table_name, column_name) JOIN whole w ON w.table_name = c.table_name AND w.column_name = c.column_name AND w.t IS NOT DISTINCT FROM c.t AND w.y IS NOT DISTINCT FROM c.y
),
bins AS (SELECT table_name, column_name, load_id, bin, sum(n) AS n FROM placed GROUP BY ALL),
shares AS (
  SELECT l.table_name, l.column_name, l.load_id, l.load_n, coalesce(b.n, 0) / l.load_n AS p, w.all_n / w.col_n AS q
  FROM (SELECT table_name, column_name, load_id, sum(n) AS load_n FROM bins WHERE load_id IS NOT NULL GROUP BY ALL) l
  JOIN (SELECT table_name, column_name, bin, sum(n) AS all_n, sum(sum(n)) OVER (PARTITION BY table_name, column_name) AS col_n FROM bins GROUP BY table_name, column_name, bin) w USING (table_name, column_name)
  LEFT JOIN bins b ON b.table_name = l.table_name AND b.column_name = l.column_name AND b.load_id = l.load_id AND b.bin = w.bin
)
SELECT table_name, column_name, load_id, CAST(any_value(load_n) AS BIGINT) AS n_valid, round(sum(abs(p - q)) / 2, 6) AS distance, round(sum((CASE WHEN p = 0 THEN 1e-4 ELSE p END - q) * ln(CASE WHEN p = 0 THEN 1e-4 ELSE p END / q)), 4) AS psi,
  round(any_value(load_n) * sum((p - q) * (p - q) / q), 3) AS chi2 FROM shares GROUP BY table_name, column_name, load_id""",
    "p3_found": f"WITH {_TREE} SELECT record_id, child, CAST(parent_ord AS INTEGER) AS parent_ord, CAST(ord AS INTEGER) AS ord FROM found",
    "p3_lines": _flat_sql("lines", f"TRY_CAST({_JT('line_number')} AS INTEGER) AS line_number, {_JT('description')} AS description, {_JT('unit_of_measure')} AS unit_of_measure, {_JF('quantity')} AS quantity, {_JF('unit_price')} AS unit_price, {_JF('net_amount')} AS net_amount, "
                          f"coalesce({_JF('tax_rate')}, {_JF('tax.rate')}) AS tax_rate, coalesce({_JF('tax_amount')}, {_JF('tax.amount')}) AS tax_amount, {_JF('line_total')} AS line_total"),
    "p3_totals": _flat_sql("totals", f"{_JF('subtotal')} AS subtotal, {_JF('tax_total')} AS tax_total, {_JF('grand_total')} AS grand_total, {_JT('currency')} AS currency"),
    "p3_rate_schedule": _flat_sql("rate_schedule", f"{_JT('description')} AS description, {_JT('unit_of_measure')} AS unit_of_measure, {_JF('max_unit_price')} AS max_unit_price"),
    "p3_allocations": _flat_sql("allocations", f"{_JT('site')} AS site, {_JF('quantity')} AS quantity"),
}

#: SQL of the cells that p5_profile_all and p5_shift_all have besides those of the SQL above, which stands as it is
_KEY_CELLS = " UNION ALL ".join(
    [f"SELECT '{t}' AS table_name, '{c}' AS column_name, {load or 'CAST(NULL AS INTEGER)'} AS load_id, CAST(NULL AS VARCHAR) AS t, CAST({c} AS DOUBLE) AS x FROM {t}" for t, (key, load) in PROFILED.items() for c in (key, load) if c]
    + [f"SELECT 'given_names', '{c}', CAST(NULL AS INTEGER), {c}, CAST(NULL AS DOUBLE) FROM given_names" for c in ("given_name", "lang")]
)
ORACLE |= {f"{name}_all": ORACLE[name].replace("every AS (", f"every AS ({_KEY_CELLS} UNION ALL ", 1) for name in ("p5_profile", "p5_shift")}
