"""Queries that print the parsed documents to pages and read them back, with their SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.operators import evidence as E
from tallyfold.operators import document, extract, layout, lookup
from tallyfold.operators.document import OVERLAID, SEAM, Words
from tallyfold.sources import words as W
from tallyfold.sources.tables import by_key, spread, table

_TABLES = tuple(W.PRINTERS)


def _printed(spark: SparkSession, d: str, name: str, changed: Callable[[Words], Words] | None = None) -> layout.Documents:
    return W.printed_documents(spread(table(spark, d, name)), name, changed=changed)


def _read(spark: SparkSession, d: str, name: str, changed: Callable[[Words], Words] | None = None) -> DataFrame:
    return extract.records(_printed(spark, d, name, changed))


def _all(of: Callable[[str], DataFrame], names: tuple[str, ...] = _TABLES) -> DataFrame:
    """The same of several tables, each row with the name of its table."""
    return reduce(DataFrame.unionByName, (of(n).select(F.lit(n).alias("table_name"), "*") for n in names))


def read_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents of all three layouts read end to end; which layout it is, the page says."""
    items = F.coalesce(F.size("lines"), F.size("rate_schedule"))
    return _all(lambda n: _read(spark, d, n).select("doc_id", "status", "document_type", "source_system", "document_id", "page_count", "payment_terms", items.alias("n_items"), F.size("removed_duplicates").alias("n_removed")))


def read_invoices(spark: SparkSession, d: str) -> DataFrame:
    x = _read(spark, d, "invoices")
    return x.select("doc_id", "document_id", "issue_date", "due_date", "currency", "currency_defaulted", "payment_terms", "po_reference", "totals.subtotal", "totals.tax_total", "totals.grand_total", F.size("lines").alias("n_lines"))


_LINE = ("line_number", "description", "unit_of_measure", "quantity", "unit_price", "net_amount", "tax_rate", "line_total", "tax_amount")


def read_invoice_lines(spark: SparkSession, d: str) -> DataFrame:
    """Line items as read, repeats removed."""
    one = _read(spark, d, "invoices").select("doc_id", F.posexplode("lines").alias("ord", "l"))
    return one.select("doc_id", (F.col("ord") + 1).alias("ord"), *(F.col(f"l.{c}") for c in _LINE))


def read_orders(spark: SparkSession, d: str) -> DataFrame:
    x = _read(spark, d, "purchase_orders")
    return x.select("doc_id", "document_id", "order_date", "delivery_date", "requisition_number", "currency", "payment_terms", "contract_reference", "order_value", F.size("lines").alias("n_lines"))


def read_parties(spark: SparkSession, d: str) -> DataFrame:
    """Party blocks of all three layouts."""
    roles = ("seller", "buyer", "vendor", "counterparty")
    each = F.explode(F.array(*(F.struct(F.lit(r).alias("role"), F.col(r).alias("p")) for r in roles))).alias("x")
    return _all(lambda n: _read(spark, d, n).select("doc_id", each).where("x.p is not null").select("doc_id", "x.role", "x.p.name", "x.p.vendor_id", "x.p.tax_registration", "x.p.location"))


def read_contracts(spark: SparkSession, d: str) -> DataFrame:
    x = _read(spark, d, "contracts")
    return x.select("doc_id", "document_id", "effective_date", "expiry_date", "governing_law", "payment_terms", F.size("rate_schedule").alias("n_rates"))


def read_rate_schedule(spark: SparkSession, d: str) -> DataFrame:
    x = _read(spark, d, "contracts")
    return x.select("doc_id", F.posexplode("rate_schedule").alias("pos", "r")).select("doc_id", (F.col("pos") + 1).alias("ord"), "r.description", "r.unit_of_measure", "r.max_unit_price")


def _places(positions: DataFrame) -> DataFrame:
    b = "bounding_box"
    return positions.select(*(c for c in positions.columns if c not in (b, "document_id")), *(F.round(f"{b}.{c}", 4).alias(c) for c in ("x0", "y0", "x1", "y1")))


def field_positions(spark: SparkSession, d: str) -> DataFrame:
    """Page and rectangle of every located field of all documents."""
    return _all(lambda n: _places(extract.positions(_read(spark, d, n))))


def _located(spark: SparkSession, d: str) -> DataFrame:
    """Evidence on documents that are there, with the value, page and rectangle that its field has in the document as first delivered."""
    asked = table(spark, d, "evidence_items").select("row_id", "document_id", "field_path")
    known = asked.where("document_id is not null").select(F.col("document_id").alias("k")).distinct()
    parts = []
    for name, (_, columns) in W.PRINTERS.items():
        first = table(spark, d, name).where("document_id is not null").groupBy(F.col("document_id").alias("k")).agg(F.min_by(F.struct(*columns), F.struct("ingested_at", "row_id")).alias("x"))
        parts.append(extract.located(W.printed_documents(by_key(first.join(known, "k", "left_semi").select("k", "x.*"), "k"), name, "k")))
    return E.cite(asked, reduce(DataFrame.unionByName, parts).withColumnRenamed("doc_id", "document_id")).where("present")


def cite_located(spark: SparkSession, d: str) -> DataFrame:
    """All evidence on documents that are there, cited again from what was read of them, with the page and rectangle of each value."""
    return _located(spark, d).select("row_id", "field_path", "page", *(F.round(c, 4).alias(c) for c in ("x0", "y0", "x1", "y1")))


def citation_crops(spark: SparkSession, d: str) -> DataFrame:
    """The crop rectangle of every located citation, clamped to its page."""
    crops = lookup.crop(_located(spark, d), (W.WIDTH, W.HEIGHT))
    return crops.select("row_id", "field_path", "page", *(F.round(c, 4).alias(c) for c in ("cx0", "cy0", "cx1", "cy1")))


def _twice(words: Words) -> Words:
    """A second text layer over the first."""
    for column in (words.page, words.text, words.x0, words.y0, words.x1, words.y1):
        column.extend(column[:])
    return words


def overlaid_layers(spark: SparkSession, d: str) -> DataFrame:
    """Every word of the documents printed twice: the repeats are dropped and counted."""
    return _all(lambda n: layout.deduplicated(_printed(spark, d, n, _twice)))


def overlaid_read(spark: SparkSession, d: str) -> DataFrame:
    """Documents with a doubled text layer read as if it were single, and what was dropped is noted."""
    note = F.element_at("removed_duplicates", -1)
    items = F.coalesce(F.size("lines"), F.size("rate_schedule"))
    return _all(lambda n: _read(spark, d, n, _twice).select("doc_id", "document_id", items.alias("n_items"), F.size("removed_duplicates").alias("notes"), (note["words"] > 0).alias("counted"), note["reason"].alias("reason")))


def scanned_read(spark: SparkSession, d: str) -> DataFrame:
    """Documents of which only pictures of their pages are left: each is a row that says why it can't be read."""
    return _all(lambda n: _read(spark, d, n, W.scanned).select("doc_id", "status", "page_count", "document_type", F.size("positions").alias("located")))


def _seamed(words: Words) -> Words:
    """The last line of each page printed once more at the top of the next one."""
    last = {}
    for k, (page, text, x0, y0) in enumerate(zip(words.page, words.text, words.x0, words.y0)):
        if abs(y0 + W.SIZE - W.row_y(W.FIRST_ROWS - 1 if page == 0 else W.FIRST_ROWS + W.NEXT_ROWS - 1)) < 0.01:
            last.setdefault(page, []).append(k)
    for page, row in last.items():
        if page + 1 < words.pages:
            shift = W.NEXT_TABLE_Y + W.ROW_PITCH / 2 - W.SIZE - words.y0[row[0]]
            for k in row:
                words.add(page + 1, words.text[k], words.x0[k], words.y0[k] + shift, words.x1[k], words.y1[k] + shift)
    return words


def seam_rows(spark: SparkSession, d: str) -> DataFrame:
    """Lines rendered onto both pages of a break are read once and recorded."""
    seams = F.filter("removed_duplicates", lambda r: r["reason"] == SEAM)
    return _all(lambda n: _read(spark, d, n, _seamed).select("doc_id", F.size("lines").alias("n_lines"), F.size(seams).alias("seams")), ("invoices", "purchase_orders"))


def artefacts_removed(spark: SparkSession, d: str) -> DataFrame:
    """Every line of invoices and orders printed once more at its own place, and once far below: the former goes, the latter stays."""
    return _all(lambda n: _repeats(_printed(spark, d, n), n), ("invoices", "purchase_orders"))


def _repeats(docs: layout.Documents, name: str) -> DataFrame:
    header, stop = document.LAYOUTS[name.removesuffix("s")][3]

    def run(words: Words) -> list[tuple]:
        printed = document.Document(words, W.HEIGHT).lines(header, stop)
        again, below = ([replace(x, **{f: getattr(x, f) + by}) for x in printed] for f, by in (("y0", 1.0), ("page", 100_000)))
        kept, removed = document.without_artefacts([*printed, *again, *below])
        return [(len(printed), len(kept), len(removed))]

    return docs.map(run, "printed int, kept int, removed int")


def page_furniture(spark: SparkSession, d: str) -> DataFrame:
    """Rows removed as furniture, of all three tables: title and folio of documents of two pages or more."""
    return _all(lambda n: layout.texts(_printed(spark, d, n)).where(F.size("furniture") > 0).select("doc_id", "page_count", F.size("furniture").alias("removed")))


def layout_status(spark: SparkSession, d: str) -> DataFrame:
    return _all(lambda n: layout.status(_printed(spark, d, n)))


QUERIES = {f.__name__: f for f in (
    read_documents, read_invoices, read_invoice_lines, read_orders, read_parties, read_contracts, read_rate_schedule, field_positions, cite_located, citation_crops,
    overlaid_layers, overlaid_read, scanned_read, seam_rows, artefacts_removed, page_furniture, layout_status,
)}

_V = lambda x: f"nullif(trim(regexp_replace({x}, '[ \\t\\r\\n]+', ' ', 'g')), '')"
_D = lambda x: f"CAST(round(CAST(CAST({x} AS VARCHAR) AS DECIMAL(24,6)), 2) AS DOUBLE)"
_N1, _N2 = W.FIRST_ROWS, W.NEXT_ROWS
_PAGES = f"(CASE WHEN n + 4 < {_N1} THEN 0 ELSE (n + 4 - {_N1}) // {_N2} + 1 END) + 1"

_UNIT = f"""
raw AS (SELECT row_id, unnest(lines) AS l, generate_subscripts(lines, 1) AS i FROM {{t}}),
v AS (
  SELECT row_id, i, l.line_number, {_V('l.description')} AS d, {_V('l.unit_of_measure')} AS u, {_D('l.quantity')} AS quantity, {_D('l.unit_price')} AS unit_price, {_D('l.net_amount')} AS net_amount,
         {_D('l.tax_rate')} AS tax_rate, {_D('l.line_total')} AS line_total FROM raw WHERE l.line_number >= 0 AND l.quantity IS NOT NULL AND l.unit_price IS NOT NULL
),
w AS (SELECT *, string_split(concat_ws(' ', d, u), ' ') AS ws, d IS NOT NULL OR u IS NOT NULL AS has FROM v)
"""


def _party(role: str, t: str) -> str:
    name, vendor, tax, loc = (_V(f"{role}.{x}") for x in ("name", "vendor_id", "tax_registration", "location"))
    return f"""
SELECT '{t}' AS table_name, row_id AS doc_id, '{role}' AS role, ls[1] AS name,
  CASE WHEN NOT head_v THEN vendor END AS vendor_id, CASE WHEN NOT head_t THEN tax END AS tax_registration,
  CASE WHEN NOT head_l AND NOT (upper(loc) = loc AND lower(loc) <> loc AND len(string_split(loc, ' ')) <= 3) THEN loc END AS location
FROM (
  SELECT *, list_filter([name, 'Account ' || vendor, 'Tax reg. ' || tax, loc], lambda x: x IS NOT NULL) AS ls,
    name IS NULL AS head_v, name IS NULL AND vendor IS NULL AS head_t, name IS NULL AND vendor IS NULL AND tax IS NULL AS head_l
  FROM (SELECT row_id, {name} AS name, {vendor} AS vendor, {tax} AS tax, {loc} AS loc FROM {t})
) WHERE len(ls) > 0"""


_KINDS = (("invoices", "invoice", "lines"), ("purchase_orders", "purchase_order", "lines"), ("contracts", "contract", "rate_schedule"))
_SYSTEMS = {"invoices": "SharePoint", "purchase_orders": "SAP", "contracts": "CLM"}
_GOOD = "coalesce(len(list_filter(lines, lambda l: l.line_number >= 0 AND l.quantity IS NOT NULL AND l.unit_price IS NOT NULL)), 0)"
_GOOD_RATES = "coalesce(len(list_filter(rate_schedule, lambda l: l.max_unit_price IS NOT NULL)), 0)"
_TERMS_OF = {
    "invoices": f"CASE WHEN lower({_V('payment_terms')}) <> 'not stated' THEN {_V('payment_terms')} END", "purchase_orders": _V("payment_terms"),
    "contracts": f"nullif(regexp_extract({_V('payment_terms')}, '^(Net [0-9]+)$', 1), '')",
}
_F = lambda x: f"format('{{:,.2f}}', {x})"
_ON_PAGE = lambda i: f"(CASE WHEN {i} < {_N1} THEN 0 ELSE ({i} - {_N1}) // {_N2} + 1 END)"
_AT_Y = lambda i: f"(CASE WHEN {i} < {_N1} THEN {W.TABLE_Y} + {W.ROW_PITCH} * ({i} + 1) ELSE {W.NEXT_TABLE_Y} + {W.ROW_PITCH} * (({i} - {_N1}) % {_N2} + 1) END)"
#: Labelled fields and party blocks of each type: (path, x, y of the value or the heading)
_LABELLED = {
    "invoices": (("document_id", 57, 111), ("issue_date", 170, 111), ("due_date", 278, 111), ("currency", 386, 111), ("payment_terms", 476, 111), ("po_reference", 57, 151)),
    "purchase_orders": (("document_id", 57, 111), ("order_date", 170, 111), ("delivery_date", 278, 111), ("requisition_number", 386, 111), ("currency", 476, 111), ("payment_terms", 57, 151), ("contract_reference", 278, 151)),
    "contracts": (("document_id", 57, 111), ("effective_date", 170, 111), ("expiry_date", 278, 111), ("governing_law", 386, 111)),
}
_PARTIES = {"invoices": (("seller", 57), ("buyer", 317)), "purchase_orders": (("vendor", 57),), "contracts": (("counterparty", 57),)}
_COLUMNS = {"invoices": W.INVOICE_COLUMNS, "purchase_orders": W.ORDER_COLUMNS}
_TOTALS = {"invoices": (("totals.subtotal", 1), ("totals.tax_total", 2), ("totals.grand_total", 3)), "purchase_orders": (("order_value", 1),), "contracts": ()}


def _positions(t: str, src: str, key: str) -> str:
    """SQL of (doc_id, field_path, page, x0, y0, x1, y1): where the printer puts what is read."""
    left = lambda path, page, x, y, text, frm: f"SELECT {key} AS doc_id, {path} AS field_path, {page} AS page, CAST({x} AS DOUBLE) AS a, {x} + length({text}) * {W.NARROW} AS b, CAST({y} AS DOUBLE) AS y FROM {frm} WHERE {text} IS NOT NULL"
    right = lambda path, page, x, y, value, frm: f"SELECT {key} AS doc_id, {path} AS field_path, {page} AS page, {x} - length({_F(value)}) * {W.NARROW} AS a, CAST({x} AS DOUBLE) AS b, CAST({y} AS DOUBLE) AS y FROM {frm} WHERE {value} IS NOT NULL"
    parts = [left(f"'{c}'", 0, x, y, _V(c), src) for c, x, y in _LABELLED[t]]
    for role, x in _PARTIES[t]:
        name, vendor, tax, loc = (_V(f"{role}.{c}") for c in ("name", "vendor_id", "tax_registration", "location"))
        block = f"(SELECT {key}, {name} AS name, 'Account ' || {vendor} AS vendor_id, 'Tax reg. ' || {tax} AS tax_registration, {loc} AS location FROM {src})"
        listed = f"(SELECT {key}, unnest(ls) AS e, generate_subscripts(ls, 1) AS i, upper(ls[-1].v) = ls[-1].v AND lower(ls[-1].v) <> ls[-1].v AND len(string_split(ls[-1].v, ' ')) <= 3 AND ls[-1].f = 'location' AS heading, len(ls) AS n FROM (SELECT {key}, list_filter([{{'f': 'name', 'v': name}}, {{'f': 'vendor_id', 'v': vendor_id}}, {{'f': 'tax_registration', 'v': tax_registration}}, {{'f': 'location', 'v': location}}], lambda e: e.v IS NOT NULL) AS ls FROM {block}))"
        placed = f"(SELECT {key}, CASE WHEN i = 1 THEN 'name' ELSE e.f END AS f, e.v AS v, i FROM {listed} WHERE NOT (i = n AND i > 1 AND heading))"
        parts.append(left(f"'{role}.' || f", 0, x, f"{W.PARTY_Y} + 13 + 12 * (i - 1)", "v", placed))
    items = "rate_schedule" if t == "contracts" else "lines"
    each = f"(SELECT {key}, unnest({items}) AS l, generate_subscripts({items}, 1) - 1 AS i FROM {src})"
    good = "l.max_unit_price IS NOT NULL" if t == "contracts" else "l.line_number >= 0 AND l.quantity IS NOT NULL AND l.unit_price IS NOT NULL"
    figures = (("max_unit_price", 480.0),) if t == "contracts" else _COLUMNS[t]
    dx, ux = (57, 300) if t == "contracts" else (82, 272)
    lines = f"""(SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY i) - 1 AS k, CASE WHEN u IS NULL THEN string_split(d, ' ') ELSE string_split(u, ' ') END AS ws FROM
      (SELECT {key}, l, i, {_V('l.description')} AS d, {_V('l.unit_of_measure')} AS u FROM {each} WHERE {good}))"""
    path = lambda f: f"'{items}[' || k || '].{f}'"
    parts += [right(path(f), _ON_PAGE("i"), x, _AT_Y("i"), f"l.{f}", lines) for f, x in figures]
    parts.append(f"SELECT {key}, {path('description')}, {_ON_PAGE('i')}, CASE WHEN d IS NULL THEN {ux} ELSE {dx} END, greatest({dx} + length(d) * {W.NARROW}, {ux} + length(u) * {W.NARROW}), {_AT_Y('i')} FROM {lines} WHERE d IS NOT NULL OR u IS NOT NULL")
    if t != "contracts":
        parts.append(f"SELECT {key}, {path('unit_of_measure')}, {_ON_PAGE('i')}, x + (length(v) - length(ws[-1])) * {W.NARROW}, x + length(v) * {W.NARROW}, {_AT_Y('i')} FROM (SELECT *, coalesce(u, d) AS v, CASE WHEN u IS NULL THEN {dx} ELSE {ux} END AS x FROM {lines}) WHERE (d IS NOT NULL OR u IS NOT NULL) AND (d IS NOT NULL AND u IS NOT NULL OR len(ws) > 1)")
        n = "coalesce(len(lines), 0)"
        parts += [right(f"'{p}'", _ON_PAGE(f"({n} + {k})"), 540, _AT_Y(f"({n} + {k})"), p, src) for p, k in _TOTALS[t]]
    return f"SELECT doc_id, field_path, CAST(page AS INTEGER) AS page, round(a, 4) AS x0, round(y - {W.SIZE}, 4) AS y0, round(b, 4) AS x1, round(y + 0.3 * {W.SIZE}, 4) AS y1 FROM ({' UNION ALL '.join(parts)})"


def _words_of(t: str) -> str:
    """SQL of (doc_id, w): numbers of words that the printer sets."""
    words = lambda x: f"coalesce(len(string_split({x}, ' ')), 0)"
    items = "rate_schedule" if t == "contracts" else "lines"
    heads = {"invoices": ("COMMERCIAL INVOICE", 10, 9), "purchase_orders": ("PURCHASE ORDER", 7, 11), "contracts": ("MASTER SUPPLY AGREEMENT", 6, 8)}[t]
    labels = {"invoices": 2 + 2 + 2 + 1 + 1 + 3, "purchase_orders": 2 + 2 + 2 + 1 + 1 + 2 + 2, "contracts": 2 * 4}[t]
    n = f"coalesce(len({items}), 0)"
    per_page = len(heads[0].split()) + 4 + heads[1]
    fixed = [f"SELECT row_id AS doc_id, {labels} + 2 + {per_page} * ({_PAGES.replace('n +', f'{n} +')}) AS w FROM {t}"]
    fixed += [f"SELECT row_id, {words(_V(c))} FROM {t}" for c, _, _ in _LABELLED[t]]
    for role, _ in _PARTIES[t]:
        name, vendor, tax, loc = (_V(f"{role}.{c}") for c in ("name", "vendor_id", "tax_registration", "location"))
        size = {"seller": 1, "buyer": 2, "vendor": 1, "counterparty": 1}[role]
        fixed.append(f"SELECT row_id, {words(name)} + {words(loc)} + CASE WHEN {vendor} IS NULL THEN 0 ELSE 1 + {words(vendor)} END + CASE WHEN {tax} IS NULL THEN 0 ELSE 2 + {words(tax)} END + CASE WHEN coalesce({name}, {vendor}, {tax}, {loc}) IS NULL THEN 0 ELSE {size} END FROM {t}")
    figures = ("max_unit_price",) if t == "contracts" else tuple(c for c, _ in _COLUMNS[t])
    number = "0" if t == "contracts" else "CASE WHEN l.line_number IS NULL THEN 0 ELSE 1 END"
    fixed.append(f"SELECT row_id, {number} + {words(_V('l.description'))} + {words(_V('l.unit_of_measure'))} + {' + '.join(f'CASE WHEN l.{c} IS NULL THEN 0 ELSE 1 END' for c in figures)} FROM (SELECT row_id, unnest({items}) AS l FROM {t})")
    if t == "contracts":
        fixed.append(f"SELECT row_id, 8 + CASE WHEN {_V('payment_terms')} IS NULL THEN 0 ELSE 10 + {words(_V('payment_terms'))} END FROM {t}")
    else:
        fixed.append(f"SELECT row_id, {5 if t == 'invoices' else 3} + {' + '.join(f'CASE WHEN {p} IS NULL THEN 0 ELSE 1 END' for p, _ in _TOTALS[t])} FROM {t}")
    return " UNION ALL ".join(fixed)


_PLACED = ", ".join(f"first_{t} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY ingested_at, row_id) AS rn FROM {t} WHERE document_id IS NOT NULL) WHERE rn = 1)" for t, _, _ in _KINDS)
_PLACED += f""", placed AS ({" UNION ALL ".join(_positions(t, f"first_{t}", "document_id") for t, _, _ in _KINDS)})"""

ORACLE = {
    "read_invoices": f"""
SELECT row_id AS doc_id, {_V('document_id')} AS document_id, {_V('issue_date')} AS issue_date, {_V('due_date')} AS due_date, coalesce({_V('currency')}, 'EUR') AS currency, {_V('currency')} IS NULL AS currency_defaulted,
  CASE WHEN lower({_V('payment_terms')}) <> 'not stated' THEN {_V('payment_terms')} END AS payment_terms, CASE WHEN NOT contains(lower({_V('po_reference')}), 'none') THEN {_V('po_reference')} END AS po_reference,
  {_D('totals.subtotal')} AS subtotal, {_D('totals.tax_total')} AS tax_total, {_D('totals.grand_total')} AS grand_total,
  CAST(coalesce(len(list_filter(lines, lambda l: l.line_number >= 0 AND l.quantity IS NOT NULL AND l.unit_price IS NOT NULL)), 0) AS INTEGER) AS n_lines FROM invoices""",
    "read_invoice_lines": f"""WITH {_UNIT.format(t='invoices')}
SELECT row_id AS doc_id, CAST(row_number() OVER (PARTITION BY row_id ORDER BY i) AS INTEGER) AS ord, line_number,
  CASE WHEN has THEN CASE WHEN len(ws) > 1 THEN array_to_string(ws[1:-2], ' ') ELSE ws[1] END END AS description, CASE WHEN has AND len(ws) > 1 THEN ws[-1] END AS unit_of_measure,
  quantity, unit_price, net_amount, tax_rate, line_total,
  CASE WHEN tax_rate IS NOT NULL THEN CAST(CAST(CAST(line_total AS VARCHAR) AS DECIMAL(24,2)) - CAST(CAST(net_amount AS VARCHAR) AS DECIMAL(24,2)) AS DOUBLE) END AS tax_amount FROM w""",
    "read_orders": f"""
SELECT row_id AS doc_id, {_V('document_id')} AS document_id, {_V('order_date')} AS order_date, {_V('delivery_date')} AS delivery_date, {_V('requisition_number')} AS requisition_number, coalesce({_V('currency')}, 'EUR') AS currency,
  {_V('payment_terms')} AS payment_terms, CASE WHEN lower({_V('contract_reference')}) <> 'none' THEN {_V('contract_reference')} END AS contract_reference, {_D('order_value')} AS order_value,
  CAST(coalesce(len(list_filter(lines, lambda l: l.line_number >= 0 AND l.quantity IS NOT NULL AND l.unit_price IS NOT NULL)), 0) AS INTEGER) AS n_lines FROM purchase_orders""",
    "read_parties": " UNION ALL ".join(_party(r, t) for r, t in (("seller", "invoices"), ("buyer", "invoices"), ("vendor", "purchase_orders"), ("counterparty", "contracts"))),
    "read_contracts": f"""
SELECT row_id AS doc_id, {_V('document_id')} AS document_id, {_V('effective_date')} AS effective_date, {_V('expiry_date')} AS expiry_date, {_V('governing_law')} AS governing_law,
  nullif(regexp_extract({_V('payment_terms')}, '^(Net [0-9]+)$', 1), '') AS payment_terms,
  CAST(coalesce(len(list_filter(rate_schedule, lambda l: l.max_unit_price IS NOT NULL)), 0) AS INTEGER) AS n_rates FROM contracts""",
    "read_rate_schedule": f"""
WITH raw AS (SELECT row_id, unnest(rate_schedule) AS r, generate_subscripts(rate_schedule, 1) AS i FROM contracts),
v AS (SELECT row_id, i, string_split(concat_ws(' ', {_V('r.description')}, {_V('r.unit_of_measure')}), ' ') AS ws, {_V('r.description')} IS NOT NULL OR {_V('r.unit_of_measure')} IS NOT NULL AS has, {_D('r.max_unit_price')} AS max_unit_price FROM raw WHERE r.max_unit_price IS NOT NULL)
SELECT row_id AS doc_id, CAST(row_number() OVER (PARTITION BY row_id ORDER BY i) AS INTEGER) AS ord, CASE WHEN has THEN CASE WHEN len(ws) > 1 THEN array_to_string(ws[1:-2], ' ') ELSE ws[1] END END AS description,
  CASE WHEN has THEN ws[-1] END AS unit_of_measure, max_unit_price FROM v""",
    "artefacts_removed": " UNION ALL ".join(f"SELECT '{t}' AS table_name, row_id AS doc_id, CAST(n AS INTEGER) AS printed, CAST(2 * n AS INTEGER) AS kept, CAST(n AS INTEGER) AS removed FROM (SELECT row_id, {_GOOD} AS n FROM {t})" for t in ("invoices", "purchase_orders")),
    "page_furniture": " UNION ALL ".join(f"SELECT '{t}' AS table_name, row_id AS doc_id, CAST(pages AS INTEGER) AS page_count, CAST(2 * pages AS INTEGER) AS removed FROM (SELECT row_id, {_PAGES} AS pages FROM (SELECT row_id, coalesce(len({items}), 0) AS n FROM {t})) WHERE pages > 1" for t, _, items in _KINDS),
    "read_documents": " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, row_id AS doc_id, 'OK' AS status, '{k}' AS document_type, '{_SYSTEMS[t]}' AS source_system, {_V('document_id')} AS document_id, CAST({_PAGES} AS INTEGER) AS page_count, {_TERMS_OF[t]} AS payment_terms, CAST({_GOOD if items == 'lines' else _GOOD_RATES} AS INTEGER) AS n_items, CAST(0 AS INTEGER) AS n_removed FROM (SELECT *, coalesce(len({items}), 0) AS n FROM {t})"
        for t, k, items in _KINDS
    ),
    "overlaid_layers": " UNION ALL ".join(f"SELECT '{t}' AS table_name, doc_id, CAST(sum(w) AS BIGINT) AS words, CAST(sum(w) AS BIGINT) AS dropped FROM ({_words_of(t)}) GROUP BY doc_id" for t, _, _ in _KINDS),
    "overlaid_read": " UNION ALL ".join(f"SELECT '{t}' AS table_name, row_id AS doc_id, {_V('document_id')} AS document_id, CAST({_GOOD if items == 'lines' else _GOOD_RATES} AS INTEGER) AS n_items, CAST(1 AS INTEGER) AS notes, true AS counted, '{OVERLAID}' AS reason FROM {t}" for t, _, items in _KINDS),
    "scanned_read": " UNION ALL ".join(f"SELECT '{t}' AS table_name, row_id AS doc_id, 'NO_TEXT_LAYER' AS status, CAST({_PAGES} AS INTEGER) AS page_count, CAST(NULL AS VARCHAR) AS document_type, CAST(0 AS INTEGER) AS located FROM (SELECT row_id, coalesce(len({items}), 0) AS n FROM {t})" for t, _, items in _KINDS),
    "seam_rows": " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, row_id AS doc_id, CAST({_GOOD} AS INTEGER) AS n_lines, CAST(coalesce(len(list_filter(range(0, CASE WHEN coalesce(len(lines), 0) + 4 < {_N1} THEN 0 ELSE (coalesce(len(lines), 0) + 4 - {_N1}) // {_N2} + 1 END), lambda b: {_N1} + b * {_N2} <= len(lines) AND lines[{_N1} + b * {_N2}].line_number >= 0 AND lines[{_N1} + b * {_N2}].quantity IS NOT NULL AND lines[{_N1} + b * {_N2}].unit_price IS NOT NULL)), 0) AS INTEGER) AS seams FROM {t}"
        for t in ("invoices", "purchase_orders")
    ),
    "field_positions": " UNION ALL ".join(f"SELECT '{t}' AS table_name, doc_id, field_path, page, x0, y0, x1, y1 FROM ({_positions(t, t, 'row_id')})" for t, _, _ in _KINDS),
    "cite_located": f"WITH {_PLACED} SELECT e.row_id, e.field_path, p.page, p.x0, p.y0, p.x1, p.y1 FROM evidence_items e JOIN placed p ON p.doc_id = e.document_id AND p.field_path = e.field_path",
    "citation_crops": f"WITH {_PLACED} SELECT e.row_id, e.field_path, p.page, round(greatest(0, p.x0 - 4), 4) AS cx0, round(greatest(0, p.y0 - 1.5), 4) AS cy0, round(least({W.WIDTH}, p.x1 + 4), 4) AS cx1, round(least({W.HEIGHT}, p.y1 + 1.5), 4) AS cy1 FROM evidence_items e JOIN placed p ON p.doc_id = e.document_id AND p.field_path = e.field_path",
    "layout_status": " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, row_id AS doc_id, CAST({_PAGES} AS INTEGER) AS page_count, 'OK' AS status, '{k}' AS document_type FROM (SELECT row_id, coalesce(len({lines}), 0) AS n FROM {t})"
        for t, k, lines in _KINDS
    ),
}
