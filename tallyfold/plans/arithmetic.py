"""Queries on the arithmetic of documents, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.functions.numbers import severity
from tallyfold.operators import arithmetic as A
from tallyfold.operators import render
from tallyfold.sources.tables import table

TYPES = ("invoices", "purchase_orders", "contracts")


def _documents(spark: SparkSession, d: str, names: tuple[str, ...] = TYPES) -> DataFrame:
    out = None
    for name in names:
        one = A.documents(table(spark, d, name))
        out = one if out is None else out.unionByName(one)
    return out


def _plain(df: DataFrame, *columns: str) -> DataFrame:
    """Decimals as doubles, for comparison with other engines."""
    return df.withColumns({c: F.col(c).cast("double") for c in columns})


def _check(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, d: str) -> DataFrame:
        rows = A.checks(_documents(spark, d)).where(F.col("check") == name)
        return _plain(rows.select("document_type", "doc_id", "location", "expected", "stated", "difference", "percentage", F.coalesce("severity", F.lit("agrees")).alias("severity")), "expected", "stated", "difference", "percentage")

    return run


def sum_report(spark: SparkSession, d: str) -> DataFrame:
    r = A.verdict(A.reports(_documents(spark, d)))
    return _plain(r.select("document_type", "doc_id", "checks_run", "balanced", "n_material", "n_rounding", "lines_net", "lines_tax", "lines_gross", "verdict"), "lines_net", "lines_tax", "lines_gross")


def discrepancies(spark: SparkSession, d: str) -> DataFrame:
    rows = A.discrepancies(_documents(spark, d))
    return _plain(rows.select("document_type", "doc_id", "check", "location", "expected", "stated", "difference", "percentage", "severity"), "expected", "stated", "difference", "percentage")


def tolerance_sweep(spark: SparkSession, d: str) -> DataFrame:
    """All checks graded under several pairs of tolerances at once; the pairs are exploded per row, not joined."""
    pairs = F.explode(F.array(*(F.struct(F.lit(r).cast("decimal(18,2)").alias("rounding"), F.lit(p).cast("decimal(18,2)").alias("reporting")) for r, p in (("0.00", "0.02"), ("0.02", "1.00"), ("0.05", "5.00"), ("1.00", "100.00"))))).alias("t")
    rows = A.checks(_documents(spark, d)).select("check", "expected", "stated", pairs).select("check", "expected", "stated", "t.*")
    graded = rows.withColumn("severity", F.coalesce(severity(F.col("expected"), F.col("stated"), F.col("rounding"), F.col("reporting")), F.lit("agrees")))
    return _plain(graded.groupBy("rounding", "reporting", "check", "severity").agg(F.count(F.lit(1)).alias("checks")), "rounding", "reporting")


def population_rollup(spark: SparkSession, d: str) -> DataFrame:
    return A.rollup(A.reports(_documents(spark, d)))


def report_text(spark: SparkSession, d: str) -> DataFrame:
    return render.report_text(A.reports(_documents(spark, d)))


def report_json(spark: SparkSession, d: str) -> DataFrame:
    return render.report_json(A.reports(_documents(spark, d)))


QUERIES = {f"check_{name}": _check(name) for name in A.CHECKS} | {
    "sum_report": sum_report, "discrepancies": discrepancies, "tolerance_sweep": tolerance_sweep, "population_rollup": population_rollup, "report_text": report_text, "report_json": report_json,
}

_DEC = lambda x: f"CAST(CAST({x} AS VARCHAR) AS DECIMAL(24,6))"
_C = lambda x: f"CAST(round({x}, 2) AS DECIMAL(24,2))"
_SQL = f"""
docs AS (
  SELECT 'invoice' AS document_type, row_id AS doc_id, document_id, lines, totals IS NOT NULL AS has_totals, totals.subtotal AS subtotal, totals.tax_total AS tax_total, totals.grand_total AS grand_total, CAST(NULL AS DOUBLE) AS order_value, document_type AS stated_type FROM invoices
  UNION ALL SELECT 'purchase_order', row_id, document_id, lines, false, NULL, NULL, NULL, order_value, document_type FROM purchase_orders
),
every AS (SELECT stated_type AS document_type, doc_id, document_id FROM docs UNION ALL SELECT document_type, row_id, document_id FROM contracts),
raw AS (SELECT stated_type AS document_type, doc_id, unnest(lines) AS l, generate_subscripts(lines, 1) AS i FROM docs),
figures AS (
  SELECT document_type, doc_id, i, 'line[' || coalesce(CAST(l.line_number AS VARCHAR), '?') || '].' AS ref,
    {_DEC('l.net_amount')} AS net, {_DEC('l.tax_rate')} AS rate, {_DEC('l.tax_amount')} AS tax, {_DEC('l.line_total')} AS total,
    {_C(f"CAST({_DEC('l.quantity')} AS DECIMAL(30,6)) * CAST({_DEC('l.unit_price')} AS DECIMAL(30,6))")} AS ext FROM raw
),
counted AS (
  SELECT *, coalesce(net, CAST(ext AS DECIMAL(24,6)), 0) AS net_c, CASE WHEN rate IS NOT NULL AND tax IS NOT NULL THEN tax ELSE 0 END AS tax_c FROM figures
),
sums AS (
  SELECT d.stated_type AS document_type, d.doc_id, coalesce(s.net, 0) AS net, coalesce(s.tax, 0) AS tax, d.has_totals,
         {_DEC('d.subtotal')} AS subtotal, {_DEC('d.tax_total')} AS tax_total, {_DEC('d.grand_total')} AS grand_total, {_DEC('d.order_value')} AS order_value
  FROM docs d LEFT JOIN (SELECT document_type, doc_id, sum(net_c) AS net, sum(tax_c) AS tax FROM counted GROUP BY ALL) s ON s.document_type = d.stated_type AND s.doc_id = d.doc_id
),
made AS (
  SELECT document_type, doc_id, 'line_extension' AS "check", ref || 'net_amount' AS location, ext AS expected, {_C('net')} AS stated, i AS i, 1 AS k FROM counted WHERE ext IS NOT NULL AND net IS NOT NULL
  UNION ALL SELECT document_type, doc_id, 'line_tax', ref || 'tax_amount', {_C("CAST(net_c AS DECIMAL(30,6)) * CAST(rate AS DECIMAL(30,6)) * CAST(0.01 AS DECIMAL(30,2))")}, {_C('tax')}, i AS i, 2 AS k FROM counted WHERE rate IS NOT NULL AND tax IS NOT NULL
  UNION ALL SELECT document_type, doc_id, 'line_total', ref || 'line_total', {_C('net_c + tax_c')}, {_C('total')}, i AS i, 3 AS k FROM counted WHERE total IS NOT NULL
  UNION ALL SELECT document_type, doc_id, 'subtotal', 'totals.subtotal', {_C('net')}, {_C('subtotal')}, 1000000000 AS i, 4 AS k FROM sums WHERE subtotal IS NOT NULL
  UNION ALL SELECT document_type, doc_id, 'tax_total', 'totals.tax_total', {_C('tax')}, {_C('tax_total')}, 1000000000 AS i, 5 AS k FROM sums WHERE tax_total IS NOT NULL
  UNION ALL SELECT document_type, doc_id, 'grand_total', 'totals.grand_total', {_C('coalesce(subtotal, net) + coalesce(tax_total, tax)')}, {_C('grand_total')}, 1000000000 AS i, 6 AS k FROM sums WHERE grand_total IS NOT NULL
  UNION ALL SELECT document_type, doc_id, 'order_value', 'order_value', {_C('net')}, {_C('order_value')}, 1000000000 AS i, 7 AS k FROM sums WHERE NOT has_totals AND order_value IS NOT NULL
),
graded AS (
  SELECT *, stated - expected AS difference,
    CASE WHEN abs(stated - expected) <= 0.02 THEN 'agrees' WHEN abs(stated - expected) <= 1 THEN 'rounding' ELSE 'material' END AS severity FROM made
),
report AS (
  SELECT e.document_type, e.doc_id, coalesce(g.n, 0) AS checks_run, coalesce(g.material, 0) AS n_material, coalesce(g.rounding, 0) AS n_rounding
  FROM every e LEFT JOIN (SELECT document_type, doc_id, count(*) AS n, count(*) FILTER (WHERE severity = 'material') AS material, count(*) FILTER (WHERE severity = 'rounding') AS rounding FROM graded GROUP BY ALL) g USING (document_type, doc_id)
)
"""


def _pct(e: str = "expected", s: str = "stated") -> str:
    """Percentage to two decimals, half up, in whole numbers: floor((|s-e| * 10000 * 2 + |e|) / (2 |e|)) / 100."""
    return f"CASE WHEN {e} <> 0 THEN CAST((CAST(abs({s} - {e}) * 100 AS HUGEINT) * 20000 + CAST(abs({e}) * 100 AS HUGEINT)) // (2 * CAST(abs({e}) * 100 AS HUGEINT)) AS DOUBLE) / 100 END"


_COLUMNS = f"location, CAST(expected AS DOUBLE) AS expected, CAST(stated AS DOUBLE) AS stated, CAST(stated - expected AS DOUBLE) AS difference, {_pct()} AS percentage, severity"

_TXT = lambda x: f"CAST({_C(x)} AS VARCHAR)"
_PCT = f"CAST(CAST({_pct()} AS DECIMAL(24,2)) AS VARCHAR)"
_Q = lambda x: f"coalesce('\"' || replace(replace({x}, '\\', '\\\\'), '\"', '\\\"') || '\"', 'null')"

ORACLE = {f"check_{name}": f"""WITH {_SQL} SELECT document_type, doc_id, {_COLUMNS} FROM graded WHERE "check" = '{name}'""" for name in A.CHECKS} | {
    "discrepancies": f"""WITH {_SQL} SELECT document_type, doc_id, "check", {_COLUMNS} FROM graded WHERE severity <> 'agrees'""",
    "sum_report": f"""WITH {_SQL} SELECT r.document_type, r.doc_id, CAST(checks_run AS INTEGER) AS checks_run, n_material + n_rounding = 0 AS balanced, CAST(n_material AS INTEGER) AS n_material, CAST(n_rounding AS INTEGER) AS n_rounding,
      CAST({_C('coalesce(net, 0)')} AS DOUBLE) AS lines_net, CAST({_C('coalesce(tax, 0)')} AS DOUBLE) AS lines_tax, CAST({_C('coalesce(net, 0) + coalesce(tax, 0)')} AS DOUBLE) AS lines_gross,
      CASE WHEN checks_run = 0 THEN 'not applicable' WHEN n_material + n_rounding = 0 THEN 'agrees' WHEN n_material > 0 THEN 'DISCREPANCY' ELSE 'rounding' END AS verdict
      FROM report r LEFT JOIN sums s USING (document_type, doc_id)""",
    "tolerance_sweep": f"""WITH {_SQL} SELECT CAST(t.a AS DOUBLE) AS rounding, CAST(t.b AS DOUBLE) AS reporting, "check",
      CASE WHEN abs(stated - expected) <= t.a THEN 'agrees' WHEN abs(stated - expected) <= t.b THEN 'rounding' ELSE 'material' END AS severity, count(*) AS checks
      FROM made, (VALUES (0.00, 0.02), (0.02, 1.00), (0.05, 5.00), (1.00, 100.00)) t(a, b) GROUP BY ALL""",
    "population_rollup": f"""WITH {_SQL} SELECT document_type, count(*) AS documents, count(*) FILTER (WHERE checks_run = 0) AS not_applicable, count(*) FILTER (WHERE checks_run > 0 AND n_material + n_rounding = 0) AS agree,
      count(*) FILTER (WHERE n_material > 0) AS material, count(*) FILTER (WHERE n_material = 0 AND n_rounding > 0) AS rounding_only, CAST(sum(checks_run) AS BIGINT) AS checks_run FROM report GROUP BY ALL""",
    "report_text": f"""WITH {_SQL}, named AS (SELECT stated_type AS document_type, doc_id, document_id FROM docs UNION ALL SELECT document_type, row_id, document_id FROM contracts),
told AS (SELECT document_type, doc_id, count(*) AS n, string_agg('    [' || severity || '] ' || "check" || ' at ' || location || ': stated ' || {_TXT('stated')} || ', computed ' || {_TXT('expected')} || ', difference ' || {_TXT('stated - expected')} || coalesce('  (' || {_PCT} || '%)', ''), chr(10) ORDER BY i, k) AS lines
  FROM graded WHERE severity <> 'agrees' GROUP BY ALL)
SELECT e.doc_id, e.document_type, coalesce(e.document_id, '?') || '  (' || coalesce(e.document_type, '?') || ')  ' || r.checks_run || ' checks' || CASE WHEN t.n IS NULL THEN '  ·  all arithmetic agrees' ELSE '  ·  ' || t.n || ' discrepancy(ies)' || chr(10) || t.lines END AS summary
FROM named e JOIN report r ON r.document_type IS NOT DISTINCT FROM e.document_type AND r.doc_id = e.doc_id LEFT JOIN told t ON t.document_type IS NOT DISTINCT FROM e.document_type AND t.doc_id = e.doc_id""",
    "report_json": f"""WITH {_SQL}, named AS (SELECT stated_type AS document_type, doc_id, document_id FROM docs UNION ALL SELECT document_type, row_id, document_id FROM contracts),
told AS (SELECT document_type, doc_id, string_agg('{{"check":"' || "check" || '","location":"' || location || '","expected":"' || {_TXT('expected')} || '","stated":"' || {_TXT('stated')} || '","difference":"' || {_TXT('stated - expected')} || '","percentage":' || coalesce('"' || {_PCT} || '"', 'null') || ',"severity":"' || severity || '"}}', ',' ORDER BY i, k) AS items
  FROM graded WHERE severity <> 'agrees' GROUP BY ALL)
SELECT e.doc_id, '{{"document_id":' || {_Q('e.document_id')} || ',"document_type":' || {_Q('e.document_type')} || ',"checks_run":' || r.checks_run || ',"balanced":' || CASE WHEN t.items IS NULL THEN 'true' ELSE 'false' END ||
  ',"computed":{{"lines_net":"' || {_TXT('coalesce(s.net, 0)')} || '","lines_tax":"' || {_TXT('coalesce(s.tax, 0)')} || '","lines_gross":"' || {_TXT('coalesce(s.net, 0) + coalesce(s.tax, 0)')} || '"}},"discrepancies":[' || coalesce(t.items, '') || ']}}' AS report
FROM named e JOIN report r ON r.document_type IS NOT DISTINCT FROM e.document_type AND r.doc_id = e.doc_id LEFT JOIN sums s ON s.document_type IS NOT DISTINCT FROM e.document_type AND s.doc_id = e.doc_id
LEFT JOIN told t ON t.document_type IS NOT DISTINCT FROM e.document_type AND t.doc_id = e.doc_id""",
}
