"""Streaming queries; they run over what is there now and end."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from tallyfold.operators import matching
from tallyfold.plans.arithmetic import _SQL
from tallyfold.sources.tables import ensure_checkpoint_dir, table
from tallyfold.streaming import ingest


def _place(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"


TYPES = ("invoices", "purchase_orders", "contracts")


def _stream(spark: SparkSession, d: str, name: str) -> DataFrame:
    return ingest.read_stream(spark, f"{d}/{name}.parque[t]", table(spark, d, name).schema)


def streamed_reports(spark: SparkSession, d: str) -> DataFrame:
    """Documents of all types checked as file streams, each micro-batch on its own."""
    at, out = _place(spark), []
    for name in TYPES:
        ingest.check_stream(_stream(spark, d, name), f"{at}/{name}", f"{at}/state-{name}")
        out.append(spark.read.parquet(f"{at}/{name}").drop("batch"))
    return reduce(DataFrame.unionByName, out)


def arrivals_by_week(spark: SparkSession, d: str) -> DataFrame:
    """Documents of all types per week of arrival, by the windowed aggregation of one stream in complete mode."""
    at = _place(spark)
    stream = reduce(DataFrame.unionByName, (_stream(spark, d, name).select("document_type", "ingested_at") for name in TYPES))
    out = f"{at}/windows"
    ingest.arrivals(stream).writeStream.outputMode("complete").foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(out)).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


def three_way_match(spark: SparkSession, d: str) -> DataFrame:
    """Invoice lines against the order they refer to and the ceiling of its contract (an extension)."""
    return matching.three_way(table(spark, d, "invoices"), table(spark, d, "purchase_orders"), table(spark, d, "contracts"))


QUERIES = {"streamed_reports": streamed_reports, "arrivals_by_week": arrivals_by_week, "three_way_match": three_way_match}

ORACLE = {
    "streamed_reports": f"""WITH {_SQL} SELECT r.doc_id, i.document_id, r.document_type, CAST(checks_run AS INTEGER) AS checks_run, CAST(n_material AS INTEGER) AS n_material, CAST(n_rounding AS INTEGER) AS n_rounding,
      CASE WHEN checks_run = 0 THEN 'not applicable' WHEN n_material + n_rounding = 0 THEN 'agrees' WHEN n_material > 0 THEN 'DISCREPANCY' ELSE 'rounding' END AS verdict
      FROM report r JOIN (SELECT row_id, document_type, document_id FROM invoices UNION ALL SELECT row_id, document_type, document_id FROM purchase_orders UNION ALL SELECT row_id, 'contract', document_id FROM contracts) i ON i.row_id = r.doc_id AND i.document_type = r.document_type""",
    "arrivals_by_week": "SELECT time_bucket(INTERVAL '7 days', ingested_at, TIMESTAMP '1970-01-01') AS window_start, document_type, count(*) AS documents FROM (SELECT ingested_at, document_type FROM invoices UNION ALL SELECT ingested_at, document_type FROM purchase_orders UNION ALL SELECT ingested_at, document_type FROM contracts) WHERE ingested_at IS NOT NULL GROUP BY ALL",
    "three_way_match": """
WITH inv AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY ingested_at, row_id) AS rn FROM invoices WHERE document_id IS NOT NULL) WHERE rn = 1),
po AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY ingested_at, row_id) AS rn FROM purchase_orders WHERE document_id IS NOT NULL) WHERE rn = 1),
ct AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY ingested_at, row_id) AS rn FROM contracts WHERE document_id IS NOT NULL) WHERE rn = 1),
k AS (SELECT inv.document_id, po.document_id AS po_id, ct.document_id AS contract_id, unnest(inv.lines) AS l, po.lines AS pl, ct.rate_schedule AS rs FROM inv JOIN po ON po.document_id = inv.po_reference LEFT JOIN ct ON ct.document_id = po.contract_reference),
m AS (SELECT document_id, po_id, contract_id, l.description AS description, l.unit_price AS invoiced,
  list_min(list_transform(list_filter(pl, lambda x: lower(trim(x.description)) = lower(trim(l.description))), lambda x: x.unit_price)) AS ordered,
  list_min(list_transform(list_filter(rs, lambda x: lower(trim(x.description)) = lower(trim(l.description))), lambda x: x.max_unit_price)) AS ceiling FROM k)
SELECT document_id, po_id, contract_id, description, invoiced, ordered, ceiling, CASE WHEN invoiced > ceiling THEN 'above ceiling' WHEN invoiced > ordered THEN 'above order' WHEN ordered IS NULL THEN 'not ordered' WHEN invoiced IS NULL THEN 'no price' ELSE 'agrees' END AS finding FROM m""",
}
