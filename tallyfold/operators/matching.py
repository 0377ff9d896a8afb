"""Invoice, order and contract side by side (an extension; the documents only name each other).

Defined cases: documents delivered again count once, as first delivered; an invoice whose
order is not there gives no row; lines are compared where their descriptions are equal but
for case and outer blanks; nulls compare with nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _once(df: DataFrame, *columns: str) -> DataFrame:
    return df.where("document_id is not null").groupBy("document_id").agg(F.min_by(F.struct(*columns), F.struct("ingested_at", "row_id")).alias("x")).select("document_id", "x.*")


def _lowest(items: Column, price: str, description: Column) -> Column:
    same = F.filter(items, lambda x: F.lower(F.trim(x["description"])) == F.lower(F.trim(description)))
    return F.array_min(F.transform(same, lambda x: x[price]))


def three_way(invoices: DataFrame, orders: DataFrame, contracts: DataFrame) -> DataFrame:
    """(document_id, po_id, contract_id, description, invoiced, ordered, ceiling, finding) of each invoice line."""
    po = _once(orders, "contract_reference", "lines").select(F.col("document_id").alias("po_id"), F.col("contract_reference").alias("contract_id"), F.col("lines").alias("ordered_lines"))
    ct = _once(contracts, "rate_schedule").select(F.col("document_id").alias("contract_id"), "rate_schedule", F.col("document_id").alias("contract"))
    inv = _once(invoices, "po_reference", "lines").select("document_id", F.col("po_reference").alias("po_id"), "lines")
    lines = inv.join(po, "po_id").join(ct, "contract_id", "left").select("document_id", "po_id", F.col("contract").alias("contract_id"), F.explode("lines").alias("l"), "ordered_lines", "rate_schedule")
    out = lines.select("document_id", "po_id", "contract_id", F.col("l.description").alias("description"), F.col("l.unit_price").alias("invoiced"), _lowest(F.col("ordered_lines"), "unit_price", F.col("l.description")).alias("ordered"), _lowest(F.col("rate_schedule"), "max_unit_price", F.col("l.description")).alias("ceiling"))
    finding = F.when(F.col("invoiced") > F.col("ceiling"), "above ceiling").when(F.col("invoiced") > F.col("ordered"), "above order").when(F.col("ordered").isNull(), "not ordered").when(F.col("invoiced").isNull(), "no price").otherwise("agrees")
    return out.withColumn("finding", finding)
