"""Queries of the subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.llm import bpe, canonical, linkage, packing, pii
from tallyfold.sources.tables import spread, table


def _matched(spark: SparkSession, d: str) -> DataFrame:
    invoices, orders = table(spark, d, "invoices"), table(spark, d, "purchase_orders")
    return canonical.match_references(
        invoices.select("row_id", "po_reference", F.col("seller.name").alias("seller_name")),
        orders.select("document_id", F.col("vendor.name").alias("vendor_name")),
        row_id="row_id", value="po_reference", name="seller_name", key="document_id", owner="vendor_name",
    )


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _matched(spark, d).select("row_id", F.coalesce("key", F.lit(canonical.UNMATCHED)).alias("po_id"))


def p1_misses(spark: SparkSession, d: str) -> DataFrame:
    return canonical.misses(_matched(spark, d))


def _linked(spark: SparkSession, d: str) -> DataFrame:
    has_contract = F.col("contract_reference").rlike(r"\ACTR-[0-9]{6}\z")
    return linkage.link(table(spark, d, "purchase_orders"), table(spark, d, "contracts"), has_contract)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _linked(spark, d).drop("confidence", "converged")


def p4_matches(spark: SparkSession, d: str) -> DataFrame:
    return _linked(spark, d).withColumn("confidence", F.round("confidence", 4))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    docs = spread(table(spark, d, "documents").select("doc_id", "text"))
    return bpe.encode(docs, bpe.vocabulary(spark))


def _placed(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text", "source")
    return packing.pack(packing.pieces(spread(docs), bpe.vocabulary(spark)), docs.count())


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    return _placed(spark, d)


def p7_summary(spark: SparkSession, d: str) -> DataFrame:
    return packing.summary(_placed(spark, d))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    docs = spread(table(spark, d, "documents").select("doc_id", "text"))
    return pii.find(docs, pii.model_of(table(spark, d, "given_names")))


def p8_masked(spark: SparkSession, d: str) -> DataFrame:
    docs = spread(table(spark, d, "documents").select("doc_id", "text"))
    return pii.mask(docs, pii.model_of(table(spark, d, "given_names")))


QUERIES = {
    "p1_found": p1_found, "p1_misses": p1_misses,
    "p4_found": p4_found, "p4_matches": p4_matches,
    "p6_ids": p6_ids, "p7_containers": p7_containers, "p7_summary": p7_summary,
    "p8_found": p8_found, "p8_masked": p8_masked,
}
ORACLE: dict[str, str] = {}
