"""Reports and packs as text, JSON and markdown columns.

Fixed values: the wording of headlines, discrepancies and working papers, and the names of fields.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.functions.numbers import as_text


def described_discrepancy(d: Column) -> Column:
    """One discrepancy as a line of text."""
    share = F.coalesce(F.concat(F.lit("  ("), as_text(d["percentage"]), F.lit("%)")), F.lit(""))
    return F.concat(F.lit("["), d["severity"], F.lit("] "), d["check"], F.lit(" at "), d["location"], F.lit(": stated "), as_text(d["stated"]), F.lit(", computed "), as_text(d["expected"]), F.lit(", difference "), as_text(d["difference"]), share)


def report_text(report: DataFrame) -> DataFrame:
    """(doc_id, document_type, summary): a headline and one indented line for each discrepancy."""
    head = F.concat(F.coalesce("document_id", F.lit("?")), F.lit("  ("), F.coalesce("document_type", F.lit("?")), F.lit(")  "), F.col("checks_run").cast("string"), F.lit(" checks"))
    lines = F.transform("discrepancies", lambda d: F.concat(F.lit("    "), described_discrepancy(d)))
    found = F.concat(head, F.lit("  ·  "), F.size("discrepancies").cast("string"), F.lit(" discrepancy(ies)\n"), F.array_join(lines, "\n"))
    return report.select("doc_id", "document_type", F.when(F.col("balanced"), F.concat(head, F.lit("  ·  all arithmetic agrees"))).otherwise(found).alias("summary"))


def report_json(report: DataFrame) -> DataFrame:
    """(doc_id, report): the report as JSON, decimals as strings."""
    text = lambda d: F.struct(d["check"].alias("check"), d["location"].alias("location"), *(as_text(d[f]).alias(f) for f in ("expected", "stated", "difference", "percentage")), d["severity"].alias("severity"))
    computed = F.struct(*(as_text(F.col(c)).alias(c) for c in ("lines_net", "lines_tax", "lines_gross")))
    body = F.struct("document_id", "document_type", "checks_run", "balanced", computed.alias("computed"), F.transform("discrepancies", text).alias("discrepancies"))
    return report.select("doc_id", F.to_json(body, {"ignoreNullFields": "false"}).alias("report"))


def pack_markdown(packs: DataFrame) -> DataFrame:
    """(pack_id, markdown): a working-paper extract of each pack, with the time of preparation where the packs have one (``created_at``)."""
    two = lambda c: c.cast("string").try_cast("decimal(18,2)").cast("string")
    text = lambda c: F.coalesce(c.cast("string"), F.lit("None"))
    row = lambda i: F.concat(F.lit("| "), text(i["source_system"]), F.lit(" | "), text(i["document_id"]), F.lit(" | `"), text(i["field_path"]), F.lit("` | "), text(i["value"]), F.lit(" | "), F.coalesce(two(i["confidence"]), F.lit("-")), F.lit(" |"))
    empty = F.array().cast("array<string>")
    parts = F.concat(
        F.array(F.concat(F.lit("### Evidence pack "), F.col("pack_id")), F.lit("")),
        F.when(F.length("conclusion") > 0, F.array(F.concat(F.lit("**Conclusion.** "), F.col("conclusion")), F.lit(""))).otherwise(empty),
        F.array(F.concat(F.lit("Prepared "), F.col("created_at"))) if "created_at" in packs.columns else empty,
        F.array(F.concat(F.lit("Documents: "), F.array_join("documents", ", ")), F.concat(F.lit("Sources: "), F.array_join("sources", ", "))),
        F.when(F.col("weakest_confidence").isNotNull(), F.array(F.concat(F.lit("Weakest citation confidence: "), two(F.col("weakest_confidence"))))).otherwise(empty),
        F.array(F.lit(""), F.lit("| Source | Document | Field | Value | Confidence |"), F.lit("| --- | --- | --- | --- | --- |")),
        F.transform("items", row),
        F.when(F.col("integrity_hash").isNotNull(), F.array(F.lit(""), F.concat(F.lit("Integrity hash `"), F.col("integrity_hash"), F.lit("`")))).otherwise(empty),
    )
    return packs.select("pack_id", F.array_join(parts, "\n").alias("markdown"))


def pack_json(packs: DataFrame, pretty: bool = False) -> DataFrame:
    """(pack_id, pack): each pack as JSON, indented if asked; with the time of preparation where the packs have one."""
    names = ["pack_id", "created_at", "conclusion", "documents", "sources", "weakest_confidence", "integrity_hash", "items"]
    body = F.struct(*(n for n in names if n in packs.columns))
    return packs.select("pack_id", F.to_json(body, {"ignoreNullFields": "false", "pretty": str(pretty).lower()}).alias("pack"))
