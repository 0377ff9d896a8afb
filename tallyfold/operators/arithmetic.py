"""Recomputing what documents state: lines, taxes, totals and order values.

Every check is a row (check, location, expected, stated); all are projections of one
document row and its lines, so a document is checked where it lies, without a shuffle.

Defined cases: an absent (null) figure is not checked; a line without quantity or price has
no extension, and its net amount counts if stated; without rate or tax amount a line's tax
is zero; documents without lines and totals have no checks and are not applicable; a
non-numeric value counts as absent; repeated rows are checked each for itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.functions.numbers import cents, difference, money, percentage, severity

ROUNDING, REPORTING = "0.02", "1.00"
CHECKS = ("line_extension", "line_tax", "line_total", "subtotal", "tax_total", "grand_total", "order_value")

_LINE = "array<struct<line_number:int,quantity:double,unit_price:double,net_amount:double,tax_rate:double,tax_amount:double,line_total:double>>"


def documents(df: DataFrame, doc_id: str = "row_id") -> DataFrame:
    """Any table of parsed documents as (doc_id, document_id, document_type, lines, subtotal, tax_total, grand_total, order_value)."""
    has = {f.name for f in df.schema.fields}
    null = F.lit(None).cast("double")
    total = lambda name: F.col(f"totals.{name}") if "totals" in has else null
    fields = ("line_number", "quantity", "unit_price", "net_amount", "tax_rate", "tax_amount", "line_total")
    lines = F.transform("lines", lambda x: F.struct(*(x[f].alias(f) for f in fields))) if "lines" in has else F.lit(None)
    return df.select(
        F.col(doc_id).alias("doc_id"), "document_id", "document_type", lines.cast(_LINE).alias("lines"),
        total("subtotal").alias("subtotal"), total("tax_total").alias("tax_total"), total("grand_total").alias("grand_total"),
        (F.col("order_value") if "order_value" in has else null).alias("order_value"),
        (F.col("totals").isNotNull() if "totals" in has else F.lit(False)).alias("has_totals"),
    )


def _line(x: Column) -> Column:
    """One line with its exact figures, net and tax taken into the sums."""
    quantity, price, net, rate, tax, total = (money(x[f]) for f in ("quantity", "unit_price", "net_amount", "tax_rate", "tax_amount", "line_total"))
    extension = cents(quantity * price)
    counted = F.coalesce(net, extension, F.lit(0).cast("decimal(18,6)")).cast("decimal(18,6)")
    tax_counted = F.when(rate.isNotNull() & tax.isNotNull(), tax).otherwise(F.lit(0)).cast("decimal(18,6)")
    ref = F.concat(F.lit("line["), F.coalesce(x["line_number"].cast("string"), F.lit("?")), F.lit("]."))
    check = lambda name, field, expected, stated, when: F.when(
        when & expected.isNotNull() & stated.isNotNull(),
        F.struct(F.lit(name).alias("check"), F.concat(ref, F.lit(field)).alias("location"), cents(expected).alias("expected"), cents(stated).alias("stated")),
    )
    yes = F.lit(True)
    return F.struct(
        counted.alias("net"), tax_counted.alias("tax"),
        F.filter(F.array(
            check("line_extension", "net_amount", extension, net, yes),
            check("line_tax", "tax_amount", cents(counted * rate / 100), tax, rate.isNotNull()),
            check("line_total", "line_total", counted + tax_counted, total, yes),
        ), lambda c: c.isNotNull()).alias("checks"),
    )


def _sum(lines: Column, field: str) -> Column:
    return F.aggregate(lines, F.lit(0).cast("decimal(28,6)"), lambda acc, x: (acc + x[field]).cast("decimal(28,6)"))


def checked(docs: DataFrame) -> DataFrame:
    """(doc_id, document_id, document_type, checks, lines_net, lines_tax, lines_gross): all checks of a document in an array."""
    lines = docs.withColumn("l", F.transform(F.coalesce("lines", F.array().cast(_LINE)), _line)).withColumn("net", _sum(F.col("l"), "net")).withColumn("tax", _sum(F.col("l"), "tax"))
    sub, tax, grand, order = (money(F.col(c)) for c in ("subtotal", "tax_total", "grand_total", "order_value"))
    total = lambda name, location, expected, stated: F.when(
        stated.isNotNull(), F.struct(F.lit(name).alias("check"), F.lit(location).alias("location"), cents(expected).alias("expected"), cents(stated).alias("stated"))
    )
    of_totals = F.filter(F.array(
        total("subtotal", "totals.subtotal", F.col("net"), sub),
        total("tax_total", "totals.tax_total", F.col("tax"), tax),
        total("grand_total", "totals.grand_total", F.coalesce(sub, F.col("net")) + F.coalesce(tax, F.col("tax")), grand),
        F.when(~F.col("has_totals"), total("order_value", "order_value", F.col("net"), order)),
    ), lambda c: c.isNotNull())
    return lines.select(
        "doc_id", "document_id", "document_type", F.concat(F.flatten("l.checks"), of_totals).alias("checks"),
        cents(F.col("net")).alias("lines_net"), cents(F.col("tax")).alias("lines_tax"), cents(F.col("net") + F.col("tax")).alias("lines_gross"),
    )


def checks(docs: DataFrame, rounding: Column | str = ROUNDING, reporting: Column | str = REPORTING) -> DataFrame:
    """One row per check, with difference, percentage and severity (null where it agrees)."""
    one = checked(docs).select("doc_id", "document_id", "document_type", F.posexplode("checks").alias("ord", "c")).select("doc_id", "document_id", "document_type", "ord", "c.*")
    lit = lambda x: F.lit(x).cast("decimal(18,2)") if isinstance(x, str) else x
    e, s = F.col("expected"), F.col("stated")
    return one.withColumns({"difference": difference(e, s), "percentage": percentage(e, s), "severity": severity(e, s, lit(rounding), lit(reporting))})


def discrepancies(docs: DataFrame, rounding: str = ROUNDING, reporting: str = REPORTING) -> DataFrame:
    return checks(docs, rounding, reporting).where("severity is not null")


def reports(docs: DataFrame, rounding: str = ROUNDING, reporting: str = REPORTING) -> DataFrame:
    """One row per document: checks run, discrepancies (array), computed sums, balanced and material counts."""
    r, p = (F.lit(x).cast("decimal(18,2)") for x in (rounding, reporting))
    graded = F.transform("checks", lambda c: F.struct(
        c["check"].alias("check"), c["location"].alias("location"), c["expected"].alias("expected"), c["stated"].alias("stated"),
        difference(c["expected"], c["stated"]).alias("difference"), percentage(c["expected"], c["stated"]).alias("percentage"), severity(c["expected"], c["stated"], r, p).alias("severity"),
    ))
    found = checked(docs).withColumn("discrepancies", F.filter(graded, lambda c: c["severity"].isNotNull()))
    material = F.size(F.filter("discrepancies", lambda c: c["severity"] == "material"))
    return found.select(
        "doc_id", "document_id", "document_type", F.size("checks").alias("checks_run"), "discrepancies", "lines_net", "lines_tax", "lines_gross",
        (F.size("discrepancies") == 0).alias("balanced"), material.alias("n_material"), (F.size("discrepancies") - material).alias("n_rounding"),
    )


def verdict(report: DataFrame) -> DataFrame:
    """Adds ``verdict``: not applicable, agrees, DISCREPANCY or rounding."""
    return report.withColumn("verdict", F.when(F.col("checks_run") == 0, "not applicable").when(F.col("balanced"), "agrees").when(F.col("n_material") > 0, "DISCREPANCY").otherwise("rounding"))


def rollup(report: DataFrame) -> DataFrame:
    """Population counts per document type."""
    v = F.col("verdict")
    return verdict(report).groupBy("document_type").agg(
        F.count(F.lit(1)).alias("documents"), F.count_if(v == "not applicable").alias("not_applicable"), F.count_if(v == "agrees").alias("agree"),
        F.count_if(v == "DISCREPANCY").alias("material"), F.count_if(v == "rounding").alias("rounding_only"), F.sum("checks_run").alias("checks_run"),
    )
