"""References to records that do not exist, are deleted, or arrive later.

Parent keys are compressed into runs of consecutive integers. A reference is as-of
matched to the run that starts at or before it and is an orphan when it lies beyond
that run's end. References are pre-aggregated to distinct keys before the match, so a
key that holds a third of all rows costs one row there; the rows themselves are then joined
with the keys that can make one of them an orphan, hot keys salted.

Defined cases: a null or otherwise malformed reference is no reference and gives no
row; a null ``ingested_at`` gives only the finding of a missing key, with a null month;
equal times count as arrived (first ingested) and as deleted (deleted_at); repeated rows
are reported once per row; an empty parent table makes every reference an orphan; other
columns of the inputs are ignored whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyfold.operators.skew import about_rows, join_hot

#: Printed forms of keys: kind -> (pattern with one group of digits, prefix)
KEY_FORMS = {
    "PO": r"\APO-(\d{11})\z",
    "CTR": r"\ACTR-(\d{6})\z",
    "INV": r"\AINV-2025-(\d{8})\z",
}

#: Runs are cut at multiples of this, so that no window holds more keys than this.
RUN_BUCKET = 1 << 20


def _key(column: Column, kinds: Iterable[str]) -> Column:
    """struct(kind, key) of a printed key, null when the text is no key of these kinds."""
    out = F.lit(None).cast("struct<kind:string,key:bigint>")
    for kind in kinds:
        pattern = KEY_FORMS[kind]
        parsed = F.struct(F.lit(kind).alias("kind"), F.regexp_extract(column, pattern, 1).try_cast("bigint").alias("key"))
        out = F.when(column.rlike(pattern), parsed).otherwise(out)
    return out


@dataclass
class References:
    """Rows of one table that name records: which column, and the kinds of key that count."""

    name: str
    rows: DataFrame
    column: str
    kinds: tuple[str, ...]
    row_id: str = "row_id"
    at: str = "ingested_at"


@dataclass
class Parents:
    """A table of records of one kind, with the times from and until which a record is there."""

    kind: str
    rows: DataFrame
    column: str = "document_id"
    ingested: str = "ingested_at"
    deleted: str | None = None


def references(parts: Iterable[References]) -> DataFrame:
    """(ref_table, row_id, kind, key, at) of all well-formed references."""
    out = None
    for p in parts:
        one = (
            p.rows.select(F.lit(p.name).alias("ref_table"), F.col(p.row_id).alias("row_id"), _key(F.col(p.column), p.kinds).alias("k"), F.col(p.at).alias("at"))
            .where("k is not null")
            .select("ref_table", "row_id", "k.kind", "k.key", "at")
        )
        out = one if out is None else out.unionByName(one)
    return out


def parents(parts: Iterable[Parents]) -> DataFrame:
    """One row per existing key: (kind, key, first_at, deleted_at)."""
    out = None
    for p in parts:
        deleted = F.col(p.deleted) if p.deleted else F.lit(None).cast("timestamp")
        one = (
            p.rows.select(_key(F.col(p.column), (p.kind,)).alias("k"), F.col(p.ingested).alias("at"), deleted.alias("gone"))
            .where("k is not null")
            .select("k.kind", "k.key", "at", "gone")
        )
        out = one if out is None else out.unionByName(one)
    return out.groupBy("kind", "key").agg(F.min("at").alias("first_at"), F.min("gone").alias("deleted_at"))


def key_runs(keys: DataFrame, bucket: int = RUN_BUCKET) -> DataFrame:
    """Distinct (kind, key) compressed into runs (kind, bucket, run_start, run_end, keys)."""
    b = F.floor(F.col("key") / F.lit(bucket)).alias("bucket")
    w = Window.partitionBy("kind", "bucket").orderBy("key")
    return (
        keys.select("kind", "key", b)
        .withColumn("island", F.col("key") - F.row_number().over(w))
        .groupBy("kind", "bucket", "island")
        .agg(F.min("key").alias("run_start"), F.max("key").alias("run_end"), F.count(F.lit(1)).alias("keys"))
        .drop("island")
    )


def beyond_run_end(refs: DataFrame, runs: DataFrame, bucket: int = RUN_BUCKET) -> DataFrame:
    """As-of match of distinct (kind, key, ...) to the run that starts at or before the key: adds missing."""
    b = F.floor(F.col("key") / F.lit(bucket)).alias("bucket")
    asked = refs.select("*", b, F.lit(True).alias("asked"))
    starts = runs.select("kind", "bucket", F.col("run_start").alias("key"), "run_end")
    w = Window.partitionBy("kind", "bucket").orderBy("key", F.coalesce("asked", F.lit(False))).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.last("run_end", ignorenulls=True).over(w)
    return (
        asked.unionByName(starts, allowMissingColumns=True)
        .withColumn("run_end", end)
        .where("asked")
        .select(*refs.columns, (F.col("run_end").isNull() | (F.col("key") > F.col("run_end"))).alias("missing"))
    )


def suspects(refs: DataFrame, there: DataFrame) -> DataFrame:
    """(kind, key, refs, missing, first_at, deleted_at) of the keys that some row may be an orphan by.

    Rows are reduced to distinct keys with their number and the span of their times before
    anything else. The runs tell the missing ones; only keys inside a run are looked up in the
    parents, and only those that arrived after the first row or were deleted before the last
    are left.
    """
    counted = refs.groupBy("kind", "key").agg(F.count(F.lit(1)).alias("refs"), F.min("at").alias("since"), F.max("at").alias("until"))
    state = beyond_run_end(counted, key_runs(there)).alias("s")
    inside = (F.col("s.kind") == F.col("p.kind")) & (F.col("s.key") == F.col("p.key")) & ~F.col("missing")
    known = state.join(there.alias("p"), inside, "left").select("s.*", "p.first_at", "p.deleted_at")
    return known.where(F.col("missing") | (F.col("first_at") > F.col("since")) | (F.col("deleted_at") <= F.col("until"))).drop("since", "until")


def find_orphans(refs: DataFrame, there: DataFrame, *, hot_rows: int = 50_000, hot_share: int = 1_000) -> DataFrame:
    """(ref_table, row_id, kind, key, at, reason) of every reference without a record.

    reason is ``missing``, ``late`` (first ingested after the row) or ``deleted`` (at or before the row).
    The references are read twice: for their distinct keys, and to be joined with the suspect ones.
    """
    joined = join_hot(refs, suspects(refs, there), ["kind", "key"], count="refs", total=about_rows(refs), spread_by=["ref_table", "row_id"], hot_rows=hot_rows, hot_share=hot_share)
    reason = (
        F.when(F.col("missing"), F.lit("missing"))
        .when(F.col("first_at") > F.col("at"), F.lit("late"))
        .when(F.col("deleted_at") <= F.col("at"), F.lit("deleted"))
    )
    return joined.withColumn("reason", reason).where("reason is not null").select("ref_table", "row_id", "kind", "key", "at", "reason")


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Orphans counted per table, month and reason."""
    return orphans.groupBy("ref_table", F.date_format("at", "yyyy-MM").alias("ref_month"), "reason").agg(F.count(F.lit(1)).alias("orphans"), F.countDistinct("kind", "key").alias("keys"))
