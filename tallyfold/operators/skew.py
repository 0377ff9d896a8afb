"""Joins in which one key may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.sources.tables import input_bytes

#: Bytes of an input file that one row takes, about; an error of ten in it makes the list of hot keys ten times as long and does no other harm.
BYTES_A_ROW = 16


def about_rows(df: DataFrame) -> int | None:
    """About how many rows there are, from the size of what is read, without a job; None if that is not known."""
    return input_bytes(df) // BYTES_A_ROW or None


def join_hot(rows: DataFrame, state: DataFrame, on: list[str], *, count: str, total: int | None, spread_by: list[str], hot_rows: int = 200_000, hot_share: int = 1_000, how: str = "inner", counts: DataFrame | None = None) -> DataFrame:
    """Join many rows with one state row per key, hot keys split over several tasks.

    ``state`` has one row per key and in ``count`` how many of ``rows`` have that key; a key
    is hot with more than ``hot_rows`` rows and more than one in ``hot_share`` of all
    ``total`` (which may be an estimate; None: ``hot_rows`` alone decides). So there are about
    ``hot_share`` hot keys at most, whatever the input, and only their list is broadcast; the
    rows of a hot key are dealt by a hash of ``spread_by`` to as many salts as it needs, and
    its state row is repeated once for each. counts: the keys with their ``count``, where they
    are cheaper to get than from ``state``.
    """
    limit = max(hot_rows, (total or 0) // hot_share)
    salts = F.ceil(F.col(count) / F.lit(limit)).cast("int")
    hot = (state if counts is None else counts).where(F.col(count) > limit).select(*on, salts.alias("_salts"))
    dealt = F.pmod(F.xxhash64(*spread_by), F.col("_salts")).cast("int")
    salted = rows.join(F.broadcast(hot), on, "left").withColumn("_salt", F.when(F.col("_salts").isNull(), F.lit(0)).otherwise(dealt)).drop("_salts")
    repeated = state.withColumn("_salt", F.explode(F.when(F.col(count) > limit, F.sequence(F.lit(0), salts - 1)).otherwise(F.array(F.lit(0))))).drop(count)
    return salted.join(repeated, [*on, "_salt"], how).drop("_salt")
