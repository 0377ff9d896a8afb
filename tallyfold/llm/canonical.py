"""Mapping of freely typed references to the entries of a canonical list.

Every typed value is reduced to the codes it may mean: its longest run of figures (groups
and letters that look like figures included), without leading zeros. List and values are
expanded to all strings with up to ``max_edits`` characters deleted (symmetric-delete
dictionary); two codes that share one are compared by a weighted Damerau-Levenshtein
distance. Of the entries within the bound the nearest wins, among equals the one whose
owner's name is most like that on the row, then the more often referenced, then the smaller
key. An entry that needs an edit must not contradict the row's name: a chance neighbour
among many keys has another owner.

The dictionary is broadcast while it has at most ``broadcast_entries`` codes (counted
first) and is shuffled by the deleted string beyond that. Only distinct values are matched;
rows are joined with the result of their value, values that many rows share salted.

Defined cases: a null value gives no row, a blank one ``UNMATCHED``, as does any text
without a run of figures; a value that is exactly a listed key gives no row; rows are
reported each for itself, repeated ones too; an empty list leaves everything unmatched; a
null or blank name on either side agrees with any.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.similarity import name_bigrams, overlap, weighted_edits
from tallyfold.operators.skew import about_rows, join_hot
from tallyfold.sources.tables import by_key

UNMATCHED = "UNMATCHED"

# Figures of full width, and letters that are read or typed for figures.
FULL_WIDTH = "０１２３４５６７８９"
LETTERS, FIGURES = "oilszb", "011528"

_G = rf"[\d{LETTERS}]"
_RUN = rf"(?:(?<![\p{{L}}\d])[{LETTERS}]{{0,4}}|(?<!\d))\d{_G}*(?:[ .,'’`´_\-\x{{a0}}\x{{2007}}\x{{2009}}\x{{202f}}][{LETTERS}]*\d{_G}*)*"

#: Rows agree with an entry when so much of the shorter name's letter pairs are in the other.
NAME_AGREES = 0.5


def codes(value: Column, whole_length: int) -> Column:
    """Codes a typed value may mean, as an array of strings of digits, with their leading zeros and without.

    Both are needed: zeros are left out at will, but after a slip in the figure that follows
    them, those behind it would pass for leading ones. A group of at least ``whole_length`` figures stands for itself even where others follow.
    """
    plain = F.regexp_replace(F.lower(F.translate(value, FULL_WIDTH, "0123456789")), r"\.0(?![\d.])", "")
    runs = F.regexp_extract_all(plain, F.lit(_RUN), F.lit(0))
    digits = lambda x: F.regexp_replace(F.translate(x, LETTERS, FIGURES), r"\D", "")
    groups = F.regexp_extract_all(plain, F.lit(rf"(?<!{_G}){_G}*\d{_G}*"), F.lit(0))
    long_groups = F.filter(groups, lambda x: F.length(F.regexp_replace(F.translate(x, LETTERS, FIGURES), r"\D", "")) >= whole_length)
    return both_spellings(F.transform(F.concat(runs, long_groups), digits))


def both_spellings(digits: Column) -> Column:
    """An array of strings of digits, each with its leading zeros and without."""
    plain = F.transform(digits, lambda x: F.regexp_replace(x, r"^0+", ""))
    return F.filter(F.array_distinct(F.concat(digits, plain)), lambda x: F.length(x) > 0)


def deletions(code: Column, edits: int) -> Column:
    """All strings that are ``code`` with up to ``edits`` characters deleted."""
    out = level = F.array(code)
    for _ in range(edits):
        one = lambda c: F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.concat(F.substr(c, F.lit(1), i - 1), F.substr(c, i + 1)))
        level = F.array_distinct(F.flatten(F.transform(F.filter(level, lambda c: F.length(c) > 0), one)))
        out = F.array_union(out, level)
    return out


def _distance(edits: int):  # noqa: ANN202
    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([weighted_edits(x, y, edits) for x, y in zip(a, b)], dtype="float64")

    return run.asNondeterministic()  # or the test on its result is moved before the distinct pairs and it runs on all


def may_be_near(a: Column, b: Column, edits: int) -> Column:
    """Whether two strings can be within ``edits`` edits, exchanged neighbours included: a built-in test that is never too strict.

    An exchange of neighbours counts two in the built-in distance, so that a pair beyond
    ``edits`` there must have two neighbours of one in the other order in the other.
    """
    plain = F.levenshtein(a, b, 2 * edits)
    pair = lambda i: F.substr(a, i, F.lit(2))
    exchanged = F.exists(F.sequence(F.lit(1), F.greatest(F.length(a) - 1, F.lit(1))), lambda i: (F.reverse(pair(i)) != pair(i)) & F.contains(b, F.reverse(pair(i))))
    return (plain >= 0) & ((plain <= edits) | exchanged)


def neighbours(typed: DataFrame, listed: DataFrame, max_edits: int, broadcast_entries: int) -> DataFrame:
    """(code, entry, distance): pairs of distinct codes within the bound."""
    entries = listed.select(F.col("code").alias("entry")).distinct()
    parts = entries.select("entry", F.explode(deletions(F.col("entry"), max_edits)).alias("part"))
    asked = typed.select("code").distinct().select("code", F.explode(deletions(F.col("code"), max_edits)).alias("part"))
    dictionary = F.broadcast(parts) if entries.limit(broadcast_entries + 1).count() <= broadcast_entries else parts
    # few and small, but costly: one partition for each core at least
    pairs = by_key(asked.join(dictionary, "part").select("code", "entry").where(may_be_near(F.col("code"), F.col("entry"), max_edits)), "code", "entry").distinct()
    return pairs.withColumn("distance", _distance(max_edits)(F.col("code"), F.col("entry"))).where("distance is not null")


#: Codes up to which the dictionary is broadcast: with one deletion in up to eleven figures under 800,000 short strings, some 60 MB.
BROADCAST_CODES = 65_536


def match_references(
    rows: DataFrame, listed: DataFrame, *, row_id: str, value: str, name: str, key: str, owner: str, max_edits: int = 1, broadcast_entries: int = BROADCAST_CODES,
) -> DataFrame:
    """(row_id, value, key, distance) of every row whose value is not null and not exactly a listed key.

    ``key`` is null where nothing in the list is meant.
    """
    rows = rows.where(F.col(value).isNotNull()).select(F.col(row_id).alias("row_id"), F.col(value).alias("value"), name_bigrams(F.col(name)).alias("name"))
    values = rows.groupBy("value").agg(F.count(F.lit(1)).alias("rows"))
    entries = (
        listed.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.max(F.col(owner)).alias("owner"))
        .join(values.withColumnRenamed("value", "key"), "key", "left")
        .select("key", F.coalesce("rows", F.lit(0)).alias("uses"), name_bigrams(F.col("owner")).alias("owner"), F.explode_outer(both_spellings(F.array(F.regexp_replace("key", r"\D", "")))).alias("code"))
    )
    dirty = values.join(listed.select(F.col(key).alias("value")).distinct(), "value", "left_anti")
    typed = dirty.select("value", F.explode(codes(F.col("value"), 9)).alias("code"))
    entries = entries.where("code is not null")
    near = neighbours(typed, entries, max_edits, broadcast_entries)
    meant = (
        typed.join(near, "code").join(entries.withColumnRenamed("code", "entry"), "entry")
        .groupBy("value").agg(F.collect_set(F.struct("distance", "key", "owner", "uses")).alias("meant"))
    )
    state = dirty.join(meant, "value", "left")
    joined = join_hot(rows, state, ["value"], count="rows", total=about_rows(rows), spread_by=["row_id"], hot_rows=50_000)
    alike = F.transform(
        "meant",
        lambda m: F.struct(m["distance"].alias("distance"), (-F.coalesce(overlap(m["owner"], F.col("name")), F.lit(NAME_AGREES))).alias("unlike"), (-m["uses"]).alias("unused"), m["key"].alias("key")),
    )
    best = F.array_min(F.filter(alike, lambda m: (m["distance"] == 0) | (m["unlike"] <= -NAME_AGREES)))
    return joined.withColumn("best", best).select("row_id", "value", F.col("best.key").alias("key"), F.col("best.distance").alias("distance"))


def misses(matched: DataFrame) -> DataFrame:
    """Typed values that mean no entry, with the number of their rows."""
    return matched.where("key is null").groupBy("value").agg(F.count(F.lit(1)).alias("n_rows"))
