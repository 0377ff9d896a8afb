"""Column-level data quality profile.

Tables are unpivoted into cells (table, column, load, value); equal values are counted before
anything else, and null rates, distinct counts, ranges, pattern violations and the change of
distribution between loads all come from those exact counts. Fields of structs and of arrays
of structs are columns like any other.

Defined cases: a null cell is counted and never violates a form; a NaN is a value, out of
every range; a null load is no load (its rows count in the whole column only), and so are all
rows of a table without loads; a load without valid values has no distribution and hence no
shift; a null or empty array has no cells but for its length, a null object in an array has
null ones; an empty table has no profile rows; columns are named in the call, so further
columns do no harm.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass
class Form:
    """valid: SQL condition on ``value``; bin: SQL expression on ``value`` giving the category of a valid value."""

    valid: str
    bin: str = "value"


PAYMENT_TERMS = Form(r"value rlike '\\ANet ([1-9]|[1-9][0-9]|1[01][0-9]|120)\\z'")
PO_KEY = Form(r"value rlike '\\APO-[0-9]{11}\\z'")
UNIT_INTERVAL = Form("try_cast(value as double) between 0 and 1", "cast(least(floor(try_cast(value as double) * 10), 9) as string)")

#: Columns whose findings are asked for: (table, column) -> form
FORMS = {
    ("invoices", "payment_terms"): PAYMENT_TERMS,
    ("purchase_orders", "payment_terms"): PAYMENT_TERMS,
    ("invoices", "po_reference"): PO_KEY,
    ("evidence_items", "confidence"): UNIT_INTERVAL,
}


@dataclass
class Leaf:
    """A column that is profiled: its dotted name (``[]`` for the items of an array), its value as SQL text, and whether it is a number."""

    name: str
    value: str
    number: bool


def _split(kind: T.DataType, name: str, path: str) -> tuple[list[Leaf], list[tuple[str, str, T.DataType]]]:
    """Scalar leaves of a value, fields of structs by dotted name and arrays by their length, and the arrays (name, path, type of items)."""
    if isinstance(kind, T.StructType):
        parts = [_split(f.dataType, f"{name}.{f.name}", f"{path}.`{f.name}`") for f in kind.fields]
        return [x for p, _ in parts for x in p], [x for _, p in parts for x in p]
    if isinstance(kind, (T.ArrayType, T.MapType)):
        return [Leaf(name, f"cast(if({path} is null, null, size({path})) as string)", True)], [(f"{name}[]", path, kind.elementType)] if isinstance(kind, T.ArrayType) else []
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return [Leaf(name, f"cast(unix_micros(cast({path} as timestamp)) as string)", True)], []
    return [Leaf(name, f"cast({path} as string)", isinstance(kind, T.NumericType))], []


def all_cells(df: DataFrame, table: str, leave_out: tuple[str, ...] = (), load: str | None = "load_id", *, load_too: bool = False) -> DataFrame:
    """Unpivot of all leaves: (table_name, column_name, load_id, value, number) with every value as a string.

    Times count as numbers (microseconds). The items of each array are unpivoted in a pass of their own.
    The column of the load is unpivoted like the others only with ``load_too``.
    """
    without = leave_out if load_too else (load, *leave_out)
    parts: list[DataFrame] = []

    def unpivot(rows: DataFrame, leaves: list[Leaf], arrays: list[tuple[str, str, T.DataType]]) -> None:
        if leaves:
            cells_ = ", ".join(f"'{x.name}', {x.value}, {str(x.number).lower()}" for x in leaves)
            parts.append(rows.select("load_id", F.expr(f"stack({len(leaves)}, {cells_}) as (column_name, value, number)")))
        for name, path, kind in arrays:
            unpivot(rows.select("load_id", F.expr(f"explode({path}) as item")), *_split(kind, name, "item"))

    rows = df.select((F.col(load) if load else F.lit(None)).cast("int").alias("load_id"), F.struct(*(F.col(f"`{c}`") for c in df.columns if c not in without)).alias("row"))
    fields = [_split(f.dataType, f.name, f"row.`{f.name}`") for f in rows.schema["row"].dataType.fields]
    unpivot(rows, [x for p, _ in fields for x in p], [x for _, p in fields for x in p])
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(F.lit(table).alias("table_name"), "column_name", "load_id", "value", "number")


def cells(df: DataFrame, table: str, columns: list[tuple[str, str]], row_id: str = "row_id", load: str = "load_id") -> DataFrame:
    """Unpivot of scalar columns: (table_name, column_name, load_id, row_id, value) with every value as a string."""
    pairs = ", ".join(f"'{name}', cast({path} as string)" for name, path in columns)
    return df.select(
        F.lit(table).alias("table_name"),
        F.col(load).cast("int").alias("load_id"),
        F.col(row_id).cast("bigint").alias("row_id"),
        F.expr(f"stack({len(columns)}, {pairs}) as (column_name, value)"),
    ).select("table_name", "column_name", "load_id", "row_id", "value")


def value_counts(unpivoted: DataFrame) -> DataFrame:
    """(table_name, column_name, load_id, value, number, n); counted map-side first."""
    keys = [c for c in ("table_name", "column_name", "load_id", "value", "number") if c in unpivoted.columns]
    return unpivoted.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def _by_column(pick: str, forms: dict[tuple[str, str], Form], default: Column) -> Column:
    out = default
    for (table, column), form in forms.items():
        out = F.when((F.col("table_name") == table) & (F.col("column_name") == column), F.expr(getattr(form, pick))).otherwise(out)
    return out


def with_validity(rows: DataFrame, forms: dict[tuple[str, str], Form]) -> DataFrame:
    """Adds ``valid`` (null for a null value) and ``bin``, the category of a valid value."""
    valid = F.when(F.col("value").isNotNull(), F.coalesce(_by_column("valid", forms, F.lit(True)), F.lit(False)))
    return rows.withColumn("valid", valid).withColumn("bin", F.when(F.col("valid"), _by_column("bin", forms, F.col("value"))))


#: Values by which a column is compared one by one; beyond, those with this share of its rows; ranges and buckets for the rest.
MOST_VALUES, OWN_SHARE, RANGES = 100, 0.01, 10


def form_of(text: Column) -> Column:
    """What a text looks like: runs of letters and of figures as one sign each."""
    return F.regexp_replace(F.regexp_replace(text, r"\p{L}+", "a"), r"[0-9]+", "9")


#: Values of a column that are followed by a sketch of its frequent ones, and how many of those may stand for themselves: all that have the share, and all of a column with few.
TRACKED, FOLLOWED = 2_048, 150


def categories(marked: DataFrame) -> DataFrame:
    """Valid cells counted by (table_name, column_name, load_id, bin), the category by which loads are compared.

    A column of at most ``MOST_VALUES`` values is compared value by value. In a wider one,
    values with ``OWN_SHARE`` of the rows stand for themselves; other numbers fall into
    ``RANGES`` of equal width between the least and the greatest, other texts into sixteen
    buckets by a hash of their form.

    A first pass finds the range of each column and, by a sketch, at most ``FOLLOWED`` values
    that may be frequent: the sketch of ``TRACKED`` items can't miss one with the share, or
    any of a column with few values. A second pass counts these values and the categories
    exactly, and the exact counts decide. What is shuffled are counts of categories, and what
    is broadcast is one row a column and at most ``FOLLOWED`` values of each.
    """
    col = ["table_name", "column_name"]
    valid = marked.where("valid")
    finite = "try_cast(if(number, bin, null) as double)"
    finite = f"if(abs({finite}) < double('inf'), {finite}, null)"
    seen = valid.groupBy(*col).agg(F.expr(f"min({finite})").alias("least"), F.expr(f"max({finite})").alias("most"), F.expr(f"approx_top_k(bin, {FOLLOWED}, {TRACKED})").alias("top"), F.approx_count_distinct("bin").alias("about"))
    # true of every column; since both uses of it need all four figures so, they share one pass
    seen = seen.where("size(top) >= 0 and about > 0 and (least is null or least <= most)")
    follow = seen.select(*col, F.explode("top").alias("x")).select(*col, F.col("x.item").alias("bin"), F.lit(True).alias("followed"))
    # about half as many values or fewer: the sketch has them all, and none of them will need another category
    wide = seen.select(*col, "least", "most", (F.col("about") > MOST_VALUES // 2).alias("wide"))
    placed = valid.join(F.broadcast(wide), col).join(F.broadcast(follow), [*col, "bin"], "left")
    width = (F.col("most") - F.col("least")) / RANGES
    value = F.expr(finite)
    slot = F.when(value.isNull(), F.lit("none")).when(width > 0, F.least(F.floor((value - F.col("least")) / width), F.lit(RANGES - 1)).cast("string")).otherwise(F.lit("0"))
    other = F.when(F.col("number"), F.concat(F.lit("range "), slot)).otherwise(F.concat(F.lit("form "), F.left(F.md5(form_of(F.col("bin"))), F.lit(1))))
    counts = placed.select(*col, "load_id", F.when(F.col("followed"), F.col("bin")).alias("own"), F.when(F.col("wide"), other).alias("other")).groupBy(*col, "load_id", "own", "other").agg(F.count(F.lit(1)).alias("n"))
    whole, same = Window.partitionBy(*col), Window.partitionBy(*col, "own")
    first = F.row_number().over(same.orderBy("load_id", "other")) == 1
    known = counts.repartition(*(F.col(c) for c in col)).withColumns({
        "few": (F.count_if(F.col("own").isNull()).over(whole) == 0), "first": F.when(F.col("own").isNotNull() & first, 1), "share": F.sum("n").over(same) / F.sum("n").over(whole),
    }).withColumn("values", F.sum("first").over(whole))
    alone = F.col("own").isNotNull() & ((F.col("few") & (F.col("values") <= MOST_VALUES)) | (F.col("share") >= OWN_SHARE))
    return known.select(*col, "load_id", F.lit(True).alias("valid"), F.when(alone, F.col("own")).otherwise(F.col("other")).alias("bin"), "n")


def profile(counts: DataFrame) -> DataFrame:
    """Per column and load: rows, nulls, distinct values, range of texts or of numbers, lengths, violations, and the mode's share."""
    n, value = F.col("n"), F.col("value")
    text, number = F.when(~F.col("number"), value), F.when(F.col("number"), F.expr("try_cast(value as double)"))
    return counts.groupBy("table_name", "column_name", "load_id").agg(
        F.sum("n").alias("n_rows"),
        F.coalesce(F.sum(F.when(value.isNull(), n)), F.lit(0)).alias("n_nulls"),
        F.count("value").alias("n_distinct"),
        F.min(text).alias("min_text"),
        F.max(text).alias("max_text"),
        F.min(number).alias("min_number"),
        F.max(number).alias("max_number"),
        F.min(F.length(text)).alias("min_length"),
        F.max(F.length(text)).alias("max_length"),
        F.coalesce(F.sum(F.when(~F.col("valid"), n)), F.lit(0)).alias("n_violations"),
        F.max(F.when(value.isNotNull(), n)).alias("n_mode"),
    )


def shifts(counts: DataFrame, floor: float = 1e-4) -> DataFrame:
    """Per column and load: distance of its shares of valid values from those of the whole column.

    ``distance`` is half the sum of absolute differences, ``psi`` the population stability
    index with shares floored at ``floor``, ``chi2`` Pearson's statistic against the shares
    of the whole column. Categories that a load lacks enter through what the whole has left.
    Counts of (column, load, category) are few; the sums of loads, categories and columns are
    windows over them, all within one partitioning by column.
    """
    col = ["table_name", "column_name"]
    by_bin = counts.where("valid").groupBy(*col, "load_id", "bin").agg(F.sum("n").alias("n")).repartition(*(F.col(c) for c in col))
    of = lambda *keys: Window.partitionBy(*col, *keys)
    known = by_bin.withColumns({"load_total": F.sum("n").over(of("load_id")), "all_n": F.sum("n").over(of("bin")), "all_total": F.sum("n").over(of()), "loads": F.count(F.lit(1)).over(of("bin"))})
    p, q = F.col("n") / F.col("load_total"), F.col("all_n") / F.col("all_total")
    # the floored terms of absent categories: sum over all bins of (q - floor) ln(q / floor), less those present
    lone = (q - F.lit(floor)) * F.log(q / F.lit(floor))
    termed = known.withColumn("lone", lone).withColumn("lone_total", F.sum(F.col("lone") / F.col("loads")).over(of()))
    missing = F.greatest(F.lit(1.0) - F.sum(q), F.lit(0.0))
    return termed.where("load_id is not null").groupBy(*col, "load_id").agg(
        F.first("load_total").alias("n_valid"),
        ((F.sum(F.abs(p - q)) + missing) / 2).alias("distance"),
        (F.sum((p - q) * F.log(p / q)) + F.first("lone_total") - F.sum("lone")).alias("psi"),
        (F.first("load_total") * (F.sum((p - q) * (p - q) / q) + missing)).alias("chi2"),
    )


def findings(
    unpivoted: DataFrame, forms: dict[tuple[str, str], Form], *, form_only: set[str] = frozenset(), no_shift: set[str] = frozenset(),
    null_limit: float = 0.25, shift_limit: float = 0.4,
) -> DataFrame:
    """(table_name, column_name, load_id, row_id, finding): form per row; nulls and shift per load, with row_id 0.

    form_only: tables of which only the rows are examined; no_shift: columns without a distribution worth comparing.
    Violations are found in one pass over the cells, everything else in the counts of another.
    """
    marked = with_validity(unpivoted, forms)
    form = marked.where("value is not null and not valid").select("table_name", "column_name", "load_id", "row_id", F.lit("form").alias("finding"))
    kept = marked if not form_only else marked.where(~F.col("table_name").isin(*form_only))
    # po_reference and the like are not compared: that they are valid is all that is counted
    bin_ = F.col("bin") if not no_shift else F.when(~F.col("column_name").isin(*no_shift), F.col("bin"))
    counts = kept.groupBy("table_name", "column_name", "load_id", "valid", bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    load = ["table_name", "column_name", "load_id"]
    nulls = counts.where("load_id is not null").groupBy(*load).agg((F.sum(F.when(F.col("valid").isNull(), F.col("n")).otherwise(0)) / F.sum("n")).alias("share")).where(F.col("share") > null_limit)
    shift = shifts(counts.where("bin is not null")).where(F.col("distance") > shift_limit)
    found = lambda df, what: df.select(*load, F.lit(0).cast("bigint").alias("row_id"), F.lit(what).alias("finding"))
    return form.unionByName(found(nulls, "nulls")).unionByName(found(shift, "shift"))
