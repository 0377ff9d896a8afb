"""Citable values: fields by path, citations, packs and their integrity.

Documents are unpivoted into fields (document_id, field_path, value); a citation is a join
of a request with the field of that path, so that an absent field is a row that says so.

Defined cases: a path that is not there, of an unknown document, or malformed gives a
citation with ``present`` false and the note of its absence; a field that is there but null
is present with a null value; of a document delivered more than once the first delivery
counts; a null confidence is not counted; repeated requests give repeated citations; a pack
without items does not exist; a hot document's requests are salted.
"""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyfold.functions.text import valid_path
from tallyfold.operators.skew import about_rows, join_hot

ABSENT = "field absent from source document"


def as_value(column: Column, kind: T.DataType) -> Column:
    """A field's value as text; figures without trailing zeros."""
    if isinstance(kind, T.DoubleType):
        plain = column.cast("string").try_cast("decimal(24,6)").cast("string")
        return F.regexp_replace(F.regexp_replace(plain, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return column.cast("string")


def _leaves(kind: T.StructType, at: Column | None, path: Column | None) -> list[Column]:
    """struct(field_path, value) of the scalar fields below; objects that are null have none."""
    out = []
    for f in kind.fields:
        here = F.col(f"`{f.name}`") if at is None else at[f.name]
        name = F.lit(f.name) if path is None else F.concat(path, F.lit(f".{f.name}"))
        if isinstance(f.dataType, T.StructType):
            inner = _leaves(f.dataType, here, name)
            out += [F.when(here.isNotNull(), x) for x in inner]
        elif not isinstance(f.dataType, (T.ArrayType, T.MapType)):
            out.append(F.struct(name.alias("field_path"), as_value(here, f.dataType).alias("value")))
    return out


def _item_leaves(kind: T.StructType, name: str):  # noqa: ANN202
    return lambda x, i: F.array(*_leaves(kind, x, F.concat(F.lit(f"{name}["), i.cast("string"), F.lit("]"))))


def fields(df: DataFrame, keys: list[str], wanted: str | None = None) -> DataFrame:
    """(*keys, field_path, value): every scalar field of every document, items of arrays by index from 0.

    wanted: an array column of paths; of each document only its fields of these paths are given.
    """
    schema = T.StructType([f for f in df.schema.fields if f.name not in (*keys, wanted)])
    parts = F.array(*_leaves(schema, None, None))
    for f in schema.fields:
        if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType):
            kind, name = f.dataType.elementType, f.name
            items = F.transform(F.coalesce(F.col(name), F.array().cast(f.dataType)), _item_leaves(kind, name))
            parts = F.concat(parts, F.flatten(items))
    kept = lambda p: p.isNotNull() if wanted is None else p.isNotNull() & F.array_contains(wanted, p["field_path"])
    return df.select(*keys, F.explode(F.filter(parts, kept)).alias("f")).select(*keys, "f.field_path", "f.value")


def cite(requests: DataFrame, of_fields: DataFrame, positions: DataFrame | None = None, *, default_document: str | None = None, strict: bool = False) -> DataFrame:
    """Citations for requests (…, document_id, field_path, …): adds present, value, and note where absent.

    of_fields: (document_id, field_path, value), one row per path; positions: (document_id,
    field_path, page, bounding_box) fills page and box where the request has none.
    default_document: the document that is meant where a request names none; strict: an absent
    field ends the query with an error instead of being a row that says so.
    """
    if default_document is not None:
        requests = requests.withColumn("document_id", F.coalesce("document_id", F.lit(default_document)))
    key = ["document_id", "field_path"]
    counted = requests.where("document_id is not null and field_path is not null").groupBy(*key).agg(F.count(F.lit(1)).alias("asked"))
    state = counted.join(of_fields.withColumn("present", F.lit(True)), key, "left")
    if positions is not None:
        state = state.join(positions.select(*key, F.col("page").alias("at_page"), F.col("bounding_box").alias("at_box")), key, "left")
    spread_by = [c for c in requests.columns if c not in key][:2] or key
    found = join_hot(requests, state, key, count="asked", total=about_rows(requests), spread_by=spread_by, how="left", counts=counted)
    present = F.coalesce(F.col("present"), F.lit(False)) & F.coalesce(valid_path(F.col("field_path")), F.lit(False))
    out = found.withColumns({"present": present, "value": F.when(present, F.col("value"))})
    if strict:
        missing = F.concat(F.lit("no field "), F.coalesce("field_path", F.lit("?")), F.lit(" in document "), F.coalesce("document_id", F.lit("?")))
        out = out.withColumn("present", F.when(F.col("present"), True).otherwise(F.raise_error(missing).cast("boolean")))
        present = F.col("present")
    note = F.col("note") if "note" in requests.columns else F.lit(None).cast("string")
    out = out.withColumn("note", F.when(present, note).otherwise(F.lit(ABSENT)))
    if positions is not None:
        out = out.withColumns({"page": F.coalesce("page", "at_page") if "page" in requests.columns else F.col("at_page"), "bounding_box": F.coalesce("bounding_box", "at_box") if "bounding_box" in requests.columns else F.col("at_box")}).drop("at_page", "at_box")
    return out


ITEM = ("source_system", "document_id", "document_type", "field_path", "value", "confidence", "page", "bounding_box", "note")


def canonical(item: Column) -> Column:
    """The spelling of an item that the hash covers: its fields by name, nulls as null."""
    text = lambda c: F.coalesce(F.concat(F.lit('"'), F.replace(F.replace(c.cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"')), F.lit("null"))
    number = lambda c: F.coalesce(c.cast("string").try_cast("decimal(24,6)").cast("string"), F.lit("null"))
    box = item["bounding_box"]
    corners = F.when(box.isNull(), F.lit("null")).otherwise(F.concat(F.lit("["), F.concat_ws(",", *(number(box[c]) for c in ("x0", "y0", "x1", "y1"))), F.lit("]")))
    parts = [("bounding_box", corners), ("confidence", number(item["confidence"])), ("document_id", text(item["document_id"])), ("document_type", text(item["document_type"])), ("field_path", text(item["field_path"])),
             ("note", text(item["note"])), ("page", F.coalesce(item["page"].cast("string"), F.lit("null"))), ("source_system", text(item["source_system"])), ("value", text(item["value"]))]
    return F.concat(F.lit("{"), F.concat_ws(",", *(F.concat(F.lit(f'"{n}":'), v) for n, v in parts)), F.lit("}"))


def packs(citations: DataFrame, pack_id: str = "pack_id", ord_: str = "ord") -> DataFrame:
    """One row per pack: items in order of citation, documents as first seen, sources, weakest confidence, integrity hash.

    Neither the time of packing nor a random id belongs here; add them where a pack is written.
    """
    item = F.struct(*(F.col(c) for c in ITEM))
    grouped = citations.groupBy(F.col(pack_id).alias("pack_id")).agg(F.array_sort(F.collect_list(F.struct(F.col(ord_).alias("o"), canonical(item).alias("c"), item.alias("i")))).alias("all"))
    items = F.transform("all", lambda x: x["i"])
    return grouped.select(
        "pack_id", items.alias("items"), F.array_distinct(F.filter(F.transform("all", lambda x: x["i"]["document_id"]), lambda d: d.isNotNull())).alias("documents"),
        F.array_sort(F.array_distinct(F.filter(F.transform("all", lambda x: x["i"]["source_system"]), lambda d: d.isNotNull()))).alias("sources"),
        F.array_min(F.filter(F.transform("all", lambda x: x["i"]["confidence"]), lambda c: c.isNotNull() & ~F.isnan(c))).alias("weakest_confidence"),
        F.size("all").alias("n_items"), F.size(F.filter("all", lambda x: x["i"]["bounding_box"].isNotNull())).alias("n_located"),
        F.left(F.sha2(F.concat(F.lit("["), F.array_join(F.transform("all", lambda x: x["c"]), ","), F.lit("]")), 256), F.lit(16)).alias("integrity_hash"),
    )


def json_hashed(of_packs: DataFrame) -> DataFrame:
    """(pack_id, integrity_hash): the first 16 hexadecimal digits of the SHA-256 of the items as JSON.

    The spelling is that of Python's json module with sorted names and its own separators, so
    that a hash made elsewhere from the same items can be compared byte by byte.
    """

    @F.pandas_udf("string")
    def hashed(items: pd.Series) -> pd.Series:
        def plain(i: dict) -> dict:
            box = i["bounding_box"]
            return {**i, "bounding_box": None if box is None else [box[c] for c in ("x0", "y0", "x1", "y1")]}

        number = lambda x: None if x is None else int(x)
        return pd.Series([hashlib.sha256(json.dumps([{**plain(i), "page": number(i["page"])} for i in pack], sort_keys=True).encode()).hexdigest()[:16] for pack in items], dtype="str")

    return of_packs.select("pack_id", hashed("items").alias("integrity_hash"))


def stamped(of_packs: DataFrame, conclusion: str | None = None) -> DataFrame:
    """Packs as written: with a random id, the time, and the conclusion; not reproducible by nature."""
    return of_packs.withColumns({"pack_id": F.concat(F.lit("EP-"), F.left(F.replace(F.uuid(), F.lit("-"), F.lit("")), F.lit(10))), "created_at": F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX"), "conclusion": F.lit(conclusion).cast("string")})


def described(citations: DataFrame) -> Column:
    """One citation as a line of text."""
    c = F.col("confidence")
    conf = F.when(c.isNotNull(), F.concat(F.lit("  (conf "), F.coalesce(c.cast("string").try_cast("decimal(18,2)").cast("string"), F.lit("null")), F.lit(")"))).otherwise(F.lit(""))
    return F.concat(F.col("source_system"), F.lit("/"), F.col("document_id"), F.lit("  "), F.col("field_path"), F.lit(" = "), F.coalesce("value", F.lit("None")), conf)
