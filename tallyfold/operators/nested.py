"""Deeply nested semi-structured records as flat tables with parent-child links.

A record is parsed once, bottom-up: as soon as an object is complete it is canonicalised
(fields by name, figures in one spelling, nested objects replaced by their identities) and
hashed, so that equal subtrees have equal identities (Merkle hashes) wherever they stand.
Distinct objects are stored once, in bodies that hold the identities of what is nested in
them; each place where a child stands is a row of the bridge with its record, its parent and
its ordinal. The flat tables are the bridge joined with the objects: one shuffle by identity,
to which both come from the same parse; identities that stand in many places are salted.

Defined cases: a null, blank, foreign or cut-off text has a row in ``records`` with its
status and no children; white space, byte order marks and other invisible marks around a
text are ignored; null elements and objects without fields are no children, nor are objects
that only hold others together (numbered maps, groups with ``items``, pages); a single
object in place of a list is a list of one; JSON kept as text inside a record is read as
part of it, at any depth; a key that is repeated in one object counts each time; figures of
any length and records of any depth are read; repeated records give repeated rows under
their own ids.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from json.decoder import scanstring
from json.scanner import NUMBER_RE

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Fields whose objects become child rows; those of the second kind hang below the nearest child of the first.
CHILDREN = ("lines", "totals", "rate_schedule")
GRANDCHILDREN = ("allocations",)
#: Arrays and maps of objects that only hold others together.
HOLDERS = ("items", "pages", "documents", "groups", "entries")
MARKS = " \t\r\n\v\f\0 ​‌‍⁠﻿"
#: An identity that stands in many places is spread over this many tasks.
SALTS = 32
#: Identities a task remembers as written; it may write one again after that, and equal rows are merged.
REMEMBERED = 200_000

_quoted = json.encoder.encode_basestring_ascii


class Figure(str):
    """A whole number too long to be worth computing with, as its digits."""


class Object:
    """A complete object: its fields as written, its canonical body, and the hash of that."""

    __slots__ = ("pairs", "body", "id")

    def __init__(self, pairs: list[tuple[str, object]], nested: list[tuple[str, str, int]]) -> None:
        self.pairs = pairs
        self.body = "{" + ",".join([f"{_quoted(k)}:{_token(v, nested)}" for k, v in sorted(pairs, key=_name)]) + "}"
        self.id = _hash(self.body)
        nested.append((self.id, self.body, len(pairs)))


class Array(list):
    """An array with its token, where recursion would be too deep to find it later."""

    __slots__ = ("token",)


_NESTED = (Object, list, Array)


def _name(pair: tuple[str, object]) -> str:
    return pair[0]


def _hash(text: str) -> str:
    return hashlib.blake2b(text.encode(), digest_size=16).hexdigest()


def _token(value: object, nested: list[tuple[str, str, int]]) -> str:
    """Canonical spelling of a value inside its parent."""
    kind = type(value)
    if kind is str:
        return _quoted(value)
    if kind is Object:
        return f'{{"#":"{value.id}"}}'
    if kind is float:
        return str(int(value)) if value.is_integer() and abs(value) < 1e15 else json.dumps(value)  # 24.0 and 24 are one figure
    if kind is int or kind is Figure:
        return str(value)
    if kind is list:
        return "[" + ",".join([_element(v, nested) for v in value]) + "]"
    return value.token if kind is Array else json.dumps(value)


def _element(value: object, nested: list[tuple[str, str, int]]) -> str:
    """As _token, but an array inside an array is stored on its own, so that no spelling grows with the depth."""
    token = _token(value, nested)
    if isinstance(value, list):
        own = _hash(token)
        nested.append((own, token, 0))
        return f'{{"[":"{own}"}}'
    return token


def _whole(digits: str) -> int | Figure:
    return int(digits) if len(digits) < 4000 else Figure(digits)


_BLANKS = re.compile(r"[ \t\n\r]*")
_WORDS = {"true": True, "false": False, "null": None, "NaN": float("nan"), "Infinity": float("inf"), "-Infinity": float("-inf")}
_WORD = re.compile(r"true|false|null|NaN|-?Infinity")


def _deep(s: str, nested: list[tuple[str, str, int]]) -> object:
    """Parser with a stack of its own, for records nested deeper than recursion goes."""

    def blank(i: int) -> int:
        return _BLANKS.match(s, i).end()

    def key(i: int) -> tuple[str, int]:
        if s[i : i + 1] != '"':
            raise ValueError("a name is missing")
        name, i = scanstring(s, i + 1, True)
        i = blank(i)
        if s[i : i + 1] != ":":
            raise ValueError("a colon is missing")
        return name, blank(i + 1)

    def closed(is_object: bool, items: list) -> object:
        if is_object:
            return Object(items, nested)
        array = Array(items)
        array.token = "[" + ",".join([_element(v, nested) for v in items]) + "]"
        return array

    stack: list[list] = []  # [whether an object, items, name of the next]
    i = blank(0)
    while True:
        c = s[i : i + 1]
        if c == "{" or c == "[":
            i = blank(i + 1)
            if s[i : i + 1] != ("}" if c == "{" else "]"):
                stack.append([c == "{", [], None])
                if c == "{":
                    stack[-1][2], i = key(i)
                continue
            value, i = closed(c == "{", []), i + 1
        elif c == '"':
            value, i = scanstring(s, i + 1, True)
        elif m := NUMBER_RE.match(s, i):
            whole, fraction, power = m.groups()
            value, i = (float(m.group()) if fraction or power else _whole(whole)), m.end()
        elif m := _WORD.match(s, i):
            value, i = _WORDS[m.group()], m.end()
        else:
            raise ValueError("a value is missing")
        while True:
            i = blank(i)
            if not stack:
                if i != len(s):
                    raise ValueError("text after the end")
                return value
            top = stack[-1]
            top[1].append((top[2], value) if top[0] else value)
            c, i = s[i : i + 1], i + 1
            if c == ",":
                i = blank(i)
                if top[0]:
                    top[2], i = key(i)
                break
            if c != ("}" if top[0] else "]"):
                raise ValueError("not closed")
            stack.pop()
            value = closed(top[0], top[1])


def parse(text: str, nested: list[tuple[str, str, int]]) -> object:
    """The value of a JSON text; every object in it is added to ``nested`` as (identity, body, number of fields)."""
    start = len(nested)

    def fast(**how: Callable) -> object:
        value = json.loads(text, object_pairs_hook=lambda pairs: Object(pairs, nested), **how)
        if isinstance(value, list):
            value = Array(value)
            value.token = _token(list(value), nested)
        return value

    try:
        return fast()
    except json.JSONDecodeError:
        del nested[start:]
        raise
    except RecursionError:
        pass
    except ValueError:  # a figure longer than int() takes
        del nested[start:]
        try:
            return fast(parse_int=_whole)
        except RecursionError:
            pass
    del nested[start:]
    return _deep(text, nested)


def identity(text: str) -> str:
    """Merkle identity of a JSON text."""
    value = parse(text, [])
    return value.id if isinstance(value, Object) else _hash(_token(value, []))


def _may_hold(value: object) -> bool:
    return isinstance(value, _NESTED) or (type(value) is str and value.lstrip(MARKS)[:1] in ("{", "["))


def _embedded(value: object, nested: list[tuple[str, str, int]]) -> object:
    """What a sender kept as JSON text inside a record, or the value itself."""
    if type(value) is str:
        start = len(nested)
        try:
            return parse(value.strip(MARKS), nested)
        except ValueError:
            del nested[start:]
    return value


def _holds_only(value: Object, name: str) -> bool:
    """Whether an object in the place of a child only holds others together."""
    return all(k.isascii() and k.isdigit() for k, _ in value.pairs) or any(k == name or k in HOLDERS for k, v in value.pairs if isinstance(v, _NESTED))


def _printed(path: tuple | None) -> str:
    parts = []
    while path:
        path, step = path
        parts.append(f"[{step}]" if isinstance(step, int) else f".{step}")
    return "$" + "".join(reversed(parts))


_ANYWHERE, _CHILD, _BELOW, _GRANDCHILD = range(4)


def walk(root: object, root_id: str, nested: list[tuple[str, str, int]]) -> list[tuple]:
    """(child, parent_ord, ord, path, node_id, parent_id) of all children of a record, in written order."""
    rows: list[tuple] = []
    ords = dict.fromkeys(CHILDREN, 0)
    stack: list[tuple] = [(_ANYWHERE, root, None, None, None)]
    while stack:
        mode, value, name, path, line = stack.pop()
        value = _embedded(value, nested)
        kind = type(value)
        if kind is Object:
            if mode == _ANYWHERE:
                inner = [(_CHILD, v, k, (path, k), None) if k in CHILDREN else (_ANYWHERE, v, None, (path, k), None) for k, v in value.pairs if _may_hold(v)]
            elif mode == _BELOW:
                inner = [(_GRANDCHILD if k in GRANDCHILDREN else _BELOW, v, k, (path, k), line) for k, v in value.pairs if _may_hold(v)]
            elif not value.pairs:
                continue
            elif _holds_only(value, name):
                other = lambda k: mode == _CHILD and k in CHILDREN
                inner = [(mode, v, k if other(k) else name, (path, k), line) for k, v in value.pairs if _may_hold(v)]
            elif mode == _CHILD:
                ords[name] += 1
                rows.append((name, 0, ords[name], _printed(path), value.id, root_id))
                inner = [(_BELOW, value, None, path, [ords[name], value.id, dict.fromkeys(GRANDCHILDREN, 0)])] if name == "lines" else []
            else:
                line[2][name] += 1
                rows.append((name, line[0], line[2][name], _printed(path), value.id, line[1]))
                inner = []
        elif kind is list or kind is Array:
            inner = [(mode, v, name, (path, i), line) for i, v in enumerate(value) if _may_hold(v)]
        else:
            continue
        stack += reversed(inner)
    return rows


def shred_text(raw: str | None) -> tuple[str, str | None, list[tuple], list[tuple[str, str, int]]]:
    """(status, identity of the record, occurrences of its children, objects) of one text."""
    if raw is None or not (text := raw.strip(MARKS)):
        return "empty", None, [], []
    nested: list[tuple[str, str, int]] = []
    try:
        root = parse(text, nested)
        while isinstance(root, str) and not isinstance(root, Figure):  # the whole record sent as JSON text
            root = parse(root.strip(MARKS), nested)
    except ValueError:
        return ("cut_off" if text[0] in "{[" else "foreign"), None, [], []
    if not isinstance(root, _NESTED):
        return "foreign", None, [], []
    if isinstance(root, Object):
        own = root.id
    else:
        own = _hash(root.token)
        nested.append((own, root.token, 0))
    return "ok", own, walk(root, own, nested), nested


NODE_SCHEMA = (
    "role string, salt int, record_id bigint, status string, child string, parent_ord int, ord int, path string, "
    "node_id string, parent_id string, fields int, body string"
)
_NODES = pa.schema([
    ("role", pa.string()), ("salt", pa.int32()), ("record_id", pa.int64()), ("status", pa.string()), ("child", pa.string()), ("parent_ord", pa.int32()), ("ord", pa.int32()),
    ("path", pa.string()), ("node_id", pa.string()), ("parent_id", pa.string()), ("fields", pa.int32()), ("body", pa.string()),
])


def shred(df: DataFrame, record_id: str = "record_id", raw: str = "raw") -> DataFrame:
    """Rows of three roles: ``record``, ``place`` (one per occurrence of a child) and ``object`` (distinct ones)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        written: set[tuple[str, int]] = set()
        for batch in batches:
            out: list[list] = [[] for _ in _NODES]
            rows: list[tuple] = []
            for rid, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                salt = (rid or 0) % SALTS
                status, own, places, nested = shred_text(text)
                rows.append(("record", salt, rid, status, None, 0, 0, "$", own, None, None, None))
                rows += [("place", salt, rid, status, *p, None, None) for p in places]
                for node, body, fields in nested:
                    if (node, salt) not in written:
                        if len(written) >= REMEMBERED:
                            written.clear()
                        written.add((node, salt))
                        rows.append(("object", salt, None, None, None, None, None, None, node, None, fields, body))
            out = list(zip(*rows)) if rows else [[] for _ in _NODES]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, _NODES)], schema=_NODES)

    return df.select(F.col(record_id).cast("bigint").alias("record_id"), F.col(raw).cast("string").alias("raw")).mapInArrow(run, NODE_SCHEMA)


def records(nodes: DataFrame) -> DataFrame:
    """(record_id, status, node_id): one row per record."""
    return nodes.where("role = 'record'").select("record_id", "status", "node_id")


def bridge(nodes: DataFrame) -> DataFrame:
    """(record_id, child, parent_ord, ord, path, node_id, parent_id): one row per place of an object."""
    return nodes.where("role = 'place'").select("record_id", "child", "parent_ord", "ord", "path", "node_id", "parent_id")


def objects(nodes: DataFrame) -> DataFrame:
    """(node_id, body, fields, places): every distinct object once, and in how many places of the bridge it stands."""
    return nodes.where("role <> 'record'").groupBy("node_id").agg(F.max("body").alias("body"), F.max("fields").alias("fields"), F.count_if(F.col("role") == "place").alias("places"))


def _known(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows of other roles joined with the object of their ``key``: the object stands first among the rows of its identity and salt."""
    w = Window.partitionBy(key, "salt").orderBy(F.col("role") != "object").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumns({c: F.first(c, ignorenulls=True).over(w) for c in columns}).where("role <> 'object'")


def children(nodes: DataFrame, kinds: tuple[str, ...] = (*CHILDREN, *GRANDCHILDREN)) -> DataFrame:
    """The bridge joined with the objects: places of objects that have fields, with ``fields`` and ``body``."""
    return _known(nodes.where((F.col("role") == "object") | ((F.col("role") == "place") & F.col("child").isin(*kinds))), "node_id", ["fields", "body"]).where("fields > 0")


def _text(name: str, body: str = "body") -> str:
    return f"get_json_object({body}, '$.{name}')"


def _figure(name: str, body: str = "body") -> str:
    """A figure that may be written as text, with a currency and thousands separators."""
    return rf"try_cast(regexp_replace(regexp_replace({_text(name, body)}, '^[^0-9(-]+', ''), '[, ]', '') as double)"


#: Columns of the flat tables by kind of child.
FLAT: dict[str, dict[str, str]] = {
    "lines": {
        "line_number": f"try_cast({_text('line_number')} as int)", "description": _text("description"), "unit_of_measure": _text("unit_of_measure"),
        "quantity": _figure("quantity"), "unit_price": _figure("unit_price"), "net_amount": _figure("net_amount"),
        "tax_rate": f"coalesce({_figure('tax_rate')}, {_figure('rate', 'tax_body')})", "tax_amount": f"coalesce({_figure('tax_amount')}, {_figure('amount', 'tax_body')})",
        "line_total": _figure("line_total"),
    },
    "totals": {"subtotal": _figure("subtotal"), "tax_total": _figure("tax_total"), "grand_total": _figure("grand_total"), "currency": _text("currency")},
    "rate_schedule": {"description": _text("description"), "unit_of_measure": _text("unit_of_measure"), "max_unit_price": _figure("max_unit_price")},
    "allocations": {"site": _text("site"), "quantity": _figure("quantity")},
}


def flat(nodes: DataFrame, child: str) -> DataFrame:
    """Typed flat table of one kind of child, with its record and parent ordinals.

    The tax of a line may be an object of its own; its body is fetched by its identity.
    """
    rows = children(nodes, (child,))
    if child == "lines":
        tax = F.get_json_object("body", "$.tax['#']")
        asked = rows.withColumn("tax_id", F.coalesce(tax, F.concat_ws("/", "record_id", "ord")))
        known = nodes.where("role = 'object'").select("role", "salt", F.col("node_id").alias("tax_id"), F.col("body").alias("tax_body"))
        rows = _known(asked.unionByName(known, allowMissingColumns=True), "tax_id", ["tax_body"])
    return rows.selectExpr("record_id", "parent_ord", "ord", "node_id", "parent_id", *(f"{e} as {n}" for n, e in FLAT[child].items()))


def rebuilt(root: str, bodies: Callable[[str], str]) -> object:
    """A record's value put together again from the bodies of its objects; repeated keys as lists of pairs."""

    def value(x: object) -> object:
        if isinstance(x, list) and x and isinstance(x[0], tuple):
            if len(x) == 1 and x[0][0] in ("#", "["):
                return value(load(x[0][1]))
            pairs = [(k, value(v)) for k, v in x]
            return dict(pairs) if len(dict(pairs)) == len(pairs) else pairs
        return [value(v) for v in x] if isinstance(x, list) else x

    def load(node: str) -> object:
        return json.loads(bodies(node), object_pairs_hook=lambda pairs: pairs or {})

    return value(load(root))
