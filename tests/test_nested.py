import json

from hypothesis import given, settings
from hypothesis import strategies as st

from tallyfold.operators import nested

L = lambda n, **kw: {"line_number": n, **kw}


def places(raw):
    status, _, rows, _ = nested.shred_text(raw if isinstance(raw, str) or raw is None else json.dumps(raw))
    return status, [(c, p, o) for c, p, o, *_ in rows]


def test_shapes():
    two = [("lines", 0, 1), ("lines", 0, 2)]
    assert places({"lines": [L(1), None, {}, L(2)]}) == ("ok", two)
    assert places({"body": {"lines": {"2": L(2), "10": L(10)}}}) == ("ok", two)
    assert places({"lines": L(1)}) == ("ok", [("lines", 0, 1)])
    assert places({"pages": [{"lines": [L(1)]}, {"lines": [L(2)]}]}) == ("ok", two)
    assert places({"payload": json.dumps({"lines": [L(1), L(2)]})}) == ("ok", two)
    assert places({"documents": [{"lines": [L(1)]}, {"lines": [L(2)], "totals": {"subtotal": 1}}]}) == ("ok", [*two, ("totals", 0, 1)])
    assert places({"rate_schedule": [{"group": "Goods", "items": [{"description": "a"}, {"description": "b"}]}]}) == ("ok", [("rate_schedule", 0, 1), ("rate_schedule", 0, 2)])
    assert places({"rate_schedule": {"valid_from": "x", "items": [{"description": "a"}]}}) == ("ok", [("rate_schedule", 0, 1)])
    assert places({"totals": [{"subtotal": 1}, {"subtotal": 1}]}) == ("ok", [("totals", 0, 1), ("totals", 0, 2)])
    assert places({"totals": {}, "lines": None, "rate_schedule": {"items": []}}) == ("ok", [])


def test_allocations_follow_their_line():
    raw = {"lines": [L(1, allocations=[{"site": "a"}, {}, {"site": "b"}]), L(2), L(3, delivery={"allocations": [{"site": "c"}]})]}
    assert places(raw)[1] == [("lines", 0, 1), ("allocations", 1, 1), ("allocations", 1, 2), ("lines", 0, 2), ("lines", 0, 3), ("allocations", 3, 1)]


def test_unusable_texts():
    assert places(None)[0] == places("")[0] == places(" \n")[0] == "empty"
    assert places("<html>")[0] == places("null")[0] == places("3")[0] == "foreign"
    assert places('{"lines": [{"a": 1}')[0] == "cut_off"
    assert places("﻿ {\"lines\": [{\"a\": 1}]}\n")[1] == [("lines", 0, 1)]
    assert places("[" * 100000)[0] == "cut_off" and places("[1}" * 3000)[0] == "cut_off"
    assert places("[" * 300 + "]" * 300) == ("ok", [])


def test_nothing_is_lost():
    assert places('{"lines":[{"a":1}],"lines":[{"b":2},{"c":3}]}') == ("ok", [("lines", 0, 1), ("lines", 0, 2), ("lines", 0, 3)])
    assert places('{"x": ' + "9" * 5000 + ', "lines": {"a": -' + "8" * 5000 + "}}") == ("ok", [("lines", 0, 1)])
    for depth in (150, 5_000, 60_000):
        for a, b in (('{"a":', "}"), ("[", "]"), ('[{"a":', "}]")):
            assert places(a * depth + '{"lines": [{"q": 1, "allocations": [{"s": "x"}]}]}' + b * depth) == ("ok", [("lines", 0, 1), ("allocations", 1, 1)])
    assert places({"lines": [L(1, delivery=json.dumps({"allocations": [{"site": "c"}]})), L(2, allocations='[{"site": "d"}, {}]')]})[1] == [("lines", 0, 1), ("allocations", 1, 1), ("lines", 0, 2), ("allocations", 2, 1)]


def test_the_deep_parser_reads_the_same():
    for text in ('{"a": [1, -2.50, 1e3, true, null, "x\\u00e9\\n", {}, [], [[1], {"b": [[2]]}]], "a": {"c": "d"}}', " [ ] ", '"t"', "-0.0", '[1,{"a":2},[3,[4]]]'):
        one, two = [], []
        a, b = nested.parse(text, one), nested._deep(text, two)
        assert sorted(set(one)) == sorted(set(two)) and nested._token(a, []) == nested._token(b, [])
    for text in ("", "{", "[1,]", '{"a"}', '{"a":1,}', "[1 2]", "tru", '{"a":1}x', "]", '{1:2}'):
        try:
            nested._deep(text, [])
        except ValueError:
            continue
        raise AssertionError(text)


def test_a_record_is_rebuilt_from_its_objects(tiny):
    import duckdb

    for (raw,) in duckdb.sql(f"select raw from '{tiny}/raw_records.parquet'").fetchall():
        status, root, _, objects = nested.shred_text(raw)
        if status == "ok":
            value = json.loads(raw.strip(nested.MARKS))
            assert nested.rebuilt(root, {i: b for i, b, _ in objects}.__getitem__) == (json.loads(value) if isinstance(value, str) else value)
            assert not any('{"site"' in b[1:] for _, b, _ in objects)  # bodies hold identities in place of what is nested


@settings(max_examples=60)
@given(st.recursive(st.none() | st.booleans() | st.integers(-5, 5) | st.text(max_size=3), lambda c: st.lists(c, max_size=3) | st.dictionaries(st.text(max_size=3), c, max_size=3), max_leaves=12))
def test_identity_is_of_content(value):
    def shuffled(v):
        if isinstance(v, dict):
            return {k: shuffled(v[k]) for k in reversed(list(v))}
        return [shuffled(x) for x in v] if isinstance(v, list) else v

    of = lambda v: nested.identity(json.dumps(v))
    assert of(value) == of(shuffled(value))
    assert of([value, 1]) != of([value, 2])


def test_tables_keep_their_links(spark):
    one = json.dumps({"lines": [L(1, unit_price="EUR 1,200.50", tax={"rate": 24, "amount": 1}), L(1, tax={"amount": 1, "rate": 24.0}, unit_price="EUR 1,200.50")]})
    df = spark.createDataFrame([(1, one, "x"), (1, one, "x"), (2, None, "x"), (3, '{"lines": {"allocations": [{"site": "s", "quantity": "2"}]}}', "x")], "record_id long, raw string, node_id string")
    nodes = nested.shred(df)
    assert nested.bridge(nodes).count() == 6
    objs = nested.objects(nodes).collect()
    assert sorted((o["fields"], o["places"]) for o in objs) == [(1, 0), (1, 0), (1, 1), (2, 0), (2, 1), (3, 4)]
    assert nested.children(nodes).count() == 6
    lines = nested.flat(nodes, "lines").where("record_id = 1").collect()
    assert {(r["unit_price"], r["tax_rate"]) for r in lines} == {(1200.5, 24.0)} and len({r["node_id"] for r in lines}) == 1
    a = nested.flat(nodes, "allocations").first()
    line = nested.flat(nodes, "lines").where("record_id = 3").first()
    assert a["parent_id"] == line["node_id"] and a["parent_ord"] == line["ord"] and a["quantity"] == 2.0
    assert nested.records(nodes).count() == 4
    assert nested.bridge(nested.shred(df.limit(0))).count() == 0
