import itertools

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyfold.llm import canonical, linkage, similarity

ROWS = "row_id long, po_reference string, seller string, key string, value string"
LIST = "document_id string, vendor string, code string"


def match(spark, typed, listed, **kw):
    rows = spark.createDataFrame([(*t, "clash", "clash") for t in typed], ROWS)
    orders = spark.createDataFrame([(*x, "clash") for x in listed], LIST)
    got = canonical.match_references(rows, orders, row_id="row_id", value="po_reference", name="seller", key="document_id", owner="vendor", **kw)
    return sorted((r["row_id"], r["key"]) for r in got.collect())


A, B = "PO-00123456789", "PO-00987654321"
LISTED = [(A, "Bergvoll Handling GmbH"), (A, "Bergvoll Handling GmbH"), (B, None), (None, "x")]


def test_forms(spark):
    values = [
        "po 123456789", "Best.-Nr. 00123456789/A", "P/O 123'456'789 dd 3.4.", "PO – 00123456789 (rev B)", "１２３４５６７８９", "po_123456789.0", "order 1.2345.6789.0", "Til.nro I23456789 line 4", "SAP 00l 23456789.",
        "IO 00123456789 SEE MAIL", "po 123456798", "12345679", "1234567889", "po 123456780",
    ]
    typed = [(k, v, "BERGVOLL HANDLING") for k, v in enumerate(values)]
    assert match(spark, typed, LISTED) == [(k, A) for k in range(len(values))]


def test_zeros_behind_a_slip(spark):
    # the 6 that is left out makes the zeros behind it look like leading ones
    listed = [("PO-00600069323", "Brask Works AB"), ("PO-00700069999", "Brask Works AB")]
    typed = [(1, "PO no. 0000069323", "Brask Works"), (2, "600069323", "x"), (3, "0600069323", "x"), (4, "69323", "Brask Works")]
    assert match(spark, typed, listed) == [(1, "PO-00600069323"), (2, "PO-00600069323"), (3, "PO-00600069323"), (4, None)]


def test_misses_and_edges(spark):
    typed = [(1, None, "x"), (2, "", "x"), (3, "  ", None), (4, A, "x"), (5, "PO-", "x"), (6, "BANF 77850", "x"), (7, "po 555555555", "x"), (8, "123456780", "Zelkin Tooling Oy"), (9, "123456780", None), (10, "987654312", "Anyone"), (10, "987654312", "Anyone"), (11, "x" * 5000 + " 123456789", "z")]
    got = match(spark, typed, LISTED)
    assert got == [(2, None), (3, None), (5, None), (6, None), (7, None), (8, None), (9, A), (10, B), (10, B), (11, A)]
    assert match(spark, typed, [], broadcast_entries=0) == [(r, None) for r in (2, 3, 4, 5, 6, 7, 8, 9, 10, 10, 11)]
    assert match(spark, [], LISTED) == []


def test_broadcast_and_shuffle_agree(spark):
    typed = [(k, str(123456789 + 9 * k), "Bergvoll Handling") for k in range(60)]
    listed = [(f"PO-00{123456789 + 17 * k}", "Bergvoll Handling") for k in range(60)]
    one, two = match(spark, typed, listed), match(spark, typed, listed, broadcast_entries=0)
    assert one == two and any(k for _, k in one)


def brute(typed, codes, bound):
    near = [(similarity.weighted_edits(typed, c, bound), c) for c in codes]
    return sorted((w, c) for w, c in near if w is not None)


@settings(max_examples=10, deadline=None)
@given(st.sets(st.text("0123", min_size=3, max_size=6), min_size=1, max_size=12), st.sets(st.text("0123", min_size=3, max_size=6), min_size=1, max_size=8), st.sampled_from([1, 2]))
def test_neighbours_equal_brute_force(spark, codes, typed, edits):
    got = canonical.neighbours(spark.createDataFrame([(t,) for t in typed], "code string"), spark.createDataFrame([(c,) for c in codes], "code string"), edits, 100).collect()
    assert {(r["code"], r["entry"], round(r["distance"], 6)) for r in got} == {(t, c, round(w, 6)) for t in typed for w, c in brute(t, codes, edits)}


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.text("0123", max_size=6), st.text("0123", max_size=6)), min_size=40, max_size=120), st.sampled_from([1, 2]))
def test_the_built_in_test_is_never_too_strict(spark, pairs, edits):
    df = spark.createDataFrame(pairs + [("12", "21"), ("1233", "1323"), ("", "1"), ("2112", "1221")], "a string, b string")
    kept = {(r["a"], r["b"]) for r in df.where(canonical.may_be_near(F.col("a"), F.col("b"), edits)).collect()}
    assert all((a, b) in kept for a, b in pairs if similarity.weighted_edits(a, b, edits) is not None)
    assert ("12", "21") in kept and not {("0000", "3333"), ("012301", "333333")} & kept


def test_weights():
    w = similarity.weighted_edits
    assert w("12", "21", 1) == similarity.TRANSPOSED and w("1", "11", 1) == similarity.DOUBLED and w("12", "172", 1) == 1.0 and w("1", "7", 1) == similarity.ALIKE
    assert w("1234", "4321", 2) is None and w("", "", 1) == 0.0 and w("ab", "", 2) == 2.0


def test_solver_equals_grid_search():
    # two matches of one line, one party each: minimise over a fine grid
    i = np.array([0, 0, 1, 1, 2, 2, 0, 1])
    a = np.array([-1.0, 1, -1, 1, -1, 1, 1, 1])
    j = np.array([-1, -1, -1, -1, -1, -1, 2, -1])
    b = np.array([0.0, 0, 0, 0, 0, 0, -1, 0])
    c = np.array([0.9, -0.9, 0.7, -0.7, 0.4, -0.4, 0, 0])
    w = np.array([1.0, 1, 1, 1, 3, 3, 2, 0.5])
    group = (np.array([0, 1]), np.array([0, 0]), 1)
    z, converged = linkage.solve(3, (i, a, j, b, c, w), group)
    assert converged.tolist() == [True]

    def loss(x):
        return sum(wk * max(0.0, ak * x[ik] + (bk * x[jk] if jk >= 0 else 0) + ck) ** 2 for ik, ak, jk, bk, ck, wk in zip(i, a, j, b, c, w))

    grid = np.linspace(0, 1, 51)
    best = min((loss(x), x) for x in itertools.product(grid, repeat=3) if x[0] + x[1] <= 1)
    assert z[0] + z[1] <= 1.001 and loss(np.clip(z, 0, 1)) <= best[0] + 2e-3


LINES = "array<struct<line_number:int,description:string,unit_of_measure:string,quantity:double,unit_price:double,net_amount:double,tax_rate:double,tax_amount:double,line_total:double>>"
ORDERS = f"row_id long, document_id string, vendor struct<name:string,vendor_id:string>, contract_reference string, lines {LINES}, ingested_at string, party string"
CONTRACTS = "row_id long, document_id string, counterparty struct<name:string>, rate_schedule array<struct<description:string,unit_of_measure:string,max_unit_price:double>>, ingested_at string, vendor string"


def order(n, vendor, lines, ref=None, name=None):
    return (n, name or f"PO-{n}", (vendor, None), ref, lines and [(1, d, u, 1.0, p, None, None, None, None) for d, u, p in lines], f"t{n}", "clash")


def linked(spark, orders, contracts):
    o = spark.createDataFrame(orders, ORDERS)
    c = spark.createDataFrame(contracts, CONTRACTS)
    return {(r["po_id"], r["line_pos"]): (r["contract_id"], r["rate_pos"], r["confidence"]) for r in linkage.link(o, c, F.col("contract_reference").rlike("CTR-"))
            .collect()}


CON = [
    (1, "C1", ("Kolvane Tooling AS",), [("Stud bar KC-817 25 kg", "L", 100.0), ("Junction box GE-374 500 mm", "EA", 20.0)], "a", "clash"),
    (2, "C1", ("Kolvane Tooling AS",), [("Stud bar KC-817 25 kg", "L", 100.0), ("Junction box GE-374 500 mm", "EA", 20.0)], "b", "clash"),
    (3, "C2", ("Zelkin Works Oy",), [("Junction box GE-374 500 mm", "EA", 31.0), ("KC.817 threaded rod / stud bar (25 kg)", "L", 150.0)], "a", "clash"),
    (4, None, ("Nobody",), None, "a", "clash"), (5, "C3", None, [(None, None, None)], "a", "clash"),
]


def test_linkage(spark):
    orders = [
        order(1, "Tooling Kolvane", [("Thraeded rod kc 817", "ltr", 99.5), ("Express handling", "EA", 5.0), (None, None, None)]),
        order(2, None, [("Branching box 50 cm", "pc", 31.0), ("stud bar 25kg", None, 150.0)]),
        order(3, "Kolvane Tooling AS", [("Junction box GE-374", "EA", 20.0)], ref="CTR-1"),
        order(4, "Brask Trading BV", [("Junction box GE-374 500 mm", "EA", 20.0)]),
        order(5, "Kolvane Tooling AS", [("Junction box GE-999 500 mm", "EA", 20.0)]),
        order(6, "Tooling Kolvane", [("Thraeded rod kc 817", "ltr", 99.5)], name="PO-1"),
        order(7, "Zelkin Works", None),
    ]
    got = linked(spark, orders, CON)
    assert {k: v[:2] for k, v in got.items()} == {("PO-1", 1): ("C1", 1), ("PO-2", 1): ("C2", 1), ("PO-2", 2): ("C2", 2)}
    assert all(0.4 <= v[2] <= 1.0 for v in got.values())
    assert linked(spark, [], CON) == {} and linked(spark, orders, []) == {}


def problem(r, lines, parties):
    """A random order: atoms of parties and matches, rules as in the operator."""
    i, a, j, b, c, w, atom, group = ([] for _ in range(8))
    n = parties + lines * parties
    for p in range(parties):
        v = r.random()
        i += [p, p]; a += [-1.0, 1.0]; j += [-1, -1]; b += [0.0, 0.0]; c += [v, -v]; w += [5.0, 5.0]
        atom.append(p); group.append(0)
    for x in range(lines):
        for p in range(parties):
            k, v = parties + x * parties + p, r.random()
            i += [k, k, k, p]; a += [-1.0, 1, 1, 1]; j += [-1, -1, p, k]; b += [0.0, 0, -1, -1]; c += [v, -v, 0.0, v - 1]; w += [1.0, 1, 10, 0.5]
            atom.append(k); group.append(1 + x)
    return n, tuple(np.array(x) for x in (i, a, j, b, c, w)), np.array(atom), np.array(group)


def test_each_order_stops_on_its_own():
    r = np.random.default_rng(5)
    alone, parts, at, groups = [], [], 0, 0
    problems = [problem(r, int(r.integers(1, 5)), int(r.integers(1, 5))) for _ in range(25)]
    for n, linear, atom, group in problems:
        z, converged = linkage.solve(n, linear, (atom, group, int(group.max()) + 1))
        assert converged.all()
        alone.append(z)
        i, a, j, b, c, w = linear
        parts.append((i + at, a, np.where(j < 0, -1, j + at), b, c, w, atom + at, group + groups, np.full(n, len(parts))))
        at, groups = at + n, groups + int(group.max()) + 1
    i, a, j, b, c, w, atom, group, block = (np.concatenate(x) for x in zip(*parts))
    z, converged = linkage.solve(at, (i, a, j, b, c, w), (atom, group, groups), block)
    assert converged.all() and np.array_equal(z, np.concatenate(alone))
    assert not linkage.solve(at, (i, a, j, b, c, w), (atom, group, groups), block, rounds=20)[1].all()
    assert linkage.solve(0, tuple(np.zeros(0, t) for t in (int, float, int, float, float, float)), (np.zeros(0, int), np.zeros(0, int), 0), np.zeros(0, int))[0].size == 0


def test_confidence_does_not_depend_on_batches(spark):
    orders = [order(n, v, [("Thraeded rod kc 817", "ltr", 99.5 + n), ("Branching box 50 cm", "pc", 20.0 + n)]) for n, v in enumerate(("Tooling Kolvane", None, "Zelkin Works", "Kolvane Toling", None, "Zelkn Works Oy") * 3)]
    got = []
    for size in (1, 7, 10_000):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        got.append(linked(spark, orders, CON))
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got[0] == got[1] == got[2] and got[0]


def test_the_field_finds_what_no_single_likeness_does(spark):
    """A name so mistyped that likeness times name stays below the threshold; that the lines fit lifts the party, and the party the lines."""
    vendor, party = "Zekiln Works Oy", "Zelkin Works Oy"
    named = linkage.same_party(vendor, party, similarity.name_similarity(vendor, party))
    assert named * 1.0 < linkage.ACCEPT  # no likeness of a line is greater than 1
    got = linked(spark, [order(1, vendor, [("Junction box GE-374 500 mm", "EA", 31.0), ("threaded rod KC-817 25 kg", "L", 150.0)])], CON)
    assert {k: v[:2] for k, v in got.items()} == {("PO-1", 1): ("C2", 1), ("PO-1", 2): ("C2", 2)}
    # where the lines speak against the party, nothing is lifted
    assert linked(spark, [order(1, vendor, [("Junction box GE-999 500 mm", "EA", 3.0)])], CON) == {}
