import math
from collections import Counter

from pyspark.sql import functions as F

from tallyfold.operators import profile

FORMS = {("t", "c"): profile.UNIT_INTERVAL, ("t", "p"): profile.PAYMENT_TERMS}
SCHEMA = "row_id long, load_id int, c double, p string, value string, column_name string"


def cells(spark, rows):
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA)
    return profile.cells(df, "t", [("c", "c"), ("p", "p")])


def test_findings(spark):
    rows = [(i, 1, 0.55, "Net 30") for i in range(8)] + [(8, 1, float("nan"), "net 30"), (9, 1, 1.2, "Net 0"), (10, 2, None, None), (11, 2, 1.0, "Net 120"), (12, 2, -0.1, "Net 121"), (13, None, 2.0, "Net\xa030")]
    got = {tuple(r) for r in profile.findings(cells(spark, rows), FORMS).collect()}
    form = {(r[1], r[3]) for r in got if r[4] == "form"}
    assert form == {("c", 8), ("c", 9), ("c", 12), ("c", 13), ("p", 8), ("p", 9), ("p", 12), ("p", 13)}
    assert {(r[1], r[2]) for r in got if r[4] == "nulls"} == {("c", 2), ("p", 2)}
    assert {(r[1], r[2]) for r in got if r[4] == "shift"} == {("c", 2), ("p", 2)}
    assert profile.findings(cells(spark, rows[:0]), FORMS).count() == 0


def test_shift_equals_brute_force(spark):
    rows = [(i, i % 3, round((i * 37 % 100) / 100, 2) if i % 3 else round((i * 7 % 30) / 100, 2), None) for i in range(300)]
    counts = profile.with_validity(profile.value_counts(cells(spark, rows)), FORMS)
    got = {r["load_id"]: r for r in profile.shifts(counts).where("column_name = 'c'").collect()}
    bins = [(r[1], min(9, math.floor(r[2] * 10))) for r in rows]
    whole = Counter(b for _, b in bins)
    n = len(bins)
    for load in range(3):
        own = Counter(b for l, b in bins if l == load)
        m = sum(own.values())
        p, q = {b: own[b] / m for b in whole}, {b: whole[b] / n for b in whole}
        assert abs(got[load]["distance"] - sum(abs(p[b] - q[b]) for b in whole) / 2) < 1e-9
        psi = sum(((p[b] or 1e-4) - q[b]) * math.log((p[b] or 1e-4) / q[b]) for b in whole)
        assert abs(got[load]["psi"] - psi) < 1e-6
        assert abs(got[load]["chi2"] - m * sum((p[b] - q[b]) ** 2 / q[b] for b in whole)) < 1e-6


def test_profile_counts(spark):
    rows = [(1, 1, 0.5, "b"), (2, 1, 0.5, None), (2, 1, None, "a")]
    counted = profile.value_counts(cells(spark, rows).withColumn("number", F.col("column_name") == "c"))
    p = {r["column_name"]: r for r in profile.profile(profile.with_validity(counted, FORMS)).collect()}
    assert (p["c"]["n_rows"], p["c"]["n_nulls"], p["c"]["n_distinct"], p["c"]["min_number"], p["c"]["n_mode"]) == (3, 1, 1, 0.5, 2)
    assert (p["p"]["n_violations"], p["p"]["min_text"], p["p"]["max_text"], p["p"]["min_number"], p["c"]["min_text"]) == (2, "a", "b", None, None)


def test_leaves(spark):
    rows = [(1, 7, (1, ("x",)), [(2.5, [1, 2]), None], "clash"), (2, None, None, None, "clash"), (3, 7, (None, None), [], "clash")]
    df = spark.createDataFrame(rows, "row_id long, load_id int, t struct<a:int,s:struct<b:string>>, l array<struct<v:double,w:array<int>>>, value string")
    cells_ = profile.all_cells(df, "t", ("row_id",)).collect()
    assert {(r["column_name"], r["number"]) for r in cells_} == {("t.a", True), ("t.s.b", False), ("l", True), ("l[].v", True), ("l[].w", True), ("l[].w[]", True), ("value", False)}
    got = Counter((r["column_name"], r["load_id"], r["value"]) for r in cells_)
    assert got == Counter({
        ("t.a", 7, "1"): 1, ("t.a", None, None): 1, ("t.a", 7, None): 1, ("t.s.b", 7, "x"): 1, ("t.s.b", None, None): 1, ("t.s.b", 7, None): 1, ("l", 7, "2"): 1, ("l", None, None): 1, ("l", 7, "0"): 1,
        ("l[].v", 7, "2.5"): 1, ("l[].v", 7, None): 1, ("l[].w", 7, "2"): 1, ("l[].w", 7, None): 1, ("l[].w[]", 7, "1"): 1, ("l[].w[]", 7, "2"): 1, ("value", 7, "clash"): 2, ("value", None, "clash"): 1,
    })
    assert profile.all_cells(df.limit(0), "t").count() == 0


def test_ranges_of_wide_columns(spark):
    rows = [(i, i % 2, None, f"k{i:04d}" if i % 4 else "often") for i in range(2000)] + [(i, i % 2, float(i if i % 2 else -i), None) for i in range(2000, 4000)] + [(9999, 1, float("nan"), "Ä-1")]
    counts = profile.categories(profile.with_validity(cells(spark, rows).withColumn("number", F.col("column_name") == "c"), {}))
    n = Counter()
    for r in counts.collect():
        n[r["column_name"], r["bin"]] += r["n"]
    assert n["p", "often"] == 500 and sum(v for k, v in n.items() if k[0] == "p") == 2001 and sum(k[1].startswith("form ") for k in n) == 2
    assert n["c", "range none"] == 1 and n["c", "range 0"] + n["c", "range 1"] + n["c", "range 2"] == n["c", "range 7"] + n["c", "range 8"] + n["c", "range 9"] == 1000
    shift = {(r["column_name"], r["load_id"]): r["distance"] for r in profile.shifts(counts).collect()}
    assert abs(shift["c", 0] - 0.5) < 1e-3 and abs(shift["c", 1] - 0.5) < 1e-3


def test_every_column_has_its_shift(spark, tiny):
    from tallyfold.plans import quality

    loads = lambda df: {(r["table_name"], r["column_name"], r["load_id"]) for r in df.collect()}
    found = quality.p5_profile(spark, tiny).where("load_id is not null and n_nulls + n_violations < n_rows")
    assert loads(quality.p5_shift(spark, tiny)) == loads(found)
    assert {("invoices", "currency"), ("evidence_items", "field_path"), ("purchase_orders", "source_system"), ("invoices", "po_reference"), ("invoices", "lines[].unit_price"), ("invoices", "removed_duplicates[].reason")} <= {x[:2] for x in loads(found)}


def test_no_column_is_left_out(spark, tiny):
    from tallyfold.plans import quality

    names = ["invoices", "purchase_orders", "evidence_items", "contracts", "raw_records", "documents", "given_names"]
    held = {(n, c) for n in names for c in spark.read.parquet(f"{tiny}/{n}.parquet").columns}
    top = lambda df: {(r["table_name"], r["column_name"].split(".")[0].removesuffix("[]")) for r in df.select("table_name", "column_name").distinct().collect()}
    assert top(quality._all_cells(spark, tiny, names)) == held == top(quality.p5_profile_all(spark, tiny))
    assert top(quality.p5_shift_all(spark, tiny)) - top(quality.p5_shift(spark, tiny)) == {(n, c) for n in names[:3] for c in ("row_id", "load_id")}


def test_identities_and_loads_are_columns(spark):
    df = spark.createDataFrame([(1, 7, "a"), (1, 7, "b"), (None, 7, "c"), (5, None, "d")], "row_id long, load_id int, v string")
    rows = profile.profile(profile.with_validity(profile.value_counts(profile.all_cells(df, "t", load_too=True)), {})).collect()
    got = {(r["column_name"], r["load_id"]): (r["n_rows"], r["n_nulls"], r["n_distinct"], r["min_number"], r["n_mode"]) for r in rows if r["column_name"] != "v"}
    assert got == {("row_id", 7): (3, 1, 1, 1.0, 2), ("row_id", None): (1, 0, 1, 5.0, 1), ("load_id", 7): (3, 0, 1, 7.0, 3), ("load_id", None): (1, 1, 0, None, None)}
    assert {r["column_name"] for r in profile.all_cells(df, "t", ("row_id",)).collect()} == {"v"}


def test_values_that_are_all_different_have_a_shift(spark):
    n = 20_000  # more than the sketch follows, which then proposes none
    df = spark.range(n).selectExpr("id as row_id", "cast(if(id < 5000, 1, 2) as int) as load_id")
    marked = profile.with_validity(profile.all_cells(df, "t", load_too=True), {})
    got = {(r["column_name"], r["load_id"]): round(r["distance"], 6) for r in profile.shifts(profile.categories(marked)).collect()}
    assert got == {("row_id", 1): 0.7, ("row_id", 2): 0.233333, ("load_id", 1): 0.75, ("load_id", 2): 0.25}
