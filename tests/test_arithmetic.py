from decimal import ROUND_HALF_UP, Decimal

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyfold.functions import numbers
from tallyfold.operators import arithmetic, render

DOC = "row_id long, document_id string, document_type string, lines array<struct<line_number:int,description:string,unit_of_measure:string,quantity:double,unit_price:double,net_amount:double,tax_rate:double,tax_amount:double,line_total:double>>, totals struct<subtotal:double,tax_total:double,grand_total:double>, order_value double"


def line(quantity=1.0, price=100.0, net=None, rate=None, tax=None, total=None, number=1):
    return (number, "x", "EA", quantity, price, net, rate, tax, total)


def reports(spark, docs, **kw):
    df = spark.createDataFrame(docs, DOC)
    return {r["doc_id"]: r for r in arithmetic.verdict(arithmetic.reports(arithmetic.documents(df), **kw)).collect()}


def test_tolerances(spark):
    docs = [(1, "T-1", "invoice", [line(net=100.50)], (100.50, None, None), None)]
    assert reports(spark, docs, reporting="5.00")[1]["n_material"] == 0
    assert reports(spark, docs, reporting="0.10")[1]["n_material"] == 1


def test_masked_total(spark):
    r = reports(spark, [(1, "T-2", "invoice", [line(net=100.0)], (100.0, 0.0, 999.0), None)])[1]
    assert [d["check"] for d in r["discrepancies"]] == ["grand_total"] and r["verdict"] == "DISCREPANCY"


def test_order_value_only_without_totals(spark):
    r = reports(spark, [(1, "A", "purchase_order", [line(net=100.0)], None, 90.0), (2, "B", "purchase_order", [line(net=100.0)], (100.0, None, None), 90.0)])
    assert r[1]["discrepancies"][0]["check"] == "order_value" and r[2]["balanced"]


def test_absent_figures(spark):
    r = reports(spark, [
        (1, "A", "contract", None, None, None), (2, None, None, [], None, None), (3, "C", "invoice", [None, line(quantity=None, net=5.0), line(price=None)], (5.0, None, None), None),
        (4, "D", "invoice", [line(net=float("nan"))], (100.0, None, None), None),
    ])
    assert r[1]["verdict"] == r[2]["verdict"] == "not applicable"
    assert r[3]["balanced"] and r[3]["checks_run"] == 1
    assert r[4]["balanced"]


def test_percentage_and_summary(spark):
    df = spark.createDataFrame([(1, "I", "invoice", [line(net=100.0)], (96.0, None, None), None)], DOC)
    rep = arithmetic.reports(arithmetic.documents(df))
    text = render.report_text(rep).first()["summary"]
    assert text == "I  (invoice)  2 checks  ·  1 discrepancy(ies)\n    [material] subtotal at totals.subtotal: stated 96.00, computed 100.00, difference -4.00  (4.00%)"
    assert '"percentage":"4.00"' in render.report_json(rep).first()["report"]


@settings(max_examples=30, deadline=None)
@given(st.lists(st.floats(-1e6, 1e6, allow_nan=False).map(lambda x: round(x, 4)), min_size=1, max_size=20))
def test_cents_are_half_up(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v double").select("v", numbers.cents(numbers.money(F.col("v"))).alias("c"))
    for r in df.collect():
        assert r["c"] == Decimal(str(r["v"])).quantize(Decimal("0.01"), ROUND_HALF_UP)


def test_figures(spark):
    texts = ["EUR100,234.40", "€ 5", "-3.5", "1,000", ",", "12a", "", None, "usd -7", "SEK", "1.2.3", "(4)", "5\r"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(numbers.figure(F.col("t"))).collect()]
    assert got == [100234.40, 5.0, -3.5, 1000.0, None, None, None, None, -7.0, None, None, None, None]


def test_reports_of_all_types(spark, tiny):
    from tallyfold.plans import arithmetic as plans

    assert {r[0] for r in plans.report_text(spark, tiny).select("document_type").distinct().collect()} == {"invoice", "purchase_order", "contract"}
