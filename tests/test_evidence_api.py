import pytest
from pyspark.sql import functions as F

from tallyfold.api import ALL_TOOLS, Workbench
from tallyfold.operators import evidence, render

DOC = "document_id string, document_type string, source_system string, currency string, po_reference string, lines array<struct<line_number:int,description:string,unit_of_measure:string,quantity:double,unit_price:double,net_amount:double,tax_rate:double,tax_amount:double,line_total:double>>, totals struct<subtotal:double,tax_total:double,grand_total:double>, order_value double"


def documents(spark):
    return spark.createDataFrame([("INV-1", "invoice", "SharePoint", "EUR", None, [(1, "pipe", "EA", 2.0, 10.5, 21.0, 24.0, 5.04, 26.04)], (21.0, 5.04, 30.0), None)], DOC)


def test_cite_and_absence(spark):
    of = evidence.fields(documents(spark), ["document_id"])
    asked = spark.createDataFrame([(1, "INV-1", "lines[0].unit_price"), (2, "INV-1", "po_reference"), (3, "INV-1", "lines[9].unit_price"), (4, "INV-1", "lines[0][1]"), (5, "X", "currency"), (6, None, None), (7, "INV-1", "totals.grand_total"), (7, "INV-1", "totals.grand_total")], "ord int, document_id string, field_path string")
    got = {(r["ord"], r["present"], r["value"], r["note"]) for r in evidence.cite(asked, of).collect()}
    gone = evidence.ABSENT
    assert got == {(1, True, "10.5", None), (2, True, None, None), (3, False, None, gone), (4, False, None, gone), (5, False, None, gone), (6, False, None, gone), (7, True, "30", None)}
    assert evidence.cite(asked, of).count() == 8
    assert {r["ord"] for r in evidence.cite(asked.withColumn("document_id", F.lit(None).cast("string")), of, default_document="INV-1").where("present").collect()} == {1, 2, 5, 7}
    assert evidence.cite(asked.where("ord in (1, 7)"), of, strict=True).where("present").count() == 3
    with pytest.raises(Exception, match=r"no field lines\[9\].unit_price in document INV-1"):
        evidence.cite(asked.where("ord = 3"), of, strict=True).collect()


ITEM = "pack_id string, ord int, source_system string, document_id string, document_type string, field_path string, value string, confidence double, page int, bounding_box struct<x0:double,y0:double,x1:double,y1:double>, note string, created_at string"


def packs(spark, confidences=(0.99, 0.99, 0.55), order=(0, 1, 2)):
    rows = [("p", o, "SAP" if k else "CLM", f"D{k % 2}", "invoice", "x", f"v{k}", c, 0, None, None, "t") for k, (c, o) in enumerate(zip(confidences, order))]
    return evidence.packs(spark.createDataFrame(rows, ITEM))


def test_packs(spark):
    p = packs(spark).first()
    assert p["weakest_confidence"] == 0.55 and p["documents"] == ["D0", "D1"] and p["sources"] == ["CLM", "SAP"] and (p["n_items"], p["n_located"]) == (3, 0)
    assert packs(spark, (None, None, float("nan"))).first()["weakest_confidence"] is None
    assert p["integrity_hash"] == packs(spark).first()["integrity_hash"] and len(p["integrity_hash"]) == 16
    assert p["integrity_hash"] != packs(spark, order=(1, 0, 2)).first()["integrity_hash"] != packs(spark, (0.9, 0.99, 0.55)).first()["integrity_hash"]
    text = render.pack_markdown(evidence.stamped(packs(spark), "fine")).first()["markdown"]
    assert "**Conclusion.** fine" in text and "Weakest citation confidence: 0.55" in text and text.count("\n| ") == 5


def test_the_json_hash_is_that_of_the_json_module(spark):
    import hashlib
    import json

    rows = [("p", 1, "SAP", "Ä-1", "invoice", "x", 'a"b\\c\n', 0.5, 2, (1.0, 2.5, 3.0, 4.0), None, "t"), ("p", 0, None, None, None, "y", None, None, None, None, "€", "t")]
    names = ("source_system", "document_id", "document_type", "field_path", "value", "confidence", "page", "bounding_box", "note")
    items = [dict(zip(names, r[2:11])) for r in sorted(rows, key=lambda r: r[1])]
    want = hashlib.sha256(json.dumps(items, sort_keys=True, default=str).encode()).hexdigest()[:16]
    assert [tuple(r) for r in evidence.json_hashed(evidence.packs(spark.createDataFrame(rows, ITEM))).collect()] == [("p", want)]


def test_agent_functions_never_raise(spark):
    docs = documents(spark)
    words = spark.createDataFrame([("INV-1", 0, 1, "Total", 10.0, 10.0, 40.0, 20.0), ("INV-1", 0, 2, "due", 45.0, 11.0, 60.0, 21.0), ("INV-1", 0, 3, "30.00", 90.0, 10.0, 120.0, 20.0)], "doc_id string, page int, word_no long, text string, x0 double, y0 double, x1 double, y1 double")
    pages = spark.createDataFrame([("INV-1", 0, 595.0, 842.0)], "doc_id string, page int, width double, height double")
    wb = Workbench(docs, words, pages)
    assert wb.read_document_fields("INV-1")["document"]["currency"] == "EUR"
    for bad in ("../../etc/passwd", "", None, ".hidden", 7):
        assert wb.read_document_fields(bad)["ok"] is False and wb.check_document_arithmetic(bad)["ok"] is False
    r = wb.check_document_arithmetic("INV-1.pdf")
    assert [d["check"] for d in r["material_discrepancies"]] == ["grand_total"] and r["material_discrepancies"][0]["difference"] == 3.96
    assert wb.find_value_in_document("INV-1", "Total due")["hits"] == [{"text": "Total due", "page": 0, "x0": 10.0, "y0": 10.0, "x1": 60.0, "y1": 21.0}]
    none = wb.find_value_in_document("INV-1.pdf ", "nope")
    assert none["ok"] and none["found"] is False and none["hits"] == []
    for bad in ("INV-2", None, "../x", ".pdf"):
        assert wb.find_value_in_document(bad, "Total due")["ok"] is False and wb.snip_value_from_document(bad, "Total due")["ok"] is False
    assert wb.find_value_in_document("archive/INV-1.pdf", "Total due")["found"]
    s = wb.snip_value_from_document("INV-1", "Total due")
    assert s["text"] == "Total due 30.00" and s["rectangle"] == [0.0, 0.5, 132.0, 30.5] and s["image_path"] == "INV-1-Total_due.png" and s["occurrences_found"] == 1
    assert wb.snip_value_from_document("INV-1", "nope")["found"] is False
    for bad in ([], None, [{"document_id": "INV-1"}], [{"field_path": "x"}], [{"document_id": "Z", "field_path": "x"}]):
        assert wb.build_evidence_pack("c", bad)["ok"] is False
    p = wb.build_evidence_pack("c", [{"document_id": "INV-1", "field_path": "po_reference"}, {"document_id": "INV-1", "field_path": "totals.grand_total", "confidence": 0.8}])
    assert p["ok"] and p["fields_not_found"] == ["po_reference"] and p["weakest_confidence"] == 0.8
    assert set(wb.tools()) == set(ALL_TOOLS)


def test_a_workbench_over_words(spark):
    from tallyfold.sources import words as W
    from tests.test_layout import INVOICE

    w = W.print_invoice(INVOICE)
    rows = [("scan-7", p, k, *x) for k, (p, *x) in enumerate(zip(w.page, w.text, w.x0, w.y0, w.x1, w.y1))] + [("blank", 0, 0, None, None, None, None, None)]
    words = spark.createDataFrame(rows, "doc_id string, page int, word_no long, text string, x0 double, y0 double, x1 double, y1 double")
    wb = Workbench.of_words(words, None, W.HEIGHT)
    got = wb.read_document_fields("scan-7.pdf")
    assert got["ok"] and got["document"]["printed_id"] == "INV-1" and "lines[0].unit_price" in got["locatable_fields"] and "document_id" in got["locatable_fields"]
    assert wb.read_document_fields("blank")["requires_extraction_service"] is True
    pack = wb.build_evidence_pack("c", [{"document_id": "scan-7", "field_path": "totals.grand_total"}])
    assert pack["ok"] and pack["items"][0]["value"] == "26.04" and pack["items"][0]["page"] == W.row_page(42) and pack["items"][0]["bounding_box"]["x1"] > 0
    assert "Prepared " in pack["markdown"]


def test_evidence_on_every_type_is_cited_or_absent(spark, tiny):
    from tallyfold.plans import evidence as plans
    from tallyfold.sources.tables import table

    asked = sorted(r["row_id"] for r in table(spark, tiny, "evidence_items").collect())
    cited, absent = plans.cite_fields(spark, tiny).collect(), plans.try_cite_absent(spark, tiny).collect()
    assert sorted(r["row_id"] for r in cited + absent) == asked
    assert {r["document_type"] for r in cited} == {"invoice", "purchase_order", "contract"}
    assert any(r["field_path"].startswith("rate_schedule[") for r in cited)
