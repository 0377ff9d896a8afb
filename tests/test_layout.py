import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from tallyfold.operators import document, extract, layout, lookup
from tallyfold.operators.document import Document, Line, Words
from tallyfold.sources import words as W

WORDS = "doc_id string, page int, word_no long, text string, x0 double, y0 double, x1 double, y1 double"


def frame(spark, rows):
    return spark.createDataFrame(rows, WORDS)


def word(n, text, x, y, page=0, doc="d"):
    return (doc, page, n, text, float(x), float(y), float(x) + 5 * len(text), float(y) + 10)


def words(rows):
    out = Words()
    for _, page, _, text, *box in sorted(rows, key=lambda r: r[2]):
        out.add(page, text, *box)
    return out


def documents(spark, rows):
    return layout.Documents.of_words(frame(spark, rows), 800.0)


def model_rows(rows):
    out = []
    for w in sorted(rows, key=lambda w: (round(w[5], 1), w[4], w[2])):
        if out and abs(out[-1][0][5] - w[5]) <= 3.0:
            out[-1].append(w)
        else:
            out.append([w])
    return [" ".join(x[3] for x in sorted(r, key=lambda w: w[4])) for r in out]


def test_anchored_drift(spark):
    rows = [word(1, "a", 0, 0), word(2, "b", 10, 2), word(3, "c", 20, 4)]
    assert [r["text"] for r in layout.rows(documents(spark, rows)).orderBy("page_row_no").collect()] == ["a b", "c"]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 400), st.integers(0, 60)), min_size=1, max_size=40, unique=True))
def test_clustering_equals_model(places):
    rows = [word(k, f"w{k}", x, y) for k, (x, y) in enumerate(places)]
    assert Document(words(rows)).texts == model_rows(rows)


def test_flat_words_are_gathered_in_any_order(spark):
    rows = [word(k, f"w{k}", 10 * (k % 7), 13 * (k // 7), k // 30) for k in range(90)]
    shuffled = rows[:]
    random.Random(1).shuffle(shuffled)
    got = layout.rows(documents(spark, shuffled)).orderBy("page", "page_row_no").collect()
    assert [r["text"] for r in got] == [t for p in range(3) for t in model_rows([r for r in rows if r[1] == p])]
    assert [r["page_row_no"] for r in got if r["page"] == 1] == list(range(sum(r["page"] == 1 for r in got)))
    assert layout.rows(documents(spark, [])).count() == 0


def test_duplicates_are_dropped_and_counted(spark):
    rows = [word(1, "a", 0, 0), word(2, "a", 0.04, 0), word(3, "a", 50, 0), ("d", 0, 4, None, None, None, None, None)]
    got = layout.deduplicated(documents(spark, rows)).first()
    assert (got["words"], got["dropped"]) == (2, 1)
    assert [r["text"] for r in layout.rows(documents(spark, rows)).collect()] == ["a a"]


def test_furniture_needs_two_pages(spark):
    two = [word(1, "Page", 10, 790), word(2, "1", 40, 790), word(3, "Page", 10, 790, 1), word(4, "2", 40, 790, 1), word(5, "body", 10, 400), word(6, "body", 10, 400, 1)]
    one = [word(1, "Page", 10, 790, doc="e"), word(2, "1", 40, 790, doc="e")]
    got = {r["doc_id"]: r for r in layout.texts(documents(spark, two + one)).collect()}
    assert got["d"]["rows"] == ["body", "body"] and got["d"]["furniture"] == ["Page 1", "Page 2"]
    assert got["e"]["rows"] == ["Page 1"] and got["d"]["page_count"] == 2


def test_marker_priority_and_status(spark):
    rows = [word(1, "purchase", 0, 0), word(2, "order", 60, 0), word(3, "MASTER", 0, 20), word(4, "SUPPLY", 60, 20), word(5, "AGREEMENT", 110, 20)]
    blank = [("blank", 0, 1, None, None, None, None, None)]
    got = {r["doc_id"]: (r["status"], r["document_type"]) for r in layout.status(documents(spark, rows + [word(1, "hello", 0, 0, doc="u")] + blank)).collect()}
    assert got == {"d": ("OK", "purchase_order"), "u": ("UNKNOWN_LAYOUT", None), "blank": ("NO_TEXT_LAYER", None)}


def test_first_match_does_not_fall_through(spark):
    # the first row with the words has no word that equals the label's first: absent, although a later row has it
    rows = [word(1, "InvoiceX", 0, 0), word(2, "NUMBER", 80, 0), word(3, "INVOICE", 0, 100), word(4, "NUMBER", 80, 100), word(5, "INV-1", 0, 112)]
    assert Document(words(rows)).below("INVOICE NUMBER") is None
    assert Document(words(rows[2:])).below("INVOICE NUMBER") == ("INV-1", (0, 0.0, 112.0, 25.0, 122.0))
    got = lookup.below_labels(documents(spark, rows[2:]), ["INVOICE NUMBER", "NONE"]).collect()
    assert [(r["label"], r["text"], r["page"]) for r in got] == [("INVOICE NUMBER", "INV-1", 0)]


def test_value_run_stops_at_a_wide_gap():
    rows = [word(1, "TERMS", 0, 0), word(2, "Net", 0, 12), word(3, "30", 20, 12), word(4, "other", 80, 12)]
    assert Document(words(rows)).below("TERMS")[0] == "Net 30"


def test_figures():
    for text, value in (("1,400.00", 1400.0), ("EUR5", 5.0), ("eur -7", -7.0), ("€1.", 1.0), (",", None), ("-", None), ("5a", None), ("", None), ("EUR", None), ("٣", None), ("(5)", None)):
        assert document.figure(text) == value


def test_column_assignment_is_closest_pair_first():
    # the first figure is nearer to the second column than to its own, but the second figure is nearer still
    edges = [("quantity", 0, 100.0), ("unit_price", 1, 138.0)]
    assert document.assigned([(121.0, 7.0), (140.0, 9.0)], edges) == {"quantity": 0, "unit_price": 1}
    assert document.assigned([(119.0, 7.0), (119.0, 9.0)], edges) == {"quantity": 0, "unit_price": 1}  # ties by figure, then by column
    assert document.assigned([(10.0, 1.0)], edges) == {}


def placed(number, page, y):
    return Line((number, "x", "EA", 1.0, 2.0, None, None, None, None), page, float(y), {})


def model_artefacts(items):
    kept, removed = [], []
    for x in items:
        twin = any(k.record == x.record and k.page == x.page and abs(k.y0 - x.y0) <= 6 for k in kept)
        seam = bool(kept) and kept[-1].record == x.record and x.page - kept[-1].page == 1
        (removed if twin or seam else kept).append(x)
    return kept, removed


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 2), st.integers(0, 2), st.sampled_from([0, 4, 20, 40])), max_size=12))
def test_artefacts_equal_model(items):
    rows = [placed(*i) for i in items]
    kept, removed = document.without_artefacts(rows)
    model = model_artefacts(rows)
    assert kept == model[0] and [(r[0], r[2]) for r in removed] == [(x.record[0], x.page + 1) for x in model[1]]
    assert all(r[4] in (document.SAME_PLACE, document.SEAM) for r in removed)


def test_search_and_crop(spark):
    text = spark.createDataFrame([(1, "the credit note of May\ncredit note"), (2, None), (3, ""), (4, "credit note of credit note of")], "doc_id long, text string")
    docs, pages = W.text_documents(text), W.text_pages(text)
    hits = lookup.search(docs, "credit note of")
    assert sorted((r["doc_id"], r["x0"]) for r in hits.collect()) == [(1, 24.0), (4, 0.0), (4, 90.0)]
    assert "Contains" in hits._jdf.queryExecution().optimizedPlan().toString()
    assert pages.count() == 4
    c = lookup.crop(hits.where("doc_id = 4 and x0 = 0"), pages).first()
    assert (c["cx0"], c["cy0"]) == (0.0, 38.5)
    assert lookup.search(docs, "").count() == 0 and lookup.search(docs, "credit note of", page=1).count() == 0


def test_a_hit_without_words_at_its_height_stays():
    w = words([word(1, "far", 0, 500)])
    hit = ("x", 0, 10.0, 20.0, 30.0, 40.0)
    assert document.widened(w, hit, 100.0) == hit
    assert document.widened(words([word(1, "x", 10, 20), word(2, "y", 90, 22)]), hit, 96.0) == ("x y", 0, 2.0, 12.0, 96.0, 40.0)


def test_missing_table_and_party():
    doc = Document(words([word(1, "nothing", 0, 0)]))
    assert doc.lines(("LN", "QTY"), re.compile("subtotal")) == [] and doc.party("SELLER") == {} and doc.rates() == [] and doc.last_figure("subtotal") is None
    assert document.read(Words())[0] == "NO_TEXT_LAYER" and Document(Words()).page_count == 0


INVOICE = {
    "document_id": "INV-1", "issue_date": "1.2.2025", "due_date": None, "currency": None, "payment_terms": "Not stated", "po_reference": "none given", "seller": {"name": "A  B Oy", "vendor_id": "V1", "tax_registration": "T.1", "location": "Oslo"}, "buyer": None,
    "lines": [{"line_number": n, "description": f"Pipe {n} x", "unit_of_measure": "EA", "quantity": 2.0, "unit_price": 1050.5, "net_amount": 2101.0, "tax_rate": 24.0, "tax_amount": None, "line_total": 2605.24} for n in range(1, 40)],
    "totals": {"subtotal": 21.0, "tax_total": None, "grand_total": 26.04},
}


def test_an_invoice_is_read_with_its_positions(spark):
    status, record, positions = document.read(W.print_invoice(INVOICE), W.HEIGHT)
    place = {p[0]: p[1:] for p in positions}
    assert status == "OK" and record["document_type"] == "invoice" and record["page_count"] == W.row_page(43) + 1 > 2
    assert (record["currency"], record["currency_defaulted"]) == ("EUR", True) and not {"due_date", "payment_terms", "po_reference", "buyer"} & set(record)
    assert record["seller"] == ("A B Oy", "V1", "T.1", "Oslo") and record["totals"] == (21.0, None, 26.04) and record["removed_duplicates"] == []
    assert [x[0] for x in record["lines"]] == list(range(1, 40)) and record["lines"][0] == (1, "Pipe 1 x", "EA", 2.0, 1050.5, 2101.0, 24.0, 2605.24, 504.24)
    assert place["document_id"][0] == 0 and place["lines[0].unit_price"][0] == 0 and place["lines[38].line_total"][0] == W.row_page(38) and place["totals.grand_total"][0] == W.row_page(42)
    assert {"payment_terms", "po_reference", "seller.name", "lines[3].description", "lines[3].unit_of_measure"} <= set(place) and not {"due_date", "totals.tax_total", "lines[0].tax_amount", "lines[39].unit_price"} & set(place)


def test_located_fields_have_their_values(spark):
    _, record, positions = document.read(W.print_invoice(INVOICE), W.HEIGHT)
    value = {p[0]: document.value_at(record, p[0]) for p in positions}
    assert value["document_id"] == "INV-1" and value["seller.name"] == "A B Oy" and value["lines[1].unit_price"] == "1050.5" and value["lines[1].quantity"] == "2" and value["totals.grand_total"] == "26.04"
    assert value["payment_terms"] is None and value["po_reference"] is None  # printed, but what is printed is that there is none
    df = spark.createDataFrame([(1, INVOICE["document_id"], None, None, None, None, None, None, None, None, None)], "row_id long, document_id string, issue_date string, due_date string, currency string, payment_terms string, po_reference string, seller struct<name:string>, buyer struct<name:string>, lines array<struct<line_number:int>>, totals struct<subtotal:double>")
    assert [(r["field_path"], r["value"], r["page"]) for r in extract.located(W.printed_documents(df, "invoices")).collect()] == [("document_id", "INV-1", 0)]


def test_a_doubled_text_layer_reads_as_the_clean_document(spark):
    from tallyfold.plans import reading

    clean, doubled = (document.read(w, W.HEIGHT) for w in (W.print_invoice(INVOICE), reading._twice(W.print_invoice(INVOICE))))
    note = doubled[1].pop("removed_duplicates")
    assert clean[1].pop("removed_duplicates") == [] and clean == doubled
    assert note == [(None, None, None, len(W.print_invoice(INVOICE)), document.OVERLAID)]


def test_a_row_on_a_page_seam_counts_once_and_a_true_duplicate_twice():
    from tallyfold.plans import reading

    seamed = document.read(reading._seamed(W.print_invoice(INVOICE)), W.HEIGHT)[1]
    assert [x[0] for x in seamed["lines"]] == list(range(1, 40))
    assert [(r[0], r[2], r[4]) for r in seamed["removed_duplicates"]] == [(W.FIRST_ROWS, 2, document.SEAM), (W.FIRST_ROWS + W.NEXT_ROWS, 3, document.SEAM)]
    twice = document.read(W.print_invoice(INVOICE | {"lines": INVOICE["lines"][:3] + INVOICE["lines"][1:2]}), W.HEIGHT)[1]
    assert [x[0] for x in twice["lines"]] == [1, 2, 3, 2] and twice["removed_duplicates"] == []


# A catalogue of goods and services.
CATALOGUE = [
    ("RRU 4415 radio unit", "EA", 1250.00), ("Fibre trunk cable 500m", "EA", 1250.00), ("Installation services", "HR", 95.00), ("Site survey", "DAY", 640.00), ("Antenna mount bracket", "EA", 78.50),
    ("Baseband module BB6630", "EA", 3180.00), ("Microwave link 80GHz", "EA", 4120.00), ("Power distribution unit", "EA", 890.00), ("Cabinet thermal kit", "EA", 445.00), ("Commissioning and test", "DAY", 720.00),
    ("Tower climb crew", "DAY", 1180.00), ("Spare parts kit A", "EA", 336.00), ("Optical patch panel", "EA", 214.00), ("Grounding kit", "EA", 96.50), ("Remote monitoring licence", "YR", 1540.00),
]
#: Known documents: (table, lines, first entry, printed error of the subtotal or order value, sum of the lines, checks)
KNOWN = {
    "I1": ("invoices", 26, 0, 0.0, 136343.50, 81), "I2": ("invoices", 34, 3, -4000.0, 178532.00, 105), "I3": ("invoices", 21, 6, 0.0, 137287.00, 66), "I4": ("invoices", 48, 1, 0.0, 329751.00, 147), "I5": ("invoices", 30, 9, 0.0, 152262.00, 93),
    "P1": ("purchase_orders", 26, 0, 0.0, 136343.50, 27), "P2": ("purchase_orders", 48, 1, 0.0, 329751.00, 49), "P3": ("purchase_orders", 33, 4, -2500.0, 225783.00, 34), "P4": ("purchase_orders", 19, 7, 0.0, 114192.00, 20),
}


def test_known_documents_are_read_and_checked(spark):
    from tallyfold.operators import arithmetic

    rows = []
    for name, (table, count, start, error, *_) in KNOWN.items():
        lines = W.catalogue_lines(CATALOGUE, count, start)
        net = round(sum(x["net_amount"] for x in lines), 2)
        tax = round(sum(x["line_total"] - x["net_amount"] for x in lines), 2)
        record = dict.fromkeys(W.PRINTERS[table][1]) | {"document_id": name, "lines": lines, "totals": {"subtotal": net + error, "tax_total": tax, "grand_total": net + error + tax}, "order_value": net + error}
        w = W.PRINTERS[table][0](record)
        rows += [(name, p, k, *x) for k, (p, *x) in enumerate(zip(w.page, w.text, w.x0, w.y0, w.x1, w.y1))]
    read = extract.records(layout.Documents.of_words(frame(spark, rows), W.HEIGHT)).cache()
    for r in read.collect():
        table, count, start, error, net, _ = KNOWN[r["doc_id"]]
        want = W.catalogue_lines(CATALOGUE, count, start)
        assert r["status"] == "OK" and r["document_id"] == r["doc_id"] and not r["removed_duplicates"]
        fields = ("line_number", "description", "unit_of_measure", "quantity", "unit_price", "net_amount") + (("tax_rate", "line_total") if table == "invoices" else ())
        assert [tuple(x[f] for f in fields) for x in r["lines"]] == [tuple(x[f] for f in fields) for x in want]
    reports = {r["doc_id"]: r for r in arithmetic.reports(arithmetic.documents(read, "doc_id")).collect()}
    for name, (table, _, _, error, net, checks) in KNOWN.items():
        r = reports[name]
        assert (r["checks_run"], float(r["lines_net"])) == (checks, net)
        found = [(d["check"], d["severity"], float(d["difference"])) for d in r["discrepancies"]]
        assert found == ([("subtotal" if table == "invoices" else "order_value", "material", error)] if error else [])
    assert sum(k[5] for k in KNOWN.values()) == 622


def test_no_decoder_is_a_row(spark, tmp_path):
    (tmp_path / "b.pdf").write_bytes(b"%PDF-1.4 broken")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "A.PDF.pdf").write_bytes(b"%")
    (tmp_path / "note.txt").write_text("no")
    assert [r["doc_id"] for r in W.pdf_files(spark, str(tmp_path)).collect()] == ["A.PDF", "b"]
    got = W.pdf_words(spark, str(tmp_path)).orderBy("path").collect()
    assert len(got) == 2 and got[0]["status"] != "OK"
    read = extract.records(W.pdf_documents(spark, str(tmp_path))).collect()
    assert {r["doc_id"] for r in read} == {"A.PDF", "b"} and all(r["status"] == got[0]["status"] or r["status"].startswith("UNREADABLE") for r in read) and all(r["positions"] == [] for r in read)
    asked = spark.createDataFrame([(got[0]["path"], 0, *[0.0, 0.0, 10.0, 10.0] * 2)], "path string, page int, x0 double, y0 double, x1 double, y1 double, cx0 double, cy0 double, cx1 double, cy1 double")
    cut = W.pdf_crops(spark, str(tmp_path), asked, outlined=True).collect()
    assert len(cut) == 1 and cut[0]["png"] is None and cut[0]["status"] == got[0]["status"]


def test_reading_queries_take_all_tables(spark, tiny):
    from tallyfold.plans import reading
    from tallyfold.sources.tables import table

    rows = reading.overlaid_layers(spark, tiny).collect()
    for name in ("invoices", "purchase_orders", "contracts"):
        assert sum(r["table_name"] == name for r in rows) == table(spark, tiny, name).count()
    assert all(r["dropped"] == r["words"] for r in rows)
    kept = reading.artefacts_removed(spark, tiny).collect()
    assert {r["table_name"] for r in kept if r["printed"]} == {"invoices", "purchase_orders"}
    assert all(r["kept"] + r["removed"] == 3 * r["printed"] and r["removed"] >= r["printed"] for r in kept)
    status = {(r["table_name"], r["doc_id"]) for r in reading.layout_status(spark, tiny).where("page_count > 1").collect()}
    furniture = reading.page_furniture(spark, tiny).collect()
    assert {(r["table_name"], r["doc_id"]) for r in furniture} == status and all(r["removed"] == 2 * r["page_count"] for r in furniture)
