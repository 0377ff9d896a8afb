"""One document as positioned words: its rows, what is printed where, and the record it holds.

Plain Python over the words of a single document; ``layout``, ``lookup`` and ``extract`` run
it in Arrow batches over relations of documents, each document where it lies. Row clustering,
artefact removal and the assignment of figures to columns each depend on what was decided
before, which is why they are loops here and not expressions.

Defined cases: words with a null text or coordinate are dropped; of words with the same text
at the same place (to a tenth of a point) the first counts; what is not printed is None,
never zero or empty; the first match wins and nothing falls through: where the first row with
a label's words lacks the label's first word, the field is absent even if a later row has it;
a table without its header has no lines; a row whose first word is no number is no line; a
line without quantity or price is none; a repeated line is kept unless it stands at the same
place or on a page break, and what is removed is recorded with its reason.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from decimal import ROUND_HALF_UP, Decimal

from tallyfold.functions.numbers import CURRENCIES

# Tolerances and distances in points, the share of a page that is its band, and lengths.
ROW_TOLERANCE, FURNITURE_BAND, HEADER_CHARS = 3.0, 0.12, 400
LABEL_GAP, COLUMN_DRIFT, PARTY_COLUMN = 24.0, 30.0, 150.0
LABEL_CLEARANCE, VALUE_GAP, LABEL_ROWS = 3.0, 12.0, 2
COLUMN_REACH, PARTY_ROWS = 40.0, 8
BESIDE_DX, BESIDE_DY, BESIDE_WIDTH, ROW_MARGIN = 26.0, 22.0, 140.0, 8.0
# Markers of the three layouts in order of priority, headings of figure columns and where each figure may stand, reasons.
MARKERS = (("COMMERCIAL INVOICE", "invoice"), ("PURCHASE ORDER", "purchase_order"), ("MASTER SUPPLY AGREEMENT", "contract"))
FIGURE_HEADINGS = frozenset(("QTY", "ORDERED", "UNIT", "PRICE", "NET", "VAT", "LINE", "TOTAL", "UOM"))
RATE_HEADINGS = frozenset(("UOM", "MAXIMUM", "UNIT", "RATE"))
COLUMNS = (("quantity", ("QTY", "ORDERED")), ("unit_price", ("PRICE",)), ("net_amount", ("NET",)), ("tax_rate", ("VAT",)), ("line_total", ("TOTAL",)))
SAME_PLACE, SEAM = "same row printed twice at the same position", "row on a page break, rendered onto both pages"
OVERLAID = "text printed twice at the same coordinates (more than one text layer on the page)"

_CURRENCY = re.compile(rf"(?:{'|'.join(CURRENCIES)})\s*(?=[0-9(-])", re.I)
_FIGURE = re.compile(r"-?[0-9,]+\.?[0-9]*")
_DIGITS = re.compile(r"[0-9]+")
_TERMS = re.compile(r"settled on (Net [0-9]+) terms")

Box = tuple[int, float, float, float, float]  # page, x0, y0, x1, y1
Span = tuple[float, float, float, float]


@dataclass(slots=True)
class Words:
    """Words in the order of extraction, as columns.

    pages: how many there are, blank ones included; height: of the first page, if it is known;
    status: why there are no words, if a file could not be opened.
    """

    page: list[int] = field(default_factory=list)
    text: list[str] = field(default_factory=list)
    x0: list[float] = field(default_factory=list)
    y0: list[float] = field(default_factory=list)
    x1: list[float] = field(default_factory=list)
    y1: list[float] = field(default_factory=list)
    pages: int = 0
    height: float | None = None
    status: str | None = None

    def add(self, page: int, text: str, x0: float, y0: float, x1: float, y1: float) -> None:
        self.page.append(page), self.text.append(text), self.x0.append(x0), self.y0.append(y0), self.x1.append(x1), self.y1.append(y1)

    def __len__(self) -> int:
        return len(self.text)

    def box(self, words: list[int]) -> Box:
        """The union of the boxes of some words."""
        if len(words) == 1:
            return self.at(words[0])
        return self.page[words[0]], min(self.x0[w] for w in words), min(self.y0[w] for w in words), max(self.x1[w] for w in words), max(self.y1[w] for w in words)

    def at(self, word: int) -> Box:
        """The box of one word."""
        return self.page[word], self.x0[word], self.y0[word], self.x1[word], self.y1[word]

    def joined(self, words: Iterable[int]) -> str:
        return " ".join([self.text[w] for w in words])


def single(words: Words) -> tuple[list[int], int]:
    """Positions of the words that count, and how many are repeats of one at the same place."""
    seen: set[tuple] = set()
    kept, repeats = [], 0
    tenth: dict[float, float] = {}
    for w, (page, text, x, y) in enumerate(zip(words.page, words.text, words.x0, words.y0)):
        if page is None or text is None or x is None or y is None:
            continue
        if (top := tenth.get(y)) is None:
            top = tenth[y] = round(y, 1)
        key = (page, text, round(x, 1), top)
        if key in seen:
            repeats += 1
        else:
            seen.add(key)
            kept.append(w)
    return kept, repeats


def clustered(words: Words, kept: Iterable[int]) -> list[list[int]]:
    """Rows in page order: a word opens a row where it stands more than the tolerance from the row's first word; then left to right."""
    page, x0, y0 = words.page, words.x0, words.y0
    rows: list[list[int]] = []
    at, anchor = None, 0.0
    kept = list(kept)
    tenth = {y: round(y, 1) for y in {y0[w] for w in kept}}
    for w in sorted(kept, key=lambda w: (page[w], tenth[y0[w]], x0[w])):
        if page[w] != at or abs(y0[w] - anchor) > ROW_TOLERANCE:
            at, anchor = page[w], y0[w]
            rows.append([w])
        else:
            rows[-1].append(w)
    left = x0.__getitem__
    for row in rows:
        row.sort(key=left)
    return rows


def figure(text: str) -> float | None:
    """The figure a word is, with thousands separators and after its currency; None if it is none."""
    text = text.strip()
    if m := _CURRENCY.match(text):
        text = text[m.end() :]
    if not _FIGURE.fullmatch(text):
        return None
    try:
        return float(text.replace(",", ""))
    except ValueError:
        return None


def _cents(value: float) -> Decimal:
    return Decimal(repr(value)).quantize(Decimal("0.000001"), ROUND_HALF_UP)


class Document:
    """Rows of a document with its page furniture apart, and lookups by what is printed where."""

    def __init__(self, words: Words, height: float | None = None) -> None:
        self.words = words
        height = height if words.height is None else words.height
        kept, self.repeats = single(words)
        self.all_rows = clustered(words, kept)
        self.texts = [words.joined(r) for r in self.all_rows]
        self.page_count = max(words.pages, 1 + max((words.page[r[0]] for r in self.all_rows), default=-1))
        away = self._furniture(height)
        self.furniture = [self.texts[k] for k in sorted(away)]
        body = [k for k in range(len(self.all_rows)) if k not in away]
        self.rows = [self.all_rows[k] for k in body]
        self.text = [self.texts[k] for k in body]
        self._low: list[str] | None = None

    def _furniture(self, height: float | None) -> set[int]:
        """Rows in the top or bottom band that stand at the same height, with the same wording but for figures, more than once."""
        if self.page_count < 2 or height is None:
            return set()
        band = height * FURNITURE_BAND
        shapes: dict[tuple, list[int]] = {}
        for k, row in enumerate(self.all_rows):
            y = self.words.y0[row[0]]
            if not band < y < height - band:
                shapes.setdefault((round(y), _DIGITS.sub("#", self.texts[k])), []).append(k)
        return {k for same in shapes.values() if len(same) > 1 for k in same}

    @property
    def low(self) -> list[str]:
        if self._low is None:
            self._low = [t.lower() for t in self.text]
        return self._low

    def kind(self) -> str | None:
        """Type of the document by the first marker in the first characters of its pages."""
        pages: dict[int, list[str]] = {}
        for row, text in zip(self.all_rows, self.texts):
            pages.setdefault(self.words.page[row[0]], []).append(text)
        header = "\n".join("\n".join(lines)[:HEADER_CHARS] for lines in pages.values()).upper()
        return next((kind for marker, kind in MARKERS if marker in header), None)

    def row_with(self, *needles: str) -> int | None:
        """The first row containing all needles, in any order and case."""
        wanted = [n.lower() for n in needles]
        return next((k for k, text in enumerate(self.low) if all(n in text for n in wanted)), None)

    def below(self, label: str) -> tuple[str, Box] | None:
        """The value printed beneath a label, left-aligned to it, up to the first wide gap."""
        w, parts = self.words, label.lower().split()
        head = self.row_with(*parts)
        if head is None:
            return None
        row = self.rows[head]
        anchor = next((w.x0[k] for k in row if w.text[k].lower().rstrip(":") == parts[0]), None)
        if anchor is None:
            return None
        page, top, bottom = w.page[row[0]], w.y0[row[0]], w.y1[row[0]]
        fits = [
            (w.y0[k], w.x0[k], r, n)
            for r in range(head + 1, min(head + 1 + LABEL_ROWS, len(self.rows)))
            if w.page[self.rows[r][0]] == page
            for n, k in enumerate(self.rows[r])
            if abs(w.x0[k] - anchor) <= COLUMN_DRIFT and w.y0[k] > top + LABEL_CLEARANCE and w.y0[k] - bottom < LABEL_GAP
        ]
        if not fits:
            return None
        _, x, r, n = min(fits)
        value = [self.rows[r][n]]
        for k in self.rows[r][n + 1 :]:
            if w.x0[k] == x:
                continue
            if w.x0[k] - w.x1[value[-1]] > VALUE_GAP:
                break
            value.append(k)
        return w.joined(value), w.box(value)

    def last_figure(self, label: str) -> tuple[float, Box] | None:
        """The last figure in the first row containing a label."""
        at = self.row_with(label)
        for k in reversed(self.rows[at] if at is not None else []):
            if (value := figure(self.words.text[k])) is not None:
                return value, self.words.at(k)
        return None

    def party(self, label: str) -> dict[str, tuple[str, Box]]:
        """What is printed beneath a heading: name, vendor_id, tax_registration and location, those that are there."""
        w, parts = self.words, label.split()
        head = self.row_with(*parts)
        if head is None:
            return {}
        row = self.rows[head]
        anchor = next((w.x0[k] for k in row if w.text[k].upper().rstrip(":") == parts[0].upper()), None)
        found: dict[str, tuple[str, Box]] = {}
        for below in self.rows[head + 1 : head + 1 + PARTY_ROWS] if anchor is not None else []:
            if w.page[below[0]] != w.page[row[0]]:
                break
            inside = [k for k in below if -COLUMN_DRIFT <= w.x0[k] - anchor <= PARTY_COLUMN]
            text = w.joined(inside).strip()
            if not text:
                continue
            low = text.lower()
            if not found:
                what, value = "name", text
            elif text.isupper() and len(text.split()) <= 3:
                break
            elif low.startswith("account"):
                what, value = "vendor_id", text.split(None, 1)[-1]
            elif low.startswith("tax reg"):
                what, value = "tax_registration", text.partition(".")[2].strip() if "." in text else text
            elif "location" not in found:
                what, value = "location", text
            else:
                continue
            found[what] = value, w.box(inside)
        return found

    def _table(self, header: tuple[str, ...], stop: re.Pattern) -> tuple[list[int], list[list[int]]] | None:
        """Words of the header row, and the rows after it up to the stop row."""
        head = self.row_with(*header)
        if head is None:
            return None
        end = next((k for k in range(head + 1, len(self.rows)) if stop.search(self.text[k])), len(self.rows))
        return self.rows[head], self.rows[head + 1 : end]

    def _heading(self, k: int) -> str:
        return self.words.text[k].upper().rstrip("%")

    def _parted(self, row: list[int], zone: float) -> tuple[list[tuple[int, float]], list[int]]:
        """Figures in the zone of figure columns, with their values, and the other words."""
        figures, others = [], []
        for k in row:
            value = figure(self.words.text[k]) if self.words.x0[k] >= zone - COLUMN_DRIFT else None
            figures.append((k, value)) if value is not None else others.append(k)
        return figures, others

    def lines(self, header: tuple[str, ...], stop: re.Pattern) -> list[Line]:
        """Line items as printed, before repeats are removed."""
        table = self._table(header, stop)
        if table is None:
            return []
        w, (head, body) = self.words, table
        names = [self._heading(k) for k in head]
        zone = min((w.x0[k] for k, name in zip(head, names) if name in FIGURE_HEADINGS), default=0.0)
        right = {name: w.x1[k] for k, name in zip(head, names)}  # a later equal heading counts
        edges = [(column, n, right[h]) for n, (column, headings) in enumerate(COLUMNS) for h in headings if h in right]
        out = []
        for row in body:
            first = w.text[row[0]]
            if not (first.isascii() and first.isdigit() and int(first) < 1 << 31):
                continue
            figures, others = self._parted(row[1:], zone)
            given = assigned([(w.x1[k], v) for k, v in figures], edges)
            if "quantity" not in given or "unit_price" not in given:
                continue
            unit = others[-1:] if "UOM" in right and len(others) > 1 else []
            described = others[: len(others) - len(unit)]
            value = {c: figures[given[c]][1] if c in given else None for c, _ in COLUMNS}
            tax = None
            if value["tax_rate"] is not None and value["net_amount"] is not None and value["line_total"] is not None:
                tax = float((_cents(value["line_total"]) - _cents(value["net_amount"])).quantize(Decimal("0.01"), ROUND_HALF_UP))
            record = (int(first), w.joined(described) if others else None, w.text[unit[0]] if unit else None, *value.values(), tax)
            places = {c: w.at(figures[n][0]) for c, n in given.items()}
            if others:
                places["description"] = w.box(others)
            if unit:
                places["unit_of_measure"] = w.box(unit)
            out.append(Line(record, w.page[row[0]], w.y0[row[0]], places))
        return out

    def rates(self) -> list[tuple[tuple, dict[str, Box]]]:
        """Terms of a rate schedule: (description, unit_of_measure, max_unit_price), and their places."""
        table = self._table(("ITEM DESCRIPTION", "MAXIMUM"), _CLAUSE)
        if table is None:
            return []
        w, (head, body) = self.words, table
        zone = min((w.x0[k] for k in head if self._heading(k) in RATE_HEADINGS), default=0.0)
        out = []
        for row in body:
            figures, others = self._parted(row, zone)
            if not figures:
                continue
            places = {"max_unit_price": w.at(figures[-1][0])}
            if others:
                places["description"] = w.box(others)
            out.append(((w.joined(others[:-1]) or w.text[others[0]] if others else None, w.text[others[-1]] if others else None, figures[-1][1]), places))
        return out


@dataclass(slots=True)
class Line:
    """A printed line item: its record, where its row stands, and the places of its fields."""

    record: tuple
    page: int
    y0: float
    places: dict[str, Box]


LINE_FIELDS = ("line_number", "description", "unit_of_measure", *(c for c, _ in COLUMNS), "tax_amount")
_CLAUSE = re.compile(r"clause|renewal|synthetic", re.I)


def assigned(figures: list[tuple[float, float]], edges: list[tuple[str, int, float]]) -> dict[str, int]:
    """Column -> number of its figure: closest pair of right edges first, each column and each figure at most once."""
    near = sorted((abs(edge - x1), n, order, column) for n, (x1, _) in enumerate(figures) for column, order, edge in edges if abs(edge - x1) < COLUMN_REACH)
    given: dict[str, int] = {}
    used: set[int] = set()
    for _, n, _, column in near:
        if n not in used and column not in given:
            given[column] = n
            used.add(n)
    return given


def without_artefacts(printed: Iterable[Line]) -> tuple[list[Line], list[tuple]]:
    """(lines, removed): lines that stand twice at one place, or directly after themselves on the next page, count once."""
    kept: list[Line] = []
    places: dict[tuple, list[tuple[int, float]]] = {}
    removed = []
    for x in printed:
        same = places.setdefault(x.record, [])
        if any(page == x.page and abs(y - x.y0) <= 2 * ROW_TOLERANCE for page, y in same):
            reason = SAME_PLACE
        elif kept and kept[-1].record == x.record and x.page - kept[-1].page == 1:
            reason = SEAM
        else:
            kept.append(x)
            same.append((x.page, x.y0))
            continue
        removed.append((x.record[0], x.record[1], x.page + 1, None, reason))
    return kept, removed


#: Of each type: its source system, labelled fields, party blocks, the header of its table and the row that ends it, and labelled totals.
LAYOUTS = {
    "invoice": (
        "SharePoint",
        {"document_id": "INVOICE NUMBER", "issue_date": "ISSUE DATE", "due_date": "DUE DATE", "currency": "CURRENCY", "payment_terms": "TERMS", "po_reference": "PURCHASE ORDER REFERENCE"},
        {"seller": "SELLER", "buyer": "BILL TO"}, (("LN", "DESCRIPTION", "QTY"), re.compile("subtotal", re.I)),
        {"totals.subtotal": "subtotal", "totals.tax_total": "vat total", "totals.grand_total": "total due"},
    ),
    "purchase_order": (
        "SAP",
        {"document_id": "PO NUMBER", "order_date": "ORDER DATE", "delivery_date": "DELIVERY BY", "requisition_number": "REQUISITION", "currency": "CURRENCY", "payment_terms": "PAYMENT TERMS", "contract_reference": "CONTRACT REFERENCE"},
        {"vendor": "SUPPLIER"}, (("ITEM", "ORDERED", "NET"), re.compile("order value", re.I)), {"order_value": "order value"},
    ),
    "contract": (
        "CLM",
        {"document_id": "CONTRACT REFERENCE", "effective_date": "EFFECTIVE DATE", "expiry_date": "EXPIRY DATE", "governing_law": "GOVERNING LAW"},
        {"counterparty": "COUNTERPARTY"}, None, {},
    ),
}
PARTY_FIELDS = ("name", "vendor_id", "tax_registration", "location")


def read(words: Words, height: float | None = None) -> tuple[str, dict, list[tuple]]:
    """(status, record, positions) of a document; positions are (field_path, page, x0, y0, x1, y1).

    The record has what its layout prints, ``page_count``, ``removed_duplicates`` and, where
    the currency is not printed, EUR and ``currency_defaulted``.
    """
    doc = Document(words, height)
    record: dict = {"page_count": doc.page_count}
    if not doc.all_rows:
        return words.status or "NO_TEXT_LAYER", record, []
    kind = doc.kind()
    if kind is None:
        return "UNKNOWN_LAYOUT", record, []
    record["document_type"] = kind
    record["source_system"], labels, parties, table, totals = LAYOUTS[kind]
    positions: list[tuple] = []
    for path, label in labels.items():
        if (found := doc.below(label)) is not None:
            record[path] = found[0]
            positions.append((path, *found[1]))
    if kind != "contract":
        record["currency_defaulted"] = "currency" not in record
        record.setdefault("currency", "EUR")
    if kind == "invoice" and record.get("payment_terms", "").lower() == "not stated":
        del record["payment_terms"]
    if kind == "invoice" and "none" in record.get("po_reference", "").lower():
        del record["po_reference"]
    if kind == "purchase_order" and record.get("contract_reference", "").lower() == "none":
        del record["contract_reference"]
    for role, label in parties.items():
        if block := doc.party(label):
            record[role] = tuple(block[f][0] if f in block else None for f in PARTY_FIELDS)
            positions += [(f"{role}.{f}", *place) for f, (_, place) in block.items()]
    removed: list[tuple] = []
    if table is not None:
        lines, removed = without_artefacts(doc.lines(*table))
        record["lines"] = [x.record for x in lines]
        positions += [(f"lines[{k}].{f}", *place) for k, x in enumerate(lines) for f, place in x.places.items()]
    else:
        terms = doc.rates()
        record["rate_schedule"] = [t for t, _ in terms]
        positions += [(f"rate_schedule[{k}].{f}", *place) for k, (_, places) in enumerate(terms) for f, place in places.items()]
        if m := _TERMS.search("\n".join(doc.text)):
            record["payment_terms"] = m.group(1)
    figures = {}
    for path, label in totals.items():
        if (found := doc.last_figure(label)) is not None:
            figures[path] = found[0]
            positions.append((path, *found[1]))
    if kind == "invoice":
        record["totals"] = tuple(figures.get(path) for path in totals)
    record.update((path, value) for path, value in figures.items() if "." not in path)
    if doc.repeats:
        removed = [*removed, (None, None, None, doc.repeats, OVERLAID)]
    record["removed_duplicates"] = removed
    return "OK", record, positions


_STEP = re.compile(r"([a-z_]+)(?:\[([0-9]+)\])?")
_MEMBERS = {
    **dict.fromkeys(("seller", "buyer", "vendor", "counterparty"), PARTY_FIELDS), "lines": LINE_FIELDS, "rate_schedule": ("description", "unit_of_measure", "max_unit_price"), "totals": ("subtotal", "tax_total", "grand_total"),
}


def value_at(record: dict, path: str) -> str | None:
    """The value of a field of a read record as text, figures without trailing zeros; None where it is not printed."""
    first, _, member = path.partition(".")
    name, number = _STEP.fullmatch(first).groups()
    value = record.get(name)
    if number is not None:
        value = value[int(number)]
    if member and value is not None:
        value = value[_MEMBERS[name].index(member)]
    if isinstance(value, float):
        return f"{Decimal(repr(value)).quantize(Decimal('0.000001'), ROUND_HALF_UP):f}".rstrip("0").rstrip(".")
    return None if value is None else str(value)


# Places of texts in words; a hit is (text, page, x0, y0, x1, y1).
Hit = tuple[str, int, float, float, float, float]


def located(words: Words) -> list[int]:
    """Words that have a text and a place."""
    return [k for k, at in enumerate(zip(words.page, words.text, words.x0, words.y0)) if None not in at]


def literal(words: Words, needle: str) -> Iterator[tuple[int, Hit]]:
    """(number of its row on the page, hit): contiguous words of one row that are the words of the needle, in the same case.

    Overlaid text is found as often as it is there.
    """
    parts = needle.split()
    if not parts or not set(parts) <= set(words.text):
        return
    page, number = None, 0
    for row in clustered(words, located(words)):
        at = words.page[row[0]]
        page, number = at, number + 1 if at == page else 0
        texts = [words.text[k] for k in row]
        for n in range(len(row) - len(parts) + 1):
            if texts[n : n + len(parts)] == parts:
                yield number, (needle, *words.box(row[n : n + len(parts)]))


def pattern(words: Words, regex: re.Pattern) -> Iterator[Hit]:
    """Single words in which a regular expression is found."""
    for k, text in enumerate(words.text):
        if text is not None and regex.search(text):
            yield text, words.page[k], words.x0[k], words.y0[k], words.x1[k], words.y1[k]


def beside(words: Words, hits: Iterable[Hit], direction: str) -> Iterator[Hit]:
    """The value right of or below the first hit of each page."""
    first: dict[int, Hit] = {}
    for h in hits:
        if h[1] not in first or (h[3], h[2]) < (first[h[1]][3], first[h[1]][2]):
            first[h[1]] = h
    for page, (_, _, ax0, ay0, ax1, ay1) in sorted(first.items()):
        on_page = [k for k, p in enumerate(words.page) if p == page]
        if direction == "below":
            near = [k for k in on_page if words.y0[k] > ay1 and abs(words.x0[k] - ax0) < BESIDE_DX and words.y0[k] - ay1 < BESIDE_DY]
            near.sort(key=lambda k: (words.y0[k], words.x0[k]))
        else:
            near = [k for k in on_page if words.x0[k] > ax1 and abs(words.y0[k] - ay0) < ROW_TOLERANCE]
            near.sort(key=lambda k: (words.x0[k], words.y0[k]))
        if near:
            at = near[0]
            group = sorted((k for k in near if abs(words.y0[k] - words.y0[at]) < ROW_TOLERANCE and words.x0[k] - words.x0[at] < BESIDE_WIDTH), key=words.x0.__getitem__)
            yield words.joined(group), *words.box(group)


def widened(words: Words, hit: Hit, width: float | None) -> Hit:
    """A hit widened to all words at its height, x clamped to the page; where there are none, the hit itself."""
    _, page, _, y0, _, _ = hit
    near = sorted((k for k, p in enumerate(words.page) if p == page and abs(words.y0[k] - y0) <= ROW_TOLERANCE), key=words.x0.__getitem__)
    if not near:
        return hit
    _, left, top, right, bottom = words.box(near)
    right += ROW_MARGIN
    return words.joined(near), page, max(0.0, left - ROW_MARGIN), top - ROW_MARGIN, right if width is None else min(width, right), bottom + ROW_MARGIN
