"""Functions for an agent: plain dictionaries in and out, never an exception.

A ``Workbench`` holds the parsed tables of a session; each call selects one document by an
equality on its id (there are no paths, hence none to escape from) and answers with ``ok``
and either the result or ``error``. Rectangles have one decimal, figures are floats.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.functions.text import slug
from tallyfold.operators import arithmetic, evidence, extract, lookup, render
from tallyfold.operators.layout import Documents


def _fail(message: str, **extra: Any) -> dict[str, Any]:
    return {"ok": False, "error": message, **extra}


def _safe(call: Callable[..., dict[str, Any]]) -> Callable[..., dict[str, Any]]:
    def run(*args: Any, **kwargs: Any) -> dict[str, Any]:
        try:
            return call(*args, **kwargs)
        except Exception as e:  # noqa: BLE001 - the contract of this surface
            return _fail(f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}")

    run.__name__, run.__doc__ = call.__name__, call.__doc__
    return run


@dataclass
class Workbench:
    """Parsed documents (document_id and any fields), and optionally their words, pages and positions."""

    documents: DataFrame
    words: DataFrame | None = None
    pages: DataFrame | None = None
    positions: DataFrame | None = None

    @staticmethod
    def of_words(words: DataFrame, pages: DataFrame | None = None, height: float | None = None) -> Workbench:
        """A workbench over documents that are read from their words; its ids are those of the relation of words."""
        read = extract.records(Documents.of_words(words, height))
        places = extract.positions(read).withColumn("document_id", F.col("doc_id").cast("string"))
        return Workbench(read.withColumn("printed_id", F.col("document_id")).withColumn("document_id", F.col("doc_id").cast("string")).drop("doc_id", "positions"), words, pages, places.drop("doc_id"))

    @staticmethod
    def _id(document_id: object) -> str | None:
        """The id that is meant: the last part of a path, without ``.pdf``; None for what can't be one."""
        name = document_id.strip().replace("\\", "/").rpartition("/")[2] if isinstance(document_id, str) else ""
        return name.removesuffix(".pdf") or None if not name.startswith(".") else None

    def _one(self, document_id: object) -> DataFrame | None:
        name = self._id(document_id)
        one = self.documents.where(F.col("document_id") == name) if name else None
        return one if one is not None and one.take(1) else None

    @_safe
    def read_document_fields(self, document_id: str) -> dict[str, Any]:
        """The document and the paths of its fields that have a place on a page."""
        one = self._one(document_id)
        if one is None:
            return _fail(f"no document {document_id!r}")
        document = one.first().asDict(recursive=True)
        if document.get("status", "OK") != "OK":
            return _fail(f"{document_id!r} cannot be read: {document['status']}", requires_extraction_service=document["status"] == "NO_TEXT_LAYER")
        located: list[str] = []
        if self.positions is not None:
            located = sorted(r[0] for r in self.positions.where(F.col("document_id") == self._id(document_id)).select("field_path").distinct().collect())
        return {"ok": True, "document": document, "locatable_fields": located}

    @_safe
    def check_document_arithmetic(self, document_id: str, reporting_tolerance: float = 1.00) -> dict[str, Any]:
        """Discrepancies of one document, material ones apart from rounding."""
        one = self._one(document_id)
        if one is None:
            return _fail(f"no document {document_id!r}")
        docs = arithmetic.documents(one.withColumn("_key", F.lit(1)), "_key")
        report = arithmetic.reports(docs, reporting=str(reporting_tolerance)).first().asDict(recursive=True)
        found = [{k: float(v) if k in ("expected", "stated", "difference", "percentage") and v is not None else v for k, v in d.items()} for d in report["discrepancies"]]
        return {
            "ok": True, "document_id": self._id(document_id), "checks_run": report["checks_run"], "balanced": report["balanced"],
            "material_discrepancies": [d for d in found if d["severity"] == "material"], "rounding_only": [d for d in found if d["severity"] == "rounding"],
            "computed": {k: float(report[k]) for k in ("lines_net", "lines_tax", "lines_gross")},
        }

    def _hits(self, document_id: object, search_text: str) -> list[dict[str, Any]] | str:
        """Hits in order, or why there can be none."""
        if self.words is None:
            return "no words are loaded"
        if self._one(document_id) is None:
            return f"no document {document_id!r}"
        words = self.words.where(F.col("doc_id") == self._id(document_id))
        if not words.take(1):
            return f"{document_id!r} has no text layer"
        hits = lookup.search(Documents.of_words(words), search_text).orderBy("page", "y0", "x0").collect()
        return [h.asDict() for h in hits]

    @_safe
    def find_value_in_document(self, document_id: str, search_text: str) -> dict[str, Any]:
        """All places of a text; none is an answer, not an error."""
        hits = self._hits(document_id, search_text)
        if isinstance(hits, str):
            return _fail(hits)
        rounded = [{"text": h["text"], "page": h["page"], **{c: round(h[c], 1) for c in ("x0", "y0", "x1", "y1")}} for h in hits]
        return {"ok": True, "document_id": self._id(document_id), "search_text": search_text, "found": bool(hits), "hits": rounded}

    @_safe
    def snip_value_from_document(self, document_id: str, search_text: str, whole_row: bool = True) -> dict[str, Any]:
        """The crop rectangle (and text) of the first hit, widened to its row if asked, with the name of the image.

        The image itself is cut by ``sources.words.pdf_crops``, where files and a decoder are at hand.
        """
        hits = self._hits(document_id, search_text)
        if isinstance(hits, str):
            return _fail(hits, found=False)
        if not hits:
            return _fail(f"{search_text!r} not found", found=False)
        spark, name = self.words.sparkSession, self._id(document_id)
        first = tuple(hits[0][c] for c in ("text", "page", "x0", "y0", "x1", "y1"))
        hit = spark.createDataFrame([(name, hits[0]["page"], *first[:1], *first[2:], search_text)], "doc_id string, page int, text string, x0 double, y0 double, x1 double, y1 double, asked string")
        if whole_row:
            words = Documents.of_words(self.words.where(F.col("doc_id") == name))
            width = self.pages.where(F.col("doc_id") == name).agg(F.max("width")).first()[0] if self.pages is not None else None
            hit = lookup.widened_rows(words, lambda _: [first], width).withColumn("asked", F.lit(search_text))
        c = lookup.crop(hit, self.pages).withColumn("slug", slug(F.col("asked"))).first()
        rectangle = [round(c[k], 1) for k in ("cx0", "cy0", "cx1", "cy1")]
        return {"ok": True, "document_id": name, "found": True, "text": c["text"], "page": c["page"], "rectangle": rectangle, "image_path": f"{name}-{c['slug']}.png", "occurrences_found": len(hits)}

    @_safe
    def build_evidence_pack(self, conclusion: str, citations: list[dict[str, Any]]) -> dict[str, Any]:
        """A pack of the cited fields; fields that are absent or null are listed."""
        if not isinstance(citations, list) or not citations:
            return _fail("citations must be a list with at least one entry")
        for k, c in enumerate(citations):
            if not isinstance(c, dict) or not c.get("document_id") or not c.get("field_path"):
                return _fail(f"citation {k} needs document_id and field_path")
        spark = self.documents.sparkSession
        asked = spark.createDataFrame([(k, self._id(c["document_id"]), c["field_path"], None if c.get("confidence") is None else float(c["confidence"]), c.get("note")) for k, c in enumerate(citations)], "ord int, document_id string, field_path string, confidence double, note string")
        ids = sorted({self._id(c["document_id"]) or "" for c in citations})
        documents = self.documents.where(F.col("document_id").isin(ids))
        known = {r[0] for r in documents.select("document_id").distinct().collect()}
        if missing := [i for i in ids if i not in known]:
            return _fail(f"no document {missing[0]!r}")
        of = evidence.fields(documents.withColumn("k", F.col("document_id")), ["k"]).withColumnRenamed("k", "document_id").dropDuplicates(["document_id", "field_path"])
        positions = self.positions if self.positions is not None else spark.createDataFrame([], "document_id string, field_path string, page int, bounding_box struct<x0:double,y0:double,x1:double,y1:double>")
        cited = evidence.cite(asked, of, positions).join(documents.groupBy("document_id").agg(F.min("source_system").alias("source_system"), F.min("document_type").alias("document_type")), "document_id", "left")
        pack = evidence.stamped(evidence.packs(cited.withColumn("pack_id", F.lit("p"))), conclusion)
        out = pack.first().asDict(recursive=True)
        rendered = render.pack_markdown(spark.createDataFrame([out], pack.schema)).first()["markdown"]
        absent = [i["field_path"] for i in out["items"] if i["value"] is None]
        return {"ok": True, **out, "fields_not_found": absent, "markdown": rendered}

    def tools(self, names: tuple[str, ...] | None = None) -> dict[str, Callable[..., dict[str, Any]]]:
        return {n: getattr(self, n) for n in names or ALL_TOOLS}


# Which functions belong to which set.
DOCUMENT_TOOLS = ("read_document_fields", "find_value_in_document")
ARITHMETIC_TOOLS = ("check_document_arithmetic",)
EVIDENCE_TOOLS = ("build_evidence_pack", "snip_value_from_document")
THREE_WAY_MATCH_TOOLS = ("read_document_fields", "check_document_arithmetic", "build_evidence_pack", "snip_value_from_document")
ALL_TOOLS = ("read_document_fields", "check_document_arithmetic", "find_value_in_document", "snip_value_from_document", "build_evidence_pack")
