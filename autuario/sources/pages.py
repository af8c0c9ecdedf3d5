"""Result pages in HTML: cards of labelled values, in Arrow batches with the standard parser."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class Cards(HTMLParser):
    """Collects elements ``.resultadoItem#resultado<id>`` with ``.resLabel`` and ``.resValue`` pairs, and the declared total."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.total: int | None = None
        self.cards: list[tuple[str, dict[str, str]]] = []
        self.stack: list[str] = []
        self.part: str | None = None
        self.depth = 0
        self.text: list[str] = []
        self.label = ""

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        classes = (a.get("class") or "").split()
        if a.get("id") == "hdnTotalResultado" and (a.get("value") or "").strip().isdigit():
            self.total = int(a["value"])
        if "resultadoItem" in classes and (a.get("id") or "").startswith("resultado"):
            self.cards.append((a["id"][len("resultado"):], {}))
        kind = next((c for c in ("resLabel", "resValue") if c in classes), None)
        if kind and self.part is None:
            self.part, self.depth, self.text = kind, len(self.stack), []
        if tag == "br" and self.part:
            self.text.append("\n")
        if tag not in _VOID:
            self.stack.append(tag)

    def handle_endtag(self, tag):
        if tag in self.stack:
            while self.stack.pop() != tag:
                pass
        if self.part and len(self.stack) <= self.depth:
            value = re.sub(r"[ \t\r\f\v\xa0]+", " ", "".join(self.text)).strip()
            if self.part == "resLabel":
                self.label = value.rstrip(":").strip().upper()
            elif self.cards and self.label:
                self.cards[-1][1].setdefault(self.label, value)
            self.part = None

    def handle_data(self, data):
        if self.part:
            self.text.append(data)


def parse_page(html: str) -> tuple[int | None, list[tuple[str, dict[str, str]]]]:
    """(declared total, cards) of a page."""
    p = Cards()
    p.feed(html)
    p.close()
    return p.total, p.cards


def cards(df: DataFrame, page_col: str, html_col: str) -> DataFrame:
    """``page, total, id, fields``: the cards of each page; a page without cards has one row with a null id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for page, html in zip(b.column("page").to_pylist(), b.column("html").to_pylist()):
                total, found = parse_page(html or "")
                rows += [(page, total, i, f) for i, f in found] or [(page, total, None, {})]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.string()), pa.array([list(r[3].items()) for r in rows], pa.map_(pa.string(), pa.string()))],
                names=["page", "total", "id", "fields"],
            )

    return df.select(F.col(page_col).cast("string").alias("page"), F.col(html_col).alias("html")).mapInArrow(run, "page string, total long, id string, fields map<string,string>")


def stable(found: DataFrame) -> DataFrame:
    """Checks of a paged scan: one total declared, as many ids as declared, no id with two contents."""
    content = F.to_json(F.map_from_entries(F.array_sort(F.map_entries("fields"))))
    per_id = found.where("id is not null").groupBy("id").agg(F.count_distinct(content).alias("contents"))
    ids = per_id.agg(F.count("*").alias("ids"), F.count_if(F.col("contents") > 1).alias("conflicts"))
    totals = found.agg(F.count_distinct("total").alias("totals"), F.max("total").alias("total"))
    return totals.join(F.broadcast(ids)).select("totals", "total", "ids", "conflicts", ((F.col("totals") == 1) & (F.col("total") == F.col("ids")) & (F.col("conflicts") == 0)).alias("complete"))
