"""Summaries of the superior courts from their HTML pages, and the options of a search form.

Pages are read into plain rows in Arrow batches; what rows of several pages say
together (first one counts, index and page agree) is decided by joins and groups.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser
from typing import NamedTuple
from urllib.parse import parse_qs, urljoin, urlparse

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
# Markers of a summary that is no longer in force, and the collections of the index.
MARKERS = {"CANCELADA": "cancelado", "REVOGADA": "revogado", "SUPERADA": "superado"}
COLLECTIONS = {"30": "sumula", "26": "sumula_vinculante"}


@dataclass
class Element:
    """An element with its attributes and, in order, its texts and elements."""

    tag: str
    attributes: dict[str, str]
    parts: list = field(default_factory=list)

    def has(self, name: str) -> bool:
        return name in (self.attributes.get("class") or "").split()

    def inside(self) -> Iterator["Element"]:
        for p in self.parts:
            if isinstance(p, Element):
                yield p
                yield from p.inside()

    def first(self, name: str) -> "Element | None":
        return next((e for e in self.inside() if e.has(name)), None)

    def text(self, without: tuple[str, ...] = ()) -> str:
        return "".join(p if isinstance(p, str) else p.text(without) for p in self.parts if isinstance(p, str) or not any(p.has(n) for n in without))


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Element("", {})
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        e = Element(tag, {k: v or "" for k, v in attrs})
        self.open[-1].parts.append(e)
        if tag not in _VOID:
            self.open.append(e)

    def handle_endtag(self, tag):
        if any(e.tag == tag for e in self.open[1:]):
            while self.open.pop().tag != tag:
                pass

    def handle_data(self, data):
        self.open[-1].parts.append(data)


def tree(html: str) -> Element:
    parser = _Tree()
    parser.feed(html)
    parser.close()
    return parser.root


def _line(text: str) -> str:
    return " ".join(text.split())


def _dates(text: str, separator: str) -> list[str]:
    return [f"{y}-{int(m):02d}-{int(d):02d}" for d, m, y in re.findall(rf"(\d{{1,2}}){separator}(\d{{1,2}}){separator}(\d{{4}})", text)]


def listed_summaries(html: str) -> list[dict]:
    """The entries of a listing page: number, marker, branch, statement, organ, dates of publication; ``problem`` for one that isn't as expected."""
    out = []
    for block in tree(html).inside():
        if not block.has("gridSumula"):
            continue
        said = {n: _line(e.text()) if (e := block.first(c)) else "" for n, c in (("number", "numeroSumula"), ("marker", "clsINDE"), ("branch", "ramoSumula"))}
        body = block.first("blocoVerbete")
        whole = body.text(("ramoSumula", "clsCOM")).strip() if body else ""
        # the reference is the last parenthesis and says when the summary was decided
        statement, _, reference = whole.rpartition("(")
        parts = [p.strip() for p in reference.rstrip(")").split(",")]
        decided = next((k for k, p in enumerate(parts) if re.match(r"(?i)julgad[oa]\s+em\b", p)), None)
        good = whole.endswith(")") and decided and "julgad" not in statement.rpartition("(")[2].lower()
        published = [d for p in parts[(decided or 0) + 1 :] if not p.upper().startswith("REP") for d in _dates(p, "/")]
        problem = None if re.fullmatch(r"[1-9]\d{0,6}", said["number"]) else "invalid_number"
        out.append({**said, "statement": statement.strip() if good else "", "organ": _line(parts[decided - 1]) if good else "", "published": published[0] if good and len(published) == 1 else None,
                    "ambiguous": bool(good) and len(published) > 1, "problem": problem or (None if good else "unexpected_form")})
    return out


class Label(NamedTuple):
    """What a summary is called: its number, whether it binds, and a marker in parentheses."""

    number: str
    binding: bool
    marker: str


def _label(text: str) -> Label | None:
    """A label such as ``Súmula Vinculante 9 (cancelada)``, None if it isn't one."""
    words, _, marker = text.partition(" (")
    said = words.split(" ")
    binding = said[1:2] == ["Vinculante"]
    number = said[-1]
    if said[0] != "Súmula" or len(said) != 2 + binding or not number.isdigit() or (marker and marker.find(")") != len(marker) - 1):
        return None
    return Label(number, binding, marker[:-1].upper())


def _target(url: str) -> tuple[str, str] | None:
    query = parse_qs(urlparse(url).query)
    base = query.get("base", [""])[0]
    return (base, query.get("sumula", [""])[0]) if base in COLLECTIONS else None


def indexed_summaries(url: str, html: str) -> list[dict]:
    """Of an index page, its anchors; of a summary's page, its title, statement and date: ``base, page, number, binding, marker, statement, published, ambiguous``."""
    own = _target(url)
    if own is None:
        return []
    base, page = own
    root = tree(html)
    if not page:
        out = []
        for e in root.inside():
            to = _target(urljoin(url, e.attributes["href"])) if e.tag == "a" and "href" in e.attributes else None
            label = _label(_line(e.text()))
            if label and to and to[0] == base and to[1]:
                out.append({"base": base, "page": to[1], "role": "index", **label._asdict()})
        return out
    title = root.first("titulo")
    label = _label(_line(title.text())) if title else None
    statement = ""
    for parent in [root, *root.inside()]:  # the statement is the title's next sibling of its class
        if title is not None and any(p is title for p in parent.parts):
            after = parent.parts[next(k for k, p in enumerate(parent.parts) if p is title) + 1 :]
            statement = next((p.text().strip() for p in after if isinstance(p, Element) and p.has("parCOM")), "")
    dates = [d for m in re.findall(r"Data de publicação do enunciado:\s*DJE?\s+de\s+(\S+)", root.text(), re.I) for d in _dates(m, "-")]
    return [{"base": base, "page": page, "role": "page", "number": label.number if label else None, "binding": bool(label and label.binding), "statement": statement, "published": dates[0] if len(dates) == 1 else None, "ambiguous": len(dates) > 1}]


def form_options(html: str) -> list[dict]:
    """``name, value, label`` of each option of the selections of a form."""
    return [
        {"name": s.attributes.get("name", ""), "value": o.attributes.get("value", _line(o.text())), "label": _line(o.text())}
        for s in tree(html).inside() if s.tag == "select" for o in s.inside() if o.tag == "option"
    ]


def _read(pages: DataFrame, read: Callable[[str, str], list[dict]], columns: dict[str, str]) -> DataFrame:
    """Rows of pages (``url, html``), with the page's address and the row's place in it."""
    kinds = {"string": pa.string(), "boolean": pa.bool_()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(u, k, r) for u, h in zip(b.column("url").to_pylist(), b.column("html").to_pylist()) if h is not None for k, r in enumerate(read(u, h))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()), *[pa.array([r[2].get(c) for r in rows], kinds[t]) for c, t in columns.items()]], names=["url", "place", *columns])

    return pages.select("url", "html").mapInArrow(run, "url string, place int, " + ", ".join(f"{c} {t}" for c, t in columns.items()))


def _state(marker: str) -> F.Column:
    known = F.create_map(*[F.lit(x) for pair in MARKERS.items() for x in pair])
    return F.when(F.coalesce(marker, F.lit("")) == "", "vigente").otherwise(F.coalesce(known[F.upper(marker)], F.lit("desconhecido")))


def summaries_of_lists(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(summaries, rejects) of listing pages (``url, html``): the first entry of a number counts, in order of address and place."""
    columns = {"number": "string", "marker": "string", "branch": "string", "statement": "string", "organ": "string", "published": "string", "ambiguous": "boolean", "problem": "string"}
    rows = _read(pages, lambda _, h: listed_summaries(h), columns)
    order = F.struct("url", "place")
    good = rows.where("problem is null").withColumn("order", order)
    first = good.groupBy("number").agg(F.min("order").alias("order"))
    kept = good.join(first, ["number", "order"]).select("number", "branch", "statement", "organ", F.to_date("published").alias("published"), "ambiguous", _state("marker").alias("state"), "url")
    again = good.join(first, ["number", "order"], "left_anti").select("url", "number", F.lit("repeated_identity").alias("problem"))
    return kept, rows.where("problem is not null").select("url", "number", "problem").unionByName(again)


def summaries_of_index(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(summaries, rejects) of index and summary pages (``url, html``), joined by collection and page; the index says the number and whether it is in force."""
    columns = {"base": "string", "page": "string", "role": "string", "number": "string", "binding": "boolean", "marker": "string", "statement": "string", "published": "string", "ambiguous": "boolean"}
    rows = _read(pages, indexed_summaries, columns)
    index = rows.where("role = 'index'").groupBy("base", "page").agg(F.min_by(F.struct("number", "marker"), F.struct("url", "place")).alias("i"))
    joined = rows.where("role = 'page'").join(index, ["base", "page"], "left")
    kind = F.create_map(*[F.lit(x) for pair in COLLECTIONS.items() for x in pair])[F.col("base")]
    differs = F.col("number").isNull() | (F.col("number") != F.col("i.number")) | (F.col("binding") != (kind == "sumula_vinculante"))
    told = joined.withColumn("problem", F.when(F.col("i").isNull(), "not_in_index").when(differs, "title_differs")).withColumn("species", kind)
    good = told.where("problem is null")
    first = good.groupBy("species", "number").agg(F.min("url").alias("url"))
    kept = good.join(first, ["species", "number", "url"]).select("species", "number", "statement", F.to_date("published").alias("published"), "ambiguous", _state("i.marker").alias("state"), "url")
    again = good.join(first, ["species", "number", "url"], "left_anti").select("url", "number", F.lit("repeated_identity").alias("problem"))
    return kept, told.where("problem is not null").select("url", "number", "problem").unionByName(again)


def form_values(pages: DataFrame) -> DataFrame:
    """``url, place, name, value, label``: the options of forms."""
    return _read(pages, lambda _, h: form_options(h), {"name": "string", "value": "string", "label": "string"})


def organ_registry(pages: DataFrame, known: DataFrame, name: str) -> DataFrame:
    """``organ, state``: the options of one selection against the organs known (``organ``): ``known``, ``new`` or ``gone``."""
    now = form_values(pages).where((F.col("name") == name) & (F.trim("value") != "")).select(F.col("value").alias("a")).distinct()
    state = F.when(F.col("b").isNull(), "new").when(F.col("a").isNull(), "gone").otherwise("known")
    return now.join(known.select(F.col("organ").alias("b")).distinct(), F.col("a") == F.col("b"), "full_outer").select(F.coalesce("a", "b").alias("organ"), state.alias("state"))
