"""The programming interface: search, precedents, documents, coverage and reference checks.

Each method plans one or two Spark jobs and gives a page: the items are collected,
at most ``MOST_ITEMS`` of them, everything before that stays distributed.
"""

from __future__ import annotations

import base64
import hashlib
import json
from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from autuario.errors import EngineError
from autuario.functions.citing import filter_key, recognized
from autuario.functions.text import fold_literal, folded
from autuario.operators import citations as C
from autuario.operators import search as S
from autuario.operators.history import history
from autuario.operators.sections import header, sections
from autuario.plans.language import Leaf, Node, broadened, leaves, parse_advanced, parse_simple
from autuario.plans.search import PRECEDENT_FIELDS, precedent_texts, ranked_precedents
from autuario.runtime import cut
from autuario.sources.tables import table

MOST_ITEMS, MOST_REFERENCES, BLOCK = 50, 50, 1500


@dataclass
class Page:
    """Items with the total, why there are none, documents per term, and where to go on."""

    items: list[dict]
    total: int
    reason: str | None = None
    terms: dict[str, int] = field(default_factory=dict)
    broadened: bool = False
    cursor: str | None = None


def _mark(params: dict) -> str:
    return hashlib.sha256(json.dumps(params, sort_keys=True, ensure_ascii=False, default=str).encode()).hexdigest()[:16]


def encode_cursor(params: dict, offset: int) -> str:
    """An opaque place in the result of exactly these parameters."""
    body = json.dumps({"m": _mark(params), "o": offset}, sort_keys=True, separators=(",", ":"))
    return base64.urlsafe_b64encode(body.encode()).decode().rstrip("=")


def decode_cursor(cursor: str | None, params: dict) -> int:
    if not cursor:
        return 0
    try:
        body = json.loads(base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)))
        mark, offset = body["m"], int(body["o"])
    except (ValueError, KeyError, TypeError) as x:
        raise EngineError("cursor_invalido", "The cursor can't be read.") from x
    if mark != _mark(params):
        raise EngineError("cursor_invalido", "The cursor belongs to another query.")
    return offset


class Engine:
    """Queries over one generation of corpus tables."""

    def __init__(self, spark: SparkSession, root: str, index: str | None = None):
        """``index``: a written index of the ementas; without one it is ``root``'s own, or written on the first search."""
        self.spark, self.root = spark, root
        self._place = index or f"{root.rstrip('/')}/index"

    @property
    def index(self) -> S.Index:
        held = S.Index(self.spark, self._place)
        return held if held.manifest["segments"] else S.index_for(self.spark, self._table("search").where("id is not null"), "id", "ementa", self.root)

    def _table(self, name: str) -> DataFrame:
        return table(self.spark, self.root, name)

    def holds(self, name: str) -> bool:
        """Whether the folder has a table."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root.rstrip('/')}/{name}.parquet")
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def _filtered(self, tribunal=None, organ=None, classe=None, process=None, relator=None, judged=(None, None), published=(None, None), cites=None, cites_judgment=None, cites_provision=None, cited_by=None, citing=None) -> DataFrame:
        """Documents under the filters; comparisons on stored columns reach the scan. Citations may be typed as in texts."""
        docs = self._table("documents").select("id", "tribunal", "organ", "classe", "process", "registration", "judgment", "publication")
        for name, value in (("tribunal", tribunal), ("organ", organ), ("classe", classe)):
            if value is not None:
                docs = docs.where(F.col(name) == fold_literal(value))
        if process is not None:
            number = "".join(c for c in process if c.isdigit())
            if not number:
                raise EngineError("processo_invalido", "A process number has digits.")
            docs = docs.where((F.col("process") == number) | (F.col("registration") == number))
        for name, (low, high) in (("judgment", judged), ("publication", published)):
            for day in (low, high):
                if day:
                    _check_date(day)
            if low and high and low > high:
                raise EngineError("filtro_invalido", f"The range of {name} ends before it begins.")
            docs = docs.where(F.col(name) >= F.lit(low).cast("date")) if low else docs
            docs = docs.where(F.col(name) <= F.lit(high).cast("date")) if high else docs
        if relator is not None:
            named = self._table("document_details").where(F.contains(folded(F.col("relator")), F.lit(fold_literal(relator)))).select("id")
            docs = docs.join(named, "id", "left_semi")
        for tipo, value in (("precedente", cites), ("acordao", cites_judgment), ("dispositivo", cites_provision)):
            if value is not None:
                key = filter_key(tipo, value)
                if key is None:
                    raise EngineError("filtro_invalido", f"No {tipo} can be read in {value!r}.")
                cited = self._table("document_citations").where((F.col("tipo") == tipo) & (F.col("chave") == key))
                docs = docs.join(cited.select(F.col("document_id").alias("id")), "id", "left_semi")
        if citing is not None:
            docs = docs.join(self._table("citation_links").where(F.col("cited_id") == citing).select(F.col("document_id").alias("id")), "id", "left_semi")
        if cited_by is not None:
            docs = docs.join(self._table("citation_links").where(F.col("document_id") == cited_by).select(F.col("cited_id").alias("id")), "id", "left_semi")
        return docs

    def search_df(self, query: str, *, advanced: bool = False, order: str = "relevance", similar_to: str | None = None, **filters) -> tuple[DataFrame, Leaf | Node | None, DataFrame | None]:
        """(matches under the filters, the tree, what was measured): a lazy table with ``score``."""
        if order not in ("relevance", "newest", "oldest"):
            raise EngineError("parametro_invalido", "Order is relevance, newest or oldest.")
        docs = self._filtered(**filters)
        if similar_to:
            terms = [r["term"] for r in S.seed_terms(self.index, self._table("search").where(F.col("id") == similar_to), "ementa").collect()]  # 25 at most
            if len(terms) < 3:
                raise EngineError("filtro_indisponivel", "The document has too few terms of its own.")
            tree: Leaf | Node | None = Node("or", tuple(Leaf(t, (t,)) for t in terms))
            docs = docs.where(F.col("id") != similar_to)
        else:
            tree = parse_advanced(query) if advanced else parse_simple(query, ranked=order == "relevance")
        if tree is None:
            return docs.withColumns({"score": F.lit(0.0), "hits": F.array().cast("array<int>")}), None, None
        measured = cut(self.index.measure(tree), "engine-measured")
        return self._scored(measured, tree, tree).join(docs, "id"), tree, measured

    def _scored(self, measured: DataFrame, tree: Leaf | Node, asked: Leaf | Node) -> DataFrame:
        """The matches of a tree among what was measured for the tree asked."""
        found = leaves(asked)
        return measured.where(S.matches(tree, found)).select("id", S.bm25(self.index.statistics(measured, len(found))).alias("score"), "hits")

    def search(self, query: str = "", *, limit: int = 8, cursor: str | None = None, advanced: bool = False, order: str = "relevance", similar_to: str | None = None, **filters) -> Page:
        """A page of documents. An AND without a match in order of date is broadened to OR."""
        if not 1 <= limit <= MOST_ITEMS:
            raise EngineError("limite_invalido", f"The limit is 1 to {MOST_ITEMS}.")
        params = {"q": query, "a": advanced, "o": order, "s": similar_to, **filters}
        offset = decode_cursor(cursor, params)
        rows, tree, measured = self.search_df(query, advanced=advanced, order=order, similar_to=similar_to, **filters)
        rows = cut(rows, "engine-matches")
        total, wide = rows.count(), False
        if not total and not advanced and isinstance(tree, Node) and tree.kind == "and" and order != "relevance":
            wider = broadened(tree)
            more = cut(self._scored(measured, wider, tree).join(self._filtered(**filters), "id"), "engine-matches")
            if n := more.count():
                rows, total, wide = more, n, True
        if order == "relevance":
            by = [F.round("score", 9).desc(), F.col("publication").desc_nulls_last(), F.col("id").asc()]
        else:
            by = [F.col("judgment").desc_nulls_last() if order == "newest" else F.col("judgment").asc_nulls_last(), F.col("id").asc()]
        order_of = leaves(tree)
        present = S.present_terms(order_of) if order_of else F.array().cast("array<string>")
        page = rows.orderBy(*by).offset(offset).limit(limit).withColumn("present", present).drop("hits")
        items = [r.asDict() for r in page.collect()]
        snippets = {}
        if order_of and items:
            ids = self.spark.createDataFrame([(x["id"],) for x in items], "id string")
            near = S.snippet(self._table("search").join(F.broadcast(ids), "id", "left_semi"), "id", "ementa", order_of)
            snippets = {r["id"]: " ".join(r["snippet_tokens"]) for r in near.collect()}
        heads = self._heads([x["id"] for x in items])
        for x in items:
            x["snippet"], x["header"] = snippets.get(x["id"]), heads.get(x["id"])
        terms = dict(zip((t.text for t in order_of), S.statistics(measured, len(order_of))[2])) if measured is not None and (wide or not total) else {}
        return Page(items, total, None if total else self._why(tree, measured, filters), terms, wide, encode_cursor(params, offset + limit) if offset + limit < total else None)

    def _heads(self, ids: list[str]) -> dict[str, str]:
        """The headers of a page's documents."""
        rows = self._table("search").where(F.col("id").isin(ids) & F.col("ementa").isNotNull()) if ids else None
        return {} if rows is None else {r["id"]: r["h"] for r in rows.select("id", header(F.col("ementa")).alias("h")).collect()}

    def _why(self, tree, measured, filters) -> str:
        """Why there is no match: beyond the dates held, a restrictive filter, or no match at all."""
        for name, column in (("judged", "judgment"), ("published", "publication")):
            low, high = filters.get(name) or (None, None)
            held = self._table("documents").agg(F.min(column), F.max(column)).first()
            if held[0] is None or (low and low > str(held[1])) or (high and high < str(held[0])):
                return "outside_coverage"
        if tree is None or not measured.where(S.matches(tree, leaves(tree))).isEmpty():
            return "restrictive_filter"
        return "no_match"

    def precedents(self, query: str = "", *, tribunal=None, organ=None, species=None, numero=None, matter=None, field: str | None = None, admitted: bool = True, withdrawn: list[str] | None = None,
                   advanced: bool = False, order: str = "relevance", published=(None, None), limit: int = 8, cursor: str | None = None) -> Page:
        """A page of precedents: by text over their weighted fields, or one of them, with the fields that match; without a query, newest first.

        ``withdrawn``: (id, hash) pairs, as ``id:hash``, that are not served.
        """
        if not 1 <= limit <= MOST_ITEMS:
            raise EngineError("limite_invalido", f"The limit is 1 to {MOST_ITEMS}.")
        if field is not None and field not in PRECEDENT_FIELDS:
            raise EngineError("campo_indisponivel", f"A field is one of {', '.join(PRECEDENT_FIELDS)}.")
        params = {"q": query, "t": tribunal, "g": organ, "s": species, "n": numero, "m": matter, "f": field, "d": admitted, "w": withdrawn, "a": advanced, "o": order, "p": published}
        offset = decode_cursor(cursor, params)
        rows = precedent_texts(self._table("precedents"), self._table("precedent_versions")) if query or matter else self._table("precedents")
        shown = [c for c in rows.columns if c not in PRECEDENT_FIELDS]
        every = rows
        if admitted:
            every = every.where("admission = 'admitido'")
        if withdrawn:
            gone = self.spark.createDataFrame([(x,) for x in withdrawn], "w string")
            every = every.join(gone, F.concat_ws(":", "id", "hash") == F.col("w"), "left_anti")  # the optimizer chooses how, by size
        rows = every
        for name, value in (("tribunal", tribunal), ("organ", organ), ("species", species), ("numero", numero), ("materia", matter)):
            rows = rows if value is None else rows.where(F.col(name) == str(value))
        for day, test in zip(published, (F.Column.__ge__, F.Column.__le__)):
            if day:
                rows = rows.where(test(F.col("publication"), F.lit(_check_date(day)).cast("date")))
        tree = (parse_advanced(query) if advanced else parse_simple(query, ranked=order == "relevance")) if query else None
        newest = [F.col("publication").asc_nulls_last() if order == "oldest" else F.col("publication").desc_nulls_last(), F.col("id").asc()]
        if tree is None:
            found = cut(rows.select(*shown), "engine-precedents")
            items = [r.asDict() for r in found.orderBy(*newest).offset(offset).limit(limit).collect()]
        else:
            scored = cut(ranked_precedents(every, tree, field), "engine-precedents-scored")
            found = cut(rows.select(*shown).join(scored, "id"), "engine-precedents")
            by = [F.round("score", 9).desc(), *newest] if order == "relevance" else newest
            items = [r.asDict() for r in found.orderBy(*by).offset(offset).limit(limit).collect()]
        total = found.count()
        reason = None if total else "no_match" if tree is not None and scored.isEmpty() else "restrictive_filter"
        return Page(items, total, reason, cursor=encode_cursor(params, offset + limit) if offset + limit < total else None)

    def document(self, id: str, block: int = 0, size: int = BLOCK, citations_from: int = 0, component: str = "text", section: str | None = None, version: str | None = None) -> dict:
        """A document's metadata with one component.

        ``text``: a block of its text (the blocks in order are the text), and a page of its citations;
        ``ementa``: a block of its summary, of one ``section`` if that is named; ``sections``: names and offsets;
        ``history``: its contents with their periods; ``version``: the content with a hash, as it was seen.
        """
        found = self._table("documents").where(F.col("id") == id).limit(1)
        if component not in ("text", "ementa", "sections", "history"):
            raise EngineError("componente_indisponivel", "A component is text, ementa, sections or history.")
        if component == "history":
            log = self._table("versions").where(F.col("document_id") == id)
            periods = history(log, "document_id", "hash", "first_seen").orderBy("valid_from")
            return self._meta(found) | {"history": [r.asDict() for r in periods.drop("entity_id").collect()]}  # one document's
        if version is not None:
            seen = self._table("versions").where((F.col("document_id") == id) & (F.col("hash") == version)).select("hash", "first_seen", "raw").orderBy("first_seen").first()
            if seen is None:
                raise EngineError("versao_indisponivel", "The document has no such version.")
            return self._meta(found) | seen.asDict()
        if component != "text":
            ementa = self._table("search").where(F.col("id") == id).select("id", "ementa").limit(1)
            spans = sections(ementa, "id", "ementa").orderBy("start")
            if component == "sections":
                return self._meta(found) | {"sections": [r.asDict() for r in spans.drop("id", "text").collect()]}
            if section is not None:
                own = spans.where(F.col("name") == section).select(F.col("text").alias("ementa"))
                if own.isEmpty():
                    raise EngineError("componente_indisponivel", "The summary has no such section.")
            else:
                own = ementa.select("ementa")
            return self._meta(found) | self._block(own, "ementa", block, size, [])
        out = self._block(found, "text", block, size, [c for c in found.columns if c != "text"])
        cites = self._table("document_citations").where(F.col("document_id") == id).select("ord", "tipo", "chave", "resolvido").distinct()
        out["citations_total"] = cites.count()
        out["citations"] = [r.asDict() for r in cites.orderBy("ord", "tipo", "chave").offset(citations_from).limit(MOST_ITEMS).collect()]  # a page of them
        return out

    def _meta(self, found: DataFrame) -> dict:
        row = found.drop("text").first()
        if row is None:
            raise EngineError("documento_nao_encontrado", "There is no such document.")
        return row.asDict()

    def _block(self, rows: DataFrame, column: str, block: int, size: int, more: list[str]) -> dict:
        n = F.greatest(F.ceil(F.length(column) / size), F.lit(1))
        row = rows.select(*more, n.alias("blocks"), F.substring(column, block * size + 1, size).alias("part")).first()
        if row is None:
            raise EngineError("documento_nao_encontrado", "There is no such document.")
        if row["blocks"] is not None and not 0 <= block < row["blocks"]:
            raise EngineError("parametro_invalido", f"The text has {row['blocks']} blocks.")
        return row.asDict()

    def coverage(self, tribunal: str | None = None) -> DataFrame:
        """Per court and organ: documents and their dates."""
        docs = self._table("documents")
        docs = docs if tribunal is None else docs.where(F.col("tribunal") == tribunal)
        return docs.groupBy("tribunal", "organ").agg(F.count("*").alias("n"), F.min("judgment").alias("from"), F.max("judgment").alias("to"), F.count_if(F.col("publication").isNull()).alias("unpublished"))

    def check_references(self, references: list[str]) -> list[dict]:
        """Whether each reference, as written, is held: ``held``, ``several``, ``not_held``, ``other_court`` or
        ``unread``; and whether the date, judge and body it states are those of the document held."""
        if not 1 <= len(references) <= MOST_REFERENCES or any(len(r) > 200 for r in references):
            raise EngineError("parametro_invalido", f"1 to {MOST_REFERENCES} references of up to 200 characters.")
        named = [recognized(r) for r in references]
        keyed = self.spark.createDataFrame([("", k, *(n or ("acordao", None))) for k, n in enumerate(named)], "document_id string, ord int, tipo string, chave string")
        r = C.resolve(keyed, self._table("documents"), self._table("precedents"))
        state: Column = (
            F.when(F.col("chave").isNull(), "unread").when(F.col("tipo") == "acordao_outro", "other_court")
            .when(F.col("resolvido").isNotNull(), "held").when(F.col("candidatos").isNotNull(), "several").otherwise("not_held")
        )
        found = {x["ord"]: x.asDict() for x in r.select("ord", "tipo", "chave", state.alias("state"), "resolvido", "candidatos").collect()}
        ids = [(i, t, [found[i]["resolvido"]] if found[i]["resolvido"] else found[i]["candidatos"]) for i, t in enumerate(references) if found[i]["resolvido"] or found[i]["candidatos"]]
        dates, stated = {}, {}
        if ids:
            asked = self.spark.createDataFrame(ids, "ref int, texto string, ids array<string>")
            dates = {x["ref"]: x for x in C.singled_out(asked, self._table("documents")).collect()}
            for i, x in dates.items():  # the stated date tells one apart
                if found[i]["state"] == "several" and x["id"]:
                    found[i] |= {"state": "held", "resolvido": x["id"]}
            one = [(i, t, found[i]["resolvido"]) for i, t, _ in ids if found[i]["resolvido"] and found[i]["tipo"] != "precedente"]
            if one:
                held = self._table("documents").select("id", folded(F.col("organ")).alias("organ")).join(self._table("document_details").groupBy("id").agg(F.min("relator_fold").alias("judge")), "id", "left")
                said = self.spark.createDataFrame(one, "ref int, texto string, id string").join(held, "id", "left")
                t = F.col("texto")
                compared = said.select("ref", C.names_agree(C.stated_judge(t), F.col("judge")).alias("judge"), C.names_agree(C.stated_organ(t), F.col("organ")).alias("organ"))
                stated = {x["ref"]: x for x in compared.collect()}
        out = []
        for i, t in enumerate(references):
            x = {k: v for k, v in found[i].items() if k not in ("ord", "tipo")}
            out.append({"reference": t, **x, "date": dates[i]["state"] if i in dates else None, **{k: stated[i][k] if i in stated else None for k in ("judge", "organ")}})
        return out

    def catalogued(self, ids: list[str]) -> DataFrame:
        """``id, state``: precedents by id: ``admitted``, ``known`` (in the catalog, not admitted) or ``absent``."""
        asked = self.spark.createDataFrame([(x,) for x in ids], "id string")
        state = F.when(F.col("admission").isNull(), "absent").when(F.col("admission") == "admitido", "admitted").otherwise("known")
        return asked.join(self._table("precedents").select("id", F.coalesce("admission", F.lit("pendente")).alias("admission")), "id", "left").select("id", state.alias("state"))


def _check_date(day: str) -> str:
    try:
        return str(date.fromisoformat(day))
    except ValueError as x:
        raise EngineError("data_invalida", "A date is written yyyy-mm-dd.") from x
