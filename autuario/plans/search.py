"""Retrieval queries over the ementas, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from autuario.functions.text import ENDINGS, folded
from autuario.operators import search as S
from autuario.operators.sections import header
from autuario.plans import relations
from autuario.plans.language import Leaf, Node, broadened, cut_prefixes, leaves, parse_advanced, parse_simple
from autuario.runtime import checkpoint_root, cut, kept
from autuario.sources.tables import table

RANKED, PHRASE, PREFIX = "partilha de bens pensão mensal", '"partilha de bens"', "partilh* usucap*"
NESTED = '("seguro de vida" OU fiança) E (mora OU prazo) E dano*'
STRICT, NOWHERE = "testamento condominial usufrutuária rebanho prótese", "testamento xilofone condominial quinquagésimo"
SEED_RANK = 8


def _ementas(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "search").where("id is not null")


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("id", "tribunal", "organ", "judgment", "publication")


def _index(spark: SparkSession, d: str) -> S.Index:
    """The written index of the ementas, made on first use in an application."""
    return S.index_for(spark, _ementas(spark, d), "id", "ementa", d)


def _measured(spark: SparkSession, d: str, tree) -> DataFrame:
    return _index(spark, d).measure(tree)


def _top(spark: SparkSession, d: str, tree, keep=None, k: int = 8) -> DataFrame:
    """The best of the matches; filters come before the scores, dates after the cut where there is none."""
    documents = _documents(spark, d)
    page = _index(spark, d).ranked(tree, documents if keep is None else documents.where(keep))
    return page.orderBy(F.round("score", 6).desc(), F.col("publication").desc_nulls_last(), F.col("id")).limit(k).select("id", F.round("score", 6).alias("score"), "publication")


def search_rank_or(spark, d):
    """Ranked simple query with filters: the eight best."""
    return _top(spark, d, parse_simple(RANKED), (F.col("tribunal") == "TJSC") & F.col("organ").isNotNull())


def search_rank_phrase(spark, d):
    return _top(spark, d, parse_simple(PHRASE))


def search_rank_prefix(spark, d):
    return _top(spark, d, parse_advanced(PREFIX.replace(" ", " OU ")))


def search_boolean_nested(spark, d):
    """All matches of a nested expression, with their terms present."""
    tree = parse_advanced(NESTED)
    order = leaves(tree)
    return _measured(spark, d, tree).where(S.matches(tree, order)).select("id", F.array_join(S.present_terms(order), "|").alias("present"))


def search_date_order(spark, d):
    """AND of all terms in order of date, dates lacking last, second page of ten."""
    tree = parse_simple("prazo mora dano", ranked=False)
    found = _measured(spark, d, tree).where(S.matches(tree, leaves(tree))).select("id")
    return found.join(_documents(spark, d), "id").orderBy(F.col("judgment").desc_nulls_last(), "id").offset(10).limit(10).select("id", "judgment")


def search_broadened(spark, d):
    """AND without a match becomes OR; the words that stand nowhere are reported by ``search_term_counts``."""
    tree = parse_simple(NOWHERE, ranked=False)
    held = cut(_measured(spark, d, tree), "search-measured")
    order = leaves(tree)
    if held.where(S.matches(tree, order)).isEmpty():
        tree = broadened(tree)
    return held.where(S.matches(tree, order)).select("id", F.aggregate("hits", F.lit(0), lambda a, x: a + (x > 0).cast("int")).alias("terms_present"))


def search_term_counts(spark, d):
    """Documents with each term, without filters."""
    tree = parse_simple(NOWHERE, ranked=False)
    order = leaves(tree)
    counts = _measured(spark, d, tree).agg(*[F.count_if(F.col("hits")[i] > 0).alias(f"c{i}") for i in range(len(order))])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(x.text).alias("term"), F.col(f"c{i}").alias("documents")) for i, x in enumerate(order)])).alias("x")).select("x.*")


def search_total(spark, d):
    """Matches under a filter, and without it."""
    tree = parse_simple(RANKED)
    found = _measured(spark, d, tree).where(S.matches(tree, leaves(tree))).select("id").join(_documents(spark, d), "id")
    return found.agg(F.count("*").alias("total"), F.count_if(F.col("tribunal") == "STJ").alias("total_stj"))


def search_empty_reason(spark, d):
    """Why a filtered query has no match: a restrictive filter, or terms that stand nowhere."""
    tree = parse_simple("usucapião", ranked=False)
    found = _measured(spark, d, tree).where(S.matches(tree, leaves(tree))).select("id").join(_documents(spark, d), "id")
    n = found.agg(F.count("*").alias("unfiltered"), F.count_if(F.col("judgment") < F.lit("1900-01-01").cast("date")).alias("total"))
    bounds = _documents(spark, d).agg(F.min("judgment").alias("lo"), F.max("judgment").alias("hi")).first()
    outside = bounds["lo"] is None or str(bounds["lo"]) > "1899-12-31"
    reason = F.when(F.col("total") > 0, "found").when(F.lit(outside), "outside_coverage").when(F.col("unfiltered") > 0, "restrictive_filter").otherwise("no_match")
    return n.select("total", "unfiltered", reason.alias("reason"))


def search_index_rank(spark, d):
    """The ranked query of a phrase and a word."""
    return _top(spark, d, parse_simple('"partilha de bens" usucapião'))


def search_index_updated(spark, d):
    """The best after an update of an index: the STJ's documents first, then the state court's with one of every two STJ ids gone, and merged segments."""
    e = _ementas(spark, d)
    path = f"{checkpoint_root(spark).rstrip('/')}/index-{uuid.uuid4().hex}"
    kept(spark, path)
    index = S.Index(spark, path).replace(e.where("id like 'STJ:%'"), "id", "ementa").replace(e.where("id like 'TJSC:%'"), "id", "ementa", e.where("id like 'STJ:%0'").select("id"))
    found = index.ranked(parse_simple(RANKED), _documents(spark, d))
    return found.orderBy(F.round("score", 6).desc(), F.col("publication").desc_nulls_last(), "id").limit(8).select("id", F.round("score", 6).alias("score"), "publication")


def search_prefix_cut(spark, d):
    """Matches of all words, each by its first five letters."""
    tree = cut_prefixes(parse_simple("prorrogação decadencial", ranked=False), 5)
    return _measured(spark, d, tree).where(S.matches(tree, leaves(tree))).select("id", F.element_at("hits", 1).alias("first"), F.element_at("hits", 2).alias("second"))


def search_stems(spark, d):
    """The eight best by stems of the words."""
    words = S.stemmed(_ementas(spark, d), "id", "ementa")
    tree = parse_simple("prorrogações decadencial", ranked=True)
    found = S.ranked(S.measure_tokens(words, S.stem_tree(spark, tree)), S.stem_tree(spark, tree))
    return found.orderBy(F.round("score", 6).desc(), "id").limit(8).select("id", F.round("score", 6).alias("score"))


def search_header_weight(spark, d):
    """The eight best where a hit in the header counts three times more."""
    tree = parse_simple("prazo decadencial")
    rows = _ementas(spark, d).where("ementa is not null").dropDuplicates(["id"]).select("id", header(F.col("ementa"), 400).alias("header"), "ementa")
    measured = S.in_fields(S.measure_fields(rows, "id", ["header", "ementa"], tree), [3.0, 1.0])
    return S.ranked(measured, tree).orderBy(F.round("score", 6).desc(), "id").limit(8).select("id", F.round("score", 6).alias("score"))


def search_snippets(spark, d):
    """For the page of a ranked query, the window of 16 tokens with most terms."""
    tree = parse_simple(RANKED)
    page = _top(spark, d, tree)
    texts = _ementas(spark, d).join(F.broadcast(page.select("id")), "id", "left_semi")  # eight rows
    return S.snippet(texts, "id", "ementa", leaves(tree)).select("id", "first_token", "distinct_terms", F.array_join("snippet_tokens", " ").alias("snippet"))


def vocab_df(spark, d):
    """The vocabulary with document frequencies."""
    return S.vocabulary(_ementas(spark, d), "id", "ementa")


def _seed(spark, d) -> str:
    return table(spark, d, "documents").where("tribunal = 'STJ'").agg(F.min("id")).first()[0]


def _seed_terms(spark, d, seed: str) -> DataFrame:
    return S.seed_terms(_index(spark, d), _ementas(spark, d).where(F.col("id") == seed), "ementa")


def similar_terms(spark, d):
    """The seed document's 25 strongest terms."""
    return _seed_terms(spark, d, _seed(spark, d)).select("term", F.round("weight", 6).alias("weight"))


def similar_docs(spark, d):
    """Documents by the seed's terms, without the seed."""
    seed = _seed(spark, d)
    terms = [r["term"] for r in _seed_terms(spark, d, seed).collect()]  # 25 at most
    if len(terms) < 3:
        return spark.createDataFrame([], "id string, score double, publication date")
    return _top(spark, d, Node("or", tuple(Leaf(t, (t,)) for t in terms)), F.col("id") != seed)


# The text fields of a precedent and their weights.
PRECEDENT_FIELDS = {"enunciado": 3.0, "questao_submetida": 1.0, "tese_firmada": 3.0, "modulacao": 0.5, "suspensao": 0.5}
PRECEDENT_QUERY = "prazo contrato locatário"


def precedent_texts(precedents: DataFrame, versions: DataFrame) -> DataFrame:
    """Precedents with the text fields of their latest body."""
    latest = versions.where("observed is not null").groupBy("id").agg(F.max_by("body", F.struct("observed", "hash")).alias("body"))
    return precedents.join(latest, "id").select(*precedents.columns, *[F.get_json_object("body", f"$.componentes.{f}").alias(f) for f in PRECEDENT_FIELDS], F.get_json_object("body", "$.materia").alias("materia"))


def ranked_precedents(texts: DataFrame, tree, field: str | None = None) -> DataFrame:
    """``id, score, fields``: BM25 over the weighted fields, or one of them, and the fields that match."""
    names, order = list(PRECEDENT_FIELDS), leaves(tree)
    measured = S.measure_fields(texts, "id", names, tree)
    held = cut(S.in_fields(measured, list(PRECEDENT_FIELDS.values()), None if field is None else names.index(field)), "search-measured")
    named = F.transform("matched", lambda i: F.element_at(F.array(*map(F.lit, names)), i + 1))
    return held.where(S.matches(tree, order)).select("id", S.bm25(S.statistics(held, len(order))).alias("score"), F.array_join(named, "|").alias("fields"))


def _precedent_page(spark, d, tree, field=None) -> DataFrame:
    precedents = table(spark, d, "precedents")
    found = ranked_precedents(precedent_texts(precedents, table(spark, d, "precedent_versions")), tree, field).join(precedents.select("id", "publication"), "id")
    return found.orderBy(F.round("score", 6).desc(), F.col("publication").desc_nulls_last(), "id").limit(10).select("id", F.round("score", 6).alias("score"), "fields")


def precedent_search(spark, d):
    """Precedents by BM25 over five weighted fields."""
    return _precedent_page(spark, d, parse_simple(PRECEDENT_QUERY))


def precedent_search_field(spark, d):
    """Precedents by one field."""
    return _precedent_page(spark, d, parse_simple(PRECEDENT_QUERY), "enunciado")


def index_integrity(spark, d):
    """Documents that the written index lacks, and indexed ids of no document."""
    ids, held = table(spark, d, "documents").select("id"), _index(spark, d).rows().where("term = ''").select("id")
    lost, extra = ids.join(held, "id", "left_anti"), held.join(ids, "id", "left_anti")
    return lost.select("id", F.lit("no_text").alias("problem")).unionByName(extra.select("id", F.lit("no_document").alias("problem")))


def filter_contains_folded(spark, d):
    """Accent- and case-insensitive substring of the reporting judge's name."""
    rows = table(spark, d, "document_details").where(F.contains(folded(F.col("relator")), F.lit("MARIA")))
    return rows.select("id", "relator").distinct()


def dense_nearest(spark, d):
    """The ten vectors nearest to the first one by cosine."""
    from autuario.operators.fusion import nearest

    vectors = table(spark, d, "embeddings")
    query = vectors.orderBy("vec_id").select("embedding").first()[0]
    return nearest(vectors, "vec_id", "embedding", query, 10).select("id", F.round("similarity", 5).alias("similarity"))


def dense_nearest_each(spark, d):
    """For every vector whose id is divisible by 50, the ten nearest of all vectors by cosine."""
    from autuario.operators.fusion import nearest_of_each

    vectors = table(spark, d, "embeddings")
    return nearest_of_each(vectors, vectors.where("vec_id % 50 = 0"), "vec_id", "embedding", 10).select("query", "id", F.round("similarity", 5).alias("similarity"))


def fused_ranks(spark, d):
    """Two lexical rankings of twenty, of all terms and of a phrase, fused by reciprocal ranks."""
    from autuario.operators.fusion import reciprocal_ranks

    a, b = (_top(spark, d, parse_simple(q), k=20) for q in (RANKED, PHRASE))
    fused = reciprocal_ranks([(a, F.col("score").desc(), 1.0), (b, F.col("score").desc(), 0.5)], 10)
    return fused.select("id", F.round("score", 9).alias("score"))


QUERIES = {f.__name__: f for f in (
    dense_nearest, dense_nearest_each, fused_ranks,
    search_rank_or, search_rank_phrase, search_rank_prefix, search_boolean_nested, search_date_order, search_broadened, search_term_counts, search_total,
    search_empty_reason, search_index_rank, search_index_updated, search_prefix_cut, search_stems, search_header_weight, search_snippets, vocab_df, similar_terms, similar_docs, precedent_search, precedent_search_field, index_integrity, filter_contains_folded,
)}

_TOKENS = "list_filter(string_split_regex(lower(strip_accents({})), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"
_W = f"w as (select id, any_value({_TOKENS.format('ementa')}) as w from search where id is not null and ementa is not null group by id)"


def _sql_hits(leaf: Leaf) -> str:
    t = leaf.tokens
    if len(t) == 1:
        return f"len(list_filter(w, lambda x: {f'starts_with(x, {t[0]!r})' if leaf.prefix else f'x = {t[0]!r}'}))"
    return "len(list_filter(range(1, greatest(len(w) - %d, 1)), lambda i: %s))" % (len(t) - 2, " and ".join(f"w[i + {k}] = {x!r}" for k, x in enumerate(t)))


def _sql_match(tree, order) -> str:
    if isinstance(tree, Leaf):
        return f"h{order.index(tree)} > 0"
    return "(" + f" {tree.kind} ".join(_sql_match(p, order) for p in tree.parts) + ")"


def _sql_measured(tree, more: str = "") -> str:
    order = leaves(tree)
    hits = ", ".join(f"{_sql_hits(x)} as h{i}" for i, x in enumerate(order))
    return f"with {_W}, m as (select id, len(w) as dl, {hits}{more} from w)"


def _sql_precedents(tree, field: str | None = None) -> str:
    order, names = leaves(tree), list(PRECEDENT_FIELDS)
    used = names if field is None else [field]
    count = lambda f, x: _sql_hits(x).replace("(w,", f"(w_{f},")
    hits = ", ".join(f"{' + '.join(f'{PRECEDENT_FIELDS[f]} * {count(f, x)}' for f in used)} as h{i}" for i, x in enumerate(order))
    named = ", ".join(f"case when {' + '.join(count(f, x) for x in order)} > 0 then '{f}' end" for f in used)
    stats = ", ".join(f"count(*) filter (h{i} > 0) as d{i}" for i in range(len(order)))
    score = " + ".join(f"greatest(ln((n - d{i} + 0.5) / (d{i} + 0.5)), 1e-6) * h{i} * 2.2 / (h{i} + 1.2 * (0.25 + 0.75 * dl / mean))" for i in range(len(order)))
    words = ", ".join(_TOKENS.format(f"coalesce(body ->> '$.componentes.{f}', '')") + f" as w_{f}" for f in names)
    return f"""with l as (select id, body from precedent_versions where observed is not null qualify row_number() over (partition by id order by observed desc, hash desc) = 1),
 t as (select p.id, p.publication, {words} from precedents p join l on l.id = p.id), m as (select id, publication, {' + '.join(f'len(w_{f})' for f in names)} as dl, {hits}, concat_ws('|', {named}) as fields from t),
 s as (select count(*) as n, avg(dl) as mean, {stats} from m) select id, round({score}, 6) as score, fields from m, s where {_sql_match(tree, order)} order by round({score}, 6) desc, publication desc nulls last, id limit 10"""


def _sql_scored(tree) -> str:
    order = leaves(tree)
    stats = ", ".join(f"count(*) filter (h{i} > 0) as d{i}" for i in range(len(order)))
    score = " + ".join(f"greatest(ln((n - d{i} + 0.5) / (d{i} + 0.5)), 1e-6) * h{i} * 2.2 / (h{i} + 1.2 * (0.25 + 0.75 * dl / mean))" for i in range(len(order)))
    return f"{_sql_measured(tree)}, s as (select count(*) as n, avg(dl) as mean, {stats} from m), r as (select id, round({score}, 6) as score from m, s where {_sql_match(tree, order)})"


def _sql_top(tree, where: str = "true") -> str:
    return f"{_sql_scored(tree)} select r.id, score, publication from r join documents d on d.id = r.id where {where} order by score desc, publication desc nulls last, r.id limit 8"


_OR, _AND_DATE, _NO = parse_simple(RANKED), parse_simple("prazo mora dano", ranked=False), parse_simple(NOWHERE, ranked=False)
_NEST, _USU = parse_advanced(NESTED), parse_simple("usucapião", ranked=False)
_present = "concat_ws('|', %s)" % ", ".join(f"case when h{i} > 0 then {x.text + '*' * x.prefix!r} end" for i, x in enumerate(leaves(_NEST)))
_SEED = "(select min(id) from documents where tribunal = 'STJ')"
_TERMS = f"""with {_W}, n as (select count(*) as n from w), mine as (select term, count(*) as tf from (select unnest(w) as term from w where id = {_SEED}) where regexp_full_match(term, '\\p{{L}}{{3,}}') group by term),
 df as (select term, count(*) as documents from (select unnest(list_distinct(w)) as term from w) where term in (select term from mine) group by term),
 terms as (select term, round(tf * ln(n / documents), 6) as weight from df join mine using (term), n where documents >= 5 and documents <= 0.25 * n order by round(tf * ln(n / documents), 9) desc, term limit 25)"""

def _sql_page(tree, k: int) -> str:
    return f"({_sql_top(tree)[: -len('limit 8')]} limit {k})"


_UPDATED = _sql_top(_OR).replace("from search where", "from search where id not like 'STJ:%0' and", 1)
_SNIPPETS = f"""with k as (select id from {_sql_page(_OR, 8)}), {_W}, t as (select id, w from w where id in (select id from k)),
 s as (select id, w, i, len(list_distinct(list_filter(w[i:i + 15], lambda x: x in ({', '.join(repr(x.tokens[0]) for x in leaves(_OR))})))) as n from (select id, w, unnest(range(1, greatest(len(w) - 15, 1) + 1)) as i from t)),
 b as (select *, row_number() over (partition by id order by n desc, i) as r from s)
 select id, (i - 1)::int as first_token, n::int as distinct_terms, array_to_string(w[i:i + 15], ' ') as snippet from b where r = 1"""

_CUT = cut_prefixes(parse_simple("prorrogação decadencial", ranked=False), 5)

_HEAVY = parse_simple("prazo decadencial")


def _sql_headed(tree) -> str:
    order = leaves(tree)
    opening = relations.SQL["headers"].replace("120", "400").replace("121", "401")
    hits = ", ".join(f"3.0 * {_sql_hits(x).replace('(w,', '(wh,')} + {_sql_hits(x).replace('(w,', '(we,')} as h{i}" for i, x in enumerate(order))
    stats = ", ".join(f"count(*) filter (h{i} > 0) as d{i}" for i in range(len(order)))
    score = " + ".join(f"greatest(ln((n - d{i} + 0.5) / (d{i} + 0.5)), 1e-6) * h{i} * 2.2 / (h{i} + 1.2 * (0.25 + 0.75 * dl / mean))" for i in range(len(order)))
    return f"""with o as ({opening}), t as (select o.id, any_value({_TOKENS.format('header')}) as wh, any_value({_TOKENS.format('ementa')}) as we from o join search s on s.id = o.id where ementa is not null group by o.id),
 m as (select id, len(wh) + len(we) as dl, {hits} from t), s as (select count(*) as n, avg(dl) as mean, {stats} from m)
 select id, round({score}, 6) as score from m, s where {_sql_match(tree, order)} order by round({score}, 6) desc, id limit 8"""


_STEMMED = "case " + " ".join(f"when ends_with(x, '{e}') and length(x) >= {len(e) + k} then x[1:length(x) - {len(e)}]" for e, k in sorted(ENDINGS, key=lambda e: -len(e[0]))) + " else x end"
_STEM_TREE = Node("or", tuple(Leaf(t, (t,)) for t in ("prorrog", "decadencial")))  # of prorrogações and decadencial

SQL = {
    "search_stems": _sql_scored(_STEM_TREE).replace(_W, _W.replace("w as (", "w0 as (") + f", w as (select id, list_transform(w, lambda x: {_STEMMED}) as w from w0)") + " select id, score from r order by score desc, id limit 8",
    "search_header_weight": _sql_headed(_HEAVY),
    "search_prefix_cut": f"{_sql_measured(_CUT)} select id, h0::int as first, h1::int as second from m where {_sql_match(_CUT, leaves(_CUT))}",
    "search_index_updated": _UPDATED,
    "search_snippets": _SNIPPETS,
    "precedent_search": _sql_precedents(parse_simple(PRECEDENT_QUERY)),
    "precedent_search_field": _sql_precedents(parse_simple(PRECEDENT_QUERY), "enunciado"),
    "dense_nearest": "select vec_id as id, round(list_cosine_similarity(embedding::double[], (select embedding::double[] from embeddings order by vec_id limit 1)), 5) as similarity from embeddings order by round(list_cosine_similarity(embedding::double[], (select embedding::double[] from embeddings order by vec_id limit 1)), 9) desc, vec_id limit 10",
    "dense_nearest_each": """select query, id, round(c, 5) as similarity from (select q.vec_id as query, v.vec_id as id, list_cosine_similarity(v.embedding::double[], q.embedding::double[]) as c from embeddings q, embeddings v where q.vec_id % 50 = 0)
 qualify row_number() over (partition by query order by round(c, 9) desc, id) <= 10""",
    "fused_ranks": f"""with a as (select id, 1.0 / (60 + row_number() over (order by score desc, id)) as part from {_sql_page(_OR, 20)}), b as (select id, 0.5 / (60 + row_number() over (order by score desc, id)) as part from {_sql_page(parse_simple(PHRASE), 20)})
 select id, round(sum(part), 9) as score from (select * from a union all select * from b) group by id order by round(sum(part), 12) desc, id limit 10""",
    "search_rank_or": _sql_top(_OR, "tribunal = 'TJSC' and organ is not null"),
    "search_rank_phrase": _sql_top(parse_simple(PHRASE)),
    "search_rank_prefix": _sql_top(parse_advanced(PREFIX.replace(" ", " OU "))),
    "search_index_rank": _sql_top(parse_simple('"partilha de bens" usucapião')),
    "search_boolean_nested": f"{_sql_measured(_NEST)} select id, {_present} as present from m where {_sql_match(_NEST, leaves(_NEST))}",
    "search_date_order": f"{_sql_measured(_AND_DATE)} select m.id, judgment from m join documents d on d.id = m.id where {_sql_match(_AND_DATE, leaves(_AND_DATE))} order by judgment desc nulls last, m.id limit 10 offset 10",
    "search_broadened": f"{_sql_measured(_NO)} select id, {' + '.join(f'(h{i} > 0)::int' for i in range(4))} as terms_present from m where {_sql_match(broadened(_NO), leaves(_NO))}",
    "search_term_counts": f"{_sql_measured(_NO)} " + " union all ".join(f"select {x.text!r} as term, count(*) filter (h{i} > 0) as documents from m" for i, x in enumerate(leaves(_NO))),
    "search_total": f"{_sql_measured(_OR)} select count(*) as total, count(*) filter (tribunal = 'STJ') as total_stj from m join documents d on d.id = m.id where {_sql_match(_OR, leaves(_OR))}",
    "search_empty_reason": f"{_sql_measured(_USU)} select count(*) filter (judgment < date '1900-01-01') as total, count(*) as unfiltered, 'outside_coverage' as reason from m join documents d on d.id = m.id where h0 > 0",
    "vocab_df": f"with {_W} select term, count(distinct id) as documents, count(*) as occurrences from (select id, unnest(w) as term from w) group by term",
    "similar_terms": f"{_TERMS} select * from terms",
    "similar_docs": f"""{_TERMS}, k as (select id, len(w) as dl, unnest(w) as term from w), tf as (select id, dl, term, count(*) as h from k where term in (select term from terms) group by all),
 c as (select count(*) as n, avg(len(w)) as mean from w), d2 as (select term, count(*) as d from tf group by term),
 r as (select id, round(sum(greatest(ln((n - d + 0.5) / (d + 0.5)), 1e-6) * h * 2.2 / (h + 1.2 * (0.25 + 0.75 * dl / mean))), 6) as score from tf join d2 using (term), c group by id)
 select r.id, score, publication from r join documents d on d.id = r.id where r.id <> {_SEED} order by score desc, publication desc nulls last, r.id limit 8""",
    "index_integrity": "select id, 'no_text' as problem from documents where id not in (select id from search where id is not null and ementa is not null) union all select distinct id, 'no_document' from search where ementa is not null and id not in (select id from documents)",
    "filter_contains_folded": "select distinct id, relator from document_details where contains(upper(strip_accents(nfc_normalize(relator))), 'MARIA')",
}
