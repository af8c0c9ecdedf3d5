"""Queries on sections, citations and the citation graph, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from autuario.operators import citations as C
from autuario.operators.sections import sections
from autuario.sources.tables import table


def _ementas(spark, d) -> DataFrame:
    return table(spark, d, "search").where("id is not null and ementa is not null").distinct()


def section_spans(spark, d):
    """Sections of every ementa, with offsets."""
    return sections(_ementas(spark, d), "id", "ementa").select("id", "name", "start", "end", "digest")


def section_counts(spark, d):
    """How many ementas have each section, and its mean length."""
    s = sections(_ementas(spark, d), "id", "ementa")
    return s.groupBy("name").agg(F.count("*").alias("n"), F.sum(F.col("end") - F.col("start")).alias("characters"))


def citations_judgments(spark, d):
    return C.cited_judgments(_ementas(spark, d), "id", "ementa")


def citations_provisions(spark, d):
    return C.cited_provisions(_ementas(spark, d), "id", "ementa")


def citations_first(spark, d):
    return C.first_occurrences(table(spark, d, "document_citations"))


def citations_resolved(spark, d):
    """Citations with what they refer to; candidates joined by a bar."""
    r = C.resolve(table(spark, d, "document_citations"), table(spark, d, "documents"), table(spark, d, "precedents"))
    return r.select("document_id", "ord", "tipo", "chave", "resolvido", F.array_join("candidatos", "|").alias("candidatos"))


def citations_links(spark, d):
    return C.links(C.resolve(table(spark, d, "document_citations"), table(spark, d, "documents"), table(spark, d, "precedents")))


def citations_summary(spark, d):
    """Per type: citations, resolved, ambiguous, without a key."""
    rows = table(spark, d, "document_citations").select("document_id", "ord", "tipo", "chave", "resolvido", F.size("candidatos").alias("c")).distinct()
    return rows.groupBy("tipo").agg(
        F.count("*").alias("total"), F.count("resolvido").alias("resolved"), F.count_if(F.col("c") > 1).alias("ambiguous"), F.count_if(F.coalesce("chave", F.lit("")) == "").alias("unkeyed")
    )


def filter_citing(spark, d):
    """Documents that cite a given precedent, by stored key."""
    cites = table(spark, d, "document_citations").where("tipo = 'precedente' and chave = 'STJ:sumula:144'").select(F.col("document_id").alias("id"))
    return table(spark, d, "documents").join(cites, "id", "left_semi").select("id", "tribunal", "publication")


def graph_degrees(spark, d):
    """Distinct documents each document cites and is cited by, along resolved or ambiguous links."""
    e = table(spark, d, "citation_links").select("document_id", "cited_id").distinct()
    out = e.groupBy(F.col("document_id").alias("id")).agg(F.count("*").alias("cites"))
    into = e.groupBy(F.col("cited_id").alias("id")).agg(F.count("*").alias("cited_by"))
    return out.join(into, "id", "full_outer").select("id", F.coalesce("cites", F.lit(0)).alias("cites"), F.coalesce("cited_by", F.lit(0)).alias("cited_by"))


def graph_who_cites(spark, d):
    """Documents that cite the most cited document (first by id), and the state of each link."""
    e = table(spark, d, "citation_links").groupBy("document_id", "cited_id").agg(F.min("ambiguo").alias("ambiguo"))
    top = e.join(table(spark, d, "documents").select(F.col("id").alias("cited_id")), "cited_id", "left_semi").groupBy("cited_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "cited_id").limit(1)
    return e.join(F.broadcast(top.select("cited_id")), "cited_id").select("document_id", "cited_id", F.when(F.col("ambiguo"), "ambiguo").otherwise("resolvido").alias("state"))


def reference_check(spark, d):
    """A given list of references against the corpus: held once, held several times, or not held."""
    listed = table(spark, d, "document_citations").where("tipo in ('acordao', 'precedente') and chave <> ''").groupBy("tipo", "chave").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "chave").limit(50)
    asked = listed.select(F.col("chave").alias("document_id"), F.lit(0).alias("ord"), "tipo", "chave")
    r = C.resolve(asked, table(spark, d, "documents"), table(spark, d, "precedents"))
    state = F.when(F.col("resolvido").isNotNull(), "held").when(F.col("candidatos").isNotNull(), "several").otherwise("not_held")
    return r.select("tipo", "chave", state.alias("state"), F.coalesce("resolvido", F.array_join("candidatos", "|")).alias("ids"))


def citations_dated(spark, d):
    """Per type: whether the date of judgment that a citation states is the cited document's."""
    rows = table(spark, d, "document_citations").where("tipo in ('acordao', 'similar')").select("document_id", "ord", "tipo", "texto", "resolvido").distinct()
    held = table(spark, d, "documents").select(F.col("id").alias("resolvido"), "judgment")
    state = C.agreement(C.stated_date(F.col("texto")), F.col("judgment"))
    return rows.join(held, "resolvido", "left").groupBy("tipo", state.alias("state")).agg(F.count("*").alias("n"))


def pending_numbers(spark, d):
    """National numbers cited that no document has, with how many documents cite them."""
    cited = table(spark, d, "document_citations").where("tipo = 'acordao' and chave like 'TJSC:%'").select("document_id", F.regexp_replace("chave", "[^0-9]", "").alias("number")).where("number <> ''")
    counts = cited.groupBy("number").agg(F.count_distinct("document_id").alias("cited_by"))
    return counts.join(table(spark, d, "documents").where("tribunal = 'TJSC'").select(F.col("process").alias("number")), "number", "left_anti")


QUERIES = {f.__name__: f for f in (
    citations_dated, pending_numbers,
    section_spans, section_counts, citations_judgments, citations_provisions, citations_first, citations_resolved, citations_links, citations_summary,
    filter_citing, graph_degrees, graph_who_cites, reference_check,
)}

# Written apart from the operators' tables, so that either shows the other's faults.
_HEADING = (
    "(?im)^([ \\t]*([IVX]+[ \\t]*[.:–-][ \\t]*)?((caso em exame|hip[oó]tese em exame|quest[aã]o em discuss[aã]o|raz[oõ]es de decidir|dispositivo e tese|tese de julgamento"
    "|dispositivos relevantes citados|jurisprud[eê]ncia relevante citada)[ \\t]*([:.–-]|\\r?$)|(?-i:D)ispositivo[ \\t]*[:.–-]?[ \\t]*\\r?$))"
)
_NAMED = """case when i = 1 then 'cabecalho' when h like '%caso em exame%' or h like '%hipotese em exame%' then 'caso_em_exame' when h like '%questao em discussao%' then 'questao_em_discussao'
 when h like '%razoes de decidir%' then 'razoes_de_decidir' when h like '%tese de julgamento%' then 'tese_na_ementa' when h like '%dispositivos relevantes citados%' then 'dispositivos_citados'
 when h like '%jurisprudencia relevante citada%' then 'jurisprudencia_citada' else 'dispositivo_e_tese' end"""
_SPANS = f"""e as (select distinct id, ementa from search where id is not null and ementa is not null),
 p as (select id, ementa, sha256(ementa) as digest, string_split(regexp_replace(ementa, '{_HEADING}', chr(1) || '\\1', 'g'), chr(1)) as parts from e),
 x as (select id, digest, i, parts[i] as part, list_sum(list_transform(parts[1:i-1], lambda s: length(s)))::int as start, lower(strip_accents(regexp_extract(parts[i], '{_HEADING}', 1))) as h from (select *, unnest(range(1, len(parts) + 1)) as i from p where len(parts) > 1)),
 n as (select *, {_NAMED} as name from x),
 s as (select id, name, coalesce(start, 0)::int as start, (coalesce(start, 0) + length(part))::int as "end", digest, part as text from n where id not in (select id from n group by id having count(*) <> count(distinct name)) and (name <> 'cabecalho' or trim(part) <> ''))"""
_LABEL = "dispositivos relevantes citados|jurisprud[eê]ncia relevante citada"
_CLOSING = f"""{_SPANS}, cl as (select id, name, text from s where name in ('dispositivos_citados', 'jurisprudencia_citada')),
 fb as (select id, k.name, regexp_extract(ementa, '(?is)^.*((' || k.l || ')\\s*[:.].*)$', 1) as rest from e, (values ('dispositivos_citados', 'dispositivos relevantes citados'), ('jurisprudencia_citada', 'jurisprud[eê]ncia relevante citada')) k(name, l) where id not in (select id from cl)),
 li as (select id, name, text from cl union all select id, name, regexp_extract(rest, '(?is)^(.+?)(\\r?\\n\\s*({_LABEL}).*)?$', 1) from fb where rest <> ''),
 ln as (select id, name, regexp_replace(text, '(?i)^\\s*({_LABEL})\\s*[:.]?\\s*', '') as line from li)"""
_SIGLAS = "AgInt|AgRg|EDcl|EREsp|EAREsp|AREsp|REsp|RMS|RHC|HC|CC|ARE|ADI|ADPF|ADC|Rcl|MS|Pet|AR|RE|EmbDiv|SLS|SS|CR|HD|MI|RO"
# Items as the tables here have them: class and number, or a national number; no item names a precedent.
_JUDGMENTS = f"""{_CLOSING}, it as (select id, k, trim(item, ' .' || chr(9) || chr(10) || chr(13)) as texto from (select id, unnest(string_split(line, ';')) as item, generate_subscripts(string_split(line, ';'), 1) as k from ln where name = 'jurisprudencia_citada')),
 ks as (select id, k, texto, replace(upper(regexp_extract(texto, '^(?:[Ee]\\s+)?(STF|STJ|TST|TSE|TJ-?[A-Z]{{2}})\\b', 1)), '-', '') as court, regexp_replace(regexp_extract(texto, '\\b(\\d{{7}}-?\\d{{2}}\\.?\\d{{4}}\\.?\\d\\.?\\d{{2}}\\.?\\d{{4}})\\b', 1), '[^0-9]', '', 'g') as nat,
 regexp_extract(texto, '\\b((?:{_SIGLAS})(?:\\s+n[oa]s?\\s+(?:{_SIGLAS}))*)\\s*(?:n[.º°]*)?\\s*(\\d{{1,3}}(?:\\.\\d{{3}})+|\\d{{1,9}})', ['c', 'n']) as m from it where texto <> ''),
 ju as (select id, (row_number() over (partition by id order by k) - 1)::int as ord, 'acordao' as tipo, case when nat <> '' then case when court <> '' then court || ':' || nat when nat[14:16] = '824' then 'TJSC:' || nat end
 when m.n <> '' and court in ('', 'STJ', 'STF') then coalesce(nullif(court, ''), 'STJ') || ':' || upper(regexp_replace(m.c, '\\s+', ' ', 'g')) || ':' || replace(m.n, '.', '')::bigint end as chave, texto from ks)"""
_NORM = """case when upper(trim(split_part(chave, ':', 1))) = 'STJ' then 'k|STJ:' || trim(upper(regexp_replace(regexp_replace(chave, '^[^:]*:', ''), ':?[^:]*$', ''))) || ':' || regexp_replace(regexp_extract(chave, '[^:]*$'), '[^0-9]', '', 'g')
 when upper(trim(split_part(chave, ':', 1))) = 'TJSC' then 'k|TJSC:' || regexp_replace(regexp_extract(chave, '[^:]*$'), '[^0-9]', '', 'g') end"""
_RESOLVED = f"""t as (select case when tribunal = 'STJ' then 'k|STJ:' || trim(upper(classe)) || ':' || process else 'k|TJSC:' || process end as key, id from documents union all select 'p|' || id, id from precedents),
 a as (select key, list_sort(list(distinct id)) as ids from t where key is not null group by key),
 k as (select *, case when tipo = 'precedente' and chave <> '' then 'p|' || chave when tipo in ('acordao', 'similar') then {_NORM} end as key from c),
 r as (select document_id, ord, tipo, chave, case when len(ids) = 1 then ids[1] end as resolvido, case when len(ids) > 1 then ids end as candidatos from k left join a using (key))"""
_CITED = "c as (select distinct document_id, ord, tipo, chave from document_citations)"

SQL = {
    "citations_dated": """with r as (select distinct document_id, ord, tipo, texto, resolvido from document_citations where tipo in ('acordao', 'similar')),
 s as (select r.*, try_strptime(regexp_replace(regexp_extract(texto, '\\bj\\.?\\s*(\\d{2}[/.-]\\d{2}[/.-]\\d{4})', 1), '[/.-]', '', 'g'), '%d%m%Y')::date as said, judgment from r left join documents d on d.id = r.resolvido)
 select tipo, case when said is null then 'not_stated' when judgment is null then 'not_held' when said = judgment then 'agrees' else 'differs' end as state, count(*) as n from s group by all""",
    "pending_numbers": """select number, count(distinct document_id) as cited_by from (select document_id, regexp_replace(chave, '[^0-9]', '', 'g') as number from document_citations where tipo = 'acordao' and chave like 'TJSC:%')
 where number <> '' and number not in (select process from documents where tribunal = 'TJSC' and process is not null) group by number""",
    "citations_judgments": f"with {_JUDGMENTS} select id, ord, tipo, chave, texto from ju",
    "section_spans": f'with {_SPANS} select id, name, start, "end", digest from s',
    "section_counts": f'with {_SPANS} select name, count(*) as n, sum("end" - start) as characters from s group by name',
    "citations_first": "select document_id, tipo, case when chave <> '' then chave else texto end as cited, min(ord) as ord from document_citations group by 1, 2, 3",
    "citations_resolved": f"with {_CITED}, {_RESOLVED} select document_id, ord, tipo, chave, resolvido, array_to_string(candidatos, '|') as candidatos from r",
    "citations_links": f"""with {_CITED}, {_RESOLVED}, l as (select document_id, unnest(case when resolvido is not null then [resolvido] else candidatos end) as cited_id, resolvido is null as ambiguo from r where tipo = 'acordao')
 select document_id, cited_id, bool_and(ambiguo) as ambiguo from l where cited_id <> document_id group by all""",
    "citations_summary": """select tipo, count(*) as total, count(resolvido) as resolved, count(*) filter (n > 1) as ambiguous, count(*) filter (coalesce(chave, '') = '') as unkeyed
 from (select distinct document_id, ord, tipo, chave, resolvido, len(candidatos) as n from document_citations) group by tipo""",
    "filter_citing": "select id, tribunal, publication from documents where exists (select 1 from document_citations c where c.document_id = documents.id and tipo = 'precedente' and chave = 'STJ:sumula:144')",
    "graph_degrees": """with e as (select distinct document_id, cited_id from citation_links), o as (select document_id as id, count(*) as n from e group by 1), i as (select cited_id as id, count(*) as n from e group by 1)
 select coalesce(o.id, i.id) as id, coalesce(o.n, 0) as cites, coalesce(i.n, 0) as cited_by from o full join i on o.id = i.id""",
    "graph_who_cites": """with e as (select document_id, cited_id, bool_and(ambiguo) as a from citation_links group by 1, 2),
 t as (select cited_id from e where cited_id in (select id from documents) group by 1 order by count(*) desc, cited_id limit 1)
 select document_id, cited_id, case when a then 'ambiguo' else 'resolvido' end as state from e where cited_id in (select cited_id from t)""",
    "reference_check": f"""with l as (select tipo, chave from document_citations where tipo in ('acordao', 'precedente') and chave <> '' group by 1, 2 order by count(*) desc, chave limit 50),
 c as (select chave as document_id, 0 as ord, tipo, chave from l), {_RESOLVED}
 select tipo, chave, case when resolvido is not null then 'held' when candidatos is not null then 'several' else 'not_held' end as state, coalesce(resolvido, array_to_string(candidatos, '|')) as ids from r""",
}
