"""Queries on samples, question sets, catalogs, copies and pruning, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from autuario.functions.text import folded
from autuario.operators import publish as P
from autuario.operators import review as R
from autuario.plans import relations
from autuario.sources.tables import table

# What a scan for confidential patterns looks for here.
PATTERNS = {"valor": r"R\$ [0-9.]+,[0-9]{2}", "folha": r"\(fl\. [0-9]+\)"}


def review_sample(spark, d):
    """The sample of the STJ's documents to be reviewed."""
    return R.review_sample(table(spark, d, "documents").where("tribunal = 'STJ'"), "id", "lote-1")


def review_again(spark, d):
    """A further sample, without the one before, and the verdict if all but one in twenty are approved."""
    batch = table(spark, d, "documents").where("tribunal = 'STJ'")
    first = R.review_sample(batch, "id", "lote-1")
    second = R.review_sample(batch, "id", "lote-2", first)
    reviews = second.select("id", (~F.col("draw").startswith("0")).alias("approved"))
    return R.review_verdict(second, reviews, 0.9)


def unjudged_pairs(spark, d):
    """Resolved citations that are no links yet."""
    found = table(spark, d, "document_citations").where("resolvido is not null and tipo = 'acordao'").select("document_id", F.col("resolvido").alias("cited_id"))
    return R.unjudged(found, table(spark, d, "citation_links"), ["document_id", "cited_id"])


def judging_lot(spark, d):
    """Those pairs as a blind lot."""
    found = table(spark, d, "document_citations").where("resolvido is not null and tipo = 'acordao'").select("document_id", F.col("resolvido").alias("cited_id"))
    return R.judging_lot(found, table(spark, d, "citation_links"), ["document_id", "cited_id"], "cego").select("document_id", "cited_id", "place")


def citation_removed(spark, d):
    """The openings of all ementas as questions."""
    return R.without_citations(table(spark, d, "search").where("id is not null").dropDuplicates(["id"]), "id", "ementa")


def question_set(spark, d):
    """A hundred questions with what they should find."""
    return R.question_set(table(spark, d, "search").where("id is not null"), table(spark, d, "document_citations"), "id", "ementa", "conjunto", 100)


def question_scopes(spark, d):
    """Per citing document: the court and the chamber of most of what it cites."""
    cited = table(spark, d, "citation_links").select("document_id", "cited_id").distinct()
    held = table(spark, d, "documents").select(F.col("id").alias("cited_id"), "tribunal", "organ")
    return R.scopes(cited.join(held, "cited_id").withColumn("grade", F.lit(1)), "document_id", "grade", "tribunal", "organ")


def pattern_scan(spark, d):
    """Texts with amounts or leaves of the file."""
    return R.scan_patterns(table(spark, d, "documents"), "doc_id", "text", PATTERNS)


def text_copies(spark, d):
    """Copies of ementas by folded letters and digits."""
    return R.text_copies(table(spark, d, "search"), "id", "ementa")


def catalog_states(spark, d):
    """Precedents cited, by state in the catalog: admitted, known or absent."""
    cited = table(spark, d, "document_citations").where("tipo = 'precedente' and chave <> ''").select(F.col("chave").alias("id")).distinct()
    held = table(spark, d, "precedents").select("id", F.coalesce("admission", F.lit("pendente")).alias("admission"))
    state = F.when(F.col("admission").isNull(), "absent").when(F.col("admission") == "admitido", "admitted").otherwise("known")
    return cited.join(held, "id", "left").select("id", state.alias("state"))


def theme_catalog(spark, d):
    """The catalog of precedents from the latest content of each: number, situation and revision."""
    latest = table(spark, d, "precedent_versions").where("observed is not null").groupBy("id").agg(F.max_by(F.struct("hash", "body"), F.struct("observed", "hash")).alias("v"))
    part = lambda k: F.get_json_object("v.body", f"$.{k}").alias(k)
    return latest.select("id", F.col("v.hash").alias("hash"), part("numero"), part("situacao"), part("revisao").cast("int").alias("revisao"))


def details_derived(spark, d):
    """Documents' details from the current content: body and class as written and folded."""
    seen = table(spark, d, "versions").select("document_id", "hash", "raw")
    current = table(spark, d, "documents").select(F.col("id").alias("document_id"), "hash").join(seen, ["document_id", "hash"]).groupBy("document_id").agg(F.min("raw").alias("raw"))
    part = lambda k: F.get_json_object("raw", f"$.{k}")
    return current.select(F.col("document_id").alias("id"), part("nomeOrgaoJulgador").alias("organ"), folded(part("nomeOrgaoJulgador")).alias("organ_fold"), part("siglaClasse").alias("classe"))


def pruned_versions(spark, d):
    """Contents that readers need: those of the documents held, as they are."""
    return P.prune({n: table(spark, d, n) for n in ("documents", "versions", "precedents", "precedent_versions")})["versions"].select("document_id", "hash").distinct()


def expected_days(spark, d):
    """Per court: the days of its period, by month, on which it published nothing."""
    docs = table(spark, d, "documents").where("publication is not null and publication between '2015-01-01' and '2016-12-31'")
    days = docs.groupBy("tribunal").agg(F.min("publication").alias("a"), F.max("publication").alias("b")).select("tribunal", F.explode(F.sequence("a", "b")).alias("publication"))
    left = days.join(docs.select("tribunal", "publication").distinct(), ["tribunal", "publication"], "left_anti")
    return left.groupBy("tribunal", F.date_format("publication", "yyyy-MM").alias("month")).agg(F.count("*").alias("days"))


QUERIES = {f.__name__: f for f in (
    review_sample, review_again, unjudged_pairs, judging_lot, citation_removed, question_set, question_scopes, pattern_scan, text_copies, catalog_states, theme_catalog, details_derived,
    pruned_versions, expected_days,
)}

_STJ = "(select distinct id from documents where tribunal = 'STJ' and id is not null)"
_SIZE = f"(select greatest(10, ceil(count(*) * 5 / 100.0))::int as k from {_STJ})"
_FIRST = f"(select id from (select id, row_number() over (order by sha256('lote-1:' || id), id) as r from {_STJ}), {_SIZE} where r <= k)"
_PAIRS = "(select distinct document_id, resolvido as cited_id from document_citations where resolvido is not null and tipo = 'acordao' and (document_id, resolvido) not in (select (document_id, cited_id) from citation_links))"
_FOLD = "regexp_replace(upper(strip_accents(nfc_normalize(ementa))), '[^\\p{L}\\p{N}]+', '', 'g')"

_OPENING = relations.SQL["headers"].replace("120", "1000").replace("121", "1001")
_BARE = (
    "(?i)\\b(?:agint|agrg|edcl|earesp|eresp|aresp|resp|rms|rhc|hc|tema|s[úu]mula(?:\\s+vinculante)?|irdr|iac)\\b(?:\\s+n[oa]s?\\s+\\p{L}+)*\\s*(?:n[.º°]*)?\\s*[0-9][0-9.-]*(?:/[A-Z]{2}\\b|/[0-9]+)?"
    "|\\b[0-9]{7}-[0-9]{2}\\.[0-9]{4}\\.[0-9]\\.[0-9]{2}\\.[0-9]{4}\\b"
)
_QUESTIONS = f"""(select id, q as query from (select id, array_to_string(list_filter(string_split(trim(regexp_replace(regexp_replace(header, '{_BARE}', ' ', 'g'), '\\s+', ' ', 'g')), ' '), lambda x: regexp_matches(x, '[\\p{{L}}\\p{{N}}]'))[1:30], ' ') as q from ({_OPENING})) where q <> '')"""

SQL = {
    "citation_removed": f"select id, query from {_QUESTIONS}",
    "question_set": f"""with c as (select document_id as id, min(resolvido) as wanted from document_citations where resolvido is not null group by 1)
 select id, query, wanted from {_QUESTIONS} join c using (id) order by sha256('conjunto:' || id) limit 100""",
    "review_sample": f"select id, sha256('lote-1:' || id) as draw from {_STJ} where id in {_FIRST}",
    "review_again": f"""with s as (select id, draw from (select id, sha256('lote-2:' || id) as draw, row_number() over (order by sha256('lote-2:' || id), id) as r from {_STJ} where id not in {_FIRST}), {_SIZE} where r <= k)
 select count(*) as sampled, count(*) as reviewed, count(*) filter (not starts_with(draw, '0')) as approved, count(*) filter (not starts_with(draw, '0')) >= count(*) * 0.9 as accepted from s""",
    "unjudged_pairs": f"select * from {_PAIRS}",
    "judging_lot": f"select document_id, cited_id, row_number() over (partition by document_id order by sha256('cego:' || document_id || '|' || cited_id)) as place from {_PAIRS}",
    "question_scopes": """with c as (select distinct document_id, cited_id from citation_links), h as (select document_id, tribunal, organ from c join documents d on d.id = c.cited_id),
 s as (select document_id as query, 'tribunal' as scope, tribunal as value, count(*) as relevant from h where tribunal is not null group by all union all select document_id, 'organ', organ, count(*) from h where organ is not null group by all)
 select * from s qualify row_number() over (partition by query, scope order by relevant desc, value) = 1""",
    "pattern_scan": " union all ".join(
        f"""select doc_id as id, '{n}' as pattern, regexp_extract(text, '{p}') as found, length(split_part(text, regexp_extract(text, '{p}'), 1)) - length(replace(split_part(text, regexp_extract(text, '{p}'), 1), chr(10), '')) + 1 as line,
 len(regexp_extract_all(text, '{p}')) as times from documents where regexp_matches(text, '{p}')""" for n, p in PATTERNS.items()),
    "text_copies": f"""with k as (select distinct id, {_FOLD} as k from search where id is not null and ementa is not null), g as (select k, min(id) as kept_id from k where k <> '' group by k)
 select kept_id, id as copy_id from k join g using (k) where id <> kept_id""",
    "catalog_states": """select distinct chave as id, case when p.id is null then 'absent' when p.admission = 'admitido' then 'admitted' else 'known' end as state
 from document_citations c left join precedents p on p.id = c.chave where tipo = 'precedente' and chave <> ''""",
    "theme_catalog": """select id, hash, body ->> '$.numero' as numero, body ->> '$.situacao' as situacao, (body ->> '$.revisao')::int as revisao from precedent_versions where observed is not null
 qualify row_number() over (partition by id order by observed desc, hash desc) = 1""",
    "details_derived": """with c as (select d.id, min(v.raw) as raw from documents d join versions v on v.document_id = d.id and v.hash = d.hash group by d.id)
 select id, raw ->> '$.nomeOrgaoJulgador' as organ, replace(replace(upper(strip_accents(raw ->> '$.nomeOrgaoJulgador')), 'ª', 'A'), 'º', 'O') as organ_fold, raw ->> '$.siglaClasse' as classe from c""",
    "pruned_versions": "select distinct document_id, hash from versions v where exists (select 1 from documents d where d.id = v.document_id and d.hash = v.hash)",
    "expected_days": """with p as (select distinct tribunal, publication from documents where publication between date '2015-01-01' and date '2016-12-31'), b as (select tribunal, min(publication) as a, max(publication) as b from p group by 1),
 g as (select tribunal, unnest(generate_series(a, b, interval 1 day))::date as publication from b) select tribunal, strftime(publication, '%Y-%m') as month, count(*) as days from g anti join p using (tribunal, publication) group by all""",
}
