"""Queries of the general problems (2, 4 and 7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from autuario.operators.history import history, snapshot_history
from autuario.operators.orphans import KEY, OrphanLedger, corpus_parents, corpus_references
from autuario.operators.snapshots import deliveries, snapshot_changes
from autuario.sources.tables import table

P2_COLUMNS = ("source_table", "source_field", "document_id", "ord", "missing_ref")


def _ledger(spark: SparkSession, d: str) -> OrphanLedger:
    """The ledger after all deliveries, by steps.

    All documents ever logged arrive; the references of document_citations probe them;
    the documents held and the precedents arrive, which resolve references that wait,
    together with the references of citation_links; the documents logged but no longer
    held are deleted, which reopens what refers to them. The counts of each step are kept.
    """
    citations, links, documents, precedents = (table(spark, d, n) for n in ("document_citations", "citation_links", "documents", "precedents"))
    held = corpus_parents(documents, precedents)
    logged = table(spark, d, "versions").select(F.explode(F.array(*[F.concat(F.lit(k), "document_id") for k in ("d|", "e|")])).alias(KEY)).where(f"{KEY} is not null")
    refs = corpus_references(citations, links)
    ledger = OrphanLedger.empty(spark, refs)
    ledger = ledger.step(arrived=logged)
    ledger = ledger.step(refs=corpus_references(citations, links.limit(0)))
    ledger = ledger.step(refs=corpus_references(citations.limit(0), links), arrived=held)
    gone = logged.distinct().join(held.where(f"{KEY} like 'd|%' or {KEY} like 'e|%'"), KEY, "left_anti")
    return ledger.step(deleted=gone)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """References without a target."""
    return _ledger(spark, d).pending.select(*P2_COLUMNS)


def p2_counts(spark: SparkSession, d: str) -> DataFrame:
    """Orphans per table, field and month of the citing document's publication (null: no date or no such document)."""
    month = table(spark, d, "documents").select(F.col("id").alias("document_id"), F.date_format("publication", "yyyy-MM").alias("month"))
    per_document = _ledger(spark, d).pending.groupBy("source_table", "source_field", "document_id").agg(F.count("*").alias("n"))
    return per_document.join(month, "document_id", "left").groupBy("source_table", "source_field", "month").agg(F.sum("n").alias("orphans"))


def p2_snapshots(spark: SparkSession, d: str) -> DataFrame:
    """Orphans per table and field after each step that changed references: with the documents logged, with those held, after the deletions."""
    last = _ledger(spark, d)
    versions = range(2, last.version + 1)
    for v in versions:
        last.at(v).snapshot("source_table", "source_field")
    return last.snapshots(*versions).select("version", "source_table", "source_field", "orphans")


def p4_periods(spark: SparkSession, d: str) -> DataFrame:
    """All periods with their ends."""
    of = [
        table(spark, d, name).select(F.lit(name).alias("source_table"), F.col(entity).alias("entity"), "hash", F.col(instant).alias("instant"))
        for name, entity, instant in (("versions", "document_id", "first_seen"), ("precedent_versions", "id", "observed"))
    ]
    text = lambda c: F.substring(F.col(c).cast("string"), 1, 19).alias(c)
    periods = history(of[0].unionByName(of[1]), ["source_table", "entity"], "hash", "instant")
    return periods.select("entity_id.source_table", F.col("entity_id.entity").alias("entity_id"), F.col("content").alias("hash"), text("valid_from"), text("valid_to"), "change")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Each period of validity with its first instant."""
    return p4_periods(spark, d).select("source_table", "entity_id", "hash", "valid_from").distinct()


def p4_snapshots(spark: SparkSession, d: str) -> DataFrame:
    """Periods in which a document had a content in its dataset, from the dataset's full deliveries; a document that is left out ends."""
    w = Window.partitionBy("dataset").orderBy("rank_key", "id")  # deliveries of one dataset: few
    ok = table(spark, d, "resources").where("status = 'ok' and id is not null").select("dataset", "rank_key", "id").distinct()
    steps = ok.select(F.col("id").alias("step"), F.lag("id").over(w).alias("prev"), F.col("id").alias("next"), F.row_number().over(w).alias("at"), "dataset")
    entries = table(spark, d, "observations").select(F.col("resource_id").alias("snapshot"), F.col("document_id").alias("entity_id"), F.col("hash").alias("content"))
    return snapshot_history(entries, steps, "dataset").select("dataset", F.col("entity_id").alias("document_id"), F.col("content").alias("hash"), F.col("valid_from").alias("from_delivery"), F.col("valid_to").alias("to_delivery"), "change")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents added, removed or changed from each delivery of a dataset to its next."""
    steps = deliveries(table(spark, d, "resources"))
    entries = table(spark, d, "observations").select(F.col("resource_id").alias("snapshot"), F.col("document_id").alias("key"), "hash")
    wanted = steps.select(F.explode(F.array("prev", "next")).alias("snapshot")).distinct()
    held = entries.join(wanted, "snapshot", "left_semi")
    return snapshot_changes(held, steps).select(F.col("next").alias("resource_id"), F.col("key").alias("document_id"), "change")


QUERIES = {"p2_found": p2_found, "p2_counts": p2_counts, "p2_snapshots": p2_snapshots, "p4_found": p4_found, "p4_periods": p4_periods, "p4_snapshots": p4_snapshots, "p7_found": p7_found}

_KEY = """case when upper(trim(split_part(chave, ':', 1))) = 'STJ' then 'STJ:' || trim(upper(regexp_replace(regexp_replace(chave, '^[^:]*:', ''), ':?[^:]*$', ''))) || ':' || regexp_replace(regexp_extract(chave, '[^:]*$'), '[^0-9]', '', 'g')
 when upper(trim(split_part(chave, ':', 1))) = 'TJSC' then 'TJSC:' || regexp_replace(regexp_extract(chave, '[^:]*$'), '[^0-9]', '', 'g') end"""
_ORPHANS = f"""select distinct * from (
 select 'document_citations' as source_table, 'resolvido' as source_field, document_id, ord, resolvido as missing_ref from document_citations
 where resolvido is not null and resolvido not in (select id from documents where id is not null) and resolvido not in (select id from precedents)
 union all select 'document_citations', 'chave', document_id, ord, chave from document_citations
 where tipo = 'precedente' and chave <> '' and chave not in (select id from precedents)
 union all select 'document_citations', 'chave', document_id, ord, chave from (select *, {_KEY} as k from document_citations where tipo in ('acordao', 'similar') and chave <> '')
 where k is not null and k not in (select case when tribunal = 'STJ' then 'STJ:' || trim(upper(classe)) || ':' || process else 'TJSC:' || process end from documents where process is not null and classe is not null)
 union all select 'citation_links', 'cited_id', document_id, -1, cited_id from citation_links where cited_id not in (select id from documents where id is not null))"""


def _orphans_with(e: str, p: str, documents: str, links: str) -> str:
    """The orphans of each field where the ids held are ``e``, the precedents ``p``, and the documents with keys ``documents``."""
    one = f"""select 'document_citations' as source_table, 'resolvido' as source_field, document_id, ord, resolvido as r from document_citations where resolvido is not null and resolvido not in ({e})
 union select 'document_citations', 'chave', document_id, ord, chave from document_citations where tipo = 'precedente' and chave <> '' and chave not in ({p})
 union select 'document_citations', 'chave', document_id, ord, chave from (select *, {_KEY} as k from document_citations where tipo in ('acordao', 'similar') and chave <> '') where k is not null and k not in ({documents})"""
    return one + (f" union select 'citation_links', 'cited_id', document_id, -1, cited_id from citation_links where cited_id is not null and cited_id not in ({links})" if links else "")


_IDS, _LOGGED, _PRECEDENTS = "select id from documents where id is not null", "select document_id from versions where document_id is not null", "select id from precedents where id is not null"
_KEYS = "select case when tribunal = 'STJ' then 'STJ:' || trim(upper(classe)) || ':' || process else 'TJSC:' || process end from documents where process is not null and classe is not null"
_STEPS = (
    (2, _orphans_with(_LOGGED, "select id from precedents where false", "select '' where false", "")),
    (3, _orphans_with(f"{_LOGGED} union {_IDS} union {_PRECEDENTS}", _PRECEDENTS, _KEYS, f"{_LOGGED} union {_IDS}")),
    (4, _orphans_with(f"{_IDS} union {_PRECEDENTS}", _PRECEDENTS, _KEYS, _IDS)),
)


def _periods(t: str, e: str, i: str) -> str:
    return f"""select '{t}' as source_table, {e} as entity_id, hash, {i} as t, lag(hash) over w as ph, row_number() over w as k from (select distinct {e}, hash, {i} from {t} where {i} is not null and {e} is not null) window w as (partition by {e} order by {i}, hash)"""


_STARTS = f"""select * from ({_periods('versions', 'document_id', 'first_seen')} union all {_periods('precedent_versions', 'id', 'observed')}) where k = 1 or hash is distinct from ph"""

SQL = {
    "p2_found": _ORPHANS,
    "p2_counts": f"select source_table, source_field, strftime(publication, '%Y-%m') as month, count(*) as orphans from ({_ORPHANS}) o left join documents d on d.id = o.document_id group by all",
    "p2_snapshots": " union all ".join(f"select {v} as version, source_table, source_field, count(*) as orphans from ({q}) group by all" for v, q in _STEPS),
    "p4_found": f"select source_table, entity_id, hash, strftime(t, '%Y-%m-%d %H:%M:%S') as valid_from from ({_STARTS})",
    "p4_periods": f"""select source_table, entity_id, hash, strftime(t, '%Y-%m-%d %H:%M:%S') as valid_from, strftime(lead(t) over (partition by source_table, entity_id order by t, hash), '%Y-%m-%d %H:%M:%S') as valid_to, case when k = 1 then 'inserted' else 'changed' end as change from ({_STARTS})""",
    "p4_snapshots": """with r as (select id, dataset, row_number() over w as k, lag(id) over w as prev from (select distinct id, dataset, rank_key from resources where status = 'ok') window w as (partition by dataset order by rank_key, id)),
 o as (select resource_id, document_id, case when bool_or(hash is null) then null else min(hash) end as hash from observations where document_id is not null group by all),
 a as (select r.id, k, dataset, document_id, hash from r join o on o.resource_id = r.id), b as (select r.id, k, dataset, document_id, hash from r join o on o.resource_id = r.prev),
 e as (select coalesce(a.dataset, b.dataset) as dataset, coalesce(a.document_id, b.document_id) as document_id, a.hash, coalesce(a.k, b.k) as k, case when b.id is null then 'inserted' when a.id is null then 'deleted' else 'changed' end as change
 from a full join b on a.id = b.id and a.document_id = b.document_id where a.id is null or b.id is null or a.hash is distinct from b.hash),
 p as (select *, lead(k) over (partition by dataset, document_id order by k) as nk from e)
 select dataset, document_id, hash, k as from_delivery, nk as to_delivery, change from p where change <> 'deleted'""",
    "p7_found": """with o as (select resource_id, document_id, min(coalesce(hash, '')) as hash from observations where document_id is not null group by all),
 r as (select id, lag(id) over (partition by dataset order by rank_key, id) as prev from resources where status = 'ok'),
 a as (select r.id, o.document_id, o.hash from r join o on o.resource_id = r.id where prev is not null),
 b as (select r.id, o.document_id, o.hash from r join o on o.resource_id = r.prev)
 select coalesce(a.id, b.id) as resource_id, coalesce(a.document_id, b.document_id) as document_id, case when b.id is null then 'added' when a.id is null then 'removed' else 'changed' end as change
 from a full join b on a.id = b.id and a.document_id = b.document_id where a.hash is distinct from b.hash""",
}
