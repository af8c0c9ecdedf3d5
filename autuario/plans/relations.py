"""Queries on filters, joins, aggregates, order, sets and functions, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from autuario.functions import legal as L
from autuario.functions import text as T
from autuario.sources.tables import table

TODAY = "2025-09-01"


def filter_exact(spark, d):
    """Equality on stored folded columns; all three filters reach the scan."""
    rows = table(spark, d, "documents").where((F.col("tribunal") == "TJSC") & (F.col("classe") == "APCIV") & (F.col("organ") == T.fold_literal("1ª Câmara de Direito Civil")))
    return rows.select("id", "process", "judgment")


def filter_number(spark, d):
    """A process by the digits of its number, as process or as registration, however it is written."""
    first = table(spark, d, "documents").where("tribunal = 'TJSC'").agg(F.min("process").alias("p"))
    written = first.select(L.cnj_number(F.col("p")).alias("w"))
    wanted = F.broadcast(written.select(T.digits(F.col("w")).alias("n")))  # one row
    docs = table(spark, d, "documents").select("id", "process", "registration")
    return docs.join(wanted, (docs.process == F.col("n")) | (docs.registration == F.col("n")), "left_semi")


def filter_dates(spark, d):
    """Inclusive range on one date column, with an open end."""
    rows = table(spark, d, "documents").where(F.col("judgment").between("2010-01-01", "2012-12-31") & (F.col("publication") >= "2010-06-01"))
    return rows.select("id", "judgment", "publication")


def filter_withdrawn(spark, d):
    """Admitted precedents without those withdrawn (a list of id and hash); null-safe, unlike NOT IN."""
    gone = spark.createDataFrame([("STJ:sumula:7", None), ("STJ:iac:500", "x"), (None, None)], "id string, hash string")
    held = table(spark, d, "precedents").where("admission = 'admitido'")
    left = held.join(gone.where("hash is null").select("id"), "id", "left_anti")
    return left.join(gone.where("hash is not null"), ["id", "hash"], "left_anti").select("id", "species", "numero")


def filter_precedents(spark, d):
    return table(spark, d, "precedents").where((F.col("tribunal") == "STJ") & F.col("publication").between("2010-01-01", "2020-12-31")).select("id", "species", "numero", "publication")


def json_fields(spark, d):
    """Fields of the stored JSON bodies, parsed once with a schema."""
    body = F.from_json("raw", "siglaClasse string, dataDecisao string, dataPublicacao string, revisao int")
    rows = table(spark, d, "versions").select("document_id", "hash", body.alias("b")).distinct()
    return rows.select("document_id", "hash", "b.siglaClasse", L.source_date(F.col("b.dataDecisao")).alias("judgment"), L.single_publication(F.col("b.dataPublicacao")).alias("publication"), "b.revisao")


def current_versions(spark, d):
    """Documents with the stored raw form of their current content, if it is logged."""
    v = table(spark, d, "versions").groupBy(F.col("document_id").alias("id"), "hash").agg(F.min("first_seen").alias("first_seen"))
    docs = table(spark, d, "documents").select("id", "hash", "tribunal")
    return docs.join(v, ["id", "hash"], "left").select("id", "tribunal", "hash", F.col("first_seen").cast("string").alias("first_seen"))


def export_rows(spark, d):
    """Documents with their delivery's dataset and name, for export, with a digest of each row."""
    r = table(spark, d, "resources").select(F.col("id").alias("resource_id"), "dataset", "name")
    docs = table(spark, d, "documents").select("id", "resource_id", "hash", "judgment")
    out = docs.join(r, "resource_id", "left").select("id", "dataset", "name", "hash", "judgment")
    return out.withColumn("digest", F.sha2(F.concat_ws("|", "id", F.coalesce("dataset", F.lit("")), F.coalesce("name", F.lit("")), "hash"), 256))


def winner_per_document(spark, d):
    """Of all observations in good deliveries, each document's latest: greatest rank, then resource id."""
    r = table(spark, d, "resources").where("status = 'ok'").select(F.col("id").alias("resource_id"), "rank_key")
    o = table(spark, d, "observations").select("resource_id", "document_id", "hash").join(r, "resource_id")
    best = o.groupBy("document_id").agg(F.max_by(F.struct("resource_id", "hash"), F.struct("rank_key", "resource_id", "hash")).alias("w"))
    return best.select("document_id", "w.resource_id", "w.hash")


def merge_upsert(spark, d):
    """The documents table after the latest observations: kept, changed, new and removed rows."""
    new = winner_per_document(spark, d).select(F.col("document_id").alias("id"), F.col("hash").alias("new"))
    old = table(spark, d, "documents").select("id", F.col("hash").alias("old"))
    state = F.when(F.col("old").isNull(), "new").when(F.col("new").isNull(), "removed").when(F.col("old") == F.col("new"), "unchanged").otherwise("changed")
    return old.join(new, "id", "full_outer").groupBy(state.alias("state")).agg(F.count("*").alias("n"))


def duplicate_versions(spark, d):
    """Contents logged under several documents."""
    return table(spark, d, "versions").groupBy("hash").agg(F.count_distinct("document_id").alias("documents")).where("documents > 1")


def coverage_groups(spark, d):
    """Per court and organ: documents, first and last dates, documents without publication."""
    return table(spark, d, "documents").groupBy("tribunal", "organ").agg(
        F.count("*").alias("n"), F.min("judgment").alias("first_judgment"), F.max("judgment").alias("last_judgment"), F.min("publication").alias("first_publication"),
        F.max("publication").alias("last_publication"), F.count_if(F.col("publication").isNull()).alias("unpublished"),
    )


def coverage_intersects(spark, d):
    """Whether each organ's dates meet a period asked for."""
    g = coverage_groups(spark, d)
    return g.select("tribunal", "organ", F.coalesce((F.col("first_judgment") <= "2001-06-30") & (F.col("last_judgment") >= "2001-01-01"), F.lit(False)).alias("meets"))


def admission_counts(spark, d):
    return table(spark, d, "precedents").groupBy("admission", "tribunal", "species").agg(F.count("*").alias("n"))


def resource_summary(spark, d):
    """Per dataset: deliveries by status, errors, first and last name that isn't good."""
    bad = F.col("status") != "ok"
    return table(spark, d, "resources").groupBy("dataset").agg(
        F.count("*").alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in ("ok", "error", "superseded")],
        F.min(F.when(bad, F.col("name"))).alias("first_bad"), F.max(F.when(bad, F.col("name"))).alias("last_bad"), F.count_distinct("error").alias("errors"),
    )


def latest_resource(spark, d):
    """The latest checked delivery of each dataset."""
    best = table(spark, d, "resources").where("checked is not null").groupBy("dataset").agg(F.max_by(F.struct("id", "status", "checked"), F.struct("checked", "id")).alias("r"))
    return best.select("dataset", "r.id", "r.status", F.col("r.checked").cast("string").alias("checked"))


def collection_delay(spark, d):
    """Days since the last good delivery of each dataset; none at all counts as late."""
    last = table(spark, d, "resources").groupBy("dataset").agg(F.max(F.when(F.col("status") == "ok", F.col("checked"))).alias("last"))
    days = F.datediff(F.lit(TODAY).cast("date"), F.col("last").cast("date"))
    return last.select("dataset", days.alias("days"), F.coalesce(days > 30, F.lit(True)).alias("late"))


def panel_groups(spark, d):
    return table(spark, d, "documents").groupBy("tribunal", "classe").agg(F.count("*").alias("n"), F.max("publication").alias("last"), F.count_distinct("organ").alias("organs"))


def joined_classes(spark, d):
    """The distinct classes of each organ, in order, in one text."""
    return table(spark, d, "documents").groupBy("organ").agg(F.array_join(F.array_sort(F.collect_set("classe")), " | ").alias("classes"))


def merged_numbers(spark, d):
    """Citation keys of judgments merged per key, with their origins in order and number of documents."""
    rows = table(spark, d, "document_citations").where("tipo = 'acordao' and chave <> ''")
    return rows.groupBy("chave").agg(F.array_join(F.array_sort(F.collect_set("origem")), "|").alias("origins"), F.count_distinct("document_id").alias("documents"))


def held_by_key(spark, d):
    """Per class: documents reachable by process or registration number among those cited by number."""
    keys = table(spark, d, "documents").select("id", "classe", F.explode(F.array("process", "registration")).alias("number")).where("number <> ''")
    cited = table(spark, d, "document_citations").where("tipo = 'acordao'").select(T.digits(F.element_at(F.split("chave", ":"), -1)).alias("number")).where("number <> ''").distinct()
    return keys.join(cited, "number", "left_semi").groupBy("classe").agg(F.count_distinct("id").alias("held"))


def before_after(spark, d):
    """Documents per dataset in its first and last good delivery."""
    r = table(spark, d, "resources").where("status = 'ok'").groupBy("dataset").agg(F.min_by("id", "rank_key").alias("first"), F.max_by("id", "rank_key").alias("last"))
    n = table(spark, d, "observations").select("resource_id", "document_id").distinct().groupBy("resource_id").agg(F.count("*").alias("n"))
    a, b = (n.select(F.col("resource_id").alias(c), F.col("n").alias(k)) for c, k in (("first", "before"), ("last", "after")))
    return r.join(a, "first", "left").join(b, "last", "left").select("dataset", F.coalesce("before", F.lit(0)).alias("before"), F.coalesce("after", F.lit(0)).alias("after"))


def fingerprint(spark, d):
    """A digest of the whole table that doesn't depend on row order: per month, and combined by exclusive or."""
    rows = table(spark, d, "documents").select(F.date_format("judgment", "yyyy-MM").alias("month"), F.conv(F.substring(F.sha2(F.concat_ws("|", "id", "hash"), 256), 1, 15), 16, 10).cast("long").alias("h"))
    return rows.groupBy("month").agg(F.bit_xor("h").alias("digest"), F.count("*").alias("n"))


def hash_sample(spark, d):
    """A reproducible sample: the 50 documents of least SHA-256 of seed and id (sampling is the feature)."""
    return table(spark, d, "documents").select("id", F.sha2(F.concat(F.lit("42:"), "id"), 256).alias("draw")).orderBy("draw", "id").limit(50)


def page_by_date(spark, d):
    """The third page of 20 in order of publication, dates lacking last."""
    return table(spark, d, "documents").orderBy(F.col("publication").asc_nulls_last(), "id").offset(40).limit(20).select("id", "publication")


def history_page(spark, d):
    """The versions of the document with most contents, newest first."""
    v = table(spark, d, "versions").where("first_seen is not null").groupBy("document_id", "hash").agg(F.min("first_seen").alias("first_seen"))
    top = v.groupBy("document_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "document_id").limit(1)
    return v.join(F.broadcast(top.select("document_id")), "document_id", "left_semi").orderBy(F.desc("first_seen"), "hash").limit(20).select("document_id", "hash", F.col("first_seen").cast("string").alias("first_seen"))


def pending_first(spark, d):
    """Work order of deliveries: those not good first, then the longest unchecked."""
    return table(spark, d, "resources").orderBy((F.col("status") != "ok").desc(), F.col("checked").asc_nulls_first(), "id").limit(30).select("id", "status", F.col("checked").cast("string").alias("checked"))


def _blocks(texts):
    n = F.greatest(F.ceil(F.length("text") / 1500), F.lit(1)).cast("int")
    return texts.select("doc_id", "text", F.explode(F.sequence(F.lit(0), n - 1)).alias("block")).select("doc_id", "block", F.expr("substring(text, block * 1500 + 1, 1500)").alias("part"))


def text_blocks(spark, d):
    """Every text in blocks of 1,500 characters."""
    return _blocks(table(spark, d, "documents").where("text is not null").select("doc_id", "text"))


def byte_budget(spark, d):
    """Of each organ's newest eight documents, those whose ids and organs fit 120 bytes, in order."""
    w = Window.partitionBy("organ").orderBy(F.col("publication").desc_nulls_last(), "id")
    rows = table(spark, d, "documents").select("organ", "id", "publication").withColumn("k", F.row_number().over(w)).where("k <= 8")  # ranked and cut per partition before the shuffle
    return rows.withColumn("bytes", F.sum(F.octet_length(F.concat("organ", "id"))).over(w)).where("bytes <= 120").select("organ", "id", "k", "bytes")


def backup_retention(spark, d):
    """Deliveries to keep: the three newest of each dataset and the newest of each month."""
    newest = Window.partitionBy("dataset").orderBy(F.col("checked").desc(), F.col("id").desc())
    month = Window.partitionBy("dataset", F.date_trunc("month", "checked")).orderBy(F.col("checked").desc(), F.col("id").desc())
    rows = table(spark, d, "resources").where("checked is not null")
    return rows.withColumn("a", F.row_number().over(newest)).withColumn("b", F.row_number().over(month)).select("id", "dataset", ((F.col("a") <= 3) | (F.col("b") == 1)).alias("keep"))


def retired_ids(spark, d):
    """Documents once logged that are no longer held."""
    return table(spark, d, "versions").select("document_id").distinct().join(table(spark, d, "documents").select(F.col("id").alias("document_id")), "document_id", "left_anti")


def affected_ids(spark, d):
    """Documents of the last good delivery of each dataset or of the one before."""
    w = Window.partitionBy("dataset").orderBy(F.col("rank_key").desc(), F.col("id").desc())
    last = table(spark, d, "resources").where("status = 'ok'").withColumn("k", F.row_number().over(w)).where("k <= 2").select(F.col("id").alias("resource_id"))
    return table(spark, d, "observations").join(last, "resource_id", "left_semi").select("document_id").distinct()


def unreferenced_contents(spark, d):
    """Logged contents that no observation has."""
    return table(spark, d, "versions").select("hash").distinct().join(table(spark, d, "observations").select("hash"), "hash", "left_anti")


def required_fields(spark, d):
    """Documents whose filled fields don't cover those required, with the ones missing."""
    lacking = L.missing_parts(text=F.col("text"), judgment=F.col("judgment"), publication=F.col("publication"), lang=F.col("lang"))
    rows = table(spark, d, "documents").select("id", lacking.alias("m"))
    return rows.where(F.size("m") > 0).select("id", F.array_join("m", "|").alias("missing"))


def shared_precedents(spark, d):
    """Pairs of documents' citation lists: documents that cite at least two of three given precedents."""
    wanted = F.array(F.lit("STJ:sumula:144"), F.lit("STJ:iac:500"), F.lit("STJ:sumula:36"))
    lists = table(spark, d, "document_citations").where("tipo = 'precedente'").where(F.array_contains(wanted, F.col("chave"))).groupBy("document_id").agg(F.collect_set("chave").alias("c"))
    return lists.where(F.size(F.array_intersect("c", wanted)) >= 2).select("document_id", F.size("c").alias("n"))


def union_passes(spark, d):
    """Union of two passes over a source without repeats; an id with two contents is a conflict."""
    a = table(spark, d, "observations").select("document_id", "hash")
    b = table(spark, d, "versions").select("document_id", "hash")
    return a.unionByName(b).distinct().groupBy("document_id").agg(F.count("*").alias("contents"), F.min("hash").alias("first"))


def numbers_checked(spark, d):
    """National numbers in written form, with the check digits they should have."""
    rows = table(spark, d, "documents").where("tribunal = 'TJSC'").select("id", "process")
    should = L.cnj_check(F.col("process"))
    return rows.select("id", L.cnj_number(F.col("process")).alias("written"), should.alias("check"), (F.substring("process", 8, 2) == should).alias("valid"), L.court_of_number(F.col("process")).alias("court"))


def class_families(spark, d):
    return table(spark, d, "documents").groupBy(L.class_family(F.col("classe")).alias("family"), T.slug(F.col("organ")).alias("organ_slug")).agg(F.count("*").alias("n"))


def law_numbers(spark, d):
    """Statute numbers of provisions, with dots at the thousands."""
    rows = table(spark, d, "document_citations").where("tipo = 'dispositivo' and chave like 'LEI %'")
    return rows.select(F.regexp_extract("chave", r"LEI ([\d.]+)/", 1).alias("number")).distinct().select("number", L.law_number(F.col("number")).alias("dotted"), L.single_number(F.concat(F.lit("Lei "), "number")).alias("value"))


def text_keys(spark, d):
    """Documents whose titles fold to one key: name, key and number of documents."""
    rows = table(spark, d, "document_details").where("classe_descricao is not null").select("id", "classe_descricao").distinct()
    return rows.groupBy(T.text_key(F.col("classe_descricao")).alias("key"), T.plain(F.col("classe_descricao")).alias("plain")).agg(F.count("*").alias("n"))


def references_in_words(spark, d):
    """A citation in words for each document, with the parts that are missing."""
    doc = table(spark, d, "documents").select("id", "tribunal", "classe", "process", "organ", "judgment", "publication")
    details = table(spark, d, "document_details").groupBy("id").agg(F.min("relator").alias("relator"))
    c = {k: F.col(k) for k in ("tribunal", "classe", "process", "organ", "relator", "judgment", "publication")}
    return doc.join(details, "id", "left").select("id", L.reference(*c.values()).alias("reference"), F.array_join(L.missing_parts(relator=c["relator"], publication=c["publication"]), "|").alias("pending"))


def local_dates(spark, d):
    """Deliveries per calendar date in São Paulo."""
    rows = table(spark, d, "resources").where("checked is not null")
    return rows.groupBy(L.local_date(F.col("checked").cast("timestamp")).alias("date")).agg(F.count("*").alias("n"))


def expected_grid(spark, d):
    """Months and datasets without a good delivery between a dataset's first and last."""
    ok = table(spark, d, "resources").where("status = 'ok'").select("dataset", F.trunc(F.to_date(F.substring("name", 1, 8), "yyyyMMdd"), "month").alias("month"))
    grid = ok.groupBy("dataset").agg(F.min("month").alias("a"), F.max("month").alias("b")).select("dataset", F.explode(F.sequence("a", F.add_months("b", 2), F.expr("interval 1 month"))).alias("month"))
    return grid.join(ok, ["dataset", "month"], "left_anti")


def retrieval_metrics(spark, d):
    """Citations in order as a ranked answer, resolved ones relevant: hit@8, recall@8, reciprocal rank and nDCG@8, averaged."""
    rows = table(spark, d, "document_citations").where("tipo = 'acordao'").groupBy("document_id", "ord").agg(F.max(F.col("resolvido").isNotNull().cast("int")).alias("grade"))
    from autuario.operators.evaluation import averaged, per_query

    return averaged(per_query(rows, "document_id", "ord", "grade", 8))


def headers(spark, d):
    """The opening of each ementa, at most 120 characters."""
    from autuario.operators.sections import header

    rows = table(spark, d, "search").where("id is not null and ementa is not null").distinct()
    return rows.select("id", header(F.col("ementa")).alias("header"))


def period_parts(spark, d):
    """The period of publication of a court in halves of halves, until each part has at most 50 decisions."""
    from autuario.operators.periods import parts_of

    return parts_of(table(spark, d, "documents").where("tribunal = 'TJSC'"), "publication", 50)


def export_changes(spark, d):
    """What an export of the documents would write against an export of all but the newest content of each."""
    from autuario.operators.export import export_plan, markdown

    docs = table(spark, d, "documents").select("id", markdown(F.col("id"), {"classe": F.col("classe"), "julgamento": F.col("judgment")}, F.col("hash")).alias("content"))
    old = table(spark, d, "versions").select("document_id", "hash").distinct().join(table(spark, d, "documents").select(F.col("id").alias("document_id"), "classe", "judgment"), "document_id", "left")
    before = old.groupBy("document_id").agg(F.min(F.struct("hash", "classe", "judgment")).alias("o"))
    previous = before.select(F.col("document_id").alias("id"), F.sha2(markdown(F.col("document_id"), {"classe": F.col("o.classe"), "julgamento": F.col("o.judgment")}, F.col("o.hash")), 256).alias("sha256"))
    return export_plan(docs, previous).select("id", "sha256", "action")


def catalog_upsert(spark, d):
    """The catalog of deliveries after a listing without the failed ones."""
    from autuario.operators.export import upsert_catalog

    r = table(spark, d, "resources").select("id", "sha256", F.when(F.col("status") == "ok", F.col("sha256")).alias("applied"))
    listed = table(spark, d, "resources").where("status <> 'error'").select("id", F.when(F.col("rank_key") > "20250601", F.concat("sha256", F.lit("2"))).otherwise(F.col("sha256")).alias("sha256"))
    return upsert_catalog(r, listed, "id", "sha256")


QUERIES = {f.__name__: f for f in (
    headers, period_parts, export_changes, catalog_upsert,
    filter_exact, filter_number, filter_dates, filter_withdrawn, filter_precedents, json_fields, current_versions, export_rows, winner_per_document, merge_upsert,
    duplicate_versions, coverage_groups, coverage_intersects, admission_counts, resource_summary, latest_resource, collection_delay, panel_groups, joined_classes,
    merged_numbers, held_by_key, before_after, fingerprint, hash_sample, page_by_date, history_page, pending_first, text_blocks, byte_budget, backup_retention,
    retired_ids, affected_ids, unreferenced_contents, required_fields, shared_precedents, union_passes, numbers_checked, class_families, law_numbers, text_keys,
    references_in_words, local_dates, expected_grid, retrieval_metrics,
)}

_WINNER = """(select document_id, max_by({'resource_id': resource_id, 'hash': hash}, {'a': rank_key, 'b': resource_id, 'c': hash}) as w from (select distinct o.resource_id, document_id, o.hash, rank_key from observations o join resources r on r.id = o.resource_id where status = 'ok') group by document_id)"""
_GROUPS = "select tribunal, organ, count(*) as n, min(judgment) as first_judgment, max(judgment) as last_judgment, min(publication) as first_publication, max(publication) as last_publication, count(*) filter (publication is null) as unpublished from documents group by all"
_DIGITS = "regexp_replace({}, '[^0-9]', '', 'g')"
_NUMBER = "regexp_replace(process, '^(\\d{7})(\\d{2})(\\d{4})(\\d)(\\d{2})(\\d{4})$', '\\1-\\2.\\3.\\4.\\5.\\6')"
_CHECK = "lpad((98 - (substr(process, 1, 7) || substr(process, 10, 11) || '00')::hugeint % 97)::varchar, 2, '0')"

SQL = {
    "headers": """with e as (select distinct id, ementa from search where id is not null and ementa is not null), l as (select id, string_split(regexp_replace(ementa, '^\\s+', ''), chr(10)) as lines from e),
 b as (select id, lines, list_position(list_transform(lines, lambda x: regexp_matches(x, '^\\s*$') or regexp_matches(x, '^\\s*(\\d{1,3}|[IVX]{1,5})\\s*[.)–-]') or regexp_matches(x, '(?i)^[ \\t]*([IVX]+[ \\t]*[.:–-][ \\t]*)?((caso em exame|hip[oó]tese em exame|quest[aã]o em discuss[aã]o|raz[oõ]es de decidir|dispositivo e tese|tese de julgamento|dispositivos relevantes citados|jurisprud[eê]ncia relevante citada)[ \\t]*([:.–-]|\\r?$)|(?-i:D)ispositivo[ \\t]*[:.–-]?[ \\t]*\\r?$)')), true) as stop from l),
 h as (select id, regexp_replace(array_to_string(lines[1:case when stop is null or stop = 0 then len(lines) else greatest(stop - 1, 1) end], chr(10)), '\\s+$', '') as h from b)
 select id, rtrim(case when length(h) <= 120 then h when regexp_extract(h[1:121], '(?s)^(.*\\S)\\s', 1) <> '' then regexp_extract(h[1:121], '(?s)^(.*\\S)\\s', 1) else h[1:120] end) as header from h""",
    "catalog_upsert": """with l as (select id, case when rank_key > '20250601' then sha256 || '2' else sha256 end as s from resources where status <> 'error')
 select r.id, coalesce(l.s, r.sha256) as sha256, case when status = 'ok' then r.sha256 end as applied, l.id is not null as present, l.id is not null and l.s is distinct from (case when status = 'ok' then r.sha256 end) as pending from resources r left join l using (id)""",
    "export_changes": """with n as (select id, sha256('# ' || id || chr(10) || chr(10) || concat_ws(chr(10), '- classe: ' || classe, '- julgamento: ' || judgment) || chr(10) || chr(10) || hash || chr(10)) as s from documents),
 o as (select v.document_id as id, sha256('# ' || v.document_id || chr(10) || chr(10) || concat_ws(chr(10), '- classe: ' || classe, '- julgamento: ' || judgment) || chr(10) || chr(10) || min(v.hash) || chr(10)) as s from versions v left join documents d on d.id = v.document_id group by v.document_id, classe, judgment)
 select coalesce(n.id, o.id) as id, coalesce(n.s, o.s) as sha256, case when n.id is null then 'retire' when o.id is null then 'add' when n.s = o.s then 'keep' else 'replace' end as action from n full join o on n.id = o.id""",
    "period_parts": """with recursive c as (select publication as d, count(*) as n from documents where tribunal = 'TJSC' and publication is not null group by 1),
 p as (select (select min(d) from c) as a, (select max(d) from c) as b, (select sum(n) from c) as n union all
  select s.a, s.b, coalesce((select sum(n) from c where c.d between s.a and s.b), 0) from (select unnest([{'a': a, 'b': a + ((b - a) // 2)::int}, {'a': a + ((b - a) // 2)::int + 1, 'b': b}]) as s from p where n > 50 and a < b))
 select a as start, b as "end", n::bigint as n from p where n <= 50 or a >= b""",
    "filter_exact": "select id, process, judgment from documents where tribunal = 'TJSC' and classe = 'APCIV' and organ = '1A CAMARA DE DIREITO CIVIL'",
    "filter_number": "select id, process, registration from documents where (select min(process) from documents where tribunal = 'TJSC') in (process, registration)",
    "filter_dates": "select id, judgment, publication from documents where judgment between '2010-01-01' and '2012-12-31' and publication >= '2010-06-01'",
    "filter_withdrawn": "select id, species, numero from precedents where admission = 'admitido' and id <> 'STJ:sumula:7' and not (id = 'STJ:iac:500' and hash = 'x')",
    "filter_precedents": "select id, species, numero, publication from precedents where tribunal = 'STJ' and publication between '2010-01-01' and '2020-12-31'",
    "json_fields": """select distinct document_id, hash, raw->>'$.siglaClasse' as "siglaClasse", try_strptime(raw->>'$.dataDecisao', '%Y%m%d')::date as judgment,
 case when len(list_distinct(regexp_extract_all(raw->>'$.dataPublicacao', '\\d{2}/\\d{2}/\\d{4}'))) = 1 then try_strptime(regexp_extract(raw->>'$.dataPublicacao', '\\d{2}/\\d{2}/\\d{4}'), '%d/%m/%Y')::date end as publication, (raw->>'$.revisao')::int as revisao from versions""",
    "current_versions": "select d.id, tribunal, d.hash, min(first_seen)::varchar as first_seen from documents d left join versions v on v.document_id = d.id and v.hash = d.hash group by all",
    "export_rows": "select d.id, dataset, name, d.hash, judgment, sha256(d.id || '|' || coalesce(dataset, '') || '|' || coalesce(name, '') || '|' || d.hash) as digest from documents d left join resources r on r.id = d.resource_id",
    "winner_per_document": f"select document_id, w.resource_id, w.hash from {_WINNER}",
    "merge_upsert": f"select case when d.hash is null then 'new' when n.w is null then 'removed' when d.hash = n.w.hash then 'unchanged' else 'changed' end as state, count(*) as n from documents d full join {_WINNER} n on n.document_id = d.id group by all",
    "duplicate_versions": "select hash, count(distinct document_id) as documents from versions group by hash having count(distinct document_id) > 1",
    "coverage_groups": _GROUPS,
    "coverage_intersects": f"select tribunal, organ, coalesce(first_judgment <= date '2001-06-30' and last_judgment >= date '2001-01-01', false) as meets from ({_GROUPS})",
    "admission_counts": "select admission, tribunal, species, count(*) as n from precedents group by all",
    "resource_summary": "select dataset, count(*) as total, count(*) filter (status = 'ok') as ok, count(*) filter (status = 'error') as error, count(*) filter (status = 'superseded') as superseded, min(name) filter (status <> 'ok') as first_bad, max(name) filter (status <> 'ok') as last_bad, count(distinct r.error) as errors from resources r group by dataset",
    "latest_resource": "select dataset, w.id, w.status, w.checked::varchar as checked from (select dataset, max_by({'id': id, 'status': status, 'checked': checked}, {'a': checked, 'b': id}) as w from resources where checked is not null group by dataset)",
    "collection_delay": f"select dataset, date_diff('day', last::date, date '{TODAY}')::int as days, coalesce(date_diff('day', last::date, date '{TODAY}') > 30, true) as late from (select dataset, max(checked) filter (status = 'ok') as last from resources group by dataset)",
    "panel_groups": "select tribunal, classe, count(*) as n, max(publication) as last, count(distinct organ) as organs from documents group by all",
    "joined_classes": "select organ, string_agg(distinct classe, ' | ' order by classe) as classes from documents group by organ",
    "merged_numbers": "select chave, string_agg(distinct origem, '|' order by origem) as origins, count(distinct document_id) as documents from document_citations where tipo = 'acordao' and chave <> '' group by chave",
    "held_by_key": f"select classe, count(distinct id) as held from (select id, classe, unnest([process, registration]) as number from documents) where number <> '' and number in (select {_DIGITS.format(chr(34) + 'n' + chr(34))} from (select regexp_extract(chave, '[^:]*$') as n from document_citations where tipo = 'acordao')) group by classe",
    "before_after": """with r as (select dataset, min_by(id, rank_key) as a, max_by(id, rank_key) as b from resources where status = 'ok' group by dataset), n as (select resource_id, count(distinct document_id) as n from observations group by 1)
 select dataset, coalesce(x.n, 0) as before, coalesce(y.n, 0) as after from r left join n x on x.resource_id = a left join n y on y.resource_id = b""",
    "fingerprint": "select strftime(judgment, '%Y-%m') as month, bit_xor(('0x' || substr(sha256(id || '|' || hash), 1, 15))::bigint) as digest, count(*) as n from documents group by 1",
    "hash_sample": "select id, sha256('42:' || id) as draw from documents order by draw, id limit 50",
    "page_by_date": "select id, publication from documents order by publication asc nulls last, id limit 20 offset 40",
    "history_page": """with v as (select document_id, hash, min(first_seen) as t from versions where first_seen is not null group by all)
 select document_id, hash, t::varchar as first_seen from v where document_id = (select document_id from v group by 1 order by count(*) desc, 1 limit 1) order by t desc, hash limit 20""",
    "pending_first": "select id, status, checked::varchar as checked from resources order by (status <> 'ok') desc, checked asc nulls first, id limit 30",
    "text_blocks": "select doc_id, block::int as block, substr(text, block * 1500 + 1, 1500) as part from (select doc_id, text, unnest(range(0, greatest(ceil(length(text) / 1500), 1)::int)) as block from documents where text is not null)",
    "byte_budget": "select organ, id, k, bytes from (select *, sum(octet_length((organ || id)::blob)) over (partition by organ order by k) as bytes from (select organ, id, row_number() over (partition by organ order by publication desc nulls last, id) as k from documents) where k <= 8) where bytes <= 120",
    "backup_retention": "select id, dataset, (row_number() over (partition by dataset order by checked desc, id desc) <= 3 or row_number() over (partition by dataset, date_trunc('month', checked) order by checked desc, id desc) = 1) as keep from resources where checked is not null",
    "retired_ids": "select distinct document_id from versions v where not exists (select 1 from documents d where d.id = v.document_id)",
    "affected_ids": "select distinct document_id from observations where resource_id in (select id from (select id, row_number() over (partition by dataset order by rank_key desc, id desc) as k from resources where status = 'ok') where k <= 2)",
    "unreferenced_contents": "select distinct hash from versions v where not exists (select 1 from observations o where o.hash = v.hash)",
    "required_fields": "select id, missing from (select id, concat_ws('|', case when coalesce(trim(text, ' '), '') = '' then 'text' end, case when judgment is null then 'judgment' end, case when publication is null then 'publication' end, case when coalesce(trim(lang, ' '), '') = '' then 'lang' end) as missing from documents) where missing <> ''",
    "shared_precedents": "select document_id, count(distinct chave) as n from document_citations where tipo = 'precedente' and chave in ('STJ:sumula:144', 'STJ:iac:500', 'STJ:sumula:36') group by 1 having count(distinct chave) >= 2",
    "union_passes": "select document_id, count(*) as contents, min(hash) as first from (select document_id, hash from observations union select document_id, hash from versions) group by 1",
    "numbers_checked": f"select id, {_NUMBER} as written, {_CHECK} as \"check\", substr(process, 8, 2) = {_CHECK} as valid, case when substr(process, 14, 3) = '824' then 'TJSC' when substr(process, 14, 1) = '8' then 'TJ' else 'OUTRO' end as court from documents where tribunal = 'TJSC'",
    "class_families": "select regexp_extract(upper(trim(classe)), '([^ ]*)$', 1) as family, trim(regexp_replace(lower(strip_accents(organ)), '[^a-z0-9]+', '-', 'g'), '-') as organ_slug, count(*) as n from documents group by all",
    "law_numbers": "select distinct number, replace(format('{:,}', replace(number, '.', '')::bigint), ',', '.') as dotted, replace(number, '.', '')::bigint as value from (select regexp_extract(chave, 'LEI ([\\d.]+)/', 1) as number from document_citations where tipo = 'dispositivo' and chave like 'LEI %')",
    "text_keys": "select case when regexp_matches(classe_descricao, '[\\p{L}\\p{N}]') then sha256(regexp_replace(upper(strip_accents(classe_descricao)), '[^\\p{L}\\p{N}]+', '', 'g')) end as key, trim(regexp_replace(upper(strip_accents(classe_descricao)), '[^\\p{L}\\p{N}]+', ' ', 'g')) as plain, count(*) as n from (select distinct id, classe_descricao from document_details where classe_descricao is not null) group by all",
    "references_in_words": """select d.id, concat_ws(', ', tribunal, classe || ' n. ' || process, 'rel. ' || coalesce(case when trim(relator) <> '' then relator end, '[não informado]'), organ,
 'j. ' || coalesce(strftime(judgment, '%d/%m/%Y'), '[não informado]'), 'pub. ' || coalesce(strftime(publication, '%d/%m/%Y'), '[não informado]')) as reference,
 concat_ws('|', case when coalesce(trim(relator), '') = '' then 'relator' end, case when publication is null then 'publication' end) as pending
 from documents d left join (select id, min(relator) as relator from document_details group by id) r on r.id = d.id""",
    "local_dates": "select (checked - interval 3 hour)::date as date, count(*) as n from resources where checked is not null group by 1",
    "expected_grid": """with ok as (select dataset, date_trunc('month', strptime(substr(name, 1, 8), '%Y%m%d'))::date as month from resources where status = 'ok'),
 g as (select dataset, unnest(generate_series(a, b + interval 2 month, interval 1 month))::date as month from (select dataset, min(month) as a, max(month) as b from ok group by 1))
 select dataset, month from g where not exists (select 1 from ok where ok.dataset = g.dataset and ok.month = g.month)""",
    "retrieval_metrics": """with r as (select document_id, grade, row_number() over (partition by document_id order by ord) as k, row_number() over (partition by document_id order by grade desc, ord) as best from (select document_id, ord, max((resolvido is not null)::int) as grade from document_citations where tipo = 'acordao' group by 1, 2)),
 q as (select document_id, sum(grade) as n, coalesce(max(grade) filter (k <= 8), 0) as hit, coalesce(sum(grade) filter (k <= 8), 0) / sum(grade) as recall, 1.0 / min(k) filter (grade > 0) as rr,
  coalesce(sum((2 ** grade - 1) / log2(k + 1)) filter (k <= 8), 0) as dcg, sum((2 ** grade - 1) / log2(best + 1)) filter (best <= 8) as ideal from r group by 1 having sum(grade) > 0)
 select count(*) as queries, round(avg(hit), 6) as hit, round(avg(recall), 6) as recall, round(avg(rr), 6) as mrr, round(avg(dcg / ideal), 6) as ndcg from q""",
}
