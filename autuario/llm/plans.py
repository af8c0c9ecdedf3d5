"""Queries of the corpus problems (1, 3, 5, 6, 8, 9 and 10)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from autuario.llm import copies, encodings, lookalikes, names, near, packing, tokens
from autuario.sources.tables import table

P5_THRESHOLD, P5_SHINGLE = 0.6, 3


def p3_normal(spark: SparkSession, d: str) -> DataFrame:
    """Affected records with their text in ordinary form."""
    of = [
        lookalikes.unusual(table(spark, d, name), "id", column).select(F.lit(name).alias("source_table"), "id", "normal")
        for name, column in (("search", "ementa"), ("document_details", "relator"))
    ]
    return of[0].unionByName(of[1]).distinct()


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Records that hold characters which stand in for ordinary ones."""
    return p3_normal(spark, d).select("source_table", "id").distinct()


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of similar ementas that are no copies."""
    return near.near_pairs(table(spark, d, "search"), "id", "ementa", P5_THRESHOLD, P5_SHINGLE).select("id_a", "id_b").distinct()


def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    """The groups that similar ementas form."""
    return near.near_groups(table(spark, d, "search"), "id", "ementa", P5_THRESHOLD, P5_SHINGLE)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Copies in another layout, with the record that is kept."""
    return copies.copies(table(spark, d, "search"), "id", "ementa")


def p6_counts(spark: SparkSession, d: str) -> DataFrame:
    """Each record that remains and its number of copies."""
    return copies.copy_counts(table(spark, d, "search"), "id", "ementa")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of spellings of one person."""
    pairs = names.same_person(table(spark, d, "document_details"), "relator_fold")
    return pairs.select(F.col("a").alias("relator_fold_a"), F.col("b").alias("relator_fold_b"))


def p1_people(spark: SparkSession, d: str) -> DataFrame:
    """Each spelling with its person's true form."""
    return names.attribute(table(spark, d, "document_details"), "relator_fold").withColumnRenamed("spelling", "relator_fold")


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    """The ids of each document's text."""
    return tokens.encode(table(spark, d, "documents"), "doc_id", "text").withColumnRenamed("id", "doc_id")


def p9_packing(spark: SparkSession, d: str) -> DataFrame:
    """The container and position of each text or piece, for each capacity; empty texts take no room."""
    sizes = tokens.token_counts(table(spark, d, "documents").where("text is not null"), "doc_id", "text")
    return packing.pack(sizes, table(spark, d, "containers")).withColumnRenamed("id", "doc_id")


def p9_fill(spark: SparkSession, d: str) -> DataFrame:
    """Bins used and room left for each capacity."""
    bins = p9_packing(spark, d).groupBy("container", "capacity", "bin").agg(F.sum("tokens").alias("fill"))
    least = F.ceil(F.sum("fill") / F.first("capacity"))
    return bins.groupBy("container", "capacity").agg(
        F.count("*").alias("bins"), least.alias("least_bins"), F.max("fill").alias("fullest"), F.sum(F.col("capacity") - F.col("fill")).alias("unused")
    )


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold a wrongly decoded passage."""
    return p10_restored(spark, d).select("doc_id").distinct()


def p10_restored(spark: SparkSession, d: str) -> DataFrame:
    """Those documents with the text restored where it can be, and the chains of encodings found."""
    return encodings.garbled(table(spark, d, "documents"), "doc_id", "text").withColumnRenamed("id", "doc_id")


QUERIES = {
    "p1_found": p1_found, "p1_people": p1_people,
    "p3_found": p3_found, "p3_normal": p3_normal,
    "p5_found": p5_found, "p5_groups": p5_groups,
    "p6_found": p6_found, "p6_counts": p6_counts,
    "p8_ids": p8_ids,
    "p9_packing": p9_packing, "p9_fill": p9_fill,
    "p10_found": p10_found, "p10_restored": p10_restored,
}

_BARE = "(select id, regexp_replace(lower(ementa), '[^\\p{L}\\p{N}]+', '', 'g') as b from search where id is not null and ementa is not null)"
_COPY = f"""(select id, case when contains(b, '{copies.PRECEDENTS}') and contains(b, '{copies.PROVISIONS}') then regexp_replace(b, '^(.*)({copies.PRECEDENTS}.*?)({copies.PROVISIONS}.*)$', '\\1\\3\\2', 's') else b end as k from {_BARE} where b <> '')"""

SQL = {
    "p6_found": f"select distinct g.kept_id, c.id as copy_id from {_COPY} c join (select k, min(id) as kept_id from {_COPY} group by k) g using (k) where c.id <> g.kept_id",
    "p6_counts": f"""with p as (select distinct g.kept_id, c.id as copy_id from {_COPY} c join (select k, min(id) as kept_id from {_COPY} group by k) g using (k) where c.id <> g.kept_id)
 select i.id as kept_id, 1 + count(p.copy_id) as copies from (select distinct id from search) i left join p on p.kept_id = i.id where i.id not in (select copy_id from p) group by i.id""",
}
