"""Precedents from lists of themes and their processes, in CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from autuario.functions.legal import single_number

#: Columns whose values identify what a theme says; repeats must agree in all of them.
USED = ("situacao", "teseFirmada", "questaoSubmetidaAJulgamento", "orgaoJulgador", "dataPublicacaoAcordao")


def themes(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(themes, rejects) of lines with ``tipoPrecedente``, ``numeroPrecedente``, ``line`` and the columns used.

    A theme repeated with equal values counts once, its first line standing; one
    repeated with different values is ambiguous and left out; lines without a number
    or organ are rejected.
    """
    named = rows.withColumn("kind", F.trim("tipoPrecedente")).withColumn("number", single_number(F.col("numeroPrecedente")))
    bad = F.when(F.col("number").isNull(), "invalid_number").when(F.coalesce(F.trim("orgaoJulgador"), F.lit("")) == "", "no_organ")
    told = named.withColumn("reason", bad)
    said = F.struct(*[F.coalesce(F.trim(c), F.lit("")).alias(c) for c in USED])
    grouped = told.where("reason is null").groupBy("kind", "number").agg(
        F.count_distinct(said).alias("says"), F.min_by(F.struct("sequencialPrecedente", *USED), "line").alias("first"), F.min("line").alias("line"), F.count("*").alias("lines")
    )
    good = grouped.where("says = 1").select("kind", "number", "line", "lines", "first.*")
    rejects = told.where("reason is not null").select("line", "reason").unionByName(grouped.where("says > 1").select("line", F.lit("ambiguous_identity").alias("reason")))
    return good, rejects


def with_leading_cases(good: DataFrame, processes: DataFrame) -> DataFrame:
    """Themes with their leading cases, one per registration number, in order of line."""
    cases = processes.where((F.col("leadingCase") == "S") & (F.coalesce(F.trim("numeroRegistro"), F.lit("")) != ""))
    one = cases.groupBy("sequencialPrecedente", F.trim("numeroRegistro").alias("registration")).agg(F.min_by(F.struct("line", F.col("Processo").alias("process")), "line").alias("c"))
    listed = one.groupBy("sequencialPrecedente").agg(F.array_sort(F.collect_list(F.struct("c.line", "registration", "c.process"))).alias("cases"))
    return good.join(listed, "sequencialPrecedente", "left").withColumn("cases", F.transform(F.coalesce("cases", F.array().cast("array<struct<line:int,registration:string,process:string>>")), lambda x: F.struct(x["registration"], x["process"])))
