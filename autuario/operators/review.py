"""Samples for review, question sets without the citation they ask for, and scans for patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from autuario.functions.text import text_key
from autuario.operators.sections import header
from autuario.operators.skew import left_join_counted
from autuario.runtime import cut

#: A sample's least size, and its share of the batch.
LEAST, SHARE = 10, 0.05


def draw(id_: Column, seed: str) -> Column:
    """The place of an id in a reproducible shuffle."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), id_), 256)


def review_sample(batch: DataFrame, id_col: str, seed: str, earlier: DataFrame | None = None) -> DataFrame:
    """``id, draw``: the sample of a batch: the least draws, as many as ``LEAST`` or ``SHARE`` of the batch, whichever is more.

    Ids of ``earlier`` samples take no part in the draw, but count to the batch's size.
    """
    ids = batch.select(F.col(id_col).alias("id")).where("id is not null").distinct()
    size = max(LEAST, -(-ids.count() * round(SHARE * 100) // 100))
    left = ids if earlier is None else ids.join(earlier.select("id"), "id", "left_anti")
    return left.select("id", draw(F.col("id"), seed).alias("draw")).orderBy("draw", "id").limit(size)  # the sample is the feature


def review_verdict(sample: DataFrame, reviews: DataFrame, least_approved: float = 1.0) -> DataFrame:
    """One row: ``sampled, reviewed, approved, accepted``: a batch is accepted if its whole sample is reviewed and enough of it approved (``id, approved``)."""
    said = reviews.groupBy("id").agg(F.min("approved").alias("approved"))
    counts = sample.join(said, "id", "left").agg(F.count("*").alias("sampled"), F.count("approved").alias("reviewed"), F.count_if("approved").alias("approved"))
    whole = (F.col("sampled") > 0) & (F.col("reviewed") == F.col("sampled"))
    return counts.withColumn("accepted", whole & (F.col("approved") >= F.col("sampled") * F.lit(least_approved)))


def unjudged(found: DataFrame, judged: DataFrame, keys: list[str]) -> DataFrame:
    """The pairs of results that no judgement covers."""
    return found.select(*keys).distinct().join(judged.select(*keys), keys, "left_anti")


def judging_lot(found: DataFrame, judged: DataFrame, keys: list[str], seed: str) -> DataFrame:
    """Unjudged pairs in a reproducible order that tells nothing of their rank: ``place`` within each query (the first key)."""
    rows = unjudged(found, judged, keys).withColumn("draw", draw(F.concat_ws("|", *keys), seed))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(keys[0]).orderBy("draw")))  # a query's results: few


#: Mentions of a judgment or precedent, and of its court.
_MENTION = r"(?iu)\b(?:agint|agrg|edcl|earesp|eresp|aresp|resp|rms|rhc|hc|tema|s[úu]mula(?:\s+vinculante)?|irdr|iac)\b(?:\s+n[oa]s?\s+\p{L}+)*\s*(?:n[.º°]*)?\s*[0-9][0-9.-]*(?:/[A-Z]{2}\b|/[0-9]+)?|\b[0-9]{7}-[0-9]{2}\.[0-9]{4}\.[0-9]\.[0-9]{2}\.[0-9]{4}\b"


def without_citations(df: DataFrame, id_col: str, text_col: str, words: int = 30) -> DataFrame:
    """``id, query``: the opening of a text as a question: its mentions of judgments and precedents removed, at most ``words`` words."""
    bare = F.regexp_replace(header(F.col(text_col), 1000), _MENTION, " ")
    said = F.filter(F.split(F.trim(F.regexp_replace(bare, r"\s+", " ")), " "), lambda w: F.regexp(w, F.lit(r"[\p{L}\p{N}]")))
    return df.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.array_join(F.slice(said, 1, words), " ").alias("query")).where("query <> ''")


def question_set(df: DataFrame, citations: DataFrame, id_col: str, text_col: str, seed: str, size: int) -> DataFrame:
    """``id, query, wanted``: the first questions, in hash order, of documents that cite something held, and what they should find."""
    cited = citations.where("resolvido is not null").groupBy(F.col("document_id").alias("id")).agg(F.min("resolvido").alias("wanted"))
    asked = without_citations(df, id_col, text_col).dropDuplicates(["id"]).join(cited, "id")
    return asked.select("id", "query", "wanted", draw(F.col("id"), seed).alias("draw")).orderBy("draw").limit(size).drop("draw")  # the set's size is the feature


def scopes(ranked: DataFrame, query: str, grade: str, *of: str) -> DataFrame:
    """Per query and each of the columns ``of``: the value with most relevant answers, ties to the first: a scope to ask within."""
    named = [F.lit(c) for c in of]
    rows = ranked.where(F.col(grade) > 0).select(F.col(query).alias("query"), F.explode(F.array(*[F.struct(n.alias("scope"), F.col(c).alias("value")) for n, c in zip(named, of)])).alias("x")).select("query", "x.*").where("value is not null")
    counts = rows.groupBy("query", "scope", "value").agg(F.count("*").alias("relevant"))
    best = counts.groupBy("query", "scope").agg(F.min_by(F.struct("value", "relevant"), F.struct(-F.col("relevant"), "value")).alias("b"))
    return best.select("query", "scope", "b.value", "b.relevant")


def scan_patterns(df: DataFrame, id_col: str, text_col: str, patterns: dict[str, str]) -> DataFrame:
    """``id, pattern, found, line, times``: texts that hold what a pattern looks for: the first find, its line (from 1), and how often."""
    each = [F.struct(F.lit(n).alias("pattern"), F.lit(p).alias("p")) for n, p in patterns.items()]
    rows = df.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.explode(F.array(*each)).alias("x")).select("id", "text", "x.*")
    at = F.regexp_instr("text", F.col("p"))
    hit = rows.withColumn("at", at).where("at > 0")
    before = F.substring("text", 1, F.col("at") - 1)
    return hit.select("id", "pattern", F.regexp_substr("text", F.col("p")).alias("found"), (F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1).alias("line"), F.regexp_count("text", F.col("p")).alias("times"))


def text_copies(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``kept_id, copy_id``: documents whose texts have the same folded letters and digits, each with the first id of its group.

    Groups of any size stay spread: each document learns its group's first id, that of large
    groups where it is. Null texts, and those without a letter or digit, are no copies.
    """
    keyed = df.select(F.col(id_col).alias("copy_id"), text_key(F.col(text_col)).alias("key")).where("copy_id is not null and key is not null").distinct()
    keyed = cut(keyed, "text-keys")
    groups = cut(keyed.groupBy("key").agg(F.min("copy_id").alias("kept_id"), F.count("*").alias("n")), "text-groups")
    total = groups.agg(F.sum("n")).first()[0] or 0
    return left_join_counted(keyed, groups, "key", total).where("kept_id <> copy_id").select("kept_id", "copy_id")


def reread(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``key, state``: records read again: ``same``, ``blanks`` (only white space differs, accepted), ``differs``, ``missing`` or ``new``."""
    pack = lambda blank: F.to_json(F.struct(*[F.regexp_replace(c, r"\s+", "" if blank else " ").alias(c) if blank else F.col(c) for c in columns]), {"ignoreNullFields": "false"})
    a = old.select(F.col(key).alias("a"), pack(False).alias("ar"), pack(True).alias("ab"))
    b = new.select(F.col(key).alias("b"), pack(False).alias("br"), pack(True).alias("bb"))
    state = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "new").when(F.col("ar") == F.col("br"), "same").when(F.col("ab") == F.col("bb"), "blanks").otherwise("differs")
    return a.join(b, F.col("a") == F.col("b"), "full_outer").select(F.coalesce("a", "b").alias(key), state.alias("state"))


def unequal(a: DataFrame, b: DataFrame) -> DataFrame:
    """The rows of which one table has more than the other, with ``side`` (``left`` or ``right``); none if they hold the same rows."""
    return a.exceptAll(b.select(*a.columns)).withColumn("side", F.lit("left")).unionByName(b.select(*a.columns).exceptAll(a).withColumn("side", F.lit("right")))
