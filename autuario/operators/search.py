"""Lexical retrieval: matching and BM25 ranking of texts against a query tree.

``measure`` reads each text once and keeps, per document, its length and how often
each leaf of the query occurs in it; everything else works on those few numbers. The
same numbers come from a written index (``Index``), where a query reads only the row
groups of its terms.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from autuario.functions.text import stems, tokens
from autuario.plans.language import Leaf, Node, leaves
from autuario.runtime import checkpoint_root, cut, is_kept, kept, partitions_for, read_small, spread, write_small

#: Parameters of BM25, and its least weight of a term.
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6


def _hits(words: Column, leaf: Leaf) -> Column:
    """How often a leaf occurs in an array of tokens."""
    t = leaf.tokens
    if not t:
        return F.lit(0)
    if len(t) == 1:
        return F.size(F.filter(words, lambda x: x.startswith(t[0]) if leaf.prefix else x == t[0]))

    def here(i: Column) -> Column:
        checks = [F.element_at(words, i + k) == x for k, x in enumerate(t)]
        if leaf.prefix:
            checks[-1] = F.element_at(words, i + len(t) - 1).startswith(t[-1])
        return reduce(Column.__and__, checks)

    spots = F.filter(F.sequence(F.lit(1), F.greatest(F.size(words) - len(t) + 1, F.lit(1))), here)
    return F.when(F.size(words) >= len(t), F.size(spots)).otherwise(0)


def _words(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, w``: each text's tokens."""
    texts = df.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return spread(texts, "id").select("id", tokens(F.col("text")).alias("w"))


def measure(df: DataFrame, id_col: str, text_col: str, tree: Leaf | Node) -> DataFrame:
    """``id, length, hits``: each document's number of tokens and array of hits per leaf.

    Null texts have no row; a document delivered twice has one.
    """
    return measure_tokens(_words(df, id_col, text_col), tree)


def measure_tokens(words: DataFrame, tree: Leaf | Node) -> DataFrame:
    """As ``measure``, of ``id, w`` with each text's tokens."""
    found = leaves(tree)
    single = lambda x: len(x.tokens) == 1 and not x.prefix
    terms = [x.tokens[0] for x in found if single(x)]
    words = words.select("id", "w", F.filter("w", lambda x: x.isin(terms)).alias("own")) if terms else words  # the text is gone through once for all single terms
    counted = F.array(*[_hits(F.col("own" if single(x) else "w"), x) for x in found])
    return words.select("id", F.size("w").alias("length"), counted.alias("hits")).dropDuplicates(["id"])


def stemmed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, w``: the stems of each text's tokens."""
    return _words(df, id_col, text_col).select("id", stems(F.col("w")).alias("w"))


def stem_tree(spark: SparkSession, tree: Leaf | Node) -> Leaf | Node:
    """The tree with stems in place of its tokens; prefixes stay."""
    tokens_of = list(dict.fromkeys(t for x in leaves(tree) for t in x.tokens))
    row = spark.createDataFrame([(tokens_of,)], "w array<string>").select(stems(F.col("w")).alias("w")).first()
    known = dict(zip(tokens_of, row["w"]))
    turn = lambda x: Node(x.kind, tuple(map(turn, x.parts))) if isinstance(x, Node) else x if x.prefix else Leaf(x.text, tuple(known[t] for t in x.tokens))
    return turn(tree)


def matches(tree: Leaf | Node, order: list[Leaf]) -> Column:
    """Whether a document's ``hits`` satisfy the tree."""
    if isinstance(tree, Leaf):
        return F.col("hits")[order.index(tree)] > 0
    parts = [matches(p, order) for p in tree.parts]
    return reduce(Column.__and__ if tree.kind == "and" else Column.__or__, parts)


def statistics(measured: DataFrame, n_leaves: int) -> tuple[int, float, list[int]]:
    """(documents, mean length, documents with each leaf), over all documents."""
    row = measured.agg(
        F.count("*").alias("n"), F.avg("length").alias("mean"), *[F.count_if(F.col("hits")[i] > 0).alias(f"d{i}") for i in range(n_leaves)]
    ).first()
    return row["n"], row["mean"] or 0.0, [row[f"d{i}"] for i in range(n_leaves)]


def bm25(stats: tuple[int, float, list[int]]) -> Column:
    """The sum of the leaves' BM25 scores; larger is better."""
    n, mean, documents = stats
    total = F.lit(0.0)
    for i, d in enumerate(documents):
        idf = F.greatest(F.log(F.lit((n - d + 0.5) / (d + 0.5))), F.lit(LEAST_IDF))
        tf = F.col("hits")[i].cast("double")
        total = total + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("length") / F.lit(mean or 1.0)))
    return total


def ranked(measured: DataFrame, tree: Leaf | Node) -> DataFrame:
    """``id, score, hits`` of the documents that match; statistics are of all documents."""
    order = leaves(tree)
    held = cut(measured, "search-measured")
    return held.where(matches(tree, order)).select("id", bm25(statistics(held, len(order))).alias("score"), "hits")


def best_first(df: DataFrame, date: str = "publication") -> list[Column]:
    """Order of relevance: score, then the later date with dates lacking last, then id."""
    return [F.col("score").desc(), F.col(date).desc_nulls_last(), F.col("id").asc()]


def postings(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``term, id, tf, positions, length``: the inverted index of whole texts, made within the row.

    Each document has one more row, of the empty term, so that its length is known
    whatever it holds.
    """
    words = _words(df, id_col, text_col).dropDuplicates(["id"])
    placed = words.select("id", F.size("w").alias("length"), F.array_sort(F.transform("w", lambda x, i: F.struct(x.alias("term"), i.alias("pos")))).alias("s"))
    term = lambda i: F.get("s", i)["term"]
    begun = placed.select("*", F.when(F.col("length") > 0, F.filter(F.sequence(F.lit(1), F.greatest("length", F.lit(1))), lambda i: (i == 1) | (term(i - 1) != term(i - 2)))).otherwise(F.array().cast("array<int>")).alias("a"))
    after = lambda i: F.when(i + 1 < F.size("a"), F.get("a", i + 1)).otherwise(F.col("length") + 1)
    runs = F.transform("a", lambda s, i: F.struct(term(s - 1).alias("term"), F.transform(F.slice("s", s, after(i) - s), lambda x: x["pos"]).alias("positions")))
    whole = F.array(F.struct(F.lit("").alias("term"), F.array().cast("array<int>").alias("positions")))
    each = begun.select("id", "length", F.explode(F.concat(whole, runs)).alias("x"))
    return each.select("x.term", "id", F.size("x.positions").alias("tf"), "x.positions", "length")


class Index:
    """A written index of texts: sorted segments, and a manifest written last.

    A segment holds the postings of some documents, sorted by term and id, so that a
    query's terms are in few row groups; the range partitioning includes the id, which
    spreads a term of a third of all texts. New and changed documents come as a further
    segment, and ids that left an earlier one are kept in its list of gone ids, so an update
    costs what it brings. ``compact`` writes one segment again.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        held = read_small(spark, f"{self.path}/index.json")
        self.manifest = json.loads(held) if held else {"segments": [], "documents": 0, "tokens": 0}

    def _keep(self, **changes) -> "Index":
        write_small(self.spark, f"{self.path}/index.json", json.dumps(self.manifest | changes))
        return Index(self.spark, self.path)

    def _write(self, found: DataFrame, segment: str) -> None:
        found.repartitionByRange(partitions_for(found), "term", "id").sortWithinPartitions("term", "id").write.mode("overwrite").parquet(f"{self.path}/{segment}")

    def _size(self, rows: DataFrame) -> tuple[int, int]:
        r = rows.where("term = ''").agg(F.count("*").alias("n"), F.sum("length").alias("t")).first()
        return r["n"], r["t"] or 0

    def _segment(self, s: dict) -> DataFrame:
        """A segment's rows, without those of ids that are gone from it."""
        rows = self.spark.read.parquet(f"{self.path}/{s['path']}")
        for gone, n in s["gone"]:
            ids = self.spark.read.parquet(f"{self.path}/{gone}")
            rows = rows.join(F.broadcast(ids) if n <= BROADCAST_IDS else ids, "id", "left_anti")
        return rows

    def rows(self) -> DataFrame:
        """All postings."""
        parts = [self._segment(s) for s in self.manifest["segments"]]
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], "term string, id string, tf int, positions array<int>, length int")

    def replace(self, df: DataFrame, id_col: str, text_col: str, gone: DataFrame | None = None) -> "Index":
        """The index with the texts of ``df``, new or in place of those of their ids, and without the ids of ``gone``.

        A changed text that is null leaves the index. An index without segments is written whole.
        """
        tag = uuid.uuid4().hex[:12]
        old = self.manifest["segments"]
        fresh = df if gone is None else df.join(gone.select(id_col).distinct(), id_col, "left_anti")
        self._write(cut(postings(fresh, id_col, text_col), "index-postings"), f"segment-{tag}")  # range bounds are drawn from it without tokenizing twice
        added = {"path": f"segment-{tag}", "gone": []}
        n, t = self._size(self._segment(added))
        if old:
            ids = df.select(F.col(f"`{id_col}`").alias("id"))
            out = ids if gone is None else ids.unionByName(gone.select(F.col(f"`{id_col}`").alias("id")))
            out.where("id is not null").distinct().write.mode("overwrite").parquet(f"{self.path}/gone-{tag}")
            ids = self.spark.read.parquet(f"{self.path}/gone-{tag}")
            count = ids.count()
            lost, tokens_lost = self._size(self.rows().where("term = ''").join(F.broadcast(ids) if count <= BROADCAST_IDS else ids, "id", "left_semi"))
            old = [s | {"gone": [*s["gone"], [f"gone-{tag}", count]]} for s in old]
            n, t = n + self.manifest["documents"] - lost, t + self.manifest["tokens"] - tokens_lost
        return self._keep(segments=[*old, added], documents=n, tokens=t)

    def compact(self) -> "Index":
        """One segment in place of all."""
        tag = uuid.uuid4().hex[:12]
        self._write(self.rows(), f"segment-{tag}")
        return self._keep(segments=[{"path": f"segment-{tag}", "gone": []}])

    def measure(self, tree: Leaf | Node) -> DataFrame:
        """As ``measure``, of the documents that have a token of the query; reads its terms' row groups only."""
        return _measure_postings(self.rows(), tree)

    def statistics(self, measured: DataFrame, n_leaves: int) -> tuple[int, float, list[int]]:
        """As ``statistics``: the size is the index's, the documents with each leaf are among those measured."""
        n = self.manifest["documents"]
        return n, self.manifest["tokens"] / n if n else 0.0, statistics(measured, n_leaves)[2]

    def ranked(self, tree: Leaf | Node, keep: DataFrame | None = None) -> DataFrame:
        """As ``ranked``; only matches among the ids of ``keep`` are scored, if it is given.

        The documents with each single word are counted among its postings; where a query has
        phrases or prefixes, all is measured first and counted then.
        """
        order = leaves(tree)
        if all(len(x.tokens) == 1 and not x.prefix for x in order):
            terms = [x.tokens[0] for x in order]
            counts = {r["term"]: r["n"] for r in self.rows().where(F.col("term").isin(terms)).groupBy("term").agg(F.count("*").alias("n")).collect()}
            n = self.manifest["documents"]
            held, stats = self.measure(tree), (n, self.manifest["tokens"] / n if n else 0.0, [counts.get(t, 0) for t in terms])
        else:
            held = cut(self.measure(tree), "search-measured")
            stats = self.statistics(held, len(order))
        found = held.where(matches(tree, order))
        found = found if keep is None else found.join(keep, "id")
        return found.withColumn("score", bm25(stats)).drop("length")


#: Ids up to this number are broadcast (some 30 bytes each).
BROADCAST_IDS = 100_000
_INDEXES: dict[tuple[str, str, str], str] = {}


def index_for(spark: SparkSession, df: DataFrame, id_col: str, text_col: str, name: str) -> Index:
    """The index of a table's texts, written in the shared folder on first use in an application."""
    key = (spark.sparkContext.applicationId, name, text_col)
    if key not in _INDEXES or not is_kept(_INDEXES[key]):
        path = f"{checkpoint_root(spark).rstrip('/')}/index-{uuid.uuid4().hex}"
        Index(spark, path).replace(df, id_col, text_col)
        kept(spark, path)
        _INDEXES[key] = path
    return Index(spark, _INDEXES[key])


def _shifted(positions: Column, by: int) -> Column:
    return F.transform(positions, lambda p: p - by)


def _measure_postings(rows: DataFrame, tree: Leaf | Node) -> DataFrame:
    """``id, length, hits`` of the documents that have a token of the query."""
    found = leaves(tree)
    wanted = F.lit(False)
    for leaf in found:
        for k, t in enumerate(leaf.tokens):
            last = leaf.prefix and k == len(leaf.tokens) - 1
            wanted = wanted | (F.col("term").startswith(t) if last else F.col("term") == t)

    def hits(leaf: Leaf) -> Column:
        if not leaf.tokens:
            return F.lit(0)
        if len(leaf.tokens) == 1:
            is_term = F.col("term").startswith(leaf.tokens[0]) if leaf.prefix else F.col("term") == leaf.tokens[0]
            return F.coalesce(F.sum(F.when(is_term, F.col("tf"))), F.lit(0)).cast("int")
        sets = []
        for k, t in enumerate(leaf.tokens):
            last = leaf.prefix and k == len(leaf.tokens) - 1
            is_term = F.col("term").startswith(t) if last else F.col("term") == t
            sets.append(_shifted(F.flatten(F.collect_list(F.when(is_term, F.col("positions")))), k))
        return F.size(reduce(F.array_intersect, sets))

    spots = rows.where(wanted)
    return spots.groupBy("id").agg(F.first("length").alias("length"), F.array(*[hits(x) for x in found]).alias("hits"))


def present_terms(order: list[Leaf]) -> Column:
    """The query's terms found in a document, in the query's order."""
    return F.array_compact(F.array(*[F.when(F.col("hits")[i] > 0, F.lit(x.text + "*" * x.prefix)) for i, x in enumerate(order)]))


def snippet(df: DataFrame, id_col: str, text_col: str, order: list[Leaf], size: int = 16) -> DataFrame:
    """``id, first_token, distinct_terms, snippet_tokens``: the window of ``size`` tokens with
    most distinct terms of the query, the earliest of such; for the few documents of a page."""
    words = df.select(F.col(id_col).alias("id"), tokens(F.col(text_col)).alias("w")).dropDuplicates(["id"])

    # one bit per leaf: a token's mask, then the window's
    exact: dict[str, int] = {}
    for k, leaf in enumerate(order):
        if not leaf.prefix:
            for t in leaf.tokens:
                exact[t] = exact.get(t, 0) | 1 << k
    known = F.create_map(*[x for t, bits in exact.items() for x in (F.lit(t), F.lit(bits).cast("long"))]) if exact else None
    begins = [(leaf.tokens[-1], 1 << k) for k, leaf in enumerate(order) if leaf.prefix and leaf.tokens]

    def mask(x: Column) -> Column:
        bits = F.coalesce(known[x], F.lit(0).cast("long")) if known is not None else F.lit(0).cast("long")
        for start, bit in begins:
            bits = bits.bitwiseOR(F.when(x.startswith(start), F.lit(bit).cast("long")).otherwise(F.lit(0).cast("long")))
        return bits

    words = words.withColumn("m", F.transform("w", mask))
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1)))

    def distinct(i: Column) -> Column:
        return F.bit_count(F.aggregate(F.slice("m", i, F.lit(size)), F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x)))

    scored = F.transform(starts, lambda i: F.struct((-distinct(i)).alias("d"), i.alias("i")))
    best = F.array_min(scored)
    return words.where(F.size("w") > 0).select("id", "w", best.alias("b")).select(
        "id", (F.col("b.i") - 1).alias("first_token"), (-F.col("b.d")).alias("distinct_terms"), F.slice("w", F.col("b.i"), F.lit(size)).alias("snippet_tokens")
    )


def run_starts(ordered: Column) -> Column:
    """Where the runs of a sorted, non-empty array column begin (from 1)."""
    return F.filter(F.sequence(F.lit(1), F.size(ordered)), lambda i: (i == 1) | (F.get(ordered, i - 1) != F.get(ordered, i - 2)))


def run_counts(ordered: Column, starts: Column) -> Column:
    """The distinct tokens of a sorted array column with their numbers; linear in long texts, as both columns are there already."""
    after = F.size(starts)
    return F.transform(starts, lambda s, i: F.struct(F.get(ordered, s - 1).alias("term"), (F.when(i + 1 < after, F.get(starts, i + 1)).otherwise(F.size(ordered) + 1) - s).alias("tf")))


def vocabulary(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``term, documents, occurrences`` over all texts; counted per document before the shuffle."""
    words = _words(df, id_col, text_col).dropDuplicates(["id"])
    sorted_ = words.select(F.array_sort("w").alias("w")).where(F.size("w") > 0)
    begins = sorted_.select("w", run_starts(F.col("w")).alias("s"))
    each = begins.select(F.explode(run_counts(F.col("w"), F.col("s"))).alias("x")).select("x.term", "x.tf")
    return each.groupBy("term").agg(F.count("*").alias("documents"), F.sum("tf").alias("occurrences"))


def seed_terms(index: Index, text: DataFrame, text_col: str, most: int = 25, least_documents: int = 5, share: float = 0.25) -> DataFrame:
    """``term, weight``: a document's terms by tf-idf: letters only, three or more, neither rare nor common.

    ``text`` is the document's row; its terms' documents are counted in the index, by row groups of these terms.
    """
    own = text.where(F.col(text_col).isNotNull()).select(tokens(F.col(text_col)).alias("w")).limit(1)
    mine = own.select(F.explode("w").alias("term")).where(F.col("term").rlike(r"^\p{L}{3,}$")).groupBy("term").agg(F.count("*").alias("tf"))
    said = [(r["term"], r["tf"]) for r in mine.collect()]  # the vocabulary of one document
    spark, n = text.sparkSession, index.manifest["documents"]
    if not said or not n:
        return spark.createDataFrame([], "term string, weight double")
    held = index.rows().where(F.col("term").isin([t for t, _ in said]))
    counts = held.groupBy("term").agg(F.count("*").alias("documents")).where((F.col("documents") >= least_documents) & (F.col("documents") <= share * n))
    weight = F.col("tf") * F.log(F.lit(float(n)) / F.col("documents"))
    return counts.join(F.broadcast(spark.createDataFrame(said, "term string, tf long")), "term").select("term", weight.alias("weight")).orderBy(F.round("weight", 9).desc(), "term").limit(most)


# -- several fields -------------------------------------------------------------

def measure_fields(df: DataFrame, id_col: str, fields: list[str], tree: Leaf | Node) -> DataFrame:
    """``id, length, hits``: the length of all fields together and, per leaf, the hits in each field."""
    found = leaves(tree)
    rows = df.select(F.col(id_col).alias("id"), *[tokens(F.coalesce(F.col(f), F.lit(""))).alias(f"w{i}") for i, f in enumerate(fields)]).dropDuplicates(["id"])
    length = reduce(Column.__add__, [F.size(f"w{i}") for i in range(len(fields))])
    hits = F.array(*[F.array(*[_hits(F.col(f"w{i}"), x) for i in range(len(fields))]) for x in found])
    return rows.select("id", length.alias("length"), hits.alias("fields"))


def in_fields(measured: DataFrame, weights: list[float], only: int | None = None) -> DataFrame:
    """``id, length, hits, matched``: hits weighed by field, and the places of the fields that have any; ``only``: one field counts."""
    used = range(len(weights)) if only is None else [only]
    total = lambda h: reduce(Column.__add__, [h[i].cast("double") * F.lit(float(weights[i])) for i in used])
    hit = lambda i: F.exists("fields", lambda h: h[i] > 0)
    matched = F.array_compact(F.array(*[F.when(hit(i), F.lit(i)) for i in used]))
    return measured.select("id", "length", F.transform("fields", total).alias("hits"), matched.alias("matched"))
