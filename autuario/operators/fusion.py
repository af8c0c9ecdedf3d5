"""Dense ranking by cosine and fusion of several rankings by reciprocal ranks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cosine(a: Column, b: Column) -> Column:
    """The cosine of two arrays of equal length; null where one is all zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)


def nearest(vectors: DataFrame, id_col: str, vector_col: str, query: Sequence[float], k: int) -> DataFrame:
    """``id, similarity``: the ``k`` vectors of greatest cosine with the query, ties by id; one scan against one vector."""
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = vectors.where(F.size(vector_col) == len(query)).select(F.col(id_col).alias("id"), cosine(F.col(vector_col), q).alias("similarity")).where("similarity is not null")
    return scored.orderBy(F.round("similarity", 9).desc(), "id").limit(k)


#: Vectors, and queries, of a block; a pair of blocks is one product of matrices.
BLOCK = 2_000


def _blocks(vectors: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int]:
    """``block, ids, rows``: vectors dealt to blocks of about ``BLOCK``, and the number of blocks."""
    v = F.col(f"`{vector_col}`")
    whole = vectors.select(F.col(f"`{id_col}`").alias("id"), v.cast("array<double>").alias("row")).where("id is not null and size(row) > 0 and not exists(row, x -> x is null) and exists(row, x -> x <> 0)")
    blocks = max(1, -(-whole.count() // BLOCK))
    dealt = whole.groupBy(F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block")).agg(F.collect_list(F.struct("id", "row")).alias("x"))
    return dealt.select("block", F.col("x.id").alias("ids"), F.col("x.row").alias("rows")), blocks


def nearest_of_each(vectors: DataFrame, queries: DataFrame, id_col: str, vector_col: str, k: int) -> DataFrame:
    """``query, id, similarity``: for each query the ``k`` vectors of greatest cosine, ties by id.

    Every block of queries meets every block of vectors in one task, which keeps each
    query's best; these are merged. Cases: vectors of another length than the query's,
    with nulls or all zero are near to nothing; ids are unique.
    """
    kind = vectors.schema[id_col].dataType.simpleString()
    (a, n), (b, m) = _blocks(queries, id_col, vector_col), _blocks(vectors, id_col, vector_col)
    pairs = vectors.sparkSession.range(n * m).select(F.floor(F.col("id") / m).alias("qa"), F.pmod("id", F.lit(m)).alias("vb"))
    met = pairs.join(a.select(F.col("block").alias("qa"), F.col("ids").alias("qi"), F.col("rows").alias("qr")), "qa").join(b.select(F.col("block").alias("vb"), "ids", "rows"), "vb")

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(len(batch)):
                one = {c: batch.column(c)[at].values for c in ("qi", "qr", "ids", "rows")}
                out: list[tuple] = []
                sizes = [np.diff(one[c].offsets.to_numpy()) for c in ("qr", "rows")]
                for size in np.unique(sizes[0]):
                    q, v = (np.flatnonzero(s == size) for s in sizes)
                    if not len(v):
                        continue
                    x, y = (one[c].take(pa.array(i)).flatten().to_numpy().reshape(-1, size) for c, i in (("qr", q), ("rows", v)))
                    near = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ (y / np.linalg.norm(y, axis=1, keepdims=True)).T
                    ids = one["ids"].take(pa.array(v)).to_pylist()
                    for query, row in zip(one["qi"].take(pa.array(q)).to_pylist(), near):
                        key = np.round(row, 9)
                        least = np.partition(key, -k)[-k] if len(key) > k else -2.0
                        held = sorted(np.flatnonzero(key >= least).tolist(), key=lambda i: (-key[i], ids[i]))[:k]
                        out += [(query, ids[i], float(row[i])) for i in held]
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in enumerate((one["qi"].type, one["ids"].type, pa.float64()))], names=["query", "id", "similarity"])

    ranks = Window.partitionBy("query").orderBy(F.round("similarity", 9).desc(), "id")
    found = met.select("qi", "qr", "ids", "rows").mapInArrow(best, f"query {kind}, id {kind}, similarity double")
    return found.withColumn("place", F.row_number().over(ranks)).where(F.col("place") <= k).select("query", "id", "similarity")


def reciprocal_ranks(rankings: Sequence[tuple[DataFrame, Column, float]], k: int, constant: int = 60) -> DataFrame:
    """``id, score``: rankings (``id`` and an order, with a weight) fused by the sum of weight / (constant + rank).

    Each ranking is already cut to its best few, as fusion is of pages, so the ranks are cheap.
    """
    parts = [df.select("id", (F.lit(w) / (F.lit(constant) + F.row_number().over(Window.orderBy(order, F.col("id"))))).alias("part")) for df, order, w in rankings]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy("id").agg(F.sum("part").alias("score")).orderBy(F.round("score", 12).desc(), "id").limit(k)
