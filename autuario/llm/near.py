"""Near-duplicate texts by DartMinHash signatures and banded joining."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from autuario.llm.copies import copy_digest
from autuario.llm.darts import EMPTY, signatures
from autuario.llm.words import mix, pieces, sequence_hashes, shingle_hashes, word_hashes
from autuario.runtime import cut, partitions_for, spread

#: Signature bits kept beside each band, and how many of them must agree for a pair to be looked at.
BITS = 128
#: A run of one band key longer than this is joined in pieces by many tasks, chunk by chunk.
RUN, CHUNK = 256, 2048
#: Largest number of candidate texts whose ids are broadcast (some 30 bytes each); beyond it they are shuffled.
BROADCAST_IDS = 100_000

_SIGNED = "id string, h long, bands array<long>, s1 long, s2 long"
_PAIRED = "ha long, hb long, band long, h long, s1 long, s2 long, part int, chunk int"
_NAMES = ["ha", "hb", "band", "h", "s1", "s2", "part", "chunk"]


def plan_bands(threshold: float) -> tuple[int, int, int]:
    """(bands, rows, least agreeing bits) for a similarity threshold.

    Rows are as many as keep dissimilar texts apart, bands as many as miss fewer
    than 2 of 1,000 pairs exactly at the threshold; the bits' bound is 3.6 standard
    deviations below what such a pair has.
    """
    rows = 3 if threshold < 0.5 else 4 if threshold < 0.75 else 6
    bands = int(np.ceil(np.log(0.002) / np.log(1 - threshold**rows)))
    p = (1 + threshold) / 2
    return bands, rows, int(BITS * p - 3.6 * np.sqrt(BITS * p * (1 - p)))


def _sign(shingle: int, bands: int, rows: int):
    k = max(bands * rows, BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for part in pieces(texts):
                own = [texts[i] for i in part]
                n = len(own)
                doc, word = word_hashes(own)
                h = sequence_hashes(doc, word, n)
                sdoc, element = shingle_hashes(doc, word, shingle)
                fresh = np.zeros(n, bool)  # copies met in this task are signed once
                for i, x in enumerate(h.tolist()):
                    if x not in seen:
                        fresh[i] = True
                        seen.add(x)
                if len(seen) > 2_000_000:
                    seen.clear()
                has = np.bincount(sdoc, minlength=n) > 0
                keep = fresh[sdoc]
                sig = signatures(sdoc[keep], element[keep], None, n, k)
                bits = (mix(sig[:, :BITS]) & np.uint64(1)).astype(np.uint8)
                sketch = np.packbits(bits, axis=1).view(np.uint64)
                key = np.zeros((n, bands), np.uint64)
                for r in range(rows):
                    key = mix(key ^ sig[:, r * bands : (r + 1) * bands]) + np.arange(bands, dtype=np.uint64)
                signed = fresh & (sig != EMPTY).all(axis=1)
                flat = pa.array(key[signed].reshape(-1).view(np.int64))
                offsets = np.concatenate([[0], np.cumsum(np.where(signed, bands, 0))]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), flat, mask=pa.array(~signed))
                out = pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(part.start, n), pa.array(h.view(np.int64)), lists,
                     pa.array(sketch[:, 0].copy().view(np.int64)), pa.array(sketch[:, 1].copy().view(np.int64))],
                    names=["id", "h", "bands", "s1", "s2"],
                )
                yield out.filter(pa.array(has))

    return run


def _agree(a1: np.ndarray, a2: np.ndarray, b1: np.ndarray, b2: np.ndarray) -> np.ndarray:
    differ = np.bitwise_count((a1 ^ b1).view(np.uint64)).astype(np.int32) + np.bitwise_count((a2 ^ b2).view(np.uint64))
    return BITS - differ


def _pairs_out(ha, hb) -> pa.RecordBatch:
    n = len(ha)
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(ha, hb)), pa.array(np.maximum(ha, hb)), *[pa.nulls(n, pa.int64())] * 4, *[pa.nulls(n, pa.int32())] * 2], names=_NAMES)


def _rows_out(c: list[np.ndarray], part: int, chunk: np.ndarray) -> pa.RecordBatch:
    n = len(chunk)
    return pa.RecordBatch.from_arrays([*[pa.nulls(n, pa.int64())] * 2, *map(pa.array, c), pa.array(np.full(n, part, np.int32)), pa.array(chunk.astype(np.int32))], names=_NAMES)


def _pair_runs(least: int):
    """Pairs within runs of a band key in rows sorted by band and ``h``.

    The first and last run of a partition, which may go on in another one, and runs
    longer than ``RUN`` leave as rows numbered by chunk.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held: list[np.ndarray] = [np.zeros(0, np.int64)] * 4
        open_band: int | None = None  # the run that leaves row by row, how many rows have left, and the last of them
        left, last_h = 0, None
        first = True

        def leave(c: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            """Rows of one run, as chunks."""
            nonlocal open_band, left, last_h
            if c[0][0] != open_band:
                open_band, left, last_h = int(c[0][0]), 0, None
            h = c[1]
            fresh = np.concatenate([[last_h is None or h[0] != last_h], h[1:] != h[:-1]])
            last_h = h[-1]
            c = [x[fresh] for x in c]
            if len(c[0]):
                yield _rows_out(c, part, (left + np.arange(len(c[0]))) // CHUNK)
                left += len(c[0])

        def settle(c: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            """Whole runs; the partition's first one and the rest of one that is leaving go the same way."""
            nonlocal first
            start = np.flatnonzero(np.concatenate([[True], c[0][1:] != c[0][:-1]]))
            length = np.diff(np.concatenate([start, [len(c[0])]]))
            out = length > RUN
            out[0] |= first or c[0][0] == open_band
            first = False
            for s, m in zip(start[out].tolist(), length[out].tolist()):
                yield from leave([x[s : s + m] for x in c])
            stay = ~np.repeat(out, length)
            band, h, s1, s2 = (x[stay] for x in c)
            fresh = np.ones(len(band), bool)
            fresh[1:] = (band[1:] != band[:-1]) | (h[1:] != h[:-1])
            band, h, s1, s2 = (x[fresh] for x in (band, h, s1, s2))
            for k in range(1, RUN + 1):
                i = np.flatnonzero(band[k:] == band[:-k]) if len(band) > k else []
                if not len(i):
                    break
                i = i[_agree(s1[i], s2[i], s1[i + k], s2[i + k]) >= least]
                if len(i):
                    yield _pairs_out(h[i], h[i + k])

        for b in batches:
            c = [np.concatenate([x, np.asarray(b.column(n))]) for x, n in zip(held, ("band", "h", "s1", "s2"))]
            if not len(c[0]):
                continue
            last = int(np.searchsorted(c[0], c[0][-1]))
            if last:
                yield from settle([x[:last] for x in c])
            held = [x[last:] for x in c]
            if len(held[0]) > RUN:
                yield from leave(held)
                first = False
                held = [x[:0] for x in held]
        if len(held[0]):
            yield from leave(held)

    return run


def _pair_chunks(least: int):
    """Pairs between two chunks of a run (``i`` and ``j``), or within one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def settle(t: pa.Table) -> Iterator[pa.RecordBatch]:
            c = {n: t.column(n).to_numpy() for n in t.column_names}
            cut_at = np.flatnonzero((np.diff(c["band"]) != 0) | (np.diff(c["i"]) != 0) | (np.diff(c["j"]) != 0)) + 1
            for x in np.split(np.arange(len(t)), cut_at):
                left, right = x[c["side"][x] == 0], x[c["side"][x] == 1]
                same = c["i"][x[0]] == c["j"][x[0]]
                right = left if same else right
                for low in range(0, len(left), RUN):
                    own = left[low : low + RUN]
                    a, b = np.nonzero(_agree(c["s1"][own][:, None], c["s2"][own][:, None], c["s1"][right][None], c["s2"][right][None]) >= least)
                    if same:
                        a, b = a[b > a + low], b[b > a + low]
                    if len(a):
                        yield _pairs_out(c["h"][own[a]], c["h"][right[b]])

        for b in batches:
            t = pa.Table.from_batches([b] if held is None else [*held.to_batches(), b]).combine_chunks()
            band, i, j = (t.column(n).to_numpy() for n in ("band", "i", "j"))
            other = np.flatnonzero((band != band[-1]) | (i != i[-1]) | (j != j[-1])) if len(t) else []
            if len(other):
                yield from settle(t.slice(0, other[-1] + 1))
                t = t.slice(other[-1] + 1)
            held = t
        if held is not None and len(held):
            yield from settle(held)

    return run


def candidates(signed: DataFrame, least: int) -> DataFrame:
    """Distinct pairs ``ha < hb`` of sequence hashes that share a band and enough signature bits.

    One shuffle by range of band key and hash, so that the rows of one key, however
    many, are spread over tasks. Runs of a key that end within a task are paired
    there; others are cut into chunks, and each pair of a key's chunks is one unit of work.
    """
    rows = signed.where("bands is not null").select("h", "s1", "s2", F.explode("bands").alias("band")).select("band", "h", "s1", "s2")
    sorted_ = rows.repartitionByRange(partitions_for(rows), "band", "h").sortWithinPartitions("band", "h")
    made = cut(sorted_.mapInArrow(_pair_runs(least), _PAIRED), "near-pairs")
    short = made.where("ha is not null").select("ha", "hb")
    loose = made.where("ha is null").select("band", "h", "s1", "s2", "part", "chunk")
    chunk = loose.groupBy("band", "part", "chunk").agg(F.count("*").alias("n"))  # a row for each chunk of a key
    of_band = Window.partitionBy("band")
    numbered = chunk.select(
        "band", "part", "chunk", (F.row_number().over(of_band.orderBy("part", "chunk")) - 1).alias("own"), F.count("*").over(of_band).alias("chunks"), F.sum("n").over(of_band).alias("all")
    ).where("all > 1")
    sides = loose.join(numbered, ["band", "part", "chunk"]).select(
        "band", "h", "s1", "s2", "own", F.explode(F.sequence(F.lit(0), F.col("chunks").cast("int") - 1)).alias("other")
    ).select(
        "band", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "h", "s1", "s2",
        F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side"),
    )
    more = sides.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j").mapInArrow(_pair_chunks(least), _PAIRED)
    return short.unionByName(more.select("ha", "hb")).where("ha < hb").distinct()


def shingle_sets(texts: list[str], size: int) -> list[np.ndarray]:
    """The sets of ``size`` consecutive words of texts, as sorted 64-bit hashes."""
    out: list[np.ndarray] = []
    for part in pieces(texts):
        doc, element = shingle_hashes(*word_hashes([texts[i] for i in part]), size)
        edges = np.searchsorted(doc, np.arange(len(part) + 1))
        out += [np.unique(element[a:b]) for a, b in zip(edges, edges[1:])]
    return out


def _verify(threshold: float, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ha, hb = (np.asarray(batch.column(c)) for c in ("ha", "hb"))
            texts: dict[int, str] = {}
            for h, column in ((ha, "ta"), (hb, "tb")):
                found, first = np.unique(h, return_index=True)
                new = [(x, i) for x, i in zip(found.tolist(), first.tolist()) if x not in texts]
                texts.update(zip((x for x, _ in new), batch.column(column).take(pa.array([i for _, i in new], pa.int64())).to_pylist()))
            sets = dict(zip(texts, shingle_sets(list(texts.values()), size)))
            similarity = np.zeros(len(ha))
            for i, (x, y) in enumerate(zip(ha.tolist(), hb.tolist())):
                a, b = sets[x], sets[y]
                both = np.isin(a, b, assume_unique=True, kind="sort").sum()
                similarity[i] = both / (len(a) + len(b) - both)
            same = pa.array((batch.column("ka").to_pandas() == batch.column("kb").to_pandas()).to_numpy(bool))
            out = pa.RecordBatch.from_arrays([batch.column("ha"), batch.column("hb"), pa.array(similarity), same], names=["ha", "hb", "similarity", "copies"])
            yield out.filter(pa.array(similarity >= threshold))

    return run


def near_duplicates(df: DataFrame, id_col: str, text_col: str, threshold: float = 0.8, shingle: int = 5) -> tuple[DataFrame, DataFrame]:
    """Texts whose sets of ``shingle`` consecutive words have a Jaccard index of ``threshold`` or more.

    Gives two tables. Classes: ``h, id``, each id with the class of all texts that
    have the same words in the same order. Links: ``ha, hb, similarity, copies``, each
    pair of different classes at or above the threshold, verified on all shingles of
    the whole texts; ``copies``: they have the same letters and digits in order.

    Every text gets a DartMinHash signature; classes that share a band of it are
    compared by 128 signature bits and, where these agree enough, word by word.

    Cases: rows with a null id or null text, and texts with fewer words than a
    shingle, are in no class; rows delivered twice count once; an id with two texts
    is in two classes; an empty table gives empty tables; other columns are ignored.
    """
    bands, rows, least = plan_bands(threshold)
    texts = df.select(F.col(f"`{id_col}`").cast("string").alias("id"), F.col(f"`{text_col}`").alias("text")).where("id is not null and text is not null")
    signed = cut(spread(texts, "id").mapInArrow(_sign(shingle, bands, rows), _SIGNED), "near-signed")
    found = cut(candidates(signed, least), "near-candidates")
    ends = found.select(F.explode(F.array("ha", "hb")).alias("h")).distinct()
    few = ends.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    near = (lambda x: F.broadcast(x)) if few else (lambda x: x)
    first = signed.select("h", "id").join(near(ends), "h", "left_semi").groupBy("h").agg(F.min("id").alias("id"))
    first = cut(first, "near-first")
    whole = cut(_texts_of(texts, first, few), "near-texts")
    both = (
        found.join(whole.select(F.col("h").alias("ha"), F.col("text").alias("ta"), F.col("key").alias("ka")), "ha")
        .join(whole.select(F.col("h").alias("hb"), F.col("text").alias("tb"), F.col("key").alias("kb")), "hb")
        .select("ha", "hb", "ta", "tb", "ka", "kb")
    )
    links = cut(both.mapInArrow(_verify(threshold, shingle), "ha long, hb long, similarity double, copies boolean"), "near-links")
    return signed.select("h", "id").distinct(), links


def _texts_of(texts: DataFrame, first: DataFrame, few: bool) -> DataFrame:
    """One text of each class: that of its first id whose words have the class's hash."""
    held = texts.join(F.broadcast(first) if few else first, "id")

    def same(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = b.column("text").to_pylist()
            for part in pieces(t):
                h = sequence_hashes(*word_hashes([t[i] for i in part]), len(part)).view(np.int64)
                own = b.slice(part.start, len(part)).filter(pa.array(h == np.asarray(b.column("h").slice(part.start, len(part)))))
                keys = pa.array([copy_digest(x) for x in own.column("text").to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([own.column("h"), own.column("text"), keys], names=["h", "text", "key"])

    return held.select("h", "text").mapInArrow(same, "h long, text string, key binary").dropDuplicates(["h"])


def near_pairs(df: DataFrame, id_col: str, text_col: str, threshold: float, shingle: int) -> DataFrame:
    """``id_a, id_b, similarity``: pairs of ids, smaller first, of similar texts that are no copies of each other."""
    classes, links = near_duplicates(df, id_col, text_col, threshold, shingle)
    a, b = (classes.select(F.col("h").alias(f"h{c}"), F.col("id").alias(f"i{c}")) for c in "ab")
    pairs = links.where("not copies").join(a, "ha").join(b, "hb").where("ia <> ib")
    return pairs.select(F.least("ia", "ib").alias("id_a"), F.greatest("ia", "ib").alias("id_b"), "similarity").distinct()


def near_groups(df: DataFrame, id_col: str, text_col: str, threshold: float, shingle: int, max_rounds: int | None = None) -> DataFrame:
    """``id, group_id``: connected groups of classes linked by similarity; group_id is the group's smallest id.

    Labels travel along links and are then shortened to their label's label, so
    rounds grow with the logarithm of a chain's length; they go on until no label
    moves, and if ``max_rounds`` are given and don't suffice, there is no result but
    an error. Ids without any similar text, or copy, are groups of one; an id with
    several texts is in one group with all that is near any of them.
    """
    classes, links = near_duplicates(df, id_col, text_col, threshold, shingle)
    one = classes.groupBy("id").agg(F.min("h").alias("ha"), F.max("h").alias("hb")).where("ha <> hb").select("id", "ha")  # ids with several texts tie their classes together
    tied = classes.join(one, "id").where("h <> ha").select("ha", F.col("h").alias("hb")).distinct()
    pairs = links.select("ha", "hb").unionByName(tied)
    edges = cut(pairs.select(F.col("ha").alias("a"), F.col("hb").alias("b")).unionByName(pairs.select(F.col("hb").alias("a"), F.col("ha").alias("b"))), "near-edges")
    label = cut(edges.select("a").distinct().withColumn("label", F.col("a")), "near-label")
    for k in count():  # a label only falls, so this ends
        if k == max_rounds:
            raise RuntimeError(f"labels still move after {max_rounds} rounds")
        offered = edges.join(label.select(F.col("a").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("offer"))
        lower = label.join(offered, "a", "left").select("a", "label", F.least("label", F.coalesce("offer", "label")).alias("new"))
        jump = label.select(F.col("a").alias("new"), F.col("label").alias("far"))
        new = cut(lower.join(jump, "new").select("a", F.least("new", "far").alias("new"), "label"), "near-label")
        changed = not new.where("new <> label").isEmpty()
        label = new.select("a", F.col("new").alias("label"))
        if not changed:
            break
    tagged = classes.join(label.withColumnRenamed("a", "h"), "h", "left").select("id", F.coalesce("label", "h").alias("label"))
    lead = tagged.groupBy("label").agg(F.min("id").alias("group_id"))
    return tagged.join(lead, "label").groupBy("id").agg(F.min("group_id").alias("group_id"))
