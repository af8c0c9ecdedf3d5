"""Filling containers of fixed capacity with texts."""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from autuario.runtime import cut

#: Items packed together by one task; the groups are drawn by a hash, so each is like the whole.
GROUP = 20_000

_PACKED = "container string, capacity int, bin string, id long, piece int, position int, place int, start long, tokens int"


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of item indices: largest items first, each into the fullest bin with room."""
    room_of: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, bins = 0, []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        s = sizes[i]
        above = mask >> s
        if above:
            room = s + (above & -above).bit_length() - 1
            b = room_of[room].pop()
            if not room_of[room]:
                mask &= ~(1 << room)
        else:
            b, room = len(bins), capacity
            bins.append([])
        bins[b].append(i)
        room_of[room - s].append(b)
        mask |= 1 << (room - s)
    return bins


def improve(bins: list[list[int]], sizes: list[int], capacity: int) -> list[list[int]]:
    """Local search: moves, one-for-one, two-for-one and one-for-two exchanges between underfull bins.

    Each step makes a bin fuller than the other was, so the sum of squared fills grows,
    and the search ends when no step raises it. Bins that end up empty go. Full
    bins are left alone.
    """
    fill = [sum(sizes[i] for i in b) for b in bins]
    changed = True
    while changed:
        changed = False
        under = sorted((b for b in range(len(bins)) if bins[b] and fill[b] < capacity), key=lambda b: -fill[b])
        where = {i: b for b in under for i in bins[b]}
        pool = sorted((sizes[i], i) for i in where)
        for a in under:  # takes from all others
            for i in bins[a]:
                pool.pop(bisect_right(pool, (sizes[i], i)) - 1)
            while fill[a] < capacity and pool:
                step = _best_step(bins[a], sizes, capacity - fill[a], pool, fill, where, fill[a])
                if step is None:
                    break
                given, taken = step
                b = where[taken[0]]
                for i in taken:
                    pool.pop(bisect_right(pool, (sizes[i], i)) - 1)
                    bins[where[i]].remove(i)
                    fill[where[i]] -= sizes[i]
                    bins[a].append(i)
                    fill[a] += sizes[i]
                for i in given:
                    bins[a].remove(i)
                    fill[a] -= sizes[i]
                    bins[b].append(i)
                    fill[b] += sizes[i]
                    where[i] = b
                    insort(pool, (sizes[i], i))
                changed = True
            for i in bins[a]:
                where[i] = a
                insort(pool, (sizes[i], i))
    return [b for b in bins if b]


def _best_step(own: list[int], sizes, gap: int, pool, fill, where, own_fill: int):
    """(items to give, items to take) that fill the gap most, None if nothing helps.

    Tried with all items: take one for none, take one for one, take one for two, and take
    two of one donor for one. The receiver must get fuller than the donor was.
    """
    best, found = 0, None

    def offer(given: list[int], out: int):
        nonlocal best, found
        k = bisect_right(pool, (gap + out, 1 << 62)) - 1
        while k >= 0 and (got := pool[k][0] - out) > best:
            if own_fill + got > fill[where[pool[k][1]]]:
                best, found = got, (given, [pool[k][1]])
                return
            k -= 1

    offer([], 0)
    one = list({sizes[i]: i for i in own}.values())  # items of a size are alike
    for i in one:
        if best == gap:
            return found
        offer([i], sizes[i])
    pairs = {sizes[i] + sizes[j]: [i, j] for k, i in enumerate(own) for j in own[k + 1 :]} if best < gap else {}
    for out, pair in pairs.items():
        if best == gap:
            return found
        offer(pair, out)
    if best == gap:
        return found
    donors: dict[int, list[tuple[int, int]]] = {}
    for x in pool:
        donors.setdefault(where[x[1]], []).append(x)
    for i in one:
        for b, held in donors.items():
            low, high = 0, len(held) - 1
            while low < high:
                got = held[low][0] + held[high][0] - sizes[i]
                if got > gap:
                    high -= 1
                    continue
                if got > best and own_fill + got > fill[b]:
                    best, found = got, ([i], [held[low][1], held[high][1]])
                    if best == gap:
                        return found
                low += 1
    return found


def pour(bins: list[list[tuple[int, int]]], flexible: list[bool], capacity: int) -> list[list[tuple[int, int]]]:
    """Empty bins that hold only rests of split items into the room left in others.

    Such a rest may be divided once more, since its item is larger than a container.
    Bins hold (item, size); the emptiest are poured first, into the largest gaps.
    """
    fill = [sum(s for _, s in b) for b in bins]
    loose = sorted((b for b in range(len(bins)) if all(flexible[i] for i, _ in bins[b])), key=lambda b: (fill[b], b))
    gaps = sorted((capacity - f, b) for b, f in enumerate(fill) if f < capacity)
    room = sum(g for g, _ in gaps)
    for b in loose:
        own = capacity - fill[b]
        if not bins[b] or room - own < fill[b]:
            break
        if own:
            gaps.remove((own, b))
            room -= own
        for i, s in bins[b]:
            while s:
                g, to = gaps.pop()
                part = min(g, s)
                bins[to].append((i, part))
                s -= part
                room -= part
                if part < g:
                    insort(gaps, (g - part, to))
                fill[to] += part
        bins[b], fill[b] = [], 0
    return [b for b in bins if b]


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pack each group of rows sorted by (container, group)."""

    def settle(t: pa.Table) -> Iterator[pa.RecordBatch]:
        names, groups = t.column("container").to_pylist(), t.column("grp").to_numpy()
        edges = [0, *(i for i in range(1, len(t)) if names[i] != names[i - 1] or groups[i] != groups[i - 1]), len(t)]
        for a, b in zip(edges, edges[1:]):
            own = t.slice(a, b - a)
            sizes = own.column("tokens").to_pylist()
            capacity = own.column("capacity")[0].as_py()
            packed = improve(best_fit(sizes, capacity), sizes, capacity)
            flexible = (own.column("piece").to_numpy() > 0).tolist()  # rests of items larger than the capacity
            bins = pour([[(i, sizes[i]) for i in x] for x in packed], flexible, capacity)
            order = np.array([i for x in bins for i, _ in x], np.int64)
            position = np.array([k for x in bins for k in range(len(x))], np.int32)
            size = np.array([s for x in bins for _, s in x], np.int64)
            by_item = np.argsort(order, kind="stable")
            first = np.concatenate([[True], order[by_item][1:] != order[by_item][:-1]])
            starts = np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
            before = np.cumsum(size[by_item]) - size[by_item]
            part, skipped = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
            part[by_item] = np.arange(len(order)) - starts
            skipped[by_item] = before - before[starts]
            ends = np.cumsum(size)
            heads = np.flatnonzero(position == 0)
            base = np.repeat(ends[heads] - size[heads], np.diff([*heads, len(order)]))
            label = [f"{groups[a]}-{k}" for k, x in enumerate(bins) for _ in x]
            got = own.take(pa.array(order))
            yield pa.RecordBatch.from_arrays(
                [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in (
                    got.column("container"), got.column("capacity"), pa.array(label), got.column("id"),
                    pa.array((got.column("piece").to_numpy() + part).astype(np.int32)),
                    pa.array(position), pa.array((ends - size - base).astype(np.int32)), pa.array(got.column("start").to_numpy() + skipped), pa.array(size.astype(np.int32)))],
                names=["container", "capacity", "bin", "id", "piece", "position", "place", "start", "tokens"],
            )

    held: pa.Table | None = None
    for b in batches:
        t = pa.Table.from_batches([b] if held is None else [*held.to_batches(), b])
        names, groups = t.column("container").to_pylist(), t.column("grp").to_pylist()
        last = len(t) - 1
        while last > 0 and (names[last - 1], groups[last - 1]) == (names[-1], groups[-1]):
            last -= 1
        if last > 0:
            yield from settle(t.slice(0, last))
            t = t.slice(last)
        held = t
    if held is not None and len(held):
        yield from settle(held)


def pack(items: DataFrame, containers: DataFrame) -> DataFrame:
    """Place items (``id long, tokens long``) in containers of each kind (``container, capacity``).

    Result: ``container, capacity, bin, id, piece, position, place, start, tokens``: the
    bin, the item's number (``position``) and first token (``place``) in it, and the
    piece's number and first token in the item. Only an item larger than the capacity
    is split, into pieces that fill a bin each and a rest that is packed like an item;
    rests alone in a bin are divided once more where that fills gaps and saves the bin.

    Items are dealt by a hash of their id into groups of about ``GROUP``; a group is
    packed by best fit, largest first, then by local search. A group leaves few bins
    underfull, whatever the number of groups.

    Cases: an item of size 0 is placed and takes no room; null ids and sizes have no
    row; of repeated ids the largest size stands; a kind of container without a
    positive capacity holds nothing; the kinds are parameters and few; empty tables give no rows.
    """
    item = items.where("id is not null and tokens is not null").groupBy("id").agg(F.max("tokens").alias("tokens"))
    item = cut(item, "packing-items")
    groups = max(1, -(-item.count() // GROUP))
    kinds = containers.where("container is not null and capacity > 0").select("container", F.col("capacity").cast("int").alias("capacity")).distinct()
    listed = [F.struct(F.lit(r["container"]).alias("container"), F.lit(r["capacity"]).alias("capacity")) for r in kinds.collect()]  # a table of parameters
    if not listed:
        return item.sparkSession.createDataFrame([], _PACKED)
    each = item.select("id", "tokens", F.explode(F.array(*listed)).alias("k")).select("id", "tokens", "k.container", "k.capacity")
    full = F.when(F.col("tokens") > F.col("capacity"), F.floor(F.col("tokens") / F.col("capacity"))).otherwise(F.lit(0)).cast("int")
    each = each.withColumn("n", full)
    whole = each.where("n > 0").select("container", "capacity", "id", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("piece")).select(
        "container", "capacity", F.concat(F.lit("f"), F.col("id").cast("string"), F.lit("-"), F.col("piece").cast("string")).alias("bin"), "id", "piece",
        F.lit(0).alias("position"), F.lit(0).alias("place"), (F.col("piece").cast("long") * F.col("capacity")).alias("start"), F.col("capacity").alias("tokens"),
    )
    rest = each.withColumn("left", F.col("tokens") - F.col("n").cast("long") * F.col("capacity")).where("left > 0 or n = 0").select(
        "container", "capacity", F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int").alias("grp"), "id", F.col("n").alias("piece"),
        (F.col("n").cast("long") * F.col("capacity")).alias("start"), F.col("left").cast("int").alias("tokens"),
    )
    dealt = rest.repartition("container", "grp").sortWithinPartitions("container", "grp", "id")
    return dealt.mapInArrow(_pack, _PACKED).unionByName(whole)
