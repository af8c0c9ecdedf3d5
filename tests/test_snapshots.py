import random

import pytest

from autuario.operators import snapshots
from autuario.operators.snapshots import snapshot_changes

ENTRY, STEP = "snapshot string, key string, hash string, change int", "pair long, prev string, next string"


def brute(entries, steps):
    held = {}
    for s, k, h, *_ in entries:
        if s is not None and k is not None:
            d = held.setdefault(s, {})
            d[k] = (h is not None, h)
    out = []
    for pair, a, b in steps:
        x, y = held.get(a, {}), held.get(b, {})
        out += [(pair, b, k, "added" if k not in x else "removed" if k not in y else "changed") for k in x.keys() | y.keys() if x.get(k) != y.get(k)]
    return sorted(out, key=str)


def snapshots_of(n, change, seed):
    draw = random.Random(seed)
    state = {f"k{i}": f"h{i}" for i in range(n)}
    rows = []
    for s in range(3):
        rows += [(f"s{s}", k, h, 0) for k, h in state.items()]
        for k in list(state):
            x = draw.random()
            if x < change / 3:
                del state[k]
            elif x < change:
                state[k] = f"n{draw.random()}"
        for i in range(int(n * change / 3)):
            state[f"new{s}-{i}"] = "x"
    return rows


STEPS = [(1, "s0", "s1"), (2, "s1", "s2")]


@pytest.mark.parametrize("entries", [
    [],
    [("s0", "a", "1", 0), ("s0", "a", "1", 0), ("s1", "a", "1", 0), ("s1", "b", None, 0), ("s2", "b", "", 0), (None, "c", "1", 0), ("s2", None, "1", 0)],
    [("s0", "a", "1", 0)],
    [("s1", "k" * 20000, "1", 0), ("s2", "k" * 20000, "2", 0)],
    snapshots_of(3000, 0.05, 1),
    snapshots_of(800, 0.9, 2),
])
def test_changes_match_sets(spark, rows, entries):
    assert rows(snapshot_changes(spark.createDataFrame(entries, ENTRY), spark.createDataFrame(STEPS, STEP))) == brute(entries, STEPS)


def test_failed_buckets_are_enlarged(spark, rows, monkeypatch):
    monkeypatch.setattr(snapshots, "FIRST_SHARE", 0.001)
    monkeypatch.setattr(snapshots, "LEAST_CELLS", 3)
    entries = snapshots_of(1500, 0.6, 3)
    assert rows(snapshot_changes(spark.createDataFrame(entries, ENTRY), spark.createDataFrame(STEPS, STEP))) == brute(entries, STEPS)
