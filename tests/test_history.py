from datetime import datetime, timedelta

import pytest

from autuario.operators.history import history, snapshot_history

SCHEMA = "id string, hash string, at timestamp, entity_id int, change string"


def t(k):
    return datetime(2025, 1, 1) + timedelta(hours=k)


def brute(rows):
    out, by = [], {}
    for e, h, at, *_ in rows:
        if e is not None and at is not None:
            by.setdefault(e, set()).add((at, h))
    for e, seen in by.items():
        periods = []
        for at, h in sorted(seen, key=lambda x: (x[0], x[1] is not None, x[1] or "")):
            if not periods or periods[-1][0] != h:
                periods.append((h, at))
        for k, (h, at) in enumerate(periods):
            out.append((e, h, at, periods[k + 1][1] if k + 1 < len(periods) else None, "changed" if k else "inserted"))
    return sorted(out, key=str)


@pytest.mark.parametrize("rows_in", [
    [],
    [("a", "x", t(1), 1, "n"), ("a", "x", t(1), 1, "n"), ("a", "y", t(2), 1, "n"), ("a", "x", t(3), 1, "n"), ("b", None, t(1), 1, None), ("b", "z", None, 1, None), (None, "z", t(1), 1, None)],
    [("a", None, t(1), 0, ""), ("a", "x", t(2), 0, ""), ("a", None, t(3), 0, ""), ("a", "q", t(2), 0, "")],
    [("hot", "xyz"[k % 3 if k % 7 else 0], t(k), 0, "") for k in range(300)] + [(f"e{k}", "x" * 5000, t(k), 0, "") for k in range(40)],
])
def test_periods_match_a_plain_walk(spark, rows, rows_in):
    assert rows(history(spark.createDataFrame(rows_in, SCHEMA), "id", "hash", "at")) == brute(rows_in)


def test_deletions_close_periods_and_open_new_ones(spark, rows):
    log = spark.createDataFrame([("a", "x", t(1)), ("a", "x", t(3)), ("a", "y", t(5)), ("b", "z", t(1)), ("c", "z", t(4))], "id string, hash string, at timestamp")
    gone = spark.createDataFrame([("a", t(2)), ("a", t(6)), ("a", t(7)), ("c", t(4)), ("never", t(1)), (None, t(1))], "id string, at timestamp")
    assert rows(history(log, "id", "hash", "at", gone)) == sorted([
        ("a", "x", t(1), t(2), "inserted"), ("a", "x", t(3), t(5), "inserted"), ("a", "y", t(5), t(6), "changed"), ("b", "z", t(1), None, "inserted"), ("c", "z", t(4), None, "inserted"),
    ], key=str)


def test_full_snapshots(spark, rows):
    entries = spark.createDataFrame(
        [("s1", "a", "x"), ("s1", "b", None), ("s1", "c", "q"), ("s1", "c", "p"), ("s1", "c", "p"), ("s2", "a", "y"), ("s2", "b", None), ("s3", "a", "y"), ("s3", "c", "p"), (None, "a", "x"), ("s1", None, "x"), ("other", "a", "x")],
        "snapshot string, entity_id string, content string")
    steps = spark.createDataFrame([("1", None, "s1", 1, "g"), ("2", "s1", "s2", 2, "g"), ("3", "s2", "s3", 3, "g"), ("4", "s3", "none", 4, "g"), ("5", None, "other", 1, "h")], "step string, prev string, next string, at int, series string")
    assert rows(snapshot_history(entries, steps, "series")) == sorted([
        ("g", "a", "x", 1, 2, "inserted"), ("g", "a", "y", 2, 4, "changed"), ("g", "b", None, 1, 3, "inserted"), ("g", "c", "p", 1, 2, "inserted"), ("g", "c", "p", 3, 4, "inserted"), ("h", "a", "x", 1, None, "inserted"),
    ], key=str)
    assert rows(snapshot_history(entries.limit(0), steps, "series")) == []
