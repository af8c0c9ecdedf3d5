import random
import re
from itertools import combinations

import numpy as np
import pytest

from autuario.llm import near
from autuario.llm.darts import signatures
from autuario.llm.near import near_groups, near_pairs, plan_bands
from autuario.llm.words import sequence_hashes, shingle_hashes, word_hashes

SCHEMA = "id string, ementa string, h int, text int"


def corpus(seed=1, families=12, each=6):
    draw = random.Random(seed)
    vocabulary = [f"palavra{i}" for i in range(400)] + ["ação", "É"]
    rows = []
    for f in range(families):
        base = [draw.choice(vocabulary) for _ in range(draw.randrange(8, 120))]
        for k in range(each):
            words = list(base)
            for _ in range(k):
                words[draw.randrange(len(words))] = draw.choice(vocabulary)
            if k == 4:
                del words[: len(words) // 5]
            rows.append((f"d{f}-{k}", ", ".join(words).upper() if k % 2 else " ".join(words), 0, 0))
    return rows


def brute(rows, threshold, size):
    sets, keys = {}, {}
    for i, t, *_ in rows:
        if i is not None and t is not None:
            w = re.findall(r"[^\W_]+", t.lower())
            if len(w) >= size:
                sets.setdefault(i, set(zip(*(w[k:] for k in range(size)))))
                keys[i] = "".join(w)
    return {(a, b) for a, b in combinations(sorted(sets), 2) if keys[a] != keys[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= threshold}


@pytest.mark.parametrize("threshold, size", [(0.6, 3), (0.8, 5), (0.4, 2)])
def test_pairs_match_brute_force(spark, threshold, size):
    rows = corpus()
    rows += [rows[0], ("null", None, 0, 0), ("empty", "", 0, 0), ("blank", " \r\n", 0, 0), ("one", "palavra", 0, 0), (None, rows[0][1], 0, 0), ("copy", rows[0][1].replace(" ", "  "), 0, 0)]
    want = brute(rows, threshold, size)
    got = {(r["id_a"], r["id_b"]) for r in near_pairs(spark.createDataFrame(rows, SCHEMA), "id", "ementa", threshold, size).collect()}
    assert not got - want
    assert len(want - got) <= 0.02 * len(want), want - got


def test_long_runs_are_joined_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(near, "RUN", 7)
    monkeypatch.setattr(near, "CHUNK", 5)
    rows = corpus(2, 2, 40)
    want = brute(rows, 0.6, 3)
    got = {(r["id_a"], r["id_b"]) for r in near_pairs(spark.createDataFrame(rows, SCHEMA), "id", "ementa", 0.6, 3).collect()}
    assert not got - want and len(want - got) <= 0.02 * len(want)


def test_many_candidates_are_shuffled(spark, monkeypatch):
    monkeypatch.setattr(near, "BROADCAST_IDS", 1)
    rows = corpus(4, 4, 5)
    got = {(r["id_a"], r["id_b"]) for r in near_pairs(spark.createDataFrame(rows, SCHEMA), "id", "ementa", 0.6, 3).collect()}
    assert got == brute(rows, 0.6, 3)


def test_groups_are_connected_components(spark):
    rows = corpus(3)
    pairs = brute(rows, 0.6, 3)
    parent = {r[0]: r[0] for r in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    got = {r["id"]: r["group_id"] for r in near_groups(spark.createDataFrame(rows, SCHEMA), "id", "ementa", 0.6, 3).collect()}
    assert got == {i: root(i) for i in parent}


def test_an_id_with_two_texts_ties_their_groups(spark):
    draw = random.Random(9)
    a, b = ([f"w{draw.randrange(900)}" for _ in range(60)] for _ in "ab")
    rows = [("a", " ".join(a)), ("m", " ".join(["x", *a[1:]])), ("m", " ".join(b)), ("z", " ".join([*b[:-1], "y"])), ("q", "sem par algum aqui")]
    got = {r["id"]: r["group_id"] for r in near_groups(spark.createDataFrame([(*r, 0, 0) for r in rows], SCHEMA), "id", "ementa", 0.6, 3).collect()}
    assert got == {"a": "a", "m": "a", "z": "a", "q": "q"}


def test_a_band_that_most_rows_share(spark):
    """Rows of one band key over many partitions meet all the same, once each."""
    draw = np.random.default_rng(1)
    n = 5000
    bits = draw.integers(-(2**62), 2**62, (n, 2))
    bits[1::2] = bits[::2] ^ 1  # pairs one bit apart
    rows = [(f"d{i}", i + 1, [7] if i % 3 else [7, i // 2 + 100], int(bits[i, 0]), int(bits[i, 1])) for i in range(n)]
    signed = spark.createDataFrame(rows, near._SIGNED).repartition(3)
    got = sorted((r["ha"], r["hb"]) for r in near.candidates(signed, 120).collect())
    assert got == [(i + 1, i + 2) for i in range(0, n, 2)]


def test_groups_are_whole_or_an_error(spark):
    df = spark.createDataFrame(corpus(3), SCHEMA)
    with pytest.raises(RuntimeError, match="still move"):
        near_groups(df, "id", "ementa", 0.6, 3, max_rounds=1)


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert near_pairs(df, "id", "ementa", 0.6, 3).collect() == [] and near_groups(df, "id", "ementa", 0.6, 3).collect() == []


def test_words_are_runs_of_letters_and_digits():
    texts = ["Ação 12,3 — não_sei", None, "", "x" * 5000 + " é", "ação 12 3 NÃO sei"]
    doc, word = word_hashes(texts)
    assert np.bincount(doc, minlength=5).tolist() == [5, 0, 0, 2, 5]
    h = sequence_hashes(doc, word, 5)
    assert h[0] == h[4] != h[3] and h[1] == h[2] == 0
    assert len(shingle_hashes(doc, word, 3)[0]) == 6


def test_weighted_signatures_estimate_weighted_jaccard():
    draw = np.random.default_rng(1)
    element = np.arange(300, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(7)
    a, b = draw.gamma(2.0, 1.0, 300), draw.gamma(2.0, 1.0, 300)
    b[:200] = a[:200] * draw.uniform(0.7, 1.3, 200)
    doc = np.repeat([0, 1], 300)
    sig = signatures(doc, np.concatenate([element, element]), np.concatenate([a, b]), 2, 2000)
    assert abs((sig[0] == sig[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.04


def test_signatures_of_small_and_empty_sets():
    sig = signatures(np.array([0, 2, 2]), np.array([5, 5, 9], np.uint64), None, 3, 64)
    assert len(set(sig[1].tolist())) == 1 and (sig[0] == sig[2]).mean() > 0.2
    assert plan_bands(0.6)[1] == 4
