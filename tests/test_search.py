"""Retrieval against a plain implementation, from texts and from an index."""

import math
import random

import pytest

from autuario.operators import search as S
from autuario.plans.language import Leaf, leaves, parse_advanced

WORDS = ["mora", "prazo", "dano", "bens", "partilha", "usucapião"]
QUERIES = ["mora", "mora OU prazo", "mora prazo dano", '"partilha bens"', "parti*", '("mora prazo" OU dano) E bens', "xilofone", "mora OU xilofone", '"bens parti*"', "..."]


def corpus():
    draw = random.Random(7)
    rows = [(f"d{k:02}", " ".join(draw.choice(WORDS) for _ in range(60 if k % 7 == 0 else draw.randrange(1, 9))), "x") for k in range(40)]
    return [*rows, rows[3], ("n", None, "x"), ("e", "", "x"), ("s", " — ", "x")]


def plain_hits(words, leaf):
    t = leaf.tokens
    if not t:
        return 0
    ok = lambda w, x, last: w.startswith(x) if leaf.prefix and last else w == x
    return sum(all(ok(words[i + k], x, k == len(t) - 1) for k, x in enumerate(t)) for i in range(len(words) - len(t) + 1))


def plain_rank(rows, tree):
    docs = {i: [w.replace("ã", "a") for w in t.split() if w.isalnum()] for i, t, _ in rows if t is not None}
    order = leaves(tree)
    hits = {i: [plain_hits(w, x) for x in order] for i, w in docs.items()}
    n, mean = len(docs), sum(map(len, docs.values())) / len(docs)

    def fits(node, h):
        if isinstance(node, Leaf):
            return h[order.index(node)] > 0
        return (all if node.kind == "and" else any)(fits(p, h) for p in node.parts)

    out = {}
    for i, h in hits.items():
        if fits(tree, h):
            out[i] = sum(
                max(math.log((n - d + 0.5) / (d + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(docs[i]) / mean))
                for k, tf in enumerate(h) for d in [sum(x[k] > 0 for x in hits.values())]
            )
    return out


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index") / "i")
    return S.Index(spark, path).replace(spark.createDataFrame(corpus(), "id string, t string, hits string"), "id", "t")


@pytest.mark.parametrize("query", QUERIES)
def test_scan_and_index_rank_alike(spark, index, query):
    tree = parse_advanced(query)
    want = plain_rank(corpus(), tree)
    df = spark.createDataFrame(corpus(), "id string, t string, hits string")
    for found in (S.ranked(S.measure(df, "id", "t", tree), tree), index.ranked(tree)):
        got = {r["id"]: r["score"] for r in found.collect()}
        assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in want)


def test_vocabulary_counts(spark):
    df = spark.createDataFrame([("a", "x y x É", 1), ("b", "e X", 1), ("b", "e X", 1), ("c", "", 1), ("d", None, 1)], "id string, t string, term int")
    assert sorted((r["term"], r["documents"], r["occurrences"]) for r in S.vocabulary(df, "id", "t").collect()) == [("e", 2, 2), ("x", 2, 3), ("y", 1, 1)]


def test_snippet_is_the_earliest_best_window(spark):
    text = "um dois três " * 10 + "mora quatro prazo " + "cinco " * 20 + "prazo mora"
    df = spark.createDataFrame([("a", text), ("b", ""), ("c", "mora")], "id string, t string")
    got = {r["id"]: (r["first_token"], r["distinct_terms"]) for r in S.snippet(df, "id", "t", leaves(parse_advanced("mora OU praz*")), 4).collect()}
    assert got == {"a": (29, 2), "c": (0, 1)}


def test_nearest_of_each_query_over_several_blocks(spark, rows, monkeypatch):
    from autuario.operators import fusion

    monkeypatch.setattr(fusion, "BLOCK", 7)
    draw = random.Random(8)
    data = [(i, [float(draw.randrange(-2, 3)) for _ in range(4)]) for i in range(40)] + [(40, None), (41, [0.0] * 4), (42, [1.0, 2.0]), (43, [1.0, None, 0.0, 1.0])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    got = fusion.nearest_of_each(df, df.where("vec_id % 5 = 0"), "vec_id", "embedding", 6)
    want = []
    for i, v in data:
        if i % 5 == 0 and v and any(v):
            want += [(i, r["id"]) for r in fusion.nearest(df, "vec_id", "embedding", v, 6).collect()]
    assert rows(got.select("query", "id")) == sorted(want, key=str)


def test_index_with_changed_documents_is_that_of_the_new_texts(spark, rows, tmp_path):
    schema = "id string, t string, hits string"
    index = S.Index(spark, str(tmp_path / "i")).replace(spark.createDataFrame(corpus(), schema), "id", "t")
    changed, gone = [("d01", "mora nova", "x"), ("d02", None, "x"), ("e", "bens", "x"), ("z", "partilha", "x"), ("y", "", "x")], ["d05", "s", "never"]
    index = index.replace(spark.createDataFrame(changed[:2], schema), "id", "t").replace(spark.createDataFrame(changed, schema), "id", "t", spark.createDataFrame([(g,) for g in gone], "id string"))
    left = [r for r in corpus() if r[0] not in {*gone, *(c[0] for c in changed)}] + changed
    want = S.Index(spark, str(tmp_path / "want")).replace(spark.createDataFrame(left, schema), "id", "t")
    for have in (index, index.compact()):
        assert rows(have.rows().select(*want.rows().columns)) == rows(want.rows()) and [have.manifest[k] == want.manifest[k] for k in ("documents", "tokens")] == [True, True]
    assert len(S.Index(spark, str(tmp_path / "i")).manifest["segments"]) == 1 and S.Index(spark, str(tmp_path / "none")).rows().count() == 0


def test_hash_cover_is_the_greedy_one(spark):
    import hashlib

    from autuario.operators.evaluation import hash_cover

    draw = random.Random(9)
    pairs = [(f"d{draw.randrange(40)}", f"k{draw.randrange(25)}") for _ in range(120)] + [(None, "k1"), ("d1", None)]
    seen, chosen = set(), set()
    for doc in sorted({d for d, _ in pairs if d}, key=lambda d: hashlib.sha256(f"s:{d}".encode()).hexdigest()):
        own = {k for d, k in pairs if d == doc and k}
        if own - seen:
            seen |= own
            chosen.add(doc)
    assert {r["document"] for r in hash_cover(spark.createDataFrame(pairs, "d string, k string"), "d", "k", "s").collect()} == chosen
