import random

from autuario.operators.orphans import OrphanLedger, corpus_parents, corpus_references
from autuario.operators.skew import counted_keys, left_join_counted, semi_join_counted

REF = "ref_key string, who string, index int"


def frame(spark, keys, schema="ref_key string"):
    return spark.createDataFrame([(k,) for k in keys], schema)


def test_ledger_follows_arrivals_and_deletions(spark, rows):
    draw = random.Random(5)
    ledger = OrphanLedger.empty(spark, spark.createDataFrame([], REF))
    parents, refs = set(), set()
    for _ in range(4):
        new = {(f"k{draw.randrange(12)}", f"d{draw.randrange(30)}", draw.randrange(3)) for _ in range(8)}
        arrived = {f"k{draw.randrange(12)}" for _ in range(3)}
        deleted = {f"k{draw.randrange(12)}" for _ in range(2)}
        ledger = ledger.step(spark.createDataFrame([*new, *new, (None, "d", 1)], REF), frame(spark, arrived), frame(spark, deleted))
        parents = (parents - deleted) | arrived
        refs |= new
        assert rows(ledger.pending) == sorted((r for r in refs if r[0] not in parents), key=str)
        assert rows(ledger.settled) == sorted((r for r in refs if r[0] in parents), key=str)
    assert sum(r["orphans"] for r in ledger.counts("who").collect()) == ledger.pending.count()


def test_empty_steps(spark, rows):
    ledger = OrphanLedger.empty(spark, spark.createDataFrame([], REF)).step(spark.createDataFrame([], REF), frame(spark, []), frame(spark, []))
    assert rows(ledger.pending) == [] and rows(ledger.index) == [] and ledger.step() is ledger


def test_a_step_rewrites_the_buckets_it_touches_only(spark, rows):
    refs = spark.createDataFrame([(f"k{i}", "x", i) for i in range(40)], REF)
    first = OrphanLedger.empty(spark, refs, buckets=16).step(refs, frame(spark, [f"k{i}" for i in range(0, 40, 2)]))
    second = first.step(arrived=frame(spark, ["k1"]))
    assert sum(first.places[b] != second.places[b] for b in first.places) == 1
    assert {(r["ref_key"], r["moved"]) for r in second.keys.collect() if r["moved"] == "resolved"} == {("k1", "resolved")}
    third = second.step(deleted=frame(spark, ["k1"]))
    assert {r["ref_key"] for r in third.keys.where("moved = 'reopened'").collect()} == {"k1"} and rows(third.pending) == rows(first.pending)
    assert rows(third.at(2).pending) == rows(second.pending)  # earlier versions stay readable
    counts = [len(rows(x.snapshot("who").snapshots(x.version))) for x in (first, second, third)]
    assert counts == [1, 1, 1] and rows(third.snapshots(1, 2, 3).select("version", "orphans")) == [(1, 20), (2, 19), (3, 20)]


def test_a_ledger_is_found_again_in_its_folder(spark, rows, tmp_path):
    refs = spark.createDataFrame([("a", "x", 1), ("b", "y", 2)], REF)
    ledger = OrphanLedger.empty(spark, refs, str(tmp_path / "l")).step(refs, tag="one")
    again = OrphanLedger.empty(spark, refs, str(tmp_path / "l"))
    assert (again.version, again.tag) == (1, "one") and rows(again.step(arrived=frame(spark, ["a"])).pending) == [("b", "y", 2)]
    (tmp_path / "l" / ".last.json.crc").unlink()
    (tmp_path / "l" / "last.json").write_text("1")  # the pointer was lost: the manifest counts
    assert OrphanLedger.empty(spark, refs, str(tmp_path / "l")).version == 2


def test_hot_keys_are_matched_where_they_are(spark, rows):
    data = [("hot",)] * 4000 + [(f"k{i}",) for i in range(2000)] + [(None,)]
    df = spark.createDataFrame(data, "key string").selectExpr("key", "monotonically_increasing_id() as i")
    counts = counted_keys(df, "key")
    wanted = counts.where("key = 'hot' or key like 'k1%'")
    got = semi_join_counted(df, wanted, "key", 6000)
    assert got.count() == 4000 + sum(str(i).startswith("1") for i in range(2000))
    answers = counts.selectExpr("key", "n", "concat(key, '!') as v")
    joined = left_join_counted(df, answers, "key", 6000)
    assert joined.count() == 6001 and joined.where("v = concat(key, '!')").count() == 6000


def test_reference_cases(spark, rows):
    citations = spark.createDataFrame([
        ("A", 1, "precedente", "STJ:sumula:1", None), ("A", 2, "precedente", "", "X:1"), ("A", 3, "acordao", "stj:resp:1.234", None), ("A", 4, "acordao", "TJSC:0000001-02.2020.8.24.0001", ""),
        ("A", 5, "acordao", "STF:RE:1", None), ("A", 6, "dispositivo", "CPC:1", None), ("A", 7, "similar", "STJ:RESP:9", "TJSC:1"), ("A", 7, "similar", "STJ:RESP:9", "TJSC:1"), ("A", 8, "acordao", None, None), (None, None, None, None, None),
    ], "document_id string, ord int, tipo string, chave string, resolvido string")
    links = spark.createDataFrame([("A", "TJSC:1"), ("A", "gone"), ("A", "gone"), ("A", None)], "document_id string, cited_id string")
    documents = spark.createDataFrame([("STJ:5", "STJ", "RESP", "1234"), ("TJSC:1", "TJSC", "AI", None), (None, None, None, None)], "id string, tribunal string, classe string, process string")
    precedents = spark.createDataFrame([("STJ:sumula:2",)], "id string")
    ledger = OrphanLedger.first(corpus_references(citations, links), corpus_parents(documents, precedents))
    assert rows(ledger.pending.select("source_field", "ord", "missing_ref")) == sorted([
        ("chave", 1, "STJ:sumula:1"), ("resolvido", 2, "X:1"), ("chave", 4, "TJSC:0000001-02.2020.8.24.0001"), ("resolvido", 4, ""), ("chave", 7, "STJ:RESP:9"), ("cited_id", -1, "gone"),
    ], key=str)


def test_deletion_after_the_first_load_reopens(spark, rows):
    refs = spark.createDataFrame([("a", "x", 1), ("b", "y", 2)], REF)
    ledger = OrphanLedger.first(refs, frame(spark, ["a"])).step(deleted=frame(spark, ["a"]))
    assert rows(ledger.pending) == [("a", "x", 1), ("b", "y", 2)]
    assert rows(ledger.step(arrived=frame(spark, ["b"])).pending) == [("a", "x", 1)]
