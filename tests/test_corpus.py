import json
import zipfile

import pytest

from autuario.errors import EngineError
from autuario.operators.evaluation import averaged, bootstrap, per_query
from autuario.operators.ingest import Corpus
from autuario.operators.publish import KEEP, manifest, open_generation, publish, verify
from autuario.sources.files import merged, read_csv, read_numbers, read_originals
from autuario.sources.pages import cards, parse_page, stable
from autuario.sources.records import array_items, parsed, read_batches, stream_items, wanted
from autuario.streaming import streams


def record(id_, text="t", **more):
    return {"id": id_, "ementa": text, "nomeOrgaoJulgador": "O", "numeroProcesso": f"n{id_}", "siglaClasse": "RESP", "dataDecisao": "20240101"} | more


def test_batches_from_files_and_archives(spark, tmp_path, rows):
    (tmp_path / "20240101.json").write_text("﻿" + json.dumps([record("1"), record("2", ""), record("3", dataDecisao="2024")]))
    (tmp_path / "20240201.json").write_text("[{")
    with zipfile.ZipFile(tmp_path / "old.zip", "w") as z:
        z.writestr("b.json", json.dumps([record("1", "novo")]))
        z.writestr("a.json", json.dumps([record("1", "velho"), record("4")]))
    (tmp_path / "bad.zip").write_bytes(b"no archive")
    found = read_batches(spark, str(tmp_path))
    assert found.where("problem = 'unreadable'").count() == 2 and found.where("record is not null").count() == 6
    p = parsed(found)
    assert sorted((r["position"], r["reason"]) for r in p.where("reason is not null").collect()) == [(1, "no_text"), (2, "illegible_date")]
    got = wanted(p.where("member <> ''"), spark.createDataFrame([("1",), ("9",)], "number string")).collect()
    assert [(r["document_id"], r["member"], r["conflict"]) for r in got] == [("STJ:1", "b.json", True)]
    assert list(array_items(' [ {"a": [1, "]"]} , 2 ] ')) == ['{"a": [1, "]"]}', "2"] and list(array_items("[]")) == []


def delivery(spark, *pairs):
    return spark.createDataFrame([(d, h, "{}", 1) for d, h in pairs], "document_id string, hash string, raw string, rank_key int")


def test_ingestion_is_idempotent_and_ranked(spark, rows):
    corpus, n = Corpus.empty(spark).ingest("r2", "2024", delivery(spark, ("A", "2"), ("B", "1")), "2024-01-02")
    assert n == {"new": 2, "changed": 0, "unchanged": 0, "removed": 0}
    corpus, n = corpus.ingest("r2", "2024", delivery(spark, ("A", "2"), ("B", "1"), ("B", "1")), "2024-01-03")
    assert n["unchanged"] == 2 and corpus.versions.count() == 2
    corpus, n = corpus.ingest("r1", "2023", delivery(spark, ("A", "1"), ("C", "1")), "2024-01-04")  # late: older rank
    assert n == {"new": 1, "changed": 0, "unchanged": 1, "removed": 0}
    assert rows(corpus.documents) == [("A", "r2", "2"), ("B", "r2", "1"), ("C", "r1", "1")]
    corpus, n = corpus.ingest("r2", "2024", delivery(spark, ("B", "3")), "2024-01-05")  # replaced: A falls back, B changes
    assert n == {"new": 0, "changed": 2, "unchanged": 0, "removed": 0} and rows(corpus.documents)[0] == ("A", "r1", "1")
    corpus, n = corpus.ingest("r1", "2023", delivery(spark), "2024-01-06")
    assert n["removed"] == 2 and corpus.versions.count() == 5 and corpus.revision == 5
    with pytest.raises(EngineError):
        corpus.ingest("r3", "2025", delivery(spark, ("A", "1"), ("A", "2")), "2024-01-07")


def test_generations(spark, tmp_path, rows):
    root = str(tmp_path / "gen")
    df = spark.createDataFrame([("a", 1), ("b", None)], "id string, n int")
    with pytest.raises(EngineError):
        open_generation(spark, root)
    names = [publish(spark, root, {"t": df.withColumn("k", df.n + i), "u": df.select("n")}) for i in range(KEEP + 2)]
    held = [g["id"] for g in manifest(spark, root)]
    assert held == names[::-1][:KEEP] and not (tmp_path / "gen" / names[0]).exists()
    assert rows(open_generation(spark, root, withdrawn=["a"])["t"]) == [("b", None, None)]
    assert rows(open_generation(spark, root, held[1])["t"])[0] == ("a", 1, KEEP + 1) and verify(spark, root, held[0]) == []
    df.limit(1).write.mode("overwrite").parquet(f"{root}/{held[0]}/t")
    assert verify(spark, root, held[0]) == ["t"]
    with pytest.raises(EngineError):
        open_generation(spark, root, "r0")


PAGE = '<input id="hdnTotalResultado" value="2"><div class="resultadoItem" id="resultado7"><span class="resLabel">ÓRGÃO JULGADOR:</span><span class="resValue">1ª <b>Câmara</b><br>Civil</span><p class="resLabel">Processo</p><p class="resValue">1 &amp; 2</p></div><div class="resultadoItem x" id="resultado8"></div>'


def test_pages(spark):
    total, found = parse_page(PAGE)
    assert total == 2 and found == [("7", {"ÓRGÃO JULGADOR": "1ª Câmara\nCivil", "PROCESSO": "1 & 2"}), ("8", {})]
    df = spark.createDataFrame([("1", PAGE), ("2", PAGE), ("3", "<html>blocked"), ("4", None)], "p string, h string")
    got = cards(df, "p", "h")
    assert got.count() == 6 and got.where("id is null").count() == 2
    assert stable(got.where("page <= '2'")).first()["complete"] is True and stable(got).first()["totals"] == 1


def test_lists_csv_and_originals(spark, tmp_path, rows):
    (tmp_path / "n.txt").write_text("﻿# list\n5011469-46.2023.8.24.0000\n\n 1779343 \n1779343\n")
    assert rows(merged(read_numbers(spark, str(tmp_path / "n.txt"))).select("number", "court")) == [("1779343", "STJ"), ("50114694620238240000", "TJSC")]
    (tmp_path / "t.csv").write_text('﻿a,b\n1,"x\ny"\n2,""\n3,"q""q"\n')
    assert rows(read_csv(spark, str(tmp_path / "t.csv")).select("line", "a", "b")) == [(2, "1", "x\ny"), (3, "2", None), (4, "3", 'q"q')]
    folder = tmp_path / "o"
    folder.mkdir()
    (folder / "f").write_bytes(b"abc")
    (folder / "g").write_bytes(b"new")
    import hashlib

    sha = hashlib.sha256(b"abc").hexdigest()
    receipts = spark.createDataFrame([("u", sha, "1"), ("u2", sha, "2"), ("v", "0" * 64, "1"), ("v", "1" * 64, "1")], "url string, sha256 string, obtained string")
    got = {(r["state"], r["url"], r["ambiguous"]) for r in read_originals(spark, str(folder), receipts).collect()}
    assert got == {("verified", "u2", False), ("unreceipted", None, False), ("lost", "v", True)}


def test_measures(spark):
    df = spark.createDataFrame([("q1", 1, 0), ("q1", 2, 2), ("q1", 3, 1), ("q2", 1, 1), ("q3", 1, 0)], "q string, r int, g int")
    got = averaged(per_query(df, "q", "r", "g", 2)).first()
    assert (got["queries"], got["hit"], got["recall"], got["mrr"]) == (2, 1.0, 0.75, 0.75)
    import math

    assert got["ndcg"] == round((3 / math.log2(3) / (3 + 1 / math.log2(3)) + 1) / 2, 6)
    low, high = bootstrap([0.0, 1.0] * 50)
    assert 0.38 < low < 0.5 < high < 0.62 and bootstrap([0.5]) == (0.5, 0.5)


def test_streams(spark, tmp_path, rows):
    for k in range(3):
        spark.createDataFrame([("d1", f"r{k}", f"h{k}", f"{2 - k}"), (f"d2{k}", "r", "h", "0")], "document_id string, resource_id string, hash string, rank_key string").coalesce(1).write.mode("append").parquet(str(tmp_path / "s"))
    got = streams.latest_stream(spark, streams.table_stream(spark, str(tmp_path / "s"), 1))
    assert rows(got)[0] == ("d1", "r0", "h0") and got.count() == 4


def test_fusion(spark):
    from pyspark.sql import functions as F

    from autuario.operators.fusion import nearest, reciprocal_ranks

    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 1.0]), (3, [0.0, 0.0]), (4, None), (5, [2.0, 0.0]), (6, [1.0])], "id long, v array<float>")
    assert [r["id"] for r in nearest(vectors, "id", "v", [1.0, 0.0], 3).collect()] == [1, 5, 2]
    a, b = (spark.createDataFrame(x, "id string, s double") for x in ([("x", 3.0), ("y", 2.0)], [("y", 9.0), ("z", 1.0)]))
    got = reciprocal_ranks([(a, F.col("s").desc(), 1.0), (b, F.col("s").desc(), 1.0)], 5).collect()
    assert [r["id"] for r in got] == ["y", "x", "z"] and abs(got[0]["score"] - (1 / 62 + 1 / 61)) < 1e-12


def test_streams_go_on_where_they_stopped(spark, tmp_path, rows):
    """Late parents and deletions between two runs; nothing that a run has read is read again; empty streams give empty tables."""
    from autuario.operators.orphans import OrphanLedger

    refs = "ref_key string, who string"
    source, folder, state = str(tmp_path / "refs"), str(tmp_path / "stream"), str(tmp_path / "state")
    like = spark.createDataFrame([], refs)
    like.write.parquet(source)
    keys = lambda *k: spark.createDataFrame([(x,) for x in k], "ref_key string")
    run = lambda ledger: streams.orphan_stream(spark, streams.table_stream(spark, source, 1), ledger, folder)
    ledger = run(OrphanLedger.empty(spark, like, state).step(arrived=keys("a")))
    assert rows(ledger.pending) == []
    spark.createDataFrame([("a", "x"), ("b", "y")], refs).coalesce(1).write.mode("append").parquet(source)
    ledger = run(OrphanLedger.empty(spark, like, state))
    assert rows(ledger.pending) == [("b", "y")]
    ledger.step(arrived=keys("b")).step(deleted=keys("a"))
    spark.createDataFrame([("a", "z"), ("c", "y")], refs).coalesce(1).write.mode("append").parquet(source)
    ledger = run(OrphanLedger.empty(spark, like, state))
    assert rows(ledger.pending) == [("a", "x"), ("a", "z"), ("c", "y")] and rows(ledger.settled) == [("b", "y")]
    assert rows(run(OrphanLedger.empty(spark, like, state)).pending) == rows(ledger.pending)

    events = str(tmp_path / "events")
    spark.createDataFrame([], "ts timestamp, kind string").write.parquet(events)
    count = lambda: rows(streams.write_daily_counts(spark, streams.table_stream(spark, events, 1), "ts", "kind", folder=str(tmp_path / "daily")).select("kind", "n"))
    assert count() == []
    for n in (2, 3):
        spark.sql("select timestamp'2024-01-05 10:00:00' as ts, 'k' as kind").crossJoin(spark.range(n)).drop("id").coalesce(1).write.mode("append").parquet(events)
        got = count()
    assert got == [("k", 5)]
    observed = str(tmp_path / "observed")
    spark.createDataFrame([], "document_id string, resource_id string, hash string, rank_key string").write.parquet(observed)
    assert rows(streams.latest_stream(spark, streams.table_stream(spark, observed))) == []


ITEMS = ['{"a": "x]}\\\\\\"{,", "b": [1, {"c": 2}]}', "2", '"t,]"', "null", "[]"]


@pytest.mark.parametrize("size", [1, 2, 3, 7, 1000])
def test_arrays_are_read_in_pieces(size):
    text = " [ " + " ,\n".join(ITEMS) + " ] \n"
    assert list(stream_items(text[k : k + size] for k in range(0, len(text), size))) == ITEMS
    for bad in ("", "[1", "[1] 2", "{}", "x", '["a', "[1]]"):
        with pytest.raises(ValueError):
            list(stream_items(bad[k : k + size] for k in range(0, len(bad), size)))


def test_files_without_the_numbers_are_skipped(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([record("1", numeroProcesso="77123"), record("2", numeroProcesso="5")]))
    (tmp_path / "b.json").write_text("[{ not read, as it has no such number")
    got = read_batches(spark, str(tmp_path), ["77123"]).collect()
    assert [(r["position"], r["problem"]) for r in got] == [(0, None)]


def test_keeping(spark, tmp_path, rows):
    import hashlib

    from autuario.operators import keeping as K

    store = str(tmp_path / "store")
    path = K.save_original(spark, store, b"conte\xfado")
    assert K.save_original(spark, store, b"conte\xfado") == path and path.endswith(hashlib.sha256(b"conte\xfado").hexdigest())
    log = K.RunLog(spark, str(tmp_path / "runs"))
    log.start("stj", "2024-01-01")

    def work(r):
        if r == "b":
            raise OSError("gone")
        if r == "stop":
            raise KeyError(r)

    assert log.each("stj", ["a", "b", "c"], work)["state"] == "partial" and log.each("x", ["a", "stop", "c"], work, (KeyError,))["state"] == "error" and log.each("y", ["a"], work)["state"] == "ok"
    assert sorted(r["state"] for r in log.runs().collect()) == ["error", "interrupted", "ok", "partial"]
    df = spark.createDataFrame([("a", 1), ("b", 2)], "id string, n int")
    root, depot = str(tmp_path / "gen"), str(tmp_path / "depot")
    one = publish(spark, root, {"t": df, "u": df.limit(1)})
    K.backup(spark, root, depot, "first")
    two = publish(spark, root, {"t": df, "u": df.limit(0)})
    K.backup(spark, root, depot, "second")
    assert len(list((tmp_path / "depot" / "tables").glob("[!.]*"))) == 3  # table t is there once
    assert K.restore(spark, depot, "first", str(tmp_path / "back")) == one and rows(open_generation(spark, str(tmp_path / "back"))["u"]) == [("a", 1)]
    assert K.install(spark, root, str(tmp_path / "reader")) == two == K.install(spark, root, str(tmp_path / "reader"))
    gone = K.prune_depot(spark, depot, ["second"])
    assert len(gone) == 2 and rows(open_generation(spark, str(tmp_path / "reader"))["t"]) == [("a", 1), ("b", 2)]
    with pytest.raises(EngineError):
        K.restore(spark, depot, "first", root)
    body = '{"x": 1}'
    good = {"id": "P:1", "tribunal": "STJ", "species": "tema", "numero": "1", "organ": None, "publication": "2020-01-02", "hash": hashlib.sha256(body.encode()).hexdigest(), "body": body}
    lines = [good, good | {"id": "P:2", "hash": "x"}, good | {"id": "P:3", "numero": " "}, good | {"id": "P:4", "publication": "ontem"}, good | {"id": "P:5"}, good | {"id": "P:5"}]
    (tmp_path / "package.json").write_text("\n".join(map(json.dumps, lines)) + "\n{")
    records, problems = K.read_package(spark, str(tmp_path / "package.json"))
    assert [r["id"] for r in records.collect()] == ["P:1"] and sorted(r["reason"] for r in problems.collect()) == ["hash_differs", "illegible", "illegible_date", "no_numero", "repeated_id", "repeated_id"]


def test_review(spark, rows):
    from autuario.operators import review as R

    ids = spark.createDataFrame([(f"d{k}",) for k in range(300)] + [(None,), ("d1",)], "id string")
    first = R.review_sample(ids, "id", "s")
    assert first.count() == 15 and R.review_sample(ids.limit(40), "id", "s").count() == 10 and R.review_sample(ids.limit(0), "id", "s").count() == 0
    assert R.review_sample(ids, "id", "s", first).join(first, "id").count() == 0
    said = first.select("id", (first.id != first.first()["id"]).alias("approved"))
    verdict = lambda r, least: tuple(R.review_verdict(first, r, least).first())
    assert verdict(said, 1.0) == (15, 15, 14, False) and verdict(said, 0.9) == (15, 15, 14, True) and verdict(said.limit(3), 0.1)[3] is False
    a = spark.createDataFrame([("1", "a b", 1), ("2", "x", 1), ("3", "x", 1)], "id string, t string, n int")
    b = spark.createDataFrame([("1", "ab ", 1), ("2", "y", 1), ("4", "x", 1)], "id string, t string, n int")
    assert rows(R.reread(a, b, "id", ["t", "n"])) == [("1", "blanks"), ("2", "differs"), ("3", "missing"), ("4", "new")] and rows(R.reread(a, a, "id", ["t"])) == [("1", "same"), ("2", "same"), ("3", "same")]
    assert R.unequal(a, a).count() == 0 and sorted(r["side"] for r in R.unequal(a, a.limit(2)).collect()) == ["left"]
    text = spark.createDataFrame([("a", "CIVIL. AgInt no AREsp 2.345.678/SC. Tema 77. Posse mansa."), ("b", "Súmula 83"), ("c", None)], "id string, t string")
    assert rows(R.without_citations(text, "id", "t")) == [("a", "CIVIL. Posse mansa.")]


def test_settings(tmp_path):
    from autuario.config import load

    (tmp_path / "c.toml").write_text('root = "/a"\npage = 5\n')
    file = str(tmp_path / "c.toml")
    assert load({"page": 9}, {"AUTUARIO_ROOT": "/b"}, file).root == "/b" and load({"page": 9}, {"AUTUARIO_PAGE": "7"}, file).page == 9 and load({}, {}, file).page == 5 and load({}, {}).page == 8
    for bad in ("page = 99", "pages = 1", 'page = "x"'):
        (tmp_path / "c.toml").write_text(bad)
        with pytest.raises(EngineError):
            load({}, {}, file)
