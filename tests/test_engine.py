import pytest

from autuario.errors import EngineError
from autuario.plans.engine import Engine

TEXTS = {
    "a": "partilha de bens do casal. mora comprovada", "b": "partilha de bens. partilha de bens", "c": "bens sem partilha " + "outra coisa " * 60, "d": "usucapião de imóvel rural", "e": None,
    "f": "CIVIL. POSSE.\nI. CASO EM EXAME\n1. Um.\nIII. RAZÕES DE DECIDIR\n3. Sim.\nIV. DISPOSITIVO:\n4. Provido.",
}


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("corpus"))
    save = lambda name, rows, schema: spark.createDataFrame(rows, schema).write.parquet(f"{root}/{name}.parquet")
    save("search", [(i, t) for i, t in TEXTS.items()] + [("a", TEXTS["a"])], "id string, ementa string")
    docs = [(k, i, f"{t or ''} " * 30 if i != "e" else None, "STJ" if i < "c" else "TJSC", "PRIMEIRA TURMA", "RESP", str(100 + k), "", f"20{10 + k}-01-01" if i != "b" else None) for k, (i, t) in enumerate(TEXTS.items())]
    spark.createDataFrame(docs, "doc_id long, id string, text string, tribunal string, organ string, classe string, process string, registration string, j string").selectExpr("*", "cast(j as date) judgment", "cast(j as date) publication").drop("j").write.parquet(f"{root}/documents.parquet")
    save("document_details", [("a", "Ministra Ânia", "MINISTRA ANIA"), ("b", None, None)], "id string, relator string, relator_fold string")
    save("document_citations", [("a", 1, "precedente", "STJ:sumula:7", "STJ:sumula:7"), ("b", 1, "acordao", "STJ:RESP:100", "a")], "document_id string, ord int, tipo string, chave string, resolvido string")
    save("citation_links", [("b", "a", False)], "document_id string, cited_id string, ambiguo boolean")
    spark.createDataFrame([("STJ:sumula:7", "STJ", "sumula", "7", "admitido", None), ("STJ:iac:1", "STJ", "iac", "1", "excluido", None)], "id string, tribunal string, species string, numero string, admission string, p string").selectExpr("*", "cast(p as date) publication", "'g' as hash").drop("p").write.parquet(f"{root}/precedents.parquet")
    save("versions", [("a", "h1", "2020-01-01", "{}"), ("a", "h1", "2020-01-02", "{}"), ("a", "h2", "2020-01-03", "{}")], "document_id string, hash string, first_seen string, raw string")
    save("precedent_versions", [
        ("STJ:sumula:7", "g", '{"componentes": {"enunciado": "O prazo de mora", "tese_firmada": "A mora"}}', "2020-01-02"), ("STJ:sumula:7", "f", '{"componentes": {"enunciado": "antigo"}}', "2020-01-01"),
        ("STJ:iac:1", "g", '{"materia": "civil", "componentes": {"modulacao": "prazo"}}', "2020-01-01"),
    ], "id string, hash string, body string, observed string")
    return Engine(spark, root)


def ids(page):
    return [x["id"] for x in page.items]


def test_ranked_pages(engine):
    first = engine.search("partilha de bens", limit=2)
    assert first.total == 3 and len(first.items) == 2 and first.cursor and first.items[0]["present"] == ["partilha", "bens"] and "partilha" in first.items[0]["snippet"]
    rest = engine.search("partilha de bens", limit=2, cursor=first.cursor)
    assert sorted(ids(first) + ids(rest)) == ["a", "b", "c"] and rest.cursor is None
    with pytest.raises(EngineError):
        engine.search("outra", cursor=first.cursor)


def test_expressions_and_order(engine):
    assert engine.search('"partilha de bens"').total == 2
    assert ids(engine.search("partilha OU usuc*", advanced=True, order="newest")) == ["d", "c", "a", "b"]
    wide = engine.search("partilha usucapião", order="oldest")
    assert wide.broadened and wide.total == 4 and wide.terms == {"partilha": 3, "usucapião": 1}


def test_filters(engine):
    assert ids(engine.search("bens", tribunal="stj", judged=("2010-01-01", None))) == ["a"]
    assert ids(engine.search("", relator="ania", order="newest")) == ["a"] and ids(engine.search("", cites="STJ:sumula:7", order="newest")) == ["a"]
    assert ids(engine.search("", cites="Súmula 7 do STJ", order="newest")) == ["a"] and ids(engine.search("", cites_judgment="REsp n. 100/SP", order="newest")) == ["b"] and engine.search("", cites_provision="CPC, art. 9", order="newest").total == 0
    assert ids(engine.search("", citing="a", order="newest")) == ["b"] and ids(engine.search("", cited_by="b", order="newest")) == ["a"] and ids(engine.search("", process="1-0-3", order="newest")) == ["d"]


def test_reasons_for_nothing(engine):
    assert engine.search("xilofone").reason == "no_match" and engine.search("bens", tribunal="STF").reason == "restrictive_filter" and engine.search("bens", judged=("1900-01-01", "1901-01-01")).reason == "outside_coverage"


@pytest.mark.parametrize("params", [{"limit": 0}, {"limit": 99}, {"order": "random"}, {"judged": ("2020-01-01", "2019-01-01")}, {"query": "a OU", "advanced": True}, {"cites": "nada"}, {"published": ("2020-13-01", None)}, {"process": "x"}])
def test_refusals(engine, params):
    with pytest.raises(EngineError):
        engine.search(**({"query": "bens"} | params))


def test_documents_and_precedents(engine):
    n = engine.document("c", size=100)["blocks"]
    assert "".join(engine.document("c", block=k, size=100)["part"] for k in range(n)) == f"{TEXTS['c']} " * 30
    assert engine.document("e")["part"] is None and engine.document("b")["citations"][0]["chave"] == "STJ:RESP:100"
    with pytest.raises(EngineError):
        engine.document("zz")
    assert [x["id"] for x in engine.precedents().items] == ["STJ:sumula:7"] and engine.precedents(admitted=False).total == 2
    assert engine.document("f", component="ementa", section="razoes_de_decidir")["part"].strip() == "III. RAZÕES DE DECIDIR\n3. Sim." and [x["name"] for x in engine.document("f", component="sections")["sections"]] == ["cabecalho", "caso_em_exame", "razoes_de_decidir", "dispositivo_e_tese"]
    assert [(x["content"], x["change"]) for x in engine.document("a", component="history")["history"]] == [("h1", "inserted"), ("h2", "changed")] and engine.document("a", version="h1")["raw"] == "{}"
    for bad in ({"component": "x"}, {"version": "h9"}, {"component": "ementa", "section": "x"}, {"block": 99}):
        with pytest.raises(EngineError):
            engine.document("a", **bad)
    assert {(r["tribunal"], r["n"]) for r in engine.coverage().collect()} == {("STJ", 2), ("TJSC", 4)}


def test_precedents_by_text(engine):
    found = engine.precedents("prazo mora")
    assert [(x["id"], x["fields"]) for x in found.items] == [("STJ:sumula:7", "enunciado|tese_firmada")] and found.items[0]["score"] > 0
    assert engine.precedents("prazo", field="modulacao", admitted=False).items[0]["id"] == "STJ:iac:1" and engine.precedents("prazo", field="modulacao").reason == "no_match"
    assert engine.precedents("mora", species="iac").reason == "restrictive_filter" and engine.precedents("xilofone").reason == "no_match"
    assert engine.precedents(matter="civil", admitted=False).total == 1 and engine.precedents(withdrawn=["STJ:sumula:7:g"]).total == 0
    first = engine.precedents(admitted=False, limit=1)
    assert first.total == 2 and engine.precedents(admitted=False, limit=1, cursor=first.cursor).cursor is None
    for bad in ({"field": "x"}, {"limit": 0}, {"published": ("ontem", None)}):
        with pytest.raises(EngineError):
            engine.precedents("prazo", **bad)
    assert {(r["id"], r["state"]) for r in engine.catalogued(["STJ:sumula:7", "STJ:iac:1", "x"]).collect()} == {("STJ:sumula:7", "admitted"), ("STJ:iac:1", "known"), ("x", "absent")}


def test_references(engine):
    got = engine.check_references(["STJ, REsp 100/SP, rel. Min. Ânia, Segunda Turma, j. 1/1/2010", "Súmula 7 do STJ", "REsp 999", "conversa", "TJSP, REsp 100"])
    assert [(x["state"], x["resolvido"]) for x in got] == [("held", "a"), ("held", "STJ:sumula:7"), ("not_held", None), ("unread", None), ("other_court", None)]
    assert (got[0]["date"], got[0]["judge"], got[0]["organ"]) == ("agrees", "agrees", "differs")
    with pytest.raises(EngineError):
        engine.check_references([])


def test_commands(engine, spark, capsys):
    import json

    from autuario.__main__ import main

    assert main([engine.root, "search", "usucapião", "--limit", "2"]) == 0
    assert json.loads(capsys.readouterr().out)["items"][0]["id"] == "d"
    assert main([engine.root, "document", "a"]) == 0 and json.loads(capsys.readouterr().out)["judgment"] == "2010-01-01"
    assert main([engine.root, "coverage"]) == 0 and len(json.loads(capsys.readouterr().out)) == 2
    assert main([engine.root, "check", "REsp 100"]) == 0 and json.loads(capsys.readouterr().out)[0]["state"] == "held"
    assert main([engine.root, "precedents", "prazo"]) == 0 and json.loads(capsys.readouterr().out)["items"][0]["id"] == "STJ:sumula:7"
    assert main([engine.root, "index", f"{engine.root}/index"]) == 0 and json.loads(capsys.readouterr().out)["documents"] == 5 and engine.search("usucapião").total == 1
    assert main([engine.root, "publish", f"{engine.root}-releases"]) == 0 and main([f"{engine.root}-reader", "install", f"{engine.root}-releases"]) == 0 and capsys.readouterr().out
    assert main([engine.root, "search", "x OU", "--advanced"]) == 1 and json.loads(capsys.readouterr().out)["error"] == "consulta_invalida"
