import pytest

from autuario.functions.citing import case_law, filter_key, provisions, recognized, statute_key
from autuario.operators.citations import cited_judgments, cited_provisions, first_occurrences, links, resolve
from autuario.operators.sections import sections

EMENTA = (
    "DIREITO CIVIL. APELAÇÃO.\r\nI. CASO EM EXAME\r\n1. Fato.\r\nII. QUESTÃO EM DISCUSSÃO\r\n2. Ponto.\r\nIII. RAZÕES DE DECIDIR\r\n3. Razão.\r\nIV. DISPOSITIVO E TESE\r\n4. Provido.\r\n"
    "Dispositivos relevantes citados: CPC, arts. 77, § 2º, e 1.003; CC, art. 1.723; Lei n. 9.771/92, art. 4º-B; CF.\r\n"
    "Jurisprudência relevante citada: STJ, AgInt no AREsp 2.345.678/SC, j. 01/02/2022; TJSC, autos n. 5004321-17.2021.8.24.0011; Súmula 83 do STJ; STF, Tema 1.199; STF, Súmula Vinculante 25; IRDR 22; conversa."
)


def test_sections_cover_the_text(spark):
    df = spark.createDataFrame([("a", EMENTA), ("b", "sem títulos"), ("c", EMENTA + "\nCASO EM EXAME\n"), ("d", None), ("e", "")], "id string, t string")
    got = sorted((r for r in sections(df, "id", "t").collect()), key=lambda r: r["start"])
    assert {r["id"] for r in got} == {"a"}
    assert [r["name"] for r in got] == ["cabecalho", "caso_em_exame", "questao_em_discussao", "razoes_de_decidir", "dispositivo_e_tese", "dispositivos_citados", "jurisprudencia_citada"]
    assert "".join(EMENTA[r["start"] : r["end"]] for r in got) == EMENTA and all(r["text"] == EMENTA[r["start"] : r["end"]] for r in got)


def test_judgments(spark):
    df = spark.createDataFrame([("a", EMENTA)], "id string, t string")
    got = [(r["tipo"], r["chave"]) for r in sorted(cited_judgments(df, "id", "t").collect(), key=lambda r: r["ord"])]
    assert got == [
        ("acordao", "STJ:AGINT NO ARESP:2345678"), ("acordao", "TJSC:50043211720218240011"), ("precedente", "STJ:sumula:83"), ("precedente", "STF:tema_repercussao_geral:1199"),
        ("precedente", "STF:sumula_vinculante:25"), ("precedente", "TJSC:irdr:22"), ("acordao", None),
    ]


@pytest.mark.parametrize("item, want", [
    ("STJ, REsp 1.111.222/PR, Tema 77", [("precedente", "STJ:tema_repetitivo:77"), ("acordao", "STJ:RESP:1111222")]),
    ("TJSC, AC 2009.033044-1, j. 05/12/2016", [("acordao", "TJSC:20090330441")]),
    ("STJ, Agravo Interno no Recurso Especial n. 1234567/MG", [("acordao", "STJ:AGINT NO RESP:1234567")]),
    ("STJ, Embargos de Divergência em Agravo em Recurso Especial nº 88.001", [("acordao", "STJ:EARESP:88001")]),
    ("TJ-PR, AI n. 0019876-54.2022.8.16.0000", [("acordao", "TJPR:00198765420228160000")]),
    ("0019876-54.2022.8.24.0000", [("acordao", "TJSC:00198765420228240000")]), ("0019876-54.2022.8.16.0000", [("acordao", None)]),
    ("STF, ADC n. 91", [("acordao", "STF:ADC:91")]), ("Temas 905 e 810 da repercussão geral", [("precedente", "STJ:tema_repetitivo:905"), ("precedente", "STJ:tema_repetitivo:810")]),
    ("Tema RG 810", [("precedente", "STF:tema_repercussao_geral:810")]), ("TJSC, Súmula 34", [("precedente", None)]), ("IRDR n. 5004321-17.2021.8.24.0000", [("precedente", None), ("acordao", "TJSC:50043211720218240000")]),
    ("TEMA(s) 31", [("precedente", "STJ:tema_repetitivo:31")]), ("Enunciado 110 da II Jornada", [("acordao", None)]), ("TRF-4, HC 12", [("acordao", None)]),
])
def test_items(item, want):
    assert [(t, k) for t, k, _ in case_law(item)] == want


@pytest.mark.parametrize("tipo, typed, key", [
    ("precedente", "Tema 1.199", "STJ:tema_repetitivo:1199"), ("precedente", "Súmula 11 do STF", "STF:sumula:11"), ("precedente", "stj:sumula:9", "STJ:sumula:9"), ("precedente", "nada", None), ("precedente", "", None),
    ("dispositivo", "art. 77, § 1º, do CPC", "CPC:77"), ("dispositivo", "CF/88, art. 6º", "CF:6"), ("dispositivo", "Lei n. 9.771/1992", "LEI 9.771/1992:*"), ("dispositivo", "art. 77", None),
    ("acordao", "TJSP, 1000234-00.2020.8.26.0100", "TJSP:10002340020208260100"), ("acordao", "AC 2009.033044-1", "TJSC:20090330441"), ("acordao", "123", None), ("acordao", "REsp 77.123", "STJ:RESP:77123"),
])
def test_filters_are_read_like_texts(tipo, typed, key):
    assert filter_key(tipo, typed) == key


def test_recognized():
    assert recognized("TJPR, REsp 5") == ("acordao_outro", "TJPR:RESP:5") and recognized("AgInt no REsp 5") == ("acordao", "STJ:AGINT NO RESP:5") and recognized("Súmula 5") == ("precedente", "STJ:sumula:5") and recognized("nada") is None


def test_closing_lines_without_sections(spark, rows):
    """Headings that recur leave no sections; the last closing lines count all the same."""
    twice = EMENTA + "\r\nI. CASO EM EXAME\r\nDispositivos relevantes citados: CLT, art. 9.\r\nJurisprudência relevante citada: STJ, HC 5."
    df = spark.createDataFrame([("a", twice), ("b", "Nada. Jurisprudência relevante citada: REsp 8"), ("c", "sem linhas"), ("d", None)], "id string, t string")
    assert rows(cited_judgments(df, "id", "t").select("id", "chave")) == [("a", "STJ:HC:5"), ("b", "STJ:RESP:8")] and rows(cited_provisions(df, "id", "t").select("id", "chave")) == [("a", "CLT:9")]


def test_dispositivo_alone_is_a_heading(spark):
    text = "CIVIL.\nI. CASO EM EXAME\n1. A.\nII. QUESTÃO EM DISCUSSÃO\n2. B.\nIII. RAZÕES DE DECIDIR\n3. C; o dispositivo foi lido.\nDispositivo legal: x\nIV. DISPOSITIVO\n4. D."
    got = {r["name"]: text[r["start"] : r["end"]] for r in sections(spark.createDataFrame([("a", text)], "id string, t string"), "id", "t").collect()}
    assert got["dispositivo_e_tese"] == "IV. DISPOSITIVO\n4. D." and "Dispositivo legal" in got["razoes_de_decidir"] and len(got) == 5


def test_provisions(spark):
    df = spark.createDataFrame([("a", EMENTA)], "id string, t string")
    got = [(r["chave"], r["texto"]) for r in sorted(cited_provisions(df, "id", "t").collect(), key=lambda r: r["ord"])]
    assert got == [("CPC:77", "CPC, art. 77, § 2º"), ("CPC:1003", "CPC, art. 1.003"), ("CC:1723", "CC, art. 1.723"), ("LEI 9.771/1992:4-B", "Lei n. 9.771/92, art. 4º-B"), ("CF:*", "CF")]
    assert provisions("nada") == [(None, "nada")] and provisions("  ") == [] and provisions("CC, arts. 1.723; 1.724, V; CPC/73, § 1º") == [
        ("CC:1723", "CC, art. 1.723"), ("CC:1724", "CC, art. 1.724, V"), (None, "CPC/73, art. § 1º")]


@pytest.mark.parametrize("name, key", [("Código de Processo Civil", "CPC"), ("CPC/73", "CPC/1973"), ("Lei Complementar nº 101/2000", "LC 101/2000"), ("Decreto-Lei 4.657/42", "DL 4.657/1942"), ("ECA", "ECA"), ("Lei 13105/15", "LEI 13.105/2015")])
def test_statutes(name, key):
    assert statute_key(name) == key


def test_resolution_and_links(spark, rows):
    cites = spark.createDataFrame(
        [("A", 1, "acordao", "STJ:RESP:1.0"), ("A", 2, "acordao", "TJSC:7"), ("A", 3, "precedente", "P"), ("A", 4, "acordao", ""), ("A", 5, "similar", "stj:resp:10"), ("B", 1, "acordao", "STJ:RESP:10"), ("C", 1, "acordao", "TJSC:8"), ("C", 1, "acordao", "TJSC:8"), ("C", 2, "acordao", None)],
        "document_id string, ord int, tipo string, chave string",
    )
    documents = spark.createDataFrame([("A", "STJ", "RESP", "10"), ("B", "TJSC", "AI", "7"), ("C", "TJSC", "AI", "7")], "id string, tribunal string, classe string, process string")
    got = resolve(cites, documents, spark.createDataFrame([("P",)], "id string"))
    assert {(r[0], r[1]): (r["resolvido"], r["candidatos"]) for r in got.collect()} == {
        ("A", 1): ("A", None), ("A", 2): (None, ["B", "C"]), ("A", 3): ("P", None), ("A", 4): (None, None), ("A", 5): ("A", None), ("B", 1): ("A", None), ("C", 1): (None, None), ("C", 2): (None, None),
    }
    assert rows(links(got)) == [("A", "B", True), ("A", "C", True), ("B", "A", False)]
    first = first_occurrences(cites.withColumn("texto", cites.tipo))
    assert first.count() == 8


def test_stated_dates_tell_candidates_apart(spark, rows):
    from pyspark.sql import functions as F

    from autuario.operators.citations import singled_out, stated_date, stated_judge

    df = spark.createDataFrame([("REsp 1, rel. Min. Ânia Sá, j. 02/01/2020",), ("j. 31-02-2020",), ("nada",), (None,)], "t string")
    got = [(str(r[0]), r[1]) for r in df.select(stated_date(F.col("t")), stated_judge(F.col("t"))).collect()]
    assert got == [("2020-01-02", "ANIA SA"), ("None", None), ("None", None), ("None", None)]
    asked = spark.createDataFrame([
        (1, "j. 02/01/2020", ["a", "b"]), (2, "sem data", ["a", "b"]), (3, "j. 09/09/2020", ["a"]), (4, "j. 02/01/2020", ["a"]), (5, "x", ["c"]), (6, "j. 02/01/2020", ["a", "d"]), (7, "j. 02/01/2020", ["c", "a"]),
    ], "ref int, texto string, ids array<string>")
    documents = spark.createDataFrame([("a", "2020-01-02"), ("b", "2021-01-02"), ("c", None), ("d", "2020-01-02")], "id string, j string").selectExpr("id", "cast(j as date) judgment")
    assert rows(singled_out(asked, documents)) == [
        (1, "a", "agrees"), (2, None, "ambiguous"), (3, "a", "differs"), (4, "a", "agrees"), (5, "c", "not_stated"), (6, None, "ambiguous"), (7, "a", "agrees"),
    ]
