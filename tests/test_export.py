from datetime import date

from pyspark.sql import functions as F

from autuario.operators.citations import source_judgments, source_provisions, source_similar
from autuario.operators.export import depot_orphans, differences, export_plan, official, upsert_catalog
from autuario.operators.periods import parts_of, split_period
from autuario.operators.sections import header
from autuario.sources.themes import themes, with_leading_cases


def test_catalog(spark, rows):
    old = spark.createDataFrame([("a", "1", "1"), ("b", "1", "1"), ("c", "1", None)], "id string, f string, applied string")
    listed = spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "1"), ("d", "1")], "id string, f string")
    assert rows(upsert_catalog(old, listed, "id", "f")) == [("a", "1", "1", True, False), ("b", "2", "1", True, True), ("c", "1", None, False, False), ("d", "1", None, True, True)]


def test_export_and_depot(spark, rows):
    now = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "z")], "id string, content string")
    was = now.where("id <> 'c'").select("id", F.sha2("content", 256).alias("sha256")).unionByName(spark.createDataFrame([("d", "0")], "id string, sha256 string"))
    was = was.withColumn("sha256", F.when(F.col("id") == "b", "0").otherwise(F.col("sha256")))
    assert {r["id"]: r["action"] for r in export_plan(now, was).collect()} == {"a": "keep", "b": "replace", "c": "add", "d": "retire"}
    depot, kept = (spark.createDataFrame([(x,) for x in xs], "sha256 string") for xs in (["1", "2"], ["1", None]))
    assert rows(depot_orphans(depot, kept)) == [("2",)]


def test_differences_and_urls(spark, rows):
    df = spark.createDataFrame([("1", "a ação", "a acao"), ("2", "x", "x"), ("3", None, "n"), ("4", None, None)], "id string, a string, b string")
    assert rows(differences(df, "id", "a", "b")) == [("1", 0, "replace", "çã", "ca"), ("3", 0, "insert", "", "n")]
    urls = spark.createDataFrame([("https://www.tj.example/x",), ("http://tj.example",), ("https://nottj.example",), ("no url",), (None,)], "u string")
    assert [r[0] for r in urls.select(official(F.col("u"), ["tj.example"])).collect()] == [True, False, False, False, False]


def test_periods(spark, rows):
    a, b = date(2024, 1, 1), date(2024, 1, 8)
    counts = {date(2024, 1, d): n for d, n in ((1, 3), (2, 9), (5, 1), (8, 2))}
    found = split_period(counts, a, b, 4)
    assert sum(n for *_, n in found) == 15 and all(n <= 4 or s == e for s, e, n in found) and found[0][0] == a and found[-1][1] == b
    df = spark.createDataFrame([(d,) for d, n in counts.items() for _ in range(n)] + [(None,)], "d date")
    assert rows(parts_of(df, "d", 4)) == sorted(found, key=str) and parts_of(df.limit(0), "d", 4).count() == 0


def test_header(spark):
    texts = ["  DIREITO CIVIL.\r\nAPELAÇÃO. PRAZO.\r\nI. CASO EM EXAME\r\n1. x", "CIVIL. MORA\n1. Fato", "CIVIL.\n\nResto", "I. CASO EM EXAME\n1. x", "palavra " * 40, "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i")
    got = [r[0] for r in df.select(header(F.col("t"))).collect()]
    assert got[:4] == ["DIREITO CIVIL.\r\nAPELAÇÃO. PRAZO.", "CIVIL. MORA", "CIVIL.", "I. CASO EM EXAME"] and len(got[4]) <= 120 and got[4].endswith("palavra") and got[5:] == ["", None]


def test_source_fields(spark, rows):
    df = spark.createDataFrame([(
        "d", ["LEG:FED LEI:013105 ANO:2015\n***** CPC-15\nART:00085 PAR:00002 ART:01015", "LEG:FED SUM:****** ANO:****\n***** SUM(STJ) SÚMULA\nSUM:000007", "LEG:FED LEI:009771 ANO:1999\nART:00002A", "LEG:FED CFB:****** ANO:1988\nART:00005", "nada"],
        "STJ - <<AGINT NO ARESP 2345678>>-SC TEMA\nSTF - <<RE 0123>>\n<<ADI 5>>", ["REsp 00123 SP 2020", "ilegível"],
    )], "id string, laws array<string>, cited string, similar array<string>")
    assert {r["chave"] for r in source_provisions(df, "id", "laws").collect()} >= {"CPC:85", "CPC:1015", "STJ:sumula:7", "LEI 9.771/1999:2-A", "CF:5"}
    assert [r["chave"] for r in source_judgments(df, "id", "cited").orderBy("ord").collect()] == ["STJ:AGINT NO ARESP:2345678", "STF:RE:123", "STF:ADI:5"]
    assert [r["chave"] for r in source_similar(df, "id", "similar").orderBy("ord").collect()] == ["STJ:RESP:123", None]


def test_themes(spark):
    rows_in = [(2, "1", "Tema", "1.076", "S", "tese", "q", "O", "d"), (3, "1", "Tema", "1.076", "S", "tese", "q", "O", "d"), (4, "2", "Tema", "5", "S", "a", "q", "O", "d"), (5, "2", "Tema", "5", "S", "b", "q", "O", "d"), (6, "3", "Tema", "x", "S", "a", "q", "O", "d"), (7, "4", "IAC", "1", "S", "a", "q", " ", "d")]
    df = spark.createDataFrame(rows_in, "line int, sequencialPrecedente string, tipoPrecedente string, numeroPrecedente string, situacao string, teseFirmada string, questaoSubmetidaAJulgamento string, orgaoJulgador string, dataPublicacaoAcordao string")
    good, rejects = themes(df)
    assert {r["reason"] for r in rejects.collect()} == {"ambiguous_identity", "invalid_number", "no_organ"}
    cases = spark.createDataFrame([(2, "1", "S", "9", "REsp 1"), (3, "1", "S", "9", "REsp 1"), (4, "1", "N", "8", "REsp 2"), (5, "1", "S", " 7 ", "REsp 3")], "line int, sequencialPrecedente string, leadingCase string, numeroRegistro string, Processo string")
    got = with_leading_cases(good, cases).collect()
    assert [(r["number"], r["line"], r["lines"], [c["registration"] for c in r["cases"]]) for r in got] == [(1076, 2, 2, ["9", "7"])]
