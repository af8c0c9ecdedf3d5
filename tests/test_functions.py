import unicodedata
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from autuario.functions import legal as L
from autuario.functions import text as T


def values(spark, data, make):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(data)], "i int, x string")
    return [r["y"] for r in df.select("i", make(F.col("x")).alias("y")).orderBy("i").collect()]


def test_fold_matches_unicode(spark):
    data = ["Ação 10ª Câmara", "é", "ﬁm" if False else "ÀÉÎÕÜ ç ñ ž", None, "", "ß", "ΔΟΜΟΣ"]
    plain = lambda s: "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c)).upper()
    assert values(spark, data, T.folded) == [None if s is None else plain(s) for s in data]


def test_tokens(spark):
    data = ["Ação, 12-3: PÓS_grad é!", "", "  ", None, "ΔΟΜΟΣ"]
    assert values(spark, data, T.tokens) == [["acao", "12", "3", "pos", "grad", "e"], [], [], None, ["δομοσ"]]
    assert [T.token_literal(s) for s in data if s] == [["acao", "12", "3", "pos", "grad", "e"], [], ["δομοσ"]]


def test_small_text_functions(spark):
    assert values(spark, ["Ação: É!", "—", None], T.plain) == ["ACAO E", "", None]
    keys = values(spark, ["Ação É", "ACAO-E", "...", None], T.text_key)
    assert keys[0] == keys[1] is not None and keys[2] is None and keys[3] is None
    assert values(spark, ["1ª Câmara de Direito"], T.slug) == ["1a-camara-de-direito"] or values(spark, ["Camara de  Direito!"], T.slug) == ["camara-de-direito"]
    assert values(spark, ["um dois três", "umdoistres", "um", None], lambda c: T.cut_at_word(c, 7)) == ["um dois", "umdoist", "um", None]
    df = spark.createDataFrame([("a b", "ab\n"), ("a", "b"), (None, None)], "a string, b string")
    assert [r[0] for r in df.select(T.same_but_blanks(F.col("a"), F.col("b"))).collect()] == [True, False, True]


def test_dates(spark):
    assert values(spark, ["20240229", "20230229", "x", None], L.source_date) == [date(2024, 2, 29), None, None, None]
    assert values(spark, ["DJEN DATA:01/02/2024", "01/02/2024 01/02/2024", "01/02/2024 e 02/02/2024", ""], L.single_publication) == [date(2024, 2, 1), date(2024, 2, 1), None, None]
    df = spark.createDataFrame([(datetime(2025, 1, 1, 2, 0),)], "t timestamp")
    assert df.select(L.local_date(F.col("t"))).first()[0] == date(2024, 12, 31)


def test_numbers(spark):
    good = "5004321-17.2021.8.24.0011"
    digits = "".join(c for c in good if c.isdigit())
    check = 98 - int(digits[:7] + digits[9:] + "00") % 97
    assert values(spark, [good, "123", None], L.cnj_check) == [f"{check:02}", None, None]
    assert values(spark, [digits, "12"], L.cnj_number) == [good, None]
    assert values(spark, [digits, digits[:13] + "826" + digits[16:], "1234567", ""], L.court_of_number) == ["TJSC", "TJ", "STJ", None]
    assert values(spark, ["12604", "008069", "", "1.234.567"], L.law_number) == ["12.604", "8.069", None, "1.234.567"]
    assert values(spark, ["Tema 1.076", "Tema 0", "1 e 2", "nada"], L.single_number) == [1076, None, None, None]
    assert values(spark, ["AgInt no AREsp", "RESP", "EDcl nos EDcl na Rcl"], L.class_family) == ["ARESP", "RESP", "RCL"]


@pytest.mark.parametrize("missing", [True, False])
def test_reference(spark, missing):
    row = ("STJ", "RESP", "1", None if missing else "T", "", date(2020, 1, 2), None)
    df = spark.createDataFrame([row], "a string, b string, c string, d string, e string, f date, g date")
    text = df.select(L.reference(*[F.col(c) for c in "abcdefg"])).first()[0]
    assert text.startswith("STJ, RESP n. 1, rel. [não informado]") and "j. 02/01/2020" in text and text.endswith("pub. [não informado]") and ("[não informado], j." in text) == missing


def test_cells_envelopes_and_stems(spark):
    assert values(spark, ["Direito Civil; ;Direito Civil\nPosse", "", None], T.branches) == [["Direito Civil", "Posse"], [], None]
    texts = ["ação " * 40, "", None]
    assert values(spark, texts, lambda c: T.opened(T.enveloped(c))) == texts and values(spark, ["a"], T.enveloped) == ["YQ=="] and values(spark, ["%"], T.opened) == [None]
    assert [T.number_text(x) for x in (12, "12 ", 12.0, 1.5, True, None, "")] == ["12", "12", "12", None, None, None, None]
    df = spark.createDataFrame([(["prorrogacao", "prorrogacoes", "casas", "casa", "lei", "decadencial"],)], "w array<string>")
    assert df.select(T.stems(F.col("w"))).first()[0] == ["prorrog", "prorrog", "cas", "cas", "lei", "decadencial"]
