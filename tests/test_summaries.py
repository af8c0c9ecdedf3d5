from datetime import date

from autuario.sources import summaries as S

LISTING = """<div class="gridSumula"><div class="blocoNumSumula"><span class="numeroSumula">91</span><span class="clsINDE">CANCELADA</span></div>
<div class="blocoVerbete"><span class="ramoSumula">DIREITO CIVIL - POSSE</span> O possuidor responde (sempre) pelo dano. (SÚMULA 91, SEGUNDA SEÇÃO, julgado em 02/03/2011, REPDJe 09/03/2011, DJe 05/03/2011, p. 12)</div></div>
<div class="gridSumula"><span class="numeroSumula">92</span><div class="blocoVerbete">Texto. (TERCEIRA SEÇÃO, julgada em 1/2/1999, DJ 3/2/1999, DJ 4/2/1999)</div></div>
<div class="gridSumula"><span class="numeroSumula">91</span><div class="blocoVerbete">Outro. (CORTE ESPECIAL, julgado em 1/2/1999, DJ 3/2/1999)</div></div>
<div class="gridSumula"><span class="numeroSumula">x</span></div><div class="gridSumula"><span class="numeroSumula">93</span><div class="blocoVerbete">sem referência</div></div>"""
INDEX = '<a href="?base=30&sumula=11">Súmula 7 (cancelada)</a><a href="?base=30&sumula=12">Súmula 8</a><a href="?base=26&sumula=12">Súmula 9</a><a href="x">Súmula 1</a>'
PAGE = '<div><div class="titulo">Súmula {}</div><p>x</p><div class="parCOM"> Enunciado. </div></div><p>Data de publicação do enunciado: DJ de {}</p>'


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), "url string, html string")


def test_listing(spark, rows):
    good, rejects = S.summaries_of_lists(frame(spark, ("u1", LISTING), ("u2", None), ("u3", "")))
    assert rows(good.drop("url")) == [
        ("91", "DIREITO CIVIL - POSSE", "O possuidor responde (sempre) pelo dano.", "SEGUNDA SEÇÃO", date(2011, 3, 5), False, "cancelado"), ("92", "", "Texto.", "TERCEIRA SEÇÃO", None, True, "vigente"),
    ]
    assert rows(rejects.select("number", "problem")) == [("91", "repeated_identity"), ("93", "unexpected_form"), ("x", "invalid_number")]


def test_index_and_pages(spark, rows):
    at = "https://portal/lista?base=30"
    good, rejects = S.summaries_of_index(frame(
        spark, (at, INDEX), (at + "&sumula=11", PAGE.format(7, "05-06-1964")), (at + "&sumula=12", PAGE.format(80, "1-2-1970")), (at + "&sumula=99", PAGE.format(5, "1-2-1970")), ("https://portal/", "x"),
    ))
    assert rows(good.drop("url")) == [("sumula", "7", "Enunciado.", date(1964, 6, 5), False, "cancelado")]
    assert rows(rejects.select("number", "problem")) == [("5", "not_in_index"), ("80", "title_differs")]


def test_form(spark, rows):
    form = '<select name="org[]"><option value="">Todos</option><option value="1ª Câmara">1ª Câmara</option><option>2ª Câmara</option></select><select name="x"><option value="z">z</option></select>'
    known = spark.createDataFrame([("1ª Câmara",), ("9ª Câmara",)], "organ string")
    assert rows(S.organ_registry(frame(spark, ("u", form)), known, "org[]")) == [("1ª Câmara", "known"), ("2ª Câmara", "new"), ("9ª Câmara", "gone")]


def test_labels():
    assert S._label("Súmula Vinculante 9 (cancelada)") == ("9", True, "CANCELADA") and S._label("Súmula 7") == ("7", False, "")
    assert [S._label(x) for x in ("Súmula", "Súmula x", "Tema 7", "Súmula 7 (a) b", "Súmula 7 8", "")] == [None] * 6
