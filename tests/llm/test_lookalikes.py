import unicodedata
from types import SimpleNamespace

import pytest
from hypothesis import given
from hypothesis import strategies as st

from autuario.llm.lookalikes import lookalikes_of, ordinary, scripts, unusual, use


@pytest.mark.parametrize("text", [
    "", "plain text", "ação, é, ÇÃO ª º § ° ² ½ ‰ … √ │ £ € “x” ‘y’ – —", "ΔΟΜΟΣ", "грузополучатель", "β", "東港", "Żelewska-Nový", "linha\r\noutra\tcoluna", "√(a² + b²)", "µ", "1.076",
])
def test_ordinary_text_stays(text):
    assert ordinary(text) == text


@pytest.mark.parametrize("text, want", [
    ("Ζélia Морaтrondі", "Zélia Mopatrondi"), ("Ноnоrárіоѕ", "Honorários"), ("Ｒ＄ ４０７，７２", "R$ 407,72"), ("ﬁadora", "fiadora"), ("a b c　d", "a b c d"),
    ("D​I­R⁠EITO﻿", "DIREITO"), ("água", "água"), ("САЅО", "CASO"), ("boa‑fé", "boa-fé"), ("𝐝𝐚𝐧𝐨", "dano"), ("sеja е não", "seja e não"), ("٣", "3"), ("Ⅳ", "IV"),
])
def test_look_alikes_are_mended(text, want):
    assert ordinary(text) == want


@given(st.text(max_size=80))
def test_mending_is_stable(text):
    once = ordinary(text)
    assert ordinary(once) == once


@given(st.text(alphabet="abcdeáéíõç ,.\n", max_size=60))
def test_decomposing_is_undone(text):
    assert ordinary(unicodedata.normalize("NFD", text)) == text


@pytest.fixture(scope="module")
def more(spark):
    use(lookalikes_of(spark))
    yield
    use({})


@pytest.mark.parametrize("text, want", [
    ("Ꭱecurso", "Recurso"), ("Ⲣrazo", "Prazo"), ("ꓑrazo", "Prazo"), ("ᴀcórdão", "acórdão"), ("ɡato", "gato"), ("НЕТ ВОЙНЕ", "НЕТ ВОЙНЕ"), ("ᏣᎳᎩ", "ᏣᎳᎩ"), ("νόσος", "νόσος"), ("[ɡ]", "[ɡ]"), ("ação à Ω 東", "ação à Ω 東"),
])
def test_letters_of_many_scripts(more, text, want):
    assert ordinary(text) == want and ordinary(want) == want


def test_script_sets():
    assert scripts("a") == {"LATIN"} and scripts("1") is None and "Jpan" in scripts("東") and "Jpan" in scripts("か")


def test_unusual(spark, rows):
    data = [("1", "limpo", 0), ("2", "ﬁm", 0), ("2", "ﬁm", 0), ("3", None, 0), ("4", "", 0), (None, "ﬁm", 0), ("5", "x" * 100_000 + "​", 0), ("6", "ΔΟΜΟΣ", 0)]
    df = spark.createDataFrame(data, "id string, t string, normal int")
    assert rows(unusual(df, "id", "t")) == [("2", "ﬁm", "fim"), ("5", "x" * 100_000 + "​", "x" * 100_000)]
    assert rows(unusual(df.limit(0), "id", "t")) == []


def _icu(skeleton):
    """A session whose ICU gives these skeletons."""
    checker = SimpleNamespace(getSkeleton=skeleton)
    text = SimpleNamespace(SpoofChecker=SimpleNamespace(Builder=lambda: SimpleNamespace(build=lambda: checker)))
    return SimpleNamespace(_jvm=SimpleNamespace(com=SimpleNamespace(ibm=SimpleNamespace(icu=SimpleNamespace(text=text)))))


def _fails(text):
    raise OSError("the gateway is gone")


@pytest.mark.parametrize("session", [
    lambda spark: SimpleNamespace(), lambda spark: SimpleNamespace(_jvm=SimpleNamespace(com=spark._jvm.com.absent)), lambda spark: _icu(_fails),
    lambda spark: _icu(lambda text: text.rpartition("\n")[0]), lambda spark: _icu(lambda text: ""),
], ids=["no JVM", "no ICU", "failing ICU", "a skeleton too few", "no skeletons"])
def test_a_failing_icu_is_an_error(spark, monkeypatch, session):
    df, made = spark.createDataFrame([("1", "Ꭱecurso")], "id string, t string"), session(spark)
    with pytest.raises(RuntimeError, match="ICU"):
        lookalikes_of(made)
    made._sc = spark._sc
    monkeypatch.setattr(type(df), "sparkSession", property(lambda _: made))
    with pytest.raises(RuntimeError, match="ICU"):
        unusual(df, "id", "t")


def test_letters_of_many_scripts_are_found(spark, rows):
    df = spark.createDataFrame([("1", "Ꭱecurso"), ("2", "Recurso")], "id string, t string")
    assert rows(unusual(df, "id", "t")) == [("1", "Ꭱecurso", "Recurso")]
