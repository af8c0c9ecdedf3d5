"""Sections of a summary by their headings, as offsets into the original text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from autuario.functions.text import folded
from autuario.runtime import spread

# The headings, folded, and the section each opens.
HEADINGS = {
    "CASO EM EXAME": "caso_em_exame",
    "HIPOTESE EM EXAME": "caso_em_exame",
    "QUESTAO EM DISCUSSAO": "questao_em_discussao",
    "RAZOES DE DECIDIR": "razoes_de_decidir",
    "DISPOSITIVO E TESE": "dispositivo_e_tese",
    "TESE DE JULGAMENTO": "tese_na_ementa",
    "DISPOSITIVOS RELEVANTES CITADOS": "dispositivos_citados",
    "JURISPRUDENCIA RELEVANTE CITADA": "jurisprudencia_citada",
    "DISPOSITIVO": "dispositivo_e_tese",
}
_ACCENTS = {"A": "[AÁÀÂÃaáàâã]", "E": "[EÉÊeéê]", "I": "[IÍií]", "O": "[OÓÔÕoóôõ]", "U": "[UÚuú]"}
def _any_case(title: str) -> str:
    return "".join(_ACCENTS.get(c, f"[{c}{c.lower()}]" if c.isalpha() else c) for c in title)


#: This one is a heading only alone in its line, and with a capital.
_ALONE = "D" + _any_case("ISPOSITIVO")
_TITLES = "|".join(_any_case(t) for t in HEADINGS if t != "DISPOSITIVO")
#: A heading fills the start of a line, perhaps after a Roman number, and ends with a sign or the line.
HEADING = rf"(?m)^([ \t]*([IVXivx]+[ \t]*[.:–-][ \t]*)?(({_TITLES})[ \t]*([:.–-]|\r?$)|{_ALONE}[ \t]*[:.–-]?[ \t]*\r?$))"
MARK = "\x01"


def parts(text: Column) -> Column:
    """The text cut before each heading; the first part is what comes before all."""
    return F.split(F.regexp_replace(text, HEADING, MARK + "$1"), MARK)


def _listed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, text, p, n, digest, divided``: the parts of each text, their names, and whether they are its sections."""
    named = F.transform("p", lambda x, i: F.when(i == 0, "cabecalho").otherwise(
        F.regexp_extract(folded(F.substring(F.ltrim(x), 1, 60)), "(" + "|".join(HEADINGS) + ")", 1)))
    texts = spread(df.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "id")
    cut = texts.select("id", "text", parts(F.col("text")).alias("p"), F.sha2("text", 256).alias("digest"))
    titles = F.create_map(*[x for k, v in HEADINGS.items() for x in (F.lit(k), F.lit(v))])
    found = cut.withColumn("n", F.transform(named, lambda x: F.coalesce(titles[x], x)))
    return found.withColumn("divided", (F.size("p") > 1) & (F.size(F.array_distinct("n")) == F.size("n")))


def sections(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, name, start, end, digest``: the sections of each text, with code point offsets.

    A text without headings, and one in which a heading recurs, has none. Works
    within the row: no shuffle and no Python.
    """
    listed = _listed(df, id_col, text_col).where("divided")
    each = listed.select("id", "digest", "p", F.posexplode("n").alias("i", "name"))
    start = F.aggregate(F.slice("p", 1, F.col("i")), F.lit(0), lambda a, x: a + F.length(x))
    spans = each.select("id", "name", start.alias("start"), F.element_at("p", F.col("i") + 1).alias("text"), "digest")
    return spans.where("name <> 'cabecalho' or trim(text) <> ''").select("id", "name", "start", (F.col("start") + F.length("text")).alias("end"), "digest", "text")


CLOSING = {"dispositivos_citados": "dispositivos relevantes citados", "jurisprudencia_citada": "jurisprud[eê]ncia relevante citada"}


def closing_lines(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, name, text``: the two closing lines, without their labels.

    They are those sections, where the text is divided into sections and has one of them; else
    each line's last occurrence, up to the other one's label at the start of a line.
    """
    label = "|".join(CLOSING.values())
    own = _listed(df, id_col, text_col).select("id", "text", F.filter(F.arrays_zip("n", "p"), lambda x: F.col("divided") & x["n"].isin(*CLOSING)).alias("own"))
    last = []
    for name, words in CLOSING.items():
        rest = F.regexp_extract("text", rf"(?isu)^.*({words}\s*[:.].*)$", 1)
        line = F.regexp_extract(rest, rf"(?isu)^(.+?)(?:\r?\n\s*(?:{label}).*)?$", 1)
        last.append(F.struct(F.lit(name).alias("n"), F.when(line != "", line).alias("p")))
    found = own.select("id", F.explode(F.when(F.size("own") > 0, F.col("own")).otherwise(F.array(*last))).alias("x")).where("x.p is not null")
    return found.select("id", F.col("x.n").alias("name"), F.regexp_replace("x.p", rf"(?iu)^\s*(?:{label})\s*[:.]?\s*", "").alias("text"))


def header(text: Column, size: int = 120) -> Column:
    """The lines before the first section, numbered paragraph or blank line, at most ``size`` characters at a word's end.

    A text that opens with one of these is stood for by its first line.
    """
    from autuario.functions.text import cut_at_word

    lines = F.split(F.regexp_replace(text, r"^\s+", ""), "\n")
    ends = F.transform(lines, lambda x: F.regexp(x, F.lit(r"^\s*$")) | F.regexp(x, F.lit(r"^\s*([0-9]{1,3}|[IVX]{1,5})\s*[.)–-]")) | F.regexp(x, F.lit(HEADING)))
    before = F.array_position(ends, True) - 1  # -1: no line ends it
    kept = F.slice(lines, 1, F.when(before < 0, F.size(lines)).otherwise(F.greatest(before, F.lit(1))).cast("int"))
    return F.rtrim(cut_at_word(F.regexp_replace(F.array_join(kept, "\n"), r"\s+$", ""), size))
