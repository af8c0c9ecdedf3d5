"""Functions on process numbers, dates, laws and references, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from autuario.functions.text import digits


def source_date(col: Column) -> Column:
    """A date as the sources write it (yyyyMMdd), null if illegible."""
    return F.try_to_date(col, "yyyyMMdd")


def single_publication(col: Column) -> Column:
    """The publication date of a notice, null unless it names exactly one."""
    found = F.array_distinct(F.regexp_extract_all(col, F.lit(r"(\d{2}/\d{2}/\d{4})"), 1))
    return F.when(F.size(found) == 1, F.try_to_date(found[0], "dd/MM/yyyy"))


def local_date(col: Column, zone: str = "America/Sao_Paulo") -> Column:
    """The calendar date of an instant in UTC, in a zone."""
    return F.to_date(F.from_utc_timestamp(col, zone))


def cnj_number(col: Column) -> Column:
    """Twenty digits in the national form NNNNNNN-DD.AAAA.J.TR.OOOO, else null."""
    d = digits(col)
    return F.when(F.length(d) == 20, F.regexp_replace(d, r"^(\d{7})(\d{2})(\d{4})(\d)(\d{2})(\d{4})$", "$1-$2.$3.$4.$5.$6"))


def cnj_check(col: Column) -> Column:
    """The two check digits that a national number should have (97 less the rest of base 97), null if it isn't one."""
    d = digits(col)
    base = F.concat(F.substring(d, 1, 7), F.substring(d, 10, 11), F.lit("00"))
    rest = F.when(F.length(d) == 20, base.cast("decimal(38,0)") % F.lit(97).cast("decimal(38,0)"))
    return F.lpad((F.lit(98) - rest).cast("int").cast("string"), 2, "0")


def court_of_number(col: Column) -> Column:
    """The court that a process number's shape tells: segment and court of a national number, STJ for up to nine digits."""
    d = digits(col)
    code = F.substring(d, 14, 3)
    return (
        F.when((F.length(d) == 20) & (code == "824"), "TJSC").when((F.length(d) == 20) & (F.substring(d, 14, 1) == "8"), "TJ" )
        .when(F.length(d) == 20, "OUTRO").when(F.length(d).between(1, 9), "STJ")
    )


def class_family(col: Column) -> Column:
    """The class under all appeals within it: the part after the last NO or NA."""
    return F.element_at(F.split(F.upper(F.trim(col)), r"\s+N[OA]S?\s+"), -1)


def law_number(col: Column) -> Column:
    """A number with a dot at the thousands."""
    d = digits(col)
    return F.when(d != "", F.regexp_replace(F.regexp_replace(d, "^0+(?=.)", ""), r"(?<=\d)(?=(\d{3})+$)", "."))


def single_number(col: Column) -> Column:
    """The number that a label such as "Tema 1.076" names; null for none, zero or several."""
    found = F.regexp_extract_all(F.regexp_replace(col, r"(?<=\d)\.(?=\d{3})", ""), F.lit(r"(\d+)"), 1)
    n = F.when(F.size(found) == 1, found[0].cast("long"))
    return F.when(n > 0, n)


def reference(tribunal: Column, classe: Column, process: Column, organ: Column, relator: Column, judgment: Column, publication: Column) -> Column:
    """A citation in words, each missing part said to be missing."""
    date = lambda c: F.date_format(c, "dd/MM/yyyy")
    part = lambda label, c: F.concat(F.lit(label), F.coalesce(c, F.lit("[não informado]")))
    return F.concat_ws(
        ", ", F.coalesce(tribunal, F.lit("[não informado]")), F.concat_ws(" n. ", F.coalesce(classe, F.lit("[não informado]")), F.coalesce(process, F.lit("[não informado]"))),
        part("rel. ", F.when(F.trim(relator) != "", relator)), F.coalesce(organ, F.lit("[não informado]")), part("j. ", date(judgment)), part("pub. ", date(publication)),
    )


def missing_parts(**parts: Column) -> Column:
    """The names of the parts that are null or blank, in order."""
    return F.array_compact(F.array(*[F.when(c.isNull() | (F.trim(c.cast("string")) == ""), F.lit(n)) for n, c in parts.items()]))
