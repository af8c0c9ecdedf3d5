"""Variant spellings of people's names, linked by a noisy channel.

Frequent, complete spellings are candidate true forms. A spelling is attached to the
candidate with the largest posterior: the candidate's frequency times the likelihood
that a clerk turns the true form into the spelling by abbreviating, dropping,
mistyping or replacing parts by familiar forms.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import count
from math import log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from autuario.llm.lookalikes import ordinary
from autuario.runtime import cut

# What stands around a name, within it, and after it.
TITLES = frozenset(
    "MIN MINISTRO MINISTRA DES DESA DESEMBARGADOR DESEMBARGADORA JUIZ JUIZA DR DRA DOUTOR DOUTORA SUBST SUBSTITUTO SUBSTITUTA "
    "CONV CONVOCADO CONVOCADA EXMO EXMA SR SRA SENHOR SENHORA PROF PROFESSOR PROFESSORA REL RELATOR RELATORA FED FEDERAL PRES PRESIDENTE".split()
)
PARTICLES = frozenset("DE DA DO DOS DAS E DI DEL VON VAN D".split())
SUFFIXES = {"JUNIOR": "JUNIOR", "JR": "JUNIOR", "JOR": "JUNIOR", "FILHO": "FILHO", "FO": "FILHO", "NETO": "NETO", "NETTO": "NETO", "SOBRINHO": "SOBRINHO"}
# Familiar forms of given names.
NICKNAMES = {
    "ADRI": "ADRIANA", "DRI": "ADRIANA", "DRICA": "ADRIANA", "AFONSINHO": "AFONSO", "FONSO": "AFONSO", "LILI": "ALICE", "ALVINHO": "ALVARO", "VAVA": "ALVARO",
    "MANDA": "AMANDA", "MANDINHA": "AMANDA", "SELMO": "ANSELMO", "TONINHO": "ANTONIO", "TONHO": "ANTONIO", "TONICO": "ANTONIO", "TONI": "ANTONIO",
    "BIA": "BEATRIZ", "BEBEL": "ISABEL", "BENE": "BENICIO", "BENI": "BENICIO", "CAITO": "CAIO", "CANDINHA": "CANDIDA", "CICA": "CECILIA", "CECI": "CECILIA",
    "CISSA": "CECILIA", "CESINHA": "CESAR", "CESINHO": "CESAR", "CLA": "CLARICE", "CLARINHA": "CLARICE", "CLAUDINHO": "CLAUDIO", "CACAU": "CLAUDIO",
    "DALVINHA": "DALVA", "DALVITA": "DALVA", "DAVIZINHO": "DAVI", "DEB": "DEBORA", "DEBI": "DEBORA", "DEBINHA": "DEBORA", "DU": "EDUARDO", "DUDU": "EDUARDO",
    "EDU": "EDUARDO", "DUDA": "EDUARDO", "MUNDO": "EDMUNDO", "MUNDINHO": "EDMUNDO", "LISA": "ELISA", "LILA": "ELISA", "MILA": "EMILIA", "EMI": "EMILIA",
    "FABI": "FABIANA", "NANDO": "FERNANDO", "FLAVINHA": "FLAVIA", "FLA": "FLAVIA", "CHICO": "FRANCISCO", "CHIQUINHO": "FRANCISCO", "KIKO": "FRANCISCO",
    "PACO": "FRANCISCO", "GABI": "GABRIELA", "BIELA": "GABRIELA", "GE": "GERALDO", "GERALDINHO": "GERALDO", "GLORINHA": "GLORIA", "HEITORZINHO": "HEITOR",
    "TOTO": "HEITOR", "LENA": "HELENA", "LENINHA": "HELENA", "NACIO": "INACIO", "INACINHO": "INACIO", "INESITA": "INES", "NENE": "INES", "BEL": "ISABEL",
    "ISA": "ISABEL", "BELINHA": "ISABEL", "IVINHO": "IVO", "VIVO": "IVO", "QUIM": "JOAQUIM", "QUINCAS": "JOAQUIM", "JOCA": "JOAQUIM", "ZE": "JOSE", "ZECA": "JOSE",
    "ZEZINHO": "JOSE", "JUCA": "JOSE", "JU": "JULIA", "JUJU": "JULIA", "JULINHA": "JULIA", "KATINHA": "KATIA", "KA": "KATIA", "LAURINHA": "LAURA", "LALA": "LAURA",
    "LEO": "LEONARDO", "LEOZINHO": "LEONARDO", "NARDO": "LEONARDO", "GIA": "LIGIA", "LUISINHO": "LUIS", "LULA": "LUIS", "LULU": "LUIS", "LUCINHA": "LUCIA",
    "MANE": "MANUEL", "MANECO": "MANUEL", "NECO": "MANUEL", "MARCINHA": "MARCIA", "MA": "MARIA", "MONI": "MONICA", "NICA": "MONICA", "NATA": "NATALIA", "NATI": "NATALIA",
    "TALIA": "NATALIA", "NELSINHO": "NELSON", "LIVINHA": "OLIVIA", "LIVIA": "OLIVIA", "OLI": "OLIVIA", "TAVINHO": "OTAVIO", "TAVIO": "OTAVIO", "PATI": "PATRICIA", "TICIA": "PATRICIA",
    "TITA": "PATRICIA", "PLININHO": "PLINIO", "QUITA": "QUITERIA", "RAFA": "RAFAEL", "FAEL": "RAFAEL", "RO": "ROSANGELA", "ROSINHA": "ROSANGELA", "ZANGELA": "ROSANGELA",
    "SERGINHO": "SERGIO", "SIL": "SILVIA", "SILVINHA": "SILVIA", "TECA": "TERESA", "TETE": "TERESA", "TEREZINHA": "TERESA", "TOM": "TOMAS", "TOMASINHO": "TOMAS",
    "SULA": "URSULA", "VICENTINHO": "VICENTE", "CENTINHO": "VICENTE", "ZELINHA": "ZELIA", "ZEZE": "ZELIA",
}
#: Log-likelihoods of what a clerk may do.
INITIAL, ABBREVIATED, FAMILIAR, DROPPED, MISTYPED, SOUNDALIKE, TO_ANOTHER_NAME = -1.5, -2.5, -2.5, -2.0, -3.5, -3.0, -7.0
#: Least log-likelihood for a spelling to be attached at all.
LEAST = -9.5
#: Likelihood of a familiar form that a rule makes (a diminutive, a name's beginning or end), not the list.
FAMILIAR_BY_RULE = -4.0
#: A block of more forms is paired in parts by many tasks.
BLOCK = 2000
#: A token met beside so many last names is a name in its own right.
COMMON = 4

_BLANK = re.compile(r"[\s.]+")


@dataclass(frozen=True)
class Name:
    """Parts of a name in natural order, without titles and particles; abbreviated ones end in a dot."""

    parts: tuple[str, ...]
    suffix: str

    @property
    def key(self) -> str:
        return " ".join(self.parts) + "|" + self.suffix


def _plain(text: str) -> str:
    text = unicodedata.normalize("NFKD", ordinary(text))
    return "".join(c for c in text if not unicodedata.combining(c)).upper()


def _tokens(text: str) -> list[str]:
    """Tokens without surrounding signs; a dot inside or after a token becomes one at its end."""
    out = []
    for raw in re.split(r"[\s\-/]+", text):
        for t in re.findall(r"[^\s,;()]+", raw):
            bare = re.sub(r"[^\w]", "", t)
            dotted = "." in t
            if not bare:
                continue
            if dotted and re.fullmatch(r"(\w\.){2,}", t):
                out += [c + "." for c in bare]
            else:
                out.append(bare + "." * (dotted or len(bare) == 1))
    return out


def _without_titles(tokens: list[str]) -> list[str]:
    k = 0
    while k < len(tokens) and tokens[k].rstrip(".") in TITLES and len(tokens[k].rstrip(".")) > 1:
        k += 1
    return tokens[k:]


def parse(spelling: str) -> Name | None:
    """The name in a spelling, None where there is none."""
    text = re.sub(r"\([^)]*\)?", " ", _plain(spelling))
    text = re.split(r"\s[-–—]\s", text)[0] if re.search(r"\w", re.split(r"\s[-–—]\s", text)[0]) else text
    sides = [_without_titles(_tokens(s)) for s in text.split(",")]
    sides = [s for s in sides if s]
    if not sides:
        return None
    if len(sides) > 1 and not all(t.rstrip(".") in SUFFIXES for t in sides[1]):
        tokens = sides[1] + sides[0] + [t for s in sides[2:] for t in s]
    else:
        tokens = [t for s in sides for t in s]
    kept = [t for t in tokens if t not in PARTICLES]
    suffix = ""
    while len(kept) > 1 and (found := _suffix(kept[-1])):
        suffix = suffix or found
        kept.pop()
    if len(sides) > 1 and not suffix:  # surnames first: a suffix may end the first side
        n = len([t for t in sides[1] if t not in PARTICLES])
        if len(kept) > n >= 1 and (found := _suffix(kept[n - 1])) and n > 1:
            suffix = found
            kept.pop(n - 1)
    return Name(tuple(kept), suffix) if kept else None


def _suffix(token: str) -> str:
    bare = token.rstrip(".")
    if bare in SUFFIXES and (len(bare) > 2 or bare == "JR" or token.endswith(".")):
        return SUFFIXES[bare]
    if len(bare) >= 5 and one_edit(bare, "JUNIOR"):
        return "JUNIOR"
    return ""


def one_edit(a: str, b: str) -> bool:
    """Whether one insertion, deletion, substitution or exchange of neighbours turns a into b."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    i = 0
    while i < len(a) and i < len(b) and a[i] == b[i]:
        i += 1
    x, y = a[i:], b[i:]
    return x[1:] == y[1:] or x[1:] == y or x == y[1:] or (len(x) > 1 and len(y) > 1 and x[0] == y[1] and x[1] == y[0] and x[2:] == y[2:])


@lru_cache(65536)
def sound(token: str) -> str:
    """Letters of a token as they sound in Portuguese; C counts as S, since folding takes the cedilla."""
    t = re.sub(r"PH", "F", token)
    t = re.sub(r"^H|(?<=[^CLNS])H", "", t)
    t = re.sub(r"QU(?=[EI])", "K", t)
    t = t.translate(str.maketrans("YWZC", "IVSS"))
    t = re.sub(r"XS(?=[EI])", "S", t)
    t = re.sub(r"G(?=[EI])", "J", t)
    return re.sub(r"(.)\1+", r"\1", t)


def _abbreviates(short: str, full: str) -> bool:
    """Whether the letters of an abbreviation are some of the name's, in order, from its first."""
    bare = short.rstrip(".")
    if not bare or bare[0] != full[0] or len(bare) >= len(full):
        return False
    rest = iter(full)
    return all(c in rest for c in bare)


def _familiar(a: str, b: str) -> bool:
    return NICKNAMES.get(a) == b or NICKNAMES.get(b) == a or (NICKNAMES.get(a) is not None and NICKNAMES.get(a) == NICKNAMES.get(b))


_DIMINUTIVE = re.compile(r"(.+?)(?:ZINH|INH|IT|ZIT)([OA])$")


def _made_familiar(said: str, true: str) -> bool:
    """Whether a familiar form is made from a given name: a diminutive of it, its beginning or its end."""
    if len(said) >= 4 and len(true) - len(said) >= 2 and (true.startswith(said) or true.endswith(said)):
        return True
    small = _DIMINUTIVE.fullmatch(said)
    if not small or len(small[1]) < 3:
        return False
    stem = true[:-1] if true[-1] in "AEO" else true
    return small[1] in (true, stem)


def part_cost(said: str, true: str, common: bool, given: bool) -> float | None:
    """Log-likelihood of one part being written so, None if it can't be."""
    if said == true:
        return 0.0
    if said.endswith("."):
        if true.endswith("."):
            return None if len(true) > 2 or not said.startswith(true[0]) else ABBREVIATED
        return (INITIAL if len(said) == 2 else ABBREVIATED) if _abbreviates(said, true) else None
    if true.endswith("."):
        return None
    if given and _familiar(said, true):
        return FAMILIAR
    if given and not common and _made_familiar(said, true):
        return FAMILIAR_BY_RULE
    if len(said) <= 3 and len(true) > len(said) + 1 and said[-1] == true[-1] and _abbreviates(said, true):
        return ABBREVIATED
    if len(said) >= 3 and len(true) >= 3:
        if sound(said) == sound(true):
            return SOUNDALIKE
        if one_edit(said, true):
            return TO_ANOTHER_NAME if common else MISTYPED
    return None


def likelihood(said: tuple[str, ...], true: tuple[str, ...], common: tuple[bool, ...]) -> float | None:
    """Log-likelihood that a true form is written so; ``common`` says which written parts are names in their own right."""
    if len(said) > len(true) or len(said) < 2:
        return None if said != true else 0.0
    first = part_cost(said[0], true[0], common[0], True)
    last = part_cost(said[-1], true[-1], common[-1], False)
    if first is None or last is None or true[-1].endswith("."):
        return None
    total = first + last
    middle, inner, flags = said[1:-1], true[1:-1], common[1:-1]
    best = [0.0] + [None] * len(middle)  # best[k]: the first k written parts are placed
    for t in inner:
        new = [None if b is None else b + DROPPED for b in best]
        for k, (m, c) in enumerate(zip(middle, flags)):
            if best[k] is not None and (cost := part_cost(m, t, c, False)) is not None and (new[k + 1] is None or best[k] + cost > new[k + 1]):
                new[k + 1] = best[k] + cost
        best = new
    return None if best[-1] is None else total + best[-1]


def block_keys(parts: tuple[str, ...]) -> list[str]:
    """Keys of which two forms share one if their last parts are at most one edit apart, or
    sound alike, and their given parts can stand for each other."""
    last, given = parts[-1], parts[0].rstrip(".")
    letters = {given[0], *given[1:2]} | {n[0] for n, g in NICKNAMES.items() if g == given}
    if given in NICKNAMES:
        letters |= {NICKNAMES[given][0]} | {n[0] for n, g in NICKNAMES.items() if g == NICKNAMES[given]}
    if len(given) >= 6:  # a longer name's end may stand for it
        letters |= {given[-5], given[-4]}
    ends = {last, "~" + sound(last)} | {last[:i] + last[i + 1 :] for i in range(len(last))}
    return [f"{e} {c}" for e in sorted(ends) for c in sorted(letters)]


def _parse_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        names = [parse(s) for s in b.column("spelling").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [b.column("spelling"), b.column("n"), pa.array([x and list(x.parts) for x in names], pa.list_(pa.string())), pa.array([x and x.suffix for x in names], pa.string()),
             pa.array([x and x.key for x in names], pa.string())], names=["spelling", "n", "parts", "suffix", "form"],
        ).filter(pa.array([x is not None for x in names]))


def _key_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keys = [block_keys(tuple(p)) for p in b.column("parts").to_pylist()]
        at = pa.array([i for i, k in enumerate(keys) for _ in k], pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([x for k in keys for x in k], pa.string()), *(b.column(c).take(at) for c in ("form", "suffix", "rank"))], names=["key", "form", "suffix", "rank"])


def _score_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        said, true, common, n = (b.column(c).to_pylist() for c in ("said", "true_parts", "common", "n"))
        score = []
        for s, t, c, k in zip(said, true, common, n):
            like = likelihood(tuple(s), tuple(t), tuple(c))
            score.append(None if like is None or like < LEAST else like + log(k) - 2.0 * sum(x.endswith(".") for x in t))
        yield pa.RecordBatch.from_arrays([b.column("form"), b.column("true"), pa.array(score, pa.float64())], names=["form", "true", "score"]).filter(pa.array([x is not None for x in score]))


def _meetings(keyed: DataFrame) -> DataFrame:
    """``form, true``: forms that share a key and suffix, the second of higher rank.

    A large block is dealt by hash of the form into parts of about ``BLOCK``; each
    pair of parts is joined by itself, so no task holds a whole block.
    """
    block = ["key", "suffix"]
    large = keyed.groupBy(*block).agg(F.count("*").alias("n")).where(F.col("n") > BLOCK).select(*block, F.ceil(F.col("n") / BLOCK).cast("int").alias("parts"))
    dealt = keyed.join(large, block, "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("form"), F.col("parts")).cast("int"))
    others = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    a = dealt.select(*block, F.col("own").alias("i"), others, F.col("form").alias("form"), F.col("rank").alias("ra")).withColumnRenamed("other", "j")
    b = dealt.select(*block, F.col("own").alias("j"), others, F.col("form").alias("true"), F.col("rank").alias("rb")).withColumnRenamed("other", "i")
    return a.join(b, [*block, "i", "j"]).where(F.col("ra") < F.col("rb")).select("form", "true").distinct()


def attribute(df: DataFrame, name_col: str, max_rounds: int | None = None) -> DataFrame:
    """``spelling, person``: each distinct non-empty spelling with its person's true form.

    Spellings are counted first, so the work follows their number, not the rows'.
    Forms whose last parts are an edit apart meet under a shared key; each form's
    candidates are those that are more complete, or as complete and more frequent.

    Cases: null and blank spellings have no row, nor have those without a letter; a
    spelling is one person's, so namesakes are not told apart; of candidates equally
    likely the first in code point order is taken; other columns are ignored.
    """
    counts = df.select(F.col(f"`{name_col}`").cast("string").alias("spelling")).where(F.trim("spelling") != "").groupBy("spelling").agg(F.count("*").alias("n"))
    parsed = cut(counts.mapInArrow(_parse_batches, "spelling string, n long, parts array<string>, suffix string, form string"), "names-parsed")
    forms = parsed.groupBy("form").agg(F.sum("n").alias("n"), F.first("parts").alias("parts"), F.first("suffix").alias("suffix"))
    tokens = forms.select("form", F.explode("parts").alias("t"), F.element_at("parts", -1).alias("last"))
    common = tokens.where(F.col("t") != F.col("last")).groupBy("t").agg(F.count_distinct("last").alias("d")).where(F.col("d") >= COMMON).select("t")
    flags = tokens.select("form", "t").distinct().join(common, "t").groupBy("form").agg(F.collect_set("t").alias("known"))
    rank = F.struct(F.size(F.filter("parts", lambda p: ~p.endswith("."))).alias("full"), "n", "form")
    forms = cut(
        forms.withColumn("rank", rank).join(flags, "form", "left").withColumn("known", F.coalesce("known", F.array().cast("array<string>")))
        .withColumn("common", F.transform("parts", lambda p: F.array_contains("known", p))).drop("known"),
        "names-forms",
    )
    keyed = forms.select("form", "suffix", "parts", "rank").mapInArrow(_key_batches, "key string, form string, suffix string, rank struct<full:int,n:long,form:string>")
    met = _meetings(cut(keyed, "names-keyed"))
    said = forms.select("form", F.col("parts").alias("said"), "common")
    true = forms.select(F.col("form").alias("true"), F.col("parts").alias("true_parts"), "n")
    scored = met.join(said, "form").join(true, "true").select("form", "true", "said", "true_parts", "common", "n").mapInArrow(_score_batches, "form string, true string, score double")
    best = scored.groupBy("form").agg(F.min_by("true", F.struct(-F.col("score"), F.col("true"))).alias("true"))
    link = cut(forms.select("form").join(best, "form", "left").select("form", F.coalesce("true", "form").alias("root")), "names-links")
    for k in count():  # a form's root only rises in rank, so this ends
        if k == max_rounds:
            raise RuntimeError(f"roots still move after {max_rounds} rounds")
        up = link.select(F.col("form").alias("root"), F.col("root").alias("up"))
        new = cut(link.join(up, "root").select("form", F.col("up").alias("root"), (F.col("up") != F.col("root")).alias("moved")), "names-links")
        link = new.select("form", "root")
        if new.where("moved").isEmpty():
            break
    return parsed.select("spelling", "form").join(link, "form").select("spelling", F.col("root").alias("person"))


def same_person(df: DataFrame, name_col: str) -> DataFrame:
    """``a, b``: all pairs of different spellings of one person, smaller first; cases as in ``attribute``."""
    who = attribute(df, name_col)
    left, right = who.select(F.col("spelling").alias("a"), "person"), who.select(F.col("spelling").alias("b"), "person")
    return left.join(right, "person").where("a < b").select("a", "b")
