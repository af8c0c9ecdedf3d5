"""What a citation in words names: judgments, precedents and provisions, read token by token.

The same reading serves texts, filters typed by users and references to be checked.
A text is cut into words, numbers and signs; each kind of mention is a walk over them.
"""

from __future__ import annotations

import re
import unicodedata
from typing import NamedTuple

# Courts, classes and precedents as they are named.
COURTS = ("STF", "STJ", "TST", "TSE")
CLASSES = frozenset("AgInt AgRg EDcl EREsp EAREsp AREsp REsp RMS RHC HC CC RE ARE ADI ADPF ADC Rcl MS Pet AR EmbDiv SLS SS CR HD MI RO".split())
CLASS_NAMES = {
    "AGRAVO INTERNO": "AgInt", "AGRAVO REGIMENTAL": "AgRg", "EMBARGOS DE DECLARACAO": "EDcl", "EMBARGOS DE DIVERGENCIA EM AGRAVO EM RECURSO ESPECIAL": "EAREsp",
    "EMBARGOS DE DIVERGENCIA EM RECURSO ESPECIAL": "EREsp", "AGRAVO EM RECURSO ESPECIAL": "AREsp", "RECURSO ESPECIAL": "REsp", "RECURSO EM MANDADO DE SEGURANCA": "RMS",
    "RECURSO ORDINARIO EM HABEAS CORPUS": "RHC", "HABEAS CORPUS": "HC", "CONFLITO DE COMPETENCIA": "CC", "RECLAMACAO": "Rcl", "RECURSO EXTRAORDINARIO": "RE", "AGRAVO EM RECURSO EXTRAORDINARIO": "ARE",
}
SPECIES = {"TEMA": "tema", "TEMAS": "tema", "SUMULA": "sumula", "SUMULAS": "sumula", "IRDR": "irdr", "IAC": "iac"}
# Segment and court of a national number.
NATIONAL_COURTS = {"824": "TJSC"}
# Names of statutes and the key of each.
STATUTES = {
    "CPC": "CPC", "CPC/2015": "CPC", "CPC/15": "CPC", "NCPC": "CPC", "CPC/1973": "CPC/1973", "CPC/73": "CPC/1973", "CODIGO DE PROCESSO CIVIL": "CPC",
    "CC": "CC", "CC/2002": "CC", "CC/02": "CC", "CC/1916": "CC/1916", "CC/16": "CC/1916", "CODIGO CIVIL": "CC",
    "CF": "CF", "CF/1988": "CF", "CF/88": "CF", "CRFB": "CF", "CRFB/1988": "CF", "CRFB/88": "CF", "CONSTITUICAO FEDERAL": "CF", "CONSTITUICAO DA REPUBLICA": "CF",
    "ECA": "ECA", "ESTATUTO DA CRIANCA E DO ADOLESCENTE": "ECA", "CDC": "CDC", "CODIGO DE DEFESA DO CONSUMIDOR": "CDC",
    "CLT": "CLT", "CTN": "CTN", "CP": "CP", "CPP": "CPP", "LINDB": "LINDB", "RISTJ": "RISTJ",
}
LAWS = {"LEI": "LEI", "LEI COMPLEMENTAR": "LC", "DECRETO": "DECRETO", "DECRETO-LEI": "DL"}

_LINKS = frozenset("NO NA NOS NAS".split())
_NUMBER_MARKS = frozenset(["N", "NO", ".", "º", "°", "o"])
_ARTICLE_WORDS = frozenset("E ART ARTS ARTIGO ARTIGOS".split())
_COMPLEMENTS = ("§", "PAR", "INC", "ALINEA", "CAPUT", "LETRA")
_TOKEN = re.compile(r"(?P<n>\d(?:[\d./-]*\d)?)|(?P<w>[^\W\d_]+(?:-[^\W\d_]+)*)|(?P<s>\S)")


class Token(NamedTuple):
    kind: str
    raw: str
    fold: str
    start: int
    end: int


def _fold(text: str) -> str:
    return text if text in "ºª" else "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).upper()


def lex(text: str) -> list[Token]:
    return [Token(m.lastgroup, m[0], _fold(m[0]), m.start(), m.end()) for m in _TOKEN.finditer(text)]


def _longest(tokens: list[Token], at: int, names: dict[str, str]) -> tuple[str, str, int] | None:
    """(name, value, end) of the longest entry whose words stand at a place."""
    best = None
    said = ""
    for k in range(at, min(at + 9, len(tokens))):
        if tokens[k].kind != "w":
            break
        said = f"{said} {tokens[k].fold}".strip()
        if said in names:
            best = said, names[said], k + 1
    return best


def _after_marks(tokens: list[Token], at: int) -> int:
    """Past what stands between a name and its number: ``n.``, ``nº``, ``(s)``."""
    while at < len(tokens) and (tokens[at].raw in _NUMBER_MARKS or tokens[at].fold in _NUMBER_MARKS or tokens[at].raw in "()" or (tokens[at].fold == "S" and tokens[at - 1].raw == "(")):
        at += 1
    return at


def _whole(number: str, most: int) -> str | None:
    """The value of a number, with dots at thousands or none, of at most so many digits."""
    groups = number.split(".")
    good = all(g.isdigit() for g in groups) and (len(groups) == 1 or (len(groups[0]) <= 3 and all(len(g) == 3 for g in groups[1:])))
    joined = "".join(groups)
    return str(int(joined)) if good and len(joined) <= most else None


def court_at(tokens: list[Token], at: int) -> str | None:
    """The court that a token names."""
    if not 0 <= at < len(tokens):
        return None
    word = tokens[at].fold.replace("-", "")
    if word in COURTS or re.fullmatch(r"TJ[A-Z]{2}", word):
        return word
    if word == "TRF" and at + 1 < len(tokens):  # its number is a token of its own
        number = next((t.raw for t in tokens[at + 1 : at + 3] if t.kind == "n"), "")
        return f"TRF{number}" if len(number) == 1 else None
    return None


def leading_court(tokens: list[Token]) -> str | None:
    """The court with which an item begins, perhaps after ``e``."""
    return court_at(tokens, 1 if tokens and tokens[0].fold == "E" else 0)


def trailing_court(tokens: list[Token]) -> str | None:
    """The court with which a reference ends (``... do STJ``)."""
    last = tokens[-1].fold if tokens else ""
    return last if last in ("STJ", "STF", "TJSC") else None


def national_number(tokens: list[Token]) -> str | None:
    """The twenty digits of the first national number."""
    for t in tokens:
        if t.kind == "n" and len(digits := re.sub(r"\D", "", t.raw.split("/")[0])) == 20:
            return digits
    return None


def old_number(tokens: list[Token]) -> str | None:
    """The digits of the first number of the state's earlier form: year, six digits, check digit."""
    for t in tokens:
        year, _, rest = t.raw.partition(".")
        if t.kind == "n" and len(year) == 4 and year.isdigit() and re.fullmatch(r"\d{6}-\d", rest):
            return year + rest.replace("-", "")
    return None


def class_number(tokens: list[Token]) -> str | None:
    """``CLASSE:number`` of the first class, or chain of classes, that a number follows."""
    at = 0
    while at < len(tokens):
        chain: list[str] = []
        k = at
        while k < len(tokens):
            named = _longest(tokens, k, CLASS_NAMES)
            if named:
                chain, k = [*chain, named[1]], named[2]
            elif tokens[k].raw in CLASSES:
                chain, k = [*chain, tokens[k].raw], k + 1
            elif chain and tokens[k].raw.upper() in _LINKS and chain[-1] not in _LINKS:  # not "nº"
                chain, k = [*chain, tokens[k].fold], k + 1
            else:
                break
        if chain:
            after = _after_marks(tokens, k)
            if chain[-1] not in _LINKS and after < len(tokens) and tokens[after].kind == "n" and (number := _whole(tokens[after].raw.split("/")[0], 9)):
                return f"{' '.join(chain).upper()}:{number}"
        at = max(k, at + 1)
    return None


def judgment(tokens: list[Token], court: str | None) -> str | None:
    """The key of the judgment an item names: a national number, then one of the earlier form, then class and number."""
    if number := national_number(tokens):
        of = court or NATIONAL_COURTS.get(number[13:16])
        return f"{of}:{number}" if of else None
    if court in (None, "TJSC") and (number := old_number(tokens)):
        return f"TJSC:{number}"
    if court in (None, "STJ", "STF") and (found := class_number(tokens)):
        return f"{court or 'STJ'}:{found}"
    return None


def _precedent(kind: str, number: str, court: str | None, binding: bool, general: bool) -> str | None:
    if kind == "tema":
        return f"STF:tema_repercussao_geral:{number}" if general or court == "STF" else f"STJ:tema_repetitivo:{number}"
    if kind == "sumula":
        if binding:
            return f"STF:sumula_vinculante:{number}"
        return None if court == "TJSC" else f"{court if court in ('STF', 'STJ') else 'STJ'}:sumula:{number}"  # the state court numbers them by organ
    return f"TJSC:{kind}:{number}" if court in (None, "TJSC") else None


def precedents(tokens: list[Token], court: str | None) -> list[tuple[str | None, int, int]]:
    """(key, first, last token) of each precedent mentioned; an incident known by its process number has no key."""
    out: list[tuple[str | None, int, int]] = []
    for at, t in enumerate(tokens):
        kind = SPECIES.get(t.fold)
        if kind is None:
            continue
        k, binding, general = at + 1, False, False
        while k < len(tokens) and tokens[k].kind == "w" and tokens[k].fold not in _NUMBER_MARKS and not (tokens[k].fold == "S" and tokens[k - 1].raw == "("):
            binding |= tokens[k].fold.startswith("VINCULANTE")
            general |= tokens[k].fold in ("RG", "STF") or tokens[k].fold.startswith("REPERCUSS")
            if k - at > 4 or SPECIES.get(tokens[k].fold):
                break
            k += 1
        k = _after_marks(tokens, k)
        many = t.fold.endswith("S")
        while k < len(tokens) and tokens[k].kind == "n":
            number = _whole(tokens[k].raw, 5)
            if number is not None:
                out.append((_precedent(kind, number, court, binding, general), at, k))
            elif kind in ("irdr", "iac") and sum(c.isdigit() for c in tokens[k].raw) > 5:
                out.append((None, at, k))
            if not many or not (k + 2 < len(tokens) and (tokens[k + 1].raw == "," or tokens[k + 1].fold == "E")):
                break
            k += 2
    return out


def statute_at(tokens: list[Token], at: int) -> tuple[str, int] | None:
    """(key, end) of a statute named at a place: a code by short or full name, or a law by number and year."""
    t = tokens[at]
    if t.kind != "w":
        return None
    if t.raw in STATUTES:
        if at + 2 < len(tokens) and tokens[at + 1].raw == "/" and tokens[at + 1].start == t.end and re.fullmatch(r"\d{2}|\d{4}", tokens[at + 2].raw):
            dated = f"{t.raw}/{tokens[at + 2].raw}"
            return STATUTES.get(dated, dated), at + 3
        return STATUTES[t.raw], at + 1
    if (named := _longest(tokens, at, STATUTES)) and " " in named[0]:
        return named[1], named[2]
    if law := _longest(tokens, at, LAWS):
        k = _after_marks(tokens, law[2])
        number, _, year = tokens[k].raw.partition("/") if k < len(tokens) and tokens[k].kind == "n" else ("", "", "")
        if year.isdigit() and 2 <= len(year) <= 4 and (plain := number.replace(".", "")).isdigit():
            full = year if len(year) > 2 else ("19" if int(year) > 30 else "20") + year
            return f"{law[1]} {int(plain):,}/{full}".replace(",", "."), k + 1
    return None


def statute_key(name: str) -> str:
    """One key for a statute's names; laws by kind, number with dots, and year."""
    tokens = lex(name)
    found = statute_at(tokens, 0) if tokens else None
    return found[0] if found and found[1] == len(tokens) else _fold(" ".join(name.split()))


def _article(tokens: list[Token]) -> str | None:
    """The number of the article with which some tokens begin, with its letter if it has one."""
    if not tokens or tokens[0].kind != "n" or (number := _whole(tokens[0].raw, 7)) is None or len(tokens[0].raw.split(".")[0]) > 4:
        return None
    rest = "".join(t.raw for t in tokens[1:4]).lstrip("º°o")
    letter = re.match(r"-([A-Z])(?![^\W\d_])", rest)
    return f"{number}-{letter[1]}" if letter else number


def _is_complement(t: Token) -> bool:
    return t.raw == "§" or (t.kind == "w" and (t.fold.startswith(_COMPLEMENTS[1:]) or re.fullmatch(r"[IVXLC]+", t.raw) is not None))


def provisions(line: str) -> list[tuple[str | None, str]]:
    """(key, text) of each provision in a line: the statute last named with each article after it.

    Articles stand between commas and semicolons; what is no article belongs to the one before.
    """
    tokens = lex(line)
    out: list[tuple[str | None, str]] = []
    statute: tuple[str, str] | None = None
    articles: list[list] = []
    at = begun = 0

    def close() -> None:
        nonlocal articles
        if statute:
            out.extend((f"{statute[0]}:{n}" if n else None, f"{statute[1]}, art. {text}") for n, text in articles)
            if not articles:
                out.append((f"{statute[0]}:*", statute[1]))
        articles = []

    def piece(own: list[Token]) -> None:
        while own and (own[0].fold in _ARTICLE_WORDS or own[0].raw in ".:"):
            own = own[1:]
        while own and own[-1].raw in ".:":
            own = own[:-1]
        if not own or not statute:
            return
        text = line[own[0].start : own[-1].end]
        if (number := _article(own)) is not None:
            articles.append([number, text])
        elif articles:
            articles[-1][1] += f", {text}"
        elif _is_complement(own[0]):
            articles.append([None, text])

    while at < len(tokens):
        found = statute_at(tokens, at)
        if found:
            piece(tokens[begun:at])
            close()
            statute = found[0], line[tokens[at].start : tokens[found[1] - 1].end]
            at = begun = found[1]
        elif tokens[at].raw in ",;":
            piece(tokens[begun:at])
            at = begun = at + 1
        else:
            at += 1
    piece(tokens[begun:])
    close()
    bare = line.strip()
    return out if statute or not bare else [(None, bare)]


def case_law(line: str) -> list[tuple[str, str | None, str]]:
    """(tipo, key, text) of a line's items, parted by semicolons: each precedent an item mentions,
    and its judgment; an item in which nothing can be read is a judgment without a key, so that the loss shows."""
    out: list[tuple[str, str | None, str]] = []
    for item in line.split(";"):
        item = item.strip(" .\t\r\n")
        if not item:
            continue
        tokens = lex(item)
        court = leading_court(tokens)
        found = precedents(tokens, court)
        out += [("precedente", key, item[tokens[a].start : tokens[b].end]) for key, a, b in found]
        key = judgment(tokens, court)
        if key or not found:
            out.append(("acordao", key, item))
    return out


def recognized(reference: str) -> tuple[str, str] | None:
    """(tipo, key) of what a reference names: a national number, class and number of the STJ, a number
    of the earlier form, a precedent, or class and number of another court (``acordao_outro``)."""
    tokens = lex(reference)
    court = leading_court(tokens) or trailing_court(tokens)
    if number := national_number(tokens):
        return "acordao", f"{court or NATIONAL_COURTS.get(number[13:16], '')}:{number}"
    of_class = class_number(tokens)
    if of_class and court in (None, "STJ"):
        return "acordao", f"STJ:{of_class}"
    if court in (None, "TJSC") and (number := old_number(tokens)):
        return "acordao", f"TJSC:{number}"
    named = [key for key, _, _ in precedents(tokens, court) if key]
    if len(named) == 1:
        return "precedente", named[0]
    return ("acordao_outro", f"{court}:{of_class}") if of_class else None


def filter_key(tipo: str, value: str) -> str | None:
    """The key that a filter typed by a user means, made as texts are read; None where it means none."""
    value = " ".join(value.split())
    tokens = lex(value)
    court = leading_court(tokens) or trailing_court(tokens)
    if tipo == "precedente":
        parts = value.split(":")
        if len(parts) in (3, 4) and parts[0].upper() in ("STJ", "STF", "TJSC") and parts[-1].isdigit() and all(parts):  # a key as it is stored
            return ":".join([parts[0].upper(), *parts[1:]])
        named = [key for key, _, _ in precedents(tokens, court) if key]
        return named[0] if len(named) == 1 else None
    if tipo == "acordao":
        if re.fullmatch(r"[A-Z]+:[A-Z ]+:\d+|[A-Z]+:\d{9,}", value):
            return value
        if number := national_number(tokens):
            return f"{of}:{number}" if (of := court or NATIONAL_COURTS.get(number[13:16])) else None
        if number := old_number(tokens):
            return f"TJSC:{number}"
        return f"{court or 'STJ'}:{found}" if (found := class_number(tokens)) else None
    for at in range(len(tokens)):
        if found := statute_at(tokens, at):
            rest = [t for t in tokens[:at] + tokens[found[1] :] if t.raw not in ".,;:"]
            while rest and rest[0].fold in _ARTICLE_WORDS | {"DO", "DA"}:
                rest = rest[1:]
            if not rest:
                return f"{found[0]}:*"
            return f"{found[0]}:{number}" if (number := _article(rest)) else None
    return None
