"""One ordinary form for text that looks the same in different characters."""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Letters of Greek, Cyrillic and Armenian that look like Latin ones.
LATIN_LIKE = dict(zip(
    "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧΚͿϹϳϲιονρυκϱ" "АВЕЅІЈКМНОРСТУХҮԚԜаеѕіјорсухһԁԛԝցқҮӀҺΙ" "ՕՏՍԼհոսօցք",
    "ABEZHIKMNOPTYXKJCjciovpukp" "ABESIJKMHOPCTYXYQWaesijopcyxhdqwgkYlhI" "OSULhnuogp",
))
# The same for letters met in mixed words only.
LATIN_LIKE_MIXED = dict(zip("αγτωβвнмткгьϜ", "aytwßbhmtkrbF"))

#: What may need mending: all but ASCII, Latin letters and ordinary signs. Other texts are not looked at closer.
SUSPECT = re.compile("[^\\u0000-\\u007E\\u00A1-\\u00AC\\u00AE-\\u0131\\u0134-\\u013E\\u0141-\\u0148\\u014A-\\u017E\\u2013\\u2014\\u2018-\\u201D\\u2026\\u2030\\u20AC\\u221A\\u2502]")
#: What stands for Latin letters in mixed words, beyond these tables; filled from ``lookalikes_of``.
_MORE: dict[str, str] = {}
_WORD = regex.compile(r"[\p{L}\p{M}\p{N}\p{Cf}]+")
_LETTERS = regex.compile(r"[\p{L}\p{M}]+")
_HIDDEN = regex.compile(r"[\p{Cf}͏ᅟᅠ឴឵᠋-᠏ㅤ︀-️ﾠ]")
_LATIN = regex.compile(r"\p{Script=Latin}")
_JOINED = {"HIRAGANA": {"Jpan"}, "KATAKANA": {"Jpan"}, "HANGUL": {"Kore"}, "BOPOMOFO": {"Hanb"}, "CJK": {"Jpan", "Kore", "Hanb"}}


@lru_cache(4096)
def scripts(char: str) -> frozenset[str] | None:
    """The resolved script set of a letter; None (all scripts) for what belongs to none."""
    if not unicodedata.category(char).startswith("L") or char in "ªº":
        return None
    name = unicodedata.name(char, "UNKNOWN").split(" ", 1)[0]
    return frozenset({name} | _JOINED.get(name, set()))


@lru_cache(4096)
def _plain_form(char: str) -> str:
    """Blanks, full-width forms, styled letters, ligatures: their ordinary characters; else the character."""
    kind, _, _ = unicodedata.decomposition(char).partition(" ")
    category = unicodedata.category(char)
    if category == "Zs":
        return " "
    if char in "‐‑":
        return "-"
    form = unicodedata.normalize("NFKC", char)
    if kind in ("<wide>", "<narrow>", "<font>"):
        return form
    if kind == "<compat>" and category[0] == "L" and char != "µ" and form.isalpha():
        return form
    if kind == "<compat>" and category == "Nl":
        return form
    if category == "Nd" and not char.isascii():
        return str(unicodedata.decimal(char))
    return char


def lookalikes_of(spark: SparkSession) -> dict[str, str]:
    """Letters of all scripts, phonetic ones and small capitals included, with the Latin letter they look like.

    By the Unicode data on confusable characters that ICU holds, which Spark brings
    along: a letter with the same skeleton as an ASCII letter stands for it, in its own
    case. Small capitals go by their names. Ordinary letters of European alphabets and those of
    the fixed tables are left out. A session whose ICU can't be asked is an error: a shorter
    table would leave look-alikes unfound.
    """
    letters = [c for n in range(0x250, sys.maxunicode + 1) if unicodedata.category(c := chr(n)) in ("Lu", "Ll", "Lo", "Lt") and c not in LATIN_LIKE and c not in LATIN_LIKE_MIXED and not "\u1e00" <= c <= "\u1fff"]
    found = {c: m[1].lower() for c in letters if (m := _SMALL_CAPITAL.fullmatch(unicodedata.name(c, "")))}
    ascii_ = [c for c in map(chr, range(128)) if c.isalpha()]
    try:
        checker = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
        shapes = str(checker.getSkeleton("\n".join(ascii_ + letters))).split("\n")
    except Exception as x:
        raise RuntimeError("ICU's data on confusable characters can't be read; a classic session with icu4j on the driver's class path is needed") from x
    if len(shapes) != len(ascii_) + len(letters):
        raise RuntimeError(f"ICU gave {len(shapes)} skeletons of {len(ascii_) + len(letters)} letters")
    of_shape: dict[str, list[str]] = {}
    for c, shape in zip(ascii_, shapes):
        of_shape.setdefault(shape, []).append(c)
    for c, shape in zip(letters, shapes[len(ascii_) :]):
        for like in of_shape.get(shape, []):
            if unicodedata.category(c) == "Lo" or like.isupper() == (unicodedata.category(c) == "Lu"):
                found.setdefault(c, like)
    return found


_SMALL_CAPITAL = re.compile("LATIN LETTER SMALL CAPITAL ([A-Z])")


def use(more: dict[str, str]) -> None:
    """Take a table of ``lookalikes_of`` into account from here on."""
    if more != _MORE:
        _MORE.clear()
        _MORE.update(more)
        for f in (_latin, consistent):
            f.cache_clear()


@lru_cache(8192)
def _latin(char: str, mixed: bool) -> str | None:
    """The Latin spelling of a letter, None if it has none."""
    if char in _MORE and (mixed or _LATIN.match(char)):
        return _MORE[char]
    if _LATIN.match(char):
        return char
    if char in LATIN_LIKE:
        return LATIN_LIKE[char]
    if mixed and char in LATIN_LIKE_MIXED:
        return LATIN_LIKE_MIXED[char]
    base = unicodedata.normalize("NFD", char)
    if len(base) > 1 and (head := _latin(base[0], mixed)):
        return unicodedata.normalize("NFC", head + base[1:])
    return None


@lru_cache(65536)
def consistent(token: str, around: frozenset[str] = frozenset()) -> str:
    """The token in one script: where letters of several scripts share no script, or all
    letters of a foreign one look Latin, the Latin spelling if there is one.

    The scripts of all letters are intersected; a non-empty intersection is a
    consistent token, which changes only as a whole-script look-alike, and not even so
    beside a word that is plainly in that script (``around``). Of one letter alone only
    those that stand for the one-letter words A, E and O change. Phonetic letters and small
    capitals, which are Latin, change among ordinary letters.
    """
    letters = [c for c in token if scripts(c) is not None]
    if not letters:
        return token
    if all(_LATIN.match(c) for c in letters):
        if any(c in _MORE for c in letters) and (len(letters) > 1 and not all(c in _MORE for c in letters)):
            return "".join(_MORE.get(c, c) for c in token)
        return token
    shared = frozenset.intersection(*(scripts(c) for c in letters))
    if shared:
        spelt = [_latin(c, False) for c in letters]
        if None in spelt or "LATIN" in shared or shared & around or (len(letters) == 1 and spelt[0] not in "aeoAEO"):
            return token
        mixed = False
    else:
        if not any(_LATIN.match(c) for c in letters) and any(_latin(c, True) is None for c in letters):
            return token
        mixed = True
    return "".join(c if scripts(c) is None else _latin(c, mixed) or c for c in token)


def _plainly_in(word: str) -> frozenset[str]:
    """The script of a word that can't be read as Latin, else none."""
    letters = [c for c in word if scripts(c) is not None]
    if not letters or all(_latin(c, False) is not None for c in letters):
        return frozenset()
    return frozenset.intersection(*(scripts(c) for c in letters))


def _in_one_script(text: str) -> str:
    """The text with each word in one script; words know their neighbours."""
    words = list(_WORD.finditer(text))
    out, at = [], 0
    for k, m in enumerate(words):
        if m[0].isascii():
            continue
        near = [words[i][0] for i in (k - 1, k + 1) if 0 <= i < len(words) and not words[i][0].isascii()]
        around = frozenset().union(*map(_plainly_in, near))
        out += [text[at : m.start()], _LETTERS.sub(lambda x: consistent(x[0], around), m[0])]  # noqa: B023
        at = m.end()
    return "".join([*out, text[at:]])


def ordinary(text: str) -> str:
    """The text in its ordinary form; equal to the text if nothing stands in for ordinary characters.

    Hidden characters go; other blanks become spaces, full-width and styled forms,
    ligatures and foreign digits their ordinary characters; combining accents are
    joined with their letters; words in mixed or look-alike scripts get one script.
    Precomposed letters, line breaks, signs, and words wholly in another script stay.
    """
    text = _HIDDEN.sub("", text)
    if not text.isascii():
        text = "".join(c if c < "\x7f" else _plain_form(c) for c in text)
        text = _in_one_script(text)
        text = unicodedata.normalize("NFC", text)
    return text


def _normal(more: dict[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use(more)
        for b in batches:
            texts = b.column("text").to_pylist()
            at = [i for i, t in enumerate(texts) if SUSPECT.search(t)]
            made = [ordinary(texts[i]) for i in at]
            own = b.take(pa.array(at, pa.int64()))
            out = pa.RecordBatch.from_arrays([own.column("id"), own.column("text"), pa.array(made, pa.string())], names=["id", "text", "normal"])
            yield out.filter(pa.array([m != texts[i] for m, i in zip(made, at)], pa.bool_()))

    return run


def unusual(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, text, normal``: the records whose text is not in its ordinary form, with that form.

    One pass; only texts that hold a character outside the ordinary ones are mended.
    Cases: null and empty texts, and null ids, give no row; rows delivered twice count
    once; an empty table gives no rows; other columns are ignored.
    """
    rows = df.select(F.col(f"`{id_col}`").cast("string").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return rows.where("id is not null and text is not null").mapInArrow(_normal(lookalikes_of(df.sparkSession)), "id string, text string, normal string").distinct()
