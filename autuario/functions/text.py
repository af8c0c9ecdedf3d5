"""Text functions as columns: folding, tokens, keys.

All stay in the JVM. Two folds exist and are kept apart: ``folded`` (compatibility
forms, for filters and keys) and the index fold (diacritics only, for tokens).
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

_MARKS = "".join(chr(c) for c in range(0x300, 0x370))


@lru_cache(2)
def _fold_table(form: str) -> tuple[str, str]:
    """(from, to) of every character that the form takes apart into one base and marks; marks alone go."""
    source, target = [], []
    for c in range(0x80, min(sys.maxunicode, 0xFFFF) + 1):
        ch = chr(c)
        if unicodedata.category(ch)[0] in "MC":
            continue
        bare = "".join(x for x in unicodedata.normalize(form, ch) if not unicodedata.combining(x))
        if len(bare) == 1 and bare != ch:
            source.append(ch)
            target.append(bare)
    return "ς" + "".join(source) + _MARKS, "σ" + "".join(target)  # lower case has two sigmas


def folded(col: Column) -> Column:
    """Compatibility form without combining marks, in capitals."""
    return F.upper(F.translate(col, *_fold_table("NFKD")))


def undiacritic(col: Column) -> Column:
    """The text without diacritics; compatibility characters such as ª stay."""
    return F.translate(col, *_fold_table("NFD"))


def tokens(col: Column) -> Column:
    """Index tokens in order: runs of letters and digits, in lower case without diacritics."""
    return F.array_remove(F.split(undiacritic(F.lower(col)), r"[^\p{L}\p{N}]+"), "")


def fold_literal(text: str) -> str:
    """``folded`` of a driver-side string."""
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).upper()


def token_literal(text: str) -> list[str]:
    """``tokens`` of a driver-side string."""
    source, target = _fold_table("NFD")
    table = {ord(c): (target[i] if i < len(target) else None) for i, c in enumerate(source)}
    low = text.lower().translate(table)
    return "".join(c if c.isalnum() else " " for c in low).split()


def digits(col: Column) -> Column:
    """The decimal digits of a text."""
    return F.regexp_replace(col, r"[^0-9]", "")


def plain(col: Column) -> Column:
    """Folded, punctuation as blanks, blanks collapsed."""
    return F.trim(F.regexp_replace(folded(col), r"[^\p{L}\p{N}]+", " "))


def text_key(col: Column) -> Column:
    """Digest of the folded letters and digits; null where there are none."""
    bare = F.regexp_replace(folded(col), r"[^\p{L}\p{N}]+", "")
    return F.when(bare != "", F.sha2(bare, 256))


def slug(col: Column) -> Column:
    """ASCII words joined by dashes."""
    return F.array_join(F.array_remove(F.split(undiacritic(F.lower(col)), r"[^a-z0-9]+"), ""), "-")


def cut_at_word(col: Column, size: int) -> Column:
    """At most ``size`` characters, ending at a word's end where there is one."""
    head = F.substring(col, 1, size + 1)
    at = F.regexp_extract(head, r"(?s)^(.*\S)\s", 1)
    return F.when(F.length(col) <= size, col).when(at != "", at).otherwise(F.substring(col, 1, size))


def same_but_blanks(a: Column, b: Column) -> Column:
    """Whether two texts differ at most in white space."""
    return F.regexp_replace(a, r"\s+", "").eqNullSafe(F.regexp_replace(b, r"\s+", ""))


def branches(col: Column) -> Column:
    """The branches that a cell names, parted by semicolons or line breaks: trimmed, blanks left out, each once, in order."""
    return F.array_distinct(F.filter(F.transform(F.split(col, r"[;\r\n]+"), lambda x: F.trim(x)), lambda x: x != ""))


def enveloped(col: Column) -> Column:
    """A text as Base64 of its UTF-8, without line breaks."""
    return F.regexp_replace(F.base64(F.encode(col, "UTF-8")), r"\s", "")


def opened(col: Column) -> Column:
    """The text in a Base64 envelope, null if it isn't one."""
    return F.decode(F.try_to_binary(col, F.lit("base64")), "UTF-8")


def number_text(value: object) -> str | None:
    """A number given as text or as a number, as text; a true or false, a fraction and nothing are refused (None)."""
    if isinstance(value, bool) or value is None:
        return None
    if isinstance(value, float):
        return str(int(value)) if value.is_integer() else None
    return str(value).strip() or None if isinstance(value, (int, str)) else None


#: Endings of Portuguese words that a light stemmer takes off, longest first, with the least letters left before them.
ENDINGS = (("amento", 3), ("imento", 3), ("mente", 4), ("idade", 4), ("acao", 3), ("icao", 3), ("acoes", 3), ("icoes", 3), ("oes", 3), ("ista", 4), ("avel", 3), ("ivel", 3), ("ais", 3), ("eis", 3), ("ado", 3), ("ada", 3), ("ido", 3), ("ida", 3), ("ar", 3), ("er", 3), ("ir", 3), ("os", 3), ("as", 3), ("es", 3), ("o", 3), ("a", 3), ("e", 3), ("s", 3))


def stems(words: Column) -> Column:
    """An array of index tokens by a light stemmer: the longest ending that leaves enough of a word is taken off."""

    def stem(w: Column) -> Column:
        out = F.when(F.lit(False), w)
        for ending, least in sorted(ENDINGS, key=lambda e: -len(e[0])):
            out = out.when(w.endswith(ending) & (F.length(w) >= len(ending) + least), F.substring(w, F.lit(1), F.length(w) - len(ending)))
        return out.otherwise(w)

    return F.transform(words, stem)
