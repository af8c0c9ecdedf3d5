"""Text that was decoded with the wrong character encoding.

A multinomial classifier on hashed byte bigrams, trained on records garbled here on
purpose, predicts for each word beyond ASCII the chain of encodings that garbled it;
the chain is inverted, and the result kept where it decodes strictly and is likelier
as ordinary text. Chains that no part of the corpus bears out are not believed.
"""

from __future__ import annotations

import codecs
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from autuario.operators.skew import counted_keys, left_join_counted, semi_join_counted
from autuario.runtime import cut, spread


#: The bigrams' weights are fitted on the words of so many documents, drawn by a hash of their id; all else is taken from all documents.
TRAIN_DOCUMENTS = 20_000
#: Buckets of the hashed bigrams.
FEATURES = 1 << 15
#: Advantage in nats, for a word to be garbled: where its inversion is verified, and where it cannot be inverted.
LEAST_GAIN, LEAST_GAIN_BLIND = 3.0, 12.0
#: A word that the corpus has so often is a word as it stands, unless what it would be restored to is one, too.
RECURS = 3
#: A word may have gone through so many chains.
DEPTH = 4
#: Share of the corpus's letters beyond ASCII that the words restored by a chain must show between them, in the corpus or in one document.
LEAST_COVER = 0.25

# The encodings and chains that are tried.
_MULTI = ("latin-1", "cp1252", "mac_roman", "cp437", "cp850")
CHAINS: tuple[tuple[tuple[str, str], ...], ...] = (
    *((("utf-8", d),) for d in (*_MULTI, "cp1251", "iso8859_15")),
    *((("utf-8", a), ("utf-8", b)) for a in _MULTI for b in _MULTI),
    *((("cp1252", d),) for d in ("cp437", "cp850", "mac_roman", "cp1251", "cp1250", "iso8859_7", "cp1253")),
    *((("cp850", d),) for d in ("cp1252", "cp437", "mac_roman")),
    *((("mac_roman", d),) for d in ("cp1252", "cp850", "cp437")),
    *((("cp1252", d), ("cp1252", d)) for d in ("cp437", "cp850", "mac_roman")),
)
LOST = "�"
LOST_BYTES = LOST.encode()


def _table(name: str) -> str:
    """The character of each byte; bytes without one are read as in Latin-1."""
    out = []
    for b in range(256):
        try:
            out.append(bytes([b]).decode(name))
        except UnicodeDecodeError:
            out.append(chr(b))
    return "".join(out)


_DECODE = {n: _table(n) for n in {x for c in CHAINS for s in c for x in s} - {"utf-8"}}
_ENCODE = {n: codecs.charmap_build(t) for n, t in _DECODE.items()}


def _to_bytes(text: str, name: str) -> bytes:
    return text.encode("utf-8") if name == "utf-8" else codecs.charmap_encode(text, "strict", _ENCODE[name])[0]


def _to_text(raw: bytes, name: str) -> str:
    return raw.decode("utf-8") if name == "utf-8" else codecs.charmap_decode(raw, "strict", _DECODE[name])[0]


def garble(text: str, chain: tuple[tuple[str, str], ...]) -> str:
    """The text as it looks after each step's bytes (first) were read in the wrong encoding (second)."""
    for right, wrong in chain:
        text = _to_text(_to_bytes(text, right), wrong)
    return text


def invert(text: str, chain: tuple[tuple[str, str], ...]) -> str | None:
    """The text before the chain, None where some step doesn't decode strictly."""
    try:
        for right, wrong in reversed(chain):
            text = _to_text(_to_bytes(text, wrong), right)
    except (UnicodeError, TypeError):
        return None
    return text


def _bigrams(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(position, feature) of each bigram of bytes that has a byte beyond ASCII."""
    b = np.frombuffer(raw, np.uint8)
    if len(b) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.flatnonzero((b[:-1] | b[1:]) & 0x80)
    code = (b[at].astype(np.uint32) << np.uint32(8)) | b[at + 1]
    return at, ((code * np.uint32(0x9E3779B1)) >> np.uint32(32 - 15)).astype(np.int64)


_BEYOND = re.compile("[^\\x00-\\x7f]")
_SPACE = re.compile("([ \t\r\n\x0b\x0c]+)")


def foreign_words(text: str) -> list[bytes]:
    """The words of a text, between ASCII blanks, that have a character beyond ASCII, as UTF-8."""
    return [w for w in text.encode("utf-8", "surrogatepass").split() if not w.isascii()]


def _odd(text: str) -> bool:
    """Control characters, which no ordinary text holds."""
    return any("\x7f" <= c <= "\x9f" for c in text)


#: Taken off a word's ends; a question mark may stand for a lost character.
_CORE_ENDS = "!\"#$%&'()*+,-./:;<=>@[]^_{|}~`“”"
_ENDS = _CORE_ENDS + "?"


def _bare(word: str) -> str:
    return word.strip(_ENDS)


def hole(word: str) -> str | None:
    """The form, with lost characters as ``?``, under which a word may be known; None where it has none or is too short."""
    if LOST not in word and "?" not in word[:-1]:
        return None
    core = word.strip(_CORE_ENDS)
    return core.replace(LOST, "?") if LOST in core or len(core) > 3 else None


@dataclass
class Model:
    """The classifier: log-probabilities of each feature (rows) in ordinary text (column 0)
    and under each chain; the chains borne out by the corpus; the frequency of each letter;
    ordinary words beyond ASCII, and how often each word is there, garbled or not. Of the
    last two a task holds those that its words look up (``keys``)."""

    weight: np.ndarray
    active: frozenset[int]
    letters: dict[str, float]
    words: frozenset[str]
    seen: dict[str, int]

    def score(self, word: str) -> np.ndarray:
        return self.weight[_bigrams(f" {word} ".encode("utf-8", "surrogatepass"))[1]].sum(axis=0)

    def likelier(self, word: str, score: np.ndarray) -> list[tuple[float, int, str]]:
        """(gain, chain, restored) of each chain under which the word is likelier than as
        ordinary text, and whose inversion decodes strictly and gives a likelier word."""
        out = []
        for i in np.flatnonzero(score[1:] > score[0]).tolist():
            restored = invert(word, CHAINS[i])
            if restored is not None and restored != word and not _odd(restored):
                gain = float(self.score(restored)[0] - score[0])
                if gain >= LEAST_GAIN:
                    out.append((gain, i, restored))
        return out

    def inversions(self, word: str, score: np.ndarray) -> list[tuple[float, int, str]]:
        return [x for x in self.likelier(word, score) if self.believes(word, x[2])]

    def blind(self, score: np.ndarray) -> list[int]:
        """The chains that a word shows which cannot be inverted."""
        return [i for i in self.active if score[1 + i] - score[0] >= LEAST_GAIN_BLIND]

    def keys(self, word: str, depth: int = DEPTH) -> set[str]:
        """The words that judging this one may look up; none if its letters alone make it ordinary."""
        out: set[str] = set()
        level = {word}
        for _ in range(depth):
            after: set[str] = set()
            for w in level:
                score = self.score(w)
                found = {r for _, _, r in self.likelier(w, score)}
                if found or self.blind(score):
                    out.add(_bare(w))
                after |= found
            out |= {_bare(r) for r in after}
            level = after
        return out

    def believes(self, word: str, restored: str) -> bool:
        """A word that recurs as it stands is not taken for one that the corpus never has."""
        return restored.isascii() or self.seen.get(_bare(word), 0) < RECURS or _bare(restored) in self.seen

    def judge(self, word: str) -> tuple[int | None, str]:
        """The chain that garbled a word and the word restored; (None, word) for an ordinary
        one, (-2 - chain, word) for one whose chain cannot be inverted. A word may have
        gone through several chains; the last one is named."""
        first, current = None, word
        for _ in range(DEPTH):
            kind, restored = self._judge_once(current)
            if kind is None or kind < 0:
                return (kind, word) if first is None else (first, current)
            first, current = kind if first is None else first, restored
        return first, current

    def _judge_once(self, word: str) -> tuple[int | None, str]:
        score = self.score(word)
        found = self.inversions(word, score)
        if found:  # a chain that is not borne out needs a clear lead
            _, kind, restored = max(found, key=lambda x: (x[0] - (0 if x[1] in self.active else LEAST_GAIN), score[1 + x[1]]))
            return kind, restored
        if _bare(word) in self.words:
            return None, word
        blind = self.blind(score)
        return (-2 - max(blind, key=lambda i: score[1 + i]), word) if blind else (None, word)

    def is_word(self, restored: str) -> bool:
        """Whether a word of some length is an ordinary one of the corpus."""
        return len(bare := _bare(restored)) > 3 and bare in self.words

    def cover(self, restored: set[str]) -> float:
        return sum(self.letters.get(c, 0.0) for c in restored)


def _weights(words: dict[str, int]) -> np.ndarray:
    """Count the bigrams of the words as they are, and garbled with each chain."""
    counts = np.zeros((FEATURES, len(CHAINS) + 1))
    sizes = np.array(list(words.values()), np.float64)
    columns = [list(words)]
    for chain in CHAINS:
        made: list[str] = []
        for w in columns[0]:
            try:
                made.append(garble(w, chain))
            except UnicodeError:
                made.append("")
        columns.append(made)
    for k, made in enumerate(columns):
        raw = [f" {w} ".encode("utf-8", "surrogatepass") for w in made]
        at, feature = _bigrams(b"".join(raw))
        owner = np.searchsorted(np.cumsum([len(r) for r in raw]), at, side="right")
        counts[:, k] = np.bincount(feature, sizes[owner], FEATURES)
    smooth = counts * (counts[:, :1].sum() / np.maximum(counts.sum(axis=0), 1)) + 0.05  # one total for all, so that an unknown bigram tells nothing
    return np.log(smooth / smooth.sum(axis=0)).astype(np.float32)


def _shares(letters: dict[str, int]) -> dict[str, float]:
    total = max(1, sum(letters.values()))
    return {c: n / total for c, n in letters.items()}


def _claim(model: Model, word: str) -> tuple[int, list[int], list[str]] | None:
    """The likeliest chain of a word, all chains that restore the same, and the letters restored; None for an ordinary word."""
    found = model.inversions(word, model.score(word))
    best = max(found, default=None)
    if not best or not any(c > "\x7f" and c.isalpha() for c in best[2]):
        return None
    return best[1], [k for _, k, r in found if r == best[2]], sorted({c for c in best[2] if c > "\x7f"})  # equal restorations bear out all their chains


def _borne_out(shown: dict[int, set[str]], model: Model) -> frozenset[int]:
    return frozenset(k for k, c in shown.items() if model.cover(c) >= LEAST_COVER)


def _letters(words: dict[str, int]) -> dict[str, float]:
    out: Counter = Counter()
    for w, n in words.items():
        for c in w:
            if c > "\x7f":
                out[c] += n
    return _shares(out)


def train(words: dict[str, int]) -> Model | None:
    """``fit`` in memory, for words (word, number of times) that are both the sample and the corpus.

    The words are first taken as ordinary text. Then the chains that restore a fair
    share of the language's letters are found, the words they claim leave the
    ordinary ones, and the classifier is fitted again.
    """
    words = {w: n for w, n in words.items() if LOST not in w}
    if not words:
        return None
    seen: Counter = Counter()
    for w, n in words.items():
        seen[_bare(w)] += n
    model = Model(_weights(words), frozenset(range(len(CHAINS))), _letters(words), frozenset(), dict(seen))
    shown: dict[int, set[str]] = {}
    claimed: dict[str, int] = {}
    for w in words:
        if claim := _claim(model, w):
            claimed[w] = claim[0]
            for kind in claim[1]:
                shown.setdefault(kind, set()).update(claim[2])
    active = _borne_out(shown, model)
    left = {w: n for w, n in words.items() if claimed.get(w) not in active}
    return Model(_weights(left), active, _letters(left), frozenset(_bare(w) for w, n in left.items() if n > 1), dict(seen))


def _name(kind: int) -> str:
    if kind == -1:
        return "lost"
    return ("" if kind >= 0 else "unrestored ") + " ".join(f"{a}>{b}" for a, b in CHAINS[kind if kind >= 0 else -2 - kind])


def repair(text: str, model: Model | None, holes: dict[str, str], verdicts: dict[str, tuple[int, str, bool]]) -> tuple[str, list[str]]:
    """The text with all garbled words restored, and the chains found.

    ``holes`` has its words that lost characters, as they were; ``verdicts`` its
    garbled words: chain, restored word, whether that is an ordinary word.
    """
    lost = ["lost"] if LOST in text or holes else []
    taken = dict(holes)
    found: dict[int, set[str]] = {}
    for word in {w.decode("utf-8", "surrogatepass") for w in foreign_words(text)} if verdicts else ():
        if word in verdicts:
            found.setdefault(verdicts[word][0], set()).add(word)
    kinds = set()
    for kind, own in found.items():
        if kind >= 0 and kind not in model.active:
            shown = {c for w in own for c in verdicts[w][1] if c > "\x7f"}
            if len(shown) < 3 or model.cover(shown) < LEAST_COVER:
                own = {w for w in own if verdicts[w][2]}
                if not own:
                    continue
        kinds.add(kind)
        taken.update((w, verdicts[w][1]) for w in own)
    if not taken:
        return text, lost + sorted(map(_name, kinds))
    return "".join(taken.get(w, w) for w in _SPACE.split(text)), lost + sorted(map(_name, kinds))


#: A task keeps no more words than this at a time.
WORDS = 300_000


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words beyond ASCII: how often they are there, and how often in the drawn documents."""
    counts: Counter = Counter()
    drawn: Counter = Counter()

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([w.decode("utf-8", "surrogatepass") for w in counts], pa.string()), pa.array(list(counts.values()), pa.int64()), pa.array([drawn[w] for w in counts], pa.int64())], names=["word", "n", "drawn"])

    for b in batches:
        for text, of_sample in zip(b.column("text"), b.column("drawn")):
            own = [w for w in foreign_words(text.as_py()) if LOST_BYTES not in w]
            counts.update(own)
            if of_sample.as_py():
                drawn.update(own)
            if len(counts) > WORDS:
                yield out()
                counts.clear()
                drawn.clear()
    yield out()


def _asking(shared, depth: int):
    """``word, keys``: the words that their letters alone don't make ordinary, with what judging them looks up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            asked = [(w, sorted(k)) for w in b.column("word").to_pylist() if (k := shared.value.keys(w, depth))]
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in asked], pa.string()), pa.array([k for _, k in asked], pa.list_(pa.string()))], names=["word", "keys"])

    return run


def _answered(b: pa.RecordBatch, model: Model) -> list[str]:
    """The words of a batch; what they look up is put into the model."""
    held = [x for row in b.column("held").to_pylist() for x in row]
    model.seen = {x["key"]: x["n"] for x in held}
    model.words = frozenset(x["key"] for x in held if x["ordinary"])
    return b.column("word").to_pylist()


def _claims(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            claims = [(w, *c) for w in _answered(b, shared.value) if (c := _claim(shared.value, w))]
            yield pa.RecordBatch.from_arrays([pa.array([c[i] for c in claims], kind) for i, kind in enumerate((pa.string(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.string())))], names=["word", "kind", "kinds", "letters"])

    return run


def _verdicts(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            judged = [(w, *v, model.is_word(v[1])) for w in _answered(b, model) if (v := model.judge(w))[0] is not None]
            yield pa.RecordBatch.from_arrays([pa.array([v[i] for v in judged], kind) for i, kind in enumerate((pa.string(), pa.int32(), pa.string(), pa.bool_()))], names=["word", "kind", "restored", "ordinary"])

    return run


def _look_up(words: DataFrame, shared, depth: int, facts: DataFrame) -> DataFrame:
    """``word, held``: each word that may be garbled with the facts of all words it asks for."""
    asked = spread(words.select("word"), "word").mapInArrow(_asking(shared, depth), "word string, keys array<string>")
    met = asked.select("word", F.explode("keys").alias("key")).join(facts, "key")
    return met.groupBy("word").agg(F.collect_list(F.struct("key", "n", "ordinary")).alias("held"))


def fit(rows: DataFrame) -> tuple[Model, DataFrame, DataFrame] | None:
    """Of a table of ``id, text``: the model, ``word, kind, restored, ordinary`` of each
    garbled word, and ``form, whole`` of ordinary words by their form with lost characters
    (empty where several have it); None for a table without a word beyond ASCII.

    The weights are fitted on the words of ``TRAIN_DOCUMENTS`` documents. Words, their
    recurrences, letters and the chains borne out are counted over all documents, and
    words are looked up by joins, so a verdict rests on the whole table at any size.
    The driver gets the sample's words and one row for each chain and character.
    """
    context = rows.sparkSession.sparkContext
    n = rows.count()
    bound = min((1 << 63) - 1, (TRAIN_DOCUMENTS << 64) // max(1, n) - (1 << 63))  # of 64-bit hashes, so that any number of rows is drawn from alike
    drawn = rows.select("text", (F.xxhash64("id") <= F.lit(bound)).alias("drawn"))
    counted = drawn.mapInArrow(_count_words, "word string, n long, drawn long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("drawn").alias("drawn"))
    words = cut(counted.withColumn("key", F.btrim("word", F.lit(_ENDS))), "encodings-words")
    sample = {r["word"]: r["drawn"] for r in words.where("drawn > 0 and octet_length(word) <= 60").select("word", "drawn").collect()}
    if not sample and words.isEmpty():
        return None
    if not sample and n > TRAIN_DOCUMENTS:
        raise RuntimeError("no document drawn for the classifier has a word beyond ASCII; raise TRAIN_DOCUMENTS")

    first = context.broadcast(Model(_weights(sample), frozenset(range(len(CHAINS))), {}, frozenset(), {}))
    seen = words.groupBy("key").agg(F.sum("n").alias("n"), F.lit(False).alias("ordinary"))
    claims = cut(_look_up(words, first, 1, seen).mapInArrow(_claims(first), "word string, kind int, kinds array<int>, letters array<string>"), "encodings-claims")
    words = cut(words.join(claims.select("word", "kind"), "word", "left"), "encodings-words")
    letters = words.select("kind", "n", F.explode(F.split(F.regexp_replace("word", "[\\x00-\\x7f]", ""), "")).alias("c")).where("c <> ''").groupBy("kind", "c").agg(F.sum("n").alias("n")).collect()
    every, left = Counter(), Counter()
    for r in letters:
        every[r["c"]] += r["n"]
    shown: dict[int, set[str]] = {}
    for r in claims.select(F.explode("kinds").alias("k"), "letters").select("k", F.explode("letters").alias("c")).distinct().collect():
        shown.setdefault(r["k"], set()).add(r["c"])
    active = _borne_out(shown, Model(first.value.weight, frozenset(), _shares(every), frozenset(), {}))
    for r in letters:
        if r["kind"] not in active:
            left[r["c"]] += r["n"]

    claimed = F.coalesce(F.col("kind").isin(*active), F.lit(False)) if active else F.lit(False)
    for r in words.where((F.col("drawn") > 0) & claimed).select("word").collect():
        sample.pop(r["word"], None)
    model = Model(_weights(sample), active, _shares(left), frozenset(), {})
    shared = context.broadcast(model)
    facts = cut(words.groupBy("key").agg(F.sum("n").alias("n"), F.max((F.col("n") > 1) & ~claimed).alias("ordinary")), "encodings-facts")
    verdicts = cut(_look_up(words, shared, DEPTH, facts).mapInArrow(_verdicts(shared), "word string, kind int, restored string, ordinary boolean"), "encodings-verdicts")
    forms = facts.where("ordinary and length(key) > 1").groupBy(F.regexp_replace("key", "[^\\x00-\\x7f]", "?").alias("form"))
    return model, verdicts, cut(forms.agg(F.when(F.count("*") == 1, F.first("key")).otherwise("").alias("whole")), "encodings-forms")


def _suspects(shared):
    """The records that may have lost or garbled words, with those words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        asks: dict[bytes, bool] = {}
        for b in batches:
            keep, words, holes = [], [], []
            for i, text in enumerate(b.column("text")):
                text = text.as_py()
                own = []
                for raw in set(foreign_words(text)) if model else ():
                    if LOST_BYTES in raw:
                        continue
                    if (ask := asks.get(raw)) is None:
                        if len(asks) > WORDS:
                            asks.clear()
                        ask = asks[raw] = bool(model.keys(raw.decode("utf-8", "surrogatepass"), 1))
                    if ask:
                        own.append(raw.decode("utf-8", "surrogatepass"))
                lost = [(w, h) for w in set(_SPACE.split(text)) if (h := hole(w)) is not None] if model and ("?" in text or LOST in text) else []
                if own or lost or LOST in text:
                    keep.append(i)
                    words.append(own)
                    holes.append([{"word": w, "form": h} for w, h in lost])
            yield pa.RecordBatch.from_arrays([*b.take(pa.array(keep, pa.int64())).columns, pa.array(words, pa.list_(pa.string())), pa.array(holes, pa.list_(pa.struct([("word", pa.string()), ("form", pa.string())])))], names=["id", "text", "words", "holes"])

    return run


def _restore(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, made, chains = [], [], []
            for i, (text, held) in enumerate(zip(b.column("text"), b.column("held"))):
                text, held = text.as_py(), held.as_py() or []
                holes = {x["word"]: x["restored"] for x in held if x["kind"] is None}
                verdicts = {x["word"]: (x["kind"], x["restored"], x["ordinary"]) for x in held if x["kind"] is not None}
                restored, kinds = repair(text, shared.value, holes, verdicts)
                if kinds:
                    keep.append(i)
                    made.append(restored)
                    chains.append(", ".join(kinds))
            yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(keep, pa.int64())), pa.array(made, pa.string()), pa.array(chains, pa.string())], names=["id", "restored", "chain"])

    return run


def _of_rows(asked: DataFrame, answers: DataFrame, key: str) -> DataFrame:
    """The rows of ``asked`` that have an answer, with it; a key that many rows ask for is answered where they are."""
    counts = cut(counted_keys(asked, key).join(answers, key), "encodings-asked")
    total = counts.agg(F.sum("n")).first()[0] or 0
    held = semi_join_counted(asked, counts.select(key, "n"), key, total)
    return left_join_counted(held, counts, key, total)


def garbled(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, restored, chain``: the records with a wrongly decoded passage, their text with
    every word restored that can be, and the chains found (``lost``: characters were replaced).

    Whole texts are read to count words beyond ASCII and to find the records that may be
    garbled; each distinct word is judged once, and the verdicts are joined to the
    records that ask for them. A chain that the corpus does not bear out is believed in
    a document that does. Cases: null and empty texts and null ids give no row; rows
    delivered twice count once; an empty table gives no rows; other columns are ignored.
    """
    context = df.sparkSession.sparkContext
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).where("id is not null and text is not null")
    beyond = F.length("text") != F.octet_length("text")
    fitted = fit(spread(rows.where(beyond), "id"))
    shared = context.broadcast(fitted and fitted[0])
    kind = rows.schema["id"].dataType.simpleString()
    found = spread(rows.where(beyond | F.contains("text", F.lit("?"))), "id").mapInArrow(_suspects(shared), f"id {kind}, text string, words array<string>, holes array<struct<word:string,form:string>>")
    records = cut(found.withColumn("at", F.monotonically_increasing_id()), "encodings-records")
    if fitted:
        words = _of_rows(records.select("at", F.explode("words").alias("word")), fitted[1], "word").select("at", "word", "kind", "restored", "ordinary")
        holes = _of_rows(records.select("at", F.explode("holes").alias("x")).select("at", "x.word", "x.form"), fitted[2], "form")
        core = F.btrim("word", F.lit(_CORE_ENDS))
        whole = F.when(F.col("whole") == "", F.col("word")).otherwise(F.replace("word", core, F.col("whole")))
        holes = holes.select("at", "word", F.lit(None).cast("int").alias("kind"), whole.alias("restored"), F.lit(True).alias("ordinary"))
        held = words.unionByName(holes).groupBy("at").agg(F.collect_list(F.struct("word", "kind", "restored", "ordinary")).alias("held"))
        records = records.join(held, "at", "left")
    else:
        records = records.withColumn("held", F.lit(None).cast("array<struct<word:string,kind:int,restored:string,ordinary:boolean>>"))
    return records.select("id", "text", "held").mapInArrow(_restore(shared), f"id {kind}, restored string, chain string").distinct()
