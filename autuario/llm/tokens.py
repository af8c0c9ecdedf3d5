"""Encoding of whole texts with a public byte-level BPE, chunk by chunk.

A rolling hash over the bytes before each run of blanks decides where a text is cut
into chunks, so that equal passages of different texts fall into equal chunks. Each
distinct chunk that a task meets is encoded once. The pre-tokenizer breaks before
every run of blanks, so chunks joined there agree with the whole text's encoding; in
a long run without blanks, where a cut may fall inside a token, the open end of a
chunk is encoded again together with the next one, until a break confirms it.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from autuario.llm.words import mix, pieces, powers
from autuario.runtime import spread

# Fixed value: the pre-tokenizer of the vocabulary byte_bpe_50k.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_BLANKS = frozenset(b" \t\n\r\x0b\x0c")
BLANK = regex.compile(r"\s")
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: One blank run in so many ends a chunk.
CUT_EVERY = 2
#: Bytes of the rolling hash's window.
WINDOW = 8
#: A run of so many bytes without a blank is cut anyway, and its joins repaired.
BLANKLESS = 8192
#: Bytes of known chunks a task keeps.
CACHE_BYTES = 96_000_000


def vocabulary(name: str = "byte_bpe_50k.tiktoken") -> str:
    """The place of a public vocabulary file."""
    try:
        import public_tokenizers

        return public_tokenizers.path(name)
    except ImportError:
        return f"/opt/tokenizers/{name}"


@lru_cache(2)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f)}
    return tiktoken.Encoding("byte-bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(2)
def _widths(path: str) -> np.ndarray:
    """How many bytes each id stands for."""
    encoding = _encoding(path)
    width = np.zeros(encoding.n_vocab, np.int64)
    for token, rank in encoding._mergeable_ranks.items():
        width[rank] = len(token)
    return width


def cuts(raw: np.ndarray) -> np.ndarray:
    """Where chunks begin: before those runs of ASCII blanks whose preceding bytes hash to a cut."""
    n = len(raw)
    blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
    seen = (raw > 32) & (raw < 127)  # so that the run of blanks has not begun before
    at = np.flatnonzero(blank[1:] & seen[:-1]) + 1
    at = at[at >= WINDOW]
    if not len(at):
        return at
    window = np.lib.stride_tricks.sliding_window_view(raw, WINDOW)[at - WINDOW]
    value = np.ascontiguousarray(window).view(np.uint64).reshape(-1)
    return at[mix(value) % np.uint64(CUT_EVERY) == 0]


class Encoder:
    """Encodes texts, keeping what chunks encode to.

    A chunk is found by a 64-bit hash of its bytes; its bytes themselves are compared
    before its ids are used. The ids and bytes of all known chunks lie in two pools,
    from which a batch's are gathered.
    """

    def __init__(self, path: str):
        self.encoding = _encoding(path)
        self.width = _widths(path)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[int, int] = {}
        self.pool, self.text = np.zeros(1 << 16, np.int32), np.zeros(1 << 18, np.uint8)
        self.first, self.size, self.begin, self.bytes = (np.zeros(1 << 12, np.int64) for _ in range(4))
        self.filled = 0

    def _learn(self, keys: list[int], chunks: list[bytes]) -> np.ndarray:
        """Encode chunks not met before; their slots.

        The pre-tokenizer breaks where a blank follows anything else. So chunks that
        begin with a blank and end in none are encoded in one call, and the ids dealt
        out by the bytes they stand for; where these don't end with a chunk, and all
        other chunks, are encoded one by one.
        """
        texts = [c.decode("utf-8") for c in chunks]
        joint = [k for k, (c, t) in enumerate(zip(chunks, texts)) if c[0] in _BLANKS and len(c) <= BLANKLESS and not BLANK.match(t[-1])]
        ids: list[np.ndarray | None] = [None] * len(chunks)
        if joint:
            together = self.encoding.encode_to_numpy("".join(texts[k] for k in joint), disallowed_special=()).astype(np.int32)
            ends = np.cumsum([len(chunks[k]) for k in joint])
            spans = np.cumsum(self.width[together])
            edges = np.searchsorted(spans, ends, side="right")
            agree = spans[edges - 1] == ends
            agree[1:] &= agree[:-1]
            for k, part, ok in zip(joint, np.split(together, edges[:-1]), agree):
                ids[k] = part if ok else None
        for k, t in enumerate(texts):
            if ids[k] is None:
                ids[k] = self._alone(t)
        new = np.concatenate(ids)
        sizes, lengths = np.array([len(x) for x in ids], np.int64), np.array([len(c) for c in chunks], np.int64)
        slots = np.arange(self.filled + 1, self.filled + 1 + len(chunks))
        at, to = int(self.first[self.filled] + self.size[self.filled]), int(self.begin[self.filled] + self.bytes[self.filled])
        while slots[-1] >= len(self.first):
            self.first, self.size, self.begin, self.bytes = (np.concatenate([x, np.zeros_like(x)]) for x in (self.first, self.size, self.begin, self.bytes))
        if at + len(new) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(len(self.pool), len(new)), np.int32)])
        raw = np.frombuffer(b"".join(chunks), np.uint8)
        if to + len(raw) > len(self.text):
            self.text = np.concatenate([self.text, np.zeros(max(len(self.text), len(raw)), np.uint8)])
        self.pool[at : at + len(new)], self.text[to : to + len(raw)] = new, raw
        self.first[slots], self.size[slots] = at + np.cumsum(sizes) - sizes, sizes
        self.begin[slots], self.bytes[slots] = to + np.cumsum(lengths) - lengths, lengths
        self.filled = int(slots[-1])
        self.known.update(zip(keys, slots.tolist()))
        return slots

    def _alone(self, text: str) -> np.ndarray:
        """The ids of a chunk by itself."""
        return self._blankless(text) if len(text) > BLANKLESS else self.encoding.encode_to_numpy(text, disallowed_special=()).astype(np.int32)

    def _blankless(self, text: str) -> np.ndarray:
        """Encode a long chunk in steps; the open end of a step is encoded again with the next."""
        out, begin, end = [], 0, 0
        while end < len(text):
            end = min(end + BLANKLESS, len(text))
            breaks = [m.start() for m in regex.finditer(PATTERN, text, pos=begin, endpos=end)][1:-1]
            breaks = [k for k in breaks if not text[k - 1].isspace()]  # blanks before a break may belong to what follows
            sure = end if end == len(text) else breaks[-1] if breaks else begin
            if sure > begin:
                out += self.encoding.encode_ordinary(text[begin:sure])
                begin = sure
        return np.array(out, np.int32)

    def batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids) of the texts; null and empty ones have no ids."""
        raws = [(t or "").encode("utf-8") for t in texts]
        joined = b"".join(raws)
        raw = np.frombuffer(joined, np.uint8)
        ends = np.cumsum([len(r) for r in raws])
        if not len(raw):
            return np.zeros(len(texts) + 1, np.int64), np.zeros(0, np.int32)
        starts = np.unique(np.concatenate([cuts(raw), ends - [len(r) for r in raws], [0]])).astype(np.int64)
        starts = starts[starts < len(raw)]
        length = np.diff(np.concatenate([starts, [len(raw)]]))
        place = np.arange(len(raw)) - np.repeat(starts, length)
        value = np.add.reduceat((raw + np.uint64(1)) * powers(_BASE, int(length.max()))[place], starts)
        key = mix(value + length.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        distinct, example, which = np.unique(key, return_index=True, return_inverse=True)
        if len(self.known) * 160 + 4 * self.first[self.filled] + self.begin[self.filled] > CACHE_BYTES:
            self._forget()
        keys = distinct.tolist()
        slots = np.fromiter((self.known.get(k, 0) for k in keys), np.int64, len(keys))
        new = np.flatnonzero(self.bytes[slots] != length[example])
        if len(new):
            at, to = starts[example[new]].tolist(), (starts + length)[example[new]].tolist()
            slots[new] = self._learn([keys[i] for i in new.tolist()], [joined[a:b] for a, b in zip(at, to)])
        mine = slots[which]
        at = np.minimum(np.repeat(self.begin[mine] - starts, length) + np.arange(len(raw)), len(self.text) - 1)
        differ = np.searchsorted(starts, np.flatnonzero(self.text[at] != raw), side="right") - 1
        for k in np.union1d(differ, np.flatnonzero(self.bytes[mine] != length)).tolist():  # chunks whose hash another one has
            mine[k] = self._learn([-1], [joined[starts[k] : starts[k] + length[k]]])[0]
        size = self.size[mine]
        total = np.concatenate([[0], np.cumsum(size)])
        ids = self.pool[np.repeat(self.first[mine] - total[:-1], size) + np.arange(total[-1])]
        return np.concatenate([[0], total[np.searchsorted(starts, ends)]]), ids


def _encode(path: str, lengths: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        for b in batches:
            texts = b.column("text").to_pylist()
            for part in pieces(texts):
                offsets, ids = encoder.batch([texts[i] for i in part])
                if lengths:
                    made = pa.array(np.diff(offsets), pa.int64())
                else:
                    made = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids))
                yield pa.RecordBatch.from_arrays([b.column("id").slice(part.start, len(part)), made], names=["id", "ids"])

    return run


def encode(df: DataFrame, id_col: str, text_col: str, path: str | None = None) -> DataFrame:
    """``id, ids``: each record's text as ids of the vocabulary, without special tokens.

    One pass without a shuffle. Cases: null and empty texts have an empty list; a
    record with a null id has ids, too; rows delivered twice come out twice; an empty
    table gives no rows; other columns are ignored.
    """
    return _run(df, id_col, text_col, path, False, "array<int>")


def token_counts(df: DataFrame, id_col: str, text_col: str, path: str | None = None) -> DataFrame:
    """``id, tokens``: the number of ids ``encode`` gives; cases as there."""
    return _run(df, id_col, text_col, path, True, "long").withColumnRenamed("ids", "tokens")


def _run(df: DataFrame, id_col: str, text_col: str, path: str | None, lengths: bool, kind: str) -> DataFrame:
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return spread(rows, "id").mapInArrow(_encode(path or vocabulary(), lengths), f"id {rows.schema['id'].dataType.simpleString()}, ids {kind}")
