import random

from hypothesis import given, settings
from hypothesis import strategies as st

from autuario.llm import tokens as T
from autuario.llm.packing import best_fit, improve, pack, pour

ENCODER = T.Encoder(T.vocabulary())
PLAIN = T._encoding(T.vocabulary())
TEXTS = [
    None, "", " ", "\n\n", "A ação é boa. " * 300, "x" * 20_000, "é" * 20_000, "don't  stop\t\n now" * 300, "東京" * 9000, "ab\xa0\n\nx" * 3000, "<|endoftext|> fim",
    "".join(random.Random(1).choice(" \n\tab,1é東\xa0　") for _ in range(30_000)), "".join(random.Random(2).choice("ab,1é東\xa0 ") for _ in range(30_000)),
]


def check(texts):
    offsets, ids = ENCODER.batch(texts)
    for k, t in enumerate(texts):
        assert ids[offsets[k] : offsets[k + 1]].tolist() == PLAIN.encode_ordinary(t or "")


def test_ids_agree_with_the_whole_text():
    check(TEXTS)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=200), max_size=5))
def test_ids_agree_on_any_text(texts):
    check(texts)


ENDS = ["Recurso de agravo\n", "\n\nvoto vencido da turma\n", "fim do texto\n", "\n\ncaso em exame\n", "caso  ", "  caso em exame", "caso em exame\xa0", "\u3000 caso", " \n", "\x85\n caso em exame \x85", "\t", "ação em exame \u2003"]


def test_texts_that_begin_and_end_in_blanks_in_any_order():
    draw = random.Random(4)
    for _ in range(40):
        texts = [draw.choice(ENDS) * draw.randrange(1, 4) for _ in range(draw.randrange(1, 30))]
        encoder = T.Encoder(T.vocabulary())
        at = 0
        while at < len(texts):  # several batches, so that what an earlier one learnt is used again
            part = texts[at : at + draw.randrange(1, 12)]
            at += len(part)
            offsets, ids = encoder.batch(part)
            for k, t in enumerate(part):
                assert ids[offsets[k] : offsets[k + 1]].tolist() == PLAIN.encode_ordinary(t), (texts, t)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.text(alphabet=" \n\t\xa0\u3000\x85abé1,'", max_size=40), max_size=6), max_size=3))
def test_fresh_encoders_on_blanks(batches):
    encoder = T.Encoder(T.vocabulary())
    for texts in batches:
        offsets, ids = encoder.batch(texts)
        for k, t in enumerate(texts):
            assert ids[offsets[k] : offsets[k + 1]].tolist() == PLAIN.encode_ordinary(t)


def test_chunks_with_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(T, "mix", lambda x: x * 0 + x.dtype.type(5))  # every chunk has the same hash
    encoder = T.Encoder(T.vocabulary())
    texts = ["um texto", "xx texto", "um texto mais longo", "z", "", "um texto"]
    for part in (texts, texts[::-1]):
        offsets, ids = encoder.batch(part)
        assert [ids[offsets[k] : offsets[k + 1]].tolist() for k in range(len(part))] == [PLAIN.encode_ordinary(t) for t in part]


def test_agrees_with_another_library():
    from tokenizers import Tokenizer

    other = Tokenizer.from_file(T.vocabulary("byte_bpe_50k.json"))
    other.encode_special_tokens = True
    own = [t or "" for t in TEXTS if t is None or len(t) < 10_000]
    offsets, ids = ENCODER.batch(own)
    for k, e in enumerate(other.encode_batch(own, add_special_tokens=False)):
        assert ids[offsets[k] : offsets[k + 1]].tolist() == e.ids


def test_table(spark, rows):
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(TEXTS)] + [(None, "fim", "x")], "doc_id long, text string, ids string")
    got = {r["id"]: r["ids"] for r in T.encode(df, "doc_id", "text").collect()}
    assert got == {k: PLAIN.encode_ordinary(t or "") for k, t in enumerate(TEXTS)} | {None: PLAIN.encode_ordinary("fim")}
    assert dict(rows(T.token_counts(df, "doc_id", "text"))) == {k: len(v) for k, v in got.items()}
    assert rows(T.encode(df.limit(0), "doc_id", "text")) == []


def test_local_search_keeps_items_and_never_adds_bins():
    draw = random.Random(3)
    for _ in range(30):
        sizes = [draw.randrange(1, 100) for _ in range(draw.randrange(0, 300))]
        before = best_fit(sizes, 100)
        after = improve([list(b) for b in before], sizes, 100)
        assert sorted(i for b in after for i in b) == list(range(len(sizes))) and len(after) <= len(before)
        assert all(sum(sizes[i] for i in b) <= 100 for b in after)
        flexible = [draw.random() < 0.5 for _ in sizes]
        poured = pour([[(i, sizes[i]) for i in b] for b in after], flexible, 100)
        assert len(poured) <= len(after) and all(0 < sum(s for _, s in b) <= 100 for b in poured)
        for i, s in enumerate(sizes):
            parts = [x for b in poured for k, x in b if k == i]
            assert sum(parts) == s and (flexible[i] or len(parts) == 1)


def test_swaps_empty_a_bin():
    sizes = [60, 30, 50, 39, 11, 10]
    assert len(improve([[0, 1], [2, 3], [4], [5]], sizes, 100)) <= 3


def test_packing_table(spark):
    draw = random.Random(4)
    data = [(k, draw.choice([0, 1, 100, 255, 256, 257, 5000, draw.randrange(3000)])) for k in range(400)]
    items = spark.createDataFrame([*data, data[0], (None, 5), (999, None)], "id long, tokens long")
    kinds = spark.createDataFrame([("a", 256), ("b", 1000), ("c", 0), (None, 5)], "container string, capacity int")
    placed = pack(items, kinds).collect()
    for kind, capacity in (("a", 256), ("b", 1000)):
        own = [r for r in placed if r["container"] == kind]
        bins, texts = {}, {}
        for r in own:
            bins.setdefault(r["bin"], []).append(r)
            texts.setdefault(r["id"], []).append(r)
        for b in bins.values():
            b.sort(key=lambda r: r["position"])
            assert [r["position"] for r in b] == list(range(len(b))) and sum(r["tokens"] for r in b) <= capacity
            at = 0
            for r in b:
                assert r["place"] == at
                at += r["tokens"]
        assert set(texts) == {k for k, _ in data}
        for k, n in data:
            parts = sorted(texts[k], key=lambda r: r["piece"])
            assert [r["piece"] for r in parts] == list(range(len(parts))) and (len(parts) == 1 or n > capacity)
            at = 0
            for r in parts:
                assert r["start"] == at
                at += r["tokens"]
            assert at == n
        assert len(bins) <= -(-sum(n for _, n in data) // capacity) * 1.03 + 2
    assert {r["container"] for r in placed} == {"a", "b"}
    assert pack(items.limit(0), kinds).collect() == []


def test_local_search_ends_where_no_exchange_helps():
    draw = random.Random(5)
    sizes = [draw.randint(140, 420) for _ in range(400)]
    bins = improve(best_fit(sizes, 1000), sizes, 1000)
    assert sorted(i for b in bins for i in b) == list(range(400)) and len(bins) <= 115
    fill = [sum(sizes[i] for i in b) for b in bins]
    for a, own in enumerate(bins):
        for b, other in enumerate(bins):
            if a != b and fill[a] < 1000 and fill[b] < 1000:
                gains = {sizes[j] - out for j in other for out in [0, *(sizes[i] for i in own), *(sizes[i] + sizes[k] for i in own for k in own if i < k)]}
                gains |= {sizes[j] + sizes[k] - sizes[i] for j in other for k in other if j < k for i in own}
                assert not [g for g in gains if 0 < g <= 1000 - fill[a] and fill[a] + g > fill[b]]
