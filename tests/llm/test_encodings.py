import random
from collections import Counter

import pytest
from hypothesis import given
from hypothesis import strategies as st

from autuario.llm import encodings as E

SENTENCES = [
    "A câmara julgadora não explicou a notificação da pensão mensal.", "O município é responsável pela área comum e pelos honorários.", "Em razão da vulnerabilidade técnica, a ação é procedente.",
    "O condomínio recebeu a prótese à vista dos autos, até a decisão.", "À luz da boa-fé objetiva, o usufruto vitalício permanece.", "DECISÃO DA CÂMARA DE DIREITO PÚBLICO EM MANDADO DE SEGURANÇA.",
    "O contêiner e a perícia técnica têm preferência: três ocasiões.", "A união de fato após a notificação só gera indenização às partes.",
]
DECOYS = ["Fixou-se por Ângela Çamão, síndica.", "O coeficiente β foi fixado.", "O frete foi cotado em € 310.", "A carga chegou a 38 °C.", "O quadro │ parcela │ valor │ está no anexo.", "A marca ΔΟΜΟΣ e o rótulo 東港.", "A embalagem dizia “uso externo” — e nada mais.", "art. 7º, § 2º, fração ½…", "a palavra грузополучатель"]


def documents(n=600, seed=1):
    draw = random.Random(seed)
    rows = []
    for k in range(n):
        text = "\r\n".join(draw.choice(SENTENCES) for _ in range(8))
        if k % 6 == 0:
            text += "\n" + draw.choice(DECOYS)
        rows.append((k, text, "x"))
    return rows


CHAINS = [(("utf-8", "cp1252"),), (("utf-8", "latin-1"),), (("utf-8", "mac_roman"),), (("cp1252", "cp850"),), (("cp1252", "cp1251"),), (("utf-8", "cp1252"), ("utf-8", "cp1252"))]


def test_garbled_documents_are_found_and_restored(spark):
    draw = random.Random(2)
    rows, truth, original = [], {}, {}
    for k, text, x in documents():
        if k % 10 == 3:
            chain = draw.choice(CHAINS)
            lines = text.split("\r\n")
            lines[2] = E.garble(lines[2], chain)
            truth[k], original[k] = chain, text
            text = "\r\n".join(lines)
        rows.append((k, text, x))
    rows += [(9005, "O munic?pio pagou?", "x"), (9006, "Quem pagou? Nada.", "x"), (9007, "a notifica��o da pens�o", "x"), (9001, None, "x"), (9002, "", "x"), (9003, "ASCII", "x"), (None, SENTENCES[0], "x"), (9004, "perdi�o", "x"), rows[3]]
    df = spark.createDataFrame(rows, "doc_id long, text string, restored string")
    got = {r["id"]: r for r in E.garbled(df, "doc_id", "text").collect()}
    assert set(got) == set(truth) | {9004, 9005, 9007}
    assert got[9004]["chain"] == "lost" and got[9005]["restored"] == "O município pagou?" and got[9007]["restored"] == "a notificação da pensão"
    assert sum(got[k]["restored"] == original[k] for k in truth) >= 0.95 * len(truth)
    assert E.garbled(df.limit(0), "doc_id", "text").collect() == []


@pytest.mark.parametrize("chain", E.CHAINS)
def test_chains_are_inverted(chain):
    text = "notificação, é à ÇÃO"
    try:
        wrong = E.garble(text, chain)
    except UnicodeError:
        return
    assert wrong != text and E.invert(wrong, chain) == text


@given(st.text(max_size=60))
def test_inversion_is_strict(text):
    for chain in E.CHAINS[:12]:
        back = E.invert(text, chain)
        if back is not None:
            assert E.garble(back, chain) == text


def test_held_out_accuracy():
    words = Counter()
    for _, t, _ in documents(300, 3):
        words.update(w.decode() for w in E.foreign_words(t))
    for s in SENTENCES[:6]:
        for chain in CHAINS:
            words.update(w.decode() for w in E.foreign_words(E.garble(s, chain)))
    model = E.train(words)
    right = total = 0
    for s in SENTENCES[6:]:
        for chain in CHAINS:
            for w in E.foreign_words(E.garble(s, chain)):
                total += 1
                kind, restored = model.judge(w.decode())
                right += kind is not None and restored in s
    clean = [w.decode() for s in SENTENCES + DECOYS for w in E.foreign_words(s)]
    assert right >= 0.9 * total and not [w for w in clean if model.judge(w)[0] in model.active]


def test_verdicts_rest_on_all_documents(spark, monkeypatch):
    """What the bigrams' sample does not hold counts as well: lost characters, and restorations of words that recur."""
    monkeypatch.setattr(E, "TRAIN_DOCUMENTS", 200)
    rows = [(k, text) for k, text, _ in documents()]
    names = [a + b for a in ("bar", "cor", "dal", "fen") for b in ("mi", "ru", "to", "ve", "sa")]
    rows += [(1000 + k, f"A {w}ção foi paga.") for k, w in enumerate(names * 2)]  # each twice
    lost = {2000 + k: (f"A {w}??o foi paga.", f"A {w}ção foi paga.") for k, w in enumerate(names)}
    again = {3000 + k: (f"O {w}rão foi lido.".replace("ã", "Ã£"), f"O {w}rão foi lido.") for k, w in enumerate(names * 8)}
    rows += [(4000 + k, f"O {w}rão foi lido.") for k, w in enumerate(names * 2)]  # each restoration twice
    planted = lost | again
    rows += [(k, text) for k, (text, _) in planted.items()]
    got = {r["id"]: r["restored"] for r in E.garbled(spark.createDataFrame(rows, "id long, text string"), "id", "text").collect()}
    assert got == {k: original for k, (_, original) in planted.items()}


def test_distributed_fit_is_the_fit_in_memory(spark):
    draw = random.Random(4)
    texts = [E.garble(t, draw.choice(CHAINS)) if k % 9 == 2 else t for k, t, _ in documents(200, 4)]
    model, verdicts, forms = E.fit(spark.createDataFrame(list(enumerate(texts)), "id long, text string"))
    words = Counter(w.decode() for t in texts for w in E.foreign_words(t))
    whole = E.train(words)
    judged = {w: v for w in words if (v := whole.judge(w))[0] is not None}
    assert judged and {r["word"]: (r["kind"], r["restored"]) for r in verdicts.collect()} == judged
    assert model.active == whole.active and model.letters == whole.letters
    assert {r["whole"] for r in forms.collect()} - {""} <= whole.words
