import pytest

from autuario.llm import names as N


@pytest.mark.parametrize("spelling, parts, suffix", [
    ("MIN. HELENA ALBERTO PENCA BAFOMEZZI", ("HELENA", "ALBERTO", "PENCA", "BAFOMEZZI"), ""),
    ("DES. SUBST. FLAVIA DA TILHU DELIFORBI", ("FLAVIA", "TILHU", "DELIFORBI"), ""),
    ("BENENINDI NETO, JOSE REGINA DA CILFU", ("JOSE", "REGINA", "CILFU", "BENENINDI"), "NETO"),
    ("GARBE BROGRIMONDRA JUNIOR, BENICIO L.", ("BENICIO", "L.", "GARBE", "BROGRIMONDRA"), "JUNIOR"),
    ("DALVA DOS VARBE DADADINCI - REL. P/ ACORDAO", ("DALVA", "VARBE", "DADADINCI"), ""),
    ("PATRICIA LUISA BENCA-MILIBRIZZI (RELATOR)", ("PATRICIA", "LUISA", "BENCA", "MILIBRIZZI"), ""),
    ("J.E DA GROSCO BRALAFANDA", ("JE.", "GROSCO", "BRALAFANDA"), ""),
    ("ΖELIA  CARLOS​ MОRАTRONDІ", ("ZELIA", "CARLOS", "MORATRONDI"), ""),
])
def test_parse(spelling, parts, suffix):
    assert N.parse(spelling) == N.Name(parts, suffix)


@pytest.mark.parametrize("text", ["", "  ", "...", "(RELATOR)", ",", "-"])
def test_parse_of_nothing(text):
    assert N.parse(text) is None


def test_one_edit():
    for a, b in (("DALVA", "DALA"), ("GARBE", "GABRE"), ("LUIS", "LUISA"), ("TARTE", "TARSE")):
        assert N.one_edit(a, b) and N.one_edit(b, a)
    for a, b in (("DALVA", "DALVA"), ("ALBERTO", "ROBERTO"), ("", "AB"), ("ABCD", "BADC")):
        assert not N.one_edit(a, b)


PEOPLE = {
    1: ["CLARICE RODRIGO BENCA BRITRENERLI"] * 9 + ["C. R. BENCA BRITRENERLI", "BRITRENERLI, CLARICE RODRIGO BENCA", "CLARACE RODRIGO BENCA BRITRENERLI", "MINISTRA CLARICE RODRIGO BENCA BRITRENERLI", "CLARICE BRITRENERLI", "CLARICE RODRIGO BENCA BRITRENELRI"],
    2: ["CLARICE RODRIGO BENCA BRITRENERLI JUNIOR"] * 4 + ["CLARICE R. BENCA BRITRENERLI JR."],
    3: ["FRANCISCO MARIA DA TRINDU RETREBRILHI"] * 5 + ["CHICO DA TRINDU RETREBRILHI", "TRINDU RETREBRILHI, FRANCISCO M.", "FCO. MARIA RETREBRILHI", "FRANCISCO MARIA DA TRINDU REIREBRILHI"],
    4: ["GERALDO MARIA DA TRINDU RETREBRILHI"] * 5,
    5: ["PATRICIA LUISA PENCA TARAPINTI"] * 3 + ["PATRICIA LUISA PENSSA TARAPINTI", "PАTRICІA LUISA PENCA TARAPINTI"],
}


def test_spellings_of_one_person_are_linked(spark, rows):
    data = [(s, "x", 1) for own in PEOPLE.values() for s in own] + [(None, "x", 1), ("", "x", 1), ("  ", "x", 1), ("...", "x", 1)]
    df = spark.createDataFrame(data, "relator string, person string, n int")
    want = sorted({(min(a, b), max(a, b)) for own in PEOPLE.values() for a in own for b in own if a != b}, key=str)
    assert rows(N.same_person(df, "relator")) == want


def test_large_blocks_are_paired_in_parts(spark, rows, monkeypatch):
    df = spark.createDataFrame([(s,) for own in PEOPLE.values() for s in own], "relator string")
    want = rows(N.same_person(df, "relator"))
    monkeypatch.setattr(N, "BLOCK", 2)
    assert rows(N.same_person(df, "relator")) == want


@pytest.mark.parametrize("said, true, made", [
    ("HEITORZINHO", "HEITOR", True), ("CLARINHA", "CLARA", True), ("NANDO", "FERNANDO", True), ("GABRI", "GABRIELA", True), ("ANITA", "ANA", False), ("MARIA", "MARTA", False), ("ZINHO", "JOAO", False), ("LIA", "JULIA", False),
])
def test_familiar_forms_by_rule(said, true, made):
    assert N._made_familiar(said, true) is made


def test_roots_are_found_or_an_error(spark):
    df = spark.createDataFrame([(s,) for s in PEOPLE[1]], "relator string")
    with pytest.raises(RuntimeError, match="still move"):
        N.attribute(df, "relator", max_rounds=0)


def test_empty_table(spark, rows):
    assert rows(N.same_person(spark.createDataFrame([], "relator string"), "relator")) == []
