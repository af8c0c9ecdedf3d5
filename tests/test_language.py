import pytest

from autuario.errors import EngineError
from autuario.functions.text import fold_literal, token_literal
from autuario.plans.engine import decode_cursor, encode_cursor
from autuario.plans.language import Leaf, Node, broadened, cut_prefixes, leaves, parse_advanced, parse_simple, refusals


def show(tree):
    if tree is None:
        return ""
    if isinstance(tree, Leaf):
        return " ".join(tree.tokens) + "*" * tree.prefix
    return "(" + f" {tree.kind} ".join(map(show, tree.parts)) + ")"


@pytest.mark.parametrize("query, want", [
    ("a b", "(a and b)"), ("a OU b c", "(a or (b and c))"), ("(a ou b) e c", "((a or b) and c)"), ('"um dois" prefix*', "(um dois and prefix*)"), ('"e" a', "(e and a)"),
    ("", ""), ("alimentos?", "alimentos"), ("pós-graduação", "pos graduacao"), ("não", "nao"),
])
def test_advanced(query, want):
    assert show(parse_advanced(query)) == want


@pytest.mark.parametrize("query", ["a OU", "(a", "a)", "NOT a", "a NEAR/3 b", "NÃO a", "*", "a**", '"a', "OU", "x" * 501, " ".join(["a"] * 31), "(" * 10 + "a" + ")" * 10])
def test_refused(query):
    with pytest.raises(EngineError) as x:
        parse_advanced(query)
    assert x.value.code == "consulta_invalida"


def test_simple():
    assert show(parse_simple("partilha de bens")) == "(partilha or bens)"
    assert show(parse_simple("partilha de bens", ranked=False)) == "(partilha and de and bens)"
    assert show(parse_simple("de que")) == "(de and que)"
    assert show(parse_simple('"partilha de bens"')) == "partilha de bens"
    assert show(parse_simple("não há seu direito à prova")) == "(direito or prova)"
    assert show(broadened(parse_simple("a1 de b1", ranked=False))) == "(a1 or b1)" and show(broadened(parse_simple("de que", ranked=False))) == "(de or que)"
    assert leaves(None) == [] and isinstance(parse_advanced("a a"), Node) and len(leaves(parse_advanced("a a"))) == 1


def test_folds_are_kept_apart():
    assert fold_literal("10ª Câmara") == "10A CAMARA" and token_literal("10ª Câmara É") == ["10ª", "camara", "e"]


def test_cursor():
    p = {"q": "á", "o": "newest"}
    assert decode_cursor(encode_cursor(p, 16), p) == 16 and decode_cursor(None, p) == 0
    for cursor, params in ((encode_cursor(p, 1), {"q": "b"}), ("%%%", p), ("e30", p)):
        with pytest.raises(EngineError):
            decode_cursor(cursor, params)


def test_prefixes_and_refusals():
    assert show(cut_prefixes(parse_advanced('prorrogação OU (mora "de fato" usuc*)'), 5)) == "(prorr* or (mora and de fato and usuc*))"
    assert refusals(["a b", "x " * 40, '"a']) == {"accepted": 1, "consulta_invalida": 2} and refusals(["a OU"], advanced=True) == {"consulta_invalida": 1}
