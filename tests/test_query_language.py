import pytest

from gleaner.plans.nodes import And, Not, Or, Phrase, QueryError, Term, expand, positive_tokens, prune, validate
from gleaner.plans.parser import Kind, lex, parse

A, B, C = Term("alpha"), Term("beta"), Term("gamma")


def test_lexer():
    kinds = [x.kind for x in lex('alpha and (beta or not "gamma delta")')]
    assert kinds == [Kind.TERM, Kind.AND, Kind.OPEN, Kind.TERM, Kind.OR, Kind.NOT, Kind.PHRASE, Kind.TERM, Kind.TERM, Kind.PHRASE_END, Kind.CLOSE, Kind.EOF]
    assert [x.text for x in lex("cat the AND dog")] == ["cat", "dog", ""]


@pytest.mark.parametrize(
    "query, tree",
    [
        ("alpha", A),
        ("ALPHA", A),
        ("alpha and beta or gamma", Or((And((A, B)), C))),
        ("(alpha or beta) and gamma", And((Or((A, B)), C))),
        ("alpha beta gamma", And((A, B, C))),
        ("alpha beta or gamma alpha", Or((And((A, B)), And((C, A))))),
        ('"alpha beta" and not gamma', And((Phrase(("alpha", "beta")), Not(C)))),
        ("((alpha))", A),
        ("not not alpha", Not(Not(A))),
        ('"alpha the beta"', Phrase(("alpha", "beta"))),
        ("alpha AND beta", And((A, B))),
    ],
)
def test_parser(query, tree):
    assert parse(query) == tree


@pytest.mark.parametrize(
    "query, message",
    [
        ("  ", "query contains no searchable terms"),
        ("the of", "query contains no searchable terms"),
        ("cat )", 'unexpected token ")"'),
        ("cat and the", "expected expression after AND"),
        ("cat or", "unexpected end of query"),
        ("not", "unexpected end of query"),
        ("cat and or dog", 'unexpected token "or"'),
        ("(alpha or beta", "expected closing ')'"),
        ('"alpha and beta"', "phrases can only contain terms"),
        ('""', "empty phrase is not allowed"),
        ('"the"', "empty phrase is not allowed"),
        ('"new york', "unterminated phrase; missing closing quote"),
    ],
)
def test_parser_errors(query, message):
    with pytest.raises(QueryError) as e:
        parse(query)
    assert message in str(e.value)


@pytest.mark.parametrize(
    "tree, kept, expected",
    [
        (And((A, Not(B))), {"alpha"}, And((A, Not(B)))),
        (B, {"alpha"}, None),
        (And((A, B, C)), {"alpha", "gamma"}, And((A, C))),
        (Or((A, B, C)), {"alpha"}, A),
        (And((Or((A, B)), Not(C))), {"alpha"}, And((A, Not(C)))),
        (Phrase(("alpha", "beta")), {"beta"}, Phrase(("alpha", "beta"))),
        (Phrase(("beta", "gamma")), {"alpha"}, None),
        (And((A, Not(B))), set(), Not(B)),
    ],
)
def test_prune(tree, kept, expected):
    assert prune(tree, kept.__contains__) == expected


def test_positive_tokens():
    assert positive_tokens(parse('alpha alpha and not beta or "gamma beta"')) == ["alpha", "alpha", "gamma", "beta"]
    assert positive_tokens(Not(A)) == []


@pytest.mark.parametrize("tree", [Not(A), Or((A, Not(B))), And((A, Not(Not(B)))), And((Not(A), Not(B))), And((A, Or((Not(B), C))))])
def test_validate(tree):
    with pytest.raises(QueryError):
        validate(tree)
    validate(And((A, Not(Or((B, C))))))


def test_expand():
    words = {"alpha": ["beta"], "gamma": []}
    assert expand(parse("alpha gamma"), lambda t: words.get(t, [])) == And((Or((A, B)), Or((C,))))
    assert expand(parse('gamma and not alpha and "alpha gamma"'), lambda t: words.get(t, [])) == And((Or((C,)), Not(Or((A, B))), Phrase(("alpha", "gamma"))))
