import pytest

from fathomdex.plans import ast as A
from fathomdex.plans.parsers import parse
from fathomdex.plans.relations import QueryError

X = lambda w: A.Term(w, exact=True)
M = lambda w: A.Term(w, morph=True)


@pytest.mark.parametrize(
    ("text", "tree"),
    [
        ("java", M("java")),
        ("<exact> java", X("java")),
        ("a <and> b <and> c", A.And((M("a"), M("b"), M("c")))),
        ("a b", A.And((M("a"), M("b")))),
        ("(<and> a b)", A.And((M("a"), M("b")))),
        ("a <and> b <or> c", A.Or((A.And((M("a"), M("b"))), M("c")))),
        ("a <and> (b <or> c)", A.And((M("a"), A.Or((M("b"), M("c")))))),
        ("<NOT> a", A.Not(M("a"))),
        ("<if> (a <or> b)", A.If(A.Or((M("a"), M("b"))))),
        ("<hide> a", A.Hide(M("a"))),
        ("(<weight> 2.5 a)", A.Weight(2.5, M("a"))),
        ("a <near/4> b", A.Near(M("a"), M("b"), n=4)),
        ("a <near> b", A.Near(M("a"), M("b"))),
        ("(<within> 7 a b)", A.Within(7, M("a"), M("b"))),
        ("(<passage> a b)", A.Passage(M("a"), M("b"))),
        ("a <pand> b", A.PAnd(M("a"), M("b"))),
        ("a <tor> b", A.TermOr((M("a"), M("b")))),
        ('"a b c"', A.Phrase(X("a"), X("b"), X("c"))),
        ("don't", None),
        ("'a-b'", A.Term("a-b", morph=True)),
        ("wi-fi", A.Phrase(X("wi"), X("fi"))),
        ("size <= 5", A.Relation("size", "<=", "5")),
        ("size <leq> 5", A.Relation("size", "<=", "5")),
        ('name <matches> "a* b"', A.Relation("name", "matches", "a* b")),
        ("name != x", A.Relation("name", "!=", "x")),
        ("<undef> name", A.Undefined("name")),
        ("f,G <contains> (a <or> b)", A.Fields(("f", "g"), A.Or((M("a"), M("b"))))),
        ("*", A.MatchAll()),
        ("a <SOR> b", A.Or((M("a"), M("b")))),
        ("te*t", M("te*t")),
    ],
)
def test_strict(text, tree):
    if tree is None:
        with pytest.raises(QueryError):
            parse(text)
    else:
        assert parse(text) == tree


@pytest.mark.parametrize("text", ["", "(a", "a <and> b <near> c", "a <tor> (b <and> c)", "size <", "<weight> x a", "..."])
def test_strict_errors(text):
    with pytest.raises(QueryError):
        parse(text)


@pytest.mark.parametrize(
    ("text", "tree"),
    [
        ("a b", A.And((M("a"), M("b")))),
        ("+a -b", A.And((M("a"), A.Not(M("b"))))),
        ("a /b /c", A.And((M("a"), A.Or((M("b"), M("c")))))),
        ("~a", A.Term("a", expand=True)),
        ('"a b"', A.Phrase(X("a"), X("b"))),
        ("[a b]", A.PAnd(M("a"), M("b"))),
    ],
)
def test_web(text, tree):
    assert parse(text, "web") == tree


def test_web_pand_default():
    assert parse("a b -c", "web", "pand") == A.And((A.PAnd(M("a"), M("b")), A.Not(M("c"))))


L = lambda w: A.Term(w)


@pytest.mark.parametrize(
    ("text", "tree"),
    [
        ("a AND b OR c", A.Or((A.And((L("a"), L("b"))), L("c")))),
        ("a && !b", A.And((L("a"), A.Not(L("b"))))),
        ("a || b", A.Or((L("a"), L("b")))),
        ("+a -b", A.And((L("a"), A.Not(L("b"))))),
        ("f:a", A.Fields(("f",), L("a"))),
        ("f:[1 TO 5]", A.Range("f", "1", "5")),
        ("f:{1 TO 5}", A.Range("f", "1", "5", True, True)),
        ('"a b"~3', A.Near(X("a"), X("b"), n=3)),
        ("a~", M("a")),
        ("a^2", A.Weight(2.0, L("a"))),
        ("(a OR b) AND c", A.And((A.Or((L("a"), L("b"))), L("c")))),
    ],
)
def test_lucene(text, tree):
    assert parse(text, "lucene") == tree


def test_lucene_has_no_passage_default():
    with pytest.raises(QueryError):
        parse("a", "lucene", "passage")


def test_exact_excludes_morph():
    with pytest.raises(ValueError):
        A.Term("a", exact=True, morph=True)
