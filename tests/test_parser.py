import pytest

from weftgraph import ParseError, parse
from weftgraph.plans import syntax as s
from weftgraph.plans.lexer import tokenize


def expr(text):
    return parse(f"RETURN {text}").queries[0].clauses[0].items[0].expr


def test_tokens():
    kinds = [(t.kind, t.text) for t in tokenize("MATCH (`a b`:X) // c\n/* d */ <= 0xFF 1.5 'it\\'s' $p ${q}")]
    assert kinds[0] == ("keyword", "MATCH") and ("name", "a b") in kinds and ("op", "<=") in kinds
    values = [t.value for t in tokenize("0xFF 1.5 'it\\'s\\u0041' $p ${q} \"x\"")][:-1]
    assert values == [255, 1.5, "it'sA", "p", "q", "x"]


@pytest.mark.parametrize("text", ["RETURN 99999999999999999999", "RETURN 1 ~ 2", "MATCH (n RETURN n", "RETURN", "", "MATCH (a)-->(b) RETURN a", "RETURN 'a\\q'"])
def test_errors_have_positions(text):
    with pytest.raises(ParseError) as e:
        parse(text)
    assert isinstance(e.value.position, int) and 0 <= e.value.position <= len(text)


def test_precedence():
    assert expr("1 + 2 * 3") == s.Binary("+", s.Lit(1), s.Binary("*", s.Lit(2), s.Lit(3)))
    assert expr("(1 + 2) * 3") == s.Binary("*", s.Binary("+", s.Lit(1), s.Lit(2)), s.Lit(3))
    assert expr("a OR b AND c") == s.Binary("or", s.Name("a"), s.Binary("and", s.Name("b"), s.Name("c")))
    assert expr("a OR b XOR c") == s.Binary("or", s.Name("a"), s.Binary("xor", s.Name("b"), s.Name("c")))
    # NOT takes less than IN and IS NULL do.
    assert expr("NOT a IN l") == s.Binary("in", s.Unary("not", s.Name("a")), s.Name("l"))
    assert expr("NOT a = b") == s.Unary("not", s.Binary("=", s.Name("a"), s.Name("b")))
    assert expr("10 - 2 - 3") == s.Binary("-", s.Binary("-", s.Lit(10), s.Lit(2)), s.Lit(3))
    assert expr("-5") == s.Lit(-5) and expr("-a") == s.Unary("-", s.Name("a"))


def test_patterns():
    m = parse("MATCH p = (a:X:Y {k: 1} WHERE a.v > 2)-[r:T|:U*2..5 {w: 3}]->(b)<-[]-(c), (d)-[s]-(e) WHERE a.z = 1 RETURN *").queries[0].clauses[0]
    path = m.paths[0]
    assert path.var == "p" and path.nodes[0].labels == ("X", "Y") and path.nodes[0].where is not None
    assert path.rels[0].types == ("T", "U") and path.rels[0].hops == (2, 5) and path.rels[0].direction == "right"
    assert path.rels[1].direction == "left" and m.paths[1].rels[0].direction == "both"
    hops = lambda t: parse(f"MATCH (a)-[{t}]->(b) RETURN a").queries[0].clauses[0].paths[0].rels[0].hops
    assert [hops(t) for t in ("*", "*3", "*3..", "*..4", ":T*0..1", "")] == [(1, None), (3, 3), (3, None), (1, 4), (0, 1), None]


def test_clauses_and_keywords_as_names():
    st = parse("EXPLAIN MATCH (order:Order) OPTIONAL MATCH (x) FROM g WITH DISTINCT order AS o ORDER BY o.a DESC, o.b SKIP 1 LIMIT $n WHERE o.c RETURN o UNION ALL FOR x IN [1] RETURN x AS o;")
    assert st.explain and st.union_all == (True,)
    kinds = [type(c).__name__ for c in st.queries[0].clauses]
    assert kinds == ["Match", "Match", "Projection", "Projection"]
    w = st.queries[0].clauses[2]
    assert w.distinct and w.order[0][1] is False and w.order[1][1] is True and w.limit == s.Param("n")
    assert expr("match.limit") == s.Prop(s.Name("match"), "limit")


def test_expressions():
    assert isinstance(expr("[x IN l WHERE x > 1 | x]"), s.Comprehension)
    assert isinstance(expr("[(a)-[:T]->(b) WHERE b.x | b.y]"), s.PatternComprehension)
    assert expr("[(a), 1]") == s.ListLit((s.Name("a"), s.Lit(1)))
    assert isinstance(expr("any(x IN l WHERE x)"), s.Quantifier) and isinstance(expr("reduce(a = 0, x IN l | a + x)"), s.Reduce)
    assert expr("EXISTS(n.p)") == s.IsNull(s.Prop(s.Name("n"), "p"), True)
    assert isinstance(expr("EXISTS { (a)-[:T]->(b) WHERE b.x = 1 }"), s.Exists)
    assert expr("count(*)") == s.Call("count", star=True) and expr("count(DISTINCT x)").distinct
    assert expr("n {.a, .*, k: 1}").items == (("a", None), ("*", None), ("k", s.Lit(1)))
    assert isinstance(expr("CASE x WHEN 1 THEN 2 ELSE 3 END"), s.Case)


def test_writes():
    q = parse("MATCH (n) SET n.a.b = 1" if False else "MATCH (n) SET n.a = 1, n += {b: 2}, n:L DETACH DELETE n").queries[0].clauses
    assert [i.key or i.label or i.merge for i in q[1].items] == ["a", True, "L"] and q[2].detach
