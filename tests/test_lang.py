import pytest

from ledgerloom.lang import ast as A
from ledgerloom.lang import json_form as J
from ledgerloom.lang.errors import QueryError, SyntaxProblem
from ledgerloom.lang.parser import parse, parse_expression


def test_precedence():
    assert parse_expression("NOT a = 1 AND b OR c") == A.Binary("or", A.Binary("and", A.Unary("not", A.Binary("=", A.Name("a"), A.Literal(1))), A.Name("b")), A.Name("c"))
    assert parse_expression("a -5") == A.Binary("-", A.Name("a"), A.Literal(5))
    assert parse_expression("1 + 2 * -x") == A.Binary("+", A.Literal(1), A.Binary("*", A.Literal(2), A.Unary("-", A.Name("x"))))


def test_whole_query():
    q = parse(
        "select inv.*, con.title AS t from invoices inv LEFT ZIP contracts con ON inv.vendor_name = con.party_name -- note\n"
        "WHERE con.id IS NOT NULL AND inv.total_amount NOT BETWEEN 1 AND :most ORDER BY t DESC NULLS LAST OFFSET 5 LIMIT 10 |> VALIDATE WITH ('math_check') FAIL_FAST |> TAKE 3"
    )
    assert q.zip.kind == "left" and q.limit == 10 and q.offset == 5
    assert q.select[0].expr == A.Star("inv") and q.order[0] == A.Order(A.Name("t"), True, False)
    assert q.pipeline == (A.Validate(("math_check",), True), A.Take(3))
    assert A.parameters(q) == ["most"] and A.uses(q)["zip"] and not A.uses(q)["vector"]


def test_steps():
    q = parse("SELECT * FROM invoices |> ANALYZE BASELINE vendor_name WINDOW 30 DAYS THRESHOLD 2.5 METRICS total_amount, subtotal |> CROSS_VALIDATE ON (inv.total_amount, con.total_value), (currency, currency) TOLERANCE 0.1 |> AGGREGATE BY currency INTO sum(total_amount) AS s |> GRAPH TRAVERSE vendor_name DEPTH 2 |> GRAPH ENRICH")
    assert q.pipeline[0] == A.AnalyzeBaseline("vendor_name", 30, 2.5, ("total_amount", "subtotal"))
    assert q.pipeline[1] == A.CrossValidate((("total_amount", "total_value"), ("currency", "currency")), 0.1)
    assert q.pipeline[2] == A.Aggregate((A.Name("currency"),), (("sum", A.Name("total_amount"), "s"),))
    assert q.pipeline[3:] == (A.GraphTraverse("vendor_name", 2), A.GraphEnrich())


@pytest.mark.parametrize("text", ["SELECT", "SELECT a FROM", "SELECT a FROM t WHERE", "SELECT a FROM t LIMIT x", "SELECT a FROM t |> JUMP", "SELECT a FROM t WHERE a # 1", "SELECT a FROM t extra words", "SELECT a FROM t WHERE 'open"])
def test_errors(text):
    with pytest.raises(SyntaxProblem) as e:
        parse(text)
    assert e.value.line == 1 and e.value.column >= 1


def test_strings_and_vectors():
    assert parse_expression("'it''s'") == A.Literal("it's")
    assert parse_expression('"x"') == A.Literal("x")
    assert parse_expression("VECTOR_DISTANCE(embedding, [1, -2.5])") == A.Call("VECTOR_DISTANCE", (A.Name("embedding"), A.Literal([1.0, -2.5])))


def test_json_matches_text():
    form = J.invoices().select("id").filter(J.all_of(J.gt("total_amount", 5), J.negate(J.like("vendor_name", "A%")))).order_by_desc("id").limit(3).build()
    assert J.parse_json(form)[0] == parse("SELECT id FROM invoices WHERE total_amount > 5 AND NOT vendor_name LIKE 'A%' ORDER BY id DESC LIMIT 3")
    both = [J.parse_json({"from": "invoices", "pipeline": [{"op": op, k: {"total_amount": "total_value"}, "tolerance": 0.2}]})[0] for op, k in (("crossValidate", "fieldMapping"), ("cross_validate", "field_mapping"))]
    assert both[0] == both[1] and both[0].pipeline[0].tolerance == 0.2
    with pytest.raises(QueryError):
        J.condition({"and": []})
    assert J.parse_json(J.invoices().param("x", 1).build())[1] == {"x": 1}
