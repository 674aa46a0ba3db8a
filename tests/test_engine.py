import datetime
from decimal import Decimal

import pytest

from ledgerloom.lang.errors import AmbiguousColumn, MissingParameter, QueryError, UnknownColumn, UnknownTable, Unsupported
from ledgerloom.plans.engine import Engine

D, day = Decimal, datetime.date


@pytest.fixture(scope="module")
def engine(spark):
    invoices = spark.createDataFrame(
        [
            (1, "INV-1", day(2024, 1, 5), day(2024, 2, 5), "Acme", None, None, "USD", D("100.00"), D("10.00"), D("0.00"), D("110.00")),
            (2, "INV-2", day(2024, 1, 9), day(2024, 1, 1), "Acme", "PO-1", 20, "EUR", D("50.00"), D("5.00"), D("5.00"), D("60.00")),
            (3, "UNKNOWN-9", day(2024, 3, 1), None, "Unknown Vendor", None, None, "USD", D("0.00"), D("0.00"), D("0.00"), D("0.00")),
            (4, "INV-4", None, None, None, None, None, None, None, None, None, None),
        ],
        "id long, invoice_number string, invoice_date date, due_date date, vendor_name string, po_number string, contract_id long, currency string, subtotal decimal(18,2), tax_amount decimal(18,2), discount_amount decimal(18,2), total_amount decimal(18,2)",
    )
    contracts = spark.createDataFrame(
        [(10, "Deal", "Acme", D("80.00"), "USD", day(2024, 1, 1), None), (20, "Other", "Else", None, "EUR", day(2023, 1, 1), day(2023, 12, 31))],
        "id long, title string, party_name string, total_value decimal(18,2), currency string, effective_date date, expiration_date date",
    )
    documents = spark.createDataFrame([(1, "the quick brown fox", [1.0, 0.0]), (2, "a lazy dog and the fox fox", [0.0, 1.0]), (3, None, None), (4, "", [0.0, 0.0])], "id long, text string, embedding array<float>")
    return Engine({"invoices": invoices, "contracts": contracts, "documents": documents})


def ids(engine, text, params=None):
    return sorted(r[0] for r in engine.sql(text, params).rows.collect())


@pytest.mark.parametrize(
    ("where", "want"),
    [
        ("NOT total_amount > 50", [3]), ("due_date IS NOT NULL", [1, 2]), ("po_number = NULL", []), ("total_amount = 110", [1]), ("invoice_date < '2024-01-06'", [1]), ("vendor_name > 'B'", [3]),
        ("total_amount / subtotal > 1.15", [2]), ("currency IN ('EUR')", [2]), ("currency NOT IN ('EUR')", [1, 3]), ("id BETWEEN 2 AND 3", [2, 3]), ("invoice_number LIKE 'INV__'", [1, 2, 4]),
        ("vendor_name ILIKE 'ACME'", [1, 2]), ("vendor_name LIKE 'ACME'", []), ("total_amount -100 = 10", [1]), ("invoice_date = 'not a date'", []), ("id % 2 = 0", [2, 4]),
        ("EXISTS (SELECT id FROM contracts c WHERE c.party_name = invoices.vendor_name)", [1, 2]), ("NOT EXISTS (SELECT id FROM contracts c WHERE c.id = contract_id)", [1, 3, 4]),
    ],
)
def test_where(engine, where, want):
    assert ids(engine, f"SELECT id FROM invoices WHERE {where}") == want


def test_division_by_zero_is_null(engine):
    assert [r.x for r in engine.sql("SELECT total_amount / subtotal AS x FROM invoices WHERE id = 3").rows.collect()] == [None]


def test_zip(engine):
    on = "ON i.vendor_name = c.party_name"
    assert ids(engine, f"SELECT i.id FROM invoices i ZIP contracts c {on}") == [1, 2]
    assert ids(engine, f"SELECT i.id FROM invoices i LEFT ZIP contracts c {on} WHERE c.id IS NULL") == [3, 4]
    assert ids(engine, f"SELECT i.id FROM invoices i ZIP contracts c {on} WHERE i.total_amount > c.total_value") == [1]
    assert len(ids(engine, "SELECT i.id FROM invoices i CROSS ZIP contracts c ON i.id > c.id - 9")) == 3
    linked = Engine(engine.tables, link_mode="inferred").sql(f"SELECT invoices.id AS i, contracts.id AS c FROM invoices ZIP contracts {on.replace('i.', 'invoices.').replace('c.', 'contracts.')}").rows
    assert sorted(map(tuple, linked.collect())) == [(1, 10), (2, 20)]
    with pytest.raises(AmbiguousColumn):
        engine.sql(f"SELECT id FROM invoices i ZIP contracts c {on}")
    assert engine.sql(f"SELECT c.* FROM invoices i ZIP contracts c {on}").rows.columns[0] == "c_id"


def test_order_limit(engine):
    assert [r.id for r in engine.sql("SELECT id FROM invoices ORDER BY due_date, id").rows.collect()] == [2, 1, 3, 4]
    assert [r.id for r in engine.sql("SELECT id FROM invoices ORDER BY due_date DESC NULLS LAST, id LIMIT 2 OFFSET 1").rows.collect()] == [2, 3]
    assert Engine(engine.tables, default_limit=2, max_limit=3).sql("SELECT id FROM invoices").rows.count() == 2


def test_search(engine):
    rows = {r.id: r for r in engine.sql("SELECT id, VECTOR_DISTANCE(embedding, [1, 0]) AS d, BM25_SCORE(text, 'fox fox') AS s FROM documents").rows.collect()}
    assert rows[1].d == 0 and rows[2].d == 1 and rows[3].d is None and rows[4].d == 1
    assert rows[2].s > rows[1].s > 0 and rows[3].s == 0
    assert ids(engine, "SELECT id FROM documents WHERE CONTAINS(text, 'Fox the')") == [1, 2]
    assert ids(engine, "SELECT id FROM documents WHERE CONTAINS(text, '!')") == [1, 2, 4]


def test_pipeline(engine):
    r = engine.sql("SELECT id FROM invoices |> VALIDATE")
    found = {x.id: [a.rule for a in x.anomalies] for x in r.rows.collect()}
    assert found == {1: [], 2: ["math_check", "date_check"], 3: [], 4: ["required_fields"]}
    assert tuple(r.reports["validation"].first()) == (4, 2, 2)
    fast = engine.sql("SELECT id FROM invoices |> VALIDATE FAIL_FAST").rows
    assert {x.id: len(x.anomalies) for x in fast.collect()} == {1: 0, 2: 1, 3: 0, 4: 1}
    issues = engine.sql("SELECT i.id AS id FROM invoices i ZIP contracts c ON i.vendor_name = c.party_name |> CROSS_VALIDATE ON (total_amount, total_value), (vendor_name, party_name) TOLERANCE 0.1").rows
    assert {x.id: [y.type for y in x.issues] for x in issues.collect()} == {1: ["AmountExceedsContract"], 2: []}
    total = engine.sql("SELECT * FROM invoices |> FILTER currency IS NOT NULL |> AGGREGATE BY currency INTO sum(total_amount) AS t, count(po_number) AS n |> SORT BY t DESC |> TAKE 1").rows
    assert [tuple(x) for x in total.collect()] == [("USD", D("110.00"), 0)]
    near = engine.sql("SELECT id FROM invoices WHERE id = 1 |> GRAPH TRAVERSE vendor_name DEPTH 2 |> GRAPH ENRICH").rows.first()
    assert (near.graph_vendor_id, near.graph_related_invoices, near.graph_related_contracts, near.graph_contracts, near.graph_vendor_invoice_count) == ("vendor:acme", [1, 2], [20], [], 2)


def test_functions_and_errors(engine):
    engine.register_function("TWICE", lambda c: c * 2)
    assert engine.sql("SELECT TWICE(id) AS x FROM invoices WHERE id = 2").rows.first().x == 4
    for text, error in (
        ("SELECT a FROM nothing", UnknownTable), ("SELECT nope FROM invoices", UnknownColumn), ("SELECT id FROM invoices WHERE id = :x", MissingParameter), ("SELECT FOO(id) FROM invoices", Unsupported),
        ("SELECT id, COUNT(*) FROM invoices", QueryError), ("SELECT id FROM invoices |> VALIDATE WITH ('none')", Unsupported), ("SELECT x.id FROM invoices i", UnknownTable),
    ):
        with pytest.raises(error):
            engine.sql(text)
