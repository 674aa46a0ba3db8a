"""Links, sides, aggregates of expressions, searches, stores and files that the queries over the driver's tables leave out."""

import datetime
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerloom.functions import fields, vector
from ledgerloom.functions import statistics as st
from ledgerloom.functions import text as text_functions
from ledgerloom.lang.errors import QueryError
from ledgerloom.operators import baseline, graph, rollups, validate
from ledgerloom.plans.catalog import catalog, view
from ledgerloom.plans.engine import Engine, Wide
from ledgerloom.sources import formats, probing, stores

SF = "/root/testdata/sf0.001"
D, day = Decimal, datetime.date


@pytest.fixture(scope="module")
def tables(spark):
    invoices = spark.createDataFrame(
        [(1, "A", "N1", None, 5.0, "USD"), (2, "A", None, 20, 6.0, "EUR"), (3, "B", "N2", None, 7.0, "USD"), (4, None, None, None, 8.0, None), (5, "A", "N9", 99, 9.0, "USD"), (6, "A", "N3", None, 1.0, "USD")],
        "id long, vendor_name string, contract_number string, contract_id long, total_amount double, currency string",
    )
    contracts = spark.createDataFrame([(10, "A", "N1", "EUR"), (20, "B", "N2", "USD"), (30, "C", "N3", "USD")], "id long, party_name string, contract_number string, currency string")
    return {"invoices": invoices, "contracts": contracts}


def pairs(df):
    return sorted(map(tuple, df.collect()), key=str)


def brute_links(tables, kind):
    out = []
    cons = tables["contracts"].collect()
    for i in tables["invoices"].collect():
        if i.contract_id is not None:
            hit = [c for c in cons if c.id == i.contract_id]
        else:
            hit = [c for c in cons if (i.contract_number and c.contract_number == i.contract_number) or (i.vendor_name and c.party_name == i.vendor_name)]
        out += [(i.id, c.id) for c in hit] or ([(i.id, None)] if kind == "LEFT" else [])
    return sorted(out, key=str)


@pytest.mark.parametrize("kind", ["INNER", "LEFT"])
def test_inferred_links(tables, kind):
    engine = Engine(tables, link_mode="inferred")
    got = engine.sql(f"SELECT i.id AS a, c.id AS b FROM invoices i {kind} ZIP contracts c ON i.vendor_name = c.party_name").rows
    assert pairs(got) == brute_links(tables, kind)
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
    turned = engine.sql(f"SELECT c.id AS a, i.id AS b FROM contracts c {kind} ZIP invoices i ON i.vendor_name = c.party_name").rows
    linked = {(b, a) for a, b in brute_links(tables, "INNER")}
    lonely = {(c.id, None) for c in tables["contracts"].collect()} if kind == "LEFT" else set()
    assert pairs(turned) == sorted(linked | {(c, None) for c, _ in lonely if c not in {a for a, _ in linked}}, key=str)


@pytest.mark.parametrize("names", [("inv", "con"), ("k", "x"), ("con", "inv"), ("contracts_1", "c_2")])
def test_sides_of_any_alias(tables, names):
    i, c = names
    got = Engine(tables).sql(f"SELECT {i}.id AS id FROM invoices {i} ZIP contracts {c} ON {i}.vendor_name = {c}.party_name |> CROSS_VALIDATE ON (currency, currency)").rows
    assert {r.id: [x.type for x in r.issues] for r in got.collect()} == {1: ["CurrencyMismatch"], 2: [], 3: [], 5: ["CurrencyMismatch"], 6: ["CurrencyMismatch"]}


def test_aggregates_of_expressions(tables):
    engine = Engine(tables)
    row = engine.sql("SELECT SUM(total_amount) / COUNT(*) AS mean, MAX(id) - MIN(id) AS spread FROM invoices |> TRANSFORM mean AS m, spread AS s |> FILTER s > 1").rows.first()
    assert (row.m, row.s) == (6.0, 5)
    assert engine.sql("SELECT COUNT(*) AS n FROM invoices ORDER BY n LIMIT 0").rows.count() == 0
    with pytest.raises(QueryError):
        engine.sql("SELECT id + COUNT(*) AS n FROM invoices")
    nothing = "SELECT SUM(total_amount) AS t FROM invoices WHERE id > 100"
    assert engine.sql(nothing).rows.first().t is None and Engine(tables, empty_sums=True).sql(nothing).rows.first().t == 0
    assert engine.sql("SELECT PAIR_SCORE(total_amount, contract_id) AS s FROM invoices WHERE id < 3 ORDER BY id").rows.collect() == [(5.0,), (13.0,)]


def test_exists_anywhere(tables):
    engine = Engine(tables)
    ids = lambda where: [r.id for r in engine.sql(f"SELECT id FROM invoices WHERE {where} ORDER BY id").rows.collect()]
    some = "EXISTS (SELECT id FROM contracts c WHERE c.party_name = invoices.vendor_name AND c.currency = 'USD')"
    assert ids(f"{some} OR id = 1") == [1, 3] and ids(f"NOT ({some} OR id = 1)") == [2, 4, 5, 6] and ids(f"NOT {some} AND (id < 3 OR {some})") == [1, 2]
    assert engine.sql(f"SELECT * FROM invoices WHERE {some} OR id = 1").rows.columns == tables["invoices"].columns


def test_products_are_asked_for(tables):
    form = {"from": "invoices", "select": ["invoices.id"], "zip": {"mode": "cartesian", "table": "contracts"}}
    with pytest.raises(QueryError):
        Engine(tables).json(form)
    assert Engine(tables, products=True).json(form).rows.count() == 18


def test_costly_columns_join_when_named(spark):
    base, more = spark.createDataFrame([(1, "a"), (2, "b")], "id long, text string"), spark.createDataFrame([(1, [1.0, 0.0])], "id long, embedding array<double>")
    engine = Engine({"documents": Wide(base, more, "id")})
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan(engine.sql("SELECT id FROM documents WHERE text = 'a'").rows) and "Join" in plan(engine.sql("SELECT id, embedding FROM documents").rows)
    assert engine.sql("SELECT * FROM documents").rows.columns == ["id", "text", "embedding"]


def test_rules_are_registered(spark, tables):
    engine = Engine(tables)
    engine.register_rule(validate.Rule("large", "total_amount > 7", "critical", "total_amount"))
    got = engine.sql("SELECT id FROM invoices |> VALIDATE WITH ('large', 'math_check')").rows
    assert [r.id for r in got.where("not is_valid").orderBy("id").collect()] == [4, 5]
    assert validate.rule_names(engine.rules)[-1] == "large" and "date_check" in validate.rule_names()
    row = {"invoice_date": day(2024, 2, 1), "due_date": day(2024, 1, 1), "total_amount": 9.0}
    assert [r.type for r in validate.evaluate_rule(spark, "date_check", row).collect()] == ["DateInconsistency"]
    assert [r.severity for r in validate.evaluate_rule(spark, engine.rules["large"], row).collect()] == ["High"]


# searching
def test_terms_are_counted_in_place(spark):
    texts = ["The the THE a bb, b-b é", None, "", "xthe the_the the", "ÉCOLE école l'école 日 日本", "a.b c;dd"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    text = F.coalesce("text", F.lit(""))
    own = text_functions.terms(text)
    for term in ("the", "bb", "é", "école", "日", "dd"):
        rows = df.select((F.size(own) - F.size(F.array_remove(own, term))).alias("a"), text_functions.frequency(F.lower(text), term).alias("b"), F.size(own).alias("c"), text_functions.term_count(text).alias("d")).collect()
        assert all((r.a, r.c) == (r.b, r.d) for r in rows)


def test_query_syntax(spark):
    rows = [(1, "red fox runs", "fox"), (2, "red dog", "dog"), (3, "fox and dog", "cat"), (4, None, None)]
    found = formats.index(spark.createDataFrame(rows, "id long, body string, title string"), "notes", ["body", "title"], ["title"])
    keys = lambda q, **kw: sorted(r.key for r in formats.search(found, q, 10, **kw).collect())
    assert keys("fox") == [1, 3] and keys("red fox") == [1, 2, 3] and keys("+red fox") == [1, 2] and keys("red AND fox") == [1] and keys("dog -red") == [3] and keys("dog NOT fox") == [2]
    assert keys("title:cat") == [3] and keys('"fox dog"') == [3] and keys("") == [] and keys("-red") == [] and keys("fox", kind="other") == []
    assert keys("title:dog title:fox") == [1, 2]
    left = found.delete(spark.createDataFrame([(1, "notes")], "key long, type string"))
    assert sorted(r.key for r in formats.search(left, "fox", 10).collect()) == [3] and left.documents.count() == 3
    both = found.union(formats.index(spark.createDataFrame([(1, "fox")], "id long, body string"), "memos", ["body"]))
    assert [(r.type, r.key) for r in formats.search(both, "fox", 1, "memos").collect()] == [("memos", 1)]
    hot, warm = spark.createDataFrame([(1, "h")], "id long, x string"), spark.createDataFrame([(1, "w"), (3, "w")], "id long, x string")
    assert sorted((r.key, r.x) for r in formats.fetch(formats.search(found, "fox", 10), hot, warm).collect()) == [(1, "h"), (3, "w")]


def test_probed_cells_find_the_nearest(spark):
    r = np.random.default_rng(5)
    centers = r.standard_normal((40, 16))
    rows = [(i, [float(x) for x in centers[i % 40] + 0.3 * r.standard_normal(16)]) for i in range(2000)]
    df = spark.createDataFrame(rows, "id long, embedding array<double>")
    cells = stores.Cells(planes=6, tables=6)
    indexed = cells.index(df, 16)
    got = {(x.query, x.id) for x in stores.probe_search(indexed.where("id % 100 = 0"), indexed, cells, 5).collect()}
    v = np.array([x for _, x in rows])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    want = {(q, int(i)) for q in range(0, 2000, 100) for i in np.argsort(-(v @ v[q]), kind="stable")[:5]}
    assert len(got & want) >= 0.9 * len(want)


def test_recall_on_the_given_vectors(spark):
    from ledgerloom.queries import QUERIES

    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    ids = np.array([r.vec_id for r in rows])
    v = np.array([r.embedding for r in rows], float)
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    want = set()
    for q in np.flatnonzero(ids % 100 == 0):
        best = np.lexsort((ids, np.round(1 - v @ v[q], 9)))[:5]
        want |= {(int(ids[q]), int(ids[i])) for i in best}
    got = {(x.query, x.id) for x in QUERIES["vector_probe"](spark, SF).collect()}
    assert want and len(got & want) >= 0.9 * len(want)


def plain_cells(v, normals):
    """The cells of a vector by Spark's own sums."""
    bits = lambda planes: [F.when(vector.dot(v, vector.literal(p.tolist())) > 0, 1 << i).otherwise(0) for i, p in enumerate(planes)]
    return F.array(*[sum(bits(planes)[1:], bits(planes)[0]) for planes in normals])


def odd_vectors():
    r = np.random.default_rng(11)
    inf, nan = float("inf"), float("nan")
    base = [[float(x) for x in r.integers(-2, 3, 4)] for _ in range(60)] + [[float(x) for x in r.standard_normal(4)] for _ in range(60)]
    odd = [None, [], [0.0] * 4, [-0.0] * 4, [1.0, None, 2.0, 3.0], [None] * 4, [1.0, 2.0], [0.0, 0.0], [1.0, 2.0, None], [1.0] * 7, [nan, 1.0, 1.0, 1.0], [inf, 1.0, 0.0, 1.0], [-inf, inf, 0.0, 1.0]]
    odd += [[1e200, -1e200, 1.0, 0.0], [1e-200, 1e-190, 0.0, 0.0], [1e-60, 2e-60, 0.0, 1e-61], [1e60, 2e60, 0.0, 1e59], [5.0, 5.0, 5.0, 5.0]]
    vectors = base + odd * 2 + [[1.0, 1.0, 1.0, 1.0]] * 12 + [[3.0, 3.0, 3.0, 3.0000001]] * 3
    return [vectors[i] for i in r.permutation(len(vectors))]


@pytest.mark.parametrize("planes, tables, flips, limit, names", [(5, 3, 1, 5, "long"), (2, 1, 2, 200, "string"), (20, 2, 1, 3, "long"), (4, 2, 0, 1, "string")])
def test_probed_rows_are_those_of_all_pairs(spark, planes, tables, flips, limit, names):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(odd_vectors())] + [(None, [1.0] * 4)], "id long, embedding array<double>").select(F.col("id").cast(names), "embedding")
    cells = stores.Cells(planes=planes, tables=tables)
    indexed = cells.index(df, 4).localCheckpoint()
    assert pairs(indexed.select("id", "cells")) == pairs(df.select("id", plain_cells(F.col("embedding"), cells.normals(4)).alias("cells")))
    both = indexed.select(F.col("id").alias("query"), F.col("embedding").alias("wanted"), F.col("cells").alias("own")).crossJoin(indexed.where("id is not null"))
    met = both.where("query is not null").where(F.exists(F.zip_with("own", "cells", lambda a, b: F.bit_count(a.bitwiseXOR(b)) <= flips), lambda x: x))
    scored = met.select("query", "id", vector.cosine_distance(F.col("embedding"), F.col("wanted")).alias("distance")).where("distance is not null")
    want = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("distance", "id"))).where(F.col("rank") <= limit)
    got = stores.probe_search(indexed, indexed, cells, limit, flips)
    assert got.columns == want.columns and got.dtypes == want.dtypes
    assert [str(x) for x in pairs(got)] == [str(x) for x in pairs(want)]
    assert got.count() > 100 and stores.probe_search(indexed.limit(0), indexed, cells, limit, flips).count() == 0 and stores.probe_search(indexed, indexed.limit(0), cells, limit, flips).count() == 0


@pytest.mark.parametrize("planes, flips", [(6, 2), (14, 1)])
def test_tiles_over_many_batches(planes, flips):
    r = np.random.default_rng(4)
    v = r.standard_normal((4000, 8)).round(1)
    v[::3] = v[0]
    ids, cells = r.permutation(4000), (v @ r.standard_normal((8, planes)) > 0) @ (1 << np.arange(planes))
    whole = probing.Vectors.of(pa.table({"id": ids, "embedding": pa.array(v.tolist()), "cells": pa.array(cells[:, None].tolist())}))
    tile = probing.Tile(whole.take(np.arange(50)), planes, flips, 5)
    for i in range(0, 4000, 130):
        tile.meet(whole.take(np.arange(i, min(i + 130, 4000))).without_copies(5))
    for q in range(50):
        at = np.flatnonzero(np.bitwise_count(cells ^ cells[q]) <= flips)
        d, _ = probing.distances(whole, np.full(len(at), q), whole, at)
        best = np.lexsort((ids[at], d))[:5]
        assert tile.ids[tile.q == q].tolist() == ids[at][best].tolist() and tile.d[tile.q == q].tolist() == d[best].tolist()


def shuffled(plan):
    """Records that the exchanges of a plan that has run wrote."""
    kind = plan.getClass().getSimpleName()
    own = plan.metrics().get("shuffleRecordsWritten")
    inner = [plan.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [plan.plan()] if kind.endswith("QueryStageExec") else []
    inner += [plan.children().apply(i) for i in range(plan.children().size())]
    return (own.get().value() if own.isDefined() else 0) + sum(map(shuffled, inner))


def test_probed_pairs_are_not_shuffled(spark):
    r = np.random.default_rng(6)
    df = spark.createDataFrame([(i, [float(x) for x in r.standard_normal(16)]) for i in range(3000)], "id long, embedding array<double>").localCheckpoint()
    cells = stores.Cells()
    indexed = cells.index(df, 16)
    got = stores.probe_search(indexed.where("id % 100 = 0"), indexed, cells, 5, 2)
    assert len(got.collect()) == 150
    # 30 queries meet most of 3,000 rows; a task gives five a query
    assert shuffled(got._jdf.queryExecution().executedPlan()) < 3000


# baselines
@pytest.mark.parametrize("values", [[1.0], [5.0] * 40, [-3.0, -2.5, 0.0, 0.1, 7.0, 1e9, -1e9], list(range(100)), [0.001 * i * (-1) ** i for i in range(333)]])
def test_nearest_ranks(spark, values):
    df = spark.createDataFrame([(g, float(x)) for g in ("a", None) for x in values], "g string, x double")
    ordered = sorted(map(float, values))
    for row in st.nearest_ranks(df, ["g"], "x").collect():
        for p in st.PERCENTILES:
            assert row[f"p{p}"] == ordered[int(np.floor(p / 100 * (len(ordered) - 1) + 0.5))]


def test_rolling_equals_brute_force(spark):
    r = np.random.default_rng(2)
    rows = [(i, ["a", "b", None][i % 3], day(2024, 1, 1) + datetime.timedelta(int(r.integers(0, 60))), [None, 5.0, float(r.random() * 1e5)][int(r.integers(0, 3))]) for i in range(150)] + [(500, "a", None, 3.0)]
    df = spark.createDataFrame(rows, "id int, g string, d date, x double")
    for x in baseline.rolling(df, "g", "d", "x", 10).collect():
        own = [v for _, g, d, v in rows if x.d and d and g == x.g and v is not None and 1 <= (x.d - d).days <= 10]
        assert x.n == len(own) and (not own or (abs(x.mean - np.mean(own)) < 1e-6 and abs(x.stddev - np.std(own)) < 1e-4))
        assert own or (x.mean is None and x.stddev is None)


# stores
def test_the_last_change_of_a_key_wins(spark):
    df = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "id int, x string, v int")
    changes = spark.createDataFrame([(1, "z", 2), (1, "y", 3), (3, "c", None), (3, "c", None)], "id int, x string, v int")
    assert pairs(stores.upsert(df, changes, "v")) == [(1, "y", 3), (2, "b", 1), (3, "c", None)]
    assert pairs(stores.upsert(df, changes)) == [(1, "z", 2), (2, "b", 1), (3, "c", None)]


def test_baselines_and_lists(spark):
    base = spark.createDataFrame([("A", 3)], "vendor_name string, n int")
    rows = stores.computed_baselines(base, "vendor_name", "total_amount", datetime.datetime(2024, 1, 1))
    assert rows.first().id == "A:total_amount:r90" and stores.live_baselines(rows, datetime.datetime(2024, 1, 3)).count() == 0 and stores.live_baselines(rows, datetime.datetime(2024, 1, 2)).count() == 1
    docs = spark.createDataFrame([(i, "invoice" if i % 2 else "contract", f"V{i % 3}", "Open", day(2024, 1, i + 1)) for i in range(9)], "id int, type string, vendor_name string, status string, date date")
    assert [r.id for r in stores.list_documents(docs, kind="invoice", until=day(2024, 1, 6), page=1, page_size=2).collect()] == [5, 3]
    assert [r.id for r in stores.list_documents(docs, vendor="V1", limit=1, offset=1).collect()] == [4]


def test_small_functions(spark):
    one = spark.range(1)
    box = lambda *x: F.struct(*[F.lit(float(v)).alias(k) for k, v in zip(("x0", "y0", "x1", "y1"), x, strict=True)])
    row = one.select(fields.box_iou(box(0, 0, 2, 2), box(1, 1, 3, 3)).alias("a"), fields.box_iou(box(0, 0, 1, 1), box(5, 5, 6, 6)).alias("b"), fields.snake_case(F.lit("MathMismatch")).alias("c"), fields.sigmoid(F.lit(0.0)).alias("d"), fields.span_iou(F.lit(0), F.lit(4), F.lit(2), F.lit(6)).alias("e")).first()
    assert abs(row.a - 1 / 7) < 1e-12 and row.b == 0 and row.c == "math_mismatch" and row.d == 0.5 and abs(row.e - 1 / 3) < 1e-12
    events = spark.createDataFrame([(i, "u", datetime.datetime(2024, 1, 1, 0, 0, i)) for i in range(5)], "id int, user string, ts timestamp")
    assert [r.retry_after for r in rollups.rate_limited(events, ["user"], 3, 2).orderBy("id").collect()] == [None, None, 1, 1, 1]


def test_graph_edges(spark):
    invoices = spark.createDataFrame([(1, "V", "P One", 7, "n", None, None), (2, "V", None, None, "n", None, None)], "id long, vendor_name string, bill_to_name string, contract_id long, invoice_number string, invoice_date date, total_amount double")
    contracts = spark.createDataFrame([(7, "T", "p one", 1.0)], "id long, title string, party_name string, total_value double")
    g = graph.build(invoices, contracts)
    assert pairs(g["billed_to"]) == [("party:p_one", 1)] and g["party"].count() == 1
    assert pairs(graph.neighbours(invoices)) == [("vendor:v", "contract", "7"), ("vendor:v", "invoice", "1"), ("vendor:v", "invoice", "2")]
    assert pairs(graph.link(g, spark.createDataFrame([(2, 7), (1, 7)], "invoice long, contract long"))["governed_by"]) == [(1, 7), (2, 7)]
    texts = spark.createDataFrame([("c", [("k", "t", "title", "ab" * 3), (None, "t", "title", "é" * 4)])], "id string, clauses array<struct<clause_id:string,clause_type:string,title:string,text:string>>")
    assert [(r.key, r.text) for r in graph.clauses(texts, 5).collect()] == [("k", "ababa"), ("c#1", "éé")]


# files
def test_ntriples_are_read_or_rejected(spark, tmp_path):
    (tmp_path / "a.nt").write_text('# c\n<s> <http://x/name> "x\\\\ny\\n\\u00e9\\U0001F600\\"q" .\n<s> <http://www.w3.org/1999/02/22-rdf-syntax-ns#type> <http://x#Organization> .\nno triple\n')
    at = str(tmp_path / "a.nt")
    with pytest.raises(Exception, match="not a triple"):
        formats.read_ntriples(spark, at).collect()
    t = formats.read_ntriples(spark, at, strict=False)
    assert [r.object for r in t.where("is_literal").collect()] == ["x\\ny\né😀\"q"]
    assert [r.value for r in formats.rejected_ntriples(spark, at).collect()] == ["no triple"]
    assert [(r.label, r.name) for r in formats.mapped_nodes(t).collect()] == [("vendor", "x\\ny\né😀\"q")]


def test_views_by_hand(spark):
    """The views that Spark and DuckDB read alike, against sums over the raw rows."""
    import pandas as pd

    lines, orders, customers = (pd.read_parquet(f"{SF}/{t}.parquet") for t in ("lineitem", "orders", "customer"))
    got = {r.id: r for r in view(spark, SF, "invoices").collect()}
    assert len(got) == len(orders)
    names = dict(zip(customers.c_custkey, customers.c_name, strict=True))
    for o in orders.sample(60, random_state=1).itertuples():
        own, row = lines[lines.l_orderkey == o.o_orderkey], got[o.o_orderkey]
        assert row.vendor_name == names[o.o_custkey] and row.line_item_count == len(own)
        assert abs(float(row.subtotal) - own.l_extendedprice.astype(float).sum()) < 0.011 and (row.contract_id == o.o_custkey) == (o.o_orderkey % 5 == 0)
    contracts = {r.id: r for r in view(spark, SF, "contracts").collect()}
    assert set(contracts) == {k for k in customers.c_custkey if k % 3} and all(contracts[k].party_name == names[k] for k in contracts)
    assert set(catalog(spark, SF)) == {"invoices", "contracts", "documents"}


# extraction and streams
def test_forms_of_invoices_and_contracts(spark):
    from ledgerloom.operators import extract

    invoices = spark.createDataFrame([(1, "Bill # B-77\nSupplier: Acme Ltd\nTotal $12.00"), (2, "Billed by Widget Co\nInvoice No. 9-A"), (3, "nothing")], "id int, text string")
    got = {r.id: r for r in extract.invoice(invoices).collect()}
    assert (got[1].invoice_number, got[1].vendor_name) == ("B-77", "Acme Ltd") and (got[2].invoice_number, got[2].vendor_name) == ("9-A", "Widget Co")
    assert got[3].invoice_number.startswith("UNKNOWN-") and got[3].vendor_name == "Unknown Vendor"
    contracts = spark.createDataFrame(
        [
            (1, "intro\nMASTER SERVICE AGREEMENT\nRef. No: X/12\nThis is made between \"Alpha Inc\" (the first) and Beta LLC, for work"),
            (2, "CONSULTING CONTRACT\nClient: Gamma\nProvider: Delta\nContract # C-1\nNot to exceed: $5,000"),
            (3, "Some title\nParty A: One\nParty B: Two\nPurchase Order No. 44\nTotal contract value: $10.50 of $99.00"),
            (4, "plain"),
        ],
        "id int, text string",
    )
    got = {r.id: r for r in extract.contract(contracts).collect()}
    assert (got[1].title, got[1].contract_number, got[1].parties) == ("MASTER SERVICE AGREEMENT", "X/12", ["Alpha Inc", "Beta LLC"])
    assert (got[2].title, got[2].contract_number, got[2].parties, got[2].total_value) == ("CONSULTING CONTRACT", "C-1", ["Gamma", "Delta"], D("5000"))
    assert (got[3].title, got[3].contract_number, got[3].parties, got[3].total_value) == ("Some title", "44", ["One", "Two"], D("10.50"))
    assert (got[4].title, got[4].contract_number, got[4].parties) == ("plain", None, ["Unknown"])


def test_streamed_rollups_have_percentiles(spark, tmp_path):
    from ledgerloom.streaming import jobs

    events = spark.createDataFrame([(datetime.datetime(2024, 1, 1, 0, i % 60), float(i)) for i in range(100)] + [(datetime.datetime(2024, 1, 2), 0.0)], "ts timestamp, value double").withColumn("k", F.lit("a"))
    events.write.parquet(str(tmp_path / "in"))
    out = jobs.rollup(jobs.file_source(spark, str(tmp_path / "in"), events, 100), "1 hour", ["k"], "1 minute", error=F.col("value") >= 90)
    jobs.run_available(out, str(tmp_path / "out"), str(tmp_path / "cp"))
    row = spark.read.parquet(str(tmp_path / "out")).orderBy("bucket").first()
    assert (row.n, row["mean"], row.n_errors) == (100, 49.5, 10) and abs(row.p50 - 49.5) <= 1 and abs(row.p99 - 98) <= 1


def test_running_queries_see_new_baselines(spark, tmp_path):
    from ledgerloom.streaming import jobs

    base = spark.createDataFrame([(1, "INV-1", "V", 100.0)], "id long, invoice_number string, vendor_name string, total_amount double")
    for i in (1, 2):
        base.withColumn("id", F.lit(i).cast("long")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    means, seen = iter((1000.0, *[100.0] * 9)), []
    fresh = lambda: spark.createDataFrame([("V", 9, next(means), 10.0)], "vendor_name string, n long, mean double, stddev double")
    q = jobs.validate_fresh(jobs.file_source(spark, str(tmp_path / "in"), base), fresh, lambda df, n: seen.extend(r.anomaly_count for r in df.collect()), str(tmp_path / "cp"))
    q.awaitTermination()
    assert sorted(seen) == [0, 1] and isinstance(jobs.lag(q)["behind"], list)
    assert jobs._behind('{"t": {"0": 10, "1": 7}}', {"t": {"0": 4, "1": 7}}) == 6 and jobs._behind(None, 3) is None


def test_entities_are_decoded(spark):
    from ledgerloom.operators import extract

    text, labels, width = "  Acme Ltd\tbilled é  $5 ", ["vendor", "amount"], 2
    spans = [(s, e) for s in range(5) for e in range(s + 1, min(s + width, 5) + 1)]
    score = {(0, 2, "vendor"): 3.0, (0, 1, "vendor"): 2.0, (2, 3, "vendor"): 3.0, (4, 5, "amount"): 0.0, (3, 5, "amount"): -0.5}
    logits = [score.get((s, e, x), -9.0) for s, e in spans for x in labels]
    df = spark.createDataFrame([(1, text, logits), (2, "", []), (3, None, None)], "doc_id int, text string, logits array<double>")
    got = extract.decode_entities(df, labels, 0.5, width)
    assert sorted((r.label, r.start, r.end, r.value, r.char_start) for r in got.collect()) == [("amount", 4, 5, "$5", 21), ("vendor", 0, 2, "Acme Ltd", 2), ("vendor", 2, 3, "billed", 11)]
    assert sorted((r.label, r.value) for r in extract.best_entities(got).collect()) == [("amount", "$5"), ("vendor", "billed")]
    assert [text[r.char_start : r.char_end] for r in got.where("label = 'vendor'").orderBy("start").collect()] == ["Acme Ltd", "billed"]
