import datetime

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import fields, text, vector
from ledgerloom.functions.statistics import percentile_of, z_score
from ledgerloom.operators import baseline, extract, graph, rollups, validate
from ledgerloom.sources import formats, stores
from ledgerloom.streaming import jobs

day = datetime.date


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


@pytest.mark.parametrize(("said", "want"), [("2024-01-31", day(2024, 1, 31)), ("1/31/2024", day(2024, 1, 31)), ("31/1/2024", day(2024, 1, 31)), ("January 5, 2024", day(2024, 1, 5)), ("5 Jan 2024", day(2024, 1, 5)), ("31.12.2024", day(2024, 12, 31)), ("soon", None), ("", None)])
def test_dates(spark, said, want):
    assert one(spark, fields.parse_date(F.lit(said))) == want


@pytest.mark.parametrize(("said", "want"), [("1,234.50", 1234.5), ("$ 5", 5), ("(3.25)", -3.25), ("x", None)])
def test_amounts(spark, said, want):
    got = one(spark, fields.parse_amount(F.lit(said)))
    assert got == want if want is None else float(got) == want


def test_vectors(spark):
    a, b = vector.literal([3, 4]), vector.literal([4, 3])
    assert one(spark, vector.cosine_similarity(a, b)) == pytest.approx(0.96)
    assert one(spark, vector.cosine_similarity(a, vector.literal([1]))) == 0
    assert one(spark, vector.normalize(a)) == [0.6, 0.8] and one(spark, vector.normalize(vector.literal([0]))) == [0]


def test_terms(spark):
    assert one(spark, text.terms(F.lit("A Fox's é x, THE end"))) == ["fox", "é", "the", "end"]
    assert text.query_terms("A Fox's é x, THE end") == ["fox", "é", "the", "end"]


def test_statistics(spark):
    df = spark.createDataFrame([("a", i, day(2024, 1, 1) + datetime.timedelta(i), float(v)) for i, v in enumerate((100, 200, 300, 400, 500))], "vendor_name string, id long, invoice_date date, m double")
    r = baseline.statistics(df, ["vendor_name"], "m").first()
    assert (r.n, r.mean, r.low, r.high, r.p50, r.p75) == (5, 300, 100, 500, 300, 400)
    assert one(spark, z_score(F.lit(1200.0), F.lit(1000.0), F.lit(100.0))) == 2 and one(spark, z_score(F.lit(1.0), F.lit(0.0), F.lit(0.0))) == 0
    points = {p: F.lit(float(p)) for p in (25, 50, 75, 90, 95, 99)}
    at = lambda v: one(spark, percentile_of(F.lit(v), F.lit(10.0), points, F.lit(120.0)))
    assert at(130.0) == 100 and at(10.0) == 0 and at(50.0) == 50 and at(-5.0) < 0
    assert baseline.trends(df, "vendor_name", "invoice_date", "m").first().trend == "Increasing"
    running = baseline.running(spark.range(25).select(F.lit("k").alias("k"), "id", F.col("id").cast("double").alias("v")), ["k"], ["id"], "v").collect()
    assert [r.n for r in running] == [10, 20]


def test_rules(spark):
    items = "array<struct<quantity:decimal(18,4),unit_price:decimal(18,4),total:decimal(18,4)>>"
    df = spark.sql(f"SELECT 1 AS id, 'A' AS vendor_name, 'INV-1' AS invoice_number, CAST(5 AS DECIMAL(18,2)) AS subtotal, CAST(0 AS DECIMAL(18,2)) AS tax_amount, CAST(0 AS DECIMAL(18,2)) AS discount_amount, CAST(5 AS DECIMAL(18,2)) AS total_amount, 0.5D AS confidence_score, CAST(array(struct(2, 2, 4), struct(1, 1, 2)) AS {items}) AS line_items")
    assert [a.field for a in validate.structural(df).first().anomalies] == ["subtotal", "confidence_score", "line_items[1].total"]
    table = validate.decision_table(spark.sql("SELECT -5 AS amount UNION ALL SELECT 100"), [validate.Rule("positive", "amount <= 0", "critical")])
    assert {r.amount: r.is_valid for r in table.collect()} == {-5: False, 100: True}


INVOICE = "ACME\nInvoice No: INV-2024-001\nFrom: Acme Corp\nDate: 2024-01-15\nDue Date:\n2024-02-15\nPO Number: PO-77\nWidgets  $1,000.00\nBolts  $50.00\nSubtotal: $1,050.00\nTax: $84.00\nTotal: $1,134.00\n"


def test_extraction(spark):
    df = spark.createDataFrame([(1, INVOICE), (2, None)], "id long, text string")
    rows = {r.id: r for r in extract.invoice(df).collect()}
    assert (rows[1].invoice_number, rows[1].vendor_name, float(rows[1].total_amount), rows[1].invoice_date) == ("INV-2024-001", "Acme Corp", 1134.0, day(2024, 1, 15))
    assert rows[2].invoice_number.startswith("UNKNOWN-") and rows[2].total_amount is None
    lines = extract.line_rules(df).where("id = 1").first()
    assert (lines.due_date, float(lines.subtotal), float(lines.tax_amount), float(lines.total_amount), lines.po_number) == (day(2024, 2, 15), 1050.0, 84.0, 1134.0, "PO-77")
    c = extract.contract(spark.createDataFrame([(1, "Master Service Agreement\nMSA-2024-001 between Acme Corp and Client Inc.\nEffective: 2024-01-01\nExpires: 2025-12-31\nTotal value: $150,000\nPayment, termination and liability.")], "id long, text string")).first()
    assert (c.contract_type, c.contract_number, c.parties, c.effective_date, c.expiration_date, float(c.total_value)) == ("MasterServiceAgreement", "MSA-2024-001", ["Acme Corp", "Client Inc"], day(2024, 1, 1), day(2025, 12, 31), 150000.0)
    assert c.clause_types == ["Payment", "Termination", "Liability"]
    spans = spark.createDataFrame([(1, "x", 0, 5, 0.9), (1, "x", 1, 5, 0.8), (1, "x", 10, 12, 0.7), (1, "y", 0, 5, 0.1)], "doc_id long, label string, start long, end long, score double")
    assert sorted((r.label, r.start) for r in extract.best_spans(spans).collect()) == [("x", 0), ("x", 10), ("y", 0)]


def test_graph(spark):
    inv = spark.createDataFrame([(1, "A 1", None), (2, "a 1", 7), (3, "B", None)], "id long, vendor_name string, contract_id long").selectExpr("*", "'n' AS invoice_number", "DATE '2024-01-01' AS invoice_date", "1 AS total_amount")
    con = spark.createDataFrame([(7, "t", "A 1")], "id long, title string, party_name string").selectExpr("*", "1 AS total_value")
    g = graph.build(inv, con)
    assert {r.label: r.n for r in graph.node_counts(g).collect()} == {"vendor": 2, "invoice": 3, "contract": 1, "party": 1}
    assert sorted(map(tuple, graph.related_contracts(g).collect())) == [(1, 7), (2, 7)]


def test_stores(spark):
    df = spark.createDataFrame([(1, "t1", day(2024, 1, 1)), (2, "t2", day(2020, 1, 1)), (3, "t1", None)], "id long, tenant_id string, invoice_date date")
    tiers = {r.id: r.tier for r in stores.with_tier(df, day(2024, 1, 31)).collect()}
    assert tiers == {1: "hot", 2: "cold", 3: "cold"}
    hot, warm = stores.migrate(df, df.limit(0), day(2024, 1, 31))
    assert hot.count() == 2 and warm.count() == 1
    actions = {r.id: r.action for r in stores.sweep(df, stores.Retention(30, 365, 1000), day(2024, 1, 31)).collect()}
    assert actions[1] == "warm" and actions[2] == "soft_delete"
    with pytest.raises(stores.TenantError):
        stores.Tenant("t1").check(df)
    assert stores.Tenant("t1").read(df).count() == 2
    assert stores.upsert(df, df.where("id = 1")).count() == 3 and stores.delete(df, df.where("id = 1")).count() == 2


def test_formats(spark, tmp_path):
    (tmp_path / "a.nt").write_text('# c\n<http://x/p> <http://www.w3.org/1999/02/22-rdf-syntax-ns#type> <http://x/Person> .\n<http://x/p> <http://x/name> "A \\"B\\"" .\n<http://x/p> <http://x/knows> <http://x/q> .\n')
    t = formats.read_ntriples(spark, str(tmp_path / "a.nt"))
    assert formats.nodes_by_type(t).count() == 1 and formats.edges_by_predicate(t).count() == 1
    assert t.where("is_literal").first().object == 'A "B"'
    df = spark.createDataFrame([('a "q"', "x,y", 1)], "a string, b string, c int")
    assert df.select(formats.csv_line(df).alias("l")).first().l == 'a "q","x,y",1'.replace('a "q"', '"a ""q"""')
    docs = spark.createDataFrame([(1, "quick fox"), (2, "lazy dog lazy")], "id long, text string")
    found = formats.index(docs, "invoices", ["text"])
    assert [r.key for r in formats.search(found, "lazy cat", 5).collect()] == [2]


def test_streams_equal_batch(spark, tmp_path):
    events = spark.createDataFrame([(i, "k%d" % (i % 2), datetime.datetime(2024, 1, 1, i % 5, i % 60), float(i)) for i in range(60)], "event_id long, k string, ts timestamp, value double")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = jobs.file_source(spark, str(tmp_path / "in"), events, 10)
    jobs.run_available(jobs.running_baselines(stream, "k", "value", "event_id"), str(tmp_path / "out"), str(tmp_path / "cp"))
    want = baseline.running(events, ["k"], ["event_id"], "value").drop("event_id")
    got = spark.read.parquet(str(tmp_path / "out"))
    rows = lambda df: sorted((r.k, r.n, round(r.mean, 6), round(r.stddev, 6), r.low, r.high) for r in df.collect())
    assert rows(got) == rows(want)
    q = jobs.rollup(stream, "1 hour", ["k"], "10 minutes").writeStream.outputMode("complete").format("memory").queryName("hours").trigger(availableNow=True).start()
    q.awaitTermination()
    hourly = rollups.rollup(events, "hour", ["k"])
    assert sorted((r.bucket, r.k, r.n) for r in spark.table("hours").collect()) == sorted((r.bucket, r.k, r.n) for r in hourly.collect())


def test_ingest_stream(spark, tmp_path):
    texts = spark.createDataFrame([(1, INVOICE), (2, "nothing here")], "id long, text string")
    texts.write.parquet(str(tmp_path / "in"))
    stream = jobs.file_source(spark, str(tmp_path / "in"), texts, 10)
    jobs.ingest(stream, jobs.idempotent(str(tmp_path / "ok")), jobs.idempotent(str(tmp_path / "dead")), str(tmp_path / "cp")).awaitTermination()
    assert [r.id for r in spark.read.parquet(str(tmp_path / "ok")).collect()] == [1]
    assert [r.id for r in spark.read.parquet(str(tmp_path / "dead")).collect()] == [2]


def test_limits(spark):
    events = spark.createDataFrame([(i, "u", datetime.datetime(2024, 1, 1, 0, 0, i * 10)) for i in range(5)], "id long, u string, ts timestamp")
    assert [r.rejected for r in rollups.rate_limited(events, ["u"], 30, 2).orderBy("id").collect()] == [False, False, True, True, True]
