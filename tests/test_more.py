import datetime
import hashlib
import hmac
import http.server
import json
import threading

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import fields
from ledgerloom.operators import cross_validate, extract, models, rollups, validate
from ledgerloom.sources import formats, stores
from ledgerloom.streaming import jobs, notify

at = datetime.datetime


def test_embed(spark, tmp_path):
    df = spark.createDataFrame([(1, "ab\n\ncd"), (2, None), (3, " ")], "id long, text string")
    encoder = lambda texts: [[float(len(t)), 0.0] for t in texts]
    assert {r.id: r.embedding for r in models.embed(df, "text", encoder, 2).collect()} == {1: [1, 0], 2: [0, 0], 3: [0, 0]}
    assert sorted((r.id, r.kind, r.position) for r in models.embed_documents(df, "id", "text", encoder, 2).where("id = 1").collect()) == [(1, "document", 0), (1, "section", 0), (1, "section", 1)]
    assert models.similar(models.embed(df, "text", encoder, 2), [1.0, 0.0], 1).first().id == 1
    (tmp_path / "a.pdf").write_bytes(b"%PDF x")
    assert models.read_files(spark, str(tmp_path), "*.pdf", bytes.decode).first().text == "%PDF x"


def test_webhook(spark):
    got = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            body = self.rfile.read(int(self.headers["Content-Length"]))
            got.append((body, self.headers["X-Signature"]))
            self.send_response(500 if len(got) == 1 else 200)
            self.end_headers()

        def log_message(self, *args):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    hook = notify.Webhook(f"http://127.0.0.1:{server.server_port}/x", "key", wait_s=0.01)
    out = hook.send(spark.createDataFrame([(1, "hi")], "id long, message string"), "id").collect()
    server.shutdown()
    assert [(r.id, r.tries, r.error) for r in out] == [(1, 2, "")]
    body, signature = got[-1]
    assert json.loads(body) == {"id": 1, "message": "hi"} and signature == "sha256=" + hmac.new(b"key", body, hashlib.sha256).hexdigest()
    assert notify.Webhook("http://127.0.0.1:9/none", "k", tries=1).post({})[1]


def test_digest(spark):
    df = spark.createDataFrame([("t", at(2024, 1, 1, 0, 5), "b"), ("t", at(2024, 1, 1, 0, 1), "a"), ("u", at(2024, 1, 1, 2), "c")], "tenant string, ts timestamp, message string")
    assert sorted((r.tenant, r.n, r.body) for r in rollups.digest(df, "tenant", "1 hour").collect()) == [("t", 2, "a\nb"), ("u", 1, "c")]


def test_confidence_and_spans(spark):
    df = spark.createDataFrame([(1, "x", 0.9), (1, "x", 0.4), (1, "y", 0.3)], "doc_id long, label string, score double")
    r = extract.confidence(df, 4).first()
    assert (r.mean, r.least, r.completeness, r.n_low) == (pytest.approx(0.6), 0.3, 0.5, 1)
    row = extract.field_spans(spark.createDataFrame([("Bill ACME now", "acme", "zz")], "text string, vendor string, po string"), "text", ["vendor", "po"]).first()
    assert [tuple(s) for s in row.spans] == [("vendor", 5, 9)]
    gates = spark.createDataFrame([("a.pdf", "", 1), ("b", "%PDF-1", 1), ("c", "x", 1), ("d.pdf", "", 0)], "n string, h string, s int")
    assert [r.x for r in gates.select(extract.accepts(F.col("n"), F.col("h"), F.col("s")).alias("x")).collect()] == [True, True, False, False]
    kinds = spark.range(1).select(extract.choose_parser(F.lit("x" * 100), True, False).alias("a"), extract.choose_parser(F.lit("x"), False, True).alias("b"), extract.escalates(F.lit(0.9), F.lit(0.5), F.lit(0.9)).alias("c")).first()
    assert tuple(kinds) == ("ner", "layout", True)


def test_kept_anomalies_and_baselines(spark):
    df = spark.createDataFrame([(1, "A", "Math", at(2024, 1, 2), 3.0), (2, "A", "Date", at(2024, 1, 3), None), (3, "B", "Math", at(2024, 1, 1), 1.0)], "id long, vendor_name string, anomaly_type string, detected_at timestamp, z_score double")
    pick = lambda **k: [r.id for r in stores.anomalies(df, **k).collect()]
    assert pick() == [2, 1, 3] and pick(vendor="A", limit=1) == [2] and pick(kind="Math") == [1, 3] and pick(since=at(2024, 1, 2)) == [2, 1] and pick(outliers=2.0) == [1] and pick(offset=2) == [3]
    base = spark.createDataFrame([(1, at(2024, 1, 1)), (2, at(2024, 1, 3))], "id long, expires_at timestamp")
    assert [r.id for r in stores.live_baselines(base, at(2024, 1, 2)).collect()] == [2]
    assert df.select(stores.baseline_key(F.col("vendor_name"), F.lit("total")).alias("k")).first().k == "A:total:r90"
    assert fields.page_offset(3, 20) == (20, 40) and fields.page_offset(0, 5000) == (1000, 0) and fields.display_name("tax_rate") == "tax rate"


def test_validation_stream(spark, tmp_path):
    cols = "id long, invoice_number string, vendor_name string, invoice_date date, due_date date, subtotal double, tax_amount double, discount_amount double, total_amount double"
    day = datetime.date
    df = spark.createDataFrame([(1, "A", "V", day(2024, 1, 1), None, 10.0, 0.0, 0.0, 10.0), (2, "B", "V", day(2024, 1, 1), day(2023, 1, 1), 500.0, 0.0, 0.0, 500.0)], cols)
    base = spark.createDataFrame([("V", 10, 10.0, 1.0)], "vendor_name string, n long, mean double, stddev double")
    df.write.parquet(str(tmp_path / "in"))
    out = jobs.validated(jobs.file_source(spark, str(tmp_path / "in"), df), base).select("id", "anomaly_count", "is_valid")
    jobs.run_available(out, str(tmp_path / "out"), str(tmp_path / "cp"))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == [(1, 0, True), (2, 2, False)]
    assert sorted(map(tuple, jobs.validated(df, base).select("id", "anomaly_count", "is_valid").collect())) == [(1, 0, True), (2, 2, False)]


def test_files(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.9, ["x"]), (2, 0.5, ["x"]), (3, 0.9, [])], "id long, confidence double, entities array<string>")
    formats.write_training_log(df, str(tmp_path / "log"))
    assert [r.id for r in spark.read.json(str(tmp_path / "log")).collect()] == [1]
    formats.append(df.select("id", "confidence"), str(tmp_path / "m"), ["id"])
    formats.append(df.select("id", "confidence"), str(tmp_path / "m"), ["id"])
    assert spark.read.parquet(str(tmp_path / "m")).count() == 6
    one = spark.createDataFrame([("a", None)], "x string, y string")
    assert one.select(formats.markdown(one).alias("l")).first().l == "| a |  |"
    assert one.select(formats.composite(one, ["x", "y"]).alias("l")).first().l == "a"


def test_issues_without_contract_values(spark):
    df = spark.createDataFrame([(5.0, None, "USD", None)], "total_amount double, total_value double, currency string, con_currency string")
    assert cross_validate.with_issues(df, F.col, lambda n: F.col("con_currency" if n == "currency" else n), [("total_amount", "total_value"), ("currency", "currency")]).first().issues == []
    assert validate.findings(lambda n: None, ["math_check"]) is not None
