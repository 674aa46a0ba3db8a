"""Queries over the driver's tables, one or more for each operator family, and the same in DuckDB's SQL."""

from __future__ import annotations

import re
from collections.abc import Callable
from datetime import date
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import fields, text as text_functions, vector
from ledgerloom.lang import json_form as J
from ledgerloom.operators import analyze, baseline, cross_validate, extract, graph, rollups, validate
from ledgerloom.plans.catalog import catalog, line_items, oracle, read, view
from ledgerloom.plans.engine import Engine
from ledgerloom.sources import formats, stores

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

AS_OF = date(1998, 8, 2)
VECTOR = [round(((i * 37) % 64 - 31.5) / 32, 4) for i in range(64)]
ZIP = "invoices inv {kind} ZIP contracts con ON inv.vendor_name = con.party_name"
DUCK_ZIP = "FROM invoices inv {kind} JOIN contracts con ON inv.vendor_name = con.party_name"
PARTS = "subtotal + tax_amount - discount_amount"


def add(name: str, run: Query, sql: str | None = None, views: bool = True) -> None:
    QUERIES[name] = run
    if sql:
        sql = re.sub(r"count_if\(", "count(*) FILTER (WHERE ", sql)
        ORACLES[name] = oracle(sql) if views else sql


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, for a comparison of values."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def ql(text: str, params: dict | None = None, report: str | None = None, then=None, **options) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        r = Engine(catalog(spark, sf_dir), **options).sql(text, params)
        df = r.reports[report] if report else r.rows
        return then(df) if then else rounded(df)

    return run


def js(form: dict, params: dict | None = None) -> Query:
    return lambda spark, sf_dir: rounded(Engine(catalog(spark, sf_dir)).json(form, params).rows)


# projections and filters
COLUMNS = "id, invoice_number, vendor_name, total_amount"


def _plain(name: str, where: str, sql_where: str | None = None, params: dict | None = None, table: str = "invoices", columns: str = COLUMNS) -> None:
    add(name, ql(f"SELECT {columns} FROM {table} WHERE {where}", params), f"SELECT {columns} FROM {table} WHERE {sql_where or where}")


add("select_columns", ql("SELECT id, invoice_number AS number, total_amount total FROM invoices"), "SELECT id, invoice_number AS number, total_amount AS total FROM invoices")
add("select_star", ql("SELECT * FROM contracts"), "SELECT * FROM contracts")
add("qualified_star", ql(f"SELECT inv.id AS invoice, con.* FROM {ZIP.format(kind='INNER')}"), f"SELECT inv.id AS invoice, {', '.join(f'con.{c} AS con_{c}' for c in ('id', 'title', 'contract_type', 'party_name', 'total_value', 'currency', 'effective_date', 'expiration_date'))} {DUCK_ZIP.format(kind='')}")
_plain("where_eq", "currency = 'USD'")
_plain("where_neq", "currency <> 'USD' AND currency != 'EUR'")
_plain("where_cmp_numeric", "total_amount >= 100000 AND total_amount < 250000.5")
_plain("where_cmp_date", "invoice_date >= '1995-01-01' AND invoice_date < '1996-01-01'")
_plain("where_and_or_not", "NOT (currency = 'USD' OR total_amount > 100000) AND po_number IS NOT NULL")
_plain("where_like", "invoice_number LIKE 'INV-1_0%'")
_plain("where_ilike", "vendor_name ILIKE 'cUSTOMER%1'")
_plain("where_is_null", "po_number IS NULL")
_plain("where_is_not_null", "due_date IS NOT NULL")
_plain("where_in", "currency IN ('USD', 'JPY') AND contract_id NOT IN (1, 2, 3)")
_plain("where_between", "total_amount BETWEEN 1000 AND 50000 AND invoice_date NOT BETWEEN '1995-01-01' AND '1996-12-31'", "total_amount BETWEEN 1000 AND 50000 AND invoice_date NOT BETWEEN DATE '1995-01-01' AND DATE '1996-12-31'")
_plain("where_arithmetic", "subtotal + tax_amount - discount_amount - total_amount > 0.01 OR id % 7 = 3")
_plain("where_param", "total_amount > :least AND vendor_name LIKE :pattern", "total_amount > 200000 AND vendor_name LIKE 'Customer%'", {"least": 200000, "pattern": "Customer%"})
add("select_arithmetic", ql("SELECT id, -total_amount AS negative, subtotal * 2 AS twice, tax_amount / subtotal AS rate, id % 10 AS digit, 'x' AS mark FROM invoices"), "SELECT id, -total_amount AS negative, subtotal * 2 AS twice, round(CAST(tax_amount AS DOUBLE) / CAST(nullif(subtotal, 0) AS DOUBLE), 6) AS rate, id % 10 AS digit, 'x' AS mark FROM invoices")

# the JSON form
add("json_nested_conditions", js(J.invoices().select("id", "currency").filter(J.any_of(J.all_of(J.eq("currency", "USD"), J.gt("total_amount", 100000)), J.negate(J.is_null("contract_id")))).build()), "SELECT id, currency FROM invoices WHERE (currency = 'USD' AND total_amount > 100000) OR NOT contract_id IS NULL")
add("json_between_negated", js(J.invoices().select("id").filter(J.between("total_amount", 1000, 200000, negated=True)).build()), "SELECT id FROM invoices WHERE total_amount NOT BETWEEN 1000 AND 200000")
add("json_in_empty", js(J.invoices().select("id").filter(J.one_of("currency", [])).build()), "SELECT id FROM invoices WHERE FALSE")
add("json_like_ci", js(J.contracts().select("id", "title").filter(J.like("title", "AGREEMENT 1%", case_insensitive=True)).build()), "SELECT id, title FROM contracts WHERE title ILIKE 'AGREEMENT 1%'")
_EXISTS = {"query": {"from": {"table": "contracts", "alias": "c"}, "where": {"left": "c.party_name", "op": "eq", "right": {"column": "invoices.vendor_name"}}}}
add("json_exists_semi", js({"from": "invoices", "select": ["id"], "where": {"exists": _EXISTS}}), "SELECT id FROM invoices WHERE EXISTS (SELECT 1 FROM contracts c WHERE c.party_name = invoices.vendor_name)")
add("json_not_exists_anti", js({"from": "invoices", "select": ["id"], "where": {"exists": {**_EXISTS, "negated": True}}}), "SELECT id FROM invoices WHERE NOT EXISTS (SELECT 1 FROM contracts c WHERE c.party_name = invoices.vendor_name)")
add("json_pipeline", js({"from": "invoices", "pipeline": [{"op": "filter", "condition": {"column": "total_amount", "op": "gt", "value": 0}}, {"op": "aggregate", "groupBy": ["currency"], "aggregates": [{"function": "sum", "field": "total_amount", "alias": "total"}]}]}), "SELECT currency, sum(total_amount) AS total FROM invoices WHERE total_amount > 0 GROUP BY currency")

# order and limit
add("order_by_multi", ql("SELECT id, currency, total_amount FROM invoices ORDER BY currency DESC, total_amount ASC, id"), "SELECT id, currency, total_amount FROM invoices ORDER BY currency DESC, total_amount, id")
add("order_by_expr", ql("SELECT id, total_amount - subtotal AS extra FROM invoices ORDER BY extra DESC, id"), "SELECT id, total_amount - subtotal AS extra FROM invoices ORDER BY extra DESC, id")
add("order_by_nulls_first", ql("SELECT id, due_date FROM invoices ORDER BY due_date NULLS FIRST, id"), "SELECT id, due_date FROM invoices ORDER BY due_date NULLS FIRST, id")
add("order_by_nulls_last", ql("SELECT id, due_date FROM invoices ORDER BY due_date DESC NULLS LAST, id"), "SELECT id, due_date FROM invoices ORDER BY due_date DESC NULLS LAST, id")
add("limit_offset", ql("SELECT id FROM invoices ORDER BY id LIMIT 20 OFFSET 40"), "SELECT id FROM invoices ORDER BY id LIMIT 20 OFFSET 40")
add("top_k", ql("SELECT invoice_number, total_amount FROM invoices WHERE total_amount > :least AND vendor_name LIKE 'Customer%' ORDER BY total_amount DESC, invoice_number LIMIT 10", {"least": 1000}), "SELECT invoice_number, total_amount FROM invoices WHERE total_amount > 1000 AND vendor_name LIKE 'Customer%' ORDER BY total_amount DESC, invoice_number LIMIT 10")
add("scan_page", lambda s, d: stores.scan(view(s, d, "invoices"), 30, 60).select("id", "total_amount"), "SELECT id, total_amount FROM invoices ORDER BY id LIMIT 30 OFFSET 60")
add("point_lookup", lambda s, d: stores.point(view(s, d, "invoices"), 7).select("id", "invoice_number"), "SELECT id, invoice_number FROM invoices WHERE id = 7")
add("count_rows", lambda s, d: view(s, d, "invoices").agg(F.count("*").alias("n")), "SELECT count(*) AS n FROM invoices")

# ZIP
PAIR = "inv.id AS invoice, con.id AS contract"


def _zip(name: str, kind: str, more: str = "", sql_more: str | None = None, columns: str = PAIR, **options) -> None:
    add(name, ql(f"SELECT {columns} FROM {ZIP.format(kind=kind)} {more}", **options), f"SELECT {columns} {DUCK_ZIP.format(kind=kind)} {more if sql_more is None else sql_more}")


_zip("zip_inner", "INNER")
_zip("zip_left", "LEFT")
_zip("zip_left_orphans", "LEFT", "WHERE con.id IS NULL", columns="inv.id AS invoice, inv.vendor_name AS vendor")
_zip("zip_where_mixed", "INNER", "WHERE inv.total_amount > con.total_value AND con.contract_type = 'BUILDING' AND inv.currency = 'USD'")
_zip("zip_cross_table_arith", "INNER", "WHERE inv.total_amount * 2 > con.total_value + 1000 OR inv.currency = con.currency")
_zip("zip_period", "INNER", "WHERE inv.invoice_date >= con.effective_date AND (con.expiration_date IS NULL OR inv.invoice_date <= con.expiration_date)")
_zip("zip_order_limit", "LEFT", "ORDER BY inv.total_amount DESC, inv.id LIMIT 40 OFFSET 10")
SMALL = "SELECT inv.id AS invoice, con.id AS contract FROM invoices inv CROSS ZIP contracts con ON inv.contract_id = con.id WHERE con.total_value > 500000"
add("zip_cross_filtered", ql(SMALL), "SELECT inv.id AS invoice, con.id AS contract FROM invoices inv JOIN contracts con ON inv.contract_id = con.id WHERE con.total_value > 500000")
add("zip_theta", ql("SELECT inv.id AS invoice, con.id AS contract FROM invoices inv ZIP contracts con ON inv.vendor_name = con.party_name AND inv.total_amount > con.total_value"), f"SELECT {PAIR} {DUCK_ZIP.format(kind='')} AND inv.total_amount > con.total_value")
add("zip_disjunctive", ql("SELECT inv.id AS invoice, con.id AS contract FROM invoices inv ZIP contracts con ON inv.vendor_name = con.party_name AND (inv.currency = con.currency OR inv.total_amount > 100000)"), f"SELECT {PAIR} {DUCK_ZIP.format(kind='')} AND (inv.currency = con.currency OR inv.total_amount > 100000)")
add("zip_inferred_link", ql("SELECT inv.id AS invoice, con.id AS contract FROM invoices inv ZIP contracts con ON inv.vendor_name = con.party_name", link_mode="inferred"), "SELECT inv.id AS invoice, con.id AS contract FROM invoices inv JOIN contracts con ON inv.contract_id = con.id UNION ALL SELECT inv.id, con.id FROM invoices inv JOIN contracts con ON inv.vendor_name = con.party_name WHERE inv.contract_id IS NULL")


add("zip_inferred_left", ql("SELECT inv.id AS invoice, con.id AS contract FROM invoices inv LEFT ZIP contracts con ON inv.vendor_name = con.party_name", link_mode="inferred"), "SELECT inv.id AS invoice, con.id AS contract FROM invoices inv LEFT JOIN contracts con ON inv.contract_id = con.id WHERE inv.contract_id IS NOT NULL UNION ALL SELECT inv.id, con.id FROM invoices inv LEFT JOIN contracts con ON inv.vendor_name = con.party_name WHERE inv.contract_id IS NULL")


def zip_cartesian(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs, of the two tables that are always small."""
    tables = {t: read(spark, sf_dir, t) for t in ("nation", "region")}
    form = {"from": {"table": "nation", "alias": "n"}, "select": ["n.n_name", "r.r_name"], "zip": {"mode": "cartesian", "table": "region", "alias": "r"}}
    return Engine(tables, products=True).json(form).rows


add("zip_cartesian", zip_cartesian, "SELECT n_name, r_name FROM nation, region", False)
add("zip_pair_score", ql("SELECT inv.id AS invoice, con.id AS contract, PAIR_SCORE(inv.total_amount, con.total_value) AS score FROM invoices inv LEFT ZIP contracts con ON inv.vendor_name = con.party_name", then=lambda df: df.withColumn("score", F.round(F.col("score").cast("double"), 4))), f"SELECT inv.id AS invoice, con.id AS contract, round(CAST(coalesce((total_amount + total_value) / 2, total_amount, total_value) AS DOUBLE), 4) AS score {DUCK_ZIP.format(kind='LEFT')}")
add("json_exists_or", js({"from": "invoices", "select": ["id"], "where": {"or": [{"exists": _EXISTS}, {"column": "total_amount", "op": "gt", "value": 250000}]}}), "SELECT id FROM invoices WHERE EXISTS (SELECT 1 FROM contracts c WHERE c.party_name = invoices.vendor_name) OR total_amount > 250000")

# aggregates
add("agg_global", ql("SELECT COUNT(*) AS n, SUM(total_amount) AS total, AVG(total_amount) AS mean, MIN(invoice_date) AS first_date, MAX(vendor_name) AS last_vendor, COUNT(po_number) AS n_po FROM invoices", then=lambda df: df.withColumn("mean", F.round(F.col("mean").cast("double"), 4))), "SELECT count(*) AS n, sum(total_amount) AS total, round(CAST(avg(total_amount) AS DOUBLE), 4) AS mean, min(invoice_date) AS first_date, max(vendor_name) AS last_vendor, count(po_number) AS n_po FROM invoices")
add("agg_expression", ql("SELECT SUM(total_amount) / COUNT(*) AS mean, MAX(total_amount) - MIN(subtotal) AS spread, COUNT(*) + 0 AS n FROM invoices |> FILTER n > 0", then=lambda df: df.withColumn("mean", F.round("mean", 4))), "SELECT round(CAST(sum(total_amount) AS DOUBLE) / count(*), 4) AS mean, max(total_amount) - min(subtotal) AS spread, count(*) + 0 AS n FROM invoices")
add("agg_no_rows", ql("SELECT SUM(total_amount) AS total, COUNT(*) AS n FROM invoices WHERE total_amount < 0 AND total_amount > 0", empty_sums=True, then=lambda df: df.withColumn("total", F.col("total").cast("double"))), "SELECT CAST(0 AS DOUBLE) AS total, CAST(0 AS BIGINT) AS n")
add("agg_group_by", ql("SELECT * FROM invoices |> AGGREGATE BY currency INTO count(*) AS n, sum(total_amount) AS total, max(total_amount) AS most"), "SELECT currency, count(*) AS n, sum(total_amount) AS total, max(total_amount) AS most FROM invoices GROUP BY currency")
add("agg_group_multi", ql(f"SELECT * FROM {ZIP.format(kind='LEFT')} |> AGGREGATE BY contract_type, inv.currency INTO count(inv.id) AS n, min(total_value) AS least"), f"SELECT contract_type, inv.currency AS currency, count(inv.id) AS n, min(total_value) AS least {DUCK_ZIP.format(kind='LEFT')} GROUP BY ALL")
add("agg_first_last", ql("SELECT * FROM invoices |> AGGREGATE BY vendor_name INTO first(total_amount) AS first_total, last(invoice_number) AS last_number"), "SELECT vendor_name, arg_min(total_amount, id) AS first_total, arg_max(invoice_number, id) AS last_number FROM invoices GROUP BY vendor_name")
add("agg_collect", ql("SELECT * FROM contracts |> AGGREGATE BY contract_type INTO collect(currency) AS currencies", then=lambda df: df.select("contract_type", F.array_join("currencies", ",").alias("currencies"))), "SELECT contract_type, string_agg(currency, ',' ORDER BY currency) AS currencies FROM contracts GROUP BY contract_type")
add("analyze_metrics", ql(f"SELECT * FROM {ZIP.format(kind='LEFT')} |> ANALYZE", report="analysis", then=lambda df: df.withColumn("average_invoice_amount", F.round(F.col("average_invoice_amount").cast("double"), 4))), f"SELECT sum(total_amount) AS total_invoice_amount, round(CAST(avg(total_amount) AS DOUBLE), 4) AS average_invoice_amount, count(inv.invoice_number) AS invoice_count, count(con.title) AS contract_count, count(*) AS pair_count {DUCK_ZIP.format(kind='LEFT')}")
add("zip_metadata", lambda s, d: analyze.zip_metadata(Engine(catalog(s, d)).sql(f"SELECT inv.id AS i, con.id AS c FROM {ZIP.format(kind='LEFT')}").rows, F.col("i"), F.col("c")), f"SELECT count(inv.id) AS invoice_count, count(con.id) AS contract_count, greatest(count(inv.id), count(con.id)) AS pair_count {DUCK_ZIP.format(kind='LEFT')}")

# search
_DOT = "list_sum(list_transform(range(1, 65), lambda i: CAST(embedding[i] AS DOUBLE) * q[i]))"
_DOCS = f"""q0 AS (SELECT CAST({VECTOR} AS DOUBLE[]) AS q),
docs AS (SELECT doc_id AS id, text, lang, source, CASE WHEN embedding IS NOT NULL THEN 1 - {_DOT} / (sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) * sqrt(list_sum(list_transform(q, lambda x: x * x)))) END AS distance
 FROM documents LEFT JOIN embeddings ON vec_id = doc_id, q0)"""


def _bm25(query: str) -> str:
    wanted = text_functions.query_terms(query)
    parts = " + ".join(f"{wanted.count(t)} * ln(((SELECT n FROM st) - (SELECT count(*) FROM tk WHERE list_contains(t, '{t}')) + 0.5) / ((SELECT count(*) FROM tk WHERE list_contains(t, '{t}')) + 0.5) + 1) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * len(t) / (SELECT total / n FROM st)))" for i, t in enumerate(sorted(set(wanted))))
    counts = ", ".join(f"len(list_filter(t, lambda x: x = '{t}')) AS f{i}" for i, t in enumerate(sorted(set(wanted))))
    return rf"""tk AS (SELECT doc_id, list_transform(list_filter(regexp_split_to_array(text, '[\s!-/:-@\[-`{{-~]+'), lambda x: strlen(x) >= 2), lambda x: lower(x)) AS t FROM documents),
st AS (SELECT count(*) AS n, CAST(sum(len(t)) AS DOUBLE) AS total FROM tk), tf AS (SELECT doc_id, t, {counts} FROM tk), scored AS (SELECT doc_id AS id, {parts} AS score FROM tf)"""


QUERY = "the thing, that other with the"
add("vector_top_k", ql("SELECT id, VECTOR_DISTANCE(embedding, :v) AS distance FROM documents WHERE embedding IS NOT NULL ORDER BY distance, id LIMIT 10", {"v": VECTOR}), f"WITH {_DOCS} SELECT id, round(distance, 6) AS distance FROM docs WHERE distance IS NOT NULL ORDER BY docs.distance, id LIMIT 10", False)
add("vector_threshold", ql("SELECT id FROM documents WHERE VECTOR_DISTANCE(embedding, :v) < 0.95", {"v": VECTOR}), f"WITH {_DOCS} SELECT id FROM docs WHERE distance < 0.95", False)
add("vector_filtered", lambda s, d: rounded(stores.vector_search(catalog(s, d)["documents"].frame(), VECTOR, 10, F.col("lang") == "en").select("id", "distance")), f"WITH {_DOCS} SELECT id, round(distance, 6) AS distance FROM docs WHERE distance IS NOT NULL AND lang = 'en' ORDER BY docs.distance, id LIMIT 10", False)
add("bm25_score", ql("SELECT id, BM25_SCORE(text, :q) AS score FROM documents", {"q": QUERY}), f"WITH {_bm25(QUERY)} SELECT id, round(score, 6) AS score FROM scored", False)
add("bm25_top_k", ql("SELECT id, BM25_SCORE(text, 'ernd than') AS score FROM documents ORDER BY score DESC, id LIMIT 10"), f"WITH {_bm25('ernd than')} SELECT id, round(score, 6) AS score FROM scored ORDER BY scored.score DESC, id LIMIT 10", False)
add("contains_terms", ql("SELECT id FROM documents WHERE CONTAINS(text, 'The AND with')"), rf"WITH {_bm25('the')} SELECT doc_id AS id FROM tk WHERE list_has_all(t, ['the', 'and', 'with'])", False)
add("hybrid_fusion", ql("SELECT id, HYBRID_SCORE(VECTOR_DISTANCE(embedding, :v), BM25_SCORE(text, :q)) AS score FROM documents WHERE embedding IS NOT NULL ORDER BY score DESC, id LIMIT 10", {"v": VECTOR, "q": QUERY}), f"WITH {_DOCS}, {_bm25(QUERY)} SELECT docs.id AS id, round(0.7 * (1 - least(distance, 1)) + 0.3 * least(score, 10) / 10, 6) AS score FROM docs JOIN scored USING (id) WHERE distance IS NOT NULL ORDER BY 0.7 * (1 - least(distance, 1)) + 0.3 * least(scored.score, 10) / 10 DESC, id LIMIT 10", False)


def fulltext_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").withColumnRenamed("doc_id", "id")
    index = formats.postings(docs, "text")
    return index.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))


add("fulltext_index", fulltext_index, rf"WITH {_bm25('the')}, e AS (SELECT doc_id, unnest(t) AS term FROM tk) SELECT term, count(DISTINCT doc_id) AS df, count(*) AS tf FROM e GROUP BY term", False)

_TK = r"list_transform(list_filter(regexp_split_to_array(coalesce({}, ''), '[\s!-/:-@\[-`{{-~]+'), lambda x: strlen(x) >= 2), lambda x: lower(x))"
_INDEX = f""", texts AS (SELECT 'invoices' AS type, id AS key, {_TK.format("concat_ws(' ', invoice_number, vendor_name, po_number)")} AS t FROM invoices
 UNION ALL SELECT 'contracts', id, {_TK.format("concat_ws(' ', title, party_name)")} FROM contracts),
cs AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM texts), post AS (SELECT type, key, len(t) AS length, unnest(t) AS term FROM texts),
tf AS (SELECT type, key, length, term, count(*) AS tf FROM post GROUP BY ALL), dfs AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
part AS (SELECT type, key, term, ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean)) AS score FROM tf JOIN dfs USING (term), cs)"""


def _search(query: str, limit: int, kind: str | None = None) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = formats.index(view(spark, sf_dir, "invoices"), "invoices").union(formats.index(view(spark, sf_dir, "contracts"), "contracts"))
        return rounded(formats.search(found, query, limit, kind))

    return run


add("fulltext_search", _search("agreement 000000007 PO", 50), f"{_INDEX} SELECT type, key, round(sum(score), 6) AS score FROM part WHERE term IN ('agreement', '000000007', 'po') GROUP BY type, key ORDER BY sum(part.score) DESC, type, key LIMIT 50")
add("fulltext_search_filtered", _search("+agreement customer 000000007 -000000010", 50, "contracts"), f"{_INDEX} SELECT type, key, round(sum(score) FILTER (WHERE term <> '000000010'), 6) AS score FROM part WHERE term IN ('agreement', '000000007', 'customer', '000000010') AND type = 'contracts' GROUP BY type, key HAVING bool_or(term = 'agreement') AND NOT bool_or(term = '000000010') ORDER BY sum(part.score) FILTER (WHERE term <> '000000010') DESC, type, key LIMIT 50")
add("fulltext_phrase", _search('"customer 000000007" AND inv', 50), f"{_INDEX} SELECT type, key, round(sum(score), 6) AS score FROM part WHERE term IN ('customer', '000000007', 'inv') GROUP BY type, key HAVING count(DISTINCT term) = 3 ORDER BY sum(part.score) DESC, type, key LIMIT 50")
add("bm25_composite", ql("SELECT id, BM25_SCORE(vendor_name, 'customer 000000007') AS score FROM invoices WHERE CONTAINS(vendor_name, '000000007')", bm25_corpus="composite"), f"""{_INDEX}, own AS (SELECT id, {_TK.format("vendor_name")} AS t FROM invoices), w AS (SELECT id, len(t) AS length, unnest(t) AS term FROM own WHERE list_contains(t, '000000007'))
 SELECT id, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * 2.2 / (1 + 1.2 * (0.25 + 0.75 * length / mean))), 6) AS score FROM w JOIN dfs USING (term), cs WHERE term IN ('customer', '000000007') GROUP BY id""")


def vector_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest of the index for every vector whose id is divisible by 100, and how many of them exact search finds too."""
    cells = stores.Cells()
    rows = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    indexed = cells.index(rows.repartition("id"), len(VECTOR))  # a file may be one task
    return stores.probe_search(indexed.where("id % 100 = 0"), indexed, cells, 5, 2).select("query", "rank", "id", F.round("distance", 6).alias("distance"))


# the index is approximate: its recall is held against exact search by a test, and SQL has nothing that it must equal
add("vector_probe", vector_probe)

# pipeline
_FINDING = "CAST({} AS INTEGER)"
_CHECKS = {"math_check": f"abs({PARTS} - total_amount) > 0.01", "date_check": "coalesce(due_date < invoice_date, FALSE)", "required_fields": "(invoice_number IS NULL OR trim(invoice_number) = '' OR vendor_name IS NULL OR trim(vendor_name) = '')"}
_counted = lambda df: df.select("id", F.size("anomalies").alias("n"), "is_valid")


def _validate(name: str, rules: list[str], fail_fast: bool = False) -> None:
    said = ", ".join(f"'{r}'" for r in rules)
    n = " + ".join(_FINDING.format(_CHECKS[r]) for r in rules)
    n = f"least({n}, 1)" if fail_fast else n
    add(name, ql(f"SELECT id FROM invoices |> VALIDATE WITH ({said})" + " FAIL_FAST" * fail_fast, then=_counted), f"SELECT id, {n} AS n, {n} = 0 AS is_valid FROM invoices")


_validate("validate_math", ["math_check"])
_validate("validate_dates", ["date_check"])
_validate("validate_required", ["required_fields"])
_validate("validate_fail_fast", ["math_check", "date_check", "required_fields"], True)
_validate("validate_all", ["math_check", "date_check", "required_fields"])
add("validation_summary", ql("SELECT id FROM invoices |> VALIDATE", report="validation"), f"SELECT count(*) AS total, count_if(ok) AS passed, count_if(NOT ok) AS failed FROM (SELECT NOT ({' OR '.join(_CHECKS.values())}) AS ok FROM invoices)")


def _cross(name: str, pair: str, condition: str, tolerance: str = "") -> None:
    add(name, ql(f"SELECT inv.id AS invoice, con.id AS contract FROM {ZIP.format(kind='INNER')} |> CROSS_VALIDATE ON {pair} {tolerance}", then=lambda df: df.where(F.size("issues") > 0).drop("issues")), f"SELECT {PAIR} {DUCK_ZIP.format(kind='')} WHERE {condition}")


_cross("cross_validate_amount", "(inv.total_amount, con.total_value)", "total_amount > total_value * 1.1", "TOLERANCE 0.1")
_cross("cross_validate_currency", "(currency, currency)", "inv.currency <> con.currency")
add("cross_validate_aliases", ql("SELECT x.id AS invoice, k.id AS contract FROM invoices x ZIP contracts k ON x.vendor_name = k.party_name |> CROSS_VALIDATE ON (currency, currency), (invoice_date, effective_date)", then=lambda df: df.select("invoice", "contract", F.size("issues").alias("n"))), f"SELECT {PAIR}, CAST(inv.currency <> con.currency AS INTEGER) + CAST(invoice_date <> effective_date AS INTEGER) AS n {DUCK_ZIP.format(kind='')}")
_cross("cross_validate_period", "(invoice_date, contract_period)", "invoice_date NOT BETWEEN effective_date AND expiration_date")
add("cross_validate_vendor", ql("SELECT inv.id AS invoice, con.id AS contract FROM invoices inv ZIP contracts con ON inv.contract_id = con.id |> CROSS_VALIDATE ON (vendor_name, party_name)", then=lambda df: df.select("invoice", "contract", F.size("issues").alias("n"))), "SELECT inv.id AS invoice, con.id AS contract, CAST(inv.vendor_name <> con.party_name AS INTEGER) AS n FROM invoices inv JOIN contracts con ON inv.contract_id = con.id")
add("cross_validate_issues", ql(f"SELECT inv.id AS invoice FROM {ZIP.format(kind='INNER')} |> CROSS_VALIDATE ON (total_amount, total_value), (currency, currency)", report="issues"), f"SELECT * FROM (SELECT 'AmountExceedsContract' AS type, 'High' AS severity, count(*) AS n {DUCK_ZIP.format(kind='')} WHERE total_amount > total_value UNION ALL SELECT 'CurrencyMismatch', 'Medium', count(*) {DUCK_ZIP.format(kind='')} WHERE inv.currency <> con.currency)")
add("pipe_filter", ql(f"SELECT inv.id AS invoice FROM {ZIP.format(kind='LEFT')} |> FILTER con.id IS NULL AND total_amount > 1000"), f"SELECT inv.id AS invoice {DUCK_ZIP.format(kind='LEFT')} WHERE con.id IS NULL AND total_amount > 1000")
add("pipe_sort", ql("SELECT id, po_number FROM invoices |> SORT BY po_number DESC, id"), "SELECT id, po_number FROM invoices ORDER BY po_number DESC NULLS FIRST, id")
add("pipe_take", ql("SELECT id FROM invoices ORDER BY id |> TAKE 10 OFFSET 5"), "SELECT id FROM invoices ORDER BY id LIMIT 10 OFFSET 5")
add("pipe_transform", ql("SELECT * FROM invoices |> TRANSFORM id AS key, total_amount - subtotal AS extra |> FILTER extra > 0"), "SELECT id AS key, total_amount - subtotal AS extra FROM invoices WHERE total_amount - subtotal > 0")

# rules
_LINE = "SELECT l_orderkey AS id, l_linenumber, CAST(l_quantity AS DECIMAL(18,4)) * CAST(l_extendedprice / l_quantity AS DECIMAL(18,4)) AS product, CAST(l_extendedprice AS DECIMAL(18,4)) AS total FROM lineitem"
_R = {"line": "NULL", "total": f"abs({PARTS} - total_amount) > 0.01", "date": "coalesce(due_date < invoice_date, FALSE)", "positive": "total_amount <= 0"}
add("rules_structural", lambda s, d: validate.completion(validate.structural(view(s, d, "invoices"))).select("id", "anomaly_count", "high_severity_count", "is_valid"), f"SELECT id, {' + '.join(_FINDING.format(_R[k]) for k in ('total', 'date', 'positive'))} AS anomaly_count, {' + '.join(_FINDING.format(_R[k]) for k in ('total', 'positive'))} AS high_severity_count, NOT ({_R['total']} OR {_R['date']} OR {_R['positive']}) AS is_valid FROM invoices")
add("rules_line_items", lambda s, d: line_items(s, d).select("id", F.size(validate.line_findings(F.col("line_items"))).alias("n")).where("n > 0"), f"SELECT id, CAST(count(*) AS INTEGER) AS n FROM ({_LINE}) WHERE abs(product - total) > 0.01 GROUP BY id", False)
_TABLE = [validate.Rule("large", "total_amount > 300000", "critical", "total_amount"), validate.Rule("no_order", "po_number IS NULL", "warning", "po_number"), validate.Rule("early", "invoice_date < DATE '1993-01-01'")]
add("rules_custom_table", lambda s, d: validate.decision_table(view(s, d, "invoices"), _TABLE).select("id", F.array_join(F.transform("anomalies", lambda a: F.concat(a["rule"], F.lit(":"), a["severity"])), ",").alias("fired")), "SELECT id, concat_ws(',', CASE WHEN total_amount > 300000 THEN 'large:High' END, CASE WHEN po_number IS NULL THEN 'no_order:Low' END, CASE WHEN invoice_date < DATE '1993-01-01' THEN 'early:Medium' END) AS fired FROM invoices")
add("possible_duplicates", lambda s, d: validate.possible_duplicates(view(s, d, "invoices").withColumn("invoice_number", F.col("currency"))), "SELECT vendor_name, currency AS invoice_number, total_amount, count(*) AS n, min(id) AS first_id FROM invoices GROUP BY ALL HAVING count(*) > 1")

# statistics
_NR = lambda p: f"list_sort(list(x))[CAST(round({p / 100} * (count(x) - 1)) AS INTEGER) + 1]"
_BASE = f"SELECT vendor_name, count(x) AS n, avg(x) AS mean, stddev_pop(x) AS stddev, min(x) AS low, max(x) AS high, {', '.join(f'{_NR(p)} AS p{p}' for p in (25, 50, 75, 90, 95, 99))} FROM (SELECT *, CAST(total_amount AS DOUBLE) AS x FROM invoices) GROUP BY vendor_name"
_RB = "SELECT vendor_name, n, round(mean, 6) AS mean, round(stddev, 6) AS stddev, low, high FROM b"
add("baseline_stats", lambda s, d: rounded(baseline.statistics(view(s, d, "invoices"), ["vendor_name"], "total_amount").select("vendor_name", "n", "mean", "stddev", "low", "high")), f", b AS ({_BASE}) {_RB}")
add("baseline_percentiles", lambda s, d: baseline.statistics(view(s, d, "invoices"), ["vendor_name"], "total_amount").select("vendor_name", "p25", "p50", "p75", "p90", "p95", "p99"), f", b AS ({_BASE}) SELECT vendor_name, p25, p50, p75, p90, p95, p99 FROM b")
_W90 = "OVER (PARTITION BY vendor_name ORDER BY invoice_date RANGE BETWEEN INTERVAL 90 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING)"
add("baseline_rolling_90d", lambda s, d: rounded(baseline.rolling(view(s, d, "invoices"), "vendor_name", "invoice_date", "total_amount", 90).select("id", "n", "mean", "stddev")), f"SELECT id, count(x) {_W90} AS n, round(avg(x) {_W90}, 6) AS mean, round(stddev_pop(x) {_W90}, 6) AS stddev FROM (SELECT *, CAST(total_amount AS DOUBLE) AS x FROM invoices)")
add("baseline_month_of_year", lambda s, d: rounded(baseline.month_of_year(view(s, d, "invoices"), "currency", "invoice_date", "total_amount").select("currency", "month", "n", "mean", "p95")), f"SELECT currency, CAST(month(invoice_date) AS INTEGER) AS month, count(x) AS n, round(avg(x), 6) AS mean, {_NR(95)} AS p95 FROM (SELECT *, CAST(total_amount AS DOUBLE) AS x FROM invoices) GROUP BY currency, month(invoice_date)")
_SC = f", b AS ({_BASE}), s AS (SELECT id, i.vendor_name, CAST(total_amount AS DOUBLE) AS x, b.* EXCLUDE (vendor_name), CASE WHEN stddev = 0 THEN 0 ELSE (CAST(total_amount AS DOUBLE) - mean) / stddev END AS z FROM invoices i JOIN b USING (vendor_name) WHERE n >= 5)"
_SEG = [(0, "low"), *[(p, f"p{p}") for p in (25, 50, 75, 90, 95, 99)], (100, "high")]
_PCT = "CASE " + " ".join(f"WHEN x <= {b} THEN CASE WHEN {b} = {a} THEN {p}.0 ELSE {p} + (x - {a}) / ({b} - {a}) * {q - p} END" for (p, a), (q, b) in zip(_SEG[:-1], _SEG[1:], strict=True)) + " ELSE 100.0 END"
add("z_scores", lambda s, d: rounded(baseline.scores(view(s, d, "invoices"), "vendor_name", "total_amount").select("id", F.col("z_score").alias("z"), "is_outlier")), f"{_SC} SELECT id, round(z, 6) AS z, abs(z) > 2 AS is_outlier FROM s")
add("percentile_of", lambda s, d: rounded(baseline.scores(view(s, d, "invoices"), "vendor_name", "total_amount").select("id", "percentile"), 4), f"{_SC} SELECT id, round({_PCT}, 4) AS percentile FROM s")
add("outliers", lambda s, d: baseline.outliers(view(s, d, "invoices"), "vendor_name", "total_amount").select("id", "severity", "actual_value"), f"{_SC} SELECT id, 'Medium' AS severity, printf('%.2f', x) AS actual_value FROM s WHERE abs(z) > 2")
_TREND = "CASE WHEN n < 3 THEN 'Stable' WHEN sd / nullif(abs(m), 0) > 0.5 THEN 'Volatile' WHEN sl / greatest(abs(m), 1) > 0.1 THEN 'Increasing' WHEN sl / greatest(abs(m), 1) < -0.1 THEN 'Decreasing' ELSE 'Stable' END"
add("trend", lambda s, d: baseline.trends(view(s, d, "invoices"), "vendor_name", "invoice_date", "total_amount").select("vendor_name", "n", "trend"), f"SELECT vendor_name, n, {_TREND} AS trend FROM (SELECT vendor_name, count(x) AS n, coalesce(regr_slope(x, -k), 0) AS sl, avg(x) AS m, stddev_pop(x) AS sd FROM (SELECT vendor_name, CAST(total_amount AS DOUBLE) AS x, row_number() OVER (PARTITION BY vendor_name ORDER BY invoice_date DESC, id DESC) AS k FROM invoices) WHERE k <= 10 GROUP BY vendor_name)")
add("analyze_baseline", ql("SELECT id FROM invoices |> ANALYZE BASELINE vendor_name WINDOW 365 DAYS THRESHOLD 1.5 METRICS total_amount", then=lambda df: df.select("id", "total_amount_samples", "total_amount_outlier")), "SELECT id, n AS total_amount_samples, coalesce(n >= 5 AND abs(CASE WHEN sd = 0 THEN 0 ELSE (x - m) / sd END) > 1.5, FALSE) AS total_amount_outlier FROM (SELECT id, x, count(x) OVER w AS n, avg(x) OVER w AS m, stddev_pop(x) OVER w AS sd FROM (SELECT *, CAST(total_amount AS DOUBLE) AS x FROM invoices) WINDOW w AS (PARTITION BY vendor_name ORDER BY invoice_date RANGE BETWEEN INTERVAL 365 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING))")
add("running_stats_every_10", lambda s, d: rounded(baseline.running(read(s, d, "events"), ["event_type"], ["event_id"], "value"), 10).drop("event_id"), "SELECT event_type, n, round(mean, 10) AS mean, round(stddev, 10) AS stddev, low, high FROM (SELECT event_type, count(value) OVER w AS n, avg(value) OVER w AS mean, coalesce(stddev_samp(value) OVER w, 0) AS stddev, min(value) OVER w AS low, max(value) OVER w AS high FROM events WINDOW w AS (PARTITION BY event_type ORDER BY event_id ROWS UNBOUNDED PRECEDING)) WHERE n >= 10 AND n % 10 = 0", False)
add("moving_average", lambda s, d: rounded(baseline.moving_average(read(s, d, "events"), "event_type", ["event_id"], "value").select("event_id", "moving_avg")), "SELECT event_id, round(avg(value) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 6) AS moving_avg FROM events", False)

# graph


def _graph(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return graph.build(view(spark, sf_dir, "invoices"), view(spark, sf_dir, "contracts"))


_G = ", key AS (SELECT *, concat('vendor:', replace(lower(trim(vendor_name)), ' ', '_')) AS vendor FROM invoices), g AS (SELECT DISTINCT id AS invoice, contract_id AS contract FROM invoices WHERE contract_id IS NOT NULL)"
add("graph_invoices_for_vendor", lambda s, d: graph.invoices_for_vendor(_graph(s, d), "Customer#000000001"), f"{_G} SELECT id AS invoice FROM key WHERE vendor = 'vendor:customer#000000001'")
add("graph_related_contracts", lambda s, d: graph.related_contracts(_graph(s, d)), f"{_G} SELECT invoice, contract FROM g UNION SELECT k.id, g.contract FROM key k JOIN key k2 USING (vendor) JOIN g ON g.invoice = k2.id")
add("graph_vendor_network", lambda s, d: graph.vendor_network(_graph(s, d)), f"{_G} SELECT vendor, count(DISTINCT key.id) AS n_invoices, count(DISTINCT contract) AS n_contracts FROM key LEFT JOIN g ON g.invoice = key.id GROUP BY vendor")
add("graph_traverse_depth2", ql("SELECT id FROM invoices |> GRAPH TRAVERSE vendor_name DEPTH 2", then=lambda df: df.select("id", "graph_vendor_id", F.size("graph_related_invoices").alias("n_invoices"), F.size("graph_related_contracts").alias("n_contracts"))), f"{_G} SELECT id, vendor AS graph_vendor_id, CAST(n AS INTEGER) AS n_invoices, CAST(m AS INTEGER) AS n_contracts FROM key JOIN (SELECT vendor, count(DISTINCT id) AS n, count(DISTINCT contract_id) AS m FROM key GROUP BY vendor) USING (vendor)")
add("graph_enrich", ql("SELECT id FROM invoices |> GRAPH ENRICH", then=lambda df: df.select("id", F.array_join(F.col("graph_contracts").cast("array<string>"), ",").alias("contracts"), "graph_vendor_invoice_count")), "SELECT id, coalesce(CAST(contract_id AS VARCHAR), '') AS contracts, count(*) OVER (PARTITION BY vendor_name) AS graph_vendor_invoice_count FROM invoices")
add("graph_node_counts", lambda s, d: graph.node_counts(_graph(s, d)), "SELECT 'vendor' AS label, count(DISTINCT vendor_name) AS n FROM invoices UNION ALL SELECT 'invoice', count(*) FROM invoices UNION ALL SELECT 'contract', count(*) FROM contracts UNION ALL SELECT 'party', count(DISTINCT party_name) FROM contracts")
add("entity_same_as", lambda s, d: graph.same_as(_graph(s, d)["vendor"], _graph(s, d)["party"], "name"), "SELECT DISTINCT concat('vendor:', replace(lower(trim(vendor_name)), ' ', '_')) AS left_key, concat('party:', replace(lower(trim(party_name)), ' ', '_')) AS right_key FROM invoices JOIN contracts ON vendor_name = party_name")

add("graph_neighbours", lambda s, d: graph.neighbours(view(s, d, "invoices")), f"{_G} SELECT vendor, 'invoice' AS kind, CAST(id AS VARCHAR) AS node FROM key UNION SELECT vendor, 'contract', CAST(contract_id AS VARCHAR) FROM key WHERE contract_id IS NOT NULL")
add("graph_contracts_of_vendors", lambda s, d: graph.contracts_of_vendors(_graph(s, d)), f"{_G} SELECT DISTINCT vendor, contract_id AS contract FROM key WHERE contract_id IS NOT NULL")
add("graph_billed_to", lambda s, d: graph.build(view(s, d, "invoices").withColumn("bill_to_name", F.col("currency")), view(s, d, "contracts"))["billed_to"], "SELECT concat('party:', lower(currency)) AS party, id AS invoice FROM invoices")
add("graph_link", lambda s, d: graph.link(_graph(s, d), view(s, d, "invoices").where("contract_id is null").select(F.col("id").alias("invoice"), F.lit(1).cast("long").alias("contract")))["governed_by"], "SELECT id AS invoice, coalesce(contract_id, 1) AS contract FROM invoices")

# rollups
_ERR = "event_type = 'click'"
add("rollup_hourly", lambda s, d: rounded(rollups.rollup(read(s, d, "events"), "hour", ["event_type"], error=F.expr("value < 10")), 10), "SELECT date_trunc('hour', ts) AS bucket, event_type, count(*) AS n, round(avg(value), 10) AS mean, round(quantile_cont(value, 0.5), 10) AS p50, round(quantile_cont(value, 0.95), 10) AS p95, round(quantile_cont(value, 0.99), 10) AS p99, count_if(value < 10) AS n_errors FROM events GROUP BY ALL", False)
add("rollup_daily", lambda s, d: rounded(rollups.daily(read(s, d, "events"), ["event_type"], success=F.expr("value >= 10")), 10), "SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n, count_if(value >= 10) AS n_success, round(avg(value), 10) AS mean, round(sum(value), 10) AS total FROM events GROUP BY ALL", False)
add("error_rate_series", lambda s, d: rounded(rollups.error_rates(read(s, d, "events"), "15 minutes", F.expr(_ERR)), 10), f"SELECT time_bucket(INTERVAL 15 MINUTE, ts) AS bucket, count(*) AS total, count_if({_ERR}) AS errors, round(count_if({_ERR}) / count(*), 10) AS error_rate FROM events GROUP BY ALL", False)
add("tenant_summary", lambda s, d: rounded(rollups.tenant_summary(read(s, d, "events"), "event_type", F.expr("value < 10")), 10), "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS n_users, round(sum(value), 10) AS total, max(ts) AS last_at, round(count_if(value < 10) / count(*), 10) AS error_rate FROM events GROUP BY event_type", False)


def anomaly_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = validate.structural(view(spark, sf_dir, "invoices")).select("id", F.explode("anomalies").alias("a"))
    return stores.anomaly_statistics(found.select("a.severity", F.when(F.col("id") % 3 == 0, "Resolved").otherwise("Open").alias("status"), F.col("a.type").alias("anomaly_type")))


add("anomaly_stats", anomaly_stats, f", a AS (SELECT id, 'High' AS severity, 'MathMismatch' AS t FROM invoices WHERE {_R['total']} UNION ALL SELECT id, 'Medium', 'DateInconsistency' FROM invoices WHERE {_R['date']} UNION ALL SELECT id, 'High', 'OutOfRange' FROM invoices WHERE {_R['positive']}) SELECT 'severity' AS dimension, severity AS value, count(*) AS n FROM a GROUP BY severity UNION ALL SELECT 'status', CASE WHEN id % 3 = 0 THEN 'Resolved' ELSE 'Open' END, count(*) FROM a GROUP BY 2 UNION ALL SELECT 'anomaly_type', t, count(*) FROM a GROUP BY t UNION ALL SELECT 'total', 'all', count(*) FROM a")

# stores
_AGE = "date_diff('day', invoice_date, DATE '1998-08-02')"
_TIER = f"CASE WHEN {_AGE} <= 30 THEN 'hot' WHEN {_AGE} <= 365 THEN 'warm' ELSE 'cold' END"
add("tier_assignment", lambda s, d: stores.with_tier(view(s, d, "invoices"), AS_OF).select("id", "tier"), f"SELECT id, {_TIER} AS tier FROM invoices")
add("tier_distribution", lambda s, d: stores.distribution(stores.with_tier(view(s, d, "invoices"), AS_OF)), f"SELECT {_TIER} AS tier, count(*) AS n FROM invoices GROUP BY 1")
def tier_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hot store keeps a year; the warm one already has what is older than 30 days, so both hold what lies between."""
    rows, age = view(spark, sf_dir, "invoices"), F.datediff(F.lit(AS_OF), "invoice_date")
    return stores.union_tiers(rows.where(age <= 365).select("id", "total_amount"), rows.where(age > 30).select("id", "total_amount"))


add("tier_union_dedup", tier_union, f"SELECT id, total_amount, CASE WHEN {_AGE} <= 365 THEN 'hot' ELSE 'warm' END AS tier FROM invoices")
add("tier_migration", lambda s, d: stores.migrate(view(s, d, "invoices").select("id", "invoice_date"), view(s, d, "invoices").select("id", "invoice_date").where("id % 9 = 0"), AS_OF, 400)[1], "SELECT id, invoice_date FROM invoices WHERE invoice_date < DATE '1998-08-02' - INTERVAL 400 DAY OR id % 9 = 0")
add("retention_sweep", lambda s, d: stores.sweep_statistics(stores.sweep(view(s, d, "invoices"), stores.Retention(100, 700, 1500), AS_OF), ["currency"]), f"SELECT currency, count_if(g < 100) AS n_hot, count_if(g >= 100 AND g < 700) AS n_warm, count_if(g >= 700 AND g < 1500) AS n_cold, count_if(g >= 1500) AS n_soft_delete, CAST(0 AS BIGINT) AS n_hard_delete FROM (SELECT currency, {_AGE} AS g FROM invoices) GROUP BY currency")
add("tenant_scoped", lambda s, d: stores.Tenant("EUR").read(view(s, d, "invoices").withColumn("tenant_id", F.col("currency"))).select("id", "tenant_id"), "SELECT id, currency AS tenant_id FROM invoices WHERE currency = 'EUR'")
add("upsert", lambda s, d: stores.upsert(view(s, d, "invoices").select("id", "total_amount"), view(s, d, "invoices").where("id % 5 = 0").select("id", (F.col("total_amount") * 0).cast("decimal(18,2)").alias("total_amount"))), "SELECT id, CAST(CASE WHEN id % 5 = 0 THEN 0 ELSE total_amount END AS DECIMAL(18,2)) AS total_amount FROM invoices")
add("delete_keys", lambda s, d: stores.delete(view(s, d, "invoices"), view(s, d, "contracts")).select("id"), "SELECT id FROM invoices WHERE id NOT IN (SELECT id FROM contracts)")
add("invoice_filter", lambda s, d: view(s, d, "invoices").where(stores.InvoiceFilter(vendor="00001", date_from=date(1994, 1, 1), currency="EUR").condition()).select("id"), "SELECT id FROM invoices WHERE contains(vendor_name, '00001') AND invoice_date >= DATE '1994-01-01' AND currency = 'EUR'")
add("rate_limit_window", lambda s, d: rollups.rate_limited(read(s, d, "events"), ["user_id"], 86400, 3).select("event_id", "in_window", "rejected"), "SELECT event_id, count(*) OVER w AS in_window, count(*) OVER w > 3 AS rejected FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 86399999999 MICROSECOND PRECEDING AND CURRENT ROW)", False)
add("quota_usage", lambda s, d: rollups.quota(read(s, d, "events").withColumn("one", F.lit(1)), ["user_id"], ["event_id"], "one", 5).select("event_id", "used", "over_quota"), "SELECT event_id, count(*) OVER w AS used, count(*) OVER w > 5 AS over_quota FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)", False)

_FOUND = f", a AS (SELECT id, 'High' AS severity, 'MathMismatch' AS t FROM invoices WHERE {_R['total']} UNION ALL SELECT id, 'Medium', 'DateInconsistency' FROM invoices WHERE {_R['date']} UNION ALL SELECT id, 'High', 'OutOfRange' FROM invoices WHERE {_R['positive']}), s AS (SELECT *, CASE WHEN id % 3 = 0 THEN 'Resolved' ELSE 'Open' END AS status FROM a)"


def _anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = validate.structural(view(spark, sf_dir, "invoices")).select("id", "invoice_date", F.explode("anomalies").alias("a"))
    status = F.when(F.col("id") % 3 == 0, "Resolved").otherwise("Open")
    at = F.timestamp_add("HOUR", F.pmod(F.col("id"), F.lit(24)).cast("int"), F.col("invoice_date").cast("timestamp_ntz"))
    return found.select("id", F.col("a.type").alias("anomaly_type"), "a.severity", status.alias("status"), at.alias("detected_at"), ((F.col("id") % 10) / 10).alias("confidence"), *[F.lit(None).cast(t).alias(c) for c, t in (("resolved_by", "string"), ("resolved_at", "timestamp_ntz"), ("resolution_notes", "string"))])


_AT = "CAST(invoice_date AS TIMESTAMP) + INTERVAL 1 HOUR * (id % 24)"
add("rollup_anomalies_hourly", lambda s, d: rounded(rollups.anomaly_rollup(_anomalies(s, d))), f"{_FOUND} SELECT date_trunc('hour', {_AT}) AS bucket, t AS anomaly_type, severity, count(*) AS n, round(avg((id % 10) / 10), 6) AS mean_confidence, count_if(status = 'Resolved') AS n_resolved FROM s JOIN invoices USING (id) GROUP BY ALL")
add("anomaly_update", lambda s, d: stores.update_anomalies(_anomalies(s, d), view(s, d, "contracts").select("id", F.lit("Dismissed").alias("status"), F.lit("me").alias("resolved_by"), F.lit(None).cast("timestamp_ntz").alias("resolved_at"), F.lit("seen").alias("resolution_notes"))).select("id", "anomaly_type", "status", "resolved_by"), f"{_FOUND} SELECT s.id AS id, t AS anomaly_type, CASE WHEN c.id IS NOT NULL THEN 'Dismissed' ELSE status END AS status, CASE WHEN c.id IS NOT NULL THEN 'me' END AS resolved_by FROM s LEFT JOIN contracts c ON c.id = s.id")
add("anomaly_cleanup", lambda s, d: stores.clean_anomalies(_anomalies(s, d), date(1995, 1, 1)).select("id", "anomaly_type"), f"{_FOUND} SELECT id, t AS anomaly_type FROM s JOIN invoices USING (id) WHERE NOT (status = 'Resolved' AND {_AT} < TIMESTAMP '1995-01-01')")
add("anomaly_recent_count", lambda s, d: baseline.recent_anomalies(_anomalies(s, d), "anomaly_type", "detected_at", 30).select("id", "anomaly_type", "n_recent"), f"{_FOUND}, d AS (SELECT s.id AS id, t AS anomaly_type, CAST({_AT} AS DATE) AS day FROM s JOIN invoices USING (id)) SELECT id, anomaly_type, count(*) OVER (PARTITION BY anomaly_type ORDER BY day RANGE BETWEEN INTERVAL 30 DAY PRECEDING AND CURRENT ROW) AS n_recent FROM d")
add("system_stats", lambda s, d: rounded(stores.system_statistics(view(s, d, "invoices"), view(s, d, "contracts"), _anomalies(s, d))), f"{_FOUND} SELECT (SELECT count(*) FROM invoices) + (SELECT count(*) FROM contracts) AS documents, (SELECT count(*) FROM invoices) AS invoices, (SELECT count(*) FROM contracts) AS contracts, (SELECT sum(total_amount) FROM invoices) AS total_amount, count(*) AS anomalies, round(100.0 * count_if(status = 'Open') / count(*), 6) AS open_anomaly_rate FROM s")
add("baseline_store", lambda s, d: stores.store_baselines(*[stores.computed_baselines(baseline.statistics(view(s, d, "invoices").where(c), ["vendor_name"], "total_amount").select("vendor_name", "n"), "vendor_name", "total_amount", at).select("id", "n", "computed_at") for c, at in (("invoice_date < '1995-01-01'", AS_OF), ("invoice_date >= '1997-01-01'", date(1998, 9, 1)))]).select("id", "n"), "SELECT concat_ws(':', vendor_name, 'total_amount', 'r90') AS id, coalesce(nullif(count_if(invoice_date >= DATE '1997-01-01'), 0), count_if(invoice_date < DATE '1995-01-01')) AS n FROM invoices GROUP BY vendor_name HAVING count_if(invoice_date >= DATE '1997-01-01') + count_if(invoice_date < DATE '1995-01-01') > 0")
add("upsert_repeated_keys", lambda s, d: stores.upsert(view(s, d, "contracts").select("id", F.lit("old").alias("mark")), read(s, d, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("mark"))), "SELECT o_custkey AS id, max(o_orderpriority) AS mark FROM orders GROUP BY 1 UNION ALL SELECT id, 'old' FROM contracts WHERE id NOT IN (SELECT o_custkey FROM orders)")
_POLICIES = {"USD": stores.Retention(100, 700, 1500), "EUR": stores.Retention(10, 70, 150, True)}
add("retention_by_type", lambda s, d: stores.sweep_by_type(view(s, d, "invoices"), _POLICIES, AS_OF, "currency").select("id", "action"), f"SELECT id, CASE currency WHEN 'USD' THEN CASE WHEN g < 100 THEN 'hot' WHEN g < 700 THEN 'warm' WHEN g < 1500 THEN 'cold' ELSE 'soft_delete' END WHEN 'EUR' THEN CASE WHEN g < 10 THEN 'hot' WHEN g < 70 THEN 'warm' WHEN g < 150 THEN 'cold' ELSE 'hard_delete' END ELSE 'hot' END AS action FROM (SELECT id, currency, {_AGE} AS g FROM invoices)")
add("list_documents", lambda s, d: stores.list_documents(view(s, d, "invoices").select("id", F.lit("invoice").alias("type"), "vendor_name", F.col("currency").alias("status"), F.col("invoice_date").alias("date")), kind="invoice", status="USD", since=date(1994, 1, 1), page=3, page_size=40).select("id", "date"), "SELECT id, invoice_date AS date FROM invoices WHERE currency = 'USD' AND invoice_date >= DATE '1994-01-01' ORDER BY invoice_date DESC, id LIMIT 40 OFFSET 80")
add("hybrid_store_search", lambda s, d: stores.hybrid_search(view(s, d, "invoices"), None, stores.InvoiceFilter(min_amount=Decimal(1000), max_amount=Decimal(90000)), 25).select("id"), "SELECT id FROM invoices WHERE total_amount BETWEEN 1000 AND 90000 ORDER BY id LIMIT 25")
add("rate_limit_retry", lambda s, d: rollups.rate_limited(read(s, d, "events"), ["user_id"], 86400, 3).where("rejected").select("event_id", "retry_after"), "SELECT event_id, CAST(ceil((epoch_us(oldest) + 86400000000 - epoch_us(ts)) / 1000000) AS BIGINT) AS retry_after FROM (SELECT event_id, ts, count(*) OVER w AS n, min(ts) OVER w AS oldest FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 86399999999 MICROSECOND PRECEDING AND CURRENT ROW)) WHERE n > 3", False)
add("shard_hash", lambda s, d: view(s, d, "invoices").select(fields.shard(F.col("currency"), F.lit("invoice"), 8).alias("shard"), "currency").distinct().groupBy("currency").agg(F.count("*").alias("n_shards"), (F.min("shard") >= 0).alias("low"), (F.max("shard") < 8).alias("high")), "SELECT currency, CAST(1 AS BIGINT) AS n_shards, TRUE AS low, TRUE AS high FROM invoices GROUP BY currency")
add("date_trunc", ql("SELECT id, DATE_TRUNC('month', invoice_date) AS month FROM invoices", then=lambda df: df.withColumn("month", F.to_date("month"))), "SELECT id, CAST(date_trunc('month', invoice_date) AS DATE) AS month FROM invoices")

# extraction
add("vendor_key", lambda s, d: view(s, d, "contracts").select("id", fields.entity_key("party", F.col("party_name")).alias("key")), "SELECT id, concat('party:', replace(lower(trim(party_name)), ' ', '_')) AS key FROM contracts")
add("doc_type_detect", lambda s, d: read(s, d, "documents").select("doc_id", fields.document_type(F.lit(None).cast("string"), F.concat("source", F.when(F.col("doc_id") % 3 == 0, "_NDA").otherwise(""))).alias("kind")), "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'contract' ELSE 'invoice' END AS kind FROM documents", False)


def _made(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "invoices")
    return rows.select("id", F.concat(F.lit("Invoice No: "), "invoice_number", F.lit("\nFrom: "), "vendor_name", F.lit("\nDate: "), F.col("invoice_date").cast("string"), F.lit("\nService $"), F.col("subtotal").cast("string"), F.lit("\nTotal $"), F.format_number(F.greatest("subtotal", "total_amount"), 2), F.lit(" "), "currency").alias("text"))


add("extract_amounts", lambda s, d: _made(s, d).select("id", F.array_max(extract.amounts(F.col("text"))).cast("decimal(18,2)").alias("most")).where("most is not null"), "SELECT id, greatest(subtotal, total_amount) AS most FROM invoices")
add("extract_dates", lambda s, d: _made(s, d).select("id", F.try_element_at(extract.dates(F.col("text")), F.lit(1)).alias("found")), "SELECT id, invoice_date AS found FROM invoices")
add("extract_currency", lambda s, d: _made(s, d).select("id", fields.detect_currency(F.replace("text", F.lit("$"), F.lit(""))).alias("currency")), "SELECT id, currency FROM invoices")
add("extract_invoice", lambda s, d: extract.invoice(_made(s, d)).select("id", "invoice_number", "invoice_date", "vendor_name", F.size("line_items").alias("n_items")), "SELECT id, invoice_number, invoice_date, vendor_name, CAST(1 AS INTEGER) AS n_items FROM invoices")
add("cross_validate_checks", lambda s, d: cross_validate.named_checks(view(s, d, "invoices").join(view(s, d, "contracts").withColumnRenamed("currency", "con_currency").withColumnRenamed("id", "con_id"), F.col("contract_id") == F.col("con_id")), F.col, lambda n: F.col("con_currency" if n == "currency" else n), ["amount", "currency"]).select("id", "con_id", F.size("issues").alias("n")), "SELECT i.id AS id, c.id AS con_id, CAST(coalesce(total_amount > total_value, FALSE) AS INTEGER) + CAST(i.currency <> c.currency AS INTEGER) AS n FROM invoices i JOIN contracts c ON i.contract_id = c.id")
add("normalized_vectors", lambda s, d: read(s, d, "embeddings").select("vec_id", F.round(vector.norm(vector.normalize(F.col("embedding"))), 6).alias("length")), "SELECT vec_id, CAST(CASE WHEN list_sum(list_transform(embedding, lambda x: abs(x))) = 0 THEN 0 ELSE 1 END AS DOUBLE) AS length FROM embeddings", False)
