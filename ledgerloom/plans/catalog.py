"""The tables that queries name. Over the driver's star schema, invoices and contracts are views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.plans.engine import Wide

#: The views in SQL that Spark and DuckDB both read; {table} stands for a table.
VIEWS = """
li AS (SELECT l_orderkey, count(*) AS line_item_count,
 sum(CAST(l_extendedprice AS DECIMAL(12,2))) AS subtotal,
 round(sum(CAST(l_extendedprice AS DECIMAL(12,2))*CAST(l_discount AS DECIMAL(4,2))),2) AS discount_amount,
 round(sum(CAST(l_extendedprice AS DECIMAL(12,2))*(1-CAST(l_discount AS DECIMAL(4,2)))*CAST(l_tax AS DECIMAL(4,2))),2) AS tax_amount
 FROM {lineitem} GROUP BY l_orderkey),
invoices AS (SELECT o_orderkey AS id, concat('INV-', CAST(o_orderkey AS STRING)) AS invoice_number, CAST(o_orderdate AS DATE) AS invoice_date,
 CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 20 = 0 THEN CAST(CAST(o_orderdate AS DATE) - INTERVAL 5 DAY AS DATE)
      ELSE CAST(CAST(o_orderdate AS DATE) + INTERVAL 30 DAY AS DATE) END AS due_date,
 c_name AS vendor_name, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE concat('PO-', CAST(o_orderkey % 1000 AS STRING)) END AS po_number,
 CASE WHEN o_orderkey % 5 = 0 THEN o_custkey END AS contract_id,
 CASE c_nationkey % 4 WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' WHEN 2 THEN 'GBP' ELSE 'JPY' END AS currency,
 CAST(coalesce(li.subtotal,0) AS DECIMAL(18,2)) AS subtotal, CAST(coalesce(li.tax_amount,0) AS DECIMAL(18,2)) AS tax_amount,
 CAST(coalesce(li.discount_amount,0) AS DECIMAL(18,2)) AS discount_amount,
 CAST(CASE WHEN o_orderkey % 10 = 0 THEN CAST(o_totalprice AS DECIMAL(18,2))
      ELSE coalesce(li.subtotal+li.tax_amount-li.discount_amount,0) END AS DECIMAL(18,2)) AS total_amount,
 CAST(coalesce(li.line_item_count,0) AS BIGINT) AS line_item_count
 FROM {orders} JOIN {customer} ON o_custkey=c_custkey LEFT JOIN li ON l_orderkey=o_orderkey),
contracts AS (SELECT c_custkey AS id, concat('Agreement ', CAST(c_custkey AS STRING)) AS title, c_mktsegment AS contract_type, c_name AS party_name,
 CASE WHEN c_acctbal<=0 THEN NULL ELSE CAST(CAST(c_acctbal AS DECIMAL(12,2))*100 AS DECIMAL(18,2)) END AS total_value,
 CASE WHEN c_nationkey % 3 = 0 THEN 'USD' ELSE 'EUR' END AS currency,
 DATE '1996-01-01' AS effective_date, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE DATE '2000-12-31' END AS expiration_date
 FROM {customer} WHERE c_custkey % 3 <> 0)
"""


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tables = {t: read(spark, sf_dir, t) for t in ("lineitem", "orders", "customer")}
    return spark.sql(f"WITH {VIEWS} SELECT * FROM {name}", **tables)


def oracle(sql: str) -> str:
    """The same views before a DuckDB query."""
    # a query that begins with a comma adds to the WITH list
    return f"WITH {VIEWS.format(lineitem='lineitem', orders='orders', customer='customer')} {sql}"


def line_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invoice id and its nested line items, for the line rules."""
    item = F.struct(
        F.col("l_linenumber").alias("line_number"), F.col("l_quantity").cast("decimal(18,4)").alias("quantity"), (F.col("l_extendedprice") / F.col("l_quantity")).cast("decimal(18,4)").alias("unit_price"), F.col("l_extendedprice").cast("decimal(18,4)").alias("total")
    )
    return read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.sort_array(F.collect_list(item)).alias("line_items"))


def searchable(spark: SparkSession, sf_dir: str) -> Wide:
    """Documents, with their vectors where these are named."""
    vectors = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return Wide(read(spark, sf_dir, "documents").withColumnRenamed("doc_id", "id"), vectors, "id")


def catalog(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame | Wide]:
    return {"invoices": view(spark, sf_dir, "invoices"), "contracts": view(spark, sf_dir, "contracts"), "documents": searchable(spark, sf_dir)}
