"""The vendor graph as node and edge tables; traversals are joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.fields import entity_key


def build(invoices: DataFrame, contracts: DataFrame) -> dict[str, DataFrame]:
    """Node tables vendor, invoice, contract, party and edge tables supplies, billed_to, governed_by, party_to; keys once each.

    Parties are those of contracts and, where invoices have a bill_to_name, those that they bill.
    """
    named = invoices.where(F.col("vendor_name").isNotNull() & ~F.col("vendor_name").isin("", "Unknown", "Unknown Vendor"))
    vendor, party = entity_key("vendor", F.col("vendor_name")), entity_key("party", F.col("party_name"))
    parties = contracts.where("party_name is not null").select(party.alias("key"), F.col("party_name").alias("name"))
    billed = invoices.select("id", "bill_to_name").where("trim(bill_to_name) <> ''") if "bill_to_name" in invoices.columns else None
    billed_to = contracts.select(F.lit("").alias("party"), F.col("id").alias("invoice")).limit(0)
    if billed is not None:
        payer = entity_key("party", F.col("bill_to_name"))
        parties = parties.union(billed.select(payer, "bill_to_name"))
        billed_to = billed.select(payer.alias("party"), F.col("id").alias("invoice")).distinct()
    return {
        "billed_to": billed_to,
        "vendor": named.groupBy(vendor.alias("key")).agg(F.min("vendor_name").alias("name")),
        "invoice": invoices.select(F.col("id").alias("key"), "invoice_number", "invoice_date", "total_amount").dropDuplicates(["key"]),
        "contract": contracts.select(F.col("id").alias("key"), "title", "total_value").dropDuplicates(["key"]),
        "party": parties.groupBy("key").agg(F.min("name").alias("name")),
        "supplies": named.select(vendor.alias("vendor"), F.col("id").alias("invoice")).distinct(),
        "governed_by": invoices.where("contract_id is not null").select(F.col("id").alias("invoice"), F.col("contract_id").alias("contract")).distinct(),
        "party_to": contracts.where("party_name is not null").select(party.alias("party"), F.col("id").alias("contract")).distinct(),
    }


def clauses(contracts: DataFrame, most: int = 2000) -> DataFrame:
    """Clause nodes with their contract; texts are cut to a number of bytes."""
    each = contracts.select(F.col("id").alias("contract"), F.posexplode("clauses").alias("k", "c"))
    cut = F.make_valid_utf8(F.substring(F.encode(F.col("c.text"), "UTF-8"), 1, most).cast("string"))
    return each.select("contract", F.coalesce("c.clause_id", F.concat_ws("#", "contract", "k")).alias("key"), F.col("c.clause_type").alias("type"), F.col("c.title").alias("title"), F.regexp_replace(cut, "�+$", "").alias("text"))


def link(graph: dict[str, DataFrame], more: DataFrame) -> dict[str, DataFrame]:
    """The graph with more governed_by edges (invoice, contract)."""
    return graph | {"governed_by": graph["governed_by"].union(more.select("invoice", "contract")).distinct()}


def node_counts(graph: dict[str, DataFrame]) -> DataFrame:
    out = None
    for label in ("vendor", "invoice", "contract", "party"):
        one = graph[label].agg(F.count("*").alias("n")).select(F.lit(label).alias("label"), "n")
        out = one if out is None else out.union(one)
    return out


def invoices_for_vendor(graph: dict[str, DataFrame], name: str) -> DataFrame:
    key = entity_key("vendor", F.lit(name))
    return graph["supplies"].where(F.col("vendor") == key).select("invoice")


def related_contracts(graph: dict[str, DataFrame]) -> DataFrame:
    """(invoice, contract): its own contracts, and those of other invoices of its vendor.

    The vendor's contracts are made unique before they meet its invoices, so pairs of invoices never arise.
    """
    shared = graph["supplies"].join(contracts_of_vendors(graph), "vendor").select("invoice", "contract")
    return graph["governed_by"].select("invoice", "contract").union(shared).distinct()


def contracts_of_vendors(graph: dict[str, DataFrame]) -> DataFrame:
    """(vendor, contract), each once: with `supplies` as membership it is related_contracts, a row a vendor and not an invoice."""
    return graph["supplies"].join(graph["governed_by"], "invoice").select("vendor", "contract").distinct()


def vendor_network(graph: dict[str, DataFrame]) -> DataFrame:
    """Each vendor's invoices and contracts, counted."""
    contracts = graph["supplies"].join(graph["governed_by"], "invoice", "left")
    return contracts.groupBy("vendor").agg(F.countDistinct("invoice").alias("n_invoices"), F.countDistinct("contract").alias("n_contracts"))


def same_as(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """SAME_AS edges between two labels' nodes of an equal property."""
    return left.select(F.col("key").alias("left_key"), F.col(on).alias("__v")).join(right.select(F.col("key").alias("right_key"), F.col(on).alias("__v")), "__v").select("left_key", "right_key")


def traverse(df: DataFrame, field: Column | None, invoices: DataFrame, contracts: DataFrame | None, depth: int) -> tuple[DataFrame, list[str]]:
    """The GRAPH TRAVERSE step: graph_vendor_id, graph_related_invoices, and from depth 2 graph_related_contracts.

    The lists repeat with each of a vendor's rows; `neighbours` has them as edges, a row each.
    """
    key = entity_key("vendor", F.col("vendor_name"))
    lists = {"graph_related_invoices": "id"} | ({"graph_related_contracts": "contract_id"} if depth > 1 else {})
    near = invoices.where("vendor_name is not null").groupBy(key.alias("__key")).agg(*[F.array_sort(F.collect_set(c)).alias(name) for name, c in lists.items()])
    names = ["graph_vendor_id", *lists]
    own = df.withColumn("graph_vendor_id", entity_key("vendor", field if field is not None else F.lit(None).cast("string")))
    out = own.join(near, own["graph_vendor_id"] == near["__key"], "left")
    return out.select(*df.columns, *names), names


def neighbours(invoices: DataFrame, depth: int = 2) -> DataFrame:
    """(vendor, kind, node): what GRAPH TRAVERSE reaches from each vendor, an edge a row, each once."""
    key = entity_key("vendor", F.col("vendor_name")).alias("vendor")
    named = invoices.where("vendor_name is not null")
    out = named.select(key, F.lit("invoice").alias("kind"), F.col("id").cast("string").alias("node"))
    if depth > 1:
        out = out.union(named.where("contract_id is not null").select(key, F.lit("contract"), F.col("contract_id").cast("string")))
    return out.distinct()


def enrich(df: DataFrame, invoice_id: Column, vendor: Column, invoices: DataFrame) -> tuple[DataFrame, list[str]]:
    """The GRAPH ENRICH step: graph_contracts by id, and graph_vendor_invoice_count."""
    own = invoices.where("contract_id is not null").groupBy(F.col("id").alias("__id")).agg(F.array_sort(F.collect_set("contract_id")).alias("graph_contracts"))
    counts = invoices.groupBy(F.col("vendor_name").alias("__vendor")).agg(F.count("*").alias("graph_vendor_invoice_count"))
    keyed = df.withColumn("__own", invoice_id).withColumn("__name", vendor)
    out = keyed.join(own, F.col("__own") == F.col("__id"), "left").join(counts, F.col("__name") == F.col("__vendor"), "left")
    names = ["graph_contracts", "graph_vendor_invoice_count"]
    filled = out.withColumn("graph_contracts", F.coalesce("graph_contracts", F.array().cast(own.schema["graph_contracts"].dataType)))
    return filled.select(*df.columns, *names), names
