"""Files in and out: postings of a full-text index, N-Triples, JSON lines, tables as Markdown and CSV, Kafka."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import text as text_functions

_TERM = r'(<[^>]*>|_:\S+|"(?:[^"\\]|\\.)*"(?:\^\^<[^>]*>|@[\w-]+)?)'
_TRIPLE = rf"^\s*{_TERM}\s+{_TERM}\s+{_TERM}\s*\.\s*(?:#.*)?$"
TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"


#: Fixed: the columns whose texts make up the searchable text of a document.
COMPOSITE = {
    "invoices": ("invoice_number", "vendor_name", "bill_to_name", "po_number", "vendor_tax_id", "item_descriptions", "extracted_text"),
    "contracts": ("contract_number", "title", "party_name", "party_names", "clause_titles", "clause_texts", "extracted_text"),
}


def composite(df: DataFrame, columns: Sequence[str]) -> Column:
    """The searchable text of a row: its columns joined by spaces, nulls left out, arrays joined too."""
    kinds = dict(df.dtypes)
    return F.concat_ws(" ", *[F.array_join(c, " ") if kinds[c].startswith("array<string") else F.col(c).cast("string") for c in columns if c in kinds])


def postings(df: DataFrame, text: str, key: str = "id") -> DataFrame:
    """An inverted index: term, key, term frequency and document length."""
    each = df.select(key, text_functions.terms(F.coalesce(F.col(text), F.lit(""))).alias("t"))
    return each.select(key, F.size("t").alias("length"), F.explode("t").alias("term")).groupBy("term", key, "length").agg(F.count("*").alias("tf"))


@dataclass(frozen=True)
class Index:
    """A full-text index as tables: postings (term, field, key, tf, length) and documents (key, type, length)."""

    postings: DataFrame
    documents: DataFrame

    def union(self, other: Index) -> Index:
        return Index(self.postings.unionByName(other.postings), self.documents.unionByName(other.documents))

    def delete(self, keys: DataFrame) -> Index:
        """The index without the documents (key, type) of `keys`; statistics follow, as they are counted when searching."""
        gone = keys.select("key", "type").distinct()
        return Index(self.postings.join(gone, ["key", "type"], "left_anti"), self.documents.join(gone, ["key", "type"], "left_anti"))


def index(df: DataFrame, kind: str, columns: Sequence[str] | None = None, fields: Sequence[str] = (), key: str = "id") -> Index:
    """Indexes the composite text of each row (field "text"), and single columns beside it."""
    texts = F.array(*[F.struct(F.lit(name).alias("field"), x.alias("value")) for name, x in [("text", composite(df, columns or COMPOSITE[kind])), *((f, F.col(f).cast("string")) for f in fields)]])
    each = df.select(F.col(key).alias("key"), F.inline(texts)).select("key", "field", text_functions.terms(F.coalesce("value", F.lit(""))).alias("t"))
    sized = each.select("key", F.lit(kind).alias("type"), "field", F.size("t").alias("length"), "t")
    counted = sized.select("key", "type", "field", "length", F.explode("t").alias("term")).groupBy("term", "field", "key", "type", "length").agg(F.count("*").alias("tf"))
    return Index(counted, sized.where("field = 'text'").select("key", "type", "length"))


_CLAUSE = re.compile(r"""([+-]|(?:AND|OR|NOT)\s+)?(?:(\w+):)?(?:"([^"]*)"|(\S+))""")


def clauses(query: str) -> list[tuple[str, str, list[str]]]:
    """(must, should or not; field; terms) of each clause of a query: words, +word, -word, NOT word, AND, OR, field:word and "several words".

    AND makes both sides must. A clause of several terms, quoted or not, holds where all of them do.
    """
    out: list[tuple[str, str, list[str]]] = []
    for sign, name, quoted, word in _CLAUSE.findall(query):
        sign = sign.strip()
        terms = text_functions.query_terms(quoted or word)
        if not terms or (not sign and not name and word in ("AND", "OR", "NOT")):
            continue
        if sign == "AND" and out and out[-1][0] == "should":
            out[-1] = ("must", *out[-1][1:])
        out.append(({"+": "must", "AND": "must", "-": "not", "NOT": "not"}.get(sign, "should"), name or "text", terms))
    return out


def search(found: Index, query: str, limit: int, kind: str | None = None) -> DataFrame:
    """key, type and score of the best documents by BM25; ties by type and key. Statistics are those of the whole index.

    A document matches if all `must` clauses and no `not` clause hold, and, without a `must`, some `should` clause does.
    """
    said = clauses(query)
    statistics = found.documents.agg(F.count("*").alias("n"), F.coalesce(F.avg("length"), F.lit(0.0)).alias("mean"))
    wanted: dict[tuple[str, str], int] = {}
    for role, name, terms in said:
        for t in terms:
            wanted[name, t] = wanted.get((name, t), 0) + (role != "not")
    if not any(role != "not" for role, _, _ in said):
        return found.documents.select("key", "type", F.lit(0.0).alias("score")).limit(0)
    is_one = reduce(lambda a, b: a | b, [(F.col("field") == name) & (F.col("term") == t) for name, t in wanted])
    hits = found.postings.where(is_one)
    df = hits.groupBy("field", "term").agg(F.count("*").alias("df"))
    k1, b = text_functions.K1, text_functions.B
    times = F.coalesce(*[F.when((F.col("field") == name) & (F.col("term") == t), n) for (name, t), n in wanted.items()])
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    mean = F.when(F.col("mean") == 0, 1.0).otherwise(F.col("mean"))
    part = times * idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / mean))
    has = {k: F.max(F.when((F.col("field") == k[0]) & (F.col("term") == k[1]), 1).otherwise(0)) for k in wanted}
    # the index's terms of one query are few rows: their counts and the statistics are broadcast
    scored = hits.join(F.broadcast(df), ["field", "term"]).crossJoin(F.broadcast(statistics)).groupBy("key", "type").agg(F.sum(part).alias("score"), *[c.alias(f"has{i}") for i, c in enumerate(has.values())])
    at = {k: F.col(f"has{i}") == 1 for i, k in enumerate(has)}
    holds = [(role, reduce(lambda a, b: a & b, [at[name, t] for t in terms])) for role, name, terms in said]
    must = [c for role, c in holds if role == "must"]
    passed = reduce(lambda a, b: a & b, must) if must else reduce(lambda a, b: a | b, [c for role, c in holds if role == "should"])
    for role, c in holds:
        passed = passed & ~c if role == "not" else passed
    out = scored.where(passed & (F.lit(True) if kind is None else F.col("type") == kind))
    return out.select("key", "type", "score").orderBy(F.desc("score"), "type", "key").limit(limit)


def fetch(hits: DataFrame, hot: DataFrame, warm: DataFrame, key: str = "id") -> DataFrame:
    """The documents of search hits: the hot store's row, or the warm one's where that has none; hits that no store has are left out."""
    columns = [c for c in hot.columns if c in warm.columns]
    first = hits.join(hot.select(*columns), hits["key"] == hot[key])
    missing = hits.join(hot, hits["key"] == hot[key], "left_anti")
    return first.unionByName(missing.join(warm.select(*columns), missing["key"] == warm[key]))


def _unescaped(text: Column) -> Column:
    """The text with its escapes undone, each once: cut behind every escape, and each piece's one at its end replaced."""
    pieces = F.split(F.regexp_replace(text, r"(\\(?:u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.))", "$1\x00"), "\x00")

    def of(piece: Column) -> Column:
        code = F.regexp_extract(piece, r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)$", 1)
        number = F.conv(F.substring(code, F.lit(2), F.length(code) - 1), 16, 10).cast("int")
        high = F.lpad(F.hex(F.when(number < 0x110000, number)), 8, "0")
        char = F.when(F.length(code) > 1, F.decode(F.unhex(high), "UTF-32"))
        for said, meant in (("n", "\n"), ("t", "\t"), ("r", "\r"), ("b", "\b"), ("f", "\f")):
            char = F.when(code == said, F.lit(meant)).otherwise(char)
        return F.when(code == "", piece).otherwise(F.concat(F.substring(piece, F.lit(1), F.length(piece) - F.length(code) - 1), F.coalesce(char, code)))

    return F.array_join(F.transform(pieces, of), "")


def read_ntriples(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """subject, predicate, object, is_literal of each triple; IRIs without brackets, literals unescaped.

    A line that is no triple is an error, or, if not strict, left out; `rejected_ntriples` has those lines.
    """
    at = lambda k: F.regexp_extract("value", _TRIPLE, k)
    bare = lambda c: F.regexp_replace(c, r"^<|>$", "")
    raw = _triple_lines(spark, path)
    if not strict:
        raw = raw.where(F.col("value").rlike(_TRIPLE))
    is_literal = at(3).startswith('"')
    literal = _unescaped(F.regexp_extract(at(3), r'^"((?:[^"\\]|\\.)*)"', 1))
    subject = F.when(F.col("value").rlike(_TRIPLE), bare(at(1))).otherwise(F.raise_error(F.concat(F.lit("not a triple: "), F.col("value"))))
    return raw.select(subject.alias("subject"), bare(at(2)).alias("predicate"), F.when(is_literal, literal).otherwise(bare(at(3))).alias("object"), is_literal.alias("is_literal"))


def _triple_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).where((F.trim("value") != "") & ~F.trim("value").startswith("#"))


def rejected_ntriples(spark: SparkSession, path: str) -> DataFrame:
    """The lines that are no triple."""
    return _triple_lines(spark, path).where(~F.col("value").rlike(_TRIPLE))


#: Fixed: classes whose named nodes are nodes of the vendor graph, and the property that is their name.
RDF_LABELS = {"Person": "party", "Organization": "vendor"}
RDF_NAME = "name"


def mapped_nodes(triples: DataFrame, labels: dict[str, str] = RDF_LABELS, name: str = RDF_NAME) -> DataFrame:
    """label, key and name of the nodes of mapped classes; classes and properties go by the last part of their IRI."""
    last = lambda c: F.regexp_extract(c, r"([^/#]+)[/#]?$", 1)
    names = triples.where(F.col("is_literal") & (last(F.col("predicate")) == name)).groupBy("subject").agg(F.min("object").alias("name"))
    label = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])[last(F.col("type"))]
    found = nodes_by_type(triples).withColumn("label", label).where("label is not null").join(names, F.col("node") == F.col("subject"))
    return found.select("label", F.concat("label", F.lit(":"), F.replace(F.lower(F.trim("name")), F.lit(" "), F.lit("_"))).alias("key"), "name").distinct()


def nodes_by_type(triples: DataFrame) -> DataFrame:
    """(type, node) from rdf:type."""
    return triples.where(F.col("predicate") == TYPE).select(F.col("object").alias("type"), F.col("subject").alias("node")).distinct()


def edges_by_predicate(triples: DataFrame) -> DataFrame:
    """(predicate, source, target) between nodes."""
    return triples.where(~F.col("is_literal") & (F.col("predicate") != TYPE)).select("predicate", F.col("subject").alias("source"), F.col("object").alias("target")).distinct()


def rdf_statistics(triples: DataFrame) -> DataFrame:
    return triples.agg(F.count("*").alias("triples"), F.count_distinct("subject").alias("subjects"), F.count_distinct("predicate").alias("predicates"))


def write_training_log(df: DataFrame, path: str, least_confidence: float = 0.7) -> None:
    """JSON lines of the extractions sure enough and with entities."""
    df.where((F.col("confidence") >= least_confidence) & (F.size("entities") > 0)).write.mode("append").json(path)


def markdown(df: DataFrame) -> Column:
    """A row as a line of a Markdown table."""
    return F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]), F.lit(" |"))


def csv_line(df: DataFrame) -> Column:
    """A row as a line of CSV: fields with a comma, quote or newline are quoted, quotes doubled."""

    def field(c: str) -> Column:
        x = F.coalesce(F.col(c).cast("string"), F.lit(""))
        return F.when(x.rlike('[,"\n]'), F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(x)

    return F.concat_ws(",", *map(field, df.columns))


def kafka_source(spark: SparkSession, servers: str, topic: str, most: int = 10_000) -> DataFrame:
    """A stream of a topic: key, value, topic, partition, offset, timestamp, headers."""
    return spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("includeHeaders", "true").option("maxOffsetsPerTrigger", most).load()


def kafka_sink(df: DataFrame, servers: str, topic: str, checkpoint: str):
    """Writes key and value, acknowledged by all replicas."""
    return df.writeStream.format("kafka").option("kafka.bootstrap.servers", servers).option("kafka.acks", "all").option("topic", topic).option("checkpointLocation", checkpoint)


def append(df: DataFrame, path: str, by: Sequence[str] = ()) -> None:
    """Appends metric rows, in folders by the columns named."""
    df.write.mode("append").partitionBy(*by).parquet(path)


def append_jdbc(df: DataFrame, url: str, table: str, **options: str) -> None:
    df.write.mode("append").format("jdbc").options(url=url, dbtable=table, **options).save()
