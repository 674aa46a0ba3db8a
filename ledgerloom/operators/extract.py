"""Text to records: invoices and contracts by patterns, in expressions; the line-by-line engine and span selection in pandas."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import fields

#: Fixed patterns of the labels, tried in order.
NUMBER = (r"(?i)invoice\s*(?:#|no\.?|number)\s*:?\s*([A-Z0-9][A-Z0-9-]*)", r"(?i)inv\s*[#:]\s*([A-Z0-9][A-Z0-9-]*)", r"\b(INV-[A-Z0-9-]+)", r"(?i)\bbill\s*(?:#|no\.?|number)\s*:?\s*([A-Z0-9][A-Z0-9-]*)", r"#\s*([0-9]{3,}[A-Z0-9-]*)")
DATE = r"\b(\d{4}-\d{1,2}-\d{1,2}|\d{1,2}[/.-]\d{1,2}[/.-]\d{2,4}|(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]* \d{1,2}, \d{4}|\d{1,2} (?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]* \d{4})\b"
AMOUNT = r"\$\s*([0-9][0-9,]*(?:\.[0-9]{1,2})?)"
VENDOR = r"(?im)^\s*(?:(?:from|vendor|seller|bill from|supplier|billed by)\s*:|billed\s+by\s)\s*(.+)$"
ORDER = r"(?i)(?:p\.?o\.?|purchase order)\s*(?:#|no\.?|number)?\s*:?\s*([A-Z0-9][A-Z0-9-]+)"
LINE = r"(?m)^\s*([^\n$]*[A-Za-z][^\n$]*?)\s+\$\s*([0-9][0-9,]*(?:\.[0-9]{1,2})?)\s*$"
#: A contract's number: behind these labels, tried in order, or one that says its kind.
_MARK = r"\s*(?:#|no\.?|number)\s*:?\s*([A-Z0-9][A-Z0-9/-]+)"
CONTRACT_NUMBER = (*(rf"(?i)\b{label}{_MARK}" for label in ("contract", "agreement", r"(?:p\.?o\.?|purchase\s+order)", r"ref(?:erence|\.)?")), r"\b((?:MSA|SOW|NDA)-[A-Z0-9-]+)")
#: A line in capitals that names its kind, and who the parties are where "between ... and ..." doesn't say.
CONTRACT_TITLE = r"(?m)^\s*([A-Z][A-Z ]{4,80}?(?:AGREEMENT|CONTRACT|ORDER|AMENDMENT|STATEMENT)[A-Z ]*)\s*$"
PARTY_LABELS = (r"client|buyer|customer", r"vendor|provider|contractor|seller|supplier", r"party\s*(?:a|1)", r"party\s*(?:b|2)")
UNKNOWN_PARTY = "Unknown"
CONTRACT_TYPES = (("MasterServiceAgreement", r"(?i)master\s+services?\s+agreement"), ("StatementOfWork", r"(?i)statement\s+of\s+work"), ("Amendment", r"(?i)\bamendment\b"), ("PurchaseOrder", r"(?i)purchase\s+order"), ("ServiceAgreement", r"(?i)services?\s+agreement"))
CLAUSES = (
    ("Payment", r"(?i)\bpayment"), ("Termination", r"(?i)\bterminat"), ("Confidentiality", r"(?i)\bconfidential"), ("Liability", r"(?i)\bliab"), ("Indemnification", r"(?i)\bindemni"),
    ("Warranty", r"(?i)\bwarrant"), ("GoverningLaw", r"(?i)\bgoverning\s+law"), ("ForceMajeure", r"(?i)\bforce\s+majeure"),
)


def _first(text: Column, pattern: str, group: int = 1) -> Column:
    found = F.regexp_extract(text, pattern, group)
    return F.when(found != "", F.trim(found))


def dates(text: Column) -> Column:
    """All dates in the text, in order."""
    return F.array_compact(F.transform(F.regexp_extract_all(text, F.lit(DATE)), fields.parse_date))


def amounts(text: Column) -> Column:
    """All dollar amounts in the text, in order."""
    return F.array_compact(F.transform(F.regexp_extract_all(text, F.lit(AMOUNT)), fields.parse_amount))


def invoice(df: DataFrame, text: str = "text", key: str = "id") -> DataFrame:
    """One invoice a text: the largest amount is total and subtotal, the first date its date; confidence 0.5."""
    t = F.coalesce(F.col(text), F.lit(""))
    total = F.array_max(amounts(t))
    item = lambda line: F.struct(F.trim(F.regexp_extract(line, LINE, 1)).alias("description"), F.lit(1).cast("decimal(18,4)").alias("quantity"), fields.parse_amount(F.regexp_extract(line, LINE, 2)).alias("total"))
    return df.select(
        key,
        F.coalesce(*[_first(t, p) for p in NUMBER], F.concat(F.lit("UNKNOWN-"), F.substring(F.sha2(t, 256), 1, 8))).alias("invoice_number"),
        F.try_element_at(dates(t), F.lit(1)).alias("invoice_date"),
        F.coalesce(_first(t, VENDOR), F.lit("Unknown Vendor")).alias("vendor_name"),
        _first(t, ORDER).alias("po_number"),
        F.coalesce(fields.detect_currency(t), F.lit("USD")).alias("currency"),
        F.transform(F.regexp_extract_all(t, F.lit(LINE), F.lit(0)), item).alias("line_items"),
        total.alias("subtotal"),
        total.alias("total_amount"),
        F.lit(0.5).alias("confidence_score"),
    )


def contract(df: DataFrame, text: str = "text", key: str = "id") -> DataFrame:
    """One contract a text; confidence 0.4."""
    t = F.coalesce(F.col(text), F.lit(""))
    kind = F.lit("Other")
    for name, pattern in reversed(CONTRACT_TYPES):
        kind = F.when(t.rlike(pattern), name).otherwise(kind)
    labelled = lambda word: F.try_element_at(dates(F.regexp_extract(t, rf"(?is){word}[^\n]*", 0)), F.lit(1))
    found = dates(t)
    value = F.coalesce(fields.parse_amount(_first(t, r"(?i)(?:total\s+|contract\s+)+value\s*:?\s*\$?\s*([0-9][0-9,]*(?:\.[0-9]{1,2})?)")), F.array_max(amounts(t)))
    value = F.coalesce(fields.parse_amount(_first(t, r"(?i)(?:not\s+to\s+exceed|maximum\s+(?:contract\s+)?(?:value|amount))\s*:?\s*\$?\s*([0-9][0-9,]*(?:\.[0-9]{1,2})?)")), value)
    between = F.array_compact(F.array(_first(t, r"(?i)between\s*:?\s+(.+?)\s+(?:and\s|\()"), _first(t, r"(?is)between\s*:?\s+.+?\sand\s+(.+?)(?:[.,(\n]|$)")))
    named = F.array_compact(F.array(*[_first(t, rf"(?im)^\s*(?:{label})\s*:\s*(.+)$") for label in PARTY_LABELS]))
    parties = F.when(F.size(between) > 0, between).when(F.size(named) > 0, named).otherwise(F.array(F.lit(UNKNOWN_PARTY)))
    parties = F.transform(parties, lambda x: F.btrim(x, F.lit(' "“”\t')))
    lines = F.filter(F.split(t, "\n"), lambda x: F.trim(x) != "")
    return df.select(
        key,
        F.coalesce(*[_first(t, p) for p in CONTRACT_NUMBER]).alias("contract_number"),
        F.coalesce(_first(t, CONTRACT_TITLE), F.trim(F.try_element_at(lines, F.lit(1)))).alias("title"),
        kind.alias("contract_type"),
        parties.alias("parties"),
        F.coalesce(labelled("effective"), F.try_element_at(found, F.lit(1))).alias("effective_date"),
        labelled("expir").alias("expiration_date"),
        labelled("execut|signed").alias("execution_date"),
        value.alias("total_value"),
        F.lit("USD").alias("currency"),
        F.array_compact(F.array(*[F.when(t.rlike(p), F.lit(n)) for n, p in CLAUSES])).alias("clause_types"),
        F.lit(0.4).alias("confidence_score"),
    )


_LABELS = {
    "invoice_number": r"invoice\s*(?:#|no\.?|number)", "invoice_date": r"(?:invoice\s+)?date", "due_date": r"due(?:\s+date)?|payment\s+due", "subtotal": r"sub\s*-?total", "tax_amount": r"(?:sales\s+)?tax|vat",
    "total_amount": r"(?:grand\s+|invoice\s+)?total(?:\s+due)?|amount\s+due|balance\s+due", "vendor_name": r"from|vendor|seller|sold\s+by", "bill_to": r"bill(?:ed)?\s+to|customer", "po_number": r"p\.?o\.?\s*(?:#|no\.?|number)?|purchase\s+order",
}


def label_values(text: str) -> dict[str, str]:
    """The first value of each label, behind it on its line or on the next line that has text."""
    lines = [x.strip() for x in text.splitlines()]
    out: dict[str, str] = {}
    for i, line in enumerate(lines):
        for name, label in _LABELS.items():
            if name in out or not (m := re.match(rf"(?:{label})\s*(?::|#|$|\s)\s*(.*)$", line, re.I)):
                continue
            value = m[1].lstrip(":# ").strip() or next((x for x in lines[i + 1 :] if x), "")
            if value:
                out[name] = value
                break
    return out


def line_rules(df: DataFrame, text: str = "text", key: str = "id") -> DataFrame:
    """label_values of each text, with dates and amounts parsed."""
    names = list(_LABELS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [label_values(t or "") for t in batch[text]]
            yield pd.DataFrame({key: batch[key], **{n: [f.get(n) for f in found] for n in names}})

    kind = dict(df.dtypes)[key]
    raw = df.select(key, text).mapInPandas(run, f"{key} {kind}, " + ", ".join(f"{n} string" for n in names))
    for n in ("invoice_date", "due_date"):
        raw = raw.withColumn(n, fields.parse_date(F.col(n)))
    for n in ("subtotal", "tax_amount", "total_amount"):
        raw = raw.withColumn(n, fields.parse_amount(F.col(n)))
    return raw


def choose_parser(text: Column, has_ner: bool, has_layout: bool) -> Column:
    """ner for long texts where there is a model, else layout, else regex."""
    out = F.lit("layout" if has_layout else "regex")
    return F.when(F.length(text) >= 100, "ner").otherwise(out) if has_ner else out


def escalates(overall: Column, completeness: Column, least: Column) -> Column:
    """Whether a medium model's result goes to the large one."""
    return (overall < 0.65) | (completeness < 0.6) | (least < 0.3)


def field_spans(df: DataFrame, text: str, names: list[str]) -> DataFrame:
    """(label, start, end) of each field's value in the text, where it is found."""
    spans = []
    for n in names:
        at = F.instr(F.lower(F.col(text)), F.lower(F.col(n).cast("string")))
        spans.append(F.when(at > 0, F.struct(F.lit(n).alias("label"), (at - 1).alias("start"), (at - 1 + F.length(F.col(n).cast("string"))).alias("end"))))
    return df.withColumn("spans", F.array_compact(F.array(*spans)))


def accepts(name: Column, head: Column, size: Column) -> Column:
    """Whether an upload is taken: not empty, and a PDF by name or magic."""
    return (size > 0) & (F.lower(name).endswith(".pdf") | head.startswith("%PDF"))


def confidence(df: DataFrame, expected: int) -> DataFrame:
    """Entities (doc_id, label, score) to each document's mean, minimum, completeness, low count and overall score."""
    best = df.groupBy("doc_id", "label").agg(F.max("score").alias("best"))
    out = best.groupBy("doc_id").agg(F.avg("best").alias("mean"), F.min("best").alias("least"), (F.count("*") / F.lit(expected)).alias("completeness"), F.count_if(F.col("best") < 0.5).alias("n_low"))
    return out.withColumn("overall", 0.5 * F.col("mean") + 0.2 * F.col("least") + 0.3 * F.least(F.col("completeness"), F.lit(1.0)))


def best_spans(df: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Spans (doc_id, label, start, end, score): of those of a label that overlap by `threshold` and more the best stays, greedily."""

    def keep(group: pd.DataFrame) -> pd.DataFrame:
        chosen: list[tuple[int, int]] = []
        rows = []
        for i, r in group.sort_values(["score", "start", "end"], ascending=[False, True, True], kind="stable").iterrows():
            over = [max(0, min(r["end"], e) - max(r["start"], s)) / max(1, max(r["end"], e) - min(r["start"], s)) for s, e in chosen]
            if all(x < threshold for x in over):
                chosen.append((r["start"], r["end"]))
                rows.append(i)
        return group.loc[sorted(rows)]

    return df.select("doc_id", "label", "start", "end", "score").groupBy("doc_id", "label").applyInPandas(keep, df.select("doc_id", "label", "start", "end", "score").schema)


def words(text: Column) -> Column:
    """The words of a text (runs of anything but white space) with their place in characters."""
    pieces = F.regexp_extract_all(text, F.lit(r"\s*\S+"), F.lit(0))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<text:string,start:int,end:int>>").alias("out"))

    def add(state: Column, piece: Column) -> Column:
        end, word = state["at"] + F.length(piece), F.regexp_extract(piece, r"\S+", 0)
        one = F.struct(word.alias("text"), (end - F.length(word)).alias("start"), end.alias("end"))
        return F.struct(end.alias("at"), F.array_append(state["out"], one).alias("out"))

    return F.aggregate(pieces, start, add)["out"]


def candidate_spans(n: Column, width: int) -> Column:
    """(start, end) of all runs of at most `width` of n words, by start and length; the end is not in the run."""
    ends = lambda s: F.sequence(s + 1, F.least(s + width, n))
    return F.when(n > 0, F.flatten(F.transform(F.sequence(F.lit(0), n - 1), lambda s: F.transform(ends(s), lambda e: F.struct(s.alias("start"), e.alias("end"))))))


def decode_entities(df: DataFrame, labels: list[str], threshold: float = 0.5, width: int = 12, overlap: float = 0.3) -> DataFrame:
    """A recogniser's output (doc_id, text, logits) to entities: doc_id, label, score, start and end in words, and value with its place.

    logits: for each candidate span, in order, one number a label. Spans of a score of `threshold` and more are candidates.
    """
    split = df.select("doc_id", "text", "logits", words(F.col("text")).alias("words"))
    each = split.select("doc_id", "text", "words", "logits", F.posexplode(candidate_spans(F.size("words"), width)).alias("k", "span"))
    scored = F.array(*[F.struct(F.lit(name).alias("label"), fields.sigmoid(F.get("logits", F.col("k") * len(labels) + j)).alias("score")) for j, name in enumerate(labels)])
    found = each.select("doc_id", "text", "words", "span.start", "span.end", F.inline(scored)).where(F.col("score") >= threshold)
    first, last = F.get("words", F.col("start"))["start"], F.get("words", F.col("end") - 1)["end"]
    placed = found.select("doc_id", "label", "start", "end", "score", first.alias("char_start"), last.alias("char_end"), F.substring("text", first + 1, last - first).alias("value"))
    return best_spans(placed, overlap).join(placed, ["doc_id", "label", "start", "end", "score"])


def best_entities(entities: DataFrame) -> DataFrame:
    """Of each document and label the entity of the best score; of equal ones the last."""
    rest = [c for c in entities.columns if c not in ("doc_id", "label")]
    best = entities.groupBy("doc_id", "label").agg(F.max_by(F.struct(*rest), F.struct("score", "start", "end")).alias("best"))
    return best.select("doc_id", "label", "best.*")
