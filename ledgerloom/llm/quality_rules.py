"""Quality rules: text statistics and cross-document line frequency, in DataFrame functions only.

Method: normalised lines are hashed; for each host (column `source`) the distinct texts that hold a line are counted, so
exact copies count once; a line in more than `max_docs` of them is boilerplate and is removed everywhere but in the
document with the smallest doc_id that holds it. A document of whose words less than `min_kept` stay is depleted and
rejected. In the corpus that `apply_quality_rules` gives, the smallest kept document carries a line, so no line that a
kept document holds vanishes; the verdicts alone (as in the SQL) name the smallest document, kept or not.

Hot lines and hosts: counting is partially aggregated before each shuffle; the join back has one row a line on its right
side, so AQE splits a skewed left side. Texts are read once: their figures and line hashes go to a checkpoint, and only
those are shuffled.

Defined results: null text has no words and no lines, fails the base rules and is rejected; a null source is a host of
its own; a null doc_id is a document like others and never the carrier of a line where another has it; repeated rows
(same doc_id and text) each get their row, with the figures of one (the SQL, which isn't held to them, sums their words); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm._shared import BLANKS, cut, let

#: Fixed values of the base rules.
SYMBOLS, WINDOW, MIN_WORDS, MAX_REPEAT_PERCENT = "#*$%&|<>", 8, 20, 30


@dataclass(frozen=True)
class LineLimits:
    """max_docs: distinct texts of a host that may hold a line; min_kept: fraction of words that must stay."""

    max_docs: int = 20
    min_kept: float = 0.2


def words_of(text: Column) -> Column:
    """Maximal runs of characters other than BLANKS; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[ \t\n\x0B\f\r]+"), "")


def _pair(hashes: Column, step: int) -> Column:
    """Hash of each element with the one `step` on: twice the span."""
    return F.zip_with(hashes, F.slice(hashes, step + 1, F.greatest(F.size(hashes) - step, F.lit(0))), lambda a, b: F.xxhash64(a, b))


def repeated_words(words: Column) -> Column:
    """Words in 8-word windows that occur at least twice in the text, counting every occurrence's words once."""
    single = F.transform(words, lambda w: F.xxhash64(w))
    spans = let(single, lambda a: let(_pair(a, 1), lambda b: let(_pair(b, 2), lambda c: F.slice(_pair(c, 4), 1, F.greatest(F.size(a) - (WINDOW - 1), F.lit(0))))))

    def covered(windows: Column) -> Column:
        ordered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        starts = let(ordered, lambda s: F.sort_array(F.transform(F.filter(s, lambda x, k: F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False))), lambda x: x["i"])))
        steps = let(starts, lambda s: F.transform(s, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(s, k + 1) - x, F.lit(WINDOW)))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    return let(spans, lambda s: F.when(F.size(F.array_distinct(s)) < F.size(s), covered(s)).otherwise(F.lit(0).cast("long")))


def _lines(text: Column) -> Column:
    """Lines with a word, as written."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.length(F.btrim(x, F.lit(BLANKS))) > 0)


def line_hash(line: Column) -> Column:
    """Hash of the normalised line: its words in lower case."""
    return F.xxhash64(words_of(F.lower(line)))


def _line_facts(lines: Column) -> Column:
    """For each line its hash and number of words."""
    return F.transform(lines, lambda x: let(words_of(F.lower(x)), lambda w: F.struct(F.xxhash64(w).alias("line"), F.size(w).cast("long").alias("words"))))


def document_facts(docs: DataFrame) -> DataFrame:
    """One pass over the texts: doc_id, text_hash, host, the base figures and a (line, words) pair for each line."""
    text = F.coalesce(F.col("text"), F.lit(""))
    n = F.col("n_words")
    split = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.col("source").alias("host"), words_of(F.col("text")).alias("words"), _lines(F.col("text")).alias("each"), text.alias("text"))
    figures = split.select(
        "doc_id", "text_hash", "host",
        F.size("words").cast("long").alias("n_words"),
        F.aggregate("words", F.lit(0).cast("long"), lambda a, w: a + F.length(w)).alias("word_chars"),
        F.regexp_count("text", F.lit("[" + SYMBOLS + "]")).cast("long").alias("n_symbols"),
        (F.size("each") - F.size(F.array_distinct("each"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
        _line_facts(F.col("each")).alias("lines"),
    )
    return figures.withColumn("base_failed", (n < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * n))


def _carried(held: DataFrame, by: Column) -> DataFrame:
    """held with the carrier of each line: the smallest doc_id of the documents that `by` names."""
    carriers = held.groupBy("host", "line").agg(F.min(F.when(by, F.col("doc_id"))).alias("carrier")).select(F.col("host").alias("of_host"), F.col("line").alias("of_line"), "carrier")
    return held.join(carriers, F.col("host").eqNullSafe(F.col("of_host")) & (F.col("line") == F.col("of_line"))).drop("of_host", "of_line")


def _by_kept(held: DataFrame, limits: LineLimits) -> DataFrame:
    """held with carriers that are kept: first among those that pass the base rules, then among those of these that aren't depleted.

    A document that carries more lines loses fewer words, so those kept at first are kept in the end.
    """
    held = cut(held)
    own = ["doc_id", "text_hash", "n_words", "base_failed"]
    gone = F.max(F.when(F.col("doc_id").eqNullSafe(F.col("carrier")), 0).otherwise(F.col("words")))
    each = _carried(held, ~F.col("base_failed")).groupBy(*own, "at").agg(gone.alias("gone")).groupBy(*own).agg(F.sum("gone").alias("gone"))
    stays = each.select(F.col("doc_id").alias("of_id"), F.col("text_hash").alias("of_hash"), (~F.col("base_failed") & (F.col("n_words") - F.col("gone") >= F.lit(limits.min_kept) * F.col("n_words"))).alias("stays"))
    judged = held.join(stays, F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("text_hash") == F.col("of_hash"))).drop("of_id", "of_hash")
    return _carried(judged, F.col("stays"))


def removed_lines(facts: DataFrame, limits: LineLimits, by_kept: bool = False) -> DataFrame:
    """doc_id, text_hash, words removed and the hashes of the lines removed, for documents that lose any."""
    lines = facts.select("doc_id", "text_hash", "host", "n_words", "base_failed", F.posexplode("lines").alias("at", "x")).select("doc_id", "text_hash", "host", "n_words", "base_failed", "at", "x.line", "x.words")
    texts = lines.groupBy("host", "line", "text_hash").agg(F.min("doc_id").alias("carrier"))
    often = texts.groupBy("host", "line").agg(F.count("*").alias("n_docs"), F.min("carrier").alias("carrier")).where(F.col("n_docs") > limits.max_docs)
    often = often.select(F.col("host").alias("often_host"), F.col("line").alias("often_line"), "carrier")
    held = lines.join(often, F.col("host").eqNullSafe(F.col("often_host")) & (F.col("line") == F.col("often_line"))).drop("often_host", "often_line")
    if by_kept:
        held = _by_kept(held.drop("carrier"), limits)
    # repeated rows lose the same lines, counted once
    hit = held.where(~F.col("doc_id").eqNullSafe(F.col("carrier"))).groupBy("doc_id", "text_hash", "at", "line", "words").agg(F.lit(1))
    return hit.groupBy("doc_id", "text_hash").agg(F.sum("words").alias("n_removed_words"), F.collect_set("line").alias("lines"))


def quality_verdicts(docs: DataFrame, limits: LineLimits = LineLimits(), by_kept: bool = False) -> DataFrame:
    """For each row: the base figures, n_removed_words, removed_lines and kept; with by_kept, lines are carried by kept documents only."""
    facts = cut(document_facts(docs))
    lost = removed_lines(facts, limits, by_kept).select(F.col("doc_id").alias("lost_id"), F.col("text_hash").alias("lost_hash"), F.col("n_removed_words"), F.col("lines").alias("removed_lines"))
    base = facts.drop("lines", "host")
    joined = base.join(lost, F.col("doc_id").eqNullSafe(F.col("lost_id")) & (F.col("text_hash") == F.col("lost_hash")), "left")
    n_removed = F.coalesce("n_removed_words", F.lit(0))
    depleted = (F.col("n_words") - n_removed) < F.lit(limits.min_kept) * F.col("n_words")
    return joined.select(
        *base.columns, n_removed.alias("n_removed_words"), F.coalesce("removed_lines", F.array().cast("array<long>")).alias("removed_lines"), (~F.col("base_failed") & ~depleted).alias("kept")
    )


def apply_quality_rules(docs: DataFrame, limits: LineLimits = LineLimits()) -> DataFrame:
    """The kept documents in their own columns, without their removed lines; n_chars follows where it is a column."""
    verdict = quality_verdicts(docs, limits, by_kept=True).where("kept").groupBy("doc_id", "text_hash").agg(F.first("removed_lines").alias("lines"))
    verdict = verdict.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), F.col("lines").alias("__lines"))
    joined = docs.join(verdict, docs["doc_id"].eqNullSafe(F.col("__id")) & (F.xxhash64(docs["text"]) == F.col("__hash")))
    cleaned = F.array_join(F.filter(F.split("text", "\n"), lambda x: ~F.array_contains(F.col("__lines"), line_hash(x))), "\n")
    text = F.when(F.size("__lines") > 0, cleaned).otherwise(F.col("text"))
    out = joined.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
