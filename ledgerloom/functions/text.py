"""Terms, containment and BM25."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed: Okapi parameters and the separators of terms (Unicode white space and ASCII punctuation).
K1, B = 1.2, 0.75
SEPARATORS = r"[\p{IsWhite_Space}\p{Punct}]+"
_PUNCT = re.compile(r"""[\s!-/:-@\[-`{-~]+""")


def terms(text: Column) -> Column:
    """Lower-case terms of at least two bytes (as written)."""
    return F.transform(F.filter(F.split(text, SEPARATORS), lambda t: F.octet_length(t) >= 2), lambda t: F.lower(t))


def query_terms(query: str) -> list[str]:
    """The same for a query string."""
    return [t.lower() for t in _PUNCT.split(query) if len(t.encode()) >= 2]


#: One character that is in a term, and a term: two characters, or one that has two bytes.
_IN = r"[^\p{IsWhite_Space}\p{Punct}]"
_ONE = rf"(?:{_IN}{{2,}}|[^\p{{IsWhite_Space}}\p{{Punct}}\x00-\x7F])"


def term_count(text: Column) -> Column:
    """How many terms a text has."""
    return F.regexp_count(text, F.lit(_ONE))


def frequency(lowered: Column, term: str) -> Column:
    """How often a term is in a text that is in lower case; texts that don't hold its letters aren't searched."""
    said = re.escape(term)
    return F.when(F.contains(lowered, F.lit(term)), F.regexp_count(lowered, F.lit(rf"{said}(?!{_IN})(?<!{_IN}{said})"))).otherwise(0)


def contains(text: Column, query: str) -> Column:
    """Whether every term of the query is in the text; an empty query is in any."""
    out = F.lit(True)
    for t in sorted(set(query_terms(query))):
        out = out & (frequency(F.lower(text), t) > 0)
    return F.when(text.isNotNull(), out)


def with_bm25(df: DataFrame, text: Column, query: str, name: str, corpus: DataFrame | None = None) -> DataFrame:
    """df with the BM25 score of `query`; the corpus is the column in df, or the column `text` of `corpus`.

    Statistics are one row, one partial aggregate over the corpus; a term that the query repeats counts as often. Terms are
    counted where they stand, so no array of terms is made.
    """
    wanted = query_terms(query)
    distinct = sorted(set(wanted))
    if not distinct:
        return df.withColumn(name, F.lit(0.0))
    source, column = (df, text) if corpus is None else (corpus, F.col("text"))
    column = F.coalesce(column, F.lit(""))
    low = source.select(term_count(column).alias("size"), F.lower(column).alias("low"))
    stats = low.agg(F.count("*").alias("n"), F.sum("size").alias("total"), *[F.count_if(frequency(F.col("low"), t) > 0).alias(f"df{i}") for i, t in enumerate(distinct)])
    n = F.col("__s.n")
    idf = lambda i: F.when((n == 0) | (F.col(f"__s.df{i}") == 0), 0.0).otherwise(F.log((n - F.col(f"__s.df{i}") + 0.5) / (F.col(f"__s.df{i}") + 0.5) + 1))
    average = F.when((n == 0) | (F.col("__s.total") == 0), 1.0).otherwise(F.col("__s.total") / n)
    own = F.coalesce(text, F.lit(""))
    scored = df.withColumn("__size", term_count(own)).withColumn("__low", F.lower(own)).crossJoin(F.broadcast(stats.select(F.struct("*").alias("__s"))))  # one row
    length = F.col("__size") / average
    score = F.lit(0.0)
    for i, t in enumerate(distinct):
        tf = frequency(F.col("__low"), t)
        score = score + wanted.count(t) * idf(i) * (tf * (K1 + 1)) / (tf + K1 * (1 - B + B * length))
    return scored.withColumn(name, score).drop("__size", "__low", "__s")


def pair_score(left: Column, right: Column) -> Column:
    """The score of a pair: the mean of both sides' scores, or the one that there is."""
    return F.coalesce((left + right) / 2, left, right)


def fused(distance: Column | None, bm25: Column | None, vector_weight: float = 0.7, text_weight: float = 0.3) -> Column:
    """Weighted score of a vector distance and a BM25 score, or either alone."""
    v = None if distance is None else 1 - F.least(distance, F.lit(1.0))
    t = None if bm25 is None else F.least(bm25, F.lit(10.0)) / 10
    if v is not None and t is not None:
        return vector_weight * v + text_weight * t
    return v if v is not None else t if t is not None else F.lit(0.0)


def idf(n: int, df: int) -> float:
    return 0.0 if not n or not df else math.log((n - df + 0.5) / (df + 0.5) + 1)
