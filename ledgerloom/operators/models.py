"""Where models plug in: encoders and extractors are given as functions over batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Encoder = Callable[[Sequence[str]], Sequence[Sequence[float]]]


def embed(df: DataFrame, text: str, encoder: Encoder, dimension: int, name: str = "embedding") -> DataFrame:
    """df with the encoder's vectors, of length 1; null and blank texts, and all texts without an encoder, get zeros."""
    zero = [0.0] * dimension

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            full = [t for t in batch if t and t.strip()]
            made = iter(encoder(full) if full and encoder else [])
            yield pd.Series([_unit(next(made, zero)) if t and t.strip() else zero for t in batch])

    return df.withColumn(name, F.pandas_udf(run, "array<float>")(F.col(text)))


def _unit(v: Sequence[float]) -> list[float]:
    n = sum(x * x for x in v) ** 0.5
    return [float(x) / n for x in v] if n else [float(x) for x in v]


def sections(text: Column) -> Column:
    """Paragraphs of a text: what is embedded beside the whole."""
    return F.filter(F.transform(F.split(text, r"\n\s*\n"), lambda x: F.trim(x)), lambda x: x != "")


def embed_documents(df: DataFrame, key: str, text: str, encoder: Encoder, dimension: int) -> DataFrame:
    """(key, kind, position, embedding) of each document and its sections."""
    whole = df.select(key, F.lit("document").alias("kind"), F.lit(0).alias("position"), F.col(text).alias("part"))
    parts = df.select(key, F.lit("section").alias("kind"), F.posexplode(sections(F.col(text))).alias("position", "part"))
    return embed(whole.union(parts), "part", encoder, dimension).drop("part")


def similar(df: DataFrame, query: Sequence[float], k: int, key: str = "id") -> DataFrame:
    """The k rows of the greatest cosine similarity."""
    from ledgerloom.functions import vector

    return df.withColumn("similarity", vector.cosine_similarity(F.col("embedding"), vector.literal(list(query)))).orderBy(F.desc_nulls_last("similarity"), key).limit(k)


def read_files(spark: SparkSession, path: str, pattern: str, extract: Callable[[bytes], str]) -> DataFrame:
    """(path, size, text) of binary files such as PDFs, by a function that turns bytes to text."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(extract)

    return files.select("path", F.col("length").alias("size"), F.pandas_udf(run, "string")("content").alias("text"))
