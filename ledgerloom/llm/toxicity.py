"""Toxicity: a counterfactual-regularised linear classifier over words and word beginnings.

A text's features are the terms in it (runs of letters and digits, in lower case) and their first 4, 5 and 6 bytes, each
once, whatever the text's length. Training learns a logistic model on at most `max_rows` labelled rows, taken by a hash
of doc_id; that bound is the only one, and scoring covers every row and whole texts. The penalty: in each training text
with terms of the identity lexicon these are swapped for others of it, and squared changes of the log-odds cost
`fairness`, so that neutral mentions of a group don't move a score.

Documents are read twice: for the training rows, which a checkpoint holds, and for the scores. Of the training rows feature
counts by label are summed in Spark before the `max_features` strongest reach the driver, then each row's chosen features,
as packed numbers. The model is at most `max_features` weights and goes out with the tasks.

Defined results: null and empty texts get the score of a text without features; labels that are null or have no
document are ignored, repeated labels of a document count as rows; without both labels the score is 0.5 for all; repeated
rows each get their score; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm._shared import cut
from ledgerloom.llm._text import NO_TERM, U, blocks, lowered, mix, raw, rows_of, run_hashes, spans

#: Fixed lexicon of identity terms.
IDENTITY_TERMS = (
    "women men woman man girls boys muslim muslims christian christians jew jews jewish hindu hindus buddhist atheist black white asian african american "
    "european arab latino hispanic immigrant immigrants refugee refugees gay lesbian bisexual trans transgender queer straight disabled blind deaf old young "
    "frauen männer juden muslime christen schwarze weiße ausländer femmes hommes juifs musulmans chrétiens noirs blancs étrangers mujeres hombres judíos "
    "musulmanes cristianos negros blancos extranjeros"
).split()
PREFIXES = (4, 5, 6)


@dataclass(frozen=True)
class Training:
    max_rows: int = 20_000
    max_features: int = 4096
    min_rows: int = 3
    #: How many rows a toxic one counts as, at most: they are the rarer.
    toxic_weight: float = 6.0
    fairness: float = 4.0
    ridge: float = 1e-4
    steps: int = 400


@dataclass(frozen=True)
class Model:
    """Weights of the features in `keys`, which are in order; score = sigmoid(bias + sum of the weights found)."""

    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, U))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = 0.0


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and key of each feature occurrence, and the hash of the whole term that it comes from."""
    data, offsets = raw(lowered(column))
    starts, ends, first = spans(data, offsets, NO_TERM)
    rows, whole = rows_of(first), run_hashes(data, starts, ends)
    at, keys, terms = [rows], [whole], [whole]
    for n in PREFIXES:
        long = ends - starts > n
        at.append(rows[long])
        terms.append(whole[long])
        keys.append(mix(run_hashes(data, starts[long], starts[long] + n) ^ U(n)))
    return np.concatenate(at), np.concatenate(keys), np.concatenate(terms)


def _lexicon() -> np.ndarray:
    data, offsets = raw(pa.array(IDENTITY_TERMS))
    return run_hashes(data, *spans(data, offsets, NO_TERM)[:2])


def _swapped(term: str, salt: int) -> str:
    """The identity term that stands in for `term`: another one, fixed by the salt."""
    k = IDENTITY_TERMS.index(term)
    return IDENTITY_TERMS[(k + 1 + salt % (len(IDENTITY_TERMS) - 1)) % len(IDENTITY_TERMS)]


def counterfactual(text: str, salt: int) -> str | None:
    """The text with each identity term swapped for another; None if it has none."""
    import re

    known, found = set(IDENTITY_TERMS), False

    def swap(m: re.Match) -> str:
        nonlocal found
        if (low := m[0].lower()) not in known:
            return m[0]
        found = True
        return _swapped(low, salt)

    out = re.sub(r"\w+", swap, text)
    return out if found else None


def _unique(rows: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each (row, key) once, by row."""
    order = np.lexsort((keys, rows))
    rows, keys = rows[order], keys[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (keys[1:] != keys[:-1])
    return rows[new], keys[new]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by label of each feature of a block; Spark sums them."""
    for batch in batches:
        for block in blocks(batch):
            label = np.asarray(block.column("label"))
            rows, keys = _unique(*features(block.column("text"))[:2])
            found, at = np.unique(keys, return_inverse=True)
            n = [np.bincount(at, label[rows] == value, len(found)).astype(np.int64) for value in (0, 1)]
            yield pa.record_batch({"key": found.view(np.int64), "n0": n[0], "n1": n[1]})


def _chosen(keys: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Index in the sorted table of each key, -1 where it isn't there."""
    if not len(table):
        return np.full(len(keys), -1)
    at = np.searchsorted(table, keys)
    at[at == len(table)] = 0
    return np.where(table[at] == keys, at, -1)


def _gather(table: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch):
                texts = block.column("text").to_pylist()
                swapped = [counterfactual(t or "", i) for i, t in zip(block.column("salt").to_pylist(), texts, strict=True)]
                out = []
                for column in (block.column("text"), pa.array([s or "" for s in swapped], pa.string())):
                    rows, keys = _unique(*features(column)[:2])
                    at = _chosen(keys, table)
                    rows, at = rows[at >= 0], at[at >= 0]
                    out.append([x.tobytes() for x in np.split(at.astype(np.int32), np.searchsorted(rows, np.arange(1, len(texts))))])
                other = [x if s is not None else None for x, s in zip(out[1], swapped, strict=True)]
                yield pa.record_batch({"label": block.column("label"), "own": pa.array(out[0], pa.binary()), "swapped": pa.array(other, pa.binary())})

    return run


def fit(own: list, swapped: list, labels: np.ndarray, n: int, training: Training) -> tuple[np.ndarray, float]:
    """Weights and bias by accelerated gradient descent on the log loss, the ridge and the counterfactual penalty."""
    size = lambda rows: np.repeat(np.arange(len(rows)), [len(x) for x in rows])
    at, key = size(own), np.concatenate([np.asarray(x, np.int64) for x in own] or [np.zeros(0, np.int64)])
    pairs = [(np.setdiff1d(a, b), np.setdiff1d(b, a)) for a, b in zip(own, swapped, strict=True) if b is not None]
    gone, came = [p[0] for p in pairs], [p[1] for p in pairs]
    c_at = np.concatenate([size(gone), size(came)]).astype(np.int64)
    c_key = np.concatenate([*map(np.asarray, gone), *map(np.asarray, came), np.zeros(0)]).astype(np.int64)
    c_sign = np.repeat([1.0, -1.0], [sum(map(len, gone)), sum(map(len, came))])
    toxic = labels.sum()
    cost = np.where(labels > 0, min(training.toxic_weight, (len(labels) - toxic) / max(1.0, toxic)), 1.0)
    m, w, b = cost.sum(), np.zeros(n), 0.0
    vw, vb = np.zeros(n), 0.0
    rate = 1.0
    s_w, s_b = np.full(n, 1e-8), 1e-8
    for step in range(training.steps):
        z = np.bincount(at, w[key], len(labels)) + b
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        error = cost * (p - labels) / m
        g = np.bincount(key, error[at], n) + training.ridge * w
        if len(pairs):
            change = np.bincount(c_at, c_sign * w[c_key], len(pairs))
            g += training.fairness / m * np.bincount(c_key, c_sign * change[c_at], n)
        vw, vb = 0.9 * vw + 0.1 * g, 0.9 * vb + 0.1 * error.sum()
        s_w, s_b = 0.99 * s_w + 0.01 * g * g, 0.99 * s_b + 0.01 * error.sum() ** 2
        lr = rate * 0.3 / (1 + step / 100)
        w, b = w - lr * vw / (np.sqrt(s_w) + 1e-9) * 0.5, b - lr * vb / (np.sqrt(s_b) + 1e-9) * 0.5
    return w, float(b)


def train(documents: DataFrame, labels: DataFrame, usable: Column, training: Training = Training()) -> Model:
    """documents: doc_id, text; labels: doc_id, toxic; usable: which rows of labels may be learned from."""
    rows = labels.where(usable & F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col("toxic").cast("int").alias("label"), F.xxhash64("doc_id").alias("salt"))
    rows = rows.orderBy("salt", "doc_id", "label").limit(training.max_rows)
    texts = cut(F.broadcast(rows).join(documents.select("doc_id", "text"), "doc_id").select("label", F.abs("salt").alias("salt"), "text"))  # max_rows rows at most
    counts = texts.mapInArrow(_count, "key long, n0 long, n1 long").groupBy("key").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    total = texts.groupBy("label").count().collect()
    n = {r["label"]: r["count"] for r in total}
    if not n.get(0) or not n.get(1):
        return Model()
    odds = F.log((F.col("n1") + 0.5) / (n[1] + 1.0)) - F.log((F.col("n0") + 0.5) / (n[0] + 1.0))
    # the signed strength of the association: log-odds by the root of its rows
    best = counts.where(F.col("n0") + F.col("n1") >= training.min_rows).select("key", (F.abs(odds) * F.sqrt(F.col("n0") * (n[1] / n[0]) + F.col("n1"))).alias("strength"))
    keys = [r["key"] for r in best.orderBy(F.desc("strength"), "key").limit(training.max_features).collect()]
    lexicon = np.setdiff1d(_lexicon(), np.zeros(0, U))
    table = np.unique(np.concatenate([np.array(keys, np.int64).view(U), lexicon]))
    got = texts.mapInArrow(_gather(table), "label int, own binary, swapped binary").collect()  # max_rows rows at most
    numbers = lambda k: [None if r[k] is None else np.frombuffer(r[k], np.int32) for r in got]
    weights, bias = fit(numbers("own"), numbers("swapped"), np.array([r["label"] for r in got], float), len(table), training)
    return Model(table, weights, bias)


def scores(model: Model, column: pa.Array) -> np.ndarray:
    rows, keys, _ = features(column)
    seen = np.zeros(1 << 20, bool)
    seen[(model.keys & U((1 << 20) - 1)).astype(np.int64)] = True
    maybe = seen[(keys & U((1 << 20) - 1)).astype(np.int64)]
    rows, keys = _unique(rows[maybe], keys[maybe])
    at = _chosen(keys, model.keys)
    known = at >= 0
    z = np.bincount(rows[known], model.weights[at[known]], len(column)) + model.bias
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def score_documents(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of each row."""
    import pyspark.sql.types as T

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch):
                yield pa.record_batch({"doc_id": block.column("doc_id"), "score": scores(model, block.column("text"))})

    return documents.select("doc_id", "text").mapInArrow(run, T.StructType([documents.schema["doc_id"], T.StructField("score", T.DoubleType())]))
