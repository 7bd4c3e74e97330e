"""Quality classifier: supervised subword embeddings.

A document is the mean of the learned vectors of its hashed features: words, pairs of words, and runs of three and
four bytes of its UTF-8 text, in the case they are written. A pair of words that the document has had before, and a
word that follows itself, are features of their own. A softmax over the mean gives the classes; vectors and output
are trained by stochastic gradient descent in numpy.

Training uses a bounded sample of labelled rows: ``per_class`` of each class, those with the smallest hash of their
id, whole texts. Scoring reads every document once, without a shuffle: for two classes the score of a mean of
vectors is the mean of one number for each feature, so tasks get one array of ``BUCKETS`` numbers.

Defined results: a null or empty text has no feature and gets the score of the output's bias; rows with equal texts
get equal scores; repeated labels count once, a label that is neither 0 nor 1 not at all; without any label of the
fit folds every score is 0.5; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rackpulse.llm import textbytes
from rackpulse.llm.tables import table, text_of

BUCKETS = 1 << 18
#: The last buckets are not hashed into: a repeated pair of words, a word that follows itself.
AGAIN, SELF = BUCKETS - 1, BUCKETS - 2
BYTE_RUNS = (3, 4)


@dataclass(frozen=True)
class Settings:
    """Size of the sample, the vectors and the descent."""

    per_class: int = 2000
    dimensions: int = 8
    steps: int = 8_000
    rate: float = 0.5
    vector_rate: float = 50.0
    seed: int = 7


def _bucket(hashes: np.ndarray, salt: int) -> np.ndarray:
    return (textbytes.mixed(hashes ^ np.uint64(salt)) % np.uint64(BUCKETS - 2)).astype(np.int64)


def features(data: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Groups of features of a run of texts: bucket of each, and where each row's begin and end."""
    begin, end, before = textbytes.words(data, at)
    word = textbytes.hashes(data, begin, end)
    yield _bucket(word, 1), before[:-1], before[1:]
    pair = textbytes.runs(word, 2)
    first, last = before[:-1], np.maximum(before[1:] - 1, before[:-1])
    yield _bucket(pair, 2), first, last
    row = np.repeat(np.arange(len(at) - 1), np.diff(before))[: len(pair)]
    inside = np.arange(len(pair)) < last[row]
    order = np.lexsort((pair, row))
    again = np.zeros(len(pair), bool)
    again[order[1:]] = (pair[order[1:]] == pair[order[:-1]]) & (row[order[1:]] == row[order[:-1]])
    same = word[1:] == word[:-1] if len(word) else np.zeros(0, bool)
    for flags, bucket in ((again & inside, AGAIN), (same & inside, SELF)):
        total = np.concatenate([[0], np.cumsum(flags)])
        yield np.full(int(total[-1]), bucket), total[first], total[last]
    for size in BYTE_RUNS:
        count = max(0, len(data) - size + 1)
        code = np.zeros(count, np.uint32)
        for i in range(size):
            code = code << np.uint32(8) | data[i : i + count]
        code = code * np.uint32(0x9E3779B1)
        code = (code ^ (code >> np.uint32(15))) * np.uint32(0x85EBCA77) >> np.uint32(14)  # 18 bits
        yield np.minimum(code, SELF - 1), at[:-1], np.maximum(at[1:] - size + 1, at[:-1])


def _row_sums(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Sum of the values of each row; a row's sum does not depend on its neighbours."""
    out = np.zeros(len(first))
    full = np.flatnonzero(last > first)
    if len(full):
        edges = np.stack([first[full], last[full]], 1).ravel()
        out[full] = np.add.reduceat(np.append(values, 0.0), edges)[::2]
    return out


@dataclass
class Model:
    """One number for each feature, and the bias, of class 1 over class 0."""

    weights: np.ndarray
    bias: float

    def scores(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        total, count = np.zeros(len(at) - 1), np.zeros(len(at) - 1)
        for bucket, first, last in features(data, at):
            total += _row_sums(self.weights[bucket], first, last)
            count += last - first
        return np.round(1 / (1 + np.exp(-(total / np.maximum(count, 1) + self.bias))), 9)


def fit(rows: list[tuple[int, np.ndarray, np.ndarray]], settings: Settings = Settings()) -> Model:
    """Train on (class, buckets, counts) rows."""
    random = np.random.default_rng(settings.seed)
    size = settings.dimensions
    vectors = random.uniform(-1 / size, 1 / size, (BUCKETS, size)).astype(np.float32)
    output, bias = np.zeros((size, 2), np.float32), np.zeros(2, np.float32)
    by_class = [c for c in ([i for i, r in enumerate(rows) if r[0] == y] for y in (0, 1)) if c]
    for step in range(settings.steps):  # classes take turns, whatever their sizes
        mine = by_class[step % len(by_class)]
        label, bucket, count = rows[mine[random.integers(len(mine))]]
        left = 1 - step / settings.steps
        share = (count / max(count.sum(), 1)).astype(np.float32)
        mean = share @ vectors[bucket]
        logits = mean @ output + bias
        wrong = np.exp(logits - logits.max())
        wrong /= wrong.sum()
        wrong[label] -= 1
        back = output @ wrong
        output -= settings.rate * left * np.outer(mean, wrong)
        bias -= settings.rate * left * wrong
        # A vector's part in the mean is small, so vectors move at a rate of their own.
        vectors[bucket] -= settings.vector_rate * left * share[:, None] * back
    return Model((vectors @ (output[:, 1] - output[:, 0])).astype(np.float64), float(bias[1] - bias[0]))


def fold(key: Column) -> Column:
    """0, 1 or 2 by the checksum of the id's text."""
    return F.crc32(key.cast("string").cast("binary")) % 3


def sampled(docs: DataFrame, labels: DataFrame, label: str, settings: Settings) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Class and counted features of the bounded sample of labelled rows outside fold 1."""
    usable = labels.select("doc_id", F.col(label).cast("int").alias("y")).filter(F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 1))
    chosen = [
        usable.filter(F.col("y") == y).distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(settings.per_class) for y in (0, 1)
    ]
    ids = F.broadcast(chosen[0].unionByName(chosen[1]))  # at most two times per_class rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end, data, at in textbytes.chunks(batch.column(1)):
                groups = list(features(data, at))
                counted = [
                    np.unique(np.concatenate([bucket[a[r] : b[r]] for bucket, a, b in groups]).astype(np.uint32), return_counts=True) for r in range(end - begin)
                ]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(begin, end - begin), *(pa.array([x[k].astype("<u4").tobytes() for x in counted], pa.binary()) for k in (0, 1))],
                    names=["y", "buckets", "counts"],
                )

    # One row of each id, the one of the least text hash, however many rows an id has.
    texts = docs.select("doc_id", text_of().alias("text")).join(ids, "doc_id").withColumn("h", F.xxhash64("text"))
    texts = texts.groupBy("doc_id", "y").agg(F.min(F.struct("h", "text")).alias("least")).select("y", F.col("least")["text"].alias("text"))
    rows = texts.mapInArrow(run, "y int, buckets binary, counts binary")
    found = sorted((r["y"], bytes(r["buckets"]), bytes(r["counts"])) for r in rows.collect())  # in an order of their own
    return [(y, np.frombuffer(a, "<u4"), np.frombuffer(b, "<u4")) for y, a, b in found]


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id`` and ``score`` of every document."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # one array of BUCKETS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end, data, at in textbytes.chunks(batch.column(1)):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(begin, end - begin), pa.array(sent.value.scores(data, at))], names=["doc_id", "score"]
                )

    return docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(run, "doc_id long, score double")


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", settings: Settings = Settings()) -> Model:
    rows = sampled(docs, labels, label, settings)
    return fit(rows, settings) if rows else Model(np.zeros(BUCKETS), 0.0)


def query(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    out = scored(docs, train(docs, table(spark, folder, "labels")))
    return out.select(
        "doc_id", F.coalesce(fold(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


QUERIES = {"op10_quality_classifier": (query, None)}
