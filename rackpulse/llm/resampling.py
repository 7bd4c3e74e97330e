"""Importance resampling towards a target distribution, with a head-tail vocabulary.

Features are runs of 1 to ``runs`` consecutive words (joined by one space), hashed by CRC-32 into buckets. A bucket's gain
is the log ratio of its smoothed share in the target texts to that in the corpus; a document's weight is the sum over its
features. Documents are drawn without repeats by the highest weight plus Gumbel noise from a hash of the id.

Words repeat, so their checksums need not be computed each time. The head of the vocabulary, broadcast, holds the exact
CRC state of the most frequent words and the bucket of the most frequent pairs of them; the checksum of a longer feature
continues the state of its first words. Words and pairs of the tail are computed directly, byte by byte for all words at a
time. Head entries are told apart by all their bytes, so both ways give the same bucket totals: which words are
in the head changes the work, never the result.

Words are runs of letters, digits and characters outside ASCII after lower-casing A-Z.

Defined results: a null or empty text has no features, weighs 0 and is never drawn; rows without an id draw with the noise of an
empty id and come after those with one; repeated rows and equal scores are documents each, ties go to the smaller id;
an empty corpus gives an empty table, an empty target zero counts; further columns are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rackpulse.llm import textbytes
from rackpulse.llm.ranks import numbered
from rackpulse.llm.tables import table, text_of, written

BUCKETS = 10_000
RUNS = 1
LEAST_WORDS = 20
PERCENT = 10
SEED = "2024"
#: Words and pairs in the broadcast head. A word of the head has at most two machine words of bytes.
HEAD_WORDS = 4096
HEAD_PAIRS = 16_384
_LONGEST_HEAD = 16
_LONG = 64
#: A task tells the words that make up this share of one of its batches; there are no more than its inverse.
TOLD_SHARE = 0.0001

_INSIDE = np.zeros(256, bool)
_INSIDE[48:58] = _INSIDE[97:123] = _INSIDE[128:] = True
_FIRST_BYTES = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
_ALL = np.uint32(0xFFFFFFFF)


def _crc_table() -> np.ndarray:
    value = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        value = np.where(value & 1, (value >> 1) ^ np.uint32(0xEDB88320), value >> 1).astype(np.uint32)
    return value


_CRC = _crc_table()


def extended(state: np.ndarray, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 states after the byte ranges: one step for the next byte of all ranges that still have one.

    The few long ranges are continued one by one.
    """
    state, size = state.copy(), end - begin
    long = np.flatnonzero(size > _LONG)
    for i in long.tolist():
        state[i] = zlib.crc32(data[begin[i] : end[i]].tobytes(), int(state[i] ^ _ALL)) ^ 0xFFFFFFFF
    if len(long):
        size = np.where(size > _LONG, 0, size)
    order = np.argsort(-size, kind="stable")
    state, begin, size = state[order], begin[order], size[order]
    for k in range(int(size[0]) if len(size) else 0):
        live = int(np.searchsorted(-size, -k, "left"))  # ranges longer than k bytes stand first
        now = state[:live]
        state[:live] = _CRC[(now ^ data[begin[:live] + k]) & 0xFF] ^ (now >> np.uint32(8))
    out = np.empty_like(state)
    out[order] = state
    return out


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of every word of lower-cased bytes, and how many words stand before each row (one more at the end)."""
    inside = _INSIDE[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[at] = True
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | cut[1:-1]
    ends[:-1] &= ~inside[1:] | cut[1:-1]
    begin, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return begin, end, np.searchsorted(begin, at)


def packed(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first 16 bytes of every range as two numbers; no word has a zero byte, so words up to 16 bytes are told apart."""
    wide = np.concatenate([data, np.zeros(_LONGEST_HEAD, np.uint8)])
    eights = np.ndarray(len(data) + 9, "<u8", wide, 0, (1,))
    size = end - begin
    low = eights[begin] & _FIRST_BYTES[np.minimum(size, 8)]
    high = eights[np.minimum(begin + 8, len(data))] & _FIRST_BYTES[np.clip(size - 8, 0, 8)]
    return low, high


def _key(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return textbytes.mixed(low ^ textbytes.mixed(high + np.uint64(1)))


@dataclass(frozen=True)
class Head:
    """Frequent words with their CRC states, and frequent pairs of them with their buckets."""

    key: np.ndarray  # ascending hash of a word's bytes, to look it up
    low: np.ndarray  # its bytes, to tell it from others
    high: np.ndarray
    state: np.ndarray  # CRC state behind it
    pair: np.ndarray  # ascending: place of the first word * number of words + place of the second
    pair_bucket: np.ndarray

    @staticmethod
    def of(names: list[bytes], pairs: list[tuple[bytes, bytes]] = (), buckets: int = BUCKETS) -> Head:
        names = [n for n in dict.fromkeys(names) if 0 < len(n) <= _LONGEST_HEAD]
        data = np.frombuffer(b"".join(names), np.uint8)
        ends = np.cumsum([len(n) for n in names], dtype=np.int64)
        begins = np.concatenate([np.zeros(1, np.int64), ends])[:-1] if names else ends
        low, high = packed(data, begins, ends) if names else (np.zeros(0, np.uint64),) * 2
        state = np.array([zlib.crc32(n) for n in names], np.uint32) ^ _ALL
        key = _key(low, high)
        order = np.argsort(key, kind="stable")
        place = {names[o]: i for i, o in enumerate(order.tolist())}
        both = {place[a] * len(names) + place[b]: zlib.crc32(a + b" " + b) % buckets for a, b in pairs if a in place and b in place}
        return Head(
            key[order], low[order], high[order], state[order], np.array(sorted(both), np.int64), np.array([both[p] for p in sorted(both)], np.int64)
        )

    def places(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Place of every word in the head; -1 for words of the tail."""
        if not len(self.key):
            return np.full(len(begin), -1)
        low, high = packed(data, begin, end)
        at = np.minimum(np.searchsorted(self.key, _key(low, high)), len(self.key) - 1)
        return np.where((self.low[at] == low) & (self.high[at] == high) & (end - begin <= _LONGEST_HEAD), at, -1)


def features(head: Head, data: np.ndarray, at: np.ndarray, runs: int = RUNS, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of every feature of the texts, the row of each, and the number of words of every row."""
    data = textbytes.lowered(data)
    begin, end, before = words(data, at)
    count = np.diff(before)
    row = np.repeat(np.arange(len(count)), count)
    place = head.places(data, begin, end)
    known = place >= 0
    state = np.full(len(begin), _ALL, np.uint32)
    state[known] = head.state[place[known]]
    state[~known] = extended(state[~known], data, begin[~known], end[~known])
    found, rows = [((state ^ _ALL) % np.uint32(buckets)).astype(np.int64)], [row]
    left = before[1:][row] - np.arange(len(row))  # words from here to the end of the row
    here = np.arange(len(row))
    for length in range(2, runs + 1):
        here = here[left[here] >= length]
        last = here + length - 1
        bucket = np.full(len(here), -1, np.int64)
        if length == 2 and len(head.pair):
            pair = place[here] * len(head.key) + place[last]
            spot = np.minimum(np.searchsorted(head.pair, pair), len(head.pair) - 1)
            same = (head.pair[spot] == pair) & known[here] & known[last]
            bucket[same] = head.pair_bucket[spot[same]]
        # Longer runs continue the state, so it is needed for all features but pairs that nothing follows.
        need = np.ones(len(here), bool) if length < runs else bucket < 0
        now = state[here[need]]
        now = _CRC[(now ^ np.uint32(32)) & 0xFF] ^ (now >> np.uint32(8))  # the space
        now = extended(now, data, begin[last[need]], end[last[need]])
        state = state.copy()
        state[here[need]] = now
        bucket[need] = (now ^ _ALL) % np.uint32(buckets)
        found.append(bucket)
        rows.append(row[here])
    return np.concatenate(found), np.concatenate(rows), count


def vocabulary(docs: DataFrame, runs: int = RUNS, buckets: int = BUCKETS) -> Head:
    """The head of all documents' vocabulary: words and pairs that are frequent in some batch, the most frequent ones of them.

    A task tells what reaches ``TOLD_SHARE`` in one of its batches, so a list it tells has a bound; counts are
    summed over all tasks and the first ``HEAD_WORDS`` and ``HEAD_PAIRS`` come to the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[bytes, bytes], int] = {}
        for batch in batches:
            for _, _, data, at in textbytes.chunks(batch.column(0)):
                data = textbytes.lowered(data)
                begin, end, before = words(data, at)
                low, high = packed(data, begin, end)
                short = np.flatnonzero(end - begin <= _LONGEST_HEAD)
                key = _key(low[short], high[short])
                _, first, count = np.unique(key, return_index=True, return_counts=True)
                for i in np.flatnonzero(count > max(1, TOLD_SHARE * len(key))).tolist():
                    w = short[first[i]]
                    name = data[begin[w] : end[w]].tobytes(), b""
                    total[name] = total.get(name, 0) + int(count[i])
                if runs > 1 and len(begin) > 1:
                    inner = np.ones(len(begin), bool)
                    inner[before[1:-1][before[1:-1] < len(begin)]] = False
                    second = np.flatnonzero(inner[1:] & (end - begin <= _LONGEST_HEAD)[1:] & (end - begin <= _LONGEST_HEAD)[:-1]) + 1
                    both = textbytes.mixed(_key(low[second - 1], high[second - 1]) + np.uint64(3) * _key(low[second], high[second]))
                    _, first, count = np.unique(both, return_index=True, return_counts=True)
                    for i in np.flatnonzero(count > max(1, TOLD_SHARE * len(both))).tolist():
                        w = second[first[i]]
                        name = data[begin[w - 1] : end[w - 1]].tobytes(), data[begin[w] : end[w]].tobytes()
                        total[name] = total.get(name, 0) + int(count[i])
            if len(total) > 4 / TOLD_SHARE:
                yield _told(total)
                total = {}
        yield _told(total)

    told = docs.select(text_of().alias("text")).mapInArrow(run, "a binary, b binary, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))
    order = (F.col("n").desc(), "a", "b")
    told = written(told, "vocabulary")
    names = told.filter(F.length("b") == 0).orderBy(*order).limit(HEAD_WORDS).collect()
    pairs = told.filter(F.length("b") > 0).orderBy(*order).limit(HEAD_PAIRS).collect() if runs > 1 else []
    return Head.of([bytes(r["a"]) for r in names], [(bytes(r["a"]), bytes(r["b"])) for r in pairs], buckets)


def _told(total: dict[tuple[bytes, bytes], int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([a for a, _ in total], pa.binary()), pa.array([b for _, b in total], pa.binary()), pa.array(total.values(), pa.int64())], names=["a", "b", "n"]
    )


def bucket_totals(texts: DataFrame, head: Head, runs: int = RUNS, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all texts by bucket: one row a bucket and task is shuffled, one a bucket comes to the driver."""
    sent = texts.sparkSession.sparkContext.broadcast(head)  # HEAD_WORDS and HEAD_PAIRS entries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, data, at in textbytes.chunks(batch.column(0)):
                total += np.bincount(features(sent.value, data, at, runs, buckets)[0], minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    counted = texts.select(text_of().alias("text")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    for row in counted.collect():
        out[row["bucket"]] = row["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of the smoothed shares, rounded down, for each bucket."""
    size, all_corpus, all_target = len(corpus), int(corpus.sum()), int(target.sum())
    return np.array([
        math.floor(1000 * math.log(float((t + 1) * (all_corpus + size)) / float((s + 1) * (all_target + size))))
        for s, t in zip(corpus.tolist(), target.tolist())
    ], np.int64)


def weighted(docs: DataFrame, gain: np.ndarray, head: Head, runs: int = RUNS) -> DataFrame:
    """Features, words and weight of every document (``doc_id``, ``n_features``, ``n_words``, ``weight``)."""
    buckets = len(gain)
    sent = docs.sparkSession.sparkContext.broadcast((gain, head))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain, head = sent.value
        for batch in batches:
            for begin, end, data, at in textbytes.chunks(batch.column(1)):
                bucket, row, count = features(head, data, at, runs, buckets)
                weight = np.bincount(row, gain[bucket], end - begin).astype(np.int64)  # whole numbers far below 2^53
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(begin, end - begin), pa.array(np.bincount(row, minlength=end - begin)), pa.array(count), pa.array(weight)],
                    names=["doc_id", "n_features", "n_words", "weight"],
                )

    source = docs.select(F.col("doc_id").cast("long"), text_of().alias("text"))
    return source.mapInArrow(run, "doc_id long, n_features long, n_words long, weight long")


def noise(doc_id: Column, seed: str = SEED) -> Column:
    """Thousandths of a Gumbel number from a hash of the id, rounded down."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def resampled(
    docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, runs: int = RUNS, buckets: int = BUCKETS, seed: str = SEED
) -> DataFrame:
    """Every document's features, weight, score and rank (``doc_id``, ``n_features``, ``weight``, ``score``, ``rank``).

    ``percent`` of the documents with enough words are drawn; the rank of those not drawn is null.
    """
    head = vocabulary(docs, runs, buckets)
    gain = gains(bucket_totals(docs, head, runs, buckets), bucket_totals(target, head, runs, buckets))
    rows = weighted(docs, gain, head, runs).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "scores")
    draw = rows.filter(F.col("n_words") >= least_words).count() * percent // 100
    fit = F.when(F.col("n_words") >= least_words, F.col("score"))
    placed = numbered(rows, fit.desc_nulls_last(), F.col("doc_id").asc_nulls_last(), F.col("row"))
    rank = F.when(F.col("place") < draw, F.col("place") + 1)
    return placed.select("doc_id", "n_features", "weight", "score", rank.alias("rank"))


def sample(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """Ids of the drawn documents with their ranks."""
    return resampled(docs, target, **options).filter(F.col("rank").isNotNull())


def query(spark: SparkSession, folder: str) -> DataFrame:
    return resampled(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


QUERIES = {"op13_target_resampling": (query, None)}
