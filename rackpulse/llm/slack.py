"""Packing by minimum bin slack.

Pieces of equal length are alike, so only the number of pieces of each length matters for the plan: at most
``capacity`` numbers, whatever the corpus. For each bin the longest length left is set, and a subset-sum bitset over
the other lengths left finds the fullest feasible combination; it is removed as often as the pieces allow, which
makes that many equal bins at once. The plan has at most a few combinations for each length, fits on the driver and
is proven to stay small; the pieces themselves are ranked among their length in parallel and look up their place.

Defined results: a null or empty text is the closing id alone; rows without an id column value are packed like any
other; repeated rows are packed each; ties are broken by id and piece; an empty table gives no rows; further columns
are not read. Texts are processed whole; one longer than the capacity is cut into full pieces, the first may be shorter.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rackpulse.llm import textbytes
from rackpulse.llm.tables import table, text_of, written
from rackpulse.llm.tokens import Encoder

CAPACITY = 2048
#: Pieces that one ranking task sees of one length, about; a length in a third of all pieces is split by it.
RANKED_TOGETHER = 200_000
LEAST_SHARDS = 32

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(size: int, capacity: int) -> list[tuple[int, int]]:
    """Begin and length of the pieces of a text; a remainder comes first."""
    begins = ([0] if size % capacity else []) + list(range(size % capacity, size, capacity))
    return [(a, b - a) for a, b in zip(begins, begins[1:] + [size])]


def pieces(df: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None) -> DataFrame:
    """Pieces of every text with the checksum of their ids (columns of ``PIECES``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary)
        for batch in batches:
            names = batch.column(0)
            for begin, end, data, at in textbytes.chunks(batch.column(1)):
                ids, place = encoder.encode(data, at)
                ids = ids.astype("<u4", copy=False)
                row, piece, start, length, crc = [], [], [], [], []
                for r, (a, b) in enumerate(zip(place[:-1].tolist(), place[1:].tolist())):
                    for k, (s, n) in enumerate(cut(b - a, capacity)):
                        row.append(begin + r)
                        piece.append(k)
                        start.append(s)
                        length.append(n)
                        crc.append(zlib.crc32(ids[a + s : a + s + n]))
                yield pa.RecordBatch.from_arrays(
                    [names.take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return df.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(run, PIECES)


def fullest(room: int, counts: np.ndarray, longest: int) -> list[int]:
    """Lengths, long ones first, whose sum is as near to ``room`` as the pieces allow.

    A bitset holds the sums reached; each length enters as often as there are pieces and room, in parts of 1, 2, 4
    ... copies. The bitsets before each part lead back to the lengths used.
    """
    reached, mask, steps = 1, (1 << (room + 1)) - 1, []
    goal = 1 << room
    for length in range(min(longest, room), 0, -1):
        left, part = min(int(counts[length]), room // length), 1
        while left > 0 and not reached & goal:
            part = min(part, left)
            steps.append((reached, length, part))
            reached = (reached | (reached << (length * part))) & mask
            left -= part
            part *= 2
        if reached & goal:
            break
    at, used = reached.bit_length() - 1, []
    for before, length, part in reversed(steps):
        if not before >> at & 1:
            used += [length] * part
            at -= length * part
    return sorted(used, reverse=True)


def plan(counts: np.ndarray) -> list[tuple[int, list[int]]]:
    """Combinations with the number of bins each fills, from the number of pieces of each length (index: length)."""
    counts, capacity, out = counts.copy(), len(counts) - 1, []
    longest = capacity
    while True:
        while longest and not counts[longest]:
            longest -= 1
        if not longest:
            return out
        counts[longest] -= 1
        used = [longest, *fullest(capacity - longest, counts, longest)]
        counts[longest] += 1
        kinds, need = np.unique(used, return_counts=True)
        bins = int((counts[kinds] // need).min())
        counts[kinds] -= bins * need
        out.append((bins, used))


class Places:
    """For a length and a rank among its pieces: the bin and the place there."""

    def __init__(self, counts: np.ndarray):
        self.first = np.concatenate([[0], np.cumsum(counts)[:-1]])  # of each length, in one numbering of all pieces
        given = np.zeros(len(counts), np.int64)
        rows, bin_id = [], 0
        for bins, used in plan(counts):
            kinds, need = np.unique(used, return_counts=True)
            offset = 0
            for length, copies in zip(kinds.tolist(), need.tolist()):
                rows.append((self.first[length] + given[length], bins, bin_id, offset, length))
                given[length] += bins * copies
                offset += length * copies
            bin_id += bins
        self.rows = np.array(sorted(rows), np.int64).reshape(-1, 5)
        self.bins = bin_id

    def of(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        number = self.first[length] + rank
        begin, bins, bin_id, offset, size = self.rows[np.searchsorted(self.rows[:, 0], number, "right") - 1].T
        slot, copy = np.divmod(number - begin, bins)
        return bin_id + copy, offset + slot * size


def ranked(rows: DataFrame, by: str, ties: list[str], total: int) -> DataFrame:
    """The rows with ``rank``, from 0 among those of equal ``by``, without a task that sees all of them.

    Rows are dealt to shards by a hash of ``ties``; counts of the shards give each its first rank.
    """
    shards = max(LEAST_SHARDS, -(-total // RANKED_TOGETHER))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64(*ties), F.lit(shards)))
    counts = dealt.groupBy(by, "shard").agg(F.count("*").alias("n"))
    before = Window.partitionBy(by).orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select(by, "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    own = F.row_number().over(Window.partitionBy(by, "shard").orderBy(*ties))
    return dealt.withColumn("own", own).join(first, [by, "shard"]).withColumn("rank", F.col("first") + F.col("own") - 1).drop("shard", "own", "first")


def packed(df: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None) -> DataFrame:
    """Every piece with its bin and its place there (``PIECES``, ``sequence_id``, ``offset``)."""
    made = written(pieces(df, capacity, vocabulary), "slack-pieces")
    counts = np.zeros(capacity + 1, np.int64)
    for row in made.groupBy("length").count().collect():  # at most one row for each possible length
        counts[row["length"]] = row["count"]
    places = Places(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bin_id, offset = places.of(batch.column("length").to_numpy(), batch.column("rank").to_numpy())
            arrays = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays(
                [*arrays, pa.array(bin_id), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
            )

    rows = ranked(made, "length", ["doc_id", "piece", "start", "ids_crc32"], int(counts.sum()))
    return rows.mapInArrow(run, f"{PIECES}, sequence_id long, offset long")


def query(spark: SparkSession, folder: str) -> DataFrame:
    return packed(table(spark, folder, "documents"))


QUERIES = {"op9_best_fit_packing": (query, None)}
