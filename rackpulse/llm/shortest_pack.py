"""Packing by shortest pack first over the length histogram, with cuts that leave no padding.

Pieces of equal length are alike, so the plan is made on the number of pieces of each length. Lengths are placed
longest first, each into the shortest packs that are open (those with the most room); packs with the same lengths are one
pattern with a count, and placing a length moves packs from one pattern to another. A length that does not even fit
the shortest pack opens new ones. The plan has a few patterns for each length, whatever the corpus.

What is left is room at the end of packs. The shortest packs are taken apart again, as many as it takes for their tokens to fill
the room of all others: those tokens are one stream, the rooms are laid along it, and a piece that crosses a border is
cut there. The last tokens, fewer than a sequence holds, become sequences whose lengths are powers of two. So no sequence
is padded, and only pieces of the dissolved packs are cut.

Documents meet the plan by rank: a piece's place in the global order by length says which pattern, which copy of it and
which place in it is the piece's. No task sees more than a range of that order, and nothing but the histogram and the
plan visits the driver. Ids are written once where they are made and stay there: what is ranked is a narrow row for each piece, and
only ids of cut pieces are read again. ``sequences`` brings all ids together.

Defined results: a null or empty text is the closing id alone; rows without an id are packed like any other; repeated rows are
packed each; pieces of equal length are told apart by where they were read; an empty table gives no rows; further columns
are not read. Texts are processed whole; one longer than the capacity is cut into full pieces, the last may be shorter.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rackpulse.llm import textbytes
from rackpulse.llm.ranks import numbered
from rackpulse.llm.tables import table, text_of, written
from rackpulse.llm.tokens import Encoder

CAPACITY = 2048
CLOSING = 1

PIECES = "doc_id long, start long, length long, doc_tokens long, ids_crc32 long, ids binary"
PARTS = "row long, doc_id long, start long, length long, doc_tokens long, ids_crc32 long, begin long, whole long, sequence_id long, offset long"


def pieces(df: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None, closing: int = CLOSING) -> DataFrame:
    """Every text's ids in pieces of at most ``capacity`` (``PIECES``; ``ids``: unsigned 32-bit, little-endian, with their checksum)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary, closing)
        for batch in batches:
            names = batch.column(0)
            for begin, _, data, at in textbytes.chunks(batch.column(1)):
                ids, place = encoder.encode(data, at)
                size = np.diff(place)
                count = -(-size // capacity)
                row = np.repeat(np.arange(len(size)), count)
                start = (np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)) * capacity
                length = np.minimum(capacity, size[row] - start)
                ids, ends = ids.astype("<u4", copy=False), np.append(place[row] + start, place[-1])
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [names.take(pa.array(begin + row)), pa.array(start), pa.array(length), pa.array(size[row]), pa.array(crc, pa.int64()), textbytes.binaries(ids, ends)],
                    names=["doc_id", "start", "length", "doc_tokens", "ids_crc32", "ids"],
                )

    return df.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(run, PIECES)


def patterns(counts: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Packs of equal lengths with their number, from the number of pieces of each length (index: length)."""
    capacity = len(counts) - 1
    open_packs: dict[int, list[list]] = {}  # by room: [lengths, number]
    out = []

    def put(lengths: tuple[int, ...], number: int) -> None:
        room = capacity - sum(lengths)
        if room:
            open_packs.setdefault(room, []).append([lengths, number])
        else:
            out.append((lengths, number))

    for length in range(capacity, 0, -1):
        left = int(counts[length])
        while left:
            room = max(open_packs, default=0)  # the shortest pack
            if room >= length:
                pack = open_packs[room][-1]
                taken = min(left, pack[1])
                pack[1] -= taken
                if not pack[1]:
                    open_packs[room].pop()
                    if not open_packs[room]:
                        del open_packs[room]
                put((*pack[0], length), taken)
                left -= taken
            else:  # new packs, each takes the length as often as it fits before another is opened
                fits = min(capacity // length, left)
                taken = left // fits
                put((length,) * fits, taken)
                left -= fits * taken
    return out + [(lengths, number) for room in sorted(open_packs) for lengths, number in open_packs[room]]


class Plan:
    """Where every piece goes, by its place in the order of all pieces by length."""

    def __init__(self, counts: np.ndarray):
        self.capacity = len(counts) - 1
        self.first = np.concatenate([np.zeros(1, np.int64), np.cumsum(counts)])[:-1]
        tokens = int((np.arange(len(counts)) * counts).sum())
        made = sorted(patterns(counts), key=lambda p: -sum(p[0]))
        full = tokens // self.capacity  # sequences that will be filled; the others are taken apart
        given = np.zeros(len(counts), np.int64)
        kept, stream, rooms = [], [], []  # (first piece, packs, first sequence, offset, length), (first piece, pieces, length), (room, packs, first sequence)
        sequence = 0
        for lengths, number in made:
            keep = min(number, full - sequence)
            kinds, times = np.unique(lengths, return_counts=True)
            offset = 0
            for length, copies in zip(kinds.tolist(), times.tolist()):
                begin = int(self.first[length] + given[length])
                if keep:
                    kept.append((begin, keep, sequence, offset, length))
                if number > keep:
                    stream.append((begin + keep * copies, (number - keep) * copies, length))
                given[length] += number * copies
                offset += length * copies
            if keep and offset < self.capacity:
                rooms.append((self.capacity - offset, keep, sequence))
            sequence += keep
        self.kept = np.array(sorted(kept), np.int64).reshape(-1, 5)
        # The stream of the pieces taken apart, and the rooms along it: those of the kept packs, then powers of two.
        stream.sort(key=lambda s: (-s[2], s[0]))
        sizes = np.array([n * length for _, n, length in stream], np.int64)
        begins = np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)])[:-1] if len(sizes) else sizes
        self.stream = np.array(sorted((p, n, length, b) for (p, n, length), b in zip(stream, begins.tolist())), np.int64).reshape(-1, 4)
        rest = tokens - full * self.capacity
        for power in range(rest.bit_length() - 1, -1, -1):
            if rest >> power & 1:
                rooms.append((1 << power, 1, sequence))
                sequence += 1
        self.sequences, at, runs = sequence, 0, []
        for room, packs, first in rooms:
            where = 0 if first >= full else self.capacity - room
            runs.append((at, room, packs, first, where))
            at += room * packs
        self.runs = np.array(runs, np.int64).reshape(-1, 5)

    def _room(self, token: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of places in the stream: the sequence, the offset there, and where in the stream its room ends."""
        begin, room, _, first, where = self.runs[np.searchsorted(self.runs[:, 0], token, "right") - 1].T
        pack, inside = np.divmod(token - begin, room)
        return first + pack, where + inside, begin + (pack + 1) * room

    def parts(self, number: np.ndarray) -> tuple[np.ndarray, ...]:
        """Parts of the pieces: place in ``number``, start in the piece, length, sequence, offset; kept pieces have one part."""
        out = []
        begin = np.concatenate([self.kept[:, 0], self.stream[:, 0]])
        order = np.argsort(begin, kind="stable")
        run = order[np.searchsorted(begin[order], number, "right") - 1]
        here = np.flatnonzero(run < len(self.kept))
        first, packs, sequence, offset, length = self.kept[run[here]].T
        slot, pack = np.divmod(number[here] - first, packs)
        out.append((here, np.zeros_like(here), length, sequence + pack, offset + slot * length))
        here = np.flatnonzero(run >= len(self.kept))
        first, _, length, token = self.stream[run[here] - len(self.kept)].T
        token = token + (number[here] - first) * length
        end, start = token + length, np.zeros_like(here)
        while len(here):
            sequence, offset, border = self._room(token)
            size = np.minimum(border, end) - token
            out.append((here, start, size, sequence, offset))
            more = token + size < end
            here, token, end, start = here[more], (token + size)[more], end[more], (start + size)[more]
        return tuple(np.concatenate(c) for c in zip(*out))


def _parts(made: DataFrame, capacity: int) -> DataFrame:
    """Parts of all pieces (``PARTS``; ``begin``: of the part in its piece, ``whole``: length of the piece). Those of cut pieces have no checksum."""
    counts = np.zeros(capacity + 1, np.int64)
    for row in made.groupBy("length").count().collect():  # at most one row for each possible length
        counts[row["length"]] = row["count"]
    sent = made.sparkSession.sparkContext.broadcast(Plan(counts))  # bounded by the capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            piece, begin, length, sequence, offset = sent.value.parts(batch.column("place").to_numpy())
            whole = batch.column("length").to_numpy()[piece]
            row, doc, start, tokens, crc = (batch.column(c).take(pa.array(piece)) for c in ("row", "doc_id", "start", "doc_tokens", "ids_crc32"))
            crc = pc.if_else(pa.array(length == whole), crc, pa.scalar(None, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [row, doc, pa.array(start.to_numpy() + begin), pa.array(length), tokens, crc, pa.array(begin), pa.array(whole), pa.array(sequence), pa.array(offset)],
                names=["row", "doc_id", "start", "length", "doc_tokens", "ids_crc32", "begin", "whole", "sequence_id", "offset"],
            )

    narrow = made.select("row", "doc_id", "start", "length", "doc_tokens", "ids_crc32")
    return numbered(narrow, F.col("length"), F.col("row")).mapInArrow(run, PARTS)


def _made(df: DataFrame, capacity: int, vocabulary: str | None, closing: int) -> DataFrame:
    rows = pieces(df, capacity, vocabulary, closing).withColumn("row", F.monotonically_increasing_id())
    return written(rows, "pack-pieces", compression="zstd")


def _ids(part: DataFrame) -> DataFrame:
    """Parts with the ids of their piece, cut to their own."""
    return part.withColumn("ids", F.expr("substring(ids, cast(4 * begin + 1 as int), cast(4 * length as int))"))


def packed(df: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None, closing: int = CLOSING) -> DataFrame:
    """Every piece with the checksum of its ids, its sequence and its place there."""
    made = _made(df, capacity, vocabulary, closing)
    parts = written(_parts(made, capacity), "pack-parts")
    # In the order of one length, pieces of dissolved packs come last: their ids are found by a least row for each length.
    cut = parts.filter(F.col("ids_crc32").isNull())
    least = F.broadcast(cut.groupBy(F.col("whole").alias("length")).agg(F.min("row").alias("least")))  # at most a row for each length
    ids = made.select("row", "length", "ids").join(least, "length").filter(F.col("row") >= F.col("least")).select("row", "ids")
    filled = _ids(cut.join(ids, "row")).withColumn("ids_crc32", F.crc32("ids"))
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    return parts.filter(F.col("ids_crc32").isNotNull()).select(*columns).unionByName(filled.select(*columns))


def sequences(df: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None, closing: int = CLOSING) -> DataFrame:
    """The sequences themselves: all ids in one binary, and of each segment its offset, document, start there and length."""
    made = _made(df, capacity, vocabulary, closing)
    parts = _ids(written(_parts(made, capacity), "pack-parts").join(made.select("row", "ids"), "row"))
    segments = parts.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "doc_id", "start", "length", "ids"))).alias("s"))
    ids = F.aggregate("s", F.expr("cast('' as binary)"), lambda before, x: F.concat(before, x["ids"]))  # at most ``capacity`` segments
    return segments.select("sequence_id", ids.alias("ids"), *[F.col("s")[c].alias(f"{c}s") for c in ("offset", "doc_id", "start", "length")])


def query(spark: SparkSession, folder: str) -> DataFrame:
    return packed(table(spark, folder, "documents"))


QUERIES = {"op12_shortest_pack": (query, None)}
