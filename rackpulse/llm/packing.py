"""Token-id output: best-fit-decreasing packing into fixed rows of ids.

Each task encodes its texts, cuts long ones into pieces without losing an id, and packs a bounded buffer of pieces:
longest first, each into the bin with the least room that still takes it, found by a segment tree over the room
left. Bins that are not full stay open for the next buffer; full and old ones are written. Nothing is shuffled and
no task holds more than a buffer, at any size of the corpus; the price is one short run of open bins for each task.

A row is a packed sequence: ``input_ids`` (little-endian, padded to the capacity), ``cu_seqlens`` (cumulative segment
lengths from 0), ``position_ids`` (from 0 in each segment), and of each segment the document and the place of its
first id there. ``matrices`` writes the rows; ``read_matrix`` reads them as numpy arrays.

Defined results: a null or empty text is the closing id alone; repeated rows are packed each; an empty table gives no
rows; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rackpulse.llm import textbytes
from rackpulse.llm.tables import table, text_of
from rackpulse.llm.tokens import Encoder

CAPACITY = 2048
#: Pieces a task packs at a time, and bins it keeps open between two buffers.
BUFFER_PIECES = 4096
OPEN_BINS = 64
SCHEMA = (
    "sequence_id long, n_tokens int, doc_ids array<long>, starts array<long>, cu_seqlens array<int>, input_ids binary, position_ids binary"
)


class RoomTree:
    """Bins by the room they have left, in a segment tree: the least room that is enough in log(capacity) steps."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, room: int, bin_id: int) -> None:
        self.bins[room].append(bin_id)
        self._change(room, 1)

    def take(self, size: int) -> tuple[int, int] | None:
        """The bin with the least room of at least ``size``, removed; None if there is none."""
        node = size + self.leaves
        if not self.count[node]:
            while node > 1 and (node & 1 or not self.count[node + 1]):  # to the next subtree on the right with a bin
                node >>= 1
            if node == 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.count[2 * node] else 2 * node + 1
        room = node - self.leaves
        self._change(room, -1)
        return room, self.bins[room].pop()

    def _change(self, room: int, by: int) -> None:
        node = room + self.leaves
        while node:
            self.count[node] += by
            node >>= 1


def best_fit(sizes: list[int], capacity: int, rooms: list[int]) -> list[int]:
    """Bin of each piece, longest pieces first. ``rooms``: room left in the open bins; new bins are appended to it."""
    tree = RoomTree(capacity)
    for bin_id, room in enumerate(rooms):
        tree.add(room, bin_id)
    out = [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        found = tree.take(sizes[i])
        if found is None:
            found = capacity, len(rooms)
            rooms.append(capacity)
        room, bin_id = found
        rooms[bin_id] = room - sizes[i]
        tree.add(rooms[bin_id], bin_id)
        out[i] = bin_id
    return out


class _Packer:
    """Bins of one task."""

    def __init__(self, capacity: int, task: int):
        self.capacity, self.next, self.pieces, self.rooms, self.segments = capacity, task << 33, [], [], []

    def add(self, name: int | None, start: int, ids: np.ndarray) -> None:
        self.pieces.append((name, start, ids))

    def pack(self, last: bool) -> pa.RecordBatch | None:
        bins = best_fit([len(x[2]) for x in self.pieces], self.capacity, self.rooms)
        self.segments += [[] for _ in range(len(self.rooms) - len(self.segments))]
        for bin_id, piece in zip(bins, self.pieces):
            self.segments[bin_id].append(piece)
        self.pieces = []
        order = sorted(range(len(self.rooms)), key=lambda b: (-self.rooms[b], b))
        keep = [] if last else [b for b in order[:OPEN_BINS] if self.rooms[b]]
        done = sorted(set(order) - set(keep))
        out = self._rows([self.segments[b] for b in done])
        self.rooms, self.segments = [self.rooms[b] for b in keep], [self.segments[b] for b in keep]
        return out

    def _rows(self, bins: list[list[tuple]]) -> pa.RecordBatch | None:
        if not bins:
            return None
        ids = np.zeros((len(bins), self.capacity), "<u2")
        positions = np.zeros((len(bins), self.capacity), "<u2")
        ends = []
        for r, segments in enumerate(bins):
            at = [0]
            for _, _, piece in segments:
                ids[r, at[-1] : at[-1] + len(piece)] = piece
                positions[r, at[-1] : at[-1] + len(piece)] = np.arange(len(piece))
                at.append(at[-1] + len(piece))
            ends.append(at)
        places = np.arange(len(bins) + 1) * self.capacity
        arrays = [
            pa.array(range(self.next, self.next + len(bins)), pa.int64()), pa.array([x[-1] for x in ends], pa.int32()),
            pa.array([[x[0] for x in s] for s in bins], pa.list_(pa.int64())), pa.array([[x[1] for x in s] for s in bins], pa.list_(pa.int64())),
            pa.array(ends, pa.list_(pa.int32())), textbytes.binaries(ids.ravel(), places), textbytes.binaries(positions.ravel(), places),
        ]
        self.next += len(bins)
        return pa.RecordBatch.from_arrays(arrays, names=["sequence_id", "n_tokens", "doc_ids", "starts", "cu_seqlens", "input_ids", "position_ids"])


def packed(df: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None) -> DataFrame:
    """Packed sequences of all texts (columns of ``SCHEMA``); ids are two bytes each, as vocabularies below 65,536 allow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, packer = Encoder(vocabulary), _Packer(capacity, TaskContext.get().partitionId())
        for batch in batches:
            names = batch.column(0).to_pylist()
            for begin, end, data, at in textbytes.chunks(batch.column(1)):
                ids, place = encoder.encode(data, at)
                ids = ids.astype("<u2")
                for r, (a, b) in enumerate(zip(place[:-1].tolist(), place[1:].tolist())):
                    for s in range(a, b, capacity):
                        packer.add(names[begin + r], s - a, ids[s : min(b, s + capacity)].copy())
                        if len(packer.pieces) >= BUFFER_PIECES and (out := packer.pack(False)) is not None:
                            yield out
        if (out := packer.pack(True)) is not None:
            yield out

    return df.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(run, SCHEMA)


def matrices(df: DataFrame, path: str, **options) -> None:
    """Write the packed rows as Parquet files."""
    packed(df, **options).write.parquet(path)


def read_matrix(rows) -> tuple[np.ndarray, np.ndarray]:
    """Id and position matrices of collected rows."""
    read = [(np.frombuffer(r["input_ids"], "<u2"), np.frombuffer(r["position_ids"], "<u2")) for r in rows]
    return np.stack([a for a, _ in read]), np.stack([b for _, b in read])


def query(spark: SparkSession, folder: str) -> DataFrame:
    return packed(table(spark, folder, "documents"))


QUERIES = {"op6_token_matrices": (query, None)}
