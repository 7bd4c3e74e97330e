"""Exact k nearest neighbours as a partitioned join.

Training points are assigned to the nearest of a few centres. A bound on the
k-th neighbour's distance, taken from the cells' distances to their centres,
rules out the cells that cannot hold a closer point (the pivot-based kNN join,
Lu et al. 2012). Large cells split into blocks on both sides, each packed into
one row; pairs of blocks are read where they are joined, and only the k best
rows of a query leave a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf

from rackpulse.operators.skew import last_wins, top_k
from rackpulse.session import materialise

BLOCK_ROWS = 8192
MAX_CENTRES = 1024
CHUNK_CELLS = 4_000_000
#: Many rows are cut into this many cells at least; more only when blocks would be larger than BLOCK_ROWS.
LEAST_CELLS = 64
#: Bytes of vectors that a task of the block join holds of the points' side.
RIGHT_BYTES = 256 << 20


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype=np.float64)


def _distances(points: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Euclidean distances by differences, so equal points are exactly 0 apart."""
    out = np.empty((len(points), len(others)))
    step = max(1, CHUNK_CELLS // max(1, others.size))
    for i in range(0, len(points), step):
        gap = points[i:i + step, None, :] - others[None, :, :]
        out[i:i + step] = np.sqrt(np.einsum("ijk,ijk->ij", gap, gap))
    return out


def _centres(train: DataFrame, n: int) -> np.ndarray:
    """A fixed pseudo-random choice of training points; at most MAX_CENTRES rows."""
    rows = train.select("_x").orderBy(F.xxhash64("_tid"), "_tid").limit(n).collect()
    return np.array([r["_x"] for r in rows], dtype=np.float64)


def _nearest_centre(centres: np.ndarray):
    @pandas_udf("struct<cell:int,gap:double>")
    def assign(x: pd.Series) -> pd.DataFrame:
        gaps = _distances(_matrix(x), centres)
        cell = gaps.argmin(axis=1)
        return pd.DataFrame({"cell": cell.astype("int32"), "gap": gaps[np.arange(len(gaps)), cell]})

    return assign


def _reachable_cells(centres: np.ndarray, radius: np.ndarray, closest: np.ndarray, k: int):
    """Cells that can hold one of a point's k nearest neighbours.

    ``closest`` lists up to k smallest distances to its centre per cell, padded with infinity.
    """
    between = _distances(centres, centres)
    inner = closest.ravel()

    def cells_of(points: np.ndarray) -> list[np.ndarray]:
        gaps = _distances(points, centres)
        upper = np.repeat(gaps, closest.shape[1], axis=1) + inner
        nth = min(k, upper.shape[1]) - 1
        bound = np.partition(upper, nth, axis=1)[:, nth][:, None]
        home = gaps.argmin(axis=1)
        own = gaps[np.arange(len(gaps)), home][:, None]
        apart = between[home]
        # No point of another cell is nearer than the plane midway between the centres.
        plane = np.divide(gaps**2 - own**2, 2 * apart, out=np.zeros_like(gaps), where=apart > 0)
        lower = np.maximum(gaps - radius, plane)
        keep = (lower <= bound * (1 + 1e-9) + 1e-12) & (radius >= 0)
        return [np.flatnonzero(row).astype("int32") for row in keep]

    @pandas_udf("array<int>")
    def reachable(x: pd.Series) -> pd.Series:
        points = _matrix(x)
        step = max(1, CHUNK_CELLS // inner.size)
        return pd.Series([c for i in range(0, len(points), step) for c in cells_of(points[i:i + step])])

    return reachable


def _numbers(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.float64, copy=False)


class _Block:
    """One packed block of queries or points: ids, labels and the matrix of its vectors."""

    def __init__(self, row: pa.RecordBatch, i: int, side: str):
        flat = lambda name: row.column(name)[i].values
        self.ids = flat(f"{side}_ids")
        self.x = _numbers(flat(f"{side}_xs")).reshape(len(self.ids), -1)
        self.norms = np.einsum("ij,ij->i", self.x, self.x)


class _Nearest:
    """The k best points of each query of a block, merged point block by point block."""

    def __init__(self, number: int, asked: _Block, k: int):
        self.number, self.asked, self.k = number, asked, k
        n = len(asked.ids)
        self.gap, self.tid = np.full((n, k), np.inf), np.full((n, k), np.iinfo(np.int64).max)
        self.label = np.full((n, k), np.nan)
        self.filled = np.zeros(n, dtype=np.int64)

    def add(self, known: _Block, labels: np.ndarray) -> None:
        tid = known.ids.to_numpy(zero_copy_only=False)
        step = max(1, CHUNK_CELLS // max(1, len(tid)))
        for i in range(0, len(self.filled), step):
            self._add(slice(i, min(i + step, len(self.filled))), known, tid, labels)

    def _add(self, part: slice, known: _Block, tid: np.ndarray, labels: np.ndarray) -> None:
        x, norms, k = self.asked.x[part], self.asked.norms[part], self.k
        # Squares by one matrix product, off by rounding only; what they cannot rule out is measured by differences.
        rough = norms[:, None] + known.norms[None, :] - 2 * (x @ known.x.T)
        slack = 8 * (x.shape[1] + 8) * np.finfo(np.float64).eps * (norms + known.norms.max())
        bound = self.gap[part, k - 1] ** 2
        if len(tid) >= k and (self.filled[part] < k).any():
            bound = np.minimum(bound, np.partition(rough, k - 1, axis=1)[:, k - 1] + slack)
        row, col = np.nonzero(rough <= (bound * (1 + 1e-9) + slack)[:, None])
        if not len(row):
            return
        gaps = np.empty(len(row))
        for j in range(0, len(row), CHUNK_CELLS // max(1, x.shape[1]) + 1):
            some = slice(j, j + CHUNK_CELLS // max(1, x.shape[1]) + 1)
            gap = x[row[some]] - known.x[col[some]]
            gaps[some] = np.sqrt(np.einsum("ij,ij->i", gap, gap))
        held_row, held_col = np.nonzero(np.arange(k)[None, :] < self.filled[part][:, None])
        rows = np.concatenate([held_row, row])
        gaps = np.concatenate([self.gap[part][held_row, held_col], gaps])
        tids = np.concatenate([self.tid[part][held_row, held_col], tid[col]])
        label = np.concatenate([self.label[part][held_row, held_col], labels[col]])
        order = np.lexsort((tids, gaps, rows))
        rows = rows[order]
        starts = np.searchsorted(rows, np.arange(len(norms)))
        place = np.arange(len(rows)) - starts[rows]
        kept = place < k
        order, rows, place = order[kept], rows[kept], place[kept]
        self.gap[part][rows, place], self.tid[part][rows, place], self.label[part][rows, place] = gaps[order], tids[order], label[order]
        self.filled[part] = np.bincount(rows, minlength=len(norms))

    def rows(self) -> pa.RecordBatch:
        row, col = np.nonzero(np.arange(self.k)[None, :] < self.filled[:, None])
        return pa.RecordBatch.from_arrays(
            [self.asked.ids.take(pa.array(row)), pa.array(self.tid[row, col]), pa.array(self.label[row, col], from_pandas=True),
             pa.array(self.gap[row, col])], ["_qid", "_tid", "_label", "distance"],
        )


def _block_join(k: int):
    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: _Nearest | None = None  # pairs of one query block follow each other
        for batch in batches:
            for i, number in enumerate(batch.column("q_block").to_pylist()):
                if held is None or held.number != number:
                    if held is not None:
                        yield held.rows()
                    held = _Nearest(number, _Block(batch, i, "q"), k)
                held.add(_Block(batch, i, "t"), _numbers(batch.column("t_labels")[i].values))
        if held is not None:
            yield held.rows()

    return join


def _packed(df: DataFrame, side: str, keys: list[str], fields: dict[str, str], *more: Column) -> DataFrame:
    """One row per block: its fields as arrays in the same order, the vectors as one array."""
    row = F.struct(*[F.col(c) for c in (*fields.values(), "_x")])
    blocks = df.groupBy(*keys).agg(F.collect_list(row).alias("r"), *more)
    return blocks.select(
        *[c for c in blocks.columns if c != "r"],
        *[F.col(f"r.{c}").alias(f"{side}_{n}") for n, c in fields.items()], F.flatten("r._x").alias(f"{side}_xs"),
    )


def nearest_neighbours(
    train: DataFrame, queries: DataFrame, train_id: str, query_id: str, vector: str, label: str, k: int,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """The k nearest training rows of each query: query id, training id, label and distance.

    Ids are integers; equal distances are ordered by training id. ``block_rows`` is the least size of a block: many rows
    make larger ones, at most BLOCK_ROWS, so that pairs of blocks stay few.
    """
    points = train.select(
        F.col(train_id).cast("bigint").alias("_tid"), F.col(label).cast("double").alias("_label"),
        F.col(vector).cast("array<double>").alias("_x"),
    )
    asked = queries.select(
        F.col(query_id).cast("bigint").alias("_qid"), F.col(vector).cast("array<double>").alias("_x")
    )
    n_points = points.count()
    if n_points == 0:
        raise ValueError("no training rows")
    block_rows = max(block_rows, min(BLOCK_ROWS, n_points // LEAST_CELLS))
    centres = _centres(points, min(MAX_CENTRES, max(1, ceil(n_points / block_rows))))
    # The assignment is read several times below, so it is computed and written once.
    placed = materialise(
        points.withColumn("_a", _nearest_centre(centres)("_x")).select("_tid", "_label", "_x", "_a.*"), "cells"
    )
    radius, sizes = np.full(len(centres), -1.0), np.zeros(len(centres), dtype=np.int64)
    for row in placed.groupBy("cell").agg(F.max("gap").alias("r"), F.count("*").alias("n")).collect():
        radius[row["cell"]], sizes[row["cell"]] = row["r"], row["n"]
    closest = np.full((len(centres), k), np.inf)
    near = top_k(placed.select("cell", "gap", "_tid"), ["cell"], [F.asc("gap"), F.asc("_tid")], k)
    filled = np.zeros(len(centres), dtype=int)
    for row in near.collect():
        closest[row["cell"], filled[row["cell"]]] = row["gap"]
        filled[row["cell"]] += 1

    own = lambda key, n: F.pmod(F.xxhash64(key), n).cast("int")
    per_cell = F.array(*[F.lit(max(1, ceil(int(n) / block_rows))) for n in sizes])
    right = _packed(
        placed.withColumn("tb", own("_tid", per_cell[F.col("cell")])), "t", ["cell", "tb"], {"ids": "_tid", "labels": "_label"}
    ).drop("tb")
    # Queries of one cell travel in one row with every cell that one of them can reach; no vector is copied for a cell.
    homed = asked.withColumns({"home": _nearest_centre(centres)("_x")["cell"], "_cells": _reachable_cells(centres, radius, closest, k)("_x")})
    spread = max(1, ceil(asked.count() / len(centres) / block_rows))
    reached = F.array_distinct(F.flatten(F.collect_list("_cells"))).alias("cells")
    left = _packed(homed.withColumn("qb", own("_qid", F.lit(spread))), "q", ["home", "qb"], {"ids": "_qid"}, reached)
    left = left.select((F.col("home") * spread + F.col("qb")).alias("q_block"), "cells", "q_ids", "q_xs")
    # Both sides are written, so each pair of their partitions is read where it is joined, and nothing is shuffled for it.
    right, width = materialise(right, "point-blocks"), 8 * centres.shape[1]
    left = materialise(left, "query-blocks")
    cores = placed.sparkSession.sparkContext.defaultParallelism
    pairs = left.repartition(min(len(centres) * spread, 4 * cores), "q_block").hint("shuffle_replicate_nl").join(
        right.coalesce(max(1, ceil(n_points * width / RIGHT_BYTES))), F.array_contains("cells", F.col("cell"))
    )
    found = pairs.drop("cells", "cell").mapInArrow(_block_join(k), "_qid bigint, _tid bigint, _label double, distance double")
    best = top_k(found, ["_qid"], [F.asc("distance"), F.asc("_tid")], k)
    return best.select(
        F.col("_qid").alias("query_id"), F.col("_tid").alias("train_id"), F.col("_label").alias("label"), "distance"
    )


def vote(neighbours: DataFrame) -> DataFrame:
    """Most frequent label of each query's neighbours; the smallest label wins a tie."""
    votes = neighbours.groupBy("query_id", "label").agg(F.count("*").alias("n"))
    return last_wins(votes, ["query_id"], [F.col("n"), -F.col("label")]).select(
        "query_id", F.col("label").alias("prediction")
    )


def mean_label(neighbours: DataFrame) -> DataFrame:
    return neighbours.groupBy("query_id").agg(F.avg("label").alias("prediction"))
