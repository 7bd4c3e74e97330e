"""Mixing sources to target weights by iterative proportional fitting.

Tokens are summed over the cells of source, language and topic. The cells are raked: scaled to each marginal target
in turn until all hold, never beyond the tokens a cell has. A cell's probability is its raked tokens over its tokens,
and each document is kept if a hash of its id falls below the probability of its cell.

The targets name the values; all other values of a dimension share one cell ("other"), so the number of cells is the
product of the targets' lengths plus one, whatever the corpus: that table alone visits the driver and is sent to the
tasks. A source with a third of all rows is summed by partial aggregation. Nothing is shuffled to draw the sample.

Defined results: a null value of a dimension is "other"; a null or empty text has no tokens and is drawn by the overall
fraction where its cell has none; targets without any tokens are left out and the others scaled up; documents with
equal ids are drawn alike, a null id is drawn by its text; an empty table gives no rows; further columns stay as they are.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rackpulse.llm.tables import free, table, text_of, words_of

OTHER = -1
ROUNDS, CLOSE = 500, 1e-9


@dataclass(frozen=True)
class Target:
    """Wanted share of tokens of each value of a dimension; ``other`` is the share of all values not named."""

    value: Column
    shares: dict[str, float]
    other: float = 0.0

    def index(self) -> Column:
        """Place of the row's value among the names, ``OTHER`` for any other."""
        names = F.array(*[F.lit(x) for x in self.shares])
        return F.coalesce(F.array_position(names, self.value.cast("string")).cast("int") - 1, F.lit(OTHER))

    def weights(self) -> np.ndarray:
        return np.array([*self.shares.values(), self.other], float)


def topic(text: Column) -> Column:
    """The table has no topic; the class of a text's length stands for it."""
    return F.when(F.length(text) < 800, "note").when(F.length(text) < 4000, "article").otherwise("long")


def production_targets(text: str = "text") -> list[Target]:
    """Equal sources, English at two fifths, mostly articles."""
    return [
        Target(F.col("source"), {f"src{i}": 0.0475 for i in range(20)}, 0.05),
        Target(F.col("lang"), {"en": 0.4, "de": 0.2, "fr": 0.2, "es": 0.15}, 0.05),
        Target(topic(text_of(text)), {"note": 0.15, "article": 0.55, "long": 0.3}, 0.0),
    ]


def tokens(text: Column) -> Column:
    return F.size(words_of(text)).cast("long")


def rake(have: np.ndarray, targets: list[np.ndarray], fraction: float) -> np.ndarray:
    """Tokens to keep of each cell so that the marginals meet the targets, at most those there are.

    Where the targets cannot all be met within the cells' tokens, the result is what the last round gives.
    """
    total, kept = have.sum(), have * fraction
    if not total:
        return kept
    wanted = []
    for axis, shares in enumerate(targets):
        there = have.sum(tuple(a for a in range(have.ndim) if a != axis)) > 0
        shares = np.where(there, shares, 0.0)
        wanted.append(shares / shares.sum() * fraction * total if shares.sum() else have.sum(tuple(a for a in range(have.ndim) if a != axis)) * fraction)
    for _ in range(ROUNDS):
        before = kept.copy()
        for axis, want in enumerate(wanted):
            now = kept.sum(tuple(a for a in range(have.ndim) if a != axis))
            factor = np.divide(want, now, out=np.zeros_like(want), where=now > 0)
            kept = np.minimum(kept * factor.reshape([-1 if a == axis else 1 for a in range(have.ndim)]), have)
        if np.abs(kept - before).max() <= CLOSE * total:
            break
    return kept


def probabilities(docs: DataFrame, targets: list[Target], fraction: float, text: str = "text") -> np.ndarray:
    """Probability of every cell; the last place of each dimension is "other"."""
    names = [f"d{i}" for i in range(len(targets))]
    cells = docs.select(*[t.index().alias(n) for t, n in zip(targets, names)], tokens(text_of(text)).alias("tokens"))
    have = np.zeros([len(t.shares) + 1 for t in targets])
    for row in cells.groupBy(*names).agg(F.sum("tokens").alias("tokens")).collect():  # one row for each cell
        have[tuple(row[n] for n in names)] = row["tokens"]
    kept = rake(have, [t.weights() for t in targets], fraction)
    return np.divide(kept, have, out=np.full_like(have, fraction), where=have > 0)


def drawn(docs: DataFrame, targets: list[Target], fraction: float = 0.5, seed: int = 5, text: str = "text", probability: str = "probability", sampled: str = "sampled") -> DataFrame:
    """The documents with their probability and whether they are in the sample."""
    chance = probabilities(docs, targets, fraction, text)
    flat = F.array(*[F.lit(float(x)) for x in chance.ravel()])
    place = F.lit(0)
    for target, size in zip(targets, chance.shape):
        place = place * size + F.pmod(target.index(), F.lit(size))
    uniform = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), text_of(text)))), 11).cast("double") / float(1 << 53)
    out = docs.withColumn(probability, F.get(flat, place))
    return out.withColumn(sampled, uniform < F.col(probability))


def sample(docs: DataFrame, targets: list[Target], fraction: float = 0.5, seed: int = 5, text: str = "text") -> DataFrame:
    """The sampled documents, with their own columns only."""
    probability, sampled = free(docs, "probability", "sampled")
    return drawn(docs, targets, fraction, seed, text, probability, sampled).filter(F.col(sampled)).drop(probability, sampled)


def query(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang", "source")
    return drawn(docs, production_targets()).select("doc_id", "probability", "sampled")


QUERIES = {"op5_mixing": (query, None)}
