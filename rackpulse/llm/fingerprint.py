"""Document fingerprints: a homomorphic hash of the multiset of paragraphs.

A paragraph (a line of the text) hashes to a wide vector; a document's fingerprint is the sum of its paragraphs'
vectors, each lane modulo a power of two. The order of the paragraphs does not matter, and a paragraph is put in or
taken out by adding or subtracting its vector. ``WIDE`` lanes modulo 2^48 decide equality. ``SIGNS`` lanes modulo 2^16
sum +1 or -1 for each paragraph: the mean square of the difference of two such vectors estimates how many paragraphs
differ, which gives the likeness of two documents from their fingerprints alone.

Defined results: a null text is empty; an empty text has one empty paragraph; an id given more than once counts once,
with its longest text (of equal length: the first in order); rows without an id have no place in the order and are
left out; one document alone is followed by itself; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rackpulse.llm.tables import table, text_of, written

WIDE, SIGNS = 16, 64
_WIDE_MASK, _SIGN_MODULUS = (1 << 48) - 1, 1 << 16
TYPE = "struct<wide:array<bigint>,signs:array<int>,paragraphs:bigint>"


def _with(value: Column, body) -> Column:
    """``body(value)``, the value computed once."""
    return F.transform(F.array(value), body)[0]


def _low(value: Column) -> Column:
    """The remainder modulo 2^16."""
    return value.bitwiseAND(F.lit(_SIGN_MODULUS - 1))


def fingerprint(text: Column) -> Column:
    """Fingerprint of a text that is not null."""
    hashed = F.transform(F.split(text, "\n", -1), lambda p: F.struct(F.xxhash64(p).alias("a"), F.xxhash64(p, F.lit(1)).alias("b")))

    def summed(h: Column) -> Column:
        def wide(i: Column) -> Column:
            step = lambda acc, x: (acc + F.xxhash64(x["a"], x["b"], i).bitwiseAND(F.lit(_WIDE_MASK))).bitwiseAND(F.lit(_WIDE_MASK))
            return F.aggregate(h, F.lit(0).cast("long"), step)

        def sign(i: Column) -> Column:
            ones = F.aggregate(h, F.lit(0), lambda acc, x: acc + F.getbit(x["b"], i).cast("int"))
            return _low(F.size(h) - ones * 2)

        return F.struct(
            F.transform(F.sequence(F.lit(0), F.lit(WIDE - 1)), wide).alias("wide"),
            F.transform(F.sequence(F.lit(0), F.lit(SIGNS - 1)), sign).alias("signs"), F.size(h).cast("long").alias("paragraphs"),
        )

    return _with(hashed, summed)


def _joined(a: Column, b: Column, sign: int) -> Column:
    return F.struct(
        F.zip_with(a["wide"], b["wide"], lambda x, y: (x + y * sign).bitwiseAND(F.lit(_WIDE_MASK))).alias("wide"),
        F.zip_with(a["signs"], b["signs"], lambda x, y: _low(x + y * sign)).alias("signs"),
        (a["paragraphs"] + b["paragraphs"] * sign).alias("paragraphs"),
    )


def inserted(a: Column, b: Column) -> Column:
    """Fingerprint of the paragraphs of both."""
    return _joined(a, b, 1)


def deleted(a: Column, b: Column) -> Column:
    """Fingerprint of the first without the paragraphs of the second, which it must have."""
    return _joined(a, b, -1)


def likeness(a: Column, b: Column) -> Column:
    """1 for equal fingerprints, else the estimated share of common paragraphs (below 1, at least 0)."""
    def apart(x: Column, y: Column) -> Column:
        return _with(_low(x - y), lambda d: F.when(d >= _SIGN_MODULUS // 2, d - _SIGN_MODULUS).otherwise(d).cast("double"))

    differ = F.aggregate(F.zip_with(a["signs"], b["signs"], apart), F.lit(0.0), lambda acc, d: acc + d * d) / SIGNS
    total = a["paragraphs"] + b["paragraphs"]
    share = F.lit(1.0) - differ / total
    return F.when((a["wide"] == b["wide"]) & (a["paragraphs"] == b["paragraphs"]), F.lit(1.0)).otherwise(
        F.greatest(F.lit(0.0), F.least(share, F.lit(1.0) - F.lit(1.0) / total))
    )


def written_out(f: Column) -> Column:
    """A fingerprint as text: paragraphs, wide lanes and sign lanes in hexadecimal."""
    wide = F.array_join(F.transform(f["wide"], lambda x: F.lpad(F.lower(F.hex(x)), 12, "0")), "")
    signs = F.array_join(F.transform(f["signs"], lambda x: F.lpad(F.lower(F.hex(x)), 4, "0")), "")
    return F.concat_ws("-", F.lower(F.hex(f["paragraphs"])), wide, signs)


def predecessors(sizes: DataFrame) -> DataFrame:
    """For every id its predecessor in ascending order and that one's size (``id``, ``size`` to ``id``, ``before``, ``before_size``).

    The first id gets the last one. Ids are dealt by range; only the last id of each range, one row for each
    partition, is looked at together.
    """
    dealt = written(sizes.repartitionByRange("id").withColumn("part", F.spark_partition_id()), "ordered-ids")
    own = Window.partitionBy("part").orderBy("id")
    inner = dealt.select("id", "part", F.lag("id").over(own).alias("before"), F.lag("size").over(own).alias("before_size"))
    last = dealt.groupBy("part").agg(F.max(F.struct("id", "size")).alias("last"))
    every = Window.orderBy("part")  # one row for each partition
    edge = last.select(
        F.col("part").alias("edge_part"),
        F.coalesce(F.lag("last").over(every), F.last("last").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("edge"),
    )
    return inner.join(F.broadcast(edge), F.col("part") == F.col("edge_part")).select(
        "id", F.coalesce("before", F.col("edge")["id"]).alias("before"), F.coalesce("before_size", F.col("edge")["size"]).alias("before_size")
    )


def unique(docs: DataFrame) -> DataFrame:
    """One row for each id, with its longest text."""
    rows = docs.select("doc_id", text_of().alias("text")).filter(F.col("doc_id").isNotNull())
    choice = Window.partitionBy("doc_id").orderBy(F.length("text").desc(), "text")
    return rows.withColumn("choice", F.row_number().over(choice)).filter(F.col("choice") == 1).drop("choice")


def with_next(docs: DataFrame) -> DataFrame:
    """Every document with its edited text and the fingerprint of the next (``doc_id``, ``text``, ``edited``, ``next_print``).

    Texts are shuffled once, by id; of the next document only the part that replaces the end travels.
    """
    own = unique(docs)
    sizes = docs.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("id")).agg(F.max(F.length(text_of())).alias("size"))
    order = predecessors(sizes)
    heads = own.join(order, F.col("doc_id") == F.col("id")).select(
        F.col("before").alias("reader"), F.expr("left(text, before_size div 2)").alias("head"), fingerprint(F.col("text")).alias("next_print")
    )
    both = own.join(heads, F.col("doc_id") == F.col("reader"))
    kept = F.expr("left(text, length(text) - length(text) div 2)")
    return both.select("doc_id", "text", F.concat(kept, F.col("head")).alias("edited"), "next_print")


def query(spark: SparkSession, folder: str) -> DataFrame:
    rows = with_next(table(spark, folder, "documents")).select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited"), 256).alias("edited_sha256"),
        fingerprint(F.col("text")).alias("own"), fingerprint(F.col("edited")).alias("changed"), "next_print",
    )
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", written_out(F.col("own")).alias("fingerprint"), written_out(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"), likeness(F.col("own"), F.col("next_print")).alias("near_next"),
    )


QUERIES = {"op7_document_fingerprints": (query, None)}
