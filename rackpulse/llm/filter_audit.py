"""Audit of how filters interact: what every filter removes in every order, alone, and on average over all orders.

Five filters look at whole texts: too few words (A), too few different words (B), too many capitals (C), a symbol of markup or code (D),
a text that a document of a smaller id has too (E). The first four are read off the text, the last one needs all texts.

Equal texts are found by compressed tries. Texts are dealt to ranges of their prefixes, and a prefix that holds more text than a
task should see is extended until it does not, so ranges adapt to where texts differ. Each task inserts whole texts into a
radix trie whose terminals hold the least id, then walks it and tells the texts that another document has earlier.
Copies collapse before anything is shuffled: a task tells a text once (again only when it meets a smaller id), and documents refer
to the told text by its number, so a text that a third of all rows share is neither one task's nor sent with each row.

A document is then a mask of the filters it fails; masks are counted by part with the labels, at most 32 rows a part, and the counts
of all orders are sums over masks.

Defined results: a null text is empty: it fails A, and E if another document is empty; a null source is the part named by the empty
string; rows without an id count as documents after all ids, and are no smaller one to others; repeated rows are documents
each and none of them is smaller than another; several labels of an id count as the largest of them; an empty table gives no
rows; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import permutations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rackpulse.llm.tables import table, text_of, written

LETTERS = "ABCDE"
COPY = 1 << LETTERS.index("E")
#: Most bytes of different texts that a task puts into a trie, about; there are as many ranges as shuffle partitions at least.
RANGE_BYTES = 16 << 20
#: Characters of the first prefix, and how many times longer the next one is where it holds too much.
PREFIX, LONGER = 32, 4
#: Bytes of texts a task remembers to tell copies; beyond it, it starts anew.
REMEMBERED = 32 << 20

_CAPITALS = bytes(range(65, 91))
_INNER = bytes(range(128, 192))  # bytes of a character behind its first
_SYMBOLS = b"#$%&*|"


@dataclass(frozen=True)
class Limits:
    min_words: int = 50
    min_different_percent: int = 65
    max_capitals_percent: int = 5


def failures(raw: bytes, limits: Limits = Limits()) -> int:
    """Mask of the filters A to D that a text fails. Splitting bytes cuts at ASCII white space only."""
    words = raw.split()
    few = len(words) < limits.min_words
    same = 100 * len(set(words)) < limits.min_different_percent * len(words)
    capitals, points = len(raw) - len(raw.translate(None, _CAPITALS)), len(raw.translate(None, _INNER))
    loud = 100 * capitals > limits.max_capitals_percent * points
    marked = len(raw.translate(None, _SYMBOLS)) < len(raw)
    return few | same << 1 | loud << 2 | marked << 3


def shared(edge: bytes, text: bytes, at: int) -> int:
    """Length of the common prefix of an edge and the text from a place on, by halving."""
    low, high = 0, min(len(edge), len(text) - at)
    while low < high:
        middle = (low + high + 1) // 2
        if edge[low:middle] == text[at + low : at + middle]:
            low = middle
        else:
            high = middle - 1
    return low


class Node:
    """A node of a radix trie: the bytes that lead to it, its children by first byte, and the documents that end here."""

    __slots__ = ("edge", "children", "least", "entries")

    def __init__(self, edge: bytes):
        self.edge, self.children, self.least, self.entries = edge, {}, None, None

    def end(self, entry: int, own: int | None) -> None:
        if self.entries is None:
            self.entries = []
        self.entries.append((entry, own))
        if own is not None and (self.least is None or own < self.least):
            self.least = own


class Trie:
    """Whole texts with the least id of each."""

    def __init__(self):
        self.root = Node(b"")

    def insert(self, text: bytes, entry: int, own: int | None) -> None:
        node, at = self.root, 0
        while at < len(text):
            child = node.children.get(text[at])
            if child is None:
                child = node.children[text[at]] = Node(text[at:])
            elif not text.startswith(child.edge, at):
                size = shared(child.edge, text, at)
                middle = Node(child.edge[:size])
                child.edge = child.edge[size:]
                middle.children[child.edge[0]] = child
                child = node.children[text[at]] = middle
            node = child
            at += len(node.edge)
        node.end(entry, own)

    def later(self) -> Iterator[tuple[int, int]]:
        """Entries whose text another entry has with a smaller id, with the least id."""
        stack = [self.root]
        while stack:
            node = stack.pop()
            stack.extend(node.children.values())
            if node.least is not None:
                for entry, own in node.entries:
                    if own is None or own > node.least:
                        yield entry, node.least


DOCUMENTS = "doc_id long, part string, mask int, entry long, own long, text string"


def marked(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Every document with its mask of A to D and the number of its text (``DOCUMENTS``).

    A text stands in the first row of its entry, with the least id the task had met (``own``); rows that share it hold none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, remembered, size = TaskContext.get().partitionId() << 33, {}, 0
        for batch in batches:
            ids = batch.column(0).to_pylist()
            texts = [x.as_buffer().to_pybytes() for x in batch.column(2).cast(pa.large_binary())]
            least: dict[bytes, int | None] = {}
            for doc, text in zip(ids, texts):
                old = least.setdefault(text, doc)
                if doc is not None and (old is None or doc < old):
                    least[text] = doc
            told, found = set(), {}
            for text, own in least.items():
                known = remembered.get(text)
                if known is None or (own is not None and (known[1] is None or own < known[1])):
                    size += len(text) if known is None else 0
                    known = remembered[text] = number, own, failures(text, limits) if known is None else known[2]
                    told.add(text)
                    number += 1
                found[text] = known
            rows = [found[text] for text in texts]
            first = []
            for text in texts:
                first.append(text in told)
                told.discard(text)
            if size > REMEMBERED:
                remembered, size = {}, 0
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([r[2] for r in rows], pa.int32()), pa.array([r[0] for r in rows], pa.int64()),
                 pa.array([r[1] for r in rows], pa.int64()), pc.if_else(pa.array(first, pa.bool_()), batch.column(2), pa.scalar(None, batch.column(2).type))],
                names=["doc_id", "part", "mask", "entry", "own", "text"],
            )

    part = F.coalesce(F.col("source").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long"), part.alias("part"), text_of().alias("text")).mapInArrow(run, DOCUMENTS)


def prefixed(entries: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Entries with the prefix of their text by which they are dealt (``prefix``).

    The bytes below every prefix are summed over all entries. Texts below one with too many get a longer prefix, unless they
    end there; heavy prefixes are fewer than the ranges.
    """
    length = PREFIX
    out = entries.withColumn("prefix", F.substring("text", 1, length))
    open_ends = out
    while True:
        heavy = open_ends.filter(F.length("text") > length).groupBy("prefix").agg(F.sum(F.octet_length("text")).alias("bytes"))
        heavy = written(heavy.filter(F.col("bytes") > range_bytes).select("prefix", F.lit(True).alias("heavy")), "heavy-prefixes")
        if heavy.isEmpty():
            return out
        length *= LONGER
        out = out.join(heavy, "prefix", "left").withColumn(
            "prefix", F.when(F.col("heavy"), F.substring("text", 1, length)).otherwise(F.col("prefix"))
        ).drop("heavy")
        open_ends = out.filter(F.length("prefix") == length)


def copies(entries: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Entries whose text has a smaller id elsewhere, with the least one (``entry``, ``least``). Reads ``entry``, ``own``, ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie()
        for batch in batches:
            for entry, own, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.large_binary())):
                trie.insert(text.as_buffer().to_pybytes(), entry, own)
        told = list(trie.later())
        yield pa.RecordBatch.from_arrays([pa.array([t[k] for t in told], pa.int64()) for k in (0, 1)], names=["entry", "least"])

    total = entries.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(1 + int(total // range_bytes), int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = prefixed(entries.select("entry", "own", "text"), 1 + int(total // ranges)).repartitionByRange(ranges, "prefix")
    return dealt.select("entry", "own", "text").mapInArrow(run, "entry long, least long")


def masks(docs: DataFrame, limits: Limits = Limits(), range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The filters every document fails (``doc_id``, ``part``, ``mask``: bit 0 for A to bit 4 for E)."""
    made = written(marked(docs, limits), "audit-documents")
    least = written(copies(made.filter(F.col("text").isNotNull()), range_bytes), "audit-copies")
    rows = made.select("doc_id", "part", "mask", "entry", "own").join(least, "entry", "left")
    first = F.coalesce("least", "own")
    late = F.coalesce(F.col("doc_id") > first, first.isNotNull())
    return rows.select("doc_id", "part", F.when(late, F.col("mask").bitwiseOR(COPY)).otherwise(F.col("mask")).alias("mask"))


def counted(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents, good ones and toxic ones by part and mask. Equal rows are summed before labels are joined."""
    known = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max((F.col("quality") == 1).cast("long")).alias("good"), F.max((F.col("toxic") == 1).cast("long")).alias("toxic")
    )
    alike = rows.groupBy("doc_id", "part", "mask").agg(F.count("*").alias("n")).join(known, "doc_id", "left")
    total = lambda c: F.sum(F.col("n") * F.coalesce(c, F.lit(0)))
    return alike.groupBy("part", "mask").agg(F.sum("n").alias("n"), total("good").alias("good"), total("toxic").alias("toxic"))


def audited(counts: DataFrame) -> DataFrame:
    """What each step of each order keeps and removes in each part."""
    orders = F.array(*[F.lit("".join(o)) for o in permutations(LETTERS)])
    steps = counts.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(LETTERS)))))
    fails = [F.col("mask").bitwiseAND(1 << k) > 0 for k in range(len(LETTERS))]
    first = F.least(*[F.when(f, F.instr("filter_order", c)).otherwise(len(LETTERS) + 1) for f, c in zip(fails, LETTERS)])
    letter = F.expr("substring(filter_order, step, 1)")
    own = F.coalesce(*[F.when(letter == c, f) for f, c in zip(fails, LETTERS)])
    failed = F.bit_count("mask")
    steps = steps.withColumns({"first": first, "own": own, "failed": failed})
    here = F.col("first") == F.col("step")
    orders_each = F.lit(len(list(permutations(LETTERS)))).cast("long")
    total = lambda when, value="n": F.coalesce(F.sum(F.when(when, F.col(value))), F.lit(0)).cast("long")
    return steps.groupBy("part", "filter_order", "step").agg(
        total(F.col("first") > F.col("step")).alias("kept"), total(here).alias("removed"), total(F.col("own") & (F.col("first") < F.col("step"))).alias("redundant"),
        total(F.col("own") & (F.col("failed") == 1)).alias("unique_fails"), total(here, "good").alias("good_lost"), total(here, "toxic").alias("toxic_lost"),
        # Of the orders, a document that fails m filters leaves by each of them in one of m.
        F.coalesce(F.sum(F.when(F.col("own"), F.expr("n") * F.floor(orders_each / F.col("failed")))), F.lit(0)).cast("long").alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, limits: Limits = Limits(), range_bytes: int = RANGE_BYTES) -> DataFrame:
    return audited(written(counted(masks(docs, limits, range_bytes), labels), "audit-counts"))


def query(spark: SparkSession, folder: str) -> DataFrame:
    return audit(table(spark, folder, "documents"), table(spark, folder, "labels"))


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY t) AS least FROM d),
f AS (SELECT doc_id, part, CASE WHEN len(words) < 50 THEN 1 ELSE 0 END AS a,
    CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 1 ELSE 0 END AS b,
    CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 5 * length(t) THEN 1 ELSE 0 END AS c,
    CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 1 ELSE 0 END AS d,
    CASE WHEN least IS NOT NULL AND (doc_id IS NULL OR doc_id > least) THEN 1 ELSE 0 END AS e FROM w),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY 1),
m AS (SELECT part, a, b, c, d, e, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic
  FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT p.x || q.x || r.x || s.x || u.x AS filter_order FROM x p, x q, x r, x s, x u
  WHERE p.x <> q.x AND p.x <> r.x AND p.x <> s.x AND p.x <> u.x AND q.x <> r.x AND q.x <> s.x AND q.x <> u.x AND r.x <> s.x AND r.x <> u.x AND s.x <> u.x),
g AS (SELECT part, filter_order, step, n, good, toxic, a + b + c + d + e AS failed,
    least(CASE WHEN a = 1 THEN instr(filter_order, 'A') ELSE 6 END, CASE WHEN b = 1 THEN instr(filter_order, 'B') ELSE 6 END,
      CASE WHEN c = 1 THEN instr(filter_order, 'C') ELSE 6 END, CASE WHEN d = 1 THEN instr(filter_order, 'D') ELSE 6 END,
      CASE WHEN e = 1 THEN instr(filter_order, 'E') ELSE 6 END) AS first,
    CASE substr(filter_order, step, 1) WHEN 'A' THEN a WHEN 'B' THEN b WHEN 'C' THEN c WHEN 'D' THEN d ELSE e END AS own
  FROM m, o, (SELECT unnest([1, 2, 3, 4, 5]) AS step) s)
SELECT part, filter_order, step, CAST(coalesce(sum(n) FILTER (first > step), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (first = step), 0) AS BIGINT) AS removed,
  CAST(coalesce(sum(n) FILTER (own = 1 AND first < step), 0) AS BIGINT) AS redundant,
  CAST(coalesce(sum(n) FILTER (own = 1 AND failed = 1), 0) AS BIGINT) AS unique_fails,
  CAST(coalesce(sum(good) FILTER (first = step), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(toxic) FILTER (first = step), 0) AS BIGINT) AS toxic_lost,
  CAST(coalesce(sum(n * (120 // greatest(failed, 1))) FILTER (own = 1), 0) AS BIGINT) AS shapley
FROM g GROUP BY 1, 2, 3"""

QUERIES = {"op11_filter_audit": (query, SQL)}
