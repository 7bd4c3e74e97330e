"""N-gram Jaccard join with count-vector R-trees.

A document is the set of its distinct word shingles. Two documents link when their sets' Jaccard similarity reaches
the threshold; the result is every document's connected component. No step compares all documents of a group:

1. Documents with equal sets collapse to one representative.
2. In one global order of shingles, the first fifth of a set and c more must hold c shingles of every set it links
   with (c: a twentieth of the set), so representatives meet only inside buckets of such shingles, and one with
   fewer than c of its leading shingles in shared buckets ends here. Most of a corpus does. The order puts
   shingles that many documents have last.
3. Inside a bucket, shingles are hashed to ``GROUPS`` groups and the counts of the groups are a document's point. An
   R-tree over the points bounds the overlap of a document with a whole subtree by the summed minima of coordinates
   and prunes it; leaves give the pairs that may link.
4. Each representative first meets its home bucket (the largest it is in) together with its set. Survivors are
   verified there, one link for each component met, so thousands of near copies shrink to a tree of links. In the
   buckets that still hold several components, the first document of each is then verified against the first of all, if the two
   share enough of such buckets; this only saves work, and pairs left out come again in the last step.
5. Buckets that still hold more than one component are searched by the R-tree for pairs across components that have not met at
   home. A pair is told narrowly, with the number of shingles the bucket stands for; only pairs told for as many as the
   promise of step 2 asks for are verified against the sets. Buckets with the same members (all shingles of a passage that some documents
   share) are one bucket that counts as many.

Buckets larger than ``BLOCK`` are dealt to blocks, and the search across components runs over all pairs of blocks, so
no pair is lost and no task holds more than two blocks.

Defined results: a null or empty text, or one without words, has no shingle and is a component of itself; fewer words
than a shingle has are one shingle; repeated rows and equal texts are copies; rows that give one id several texts
are one node with the links of all of them; rows without an id are left out of the components, but are documents like
others in ``unique``; an empty table gives no rows; further columns are not read. Sets are compared by 64-bit hashes of their shingles.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rackpulse.llm import textbytes
from rackpulse.llm.components import components
from rackpulse.llm.line_dedup import row_key
from rackpulse.llm.tables import free, table, text_of, written

WORDS, PERCENT = 5, 80
GROUPS = 256
#: A shingle in this share of all documents, and in this many at least, comes last in the order. The list of them is
#: no longer than the mean set divided by the share.
COMMON_SHARE, COMMON_LEAST = 0.0005, 50
HEAD_ROUNDS = 2
#: A set's leading shingles are one in this many more than a single shared shingle would need.
SHARED_PART = 20
BLOCK = 2000
LEAF = 32
SATURATED = 255
#: Bits of the filter for the ids whose sets are wanted; set hashes a task remembers to tell copies.
FILTER_BITS = 1 << 23
REMEMBERED = 1 << 20


def needed(a, b, percent: int = PERCENT):
    """Least overlap at which sets of sizes a and b link."""
    return -(-percent * (a + b) // (100 + percent))


def shared_least(size):
    """Leading shingles that a set of this size shares at least with a set it links with that is no smaller."""
    return 1 + size // SHARED_PART


def group_counts(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Point of each set: how many shingles fall into each group (``SATURATED`` stands for that many or more)."""
    rows = len(at) - 1
    row = np.repeat(np.arange(rows), np.diff(at))
    counts = np.bincount(row * GROUPS + (values % np.uint64(GROUPS)).astype(np.int64), minlength=rows * GROUPS)
    return np.minimum(counts, SATURATED).astype(np.uint8).reshape(rows, GROUPS)


def bound(points: np.ndarray, point: np.ndarray) -> np.ndarray:
    """Most that the set of ``point`` can share with the sets below each of ``points``."""
    out = np.minimum(points, point).sum(-1, dtype=np.int64)
    open_end = point == SATURATED
    if open_end.any():  # a full counter says nothing
        out = np.where(((points == SATURATED) & open_end).any(-1), np.iinfo(np.int64).max, out)
    return out


class RTree:
    """Points of sets with their sizes; nodes hold the largest coordinates and the range of sizes below them."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, percent: int = PERCENT):
        self.percent = percent
        # Packed by size, then along the coordinate that varies most.
        widest = int(np.argmax(points.var(0))) if len(points) > LEAF else 0
        slab = np.argsort(np.argsort(sizes, kind="stable"), kind="stable") // (LEAF * 8)
        self.order = np.lexsort((points[:, widest], slab))
        self.points, self.sizes = points[self.order], sizes[self.order]
        self.levels = []
        high, low_size, high_size = self.points, self.sizes, self.sizes
        while len(high) > LEAF:
            cuts = np.arange(0, len(high), LEAF)
            high = np.maximum.reduceat(high, cuts, axis=0)
            low_size, high_size = np.minimum.reduceat(low_size, cuts), np.maximum.reduceat(high_size, cuts)
            self.levels.append((high, low_size, high_size))

    def search(self, point: np.ndarray, size: int) -> np.ndarray:
        """Places (in the order given) of the sets that may link with the set."""
        # Each level holds one node for LEAF of the level below; the last has LEAF nodes at most.
        live = None
        for high, low_size, high_size in reversed(self.levels):
            live = np.arange(len(high)) if live is None else self._children(live, len(high))
            fits = (100 * high_size[live] >= self.percent * size) & (100 * size >= self.percent * low_size[live])
            live = live[fits]
            least = np.maximum(low_size[live], -(-self.percent * size // 100))
            live = live[bound(high[live], point) >= needed(least, size, self.percent)]
            if not len(live):
                return live
        live = np.arange(len(self.points)) if live is None else self._children(live, len(self.points))
        mine = self.sizes[live]
        live = live[(100 * mine >= self.percent * size) & (100 * size >= self.percent * mine)]
        live = live[bound(self.points[live], point) >= needed(self.sizes[live], size, self.percent)]
        return self.order[live]

    @staticmethod
    def _children(nodes: np.ndarray, count: int) -> np.ndarray:
        below = (nodes[:, None] * LEAF + np.arange(LEAF)).ravel()
        return below[below < count]


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Common values of two ascending arrays without repeats."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    return int((b[np.minimum(at, len(b) - 1)] == a).sum()) if len(b) else 0


def linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    both = overlap(a, b)
    return bool(len(a)) and 100 * both >= percent * (len(a) + len(b) - both)


def _arrow(run: Callable, schema: str):
    """Adds the plumbing between record batches and dictionaries of arrays."""
    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in run(source):
            yield pa.RecordBatch.from_pydict(out) if isinstance(out, dict) else out

    return batches, schema


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Runs of whole groups from sorted rows, with the place of each group (one more at the end)."""
    rest: list[pa.RecordBatch] = []

    def told(rows: pa.Table, last: bool):
        columns = [rows.column(k).to_numpy() for k in keys]
        new = np.zeros(len(rows), bool)
        new[:1] = True
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        at = np.flatnonzero(new)
        return np.append(at, len(rows)) if last else at

    for batch in batches:
        if not batch.num_rows:
            continue
        rest.append(batch)
        first = [rest[0].column(k)[0].as_py() for k in keys]
        if first == [batch.column(k)[batch.num_rows - 1].as_py() for k in keys]:
            continue  # all one group so far
        rows = pa.Table.from_batches(rest).combine_chunks()
        at = told(rows, False)
        yield rows.slice(0, int(at[-1])), at
        rest = rows.slice(int(at[-1])).to_batches()
    if rest:
        rows = pa.Table.from_batches(rest).combine_chunks()
        yield rows, told(rows, True)


def _binary(column: pa.ChunkedArray, kind: type) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), kind) for x in column]


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).filter(F.col("doc_id").isNotNull())


def common_shingles(docs: DataFrame, words: int = WORDS, share: float = COMMON_SHARE) -> np.ndarray:
    """Ascending hashes of shingles that a large share of all documents have.

    Such a shingle reaches the share in some run of documents that a task works on, so each task tells only those that
    reach it in one of its runs; their counts are summed. The list only orders shingles; any order is right.
    """
    def run(batches):
        for batch in batches:
            values = [textbytes.shingle_sets(data, at, words)[0] for _, _, data, at in textbytes.chunks(batch.column(1))]
            values, count = np.unique(np.concatenate([np.zeros(0, np.uint64), *values]), return_counts=True)
            often = count >= max(2, share * batch.num_rows)
            yield {"h": values[often].view(np.int64), "n": count[often]}

    batches, schema = _arrow(run, "h long, n long")
    total = docs.count()
    least = max(COMMON_LEAST, share * total)
    found = docs.mapInArrow(batches, schema).groupBy("h").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).select("h").collect()
    return np.sort(np.array([r["h"] for r in found], np.int64).view(np.uint64))


def signatures(docs: DataFrame, common: np.ndarray, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Size, set hash and leading shingles of every document (``doc_id``, ``n``, ``k1``, ``k2``, ``lead``).

    Of equal sets that a task has seen before, ``lead`` is empty: another row of the same set has it.
    """
    sent = docs.sparkSession.sparkContext.broadcast(common)  # bounded, see COMMON_SHARE

    def run(batches):
        known, seen = sent.value, set()
        for batch in batches:
            for begin, end, data, at in textbytes.chunks(batch.column(1)):
                values, place = textbytes.shingle_sets(data, at, words)
                size = np.diff(place)
                row = np.repeat(np.arange(len(size)), size)
                late = np.zeros(len(values), bool)
                if len(known):
                    late = known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values
                order = np.lexsort((values, late, row))
                sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)]) for x in (textbytes.mixed(values), textbytes.mixed(~values))]
                k1, k2 = (s[place[1:]] - s[place[:-1]] for s in sums)
                new = np.zeros(len(size), bool)
                for r, key in enumerate(zip(k1.tolist(), k2.tolist())):
                    if key not in seen:
                        new[r] = True
                        seen.add(key)
                if len(seen) > REMEMBERED:
                    seen.clear()
                lead_size = np.where(new & (size > 0), size - -(-percent * size // 100) + shared_least(size), 0)
                take = np.arange(len(values)) - np.repeat(place[:-1], size) < np.repeat(lead_size, size)
                lead = values[order][take].view(np.int64)
                ends = np.concatenate([[0], np.cumsum(lead_size)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(begin, end - begin), pa.array(size.astype(np.int64)), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)),
                     pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(lead))],
                    names=["doc_id", "n", "k1", "k2", "lead"],
                )

    return docs.mapInArrow(run, "doc_id long, n long, k1 long, k2 long, lead array<long>")


def _filter_bit(ids: np.ndarray) -> np.ndarray:
    return (textbytes.mixed(ids.view(np.uint64)) % np.uint64(FILTER_BITS)).astype(np.int64)


def id_filter(ids: DataFrame) -> np.ndarray:
    """A bit for every hash of an id: fixed in size, so it says "perhaps" more often when there are more ids."""
    def run(batches):
        for batch in batches:
            yield {"bit": np.unique(_filter_bit(batch.column(0).to_numpy()))}

    batches, schema = _arrow(run, "bit long")
    out = np.zeros(FILTER_BITS // 8, np.uint8)
    bits = np.array([r["bit"] for r in ids.mapInArrow(batches, schema).distinct().toLocalIterator()], np.int64)
    np.bitwise_or.at(out, bits >> 3, np.left_shift(1, bits & 7).astype(np.uint8))
    return out


def sets(docs: DataFrame, wanted: DataFrame, words: int = WORDS) -> DataFrame:
    """Sets of the wanted documents, and perhaps of a few others, as ascending hashes (``rep``, ``items``).

    The texts are read again where they lie; only sets travel.
    """
    sent = docs.sparkSession.sparkContext.broadcast(id_filter(wanted))  # FILTER_BITS bits

    def run(batches):
        bits = sent.value
        for batch in batches:
            bit = _filter_bit(batch.column(0).to_numpy())
            batch = batch.filter(pa.array(bits[bit >> 3] >> (bit & 7) & 1 == 1))
            for begin, end, data, at in textbytes.chunks(batch.column(1)):
                values, place = textbytes.shingle_sets(data, at, words)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(begin, end - begin), textbytes.binaries(values, place)], names=["rep", "items"]
                )

    return docs.mapInArrow(run, "rep long, items binary")


def _merge_home(batches, percent: int):
    """Links that join the documents of each home block: one for each component a document meets."""
    for rows, at in groups(batches, ["h", "block"]):
        left, right = [], []
        for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
            if b - a < 2:
                continue
            part = rows.slice(a, b - a)
            name = part.column("rep").to_numpy()
            items = _binary(part.column("items"), np.uint64)
            size = np.array([len(x) for x in items])
            points = group_counts(np.concatenate(items), np.concatenate([[0], np.cumsum(size)]))
            tree, root = RTree(points, size, percent), list(range(b - a))

            def top(i: int) -> int:
                while root[i] != i:
                    root[i] = root[root[i]]
                    i = root[i]
                return i

            for i in range(b - a):
                near = tree.search(points[i], int(size[i]))
                near = near[near < i]
                near = near[np.argsort(-bound(points[near], points[i]), kind="stable")]
                for j in near.tolist():
                    if top(i) != top(j) and linked(items[i], items[j], percent):
                        root[max(top(i), top(j))] = min(top(i), top(j))
                        left.append(name[i])
                        right.append(name[j])
        yield {"a": pa.array(left, pa.int64()), "b": pa.array(right, pa.int64())}


def _across(batches, percent: int):
    """Pairs of different components of each bucket (or pair of blocks) that may link and have not met at home.

    Each comes with the number of shingles of the bucket (``shared``) and the size of its smaller set (``small``).
    """
    for rows, at in groups(batches, ["h", "lower", "upper"]):
        name, comp = rows.column("rep").to_numpy(), rows.column("comp").to_numpy()
        weight, home = rows.column("weight").to_numpy(), np.stack([rows.column(c).to_numpy() for c in ("home", "home_block")])
        size, block = rows.column("n").to_numpy(), rows.column("block").to_numpy()
        lower, upper = rows.column("lower").to_numpy(), rows.column("upper").to_numpy()
        points = np.frombuffer(b"".join(x.as_buffer().to_pybytes() for x in rows.column("point")), np.uint8).reshape(-1, GROUPS)
        count = np.diff(at)
        pairs = [np.zeros((0, 2), np.int64)]
        # A bucket of one leaf: all its pairs at once, many buckets of one size together.
        for width in np.unique(count[(count > 1) & (count <= 8)]).tolist():
            i, j = np.triu_indices(width, 1)
            begin = at[:-1][count == width][:, None]
            p = np.stack([(begin + i).ravel(), (begin + j).ravel()], 1)
            p = p[comp[p[:, 0]] != comp[p[:, 1]]]
            a, b = size[p[:, 0]], size[p[:, 1]]
            p = p[(100 * a >= percent * b) & (100 * b >= percent * a)]
            x, y = points[p[:, 0]], points[p[:, 1]]
            full = ((x == SATURATED) & (y == SATURATED)).any(1)
            pairs.append(p[full | (np.minimum(x, y).sum(1, dtype=np.int64) >= needed(size[p[:, 0]], size[p[:, 1]], percent))])
        for g in np.flatnonzero(count > 8).tolist():
            a, b = int(at[g]), int(at[g + 1])
            tree = RTree(points[a:b], size[a:b], percent)
            crossed = lower[a] != upper[a]
            for i in range(a, b):
                near = tree.search(points[i], int(size[i])) + a
                near = near[(near < i) & (comp[near] != comp[i])]
                if crossed:  # pairs inside a block belong to the block's own search
                    near = near[block[near] != block[i]]
                if len(near):
                    pairs.append(np.stack([np.full(len(near), i), near], 1))
        p = np.concatenate(pairs)
        p = p[(home[:, p[:, 0]] != home[:, p[:, 1]]).any(0)]
        i, j = p.T
        yield {"a": np.maximum(name[i], name[j]), "b": np.minimum(name[i], name[j]), "shared": weight[i], "small": np.minimum(size[i], size[j])}


def _verify(batches, percent: int):
    for batch in batches:
        left, right = (_binary(pa.chunked_array([batch.column(c)]), np.uint64) for c in ("left_items", "right_items"))
        good = pa.array([linked(x, y, percent) for x, y in zip(left, right)], pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(good), batch.column("b").filter(good)], names=["a", "b"])


def home_links(members: DataFrame, percent: int) -> DataFrame:
    """Links inside home blocks. ``members``: ``h``, ``block``, ``rep``, ``items``."""
    batches, schema = _arrow(lambda source: _merge_home(source, percent), "a long, b long")
    return members.select("h", "block", "rep", "items").repartition("h", "block").sortWithinPartitions("h", "block", "rep").mapInArrow(batches, schema)


def _as_links(roots: DataFrame) -> DataFrame:
    return roots.select(F.col("node").alias("a"), F.col("root").alias("b"))


def _checked(pairs: DataFrame, items: DataFrame, percent: int) -> DataFrame:
    """The pairs (``a``, ``b``) whose sets link."""
    left = items.select(F.col("rep").alias("a"), F.col("items").alias("left_items"))
    right = items.select(F.col("rep").alias("b"), F.col("items").alias("right_items"))
    batches, schema = _arrow(lambda source: _verify(source, percent), "a long, b long")
    return pairs.join(left, "a").join(right, "b").select("a", "b", "left_items", "right_items").mapInArrow(batches, schema)


def _promising(told: DataFrame) -> DataFrame:
    """Pairs told for as many shared leading shingles as sets of their sizes share if they link (see ``shared_least``)."""
    pairs = told.groupBy("a", "b").agg(F.sum("shared").alias("shared"), F.min("small").alias("small"))
    return written(pairs.filter(F.col("shared") >= F.lit(1) + F.floor(F.col("small") / SHARED_PART)).select("a", "b"), "pairs")


def _mixed(entries: DataFrame, roots: DataFrame) -> DataFrame:
    """Entries of the buckets that hold several components, with the component (``comp``)."""
    placed = entries.join(roots.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("root", "rep")).drop("root")
    bucket = Window.partitionBy("h")
    several = placed.withColumn("low", F.min("comp").over(bucket)).withColumn("high", F.max("comp").over(bucket))
    return several.filter(F.col("low") != F.col("high")).drop("low", "high")


def joined(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Every document's set size and component (``doc_id``, ``n_shingles``, ``component_id``)."""
    docs = _keyed(docs)
    made = written(signatures(docs, common_shingles(docs, words), words, percent), "shingles")
    some = made.filter(F.col("n") > 0)
    copies = written(some.groupBy("k1", "k2", "n").agg(F.min("doc_id").alias("rep")), "copies")

    # Buckets of more than one representative, of those that share enough.
    names = some.select("doc_id", "n", "k1", "k2").join(copies, ["k1", "k2", "n"]).select("doc_id", "rep", "n")
    enough = F.lit(1) + F.floor(F.ceil(F.col("n") * percent / 100) / SHARED_PART)
    bucket = Window.partitionBy("h")
    entries = some.select(F.explode("lead").alias("h"), "doc_id").withColumn("members", F.count("*").over(bucket)).filter(F.col("members") > 1)
    entries = entries.select("h", "doc_id").join(names, "doc_id").withColumn("shared", F.count("*").over(Window.partitionBy("doc_id")))
    entries = entries.filter(F.col("shared") >= enough).select("h", "rep", "n").repartition("h").dropDuplicates(["h", "rep"])
    entries = entries.withColumns({
        "members": F.count("*").over(bucket), "s1": F.bit_xor(F.xxhash64("rep")).over(bucket),
        "s2": F.sum(F.pmod(F.xxhash64("rep", F.lit(1)), F.lit(1 << 40))).over(bucket),
    }).filter(F.col("members") > 1)
    entries = entries.withColumn("shared", F.count("*").over(Window.partitionBy("rep"))).filter(F.col("shared") >= enough)
    # Buckets of the same members are one, named by the least of them.
    entries = entries.groupBy("rep", "n", "members", "s1", "s2").agg(F.min("h").alias("h"), F.count("*").alias("weight"))
    entries = written(entries.select("h", "rep", "n", "members", "weight"), "buckets")

    # Home buckets, with the sets.
    items = written(sets(docs, entries.select("rep").distinct(), words), "sets")
    home = entries.groupBy("rep").agg(F.max(F.struct("members", "h")).alias("home")).select("rep", F.col("home")["h"].alias("h"))
    home = home.withColumn("at_home", F.count("*").over(bucket)).filter(F.col("at_home") > 1)
    home = written(home.withColumn("block", F.pmod(F.xxhash64("rep"), F.ceil(F.col("at_home") / BLOCK))).drop("at_home"), "homes")
    links = written(home_links(home.join(items, "rep"), percent), "home-links")
    roots = components(links)
    for _ in range(HEAD_ROUNDS):
        heads = _mixed(entries, roots).groupBy("h", "comp").agg(F.min(F.struct("rep", "n")).alias("x"), F.min("weight").alias("shared"))
        heads = heads.withColumn("y", F.min("x").over(bucket)).filter(F.col("x.rep") != F.col("y.rep"))
        met = heads.select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b"), "shared", F.least("x.n", "y.n").alias("small"))
        found = written(_checked(_promising(met), items, percent), "head-links")
        if found.isEmpty():
            break
        roots = components(_as_links(roots).unionByName(found))

    # Buckets that still hold several components.
    batches, schema = _arrow(_points, "rep long, n long, point binary")
    met = home.select("rep", F.col("h").alias("home"), F.col("block").alias("home_block"))
    # One alone in its home bucket has met nobody: a home of its own stands for that.
    points = items.mapInArrow(batches, schema).join(met, "rep", "left").select(
        "rep", "n", "point", F.coalesce("home", "rep").alias("home"), F.coalesce("home_block", F.lit(-1)).alias("home_block"))
    rest = _mixed(entries, roots).withColumn("blocks", F.ceil(F.col("members") / BLOCK).cast("int"))
    rest = rest.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    rest = rest.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rest = rest.withColumns({"lower": F.least("block", "other"), "upper": F.greatest("block", "other")}).drop("other", "members", "blocks", "n").join(points, "rep")
    batches, schema = _arrow(lambda source: _across(source, percent), "a long, b long, shared long, small long")
    keys = ["h", "lower", "upper"]
    told = rest.select(*keys, "rep", "comp", "block", "weight", "home", "home_block", "n", "point")
    told = told.repartition(*keys).sortWithinPartitions(*keys, "rep").mapInArrow(batches, schema)
    late = written(_checked(_promising(told), items, percent), "late-links")
    if not late.isEmpty():
        roots = components(_as_links(roots).unionByName(late))

    reps = copies.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("k1", "k2", "n", F.coalesce("root", "rep").alias("component_id"))
    with_words = some.select("doc_id", "n", "k1", "k2").join(reps, ["k1", "k2", "n"])
    without = made.filter(F.col("n") == 0).select("doc_id", "n", F.col("doc_id").alias("component_id"))
    found = written(with_words.select("doc_id", "n", "component_id").unionByName(without), "classes")

    # The texts of one id are one node, so what they belong to is one component.
    least = found.groupBy("doc_id").agg(F.min("component_id").alias("b"), F.max("component_id").alias("high")).filter(F.col("b") != F.col("high"))
    shared = written(found.join(least, "doc_id").select(F.col("component_id").alias("a"), "b").distinct(), "id-links")
    if not shared.isEmpty():
        moved = components(shared).withColumnRenamed("node", "component_id")
        found = found.join(moved, "component_id", "left").select("doc_id", "n", F.coalesce("root", "component_id").alias("component_id"))
    return found.withColumnRenamed("n", "n_shingles")


def _points(batches):
    for batch in batches:
        items = _binary(pa.chunked_array([batch.column("items")]), np.uint64)
        size = np.array([len(x) for x in items], np.int64)
        counts = group_counts(np.concatenate([*items, np.zeros(0, np.uint64)]), np.concatenate([[0], np.cumsum(size)]))
        yield pa.RecordBatch.from_arrays(
            [batch.column("rep"), pa.array(size), textbytes.binaries(counts.ravel(), np.arange(len(items) + 1) * GROUPS)], names=["rep", "n", "point"]
        )


def unique(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One document of each component, the one with the least id, with all columns of ``docs``.

    Every row is a document, whether its id is missing, its own or that of others; rows without an id come last and
    equal ids are ordered by their text. Texts without words are copies only where the rows have one id and one text.
    """
    number, = free(docs, "document_number")
    numbered = written(docs.withColumn(number, F.monotonically_increasing_id()), "numbered")
    classes = joined(numbered.select(F.col(number).alias("doc_id"), "text"), words, percent).withColumnRenamed("doc_id", "row")
    rows = classes.join(numbered.select(F.col(number).alias("row"), "doc_id", F.col("doc_id").isNull().alias("no_id"), *row_key()), "row")
    group = [F.when(F.col("n_shingles") > 0, F.col("component_id")).alias("g0")]
    group += [F.when(F.col("n_shingles") == 0, F.col(c)).alias(f"g{i}") for i, c in enumerate(("doc_id", "r1", "r2"), 1)]
    kept = rows.groupBy(*group).agg(F.min(F.struct("no_id", "doc_id", "r1", "r2", "row")).alias("first"))
    return numbered.join(kept.select(F.col("first")["row"].alias(number)), number, "left_semi").select(*docs.columns)


def query(spark: SparkSession, folder: str) -> DataFrame:
    return joined(table(spark, folder, "documents"))


QUERIES = {"op8_ngram_jaccard": (query, None)}
