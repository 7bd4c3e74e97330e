"""Line dedup by a segment-partition edit join.

Equal lines are one line. Two lines within ``edits`` edits of each other link, and of each connected class only its
first line (least document, least line number) stays.

A line is split into ``edits`` + 1 even segments. If two lines are within ``edits`` edits, one segment of the shorter
stands untouched in the longer, at a place that the edits left and right of it allow. So every line is indexed by its
segments, and probes the index for each admissible length with the substrings at the admissible places (the
multi-match-aware windows of the segment-partition join). Keys that only one line has end there, which is most. Pairs
that meet are verified by a bit-parallel edit distance on the diagonal band of 2 * ``edits`` + 1 cells, after common
ends are cut off.

A key does not emit all its pairs: first every line meets the least indexed line of its key, which shrinks large
families of variants to few classes; then only pairs across classes are formed, and only those whose letters can
be within reach (counts of eight letter groups). Both joins are plain equi-joins that Spark splits where skewed.

Defined results: a null or empty text has one empty line; lines without a word never count as repeated and stay;
lines shorter than ``min_chars`` link only where they are equal; rows of one id are parts of one document, told apart
by two hashes of their text, and of their lines with one number the one of the lesser hash is first; rows equal in id
and text are one row; rows without an id are told apart and judged like others, with the null id last; an empty table
gives no rows; further columns pass through untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rackpulse.llm.components import components
from rackpulse.llm.tables import SPACE, free, table, text_of, written

EDITS, MIN_CHARS = 2, 32
ID_BUCKETS = 1 << 20
#: Bits of a key that are kept; keys that meet by chance are verified like others.
KEY_BITS = (1 << 48) - 1
#: Characters after which an edit distance that has left its band ends.
PROBED = 16
NULL_ID = (1 << 63) - 1
LETTER_GROUPS = ("aqAQ0", "eihEIH1", "tnTN2", "osOS34", "rdlRDL5", "ucmUCM67", "wfgypWFGYP8", "bvkBVK9")


def windows(edits: int) -> list[tuple[int, int, int, bool]]:
    """What a line looks at: how much shorter the indexed line is, segment, shift of its place, whether it is the index itself.

    Edits left of segment i shift it by at most i, edits right of it by at most ``edits`` - i.
    """
    index = [(0, i, 0, True) for i in range(edits + 1)]
    probes = [
        (shorter, i, shift, False) for shorter in range(edits + 1) for i in range(edits + 1)
        for shift in range(max(-i, shorter - (edits - i)), min(i, shorter + edits - i) + 1) if shorter or shift
    ]
    return index + probes


def keys(lines: DataFrame, edits: int = EDITS) -> DataFrame:
    """Index and probe keys of lines (``id``, ``key``, ``indexed``), from ``id`` and ``line``.

    A line of n characters has ``edits`` + 1 segments of n div (``edits`` + 1), the last ones with one more for the remainder.
    A row for each window keeps the expression small enough for the JVM to compile.
    """
    count = edits + 1
    spec = F.array(*[F.struct(F.lit(a).alias("shorter"), F.lit(b).alias("i"), F.lit(c).alias("shift"), F.lit(d).alias("indexed")) for a, b, c, d in windows(edits)])
    rows = lines.select("id", "line", F.length("line").alias("n"), F.inline(spec)).withColumn("other", F.col("n") - F.col("shorter"))
    rows = rows.withColumn("small", F.expr(f"cast(other div {count} as int)")).withColumn("plain", F.expr(f"{count} - other % {count}"))
    rows = rows.withColumn("at", F.expr("i * small + greatest(0, i - plain) + shift")).withColumn("size", F.expr("small + if(i >= plain, 1, 0)"))
    key = F.expr(f"xxhash64(other, i, substr(line, at + 1, size)) & {KEY_BITS}L").alias("key")
    return rows.filter("at >= 0 and at + size <= n").select("id", key, "indexed")


def _common_ends(a: Column, b: Column, edits: int) -> tuple[Column, Column]:
    """The two lines without their common beginning and end."""
    def shared(x: Column, y: Column, side: str) -> Column:
        steps = F.array(*[F.lit(1 << k) for k in range(16, -1, -1)])
        cut = F.left if side == "left" else F.right
        least = F.least(F.length(x), F.length(y))
        return F.aggregate(
            steps, F.lit(0), lambda n, s: F.when((n + s <= least) & (cut(x, n + s) == cut(y, n + s)), n + s).otherwise(n)
        )

    def rest(x: Column, n: Column) -> Column:
        return F.substr(x, n + 1, F.greatest(F.length(x) - n, F.lit(0)))

    def kept(x: Column, n: Column) -> Column:
        return F.left(x, F.length(x) - n)

    pair = F.struct(a.alias("a"), b.alias("b"))
    front = F.transform(F.array(pair), lambda p: F.struct(p["a"].alias("a"), p["b"].alias("b"), shared(p["a"], p["b"], "left").alias("n")))
    front = F.transform(front, lambda p: F.struct(rest(p["a"], p["n"]).alias("a"), rest(p["b"], p["n"]).alias("b")))
    back = F.transform(front, lambda p: F.struct(p["a"].alias("a"), p["b"].alias("b"), shared(p["a"], p["b"], "right").alias("n")))
    back = F.transform(back, lambda p: F.struct(kept(p["a"], p["n"]).alias("a"), kept(p["b"], p["n"]).alias("b")))
    return back[0]


def within(a: Column, b: Column, edits: int = EDITS) -> Column:
    """Whether two lines are within so many edits, by banded bit-parallel simulation.

    Row d of the state has a bit for each diagonal of the band: set if the prefixes that end there are d edits apart
    or less. A step reads one character of ``b`` and moves all diagonals at once with shifts and masks.
    """
    band = (1 << (2 * edits + 1)) - 1

    def run(pair: Column) -> Column:
        x, y = pair["a"], pair["b"]
        start = F.struct(*[F.lit(((1 << (d + 1)) - 1) << edits).alias(f"r{d}") for d in range(edits + 1)])

        def step(state: Column, j: Column) -> Column:
            letter = F.substr(y, j, F.lit(1))
            match = F.lit(0)
            for t in range(2 * edits + 1):
                place = j + (t - edits)  # from 1, in a
                same = (place >= 1) & (place <= F.length(x)) & (F.substr(x, F.greatest(place, F.lit(1)), F.lit(1)) == letter)
                match = match + F.when(same, 1 << t).otherwise(0)
            rows = F.struct(match.alias("m"), state.alias("s"))

            def moved(v: Column) -> Column:
                new = []
                for d in range(edits + 1):
                    row = v["s"][f"r{d}"].bitwiseAND(v["m"])
                    if d:
                        below = v["s"][f"r{d - 1}"]
                        row = row.bitwiseOR(below).bitwiseOR(F.shiftright(below, 1)).bitwiseOR(F.shiftleft(new[-1], 1))
                    new.append(row.bitwiseAND(F.lit(band)))
                return F.struct(*[c.alias(f"r{d}") for d, c in enumerate(new)])

            return F.transform(F.array(rows), moved)[0]

        end = F.length(x) - F.length(y) + edits
        near = F.abs(F.length(x) - F.length(y)) <= edits
        reached = lambda state: F.getbit(state[f"r{edits}"], F.when(near, end).otherwise(0)) == 1

        def rest(head: Column) -> Column:
            """Lines that are far apart have lost every diagonal after a few characters, and end there."""
            state = head["s"]
            return F.when(state[f"r{edits}"] == 0, False).when(F.length(y) <= PROBED, reached(state)).otherwise(
                reached(F.aggregate(F.sequence(F.lit(PROBED + 1), F.length(y)), state, step))
            )

        head = F.aggregate(F.sequence(F.lit(1), F.least(F.length(y), F.lit(PROBED))), start, step)
        walked = F.transform(F.array(F.struct(head.alias("s"))), rest)[0]
        return F.when(~near, False).when(F.length(y) == 0, F.length(x) <= edits).otherwise(walked)

    return F.transform(F.array(_common_ends(a, b, edits)), run)[0]


def letters(line: Column) -> Column:
    """How often the letters of each group occur; one edit changes the sum of differences by two at most."""
    return F.array(*[F.length(line) - F.length(F.translate(line, group, "")) for group in LETTER_GROUPS])


def _apart(a: Column, b: Column) -> Column:
    return sum((F.abs(a[i] - b[i]) for i in range(len(LETTER_GROUPS))), F.lit(0))


def row_key(text: str = "text") -> list[Column]:
    """What tells the rows of one id, or of none, apart (``r1``, ``r2``)."""
    return [F.xxhash64(F.lit(i), F.col("doc_id").isNull(), text_of(text)).alias(f"r{i}") for i in (1, 2)]


def _place() -> Column:
    return F.struct(F.coalesce("doc_id", F.lit(NULL_ID)).alias("doc_id"), "line_no", "r1", "r2")


def exploded(docs: DataFrame, text: str = "text") -> DataFrame:
    """Lines that hold a word (``doc_id``, ``r1``, ``r2``, ``line_no``, ``line``)."""
    # Keys come before the lines: behind them, the text would be hashed again for each line.
    keyed = docs.select("doc_id", *row_key(text), F.split(text_of(text), "\n", -1).alias("lines"))
    rows = keyed.select("doc_id", "r1", "r2", F.posexplode("lines").alias("line_no", "line"))
    return rows.filter(F.col("line").rlike(f"[^{SPACE}]"))


def _names(line: Column) -> list[Column]:
    return [F.xxhash64(line).alias("k1"), F.xxhash64(F.lit(1), line).alias("k2")]


def distinct_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """Every distinct line with its first place and how often it stands (``k1``, ``k2``, ``line``, ``first``, ``places``)."""
    # Hashes do not compress; they come behind the shuffle.
    found = exploded(docs, text).select("line", _place().alias("place")).groupBy("line").agg(F.min("place").alias("first"), F.count("*").alias("places"))
    return found.select(*_names(F.col("line")), "line", "first", "places")


def _likely(rows: DataFrame, ids: DataFrame, column: str = "id") -> DataFrame:
    """The rows of some ids and a few others, by a broadcast table of at most ``ID_BUCKETS`` hashes of ids: most go where they are read."""
    bucket = F.pmod(F.xxhash64(column), F.lit(ID_BUCKETS))
    return rows.withColumn("id_bucket", bucket).join(F.broadcast(ids.select(bucket.alias("id_bucket")).distinct()), "id_bucket", "left_semi").drop("id_bucket")


def _wanted(lines: DataFrame, ids: DataFrame) -> DataFrame:
    """The lines of some ids."""
    return _likely(lines, ids).join(ids, "id", "left_semi")


def _checked(pairs: DataFrame, lines: DataFrame, edits: int) -> DataFrame:
    """The pairs of line numbers within reach."""
    left = lines.select(F.col("id").alias("a"), F.col("line").alias("left_line"), F.col("letters").alias("left_letters"))
    right = lines.select(F.col("id").alias("b"), F.col("line").alias("right_line"), F.col("letters").alias("right_letters"))
    both = pairs.join(left, "a").join(right, "b").filter(_apart(F.col("left_letters"), F.col("right_letters")) <= 2 * edits)
    return both.filter(within(F.col("left_line"), F.col("right_line"), edits)).select("a", "b")


def classes(docs: DataFrame, text: str = "text", edits: int = EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """Classes of the lines that stand in more than one place or share their class (``k1``, ``k2``, ``first``, ``class_first``).

    ``class_first`` is the first place of the class's first line. Lines that stand once and are like no other are left out.
    """
    found = distinct_lines(docs, text).select("line", "first", "places").withColumn("id", F.monotonically_increasing_id())
    lines = written(found, "lines", compression="zstd")
    long_lines = lines.filter(F.length("line") >= min_chars)
    # Number and kind of an entry travel as one number.
    tagged = keys(long_lines, edits).select("key", (F.shiftleft("id", 1) + F.col("indexed").cast("long")).alias("tag"))
    id_, indexed = F.shiftright("tag", 1), F.col("tag").bitwiseAND(F.lit(1)) == 1
    bucket = Window.partitionBy("key")
    entries = tagged.withColumn("members", F.count("*").over(bucket)).withColumn("head", F.min(F.when(indexed, id_)).over(bucket))
    # Keys without an indexed line, and keys of one line, join nothing.
    entries = entries.filter((F.col("members") > 1) & F.col("head").isNotNull())
    met = written(entries.select("key", id_.alias("id"), indexed.alias("indexed"), "head"), "line-keys")
    known = written(_wanted(lines, met.select("id").distinct()).select("id", "line", letters(F.col("line")).alias("letters")), "met-lines")
    pairs = met.filter(F.col("id") != F.col("head")).select(F.greatest("id", "head").alias("a"), F.least("id", "head").alias("b")).distinct()
    links = _checked(pairs, known, edits)
    roots = components(links)

    placed = met.join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("class", F.coalesce("root", "id"))
    several = placed.groupBy("key").agg(F.min("class").alias("low"), F.max("class").alias("high")).filter(F.col("low") != F.col("high")).select("key")
    rest = placed.join(several, "key", "left_semi").join(known.select("id", "letters", F.length("line").alias("chars")), "id")
    rest = written(rest.select("key", "id", "indexed", "class", "letters", "chars"), "line-classes")
    x, y = rest.filter("indexed").alias("x"), rest.alias("y")
    cross = (
        (F.col("x.key") == F.col("y.key")) & (F.col("x.class") != F.col("y.class")) & (~F.col("y.indexed") | (F.col("x.id") < F.col("y.id")))
        & (_apart(F.col("x.letters"), F.col("y.letters")) <= 2 * edits)
    )
    pairs = x.join(y, cross).select(F.greatest("x.id", "y.id").alias("a"), F.least("x.id", "y.id").alias("b")).distinct()
    late = _checked(pairs, known, edits)
    roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(late))

    named = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct()).withColumnRenamed("node", "id")  # classes of more than one line
    narrow = lines.select(*_names(F.col("line")), "first", "id", "places")
    shared = written(_likely(narrow, named).join(named, "id").withColumnRenamed("root", "class"), "shared-lines")
    least = shared.groupBy("class").agg(F.min("first").alias("class_first"))
    alone = narrow.filter(F.col("places") > 1).join(named.select("id"), "id", "left_anti").withColumn("class_first", F.col("first"))
    return shared.join(least, "class").select("k1", "k2", "first", "class_first").unionByName(alone.select("k1", "k2", "first", "class_first"))


def repeated(docs: DataFrame, text: str = "text", edits: int = EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """Lines to drop (``doc_id``, ``r1``, ``r2``, ``line_no``, ``class_first``): every line that is not the first of its class."""
    rows = exploded(docs, text).select("doc_id", "r1", "r2", "line_no", *_names(F.col("line")))
    found = written(classes(docs, text, edits, min_chars).drop("first"), "shared-classes")
    judged = _likely(rows, found.select("k1"), "k1").join(found, ["k1", "k2"])
    return judged.filter(_place() != F.col("class_first")).select("doc_id", "r1", "r2", "line_no", "class_first")


def _per_document(docs: DataFrame, text: str, edits: int, min_chars: int) -> DataFrame:
    drop = F.struct("line_no", F.col("class_first")["doc_id"].alias("first_doc"), F.col("class_first")["line_no"].alias("first_line"))
    return repeated(docs, text, edits, min_chars).groupBy("doc_id", "r1", "r2").agg(F.sort_array(F.collect_set(drop)).alias("dropped"))


def without(values: Column, places: Column) -> Column:
    """An array without the values at some places; the work is linear in the array, however many go."""
    def kept(p: Column) -> Column:
        left = F.array_except(F.sequence(F.lit(0), F.size(p["values"]) - 1), p["places"])
        return F.transform(left, lambda i: F.get(p["values"], i))

    some = F.transform(F.array(F.struct(values.alias("values"), places.alias("places"))), kept)[0]
    return F.when(F.size(places) == 0, values).otherwise(some)


def deduplicated(docs: DataFrame, text: str = "text", edits: int = EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """The documents without repeated lines; a document that loses every line with a word goes."""
    name, r1, r2, s1, s2, lost = free(docs, "line_doc", "line_r1", "line_r2", "row_r1", "row_r2", "lost_lines")
    gone = _per_document(docs.select("doc_id", F.col(text).alias("text")), "text", edits, min_chars)
    gone = gone.select(F.col("doc_id").alias(name), F.col("r1").alias(r1), F.col("r2").alias(r2), F.transform("dropped", lambda d: d["line_no"]).alias(lost))
    keyed = docs.select("*", *[c.alias(n) for c, n in zip(row_key(text), (s1, s2))])
    both = keyed.join(gone, F.col("doc_id").eqNullSafe(F.col(name)) & (F.col(s1) == F.col(r1)) & (F.col(s2) == F.col(r2)), "left")
    kept = F.array_join(without(F.split(text_of(text), "\n", -1), F.col(lost)), "\n")
    left = both.withColumn(text, F.when(F.col(lost).isNull(), F.col(text)).otherwise(kept))
    return left.filter(F.col(lost).isNull() | F.col(text).rlike(f"[^{SPACE}]")).select(*docs.columns)


def query(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's lines, and those dropped with the first place of their class."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    gone = _per_document(docs, "text", EDITS, MIN_CHARS).withColumnRenamed("doc_id", "line_doc")
    counted = docs.select("doc_id", *row_key(), F.size(F.split(text_of(), "\n", -1)).cast("long").alias("n_lines"))
    same = F.col("x.doc_id").eqNullSafe(F.col("y.line_doc")) & (F.col("x.r1") == F.col("y.r1")) & (F.col("x.r2") == F.col("y.r2"))
    both = counted.alias("x").join(gone.alias("y"), same, "left")
    told = F.transform("dropped", lambda d: F.concat_ws(":", d["line_no"].cast("string"), d["first_doc"].cast("string"), d["first_line"].cast("string")))
    return both.select(
        "doc_id", "n_lines", F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"),
        F.coalesce(F.array_join(told, ","), F.lit("")).alias("dropped"),
    )


QUERIES = {"op2_line_dedup": (query, None)}
