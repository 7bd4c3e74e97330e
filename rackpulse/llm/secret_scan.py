"""Secret scan with corpus-wide ownership frequency.

Candidates are found in every text by pattern. Each candidate's value is hashed, and its hash is counted over the
corpus by distinct repositories and distinct owners. A value that several owners carry, or one owner in
``COPIED_REPOSITORIES`` repositories or more, is a copied example (a tutorial key, a licence hash); a value of one
owner in fewer repositories looks live. Base kinds are always reported, with that
verdict beside them; the wider kinds, which alone would be mostly noise, are reported only where they look live.

Positions are code points, end exclusive. A kind's spans are leftmost and do not overlap each other. Spark's
pattern functions give matches without positions; the texts between the matches give them: both alternate.

Texts are scanned whole, however long; the work grows little more than with the matches of a text.

Defined results: a null or empty text has no span; a null owner or repository counts as one owner or repository
of its own; a repeated row is a row of its own in the result and adds nothing to distinct counts; an empty table
gives an empty result; further columns are not read. The texts never leave the scan: only spans with hashes,
owners and repositories are shuffled, the owners of a value are counted by partial aggregation, so a value in a
third of all rows costs its distinct owners, not its rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rackpulse.llm.tables import table, text_of, written


@dataclass(frozen=True)
class Kind:
    """A kind of candidate: its pattern, the group that holds the value, the least length of the value, a cheap
    test that texts with a match must pass, and whether it is reported whatever its ownership."""

    name: str
    pattern: str
    group: int
    least: int
    hint: str | None
    base: bool


# The kinds and patterns asked for.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE_KINDS = (
    Kind("assign", ASSIGN, 2, 6, r"(?i)passw|secret|token|api_?key", True),
    Kind("access", r"(AKIA[A-Z0-9]+)", 1, 20, "AKIA", True),
    Kind("hex", r"(?<![0-9a-f])([0-9a-f]{24,}+)", 1, 24, None, True),
)
#: A run of 32 and more with a digit, a capital and a small letter.
MIXED = r"(?<![A-Za-z0-9+/])((?=[A-Za-z+/]*[0-9])(?=[a-z0-9+/]*[A-Z])(?=[A-Z0-9+/]*[a-z])[A-Za-z0-9+/]{32,}+={0,2})"
#: Wider kinds: key blocks, prefixed service tokens, signed web tokens, long mixed runs.
WIDE_KINDS = (
    Kind("block", r"(-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]*)", 1, 40, "PRIVATE KEY", False),
    Kind("prefixed", r"((?:ghp_|gho_|glpat-|xox[abp]-|sk_live_|sk-)[A-Za-z0-9_-]+)", 1, 20, "gh[po]_|glpat-|xox[abp]-|sk[_-]", False),
    Kind("signed", r"(eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+)", 1, 30, "eyJ", False),
    Kind("mixed", MIXED, 1, 32, None, False),
)
#: A value that this many owners or more carry is a copied example.
COPIED_OWNERS = 2
#: So is one in this many repositories or more, whoever owns them; a live key is used in a few places.
COPIED_REPOSITORIES = 5


def _has(text: Column, hint: str) -> Column:
    return F.contains(text, F.lit(hint)) if hint.replace(" ", "").isalnum() else text.rlike(hint)


_SPANS = "array<struct<start:int,rank:int,end:int,value:string>>"


def _placed(rows: Column, rank: int) -> Column:
    """Spans from the gaps before the matches, by a running sum.

    An array that grows in a fold is copied at each step, so matches are folded in blocks of about the root of their number: first
    the lengths of the blocks give each its start, then every block is folded on its own.
    """
    size = F.size(rows)
    block = F.ceil(F.sqrt(size.cast("double"))).cast("int")

    def whole(b: Column) -> Column:
        lengths = F.transform(b["blocks"], lambda part: F.aggregate(part, F.lit(0), lambda n, r: n + r["gap"] + F.length(r["whole"])))
        none = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        starts = F.aggregate(
            lengths, none, lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"]
        )
        return F.flatten(F.zip_with(b["blocks"], starts, fold))

    def fold(part: Column, at: Column) -> Column:
        step = f"struct<at:int,out:{_SPANS}>"

        def add(acc: Column, r: Column) -> Column:
            begin = acc["at"] + r["gap"]
            end = begin + F.length(r["whole"])
            span = F.struct(begin.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), r["value"].alias("value"))
            return F.struct(end.alias("at"), F.concat(acc["out"], F.array(span)).alias("out")).cast(step)

        return F.aggregate(part, F.struct(at.alias("at"), F.array().cast(_SPANS).alias("out")).cast(step), add, lambda acc: acc["out"])

    blocks = F.transform(F.sequence(F.lit(0), size - 1, block), lambda i: F.slice(rows, i + 1, block))
    return F.when(size == 0, F.array().cast(_SPANS)).otherwise(F.transform(F.array(F.struct(blocks.alias("blocks"))), whole)[0])


def _found(text: Column, kind: Kind, rank: int) -> Column:
    """Spans of one kind as an array of (start, rank, end, value), in order."""
    def build(t: Column) -> Column:
        whole, value = F.regexp_extract_all(t, F.lit(kind.pattern), F.lit(0)), F.regexp_extract_all(t, F.lit(kind.pattern), F.lit(kind.group))
        gaps = F.transform(F.split(t, kind.pattern, -1), lambda x: F.length(x))
        rows = F.arrays_zip(gaps.alias("gap"), whole.alias("whole"), value.alias("value"))
        # The text after the last match has no match beside it.
        rows = F.filter(rows, lambda r: r["whole"].isNotNull())
        spans = F.transform(F.array(F.struct(rows.alias("rows"))), lambda v: _placed(v["rows"], rank))[0]
        return F.filter(spans, lambda s: F.length(s["value"]) >= kind.least)

    none = F.array().cast(_SPANS)
    test = text.rlike(kind.pattern) if kind.hint is None else _has(text, kind.hint)
    return F.when(test, build(text)).otherwise(none)


def candidates(df: DataFrame, text: str, keep: list[str], kinds: tuple[Kind, ...] = BASE_KINDS + WIDE_KINDS) -> DataFrame:
    """Every row with ``spans``: an array of (start, rank, end, value_hash), by start, then kind as listed."""
    value = text_of(text)
    found = F.concat(*[_found(F.col("scanned"), kind, i) for i, kind in enumerate(kinds)])
    hashed = F.transform(
        F.array_sort(found), lambda s: F.struct(s["start"], s["rank"], s["end"], F.md5(s["value"].cast("binary")).alias("value_hash"))
    )
    return df.select(*keep, value.alias("scanned")).select(*keep, hashed.alias("spans"))


def ownership(found: DataFrame, repository: str, owner: str) -> DataFrame:
    """Distinct repositories and owners of each value (``value_hash``, ``repositories``, ``owners``)."""
    uses = found.select(F.explode("spans").alias("s"), F.col(repository).cast("string").alias("r"), F.col(owner).cast("string").alias("o"))
    none = F.lit("\0")  # a missing repository or owner counts as one
    uses = uses.select(F.col("s")["value_hash"].alias("value_hash"), F.coalesce("r", none).alias("r"), F.coalesce("o", none).alias("o"))
    # Two levels of aggregation: a value's rows shrink to its distinct pairs before they meet.
    pairs = uses.groupBy("value_hash", "r", "o").agg(F.lit(1).alias("one"))
    repositories = pairs.groupBy("value_hash", "r").agg(F.lit(1).alias("one")).groupBy("value_hash").agg(F.count("*").alias("repositories"))
    owners = pairs.groupBy("value_hash", "o").agg(F.lit(1).alias("one")).groupBy("value_hash").agg(F.count("*").alias("owners"))
    return repositories.join(owners, "value_hash")


def scanned(
    df: DataFrame, text: str = "text", key: str = "doc_id", repository: str = "doc_id", owner: str = "source",
    kinds: tuple[Kind, ...] = BASE_KINDS + WIDE_KINDS, copied_owners: int = COPIED_OWNERS, copied_repositories: int = COPIED_REPOSITORIES,
) -> DataFrame:
    """Every row's reported spans: ``key`` and ``spans``, an array of (start, rank, end, value_hash, owners, repositories, live).

    ``rank`` is the kind's place in ``kinds``. Base kinds are all there; wider kinds only where they look live.
    The scan runs once: its spans, without any text, are written and read by the steps behind it.
    """
    rows = df.select(F.col(key).alias("k"), F.col(repository).alias("r"), F.col(owner).alias("o"), F.col(text).alias("t"))
    found = candidates(rows, "t", ["k", "r", "o"], kinds).withColumn("row_key", F.monotonically_increasing_id())
    found = written(found, "secret-candidates")
    some = found.filter(F.size("spans") > 0)
    counts = ownership(some, "r", "o")
    uses = some.select("row_key", F.explode("spans").alias("s")).select("row_key", "s.*")
    base = F.col("rank").isin([i for i, kind in enumerate(kinds) if kind.base])
    live = (F.col("owners") < copied_owners) & (F.col("repositories") < copied_repositories)
    judged = uses.join(counts, "value_hash").withColumn("live", live).filter(base | F.col("live"))
    told = judged.groupBy("row_key").agg(F.sort_array(F.collect_list(F.struct("start", "rank", "end", "value_hash", "owners", "repositories", "live"))).alias("told"))
    silent = F.array().cast(told.schema["told"].dataType)
    return found.join(told, "row_key", "left").select(F.col("k").alias(key), F.coalesce("told", silent).alias("spans"))


def query(spark: SparkSession, folder: str) -> DataFrame:
    """Counts and digests of every document's spans; ``repositories`` has each value's number of documents, ``n_live`` counts live values."""
    kinds = BASE_KINDS + WIDE_KINDS
    out = scanned(table(spark, folder, "documents"), kinds=kinds)
    names = F.array(*[F.lit(kind.name) for kind in kinds])

    def told(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["rank"]], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def of_rank(rank: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["rank"] == rank)).cast("long")

    base = F.filter("spans", lambda s: s["rank"] < len(BASE_KINDS))
    return out.select(
        "doc_id", *[of_rank(i).alias(f"n_{kind.name}") for i, kind in enumerate(BASE_KINDS)],
        F.sha2(told(base), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: s["live"])).cast("long").alias("n_live"),
        F.array_join(F.transform("spans", lambda s: s["repositories"].cast("string")), ",").alias("repositories"),
    )


QUERIES = {"op3_secret_scan": (query, None)}
