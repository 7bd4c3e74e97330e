"""Quality rules as a short-circuit cascade.

A rule compares parts of a document: its words, its lines, counts over them. The cost of each part is measured on a sample, and so
is which sampled documents each rule rejects. Rules then run in the order of rejection per cost: the next one is the rule that
rejects most of what the rules before it have left, for the cost of the parts that none of them has computed yet. A
document leaves at the first rule that rejects it, and a part is computed once, when the first rule that needs it is reached,
so costly parts see only what cheap rules have let through. The order changes the work, never the verdict.

Defined results: a null or empty text has no words and is rejected for it; every row is judged by itself, so
repeated rows and ties need no rule; an empty table gives an empty table; further columns pass through untouched.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rackpulse.llm.tables import SPACE, free, text_of, words_of, written

SYMBOLS = "#*$%&|<>"
SAMPLE_SEED = 4


@dataclass(frozen=True)
class Thresholds:
    """Limits of the rules; counts are per document."""

    min_words: int = 50
    max_repeat_percent: int = 50
    max_symbols_percent: int = 10
    max_capitals_percent: int = 30
    max_duplicate_lines_percent: int = 40
    min_mean_word: int = 2
    max_mean_word: int = 15


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Column


@dataclass(frozen=True)
class Measured:
    """What the sample says of a rule."""

    name: str
    seconds: float
    rejection: float

    @property
    def gain(self) -> float:
        return self.rejection / max(self.seconds, 1e-6)


def n_words(text: Column) -> Column:
    return F.size(words_of(text)).cast("long")


def word_chars(text: Column) -> Column:
    return F.length(F.array_join(words_of(text), "")).cast("long")


def n_symbols(text: Column) -> Column:
    return (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long")


def worded_lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n", -1), lambda line: line.rlike(f"[^{SPACE}]"))


def n_duplicate_lines(text: Column) -> Column:
    return _bound(worded_lines(text), lambda lines: F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


def n_capitals(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"\P{Lu}+", "")).cast("long")


def _bound(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, also where the body names it often."""
    return F.transform(F.array(value), body)[0]


def n_repeat_words(words: Column) -> Column:
    """Words inside a three-word window that occurs at least twice in the text, the first occurrence included.

    Windows are compared by a 64-bit hash. Most texts repeat none, which one set of the hashes shows; only the
    others pay for the sort that locates the repeated windows.
    """
    def windows(w: Column) -> Column:
        size = F.greatest(F.size(w) - 2, F.lit(0))
        return F.transform(F.arrays_zip(F.slice(w, 1, size), F.slice(w, 2, size), F.slice(w, 3, size)), lambda x: F.xxhash64(x))

    def located(hashes: Column) -> Column:
        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        repeated = _bound(
            placed,
            lambda s: F.filter(
                s, lambda x, j: F.coalesce(F.get(s, j - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, j + 1)["h"] == x["h"], F.lit(False))
            ),
        )
        covered = F.flatten(F.transform(repeated, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))
        return F.size(F.array_distinct(covered))

    return _bound(
        words, lambda w: _bound(windows(w), lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), located(h)).otherwise(F.lit(0)))
    ).cast("long")


def base_failed(words: Column, repeated: Column, limits: Thresholds = Thresholds()) -> Column:
    return (words < limits.min_words) | (repeated * 100 > words * limits.max_repeat_percent)


#: What rules are made of, each from the text or from parts before it.
PARTS: dict[str, tuple[tuple[str, ...], Callable[[dict[str, Column]], Column]]] = {
    "words": ((), lambda p: words_of(p["text"])),
    "n_words": (("words",), lambda p: F.size(p["words"]).cast("long")),
    "word_chars": (("words",), lambda p: F.length(F.array_join(p["words"], "")).cast("long")),
    "n_symbols": ((), lambda p: n_symbols(p["text"])),
    "lines": ((), lambda p: worded_lines(p["text"])),
    "n_lines": (("lines",), lambda p: F.size(p["lines"]).cast("long")),
    "n_dup_lines": (("lines",), lambda p: (F.size(p["lines"]) - F.size(F.array_distinct(p["lines"]))).cast("long")),
    "n_capitals": ((), lambda p: n_capitals(p["text"])),
    "n_repeat_words": (("words",), lambda p: n_repeat_words(p["words"])),
}


@dataclass(frozen=True)
class Step:
    """A rule of the cascade: the parts it compares, and the comparison that is true for a document to reject."""

    name: str
    needs: tuple[str, ...]
    test: Callable[[dict[str, Column]], Column]


def steps(limits: Thresholds = Thresholds()) -> list[Step]:
    """The standard rules."""
    return [
        Step("few_words", ("n_words",), lambda p: p["n_words"] < limits.min_words),
        Step("repeated_windows", ("n_repeat_words", "n_words"), lambda p: p["n_repeat_words"] * 100 > p["n_words"] * limits.max_repeat_percent),
        Step("symbols", ("n_symbols", "n_words"), lambda p: p["n_symbols"] * 100 > p["n_words"] * limits.max_symbols_percent),
        Step("capitals", ("n_capitals", "word_chars"), lambda p: p["n_capitals"] * 100 > p["word_chars"] * limits.max_capitals_percent),
        Step("duplicate_lines", ("n_dup_lines", "n_lines"), lambda p: p["n_dup_lines"] * 100 > p["n_lines"] * limits.max_duplicate_lines_percent),
        Step("word_length", ("word_chars", "n_words"), lambda p: ~p["word_chars"].between(p["n_words"] * limits.min_mean_word, p["n_words"] * limits.max_mean_word)),
    ]


def missing(step: Step, known: set[str]) -> list[str]:
    """Parts a rule still needs, each behind those it rests on."""
    out: list[str] = []

    def add(part: str) -> None:
        if part not in known and part not in out:
            for other in PARTS[part][0]:
                add(other)
            out.append(part)

    for part in step.needs:
        add(part)
    return out


def cascade(plan: list[Step], known: dict[str, Column]) -> Column:
    """Name of the first rule that rejects, null for a document to keep. Later rules and their parts are not evaluated."""
    if not plan:
        return F.lit(None).cast("string")
    wanted = missing(plan[0], set(known))
    if wanted:
        part = wanted[0]
        return _bound(PARTS[part][1](known), lambda v: cascade(plan, {**known, part: v}))
    return F.when(F.coalesce(plan[0].test(known), F.lit(False)), F.lit(plan[0].name)).otherwise(cascade(plan[1:], known))


def rules(text: Column, limits: Thresholds = Thresholds()) -> list[Rule]:
    """The standard rules one by one, over a text column that is never null."""
    return [Rule(s.name, cascade([s], {"text": text}).isNotNull()) for s in steps(limits)]


def measure(df: DataFrame, text: str, checks: list[Rule], sample_rows: int = 400, repeats: int = 4, judged: str = "text") -> list[Measured]:
    """Seconds and rejected share of every rule on the first rows of the table, each in a job of its own.

    The sample (``sample_rows``) only steers the order of the rules. Each job judges every sampled row
    ``repeats`` times, so that the rule outweighs the job around it, whose time alone is taken off. ``judged`` is the
    name of the text in the rules.
    """
    sample = df.withColumn(judged, text_of(text)).limit(sample_rows)
    rows = sample.withColumn("judged_again", F.explode(F.sequence(F.lit(1), F.lit(repeats))))

    def run(condition: Column) -> tuple[float, int, int]:
        began = time.monotonic()
        seen, out = rows.agg(F.count("*"), F.count_if(condition)).first()
        return time.monotonic() - began, seen, out

    run(F.lit(False))
    idle = run(F.lit(False))[0]
    found = []
    for rule in checks:
        seconds, seen, out = run(rule.rejects)
        found.append(Measured(rule.name, max(seconds - idle, 1e-3), out / seen if seen else 0.0))
    return found


def ordered(checks: list[Rule], figures: list[Measured]) -> list[Rule]:
    """The rules by rejection per cost, best first; equal ones by name."""
    gain = {m.name: m.gain for m in figures}
    return sorted(checks, key=lambda r: (-gain[r.name], r.name))


def verdict(checks: list[Rule]) -> Column:
    """Name of the first rule that rejects, null for a document to keep. Later rules are not evaluated."""
    out = F
    for rule in checks:
        out = out.when(F.coalesce(rule.rejects, F.lit(False)), F.lit(rule.name))
    return out.otherwise(F.lit(None).cast("string")) if checks else F.lit(None).cast("string")


def sampled(df: DataFrame, text: str, sample_rows: int) -> DataFrame:
    """A sample of about so many texts (twice as many at most) with all parts, from everywhere in the table.

    Rows are drawn where they are read, nothing is sorted; the sample only steers the order of the rules.
    """
    share = min(1.0, sample_rows / max(df.count(), 1))
    chosen = df.select(text_of(text).alias("text")).sample(share, seed=SAMPLE_SEED).limit(2 * sample_rows)
    for part, (_, value) in PARTS.items():
        chosen = chosen.withColumn(part, value({c: F.col(c) for c in chosen.columns}))
    return written(chosen, "quality-sample")


def planned(checks: list[Step], costs: dict[str, float], rejected: list[set[str]], known: set[str] = frozenset()) -> list[Step]:
    """The rules in the order of rejection per cost, given what the rules before each have rejected and computed; equal ones by name."""
    out, left, known, rows = [], sorted(checks, key=lambda s: s.name), set(known), list(rejected)
    while left:
        def gain(step: Step) -> float:
            share = sum(step.name in r for r in rows) / max(len(rows), 1)
            return share / max(sum(costs.get(p, 0.0) for p in missing(step, known)), 1e-6)

        best = max(left, key=gain)
        out.append(best)
        left.remove(best)
        known |= set(missing(best, known))
        rows = [r for r in rows if best.name not in r]
    return out


def plan_for(df: DataFrame, text: str, checks: list[Step], sample_rows: int, known: set[str] = frozenset()) -> list[Step]:
    """The order for a table: costs of the parts and rejections of the rules, measured on a sample."""
    sample = sampled(df, text, sample_rows)
    parts = {c: F.col(c) for c in ["text", *PARTS]}
    timed = measure(sample, "text", [Rule(p, F.xxhash64(value(parts)) == 0) for p, (_, value) in PARTS.items()], 2 * sample_rows)
    verdicts = sample.select(*[F.coalesce(s.test(parts), F.lit(False)).alias(s.name) for s in checks]).collect()  # twice sample_rows at most
    return planned(checks, {m.name: m.seconds for m in timed}, [{s.name for s in checks if r[s.name]} for r in verdicts], known)


def kept(df: DataFrame, text: str = "text", limits: Thresholds = Thresholds(), sample_rows: int = 400) -> DataFrame:
    """The documents that no rule rejects, with all their columns."""
    (name,) = free(df, "judged_text")
    plan = plan_for(df, text, steps(limits), sample_rows)
    return df.withColumn(name, text_of(text)).filter(cascade(plan, {"text": F.col(name)}).isNull()).drop(name)


def judged(df: DataFrame, limits: Thresholds = Thresholds(), sample_rows: int = 400) -> DataFrame:
    """Counts, base rules and the verdict of the cascade for every document (columns ``doc_id``, ``text``).

    The counts are wanted for every document, so the cascade starts with them as parts it need not compute; it computes
    what else a rule needs when it reaches that rule.
    """
    docs = df.select("doc_id", text_of().alias("text"))
    counted = docs.withColumn("words", words_of(F.col("text"))).withColumn("lines", worded_lines(F.col("text")))
    given = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
    parts = {c: F.col(c) for c in ("text", "words", "lines")}
    counted = counted.select("doc_id", "text", *[PARTS[p][1](parts).alias(p) for p in given])
    plan = plan_for(docs, "text", steps(limits), sample_rows, set(given))
    known = {c: F.col(c) for c in ("text", *given)}
    failed = base_failed(F.col("n_words"), F.col("n_repeat_words"), limits)
    return counted.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        F.when(failed, F.lit(False)).otherwise(cascade(plan, known).isNull()).alias("kept"),
    )


def query(spark, folder: str) -> DataFrame:
    return judged(spark.read.parquet(f"{folder}/documents.parquet"))


SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
     split AS (SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
                      list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM docs),
     grams AS (SELECT r, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM split)),
     again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM grams) WHERE n > 1),
     covered AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM again) GROUP BY r),
     counts AS (
       SELECT d.r, doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
              length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols,
              len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
              length(regexp_replace(text, '\P{Lu}', '', 'g')) AS capitals
       FROM docs d JOIN split USING (r) LEFT JOIN covered USING (r))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 100 * n_symbols > 10 * n_words OR 100 * capitals > 30 * word_chars
            OR 100 * n_dup_lines > 40 * n_lines OR word_chars NOT BETWEEN 2 * n_words AND 15 * n_words) AS kept
FROM counts
"""

QUERIES = {"op4_quality_rules": (query, SQL)}
