"""Line classes beside all pairs of lines."""

import random

import plain
import pytest
from pyspark.sql import functions as F

from rackpulse.llm import line_dedup


def varied(line, rng, edits):
    out = list(line)
    for _ in range(edits):
        at = rng.randrange(len(out))
        kind = rng.randrange(3)
        if kind == 0:
            out[at] = "#"
        elif kind == 1:
            out.insert(at, "é")
        else:
            del out[at]
    return "".join(out)


def wanted(texts, edits=line_dedup.EDITS, least=line_dedup.MIN_CHARS):
    first = {}
    for i in sorted(texts):
        for n, line in enumerate((texts[i] or "").split("\n")):
            if plain.WORD.search(line):
                first.setdefault(line, (i, n))
    long = [line for line in first if len(line) >= least]
    links = [
        (first[a], first[b]) for x, a in enumerate(long) for b in long[:x]
        if abs(len(a) - len(b)) <= edits and plain.edit_distance(a, b) <= edits
    ]
    root = plain.roots(list(first.values()), links)
    out = {}
    for i in texts:
        for n, line in enumerate((texts[i] or "").split("\n")):
            if plain.WORD.search(line) and root[first[line]] != (i, n):
                out.setdefault(i, []).append(f"{n}:{root[first[line]][0]}:{root[first[line]][1]}")
    return out


def corpus(seed):
    rng = random.Random(seed)
    stock = [" ".join(plain.prose(seed * 100 + k, rng.randint(1, 14))) for k in range(40)]
    texts = {}
    for i in range(60):
        lines = []
        for _ in range(rng.randint(0, 5)):
            line = rng.choice(stock)
            lines.append(varied(line, rng, rng.randint(0, 3)) if line and rng.random() < 0.6 else line)
        texts[i] = "\n".join(lines)
    texts[60], texts[61], texts[62] = None, "\n \n", "z" * 40_000 + "\n" + "z" * 40_001
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_dropped_lines(spark, folder, seed):
    texts = corpus(seed)
    got = {r["doc_id"]: r for r in line_dedup.query(spark, folder(list(texts.items()))).collect()}
    want = wanted(texts)
    assert {i: r["dropped"].split(",") for i, r in got.items() if r["dropped"]} == want
    assert all(r["n_lines"] == len((texts[i] or "").split("\n")) and r["n_dropped"] == len(want.get(i, [])) for i, r in got.items())


def test_distance(spark):
    rng = random.Random(3)
    lines = ["", "a", "ab", "abcdefgh", "kitten sitting", "ééüß"]
    pairs = [(a, varied(a, rng, min(k, len(a)))) for a in lines for k in range(4)] + [("abc", "xyz"), ("", "ab"), ("", "abc"), ("abcd", "bcda")]
    rows = spark.createDataFrame(pairs, "a string, b string")
    for edits in (1, 2, 3):
        got = rows.select("a", "b", line_dedup.within(F.col("a"), F.col("b"), edits).alias("near")).collect()
        assert [(r["a"], r["b"], r["near"]) for r in got] == [(a, b, plain.edit_distance(a, b) <= edits) for a, b in pairs]


def test_deduplicated_documents(spark, folder):
    line, other = "this line is long enough to be compared", "and here is quite another line of prose"
    path = folder([(1, f"{line}\nshort"), (2, f"{line}!\n{other}"), (3, f"{line}\n{line}"), (4, None), (None, other)])
    docs = spark.read.parquet(path + "/documents.parquet")
    out = line_dedup.deduplicated(docs)
    assert out.columns == docs.columns
    assert sorted((r["doc_id"], r["text"]) for r in out.collect()) == [(1, f"{line}\nshort"), (2, other), (4, None)]


def plain_rows(spark, rows):
    """Kept lines of each row and the number dropped, for rows that are not told apart by their id."""
    key = {(r["doc_id"], r["text"]): (r["r1"], r["r2"]) for r in spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", "text", *line_dedup.row_key()).collect()}
    lines = {
        ((1 << 63) - 1 if i is None else i, n, key[i, t]): (line, i, t)
        for i, t in rows for n, line in enumerate(t.split("\n")) if plain.WORD.search(line)
    }
    links = [
        (a, b) for a, (x, *_) in lines.items() for b, (y, *_) in lines.items()
        if a < b and (x == y or min(len(x), len(y)) >= line_dedup.MIN_CHARS and plain.edit_distance(x, y) <= line_dedup.EDITS)
    ]
    root = plain.roots(list(lines), links)
    gone = {(i, t): sorted(a[1] for a in lines if root[a] != a and lines[a][1:] == (i, t)) for i, t in rows}
    return [(i, t, gone[i, t], "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone[i, t])) for i, t in rows]


def test_rows_of_one_id_or_none(spark, folder):
    line = "this line is long enough to be compared"
    rows = [(7, "A\nB"), (7, "C\nA"), (3, "one\ntwo"), (3, "two\none"), (None, f"A\nD\n{line}"), (None, f"E\nD\n{line}."), (None, "F\nG\nH"), (None, "F\nI\nB"), (7, "J\nK"), ((1 << 63) - 1, "F\nG\nH")]
    want = plain_rows(spark, rows)
    assert [x[3] for x in want[:2]] == ["A\nB", "C"]
    path = folder(rows)
    got = sorted((str(r["doc_id"]), r["n_lines"], r["n_dropped"], [int(x.split(":")[0]) for x in r["dropped"].split(",") if x]) for r in line_dedup.query(spark, path).collect())
    assert got == sorted((str(i), t.count("\n") + 1, len(gone), gone) for i, t, gone, _ in want)
    left = line_dedup.deduplicated(spark.read.parquet(path + "/documents.parquet")).collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in left) == sorted((str(i), kept) for i, _, _, kept in want if plain.WORD.search(kept))


def test_empty_table(spark, folder):
    assert line_dedup.query(spark, folder([])).collect() == []


def test_a_text_of_many_equal_lines(spark):
    rows = [(1, "the same line again and again and again\n" * 100_000 + "the end"), (2, "a line of its own, which nobody else has written")]
    kept = {r["doc_id"]: r["text"] for r in line_dedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == {1: "the same line again and again and again\nthe end", 2: rows[1][1]}


def test_without(spark):
    cases = [([], []), (["a"], []), (["a"], [0]), (list("abcdef"), [0, 1, 5]), (list("abcdef"), [2, 3]), (list("abc"), [0, 1, 2])]
    df = spark.createDataFrame([(i, v, p) for i, (v, p) in enumerate(cases)], "i int, v array<string>, p array<int>")
    got = {r["i"]: r["w"] for r in df.select("i", line_dedup.without(F.col("v"), F.col("p")).alias("w")).collect()}
    assert got == {i: [x for k, x in enumerate(v) if k not in p] for i, (v, p) in enumerate(cases)}


def test_equal_rows_are_one(spark):
    text = "first of all lines, long enough to be compared\nsecond of all lines, long enough too"
    rows = [(5, text), (5, text), (6, text.replace("second", "secund")), (None, text), (None, text)]
    kept = line_dedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [(r["doc_id"], r["text"]) for r in kept] == [(5, text), (5, text)]


def test_hashes_stay_behind_the_shuffle_of_lines(spark):
    docs = spark.createDataFrame([(1, "a line of words that is long enough\nother"), (2, "other\n\nother")], "doc_id long, text string")
    found = line_dedup.distinct_lines(docs)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(line" in plan and "hashpartitioning(k1" not in plan
    assert {r["line"]: r["places"] for r in found.collect()} == {"a line of words that is long enough": 1, "other": 3}
    tall = line_dedup.keys(found.withColumn("id", F.monotonically_increasing_id())).where((F.col("key") < 0) | (F.col("key") > line_dedup.KEY_BITS))
    assert tall.count() == 0
