"""Quality counts beside plain counting, and the cascade."""

import plain
from pyspark.sql import functions as F

from rackpulse.llm import quality


def counts(text):
    text = text or ""
    words = plain.WORD.findall(text)
    lines = [line for line in text.split("\n") if plain.WORD.search(line)]
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = {g for g in grams if grams.count(g) > 1} if len(grams) < 2000 else None
    if often is None:
        seen = {}
        for g in grams:
            seen[g] = seen.get(g, 0) + 1
        often = {g for g, n in seen.items() if n > 1}
    covered = {p for i, g in enumerate(grams) if g in often for p in (i, i + 1, i + 2)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_counts_and_verdicts(spark, folder):
    prose = " ".join(plain.prose(1, 90))
    texts = [
        None, "", " \n\t", "a b c a b c", prose, prose.upper(), "\n".join([prose[:60]] * 9 + [prose]), prose.replace(" ", " ## "),
        "Und " * 70, " ".join(["x" * 40] * 3 + plain.prose(2, 60)), "é\x0bü\x0c\x1cß " * 30, "q r s\n" * 40, " ".join(plain.prose(3, 9000, 300)),
        "\n".join(["abc"] * 3 + ["", " ", "def"] * 3),
    ]
    got = {r["doc_id"]: r for r in quality.query(spark, folder(list(enumerate(texts)))).collect()}
    for i, text in enumerate(texts):
        want = counts(text)
        assert tuple(got[i])[1:6] == want, (text or "")[:40]
        assert got[i]["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
    assert [i for i in got if got[i]["kept"]] == [4] or got[4]["kept"]
    assert not any(got[i]["kept"] for i in (0, 1, 2, 3, 5, 6, 7, 8))


def test_empty_and_repeated(spark, folder):
    prose = " ".join(plain.prose(1, 90))
    docs = spark.read.parquet(folder([(1, prose), (1, prose), (2, None), (None, prose)]) + "/documents.parquet")
    kept = quality.kept(docs)
    assert kept.columns == docs.columns and [r["doc_id"] for r in kept.collect()] == [1, 1, None]


def test_empty_table(spark, folder):
    assert quality.query(spark, folder([])).collect() == []


def test_order_is_by_rejection_per_cost(spark):
    checks = [quality.Rule(n, F.lit(False)) for n in "abc"]
    figures = [quality.Measured("a", 1.0, 0.1), quality.Measured("b", 0.1, 0.1), quality.Measured("c", 1.0, 0.5)]
    assert [r.name for r in quality.ordered(checks, figures)] == ["b", "c", "a"]


def test_later_rules_are_not_evaluated(spark):
    fails = F.raise_error(F.lit("evaluated")).cast("boolean")
    rows = spark.range(3).select(quality.verdict([quality.Rule("first", F.col("id") >= 0), quality.Rule("second", fails)]).alias("v"))
    assert [r["v"] for r in rows.collect()] == ["first"] * 3


def test_measured_on_the_sample(spark, folder):
    docs = spark.read.parquet(folder([(i, "w " * (i % 2) * 60) for i in range(40)]) + "/documents.parquet")
    figures = quality.measure(docs, "text", [quality.Rule("few", quality.n_words(F.col("text")) < 50)])
    assert figures[0].rejection == 0.5 and figures[0].seconds > 0


def test_parts_are_computed_when_a_rule_needs_them(spark, monkeypatch):
    fails = F.raise_error(F.lit("evaluated")).cast("bigint")
    monkeypatch.setitem(quality.PARTS, "n_capitals", ((), lambda p: fails))
    by_name = {s.name: s for s in quality.steps()}
    rows = spark.createDataFrame([("few words",), ("# " * 60,)], "text string")
    plan = [by_name[n] for n in ("few_words", "symbols", "capitals")]
    assert [r["v"] for r in rows.select(quality.cascade(plan, {"text": F.col("text")}).alias("v")).collect()] == ["few_words", "symbols"]


def test_order_counts_shared_parts_once():
    by_name = {s.name: s for s in quality.steps()}
    costs = {"words": 1.0, "n_words": 0.0, "word_chars": 0.1, "n_symbols": 0.4, "n_capitals": 0.2, "n_repeat_words": 5.0}
    rejected = [{"few_words"}] * 30 + [{"symbols"}] * 20 + [{"word_length"}] * 19 + [{"few_words", "repeated_windows"}] * 31
    plan = quality.planned([by_name[n] for n in ("few_words", "symbols", "word_length", "repeated_windows")], costs, rejected)
    # Once the words are there, the word length costs 0.1; nobody is left to reject for the repeated windows.
    assert [s.name for s in plan] == ["few_words", "word_length", "symbols", "repeated_windows"]


def test_cascade_equals_all_rules(spark, folder):
    prose = [" ".join(plain.prose(i, 40 + 5 * i)) for i in range(20)]
    odd = [p.upper() for p in prose[:4]] + [p.replace(" ", " # ", 20) for p in prose[4:8]] + ["\n".join([p[:50]] * 5) for p in prose[8:12]] + ["", None]
    docs = spark.read.parquet(folder(list(enumerate(prose + odd))) + "/documents.parquet")
    alone = docs.withColumn("t", F.coalesce("text", F.lit("")))
    for rule in quality.rules(F.col("t")):
        alone = alone.filter(~rule.rejects)
    want = sorted(r["doc_id"] for r in alone.collect())
    assert 0 < len(want) < 20 and sorted(r["doc_id"] for r in quality.kept(docs).collect()) == want
