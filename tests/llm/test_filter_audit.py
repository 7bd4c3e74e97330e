"""Tries, masks and the audit beside plain loops."""

import random
import re
from itertools import permutations

import pytest

from rackpulse.llm import filter_audit
from rackpulse.llm.tables import table

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LABELS = "doc_id long, quality int, toxic int, part string, mask int"


def failing(text, least, doc):
    words = WORD.findall(text)
    out = {
        "A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text),
        "D": bool(re.search(r"[#$%&*|]", text)), "E": least is not None and (doc is None or doc > least),
    }
    return {k for k, v in out.items() if v}


def plain_audit(rows, labels):
    least = {}
    for doc, text, _ in rows:
        if doc is not None:
            least[text or ""] = min(doc, least.get(text or "", doc))
    good = {d for d, q, _ in labels if q == 1}
    toxic = {d for d, _, t in labels if t == 1}
    docs = [(doc, part or "", failing(text or "", least.get(text or ""), doc)) for doc, text, part in rows]
    orders = list(permutations("ABCDE"))
    out = {}
    for part in {p for _, p, _ in docs}:
        mine = [(d, f) for d, p, f in docs if p == part]
        lost = dict.fromkeys("ABCDE", 0)
        for order in orders:
            for _, f in mine:
                first = next((x for x in order if x in f), None)
                if first:
                    lost[first] += 1
        for order in orders:
            left = list(mine)
            for step, x in enumerate(order, 1):
                gone = [(d, f) for d, f in left if x in f]
                earlier = len([1 for _, f in mine if x in f]) - len(gone)
                left = [(d, f) for d, f in left if x not in f]
                out[part, "".join(order), step] = (
                    len(left), len(gone), earlier, sum(f == {x} for _, f in mine), sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone), lost[x]
                )
    return out


def told(rows):
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    return {(r["part"], r["filter_order"], r["step"]): tuple(r[n] for n in names) for r in rows}


def corpus(spark, path, rows, labels):
    schema = "doc_id long, text string, source string, part string, mask int, entry long, own int, prefix string"
    spark.createDataFrame([(d, t, s, "x", 1, 2, 3, "p") for d, t, s in rows], schema).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(*x, "x", 1) for x in labels], LABELS).write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_audit_equals_plain(spark, tmp_path):
    rng = random.Random(3)
    base = ["", "few words", "word " * 60, "LOUD " * 20 + " ".join(f"w{i}" for i in range(60)), " ".join(f"v{i}" for i in range(70)),
            " ".join(f"u{i}" for i in range(70)) + " # | x", "a b　c " * 30, "x" * 5000, "é É ü " * 40, "same start " * 30 + "1", "same start " * 30 + "2"]
    rows = [(i, rng.choice(base) + rng.choice(["", "", " y", f" {i}"]), rng.choice(["s1", "s1", "s2", None, ""])) for i in range(300)]
    rows += [(None, "few words", "s1"), (None, "only without id", "s2"), (7, None, None), (5, "few words", "s1"), (5, "few words", "s1"), (-1, "word " * 60, "s2")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 300, 3)] + [(3, 1, 1), (3, 0, 0), (None, 1, 1)]
    path = corpus(spark, tmp_path, rows, labels)
    want = plain_audit(rows, [x for x in labels if x[0] is not None])
    assert told(filter_audit.query(spark, path).collect()) == want
    # Ranges so small that most prefixes are extended, and a task that remembers nothing.
    small = filter_audit.audit(table(spark, path, "documents").repartition(5), table(spark, path, "labels"), range_bytes=300)
    assert told(small.collect()) == want


def test_empty_table(spark, tmp_path):
    assert filter_audit.query(spark, corpus(spark, tmp_path, [], [])).collect() == []


@pytest.mark.parametrize("seed", range(5))
def test_trie(seed):
    rng = random.Random(seed)
    texts = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 9))) * rng.choice([1, 1, 40]) for _ in range(300)]
    owns = [rng.choice([None, *range(40)]) for _ in texts]
    trie = filter_audit.Trie()
    for entry, (text, own) in enumerate(zip(texts, owns)):
        trie.insert(text, entry, own)
    least = {t: min((o for x, o in zip(texts, owns) if x == t and o is not None), default=None) for t in texts}
    want = {(e, least[t]) for e, (t, o) in enumerate(zip(texts, owns)) if least[t] is not None and (o is None or o > least[t])}
    assert set(trie.later()) == want


def test_entries_fall_back_to_smaller_ids(spark, monkeypatch):
    monkeypatch.setattr("rackpulse.llm.filter_audit.REMEMBERED", 10)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        rows = [(20 - i, "copy" if i % 2 else f"own {i}", "s") for i in range(20)]
        found = filter_audit.masks(spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1), range_bytes=1).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    copies = {r["doc_id"] for r in found if r["mask"] & filter_audit.COPY}
    assert copies == {20 - i for i in range(20) if i % 2} - {1} and len(found) == 20


def test_very_long_texts(spark):
    long = "start " * 200_000
    rows = [(1, long + "a", "s"), (2, long + "b", "s"), (3, long + "a", "s")]
    found = filter_audit.masks(spark.createDataFrame(rows, "doc_id long, text string, source string"), range_bytes=1000).collect()
    assert {r["doc_id"]: bool(r["mask"] & filter_audit.COPY) for r in found} == {1: False, 2: False, 3: True}
