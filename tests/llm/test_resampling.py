"""Resampling beside a plain version; the two vocabularies beside each other."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import plain
import pyarrow as pa
import pytest

from rackpulse.llm import resampling, textbytes
from rackpulse.llm.tables import table

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def features(text, runs):
    w = words(text)
    return [" ".join(w[i : i + n]) for n in range(1, runs + 1) for i in range(len(w) - n + 1)]


def plain_resampled(docs, target, percent=10, least=20, runs=1, buckets=10_000):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(bucket(f) for _, x in docs for f in features(x, runs)), Counter(bucket(f) for x in target for f in features(x, runs))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets))))
    rows = []
    for doc, text in docs:
        f = features(text, runs)
        h = int(hashlib.sha256(f"2024:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(bucket(x)) for x in f)
        rows.append([doc, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(text)), None])
    drawn = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for place, row in enumerate(drawn[: percent * len(drawn) // 100], 1):
        row[5] = place
    return sorted([tuple(r[:4] + r[5:]) for r in rows], key=str)


def told(df):
    return sorted([(r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in df.collect()], key=str)


def corpus(count=260):
    rng = random.Random(5)
    docs = [(i, " ".join(plain.prose(i, rng.choice([0, 3, 19, 20, 60, 300])))) for i in range(count)]
    docs += [(9000, "Ärger ÄÖ, it's 3.5% -- x_y z　 <b>Bold</b>\tA\r\nB"), (9001, None), (None, "word " * 30), (None, "other " * 30), (9002, "w" * 200 + " " + "é" * 90),
             (9003, "\x00\x01 a\x7fb 中文 " * 9), (9004, "same words here " * 10), (9004, "same words here " * 10), (-5, "a " * 5000), (9005, "zero " * 20)]
    target = [" ".join(plain.prose(i, 50)) for i in range(3, 30)] + [None, "", "word other Word"]
    return docs, target


def frames(spark, folder, docs, target):
    path = folder(docs, benchmark=([(i, t, 1) for i, t in enumerate(target)], "item_id long, text string, n_features int"))
    return path, table(spark, path, "documents"), table(spark, path, "benchmark")


@pytest.mark.parametrize("percent,runs", [(10, 1), (37, 2), (100, 3)])
def test_resampled_equals_plain(spark, folder, percent, runs):
    docs, target = corpus()
    path, rows, bench = frames(spark, folder, docs, target)
    want = plain_resampled(docs, target, percent, runs=runs)
    assert told(resampling.resampled(rows.repartition(6), bench, percent, runs=runs)) == want
    if runs == 1:
        assert told(resampling.query(spark, path)) == want
        drawn = [(x[0], x[4]) for x in want if x[4]]
        assert sorted((r["doc_id"], r["rank"]) for r in resampling.sample(rows, bench).collect()) == sorted(drawn)


def test_empty_tables(spark, folder):
    path, rows, bench = frames(spark, folder, [], [])
    assert resampling.query(spark, path).collect() == []


def test_empty_target(spark, folder):
    docs, _ = corpus(30)
    path, _, _ = frames(spark, folder, docs, [])
    assert told(resampling.query(spark, path)) == plain_resampled(docs, [])


@pytest.mark.parametrize("runs", [1, 2, 3])
@pytest.mark.parametrize("share", [0, 0.3, 1])
def test_head_and_tail_give_the_same_buckets(runs, share):
    texts = [t or "" for _, t in corpus(60)[0]]
    rng = random.Random(1)
    names = sorted({w.encode() for t in texts for w in words(t)})
    pairs = sorted({(a.encode(), b.encode()) for t in texts for a, b in zip(words(t), words(t)[1:])})
    head = resampling.Head.of([n for n in names if rng.random() < share], [p for p in pairs if rng.random() < share])
    for begin, end, data, at in textbytes.chunks(pa.array(texts)):
        bucket, row, count = resampling.features(head, data, at, runs)
        for r in range(end - begin):
            assert Counter(bucket[row == r].tolist()) == Counter(zlib.crc32(f.encode()) % 10_000 for f in features(texts[begin + r], runs))
            assert count[r] == len(words(texts[begin + r]))


def test_vocabulary_holds_the_frequent(spark, folder):
    _, rows, _ = frames(spark, folder, [(i, "the cat sat on the mat " * 30 + f"rare{i}") for i in range(20)], [])
    head = resampling.vocabulary(rows, runs=2)
    data = np.frombuffer(b"the mat rare3", np.uint8)
    begin, end, _ = resampling.words(data, np.array([0, len(data)]))
    assert (head.places(data, begin, end) >= 0).tolist() == [True, True, False] and len(head.pair) >= 5
