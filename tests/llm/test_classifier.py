"""Classifier: held-out accuracy, folds, odd rows."""

import os
import zlib

import numpy as np
import plain
import pytest

from rackpulse.llm import classifier, textbytes


def test_folds_scores_and_odd_rows(spark, folder):
    texts, labels = [], []
    for i in range(400):
        words = plain.prose(i, 60)
        good = i % 3 != 0
        texts.append((i, " ".join(words) if good else " ".join(w.upper() + "!!" for w in words)))
        labels.append((i, int(good), 0))
    texts += [(1000, None), (1001, ""), (1002, " ".join(plain.prose(1, 60))), (1002, " ".join(plain.prose(1, 60))), (1003, "x " * 40_000), (None, "a")]
    labels += [(1000, None, 0), (1001, 5, 0), (None, 1, 0), (0, 0, 0)]
    path = folder(texts, labels=(labels, "doc_id long, quality int, toxic int"))
    rows = classifier.query(spark, path).collect()
    assert len(rows) == len(texts) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    for r in rows:
        if r["doc_id"] is not None:
            assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
    held = [(r["predicted"], int(r["doc_id"] % 3 != 0)) for r in rows if r["held_out"] and r["doc_id"] < 400]
    assert len(held) > 80 and np.mean([a == b for a, b in held]) > 0.97


def test_without_labels(spark, folder):
    path = folder([(1, "a b"), (2, None)], labels=([], "doc_id long, quality int, toxic int"))
    assert [r["score"] for r in classifier.query(spark, path).collect()] == [0.5, 0.5]


def test_empty_table(spark, folder):
    assert classifier.query(spark, folder([], labels=([], "doc_id long, quality int, toxic int"))).collect() == []


def test_scores_do_not_depend_on_neighbours():
    import pyarrow as pa

    model = classifier.Model(np.random.default_rng(1).normal(size=classifier.BUCKETS), 0.1)
    texts = ["", "a", "abc abc abc", " ".join(plain.prose(3, 300)), "é\n", " ".join(plain.prose(4, 30))]
    (_, _, data, at), = textbytes.chunks(pa.array(texts))
    together = model.scores(data, at)
    for text, score in zip(texts, together):
        alone = [model.scores(d, a)[0] for _, _, d, a in textbytes.chunks(pa.array([text]))]
        assert alone == [score]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="tables not present")
def test_held_out_accuracy(spark):
    path = "/root/testdata/sf0.01"
    rows = classifier.query(spark, path).join(spark.read.parquet(f"{path}/labels.parquet"), "doc_id").filter("held_out").collect()
    right = {y: np.mean([r["predicted"] == y for r in rows if r["quality"] == y]) for y in (0, 1)}
    assert min(right.values()) > 0.85, right
