"""Jaccard components beside all pairs, and the R-tree beside a scan."""

import numpy as np
import plain
import pytest

from rackpulse.llm import jaccard


def corpus():
    texts = {}
    for g in range(12):
        base = plain.prose(g, 30 + 25 * g)
        for c in range(6):
            texts[len(texts)] = " ".join(plain.edited(base, c * (1 + g // 4), 100 * g + c))
    shared = plain.prose(99, 60)
    for c in range(15):
        texts[len(texts)] = " ".join(plain.prose(200 + c, 40 + c) + shared + plain.prose(300 + c, 50))
    for t in ("", "one two", "ONE  two\n", "one two three", " ", " \t", "a " * 5000, "x" * 70_000, " ".join(plain.prose(1, 55)).upper()):
        texts[len(texts)] = t
    return texts


def check(spark, folder, texts):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.query(spark, folder(list(texts.items()))).collect()}
    assert got == plain.jaccard_components(texts)


def test_components(spark, folder):
    texts = corpus()
    texts[len(texts)] = None
    check(spark, folder, texts)


def test_small_blocks(spark, folder, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 3)
    check(spark, folder, corpus())


def test_large_group_of_near_copies(spark, folder):
    base = plain.prose(5, 120)
    check(spark, folder, {i: " ".join(plain.edited(base, i % 4, i)) for i in range(150)})


def test_repeated_rows_and_missing_ids(spark, folder):
    a, b = " ".join(plain.prose(1, 40)), " ".join(plain.prose(2, 40))
    rows = jaccard.query(spark, folder([(7, a), (7, a), (3, a), (9, b), (None, b), (2, None), (2, None)])).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in rows) == [(2, 2), (2, 2), (3, 3), (7, 3), (7, 3), (9, 9)]


def test_empty_table(spark, folder):
    assert jaccard.query(spark, folder([])).collect() == []


def test_unique_keeps_columns(spark, folder):
    a = " ".join(plain.prose(1, 40))
    docs = spark.read.parquet(folder([(4, a), (5, a + " end"), (6, "other")]) + "/documents.parquet")
    kept = jaccard.unique(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [4, 6]


def test_texts_of_one_id_are_one_node(spark, folder):
    a, b = " ".join(plain.prose(1, 40)), " ".join(plain.prose(2, 40))
    rows = jaccard.query(spark, folder([(1, a), (2, b), (5, a), (5, b), (6, None), (6, b), (7, None)])).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in rows) == [(1, 1), (2, 1), (5, 1), (5, 1), (6, 1), (6, 1), (7, 7)]


def test_unique_works_on_rows(spark, folder):
    a, b, c, d, e = (" ".join(plain.prose(k, 40)) for k in range(1, 6))
    near = b + " end"
    rows = [(7, a), (7, a), (3, c), (3, d), (9, d), (None, b), (None, near), (None, b), (None, e), (8, e), (4, None), (4, None), (5, None)]
    kept = [(r["doc_id"], r["text"]) for r in jaccard.unique(spark.read.parquet(folder(rows) + "/documents.parquet")).collect()]
    assert sorted((i, t or "") for i, t in kept if i is not None) == sorted([(3, c), (3, d), (4, ""), (5, ""), (7, a), (8, e)])
    assert [i in ((None, b), (None, near)) for i in kept if i[0] is None] == [True]


@pytest.mark.parametrize("seed", range(4))
def test_tree_equals_scan(seed):
    rng = np.random.default_rng(seed)
    centres = rng.integers(0, 9, (20, jaccard.GROUPS))
    points = np.clip(centres[rng.integers(0, 20, 3000)] + rng.integers(-1, 2, (3000, jaccard.GROUPS)), 0, 255).astype(np.uint8)
    points[::500, 3] = 255
    sizes = points.sum(1).astype(np.int64)
    tree = jaccard.RTree(points, sizes)
    for q in rng.integers(0, 3000, 40):
        fits = (100 * sizes >= 80 * sizes[q]) & (100 * sizes[q] >= 80 * sizes)
        want = np.flatnonzero(fits & (jaccard.bound(points, points[q]) >= jaccard.needed(sizes, sizes[q])))
        assert sorted(tree.search(points[q], int(sizes[q])).tolist()) == want.tolist()


def test_bound_is_above_the_overlap():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 3000, 1500).astype(np.uint64) * np.uint64(7919)) for _ in range(30)]
    at = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    points = jaccard.group_counts(np.concatenate(sets), at)
    for i, s in enumerate(sets):
        assert all(b >= jaccard.overlap(s, t) for b, t in zip(jaccard.bound(points, points[i]), sets))
