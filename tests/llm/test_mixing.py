"""Raking and sampling."""

import numpy as np
import plain
import pytest
from pyspark.sql import functions as F

from rackpulse.llm import mixing


@pytest.mark.parametrize("seed", range(3))
def test_marginals_are_met(seed):
    rng = np.random.default_rng(seed)
    have = rng.uniform(50, 100, (4, 3, 2))
    targets = [rng.dirichlet(np.full(n, 30.0)) for n in have.shape]
    kept = mixing.rake(have, targets, 0.2)
    assert (kept <= have + 1e-9).all()
    for axis, want in enumerate(targets):
        assert np.allclose(kept.sum(tuple(a for a in range(3) if a != axis)) / kept.sum(), want, atol=1e-6)


def test_no_tokens_beyond_those_there():
    have = np.array([[10.0, 0.0], [0.0, 1000.0]])
    kept = mixing.rake(have, [np.array([0.5, 0.5]), np.array([0.5, 0.5])], 0.5)
    assert kept[0, 0] == 10 and (kept <= have).all()
    assert not mixing.rake(np.zeros((2, 2)), [np.ones(2) / 2] * 2, 0.5).any()


def test_sample_follows_probabilities(spark, folder):
    texts = [(i, " ".join(plain.prose(i % 50, 20 + i % 30))) for i in range(3000)]
    docs = spark.read.parquet(folder(texts) + "/documents.parquet")
    targets = [mixing.Target(F.col("source"), {"src0": 0.2, "src1": 0.3}, 0.5), mixing.Target(F.col("lang"), {"en": 1.0})]
    out = mixing.drawn(docs, targets, 0.4)
    rows = out.groupBy("source").agg(F.avg("probability").alias("p"), F.avg(F.col("sampled").cast("int")).alias("share")).collect()
    assert all(abs(r["p"] - r["share"]) < 0.06 for r in rows)
    assert all(abs(r["p"] - {"src0": 0.24, "src1": 0.36, "src2": 0.6}[r["source"]]) < 0.03 for r in rows)
    kept = mixing.sample(docs, targets, 0.4)
    assert kept.columns == docs.columns and kept.count() == out.filter(F.col("sampled") == True).count()  # noqa: E712


def test_odd_rows(spark, folder):
    path = folder([(1, None), (2, ""), (3, "one two"), (3, "one two"), (None, "one two"), (4, "word " * 30_000)])
    rows = mixing.query(spark, path).collect()
    assert len(rows) == 6 and all(0 <= r["probability"] <= 1 for r in rows)
    same = [r["sampled"] for r in rows if r["doc_id"] == 3]
    assert same[0] == same[1]


def test_empty_table(spark, folder):
    assert mixing.query(spark, folder([])).collect() == []


def plain_probabilities(docs, fraction=0.5):
    """Probability of each row of (doc_id, text, lang, source), by loops over cells."""
    names = [[f"src{i}" for i in range(20)], ["en", "de", "fr", "es"], ["note", "article", "long"]]
    shares = [{**{f"src{i}": 0.0475 for i in range(20)}, None: 0.05}, {"en": 0.4, "de": 0.2, "fr": 0.2, "es": 0.15, None: 0.05},
              {"note": 0.15, "article": 0.55, "long": 0.3, None: 0.0}]

    def cell(text, lang, source):
        size = len(text or "")
        values = (source, lang, "note" if size < 800 else "article" if size < 4000 else "long")
        return tuple(v if v in n else None for v, n in zip(values, names))

    have = {}
    for _, text, lang, source in docs:
        have[cell(text, lang, source)] = have.get(cell(text, lang, source), 0) + len(plain.WORD.findall(text or ""))
    total, kept = sum(have.values()), {c: n * fraction for c, n in have.items()}
    wanted = []
    for axis in range(3):
        there = {v for c, n in have.items() for v in [c[axis]] if n > 0}
        all_shares = sum(s for v, s in shares[axis].items() if v in there)
        wanted.append({v: shares[axis][v] / all_shares * fraction * total for v in there})
    for _ in range(mixing.ROUNDS):
        before = dict(kept)
        for axis in range(3):
            now = {}
            for c, n in kept.items():
                now[c[axis]] = now.get(c[axis], 0) + n
            kept = {c: min(n * (wanted[axis][c[axis]] / now[c[axis]] if now[c[axis]] > 0 else 0), have[c]) for c, n in kept.items()}
        if max(abs(kept[c] - before[c]) for c in kept) <= mixing.CLOSE * total:
            break
    return [kept[c] / have[c] if have[c] else fraction for c in (cell(*row[1:]) for row in docs)]


def test_query_equals_plain(spark, tmp_path):
    import xxhash

    docs = [(i, " ".join(plain.prose(i, [8, 200, 900][i % 3])), ["en", "de", "it", None][i % 4], [f"src{i % 7}", "elsewhere", None][i % 3]) for i in range(240)]
    docs += [(900, None, "en", "src1"), (901, "", "fr", "nowhere"), (None, "no id here", "en", "src2")]
    spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, lang string, source string, probability string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in mixing.query(spark, str(tmp_path)).collect()}
    seed = xxhash.xxh64((5).to_bytes(4, "little"), seed=42).intdigest()
    for (doc, text, _, _), want in zip(docs, plain_probabilities(docs)):
        uniform = (xxhash.xxh64(str(doc) if doc is not None else f"text {text}", seed=seed).intdigest() >> 11) / 2**53
        assert got[doc]["probability"] == pytest.approx(want, rel=1e-6)
        assert got[doc]["sampled"] == (uniform < got[doc]["probability"])
