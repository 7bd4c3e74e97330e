"""Fingerprints: edited texts beside plain Python, and the algebra."""

import hashlib

import plain
from pyspark.sql import functions as F

from rackpulse.llm import fingerprint as fp


def test_edited_texts(spark, folder):
    texts = {i: "\n".join(" ".join(plain.prose(i * 50 + k, 8)) for k in range(i % 9)) for i in range(0, 120, 2)}
    texts |= {200: None, 201: "", 202: "é\U0001f600ü" * 7, 203: "x" * 60_000, 204: "x" * 60_000, 300: "end"}
    got = {r["doc_id"]: r for r in fp.query(spark, folder(list(texts.items()))).collect()}
    order = sorted(texts)
    assert sorted(got) == order
    for i, following in zip(order, order[1:] + order[:1]):
        text, after = texts[i] or "", texts[following] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert got[i]["n_chars"] == len(text) and got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert (got[i]["near_next"] == 1) == (sorted(text.split("\n")) == sorted(after.split("\n")))
        assert 0 <= got[i]["near_edited"] <= 1
    assert got[203]["fingerprint"] == got[204]["fingerprint"] and got[203]["near_next"] == 1.0


def test_order_does_not_matter_and_parts_add_up(spark):
    rows = spark.createDataFrame([("a\nb\nc\nb", "b\nb\nc\na", "a\nb", "c\nb", "a\nc\nb\nx")], "t string, u string, v string, w string, x string")
    f = {c: fp.fingerprint(F.col(c)) for c in "tuvwx"}
    out = rows.select(
        (f["t"] == f["u"]).alias("equal"), (fp.inserted(f["v"], f["w"]) == f["t"]).alias("sum"), (fp.deleted(f["t"], f["w"]) == f["v"]).alias("rest"),
        fp.likeness(f["t"], f["u"]).alias("one"), fp.likeness(f["t"], f["x"]).alias("less"),
    ).first()
    assert out["equal"] and out["sum"] and out["rest"] and out["one"] == 1.0 and 0 < out["less"] < 1


def test_likeness_estimates_the_common_share(spark):
    rows = [("\n".join(f"p{i}" for i in range(200)), "\n".join(f"p{i}" for i in range(k, 200 + k))) for k in (20, 100, 200)]
    got = [r[0] for r in spark.createDataFrame(rows, "a string, b string").select(fp.likeness(fp.fingerprint(F.col("a")), fp.fingerprint(F.col("b")))).collect()]
    assert abs(got[0] - 0.9) < 0.08 and abs(got[1] - 0.5) < 0.25 and got[2] < 0.4


def test_single_repeated_and_missing(spark, folder):
    rows = fp.query(spark, folder([(5, "a\nb"), (5, "a\nb"), (None, "c")])).collect()
    assert [(r["doc_id"], r["n_chars"], r["near_next"]) for r in rows] == [(5, 3, 1.0)]


def test_empty_table(spark, folder):
    assert fp.query(spark, folder([])).collect() == []
