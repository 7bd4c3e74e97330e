"""The pipeline's stages: columns, what stays, what goes."""

import corpus_pipeline as pipeline
import plain


def test_stages(spark, folder):
    clean = {i: "\n".join(" ".join(plain.prose(i * 10 + k, 40, 3000)) for k in range(3)) for i in range(30)}
    near = plain.prose(900, 150, 3000)
    texts = dict(clean) | {
        100: clean[0], 101: " ".join(near), 102: " ".join(plain.edited(near, 2, 1)), 103: "Und " * 90, 104: None, 105: " ".join(plain.prose(5, 90)).upper(),
        106: "good line of prose with quite enough letters\n" + " ".join(plain.prose(906, 80, 3000)),
        107: "good line of prose with quite enough letters\n" + " ".join(plain.prose(907, 80, 3000)),
    }
    path = folder(list(texts.items()))
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns, ids = docs.columns, []
    for name, stage in pipeline.STAGES[:3]:
        docs = stage(spark, docs, path)
        assert docs.columns == columns, name
        ids.append({r["doc_id"] for r in docs.collect()})
    assert ids[0] == set(texts) - {103, 104, 105}
    assert ids[1] == ids[0] - {100} and ids[2] == ids[1] - {102}
    text = {r["doc_id"]: (r["text"], r["n_chars"]) for r in docs.collect()}
    assert text[106][0] == texts[106] and text[107][0] == texts[107].split("\n")[1] and all(n == len(t) for t, n in text.values())
    out = pipeline.run(spark, path)
    assert set(out.columns) == {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"}
    assert {r["doc_id"] for r in out.collect()} <= ids[2] and len(pipeline.STAGES) == 5
