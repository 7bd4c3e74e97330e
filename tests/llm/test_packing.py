"""Token ids beside the tokenizer itself; packings beside their rules."""

import random
import zlib

import numpy as np
import plain
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from rackpulse.llm import packing, slack, textbytes
from rackpulse.llm.tokens import Encoder

ODD = [
    None, "", " ", "\n\n  \t", "Hello  world\n\n\nwhat's  up ", "a  b \n c　d", "x\u0085y  ", "<|endoftext|>", "a <|endoftext|> b<|endoftext|>",
    "tabs\t\tand\r\nlines\x0b\x0c\x1c end", "“smart” – dash…", "日本語 text\n 中文", "\U0001f600\U0001f600 é", "'s 't 're 've 'm 'll 'd", "1234 5 67.89", "word " * 3000, "q" * 9000,
    " leading", "trailing   ", "a\n b\n  c",
]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def ids_of(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]


def test_ids_equal_the_tokenizer(tokenizer, monkeypatch):
    texts = [t or "" for t in ODD] + [" ".join(plain.prose(s, 80)) for s in range(20)]
    for limit in (300_000, 40):
        monkeypatch.setattr("rackpulse.llm.tokens.REMEMBERED", limit)
        encoder = Encoder()
        for begin, end, data, at in textbytes.chunks(pa.array(texts * 2)):
            ids, place = encoder.encode(data, at)
            for r in range(end - begin):
                assert ids[place[r] : place[r + 1]].tolist() == ids_of(tokenizer, (texts * 2)[begin + r])


def corpus(count=300):
    rng = random.Random(4)
    texts = dict(enumerate(ODD))
    for i in range(len(ODD), count):
        texts[i] = " ".join(plain.prose(i, rng.choice([3, 40, 200, 700, 2500])))
    return texts


def test_slack_packing(spark, folder, tokenizer):
    texts = corpus()
    rows = slack.query(spark, folder(list(texts.items()))).collect()
    want = {i: ids_of(tokenizer, t) for i, t in texts.items()}
    bins = {}
    for i, ids in want.items():
        mine = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["piece"])
        assert [r["piece"] for r in mine] == list(range(len(mine))) and sum(r["length"] for r in mine) == len(ids)
        at = 0
        for r in mine:
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            assert len(mine) == 1 or r["piece"] == 0 or r["length"] == slack.CAPACITY
            at += r["length"]
            bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in bins.values():
        assert [a for a, _ in sorted(spans)] == [sum(n for _, n in sorted(spans)[:k]) for k in range(len(spans))]
        assert sum(n for _, n in spans) <= slack.CAPACITY
    assert len(bins) <= 1.03 * sum(map(len, want.values())) / slack.CAPACITY + 1


def test_repeated_rows_and_missing_ids(spark, folder):
    rows = slack.query(spark, folder([(1, "a b"), (1, "a b"), (None, "c"), (None, None)])).collect()
    assert sorted(str(r["doc_id"]) for r in rows) == ["1", "1", "None", "None"] and sorted(r["offset"] for r in rows)[0] == 0
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == 4


def test_empty_table(spark, folder):
    path = folder([])
    assert slack.query(spark, path).collect() == [] and packing.query(spark, path).collect() == []


@pytest.mark.parametrize("seed", range(6))
def test_fullest_is_the_best_subset(seed):
    rng = random.Random(seed)
    sizes = [rng.randint(1, 40) for _ in range(10)]
    counts = np.bincount(sizes, minlength=101)
    for room in (5, 37, 90):
        best = max(s for s in (sum(x for k, x in enumerate(sizes) if m >> k & 1) for m in range(1024)) if s <= room)
        used = slack.fullest(room, counts, 100)
        assert sum(used) == best and all(used.count(u) <= counts[u] for u in used)


def test_plan_places_every_piece_once():
    rng = np.random.default_rng(2)
    counts = np.bincount(rng.integers(1, 65, 5000), minlength=65)
    places, seen = slack.Places(counts), {}
    for length in range(1, 65):
        bins, offset = places.of(np.full(counts[length], length), np.arange(counts[length]))
        for b, o in zip(bins.tolist(), offset.tolist()):
            seen.setdefault(b, []).append((o, length))
    assert sum(map(len, seen.values())) == 5000 and len(seen) == places.bins <= 1.005 * (counts * np.arange(65)).sum() / 64 + 1
    for spans in seen.values():
        spans.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:])) and sum(spans[-1]) <= 64


def test_matrices(spark, folder, tokenizer, tmp_path):
    texts = corpus(120)
    docs = spark.read.parquet(folder(list(texts.items())) + "/documents.parquet")
    packing.matrices(docs, str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows")).collect()
    ids, positions = packing.read_matrix(rows)
    found = {}
    for r, row, places in zip(rows, ids, positions):
        ends = r["cu_seqlens"]
        assert ends[0] == 0 and ends[-1] == r["n_tokens"] and not row[r["n_tokens"] :].any()
        for doc, start, a, b in zip(r["doc_ids"], r["starts"], ends, ends[1:]):
            assert places[a:b].tolist() == list(range(b - a))
            found.setdefault(doc, []).append((start, row[a:b].tolist()))
    for i, text in texts.items():
        assert [x for _, part in sorted(found[i]) for x in part] == ids_of(tokenizer, text)
    assert len({r["sequence_id"] for r in rows}) == len(rows)


@pytest.mark.parametrize("seed", range(3))
def test_best_fit_decreasing(seed):
    rng = random.Random(seed)
    sizes = [rng.randint(1, 60) for _ in range(400)]
    rooms, plain_rooms, out = [17, 60, 3], [17, 60, 3], {}
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        fit = [(room, b) for b, room in enumerate(plain_rooms) if room >= sizes[i]]
        if not fit:
            plain_rooms.append(60)
            fit = [(60, len(plain_rooms) - 1)]
        plain_rooms[min(fit)[1]] -= sizes[i]
    packing.best_fit(sizes, 60, rooms)
    assert sorted(rooms) == sorted(plain_rooms)
