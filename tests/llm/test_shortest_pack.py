"""Shortest-pack-first packing beside the tokenizer and its rules."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from test_packing import corpus
from tokenizers import Tokenizer

from rackpulse.llm import shortest_pack
from rackpulse.llm.tables import table


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def checked(rows, capacity):
    """Sequences have neither gaps nor overlaps; returns their lengths."""
    ends = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends.get(r["sequence_id"], 0) and r["length"] > 0
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    assert all(n == capacity or n < capacity and n & (n - 1) == 0 for n in ends.values())
    return list(ends.values())


@pytest.mark.parametrize("capacity", [2048, 64])
def test_every_id_once_and_no_padding(spark, folder, tokenizer, capacity):
    texts = corpus()
    docs = table(spark, folder(list(texts.items())), "documents")
    rows = shortest_pack.packed(docs, capacity).collect()
    want = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for i, t in texts.items()}
    for i, ids in want.items():
        mine, at = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["start"]), 0
        for r in mine:
            part = np.array(ids[at : at + r["length"]], "<u4")
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(part.tobytes()) and r["doc_tokens"] == len(ids)
            at += r["length"]
        assert at == len(ids)
    total = sum(map(len, want.values()))
    sizes = checked(rows, capacity)
    assert sum(sizes) == total and len(sizes) == total // capacity + bin(total % capacity).count("1")
    # Only few documents that fit are cut.
    cut = {r["doc_id"] for r in rows if r["doc_tokens"] <= capacity and r["length"] < r["doc_tokens"]}
    assert len(cut) <= 0.1 * len(texts)


def test_query_and_sequences(spark, folder, tokenizer):
    texts = corpus(60)
    path = folder(list(texts.items()))
    rows = shortest_pack.query(spark, path).collect()
    assert sum(checked(rows, shortest_pack.CAPACITY)) == sum(len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for t in texts.values())
    whole = shortest_pack.sequences(table(spark, path, "documents")).collect()
    for s in whole:
        ids = np.frombuffer(s["ids"], "<u4").tolist()
        for offset, doc, start, length in zip(s["offsets"], s["doc_ids"], s["starts"], s["lengths"]):
            full = [*tokenizer.encode(texts[doc] or "", add_special_tokens=False).ids, 1]
            assert ids[offset : offset + length] == full[start : start + length]


def test_odd_rows(spark, folder):
    rows = shortest_pack.query(spark, folder([(1, "a b"), (1, "a b"), (None, "c"), (None, None), (4, "")])).collect()
    assert sorted(checked(rows, 2048)) == [2, 8] and sum(r["length"] for r in rows) == 10
    assert sorted((str(r["doc_id"]), r["doc_tokens"]) for r in rows if r["start"] == 0) == [("1", 3), ("1", 3), ("4", 1), ("None", 1), ("None", 2)]


def test_empty_table(spark, folder):
    assert shortest_pack.query(spark, folder([])).collect() == []


def test_equal_lengths(spark, folder):
    rows = shortest_pack.query(spark, folder([(i, "a " * 1499 + "a") for i in range(30)])).collect()
    sizes = checked(rows, 2048)
    assert sum(sizes) == 30 * 1501


@pytest.mark.parametrize("seed", range(12))
def test_plan(seed):
    rng, capacity = np.random.default_rng(seed), 64
    counts = np.bincount(rng.integers(1, capacity + 1 if seed % 2 else 20, rng.integers(0, 400)), minlength=capacity + 1)
    made = shortest_pack.patterns(counts)
    got = np.zeros_like(counts)
    for lengths, number in made:
        assert sum(lengths) <= capacity and list(lengths) == sorted(lengths, reverse=True)
        np.add.at(got, list(lengths), number)
    assert (got == counts).all()
    plan, size = shortest_pack.Plan(counts), np.repeat(np.arange(capacity + 1), counts)
    piece, start, length, sequence, offset = plan.parts(np.arange(len(size)))
    at = {}
    for p, s, n in sorted(zip(piece.tolist(), start.tolist(), length.tolist())):
        assert at.get(p, 0) == s
        at[p] = s + n
    assert [at[i] for i in range(len(size))] == size.tolist()
    rows = [dict(sequence_id=q, offset=o, length=n) for q, o, n in zip(sequence.tolist(), offset.tolist(), length.tolist())]
    assert len(checked(rows, capacity)) == plan.sequences


def plain_shortest_pack_first(sizes, capacity):
    packs = []
    for size in sorted(sizes, reverse=True):
        pack = min((p for p in packs), key=sum, default=None)
        if pack is None or sum(pack) + size > capacity:
            packs.append([size])
        else:
            pack.append(size)
    return packs


@pytest.mark.parametrize("seed", range(4))
def test_patterns_are_those_of_single_pieces(seed):
    sizes = np.random.default_rng(seed).integers(1, 60, 200).tolist()
    made = shortest_pack.patterns(np.bincount(sizes, minlength=65))
    plain = plain_shortest_pack_first(sizes, 64)
    assert sum(n for _, n in made) == len(plain)
    assert sorted(sum(x) for x, n in made for _ in range(n)) == sorted(map(sum, plain))


def test_plan_size_does_not_follow_the_corpus():
    counts = np.bincount(np.random.default_rng(1).integers(1, 2049, 20_000), minlength=2049)
    small, large = shortest_pack.Plan(counts), shortest_pack.Plan(counts * 1_000_000)
    assert len(large.kept) < 3 * len(small.kept) + 1000 and len(large.stream) < 2049 and len(large.runs) < 5000
