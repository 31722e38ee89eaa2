"""Token alignment against a plain version over bytes and the public libraries; products against dense matrices; edge cases."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from plumbline.llm import token_alignment as T

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
PARTS = ["a", "b", " ", "  ", "\n", "'s", "1", "é", "<|endoftext|>", "<s>", "</s>", "<unk>", "<0x0A>", "\xa0", "the", " and", "日本", "!", "🙂", "▁", "\x00", "zq", "ing", "tokenizer", "Größe", "\t"]
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def raw_of(libraries):
    a, b = libraries
    letters = T.byte_letters()
    back = {c: x for x, c in letters.items()}
    a_raw = lambda i: bytes(back[c] for c in a.id_to_token(i))
    b_raw = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    return a_raw, b_raw


def groups_of(text, libraries):
    """Groups ([A ids], [B ids]) by the byte offsets where both end a token."""
    a, b = libraries
    a_raw, b_raw = raw_of(libraries)
    if not text:
        return []
    x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    want = (" " + text).encode()
    if b"".join(map(a_raw, x)) != want or b"".join(map(b_raw, y)) != want:
        return []
    ends = [np.cumsum([len(f(i)) for i in ids]).tolist() for f, ids in ((a_raw, x), (b_raw, y))]
    out, at = [], [0, 0]
    for end in sorted(set(ends[0]) & set(ends[1])):
        to = [e.index(end) + 1 for e in ends]
        out.append((x[at[0] : to[0]], y[at[1] : to[1]]))
        at = to
    return out


def brute(rows, libraries):
    docs = [(i, groups_of(t, libraries)) for i, t in rows]
    links = [Counter((p, q) for x, y in g for p in x for q in y) for _, g in docs]
    held = Counter(pair for c in links for pair in c)
    most = {}
    for (p, _), n in held.items():
        most[p] = max(most.get(p, 0), n)
    out = []
    for (i, g), c in zip(docs, links):
        shown = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g)
        digest = hashlib.sha256(shown.encode()).hexdigest() if g else ""
        out.append((i, sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), sum(c.values()), sum(n for p, n in c.items() if held[p] == most[p[0]]), sum(n * held[p] for p, n in c.items()), digest))
    return sorted(out, key=str)


def make(seed, n):
    rng = random.Random(seed)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 14))) for _ in range(n)]
    texts += [None, "", " ", "\n", "▁", "a" * 3000, " " * 3000 + "x", "the tokenizer, and more. " * 400, "<|endoftext|><s>", "é", "same", "same", "\x1c\x85"]
    rows = list(enumerate(texts))
    return rows + [(None, "the same id"), (None, "the same id"), (3, "twice"), (3, "twice")]


@pytest.mark.parametrize("sizes", [{}, {"batch_bytes": 600, "piece_bytes": 100}])
def test_brute_force(spark, libraries, sizes):
    rows = make(7, 250)
    got = T.alignment(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), A, B, **sizes)
    assert got.columns == COLUMNS
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, libraries)


def test_encoder(libraries):
    pair = T.pair_of(A, B)
    for _, text in make(11, 1500):
        if text:
            assert pair.encode_a(" " + text) == libraries[0].encode(" " + text, add_special_tokens=False).ids


def test_products():
    rng = np.random.default_rng(2)
    for block in (1, 7, 1 << 20):
        for height, inner, width in ((5, 6, 4), (1, 1, 1), (9, 3, 8), (0, 3, 2)):
            dense = [rng.integers(0, 2, shape) * rng.integers(1, 5, shape) for shape in ((height, inner), (inner, width))]
            sparse = [T.Csr(np.concatenate(([0], np.cumsum((d > 0).sum(axis=1)))), np.nonzero(d)[1], d[d > 0], d.shape[1]) for d in dense]
            out = np.zeros((height, width), int)
            for row, column, count in T.gustavson(*sparse, block):
                out[row, column] = count
            assert (out == dense[0] @ dense[1]).all()
            back = sparse[1].transposed()
            turned = np.zeros((width, inner), int)
            turned[back.rows(), back.columns] = back.counts
            assert (turned == dense[1].T).all()


def test_overlap_and_groups():
    # bytes: A ab|cd|ef|g, B a|bcd|efg: bounds of both at 4 and 7
    overlap = T.overlap_links(np.array([2, 2, 2, 1]), np.array([1, 3, 3]))
    assert list(zip(overlap.rows().tolist(), overlap.columns.tolist(), overlap.counts.tolist())) == [(0, 0, 1), (0, 1, 1), (1, 1, 2), (2, 2, 2), (3, 2, 1)]
    a, b = T.groups_of(overlap)
    assert a.tolist() == [0, 0, 1, 1] and b.tolist() == [0, 0, 1]


def test_packing():
    for numbers in ([], [0], [5, 1, 2**31 - 1, 0, 7]):
        assert T.unpacked(T.packed(np.array(numbers, np.int64))).tolist() == numbers


def test_edges(spark, libraries):
    rows = [(1, "the cat"), (2, "the dog")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    clash = docs.select("*", *(F.lit(1).alias(c) for c in ("id", "batch", "pair", "place", "n_a", "documents", "best", "shown")))
    assert sorted(map(tuple, T.alignment(clash, A, B).collect())) == brute(rows, libraries)
    none = T.alignment(docs.where("doc_id < 0"), A, B)
    assert none.collect() == [] and none.columns == COLUMNS
    words = spark.createDataFrame([("x", None), ("y", "")], "name string, body string")
    assert sorted(map(tuple, T.alignment(words, A, B, "name", "body").collect())) == [("x", 0, 0, 0, 0, 0, 0, ""), ("y", 0, 0, 0, 0, 0, 0, "")]
