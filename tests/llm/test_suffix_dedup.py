"""Suffix arrays against sorting, and the removal of repeats against counting every window."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from plumbline.llm import suffix_arrays, suffix_dedup


@pytest.mark.parametrize("letters,n", [("ab", 300), ("abcdefgh ", 500), ("a", 200), ("", 0), ("x", 1)])
def test_suffix_array_and_prefixes(letters, n):
    rng = random.Random(n)
    text = "".join(rng.choice(letters) for _ in range(n))
    symbols = np.array([ord(c) for c in text], np.int64)
    order, _ = suffix_arrays.suffix_array(symbols)
    assert order.tolist() == sorted(range(n), key=lambda i: text[i:])
    shared = suffix_arrays.common_prefixes(symbols, order)

    def common(a, b):
        k = 0
        while a + k < n and b + k < n and text[a + k] == text[b + k]:
            k += 1
        return k

    assert shared.tolist() == [0] * min(n, 1) + [common(a, b) for a, b in zip(order[:-1], order[1:])]


def test_prefixes_by_eights():
    rng = random.Random(4)
    raw = b"".join(rng.choice([b"abcabcab", b"\x00\x00", b"abcabcabc" * 3, b"x"]) for _ in range(120)) + b"\x00" * 9
    data = np.frombuffer(raw, np.uint8)
    padded = raw + bytes(8)
    eights = np.array([int.from_bytes(padded[k : k + 8], "big") for k in range(len(raw))], np.uint64)
    order, _ = suffix_arrays.suffix_array(data.astype(np.int64))
    for depth in (None, 20):
        plain = suffix_arrays.common_prefixes(data, order, depth)
        assert plain.tolist() == suffix_arrays.common_prefixes(data, order, depth, eights).tolist()


def brute(texts, size):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[k : k + size] for r in raws for k in range(len(r) - size + 1))
    out = []
    for r in raws:
        gone = np.zeros(len(r), bool)
        for k in range(len(r) - size + 1):
            if seen[r[k : k + size]] > 1:
                gone[k : k + size] = True
        edge = np.flatnonzero(np.diff(np.concatenate(([0], gone.view(np.int8), [0]))) == 1)
        kept = bytes(b for b, g in zip(r, gone) if not g)
        out.append((len(r), int(gone.sum()), len(edge), hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(60)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared = [prose(rng.randint(8, 60)) for _ in range(6)]
    texts = [None, "", "ab", "a" * 500, "ab" * 300]
    for k in range(60):
        parts = [prose(rng.randint(0, 40)) for _ in range(3)]
        parts += [rng.choice(shared) for _ in range(rng.randint(0, 2))]
        rng.shuffle(parts)
        texts.append(" ".join(parts))
    base = prose(120)
    for k in range(25):  # near copies
        w = base.split()
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = rng.choice(words)
        texts.append(" ".join(w))
    return texts + texts[10:14] + [texts[10]] * 5


@pytest.mark.parametrize("size,anchor,shard,run", [(100, 50, 256, 1 << 19), (60, 20, 2, 2000), (40, 40, 1, 500)])
def test_removal(spark, monkeypatch, size, anchor, shard, run):
    texts = corpus(size)
    monkeypatch.setattr(suffix_dedup, "SHARD_PIECES", shard)
    rows = [(i if i % 9 else None, t, "x") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string").repartition(3)
    # the size of a run is read where tasks run, so the compared function is checked with small runs here
    monkeypatch.setattr(suffix_dedup, "RUN_BYTES", run)
    got = suffix_dedup.remove_repeats(docs, size=size, anchor=anchor, keep_columns=("doc_id", "text")).collect()
    want = dict(zip(texts, brute(texts, size)))
    assert len(got) == len(texts)
    for r in got:
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.text]
        assert r.n_removed or r.kept_text == (r.text or "")


def test_query_returns_what_is_left(spark, tmp_path):
    """A passage of over fifty words goes at both places if it has 400 bytes, and stays if it has fewer; other texts are whole."""
    from plumbline.llm import queries

    rng = random.Random(8)
    passage = lambda n, letters: " ".join("".join(rng.choice("abcdefgh") for _ in range(letters)) for _ in range(n))
    long, short = passage(55, 8), passage(55, 5)
    assert len(long) >= 400 > len(short)
    own = [passage(40, 6) for _ in range(5)]
    texts = [f"{own[0]} 1 {long} 2 {own[1]}", f"3 {long}4", f"{short} 5 {own[2]}", f"{own[3]} 6 {short}", own[4]]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in queries.op10_suffix_dedup(spark, str(tmp_path)).collect()}
    assert all(hashlib.sha256(r.text.encode()).hexdigest() == r.kept_sha256 for r in got.values())
    # the blank before the passage is equal at both places too
    assert [got[k].text for k in (0, 1)] == [f"{own[0]} 1 2 {own[1]}", "34"]
    assert [got[k].text for k in (2, 3, 4)] == texts[2:]


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert suffix_dedup.remove_repeats(docs).count() == 0


@pytest.mark.parametrize("ranges,block", [(1, 3), (7, 40), (64, 1000)])
def test_merge_across_runs(ranges, block):
    """Every window not yet known is marked if its kind is in two runs, or twice in what arrives; by counting."""
    rng = random.Random(ranges)
    kinds = [hashlib.md5(str(k).encode()).digest() for k in range(400)]
    runs, entries = [], []
    for r in range(60):
        chosen = sorted(rng.sample(kinds[:5], rng.randint(0, 3)) + rng.sample(kinds, rng.randint(1, block // 3 + 1)))
        chosen = sorted(set(chosen))
        n = len(chosen)
        run = suffix_dedup.Windows(np.array(chosen, "S16"), np.array([r % 7] * n), np.array([r] * n), np.arange(n, dtype=np.int32) * 3, np.array([rng.random() < 0.2 for _ in chosen]))
        assert [len(suffix_dedup.Windows.unpack(run.pack())), suffix_dedup.Windows.unpack(run.pack()).hashes.tolist()] == [n, run.hashes.tolist()]
        runs.append(run)
        entries += [(run.hashes[i], r % 7, r, 3 * i, run.known[i]) for i in range(n)]
    count = Counter(e[0] for e in entries)
    want = sorted((a, p, o) for h, a, p, o, known in entries if count[h] > 1 and not known)
    parts = {}
    for run in runs:
        pieces = list(run.ranges(ranges))
        assert sum(len(p) for _, p in pieces) == len(run)
        for k, part in pieces:
            parts.setdefault(k, []).append(part)
    got = []
    for several in parts.values():
        merge = suffix_dedup.Merge()
        found = [b for part in several for b in merge.add(part)] + list(merge.settle())
        for row in (r for b in found for r in b.to_pylist()):
            got += [(row["anchor"], row["piece"], s["first"] + k) for s in row["spans"] for k in range(s["number"])]
    assert sorted(got) == want
