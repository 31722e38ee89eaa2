"""Groups of near duplicates against comparing every pair."""

import random
import re

import pytest

from plumbline.llm import shingle_join
from plumbline.llm.shingle_join import JoinSettings

LOWER = {c: c + 32 for c in range(65, 91)}


def shingles(text, words):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())


def brute(rows, words, percent):
    sets = [shingles(t, words) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                root[find(a)] = find(b)
    members = {}
    for k in range(len(rows)):
        members.setdefault(find(k), []).append(rows[k][0])
    low = {r: min((i for i in ids if i is not None), default=None) for r, ids in members.items()}
    return [(i, len(s), low[find(k)]) for k, ((i, _), s) in enumerate(zip(rows, sets))]


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefgé") for _ in range(rng.randint(1, 6))) for _ in range(200)]
    prose = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    texts = [None, "", " \n", "one", "One", "two words", "A b C", "a B c", "a b c d", "x y z w v"]
    shared = prose(30)
    for n in (8, 20, 40, 90, 90, 200):
        base = prose(n)
        for _ in range(14):
            w = list(base)
            for _ in range(rng.randint(0, max(1, n // 18))):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                w = w[: rng.randint(max(1, len(w) - 8), len(w))]
            texts.append(" ".join(w))
    texts += [" ".join(shared + prose(rng.randint(5, 60))) for _ in range(20)]
    texts += texts[12:18] + [texts[40]] * 8
    order = list(range(len(texts)))
    rng.shuffle(order)
    return [(100 + k if k % 17 else None, texts[o]) for k, o in enumerate(order)]


@pytest.mark.parametrize("words,percent,block", [(4, 85, 2048), (5, 80, 4), (2, 60, 3)])
def test_groups(spark, words, percent, block):
    rows = corpus(words)
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n int, place string").repartition(3)
    settings = JoinSettings(words=words, percent=percent, block=block, delegates=2, sketch_bits=10)
    got = shingle_join.near_duplicates(docs, settings).select("doc_id", "n_shingles", "component_id").collect()
    key = lambda r: tuple((x is None, x) for x in r)
    want = brute(rows, words, percent)
    # a row without words and id is its own component
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_one_of_each_group_stays(spark):
    rows = [(3, "a b c d e f"), (1, "A b c d e f"), (2, "q r s t u v"), (None, None), (5, ""), (None, "a b c d e f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = shingle_join.drop_near_duplicates(docs).collect()
    assert sorted((r.doc_id or -1, r.text) for r in left if r.text) == [(1, "A b c d e f"), (2, "q r s t u v")]
    assert len(left) == 4
    assert left[0].asDict().keys() == {"doc_id", "text"}
    assert shingle_join.near_duplicates(docs.limit(0)).count() == 0


def scattered(seed):
    """Texts of ten words of which many share one by chance, and a few near copies."""
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(600)]
    texts = []
    for k in range(240):
        words = rng.sample(vocabulary, 10)
        texts.append(" ".join(words))
        for _ in range(2 if k % 12 == 0 else 0):
            words[rng.randrange(10)] = rng.choice(vocabulary)
            texts.append(" ".join(words))
    return list(enumerate(texts))


@pytest.mark.parametrize("hot", [1, 3, 256])
def test_texts_that_share_a_shingle_by_chance(spark, monkeypatch, hot):
    rows, moved, verified = scattered(5), [], shingle_join._verified
    monkeypatch.setattr(shingle_join, "_verified", lambda r, *a: moved.append(r.count()) or verified(r, *a))
    settings = JoinSettings(words=1, percent=60, block=16, delegates=2, sketch_bits=16, hot=hot)
    got = shingle_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), settings)
    assert sorted(got.select("doc_id", "n_shingles", "component_id").collect()) == sorted(brute(rows, 1, 60))
    if hot == 256:
        # such texts do not chain to one neighbourhood, whose blocks would each be sent all of them
        assert sum(moved) < len(rows)


def test_pairs_of_different_neighbourhoods_link(spark, monkeypatch):
    """Neighbours only choose what is verified together: with none of them the groups are the same."""
    rows = corpus(3)
    alone = shingle_join._neighbourhoods
    monkeypatch.setattr(shingle_join, "_neighbourhoods", lambda met, settings: alone(met, settings).where("size < 0"))
    settings = JoinSettings(words=3, percent=70, block=8, sketch_bits=10, hot=1000)
    got = shingle_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), settings)
    key = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
    assert sorted(map(tuple, got.select("doc_id", "n_shingles", "component_id").collect()), key=key) == sorted(brute(rows, 3, 70), key=key)


def test_shuffle_files_go_with_their_query(spark):
    files = lambda: {f.getName() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()) if f.getName().startswith("shuffle_")}
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    spark.conf.set(setting, "false")
    before = files()
    rows = scattered(6)
    named = shingle_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), JoinSettings(words=1, percent=60, sketch_bits=16))
    # without it two shuffles were left here
    left = {f.split("_")[1] for f in files() - before}
    assert len(left) < 2, left
    assert spark.conf.get(setting) == "false"
    assert named.count() == len(rows)
