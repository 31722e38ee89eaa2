"""The pipeline's stages one by one against brute force, on a small table with extra columns."""

import random

import corpus_pipeline
from plumbline.llm import bpe, repetition
from test_shingle_join import brute as groups
from test_suffix_dedup import brute as removed


def make(seed=3):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(900)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, items = prose(90), [prose(25) + "." for _ in range(4)]
    texts = [None, "", "short text", prose(300), prose(60) + " " + " ".join(["again and again"] * 60)]
    texts += [prose(120) + " " + passage + " " + prose(120) for _ in range(3)]
    texts += [prose(80) + " " + items[0] + " " + prose(80), prose(200)]
    base = prose(200)
    texts += [base, base, base + " more"]
    return [(i, t, "en", "s", len(t or ""), 1.5, "x") for i, t in enumerate(texts)], items


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, kept double, n_bytes string"


def test_stages(spark, tmp_path):
    rows, items = make()
    docs = spark.createDataFrame(rows, COLUMNS)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    quality, near, repeats, clean, encode = (f for _, f in corpus_pipeline.STAGES)
    text_of = {r[0]: r[1] for r in rows}

    one = quality(spark, docs, str(tmp_path))
    assert one.schema == docs.schema
    verdict = repetition.measure([r[1] for r in rows], repetition.RepetitionRules())["kept"]
    left = {r.doc_id for r in one.collect()}
    assert left == {r[0] for r, k in zip(rows, verdict) if k} and not left & {0, 1, 2, 4}

    two = near(spark, one, str(tmp_path))
    assert two.schema == docs.schema
    want = {c for _, _, c in groups([(i, text_of[i]) for i in sorted(left)], 5, 80)}
    left = {r.doc_id for r in two.collect()}
    assert left == want

    three = repeats(spark, two, str(tmp_path))
    assert three.schema == docs.schema
    order = sorted(left)
    expected = dict(zip(order, removed([text_of[i] for i in order], 400)))
    got = {r.doc_id: r for r in three.collect()}
    assert set(got) == left and any(n for _, n, _, _ in expected.values())
    for i, (size, gone, _, _) in expected.items():
        assert len(got[i].text) == size - gone == got[i].n_chars

    four = clean(spark, three, str(tmp_path))
    assert four.schema == docs.schema
    assert {r.doc_id for r in four.collect()} == left - {8}

    final = {r.doc_id: r.n_tokens for r in encode(spark, four, str(tmp_path)).collect()}
    vocab = bpe.vocabulary(corpus_pipeline.vocabulary_path())
    assert final == {i: len(vocab.encode(got[i].text)) for i in left - {8}}
    whole = {r.doc_id: r.n_tokens for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert whole == final


def test_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], COLUMNS)
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert out.count() == 0
        docs = out if "text" in out.columns else docs


def test_repeated_rows_leave_one(spark, tmp_path):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(900)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    known, nameless, kinds, single = (prose(200) for _ in range(4))
    rows = [(1, known, "a")] * 3 + [(None, nameless, "a")] * 3 + [(2, kinds, "b"), (2, kinds, "a"), (2, kinds, None)] + [(3, single, "a"), (None, single, "a"), (None, single + " more", "a")]
    docs = spark.createDataFrame([(i, t, s, len(t)) for i, t, s in rows], "doc_id long, text string, source string, n_chars long").repartition(4)
    near = corpus_pipeline.near_duplicates(spark, docs, str(tmp_path))
    assert near.schema == docs.schema
    left = sorted(((r.doc_id, r.text, r.source) for r in near.collect()), key=str)
    assert left == sorted([(1, known, "a"), (None, nameless, "a"), (2, kinds, "a"), (3, single, "a")], key=str)
    after = corpus_pipeline.repeated_passages(spark, near, str(tmp_path)).collect()
    assert sorted((r.text for r in after)) == sorted([known, nameless, kinds, single])
    empty = spark.createDataFrame([(None, None, "a", 0)] * 2 + [(5, " ", "a", 1)] * 2, docs.schema)
    assert corpus_pipeline.near_duplicates(spark, empty, str(tmp_path)).count() == 4
