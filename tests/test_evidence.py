"""Matching through the index gives what scoring every pair of a category gives; words as rows give what row-wise functions give."""

import random

import pytest
from pyspark.sql import functions as F

from plumbline.functions import text as T
from plumbline.operators import evidence as E
from plumbline.operators import textindex as TI
from plumbline.operators import words

STRONG = ["rim", "handle", "wick", "label", "cap", "edge"]
WEAK = ["surface", "part", "component", "layer", "body"]
ATTRIBUTES = ["crack", "fracture", "bent", "dent", "hole", "void", "ink", "stain", "fiber", "scratch", "metal", "missing"]
DEFECTS = "category string, defect_order int, defect string, visual_signature string, visual_attributes array<string>, region string, region_definition string, critical_check string, distinctions array<struct<target_defect:string,difference:string>>"


def phrase(rng, most=5):
    return " ".join(rng.choice(rng.choice([STRONG, WEAK, WEAK, ATTRIBUTES])) for _ in range(rng.randint(0, most)))


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(5)
    options = [(f"c{k % 2}", k, "A", phrase(rng)) for k in range(120)] + [("c0", 500, "A", "surface part"), ("c0", 501, "B", None), ("c9", 502, "A", "crack")]
    defects = [
        (f"c{k % 2}", k, f"kind{k} {phrase(rng, 2)}", phrase(rng), rng.choice([None, [], [phrase(rng, 2)]]), phrase(rng, 2), phrase(rng, 3), None, rng.choice([None, [("x", phrase(rng, 3))]]))
        for k in range(40)
    ]
    return (
        spark.createDataFrame(options, "category string, question_id long, option_key string, option_text string"),
        spark.createDataFrame(defects, DEFECTS).withColumn("defect_node", F.concat(F.lit("n"), F.col("defect_order").cast("string"))),
    )


def near(rng, options, text):
    rows = options.select("category", text).distinct().collect()
    return [(r[0], r[1], k, rng.random()) for r in rows if r[1] for k in range(40) if rng.random() < 0.2 and r[0] == f"c{k % 2}"]


@pytest.mark.parametrize("encoder", [False, True])
def test_options_match_as_all_pairs_do(spark, tables, encoder):
    options, defects = tables
    similarity = spark.createDataFrame(near(random.Random(2), options, "option_text"), "category string, option_text string, defect_order int, similarity double") if encoder else None
    got = E.match_options(options, defects, floor=0.0, top=10**6, similarity=similarity)
    texts, known = E._option_sides(options, defects)
    every = texts.join(known, "category")
    if encoder:
        every = every.join(similarity, ["category", "option_text", "defect_order"], "left")
    scored = E.score_options(every, F.col("similarity") if encoder else None)
    want = scored.where((F.col("signal_score") > 0) & F.col("evidence_consensus") & (F.col("score") >= 1.6))
    fields = ["category", "option_text", "defect_order", F.round("score", 9), F.round("signal_score", 9)]
    assert sorted(map(tuple, got.select(*fields).distinct().collect())) == sorted(map(tuple, want.select(*fields).collect()))
    assert want.count() > 20


@pytest.mark.parametrize("encoder", [False, True])
def test_reports_rank_as_all_pairs_do(spark, tables, encoder):
    options, defects = tables
    reports = options.select("category", F.col("question_id").alias("report_id"), F.col("option_text").alias("report"))
    similarity = spark.createDataFrame(near(random.Random(3), reports, "report"), "category string, report string, defect_order int, similarity double") if encoder else None
    got = E.rank_reports(reports, defects, top=10**6, similarity=similarity)
    text = E.evidence_text(name=F.col("defect"), signature=F.col("visual_signature"), attributes=F.col("visual_attributes"), distinctions=F.col("distinctions"), targets=False)
    stated = words.profiles(defects.select("category", "defect_order", text.alias("evidence")), ["category", "defect_order"], evidence="evidence")
    told = words.profiles(reports.select("report").where("report <> ''").distinct(), ["report"], report="report")
    every = reports.select("category", "report").distinct().join(told, "report").join(stated, "category")
    if encoder:
        every = every.join(similarity, ["category", "report", "defect_order"], "left")
    scored = E.score_pairs(every, "report", "evidence", F.col("similarity") if encoder else None)
    usable = (F.size("support_channels") == 0) | F.arrays_overlap("support_channels", T.words(["lexical_overlap", "semantic_embedding"]))
    want = scored.where(F.col("evidence_consensus") & usable & (F.col("signal_score") >= 1.6))
    fields = ["category", "report", "defect_order", F.round("score", 3), F.round("signal_score", 3)]
    assert sorted(map(tuple, got.select(*fields).distinct().collect())) == sorted(map(tuple, want.select(*fields).collect()))
    assert want.count() > 20


def test_common_words_build_no_pairs(spark):
    """Many texts and defects that share weak tokens only: nothing meets."""
    options = spark.range(20_000).selectExpr("'c' AS category", "id AS question_id", "'A' AS option_key", "concat('surface part layer ', conv(id, 10, 36)) AS option_text")
    defects = spark.createDataFrame([("c", k, f"kind{k} surface", "part layer surface body", None, "surface", "part", "layer", None) for k in range(300)], DEFECTS)
    texts, known = E._option_sides(options, defects)
    left = texts.withColumn("features", F.array_union(TI.strong("option_tokens"), TI.attributes("option_attrs")))
    right = known.withColumn("features", F.array_union(TI.strong("name_tokens", "signature_tokens"), TI.attributes("name_attrs", "evidence_attrs", "graph_attrs")))
    assert TI.meeting(left, right, ["category"]).count() == 0
    assert E.match_options(options, defects).count() == 0


def test_pairs_meet_once(spark):
    left = spark.createDataFrame([(1, "g", ["a", "b", "#x"]), (2, "g", ["b"]), (3, "h", ["a"]), (4, "g", [])], "l int, g string, features array<string>")
    right = spark.createDataFrame([(1, "g", ["b", "a", "#x"]), (2, "g", ["#x"]), (3, "g", ["q"])], "r int, g string, features array<string>")
    got = sorted((x.l, x.r, x.shared) for x in TI.meeting(left, right, ["g"]).collect())
    assert got == [(1, 1, ["a", "b", "#x"]), (1, 2, ["#x"]), (2, 1, ["b"])]


def test_words_as_rows(spark):
    rng = random.Random(8)
    pool = ["cracks", "Colour_spots", "fibres", "deformation", "no", "not", "and", "but", "hole", "board", "defect", "without", "normal", "surfaces", "x1", "the", "a", "anomalies", "inserted", "missing"]
    rows = [(k, " ".join(rng.choice(pool) for _ in range(rng.randint(0, 30)))) for k in range(150)] + [(200, None), (201, ""), (202, "no " + "x " * 17 + "crack"), (203, "no " + "x " * 18 + "crack")]
    df = spark.createDataFrame(rows, "k int, t string")
    by_row = {r.k: r.s for r in df.select("k", F.array_sort(T.tokens("t")).alias("s")).collect()}
    sets = {r.k: r.t_tokens for r in words.token_sets(df, ["k"], t="t").collect()}
    assert {k: sets.get(k, []) for k, _ in rows} == by_row
    plain = df.withColumn("n", T.normalize_text(F.col("t")))
    ordered = plain.withColumn("w", T.ordered_tokens("n"))
    want = {r.k for r in ordered.where(T.affirms(F.col("w"), T.ANOMALY_WORDS)).collect()}
    got = {r.k for r in words.affirming(plain, ["k"], F.col("n"), T.ANOMALY_WORDS).collect()}
    assert got == want and 203 in got and 202 not in got


def test_evidence_that_categories_share_matches_in_each(spark):
    options = spark.createDataFrame([(c, k, "A", "jagged crack at the rim") for k, c in enumerate(["a", "b", "c"])], "category string, question_id long, option_key string, option_text string")
    defects = spark.createDataFrame([(c, k, "crack", "jagged crack", None, region, "the rim", None, None) for c, k, region in [("a", 0, "rim"), ("b", 1, "rim"), ("b", 2, "core"), ("d", 3, "rim")]], DEFECTS)
    got = E.match_options(options, defects.withColumn("graph_path", F.concat("category", "region")))
    assert sorted((r.category, r.defect_order, r.region, r.graph_path) for r in got.collect()) == [("a", 0, "rim", "arim"), ("b", 1, "rim", "brim")]


@pytest.mark.parametrize("name", ["txt6_option_scores", "jn5_option_matches", "jn5_matches_with_encoder", "txt7_ranked_hypotheses", "rag1_retrieval_plan", "rag2_context_blocks", "txt15_attribute_evidence", "jn8_supported_hypotheses", "jn9_prompt_blocks", "grf1_graph_nodes"])
def test_sides_that_grow_are_not_broadcast_by_estimate(spark, name):
    from plumbline.plans import QUERIES, load_all

    load_all()
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan


def test_grounding_audit_matches_once(spark):
    """The audit's figures and its listing come from one matching of the options, not from one each."""
    from plumbline.plans import QUERIES, load_all

    from conftest import SMALL

    load_all()
    scans = lambda name: QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString().count("FileScan")
    assert scans("rag5_grounding_audit") < 1.5 * scans("jn5_option_matches")


def test_discriminative_lists_what_matched(spark):
    options = spark.createDataFrame([(1, "A"), (1, "B"), (2, "A"), (2, "B"), (3, "A"), (3, "B")], "question_id int, option_key string")
    rows = [(1, "B", "crack", 1, 2.0), (1, "A", "hole", 2, 2.0), (1, "A", "dent", 1, 2.5), (2, "A", "hole", 1, 9.0), (2, "B", "hole", 1, 9.0), (3, "A", "hole", 1, 3.2)]
    matches = spark.createDataFrame(rows, "question_id int, option_key string, defect string, match_rank int, signal_score double")
    got = {r["question_id"]: r for r in E.discriminative(matches, options).collect()}
    assert {q: r["discriminative"] for q, r in got.items()} == {1: True, 2: False, 3: True}
    assert [(m["option_key"], m["defects"]) for m in got[1]["matched"]] == [("A", ["dent", "hole"]), ("B", ["crack"])]
    assert {q: r["match_count"] for q, r in got.items()} == {1: 2, 2: 2, 3: 1}
