"""Matching of reports and answer options to defect evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions import text as T
from plumbline.operators import textindex as TI
from plumbline.operators import words
from plumbline.operators.joins import hold, meet

#: The fields a defect is matched by; defects that agree in all of them have equal scores.
EVIDENCE = ["defect", "visual_signature", "visual_attributes", "region", "region_definition", "critical_check", "distinctions"]
SOURCE_CHANNELS = ["visual_signature", "visual_signature_attribute", "graph_visual_attribute", "semantic_embedding"]


def profiled(df: DataFrame, **texts: str) -> DataFrame:
    """For each ``name=text column`` add ``name_tokens`` and ``name_attrs``."""
    df = df.withColumns({f"{n}_tokens": T.tokens(c) for n, c in texts.items()})
    return hold(df.withColumns({f"{n}_attrs": T.attribute_hits(f"{n}_tokens") for n in texts}))


def evidence_text(
    *,
    name: Column | None = None,
    signature: Column,
    attributes: Column | None = None,
    contrast: Column | None = None,
    region: list[Column] | None = None,
    distinctions: Column,
    targets: bool = True,
) -> Column:
    """Evidence fields joined by spaces, empty ones left out; distinctions give target and difference."""
    fields = [name, signature]
    parts = [F.array(*[f for f in fields if f is not None])]
    if attributes is not None:
        parts.append(attributes)
    if contrast is not None:
        parts.append(F.array(contrast))
    if region is not None:
        parts.append(F.array(*region))
    pieces = F.transform(
        distinctions,
        lambda d: F.array(d["target_defect"], d["difference"]) if targets else F.array(d["difference"]),
    )
    parts.append(F.flatten(pieces))
    joined = F.concat(*[F.coalesce(p, F.array().cast("array<string>")) for p in parts])
    return F.array_join(F.filter(joined, lambda x: F.coalesce(x, F.lit("")) != ""), " ")


def _channels(flags: dict[str, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(c, name) for name, c in flags.items()]))


def consensus(channels: Column, terms: Column, similarity: Column) -> Column:
    """Two channels, or one rich enough on its own (an empty set passes with three terms)."""
    only_visual = F.size(F.array_except(channels, T.words(["visual_attribute", "graph_visual_attribute"]))) == 0

    def only(name: str) -> Column:
        return (F.size(channels) == 1) & F.array_contains(channels, name)

    return (
        (F.size(channels) >= 2)
        | (only("graph_visual_attribute") & (terms >= 2))
        | (only_visual & (terms >= 3))
        | (only("semantic_embedding") & (similarity >= 0.68))
    )


def score_pairs(pairs: DataFrame, left: str, right: str, similarity: Column | None = None) -> DataFrame:
    """Score text pairs from their profiles (``<name>_tokens``, ``<name>_attrs``).

    Adds score, signal_score, strong_overlap, attribute_overlap, attribute_term_count,
    support_channels and evidence_consensus. ``similarity`` is that of an optional encoder.
    """
    sim = F.coalesce(similarity, F.lit(0.0)) if similarity is not None else F.lit(0.0)
    rows = pairs.withColumns(
        {
            "token_overlap": F.array_sort(F.array_intersect(f"{left}_tokens", f"{right}_tokens")),
            "attribute_overlap": T.attribute_overlap(F.col(f"{left}_attrs"), F.col(f"{right}_attrs")),
            "_sim": sim,
        }
    )
    rows = rows.withColumns(
        {
            "strong_overlap": F.array_except("token_overlap", T.weak_tokens()),
            "attribute_term_count": T.term_count(F.col("attribute_overlap")),
        }
    )
    weak = F.size("token_overlap") - F.size("strong_overlap")
    bonus = F.greatest(F.lit(0.0), F.col("_sim") - 0.45) * 4.0
    signal = (
        F.size("strong_overlap") * 1.2 + F.size("attribute_overlap") * 1.35 + F.col("attribute_term_count") * 0.18 + bonus
    )
    rows = rows.withColumns(
        {
            "signal_score": signal,
            "score": signal + weak * 0.25,
            "support_channels": _channels(
                {
                    "lexical_overlap": F.size("strong_overlap") > 0,
                    "visual_attribute": F.size("attribute_overlap") > 0,
                    "semantic_embedding": F.col("_sim") >= 0.58,
                }
            ),
        }
    )
    agreed = consensus(F.col("support_channels"), F.col("attribute_term_count"), F.round("_sim", 4))
    return hold(rows.withColumn("evidence_consensus", agreed).drop("_sim"))


def defect_evidence(defects: DataFrame, key: list[str]) -> DataFrame:
    """Profiles of each defect's name, signature, region, evidence and graph attributes; ``key`` tells the rows apart.

    ``defects``: defect, visual_signature, visual_attributes, region, region_definition,
    critical_check, distinctions.
    """
    differences = F.array_join(F.transform("distinctions", lambda d: F.coalesce(d["difference"], F.lit(""))), " ")
    told = defects.select(
        *key,
        F.col("defect").alias("_name"),
        F.concat_ws(" ", F.coalesce("visual_signature", F.lit("")), differences).alias("_signature"),
        F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in ("region", "region_definition", "critical_check")]).alias("_region"),
        evidence_text(name=F.col("defect"), signature=F.col("visual_signature"), distinctions=F.col("distinctions")).alias("_evidence"),
        F.array_join(F.coalesce("visual_attributes", F.array().cast("array<string>")), " ").alias("_graph"),
    )
    fields = {n: f"_{n}" for n in ("name", "signature", "region", "evidence", "graph")}
    none = F.array().cast("array<string>")
    rows = meet(defects, words.token_sets(told, key, **fields), key, "left")
    rows = rows.withColumns({f"{n}_tokens": F.coalesce(f"{n}_tokens", none) for n in fields})
    rows = hold(rows.withColumns({f"{n}_attrs": T.attribute_hits(f"{n}_tokens") for n in fields if n != "region"}))
    return rows.drop("evidence_tokens", "graph_tokens")


def score_options(pairs: DataFrame, similarity: Column | None = None) -> DataFrame:
    """Score option texts against defects. ``pairs`` has option_tokens, option_attrs and the
    columns of ``defect_evidence``."""
    return _judged(_compared(pairs), similarity)


def _compared(pairs: DataFrame) -> DataFrame:
    """What the two texts of a pair share and the parts of the score that no encoder changes (columns ``_...``)."""
    option = F.col("option_attrs")
    rows = pairs.withColumns(
        {
            "_name": F.array_intersect("option_tokens", "name_tokens"),
            "_sig": F.array_intersect("option_tokens", "signature_tokens"),
            "_reg": F.array_intersect("option_tokens", "region_tokens"),
            "attribute_overlap": T.attribute_overlap(option, F.col("evidence_attrs")),
            "signature_attribute_overlap": T.attribute_overlap(option, F.col("signature_attrs")),
            "name_attribute_overlap": T.attribute_overlap(option, F.col("name_attrs")),
            "graph_attribute_overlap": T.attribute_overlap(option, F.col("graph_attrs")),
        }
    )
    weak = T.weak_tokens()
    counts = {n: T.term_count(F.col(f"{n}attribute_overlap")) for n in ("", "signature_", "name_", "graph_")}
    rows = rows.withColumns(
        {
            "_strong_name": F.array_except("_name", weak),
            "_strong_sig": F.array_except("_sig", weak),
            "attribute_term_count": counts[""] + counts["name_"] + counts["graph_"],
            "source_attribute_term_count": counts["signature_"] + counts["graph_"],
        }
    )
    strong_name, strong_sig = F.size("_strong_name"), F.size("_strong_sig")
    visual = (
        (F.trim(F.coalesce("visual_signature", F.lit(""))) != "")
        | (F.size(F.coalesce("visual_attributes", F.array().cast("array<string>"))) > 0)
        | F.exists("distinctions", lambda d: F.trim(F.coalesce(d["difference"], F.lit(""))) != "")
    )
    signal = (
        strong_name * 2.4
        + strong_sig * 1.0
        + F.size("attribute_overlap") * 1.45
        + F.size("name_attribute_overlap") * 0.7
        + F.size("graph_attribute_overlap") * 1.2
        + F.col("attribute_term_count") * 0.18
    )
    known = F.array_union(F.array_union("name_tokens", "signature_tokens"), F.col("region_tokens"))
    contained = (F.size("option_tokens") > 0) & (F.size(F.array_except("option_tokens", known)) == 0)
    extra = (
        (F.size("_name") - strong_name) * 0.55
        + (F.size("_sig") - strong_sig) * 0.3
        + F.size("_reg") * 0.2
        + F.when(contained, 0.4).otherwise(0.0)
    )
    rows = rows.withColumns(
        {
            "_signal": signal,
            "_extra": extra,
            "_visual": visual,
            "evidence_tokens": F.array_sort(F.array_union("_strong_name", "_strong_sig")),
            "_support": _channels(
                {
                    "defect_name": strong_name > 0,
                    "visual_signature": strong_sig > 0,
                    "visual_attribute": F.size("attribute_overlap") > 0,
                    "defect_name_attribute": F.size("name_attribute_overlap") > 0,
                    "graph_visual_attribute": F.size("graph_attribute_overlap") > 0,
                }
            ),
            "_source": _channels(
                {
                    "visual_signature": strong_sig > 0,
                    "visual_signature_attribute": F.size("signature_attribute_overlap") > 0,
                    "graph_visual_attribute": F.size("graph_attribute_overlap") > 0,
                }
            ),
        }
    )
    return hold(rows.drop("_name", "_sig", "_reg", "_strong_name", "_strong_sig"))


def _judged(rows: DataFrame, similarity: Column | None = None) -> DataFrame:
    """Scores, channels and agreement of compared pairs with an encoder's similarity."""
    sim = F.coalesce(similarity, F.lit(0.0)) if similarity is not None else F.lit(0.0)
    signal = F.col("_signal") + F.greatest(F.lit(0.0), sim - 0.48) * 3.0
    rows = rows.withColumns(
        {
            "signal_score": signal,
            "score": signal + F.col("_extra"),
            "support_channels": F.concat("_support", _channels({"semantic_embedding": sim >= 0.58})),
            "source_evidence_channels": F.concat("_source", _channels({"semantic_embedding": (sim >= 0.58) & F.col("_visual")})),
        }
    )
    agreed = consensus(F.col("support_channels"), F.col("attribute_term_count"), F.round(sim, 4))
    sourced = F.size("source_evidence_channels") > 0
    rows = rows.withColumns({"label_only_match": ~sourced, "evidence_consensus": agreed & sourced})
    return hold(rows.drop("_signal", "_extra", "_visual", "_support", "_source"))


def _option_profiles(options: DataFrame) -> DataFrame:
    """Distinct option texts that have a token, profiled."""
    rows = words.profiles(options.select("option_text").distinct(), ["option_text"], option="option_text")
    return rows.where(F.size("option_tokens") > 0)


def _option_sides(options: DataFrame, defects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct (category, option text) and the defects, both profiled; each text and each defect once."""
    texts = meet(options.select("category", "option_text").distinct(), _option_profiles(options), ["option_text"])
    return texts, defect_evidence(defects, ["category", "defect_order"])


def _index_sides(options: DataFrame, defects: DataFrame, option_features: Column, defect_features: Column) -> tuple[DataFrame, ...]:
    """The profiles of the distinct option texts and of the distinct evidences, and the two sides of the index.

    The sides are slim: keys and ``features``; a defect's evidence is known by its digest ``_content``.
    """
    digest = F.unhex(F.sha2(F.to_json(F.struct(*EVIDENCE)), 256)).alias("_content")
    told = _option_profiles(options)
    contents = defect_evidence(defects.select(*EVIDENCE).distinct().select("*", digest), ["_content"])
    left = meet(options.select("category", "option_text").distinct(), told.select("option_text", option_features.alias("features")), ["option_text"])
    slim = defects.select(*[c for c in defects.columns if c not in EVIDENCE], digest)
    return told, contents, left, meet(slim, contents.select("_content", defect_features.alias("features")), ["_content"])


def _with_profiles(pairs: DataFrame, told: DataFrame, contents: DataFrame) -> DataFrame:
    """Distinct (option_text, _content, ...) with the profiles of both."""
    return meet(meet(pairs.distinct(), told, ["option_text"]), contents, ["_content"])


def _unprofiled(rows: DataFrame) -> DataFrame:
    return rows.drop(*[f"{n}_{part}" for n in ("option", "name", "signature", "region") for part in ("tokens", "attrs")], "evidence_attrs", "graph_attrs")


def option_scores(options: DataFrame, defects: DataFrame) -> DataFrame:
    """Every option text against the defects of its category that share any token or attribute with it (score above 0)."""
    every = F.array_union(F.array_union("name_tokens", "signature_tokens"), F.col("region_tokens"))
    told, contents, left, right = _index_sides(
        options,
        defects,
        F.array_union("option_tokens", TI.attributes("option_attrs")),
        F.array_union(every, TI.attributes("name_attrs", "signature_attrs", "evidence_attrs", "graph_attrs")),
    )
    met = TI.meeting(left, right, ["category"]).drop("shared")
    scored = score_options(_with_profiles(met.select("option_text", "_content"), told, contents)).where("score > 0")
    return meet(met, _unprofiled(scored), ["option_text", "_content"]).drop("_content")


def _could_match(min_score: float) -> Column:
    """Whether a pair of these shared features can agree and reach the score, whatever else it shares."""
    tokens, attributes = TI.split("shared")
    weak = F.size("option_tokens") - F.size(TI.strong("option_tokens"))
    hit_terms = T.term_count(F.col("option_attrs"))
    known_terms = T.term_count(F.col("evidence_attrs")) + T.term_count(F.col("name_attrs")) + T.term_count(F.col("graph_attrs"))
    most = F.size(tokens) * 3.4 + attributes * 3.35 + F.when(attributes > 0, (hit_terms * 3 + known_terms) * 0.18).otherwise(0.0)
    most = most + weak * 0.85 + F.size("option_tokens") * 0.2 + 0.4
    # without attributes only the name and the signature are left as channels: both are needed
    both = F.arrays_overlap(tokens, "name_tokens") & F.arrays_overlap(tokens, "signature_tokens")
    return ((attributes > 0) | both) & (most >= min_score)


def match_options(options: DataFrame, defects: DataFrame, *, min_score: float = 1.6, floor: float = 0.75, top: int = 3, similarity: DataFrame | None = None):
    """Best defects per answer option within its category.

    ``options``: category, question_id, option_key, option_text. ``defects``: category and defect_order (one row each) plus the
    inputs of ``defect_evidence``. Each option text is scored once against each different evidence it meets, however many categories
    ask or show it. Pairs come from the index of ``textindex``; one that cannot reach ``min_score`` is never scored. ``similarity``: rows (category, option_text, defect_order,
    similarity) of an optional encoder, such as the nearest defects of each option by ``vectors.top_k``.
    """
    told, contents, left, right = _index_sides(
        options,
        defects,
        F.array_union(TI.strong("option_tokens"), TI.attributes("option_attrs")),
        F.array_union(TI.strong("name_tokens", "signature_tokens"), TI.attributes("name_attrs", "evidence_attrs", "graph_attrs")),
    )
    met, pair = TI.meeting(left, right, ["category"]), ["option_text", "_content"]
    good = (F.col("signal_score") > 0) & F.col("evidence_consensus") & (F.col("score") >= min_score)
    if similarity is None:
        pairs = _with_profiles(met.select(*pair, "shared"), told, contents).where(_could_match(min_score)).drop("shared")
        scored = meet(met.drop("shared"), _unprofiled(score_options(pairs).where(good)), pair)
    else:
        key = ["category", "option_text", "defect_order"]
        near = similarity.select(*key, F.col("similarity").cast("double"))
        # what the encoder finds without a shared feature; it has to count as a channel
        others = meet(near.where("similarity >= 0.58"), met.select(*key), key, "left_anti")
        others = meet(meet(others, left.drop("features"), ["category", "option_text"]), right.drop("features"), ["category", "defect_order"])
        met = meet(met.drop("shared"), near, key, "left").unionByName(others)
        compared = _unprofiled(_compared(_with_profiles(met.select(*pair), told, contents)))
        scored = _judged(meet(met, compared, pair), F.col("similarity")).drop("similarity").where(good)
    scored = scored.drop("_content")
    strength = [F.desc("score"), F.desc("signal_score"), F.desc(F.size("evidence_tokens")), F.asc("defect_order")]
    per_text = W.partitionBy("category", "option_text")
    scored = scored.withColumn("_nth", F.row_number().over(W.partitionBy("category", "option_text", "defect").orderBy(*strength)))
    unique = scored.where("_nth = 1").withColumn("_best", F.max("score").over(per_text))
    share = F.when(T.is_compound(F.col("option_text")), 0.45).otherwise(floor)
    kept = unique.where(F.col("score") >= F.greatest(F.lit(min_score), F.col("_best") * share))
    ranked = kept.withColumn("match_rank", F.row_number().over(per_text.orderBy(*strength))).where(F.col("match_rank") <= top)
    return meet(options, ranked.drop("_nth", "_best"), ["category", "option_text"])


def discriminative(matches: DataFrame, options: DataFrame) -> DataFrame:
    """Whether a question's option matches tell its options apart: question_id, match_count, discriminative, matched.

    ``matches`` as from ``match_options``; ``options`` gives the number of options. ``matched`` lists the question's options that
    have matches, by key, each with its defects in order.
    """
    asked = options.groupBy("question_id").agg(F.count(F.lit(1)).alias("option_count"))
    per_option = matches.groupBy("question_id", "option_key").agg(
        F.array_sort(F.collect_set("defect")).alias("defects"),
        F.max(F.when(F.col("match_rank") == 1, F.round("signal_score", 3))).alias("signal"),
    )
    per_question = per_option.groupBy("question_id").agg(
        F.count(F.lit(1)).alias("match_count"),
        F.array_sort(F.collect_list(F.struct("option_key", "defects"))).alias("matched"),
        F.max("signal").alias("signal"),
    )
    sets = F.size(F.array_distinct(F.col("matched")["defects"]))
    many = F.col("option_count") > 1
    decided = (
        F.when(many & (F.col("match_count") < 2), F.col("signal") >= 3.2)
        .when(many & (sets < 2), False)
        .otherwise(True)
    )
    return meet(per_question, asked, ["question_id"]).select("question_id", "match_count", decided.alias("discriminative"), "matched")


def rank_reports(reports: DataFrame, defects: DataFrame, *, top: int = 3, min_signal: float = 1.6, similarity: DataFrame | None = None) -> DataFrame:
    """Defect hypotheses per visual report within its category; normal reports give none.

    ``reports``: category, report_id, report. ``defects``: category, defect_order (one row each), defect_node
    and evidence fields. Each report text is scored once against each different evidence it meets, by the index of ``textindex``. ``similarity``: rows (category, report,
    defect_order, similarity) of an optional encoder.
    """
    told = reports.select("report").distinct().withColumn("_text", T.normalize_text(F.col("report"))).where("_text <> ''")
    affirmed = words.affirming(told.where(T.has_normal_phrase(F.col("_text"))), ["report"], F.col("_text"), T.ANOMALY_WORDS)
    told = meet(told, affirmed.withColumn("_affirmed", F.lit(True)), ["report"], "left")
    told = told.where(~T.has_normal_phrase(F.col("_text")) | F.col("_affirmed").isNotNull()).select("report")
    stated = defects.select(
        "category",
        "defect_order",
        "defect_node",
        "defect",
        "region",
        evidence_text(
            name=F.col("defect"),
            signature=F.col("visual_signature"),
            attributes=F.col("visual_attributes"),
            distinctions=F.col("distinctions"),
            targets=False,
        ).alias("evidence"),
    )
    profiles = words.profiles(told, ["report"], report="report").where(F.size("report_tokens") > 0)
    contents = words.profiles(stated.select("evidence").distinct(), ["evidence"], evidence="evidence")
    # without an encoder a pair needs a strong token and an attribute, so only tokens are posted and both sides have attributes
    if similarity is None:
        some = lambda c: F.size(F.map_keys(c)) > 0
        profiles, contents = profiles.where(some("report_attrs")), contents.where(some("evidence_attrs"))
    digest = F.unhex(F.sha2("evidence", 256)).alias("_content")
    contents = contents.select(digest, "evidence_tokens", "evidence_attrs")
    left = meet(reports.select("category", "report").distinct(), profiles.select("report", TI.strong("report_tokens").alias("features")), ["report"])
    right = meet(stated.select("*", digest).drop("evidence"), contents.select("_content", TI.strong("evidence_tokens").alias("features")), ["_content"])
    met, pair, key = TI.meeting(left, right, ["category"]).drop("shared"), ["report", "_content"], ["category", "report", "defect_order"]
    profiled_pairs = lambda rows: meet(meet(rows, profiles, ["report"]), contents, ["_content"])
    if similarity is None:
        pairs = profiled_pairs(met.select(*pair).distinct())
        pairs = pairs.where(F.arrays_overlap(F.map_keys("report_attrs"), F.map_keys("evidence_attrs")))
        scored = score_pairs(pairs, "report", "evidence")
    else:
        near = similarity.select(*key, F.col("similarity").cast("double"))
        others = meet(near.where("similarity >= 0.58"), met.select(*key), key, "left_anti")
        others = meet(meet(others, left.drop("features"), ["category", "report"]), right.drop("features"), ["category", "defect_order"])
        scored = score_pairs(profiled_pairs(meet(met, near, key, "left").unionByName(others)), "report", "evidence", F.col("similarity"))
    usable = (F.size("support_channels") == 0) | F.arrays_overlap("support_channels", T.words(["lexical_overlap", "semantic_embedding"]))
    scored = scored.where(F.col("evidence_consensus") & usable & (F.col("signal_score") >= min_signal))
    scored = scored.withColumns({"score": F.round("score", 3), "signal_score": F.round("signal_score", 3)})
    scored = scored.drop("report_tokens", "report_attrs", "evidence_tokens", "evidence_attrs")
    if similarity is None:
        scored = meet(met, scored, pair)
    scored = scored.drop("_content")
    place = F.row_number().over(
        W.partitionBy("category", "report").orderBy(
            F.desc("score"), F.desc("signal_score"), F.desc("attribute_term_count"), F.asc("defect_order")
        )
    )
    return meet(reports, scored.withColumn("rank", place).where(F.col("rank") <= top), ["category", "report"])


def decisive(rows: DataFrame, group: list[str], order: list[Column], margin: float = 0.9) -> DataFrame:
    """Best row per group and whether it leads the runner-up by ``margin``; needs score and signal_score."""
    window = W.partitionBy(*group).orderBy(*order)
    ahead = F.col("score") - F.lead("score").over(window)
    rows = rows.withColumns({"_place": F.row_number().over(window), "_ahead": ahead}).where("_place = 1")
    return rows.withColumn(
        "decisive", (F.col("signal_score") > 0) & (F.col("_ahead").isNull() | (F.col("_ahead") >= margin))
    ).drop("_place", "_ahead")
