"""Text evidence: tokens, profiles, negation, pair scores, option and report matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import lexicon as L
from plumbline.functions import text as T
from plumbline.operators import evidence as E
from plumbline.operators import words
from plumbline.operators.joins import meet
from plumbline.plans import textsql as S
from plumbline.plans.fixtures import KB_SQL, knowledge
from plumbline.plans.registry import query, table

REPORTS = [
    "A jagged crack runs along the rim and the material is split",
    "No defects detected, the surface matches the normal standard",
    "Normal finish but a round hole puncture is visible",
    "Loose fuzzy fibers and torn weaving near the left edge",
    "Without any visible anomalies",
    "Shiny foreign metallic contamination on the core",
    "The inserted board hole is normal",
    "Faded ink stains discolor the printed surface",
    "The component is missing, an empty gap remains",
    "There is no crack and no scratch; everything is normal",
    "Slight scrape at the seam, layer texture is irregular",
    "Warped outline, bent geometry",
]
OPTIONS = [
    "Crack with jagged fracture",
    "Scratch",
    "Missing part",
    "Bent edge and deformation",
    "Stain or ink print",
    "Round hole",
    "Foreign metal contamination",
    "Frayed thread weaving",
    "crack, hole",
    "No defect",
    "surface color",
    "Torn fibers at the upper left corner",
]


def _pick(values, index):
    return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))


def _sql_pick(values, index):
    return f"list_extract([{', '.join(repr(v) for v in values)}], CAST({index} AS INTEGER) + 1)"


REPORT_SQL = f"""reports AS (SELECT doc_id, {_sql_pick(REPORTS, 'doc_id % 12')} || CASE WHEN doc_id % 3 = 0 THEN '. ' || text ELSE '' END AS report,
  {_sql_pick(OPTIONS, 'doc_id % 7 + doc_id % 5')} AS option_text FROM documents)"""


def reports(spark, folder):
    doc = F.col("doc_id")
    phrase = _pick(REPORTS, doc % 12)
    return table(spark, folder, "documents").select(
        "doc_id",
        F.when(doc % 3 == 0, F.concat(phrase, F.lit(". "), "text")).otherwise(phrase).alias("report"),
        _pick(OPTIONS, doc % 7 + doc % 5).alias("option_text"),
    )


@query(
    "txt1_normalized_words",
    f"""WITH n AS (SELECT doc_id, trim(regexp_replace(replace(lower(text), '_', ' '), '\\s+', ' ', 'g')) AS normal FROM documents),
    w AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(normal, '[a-z0-9]+')) AS raw FROM n), s AS (SELECT doc_id, {S.spelled('raw')} AS s FROM w),
    t AS (SELECT doc_id, {S.stem('s')} AS t FROM s), f AS (SELECT DISTINCT doc_id, {S.spelled('t')} AS tok FROM t)
    SELECT doc_id, any_value(normal) AS normalized, count(tok) AS words, coalesce(string_agg(tok, ' ' ORDER BY tok), '') AS stems FROM n LEFT JOIN f USING (doc_id) GROUP BY doc_id""",
)
def normalized_words(spark, folder):
    rows = table(spark, folder, "documents").select("doc_id", T.normalize_text(F.col("text")).alias("normalized"))
    rows = rows.withColumn("raw", F.array_distinct(T.raw_tokens(F.col("normalized"))))
    rows = rows.withColumn("s", F.array_sort(F.array_distinct(T.normalized_each("raw"))))
    return rows.select("doc_id", "normalized", F.size("s").cast("long").alias("words"), F.array_join("s", " ").alias("stems"))


@query(
    "txt2_token_sets",
    "WITH "
    + S.tokens("toks", "documents", "doc_id", "text")
    + " SELECT d.doc_id, count(tok) AS token_count, coalesce(string_agg(tok, ' ' ORDER BY tok), '') AS tokens FROM documents d LEFT JOIN toks USING (doc_id) GROUP BY d.doc_id",
)
def token_sets(spark, folder):
    docs = table(spark, folder, "documents")
    rows = docs.select("doc_id").join(words.token_sets(docs, ["doc_id"], t="text"), "doc_id", "left")
    return rows.select(
        "doc_id", F.coalesce(F.size("t_tokens"), F.lit(0)).cast("long").alias("token_count"), F.coalesce(F.array_join("t_tokens", " "), F.lit("")).alias("tokens")
    )


PROFILE_SQL = (
    "WITH " + REPORT_SQL + ", " + S.LEXICON + ", " + S.tokens("lt", "reports", "doc_id", "report") + ", " + S.hits("lh", "lt", "doc_id")
)


@query(
    "txt3_attribute_profile",
    PROFILE_SQL
    + """, a AS (SELECT doc_id, attr, string_agg(tok, ', ' ORDER BY tok) AS toks, count(*) AS n FROM lh GROUP BY ALL)
    SELECT r.doc_id, count(attr) AS attributes, coalesce(CAST(sum(n) AS BIGINT), 0) AS terms, coalesce(string_agg(attr || '(' || toks || ')', '; ' ORDER BY attr), '') AS profile
    FROM reports r LEFT JOIN a USING (doc_id) GROUP BY r.doc_id""",
)
def attribute_profile(spark, folder):
    rows = words.profiles(reports(spark, folder), ["doc_id"], r="report")
    return rows.select(
        "doc_id",
        F.size("r_attrs").cast("long").alias("attributes"),
        T.term_count(F.col("r_attrs")).cast("long").alias("terms"),
        T.overlap_text(F.col("r_attrs")).alias("profile"),
    )


PAIR_SQL = (
    PROFILE_SQL
    + ", "
    + S.tokens("rt", "reports", "doc_id", "option_text")
    + ", "
    + S.hits("rh", "rt", "doc_id")
    + """, doc_pairs AS (SELECT doc_id, doc_id AS oid FROM reports), rto AS (SELECT doc_id AS oid, tok FROM rt), rho AS (SELECT doc_id AS oid, attr, tok FROM rh), """
    + S.shared("sh", "doc_pairs", "lt", "doc_id", "rto", "oid")
    + ", "
    + S.overlap("ov", "doc_pairs", "lh", "doc_id", "rho", "oid")
    + """, sized AS (SELECT r.doc_id, coalesce(strong, 0) AS strong, coalesce(weak, 0) AS weak, coalesce(attrs, 0) AS attrs, coalesce(terms, 0) AS terms,
      coalesce(toks, '') AS toks, coalesce(strong_toks, '') AS strong_toks, coalesce(listing, '') AS listing
      FROM reports r LEFT JOIN sh USING (doc_id) LEFT JOIN ov USING (doc_id))"""
)


def _pairs(spark, folder):
    return words.profiles(reports(spark, folder), ["doc_id"], report="report", option="option_text")


@query("set1_token_intersections", PAIR_SQL + " SELECT doc_id, toks AS shared, strong_toks AS strong FROM sized")
def token_intersections(spark, folder):
    shared = F.array_sort(F.array_intersect("report_tokens", "option_tokens"))
    return _pairs(spark, folder).select(
        "doc_id",
        F.array_join(shared, ",").alias("shared"),
        F.array_join(F.array_except(shared, T.weak_tokens()), ",").alias("strong"),
    )


@query(
    "set2_token_subset",
    PAIR_SQL
    + """ SELECT r.doc_id, count(rt.tok) AS option_tokens, count(rt.tok) FILTER (rt.tok NOT IN (SELECT tok FROM lt WHERE lt.doc_id = r.doc_id)
       AND rt.tok NOT IN ('rim', 'edge', 'corner')) = 0 AS contained FROM reports r LEFT JOIN rt USING (doc_id) GROUP BY r.doc_id""",
)
def token_subset(spark, folder):
    known = F.array_union("report_tokens", T.words(["rim", "edge", "corner"]))
    return _pairs(spark, folder).select(
        "doc_id",
        F.size("option_tokens").cast("long").alias("option_tokens"),
        (F.size(F.array_except("option_tokens", known)) == 0).alias("contained"),
    )


@query("set3_attribute_overlap", PAIR_SQL + " SELECT doc_id, attrs, terms, listing FROM sized")
def attribute_overlap(spark, folder):
    rows = _pairs(spark, folder).withColumn("o", T.attribute_overlap(F.col("report_attrs"), F.col("option_attrs")))
    return rows.select(
        "doc_id",
        F.size("o").cast("long").alias("attrs"),
        T.term_count(F.col("o")).cast("long").alias("terms"),
        T.overlap_text(F.col("o")).alias("listing"),
    )


PAIR_CONSENSUS = S.consensus(["(strong > 0)", "(attrs > 0)"], "(attrs > 0)", None, "terms")


@query(
    "txt5_pair_scores",
    PAIR_SQL
    + f""" SELECT doc_id, round(1.2::DOUBLE * strong + 0.25::DOUBLE * weak + 1.35::DOUBLE * attrs + 0.18::DOUBLE * terms, 6) AS score,
      round(1.2::DOUBLE * strong + 1.35::DOUBLE * attrs + 0.18::DOUBLE * terms, 6) AS signal_score,
      CASE WHEN strong > 0 AND attrs > 0 THEN 'lexical_overlap,visual_attribute' WHEN strong > 0 THEN 'lexical_overlap' WHEN attrs > 0 THEN 'visual_attribute' ELSE '' END AS channels,
      {PAIR_CONSENSUS} AS evidence_consensus FROM sized""",
)
def pair_scores(spark, folder):
    out = E.score_pairs(_pairs(spark, folder), "report", "option")
    return out.select(
        "doc_id",
        F.round("score", 6).alias("score"),
        F.round("signal_score", 6).alias("signal_score"),
        F.array_join("support_channels", ",").alias("channels"),
        "evidence_consensus",
    )


NORMAL_RE = "|".join(p.replace("\\", "\\") for p in L.NORMAL_PHRASES)
REPORT_TEXT = "trim(regexp_replace(replace(lower(report), '_', ' '), '\\s+', ' ', 'g'))"
NORMAL_SQL = (
    "norm AS (SELECT doc_id, "
    + REPORT_TEXT
    + " AS txt FROM reports), "
    + S.affirmed("aff", "norm", "doc_id", "txt", T.ANOMALY_WORDS)
    + f", verdict AS (SELECT n.doc_id, regexp_matches(txt, '{NORMAL_RE}') AS phrase, coalesce(yes, false) AS affirmed FROM norm n LEFT JOIN aff USING (doc_id))"
)


@query("txt8_normal_reports", "WITH " + REPORT_SQL + ", " + NORMAL_SQL + " SELECT doc_id, phrase AS normal_phrase, phrase AND NOT affirmed AS is_normal FROM verdict")
def normal_reports(spark, folder):
    rows = reports(spark, folder).select("doc_id", T.normalize_text(F.col("report")).alias("n"))
    rows = rows.withColumn("normal_phrase", T.has_normal_phrase(F.col("n")))
    affirmed = words.affirming(rows.where("normal_phrase"), ["doc_id"], F.col("n"), T.ANOMALY_WORDS).withColumn("affirmed", F.lit(True))
    rows = rows.drop("n").join(affirmed, "doc_id", "left")
    return rows.select("doc_id", "normal_phrase", (F.col("normal_phrase") & F.col("affirmed").isNull()).alias("is_normal"))


@query(
    "dec4_normal_without_evidence",
    "WITH "
    + REPORT_SQL
    + ", low AS (SELECT doc_id, lower(report) AS txt FROM reports), "
    + S.affirmed("aff", "low", "doc_id", "txt", L.DECISIVE_TERMS)
    + f""", surf AS (SELECT doc_id, bool_or(tok IN {S.quoted(L.SURFACE_TERMS)}) AS surface FROM aff_n GROUP BY doc_id)
    SELECT r.doc_id, r.doc_id % 4 <> 0 AND r.doc_id % 5 <> 0 AND r.doc_id % 3 <> 1 AND coalesce(surface, false) AND NOT coalesce(yes, false) AS prefers_normal
    FROM reports r LEFT JOIN aff USING (doc_id) LEFT JOIN surf USING (doc_id)""",
)
def normal_without_evidence(spark, folder):
    doc = F.col("doc_id")
    yes_no = F.create_map(F.lit("A"), F.lit("Yes"), F.lit("B"), F.lit("No"))
    other = F.create_map(F.lit("A"), F.lit("Left"), F.lit("B"), F.lit("Right"))
    rows = reports(spark, folder).withColumn("low", F.lower("report")).withColumn("w", T.ordered_tokens("low"))
    return rows.select(
        "doc_id",
        T.prefers_normal(
            F.when(doc % 4 == 0, "Defect Analysis").otherwise("Anomaly Detection"),
            F.when(doc % 5 == 0, other).otherwise(yes_no),
            doc % 3 == 1,
            F.col("w"),
        ).alias("prefers_normal"),
    )


# --- options against the defects of a category -----------------------------------------


def defects(spark, folder):
    """Defect rows of every knowledge base, in file order."""
    kb = knowledge(spark, folder)
    rows = kb.select("category", F.col("kb.target_object").alias("target"), F.posexplode(F.map_entries("kb.regions")).alias("pos", "r"))
    rows = rows.select("category", "target", "pos", F.col("r.key").alias("region"), "r.value.*")
    rows = rows.select("*", F.posexplode("defects").alias("k", "d"))
    node = F.concat_ws("_", "region", "d.type")
    return rows.select(
        "category",
        (F.col("pos") * 2 + F.col("k")).alias("defect_order"),
        "region",
        F.col("definition").alias("region_definition"),
        "critical_check",
        node.alias("defect_node"),
        F.concat_ws(" -> ", "target", "region", node).alias("graph_path"),
        F.col("d.type").alias("defect"),
        F.col("d.visual_signature").alias("visual_signature"),
        F.col("d.contrast_vs_normal").alias("contrast_vs_normal"),
        F.col("d.visual_attributes").alias("visual_attributes"),
        F.col("d.distinctions").alias("distinctions"),
    )


def options(spark, folder):
    part = F.col("p_partkey")
    rows = table(spark, folder, "part").select(
        part.alias("question_id"),
        F.concat(F.lit("part_"), part.cast("string")).alias("category"),
        F.posexplode(F.array(*[_pick(OPTIONS, (part * (1 + i % 3) + i * 3 + F.col("p_size")) % 12) for i in range(4)])).alias("at", "option_text"),
    )
    return rows.select("question_id", "category", _pick("ABCD", F.col("at")).alias("option_key"), "option_text")


OPTION_SQL = (
    KB_SQL
    + f""", asked AS (SELECT p_partkey, i, substr('ABCD', CAST(i + 1 AS INTEGER), 1) AS option_key, (p_partkey * (1 + i % 3) + i * 3 + p_size) % 12 AS oid
      FROM part, (SELECT unnest(range(4)) AS i)),
    phrases AS (SELECT CAST(i AS BIGINT) AS oid, {_sql_pick(OPTIONS, 'i')} AS txt FROM (SELECT unnest(range(12)) AS i)),
    dd AS (SELECT p_partkey, pos * 2 + k AS ord, region, type, signature, coalesce(array_to_string(attributes, ' '), '') AS attr_text, coalesce(target_defect, '') AS target, coalesce(difference, '') AS diff,
       region || ' ' || definition || ' ' || critical_check AS region_text, len(attributes) AS n_attr FROM kb_defects),
    variants AS (SELECT row_number() OVER (ORDER BY type, target, diff, region_text) AS vid, * FROM (SELECT DISTINCT type, signature, attr_text, target, diff, region_text, n_attr FROM dd)),
    du AS (SELECT d.p_partkey, d.ord, d.region, v.* FROM dd d JOIN variants v USING (type, signature, attr_text, target, diff, region_text)),
    pairs AS (SELECT oid, vid FROM phrases, variants), """
    + S.LEXICON
    + ", "
    + ", ".join(
        [
            S.tokens("ot", "phrases", "oid", "txt"),
            S.tokens("nt", "variants", "vid", "type"),
            S.tokens("st", "variants", "vid", "(signature || ' ' || diff)"),
            S.tokens("gt", "variants", "vid", "region_text"),
            S.tokens("et", "variants", "vid", "(type || ' ' || signature || ' ' || target || ' ' || diff)"),
            S.tokens("at_", "variants", "vid", "attr_text"),
            S.hits("oh", "ot", "oid"),
            S.hits("nh", "nt", "vid"),
            S.hits("sh_", "st", "vid"),
            S.hits("eh", "et", "vid"),
            S.hits("ah", "at_", "vid"),
            S.shared("s_name", "pairs", "ot", "oid", "nt", "vid"),
            S.shared("s_sig", "pairs", "ot", "oid", "st", "vid"),
            S.shared("s_reg", "pairs", "ot", "oid", "gt", "vid"),
            S.overlap("o_ev", "pairs", "oh", "oid", "eh", "vid"),
            S.overlap("o_sig", "pairs", "oh", "oid", "sh_", "vid"),
            S.overlap("o_name", "pairs", "oh", "oid", "nh", "vid"),
            S.overlap("o_graph", "pairs", "oh", "oid", "ah", "vid"),
        ]
    )
    + """, counts AS (SELECT p.oid, p.vid, coalesce(n.strong, 0) AS sn, coalesce(n.weak, 0) AS wn, coalesce(s.strong, 0) AS ss, coalesce(s.weak, 0) AS ws,
      coalesce(g.strong + g.weak, 0) AS rg, coalesce(e.attrs, 0) AS ea, coalesce(oi.attrs, 0) AS sa, coalesce(na.attrs, 0) AS na, coalesce(ga.attrs, 0) AS ga,
      coalesce(e.terms, 0) + coalesce(na.terms, 0) + coalesce(ga.terms, 0) AS terms,
      n.strong_toks AS t1, s.strong_toks AS t2
      FROM pairs p LEFT JOIN s_name n USING (oid, vid) LEFT JOIN s_sig s USING (oid, vid) LEFT JOIN s_reg g USING (oid, vid) LEFT JOIN o_ev e USING (oid, vid)
      LEFT JOIN o_sig oi USING (oid, vid) LEFT JOIN o_name na USING (oid, vid) LEFT JOIN o_graph ga USING (oid, vid)),
    cover AS (SELECT p.oid, p.vid, count(*) AS n, count(*) FILTER (NOT EXISTS (SELECT 1 FROM (SELECT vid, tok FROM nt UNION SELECT vid, tok FROM st UNION SELECT vid, tok FROM gt) k
       WHERE k.vid = p.vid AND k.tok = ot.tok)) AS missing FROM pairs p JOIN ot USING (oid) GROUP BY ALL),
    rated AS (SELECT c.*, 2.4::DOUBLE * sn + ss + 1.45::DOUBLE * ea + 0.7::DOUBLE * na + 1.2::DOUBLE * ga + 0.18::DOUBLE * terms AS signal,
       0.55::DOUBLE * wn + 0.3::DOUBLE * ws + 0.2::DOUBLE * rg + CASE WHEN coalesce(v.n, 0) > 0 AND v.missing = 0 THEN 0.4::DOUBLE ELSE 0 END AS extra,
       (ss > 0 OR sa > 0 OR ga > 0) AS sourced, len(list_distinct(string_split(coalesce(t1, '') || ',' || coalesce(t2, ''), ','))) AS ev FROM counts c LEFT JOIN cover v USING (oid, vid)),
    scored AS (SELECT *, signal + extra AS score, sourced AND """
    + S.consensus(["(sn > 0)", "(ss > 0)", "(ea > 0)", "(na > 0)", "(ga > 0)"], "(ea > 0)", "(ga > 0)", "terms")
    + """ AS agreed FROM rated),
    cand AS (SELECT a.p_partkey, a.option_key, a.oid, d.ord, d.region, d.type, s.score, s.signal, s.ev FROM (SELECT DISTINCT p_partkey, option_key, oid FROM asked) a JOIN du d USING (p_partkey)
      JOIN scored s ON s.oid = a.oid AND s.vid = d.vid WHERE signal > 0 AND agreed AND score >= 1.6::DOUBLE),
    uniq AS (SELECT *, max(score) OVER (PARTITION BY p_partkey, option_key) AS best FROM (SELECT *, row_number() OVER (PARTITION BY p_partkey, option_key, type ORDER BY score DESC, signal DESC, ev DESC, ord) AS nth FROM cand) WHERE nth = 1),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY p_partkey, option_key ORDER BY score DESC, signal DESC, ev DESC, ord) AS match_rank FROM uniq
      WHERE score >= greatest(1.6::DOUBLE, best * CASE WHEN oid IN (3, 8) THEN 0.45::DOUBLE ELSE 0.75::DOUBLE END)),
    matched AS (SELECT * FROM ranked WHERE match_rank <= 3),
    per_option AS (SELECT p_partkey, option_key, string_agg(type, ',' ORDER BY type) AS defs, max(round(signal, 3)) FILTER (match_rank = 1) AS signal FROM matched GROUP BY ALL),
    told AS (SELECT p_partkey, count(*) AS match_count, CASE WHEN count(*) < 2 THEN max(signal) >= 3.2::DOUBLE WHEN count(DISTINCT defs) < 2 THEN false ELSE true END AS discriminative
      FROM per_option GROUP BY p_partkey)"""
)


@query(
    "txt6_option_scores",
    "WITH "
    + OPTION_SQL
    + """ SELECT p_partkey AS question_id, option_key, CAST(ord AS INTEGER) AS defect_order, round(score, 4) AS score, round(signal, 4) AS signal_score, agreed AS evidence_consensus, NOT sourced AS label_only_match
      FROM asked JOIN du USING (p_partkey) JOIN scored USING (oid, vid) WHERE signal + extra > 0""",
)
def option_scores(spark, folder):
    """Every option against the defects of its category that share any token or attribute with it."""
    opts = options(spark, folder)
    out = meet(opts, E.option_scores(opts, defects(spark, folder)), ["category", "option_text"])
    return out.select(
        "question_id",
        "option_key",
        "defect_order",
        F.round("score", 4).alias("score"),
        F.round("signal_score", 4).alias("signal_score"),
        "evidence_consensus",
        "label_only_match",
    )


def _matches(spark, folder):
    return E.match_options(options(spark, folder), defects(spark, folder))


@query(
    "win7_ranked_defects",
    "WITH " + OPTION_SQL + " SELECT p_partkey AS question_id, option_key, CAST(match_rank AS INTEGER) AS match_rank, type AS defect, region, round(score, 4) AS score FROM matched",
)
def ranked_defects(spark, folder):
    return _matches(spark, folder).select("question_id", "option_key", "match_rank", "defect", "region", F.round("score", 4).alias("score"))


@query(
    "jn5_option_matches",
    "WITH "
    + OPTION_SQL
    + " SELECT p_partkey AS question_id, option_key, count(*) AS matched_defects, any_value(type) FILTER (match_rank = 1) AS defect, round(max(signal) FILTER (match_rank = 1), 3) AS signal_score FROM matched GROUP BY ALL",
)
def option_matches(spark, folder):
    first = F.col("match_rank") == 1
    return _matches(spark, folder).groupBy("question_id", "option_key").agg(
        F.count(F.lit(1)).alias("matched_defects"),
        F.max(F.when(first, F.col("defect"))).alias("defect"),
        F.round(F.max(F.when(first, F.col("signal_score"))), 3).alias("signal_score"),
    )


@query(
    "jn5_matches_with_encoder",
    "WITH "
    + OPTION_SQL
    + """, near AS (SELECT p_partkey, oid, ord, max(CAST((p_partkey * 7 + oid * 13 + ord * 29) % 100 AS DOUBLE) / 100) AS sim FROM (SELECT DISTINCT p_partkey, oid FROM asked) JOIN du USING (p_partkey) GROUP BY ALL),
    near_kept AS (SELECT * FROM near WHERE sim >= 0.4::DOUBLE),
    vis AS (SELECT vid, signature <> '' OR n_attr > 0 OR diff <> '' AS visual FROM variants),
    pool AS (SELECT d.p_partkey, a.oid, d.ord, d.type, d.region, s.*, coalesce(n.sim, 0) AS sim, v.visual FROM (SELECT DISTINCT p_partkey, oid FROM asked) a JOIN du d USING (p_partkey)
      JOIN (SELECT oid AS o, vid, sn, ss, ea, na, ga, sa, terms, signal AS sig0, extra, ev FROM rated) s ON s.o = a.oid AND s.vid = d.vid JOIN vis v ON v.vid = d.vid
      LEFT JOIN near_kept n ON n.p_partkey = d.p_partkey AND n.oid = a.oid AND n.ord = d.ord),
    lit AS (SELECT *, sig0 + greatest(0.0::DOUBLE, sim - 0.48::DOUBLE) * 3 AS signal, CAST(sn > 0 AS INTEGER) + CAST(ss > 0 AS INTEGER) + CAST(ea > 0 AS INTEGER) + CAST(na > 0 AS INTEGER) + CAST(ga > 0 AS INTEGER) + CAST(sim >= 0.58::DOUBLE AS INTEGER) AS ch,
      ss > 0 OR sa > 0 OR ga > 0 OR (sim >= 0.58::DOUBLE AND visual) AS sourced FROM pool),
    fit AS (SELECT *, signal + extra AS score FROM lit WHERE signal > 0 AND sourced AND (ch >= 2 OR (ch = 1 AND ga > 0 AND terms >= 2)
      OR (sn = 0 AND ss = 0 AND na = 0 AND sim < 0.58::DOUBLE AND terms >= 3) OR (ch = 1 AND sim >= 0.68::DOUBLE)) AND signal + extra >= 1.6::DOUBLE),
    one AS (SELECT *, max(score) OVER (PARTITION BY p_partkey, oid) AS best FROM (SELECT *, row_number() OVER (PARTITION BY p_partkey, oid, type ORDER BY round(score, 9) DESC, round(signal, 9) DESC, ev DESC, ord) AS nth FROM fit) WHERE nth = 1),
    place AS (SELECT *, row_number() OVER (PARTITION BY p_partkey, oid ORDER BY score DESC, signal DESC, ev DESC, ord) AS match_rank FROM one WHERE score >= greatest(1.6::DOUBLE, best * CASE WHEN oid IN (3, 8) THEN 0.45::DOUBLE ELSE 0.75::DOUBLE END))
    SELECT a.p_partkey AS question_id, option_key, count(*) AS matched_defects, round(max(score), 4) AS score, count(*) FILTER (sim >= 0.58::DOUBLE) AS similar FROM asked a JOIN place p ON p.p_partkey = a.p_partkey AND p.oid = a.oid WHERE match_rank <= 3 GROUP BY ALL""",
)
def matches_with_encoder(spark, folder):
    """Option matching with an encoder's nearest pairs; a formula over the keys stands for its similarities."""
    opts, known = options(spark, folder), defects(spark, folder)
    phrase = F.array_position(F.array(*[F.lit(o) for o in OPTIONS]), F.col("option_text")) - 1
    near = meet(opts.select("question_id", "category", "option_text").distinct(), known.select("category", "defect_order"), ["category"])
    sim = (F.col("question_id") * 7 + phrase * 13 + F.col("defect_order") * 29) % 100 / 100.0
    near = near.select("category", "option_text", "defect_order", sim.alias("similarity")).where("similarity >= 0.4")
    out = E.match_options(opts, known, similarity=near)
    return out.groupBy("question_id", "option_key").agg(
        F.count(F.lit(1)).alias("matched_defects"),
        F.round(F.max("score"), 4).alias("score"),
        F.count(F.when(F.array_contains("support_channels", "semantic_embedding"), 1)).alias("similar"),
    )


@query("set5_discriminative", "WITH " + OPTION_SQL + " SELECT p_partkey AS question_id, match_count, discriminative FROM told")
def discriminative(spark, folder):
    return E.discriminative(_matches(spark, folder), options(spark, folder)).drop("matched")


@query(
    "rag5_grounding_audit",
    "WITH "
    + OPTION_SQL
    + """ SELECT q.p_partkey AS question_id, coalesce(discriminative, false) AS discriminative, coalesce(match_count, 0) AS raw_match_count,
      CASE WHEN coalesce(discriminative, false) THEN match_count ELSE 0 END AS match_count,
      CASE WHEN coalesce(discriminative, false) THEN listing ELSE '' END AS matches FROM part q LEFT JOIN told USING (p_partkey)
      LEFT JOIN (SELECT p_partkey, string_agg(option_key || '=' || defs, ';' ORDER BY option_key) AS listing FROM per_option GROUP BY p_partkey) USING (p_partkey)""",
)
def grounding_audit(spark, folder):
    """Matches are kept for the audit only when they tell the options apart."""
    opts = options(spark, folder)
    told = E.discriminative(_matches(spark, folder), opts)
    listing = F.array_join(F.transform("matched", lambda m: F.concat_ws("=", m["option_key"], F.array_join(m["defects"], ","))), ";")
    rows = meet(opts.select("question_id").distinct(), told, ["question_id"], "left").withColumn("listing", listing)
    yes = F.coalesce("discriminative", F.lit(False))
    return rows.select(
        "question_id",
        yes.alias("discriminative"),
        F.coalesce("match_count", F.lit(0)).alias("raw_match_count"),
        F.when(yes, F.col("match_count")).otherwise(0).alias("match_count"),
        F.when(yes, F.col("listing")).otherwise("").alias("matches"),
    )


@query(
    "win8_decisive_option",
    "WITH "
    + OPTION_SQL
    + """, tops AS (SELECT p_partkey, option_key, score, signal FROM matched WHERE match_rank = 1),
    o AS (SELECT *, row_number() OVER w AS rn, score - lead(score) OVER w AS ahead FROM tops WINDOW w AS (PARTITION BY p_partkey ORDER BY round(score, 6) DESC, option_key))
    SELECT p_partkey AS question_id, option_key, signal > 0 AND (ahead IS NULL OR round(ahead, 6) >= 0.9::DOUBLE) AS decisive FROM o WHERE rn = 1""",
)
def decisive_option(spark, folder):
    tops = _matches(spark, folder).where("match_rank = 1").withColumn("score", F.round("score", 6))
    out = E.decisive(tops, ["question_id"], [F.desc("score"), F.asc("option_key")], margin=0.9 - 1e-9)
    return out.select("question_id", "option_key", "decisive")


# --- reports against the defects of a category -----------------------------------------

HYPO_SQL = (
    KB_SQL
    + f""", asked AS (SELECT o_orderkey, o_custkey AS p_partkey, o_orderkey % 12 AS rid FROM orders), phrases AS (SELECT CAST(i AS BIGINT) AS doc_id, CAST(i AS BIGINT) AS rid, {_sql_pick(REPORTS, 'i')} AS report FROM (SELECT unnest(range(12)) AS i)),
    reports AS (SELECT doc_id, report FROM phrases), """
    + NORMAL_SQL
    + """, dd AS (SELECT p_partkey, pos * 2 + k AS ord, type, region, region || '_' || type AS node, type || ' ' || signature || ' ' || coalesce(array_to_string(attributes, ' '), '') || ' ' || coalesce(difference, '') AS txt FROM kb_defects),
    variants AS (SELECT row_number() OVER (ORDER BY txt) AS vid, txt FROM (SELECT DISTINCT txt FROM dd)),
    pairs AS (SELECT p.rid, vid FROM phrases p JOIN verdict v ON v.doc_id = p.rid, variants WHERE NOT (phrase AND NOT affirmed)), """
    + S.LEXICON
    + ", "
    + ", ".join(
        [
            S.tokens("pt", "phrases", "rid", "report"),
            S.tokens("vt", "variants", "vid", "txt"),
            S.hits("ph", "pt", "rid"),
            S.hits("vh", "vt", "vid"),
            S.shared("sh", "pairs", "pt", "rid", "vt", "vid"),
            S.overlap("ov", "pairs", "ph", "rid", "vh", "vid"),
        ]
    )
    + """, c AS (SELECT p.rid, p.vid, coalesce(strong, 0) AS strong, coalesce(weak, 0) AS weak, coalesce(attrs, 0) AS attrs, coalesce(terms, 0) AS terms FROM pairs p LEFT JOIN sh USING (rid, vid) LEFT JOIN ov USING (rid, vid)),
    s AS (SELECT *, 1.2::DOUBLE * strong + 1.35::DOUBLE * attrs + 0.18::DOUBLE * terms AS signal, 0.25::DOUBLE * weak AS extra FROM c),
    good AS (SELECT rid, vid, round(signal + extra, 3) AS score, round(signal, 3) AS signal, terms FROM s WHERE """
    + PAIR_CONSENSUS
    + """ AND (strong > 0 OR attrs = 0) AND signal >= 1.6::DOUBLE),
    hypo AS (SELECT o_orderkey, ord, node, type, region, score, rank FROM (SELECT a.o_orderkey, d.ord, d.node, d.type, d.region, g.score, row_number() OVER (PARTITION BY a.o_orderkey ORDER BY g.score DESC, g.signal DESC, g.terms DESC, d.ord) AS rank
      FROM asked a JOIN dd d USING (p_partkey) JOIN variants v USING (txt) JOIN good g ON g.rid = a.rid AND g.vid = v.vid) WHERE rank <= 3)"""
)


def order_reports(spark, folder):
    order = F.col("o_orderkey")
    return table(spark, folder, "orders").select(
        order.alias("report_id"),
        F.concat(F.lit("part_"), F.col("o_custkey").cast("string")).alias("category"),
        _pick(REPORTS, order % 12).alias("report"),
    )


@query(
    "txt7_ranked_hypotheses",
    "WITH " + HYPO_SQL + " SELECT o_orderkey AS report_id, CAST(rank AS INTEGER) AS rank, node AS defect_node, score FROM hypo",
)
def ranked_hypotheses(spark, folder):
    out = E.rank_reports(order_reports(spark, folder), defects(spark, folder))
    return out.select("report_id", "rank", "defect_node", "score")


@query(
    "txt4_evidence_text",
    "WITH "
    + KB_SQL
    + """ SELECT category, CAST(pos * 2 + k AS INTEGER) AS defect_order, array_to_string(list_filter([type, signature] || attributes || [contrast, region, definition, critical_check, target_defect, difference], lambda x: coalesce(x, '') <> ''), ' ') AS full_text,
      array_to_string(list_filter([type, signature, difference], lambda x: coalesce(x, '') <> ''), ' ') AS short_text FROM kb_defects""",
)
def evidence_text(spark, folder):
    d = F.col("distinctions")
    return defects(spark, folder).select(
        "category",
        "defect_order",
        E.evidence_text(
            name=F.col("defect"),
            signature=F.col("visual_signature"),
            attributes=F.col("visual_attributes"),
            contrast=F.col("contrast_vs_normal"),
            region=[F.col("region"), F.col("region_definition"), F.col("critical_check")],
            distinctions=d,
        ).alias("full_text"),
        E.evidence_text(
            name=F.col("defect"), signature=F.col("visual_signature"), distinctions=d, targets=False
        ).alias("short_text"),
    )


PLACES = ["Upper left corner", "center slightly right", "Lower edge, right", "middle", "top", "no location named"]
TERM_SETS = [["left", "top"], ["center"], ["bottom", "right"], ["center", "right", "slightly"]]


@query(
    "txt13_location_options",
    f"""WITH o AS (SELECT p_partkey AS question_id, i, substr('ABCD', CAST(i + 1 AS INTEGER), 1) AS option_key, {_sql_pick(PLACES, '(p_partkey + i * (1 + p_size % 3)) % 6')} AS txt,
      list_extract([['left','top'],['center'],['bottom','right'],['center','right','slightly']], CAST(p_size % 4 + 1 AS INTEGER)) AS pt FROM part, (SELECT unnest(range(4)) AS i)),
    t AS (SELECT *, list_filter([CASE WHEN regexp_matches(lower(txt), '\\bleft\\b') THEN 'left' END, CASE WHEN regexp_matches(lower(txt), '\\bright\\b') THEN 'right' END,
      CASE WHEN regexp_matches(lower(txt), '\\b(top|upper)\\b') THEN 'top' END, CASE WHEN regexp_matches(lower(txt), '\\b(bottom|lower)\\b') THEN 'bottom' END,
      CASE WHEN regexp_matches(lower(txt), '\\b(center|middle)\\b') THEN 'center' END, CASE WHEN regexp_matches(lower(txt), '\\bslight(ly)?\\b') THEN 'slightly' END,
      CASE WHEN regexp_matches(lower(txt), '\\bcorner\\b') THEN 'corner' END], lambda x: x IS NOT NULL) AS ot FROM o),
    s AS (SELECT *, 2 * len(list_intersect(list_intersect(pt, ot), ['left','right','top','bottom'])) + CASE WHEN list_contains(pt, 'center') AND list_contains(ot, 'center') THEN 1.5 ELSE 0 END
      + CASE WHEN list_contains(pt, 'slightly') AND list_contains(ot, 'slightly') THEN 0.5 ELSE 0 END
      - CASE WHEN list_contains(ot, 'corner') AND NOT (list_has_any(pt, ['top','bottom']) AND list_has_any(pt, ['left','right'])) THEN 1 ELSE 0 END
      - 2 * (CAST(list_contains(pt,'left') AND list_contains(ot,'right') AS INTEGER) + CAST(list_contains(pt,'right') AND list_contains(ot,'left') AS INTEGER)
           + CAST(list_contains(pt,'top') AND list_contains(ot,'bottom') AS INTEGER) + CAST(list_contains(pt,'bottom') AND list_contains(ot,'top') AS INTEGER)) AS score FROM t WHERE len(ot) > 0),
    r AS (SELECT *, row_number() OVER w AS rn, lead(score) OVER w AS nxt FROM s WINDOW w AS (PARTITION BY question_id ORDER BY score DESC, option_key))
    SELECT question_id, option_key, CAST(score AS DOUBLE) AS score FROM r WHERE rn = 1 AND score >= 1.5 AND score - coalesce(nxt, -999) >= 0.5""",
)
def location_options(spark, folder):
    part, size = F.col("p_partkey"), F.col("p_size")
    rows = table(spark, folder, "part").select(
        part.alias("question_id"),
        F.get(F.array(*[T.words(t) for t in TERM_SETS]), (size % 4).cast("int")).alias("primary"),
        F.posexplode(F.array(*[_pick(PLACES, (part + i * (1 + size % 3)) % 6) for i in range(4)])).alias("at", "text"),
    )
    rows = rows.select("question_id", "primary", _pick("ABCD", F.col("at")).alias("option_key"), T.location_terms(F.col("text")).alias("terms"))
    rows = rows.withColumn("score", T.location_score(F.col("primary"), F.col("terms"))).where("score is not null")
    return best_location(rows).select("question_id", "option_key", "score")


def best_location(rows, *, least: float = 1.5, margin: float = 0.5):
    """The question's best option when it scores enough and leads the next one; rows: question_id, option_key, score."""
    out = E.decisive(rows.withColumn("signal_score", F.lit(1.0)), ["question_id"], [F.desc("score"), F.asc("option_key")], margin)
    return out.where(F.col("decisive") & (F.col("score") >= least))


@query(
    "txt14_text_markers",
    """WITH q AS (SELECT conv_id, turn, CASE turn % 5 WHEN 0 THEN 'What TYPE of the defect is it? ' WHEN 1 THEN 'Defect Description: ' WHEN 2 THEN 'Which region, Whole_body or rim? ' WHEN 3 THEN 'scratch plus dent ' ELSE '' END || text AS txt FROM conversations)
    SELECT conv_id, turn, regexp_matches(lower(txt), 'defect classification|defect description|defect analysis|type of the defect|appearance of the defect|effect does the defect|how does the defect affect') AS wants_grounding,
      contains(lower(txt), 'whole') OR contains(lower(txt), 'global') AS is_global, regexp_matches(trim(regexp_replace(replace(lower(txt), '_', ' '), '\\s+', ' ', 'g')), '\\b(and|plus|both|multiple|combined|together)\\b|[,;/]') AS is_compound FROM q""",
)
def text_markers(spark, folder):
    heads = ["What TYPE of the defect is it? ", "Defect Description: ", "Which region, Whole_body or rim? ", "scratch plus dent ", ""]
    text = F.concat(_pick(heads, F.col("turn") % 5), "text")
    rows = table(spark, folder, "conversations").select("conv_id", "turn", text.alias("t"))
    t = F.col("t")
    return rows.select(
        "conv_id",
        "turn",
        T.wants_grounding(t).alias("wants_grounding"),
        T.is_global_region(t).alias("is_global"),
        T.is_compound(t).alias("is_compound"),
    )
