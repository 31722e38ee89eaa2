"""Projections, filters, settings, answer parsing."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions import answers as A
from plumbline.functions import paths as P
from plumbline.functions import settings as S
from plumbline.plans.fixtures import FILES_SQL, QA_SQL, SCORES_SQL, files, qa, scores
from plumbline.plans.registry import query, table
from plumbline.sources import layout

SCOPE = "('Anomaly Detection','Defect Classification','Defect Localization','Defect Description','Defect Analysis')"


@query(
    "flt1_scope_tasks",
    "WITH " + QA_SQL + f" SELECT conv_id, turn, task_type FROM qa WHERE task_type IN {SCOPE}",
)
def scope_tasks(spark, folder):
    rows = qa(spark, folder).withColumn("padded", F.concat(F.lit(" "), "task_type", F.lit("  ")))
    return rows.where(S.in_scope(F.col("padded"))).select("conv_id", "turn", "task_type")


@query(
    "flt2_requested_tasks",
    "WITH "
    + QA_SQL
    + """ SELECT conv_id, turn, task_type FROM qa WHERE task_type IN ('Anomaly Detection', 'Defect Analysis', 'Defect Localization')
       AND (conv_id % 2 = 0 OR task_type <> 'Defect Localization')""",
)
def requested_tasks(spark, folder):
    rows = qa(spark, folder).withColumn(
        "wanted",
        F.when(F.col("conv_id") % 2 == 0, " Defect Analysis, Anomaly Detection,Defect Localization,").otherwise(
            "Anomaly Detection,Defect Analysis"
        ),
    )
    return rows.where(F.array_contains(S.requested_tasks(F.col("wanted")), F.col("task_type"))).select(
        "conv_id", "turn", "task_type"
    )


@query(
    "flt3_row_limits",
    "WITH "
    + SCORES_SQL
    + """ SELECT category, image_path, ordinal FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY image_path) AS rn
      FROM scores WHERE split = 'test') WHERE rn <= 20""",
)
def row_limits(spark, folder):
    """At most 20 test samples per category (the cap is the feature); pruned before the shuffle."""
    place = F.row_number().over(W.partitionBy("category").orderBy("image_path"))
    rows = scores(spark, folder).where("split = 'test'").withColumn("rn", place).where("rn <= 20")
    return rows.select("category", "image_path", "ordinal")


@query(
    "flt3_global_limit",
    "WITH " + SCORES_SQL + " SELECT image_path, score FROM scores ORDER BY score DESC, image_path LIMIT 50",
)
def global_limit(spark, folder):
    return scores(spark, folder).orderBy(F.desc("score"), "image_path").limit(50).select("image_path", "score")


@query(
    "flt4_browse_filter",
    "WITH "
    + QA_SQL
    + """ SELECT conv_id, turn FROM qa WHERE contains(image_path, 'scratch') AND task_type = 'Anomaly Detection'
      AND (contains(lower(question), lower('On')) OR contains(lower(string_split(image_path, '/')[-1]), lower('On')))""",
)
def browse_filter(spark, folder):
    return browse(qa(spark, folder), "scratch", "Anomaly Detection", "On").select("conv_id", "turn")


def browse(rows, subfolder="", task_type="", search=""):
    if subfolder and subfolder != "All":
        rows = rows.where(F.contains(F.col("image_path"), F.lit(subfolder)))
    if task_type and task_type != "All":
        rows = rows.where(F.col("task_type") == task_type)
    if search:
        text = F.lit(search.lower())
        rows = rows.where(
            F.contains(F.lower("question"), text) | F.contains(F.lower(P.file_name(F.col("image_path"))), text)
        )
    return rows


@query(
    "flt5_browse_choices",
    "WITH "
    + QA_SQL
    + """ SELECT 'subfolder' AS kind, string_split(image_path, '/')[-2] AS choice FROM qa
      UNION SELECT 'task', task_type FROM qa""",
)
def browse_choices(spark, folder):
    rows = qa(spark, folder)
    folders = rows.select(F.lit("subfolder").alias("kind"), F.element_at(F.split("image_path", "/"), -2).alias("choice"))
    tasks = rows.select(F.lit("task").alias("kind"), F.col("task_type").alias("choice"))
    return folders.distinct().union(tasks.distinct()).orderBy("kind", "choice")


@query(
    "flt6_normal_by_path",
    "WITH "
    + FILES_SQL
    + """ SELECT path, list_contains(string_split(path, '/'), 'good') OR contains(coalesce(string_split(path, '/')[-2], ''), 'good') AS is_normal FROM files""",
)
def normal_by_path(spark, folder):
    return files(spark, folder).select("path", P.normal_by_path(F.col("path")).alias("is_normal"))


NAME_SQL = """named AS (SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN 'Good' WHEN 1 THEN ' non-defective' WHEN 2 THEN 'Ground Truth'
  WHEN 3 THEN 'ground-truth' WHEN 4 THEN 'NEG ' WHEN 5 THEN 'scratch' ELSE source END AS name FROM documents)"""


def _names(spark, folder):
    names = ["Good", " non-defective", "Ground Truth", "ground-truth", "NEG ", "scratch"]
    listed = F.get(F.array(*[F.lit(n) for n in names]), (F.col("doc_id") % 7).cast("int"))
    return table(spark, folder, "documents").select("doc_id", F.coalesce(listed, F.col("source")).alias("name"))


@query(
    "flt7_folder_names",
    "WITH "
    + NAME_SQL
    + """ SELECT doc_id, translate(lower(trim(name)), '- ', '__') IN ('good','normal','norm','ok','negative','neg','nondefective') AS normal_name,
      translate(lower(trim(name)), '- ', '__') IN ('ground_truth','groundtruth','label','labels','masks') AS label_name FROM named""",
)
def folder_names(spark, folder):
    name = F.col("name")
    return _names(spark, folder).select(
        "doc_id", P.is_normal_name(name).alias("normal_name"), P.is_label_name(name).alias("label_name")
    )


@query(
    "flt8_layout_class",
    "WITH "
    + FILES_SQL
    + """, own AS (SELECT 'data_' || substr(path, 1, 4) AS dataset, path FROM files UNION ALL SELECT 'data_cat1', 'meta.json'
       UNION ALL SELECT 'data_none', 'readme/notes.txt'),
    dirs AS (SELECT dataset, bool_or(path = 'meta.json') AS meta, bool_or(len(string_split(path, '/')) > 2 AND string_split(path, '/')[2] IN ('ground_truth', 'Label')) AS lab,
      bool_or(string_split(path, '/')[2] IN ('train', 'Train')) AS tr, bool_or(string_split(path, '/')[2] IN ('test', 'Test')) AS te FROM own GROUP BY dataset)
    SELECT dataset, CASE WHEN meta THEN 'meta_json' WHEN lab THEN 'flat_test_with_label_masks' WHEN tr AND te THEN 'category_train_test_dirs' ELSE 'unknown' END AS layout FROM dirs""",
)
def layout_class(spark, folder):
    rows = files(spark, folder).select(F.concat(F.lit("data_"), F.substring("path", 1, 4)).alias("dataset"), "path")
    extra = spark.createDataFrame([("data_cat1", "meta.json"), ("data_none", "readme/notes.txt")], "dataset string, path string")
    return layout.describe_layout(rows.union(extra))


@query(
    "flt9_run_settings",
    """WITH r AS (SELECT p_partkey, p_size, CASE p_partkey % 6 WHEN 0 THEN 'DS-MVTec' WHEN 1 THEN ' vis_a ' WHEN 2 THEN 'dagm_KaggleUpload' WHEN 3 THEN 'mvtec_ad'
        WHEN 4 THEN 'MPDD' END AS dataset, CASE p_size % 5 WHEN 0 THEN '0' WHEN 1 THEN '1' WHEN 2 THEN 'one' WHEN 3 THEN '2' END AS shots,
        CASE p_partkey % 4 WHEN 0 THEN 'auto' WHEN 1 THEN 'Ada-pt_CLIP' WHEN 2 THEN 'abound' END AS choice FROM part),
    k AS (SELECT *, CASE p_partkey % 6 WHEN 0 THEN 'mvtec' WHEN 1 THEN 'visa' WHEN 2 THEN 'dagm' WHEN 3 THEN 'mvtec' WHEN 4 THEN 'mpdd' ELSE '' END AS dataset_key,
        CASE p_size % 5 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 1 WHEN 3 THEN 2 ELSE 0 END AS k_shot FROM r)
    SELECT p_partkey, dataset_key, k_shot, CASE p_partkey % 4 WHEN 1 THEN 'adaptclip' WHEN 2 THEN 'abound'
      ELSE CASE WHEN dataset_key IN ('mvtec', 'visa') AND k_shot = 1 THEN 'abound' ELSE 'adaptclip' END END AS localizer FROM k""",
)
def run_settings(spark, folder):
    key, size = F.col("p_partkey"), F.col("p_size")

    def pick(options, index):
        return F.get(F.array(*[F.lit(o) for o in options]), index.cast("int"))

    rows = table(spark, folder, "part").select(
        "p_partkey",
        pick(["DS-MVTec", " vis_a ", "dagm_KaggleUpload", "mvtec_ad", "MPDD", None], key % 6).alias("dataset"),
        pick(["0", "1", "one", "2", None], size % 5).alias("shots"),
        pick(["auto", "Ada-pt_CLIP", "abound", None], key % 4).alias("choice"),
    )
    return rows.select(
        "p_partkey",
        S.dataset_key(F.col("dataset")).alias("dataset_key"),
        S.shot_count(F.col("shots")).alias("k_shot"),
        S.localizer_name(F.col("choice"), F.col("dataset"), F.col("shots")).alias("localizer"),
    )


@query(
    "flt10_task_policy",
    "WITH "
    + QA_SQL
    + """, o AS (SELECT *, task_type = 'Object Structure' AS obj FROM qa)
    SELECT conv_id, turn, CASE WHEN obj THEN 'object' ELSE 'defect' END AS task_group,
      NOT obj AS use_local_anomaly_stream, NOT obj AS use_mcts_search, NOT obj AS use_local_evidence_crops,
      NOT obj AS show_local_crops_in_final_prompt, NOT obj AS use_sam3_local_refinement, NOT obj AS use_raw_heatmap_fill,
      NOT obj AND task_type <> 'Defect Localization' AS use_no_local_anomaly_gate, obj AS include_global_reference_in_final,
      TRUE AS show_rag_blocks_in_final_prompt, TRUE AS show_phase1_report_in_final_prompt, FALSE AS use_pvla_defect_hypothesis_prompt,
      CASE task_type WHEN 'Object Structure' THEN 'global_reference' WHEN 'Anomaly Detection' THEN 'global_reference'
        WHEN 'Defect Localization' THEN 'global_spatial_reference' ELSE 'logic_guided_primary' END AS phase1_logic_role FROM o""",
)
def task_policy(spark, folder):
    fields = [f.split()[0] for f in S.POLICY_FIELDS.split(", ")[1:]]
    return S.with_task_policy(qa(spark, folder)).select("conv_id", "turn", *fields)


@query(
    "flt11_safe_names",
    """SELECT doc_id, CASE WHEN s = '' THEN 'item' ELSE s END AS safe FROM (
      SELECT doc_id, trim(regexp_replace(trim(regexp_replace(text, '\\s', ' ', 'g')), '[^A-Za-z0-9_.-]+', '_', 'g'), '._') AS s FROM documents)""",
)
def safe_names(spark, folder):
    text = F.regexp_replace("text", r"\s", " ")
    return table(spark, folder, "documents").select("doc_id", P.safe_name(text).alias("safe"))


@query(
    "flt12_category_source",
    """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN lang WHEN doc_id % 3 = 1 THEN source ELSE '' END AS category,
      CASE WHEN doc_id % 3 = 0 THEN 'row_category' WHEN doc_id % 3 = 1 THEN 'localizer_detected_category_fallback' ELSE 'row_category_fallback' END AS category_source
      FROM documents""",
)
def category_source(spark, folder):
    own = F.when(F.col("doc_id") % 3 == 0, F.col("lang")).otherwise("")
    found = F.when(F.col("doc_id") % 3 != 2, F.col("source"))
    category, source = S.category_choice(own, found)
    return table(spark, folder, "documents").select("doc_id", category.alias("category"), source.alias("category_source"))


LETTER_SQL = """r AS (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN text || ' The correct answer is (B). Not C'
   WHEN 1 THEN 'the CORRECT answer is d' || text WHEN 2 THEN text || ' maybe B or C, see (D)x' ELSE text END AS response FROM conversations)"""
LAST_LETTER = "nullif(regexp_extract(response, '(?s)^(?:.*[^\\pL\\pN_])?([A-D])(?:[^\\pL\\pN_].*)?$', 1), '')"


def _responses(spark, folder):
    turn, text = F.col("turn"), F.col("text")
    return table(spark, folder, "conversations").select(
        "conv_id",
        "turn",
        F.when(turn % 4 == 0, F.concat(text, F.lit(" The correct answer is (B). Not C")))
        .when(turn % 4 == 1, F.concat(F.lit("the CORRECT answer is d"), text))
        .when(turn % 4 == 2, F.concat(text, F.lit(" maybe B or C, see (D)x")))
        .otherwise(text)
        .alias("response"),
    )


@query(
    "txt9_answer_letter",
    "WITH "
    + LETTER_SQL
    + f""" SELECT conv_id, turn, coalesce(nullif(regexp_extract(response, 'The correct answer is \\(?([A-D])\\)?', 1), ''), {LAST_LETTER}, 'A') AS batch_letter,
      coalesce(upper(nullif(regexp_extract(response, '(?i)The correct answer is\\s*\\(?([A-D])\\)?', 1), '')), {LAST_LETTER}, '') AS viewer_letter FROM r""",
)
def answer_letter(spark, folder):
    return _responses(spark, folder).select(
        "conv_id",
        "turn",
        A.answer_letter(F.col("response")).alias("batch_letter"),
        A.answer_letter(F.col("response"), "viewer").alias("viewer_letter"),
    )


VERIFIER_TEXTS = [
    '{"prediction": "Anomaly", "confidence": 0.9, "evidence": "crack"}',
    'Sure:\n```json\n{"label": "no defect", "confidence": "0.25", "rationale": "clean"}\n```\ndone',
    "The part looks normal and good, no scratch.",
    "",
    '{"confidence": 0.4, "evidence": "unclear defect"}',
    'I think {"answer": "damaged!"} fits',
    "[1, 2] abnormal stain",
    '{"prediction": "non defective", "confidence": "high"',
]


def _verifier_rows(spark, folder):
    doc = F.col("doc_id")
    base = F.get(F.array(*[F.lit(t) for t in VERIFIER_TEXTS]), (doc % 8).cast("int"))
    return table(spark, folder, "documents").select(
        "doc_id",
        F.when((doc % 8).isin(2, 7), F.concat(base, F.lit(" "), "text")).otherwise(base).alias("raw"),
        (F.floor(doc / 8) % 2).cast("int").alias("fallback"),
    )


VERIFIER_SQL = (
    "raw_ AS (SELECT doc_id, CAST(doc_id // 8 % 2 AS INTEGER) AS fallback, CASE doc_id % 8 "
    + " ".join(
        f"WHEN {i} THEN '{t}'" + (" || ' ' || text" if i in (2, 7) else "") for i, t in enumerate(VERIFIER_TEXTS)
    )
    + """ END AS raw FROM documents),
cand AS (SELECT *, nullif(regexp_extract(raw, '```(?:json)?\\s*(\\{.*?\\})\\s*```', 1, 'si'), '') AS c1,
   nullif(regexp_extract(raw, '(\\{.*\\})', 1, 's'), '') AS c2 FROM raw_),
obj AS (SELECT *, CASE WHEN json_valid(c1) AND json_type(c1) = 'OBJECT' THEN c1 WHEN json_valid(c2) AND json_type(c2) = 'OBJECT' THEN c2
   WHEN json_valid(raw) AND json_type(raw) = 'OBJECT' THEN raw END AS o FROM cand),
got AS (SELECT *, lower(coalesce(o ->> '$.prediction', o ->> '$.label', o ->> '$.answer', '')) AS w,
   len(regexp_extract_all(lower(raw), '\\b(anomaly|abnormal|defect|defective|damaged|scratch|stain)\\b')) AS na,
   len(regexp_extract_all(lower(raw), '\\b(normal|good|nondefective|non-defective|no defect)\\b')) AS nn FROM obj),
word AS (SELECT *, CASE WHEN o IS NULL THEN CASE WHEN na > nn THEN 'anomaly' WHEN nn > na THEN 'normal' END
   WHEN w = 'anomaly' OR w = 'damaged!' THEN 'anomaly' WHEN w = 'no defect' THEN 'normal' END AS word FROM got),
verdicts AS (SELECT doc_id, fallback, CASE WHEN word IS NULL THEN 'fallback_threshold' WHEN o IS NOT NULL THEN 'json' ELSE 'keyword' END AS parse_status,
   coalesce(word, CASE WHEN fallback = 1 THEN 'anomaly' ELSE 'normal' END) AS prediction_text,
   CASE WHEN word IS NULL THEN fallback ELSE CAST(word = 'anomaly' AS INTEGER) END AS prediction,
   try_cast(o ->> '$.confidence' AS DOUBLE) AS confidence, coalesce(o ->> '$.evidence', o ->> '$.rationale', '') AS evidence FROM word)
"""
)


@query("txt10_verifier_response", "WITH " + VERIFIER_SQL + " SELECT * EXCLUDE (fallback) FROM verdicts")
def verifier_response(spark, folder):
    out = A.parse_verifier(_verifier_rows(spark, folder), "raw", "fallback")
    return out.drop("raw", "fallback")


@query(
    "txt11_prediction_word",
    """WITH w AS (SELECT doc_id, CASE doc_id % 9 WHEN 0 THEN 'GOOD!' WHEN 1 THEN 'non  defective' WHEN 2 THEN 'Abnormal' WHEN 3 THEN 'looks normal to me'
       WHEN 4 THEN 'an anomalous mark' WHEN 5 THEN 'no defect seen' WHEN 6 THEN '' WHEN 7 THEN 'Negative' ELSE text END AS word FROM documents)
    SELECT doc_id, CASE doc_id % 9 WHEN 0 THEN 'normal' WHEN 1 THEN 'normal' WHEN 2 THEN 'anomaly' WHEN 3 THEN 'normal' WHEN 4 THEN 'anomaly'
      WHEN 5 THEN 'anomaly' WHEN 7 THEN 'normal' WHEN 8 THEN CASE WHEN contains(lower(word), 'anomal') OR contains(lower(word), 'defect') OR contains(lower(word), 'abnormal') THEN 'anomaly'
        WHEN contains(lower(word), 'normal') OR contains(lower(word), 'good') THEN 'normal' END END AS prediction FROM w""",
)
def prediction_word(spark, folder):
    words = ["GOOD!", "non  defective", "Abnormal", "looks normal to me", "an anomalous mark", "no defect seen", "", "Negative"]
    listed = F.get(F.array(*[F.lit(w) for w in words]), (F.col("doc_id") % 9).cast("int"))
    return table(spark, folder, "documents").select(
        "doc_id", A.prediction_word(F.coalesce(listed, F.col("text"))).alias("prediction")
    )


@query(
    "win9_ordered_dedupe",
    """SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS kept FROM (
      SELECT doc_id, line, min(pos) AS pos FROM (
        SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents) GROUP BY ALL)
      GROUP BY doc_id""",
)
def ordered_dedupe(spark, folder):
    """Repeated lines of a text are dropped, the first one stays in place."""
    return table(spark, folder, "documents").select(
        "doc_id", F.array_join(F.array_distinct(F.split("text", "\n")), "\n").alias("kept")
    )


@query(
    "win12_sorted_report",
    "WITH "
    + QA_SQL
    + """ SELECT place, subclass, task_type, total FROM (SELECT row_number() OVER (ORDER BY subclass, task_type) AS place, subclass, task_type, total
      FROM (SELECT subclass, task_type, count(*) AS total FROM qa GROUP BY ALL))""",
)
def sorted_report(spark, folder):
    """Report lines in category and task order; the counts are few (one per category and task)."""
    counts = qa(spark, folder).groupBy("subclass", "task_type").agg(F.count(F.lit(1)).alias("total"))
    place = F.row_number().over(W.orderBy("subclass", "task_type")).cast("long")
    return counts.select(place.alias("place"), "subclass", "task_type", "total")


@query(
    "set4_task_sets",
    "WITH "
    + QA_SQL
    + f""" SELECT 'unknown' AS kind, task_type AS name FROM (SELECT DISTINCT task_type FROM qa WHERE task_type NOT IN {SCOPE})
      UNION ALL SELECT 'category', subclass FROM (SELECT DISTINCT subclass FROM qa)""",
)
def task_sets(spark, folder):
    rows = qa(spark, folder)
    valid = spark.createDataFrame([(t,) for t in S.SCOPE_TASKS], "name string")
    unknown = rows.select(F.col("task_type").alias("name")).subtract(valid).select(F.lit("unknown").alias("kind"), "name")
    even = rows.where("turn % 2 = 0").select(F.col("subclass").alias("name"))
    odd = rows.where("turn % 2 = 1").select(F.col("subclass").alias("name"))
    both = even.unionByName(odd).distinct().select(F.lit("category").alias("kind"), "name")
    return unknown.unionByName(both)
