"""Input shapes derived from the given tables, once in Spark and once as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.plans.registry import table

# --- scored images (events): normal training scores and labelled test scores -----------

SCORES_SQL = """scores AS (
  SELECT 'set' || CAST((user_id % 7) % 3 AS VARCHAR) AS dataset,
         'cat' || CAST(user_id % 7 AS VARCHAR) AS category,
         'img/' || CAST(event_id AS VARCHAR) || '.png' AS image_path,
         CASE WHEN event_type IN ('click', 'view') THEN 'train' ELSE 'test' END AS split,
         CAST(event_type = 'error' AS INTEGER) AS label,
         CASE WHEN event_type = 'error' THEN 'defect_' || CAST(user_id % 3 AS VARCHAR) ELSE 'good' END AS defect_type,
         value AS score, event_id AS ordinal
  FROM events)"""


def scores(spark, folder) -> DataFrame:
    user = F.col("user_id")
    return table(spark, folder, "events").select(
        F.concat(F.lit("set"), (user % 7 % 3).cast("string")).alias("dataset"),
        F.concat(F.lit("cat"), (user % 7).cast("string")).alias("category"),
        F.concat(F.lit("img/"), F.col("event_id").cast("string"), F.lit(".png")).alias("image_path"),
        F.when(F.col("event_type").isin("click", "view"), "train").otherwise("test").alias("split"),
        (F.col("event_type") == "error").cast("int").alias("label"),
        F.when(F.col("event_type") == "error", F.concat(F.lit("defect_"), (user % 3).cast("string")))
        .otherwise("good")
        .alias("defect_type"),
        F.col("value").alias("score"),
        F.col("event_id").alias("ordinal"),
    )


# --- heatmaps (embeddings): 8x8 grids of absolute values --------------------------------

HEATMAPS_SQL = """heatmaps AS (
  SELECT vec_id AS image_id, 8 AS height, 8 AS width, 'cat' || CAST(label AS VARCHAR) AS category,
         list_transform(embedding, lambda v: CAST(abs(v) AS DOUBLE)) AS vals,
         list_transform(embedding, lambda v: v > 0) AS mask
  FROM embeddings)"""

PIXELS_SQL = (
    HEATMAPS_SQL
    + """, pixels AS (
  SELECT image_id, category, p // 8 AS y, p % 8 AS x, p AS pos, vals[p + 1] AS v, mask[p + 1] AS on_mask
  FROM heatmaps, (SELECT unnest(range(64)) AS p))"""
)


def heatmaps(spark, folder) -> DataFrame:
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("image_id"),
        F.lit(8).alias("height"),
        F.lit(8).alias("width"),
        F.concat(F.lit("cat"), F.col("label").cast("string")).alias("category"),
        F.transform("embedding", lambda v: F.abs(v.cast("double"))).alias("vals"),
        F.transform("embedding", lambda v: v > 0).alias("mask"),
    )


# --- question-answer rows (conversations) ----------------------------------------------

TASKS = (
    "Anomaly Detection",
    "Defect Classification",
    "Defect Localization",
    "Defect Description",
    "Defect Analysis",
    "Object Structure",
)

QA_SQL = """qa AS (
  SELECT conv_id, turn, 'part' || CAST(conv_id % 5 AS VARCHAR) AS subclass,
         CASE turn % 6 WHEN 0 THEN 'Anomaly Detection' WHEN 1 THEN 'Defect Classification'
           WHEN 2 THEN 'Defect Localization' WHEN 3 THEN 'Defect Description'
           WHEN 4 THEN 'Defect Analysis' ELSE 'Object Structure' END AS task_type,
         text AS question,
         'part' || CAST(conv_id % 5 AS VARCHAR) || '/test/' ||
           CASE WHEN conv_id % 3 = 0 THEN 'good' ELSE 'scratch' END || '/' || CAST(conv_id AS VARCHAR) || '.png' AS image_path,
         substr('ABCD', CAST(conv_id % 4 + 1 AS INTEGER), 1) AS correct_answer,
         substr('ABCD', CAST((conv_id + length(text)) % 4 + 1 AS INTEGER), 1) AS given_answer
  FROM conversations)"""


def qa(spark, folder) -> DataFrame:
    conv, turn = F.col("conv_id"), F.col("turn")
    subclass = F.concat(F.lit("part"), (conv % 5).cast("string"))
    letters = F.array(*[F.lit(c) for c in "ABCD"])
    return table(spark, folder, "conversations").select(
        "conv_id",
        "turn",
        subclass.alias("subclass"),
        F.element_at(F.array(*[F.lit(t) for t in TASKS]), (turn % 6 + 1).cast("int")).alias("task_type"),
        F.col("text").alias("question"),
        F.concat(
            subclass,
            F.lit("/test/"),
            F.when(conv % 3 == 0, "good").otherwise("scratch"),
            F.lit("/"),
            conv.cast("string"),
            F.lit(".png"),
        ).alias("image_path"),
        F.element_at(letters, (conv % 4 + 1).cast("int")).alias("correct_answer"),
        F.element_at(letters, ((conv + F.length("text")) % 4 + 1).cast("int")).alias("given_answer"),
    )


# --- boxes (lineitem): candidates per image --------------------------------------------

BOXES_SQL = """boxes AS (
  SELECT l_orderkey AS image_id, (((l_orderkey * 10 + l_linenumber) * 1000 + l_partkey % 1000) * 100 + l_suppkey % 100) * 100 + CAST(l_quantity AS BIGINT) AS box_id,
         CASE l_returnflag WHEN 'A' THEN 'box' WHEN 'N' THEN 'text' ELSE 'search' END AS source,
         CAST(l_quantity AS INTEGER) AS x1, CAST(l_partkey % 50 AS INTEGER) AS y1,
         CAST(l_quantity AS INTEGER) + CAST(5 + l_suppkey % 20 AS INTEGER) AS x2,
         CAST(l_partkey % 50 AS INTEGER) + 5 + l_linenumber * 3 AS y2,
         l_extendedprice AS priority, l_discount AS discount, l_tax AS tax,
         l_linenumber AS line, l_quantity AS quantity, l_suppkey AS suppkey, l_linestatus AS status
  FROM lineitem)"""


def boxes(spark, folder) -> DataFrame:
    x1, y1 = F.col("l_quantity").cast("int"), (F.col("l_partkey") % 50).cast("int")
    return table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("image_id"),
        (
            (((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 1000 + F.col("l_partkey") % 1000) * 100 + F.col("l_suppkey") % 100) * 100
            + F.col("l_quantity").cast("long")
        ).alias("box_id"),
        F.when(F.col("l_returnflag") == "A", "box")
        .when(F.col("l_returnflag") == "N", "text")
        .otherwise("search")
        .alias("source"),
        x1.alias("x1"),
        y1.alias("y1"),
        (x1 + (F.col("l_suppkey") % 20 + 5).cast("int")).alias("x2"),
        (y1 + 5 + F.col("l_linenumber") * 3).alias("y2"),
        F.col("l_extendedprice").alias("priority"),
        F.col("l_discount").alias("discount"),
        F.col("l_tax").alias("tax"),
        F.col("l_linenumber").alias("line"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_suppkey").alias("suppkey"),
        F.col("l_linestatus").alias("status"),
    )


# --- earlier predictions (labels) ------------------------------------------------------

PREDICTIONS_SQL = """predictions AS (
  SELECT 'set' || CAST(doc_id % 3 AS VARCHAR) AS dataset, 'cat' || CAST(doc_id % 9 AS VARCHAR) AS category,
         'img/' || CAST(doc_id AS VARCHAR) || '.png' AS image_path, toxic AS label, 1 - quality AS prediction,
         doc_id AS ordinal
  FROM labels)"""


def predictions(spark, folder) -> DataFrame:
    doc = F.col("doc_id")
    return table(spark, folder, "labels").select(
        F.concat(F.lit("set"), (doc % 3).cast("string")).alias("dataset"),
        F.concat(F.lit("cat"), (doc % 9).cast("string")).alias("category"),
        F.concat(F.lit("img/"), doc.cast("string"), F.lit(".png")).alias("image_path"),
        F.col("toxic").alias("label"),
        (1 - F.col("quality")).alias("prediction"),
        doc.alias("ordinal"),
    )


# --- file listing (documents): four folder-layout categories, two flat ones with masks --

FILES_SQL = """files AS (
  SELECT path, n_chars AS size, n_chars % 3 <> 0 AS foreground FROM (
    SELECT n_chars, 'cat' || CAST(doc_id % 6 AS VARCHAR) || '/' ||
      CASE WHEN doc_id % 6 < 4 THEN
        CASE (doc_id // 6) % 8 WHEN 0 THEN 'train/good/' WHEN 1 THEN 'train/good/' WHEN 2 THEN 'train/bad/' WHEN 3 THEN 'test/good/'
          WHEN 4 THEN 'test/scratch/' WHEN 5 THEN 'test/hole/' WHEN 6 THEN 'ground_truth/scratch/' ELSE 'ground_truth/hole/' END
        || CAST(doc_id // 48 AS VARCHAR) || CASE (doc_id // 6) % 8 WHEN 1 THEN 'x' WHEN 6 THEN '_mask' WHEN 7 THEN '_mask' ELSE '' END
      ELSE
        CASE (doc_id // 6) % 8 WHEN 3 THEN 'Train/Label/' WHEN 7 THEN 'Test/Label/' WHEN 4 THEN 'Test/' WHEN 5 THEN 'Test/'
          WHEN 6 THEN 'Test/' ELSE 'Train/' END
        || CAST(doc_id // 48 AS VARCHAR) || CASE (doc_id // 6) % 4 WHEN 0 THEN 'a' WHEN 1 THEN 'b' WHEN 2 THEN 'c' ELSE 'b_label' END
      END || CASE n_chars % 7 WHEN 0 THEN '.PNG' WHEN 1 THEN '.jpg' WHEN 2 THEN '.txt' ELSE '.png' END AS path
    FROM documents))"""


def files(spark, folder) -> DataFrame:
    """path, size, foreground (whether a mask file has any lit pixel)."""

    def pick(options, index):
        return F.element_at(F.array(*[F.lit(o) for o in options]), (index + 1).cast("int"))

    doc, size = F.col("doc_id"), F.col("n_chars")
    slot, group = F.floor(doc / 6) % 8, F.floor(doc / 48).cast("string")
    nested = F.concat(
        pick(
            ["train/good/", "train/good/", "train/bad/", "test/good/", "test/scratch/", "test/hole/"]
            + ["ground_truth/scratch/", "ground_truth/hole/"],
            slot,
        ),
        group,
        pick(["", "x", "", "", "", "", "_mask", "_mask"], slot),
    )
    flat = F.concat(
        pick(["Train/"] * 3 + ["Train/Label/"] + ["Test/"] * 3 + ["Test/Label/"], slot),
        group,
        pick(["a", "b", "c", "b_label"], slot % 4),
    )
    extension = pick([".PNG", ".jpg", ".txt", ".png", ".png", ".png", ".png"], size % 7)
    return table(spark, folder, "documents").select(
        F.concat(
            F.lit("cat"), (doc % 6).cast("string"), F.lit("/"), F.when(doc % 6 < 4, nested).otherwise(flat), extension
        ).alias("path"),
        size.alias("size"),
        (size % 3 != 0).alias("foreground"),
    )


# --- knowledge bases (part): three regions with two defects each ------------------------

DEFECTS = [
    ("crack", "thin jagged line across the surface", "normal surface is continuous", ["fracture", "split"]),
    ("scratch", "linear abrasion mark on the coating", "the coating is even", ["scuff line"]),
    ("missing_part", "empty gap where a component should be", "all components present", ["absent part"]),
    ("bent_edge", "warped outline and distorted geometry", "edge is straight", ["deformation"]),
    ("stain", "faded discolored spot with ink", "uniform color", ["stain", "ink print"]),
    ("hole", "round puncture through the material", "no openings", ["hole", "void"]),
    ("metal_contamination", "shiny foreign metallic particle", "no foreign objects", ["foreign metal"]),
    ("frayed_thread", "loose fuzzy fibers and torn weaving", "weave is tight", []),
]


def _sql_list(values):
    return "CAST([" + ", ".join(f"'{v}'" for v in values) + "] AS VARCHAR[])"


KB_SQL = (
    "kb_vocab AS (SELECT * FROM (VALUES "
    + ", ".join(f"({i}, '{t}', '{s}', '{c}', {_sql_list(a)})" for i, (t, s, c, a) in enumerate(DEFECTS))
    + """) v(vid, type, signature, contrast, attributes)),
kb_regions AS (
  SELECT p_partkey, p_size, 'part_' || CAST(p_partkey AS VARCHAR) AS category,
         p_name || ' ' || CAST(p_partkey AS VARCHAR) AS target, pos,
         CASE pos WHEN 0 THEN 'Whole_Body' WHEN 1 THEN 'Edge Rim' ELSE lower(p_type) || '_core' END AS region,
         'The ' || p_name || CASE pos WHEN 0 THEN ' body' WHEN 1 THEN ' rim' ELSE ' core' END AS definition,
         CASE WHEN pos = 2 AND p_size % 3 = 0 THEN 'N/A' ELSE 'Uniform finish' END AS normal_standard,
         CASE pos WHEN 0 THEN '' WHEN 1 THEN 'Check the rim for cracks'
           ELSE CASE WHEN p_size % 2 = 0 THEN 'N/A' ELSE 'Inspect the core' END END AS critical_check
  FROM part, (SELECT unnest(range(3)) AS pos)),
kb_defects AS (
  SELECT r.*, k, v.type, v.signature, v.contrast, v.attributes,
         CASE WHEN k = 0 THEN w.type WHEN p_size % 2 = 0 THEN 'phantom_mark' END AS target_defect,
         CASE WHEN k = 0 THEN 'unlike ' || w.type || ' it shows ' || v.signature WHEN p_size % 2 = 0 THEN 'N/A' END AS difference
  FROM kb_regions r, (SELECT unnest(range(2)) AS k)
  JOIN kb_vocab v ON v.vid = CASE k WHEN 0 THEN (p_partkey + pos) % 8 ELSE ((p_partkey + pos) % 8 + 1 + p_size % 6) % 8 END
  JOIN kb_vocab w ON w.vid = ((p_partkey + pos) % 8 + 1 + p_size % 6) % 8)"""
)


def knowledge(spark, folder) -> DataFrame:
    """category and the parsed knowledge base ``kb``."""
    vocab = F.array(
        *[
            F.struct(
                F.lit(t).alias("type"),
                F.lit(s).alias("signature"),
                F.lit(c).alias("contrast"),
                F.array(*[F.lit(x) for x in a]).cast("array<string>").alias("attributes"),
            )
            for t, s, c, a in DEFECTS
        ]
    )
    part, size = F.col("p_partkey"), F.col("p_size")

    def region(pos: int):
        one, two = F.col(f"_one{pos}"), F.col(f"_two{pos}")

        def defect(own, target, difference, present):
            return F.struct(
                own["type"].alias("type"),
                own["signature"].alias("visual_signature"),
                own["contrast"].alias("contrast_vs_normal"),
                own["attributes"].alias("visual_attributes"),
                F.when(
                    present, F.array(F.struct(target.alias("target_defect"), difference.alias("difference")))
                )
                .otherwise(F.array().cast("array<struct<target_defect:string,difference:string>>"))
                .alias("distinctions"),
            )

        name = [F.lit("Whole_Body"), F.lit("Edge Rim"), F.concat(F.lower("p_type"), F.lit("_core"))][pos]
        check = [
            F.lit(""),
            F.lit("Check the rim for cracks"),
            F.when(size % 2 == 0, "N/A").otherwise("Inspect the core"),
        ][pos]
        standard = F.when((size % 3 == 0) & F.lit(pos == 2), "N/A").otherwise("Uniform finish")
        body = F.struct(
            F.concat(F.lit("The "), F.col("p_name"), F.lit([" body", " rim", " core"][pos])).alias("definition"),
            standard.alias("normal_standard"),
            check.alias("critical_check"),
            F.array(
                defect(
                    one,
                    two["type"],
                    F.concat(F.lit("unlike "), two["type"], F.lit(" it shows "), one["signature"]),
                    F.lit(True),
                ),
                defect(two, F.lit("phantom_mark"), F.lit("N/A"), size % 2 == 0),
            ).alias("defects"),
            F.array(F.lit("Do not guess"), F.lit("N/A")).alias("anti_hallucination_rules"),
        )
        return [name, body]

    picked = {}
    for pos in range(3):
        first = ((part + pos) % 8).cast("int")
        picked[f"_one{pos}"] = F.get("_vocab", first)
        picked[f"_two{pos}"] = F.get("_vocab", ((first + 1 + size % 6) % 8).cast("int"))
    return (
        table(spark, folder, "part")
        .select("p_partkey", "p_size", "p_name", "p_type")
        # a small compressed file holds many rows: they are dealt over the tasks before they are widened
        .repartition("p_partkey")
        .withColumn("_vocab", vocab)
        .withColumns(picked)
        .select(
            F.concat(F.lit("part_"), part.cast("string")).alias("category"),
            F.struct(
                F.concat_ws(" ", "p_name", part.cast("string")).alias("target_object"),
                F.create_map(*region(0), *region(1), *region(2)).alias("regions"),
            ).alias("kb"),
            "p_partkey",
            "p_size",
        )
    )


def knowledge_files(spark, folder) -> DataFrame:
    """The same knowledge bases as files (path, text), with skipped names and broken texts among them."""
    suffix = F.when(F.col("p_size") > 45, "_origin.json").when(F.col("p_size") < 3, ".txt").otherwise(".json")
    return knowledge(spark, folder).select(
        F.concat(F.lit("kb/"), "category", suffix).alias("path"),
        F.when(F.col("p_partkey") % 17 == 0, '{"target_object": ').otherwise(F.to_json("kb")).alias("text"),
    )
