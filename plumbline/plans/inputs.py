"""Sources and sinks: listings, layouts, masks, JSON documents, logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators.metrics import answer_counts
from plumbline.plans.fixtures import (
    FILES_SQL,
    HEATMAPS_SQL,
    KB_SQL,
    PREDICTIONS_SQL,
    QA_SQL,
    files,
    heatmaps,
    knowledge_files,
    predictions,
    qa,
)
from plumbline.plans.metrics import ANSWERS_SQL, answers
from plumbline.plans.registry import query, table
from plumbline.session import shared_path
from plumbline.sources import documents, layout, sinks

IMAGE_SQL = "lower(regexp_extract(path, '\\.([^./]*)$', 1)) IN ('bmp','jpeg','jpg','png','tif','tiff','webp')"
NORMAL_SQL = "('good','normal','norm','ok','negative','neg','nondefective')"
PARTS_SQL = (
    "WITH "
    + FILES_SQL
    + f""", listed AS (
  SELECT *, string_split(path, '/') AS p, {IMAGE_SQL} AS is_image,
         regexp_replace(string_split(path, '/')[-1], '\\.[^.]*$', '') AS stem FROM files),
rows_ AS (SELECT *, p[1] AS category, p[2] AS dir, CASE WHEN len(p) > 3 THEN p[3] END AS child FROM listed)
"""
)


# --- SRC1, SRC2: question files --------------------------------------------------------


def _question_images(spark, folder):
    """subclass, key and item of each image, one image per conversation."""
    conv, turn = F.col("conv_id"), F.col("turn")
    item = F.struct(
        turn.alias("turn"),
        F.when(F.col("role") == "user", True).when(F.col("role") == "assistant", False).alias("annotation"),
        F.col("text").alias("Question"),
        F.element_at(F.array(*[F.lit(c) for c in "ABCD"]), (conv % 4 + 1).cast("int")).alias("Answer"),
        F.create_map(F.lit("A"), F.lit("Yes."), F.lit("B"), F.concat(F.lit("No "), turn.cast("string"))).alias("Options"),
        F.when(turn % 2 == 0, "Anomaly Detection").alias("type"),
    )
    grouped = table(spark, folder, "conversations").groupBy("conv_id").agg(
        F.array_sort(F.collect_list(item), lambda a, b: (a["turn"] - b["turn"]).cast("int")).alias("turns")
    )
    key = F.concat(F.lit("img/"), conv.cast("string"), F.lit(".png"))
    body = F.struct(
        F.when(conv % 2 == 1, F.concat(F.lit("own/"), conv.cast("string"), F.lit(".png"))).alias("image_path"),
        F.transform("turns", lambda t: t.dropFields("turn")).alias("conversation"),
    )
    return grouped.select(F.concat(F.lit("part"), (conv % 5).cast("string")).alias("subclass"), key.alias("key"), body.alias("item"))


def _question_files(spark, folder):
    """A document per image."""
    return _question_images(spark, folder).select("subclass", F.to_json(F.create_map("key", "item")).alias("text"))


@query(
    "src1_question_rows",
    """SELECT 'part' || CAST(conv_id % 5 AS VARCHAR) AS subclass,
      CASE WHEN conv_id % 2 = 1 THEN 'own/' ELSE 'img/' END || CAST(conv_id AS VARCHAR) || '.png' AS image_path,
      text AS question, substr('ABCD', CAST(conv_id % 4 + 1 AS INTEGER), 1) AS gt_answer,
      CASE WHEN turn % 2 = 0 THEN 'Anomaly Detection' ELSE 'Unknown' END AS task_type, 'No ' || CAST(turn AS VARCHAR) AS option_b
    FROM conversations WHERE role = 'user'""",
)
def question_rows(spark, folder):
    out = documents.question_rows(_question_files(spark, folder))
    return out.select(
        "subclass", "image_path", "question", "gt_answer", "task_type", F.col("options")["B"].alias("option_b")
    )


QUESTION_SQL = """SELECT 'part' || CAST(conv_id % 5 AS VARCHAR) AS subclass,
      CASE WHEN conv_id % 2 = 1 THEN 'own/' ELSE 'img/' END || CAST(conv_id AS VARCHAR) || '.png' AS image_path,
      text AS question, substr('ABCD', CAST(conv_id % 4 + 1 AS INTEGER), 1) AS gt_answer
    FROM conversations WHERE role = 'user'"""


def _written_questions(spark, docs):
    """The question files, one document per file in a folder per subclass."""
    path = shared_path(spark, "questions")
    sinks.write_documents(docs, path, ["subclass"])
    return path


@query("src1_question_files", QUESTION_SQL)
def question_files(spark, folder):
    """Question rows of files that lie in folders by subclass."""
    docs = sinks.question_documents(_question_images(spark, folder))
    files = documents.read_json_files(spark, _written_questions(spark, docs))
    files = files.select(F.regexp_extract("path", "/subclass=([^/]*)/", 1).alias("subclass"), "text")
    return documents.question_rows(files).select("subclass", "image_path", "question", "gt_answer")


@query(
    "src7_listed_folders",
    "SELECT 'subclass=part' || CAST(conv_id % 5 AS VARCHAR) AS folder, count(DISTINCT conv_id) AS files, min(length(text)) > 0 AS filled FROM conversations GROUP BY conv_id % 5",
)
def listed_folders(spark, folder):
    """A recursive listing of written files, one per image."""
    files = layout.list_files(spark, _written_questions(spark, _question_files(spark, folder)))
    return files.groupBy(F.substring_index("path", "/", 1).alias("folder")).agg(F.count(F.lit(1)).alias("files"), (F.min("size") > 0).alias("filled"))


@query(
    "src2_question_file_fallback",
    """WITH f AS (
      SELECT CASE WHEN c_acctbal < 3000 THEN 'qa/' ELSE 'data/' END || 'unit' || CAST(c_custkey // 20 AS VARCHAR) || '/QA.json' AS path,
             c_custkey, c_acctbal >= 0 AS readable FROM customer),
    one AS (SELECT path, arg_min(readable, c_custkey) AS readable FROM f GROUP BY path),
    c AS (SELECT 'unit' || CAST(s_suppkey AS VARCHAR) AS subclass, unnest([0, 1]) AS pr FROM supplier)
    SELECT subclass, path FROM (
      SELECT subclass, one.path, readable, row_number() OVER (PARTITION BY subclass ORDER BY pr) AS rn
      FROM c JOIN one ON one.path = CASE pr WHEN 0 THEN 'qa/' ELSE 'data/' END || subclass || '/QA.json')
    WHERE rn = 1 AND readable""",
)
def question_file_fallback(spark, folder):
    customer = table(spark, folder, "customer")
    unit = F.floor(F.col("c_custkey") / 20).cast("string")
    path = F.concat(F.when(F.col("c_acctbal") < 3000, "qa/").otherwise("data/"), F.lit("unit"), unit, F.lit("/QA.json"))
    listing = customer.groupBy(path.alias("path")).agg(
        F.min_by(F.when(F.col("c_acctbal") < 0, '{"broken": ').otherwise('{"a.png": {}}'), "c_custkey").alias("text")
    )
    wanted = table(spark, folder, "supplier").select(F.concat(F.lit("unit"), F.col("s_suppkey").cast("string")).alias("subclass"))
    return documents.first_existing(wanted, listing, "subclass", ["qa", "data"], "QA.json").select("subclass", "path")


@query(
    "src3_resolved_paths",
    "WITH "
    + QA_SQL
    + """, rows_ AS (
      SELECT conv_id * 100 + turn AS row_id, subclass,
        CASE conv_id % 3 WHEN 0 THEN substr(image_path, 7) WHEN 1 THEN image_path ELSE subclass || '/' || image_path END AS rel_path FROM qa),
    manifest AS (SELECT DISTINCT CASE WHEN conv_id % 6 = 2 THEN subclass || '/' || image_path ELSE image_path END AS path
                 FROM qa WHERE length(question) > 40),
    c AS (SELECT row_id, unnest([0, 1, 2]) AS rk, unnest([subclass || '/' || rel_path, rel_path,
            CASE WHEN starts_with(rel_path, subclass || '/') THEN subclass || '/' || substr(rel_path, length(subclass) + 2) END]) AS path FROM rows_)
    SELECT row_id, arg_min(path, rk) AS resolved_path FROM c JOIN manifest USING (path) GROUP BY row_id""",
)
def resolved_paths(spark, folder):
    rows, conv = qa(spark, folder), F.col("conv_id")
    prefixed = F.concat_ws("/", "subclass", "image_path")
    wanted = rows.select(
        (conv * 100 + F.col("turn")).alias("row_id"),
        "subclass",
        F.when(conv % 3 == 0, F.expr("substring(image_path, 7)"))
        .when(conv % 3 == 1, F.col("image_path"))
        .otherwise(prefixed)
        .alias("rel_path"),
    )
    manifest = rows.where(F.length("question") > 40).select(
        F.when(conv % 6 == 2, prefixed).otherwise(F.col("image_path")).alias("path")
    )
    return layout.resolve_paths(wanted, manifest.distinct()).select("row_id", "resolved_path")


CATALOG = ["part0", "part1", "part2", "part3", "part4"]


@query(
    "src4_category_selection",
    "WITH "
    + QA_SQL
    + """ SELECT class_index, subclass, count(*) AS question_count FROM qa
      JOIN (SELECT * FROM (VALUES (3, 'part3'), (0, 'part0'), (4, 'part4')) t(class_index, subclass)) USING (subclass) GROUP BY ALL""",
)
def category_selection(spark, folder):
    chosen = select_categories(spark, CATALOG, " part3, part0,part4 ,unknown")
    return (
        qa(spark, folder)
        .join(F.broadcast(chosen), "subclass")
        .groupBy("class_index", "subclass")
        .agg(F.count(F.lit(1)).alias("question_count"))
    )


def select_categories(spark, catalog: list[str], selection: str):
    """Catalog rows (subclass, class_index) of "all" or a comma list; unknown names are skipped."""
    rows = spark.createDataFrame(list(enumerate(catalog)), "class_index int, subclass string")
    if selection.strip().lower() == "all":
        return rows
    return rows.where(F.col("subclass").isin([s.strip() for s in selection.split(",")]))


# --- SRC5: split metadata --------------------------------------------------------------

META_ITEMS_SQL = """items AS (
  SELECT doc_id, doc_id // 40 AS grp, CASE WHEN quality = 1 THEN 'train' ELSE 'test' END AS split, 'cat' || CAST(doc_id % 7 AS VARCHAR) AS cat,
         'img/' || CAST(doc_id AS VARCHAR) || CASE WHEN doc_id % 13 = 0 THEN '.txt' ELSE '.png' END AS path, toxic AS label,
         CASE doc_id % 4 WHEN 0 THEN 'Normal' WHEN 1 THEN 'scratch' WHEN 2 THEN '' END AS kind,
         CASE WHEN doc_id % 3 = 2 THEN 'named' END AS cls
  FROM labels)"""


def _metadata_docs(spark, folder):
    doc, grp = F.col("doc_id"), F.floor(F.col("doc_id") / 40)
    kind = F.when(doc % 4 == 0, "Normal").when(doc % 4 == 1, "scratch").when(doc % 4 == 2, "")
    path = F.concat(F.lit("img/"), doc.cast("string"), F.when(doc % 13 == 0, ".txt").otherwise(".png"))
    item = (
        F.when(
            doc % 3 == 0,
            F.to_json(F.struct(path.alias("img_path"), F.col("toxic").alias("anomaly"), kind.alias("specie_name"))),
        )
        .when(
            doc % 3 == 1,
            F.to_json(F.struct(path.alias("image_path"), F.col("toxic").alias("label"), kind.alias("defect_type"))),
        )
        .otherwise(
            F.to_json(
                F.struct(
                    path.alias("path"), F.col("toxic").alias("anomaly"), F.lit("named").alias("cls_name"), kind.alias("specie_name")
                )
            )
        )
    )
    rows = table(spark, folder, "labels").select(
        "doc_id",
        grp.alias("grp"),
        F.when(F.col("quality") == 1, "train").otherwise("test").alias("split"),
        F.concat(F.lit("cat"), (doc % 7).cast("string")).alias("cat"),
        item.alias("item"),
    )
    per_cat = rows.groupBy("grp", "split", "cat").agg(
        F.array_sort(F.collect_list(F.struct("doc_id", "item")))["item"].alias("items")
    )
    listed = F.concat(F.lit("["), F.array_join("items", ","), F.lit("]"))
    single = (F.col("grp") % 3 == 2) & (F.col("split") == "train")
    entry = F.concat(F.lit('"'), F.col("cat"), F.lit('":'), F.when(single, F.get("items", F.lit(0))).otherwise(listed))
    per_split = per_cat.groupBy("grp", "split").agg(
        F.array_join(F.array_sort(F.collect_list(entry)), ",").alias("named"),
        F.array_join(F.collect_list(F.array_join("items", ",")), ",").alias("flat"),
    )
    body = F.when(
        (F.col("grp") % 3 == 0) & (F.col("split") == "test"), F.concat(F.lit("["), "flat", F.lit("]"))
    ).otherwise(F.concat(F.lit("{"), "named", F.lit("}")))
    per_doc = per_split.select("grp", F.concat(F.lit('"'), F.col("split"), F.lit('": '), body).alias("part")).groupBy("grp")
    return per_doc.agg(F.concat(F.lit("{"), F.array_join(F.collect_list("part"), ","), F.lit("}")).alias("text")).select(
        F.concat(F.lit("set"), F.col("grp").cast("string")).alias("dataset"), "text"
    )


@query(
    "src5_metadata_samples",
    "WITH "
    + META_ITEMS_SQL
    + f""", kept AS (SELECT *, row_number() OVER (PARTITION BY grp, split, cat ORDER BY doc_id) AS rn FROM items)
    SELECT 'set' || CAST(grp AS VARCHAR) AS dataset,
      coalesce(cls, CASE WHEN grp % 3 = 0 AND split = 'test' THEN 'default' ELSE cat END) AS category, split, path AS image_path, label,
      CASE WHEN lower(coalesce(nullif(kind, ''), CASE WHEN label <> 0 THEN 'defect' ELSE 'good' END)) IN {NORMAL_SQL} THEN 'good'
           ELSE coalesce(nullif(kind, ''), CASE WHEN label <> 0 THEN 'defect' ELSE 'good' END) END AS defect_type
    FROM kept WHERE (grp % 3 <> 2 OR split = 'test' OR rn = 1) AND path LIKE '%.png' AND (split = 'test' OR label = 0)
      AND doc_id IN (SELECT doc_id FROM documents WHERE n_chars > 300)""",
)
def metadata_samples(spark, folder):
    manifest = table(spark, folder, "documents").where("n_chars > 300").select(
        F.concat(F.lit("img/"), F.col("doc_id").cast("string"), F.lit(".png")).alias("path")
    )
    return documents.metadata_samples(_metadata_docs(spark, folder), manifest)


# --- SRC6 - SRC11, SRC13: listings -----------------------------------------------------


@query(
    "src6_layout_samples",
    PARTS_SQL
    + f""", lit AS (SELECT DISTINCT category, lower(dir) AS split, string_split(path, '/')[-1] AS name FROM rows_
         WHERE child = 'Label' AND is_image AND foreground)
    SELECT 'demo' AS dataset, category, 'train' AS split, path AS image_path, 0 AS label, 'good' AS defect_type
      FROM rows_ WHERE is_image AND dir = 'train' AND child IN {NORMAL_SQL}
    UNION ALL
    SELECT 'demo', category, 'test', path, CAST(child <> 'good' AS INTEGER), child FROM rows_ WHERE is_image AND dir = 'test'
    UNION ALL
    SELECT 'demo', category, lower(dir), path, CAST(has AS INTEGER), CASE WHEN has THEN 'defect' ELSE 'good' END FROM (
      SELECT *, EXISTS (SELECT 1 FROM lit l WHERE l.category = r.category AND l.split = lower(r.dir) AND starts_with(l.name, r.stem)) AS has
      FROM rows_ r WHERE is_image AND child IS NULL AND dir IN ('Train', 'Test')) WHERE dir = 'Test' OR NOT has""",
)
def layout_samples(spark, folder):
    return layout.layout_samples(files(spark, folder), "demo")


@query("src7_image_listing", "WITH " + FILES_SQL + f" SELECT path, size FROM files WHERE {IMAGE_SQL}")
def image_listing(spark, folder):
    return layout.image_files(files(spark, folder)).select("path", "size")


@query(
    "src8_category_folders",
    PARTS_SQL + "SELECT DISTINCT category FROM rows_ WHERE dir IN ('train', 'Train', 'test', 'Test', 'training', 'testing')",
)
def category_folders(spark, folder):
    return layout.discover_categories(files(spark, folder))


@query(
    "src9_folder_metadata",
    PARTS_SQL
    + """, masks AS (SELECT category, child AS kind, path, stem FROM rows_ WHERE is_image AND dir = 'ground_truth'),
    test AS (SELECT * FROM rows_ WHERE is_image AND dir = 'test')
    SELECT 'train' AS split, category, path AS img_path, 'good' AS specie_name, 0 AS anomaly, CAST(NULL AS VARCHAR) AS mask_path
      FROM rows_ WHERE is_image AND dir = 'train' AND child = 'good'
    UNION ALL
    SELECT 'test', t.category, t.path, t.child, CAST(t.child <> 'good' AS INTEGER),
      CASE WHEN t.child <> 'good' THEN (SELECT min(m.path) FROM masks m WHERE m.category = t.category AND m.kind = t.child
         AND (m.stem = t.stem OR starts_with(m.stem, t.stem || '_'))) END
      FROM test t""",
)
def folder_metadata(spark, folder):
    return layout.folder_metadata(files(spark, folder))


@query(
    "src9_written_metadata",
    PARTS_SQL
    + """SELECT 'demo' AS dataset, category, 'train' AS split, path AS image_path, 0 AS label, 'good' AS defect_type
      FROM rows_ WHERE is_image AND dir = 'train' AND child = 'good'
    UNION ALL SELECT 'demo', category, 'test', path, CAST(child <> 'good' AS INTEGER), child FROM rows_ WHERE is_image AND dir = 'test'""",
)
def written_metadata(spark, folder):
    """Metadata of the folders written as nested documents and read back as samples."""
    path = shared_path(spark, "metadata")
    listing = files(spark, folder)
    sinks.write_documents(sinks.metadata_documents(layout.folder_metadata(listing)), path, ["category"])
    docs = documents.read_json_files(spark, path).select(F.lit("demo").alias("dataset"), "text")
    return documents.metadata_samples(docs, listing).select("dataset", "category", "split", "image_path", "label", "defect_type")


@query(
    "src10_masked_metadata",
    PARTS_SQL
    + """, masks AS (
      SELECT category, dir, regexp_replace(stem, '_label$', '') AS stem, arg_min(path, path) AS path, arg_min(foreground, path) AS lit
      FROM rows_ WHERE is_image AND child = 'Label' GROUP BY ALL),
    joined AS (SELECT r.category, lower(r.dir) AS split, r.path AS img_path, m.path AS mask_path, coalesce(m.lit, false) AS has
      FROM rows_ r LEFT JOIN masks m ON m.category = r.category AND m.dir = r.dir AND m.stem = r.stem
      WHERE r.is_image AND r.child IS NULL AND r.dir IN ('Train', 'Test'))
    SELECT split, category, img_path, CASE WHEN has THEN 'defect' ELSE 'good' END AS specie_name, CAST(has AS INTEGER) AS anomaly, mask_path
    FROM joined WHERE split = 'test' OR NOT has""",
)
def masked_metadata(spark, folder):
    return layout.masked_metadata(files(spark, folder))


@query(
    "src11_mask_matches",
    PARTS_SQL
    + """, stems AS (SELECT DISTINCT category, child, stem FROM rows_ WHERE dir = 'test' AND is_image),
    masks AS (SELECT category, child, path, stem FROM rows_ WHERE is_image AND dir = 'ground_truth')
    SELECT s.category, s.child AS specie_name, s.stem AS stem, min(m.path) AS mask_path FROM stems s
    JOIN masks m ON m.category = s.category AND m.child = s.child AND (m.stem = s.stem OR starts_with(m.stem, s.stem || '_')) GROUP BY ALL""",
)
def mask_matches(spark, folder):
    from plumbline.functions.paths import is_image, stem

    rows = files(spark, folder).where(is_image(F.col("path"))).withColumn("_p", F.split("path", "/"))
    rows = rows.withColumns(
        {"category": F.get("_p", F.lit(0)), "specie_name": F.get("_p", F.lit(2)), "_own": stem(F.col("path"))}
    )
    stems = rows.where(F.get("_p", F.lit(1)) == "test").select("category", "specie_name", F.col("_own").alias("_stem"))
    masks = rows.where(F.get("_p", F.lit(1)) == "ground_truth").select(
        "category", "specie_name", F.col("path").alias("mask_path"), F.col("_own").alias("_full")
    )
    out = layout.match_masks(stems.distinct(), masks, ["category", "specie_name"])
    return out.withColumnRenamed("_stem", "stem")


@query(
    "src12_mask_foreground",
    "WITH "
    + HEATMAPS_SQL
    + """ SELECT image_id, list_bool_or(list_transform(vals, lambda v: v > 0.2)) AS has_foreground,
      len(list_filter(vals, lambda v: CAST(floor(v * 255) AS INTEGER) > 127)) AS lit_pixels FROM heatmaps""".replace(
        "list_bool_or(list_transform(vals, lambda v: v > 0.2))", "len(list_filter(vals, lambda v: v > 0.2)) > 0"
    ),
)
def mask_foreground(spark, folder):
    """Foreground test of mask pixels, and the binarised form of 8-bit files (value above 127)."""
    return heatmaps(spark, folder).select(
        "image_id",
        F.exists("vals", lambda v: v > 0.2).alias("has_foreground"),
        F.size(F.filter("vals", lambda v: F.floor(v * 255) > 127)).cast("long").alias("lit_pixels"),
    )


@query(
    "src13_support_images",
    PARTS_SQL
    + """, ranked AS (SELECT category, path, string_split(path, '/')[-1] AS name,
        CASE dir || '/' || child WHEN 'train/bad' THEN 1 WHEN 'train/good' THEN 2 WHEN 'test/good' THEN 3 END AS rk FROM rows_ WHERE is_image),
    best AS (SELECT category, min(rk) AS rk FROM ranked GROUP BY category)
    SELECT category, path, place FROM (SELECT r.category, path, CAST(row_number() OVER (PARTITION BY r.category ORDER BY name) AS INTEGER) AS place
      FROM ranked r JOIN best b ON b.category = r.category AND b.rk = r.rk) WHERE place <= 4""",
)
def support_images(spark, folder):
    return layout.support_images(files(spark, folder), ["train/bad", "train/good", "test/good"], 4)


@query(
    "src14_reference_images",
    """WITH m AS (SELECT DISTINCT r_name || '/' || lpad(CAST(s_suppkey % 5 AS VARCHAR), CAST(3 + s_suppkey % 2 AS INTEGER), '0') || '/' || n_name || '.png' AS path
      FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey),
    w AS (SELECT r_name AS category, n_name AS region, unnest([0, 1, 2, 3]) AS shot FROM nation JOIN region ON r_regionkey = n_regionkey),
    c AS (SELECT w.*, wd, category || '/' || lpad(CAST(shot AS VARCHAR), CAST(wd AS INTEGER), '0') || '/' || region || '.png' AS path FROM w, (SELECT unnest([3, 4]) AS wd))
    SELECT category, region, CAST(shot AS INTEGER) AS shot, arg_max(path, wd) AS path FROM c JOIN m USING (path) GROUP BY ALL""",
)
def reference_images(spark, folder):
    nation = table(spark, folder, "nation").join(
        F.broadcast(table(spark, folder, "region")), F.col("n_regionkey") == F.col("r_regionkey")
    )
    regions = nation.select(F.col("r_name").alias("category"), F.col("n_name").alias("region"))
    supp = F.col("s_suppkey")
    shot = F.when(supp % 2 == 0, F.lpad((supp % 5).cast("string"), 3, "0")).otherwise(F.lpad((supp % 5).cast("string"), 4, "0"))
    manifest = (
        table(spark, folder, "supplier")
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .select(F.concat_ws("/", "r_name", shot, F.concat("n_name", F.lit(".png"))).alias("path"))
    )
    return layout.reference_images(regions, manifest)


@query(
    "src15_knowledge_scan",
    "WITH "
    + KB_SQL
    + """ SELECT category, target AS target_object, count(DISTINCT pos) AS region_count, count(*) AS defect_count FROM kb_defects
      WHERE p_size BETWEEN 3 AND 45 AND p_partkey % 17 <> 0 GROUP BY ALL""",
)
def knowledge_scan(spark, folder):
    out = documents.knowledge_bases(knowledge_files(spark, folder))
    return out.select(
        "category",
        "kb.target_object",
        F.size("kb.regions").cast("long").alias("region_count"),
        F.aggregate(
            F.map_values("kb.regions"), F.lit(0), lambda n, r: n + F.size(r["defects"])
        ).cast("long").alias("defect_count"),
    )


# --- SRC16, SRC17, SRC20: nested configuration documents -------------------------------


def _configs(spark, folder):
    key, price = F.col("p_partkey"), F.col("p_retailprice").cast("string")
    section = F.concat(
        F.lit('{"decision_parameters": {"binary_ad": {"localizer": "Main", "source": "snapshot", "shots": {"0-shot": {"SetA": {"c1": '),
        price,
        F.lit(', "c2": "none"}}, "1-shot": {"SetB": {"c1": '),
        F.col("p_size").cast("string"),
        F.lit('}}, "many": {"SetC": {"c9": 1}}}}, "heatmap_by_shot": {"shots": {"0-shot": {"image": {"c1": 0.5, "c2": '),
        price,
        F.lit('}, "pixel_level_cutoffs": {"SetA": {"c1": 0.1, "c3": 0.3}, "SetB": {"c1": '),
        F.col("p_size").cast("string"),
        F.lit('}}}, "1": {"pixel": {"c7": "x", "c8": 0.8}}}}}}'),
    )
    return table(spark, folder, "part").select(key.alias("config_id"), section.alias("text"))


@query(
    "src16_decision_table",
    """SELECT p_partkey AS config_id, 'seta' AS dataset, 'main' AS localizer, 0 AS shot, 'c1' AS category, p_retailprice AS threshold, 'snapshot' AS source FROM part
    UNION ALL SELECT p_partkey, 'setb', 'main', 1, 'c1', CAST(p_size AS DOUBLE), 'snapshot' FROM part""",
)
def decision_table(spark, folder):
    return documents.decision_table(_configs(spark, folder), "main")


@query(
    "src17_cutoff_tables",
    """SELECT p_partkey AS config_id, unnest([0, 0, 0, 0, 1]) AS shot, unnest(['image', 'image', 'pixel', 'pixel', 'pixel']) AS level,
      unnest(['c1', 'c2', 'c1', 'c3', 'c8']) AS category, unnest([0.5::DOUBLE, p_retailprice, CAST(p_size AS DOUBLE), 0.3::DOUBLE, 0.8::DOUBLE]) AS cutoff FROM part""",
)
def cutoff_tables(spark, folder):
    return documents.cutoff_tables(_configs(spark, folder))


@query(
    "src20_offline_assets",
    "WITH "
    + PREDICTIONS_SQL
    + """ SELECT p.image_path, p.dataset, p.category, s_suppkey AS manifest_id, 'rim,body' AS regions, 2 + s_suppkey AS train_normal_total
      FROM predictions p JOIN supplier ON s_suppkey = p.ordinal % 50 AND 'set' || CAST(s_suppkey % 3 AS VARCHAR) = p.dataset
      WHERE p.category = 'cat' || CAST(s_suppkey % 9 AS VARCHAR)""",
)
def offline_assets(spark, folder):
    supp = F.col("s_suppkey")
    one = F.struct(
        F.concat(F.lit("cat"), (supp % 9).cast("string")).alias("category"),
        F.array(F.lit("rim"), F.lit("body")).alias("regions"),
        (supp + 2).cast("int").alias("train_normal_total"),
    )
    sets = F.array(F.struct(F.concat(F.lit("SET"), (supp % 3).cast("string")).alias("dataset"), F.array(one).alias("categories")))
    docs = table(spark, folder, "supplier").select(
        supp.alias("manifest_id"), F.to_json(F.struct(sets.alias("datasets"))).alias("text")
    )
    wanted = predictions(spark, folder).withColumn("manifest_id", F.col("ordinal") % 50)
    out = wanted.join(documents.manifest_assets(docs), ["manifest_id", "dataset", "category"])
    return out.select(
        "image_path", "dataset", "category", "manifest_id", F.array_join("regions", ",").alias("regions"),
        F.col("train_normal_total").cast("long").alias("train_normal_total"),
    )


# --- SRC18, SRC19, JN2, SNK: logs ------------------------------------------------------

LOG_SQL = (
    "WITH "
    + PREDICTIONS_SQL
    + """, log AS (
      SELECT ordinal, dataset, category, image_path, label, prediction FROM predictions
      UNION ALL SELECT ordinal + 1000000, dataset, category, image_path, label, 1 - prediction FROM predictions WHERE ordinal % 3 = 0
      UNION ALL SELECT ordinal + 2000000, dataset, category, image_path, label, 1 FROM predictions WHERE label = 1)
"""
)


def _log_lines(spark, folder):
    rows = predictions(spark, folder)
    again = rows.where(F.col("ordinal") % 3 == 0).withColumns(
        {"ordinal": F.col("ordinal") + 1000000, "prediction": 1 - F.col("prediction")}
    )
    forced = rows.where("label = 1").withColumns({"ordinal": F.col("ordinal") + 2000000, "prediction": F.lit(1)})
    good = rows.unionByName(again).unionByName(forced)
    lines = good.select("ordinal", F.to_json(F.struct("dataset", "category", "image_path", "label", "prediction")).alias("text"))
    broken = rows.where(F.col("ordinal") % 5 == 0).select(
        (F.col("ordinal") + 3000000).alias("ordinal"),
        F.when(F.col("ordinal") % 2 == 0, "  ").otherwise('{"image_path": "img/1.png", "label"').alias("text"),
    )
    return lines.unionByName(broken)


@query(
    "src18_earlier_results",
    LOG_SQL
    + """SELECT image_path, ordinal, dataset, category, label, prediction, prediction = label AS correct, 0.0::DOUBLE AS score, '' AS score_policy FROM (
      SELECT *, row_number() OVER (PARTITION BY image_path ORDER BY ordinal DESC) AS rn FROM log) WHERE rn = 1""",
)
def earlier_results(spark, folder):
    out = documents.earlier_results(_log_lines(spark, folder))
    return out.select("image_path", "ordinal", "dataset", "category", "label", "prediction", "correct", "score", "score_policy")


@query(
    "src19_merged_parts",
    ANSWERS_SQL
    + """SELECT subclass, task_type, total, correct, wrong_count, normal_total FROM (
      SELECT subclass, task_type, count(*) AS total, count(*) FILTER (correct) AS correct, count(*) FILTER (NOT correct) AS wrong_count,
      count(*) FILTER (is_normal AND turn % 2 = 0) AS normal_total FROM answers GROUP BY ALL)""",
)
def merged_parts(spark, folder):
    """Two workers' outputs; the second never wrote the is_normal field."""
    rows = answers(spark, folder).select("subclass", "task_type", "correct", "is_normal", "turn")
    parts = [rows.where("turn % 2 = 0"), rows.where("turn % 2 = 1").drop("is_normal")]
    merged = documents.merged_parts(parts).fillna(False, ["is_normal"])
    return answer_counts(merged).select("subclass", "task_type", "total", "correct", "wrong_count", "normal_total")


@query(
    "jn2_resumed_predictions",
    LOG_SQL
    + """, last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image_path ORDER BY ordinal DESC) AS rn FROM log) WHERE rn = 1),
    fresh AS (SELECT 'img/' || CAST(doc_id AS VARCHAR) || '.png' AS image_path, CAST(n_chars > 1000 AS INTEGER) AS prediction FROM documents)
    SELECT f.image_path, coalesce(l.prediction, f.prediction) AS prediction, l.image_path IS NOT NULL AS reused
    FROM fresh f LEFT JOIN last l USING (image_path)""",
)
def resumed_predictions(spark, folder):
    """Images predicted before keep their row; only the others are scored."""
    images = table(spark, folder, "documents").select(
        F.concat(F.lit("img/"), F.col("doc_id").cast("string"), F.lit(".png")).alias("image_path"), "n_chars"
    )
    old = documents.earlier_results(_log_lines(spark, folder)).select("image_path", "prediction")
    pending = images.join(old, "image_path", "left_anti").select(
        "image_path", (F.col("n_chars") > 1000).cast("int").alias("prediction"), F.lit(False).alias("reused")
    )
    kept = old.join(images, "image_path", "left_semi").withColumn("reused", F.lit(True))
    return pending.unionByName(kept)


@query(
    "snk2_wrong_answers",
    ANSWERS_SQL
    + "SELECT subclass, replace(task_type, ' ', '_') AS task, image_path, turn, given_answer FROM answers WHERE NOT correct",
)
def wrong_answers(spark, folder):
    """Wrong answers written in a folder per subclass and task, and read back."""
    path = shared_path(spark, "wrong")
    rows = answers(spark, folder).select("subclass", "task_type", "image_path", "turn", "given_answer", "correct")
    sinks.write_wrong_answers(rows, path)
    fields = "image_path string, turn long, given_answer string, subclass string, task string"
    return spark.read.schema(fields).json(path).select("subclass", "task", "image_path", "turn", "given_answer")


@query(
    "snk3_missing_results",
    ANSWERS_SQL + "SELECT conv_id, turn FROM answers WHERE NOT (correct OR length(question) > 100)",
)
def missing_results(spark, folder):
    samples = answers(spark, folder)
    done = samples.where(F.col("correct") | (F.length("question") > 100)).select("conv_id", "turn")
    return sinks.missing_results(samples, done, ["conv_id", "turn"]).select("conv_id", "turn")


@query("snk1_written_lines", "WITH " + PREDICTIONS_SQL + " SELECT * FROM predictions")
def written_lines(spark, folder):
    """Prediction rows written as JSON lines and read back."""
    path = shared_path(spark, "lines")
    sinks.write_lines(predictions(spark, folder), path)
    return spark.read.schema(predictions(spark, folder).schema).json(path)
