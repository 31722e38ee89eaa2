"""JSON documents: question files, split metadata, knowledge bases, threshold tables, result logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions.paths import is_image, is_normal_name
from plumbline.operators.joins import hold

QA_SCHEMA = (
    "map<string, struct<image_path: string, conversation: array<struct<annotation: boolean, "
    "Question: string, Answer: string, Options: map<string,string>, type: string>>>>"
)
KNOWLEDGE_SCHEMA = (
    "struct<target_object: string, regions: map<string, struct<definition: string, normal_standard: string, "
    "critical_check: string, defects: array<struct<type: string, visual_signature: string, contrast_vs_normal: string, "
    "visual_attributes: array<string>, examples: array<string>, "
    "distinctions: array<struct<target_defect: string, difference: string>>>>, anti_hallucination_rules: array<string>>>>"
)
ITEM_SCHEMA = (
    "struct<img_path: string, image_path: string, path: string, cls_name: string, specie_name: string, "
    "defect_type: string, anomaly: int, label: int>"
)
RESULT_SCHEMA = (
    "struct<dataset: string, category: string, image_path: string, defect_type: string, label: int, score: double, "
    "threshold: double, prediction: int, correct: boolean, localizer_category: string, score_policy: string>"
)


PROFILE_SCHEMA = (
    "struct<dataset: string, category: string, defect_prompts: boolean, audited_roles: array<string>, "
    "prompts: array<struct<role: string, text: string, threshold: double, use_for_object_mask: boolean, use_for_refinement: boolean>>>"
)
SPEC_RULE_SCHEMA = (
    "struct<dataset: string, rule_order: int, pattern: string, regions: array<struct<region: string, definition: string, normal_standard: string, "
    "critical_check: string, visual_attributes: array<string>, prompt: string, crop_box: array<double>>>>"
)


def read_json_files(spark, path: str) -> DataFrame:
    """One row per file: path, text."""
    rows = spark.read.text(path, wholetext=True)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def question_rows(files: DataFrame) -> DataFrame:
    """Annotated question turns; ``files`` has subclass and text. Order columns keep the file's order."""
    images = files.select("subclass", F.posexplode_outer(F.from_json("text", QA_SCHEMA)).alias("image_pos", "key", "item"))
    turns = images.where(F.col("item").isNotNull()).select(
        "subclass",
        "image_pos",
        F.coalesce("item.image_path", "key").alias("image_path"),
        F.posexplode("item.conversation").alias("turn_pos", "turn"),
    )
    return turns.where(F.coalesce("turn.annotation", F.lit(False))).select(
        "subclass",
        "image_pos",
        "turn_pos",
        "image_path",
        F.col("turn.Question").alias("question"),
        F.col("turn.Answer").alias("gt_answer"),
        F.col("turn.Options").alias("options"),
        F.coalesce("turn.type", F.lit("Unknown")).alias("task_type"),
    )


def first_existing(wanted: DataFrame, files: DataFrame, key: str, roots: list[str], name: str) -> DataFrame:
    """The file of the first root that has ``root/key/name``; unreadable JSON gives no row.

    ``files``: path, text.
    """
    candidates = wanted.select(
        key,
        F.posexplode(F.array(*[F.concat(F.lit(r + "/"), F.col(key), F.lit("/" + name)) for r in roots])).alias(
            "priority", "path"
        ),
    )
    chosen = (
        candidates.join(files, "path").groupBy(key).agg(F.min(F.struct("priority", "path", "text")).alias("_f"))
    )
    out = chosen.select(key, F.col("_f.path").alias("path"), F.col("_f.text").alias("text"))
    return out.where(F.try_parse_json("text").isNotNull())


def metadata_samples(docs: DataFrame, manifest: DataFrame, category: str | None = None) -> DataFrame:
    """Samples from split metadata. ``docs``: dataset, text; a split is {category: [items]},
    {category: item} or [items]. Only files of the manifest count."""
    splits = docs.select(
        "dataset",
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(s).alias("split"), F.get_json_object("text", f"$.{s}").alias("body"))
                    for s in ("train", "test")
                ]
            )
        ).alias("s"),
    ).select("dataset", "s.split", F.ltrim("s.body").alias("body"))
    as_list = F.startswith("body", F.lit("["))
    named = F.when(~as_list, F.map_entries(F.from_json("body", "map<string,string>")))
    listed = F.when(
        as_list, F.array(F.struct(F.lit("default").alias("key"), F.col("body").alias("value")))
    )
    groups = splits.select("dataset", "split", F.explode(F.coalesce(named, listed)).alias("g"))
    raw = F.ltrim("g.value")
    items = F.when(F.startswith(raw, F.lit("[")), F.from_json(raw, "array<string>")).otherwise(F.array(raw))
    rows = groups.select("dataset", "split", F.col("g.key").alias("key"), F.explode(items).alias("raw"))
    rows = rows.where(F.startswith("raw", F.lit("{"))).select(
        "dataset", "split", "key", F.from_json("raw", ITEM_SCHEMA).alias("i")
    )

    def text(*names):
        return F.coalesce(*[F.nullif(F.col(f"i.{n}"), F.lit("")) for n in names])

    label = F.coalesce("i.anomaly", "i.label", F.lit(0))
    kind = F.coalesce(text("specie_name", "defect_type"), F.when(label != 0, "defect").otherwise("good"))
    rows = rows.select(
        "dataset",
        F.coalesce(text("cls_name"), F.col("key")).alias("category"),
        "split",
        text("img_path", "image_path", "path").alias("image_path"),
        label.alias("label"),
        F.when(is_normal_name(kind), "good").otherwise(kind).alias("defect_type"),
    )
    rows = rows.where(is_image(F.col("image_path")) & ((F.col("split") == "test") | (F.col("label") == 0)))
    if category is not None:
        rows = rows.where(F.col("category") == category)
    return rows.join(manifest.select(F.col("path").alias("image_path")), "image_path", "left_semi")


def knowledge_bases(files: DataFrame) -> DataFrame:
    """Readable knowledge files: category and parsed ``kb``. Copies named ``*_origin.json`` are skipped."""
    name = F.element_at(F.split("path", "/"), -1)
    active = name.endswith(".json") & ~name.endswith("_origin.json")
    parsed = F.from_json("text", KNOWLEDGE_SCHEMA)
    # held, as the optimizer would parse each text once per condition, and do so where the files are listed, before any shuffle deals them
    bases = hold(files.where(active).select(F.regexp_replace(name, r"\.json$", "").alias("category"), parsed.alias("kb")))
    return bases.where(F.col("kb.target_object").isNotNull() & F.col("kb.regions").isNotNull())


def _shot(text) -> F.Column:
    return F.trim(F.replace(text, F.lit("-shot"), F.lit(""))).try_cast("int")


def decision_table(configs: DataFrame, default_localizer: str) -> DataFrame:
    """Flat threshold rows from nested configuration JSON (shots -> datasets -> categories)."""
    section = F.coalesce(
        F.get_json_object("text", "$.decision_parameters.binary_ad"), F.get_json_object("text", "$.binary_ad_thresholds_by_shot")
    )
    nested = F.from_json(F.get_json_object(section, "$.shots"), "map<string,map<string,map<string,string>>>")
    return (
        configs.withColumn("_localizer", F.lower(F.coalesce(F.get_json_object(section, "$.localizer"), F.lit(default_localizer))))
        .withColumn("_source", F.get_json_object(section, "$.source"))
        .select("config_id", "_localizer", "_source", F.explode(nested).alias("_shot", "_sets"))
        .select("config_id", "_localizer", "_source", _shot(F.col("_shot")).alias("shot"), F.explode("_sets").alias("_set", "_cats"))
        .where(F.col("shot").isNotNull())
        .select("config_id", "_localizer", "_source", "shot", F.lower("_set").alias("dataset"), F.explode("_cats").alias("category", "_t"))
        .select(
            "config_id",
            "dataset",
            F.col("_localizer").alias("localizer"),
            "shot",
            "category",
            F.col("_t").try_cast("double").alias("threshold"),
            F.col("_source").alias("source"),
        )
        .where(F.col("threshold").isNotNull())
    )


def cutoff_tables(configs: DataFrame) -> DataFrame:
    """Map cutoffs per shot, level and category. A group is {category: value} or {dataset: {category: value}};
    in the second form a later dataset overrides an earlier one."""
    shots = F.coalesce(
        F.get_json_object("text", "$.decision_parameters.heatmap_by_shot.shots"), F.get_json_object("text", "$.thresholds_by_shot")
    )
    rows = configs.select("config_id", F.explode(F.from_json(shots, "map<string,string>")).alias("_shot", "_group"))
    levels = F.explode(
        F.create_map(
            F.lit("image"),
            F.coalesce(F.get_json_object("_group", "$.image_level_cutoffs"), F.get_json_object("_group", "$.image")),
            F.lit("pixel"),
            F.coalesce(F.get_json_object("_group", "$.pixel_level_cutoffs"), F.get_json_object("_group", "$.pixel")),
        )
    )
    rows = rows.select("config_id", _shot(F.col("_shot")).alias("shot"), levels.alias("level", "_body")).where("shot is not null")
    entries = rows.select("config_id", "shot", "level", F.posexplode(F.from_json("_body", "map<string,string>")).alias("_pos", "_k", "_v"))
    entries = entries.withColumn("_direct", F.col("_v").try_cast("double"))
    any_direct = F.bool_or(F.col("_direct").isNotNull()).over(W.partitionBy("config_id", "shot", "level"))
    entries = entries.withColumn("_flat", any_direct)
    flat = entries.where("_flat and _direct is not null").select("config_id", "shot", "level", F.lit(0).alias("_pos"), F.col("_k").alias("category"), F.col("_direct").alias("cutoff"))
    grouped = (
        entries.where("not _flat")
        .select("config_id", "shot", "level", "_pos", F.explode(F.from_json("_v", "map<string,string>")).alias("category", "_c"))
        .select("config_id", "shot", "level", "_pos", "category", F.col("_c").try_cast("double").alias("cutoff"))
        .where("cutoff is not null")
    )
    return flat.unionByName(grouped).groupBy("config_id", "shot", "level", "category").agg(F.max_by("cutoff", "_pos").alias("cutoff"))


def earlier_results(lines: DataFrame) -> DataFrame:
    """Readable log lines (ordinal, text), the last one per image, missing fields defaulted."""
    parsed = lines.where(F.trim("text") != "").select(
        "ordinal", F.from_json("text", RESULT_SCHEMA + "", {"mode": "PERMISSIVE"}).alias("r"), F.try_parse_json("text").alias("v")
    )
    rows = parsed.where(F.col("v").isNotNull() & F.startswith(F.ltrim(F.to_json("v")), F.lit("{"))).select("ordinal", "r.*")

    def text(name):
        return F.coalesce(name, F.lit("")).alias(name)

    label, prediction = F.coalesce("label", F.lit(0)), F.coalesce("prediction", F.lit(0))
    rows = rows.select(
        "ordinal",
        text("dataset"),
        text("category"),
        text("image_path"),
        text("defect_type"),
        label.alias("label"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
        F.coalesce("threshold", F.lit(0.0)).alias("threshold"),
        prediction.alias("prediction"),
        F.coalesce("correct", prediction == label).alias("correct"),
        text("localizer_category"),
        text("score_policy"),
    )
    return last_per_image(rows)


def last_per_image(rows: DataFrame, key: str = "image_path", order: str = "ordinal") -> DataFrame:
    """Later rows override earlier ones; combines before the shuffle, so repeats of one image stay cheap."""
    columns = [c for c in rows.columns if c not in (key, order)]
    last = rows.groupBy(key).agg(F.max(F.struct(F.col(order), *columns)).alias("_last"))
    return last.select(key, F.col(f"_last.{order}").alias(order), *[F.col(f"_last.{c}").alias(c) for c in columns])


def manifest_assets(manifests: DataFrame, region_field: str = "regions") -> DataFrame:
    """Offline assets per (dataset, category) from manifest documents (manifest_id, text)."""
    schema = (
        "struct<datasets: array<struct<dataset: string, categories: array<struct<category: string, "
        f"{region_field}: array<string>, offline_reference_paths: array<string>, train_normal_total: int>>>>>"
    )
    sets = manifests.select("manifest_id", F.explode(F.from_json("text", schema)["datasets"]).alias("d"))
    rows = sets.select("manifest_id", F.lower("d.dataset").alias("dataset"), F.explode("d.categories").alias("c"))
    return rows.select(
        "manifest_id",
        "dataset",
        F.col("c.category").alias("category"),
        F.col(f"c.{region_field}").alias("regions"),
        F.col("c.offline_reference_paths").alias("reference_paths"),
        F.col("c.train_normal_total").alias("train_normal_total"),
    )


def prompt_profiles(files: DataFrame) -> DataFrame:
    """Prompts of profile documents (``text``), one row each in the profile's order; missing fields have their defaults.

    dataset, category, profile_order, role, prompt, threshold, use_for_object_mask, use_for_refinement, audited, defect_disabled.
    """
    docs = files.select(F.from_json("text", PROFILE_SCHEMA).alias("d")).where(F.col("d.category").isNotNull())
    rows = docs.select("d.dataset", "d.category", "d.audited_roles", F.coalesce("d.defect_prompts", F.lit(True)).alias("_defects"), F.posexplode("d.prompts").alias("profile_order", "p"))
    return rows.where(F.coalesce("p.role", F.lit("")) != "").select(
        "dataset",
        "category",
        "profile_order",
        F.col("p.role").alias("role"),
        F.coalesce("p.text", F.lit("")).alias("prompt"),
        F.coalesce("p.threshold", F.lit(0.4)).alias("threshold"),
        F.coalesce("p.use_for_object_mask", F.lit(False)).alias("use_for_object_mask"),
        F.coalesce("p.use_for_refinement", F.lit(True)).alias("use_for_refinement"),
        F.coalesce(F.array_contains("audited_roles", F.col("p.role")), F.lit(False)).alias("audited"),
        (~F.col("_defects")).alias("defect_disabled"),
    )


def region_spec_rules(files: DataFrame) -> DataFrame:
    """Rules of region-spec documents (``text``): dataset, rule_order, pattern (of category names) and the specs of their regions."""
    rules = files.select(F.from_json("text", SPEC_RULE_SCHEMA).alias("r")).where(F.col("r.dataset").isNotNull() & F.col("r.regions").isNotNull())
    return rules.select("r.dataset", F.coalesce("r.rule_order", F.lit(0)).alias("rule_order"), F.coalesce("r.pattern", F.lit(".*")).alias("pattern"), "r.regions")


def merged_parts(parts: list[DataFrame]) -> DataFrame:
    """Rows of several workers' outputs; absent columns become null."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out
