"""From a file listing (path, ...) to samples, metadata and masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions import paths as P
from plumbline.operators.joins import attach


def list_files(spark, root: str) -> DataFrame:
    """Relative path and size of every file below ``root``; contents are not read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")
    # a path may spell the root's scheme in another way, so it is cut behind the root's own name
    name = root.rstrip("/").rpartition("/")[2]
    return rows.select(
        F.element_at(F.split("path", f"/\\Q{name}\\E/", 2), -1).alias("path"), F.col("length").alias("size")
    )


def image_files(files: DataFrame) -> DataFrame:
    return files.where(P.is_image(F.col("path")))


def _parts(files: DataFrame) -> DataFrame:
    parts = F.split("path", "/")
    return files.withColumn("_p", parts).withColumns(
        {
            "category": F.get("_p", F.lit(0)),
            "_split": F.when(F.size("_p") > 2, F.get("_p", F.lit(1))),
            "_child": F.when(F.size("_p") > 3, F.get("_p", F.lit(2))),
        }
    )


def discover_categories(files: DataFrame, root_name: str = "") -> DataFrame:
    """Top folders that hold a train or test folder; the root itself when there are none."""
    known = F.col("_split").isin(P.TRAIN_NAMES + P.TEST_NAMES)
    found = _parts(files).groupBy("category").agg(F.bool_or(F.coalesce(known, F.lit(False))).alias("_k")).where("_k")
    found = found.select("category")
    none = found.agg(F.count(F.lit(1)).alias("n")).where("n = 0").select(F.lit(root_name).alias("category"))
    return found.unionByName(none)


def describe_layout(files: DataFrame, dataset: str = "dataset") -> DataFrame:
    """Layout class per dataset, judged by its first category in name order; ``path`` is below the dataset root."""
    parts = F.split("path", "/")
    rows = files.select(
        dataset,
        (F.col("path") == "meta.json").alias("_meta"),
        F.when(F.size(parts) > 2, F.get(parts, F.lit(0))).alias("_category"),
        F.when(F.size(parts) > 2, F.get(parts, F.lit(1))).alias("_dir"),
    )
    per_category = rows.groupBy(dataset, "_category").agg(
        F.bool_or("_meta").alias("_meta"),
        F.bool_or(F.col("_dir").isin(P.LABEL_NAMES)).alias("_label"),
        F.bool_or(F.col("_dir").isin(P.TRAIN_NAMES)).alias("_train"),
        F.bool_or(F.col("_dir").isin(P.TEST_NAMES)).alias("_test"),
    )
    split_dirs = F.col("_category").isNotNull() & (F.col("_train") | F.col("_test"))
    first = F.min_by(F.struct("_label", "_train", "_test"), F.when(split_dirs, F.col("_category")))
    return (
        per_category.groupBy(dataset)
        .agg(F.bool_or("_meta").alias("_meta"), first.alias("_f"))
        .select(
            dataset,
            F.when(F.col("_meta"), "meta_json")
            .when(F.col("_f").isNull(), "unknown")
            .when(F.col("_f._label"), "flat_test_with_label_masks")
            .when(F.col("_f._train") & F.col("_f._test"), "category_train_test_dirs")
            .otherwise("unknown")
            .alias("layout"),
        )
    )


def _with_lit_mask(images: DataFrame, masks: DataFrame, scope: list[str], files: DataFrame) -> DataFrame:
    """Add ``_lit``: a mask in the same scope whose stem starts with the image's stem has foreground.

    The prefix match is an equality join: each mask offers its prefixes, of those lengths
    only that occur among the stems of the listing's images (``files``).
    """
    images = images.withColumn("_stem", P.stem(F.col("path")))
    lengths = image_files(files).agg(F.array_sort(F.collect_set(F.length(P.stem(F.col("path"))))).alias("_lengths"))
    offered = (
        masks.where(P.is_image(F.col("path")) & F.col("foreground"))
        .select(*scope, P.file_name(F.col("path")).alias("_name"))
        .withColumn("_lengths", F.lit(lengths.scalar()))
        .withColumn("_n", F.explode(F.filter("_lengths", lambda n: n <= F.length("_name"))))
        .select(*scope, F.substring("_name", F.lit(1), F.col("_n")).alias("_stem"))
        .distinct()
        .withColumn("_lit", F.lit(True))
    )
    return images.join(offered, [*scope, "_stem"], "left").withColumn("_lit", F.coalesce("_lit", F.lit(False)))


def _folder_flags(rows: DataFrame) -> DataFrame:
    """Per category what its folders are: one aggregate to the set of (split, child) folders, of which the flags are computed."""

    def folders(name: str, names: list[str], where=None) -> Column:
        ranks = F.transform("_dirs", lambda d: F.when(F.lit(True) if where is None else where(d), P.name_rank(d[name], names)))
        return F.array_min(ranks)

    flags = rows.groupBy("category").agg(F.collect_set(F.struct("_split", "_child")).alias("_dirs")).withColumns(
        {
            "_train_rank": folders("_split", P.TRAIN_NAMES),
            "_test_rank": folders("_split", P.TEST_NAMES),
            "_own_label_rank": folders("_split", P.LABEL_NAMES),
        }
    )
    train = lambda d: F.coalesce(P.name_rank(d["_split"], P.TRAIN_NAMES) == F.col("_train_rank"), F.lit(False))
    test = lambda d: F.coalesce(P.name_rank(d["_split"], P.TEST_NAMES) == F.col("_test_rank"), F.lit(False))
    normal = lambda d: F.coalesce(P.is_normal_name(d["_child"]), F.lit(False))
    flags = flags.withColumns(
        {
            "_normal_dirs": F.exists("_dirs", lambda d: train(d) & normal(d)),
            "_child_dirs": F.exists("_dirs", lambda d: test(d) & d["_child"].isNotNull() & ~F.coalesce(P.is_label_name(d["_child"]), F.lit(False))),
            "_train_label_rank": folders("_child", P.LABEL_NAMES, train),
            "_test_label_rank": folders("_child", P.LABEL_NAMES, test),
        }
    )
    return flags.drop("_dirs")


def layout_samples(files: DataFrame, dataset: str) -> DataFrame:
    """Labelled samples from folder names: dataset, category, split, image_path, label, defect_type."""
    rows = _parts(files)
    child = F.col("_child")
    rows = attach(rows, _folder_flags(rows), ["category"]).withColumns(
        {
            "_in_train": F.coalesce(P.name_rank(F.col("_split"), P.TRAIN_NAMES) == F.col("_train_rank"), F.lit(False)),
            "_in_test": F.coalesce(P.name_rank(F.col("_split"), P.TEST_NAMES) == F.col("_test_rank"), F.lit(False)),
        }
    )
    image = P.is_image(F.col("path"))
    in_label = {
        "train": F.col("_in_train") & (P.name_rank(child, P.LABEL_NAMES) == F.col("_train_label_rank")),
        "test": F.when(
            F.col("_test_label_rank").isNotNull(),
            F.col("_in_test") & (P.name_rank(child, P.LABEL_NAMES) == F.col("_test_label_rank")),
        ).otherwise(P.name_rank(F.col("_split"), P.LABEL_NAMES) == F.col("_own_label_rank")),
    }
    masks = rows.withColumn("split", F.when(in_label["train"], "train").when(in_label["test"], "test")).where(F.col("split").isNotNull())

    good_train = F.col("_in_train") & (
        (F.col("_normal_dirs") & P.is_normal_name(child)) | (~F.col("_normal_dirs") & F.col("_train_label_rank").isNull())
    )
    foldered_test = F.col("_in_test") & F.col("_child_dirs") & child.isNotNull() & ~P.is_label_name(child)
    normal = P.is_normal_name(child)
    train, test = F.coalesce(good_train, F.lit(False)), F.coalesce(foldered_test, F.lit(False))
    named = rows.where(image & (train | test)).select(
        "category",
        F.when(train, "train").otherwise("test").alias("split"),
        F.col("path").alias("image_path"),
        F.when(train, False).otherwise(~normal).cast("int").alias("label"),
        F.when(train | normal, "good").otherwise(child).alias("defect_type"),
    )

    flat = rows.where(image & child.isNull() & (F.col("_in_train") | F.col("_in_test"))).withColumn(
        "split", F.when(F.col("_in_train"), "train").otherwise("test")
    )
    flat = flat.where(
        ((F.col("split") == "train") & ~F.col("_normal_dirs") & F.col("_train_label_rank").isNotNull())
        | ((F.col("split") == "test") & ~F.col("_child_dirs"))
    )
    flat = _with_lit_mask(flat, masks, ["category", "split"], files).where((F.col("split") == "test") | ~F.col("_lit"))
    defect = (F.col("split") == "test") & F.col("_lit")
    masked = flat.select(
        "category", "split", F.col("path").alias("image_path"), defect.cast("int").alias("label"), F.when(defect, "defect").otherwise("good").alias("defect_type")
    )
    return named.unionByName(masked).select(F.lit(dataset).alias("dataset"), "category", "split", "image_path", "label", "defect_type")


def folder_metadata(files: DataFrame) -> DataFrame:
    """Metadata items of a train/test/ground_truth tree.

    split, category, img_path, specie_name, anomaly, mask_path (null for normal items).
    A mask belongs to an image when their stems are equal or it continues with ``_``; of
    several the first path wins.
    """
    rows = _parts(files)
    kept = rows.groupBy("category").agg(
        F.bool_or(F.col("_split").isin("train", "Train", "test", "Test")).alias("_known"),
        F.bool_or((F.col("_split") == "train") & P.is_normal_name(F.col("_child"))).alias("_normal_dirs"),
    )
    rows = attach(rows, kept.where("_known"), ["category"])
    image, child = P.is_image(F.col("path")), F.col("_child")
    train = rows.where(
        image
        & (F.col("_split") == "train")
        & F.when(F.coalesce("_normal_dirs", F.lit(False)), P.is_normal_name(child)).otherwise(child.isNull())
    ).select(
        F.lit("train").alias("split"),
        "category",
        F.col("path").alias("img_path"),
        F.lit("good").alias("specie_name"),
        F.lit(0).alias("anomaly"),
        F.lit(None).cast("string").alias("mask_path"),
    )
    normal = P.is_normal_name(child)
    test = rows.where(image & (F.col("_split") == "test") & child.isNotNull() & ~P.is_label_name(child)).select(
        "category",
        F.col("path").alias("img_path"),
        F.when(normal, "good").otherwise(child).alias("specie_name"),
        (~normal).cast("int").alias("anomaly"),
        P.stem(F.col("path")).alias("_stem"),
    )
    masks = rows.where(image & (F.col("_split") == "ground_truth") & child.isNotNull()).select(
        "category", child.alias("specie_name"), F.col("path").alias("mask_path"), P.stem(F.col("path")).alias("_full")
    )
    found = match_masks(
        test.where("anomaly = 1").select("category", "specie_name", "_stem").distinct(), masks, ["category", "specie_name"]
    )
    test = test.join(found, ["category", "specie_name", "_stem"], "left").select(
        F.lit("test").alias("split"), "category", "img_path", "specie_name", "anomaly", "mask_path"
    )
    return train.unionByName(test)


def match_masks(stems: DataFrame, masks: DataFrame, scope: list[str]) -> DataFrame:
    """First mask path per (scope, _stem); masks carry ``_full`` (their stem) and ``mask_path``.

    Each mask offers the stems it can belong to: its own and those cut before an underscore.
    """
    words = F.split("_full", "_")
    offered = masks.withColumn(
        "_stem",
        F.explode(
            F.transform(F.sequence(F.lit(1), F.size(words)), lambda n: F.array_join(F.slice(words, F.lit(1), n), "_"))
        ),
    )
    return (
        offered.join(stems, [*scope, "_stem"], "left_semi").groupBy(*scope, "_stem").agg(F.min("mask_path").alias("mask_path"))
    )


def masked_metadata(files: DataFrame) -> DataFrame:
    """Metadata items of Train/Test folders whose labels come from masks in their Label folder."""
    rows = _parts(files).where(F.col("_split").isin("Train", "Test") & P.is_image(F.col("path")))
    split = F.lower("_split").alias("split")
    bare = F.regexp_replace(F.regexp_replace(P.stem(F.col("path")), "_label$", ""), "_mask$", "")
    masks = (
        rows.where(F.col("_child") == "Label")
        .groupBy("category", split, bare.alias("_stem"))
        .agg(
            F.min(F.struct("path", "foreground")).alias("_m"),
        )
    )
    images = rows.where(F.col("_child").isNull()).select(
        "category", split, F.col("path").alias("img_path"), P.stem(F.col("path")).alias("_stem")
    )
    label = F.coalesce(F.col("_m.foreground"), F.lit(False))
    out = images.join(masks, ["category", "split", "_stem"], "left").select(
        "split",
        "category",
        "img_path",
        F.when(label, "defect").otherwise("good").alias("specie_name"),
        label.cast("int").alias("anomaly"),
        F.col("_m.path").alias("mask_path"),
    )
    return out.where((F.col("split") == "test") | (F.col("anomaly") == 0))


def support_images(files: DataFrame, folders: list[str], limit: int) -> DataFrame:
    """First ``limit`` images by name from the first folder (of ``folders``, in order) that has any."""
    parts = F.split("path", "/")
    rows = image_files(files).where(F.size(parts) == 4).withColumns(
        {
            "category": F.get(parts, F.lit(0)),
            "_rank": P.name_rank(F.concat_ws("/", F.get(parts, F.lit(1)), F.get(parts, F.lit(2))), folders),
        }
    )
    rows = rows.where(F.col("_rank").isNotNull())
    best = rows.groupBy("category").agg(F.min("_rank").alias("_rank"))
    rows = attach(rows, best, ["category", "_rank"], "left_semi")
    place = F.row_number().over(W.partitionBy("category").orderBy(P.file_name(F.col("path"))))
    return rows.withColumn("place", place).where(F.col("place") <= limit).select("category", "path", "place")


def reference_images(regions: DataFrame, manifest: DataFrame, shots: int = 4) -> DataFrame:
    """Reference image per region and shot; a four-digit shot folder is preferred to a three-digit one.

    ``regions``: category, region. ``manifest``: path. Path form: category/<shot>/region.png.
    """

    def candidate(width: int) -> Column:
        shot = F.lpad(F.col("shot").cast("string"), width, "0")
        return F.concat_ws("/", "category", shot, F.concat("region", F.lit(".png")))

    wanted = regions.withColumn("shot", F.explode(F.sequence(F.lit(0), F.lit(shots - 1)))).withColumn(
        "_c", F.explode(F.array(F.struct(F.lit(4).alias("w"), candidate(4).alias("path")), F.struct(F.lit(3).alias("w"), candidate(3).alias("path"))))
    )
    found = wanted.select("category", "region", "shot", "_c.w", "_c.path").join(manifest, "path", "left_semi")
    return found.groupBy("category", "region", "shot").agg(F.max_by("path", "w").alias("path"))


def resolve_paths(rows: DataFrame, manifest: DataFrame) -> DataFrame:
    """Add ``resolved_path``: below the subclass folder, else the root, else without the repeated prefix.

    ``rows``: row_id, subclass, rel_path. Rows that resolve to nothing are dropped.
    """
    prefix = F.concat("subclass", F.lit("/"))
    stripped = F.when(
        F.startswith(F.col("rel_path"), prefix), F.expr("substring(rel_path, length(subclass) + 2)")
    )
    candidates = F.array(
        F.concat(prefix, F.col("rel_path")), F.col("rel_path"), F.concat(prefix, stripped)
    )
    found = (
        rows.select("row_id", F.posexplode(candidates).alias("_rank", "resolved_path"))
        .where(F.col("resolved_path").isNotNull())
        .join(manifest.select(F.col("path").alias("resolved_path")), "resolved_path", "left_semi")
        .groupBy("row_id")
        .agg(F.min_by("resolved_path", "_rank").alias("resolved_path"))
    )
    return rows.join(found, "row_id")
