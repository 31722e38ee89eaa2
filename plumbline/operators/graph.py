"""Knowledge graphs as node and edge tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions import text as T
from plumbline.functions.paths import safe_name
from plumbline.operators.joins import meet


def region_rows(bases: DataFrame) -> DataFrame:
    """category, target, pos, region and the region's fields."""
    rows = bases.select(
        "category", F.col("kb.target_object").alias("target"), F.posexplode(F.map_entries("kb.regions")).alias("pos", "r")
    )
    return rows.select("category", "target", "pos", F.col("r.key").alias("region"), "r.value.*")


def _defects(bases: DataFrame) -> DataFrame:
    rows = region_rows(bases).select("category", "target", "pos", "region", F.posexplode("defects").alias("k", "d"))
    return rows.withColumn("node_id", F.concat_ws("_", "region", "d.type"))


def _order(defect: str | None = None, distinction: str | None = None) -> Column:
    """Place of a statement in its file: region, defect in it, distinction in that; a million of each have their own place."""
    place = F.col("pos").cast("long") * (1 << 40)
    if defect:
        place = place + (F.col(defect) + 1).cast("long") * (1 << 20)
    return place + F.col(distinction).cast("long") + 1 if distinction else place


def graph_edges(bases: DataFrame) -> DataFrame:
    """category, src, dst, relation, logic, ordinal from parsed knowledge bases (category, kb)."""
    none = F.lit(None).cast("string")
    regions, defects = region_rows(bases), _defects(bases)
    has = regions.select(
        "category", F.col("target").alias("src"), F.col("region").alias("dst"), F.lit("has_region").alias("relation"), none.alias("logic"), _order().alias("ordinal")
    )
    possible = defects.select(
        "category",
        F.col("region").alias("src"),
        F.col("node_id").alias("dst"),
        F.lit("possible_anomaly").alias("relation"),
        none.alias("logic"),
        _order("k").alias("ordinal"),
    )
    distinct = defects.select("category", "region", "node_id", "pos", "k", F.posexplode("d.distinctions").alias("j", "t")).select(
        "category",
        F.col("node_id").alias("src"),
        F.concat_ws("_", "region", "t.target_defect").alias("dst"),
        F.lit("distinct_from").alias("relation"),
        F.col("t.difference").alias("logic"),
        _order("k", "j").alias("ordinal"),
    )
    every = has.unionByName(possible).unionByName(distinct)
    # one edge per pair of nodes: a later statement replaces an earlier one
    last = every.repartition("category", "src", "dst").groupBy("category", "src", "dst").agg(F.max(F.struct("ordinal", "relation", "logic")).alias("e"))
    return last.select("category", "src", "dst", "e.relation", "e.logic", "e.ordinal")


def graph_nodes(bases: DataFrame) -> DataFrame:
    """category, node_id, type, short_name, definition, normal_standard, critical_check,
    visual_signature, contrast, visual_attributes, rules. Targets that are only named have no type."""

    def node(df, node_id, kind, ordinal, **given) -> DataFrame:
        fields = ("short_name", "definition", "normal_standard", "critical_check", "visual_signature", "contrast")
        lists = ("visual_attributes", "rules")
        return df.select(
            "category",
            node_id.alias("node_id"),
            F.lit(kind).alias("type"),
            *[given.get(f, F.lit(None)).cast("string").alias(f) for f in fields],
            *[given.get(f, F.lit(None)).cast("array<string>").alias(f) for f in lists],
            ordinal.cast("long").alias("ordinal"),
        )

    regions, defects = region_rows(bases), _defects(bases)
    root = node(bases, F.col("kb.target_object"), "root", F.lit(-1))
    region = node(
        regions,
        F.col("region"),
        "region",
        F.col("pos"),
        definition=F.col("definition"),
        normal_standard=F.coalesce("normal_standard", F.lit("N/A")),
        critical_check=F.coalesce("critical_check", F.lit("N/A")),
        rules=F.col("anti_hallucination_rules"),
    )
    defect = node(
        defects,
        F.col("node_id"),
        "defect_pattern",
        F.col("pos") * 1000 + F.col("k"),
        short_name=F.col("d.type"),
        visual_signature=F.col("d.visual_signature"),
        contrast=F.col("d.contrast_vs_normal"),
        visual_attributes=F.coalesce("d.visual_attributes", F.array().cast("array<string>")),
    )
    known = root.unionByName(region).unionByName(defect)
    columns = [c for c in known.columns if c not in ("category", "node_id")]
    # dealt by key first: a task that reads many bases would otherwise sort all their wide nodes
    known = known.repartition("category", "node_id").groupBy("category", "node_id").agg(
        F.max(F.struct("ordinal", *[c for c in columns if c != "ordinal"])).alias("n")
    )
    known = known.select("category", "node_id", *[F.col(f"n.{c}").alias(c) for c in columns])
    named = graph_edges(bases).select("category", F.col("dst").alias("node_id")).distinct()
    return meet(named, known, ["category", "node_id"], "full").select("category", "node_id", *columns)


def region_defects(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Walk root -> region -> defect -> distinctions: one row per defect with its distinctions."""
    root = nodes.where("type = 'root'").select("category", F.col("node_id").alias("root"))
    regions = nodes.where("type = 'region'").select(
        "category", F.col("node_id").alias("region"), F.col("definition").alias("region_definition"), "critical_check", F.col("ordinal").alias("region_order")
    )
    possible = edges.where("relation = 'possible_anomaly'").select(
        "category", F.col("src").alias("region"), F.col("dst").alias("defect_node"), F.col("ordinal").alias("defect_order")
    )
    details = nodes.where("type = 'defect_pattern'").select(
        "category",
        F.col("node_id").alias("defect_node"),
        F.col("short_name").alias("defect"),
        "visual_signature",
        F.col("contrast").alias("contrast_vs_normal"),
        "visual_attributes",
    )
    targets = nodes.select("category", F.col("node_id").alias("dst"), F.coalesce("short_name", "node_id").alias("target_defect"))
    distinct = (
        meet(edges.where("relation = 'distinct_from'"), targets, ["category", "dst"])
        .groupBy("category", F.col("src").alias("defect_node"))
        .agg(F.array_sort(F.collect_list(F.struct("ordinal", "target_defect", F.col("logic").alias("difference")))).alias("_d"))
        .select("category", "defect_node", F.transform("_d", lambda d: d.dropFields("ordinal")).alias("distinctions"))
    )
    rows = meet(meet(meet(regions, possible, ["category", "region"]), root, ["category"]), details, ["category", "defect_node"])
    rows = meet(rows, distinct, ["category", "defect_node"], "left")
    empty = F.array().cast("array<struct<target_defect:string,difference:string>>")
    return rows.withColumns(
        {
            "distinctions": F.coalesce("distinctions", empty),
            "graph_path": F.concat_ws(" -> ", "root", "region", "defect_node"),
        }
    )


def graph_summary(nodes: DataFrame, edges: DataFrame, names: int = 10) -> DataFrame:
    """Per category: node and edge counts, node types and the first region names."""
    place = F.row_number().over(W.partitionBy("category").orderBy("ordinal", "node_id"))
    listed = nodes.where("type = 'region'").withColumn("_at", place).where(F.col("_at") <= names)
    first = listed.groupBy("category").agg(
        F.array_join(F.array_sort(F.collect_list(F.struct("_at", "node_id")))["node_id"], ", ").alias("names")
    )
    counted = nodes.groupBy("category").agg(
        F.count(F.lit(1)).alias("node_count"),
        F.count_if(F.col("type") == "region").alias("region_count"),
        F.count_if(F.col("type") == "defect_pattern").alias("defect_count"),
    )
    linked = edges.groupBy("category").agg(F.count(F.lit(1)).alias("edge_count"))
    return meet(meet(counted, linked, ["category"], "left"), first, ["category"], "left")


def region_text(nodes: DataFrame, defects: DataFrame) -> DataFrame:
    """Readable block per region: fields that are empty or N/A are left out. Returns category, region, text."""

    def line(label: str, value: Column) -> Column:
        return F.when(T.is_valid(value), F.concat(F.lit(label), value))

    per_defect = F.concat_ws(
        "\n",
        F.concat(F.lit("\n>>> Defect: "), F.col("defect")),
        line("    Visual Signature: ", F.col("visual_signature")),
        line("    Contrast vs Normal: ", F.col("contrast_vs_normal")),
        F.array_compact(
            F.transform(
                "distinctions",
                lambda d: F.when(
                    T.is_valid(d["difference"]),
                    F.concat(F.lit("    * Distinction vs "), d["target_defect"], F.lit(": "), d["difference"]),
                ),
            )
        ),
    )
    listed = defects.groupBy("category", "region").agg(
        F.array_join(F.array_sort(F.collect_list(F.struct("defect_order", per_defect.alias("t"))))["t"], "\n").alias("details")
    )
    rows = nodes.where("type = 'region'").withColumnRenamed("node_id", "region")
    rows = meet(rows, listed, ["category", "region"], "left")
    rules = F.transform(F.filter("rules", T.is_valid), lambda r: F.concat(F.lit("!!! "), r))
    return rows.select(
        "category",
        "region",
        F.concat_ws(
            "\n",
            F.concat(F.lit("--- Reference Knowledge for Region: '"), F.col("region"), F.lit("' ---")),
            line("Definition: ", F.col("definition")),
            line("Normal Standard: ", F.col("normal_standard")),
            line("Critical Check: ", F.col("critical_check")),
            F.when(F.col("details").isNotNull(), F.concat(F.lit("\n[Potential Defects Details]:\n"), F.col("details"))),
            F.lit("\n[Anti-Hallucination Rules]:"),
            rules,
        ).alias("text"),
    )


def matching_specs(categories: DataFrame, rules: DataFrame) -> DataFrame:
    """Region specs of each category: those of the first rule of its dataset whose pattern fits.

    ``rules``: dataset, rule_order, pattern, regions (array of spec structs).
    """
    fits = F.rlike("category", F.col("pattern"))
    chosen = (
        categories.join(F.broadcast(rules), "dataset")
        .where(fits)
        .groupBy("dataset", "category")
        .agg(F.min_by("regions", "rule_order").alias("regions"))
    )
    return chosen.select("dataset", "category", F.posexplode("regions").alias("region_order", "s")).select(
        "dataset", "category", "region_order", "s.*"
    )


def spec_graph(specs: DataFrame) -> DataFrame:
    """Edges of graphs built from region specs: each region has one general defect."""
    node = F.concat("region", F.lit("_visible_anomaly"))
    has = specs.select("dataset", "category", F.col("category").alias("src"), F.col("region").alias("dst"), F.lit("has_region").alias("relation"))
    possible = specs.select("dataset", "category", F.col("region").alias("src"), node.alias("dst"), F.lit("possible_anomaly").alias("relation"))
    return has.unionByName(possible)


def normal_reference_graph(references: DataFrame, regions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the normal-reference graph of each (dataset, category).

    ``references``: dataset, category, place, image_path, region (null for whole-image ones),
    score. ``regions``: dataset, category, region.
    """
    keys = ["dataset", "category"]
    base = references.select(*keys).distinct()
    region_id = F.concat(F.lit("region:"), safe_name(F.col("region")))
    known = regions.select(*keys, "region").distinct().withColumn("_known", F.lit(True))
    suffix = F.when(F.col("region").isNotNull(), F.concat(F.lit("_"), safe_name(F.col("region")))).otherwise("")
    refs = references.join(known, [*keys, "region"], "left").withColumn(
        "node_id", F.concat(F.lit("normal_ref_"), F.col("place").cast("string"), suffix)
    )

    def nodes_of(df, node_id, kind, path=F.lit(""), score=F.lit(None).cast("double")):
        return df.select(*keys, node_id.alias("node_id"), F.lit(kind).alias("node_type"), path.alias("image_path"), score.alias("score"))

    nodes = (
        nodes_of(base, F.lit("category"), "object_category")
        .unionByName(nodes_of(base, F.lit("normal_distribution"), "score_distribution"))
        .unionByName(nodes_of(regions, region_id, "region"))
        .unionByName(nodes_of(refs, F.col("node_id"), "visual_reference_cutout", F.col("image_path"), F.col("score")))
    )

    def edges_of(df, source, target, relation):
        return df.select(*keys, source.alias("source"), target.alias("target"), F.lit(relation).alias("relation"))

    edges = (
        edges_of(base, F.lit("category"), F.lit("normal_distribution"), "has_normal_score_model")
        .unionByName(edges_of(regions, F.lit("category"), region_id, "has_region"))
        .unionByName(edges_of(refs.where("_known"), region_id, F.col("node_id"), "has_normal_reference"))
        .unionByName(edges_of(refs, F.lit("normal_distribution"), F.col("node_id"), "supported_by"))
    )
    return nodes, edges


def first_per_region(items: DataFrame, n: int, keys: list[str], region: str = "region", order: str = "ordinal") -> DataFrame:
    place = F.row_number().over(W.partitionBy(*keys, region).orderBy(order))
    return items.withColumn("place", place).where(F.col("place") <= max(1, n))


def paths_by_region(references: DataFrame, keys: list[str]) -> DataFrame:
    """Ordered reference paths per region (references are few per region, see first_per_region)."""
    return references.groupBy(*keys, "region").agg(F.array_sort(F.collect_list(F.struct("place", "path")))["path"].alias("paths"))


def resolve_references(paths: DataFrame, manifest: DataFrame, *, marker: str, root: str) -> DataFrame:
    """Existing path of each reference: as given, else re-rooted after ``marker``; first of equal ones kept.

    ``paths``: category, region, at, path. Returns category, region, at, path.
    """
    suffix = F.when(F.instr("path", marker) > 0, F.substring_index("path", marker, -1))
    options = F.array(F.col("path"), F.concat(F.lit(root), suffix))
    rows = paths.select("category", "region", "at", F.posexplode(options).alias("try", "path")).where("path is not null")
    found = rows.join(manifest.select("path").distinct(), "path", "left_semi")
    best = found.groupBy("category", "region", "at").agg(F.min_by("path", "try").alias("path"))
    return best.groupBy("category", "region", "path").agg(F.min("at").alias("at"))


