"""Vector scores over the embeddings table."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import arrays as A
from plumbline.operators import vectors as V
from plumbline.plans.registry import query, table

MEMORY = 20

PATCH_SQL = f"""emb AS (
  SELECT vec_id, label AS category, CAST(vec_id % 4 AS INTEGER) AS layer, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS vec,
    row_number() OVER (PARTITION BY label ORDER BY vec_id) AS place FROM embeddings),
unit AS (SELECT *, list_transform(vec, lambda v: v / sqrt(list_sum(list_transform(vec, lambda x: x * x)))) AS u FROM emb),
pairs AS (SELECT q.vec_id, q.category, q.layer, m.vec_id AS memory_id, 1 - list_dot_product(q.u, m.u) AS distance
  FROM unit q JOIN unit m ON q.category = m.category AND q.layer = m.layer WHERE q.place > {MEMORY} AND m.place <= {MEMORY}),
nearest AS (SELECT vec_id, category, layer, min(distance) AS distance, arg_min(memory_id, distance) AS memory_id FROM pairs GROUP BY ALL)"""


def patches(spark, folder):
    rows = table(spark, folder, "embeddings").select(
        "vec_id",
        F.col("label").alias("category"),
        (F.col("vec_id") % 4).cast("int").alias("layer"),
        F.col("embedding").alias("vec"),
    )
    memory = V.first_per_category(rows, MEMORY)
    rest = rows.join(memory.select("vec_id"), "vec_id", "left_anti")
    keys = ["category", "layer"]
    return rest.select(*keys, F.col("vec_id").alias("query_id"), "vec"), memory.select(*keys, F.col("vec_id").alias("memory_id"), "vec")


def _nearest(spark, folder):
    queries, memory = patches(spark, folder)
    return V.nearest_distance(queries, memory, ["category", "layer"])


@query("sco6_nearest_distance", "WITH " + PATCH_SQL + " SELECT vec_id AS query_id, category, layer, round(distance, 6) AS distance FROM nearest")
def nearest_distance(spark, folder):
    return _nearest(spark, folder).select("query_id", "category", "layer", F.round("distance", 6).alias("distance"))


@query("sco7_halved_distance", "WITH " + PATCH_SQL + " SELECT vec_id AS query_id, round(distance / 2, 6) AS score FROM nearest")
def halved_distance(spark, folder):
    return _nearest(spark, folder).select("query_id", F.round(F.col("distance") / 2.0, 6).alias("score"))


@query(
    "sco8_nearest_difference",
    "WITH "
    + PATCH_SQL
    + """ SELECT n.vec_id AS query_id, n.memory_id, CAST(i - 1 AS INTEGER) AS dim, round(abs(q.u[i] - m.u[i]), 6) AS difference
    FROM nearest n JOIN unit q ON q.vec_id = n.vec_id JOIN unit m ON m.vec_id = n.memory_id, unnest(range(1, 65)) x(i)""",
)
def nearest_difference(spark, folder):
    queries, memory = patches(spark, folder)
    keys = ["category", "layer"]
    near = V.nearest_distance(queries, memory, keys)
    out = V.nearest_difference(queries, memory, near, keys)
    return out.select("query_id", "memory_id", F.posexplode("difference").alias("dim", "v")).select("query_id", "memory_id", "dim", F.round("v", 6).alias("difference"))


LAYER_WEIGHTS = [(0, 0.4), (1, 0.3), (2, 0.2), (3, 0.1)]


@query(
    "sco9_layer_weighted_score",
    "WITH "
    + PATCH_SQL
    + """, w AS (SELECT * FROM (VALUES (0, 0.4::DOUBLE), (1, 0.3::DOUBLE), (2, 0.2::DOUBLE), (3, 0.1::DOUBLE)) v(layer, weight))
    SELECT category, vec_id // 4 AS patch_group, round(sum(weight * distance) / sum(weight), 6) AS score FROM nearest JOIN w USING (layer) GROUP BY ALL""",
)
def layer_weighted_score(spark, folder):
    weights = spark.createDataFrame(LAYER_WEIGHTS, "layer int, weight double")
    rows = _nearest(spark, folder).join(F.broadcast(weights), "layer")
    return rows.groupBy("category", F.floor(F.col("query_id") / 4).alias("patch_group")).agg(
        F.round(F.sum(F.col("weight") * F.col("distance")) / F.sum("weight"), 6).alias("score")
    )


STATE_SQL = """members AS (SELECT label AS category, CAST(vec_id // 10 % 2 AS INTEGER) AS state, vec_id, embedding,
    row_number() OVER (PARTITION BY label, vec_id // 10 % 2 ORDER BY vec_id) AS place FROM embeddings),
dims AS (SELECT category, state, dim, avg(CAST(embedding[dim] AS DOUBLE)) AS m FROM members, (SELECT unnest(range(1, 65)) AS dim) GROUP BY ALL),
protos AS (SELECT category, state, dim, m / (sqrt(sum(m * m) OVER (PARTITION BY category, state)) + 1e-8) AS p FROM dims)"""


def _prototypes(spark, folder):
    members = table(spark, folder, "embeddings").select(
        F.col("label").alias("category"),
        (F.floor(F.col("vec_id") / 10) % 2).cast("int").alias("state"),
        "vec_id",
        F.col("embedding").alias("vec"),
    )
    return V.prototypes(members, ["category", "state"], "vec_id")


@query(
    "sco18_class_prototypes",
    "WITH "
    + STATE_SQL
    + """, mid AS (SELECT category, dim, avg(p) AS m FROM protos GROUP BY ALL)
    SELECT a.category, CAST(a.dim - 1 AS INTEGER) AS dim, round(a.p, 6) AS normal, round(b.p, 6) AS abnormal,
      round(c.m / sqrt(sum(c.m * c.m) OVER (PARTITION BY a.category)), 6) AS merged
    FROM protos a JOIN protos b ON a.category = b.category AND a.dim = b.dim AND b.state = 1 JOIN mid c ON c.category = a.category AND c.dim = a.dim WHERE a.state = 0""",
)
def class_prototypes(spark, folder):
    protos = _prototypes(spark, folder)
    pair = protos.groupBy("category").agg(
        F.max(F.when(F.col("state") == 0, F.col("vec"))).alias("normal"), F.max(F.when(F.col("state") == 1, F.col("vec"))).alias("abnormal")
    )
    pair = pair.withColumn("merged", V.merged_prototype(F.col("normal"), F.col("abnormal")))
    rows = pair.select("category", F.posexplode(F.arrays_zip("normal", "abnormal", "merged")).alias("dim", "v"))
    return rows.select("category", "dim", *[F.round(f"v.{c}", 6).alias(c) for c in ("normal", "abnormal", "merged")])


@query(
    "sco10_text_class_similarity",
    "WITH "
    + STATE_SQL
    + """, sims AS (SELECT e.vec_id, p.state, sum(CAST(e.embedding[p.dim] AS DOUBLE) * p.p) / 0.07 AS s FROM embeddings e JOIN protos p ON p.category = e.label GROUP BY ALL),
    top AS (SELECT *, max(s) OVER (PARTITION BY vec_id) AS mx FROM sims)
    SELECT vec_id, round(sum(exp(s - mx)) FILTER (state = 1) / sum(exp(s - mx)), 6) AS abnormal_probability FROM top GROUP BY vec_id""",
)
def text_class_similarity(spark, folder):
    """Softmax of dot / 0.07 over a category's two state vectors."""
    pair = _prototypes(spark, folder).groupBy("category").agg(
        F.max(F.when(F.col("state") == 0, F.col("vec"))).alias("p0"), F.max(F.when(F.col("state") == 1, F.col("vec"))).alias("p1")
    )
    from plumbline.operators.joins import attach

    rows = table(spark, folder, "embeddings").select("vec_id", F.col("label").alias("category"), F.transform("embedding", lambda v: v.cast("double")).alias("vec"))
    rows = attach(rows, pair, ["category"]).select(
        "vec_id", (A.dot(F.col("vec"), F.col("p0")) / 0.07).alias("s0"), (A.dot(F.col("vec"), F.col("p1")) / 0.07).alias("s1")
    )
    top = F.greatest("s0", "s1")
    e0, e1 = F.exp(F.col("s0") - top), F.exp(F.col("s1") - top)
    return rows.select("vec_id", F.round(e1 / (e0 + e1), 6).alias("abnormal_probability"))


@query(
    "sco12_support_memory",
    """SELECT label AS category, vec_id, CAST(i - 1 AS INTEGER) AS dim, CAST(embedding[i] AS DOUBLE) AS value
    FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rn FROM embeddings), unnest(range(1, 65)) x(i) WHERE rn <= 4""",
)
def support_memory(spark, folder):
    """The feature memory: every value of the first vectors of each category."""
    kept = V.first_per_category(_labelled(spark, folder), 4)
    return kept.select("category", "vec_id", F.posexplode("vec").alias("dim", "v")).select("category", "vec_id", "dim", F.col("v").cast("double").alias("value"))


def _labelled(spark, folder):
    return table(spark, folder, "embeddings").select("vec_id", F.col("label").alias("category"), F.col("embedding").alias("vec"))


@query(
    "sco13_class_moments",
    """WITH d AS (SELECT vec_id, label AS category, dim, CAST(embedding[dim] AS DOUBLE) AS v FROM embeddings, (SELECT unnest(range(1, 65)) AS dim))
    SELECT a.category, CAST(a.dim - 1 AS INTEGER) AS i, CAST(b.dim - 1 AS INTEGER) AS j, count(*) AS n, round(avg(a.v), 6) AS mean_i, round(covar_pop(a.v, b.v), 6) AS cov
    FROM d a JOIN d b ON a.vec_id = b.vec_id AND a.dim <= b.dim GROUP BY ALL""",
)
def class_moments(spark, folder):
    out = V.class_moments(_labelled(spark, folder))
    return out.select("category", "i", "j", "n", F.round("mean_i", 6).alias("mean_i"), F.round("cov", 6).alias("cov"))


def _class_table(spark, folder, diagonal):
    moments = V.class_moments(_labelled(spark, folder))
    if diagonal:
        picked = moments.where("i = j")
    else:
        mirrored = moments.where("i < j").select("category", "n", F.col("j").alias("i"), F.col("i").alias("j"), F.lit(None).cast("double").alias("mean_i"), "cov")
        picked = moments.unionByName(mirrored)
    value = F.col("cov") if diagonal else F.when(F.col("i") == F.col("j"), F.col("cov") + 0.01).otherwise(F.col("cov"))
    cells = F.array_sort(F.collect_list(F.struct("i", "j", value.alias("c"))))["c"]
    means = F.array_sort(F.collect_list(F.when(F.col("i") == F.col("j"), F.struct("i", F.col("mean_i").alias("m")))))["m"]
    return picked.groupBy("category").agg(means.alias("mean"), cells.alias("covariance"))


@query(
    "sco11_likely_class_diagonal",
    """WITH d AS (SELECT vec_id, label AS category, dim, CAST(embedding[dim] AS DOUBLE) AS v FROM embeddings, (SELECT unnest(range(1, 65)) AS dim)),
    s AS (SELECT category, dim, avg(v) AS m, var_pop(v) AS s FROM d GROUP BY ALL),
    l AS (SELECT d.vec_id, s.category, sum(-0.5 * ((v - m) * (v - m) / s + ln(2 * pi() * s))) AS lp FROM d JOIN s USING (dim) GROUP BY ALL)
    SELECT vec_id AS query_id, arg_max(category, lp) AS category, round(max(lp), 4) AS log_density FROM l GROUP BY vec_id""",
)
def likely_class_diagonal(spark, folder):
    queries = _labelled(spark, folder).select(F.col("vec_id").alias("query_id"), "vec")
    out = V.most_likely_class(queries, _class_table(spark, folder, True), diagonal=True)
    return out.select("query_id", "category", F.round("log_density", 4).alias("log_density"))


@query("sco11_likely_class")
def likely_class(spark, folder):
    queries = _labelled(spark, folder).select(F.col("vec_id").alias("query_id"), "vec")
    return V.most_likely_class(queries, _class_table(spark, folder, False))


@query(
    "win10_similar_top_k",
    f"""WITH emb AS (SELECT vec_id, label AS category, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS vec,
      row_number() OVER (PARTITION BY label ORDER BY vec_id) AS place FROM embeddings),
    pairs AS (SELECT q.vec_id AS query_id, q.category, m.vec_id AS memory_id, list_cosine_similarity(q.vec, m.vec) AS s FROM emb q JOIN emb m USING (category)
      WHERE q.place > {MEMORY} AND m.place <= {MEMORY})
    SELECT query_id, category, memory_id, round(s, 6) AS similarity, rank FROM (
      SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY s DESC, memory_id) AS INTEGER) AS rank FROM pairs) WHERE rank <= 3""",
)
def similar_top_k(spark, folder):
    queries, memory = patches(spark, folder)
    out = V.top_similar(queries.drop("layer"), memory.drop("layer"), ["category"], 3)
    return out.select("query_id", "category", "memory_id", F.round("similarity", 6).alias("similarity"), "rank")
