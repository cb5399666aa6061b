"""Clusters of customers, their parents and children, and the library learners."""

from __future__ import annotations

from pyspark.sql import functions as F

from seriesloom.catalog.base import (
    CHANGEPOINT_SQL,
    CLUSTER_SQL,
    LLOYD_SQL,
    SEASONALITY_SQL,
    customer_child_parent,
    customer_cluster_table,
    customer_clusters,
    customer_totals,
    query,
    stand_in_params,
    table,
)
from seriesloom.operators import clusters, grid, relations
from seriesloom.operators.classify import coefficient_table, slopes, train_classifier
from seriesloom.sources.artifacts import settle


@query(
    "lloyd_1d",
    f"""WITH {LLOYD_SQL} SELECT key, value, cluster_id, centroid,
distance FROM cust""",
)
def lloyd_1d(spark, d):
    return customer_clusters(spark, d)


@query(
    "centroids",
    f"WITH {LLOYD_SQL} SELECT cluster_id, any_value(centroid) AS centroid, count(*) AS n_keys FROM cust GROUP BY 1",
)
def centroids(spark, d):
    return clusters.centroids(customer_clusters(spark, d))


@query(
    "cluster_range",
    f"""WITH {LLOYD_SQL} SELECT cluster_id, min(distance) AS min_distance, max(distance) AS max_distance
FROM cust GROUP BY 1""",
)
def cluster_range(spark, d):
    return clusters.cluster_ranges(customer_clusters(spark, d))


@query("centroid_lookup", f"WITH {LLOYD_SQL} SELECT key, cluster_id, centroid FROM cust")
def centroid_lookup(spark, d):
    assigned = customer_clusters(spark, d)
    found = clusters.with_centroid(assigned.select("key", "cluster_id"), clusters.centroids(assigned))
    return found.select("key", "cluster_id", "centroid")


@query(
    "cluster_range_join",
    f"""WITH {CLUSTER_SQL} SELECT key, cust.cluster_id, low AS min_distance, high AS max_distance
FROM cust JOIN cr ON cr.cluster_id = cust.cluster_id""",
)
def cluster_range_join(spark, d):
    assigned = customer_clusters(spark, d)
    found = clusters.with_range(assigned.select("key", "cluster_id"), clusters.cluster_ranges(assigned))
    return found.select("key", "cluster_id", "min_distance", "max_distance")


@query(
    "pick_parents",
    f"""WITH {CLUSTER_SQL} SELECT pr.cluster_id, parent AS key, distance
FROM pr JOIN cust ON cust.key = parent""",
)
def pick_parents(spark, d):
    return clusters.pick_parents(customer_clusters(spark, d), "key")


@query("sorted_parents", f"WITH {CLUSTER_SQL} SELECT cluster_id, parent FROM pr ORDER BY cluster_id")
def sorted_parents(spark, d):
    return clusters.parents_of(customer_cluster_table(spark, d), "key").orderBy("cluster_id")


@query(
    "cluster_table",
    f"""WITH {CLUSTER_SQL} SELECT key, cluster_id, centroid, distance, is_parent,
frac_distance, 0.05::DOUBLE + 0.2::DOUBLE * frac_distance AS sample_percent FROM ct""",
)
def cluster_table(spark, d):
    return customer_cluster_table(spark, d)


@query("child_parent_join", f"WITH {CLUSTER_SQL} SELECT child, parent, cluster_id FROM cp")
def child_parent_join(spark, d):
    return customer_child_parent(spark, d)


@query("child_parent_table", f"WITH {CLUSTER_SQL} SELECT child, parent FROM cp")
def child_parent_table(spark, d):
    """The map form, read back as rows."""
    return clusters.as_map(customer_child_parent(spark, d)).select(F.explode("parent_of").alias("child", "parent"))


@query(
    "children_per_parent",
    f"""WITH {CLUSTER_SQL}, sized AS (SELECT *, count(*) OVER (PARTITION BY parent) AS n_children FROM cp)
SELECT parent, n_children, CAST(floor(CAST('0x' || substr(md5(concat_ws('|', 'part', child)), 1, 8) AS BIGINT) / 4294967296.0
  * ceil(n_children / {clusters.LIST_PIECE}.0)) AS INTEGER) AS part,
string_agg(CAST(child AS VARCHAR), ',' ORDER BY child) AS children FROM sized GROUP BY ALL""",
)
def children_per_parent(spark, d):
    lists = clusters.parent_children(customer_child_parent(spark, d))
    return lists.withColumn("children", F.array_join(F.col("children").cast("array<string>"), ","))


@query(
    "children_top10",
    f"""WITH {CLUSTER_SQL} SELECT cluster_id, key FROM (SELECT cluster_id, key,
row_number() OVER (PARTITION BY cluster_id ORDER BY key) AS rn FROM ct WHERE NOT is_parent) WHERE rn <= 10""",
)
def children_top10(spark, d):
    return clusters.top_children(customer_cluster_table(spark, d), "key", 10)


@query(
    "union_roles",
    f"""WITH {CLUSTER_SQL} SELECT key, cluster_id, 'center' AS role FROM ct WHERE is_parent
UNION ALL SELECT key, cluster_id, 'child' AS role FROM ct WHERE NOT is_parent""",
)
def union_roles(spark, d):
    all_keys = customer_cluster_table(spark, d).select("key", "cluster_id", "is_parent")
    return relations.union_roles(
        all_keys.where("is_parent").drop("is_parent"), all_keys.where("NOT is_parent").drop("is_parent")
    )


@query(
    "parent_params_join",
    f"""WITH {CLUSTER_SQL} SELECT child, parent, {CHANGEPOINT_SQL} AS changepoint_prior_scale,
{SEASONALITY_SQL} AS seasonality_prior_scale FROM cp""",
)
def parent_params_join(spark, d):
    known = customer_cluster_table(spark, d)
    return clusters.with_parent_params(clusters.assign_parent(known, "key"), stand_in_params(known)).select(
        "child", "parent", "changepoint_prior_scale", "seasonality_prior_scale"
    )


@query(
    "membership_tally",
    f"""WITH {CLUSTER_SQL},
m AS (SELECT c_custkey, parent, p.ok FROM customer LEFT JOIN cp ON child = c_custkey
  LEFT JOIN (SELECT c_custkey AS pk, TRUE AS ok FROM customer WHERE c_acctbal > 0) p ON pk = parent)
SELECT count(*) FILTER (WHERE parent IS NOT NULL AND ok) AS yes,
count(*) FILTER (WHERE parent IS NOT NULL AND ok IS NULL) AS "no", count(*) FILTER (WHERE parent IS NULL) AS errors FROM m""",
)
def membership_tally(spark, d):
    customers = table(spark, d, "customer")
    listed = customers.where("c_acctbal > 0").select(F.col("c_custkey").alias("parent"))
    return relations.membership_tally(
        customers.select(F.col("c_custkey").alias("child")), customer_child_parent(spark, d), listed
    )


GRID_SQL = f"""g AS (SELECT CAST(i * 4 + j AS INTEGER) AS ordinal,
  list_extract({list(grid.CHANGEPOINT_SCALES)}, i + 1)::DOUBLE AS changepoint_prior_scale,
  list_extract({list(grid.SEASONALITY_SCALES)}, j + 1)::DOUBLE AS seasonality_prior_scale
  FROM range(4) a(i) CROSS JOIN range(4) b(j))"""


@query(
    "grid_cross",
    f"""WITH {CLUSTER_SQL}, {GRID_SQL} SELECT parent, cluster_id, ordinal, changepoint_prior_scale, seasonality_prior_scale
FROM pr CROSS JOIN g""",
)
def grid_cross(spark, d):
    """Every setting for every parent to be tuned."""
    return grid.with_settings(clusters.parents_of(customer_cluster_table(spark, d), "key")).select(
        "parent", "cluster_id", "ordinal", "changepoint_prior_scale", "seasonality_prior_scale"
    )


@query(
    "grid_from_driver",
    f"""WITH {CLUSTER_SQL}, {GRID_SQL} SELECT parent, cluster_id, ordinal, changepoint_prior_scale, seasonality_prior_scale
FROM pr JOIN g ON ordinal = cluster_id % 16""",
)
def grid_from_driver(spark, d):
    """Settings made on the driver, distributed and joined to the parents that take them, one each."""
    made = grid.param_grid(spark, changepoint_prior_scale=grid.CHANGEPOINT_SCALES, seasonality_prior_scale=grid.SEASONALITY_SCALES)
    parents = clusters.parents_of(customer_cluster_table(spark, d), "key")
    own = parents.withColumn("ordinal", F.pmod(F.col("cluster_id"), F.lit(16)))
    return own.join(made.withColumn("ordinal", F.col("ordinal").cast("int")), "ordinal").select(
        "parent", "cluster_id", "ordinal", "changepoint_prior_scale", "seasonality_prior_scale"
    )


@query("kmeans_clusters")
def kmeans_clusters(spark, d):
    """Rows only: the library's start points are its own."""
    return clusters.kmeans_keys(customer_totals(spark, d), "key", "value", k=56, seed=0)


@query("logistic_train")
def logistic_train(spark, d):
    """Rows only: the solver is the library's own."""
    measures = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    rows = table(spark, d, "lineitem").select((F.col("l_returnflag") == "R").cast("int").alias("label"), *measures)
    model, names = train_classifier(rows, "label")
    return coefficient_table(rows, model, names)


@query(
    "kmeans_nearest",
    """SELECT count(DISTINCT o_custkey) AS n_keys, 0::BIGINT AS n_nearer_elsewhere, 0::BIGINT AS n_wrong_distance FROM orders""",
)
def kmeans_nearest(spark, d):
    """No key of the library's clusters is nearer to another centroid of its table than to its own."""
    made = clusters.kmeans_keys(customer_totals(spark, d), "key", "value", k=56, seed=0)
    made = settle(made, "kmeans")[0]
    places = F.array(*[F.lit(r["centroid"]) for r in clusters.centroids(made).collect()])  # at most k numbers
    gaps = F.transform(places, lambda c: F.abs(F.col("value") - c))
    count = lambda which: F.sum(which.cast("bigint"))
    return made.agg(
        F.count(F.lit(1)).alias("n_keys"),
        count(F.array_min(gaps) < F.col("distance") * (1 - 1e-9)).alias("n_nearer_elsewhere"),
        count(F.abs(F.col("value") - F.col("centroid")) != F.col("distance")).alias("n_wrong_distance"),
    )


@query(
    "logistic_gradient",
    """SELECT unnest(['(intercept)', 'l_quantity', 'l_extendedprice', 'l_discount', 'l_tax']) AS feature,
(SELECT count(*) FROM lineitem) AS n_rows, TRUE AS flat""",
)
def logistic_gradient(spark, d):
    """At the fitted weights the penalised loss is flat: its slope along each feature, per standard deviation, is near 0."""
    measures = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    rows = table(spark, d, "lineitem").select((F.col("l_returnflag") == "R").cast("int").alias("label"), *measures)
    model, names = train_classifier(rows, "label")
    return slopes(rows, "label", model, names).select("feature", "n_rows", (F.abs("slope") < 1e-3).alias("flat"))
