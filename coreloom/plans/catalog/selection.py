"""Entropy and centroid based selection on given probabilities and centres."""

from __future__ import annotations

from pyspark.sql import functions as F

from coreloom.functions.scalars import clean
from coreloom.operators import clusters, select
from coreloom.plans import standins as S
from coreloom.plans.catalog import sql as Q
from coreloom.plans.catalog.profiles import entropies
from coreloom.plans.catalog.registry import query
from coreloom.plans.catalog.tables import rounded


@query("predictive_entropy", f"WITH {Q.PROBS} SELECT row_id, {Q.r('entropy')} AS entropy FROM entropies")
def predictive_entropy(spark, sf):
    return rounded(entropies(spark, sf).select("row_id", "entropy"), ["entropy"])


@query(
    "entropy_core_select",
    f"""WITH {Q.PROBS}, t AS (SELECT quantile_cont(entropy, 0.99) AS hi, quantile_cont(entropy, 0.01) AS lo FROM entropies)
    SELECT row_id, label, {Q.r('entropy')} AS entropy, 'high' AS band FROM entropies, t WHERE entropy >= hi
    UNION ALL SELECT row_id, label, {Q.r('entropy')}, 'low' FROM entropies, t WHERE entropy <= lo""",
)
def entropy_core_select(spark, sf):
    bands = select.entropy_bands(entropies(spark, sf))
    return rounded(bands.select("row_id", "label", "entropy", "band"), ["entropy"])


DISTANCES = f"""{Q.CENTERS},
distances AS (SELECT c.row_id, c.label AS own, m.label AS cluster, sqrt(sum(pow(c.x - m.m, 2))) AS distance
  FROM cells c JOIN center_cells m USING (feature) GROUP BY c.row_id, c.label, m.label)"""


def labelled_clusters(spark, sf):
    return S.features(spark, sf).withColumnRenamed("label", "cluster")


@query("centroid_distance_matrix", f"WITH {DISTANCES} SELECT row_id, cluster, {Q.r('distance')} AS distance FROM distances")
def centroid_distance_matrix(spark, sf):
    rows = labelled_clusters(spark, sf)
    return rounded(clusters.center_distances(rows, clusters.class_centers(rows)), ["distance"])


@query(
    "nearest_to_centroid",
    f"""WITH {DISTANCES} SELECT cluster, row_id, {Q.r('distance')} AS distance FROM (
      SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY distance, row_id) AS rn FROM distances WHERE own = cluster)
    WHERE rn = 1""",
)
def nearest_to_centroid(spark, sf):
    rows = labelled_clusters(spark, sf)
    picked = select.nearest_to_center(rows, clusters.class_centers(rows))
    return rounded(picked.select("cluster", "row_id", "distance"), ["distance"])


@query(
    "class_centroids",
    f"WITH {Q.CENTERS} SELECT label AS cluster, CAST(feature AS INTEGER) AS feature, {Q.r('m')} AS center FROM center_cells",
)
def class_centroids(spark, sf):
    centers = clusters.class_centers(labelled_clusters(spark, sf))
    rows = centers.select("cluster", F.posexplode("center").alias("feature", "center"))
    return rows.withColumn("center", clean(F.col("center")))


@query(
    "davies_bouldin",
    f"""WITH {DISTANCES}, s AS (SELECT cluster, avg(distance) AS s FROM distances WHERE own = cluster GROUP BY cluster),
    g AS (SELECT a.label AS i, b.label AS j, sqrt(sum(pow(a.m - b.m, 2))) AS d FROM center_cells a
          JOIN center_cells b ON a.feature = b.feature AND a.label <> b.label GROUP BY a.label, b.label),
    r AS (SELECT i, max((p.s + q.s) / d) AS r FROM g JOIN s p ON p.cluster = i JOIN s q ON q.cluster = j GROUP BY i)
    SELECT {Q.r('avg(r)')} AS davies_bouldin FROM r""",
)
def davies_bouldin(spark, sf):
    return rounded(clusters.davies_bouldin(labelled_clusters(spark, sf)), ["davies_bouldin"])


@query(
    "silhouette",
    f"""WITH {Q.VECTORS}, p AS (SELECT a.row_id, a.label AS own, b.label AS other, sum(list_distance(a.v, b.v)) AS total, count(*) AS n
      FROM vectors a CROSS JOIN vectors b GROUP BY a.row_id, a.label, b.label),
    s AS (SELECT row_id, max(total / nullif(n - 1, 0)) FILTER (WHERE own = other) AS a, max(n) FILTER (WHERE own = other) AS size,
                 min(total / n) FILTER (WHERE own <> other) AS b FROM p GROUP BY row_id)
    SELECT {Q.r('avg(CASE WHEN size > 1 THEN (b - a) / greatest(a, b) ELSE 0 END)')} AS silhouette FROM s""",
)
def silhouette(spark, sf):
    return rounded(clusters.silhouette(labelled_clusters(spark, sf)), ["silhouette"])
