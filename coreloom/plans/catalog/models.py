"""Fitted models: forests, clusterings, components, cross-validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from coreloom.operators import clusters, profile, reduce, select, similarity, split
from coreloom.operators import features as FE
from coreloom.operators import metrics as ME
from coreloom.operators import models as M
from coreloom.plans import standins as S
from coreloom.plans.catalog.registry import query
from coreloom.session import materialize


def parts(spark, sf):
    """(train, test) of the embeddings, scaled on the training rows and written once."""
    train, test = split.stratified_split(S.features(spark, sf))
    scaler = FE.fit_scaler(train)
    return materialize(scaler.apply(train), "train"), materialize(scaler.apply(test), "test")


def core_rows(train, seed=42):
    """K-Means core set with one row for every twenty, written once; nested, as their number grows with the rows."""
    core = select.kmeans_core_set(train, max(2, train.count() // 20), seed, method="nested")
    return materialize(core.select("row_id", "label", "features"), "core")


def _scored(train, test, forest, name):
    model = M.fit_forest(train, forest)
    scores = ME.scores(M.predict(model, test))
    return scores.select(
        F.lit(name).alias("model"), F.lit(model.getNumTrees).alias("trees"), F.lit(model.numFeatures).alias("features"),
        "accuracy", "precision", "recall", "f1",
    )


@query("train_forest_full")
def train_forest_full(spark, sf):
    train, test = parts(spark, sf)
    return _scored(train, test, M.FULL_ANOMALY_ENTROPY_PCA, "full")


@query("train_forest_core")
def train_forest_core(spark, sf):
    train, test = parts(spark, sf)
    return _scored(core_rows(train), test, M.CORE_ANOMALY_KMEANS, "core")


@query("train_forest_compressed")
def train_forest_compressed(spark, sf):
    train, test = parts(spark, sf)
    core = core_rows(train)
    components = reduce.fit_pca(core)
    return _scored(components.transform(core), components.transform(test), M.COMPRESSED, "compressed")


@query("forest_predict")
def forest_predict(spark, sf):
    train, test = parts(spark, sf)
    scored = M.predict(M.fit_forest(train, M.CORE_ANOMALY_KMEANS), test)
    return scored.select("row_id", "label", "prediction", "probability")


def _importances(spark, train, forest):
    return M.importances(M.fit_forest(train, forest), S.EMBEDDING_NAMES, spark)


@query("feature_importance")
def feature_importance(spark, sf):
    return _importances(spark, parts(spark, sf)[0], M.FULL_ANOMALY_KMEANS)


@query("top_features")
def top_features(spark, sf):
    return M.top_features(feature_importance(spark, sf), 50)


@query("importance_difference")
def importance_difference(spark, sf):
    train, _ = parts(spark, sf)
    full = _importances(spark, train, M.FULL_ANOMALY_KMEANS)
    return M.importance_difference(full, _importances(spark, core_rows(train), M.CORE_ANOMALY_KMEANS))


@query("entropy_core_set")
def entropy_core_set(spark, sf):
    train, _ = parts(spark, sf)
    model = M.fit_forest(train, M.FULL_ANOMALY_ENTROPY_PCA)
    scored = select.with_entropy(M.predict(model, train)).select("row_id", "label", "entropy")
    bands = select.entropy_bands(materialize(scored, "entropy"))
    return bands.select("row_id", "label", "band", "entropy")


@query("kmeans_fit")
def kmeans_fit(spark, sf):
    _, assigned = select.fit_kmeans(S.features(spark, sf), 10)
    return assigned.select("row_id", "label", "cluster")


@query("kmeans_elbow")
def kmeans_elbow(spark, sf):
    return clusters.elbow(S.features(spark, sf), [2, 4, 8, 16])


@query("kmeans_centroids")
def kmeans_centroids(spark, sf):
    model, _ = select.fit_kmeans(S.features(spark, sf), 10)
    return select.center_table(model, spark).select("cluster", F.posexplode("center").alias("feature", "center"))


@query("kmeans_core_set")
def kmeans_core_set(spark, sf):
    train, _ = parts(spark, sf)
    return select.kmeans_core_set(train, max(1, train.count() // 100)).select("cluster", "row_id", "label")


@query("kmeans_core_set_cells")
def kmeans_core_set_cells(spark, sf):
    """One representative per hundred line items, by nested clusters."""
    lines = S.wide_features(spark, sf)
    scaled = materialize(FE.fit_scaler(lines).apply(lines), "lines")
    core = select.kmeans_core_set(scaled, max(1, scaled.count() // 100), method="nested")
    return core.select("row_id", "label")


@query("pca_components_needed")
def pca_components_needed(spark, sf):
    components = reduce.fit_pca(S.features(spark, sf))
    return components.variance_table(spark).withColumn("needed", F.lit(components.k))


@query("pca_compress")
def pca_compress(spark, sf):
    train, _ = parts(spark, sf)
    core = core_rows(train)
    return reduce.fit_pca(core).transform(core).select("row_id", "label", "features")


@query("pca_project_2d")
def pca_project_2d(spark, sf):
    """Full and core rows on the two leading components of the full table."""
    train, _ = parts(spark, sf)
    components = reduce.fit_pca(train, k=2)
    both = profile.tagged({"full": train, "core": core_rows(train)}, ["row_id", "label", "features"])
    scored = components.transform(both)
    return scored.select(
        "dataset", "row_id", "label", F.get("features", F.lit(0)).alias("pc1"), F.get("features", F.lit(1)).alias("pc2")
    )


@query("pca_component_similarity")
def pca_component_similarity(spark, sf):
    """Components against components: full and core table, each on its own PCA of equal size."""
    train, _ = parts(spark, sf)
    core = core_rows(train)
    own = reduce.fit_pca(core)
    full = reduce.fit_pca(train, k=own.k)
    return similarity.ks_two_sample(similarity.stack(full.transform(train), own.transform(core)))


@query("cross_validate")
def cross_validate(spark, sf):
    train, _ = parts(spark, sf)
    return M.cross_validate(core_rows(train), M.CORE_ANOMALY_KMEANS, 5)


@query("cv_summary")
def cv_summary(spark, sf):
    train, _ = parts(spark, sf)
    core = core_rows(train)
    forests = {"full": M.FULL_ANOMALY_KMEANS, "core": M.CORE_ANOMALY_KMEANS}
    folds = {name: M.cross_validate(core, forest, 5) for name, forest in forests.items()}
    return M.cv_summary(profile.tagged(folds, ["accuracy", "f1"], "model"), "model")


@query("clustering_report")
def clustering_report(spark, sf):
    """Scores of a clustering of the core set."""
    return clusters.clustering_report(core_rows(parts(spark, sf)[0]), 10)
