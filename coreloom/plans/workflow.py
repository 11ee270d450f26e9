"""The eight select-and-compress workflows as one configurable run."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict, dataclass, field
from functools import cache

from pyspark.ml.feature import PCAModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coreloom.operators import features as FE
from coreloom.operators import clusters, metrics, models, profile, select, similarity, split
from coreloom.operators.forest import ForestModel
from coreloom.operators.models import Forest
from coreloom.operators.reduce import Components, fit_pca
from coreloom.session import scratch_path
from coreloom.sources.stages import Stage, Stages, content_key


@dataclass(frozen=True)
class Plan:
    """One workflow: how to split, filter, select and compress, and which forests to fit."""

    split: str
    select: str
    compress: str
    full: Forest
    core: Forest
    compressed: Forest
    threshold: float
    filter_first: bool = False
    clusters: int | None = None
    fraction: float = 1.0
    share: float = 0.95
    single: bool = False
    impute: bool = False
    guarded: bool = True
    method: str = "nested"
    seed: int = 42

    def cluster_count(self, rows: int) -> int:
        """A fixed number, or one cluster for every hundred rows."""
        return min(rows, self.clusters) if self.clusters else max(1, rows // 100)


# Settings of the eight workflows.
PLANS = {
    "anomaly_entropy_pca": Plan(
        "stratified", "entropy", "pca",
        models.FULL_ANOMALY_ENTROPY_PCA, models.CORE_ANOMALY_ENTROPY_PCA, models.COMPRESSED,
        threshold=0.0001,
    ),
    "anomaly_entropy_stratified": Plan(
        "stratified", "entropy", "stratified",
        models.FULL_ANOMALY_ENTROPY_STRATIFIED, models.CORE_DEEP, models.COMPRESSED,
        threshold=0.1, filter_first=True, fraction=1 / 50, guarded=False,
    ),
    "anomaly_kmeans_pca": Plan(
        "stratified", "kmeans", "pca",
        models.FULL_ANOMALY_KMEANS_PCA, models.CORE_ANOMALY_KMEANS, models.COMPRESSED,
        threshold=0.0001,
    ),
    "anomaly_kmeans_stratified": Plan(
        "stratified", "kmeans", "stratified",
        models.FULL_ANOMALY_KMEANS, models.CORE_ANOMALY_KMEANS, models.COMPRESSED,
        threshold=0.0001, fraction=1 / 2,
    ),
    "application_entropy_pca": Plan(
        "time", "entropy", "pca",
        models.FULL_APPLICATION, models.CORE_DEEP, models.COMPRESSED_APPLICATION_ENTROPY_PCA,
        threshold=0.1, single=True,
    ),
    "application_entropy_stratified": Plan(
        "time", "entropy", "stratified",
        models.FULL_APPLICATION, models.CORE_DEEP, models.COMPRESSED,
        threshold=0.1, fraction=1 / 50, guarded=False,
    ),
    "application_kmeans_pca": Plan(
        "time", "kmeans", "pca",
        models.FULL_APPLICATION, models.CORE_DEEP, models.COMPRESSED,
        threshold=0.1, single=True,
    ),
    "application_kmeans_stratified": Plan(
        "time", "kmeans", "stratified",
        models.FULL_APPLICATION, models.CORE_DEEP, models.COMPRESSED,
        threshold=0.1, clusters=500, fraction=1 / 2, method="lloyd",
    ),
}


@dataclass
class Run:
    """Tables and models of a finished workflow; the reports are DataFrames over them."""

    plan: Plan
    names: list[str]
    train: DataFrame
    test: DataFrame
    core: DataFrame
    compressed: DataFrame
    test_compressed: DataFrame
    forests: dict
    #: test-set predictions of the three forests, tagged ``model``; scored once a run
    predictions: DataFrame
    components: Components | None = None
    stages: list[tuple] = field(default_factory=list)

    def tables(self) -> dict[str, DataFrame]:
        return {"full": self.train, "core": self.core, "compressed": self.compressed}

    def comparison(self) -> DataFrame:
        """Accuracy, weighted precision, recall and F1 per model."""
        return metrics.scores(self.predictions, by=["model"])

    def report(self) -> DataFrame:
        return metrics.classification_report(self.predictions, by=["model"])

    def summary(self) -> DataFrame:
        """Per table: rows, scores of its forest, compression ratio, size and features."""
        sizes = profile.dataset_size(self.tables(), 4 if self.plan.single else 8)
        full = sizes.where("dataset = 'full'").select("rows", "features").first()
        by_columns = self.plan.compress == "pca"
        ratio = F.when(
            (F.col("dataset") == "compressed") & F.lit(by_columns), F.lit(full["features"]) / F.col("features")
        ).otherwise(F.lit(full["rows"]) / F.col("rows"))
        scored = self.comparison().withColumnRenamed("model", "dataset")
        return (
            sizes.join(scored.select("dataset", "accuracy", "f1"), "dataset")
            .withColumn("compression_ratio", F.round(ratio, 2))
            .select("dataset", "rows", "accuracy", "f1", "compression_ratio", "kilobytes", "features")
        )

    def class_test(self) -> DataFrame:
        return similarity.chi_square_classes(similarity.class_contingency(self.train, self.compressed))

    def roc(self) -> DataFrame:
        """ROC points per model and class, from the forests' probabilities on the test rows."""
        return metrics.roc_curve(self._class_scores(), by=("model", "class"))

    def auc(self) -> DataFrame:
        return metrics.roc_auc(self._class_scores(), by=("model", "class"))

    def _class_scores(self) -> DataFrame:
        scored = {n: metrics.one_vs_rest(self.predictions.where(F.col("model") == n)) for n in self.forests}
        return profile.tagged(scored, ["class", "score", "positive"], "model")

    def leakage(self) -> DataFrame:
        """Feature rows that the core set shares with the test set."""
        return similarity.leakage(self.core, self.test)

    def cross_validation(self, table: str = "core", k: int = 5, shuffled: bool = True) -> DataFrame:
        """Accuracy and F1 per fold of the named table, refitted with that table's forest settings.

        Unshuffled folds (of any ``k``, commonly 7) follow the order of ``row_id``, which must then be a number or time.
        """
        forest = {"full": self.plan.full, "core": self.plan.core, "compressed": self.plan.compressed}[table]
        return models.cross_validate(self.tables()[table], forest, k, self.plan.seed, shuffled=shuffled)

    def importance_difference(self, top: int = 10) -> DataFrame:
        """The features whose importance differs most between the full and the core forest."""
        spark = self.train.sparkSession
        full = models.importances(self.forests["full"], self.names, spark)
        return models.importance_difference(full, models.importances(self.forests["core"], self.names, spark), top)

    def component_importances(self) -> DataFrame:
        """Importance of each principal component in the compressed table's forest."""
        if self.components is None:
            raise ValueError("this plan compresses rows, not columns")
        names = [f"PC{i + 1}" for i in range(self.components.k)]
        return models.importances(self.forests["compressed"], names, self.train.sparkSession)

    def clustering(self, k: int = 10) -> DataFrame:
        return clusters.clustering_report(self.core, k, self.plan.seed)

    def core_report(self) -> DataFrame:
        return profile.core_set_report(self.train, self.core)

    def similarity_log(self, top: int = 50) -> DataFrame:
        """The four distances for the most important features, like with like.

        Components of a PCA have no counterpart among the raw features, so the core
        set stands in for the compressed one there.
        """
        ranking = models.importances(self.forests["full"], self.names, self.train.sparkSession)
        wanted = [r["feature"] for r in models.top_features(ranking, top).collect()]
        other = self.core if self.plan.compress == "pca" else self.compressed
        stacked = similarity.stack(self.train, other, [self.names.index(f) for f in wanted])
        return FE.name_features(similarity.similarity_log(stacked), self.names)

    def timings(self) -> DataFrame:
        """(stage, seconds, rows, logical_mb, reused); the seconds are those of the build, also of a reused stage."""
        return self.train.sparkSession.createDataFrame(
            self.stages, "stage string, seconds double, rows bigint, logical_mb double, reused boolean"
        )


def run(df: DataFrame, plan: Plan, names: Sequence[str], time_column: str = "Time", store: Stages | None = None) -> Run:
    """Execute a plan on (row_id, features, label) rows, plus a time column for time splits.

    With ``impute``, empty feature cells get the feature's mean over the training rows.

    Each stage result is written once to the shared folder: forests and clusterings
    read it many times, and a lost executor then costs a re-read, not a re-run. With a ``store``, tables and models
    found there under the same settings and input content are taken from it; a run that changes nothing fits nothing.
    """
    spark = df.sparkSession
    store = store or Stages(spark, scratch_path(spark, "run"))
    stages: list[tuple] = []

    def noted(stage: Stage, width: int | None = None) -> Stage:
        megabytes = None if stage.rows is None else stage.rows * (width or 0) * 8 / 1024.0**2
        stages.append((stage.name, stage.seconds, stage.rows, megabytes, stage.reused))
        return stage

    def fit(name: str, table: Stage, forest: Forest):
        params = {"table": table.digest, "forest": asdict(forest)}
        rows = widen(table.table)
        model, stage = store.model(name, params, lambda: (models.fit_forest(rows, forest), {}), ForestModel.load)
        noted(stage)
        return model, stage

    keep = ["row_id", "label", "features"]
    ordered = [time_column] if plan.split == "time" else []
    split_by = {"time": time_column, "ratio": 0.8} if ordered else {"held": 0.2, "seed": plan.seed}
    prepared_by = {
        "input": content_key(df.select(*keep, *ordered)), "split": split_by, "impute": plan.impute, "single": plan.single,
        "threshold": plan.threshold, "filter_first": plan.filter_first,
    }

    @cache
    def prepared() -> tuple[DataFrame, DataFrame, list[int]]:
        if plan.split == "time":
            train, test = split.time_split(df, 0.8, time_column)
        else:
            train, test = split.stratified_split(df, 0.2, seed=plan.seed)
        train, test = train.select(*keep), test.select(*keep)
        if plan.impute:
            means = FE.cell_means(train)
            train, test = FE.fill_cells(train, means), FE.fill_cells(test, means)
        # One pass over the training rows yields the moments for both the filter and the scaler.
        scaler = FE.fit_scaler(train)
        kept = scaler.passing(plan.threshold, scaled=not plan.filter_first)
        chosen = scaler.subset(kept)
        train, test = chosen.apply(FE.keep_features(train, kept)), chosen.apply(FE.keep_features(test, kept))
        if plan.single:
            train, test = FE.cast_float32(train), FE.cast_float32(test)
        return train, test, kept

    train_stage = store.table("train", prepared_by, lambda: prepared()[0], lambda: {"kept": prepared()[2]})
    kept = train_stage.note["kept"]
    noted(train_stage, len(kept))
    test_stage = noted(store.table("test", prepared_by, lambda: prepared()[1]), len(kept))
    train, test = widen(train_stage.table), widen(test_stage.table)
    names = [names[i] for i in kept]

    full, full_stage = fit("fit_full", train_stage, plan.full)
    if plan.select == "entropy":
        def scored() -> DataFrame:
            return select.with_entropy(models.predict(full, train)).select(*keep, "entropy")

        entropy = noted(store.table("entropy", {"table": train_stage.digest, "model": full_stage.digest}, scored), len(kept))
        core_stage = store.table("core", {"entropy": entropy.digest}, lambda: banded_core(entropy.table, keep))
    else:
        k = plan.cluster_count(train_stage.rows)
        by = {"table": train_stage.digest, "k": k, "seed": plan.seed, "method": plan.method}
        core_stage = store.table("core", by, lambda: select.kmeans_core_set(train, k, plan.seed, method=plan.method).select(*keep))
    noted(core_stage, len(kept))
    core = core_stage.table
    core_model, core_fit = fit("fit_core", core_stage, plan.core)

    components = None
    if plan.compress == "pca":
        components, pca_stage = fitted_components(store, core_stage, plan.share)
        noted(pca_stage)
        by = {"table": core_stage.digest, "components": pca_stage.digest, "single": plan.single}
        compressed_stage = store.table("compressed", by, lambda: components.transform(core, single=plan.single).select(*keep))
        noted(compressed_stage, components.k)
        compressed = widen(compressed_stage.table)
        test_compressed = widen(components.transform(test, single=plan.single))
    else:
        def shrunk() -> DataFrame:
            if plan.guarded:
                return split.stratified_compress_guarded(core, plan.fraction, seed=plan.seed).select(*keep)
            return split.stratified_compress(core, plan.fraction, seed=plan.seed, strict=True).select(*keep)

        by = {"table": core_stage.digest, "fraction": plan.fraction, "guarded": plan.guarded, "seed": plan.seed}
        compressed_stage = noted(store.table("compressed", by, shrunk), len(kept))
        compressed, test_compressed = compressed_stage.table, test
    small_model, small_fit = fit("fit_compressed", compressed_stage, plan.compressed)

    forests = {"full": full, "core": core_model, "compressed": small_model}
    tests = {"full": test, "core": test, "compressed": test_compressed}

    def predicted() -> DataFrame:
        scored = {n: models.predict(m, tests[n]) for n, m in forests.items()}
        return profile.tagged(scored, ["row_id", "label", "prediction", "probability"], "model")

    by = {"table": test_stage.digest, "models": [full_stage.digest, core_fit.digest, small_fit.digest], "compressed": compressed_stage.digest}
    predictions = noted(store.table("predictions", by, predicted)).table
    return Run(plan, names, train, test, core, compressed, test_compressed, forests, predictions, components, stages)


def fitted_components(store: Stages, table: Stage, share: float) -> tuple[Components, Stage]:
    """The principal components of a stage's table, fitted or loaded."""

    def fit() -> tuple:
        found = fit_pca(table.table, share)
        return found.model, {"means": found.means, "explained": found.explained, "k": found.k}

    model, stage = store.model("fit_pca", {"table": table.digest, "share": share}, fit, PCAModel.load)
    return Components(stage.note["means"], model, stage.note["explained"], stage.note["k"]), stage


def widen(df: DataFrame) -> DataFrame:
    """Features as double arrays, the type the models compute in; single precision only at rest."""
    return df.withColumn("features", F.col("features").cast("array<double>"))


def banded_core(scored: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Both entropy tails; the key names the band, so a row in both stays two rows."""
    bands = select.entropy_bands(scored)
    return bands.withColumn("row_id", F.concat_ws("#", F.col("row_id").cast("string"), "band")).select(*keep)
