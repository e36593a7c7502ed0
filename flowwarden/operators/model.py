"""Boosted-tree model: training, scoring, persistence, trees as data."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..fixed_values import BOOSTING, DEFAULT_THRESHOLD, LABEL_MAPPING
from ..schema import CATEGORICAL_FEATURES, NUMERIC_FEATURES
from ..session import shared_folder
from . import evaluate as E
from . import prepare as P
from .detect import PROB
from .forest import forest_of
from .tree_shap import Nodes, expected_value, shap_column

#: Feature values that a task of the fit holds at most, with some 16 more a row for label, weight and errors.
TASK_VALUES = 8_000_000

METADATA_SCHEMA = (
    "feature_names array<string>, numeric_features array<string>, categorical_features array<string>, "
    "vocabulary map<string,array<string>>, scaler map<string,array<double>>, threshold double, "
    "label_mapping map<string,int>, performance map<string,double>, config map<string,double>"
)


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


@dataclass
class ModelPackage:
    """A fitted model with all that is needed to apply it to raw flows."""

    model: GBTClassificationModel
    numeric: list[str]
    vocab: dict[str, list[str]]
    scaler: dict[str, tuple[float, float]]
    threshold: float = DEFAULT_THRESHOLD
    performance: dict = field(default_factory=dict)
    config: dict = field(default_factory=dict)
    tree_rows: list | None = None

    @property
    def features(self) -> list[str]:
        return P.encoded_names(self.vocab, self.numeric)

    def with_features(self, df: DataFrame) -> DataFrame:
        """Add ``x``: conformed, encoded and scaled features in model order, one projection.

        Absent numeric columns count as 0, absent text columns and unseen values as no
        category; a null or NaN stays NaN and goes right at every split.
        """
        terms = []
        for c in self.numeric:
            mean, std = self.scaler[c]
            value = f"CAST(`{c}` AS DOUBLE)" if c in df.columns else "0D"
            terms.append(f"coalesce(({value} - ({mean!r}D)) / {(std or 1.0)!r}D, DOUBLE('NaN'))")
        for c, values in self.vocab.items():
            known = c in df.columns
            terms += [f"CASE WHEN `{c}` = {_text(v)} THEN 1D ELSE 0D END" if known else "0D" for v in values]
        return df.withColumn("x", F.expr("array(" + ", ".join(terms) + ")"))

    def score(self, df: DataFrame) -> DataFrame:
        """Add the probability of an intrusion; scoring stays in the JVM."""
        cols = [c for c in df.columns if c != PROB]
        ready = self.with_features(df).withColumn("features", array_to_vector("x"))
        return self.model.transform(ready).select(*cols, vector_to_array("probability")[1].alias(PROB))

    def explain(self, df: DataFrame) -> DataFrame:
        """Add ``x`` and ``shap``: log-odds attributions, additive up to ``base_value``."""
        return self.with_features(df).withColumn("shap", shap_column(df.sparkSession, self.forest()))

    def forest(self) -> list[Nodes]:
        """The trees, values scaled so that the sum over the leaves that a row reaches is the log-odds."""
        if self.tree_rows is None:
            raise ValueError("trees are read from the saved model: save or load the package first")
        return forest_of(self.tree_rows)

    @property
    def base_value(self) -> float:
        return expected_value(self.forest())

    def native_importance(self) -> dict[str, float]:
        gains = self.model.featureImportances.toArray()
        return {f: float(g) for f, g in zip(self.features, gains)}

    def metadata(self, spark: SparkSession) -> DataFrame:
        row = (self.features, self.numeric, list(self.vocab), self.vocab,
               {c: [float(m), float(s)] for c, (m, s) in self.scaler.items()}, float(self.threshold),
               LABEL_MAPPING, {k: float(v) for k, v in self.performance.items()},
               {k: float(v) for k, v in self.config.items()})
        return spark.createDataFrame([row], METADATA_SCHEMA)

    def save(self, spark: SparkSession, path: str) -> "ModelPackage":
        self.model.write().overwrite().save(f"{path}/model")
        self.metadata(spark).coalesce(1).write.mode("overwrite").parquet(f"{path}/metadata")
        self.tree_rows = model_trees(spark, path).collect()        # bounded by trees x 2^depth
        return self


def load_package(spark: SparkSession, path: str) -> ModelPackage:
    m = spark.read.parquet(f"{path}/metadata").first()
    return ModelPackage(
        GBTClassificationModel.load(f"{path}/model"), m["numeric_features"],
        {c: m["vocabulary"][c] for c in m["categorical_features"]},
        {c: tuple(v) for c, v in m["scaler"].items()}, m["threshold"], m["performance"], m["config"],
        model_trees(spark, path).collect())


def train_package(
    labelled: DataFrame, numeric: list[str] = NUMERIC_FEATURES, categorical: list[str] = CATEGORICAL_FEATURES,
    trees: int = BOOSTING["n_estimators"], depth: int = BOOSTING["max_depth"], policy: str = "first",
) -> ModelPackage:
    """Split, fit the encoder and scaler on the training part, boost, choose the threshold.

    ``labelled`` holds ``flow_id``, ``y`` and the features. The split is written once, by
    part, so that the passes after it prune to the part they need and repeat none of the
    work before it; the encoded rows are cached because every boosting round reads them, in
    partitions of a bounded number of values: files pack far more rows than a task should hold encoded.
    """
    spark = labelled.sparkSession
    folder = shared_folder(spark)
    P.stratified_split(labelled).select(
        "flow_id", "y", F.col("is_test").cast("int").alias("part"), *[f"`{c}`" for c in (*numeric, *categorical)]
    ).write.partitionBy("part").parquet(folder)
    split = spark.read.parquet(folder).withColumn("is_test", F.col("part") == 1)
    train = split.where(~F.col("is_test"))
    vocab = P.collect_vocab(split, categorical)
    scaler = P.collect_scaler(train, numeric)
    package = ModelPackage(None, numeric, vocab, scaler, config={
        "n_estimators": trees, "max_depth": depth, "learning_rate": BOOSTING["learning_rate"],
        "scale_pos_weight": BOOSTING["scale_pos_weight"]})
    rows = max(TASK_VALUES // (len(package.features) + 16), 1)
    ready = P.class_weights(package.with_features(P.bounded_parts(split, rows))).select(
        "flow_id", F.col("y").cast("double").alias("y"), "w", "is_test", array_to_vector("x").alias("features")).cache()
    gbt = GBTClassifier(
        labelCol="y", featuresCol="features", weightCol="w", maxIter=trees, maxDepth=depth,
        stepSize=BOOSTING["learning_rate"], subsamplingRate=BOOSTING["subsample"],
        featureSubsetStrategy=str(BOOSTING["colsample"]), maxBins=256, seed=BOOSTING["seed"])
    package.model = gbt.fit(ready.where(~F.col("is_test")))
    test = package.model.transform(ready.where("is_test")).select(
        F.col("y").cast("int").alias("y"), vector_to_array("probability")[1].alias(PROB)).cache()
    package.threshold = E.zero_fn_threshold(test, policy).first()["threshold"]
    metrics = E.eval_metrics(test, package.threshold).first().asDict()
    package.performance = {
        "threshold": package.threshold, "false_negatives": metrics["false_negatives"],
        "false_positives": metrics["false_positives"], "accuracy": metrics["accuracy"],
        "precision": metrics["precision"], "recall": metrics["recall"], "f1_score": metrics["f1"],
        "roc_auc": E.roc_auc(test).first()["roc_auc"] or 0.0}
    test.unpersist()
    ready.unpersist()
    return package


def loss_curve(package: ModelPackage, labelled: DataFrame) -> DataFrame:
    """Log loss on a labelled table after each boosting round."""
    ready = package.with_features(labelled).select(
        F.col("y").cast("double").alias("y"), F.lit(1.0).alias("w"), array_to_vector("x").alias("features"))
    losses = package.model.evaluateEachIteration(ready)
    return labelled.sparkSession.createDataFrame(
        [(i + 1, float(v)) for i, v in enumerate(losses)], "iteration int, loss double")


def native_importance(package: ModelPackage, spark: SparkSession, top: int = 15) -> DataFrame:
    rows = spark.createDataFrame(sorted(package.native_importance().items()), "feature string, importance double")
    return rows.orderBy(F.desc("importance"), "feature").limit(top)


def model_trees(spark: SparkSession, path: str) -> DataFrame:
    """Nodes of a saved package as rows; leaves have feature index -1."""
    nodes = spark.read.parquet(f"{path}/model/data").select("treeID", "nodeData.*")
    # stored by position: tree, parameters, weight
    weights = spark.read.parquet(f"{path}/model/treesMetadata").toDF("treeID", "params", "weights").drop("params")
    return nodes.join(F.broadcast(weights), "treeID").select(
        F.col("treeID").alias("tree_id"), F.col("id").alias("node_id"),
        F.col("leftChild").alias("left_child"), F.col("rightChild").alias("right_child"),
        F.col("split.featureIndex").alias("feature_index"),
        F.get("split.leftCategoriesOrThreshold", F.lit(0)).alias("threshold"),
        "prediction", F.get("impurityStats", F.lit(0)).alias("cover"), "gain", F.col("weights").alias("weight"))


def model_status(metadata: DataFrame) -> DataFrame:
    return metadata.select(
        F.lit("online").alias("status"), "threshold", F.size("feature_names").alias("n_features"))
