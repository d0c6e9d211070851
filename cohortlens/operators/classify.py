"""Classifiers on user features with MLlib: stacking, weights, grids, importance, clusters."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark.ml import Pipeline
from pyspark.ml.classification import (
    GBTClassificationModel, GBTClassifier, LogisticRegression, LogisticRegressionModel,
)
from pyspark.ml.clustering import BisectingKMeans
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import PCA, CountVectorizerModel, StringIndexer, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, functions as F
from pyspark.util import inheritable_thread_target

from cohortlens.operators import contingency as CT, sampling as SM, scaling
from cohortlens.operators.skipgram import Word2Vec
from cohortlens.session import ensure_checkpoint_dir


def training_set(df: DataFrame) -> DataFrame:
    """The rows every fit of a search reads again, written once to the shared checkpoint folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def assembled(df: DataFrame, cols: Sequence[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(cols), outputCol=out, handleInvalid="keep").transform(df)


def community_vectors(lists: DataFrame, column: str = "communities", size: int = 100, window: int = 5, min_count: int = 3,
                      epochs: int = 10, seed: int = 42, users_per_partition: int = 20000, most_partitions: int = 8) -> DataFrame:
    """Skip-gram vectors of communities from every user's list.

    Training runs in as many partitions as there are ``users_per_partition`` users, at most ``most_partitions``; their vectors
    are averaged after each epoch.  A partition hands over the vectors of all communities it met, so partitions that grew with
    the users would move users times communities.  Where there are more cores than ``most_partitions`` (up to 32), it takes those.
    """
    lists = training_set(lists.select(column))
    most_partitions = max(most_partitions, min(lists.sparkSession.sparkContext.defaultParallelism, 32))
    partitions = min(-(-lists.count() // users_per_partition) or 1, most_partitions)
    model = Word2Vec(
        vectorSize=size, windowSize=window, minCount=min_count, maxIter=epochs, seed=seed, numPartitions=partitions, inputCol=column, outputCol="_o"
    ).fit(lists)
    return model.getVectors().select(F.col("word").alias("community"), "vector")


def membership_vectors(lists: DataFrame, column: str = "communities", size: int = 500, min_users: int = 10, out: str = "features") -> DataFrame:
    """Sparse 0/1 vector over the communities in most lists (at least ``min_users``), ties to the smaller community."""
    users = lists.select(F.explode(F.array_distinct(column)).alias("_c")).groupBy("_c").agg(F.count(F.lit(1)).alias("_n"))
    top = users.where(F.col("_n") >= min_users).orderBy(F.desc("_n"), "_c").limit(size)
    names = [str(r[0]) for r in top.select("_c").collect()]  # at most ``size``
    if not names:
        return lists.withColumn(out, array_to_vector(F.array().cast("array<double>")))
    model = CountVectorizerModel.from_vocabulary(names, inputCol="_names", outputCol=out, binary=True)
    return model.transform(lists.withColumn("_names", F.coalesce(F.col(column).cast("array<string>"), F.array().cast("array<string>")))).drop("_names")


# ---- scaling --------------------------------------------------------------------------------


def standardised(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Zero mean and unit population deviation; constant columns are only centred."""
    stats = df.agg(*[F.avg(c).alias(f"_m_{c}") for c in cols], *[F.stddev_pop(c).alias(f"_s_{c}") for c in cols])
    out = df.join(F.broadcast(stats))  # one row
    scaled = {c: (F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") > 0, F.col(f"_s_{c}")).otherwise(1.0) for c in cols}
    return out.withColumns(scaled).drop(*[f"_{k}_{c}" for k in "ms" for c in cols])


def normal_scores(df: DataFrame, column: str, out: str, landmarks: int = 1000, fit_on: DataFrame | None = None) -> DataFrame:
    """Quantile-to-normal transform of one column, fitted on ``fit_on`` (``df`` itself without it)."""
    marks = scaling.quantile_marks(df if fit_on is None else fit_on, [column], landmarks)
    return scaling.to_normal(df.withColumn(out, F.col(column)), marks.withColumn("column", F.lit(out)), [out], landmarks=landmarks)


# ---- prediction -----------------------------------------------------------------------------


def with_confidence(predictions: DataFrame, labels: Sequence[str], threshold: float = 0.0, prob: str = "probability") -> DataFrame:
    """Per-class probabilities, the largest as confidence, no label below the threshold."""
    p = vector_to_array(prob)
    out = predictions.withColumn("_p", p)
    names = F.array(*[F.lit(x) for x in labels])
    best = F.array_max("_p")
    label = names[F.array_position("_p", best).cast("int") - 1]
    return out.withColumns(
        {
            **{f"prob_{x}": F.col("_p")[i] for i, x in enumerate(labels)},
            "confidence": best,
            "predicted": F.when(best >= threshold, label),
        }
    ).drop("_p")


class BoostedClasses:
    """One boosted model per class against the rest; their probabilities, brought to a sum of 1, are the classes'."""

    def __init__(self, models: Sequence[GBTClassificationModel]):
        self.models = list(models)

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with ``probability`` (a vector) and ``prediction``, the first class of the largest one."""
        out = df
        for i, model in enumerate(self.models):
            out = model.transform(out).withColumn(f"_share{i}", vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction")
        shares = [F.col(f"_share{i}") for i in range(len(self.models))]
        total = reduce(lambda x, y: x + y, shares)
        out = out.withColumn("_shares", F.array(*[x / total for x in shares]))
        best = (F.array_position("_shares", F.array_max("_shares")) - 1).cast("double")
        return out.withColumns({"probability": array_to_vector("_shares"), "prediction": best}).drop("_shares", *[f"_share{i}" for i in range(len(shares))])

    @property
    def featureImportances(self) -> list[float]:  # noqa: N802 - the name of MLlib's models
        """Mean over the classes."""
        parts = [m.featureImportances.toArray() for m in self.models]
        return [float(x) for x in sum(parts) / len(parts)]

    def save(self, path: str) -> None:
        for i, model in enumerate(self.models):
            model.write().overwrite().save(f"{path}/{i}")

    @classmethod
    def load(cls, path: str, n_classes: int) -> BoostedClasses:
        return cls([GBTClassificationModel.load(f"{path}/{i}") for i in range(n_classes)])


class Boosted:
    """Estimator of boosted trees for two classes or, one against the rest, for more; ``weight`` names a column."""

    def __init__(self, n_classes: int, label: str, features: str = "features", weight: str | None = None, **trees):
        self.n_classes, self.label = n_classes, label
        self.trees = GBTClassifier(labelCol=label, featuresCol=features, **trees, **({"weightCol": weight} if weight else {}))

    def fit(self, df: DataFrame) -> GBTClassificationModel | BoostedClasses:
        if self.n_classes == 2:
            return self.trees.fit(df)
        against = lambda c: df.withColumn(self.label, (F.col(self.label) == c).cast("double"))
        return BoostedClasses([self.trees.fit(against(c)) for c in range(self.n_classes)])


def _tree(n_classes: int, seed: int, iterations: int, depth: int, label: str, features: str, weight: str | None) -> Boosted:
    return Boosted(n_classes, label, features, weight, seed=seed, maxDepth=depth, maxIter=iterations)


def _probabilities(model, df: DataFrame, name: str, key: str, n: int) -> DataFrame:
    p = vector_to_array("probability")
    return model.transform(df).select(key, *[p[i].alias(f"{name}_p{i}") for i in range(1, n)])


def out_of_fold(df: DataFrame, name: str, cols: Sequence[str], key: str, label: str, n_classes: int, k: int,
                iterations: int = 20, depth: int = 4, seed: int = 42) -> DataFrame:
    """Class probabilities of every row from a model that has not seen its fold (column ``fold``)."""
    data = assembled(df.select(key, label, "fold", *cols), cols).select(key, label, "fold", "features")
    parts = []
    for f in range(k):
        model = _tree(n_classes, seed, iterations, depth, label, "features", None).fit(data.where(F.col("fold") != f))
        parts.append(_probabilities(model, data.where(F.col("fold") == f), name, key, n_classes))
    return reduce(DataFrame.unionByName, parts)


def stacked(df: DataFrame, signals: Mapping[str, Sequence[str]], key: str, label: str, n_classes: int = 2, k: int = 5,
            iterations: int = 20, depth: int = 4, seed: int = 42) -> DataFrame:
    """One boosted model per signal, and a meta-learner on their out-of-fold probabilities.

    Folds are fixed by hash, so every retry trains on the same rows; scaling or tuning never sees the
    held-out fold.  The meta-learner is cross-fitted on the same folds.
    """
    used = list(dict.fromkeys(c for cols in signals.values() for c in cols))
    folded = training_set(SM.folds(df.select(key, label, *used), key, label, k, seed))
    meta = folded.select(key, label, "fold")
    for name, cols in signals.items():
        meta = meta.join(out_of_fold(folded, name, cols, key, label, n_classes, k, iterations, depth, seed), key)
    feats = [c for c in meta.columns if c not in (key, label, "fold")]
    data = training_set(assembled(meta, feats))
    parts = []
    for f in range(k):
        model = LogisticRegression(labelCol=label, featuresCol="features", regParam=0.01).fit(data.where(F.col("fold") != f))
        parts.append(model.transform(data.where(F.col("fold") == f)).select(key, label, "fold", *feats, "probability", "prediction"))
    return reduce(DataFrame.unionByName, parts)


class Stack:
    """Signals and meta-learner fitted on all labelled rows; predicts any rows that have the signals' columns."""

    def __init__(self, signals: Mapping[str, Sequence[str]], models: Mapping[str, object], meta: object, n_classes: int):
        self.signals, self.models, self.meta, self.n_classes = dict(signals), dict(models), meta, n_classes

    def predict(self, df: DataFrame, labels: Sequence[str], threshold: float = 0.0) -> DataFrame:
        """Per-class probabilities, confidence and label (null below the threshold) of every row."""
        names, out = df.columns, df
        feats = []
        for name, cols in self.signals.items():
            out = self.models[name].transform(assembled(out, cols, "features"))
            p = vector_to_array("probability")
            made = [f"{name}_p{i}" for i in range(1, self.n_classes)]
            feats += made
            out = out.withColumns({c: p[i + 1] for i, c in enumerate(made)}).drop("features", "rawPrediction", "probability", "prediction")
        out = self.meta.transform(assembled(out, feats)).drop("features", "rawPrediction", "prediction", *feats)
        return with_confidence(out, labels, threshold).drop("probability").select(*names, *[f"prob_{x}" for x in labels], "confidence", "predicted")

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with ``prediction``, the number of the most probable class, as models of MLlib give it."""
        labels = [str(i) for i in range(self.n_classes)]
        kept = [c for c in df.columns if c not in ("confidence", "predicted", "prediction", *[f"prob_{x}" for x in labels])]
        return self.predict(df.select(*kept), labels).withColumn("prediction", F.col("predicted").cast("double")).select(*kept, "prediction")

    def save(self, path: str) -> None:
        """All models under ``path``, in MLlib's format."""
        for name, model in self.models.items():
            if isinstance(model, BoostedClasses):
                model.save(f"{path}/{name}")
            else:
                model.write().overwrite().save(f"{path}/{name}")
        self.meta.write().overwrite().save(f"{path}/meta")

    @classmethod
    def load(cls, path: str, signals: Mapping[str, Sequence[str]], n_classes: int = 2) -> Stack:
        load = GBTClassificationModel.load if n_classes == 2 else lambda x: BoostedClasses.load(x, n_classes)
        return cls(signals, {name: load(f"{path}/{name}") for name in signals}, LogisticRegressionModel.load(f"{path}/meta"), n_classes)


def fit_stack(df: DataFrame, signals: Mapping[str, Sequence[str]], key: str, label: str, n_classes: int = 2, k: int = 5,
              iterations: int = 20, depth: int = 4, seed: int = 42) -> Stack:
    """Meta-learner on out-of-fold probabilities, signals refitted on all rows of ``df``."""
    out = stacked(df, signals, key, label, n_classes, k, iterations, depth, seed)
    feats = [f"{name}_p{i}" for name in signals for i in range(1, n_classes)]
    meta = LogisticRegression(labelCol=label, featuresCol="features", regParam=0.01).fit(assembled(out.select(label, *feats), feats))
    rows = training_set(df.select(label, *dict.fromkeys(c for cols in signals.values() for c in cols)))
    models = {name: _tree(n_classes, seed, iterations, depth, label, "features", None).fit(assembled(rows, cols).select(label, "features")) for name, cols in signals.items()}
    return Stack(signals, models, meta, n_classes)


def weight_search(df: DataFrame, cols: Sequence[str], key: str, label: str, weights: Sequence[float], guarded: float = 0.0,
                  max_accuracy_loss: float = 0.03, max_recall_loss: float = 0.05, k: int = 3, seed: int = 42,
                  estimator: Callable[[str], object] | None = None) -> DataFrame:
    """Class weight that maximises macro F1 without losing too much accuracy or recall of one class.

    Every weight is judged on rows that its models have not seen.  When no weight keeps both limits, the smallest penalised
    loss wins.  One row per weight.  ``estimator`` makes the estimator from the name of the weight column: logistic
    regression without it, ``boosted_estimator(label)`` for boosted trees.
    """
    estimator = estimator or (lambda weight: LogisticRegression(labelCol=label, featuresCol="features", weightCol=weight))
    data = training_set(assembled(SM.folds(df, key, label, k, seed), cols).select(key, label, "fold", "features"))
    rows = []
    for w in weights:
        weighted = data.withColumn("_w", F.when(F.col(label) == guarded, 1.0).otherwise(float(w)))
        parts = []
        for f in range(k):
            model = estimator("_w").fit(weighted.where(F.col("fold") != f))
            parts.append(model.transform(weighted.where(F.col("fold") == f)).select(label, "prediction"))
        pred = reduce(DataFrame.unionByName, parts)
        m = CT.class_metrics(pred, label, "prediction")
        rows.append(
            m.agg(
                F.lit(float(w)).alias("weight"),
                (F.sum("correct") / F.sum("support")).alias("accuracy"),
                F.avg("f1").alias("macro_f1"),
                F.max(F.when(F.col("class") == guarded, F.col("recall"))).alias("guarded_recall"),
            )
        )
    table = reduce(DataFrame.unionByName, rows)
    base = table.where(F.col("weight") == float(weights[0])).select(F.col("accuracy").alias("_a"), F.col("guarded_recall").alias("_r"))
    t = table.join(F.broadcast(base))  # one row
    loss_a = F.greatest(F.lit(0.0), F.col("_a") - max_accuracy_loss - F.col("accuracy"))
    loss_r = F.greatest(F.lit(0.0), F.col("_r") - max_recall_loss - F.col("guarded_recall"))
    t = t.withColumns({"feasible": (loss_a == 0) & (loss_r == 0), "penalised": F.col("macro_f1") - 10 * (loss_a + loss_r)})
    from pyspark.sql import Window

    best = Window.orderBy(F.desc("feasible"), F.desc("penalised"), "weight")  # one row per weight
    return t.withColumn("chosen", F.row_number().over(best) == 1).drop("_a", "_r")


def grid_search(df: DataFrame, cols: Sequence[str], key: str, label: str, grid: Sequence[float], k: int = 3,
                metric: str = "accuracy", seed: int = 42, parallelism: int = 2) -> DataFrame:
    """Cross-validated metric of each regularisation strength, on hash folds."""
    data = assembled(SM.folds(df, key, label, k, seed), cols, "raw").select("raw", label, F.col("fold").cast("int").alias("fold"))
    data = training_set(data)
    lr = LogisticRegression(labelCol=label, featuresCol="features", maxIter=50)
    pipe = Pipeline(stages=[StandardScaler(inputCol="raw", outputCol="features", withMean=True), lr])
    maps = ParamGridBuilder().addGrid(lr.regParam, [float(g) for g in grid]).build()
    cv = CrossValidator(
        estimator=pipe, estimatorParamMaps=maps, numFolds=k, foldCol="fold", parallelism=parallelism,
        evaluator=MulticlassClassificationEvaluator(labelCol=label, metricName=metric),
    ).fit(data)
    out = [(float(g), float(m)) for g, m in zip(grid, cv.avgMetrics)]
    best = max(out, key=lambda r: (r[1], -r[0]))
    return df.sparkSession.createDataFrame([(g, m, g == best[0]) for g, m in out], f"reg_param double, {metric} double, chosen boolean")


def boosted_estimator(label: str, n_classes: int = 2, iterations: int = 20, depth: int = 4, seed: int = 42) -> Callable[[str], Boosted]:
    """Maker of boosted trees for ``weight_search``."""
    return lambda weight: _tree(n_classes, seed, iterations, depth, label, "features", weight)


def boosted_grid(df: DataFrame, cols: Sequence[str], key: str, label: str, depths: Sequence[int], rates: Sequence[float], iterations: int = 20,
                 k: int = 3, metric: str = "f1", seed: int = 42, parallelism: int = 4) -> DataFrame:
    """Cross-validated metric of each depth and learning rate of boosted trees, on hash folds; ties go to the smaller model.

    ``parallelism`` models are fitted at a time; no model is fitted on all folds.  The rows are dealt to all cores, as a small
    table of many fits would otherwise stay in the few partitions of its last join.
    """
    spark = df.sparkSession
    rows = SM.folds(df, key, label, k, seed).repartition(spark.sparkContext.defaultParallelism, key)
    data = training_set(assembled(rows, cols).select("features", label, F.col("fold").cast("int").alias("fold")))
    evaluator = MulticlassClassificationEvaluator(labelCol=label, metricName=metric)
    grid = [(int(d), float(r)) for d in depths for r in rates]

    def judged(task: tuple[int, tuple[int, float]]) -> float:
        fold, (depth, rate) = task
        tree = GBTClassifier(labelCol=label, featuresCol="features", maxIter=iterations, maxDepth=depth, stepSize=rate, seed=seed)
        return evaluator.evaluate(tree.fit(data.where(F.col("fold") != fold)).transform(data.where(F.col("fold") == fold)))

    tasks = [(fold, point) for point in grid for fold in range(k)]
    with ThreadPool(max(1, min(parallelism, len(tasks)))) as pool:
        found = pool.map(inheritable_thread_target(spark)(judged), tasks, chunksize=1)
    out = [(*point, sum(found[i * k : i * k + k]) / k) for i, point in enumerate(grid)]
    best = max(out, key=lambda r: (r[2], -r[0], -r[1]))
    return spark.createDataFrame([(*r, r == best) for r in out], f"depth int, rate double, {metric} double, chosen boolean")


def boosted(df: DataFrame, cols: Sequence[str], label: str, n_classes: int = 2, iterations: int = 20, depth: int = 4, seed: int = 42):
    """Boosted trees fitted on the columns of ``df``, one model per class for more than two."""
    return _tree(n_classes, seed, iterations, depth, label, "features", None).fit(training_set(assembled(df, cols).select(label, "features")))


def tree_importances(df: DataFrame, cols: Sequence[str], label: str, iterations: int = 20, depth: int = 4, seed: int = 42) -> DataFrame:
    model = boosted(df, cols, label, 2, iterations, depth, seed)
    return df.sparkSession.createDataFrame(
        [(c, float(model.featureImportances[i])) for i, c in enumerate(cols)], "feature string, importance double"
    )


def topics(df: DataFrame, vector: str, k: int = 10, components: int = 5, min_size: int = 10, seed: int = 42) -> DataFrame:
    """Clusters of embeddings after reduction; members of clusters below ``min_size`` become −1."""
    data = training_set(df).withColumn("_v", array_to_vector(F.transform(vector, lambda x: x.cast("double"))))
    reduced = PCA(k=components, inputCol="_v", outputCol="_r").fit(data).transform(data)
    out = BisectingKMeans(k=k, seed=seed, featuresCol="_r", predictionCol="topic", minDivisibleClusterSize=float(min_size)).fit(reduced).transform(reduced)
    sizes = out.groupBy("topic").agg(F.count(F.lit(1)).alias("_n"))
    out = out.join(F.broadcast(sizes), "topic")  # one row per cluster
    return out.withColumn("topic", F.when(F.col("_n") < min_size, -1).otherwise(F.col("topic"))).drop("_v", "_r", "_n")


def indexed(df: DataFrame, column: str, out: str = "label") -> DataFrame:
    """Class numbers in alphabetical order."""
    return StringIndexer(inputCol=column, outputCol=out, stringOrderType="alphabetAsc").fit(df).transform(df)
