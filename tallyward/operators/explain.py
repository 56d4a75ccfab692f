"""Feature attribution of a surrogate forest: global Shapley importance and local weights."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyward.functions.reshape import numeric_columns, quoted
from tallyward.functions.selection import nth_row

# Size and seed of the surrogate.
TREES = 80
SEED = 42


@dataclass(frozen=True)
class Surrogate:
    model: RandomForestClassificationModel
    features: tuple[str, ...]
    rows: DataFrame
    classes: int
    means: tuple[float, ...] | None = None  # the row to compare with; the mean of ``rows`` if not given

    def score(self, df: DataFrame) -> DataFrame:
        """Adds the class probabilities as an array."""
        assembled = VectorAssembler(inputCols=list(self.features), outputCol="vector").transform(df)
        return self.model.transform(assembled).withColumn("p", vector_to_array("probability")).drop(
            "vector", "rawPrediction", "probability", "prediction"
        )

    def explained_classes(self) -> list[int]:
        return [1] if self.classes == 2 else list(range(self.classes))


def fit_surrogate(df: DataFrame, label: str, max_depth: int = 5) -> Surrogate:
    """Random forest on the numeric columns, missing values as 0.

    Trees end at ``max_depth``, 30 at the most, so a forest has at most 80 x 2^depth leaves whatever the data; a
    deeper one follows the label more closely, and its attributions cost in proportion to its leaves.
    """
    features = [c for c in numeric_columns(df) if c != label]
    if not features:
        raise ValueError("no numeric feature")
    rows = df.select(
        *[F.coalesce(quoted(c).cast("double"), F.lit(0.0)).alias(c) for c in features],
        quoted(label).cast("string").alias("_label"),
    )
    indexer = StringIndexer(
        inputCol="_label", outputCol="_class", stringOrderType="alphabetAsc", handleInvalid="skip"
    ).fit(rows)
    assembler = VectorAssembler(inputCols=features, outputCol="vector")
    forest = RandomForestClassifier(
        featuresCol="vector", labelCol="_class", numTrees=TREES, seed=SEED, maxDepth=max_depth
    )
    model = forest.fit(assembler.transform(indexer.transform(rows)))
    return Surrogate(model, tuple(features), rows.select(features), model.numClasses)


def _leaves(model: RandomForestClassificationModel) -> list[tuple[dict[int, tuple[float, float]], list[float]]]:
    """(bounds per feature, class shares) of every leaf: values in (low, high] of each feature on its path reach it.

    The forest has a fixed number of trees of limited depth, so its leaves are few whatever the data.
    """
    found = []
    for tree in model.trees:
        stack = [(tree._call_java("rootNode"), {})]
        while stack:
            node, bounds = stack.pop()
            if node.subtreeDepth() == 0:
                counts = list(node.impurityStats().stats())
                whole = sum(counts) or 1.0
                found.append((bounds, [c / whole for c in counts]))
                continue
            split = node.split()
            feature, at = split.featureIndex(), split.threshold()
            low, high = bounds.get(feature, (-math.inf, math.inf))
            stack.append((node.leftChild(), bounds | {feature: (low, min(high, at))}))
            stack.append((node.rightChild(), bounds | {feature: (max(low, at), high)}))
    return found


Leaf = tuple[dict[int, tuple[float, float]], list[float]]


def shapley_values(surrogate: Surrogate) -> DataFrame:
    """Exact attributions of every row against the mean row: a0, a1, ... per feature, averaged over classes."""
    names, classes = surrogate.features, surrogate.explained_classes()
    means = surrogate.means or tuple(surrogate.rows.agg(*[F.avg(quoted(c)) for c in names]).first())
    trees = surrogate.model.getNumTrees
    leaves = [(bounds, [p[c] / trees for c in classes]) for bounds, p in _leaves(surrogate.model)]
    return attributions(surrogate.rows, names, leaves, means)


def attributions(rows: DataFrame, names: Sequence[str], leaves: Sequence[Leaf], means: Sequence[float | None]) -> DataFrame:
    """Mean absolute Shapley values over the outputs of a forest given by its leaves: a0, a1, ... per feature and row.

    ``leaves`` are (bounds per feature, outputs): a row whose values lie in (low, high] of each bounded feature gets the
    outputs, and a forest's output is the sum over its leaves. A leaf counts for a coalition when the row meets its
    bounds on the coalition's features and the mean row on the others. With A the features whose bounds only the row
    meets and B those only the mean row meets, its share in a feature of A is (|A| - 1)! |B|! / (|A| + |B|)! and in one
    of B the negative of |A|! (|B| - 1)! / (|A| + |B|)!; a feature that neither meets makes it nothing. So no coalition
    is scored, and rows stay where they are.
    """
    outputs = range(len(leaves[0][1]) if leaves else 1)
    depth = max((len(b) for b, _ in leaves), default=0) or 1
    feature = np.zeros((len(leaves), depth), dtype=np.int64)
    low, high = np.full((len(leaves), depth), -np.inf), np.full((len(leaves), depth), np.inf)
    for n, (bounds, _) in enumerate(leaves):
        for k, (i, (a, b)) in enumerate(sorted(bounds.items())):
            feature[n, k], low[n, k], high[n, k] = i, a, b
    shares = np.array([p for _, p in leaves]).reshape(len(leaves), len(outputs))
    usual = np.array([0.0 if m is None else m for m in means])[feature]
    by_mean = (usual > low) & (usual <= high)
    factorial = [math.factorial(n) for n in range(2 * depth + 1)]
    gain = np.zeros((depth + 1, depth + 1))
    loss = np.zeros((depth + 1, depth + 1))
    for a in range(depth + 1):
        for b in range(depth + 1):
            if a:
                gain[a, b] = factorial[a - 1] * factorial[b] / factorial[a + b]
            if b:
                loss[a, b] = factorial[a] * factorial[b - 1] / factorial[a + b]
    places = [np.eye(len(names))[feature[:, k]] for k in range(depth)]  # leaves x features

    def attribute(batches):
        for batch in batches:
            x = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(len(names))])
            total = np.zeros(x.shape)
            for at in range(0, len(x), 128):
                part = x[at : at + 128][:, feature]  # rows x leaves x depth
                by_row = (part > low) & (part <= high)
                only_row, only_mean = by_row & ~by_mean, by_mean & ~by_row
                alive = (by_row | by_mean).all(axis=2)
                a, b = only_row.sum(axis=2), only_mean.sum(axis=2)
                up, down = gain[a, b] * alive, loss[a, b] * alive
                for c in outputs:
                    value = np.zeros((len(part), len(names)))
                    for k in range(depth):
                        value += ((up * only_row[:, :, k] - down * only_mean[:, :, k]) * shares[:, c]) @ places[k]
                    total[at : at + 128] += np.abs(value) / len(outputs)
            yield pa.RecordBatch.from_arrays([pa.array(total[:, i]) for i in range(len(names))], names=[f"a{i}" for i in range(len(names))])

    return rows.select(*[quoted(c) for c in names]).mapInArrow(attribute, ", ".join(f"a{i} double" for i in range(len(names))))


def global_importance(surrogate: Surrogate) -> DataFrame:
    """(feature, importance): mean absolute attribution over all rows, scaled to sum 1."""
    return scaled_importance(shapley_values(surrogate), surrogate.features)


def scaled_importance(values: DataFrame, names: Sequence[str]) -> DataFrame:
    """(feature, importance) of attributions a0, a1, ...: their sums over all rows, scaled to sum 1, to four decimals."""
    total = values.agg(*[F.sum(f"a{i}").alias(f"a{i}") for i in range(len(names))])
    whole = sum((F.col(f"a{i}") for i in range(len(names))), F.lit(0.0))
    scale = F.when(whole > 0, whole).otherwise(F.lit(1.0))
    rows = [
        F.struct(F.lit(c).alias("feature"), F.round(F.col(f"a{i}") / scale, 4).alias("importance"))
        for i, c in enumerate(names)
    ]
    return total.select(F.inline(F.array(*rows))).orderBy(F.desc("importance"), "feature")


def local_explanation(
    surrogate: Surrogate,
    index: int = 0,
    order_by: Sequence[str] = (),
    samples: int = 5000,
    explained_class: int = 1,
) -> DataFrame:
    """(feature, weight) of one row from a weighted linear fit on perturbed rows.

    Rows are drawn around the feature means; a perturbed feature counts as kept when it lies in the
    same quartile as the explained row's value. The index is clamped to the table.
    """
    names = surrogate.features
    rows = surrogate.rows
    facts = rows.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(quoted(c)).alias(f"m{i}") for i, c in enumerate(names)],
        *[F.stddev_pop(quoted(c)).alias(f"s{i}") for i, c in enumerate(names)],
        *[F.percentile_approx(quoted(c), [0.25, 0.5, 0.75]).alias(f"q{i}") for i, c in enumerate(names)],
    ).first()
    index = max(0, min(index, facts["n"] - 1))
    row = nth_row(rows, order_by or names, index)
    bins = [sum(row[c] > cut for cut in facts[f"q{i}"]) for i, c in enumerate(names)]

    spark = rows.sparkSession
    drawn = spark.range(samples).select(
        *[
            (F.lit(facts[f"m{i}"]) + F.randn(SEED + i) * F.lit(facts[f"s{i}"])).alias(c)
            for i, c in enumerate(names)
        ]
    )

    def kept(i: int, c: str):
        place = sum(((quoted(c) > F.lit(cut)).cast("int") for cut in facts[f"q{i}"]), F.lit(0))
        return (place == bins[i]).cast("double")

    scored = surrogate.score(drawn).select(
        *[kept(i, c).alias(f"k{i}") for i, c in enumerate(names)],
        F.col("p")[min(explained_class, surrogate.classes - 1)].alias("target"),
    )
    changed = F.lit(float(len(names))) - sum((F.col(f"k{i}") for i in range(len(names))), F.lit(0.0))
    width = 0.75 * math.sqrt(len(names))
    weighted = VectorAssembler(
        inputCols=[f"k{i}" for i in range(len(names))], outputCol="vector"
    ).transform(scored.withColumn("weight", F.sqrt(F.exp(-changed / (width * width)))))
    fit = LinearRegression(
        featuresCol="vector", labelCol="target", weightCol="weight", regParam=1.0 / samples, elasticNetParam=0.0
    ).fit(weighted)
    weights = [(c, round(float(w), 4), index) for c, w in zip(names, fit.coefficients)]
    return spark.createDataFrame(weights, "feature string, weight double, instance_index bigint").orderBy(
        F.desc(F.abs("weight")), "feature"
    )


def stored_importance(
    importance: DataFrame, version_id: str, computed_at: str, dataset_id: str | None = None
) -> DataFrame:
    """Importance rows to append to a model version's history."""
    return importance.select(
        F.lit(version_id).alias("version_id"),
        "feature",
        "importance",
        F.lit("shapley").alias("engine"),
        F.lit(computed_at).cast("timestamp_ntz").alias("computed_at"),
        F.lit(dataset_id).cast("string").alias("dataset_id"),
    )
