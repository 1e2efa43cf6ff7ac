"""Nodes of a fitted tree ensemble as a table, and what each feature adds to a row's score along its paths."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkguard.shared import shared_folder


def node_table(spark: SparkSession, model) -> DataFrame:
    """tree, node, feature, threshold, left, right, value, weight, impurity_stats of a random forest or boosted trees.

    Rows go left where feature <= threshold. Leaves have feature -1. The table is what the model's own writer stores, so its
    size is that of the model and no node passes through the driver.
    """
    path = f"{shared_folder(spark, 'trees')}/model"
    model.write().save(path)
    weights = spark.createDataFrame(list(enumerate(map(float, model.treeWeights))), "tree int, weight double")
    n = F.col("nodeData")
    nodes = spark.read.parquet(f"{path}/data").select(
        F.col("treeID").alias("tree"), n.id.alias("node"), n.split.featureIndex.alias("feature"),
        F.get(n.split.leftCategoriesOrThreshold, F.lit(0)).alias("threshold"), n.leftChild.alias("left"),
        n.rightChild.alias("right"), n.prediction.alias("value"), n.impurityStats.alias("impurity_stats"))
    return nodes.join(weights, "tree")


class Paths:
    """The trees of an ensemble as flat arrays. Each node has a value: its share of label 1 over the number of trees (random
    forest), or its weighted prediction (boosted trees). A step down adds the difference of the two values to the split's
    feature, so a row's contributions and the values of the roots add up to the sum over its leaves."""

    def __init__(self, nodes: list, boosted: bool):
        nodes = sorted(nodes, key=lambda r: (r.tree, r.node))
        place = {(r.tree, r.node): i for i, r in enumerate(nodes)}
        trees = sorted({r.tree for r in nodes})
        self.boosted = boosted
        self.roots = [place[t, 0] for t in trees]
        self.feature = np.array([r.feature for r in nodes])
        self.threshold = np.array([r.threshold if r.feature >= 0 else 0.0 for r in nodes], float)
        self.left, self.right = (np.array([place.get((r.tree, k), -1) for r, k in ((r, getattr(r, side)) for r in nodes)])
                                 for side in ("left", "right"))
        self.value = np.array([r.value * r.weight if boosted else
                               r.impurity_stats[1] / (r.impurity_stats[0] + r.impurity_stats[1]) / len(trees) for r in nodes], float)
        self.base = float(sum(self.value[i] for i in self.roots))

    def walk(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probability of label 1, and contributions (rows x features)."""
        parts, total = np.zeros(x.shape), np.full(len(x), self.base)
        for root in self.roots:
            rows, at = np.arange(len(x)), np.full(len(x), root)
            while len(rows):
                inner = self.feature[at] >= 0
                rows, at = rows[inner], at[inner]
                f = self.feature[at]
                to = np.where(x[rows, f] <= self.threshold[at], self.left[at], self.right[at])
                step = self.value[to] - self.value[at]
                parts[rows, f] += step  # a row is there once
                total[rows] += step
                at = to
        return (1 / (1 + np.exp(-2 * total)) if self.boosted else total), parts


def contributions(model, df: DataFrame, cols: list[str], keep: list[str]) -> tuple[float, DataFrame]:
    """Sum of the root values, and per row: keep, probability, parts (what each of cols adds). For boosted trees the parts add
    up to half the log odds, for a random forest to the probability. The nodes, as many as the model has, are broadcast."""
    paths = Paths(node_table(df.sparkSession, model).collect(), "GBT" in type(model).__name__)
    shared, width = df.sparkSession.sparkContext.broadcast(paths), len(cols)
    plain = df.select(*keep, F.array(*[F.col(c).cast("double") for c in cols]).alias("_x"))

    def walk(batches):
        for b in batches:
            x = b.column(b.num_columns - 1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, width)
            p, parts = shared.value.walk(x)
            arr = pa.ListArray.from_arrays(pa.array(np.arange(0, parts.size + 1, width), pa.int32()), pa.array(parts.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(p), arr], names=[*keep, "probability", "parts"])

    schema = plain.drop("_x").withColumn("probability", F.lit(0.0)).withColumn("parts", F.array(F.lit(0.0))).schema
    return paths.base, plain.mapInArrow(walk, schema)
