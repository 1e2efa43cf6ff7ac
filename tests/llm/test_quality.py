"""Quality scores: the flat trees against Spark's own model, held-out accuracy, odd inputs."""

import random

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from linkguard.functions.trees import node_table
from linkguard.llm import quality


def test_flat_trees_equal_the_model(spark):
    rows = spark.range(3000).select("id", F.array(F.rand(1), F.rand(2), F.round(F.rand(3), 1)).alias("x")).cache()
    label = ((F.col("x")[0] + F.col("x")[2] > 1).cast("double")).alias("label")
    df = rows.select("id", "x", array_to_vector("x").alias("features"), label)
    model = GBTClassifier(maxIter=6, maxDepth=4, seed=1).fit(df)
    flat = quality.Trees(node_table(spark, model).collect())
    got = model.transform(df).select("x", vector_to_array("probability")[1].alias("p")).collect()
    assert np.allclose(flat.score(np.array([r.x for r in got])), [r.p for r in got], atol=1e-12)


def test_statistics():
    texts = ["Aa bb, bb!! 12", "", None, "x\nx\n\ny z", "é É", "NO!! NO!! NO!!", "w " * 200 + "A!! " * 64 + "v " * 500]
    s = quality.statistics(pa.array(texts))
    col = {c: s[:, i] for i, c in enumerate(quality.NAMES)}
    assert s.shape == (7, len(quality.NAMES)) and np.isfinite(s).all() and (s[1] == s[2]).all()
    assert np.allclose(col["log_words"], np.log1p([4, 0, 0, 4, 2, 3, 764]))
    assert col["upper"][0] == np.float32(1 / 6) and np.isclose(col["digits"][0], 2 / 14) and np.isclose(col["marks"][0], 3 / 14)
    assert np.isclose(col["distinct_lines"][3], 2 / 3) and np.isclose(col["distinct_words"][3], 3 / 4)
    assert col["ends_twice"][5] == 1 and np.isclose(col["doubled_words"][5], 2 / 3) and col["all_caps"][5] == 1
    assert col["worst_odd"][6] == 1 and np.isclose(col["odd_words"][6], 64 / 764) and col["worst_distinct"][6] == 1
    # a text has the same statistics alone and in company
    for i, t in enumerate(texts):
        assert np.allclose(quality.statistics(pa.array([t], pa.string()))[0], s[i])
    assert quality.statistics(pa.array([], pa.string())).shape == (0, len(quality.NAMES))


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    rng = random.Random(1)
    odd = [(90001, None), (90002, ""), (None, "some words here"), (90003, "word " * 300_000), (90004, "x"),
           *[(90005, "same row")] * 3, (90006, "".join(rng.choice("äöü ß") for _ in range(50)))]
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame(odd, "doc_id long, text string")) \
        .withColumn("score", F.lit("x")).withColumn("stats", F.lit(1))
    more = labels.select("doc_id", "quality").unionByName(
        spark.createDataFrame([(None, 1), (90001, None), (90002, 7), (10 ** 9, 1)], "doc_id long, quality int")).withColumn("y", F.lit(0))
    got = quality.digest(df, more).collect()
    assert len(got) == df.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= .3) for r in got)
    truth = {r.doc_id: r.quality for r in labels.collect()}
    held = [(r.predicted, truth[r.doc_id]) for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 50 and np.mean([a == b for a, b in held]) > .97
    by_id = {r.doc_id: r for r in got}
    assert by_id[90001].score == by_id[90002].score and not by_id[None].held_out


def test_without_two_kinds_of_labels(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(20)], "doc_id int, text string")
    none = spark.createDataFrame([], "doc_id int, quality int")
    assert {r.score for r in quality.digest(docs, none).collect()} == {.5}
    good = spark.createDataFrame([(i, 1) for i in range(20)], "doc_id int, quality int")
    assert {r.score for r in quality.digest(docs, good).collect()} == {1.0}
    assert quality.digest(docs.limit(0), good).count() == 0


def test_keep_good(spark):
    d = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.withColumn("stats", F.lit("mine"))
    stats = quality.table_of_statistics(docs)
    trees = quality.fit(stats, labels, rounds=4)
    kept = quality.keep_good(docs, trees)
    want = {r.doc_id for r in quality.score_statistics(stats, trees).collect() if r.score >= quality.THRESHOLD}
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == want
