"""Exported tree nodes: scores and contributions recomputed in DuckDB and against Spark's models."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from linkguard.functions.trees import contributions, node_table
from linkguard.operators import ml as M

COLS = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def rows(spark):
    cols = [F.rand(1).alias("a"), F.floor(F.rand(2) * 5).alias("b"), F.rand(3).alias("c"), F.lit(1.0).alias("d")]
    df = spark.range(1500).select(F.col("id").alias("url_id"), *cols)
    return df.withColumn("label", ((F.col("a") + F.col("b") / 5 + F.rand(5) / 4) > 1).cast("int")).cache()


@pytest.mark.parametrize("name,boosted", [("random_forest", False), ("gradient_boosting", True)])
def test_scores_in_duckdb(spark, rows, tmp_path, name, boosted):
    model = M.train(name, rows, COLS, trees=12, boost_rounds=8)
    want = {r.url_id: r.probability for r in M.probability(model, rows).collect()}
    node_table(spark, model.stages[-1]).withColumn("share", F.expr("try_divide(impurity_stats[1], impurity_stats[0] + impurity_stats[1])")) \
        .drop("impurity_stats").write.parquet(str(tmp_path / "nodes"))
    rows.write.parquet(str(tmp_path / "rows"))
    got = duckdb.sql(f"""
        WITH RECURSIVE n AS (SELECT * FROM '{tmp_path}/nodes/*.parquet'),
        x AS (SELECT url_id, [a, b, c, d] AS v FROM '{tmp_path}/rows/*.parquet'),
        w AS (SELECT url_id, v, n.* FROM x, n WHERE node = 0
              UNION ALL
              SELECT w.url_id, v, n.* FROM w JOIN n ON n.tree = w.tree
                AND n.node = CASE WHEN v[w.feature + 1] <= w.threshold THEN w."left" ELSE w."right" END WHERE w.feature >= 0)
        SELECT url_id, {'1 / (1 + exp(-2 * sum(value * weight)))' if boosted else 'avg(share)'}
        FROM w WHERE feature < 0 GROUP BY 1""").fetchall()
    assert len(got) == 1500 and all(abs(p - want[i]) < 1e-9 for i, p in got)


@pytest.mark.parametrize("name,boosted", [("random_forest", False), ("gradient_boosting", True)])
def test_contributions(spark, rows, name, boosted):
    model = M.train(name, rows, COLS, trees=12, boost_rounds=8)
    base, got = contributions(model.stages[-1], rows, COLS, ["url_id"])
    want = {r.url_id: r.probability for r in M.probability(model, rows).collect()}
    got = got.collect()
    for r in got:
        total = base + sum(r.parts)
        assert abs((1 / (1 + np.exp(-2 * total)) if boosted else total) - want[r.url_id]) < 1e-9
        assert r.parts[3] == 0  # a constant is never split on
    assert np.mean([abs(r.parts[0]) for r in got]) > np.mean([abs(r.parts[2]) for r in got])
    _, top = M.explain_trees(model, rows.select("url_id", *COLS), 2)
    assert all(len(r.top_features) == 2 for r in top.limit(5).collect())
    assert contributions(model.stages[-1], rows.limit(0), COLS, ["url_id"])[1].count() == 0


def test_selected_columns_are_stored(spark, rows, tmp_path):
    for by in ("anova", "mutual_info"):
        model = M.train("logistic_regression", rows, COLS, select=2, select_by=by)
        assert M.model_columns(model) == ["a", "b"]
        M.save_model(spark, model, "logistic_regression", str(tmp_path), by, M.model_columns(model), COLS)
        again, meta = M.latest_model(spark, str(tmp_path))
        assert M.model_columns(again) == meta["selected_features"] == ["a", "b"]


def test_boosting_stops_early(spark, rows):
    noise = rows.withColumn("label", (F.rand(9) > .5).cast("int"))
    model = M.train("gradient_boosting", noise, COLS, boost_rounds=60)
    assert len(model.stages[-1].trees) < 60


def test_quantile_bins(spark):
    """Bins follow the rank, not the value: one far value does not empty the others."""
    df = spark.range(1000).selectExpr("id", "cast(exp(id / 50.0) as double) AS x", "cast(id % 2 as int) AS even",
                                      "cast(id < 300 as int) AS label", "7.0 AS fixed")
    got = {r.feature: r.mutual_info for r in M.mutual_information(df, ["x", "even", "fixed"], quantiles=True).collect()}
    whole = -(.3 * np.log(.3) + .7 * np.log(.7))
    assert abs(got["x"] - whole) < .01 and abs(got["even"]) < 1e-9 and abs(got["fixed"]) < 1e-12
    wide = {r.feature: r.mutual_info for r in M.mutual_information(df, ["x"]).collect()}
    assert wide["x"] < got["x"] / 2
