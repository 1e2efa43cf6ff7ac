"""Training, selection, evaluation and explanation of URL classifiers with MLlib."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.ml import PipelineModel, Pipeline
from pyspark.ml.classification import (GBTClassifier, LogisticRegression,
                                       MultilayerPerceptronClassifier, RandomForestClassifier)
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from linkguard import constants as C
from linkguard.functions.sqlutil import add, lit
from linkguard.functions.trees import contributions


# --- preparation -------------------------------------------------------------------------------
def clean(features: DataFrame, cols: list[str]) -> DataFrame:
    """NULL, NaN and infinities become 0."""
    def fix(c):
        x = F.col(c).cast("double")
        return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x)
    return features.withColumns({c: fix(c) for c in cols})


def varying_columns(features: DataFrame, cols: list[str]) -> list[str]:
    """Columns with more than one value, by one min/max pass."""
    row = features.agg(*[(F.min(c) < F.max(c)).alias(c) for c in cols]).first()
    return [c for c in cols if row[c]]


def split_bucket(key: str, seed: int = 42) -> str:
    """SQL: stable bucket 0..99 of a key."""
    return f"cast(conv(substr(md5(concat({key}, ':{seed}')), 1, 8), 16, 10) as bigint) % 100"


def group_split(df: DataFrame, group: str = "domain", test: float = 0.2, seed: int = 42) -> DataFrame:
    """Adds ``is_test``: whole groups go to one side, by a hash of the group, however few there are.
    ``leakage_report`` shows a side that stayed empty."""
    return add(df, is_test=f"{split_bucket(group, seed)} < {int(round(test * 100))}")


def leakage_report(split: DataFrame, group: str = "domain") -> DataFrame:
    """Rows, groups and class balance per side, and the groups found on both sides."""
    per_group = split.groupBy(group).agg(
        F.count_if(~F.col("is_test")).alias("train"), F.count_if("is_test").alias("test"),
        F.count_if((F.col("label") == 1) & ~F.col("is_test")).alias("train_pos"),
        F.count_if((F.col("label") == 1) & F.col("is_test")).alias("test_pos"))
    return per_group.agg(
        F.sum("train").alias("train_rows"), F.sum("test").alias("test_rows"),
        F.sum("train_pos").alias("train_malicious"), F.sum("test_pos").alias("test_malicious"),
        F.count_if(F.col("train") > 0).alias("train_groups"),
        F.count_if(F.col("test") > 0).alias("test_groups"),
        F.count_if((F.col("train") > 0) & (F.col("test") > 0)).alias("shared_groups"))


def duplicate_report(split: DataFrame, cols: list[str]) -> DataFrame:
    """Identical feature rows, and those seen on both sides (by a 64-bit row hash)."""
    g = split.groupBy(F.xxhash64(*cols).alias("h")).agg(
        F.count("*").alias("n"), F.max(F.col("is_test").cast("int")).alias("t"),
        F.min(F.col("is_test").cast("int")).alias("m"))
    return g.agg(F.sum("n").alias("rows"), F.count("*").alias("distinct_rows"),
                 F.count_if(F.col("t") != F.col("m")).alias("in_both_sides"))


def assemble(cols: list[str], out: str = "features") -> VectorAssembler:
    return VectorAssembler(inputCols=cols, outputCol=out, handleInvalid="keep")


def scaler(cols: list[str]) -> Pipeline:
    """Assemble and standardise; fit it on the training side only."""
    return Pipeline(stages=[assemble(cols, "raw"), StandardScaler(
        inputCol="raw", outputCol="features", withMean=True, withStd=True)])


# --- feature selection ---------------------------------------------------------------------------
def anova_f(df: DataFrame, cols: list[str], label: str = "label") -> DataFrame:
    """One-way ANOVA F per feature from class sums: one wide aggregate, then a tiny unpivot."""
    sums = df.groupBy(label).agg(
        F.count("*").cast("double").alias("n"),
        *[F.sum(F.col(c).cast("double")).alias(f"s_{c}") for c in cols],
        *[F.sum(F.col(c).cast("double") * F.col(c)).alias(f"q_{c}") for c in cols])
    stack = ", ".join(f"'{c}', s_{c}, q_{c}" for c in cols)
    long = sums.select("n", F.expr(f"stack({len(cols)}, {stack}) AS (feature, s, q)"))
    agg = long.groupBy("feature").agg(
        F.sum("n").alias("n"), F.count("*").alias("k"), F.sum("s").alias("s"),
        F.sum("q").alias("q"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("b"))
    df = add(agg, between="b - s * s / n", within="q - b")
    return df.selectExpr("feature", "CASE WHEN within > 0 THEN (between / (k - 1)) / "
                                    "(within / (n - k)) END AS f_value")


def select_top(scores: DataFrame, col: str, k: int = 30) -> list[str]:
    """The k best features; ties by name."""
    return [r.feature for r in scores.orderBy(F.desc_nulls_last(F.round(col, 4)), "feature").limit(k).collect()]


def equal_width_bin(c: str, lo: float, hi: float, bins: int) -> str:
    """SQL: the bin of a column between its least and largest value."""
    if hi <= lo:
        return "0"
    return f"least(cast(floor((cast({c} as double) - {lo!r}D) / {hi - lo!r}D * {bins}) as int), {bins - 1})"


def quantile_bin(c: str, limits: list[float]) -> str:
    """SQL: how many of the limits lie below the value, so equal values share a bin."""
    return " + ".join(f"int(cast({c} as double) > {x!r}D)" for x in sorted(set(limits))) or "0"


def mutual_information(df: DataFrame, cols: list[str], label: str = "label", bins: int = 10,
                       quantiles: bool = False, accuracy: int = 10_000) -> DataFrame:
    """Mutual information with the label (in nats) over bins of equal width or between quantiles.

    Quantiles come from mergeable sketches, one for each column in one pass, with a rank error of at
    most 1 / accuracy. Counts are combined per task before the shuffle, which carries at most
    features x bins x classes rows each."""
    if quantiles:
        at = F.array(*[F.lit(i / bins) for i in range(1, bins)])
        lim = df.agg(*[F.percentile_approx(F.col(c).cast("double"), at, accuracy).alias(c) for c in cols]).first()
        bin_of = {c: quantile_bin(c, [float(x) for x in lim[c] or ()]) for c in cols}
    else:
        lim = df.agg(*[F.min(c).alias(f"lo_{c}") for c in cols], *[F.max(c).alias(f"hi_{c}") for c in cols]).first()
        bin_of = {c: equal_width_bin(c, float(lim[f"lo_{c}"]), float(lim[f"hi_{c}"]), bins) for c in cols}
    pairs = ", ".join(f"named_struct('feature', '{c}', 'bin', {bin_of[c]})" for c in cols)
    n = df.select(label, F.explode(F.expr(f"array({pairs})")).alias("p")).groupBy(
        "p.feature", "p.bin", label).agg(F.count("*").cast("double").alias("c"))
    w = Window.partitionBy("feature")
    t = F.sum("c").over(w)
    px = F.sum("c").over(Window.partitionBy("feature", "bin"))
    py = F.sum("c").over(Window.partitionBy("feature", label))
    return n.withColumn("term", F.col("c") / t * F.log(F.col("c") * t / (px * py))).groupBy(
        "feature").agg(F.sum("term").alias("mutual_info"))


def best_columns(df: DataFrame, cols: list[str], k: int, by: str = "anova") -> list[str]:
    """The k columns with the largest ANOVA F or mutual information, in the order of ``cols``."""
    if by == "anova":
        names = select_top(anova_f(df, cols), "f_value", k)
    else:
        names = select_top(mutual_information(df, cols, quantiles=True), "mutual_info", k)
    return [c for c in cols if c in set(names)]


def rf_importance(train: DataFrame, cols: list[str], trees: int = 200, seed: int = 42) -> list:
    model = RandomForestClassifier(numTrees=trees, seed=seed, labelCol="label").fit(
        assemble(cols).transform(train))
    return sorted(zip(cols, model.featureImportances.toArray().tolist()),
                  key=lambda x: (-x[1], x[0]))


def select_rf(train: DataFrame, cols: list[str], threshold: float = 0.01, trees: int = 200):
    return [c for c, v in rf_importance(train, cols, trees) if v >= threshold]


def select_rfe(train: DataFrame, cols: list[str], n: int = 30, step: int = 5,
               trees: int = 100) -> list[str]:
    """Drop the ``step`` least important features until ``n`` are left."""
    left = list(cols)
    while len(left) > n:
        ranked = rf_importance(train, left, trees)
        drop = {c for c, _ in ranked[-min(step, len(left) - n):]}
        left = [c for c in left if c not in drop]
    return left


# --- training ------------------------------------------------------------------------------------
def balanced_weights(train: DataFrame, label: str = "label") -> DataFrame:
    """``weight`` = n / (2 * class size)."""
    counts = {r[label]: r["n"] for r in train.groupBy(label).agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    expr = F.lit(1.0)
    for k, n in counts.items():
        expr = F.when(F.col(label) == k, total / (len(counts) * n)).otherwise(expr)
    return train.withColumn("weight", expr)


def trainers(n_features: int, trees: int = 200, boost_rounds: int = 200, epochs: int = 100) -> dict:
    """The estimators with their reference settings."""
    return {
        "random_forest": RandomForestClassifier(numTrees=trees, maxDepth=15, minInstancesPerNode=4,
                                                weightCol="weight", seed=42),
        # three boosting trainers: depth 8 on plain rows, depth 10 and 15 on balanced ones
        "gradient_boosting": GBTClassifier(maxIter=boost_rounds, maxDepth=8, stepSize=0.1, seed=42,
                                           validationIndicatorCol="is_validation"),
        "boosting_depth_10": GBTClassifier(maxIter=boost_rounds, maxDepth=10, stepSize=0.1, seed=42,
                                           weightCol="weight", validationIndicatorCol="is_validation"),
        "boosting_depth_15": GBTClassifier(maxIter=boost_rounds, maxDepth=15, stepSize=0.1, seed=42,
                                           weightCol="weight", validationIndicatorCol="is_validation"),
        "logistic_regression": LogisticRegression(maxIter=1000, weightCol="weight"),
        "neural_network": MultilayerPerceptronClassifier(layers=[n_features, 128, 64, 32, 2],
                                                         maxIter=epochs, blockSize=32, seed=42),
    }


VALIDATION_PERCENT = 10


def train(name: str, data: DataFrame, cols: list[str], scale: bool | None = None, select: int | None = None,
          select_by: str = "anova", **sizes) -> PipelineModel:
    """Fit one estimator; features are standardised for the linear and neural models.

    With ``select`` only the best columns of the training side enter, and the model names them
    (``model_columns``). Boosting holds back a tenth of the rows, equal feature rows together, and
    stops when a round no longer lowers their loss, so the number of rounds is an upper limit."""
    if select:
        cols = best_columns(data, cols, select, select_by)
    scale = name in ("logistic_regression", "neural_network") if scale is None else scale
    front = scaler(cols).getStages() if scale else [assemble(cols)]
    rows = balanced_weights(data)
    if "boosting" in name:
        rows = rows.withColumn("is_validation", F.pmod(F.xxhash64(*cols), F.lit(100)) < VALIDATION_PERCENT)
    return Pipeline(stages=[*front, trainers(len(cols), **sizes)[name]]).fit(rows)


def model_columns(model: PipelineModel) -> list[str]:
    """The columns that a fitted model reads."""
    return model.stages[0].getInputCols()


def explain_trees(model: PipelineModel, df: DataFrame, k: int = 5) -> tuple[float, DataFrame]:
    """Base value, and df with the model's ``probability``, its ``parts`` (one per column of the model) and the ``k`` largest
    as ``top_features``, from the paths through a fitted tree ensemble."""
    cols = model_columns(model)
    base, rows = contributions(model.stages[-1], df, cols, df.columns)
    return base, explain(rows, {c: f"parts[{i}]" for i, c in enumerate(cols)}, k)


def probability(model: PipelineModel, df: DataFrame, keep=("url_id", "label")) -> DataFrame:
    return model.transform(df).select(
        *keep, vector_to_array("probability")[1].alias("probability"))


def vote(models: dict[str, PipelineModel], df: DataFrame, keep=("url_id", "label")) -> DataFrame:
    """Soft vote: mean probability of two or more models, added column by column (no join)."""
    if len(models) < 2:
        raise ValueError("a vote needs at least two models")
    names = []
    for i, m in enumerate(models.values()):
        made = {"raw", "features", "rawPrediction", "probability", "prediction"}
        df = m.transform(df).withColumn(f"p_{i}", vector_to_array("probability")[1])
        df = df.drop(*made)
        names.append(f"p_{i}")
    mean = reduce(lambda a, b: a + b, [F.col(n) for n in names]) / len(names)
    return df.select(*keep, mean.alias("probability"))


def classify(pred: DataFrame) -> DataFrame:
    """Class and confidence from the probability."""
    return add(pred, predicted_class="CASE WHEN probability > 0.7 THEN 'malicious' "
                                     "WHEN probability < 0.3 THEN 'benign' ELSE 'suspicious' END",
               confidence="CASE WHEN probability < 0.3 THEN 1 - probability ELSE probability END")


# --- evaluation ----------------------------------------------------------------------------------
SLICES = 256


def score_steps(pred: DataFrame, by: str = "model_name") -> DataFrame:
    """Per model and distinct score, from high to low: positives and negatives at and above it.

    The running sums are taken in two levels, within score slices and over the slice totals, so no
    task sees all scores of a model. Slice limits are quantiles of the distinct scores, read once
    (255 numbers) and used as literals.
    """
    ladder = pred.groupBy(by, "probability").agg(
        F.sum(F.when(F.col("label") == 1, 1).otherwise(0)).alias("pos"),
        F.sum(F.when(F.col("label") == 1, 0).otherwise(1)).alias("neg"))
    probs = [i / SLICES for i in range(1, SLICES)]
    limits = sorted(set(ladder.approxQuantile("probability", probs, 0.001)))
    arr = "array(" + ", ".join(f"{x!r}D" for x in limits) + ")" if limits else \
        "cast(array() as array<double>)"
    ladder = add(ladder, slice=f"size(filter({arr}, b -> b < probability))")
    totals = ladder.groupBy(by, "slice").agg(F.sum("pos").alias("sp"), F.sum("neg").alias("sn"))
    above = Window.partitionBy(by).orderBy(F.desc("slice")).rowsBetween(
        Window.unboundedPreceding, -1)
    everything = Window.partitionBy(by)
    totals = totals.select(
        by, "slice", F.coalesce(F.sum("sp").over(above), F.lit(0)).alias("ap"),
        F.coalesce(F.sum("sn").over(above), F.lit(0)).alias("an"),
        F.sum("sp").over(everything).alias("n_pos"), F.sum("sn").over(everything).alias("n_neg"))
    inside = Window.partitionBy(by, "slice").orderBy(F.desc("probability")).rowsBetween(
        Window.unboundedPreceding, 0)
    df = ladder.withColumn("cp", F.sum("pos").over(inside)).withColumn(
        "cn", F.sum("neg").over(inside)).join(totals, [by, "slice"])
    return df.selectExpr(by, "probability", "pos", "neg", "n_pos", "n_neg", "cp + ap AS tp",
                         "cn + an AS fp")


def roc_points(pred: DataFrame, by: str = "model_name") -> DataFrame:
    return score_steps(pred, by).selectExpr(
        by, "probability AS threshold", "fp / cast(n_neg as double) AS fpr",
        "tp / cast(n_pos as double) AS tpr")


def evaluate(pred: DataFrame, by: str = "model_name") -> DataFrame:
    """Accuracy, precision, recall, F1, ROC-AUC and the confusion matrix per model."""
    hit = F.col("probability") > 0.5
    pos = F.col("label") == 1
    m = pred.groupBy(by).agg(
        F.count_if(~hit & ~pos).alias("tn"), F.count_if(hit & ~pos).alias("fp"),
        F.count_if(~hit & pos).alias("fn"), F.count_if(hit & pos).alias("tp"))
    auc = score_steps(pred, by).groupBy(by).agg(
        F.sum(F.expr("pos * (n_neg - fp + neg / 2D)")).alias("u"), F.max("n_pos").alias("p"),
        F.max("n_neg").alias("n"))
    df = add(m.join(auc, by), roc_auc="CASE WHEN p = 0 OR n = 0 THEN 0.5D ELSE "
                                      "u / (cast(p as double) * n) END")
    df = add(df, accuracy="(tp + tn) / cast(tp + tn + fp + fn as double)",
             precision="CASE WHEN tp + fp = 0 THEN 0D ELSE tp / cast(tp + fp as double) END",
             recall="CASE WHEN tp + fn = 0 THEN 0D ELSE tp / cast(tp + fn as double) END",
             f1_score="CASE WHEN tp = 0 THEN 0D ELSE 2D * tp / (2D * tp + fp + fn) END")
    return df.select(by, "accuracy", "precision", "recall", "f1_score", "roc_auc", "tn", "fp",
                     "fn", "tp")


def compare(metrics: DataFrame, by: str = "model_name") -> DataFrame:
    """Models by falling F1, the best one marked. One row per model: a small frame."""
    w = Window.orderBy(F.desc("f1_score"), by)
    return metrics.select("*", F.row_number().over(w).alias("place")).withColumn(
        "is_best", F.col("place") == 1)


# --- model store ---------------------------------------------------------------------------------
def save_model(spark: SparkSession, model: PipelineModel, name: str, path: str, version: str,
               features: list[str], all_features: list[str]) -> None:
    model.write().overwrite().save(f"{path}/v_{version}/{name}")
    meta = {"version": version, "name": name, "selected_features": features,
            "all_features": all_features, "n_selected": len(features),
            "n_total": len(all_features), "split_method": "whole domains by hash"}
    spark.createDataFrame([(name, version, json.dumps(meta))],
                          "name string, version string, meta string").coalesce(1).write.mode(
        "append").json(f"{path}/index")


def latest_model(spark: SparkSession, path: str, name: str | None = None):
    """(model, metadata) of the newest version; random forests are preferred."""
    rows = spark.read.schema("name string, version string, meta string").json(f"{path}/index")
    if name:
        rows = rows.where(F.col("name") == name)
    top = rows.orderBy((F.col("name") != "random_forest"), F.desc("version"),
                       F.desc("name")).first()
    if top is None:
        return None
    return PipelineModel.load(f"{path}/v_{top.version}/{top.name}"), json.loads(top.meta)


# --- explanation -----------------------------------------------------------------------------------
def describe(name: str) -> tuple[str, str]:
    return C.FEATURE_DESCRIPTIONS.get(
        name, (name.replace("_", " ").title(), "Contributes to the prediction"))


def _entries(impacts: dict[str, str]) -> str:
    rows = []
    for i, (f, sql) in enumerate(impacts.items()):
        d, r = describe(f)
        rows.append(f"named_struct('neg', -abs({sql}), 'pos', {i}, 'feature', {lit(f)}, 'impact', "
                    f"{sql}, 'value', cast({f} as double), 'description', {lit(d)}, "
                    f"'reason', {lit(r)})")
    return "array(" + ", ".join(rows) + ")"


def explain(features: DataFrame, impacts: dict[str, str], k: int = 5,
            skip_zero: bool = False) -> DataFrame:
    """``top_features``: the ``k`` largest signed impacts of a row, by size."""
    arr = _entries(impacts)
    if skip_zero:
        arr = f"filter({arr}, e -> e.impact <> 0)"
    return add(features, top_features=f"""transform(slice(array_sort({arr}), 1, {k}), e ->
        named_struct('feature', e.feature, 'description', e.description, 'impact', e.impact,
          'direction', CASE WHEN e.impact > 0 THEN 'increases_risk' ELSE 'decreases_risk' END,
          'reason', e.reason, 'feature_value', e.value))""")


def linear_impacts(coefs: dict[str, float], means: dict[str, float] | None = None) -> dict:
    means = means or {}
    return {f: f"({c!r}D * (cast({f} as double) - {float(means.get(f, 0.0))!r}D))"
            for f, c in coefs.items()}


def fitted_impacts(model: PipelineModel, cols: list[str]) -> tuple[float, dict]:
    """Log odds at the mean of the training side, and each feature's share of a row's distance from
    it, from a fitted logistic regression on standardised features."""
    last, scale = model.stages[-1], model.stages[-2]
    weights = zip(cols, last.coefficients.toArray(), scale.mean.toArray(), scale.std.toArray())
    parts = {c: (float(w / d) if d > 0 else 0.0, float(m)) for c, w, m, d in weights}
    return float(last.intercept), linear_impacts({c: w for c, (w, _) in parts.items()},
                                                 {c: m for c, (_, m) in parts.items()})


def fallback_impacts(names: list[str]) -> dict:
    """Without a usable model a feature's own value stands for its impact."""
    return {f: f"cast({f} as double)" for f in names}


def explain_global(features: DataFrame, impacts: dict[str, str], k: int = 10) -> DataFrame:
    """Mean absolute impact per feature: one wide aggregate, unpivoted afterwards."""
    one = features.agg(*[F.avg(F.expr(f"abs({sql})")).alias(f) for f, sql in impacts.items()])
    stack = ", ".join(f"{lit(f)}, {lit(describe(f)[0])}, {f}" for f in impacts)
    long = one.select(F.expr(f"stack({len(impacts)}, {stack}) AS (feature, description, "
                             "importance)"))
    return long.orderBy(F.desc("importance"), "feature").limit(k)


def narrative(explained: DataFrame, n_risk: int = 4, n_safe: int = 3) -> DataFrame:
    """A sentence from ``prediction``, ``confidence`` and ``top_features``, with the first ``n_risk``
    features that raise the score and the first ``n_safe`` that lower it."""
    def part(direction, n, words):
        chosen = f"slice(filter(top_features, f -> f.direction = '{direction}'), 1, {n})"
        each = "concat(f.description, ' by ', format_string('%.1f', floor(abs(f.impact) * 1000 + 0.5D) / 10D))"
        return (f"CASE WHEN exists(top_features, f -> f.direction = '{direction}') THEN concat(' {words}: ', "
                f"array_join(transform({chosen}, f -> {each}), '; '), '.') ELSE '' END")
    return add(explained, narrative=f"""concat('Verdict ', prediction, ', certainty ',
        cast(round(confidence * 100) as bigint), ' of 100.', {part('increases_risk', n_risk, 'Raising the score')},
        {part('decreases_risk', n_safe, 'Lowering it')})""")
