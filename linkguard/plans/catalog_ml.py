"""Checked queries: model preparation, selection, training, evaluation and explanation."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from linkguard.functions.sqlutil import items
from linkguard.functions.trees import contributions
from linkguard.operators import ml as M, normalize as N, url_features as U
from linkguard.plans import scan as S
from linkguard.plans.oracle_ctes import CTES, fuse_ctes, half_up
from linkguard.plans.registry import query
from linkguard.plans.views import Tables
from linkguard.shared import shared_folder

FEATS = U.URL_FEATURES


def labelled(t: Tables) -> DataFrame:
    """Feature rows with label and registered domain (host for IP URLs)."""
    rows = t.urls_v.where("is_malicious IS NOT NULL").select("url_id", "full_url", "is_malicious")
    norm = N.url_normalize(rows, keep=["is_malicious"]).withColumn(
        "domain", F.expr("CASE WHEN registered_domain = '' THEN hostname "
                         "ELSE registered_domain END"))
    df = U.url_features(norm, keep=["domain", "is_malicious"])
    return df.withColumn("label", F.col("is_malicious").cast("int")).drop("is_malicious")


CTES["p_rows"] = """SELECT f.*, cast(is_malicious AS BIGINT) AS label,
    CASE WHEN registered_domain = '' THEN hostname ELSE registered_domain END AS domain
    FROM c_features f JOIN urls_v USING (url_id)
    JOIN (SELECT url_id, registered_domain, hostname FROM c_norm) n USING (url_id)
    WHERE is_malicious IS NOT NULL"""
CTES["p_split"] = """SELECT *, ('0x' || substr(md5(domain || ':42'), 1, 8))::BIGINT % 100 < 20
    AS is_test FROM p_rows"""

DIRTY = """SELECT event_id, CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN cast('NaN' AS double)
    WHEN 2 THEN cast('Infinity' AS double) ELSE value END AS x, 7.0 AS fixed,
    cast(user_id AS double) AS y FROM events"""


@query("ml_clean", f"""SELECT event_id, CASE WHEN x IS NULL OR isnan(x) OR isinf(x) THEN 0 ELSE x END
    AS x, y FROM ({DIRTY})""")
def _(t):
    df = M.clean(t.sql(DIRTY), ["x", "fixed", "y"])
    return df.select("event_id", *M.varying_columns(df, ["x", "fixed", "y"]))


@query("ml_group_split", "SELECT url_id, domain, is_test FROM p_split")
def _(t):
    return M.group_split(labelled(t)).select("url_id", "domain", "is_test")


@query("ml_leakage_check", """SELECT count(*) FILTER (NOT is_test) AS train_rows,
    count(*) FILTER (is_test) AS test_rows,
    count(*) FILTER (NOT is_test AND label = 1) AS train_malicious,
    count(*) FILTER (is_test AND label = 1) AS test_malicious,
    count(DISTINCT domain) FILTER (NOT is_test) AS train_groups,
    count(DISTINCT domain) FILTER (is_test) AS test_groups, 0 AS shared_groups FROM p_split""")
def _(t):
    return M.leakage_report(M.group_split(labelled(t)))


@query("ml_duplicates", f"""SELECT cast(sum(n) AS BIGINT) AS rows, count(*) AS distinct_rows,
    count(*) FILTER (a <> b) AS in_both_sides FROM (SELECT count(*) AS n, bool_and(is_test) AS a,
      bool_or(is_test) AS b FROM p_split GROUP BY {', '.join(FEATS)})""")
def _(t):
    return M.duplicate_report(M.group_split(labelled(t)), FEATS)


_STATS = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, {c}::DOUBLE AS x, label FROM p_split WHERE NOT is_test" for c in FEATS)


def training_side(t: Tables) -> DataFrame:
    return M.group_split(labelled(t)).where("NOT is_test")



ANOVA = f"""SELECT feature, CASE WHEN within > 1e-9 THEN
    round((between / (k - 1)) / (within / (n - k)), 4) END AS f_value FROM (
      SELECT feature, sum(n) AS n, count(*) AS k, sum(n * (m - g) * (m - g)) AS between,
        sum(v * n) AS within FROM (
          SELECT feature, label, count(*) AS n, avg(x) AS m, var_pop(x) AS v,
            any_value(g) AS g FROM (SELECT *, avg(x) OVER (PARTITION BY feature) AS g
              FROM ({_STATS})) GROUP BY 1, 2) GROUP BY 1)"""


@query("ml_select_anova", ANOVA)
def _(t):
    df = M.anova_f(training_side(t), FEATS)
    return df.select("feature", F.round("f_value", 4).alias("f_value"))


@query("ml_select_mutual_info", f"""SELECT feature, round(sum(c / t * ln(c * t / (px * py))), 6)
      AS mutual_info FROM (
    SELECT *, sum(c) OVER (PARTITION BY feature) AS t, sum(c) OVER (PARTITION BY feature, bin) AS px,
      sum(c) OVER (PARTITION BY feature, label) AS py FROM (
      SELECT feature, label, CASE WHEN hi > lo THEN least(floor((x - lo) / (hi - lo) * 10), 9)
          ELSE 0 END AS bin, count(*)::DOUBLE AS c
      FROM (SELECT *, min(x) OVER (PARTITION BY feature) AS lo, max(x) OVER (PARTITION BY feature)
              AS hi FROM ({_STATS})) GROUP BY ALL)) GROUP BY 1""")
def _(t):
    return M.mutual_information(training_side(t), FEATS).select(
        "feature", F.round("mutual_info", 6).alias("mutual_info"))


_LIMITS = ", ".join(f"quantile_disc(x, {i / 10}) AS q{i}" for i in range(1, 10))
_BELOW = "len(list_filter(list_distinct([" + ", ".join(f"q{i}" for i in range(1, 10)) + "]), lambda q: x > q))"


@query("ml_select_mutual_info_quantiles", f"""SELECT feature, round(sum(c / t * ln(c * t / (px * py))), 6)
      AS mutual_info FROM (
    SELECT *, sum(c) OVER (PARTITION BY feature) AS t, sum(c) OVER (PARTITION BY feature, bin) AS px,
      sum(c) OVER (PARTITION BY feature, label) AS py FROM (
      SELECT feature, label, {_BELOW} AS bin, count(*)::DOUBLE AS c
      FROM ({_STATS}) JOIN (SELECT feature, {_LIMITS} FROM ({_STATS}) GROUP BY 1) USING (feature) GROUP BY ALL)) GROUP BY 1""")
def _(t):
    return M.mutual_information(training_side(t), FEATS, quantiles=True).select(
        "feature", F.round("mutual_info", 6).alias("mutual_info"))


#: Columns that the selecting trainer keeps.
TOP = 20


@query("ml_select_train", f"""SELECT feature FROM ({ANOVA}) ORDER BY f_value DESC NULLS LAST, feature LIMIT {TOP}""")
def _(t):
    """The columns of a stored model that was trained on the best ones, as read back."""
    path = shared_folder(t.spark, "models")
    model = M.train("random_forest", sides(t)[0], FEATS, select=TOP, trees=20)
    M.save_model(t.spark, model, "random_forest", path, "1", M.model_columns(model), FEATS)
    again, meta = M.latest_model(t.spark, path)
    names = [c for c in M.model_columns(again) if c in meta["selected_features"]]
    return t.spark.createDataFrame([(c,) for c in names], "feature string")


# --- training on all URL features -----------------------------------------------------------------
# What a fitted model says has no SQL counterpart. The queries report facts about it that have one: rows scored, whether the
# confusion matrix accounts for all of them, whether metrics agree with those computed from the scores anew, whether scores
# are probabilities, and whether the model is better than a floor.
# All trainers run with their full settings; boosting stops by itself on rows that it holds back.
FLOOR = 0.9


def sides(t: Tables):
    """Training and test side, written once."""
    path = shared_folder(t.spark, "sides")
    M.clean(M.group_split(labelled(t)), FEATS).select("url_id", "label", "is_test", *FEATS).write.parquet(path)
    df = t.spark.read.parquet(path)
    return df.where("NOT is_test"), df.where("is_test")


@query("ml_scale", " UNION ALL ".join(f"""SELECT '{c}' AS feature, round(avg({c}), 6) AS mean,
    round(stddev_samp({c}), 6) AS std FROM p_split WHERE NOT is_test""" for c in FEATS))
def _(t):
    tr, _ = sides(t)
    fitted = M.scaler(FEATS).fit(tr).stages[-1]
    rows = list(zip(FEATS, fitted.mean.toArray().tolist(), fitted.std.toArray().tolist()))
    return t.spark.createDataFrame(rows, "feature string, mean double, std double").select(
        "feature", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query("ml_scale_rows", "SELECT url_id, " + ", ".join(
    f"round(CASE WHEN s_{c} > 0 THEN (p.{c} - m_{c}) / s_{c} ELSE 0 END, 4)::DOUBLE AS {c}" for c in FEATS)
    + " FROM p_split p, (SELECT " + ", ".join(f"avg({c}) AS m_{c}, stddev_samp({c}) AS s_{c}" for c in FEATS)
    + " FROM p_split WHERE NOT is_test) WHERE is_test")
def _(t):
    from pyspark.ml.functions import vector_to_array
    tr, te = sides(t)
    out = M.scaler(FEATS).fit(tr).transform(te).select("url_id", vector_to_array("features").alias("f"))
    return out.select("url_id", *[F.round(F.col("f")[i], 4).alias(c) for i, c in enumerate(FEATS)])


def picked(t: Tables, names: list[str], most: int) -> DataFrame:
    """How a selection looks: known features, each once, no more than asked for, some of them useful."""
    return t.spark.createDataFrame([(set(names) <= set(FEATS), len(set(names)) == len(names), 0 < len(names) <= most)],
                                   "known boolean, distinct_names boolean, right_size boolean")


@query("ml_select_rf_importance", "SELECT true AS known, true AS distinct_names, true AS right_size")
def _(t):
    return picked(t, M.select_rf(sides(t)[0], FEATS), len(FEATS) - 1)


@query("ml_select_rfe", "SELECT true AS known, true AS distinct_names, true AS right_size")
def _(t):
    names = M.select_rfe(sides(t)[0], FEATS)
    return picked(t, names if len(names) == 30 else [], 30)


def facts(scores: DataFrame) -> DataFrame:
    """Per model: what must hold of its scores and metrics."""
    hit = (F.col("probability") > 0.5).cast("int")
    plain = scores.groupBy("model_name").agg(
        F.count("*").alias("rows"), F.sum("label").alias("positives"),
        F.avg((hit == F.col("label")).cast("double")).alias("again"),
        F.every(F.col("probability").between(0, 1)).alias("in_range"))
    return M.evaluate(scores).join(plain, "model_name").selectExpr(
        "model_name", "rows", "positives", "in_range", "tn + fp + fn + tp = rows AND tp + fn = positives AS complete",
        f"abs(again - accuracy) < 1e-9 AS agrees", f"roc_auc >= {FLOOR} AS good")


def facts_sql(*names: str) -> str:
    return " UNION ALL ".join(f"""SELECT '{n}' AS model_name, count(*) AS rows, cast(sum(label) AS BIGINT) AS positives,
    true AS in_range, true AS complete, true AS agrees, true AS good FROM p_split WHERE is_test""" for n in names)


def scored(t: Tables, *names: str) -> DataFrame:
    """Scores of the test side by each model, written once so that nothing runs a model again."""
    tr, te = sides(t)
    path = shared_folder(t.spark, "scores")
    for n in names:
        M.probability(M.train(n, tr, FEATS), te).withColumn("model_name", F.lit(n)).write.mode("append").parquet(path)
    return t.spark.read.parquet(path)


for _key, _model in [("ml_train_rf", "random_forest"), ("ml_train_gbt", "gradient_boosting"),
                     ("ml_train_logreg", "logistic_regression"),
                     ("ml_train_mlp", "neural_network")]:
    @query(_key, facts_sql(_model))
    def _(t, _model=_model):
        return facts(scored(t, _model))


CTES["ph_split"] = "SELECT * FROM p_split WHERE url_id IN (SELECT url_id FROM h_features)"


@query("ml_train_full", facts_sql("random_forest").replace("p_split", "ph_split"))
def _(t):
    """A forest on the best half of the columns of the whole feature table: URL, DNS, WHOIS, address, geo and traffic."""
    from linkguard.operators import assemble as H
    from linkguard.plans.catalog_intel import feature_table
    rows = feature_table(t).select("url_id", *H.FEATURES).join(labelled(t).select("url_id", "label", "domain"), "url_id")
    path = shared_folder(t.spark, "full")
    M.clean(M.group_split(rows), H.FEATURES).write.parquet(path)
    df = t.spark.read.parquet(path)
    tr, te = df.where("NOT is_test"), df.where("is_test")
    model = M.train("random_forest", tr, H.FEATURES, select=len(H.FEATURES) // 2)
    M.probability(model, te).withColumn("model_name", F.lit("random_forest")).write.parquet(f"{path}-scores")
    return facts(t.spark.read.parquet(f"{path}-scores"))


BOOSTERS = ("gradient_boosting", "boosting_depth_10", "boosting_depth_15")


@query("ml_train_boosting", facts_sql(*BOOSTERS))
def _(t):
    """The three boosting trainers, each with early stopping."""
    return facts(scored(t, *BOOSTERS))


VOTERS = ("random_forest", "gradient_boosting", "logistic_regression")


@query("ml_vote", facts_sql("vote"))
def _(t):
    """The network does not vote."""
    tr, te = sides(t)
    models = {n: M.train(n, tr, FEATS) for n in VOTERS}
    path = shared_folder(t.spark, "votes")
    M.vote(models, te).withColumn("model_name", F.lit("vote")).write.parquet(path)
    return facts(t.spark.read.parquet(path))


@query("ml_compare", "SELECT 4 AS models, 1 AS best, true AS in_order, 10 AS place_sum")
def _(t):
    got = M.compare(M.evaluate(scored(t, *VOTERS, "neural_network")))
    top = got.agg(F.count("*").alias("models"), F.count_if("is_best").alias("best"),
                  F.max(F.when(F.col("is_best"), F.col("f1_score"))).alias("b"), F.max("f1_score").alias("m"),
                  F.sum("place").alias("place_sum"))
    return top.selectExpr("models", "best", "b = m AS in_order", "place_sum")


@query("ml_predict", """SELECT url_id, true AS right_score, true AS right_class FROM p_split WHERE is_test""")
def _(t):
    """Scores and classes of a forest against those from walking its exported nodes."""
    tr, te = sides(t)
    model = M.train("random_forest", tr, FEATS)
    _, walked = contributions(model.stages[-1], te, FEATS, ["url_id"])
    mine = M.classify(walked.drop("parts")).selectExpr("url_id", "probability AS walked", "predicted_class AS walked_class")
    return M.classify(M.probability(model, te, ("url_id",))).join(mine, "url_id").selectExpr(
        "url_id", "abs(probability - walked) < 1e-9 AS right_score", "predicted_class = walked_class AS right_class")


@query("ml_explain_trees", """SELECT 'boosted' AS kind, url_id, true AS adds_up, 5 AS places FROM p_split WHERE is_test
    UNION ALL SELECT 'forest', url_id, true, 5 FROM p_split WHERE is_test""")
def _(t):
    """Contributions along the paths of fitted trees: with the base they add up to the model's own score."""
    tr, te = sides(t)
    out = None
    for kind, name in (("boosted", "gradient_boosting"), ("forest", "random_forest")):
        model = M.train(name, tr, FEATS)
        base, rows = M.explain_trees(model, te.select("url_id", *FEATS))
        total = f"aggregate(parts, {base!r}D, (s, x) -> s + x)"
        score = f"1 / (1 + exp(-2 * {total}))" if kind == "boosted" else total
        own = M.probability(model, te, ("url_id",)).withColumnRenamed("probability", "own")
        rows = rows.join(own, "url_id").selectExpr(
            f"'{kind}' AS kind", "url_id", f"abs({score} - own) < 1e-9 AND abs(probability - own) < 1e-9 AS adds_up",
            "size(top_features) AS places")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("ml_model_store", """SELECT '2' AS version, count(*) AS rows, 0.0::DOUBLE AS difference FROM p_split WHERE is_test""")
def _(t):
    tr, te = sides(t)
    path = shared_folder(t.spark, "models")
    model = M.train("logistic_regression", tr, FEATS)
    for version in ("1", "2"):
        M.save_model(t.spark, model, "logistic_regression", path, version, FEATS, FEATS)
    again, meta = M.latest_model(t.spark, path)
    both = M.probability(model, te, ("url_id",)).join(
        M.probability(again, te, ("url_id",)).withColumnRenamed("probability", "stored"), "url_id")
    return both.agg(F.lit(meta["version"]).alias("version"), F.count("*").alias("rows"),
                    F.max(F.abs(F.col("probability") - F.col("stored"))).alias("difference"))


@query("ml_explain_model", """SELECT url_id, true AS adds_up, 5 AS places FROM p_split WHERE is_test""")
def _(t):
    """Impacts of a fitted linear model: with its base they must add up to the model's own log odds."""
    tr, te = sides(t)
    model = M.train("logistic_regression", tr, FEATS)
    base, impacts = M.fitted_impacts(model, FEATS)
    own = M.explain(M.probability(model, te, ("url_id", *FEATS)), impacts)
    total = F.expr(" + ".join(impacts.values())) + base
    return own.select("url_id", (F.abs(1 / (1 + F.exp(-total)) - F.col("probability")) < 1e-9).alias("adds_up"),
                      F.size("top_features").alias("places"))


# stored scores as the model's signal of a scan
STORED = """SELECT url_id, max(prediction_score) AS ml_probability FROM predictions_v GROUP BY url_id"""
CTES["sm_signals"] = f"""SELECT r.*, ml_probability::DOUBLE * 100 AS ml_score, NULL::DOUBLE AS ip_score,
    CASE WHEN highest_risk > 0 THEN highest_risk::DOUBLE END AS domain_score,
    NULL::DOUBLE AS threat_score FROM s_rules r LEFT JOIN ({STORED}) USING (url_id)"""
CTES |= fuse_ctes("sm_", "sm_signals")


@query("scan_batch_ml", f"SELECT url_id, prediction, verdict, {half_up('risk_score', 2)} AS risk_score FROM sm_fused")
def _(t):
    ml = t.predictions_v.groupBy("url_id").agg(F.max("prediction_score").cast("double").alias("ml_probability"))
    fused = S.scan_batch(t.url_corpus, ml=ml)
    return fused.select("url_id", "prediction", "verdict", "risk_score")


# --- evaluation of stored scores ------------------------------------------------------------------
SCORES = """SELECT prediction_id, model_name, prediction_score AS probability,
    cast(CASE WHEN prediction_id % 4 = 0 THEN prediction_score < 0.5 ELSE prediction_score > 0.55 END
      AS int) AS label FROM predictions_v"""
CTES["p_scores"] = SCORES
CTES["p_eval"] = """SELECT model_name, count(*) FILTER (probability <= 0.5 AND label = 0) AS tn,
    count(*) FILTER (probability > 0.5 AND label = 0) AS fp,
    count(*) FILTER (probability <= 0.5 AND label = 1) AS fn,
    count(*) FILTER (probability > 0.5 AND label = 1) AS tp FROM p_scores GROUP BY 1"""
CTES["p_auc"] = """SELECT model_name, (sum(rk) FILTER (label = 1) - np * (np + 1) / 2) / (np * nn)
      AS roc_auc FROM (SELECT model_name, label, count(*) FILTER (label = 1) OVER w AS np,
        count(*) FILTER (label = 0) OVER w AS nn,
        rank() OVER (PARTITION BY model_name ORDER BY probability) +
          (count(*) OVER (PARTITION BY model_name, probability) - 1) / 2 AS rk
      FROM p_scores WINDOW w AS (PARTITION BY model_name)) GROUP BY model_name, np, nn"""
CTES["p_metrics"] = """SELECT model_name, tn, fp, fn, tp,
    round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy, round(tp / (tp + fp), 6) AS precision,
    round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1_score,
    round(roc_auc, 6) AS roc_auc FROM p_eval JOIN p_auc USING (model_name)"""
METRICS = ["accuracy", "precision", "recall", "f1_score", "roc_auc"]


def stored_metrics(t: Tables) -> DataFrame:
    df = M.evaluate(t.sql(SCORES))
    return df.withColumns({c: F.round(c, 6) for c in METRICS})


@query("ml_evaluate", "SELECT * FROM p_metrics")
def _(t):
    return stored_metrics(t)


@query("ml_compare_stored", """SELECT model_name, f1_score, row_number() OVER (ORDER BY f1_score DESC,
    model_name) AS place FROM p_metrics""")
def _(t):
    return M.compare(stored_metrics(t)).select("model_name", "f1_score", "place")


@query("ml_roc_points", """SELECT DISTINCT model_name, probability AS threshold,
    round(count(*) FILTER (label = 0) OVER w / count(*) FILTER (label = 0) OVER a, 6) AS fpr,
    round(count(*) FILTER (label = 1) OVER w / count(*) FILTER (label = 1) OVER a, 6) AS tpr
    FROM p_scores WINDOW w AS (PARTITION BY model_name ORDER BY probability DESC
      RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY model_name)""")
def _(t):
    df = M.roc_points(t.sql(SCORES))
    return df.withColumns({c: F.round(c, 6) for c in ["fpr", "tpr"]})


@query("ml_predict_class", """SELECT prediction_id, CASE WHEN probability > 0.7 THEN 'malicious'
    WHEN probability < 0.3 THEN 'benign' ELSE 'suspicious' END AS predicted_class,
    round(CASE WHEN probability < 0.3 THEN 1 - probability ELSE probability END, 6) AS confidence
    FROM p_scores""")
def _(t):
    return M.classify(t.sql(SCORES)).select("prediction_id", "predicted_class",
                                            F.round("confidence", 6).alias("confidence"))


# --- explanation -------------------------------------------------------------------------------------
COEFS = {"url_length": 0.0021, "is_https": -0.37, "entropy": 0.0513, "suspicious_tld": 0.61,
         "subdomain_count": 0.081, "digit_ratio": 0.9, "url_depth": -0.0407, "unique_char_ratio": -0.11}


def _impacts(expr: str, names) -> str:
    out = []
    for i, f in enumerate(names):
        d, r = M.describe(f)
        e = expr.format(f=f, c=COEFS.get(f))
        q = "''"
        out.append(f"struct_pack(neg := -abs({e}), pos := {i}, feature := '{f}', impact := {e}, "
                   f"description := '{d.replace(chr(39), q)}', reason := '{r.replace(chr(39), q)}')")
    return "[" + ", ".join(out) + "]"


LINEAR = _impacts("({c}::DOUBLE * {f}::DOUBLE)", COEFS)
CTES["p_linear"] = f"SELECT url_id, list_sort({LINEAR})[1:5] AS top FROM c_features"
CTES["p_plain"] = (f"SELECT url_id, list_sort(list_filter({_impacts('{f}::DOUBLE', COEFS)}, "
                   "lambda e: e.impact <> 0))[1:5] AS top FROM c_features")


def features(t: Tables) -> DataFrame:
    return U.url_features(N.url_normalize(t.url_corpus))


def top_rows(df: DataFrame) -> DataFrame:
    return df.select("url_id", F.posexplode(items("top_features")).alias("i", "f")).selectExpr(
        "url_id", "i + 1 AS place", "f.feature AS feature", "round(f.impact, 6) AS impact",
        "f.direction AS direction", "f.description AS description")


TOP_SQL = """SELECT url_id, i AS place, top[i].feature AS feature, round(top[i].impact, 6) AS impact,
    CASE WHEN top[i].impact > 0 THEN 'increases_risk' ELSE 'decreases_risk' END AS direction,
    top[i].description AS description
    FROM (SELECT *, unnest(range(1, len(top) + 1)) AS i FROM {})"""


@query("ml_explain_local", TOP_SQL.format("p_linear"))
def _(t):
    return top_rows(M.explain(features(t), M.linear_impacts(COEFS)))


@query("ml_explain_fallback", TOP_SQL.format("p_plain"))
def _(t):
    return top_rows(M.explain(features(t), M.fallback_impacts(list(COEFS)), skip_zero=True))


@query("ml_explain_global", "SELECT feature, description, round(importance, 6) AS importance FROM ("
       + " UNION ALL ".join(f"""SELECT '{f}' AS feature, '{M.describe(f)[0]}' AS description,
       avg(abs({c}::DOUBLE * {f})) AS importance FROM c_features""" for f, c in COEFS.items())
       + ") ORDER BY importance DESC, feature LIMIT 10")
def _(t):
    return M.explain_global(features(t), M.linear_impacts(COEFS)).withColumn(
        "importance", F.round("importance", 6))


def _part_sql(cond: str, n: int, words: str) -> str:
    chosen = f"list_filter(top, lambda e: {cond})[1:{n}]"
    each = "e.description || ' by ' || printf('%.1f', floor(abs(e.impact) * 1000 + 0.5) / 10)"
    return (f"CASE WHEN len(list_filter(top, lambda e: {cond})) > 0 THEN ' {words}: ' || "
            f"array_to_string(list_transform({chosen}, lambda e: {each}), '; ') || '.' ELSE '' END")


@query("ml_narrative", f"""SELECT url_id, 'Verdict ' || prediction || ', certainty ' || cast(round(confidence * 100) AS BIGINT)
      || ' of 100.' || {_part_sql('e.impact > 0', 4, 'Raising the score')} || {_part_sql('e.impact <= 0', 3, 'Lowering it')}
      AS narrative FROM p_linear JOIN s_fused USING (url_id)""")
def _(t):
    top = M.explain(features(t), M.linear_impacts(COEFS)).select("url_id", "top_features")
    verdicts = S.scan_batch(t.url_corpus).select("url_id", "prediction", "confidence")
    return M.narrative(top.join(verdicts, "url_id")).select("url_id", "narrative")
