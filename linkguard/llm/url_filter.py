"""URL filter: fixed rules first, gradient-boosted trees on lexical features for the rest.

A rule names a host and a path prefix. It fits a URL whose host is the rule's or below it and whose path starts with the
rule's path; the longest fitting rule decides. URLs that a rule decides are the labelled ones: boosted trees learn from a
bounded sample of the distinct ones (the first `SAMPLE` in the order of a hash, so the choice depends neither on the layout of
the table nor on how often a URL is repeated) and judge all URLs without a rule. `held_out_figures` learns from four fifths of
the labelled URLs and reports how well the trees tell the rest.

Features: length, depth, digit ratio, entropy, parameter counts, and statistics of the host's suffix (last label) among the
sampled labels. Words of the URL are not features.

Defined results: a null URL, or one without `://`, has empty host and path and fits no rule; the trees judge it by the
features of its text (null: those of the empty text). If the labelled URLs are all of one kind, or there are none, there is
nothing to learn and URLs without a rule are allowed. Repeated rows each give a row; extra input columns are ignored.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkguard.functions.sqlutil import count_char
from linkguard.operators.url_features import entropy

from .common import ascii_lower, stage

#: (verdict, host, path prefix)
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
         ("block", "net", "/es/"), ("block", "net", "/fr/")]
#: Labelled URLs that the trees are fitted on, at most.
SAMPLE = 20_000
#: Labels that a suffix needs before its own share counts as much as the overall share.
PRIOR = 20.0
LEXICAL = ["length", "host_length", "path_length", "depth", "labels", "digit_ratio", "hyphens", "entropy", "host_entropy",
           "params", "param_length", "has_fragment", "ends_in_slash", "has_extension"]
SUFFIX = ["suffix_share", "suffix_seen"]


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    return (F.coalesce(ascii_lower(F.regexp_extract(rest, "^([^/?#]*)", 1)), F.lit("")),
            F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit("")))


def fitting_rule(host: Column, path: Column, rules=None) -> Column:
    """The longest rule that fits, as struct(rule, verdict); null if none does."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules or RULES, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def features(urls: DataFrame) -> DataFrame:
    """Lexical features of columns url, host, path."""
    length = F.greatest(F.length("u"), F.lit(1)).cast("double")
    query = F.regexp_extract("u", "[?]([^#]*)", 1)
    return (urls.withColumn("u", F.coalesce("url", F.lit(""))).withColumn("q", query).withColumns({
        "length": F.length("u"), "host_length": F.length("host"), "path_length": F.length("path"),
        "depth": F.expr(count_char("path", "/")), "labels": F.expr(count_char("host", ".")),
        "digit_ratio": F.regexp_count("u", F.lit("[0-9]")) / length, "hyphens": F.expr(count_char("u", "-")),
        "entropy": F.expr(entropy("u")), "host_entropy": F.expr(entropy("host")),
        "params": F.when(F.col("q") == "", 0).otherwise(F.expr(count_char("q", "&")) + 1), "param_length": F.length("q"),
        "has_fragment": F.contains("u", F.lit("#")).cast("int"), "ends_in_slash": F.endswith("path", F.lit("/")).cast("int"),
        "has_extension": F.rlike("path", F.lit("[.][A-Za-z0-9]+$")).cast("int"),
        "suffix": F.substring_index("host", ".", -1)}).drop("u", "q"))


def _rows(pages: DataFrame, rules) -> DataFrame:
    url = F.col("url").cast("string")
    host, path = split_url(url)
    return pages.select("page_id", url.alias("url"), host.alias("host"), path.alias("path")) \
        .withColumn("hit", fitting_rule(F.col("host"), F.col("path"), rules)) \
        .select("page_id", "url", "host", "path", F.col("hit.rule").alias("rule"), F.col("hit.verdict").alias("verdict"))


def _labelled(rows: DataFrame) -> DataFrame:
    """url, host, path, label (1: block) of rows that a rule decides."""
    return rows.where("rule is not null").select("url", "host", "path", (F.col("verdict") == "block").cast("double").alias("label"))


def _fit(labelled: DataFrame, sample: int, rounds: int):
    """score(rows with url, host, path) -> rows with block_score and prediction; None if there is nothing to learn."""
    # what lies far above the sample's place is neither made distinct nor sorted
    many = labelled.agg(F.approx_count_distinct("url")).first()[0]
    share = min(1.0, 4.0 * sample / max(1, many))
    picked = labelled.withColumn("h", F.xxhash64("url")).where(F.col("h") / 2.0 ** 64 + 0.5 <= share).distinct() \
        .orderBy("h", "url").limit(sample).drop("h")
    train = stage(features(picked), "labelled")
    n, blocked = train.agg(F.count("*"), F.sum("label")).first()
    if not n or blocked in (0, n):
        return None
    seen = train.groupBy("suffix").agg(F.count("*").cast("double").alias("suffix_seen"), F.sum("label").alias("bad")) \
        .select("suffix", "suffix_seen", ((F.col("bad") + PRIOR * blocked / n) / (F.col("suffix_seen") + PRIOR))
                .alias("suffix_share"))
    seen = stage(seen, "suffixes")  # at most `sample` rows
    known = lambda df: df.join(F.broadcast(seen), "suffix", "left").fillna(
        {"suffix_seen": 0.0, "suffix_share": blocked / n})
    put = VectorAssembler(inputCols=LEXICAL + SUFFIX, outputCol="features")
    trees = GBTClassifier(maxIter=rounds, maxDepth=4, stepSize=0.2, seed=5, maxMemoryInMB=64, cacheNodeIds=False)
    model = trees.fit(put.transform(known(train)).select("features", "label"))
    return lambda rows: model.transform(put.transform(known(features(rows)))).withColumn(
        "block_score", vector_to_array("probability")[1])


def judge(pages: DataFrame, rules=None, sample: int = SAMPLE, rounds: int = 20) -> DataFrame:
    """page_id, host, path, rule, verdict, block_score (null where a rule decides)."""
    rows = _rows(pages, rules)
    plain = ["page_id", "host", "path", "rule"]
    score = _fit(_labelled(rows), sample, rounds)
    if score is None:
        return rows.select(*plain, F.coalesce("verdict", F.lit("allow")).alias("verdict"),
                           F.lit(None).cast("double").alias("block_score"))
    return score(rows.where("rule is null")).select(
        *plain, F.when(F.col("prediction") == 1, "block").otherwise("allow").alias("verdict"), "block_score").unionByName(
        rows.where("rule is not null").select(*plain, "verdict", F.lit(None).cast("double").alias("block_score")))


def held_out_figures(pages: DataFrame, rules=None, sample: int = SAMPLE, rounds: int = 20, folds: int = 5) -> dict:
    """n, accuracy, precision and recall of blocking, on distinct labelled URLs that the trees did not learn from."""
    labelled = _labelled(_rows(pages, rules))
    aside = F.coalesce(F.pmod(F.xxhash64(F.lit("fold"), "url"), F.lit(folds)) == 0, F.lit(False))
    score = _fit(labelled.where(~aside), sample, rounds)
    if score is None:
        return {"n": 0, "accuracy": None, "precision": None, "recall": None}
    said, is_ = F.col("prediction") == 1, F.col("label") == 1
    r = score(labelled.where(aside).distinct()).agg(
        F.count("*").alias("n"), F.count_if(said == is_).alias("right"), F.count_if(said & is_).alias("hit"),
        F.count_if(said).alias("said"), F.count_if(is_).alias("blocked")).first()
    part = lambda a, b: a / b if b else None
    return {"n": r.n, "accuracy": part(r.right, r.n), "precision": part(r.hit, r.said), "recall": part(r.hit, r.blocked)}
