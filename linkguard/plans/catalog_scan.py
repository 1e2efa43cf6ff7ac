"""Checked queries: rules, brand impersonation, risk fusion and the batch scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from linkguard import constants as C
from linkguard.operators import impersonation as I, normalize as N, risk as K, rules as R
from linkguard.plans import scan as S
from linkguard.plans.oracle_ctes import CTES, fuse_ctes, half_up
from linkguard.plans.registry import query
from linkguard.plans.views import Tables


def base(t: Tables) -> DataFrame:
    return R.rule_base(N.url_normalize(t.url_corpus))


def rollup(t: Tables) -> DataFrame:
    hosts = I.with_host(t.url_corpus, "full_url")
    return I.typosquat_rollup(I.typosquat_matches(hosts, I.brand_dim(t.spark)))


def base_ts(t: Tables) -> DataFrame:
    return R.with_typosquat(I.with_host(base(t), "raw_url"), rollup(t))


@query("rule_trusted_domain", "SELECT url_id, trusted FROM c_rbase")
def _(t):
    return base(t).select("url_id", "trusted")


@query("rule_safe_tld", "SELECT url_id, safe_tld FROM c_rbase")
def _(t):
    return base(t).select("url_id", "safe_tld")


def rule_query(name: str, *keys: str) -> None:
    pts = " + ".join(f"p_{k}" for k in keys)
    why = "concat_ws('|', " + ", ".join(f"r_{k}" for k in keys) + ")"

    @query(name, f"SELECT url_id, {pts} AS points, {why} AS reason FROM c_rule_parts")
    def _(t):
        src = base_ts(t) if "typosquat" in keys else base(t)
        return R.single_rule(src, *keys)


rule_query("rule_norm_flags", "at_symbol", "double_encoding", "punycode", "unicode", "percent")
rule_query("rule_typosquat", "typosquat")
for _name, _key in [
        ("rule_high_risk_tld", "high_risk_tld"), ("rule_brand_mimic", "brand_mimic"),
        ("rule_ip_host", "ip_host"), ("rule_dangerous_scheme", "dangerous_scheme"),
        ("rule_no_https", "no_https"), ("rule_keywords", "keywords"),
        ("rule_executable", "executable"), ("rule_admin_path", "admin_path"),
        ("rule_subdomains", "subdomains"), ("rule_hyphens", "hyphens"),
        ("rule_digit_domain", "digit_domain"), ("rule_phishing_path", "phishing_path"),
        ("rule_port", "port"), ("rule_redirect_param", "redirect_param"),
        ("rule_length", "length"), ("rule_base64", "base64")]:
    rule_query(_name, _key)


def scored(t: Tables) -> DataFrame:
    return R.rule_decide(R.rule_points(base_ts(t)))


@query("rule_decide", """SELECT url_id, points AS rule_points, rule_result,
    round(rule_confidence, 4) AS rule_confidence FROM c_rules""")
def _(t):
    return scored(t).select("url_id", "rule_points", "rule_result",
                            F.round("rule_confidence", 4).alias("rule_confidence"))


@query("rule_to_signal", "SELECT url_id, round(rule_score, 4) AS rule_score FROM c_rules")
def _(t):
    return scored(t).select("url_id", F.round("rule_score", 4).alias("rule_score"))


@query("rule_score", """SELECT url_id, points AS rule_points, reasons, rule_result FROM c_rules""")
def _(t):
    return scored(t).select("url_id", "rule_points",
                            F.concat_ws("|", "rule_reasons").alias("reasons"), "rule_result")


@query("rule_hit_stats", """SELECT split_part(r, ':', 1) AS reason, count(*) AS n
    FROM (SELECT unnest(string_split(reasons, '|')) AS r FROM c_rules WHERE reasons <> '')
    GROUP BY 1""")
def _(t):
    return R.rule_hit_stats(scored(t))


# --- brand impersonation ---------------------------------------------------------------------
def labels(t: Tables) -> DataFrame:
    return I.host_labels(I.with_host(t.url_corpus, "full_url"))


def pairs(t: Tables) -> DataFrame:
    return I.candidates(I.normalize_labels(labels(t).select("label").distinct()),
                        I.brand_dim(t.spark))


def matches(t: Tables, step: int) -> DataFrame:
    return I.label_matches(pairs(t)).where(F.col("step") == step)


@query("ts_labels", "SELECT ts_host, pos AS label_pos, label FROM c_labels")
def _(t):
    return labels(t)


@query("ts_normalize_label", "SELECT DISTINCT label, label AS normalized FROM c_labels")
def _(t):
    return I.normalize_labels(labels(t).select("label").distinct()).select("label", "normalized")


@query("ts_candidates", "SELECT DISTINCT label, brand FROM c_pairs")
def _(t):
    every = I.length_pairs(I.normalize_labels(labels(t).select("label").distinct()), I.brand_dim(t.spark))
    return every.where("kind = 'plain'").select("label", "brand")


@query("ts_piece_candidates", """SELECT DISTINCT label, brand FROM c_pairs
    WHERE lev_sim >= 0.75 OR (contains(label, brand) AND len(label) <= len(brand) * 2.5)""")
def _(t):
    near = f"{I._close('normalized')} OR (contains(label, brand) AND length(label) <= length(brand) * 2.5D)"
    return pairs(t).where("kind = 'plain'").where(near).select("label", "brand")


@query("ts_combosquat", """SELECT DISTINCT label, brand, sim AS similarity, details FROM c_found
    WHERE technique = 'combosquatting'""")
def _(t):
    return matches(t, I.COMBO).select("label", "brand", "similarity", "details")


@query("ts_levenshtein", """SELECT DISTINCT label, brand, round(sim, 6) AS similarity, details
    FROM c_found WHERE tech = 1""")
def _(t):
    return matches(t, I.EDIT).select("label", "brand",
                                     F.round("similarity", 6).alias("similarity"), "details")


@query("ts_technique", "SELECT DISTINCT label, brand, technique FROM c_found WHERE tech = 1")
def _(t):
    return matches(t, I.EDIT).select("label", "brand", "technique")


GLYPHS = {"a": "а", "e": "е", "o": "о", "p": "р", "c": "с", "x": "х", "y": "у", "i": "і"}


@query("ts_homoglyph", f"""
    WITH g AS (SELECT DISTINCT label,
        translate(label, '{''.join(GLYPHS)}', '{''.join(GLYPHS.values())}') AS odd FROM c_labels),
    f AS (SELECT g.*, b.brand, b.hv, 1.0::DOUBLE - levenshtein(label, brand) /
            greatest(len(label), len(brand))::DOUBLE AS sim FROM g, brand_list b
          WHERE odd <> label AND abs(len(label) - len(brand)) <= 3)
    SELECT odd AS label, brand, round(sim, 6) AS similarity, cast(trunc(least(100,
      ((sim - 0.75) / 0.25) * 50 + 50 + CASE WHEN hv THEN 15 ELSE 0 END + 20)) AS BIGINT) AS risk
    FROM f WHERE sim >= 0.75 AND label <> brand""")
def _(t):
    # every label of the corpus, written with Cyrillic look-alikes
    odd = labels(t).select(F.translate("label", "".join(GLYPHS), "".join(GLYPHS.values()))
                           .alias("label")).distinct()
    found = I.label_matches(I.candidates(I.normalize_labels(odd), I.brand_dim(t.spark)))
    return found.where(F.col("step") == I.GLYPH).select(
        "label", "brand", F.round("similarity", 6).alias("similarity"), "risk")


@query("ts_punycode", """SELECT DISTINCT label, brand, round(sim, 6) AS similarity, 100 AS risk
    FROM c_found WHERE tech = 3""")
def _(t):
    return matches(t, I.PUNY).select("label", "brand",
                                     F.round("similarity", 6).alias("similarity"), "risk")


# brands of the dictionary in many spellings, one for each page: embedded whole, or encoded with one look-alike letter
N_BRANDS = len({b.lower() for b in C.BRANDS})
CTES["c_page_brands"] = f"""SELECT page_id, brand, 1 + (page_id // {N_BRANDS} + page_id) % len(brand) AS k
    FROM (SELECT *, row_number() OVER (ORDER BY brand_pos) - 1 AS nth FROM brand_list) JOIN pages ON nth = page_id % {N_BRANDS}"""
EMBEDDED = ["{b} || '-' || chr(97 + (page_id % 26)::INT)", "'my' || {b}", "{b} || (page_id % 90)"]


def page_brands(t: Tables) -> DataFrame:
    order = t.spark.createDataFrame(
        [(i, r.brand) for i, r in enumerate(sorted(I.brand_dim(t.spark).collect(), key=lambda r: r.brand_pos))], "nth long, brand string")
    pages = t.sql(f"SELECT page_id, page_id % {N_BRANDS} AS nth FROM pages")
    return pages.join(order, "nth").withColumn("k", F.expr("cast(1 + (page_id div {0} + page_id) % length(brand) as int)".format(N_BRANDS)))


@query("ts_combosquat_pages", "SELECT DISTINCT label, b.brand FROM (" + " UNION ALL ".join(
    f"SELECT {x.format(b='brand')} AS label FROM c_page_brands" for x in EMBEDDED) + """) JOIN brand_list b
    ON contains(label, b.brand) AND label <> b.brand AND abs(len(label) - len(b.brand)) <= 3 AND len(label) <= len(b.brand) * 2.5
    WHERE len(label) >= 3""")
def _(t):
    spelled = [x.format(b="brand").replace("(page_id % 26)::INT", "page_id % 26") for x in EMBEDDED]
    rows = page_brands(t).select(F.explode(F.expr(f"array({', '.join(spelled)})")).alias("label")).distinct()
    found = I.label_matches(I.candidates(I.normalize_labels(rows), I.brand_dim(t.spark)))
    return found.where(F.col("step") == I.COMBO).select("label", "brand")


@query("ts_punycode_pages", f"""SELECT DISTINCT odd AS decoded, b.brand, round(sim, 6) AS similarity FROM (
    SELECT odd, b.brand, 1.0::DOUBLE - levenshtein(asked, b.brand) / greatest(len(asked), len(b.brand))::DOUBLE AS sim
    FROM (SELECT brand[:k - 1] || translate(brand[k], '{''.join(GLYPHS)}', '{''.join(GLYPHS.values())}') || brand[k + 1:] AS odd,
            brand[:k - 1] || '?' || brand[k + 1:] AS asked FROM c_page_brands
          WHERE contains('{''.join(GLYPHS)}', brand[k])), brand_list b) b WHERE sim >= 0.75""")
def _(t):
    from linkguard.functions.unicode import punycode_encode
    odd = F.expr(f"concat(substr(brand, 1, k - 1), translate(substr(brand, k, 1), '{''.join(GLYPHS)}', "
                 f"'{''.join(GLYPHS.values())}'), substr(brand, k + 1))")
    rows = page_brands(t).select("brand", odd.alias("odd")).where("odd <> brand").select("odd").distinct() \
        .withColumn("label", F.concat(F.lit("xn--"), punycode_encode("odd")))
    found = I.label_matches(I.candidates(I.normalize_labels(rows), I.brand_dim(t.spark)))
    return found.where(F.col("step") == I.PUNY).select(
        F.col("odd").alias("decoded"), "brand", F.round("similarity", 6).alias("similarity"))


@query("typosquat_matches", """SELECT ts_host, brand, technique, round(similarity, 6) AS similarity,
    risk, details FROM c_typo""")
def _(t):
    m = I.typosquat_matches(I.with_host(t.url_corpus, "full_url"), I.brand_dim(t.spark))
    return m.select("ts_host", "brand", "technique", F.round("similarity", 6).alias("similarity"),
                    "risk", "details")


@query("ts_risk_rollup", """SELECT ts_host, highest_risk AS ts_highest_risk,
    array_to_string(labels, '|') AS matches FROM c_roll""")
def _(t):
    return rollup(t).select("ts_host", "ts_highest_risk", F.concat_ws("|", F.expr(
        "transform(ts_matches, m -> concat('typosquat:', m.brand, '(', m.technique, ')'))"))
        .alias("matches"))


@query("ts_brand_report", """SELECT brand, technique, count(*) AS n_urls,
    count(DISTINCT ts_host) AS n_hosts FROM c_hosts JOIN c_typo USING (ts_host) GROUP BY 1, 2""")
def _(t):
    urls = I.with_host(t.url_corpus, "full_url")
    return I.brand_report(urls, I.typosquat_matches(urls, I.brand_dim(t.spark)))


# --- risk fusion over stored signals ---------------------------------------------------------
SIGNAL_SQL = """SELECT o_orderkey AS url_id,
    CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE (o_totalprice % 13000) / 100 - 10 END AS rule_score,
    CASE WHEN o_orderkey % 4 = 1 THEN NULL ELSE (o_totalprice % 1200) / 1000 - 0.1 END
      AS ml_probability,
    CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE (o_custkey % 110) + 0.5 END AS ip_score,
    CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE (o_custkey % 11) * 10.0 END AS domain_score,
    CASE WHEN o_orderkey % 7 < 3 THEN NULL ELSE (o_totalprice % 100) + 0.0 END AS threat_score
    FROM orders"""


def signals(t: Tables) -> DataFrame:
    return t.sql(SIGNAL_SQL)


_clip = ", ".join(f"greatest(0, least(100, {s}))::DOUBLE AS {s}" for s in
                  ["rule_score", "ip_score", "domain_score", "threat_score"])
CTES["k_signals"] = f"""SELECT * REPLACE ({', '.join(
    f"CASE WHEN {s} IS NULL THEN NULL ELSE greatest(0, least(100, {s})) END::DOUBLE AS {s}"
    for s in ["rule_score", "ip_score", "domain_score", "threat_score"])}),
    CASE WHEN ml_probability IS NULL THEN NULL ELSE greatest(0, least(1, ml_probability)) END::DOUBLE
      * 100 AS ml_score FROM ({SIGNAL_SQL})"""
CTES |= fuse_ctes("k_", "k_signals")
CUSTOM_WEIGHTS = {"rule_score": 2.0, "ml_score": 3.0, "ip_score": 0.0, "domain_score": 4.0,
                  "threat_score": 1.0}
CUSTOM_THRESHOLDS = {"benign": 20, "suspicious": 50, "high_risk": 70}
CTES |= fuse_ctes("kc_", "k_signals", {k: v / 10 for k, v in CUSTOM_WEIGHTS.items()},
                  CUSTOM_THRESHOLDS)
SIG = ["rule_score", "ml_score", "ip_score", "domain_score", "threat_score"]


def rounded(df: DataFrame, *cols: str) -> list:
    return [F.round(c, 6).alias(c) for c in cols]


@query("risk_normalize", f"SELECT url_id, {', '.join(f'{half_up(s, 6)} AS {s}' for s in SIG)} "
                         "FROM k_signals")
def _(t):
    df = K.risk_normalize(signals(t))
    return df.select("url_id", *rounded(df, *SIG))


@query("risk_renormalize", f"SELECT url_id, {', '.join(f'{half_up("w_" + s, 6)} AS w_{s}' for s in SIG)} "
                           "FROM k_weights")
def _(t):
    df = K.risk_renormalize(K.risk_normalize(signals(t)))
    return df.select("url_id", *rounded(df, *[f"w_{s}" for s in SIG]))


@query("risk_score", f"""SELECT url_id, {half_up('risk_score', 6)} AS risk_score, missing,
    {', '.join(f'{half_up("c_" + s, 6)} AS c_{s}' for s in SIG)} FROM k_fused""")
def _(t):
    df = K.risk_fuse(signals(t))
    return df.select("url_id", F.concat_ws(",", "missing_signals").alias("missing"),
                     *rounded(df, "risk_score", *[f"c_{s}" for s in SIG]))


@query("risk_verdict", "SELECT url_id, verdict FROM k_fused")
def _(t):
    return K.risk_fuse(signals(t)).select("url_id", "verdict")


@query("risk_confidence", "SELECT url_id, confidence FROM k_fused")
def _(t):
    return K.risk_fuse(signals(t)).select("url_id", "confidence")


_top = ", ".join(f"struct_pack(neg := -c_{s}, pos := {i}, name := '{s}', w := w_{s})"
                 for i, s in enumerate(SIG))


@query("risk_explain", f"""SELECT url_id, CASE WHEN n_present = 0
      THEN 'No signals available to score' ELSE concat_ws(chr(10),
      'Risk score: ' || printf('%.1f', {half_up('risk_score', 1)}) || '/100 → ' || verdict,
      CASE WHEN len(top) > 0 THEN 'Top contributing signals:' END,
      CASE WHEN len(top) > 0 THEN array_to_string(list_transform(top, lambda e: '  • ' || e.name ||
        ': ' || printf('%.1f', {half_up('-e.neg', 1)}) || ' pts (weight ' ||
        printf('%.2f', {half_up('e.w', 2)}) || ')'), chr(10)) END,
      CASE WHEN missing <> '' THEN 'Missing signals: ' || replace(missing, ',', ', ') END) END
      AS explanation
    FROM (SELECT *, list_sort(list_filter([{_top}], lambda e: e.neg < 0)) AS top FROM k_fused)""")
def _(t):
    return K.risk_fuse(signals(t)).select("url_id",
                                          F.concat_ws("\n", "explanation").alias("explanation"))


@query("risk_prediction_map", "SELECT url_id, prediction, risk_level FROM k_fused")
def _(t):
    return K.risk_fuse(signals(t)).select("url_id", "prediction", "risk_level")


@query("risk_custom_weights", f"""SELECT url_id, {half_up('risk_score', 6)} AS risk_score, verdict,
    confidence FROM kc_fused""")
def _(t):
    df = K.risk_fuse(signals(t), CUSTOM_WEIGHTS, CUSTOM_THRESHOLDS)
    return df.select("url_id", *rounded(df, "risk_score"), "verdict", "confidence")


@query("risk_fuse", f"""SELECT url_id, {half_up('risk_score', 4)} AS risk_score, verdict, confidence,
    prediction, risk_level FROM k_fused""")
def _(t):
    return K.risk_fuse(signals(t)).select("url_id", F.round("risk_score", 4).alias("risk_score"),
                                          "verdict", "confidence", "prediction", "risk_level")


# --- batch scan ------------------------------------------------------------------------------
CTES["s_signals"] = """SELECT *, NULL::DOUBLE AS ml_score, NULL::DOUBLE AS ip_score,
    CASE WHEN highest_risk > 0 THEN highest_risk::DOUBLE END AS domain_score,
    NULL::DOUBLE AS threat_score FROM s_rules"""
CTES |= fuse_ctes("s_", "s_signals")
SCAN_COLS = ["url_id", "url", "prediction", "confidence", "risk_level", "risk_score", "verdict",
             "rule_result", "rule_score", "reasons", "registered_domain"]


# what users paste: every fifth page comes with an empty or missing URL too
BLANK_URLS = """SELECT -1 - page_id AS url_id, CASE WHEN page_id % 2 = 0 THEN '' END AS full_url
    FROM pages WHERE page_id % 5 = 0"""
CTES["s_verdicts"] = f"""SELECT url_id, raw_url AS url, prediction, confidence, risk_level, risk_score, verdict,
    rule_result, rule_score, reasons, registered_domain FROM s_fused UNION ALL
    SELECT url_id, full_url, 'error', 0, 'UNKNOWN', NULL, 'UNKNOWN', NULL, NULL, NULL, NULL FROM ({BLANK_URLS})"""


def pasted(t: Tables) -> DataFrame:
    return t.url_corpus.select("url_id", "full_url").unionByName(t.sql(BLANK_URLS))


@query("scan_batch", """SELECT url_id, url, prediction, confidence, risk_level,
    round(risk_score, 2) AS risk_score, verdict, rule_result, round(rule_score, 2) AS rule_score,
    reasons, registered_domain FROM s_verdicts""")
def _(t):
    return S.scan_batch(pasted(t)).select(
        *[F.array_join(c, "|").alias(c) if c == "reasons" else c for c in SCAN_COLS])


@query("scan_summary", """SELECT count(*) AS total,
    count(*) FILTER (prediction = 'malicious') AS malicious,
    count(*) FILTER (prediction = 'suspicious') AS suspicious,
    count(*) FILTER (prediction = 'benign') AS benign,
    count(*) FILTER (prediction = 'error') AS errors FROM s_verdicts""")
def _(t):
    return S.scan_summary(S.scan_batch(pasted(t)))


@query("verdict_by_domain", """SELECT registered_domain, verdict, count(*) AS n
    FROM s_fused GROUP BY 1, 2""")
def _(t):
    return S.scan_batch(t.url_corpus).groupBy("registered_domain", "verdict").agg(
        F.count("*").alias("n"))
