"""The batch scan: URL table in, one explained verdict per URL out."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from linkguard.operators import impersonation as I, normalize as N, risk as K, rules as R
from linkguard.functions.sqlutil import add, pin


def scan_urls(urls: DataFrame) -> DataFrame:
    """Scans put ``http://`` before every URL that does not start with ``http``."""
    return urls.where("full_url <> ''").selectExpr(
        "url_id", "CASE WHEN startswith(full_url, 'http') THEN full_url "
                  "ELSE concat('http://', full_url) END AS full_url")


def unusable(urls: DataFrame) -> DataFrame:
    """The error rows of a scan: URLs that are NULL or empty."""
    return urls.where("coalesce(full_url, '') = ''").selectExpr(
        "url_id", "full_url AS url", "full_url AS raw_url", "'error' AS prediction", "0D AS confidence",
        "'UNKNOWN' AS risk_level", "'UNKNOWN' AS verdict", "'Invalid URL' AS error")


def risk_signals(ruled: DataFrame, ml: DataFrame | None = None, ip: DataFrame | None = None,
                 domains: DataFrame | None = None) -> DataFrame:
    """Attach the other signals to the rule scores.

    ``ml(url_id, ml_probability)``, ``ip(registered_domain, combined_risk, abuse_score)`` and
    ``domains(registered_domain, domain_score)`` are optional; a missing one stays NULL.
    """
    df = ruled
    df = df.join(ml, "url_id", "left") if ml is not None else \
        df.withColumn("ml_probability", F.lit(None).cast("double"))
    # hosts that are addresses have no registered domain; as one shared empty key they would be hot
    some = "CASE WHEN registered_domain <> '' THEN registered_domain ELSE concat('\\u0000', url_id) END"
    if ip is not None or domains is not None:
        df = add(df, signal_key=some)
    if ip is not None:
        df = df.join(ip.withColumnRenamed("registered_domain", "signal_key"), "signal_key", "left")
        df = add(df, ip_score="cast(combined_risk as double) * 100",
                 threat_score="cast(abuse_score as double)")
    else:
        df = add(df, ip_score="cast(NULL as double)", threat_score="cast(NULL as double)")
    df = df.join(domains.withColumnRenamed("registered_domain", "signal_key"), "signal_key", "left") if domains is not None else \
        df.withColumn("domain_score", F.lit(None).cast("double"))
    return K.domain_score_blend(df)


def scan_batch(urls: DataFrame, ml=None, ip=None, domains=None, weights=None,
               thresholds=None) -> DataFrame:
    scans = I.with_host(scan_urls(urls), "full_url")
    spark = urls.sparkSession
    rollup = I.typosquat_rollup(I.typosquat_matches(scans, I.brand_dim(spark)))
    norm = pin(I.with_host(N.url_normalize(scans), "raw_url"), "ts_host")
    ruled = R.rule_score(R.with_typosquat(norm, rollup))
    df = K.risk_fuse(risk_signals(ruled, ml, ip, domains), weights, thresholds)
    return add(df, url="raw_url", risk_score="round(risk_score, 2)",
               rule_score="round(rule_score, 2)", reasons="rule_reasons").unionByName(
        unusable(urls), allowMissingColumns=True)


def scan_summary(verdicts: DataFrame) -> DataFrame:
    return verdicts.agg(
        F.count("*").alias("total"),
        *[F.count_if(F.col("prediction") == p).alias(n) for p, n in [
            ("malicious", "malicious"), ("suspicious", "suspicious"), ("benign", "benign"),
            ("error", "errors")]])


def evidence_list(scanned: DataFrame) -> DataFrame:
    """Evidence lines of a scan; columns of optional signals may be absent."""
    has = set(scanned.columns)
    items = [("rule_score >= 30", "concat('Rule engine score: ', cast(round(rule_score) as bigint),"
              " '/100')")]
    if "ml_probability" in has:
        items.append(("ml_probability >= 0.5", "concat('ML probability: ', "
                      "format_string('%.1f', round(ml_probability * 100, 1)), '%')"))
    head = _lines(items)
    squat = ("transform(ts_matches, m -> concat('Typosquatting: mimics ', "
             "upper(m.brand), ' (similarity ', cast(round(m.similarity * 100) as bigint), '%, ', "
             "replace(m.technique, '_', ' '), ')'))")
    rest = [
        ("abuse_score > 0", "concat('IP abuse score: ', abuse_score)", "abuse_score"),
        ("is_tor", "'Source IP is a Tor exit node'", "is_tor"),
        ("is_vpn", "'Source IP is a VPN'", "is_vpn"),
        ("is_hosting", "'Source IP is a hosting/datacenter'", "is_hosting"),
        ("ip_country <> ''", "concat('IP located in ', ip_country)", "ip_country"),
        ("is_new_domain = 1", "concat('Newly registered domain (', domain_age_days, ' days old)')",
         "is_new_domain"),
        ("is_new_domain = 0 AND domain_age_days <> 0 AND domain_age_days < 90",
         "concat('Recently registered domain (', domain_age_days, ' days old)')", "is_new_domain"),
        ("is_privacy_protected = 1", "'Privacy-protected registration'", "is_privacy_protected"),
        ("is_expiring_soon = 1", "concat('Domain expiring in ', days_until_expiry, ' days')",
         "is_expiring_soon"),
        ("has_mx = 0 AND lookup_success = 1", "'No MX records'", "has_mx"),
        ("has_spf = 0 AND lookup_success = 1", "'No SPF record'", "has_spf"),
        ("is_punycode", "'Punycode/IDN domain detected'", None),
        ("has_unicode", "'Unicode characters in hostname'", None),
        ("has_at_symbol", "'@ symbol in URL (redirect trick)'", None),
        ("has_double_encoding", "'Double URL encoding detected'", None),
        ("is_ip_host", "'IP address used as host'", None),
        ("percent_encoding_count > 5", "concat('Heavy URL encoding: ', percent_encoding_count, "
         "' chars')", None)]
    tail = _lines([(c, t) for c, t, need in rest if need is None or need in has])
    df = add(scanned, evidence=f"concat({head}, {squat}, {tail})")
    return add(df, evidence="CASE WHEN size(evidence) > 0 THEN evidence ELSE transform("
                            "rule_reasons, r -> concat('Rule triggered: ', r)) END")


def _lines(items) -> str:
    cases = ", ".join(f"CASE WHEN {c} THEN {t} END" for c, t in items)
    return f"filter(array({cases}), e -> e IS NOT NULL)"
