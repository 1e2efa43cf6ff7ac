"""The rule engine: every rule is a points expression and a reason expression.

Text rules look at the lower-cased decoded URL, domain rules at the registered domain (the host
when there is none). Word lists are literal arrays scanned by ``filter``: no UDF, no join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from linkguard import constants as C
from linkguard.functions.sqlutil import (add, any_contains, any_endswith, array, count_char,
                                         in_list, items, pin)


def rule_base(norm: DataFrame) -> DataFrame:
    df = add(norm, domain_lower="lower(CASE WHEN registered_domain = '' THEN hostname "
                                "ELSE registered_domain END)",
             url_lower="lower(CASE WHEN decoded_url = '' THEN raw_url ELSE decoded_url END)")
    two = [d for d in C.TRUSTED_DOMAINS if d.count(".") == 1]
    three = [d for d in C.TRUSTED_DOMAINS if d.count(".") == 2]
    official = "concat('(^|[.])', b, '[.](" + "|".join(C.OFFICIAL_SUFFIXES) + ")$')"
    exts = array(C.RULE_EXTENSIONS)
    return add(
        df,
        # equal to an entry or a subdomain of it: compare the last two / three labels
        trusted=f"{in_list('''substring_index(domain_lower, '.', -2)''', two)} OR "
                f"{in_list('''substring_index(domain_lower, '.', -3)''', three)}",
        safe_tld=any_endswith("domain_lower", C.SAFE_TLD_SUFFIXES),
        risky_tld=f"get(filter({array(C.HIGH_RISK_TLDS)}, t -> endswith(domain_lower, t)), 0)",
        mimicked=f"get(filter({array(C.RULE_BRANDS)}, b -> contains(domain_lower, b) "
                 f"AND NOT domain_lower RLIKE {official}), 0)",
        bad_scheme=f"get(filter({array(C.DANGEROUS_SCHEMES)}, s -> contains(url_lower, s)), 0)",
        sensitive=any_contains("url_lower", C.SENSITIVE_WORDS),
        n_keywords=f"size(filter({array(C.RULE_KEYWORDS)}, k -> contains(url_lower, k)))",
        extension=f"get(filter({exts}, e -> endswith(url_lower, e) OR "
                  "contains(url_lower, concat(e, '?')) OR contains(url_lower, concat(e, '&'))), 0)",
        n_subdomains="CASE WHEN subdomain <> '' THEN size(filter(split(subdomain, '[.]'), "
                     "p -> p <> '')) ELSE greatest(0, size(split(substring_index(hostname, ':', 1)"
                     ", '[.]')) - 2) END",
        n_hyphens=count_char("domain_lower", "-"),
        digit_share="(length(domain_lower) - length(regexp_replace(domain_lower, '[0-9]', ''))) "
                    "/ cast(greatest(length(domain_lower), 1) as double)",
        odd_port="port > 0 AND NOT port <=> (CASE scheme " + " ".join(
            f"WHEN '{s}' THEN {p}" for s, p in C.RULE_DEFAULT_PORTS.items()) + " END)",
        url_chars="length(raw_url)",
        admin_path=any_contains("url_lower", C.ADMIN_PATHS),
        phishing_path=any_contains("url_lower", C.PHISHING_PATHS),
        redirecting=any_contains("url_lower", C.REDIRECT_PARAMS),
        base64_like="raw_url RLIKE '[A-Za-z0-9+/=]{50,}'",
    )


# Scored rules in reporting order: key -> [(condition, points, reason SQL or None)]; the first
# condition that holds applies. --- fixed values: points and thresholds
RULES: list[tuple[str, list[tuple[str, int, str | None]]]] = [
    ("at_symbol", [("has_at_symbol", 25, "'at_symbol_in_url'")]),
    ("double_encoding", [("has_double_encoding", 20, "'double_encoding'")]),
    ("punycode", [("is_punycode", 15, "'punycode_hostname'")]),
    ("unicode", [("has_unicode AND NOT is_punycode", 10, "'unicode_hostname'")]),
    ("percent", [("percent_encoding_count > 5", 12,
                  "concat('url_encoding:', percent_encoding_count)"),
                 ("percent_encoding_count > 2", 5, None)]),
    ("typosquat", []),
    ("high_risk_tld", [("risky_tld IS NOT NULL", 35, "concat('high_risk_tld:', risky_tld)")]),
    ("brand_mimic", [("mimicked IS NOT NULL", 30, "concat('brand_mimic:', mimicked)")]),
    ("ip_host", [("is_ip_host AND is_private_ip", 10, "'private_ip_host'"),
                 ("is_ip_host", 30, "'public_ip_as_host'")]),
    ("dangerous_scheme", [("bad_scheme IS NOT NULL", 40,
                           "concat('dangerous_scheme:', bad_scheme)")]),
    ("no_https", [("NOT is_https AND sensitive", 25, "'no_https_sensitive'"),
                  ("NOT is_https", 8, "'no_https'")]),
    ("keywords", [("n_keywords >= 5", 25, "concat('many_keywords:', n_keywords)"),
                  ("n_keywords >= 3", 15, "concat('multiple_keywords:', n_keywords)"),
                  ("n_keywords >= 1", 8, "'suspicious_keyword'")]),
    ("executable", [("extension IS NOT NULL", 25, "concat('executable:', extension)")]),
    ("admin_path", [("admin_path", 20, "'admin_panel_exposed'")]),
    ("subdomains", [("n_subdomains > 5", 15, "concat('excessive_subdomains:', n_subdomains)"),
                    ("n_subdomains > 3", 8, "concat('many_subdomains:', n_subdomains)")]),
    ("hyphens", [("n_hyphens > 4", 12, "concat('many_hyphens:', n_hyphens)"),
                 ("n_hyphens > 2", 5, None)]),
    ("digit_domain", [("digit_share > 0.5 AND length(domain_lower) > 20", 15,
                       "'digit_heavy_domain'")]),
    ("phishing_path", [("phishing_path", 12, "'phishing_pattern'")]),
    ("port", [("odd_port", 5, "concat('non_standard_port:', port)")]),
    ("redirect_param", [("redirecting", 8, "'redirect_param'")]),
    ("length", [("url_chars > 500", 15, "'extremely_long_url'"),
                ("url_chars > 200", 8, "'very_long_url'")]),
    ("base64", [("base64_like", 20, "'base64_encoded'")]),
]


def _case(cases, pick, default):
    whens = " ".join(f"WHEN {c} THEN {pick(p, r)}" for c, p, r in cases)
    return f"CASE {whens} ELSE {default} END"


def points_sql(key: str) -> str:
    if key == "typosquat":
        return "least(cast(least(ts_highest_risk, 100) * 0.4D as int), 40)"
    return _case(dict(RULES)[key], lambda p, r: str(p), "0")


def reasons_sql(key: str) -> str:
    """SQL array of zero or more reasons."""
    if key == "typosquat":
        return "transform(ts_matches, m -> concat('typosquat:', m.brand, '(', "\
               "m.technique, ')'))"
    one = _case(dict(RULES)[key], lambda p, r: r or "NULL", "NULL")
    return f"filter(array({one}), r -> r IS NOT NULL)"


def single_rule(base: DataFrame, *keys: str) -> DataFrame:
    """Points and reason text of chosen rules only (no trusted-domain shortcut)."""
    points = " + ".join(points_sql(k) for k in keys)
    reasons = "concat(" + ", ".join(reasons_sql(k) for k in keys) + ")"
    return base.select("url_id", F.expr(points).cast("int").alias("points"),
                       F.concat_ws("|", F.expr(reasons)).alias("reason"))


NO_MATCHES = ("cast(array() as array<struct<brand:string,similarity:double,technique:string,"
              "risk:int,details:string>>)")


def with_typosquat(norm: DataFrame, host_rollup: DataFrame) -> DataFrame:
    """Attach the per-host impersonation roll-up; needs ``ts_host`` on both sides."""
    df = norm.join(host_rollup, "ts_host", "left")
    return add(df, ts_highest_risk="coalesce(ts_highest_risk, 0)",
               ts_matches=f"coalesce(ts_matches, {NO_MATCHES})")


def rule_points(base: DataFrame) -> DataFrame:
    """All rules: ``rule_points`` and the ordered ``rule_reasons`` array."""
    keys = [k for k, _ in RULES]
    shortcut = "CASE WHEN trusted THEN {} WHEN safe_tld THEN {} ELSE {} END"
    total = " + ".join(points_sql(k) for k in keys)
    reasons = "concat(" + ", ".join(reasons_sql(k) for k in keys) + ")"
    df = add(base, rule_points=shortcut.format("0", "0", total),
             rule_reasons=shortcut.format("array('known_benign_domain')", "array('safe_tld')",
                                          reasons))
    return pin(df, "rule_points", "rule_reasons")


def rule_decide(scored: DataFrame) -> DataFrame:
    df = add(
        scored,
        rule_result="CASE WHEN trusted OR safe_tld THEN 'benign' WHEN rule_points >= 40 THEN "
                    "'malicious' WHEN rule_points >= 12 THEN 'suspicious' ELSE 'benign' END",
        rule_confidence="""CASE WHEN trusted THEN 0.01D WHEN safe_tld THEN 0.02D
          WHEN rule_points >= 60 THEN least(0.90D + (rule_points - 60) / 100D, 0.99D)
          WHEN rule_points >= 40 THEN 0.65D + (rule_points - 40) / 100D
          WHEN rule_points >= 25 THEN 0.40D + (rule_points - 25) / 100D
          WHEN rule_points >= 12 THEN 0.20D + (rule_points - 12) / 100D
          ELSE greatest(rule_points / 100D, 0.01D) END""")
    df = add(df, rule_score="""CASE rule_result
        WHEN 'malicious' THEN least(60D + rule_confidence * 40, 100D)
        WHEN 'suspicious' THEN least(30D + rule_confidence * 30, 60D)
        ELSE least(rule_confidence * 15, 15D) END""")
    return pin(df, "rule_result", "rule_confidence", "rule_score")


def rule_score(norm_with_typosquat: DataFrame) -> DataFrame:
    return rule_decide(rule_points(rule_base(norm_with_typosquat)))


def rule_hit_stats(scored: DataFrame) -> DataFrame:
    return (scored.select(F.explode(items("rule_reasons")).alias("r"))
            .groupBy(F.expr("substring_index(r, ':', 1)").alias("reason"))
            .agg(F.count("*").alias("n")))


def _quick(flows: DataFrame, tlds, words, min_words, tld_reason, word_reason) -> DataFrame:
    # pinned: the lambdas would otherwise derive the URL anew for each word, and the flag and the reason the hits
    df = add(pin(add(flows, low="lower(url)"), "url", "domain", "low"), hit_tld=f"get(filter({array(tlds)}, t -> endswith(domain, t)), 0)",
             hit_words=f"filter({array(words)}, k -> contains(low, k))")
    df = pin(df, "hit_tld", "hit_words").select(*flows.columns, "hit_tld", "hit_words")
    return add(
        df, is_threat=f"hit_tld IS NOT NULL OR size(hit_words) >= {min_words}",
        reason=f"CASE WHEN hit_tld IS NOT NULL THEN {tld_reason} "
               f"WHEN size(hit_words) >= {min_words} THEN {word_reason} ELSE '' END",
    ).drop("hit_tld", "hit_words")


def live_threat_check(flow_urls: DataFrame) -> DataFrame:
    """Quick check on ``(url, domain)``: a risky suffix, or at least two keywords."""
    return _quick(flow_urls, C.LIVE_TLDS, C.LIVE_KEYWORDS, 2, "concat('suspicious_tld:', hit_tld)",
                  "concat('suspicious_keywords:', concat_ws(',', hit_words))")


def traffic_threat_check(flow_urls: DataFrame) -> DataFrame:
    return _quick(flow_urls, C.TRAFFIC_TLDS, C.TRAFFIC_KEYWORDS, 1, "'suspicious_tld'",
                  "'suspicious_keywords'")
