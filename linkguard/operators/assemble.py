"""Assembly of the full feature table: URL, DNS, WHOIS, IP, geo and traffic features."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F


from linkguard.operators import domains as E, ips as I, normalize as N, traffic as G, \
    url_features as U
from linkguard.shared import staged

STRUCTURAL = ["is_private", "is_ipv6", "ip_numeric", "octet_1", "octet_2", "octet_3", "octet_4"]
HISTORY = ["threat_score", "total_requests", "active_threats_count", "is_known_malicious",
           "days_since_first_seen"]
GEO = ["has_geolocation", "latitude", "longitude", "isp_length", "org_exists", "geo_country_flag"]
IP_SIDE = STRUCTURAL + HISTORY + list(I.INTEL_FEATURES) + GEO + G.TRAFFIC_FEATURES
FEATURES = U.URL_FEATURES + list(E.DNS_FEATURES) + list(E.WHOIS_FEATURES) + IP_SIDE


def ip_side(ips: DataFrame, table, threats, alerts, abuse, geo, traffic, as_of: str) -> DataFrame:
    """All per-address features, one row per distinct address."""
    ips = staged(ips.select("ip_address").where("ip_address IS NOT NULL").distinct(), "addresses")
    intel = I.intelligence(ips, table, threats, alerts, abuse, geo, as_of)
    parts = [I.structural(ips), I.history_features(ips, table, threats, as_of),
             I.intel_features(intel), I.geo_features(ips, geo),
             G.traffic_features(G.flow_ends(traffic, ips), as_of)]
    return reduce(lambda a, b: a.join(b, "ip_address", "left"), parts)


def feature_table(urls: DataFrame, dns, whois, table, threats, alerts, abuse, geo, traffic,
                  as_of: str, compat: bool = False) -> DataFrame:
    """One row of 118 columns per URL with a URL text and a domain (117 names plus the separate
    geo country flag; ``compat`` folds that flag into ``country_risk``).

    DNS, WHOIS and IP features are built once per distinct domain / address and joined by key, so
    a domain shared by many URLs is looked up once. A URL without a parsable host takes host, path and
    tld from its own row, where ``urls`` has them.
    """
    rows = urls.where("full_url <> '' AND domain <> ''").select(
        "url_id", "full_url", "domain", F.col("domain").alias("rec_domain"),
        *[(F.col(c) if c in urls.columns else F.lit(None).cast("string")).alias(f"rec_{c}") for c in ("path", "tld")])
    doms = rows.select("domain").distinct()
    dom = E.resolve(E.whois_features(E.dns_features(doms, E.dns_by_domain(dns)),
                                     E.whois_by_domain(whois, as_of)), dns)
    # the distinct domains with their features and address; five address parts start from it
    dom = staged(dom, "domains")
    dom = dom.join(ip_side(dom, table, threats, alerts, abuse, geo, traffic, as_of),
                   "ip_address", "left").drop("ip_address")
    norm = U.fallback_row(N.url_normalize(rows, keep=["domain", *U.RECORD]))
    feats = U.url_features(norm, keep=["domain"])
    df = feats.join(dom, "domain", "left")
    df = df.select("url_id", "domain", *[F.coalesce(c, F.lit(0)).alias(c) for c in FEATURES])
    if compat:
        flagged = F.when(F.col("intel_available") + F.col("has_geolocation") > 0,
                         F.col("geo_country_flag").cast("double")).otherwise(F.lit(0.0))
        df = df.withColumn("country_risk", flagged)
    return df


def feature_stats(features: DataFrame, n_input: DataFrame) -> DataFrame:
    """Processed / failed rows, features per family, and lookup failures."""
    from linkguard.operators.reports import one_row
    ok = features.agg(
        F.count("*").alias("done"), (F.count("*") * len(U.URL_FEATURES)).alias("url_features"),
        (F.count("*") * len(E.DNS_FEATURES)).alias("dns_features"),
        (F.count("*") * len(E.WHOIS_FEATURES)).alias("domain_features"),
        F.count_if(F.col("dns_lookup_success") == 0).alias("dns_lookup_failures"),
        F.count_if(F.col("whois_success") == 0).alias("whois_lookup_failures"))
    total = n_input.agg(F.count("*").alias("total"))
    return one_row(ok, total).selectExpr(
        "done AS total_processed", "total - done AS total_failed", "url_features", "dns_features",
        "domain_features", "dns_lookup_failures", "whois_lookup_failures")


def training_set(urls: DataFrame, cache: DataFrame, limit: int | None = 1000) -> DataFrame:
    """Labelled URLs with their cached vectors, newest first. With a limit, the newest URLs are
    cut first (each has at least one joined row)."""
    u = urls.where("is_malicious IS NOT NULL").select("url_id", "full_url", "domain",
                                                      "is_malicious", "submission_date")
    order = [F.desc("submission_date"), F.desc("url_id")]
    c = cache.select("url_id", "feature_vector")
    if limit is None:
        return u.join(c, "url_id", "left")
    top = u.orderBy(*order).limit(limit)
    c = c.join(top.select("url_id"), "url_id", "left_semi")
    return top.join(c, "url_id", "left").orderBy(*order, F.asc_nulls_first("feature_vector")).limit(
        limit)
