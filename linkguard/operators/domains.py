"""DNS and WHOIS roll-ups per domain from stored records, and the features drawn from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from linkguard import constants as C
from linkguard.functions.sqlutil import add, any_endswith, lit

COUNTED = ["A", "AAAA", "MX", "NS", "TXT", "CNAME"]


def clean_domain(col: str = "domain") -> str:
    return f"rtrim('.', btrim(lower({col})))"


def _provider(kind: str, table) -> F.Column:
    """First provider (in list order) with one of its words in any record of a kind."""
    value = F.lower("record_value")
    is_kind = F.col("record_type") == kind
    best = F.lit(None).cast("int")
    for rank, (_, words) in reversed(list(enumerate(table))):
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(value, F.lit(w))
        best = F.when(hit, F.lit(rank)).otherwise(best)
    rank = F.min(F.when(is_kind, F.coalesce(best, F.lit(len(table)))))
    out = F.when(rank == len(table), F.lit("Other"))
    for i, (name, _) in enumerate(table):
        out = out.when(rank == i, F.lit(name))
    return out


def dns_by_domain(dns: DataFrame) -> DataFrame:
    """Counts, flags, mail authentication and providers: one aggregate, no collected lists."""
    txt = F.lower(F.when(F.col("record_type") == "TXT", F.col("record_value")))
    df = dns.withColumn("domain", F.expr(clean_domain())).groupBy("domain").agg(
        *[F.count_if(F.col("record_type") == k).alias(f"n_{k.lower()}") for k in COUNTED],
        *[F.max(F.coalesce(F.contains(txt, F.lit(f"v={k}")), F.lit(False))).cast("int")
          .alias(f"has_{a}") for a, k in [("spf", "spf1"), ("dmarc", "dmarc1"),
                                          ("dkim", "dkim1")]],
        _provider("MX", C.MAIL_PROVIDERS).alias("mail_provider"),
        _provider("NS", C.NS_PROVIDERS).alias("dns_provider"),
        F.sum("response_time_ms").alias("resolution_time_ms"))
    df = add(df, **{f"has_{k.lower()}": f"int(n_{k.lower()} > 0)" for k in COUNTED})
    return add(df, lookup_success="greatest(has_a, has_aaaa, has_mx, has_ns)")


DNS_FEATURES = {
    "dns_a_count": "n_a", "dns_aaaa_count": "n_aaaa", "dns_mx_count": "n_mx",
    "dns_ns_count": "n_ns", "dns_txt_count": "n_txt", "dns_has_a": "has_a",
    "dns_has_aaaa": "has_aaaa", "dns_has_mx": "has_mx", "dns_has_ns": "has_ns",
    "dns_has_txt": "has_txt", "dns_has_cname": "has_cname", "dns_has_spf": "has_spf",
    "dns_has_dmarc": "has_dmarc", "dns_has_dkim": "has_dkim",
    "dns_resolution_time_ms": "resolution_time_ms", "dns_lookup_success": "lookup_success",
    "dns_mail_provider_google": "int(mail_provider = 'Google')",
    "dns_mail_provider_microsoft": "int(mail_provider = 'Microsoft')",
    "dns_mail_provider_other": "int(mail_provider NOT IN ('Google', 'Microsoft'))",
    "dns_provider_cloudflare": "int(dns_provider = 'Cloudflare')",
    "dns_provider_aws": "int(dns_provider = 'AWS Route53')",
}


def dns_features(domains: DataFrame, rollup: DataFrame) -> DataFrame:
    """``domains`` (one row each) with the 21 DNS features; 0 where there are no records."""
    df = domains.join(rollup, "domain", "left")
    return df.select(*domains.columns, *[F.expr(f"coalesce({e}, 0)").alias(n)
                                         for n, e in DNS_FEATURES.items()])


def dns_lookup(dns: DataFrame, domain: str, record_type: str | None = None) -> DataFrame:
    df = dns.where(F.col("domain") == domain)
    return df.where(F.col("record_type") == record_type) if record_type else df


def base_domain(col: str = "domain") -> str:
    """Last two labels."""
    return f"substring_index({clean_domain(col)}, '.', -2)"


def whois_by_domain(whois: DataFrame, as_of: str) -> DataFrame:
    """Ages, expiry and registrar flags; the earliest of several dates counts, the registrar is
    the one of the first record that names one, and at most ten name servers are counted."""
    words = " OR ".join(f"contains(lower(registrar), {lit(w)})" for w in C.PRIVACY_REGISTRARS)
    df = whois.withColumn("domain", F.expr(base_domain())).groupBy("domain").agg(
        F.min("creation_date").alias("creation_date"),
        F.min("expiration_date").alias("expiration_date"),
        F.min_by("registrar", F.when(F.col("registrar").isNotNull(), F.col("record_id")))
        .alias("registrar"),
        F.countDistinct(F.expr("rtrim('.', lower(name_server))")).alias("ns"))
    now = f"TIMESTAMP_NTZ '{as_of}'"
    df = add(df, domain_age_days=f"coalesce(timestampdiff(DAY, creation_date, {now}), 0)",
             days_until_expiry="cast(coalesce(floor(timestampdiff(SECOND, "
                               f"{now}, expiration_date) / 86400D), 0) as bigint)",
             nameserver_count="ns",
             is_privacy_protected=f"int(coalesce({words}, false))",
             is_free_tld=f"int({any_endswith('domain', C.FREE_TLDS)})")
    df = add(df, is_new_domain="int(creation_date IS NOT NULL AND domain_age_days < 30)",
             is_expiring_soon="int(expiration_date IS NOT NULL AND days_until_expiry > 0 "
                              "AND days_until_expiry < 30)")
    return add(df, new_domain_risk="CASE WHEN is_new_domain = 1 THEN 1D WHEN domain_age_days <> 0 "
                                   "AND domain_age_days < 90 THEN 0.5D ELSE 0D END",
               whois_success="1").drop("ns")


WHOIS_FEATURES = {
    "domain_age_days": "least(domain_age_days, 20000)", "days_until_expiry": "days_until_expiry",
    "is_new_domain": "is_new_domain", "is_expiring_soon": "is_expiring_soon",
    "is_privacy_protected": "is_privacy_protected", "is_free_tld": "is_free_tld",
    "new_domain_risk": "new_domain_risk", "whois_nameserver_count": "nameserver_count",
    "whois_success": "whois_success",
}


def whois_features(domains: DataFrame, rollup: DataFrame) -> DataFrame:
    df = domains.withColumn("_base", F.expr(base_domain())).join(
        rollup.withColumnRenamed("domain", "_base"), "_base", "left")
    return df.select(*domains.columns, *[F.expr(f"coalesce({e}, 0)").alias(n)
                                         for n, e in WHOIS_FEATURES.items()])


def domain_score(rollup: DataFrame) -> DataFrame:
    return rollup.selectExpr("domain", "least(40 * is_new_domain + 20 * is_privacy_protected + "
                                       "30 * is_free_tld + 10 * is_expiring_soon, 100) "
                                       "AS domain_score")


def resolve(domains: DataFrame, dns: DataFrame) -> DataFrame:
    """One stored address per domain: the earliest A record (IPv4, as a resolver would give)."""
    a = dns.where("record_type = 'A'").withColumn("domain", F.expr(clean_domain()))
    one = a.groupBy("domain").agg(
        F.min_by("record_value", F.struct("query_timestamp", "record_id")).alias("ip_address"))
    return domains.join(one, "domain", "left")
