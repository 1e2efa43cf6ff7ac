"""Checked queries: feeds, flows, DNS, WHOIS, IP intelligence, traffic and destination policy."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from linkguard import constants as C
from linkguard.operators import assemble as H, domains as E, egress as L, impersonation as IM, \
    ips as I, reports as N, risk as K, traffic as G, upserts as B, url_features as U
from linkguard.plans import scan as S
from linkguard.plans.oracle_ctes import CTES, fuse_ctes, q
from linkguard.plans.registry import fmt, query
from linkguard.plans.views import AS_OF, Dialect, Tables
from linkguard.shared import shared_folder
from linkguard.sources import feeds, flows, sinks

NOW = f"TIMESTAMP '{AS_OF}'"
DUCK = Dialect("duck")

# --- feeds -----------------------------------------------------------------------------------
CTES["a_json"] = """SELECT pos, coalesce(nullif(json_extract_string(line, '$.url'), ''),
    json_extract_string(line, '$.phish_detail_url')) AS full_url FROM feed_json
    WHERE starts_with(full_url, 'http')"""
CTES["a_csv"] = """SELECT pos, regexp_extract(line, '^[^,]*,"([^"]*)"', 1) AS full_url FROM feed_csv
    WHERE starts_with(full_url, 'http')"""
CTES["a_lines"] = """SELECT source, pos, trim(line) AS full_url FROM feed_lines
    WHERE starts_with(full_url, 'http')"""
CTES["a_malware"] = """SELECT pos, string_split(line, '","')[3] AS full_url FROM feed_malware_csv
    WHERE line NOT LIKE '#%' AND starts_with(full_url, 'http')"""


@query("feed_scan_json", "SELECT pos, full_url FROM a_json")
def _(t):
    return feeds.scan_json(t.feed_json)


@query("feed_scan_csv", "SELECT pos, full_url FROM a_csv")
def _(t):
    return feeds.scan_csv(t.feed_csv)


@query("feed_scan_lines", "SELECT source, pos, full_url FROM a_lines")
def _(t):
    return feeds.scan_lines(t.feed_lines)


@query("feed_scan_malware", "SELECT pos, full_url FROM a_malware")
def _(t):
    return feeds.scan_malware_csv(t.feed_malware_csv)


@query("feed_scan_malware_json", """SELECT pos, json_extract_string(u, '$.url') AS full_url FROM
    (SELECT pos, unnest(cast(json_extract(line, '$.urls') AS JSON[])) AS u FROM feed_malware_json)
    WHERE json_extract_string(u, '$.url') <> ''""")
def _(t):
    return feeds.scan_malware_json(t.feed_malware_json)


RECORD = r"""lower(regexp_extract(full_url, '^([a-zA-Z]+):', 1)) AS protocol,
    split_part(regexp_replace(split_part(full_url, '://', 2), '[?#].*$', ''), '/', 1) AS domain,
    coalesce(nullif(regexp_extract(full_url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1), ''), '/') AS path,
    CASE WHEN domain LIKE '%.%' THEN string_split(domain, '.')[-1] ELSE '' END AS tld,
    len(full_url) AS url_length"""


@query("url_record_build", f"SELECT full_url, {RECORD}, 'phish_json' AS source, "
                           "true AS is_malicious FROM a_json")
def _(t):
    return feeds.url_records(feeds.scan_json(t.feed_json), "phish_json", True).drop("pos")


@query("ip_blocklist_scan", """SELECT DISTINCT ip FROM (
    SELECT split_part(CASE WHEN x LIKE '% %' THEN split_part(x, ' ', 1) ELSE x END, '/', 1) AS ip
    FROM (SELECT trim(line) AS x FROM netset_lines) WHERE x <> '' AND x NOT LIKE '#%')
    WHERE regexp_full_match(ip, '[0-9]+([.][0-9]+){3}')""")
def _(t):
    return feeds.ip_blocklist(t.netset_lines)


BRAND_ROWS = "SELECT p_brand, p_partkey, p_type FROM part"


@query("brand_dim", """SELECT lower(replace(p_brand, '#', '')) AS brand, min(p_partkey) AS brand_pos,
    bool_or(p_type = 'PROMO') AS high_value FROM part GROUP BY 1""")
def _(t):
    return feeds.brand_dim(t.base("part").selectExpr(
        "replace(p_brand, '#', '') AS brand", "p_partkey AS pos", "p_type = 'PROMO' AS high"))


CACHE_SQL = """SELECT url_id, concat('{"url_length":', url_length, '.0,"odd":', url_id % 7,
    '.5}') AS feature_vector FROM urls_v WHERE url_id % 4 <> 0"""


@query("feature_vector_parse", """SELECT url_id, cast(is_malicious AS BIGINT) AS label,
    regexp_replace(domain, '^www[.]', '') AS domain,
    CASE WHEN url_id % 4 = 0 THEN 0.0 ELSE url_length END::DOUBLE AS url_length,
    CASE WHEN url_id % 4 = 0 THEN 0.0 ELSE url_id % 7 + 0.5 END::DOUBLE AS odd, 0.0::DOUBLE AS none
    FROM urls_v WHERE is_malicious IS NOT NULL""")
def _(t):
    return feeds.feature_vectors(t.urls_v, t.sql(CACHE_SQL), ["url_length", "odd", "none"])


@query("feature_training_set", f"""SELECT url_id, domain, is_malicious, feature_vector FROM
    (SELECT * FROM urls_v WHERE is_malicious IS NOT NULL) LEFT JOIN ({CACHE_SQL}) USING (url_id)
    ORDER BY submission_date DESC, url_id DESC LIMIT 1000""")
def _(t):
    return H.training_set(t.urls_v, t.sql(CACHE_SQL)).select("url_id", "domain", "is_malicious",
                                                             "feature_vector")


def malicious_feeds(t: Tables) -> list[DataFrame]:
    scans = [("phish_json", feeds.scan_json(t.feed_json)), ("phish_csv", feeds.scan_csv(t.feed_csv)),
             ("phish_lines", feeds.scan_lines(t.feed_lines).drop("source")),
             ("malware_csv", feeds.scan_malware_csv(t.feed_malware_csv))]
    return [feeds.url_records(df, name, True).withColumn("source_rank", F.lit(i))
            for i, (name, df) in enumerate(scans)]


@query("feed_union_dedup", """SELECT full_url, arg_min(source, (r, pos)) AS source,
    true AS is_malicious FROM (
      SELECT 'phish_json' AS source, 0 AS r, pos, full_url FROM a_json
      UNION ALL SELECT 'phish_csv', 1, pos, full_url FROM a_csv
      UNION ALL SELECT 'phish_lines', 2, pos, full_url FROM a_lines
      UNION ALL SELECT 'malware_csv', 3, pos, full_url FROM a_malware) GROUP BY 1
    UNION ALL SELECT url, 'top_sites', false FROM pages""")
def _(t):
    benign = feeds.url_records(t.base("pages").selectExpr("url AS full_url", "page_id AS pos"),
                               "top_sites", False).withColumn("source_rank", F.lit(0))
    return B.feed_union_dedup(malicious_feeds(t), benign).select("full_url", "source",
                                                                 "is_malicious")


# --- flows ---------------------------------------------------------------------------------------
CTES["a_flow_urls"] = """SELECT *, CASE WHEN http_host <> '' THEN http_host
      WHEN sni LIKE '%.%' THEN sni
      WHEN rtrim(qname, '.') LIKE '%.%' THEN rtrim(qname, '.') END
      AS domain,
    CASE WHEN http_host <> '' THEN 'http://' || http_host || coalesce(nullif(http_path, ''), '/')
      WHEN sni LIKE '%.%' THEN 'https://' || sni || '/'
      ELSE 'dns://' || rtrim(qname, '.') END AS url FROM flows_v"""


@query("flow_normalize", """SELECT event_id, CASE WHEN transport IN ('TCP', 'UDP') THEN src_port
      ELSE 0 END AS src_port, CASE WHEN transport IN ('TCP', 'UDP') THEN dst_port ELSE 0 END
      AS dst_port, CASE transport WHEN 'TCP' THEN CASE dst_port WHEN 80 THEN 'HTTP'
      WHEN 8080 THEN 'HTTP' WHEN 443 THEN 'HTTPS' ELSE 'TCP' END WHEN 'UDP' THEN
      CASE dst_port WHEN 53 THEN 'DNS' ELSE 'UDP' END ELSE 'OTHER' END AS protocol FROM flows_v""")
def _(t):
    return flows.flow_normalize(t.flows_v).select("event_id", "src_port", "dst_port", "protocol")


@query("flow_normalize_capture", """SELECT event_id, CASE WHEN transport = 'TCP' AND dst_port = 443
      THEN 'HTTPS' WHEN transport = 'TCP' THEN 'HTTP' WHEN transport = 'UDP' AND dst_port = 53
      THEN 'DNS' ELSE 'OTHER' END AS protocol FROM flows_v""")
def _(t):
    return flows.flow_normalize(t.flows_v, "capture").select("event_id", "protocol")


@query("flow_url_extract", "SELECT event_id, url, domain FROM a_flow_urls WHERE domain IS NOT NULL")
def _(t):
    return flows.flow_urls(t.flows_v).select("event_id", "url", "domain")


def quick_sql(tlds, words, least, tld_reason, word_reason) -> str:
    return f"""SELECT event_id, tld IS NOT NULL OR len(kw) >= {least} AS is_threat,
        CASE WHEN tld IS NOT NULL THEN {tld_reason} WHEN len(kw) >= {least} THEN {word_reason}
          ELSE '' END AS reason
      FROM (SELECT event_id, list_filter({q(tlds)}, lambda x: ends_with(domain, x))[1] AS tld,
              list_filter({q(words)}, lambda x: contains(lower(url), x)) AS kw
            FROM a_flow_urls WHERE domain IS NOT NULL)"""


CTES["i_live"] = quick_sql(C.LIVE_TLDS, C.LIVE_KEYWORDS, 2, "'suspicious_tld:' || tld",
                           "'suspicious_keywords:' || array_to_string(kw, ',')")


@query("live_threat_check", "SELECT * FROM i_live")
def _(t):
    from linkguard.operators import rules as R
    return R.live_threat_check(flows.flow_urls(t.flows_v)).select("event_id", "is_threat", "reason")


@query("traffic_threat_check", quick_sql(C.TRAFFIC_TLDS, C.TRAFFIC_KEYWORDS, 1, "'suspicious_tld'",
                                         "'suspicious_keywords'"))
def _(t):
    from linkguard.operators import rules as R
    return R.traffic_threat_check(flows.flow_urls(t.flows_v)).select("event_id", "is_threat",
                                                                     "reason")


# --- DNS and WHOIS --------------------------------------------------------------------------------
def provider_sql(kind: str, table) -> str:
    cases = " ".join(
        "WHEN " + " OR ".join(f"contains(j, '{w}')" for w in words) + f" THEN '{n}'"
        for n, words in table)
    return f"""(SELECT domain, CASE {cases} ELSE 'Other' END AS provider FROM
        (SELECT domain, string_agg(lower(record_value), ' ') AS j FROM dns_v
         WHERE record_type = '{kind}' GROUP BY 1))"""


CTES["e_dns"] = f"""SELECT d.*, m.provider AS mail_provider, n.provider AS dns_provider,
    cast(n_a > 0 AS BIGINT) AS has_a, cast(n_aaaa > 0 AS BIGINT) AS has_aaaa,
    cast(n_mx > 0 AS BIGINT) AS has_mx, cast(n_ns > 0 AS BIGINT) AS has_ns,
    cast(n_txt > 0 AS BIGINT) AS has_txt, cast(n_cname > 0 AS BIGINT) AS has_cname,
    greatest(has_a, has_aaaa, has_mx, has_ns) AS lookup_success
  FROM (SELECT domain, {', '.join(f"count(*) FILTER (record_type = '{k}') AS n_{k.lower()}"
                                  for k in E.COUNTED)},
    {', '.join(f"cast(coalesce(bool_or(record_type = 'TXT' AND record_value ILIKE '%v={k}%'), false) AS BIGINT) AS has_{a}" for a, k in [('spf', 'spf1'), ('dmarc', 'dmarc1'), ('dkim', 'dkim1')])},
    cast(sum(response_time_ms) AS BIGINT) AS resolution_time_ms
    FROM dns_v GROUP BY domain) d
  LEFT JOIN {provider_sql('MX', C.MAIL_PROVIDERS)} m USING (domain)
  LEFT JOIN {provider_sql('NS', C.NS_PROVIDERS)} n USING (domain)"""
DNS_COLS = ["n_a", "n_aaaa", "n_mx", "n_ns", "n_txt", "has_a", "has_aaaa", "has_mx", "has_ns",
            "has_txt", "has_cname", "lookup_success"]


@query("dns_rollup", f"SELECT domain, {', '.join(DNS_COLS)} FROM e_dns")
def _(t):
    return E.dns_by_domain(t.dns_v).select("domain", *DNS_COLS)


@query("dns_email_auth", "SELECT domain, has_spf, has_dmarc, has_dkim FROM e_dns")
def _(t):
    return E.dns_by_domain(t.dns_v).select("domain", "has_spf", "has_dmarc", "has_dkim")


@query("dns_mail_provider", "SELECT domain, mail_provider FROM e_dns")
def _(t):
    return E.dns_by_domain(t.dns_v).select("domain", "mail_provider")


@query("dns_ns_provider", "SELECT domain, dns_provider FROM e_dns")
def _(t):
    return E.dns_by_domain(t.dns_v).select("domain", "dns_provider")


_DNS_FEATURES = ", ".join(
    f"coalesce(cast({e.replace('int(', '(')} AS BIGINT), 0) AS {n}"
    for n, e in E.DNS_FEATURES.items())
CTES["e_dns_features"] = f"""SELECT domain, {_DNS_FEATURES}
    FROM (SELECT DISTINCT domain FROM urls_v) LEFT JOIN e_dns USING (domain)"""


@query("dns_features", "SELECT * FROM e_dns_features")
def _(t):
    return E.dns_features(t.urls_v.select("domain").distinct(), E.dns_by_domain(t.dns_v))


@query("dns_lookup_filter", """SELECT record_id, record_value, ttl FROM dns_v
    WHERE domain = 'docs.python.org' AND record_type = 'MX'""")
def _(t):
    return E.dns_lookup(t.dns_v, "docs.python.org", "MX").select("record_id", "record_value", "ttl")


CTES["e_whois"] = f"""SELECT *, nsc AS nameserver_count,
    coalesce(date_diff('second', creation_date, {NOW}) // 86400, 0) AS domain_age_days,
    cast(coalesce(floor(date_diff('second', {NOW}, expiration_date) / 86400.0), 0) AS BIGINT)
      AS days_until_expiry,
    cast(len(list_filter({q(C.PRIVACY_REGISTRARS)}, lambda w: contains(lower(registrar), w))) > 0
      AND registrar IS NOT NULL AS BIGINT) AS is_privacy_protected,
    cast(regexp_matches(domain, '[.](tk|ml|ga|cf|gq)$') AS BIGINT) AS is_free_tld,
    cast(creation_date IS NOT NULL AND domain_age_days < 30 AS BIGINT) AS is_new_domain,
    cast(expiration_date IS NOT NULL AND days_until_expiry BETWEEN 1 AND 29 AS BIGINT)
      AS is_expiring_soon,
    CASE WHEN is_new_domain = 1 THEN 1 WHEN domain_age_days <> 0 AND domain_age_days < 90 THEN 0.5
      ELSE 0 END::DOUBLE AS new_domain_risk
  FROM (SELECT array_to_string(string_split(domain, '.')[-2:], '.') AS domain,
      min(creation_date) AS creation_date, min(expiration_date) AS expiration_date,
      arg_min(registrar, record_id) FILTER (registrar IS NOT NULL) AS registrar,
      count(DISTINCT rtrim(lower(name_server), '.')) AS nsc FROM whois_v GROUP BY 1)"""
WHOIS_COLS = ["domain_age_days", "days_until_expiry", "is_privacy_protected", "is_free_tld",
              "is_new_domain", "is_expiring_soon", "new_domain_risk", "nameserver_count",
              "registrar"]


@query("whois_rollup", f"SELECT domain, {', '.join(WHOIS_COLS)} FROM e_whois")
def _(t):
    return E.whois_by_domain(t.whois_v, AS_OF).select("domain", *WHOIS_COLS)


CTES["e_whois_features"] = """SELECT d.domain, coalesce(least(domain_age_days, 20000), 0)
      AS domain_age_days, coalesce(days_until_expiry, 0) AS days_until_expiry,
    coalesce(is_new_domain, 0) AS is_new_domain, coalesce(is_expiring_soon, 0) AS is_expiring_soon,
    coalesce(is_privacy_protected, 0) AS is_privacy_protected,
    coalesce(is_free_tld, 0) AS is_free_tld, coalesce(new_domain_risk, 0) AS new_domain_risk,
    coalesce(nameserver_count, 0) AS whois_nameserver_count,
    cast(w.domain IS NOT NULL AS BIGINT) AS whois_success
    FROM (SELECT DISTINCT domain FROM urls_v) d LEFT JOIN e_whois w
      ON w.domain = array_to_string(string_split(d.domain, '.')[-2:], '.')"""


@query("whois_features", "SELECT * FROM e_whois_features")
def _(t):
    return E.whois_features(t.urls_v.select("domain").distinct(),
                            E.whois_by_domain(t.whois_v, AS_OF))


CTES["e_score"] = """SELECT domain, least(40 * is_new_domain + 20 * is_privacy_protected +
    30 * is_free_tld + 10 * is_expiring_soon, 100) AS domain_score FROM e_whois"""


@query("domain_score", "SELECT * FROM e_score")
def _(t):
    return E.domain_score(E.whois_by_domain(t.whois_v, AS_OF))


CTES["e_resolved"] = """SELECT domain, arg_min(record_value, (query_timestamp, record_id))
    AS ip_address FROM dns_v WHERE record_type = 'A' GROUP BY 1"""


@query("domain_resolve", """SELECT domain, ip_address FROM (SELECT DISTINCT domain FROM urls_v)
    LEFT JOIN e_resolved USING (domain)""")
def _(t):
    return E.resolve(t.urls_v.select("domain").distinct(), t.dns_v)


# --- IP intelligence -----------------------------------------------------------------------------
OCTETS = "list_transform(string_split(ip_address, '.'), lambda x: cast(x AS BIGINT))"
ALL_IPS = """SELECT ip_address FROM ips_v UNION SELECT concat('10.0.', p_partkey % 200, '.9')
    FROM part UNION SELECT concat('172.', 10 + p_partkey % 30, '.1.1') FROM part
    UNION SELECT concat('51.15.', p_partkey % 9, '.4') FROM part"""
CTES["f_ips"] = ALL_IPS


def all_ips(t: Tables) -> DataFrame:
    return t.sql(ALL_IPS)


CTES["f_structural"] = f"""SELECT ip_address, o[1] AS octet_1, o[2] AS octet_2, o[3] AS octet_3,
    o[4] AS octet_4, o[1] * 16777216 + o[2] * 65536 + o[3] * 256 + o[4] AS ip_numeric,
    cast(o[1] IN (10, 127) OR (o[1] = 172 AND o[2] BETWEEN 16 AND 31) OR
      (o[1] = 192 AND o[2] = 168) AS BIGINT) AS is_private, 0 AS is_ipv6
    FROM (SELECT ip_address, {OCTETS} AS o FROM f_ips)"""


@query("ip_structural", "SELECT * FROM f_structural")
def _(t):
    return I.structural(all_ips(t)).withColumn("ip_numeric", F.col("ip_numeric").cast("bigint"))


CTES["f_threats"] = """SELECT ip_address, count(*) AS active_threats,
    list_sort(list(DISTINCT threat_type)) AS threat_types, avg(confidence_score) AS avg_confidence
    FROM threats_v WHERE is_active GROUP BY 1"""
CTES["f_history"] = f"""SELECT ip_address, coalesce(threat_score, 0) AS threat_score,
    coalesce(total_requests, 0) AS total_requests,
    coalesce(active_threats, 0) AS active_threats_count,
    cast(active_threats IS NOT NULL AS BIGINT) AS is_known_malicious,
    coalesce(datesub('day', first_seen, {NOW}), 0) AS days_since_first_seen
    FROM f_ips LEFT JOIN ips_v USING (ip_address) LEFT JOIN f_threats USING (ip_address)"""


@query("ip_history_features", "SELECT * FROM f_history")
def _(t):
    return I.history_features(all_ips(t), t.ips_v, t.threats_v, AS_OF)


CTES["f_alerts30"] = f"""SELECT source_ip AS ip_address, count(*) AS n FROM alerts_v
    WHERE ts >= {NOW} - INTERVAL 30 DAY AND ts <= {NOW} GROUP BY 1"""
CTES["f_internal"] = """SELECT p.ip_address, country, city, region, organization, isp, asn,
    nullif(latitude, 0) AS latitude, nullif(longitude, 0) AS longitude,
    coalesce(active_threats, 0) AS active_threats, coalesce(n, 0) AS internal_alerts,
    coalesce(total_requests, 0) AS total_requests,
    array_to_string(coalesce(threat_types, []), ',') AS threat_types,
    CASE WHEN coalesce(n, 0) > 0 THEN least(100, greatest(coalesce(threat_score, 0),
      coalesce(avg_confidence, 0)) + least(n * 5, 40)) ELSE
      greatest(coalesce(threat_score, 0), coalesce(avg_confidence, 0)) END::DOUBLE
      AS internal_threat_score
    FROM f_ips p LEFT JOIN ips_v USING (ip_address) LEFT JOIN f_threats USING (ip_address)
    LEFT JOIN f_alerts30 USING (ip_address)"""


def internal(t: Tables) -> DataFrame:
    return I.internal_reputation(all_ips(t), t.ips_v, t.threats_v, t.alerts_v, AS_OF)


@query("ip_internal_reputation", """SELECT ip_address, round(internal_threat_score, 6)
    AS internal_threat_score, internal_alerts, active_threats, threat_types, total_requests
    FROM f_internal""")
def _(t):
    return internal(t).select(
        "ip_address", F.round("internal_threat_score", 6).alias("internal_threat_score"),
        "internal_alerts", "active_threats", F.concat_ws(",", "threat_types").alias("threat_types"),
        "total_requests")


CTES["f_merged"] = f"""SELECT i.ip_address, i.active_threats, i.internal_alerts,
    i.internal_threat_score,
    CASE WHEN g.country <> '' THEN g.country WHEN i.country <> '' THEN i.country
      ELSE nullif(a.country, '') END AS country,
    CASE WHEN g.country_code <> '' THEN g.country_code WHEN coalesce(i.country, '') = ''
      THEN nullif(a.country, '') END AS country_code,
    coalesce(g.city, i.city) AS city,
    CASE WHEN g.isp <> '' THEN g.isp WHEN i.isp <> '' THEN i.isp ELSE nullif(a.isp, '') END AS isp,
    coalesce(g.org, i.organization) AS organization,
    coalesce(split_part(g.as_text, ' ', 1), i.asn) AS asn,
    coalesce(nullif(g.latitude, 0), i.latitude) AS latitude,
    coalesce(nullif(g.longitude, 0), i.longitude) AS longitude,
    coalesce(a.abuse_score, 0) AS abuse_score, coalesce(a.total_reports, 0) AS total_reports,
    coalesce(g.proxy, false) AS feed_proxy, coalesce(g.hosting, false) AS feed_hosting,
    concat_ws(',', 'internal', CASE WHEN a.ip_address IS NOT NULL THEN 'abuse_feed' END,
      CASE WHEN g.ip_address IS NOT NULL THEN 'geo_feed' END) AS sources
    FROM f_internal i LEFT JOIN abuse_feed_v a ON a.ip_address = i.ip_address
    LEFT JOIN geo_feed_v g ON g.ip_address = i.ip_address"""
MERGED = ["ip_address", "country", "country_code", "city", "isp", "organization", "asn", "latitude",
          "longitude", "abuse_score", "total_reports", "sources"]


def merged(t: Tables) -> DataFrame:
    return I.provider_merge(internal(t), t.abuse_feed_v, t.geo_feed_v)


@query("ip_provider_merge", f"SELECT {', '.join(MERGED)} FROM f_merged")
def _(t):
    return merged(t).withColumn("sources", F.concat_ws(",", "sources")).select(*MERGED)


CTES["f_classed"] = f"""SELECT *, len(list_filter({q(C.TOR_PREFIXES)},
      lambda p: starts_with(ip_address, p))) > 0 AS is_tor,
    coalesce(list_contains({q(C.HOSTING_ASNS)}, upper(asn)), false) AS listed,
    coalesce(list_contains({q(C.VPN_ASNS)}, upper(asn)), false) AS is_vpn,
    feed_hosting OR listed AS is_hosting, feed_proxy OR is_vpn OR is_tor AS is_proxy,
    CASE WHEN is_hosting THEN 0.5 ELSE 0 END + CASE WHEN listed THEN 0.2 ELSE 0 END AS asn_risk,
    CASE WHEN list_contains({q(C.HIGH_RISK_COUNTRIES)}, upper(country_code)) THEN 0.9
      WHEN list_contains({q(C.MEDIUM_RISK_COUNTRIES)}, upper(country_code)) THEN 0.4 ELSE 0 END
      AS country_risk,
    0.35::DOUBLE * (abuse_score / 100) + 0.2::DOUBLE * (internal_threat_score / 100) +
      0.15::DOUBLE * asn_risk::DOUBLE + 0.1::DOUBLE * country_risk::DOUBLE +
      0.1::DOUBLE * least(active_threats / 5, 1::DOUBLE) +
      0.1::DOUBLE * least(internal_alerts / 10, 1::DOUBLE) AS c0,
    CASE WHEN is_tor THEN least(c0 + 0.3::DOUBLE, 1) ELSE c0 END AS c1,
    round((CASE WHEN is_vpn THEN least(c1 + 0.1::DOUBLE, 1) ELSE c1 END)::DOUBLE::VARCHAR
      ::DECIMAL(38, 20), 4)::DOUBLE AS combined_risk
    FROM f_merged"""


@query("ip_tor_prefix", "SELECT ip_address, is_tor FROM f_classed")
def _(t):
    return I.tor_flag(all_ips(t))


@query("ip_asn_class", "SELECT ip_address, is_hosting, is_vpn, is_proxy FROM f_classed")
def _(t):
    return I.asn_class(merged(t)).select("ip_address", "is_hosting", "is_vpn", "is_proxy")


@query("ip_asn_country_risk", """SELECT ip_address, asn_risk::DOUBLE AS asn_risk,
    country_risk::DOUBLE AS country_risk FROM f_classed""")
def _(t):
    return I.asn_country_risk(I.asn_class(merged(t))).select("ip_address", "asn_risk",
                                                             "country_risk")


@query("ip_combined_risk", "SELECT ip_address, combined_risk FROM f_classed")
def _(t):
    return I.combined_risk(I.asn_country_risk(I.asn_class(merged(t)))).select("ip_address",
                                                                              "combined_risk")


GATE = """SELECT ip_address FROM ips_v UNION SELECT concat('10.', p_partkey) FROM part
    UNION SELECT concat('192.168.1.', p_partkey) FROM part UNION SELECT p_name FROM part"""


@query("ip_validity_gate", f"""SELECT ip_address,
    CASE WHEN NOT (ok OR short) THEN 'invalid_ip' END AS error,
    CASE WHEN short OR (ok AND (o[1] IN (10, 127) OR (o[1] = 172 AND o[2] BETWEEN 16 AND 31) OR
      (o[1] = 192 AND o[2] = 168) OR (o[1] = 169 AND o[2] = 254))) THEN 'private_ip' END AS note
    FROM (SELECT ip_address, regexp_full_match(ip_address, '[0-9]+([.][0-9]+){{0,2}}') AS short,
      list_transform(string_split(ip_address, '.'), lambda x: try_cast(x AS BIGINT)) AS o,
      regexp_full_match(ip_address, '[0-9]{{1,3}}([.][0-9]{{1,3}}){{3}}') AND
        list_max(o) <= 255 AS ok FROM ({GATE}))""")
def _(t):
    return I.validity(t.sql(GATE))


def intel(t: Tables, ips: DataFrame | None = None) -> DataFrame:
    return I.intelligence(all_ips(t) if ips is None else ips, t.ips_v, t.threats_v, t.alerts_v,
                          t.abuse_feed_v, t.geo_feed_v, AS_OF)


PRIVATE_INTEL = ("(octet_1 IN (10, 127) OR (octet_1 = 172 AND octet_2 BETWEEN 16 AND 31) OR "
                 "(octet_1 = 192 AND octet_2 = 168) OR (octet_1 = 169 AND octet_2 = 254))")
CTES["f_intel"] = f"""SELECT ip_address, {', '.join(
    f"CASE WHEN {PRIVATE_INTEL} THEN 0 ELSE {e} END AS {n}" for n, e in [
        ('abuse_score', 'abuse_score'), ('total_reports', 'total_reports'),
        ('asn_risk', 'asn_risk::DOUBLE'), ('country_risk', 'country_risk::DOUBLE'),
        ('combined_risk', 'combined_risk'), ('is_hosting', 'cast(is_hosting AS BIGINT)'),
        ('is_vpn', 'cast(is_vpn AS BIGINT)'), ('is_tor', 'cast(is_tor AS BIGINT)'),
        ('is_proxy', 'cast(is_proxy AS BIGINT)'), ('hosting_provider', 'cast(listed AS BIGINT)')])},
    1 - is_private AS intel_available
    FROM f_classed JOIN f_structural USING (ip_address)"""


@query("ip_intel_features", "SELECT * FROM f_intel")
def _(t):
    return I.intel_features(intel(t))


CTES["f_geo"] = f"""SELECT p.ip_address, cast(hit AS BIGINT) AS has_geolocation,
    CASE WHEN hit THEN latitude ELSE 0 END::DOUBLE AS latitude,
    CASE WHEN hit THEN longitude ELSE 0 END::DOUBLE AS longitude,
    CASE WHEN hit THEN len(isp) ELSE 0 END AS isp_length,
    cast(hit AND coalesce(org, '') <> '' AS BIGINT) AS org_exists,
    cast(hit AND coalesce(list_contains({q(C.GEO_FLAG_COUNTRIES)}, country_code), false) AS BIGINT)
      AS geo_country_flag
    FROM (SELECT p.ip_address, g.* EXCLUDE (ip_address), g.ip_address IS NOT NULL AND NOT
            regexp_matches(p.ip_address, '^(192[.]168[.]|10[.]|172[.]16[.]|127[.])') AS hit
          FROM f_ips p LEFT JOIN geo_feed_v g ON g.ip_address = p.ip_address) p"""


@query("geo_features", "SELECT * FROM f_geo")
def _(t):
    return I.geo_features(all_ips(t), t.geo_feed_v)


@query("vt_vote_ratio", """SELECT ip_address, malicious AS malicious_votes,
    malicious + suspicious + harmless + undetected AS total_engines,
    CASE WHEN total_engines > 0 THEN round(malicious / total_engines * 100, 2) ELSE 0 END::DOUBLE
      AS threat_score FROM vt_feed_v""")
def _(t):
    return I.vote_ratio(t.vt_feed_v)


CTES["f_votes"] = """SELECT ip_address, malicious AS m, malicious + suspicious + harmless +
    undetected AS n, CASE WHEN n > 0 THEN round(m / n * 100, 2) ELSE 0 END::DOUBLE AS s
    FROM vt_feed_v"""


@query("feed_enrich_max", """SELECT coalesce(a.ip_address, v.ip_address) AS ip_address,
    greatest(coalesce(abuse_score, 0), coalesce(s, 0))::DOUBLE AS threat_score,
    CASE WHEN coalesce(s, 0) > coalesce(abuse_score, 0) THEN 'vote_feed'
      WHEN abuse_score > 0 THEN 'abuse_feed' END AS source_feed,
    CASE WHEN coalesce(s, 0) > coalesce(abuse_score, 0) THEN 'Votes: ' || m || '/' || n ||
      ' engines' WHEN abuse_score > 0 THEN 'Abuse score: ' || abuse_score || '%' END AS description
    FROM abuse_feed_v a FULL JOIN f_votes v ON v.ip_address = a.ip_address""")
def _(t):
    return I.feed_enrich(t.abuse_feed_v, t.vt_feed_v)


@query("feed_enrich_threats", """SELECT ip_address, 'other' AS threat_type,
    abuse_score::DOUBLE AS confidence_score, 'abuse_feed' AS source_feed FROM abuse_feed_v
    WHERE abuse_score > 50 UNION ALL
    SELECT ip_address, 'malware', s, 'vote_feed' FROM f_votes WHERE s > 30""")
def _(t):
    return I.feed_threats(t.abuse_feed_v, t.vt_feed_v)


CTES["f_reputation"] = """SELECT p.ip_address, CASE WHEN i.threat_score > 0 THEN i.threat_score
      ELSE coalesce(abuse_score, 0) END::DOUBLE AS threat_score,
    CASE WHEN i.threat_score > 0 THEN i.threat_score > 50 ELSE coalesce(abuse_score > 30, false) END
      AS is_malicious,
    CASE WHEN i.threat_score > 0 THEN 'database' WHEN a.ip_address IS NOT NULL THEN 'abuse_feed' END
      AS source
    FROM f_ips p LEFT JOIN ips_v i ON i.ip_address = p.ip_address
    LEFT JOIN abuse_feed_v a ON a.ip_address = p.ip_address"""


def reputation(t: Tables) -> DataFrame:
    return I.reputation(all_ips(t), t.ips_v, t.abuse_feed_v)


@query("ip_reputation_lookup", "SELECT * FROM f_reputation")
def _(t):
    return reputation(t)


@query("ip_threat_summary", """SELECT ip_address, threat_score, alert_count, traffic_count,
    CASE WHEN r > 80 THEN 'CRITICAL' WHEN r > 50 THEN 'HIGH' WHEN r > 30 THEN 'MEDIUM'
      WHEN r > 10 THEN 'LOW' ELSE 'SAFE' END AS risk_level FROM (
    SELECT *, threat_score + 10 * alert_count AS r FROM (SELECT ip_address, threat_score,
      (SELECT count(*) FROM alerts_v WHERE source_ip = ip_address) AS alert_count,
      (SELECT count(*) FROM traffic_v WHERE src_ip = ip_address) AS traffic_count
      FROM f_reputation))""")
def _(t):
    return I.threat_summary(reputation(t), t.alerts_v, t.traffic_v).select(
        "ip_address", "threat_score", "alert_count", "traffic_count", "risk_level")


@query("alert_reputation_hook", """SELECT alert_id, source_ip, threat_score FROM alerts_v
    JOIN f_reputation ON source_ip = ip_address WHERE is_malicious""")
def _(t):
    from linkguard.operators import alerts as A
    return A.reputation_hook(t.alerts_v, reputation(t)).select("alert_id", "source_ip",
                                                               "threat_score")


@query("ip_threat_profile", """SELECT i.ip_address, country, city, threat_score, total_requests,
    coalesce(tc, 0) AS threat_count, tt AS threat_types, coalesce(ac, 0) AS alert_count,
    coalesce(lc, 0) AS traffic_count FROM ips_v i
    LEFT JOIN (SELECT ip_address, count(DISTINCT threat_id) AS tc, array_to_string(list_sort(
      list(DISTINCT threat_type)), ',') AS tt FROM threats_v WHERE is_active GROUP BY 1) USING
      (ip_address)
    LEFT JOIN (SELECT source_ip AS ip_address, count(*) AS ac FROM alerts_v GROUP BY 1) USING
      (ip_address)
    LEFT JOIN (SELECT ip_address, count(DISTINCT log_id) AS lc FROM (SELECT log_id, src_ip AS
      ip_address FROM traffic_v UNION SELECT log_id, dst_ip FROM traffic_v) GROUP BY 1) USING
      (ip_address)""")
def _(t):
    return I.threat_profile(t.ips_v, t.threats_v, t.alerts_v, t.traffic_v)


IP_COLS = ["ip_address", "country", "threat_score", "total_requests"]


@query("ip_by_country", f"SELECT {', '.join(IP_COLS)} FROM ips_v WHERE country = 'NATION_3'")
def _(t):
    return I.by_country(t.ips_v, "NATION_3").select(*IP_COLS)


@query("ip_high_threat", f"""SELECT {', '.join(IP_COLS)} FROM ips_v WHERE threat_score >= 50
    ORDER BY threat_score DESC, ip_address LIMIT 100""")
def _(t):
    return I.high_threat(t.ips_v).select(*IP_COLS)


@query("ip_get", f"SELECT {', '.join(IP_COLS)} FROM ips_v WHERE ip_address = '30.0.0.39'")
def _(t):
    return t.ips_v.where("ip_address = '30.0.0.39'").select(*IP_COLS)


@query("ip_score_band", """SELECT ip_address, threat_score, CASE WHEN threat_score > 50
    THEN 'CRITICAL' WHEN threat_score > 30 THEN 'HIGH' WHEN threat_score > 15 THEN 'MEDIUM'
    ELSE 'SAFE' END AS band FROM ips_v""")
def _(t):
    return I.score_band(t.ips_v).select("ip_address", "threat_score", "band")


# --- traffic features -------------------------------------------------------------------------------
CTES["g_top"] = """SELECT *, row_number() OVER (PARTITION BY ip_address ORDER BY ts DESC,
    log_id DESC) AS rank FROM (SELECT *, src_ip AS ip_address FROM traffic_v UNION
    SELECT *, dst_ip FROM traffic_v)"""
CTES["g_features"] = f"""SELECT ip_address,
    round(count(*) FILTER (ts >= {NOW} - INTERVAL 600 MINUTE) / 600, 2) AS request_frequency,
    count(DISTINCT dst_ip) AS unique_destinations, count(DISTINCT protocol) AS protocol_diversity,
    round(count(*) FILTER (protocol = 'HTTPS') / count(*), 4) AS https_ratio,
    round(coalesce(avg(nullif(payload_size, 0)), 0), 2) AS avg_payload_size,
    round(least(count(DISTINCT nullif(dst_port, 0)) / 50, 1), 4)
      AS port_scan_likelihood,
    round(CASE WHEN count(*) < 2 THEN 0 WHEN avg(gap) = 0 THEN 1 ELSE stddev_pop(gap) / avg(gap)
      END, 4)::DOUBLE AS traffic_burstiness
    FROM (SELECT *, date_diff('microsecond', lag(ts) OVER (PARTITION BY ip_address ORDER BY ts,
      log_id), ts) / 1e6 AS gap FROM g_top) GROUP BY 1"""


@query("traffic_by_ip", "SELECT ip_address, log_id, rank FROM g_top WHERE rank <= 20")
def _(t):
    return G.traffic_by_ip(t.traffic_v, 20).select("ip_address", "log_id", "rank")


def traffic_features(t: Tables) -> DataFrame:
    return G.traffic_features(G.flow_ends(t.traffic_v), AS_OF, 600)


@query("traffic_features", "SELECT * FROM g_features")
def _(t):
    return traffic_features(t)


for _name, _col in [("tf_request_frequency", "request_frequency"),
                    ("tf_unique_destinations", "unique_destinations"),
                    ("tf_protocol_diversity", "protocol_diversity"),
                    ("tf_https_ratio", "https_ratio"), ("tf_avg_payload", "avg_payload_size"),
                    ("tf_port_scan", "port_scan_likelihood"),
                    ("tf_burstiness", "traffic_burstiness")]:
    @query(_name, f"SELECT ip_address, {_col} FROM g_features")
    def _(t, _col=_col):
        return traffic_features(t).select("ip_address", _col)


# --- assembly ---------------------------------------------------------------------------------------
def feature_table(t: Tables) -> DataFrame:
    return H.feature_table(t.urls_v, t.dns_v, t.whois_v, t.ips_v, t.threats_v, t.alerts_v,
                           t.abuse_feed_v, t.geo_feed_v, t.traffic_v, AS_OF)


CTES["g_features60"] = CTES["g_features"].replace("600", "60")
CTES["f_ips_h"] = "SELECT DISTINCT ip_address FROM e_resolved"
H_MAP = {"f_ips": "f_ips_h", "f_structural": "h_structural", "f_history": "h_history",
         "f_internal": "h_internal", "f_merged": "h_merged", "f_classed": "h_classed",
         "f_intel": "h_intel", "f_geo": "h_geo"}


def _rename(sql: str) -> str:
    import re
    return re.sub(r"\bf_\w+\b", lambda m: H_MAP.get(m.group(0), m.group(0)), sql)


for _a, _b in H_MAP.items():
    if _a != "f_ips":
        CTES[_b] = _rename(CTES[_a])
H_COLS = [c for c in H.FEATURES]
CTES["h_features"] = f"""SELECT u.url_id, u.domain, {', '.join(
    f'coalesce({s}.{c}, 0) AS {c}' for s, cols in [
        ('c', U.URL_FEATURES), ('d', list(E.DNS_FEATURES)), ('w', list(E.WHOIS_FEATURES)),
        ('s', H.STRUCTURAL), ('y', H.HISTORY), ('n', list(I.INTEL_FEATURES)), ('o', H.GEO),
        ('g', G.TRAFFIC_FEATURES)] for c in cols)}
    FROM urls_v u JOIN c_features c USING (url_id) JOIN e_dns_features d USING (domain)
    JOIN e_whois_features w USING (domain) LEFT JOIN e_resolved r USING (domain)
    LEFT JOIN h_structural s ON s.ip_address = r.ip_address
    LEFT JOIN h_history y ON y.ip_address = r.ip_address
    LEFT JOIN h_intel n ON n.ip_address = r.ip_address
    LEFT JOIN h_geo o ON o.ip_address = r.ip_address
    LEFT JOIN g_features60 g ON g.ip_address = r.ip_address"""


@query("feature_assemble", "SELECT * FROM h_features")
def _(t):
    return feature_table(t).withColumn("ip_numeric", F.col("ip_numeric").cast("bigint"))


@query("feature_assemble_stats", f"""SELECT count(*) AS total_processed, 0 AS total_failed,
    count(*) * 52 AS url_features, count(*) * 21 AS dns_features, count(*) * 9 AS domain_features,
    count(*) FILTER (dns_lookup_success = 0) AS dns_lookup_failures,
    count(*) FILTER (whois_success = 0) AS whois_lookup_failures FROM h_features""")
def _(t):
    return H.feature_stats(feature_table(t), t.urls_v)


# --- scan with all stored signals ----------------------------------------------------------------------
def ip_by_domain(t: Tables) -> DataFrame:
    doms = E.resolve(t.dns_v.select(F.expr(E.clean_domain()).alias("domain")).distinct(), t.dns_v)
    return doms.join(intel(t, doms.where("ip_address IS NOT NULL")), "ip_address").selectExpr(
        "domain AS registered_domain", "combined_risk", "abuse_score", "is_tor", "is_vpn",
        "is_hosting", "country AS ip_country")


CTES["s_full_signals"] = """SELECT s.* EXCLUDE (ip_score, domain_score, threat_score),
    combined_risk * 100 AS ip_score, abuse_score::DOUBLE AS threat_score,
    CASE WHEN highest_risk > 0 THEN greatest(coalesce(e.domain_score, 0), highest_risk)
      ELSE e.domain_score END::DOUBLE AS domain_score
    FROM s_signals s LEFT JOIN (SELECT domain, i.* FROM e_resolved JOIN h_intel i USING (ip_address))
      x ON x.domain = s.registered_domain AND x.domain <> '' LEFT JOIN e_score e ON e.domain = s.registered_domain
      AND e.domain <> ''"""
CTES |= fuse_ctes("sf_", "s_full_signals")


def full_scan(t: Tables) -> DataFrame:
    score = E.domain_score(E.whois_by_domain(t.whois_v, AS_OF)).selectExpr(
        "domain AS registered_domain", "cast(domain_score as double) AS domain_score")
    return S.scan_batch(t.url_corpus, ip=ip_by_domain(t), domains=score)


@query("risk_signals", """SELECT url_id, round(rule_score, 4) AS rule_score, ip_score, domain_score,
    threat_score FROM s_full_signals""")
def _(t):
    return full_scan(t).select("url_id", F.col("rule_score"), "ip_score", "domain_score",
                               "threat_score").withColumn("rule_score", F.round("rule_score", 4))


@query("scan_batch_intel", """SELECT url_id, prediction, confidence, verdict,
    round(risk_score, 2) AS risk_score FROM sf_fused""")
def _(t):
    return full_scan(t).select("url_id", "prediction", "confidence", "verdict", "risk_score")


EVIDENCE_SQL = """SELECT url_id, CASE WHEN ev <> '' THEN ev ELSE array_to_string(list_transform(
      list_filter(string_split(reasons, '|'), lambda r: r <> ''),
      lambda r: 'Rule triggered: ' || r), chr(10)) END AS evidence
    FROM (SELECT *, concat_ws(chr(10),
      CASE WHEN rule_score >= 30 THEN 'Rule engine score: ' ||
        cast(round(round(rule_score, 2)) AS BIGINT) || '/100' END,
      array_to_string(list_transform(items, lambda m: 'Typosquatting: mimics ' ||
        upper(m.brand) || ' (similarity ' || cast(round(m.similarity * 100) AS BIGINT) || '%, ' ||
        replace(m.technique, '_', ' ') || ')'), chr(10)),
      CASE WHEN is_punycode THEN 'Punycode/IDN domain detected' END,
      CASE WHEN has_unicode THEN 'Unicode characters in hostname' END,
      CASE WHEN has_at_symbol THEN '@ symbol in URL (redirect trick)' END,
      CASE WHEN has_double_encoding THEN 'Double URL encoding detected' END,
      CASE WHEN is_ip_host THEN 'IP address used as host' END,
      CASE WHEN percent_encoding_count > 5 THEN 'Heavy URL encoding: ' || percent_encoding_count
        || ' chars' END) AS ev FROM s_fused)"""


@query("evidence_list", EVIDENCE_SQL)
def _(t):
    return S.evidence_list(S.scan_batch(t.url_corpus)).select(
        "url_id", F.concat_ws("\n", "evidence").alias("evidence"))


def kept(t: Tables, rows: DataFrame, table: str, *more: DataFrame) -> DataFrame:
    """Rows as a sink table holds them after appending, read back."""
    path = shared_folder(t.spark, table)
    for part in (rows, *more):
        sinks.append(part, table, path)
    return t.spark.read.parquet(path)


@query("prediction_sink", """SELECT url_id, confidence AS prediction_score,
    prediction AS predicted_class, 'rules' AS model_name, 'latest' AS model_version FROM s_fused""")
def _(t):
    return kept(t, sinks.prediction_rows(S.scan_batch(t.url_corpus), "rules")[1], "model_predictions")


@query("prediction_sink_urls", """SELECT raw_url AS full_url, CASE WHEN registered_domain <> ''
    THEN registered_domain ELSE hostname END AS domain, path, scheme AS protocol, tld,
    len(raw_url) AS url_length, 'real_time_prediction' AS source, url_id FROM s_fused""")
def _(t):
    return kept(t, sinks.prediction_rows(S.scan_batch(t.url_corpus), "rules")[0], "urls").drop("is_malicious", "seq")


@query("append_sinks", """SELECT attempt_id, CASE WHEN alert_type IN ('malicious_url',
    'suspicious_ip', 'high_traffic', 'dns_anomaly') THEN alert_type ELSE 'other' END AS alert_type,
    CASE WHEN severity = 'urgent' THEN 'low' ELSE severity END AS severity FROM alert_attempts""")
def _(t):
    half = [t.alert_attempts.where(f"attempt_id % 2 = {i}") for i in (0, 1)]
    return kept(t, half[0], "alerts", half[1]).select("attempt_id", "alert_type", "severity")


@query("export_csv", """SELECT severity, status, NULL::BOOLEAN AS is_malicious, count(*) AS n
    FROM alerts_v GROUP BY 1, 2 UNION ALL SELECT NULL, NULL, is_malicious, count(*) FROM urls_v
    WHERE is_malicious IS NOT NULL GROUP BY 3""")
def _(t):
    a = t.alerts_v.groupBy("severity", "status").agg(F.count("*").alias("n"))
    u = t.urls_v.where("is_malicious IS NOT NULL").groupBy("is_malicious").agg(
        F.count("*").alias("n"))
    path = shared_folder(t.spark, "export_csv")
    sinks.export_csv(path, a, u)
    return t.spark.read.option("header", True).csv(path, schema="severity string, status string, n long, is_malicious boolean")


@query("export_json", """SELECT cast(to_json(struct_pack(url := raw_url, prediction := prediction,
    verdict := verdict, rule_result := rule_result)) AS VARCHAR) AS line FROM s_fused""")
def _(t):
    path = shared_folder(t.spark, "export_json")
    sinks.export_json(path, S.scan_batch(t.url_corpus).select("url", "prediction", "verdict", "rule_result"))
    return t.spark.read.text(path).withColumnRenamed("value", "line")


# --- destination policy -----------------------------------------------------------------------------
EG_URLS = """SELECT url_id, CASE url_id % 24 WHEN 0 THEN concat('http://', url_id % 4294967296)
    WHEN 1 THEN 'http://0x7f000001/' WHEN 2 THEN '' WHEN 3 THEN concat('ftp://x', url_id, '.com/')
    WHEN 4 THEN 'http://localhost/a' WHEN 5 THEN concat('http://printer', url_id, '.local/')
    WHEN 6 THEN 'http://0177.0.0.1/' WHEN 7 THEN 'http://169.254.169.254/latest'
    WHEN 8 THEN 'http:///nohost' WHEN 9 THEN 'http://8.8.8.8/dns' WHEN 10 THEN 'http://224.0.0.5/'
    WHEN 11 THEN 'http://134744072/' ELSE full_url END AS full_url FROM url_corpus"""
CTES["l_syntax"] = f"""SELECT *, CASE WHEN full_url = '' THEN 'invalid_input'
      WHEN len(full_url) > 4096 THEN 'url_too_long'
      WHEN scheme NOT IN ('http', 'https') THEN 'blocked_scheme:' || scheme
      WHEN hostname = '' THEN 'missing_hostname'
      WHEN list_contains({q(C.BLOCKED_HOSTS)}, hostname) THEN 'blocked_hostname'
      WHEN sfx IS NOT NULL THEN 'blocked_suffix:' || sfx END AS syntax_reason
    FROM (SELECT *, lower(regexp_extract(p, '^([a-zA-Z][a-zA-Z0-9+.-]*):', 1)) AS scheme,
      lower(regexp_extract(p, '^[^:/]+://([^/?#]*@)?([^:/?#]*)', 2)) AS hostname,
      list_filter({q(C.BLOCKED_SUFFIXES)}, lambda s: ends_with(hostname, s))[1] AS sfx
      FROM (SELECT url_id, full_url, CASE WHEN full_url LIKE '%://%' THEN full_url
            ELSE 'http://' || full_url END AS p FROM ({EG_URLS})))"""


def eg_urls(t: Tables) -> DataFrame:
    return t.sql(EG_URLS)


@query("eg_syntax", "SELECT url_id, hostname, syntax_reason FROM l_syntax")
def _(t):
    return L.syntax(eg_urls(t)).select("url_id", "hostname", "syntax_reason")


CTES["l_decoded"] = """SELECT *, CASE WHEN num BETWEEN 0 AND 4294967295 THEN
      concat_ws('.', num // 16777216, num // 65536 % 256, num // 256 % 256, num % 256) END
      AS decoded_ip
    FROM (SELECT *, CASE WHEN regexp_full_match(hostname, '[0-9]+') THEN
        try_cast(hostname AS BIGINT)
      WHEN regexp_full_match(hostname, '0x[0-9a-f]{1,8}') THEN cast(hostname AS BIGINT)
      WHEN regexp_full_match(hostname, '[0-9]+([.][0-9]+){3}') THEN list_reduce(list_transform(
        string_split(hostname, '.'), lambda x: CASE WHEN starts_with(x, '0') THEN
          list_reduce(list_transform(string_split(x, ''), lambda c: cast(c AS BIGINT)),
            lambda a, b: a * 8 + b) ELSE cast(x AS BIGINT) END), lambda a, b: a * 256 + b) END
      AS num FROM l_syntax)"""
CTES["l_class"] = """SELECT ip, CASE WHEN ip IN ('169.254.169.254', '100.100.100.200')
      THEN 'cloud_metadata_endpoint' WHEN o[1] = 127 THEN 'loopback'
      WHEN o[1] IN (0, 10) OR o[1] >= 240 OR (o[1] = 169 AND o[2] = 254)
          OR (o[1] = 172 AND o[2] BETWEEN 16 AND 31) OR (o[1] = 192 AND o[2] = 168)
          OR (o[1] = 198 AND o[2] IN (18, 19)) OR (o[1] = 192 AND o[2] = 0 AND o[3] IN (0, 2))
          OR (o[1] = 198 AND o[2] = 51 AND o[3] = 100) OR (o[1] = 203 AND o[2] = 0 AND o[3] = 113)
        THEN 'private_range' WHEN o[1] BETWEEN 224 AND 239 THEN 'multicast' END AS ip_reason
    FROM (SELECT ip, list_transform(string_split(ip, '.'), lambda x: cast(x AS BIGINT)) AS o FROM (
      SELECT decoded_ip AS ip FROM l_decoded WHERE decoded_ip IS NOT NULL
      UNION SELECT record_value FROM dns_v WHERE record_type = 'A'))"""


@query("eg_ip_decode", "SELECT url_id, hostname, decoded_ip FROM l_decoded")
def _(t):
    return L.decode_ip(L.syntax(eg_urls(t))).select("url_id", "hostname", "decoded_ip")


@query("eg_ip_class", "SELECT ip, ip_reason FROM l_class")
def _(t):
    hosts = L.decode_ip(L.syntax(eg_urls(t))).where("decoded_ip IS NOT NULL").selectExpr(
        "decoded_ip AS ip")
    a = t.dns_v.where("record_type = 'A'").selectExpr("record_value AS ip")
    return L.classify_ip(hosts.union(a).distinct())


CTES["l_resolved"] = """SELECT domain AS hostname, count(*) AS n,
    min(ip) FILTER (ip_reason IS NOT NULL) AS bad,
    arg_min(ip_reason, ip) FILTER (ip_reason IS NOT NULL) AS why FROM (
      SELECT DISTINCT domain, record_value AS ip, ip_reason FROM dns_v JOIN l_class
        ON ip = record_value WHERE record_type = 'A'
      UNION ALL SELECT DISTINCT domain, record_value, NULL FROM dns_v WHERE record_type = 'AAAA')
    GROUP BY 1"""


def policy_ctes(p: str, decoded: str) -> dict[str, str]:
    return {p: f"""SELECT d.*, coalesce(decoded_ip, d.hostname) AS host, CASE
        WHEN syntax_reason IS NOT NULL THEN syntax_reason
        WHEN decoded_ip IS NOT NULL THEN 'encoded_ip:' || c.ip_reason
        WHEN r.n IS NULL THEN 'dns_resolution_failed'
        ELSE 'resolved_to_' || why END AS reason,
      CASE WHEN syntax_reason IS NOT NULL THEN NULL WHEN decoded_ip IS NOT NULL THEN
        CASE WHEN c.ip_reason IS NOT NULL THEN decoded_ip END ELSE bad END AS blocked_ip
      FROM {decoded} d LEFT JOIN l_class c ON c.ip = decoded_ip
      LEFT JOIN l_resolved r ON r.hostname = d.hostname"""}


CTES |= policy_ctes("l_policy", "l_decoded")


@query("eg_resolved", "SELECT url_id, reason IS NULL AS is_safe, reason, blocked_ip FROM l_policy")
def _(t):
    return L.egress_policy(eg_urls(t), t.dns_v).select("url_id", "is_safe", "reason", "blocked_ip")


# every third run of eight URLs is a chain of eight hops, the others are two chains of four
CTES["l_hops"] = """SELECT url_id, CASE WHEN url_id // 8 % 3 = 0 THEN url_id // 8 ELSE 1000000000 + url_id // 4 END
    AS chain_id, CASE WHEN url_id // 8 % 3 = 0 THEN url_id % 8 ELSE url_id % 4 END AS hop FROM l_policy"""


@query("eg_redirect_chain", """SELECT chain_id, count(*) AS hops,
    bool_and(reason IS NULL) AND max(hop) <= 6 AS is_safe,
    min(hop) FILTER (reason IS NOT NULL AND hop <= 6) AS blocked_hop,
    coalesce(arg_min(reason, hop) FILTER (reason IS NOT NULL AND hop <= 6),
      CASE WHEN max(hop) > 6 THEN 'too_many_redirects' END) AS reason
    FROM l_policy JOIN l_hops USING (url_id) GROUP BY 1""")
def _(t):
    hops = eg_urls(t).selectExpr(
        "CASE WHEN url_id div 8 % 3 = 0 THEN url_id div 8 ELSE 1000000000 + url_id div 4 END AS chain_id",
        "cast(CASE WHEN url_id div 8 % 3 = 0 THEN url_id % 8 ELSE url_id % 4 END as int) AS hop", "full_url")
    return L.redirect_chain(hops, t.dns_v)
