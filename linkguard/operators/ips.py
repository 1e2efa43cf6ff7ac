"""IP features, reputation and the merge of provider tables; one row per address."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from linkguard import constants as C
from linkguard.functions import ip as IP
from linkguard.functions.sqlutil import add, in_list
from linkguard.operators.alerts import since


def structural(ips: DataFrame) -> DataFrame:
    """Privacy, version, number and octets of ``ip_address``."""
    df = IP.add_v6(ips, "ip_address", "_v6")
    df = add(df, _n=IP.v4_number("ip_address"))
    octet = ("CASE WHEN contains(ip_address, ':') THEN 0 ELSE "
             "coalesce(try_cast(split_part(ip_address, '.', {}) as int), 0) END")
    return add(df, is_private=f"int(coalesce({IP.in_ranges('_n', IP.FEATURE_PRIVATE_V4)}, false))",
               is_ipv6="int(contains(ip_address, ':'))",
               # a double: exact for IPv4, and IPv6 numbers do not fit any integer type
               ip_numeric="coalesce(cast(_n as double), aggregate(_v6, 0D, "
                          "(acc, x) -> acc * 65536D + x), 0D)",
               **{f"octet_{i}": octet.format(i) for i in range(1, 5)}).drop("_n", "_v6")


def active_threats(threats: DataFrame) -> DataFrame:
    return threats.where("is_active").groupBy("ip_address").agg(
        F.count("*").alias("active_threats"),
        F.array_sort(F.collect_set("threat_type")).alias("threat_types"),
        F.avg(F.coalesce("confidence_score", F.lit(0.0))).alias("avg_confidence"))


def history_features(ips: DataFrame, table: DataFrame, threats: DataFrame, as_of: str) -> DataFrame:
    known = table.select("ip_address", "threat_score", "total_requests", "first_seen")
    df = ips.select("ip_address").join(known, "ip_address", "left").join(
        active_threats(threats).select("ip_address", "active_threats"), "ip_address", "left")
    return df.selectExpr(
        "ip_address", "coalesce(threat_score, 0D) AS threat_score",
        "coalesce(total_requests, 0) AS total_requests",
        "coalesce(active_threats, 0) AS active_threats_count",
        "int(coalesce(active_threats, 0) > 0) AS is_known_malicious",
        f"coalesce(timestampdiff(DAY, first_seen, TIMESTAMP_NTZ '{as_of}'), 0) "
        "AS days_since_first_seen")


def internal_reputation(ips: DataFrame, table: DataFrame, threats: DataFrame, alerts: DataFrame,
                        as_of: str) -> DataFrame:
    """Three aggregates per address, then left joins of single rows."""
    recent = alerts.where(since("ts", as_of, 30, "DAY")).groupBy(
        F.col("source_ip").alias("ip_address")).agg(F.count("*").alias("internal_alerts"))
    known = table.select("ip_address", "country", "city", "region", "latitude", "longitude", "asn",
                         "organization", "isp", "threat_score", "total_requests")
    df = (ips.select("ip_address").join(known, "ip_address", "left")
          .join(active_threats(threats), "ip_address", "left")
          .join(recent, "ip_address", "left"))
    df = add(df, internal_alerts="coalesce(internal_alerts, 0)",
             active_threats="coalesce(active_threats, 0)",
             threat_types="coalesce(threat_types, cast(array() as array<string>))",
             total_requests="coalesce(total_requests, 0)",
             latitude="CASE WHEN latitude <> 0 THEN latitude END",
             longitude="CASE WHEN longitude <> 0 THEN longitude END",
             base="greatest(coalesce(threat_score, 0D), coalesce(avg_confidence, 0D))")
    return add(df, internal_threat_score="CASE WHEN internal_alerts > 0 THEN least(100D, base + "
                                         "least(internal_alerts * 5, 40)) ELSE base END",
               ).drop("base", "threat_score", "avg_confidence")


GEO = ["country", "country_code", "region", "city", "latitude", "longitude", "isp",
       "organization", "asn"]


def provider_merge(internal: DataFrame, abuse: DataFrame, geo: DataFrame) -> DataFrame:
    """Internal data first; the abuse feed fills gaps; the geo feed overrides where it has text."""
    a = abuse.select("ip_address", "abuse_score", "total_reports", F.col("country").alias("a_cc"),
                     F.col("isp").alias("a_isp"), F.lit(True).alias("has_abuse"))
    g = geo.select(
        "ip_address", *[F.col(c).alias(f"g_{c}") for c in
                        ("country", "country_code", "city", "latitude", "longitude", "isp")],
        F.col("org").alias("g_organization"), F.lit(None).cast("string").alias("g_region"),
        F.expr("substring_index(as_text, ' ', 1)").alias("g_asn"), F.col("proxy").alias("g_proxy"),
        F.col("hosting").alias("g_hosting"), F.lit(True).alias("has_geo"))
    df = internal.join(a, "ip_address", "left").join(g, "ip_address", "left")
    text = "coalesce(nullif(g_{0}, ''), {1})"
    number = "coalesce(nullif(g_{0}, 0D), {0})"
    df = add(df, i_country="country", i_isp="isp")
    return add(
        df, country=text.format("country", "nullif(i_country, ''), nullif(a_cc, ''), i_country"),
        country_code="coalesce(nullif(g_country_code, ''), CASE WHEN nullif(i_country, '') IS NULL "
                     "THEN nullif(a_cc, '') END)",
        isp=text.format("isp", "nullif(i_isp, ''), nullif(a_isp, ''), i_isp"),
        region=text.format("region", "region"), city=text.format("city", "city"),
        organization=text.format("organization", "organization"), asn=text.format("asn", "asn"),
        latitude=number.format("latitude"), longitude=number.format("longitude"),
        abuse_score="coalesce(abuse_score, 0)", total_reports="coalesce(total_reports, 0)",
        feed_proxy="coalesce(g_proxy, false)", feed_hosting="coalesce(g_hosting, false)",
        sources="filter(array('internal', CASE WHEN has_abuse THEN 'abuse_feed' END, "
                "CASE WHEN has_geo THEN 'geo_feed' END), s -> s IS NOT NULL)",
    ).drop("a_cc", "a_isp", "has_abuse", "has_geo", "i_country", "i_isp", "g_proxy", "g_hosting",
           *[f"g_{c}" for c in GEO])


def tor_flag(ips: DataFrame) -> DataFrame:
    """Known exit prefixes are whole octet pairs: compare the first two octets."""
    pairs = [p.rstrip(".") for p in C.TOR_PREFIXES]
    return add(ips, is_tor="contains(ip_address, '.') AND substring_index(ip_address, '.', 3) <> "
                           "substring_index(ip_address, '.', 2) AND "
                           + in_list("substring_index(ip_address, '.', 2)", pairs))


def asn_class(merged: DataFrame) -> DataFrame:
    df = tor_flag(merged)
    df = add(df, listed_hosting=f"coalesce({in_list('upper(asn)', C.HOSTING_ASNS)}, false)",
             is_vpn=f"coalesce({in_list('upper(asn)', C.VPN_ASNS)}, false)")
    return add(df, is_hosting="feed_hosting OR listed_hosting",
               is_proxy="feed_proxy OR is_vpn OR is_tor")


def asn_country_risk(classed: DataFrame) -> DataFrame:
    return add(classed, asn_risk="least(CASE WHEN is_hosting THEN 0.5D ELSE 0D END + "
                                 "CASE WHEN listed_hosting THEN 0.2D ELSE 0D END, 1D)",
               country_risk=f"CASE WHEN {in_list('upper(country_code)', C.HIGH_RISK_COUNTRIES)} "
                            f"THEN 0.9D WHEN "
                            f"{in_list('upper(country_code)', C.MEDIUM_RISK_COUNTRIES)} "
                            "THEN 0.4D ELSE 0D END")


def combined_risk(df: DataFrame) -> DataFrame:
    w = C.COMBINED_RISK_WEIGHTS
    df = add(df, _c=f"{w['abuse']}D * (abuse_score / 100D) + "
                    f"{w['internal']}D * (internal_threat_score / 100D) + {w['asn']}D * asn_risk + "
                    f"{w['country']}D * country_risk + "
                    f"{w['threats']}D * least(active_threats / 5D, 1D) + "
                    f"{w['alerts']}D * least(internal_alerts / 10D, 1D)")
    df = add(df, _c="CASE WHEN is_tor THEN least(_c + 0.3D, 1D) ELSE _c END")
    return add(df, combined_risk="round(CASE WHEN is_vpn THEN least(_c + 0.1D, 1D) ELSE _c END, 4)"
               ).drop("_c")


def validity(ips: DataFrame) -> DataFrame:
    """``error`` for text that is no IPv4 address, ``note`` for private ones (no lookup is made).
    Shortened dotted forms count as addresses and then as private."""
    loose = "ip_address RLIKE '^[0-9]+([.][0-9]+){0,3}$'"
    df = add(ips, _n=IP.v4_number("ip_address"))
    df = add(df, _short=f"{loose} AND size(split(ip_address, '[.]')) < 4")
    return add(
        df, error="CASE WHEN _n IS NULL AND NOT _short THEN 'invalid_ip' END",
        note=f"CASE WHEN _short OR {IP.in_ranges('_n', IP.INTEL_PRIVATE_V4)} THEN 'private_ip' END",
    ).drop("_n", "_short")


def intelligence(ips: DataFrame, table, threats, alerts, abuse, geo, as_of: str) -> DataFrame:
    """The unified record per address; invalid and private addresses get the zero record."""
    gate = validity(ips.select("ip_address").distinct())
    checked = gate.where("error IS NULL AND note IS NULL").select("ip_address")
    internal = internal_reputation(checked, table, threats, alerts, as_of)
    full = combined_risk(asn_country_risk(asn_class(provider_merge(internal, abuse, geo))))
    return gate.join(full, "ip_address", "left").na.fill(0, [
        "abuse_score", "total_reports", "internal_threat_score", "internal_alerts",
        "active_threats", "asn_risk", "country_risk", "combined_risk"]).na.fill(
        False, ["is_hosting", "is_vpn", "is_tor", "is_proxy", "listed_hosting"])


INTEL_FEATURES = {
    "abuse_score": "int(abuse_score)", "total_reports": "int(total_reports)",
    "asn_risk": "asn_risk", "country_risk": "country_risk", "combined_risk": "combined_risk",
    "is_hosting": "int(is_hosting)", "is_vpn": "int(is_vpn)", "is_tor": "int(is_tor)",
    "is_proxy": "int(is_proxy)", "hosting_provider": "int(listed_hosting)",
    "intel_available": "int(NOT feature_private)",
}


def intel_features(intel: DataFrame) -> DataFrame:
    """Eleven features; addresses in the four private blocks get zeros."""
    df = add(intel, _n=IP.v4_number("ip_address"))
    df = add(df, feature_private=f"coalesce({IP.in_ranges('_n', IP.FEATURE_PRIVATE_V4)}, false)")
    return df.select("ip_address", *[F.expr(e).alias(n) for n, e in INTEL_FEATURES.items()])


def geo_features(ips: DataFrame, geo: DataFrame) -> DataFrame:
    """Six features; the country flag is kept apart from the graded country risk."""
    skip = ("ip_address RLIKE '^(192[.]168[.]|10[.]|172[.]16[.]|127[.])'")
    df = ips.select("ip_address").join(
        geo.select("ip_address", "country_code", "latitude", "longitude", "isp", "org",
                   F.lit(True).alias("hit")), "ip_address", "left")
    df = add(df, hit=f"coalesce(hit, false) AND NOT {skip}")
    return df.selectExpr(
        "ip_address", "int(hit) AS has_geolocation",
        "CASE WHEN hit THEN coalesce(latitude, 0D) ELSE 0D END AS latitude",
        "CASE WHEN hit THEN coalesce(longitude, 0D) ELSE 0D END AS longitude",
        "CASE WHEN hit THEN length(coalesce(isp, '')) ELSE 0 END AS isp_length",
        "int(hit AND coalesce(org, '') <> '') AS org_exists",
        f"int(hit AND coalesce({in_list('country_code', C.GEO_FLAG_COUNTRIES)}, false)) "
        "AS geo_country_flag")


def vote_ratio(votes: DataFrame) -> DataFrame:
    """Share of engines that call an address malicious, in percent."""
    total = "malicious + suspicious + harmless + undetected"
    return votes.selectExpr(
        "ip_address", "malicious AS malicious_votes", f"{total} AS total_engines",
        f"CASE WHEN {total} > 0 THEN round(malicious / cast({total} as double) * 100, 2) ELSE 0D "
        "END AS threat_score")


def feed_enrich(abuse: DataFrame, votes: DataFrame) -> DataFrame:
    """Larger of the two feed scores with its feed and description (the first feed wins ties)."""
    v = vote_ratio(votes).selectExpr(
        "ip_address", "threat_score AS v_score",
        "concat('Votes: ', malicious_votes, '/', total_engines, ' engines') AS v_text")
    a = abuse.select("ip_address", F.col("abuse_score").cast("double").alias("a_score"))
    df = a.join(v, "ip_address", "full")
    return df.selectExpr(
        "ip_address", "greatest(coalesce(a_score, 0D), coalesce(v_score, 0D)) AS threat_score",
        "CASE WHEN coalesce(v_score, 0D) > coalesce(a_score, 0D) THEN 'vote_feed' "
        "WHEN a_score > 0 THEN 'abuse_feed' END AS source_feed",
        "CASE WHEN coalesce(v_score, 0D) > coalesce(a_score, 0D) THEN v_text "
        "WHEN a_score > 0 THEN concat('Abuse score: ', cast(a_score as int), '%') END "
        "AS description")


def feed_threats(abuse: DataFrame, votes: DataFrame) -> DataFrame:
    """Threat rows the feeds give rise to: abuse above 50, votes above 30."""
    a = abuse.where("abuse_score > 50").selectExpr(
        "ip_address", "'other' AS threat_type", "cast(abuse_score as double) AS confidence_score",
        "'abuse_feed' AS source_feed")
    v = vote_ratio(votes).where("threat_score > 30").selectExpr(
        "ip_address", "'malware' AS threat_type", "threat_score AS confidence_score",
        "'vote_feed' AS source_feed")
    return a.unionByName(v)


def reputation(ips: DataFrame, table: DataFrame, abuse: DataFrame) -> DataFrame:
    """Stored score when positive, else the abuse feed, else nothing known."""
    t = table.select("ip_address", F.col("threat_score").alias("db"))
    a = abuse.select("ip_address", F.col("abuse_score").cast("double").alias("feed"))
    df = ips.select("ip_address").join(t, "ip_address", "left").join(a, "ip_address", "left")
    return df.selectExpr(
        "ip_address", "CASE WHEN db > 0 THEN db ELSE coalesce(feed, 0D) END AS threat_score",
        "CASE WHEN db > 0 THEN db > 50 ELSE coalesce(feed > 30, false) END AS is_malicious",
        "CASE WHEN db > 0 THEN 'database' WHEN feed IS NOT NULL THEN 'abuse_feed' END AS source")


def threat_summary(rep: DataFrame, alerts: DataFrame, traffic: DataFrame) -> DataFrame:
    a = alerts.groupBy(F.col("source_ip").alias("ip_address")).agg(F.count("*").alias("alert_count"))
    t = traffic.groupBy(F.col("src_ip").alias("ip_address")).agg(F.count("*").alias("traffic_count"))
    df = rep.join(a, "ip_address", "left").join(t, "ip_address", "left").na.fill(
        0, ["alert_count", "traffic_count"])
    df = add(df, _r="threat_score + alert_count * 10")
    return add(df, risk_level="CASE WHEN _r > 80 THEN 'CRITICAL' WHEN _r > 50 THEN 'HIGH' "
                              "WHEN _r > 30 THEN 'MEDIUM' WHEN _r > 10 THEN 'LOW' ELSE 'SAFE' END"
               ).drop("_r")


def threat_profile(table: DataFrame, threats: DataFrame, alerts: DataFrame, traffic: DataFrame,
                   ip: str | None = None) -> DataFrame:
    """Threats, alerts and flows per address. Each child is aggregated before the join; the
    "source or destination" join becomes two equal-key counts, a flow to itself counting once."""
    if ip is not None:
        table, threats = (d.where(F.col("ip_address") == ip) for d in (table, threats))
        alerts = alerts.where(F.col("source_ip") == ip)
        traffic = traffic.where((F.col("src_ip") == ip) | (F.col("dst_ip") == ip))
    th = threats.where("is_active").groupBy("ip_address").agg(
        F.count("*").alias("threat_count"),
        F.array_join(F.array_sort(F.collect_set("threat_type")), ",").alias("threat_types"))
    al = alerts.groupBy(F.col("source_ip").alias("ip_address")).agg(
        F.count("*").alias("alert_count"))
    ends = traffic.select("log_id", F.explode(F.array_distinct(F.array("src_ip", "dst_ip")))
                          .alias("ip_address"))
    tr = ends.groupBy("ip_address").agg(F.count("*").alias("traffic_count"))
    df = table.select("ip_address", "country", "city", "threat_score", "total_requests")
    for d in (th, al, tr):
        df = df.join(d, "ip_address", "left")
    return df.na.fill(0, ["threat_count", "alert_count", "traffic_count"])


def by_country(table: DataFrame, country: str) -> DataFrame:
    return table.where(F.col("country") == country)


def high_threat(table: DataFrame, threshold: float = 50, limit: int = 100) -> DataFrame:
    return (table.where(F.col("threat_score") >= threshold)
            .orderBy(F.desc("threat_score"), "ip_address").limit(limit))


def score_band(table: DataFrame) -> DataFrame:
    return add(table, band="CASE WHEN threat_score > 50 THEN 'CRITICAL' WHEN threat_score > 30 "
                           "THEN 'HIGH' WHEN threat_score > 15 THEN 'MEDIUM' ELSE 'SAFE' END")
