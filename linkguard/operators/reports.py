"""Analytics and report queries over the stored tables. ``as_of`` stands for "now"."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from linkguard import constants as C
from linkguard.operators.alerts import on_days, since


def one_row(*parts: DataFrame) -> DataFrame:
    """Side-by-side view of one-row frames: a union of them, then the only value per column."""
    wide = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return wide.agg(*[F.max(c).alias(c) for c in wide.columns])


def dashboard_summary(urls, ips, alerts, traffic, predictions, as_of: str) -> DataFrame:
    """One conditional aggregate per table."""
    u = urls.agg(F.count_if("is_malicious").alias("total_malicious_urls"),
                 F.count("*").alias("total_urls_scanned"))
    i = ips.agg(F.count_if(F.col("threat_score") > 50).alias("high_threat_ips"),
                F.count("*").alias("total_ips_tracked"))
    a = alerts.agg(
        F.count_if(F.col("status").isin(C.ACTIVE_STATUSES_SUMMARY)).alias("active_alerts"),
        F.count_if(since("ts", as_of, 24, "HOUR")).alias("alerts_last_24h"))
    t = (traffic.where(since("ts", as_of, 24, "HOUR")).groupBy("src_ip").agg(F.count("*").alias("n"))
         .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("traffic_last_24h"),
              F.count("*").alias("unique_visitors_24h")))
    p = (predictions.where("predicted_class = 'malicious'")
         .where(since("prediction_timestamp", as_of, 7, "DAY"))
         .agg(F.avg("prediction_score").alias("avg_threat_score_7d")))
    return one_row(u, i, a, t, p)


def threat_trends(alerts, as_of: str, days: int = 7) -> DataFrame:
    return (alerts.where(since("ts", as_of, days, "DAY"))
            .groupBy(F.to_date("ts").alias("date"), "alert_type", "severity")
            .agg(F.count("*").alias("alert_count"))
            .orderBy(F.desc("date"), F.desc("alert_count")))


def threat_trends_pivot(trend_rows: DataFrame) -> DataFrame:
    return (trend_rows.groupBy("date").pivot("severity", C.SEVERITIES).agg(F.sum("alert_count"))
            .na.fill(0))


def top_malicious_domains(urls, predictions, limit: int = 10) -> DataFrame:
    """Predictions are summed per URL before the join, so a hot URL is one row in it."""
    per_url = predictions.groupBy("url_id").agg(
        F.count("*").alias("n"), F.sum("prediction_score").alias("s"),
        F.count_if(F.col("predicted_class") == "malicious").alias("bad_n"),
        F.sum(F.when(F.col("predicted_class") == "malicious", F.col("prediction_score")))
        .alias("bad_s"))
    df = urls.select("url_id", "domain", "is_malicious").join(per_url, "url_id")
    df = df.selectExpr("domain", "CASE WHEN is_malicious THEN n ELSE bad_n END AS n",
                       "CASE WHEN is_malicious THEN s ELSE coalesce(bad_s, 0) END AS s")
    return (df.where("n > 0").groupBy("domain")
            .agg(F.sum("n").alias("occurrence_count"),
                 (F.sum("s") / F.sum("n")).alias("avg_threat_score"))
            .orderBy(F.desc("occurrence_count"), "domain").limit(limit))


def top_malicious_domains_simple(urls, limit: int = 8) -> DataFrame:
    return (urls.where("is_malicious").groupBy("domain").agg(F.count("*").alias("n"))
            .orderBy(F.desc("n"), "domain").limit(limit))


def top_threat_ips(ips, threats, limit: int = 10) -> DataFrame:
    """The top addresses first; they filter the threats, and are
    broadcast where their size allows it."""
    top = (ips.where("threat_score > 0").orderBy(F.desc("threat_score"), "ip_id").limit(limit)
           .select("ip_id", "ip_address", "country", "threat_score"))
    active = threats.where("is_active").join(top.select("ip_address"), "ip_address",
                                             "left_semi")
    agg = active.groupBy("ip_address").agg(
        F.count("*").alias("threat_count"),
        F.array_join(F.array_sort(F.collect_set("threat_type")), ",").alias("threat_types"))
    return top.join(agg, "ip_address", "left").selectExpr(
        "ip_address", "country", "threat_score", "coalesce(threat_count, 0) AS threat_count",
        "threat_types").orderBy(F.desc("threat_score"))


def traffic_heatmap(traffic, as_of: str, hours: int = 24) -> DataFrame:
    return (traffic.where(since("ts", as_of, hours, "HOUR")).groupBy(F.hour("ts").alias("hour"))
            .agg(F.count("*").alias("request_count"), F.countDistinct("src_ip").alias("unique_ips"),
                 F.count_if(F.col("protocol") == "HTTPS").alias("https_count"),
                 F.count_if(F.col("protocol") == "HTTP").alias("http_count")).orderBy("hour"))


def alert_resolution_stats(alerts) -> DataFrame:
    return (alerts.where("resolved_at IS NOT NULL").groupBy("status", "severity")
            .agg(F.count("*").alias("n"),
                 F.avg(F.expr("timestampdiff(MINUTE, ts, resolved_at)"))
                 .alias("avg_resolution_minutes")))


def geo_threat_distribution(ips, alerts, as_of: str, days: int = 30, limit: int = 20) -> DataFrame:
    """Alerts are counted per address before the join; the average stays weighted by alerts."""
    per_ip = alerts.where(since("ts", as_of, days, "DAY")).groupBy("source_ip").agg(
        F.count("*").alias("n"),
        F.collect_set("alert_type").alias("t"))
    df = ips.join(per_ip, F.col("ip_address") == F.col("source_ip"))
    return (df.groupBy("country", "city").agg(
        F.sum("n").alias("alert_count"),
        (F.sum(F.col("threat_score") * F.col("n")) / F.sum("n")).alias("avg_threat_score"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("t")))), ",")
        .alias("alert_types"))
        .orderBy(F.desc("alert_count"), "country", "city").limit(limit))


def model_prediction_stats(predictions, as_of: str, days: int = 7) -> DataFrame:
    return (predictions.where(since("prediction_timestamp", as_of, days, "DAY"))
            .groupBy("model_name", "model_version", "predicted_class")
            .agg(F.count("*").alias("prediction_count"),
                 F.avg("prediction_score").alias("avg_confidence"),
                 F.min("prediction_score").alias("min_confidence"),
                 F.max("prediction_score").alias("max_confidence"))
            .orderBy("model_name", F.desc("prediction_count")))


def url_search(urls, predictions, term: str, limit: int = 50) -> DataFrame:
    """Every match yields at least one joined row, so the first ``limit`` joined rows come from the
    newest ``limit`` matches; only predictions of those URLs enter the join."""
    hit = (F.contains(F.lower("full_url"), F.lit(term.lower()))
           | F.contains(F.lower("domain"), F.lit(term.lower())))
    top = urls.where(hit).orderBy(F.desc("submission_date"), F.desc("url_id")).limit(limit)
    preds = predictions.join(top.select("url_id"), "url_id", "left_semi").select(
        "url_id", "prediction_id", "prediction_score", "predicted_class")
    return (top.join(preds, "url_id", "left")
            .orderBy(F.desc("submission_date"), F.desc("url_id"), F.asc_nulls_first("prediction_id"))
            .limit(limit))


def threat_stats_range(alerts, start: str, end: str) -> DataFrame:
    return (alerts.where(F.expr(f"ts BETWEEN TIMESTAMP_NTZ '{start}' AND TIMESTAMP_NTZ '{end}'"))
            .groupBy("alert_type", "severity", F.to_date("ts").alias("alert_date"))
            .agg(F.count("*").alias("alert_count"))
            .orderBy(F.desc("alert_date"), F.desc("alert_count")))


def recent_threats(alerts, ips, urls, predictions, limit: int = 100) -> DataFrame:
    """Newest alerts with their address, URL and predictions; fan-out by predictions is kept."""
    top = alerts.orderBy(F.desc("ts"), F.desc("alert_id")).limit(limit)
    ip = ips.join(top.select(F.col("source_ip").alias("ip_address")), "ip_address",
                  "left_semi").select(F.col("ip_address").alias("source_ip"),
                                      F.col("country").alias("source_country"))
    ids = top.select("url_id")
    u = urls.join(ids, "url_id", "left_semi").select("url_id", "full_url")
    p = predictions.join(ids, "url_id", "left_semi").select(
        "url_id", "prediction_id", "prediction_score", "predicted_class")
    df = top.join(ip, "source_ip", "left").join(u.join(p, "url_id", "left"), "url_id", "left")
    return (df.orderBy(F.desc("ts"), F.desc("alert_id"), F.asc_nulls_first("prediction_id"))
            .limit(limit).select("alert_id", "ts", "alert_type", "severity", "source_ip",
                                 "source_country", "description", "status", "full_url",
                                 "prediction_score", "predicted_class"))


def traffic_summary(traffic, as_of: str, days: int = 7) -> DataFrame:
    return (traffic.where(since("ts", as_of, days, "DAY"))
            .groupBy(F.to_date("ts").alias("date"), F.hour("ts").alias("hour"), "protocol")
            .agg(F.count("*").alias("request_count"),
                 F.countDistinct("src_ip").alias("unique_sources"),
                 F.countDistinct("dst_ip").alias("unique_destinations"),
                 F.avg("payload_size").alias("avg_payload_size"),
                 F.avg("connection_duration_ms").alias("avg_duration")))


def traffic_stats(traffic, as_of: str, hours: int = 24, approximate: bool = False) -> DataFrame:
    n = F.approx_count_distinct if approximate else F.countDistinct
    return traffic.where(since("ts", as_of, hours, "HOUR")).groupBy("protocol").agg(
        F.count("*").alias("request_count"), n("src_ip").alias("unique_sources"),
        n("dst_ip").alias("unique_destinations"))


def url_label_stats(urls) -> DataFrame:
    return urls.where("is_malicious IS NOT NULL").groupBy("is_malicious").agg(
        F.count("*").alias("n"), F.avg("url_length").alias("avg_length"))


def url_listing(urls, where: str | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    df = urls.where(where) if where else urls
    return df.orderBy(F.desc("submission_date"), F.desc("url_id")).offset(offset).limit(limit)


def threat_listing(threats, ip: str | None = None, limit: int | None = 100) -> DataFrame:
    df = threats.where("is_active")
    if ip is not None:
        return df.where(F.col("ip_address") == ip).orderBy(F.desc("last_updated"),
                                                           F.desc("threat_id"))
    return df.orderBy(F.desc("confidence_score"), "threat_id").limit(limit)


def prediction_history(predictions, url_id: int) -> DataFrame:
    return predictions.where(F.col("url_id") == url_id).orderBy(
        F.desc("prediction_timestamp"), F.desc("prediction_id"))


def audit_history(audit, table: str | None = None, record: int | None = None, limit: int = 100,
                  offset: int = 0) -> DataFrame:
    if table is not None:
        return audit.where((F.col("table_affected") == table) & (F.col("record_id") == record)
                           ).orderBy(F.desc("ts"), F.desc("audit_id"))
    return audit.orderBy(F.desc("ts"), F.desc("audit_id")).offset(offset).limit(limit)


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    one = [df.agg(F.count("*").alias("n")).select(F.lit(n).alias("table_name"), "n")
           for n, df in tables.items()]
    return reduce(lambda a, b: a.union(b), one)


def url_source_inventory(urls) -> DataFrame:
    return urls.groupBy("source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source")


def home_metrics(urls, alerts, ips, day: str) -> DataFrame:
    u = urls.agg(F.count("*").alias("total_urls"), F.count_if("is_malicious").alias("malicious"),
                 F.count_if(F.col("source").isin("live_traffic", "traffic_capture"))
                 .alias("live_urls"))
    a = alerts.agg(F.count_if(F.col("status").isin(C.ACTIVE_STATUSES)).alias("active_alerts"),
                   F.count_if(on_days("ts", day, day)).alias("today_alerts"))
    i = ips.agg(F.count("*").alias("total_ips"))
    return one_row(u, a, i).selectExpr(
        "*", "total_urls - malicious AS benign",
        "CASE WHEN total_urls > 0 THEN malicious / total_urls * 100 ELSE 0 END AS malicious_pct")


def report_security_alerts(alerts, start: str, end: str) -> DataFrame:
    from linkguard.operators.alerts import severity_rank
    return (alerts.where(on_days("ts", start, end)).groupBy("severity", "status")
            .agg(F.count("*").alias("n")).orderBy(severity_rank(), "status"))


def report_security_urls(urls, start: str, end: str) -> DataFrame:
    return (urls.where(on_days("submission_date", start, end)).where("is_malicious IS NOT NULL")
            .groupBy("is_malicious").agg(F.count("*").alias("n")))


def report_threat_analysis(threats, start: str, end: str) -> DataFrame:
    return (threats.where(on_days("first_reported", start, end)).where("is_active")
            .groupBy("threat_type").agg(F.count("*").alias("n"),
                                        F.avg("confidence_score").alias("avg_confidence"))
            .orderBy(F.desc("n")))


def report_url_scans(urls, predictions, start: str, end: str, limit: int = 100) -> DataFrame:
    """The join with URLs keeps or drops a prediction but never repeats it (``url_id`` is the key),
    so predictions are filtered to existing URLs, cut to the newest, and only then joined."""
    p = predictions.where(on_days("prediction_timestamp", start, end))
    top = (p.join(urls.select("url_id"), "url_id", "left_semi")
           .orderBy(F.desc("prediction_timestamp"), F.desc("prediction_id")).limit(limit))
    u = urls.join(top.select("url_id"), "url_id", "left_semi").select(
        "url_id", "full_url", "domain", "is_malicious")
    return top.join(u, "url_id").select("full_url", "domain", "is_malicious", "predicted_class",
                                        "prediction_score", "prediction_timestamp")


def report_ip_intel(ips, start: str, end: str, limit: int = 100) -> DataFrame:
    return (ips.where("threat_score > 0").where(on_days("last_seen", start, end))
            .orderBy(F.desc("threat_score"), "ip_address").limit(limit)
            .select("ip_address", "country", "city", "isp", "threat_score", "total_requests"))
