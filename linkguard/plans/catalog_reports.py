"""Checked queries: analytics, reports, alerts, upserts and maintenance."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from linkguard.operators import alerts as A, reports as N, upserts as B
from linkguard.plans.oracle_ctes import CTES
from linkguard.plans.registry import fmt, query
from linkguard.plans.views import AS_OF, AS_OF_ORDERS, Dialect, Tables

NOW = f"TIMESTAMP '{AS_OF}'"
ORDERS_NOW = f"TIMESTAMP '{AS_OF_ORDERS}'"
DUCK = Dialect("duck")


def last(ts: str, n: int, unit: str, now: str = NOW) -> str:
    return f"{ts} >= {now} - INTERVAL {n} {unit} AND {ts} <= {now}"


def day(ts: str) -> str:
    return f"strftime({ts}, '%Y-%m-%d')"


# --- analytics ----------------------------------------------------------------------------------
@query("dashboard_summary", f"""SELECT
    (SELECT count(*) FROM urls_v WHERE is_malicious) AS total_malicious_urls,
    (SELECT count(*) FROM urls_v) AS total_urls_scanned,
    (SELECT count(*) FROM ips_v WHERE threat_score > 50) AS high_threat_ips,
    (SELECT count(*) FROM ips_v) AS total_ips_tracked,
    (SELECT count(*) FROM alerts_v WHERE status IN ('new', 'investigating')) AS active_alerts,
    (SELECT count(*) FROM alerts_v WHERE {last('ts', 24, 'HOUR')}) AS alerts_last_24h,
    (SELECT count(*) FROM traffic_v WHERE {last('ts', 24, 'HOUR')}) AS traffic_last_24h,
    (SELECT count(DISTINCT src_ip) FROM traffic_v WHERE {last('ts', 24, 'HOUR')})
      AS unique_visitors_24h,
    (SELECT round(avg(prediction_score), 6) FROM predictions_v WHERE predicted_class = 'malicious'
      AND {last('prediction_timestamp', 7, 'DAY', ORDERS_NOW)}) AS avg_threat_score_7d""")
def _(t):
    # predictions are dated by orders, everything else by events
    a = N.dashboard_summary(t.urls_v, t.ips_v, t.alerts_v, t.traffic_v,
                            t.predictions_v.withColumn("prediction_timestamp", F.expr(
                                "timestampadd(DAY, datediff(DATE '2024-01-31', DATE '1998-12-31'), "
                                "prediction_timestamp)")), AS_OF)
    return a.withColumn("avg_threat_score_7d", F.round("avg_threat_score_7d", 6))


@query("threat_trends", f"""SELECT {day('ts')} AS date, alert_type, severity,
    count(*) AS alert_count FROM alerts_v WHERE {last('ts', 7, 'DAY')} GROUP BY ALL""")
def _(t):
    return N.threat_trends(t.alerts_v, AS_OF)


@query("threat_trends_pivot", f"""SELECT {day('ts')} AS date,
    {', '.join(f"count(*) FILTER (severity = '{s}') AS {s}" for s in
               ['critical', 'high', 'medium', 'low'])}
    FROM alerts_v WHERE {last('ts', 7, 'DAY')} GROUP BY ALL""")
def _(t):
    return N.threat_trends_pivot(N.threat_trends(t.alerts_v, AS_OF))


@query("top_malicious_domains", """SELECT domain, count(*) AS occurrence_count,
    round(avg(prediction_score), 6) AS avg_threat_score
    FROM urls_v u JOIN predictions_v p USING (url_id)
    WHERE is_malicious OR predicted_class = 'malicious'
    GROUP BY domain ORDER BY occurrence_count DESC, domain LIMIT 10""")
def _(t):
    return N.top_malicious_domains(t.urls_v, t.predictions_v).withColumn(
        "avg_threat_score", F.round("avg_threat_score", 6))


@query("top_malicious_domains_simple", """SELECT domain, count(*) AS n FROM urls_v
    WHERE is_malicious GROUP BY domain ORDER BY n DESC, domain LIMIT 8""")
def _(t):
    return N.top_malicious_domains_simple(t.urls_v)


@query("top_threat_ips", """SELECT i.ip_address, any_value(country) AS country,
    any_value(threat_score) AS threat_score, count(DISTINCT threat_id) AS threat_count,
    array_to_string(list_sort(list(DISTINCT threat_type) FILTER (threat_type IS NOT NULL)), ',')
      AS threat_types
    FROM ips_v i LEFT JOIN threats_v t ON i.ip_address = t.ip_address AND t.is_active
    WHERE i.threat_score > 0 GROUP BY i.ip_id, i.ip_address
    ORDER BY threat_score DESC, ip_id LIMIT 10""")
def _(t):
    return N.top_threat_ips(t.ips_v, t.threats_v)


@query("traffic_heatmap", f"""SELECT hour(ts) AS hour, count(*) AS request_count,
    count(DISTINCT src_ip) AS unique_ips, count(*) FILTER (protocol = 'HTTPS') AS https_count,
    count(*) FILTER (protocol = 'HTTP') AS http_count FROM traffic_v
    WHERE {last('ts', 240, 'HOUR')} GROUP BY 1""")
def _(t):
    return N.traffic_heatmap(t.traffic_v, AS_OF, 240)


@query("alert_resolution_stats", """SELECT status, severity, count(*) AS n,
    avg(datesub('minute', ts, resolved_at)) AS avg_resolution_minutes
    FROM alerts_v WHERE resolved_at IS NOT NULL GROUP BY 1, 2""")
def _(t):
    return N.alert_resolution_stats(t.alerts_v)


@query("geo_threat_distribution", f"""SELECT country, city, count(DISTINCT alert_id) AS alert_count,
    round(avg(threat_score), 6) AS avg_threat_score,
    array_to_string(list_sort(list(DISTINCT alert_type)), ',') AS alert_types
    FROM ips_v JOIN alerts_v ON ip_address = source_ip WHERE {last('ts', 30, 'DAY')}
    GROUP BY 1, 2 ORDER BY alert_count DESC, country, city LIMIT 20""")
def _(t):
    return N.geo_threat_distribution(t.ips_v, t.alerts_v, AS_OF).withColumn(
        "avg_threat_score", F.round("avg_threat_score", 6))


@query("model_prediction_stats", f"""SELECT model_name, model_version, predicted_class,
    count(*) AS prediction_count, round(avg(prediction_score), 6) AS avg_confidence,
    min(prediction_score) AS min_confidence, max(prediction_score) AS max_confidence
    FROM predictions_v WHERE {last('prediction_timestamp', 7, 'DAY', ORDERS_NOW)}
    GROUP BY 1, 2, 3""")
def _(t):
    return N.model_prediction_stats(t.predictions_v, AS_OF_ORDERS).withColumn(
        "avg_confidence", F.round("avg_confidence", 6))


@query("url_search", f"""SELECT url_id, full_url, domain, {fmt('submission_date')}
      AS submission_date, prediction_id, prediction_score, predicted_class
    FROM urls_v LEFT JOIN predictions_v USING (url_id)
    WHERE full_url ILIKE '%LOGIN%' OR domain ILIKE '%LOGIN%'
    ORDER BY urls_v.submission_date DESC, url_id DESC, prediction_id ASC NULLS FIRST LIMIT 50""")
def _(t):
    return N.url_search(t.urls_v, t.predictions_v, "LOGIN").select(
        "url_id", "full_url", "domain", "submission_date", "prediction_id", "prediction_score",
        "predicted_class")


@query("threat_stats_range", f"""SELECT alert_type, severity, {day('ts')} AS alert_date,
    count(*) AS alert_count FROM alerts_v
    WHERE ts BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-09 12:00:00'
    GROUP BY ALL""")
def _(t):
    return N.threat_stats_range(t.alerts_v, "2024-01-05 00:00:00", "2024-01-09 12:00:00")


@query("recent_threats", f"""SELECT a.alert_id, {fmt('a.ts')} AS ts, alert_type, severity, source_ip,
    country AS source_country, description, status, full_url, prediction_score, predicted_class
    FROM alerts_v a LEFT JOIN ips_v i ON a.source_ip = i.ip_address
    LEFT JOIN urls_v u ON a.url_id = u.url_id LEFT JOIN predictions_v p ON u.url_id = p.url_id
    ORDER BY a.ts DESC, a.alert_id DESC, prediction_id ASC NULLS FIRST LIMIT 100""")
def _(t):
    return N.recent_threats(t.alerts_v, t.ips_v, t.urls_v, t.predictions_v)


@query("traffic_summary", f"""SELECT {day('ts')} AS date, hour(ts) AS hour, protocol,
    count(*) AS request_count, count(DISTINCT src_ip) AS unique_sources,
    count(DISTINCT dst_ip) AS unique_destinations, round(avg(payload_size), 6) AS avg_payload_size,
    round(avg(connection_duration_ms), 6) AS avg_duration
    FROM traffic_v WHERE {last('ts', 7, 'DAY')} GROUP BY ALL""")
def _(t):
    df = N.traffic_summary(t.traffic_v, AS_OF)
    return df.withColumns({c: F.round(c, 6) for c in ["avg_payload_size", "avg_duration"]})


@query("traffic_stats", f"""SELECT protocol, count(*) AS request_count,
    count(DISTINCT src_ip) AS unique_sources, count(DISTINCT dst_ip) AS unique_destinations
    FROM traffic_v WHERE {last('ts', 72, 'HOUR')} GROUP BY 1""")
def _(t):
    return N.traffic_stats(t.traffic_v, AS_OF, 72)


@query("url_label_stats", """SELECT is_malicious, count(*) AS n, round(avg(url_length), 6)
    AS avg_length FROM urls_v WHERE is_malicious IS NOT NULL GROUP BY 1""")
def _(t):
    return N.url_label_stats(t.urls_v).withColumn("avg_length", F.round("avg_length", 6))


def listing(name: str, where: str | None, limit: int, offset: int = 0) -> None:
    @query(name, f"""SELECT url_id, domain, {fmt('submission_date')} AS submission_date, source
        FROM urls_v {'WHERE ' + where if where else ''}
        ORDER BY urls_v.submission_date DESC, url_id DESC LIMIT {limit} OFFSET {offset}""")
    def _(t):
        return N.url_listing(t.urls_v, where, limit, offset).select(
            "url_id", "domain", "submission_date", "source")


listing("url_listing", None, 100, 40)
listing("url_listing_malicious", "is_malicious", 100)
listing("url_by_id", "url_id = 27", 1)
listing("url_by_domain", "domain = 'docs.python.org'", 1000000)


@query("url_count", "SELECT count(*) AS n FROM urls_v")
def _(t):
    return t.urls_v.agg(F.count("*").alias("n"))


@query("threat_listing", """SELECT threat_id, ip_address, threat_type, confidence_score
    FROM threats_v WHERE is_active ORDER BY confidence_score DESC, threat_id LIMIT 100""")
def _(t):
    return N.threat_listing(t.threats_v).select("threat_id", "ip_address", "threat_type",
                                                "confidence_score")


@query("threats_for_ip", f"""SELECT threat_id, threat_type, {fmt('last_updated')} AS last_updated
    FROM threats_v WHERE is_active AND ip_address = '30.0.0.39'""")
def _(t):
    return N.threat_listing(t.threats_v, "30.0.0.39").select("threat_id", "threat_type",
                                                             "last_updated")


@query("prediction_history", f"""SELECT prediction_id, prediction_score, predicted_class,
    {fmt('prediction_timestamp')} AS prediction_timestamp FROM predictions_v WHERE url_id = 99""")
def _(t):
    return N.prediction_history(t.predictions_v, 99).select(
        "prediction_id", "prediction_score", "predicted_class", "prediction_timestamp")


@query("audit_history", f"""SELECT audit_id, user_id, action, {fmt('ts')} AS ts FROM audit_v
    ORDER BY audit_v.ts DESC, audit_id DESC LIMIT 100 OFFSET 100""")
def _(t):
    return N.audit_history(t.audit_v, limit=100, offset=100).select("audit_id", "user_id", "action",
                                                                    "ts")


@query("audit_history_record", f"""SELECT audit_id, user_id, action, {fmt('ts')} AS ts FROM audit_v
    WHERE table_affected = 'alerts' AND record_id = 17""")
def _(t):
    return N.audit_history(t.audit_v, "alerts", 17).select("audit_id", "user_id", "action", "ts")


COUNTED = {"urls": "urls_v", "ip_addresses": "ips_v", "alerts": "alerts_v",
           "traffic_logs": "traffic_v", "threat_intelligence": "threats_v",
           "model_predictions": "predictions_v"}


@query("table_counts", " UNION ALL ".join(
    f"SELECT '{n}' AS table_name, count(*) AS n FROM {v}" for n, v in COUNTED.items()))
def _(t):
    return N.table_counts({n: getattr(t, v) for n, v in COUNTED.items()})


@query("url_source_inventory", "SELECT source, count(*) AS n FROM urls_v GROUP BY 1")
def _(t):
    return N.url_source_inventory(t.urls_v)


listing("url_latest", None, 15)


@query("home_metrics", """SELECT *, total_urls - malicious AS benign,
    round(malicious / total_urls * 100, 6) AS malicious_pct FROM (SELECT
    (SELECT count(*) FROM urls_v) AS total_urls,
    (SELECT count(*) FROM urls_v WHERE is_malicious) AS malicious,
    (SELECT count(*) FROM urls_v WHERE source IN ('live_traffic', 'traffic_capture')) AS live_urls,
    (SELECT count(*) FROM alerts_v WHERE status IN ('new', 'acknowledged', 'investigating'))
      AS active_alerts,
    (SELECT count(*) FROM alerts_v WHERE cast(ts AS DATE) = DATE '2024-01-20') AS today_alerts,
    (SELECT count(*) FROM ips_v) AS total_ips)""")
def _(t):
    return N.home_metrics(t.urls_v, t.alerts_v, t.ips_v, "2024-01-20").withColumn(
        "malicious_pct", F.round("malicious_pct", 6))


@query("report_security_summary", """SELECT 'alerts' AS part, severity, status,
    NULL::BOOLEAN AS is_malicious, count(*) AS n FROM alerts_v
    WHERE cast(ts AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-12' GROUP BY 2, 3
    UNION ALL SELECT 'urls', NULL, NULL, is_malicious, count(*) FROM urls_v
    WHERE cast(submission_date AS DATE) BETWEEN DATE '2024-01-01' AND DATE '2024-01-02'
      AND is_malicious IS NOT NULL GROUP BY 4""")
def _(t):
    a = N.report_security_alerts(t.alerts_v, "2024-01-05", "2024-01-12")
    u = N.report_security_urls(t.urls_v, "2024-01-01", "2024-01-02")
    return a.withColumn("part", F.lit("alerts")).unionByName(
        u.withColumn("part", F.lit("urls")), allowMissingColumns=True)


@query("report_threat_analysis", """SELECT threat_type, count(*) AS n,
    round(avg(confidence_score), 6) AS avg_confidence FROM threats_v
    WHERE cast(first_reported AS DATE) BETWEEN DATE '1997-01-01' AND DATE '1998-06-30'
      AND is_active GROUP BY 1""")
def _(t):
    return N.report_threat_analysis(t.threats_v, "1997-01-01", "1998-06-30").withColumn(
        "avg_confidence", F.round("avg_confidence", 6))


@query("report_url_scans", f"""SELECT full_url, domain, is_malicious, predicted_class,
    prediction_score, {fmt('prediction_timestamp')} AS prediction_timestamp
    FROM urls_v JOIN predictions_v p USING (url_id)
    WHERE cast(p.prediction_timestamp AS DATE) BETWEEN DATE '1997-01-01' AND DATE '1998-06-30'
    ORDER BY p.prediction_timestamp DESC, prediction_id DESC LIMIT 100""")
def _(t):
    return N.report_url_scans(t.urls_v, t.predictions_v, "1997-01-01", "1998-06-30")


@query("report_ip_intel", """SELECT ip_address, country, city, isp, threat_score, total_requests
    FROM ips_v WHERE threat_score > 0
      AND cast(last_seen AS DATE) BETWEEN DATE '2024-01-01' AND DATE '2024-01-10'
    ORDER BY threat_score DESC, ip_address LIMIT 100""")
def _(t):
    return N.report_ip_intel(t.ips_v, "2024-01-01", "2024-01-10")


# --- alerts ---------------------------------------------------------------------------------------
CTES["m_first"] = """SELECT source_ip, alert_type, ts, min(attempt_id) AS attempt_id
    FROM alert_attempts GROUP BY ALL"""
CTES["m_emitted"] = """
    SELECT source_ip, alert_type, min(ts) AS ts FROM m_first GROUP BY ALL
    UNION ALL
    SELECT f.source_ip, f.alert_type, min(f.ts) FROM m_emitted e JOIN m_first f
      ON f.source_ip = e.source_ip AND f.alert_type = e.alert_type
        AND f.ts >= e.ts + INTERVAL 60 SECOND
    GROUP BY f.source_ip, f.alert_type, e.ts"""
CTES["m_passed"] = """SELECT a.* FROM alert_attempts a WHERE attempt_id IN
    (SELECT attempt_id FROM m_emitted JOIN m_first USING (source_ip, alert_type, ts))"""
LEGAL = "[" + ", ".join(f"'{x}'" for x in ["malicious_url", "suspicious_ip", "high_traffic",
        "dns_anomaly", "geolocation_mismatch", "frequency_attack", "other"]) + "]"


@query("alert_throttle", """SELECT attempt_id, attempt_id IN (SELECT attempt_id FROM m_passed)
    AS emitted FROM alert_attempts""")
def _(t):
    return A.alert_throttle(t.alert_attempts).select("attempt_id", "emitted")


@query("alert_create", f"""SELECT attempt_id AS alert_id, CASE WHEN list_contains({LEGAL},
      alert_type) THEN alert_type ELSE 'other' END AS alert_type,
    CASE WHEN severity IN ('low', 'medium', 'high', 'critical') THEN severity ELSE 'low' END
      AS severity, source_ip, destination_ip, description, 'new' AS status FROM m_passed""")
def _(t):
    return A.alert_create(t.alert_attempts, t.ips_v)[0].drop("ts")


@query("ip_ensure_exists", """SELECT DISTINCT ip AS ip_address,
    CASE WHEN ip LIKE '%:%' THEN 'IPv6' ELSE 'IPv4' END AS ip_version FROM (
      SELECT source_ip AS ip FROM m_passed UNION SELECT destination_ip FROM m_passed)
    WHERE ip IS NOT NULL AND ip NOT IN (SELECT ip_address FROM ips_v)""")
def _(t):
    return A.alert_create(t.alert_attempts, t.ips_v)[1].select("ip_address", "ip_version")


def check_sql(cur: str) -> str:
    ok = ("CASE {0} WHEN 'new' THEN new_status IN ('acknowledged', 'investigating', 'resolved', "
          "'false_positive') WHEN 'acknowledged' THEN new_status IN ('investigating', 'resolved', "
          "'false_positive') WHEN 'investigating' THEN new_status IN ('resolved', 'false_positive')"
          " ELSE new_status = 'investigating' END").format(cur)
    valid = "new_status IN ('new', 'acknowledged', 'investigating', 'resolved', 'false_positive')"
    return f"""coalesce({valid} AND {ok} AND {cur} <> new_status AND {cur} IS NOT NULL, false)
        AS success, CASE WHEN {valid} THEN {cur} END AS old_status,
      CASE WHEN NOT {valid} THEN 'Invalid status ''' || new_status || ''''
        WHEN {cur} IS NULL THEN 'Alert ' || alert_id || ' not found'
        WHEN {cur} = new_status THEN 'Alert is already "' || new_status || '"'
        WHEN NOT ({ok}) THEN 'Cannot transition "' || {cur} || '" → "' || new_status || '"'
        ELSE 'Alert updated: ' || {cur} || ' → ' || new_status END AS message"""


@query("alert_transition_check", f"""SELECT cmd_id, alert_id, new_status, {check_sql('status')}
    FROM (SELECT c.*, a.status FROM status_commands c LEFT JOIN alerts_v a USING (alert_id))""")
def _(t):
    return A.transition_check(t.status_commands, t.alerts_v).select(
        "cmd_id", "alert_id", "new_status", "success", "old_status", "message")


CTES["m_ordered"] = """SELECT c.*, row_number() OVER (PARTITION BY alert_id ORDER BY ts, cmd_id)
    AS rn FROM status_commands c"""
CTES["m_fold"] = f"""
    SELECT cmd_id, alert_id, rn, met, new_status, {check_sql('met')},
      CASE WHEN success THEN new_status ELSE met END AS after FROM
      (SELECT o.*, a.status AS met FROM m_ordered o LEFT JOIN alerts_v a USING (alert_id)
       WHERE rn = 1)
    UNION ALL
    SELECT cmd_id, alert_id, rn, met, new_status, {check_sql('met')},
      CASE WHEN success THEN new_status ELSE met END AS after FROM
      (SELECT o.*, f.after AS met FROM m_fold f JOIN m_ordered o
       ON o.alert_id = f.alert_id AND o.rn = f.rn + 1)"""
CTES["m_done"] = """SELECT f.*, c.user_name, c.notes, c.ts FROM m_fold f
    JOIN status_commands c USING (cmd_id) WHERE success"""


@query("alert_status_history", """SELECT cmd_id, alert_id, new_status, success, old_status, message
    FROM m_fold""")
def _(t):
    return A.status_history(t.status_commands, t.alerts_v).select(
        "cmd_id", "alert_id", "new_status", "success", "old_status", "message")


@query("alert_apply_status", f"""SELECT a.alert_id,
    coalesce((SELECT arg_max(new_status, rn) FROM m_done d WHERE d.alert_id = a.alert_id), status)
      AS status,
    coalesce(k.user_name, a.resolved_by) AS resolved_by,
    coalesce(k.notes, a.resolution_notes) AS resolution_notes,
    {fmt('coalesce(k.ts, a.resolved_at)')} AS resolved_at
    FROM alerts_v a LEFT JOIN (SELECT * FROM m_done WHERE new_status IN
      ('resolved', 'false_positive') QUALIFY row_number() OVER (PARTITION BY alert_id
      ORDER BY rn DESC) = 1) k USING (alert_id)""")
def _(t):
    return A.apply_status(t.status_commands, t.alerts_v).select(
        "alert_id", "status", "resolved_by", "resolution_notes", "resolved_at")


@query("alert_audit_rows", f"""SELECT cmd_id, 'alert_status:' || new_status AS action,
    'alerts' AS table_affected, alert_id AS record_id,
    cast(to_json(struct_pack(status := old_status)) AS VARCHAR) AS old_values,
    cast(to_json(struct_pack(status := new_status, user := user_name, notes := notes)) AS VARCHAR)
      AS new_values, {fmt('ts')} AS ts FROM m_done""")
def _(t):
    return A.audit_rows(A.status_history(t.status_commands, t.alerts_v))


@query("alert_bulk_update", f"""SELECT alert_id, new_status, {check_sql('status')} FROM
    (SELECT *, 'acknowledged' AS new_status FROM alerts_v WHERE severity = 'high'
     AND status IN ('new', 'acknowledged', 'investigating'))""")
def _(t):
    return A.bulk_update(t.alerts_v, f"severity = 'high' AND {A.ACTIVE}", "acknowledged").select(
        "alert_id", "new_status", "success", "old_status", "message")


@query("alert_bulk_counts", """SELECT count(*) FILTER (status <> 'acknowledged' AND
      status <> 'investigating') AS success,
    count(*) FILTER (status IN ('acknowledged', 'investigating')) AS failed FROM alerts_v
    WHERE severity = 'high' AND status IN ('new', 'acknowledged', 'investigating')""")
def _(t):
    return A.bulk_counts(A.bulk_update(t.alerts_v, f"severity = 'high' AND {A.ACTIVE}",
                                       "acknowledged"))


@query("alert_resolve_ip", """SELECT alert_id, 'resolved' AS new_status, true AS success
    FROM alerts_v WHERE source_ip = '34.0.0.155'
    AND status IN ('new', 'acknowledged', 'investigating')""")
def _(t):
    return A.bulk_update(t.alerts_v, f"source_ip = '34.0.0.155' AND {A.ACTIVE}",
                         "resolved").select("alert_id", "new_status", "success")


RANK = "CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END"
SHOWN = ["alert_id", "alert_type", "severity", "source_ip", "status"]


def alert_list(name: str, fn, where: str, order: str = "ts DESC, alert_id DESC", limit: int = 50):
    @query(name, f"SELECT {', '.join(SHOWN)} FROM alerts_v WHERE {where} ORDER BY {order} "
                 f"LIMIT {limit}")
    def _(t):
        return fn(t.alerts_v).select(*SHOWN)


OPEN = "status IN ('new', 'acknowledged', 'investigating')"
alert_list("alert_active", lambda a: A.active(a), OPEN, f"{RANK}, ts DESC, alert_id DESC")
alert_list("alert_active_summary", lambda a: A.active(a, 100, ["new", "investigating"]),
           "status IN ('new', 'investigating')", f"{RANK}, ts DESC, alert_id DESC", 100)
alert_list("alert_by_severity", lambda a: A.newest(a.where(f"severity = 'high' AND {A.ACTIVE}"), 50),
           f"severity = 'high' AND {OPEN}")
alert_list("alert_by_status", lambda a: A.newest(a.where("status = 'investigating'"), 50),
           "status = 'investigating'")
alert_list("alert_by_ip", lambda a: A.newest(a.where("source_ip = '34.0.0.155'"), 50),
           "source_ip = '34.0.0.155'")
alert_list("alert_by_id", lambda a: a.where("alert_id = 123"), "alert_id = 123")
alert_list("alert_resolved", lambda a: A.newest(a.where("status IN ('resolved', 'false_positive')"),
                                                50, "resolved_at"),
           "status IN ('resolved', 'false_positive')", "resolved_at DESC, alert_id DESC")
alert_list("alert_search", lambda a: A.search(a, "USER 4"),
           "(description ILIKE '%user 4%' OR source_ip ILIKE '%user 4%' OR "
           "alert_type ILIKE '%user 4%')", limit=100)
alert_list("alert_search_filtered",
           lambda a: A.search(a, "click", "medium", "Active", by_severity=True),
           f"(description ILIKE '%click%' OR alert_type ILIKE '%click%') AND severity = 'medium' "
           f"AND {OPEN}", f"{RANK}, ts DESC, alert_id DESC", 100)


@query("alert_stats_7d", f"""SELECT severity, status, count(*) AS n FROM alerts_v
    WHERE {last('ts', 7, 'DAY')} GROUP BY 1, 2""")
def _(t):
    return A.stats(t.alerts_v, AS_OF)


@query("alert_today_summary", f"""SELECT count(*) AS total_alerts,
    {', '.join(f"count(*) FILTER (severity = '{s}') AS {s}" for s in
               ['critical', 'high', 'medium', 'low'])},
    count(*) FILTER (status = 'new') AS new_alerts,
    {', '.join(f"count(*) FILTER (status = '{s}') AS {s}" for s in
               ['acknowledged', 'investigating', 'resolved', 'false_positive'])}
    FROM alerts_v WHERE cast(ts AS DATE) = DATE '2024-01-20'""")
def _(t):
    return A.today_summary(t.alerts_v, "2024-01-20")


@query("alert_trends", f"""SELECT {day('ts')} AS date, severity, count(*) AS n FROM alerts_v
    WHERE {last('ts', 7, 'DAY')} GROUP BY 1, 2""")
def _(t):
    return A.trends(t.alerts_v, AS_OF)


@query("alert_top_ips", f"""SELECT source_ip, count(*) AS alert_count, {fmt('max(ts)')} AS last_alert,
    array_to_string(list_sort(list(DISTINCT alert_type)), ',') AS types FROM alerts_v
    GROUP BY 1 ORDER BY alert_count DESC, source_ip LIMIT 10""")
def _(t):
    return A.top_ips(t.alerts_v)


# --- upserts and maintenance ----------------------------------------------------------------------
URL_BATCH = """SELECT 1000000 + event_id AS url_id, concat('https://new-', event_id % 700, '.org/')
      AS full_url, concat('new-', event_id % 700, '.org') AS domain, '/' AS path,
      'https' AS protocol, 'org' AS tld, 25 AS url_length,
      concat('batch_', event_id % 3) AS source,
      CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_id % 2 = 0 END AS is_malicious,
      event_id AS seq FROM events
    UNION ALL SELECT 2000000 + url_id, full_url, domain, path, protocol, tld, url_length, 'rescan',
      CASE WHEN url_id % 3 = 0 THEN true END, url_id FROM urls_v WHERE url_id % 2 = 0"""


@query("url_upsert", f"""SELECT full_url, arg_min(url_id, (seq, url_id)) AS url_id,
    {fmt(f"CASE WHEN max(seq) >= 0 THEN {NOW} ELSE max(submission_date) END")} AS submission_date,
    arg_max(source, (seq, url_id)) AS source,
    arg_max(is_malicious, (seq, url_id)) FILTER (is_malicious IS NOT NULL) AS is_malicious FROM (
      SELECT full_url, url_id, submission_date, source, is_malicious, -1 AS seq FROM urls_v
      UNION ALL SELECT full_url, url_id, NULL, source, is_malicious, seq FROM ({URL_BATCH}))
    GROUP BY full_url""")
def _(t):
    batch = t.sql(URL_BATCH).withColumn("url_length", F.col("url_length").cast("int"))
    return B.url_upsert(t.urls_v, batch, AS_OF).select("full_url", "url_id", "submission_date",
                                                       "source", "is_malicious")


IP_BATCH_COLS = """'IPv4' AS ip_version, CASE WHEN event_id % 2 = 0 THEN 'XX' END AS country,
    CASE WHEN event_id % 3 = 0 THEN concat('isp', event_id % 5) END AS isp,
    CASE WHEN event_id % 5 = 0 THEN cast(event_id % 90 AS double) END AS threat_score,
    event_id AS seq"""


def ip_batch(d: Dialect) -> str:
    return f"SELECT {d.ip('user_id * 20')} AS ip_address, {IP_BATCH_COLS} FROM events"


@query("ip_upsert", f"""SELECT ip_address,
    arg_max(country, seq) FILTER (country IS NOT NULL) AS country,
    arg_max(isp, seq) FILTER (isp IS NOT NULL) AS isp,
    arg_max(threat_score, seq) FILTER (threat_score IS NOT NULL) AS threat_score,
    {fmt(f"CASE WHEN max(seq) >= 0 THEN {NOW} ELSE max(last_seen) END")} AS last_seen,
    cast(CASE WHEN min(seq) = -1 THEN max(total_requests) + count(*) - 1 ELSE count(*) - 1 END
      AS BIGINT) AS total_requests FROM (
      SELECT ip_address, country, isp, threat_score, last_seen, total_requests, -1 AS seq FROM ips_v
      UNION ALL SELECT ip_address, country, isp, threat_score, NULL, NULL, seq
      FROM ({ip_batch(DUCK)})) GROUP BY 1""")
def _(t):
    return B.ip_upsert(t.ips_v, t.sql(ip_batch(Dialect("spark"))), AS_OF).select(
        "ip_address", "country", "isp", "threat_score", "last_seen", "total_requests")


def threat_batch(d: Dialect) -> str:
    return f"""SELECT {d.ip('user_id')} AS ip_address, 'malware' AS threat_type,
        'feed_a' AS source_feed, cast(event_id % 100 AS double) AS confidence_score,
        concat('event ', event_id) AS description, event_id AS seq FROM events"""


@query("threat_upsert", f"""SELECT ip_address, threat_type, source_feed, confidence_score,
    description, {fmt('lu')} AS last_updated FROM (
      SELECT ip_address, threat_type, source_feed, confidence_score, description,
        last_updated AS lu, 0 AS g, threat_id AS i FROM threats_v
      UNION ALL SELECT ip_address, threat_type, source_feed, confidence_score, description,
        {NOW}, 1, seq FROM ({threat_batch(DUCK)}))
    QUALIFY row_number() OVER (PARTITION BY ip_address, threat_type, source_feed
      ORDER BY g DESC, lu DESC, i DESC) = 1""")
def _(t):
    return B.threat_upsert(t.threats_v, t.sql(threat_batch(Dialect("spark"))), AS_OF)


CACHE = """SELECT o_orderkey AS seq, o_custkey AS url_id,
    concat('{"a":', o_orderkey % 97, '.5,"b":', o_custkey, '.0}') AS feature_vector,
    2 AS feature_count, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderkey % 50 END
      AS processing_time_ms, o_orderdate AS extraction_timestamp FROM orders"""


@query("feature_cache_upsert", f"""SELECT url_id,
    arg_max(feature_vector, (g, seq)) AS feature_vector,
    {fmt("arg_max(e, (g, seq))")} AS extraction_timestamp,
    arg_max(processing_time_ms, (g, seq)) FILTER (processing_time_ms IS NOT NULL)
      AS processing_time_ms
    FROM (SELECT *, CASE WHEN seq % 5 = 0 THEN 1 ELSE 0 END AS g,
            CASE WHEN seq % 5 = 0 THEN {NOW} ELSE extraction_timestamp END AS e FROM ({CACHE}))
    GROUP BY 1""")
def _(t):
    rows = t.sql(CACHE)
    return B.feature_cache_upsert(rows.where("seq % 5 <> 0"), rows.where("seq % 5 = 0"),
                                  AS_OF).select("url_id", "feature_vector", "extraction_timestamp",
                                                "processing_time_ms")


def score_batch(d: Dialect) -> str:
    return (f"SELECT {d.ip('user_id * 3')} AS ip_address, round(value % 100, 2) AS score, "
            "event_id AS seq FROM events")


@query("ip_reputation_update", f"""SELECT i.ip_address, coalesce(s, threat_score) AS threat_score,
    {fmt(f"CASE WHEN s IS NULL THEN last_seen ELSE {NOW} END")} AS last_seen FROM ips_v i LEFT JOIN
    (SELECT ip_address, arg_max(score, seq) AS s FROM ({score_batch(DUCK)}) GROUP BY 1) b
    USING (ip_address)""")
def _(t):
    return B.ip_reputation_update(t.ips_v, t.threats_v, t.sql(score_batch(Dialect("spark"))),
                                  AS_OF)[0].select("ip_address", "threat_score", "last_seen")


@query("ip_reputation_threats", f"""SELECT ip_address, arg_max(score, seq) AS confidence_score
    FROM ({score_batch(DUCK)}) WHERE score > 70 GROUP BY 1""")
def _(t):
    out = B.ip_reputation_update(t.ips_v, t.threats_v, t.sql(score_batch(Dialect("spark"))), AS_OF)
    return out[1].where("source_feed = 'internal_model'").select("ip_address", "confidence_score")


@query("retention_cleanup", f"""SELECT log_id, src_ip, {fmt('ts')} AS ts FROM traffic_v
    WHERE ts >= {NOW} - INTERVAL 10 DAY""")
def _(t):
    return B.retention_cleanup(t.traffic_v, 10, AS_OF).select("log_id", "src_ip", "ts")


@query("retention_counts", " UNION ALL ".join(f"""SELECT '{n}' AS table_name,
    count(*) FILTER (ts >= {NOW} - INTERVAL 10 DAY) AS kept,
    count(*) FILTER (ts < {NOW} - INTERVAL 10 DAY) AS deleted FROM {v}"""
    for n, v in [("traffic_logs", "traffic_v"), ("audit_logs", "audit_v")]))
def _(t):
    return B.retention_counts({"traffic_logs": t.traffic_v, "audit_logs": t.audit_v}, 10, AS_OF)


@query("alert_retention", f"""SELECT alert_id, status FROM alerts_v WHERE NOT coalesce(
    status IN ('resolved', 'false_positive') AND resolved_at < {NOW} - INTERVAL 15 DAY, false)""")
def _(t):
    return B.alert_retention(t.alerts_v, AS_OF, 15).select("alert_id", "status")


LABELS = "SELECT event_id % 2000 AS url_id, value > 50 AS is_malicious, event_id AS seq FROM events"


@query("label_update", f"""SELECT url_id, coalesce(l.m, is_malicious) AS is_malicious FROM urls_v
    LEFT JOIN (SELECT url_id, arg_max(is_malicious, seq) AS m FROM ({LABELS}) GROUP BY 1) l
    USING (url_id)""")
def _(t):
    return B.label_update(t.urls_v, t.sql(LABELS)).select("url_id", "is_malicious")
