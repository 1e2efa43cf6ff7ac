"""Checked queries: every streaming operator, run as a real stream over files of events.

The events table is dealt out over six files, and a micro-batch reads one. Some events come a file
late, some three files late. Windowed results are emitted once the watermark has passed the window,
so the counterpart leaves out windows that end after the last event minus the delay, and rows that
arrive when their window has been closed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from linkguard.plans.catalog_intel import quick_sql
from linkguard.plans.oracle_ctes import CTES
from linkguard.plans.registry import fmt, query
from linkguard.plans.views import AS_OF, Dialect, Tables, stream_flow_columns
from linkguard.shared import shared_folder
from linkguard.sources.flows import flow_urls
from linkguard.streaming import streams as S
from linkguard import constants as C


FILES = 6
ROW_GROUP = 2 << 20
IN_ORDER = f"event_id * {FILES} {{0}} (SELECT max(event_id) + 1 FROM events)"
LATE = "CASE WHEN event_id % 97 = 0 THEN 1 WHEN event_id % 101 = 0 THEN 3 ELSE 0 END"


def event_stream(t: Tables, late: bool = True) -> DataFrame:
    """The events as a stream of six files, written one after the other. The table is read and cut by all tasks; a file has
    small row groups, so that a micro-batch is read by several tasks."""
    nth = f"least({FILES - 1}, {IN_ORDER.format('div')} + {LATE if late else 0})"
    events, path = t.sql(f"SELECT *, cast({nth} AS int) AS nth FROM events"), shared_folder(t.spark, "events")
    for i in range(FILES):
        events.where(f"nth = {i}").drop("nth").repartition(1).write.mode("append").option("parquet.block.size", ROW_GROUP).parquet(path)
    return S.file_stream(t.spark, path, events.drop("nth").schema)


def flow_stream(t: Tables, late: bool = True) -> DataFrame:
    return event_stream(t, late).selectExpr(*stream_flow_columns(Dialect("spark")))


CTES["t_files"] = f"SELECT event_id, ts, least({FILES - 1}, {IN_ORDER.format('//')} + {LATE}) AS nth FROM events"


def on_time(rows: str, end: str, delay: str) -> str:
    """Rows whose window was open when they came: a batch drops by the watermark of the batch before it, which rests on
    the files before that one."""
    return (f"SELECT r.* FROM ({rows}) r WHERE NOT EXISTS (SELECT 1 FROM (SELECT f.nth, max(e.ts) AS t FROM "
            f"(SELECT DISTINCT nth FROM t_files) f JOIN ({rows}) e ON e.nth <= f.nth - 2 GROUP BY 1) m "
            f"WHERE m.nth = r.nth AND {end} <= m.t - INTERVAL {delay})")


CTES["t_urls"] = """SELECT *, coalesce(http_host, sni, rtrim(qname, '.')) AS domain,
    CASE WHEN http_host IS NOT NULL THEN 'http://' || http_host || coalesce(http_path, '/')
      WHEN sni IS NOT NULL THEN 'https://' || sni || '/' ELSE 'dns://' || rtrim(qname, '.') END
      AS url FROM sflows_v"""
CTES["t_end"] = "SELECT max(ts) AS t FROM sflows_v"


CTES["t_rate"] = on_time("SELECT s.*, nth FROM sflows_v s JOIN t_files USING (event_id)",
                         "time_bucket(INTERVAL 6 HOUR, r.ts) + INTERVAL 6 HOUR", "2 MINUTE")


@query("stream_rate_window", f"""SELECT {fmt('ws')} AS window_start, src_ip, n FROM
    (SELECT time_bucket(INTERVAL 6 HOUR, ts) AS ws, src_ip, count(*) AS n FROM t_rate
     GROUP BY 1, 2) WHERE n > 2 AND ws + INTERVAL 6 HOUR <= (SELECT t FROM t_end) -
       INTERVAL 2 MINUTE""")
def _(t):
    out = S.drain(S.rate_window(flow_stream(t), 2, "6 hours"), shared_folder(t.spark, "rate"))
    return out.select("window_start", "src_ip", "n")


@query("stream_first_seen_domain", f"""SELECT domain, {fmt('first.ts')} AS ts, first.event_id AS event_id FROM
    (SELECT domain, min(struct_pack(nth := nth, ts := u.ts, event_id := event_id)) AS first
     FROM t_urls u JOIN t_files USING (event_id) GROUP BY 1)""")
def _(t):
    return S.first_seen_domain(flow_urls(flow_stream(t)), shared_folder(t.spark, "domains"))


CTES["t_threats"] = quick_sql(C.LIVE_TLDS, C.LIVE_KEYWORDS, 2, "'suspicious_tld:' || tld",
                              "'suspicious_keywords:' || array_to_string(kw, ',')").replace(
    "a_flow_urls", "t_urls")
CTES["t_alerts"] = """SELECT u.event_id, u.ts, src_ip AS source_ip, 'Live: ' || domain || ' (' ||
    reason || ')' AS description FROM t_threats JOIN t_urls u USING (event_id) WHERE is_threat"""
# a state of one time per key, fed in the order of files, times and ids; rows behind the watermark are dropped on the way
def throttled(name: str, rows: str, keys: str, id_col: str) -> None:
    mine, on = (", ".join(f"e.{k}" for k in keys.split(", ")), " AND ".join(f"f.{k} = e.{k}" for k in keys.split(", ")))
    CTES[f"{name}_due"] = on_time(f"SELECT a.*, nth FROM {rows} a JOIN t_files f ON f.event_id = a.{id_col}", "r.ts", "7 DAY")
    sent = f"struct_pack(nth := {{0}}nth, ts := {{0}}ts, id := {{0}}{id_col})"
    CTES[f"{name}_sent"] = f"""
    SELECT {keys}, min({sent.format('')}) AS sent FROM {name}_due GROUP BY {keys}
    UNION ALL
    SELECT {mine}, min({sent.format('f.')}) FROM {name}_sent e JOIN {name}_due f ON {on}
      AND f.nth >= e.sent.nth AND f.ts >= e.sent.ts + INTERVAL 60 SECOND GROUP BY {mine}, e.sent"""


throttled("t_tries", "alert_attempts", "source_ip, alert_type", "attempt_id")
throttled("t_flowing", "t_alerts", "source_ip", "event_id")


@query("stream_alert_throttle", "SELECT sent.id AS attempt_id FROM t_tries_sent")
def _(t):
    from linkguard.plans.views import view_sql
    # the attempts view, row by row over the stream
    body = view_sql("spark")["alert_attempts"]
    cols = body[body.index("SELECT") + 6:body.rindex("FROM events")]
    event_stream(t).withColumn("ts", F.col("ts").cast("timestamp_ntz")).createOrReplaceTempView("_attempt_events")
    attempts = t.spark.sql(f"SELECT {cols} FROM _attempt_events").select(
        "attempt_id", "source_ip", "alert_type", F.col("ts").cast("timestamp").alias("ts"))
    return S.alert_throttle(attempts, shared_folder(t.spark, "throttle"), "attempt_id", watermark="7 days").select("attempt_id")


@query("stream_threat_alerts", """SELECT event_id, source_ip, 'other' AS alert_type,
    'high' AS severity, description FROM t_alerts WHERE event_id IN (SELECT sent.id FROM t_flowing_sent)""")
def _(t):
    return S.threat_alert_stream(flow_stream(t), shared_folder(t.spark, "threats"), "7 days").drop("ts")


@query("stream_ip_profile", f"""SELECT src_ip, count(*) AS request_count,
    {fmt('min(ts)')} AS first_seen, {fmt('max(ts)')} AS last_seen, count(DISTINCT dst_ip) AS destinations,
    array_to_string(list_sort(list(DISTINCT CASE transport WHEN 'TCP' THEN CASE dst_port
      WHEN 80 THEN 'HTTP' WHEN 8080 THEN 'HTTP' WHEN 443 THEN 'HTTPS' ELSE 'TCP' END
      WHEN 'UDP' THEN CASE dst_port WHEN 53 THEN 'DNS' ELSE 'UDP' END ELSE 'OTHER' END)), ',')
      AS protocols, cast(sum(size) AS BIGINT) AS total_bytes FROM sflows_v GROUP BY 1""")
def _(t):
    return S.ip_profile(flow_stream(t), shared_folder(t.spark, "profile"))


@query("stream_url_counts", "SELECT url, count(*) AS n FROM t_urls GROUP BY 1")
def _(t):
    return S.url_counts(flow_urls(flow_stream(t)), shared_folder(t.spark, "urls"))


@query("stream_recent_buffers", f"""SELECT event_id, src_ip, {fmt('ts')} AS ts FROM sflows_v
    ORDER BY sflows_v.ts DESC, event_id DESC LIMIT 100""")
def _(t):
    return S.recent_rows(flow_stream(t).select("event_id", "ts", "src_ip"), shared_folder(t.spark, "recent"), 100)


@query("stream_url_sink", """SELECT url AS full_url, any_value(domain) AS domain,
    CASE WHEN contains(url, 'https') THEN 'https' ELSE 'http' END AS protocol,
    'live_traffic' AS source FROM t_urls GROUP BY url""")
def _(t):
    return S.url_sink(flow_urls(flow_stream(t)), shared_folder(t.spark, "url_sink"), t.urls_v.limit(0), AS_OF).select(
        "full_url", "domain", "protocol", "source")


@query("stream_ip_touch", f"""SELECT ip_address, strftime(CASE WHEN s IS NULL THEN last_seen ELSE
      TIMESTAMP '{AS_OF}' END, '%Y-%m-%d %H:%M:%S') AS last_seen,
    total_requests + coalesce(s, 0) AS total_requests FROM ips_v
    LEFT JOIN (SELECT src_ip AS ip_address, count(DISTINCT nth) AS s FROM sflows_v JOIN t_files USING (event_id)
               GROUP BY 1) USING (ip_address)""")
def _(t):
    stored = t.ips_v.selectExpr("ip_address", "ip_version", "country", "city", "region", "latitude",
                                "longitude", "isp", "organization", "asn", "threat_score",
                                "first_seen", "last_seen",
                                "cast(total_requests as bigint) AS total_requests")
    return S.ip_touch(flow_stream(t), shared_folder(t.spark, "ip_touch"), stored, AS_OF).select(
        "ip_address", "last_seen", "total_requests")


PORT_FLOWS = "SELECT s.*, nth FROM sflows_v s JOIN t_files USING (event_id) WHERE dst_port IN (22, 23, 445, 3389, 8080)"
CTES["t_ports"] = on_time(PORT_FLOWS, "time_bucket(INTERVAL 10 MINUTE, r.ts) + INTERVAL 10 MINUTE", "20 MINUTE")
CTES["t_visits"] = on_time("SELECT s.*, nth FROM t_urls s JOIN t_files USING (event_id)",
                           "time_bucket(INTERVAL 1 DAY, r.ts) + INTERVAL 1 DAY", "1 HOUR")


@query("stream_suspicious_ports", f"""SELECT {fmt('ws')} AS window_start, src_ip, n, ports FROM
    (SELECT time_bucket(INTERVAL 10 MINUTE, ts) AS ws, src_ip, count(*) AS n,
      array_to_string(list_sort(list(DISTINCT dst_port)), ',') AS ports FROM t_ports GROUP BY 1, 2)
    WHERE ws + INTERVAL 10 MINUTE <= (SELECT max(ts) FROM sflows_v
      WHERE dst_port IN (22, 23, 445, 3389, 8080)) - INTERVAL 20 MINUTE""")
def _(t):
    return S.drain(S.suspicious_ports(flow_stream(t)), shared_folder(t.spark, "ports"))


@query("stream_many_urls", f"""SELECT {fmt('ws')} AS window_start, src_ip, n_urls FROM
    (SELECT time_bucket(INTERVAL 1 DAY, ts) AS ws, src_ip, count(DISTINCT url) AS n_urls FROM t_visits
     GROUP BY 1, 2) WHERE n_urls > 2 AND ws + INTERVAL 1 DAY <= (SELECT t FROM t_end) -
       INTERVAL 1 HOUR""")
def _(t):
    return S.drain(S.many_urls(flow_urls(flow_stream(t)), 2), shared_folder(t.spark, "many"))
