"""Adapter views: the URL / IP / alert tables derived from the given parquet tables.

Every view is one SQL text with a handful of dialect differences (interval
arithmetic, series explosion, integer division), so the Spark session and the
SQL checker start from the same rows. Views are resolved by name: ``with_views``
prefixes a query with the views it mentions.
"""

from __future__ import annotations

import re
from functools import lru_cache

AS_OF = "2024-01-31 00:00:00"
AS_OF_ORDERS = "1998-12-31 00:00:00"
BASE_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
               "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def pick(expr: str, values: list, quote: bool = True) -> str:
    """CASE over a 0-based integer expression."""
    def lit(v):
        return "NULL" if v is None else (f"'{v}'" if quote else str(v))
    whens = " ".join(f"WHEN {i} THEN {lit(v)}" for i, v in enumerate(values))
    return f"(CASE {expr} {whens} END)"


class Dialect:
    def __init__(self, name: str):
        self.name = name
        self.spark = name == "spark"

    def ts(self, text: str) -> str:
        return f"TIMESTAMP_NTZ '{text}'" if self.spark else f"TIMESTAMP '{text}'"

    def add(self, ts: str, unit: str, n: str) -> str:
        if self.spark:
            return f"timestampadd({unit.upper()}, cast({n} as int), {ts})"
        return f"({ts} + to_{unit.lower()}s(cast({n} as bigint)))"

    def diff_us(self, a: str, b: str) -> str:
        if self.spark:
            return f"timestampdiff(MICROSECOND, {a}, {b})"
        return f"date_diff('microsecond', {a}, {b})"

    def add_us(self, ts: str, n: str) -> str:
        if self.spark:
            return f"timestampadd(MICROSECOND, {n}, {ts})"
        return f"({ts} + to_microseconds({n}))"

    def idiv(self, a: str, b) -> str:
        return f"(({a}) div {b})" if self.spark else f"(({a}) // {b})"

    def series(self, n: int) -> str:
        return f"explode(sequence(0, {n - 1}))" if self.spark else f"unnest(range(0, {n}))"

    def ip(self, n: str) -> str:
        """Distinct dotted address for n < 200*256*256."""
        return (f"concat(11 + ({n}) % 200, '.', {self.idiv(n, 200)} % 256, '.', "
                f"{self.idiv(n, 51200)} % 256, '.', (29 * ({n})) % 256)")


def stream_flow_columns(d: "Dialect") -> list[str]:
    """Flow columns computed from one event row, for the batch view and for a stream of events."""
    k = "cast(regexp_extract(props, '[0-9]+', 0) as bigint)"
    host = (f"concat('host', user_id % 40, '.', "
            f"{pick('event_id % 5', ['com', 'tk', 'org', 'xyz', 'net'])})")
    return [
        "event_id", "ts", f"{d.ip('user_id')} AS src_ip", f"{d.ip(k)} AS dst_ip",
        "cast(1024 + event_id % 50000 as int) AS src_port",
        f"cast({pick(f'{k} % 8', [80, 443, 53, 8080, 22, 23, 445, 3389], False)} as int) "
        "AS dst_port",
        "CASE WHEN event_type = 'error' THEN 'ICMP' WHEN event_type = 'signup' THEN 'UDP' "
        "ELSE 'TCP' END AS transport", "cast(floor(value * 3) as int) AS size",
        f"CASE WHEN event_id % 4 < 2 THEN {host} END AS http_host",
        f"CASE WHEN event_id % 3 = 0 THEN '/login/verify?account=1' END AS http_path",
        f"CASE WHEN event_id % 4 = 2 THEN {host} END AS sni",
        f"CASE WHEN event_id % 4 = 3 THEN concat({host}, '.') END AS qname"]


COUNTRY_CODES = ["US", "DE", "RU", "CN", "BR", "IN", "KP", "GB", "NG", "FR", "IR", "JP", "PK",
                 "CA", "VN", "NL", "BY", "SG", "TR", "AU", "UA", "SE", "CU", "ID", "MM"]
ASNS = ["AS16509", "AS9009", "AS7922", "AS14061", "AS3320", "AS60068", "AS701", "AS13335",
        "AS212238", "AS4134", "AS24940", None]


@lru_cache(maxsize=None)
def view_sql(dialect: str) -> dict[str, str]:
    d = Dialect(dialect)
    base = d.ts("2024-01-01 00:00:00")
    k = "cast(regexp_extract(props, '[0-9]+', 0) as bigint)"
    n_urls = "(SELECT count(*) * 12 FROM pages)"
    n_events = "(SELECT count(*) FROM events)"
    src_ip = (f"CASE WHEN user_id % 10 = 0 THEN concat('185.220.', user_id % 256, '.', "
              f"(user_id * 7) % 256) ELSE {d.ip('user_id')} END")
    v: dict[str, str] = {}

    v["corpus_rows"] = f"SELECT page_id, url, {d.series(12)} AS v FROM pages"
    squat_a = pick("page_id % 8", ["paypa1", "arnazon", "goole", "gougle", "app1e", "netfl1x",
                                   "faecbook", "mocrisoft"])
    squat_b = pick("page_id % 8", ["micros0ft", "micosoft", "amaz0n", "faceboook", "paypal-id",
                                   "linkedln", "paypal-secure", "instagarm"])
    v["url_corpus"] = f"""
      SELECT page_id * 12 + v AS url_id, page_id, v, CASE v
        WHEN 0 THEN url
        WHEN 1 THEN replace(url, '://', '://user:pw@')
        WHEN 2 THEN concat(replace(url, 'https://', 'http://'), '&redirect=1')
        WHEN 3 THEN concat('https://', {squat_a}, '.com/login/', page_id)
        WHEN 4 THEN concat('http://192.168.', page_id % 64, '.7/admin')
        WHEN 5 THEN concat('http://0x7f.0.0.1/a%2520b/', page_id)
        WHEN 6 THEN concat('http://login-verify-', page_id % 50, '.tk/account.php?next=', url)
        WHEN 7 THEN concat('HTTPS://WWW.Google.com:443/search?q=', page_id)
        WHEN 8 THEN concat('shop.example.co.uk:8080/a/b.exe?x=', page_id, '&x=2&y')
        WHEN 9 THEN concat('https://www.', {squat_b}, '.com/%6C%6F%67%69%6E/', page_id, '?u=a%40b')
        WHEN 10 THEN concat('https://xn--pypal-4ve.com/signin?id=', page_id)
        ELSE concat('https://docs.python.org/3/', page_id, '.html') END AS full_url
      FROM corpus_rows"""

    host_re = r"^([a-zA-Z]+://)?([^@/]*@)?([^:/?#]+)"
    v["urls_v"] = f"""
      SELECT url_id, full_url, lower(regexp_extract(full_url, '{host_re}', 3)) AS domain,
        coalesce(nullif(regexp_extract(full_url, '^([a-zA-Z]+://)?[^/?#]+([^?#]*)', 2), ''), '/')
          AS path,
        CASE WHEN full_url LIKE '%://%' THEN lower(regexp_extract(full_url, '^([a-zA-Z]+)://', 1))
             ELSE 'http' END AS protocol,
        regexp_extract(lower(regexp_extract(full_url, '{host_re}', 3)), '([^.]*)$', 1) AS tld,
        cast(length(full_url) as int) AS url_length,
        {d.add(base, 'minute', 'url_id')} AS submission_date,
        {pick('v', ['crawl', 'live_traffic', 'crawl', 'phish_json', 'manual', 'malware_csv',
                    'phish_lines', 'top_sites', 'traffic_capture', 'phish_csv', 'phish_lines',
                    'top_sites'])} AS source,
        CASE WHEN page_id % 7 = 0 THEN NULL ELSE v IN (3, 5, 6, 9, 10) END AS is_malicious
      FROM url_corpus"""

    v["traffic_v"] = f"""
      SELECT event_id AS log_id, ts, {src_ip} AS src_ip, {d.ip(k)} AS dst_ip,
        cast(1024 + event_id % 50000 as int) AS src_port,
        cast({pick(f'{k} % 8', [80, 443, 53, 8080, 22, 23, 445, 3389], False)} as int) AS dst_port,
        event_id % {n_urls} AS url_id,
        CASE event_type WHEN 'click' THEN 'HTTP' WHEN 'view' THEN 'HTTPS' WHEN 'purchase'
          THEN 'HTTPS' WHEN 'signup' THEN 'DNS' ELSE 'OTHER' END AS protocol,
        CASE WHEN event_type IN ('click', 'view') THEN 'GET' ELSE 'POST' END AS request_method,
        cast(CASE WHEN event_type = 'error' THEN 500 ELSE 200 END as int) AS response_code,
        cast(CASE WHEN {k} % 9 = 0 THEN 0 ELSE floor(value * 3) END as int) AS payload_size,
        cast(event_id % 977 as int) AS connection_duration_ms
      FROM events"""

    status = pick("event_id % 5", ["new", "acknowledged", "investigating", "resolved",
                                   "false_positive"])
    raw_type = ("CASE event_type WHEN 'click' THEN 'malicious_url' WHEN 'view' THEN 'suspicious_ip' "
                "WHEN 'purchase' THEN 'high_traffic' WHEN 'signup' THEN 'dns_anomaly' "
                "ELSE {} END")
    severity = ("CASE WHEN value >= 120 THEN 'critical' WHEN value >= 60 THEN 'high' "
                "WHEN value >= 25 THEN 'medium' ELSE 'low' END")
    legal = raw_type.format(pick("event_id % 3",
                                 ["geolocation_mismatch", "frequency_attack", "other"]))
    v["alerts_v"] = f"""
      SELECT alert_id, ts, alert_type, severity, source_ip, destination_ip, url_id, description,
        status,
        CASE WHEN status IN ('resolved', 'false_positive') THEN 'analyst' END AS resolved_by,
        CASE WHEN status IN ('resolved', 'false_positive') THEN 'closed' END AS resolution_notes,
        CASE WHEN status IN ('resolved', 'false_positive')
             THEN {d.add('ts', 'minute', 'alert_id % 600')} END AS resolved_at
      FROM (SELECT event_id AS alert_id, ts, {legal} AS alert_type, {severity} AS severity,
              {src_ip} AS source_ip, {d.ip(k)} AS destination_ip, event_id % {n_urls} AS url_id,
              concat('Live: ', event_type, ' k=', {k}, ' user ', user_id) AS description,
              {status} AS status
            FROM events) a"""

    v["alert_attempts"] = f"""
      SELECT event_id AS attempt_id, {d.ip('user_id')} AS source_ip,
        {raw_type.format("'suspicious_url'")} AS alert_type,
        CASE WHEN value >= 200 THEN 'urgent' ELSE {severity} END AS severity,
        CASE WHEN event_id % 6 = 0 THEN NULL ELSE concat('203.0.113.', {k}) END AS destination_ip,
        concat('attempt ', event_id) AS description,
        {d.add_us(base, d.idiv(d.diff_us(base, 'ts'), 1000))} AS ts
      FROM events"""

    v["status_commands"] = f"""
      SELECT event_id AS cmd_id, ({d.idiv('event_id', 3)} * 5) % ({n_events} + 50) AS alert_id,
        {pick('event_id % 7', ['acknowledged', 'investigating', 'resolved', 'false_positive',
                               'new', 'closed', 'investigating'])} AS new_status,
        concat('analyst', user_id % 5) AS user_name, concat('note ', event_id) AS notes, ts
      FROM events"""

    v["ips_v"] = f"""
      SELECT c_custkey AS ip_id, {d.ip('c_custkey')} AS ip_address, 'IPv4' AS ip_version,
        n_name AS country, {pick('n_nationkey', COUNTRY_CODES)} AS country_code,
        concat('City_', c_custkey % 40) AS city, concat('Region_', n_regionkey) AS region,
        cast((c_custkey % 180) - 90 as double) AS latitude,
        cast((c_custkey % 360) - 180 as double) AS longitude,
        CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE concat('ISP ', c_mktsegment) END AS isp,
        concat('Org ', c_custkey % 97) AS organization, {pick('c_custkey % 12', ASNS)} AS asn,
        round(abs(c_acctbal) % 100, 2) AS threat_score,
        {d.add(d.ts('2020-01-01 00:00:00'), 'day', 'c_custkey % 1400')} AS first_seen,
        {d.add(base, 'minute', 'c_custkey % 40000')} AS last_seen,
        cast(c_custkey % 500 as int) AS total_requests
      FROM customer JOIN nation ON c_nationkey = n_nationkey"""

    v["threats_v"] = f"""
      SELECT o_orderkey AS threat_id, {d.ip('o_custkey')} AS ip_address,
        CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'malware' WHEN '2' THEN 'phishing'
          WHEN '3' THEN 'botnet' WHEN '4' THEN 'scanner' ELSE 'spam' END AS threat_type,
        round(o_totalprice % 100, 2) AS confidence_score,
        CASE o_orderstatus WHEN 'O' THEN 'feed_a' WHEN 'F' THEN 'feed_b' ELSE 'feed_c' END
          AS source_feed,
        concat('order ', o_orderkey) AS description, o_orderdate AS first_reported,
        {d.add('o_orderdate', 'day', 'o_orderkey % 30')} AS last_updated,
        o_orderkey % 3 <> 0 AS is_active
      FROM orders"""

    v["predictions_v"] = f"""
      SELECT prediction_id, url_id, prediction_score,
        CASE WHEN prediction_score >= 0.7 THEN 'malicious' WHEN prediction_score < 0.3
          THEN 'benign' ELSE 'suspicious' END AS predicted_class,
        model_name, model_version, prediction_timestamp
      FROM (SELECT o_orderkey AS prediction_id, o_orderkey % {n_urls} AS url_id,
              (cast(floor(o_totalprice) as bigint) % 10000) / cast(10000 as double)
                AS prediction_score,
              CASE o_orderstatus WHEN 'O' THEN 'random_forest' WHEN 'F' THEN 'gbt'
                ELSE 'logistic' END AS model_name,
              concat('v', o_custkey % 3) AS model_version, o_orderdate AS prediction_timestamp
            FROM orders) p"""

    v["dns_v"] = f"""
      SELECT url_id AS record_id, CASE WHEN url_id % 12 IN (4, 5) THEN '' ELSE domain END AS domain, record_type, CASE record_type
          WHEN 'A' THEN CASE WHEN url_id % 11 = 0 THEN concat('10.0.', url_id % 200, '.9')
                        ELSE {d.ip('url_id % 1400')} END
          WHEN 'AAAA' THEN concat('2a00:1450::', url_id % 9000)
          WHEN 'MX' THEN {pick('url_id % 5', ['aspmx.l.google.com', 'x.mail.protection.outlook.com',
                                            'mx.zoho.eu', 'mail.protonmail.ch', 'mx.own.net'])}
          WHEN 'NS' THEN {pick('url_id % 6', ['ada.ns.cloudflare.com', 'ns-1.awsdns-2.com',
                               'ns37.domaincontrol.com', 'ns1.digitalocean.com', 'ns.own.net',
                               'ns1-01.azure-dns.com'])}
          WHEN 'TXT' THEN {pick('url_id % 4', ['v=spf1 -all', 'V=DMARC1; p=none',
                                             'v=DKIM1; k=rsa', 'site-verification=1'])}
          WHEN 'CNAME' THEN concat('edge-', url_id % 7, '.cdn.net')
          ELSE 'ns.own.net hostmaster' END AS record_value,
        cast(60 + url_id % 3600 as int) AS ttl, submission_date AS query_timestamp,
        cast(url_id % 250 as int) AS response_time_ms
      FROM (SELECT *, {pick('url_id % 7', ['A', 'AAAA', 'CNAME', 'MX', 'NS', 'TXT', 'SOA'])}
              AS record_type FROM urls_v) u"""

    v["whois_v"] = f"""
      SELECT url_id AS record_id, CASE WHEN url_id % 12 IN (4, 5, 7) THEN '' ELSE domain END AS domain,
        CASE WHEN url_id % 13 = 0 THEN NULL ELSE
          {d.add(d.ts(AS_OF), 'day', '-1 * ((url_id * 37) % 4000) - 5')} END AS creation_date,
        CASE WHEN url_id % 17 = 0 THEN NULL ELSE
          {d.add(d.ts(AS_OF), 'day', '((url_id * 11) % 900) - 20')} END AS expiration_date,
        {pick('url_id % 6', ['NameCheap, Inc.', 'GoDaddy.com, LLC', 'MarkMonitor Inc.',
                             'Gandi SAS', None, 'Tucows Domains'])} AS registrar,
        concat('NS', url_id % 14, '.OWN.NET.') AS name_server
      FROM urls_v"""

    v["abuse_feed_v"] = f"""
      SELECT {d.ip('c_custkey')} AS ip_address,
        cast(floor(abs(c_acctbal)) as int) % 101 AS abuse_score,
        cast(c_custkey % 50 as int) AS total_reports,
        {pick('c_nationkey', COUNTRY_CODES)} AS country,
        CASE WHEN c_custkey % 4 = 0 THEN '' ELSE concat('Abuse ISP ', c_custkey % 9) END AS isp
      FROM customer"""

    v["geo_feed_v"] = f"""
      SELECT {d.ip('s_suppkey * 7')} AS ip_address,
        {pick('s_nationkey', COUNTRY_CODES)} AS country_code,
        CASE WHEN s_suppkey % 6 = 0 THEN '' ELSE concat('Country_', s_nationkey) END AS country,
        concat('GeoCity_', s_suppkey % 30) AS city,
        cast(s_suppkey % 90 as double) AS latitude, cast(s_suppkey % 180 as double) AS longitude,
        CASE WHEN s_suppkey % 7 = 0 THEN '' ELSE concat('Geo ISP ', s_suppkey % 11) END AS isp,
        CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE concat('Geo Org ', s_suppkey) END AS org,
        {pick('s_suppkey % 4', ['AS16509 Amazon.com', 'AS9009 M247 Ltd', 'as7922 Comcast', None])}
          AS as_text,
        s_suppkey % 5 = 0 AS proxy, s_suppkey % 8 = 0 AS hosting
      FROM supplier"""

    v["vt_feed_v"] = f"""
      SELECT {d.ip('c_custkey')} AS ip_address, cast(c_custkey % 60 as int) AS malicious,
        cast(c_custkey % 7 as int) AS suspicious,
        cast(CASE WHEN c_custkey % 8 = 0 THEN 0 ELSE 40 END as int) AS harmless,
        cast(CASE WHEN c_custkey % 8 = 0 THEN 0 ELSE c_custkey % 30 END as int) AS undetected
      FROM customer"""

    v["redirect_hops"] = f"""
      SELECT {d.idiv('url_id', 4)} AS chain_id, cast(url_id % 4 as int) AS hop, full_url
      FROM url_corpus"""

    v["flows_v"] = f"""
      SELECT event_id, ts, {src_ip} AS src_ip, {d.ip(k)} AS dst_ip,
        cast(1024 + event_id % 50000 as int) AS src_port,
        cast({pick(f'{k} % 8', [80, 443, 53, 8080, 22, 23, 445, 3389], False)} as int) AS dst_port,
        CASE WHEN event_type = 'error' THEN 'ICMP' WHEN {k} % 8 = 2 OR event_type = 'signup'
          THEN 'UDP' ELSE 'TCP' END AS transport,
        cast(floor(value * 3) as int) AS size,
        CASE WHEN event_id % 4 = 0 THEN u.domain END AS http_host,
        CASE WHEN event_id % 8 = 0 THEN u.path END AS http_path,
        CASE WHEN event_id % 4 = 1 THEN u.domain WHEN event_id % 20 = 2 THEN 'a.b' END AS sni,
        CASE WHEN event_id % 4 = 2 THEN concat(u.domain, '.') WHEN event_id % 12 = 3
          THEN 'localhost' END AS qname
      FROM (SELECT *, event_id % {n_urls} AS u_id FROM events) e JOIN urls_v u ON u.url_id = u_id"""

    v["feed_json"] = """
      SELECT url_id AS pos, concat('{"phish_id":', url_id, ',"url":"',
        CASE WHEN url_id % 5 = 0 THEN '' ELSE full_url END,
        '","phish_detail_url":"http://detail.example.net/', url_id, '"}') AS line
      FROM url_corpus"""
    v["feed_csv"] = """
      SELECT CAST(-1 AS bigint) AS pos, 'phish_id,url,phish_detail_url' AS line
      FROM (SELECT max(page_id) AS m FROM pages) x
      UNION ALL SELECT url_id, concat(url_id, ',"', full_url, ',z",x') FROM url_corpus"""
    v["feed_lines"] = """
      SELECT CASE WHEN url_id % 2 = 0 THEN 'open_feed' ELSE 'army_feed' END AS source,
        url_id AS pos, concat('  ', full_url, ' ') AS line FROM url_corpus"""
    v["feed_malware_csv"] = """
      SELECT url_id AS pos, CASE WHEN url_id % 10 = 0 THEN concat('# note ', full_url) ELSE
        concat('"', url_id, '","2024-01-01","', full_url, '","online"') END AS line
      FROM url_corpus"""
    v["feed_malware_json"] = """
      SELECT page_id AS pos, concat('{"query_status":"ok","urls":[{"id":1,"url":"', url,
        '"},{"id":2,"url":""},{"id":3,"url":"ftp://files/', page_id, '"}]}') AS line FROM pages"""
    netset_ip = d.ip("c_custkey % 700")
    v["netset_lines"] = f"""
      SELECT concat('list', c_custkey % 3) AS source, {d.idiv('c_custkey', 3)} AS pos,
        CASE c_custkey % 7 WHEN 0 THEN '# comment' WHEN 1 THEN '' WHEN 2 THEN
          concat({netset_ip}, '/24') WHEN 3 THEN concat(' ', {netset_ip}, ' 5')
          WHEN 4 THEN concat({netset_ip}, chr(9), '3') WHEN 5 THEN 'not.an.ip.addr'
          ELSE {netset_ip} END AS line FROM customer"""

    v["sflows_v"] = f"SELECT {', '.join(stream_flow_columns(d))} FROM events"

    v["audit_v"] = f"""
      SELECT event_id AS audit_id, user_id, concat('alert_status:', {status}) AS action,
        'alerts' AS table_affected, event_id % 500 AS record_id, ts
      FROM events"""
    return v


_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


def with_views(sql: str, dialect: str, extra: dict[str, str] | None = None) -> str:
    """Prefix ``sql`` with the (transitively) referenced views as CTEs."""
    views = dict(view_sql(dialect))
    views.update(extra or {})
    order: list[str] = []

    def visit(text: str) -> None:
        for name in dict.fromkeys(_NAME.findall(text)):
            if name in views and name not in order:
                body = views[name]
                visit_guard.add(name)
                visit(re.sub(rf"\b{name}\b", " ", body))
                order.append(name)

    visit_guard: set[str] = set()
    visit(sql)
    if not order:
        return sql
    kw = "AS" if dialect == "spark" else "AS MATERIALIZED"
    ctes = ",\n".join(f"{n} {kw} ({views[n].strip()})" for n in order)
    recursive = "" if dialect == "spark" else "RECURSIVE "
    body = sql.strip()
    lead = re.match(r"WITH\s+(RECURSIVE\s+)?", body, re.IGNORECASE)
    body = ", " + body[lead.end():] if lead else body
    return f"WITH {recursive}{ctes}\n{body}"


class Tables:
    """Named access to the derived tables of one data folder."""

    def __init__(self, spark, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def base(self, name: str):
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def sql(self, query: str):
        text = with_views(query, "spark")
        for name in BASE_TABLES:
            text = re.sub(rf"\b(FROM|JOIN)(\s+){name}\b",
                          rf"\1\2parquet.`{self.folder}/{name}.parquet`", text)
        return self.spark.sql(text)

    def __getattr__(self, name: str):
        if name not in view_sql("spark"):
            raise AttributeError(name)
        return self.sql(f"SELECT * FROM {name}")
