"""Decoded packets to flow rows, and the URL a flow reveals."""

from __future__ import annotations

from pyspark.sql import DataFrame

from linkguard.functions.sqlutil import add


def flow_normalize(packets: DataFrame, variant: str = "monitor") -> DataFrame:
    """Protocol from transport and destination port. ``monitor`` names the transport when the port
    is not a web port; ``capture`` knows only HTTPS, HTTP, DNS and OTHER."""
    if variant == "monitor":
        rule = ("CASE WHEN transport = 'TCP' THEN CASE WHEN dst_port IN (80, 8080) THEN 'HTTP' "
                "WHEN dst_port = 443 THEN 'HTTPS' ELSE 'TCP' END WHEN transport = 'UDP' THEN "
                "CASE WHEN dst_port = 53 THEN 'DNS' ELSE 'UDP' END ELSE 'OTHER' END")
    else:
        rule = ("CASE WHEN transport = 'TCP' THEN CASE WHEN dst_port = 443 THEN 'HTTPS' "
                "ELSE 'HTTP' END WHEN transport = 'UDP' AND dst_port = 53 THEN 'DNS' "
                "ELSE 'OTHER' END")
    ports = "CASE WHEN transport IN ('TCP', 'UDP') THEN {0} " + (
        "ELSE 0 END" if variant == "monitor" else "END")
    return add(packets, protocol=rule, src_port=ports.format("src_port"),
               dst_port=ports.format("dst_port"))


def flow_urls(flows: DataFrame) -> DataFrame:
    """URL and domain by precedence HTTP host, TLS server name, DNS question; others are dropped."""
    df = add(
        flows, by_http="CASE WHEN http_host <> '' THEN http_host END",
        by_sni="CASE WHEN contains(sni, '.') AND sni RLIKE '^[ -~]+$' THEN sni END",
        by_dns="CASE WHEN contains(rtrim('.', qname), '.') THEN rtrim('.', qname) END")
    df = add(df, url="CASE WHEN by_http IS NOT NULL THEN concat('http://', by_http, "
                     "coalesce(nullif(http_path, ''), '/')) WHEN by_sni IS NOT NULL THEN "
                     "concat('https://', by_sni, '/') WHEN by_dns IS NOT NULL THEN "
                     "concat('dns://', by_dns) END",
             domain="coalesce(by_http, by_sni, by_dns)")
    return df.where("url IS NOT NULL").drop("by_http", "by_sni", "by_dns")
