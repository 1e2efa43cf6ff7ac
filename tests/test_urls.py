"""Normalisation against the standard library, and address classes against ``ipaddress``."""

import ipaddress
from urllib.parse import parse_qs, unquote, urlparse

import pytest

from linkguard.functions import ip as IP
from linkguard.operators import egress as L, ips as I, normalize as N, url_features as U

CASES = [
    "HTTP://Shop.Mill.ORG:80/Cart", "http://one.two.farm.co.uk:8443/barn?hen=1&cow=2#hay",
    "http://10.20.30.40/printer", "https://xn--bcher-kva.ch/regal",
    "https://mill.org/%67%72%61%69%6E", "http://friendly.org@stranger.net/door",
    "https://mill.org/a%252Fb", "http://0x0a.1.2.3/inside", "https://www.mill.org",
    "http://[fe80::2]:8080/x", "http://me:pw@farm.net:70000/a;b/c;d?k&k=1&l=%zz+m#n?#", "http://barn/?a=b=c&&d",
    "http://a.b.farm.com.br/?q=%C3%BC%20+", "ftp://loft.mill.org/tool.exe", "http://777.2.2.2/",
    "http://me@farm.net:/x", "http://ü.net/ö", "  http://gap.net/x  ", "http://y.net#g/?a",
]


def test_parts_match_the_standard_library(spark):
    df = spark.createDataFrame(list(enumerate(CASES)), "url_id long, full_url string")
    rows = {r.url_id: r for r in N.url_normalize(df).collect()}
    for i, raw in enumerate(CASES):
        r, p = rows[i], urlparse(raw.strip())
        assert r.scheme == p.scheme
        assert r.hostname == (p.hostname or "").lower()
        assert r.path == (p.path or "/")
        assert (r.query, r.fragment) == (p.query, p.fragment)
        try:
            assert r.port == p.port
        except ValueError:
            assert r.port is None and "invalid_port" in r.warnings
        assert r.decoded_url == unquote(raw.strip())
        params = parse_qs(p.query, keep_blank_values=True)
        assert r.query_params == params and r.query_param_count == len(params)
        assert r.has_userinfo == bool(p.username or p.password)


def test_derived_columns(spark):
    df = spark.createDataFrame([(0, "http://sub.domain.example.co.uk:8080/p?x=1#f"),
                                (1, "http://999.1.1.1/"), (2, ""), (3, "shop.example.com/x"),
                                (4, "http://[2001:db8::1"), (5, "http://a..b.com./")],
                               "url_id long, full_url string")
    r = {x.url_id: x for x in N.url_normalize(df).collect()}
    assert (r[0].subdomain, r[0].registered_domain, r[0].tld) == ("sub.domain", "example.co.uk",
                                                                  "co.uk")
    assert r[1].is_ip_host and r[1].ip_version is None and r[1].registered_domain == ""
    assert r[2].warnings == ["empty_or_invalid_input"] and not r[2].is_valid
    assert r[3].warnings == ["scheme_added"] and r[3].hostname == "shop.example.com"
    assert r[4].warnings == ["parse_error:Invalid IPv6 URL"] and r[4].hostname == ""
    assert r[5].registered_domain == "b.com"


def test_canonical_form_is_stable(spark):
    df = spark.createDataFrame(list(enumerate(CASES)), "url_id long, full_url string")
    once = N.url_normalize(df).select("url_id", "normalized_url")
    twice = N.url_normalize(once, "normalized_url").selectExpr("url_id", "normalized_url AS again")
    assert once.join(twice, "url_id").where("normalized_url <> again").count() == 0


def test_52_features(spark):
    df = spark.createDataFrame([(0, "http://login-verify.tk/a/b.exe?u=1")],
                               "url_id long, full_url string")
    r = U.url_features(N.url_normalize(df)).first().asDict()
    assert len(U.URL_FEATURES) == 52 == len(set(U.URL_FEATURES))
    assert (r["suspicious_tld"], r["suspicious_keywords_count"], r["suspicious_file_extension"],
            r["url_depth"], r["has_query"]) == (1, 2, 1, 2, 1)


IPS = ["8.8.8.8", "10.1.2.3", "127.0.0.1", "172.16.0.1", "172.32.0.1", "192.168.1.1",
       "169.254.169.254", "100.100.100.200", "100.64.0.1", "224.0.0.1", "240.0.0.1",
       "255.255.255.255", "0.0.0.0", "192.0.2.5", "198.18.0.1", "203.0.113.9", "1.2.3", "256.1.1.1",
       "01.2.3.4", "x", "::1", "::", "2001:db8::1", "2606:4700::1111", "fe80::1", "fc00::1",
       "ff02::1", "::ffff:127.0.0.1", "::ffff:8.8.8.8", "fd00:ec2::254", "1:2:3:4:5:6:7:8",
       "1:2:3:4:5:6:7", "1::2::3", "12345::", "2002::1", "64:ff9b::1"]


def expected_reason(text):
    try:
        ip = ipaddress.ip_address(text)
    except ValueError:
        return "invalid_ip_format"
    if text in ("169.254.169.254", "fd00:ec2::254", "100.100.100.200"):
        return "cloud_metadata_endpoint"
    if ip.version == 6 and ip.ipv4_mapped:
        return expected_reason(str(ip.ipv4_mapped))
    for name, flag in [("loopback", ip.is_loopback), ("private_range", ip.is_private),
                       ("link_local", ip.is_link_local), ("reserved", ip.is_reserved),
                       ("multicast", ip.is_multicast), ("unspecified", ip.is_unspecified)]:
        if flag:
            return name
    return None


def test_ip_classes_match_the_standard_library(spark):
    df = spark.createDataFrame([(x,) for x in IPS], "ip string")
    for r in L.classify_ip(df).collect():
        assert r.ip_reason == expected_reason(r.ip), r.ip


def test_ip_numbers(spark):
    df = spark.createDataFrame([(x,) for x in IPS], "ip_address string")
    for r in I.structural(df).collect():
        try:
            want = int(ipaddress.ip_address(r.ip_address))
        except ValueError:
            want = 0
        assert r.ip_numeric == pytest.approx(want, rel=1e-12), r.ip_address


@pytest.mark.parametrize("cidr,lo,hi", [("10.0.0.0/8", 167772160, 184549375)])
def test_bounds(cidr, lo, hi):
    assert IP.v4_bounds(cidr) == (lo, hi)


EGRESS = [
    # names that resolve to public addresses, with paths, ports and user info
    ("https://docs.example.org/guide?page=2", True), ("http://cdn.example.net:8443/a.js", True),
    ("http://93.184.216.34/", True),
    # addresses that must not be reached, plain and in other notations
    ("http://127.8.9.10/x", False), ("http://10.20.30.40:9200/_cat", False), ("http://172.31.255.254/", False),
    ("http://192.168.44.5/setup.cgi", False), ("http://169.254.10.20/", False), ("http://167772165/", False),
    ("http://0xc0a80001/", False), ("http://012.0.0.7/", False), ("http://[fe80::1]/", False), ("http://[::1]:81/", False),
    # names and schemes that stay inside
    ("https://localhost/", False), ("http://nas.local/share", False), ("https://wiki.internal/", False),
    ("http://build.test/job", False), ("ftp://docs.example.org/", False), ("file:///var/log/syslog", False),
    # what resolution says
    ("http://two-faced.example/", False), ("http://nowhere.example/", False),
]


def test_egress_cases(spark):
    urls = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(EGRESS)],
                                 "url_id long, full_url string")
    dns = spark.createDataFrame(
        [("docs.example.org", "A", "93.184.216.34"), ("cdn.example.net", "A", "151.101.1.6"),
         ("two-faced.example", "A", "1.1.1.1"), ("two-faced.example", "AAAA", "::1")],
        "domain string, record_type string, record_value string")
    got = {r.full_url: r for r in L.egress_policy(urls, dns).collect()}
    for url, ok in EGRESS:
        assert got[url].is_safe == ok, (url, got[url].reason)
    assert got["http://two-faced.example/"].reason == "resolved_to_loopback"
    assert got["http://nowhere.example/"].reason == "dns_resolution_failed"
    assert got["http://012.0.0.7/"].reason.startswith("encoded_ip")
