"""Checked queries: URL normalisation and lexical features."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from linkguard.operators import normalize as N, url_features as U
from linkguard.plans.registry import query
from linkguard.plans.views import Tables


def norm(t: Tables) -> DataFrame:
    return N.url_normalize(t.url_corpus)


@query("url_parse", """SELECT url_id, scheme, hostname, port, path, query, fragment, is_https,
    scheme_added, invalid_port FROM c_parts""")
def _(t):
    return N.url_parse(t.url_corpus).select("url_id", "scheme", "hostname", "port", "path", "query",
                                            "fragment", "is_https", "scheme_added", "invalid_port")


@query("url_userinfo", "SELECT url_id, has_userinfo, userinfo, has_at_symbol FROM c_norm")
def _(t):
    return N.url_userinfo(N.url_parse(t.url_corpus)).select("url_id", "has_userinfo", "userinfo",
                                                            "has_at_symbol")


@query("url_percent", """SELECT url_id, percent_encoding_count, has_double_encoding, decoded_url,
    decoded_at AS decoded_at_symbol FROM c_norm""")
def _(t):
    return N.url_percent(N.url_parse(t.url_corpus)).select(
        "url_id", "percent_encoding_count", "has_double_encoding", "decoded_url",
        "decoded_at_symbol")


@query("url_idn", "SELECT url_id, has_unicode, is_punycode FROM c_norm")
def _(t):
    return N.url_idn(N.url_parse(t.url_corpus)).select("url_id", "has_unicode", "is_punycode")


@query("url_ip_host", "SELECT url_id, is_ip_host, ip_version, is_private_ip FROM c_norm")
def _(t):
    return N.url_ip_host(N.url_parse(t.url_corpus)).select("url_id", "is_ip_host", "ip_version",
                                                           "is_private_ip")


@query("url_domain_split", "SELECT url_id, subdomain, registered_domain, tld FROM c_norm")
def _(t):
    return norm(t).select("url_id", "subdomain", "registered_domain", "tld")


@query("url_query_params", "SELECT url_id, query_param_count FROM c_norm")
def _(t):
    return N.url_query_params(N.url_parse(t.url_corpus)).select("url_id", "query_param_count")


@query("url_canonical", "SELECT url_id, normalized_url FROM c_norm")
def _(t):
    return norm(t).select("url_id", "normalized_url")


@query("url_warnings", "SELECT url_id, warnings FROM c_norm")
def _(t):
    return norm(t).select("url_id", F.concat_ws(",", "warnings").alias("warnings"))


@query("url_normalize", """SELECT url_id, raw_url, normalized_url, decoded_url, scheme, hostname,
    registered_domain, subdomain, tld, port, path, query, fragment, query_param_count, is_ip_host,
    ip_version, is_private_ip, is_punycode, has_unicode, is_https, percent_encoding_count,
    has_double_encoding, has_at_symbol, has_userinfo, userinfo, hostname <> '' AS is_valid, warnings
    FROM c_norm""")
def _(t):
    return norm(t).drop("query_params").withColumn("warnings", F.concat_ws(",", "warnings"))


@query("url_dedup_canonical", """SELECT normalized_url, count(*) AS n, min(url_id) AS first_url_id
    FROM c_norm GROUP BY 1 HAVING count(*) > 1""")
def _(t):
    return N.duplicate_urls(norm(t))


@query("url_domain_counts", """SELECT registered_domain, count(*) AS n_urls,
    count(DISTINCT normalized_url) AS n_distinct FROM c_norm GROUP BY 1""")
def _(t):
    return N.domain_counts(norm(t))


def feature_query(name: str, fn, cols: list[str]) -> None:
    @query(name, f"SELECT url_id, {', '.join(cols)} FROM c_features")
    def _(t):
        return fn(norm(t)).select("url_id", *cols)


feature_query("uf_lengths", U.lengths, list(U.LENGTHS))
feature_query("uf_counts", U.counts, list(U.CHAR_COUNTS) + [
    "percent_encoding_count", "digit_count", "letter_count", "special_character_count"])
feature_query("uf_ratios", lambda n: U.ratios(U.counts(n)), ["digit_ratio", "special_ratio"])
feature_query("uf_entropy", U.entropies, ["entropy", "hostname_entropy", "path_entropy"])
feature_query("uf_structure", U.structure, ["subdomain_count", "domain_token_count", "tld_length",
                                            "longest_token_length"])
feature_query("uf_flags", U.flags, [
    "is_https", "has_port", "port", "non_standard_port", "is_ip_host", "is_private_ip",
    "is_punycode", "has_unicode", "suspicious_tld", "suspicious_keywords_count",
    "suspicious_file_extension", "has_hex_chars", "has_double_encoding", "has_at_symbol",
    "has_userinfo"])
feature_query("uf_path_query", U.path_query, ["url_depth", "query_param_count", "has_query",
                                              "has_fragment"])
feature_query("uf_diversity", U.diversity, ["unique_char_count", "unique_char_ratio"])
feature_query("url_features", U.url_features, U.URL_FEATURES)


@query("uf_fallback", r"""SELECT page_id AS url_id, raw_url AS normalized_url, raw_url AS decoded_url,
    'http' AS scheme,
    regexp_extract(url, '^https?://([^/]+)', 1) AS hostname,
    CASE WHEN page_id % 2 = 0 THEN 'com' ELSE string_split(regexp_extract(url,
      '^https?://([^/]+)', 1), '.')[-1] END AS tld,
    '/' || page_id AS path, '' AS subdomain, 'a=1@2' AS query, true AS has_at_symbol,
    2 AS percent_encoding_count
    FROM (SELECT *, 'http:///' || page_id || '%2F%20?a=1@2' AS raw_url FROM pages)""")
def _(t):
    raw = t.sql("""SELECT page_id AS url_id, concat('http:///', page_id, '%2F%20?a=1@2') AS full_url,
        regexp_extract(url, '^https?://([^/]+)', 1) AS domain, concat('/', page_id) AS path,
        CASE WHEN page_id % 2 = 0 THEN 'com' ELSE '' END AS tld FROM pages""")
    return U.fallback(N.url_normalize(raw), raw).select(
        "url_id", "normalized_url", "decoded_url", "scheme", "hostname", "tld", "path",
        "subdomain", "query", "has_at_symbol", "percent_encoding_count")
