"""URL normalisation as column expressions over a URL table.

``url_normalize`` turns ``(url_id, full_url)`` into the normalised URL columns. All steps are
JVM-side string functions on one row: no shuffle, no Python.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from linkguard import constants as C
from linkguard.functions import ip as IP
from linkguard.functions.sqlutil import add, count_char, in_list, pin

# whitespace that is stripped from both ends of a raw URL
WHITESPACE = r" \t\n\r\u000B\u000C"
# schemes whose last path segment may carry ";parameters"
PARAM_SCHEMES = ["ftp", "hdl", "prospero", "http", "https", "shttp", "rtsp", "rtsps", "rtspu",
                 "sip", "sips", "mms", "sftp", "tel"]
SCHEME_RE = "^[a-zA-Z][a-zA-Z0-9+.-]*://"


def percent_decode(expr: str, plus_is_space: bool = False) -> str:
    """Percent-decode; malformed escapes stay as they are and bad UTF-8 becomes U+FFFD."""
    src = expr if plus_is_space else f"replace({expr}, '+', '%2B')"
    return f"url_decode(regexp_replace({src}, '%(?![0-9A-Fa-f]{{2}})', '%25'))"


def url_parse(urls: DataFrame, url_col: str = "full_url", keep=()) -> DataFrame:
    """Scheme, authority, host, port, path, query, fragment of every URL; ``keep`` passes further
    columns of ``urls`` through."""
    df = urls.select("url_id", F.coalesce(F.col(url_col), F.lit("")).alias("raw_url"), *keep)
    df = add(df, trimmed=f"btrim(raw_url, '{WHITESPACE}')")
    df = add(df, scheme_added=f"raw_url <> '' AND NOT trimmed RLIKE '{SCHEME_RE}'")
    df = add(df, url="CASE WHEN raw_url = '' THEN '' WHEN scheme_added THEN "
                     "concat('http://', trimmed) ELSE trimmed END")
    # line breaks and tabs inside a URL are dropped before it is split
    df = add(df, src=r"translate(url, '\t\r\n', '')")
    df = add(df, scheme="CASE WHEN url = '' THEN '' ELSE lower(substring_index(src, '://', 1)) END",
             rest="CASE WHEN url = '' THEN '' ELSE substr(src, instr(src, '://') + 3) END")
    df = add(df, before_fragment="substring_index(rest, '#', 1)")
    df = add(df, fragment="substr(rest, length(before_fragment) + 2)",
             before_query="substring_index(before_fragment, '?', 1)")
    df = add(df, query="substr(before_fragment, length(before_query) + 2)",
             authority="substring_index(before_query, '/', 1)")
    df = add(df, raw_path="substr(before_query, length(authority) + 1)",
             parse_error="contains(authority, '[') <> contains(authority, ']')",
             hostinfo="substring_index(authority, '@', -1)")
    df = add(df, userinfo_raw="CASE WHEN contains(authority, '@') THEN left(authority, "
                              "length(authority) - length(hostinfo) - 1) ELSE '' END",
             bracketed="CASE WHEN contains(hostinfo, '[') THEN "
                       "substr(hostinfo, instr(hostinfo, '[') + 1) END")
    df = add(df, host_raw="CASE WHEN bracketed IS NOT NULL THEN substring_index(bracketed, ']', 1) "
                          "ELSE substring_index(hostinfo, ':', 1) END")
    df = add(df, port_text="CASE WHEN bracketed IS NULL THEN substr(hostinfo, length(host_raw) + 2) "
                           "WHEN contains(substr(bracketed, length(host_raw) + 2), ':') THEN "
                           "substr(bracketed, length(host_raw) + 2 + instr(substr(bracketed, "
                           "length(host_raw) + 2), ':')) ELSE '' END",
             path_cut=f"CASE WHEN contains(raw_path, ';') AND {in_list('scheme', PARAM_SCHEMES)} "
                      "THEN regexp_replace(raw_path, '^((?:.*/)?[^/;]*);[^/]*$', '$1') "
                      "ELSE raw_path END")
    df = add(df, port_num="CASE WHEN port_text RLIKE '^[0-9]+$' THEN try_cast(port_text as int) END")
    # unbalanced brackets make the URL unparseable: everything stays at its default
    guard = "CASE WHEN parse_error THEN {d} ELSE {e} END"
    df = add(
        df,
        scheme=guard.format(d="''", e="scheme"),
        hostname=guard.format(d="''", e="lower(host_raw)"),
        port=guard.format(d="NULL", e="CASE WHEN port_num BETWEEN 0 AND 65535 THEN port_num END"),
        invalid_port="NOT parse_error AND port_text <> '' "
                     "AND coalesce(port_num NOT BETWEEN 0 AND 65535, true)",
        path=guard.format(d="'/'", e="CASE WHEN path_cut = '' THEN '/' ELSE path_cut END"),
        query=guard.format(d="''", e="query"),
        fragment=guard.format(d="''", e="fragment"),
        userinfo_raw=guard.format(d="''", e="userinfo_raw"),
        is_https="NOT parse_error AND scheme = 'https'",
    ).select("url_id", "raw_url", "url", "scheme_added", "parse_error", "scheme", "hostname",
             "port", "invalid_port", "path", "query", "fragment", "userinfo_raw", "is_https", *keep)
    return pin(df, "parse_error", "scheme", "hostname", "port", "invalid_port", "path", "query",
               "fragment", "userinfo_raw", "is_https")


def url_userinfo(parts: DataFrame) -> DataFrame:
    df = add(parts, user_name="substring_index(userinfo_raw, ':', 1)")
    df = add(df, user_pass="substr(userinfo_raw, length(user_name) + 2)")
    df = add(df, has_userinfo="user_name <> '' OR user_pass <> ''")
    return add(
        df, userinfo="CASE WHEN has_userinfo THEN concat(user_name, ':', user_pass) ELSE '' END",
        has_at_symbol="NOT parse_error AND contains(url, '@') AND NOT has_userinfo",
    ).drop("user_name", "user_pass", "userinfo_raw")


def url_percent(parts: DataFrame) -> DataFrame:
    df = add(parts, percent_encoding_count=f"CASE WHEN parse_error THEN 0 ELSE "
                                           f"{count_char('url', '%')} END",
             has_double_encoding="NOT parse_error AND contains(url, '%25')",
             decoded_url="CASE WHEN parse_error THEN '' WHEN contains(url, '%') THEN "
                         f"{percent_decode('url')} ELSE url END")
    return add(df, decoded_at_symbol="NOT parse_error AND "
                                     f"{count_char('decoded_url', '@')} > {count_char('url', '@')}")


def url_idn(parts: DataFrame, strict: bool = False) -> DataFrame:
    """``strict`` also checks, for non-ASCII hosts only, that the host has an IDNA form."""
    non_ascii = r"hostname RLIKE '[^\\x00-\\x7F]'"
    df = add(parts, has_unicode=non_ascii,
             is_punycode="startswith(hostname, 'xn--') OR contains(hostname, '.xn--')")
    if strict:
        from linkguard.functions.unicode import idna_encodable
        candidate = F.when(F.col("has_unicode"), F.col("hostname"))
        df = df.withColumn("has_unicode", F.col("has_unicode")
                           & F.coalesce(idna_encodable(candidate), F.lit(False)))
    return df


OBFUSCATED_RE = "^(0x[0-9a-f]+|[0-9]+)([.](0x[0-9a-f]+|[0-9]+)){3}$"


def url_ip_host(parts: DataFrame) -> DataFrame:
    df = add(IP.add_v6(parts, "hostname", "v6"), v4=IP.v4_number("hostname"))
    df = add(df, ip_version="CASE WHEN v4 IS NOT NULL THEN 'IPv4' WHEN v6 IS NOT NULL THEN 'IPv6' "
                            "END",
             is_private_ip=f"coalesce({IP.private_v4('v4')}, false) OR "
                           f"coalesce({IP.private_v6('v6')}, false)",
             obfuscated_ip=f"v4 IS NULL AND hostname RLIKE '{OBFUSCATED_RE}'")
    df = add(df, is_ip_host="ip_version IS NOT NULL OR obfuscated_ip").drop("v4", "v6")
    return pin(df, "ip_version", "is_private_ip", "obfuscated_ip", "is_ip_host")


def url_domain_split(parts: DataFrame) -> DataFrame:
    """Needs ``is_ip_host``; domain columns are empty for IP hosts."""
    df = add(parts, host="CASE WHEN is_ip_host THEN '' ELSE rtrim('.', hostname) END")
    df = add(df, n_labels="size(split(host, '[.]'))",
             two=in_list("substring_index(host, '.', -2)", C.TWO_PART_SUFFIXES),
             three="size(split(host, '[.]')) >= 3 AND "
                   + in_list("substring_index(host, '.', -3)", C.THREE_PART_SUFFIXES))
    df = add(df, keep_labels="CASE WHEN three THEN 4 WHEN two THEN 3 ELSE 2 END")
    df = add(df, tld="CASE WHEN n_labels < 2 THEN '' WHEN three THEN substring_index(host, '.', -3)"
                     " WHEN two THEN substring_index(host, '.', -2)"
                     " ELSE substring_index(host, '.', -1) END",
             registered_domain="substring_index(host, '.', -keep_labels)")
    df = add(
        df, subdomain="CASE WHEN length(registered_domain) < length(host) THEN left(host, "
                      "length(host) - length(registered_domain) - 1) ELSE '' END",
    ).drop("host", "n_labels", "two", "three", "keep_labels")
    return pin(df, "registered_domain", "subdomain", "tld")


def url_query_params(parts: DataFrame) -> DataFrame:
    key = percent_decode("substring_index(p, '=', 1)", plus_is_space=True)
    val = percent_decode("substr(p, length(substring_index(p, '=', 1)) + 2)", plus_is_space=True)
    df = add(parts, param_pairs=f"transform(filter(split(query, '&'), p -> p <> ''), "
                                f"p -> named_struct('k', {key}, 'v', {val}))")
    df = add(df, param_keys="array_distinct(transform(param_pairs, p -> p.k))")
    return add(
        df, query_param_count="size(param_keys)",
        query_params="map_from_arrays(param_keys, transform(param_keys, k -> "
                     "transform(filter(param_pairs, p -> p.k = k), p -> p.v)))",
    ).drop("param_pairs", "param_keys")


def url_canonical(parts: DataFrame) -> DataFrame:
    default = "CASE scheme " + " ".join(
        f"WHEN '{s}' THEN {p}" for s, p in C.DEFAULT_PORTS.items()) + " END"
    return add(parts, normalized_url=f"""
        CASE WHEN parse_error OR raw_url = '' THEN '' ELSE concat(
          scheme, '://',
          CASE WHEN has_userinfo THEN concat(userinfo, '@') ELSE '' END,
          CASE WHEN ip_version = 'IPv6' THEN concat('[', hostname, ']') ELSE hostname END,
          CASE WHEN port > 0 AND NOT port <=> ({default}) THEN concat(':', port) ELSE '' END,
          CASE WHEN startswith(path, '/') THEN path ELSE concat('/', path) END,
          CASE WHEN query <> '' THEN concat('?', query) ELSE '' END,
          CASE WHEN fragment <> '' THEN concat('#', fragment) ELSE '' END) END""")


def url_warnings(parts: DataFrame) -> DataFrame:
    # --- fixed values: warning codes, in the order they are reported
    codes = [("empty_or_invalid_input", "raw_url = ''"), ("scheme_added", "scheme_added"),
             ("parse_error:Invalid IPv6 URL", "parse_error"), ("invalid_port", "invalid_port"),
             ("userinfo_present", "has_userinfo"), ("double_encoding", "has_double_encoding"),
             ("at_symbol_in_url", "has_at_symbol"), ("decoded_at_symbol", "decoded_at_symbol"),
             ("unicode_hostname", "has_unicode"), ("punycode_hostname", "is_punycode"),
             ("private_ip_host", "is_private_ip"), ("obfuscated_ip_host", "obfuscated_ip")]
    items = ", ".join(f"CASE WHEN {cond} THEN '{code}' END" for code, cond in codes)
    return add(parts, warnings=f"filter(array({items}), w -> w IS NOT NULL)",
               is_valid="hostname <> ''")


NORM_COLUMNS = [
    "url_id", "raw_url", "normalized_url", "decoded_url", "scheme", "hostname",
    "registered_domain", "subdomain", "tld", "port", "path", "query", "fragment", "query_params",
    "query_param_count", "is_ip_host", "ip_version", "is_private_ip", "is_punycode", "has_unicode",
    "is_https", "percent_encoding_count", "has_double_encoding", "has_at_symbol", "has_userinfo",
    "userinfo", "is_valid", "warnings",
]


def url_normalize(urls: DataFrame, url_col: str = "full_url", strict_idna: bool = False,
                  keep=()) -> DataFrame:
    """The whole normalisation; Spark prunes the columns a caller does not use."""
    df = url_percent(url_userinfo(url_parse(urls, url_col, keep)))
    df = url_domain_split(url_ip_host(url_idn(df, strict_idna)))
    df = url_warnings(url_canonical(url_query_params(df)))
    return df.select(*NORM_COLUMNS, *keep)


def duplicate_urls(norm: DataFrame) -> DataFrame:
    """Canonical URLs that occur more than once."""
    return (norm.groupBy("normalized_url")
            .agg(F.count("*").alias("n"), F.min("url_id").alias("first_url_id"))
            .where("n > 1"))


def domain_counts(norm: DataFrame) -> DataFrame:
    """URLs and distinct canonical URLs per registered domain (two-step, so that one hot domain
    is counted by many tasks)."""
    return (norm.groupBy("registered_domain", "normalized_url").agg(F.count("*").alias("c"))
            .groupBy("registered_domain")
            .agg(F.sum("c").alias("n_urls"), F.count("*").alias("n_distinct")))
