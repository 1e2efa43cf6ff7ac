"""The 52 lexical URL features, as groups of column expressions over normalised URLs."""

from __future__ import annotations

from pyspark.sql import DataFrame

from linkguard import constants as C
from linkguard.functions.sqlutil import add, array, count_char, in_list, lit

LENGTHS = {
    "url_length": "raw_url", "normalized_length": "normalized_url",
    "decoded_length": "decoded_url", "hostname_length": "hostname",
    "domain_length": "registered_domain", "subdomain_length": "subdomain",
    "path_length": "path", "query_length": "query", "fragment_length": "fragment",
}
CHAR_COUNTS = {
    "dot_count": ".", "hyphen_count": "-", "underscore_count": "_", "slash_count": "/",
    "question_mark_count": "?", "equal_count": "=", "ampersand_count": "&", "at_count": "@",
    "colon_count": ":",
}


def entropy(expr: str) -> str:
    """Shannon entropy in bits of the characters of a string; 0 for the empty string."""
    share = f"((length({expr}) - length(replace({expr}, ch, ''))) / cast(length({expr}) as double))"
    return (f"CASE WHEN {expr} = '' THEN 0D ELSE round(aggregate(array_distinct(split({expr}, '')), "
            f"0D, (acc, ch) -> acc - {share} * log2({share})), 4) END")


def lengths(df: DataFrame) -> DataFrame:
    return add(df, **{name: f"length({col})" for name, col in LENGTHS.items()})


def counts(df: DataFrame) -> DataFrame:
    df = add(df, **{name: count_char("raw_url", ch) for name, ch in CHAR_COUNTS.items()})
    specials = "".join("\\\\" + ch for ch in C.SPECIAL_CHARS)
    return add(
        df,
        digit_count="length(raw_url) - length(regexp_replace(raw_url, '[0-9]', ''))",
        letter_count=r"length(raw_url) - length(regexp_replace(raw_url, '\\p{L}', ''))",
        special_character_count="length(raw_url) - length(regexp_replace(raw_url, "
                                f"'[{specials}]', ''))")


def ratios(df: DataFrame) -> DataFrame:
    """Needs the counts."""
    share = "round({} / cast(greatest(length(raw_url), 1) as double), 4)"
    return add(df, digit_ratio=share.format("digit_count"),
               special_ratio=share.format("special_character_count"))


def entropies(df: DataFrame) -> DataFrame:
    return add(df, entropy=entropy("raw_url"), hostname_entropy=entropy("hostname"),
               path_entropy=entropy("path"))


def structure(df: DataFrame) -> DataFrame:
    parts = "size(filter(split({}, '[.]'), p -> p <> ''))"
    return add(
        df, subdomain_count=parts.format("subdomain"),
        domain_token_count=parts.format("registered_domain"), tld_length="length(tld)",
        longest_token_length="array_max(transform(split(registered_domain, '[._-]'), "
                             "t -> length(t)))")


def flags(df: DataFrame) -> DataFrame:
    default = "CASE scheme " + " ".join(
        f"WHEN '{s}' THEN {p}" for s, p in C.FEATURE_DEFAULT_PORTS.items()) + " END"
    words, exts = array(C.FEATURE_KEYWORDS), array(C.FEATURE_EXTENSIONS)
    df = add(df, port_or_null="port")
    return add(
        df, is_https="int(is_https)", has_port="int(coalesce(port_or_null, 0) > 0)",
        port="coalesce(port_or_null, 0)",
        non_standard_port=f"int(coalesce(port_or_null, 0) > 0 AND "
                          f"NOT port_or_null <=> ({default}))",
        is_ip_host="int(is_ip_host)", is_private_ip="int(is_private_ip)",
        is_punycode="int(is_punycode)", has_unicode="int(has_unicode)",
        suspicious_tld=f"int({in_list('lower(tld)', C.SUSPICIOUS_TLDS)})",
        suspicious_keywords_count=f"size(filter({words}, k -> contains(lower(raw_url), k)))",
        suspicious_file_extension=f"int(exists({exts}, e -> endswith("
                                  "substring_index(lower(path), '?', 1), e)))",
        has_hex_chars="int(normalized_url RLIKE '(%[0-9a-fA-F]{2}){3}')",
        has_double_encoding="int(has_double_encoding)", has_at_symbol="int(has_at_symbol)",
        has_userinfo="int(has_userinfo)",
    ).drop("port_or_null")


def path_query(df: DataFrame) -> DataFrame:
    return add(df, url_depth="size(filter(split(path, '/'), p -> p <> ''))",
               has_query="int(query <> '')", has_fragment="int(fragment <> '')")


def diversity(df: DataFrame) -> DataFrame:
    df = add(df, unique_char_count="CASE WHEN raw_url = '' THEN 0 ELSE "
                                   "size(array_distinct(split(raw_url, ''))) END")
    return add(df, unique_char_ratio="round(unique_char_count / "
                                     "cast(greatest(length(raw_url), 1) as double), 4)")


RECORD = ["rec_domain", "rec_path", "rec_tld"]


def fallback(norm: DataFrame, url_record: DataFrame) -> DataFrame:
    """URLs without a parsable host take host, path and tld from the stored URL record."""
    rec = url_record.selectExpr("url_id", "domain AS rec_domain", "path AS rec_path",
                                "tld AS rec_tld")
    return fallback_row(norm.join(rec, "url_id", "left"))


def fallback_row(df: DataFrame) -> DataFrame:
    """The same on rows that carry their record as ``RECORD`` columns: no join."""
    df = add(df, miss="hostname = ''",
             raw_scheme="regexp_extract(raw_url, '^([a-zA-Z][a-zA-Z0-9+.-]*):', 1)",
             raw_netloc="regexp_extract(raw_url, '^([a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)', 2)",
             raw_path="regexp_extract(raw_url, "
                      "'^([a-zA-Z][a-zA-Z0-9+.-]*:)?(//[^/?#]*)?([^?#]*)', 3)",
             raw_query="regexp_extract(raw_url, '^[^?#]*[?]([^#]*)', 1)")
    df = add(df, rec_host="coalesce(nullif(rec_domain, ''), raw_netloc)")
    sub = {
        "normalized_url": "raw_url", "decoded_url": "raw_url",
        "scheme": "coalesce(nullif(lower(raw_scheme), ''), 'http')", "hostname": "rec_host",
        "registered_domain": "rec_host", "subdomain": "''",
        "tld": "coalesce(nullif(rec_tld, ''), CASE WHEN contains(rec_domain, '.') THEN "
               "substring_index(rec_domain, '.', -1) END, '')",
        "port": "cast(NULL AS int)",
        "path": "coalesce(nullif(rec_path, ''), nullif(raw_path, ''), '/')", "query": "raw_query",
        "fragment": "''", "query_param_count": "0", "is_ip_host": "false",
        "is_private_ip": "false", "is_punycode": "false", "has_unicode": "false",
        "is_https": "lower(raw_scheme) = 'https'", "has_double_encoding": "false",
        "percent_encoding_count": count_char("raw_url", "%"),
        "has_at_symbol": "contains(raw_url, '@')", "has_userinfo": "false",
    }
    df = add(df, **{c: f"CASE WHEN miss THEN {e} ELSE {c} END" for c, e in sub.items()})
    return df.drop("miss", "raw_scheme", "raw_netloc", "raw_path", "raw_query", "rec_host",
                   "rec_domain", "rec_path", "rec_tld")


URL_FEATURES = (
    list(LENGTHS) + list(CHAR_COUNTS)
    + ["percent_encoding_count", "digit_count", "letter_count", "special_character_count",
       "digit_ratio", "special_ratio", "entropy", "hostname_entropy", "path_entropy",
       "subdomain_count", "domain_token_count", "tld_length", "longest_token_length",
       "is_https", "has_port", "port", "non_standard_port", "is_ip_host", "is_private_ip",
       "is_punycode", "has_unicode", "suspicious_tld", "suspicious_keywords_count",
       "suspicious_file_extension", "has_hex_chars", "has_double_encoding", "has_at_symbol",
       "has_userinfo", "url_depth", "query_param_count", "has_query", "has_fragment",
       "unique_char_count", "unique_char_ratio"])


def url_features(norm: DataFrame, keep=()) -> DataFrame:
    """``url_id`` plus 52 features; one projection chain over the normalised URLs."""
    df = diversity(path_query(structure(entropies(ratios(counts(lengths(norm)))))))
    return flags(df).select("url_id", *keep, *URL_FEATURES)
