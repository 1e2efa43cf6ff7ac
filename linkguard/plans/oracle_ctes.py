"""DuckDB building blocks for the checker, written independently of the Spark expressions."""

from __future__ import annotations

from linkguard import constants as C


def q(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def half_up(x: str, n: int) -> str:
    """Round the shortest decimal text of a double half up, as Spark's ``round`` does."""
    return f"round(({x})::DOUBLE::VARCHAR::DECIMAL(38, 18), {n})::DOUBLE"


RFC = "^(([^:/?#]+):)?(//([^/?#]*))?([^?#]*)([?]([^#]*))?(#(.*))?"
OCT = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"


def norm_ctes(p: str, source: str, col: str = "full_url") -> dict[str, str]:
    """Normalised URLs of ``source`` as ``<p>norm`` (with ``<p>parts`` before it)."""
    return {
        f"{p}parts": f"""
      SELECT *, lower(regexp_extract(url, '{RFC}', 2)) AS scheme,
        regexp_extract(url, '{RFC}', 4) AS authority,
        coalesce(nullif(regexp_extract(url, '{RFC}', 5), ''), '/') AS path,
        regexp_extract(url, '{RFC}', 7) AS query, regexp_extract(url, '{RFC}', 9) AS fragment,
        regexp_extract(authority, '^(.*)@', 1) AS ui,
        regexp_replace(authority, '^.*@', '') AS hostinfo,
        lower(regexp_extract(hostinfo, '^([^:]*)', 1)) AS hostname,
        regexp_extract(hostinfo, '^[^:]*:(.*)$', 1) AS port_text,
        CASE WHEN regexp_full_match(port_text, '[0-9]+') AND try_cast(port_text AS BIGINT) <= 65535
             THEN cast(port_text AS BIGINT) END AS port,
        port_text <> '' AND port IS NULL AS invalid_port, scheme = 'https' AS is_https
      FROM (SELECT url_id, {col} AS raw_url, trim({col}) AS t,
              NOT regexp_matches(t, '^[a-zA-Z][a-zA-Z0-9+.-]*://') AS scheme_added,
              CASE WHEN scheme_added THEN 'http://' || t ELSE t END AS url FROM {source})""",
        f"{p}norm0": f"""
      SELECT *, split_part(ui, ':', 1) AS un, regexp_extract(ui, '^[^:]*:(.*)$', 1) AS pw,
        (un <> '' OR pw <> '') AS has_userinfo,
        CASE WHEN has_userinfo THEN un || ':' || pw ELSE '' END AS userinfo,
        url LIKE '%@%' AND NOT has_userinfo AS has_at_symbol,
        len(url) - len(replace(url, '%', '')) AS percent_encoding_count,
        url LIKE '%\\%25%' ESCAPE '\\' AS has_double_encoding, url_decode(url) AS decoded_url,
        len(string_split(decoded_url, '@')) > len(string_split(url, '@')) AS decoded_at,
        regexp_matches(hostname, '[^\\x00-\\x7F]') AS has_unicode,
        regexp_matches(hostname, '(^|[.])xn--') AS is_punycode,
        regexp_full_match(hostname, '{OCT}([.]{OCT}){{3}}') AS is_v4,
        CASE WHEN is_v4 THEN list_transform(string_split(hostname, '.'),
             lambda x: cast(x AS BIGINT)) END AS o,
        CASE WHEN is_v4 THEN 'IPv4' END AS ip_version,
        coalesce(o[1] IN (0, 10, 127) OR o[1] >= 240 OR (o[1] = 169 AND o[2] = 254)
          OR (o[1] = 172 AND o[2] BETWEEN 16 AND 31) OR (o[1] = 192 AND o[2] = 168)
          OR (o[1] = 198 AND o[2] IN (18, 19)) OR (o[1] = 192 AND o[2] = 0 AND o[3] IN (0, 2))
          OR (o[1] = 198 AND o[2] = 51 AND o[3] = 100) OR (o[1] = 203 AND o[2] = 0 AND o[3] = 113),
          false) AS is_private_ip,
        NOT is_v4 AND len(string_split(hostname, '.')) = 4 AND len(list_filter(
          string_split(hostname, '.'), lambda x: NOT regexp_full_match(x,
          '0x[0-9a-fA-F]+|0[0-7]+|[0-9]+'))) = 0 AS obfuscated_ip,
        is_v4 OR obfuscated_ip AS is_ip_host
      FROM {p}parts""",
        f"{p}norm": f"""
      SELECT *, CASE WHEN is_ip_host THEN '' ELSE rtrim(hostname, '.') END AS h,
        string_split(h, '.') AS lab, len(lab) AS n,
        CASE WHEN n >= 3 AND list_contains({q(C.THREE_PART_SUFFIXES)},
               array_to_string(lab[-3:], '.')) THEN 3
             WHEN n >= 2 AND list_contains({q(C.TWO_PART_SUFFIXES)},
               array_to_string(lab[-2:], '.')) THEN 2 ELSE 1 END AS sfx,
        CASE WHEN n < 2 THEN '' ELSE array_to_string(lab[-sfx:], '.') END AS tld,
        array_to_string(lab[greatest(n - sfx, 1):], '.') AS registered_domain,
        CASE WHEN n > sfx + 1 THEN array_to_string(lab[1:n - sfx - 1], '.') ELSE '' END
          AS subdomain,
        list_filter(string_split(query, '&'), lambda x: x <> '') AS pairs,
        CASE WHEN query = '' THEN 0 ELSE len(list_distinct(list_transform(pairs, lambda x:
          url_decode(replace(split_part(x, '=', 1), '+', ' '))))) END AS query_param_count,
        scheme || '://' || CASE WHEN has_userinfo THEN userinfo || '@' ELSE '' END || hostname ||
          CASE WHEN port > 0 AND port IS DISTINCT FROM (CASE scheme
            {' '.join(f"WHEN '{s}' THEN {n}" for s, n in C.DEFAULT_PORTS.items())} END)
            THEN ':' || port ELSE '' END || path ||
          CASE WHEN query <> '' THEN '?' || query ELSE '' END ||
          CASE WHEN fragment <> '' THEN '#' || fragment ELSE '' END AS normalized_url,
        concat_ws(',', CASE WHEN scheme_added THEN 'scheme_added' END,
          CASE WHEN invalid_port THEN 'invalid_port' END,
          CASE WHEN has_userinfo THEN 'userinfo_present' END,
          CASE WHEN has_double_encoding THEN 'double_encoding' END,
          CASE WHEN has_at_symbol THEN 'at_symbol_in_url' END,
          CASE WHEN decoded_at THEN 'decoded_at_symbol' END,
          CASE WHEN has_unicode THEN 'unicode_hostname' END,
          CASE WHEN is_punycode THEN 'punycode_hostname' END,
          CASE WHEN is_private_ip THEN 'private_ip_host' END,
          CASE WHEN obfuscated_ip THEN 'obfuscated_ip_host' END) AS warnings
      FROM {p}norm0""",
    }


def _hits(text: str, words) -> str:
    return f"list_filter({q(words)}, lambda w: contains({text}, w))"


SPECIALS = q(list(C.SPECIAL_CHARS))

FEATURES = f"""
      SELECT url_id, raw_url, string_split(raw_url, '') AS ch,
        len(raw_url) AS url_length, len(normalized_url) AS normalized_length,
        len(decoded_url) AS decoded_length, len(hostname) AS hostname_length,
        len(registered_domain) AS domain_length, len(subdomain) AS subdomain_length,
        len(path) AS path_length, len(query) AS query_length, len(fragment) AS fragment_length,
        len(list_filter(ch, lambda x: x = '.')) AS dot_count,
        len(list_filter(ch, lambda x: x = '-')) AS hyphen_count,
        len(list_filter(ch, lambda x: x = '_')) AS underscore_count,
        len(list_filter(ch, lambda x: x = '/')) AS slash_count,
        len(list_filter(ch, lambda x: x = '?')) AS question_mark_count,
        len(list_filter(ch, lambda x: x = '=')) AS equal_count,
        len(list_filter(ch, lambda x: x = '&')) AS ampersand_count,
        len(list_filter(ch, lambda x: x = '@')) AS at_count,
        len(list_filter(ch, lambda x: x = ':')) AS colon_count, percent_encoding_count,
        len(list_filter(ch, lambda x: x BETWEEN '0' AND '9')) AS digit_count,
        len(list_filter(ch, lambda x: regexp_matches(x, '\\pL'))) AS letter_count,
        len(list_filter(ch, lambda x: list_contains({SPECIALS}, x))) AS special_character_count,
        round(digit_count / greatest(len(raw_url), 1), 4) AS digit_ratio,
        round(special_character_count / greatest(len(raw_url), 1), 4) AS special_ratio,
        round(list_entropy(ch), 4) AS entropy,
        round(coalesce(list_entropy(string_split(hostname, '')), 0), 4) AS hostname_entropy,
        round(list_entropy(string_split(path, '')), 4) AS path_entropy,
        len(list_filter(string_split(subdomain, '.'), lambda x: x <> '')) AS subdomain_count,
        len(list_filter(string_split(registered_domain, '.'), lambda x: x <> ''))
          AS domain_token_count,
        len(tld) AS tld_length,
        list_max(list_transform(regexp_split_to_array(registered_domain, '[._-]'),
          lambda x: len(x))) AS longest_token_length,
        cast(is_https AS BIGINT) AS is_https, cast(coalesce(port, 0) > 0 AS BIGINT) AS has_port,
        coalesce(port, 0) AS port,
        cast(coalesce(port, 0) > 0 AND port IS DISTINCT FROM (CASE scheme
          {' '.join(f"WHEN '{s}' THEN {n}" for s, n in C.FEATURE_DEFAULT_PORTS.items())} END)
          AS BIGINT) AS non_standard_port,
        cast(is_ip_host AS BIGINT) AS is_ip_host, cast(is_private_ip AS BIGINT) AS is_private_ip,
        cast(is_punycode AS BIGINT) AS is_punycode, cast(has_unicode AS BIGINT) AS has_unicode,
        cast(list_contains({q(C.SUSPICIOUS_TLDS)}, lower(tld)) AS BIGINT) AS suspicious_tld,
        len({_hits('lower(raw_url)', C.FEATURE_KEYWORDS)}) AS suspicious_keywords_count,
        cast(regexp_matches(split_part(lower(path), '?', 1),
          '({'|'.join(e.replace('.', '[.]') for e in C.FEATURE_EXTENSIONS)})$') AS BIGINT)
          AS suspicious_file_extension,
        cast(regexp_matches(normalized_url, '(%[0-9a-fA-F]{{2}}){{3,}}') AS BIGINT)
          AS has_hex_chars,
        cast(has_double_encoding AS BIGINT) AS has_double_encoding,
        cast(has_at_symbol AS BIGINT) AS has_at_symbol,
        cast(has_userinfo AS BIGINT) AS has_userinfo,
        len(list_filter(string_split(path, '/'), lambda x: x <> '')) AS url_depth,
        query_param_count, cast(query <> '' AS BIGINT) AS has_query,
        cast(fragment <> '' AS BIGINT) AS has_fragment,
        len(list_distinct(ch)) AS unique_char_count,
        round(unique_char_count / greatest(len(raw_url), 1), 4) AS unique_char_ratio
      FROM {{src}}"""

BRAND_VALUES = ", ".join(
    f"('{b}', {i}, {str(b in C.HIGH_VALUE_BRANDS).lower()})"
    for i, b in enumerate(dict.fromkeys(C.BRANDS)))
BOOST = "CASE technique " + " ".join(
    f"WHEN '{t}' THEN {b}" for t, b in C.TECHNIQUE_BOOST.items()) + " END"


def typo_ctes(p: str, source: str, col: str) -> dict[str, str]:
    """Impersonation matches of ASCII hosts as ``<p>typo`` and per-host roll-up ``<p>roll``.
    Decoded ``xn--`` labels are looked up from the one label the corpus uses."""
    sim = "1.0::DOUBLE - levenshtein({0}, brand) / greatest(len({0}), len(brand))::DOUBLE"
    return {
        f"{p}hosts": f"""
      SELECT url_id, split_part(regexp_extract(lower(trim(CASE WHEN {col} LIKE '%://%' THEN {col}
        ELSE 'http://' || {col} END)), '^([a-z][a-z0-9+.-]*:)?//([^/?#]*)', 2), ':', 1) AS ts_host
      FROM {source}""",
        f"{p}labels": f"""
      SELECT ts_host, pos, label FROM (
        SELECT ts_host, unnest(main) AS label, unnest(range(0, len(main))) AS pos FROM
          (SELECT ts_host, string_split(ts_host, '.')[:-2] AS main
           FROM (SELECT DISTINCT ts_host FROM {p}hosts) WHERE contains(ts_host, '.'))
        UNION ALL
        SELECT ts_host, array_to_string(main, '-'), len(main) FROM
          (SELECT ts_host, string_split(ts_host, '.')[:-2] AS main
           FROM (SELECT DISTINCT ts_host FROM {p}hosts) WHERE contains(ts_host, '.'))
        WHERE len(main) > 1) WHERE len(label) >= 3""",
        f"{p}pairs": f"""
      SELECT l.*, b.*, list_filter(range(1, len(label) + 1), lambda i: label[i] <> brand[i])
          AS diffs, {sim.format('label')} AS lev_sim
      FROM {p}labels l, brand_list b WHERE abs(len(label) - len(brand)) <= 3""",
        f"{p}found": f"""
      SELECT ts_host, pos, 0 AS phase, brand_pos, 0 AS tech, label, brand, hv,
        'combosquatting' AS technique, 0.85::DOUBLE AS sim, 0 AS extra,
        '''' || brand || ''' embedded in ''' || label || '''' AS details FROM {p}pairs
      WHERE contains(label, brand) AND label <> brand AND len(label) <= len(brand) * 2.5
      UNION ALL
      SELECT ts_host, pos, 0, brand_pos, 1, label, brand, hv,
        CASE WHEN len(label) > len(brand) THEN 'insertion' WHEN len(label) < len(brand)
               THEN 'deletion' WHEN len(diffs) = 1 THEN 'character_substitution'
             WHEN len(diffs) = 2 AND label[instr(label, label[diffs[1]])] =
                  brand[instr(label, label[diffs[1]]) + 1]
              AND label[instr(label, label[diffs[1]]) + 1] = brand[instr(label, label[diffs[1]])]
              AND instr(label, label[diffs[1]]) < len(label) THEN 'transposition'
             WHEN len(diffs) = 2 AND len(list_filter(diffs, lambda i: contains('aeiou', label[i])
              AND contains('aeiou', brand[i]))) = 2 THEN 'vowel_swap' ELSE 'edit_distance' END,
        lev_sim, 0, '''' || label || ''' resembles ''' || brand || ''' (' ||
          cast(round(lev_sim * 100) AS BIGINT) || '%)'
      FROM {p}pairs WHERE lev_sim >= 0.75 AND label <> brand
      UNION ALL
      SELECT ts_host, pos, 1, brand_pos, 3, label, brand, hv, 'punycode',
        {sim.format("'p?ypal'")}, 15,
        'Punycode ''' || label || ''' decodes to ''pаypal''' FROM {p}labels, brand_list
      WHERE label = 'xn--pypal-4ve' AND {sim.format("'p?ypal'")} >= 0.75""",
        f"{p}typo": f"""
      SELECT ts_host, brand, technique, sim AS similarity, details, pos, phase, brand_pos, tech,
        least(cast(trunc(greatest(0, least(100, ((sim - 0.75) / 0.25) * 50 + 50 +
          CASE WHEN hv THEN 15 ELSE 0 END + {BOOST}))) AS BIGINT) + extra, 100) AS risk
      FROM {p}found QUALIFY row_number() OVER (PARTITION BY ts_host, brand, technique
        ORDER BY pos, phase, brand_pos, tech) = 1""",
        f"{p}roll": f"""
      SELECT ts_host, max(risk) AS highest_risk,
        list('typosquat:' || brand || '(' || technique || ')' ORDER BY risk DESC, pos, phase,
          brand_pos, tech) AS labels,
        list(struct_pack(brand := brand, technique := technique, similarity := similarity)
          ORDER BY risk DESC, pos, phase, brand_pos, tech) AS items
      FROM {p}typo GROUP BY ts_host""",
    }


def rule_ctes(p: str) -> dict[str, str]:
    """Rule points of ``<p>norm`` with ``<p>roll``: one (points, reason) pair per rule, then the
    total as ``<p>rules``."""
    two = "list_filter(" + q(C.TRUSTED_DOMAINS) + ", lambda t: d = t OR ends_with(d, '.' || t))"
    off = "[.](" + "|".join(C.OFFICIAL_SUFFIXES) + ")$"
    exts = (f"list_filter({q(C.RULE_EXTENSIONS)}, lambda e: ends_with(u, e) OR "
            "contains(u, e || '?') OR contains(u, e || '&'))[1]")

    def case(*cases):
        pts = "CASE " + " ".join(f"WHEN {c} THEN {n}" for c, n, _ in cases) + " ELSE 0 END"
        why = "CASE " + " ".join(f"WHEN {c} THEN {r}" for c, _, r in cases) + " END"
        return pts, why
    rules = {
        "at_symbol": case(("has_at_symbol", 25, "'at_symbol_in_url'")),
        "double_encoding": case(("has_double_encoding", 20, "'double_encoding'")),
        "punycode": case(("is_punycode", 15, "'punycode_hostname'")),
        "unicode": case(("has_unicode AND NOT is_punycode", 10, "'unicode_hostname'")),
        "percent": case(("percent_encoding_count > 5", 12,
                         "'url_encoding:' || percent_encoding_count"),
                        ("percent_encoding_count > 2", 5, "NULL")),
        "typosquat": ("least(cast(trunc(least(coalesce(highest_risk, 0), 100) * 0.4) AS BIGINT), "
                      "40)", "array_to_string(labels, '|')"),
        "high_risk_tld": case(("tld_hit IS NOT NULL", 35, "'high_risk_tld:' || tld_hit")),
        "brand_mimic": case(("mimic IS NOT NULL", 30, "'brand_mimic:' || mimic")),
        "ip_host": case(("is_ip_host AND is_private_ip", 10, "'private_ip_host'"),
                        ("is_ip_host", 30, "'public_ip_as_host'")),
        "dangerous_scheme": case(("bad IS NOT NULL", 40, "'dangerous_scheme:' || bad")),
        "no_https": case((f"NOT is_https AND len({_hits('u', C.SENSITIVE_WORDS)}) > 0", 25,
                          "'no_https_sensitive'"), ("NOT is_https", 8, "'no_https'")),
        "keywords": case(("kw >= 5", 25, "'many_keywords:' || kw"),
                         ("kw >= 3", 15, "'multiple_keywords:' || kw"),
                         ("kw >= 1", 8, "'suspicious_keyword'")),
        "executable": case(("ext IS NOT NULL", 25, "'executable:' || ext")),
        "admin_path": case((f"len({_hits('u', C.ADMIN_PATHS)}) > 0", 20, "'admin_panel_exposed'")),
        "subdomains": case(("nsub > 5", 15, "'excessive_subdomains:' || nsub"),
                           ("nsub > 3", 8, "'many_subdomains:' || nsub")),
        "hyphens": case(("hyph > 4", 12, "'many_hyphens:' || hyph"), ("hyph > 2", 5, "NULL")),
        "digit_domain": case(("digits / greatest(len(d), 1) > 0.5 AND len(d) > 20", 15,
                              "'digit_heavy_domain'")),
        "phishing_path": case((f"len({_hits('u', C.PHISHING_PATHS)}) > 0", 12,
                               "'phishing_pattern'")),
        "port": case(("port > 0 AND NOT ((scheme = 'http' AND port = 80) OR "
                      "(scheme = 'https' AND port = 443))", 5, "'non_standard_port:' || port")),
        "redirect_param": case((f"len({_hits('u', C.REDIRECT_PARAMS)}) > 0", 8,
                                "'redirect_param'")),
        "length": case(("len(raw_url) > 500", 15, "'extremely_long_url'"),
                       ("len(raw_url) > 200", 8, "'very_long_url'")),
        "base64": case(("regexp_matches(raw_url, '[A-Za-z0-9+/=]{50,}')", 20,
                        "'base64_encoded'")),
    }
    cols = ", ".join(f"{a} AS p_{k}, {b} AS r_{k}" for k, (a, b) in rules.items())
    total = " + ".join(f"p_{k}" for k in rules)
    why = "concat_ws('|', " + ", ".join(f"nullif(r_{k}, '')" for k in rules) + ")"
    return {
        f"{p}rbase": f"""
      SELECT n.*, r.highest_risk, r.labels, r.items, x.ts_host,
        CASE WHEN registered_domain = '' THEN hostname ELSE registered_domain END AS d,
        lower(decoded_url) AS u, len({two}) > 0 AS trusted,
        regexp_matches(d, '[.](gov|edu|mil|ac[.]uk|gov[.]in|nic[.]in)$') AS safe_tld,
        list_filter({q(C.HIGH_RISK_TLDS)}, lambda t: ends_with(d, t))[1] AS tld_hit,
        list_filter({q(C.RULE_BRANDS)}, lambda b: contains(d, b) AND NOT
          regexp_matches(d, '(^|[.])' || b || '{off}'))[1] AS mimic,
        {_hits('u', C.DANGEROUS_SCHEMES)}[1] AS bad, len({_hits('u', C.RULE_KEYWORDS)}) AS kw,
        {exts} AS ext,
        CASE WHEN subdomain <> '' THEN len(string_split(subdomain, '.'))
          ELSE greatest(0, len(string_split(hostname, '.')) - 2) END AS nsub,
        len(d) - len(replace(d, '-', '')) AS hyph,
        len(regexp_replace(d, '[^0-9]', '', 'g')) AS digits
      FROM {p}norm n JOIN {p}hosts x USING (url_id) LEFT JOIN {p}roll r ON r.ts_host = x.ts_host""",
        f"{p}rule_parts": f"SELECT *, {cols} FROM {p}rbase",
        f"{p}rules": f"""
      SELECT *, CASE WHEN trusted OR safe_tld THEN 0 ELSE {total} END AS points,
        CASE WHEN trusted THEN 'known_benign_domain' WHEN safe_tld THEN 'safe_tld' ELSE {why} END
          AS reasons,
        CASE WHEN trusted OR safe_tld THEN 'benign' WHEN points >= 40 THEN 'malicious'
          WHEN points >= 12 THEN 'suspicious' ELSE 'benign' END AS rule_result,
        CASE WHEN trusted THEN 0.01 WHEN safe_tld THEN 0.02
          WHEN points >= 60 THEN least(0.9 + (points - 60) / 100, 0.99)
          WHEN points >= 40 THEN 0.65 + (points - 40) / 100
          WHEN points >= 25 THEN 0.4 + (points - 25) / 100
          WHEN points >= 12 THEN 0.2 + (points - 12) / 100
          ELSE greatest(points / 100, 0.01) END::DOUBLE AS rule_confidence,
        CASE rule_result WHEN 'malicious' THEN least(60 + rule_confidence * 40, 100)
          WHEN 'suspicious' THEN least(30 + rule_confidence * 30, 60)
          ELSE least(rule_confidence * 15, 15) END::DOUBLE AS rule_score
      FROM {p}rule_parts""",
    }


def fuse_ctes(p: str, source: str, weights=None, thresholds=None) -> dict[str, str]:
    """Verdicts as ``<p>fused`` from a table of five nullable signals on the 0..100 scale."""
    w = weights or C.RISK_WEIGHTS
    t = thresholds or C.RISK_THRESHOLDS
    s = C.SIGNALS
    wt = " + ".join(f"(CASE WHEN {x} IS NULL THEN 0 ELSE {w[x]}::DOUBLE END)" for x in s)
    marks = ", ".join(f"abs(risk_score - {m})" for m in sorted(t.values()) + [0, 100])
    return {
        f"{p}weights": f"""
      SELECT *, {wt} AS wsum, {' + '.join(f"(CASE WHEN {x} IS NULL THEN 0 ELSE 1 END)" for x in s)}
          AS n_present,
        {', '.join(f"CASE WHEN {x} IS NULL THEN 0 WHEN wsum = 0 THEN 1.0 / n_present ELSE {w[x]}::DOUBLE / wsum END::DOUBLE AS w_{x}" for x in s)}
      FROM {source}""",
        f"{p}fused": f"""
      SELECT *, {', '.join(f"w_{x} * {x} AS c_{x}" for x in s)},
        greatest(0, least(100, {' + '.join(f"coalesce(c_{x}, 0)" for x in s)}))::DOUBLE
          AS risk_score,
        concat_ws(',', {', '.join(f"CASE WHEN {x} IS NULL THEN '{x}' END" for x in s)}) AS missing,
        CASE WHEN n_present = 0 THEN 'UNKNOWN' WHEN risk_score < {t['benign']} THEN 'BENIGN'
          WHEN risk_score < {t['suspicious']} THEN 'SUSPICIOUS'
          WHEN risk_score < {t['high_risk']} THEN 'HIGH_RISK' ELSE 'MALICIOUS' END AS verdict,
        CASE WHEN n_present = 0 THEN 0 ELSE {half_up(f"""n_present / 5 * 0.5::DOUBLE +
          least(least({marks}) / 20, 1) * 0.5::DOUBLE""", 4)} END::DOUBLE AS confidence,
        CASE verdict WHEN 'BENIGN' THEN 'benign' WHEN 'SUSPICIOUS' THEN 'suspicious'
          WHEN 'UNKNOWN' THEN 'error' ELSE 'malicious' END AS prediction,
        CASE verdict WHEN 'BENIGN' THEN 'SAFE' WHEN 'SUSPICIOUS' THEN 'MEDIUM'
          WHEN 'UNKNOWN' THEN 'UNKNOWN' ELSE 'HIGH' END AS risk_level
      FROM {p}weights""",
    }


CTES: dict[str, str] = {"brand_list": f"SELECT * FROM (VALUES {BRAND_VALUES}) b(brand, brand_pos, hv)"}
CTES |= norm_ctes("c_", "url_corpus")
CTES["c_features"] = FEATURES.replace("{src}", "c_norm")
CTES |= typo_ctes("c_", "url_corpus", "full_url")
CTES |= rule_ctes("c_")
# scans put "http://" before everything that does not start with "http"
CTES["scan_urls"] = """SELECT url_id, CASE WHEN starts_with(full_url, 'http') THEN full_url
    ELSE 'http://' || full_url END AS full_url FROM url_corpus"""
CTES |= norm_ctes("s_", "scan_urls")
CTES |= typo_ctes("s_", "scan_urls", "full_url")
CTES |= rule_ctes("s_")
