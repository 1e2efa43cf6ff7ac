"""Destination policy: which URLs point to a public destination, as a table check."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from linkguard import constants as C
from linkguard.functions import ip as IP
from linkguard.functions.sqlutil import add, array, in_list, let, pin


def syntax(urls: DataFrame, url_col: str = "full_url") -> DataFrame:
    """Adds ``hostname`` and ``syntax_reason`` (the first failing check, NULL when all pass)."""
    df = add(urls, _p=f"CASE WHEN contains({url_col}, '://') THEN {url_col} "
                      f"ELSE concat('http://', {url_col}) END")
    df = add(df, _scheme="lower(regexp_extract(_p, '^([a-zA-Z][a-zA-Z0-9+.-]*):', 1))",
             _net="regexp_extract(_p, '^([a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)', 2)")
    df = add(df, _host="substring_index(_net, '@', -1)")
    df = add(df, hostname="btrim(lower(CASE WHEN contains(_host, '[') THEN substring_index("
                          "substr(_host, instr(_host, '[') + 1), ']', 1) "
                          "ELSE substring_index(_host, ':', 1) END))")
    suffix = f"get(filter({array(C.BLOCKED_SUFFIXES)}, s -> endswith(hostname, s)), 0)"
    return add(df, syntax_reason=f"""CASE
        WHEN coalesce({url_col}, '') = '' THEN 'invalid_input'
        WHEN length({url_col}) > {C.MAX_URL_LENGTH} THEN 'url_too_long'
        WHEN contains(_net, '[') <> contains(_net, ']') THEN 'parse_error'
        WHEN NOT {in_list('_scheme', C.ALLOWED_SCHEMES)} THEN concat('blocked_scheme:', _scheme)
        WHEN hostname = '' THEN 'missing_hostname'
        WHEN {in_list('hostname', C.BLOCKED_HOSTS)} THEN 'blocked_hostname'
        WHEN {suffix} IS NOT NULL THEN concat('blocked_suffix:', {suffix}) END""",
               ).drop("_p", "_scheme", "_net", "_host")


def decode_ip(hosts: DataFrame) -> DataFrame:
    """Adds ``decoded_ip``: the dotted form of decimal, 0x-hex and dotted (octal) hosts."""
    # a dotted part with a leading zero is octal; an octal part with 8 or 9 decodes to nothing
    octet = ("CASE WHEN NOT startswith(x, '0') THEN try_cast(x as bigint) "
             "WHEN x RLIKE '^[0-7]+$' THEN cast(conv(x, 8, 10) as bigint) END")
    quad = (f"aggregate(transform(split(h, '[.]'), x -> {octet}), 0L, "
            "(acc, o) -> shiftleft(acc, 8) | o)")
    number = let("hostname", lambda h: f"""CASE
        WHEN {h} RLIKE '^[0-9]+$' THEN try_cast({h} as bigint)
        WHEN {h} RLIKE '^0x0*[0-9a-f]{{1,8}}$' THEN cast(conv(substr({h}, 3), 16, 10) as bigint)
        WHEN {h} RLIKE '^[0-9]+([.][0-9]+){{3}}$' THEN {quad.replace('h,', h + ',')} END""")
    df = add(hosts, decoded_ip=let(number, lambda n: (
        f"CASE WHEN {n} BETWEEN 0 AND {0xFFFFFFFF} THEN {IP.dotted(n)} END")))
    return pin(df, "decoded_ip")


def classify_ip(rows: DataFrame, col: str = "ip", out: str = "ip_reason") -> DataFrame:
    """Adds ``out``: why an address is not a public destination, NULL when it is one. IPv4-mapped
    IPv6 addresses are judged by the address they carry."""
    df = IP.add_v6(rows, col, "_g")
    df = add(df, _m="_g IS NOT NULL AND " + IP.v6_in("_g", "::ffff:0:0", 96))
    df = add(df, _n=f"CASE WHEN _m THEN cast(_g[6] as bigint) * 65536 + _g[7] "
                    f"ELSE {IP.v4_number(col)} END")
    v4 = [ip for ip in C.METADATA_IPS if ":" not in ip]
    v6 = [ip for ip in C.METADATA_IPS if ":" in ip]
    meta4 = " OR ".join(f"_n = {IP.v4_bounds(ip + '/32')[0]}" for ip in v4)
    meta6 = IP.v6_any("_g", [(ip, 128) for ip in v6])
    df = add(df, **{out: f"""CASE WHEN {col} IS NULL OR (_n IS NULL AND _g IS NULL)
          THEN 'invalid_ip_format'
        WHEN _n IS NOT NULL THEN CASE WHEN {meta4} THEN 'cloud_metadata_endpoint'
          WHEN {IP.in_ranges('_n', ['127.0.0.0/8'])} THEN 'loopback'
          WHEN {IP.private_v4('_n')} THEN 'private_range'
          WHEN {IP.in_ranges('_n', ['224.0.0.0/4'])} THEN 'multicast' END
        ELSE CASE WHEN {meta6} THEN 'cloud_metadata_endpoint'
          WHEN {IP.v6_in('_g', '::1', 128)} THEN 'loopback'
          WHEN {IP.private_v6('_g')} THEN 'private_range'
          WHEN {IP.v6_any('_g', IP.RESERVED_V6)} THEN 'reserved'
          WHEN {IP.v6_in('_g', 'ff00::', 8)} THEN 'multicast' END END"""}).drop("_g", "_m", "_n")
    return pin(df, out)


def host_resolution(dns: DataFrame) -> DataFrame:
    """Per host: number of distinct stored addresses and the lowest blocked one with its reason."""
    addr = dns.where("record_type IN ('A', 'AAAA')").selectExpr(
        "rtrim('.', lower(domain)) AS hostname", "record_value AS ip").distinct()
    df = classify_ip(addr)
    blocked = F.when(F.col("ip_reason").isNotNull(), F.col("ip"))
    return df.groupBy("hostname").agg(
        F.count("*").alias("n_resolved"), F.min(blocked).alias("blocked_resolved"),
        F.min_by("ip_reason", blocked).alias("resolved_reason"))


def egress_policy(urls: DataFrame, dns: DataFrame | None, url_col: str = "full_url") -> DataFrame:
    """``is_safe``, ``reason`` and ``blocked_ip`` per URL. Without ``dns`` names are not resolved."""
    df = decode_ip(syntax(urls, url_col))
    df = add(df, direct="coalesce(decoded_ip, CASE WHEN contains(hostname, ':') THEN hostname END)")
    df = classify_ip(df, "direct", "direct_reason")
    df = add(df, direct="CASE WHEN direct_reason = 'invalid_ip_format' THEN NULL ELSE direct END",
             direct_reason="CASE WHEN direct_reason <> 'invalid_ip_format' THEN direct_reason END")
    if dns is not None:
        df = df.join(host_resolution(dns), "hostname", "left")
        resolved = ("CASE WHEN n_resolved IS NULL THEN 'dns_resolution_failed' WHEN "
                    "resolved_reason IS NOT NULL THEN concat('resolved_to_', resolved_reason) END")
    else:
        df = add(df, blocked_resolved="cast(NULL as string)", n_resolved="0")
        resolved = "cast(NULL as string)"
    df = add(df, reason=f"""CASE WHEN syntax_reason IS NOT NULL THEN syntax_reason
        WHEN direct_reason IS NOT NULL AND decoded_ip IS NOT NULL
          THEN concat('encoded_ip:', direct_reason)
        WHEN direct_reason IS NOT NULL THEN direct_reason
        WHEN direct IS NOT NULL THEN NULL ELSE {resolved} END""",
             blocked_ip="CASE WHEN syntax_reason IS NOT NULL THEN NULL WHEN direct_reason IS NOT "
                        "NULL THEN direct WHEN direct IS NULL THEN blocked_resolved END",
             hostname="CASE WHEN syntax_reason IS NULL THEN coalesce(decoded_ip, hostname) "
                      "ELSE hostname END",
             n_resolved="CASE WHEN syntax_reason IS NOT NULL THEN 0 WHEN direct IS NOT NULL THEN 1 "
                        "ELSE coalesce(n_resolved, 0) END")
    return add(df, is_safe="reason IS NULL").drop("syntax_reason", "decoded_ip", "direct",
                                                  "direct_reason", "blocked_resolved",
                                                  "resolved_reason")


def redirect_chain(hops: DataFrame, dns: DataFrame | None,
                   max_redirects: int = C.MAX_REDIRECTS) -> DataFrame:
    """Verdict per chain: the first blocked hop among those whose destination is checked.

    Following ``max_redirects`` redirects takes ``max_redirects + 1`` requests, and the target of
    the last one's answer is checked too. A chain that goes on after it has too many redirects and
    is not safe.
    """
    last = max_redirects + 1
    df = egress_policy(hops, dns)
    bad = F.when(~F.col("is_safe") & (F.col("hop") <= last), F.col("hop"))
    longer = F.max("hop") > last
    return df.groupBy("chain_id").agg(
        F.count("*").alias("hops"), F.min(bad).alias("blocked_hop"),
        F.coalesce(F.min_by("reason", bad), F.when(longer, F.lit("too_many_redirects"))).alias("reason"),
        (F.every(F.col("is_safe")) & ~longer).alias("is_safe"))
