"""IPv4 / IPv6 expressions: parsing to numbers and address-range classes, JVM side only."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from linkguard.functions.sqlutil import let

OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4_RE = f"^{OCTET}([.]{OCTET}){{3}}$"

# --- fixed values: IANA special-purpose IPv4 ranges that are not publicly reachable --------
PRIVATE_V4 = ["0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12",
              "192.0.0.0/24", "192.0.0.170/31", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15",
              "198.51.100.0/24", "203.0.113.0/24", "240.0.0.0/4", "255.255.255.255/32"]
PRIVATE_V4_EXCEPT = ["192.0.0.9/32", "192.0.0.10/32"]
FEATURE_PRIVATE_V4 = ["10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "127.0.0.0/8"]
INTEL_PRIVATE_V4 = ["10.0.0.0/8", "127.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16",
                    "169.254.0.0/16"]
# --- fixed values: special-purpose IPv6 ranges, as (prefix hextets, prefix bits) ------------
PRIVATE_V6 = [("::1", 128), ("::", 128), ("::ffff:0:0", 96), ("64:ff9b:1::", 48), ("100::", 64),
              ("2001::", 23), ("2001:db8::", 32), ("2002::", 16), ("3fff::", 20), ("fc00::", 7),
              ("fe80::", 10)]
PRIVATE_V6_EXCEPT = [("2001:1::1", 128), ("2001:1::2", 128), ("2001:3::", 32),
                     ("2001:4:112::", 48), ("2001:20::", 28), ("2001:30::", 28)]
RESERVED_V6 = [("::", 8), ("100::", 8), ("200::", 7), ("400::", 6), ("800::", 5), ("1000::", 4),
               ("4000::", 3), ("6000::", 3), ("8000::", 3), ("a000::", 3), ("c000::", 3),
               ("e000::", 4), ("f000::", 5), ("f800::", 6), ("fe00::", 9)]


def v4_bounds(cidr: str) -> tuple[int, int]:
    addr, bits = cidr.split("/")
    a, b, c, d = (int(p) for p in addr.split("."))
    lo = (a << 24) + (b << 16) + (c << 8) + d
    return lo, lo + (1 << (32 - int(bits))) - 1


def v4_number(ip: str) -> str:
    """SQL: dotted quad text to bigint, NULL when it is not a strict dotted quad."""
    return let(ip, lambda s: f"CASE WHEN {s} RLIKE '{IPV4_RE}' THEN aggregate(split({s}, '[.]'), "
                             "0L, (acc, x) -> acc * 256 + cast(x as bigint)) END")


def _between(n: str, cidrs: list[str]) -> str:
    return "(" + " OR ".join(
        f"{n} BETWEEN {lo} AND {hi}" for lo, hi in map(v4_bounds, cidrs)) + ")"


def in_ranges(number: str, cidrs: list[str]) -> str:
    return let(number, lambda n: _between(n, cidrs))


def private_v4(number: str) -> str:
    return let(number, lambda n: f"({_between(n, PRIVATE_V4)} AND NOT "
                                 f"{_between(n, PRIVATE_V4_EXCEPT)})")


def dotted(number: str) -> str:
    return let(number, lambda n: f"concat_ws('.', {n} div 16777216, ({n} div 65536) % 256, "
                                 f"({n} div 256) % 256, {n} % 256)")


def add_v6(df: DataFrame, ip: str, out: str) -> DataFrame:
    """Adds ``out``: IPv6 text as an array of eight ints, NULL when it is not an IPv6 address.
    Built in small projections so that each intermediate text is computed once."""
    # a dotted-quad tail is rewritten as two hextets
    df = df.withColumn("_plain", F.expr(f"CASE WHEN contains({ip}, ':') AND "
                                        f"NOT contains({ip}, '%') THEN lower({ip}) END"))
    df = df.withColumn("_tail", F.expr("CASE WHEN contains(_plain, '.') THEN "
                                       "substring_index(_plain, ':', -1) END"))
    df = df.withColumn("_num", F.expr(v4_number("_tail")))
    df = df.withColumn("_head", F.expr(
        "CASE WHEN _tail IS NULL THEN _plain ELSE concat(left(_plain, length(_plain) - "
        "length(_tail)), lower(hex(_num div 65536)), ':', lower(hex(_num % 65536))) END"))
    # shape: hextets of up to four digits, at most one '::', no stray colon at either end
    df = df.withColumn("_head", F.expr(
        "CASE WHEN _head RLIKE '^[0-9a-f:]+$' AND NOT _head RLIKE "
        "'[0-9a-f]{5}|:::|::.*::|^:[^:]|[^:]:$' THEN _head END"))
    df = df.withColumns({
        "_left": F.expr("filter(split(substring_index(_head, '::', 1), ':'), x -> x <> '')"),
        "_right": F.expr("CASE WHEN contains(_head, '::') THEN filter(split(substr(_head, "
                         "instr(_head, '::') + 2), ':'), x -> x <> '') "
                         "ELSE cast(array() as array<string>) END")})
    df = df.withColumn("_n", F.expr("size(_left) + size(_right)"))
    df = df.withColumn(out, F.expr(
        "CASE WHEN _head IS NOT NULL AND CASE WHEN contains(_head, '::') THEN _n <= 7 "
        "ELSE _n = 8 END THEN transform(concat(_left, array_repeat('0', 8 - _n), _right), "
        "x -> cast(conv(x, 16, 10) as int)) END"))
    return df.drop("_plain", "_tail", "_num", "_head", "_left", "_right", "_n")


def _expand(prefix: str) -> list[int]:
    head, _, tail = prefix.partition("::")
    left = [int(x, 16) for x in head.split(":") if x]
    right = [int(x, 16) for x in tail.split(":") if x]
    return left + [0] * (8 - len(left) - len(right)) + right


def v6_in(groups: str, prefix: str, bits: int) -> str:
    want, tests = _expand(prefix), []
    for i in range(8):
        n = min(16, max(0, bits - 16 * i))
        if n == 16:
            tests.append(f"{groups}[{i}] = {want[i]}")
        elif n:
            shift = 16 - n
            tests.append(f"shiftright({groups}[{i}], {shift}) = {want[i] >> shift}")
    return "(" + " AND ".join(tests) + ")"


def v6_any(groups: str, ranges) -> str:
    return "(" + " OR ".join(v6_in(groups, p, b) for p, b in ranges) + ")"


def private_v6(groups: str) -> str:
    return f"({v6_any(groups, PRIVATE_V6)} AND NOT {v6_any(groups, PRIVATE_V6_EXCEPT)})"
