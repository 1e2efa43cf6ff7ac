"""Registered queries of this package and their SQL counterparts."""

from __future__ import annotations

from . import (decontaminate, hard_negatives, jaccard, language, mixing, periodic, quality, secrets, substring_dedup,
               suffix_dedup, tokens, topk, url_filter)
from .common import table

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f
    return put


@query("op5_decontaminate", r"""
WITH b AS (SELECT DISTINCT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9\x{80}-\x{10FFFF}]+') AS w
           FROM benchmark WHERE text IS NOT NULL),
bw AS (SELECT DISTINCT item_id, least(len(w), 13) AS size, array_to_string(w[i:i + 12], ' ') AS win
       FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 12))) AS i FROM b WHERE len(w) > 0)),
d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9\x{80}-\x{10FFFF}]+') AS w
      FROM documents),
sizes AS (SELECT DISTINCT size FROM bw),
dw AS (SELECT rid, size, i, array_to_string(w[i:i + size - 1], ' ') AS win
       FROM (SELECT rid, w, size, unnest(generate_series(1, len(w) - size + 1)) AS i FROM d, sizes WHERE len(w) >= size)),
hit AS (SELECT rid, item_id, dw.i, dw.size FROM dw JOIN bw ON dw.win = bw.win AND dw.size = bw.size),
cov AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(generate_series(i, i + size - 1)) AS p FROM hit) GROUP BY rid),
its AS (SELECT rid, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids
        FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN cov USING (rid) LEFT JOIN its USING (rid)
""")
def op5(spark, sf_dir):
    return decontaminate.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op7_mixing")
def op7(spark, sf_dir):
    return mixing.digest(table(spark, sf_dir, "documents"))


def vocabulary() -> str:
    """The public tokenizer file that op10 and the pipeline use; the operator takes any path."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op10_token_output")
def op10(spark, sf_dir):
    return tokens.digest(table(spark, sf_dir, "documents"), vocabulary())


@query("op3_top_k", r"""
WITH v AS (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
           FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, d.vec_id, CAST(list_sum(list_transform(list_zip(q.e, d.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
      FROM v q JOIN v d ON q.vec_id <> d.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20
""")
def op3(spark, sf_dir):
    return topk.digest(table(spark, sf_dir, "embeddings"))


@query("op4_url_filter")
def op4(spark, sf_dir):
    return url_filter.judge(table(spark, sf_dir, "pages"))


@query("op9_language_id")
def op9(spark, sf_dir):
    return language.digest(table(spark, sf_dir, "documents"))


def _positions(kind: str, pattern: str) -> str:
    """SQL for row, kind, hit, start and stop of all matches, by running sums over pieces and matches."""
    p = pattern.replace("'", "''")
    return f"""SELECT row, '{kind}' AS kind, hit, stop - length(hit) AS start, stop FROM (
  SELECT row, hit, sum(length(piece) + length(hit)) OVER (PARTITION BY row ORDER BY nth) AS stop FROM (
    SELECT row, unnest(hits) AS hit, unnest(pieces[1:len(hits)]) AS piece, generate_subscripts(hits, 1) AS nth FROM (
      SELECT row, regexp_extract_all(text, '{p}') AS hits, regexp_split_to_array(text, '{p}') AS pieces
      FROM d WHERE regexp_matches(text, '{p}'))))"""


def _any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


def _secrets_sql() -> str:
    sign = r"""["']?\x20*[:=]\x20*["']?"""
    either = lambda words: "(?:" + "|".join(_any_case(w) for w in words) + ")"
    name = either(["password", "passwd", "secret", "token", "api_?key"]) + sign
    patterns = dict(secrets.PATTERNS, assign=name + "[A-Za-z0-9+/_.=-]+",
                    id=either(["username", "user", "login", "client_?id", "account"]) + sign + "[A-Za-z0-9._@-]{3,}")
    found = " UNION ALL ".join(_positions(k, p) for k, p in patterns.items())
    case = lambda m: "CASE kind " + " ".join(f"WHEN '{k}' THEN {v!r}" for k, v in m.items()) + " END"
    value = (name + "([A-Za-z0-9+/_.=-]+)").replace("'", "''")
    strong = "('assign', 'access', 'hex')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
f AS ({found}),
g AS (SELECT row, CASE WHEN kind = 'access' AND length(hit) < 20 THEN 'id' ELSE kind END AS kind, start, stop FROM f
      WHERE CASE kind WHEN 'assign' THEN length(regexp_extract(hit, '{value}', 1)) >= 6 WHEN 'access' THEN length(hit) >= 8
            WHEN 'secret' THEN regexp_matches(hit, '[0-9]') AND regexp_matches(hit, '[A-Za-z]') ELSE true END),
r AS (SELECT *, {case(secrets.RANK)} AS rank, {case(secrets.ROLE)} AS role FROM g),
p AS (SELECT * FROM r WHERE NOT EXISTS (SELECT 1 FROM r o WHERE o.row = r.row AND o.rank < r.rank
                                        AND o.start < r.stop AND o.stop > r.start)),
t AS (SELECT * FROM p WHERE kind IN {strong} OR EXISTS (SELECT 1 FROM p o WHERE o.row = p.row AND o.role <> p.role
                                                        AND abs(o.start - p.start) <= {secrets.REACH})),
n AS (SELECT row, kind, {case({k: i for i, k in enumerate(secrets.KINDS)})} AS nth, start,
             kind || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT) AS s FROM t),
a AS (SELECT row, count(*) FILTER (kind = 'assign') AS a, count(*) FILTER (kind = 'access') AS c,
             count(*) FILTER (kind = 'hex') AS h, string_agg(s, ',' ORDER BY start, nth) FILTER (kind IN {strong}) AS base,
             string_agg(s, ',' ORDER BY start, nth) AS every FROM n GROUP BY row)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(c, 0) AS n_access, coalesce(h, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(every, '') AS spans FROM d LEFT JOIN a USING (row)
"""


@query("op6_secret_scan", _secrets_sql())
def op6(spark, sf_dir):
    return secrets.digest(table(spark, sf_dir, "documents"))


@query("op1_substring_dedup", r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS win
      FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 19)) AS i FROM w)),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY win ORDER BY doc_id, i) AS nth FROM g),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 19)) AS p FROM r WHERE nth > 1),
t AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM w),
k AS (SELECT t.doc_id, count(*) FILTER (gone.p IS NOT NULL) AS n_removed,
             string_agg(word, ' ' ORDER BY t.p) FILTER (gone.p IS NULL) AS kept
      FROM t LEFT JOIN gone ON t.doc_id = gone.doc_id AND t.p = gone.p GROUP BY t.doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k USING (doc_id)
""")
def op1(spark, sf_dir):
    return substring_dedup.digest(table(spark, sf_dir, "documents"))


@query("op2_suffix_dedup")
def op2(spark, sf_dir):
    return suffix_dedup.digest(table(spark, sf_dir, "documents"))


@query("op8_jaccard_join", r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS t
      FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 3))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM o JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * k >= 85 * (p.n + q.n - k)),
r(x, y) AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x),
c AS (SELECT x, min(y) AS m FROM r GROUP BY x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(c.m, d.doc_id)) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.x = d.doc_id
""")
def op8(spark, sf_dir):
    return jaccard.digest(table(spark, sf_dir, "documents"))


@query("op11_periodic_runs", r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
-- crc32, one bit of the decimal doc_id at a time
c AS (SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
          lambda s: list_transform(range(8), lambda k: (CAST(ascii(s) AS BIGINT) >> CAST(k AS INTEGER)) & 1)))),
          lambda x, bit: xor(x >> 1, (xor(x, bit) & 1) * 3988292384)), 4294967295::BIGINT) AS h FROM d),
a AS (SELECT *, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a FROM c),
p AS (SELECT *, 1 + (len(w) - a) // (3 + (h // 10) % 8) AS p FROM a),
t AS (SELECT rid, doc_id, CASE WHEN a IS NULL THEN w ELSE list_transform(range(len(w)),
          lambda i: w[1 + CASE WHEN i >= a THEN a + (i - a) % p ELSE i END]) END AS w FROM p),
-- a run of 12 words or more repeats six words in a row at its period
g AS (SELECT rid, i, array_to_string(w[i + 1:i + 6], ' ') AS six FROM (SELECT rid, w, unnest(range(len(w) - 5)) AS i FROM t)),
m AS (SELECT x.rid, y.i - x.i AS q, x.i FROM g x JOIN g y ON x.rid = y.rid AND x.six = y.six AND x.i < y.i),
s AS (SELECT rid, q, min(i) AS start, count(*) + 5 + q AS length
      FROM (SELECT *, i - row_number() OVER (PARTITION BY rid, q ORDER BY i) AS island FROM m) GROUP BY rid, q, island),
r AS (SELECT rid, start, length, min(q) AS period FROM s WHERE length >= greatest(12, 2 * q) GROUP BY rid, start, length),
n AS (SELECT rid, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines
      FROM r GROUP BY rid),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY length DESC, start, period) AS nth FROM r) WHERE nth = 1),
x AS (SELECT DISTINCT rid, unnest(range(start + period, start + length)) AS i FROM r),
k AS (SELECT v.rid, string_agg(word, ' ' ORDER BY v.i) AS kept
      FROM (SELECT rid, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS i FROM t) v LEFT JOIN x ON x.rid = v.rid AND x.i = v.i
      WHERE x.rid IS NULL GROUP BY v.rid)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, CAST(b.start AS BIGINT) AS start, CAST(b.length AS BIGINT) AS length,
       CAST(b.period AS BIGINT) AS period, CAST(1000 * b.length // b.period AS BIGINT) AS exponent_milli,
       sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM t LEFT JOIN n USING (rid) LEFT JOIN b USING (rid) LEFT JOIN k USING (rid)
""")
def op11(spark, sf_dir):
    return periodic.digest(periodic.with_planted_periods(table(spark, sf_dir, "documents")))


@query("op12_quality")
def op12(spark, sf_dir):
    return quality.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op13_hard_negatives", r"""
WITH v AS (SELECT row_number() OVER () AS rid, vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label,
                  list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.rid, a.vec_id AS anchor_id, d.vec_id, a.label = d.label AS same,
             CAST(list_sum(list_transform(list_zip(a.e, d.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
      FROM v a JOIN v d ON a.vec_id <> d.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS nth FROM s WHERE same) WHERE nth <= 5),
n AS (SELECT p.rid, p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
             row_number() OVER (PARTITION BY p.rid, p.nth ORDER BY s.score DESC, s.vec_id) AS rank
      FROM p JOIN s ON s.rid = p.rid AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
""")
def op13(spark, sf_dir):
    return hard_negatives.digest(table(spark, sf_dir, "embeddings"))
