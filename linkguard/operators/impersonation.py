"""Brand impersonation: a fuzzy join of host labels with the brand dictionary.

Work is done once per distinct host. Candidate pairs come from a piece index over the brands: a text
within edit distance d of a brand holds at least one of d + 1 pieces of it, moved by no more than d,
and a label that embeds a brand holds it whole. So labels and brands meet in an equi-join on pieces,
and the pairs per label do not grow with the brand table unless brands really are that similar.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from linkguard import constants as C
from linkguard.functions.sqlutil import add, items, let


def brand_dim(spark: SparkSession, brands=None, high_value=None) -> DataFrame:
    """brand, brand_pos (dictionary order), high_value; lower-case and distinct."""
    seen: dict[str, int] = {}
    for i, b in enumerate(brands or C.BRANDS):
        seen.setdefault(b.lower(), i)
    high = {b.lower() for b in (high_value or C.HIGH_VALUE_BRANDS)}
    return spark.createDataFrame([(b, i, b in high) for b, i in seen.items()],
                                 "brand string, brand_pos int, high_value boolean")


def host_of(url: str) -> str:
    """SQL: the text before the first ':' of the authority (user info is not removed)."""
    def body(s):
        full = f"CASE WHEN contains({s}, '://') THEN {s} ELSE concat('http://', {s}) END"
        netloc = f"regexp_extract({full}, '^([a-z][a-z0-9+.-]*:)?//([^/?#]*)', 2)"
        return (f"CASE WHEN contains({s}, '/') OR contains({s}, '?') "
                f"THEN substring_index({netloc}, ':', 1) "
                f"ELSE btrim(substring_index({s}, ':', 1), '.') END")
    return let(f"lower(btrim({url}))", body)


def with_host(urls: DataFrame, url_col: str) -> DataFrame:
    return urls.withColumn("ts_host", F.expr(host_of(url_col)))


def host_labels(hosts: DataFrame) -> DataFrame:
    """(ts_host, label_pos, label) for distinct hosts with at least two labels."""
    df = add(hosts.select("ts_host").distinct(), parts="split(ts_host, '[.]')")
    df = add(df.where("size(parts) >= 2"), main="slice(parts, 1, size(parts) - 1)")
    df = add(df, labels="""filter(concat(
        transform(main, (x, i) -> named_struct('pos', i, 'label', x)),
        CASE WHEN size(main) > 1 THEN array(named_struct('pos', size(main),
             'label', array_join(main, '-'))) ELSE cast(array() as
             array<struct<pos:int,label:string>>) END), e -> length(e.label) >= 3)""")
    return (df.select("ts_host", F.explode(items("labels")).alias("e"))
            .select("ts_host", F.col("e.pos").alias("label_pos"), F.col("e.label").alias("label")))


def normalize_labels(labels: DataFrame) -> DataFrame:
    """Adds the accent-free form, the Latin reading of look-alike characters and the decoded
    ``xn--`` text. Only non-ASCII and ``xn--`` labels carry text to Python; all others pass NULL."""
    from linkguard.functions.unicode import fold_label, punycode_decode
    df = add(labels, odd_label=r"CASE WHEN label RLIKE '[^\\x00-\\x7F]' THEN label END",
             xn_label="CASE WHEN startswith(label, 'xn--') THEN label END")
    df = df.withColumn("f", fold_label("odd_label")).withColumn("d", punycode_decode("xn_label"))
    df = add(df, normalized="CASE WHEN odd_label IS NULL THEN label ELSE f.normalized END",
             latin="CASE WHEN odd_label IS NULL THEN label ELSE f.latin END",
             has_homoglyph="odd_label IS NOT NULL AND f.has_homoglyph",
             decoded="CASE WHEN xn_label IS NOT NULL THEN lower(d) END")
    return df.where("length(normalized) >= 3").drop("odd_label", "xn_label", "f", "d")


def brand_band(brands: DataFrame, tol: int = C.LENGTH_TOLERANCE) -> DataFrame:
    """The dictionary repeated for each text length it is compared with. Plain labels: within
    ``tol``. Decoded labels have no tolerance, but similarity 0.75 bounds the length ratio."""
    spans = (f"array(named_struct('kind', 'plain', 'lo', greatest(length(brand) - {tol}, 1), "
             f"'hi', length(brand) + {tol}), named_struct('kind', 'xn', "
             "'lo', cast(ceil(length(brand) * 0.75D) as int), "
             "'hi', cast(floor(length(brand) / 0.75D) as int)))")
    df = brands.select("*", F.explode(F.expr(spans)).alias("s"))
    return df.select("brand", "brand_pos", "high_value", F.col("s.kind").alias("kind"),
                     F.explode(F.sequence("s.lo", "s.hi")).alias("cand_len"))


def length_pairs(labels: DataFrame, brands: DataFrame, tol: int = C.LENGTH_TOLERANCE) -> DataFrame:
    """All label/brand pairs of comparable length, by an equi-join on the text length. They grow with
    labels times brands; detection uses ``candidates``."""
    texts = ("filter(array(named_struct('kind', 'plain', 'text', normalized), "
             "named_struct('kind', 'xn', 'text', decoded)), e -> e.text <> '')")
    df = labels.withColumn("e", F.explode(F.expr(texts))).withColumn(
        "cand_len", F.length("e.text")).withColumn("kind", F.col("e.kind"))
    return df.join(brand_band(brands, tol), ["kind", "cand_len"]).drop(
        "e", "cand_len")


# --- piece index: key of an edit piece is e<brand length>,<distance>,<number>:<piece>, of a whole brand c:<brand>
_NO_KEYS = "cast(array() as array<string>)"


def _span(lo: str, hi: str, var: str, body: str) -> str:
    """SQL array of ``body`` for ``var`` from ``lo`` to ``hi``; empty if there is none."""
    return f"CASE WHEN {lo} <= {hi} THEN transform(sequence({lo}, {hi}), {var} -> {body}) ELSE array() END"


def _piece(l: str, d: str, i: str) -> tuple[str, str]:
    """Start (from 0) and length of piece ``i`` of ``d + 1`` of a text of length ``l``."""
    start = f"cast({i} * {l} div ({d} + 1) as int)"
    return start, f"cast(({i} + 1) * {l} div ({d} + 1) as int) - {start}"


def brand_index(brands: DataFrame) -> DataFrame:
    """The brands once per key: whole, and cut into the pieces of each distance that their length and
    that of a text within similarity 0.75 allow."""
    l = "length(brand)"
    start, size = _piece(l, "d", "i")
    cut = f"transform(sequence(0, d), i -> concat('e', {l}, ',', d, ',', i, ':', substr(brand, {start} + 1, {size})))"
    keys = (f"concat(array(concat('c:', brand)), flatten(transform(sequence({l} div 4, "
            f"cast(floor({l} / 0.75D) as int) div 4), d -> {cut})))")
    return brands.where("brand <> ''").select("*", F.explode(F.expr(keys)).alias("key"))


def _edit_keys(text: str, tol: int | None) -> str:
    """SQL array of the keys that ``text`` shares with every brand within similarity 0.75: for each
    brand length and piece, the substrings at the places where that piece can have moved to (it moves
    by no more than the edits before it, and by no more than those behind it allow)."""
    m = f"length({text})"
    lo, hi = f"cast(ceil({m} * 0.75D) as int)", f"least(cast(floor({m} / 0.75D) as int), longest)"
    if tol is not None:
        lo, hi = f"greatest({lo}, {m} - {tol}, 1)", f"least({hi}, {m} + {tol})"
    start, size = _piece("l", "d", "i")

    def windows(p):
        first = f"greatest(0, {p} - i, {p} + {m} - l - d + i)"
        last = f"least({m} - ({size}), {p} + i, {p} + {m} - l + d - i)"
        key = f"concat('e', l, ',', d, ',', i, ':', substr({text}, s + 1, {size}))"
        return _span(first, last, "s", key)
    per_piece = f"flatten(transform(sequence(0, d), i -> {let(start, windows)}))"
    per_length = f"transform(array(cast(greatest({m}, l) div 4 as int)), d -> {per_piece})[0]"
    return f"CASE WHEN {text} <> '' THEN flatten({_span(lo, hi, 'l', per_length)}) ELSE {_NO_KEYS} END"


def _whole_keys(tol: int) -> str:
    """SQL array of the substrings of ``label`` that can be an embedded brand."""
    m = "length(label)"
    lo = f"greatest(1, length(normalized) - {tol}, cast(ceil({m} / 2.5D) as int))"
    hi = f"least(length(normalized) + {tol}, {m}, longest)"
    cut = _span("0", f"{m} - l", "s", "concat('c:', substr(label, s + 1, l))")
    return f"flatten({_span(lo, hi, 'l', cut)})"


def candidates(labels: DataFrame, brands: DataFrame, tol: int = C.LENGTH_TOLERANCE) -> DataFrame:
    """Label/brand pairs that share a key of the piece index: a superset of all pairs that any
    detection step reports, each pair once. The built-in dictionary (168 brands) is broadcast by its
    size; a caller's may be of any size."""
    longest = brands.agg(F.coalesce(F.max(F.length("brand")), F.lit(0))).scalar()
    rest = labels.columns
    plain = (f"concat({_whole_keys(tol)}, {_edit_keys('normalized', tol)}, "
             f"CASE WHEN has_homoglyph THEN {_edit_keys('latin', None)} ELSE {_NO_KEYS} END)")
    texts = (f"array(named_struct('kind', 'plain', 'keys', array_distinct({plain})), "
             f"named_struct('kind', 'xn', 'keys', array_distinct({_edit_keys('decoded', None)})))")
    df = labels.withColumn("longest", longest).withColumn("e", F.explode(F.expr(texts)))
    df = df.select(*rest, F.col("e.kind").alias("kind"), F.explode("e.keys").alias("key"))
    found = df.join(brand_index(brands), "key").drop("key")
    return found.where(f"kind = 'xn' OR abs(length(normalized) - length(brand)) <= {tol}").distinct()


def similarity_sql(a: str, b: str = "brand") -> str:
    return (f"CASE WHEN {a} = {b} THEN 1D ELSE 1D - levenshtein({a}, {b}) / "
            f"cast(greatest(length({a}), length({b})) as double) END")


def _close(a: str) -> str:
    # bounded edit distance: similarity >= 0.75 is distance <= max length / 4
    return (f"levenshtein({a}, brand, cast(floor(greatest(length({a}), length(brand)) / 4D) "
            f"as int)) >= 0")


# --- fixed values: ranks of the detection steps, in the order they report
COMBO, EDIT, GLYPH, PUNY = 0, 1, 2, 3


def _technique() -> str:
    """Kind of edit between text and brand, most specific first; needs ``diffs``."""
    first = "instr(text, substr(text, diffs[0], 1))"
    swap = (f"{first} < length(text) AND substr(text, {first}, 1) = substr(brand, {first} + 1, 1) "
            f"AND substr(text, {first} + 1, 1) = substr(brand, {first}, 1)")
    vowels = ("forall(diffs, i -> contains('aeiou', substr(text, i, 1)) "
              "AND contains('aeiou', substr(brand, i, 1)))")
    return f"""CASE step WHEN {COMBO} THEN 'combosquatting' WHEN {GLYPH} THEN 'homoglyph'
        WHEN {PUNY} THEN 'punycode' ELSE
        CASE WHEN length(text) > length(brand) THEN 'insertion'
          WHEN length(text) < length(brand) THEN 'deletion'
          WHEN size(diffs) = 1 THEN 'character_substitution'
          WHEN size(diffs) = 2 AND {swap} THEN 'transposition'
          WHEN size(diffs) = 2 AND {vowels} THEN 'vowel_swap' ELSE 'edit_distance' END END"""


def label_matches(pairs: DataFrame) -> DataFrame:
    """Every detection of every pair: one pass, at most a few rows survive the ``explode``."""
    steps = f"""filter(CASE WHEN kind = 'xn' THEN
        array(CASE WHEN decoded = brand OR {_close('decoded')} THEN {PUNY} END) ELSE array(
        CASE WHEN contains(label, brand) AND label <> brand
             AND length(label) <= length(brand) * 2.5D THEN {COMBO} END,
        CASE WHEN normalized <> brand AND {_close('normalized')} THEN {EDIT} END,
        CASE WHEN has_homoglyph AND latin <> brand AND {_close('latin')} THEN {GLYPH} END) END,
        s -> s IS NOT NULL)"""
    df = pairs.withColumn("step", F.explode(F.expr(steps)))
    df = add(df, text=f"CASE step WHEN {GLYPH} THEN latin WHEN {PUNY} THEN decoded "
                      "ELSE normalized END")
    df = add(df, similarity=f"CASE WHEN step = {COMBO} THEN 0.85D ELSE {similarity_sql('text')} "
                            "END",
             diffs="CASE WHEN length(text) = length(brand) THEN filter(sequence(1, length(text)), "
                   "i -> substr(text, i, 1) <> substr(brand, i, 1)) END")
    df = add(df, technique=_technique(),
             pct="concat(cast(round(similarity * 100) as int), '%')",
             phase=f"int(step = {PUNY})")
    boost = "CASE technique " + " ".join(
        f"WHEN '{t}' THEN {b}" for t, b in C.TECHNIQUE_BOOST.items()) + " ELSE 0 END"
    return add(
        df, risk="least(cast(greatest(0D, least(100D, ((similarity - 0.75D) / 0.25D) * 50 + 50 + "
                 f"CASE WHEN high_value THEN 15 ELSE 0 END + {boost})) as int) "
                 f"+ CASE WHEN step = {PUNY} THEN 15 ELSE 0 END, 100)",
        details=f"""CASE step
          WHEN {COMBO} THEN concat("'", brand, "' embedded in '", label, "'")
          WHEN {EDIT} THEN concat("'", label, "' resembles '", brand, "' (", pct, ')')
          WHEN {GLYPH} THEN concat("'", label, "' contains homoglyph chars of '", brand, "'")
          ELSE concat("Punycode '", label, "' decodes to '", decoded, "'") END""",
    ).drop("text", "diffs", "pct", "normalized", "latin", "has_homoglyph", "decoded", "kind")


def typosquat_matches(hosts: DataFrame, brands: DataFrame) -> DataFrame:
    """One row per (host, brand, technique): the first match in label, brand, step order.

    The only shuffle is the one that makes hosts distinct: both group-bys start with the host and
    reuse its partitioning. Labels such as ``www`` are compared once per host instead of being
    joined back by label, which would put a third of all rows on one key.
    """
    df = label_matches(candidates(normalize_labels(host_labels(hosts)), brands))
    order = F.struct("label_pos", "phase", "brand_pos", "step")
    return (df.groupBy("ts_host", "brand", "technique")
            .agg(F.min_by(F.struct("similarity", "risk", "details"), order).alias("m"),
                 F.min(order).alias("ord"))
            .select("ts_host", "brand", "technique", "m.similarity", "m.risk", "m.details", "ord"))


def typosquat_rollup(matches: DataFrame) -> DataFrame:
    """Per host: highest risk and the matches by falling risk. A host has at most a few matches
    per brand, so the collected array is bounded by the dictionary."""
    entry = F.struct((-F.col("risk")).alias("neg"), "ord", F.struct(
        "brand", "similarity", "technique", "risk", "details").alias("m"))
    df = matches.groupBy("ts_host").agg(F.max("risk").alias("ts_highest_risk"),
                                        F.array_sort(F.collect_list(entry)).alias("e"))
    return df.select("ts_host", "ts_highest_risk",
                     F.transform("e", lambda x: x["m"]).alias("ts_matches"))


def brand_report(urls_with_host: DataFrame, matches: DataFrame) -> DataFrame:
    """Brand / technique frequencies over the URLs: hosts are counted before the join, so a
    hot host is one row there."""
    per_host = urls_with_host.groupBy("ts_host").agg(F.count("*").alias("n_urls"))
    return (matches.join(per_host, "ts_host").groupBy("brand", "technique")
            .agg(F.sum("n_urls").alias("n_urls"), F.count("*").alias("n_hosts")))
