"""Secret scan with multipart credential linking, with DataFrame functions only.

Strong spans are reported as they are: `assign` (a secret's name, a sign and a value), `access` (access key identifiers) and
`hex` (long hexadecimal runs). Weak parts mean little alone: `id` (a user or client identifier, or an access identifier that
is too short), `secret` (a long run of mixed letters and digits) and `endpoint` (an address). Identifiers, secrets and
endpoints are roles of a credential; a weak part is reported if a part of another role starts within `REACH` code points in
the same document. That is an interval join: the parts of a document fall into bins of `REACH` code points, each bin keeps
the first and last start of each role, and a weak part meets three bins.

Positions are code points, ends exclusive. A text is cut at its matches, and running sums over the lengths of pieces and
matches give the starts, in linear time for texts with very many matches.

Defined results: null and empty texts have no spans. Weak parts that overlap a strong span, or a weak one earlier in the
order endpoint, id, secret, are dropped. Repeated rows, also of one doc_id, are scanned each for itself; extra input columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

_SIGN = "[\"']?\\x20*[:=]\\x20*[\"']?"
ASSIGN = "((?i)password|passwd|secret|token|api_?key)" + _SIGN + "([A-Za-z0-9+/_.=-]+)"
PATTERNS = {
    "assign": ASSIGN,
    "access": "AKIA[A-Z0-9]+",
    "hex": "[0-9a-f]{24,}",
    "id": "((?i)username|user|login|client_?id|account)" + _SIGN + "([A-Za-z0-9._@-]{3,})",
    "secret": "[A-Za-z0-9+/_=-]{20,}",
    "endpoint": "[a-z][a-z0-9+.-]*://[^\\x20\\x09-\\x0D\"'<>]{4,}",
}
KINDS = ["assign", "access", "hex", "id", "secret", "endpoint"]
STRONG = KINDS[:3]
ROLE = {"access": "identifier", "id": "identifier", "assign": "secret", "hex": "secret", "secret": "secret",
        "endpoint": "endpoint"}
#: Weak parts give way to spans of a smaller number.
RANK = {"assign": 0, "access": 0, "hex": 0, "endpoint": 1, "id": 2, "secret": 3}
REACH = 200


def _lookup(values: dict):
    return F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), F.col("kind"))


def matches(docs: DataFrame) -> DataFrame:
    """row, doc_id, found: per kind with matches, the matches and the lengths of the text's pieces around them."""
    df = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").alias("doc_id"),
                     F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    df = df.withColumns({k: F.regexp_extract_all("text", F.lit(p), F.lit(0)) for k, p in PATTERNS.items()})
    cut = [F.struct(F.lit(k).alias("kind"), F.col(k).alias("hits"),
                    F.when(F.size(k) > 0, F.transform(F.split("text", p, -1), F.length)).alias("pieces"))
           for k, p in PATTERNS.items()]
    return df.select("row", "doc_id", F.filter(F.array(*cut), lambda x: F.size(x["hits"]) > 0).alias("found"))


def spans(found: DataFrame) -> DataFrame:
    """row, kind, start, stop of all strong spans and weak parts that give way to nothing."""
    each = (found.select("row", F.explode("found").alias("f"))
            .select("row", F.col("f.kind").alias("kind"), F.posexplode(F.arrays_zip("f.hits", "f.pieces")).alias("nth", "z"))
            .select("row", "kind", "nth", F.col("z.hits").alias("hit"), F.col("z.pieces").alias("piece"))
            .where("hit is not null"))
    upto = Window.partitionBy("row", "kind").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    size = F.length("hit")
    each = each.withColumn("stop", F.sum(F.col("piece") + size).over(upto)).withColumn("start", F.col("stop") - size)
    short = (F.col("kind") == "access") & (size < 20)
    sound = (F.when(F.col("kind") == "assign", F.length(F.regexp_extract("hit", ASSIGN, 2)) >= 6)
             .when(F.col("kind") == "access", size >= 8)
             .when(F.col("kind") == "secret", F.rlike("hit", F.lit("[0-9]")) & F.rlike("hit", F.lit("[A-Za-z]")))
             .otherwise(True))
    each = each.where(sound).select("row", F.when(short, "id").otherwise(F.col("kind")).alias("kind"), "start", "stop")
    each = each.withColumn("rank", _lookup(RANK))
    order = Window.partitionBy("row").orderBy("start", "stop", "kind")
    before, behind = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)
    clash = F.lit(False)
    for r in (1, 2, 3):
        better = F.col("rank") < r
        clash = F.when(F.col("rank") == r, F.coalesce(F.max(F.when(better, F.col("stop"))).over(before) > F.col("start"), F.lit(False))
                       | F.coalesce(F.min(F.when(better, F.col("start"))).over(behind) < F.col("stop"), F.lit(False))).otherwise(clash)
    return each.withColumn("clash", clash).where(~F.col("clash")).select("row", "kind", "start", "stop")


def linked(parts: DataFrame) -> DataFrame:
    """The weak parts near a part of another role."""
    parts = parts.withColumn("role", _lookup(ROLE)).withColumn("bin", F.floor(F.col("start") / REACH))
    ends = parts.groupBy("row", "bin", "role").agg(F.min("start").alias("first"), F.max("start").alias("last")) \
        .select(F.col("row").alias("row2"), F.col("bin").alias("bin2"), F.col("role").alias("role2"), "first", "last")
    weak = parts.where(~F.col("kind").isin(STRONG)).withColumn("near", F.explode(F.array(*[F.col("bin") + i for i in (-1, 0, 1)])))
    close = ((F.col("bin2") == F.col("bin"))
             | (F.col("bin2") < F.col("bin")) & (F.col("start") - F.col("last") <= REACH)
             | (F.col("bin2") > F.col("bin")) & (F.col("first") - F.col("start") <= REACH))
    met = weak.join(ends, (F.col("row") == F.col("row2")) & (F.col("near") == F.col("bin2"))
                    & (F.col("role") != F.col("role2")) & close, "left_semi")
    return met.select("row", "kind", "start", "stop").distinct()


def scan(docs: DataFrame) -> DataFrame:
    """row, doc_id, spans: array of struct(start, nth kind, kind, stop) in order."""
    found = stage(matches(docs), "matches")
    parts = stage(spans(found), "spans")
    told = parts.where(F.col("kind").isin(STRONG)).unionByName(linked(parts))
    nth = _lookup({k: i for i, k in enumerate(KINDS)})
    per = told.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", nth.alias("nth"), "kind", "stop"))).alias("spans"))
    empty = F.array().cast("array<struct<start:bigint,nth:int,kind:string,stop:bigint>>")
    return found.select("row", "doc_id").join(per, "row", "left").select("row", "doc_id", F.coalesce("spans", empty).alias("spans"))


def digest(docs: DataFrame) -> DataFrame:
    of = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    text = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"),
                                                                        s["stop"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["nth"] < len(STRONG))
    return scan(docs).select("doc_id", of("assign").alias("n_assign"), of("access").alias("n_access"), of("hex").alias("n_hex"),
                             F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))
