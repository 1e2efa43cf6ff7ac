"""Mixing sources to target weights by systematic sampling, with DataFrame functions only.

Within a source every document has the same expected number of copies: the source's target over its size. Documents are
put in an order by size, their expected copies are summed along it, one random offset is added, and a document is emitted
once for each integer boundary that its interval crosses. The order by size makes each stretch of similar documents get
its share, so that the words taken stay near the target.

The running number of a document comes in two steps, so that a hot source never meets in one task: counts per cell
(source, size class, salt), running sums over the cells of a source, and numbering inside a cell.

Defined results: null and empty texts have size 0 and count as documents of their source; a source without words has
target 0. The null source comes last. Rows are numbered by size, doc_id and text digest, so equal rows may change places
without changing the result. Extra input columns are ignored by `plan`; `mix` keeps the columns it got.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, stage

WEIGHTS = (5, 2, 1)
MOST = 3
SALTS = 64
#: Size classes per doubling of the size.
STEPS = 8


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _uniform(*cols) -> Column:
    """A reproducible number in [0, 1) from a hash."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 52)) / F.lit(float(1 << 52))


def targets(sized: DataFrame, weights=WEIGHTS, most: float = MOST) -> DataFrame:
    """Per source: src, source_size, source_docs, target.

    target = min(most * size, level * weight) with the one level at which targets sum to all sizes. That is where sharing
    out the excess of capped sources by weight ends. Sources are capped in the order of size / weight, so running sums
    over that order give the level. This table has a row per source.
    """
    order = Window.orderBy(F.col("src").isNull(), F.col("src").cast("binary"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]),
                     (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    per = (sized.groupBy("src").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_docs"))
           .withColumn("w", w).withColumn("cap", most * F.col("source_size") / F.col("w")))
    rising = Window.orderBy("cap", F.col("src").isNull(), "src")
    up = rising.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    per = (per.withColumn("nth", F.row_number().over(rising)).withColumn("capped", F.coalesce(F.sum(most * F.col("source_size")).over(up), F.lit(0.0)))
           .withColumn("w_left", F.sum("w").over(every) - F.coalesce(F.sum("w").over(up), F.lit(0.0)))
           .withColumn("total", F.sum("source_size").over(every))
           .withColumn("level", (F.col("total") - F.col("capped")) / F.col("w_left"))
           # the level holds from the first source that it does not cap
           .withColumn("level", F.min(F.when(F.col("cap") >= F.col("level"), F.struct("nth", "level"))).over(every)["level"]))
    return per.select("src", "source_size", "source_docs", F.coalesce(
        F.least(F.lit(float(most)) * F.col("source_size"), F.col("level") * F.col("w")), F.lit(0.0)).alias("target"))


def plan(docs: DataFrame, weights=WEIGHTS, most: float = MOST, seed: int = 7) -> DataFrame:
    """Per row: doc_id, digest (of the text), src, size, source_size, target, copies."""
    text = F.col("text").cast("string")
    sized = stage(docs.select(
        F.col("doc_id").alias("doc_id"), F.xxhash64(text, F.lit(seed)).alias("digest"),
        F.col("source").cast("string").alias("src"), n_words(text).alias("size")), "sizes")
    sized = sized.withColumn("class", F.floor(F.log2(F.col("size") + 1.0) * STEPS).cast("int")) \
        .withColumn("salt", F.pmod(F.xxhash64("doc_id", "digest"), F.lit(SALTS)).cast("int"))
    goal = targets(sized, weights, most)
    before = Window.partitionBy("src").orderBy("class", "salt").rowsBetween(Window.unboundedPreceding, -1)
    cells = (sized.groupBy("src", "class", "salt").agg(F.count("*").alias("n"))
             .withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n"))
    cells = cells.join(goal, cells["src"].eqNullSafe(goal["src"])).drop(goal["src"])
    inside = Window.partitionBy("src", "class", "salt").orderBy("size", "doc_id", "digest")
    number = sized.withColumn("k", F.row_number().over(inside))
    same = (number["src"].eqNullSafe(cells["src"]) & (number["class"] == cells["class"])
            & (number["salt"] == cells["salt"]))
    joined = number.join(cells, same).drop(cells["src"], cells["class"], cells["salt"])
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    offset = _uniform(F.coalesce("src", F.lit("")), F.col("src").isNull(), F.lit(seed))
    upto = F.col("before") + F.col("k")
    copies = F.floor(rate * upto + offset) - F.floor(rate * (upto - 1) + offset)
    return joined.select("doc_id", "digest", "src", "size", "source_size", "target",
                         F.least(copies, F.lit(int(most))).alias("copies"))


def digest(docs: DataFrame) -> DataFrame:
    return plan(docs).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"),
                             "copies")


def mix(docs: DataFrame, weights=WEIGHTS, most: float = MOST, seed: int = 7) -> DataFrame:
    """The documents of the mix, each as often as it is taken, columns as they came.

    Rows that agree in doc_id, source and text are told apart by nothing; their copies are summed and dealt out evenly.
    """
    text, names = F.col("text").cast("string"), docs.columns
    taken = (plan(docs, weights, most, seed).groupBy("doc_id", "digest", "src")
             .agg(F.sum("copies").alias("_copies"), F.count("*").alias("_rows")).where("_copies > 0")
             .select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"), F.col("src").alias("_src"),
                     "_copies", "_rows"))
    left = docs.withColumn("_digest0", F.xxhash64(text, F.lit(seed)))
    same = (left["_digest0"] == taken["_digest"]) & left["doc_id"].eqNullSafe(taken["_id"]) \
        & left["source"].cast("string").eqNullSafe(taken["_src"])
    joined = left.join(taken, same)
    number = Window.partitionBy("_id", "_digest", "_src").orderBy(*[F.col(c) for c in names if c != "text"])
    each = F.when(F.col("_rows") == 1, F.lit(1)).otherwise(F.row_number().over(number))
    times = F.floor((F.col("_copies") * each).cast("double") / F.col("_rows")) \
        - F.floor((F.col("_copies") * (each - 1)).cast("double") / F.col("_rows"))
    return (joined.withColumn("_times", times.cast("int")).where("_times > 0")
            .withColumn("_each", F.explode(F.sequence(F.lit(1), F.col("_times")))).select(*names))
