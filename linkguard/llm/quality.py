"""Quality classifier: histogram gradient-boosted trees over document statistics.

1. Statistics. Each whole text becomes some thirty numbers (`NAMES`), computed for a slice of texts at once in numpy: shares of
   byte classes, word shapes, repeated words and lines, entropy, and the worst stretch of 64 words, which shows junk in a part
   of a long text. The table of statistics is staged once; it is a hundredth of the text, and no text is shuffled.
2. Fit. Spark's boosted trees bin each statistic into at most BINS quantile bins and choose splits from histograms of gradients
   per node, combined over the tasks. They learn from the labels of a bounded sample of documents: at most `SAMPLE` doc_ids, the
   first by hash, so the choice depends on no layout.
3. Score. The fitted trees are flattened into arrays (feature, threshold, left, right, value) and all rows of a batch walk one
   tree at a time in numpy, one step a level.

Defined results: null and empty texts have the statistics of an empty text and get a score like any other. Labels other than 0
and 1, or with a null doc_id, are not learned from; of several labels of one document the least counts, of several rows of one
doc_id the one with the least statistics. Without labels of both kinds the score is the share of label 1 among the known ones
(0.5 if none). Repeated rows each give a row; extra input columns are ignored by `score`, and `keep_good` keeps the columns it
got. Learned thresholds decide ties (a statistic equal to a threshold goes left).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkguard.functions.trees import node_table

from . import texthash
from .common import slices, stage

#: Labelled documents that the trees are fitted on, at most.
SAMPLE = 40_000
ROUNDS, DEPTH, STEP, BINS = 30, 5, 0.2, 64
#: Documents with a score of at least this are good.
THRESHOLD = 0.3
#: Bytes of text that are measured together.
SLICE_BYTES = 2 << 20
#: Words of a stretch.
STRETCH = 64

NAMES = ["log_bytes", "log_words", "word_mean", "word_sd", "word_max", "upper", "digits", "marks", "high", "spaces", "lines",
         "entropy", "distinct_words", "top_word", "doubled_words", "distinct_lines", "line_mean", "ends_marked", "ends_twice",
         "begins_marked", "no_letter", "all_caps", "odd_words", "worst_odd", "worst_doubled", "worst_distinct", "marks_distinct"]

_CLASS = np.full(256, 5, np.uint8)  # other control bytes
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 0, 1, 2
_CLASS[33:48], _CLASS[58:65], _CLASS[91:97], _CLASS[123:127] = 3, 3, 3, 3
_CLASS[128:] = 4
_CLASS[[9, 11, 12, 32]], _CLASS[[10, 13]] = 6, 7


def _ratio(a, b):
    return a / np.maximum(b, 1)


def _most(flag_sums: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Per text the largest sum of flags over STRETCH neighbouring words, as a share; of all words where there are fewer.
    flag_sums: running sums over all words, with a zero before."""
    out = np.zeros(len(first) - 1)
    for i in range(len(out)):
        lo, hi = first[i], first[i + 1]
        k = min(STRETCH, hi - lo)
        if k:
            s = flag_sums[lo:hi + 1]
            out[i] = (s[k:] - s[:-k]).max() / k
    return out


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of NAMES for each text."""
    buf, offs = texthash.joined(texts)
    n = len(offs) - 1
    out = np.zeros((n, len(NAMES)), np.float32)
    if not n:
        return out
    put = {c: out[:, i] for i, c in enumerate(NAMES)}
    cls = _CLASS[buf]
    size = np.diff(offs) - 1.0  # without the line feed that `joined` adds
    count = {k: np.add.reduceat(cls == k, offs[:-1], dtype=np.int64) for k in range(8)}
    letters = count[0] + count[1] + count[4]
    put["log_bytes"][:] = np.log1p(size)
    put["upper"][:] = _ratio(count[1], letters)
    for name, k in (("digits", 2), ("marks", 3), ("high", 4), ("spaces", 6)):
        put[name][:] = _ratio(count[k], size)
    put["lines"][:] = _ratio(count[7] - 1, size)
    owner = np.repeat(np.arange(n, dtype=np.int64), np.diff(offs))
    hist = np.bincount(owner * 256 + buf, minlength=n * 256).reshape(n, 256)
    hist[:, 10] -= 1
    p = hist / np.maximum(size, 1)[:, None]
    put["entropy"][:] = -(p * np.log2(np.where(p > 0, p, 1))).sum(1)
    put["marks_distinct"][:] = (hist[:, _CLASS == 3] > 0).sum(1)

    start, end, first = texthash.words(buf, offs)
    words = np.diff(first).astype(np.float64)
    length = (end - start).astype(np.float64)
    text = np.repeat(np.arange(n), np.diff(first))
    per = lambda v: np.bincount(text, v, n)
    mean = _ratio(per(length), words)
    put["log_words"][:] = np.log1p(words)
    put["word_mean"][:] = mean
    put["word_sd"][:] = np.sqrt(np.maximum(_ratio(per(length ** 2), words) - mean ** 2, 0))
    some = np.flatnonzero(words)
    if len(some):
        put["word_max"][some] = np.log1p(np.maximum.reduceat(length, first[some]))
    sums = {k: np.concatenate([[0], np.cumsum(cls == k)]) for k in (0, 1, 3, 4)}
    has = {k: s[end] - s[start] for k, s in sums.items()}
    last, before = cls[end - 1] == 3, (cls[np.maximum(end - 2, 0)] == 3) & (end - start > 1)
    marked, twice, begins = last, last & before, cls[start] == 3
    no_letter, caps = (has[0] + has[1] + has[4]) == 0, (has[0] == 0) & (has[1] > 1)
    odd = twice | begins | no_letter | caps
    for name, flag in (("ends_marked", marked), ("ends_twice", twice), ("begins_marked", begins), ("no_letter", no_letter),
                       ("all_caps", caps), ("odd_words", odd)):
        put[name][:] = _ratio(per(flag), words)
    h = texthash.word_hashes(buf, start, end)
    order = np.lexsort((h, text))
    ht, hh = text[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (ht[1:] != ht[:-1]) | (hh[1:] != hh[:-1])
    at = np.flatnonzero(new)
    many = np.diff(np.append(at, len(h)))
    put["distinct_words"][:] = _ratio(np.bincount(ht[at], minlength=n), words)
    top = np.zeros(n)
    np.maximum.at(top, ht[at], many)
    put["top_word"][:] = _ratio(top, words)
    doubled, seen = np.zeros(len(h), bool), np.zeros(len(h), bool)
    doubled[1:] = (h[1:] == h[:-1]) & (text[1:] == text[:-1])
    near = np.zeros(len(h), bool)  # the same word less than STRETCH words before
    near[order[1:]] = ~new[1:] & (order[1:] - order[:-1] < STRETCH)
    put["doubled_words"][:] = _ratio(per(doubled), words)
    running = lambda f: np.concatenate([[0], np.cumsum(f)])
    put["worst_odd"][:] = _most(running(odd), first)
    put["worst_doubled"][:] = _most(running(doubled), first)
    put["worst_distinct"][:] = _most(running(near), first)

    ends = np.flatnonzero(buf == 10)
    begins_at = np.concatenate([[0], ends[:-1] + 1])
    lines = texthash.word_hashes(buf, begins_at, ends) if len(ends) else np.zeros(0, np.uint64)
    of = np.searchsorted(offs, begins_at, side="right") - 1
    filled = ends > begins_at
    of, lines, wide = of[filled], lines[filled], (ends - begins_at)[filled]
    total = np.bincount(of, minlength=n)
    order = np.lexsort((lines, of))
    new = np.ones(len(lines), bool)
    new[1:] = (of[order][1:] != of[order][:-1]) | (lines[order][1:] != lines[order][:-1])
    put["distinct_lines"][:] = _ratio(np.bincount(of[order][new], minlength=n), total)
    put["line_mean"][:] = np.log1p(_ratio(np.bincount(of, wide, n), total))
    return out


def table_of_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, stats (array of float) of each row."""
    def measure(batches):
        for b in batches:
            for lo, hi in slices(b.column(1), SLICE_BYTES):
                s = statistics(b.column(1).slice(lo, hi - lo))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo), pa.FixedSizeListArray.from_arrays(s.ravel(), len(NAMES)).cast(
                        pa.list_(pa.float32()))], names=["doc_id", "stats"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return stage(rows.mapInArrow(measure, "doc_id long, stats array<float>"), "statistics")


class Trees:
    """A fitted ensemble as flat arrays; `score` is the probability of label 1."""

    def __init__(self, nodes: list | None, fallback: float = 0.5):
        """nodes: rows of `node_table`. Each tree's nodes lie together; left and right are places in the arrays."""
        self.fallback, self.roots = fallback, None
        if not nodes:
            return
        nodes = sorted(nodes, key=lambda r: (r.tree, r.node))
        place = {(r.tree, r.node): i for i, r in enumerate(nodes)}
        inner = np.array([r.feature >= 0 for r in nodes])
        self.feature = np.array([max(r.feature, 0) for r in nodes], np.int32)
        # a leaf leads back to itself, so every row may take the same number of steps
        self.threshold = np.array([r.threshold if r.feature >= 0 else np.inf for r in nodes], np.float64)
        self.left = np.array([place[r.tree, r.left] if k else i for i, (r, k) in enumerate(zip(nodes, inner))], np.int32)
        self.right = np.array([place[r.tree, r.right] if k else i for i, (r, k) in enumerate(zip(nodes, inner))], np.int32)
        self.value = np.array([r.value * r.weight for r in nodes], np.float64)
        self.roots = np.array([place[t, 0] for t in sorted({r.tree for r in nodes})], np.int32)

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.roots is None:
            return np.full(len(x), self.fallback)
        x, row, margin = x.astype(np.float64), np.arange(len(x)), np.zeros(len(x))
        for root in self.roots:
            at = np.full(len(x), root, np.int32)
            while True:
                to = np.where(x[row, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
                if (to == at).all():
                    break
                at = to
            margin += self.value[at]
        return 1 / (1 + np.exp(-2 * margin))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(stats: DataFrame, labels: DataFrame, sample: int = SAMPLE, rounds: int = ROUNDS) -> Trees:
    """Trees from stats (doc_id, stats) and labels (doc_id, quality)."""
    spark = stats.sparkSession
    known = labels.where("doc_id is not null and quality in (0, 1)").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y"))
    share = min(1.0, 4.0 * sample / max(1, known.count()))  # what lies far above the sample's place is not even sorted
    hashed = F.xxhash64("doc_id")
    picked = known.where(hashed / 2.0 ** 64 + 0.5 <= share).groupBy("doc_id").agg(F.min("y").alias("y")) \
        .orderBy(hashed, "doc_id").limit(sample)
    picked = stage(picked, "picked")  # at most `sample` rows of 12 bytes, so broadcast is bounded by the parameter
    train = stage(stats.join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(
        F.min("stats").alias("stats"), F.first("y").cast("double").alias("label")), "train")
    n, good = train.agg(F.count("*"), F.sum("label")).first()
    if not n or good in (0, n):
        return Trees(None, good / n if n else 0.5)
    trees = GBTClassifier(maxIter=rounds, maxDepth=DEPTH, stepSize=STEP, maxBins=BINS, seed=11, maxMemoryInMB=128,
                          cacheNodeIds=False, minInstancesPerNode=5)
    model = trees.fit(train.select(array_to_vector(F.col("stats").cast("array<double>")).alias("features"), "label"))
    return Trees(node_table(spark, model).drop("impurity_stats").collect())  # a model: at most rounds * 2**(DEPTH + 1) nodes


def score_statistics(stats: DataFrame, trees: Trees) -> DataFrame:
    """doc_id, score."""
    shared = stats.sparkSession.sparkContext.broadcast(trees)

    def apply(batches):
        for b in batches:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, len(NAMES))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(shared.value.score(x))], names=["doc_id", "score"])

    return stats.mapInArrow(apply, "doc_id long, score double")


def score(docs: DataFrame, labels: DataFrame, held_out_too: bool = False) -> DataFrame:
    """doc_id, score; learns from `labels` of documents that `held_out` leaves in."""
    stats = table_of_statistics(docs)
    learn = labels if held_out_too else labels.where(~held_out(F.col("doc_id")))
    return score_statistics(stats, fit(stats, learn))


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, labels).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, trees: Trees, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs` with at least this score, columns as they came."""
    shared, at = docs.sparkSession.sparkContext.broadcast(trees), docs.columns.index("text")

    def apply(batches):
        for b in batches:
            for lo, hi in slices(b.column(at), SLICE_BYTES):
                part = b.slice(lo, hi - lo)
                yield part.filter(pa.array(shared.value.score(statistics(part.column(at))) >= threshold))

    return docs.mapInArrow(apply, docs.schema)
