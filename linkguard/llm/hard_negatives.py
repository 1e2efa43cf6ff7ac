"""Hard-negative mining for (anchor, positive) pairs by a secondary-sort shuffle.

For an anchor, the best rows of its own label are its positives. A hard negative of a pair has another label and a score within
a window below the positive's: low * positive <= 100 * negative <= high * positive.

1. Scores. Blocks of anchors meet ranges of rows, one task each, and give integer inner products as one matrix. Of its own label
   an anchor can only use a range's best few rows, and these come first; the true positives of an anchor are merged from them.
2. Windows. The positives' scores go back to the anchor blocks. Of other labels a range can only contribute its best few rows in
   each window, so a range sends at most positives * (1 + negatives) pairs for an anchor, whatever the number of rows.
3. Secondary sort. Each pair is packed into one binary key (anchor, descending score, positives first, id) whose byte order is
   the order of the stream. The shuffle deals keys by anchor and sorts within the partitions (the DataFrame form of
   repartitionAndSortWithinPartitions). A streaming iterator reads the sorted keys: an anchor opens, each positive opens a window,
   and a negative goes to every open window that it fits and that is not full. Only open windows are held, never an anchor's rows.

Defined results: rows with a null id, label or vector, or a null or non-finite component, take no part. A vector with fewer
components counts as filled up with zeros. Ties go to the smaller id. Rows that share the anchor's id are not its candidates;
repeated rows are an anchor or a candidate each. A positive score below zero has no window, of zero the rows with score zero.
Scores must fit in 63 bits. An empty table gives an empty result. Extra input columns are ignored.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

POSITIVES, NEGATIVES = 5, 10
#: The window, in hundredths of the positive's score.
LOW, HIGH = 30, 90
#: Rows per block, blocks per range, anchors per block of anchors.
BLOCK, RANGE, ANCHORS = 1024, 64, 256
_TOP = 1 << 63


def quantised(vectors: DataFrame, scale: float, label: Column) -> DataFrame:
    """id, label, v (array of long): floor(scale * x) of each component."""
    e = F.col("embedding").cast("array<double>")
    sound = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & e.isNotNull() & sound)
            .select(F.col("vec_id").cast("long").alias("id"), label.cast("long").alias("label"),
                    F.transform(e, lambda x: F.floor(scale * x)).alias("v")))


def _blocks(vecs: DataFrame, size: int) -> DataFrame:
    """block, ids, labels and matrix as bytes, width; up to `size` rows each."""
    def cut(batches):
        seq, part = 0, TaskContext.get().partitionId()
        for b in batches:
            for i in range(0, b.num_rows, size):
                rows = [np.asarray(r.values, np.int64) for r in b.column(2).slice(i, size)]
                m = np.zeros((len(rows), max(map(len, rows))), np.int64)
                for j, r in enumerate(rows):
                    m[j, :len(r)] = r
                cells = [np.asarray(b.column(c).slice(i, size), np.int64).tobytes() for c in (0, 1)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part << 32 | seq], pa.int64()), *(pa.array([c], pa.binary()) for c in (*cells, m.tobytes())),
                     pa.array([m.shape[1]], pa.int32())], names=["block", "ids", "labels", "m", "width"])
                seq += 1

    return vecs.mapInArrow(cut, "block long, ids binary, labels binary, m binary, width int")


def _load(t: pa.Table) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    out = []
    for block, ids, labels, m, width in zip(*(t.column(c).to_pylist() for c in ("block", "ids", "labels", "m", "width"))):
        ids = np.frombuffer(ids, np.int64)
        out.append((block, ids, np.frombuffer(labels, np.int64), np.frombuffer(m, np.int64).reshape(len(ids), width)))
    return out


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products; in doubles where these are exact."""
    width = max(a.shape[1], b.shape[1])
    top = max([1, *(int(np.abs(m).max()) for m in (a, b) if m.size)])
    kind = np.float64 if top * top * max(1, width) < 1 << 53 else np.int64
    wide = lambda m: np.pad(m, ((0, 0), (0, width - m.shape[1]))).astype(kind)
    return (wide(a) @ wide(b).T).astype(np.int64)


def _best(score: np.ndarray, ids: np.ndarray, fit: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best fitting rows, ties by smaller id."""
    at = np.flatnonzero(fit)
    if len(at) > k:
        at = at[score[at] >= -np.partition(-score[at], k - 1)[k - 1]]
    return at[np.lexsort((ids[at], -score[at]))[:k]]


def in_window(positive, negative, low: int, high: int):
    return (low * positive <= 100 * negative) & (100 * negative <= high * positive)


#: Anchor (block of anchors, row in it, id), then how a candidate's score falls, positives before others, id: all big-endian.
_KEY = struct.Struct(">QIQQBQ")


def packed_key(block: int, row: int, anchor: int, score: int, positive: bool, vec_id: int) -> bytes:
    """Bytes whose order is (anchor, descending score, positives first, id)."""
    return _KEY.pack(block, row, anchor + _TOP, _TOP - 1 - score, not positive, vec_id + _TOP)


def unpacked(key: bytes) -> tuple[int, int, int, int, bool, int]:
    block, row, anchor, score, other, vec_id = _KEY.unpack(key)
    return block, row, anchor - _TOP, _TOP - 1 - score, not other, vec_id - _TOP


def windows(keys, n_positives: int, n_negatives: int, low: int, high: int):
    """(anchor, positive, rank, negative, positive score, negative score) from keys in order; an iterator over an iterator."""
    anchor, open_, found = None, [], 0  # open_: [positive id, score, negatives so far]
    for key in keys:
        block, row, anchor_id, score, positive, vec_id = unpacked(key)
        if (block, row) != anchor:
            anchor, open_, found = (block, row), [], 0
        if positive:
            if found < n_positives:
                found += 1
                open_.append([vec_id, score, 0])
            continue
        for w in open_:
            if w[2] < n_negatives and in_window(w[1], score, low, high):
                w[2] += 1
                yield anchor_id, w[0], w[2], vec_id, w[1], score
        # scores only fall: a full window, or one that the scores have passed, is shut
        open_ = [w for w in open_ if w[2] < n_negatives and low * w[1] <= 100 * score]


def mine(vecs: DataFrame, is_anchor: Column, n_positives: int = POSITIVES, n_negatives: int = NEGATIVES, low: int = LOW,
         high: int = HIGH) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for each row of vecs (id, label, v) that
    is_anchor holds for, against all rows."""
    index = stage(_blocks(vecs, BLOCK), "rows")
    asked = stage(_blocks(vecs.where(is_anchor), ANCHORS), "anchors")
    n = max(1, -(-index.count() // RANGE))
    number = asked.select("block", (F.row_number().over(Window.orderBy("block")) - 1).alias("nth"))
    # every range of rows meets every block of the stated anchors: these are counted blocks, not pairs of rows
    right = index.withColumn("range", F.pmod(F.xxhash64("block"), F.lit(n)).cast("int")) \
        .withColumn("nth", F.explode(F.sequence(F.lit(0), F.lit(max(1, asked.count()) - 1))))

    def meet(job, left, schema):
        def run(key, a, b):
            return job(_load(a), _load(b), a)
        left = left.join(number, "block").withColumn("range", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
        return left.groupBy("range", "nth").cogroup(right.groupBy("range", "nth")).applyInArrow(run, schema)

    def positives(anchors, rows, _):
        out = [[] for _ in range(4)]
        for block, aid, alabel, am in anchors:
            for _, ids, labels, m in rows:
                score = _scores(am, m)
                for i in range(len(aid)):
                    best = _best(score[i], ids, (labels == alabel[i]) & (ids != aid[i]), n_positives)
                    for col, v in zip(out, (np.full(len(best), block), np.full(len(best), i), score[i][best], ids[best])):
                        col.append(v)
        return pa.table({c: pa.array(np.concatenate(v) if v else [], pa.int64())
                         for c, v in zip(("block", "row", "score", "id"), out)})

    near = meet(positives, asked, "block long, row long, score long, id long")
    # at most n_positives a block of rows for an anchor; sorting them keeps only the first
    nth = F.row_number().over(Window.partitionBy("block", "row").orderBy(F.desc("score"), "id"))
    top = stage(near.withColumn("nth", nth).where(F.col("nth") <= n_positives).select("block", "row", "score", "id"), "positives")
    told = top.groupBy("block").agg(F.collect_list(F.struct("row", "score")).alias("positives"))  # ANCHORS * n_positives at most

    def negatives(anchors, rows, table):
        keys = []
        scores_of = dict(zip(table.column("block").to_pylist(), table.column("positives").to_pylist()))
        for block, aid, alabel, am in anchors:
            wanted: dict[int, set] = {}
            for p in scores_of[block] or ():
                wanted.setdefault(p["row"], set()).add(p["score"])
            for _, ids, labels, m in rows if wanted else ():
                score = _scores(am, m)
                for i, floors in wanted.items():
                    other, pick = (labels != alabel[i]) & (ids != aid[i]), set()
                    for p in floors:
                        pick.update(_best(score[i], ids, other & in_window(p, score[i], low, high), n_negatives).tolist())
                    keys += [packed_key(block, i, int(aid[i]), int(score[i][j]), False, int(ids[j])) for j in pick]
        return pa.table({"key": pa.array(keys, pa.binary())})

    hard = meet(negatives, asked.join(told, "block"), "key binary")

    def keyed(batches):
        for b in batches:
            rows = zip(*(c.to_pylist() for c in b.columns))
            yield pa.RecordBatch.from_arrays([pa.array([packed_key(k, i, a, s, True, v) for k, i, a, s, v in rows], pa.binary())],
                                             names=["key"])

    names = asked.select("block", "ids").mapInArrow(_anchor_ids, "block long, row long, anchor long")
    mine_ = top.join(names, ["block", "row"]).select("block", "row", "anchor", "score", "id").mapInArrow(keyed, "key binary")
    dealt = hard.unionByName(mine_).withColumn("anchor", F.substring("key", 1, 12))
    ordered = dealt.repartition("anchor").sortWithinPartitions("key").select("key")

    def stream(batches):
        rows = windows((k.as_py() for b in batches for k in b.column(0)), n_positives, n_negatives, low, high)
        held = []
        for row in rows:
            held.append(row)
            if len(held) == 4096:
                yield _result(held)
                held = []
        if held:
            yield _result(held)

    return ordered.mapInArrow(stream, "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, "
                              "negative_score long")


def _anchor_ids(batches):
    for b in batches:
        for block, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            ids = np.frombuffer(ids, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), block)), pa.array(np.arange(len(ids))), pa.array(ids)],
                                             names=["block", "row", "anchor"])


def _result(rows: list[tuple]) -> pa.RecordBatch:
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    kinds = [pa.int32() if c == "rank" else pa.int64() for c in names]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def digest(embeddings: DataFrame) -> DataFrame:
    turned = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(quantised(embeddings, 256.0, turned), F.col("id") % 100 == 0)
