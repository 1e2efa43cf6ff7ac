"""Exact top-k search over dense integer vectors with block-at-a-time pruning.

Documents are put in an order in which similar vectors are neighbours: by the pivot (of a bounded sample) with the largest
inner product, then by id. Ranges of that order are blocks of a few vectors. A block keeps the largest and smallest value of
each component ("term") and its vectors (the forward index). For a query, the sum over components of query value times the
block's extreme bounds every score in the block. Blocks are scored in falling order of that bound, in steps that double, and a
query stops when the bound falls below its k-th score.

Blocks are dealt at random to groups of bounded size, and blocks of queries meet a group in one task each. Groups are searched
in rounds, each of which takes `GROWTH` times as many as all before: a round starts from the k-th scores so far and returns only
what reaches them. A random sample of the documents holds the k-th score of a rank at most `GROWTH` times k or so of them all,
so what a round returns grows with the queries and not with the number of groups.

What pruning saves depends on the data: in clusters most blocks are never scored; among vectors without structure the bound
lies above every score, and all blocks are (`share_scored` says how many).

Defined results: rows whose id or vector is null, or that hold a null or non-finite component, take no part. A vector with
fewer components counts as filled up with zeros. Equal scores go by smaller id. Rows that share the query's id are not its
candidates; two query rows with one id each get their ranks. Scores must fit in 64 bits. Extra input columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

#: Vectors per block, blocks per group, queries per query block.
BLOCK, RANGE, QUERIES = 32, 512, 4096
#: Vectors whose inner products order the documents, and groups of a round for each group before it.
PIVOTS, GROWTH = 64, 8


def quantised(vectors: DataFrame, scale: float = 64.0) -> DataFrame:
    """id, v (array of long): floor(scale * x) of each component."""
    e = F.col("embedding").cast("array<double>")
    sound = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (vectors.where(F.col("vec_id").isNotNull() & e.isNotNull() & sound)
            .select(F.col("vec_id").cast("long").alias("id"), F.transform(e, lambda x: F.floor(scale * x)).alias("v")))


def _matrix(col: pa.Array | pa.ChunkedArray) -> np.ndarray:
    rows = [np.asarray(r.values, np.int64) for r in col]
    out = np.zeros((len(rows), max((len(r) for r in rows), default=0)), np.int64)
    for i, r in enumerate(rows):
        out[i, :len(r)] = r
    return out


def _blocks(vecs: DataFrame, size: int) -> DataFrame:
    """Rows of up to `size` vectors: block, ids and matrix as bytes, width."""
    def cut(batches):
        seq, part = 0, TaskContext.get().partitionId()
        for b in batches:
            for i in range(0, b.num_rows, size):
                ids, m = np.asarray(b.column(0).slice(i, size), np.int64), _matrix(b.column(1).slice(i, size))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part << 32 | seq], pa.int64()), pa.array([ids.tobytes()], pa.binary()),
                     pa.array([m.tobytes()], pa.binary()), pa.array([m.shape[1]], pa.int32())],
                    names=["block", "ids", "m", "width"])
                seq += 1

    return vecs.mapInArrow(cut, "block long, ids binary, m binary, width int")


def _load(t: pa.Table) -> list[tuple[int, np.ndarray, np.ndarray]]:
    out = []
    for block, ids, m, width in zip(*(t.column(c).to_pylist() for c in ("block", "ids", "m", "width"))):
        ids = np.frombuffer(ids, np.int64)
        out.append((block, ids, np.frombuffer(m, np.int64).reshape(len(ids), width)))
    return out


def _wide(m: np.ndarray, width: int, kind) -> np.ndarray:
    return np.pad(m, ((0, 0), (0, width - m.shape[1]))).astype(kind)


def search_blocks(q: np.ndarray, qids: np.ndarray, blocks: list[tuple[np.ndarray, np.ndarray]], k: int, floor=None):
    """Best ids and scores per query, worst last; free places have the score `none`. Also the number of scored pairs of a query
    and a block. floor: per query a score that k candidates elsewhere reach; lower scores are of no use."""
    width = max([q.shape[1], *(m.shape[1] for _, m in blocks)])
    top = max([1, *(int(np.abs(m).max()) for m in [q, *(m for _, m in blocks)] if m.size)])
    kind = np.float64 if top * top * max(1, width) < 1 << 53 else np.int64  # doubles are exact below 2**53
    none = kind(-np.inf) if kind is np.float64 else -np.iinfo(np.int64).max  # its negative must exist
    q, data = _wide(q, width, kind), [(ids, _wide(m, width, kind)) for ids, m in blocks]
    high, low = np.array([m.max(0) for _, m in data]), np.array([m.min(0) for _, m in data])
    bound = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
    order = np.argsort(-bound, axis=1, kind="stable")
    score, best = np.full((len(q), k), none, kind), np.full((len(q), k), np.iinfo(np.int64).max)
    least = np.array([none if x is None else x for x in floor or [None] * len(q)], kind)
    done, step, scored = 0, 1, 0
    while done < len(data):
        places = order[:, done:done + step]
        row, col = np.nonzero(np.take_along_axis(bound, places, 1) >= np.maximum(score[:, -1], least)[:, None])
        if not len(row):
            break  # bounds only fall: an equal one may still hold an equal score with a smaller id
        at = places[row, col]
        by = np.argsort(at, kind="stable")
        row, at = row[by], at[by]
        scored += len(row)
        for part in np.split(np.arange(len(at)), np.flatnonzero(np.diff(at)) + 1):
            who, (ids, m) = row[part], data[at[part[0]]]
            s = q[who] @ m.T
            s[qids[who][:, None] == ids[None, :]] = none
            s[s < least[who][:, None]] = none
            some = np.flatnonzero(((s >= score[who, -1:]) & (s != none)).any(1))
            who, s = who[some], s[some]
            if not len(who):
                continue
            every = np.concatenate([score[who], s], 1)
            name = np.concatenate([best[who], np.broadcast_to(ids, s.shape)], 1)
            pick = np.lexsort((name, -every), axis=1)[:, :k]
            score[who], best[who] = np.take_along_axis(every, pick, 1), np.take_along_axis(name, pick, 1)
        done, step = done + step, step * 2
    return best, score, none, scored


def ordered(vecs: DataFrame, pivots: int = PIVOTS) -> DataFrame:
    """The rows so that similar vectors are neighbours: by pivot, then id."""
    rows = vecs.orderBy(F.xxhash64("id", "v"), "id").limit(pivots).collect()  # a bounded sample
    width = max((len(r.v) for r in rows), default=0)
    sample = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        sample[i, :len(r.v)] = r.v
    sample /= np.maximum(np.linalg.norm(sample, axis=1, keepdims=True), 1e-300)

    def nearest(batches):
        for b in batches:
            m = _matrix(b.column(1)).astype(float)
            w = min(m.shape[1], width)
            to = (m[:, :w] @ sample[:, :w].T).argmax(1) if len(sample) else np.zeros(len(m))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(to, pa.int32())], names=["id", "v", "pivot"])

    near = vecs.mapInArrow(nearest, "id long, v array<long>, pivot int")
    return near.repartitionByRange("pivot", "id").sortWithinPartitions("pivot", "id").select("id", "v")


def _rounds(n: int) -> list[int]:
    """Where each round of groups ends."""
    ends = [1]
    while ends[-1] < n:
        ends.append(min(n, ends[-1] * (GROWTH + 1)))
    return ends


def search(vecs: DataFrame, is_query: Column, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score for each row of `vecs` (id, v) that is_query holds for, against all rows."""
    index = stage(_blocks(ordered(vecs), BLOCK), "blocks")
    asked = stage(_blocks(vecs.where(is_query).repartitionByRange("id").sortWithinPartitions("id"), QUERIES), "queries")
    n, n_asked = max(1, -(-index.count() // RANGE)), max(1, asked.count())
    number = asked.select("block", (F.row_number().over(Window.orderBy("block")) - 1).alias("qblock"))
    numbered = asked.join(number, "block")
    dealt = index.withColumn("range", F.pmod(F.xxhash64("block"), F.lit(n)).cast("int"))
    w = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")

    def meet(key, a, b):
        out = [[], [], [], []]
        blocks = [(ids, m) for _, ids, m in _load(b)]
        floors = a.column("floors").to_pylist()
        for (block, qids, q), floor in zip(_load(a), floors) if blocks else ():
            known = {f["q"]: f["score"] for f in floor or ()}
            least = [known.get(block * QUERIES + i) for i in range(len(qids))]
            best, score, none, _ = search_blocks(q, qids, blocks, k, least)
            row, place = np.nonzero(score != none)
            for col, v in zip(out, (np.int64(block) * QUERIES + row, qids[row], best[row, place],
                                    score[row, place].astype(np.int64))):
                col.append(v)
        return pa.table({c: pa.array(np.concatenate(v) if v else [], pa.int64())
                         for c, v in zip(("q", "query_id", "vec_id", "score"), out)})

    found, begin = None, 0
    for end in _rounds(n):
        floors = F.lit(None).cast("array<struct<q:long,score:long>>")
        left = numbered.withColumn("floors", floors)
        if found is not None:  # the k-th scores so far, at most QUERIES for a block of queries
            kth = found.where(F.col("rank") == k).groupBy(F.expr(f"q div {QUERIES}").alias("block")).agg(
                F.collect_list(F.struct("q", "score")).alias("floors"))
            left = numbered.join(kth, "block", "left")
        # every group of the round meets every block of the stated queries: these are counted blocks, not rows
        left = left.withColumn("range", F.explode(F.sequence(F.lit(begin), F.lit(end - 1))))
        right = dealt.where((F.col("range") >= begin) & (F.col("range") < end)) \
            .withColumn("qblock", F.explode(F.sequence(F.lit(0), F.lit(n_asked - 1))))
        more = left.groupBy("range", "qblock").cogroup(right.groupBy("range", "qblock")).applyInArrow(
            meet, "q long, query_id long, vec_id long, score long")
        if found is not None:
            more = more.unionByName(found.drop("rank"))
        found, begin = more.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k), end
        if end < n:
            found = stage(found, "best")
    return found.select("query_id", "rank", "vec_id", "score")


def share_scored(vecs: DataFrame, is_query: Column, k: int = 20) -> float:
    """Share of (query, block) pairs that one group of all documents would score; for small tables."""
    blocks = [(ids, m) for _, ids, m in _load(_blocks(ordered(vecs), BLOCK).toArrow())]
    rows = vecs.where(is_query).toArrow()
    _, _, _, scored = search_blocks(_matrix(rows.column("v")), np.asarray(rows.column("id")), blocks, k)
    return scored / max(1, rows.num_rows * len(blocks))


def digest(embeddings: DataFrame) -> DataFrame:
    return search(quantised(embeddings), F.col("id") % 20 == 0)
