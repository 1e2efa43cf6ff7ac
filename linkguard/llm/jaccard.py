"""N-gram Jaccard join with a token-group matrix, exact, and its connected components.

A document is its set of distinct word shingles; two documents link when 100 * |x and y| >= percent * |x or y|.

1. Counts. An exchange of shingle keys (see parts.py) tells each document how many others have each of its shingles, as a
   power of two. A document of which fewer than `percent` of the shingles occur elsewhere links with nothing and goes no
   further; that is most of a corpus. Equal sets are one class from here on.
2. Groups. Shingles are put in one order for all, rare ones first. If two sets link, they share a shingle within the first
   |x| - ceil(percent * |x|) + 1 of each. Each such prefix shingle names as hub the class that holds it with the largest
   share of repeated shingles. A class that links with the hub of its rarest repeated shingle joins its group, and then with
   the hubs of its other prefix shingles where these lie in other groups. So copies gather in a group of which no two members
   have to be compared.
3. Outside. A second exchange tells each class which of its shingles occur in another group, and in how many. Shingles of one
   group alone cannot link groups, so a class of which fewer than `percent` of the shingles occur in other groups goes no
   further. The others are put in a new order, by the number of groups: what a whole family of copies shares is rare now, and
   what makes two families alike comes last.
4. Matrix. It holds the union of the prefix shingles of each group (in blocks of classes), with the sizes and places they occur
   at. The first shingle that two linked sets share lies at places i and j with i + j <= (100 - percent) / percent * overlap,
   as what precedes it in one set is missing in the other. So a class probes the matrix only with shingles at half that depth,
   and the row bounds the overlap by sizes and places: only groups that can reach the needed overlap are opened.
5. Opening. Members of an opened block are compared exactly if the query's overlap with the union of the block's shingles
   reaches what the smallest fitting member needs; one link to a block is enough, as its members are linked already. The
   queries of a block are dealt out in chunks, so a hub or block that very many classes ask is read by many tasks.

Pairs within a group are never made, and nothing is capped: whatever the groups do not link, the matrix finds.

Defined results: empty and null texts have no shingles and link with nothing; so do rows with a null doc_id, whose component
is null. A document with fewer words than a shingle has its whole word sequence as its one shingle. Repeated rows are equal
sets and link. Extra input columns are ignored by `link`; `keep_one` keeps the columns it got, whatever their names. A text is one
unit of work, however long. Sets are compared by 64-bit hashes of shingles, equal sets by 128 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import parts, texthash
from .common import stage
from .components import components

SHINGLE, PERCENT = 4, 85
#: Classes per block of a group, and queries that are compared with a block at once (at least as many as it has members).
BLOCK, CHUNK = 256, 64
#: Bytes of shingle keys in a part of the second exchange.
CLASS_BYTES = 2 << 20


def needed(x, y, percent: int):
    """Least overlap with which sets of these sizes link, as a fraction."""
    return percent * (x + y) / (100.0 + percent)


class _Part:
    """Distinct shingles of each document of a part, the same in each pass."""

    def __init__(self, blob: bytes, size: int):
        self.table = parts.in_order(blob)
        raw, offs = texthash.joined(self.table.column("text"))
        buf = texthash.FOLD[raw]
        start, end, first = texthash.words(buf, offs)
        h = texthash.word_hashes(buf, start, end)
        owner = np.repeat(np.arange(len(offs) - 1), np.diff(first))
        ok = texthash.inside(first, size)
        keys, docs = [texthash.windows(h, size)[ok]], [owner[:len(ok)][ok]]
        for k in range(1, size):  # documents with fewer words than a shingle
            short = first[:-1][np.diff(first) == k]
            if len(short):
                keys.append(texthash.mix(texthash.windows(h, k)[short] + np.uint64(k)))
                docs.append(owner[short])
        key, doc = np.concatenate(keys), np.concatenate(docs)
        order = np.lexsort((key, doc))
        new = parts.runs([doc[order], key[order]])
        self.key, self.doc = key[order][new], doc[order][new]
        self.first = np.searchsorted(self.doc, np.arange(len(offs)))

    def keys(self, bits: int):
        return np.unique(self.key >> np.uint64(64 - bits), return_inverse=True, return_counts=True)


def _sets(docs: DataFrame, size: int, percent: int, part_bytes: int, whole_rows: bool) -> tuple[DataFrame, DataFrame]:
    """Parts, and staged: part, row, doc_id, n, set_a, set_b, toks (shingles that occur elsewhere, rare first; null if too few)."""
    packed = parts.pack(docs, part_bytes, whole_rows)
    layout = parts.Layout(packed)
    bits, split = layout.filter_bits, layout.bucket_bits

    def count(part, blob):
        keys, _, n = _Part(blob, size).keys(bits)
        return parts.messages(part, keys, parts.bounds(keys, bits, split), extra=[n.astype(np.uint64)])

    def classify(bucket, t):
        names, sizes, keys, _, (n,), _ = parts.received(t, n_extra=1)
        order = np.argsort(keys, kind="stable")
        new = parts.runs([keys[order]])
        total = np.add.reduceat(n[order], new).astype(np.float64)
        code = np.where(total < 2, 0, np.minimum(np.log2(total), 254).astype(np.uint8))
        out = np.zeros(len(keys), np.uint8)
        out[order] = np.repeat(code, np.diff(np.append(new, len(keys))))
        return parts.answers(bucket, names, sizes, out, packed=False)

    codes = parts.ask(parts.send(packed, count), classify, "frequencies")

    def reduce(part, blob, told):
        p = _Part(blob, size)
        keys, which, _ = p.keys(bits)
        code = parts.applied(told["codes"], parts.bounds(keys, bits, split), packed=False)[which]
        n = np.diff(p.first)
        total = np.concatenate([[0], np.cumsum(code > 0)])
        shared = total[p.first[1:]] - total[p.first[:-1]]
        sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(texthash.mix(p.key * np.uint64(m)))]) for m in (3, 5)]
        a, b = (texthash.mix(s[p.first[1:]] - s[p.first[:-1]] + n.astype(np.uint64)).view(np.int64) for s in sums)
        ids = parts.doc_ids(p.table)
        live = (n > 0) & (100 * shared >= percent * n) & (ids != -(1 << 63))
        order = np.lexsort((p.key, code, p.doc))
        toks = []
        for i in range(len(n)):
            mine = order[p.first[i] + n[i] - shared[i]:p.first[i + 1]] if live[i] else None
            toks.append(None if mine is None else p.key[mine].tobytes())
        return pa.table({"part": pa.array([part] * len(n), pa.int64()), "row": pa.array(np.arange(len(n)), pa.int32()),
                         "doc_id": parts.null_ids(ids), "n": pa.array(n, pa.int64()), "set_a": pa.array(a), "set_b": pa.array(b),
                         "toks": pa.array(toks, pa.binary())})

    return packed, stage(parts.tell(packed, {"codes": codes}, reduce, "part long, row int, doc_id long, n long, set_a long, "
                                    "set_b long, toks binary"), "sets")


def _prefixes(classes: DataFrame, percent: int) -> DataFrame:
    """token, cid, n, place (in the order with shingles that occur nowhere else first), m (repeated shingles)."""
    def cut(batches):
        for b in batches:
            cid, n = b.column(0).to_numpy(), b.column(1).to_numpy()
            toks = [np.frombuffer(t, np.int64) for t in b.column(2).to_pylist()]
            m = np.array([len(t) for t in toks], np.int64)
            length = n - -(-percent * n // 100) + 1
            take = np.clip(length - (n - m), 0, m)
            at = np.repeat(np.arange(len(n)), take)
            place = np.arange(take.sum()) - np.repeat(np.cumsum(take) - take, take) + (n - m)[at]
            token = np.concatenate([t[:k] for t, k in zip(toks, take)] or [np.zeros(0, np.int64)])
            yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(cid[at]), pa.array(n[at]), pa.array(place), pa.array(m[at])],
                                             names=["token", "cid", "n", "place", "m"])

    return classes.select("cid", "n", "toks").mapInArrow(cut, "token long, cid long, n long, place long, m long")


def _star_asks(classes: DataFrame, prefix: DataFrame, group: DataFrame | None, percent: int) -> DataFrame:
    """cid, at: the hub of a class's rarest repeated shingle; with `group`, all hubs of its prefix that lie in other groups."""
    if group is not None:
        prefix = prefix.join(group, "cid")
    far = ["group"] if group is not None else []
    hubs = prefix.groupBy("token").agg(F.max(F.struct((F.col("m") / F.col("n")).alias("share"), "n", "cid", *far)).alias("h")) \
        .select("token", F.col("h.cid").alias("at"), F.col("h.n").alias("hub_n"), *[F.col("h.group").alias("there") for _ in far])
    if group is None:
        prefix = prefix.groupBy("cid").agg(F.min(F.struct("place", "token", "n")).alias("p")).select("cid", "p.n", "p.token")
    pairs = prefix.join(hubs, "token").where("cid <> at").where(100 * F.least("n", "hub_n") >= percent * F.greatest("n", "hub_n"))
    return (pairs.where("group <> there") if far else pairs).select("cid", "at").distinct()


def _groups(classes: DataFrame, stars: DataFrame) -> DataFrame:
    """cid, group of each class: the least class that its links lead to."""
    roots = components(stars.select("a", "b")).withColumnRenamed("node", "cid")
    return classes.select("cid").join(roots, "cid", "left").select("cid", F.coalesce("root", "cid").alias("group"))


def _outside(classes: DataFrame, group: DataFrame, percent: int) -> DataFrame:
    """Staged: the classes that may link with another group, with `group`, and of their shingles those that occur in another
    group, in the order of the number of groups."""
    rows = classes.join(group, "cid").select("cid", "toks", "n", "group", "d", "p", "r")
    packed = parts.gather(rows, CLASS_BYTES, "classes")
    split = parts.Layout(packed).bucket_bits

    def tokens(t):
        """Shingles, and the class that each belongs to, of a part."""
        each = [np.frombuffer(x, np.uint64) for x in t.column("toks").to_pylist()]
        return np.concatenate(each), np.repeat(np.arange(len(each)), [len(x) for x in each])

    def count(part, blob):
        t = parts.decoded(blob)
        tok, own = tokens(t)
        g = t.column("group").to_numpy()[own].astype(np.uint64)
        order = np.lexsort((g, tok))
        tok, g = tok[order], g[order]
        new = parts.runs([tok, g])
        tok, g = tok[new], g[new]
        at = parts.runs([tok])
        last = np.append(at[1:], len(tok)) - 1
        keys = tok[at]
        return parts.messages(part, keys, parts.bounds(keys, 64, split), extra=[g[at], g[last] - g[at], (last - at + 1).astype(np.uint64)])

    def classify(bucket, t):
        names, sizes, keys, _, (low, span, n), _ = parts.received(t, n_extra=3)
        order = np.argsort(keys, kind="stable")
        new = parts.runs([keys[order]])
        least, most = np.minimum.reduceat(low[order], new), np.maximum.reduceat((low + span)[order], new)
        many = np.add.reduceat(n[order], new).astype(np.float64)  # groups that lie in several parts count there again
        code = np.where(least == most, 0, np.clip(np.log2(many), 1, 254)).astype(np.uint8)
        out = np.zeros(len(keys), np.uint8)
        out[order] = np.repeat(code, np.diff(np.append(new, len(keys))))
        return parts.answers(bucket, names, sizes, out, packed=False)

    codes = parts.ask(parts.send(packed, count), classify, "groups-of-tokens")

    def reduce(part, blob, told):
        t = parts.decoded(blob)
        tok, own = tokens(t)
        keys, which = np.unique(tok, return_inverse=True)
        code = parts.applied(told["codes"], parts.bounds(keys, 64, split), packed=False)[which]
        shared = np.bincount(own[code > 0], minlength=t.num_rows)
        live = 100 * shared >= percent * t.column("n").to_numpy()
        use = (code > 0) & live[own]
        order = np.lexsort((tok[use], code[use], own[use]))
        tok, own = tok[use][order], own[use][order]
        cut = np.searchsorted(own, np.flatnonzero(live))
        t = t.filter(pa.array(live))
        return t.set_column(1, "toks", pa.array([x.tobytes() for x in np.split(tok, cut[1:])] if t.num_rows else [], pa.binary()))

    return stage(parts.tell(packed, {"codes": codes}, reduce, "cid long, toks binary, n long, group long, d long, p long, r int"),
                 "outside")


def _candidates(classes: DataFrame, prefix: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Members of blocks (cid, at), and queries that a block may link with (cid, at)."""
    sizes = classes.groupBy("group").agg(F.count("*").alias("members"))
    blocks = F.ceil(F.col("members") / BLOCK)
    placed = stage(classes.select("cid", "group").join(sizes, "group").withColumn("nth", F.pmod(F.xxhash64("cid"), blocks))
                   .select("cid", "group", F.xxhash64("group", "nth").alias("at")), "groups")
    slope, probe = (100 - percent) / percent, prefix.withColumn("rest", F.col("n") - F.col("place")).join(placed, "cid")
    matrix = probe.groupBy("token", "group", "at").agg(
        F.min("n").alias("n_min"), F.max("n").alias("n_max"), F.min("place").alias("first"), F.max("rest").alias("rest"))
    q, g = probe.where(2 * F.col("place") <= slope * F.col("rest") + 1e-6).alias("q"), matrix.alias("g")
    n, least = F.col("q.n"), F.col("g.n_min").cast("double")
    room = needed(n, F.greatest(least, percent * n / 100.0), percent) - 1e-6
    most = F.least("q.rest", "g.rest")  # bounds the overlap
    fits = (F.col("g.n_max") * 100 >= percent * n) & (F.col("g.n_min") * percent <= 100 * n) & (most >= room) \
        & (F.col("q.place") + F.greatest("q.place", "g.first") <= slope * most + 1e-6)
    found = q.join(g, (F.col("q.token") == F.col("g.token")) & (F.col("q.group") != F.col("g.group")) & fits)
    return placed.select("cid", "at"), stage(found.select("q.cid", "g.at").distinct(), "candidates")


def _compared(classes: DataFrame, members: DataFrame, asks: DataFrame, percent: int, name: str) -> DataFrame:
    """Links of what asks (cid, at) with members (cid, at), one for each ask that has any: a, b (classes), and the first rows
    of both classes as structs x, y."""
    sizes = members.groupBy("at").agg(F.greatest(F.count("*"), F.lit(CHUNK)).alias("size"))
    chunks = asks.groupBy("at").agg(F.count("*").alias("asked")).join(sizes, "at").select(
        "at", F.ceil(F.col("asked") / F.col("size")).alias("chunks"))
    body = classes.select("cid", "n", "toks", "d", "p", "r")
    held = members.join(chunks, "at").withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))) \
        .drop("chunks").join(body, "cid")
    queries = asks.join(chunks, "at").withColumn("chunk", F.pmod(F.xxhash64("cid"), F.col("chunks"))).drop("chunks").join(body, "cid")
    queries = queries.select(*[F.col(c).alias(f"q_{c}") for c in queries.columns])
    ends = ("cid", "d", "p", "r")

    def open_(key, left, right):
        n = right.column("n").to_numpy()
        toks = [np.frombuffer(t, np.int64) for t in right.column("toks").to_pylist()]
        every, owner = np.concatenate(toks), np.repeat(np.arange(len(toks)), [len(t) for t in toks])
        order = np.argsort(every, kind="stable")
        every, owner = every[order], owner[order]
        union, at = np.unique(every, return_index=True)
        at = np.append(at, len(every))
        a, b = [], []
        for i, (qn, t) in enumerate(zip(left.column("q_n").to_pylist(), left.column("q_toks").to_pylist())):
            fits = (100 * n >= percent * qn) & (percent * n <= 100 * qn)
            q = np.frombuffer(t, np.int64)
            place = np.searchsorted(union, q)
            known = place[(place < len(union)) & (union[np.minimum(place, len(union) - 1)] == q)]
            if not fits.any() or len(known) < needed(qn, int(n[fits].min()), percent) - 1e-6:
                continue  # the bound over the block's union
            k = at[known + 1] - at[known]
            rows = np.repeat(at[known] - (np.cumsum(k) - k), k) + np.arange(k.sum())
            both = np.bincount(owner[rows], minlength=len(n))
            ok = np.flatnonzero(100 * both >= percent * (qn + n - both))
            if len(ok):
                a.append(i)
                b.append(int(ok[0]))
        return pa.table([t.column(p + c).take(pa.array(rows, pa.int64())) for t, p, rows in ((left, "q_", a), (right, "", b))
                         for c in ends], names=[x + c for x in "xy" for c in ends])

    found = queries.groupBy("q_at", "q_chunk").cogroup(held.groupBy("at", "chunk")).applyInArrow(
        open_, ", ".join(f"{x}cid long, {x}d long, {x}p long, {x}r int" for x in "xy"))
    return stage(found.select(F.col("xcid").alias("a"), F.col("ycid").alias("b"), *[
        F.struct(*[F.col(x + c).alias(c) for c in "dpr"]).alias(x) for x in "xy"]), name)


def link(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, part_bytes: int = parts.PART_BYTES) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id."""
    return _linked(docs, size, percent, part_bytes, False)[1].select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("winner.d", "doc_id").alias("component_id"))


def _links(classes: DataFrame, percent: int) -> DataFrame:
    """x, y: first rows (d, p, r) of linked classes, enough of them to hold components together."""
    hub = lambda asks: asks.select(F.col("at").alias("cid"), "at").distinct()
    prefix = stage(_prefixes(classes, percent), "prefixes")
    asks = stage(_star_asks(classes, prefix, None, percent), "asks")
    stars = _compared(classes, hub(asks), asks, percent, "stars")
    asks = stage(_star_asks(classes, prefix, _groups(classes, stars), percent), "asks")
    stars = stars.unionByName(_compared(classes, hub(asks), asks, percent, "stars"))
    outside = _outside(classes, _groups(classes, stars), percent)
    members, asks = _candidates(outside, stage(_prefixes(outside, percent), "prefixes"), percent)
    return stars.unionByName(_compared(outside, members, asks, percent, "links")).select("x", "y")


def _linked(docs: DataFrame, size: int, percent: int, part_bytes: int, whole_rows: bool) -> tuple[DataFrame, DataFrame]:
    """Parts, and per row: part, row, doc_id, n, winner (d, p, r: the first row of its component; null if surely alone)."""
    packed, sets = _sets(docs, size, percent, part_bytes, whole_rows)
    first = F.min(F.struct(F.col("doc_id").alias("d"), F.col("part").alias("p"), F.col("row").alias("r")))
    classes = stage(sets.where("toks is not null").groupBy("set_a", "set_b").agg(
        F.first("n").alias("n"), F.first("toks").alias("toks"), first.alias("own"), F.count("*").alias("copies"))
        .select("set_a", "set_b", "n", "toks", "own", "own.*", "copies", F.monotonically_increasing_id().alias("cid")), "classes")
    # components are found between first rows, so the root of a component is its first row and nothing is gathered by component
    roots = components(_links(classes, percent).select(F.col("x").alias("a"), F.col("y").alias("b")))
    known = stage(classes.select("set_a", "set_b", "own", "copies").join(roots.withColumnRenamed("node", "own"), "own", "left")
                  .where("root is not null or copies > 1").select("set_a", "set_b", F.coalesce("root", "own").alias("winner")),
                  "components")
    plain = ["part", "row", "doc_id", "n"]
    # texts with shingles of their own meet no class; only the others need the join
    alone = sets.where("toks is null").select(*plain, F.lit(None).cast(known.schema["winner"].dataType).alias("winner"))
    rest = sets.where("toks is not null").drop("toks").join(known, ["set_a", "set_b"], "left").select(*plain, "winner")
    return packed, alone.unionByName(rest)


def digest(docs: DataFrame) -> DataFrame:
    return link(docs).select("doc_id", "n_shingles", "component_id")


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80, part_bytes: int = parts.PART_BYTES) -> DataFrame:
    """One row of each component, the one with the least doc_id (of rows that share it, any); columns as they came.

    Rows without a component all stay. Near duplicates take five words and 0.8 here, as elsewhere in a pipeline. The rows
    come back out of the parts that were compared, so no text is joined with the verdicts.
    """
    packed, rows = _linked(docs, size, percent, part_bytes, True)
    gone = rows.where("winner is not null and (winner.d <> doc_id or winner.p <> part or winner.r <> row)")
    return parts.rows_back(packed, docs, gone.select("part", "row"))
