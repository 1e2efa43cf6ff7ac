"""Substring dedup over bytes with a distributed suffix sort.

Every byte starts a suffix, of which the first 400 bytes matter: they are repeated exactly if another suffix has the same
ones. Sorting all suffixes with that much text would multiply the corpus by 400, so only suffixes in doubt are sorted.

1. Anchors. The least of the 16-byte hashes in the first half of a window, leftmost if tied, is the window's anchor. Equal
   windows have their anchors at the same place, and windows that follow one another mostly share one. A run of windows with
   one anchor has two keys: the 200 bytes from the anchor on, and its whole context (all bytes of its windows).
2. An exchange of these keys (see parts.py) settles most runs. If nothing else has the 200 bytes, no window of the run is
   repeated. If another run has the same context, all are. Suffixes stay in doubt only where some but not all of the text
   around an anchor is repeated, at the edges of copies; one run of each repeated context stays in as their partner.
3. The suffixes in doubt go to buckets by splitters that are sampled from themselves: the order is by the leading eight
   bytes, then by a hash of all 400. Buckets sort them by multikey quicksort, token after token with only ties going on, and
   neighbours that agree are repeated. Splitters are whole keys, so equal suffixes never lie on two sides of a boundary and
   what has to be compared across it is settled by the splitter itself. A part sends equal suffixes once, so a passage that
   very many documents share costs a bucket one entry per part.

Defined results: null texts are empty; texts below 400 bytes lose nothing, unless the window is set smaller. All copies of
a repeat are removed, the first one too. Repeated rows, also of one doc_id, count each; extra input columns are ignored.
What is removed rests on 64 bits of hash beside the leading bytes (64 and the filter's bits for whole contexts).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import parts, texthash

WINDOW, SEED = 400, 16
#: Parts that splitters are drawn from, suffixes from each.
SAMPLE_PARTS, SAMPLE_SUFFIXES = 64, 10_000
#: Distinct suffixes, by part, that a bucket should have; it needs some 150 bytes for each.
BUCKET_SUFFIXES = 1 << 19
ALONE, SETTLED, PARTNER, OPEN = range(4)


def sliding_min(a: np.ndarray, width: int) -> np.ndarray:
    """Least of each `width` neighbours, from prefix and suffix minima of blocks."""
    n = len(a) - width + 1
    if n <= 0:
        return a[:0]
    top = np.full(-(-len(a) // width) * width, np.iinfo(a.dtype).max, a.dtype)
    top[:len(a)] = a
    grid = top.reshape(-1, width)
    left = np.minimum.accumulate(grid, axis=1).reshape(-1)
    right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(right[:n], left[width - 1:width - 1 + n])


def multikey_sort(tokens: list[np.ndarray]) -> np.ndarray:
    """Order by tokens: sort by the first, then sort only what is tied by the next, and so on."""
    order = np.argsort(tokens[0])
    tied, group = np.arange(len(order)), np.zeros(len(order), np.int64)
    for this, following in zip(tokens, tokens[1:]):
        at = order[tied]
        new = np.ones(len(tied), bool)
        new[1:] = (this[at[1:]] != this[at[:-1]]) | (group[1:] != group[:-1])
        group = np.cumsum(new)
        more = np.bincount(group)[group] > 1
        tied, group = tied[more], group[more]
        if not len(tied):
            break
        at = order[tied]
        order[tied] = at[np.lexsort((following[at], group))]
    return order


def leading(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The eight bytes from each place, as numbers that sort like them."""
    out = np.zeros(len(at), np.uint64)
    for i in range(8):
        out = (out << np.uint64(8)) | buf[np.minimum(at + i, len(buf) - 1)].astype(np.uint64)
    return out


class _Part:
    """Anchors of a part's windows, the same in each pass."""

    def __init__(self, blob: bytes, window: int, bits: int):
        self.table, self.window = parts.decoded(blob), window
        self.buf, self.offs = texthash.joined(self.table.column("text"))
        self.sums = texthash.byte_sums(self.buf)
        gram, seed = window // 2, min(SEED, window // 2)
        sizes = np.diff(self.offs) - 1
        n = np.maximum(0, sizes - window + 1)
        first = np.concatenate([[0], np.cumsum(n)])
        p = np.arange(first[-1]) + np.repeat(self.offs[:-1] - first[:-1], n)
        spots = np.arange(max(0, len(self.buf) - seed + 1))
        key = texthash.slice_hashes(self.sums, spots, spots + seed)
        key = (key & np.uint64(0xFFFFFFFF00000000)) | spots.astype(np.uint64)
        best = sliding_min(key, window - gram + 1)
        anchor = (best[p] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        run = parts.runs([anchor]) if len(p) else np.zeros(0, np.int64)
        self.lo, self.hi = p[run], p[np.append(run[1:], len(p)) - 1] if len(p) else p
        anchor = anchor[run]
        same = texthash.slice_hashes(self.sums, anchor, anchor + gram) >> np.uint64(64 - bits)
        context = texthash.slice_hashes(self.sums, self.lo, self.hi + window) ^ texthash.mix((anchor - self.lo).astype(np.uint64))
        order = np.lexsort((context, same))
        new = parts.runs([same[order], context[order]])
        self.count = np.diff(np.append(new, len(order)))
        self.rep = order[new]
        self.which = np.zeros(len(order), np.int64)
        self.which[order] = np.repeat(np.arange(len(new)), self.count)
        self.same, self.context = same[self.rep], context[self.rep]

    def state(self, told: pa.Table, bits: int, split: int) -> np.ndarray:
        return parts.applied(told, parts.bounds(self.same, bits, split), packed=False)

    def suffixes(self, state: np.ndarray):
        """Suffixes in doubt: places, sorted distinct keys (leading bytes, hash), counts, key number of each place."""
        doubt = self.rep[state >= PARTNER]
        n = self.hi[doubt] - self.lo[doubt] + 1
        first = np.concatenate([[0], np.cumsum(n)])
        p = np.arange(first[-1]) + np.repeat(self.lo[doubt] - first[:-1], n)
        a, b = leading(self.buf, p), texthash.slice_hashes(self.sums, p, p + self.window)
        order = multikey_sort([a, b])
        new = parts.runs([a[order], b[order]])
        count = np.diff(np.append(new, len(order)))
        which = np.zeros(len(order), np.int64)
        which[order] = np.repeat(np.arange(len(new)), count)
        return p, a[order[new]], b[order[new]], count, which


def _cuts(a: np.ndarray, b: np.ndarray, splitters: np.ndarray) -> np.ndarray:
    """Bounds of the buckets in sorted keys."""
    lo, hi = np.searchsorted(a, splitters[:, 0]), np.searchsorted(a, splitters[:, 0], side="right")
    inner = [int(l + np.searchsorted(b[l:h], s)) for l, h, s in zip(lo, hi, splitters[:, 1])]
    return np.array([0, *inner, len(a)])


def _splitters(packed: DataFrame, states: DataFrame, window: int, bits: int, split: int) -> np.ndarray:
    """Quantiles of the keys of sampled suffixes: of those in doubt, so that a bucket gets no more than it can sort in little
    memory, and more coarsely of all, in case that the sampled parts say little of the others."""
    chosen = [r.part for r in packed.select("part").orderBy(F.xxhash64("part")).limit(SAMPLE_PARTS).collect()]

    def draw(part, blob, told):
        p = _Part(blob, window, bits)
        _, a, b, _, _ = p.suffixes(p.state(told["states"], bits, split))
        k = min(len(a), SAMPLE_SUFFIXES)
        some = np.arange(k) * len(a) // max(1, k)
        at = np.random.RandomState(part % (1 << 31)).randint(0, max(1, len(p.buf) - window), SAMPLE_SUFFIXES // 8)
        at = at[at + window <= len(p.buf)]
        every = leading(p.buf, at), texthash.slice_hashes(p.sums, at, at + window)
        return pa.table({"n": pa.array([len(a), len(at)], pa.int64()), "doubt": pa.array([True, False]), "keys": pa.array(
            [np.stack(keys, 1).tobytes() for keys in ((a[some], b[some]), every)], pa.binary())})

    mine = F.col("part").isin(chosen)
    rows = parts.tell(packed.where(mine), {"states": states.where(mine)}, draw, "n long, doubt boolean, keys binary").collect()

    def quantiles(doubt: bool, buckets: int | None) -> np.ndarray:
        of = [(r.n, np.frombuffer(bytes(r.keys), np.uint64).reshape(-1, 2)) for r in rows if r.doubt == doubt and r.n]
        if not of:
            return np.zeros((0, 2), np.uint64)
        keys, weight = np.concatenate([k for _, k in of]), np.concatenate([np.full(len(k), n / len(k)) for n, k in of])
        order = np.lexsort((keys[:, 1], keys[:, 0]))
        upto = np.cumsum(weight[order])
        buckets = buckets or math.ceil(upto[-1] * packed.count() / len(chosen) / BUCKET_SUFFIXES)
        return keys[order][np.searchsorted(upto, np.arange(1, buckets) * upto[-1] / buckets)]

    both = np.concatenate([quantiles(True, None), quantiles(False, 1 << max(5, split - 2))])
    return np.unique(both, axis=0)


def repeats(docs: DataFrame, window: int = WINDOW, part_bytes: int = parts.PART_BYTES) -> DataFrame:
    """Per row: doc_id, n_bytes, removed (maximal ranges of byte offsets, end exclusive), kept (remaining bytes)."""
    packed = parts.pack(docs, part_bytes)
    layout = parts.Layout(packed)
    bits, split = layout.filter_bits, layout.bucket_bits

    def anchors(part, blob):
        p = _Part(blob, window, bits)
        return parts.messages(part, p.same, parts.bounds(p.same, bits, split), extra=[p.context], flags=[p.count > 1])

    def settle(bucket, t):
        names, sizes, same, owner, (context,), (again,) = parts.received(t, 1, 1)
        order = np.lexsort((owner, context, same))
        s, c, n = same[order], context[order], 1 + again[order].astype(np.int64)
        outer, inner = parts.runs([s]), parts.runs([s, c])
        long = lambda run, v: np.repeat(v, np.diff(np.append(run, len(order))))
        held, copies = long(outer, np.add.reduceat(n, outer)), long(inner, np.add.reduceat(n, inner))
        first = np.zeros(len(order), bool)
        first[inner] = True
        contexts = long(outer, np.add.reduceat(first.astype(np.int64), outer))
        state = np.select([held == 1, copies == 1, (contexts > 1) & first], [ALONE, OPEN, PARTNER], SETTLED)
        out = np.zeros(len(order), np.uint8)
        out[order] = state
        return parts.answers(bucket, names, sizes, out, packed=False)

    states = parts.ask(parts.send(packed, anchors), settle, "states")
    splitters = _splitters(packed, states, window, bits, split)

    def doubts(part, blob, told):
        p = _Part(blob, window, bits)
        _, a, b, count, _ = p.suffixes(p.state(told["states"], bits, split))
        return parts.messages(part, a, _cuts(a, b, splitters), extra=[b], flags=[count > 1])

    def sort(bucket, t):
        names, sizes, a, _, (b,), (again,) = parts.received(t, 1, 1)
        order = multikey_sort([a, b])
        new = parts.runs([a[order], b[order]])
        many = np.add.reduceat(1 + again[order].astype(np.int64), new) > 1
        out = np.zeros(len(order), bool)
        out[order] = np.repeat(many, np.diff(np.append(new, len(order))))
        return parts.answers(bucket, names, sizes, out)

    sorted_ = parts.ask(parts.tell(packed, {"states": states}, doubts, parts.ROW), sort, "suffixes")

    def remove(part, blob, told):
        p = _Part(blob, window, bits)
        state = p.state(told["states"], bits, split)
        places, a, b, _, which = p.suffixes(state)
        many = parts.applied(told["sorted"], _cuts(a, b, splitters))[which]
        edge = np.zeros(len(p.buf) + 1, np.int32)
        whole = np.isin(state, (SETTLED, PARTNER))[p.which]
        np.add.at(edge, p.lo[whole], 1)
        np.add.at(edge, p.hi[whole] + window, -1)
        np.add.at(edge, places[many], 1)
        np.add.at(edge, places[many] + window, -1)
        return _cleaned(p, np.cumsum(edge[:-1]) > 0)

    return parts.tell(packed, {"states": states, "sorted": sorted_}, remove,
                      "doc_id long, n_bytes long, removed array<array<long>>, kept binary")


def _cleaned(p: _Part, gone: np.ndarray) -> pa.Table:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))).reshape(-1, 2)
    at = np.searchsorted(edges[:, 0], p.offs)
    raw, kept, removed = p.buf.tobytes(), [], []
    for lo, hi, a, b in zip(p.offs[:-1].tolist(), (p.offs[1:] - 1).tolist(), at[:-1], at[1:]):
        cut = edges[a:b].tolist()
        removed.append([[s - lo, e - lo] for s, e in cut])
        places = [lo, *(x for c in cut for x in c), hi]
        kept.append(b"".join(raw[s:e] for s, e in zip(places[::2], places[1::2])))
    return pa.table({"doc_id": p.table.column("doc_id"), "n_bytes": pa.array(np.diff(p.offs) - 1, pa.int64()),
                     "removed": pa.array(removed, pa.list_(pa.list_(pa.int64()))), "kept": pa.array(kept, pa.binary())})


def digest(docs: DataFrame) -> DataFrame:
    size = F.aggregate("removed", F.lit(0).cast("long"), lambda n, r: n + r[1] - r[0])
    return repeats(docs).select("doc_id", "n_bytes", size.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"),
                                F.sha2("kept", 256).alias("kept_sha256"))
