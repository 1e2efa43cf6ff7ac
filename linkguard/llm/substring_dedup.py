"""Substring dedup over words with fixed-block anchors.

The index holds non-overlapping blocks: the words 0-9, 10-19, ... of every document. Each window of 20 words holds a whole
block, so two equal windows meet where the one's block is found by the other's rolling window of 10 words. Every rolling
window probes the index; windows around hits are then extended to the exact repeats by the hash of their 20 words, and
overlapping or touching windows make the maximal runs that are removed.

Both steps are exchanges of keys between parts and buckets (see parts.py), so copies never form pairs: a bucket answers
"anchored elsewhere" in the first and "first seen elsewhere" in the second. Probes are short keys, whose chance agreements
only cost work; what is removed rests on 96 bits of hash.

Defined results: null and empty texts have no words. A null doc_id comes before all others. Rows that share a doc_id count
in the order of their texts where they lie in one part, else in the order of parts; equal rows are repeats of one another.
Extra input columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import parts, texthash

WINDOW = 20


class _Part:
    """Words and keys of a part, the same in each pass."""

    def __init__(self, blob: bytes, window: int, bits: int):
        self.table, self.window, self.block = parts.in_order(blob), window, window // 2
        self.buf, offs = texthash.joined(self.table.column("text"))
        self.start, self.end, self.first = texthash.words(self.buf, offs)
        self.hash = texthash.word_hashes(self.buf, self.start, self.end)
        self.probe_ok = texthash.inside(self.first, self.block)
        probe = texthash.windows(self.hash, self.block) >> np.uint64(64 - bits)
        self.probe, self.which, self.count = np.unique(probe[self.probe_ok], return_inverse=True, return_counts=True)

    def owner(self) -> np.ndarray:
        """Document number of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def probes(self, part: int, bits: int, bucket_bits: int) -> pa.Table:
        within = np.arange(len(self.start)) - np.repeat(self.first[:-1], np.diff(self.first))
        aligned = (within[:len(self.probe_ok)] % self.block == 0)[self.probe_ok]
        anchor = np.zeros(len(self.probe), bool)
        anchor[self.which[aligned]] = True
        return parts.messages(part, self.probe, parts.bounds(self.probe, bits, bucket_bits), flags=[anchor, self.count > 1])

    def candidates(self, hits: pa.Table, bits: int, bucket_bits: int):
        """Windows that hold an anchored block: their starts, and their keys sorted once, with the first of each."""
        at = parts.bounds(self.probe, bits, bucket_bits)
        hit = np.zeros(len(self.probe_ok) + 1, np.int64)
        hit[1:][self.probe_ok] = parts.applied(hits, at)[self.which]
        upto = np.cumsum(hit)
        ok = texthash.inside(self.first, self.window)
        n, span = len(ok), self.window - self.block + 1
        self.at = np.flatnonzero(ok & (upto[span:span + n] > upto[:n]))
        a = texthash.windows(self.hash, self.window)[self.at]
        b = texthash.windows(self.hash, self.window, seed=1)[self.at] >> np.uint64(32)
        order = np.lexsort((b, a))
        new = parts.runs([a[order], b[order]])
        self.firsts = order[new]  # the sort is stable: the first of equal windows in document order
        self.which_window = np.zeros(len(order), np.int64)
        self.which_window[order] = np.repeat(np.arange(len(new)), np.diff(np.append(new, len(order))))
        return a[self.firsts], b[self.firsts]


def repeats(docs: DataFrame, window: int = WINDOW, part_bytes: int = parts.PART_BYTES) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, removed (ranges of word numbers, end exclusive), kept (words joined by spaces)."""
    packed = parts.pack(docs, part_bytes)
    layout = parts.Layout(packed)
    bits, split = layout.filter_bits, layout.bucket_bits

    def probe(part, blob):
        return _Part(blob, window, bits).probes(part, bits, split)

    def anchored(bucket, t):
        names, sizes, keys, _, _, (anchor, again) = parts.received(t, n_flags=2)
        order = np.argsort(keys, kind="stable")
        new = parts.runs([keys[order]])
        held = np.add.reduceat(1 + again[order].astype(np.int64), new) > 1
        found = np.logical_or.reduceat(anchor[order], new) & held
        hit = np.zeros(len(keys), bool)
        hit[order] = np.repeat(found, np.diff(np.append(new, len(keys))))
        return parts.answers(bucket, names, sizes, hit)

    hits = parts.ask(parts.send(packed, probe), anchored, "anchors")

    def extend(part, blob, told):
        p = _Part(blob, window, bits)
        a, b = p.candidates(told["hits"], bits, split)
        ids = parts.doc_ids(p.table)[p.owner()[p.at[p.firsts]]]
        rising = ids.astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)  # unsigned, in the order of the ids
        return parts.messages(part, a, parts.bounds(a, 64, split), extra=[b, rising])

    def first_seen(bucket, t):
        names, sizes, keys, _, (b, ids), _ = parts.received(t, n_extra=2)
        part = np.repeat(np.array(names), sizes)
        order = np.lexsort((part, ids, b, keys))
        first = np.zeros(len(keys), bool)
        first[order[parts.runs([keys[order], b[order]])]] = True
        return parts.answers(bucket, names, sizes, first)

    firsts = parts.ask(parts.tell(packed, {"hits": hits}, extend, parts.ROW), first_seen, "firsts")

    def remove(part, blob, told):
        p = _Part(blob, window, bits)
        a, _ = p.candidates(told["hits"], bits, split)
        mine = parts.applied(told["firsts"], parts.bounds(a, 64, split))
        kept = np.zeros(len(p.at), bool)
        kept[p.firsts[mine]] = True
        edge = np.zeros(len(p.start) + 1, np.int64)
        gone_at = p.at[~kept]
        np.add.at(edge, gone_at, 1)
        np.add.at(edge, gone_at + window, -1)
        return _cleaned(p, np.cumsum(edge[:-1]) > 0)

    return parts.tell(packed, {"hits": hits, "firsts": firsts}, remove,
                      "doc_id long, n_words long, n_removed long, removed array<array<int>>, kept string")


def _cleaned(p: _Part, gone: np.ndarray) -> pa.Table:
    first, raw = p.first, p.buf.tobytes()
    total = np.concatenate([[0], np.cumsum(gone)])
    n_gone = total[first[1:]] - total[first[:-1]]
    kept, ranges = [], []
    for lo, hi, some in zip(first[:-1], first[1:], n_gone):
        if not some:
            kept.append(b" ".join(raw[p.start[lo]:p.end[hi - 1]].split()) if hi > lo else b"")
            ranges.append([])
            continue
        here = gone[lo:hi]
        ranges.append(np.flatnonzero(np.diff(np.concatenate([[0], here.astype(np.int8), [0]]))).reshape(-1, 2).tolist())
        kept.append(b" ".join(raw[s:e] for s, e in zip(p.start[lo:hi][~here].tolist(), p.end[lo:hi][~here].tolist())))
    return pa.table({
        "doc_id": parts.null_ids(parts.doc_ids(p.table)), "n_words": pa.array(np.diff(first), pa.int64()),
        "n_removed": pa.array(n_gone, pa.int64()), "removed": pa.array(ranges, pa.list_(pa.list_(pa.int32()))),
        "kept": pc.cast(pa.array(kept, pa.binary()), pa.string())})


def digest(docs: DataFrame) -> DataFrame:
    return repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept"), 256).alias("kept_sha256"))
