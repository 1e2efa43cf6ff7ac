"""Periodic run detection by recursive frequency splitting and a lag scan, and collapsing of the runs.

A run is a stretch of consecutive words of one text with smallest period q (words q apart are identical) and a length of at
least max(min_length, 2q) that no neighbouring word extends. Every word of a run occurs in it at least twice.

1. Numbering. The words of a slice of texts become integers by a dictionary of their bytes, so equal numbers are equal words.
2. Splitting. A word that occurs once in its segment belongs to no run in it and cuts the segment in two; pieces shorter than
   min_length go. A text is the first segment, all texts of a slice are split at once, and each piece that remains is split
   again, looking from both ends inwards, until every word left has a partner in its piece. Ordinary text vanishes here.
3. Lag scan. For each lag q up to half a surviving segment, blocks of about q/2 words at every place that is a multiple of
   the block size are compared with the blocks q words on, by rolling hashes. A run of period q holds such a block whole, so
   n/q comparisons a lag find all of them, n log n for all lags. What agrees is compared word by word and extended to the
   maximal stretch; a stretch found at a smaller lag before has that smaller period and is the same run.

Defined results: null, empty and word-free texts have no words, no runs and an empty collapsed text. Repeated rows each give a
row. A text is one unit of work, however long; slices hold SLICE_BYTES of text or one longer text. Extra input columns are
ignored by `digest`; `collapse` keeps the columns it got and leaves texts without runs as they came, null included.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import texthash
from .common import slices

#: Fewest words of a run.
MIN_LENGTH = 12
#: Bytes of text whose words are numbered and split together.
SLICE_BYTES = 2 << 20
#: Rounds in which all texts of a slice are split at once, before the pieces that remain are split one by one.
ROUNDS = 3


def numbered(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """A number per word (equal words have equal ones), the first word of each text and the end, and the words by number."""
    buf, offs = texthash.joined(texts)
    start, end, first = texthash.words(buf, offs)
    inside = np.zeros(len(buf) + 1, np.int8)
    inside[start] += 1
    inside[end] -= 1
    data = buf[np.cumsum(inside[:-1], dtype=np.int8) > 0]
    ends = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(ends), pa.py_buffer(data)])
    coded = words.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), first, coded.dictionary


def _partners(word: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of the word before and after with the same number in the same text; -1 and the number of words if there is none."""
    n = len(word)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((word, text))  # stable, so places ascend among equals
    same = (word[order][1:] == word[order][:-1]) & (text[order][1:] == text[order][:-1])
    before, after = np.full(n, -1, np.int64), np.full(n, n, np.int64)
    before[order[1:][same]] = order[:-1][same]
    after[order[:-1][same]] = order[1:][same]
    return before, after


def _split_once(lo: np.ndarray, hi: np.ndarray, before: np.ndarray, after: np.ndarray, least: int):
    """Pieces of segments after all words without a partner in their segment have cut them; which of them may be cut again."""
    size = hi - lo
    at = np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(size.sum())
    own = np.repeat(np.arange(len(lo)), size)
    alone = (before[at] < lo[own]) & (after[at] >= hi[own])
    cut = np.bincount(own[alone], minlength=len(lo)) > 0
    at, own = at[~alone], own[~alone]
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at) != 1) | (np.diff(own) != 0)
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(at))
    long = end - begin >= least
    begin, end = begin[long], end[long]
    return at[begin], at[end - 1] + 1 if len(end) else end, cut[own[begin]]


def _first(flags: np.ndarray) -> int:
    """Place of the first true flag, or -1."""
    i = int(flags.argmax()) if len(flags) else 0
    return i if len(flags) and flags[i] else -1


def _cut_place(lo: int, hi: int, before: np.ndarray, after: np.ndarray) -> int:
    """A word without a partner in the segment, the search going inwards from both ends; -1 if every word has one."""
    done, step = 0, 64
    half = (hi - lo + 1) // 2
    while done < half:
        upto = min(half, done + step)
        i = _first((before[lo + done:lo + upto] < lo) & (after[lo + done:lo + upto] >= hi))
        if i >= 0:
            return lo + done + i
        a, b = hi - upto, hi - done
        i = _first(((before[a:b] < lo) & (after[a:b] >= hi))[::-1])
        if i >= 0:
            return b - 1 - i
        done, step = upto, step * 2
    return -1


def segments(word: np.ndarray, first: np.ndarray, least: int = MIN_LENGTH) -> list[tuple[int, int]]:
    """Stable segments of all texts: every word in one occurs in it at least twice."""
    before, after = _partners(word, first)
    lo, hi, open_ = first[:-1], first[1:], np.ones(len(first) - 1, bool)
    keep = hi - lo >= least
    lo, hi, open_ = lo[keep], hi[keep], open_[keep]
    done = []
    for _ in range(ROUNDS):
        if not len(lo):
            break
        lo, hi, open_ = _split_once(lo, hi, before, after, least)
        done += zip(lo[~open_].tolist(), hi[~open_].tolist())
        lo, hi = lo[open_], hi[open_]
    stack = list(zip(lo.tolist(), hi.tolist()))
    while stack:  # cost of a cut is the size of the smaller piece, so n log n in all
        a, b = stack.pop()
        at = _cut_place(a, b, before, after)
        if at < 0:
            done.append((a, b))
        else:
            stack += [(x, y) for x, y in ((a, at), (at + 1, b)) if y - x >= least]
    return sorted(done)


def _extent(w: np.ndarray, at: int, lag: int) -> tuple[int, int]:
    """The maximal stretch of places around `at` whose words equal those `lag` on."""
    lo, step = at, 64
    while lo > 0:
        a = max(0, lo - step)
        i = _first((w[a:lo] != w[a + lag:lo + lag])[::-1])
        if i >= 0:
            lo -= i
            break
        lo, step = a, step * 2
    hi, step, end = at, 64, len(w) - lag
    while hi < end:
        b = min(end, hi + step)
        i = _first(w[hi:b] != w[hi + lag:b + lag])
        if i >= 0:
            hi += i
            break
        hi, step = b, step * 2
    return lo, hi


class _Scan:
    """Runs of one segment by ascending lag."""

    BASE = 0x9E3779B97F4A7C15

    def __init__(self, w: np.ndarray, least: int):
        self.w, self.least, self.n = w, least, len(w)
        self.powers = texthash.powers(self.BASE, self.n + 1)
        values = texthash.mix(w.astype(np.uint64) + np.uint64(1))
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * self.powers[:self.n])])
        self.found: dict[tuple[int, int], int] = {}
        # per word, period and end of the run that was found last over it
        self.period, self.until = np.ones(self.n, np.int64), np.zeros(self.n, np.int64)

    def block(self, lag):
        """Words per compared block: any run of this period holds an aligned one in its matches."""
        need = np.maximum(self.least - lag, lag)
        return (need + 1) // 2

    def agree(self, at, lag, size):
        """Which blocks look equal to those `lag` words on and are not inside a run that is known to have this period."""
        a, b = self.sums[at + size] - self.sums[at], self.sums[at + lag + size] - self.sums[at + lag]
        ok = a * self.powers[lag] == b
        return ok & ~((lag % self.period[at] == 0) & (self.until[at] >= at + lag + size))

    def take(self, lag: int, places: np.ndarray) -> None:
        """Extend what agrees at one lag, places ascending."""
        done = -1
        size = int(self.block(lag))
        for at in places.tolist():
            if at < done or lag % self.period[at] == 0 and self.until[at] >= at + lag + size:
                continue
            if not np.array_equal(self.w[at:at + size], self.w[at + lag:at + lag + size]):
                continue  # a chance agreement
            lo, hi = _extent(self.w, at, lag)
            done = hi
            if hi - lo >= max(self.least - lag, lag) and (lo, hi + lag) not in self.found:
                self.found[lo, hi + lag] = lag
                self.period[lo:hi + lag], self.until[lo:hi + lag] = lag, hi + lag

    def runs(self) -> list[tuple[int, int, int]]:
        """(start, length, period)."""
        n, top = self.n, self.n // 2
        turn = min(top, int(n ** 0.5) + 1)
        for lag in range(1, turn + 1):
            size = int(self.block(lag))
            at = np.arange(0, n - lag - size + 1, size)
            at = at[self.agree(at, lag, size)] if len(at) else at
            if len(at):
                self.take(lag, at)
        # beyond, few blocks a lag: one step per block number over all lags
        lags = np.arange(turn + 1, top + 1)
        sizes = self.block(lags)
        some = []
        k = 0
        while len(lags):
            at = k * sizes
            fits = at + sizes + lags <= n
            lags, sizes, at = lags[fits], sizes[fits], at[fits]
            ok = self.agree(at, lags, sizes)
            some.append((lags[ok], at[ok]))
            k += 1
        if some:
            lag, at = (np.concatenate(x) for x in zip(*some))
            order = np.lexsort((at, lag))
            lag, at = lag[order], at[order]
            cuts = np.flatnonzero(np.diff(lag)) + 1
            for places, which in zip(np.split(at, cuts), np.split(lag, cuts)):
                if len(which):
                    self.take(int(which[0]), places)
        return [(lo, hi - lo, q) for (lo, hi), q in self.found.items()]


def find_runs(word: np.ndarray, first: np.ndarray, least: int = MIN_LENGTH) -> list[list[tuple[int, int, int]]]:
    """Per text: its runs (start as word number in the text, length, period), by start and period."""
    out: list[list] = [[] for _ in range(len(first) - 1)]
    found = segments(word, first, least)
    own = np.searchsorted(first, [lo for lo, _ in found], side="right") - 1
    for (lo, hi), i in zip(found, own.tolist()):
        out[i] += [(lo + s - int(first[i]), length, q) for s, length, q in _Scan(word[lo:hi], least).runs()]
    return [sorted(r, key=lambda x: (x[0], x[2])) for r in out]


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Flag per word: in no run behind that run's first period."""
    edge = np.zeros(n + 1, np.int64)
    for start, length, q in runs:
        edge[start + q] += 1
        edge[start + length] -= 1
    return np.cumsum(edge[:-1]) == 0


def _each(texts: pa.Array, least: int):
    """Per text: number of words, runs, kept words joined by single spaces."""
    for lo, hi in slices(texts, SLICE_BYTES):
        part = texts.slice(lo, hi - lo)
        word, first, _ = numbered(part)
        for i, runs in enumerate(find_runs(word, first, least)):
            n = int(first[i + 1] - first[i])
            words = (part[i].as_py() or "").encode("utf-8", "surrogatepass").split() if n else []
            if runs:
                words = [words[j] for j in np.flatnonzero(kept_words(n, runs)).tolist()]
            yield n, runs, b" ".join(words)


def longest(runs: list[tuple[int, int, int]]) -> tuple:
    """start, length, period, 1000 * length / period of the longest run; ties go to the smallest start, then period."""
    if not runs:
        return None, None, None, None
    start, length, q = min(runs, key=lambda r: (-r[1], r[0], r[2]))
    return start, length, q, 1000 * length // q


def find(docs: DataFrame, least: int = MIN_LENGTH) -> DataFrame:
    """Per document: doc_id, n_words, runs (start, length, period), collapsed (words left, joined by single spaces)."""
    def scan(batches):
        for b in batches:
            rows = list(_each(b.column(1), least))
            runs = [[{"start": s, "length": n, "period": q} for s, n, q in r[1]] for r in rows]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([r[0] for r in rows], pa.int64()),
                 pa.array(runs, pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))),
                 pa.array([r[2].decode() for r in rows], pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])

    return _source(docs).mapInArrow(
        scan, "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def _source(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def collapse(docs: DataFrame, least: int = MIN_LENGTH) -> DataFrame:
    """The rows of `docs` with each run cut down to its first period; texts without a run as they came."""
    at = docs.columns.index("text")

    def apply(batches):
        for b in batches:
            old = b.column(at)
            new = [left.decode() if runs else text.as_py() for text, (_, runs, left) in zip(old, _each(old, least))]
            yield b.set_column(at, b.schema.field(at), pa.array(new, b.schema.field(at).type))

    return docs.mapInArrow(apply, docs.schema)


def digest(docs: DataFrame, least: int = MIN_LENGTH) -> DataFrame:
    """doc_id, n_runs, the longest run, and hashes of the list of runs and of the collapsed text."""
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]

    def scan(batches):
        for b in batches:
            out = [[] for _ in names[1:]]
            for _, runs, left in _each(b.column(1), least):
                lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()
                row = (len(runs), *longest(runs), hashlib.sha256(lines).hexdigest(), hashlib.sha256(left).hexdigest())
                for col, v in zip(out, row):
                    col.append(v)
            kinds = [pa.int64()] * 5 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(out, kinds))], names=names)

    return _source(docs).mapInArrow(scan, "doc_id long, n_runs long, start long, length long, period long, "
                                    "exponent_milli long, runs_sha256 string, collapsed_sha256 string")


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """doc_id and text, with the texts that the query's rule makes periodic from some word on (no others change)."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all("text", F.lit("([^\\x20\\x09-\\x0D]+)"), F.lit(1))
    parts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    chosen = (h % 10 == 0) & F.rlike("text", F.lit("[^\\x20\\x09-\\x0D]"))
    rows = parts.withColumn("w", F.when(chosen, words)).withColumn("n", F.size("w")) \
        .withColumn("a", (g % F.col("n")).cast("int")) \
        .withColumn("p", (F.lit(1) + F.floor((F.col("n") - F.col("a")) / (3 + g % 8))).cast("int"))
    turned = F.expr("array_join(transform(sequence(0, n - 1), i -> w[if(i >= a, a + (i - a) % p, i)]), ' ')")
    return rows.select("doc_id", F.when(F.col("w").isNotNull(), turned).otherwise(F.col("text")).alias("text"))
