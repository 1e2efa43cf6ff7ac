"""Benchmark decontamination: one Aho-Corasick automaton over the normalised benchmark, one scan of each text.

Text is normalised to lower-case words, and each distinct benchmark word to a short code of equal length (all other words of a
document share one that the benchmark lacks). The automaton's patterns are code sequences: every block of half a window at a
multiple of that size in an item, and whole items that are shorter than a window. Each window of an item holds such a block
whole, and blocks do not overlap, so the automaton has a few nodes for each benchmark word, however many windows there are, and
none has many children. A hit is extended in both directions along its item;
where the match reaches a window (or a whole short item), all its words are hit. Matches along one alignment are extended once.
Word numbers map back to code-point offsets of the original text.

The benchmark is a fixed set that does not grow with the corpus; it is broadcast, after a check of its size, and every Python
worker builds the automaton once. A benchmark of more than `BENCHMARK_BYTES` is dealt into groups of items of at most that size
(or one larger item), and the texts pass over one group after the other, so nothing is refused and memory stays bounded.

Defined results: null, empty and word-free texts have no words, no hits, and are clean. Null or word-free benchmark items
have no window. Items that share an id are one item. Extra input columns are ignored by `find`, and `keep_clean` keeps the
columns it got, whatever their names; repeated rows each give a row. A text is one unit of work, however long.
"""

from __future__ import annotations

import re
import uuid
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, stage

#: Bytes of benchmark text in one automaton, which takes some 40 times as much memory in each Python worker.
BENCHMARK_BYTES = 8 << 20
#: Bytes of text whose words are held as Python objects at once, or one longer text.
SLICE_BYTES = 1 << 20

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
_BUILT: dict[str, Automaton] = {}


def normalise(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


class Automaton:
    """All windows of `size` words of the items, as blocks to find and items to extend along."""

    def __init__(self, items: list[tuple], size: int):
        """items: (id as text, text)."""
        import ahocorasick

        self.size, self.items, self.ids = size, [], []
        texts = [normalise(text) for _, text in items]
        every = sorted({w for t in texts for w in t})
        # codes of `width` digits to the base 64; a longer code than needed would cost nodes, a larger base children
        self.width = max(1, -(-len(every).bit_length() // 6))
        self.code = {w: "".join(chr(48 + (i >> 6 * k & 63)) for k in reversed(range(self.width))) for i, w in enumerate(every)}
        self.other = "\x00" * self.width
        half = (size + 1) // 2
        places: dict[str, list] = {}
        for (item, _), words in zip(items, texts):
            words, n = [self.code[w] for w in words], len(words)
            for at in range(0, n - half + 1, half) if n >= size else [0] if n else []:
                places.setdefault("".join(words[at:at + half] if n >= size else words), []).append((len(self.items), at))
            self.items.append(words)
            self.ids.append(item)
        self.sizes, self.places = [len(p) // self.width for p in places], list(places.values())
        self.auto = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for i, p in enumerate(places):
            self.auto.add_word(p, i)
        if places:
            self.auto.make_automaton()

    def scan(self, words: list[bytes]) -> tuple[np.ndarray | None, set]:
        """Covered flag per word, ids of items with occurring windows."""
        if not self.places or not words:
            return None, set()
        text = list(map(self.code.get, words, repeat(self.other)))
        edge, found, reach, n, width = None, set(), {}, len(text), self.width
        for end, which in self.auto.iter("".join(text)):
            last, rest = divmod(end + 1, width)
            if rest:
                continue  # across codes
            last -= 1
            first = last - self.sizes[which] + 1
            for item, at in self.places[which]:
                key = (item, first - at)
                if reach.get(key, -1) >= last:
                    continue  # inside a match that was extended before
                other = self.items[item]
                lo, hi, m = first, last + 1, len(other)
                i, j = at, at + hi - first
                while lo and i and text[lo - 1] == other[i - 1]:
                    lo, i = lo - 1, i - 1
                while hi < n and j < m and text[hi] == other[j]:
                    hi, j = hi + 1, j + 1
                reach[key] = hi - 1
                if hi - lo >= min(self.size, m):
                    edge = np.zeros(n + 1, np.int64) if edge is None else edge
                    edge[lo] += 1
                    edge[hi] -= 1
                    found.add(self.ids[item])
        return (None if edge is None else np.cumsum(edge[:-1]) > 0), found


def _built(key: str, items: list[tuple], size: int) -> Automaton:
    """The automaton of a broadcast, kept while the Python worker lives."""
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = Automaton(items, size)
    return _BUILT[key]


def _spans(text: str, covered: np.ndarray) -> list[list[int]]:
    """Maximal covered word runs as code-point ranges of the original text."""
    at = [m.span() for m in _WORD.finditer(text)]
    return [[at[a][0], at[b - 1][1]] for a, b in _ranges(covered)]


def _ranges(covered: np.ndarray) -> list[list[int]]:
    """Maximal covered runs as ranges of word numbers."""
    return np.flatnonzero(np.diff(np.concatenate([[0], covered.astype(np.int8), [0]]))).reshape(-1, 2).tolist()


def _groups(benchmark: DataFrame, limit: int):
    """(key, broadcast items) for groups of items of at most `limit` bytes each, or of one larger item."""
    spark = benchmark.sparkSession
    bench = benchmark.where("text is not null").select(
        F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text"))
    sizes = bench.groupBy(F.pmod(F.xxhash64("item", "text"), F.lit(1024)).alias("cell")).agg(F.sum(F.octet_length("text")).alias("bytes"))
    cells, used, group = {}, 0, 0
    for r in sizes.orderBy("cell").collect():  # 1024 rows at most
        if used and used + r.bytes > limit:
            group, used = group + 1, 0
        cells.setdefault(group, []).append(r.cell)
        used += r.bytes
    for part in cells.values():
        rows = bench.where(F.pmod(F.xxhash64("item", "text"), F.lit(1024)).isin(part)).collect()
        yield uuid.uuid4().hex, spark.sparkContext.broadcast(sorted(tuple(r) for r in rows))


def _marked(rows: DataFrame, at: int, benchmark: DataFrame, size: int, limit: int, finish, out_schema) -> DataFrame:
    """finish(batches) of rows, whose column number `at` is the text, with three columns more: _0 (number of words), _1 (covered
    ranges of word numbers) and _2 (item ids). Between groups of a large benchmark the rows are staged, so one automaton at a
    time is in memory."""
    # positions, not names, are used in tasks, so no input column can clash
    schema = rows.select("*", F.lit(0).cast("long").alias("_0"), F.array(F.array(F.lit(0))).alias("_1"),
                         F.array(F.lit("")).alias("_2")).schema
    width, every = len(rows.columns), list(_groups(benchmark, limit))

    def scanner(key, shared, first):
        def scan(batches):
            for b in batches:
                for lo, hi in slices(b.column(at), SLICE_BYTES):
                    part = b.slice(lo, hi - lo)
                    auto = _built(key, shared.value, size) if shared is not None else None
                    n, ranges, ids = [], [], []
                    for i, text in enumerate(part.column(at).to_pylist()):
                        words = normalise(text)
                        covered, found = auto.scan(words) if auto else (None, set())
                        old = [] if first else part.column(width + 1)[i].as_py()
                        if old:
                            covered = np.zeros(len(words), bool) if covered is None else covered
                            for x, y in old:
                                covered[x:y] = True
                        n.append(len(words))
                        ranges.append([] if covered is None else _ranges(covered))
                        ids.append(sorted(found if first else found | set(part.column(width + 2)[i].as_py())))
                    yield pa.RecordBatch.from_arrays(
                        [*part.columns[:width], pa.array(n, pa.int64()), pa.array(ranges, pa.list_(pa.list_(pa.int32()))),
                         pa.array(ids, pa.list_(pa.string()))], names=schema.names)
        return scan

    for i, (key, shared) in enumerate(every[:-1]):
        rows = stage(rows.mapInArrow(scanner(key, shared, i == 0), schema), "scanned")
    last = scanner(*(every[-1] if every else ("none", None)), len(every) < 2)
    return rows.mapInArrow(lambda batches: finish(last(batches)), out_schema)


def find(docs: DataFrame, benchmark: DataFrame, size: int = 13, block_bytes: int = BENCHMARK_BYTES) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, spans (code-point ranges of covered runs), items (ids, as sorted strings)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def places(batches):
        for b in batches:
            spans, hit = [], []
            for i, ranges in enumerate(b.column(3).to_pylist()):
                hit.append(sum(y - x for x, y in ranges))
                covered = np.zeros(b.column(2)[i].as_py() if ranges else 0, bool)
                for x, y in ranges:
                    covered[x:y] = True
                spans.append(_spans(b.column(1)[i].as_py(), covered) if ranges else [])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array(hit, pa.int64()), pa.array(spans, pa.list_(pa.list_(pa.int32()))), b.column(4)],
                names=["doc_id", "n_words", "n_hit", "spans", "items"])

    return _marked(rows, 1, benchmark, size, block_bytes, places,
                   "doc_id long, n_words long, n_hit long, spans array<array<int>>, items array<string>")


def contaminated(n_hit, n_words):
    return (n_hit > 0) & (20 * n_hit >= n_words)


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return find(docs, benchmark).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"))


def keep_clean(docs: DataFrame, benchmark: DataFrame, size: int = 13, block_bytes: int = BENCHMARK_BYTES) -> DataFrame:
    """The rows of `docs` without contamination, columns as they came."""
    width, docs_names = len(docs.columns), docs.columns

    def judge(batches):
        for b in batches:
            hit = [sum(y - x for x, y in r) for r in b.column(width + 1).to_pylist()]
            keep = [not contaminated(h, n) for h, n in zip(hit, b.column(width).to_pylist())]
            yield pa.RecordBatch.from_arrays(b.columns[:width], names=docs_names).filter(pa.array(keep, pa.bool_()))

    return _marked(docs, docs.columns.index("text"), benchmark, size, block_bytes, judge, docs.schema)
