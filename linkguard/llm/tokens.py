"""Token ids in a binary format: Simple-8b words with escapes and per-block offsets.

A file row ("segment") holds whole documents in ascending order. Its bytes are, little-endian: the magic `LGS8`; numbers of
documents, ids, blocks, words and escapes (uint64 each); doc ids (int64); ids per document (uint64); first word of each
block (uint64); the words (uint64). A block is 256 ids, the last one shorter. The top four bits of a word select how many
ids of what width follow from the low end; the last word of a block may be filled in part. Selector 15 is an escape for an
id above 60 bits: the whole next word is the id. Segments are rows of Parquet files in the shared folder, so any store that
Spark writes to will do.

Defined results: null and empty texts give the end id alone; a null doc_id comes first and stays null. Documents are ordered
by doc_id, then by a digest of the text, so repeated rows each have their place. Extra input columns are ignored.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import texthash
from .common import stage

BLOCK = 256
MAGIC = b"LGS8"
#: (ids, bits) by selector.
PACKS = [(60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30),
         (1, 60)]
ESCAPE = 15
#: Bytes of text per segment, and distinct words that a Python worker remembers.
SEGMENT_BYTES, REMEMBER = 2 << 20, 1_000_000
_COUNT = np.array([p[0] for p in PACKS] + [0, 1])
_WIDTH = np.array([p[1] for p in PACKS] + [0, 64])
_NULL_DOC = -(1 << 63)
_SHORT_BITS = np.ceil(np.log2(np.arange(1 << 16) + 1.0)).astype(np.uint8)


def _bit_lengths(a: np.ndarray) -> np.ndarray:
    if a.max() < 1 << 16:
        return _SHORT_BITS[a]
    bits = np.zeros(a.shape, np.uint8)
    for shift in (32, 16, 8, 4, 2, 1):
        bits += ((a >> bits.astype(np.uint64)) >> np.uint64(shift) > 0).astype(np.uint8) * np.uint8(shift)
    return bits + (a > 0)


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Words, first word of each block, number of escapes."""
    n = len(ids)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), 0
    rows = -(-n // BLOCK)
    grid = np.zeros((rows, BLOCK + 64), np.uint64)  # the columns behind a block stay zero
    flat = np.zeros(rows * BLOCK, np.uint64)
    flat[:n] = ids
    grid[:, :BLOCK] = flat.reshape(rows, BLOCK)
    bits = _bit_lengths(grid)
    length = np.minimum(BLOCK, n - BLOCK * np.arange(rows))
    choice = np.full((rows, BLOCK), ESCAPE, np.uint8)
    done = np.zeros((rows, BLOCK), bool)
    most = {1: bits}
    for k in (2, 4, 8, 16, 32):
        half = most[k // 2]
        most[k] = np.maximum(half[:, :-(k // 2)], half[:, k // 2:])
    for s, (count, width) in enumerate(PACKS):
        k = 1 << (count.bit_length() - 1)
        full = most[k]
        over = full[:, :BLOCK] if k == count else np.maximum(full[:, :BLOCK], full[:, count - k:count - k + BLOCK])
        fits = (over <= width) & ~done
        choice[fits] = s
        done |= fits
    at, alive, steps = np.zeros(rows, np.int64), np.arange(rows), []
    while len(alive):
        s = choice[alive, at[alive]]
        steps.append((alive, at[alive], s))
        at[alive] += _COUNT[s]
        alive = alive[at[alive] < length[alive]]
    block = np.concatenate([x[0] for x in steps])
    pos = np.concatenate([x[1] for x in steps])
    sel = np.concatenate([x[2] for x in steps])
    order = np.lexsort((pos, block))
    block, pos, sel = block[order], pos[order], sel[order]
    place = np.concatenate([[0], np.cumsum(1 + (sel == ESCAPE))])
    out = np.zeros(place[-1], np.uint64)
    for s in np.unique(sel):
        rows_s = np.flatnonzero(sel == s)
        if s == ESCAPE:
            out[place[rows_s]] = np.uint64(ESCAPE) << np.uint64(60)
            out[place[rows_s] + 1] = grid[block[rows_s], pos[rows_s]]
            continue
        word = np.full(len(rows_s), int(s) << 60, np.uint64)
        for j in range(PACKS[s][0]):
            word |= np.where(pos[rows_s] + j < BLOCK, grid[block[rows_s], np.minimum(pos[rows_s] + j, BLOCK)], 0) \
                << np.uint64(j * PACKS[s][1])
        out[place[rows_s]] = word
    return out, place[np.searchsorted(block, np.arange(rows))].astype(np.uint64), int((sel == ESCAPE).sum())


def unpack(words: np.ndarray, starts: np.ndarray, n: int, escapes: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.uint64)
    raw = np.zeros(len(words), bool)
    if escapes:  # only then can a word be a bare id; walk all blocks at once
        at, end = starts.astype(np.int64), np.append(starts[1:], len(words)).astype(np.int64)
        alive = np.arange(len(starts))
        while len(alive):
            jump = words[at[alive]] >> np.uint64(60) == ESCAPE
            raw[at[alive[jump]] + 1] = True
            at[alive] += 1 + jump
            alive = alive[at[alive] < end[alive]]
    sel = np.where(raw, 14, words >> np.uint64(60)).astype(np.int64)
    count = np.where(sel == ESCAPE, 1, _COUNT[sel])
    first = np.cumsum(count) - count
    owner = np.repeat(np.arange(len(words)), count)
    j = (np.arange(count.sum()) - first[owner]).astype(np.uint64)
    width = np.minimum(_WIDTH[sel], 60).astype(np.uint64)
    value = words[np.minimum(owner + (sel[owner] == ESCAPE), len(words) - 1)]
    mask = np.where(sel == ESCAPE, np.uint64(0xFFFFFFFFFFFFFFFF), (np.uint64(1) << width) - np.uint64(1))
    value = (value >> (j * width[owner])) & mask[owner]
    block = np.searchsorted(starts, owner, side="right") - 1
    inside = np.arange(len(owner)) - first[starts.astype(np.int64)][block]
    return value[inside < np.minimum(BLOCK, n - BLOCK * block)]


def write_segment(docs: list, lens: np.ndarray, ids: np.ndarray) -> bytes:
    words, starts, escapes = pack(ids)
    head = np.array([len(docs), len(ids), len(starts), len(words), escapes], np.uint64)
    doc = np.array([_NULL_DOC if d is None else d for d in docs], np.int64)
    return b"".join([MAGIC, *(x.tobytes() for x in (head, doc, lens.astype(np.uint64), starts, words))])


def read_segment(data: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """Doc ids, ids per document, ids."""
    if data[:4] != MAGIC:
        raise ValueError("not a token segment")
    d, n, b, w, escapes = np.frombuffer(data, np.uint64, 5, 4).astype(int)
    parts, at = [], 44
    for size, kind in ((d, np.int64), (d, np.uint64), (b, np.uint64), (w, np.uint64)):
        parts.append(np.frombuffer(data, kind, size, at))
        at += 8 * size
    return [None if x == _NULL_DOC else int(x) for x in parts[0]], parts[1].astype(np.int64), \
        unpack(parts[3], parts[2], n, escapes)


class Encoder:
    """Ids of many texts. White space always parts tokens in this vocabulary, so each distinct word is encoded once.

    Words are known by a 64-bit hash; a worker remembers at most REMEMBER of them.
    """

    plain = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?|]*)")

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tok = Tokenizer.from_file(path)
        self.runs = Tokenizer(self.tok.model)  # the same merges, without the passes that lower-case letter runs don't need
        self.runs.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.last = np.zeros(self.tok.get_vocab_size(), bool)
        for token, i in self.tok.get_vocab().items():
            self.last[i] = token.endswith("</w>")
        self.clear()

    def clear(self):
        """Forget all words. Piece 0 is the empty one."""
        self.words, self.pairs = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.pieces: dict[str, int] = {"": 0}
        self.flat, self.at = np.zeros(1 << 16, np.uint16 if len(self.last) <= 1 << 16 else np.uint32), np.zeros(1 << 12, np.int64)
        self.n = 1

    def ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def keep(self, names: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        """Add pieces: their ids one after another, and how many each has."""
        used, n = self.at[self.n], self.n
        while used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while n + len(names) + 1 > len(self.at):
            self.at = np.concatenate([self.at, np.zeros_like(self.at)])
        self.flat[used:used + len(ids)] = ids
        self.at[n + 1:n + 1 + len(names)] = used + np.cumsum(sizes)
        self.n += len(names)
        self.pieces.update(zip(names, range(n, self.n)))

    def learn(self, words: list[bytes]) -> list[int]:
        """The pair of pieces of each word. Cut words into a run of letters and marks behind it, which the tokenizer parts too, and learn new pieces."""
        cut, runs, others = [], {}, {}
        for w in words:
            text = w.decode("utf-8", "surrogatepass")
            m = self.plain.fullmatch(text)
            pair = (m[1].lower(), m[2]) if m else ("", text)
            cut.append(pair)
            if pair[0] not in self.pieces:
                runs[pair[0]] = None
            if pair[1] not in self.pieces:
                others[pair[1]] = None
        runs = list(runs)
        for i in range(0, len(runs), 2000):
            part = runs[i:i + 2000]
            ids = np.array(self.runs.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids)
            ends = np.flatnonzero(self.last[ids]) + 1  # a run of letters is one word, and ends where a token ends one
            if len(ends) == len(part):
                self.keep(part, ids, np.diff(ends, prepend=0))
            else:
                others.update(dict.fromkeys(part))
        each = self.ids(list(others))
        self.keep(list(others), np.array([i for e in each for i in e], np.int64), np.array([len(e) for e in each], np.int64))
        get = self.pieces
        return [get[a] << 32 | get[b] for a, b in cut]

    def encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids with the end id behind each text, ids per text."""
        if max(len(self.words), self.n) > REMEMBER:
            self.clear()
        buf, offs = texthash.joined(texts)
        start, stop, first = texthash.words(buf, offs)
        names, at, which = np.unique(texthash.word_hashes(buf, start, stop), return_index=True, return_inverse=True)
        place = np.searchsorted(self.words, names)
        known = place < len(self.words)
        known[known] = self.words[place[known]] == names[known]
        pair = np.zeros(len(names), np.int64)
        pair[known] = self.pairs[place[known]]
        if not known.all():
            raw, new = buf.tobytes(), at[~known]
            pair[~known] = self.learn([raw[a:b] for a, b in zip(start[new].tolist(), stop[new].tolist())])
            every = np.concatenate([self.words, names[~known]])
            order = np.argsort(every, kind="stable")
            self.words, self.pairs = every[order], np.concatenate([self.pairs, pair[~known]])[order]
        own, at_own = _gather(self.flat, self.at, np.stack([pair >> 32, pair & 0xFFFFFFFF], 1).reshape(-1))
        ids, upto = _gather(own, at_own[::2], which)
        ends = upto[first[1:]]
        return np.insert(ids, ends, end).astype(np.uint64), np.diff(np.concatenate([[0], ends])) + 1


def _gather(flat: np.ndarray, at: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The slices flat[at[i]:at[i + 1]] for each i of `which` one after another, and where each begins (and the end)."""
    size = at[which + 1] - at[which]
    upto = np.concatenate([[0], np.cumsum(size)])
    return flat[np.repeat(at[which] - upto[:-1], size) + np.arange(upto[-1])], upto


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder that this Python worker keeps from task to task. Closures must ask here: a table that a closure names is
    copied with it, and would start empty in each task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def write(docs: DataFrame, vocabulary: str, end_id: int = 2) -> DataFrame:
    """Encode, pack and write all documents; the written table: shard, seq, n_ids, segment.

    Shards follow one another in doc_id order, and so do the segments of a shard by seq.
    """
    digest = F.xxhash64(F.col("text").cast("string"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       digest.alias("digest"))
    rows = rows.repartitionByRange("doc_id", "digest").sortWithinPartitions("doc_id", "digest").select("doc_id", "text")

    def encode(batches):
        coder, shard, seq = encoder(vocabulary), TaskContext.get().partitionId(), 0
        for b in batches:
            size = b.column(1).nbytes
            step = max(1, b.num_rows * SEGMENT_BYTES // max(1, size))
            for i in range(0, b.num_rows, step):
                part = b.slice(i, step)
                ids, lens = coder.encode(part.column(1), end_id)
                segment = write_segment(part.column(0).to_pylist(), lens, ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard], pa.int32()), pa.array([seq], pa.int32()), pa.array([len(ids)], pa.int64()),
                     pa.array([segment], pa.binary())], names=["shard", "seq", "n_ids", "segment"])
                seq += 1

    return stage(rows.mapInArrow(encode, "shard int, seq int, n_ids long, segment binary"), "tokens")


def read(files: DataFrame) -> DataFrame:
    """Decode written segments: doc_id, start, n_tokens, ids_crc32."""
    def decode(batches):
        for b in batches:
            for shard, seq, data in zip(*(b.column(c).to_pylist() for c in ("shard", "seq", "segment"))):
                docs, lens, ids = read_segment(data)
                ends = np.cumsum(lens)
                four = ids.astype("<u4").tobytes()
                crc = [zlib.crc32(four[4 * (e - n):4 * e]) for e, n in zip(ends.tolist(), lens.tolist())]
                n = len(docs)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard] * n, pa.int32()), pa.array([seq] * n, pa.int32()), pa.array(docs, pa.int64()),
                     pa.array(ends - lens, pa.int64()), pa.array(lens, pa.int64()), pa.array(crc, pa.int64())],
                    names=["shard", "seq", "doc_id", "off", "n_tokens", "ids_crc32"])

    found = files.select("shard", "seq", "segment").mapInArrow(
        decode, "shard int, seq int, doc_id long, off long, n_tokens long, ids_crc32 long")
    shards = files.groupBy("shard").agg(F.sum("n_ids").alias("n")) \
        .withColumn("base", F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(*_PREVIOUS)), F.lit(0)))
    segments = files.select("shard", "seq", F.coalesce(F.sum("n_ids").over(
        Window.partitionBy("shard").orderBy("seq").rowsBetween(*_PREVIOUS)), F.lit(0)).alias("above"))
    places = segments.join(shards.drop("n"), "shard").select("shard", "seq", (F.col("base") + F.col("above")).alias("base"))
    return found.join(places, ["shard", "seq"]).select("doc_id", (F.col("base") + F.col("off")).alias("start"), "n_tokens",
                                                       "ids_crc32")


_PREVIOUS = (Window.unboundedPreceding, -1)


def digest(docs: DataFrame, vocabulary: str) -> DataFrame:
    return read(write(docs, vocabulary))
