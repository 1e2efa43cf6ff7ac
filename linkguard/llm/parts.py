"""Documents packed into parts, and exchanges of hash keys between parts and buckets.

A part is a row with some megabytes of documents as one compressed Arrow stream. A job over parts hashes its texts, keeps
each key once, and sends its sorted keys, delta-coded, to buckets by their leading bits. A bucket sees all parts that hold a
key and answers each part with one number per key, in the order in which the part had sent them. The part reads its texts
again, computes the same keys and applies the answers. So a key that very many rows hold travels once per part, no document
text is shuffled with its keys, and no bucket grows with the copies of a text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage

#: Bytes of text in a part. Larger parts make fewer and better coded messages; a task needs some 60 times this in memory.
PART_BYTES = 2 << 20
#: Bytes of text per bucket: the keys of that much text meet in one bucket.
BUCKET_BYTES = 12 << 20

ROW = "bucket int, part long, n int, keys binary, extra binary, flags binary"
ANSWER = "part long, bucket int, answer binary"


def encoded(t: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, t.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(t)
    return sink.getvalue().to_pybytes()


def decoded(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(blob).read_all()


def pack(docs: DataFrame, part_bytes: int = PART_BYTES, whole_rows: bool = False) -> DataFrame:
    """Staged table of parts: part, bytes, blob. A blob has doc_id (long) and text (null as empty), and with `whole_rows` what
    else it takes to give the rows back as they came (see `rows_back`)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
                       *([F.struct(*[F.col(c) for c in docs.columns if c != "text"]).alias("rest"),
                          F.col("text").isNull().alias("no_text")] if whole_rows else []))

    return gather(rows, part_bytes, "parts")


def gather(rows: DataFrame, part_bytes: int, name: str) -> DataFrame:
    """Staged table of parts of rows: part, bytes, blob. The second column (text or binary) is what is measured."""
    def cut(batches):
        task, seq, held, size = TaskContext.get().partitionId(), 0, [], 0

        def flush():
            nonlocal seq, held, size
            t = pa.Table.from_batches(held).combine_chunks()
            row = pa.RecordBatch.from_arrays([pa.array([task << 24 | seq], pa.int64()), pa.array([size], pa.int64()),
                                              pa.array([encoded(t)], pa.binary())], names=["part", "bytes", "blob"])
            seq, held, size = seq + 1, [], 0
            return row

        for b in batches:
            lens = pc.binary_length(b.column(1)).to_numpy(zero_copy_only=False)
            i = 0
            while i < b.num_rows:
                upto = np.cumsum(lens[i:])
                k = min(b.num_rows - i, int(np.searchsorted(upto, max(1, part_bytes - size))) + 1)
                held.append(b.slice(i, k))
                size += int(upto[k - 1])
                i += k
                if size >= part_bytes:
                    yield flush()
        if held:
            yield flush()

    return stage(rows.mapInArrow(cut, "part long, bytes long, blob binary"), name)


def in_order(blob: bytes) -> pa.Table:
    """The documents of a part by doc_id (null first), then text."""
    t = decoded(blob)
    ids = pc.fill_null(t.column("doc_id"), -(1 << 63))
    t = t.set_column(0, "doc_id", ids)
    order = pc.sort_indices(t, sort_keys=[("doc_id", "ascending")])
    t = t.take(order)
    ids = t.column("doc_id").to_numpy()
    if len(ids) > 1 and (ids[1:] == ids[:-1]).any():
        t = t.take(pc.sort_indices(t, sort_keys=[("doc_id", "ascending"), ("text", "ascending")]))
    return t


def rows_back(packed: DataFrame, like: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of parts that were packed whole, but for those in gone (part, row number in the order of `in_order`)."""
    names = like.columns
    lists = gone.groupBy("part").agg(F.collect_list("row").alias("rows"))

    def each(key, left, right):
        drop = np.array([r for rows in right.column("rows").to_pylist() for r in rows], np.int64)
        out = []
        for blob in left.column("blob").to_pylist():
            t = in_order(blob)  # parts come one by one
            keep = np.ones(t.num_rows, bool)
            keep[drop] = False
            t = t.filter(pa.array(keep))
            rest = t.column("rest").combine_chunks()
            rest = pa.concat_arrays(rest.chunks) if isinstance(rest, pa.ChunkedArray) and rest.num_chunks != 1 else \
                rest.chunk(0) if isinstance(rest, pa.ChunkedArray) else rest
            text = pc.if_else(t.column("no_text"), pa.scalar(None, pa.string()), t.column("text"))
            out.append(pa.table({c: text if c == "text" else pc.struct_field(rest, [c]) for c in names}))
        return pa.concat_tables(out)

    return packed.select("part", "blob").groupBy("part").cogroup(lists.groupBy("part")).applyInArrow(each, like.schema)


def doc_ids(t: pa.Table) -> np.ndarray:
    return t.column("doc_id").to_numpy()


def null_ids(ids: np.ndarray) -> pa.Array:
    return pa.array(ids, pa.int64(), mask=ids == -(1 << 63))


class Layout:
    """How many bits keys have and how many leading ones choose the bucket, from the size of the corpus.

    Keys of `filter_bits` only have to make chance agreements rare: a chance agreement costs work, not correctness.
    """

    def __init__(self, parts: DataFrame, bucket_bytes: int = BUCKET_BYTES):
        total = parts.agg(F.sum("bytes")).first()[0] or 0
        self.bucket_bits = max(6, int(total // bucket_bytes).bit_length())
        self.filter_bits = min(62, max(24, int(total).bit_length() + 6))


def planes(a: np.ndarray) -> bytes:
    """Unsigned integers as byte planes, high planes left out where they are zero."""
    a = np.ascontiguousarray(a, dtype="<u8")
    k = max(1, (int(a.max()).bit_length() + 7) // 8) if len(a) else 0
    return bytes([k]) + np.ascontiguousarray(a.view(np.uint8).reshape(-1, 8)[:, :k].T).tobytes()


def unplanes(data: bytes, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    if n:
        out[:, :data[0]] = np.frombuffer(data, np.uint8, offset=1).reshape(data[0], n).T
    return out.reshape(-1).view("<u8").astype(np.uint64)


def put_sorted(a: np.ndarray) -> bytes:
    return planes(np.diff(a, prepend=np.uint64(0)))


def get_sorted(data: bytes, n: int) -> np.ndarray:
    return np.cumsum(unplanes(data, n), dtype=np.uint64)


def bounds(keys: np.ndarray, bits: int, bucket_bits: int) -> np.ndarray:
    """Where each bucket begins in sorted keys of `bits` bits, and the end."""
    steps = np.arange(1 << bucket_bits, dtype=np.uint64) << np.uint64(bits - bucket_bits)
    return np.append(np.searchsorted(keys, steps), len(keys))


def messages(part: int, keys: np.ndarray, at: np.ndarray, extra=None, flags=None) -> pa.Table:
    """Rows of ROW for one part. at: bounds of the buckets; extra: integers per key; flags: booleans per key."""
    out = [[], [], [], [], [], []]
    for b in np.flatnonzero(np.diff(at)):
        lo, hi = at[b], at[b + 1]
        out[0].append(int(b))
        out[1].append(part)
        out[2].append(int(hi - lo))
        out[3].append(put_sorted(keys[lo:hi]))
        out[4].append(b"".join(_sized(planes(x[lo:hi])) for x in extra or ()))
        out[5].append(b"".join(np.packbits(x[lo:hi]).tobytes() for x in flags or ()))
    kinds = (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
    return pa.table({c: pa.array(v, k) for c, v, k in zip(("bucket", "part", "n", "keys", "extra", "flags"), out, kinds)})


def _sized(data: bytes) -> bytes:
    return len(data).to_bytes(4, "little") + data


def received(t: pa.Table, n_extra: int = 0, n_flags: int = 0):
    """Of all messages to a bucket: parts, sizes, all keys, message number of each key, extras, flags."""
    parts, sizes = t.column("part").to_pylist(), np.array(t.column("n").to_pylist(), np.int64)
    keys = np.concatenate([get_sorted(k, n) for k, n in zip(t.column("keys").to_pylist(), sizes)])
    extra, flags = [[] for _ in range(n_extra)], [[] for _ in range(n_flags)]
    for data, bits, n in zip(t.column("extra").to_pylist(), t.column("flags").to_pylist(), sizes):
        for col in extra:
            size = int.from_bytes(data[:4], "little")
            col.append(unplanes(data[4:4 + size], n))
            data = data[4 + size:]
        step = -(-int(n) // 8)
        for i, col in enumerate(flags):
            col.append(np.unpackbits(np.frombuffer(bits, np.uint8, step, i * step), count=n).astype(bool))
    join = lambda cols: [np.concatenate(c) for c in cols]
    return parts, sizes, keys, np.repeat(np.arange(len(parts)), sizes), join(extra), join(flags)


def answers(bucket: int, parts: list, sizes: np.ndarray, value: np.ndarray, packed: bool = True) -> pa.Table:
    """Rows of ANSWER: per message a bit (packed) or a byte for each key."""
    cuts = np.split(value, np.cumsum(sizes)[:-1])
    data = [np.packbits(v).tobytes() if packed else v.astype(np.uint8).tobytes() for v in cuts]
    return pa.table({"part": pa.array(parts, pa.int64()), "bucket": pa.array([bucket] * len(parts), pa.int32()),
                     "answer": pa.array(data, pa.binary())})


def applied(t: pa.Table, at: np.ndarray, packed: bool = True) -> np.ndarray:
    """The answers to a part, one per key in sorted order. at: bounds of the keys."""
    out = np.zeros(at[-1], bool if packed else np.uint8)
    for bucket, data in zip(t.column("bucket").to_pylist(), t.column("answer").to_pylist()):
        raw = np.frombuffer(data, np.uint8)
        out[at[bucket]:at[bucket + 1]] = np.unpackbits(raw, count=int(at[bucket + 1] - at[bucket])) if packed else raw
    return out


def runs(sorted_rows: list[np.ndarray]) -> np.ndarray:
    """Start of each run of equal rows in sorted columns."""
    n = len(sorted_rows[0])
    new = np.ones(n, bool)
    if n:
        new[1:] = np.any([c[1:] != c[:-1] for c in sorted_rows], axis=0)
    return np.flatnonzero(new)


def send(parts: DataFrame, job: Callable[[int, bytes], pa.Table]) -> DataFrame:
    """Messages of each part, from the part alone."""
    def each(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, blob in zip(b.column(0), b.column(1)):
                yield from job(part.as_py(), blob.as_py()).to_batches()

    return parts.select("part", "blob").mapInArrow(each, ROW)


def ask(messages_: DataFrame, judge: Callable[[int, pa.Table], pa.Table], name: str) -> DataFrame:
    """Let each bucket answer its messages; staged rows of ANSWER."""
    def bucket(key, t):
        return judge(key[0].as_py(), t)

    return stage(messages_.groupBy("bucket").applyInArrow(bucket, ANSWER), name)


def tell(parts: DataFrame, told: dict[str, DataFrame], job: Callable[[int, bytes, dict], pa.Table], schema: str) -> DataFrame:
    """Bring each part together with its answers, by the name of the exchange."""
    every, named = None, list(told)
    for name, df in told.items():
        df = df.select("part", F.lit(name).alias("exchange"), "bucket", "answer")
        every = df if every is None else every.unionByName(df)

    def each(key, left, right):
        names = right.column("exchange")
        out = [job(part, blob, {n: right.filter(pc.equal(names, n)) for n in named})
               for part, blob in zip(left.column("part").to_pylist(), left.column("blob").to_pylist())]
        return pa.concat_tables(out)

    return parts.select("part", "blob").groupBy("part").cogroup(every.groupBy("part")).applyInArrow(each, schema)
