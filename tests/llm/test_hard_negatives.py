"""Hard negatives against all pairs, with ties, repeated rows, odd vectors and small blocks."""

import numpy as np
import pytest

from linkguard.llm import hard_negatives as hn


def plain(rows, n_pos=5, n_neg=10, low=30, high=90):
    """rows: (id, label, integer vector). Sorted result rows."""
    out = []
    for a, label, x in rows:
        if a % 100:
            continue
        scored = sorted((-sum(p * q for p, q in zip(x, y)), i, k) for i, k, y in rows if i != a)
        for s, p, _ in [r for r in scored if r[2] == label][:n_pos]:
            fits = [(-t, i) for t, i, k in scored if k != label and low * -s <= 100 * -t <= high * -s]
            out += [(a, p, r + 1, i, -s, t) for r, (t, i) in enumerate(fits[:n_neg])]
    return sorted(out)


@pytest.mark.parametrize("block,many,anchors,scale", [(8, 2, 3, 1), (1024, 64, 256, 1), (16, 3, 1, 1 << 21)])
def test_against_all_pairs(spark, monkeypatch, block, many, anchors, scale):
    for name, v in (("BLOCK", block), ("RANGE", many), ("ANCHORS", anchors)):
        monkeypatch.setattr(hn, name, v)
    rng = np.random.RandomState(4)
    vecs = [(int(i), [float(x) for x in rng.randint(-3, 9, 4) / 256 * scale], int(rng.randint(0, 4)))
            for i in rng.permutation(260) * 10]
    vecs += [(100, vecs[0][1], 1), (33, vecs[3][1], 2), (33, vecs[3][1], 2)]  # repeated ids and rows
    vecs += [(70000, [0.0] * 4, 1), (70100, [], 3), (-100, vecs[5][1], 0), (-7, vecs[6][1], 9)]
    odd = [(200, None, 1), (None, vecs[0][1], 1), (300, [1.0, None], 1), (300, [float("nan")], 1), (300, [float("inf")], 2), (300, vecs[0][1], None)]
    df = spark.createDataFrame([(i, v, k, 1, "x") for i, v, k in vecs + odd],
                               "vec_id long, embedding array<float>, label int, id int, key string").repartition(4)
    got = [tuple(r) for r in hn.digest(df).collect()]
    rows = [(i, (k + 1) % 10 if i % 7 == 0 else k, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v, k in vecs]
    assert sorted(got) == plain(rows) and len(got) > 100
    assert hn.digest(df.limit(0)).count() == 0


def test_keys_sort_like_their_parts():
    rng = np.random.RandomState(1)
    rows = [(int(b), int(r), -5, int(s), bool(p), int(i)) for b, r, s, p, i in zip(
        rng.randint(0, 2, 300), rng.randint(0, 2, 300), rng.randint(-9, 9, 300) * (1 << 59), rng.randint(0, 2, 300),
        rng.randint(-(1 << 62), 1 << 62, 300))]
    keys = sorted(hn.packed_key(*r) for r in rows)
    assert [hn.unpacked(k) for k in keys] == sorted(rows, key=lambda r: (r[0], r[1], -r[3], not r[4], r[5]))


def test_the_stream_holds_windows_only():
    """A hundred thousand negatives pass through the iterator; it reads ahead by one key and holds five windows."""
    read = 0

    def keys():
        nonlocal read
        for i in range(7):
            yield hn.packed_key(0, 0, 1, 1000 - i, True, i)
        for i in range(100_000):
            read += 1
            yield hn.packed_key(0, 0, 1, 900 - i // 1000, False, 10_000 + i)

    stream = hn.windows(keys(), 5, 10, 30, 90)
    first = next(stream)
    assert first == (1, 0, 1, 10_000, 1000, 900) and read == 1
    rest = list(stream)
    assert len(rest) == 49 and {r[1] for r in rest} == {0, 1, 2, 3, 4}
