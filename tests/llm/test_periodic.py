"""Periodic runs against a scan of every lag, on random texts of small alphabets, planted periods and hard shapes."""

import random
import time
import zlib

import numpy as np
import pytest

from linkguard.llm import periodic

from . import brute


def runs_of(w, least=12):
    n, out = len(w), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(least, 2 * q):
                out.setdefault((i, j - i + q), q)  # the first lag is the smallest period
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in out.items()), key=lambda r: (r[0], r[2]))


def collapsed(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return [x for i, x in enumerate(w) if i not in gone]


@pytest.mark.parametrize("seed", range(6))
def test_runs_of_random_texts(seed):
    rng = random.Random(seed)
    for _ in range(120):
        texts = []
        for _ in range(4):
            small, n = rng.choice([1, 2, 3, 6, 30]), rng.choice([0, 5, 12, 20, 40, 90])
            w = [rng.randrange(small) for _ in range(n)]
            if n and rng.random() < .6:
                p, a = rng.randint(1, n), rng.randrange(n)
                w = [w[min(n - 1, a + (i - a) % p)] if i >= a else x for i, x in enumerate(w)]
            texts.append(w)
        first, least = np.concatenate([[0], np.cumsum([len(w) for w in texts])]), rng.choice([12, 12, 6, 20])
        got = periodic.find_runs(np.array([x for w in texts for x in w], np.int64), first, least)
        assert got == [runs_of(w, least) for w in texts]


def test_segments_are_stable():
    rng = random.Random(3)
    word = np.array([rng.choice([rng.randrange(9), rng.randrange(10_000)]) for _ in range(5000)])
    found = periodic.segments(word, np.array([0, 2000, 5000]), 3)
    for lo, hi in found:
        assert hi - lo >= 3 and (np.unique(word[lo:hi], return_counts=True)[1] > 1).all()
        assert hi <= 2000 or lo >= 2000
    for (_, a), (b, _) in zip(found, found[1:]):
        assert a <= b


def test_long_texts_take_no_square_time():
    """A million equal words, a long period, and a text in which each cut makes one more word alone."""
    rng, t0 = np.random.RandomState(0), time.time()
    for w, want in [(np.zeros(1_000_000, np.int64), [(0, 1_000_000, 1)]),
                    (np.tile(rng.randint(0, 1 << 30, 50_000), 3), [(0, 150_000, 50_000)]),
                    (np.array([x for i in range(30_000) for x in (i, max(0, i - 2))] + [-5]), [])]:
        assert periodic.find_runs(w, np.array([0, len(w)]))[0] == want
    assert time.time() - t0 < 60


def corpus():
    rng = random.Random(5)
    docs = []
    for i in range(120):
        w = [rng.choice("ab") if rng.random() < .5 else f"w{rng.randrange(400)}" for _ in range(rng.choice([0, 1, 13, 60, 200]))]
        docs.append((i, rng.choice([" ", "\n", " \t"]).join(w)))
    docs += [(200, None), (201, ""), (202, " \t\n"), (None, "x " * 15), (203, "no " * 30 + "ünd é b " * 9), (204, "a b " * 6)]
    return docs + [docs[5]] * 3


def planted(doc_id, w):
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not w:
        return w
    g, n = h // 10, len(w)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[a + (i - a) % p] if i >= a else w[i] for i in range(n)]


def test_digest(spark):
    docs = corpus()
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in docs], "doc_id long, text string, n_runs int, start string").repartition(3)
    got = sorted((tuple(r) for r in periodic.digest(periodic.with_planted_periods(df)).collect()), key=str)
    want = []
    for d, t in docs:
        w = planted(d, brute.WORD.findall(t or ""))
        runs = runs_of(w)
        top = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
        best = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
        want.append((d, len(runs), *best, brute.sha("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()),
                     brute.sha(" ".join(collapsed(w, runs)).encode())))
    assert got == sorted(want, key=str) and any(r[1] > 1 for r in got)
    assert periodic.digest(df.limit(0)).count() == 0


def test_find_and_collapse(spark):
    docs = corpus()
    df = spark.createDataFrame([("k", t, d) for d, t in docs], "runs string, text string, doc_id long").repartition(2)
    kept = periodic.collapse(df)
    assert kept.columns == df.columns
    want = []
    for d, t in docs:
        w = brute.WORD.findall(t or "")
        runs = runs_of(w)
        want.append((d, " ".join(collapsed(w, runs)) if runs else t))
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(want, key=str)
    got = {r.doc_id: r for r in periodic.find(df).collect()}
    assert [tuple(x) for x in got[204].runs] == [(0, 12, 2)] and got[204].collapsed == "a b"
    assert got[200].n_words == 0 and got[200].collapsed == "" and periodic.collapse(df.limit(0)).count() == 0


def test_one_very_long_text(spark):
    unit = [f"w{i}" for i in range(3000)]
    df = spark.createDataFrame([(1, " ".join(unit * 100)), (2, "short")], "doc_id long, text string")
    r = {r.doc_id: r for r in periodic.digest(df).collect()}[1]
    assert (r.n_runs, r.start, r.length, r.period) == (1, 0, 300_000, 3000)
    assert r.collapsed_sha256 == brute.sha(" ".join(unit).encode())
