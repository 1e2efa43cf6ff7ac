"""The Jaccard join against all pairs, with copies, chains of small edits, shared passages and short texts."""

import random

import pytest

from linkguard.llm import components, jaccard

from . import brute


def corpus(seed, n=150):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcDE") for _ in range(rng.randint(1, 4)))
    text = lambda k: [word() for _ in range(k)]
    base, passage, out = text(70), text(30), []
    for i in range(n):
        kind = rng.random()
        if kind < .35:  # one large group of near copies
            w = list(base)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = word()
            if rng.random() < .3:
                del w[rng.randrange(len(w))]
        elif kind < .6 and out:  # copies of copies
            w = list(rng.choice(out)[1])
            if w and rng.random() < .7:
                w[rng.randrange(len(w))] = word()
        elif kind < .75:
            w = passage + text(rng.randint(0, 6))
        else:
            w = text(rng.choice([0, 1, 2, 3, 4, 5, 8, 40]))
        out.append((rng.choice([i, i + 1000]), w))
    docs = [(d, rng.choice([" ", "\n", "  "]).join(w)) for d, w in out]
    return docs + [(None, docs[0][1]), (2000, None), (2001, ""), (2002, " \t"), (2003, "Aa Bb"), (2004, "aA bB"), (2005, "aa")]


@pytest.mark.parametrize("seed,part_bytes,block", [(1, 500, 4), (2, 3000, 3), (3, 1 << 20, 256), (4, 2000, 8)])
def test_components(spark, monkeypatch, seed, part_bytes, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    docs = corpus(seed)
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in docs], "doc_id long, text string, cid int, toks string").repartition(3)
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.link(df, 4, 85, part_bytes).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:2])
    assert sorted(got, key=key) == sorted(brute.jaccard(docs, 4, 85), key=key)


def test_repeated_rows_and_empty_tables(spark):
    df = spark.createDataFrame([(4, "a b c d e f g h")] * 3 + [(9, "a b c d e f g h")], "doc_id int, text string")
    assert [r.component_id for r in jaccard.link(df).collect()] == [4] * 4
    assert [r.doc_id for r in jaccard.keep_one(df).collect()] == [4]
    assert jaccard.digest(df.limit(0)).count() == 0
    assert jaccard.keep_one(df.limit(0)).count() == 0


def test_keep_one(spark):
    docs = corpus(7)
    df = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, component int")
    kept = jaccard.keep_one(df)
    assert kept.columns == df.columns
    want = [d for d, _, c in brute.jaccard(docs, 5, 80) if d == c or d is None]
    assert sorted(r.doc_id or -1 for r in kept.collect()) == sorted(d or -1 for d in want)


def test_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 400), (400, 400)], "a long, b long")
    got = {r.node: r.root for r in components.components(edges).collect()}
    assert got == {**{i: 0 for i in range(1, 201)}, 500: 400}
