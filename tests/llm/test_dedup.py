"""Both substring dedups against brute force on texts with copies, edits, shared passages and edge cases."""

import random

import pytest
from pyspark.sql import functions as F

from linkguard.llm import substring_dedup, suffix_dedup

from . import brute


def corpus(seed, n=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(1, 6)))
    text = lambda k: " ".join(word() for _ in range(k))
    passage, out = text(40), []
    for i in range(n):
        kind = rng.random()
        if kind < .2 and out:
            t = rng.choice(out)[1] or ""
        elif kind < .5 and out:
            w = (rng.choice(out)[1] or "").split(" ")
            for _ in range(rng.randint(1, 3)):
                w[rng.randrange(len(w))] = word()
            t = rng.choice([" ", "\n\n"]).join(w)
        elif kind < .7:
            t = text(rng.randint(0, 60)) + " " + passage + "\t" + text(rng.randint(0, 60))
        else:
            t = text(rng.choice([0, 1, 3, 9, 10, 19, 20, 80]))
        out.append((i * 7 % 61, t))
    rep = text(2)
    return out + [(100, None), (101, ""), (102, " "), (103, (rep + " ") * 60), (104, "a" * 300), (105, "a" * 299),
                  (None, out[3][1]), (106, text(900))]


@pytest.mark.parametrize("seed,part_bytes", [(1, 400), (2, 4000), (3, 1 << 20)])
def test_suffix_dedup(spark, seed, part_bytes):
    docs = corpus(seed)
    df = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, kept string").repartition(3)
    got = suffix_dedup.repeats(df, 40, part_bytes).select("doc_id", "n_bytes", "removed", "kept").collect()
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    rows = [(r.doc_id, r.n_bytes, sum(e - s for s, e in r.removed), len(r.removed), brute.sha(bytes(r.kept))) for r in got]
    assert sorted(rows, key=key) == sorted(brute.suffix_dedup(docs, 40), key=key)


@pytest.mark.parametrize("seed,part_bytes", [(1, 400), (2, 4000), (3, 1 << 20)])
def test_substring_dedup(spark, seed, part_bytes):
    docs = sorted(corpus(seed), key=lambda d: (d[0] is not None, d[0] or 0))
    df = spark.createDataFrame([(d, t, 5) for d, t in docs], "doc_id long, text string, part int").repartition(3)
    got = substring_dedup.repeats(df, 6, part_bytes).withColumn("sha", F.sha2("kept", 256)).collect()
    rows = sorted(((r.doc_id, r.n_words, r.n_removed, r.sha) for r in got), key=lambda r: (r[0] is not None, r[0] or 0))
    assert rows == brute.substring_dedup(docs, 6)
    for r in got:
        assert sum(e - s for s, e in r.removed) == r.n_removed


def test_repeated_rows_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "a b c d e f g h")] * 3, "doc_id int, text string")
    assert sorted(r.n_removed for r in substring_dedup.repeats(df, 6).collect()) == [0, 8, 8]
    assert [len(r.removed) for r in suffix_dedup.repeats(df, 10).collect()] == [1, 1, 1]
    none = df.limit(0)
    assert substring_dedup.digest(none).count() == 0
    assert suffix_dedup.digest(none).count() == 0


def test_word_hashes_do_not_depend_on_stretches(monkeypatch):
    import numpy as np
    import pyarrow as pa

    from linkguard.llm import texthash
    texts = pa.array([t for _, t in corpus(5)] + ["x" * 5000])
    buf, offs = texthash.joined(texts)
    start, end, _ = texthash.words(buf, offs)
    whole = texthash.word_hashes(buf, start, end)
    for stretch in (1, 50, 999):
        monkeypatch.setattr(texthash, "STRETCH", stretch)
        assert np.array_equal(texthash.word_hashes(buf, start, end), whole)
    raw = buf.tobytes()
    names = [raw[a:b] for a, b in zip(start, end)]
    assert len(set(names)) == len(set(whole.tolist())) == len(set(zip(names, whole.tolist())))


def test_suffix_buckets_follow_the_suffixes_in_doubt(spark, monkeypatch):
    """Edges of copies that begin unlike most of the corpus are dealt out to many buckets all the same."""
    rng = random.Random(6)
    docs = [(i, "".join(rng.choices("abcdefghijklm", k=6000))) for i in range(30)]
    for i in range(40):
        passage = "".join(rng.choices("yz", k=150))
        docs += [(100 + 2 * i + k, passage[rng.randrange(20):] + "".join(rng.choices("yz", k=60))) for k in (0, 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    sizes, ask = [], suffix_dedup.parts.ask

    def asked(messages, judge, name):
        if name == "suffixes":
            sizes.extend(r.n for r in messages.groupBy("bucket").agg(F.sum("n").alias("n")).collect())
        return ask(messages, judge, name)

    monkeypatch.setattr(suffix_dedup.parts, "ask", asked)
    monkeypatch.setattr(suffix_dedup, "BUCKET_SUFFIXES", 100, raising=False)
    got = suffix_dedup.repeats(df, 40).select("doc_id", "n_bytes", "removed", "kept").collect()
    assert sum(sizes) > 1000 and max(sizes) <= 300, sizes
    rows = [(r.doc_id, r.n_bytes, sum(e - s for s, e in r.removed), len(r.removed), brute.sha(bytes(r.kept))) for r in got]
    assert sorted(rows) == sorted(brute.suffix_dedup(docs, 40))
