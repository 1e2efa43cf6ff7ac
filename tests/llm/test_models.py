"""Top-k search, mixing, language ID and the pipeline."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from linkguard.llm import language, mixing, topk

from . import brute

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("scale", [1, 1 << 20])
def test_top_k(spark, monkeypatch, scale):
    monkeypatch.setattr(topk, "BLOCK", 8)
    monkeypatch.setattr(topk, "RANGE", 3)
    monkeypatch.setattr(topk, "QUERIES", 4)
    rng = np.random.RandomState(2)
    vecs = [(int(i), [float(x) for x in rng.randint(-8, 8, 5) / 32 * scale]) for i in rng.permutation(200)]
    vecs += [(200 + i, vecs[0][1]) for i in range(40)]
    odd = [(1000, None), (None, vecs[0][1]), (1001, [1.0, None]), (1002, [float("nan")]), (1003, [float("inf")]), (1020, []), (1004, [2.0 * scale])]
    df = spark.createDataFrame([(i, v, 1) for i, v in vecs + odd], "vec_id long, embedding array<float>, id int").repartition(4)
    got = topk.digest(df).collect()
    sound = [(i, np.floor(64 * np.array(np.float32(v), float)).astype(np.int64)) for i, v in vecs + [odd[5], odd[6]]]
    want = []
    for q, x in sound:
        if q % 20 == 0:
            n = min(len(x), 5)
            s = sorted((-int(sum(int(a) * int(b) for a, b in zip(x, y))), i) for i, y in sound if i != q)[:20]
            want += [(q, k + 1, i, -v) for k, (v, i) in enumerate(s)]
            assert n <= 5
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == sorted(want)
    assert topk.digest(df.limit(0)).count() == 0


def test_top_k_prunes_clusters(spark):
    """Among clustered vectors most blocks are never scored; without structure all are. Rounds change no result."""
    rng = np.random.RandomState(3)
    centres = rng.randn(40, 16)
    rows = [(int(i), [float(x) for x in centres[i % 40] + rng.randn(16) * .05]) for i in range(6000)]
    df = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert topk.share_scored(df, F.col("id") % 100 == 0) < .5
    noise = [(int(i), [float(x) for x in rng.randn(16)]) for i in range(2000)]
    df = topk.quantised(spark.createDataFrame(noise, "vec_id long, embedding array<double>"))
    assert topk.share_scored(df, F.col("id") % 100 == 0) <= 1


def test_top_k_in_rounds(spark, monkeypatch):
    """Thirty groups in three rounds."""
    monkeypatch.setattr(topk, "BLOCK", 4)
    monkeypatch.setattr(topk, "RANGE", 5)
    monkeypatch.setattr(topk, "GROWTH", 4)
    rng = np.random.RandomState(6)
    rows = [(int(i), [int(x) for x in rng.randint(-5, 6, 3)]) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, v array<long>")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.search(df, F.col("id") % 20 == 0, 7).collect())
    want = []
    for q, x in rows[::20]:
        s = sorted((-sum(a * b for a, b in zip(x, y)), i) for i, y in rows if i != q)[:7]
        want += [(q, n + 1, i, -v) for n, (v, i) in enumerate(s)]
    assert got == sorted(want) and len(topk._rounds(30)) == 4


def mix_corpus():
    rng = random.Random(4)
    rows = [(i, " ".join("w" * rng.choice([1, 2]) for _ in range(rng.choice([0, 1, 5, 50, 300]))), rng.choice(["a", "b", "c", "d", None, "é", "tiny"]), 1)
            for i in range(1500)]
    rows += [(i + 1500, "word " * 40, "hot", 1) for i in range(800)]
    return rows + [(3000, None, "a", 1), (3001, "only", "single", 1), (3002, "", "no words", 1), (None, "x y", "a", 1)] + [(3003, "same row", "b", 1)] * 7


def test_mixing(spark):
    rows = mix_corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size int").repartition(5)
    got = mixing.plan(df).collect()
    size = lambda t: len(brute.WORD.findall(t or ""))
    sizes = Counter()
    for _, t, s, _ in rows:
        sizes[s] += size(t)
    goal = brute.targets(dict(sizes))
    taken = Counter()
    for r in got:
        assert r.source_size == sizes[r.src] and r.target == pytest.approx(goal[r.src], rel=1e-9)
        assert 0 <= r.copies <= 3
        taken[r.src] += r.copies * r["size"]
    assert len(got) == len(rows) and sum(goal.values()) == pytest.approx(sum(sizes.values()))
    for s in sizes:
        assert abs(taken[s] - goal[s]) <= 320
    again = mixing.plan(df.repartition(2)).collect()
    key = lambda r: (str(r.doc_id), r.digest, str(r.src), r.copies)
    assert sorted(map(key, got)) == sorted(map(key, again))
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns
    count = Counter((str(r.doc_id), str(r.src)) for r in got for _ in range(r.copies))
    assert Counter((str(r.doc_id), str(r.source)) for r in mixed.collect()) == count
    assert mixing.digest(df.limit(0)).count() == 0 and mixing.mix(df.limit(0)).count() == 0


def test_copies_follow_the_prefix_sums(spark):
    """Within a source, in the order of the plan, a document is emitted once for each integer that the running sum crosses."""
    docs = spark.createDataFrame(mix_corpus(), "doc_id long, text string, source string, size int")
    by = {}
    for r in mixing.plan(docs.repartition(3)).collect():
        by.setdefault(r.src, []).append(r)
    for src, rows in by.items():
        rate = rows[0].target / rows[0].source_size if rows[0].source_size else 0.0
        total = sum(r.copies for r in rows)
        # systematic sampling takes floor or ceiling of the expected number, of all rows and of the rows up to any size
        assert abs(total - rate * len(rows)) < 1 + 1e-6
        assert all(r.copies in (int(rate), int(rate) + 1, 3) for r in rows)
        for limit in (5, 50, 300):
            part = [r for r in rows if int(8 * np.log2(r["size"] + 1)) <= int(8 * np.log2(limit + 1))]
            assert abs(sum(r.copies for r in part) - rate * len(part)) < 1 + 1e-6
    got = {(r.doc_id, r.taken) for r in mixing.digest(docs).collect()}
    assert got == {(r.doc_id, r.copies * r["size"]) for rows in by.values() for r in rows}


def test_mix_with_clashing_columns(spark):
    """Columns named like the operator's own ones come out as they went in."""
    df = spark.createDataFrame([(i, f"w{i} " * (i % 7), "ab"[i % 2], i, str(i)) for i in range(60)],
                               "doc_id long, text string, source string, copies int, digest string")
    got = mixing.mix(df).collect()
    assert mixing.mix(df).columns == df.columns and all(r.copies == r.doc_id and r.digest == str(r.doc_id) for r in got)


def test_rejects_unknown_languages(spark):
    """Texts in scripts and alphabets that the model never saw are rejected, its own are not."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.fit(docs)
    strange = ["Это совсем другой язык, и модель его никогда не видела в своих данных. " * 3,
               "これはまったく別の言語であり、モデルは見たことがありません。" * 4, "zqxj vkwq xzzk qqjx wvzk jxqz kqzw " * 8]
    df = spark.createDataFrame(list(enumerate(strange)), "doc_id long, text string")
    assert all(r.rejected for r in language.predict(df, model).collect())
    assert language.predict(docs, model).where("rejected").count() <= 3


def test_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    odd = [(90001, None, "en"), (90002, "", "en"), (90003, " 12 !? \u0301", "fr"), (90004, "É", None), (None, "the and", "en")]
    df = docs.select("doc_id", "text", "lang").unionByName(spark.createDataFrame(odd, "doc_id long, text string, lang string")).withColumn("score", F.lit(9))
    got = {r.doc_id: r for r in language.digest(df).collect()}
    truth = {r.doc_id: r.lang for r in df.collect()}
    test = [d for d, r in got.items() if d is not None and d < 90000 and r.held_out and truth[d]]
    assert np.mean([got[d].lang_pred == truth[d] for d in test]) > .97 and len(test) > 150
    for d in (90001, 90002, 90003):
        assert got[d].lang_pred == "und" and got[d].score == 0 and got[d].rejected
    assert got[90004].lang_pred != "und" and not got[90004].rejected and not got[None].held_out
    assert all(0 <= r.score <= 1 for r in got.values())
    assert sum(r.rejected for r in got.values()) <= 3 + 5
    model = language.fit(df.where("false"))
    assert {r.lang_pred for r in language.predict(df.limit(9), model).collect()} == {"und"}
    assert language.digest(df.limit(0)).count() == 0


def test_pipeline_stages(spark):
    """Each stage on what the one before kept, against a plain version."""
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    raw = spark.read.parquet(f"{SMALL}/documents.parquet").select(names)
    odd = spark.createDataFrame([(90001, None, "en", None, 0), (90002, "", None, "x", 0), (None, "the and of", "en", "x", 3)], raw.schema)
    docs = raw.unionByName(odd).unionByName(raw.limit(3)).cache()
    steps = dict(corpus_pipeline.STAGES)
    out = {}
    for name, step in corpus_pipeline.STAGES[:-1]:
        out[name] = step(spark, docs, SMALL).cache()
        assert out[name].columns == names
        before, docs = docs, out[name]
        rows, kept = before.collect(), docs.collect()
        if name == "language_id":
            assert len(rows) - 5 <= len(kept) <= len(rows) - 2 and all(r.text for r in kept)
        if name == "near_duplicates":
            want = brute.jaccard([(r.doc_id, r.text) for r in rows], 5, 80)
            assert sorted(str(r.doc_id) for r in kept) == sorted({str(d) for d, _, c in want if d == c or d is None})
        if name == "decontamination":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
            want = brute.decontaminate([(r.doc_id, r.text) for r in rows], items, 13)
            assert sorted(str(r.doc_id) for r in kept) == sorted(str(w[0]) for w in want if not w[5])
        if name == "mix_sources":
            assert max(Counter(r.doc_id for r in kept).values()) <= 3
    last = steps["token_output"](spark, docs, SMALL).collect()
    assert Counter(r.doc_id for r in last) == Counter(r.doc_id for r in docs.collect())


def test_pipeline_empty(spark, tmp_path):
    for t in ("documents", "benchmark"):
        spark.read.parquet(f"{SMALL}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
