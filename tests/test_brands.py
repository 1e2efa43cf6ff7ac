"""The piece index of the brand join against all pairs, with a large brand table and hard texts."""

import random

import pytest
from pyspark.sql import functions as F

from linkguard.operators import impersonation as I

from tests.test_scoring import edit_distance


def near(text, brand):
    return edit_distance(text, brand) <= max(len(text), len(brand)) // 4


def mutated(rng, word):
    w = list(word)
    for _ in range(rng.randint(0, 4)):
        i = rng.randrange(len(w) + 1)
        kind = rng.randrange(3)
        if kind == 0:
            w.insert(i, rng.choice("abcxyz-"))
        elif w and i < len(w):
            w[i:i + 1] = [] if kind == 1 else [rng.choice("abcxyz0")]
    return "".join(w)


def tables(spark, brands, labels):
    b = spark.createDataFrame([(x, i, False) for i, x in enumerate(brands)], "brand string, brand_pos int, high_value boolean")
    return b, I.normalize_labels(spark.createDataFrame([(x,) for x in labels], "label string"))


@pytest.mark.parametrize("seed", [1, 2])
def test_candidates_hold_every_match(spark, seed):
    rng = random.Random(seed)
    brands = sorted({"".join(rng.choice("abc") for _ in range(rng.choice([1, 2, 3, 4, 5, 7, 8, 9, 12, 15, 16, 30]))) for _ in range(120)})
    labels = {mutated(rng, rng.choice(brands)) for _ in range(250)} | {mutated(rng, rng.choice(brands) + rng.choice(brands)) for _ in range(50)}
    labels = sorted(x for x in labels if len(x) >= 3) + ["a" * 400, "ünïcödé", "раураl", "xn--pypal-4ve"]
    b, rows = tables(spark, brands, labels)
    got = [(r.label, r.brand, r.kind) for r in I.candidates(rows, b).collect()]
    assert len(got) == len(set(got))
    found = set(got)
    for r in rows.collect():
        for brand in brands:
            if abs(len(r.normalized) - len(brand)) <= 3:
                plain = (near(r.normalized, brand) and r.normalized != brand) or (r.has_homoglyph and near(r.latin, brand)) \
                    or (brand in r.label and len(r.label) <= 2.5 * len(brand))
                assert not plain or (r.label, brand, "plain") in found, (r.label, brand)
            if r.decoded and near(r.decoded, brand):
                assert (r.label, brand, "xn") in found


def test_detections_equal_those_over_all_pairs(spark):
    """The detection steps say the same over the index as over every pair of comparable length."""
    brands = I.brand_dim(spark)
    names = [r.brand for r in brands.collect()]
    rng = random.Random(5)
    labels = sorted({x for b in names for x in (mutated(rng, b), b + "-x", "my" + b, b.replace("a", "а", 1), b) if len(x) >= 3})
    rows = I.normalize_labels(spark.createDataFrame([(x,) for x in labels], "label string"))
    cols = ["label", "brand", "step", "technique", "similarity", "risk", "details"]
    few = I.label_matches(I.candidates(rows, brands)).select(cols)
    every = I.label_matches(I.length_pairs(rows, brands)).select(cols).distinct()
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, every.collect())) and few.count() > 300


def test_pairs_do_not_grow_with_the_brand_table(spark):
    """A hundred thousand random brands: a label still meets but a few of them."""
    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    brands = sorted({word(rng.randint(6, 12)) for _ in range(100_000)})
    labels = sorted({mutated(rng, rng.choice(brands)) for _ in range(300)} | {word(9) for _ in range(300)})
    b, rows = tables(spark, brands, labels)
    pairs = I.candidates(rows, b)
    assert pairs.count() < 400 * len(labels)  # of some 50,000 of comparable length for each
    matches = I.label_matches(pairs).where(F.col("step") == I.EDIT)
    hit = {r.label for r in matches.collect()}
    assert hit >= {x for x in labels[:80] if any(x != y and abs(len(x) - len(y)) <= 3 and near(x, y) for y in brands[::50])}
