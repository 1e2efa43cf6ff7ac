"""Language identification by nearest centroid over TF-IDF vectors of character n-grams.

A text becomes counts of its byte trigrams (letters case-folded for ASCII, runs of anything that is not a letter made one
space), hashed into `DIMS` places, damped by a logarithm, weighted by inverse document frequency and set to length 1. Each
language has several centroids, found by clustering a bounded sample of its labelled texts on the unit sphere. A text gets
the language of the centroid with the largest cosine, and that cosine is its score. Texts whose cosine lies far below what
the sample of that language shows are rejected.

Document frequencies are counted over all labelled training texts; only the texts that are clustered are a sample, of at
most `PER_LANGUAGE` for each language, picked by a hash of doc_id and text.

Defined results: null texts and texts without a letter are `und` with score 0 and rejected. Ties go to the language that is
first by code point. Without any labelled training text everything is `und`. Repeated rows each give a row; extra input
columns are ignored by `predict`, and `keep_known` keeps the columns it got.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import texthash
from .common import stage

DIMS, CENTROIDS, PER_LANGUAGE = 4096, 4, 600
#: A text is rejected below this share of the lowest cosine that sampled texts of its length class reach.
SLACK = 0.35
#: Languages a model may have; each adds CENTROIDS * DIMS numbers to what is broadcast.
MAX_LANGUAGES = 500
_CLASSES = 16

_TEXT = np.full(256, 32, np.uint8)
_TEXT[128:] = np.arange(128, 256)
_TEXT[97:123] = np.arange(97, 123)
_TEXT[65:91] = np.arange(97, 123)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def counts(texts: pa.Array) -> np.ndarray:
    """Trigram counts of each text, hashed into DIMS places."""
    buf, offs = texthash.joined(texts)
    n = len(offs) - 1
    out = np.zeros((n, DIMS), np.float32)
    for i in range(n):
        a = _TEXT[buf[offs[i]:offs[i + 1]]]  # with the line feed behind, which is a space now
        a = np.concatenate([[32], a[(a != 32) | (np.concatenate([[32], a[:-1]]) != 32)]]).astype(np.uint32)
        if len(a) > 2:
            code = a[:-2] * np.uint32(0x9E3779B1) + a[1:-1] * np.uint32(0x85EBCA77) + a[2:] * np.uint32(0xC2B2AE3D)
            code = (code ^ (code >> np.uint32(15))) * np.uint32(0x27D4EB2F)
            out[i] = np.bincount(code >> np.uint32(32 - DIMS.bit_length() + 1), minlength=DIMS)
    return out


def vectors(count: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(count) * idf
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    return v / np.where(norm > 0, norm, 1)


def _length_class(count: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(count.sum(1) + 1).astype(int), _CLASSES - 1)


def cluster(v: np.ndarray, k: int = CENTROIDS, rounds: int = 12) -> np.ndarray:
    """Unit centroids of unit vectors; the first is the mean's direction, others start at the farthest vectors."""
    unit = lambda x: x / max(float(np.linalg.norm(x)), 1e-12)
    centres = [unit(v.mean(0))]
    while len(centres) < min(k, len(v)):
        near = (v @ np.array(centres).T).max(1)
        centres.append(v[int(near.argmin())])
    centres = np.array(centres)
    for _ in range(rounds):
        own = (v @ centres.T).argmax(1)
        new = np.array([unit(v[own == j].mean(0)) if (own == j).any() else c for j, c in enumerate(centres)])
        if np.allclose(new, centres):
            break
        centres = new
    return centres


def document_frequencies(train: DataFrame) -> tuple[int, np.ndarray]:
    """Number of training texts and, per place, of those that have it, over all of them."""
    def tally(batches):
        n, df = 0, np.zeros(DIMS, np.int64)
        for b in batches:
            for i in range(0, b.num_rows, 256):
                c = counts(b.column(0).slice(i, 256))
                n, df = n + len(c), df + (c > 0).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(DIMS + 1), pa.int32()), pa.array([n, *df.tolist()], pa.int64())],
                                         names=["place", "n"])

    got = train.select("text").mapInArrow(tally, "place int, n long").groupBy("place").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(DIMS + 1, np.int64)
    for r in got:
        df[r.place] = r.n
    return int(df[0]), df[1:]


def fit(train: DataFrame, per_language: int = PER_LANGUAGE) -> dict:
    """Model from columns doc_id, text, lang: idf, languages and centroids, lowest cosines per language and length class."""
    train = train.where("text is not null and lang is not null").select(
        F.col("doc_id").cast("string").alias("id"), F.col("text").cast("string").alias("text"),
        F.col("lang").cast("string").alias("lang"))
    n, df = document_frequencies(train)
    idf = (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)
    train = train.where(F.rlike("text", F.lit("\\p{L}")))
    many = {r.lang: r.n for r in train.groupBy("lang").agg(F.count("*").alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if len(many) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    # the first of each language by hash; what lies far above their expected place is not even sorted
    share = F.element_at(F.create_map(*[F.lit(x) for k, n in many.items() for x in (k, min(1.0, 4.0 * per_language / n))]),
                         F.col("lang")) if many else F.lit(1.0)
    keyed = train.select("lang", F.xxhash64("id", "text").alias("h"), "text").where(F.col("h") / 2.0 ** 64 + 0.5 <= share)
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    sample = stage(keyed.withColumn("nth", nth).where(F.col("nth") <= per_language).select("lang", "text"), "sample")

    def centroids(key, t):
        c = counts(t.column("text"))
        v = vectors(c, idf)
        centres = cluster(v)
        cos, low = (v @ centres.T).max(1), np.ones(_CLASSES)
        np.minimum.at(low, _length_class(c), cos)
        return pa.table({"lang": pa.array([key[0].as_py()]), "centres": pa.array([centres.astype(np.float32).tobytes()]),
                         "low": pa.array([low.tolist()], pa.list_(pa.float64()))})

    rows = sorted(sample.groupBy("lang").applyInArrow(centroids, "lang string, centres binary, low array<double>").collect(),
                  key=lambda r: r.lang.encode())
    centres = [np.frombuffer(r.centres, np.float32).reshape(-1, DIMS) for r in rows]
    low = np.array([r.low for r in rows]).reshape(-1, _CLASSES)
    if len(low):  # a length class that the sample lacks takes the lowest level seen
        for i in range(len(low)):
            seen = low[i] < 1
            low[i] = np.where(seen, low[i], low[i][seen].min() if seen.any() else 0)
        low[:, :6] = 0  # texts below some 60 trigrams are too short to judge by distance
    return {"idf": idf, "langs": [r.lang for r in rows], "centres": np.concatenate(centres) if rows else None,
            "owner": np.repeat(np.arange(len(rows)), [len(c) for c in centres]) if rows else None, "low": low}


def classify(texts: pa.Array, model: dict) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score, rejected."""
    known = np.array([has_letter(t) for t in texts.to_pylist()], bool)
    if model["centres"] is None:
        return ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
    c = counts(texts)
    cos = vectors(c, model["idf"]) @ model["centres"].T
    best = cos.argmax(1)
    lang, score = model["owner"][best], np.clip(cos[np.arange(len(best)), best].astype(float), 0, 1)
    far = score < SLACK * model["low"][lang, _length_class(c)]
    return ([model["langs"][j] if k else "und" for j, k in zip(lang, known)], np.where(known, score, 0.0), far | ~known)


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, lang_pred, score, rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def apply(batches):
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                lang, score, rejected = classify(part.column(1), shared.value)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected)],
                    names=["doc_id", "lang_pred", "score", "rejected"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        apply, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double, rejected boolean")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def digest(docs: DataFrame) -> DataFrame:
    model = fit(docs.where(~held_out(F.col("doc_id"))))
    return predict(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def keep_known(docs: DataFrame, model: dict) -> DataFrame:
    """The rows of `docs` that are not rejected, columns as they came."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def apply(batches):
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                yield part.filter(pa.array(~classify(part.column(at), shared.value)[2]))

    return docs.mapInArrow(apply, docs.schema)
