"""Token output against the tokenizer itself, and exact round trips of the packing."""

import zlib

import numpy as np
import pyarrow as pa
import pytest

from linkguard.llm import queries, tokens

CASES = ["", " ", "Hello, world!", "don't WON'T it's", "a<|endoftext|>b <|ENDOFTEXT|>", "É́té é", "x y z",
         "12 3a4 ,. .,;x", "İstanbul ß ẞ ǅ", "日本語 テスト", "a" * 3000, "́abc क़ क़", "tab\tnew\nline\x0b\x0c\r.", "x÷y×z ö.,!?|;:",
         "o'clock'S 's", "\x1cq\x85r"]


def ids_of(texts):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(queries.vocabulary())
    return [t.encode(x or "", add_special_tokens=False).ids + [2] for x in texts]


@pytest.mark.parametrize("ids", [[], [0], [1] * 700, [1 << 60], [(1 << 64) - 1, 0, 5] * 100, list(range(1000)),
                                 [49407] * 257, [1 << k for k in range(64)] * 9])
def test_pack_round_trip(ids):
    a = np.array(ids, np.uint64)
    words, starts, escapes = tokens.pack(a)
    assert tokens.unpack(words, starts, len(a), escapes).tolist() == ids


def test_pack_random():
    rng = np.random.RandomState(1)
    for width in (1, 4, 9, 16, 30, 61, 64):
        a = rng.randint(0, 1 << 32, 2000, dtype=np.int64).astype(np.uint64) * np.uint64(4294967291) >> np.uint64(64 - width)
        assert (tokens.unpack(*[(w := tokens.pack(a))[0], w[1], len(a), w[2]]) == a).all()


def test_encoder_equals_tokenizer():
    rng = np.random.RandomState(3)
    letters = list("abcXYZéÉßöñ'.,;<|>endoftext 0123\t\n")
    texts = CASES + ["".join(rng.choice(letters, 60)) for _ in range(300)]
    coder = tokens.Encoder(queries.vocabulary())
    for _ in range(2):  # the second time from memory
        ids, lens = coder.encode(pa.array(texts), 2)
        assert [x.tolist() for x in np.split(ids, np.cumsum(lens)[:-1])] == ids_of(texts)


def test_digest(spark):
    rows = [(i, t, "s", 1) for i, t in enumerate(CASES)] + [(None, "null id", "s", 1), (3, "again", "s", 1), (99, None, "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string, n_ids int")
    got = tokens.digest(docs, queries.vocabulary()).collect()
    want = {}
    for d, t, *_ in rows:
        ids = ids_of([t])[0]
        want.setdefault(d, []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
        want[r.doc_id].remove((r.n_tokens, r.ids_crc32))
    assert not any(want.values())
    order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order[0] is None and order[1:] == sorted(order[1:])
    assert tokens.digest(docs.limit(0), queries.vocabulary()).count() == 0
