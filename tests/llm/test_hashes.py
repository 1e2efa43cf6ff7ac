"""Words whose letters are arranged so that polynomials modulo a power of two agree: they must count as different words."""

import numpy as np
import pyarrow as pa
import pytest

from linkguard.llm import jaccard, queries, substring_dedup, texthash, tokens


def pair(n=11):
    """Two words of 2**n letters, one with the letters of the other swapped."""
    bits = [bin(i).count("1") % 2 for i in range(1 << n)]
    return "".join("ab"[x] for x in bits), "".join("ba"[x] for x in bits)


def hashes(words, seed=0):
    buf, offs = texthash.joined(pa.array([" ".join(words)]))
    start, end, _ = texthash.words(buf, offs)
    return texthash.word_hashes(buf, start, end, seed)


@pytest.mark.parametrize("seed", [0, 1])
def test_word_hashes(seed):
    words = [w for n in range(1, 12) for w in pair(n)] + ["x" * n for n in range(1, 600)] + ["\x00" * n for n in (1, 7, 8, 9, 16)]
    h = hashes(words, seed)
    assert len(set(h.tolist())) == len(set(words))
    alone = np.concatenate([hashes([w], seed) for w in words])
    assert (h == alone).all()  # the place does not matter
    assert (hashes(words, 0) != hashes(words, 1)).all()


def texts():
    a, b = pair()
    around = [f"w{i}" for i in range(15)]
    return [" ".join([*around, w, *around[::-1]]) for w in (a, b)]


def test_substring_dedup(spark):
    df = spark.createDataFrame(list(enumerate(texts())), "doc_id long, text string")
    assert [r.n_removed for r in substring_dedup.digest(df).collect()] == [0, 0]


def test_jaccard(spark):
    df = spark.createDataFrame(list(enumerate(texts())), "doc_id long, text string")
    # 28 shingles each, of which four hold the odd word: 24 / 32 is less than 85 %
    assert sorted((r.n_shingles, r.component_id) for r in jaccard.digest(df).collect()) == [(28, 0), (28, 1)]


def test_token_ids(spark):
    from tokenizers import Tokenizer
    import zlib

    path = queries.vocabulary()
    whole = Tokenizer.from_file(path)
    docs = list(enumerate([*texts(), *pair(10)]))
    df = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r.ids_crc32 for r in tokens.digest(df, path).collect()}
    for d, t in docs:
        ids = whole.encode(t, add_special_tokens=False).ids + [2]
        assert got[d] == zlib.crc32(np.array(ids, "<u4").tobytes())
