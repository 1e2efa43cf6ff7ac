"""Decontamination, secret scan and URL rules against plain versions."""

import random

import pytest

from linkguard.llm import decontaminate, secrets, url_filter

from . import brute


def bench_corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["a", "B", "é", "7", "日"]) for _ in range(rng.randint(1, 3)))
    text = lambda k: [word() for _ in range(k)]
    items = [(i, " ".join(text(rng.choice([0, 1, 3, 6, 12])))) for i in range(20)] + [(3, "x y z x y z x"), (50, None), (51, "-- !")]
    docs = []
    for i in range(80):
        w = text(rng.choice([0, 1, 4, 30, 200]))
        for _ in range(rng.randint(0, 3)):
            k = brute.bench_words(rng.choice(items)[1])
            at = rng.randint(0, len(w))
            w[at:at] = [x.upper() for x in k[rng.randint(0, 2):]]
        docs.append((i, rng.choice([" ", ", ", "\x00-\n"]).join(w)))
    return docs + [(80, None), (81, ""), (82, "..."), (None, "x y z x y z x"), (1, "X Y z\tx y z x y")], items


@pytest.mark.parametrize("seed,block", [(1, 1 << 20), (2, 60)])
def test_decontaminate(spark, seed, block):
    docs, items = bench_corpus(seed)
    df = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, n_hit int").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.find(df, bench, 6, block).collect()
    got = [(r.doc_id, r.n_words, r.n_hit, len(r["items"]), brute.sha(",".join(r["items"]).encode()),
            bool(decontaminate.contaminated(r.n_hit, r.n_words))) for r in found]
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    want = brute.decontaminate(docs, items, 6)
    assert sorted(got, key=key) == sorted(want, key=key)
    texts = {}
    for d, t in docs:
        texts.setdefault(d, []).append(t)
    for r in found:  # spans lie in the original text and hold the words that are hit
        assert any(sum(len(brute.bench_words(t[a:b])) for a, b in r.spans) == r.n_hit for t in texts[r.doc_id] if t) or not r.spans
    kept = decontaminate.keep_clean(df, bench, 6)
    assert kept.columns == df.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(w[0]) for w in want if not w[5])


def test_decontaminate_empty(spark):
    docs, items = bench_corpus(3)
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert decontaminate.digest(df.limit(0), bench).count() == 0
    assert decontaminate.digest(df, bench.limit(0)).where("n_hit > 0 or contaminated").count() == 0
    assert decontaminate.keep_clean(df, bench.limit(0)).count() == len(docs)


SECRETS = ["", None, "é" * 5 + ' password = "abc123XYZ" x', "token=token=abcdef", "secret=token:abcdefgh", "PassWD:12345", "api_key':'a/b+c=d.e-f_g",
           "apikey=aaaaaa token=bbbbbb", "AKIA" + "A" * 16, "AKIA" + "A" * 15, "xAKIAAKIA" + "B7" * 9, "0" * 23, "f" * 24, "0" * 24 + "g" + "a1" * 30,
           "日本 login: someone at https://host.example/x token: zzzzzzzz", "far " + "x " * 300 + "user=abc https://a.example/b", "user = bob42 AKIA1234567",
           "tokens", "token = \nabcdefg", "ſecret=abcdefgh toKen=abcdefgh", "password" + " " * 50 + "=" + " " * 50 + "q" * 500,
           "Zm9vYmFyYmF6cXV4MTIzNDU2 alone", "client_id=me42 then Zm9vYmFyYmF6cXV4MTIzNDU2", "token=aaaaaa " * 400]


def test_secrets(spark):
    docs = list(enumerate(SECRETS)) + [(None, SECRETS[2]), (2, SECRETS[6])]
    df = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, row int")
    rows = secrets.digest(df).collect()
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    got = [(r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in rows]
    assert sorted(got, key=key) == sorted(brute.secrets(docs), key=key)
    spans = {r.doc_id: r.spans for r in rows if r.doc_id not in (None, 2)}
    assert [s.split(":")[0] for s in spans[14].split(",")] == ["id", "endpoint", "assign"]
    assert [s.split(":")[0] for s in spans[15].split(",")] == ["id", "endpoint"]
    assert spans[16] == ""  # two identifiers complement nothing
    assert spans[21] == "" and [s.split(":")[0] for s in spans[22].split(",")] == ["id", "secret"]
    assert secrets.digest(df.limit(0)).count() == 0


URLS = {  # host, path, rule
    "https://www.example.com/en/1?x": ("www.example.com", "/en/1", "www.example.com/en/"),
    "http://a.b.EXAMPLE.com/en/": ("a.b.example.com", "/en/", "example.com/en/"),
    "http://example.com/EN/": ("example.com", "/EN/", "com/"), "http://notexample.com/en/": ("notexample.com", "/en/", "com/"),
    "http://m.www.example.com/en/q#f": ("m.www.example.com", "/en/q", "www.example.com/en/"),
    "x://net/es/": ("net", "/es/", "net/es/"), "x://a.net/fr/1": ("a.net", "/fr/1", "net/fr/"), "x://a.net/en/1": ("a.net", "/en/1", None),
    "http://x.com": ("x.com", "", None), "http://x.com?a/b": ("x.com", "", None), "http://É.Com#/": ("É.com", "", None),
    "no scheme.com/": ("", "", None), "": ("", "", None), None: ("", "", None), "://com/a://net/es/": ("com", "/a://net/es/", "com/"),
    "http://x.com:80/": ("x.com:80", "/", None)}


def test_url_rules_and_trees(spark):
    rows = [(i, u, "h") for i, u in enumerate(URLS)] + [(None, "http://q.com/a", "h")] * 2
    df = spark.createDataFrame(rows, "page_id long, url string, host string")
    got = url_filter.judge(df, rounds=3).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.page_id is not None:
            assert (r.host, r.path, r.rule) == list(URLS.values())[r.page_id]
        assert r.verdict in ("allow", "block") and (r.block_score is None) == (r.rule is not None)
    verdicts = {v + p: k for k, v, p in url_filter.RULES}
    assert all(r.verdict == verdicts[r.rule] for r in got if r.rule)
    alone = url_filter.judge(df.where("url like '%x.com%'")).collect()  # nothing labelled
    assert {r.verdict for r in alone} == {"allow"}
    assert url_filter.judge(df.limit(0)).count() == 0


def test_trees_learn(spark):
    """URLs without a rule are judged like labelled ones that look alike."""
    rows = [(i, f"http://h{i}.net/es/{'9' * 40}?a=1&b=2&c={i}") for i in range(200)] + [(1000 + i, f"http://h{i}.com/about") for i in range(200)] \
        + [(2000 + i, f"http://k{i}.org/zz/{'9' * 40}?a=1&b=2&c={i}") for i in range(50)] + [(3000 + i, f"http://k{i}.org/about") for i in range(50)]
    got = {r.page_id: r.verdict for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert {got[2000 + i] for i in range(50)} == {"block"} and {got[3000 + i] for i in range(50)} == {"allow"}


def test_url_trees_on_held_out_urls(spark):
    """Labelled URLs that the trees did not see; without two kinds of labels there is nothing to measure."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    got = url_filter.held_out_figures(pages)
    assert got["n"] > 100 and got["accuracy"] > .6 and 0 <= got["precision"] <= 1 and 0 <= got["recall"] <= 1
    assert url_filter.held_out_figures(pages.limit(0))["n"] == 0


def test_a_repeated_url_does_not_fill_the_sample(spark):
    """One labelled URL makes up nearly all rows, and the trees still learn both kinds."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(5))
    urls = ["http://hot.net/es/x"] * 3000 + [f"http://{word()}.net/es/{word()}?a={i}&b=1&c=2" for i in range(40)] \
        + [f"http://{word()}.com/{word()}" for _ in range(40)] + [f"http://{word()}.org/{word()}" for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = [r for r in url_filter.judge(df, sample=60).collect() if r.rule is None]
    assert len(got) == 40 and sum(r.verdict == "allow" for r in got) > 30
