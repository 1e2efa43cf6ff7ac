"""Impersonation against brute force, rule shortcuts and risk fusion."""

import math

import pytest

from linkguard import constants as C
from linkguard.operators import impersonation as I, risk as K
from linkguard.plans import scan as S

DOMAINS = ["google.com", "paypal.com", "paypa1.com", "micros0ft.com", "g00gle.com", "arnazon.com",
           "paypal-secure.com", "microsoft-login.com", "googel.com", "paaypl.com", "аpple.com",
           "mіcrosoft.com", "goole.com", "micosoft.com", "paipel.com", "gougle.com", "faecbook.com",
           "login.paypal-id.com", "microsoft.com.account-verify.xyz", "xn--pypal-4ve.com"]


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def brute(host):
    """(brand, similarity) of edit-distance hits over all labels and brands, no candidate filter
    beyond the length tolerance."""
    main = host.split(".")[:-1]
    labels = [x for x in main if len(x) >= 3] + (["-".join(main)] if len(main) > 1 else [])
    out = set()
    for label in labels:
        for b in set(C.BRANDS):
            if abs(len(label) - len(b)) <= 3 and label != b:
                sim = 1 - edit_distance(label, b) / max(len(label), len(b))
                if sim >= 0.75:
                    out.add((b, round(sim, 6)))
    return out


def test_edit_matches_equal_brute_force(spark):
    df = spark.createDataFrame([(d,) for d in DOMAINS], "url string")
    m = I.typosquat_matches(I.with_host(df, "url"), I.brand_dim(spark))
    got = {}
    for r in m.where("technique NOT IN ('combosquatting', 'homoglyph', 'punycode')").collect():
        got.setdefault(r.ts_host, set()).add((r.brand, round(r.similarity, 6)))
    for d in DOMAINS:
        assert got.get(d, set()) == brute(d), d


def test_techniques(spark):
    df = spark.createDataFrame([(d,) for d in DOMAINS], "url string")
    rows = {(r.ts_host, r.brand): r for r in I.typosquat_matches(
        I.with_host(df, "url"), I.brand_dim(spark)).collect()}
    assert rows["faecbook.com", "facebook"].technique == "transposition"
    assert rows["goole.com", "google"].technique == "deletion"
    assert rows["xn--pypal-4ve.com", "paypal"].technique == "punycode"
    assert ("paypal-secure.com", "paypal") not in rows  # outside the length tolerance
    assert not any(h in ("google.com", "paypal.com") for h, _ in rows)


def test_homograph_text(spark):
    df = spark.createDataFrame([("gооgle1.com",)], "url string")  # Cyrillic o twice
    rows = I.typosquat_matches(I.with_host(df, "url"), I.brand_dim(spark)).collect()
    assert any(r.technique == "homoglyph" and r.brand == "google" for r in rows)


def test_scan_of_known_cases(spark):
    urls = ["https://www.google.com", "https://paypa1.com/login", "http://free-iphone-win.xyz/claim",
            "https://www.bbc.com/news/x", "HTTPS://PAYPAL.COM:443/login", "http://192.168.1.1/admin"]
    df = spark.createDataFrame(list(enumerate(urls)), "url_id long, full_url string")
    r = {x.url_id: x for x in S.scan_batch(df).collect()}
    assert r[0].verdict == "BENIGN" and r[0].rule_reasons == ["known_benign_domain"]
    assert r[1].ts_highest_risk > 80
    assert r[1].domain_score == r[1].ts_highest_risk
    assert "high_risk_tld:.xyz" in r[2].rule_reasons
    assert r[3].rule_result == "benign"
    assert r[4].hostname == "https"  # the scan prefix goes before an upper-case scheme
    assert "private_ip_host" in r[5].rule_reasons


RISK = [(2.0, .02, 0.0, 0.0, 0.0), (85.0, .95, 75.0, 90.0, 100.0), (45.0, .55, 30.0, 50.0, 20.0),
        (70.0, .8, 85.0, 75.0, 60.0), (80.0, .9, None, 70.0, 50.0), (None, .75, None, None, None),
        (None,) * 5, (float("nan"), 2.0, -5.0, 500.0, None)]


def test_risk_fusion(spark):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(RISK)],
                               "url_id int, " + ", ".join(f"{c} double" for c in K.INPUTS))
    for r in K.risk_fuse(df).collect():
        assert 0 <= r.risk_score <= 100 and 0 <= r.confidence <= 1
        used = sum(r[f"w_{s}"] for s in C.SIGNALS)
        assert used == pytest.approx(0 if r.n_present == 0 else 1)
        vals = dict(zip(C.SIGNALS, RISK[r.url_id]))
        if r.url_id < 5:
            vals["ml_score"] = vals["ml_score"] * 100
            w = {s: C.RISK_WEIGHTS[s] for s, v in vals.items() if v is not None}
            want = sum(w[s] * vals[s] for s in w) / sum(w.values())
            assert math.isclose(r.risk_score, want, abs_tol=1e-9)
    by_id = {r.url_id: r for r in K.risk_fuse(df).collect()}
    assert by_id[6].verdict == "UNKNOWN" and by_id[1].verdict == "MALICIOUS"
    assert by_id[4].missing_signals == ["ip_score"]
    assert by_id[7].missing_signals == ["rule_score", "threat_score"]


def test_weights_are_checked():
    with pytest.raises(ValueError):
        K.validate_weights({"rule_score": 1.0})
    w = K.validate_weights({s: 2.0 for s in C.SIGNALS})
    assert sum(w.values()) == pytest.approx(1)
