"""Ordered folds on skewed keys against brute force; upserts, sinks, store and streams."""

import datetime as dt
import random

import pytest

from pyspark.sql import functions as F

from linkguard import constants as C
from linkguard.operators import alerts as A, ml as M, traffic as G, upserts as B
from linkguard.sources import feeds, sinks
from linkguard.shared import shared_folder
from linkguard.streaming import streams as S

T0 = dt.datetime(2024, 1, 1)


def attempts(n=4000, seed=3):
    """A third of all rows on one key, with runs that cross chunk limits and equal times."""
    rnd, t, rows = random.Random(seed), 0.0, []
    for i in range(n):
        t += rnd.choice([0, 0, 0.5, 3, 11, 29.5, 60, 61, 400])
        ip = "1.1.1.1" if rnd.random() < 0.34 else f"2.2.2.{rnd.randrange(60)}"
        rows.append((i, ip, rnd.choice(["a", "b"]) if ip != "1.1.1.1" else "a",
                     T0 + dt.timedelta(seconds=t)))
    return rows


def brute_throttle(rows, seconds=60):
    last, out = {}, set()
    for i, ip, kind, ts in sorted(rows, key=lambda r: (r[3], r[0])):
        if (ip, kind) not in last or (ts - last[ip, kind]).total_seconds() >= seconds:
            last[ip, kind] = ts
            out.add(i)
    return out


ATTEMPT = "attempt_id long, source_ip string, alert_type string, ts timestamp_ntz"


def test_throttle_over_small_batches(spark):
    """Groups that span many Arrow batches."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 37)
    try:
        rows = attempts(1500)
        got = A.alert_throttle(spark.createDataFrame(rows, ATTEMPT), chunk_seconds=100000).where("emitted")
        assert {r.attempt_id for r in got.collect()} == brute_throttle(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_throttle_equals_brute_force(spark):
    rows = attempts()
    df = spark.createDataFrame(rows, ATTEMPT)
    want = brute_throttle(rows)
    for chunk in (60, 600, 10 ** 7):
        got = A.alert_throttle(df, chunk_seconds=chunk).where("emitted")
        assert {r.attempt_id for r in got.collect()} == want, chunk


def test_status_fold_equals_brute_force(spark):
    rnd = random.Random(5)
    alerts = [(i, rnd.choice(C.STATUSES)) for i in range(20)]
    cmds = [(i, 0 if rnd.random() < 0.4 else rnd.randrange(25), rnd.choice(C.STATUSES + ["bogus"]),
             T0 + dt.timedelta(hours=rnd.randrange(200))) for i in range(1500)]
    state, want = dict(alerts), {}
    for i, a, s, ts in sorted(cmds, key=lambda c: (c[3], c[0])):
        ok = a in state and s in C.TRANSITIONS[state[a]]
        want[i] = (ok, state.get(a) if s in C.STATUSES else None)
        if ok:
            state[a] = s
    c = spark.createDataFrame([(i, a, s, "u", "n", ts) for i, a, s, ts in cmds],
                              "cmd_id long, alert_id long, new_status string, user_name string, "
                              "notes string, ts timestamp_ntz")
    al = spark.createDataFrame(alerts, "alert_id long, status string")
    for chunk in (3600, 86400):
        got = A.status_history(c, al, chunk).collect()
        assert {r.cmd_id: (r.success, r.old_status) for r in got} == want


def test_traffic_features_of_a_hot_address(spark):
    """All flows count, over slices, ties and more than 5,000 rows of one address."""
    rnd = random.Random(2)
    rows = [(i, T0 + dt.timedelta(seconds=rnd.choice([0, 1, 4000, 90000]) + rnd.randrange(40000)), "9.9.9.9",
             f"3.3.{rnd.randrange(30)}.{rnd.randrange(200)}", rnd.choice(["HTTP", "HTTPS", "DNS"]), rnd.randrange(3) * 100,
             rnd.randrange(40)) for i in range(6000)] + [(9000, T0, "1.1.1.1", "1.1.1.1", "TCP", 0, 0)]
    df = spark.createDataFrame(rows, "log_id long, ts timestamp_ntz, src_ip string, dst_ip string, protocol string, "
                                     "payload_size int, dst_port int")
    got = {r.ip_address: r for r in G.traffic_features(G.flow_ends(df), str(T0 + dt.timedelta(days=2)), 60 * 48).collect()}
    hot, mine = got["9.9.9.9"], [r for r in rows if r[2] == "9.9.9.9"]
    times = sorted(r[1] for r in mine)
    gaps = [(b - a).total_seconds() for a, b in zip(times, times[1:])]
    mean = sum(gaps) / len(gaps)
    std = (sum((g - mean) ** 2 for g in gaps) / len(gaps)) ** .5
    paid = [r[5] for r in mine if r[5]]
    assert hot.request_frequency == round(6000 / (60 * 48), 2) and hot.protocol_diversity == 3
    assert hot.unique_destinations == len({r[3] for r in mine})
    assert abs(hot.traffic_burstiness - std / mean) < 1e-4 and abs(hot.avg_payload_size - sum(paid) / len(paid)) < .01
    assert hot.port_scan_likelihood == round(len({r[6] for r in mine if r[6]}) / 50, 4)
    assert got["1.1.1.1"].traffic_burstiness == 0 and got["1.1.1.1"].avg_payload_size == 0


def test_redirect_chains(spark):
    from linkguard.operators import egress
    ok, bad = "http://8.8.8.8/", "http://169.254.169.254/latest"
    chains = {1: [ok] * 3, 2: [ok] * 6 + [bad, "http://127.0.0.1/"], 3: [ok] * 8, 4: [ok] * 7 + [bad], 5: [ok] * 7, 6: [bad], 7: [ok, bad, bad]}
    rows = [(c, i, u) for c, urls in chains.items() for i, u in enumerate(urls)]
    df = spark.createDataFrame(rows, "chain_id int, hop int, full_url string")
    got = {r.chain_id: (r.hops, r.blocked_hop, r.is_safe, r.reason) for r in egress.redirect_chain(df, None).collect()}
    meta = "encoded_ip:cloud_metadata_endpoint"
    assert got == {1: (3, None, True, None), 2: (8, 6, False, meta), 3: (8, None, False, "too_many_redirects"),
                   4: (8, None, False, "too_many_redirects"), 5: (7, None, True, None), 6: (1, 0, False, meta), 7: (3, 1, False, meta)}


def test_scan_keeps_blank_urls(spark):
    from linkguard.plans import scan
    df = spark.createDataFrame([(1, ""), (2, None), (3, "http://docs.python.org/3/")], "url_id int, full_url string")
    got = scan.scan_batch(df)
    assert {r.url_id: (r.prediction, r.confidence, r.risk_level) for r in got.where("url_id < 3").collect()} == {
        1: ("error", 0, "UNKNOWN"), 2: ("error", 0, "UNKNOWN")}
    assert scan.scan_summary(got).first().asDict() == {"total": 3, "malicious": 0, "suspicious": 0, "benign": 1, "errors": 2}


def test_latest_rows_per_address(spark):
    rnd = random.Random(1)
    rows = [(i, T0 + dt.timedelta(seconds=rnd.randrange(10 ** 6)),
             "9.9.9.9" if rnd.random() < .4 else f"3.3.3.{rnd.randrange(9)}",
             f"3.3.3.{rnd.randrange(9)}") for i in range(3000)]
    df = spark.createDataFrame(rows, "log_id long, ts timestamp_ntz, src_ip string, dst_ip string")
    got = G.traffic_by_ip(df, n=50)
    assert "WindowGroupLimit" in got._jdf.queryExecution().executedPlan().toString()
    for ip in ("9.9.9.9", "3.3.3.4"):
        want = sorted((r for r in rows if ip in (r[2], r[3])), key=lambda r: (r[1], r[0]),
                      reverse=True)[:50]
        ids = {r.log_id for r in got.where(F.col("ip_address") == ip).collect()}
        assert ids == {r[0] for r in want}


def test_first_occurrence_wins(spark):
    schema = "full_url string, source string, source_rank int, pos long"
    a = spark.createDataFrame([("u1", "a", 0, 5), ("u2", "a", 0, 6)], schema)
    b = spark.createDataFrame([("u1", "b", 1, 0), ("u3", "b", 1, 2), ("u3", "b2", 1, 1)], schema)
    benign = spark.createDataFrame([("u1", "ok")], "full_url string, source string")
    got = sorted(tuple(r) for r in B.feed_union_dedup([a, b], benign).collect())
    assert got == [("u1", "a"), ("u1", "ok"), ("u2", "a"), ("u3", "b2")]


def test_feed_files(spark, tmp_path):
    (tmp_path / "p.json").write_text('[{"url":"http://a.com"},{"url":"","phish_detail_url":'
                                     '"http://b.com"},{"url":"ftp://c"}]')
    (tmp_path / "m.csv").write_text('# c\n"1","d","http://x.com/a,b","on"\n')
    got = feeds.scan_json(feeds.read_lines(spark, str(tmp_path / "p.json"))).collect()
    assert [r.full_url for r in got] == ["http://a.com", "http://b.com"]
    got = feeds.scan_malware_csv(feeds.read_lines(spark, str(tmp_path / "m.csv"))).collect()
    assert [r.full_url for r in got] == ["http://x.com/a,b"]
    (tmp_path / "b.json").write_text('{"brands": ["PayPal", "x", "paypal"],'
                                     ' "high_value_brands": ["paypal"]}')
    got = {r.brand: (r.brand_pos, r.high_value)
           for r in feeds.read_brands(spark, str(tmp_path / "b.json")).collect()}
    assert got == {"paypal": (0, True), "x": (1, False)}


def test_sinks_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "weird", "urgent", "d" * 70000, T0)],
                               "alert_id int, alert_type string, severity string, "
                               "description string, ts timestamp_ntz")
    path = str(tmp_path / "alerts")
    sinks.append(df, "alerts", path)
    sinks.append(df, "alerts", path)
    rows = spark.read.parquet(path).collect()
    assert len(rows) == 2 and rows[0].alert_type == "other" and rows[0].severity == "low"
    assert len(rows[0].description) == 70000 and str(rows[0].day) == "2024-01-01"
    assert [r.wide_columns for r in sinks.too_wide(df, "alerts").collect()] == [["description"]]
    sinks.export_csv(str(tmp_path / "csv"), df.select("alert_id"), df.select("severity"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2


def test_model_store_and_scores(spark, tmp_path):
    rows = [(i, i % 2, float(i % 2) + (i % 7) / 10, float(i % 5)) for i in range(200)]
    df = spark.createDataFrame(rows, "url_id long, label int, a double, b double")
    model = M.train("logistic_regression", df, ["a", "b"])
    for v in ("1", "2"):
        M.save_model(spark, model, "logistic_regression", str(tmp_path), v, ["a", "b"], ["a", "b"])
    again, meta = M.latest_model(spark, str(tmp_path))
    assert meta["version"] == "2"
    pred = M.probability(again, df).withColumn("model_name", F.lit("m"))
    got = M.evaluate(pred).first()
    p = [(r.probability, r.label) for r in pred.collect()]
    pairs = [(x, y) for x, lx in p if lx == 1 for y, ly in p if ly == 0]
    want = sum(1.0 if x > y else 0.5 if x == y else 0.0 for x, y in pairs) / len(pairs)
    assert abs(got.roc_auc - want) < 1e-9
    assert got.tp + got.fn == 100 and got.f1_score > 0.9
    split = M.group_split(df.withColumn("domain", F.concat(F.lit("d"), F.col("url_id") % 40)))
    assert M.leakage_report(split).first().shared_groups == 0


def test_stream_throttle_resumes_over_many_batches(spark, tmp_path):
    """Five micro-batches, stopped after the third and started again on the same folder."""
    rows = sorted(attempts(600), key=lambda r: r[3])
    df = spark.createDataFrame(rows, ATTEMPT)
    source, path = str(tmp_path / "in"), str(tmp_path / "out")

    def feed(parts):
        for i in parts:
            spark.createDataFrame(rows[i * 120:(i + 1) * 120], ATTEMPT).coalesce(1).write.mode("append").parquet(source)

    def run():
        return S.alert_throttle(S.file_stream(spark, source, df.schema), path, "attempt_id")
    feed(range(3))
    assert {r.attempt_id for r in run().collect()} == brute_throttle(rows[:360])
    feed(range(3, 5))
    assert {r.attempt_id for r in run().collect()} == brute_throttle(rows)
    assert {r.attempt_id for r in run().collect()} == brute_throttle(rows)  # nothing new


def test_shared_folder_follows_the_session(tmp_path):
    class Conf:
        def __init__(self, base):
            self.base = base

        def get(self, key, default=None):
            return self.base if key == "spark.checkpoint.dir" and self.base else default

    class Session:
        class sparkContext:
            master = "spark://cluster"

        def __init__(self, base):
            self.conf = Conf(base)

    assert shared_folder(Session(str(tmp_path)), "x").startswith(str(tmp_path))
    with pytest.raises(ValueError):
        shared_folder(Session(None))


def test_filters_on_scan_columns_keep_plans_small(spark):
    from linkguard.plans import scan
    df = spark.createDataFrame([(0, "http://a.tk/login")], "url_id long, full_url string")
    got = scan.scan_batch(df).where("verdict <> 'BENIGN' AND registered_domain = 'a.tk'")
    assert got.count() == 1
    assert len(got._jdf.queryExecution().optimizedPlan().toString()) < 500_000
