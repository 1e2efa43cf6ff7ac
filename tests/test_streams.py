"""Streams with state: late rows, stops and restarts, expiry, update mode and folded batches."""

import datetime as dt
import random

from pyspark.sql import functions as F

from linkguard.functions import chunkscan
from linkguard.operators import alerts as A
from linkguard.streaming import keyed, streams as S

from tests.test_workflow import ATTEMPT, T0, attempts, brute_throttle


def feed(spark, rows, schema, source):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)


def plain_throttle(files, watermark_s, started_again, seconds=60):
    """File by file: rows behind the watermark of the batch before go, the others pass by time and id behind the last. Before a
    stream stops, a batch without rows brings the watermark up to date."""
    last, out, seen, marks = {}, set(), None, [None]
    for k, rows in enumerate(files):
        mark = marks[-1 if k == started_again else -2] if len(marks) > 1 else None
        for i, ip, kind, ts in sorted(rows, key=lambda r: (r[3], r[0])):
            if mark is not None and ts <= mark:
                continue
            if (ip, kind) not in last or (ts - last[ip, kind]).total_seconds() >= seconds:
                last[ip, kind] = ts
                out.add(i)
        seen = max([r[3] for r in rows] + ([seen] if seen else []))
        marks.append(seen - dt.timedelta(seconds=watermark_s))
    return out


def test_throttle_with_late_rows_and_expiry(spark, tmp_path):
    rows = sorted(attempts(900, seed=8), key=lambda r: r[3])
    rng = random.Random(2)
    files = [[] for _ in range(6)]
    for k, r in enumerate(rows):
        files[min(5, k // 150 + rng.choice([0] * 12 + [1, 2]))].append(r)
    source, path = str(tmp_path / "in"), str(tmp_path / "out")

    def run():
        stream = S.file_stream(spark, source, spark.createDataFrame([], ATTEMPT).schema)
        return {r.attempt_id for r in S.alert_throttle(stream, path, "attempt_id", watermark="3 hours").collect()}
    for i, part in enumerate(files):
        feed(spark, part, ATTEMPT, source)
        if i == 2:
            run()  # stopped here, and started again below
    assert run() == plain_throttle(files, 3 * 3600, 3)


def test_first_rows_over_restarts(spark, tmp_path):
    rng, schema = random.Random(1), "event_id long, ts timestamp, domain string"
    source, path, want = str(tmp_path / "in"), str(tmp_path / "out"), {}
    for i in range(4):
        rows = [(i * 50 + k, T0 + dt.timedelta(minutes=rng.randrange(40)), rng.choice([f"d{rng.randrange(60)}", "hot"])) for k in range(50)]
        rows += [(9000 + i, T0, None)]
        for e, ts, d in sorted(rows, key=lambda r: (r[1], r[0])):
            if d and d not in {x for x in want if want[x][2] < i}:
                want.setdefault(d, (e, ts, i))
        feed(spark, rows, schema, source)
        if i % 2:
            got = S.first_seen_domain(S.file_stream(spark, source, spark.createDataFrame([], schema).schema), path).collect()
    assert {r.domain: (r.event_id, r.ts) for r in got} == {d: v[:2] for d, v in want.items()}


def test_batches_are_folded(spark, tmp_path):
    """Forty batches leave a few folders, a crash at any step loses and doubles nothing."""
    path = str(tmp_path)
    sums = lambda df: df.groupBy("k").agg(F.sum("n").alias("n"))
    table = S.DeltaTable(spark, path, "k long, n long", sums, fold_after=4)
    for i in range(40):
        table.write(spark.createDataFrame([(i % 3, 1), (7, i)], "k long, n long"), i)
        if i == 17:  # batch 17 runs again; an unfinished base and a batch that was not removed lie about
            table.write(spark.createDataFrame([(i % 3, 1), (7, i)], "k long, n long"), i)
            spark.createDataFrame([(7, 10 ** 6)], "k long, n long").write.parquet(f"{path}/base/upto=17")
            (tmp_path / "base" / "upto=17" / "_SUCCESS").unlink()
            spark.createDataFrame([(7, 10 ** 6)], "k long, n long").write.parquet(f"{path}/deltas/batch_id=2")
    got = {r.k: r.n for r in sums(table.read()).collect()}
    assert got == {0: 14, 1: 13, 2: 13, 7: sum(range(40))}
    n = sum(len(list((tmp_path / d).iterdir())) for d in ("base", "deltas"))
    assert n <= 10
    assert sums(table.read(before=0)).count() == 0 or table._base() >= 0


def test_profiles_in_update_mode(spark, tmp_path):
    """Counts over restarts; only what a batch changed is written; the sketch counts small sets exactly."""
    schema = "event_id long, ts timestamp, src_ip string, url string"
    source, path = str(tmp_path / "in"), str(tmp_path / "out")
    want = {}
    for i in range(4):
        rows = [(i * 10 + k, T0, "s", f"u{(i * k) % 7}") for k in range(10)]
        for r in rows:
            want[r[3]] = want.get(r[3], 0) + 1
        feed(spark, rows, schema, source)
        got = S.url_counts(S.file_stream(spark, source, spark.createDataFrame([], schema).schema), path)
    assert {r.url: r.n for r in got.collect()} == want


def test_chunks_hold_a_bounded_number_of_rows(spark):
    """A key with all its rows in a few seconds is cut all the same."""
    rng = random.Random(4)
    rows = [(i, "1.1.1.1" if i % 3 else f"2.2.2.{i % 7}", "a", T0 + dt.timedelta(seconds=rng.randrange(500) / 10)) for i in range(5000)]
    df = spark.createDataFrame(rows, ATTEMPT)
    cut = chunkscan.count_chunks(df.withColumn("us", A.micros()), ["source_ip", "alert_type"], ["us", "attempt_id"], 6)
    assert max(r["count"] for r in cut.groupBy("_chunk").count().collect()) <= 64
    got = {r.attempt_id for r in A.alert_throttle(df, seconds=3, chunk_bits=6).where("emitted").collect()}
    assert got == brute_throttle(rows, 3)
    # chunks follow one another in time within a key
    spans = cut.groupBy("source_ip", "_chunk").agg(F.min(F.struct("us", "attempt_id")).alias("a"), F.max(F.struct("us", "attempt_id")).alias("b"))
    by = {}
    for r in sorted(spans.collect(), key=lambda r: (r.source_ip, r._chunk)):
        assert r.source_ip not in by or by[r.source_ip] < r.a
        by[r.source_ip] = r.b


def test_throttle_holds_no_more_than_it_needs():
    """Equal times of a hot key are held once, rows in the shadow of the last one that passed not at all."""
    import pandas as pd

    class Value:
        def __init__(self, v):
            self.v = v

        def exists(self):
            return self.v is not None

        def get(self):
            return self.v

        def update(self, v):
            self.v = v

    class Handle:
        def listTimers(self):
            return []

        def registerTimer(self, ms):
            self.ms = ms

    p = keyed.Throttle(["id"], "id", 60, 300)
    p.handle, p.last = Handle(), Value((1000,))
    frames = [pd.DataFrame({"id": range(i * 10, i * 10 + 10), "event_us": [1000 + i] * 5 + [1060 + i] * 5}) for i in range(4)]
    out = pd.concat(list(p.handleInputRows(("k",), iter(frames), None)))
    assert out["id"].tolist() == [5] and p.last.v == (1060,) and p.handle.ms == 2


class Store:
    """A value of the state store, the handle and the watermark in one."""

    def __init__(self):
        self.v, self.timers, self.mark = None, [], 0

    def getValueState(self, name, schema):
        return self

    def exists(self):
        return self.v is not None

    def get(self):
        return self.v

    def update(self, v):
        self.v = v

    def clear(self):
        self.v = None

    def listTimers(self):
        return list(self.timers)

    def deleteTimer(self, ms):
        self.timers.remove(ms)

    def registerTimer(self, ms):
        self.timers.append(ms)

    def getCurrentWatermarkInMs(self):
        return self.mark


def test_throttle_takes_many_keys_in_one_group(monkeypatch):
    """One call for a bucket of keys gives what one call per key would; what the watermark has left behind is forgotten."""
    import pandas as pd

    monkeypatch.setattr(keyed.Throttle, "WAITING", 7)
    rng, store, last, gap, ttl = random.Random(3), Store(), {}, 60_000, 300_000
    p = keyed.Throttle(["id"], "id", gap, ttl, True)
    p.init(store)
    for batch in range(6):
        rows = [(batch * 100 + i, f"k{rng.randrange(12)}", batch * 200_000 + rng.randrange(0, 400_000, 5000)) for i in range(100)]
        want = []
        for i, k, us in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
            if k not in last or us >= last[k] + gap:
                last[k] = us
                want.append(i)
        frames = [pd.DataFrame(rows[i:i + 10], columns=["id", "event_key", "event_us"]) for i in range(0, 100, 10)]
        store.mark = (batch * 200_000 - 400_000) // 1000
        got = [i for f in p.handleInputRows((1,), iter(frames), store) for i in f["id"]]
        assert sorted(got) == sorted(want)
        last = {k: us for k, us in last.items() if (us + ttl) // 1000 + 1 > store.mark}
        assert p._load() == last and store.timers == [(max(last.values()) + ttl) // 1000 + 1]
    list(p.handleExpiredTimer((1,), store, None))
    assert p._load() == {}


def test_throttle_calls_grow_with_buckets_not_keys(spark, tmp_path):
    """Three hundred keys, null and empty ones among them, are 600 rows in five buckets, and no two of them are taken for one."""
    ips = [None, "", "null", *(f"s{i}" for i in range(297))]
    rows = [(2 * i + late, ip, kind, T0 + dt.timedelta(seconds=late * 30 + i % 7)) for i, (ip, kind) in
            enumerate((ip, kind) for ip in ips for kind in ("a", None)) for late in (0, 1)]
    source, path = str(tmp_path / "in"), str(tmp_path / "out")
    feed(spark, rows, ATTEMPT, source)
    stream = S.file_stream(spark, source, spark.createDataFrame([], ATTEMPT).schema).withWatermark("ts", "1 hour")
    out = keyed.throttled(stream, ["source_ip", "alert_type"], "attempt_id", 60, 300, buckets=5)
    q = (out.writeStream.format("parquet").option("path", f"{path}/data").option("checkpointLocation", f"{path}/checkpoint")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    got = [r.attempt_id for r in spark.read.parquet(f"{path}/data").collect()]
    assert sorted(got) == [r[0] for r in rows if r[0] % 2 == 0]
    ops = [o for p in q.recentProgress for o in p.stateOperators]
    # a value and a timer with its index for each bucket
    assert 0 < max(o.numRowsUpdated for o in ops) <= 5


def test_threat_alerts_derive_the_url_once(spark):
    """The words of the quick check are looked up in one value, not in its derivation."""
    flows = spark.createDataFrame([(1, T0, "1.1.1.1", "login-verify.tk", "/a", None, None)],
                                  "event_id long, ts timestamp, src_ip string, http_host string, http_path string, sni string, qname string")
    df = S.threat_alerts(flows)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("concat(http://") <= 3, plan.count("concat(http://")
    assert [r.source_ip for r in df.collect()] == ["1.1.1.1"]
