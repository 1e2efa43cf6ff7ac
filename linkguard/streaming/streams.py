"""Structured Streaming operators over flow and alert streams, on event time with a watermark.

Functions take and return DataFrames; the stateless and windowed ones also run on batch input.
First rows and throttling keep one value per key in the state store (see keyed.py), profiles and
counts are streaming aggregates in update mode. A stream that keeps a table writes what each
micro-batch adds or changes below the number of the batch (`deltas`); a repeated batch overwrites its
own rows, and committed batches are folded into a base from time to time, so a reader meets a few
folders however long the stream has run. All state lies in the given folder: started again on it, a
stream goes on where it stopped. The folder must be shared by the driver and all executors.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from linkguard import constants as C
from linkguard.operators import alerts as A, rules as R, upserts as B
from linkguard.shared import exists, folders, remove
from linkguard.sources.flows import flow_normalize, flow_urls
from linkguard.streaming import keyed

#: Committed batch folders that are folded into a base together.
FOLD_AFTER = 8
#: log2 of the registers of a distinct-count sketch: at most 4 KB a key, relative error about 1.6 %.
SKETCH_BITS = 12


# --- plumbing ----------------------------------------------------------------------------------
def file_stream(spark: SparkSession, folder: str, schema, per_trigger: int = 1) -> DataFrame:
    """Stream of the Parquet files of a folder, oldest first; NTZ times become event times."""
    df = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)
    return df.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in df.columns else df


def drain(stream: DataFrame, path: str) -> DataFrame:
    """Run an append-mode stream over all available input into a Parquet table and read it."""
    q = (stream.writeStream.format("parquet").outputMode("append").option("path", f"{path}/data")
         .option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/data")


class DeltaTable:
    """A table that grows by micro-batches: `base/upto=N` holds batches up to N folded, `deltas/batch_id=M` the later ones.

    A base counts once its writer has marked it complete, and what it covers is ignored by name from then on and removed.
    So a crash between any two steps leaves a readable table: an unfinished base is passed over and written again, batches
    that were not removed are not counted twice. Batch M folds only batches before M, which are committed when M starts.
    """

    def __init__(self, spark: SparkSession, path: str, schema, fold: Callable[[DataFrame], DataFrame] | None = None,
                 fold_after: int | None = None):
        self.spark, self.path, self.fold = spark, path, fold or (lambda df: df)
        self.schema = spark.createDataFrame([], schema).schema
        self.fold_after = fold_after or FOLD_AFTER

    def _numbers(self, folder: str, name: str) -> list[int]:
        return sorted(int(x.split("=")[1]) for x in folders(self.spark, f"{self.path}/{folder}") if x.startswith(f"{name}="))

    def _base(self) -> int:
        """The number of the newest complete base, -1 if there is none."""
        done = [n for n in self._numbers("base", "upto") if exists(self.spark, f"{self.path}/base/upto={n}/_SUCCESS")]
        return max(done, default=-1)

    def read(self, before: int | None = None) -> DataFrame:
        """The rows of all batches, or of those before a number."""
        base = self._base()
        parts = [f"{self.path}/base/upto={base}"] if base >= 0 else []
        parts += [f"{self.path}/deltas/batch_id={n}" for n in self._numbers("deltas", "batch_id")
                  if n > base and (before is None or n < before)]
        return self.spark.read.schema(self.schema).parquet(*parts) if parts else self.spark.createDataFrame([], self.schema)

    def write(self, rows: DataFrame, batch_id: int) -> None:
        rows.select(*self.schema.names).write.mode("overwrite").parquet(f"{self.path}/deltas/batch_id={batch_id}")
        base = self._base()
        done = [n for n in self._numbers("deltas", "batch_id") if base < n < batch_id]
        if len(done) >= self.fold_after:
            self.fold(self.read(batch_id)).select(*self.schema.names).write.mode("overwrite").parquet(
                f"{self.path}/base/upto={done[-1]}")
            base = done[-1]
            for kind, name, keep in (("deltas", "batch_id", base + 1), ("base", "upto", base)):
                for n in self._numbers(kind, name):
                    if n < keep:
                        remove(self.spark, f"{self.path}/{kind}/{name}={n}")


def deltas(stream: DataFrame, path: str, schema, reduce: Callable[[DataFrame], DataFrame],
           fold: Callable[[DataFrame], DataFrame] | None = None, mode: str = "append") -> DataFrame:
    """Write ``reduce(batch)`` of each micro-batch to a DeltaTable; returns its rows. ``fold`` shortens rows of several
    batches to fewer that give the same result; without it they are kept as they are, in one folder."""
    table = DeltaTable(stream.sparkSession, path, schema, fold)

    def each(batch: DataFrame, batch_id: int) -> None:
        table.write(reduce(batch), batch_id)

    q = (stream.writeStream.foreachBatch(each).outputMode(mode)
         .option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()
    return table.read()


def updates(totals: DataFrame, path: str, key: str) -> DataFrame:
    """Run a streaming aggregate in update mode: each micro-batch leaves the rows that it changed, and a key's newest row
    counts. Returns the current row of each key."""
    rest = [c for c in totals.columns if c != key]
    schema = totals.withColumn("version", F.lit(0).cast("long")).schema
    spark = totals.sparkSession
    table = DeltaTable(spark, path, schema, lambda df: _newest(df, key, [*rest, "version"]))

    def each(batch: DataFrame, batch_id: int) -> None:
        table.write(batch.withColumn("version", F.lit(batch_id).cast("long")), batch_id)

    q = (totals.writeStream.foreachBatch(each).outputMode("update")
         .option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()
    return _newest(table.read(), key, rest)


def _newest(rows: DataFrame, key: str, rest: list[str]) -> DataFrame:
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), "version").alias("r")).select(key, "r.*")


# --- operators ---------------------------------------------------------------------------------
def rate_window(flows: DataFrame, threshold: int = 50, window: str = "60 seconds",
                watermark: str = "2 minutes", slide: str | None = None) -> DataFrame:
    """Requests per source and window; only sources above the threshold."""
    w = F.window("ts", window, slide) if slide else F.window("ts", window)
    df = flows.withWatermark("ts", watermark).groupBy(w.alias("w"), "src_ip").agg(
        F.count("*").alias("n"))
    return df.where(F.col("n") > threshold).select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "src_ip", "n")


def first_seen_domain(urls: DataFrame, path: str) -> DataFrame:
    """The first event of each domain: the earliest of the micro-batch that brings it first. What has been seen is a flag per
    domain in the state store, so a batch costs what it brings and nothing of the history is read again."""
    return drain(keyed.first_rows(urls.select("domain", "ts", "event_id").where("domain IS NOT NULL"), "domain",
                                  ["ts", "event_id"]), path)


def alert_throttle(alerts: DataFrame, path: str, id_col: str, seconds: int = 60, ttl_seconds: int = 300,
                   watermark: str = "10 minutes") -> DataFrame:
    """Per (source_ip, alert_type): pass an alert when ``seconds`` have gone by since the last one that passed. Late alerts
    pass only behind the last one; those behind the watermark are dropped."""
    late = alerts.withWatermark("ts", watermark)
    return drain(keyed.throttled(late, ["source_ip", "alert_type"], id_col, seconds, ttl_seconds), path)


def profile_totals(flows: DataFrame) -> DataFrame:
    """Running totals per source, as a streaming (or batch) aggregate. The distinct destinations are a mergeable sketch, so a
    source's state is bounded however many it visits; the other numbers are exact."""
    return flow_normalize(flows).groupBy("src_ip").agg(
        F.count("*").alias("request_count"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"),
        F.hll_sketch_agg("dst_ip", SKETCH_BITS).alias("destination_sketch"),
        F.array_join(F.array_sort(F.collect_set("protocol")), ",").alias("protocols"), F.sum("size").alias("total_bytes"))


def ip_profile(flows: DataFrame, path: str) -> DataFrame:
    """The current profile of each source after a run in update mode."""
    return updates(profile_totals(flows), path, "src_ip").select(
        "src_ip", "request_count", "first_seen", "last_seen",
        F.hll_sketch_estimate("destination_sketch").alias("destinations"), "protocols", "total_bytes")


def url_counts(urls: DataFrame, path: str) -> DataFrame:
    """Visits per URL, counted in update mode."""
    return updates(urls.groupBy("url").agg(F.count("*").alias("n")), path, "url")


def threat_alerts(flows: DataFrame) -> DataFrame:
    """Flow to alert: URL, quick check, severity high; the raw type is kept for throttling."""
    df = R.live_threat_check(flow_urls(flows)).where("is_threat")
    return df.select("event_id", "ts", F.col("src_ip").alias("source_ip"),
                     F.lit("suspicious_url").alias("alert_type"), F.lit("high").alias("severity"),
                     F.concat(F.lit("Live: "), "domain", F.lit(" ("), "reason", F.lit(")"))
                     .alias("description"))


def threat_alert_stream(flows: DataFrame, path: str, watermark: str = "10 minutes") -> DataFrame:
    """Threat alerts throttled per source, then coerced to the stored types."""
    return A.coerce_alert(alert_throttle(threat_alerts(flows), path, "event_id", watermark=watermark))


def recent_rows(stream: DataFrame, path: str, n: int) -> DataFrame:
    """The newest ``n`` rows: each batch keeps its newest, and so does the reader."""
    def newest(df):
        return df.orderBy(F.desc("ts"), F.desc("event_id")).limit(n)
    return newest(deltas(stream, path, stream.schema, newest, newest))


def url_rows(urls: DataFrame) -> DataFrame:
    """Captured URLs in the stored shape, tagged as live traffic."""
    return urls.selectExpr(
        "event_id AS url_id", "url AS full_url", "domain", "'/' AS path",
        "CASE WHEN contains(url, 'https') THEN 'https' ELSE 'http' END AS protocol",
        "CASE WHEN contains(domain, '.') THEN substring_index(domain, '.', -1) ELSE '' "
        "END AS tld", "length(url) AS url_length", "'live_traffic' AS source",
        "cast(NULL AS boolean) AS is_malicious", "event_id AS seq")


def url_sink(urls: DataFrame, path: str, stored: DataFrame, as_of: str) -> DataFrame:
    """The URL table after upserting captured URLs; batches keep one row per URL."""
    rows = url_rows(urls)
    rest = [c for c in rows.columns if c != "full_url"]

    def last(batch):
        return batch.groupBy("full_url").agg(F.max_by(F.struct(*rest), "seq").alias("r")).select("full_url", "r.*")
    return B.url_upsert(stored, deltas(rows, path, rows.schema, last, last), as_of)


def ip_touch(flows: DataFrame, path: str, stored: DataFrame, as_of: str) -> DataFrame:
    """The address table after one touch per source and micro-batch, as a capture flush does."""
    def touched(batch):
        return batch.groupBy(F.col("src_ip").alias("ip_address")).agg(F.min("event_id").alias("seq"))
    rows = deltas(flows, path, "ip_address string, seq long", touched)
    return B.ip_upsert(stored, rows.withColumn("ip_version", F.lit("IPv4")), as_of)


def suspicious_ports(flows: DataFrame, window: str = "10 minutes",
                     watermark: str = "20 minutes") -> DataFrame:
    """Flows to watched ports per source and window."""
    df = flows.where(F.col("dst_port").isin(C.SUSPICIOUS_PORTS)).withWatermark("ts", watermark)
    df = df.groupBy(F.window("ts", window).alias("w"), "src_ip").agg(
        F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("dst_port")).cast(
            "array<string>"), ",").alias("ports"))
    return df.select(F.col("w.start").alias("window_start"), "src_ip", "n", "ports")


def many_urls(urls: DataFrame, threshold: int = 50, window: str = "1 day",
              watermark: str = "1 hour") -> DataFrame:
    """Sources that visited more than ``threshold`` distinct URLs in a window: URLs are made
    distinct by a first windowed aggregate, so the second only counts rows."""
    df = urls.withWatermark("ts", watermark).groupBy(
        F.window("ts", window).alias("w"), "src_ip", "url").agg(F.count("*").alias("c"))
    df = df.groupBy("w", "src_ip").agg(F.count("*").alias("n_urls"))
    return df.where(F.col("n_urls") > threshold).select(
        F.col("w.start").alias("window_start"), "src_ip", "n_urls")
