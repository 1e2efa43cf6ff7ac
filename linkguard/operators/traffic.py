"""Traffic behaviour per address, over all of its flows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

#: Length of the time slices in which the gaps between flows are first summed.
SLICE_SECONDS = 3600


def flow_ends(traffic: DataFrame, ips: DataFrame | None = None) -> DataFrame:
    """A row per flow and address that is its source or destination (one when they are equal)."""
    ends = traffic.withColumn("ip_address", F.explode(F.array_distinct(F.array("src_ip", "dst_ip"))))
    return ends if ips is None else ends.join(ips.select("ip_address").distinct(), "ip_address", "left_semi")


def traffic_by_ip(traffic: DataFrame, n: int, ips: DataFrame | None = None) -> DataFrame:
    """The newest ``n`` flows of each address with their rank.

    The rank filter reaches the map side (window group limit), so at most ``n`` rows per address
    and task are shuffled, however hot an address is.
    """
    w = Window.partitionBy("ip_address").orderBy(F.desc("ts"), F.desc("log_id"))
    return flow_ends(traffic, ips).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def traffic_features(ends: DataFrame, as_of: str, minutes: int = 60) -> DataFrame:
    """The seven features of each address of ``flow_ends`` rows.

    Gaps between neighbouring flows are summed within (address, time slice), and the slices of an
    address, which are few, are stitched by the gap from one's last to the next one's first flow.
    So no task holds all flows of a hot address.
    """
    us = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)")
    df = ends.withColumn("us", us).withColumn("slice", F.floor(F.col("us") / (SLICE_SECONDS * 1e6)))
    w = Window.partitionBy("ip_address", "slice").orderBy("us", "log_id")
    gap = (F.col("us") - F.lag("us").over(w)) / 1e6
    recent = F.expr(f"ts >= TIMESTAMP_NTZ '{as_of}' - INTERVAL {minutes} MINUTE")
    paid = F.expr("nullif(payload_size, 0)")
    slices = df.withColumn("gap", gap).groupBy("ip_address", "slice").agg(
        F.count_if(recent).alias("recent"), F.count("*").alias("rows"),
        F.collect_set("protocol").alias("protocols"), F.collect_set(F.expr("nullif(dst_port, 0)")).alias("ports"),
        F.count_if(F.col("protocol") == "HTTPS").alias("https"),
        F.sum(paid).alias("paid"), F.count(paid).alias("n_paid"),
        F.count("gap").alias("n_gap"), F.coalesce(F.avg("gap"), F.lit(0.0)).alias("gap_mean"),
        F.coalesce(F.var_pop("gap"), F.lit(0.0)).alias("gap_var"), F.min("us").alias("head"), F.max("us").alias("tail"))
    before = Window.partitionBy("ip_address").orderBy("slice")
    slices = slices.withColumn("join_gap", (F.col("head") - F.lag("tail").over(before)) / 1e6)
    n, mean = F.col("n_gap"), F.col("gap_mean")
    agg = slices.groupBy("ip_address").agg(
        *[F.sum(c).alias(c) for c in ("recent", "rows", "https", "paid", "n_paid")],
        F.size(F.array_distinct(F.flatten(F.collect_set("protocols")))).alias("protocol_diversity"),
        F.size(F.array_distinct(F.flatten(F.collect_set("ports")))).alias("ports"),
        (F.sum(n) + F.count("join_gap")).alias("gaps"),
        (F.sum(n * mean) + F.coalesce(F.sum("join_gap"), F.lit(0.0))).alias("gap_sum"),
        (F.sum(n * (F.col("gap_var") + mean * mean)) + F.coalesce(F.sum(F.col("join_gap") * F.col("join_gap")), F.lit(0.0)))
        .alias("gap_squares"))
    to = ends.groupBy("ip_address").agg(F.countDistinct("dst_ip").alias("unique_destinations"))
    return agg.join(to, "ip_address").selectExpr(
        "ip_address", f"round(recent / {minutes}D, 2) AS request_frequency", "unique_destinations",
        "protocol_diversity", "round(https / cast(rows as double), 4) AS https_ratio",
        "round(coalesce(paid / cast(nullif(n_paid, 0) as double), 0D), 2) AS avg_payload_size",
        "round(least(ports / 50D, 1D), 4) AS port_scan_likelihood",
        "round(CASE WHEN rows < 2 OR gaps = 0 THEN 0D WHEN gap_sum = 0 THEN 1D ELSE "
        "sqrt(greatest(gap_squares / gaps - pow(gap_sum / gaps, 2), 0D)) / (gap_sum / gaps) END, 4) AS traffic_burstiness")


TRAFFIC_FEATURES = ["request_frequency", "unique_destinations", "protocol_diversity", "https_ratio",
                    "avg_payload_size", "port_scan_likelihood", "traffic_burstiness"]
