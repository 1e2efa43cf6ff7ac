"""Append sinks, exports and the tables a scan leaves behind."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from linkguard import constants as C
from linkguard.functions.sqlutil import add, in_list

# --- fixed values: column widths (of stores that have them) and enumerations of the stored tables
WIDTHS = {
    "urls": {"full_url": 2048, "domain": 255, "tld": 20, "protocol": 10, "source": 100},
    "ip_addresses": {"asn": 20, "isp": 255, "organization": 255, "country": 100, "city": 100,
                     "region": 100},
    "dns_records": {"record_value": 60000}, "threat_intelligence": {"description": 65000},
    "traffic_logs": {"user_agent": 60000}, "alerts": {"description": 65000},
    "model_predictions": {"features_used": 60000},
    "audit_logs": {"old_values": 60000, "new_values": 60000},
}
ENUMS = {"alerts": {"alert_type": (C.ALERT_TYPES, "other"), "severity": (C.SEVERITIES, "low")}}


def conform(rows: DataFrame, table: str) -> DataFrame:
    """Coerce enumerations to their default. Text is stored whole: Parquet has no widths, and a
    cut key would make two rows one."""
    cols = {}
    for c, (values, default) in ENUMS.get(table, {}).items():
        if c in rows.columns:
            cols[c] = f"CASE WHEN {in_list(c, values)} THEN {c} ELSE '{default}' END"
    return add(rows, **cols) if cols else rows


def too_wide(rows: DataFrame, table: str) -> DataFrame:
    """Rows that a store with fixed column widths could not take, with the names of the columns."""
    over = ", ".join(f"CASE WHEN length({c}) > {n} THEN '{c}' END"
                     for c, n in WIDTHS.get(table, {}).items() if c in rows.columns)
    return add(rows, wide_columns=f"filter(array({over or 'cast(NULL as string)'}), c -> c IS NOT NULL)").where(
        "size(wide_columns) > 0")


def append(rows: DataFrame, table: str, path: str, ts: str | None = "ts") -> None:
    """Append to a Parquet table, partitioned by day when it has a time column."""
    df = conform(rows, table)
    if ts and ts in df.columns:
        df.withColumn("day", F.to_date(ts)).write.mode("append").partitionBy("day").parquet(path)
    else:
        df.write.mode("append").parquet(path)


def union_reports(*frames: DataFrame) -> DataFrame:
    """Report frames with different columns, one below the other."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def export_csv(path: str, *frames: DataFrame) -> None:
    union_reports(*frames).write.mode("overwrite").option("header", True).csv(path)


def export_json(path: str, *frames: DataFrame) -> None:
    union_reports(*frames).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def json_rows(df: DataFrame) -> DataFrame:
    """The lines of a JSON export."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("line"))


def prediction_rows(scored: DataFrame, model_name: str, version: str = "latest"):
    """(url rows, prediction rows) of a scan; the stored prediction score is the confidence."""
    s = add(scored, store_domain="CASE WHEN registered_domain <> '' THEN registered_domain "
                                 "ELSE hostname END")
    urls = s.selectExpr("url AS full_url", "store_domain AS domain", "path", "scheme AS protocol",
                        "tld", "length(url) AS url_length", "'real_time_prediction' AS source",
                        "cast(NULL AS boolean) AS is_malicious", "url_id AS seq", "url_id")
    preds = s.select("url_id", F.col("confidence").alias("prediction_score"),
                     F.col("prediction").alias("predicted_class"),
                     F.lit(model_name).alias("model_name"), F.lit(version).alias("model_version"))
    return conform(urls, "urls"), preds
