"""Feed scans: landed text of threat feeds into URL and address tables.

Each parser takes a DataFrame of raw lines with a position, so it works on ``spark.read.text`` of
a large landing folder as well as on a stream; the ``read_*`` helpers read files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from linkguard.functions.sqlutil import add

JSON_ENTRY = "array<struct<url:string, phish_detail_url:string>>"
MALWARE_JSON = "urls array<struct<url:string>>"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files with a position that keeps file order."""
    return spark.read.text(path).select(
        F.col("value").alias("line"), F.monotonically_increasing_id().alias("pos"))


def read_csv_feed(spark: SparkSession, path: str, comment: str | None = None,
                  header: bool = True) -> DataFrame:
    """Quoted CSV files; columns as named in the header (or ``_c0`` ...)."""
    reader = spark.read.option("header", header).option("quote", '"').option("escape", '"')
    return (reader.option("comment", comment) if comment else reader).csv(path)


def first_n(rows: DataFrame, limit: int | None) -> DataFrame:
    return rows.orderBy("pos").limit(limit) if limit is not None else rows


def scan_json(lines: DataFrame, limit: int | None = None) -> DataFrame:
    """JSON objects or arrays of them: ``url``, else ``phish_detail_url``; only ``http*``."""
    df = lines.select("pos", F.posexplode(F.from_json("line", JSON_ENTRY)).alias("i", "e"))
    df = first_n(df, limit)
    url = F.coalesce(F.expr("nullif(e.url, '')"), F.col("e.phish_detail_url"))
    return df.select("pos", url.alias("full_url")).where("startswith(full_url, 'http')")


def scan_csv(lines: DataFrame, limit: int | None = None) -> DataFrame:
    """Quoted CSV with a header line first (lowest position); the URL is the second column."""
    head = lines.agg(F.min("pos").alias("head"))
    body = lines.join(F.broadcast(head), F.col("pos") > F.col("head")).drop("head")
    df = first_n(body, limit).select("pos", F.from_csv("line", "id string, url string, rest string")
                                     .alias("c"))
    return df.select("pos", F.trim("c.url").alias("full_url")).where(
        "startswith(full_url, 'http')")


def scan_lines(lines: DataFrame, limit: int | None = None) -> DataFrame:
    """One URL per line."""
    keep = [c for c in lines.columns if c != "line"]
    return first_n(lines, limit).select(*keep, F.trim("line").alias("full_url")).where(
        "startswith(full_url, 'http')")


def scan_malware_csv(lines: DataFrame, limit: int | None = None) -> DataFrame:
    """Quoted CSV with ``#`` comments; the URL is the third column. The limit counts URLs."""
    df = lines.where("NOT startswith(line, '#')").select(
        "pos", F.from_csv("line", "id string, date string, url string, rest string").alias("c"))
    return first_n(df.select("pos", F.trim("c.url").alias("full_url")).where(
        "startswith(full_url, 'http')"), limit)


def scan_malware_json(docs: DataFrame, limit: int | None = None) -> DataFrame:
    """Documents with a ``urls`` array; every non-empty URL."""
    df = docs.select("pos", F.from_json("line", MALWARE_JSON).alias("d"))
    df = df.select("pos", F.posexplode("d.urls").alias("i", "e"))
    return first_n(df, limit).select("pos", F.col("e.url").alias("full_url")).where(
        "full_url <> ''")


def url_records(urls: DataFrame, source: str, label: bool | None) -> DataFrame:
    """Shape URL text into stored columns; only the first authority split, no normalisation."""
    df = add(urls, protocol="lower(regexp_extract(full_url, '^([a-zA-Z][a-zA-Z0-9+.-]*):', 1))",
             domain="regexp_extract(full_url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1)",
             path="regexp_extract(full_url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1)")
    return add(df, path="CASE WHEN path = '' THEN '/' ELSE path END",
               tld="CASE WHEN contains(domain, '.') THEN substring_index(domain, '.', -1) "
                   "ELSE '' END",
               url_length="length(full_url)").withColumns(
        {"source": F.lit(source), "is_malicious": F.lit(label).cast("boolean")})


def ip_blocklist(lines: DataFrame) -> DataFrame:
    """Distinct IPv4-shaped first tokens; comments and blanks dropped, ``/cidr`` removed."""
    df = add(lines, t="btrim(line, ' \\t\\n\\r')").where("t <> '' AND NOT startswith(t, '#')")
    df = add(df, ip="substring_index(CASE WHEN contains(t, ' ') THEN substring_index(t, ' ', 1) "
                    "ELSE t END, '/', 1)")
    return df.where("ip RLIKE '^[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+$'").select("ip").distinct()


def read_brands(spark: SparkSession, path: str) -> DataFrame:
    """Brand dictionary file: ``{"brands": [...], "high_value_brands": [...]}``."""
    doc = spark.read.schema("brands array<string>, high_value_brands array<string>").option(
        "multiLine", True).json(path)
    rows = doc.select(F.posexplode("brands").alias("pos", "brand"),
                      F.col("high_value_brands").alias("high"))
    return brand_dim(rows.select("brand", "pos", F.exists(
        "high", lambda h: F.lower(h) == F.lower("brand")).alias("high")))


def brand_dim(rows: DataFrame) -> DataFrame:
    """Lower-case distinct brands with their first position and the high-value flag."""
    return rows.groupBy(F.lower("brand").alias("brand")).agg(
        F.min("pos").cast("int").alias("brand_pos"), F.max("high").alias("high_value"))


def feature_vectors(urls: DataFrame, cache: DataFrame, names: list[str]) -> DataFrame:
    """JSON vectors to wide numeric columns for labelled URLs; missing features are 0."""
    df = urls.where("is_malicious IS NOT NULL").select("url_id", "domain", "is_malicious").join(
        cache.select("url_id", "feature_vector"), "url_id", "left")
    df = df.withColumn("m", F.from_json("feature_vector", "map<string,double>"))
    return df.select(
        "url_id", F.col("is_malicious").cast("int").alias("label"),
        F.expr("regexp_replace(lower(domain), '^www[.]', '')").alias("domain"),
        *[F.coalesce(F.col("m").getItem(n), F.lit(0.0)).alias(n) for n in names])
