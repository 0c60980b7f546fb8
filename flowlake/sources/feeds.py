"""Threat-feed sources S7-S11 and the geo lookup S12.

Every feed is read by Spark (``read.text`` / ``read.json``), so a feed of any
size is split into tasks; lists are deduplicated with ``distinct``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REPUTATION_SCHEMA = ("ip string, reputation string, score double, is_tor boolean, "
                     "categories array<string>, source string, last_updated timestamp")


def read_list(spark: SparkSession, path: str, col: str = "ip") -> DataFrame:
    """One value per line, trimmed, blanks dropped, distinct."""
    return (spark.read.text(path)
                 .select(F.trim("value").alias(col))
                 .where(F.col(col) != "")
                 .distinct())


def read_tor_exits(spark: SparkSession, path: str) -> DataFrame:
    """Lines starting 'ExitAddress'; the second token is the address."""
    lines = spark.read.text(path).where(F.col("value").startswith("ExitAddress"))
    toks = F.split(F.trim("value"), r"\s+")
    return lines.where(F.size(toks) >= 2).select(toks.getItem(1).alias("ip")).distinct()


def read_reputation_feed(spark: SparkSession, path: str, min_score: float = 2.0) -> DataFrame:
    """JSON {"reputation": [{"ip", "threat_score"}]}, keep score > min
    (a missing score counts as 0)."""
    raw = spark.read.option("multiLine", True).schema(
        "reputation array<struct<ip: string, threat_score: double>>").json(path)
    rows = raw.select(F.explode("reputation").alias("r"))
    return (rows.where(F.coalesce(F.col("r.threat_score"), F.lit(0.0)) > min_score)
                .select(F.col("r.ip").alias("ip")).where(F.col("ip").isNotNull()).distinct())


def add_entries(current: DataFrame, new: DataFrame, col: str = "ip") -> DataFrame:
    """Add feed entries to a list."""
    return current.select(col).union(new.select(col)).distinct()


def read_engine_answers(spark: SparkSession, path: str) -> DataFrame:
    """S10 input: JSON lines ``{"ip": ..., "answer": <engine verdict JSON>}``
    as (ip, json) rows for ``threat.verdict_from_engines``."""
    raw = spark.read.schema("ip string, answer string").json(path)
    return raw.select("ip", F.col("answer").alias("json"))


def load_reputation_cache(spark: SparkSession, path: str) -> DataFrame:
    """The reputation cache is a Parquet table."""
    return spark.read.schema(REPUTATION_SCHEMA).parquet(path)


def save_reputation_cache(records: DataFrame, path: str, mode: str = "append") -> None:
    """Append records (use ``threat.new_ips`` first to add only new IPs)."""
    records.select(*[F.col(c) for c in [f.split()[0] for f in REPUTATION_SCHEMA.split(", ")]
                     if c in records.columns]).write.mode(mode).parquet(path)


def geo_table(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Caller-supplied geo lookup (ip, lat, lon, country)."""
    return spark.read.format(fmt).load(path).select("ip", "lat", "lon", "country")


def replace_list(feed: DataFrame, path: str) -> DataFrame:
    """The list table at ``path`` becomes the newest feed (distinct, blanks dropped); returns it.
    The feed is written beside the old list and read from there, so it may itself read ``path``."""
    import uuid
    spark = feed.sparkSession
    col = feed.columns[0]
    fresh = f"{path.rstrip('/')}-{uuid.uuid4().hex}"
    feed.select(F.trim(F.col(col)).alias(col)).where(F.col(col) != "").distinct().write.parquet(fresh)
    spark.read.parquet(fresh).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
