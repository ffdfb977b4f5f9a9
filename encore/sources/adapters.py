"""Play logs made from the synthetic tables (see FIXTURES.md): one row is one play."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.withColumns({c: F.col(c).cast("timestamp") for c, t in df.dtypes if t == "timestamp_ntz"})


def _lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    skip = F.when(F.col("l_returnflag") == "N", 0).when(F.col("l_returnflag") == "A", 1).otherwise(2)
    part = table(spark, sf_dir, "part")
    return table(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_partkey").alias("song_id"), F.col("p_name").alias("title"), "p_brand", "p_type", F.col("l_shipdate").alias("ts"),
        skip.alias("skip_type"), (skip != 0).cast("int").alias("is_skipped"), (F.col("l_linestatus") == "F").cast("int").alias("is_proactive"),
        (F.col("l_discount") * 10).alias("proactive_score"), (F.lit(1990) + F.col("p_size") % 30).alias("release_year"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("tie"),
    )


def plays_l(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A long, even log: lineitem as plays of parts."""
    return _lineitem(spark, sf_dir).withColumnsRenamed({"p_brand": "artist", "p_type": "genre"})


def plays_d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The long log thinned to exponential life cycles whose length depends on the artist."""
    tau = {"ECONOMY": 90, "STANDARD": 180, "PROMO": 365, "SMALL": 730, "LARGE": 1500, "MEDIUM": 1_000_000}
    plays = _lineitem(spark, sf_dir).withColumnsRenamed({"p_type": "artist", "p_brand": "genre"})
    birth = F.expr("timestamp'1995-01-02' + make_dt_interval(cast(90 * (song_id % 3) as int))")
    days = (F.unix_timestamp("ts") - F.unix_timestamp("birth")) / 86400.0
    u = F.conv(F.substring(F.md5(F.concat_ws(":", *(F.col(f"tie.{c}").cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")))), 1, 8), 16, 10).cast("double") / 4294967296.0
    length = F.element_at(F.create_map(*(F.lit(float(x)) if isinstance(x, int) else F.lit(x) for kv in tau.items() for x in kv)), F.col("artist"))
    return plays.withColumn("birth", birth).filter((F.col("ts") >= F.col("birth")) & (u < F.exp(-days / length))).drop("birth")


def plays_e(spark: SparkSession, sf_dir: str, gap_minutes: int = 30) -> DataFrame:
    """A short, dense log: events as plays, with users, sessions and runs of one artist."""
    song = F.regexp_extract("props", r"(\d+)", 1).cast("long")
    skip = F.when(F.col("event_type") == "error", 2).when(F.col("event_type") == "signup", 1).otherwise(0)
    own = Window.partitionBy("user_id").orderBy("ts", "event_id")
    plays = table(spark, sf_dir, "events").select(
        "event_id", "user_id", "ts", song.alias("song_id"), (song % 20).alias("artist"), F.concat(F.lit("song "), song).alias("title"), skip.alias("skip_type"), (skip != 0).cast("int").alias("is_skipped"),
        (F.col("event_type") == "purchase").cast("int").alias("is_proactive"), (F.col("value") / 500).alias("proactive_score"), F.struct("event_id").alias("tie"),
    )
    since = F.unix_timestamp("ts") - F.unix_timestamp(F.lag("ts").over(own))
    new = F.coalesce((since > gap_minutes * 60).cast("int"), F.lit(1))
    return plays.withColumns({"is_session_start": new, "is_artist_deep_dive": F.coalesce((F.lag("artist").over(own) == F.col("artist")).cast("int"), F.lit(0))})
