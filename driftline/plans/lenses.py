"""Views of the given tables as point clouds, scans, inertial samples and trajectories.

Times are long counts of ns or us, never timestamps, as those keep microseconds only.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

T0 = 1_704_067_200_000_000  # us, start of the trajectory
DAY = 86_400_000_000
STEP = 21_600_000_000  # us between control points


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L1: id, sensor, x, y, z, t_ns of map points."""
    xyz = [(F.col("embedding")[i].cast("double") * 10).alias(n) for i, n in enumerate("xyz")]
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("label").alias("sensor"), *xyz, (F.col("vec_id") * 1_000_000).alias("t_ns")
    )


def stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L2: stamped measurements."""
    return (
        table(spark, sf_dir, "events")
        .select(
            F.col("event_id").alias("id"),
            F.unix_micros(F.col("ts").cast("timestamp")).alias("t_us"),
            "user_id",
            F.col("event_type").alias("sensor"),
            "value",
            F.get_json_object("props", "$.k").cast("long").alias("k"),
        )
        .selectExpr("*", "k & 48 AS tag", "k % 4 AS line", "value / 10 AS x", "(k - 50) / 5.0D AS y", "(user_id % 40) / 4.0D AS z")
    )


def scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L3: flat point rows of one message per sensor and day, pos being the index in it."""
    return (
        stream(spark, sf_dir)
        .selectExpr("*", f"(t_us - {T0}) div {DAY} AS msg")
        .selectExpr("*", f"{T0} + msg * {DAY} AS begin_us")
        .selectExpr("*", "t_us - begin_us AS ofs_us", "row_number() OVER (PARTITION BY sensor, msg ORDER BY t_us, id) - 1 AS pos")
    )


def inertial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L4: acceleration and angular rate samples."""
    return (
        stream(spark, sf_dir)
        .where(F.col("sensor").isin("view", "signup"))
        .selectExpr(
            "id", "t_us", "user_id", "(k - 50) / 100.0D AS ax", "(user_id - 75) / 100.0D AS ay", "1.0D + value / 1000 AS az",
            "(k - 50) / 50.0D AS gx", "(user_id - 75) / 50.0D AS gy", "value / 500 AS gz",
        )
    )


def knots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L5: control points with position and small half-angle rotation deltas."""
    return (
        stream(spark, sf_dir)
        .groupBy(F.expr(f"(t_us - {T0}) div {STEP}").alias("idx"))
        .agg(
            F.avg("value").alias("px"),
            F.avg(F.col("k").cast("double")).alias("py"),
            F.avg(F.col("user_id").cast("double")).alias("pz"),
        )
        .selectExpr("'events' AS run", "*", "(px - 245) / 1000 AS dx", "(py - 50) / 1000 AS dy", "(pz - 75) / 1000 AS dz")
    )


def bulk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L6: many points, for volume."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey AS id", "l_linenumber AS ln", "l_quantity AS x", "l_extendedprice / 1000 AS y", "l_discount * 100 AS z"
    )


#: The same views in DuckDB SQL, in order of use.
SQL = f"""
l1 AS (SELECT vec_id AS id, label AS sensor, embedding[1]::DOUBLE * 10 AS x, embedding[2]::DOUBLE * 10 AS y, embedding[3]::DOUBLE * 10 AS z,
  vec_id * 1000000 AS t_ns FROM embeddings),
l2 AS (SELECT *, k & 48 AS tag, k % 4 AS line, value / 10 AS x, (k - 50) / 5.0::DOUBLE AS y, (user_id % 40) / 4.0::DOUBLE AS z
  FROM (SELECT event_id AS id, epoch_us(ts) AS t_us, user_id, event_type AS sensor, value, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)),
l3 AS (SELECT *, t_us - begin_us AS ofs_us, row_number() OVER (PARTITION BY sensor, msg ORDER BY t_us, id) - 1 AS pos
  FROM (SELECT *, {T0} + msg * {DAY} AS begin_us FROM (SELECT *, (t_us - {T0}) // {DAY} AS msg FROM l2))),
l4 AS (SELECT id, t_us, (k - 50) / 100.0::DOUBLE AS ax, (user_id - 75) / 100.0::DOUBLE AS ay, 1.0::DOUBLE + value / 1000 AS az,
  (k - 50) / 50.0::DOUBLE AS gx, (user_id - 75) / 50.0::DOUBLE AS gy, value / 500 AS gz FROM l2 WHERE sensor IN ('view', 'signup')),
l5 AS (SELECT *, (px - 245) / 1000 AS dx, (py - 50) / 1000 AS dy, (pz - 75) / 1000 AS dz
  FROM (SELECT (t_us - {T0}) // {STEP} AS idx, avg(value) AS px, avg(k::DOUBLE) AS py, avg(user_id::DOUBLE) AS pz FROM l2 GROUP BY 1)),
l6 AS (SELECT l_orderkey AS id, l_linenumber AS ln, l_quantity AS x, l_extendedprice / 1000 AS y, l_discount * 100 AS z FROM lineitem)
"""


def oracle(body: str, more: str = "") -> str:
    """DuckDB SQL over the lenses that body (and more) name."""
    parts = {}
    for part in SQL.strip().split("),\nl"):
        text = part if part.startswith("l1") else "l" + part
        parts[text[:2]] = text if text.endswith(")") and text.startswith("l6") else text + ")"
    need: list[str] = []

    def ask(text: str) -> None:
        for name in parts:
            if name not in need and re.search(rf"\b{name}\b", text):
                ask(parts[name].split(" AS ", 1)[1])
                need.append(name)

    ask(f"{more} {body}")
    views = ", ".join([*(parts[n] for n in need), *([more] if more else [])])
    return f"WITH RECURSIVE {views} {body}"
