"""Stateful operators over the measurement stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.operators import space
from driftline.plans.lenses import STEP, T0, cloud, inertial, scans, stream, table
from driftline.plans.registry import query
from driftline.plans.space_queries import inlier
from driftline.streaming import estimator, late, windows


@query()
def flt_late_regress(spark, sf_dir):
    """Late points by the mark that may go back; every second message runs at double speed."""
    df = scans(spark, sf_dir).selectExpr(
        "id", "sensor", "msg", "begin_us * 1000 AS begin_ns", "begin_us * 1000 + ofs_us * 1000 * CASE WHEN msg % 2 = 0 THEN 2 ELSE 1 END AS t_ns"
    )
    return late.drop_late(df).select("id", "sensor", "msg", "t_ns")


@query("""SELECT event_type AS sensor, (epoch_us(ts) // 86400000000) * 86400000000 AS window_us, CAST(floor(value / 10.0::DOUBLE) AS BIGINT) AS cell, count(*) AS n,
  round(avg(value), 6)+0e0 AS mean FROM events GROUP BY 1, 2, 3""")
def str_voxel_windows(spark, sf_dir):
    df = windows.voxel_stream(table(spark, sf_dir, "events"))
    return df.select("sensor", "window_us", F.col("cell").cast("long").alias("cell"), "n", F.expr("round(mean, 6) + 0e0 AS mean"))


def measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event points with the plane of their five nearest map points, if all five lie on it."""
    seen = stream(spark, sf_dir).selectExpr("id", "user_id", "t_us", "(x - 24.5D) / 7 AS x", "y / 2.5D AS y", "z - 5 AS z")
    planes = space.plane_of(space.nearest(seen.select("id", "x", "y", "z"), cloud(spark, sf_dir))).where(inlier("0.4e0"))
    zero = [f"0e0 AS {c}" for c in ("ax", "ay", "az", "gx", "gy", "gz")]
    # Merged, as the planes come by qid; a side that looks small would go to the driver.
    return seen.select(F.col("id").alias("qid"), "user_id", "t_us").hint("merge").join(planes, "qid").selectExpr(
        "CAST(user_id AS STRING) AS run", f"(t_us - {T0}) div {STEP} AS segment", f"((t_us - {T0}) % {STEP}) / {STEP}e0 AS u", "1 AS kind", "qid AS id",
        "qx AS bx", "qy AS by", "qz AS bz", "nx", "ny", "nz", "d", "0.01e0 AS w_pt", *zero,
    )


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inertial rows of the same runs."""
    zero = [f"0e0 AS {c}" for c in ("bx", "by", "bz", "nx", "ny", "nz", "d", "w_pt")]
    return inertial(spark, sf_dir).selectExpr(
        "CAST(user_id AS STRING) AS run", f"(t_us - {T0}) div {STEP} AS segment", f"((t_us - {T0}) % {STEP}) / {STEP}e0 AS u", "0 AS kind", "id", *zero,
        "ax * 0.1e0 AS ax", "ay * 0.1e0 AS ay", "az * 9.81e0 AS az", "gx * 0.1e0 AS gx", "gy * 0.1e0 AS gy", "gz * 0.1e0 AS gz",
    )


def _shown(df: DataFrame) -> DataFrame:
    return df.select("run", "segment", "n", "used", *[F.expr(f"round({c}, 4) + 0e0 AS {c}") for c in ("px", "py", "pz", "qw")])


@query()
def str_filter_lo(spark, sf_dir):
    return _shown(estimator.estimate(measurements(spark, sf_dir), estimator.Settings()))


@query()
def str_filter_lio(spark, sf_dir):
    both = measurements(spark, sf_dir).unionByName(samples(spark, sf_dir))
    return _shown(estimator.estimate(both, estimator.Settings(), inertial=True))


@query("""WITH l AS (SELECT event_id AS id, user_id, epoch_us(ts) AS t_us FROM events), s AS (SELECT *, (t_us - 1704067200000000) // 21600000000 AS segment FROM l),
  r AS (SELECT *, row_number() OVER (PARTITION BY user_id, segment ORDER BY t_us, id) - 1 AS rn FROM s)
  SELECT CAST(user_id AS VARCHAR) AS run, segment, rn // 2 AS batch, count(*) AS n, max(t_us) AS last_us FROM r GROUP BY ALL""")
def str_batches(spark, sf_dir):
    """Batches of at most two points that end with their segment, in order of time."""
    df = stream(spark, sf_dir).selectExpr("CAST(user_id AS STRING) AS run", f"(t_us - {T0}) div {STEP} AS segment", "t_us", "id")
    df = df.selectExpr("*", "row_number() OVER (PARTITION BY run, segment ORDER BY t_us, id) - 1 AS rn")
    return df.groupBy("run", "segment", F.expr("CAST(rn div 2 AS BIGINT)").alias("batch")).agg(F.count("*").alias("n"), F.max("t_us").alias("last_us"))
