"""Stages of the estimation loop as batch queries: gates, collection, map set-up, deferred scans, reconstruction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.functions import scalars as S
from driftline.operators import space, stages
from driftline.operators import trajectory as J
from driftline.plans.lenses import DAY, STEP, T0, cloud, inertial, knots, oracle, scans, stream
from driftline.plans.registry import query
from driftline.plans.scan_queries import OFF, SENSORS, points
from driftline.plans.space_queries import INSIDE, _boxes_sql, boxes
from driftline.plans.trajectory_queries import D, P, SHOW, TURNED, WORLD, turned
from driftline.sources import messages
from driftline.sources.config import sensor_table


def _visual(spark: SparkSession, sf_dir: str, sensor: str, kind: str) -> DataFrame:
    df = messages.decode_visual(points(spark, sf_dir, sensor), kind)
    return df.select("id", "sensor", "msg", "t_ns", F.col("off_ms").cast("double").alias("off_ms"), *S.rounded(6, refl="refl"))


def _visual_sql(sensor: str, ofs: str, keep: str) -> str:
    return oracle(f"""SELECT id, sensor, msg, begin_us * 1000 + ofs_ns AS t_ns, off_ms::DOUBLE AS off_ms, round(value, 6)+0e0 AS refl
      FROM (SELECT *, {OFF.format('ofs_ns')} AS off_ms FROM (SELECT *, {ofs} AS ofs_ns FROM l3 WHERE sensor = '{sensor}')) WHERE {keep}""")


_TAGGED, _AHEAD = "pos >= 1 AND (tag & 48) IN (0, 16)", "off_ms >= 0"


@query(_visual_sql("click", "ofs_us * 1000", _TAGGED))
def src_visual_mid70(spark, sf_dir):
    return _visual(spark, sf_dir, "click", "Mid70Avia")


@query(_visual_sql("signup", "ofs_us * 1000", _TAGGED))
def src_visual_hap(spark, sf_dir):
    return _visual(spark, sf_dir, "signup", "HAP360")


@query(_visual_sql("view", "ofs_us * 1000", _TAGGED))
def src_visual_avia(spark, sf_dir):
    return _visual(spark, sf_dir, "view", "AviaLateFirst")


@query(_visual_sql("purchase", "floor(t_us / 1e6)::BIGINT * 1000000000 + trunc((t_us / 1e6 - floor(t_us / 1e6)) * 1e9)::BIGINT - begin_us * 1000", _AHEAD))
def src_visual_hesai(spark, sf_dir):
    return _visual(spark, sf_dir, "purchase", "Hesai")


@query(_visual_sql("error", "trunc((t_us * 1000)::DOUBLE)::BIGINT - begin_us * 1000", _AHEAD))
def src_visual_mid360(spark, sf_dir):
    return _visual(spark, sf_dir, "error", "Mid360Boxi")


_DIM = ", ".join("('" + s.name + "', " + ", ".join(f"{v!r}::DOUBLE" for v in (*s.body_frame()[0], *s.body_frame()[1])) + ")" for s in SENSORS)
DIM = f"dim AS (SELECT * FROM (VALUES {_DIM}) v(sensor, rw, rx, ry, rz, tx, ty, tz))"


def dimension(spark: SparkSession) -> DataFrame:
    return sensor_table(spark, SENSORS).withColumnRenamed("name", "sensor")


@query(oracle(f"""SELECT bool_and(head IS NOT NULL) AS all_seen, min(greatest(head, 0)) AS start_us, CAST(sum(early) AS BIGINT) AS n_early,
  bool_and(head IS NOT NULL) AND sum(early) >= 100 AS ready FROM (
  SELECT d.sensor, f.head, (SELECT count(*) FROM l2 p WHERE p.sensor = d.sensor AND p.t_us < (SELECT min(t_us) FROM l2) + 5 * {DAY}) AS early
  FROM dim d LEFT JOIN (SELECT sensor, min(t_us) AS head FROM l2 GROUP BY sensor) f ON f.sensor = d.sensor)""", DIM))
def str_init_gate(spark, sf_dir):
    """Whether every configured sensor has a point, the start time, and whether enough points lie in the first days."""
    return stages.start_gate(stream(spark, sf_dir), dimension(spark), 5 * DAY, 100).select("all_seen", "start_us", "n_early", "ready")


@query(oracle(f"""SELECT id, sensor, round({S.rotate(S.quat('r'), ('x', 'y', 'z'))[0]} + tx, 5)+0e0 AS wx, round({S.rotate(S.quat('r'), ('x', 'y', 'z'))[1]} + ty, 5)+0e0 AS wy,
  round({S.rotate(S.quat('r'), ('x', 'y', 'z'))[2]} + tz, 5)+0e0 AS wz FROM l2 JOIN dim USING (sensor) WHERE t_us < (SELECT min(t_us) FROM l2) + 5 * {DAY}""", DIM))
def str_map_init(spark, sf_dir):
    """Points of the first days in the world, by the start pose and the sensors' places: what the map is built of."""
    first = stages.start_points(stream(spark, sf_dir), 5 * DAY)
    return stages.to_body(first, dimension(spark)).select("id", "sensor", *S.rounded(5, **{f"w{c}": f"b{c}" for c in "xyz"}))


_TICKS = f"""ticks AS (SELECT DISTINCT msg, {T0} + msg * {DAY} AS max_us FROM l3), seen AS (SELECT k.msg, k.max_us, d.sensor, max(p.t_us) AS newest
  FROM ticks k CROSS JOIN dim d LEFT JOIN l3 p ON p.sensor = d.sensor AND p.msg <= k.msg GROUP BY k.msg, k.max_us, d.sensor),
  imu AS (SELECT k.msg, max(p.t_us) AS imu_us FROM ticks k LEFT JOIN l4 p ON (p.t_us - {T0}) // {DAY} <= k.msg GROUP BY k.msg)"""


@query(oracle(f"""SELECT msg, min(newest) AS head_us, coalesce(bool_and(newest IS NOT NULL) AND min(newest) > max_us + {STEP}, false) AS points_ready, coalesce(any_value(imu_us) > max_us, false) AS imu_ready
  FROM seen JOIN imu USING (msg) GROUP BY msg, max_us""", f"{DIM}, {_TICKS}"))
def str_collect_gate(spark, sf_dir):
    """Per day whether all sensors, and the inertial samples, have passed the end of the trajectory."""
    ticks = scans(spark, sf_dir).select("msg").distinct().selectExpr("msg", f"{T0} + msg * {DAY} AS max_us")
    imu = inertial(spark, sf_dir).selectExpr("t_us", f"(t_us - {T0}) div {DAY} AS msg")
    return stages.collect_gate(ticks, scans(spark, sf_dir), imu, dimension(spark), STEP)


@query(oracle(f"""SELECT id, sensor, msg FROM (SELECT *, row_number() OVER (PARTITION BY msg ORDER BY sensor, t_us, id) AS rn FROM l3)
  WHERE rn <= 100 AND (4 * (msg + 1) < 10 OR t_us >= {T0} + (msg + 1) * {DAY} - 1 - {STEP})"""))
def flt_stale(spark, sf_dir):
    """At most 100 points a day are taken; of those, once ten knots are there, the ones older than a step before the end are dropped."""
    df = scans(spark, sf_dir).selectExpr("*", f"{T0} + (msg + 1) * {DAY} - 1 AS max_us", "4 * (msg + 1) AS n_knots")
    return stages.collect_points(df, 100, STEP).select("id", "sensor", "msg")


@query(oracle(f"SELECT id, t_us FROM (SELECT *, (t_us - {T0}) // {DAY} AS msg FROM l4 WHERE t_us >= {T0} + 2 * {DAY}) WHERE t_us >= {T0} + (msg + 1) * {DAY} - 1 - {STEP}"))
def flt_imu_prune(spark, sf_dir):
    """Samples before the trajectory's first time go at collection, those older than a step before its end before the update."""
    df = inertial(spark, sf_dir).selectExpr("*", f"{T0} + 2 * {DAY} AS min_us", f"{T0} + ((t_us - {T0}) div {DAY} + 1) * {DAY} - 1 AS max_us")
    return stages.prune_samples(df, STEP).select("id", "t_us")


@query(oracle(f"SELECT sensor, msg, end_us, CASE WHEN end_us < {T0} + 3 * {DAY} THEN 'gone' WHEN end_us <= {T0} + 20 * {DAY} THEN 'ready' ELSE 'waits' END AS state FROM (SELECT sensor, msg, max(t_us) AS end_us FROM l3 GROUP BY sensor, msg)"))
def flt_expired_scan(spark, sf_dir):
    """Scans that end before the trajectory's domain, inside it, or after it."""
    return stages.scan_state(scans(spark, sf_dir), T0 + 3 * DAY, T0 + 20 * DAY).select("sensor", "msg", "end_us", "state")


SHIPPED = "SELECT idx, min(version) AS version FROM (SELECT idx, idx // 10 AS version FROM l5 UNION SELECT idx, (idx + 3) // 10 FROM l5) GROUP BY idx"


@query(oracle(f"""SELECT id, t.sensor, s.version, {SHOW} FROM turned t JOIN (SELECT e.sensor, e.msg, f.version FROM (SELECT sensor, msg, max(t_us) AS end_us FROM l3 GROUP BY sensor, msg) e
  JOIN ({SHIPPED}) f ON f.idx = (e.end_us - {T0}) // {STEP} + 1) s ON t.sensor = s.sensor AND (t.t_us - {T0}) // {DAY} = s.msg""", TURNED))
def str_deferred_scans(spark, sf_dir):
    """Points of each scan in the world, with the increment that let it go: the first that ships the knot behind the scan's end."""
    increments = J.to_increments(knots(spark, sf_dir), 10, 3, T0, STEP)
    freed = stages.released_scans(scans(spark, sf_dir), increments, T0, STEP)
    df = turned(spark, sf_dir).withColumn("msg", F.expr(f"(t_us - {T0}) div {DAY}"))
    return df.join(freed.select("sensor", "msg", "version"), ["sensor", "msg"]).select("id", "sensor", "version", *S.rounded(5, **WORLD))


_MOVED_KNOTS = f"""moved AS (SELECT idx, version, px + version / 8e0 AS px, py - version / 4e0 AS py, pz, dx, dy, dz + version / 1e3 AS dz FROM (
  SELECT *, idx // 10 AS version FROM l5 UNION SELECT *, (idx + 3) // 10 FROM l5)), gate AS (SELECT version FROM (SELECT version, {T0} + (max(idx) - 4) * {STEP} AS start_t FROM moved GROUP BY version) WHERE start_t >= {T0} + 4 * {DAY})"""


@query(oracle("SELECT idx, max(version) AS version, " + ", ".join(f"round(arg_max({c}, version), 9)+0e0 AS {c}" for c in P + D) + " FROM moved WHERE version IN (SELECT version FROM gate) GROUP BY idx", _MOVED_KNOTS))
def str_reconstruct(spark, sf_dir):
    """The trajectory from increments that keep correcting it, those before the start time being ignored."""
    sent = J.to_increments(knots(spark, sf_dir), 10, 3, T0, STEP)
    change = "transform(knots, k -> named_struct('idx', k.idx, 'px', k.px + version / 8e0, 'py', k.py - version / 4e0, 'pz', k.pz, 'dx', k.dx, 'dy', k.dy, 'dz', k.dz + version / 1e3))"
    done = J.apply_increments(stages.after_start(sent.withColumn("knots", F.expr(change)), T0 + 4 * DAY))
    return done.select("idx", "version", *S.rounded(9, **{c: c for c in P + D}))


@query(oracle(f"SELECT box_id, count(id) AS n FROM (SELECT box_id FROM boxes WHERE box_id < 6) LEFT JOIN (SELECT p.id, min(b.box_id) AS box_id FROM l1 p JOIN boxes b ON b.box_id < 6 AND {INSIDE} GROUP BY p.id) USING (box_id) GROUP BY box_id", _boxes_sql(1.5)))
def agg_deleted_per_box(spark, sf_dir):
    """Points that each box deletes; one in several boxes counts for the first."""
    own = boxes(spark, sf_dir, 1.5).where("box_id < 6")
    first = space.box_join(cloud(spark, sf_dir), own, 4.0).groupBy("id").agg(F.min("box_id").alias("box_id"))
    return own.select("box_id").join(first, "box_id", "left").groupBy("box_id").agg(F.count("id").alias("n"))


@query(oracle(f"SELECT msg, greatest(a.t, b.t) AS target_us FROM (SELECT (t_us - {T0}) // {DAY} AS msg, max(t_us) AS t FROM l2 GROUP BY 1) a FULL JOIN (SELECT (t_us - {T0}) // {DAY} AS msg, max(t_us) AS t FROM l4 GROUP BY 1) b USING (msg)"))
def agg_newest(spark, sf_dir):
    """How far each day's points and inertial samples carry the trajectory."""
    both = stream(spark, sf_dir).select("t_us").unionByName(inertial(spark, sf_dir).select("t_us"))
    return both.groupBy(F.expr(f"(t_us - {T0}) div {DAY}").alias("msg")).agg(F.max("t_us").alias("target_us"))


HALF, NEAR, MOVE = 12.0, 10.0, 3.5
_EXT = "ext AS (SELECT msg, " + ", ".join(f"min(m{c}) AS lo{c}, greatest(max(m{c}), 2.2250738585072014e-308) AS hi{c}" for c in "xyz") + " FROM (SELECT sensor, msg, avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM l3 GROUP BY sensor, msg) GROUP BY msg), num AS (SELECT *, row_number() OVER (ORDER BY msg) AS n FROM ext)"


def _box_sql(c: str) -> str:
    lower, upper = f"abs(e.lo{c} - b.lo_{c}) <= {NEAR}e0", f"abs(e.hi{c} - b.hi_{c}) <= {NEAR}e0"
    return f"(CASE WHEN {lower} THEN -{MOVE}e0 WHEN {upper} THEN {MOVE}e0 ELSE 0e0 END)"


@query(oracle("SELECT msg, " + ", ".join(f"round(lo_{c}, 6)+0e0 AS lo_{c}, round(hi_{c}, 6)+0e0 AS hi_{c}, m{c}" for c in "xyz") + " FROM walk",
  _EXT + ", walk AS (SELECT n, msg, " + ", ".join(f"lo{c} - {HALF}e0 AS lo_{c}, hi{c} + {HALF}e0 AS hi_{c}, 0e0 AS m{c}" for c in "xyz") + " FROM num WHERE n = 1 UNION ALL SELECT e.n, e.msg, "
  + ", ".join(f"b.lo_{c} + {_box_sql(c)}, b.hi_{c} + {_box_sql(c)}, {_box_sql(c)}" for c in "xyz") + " FROM walk b JOIN num e ON e.n = b.n + 1)"))
def str_fov_walk(spark, sf_dir):
    """The local map's box from day to day: it moves when a sensor comes near an edge; mx .. mz are the moves."""
    mean = scans(spark, sf_dir).groupBy("sensor", "msg").agg(*[F.avg(c).alias(f"m{c}") for c in "xyz"])
    ends = [F.min(f"m{c}").alias(f"lo{c}") for c in "xyz"] + [F.greatest(F.max(f"m{c}"), F.lit(2.2250738585072014e-308)).alias(f"hi{c}") for c in "xyz"]
    extents = mean.groupBy("msg").agg(*ends).withColumn("run", F.lit("events"))
    walked = stages.walk_box(extents, HALF, NEAR, MOVE)
    return walked.select("msg", *S.rounded(6, **{f"{e}_{c}": f"{e}_{c}" for c in "xyz" for e in ("lo", "hi")}), *[f"m{c}" for c in "xyz"])


@query(oracle("SELECT msg, count(*) AS n FROM slabs s JOIN l3 p ON p.msg <= s.msg AND p.x >= s.lo_x AND p.x < s.hi_x AND p.y >= s.lo_y AND p.y < s.hi_y AND p.z >= s.lo_z AND p.z < s.hi_z GROUP BY s.msg".replace("SELECT msg", "SELECT s.msg"),
  _EXT + ", walk AS (SELECT n, msg, " + ", ".join(f"lo{c} - {HALF}e0 AS lo_{c}, hi{c} + {HALF}e0 AS hi_{c}, 0e0 AS m{c}" for c in "xyz") + " FROM num WHERE n = 1 UNION ALL SELECT e.n, e.msg, "
  + ", ".join(f"b.lo_{c} + {_box_sql(c)}, b.hi_{c} + {_box_sql(c)}, {_box_sql(c)}" for c in "xyz") + " FROM walk b JOIN num e ON e.n = b.n + 1), before AS (SELECT msg, mx, my, mz, "
  + ", ".join(f"lo_{c} - m{c} AS lo_{c}, hi_{c} - m{c} AS hi_{c}" for c in "xyz") + " FROM walk), slabs AS ("
  + " UNION ALL ".join("SELECT msg, " + ", ".join((f"CASE WHEN m{c} < 0 THEN hi_{c} + m{c} ELSE lo_{c} END AS lo_{c}, CASE WHEN m{c} > 0 THEN lo_{c} + m{c} ELSE hi_{c} END AS hi_{c}") if c == axis else f"lo_{c}, hi_{c}" for c in "xyz") + f" FROM before WHERE m{axis} <> 0" for axis in "xyz") + ")"))
def str_fov_slabs(spark, sf_dir):
    """Points so far that lie in the slabs which the box leaves behind, by the day of the move."""
    mean = scans(spark, sf_dir).groupBy("sensor", "msg").agg(*[F.avg(c).alias(f"m{c}") for c in "xyz"])
    ends = [F.min(f"m{c}").alias(f"lo{c}") for c in "xyz"] + [F.greatest(F.max(f"m{c}"), F.lit(2.2250738585072014e-308)).alias(f"hi{c}") for c in "xyz"]
    walked = stages.walk_box(mean.groupBy("msg").agg(*ends).withColumn("run", F.lit("events")), HALF, NEAR, MOVE)
    slabs = stages.vacated_slabs(walked).withColumnRenamed("msg", "moved_at")
    pts = scans(spark, sf_dir).select("id", "msg", "x", "y", "z")
    return space.box_join(pts, slabs, 8.0).where("msg <= moved_at").groupBy(F.col("moved_at").alias("msg")).agg(F.count("*").alias("n"))


@query(oracle("SELECT idx, " + S.rounded_sql(5, **{f"h{i}{j}": f"sum({w})" for i in range(4) for j in range(i, 4) for w in [f"w{i}*w{j}*100e0"]}, **{f"b{i}": f"sum(w{i}*value*100e0)" for i in range(4)})
  + " FROM (SELECT *, (1-u)*(1-u)*(1-u)/6e0 AS w0, (3*u*u*u - 6*u*u + 4)/6e0 AS w1, (-3*u*u*u + 3*u*u + 3*u + 1)/6e0 AS w2, u*u*u/6e0 AS w3 FROM (SELECT value, (t_us - "
  + f"{T0}) // {STEP} AS idx, ((t_us - {T0}) % {STEP}) / {STEP}e0 AS u FROM l2)) GROUP BY idx"))
def agg_spline_equations(spark, sf_dir):
    """Normal equations of each segment's four control points, weights 1 / 0.01: sums of products, by map-side aggregation."""
    df = stream(spark, sf_dir).selectExpr("value", f"(t_us - {T0}) div {STEP} AS idx", f"((t_us - {T0}) % {STEP}) / {STEP}e0 AS u")
    df = df.selectExpr("idx", "value", *[f"{S.weight(row, 'u')} AS w{k}" for k, row in enumerate(S.BLEND)])
    return stages.normal_equations(df, ["idx"], [f"w{k}" for k in range(4)], "value", 100.0).select(
        "idx", *S.rounded(5, **{f"h{i}{j}": f"h{i}{j}" for i in range(4) for j in range(i, 4)}, **{f"b{i}": f"b{i}" for i in range(4)})
    )
