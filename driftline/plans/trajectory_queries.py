"""Trajectories: increments, segments, poses, resampling and what is published of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftline.functions import scalars as S
from driftline.operators import trajectory as J
from driftline.plans.lenses import DAY, STEP, T0, knots, oracle, stream
from driftline.plans.registry import query
from driftline.plans.scan_queries import SENSORS
from driftline.sources.config import sensor_table

STEP_S = STEP / 1e6
HOUR = 3_600_000_000
P = ("px", "py", "pz")
D = ("dx", "dy", "dz")

_LAGS = ", ".join(
    f"{'lag' if k < 2 else 'lead'}({c}, {abs(k - 2)}) OVER w AS {c}{k}" if k != 2 else f"{c} AS {c}2" for c in P + D for k in range(4)
)
KN = """kn AS (SELECT idx, px, py, pz, dx, dy, dz FROM l5 UNION ALL SELECT i, px, py, pz, 0e0, 0e0, 0e0 FROM l5, (VALUES (-3), (-2), (-1)) AS v(i) WHERE idx = 0),
fr AS (SELECT idx, """ + _LAGS + """ FROM kn WINDOW w AS (ORDER BY idx))"""
SEG = KN + f""", seg AS (SELECT m.*, fr.* EXCLUDE (idx) FROM (SELECT *, (t_us - {T0} - idx * {STEP}) / {STEP}e0 AS u FROM (SELECT *, (t_us - {T0}) // {STEP} AS idx FROM l2 WHERE t_us >= {T0})) m
JOIN fr ON m.idx = fr.idx WHERE px3 IS NOT NULL)"""
_E = S.quat_exp(S.vec("k.d"))
PREFIX = f""", qq AS (SELECT -3::BIGINT AS idx, 1e0 AS w, 0e0 AS x, 0e0 AS y, 0e0 AS z UNION ALL
SELECT k.idx, {', '.join(S.quat_mul(('q.w', 'q.x', 'q.y', 'q.z'), ('k.ew', 'k.ex', 'k.ey', 'k.ez')))} FROM qq q
JOIN (SELECT idx, {', '.join(f'{e} AS e{c}' for e, c in zip(_E, 'wxyz', strict=True))} FROM kn k) k ON k.idx = q.idx + 1)"""


def _turned_sql(source: str) -> str:
    """Adds ow .. oz to source (with idx, u, dx0 ..)."""
    out = f", t0 AS (SELECT s.*, q.w AS ow, q.x AS ox, q.y AS oy, q.z AS oz FROM {source} s JOIN qq q ON q.idx = greatest(s.idx - 3, -3))"
    for k in range(4):
        e = S.quat_exp(tuple(f"{S.weight(S.CUMULATIVE[k], 'u')}*d{c}{k}" for c in "xyz"))
        turn = ", ".join(f"{x} AS e{c}" for x, c in zip(e, "wxyz", strict=True))
        mul = ", ".join(f"{x} AS o{c}" for x, c in zip(S.quat_mul(S.quat("o"), S.quat("e")), "wxyz", strict=True))
        out += f", e{k} AS (SELECT *, {turn} FROM t{k}), t{k + 1} AS (SELECT * EXCLUDE (ow, ox, oy, oz, ew, ex, ey, ez), {mul} FROM e{k})"
    unit = ", ".join(f"o{c}/sqrt(ow*ow + ox*ox + oy*oy + oz*oz) AS o{c}" for c in "wxyz")
    return out + f", turned AS (SELECT * EXCLUDE (ow, ox, oy, oz), {unit} FROM t4)"


POS = {c: S.spline([f"p{c}{k}" for k in range(4)], "u") for c in "xyz"}
TURNED = SEG + PREFIX + _turned_sql("seg")
WORLD = dict(zip(("wx", "wy", "wz"), (f"{r} + {POS[c]}" for r, c in zip(S.rotate(S.quat("o"), ("x", "y", "z")), "xyz", strict=True)), strict=True))


def path_sql(every: int) -> str:
    """Poses every so many us, as `turned`."""
    times = f""", ts AS (SELECT unnest(range({T0}, {T0} + (SELECT max(idx) FROM l5) * {STEP}, {every}))::BIGINT AS t_us),
    ps AS (SELECT m.*, fr.* EXCLUDE (idx) FROM (SELECT *, (t_us - {T0} - idx * {STEP}) / {STEP}e0 AS u FROM (SELECT *, (t_us - {T0}) // {STEP} AS idx FROM ts)) m JOIN fr ON m.idx = fr.idx WHERE px3 IS NOT NULL)"""
    return KN + times + PREFIX + _turned_sql("ps")


POSE = {"px": POS["x"], "py": POS["y"], "pz": POS["z"], "qw": "ow", "qx": "ox", "qy": "oy", "qz": "oz"}


def measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.segment_join(stream(spark, sf_dir).withColumn("run", F.lit("events")), knots(spark, sf_dir), T0, STEP)


def turned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.orientation(measured(spark, sf_dir), knots(spark, sf_dir))


def path(spark: SparkSession, sf_dir: str, every: int = HOUR) -> DataFrame:
    k = knots(spark, sf_dir)
    poses = J.orientation(J.resample(k, T0, STEP, every), k)
    return poses.selectExpr("run", "t_us", *[f"{e} AS {n}" for n, e in POSE.items()])


@query(oracle("SELECT idx, greatest(idx // 10, (idx + 3) // 10) AS version, round(px, 6)+0e0 AS px, round(py, 6)+0e0 AS py, round(pz, 6)+0e0 AS pz FROM l5"))
def src_spline_increment(spark, sf_dir):
    """Increments of ten knots that overlap by three, unpacked again: the latest version of each knot."""
    df = J.apply_increments(J.to_increments(knots(spark, sf_dir), 10, 3, T0, STEP))
    return df.select("idx", "version", *S.rounded(6, px="px", py="py", pz="pz"))


@query(oracle(f"""SELECT version, min(idx) AS start_idx, count(*) AS n_knots, {T0} + (max(idx) - 4) * {STEP} AS start_t, round(arg_max(px, idx), 6)+0e0 AS last_px FROM (
  SELECT idx, px, idx // 10 AS version FROM l5 UNION SELECT idx, px, (idx + 3) // 10 FROM l5) GROUP BY version"""))
def snk_spline_increment(spark, sf_dir):
    df = J.to_increments(knots(spark, sf_dir), 10, 3, T0, STEP)
    return df.select("version", "start_idx", F.size("knots").cast("long").alias("n_knots"), "start_t", *S.rounded(6, last_px="element_at(knots, -1).px"))


SHOW = S.rounded_sql(5, **WORLD)


@query(oracle(f"SELECT id, value AS intensity, {SHOW} FROM turned WHERE t_us > (SELECT max(t_us) FROM seg) - {DAY}", TURNED))
def snk_current_scan(spark, sf_dir):
    df = turned(spark, sf_dir)
    newest = measured(spark, sf_dir).agg(F.max("t_us").alias("newest"))
    return df.join(F.broadcast(newest), F.col("t_us") > F.col("newest") - DAY).select("id", F.col("value").alias("intensity"), *S.rounded(5, **WORLD))


@query(oracle(f"SELECT id, sensor, t_us, value AS intensity, {SHOW} FROM turned", TURNED))
def snk_global_map(spark, sf_dir):
    return turned(spark, sf_dir).select("id", "sensor", "t_us", F.col("value").alias("intensity"), *S.rounded(5, **WORLD))


@query(oracle(f"SELECT id, {SHOW} FROM turned", TURNED))
def prj_body_to_world(spark, sf_dir):
    return turned(spark, sf_dir).select("id", *S.rounded(5, **WORLD))


@query(oracle("SELECT t_us, " + S.rounded_sql(5, **POSE) + " FROM turned", path_sql(HOUR)))
def snk_path(spark, sf_dir):
    return path(spark, sf_dir).select("t_us", *S.rounded(5, **{n: n for n in POSE}))


@query(oracle("SELECT t_us, " + S.rounded_sql(5, x=POS["x"], y=POS["y"], z=POS["z"]) + " FROM ps", path_sql(HOUR // 6)))
def str_resample(spark, sf_dir):
    return path(spark, sf_dir, HOUR // 6).select("t_us", *S.rounded(5, x="px", y="py", z="pz"))


@query(oracle("SELECT t_us, " + S.rounded_sql(5, **POSE) + " FROM turned ORDER BY t_us DESC LIMIT 1", path_sql(HOUR)))
def snk_odometry(spark, sf_dir):
    last = path(spark, sf_dir).groupBy("run").agg(F.max_by(F.struct("t_us", *POSE), "t_us").alias("p")).select("p.*")
    return last.select("t_us", *S.rounded(5, **{n: n for n in POSE}))


_BODY = [(s.name, *s.body_frame()[0], *s.body_frame()[1]) for s in SENSORS]
_VALUES = ", ".join("('" + r[0] + "', " + ", ".join(f"{v!r}::DOUBLE" for v in r[1:]) + ")" for r in _BODY)
_COMPOSED = S.quat_mul(("qw", "qx", "qy", "qz"), ("rw", "rx", "ry", "rz"))
_MOVED = tuple(f"({r} + p{c})" for r, c in zip(S.rotate(("qw", "qx", "qy", "qz"), ("tx", "ty", "tz")), "xyz", strict=True))
COMPOSED = {**dict(zip(("cw", "cx", "cy", "cz"), _COMPOSED, strict=True)), **dict(zip(("mx", "my", "mz"), _MOVED, strict=True))}


@query(oracle("SELECT t_us, sensor, " + S.rounded_sql(5, **COMPOSED) + " FROM poses, dim",
  path_sql(HOUR) + ", poses AS (SELECT t_us, " + ", ".join(f"{e} AS {n}" for n, e in POSE.items()) + f" FROM turned), dim AS (SELECT * FROM (VALUES {_VALUES}) v(sensor, rw, rx, ry, rz, tx, ty, tz))"))
def prj_compose_pose(spark, sf_dir):
    """Pose of every sensor along the path."""
    dim = sensor_table(spark, SENSORS).withColumnRenamed("name", "sensor")
    return path(spark, sf_dir).join(F.broadcast(dim)).select("t_us", "sensor", *S.rounded(5, **COMPOSED))


TF_OWN = dict(zip(("x", "y", "z", "qw", "qx", "qy", "qz"), POSE, strict=True))
TF_LIDAR = dict(zip(TF_OWN, (COMPOSED[c] for c in ("mx", "my", "mz", "cw", "cx", "cy", "cz")), strict=True))


@query(oracle(" UNION ALL ".join([*[f"SELECT '{frame}' AS frame, {S.rounded_sql(5, **TF_OWN)} FROM last" for frame in ("body", "imu_frame")], f"SELECT 'lidar_' || sensor, {S.rounded_sql(5, **TF_LIDAR)} FROM last, dim"]),
  path_sql(HOUR) + ", last AS (SELECT t_us, " + ", ".join(f"{e} AS {n}" for n, e in POSE.items()) + f" FROM turned ORDER BY t_us DESC LIMIT 1), dim AS (SELECT * FROM (VALUES {_VALUES}) v(sensor, rw, rx, ry, rz, tx, ty, tz))"))
def snk_tf(spark, sf_dir):
    """Newest poses of the body and its inertial unit, and of every sensor."""
    last = path(spark, sf_dir).groupBy("run").agg(F.max_by(F.struct("t_us", *POSE), "t_us").alias("p")).select("p.*")
    dim = sensor_table(spark, SENSORS).withColumnRenamed("name", "sensor")
    lidars = last.join(F.broadcast(dim)).select(F.concat(F.lit("lidar_"), "sensor").alias("frame"), *S.rounded(5, **TF_LIDAR))
    own = last.select(F.explode(F.array(F.lit("body"), F.lit("imu_frame"))).alias("frame"), *S.rounded(5, **TF_OWN))
    return own.unionByName(lidars)


@query(oracle("SELECT idx, round(px, 6)+0e0 AS px, round(py, 6)+0e0 AS py, round(pz, 6)+0e0 AS pz FROM l5 ORDER BY idx DESC LIMIT 4"))
def snk_active_knots(spark, sf_dir):
    return knots(spark, sf_dir).orderBy(F.desc("idx")).limit(4).select("idx", *S.rounded(6, px="px", py="py", pz="pz"))


@query(oracle("SELECT idx, round(px, 6)+0e0 AS px FROM (SELECT *, row_number() OVER (ORDER BY idx DESC) AS rn FROM l5) WHERE rn <= 4"))
def lim_last_knots(spark, sf_dir):
    order = Window.partitionBy("run").orderBy(F.desc("idx"))
    return knots(spark, sf_dir).withColumn("rn", F.row_number().over(order)).where("rn <= 4").select("idx", *S.rounded(6, px="px"))


END = f"{T0} + (SELECT max(idx) FROM l5) * {STEP} - 1"


@query(oracle(f"SELECT id, t_us FROM l2 WHERE t_us BETWEEN {END} - 4 * {STEP} AND {END}"))
def flt_active_window(spark, sf_dir):
    end = knots(spark, sf_dir).agg((F.max("idx") * STEP + T0 - 1).alias("end_us"))
    return stream(spark, sf_dir).join(F.broadcast(end), F.col("t_us").between(F.col("end_us") - 4 * STEP, F.col("end_us"))).select("id", "t_us")


@query(oracle(f"SELECT id, t_us FROM l2 WHERE t_us BETWEEN {T0} AND {END}"))
def flt_spline_domain(spark, sf_dir):
    return measured(spark, sf_dir).select("id", "t_us")


@query(oracle("SELECT id, idx, " + S.rounded_sql(6, u="u", px0="px0", px1="px1", px2="px2", px3="px3") + " FROM seg", SEG))
def join_spline_segment(spark, sf_dir):
    return measured(spark, sf_dir).select("id", "idx", *S.rounded(6, u="u", px0="px0", px1="px1", px2="px2", px3="px3"))


@query(oracle("SELECT coalesce(b.idx, a.idx) AS idx, round(coalesce(b.px, a.px), 6)+0e0 AS px FROM (SELECT * FROM l5 WHERE idx < 80) a FULL OUTER JOIN (SELECT idx, px + 1e0 AS px FROM l5 WHERE idx >= 60) b ON a.idx = b.idx"))
def join_knot_upsert(spark, sf_dir):
    k = knots(spark, sf_dir)
    return J.upsert(k.where("idx < 80"), k.where("idx >= 60").withColumn("px", F.expr("px + 1e0"))).select("idx", *S.rounded(6, px="px"))


@query(oracle("SELECT idx, " + S.rounded_sql(6, qw="w", qx="x", qy="y", qz="z") + " FROM qq WHERE idx >= 0", KN + PREFIX))
def agg_quat_prefix(spark, sf_dir):
    return J.rotation_prefix(knots(spark, sf_dir)).select("idx", *S.rounded(6, qw="qw", qx="qx", qy="qy", qz="qz"))


FRAME = {f"{c}{k}": f"{c}{k}" for c in P + D for k in range(4)}


@query(oracle("SELECT idx, " + S.rounded_sql(9, **FRAME) + " FROM fr WHERE py0 IS NOT NULL AND py3 IS NOT NULL", KN))
def win_knot_frame(spark, sf_dir):
    return J.frames(knots(spark, sf_dir)).where("py0 IS NOT NULL AND py3 IS NOT NULL").select("idx", *S.rounded(9, **FRAME))


def _derivative(order: int) -> dict[str, str]:
    names = {0: "xyz", 1: ("vx", "vy", "vz"), 2: ("ax", "ay", "az")}[order]
    return {n: S.spline([f"p{c}{k}" for k in range(4)], "u", order, STEP_S / 1e4) for n, c in zip(names, "xyz", strict=True)}


def _derivative_sql(order: int) -> str:
    """Written out: the derivative of the four blending polynomials."""
    w = {
        0: ("(1-u)*(1-u)*(1-u)", "3*u*u*u - 6*u*u + 4", "-3*u*u*u + 3*u*u + 3*u + 1", "u*u*u"),
        1: ("-3*(1-u)*(1-u)", "9*u*u - 12*u", "-9*u*u + 6*u + 3", "3*u*u"),
        2: ("6*(1-u)", "18*u - 12", "-18*u + 6", "6*u"),
    }[order]
    names = {0: "xyz", 1: ("vx", "vy", "vz"), 2: ("ax", "ay", "az")}[order]
    scale = f"(6e0 * {(STEP_S / 1e4) ** order!r}::DOUBLE)"
    return S.rounded_sql(5, **{n: "(" + " + ".join(f"({w[k]})*p{c}{k}" for k in range(4)) + f")/{scale}" for n, c in zip(names, "xyz", strict=True)})


@query(oracle(f"SELECT id, {_derivative_sql(0)} FROM seg", SEG))
def fn_spline_pos(spark, sf_dir):
    return measured(spark, sf_dir).select("id", *S.rounded(5, **_derivative(0)))


@query(oracle(f"SELECT id, {_derivative_sql(1)} FROM seg", SEG))
def fn_spline_vel(spark, sf_dir):
    """Per 10,000 s."""
    return measured(spark, sf_dir).select("id", *S.rounded(5, **_derivative(1)))


@query(oracle(f"SELECT id, {_derivative_sql(2)} FROM seg", SEG))
def fn_spline_acc(spark, sf_dir):
    """Per 10,000 s squared."""
    return measured(spark, sf_dir).select("id", *S.rounded(5, **_derivative(2)))


@query(oracle("SELECT id, " + S.rounded_sql(5, qw="ow", qx="ox", qy="oy", qz="oz") + " FROM turned", TURNED))
def fn_spline_quat(spark, sf_dir):
    return turned(spark, sf_dir).select("id", *S.rounded(5, qw="ow", qx="ox", qy="oy", qz="oz"))


@query(oracle(f"SELECT idx, {T0} + idx * {STEP} AS t_us, {T0} AS min_us, {END} AS max_us FROM l5"))
def fn_knot_time(spark, sf_dir):
    k = knots(spark, sf_dir)
    end = k.groupBy("run").agg((F.max("idx") * STEP + T0 - 1).alias("max_us"))
    return k.join(end, "run").select("idx", (F.col("idx") * STEP + T0).alias("t_us"), F.lit(T0).alias("min_us"), "max_us")


AHEAD = 8
_KNOT = [f"{c}{k}" for k in range(4) for c in P + D]


@query(oracle("SELECT idx, " + S.rounded_sql(6, **{c: f"{c}3" for c in P}) + ", " + S.rounded_sql(9, **{c: f"{c}3" for c in D}) + " FROM ahead WHERE n > 0",
  "tail AS (SELECT max(idx) AS last FROM l5), ahead AS (SELECT 0 AS n, last AS idx, " + ", ".join(f"(SELECT {c[:2]} FROM l5 WHERE idx = last - {3 - int(c[2])}) AS {c}" for c in _KNOT)
  + " FROM tail UNION ALL SELECT n + 1, idx + 1, " + ", ".join(f"{c[:2]}{int(c[2]) + 1}" if c[2] < "3" else f"2*{c[:2]}2 - {c[:2]}0" if c[0] == "p" else f"{c[:2]}1" for c in _KNOT)
  + f" FROM ahead WHERE n < {AHEAD})"))
def str_propagate(spark, sf_dir):
    """Knots ahead of the trajectory: position 2 p[n-2] - p[n-4], rotation delta that of n-3."""
    last = Window.partitionBy("run").orderBy(F.desc("idx"))
    tail = knots(spark, sf_dir).withColumn("rn", F.row_number().over(last)).where("rn <= 4")
    state = tail.groupBy("run").agg(F.sort_array(F.collect_list(F.struct("idx", *P, *D))).alias("w"))
    grown = ", ".join([f"'{c}', 2 * element_at(s, -2).{c} - element_at(s, -4).{c}" for c in P] + [f"'{c}', element_at(s, -3).{c}" for c in D])
    step = f"concat(s, array(named_struct('idx', element_at(s, -1).idx + 1L, {grown})))"
    done = state.withColumn("w", F.expr(f"slice(aggregate(sequence(1, {AHEAD}), w, (s, i) -> {step}), 5, {AHEAD})"))
    return done.select(F.explode("w").alias("k")).select("k.idx", *S.rounded(6, **{c: f"k.{c}" for c in P}), *S.rounded(9, **{c: f"k.{c}" for c in D}))
