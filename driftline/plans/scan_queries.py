"""Decoding, predicates, projections and ordering over scan messages and inertial samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftline.functions import scalars as S
from driftline.operators.space import voxel_centroid
from driftline.plans.lenses import DAY, T0, inertial, oracle, scans, stream
from driftline.plans.registry import query
from driftline.sources import messages
from driftline.sources.config import Sensor, sensor_table

#: Sensor kinds that the event types stand for.
KINDS = {"view": "Ouster", "click": "HAP360", "signup": "AviaLateFirst", "purchase": "Hesai", "error": "Mid360Boxi"}
SENSORS = tuple(
    Sensor(name, kind, 3, 0.5 + i / 2, (0.9, 0.1 * i, 0.2, 0.1), (0.1 * i, 0.2, -0.3), 0.01 * (i + 1))
    for i, (name, kind) in enumerate(KINDS.items())
)


def points(spark: SparkSession, sf_dir: str, sensor: str | None = None) -> DataFrame:
    df = scans(spark, sf_dir)
    df = df.where(F.col("sensor") == sensor) if sensor else df
    clock = {"purchase": "t_us / 1e6", "error": "CAST(t_us * 1000 AS DOUBLE)"}.get(sensor, "ofs_us * 1000")
    return df.selectExpr("*", "begin_us * 1000 AS begin_ns", f"{clock} AS stamp", "value AS refl")


def shown(df: DataFrame) -> DataFrame:
    return df.select("id", "sensor", "msg", "t_ns", F.col("off_ms").cast("double").alias("off_ms"), *S.rounded(6, x="x", y="y", z="z"))


OFF = "CAST(CAST(CAST({} AS FLOAT) AS DOUBLE) / 1e6 AS FLOAT)"
SHOWN = "SELECT id, sensor, msg, t_ns, off_ms::DOUBLE AS off_ms, round(x, 6) + 0e0 AS x, round(y, 6) + 0e0 AS y, round(z, 6) + 0e0 AS z FROM {}"
LATE = """{name}_m AS (SELECT sensor, msg, coalesce(max(m) OVER (PARTITION BY sensor ORDER BY msg ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), b) AS last
  FROM (SELECT sensor, msg, min(begin_ns) AS b, max(t_ns) AS m FROM {name} GROUP BY sensor, msg)),
{name}_l AS (SELECT p.* FROM {name} p JOIN {name}_m m USING (sensor, msg) WHERE p.t_ns > m.last)"""


def _plain_sql(sensor: str, ofs: str, n: int, blind: float, shift: int = 0) -> str:
    more = f"""c AS (SELECT *, begin_ns + ofs_ns AS t_ns, {OFF.format('ofs_ns')} AS off_ms FROM (
      SELECT *, begin_us * 1000 - {shift} AS begin_ns, {ofs} AS ofs_ns FROM l3 WHERE sensor = '{sensor}')
      WHERE pos % {n} = 0 AND x*x + y*y + z*z > {blind * blind}e0),
    d AS (SELECT * FROM c WHERE off_ms >= 0), {LATE.format(name='d')}"""
    return oracle(SHOWN.format("d_l"), more)


def _livox_sql(sensor: str, n: int, blind: float, late_first: bool) -> str:
    start = f"""a AS (SELECT *, begin_us * 1000 AS begin_ns, t_us * 1000 AS t_ns, {OFF.format('ofs_us * 1000')} AS off_ms,
        first_value(x) OVER w AS fx, first_value(y) OVER w AS fy, first_value(z) OVER w AS fz FROM l3 WHERE sensor = '{sensor}'
        WINDOW w AS (PARTITION BY sensor, msg ORDER BY pos)),
      b AS (SELECT * FROM a WHERE pos >= 1 AND (tag & 48) IN (0, 16) AND line < 3)"""
    source = "b"
    if late_first:
        start, source = f"{start}, {LATE.format(name='b')}", "b_l"
    rest = f""", c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sensor, msg ORDER BY pos) AS rn FROM {source}) WHERE rn % {n} = 0),
      d AS (SELECT *, coalesce(lag(x) OVER v, fx) AS lx, coalesce(lag(y) OVER v, fy) AS ly, coalesce(lag(z) OVER v, fz) AS lz FROM c
        WINDOW v AS (PARTITION BY sensor, msg ORDER BY pos)),
      e AS (SELECT * FROM d WHERE off_ms >= 0 AND x*x + y*y + z*z > {blind * blind}e0 AND (abs(x-lx) > 1e-7 OR abs(y-ly) > 1e-7 OR abs(z-lz) > 1e-7))"""
    if late_first:
        return oracle(SHOWN.format("e"), start + rest)
    return oracle(SHOWN.format("e_l"), f"{start}{rest}, {LATE.format(name='e')}")


@query(_plain_sql("view", "ofs_us * 1000", 2, 2.0, 100_000_000))
def src_ouster_decode(spark, sf_dir):
    return shown(messages.decode(points(spark, sf_dir, "view"), "Ouster", 2, 2.0, shift_s=0.1))


@query(_livox_sql("click", 2, 2.0, False))
def src_livox_decode(spark, sf_dir):
    return shown(messages.decode(points(spark, sf_dir, "click"), "HAP360", 2, 2.0, 3))


@query(_livox_sql("signup", 2, 2.0, True))
def src_livox_avia_decode(spark, sf_dir):
    return shown(messages.decode(points(spark, sf_dir, "signup"), "AviaLateFirst", 2, 2.0, 3))


@query(_plain_sql("purchase", "floor(t_us / 1e6)::BIGINT * 1000000000 + trunc((t_us / 1e6 - floor(t_us / 1e6)) * 1e9)::BIGINT - begin_us * 1000", 1, 0.5))
def src_hesai_decode(spark, sf_dir):
    return shown(messages.decode(points(spark, sf_dir, "purchase"), "Hesai"))


@query(_plain_sql("error", "trunc((t_us * 1000)::DOUBLE)::BIGINT - begin_us * 1000", 1, 0.5))
def src_mid360_decode(spark, sf_dir):
    return shown(messages.decode(points(spark, sf_dir, "error"), "Mid360Boxi"))


@query(oracle("SELECT id, t_us * 1000 AS t_ns, round(ax*9.81e0, 9)+0e0 AS ax, round(ay*9.81e0, 9)+0e0 AS ay, round(az*9.81e0, 9)+0e0 AS az, gx, gy, gz FROM l4"))
def src_imu(spark, sf_dir):
    df = messages.scale_acceleration(inertial(spark, sf_dir))
    return df.select("id", F.expr("t_us * 1000 AS t_ns"), *S.rounded(9, ax="ax", ay="ay", az="az"), "gx", "gy", "gz")


@query(oracle("SELECT id, sensor, msg, t_us * 1000 AS t_ns, round(value * 0.1e0, 6)+0e0 AS refl FROM l3 WHERE sensor = 'view' AND pos >= 1 AND ofs_us >= 0"))
def src_visual_decode(spark, sf_dir):
    df = messages.decode_visual(points(spark, sf_dir, "view"), "Ouster", 0.1)
    return df.select("id", "sensor", "msg", "t_ns", *S.rounded(6, refl="refl"))


@query(oracle("SELECT id, sensor, msg, pos FROM l3 WHERE pos % 3 = 0"))
def flt_decimate_raw(spark, sf_dir):
    return scans(spark, sf_dir).where("pos % 3 = 0").select("id", "sensor", "msg", F.col("pos").cast("long").alias("pos"))


@query(oracle("SELECT id, sensor, msg, rn FROM (SELECT *, row_number() OVER (PARTITION BY sensor, msg ORDER BY pos) AS rn FROM l3 WHERE tag IN (0, 16) AND line < 3) WHERE rn % 2 = 0"))
def flt_decimate_valid(spark, sf_dir):
    order = Window.partitionBy("sensor", "msg").orderBy("pos")
    valid = scans(spark, sf_dir).where("tag IN (0, 16) AND line < 3")
    return valid.withColumn("rn", F.row_number().over(order).cast("long")).where("rn % 2 = 0").select("id", "sensor", "msg", "rn")


@query(oracle("SELECT id, round(x, 6)+0e0 AS x FROM l2 WHERE x*x + y*y + z*z > 100e0"))
def flt_blind(spark, sf_dir):
    return stream(spark, sf_dir).where("x*x + y*y + z*z > 100e0 AND NOT isnan(x*x + y*y + z*z)").select("id", *S.rounded(6, x="x"))


@query(oracle("SELECT id, sensor, msg, t_ns FROM p_l", f"p AS (SELECT *, begin_us * 1000 AS begin_ns, begin_us * 1000 + (ofs_us * 1000 * CASE WHEN msg % 2 = 0 THEN 2 ELSE 1 END) AS t_ns FROM l3), {LATE.format(name='p')}"))
def flt_late(spark, sf_dir):
    """Every second message runs at double speed, so that the next one has late points."""
    df = scans(spark, sf_dir).selectExpr("*", "begin_us * 1000 AS begin_ns", "begin_us * 1000 + ofs_us * 1000 * CASE WHEN msg % 2 = 0 THEN 2 ELSE 1 END AS t_ns")
    return messages.not_late(df).select("id", "sensor", "msg", "t_ns")


@query(oracle("SELECT id, tag FROM l2 WHERE (tag & 48) IN (0, 16)"))
def flt_tag(spark, sf_dir):
    return stream(spark, sf_dir).where(F.col("tag").bitwiseAND(48).isin(0, 16)).select("id", "tag")


@query(oracle("SELECT id, line FROM l2 WHERE line < 3"))
def flt_line(spark, sf_dir):
    return stream(spark, sf_dir).where("line < 3").select("id", "line")


@query(oracle("""SELECT id, sensor, msg FROM (SELECT *, coalesce(lag(y) OVER w, first_value(y) OVER w) AS ly, coalesce(lag(z) OVER w, first_value(z) OVER w) AS lz
  FROM l3 WINDOW w AS (PARTITION BY sensor, msg ORDER BY pos)) WHERE abs(y - ly) > 1e-7 OR abs(z - lz) > 1e-7"""))
def flt_dup(spark, sf_dir):
    """On the axes y and z, which repeat in these data."""
    order = Window.partitionBy("sensor", "msg").orderBy("pos")
    df = scans(spark, sf_dir).withColumns({f"first_{c}": F.first(c).over(order) for c in "yz"}).withColumns({"x": F.lit(0.0), "first_x": F.lit(0.0)})
    return df.withColumn("moved", messages.moved(order)).where("moved").select("id", "sensor", "msg")


@query(oracle("SELECT id, round(s, 6)+0e0 AS s FROM (SELECT id, CASE WHEN k % 7 <> 0 THEN sqrt(k) / (k % 7) END AS s FROM l2) WHERE s IS NOT NULL"))
def flt_nan(spark, sf_dir):
    df = stream(spark, sf_dir).withColumn("s", F.expr("CASE WHEN k % 7 = 0 THEN double('NaN') ELSE sqrt(k) / (k % 7) END"))
    return df.where("NOT isnan(s)").select("id", *S.rounded(6, s="s"))


@query(oracle("SELECT id, CASE WHEN abs(gx) > 0.8e0 THEN 0e0 ELSE round(gx, 6)+0e0 END AS gx, CASE WHEN abs(gy) > 0.8e0 THEN 0e0 ELSE round(gy, 6)+0e0 END AS gy, CASE WHEN abs(gz) > 0.8e0 THEN 0e0 ELSE round(gz, 6)+0e0 END AS gz FROM l4"))
def flt_imu_outlier(spark, sf_dir):
    gate = lambda c: F.expr(f"CASE WHEN abs({c}) > 0.8e0 THEN 0e0 ELSE round({c}, 6) + 0e0 END AS {c}")
    return inertial(spark, sf_dir).select("id", *map(gate, ("gx", "gy", "gz")))


@query(oracle(f"SELECT sensor, count(*) AS n, count(*) >= 100 AS enough FROM l2 WHERE t_us < {T0} + 5 * {DAY} GROUP BY sensor"))
def flt_init_window(spark, sf_dir):
    early = stream(spark, sf_dir).where(f"t_us < {T0} + 5 * {DAY}")
    return early.groupBy("sensor").agg(F.count("*").alias("n")).select("sensor", "n", F.expr("n >= 100 AS enough"))


@query(oracle(f"SELECT id, {OFF.format('ofs_us * 1000')}::DOUBLE AS off_ms FROM l3"))
def prj_offset_ms(spark, sf_dir):
    return scans(spark, sf_dir).select("id", F.expr(S.offset_ms("ofs_us * 1000")).cast("double").alias("off_ms"))


@query(oracle("SELECT id, round(ax*9.81e0, 9)+0e0 AS ax, round(ay*9.81e0, 9)+0e0 AS ay, round(az*9.81e0, 9)+0e0 AS az FROM l4"))
def prj_imu_scale(spark, sf_dir):
    return messages.scale_acceleration(inertial(spark, sf_dir)).select("id", *S.rounded(9, ax="ax", ay="ay", az="az"))


W_PT = "(CASE sensor " + " ".join(f"WHEN '{s.name}' THEN {s.w_pt!r}e0" for s in SENSORS) + " END)"


@query(oracle(f"SELECT id, begin_us * 1000 + trunc({OFF.format('ofs_us * 1000')} * 1e6::FLOAT)::BIGINT AS t_ns, {W_PT} AS var_pt FROM l3"))
def prj_measurement(spark, sf_dir):
    df = scans(spark, sf_dir).withColumn("off_ms", F.expr(S.offset_ms("ofs_us * 1000"))).withColumn("d", S.ms_to_ns("off_ms"))
    dim = sensor_table(spark, SENSORS).withColumnRenamed("name", "sensor")
    return df.join(F.broadcast(dim), "sensor").select("id", F.expr("begin_us * 1000 + d AS t_ns"), F.col("w_pt").alias("var_pt"))


@query(oracle(f"SELECT id, sensor, {W_PT} AS w_pt, (CASE sensor " + " ".join(f"WHEN '{s.name}' THEN '{s.kind}'" for s in SENSORS) + " END) AS kind FROM l3"))
def join_sensor_dim(spark, sf_dir):
    dim = sensor_table(spark, SENSORS).withColumnRenamed("name", "sensor")
    return scans(spark, sf_dir).join(F.broadcast(dim), "sensor").select("id", "sensor", "w_pt", "kind")


@query(oracle("""SELECT t_us, kind, id, row_number() OVER (PARTITION BY t_us ORDER BY kind, id) AS place FROM (
  SELECT t_us, 0 AS kind, id FROM l4 UNION ALL SELECT t_us, 1 AS kind, id FROM l2)"""))
def join_time_merge(spark, sf_dir):
    both = inertial(spark, sf_dir).select("t_us", F.lit(0).alias("kind"), "id").unionByName(stream(spark, sf_dir).select("t_us", F.lit(1).alias("kind"), "id"))
    return both.withColumn("place", F.row_number().over(Window.partitionBy("t_us").orderBy("kind", "id")).cast("long"))


@query(oracle("SELECT sensor, msg, max(ofs_us) AS max_ofs_us FROM l3 WHERE ofs_us >= 0 GROUP BY sensor, msg"))
def agg_max_offset(spark, sf_dir):
    return scans(spark, sf_dir).where("ofs_us >= 0").groupBy("sensor", "msg").agg(F.max("ofs_us").alias("max_ofs_us"))


BARRIER = "SELECT min(lo) AS head, min(hi) AS tail, min(greatest(lo, 0)) AS start_t FROM (SELECT sensor, min(t_us) AS lo, max(t_us) AS hi FROM l2 GROUP BY sensor)"


@query(oracle(BARRIER))
def agg_barrier(spark, sf_dir):
    each = stream(spark, sf_dir).groupBy("sensor").agg(F.min("t_us").alias("lo"), F.max("t_us").alias("hi"))
    return each.agg(F.min("lo").alias("head"), F.min("hi").alias("tail"), F.min(F.greatest("lo", F.lit(0))).alias("start_t"))


@query(oracle("""SELECT n, round(sx * 9.81e0 / m, 4)+0e0 AS gx, round(sy * 9.81e0 / m, 4)+0e0 AS gy, round(sz * 9.81e0 / m, 4)+0e0 AS gz
  FROM (SELECT *, sqrt(sx*sx + sy*sy + sz*sz) AS m FROM (SELECT count(*) AS n, avg(ax) AS sx, avg(ay) AS sy, avg(az) AS sz
  FROM (SELECT * FROM l4 ORDER BY t_us, id LIMIT 15)))"""))
def agg_gravity_mean(spark, sf_dir):
    first = inertial(spark, sf_dir).orderBy("t_us", "id").limit(15)
    mean = first.agg(F.count("*").alias("n"), F.avg("ax").alias("sx"), F.avg("ay").alias("sy"), F.avg("az").alias("sz"))
    mean = mean.withColumn("m", F.expr("sqrt(sx*sx + sy*sy + sz*sz)"))
    return mean.select("n", *S.rounded(4, gx="sx*9.81e0/m", gy="sy*9.81e0/m", gz="sz*9.81e0/m"))


@query(oracle("""SELECT msg, round(h11, 4)+0e0 AS h11, round(h12, 4)+0e0 AS h12, round(h13, 4)+0e0 AS h13, round(h22, 4)+0e0 AS h22, round(h23, 4)+0e0 AS h23, round(h33, 4)+0e0 AS h33,
  round(b1, 4)+0e0 AS b1, round(b2, 4)+0e0 AS b2, round(b3, 4)+0e0 AS b3 FROM (SELECT (t_us - 1704067200000000) // 86400000000 AS msg, sum(2e0*ax*ax) AS h11, sum(2e0*ax*ay) AS h12,
  sum(2e0*ax*az) AS h13, sum(2e0*ay*ay) AS h22, sum(2e0*ay*az) AS h23, sum(2e0*az*az) AS h33, sum(2e0*ax*gz) AS b1, sum(2e0*ay*gz) AS b2, sum(2e0*az*gz) AS b3 FROM l4 GROUP BY 1)"""))
def agg_normal_equations(spark, sf_dir):
    h, w = ("ax", "ay", "az"), "2e0"
    sums = {f"h{i + 1}{j + 1}": f"sum({w}*{h[i]}*{h[j]})" for i in range(3) for j in range(i, 3)} | {f"b{i + 1}": f"sum({w}*{h[i]}*gz)" for i in range(3)}
    df = inertial(spark, sf_dir).groupBy(F.expr(f"(t_us - {T0}) div {DAY}").alias("msg")).agg(*[F.expr(e).alias(n) for n, e in sums.items()])
    return df.select("msg", *S.rounded(4, **{n: n for n in sums}))


@query(oracle("SELECT sensor, msg, id, row_number() OVER (PARTITION BY sensor, msg ORDER BY ofs_us, id) AS place FROM l3"))
def srt_time(spark, sf_dir):
    order = Window.partitionBy("sensor", "msg").orderBy("ofs_us", "id")
    return scans(spark, sf_dir).select("sensor", "msg", "id", F.row_number().over(order).cast("long").alias("place"))


@query(oracle("SELECT msg, sensor, id FROM (SELECT *, row_number() OVER (PARTITION BY msg ORDER BY sensor, t_us, id) AS rn FROM l3) WHERE rn <= 100"))
def lim_batch(spark, sf_dir):
    order = Window.partitionBy("msg").orderBy("sensor", "t_us", "id")
    return scans(spark, sf_dir).withColumn("rn", F.row_number().over(order)).where("rn <= 100").select("msg", "sensor", "id")


@query(oracle("SELECT id, t_us, sensor FROM l2 WHERE sensor = 'view' UNION ALL SELECT id, t_us, sensor FROM l2 WHERE sensor = 'click' UNION ALL SELECT id, t_us, sensor FROM l2 WHERE sensor NOT IN ('view', 'click')"))
def set_union_sensors(spark, sf_dir):
    df = stream(spark, sf_dir).select("id", "t_us", "sensor")
    return df.where("sensor = 'view'").unionByName(df.where("sensor = 'click'")).unionByName(df.where("sensor NOT IN ('view', 'click')"))


QUAT_OF = {"a": ("cos(gx)", "ax", "ay", "az"), "b": ("sin(gx)", "gy", "gz", "az")}


@query(oracle("SELECT id, " + S.rounded_sql(6, **dict(zip("wxyz", (
    "cos(gx)*sin(gx) - ax*gy - ay*gz - az*az", "cos(gx)*gy + ax*sin(gx) + ay*az - az*gz",
    "cos(gx)*gz - ax*az + ay*sin(gx) + az*gy", "cos(gx)*az + ax*gz - ay*gy + az*sin(gx)"), strict=True))) + " FROM l4"))
def fn_quat_mul(spark, sf_dir):
    product = S.quat_mul(QUAT_OF["a"], QUAT_OF["b"])
    return inertial(spark, sf_dir).select("id", *S.rounded(6, **dict(zip("wxyz", product, strict=True))))


@query(oracle("SELECT id, " + S.rounded_sql(6, w="cos(n)", x="s*ax", y="s*ay", z="s*az") + " FROM (SELECT *, CASE WHEN n = 0 THEN 1e0 ELSE sin(n)/n END AS s FROM (SELECT *, sqrt(ax*ax + ay*ay + az*az) AS n FROM l4))"))
def fn_quat_exp(spark, sf_dir):
    return inertial(spark, sf_dir).select("id", *S.rounded(6, **dict(zip("wxyz", S.quat_exp(S.vec("a")), strict=True))))


@query(oracle("SELECT id, " + S.rounded_sql(6, w="abs(ax)", x="sign*ay", y="sign*az", z="sign*gx") + " FROM (SELECT *, CASE WHEN ax < 0 THEN -1e0 ELSE 1e0 END AS sign FROM l4)"))
def fn_quat_positify(spark, sf_dir):
    return inertial(spark, sf_dir).select("id", *S.rounded(6, **dict(zip("wxyz", S.quat_positive(("ax", "ay", "az", "gx")), strict=True))))


UNIT = "SELECT id, ax/n AS qw, ay/n AS qx, az/n AS qy, gx/n AS qz FROM (SELECT *, sqrt(ax*ax + ay*ay + az*az + gx*gx) AS n FROM l4)"


@query(oracle("SELECT id, " + S.rounded_sql(4,
    yaw="degrees(atan2(2e0*(qx*qy + qw*qz), 1e0 - 2e0*(qy*qy + qz*qz)))",
    pitch="degrees(asin(greatest(-1e0, least(1e0, 2e0*(qw*qy - qx*qz)))))",
    roll="degrees(atan2(2e0*(qy*qz + qw*qx), 1e0 - 2e0*(qx*qx + qy*qy)))") + f" FROM ({UNIT})"))
def fn_ypr(spark, sf_dir):
    unit = inertial(spark, sf_dir).withColumn("n", F.expr("sqrt(ax*ax + ay*ay + az*az + gx*gx)")).selectExpr("id", "ax/n AS qw", "ay/n AS qx", "az/n AS qy", "gx/n AS qz")
    return unit.select("id", *S.rounded(4, **dict(zip(("yaw", "pitch", "roll"), S.yaw_pitch_roll(S.quat("q")), strict=True))))


@query(oracle("SELECT id, " + S.rounded_sql(6, w="s/m", x="(ay/n)/m", y="-(ax/n)/m", z="0e0") + """ FROM (SELECT *, sqrt(s*s + (ax*ax + ay*ay)/(n*n)) AS m
  FROM (SELECT *, 1e0 + az/n AS s FROM (SELECT *, sqrt(ax*ax + ay*ay + az*az) AS n FROM l4)))"""))
def fn_gravity_align(spark, sf_dir):
    return inertial(spark, sf_dir).select("id", *S.rounded(6, **dict(zip("wxyz", S.gravity_rotation(S.vec("a")), strict=True))))


@query(oracle(f"SELECT id, trunc({OFF.format('ofs_us * 1000')} * 1e6::FLOAT)::BIGINT AS ns FROM l3"))
def fn_ms2ns(spark, sf_dir):
    return scans(spark, sf_dir).withColumn("off_ms", F.expr(S.offset_ms("ofs_us * 1000"))).select("id", S.ms_to_ns("off_ms").alias("ns"))


@query(oracle(f"SELECT max(t_us) AS newest, min(tail) > {T0} + 20 * {DAY} AS ready FROM (SELECT sensor, max(t_us) AS tail, max(t_us) AS t_us FROM l2 GROUP BY sensor)"))
def str_barrier(spark, sf_dir):
    each = stream(spark, sf_dir).groupBy("sensor").agg(F.max("t_us").alias("tail"))
    return each.agg(F.max("tail").alias("newest"), F.expr(f"min(tail) > {T0} + 20 * {DAY}").alias("ready"))


@query(oracle("SELECT sensor, (t_us // 100000) * 100000 AS window_us, count(*) AS n, max(t_us) AS last_us FROM l2 GROUP BY 1, 2"))
def str_tumbling_100ms(spark, sf_dir):
    return stream(spark, sf_dir).groupBy("sensor", F.expr("(t_us div 100000) * 100000").alias("window_us")).agg(F.count("*").alias("n"), F.max("t_us").alias("last_us"))


@query(oracle("""SELECT sensor, msg, vx, vy, vz, n, round(mx, 5)+0e0 AS x, round(mt, 2)+0e0 AS ofs_us FROM (
  SELECT sensor, msg, floor(x / 5.0)::BIGINT AS vx, floor(y / 5.0)::BIGINT AS vy, floor(z / 5.0)::BIGINT AS vz, count(*) AS n, avg(x) AS mx, avg(ofs_us) AS mt FROM l3
  WHERE (tag & 48) IN (0, 16) AND x*x + y*y + z*z > 1e0 AND pos % 2 = 0 GROUP BY ALL)"""))
def flagship_scan(spark, sf_dir):
    """Filters, decimation and voxel centroids of every scan."""
    kept = scans(spark, sf_dir).where("(tag & 48) IN (0, 16) AND x*x + y*y + z*z > 1e0 AND pos % 2 = 0")
    df = voxel_centroid(kept, 5.0, ["sensor", "msg"], ["x", "ofs_us"])
    return df.select("sensor", "msg", F.col("cx").alias("vx"), F.col("cy").alias("vy"), F.col("cz").alias("vz"), "n", *S.rounded(5, x="x"), *S.rounded(2, ofs_us="ofs_us"))
