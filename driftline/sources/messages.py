"""Wire schemas of sensor messages, and decoders from messages to flat point rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.functions.scalars import offset_ms
from driftline.streaming.late import drop_late


def _struct(ddl: str) -> T.StructType:
    kinds = {"long": T.LongType(), "int": T.IntegerType(), "short": T.ShortType(), "float": T.FloatType(), "double": T.DoubleType(), "string": T.StringType(), "boolean": T.BooleanType()}
    return T.StructType([T.StructField(n, kinds[k]) for n, k in (f.split() for f in ddl.split(","))])


LIVOX_POINT = _struct("offset_time long,x float,y float,z float,reflectivity short,tag int,line int")
OUSTER_POINT = _struct("x float,y float,z float,intensity float,t long")
HESAI_POINT = _struct("x float,y float,z float,intensity float,ring int,timestamp double")
MID360_POINT = _struct("x float,y float,z float,intensity float,tag int,line int,timestamp double")
IMU_SAMPLE = _struct("t_ns long,ax double,ay double,az double,gx double,gy double,gz double")
KNOT = _struct("idx long,px double,py double,pz double,dx double,dy double,dz double")


def message(point: T.StructType) -> T.StructType:
    return T.StructType([T.StructField("sensor", T.StringType()), T.StructField("msg", T.LongType()), T.StructField("begin_ns", T.LongType()), T.StructField("points", T.ArrayType(point))])


INCREMENT = T.StructType([
    T.StructField("version", T.LongType()), T.StructField("start_idx", T.LongType()), T.StructField("dt", T.LongType()),
    T.StructField("start_t", T.LongType()), T.StructField("knots", T.ArrayType(KNOT)), T.StructField("idles", T.ArrayType(KNOT)),
])


@dataclass(frozen=True)
class Decoder:
    """What a sensor kind does on decoding.

    clock: "offset" (ns since begin), "seconds" or "nanos" (absolute, double).
    lidar: Livox kinds skip the first point, test tag and line, decimate by valid
    ordinal and drop consecutive duplicates; the others decimate by raw index.
    late_first: late points don't advance the decimation.
    """

    clock: str = "offset"
    livox: bool = False
    late_first: bool = False
    shifted: bool = False


DECODERS = {
    "Ouster": Decoder(shifted=True),
    "Mid70Avia": Decoder(livox=True),
    "HAP360": Decoder(livox=True),
    "AviaLateFirst": Decoder(livox=True, late_first=True),
    "Hesai": Decoder(clock="seconds"),
    "Mid360Boxi": Decoder(clock="nanos"),
}


def flatten(messages: DataFrame) -> DataFrame:
    """One row per point; pos is its index in the message. Empty messages vanish."""
    return messages.select("sensor", "msg", "begin_ns", F.posexplode("points").alias("pos", "p")).select("sensor", "msg", "begin_ns", "pos", "p.*")


def offset_ns(clock: str, begin_ns: str = "begin_ns", at: str = "stamp") -> Column:
    if clock == "seconds":
        return F.expr(f"CAST(floor({at}) AS BIGINT) * 1000000000 + CAST(({at} - floor({at})) * 1e9 AS INT) - {begin_ns}")
    if clock == "nanos":
        return F.expr(f"CAST({at} AS BIGINT) - {begin_ns}")
    return F.expr(at)


def not_late(points: DataFrame) -> DataFrame:
    """Points after all that their sensor accepted in earlier messages.

    The first message's points must come after its own begin. This is the window form:
    it equals a running mark as long as each message yields a point. streaming.late
    has the mark that may go back.
    """
    per_message = points.groupBy("sensor", "msg").agg(F.min("begin_ns").alias("b"), F.max("t_ns").alias("m"))
    before = Window.partitionBy("sensor").orderBy("msg").rowsBetween(Window.unboundedPreceding, -1)
    marks = per_message.select("sensor", "msg", F.coalesce(F.max("m").over(before), F.col("b")).alias("last"))
    return points.join(marks, ["sensor", "msg"]).where("t_ns > last").drop("last")


def decode(points: DataFrame, kind: str, n: int = 1, blind: float = 0.5, scan_line: int = 4, shift_s: float = 0.0) -> DataFrame:
    """Accepted points of flat rows (sensor, msg, begin_ns, pos, stamp, x, y, z, tag, line, ...).

    Adds t_ns and off_ms (float32). Unknown kinds raise. Late points go by the mark
    that may go back (streaming.late).
    """
    if kind not in DECODERS:
        raise ValueError(f"unknown sensor kind {kind}")
    d = DECODERS[kind]
    rows = points.withColumn("ofs_ns", offset_ns(d.clock))
    if d.shifted and shift_s:
        rows = rows.withColumn("begin_ns", F.col("begin_ns") - int(shift_s * 1e9))
    rows = rows.withColumn("off_ms", F.expr(offset_ms("ofs_ns"))).withColumn("t_ns", F.expr("begin_ns + ofs_ns"))
    in_message = Window.partitionBy("sensor", "msg").orderBy("pos")
    far = F.expr(f"x*x + y*y + z*z > {blind * blind}e0 AND NOT isnan(x*x + y*y + z*z)")
    if not d.livox:
        kept = rows.where((F.col("pos") % n == 0) & (F.col("off_ms") >= 0) & far)
        return drop_late(kept)
    first = Window.partitionBy("sensor", "msg").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.select("*", *[F.first(c).over(first).alias(f"first_{c}") for c in "xyz"])
    rows = rows.where((F.col("pos") >= 1) & F.col("tag").bitwiseAND(48).isin(0, 16) & (F.col("line") < scan_line))
    if d.late_first:
        rows = drop_late(rows)
    rows = rows.withColumn("ordinal", F.row_number().over(in_message)).where(F.col("ordinal") % n == 0)
    rows = rows.withColumn("moved", moved(in_message)).where("moved")
    kept = rows.where((F.col("off_ms") >= 0) & far).drop("ordinal", "moved", "first_x", "first_y", "first_z")
    return kept if d.late_first else drop_late(kept)


def moved(order) -> Column:
    """Any axis differs by over 1e-7 from the row before, or from the message's first point."""
    axes = [F.abs(F.col(c) - F.coalesce(F.lag(c).over(order), F.col(f"first_{c}"))) > 1e-7 for c in "xyz"]
    return axes[0] | axes[1] | axes[2]


def decode_visual(points: DataFrame, kind: str, refl_scale: float = 1.0) -> DataFrame:
    """The looser decoding for maps: no blind radius, decimation or late test."""
    d = DECODERS[kind]
    rows = points.withColumn("ofs_ns", offset_ns(d.clock)).withColumn("off_ms", F.expr(offset_ms("ofs_ns")))
    if d.livox:
        rows = rows.where((F.col("pos") >= 1) & F.col("tag").bitwiseAND(48).isin(0, 16))
    else:
        rows = rows.where((F.col("pos") >= (1 if kind == "Ouster" else 0)) & (F.col("off_ms") >= 0))
    finite = F.expr("NOT isnan(x) AND NOT isnan(y) AND NOT isnan(z)")
    return rows.where(finite).withColumn("t_ns", F.expr("begin_ns + ofs_ns")).withColumn("refl", F.col("refl") * refl_scale)


def scale_acceleration(imu: DataFrame, in_g: bool = True) -> DataFrame:
    return imu.withColumns({c: F.col(c) * 9.81 for c in ("ax", "ay", "az")}) if in_g else imu
