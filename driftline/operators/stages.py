"""Gates, collection and hand-over between the stages of estimation and mapping."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.functions.scalars import quat, rotate


def start_points(points: DataFrame, span: int) -> DataFrame:
    """Points (t_us, ...) of the first `span` after the first of all."""
    head = points.agg(F.min("t_us").alias("head"))
    return points.join(F.broadcast(head), F.col("t_us") < F.col("head") + span).drop("head")  # one row


def start_gate(points: DataFrame, sensors: DataFrame, span: int, least: int) -> DataFrame:
    """One row: all_seen (each sensor of the configuration has a point), start_us, n_early, ready.

    A configured sensor without points blocks the start, as its row has no head.
    """
    heads = points.groupBy("sensor").agg(F.min("t_us").alias("head"))
    early = start_points(points, span).groupBy("sensor").agg(F.count("*").alias("early"))
    each = sensors.select("sensor").join(heads, "sensor", "left").join(early, "sensor", "left")
    row = each.agg(
        F.bool_and(F.col("head").isNotNull()).alias("all_seen"),
        F.min(F.greatest("head", F.lit(0))).alias("start_us"),
        F.coalesce(F.sum("early"), F.lit(0)).alias("n_early"),
    )
    return row.withColumn("ready", F.col("all_seen") & (F.col("n_early") >= least))


def to_body(points: DataFrame, sensors: DataFrame) -> DataFrame:
    """points with bx, by, bz: their coordinates in the body frame by the sensors' places (r: rotation, t: shift)."""
    turned = rotate(quat("r"), ("x", "y", "z"))
    return points.join(F.broadcast(sensors), "sensor").selectExpr("*", *[f"{e} + t{c} AS b{c}" for e, c in zip(turned, "xyz", strict=True)])


def collect_gate(ticks: DataFrame, points: DataFrame, imu: DataFrame, sensors: DataFrame, step: int) -> DataFrame:
    """Per tick (msg, max_us): head_us, points_ready, imu_ready.

    Points are ready when every configured sensor's newest point so far has passed the
    end of the trajectory by more than a step, inertial samples when the newest has
    passed it. Ticks are few; each sensor's newest is a running maximum over them.
    """
    so_far = Window.partitionBy("sensor").orderBy("msg").rowsBetween(Window.unboundedPreceding, 0)
    newest = points.groupBy("sensor", "msg").agg(F.max("t_us").alias("t"))
    grid = ticks.join(F.broadcast(sensors.select("sensor")))
    seen = grid.join(newest, ["sensor", "msg"], "left").withColumn("newest", F.max("t").over(so_far))
    gate = seen.groupBy("msg", "max_us").agg(F.min("newest").alias("head_us"), F.bool_and(F.col("newest").isNotNull()).alias("all_seen"))
    samples = imu.groupBy("msg").agg(F.max("t_us").alias("t"))
    running = Window.partitionBy(F.lit(0)).orderBy("msg").rowsBetween(Window.unboundedPreceding, 0)  # one row a tick
    last = ticks.join(samples, "msg", "left").select("msg", F.max("t").over(running).alias("imu_us"))
    return gate.join(last, "msg").select(
        "msg",
        "head_us",
        F.coalesce(F.col("all_seen") & (F.col("head_us") > F.col("max_us") + step), F.lit(False)).alias("points_ready"),
        F.coalesce(F.col("imu_us") > F.col("max_us"), F.lit(False)).alias("imu_ready"),
    )


def collect_points(points: DataFrame, budget: int, step: int) -> DataFrame:
    """The first `budget` points of each message in order of sensor and time, without stale ones.

    points: sensor, msg, t_us, id, max_us (end of the trajectory), n_knots. Stale is a
    point more than a step before the end, once there are ten knots; it counts all the same.
    """
    order = Window.partitionBy("msg").orderBy("sensor", "t_us", "id")
    taken = points.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= budget).drop("rn")
    return taken.where((F.col("n_knots") < 10) | (F.col("t_us") >= F.col("max_us") - step))


def prune_samples(imu: DataFrame, step: int) -> DataFrame:
    """Inertial samples (t_us, min_us, max_us) inside the trajectory and not older than a step before its end."""
    return imu.where((F.col("t_us") >= F.col("min_us")) & (F.col("t_us") >= F.col("max_us") - step))


def scan_ends(points: DataFrame) -> DataFrame:
    return points.groupBy("sensor", "msg").agg(F.max("t_us").alias("end_us"))


def scan_state(points: DataFrame, min_us: int, max_us: int) -> DataFrame:
    """Per scan: gone (it ends before the domain), ready (inside) or waits."""
    state = F.when(F.col("end_us") < min_us, "gone").when(F.col("end_us") <= max_us, "ready").otherwise("waits")
    return scan_ends(points).withColumn("state", state)


def released_scans(points: DataFrame, increments: DataFrame, t0: int, step: int) -> DataFrame:
    """(sensor, msg, end_us, version): the increment with which a scan's end comes inside the trajectory.

    That is the first to ship the knot behind the segment of the end, so an equi-join
    on the computed knot finds it. Scans whose end no increment reaches are absent.
    """
    shipped = increments.select("version", F.explode("knots.idx").alias("idx")).groupBy("idx").agg(F.min("version").alias("version"))
    return scan_ends(points).withColumn("idx", F.expr(f"(end_us - {t0}) div {step} + 1")).join(shipped, "idx").drop("idx")


def after_start(increments: DataFrame, start_us: int) -> DataFrame:
    """Increments from the start time on; earlier ones are not taken in."""
    return increments.where(F.col("start_t") >= start_us)


WALK = T.StructType(
    [T.StructField("run", T.StringType()), T.StructField("msg", T.LongType())]
    + [T.StructField(n, T.DoubleType()) for n in ("lo_x", "lo_y", "lo_z", "hi_x", "hi_y", "hi_z", "mx", "my", "mz")]
)


def walk_box(extents: DataFrame, half: float, near: float, move: float) -> DataFrame:
    """The box about the sensors from message to message, with its moves mx, my, mz.

    extents: run, msg, lox .. hiz. The first box reaches `half` beyond the extent. When
    the extent comes within `near` of an edge the box moves by `move` on that axis, to
    the lower side first. Each box follows from the one before: runs are read in order
    in a stream, with six numbers kept.
    """
    cols = ["run", "msg", *[f"{e}{c}" for e in ("lo", "hi") for c in "xyz"]]
    ordered = extents.select(*cols).repartition("run").sortWithinPartitions("run", "msg")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, box = object(), None
        for batch in batches:
            out = []
            for run, msg, *ends in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                lo, hi = ends[:3], ends[3:]
                if run != now:
                    now, box, moves = run, ([x - half for x in lo], [x + half for x in hi]), [0.0] * 3
                else:
                    moves = [-move if abs(a - p) <= near else move if abs(b - q) <= near else 0.0 for a, b, p, q in zip(lo, hi, *box, strict=True)]
                    box = tuple([x + m for x, m in zip(side, moves, strict=True)] for side in box)
                out.append((run, msg, *box[0], *box[1], *moves))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], WALK.fieldNames())

    return ordered.mapInArrow(walk, WALK)


def vacated_slabs(walked: DataFrame) -> DataFrame:
    """Per move and axis the slab (run, msg, lo_x .. hi_z) of the box before that the box leaves behind."""
    before = [F.expr(f"{e}_{c} - m{c}").alias(f"{e}_{c}") for c in "xyz" for e in ("lo", "hi")]
    old = walked.select("run", "msg", "mx", "my", "mz", *before)

    def slab(axis: str) -> DataFrame:
        lo = F.expr(f"CASE WHEN m{axis} < 0 THEN hi_{axis} + m{axis} ELSE lo_{axis} END")
        hi = F.expr(f"CASE WHEN m{axis} > 0 THEN lo_{axis} + m{axis} ELSE hi_{axis} END")
        return old.where(f"m{axis} <> 0").withColumns({f"lo_{axis}": lo, f"hi_{axis}": hi}).drop("mx", "my", "mz")

    return slab("x").unionByName(slab("y")).unionByName(slab("z"))


def normal_equations(rows: DataFrame, keys: list[str], columns: list[str], target: str, weight: float) -> DataFrame:
    """Per key the sums h{i}{j} of weight * c_i * c_j (i <= j) and b{i} of weight * c_i * target, summed before rows move."""
    n = range(len(columns))
    sums = {f"h{i}{j}": F.col(columns[i]) * F.col(columns[j]) for i in n for j in n if i <= j} | {f"b{i}": F.col(columns[i]) * F.col(target) for i in n}
    return rows.groupBy(*keys).agg(*[F.sum(e * F.lit(weight)).alias(k) for k, e in sums.items()])
