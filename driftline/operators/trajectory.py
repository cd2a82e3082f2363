"""Cubic B-spline trajectories as tables of control points keyed by (run, idx)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.functions.scalars import CUMULATIVE, quat, quat_exp, quat_mul, spline, vec, weight, with_quat

BLOCK = 256
NAMES = ("px", "py", "pz", "dx", "dy", "dz")


def with_idles(knots: DataFrame) -> DataFrame:
    """The knots and three rows before them, idx -3 to -1: the first position, no rotation."""
    first = knots.where("idx = 0").withColumn("idx", F.explode(F.array(*[F.lit(i).cast("long") for i in (-3, -2, -1)])))
    return knots.unionByName(first.withColumns({c: F.lit(0.0) for c in ("dx", "dy", "dz")}))


def frames(knots: DataFrame, block: int = 4096) -> DataFrame:
    """Per knot idx the four control points idx - 2 .. idx + 1 as px0 .. pz3 (dx0 .. dz3).

    Knots go into blocks of idx; those near a border go into the next one as well, so
    that no window spans more than a block, however long a run is.
    """
    at = lambda c, k: (F.lag(c, 2 - k) if k < 2 else F.lead(c, k - 2) if k > 2 else F.col(c))
    of = lambda shift: F.expr(f"CAST(floor((idx + {shift}) / {block}e0) AS BIGINT)")
    dealt = with_idles(knots).withColumn("block", F.explode(F.array_distinct(F.array(of(0), of(2), of(-1)))))
    order = Window.partitionBy("run", "block").orderBy("idx")
    cols = [(F.col(c) if k == 2 else at(c, k).over(order)).alias(f"{c}{k}") for c in NAMES for k in range(4)]
    return dealt.select("run", "idx", "block", *cols).where(F.col("block") == of(0)).drop("block")


def segment_join(points: DataFrame, knots: DataFrame, t0: int, step: int, time: str = "t_us") -> DataFrame:
    """points (run, time, ...) with their segment idx, u in [0, 1) and four control points.

    Points outside the spline's domain [t0, t0 + (n - 1) step - 1] are dropped. The key
    is computed, so the join is an equi-join.
    """
    placed = points.selectExpr("*", f"({time} - {t0}) div {step} AS idx").withColumn("u", F.expr(f"({time} - {t0} - idx * {step}) / {step}e0"))
    return placed.where(f"{time} >= {t0}").join(frames(knots), ["run", "idx"]).where("px3 IS NOT NULL")


def position(order: int = 0, step_s: float = 1.0) -> dict[str, str]:
    """Expressions after segment_join(): wx, wy, wz or a derivative."""
    return {f"w{c}": spline([f"p{c}{k}" for k in range(4)], "u", order, step_s) for c in "xyz"}


def rotation_prefix(knots: DataFrame, block: int = BLOCK, levels: int = 2) -> DataFrame:
    """(run, idx, qw, qx, qy, qz): the running product of exp(delta) in order of idx.

    Products don't commute, but they associate: blocks of 256 knots are multiplied on
    their own, then blocks of block products, and so on, and what stands before a block
    goes back down the tree by joins. With two levels, up to 256^3 knots of a run never
    meet in one row. Null deltas and gaps in idx aren't expected; the product goes over
    the rows there are.
    """
    rows = with_quat(knots, "e", quat_exp(vec("d"))).select("run", "idx", F.struct(*[F.col(f"e{c}").alias(c) for c in "wxyz"]).alias("e"))
    return _before(rows, block, levels).select("run", "idx", _multiplied(F.col("before"), F.col("e")).alias("q")).select(
        "run", "idx", *[F.col(f"q.{c}").alias(f"q{c}") for c in "wxyz"]
    )


def _before(rows: DataFrame, block: int, levels: int) -> DataFrame:
    """rows (run, idx, e) with `before`, the product of all e of smaller idx in the run."""
    one = F.struct(*[F.lit(v).alias(c) for v, c in zip((1.0, 0.0, 0.0, 0.0), "wxyz", strict=True)])
    start = F.struct(one.alias("q"), F.array().cast("array<struct<w:double,x:double,y:double,z:double>>").alias("all"))
    grown = lambda acc, r: F.struct(_multiplied(acc["q"], r["e"]).alias("q"), F.concat(acc["all"], F.array(acc["q"])).alias("all"))
    blocks = (
        rows.groupBy("run", F.expr(f"CAST(floor(idx / {block}e0) AS BIGINT)" if levels else "0L").alias("block"))
        .agg(F.sort_array(F.collect_list(F.struct("idx", "e"))).alias("rows"))
        .withColumn("done", F.aggregate("rows", start, grown))
    )
    flat = lambda df, *more: df.select("run", *more, F.explode(F.arrays_zip("rows", F.col("done.all").alias("all"))).alias("r"))
    if not levels:
        return flat(blocks).select("run", "r.rows.idx", "r.rows.e", F.col("r.all").alias("before"))
    starts = _before(blocks.select("run", F.col("block").alias("idx"), F.col("done.q").alias("e")), block, levels - 1)
    joined = flat(blocks.join(starts.select("run", F.col("idx").alias("block"), F.col("before").alias("start")), ["run", "block"]), "start")
    return joined.select("run", "r.rows.idx", "r.rows.e", _multiplied(F.col("start"), F.col("r.all")).alias("before"))


def _multiplied(a: Column, b: Column) -> Column:
    return F.struct(*[e.alias(c) for e, c in zip(_product(a, b), "wxyz", strict=True)])


def _product(a: Column, b: Column) -> list[Column]:
    aw, ax, ay, az = (a[c] for c in "wxyz")
    bw, bx, by, bz = (b[c] for c in "wxyz")
    return [
        aw * bw - ax * bx - ay * by - az * bz, aw * bx + ax * bw + ay * bz - az * by,
        aw * by - ax * bz + ay * bw + az * bx, aw * bz + ax * by - ay * bx + az * bw,
    ]


def orientation(segmented: DataFrame, knots: DataFrame) -> DataFrame:
    """segment_join() rows with ow, ox, oy, oz: q(idx-3) times exp(c_k(u) delta_k), unit length."""
    base = rotation_prefix(with_idles(knots)).selectExpr("run", "idx + 3 AS idx", "qw AS ow", "qx AS ox", "qy AS oy", "qz AS oz")
    df = segmented.join(base, ["run", "idx"], "left").fillna({"ow": 1.0, "ox": 0.0, "oy": 0.0, "oz": 0.0})
    for k in range(4):
        # Column by column, so that no expression holds another several times.
        df = df.withColumns({f"h{c}": F.expr(f"{weight(CUMULATIVE[k], 'u')}*d{c}{k}") for c in "xyz"})
        df = df.withColumn("hn", F.expr("sqrt(hx*hx + hy*hy + hz*hz)")).withColumn("hs", F.expr("CASE WHEN hn = 0 THEN 1e0 ELSE sin(hn)/hn END"))
        df = with_quat(df, "e", ("cos(hn)", "hs*hx", "hs*hy", "hs*hz")).drop("hx", "hy", "hz", "hn", "hs")
        df = df.selectExpr("*", *[f"{e} AS m{c}" for c, e in zip("wxyz", quat_mul(quat("o"), quat("e")), strict=True)])
        df = df.drop("ow", "ox", "oy", "oz", "ew", "ex", "ey", "ez").withColumnsRenamed({f"m{c}": f"o{c}" for c in "wxyz"})
    return df.withColumn("on", F.expr("sqrt(ow*ow + ox*ox + oy*oy + oz*oz)")).withColumns({f"o{c}": F.col(f"o{c}") / F.col("on") for c in "wxyz"}).drop("on")


def to_increments(knots: DataFrame, size: int, overlap: int, t0: int, step: int) -> DataFrame:
    """Nested trajectory increments: version v ships idx v*size - overlap .. v*size + size - 1.

    start_t is the time of the fifth knot from the increment's end, as published by an
    estimator whose last four knots may still change.
    """
    shipped = knots.withColumn("version", F.explode(F.expr(f"array_distinct(array(idx div {size}, (idx + {overlap}) div {size}))")))
    nested = shipped.groupBy("run", "version").agg(F.sort_array(F.collect_list(F.struct("idx", *NAMES))).alias("knots"))
    return nested.selectExpr(
        "run", "version", "knots[0].idx AS start_idx", f"{step} AS dt",
        f"{t0} + (element_at(knots, -1).idx - 4) * {step} AS start_t", "knots",
    )


def apply_increments(increments: DataFrame) -> DataFrame:
    """The trajectory after all increments: per idx the knot of the latest version."""
    flat = increments.select("run", "version", F.explode("knots").alias("k")).select("run", "version", "k.*")
    latest = flat.groupBy("run", "idx").agg(F.max_by(F.struct("version", *NAMES), "version").alias("k"))
    return latest.select("run", "idx", "k.*")


def upsert(current: DataFrame, new: DataFrame) -> DataFrame:
    """current with the knots of new in place of its own, and those it didn't have."""
    n = new.select("run", "idx", *[F.col(c).alias(f"n_{c}") for c in NAMES])
    return current.join(n, ["run", "idx"], "full_outer").select("run", "idx", *[F.coalesce(f"n_{c}", c).alias(c) for c in NAMES])


def resample(knots: DataFrame, t0: int, step: int, every: int) -> DataFrame:
    """Times every `every` from t0 to the end of the spline, segment-joined."""
    ends = knots.groupBy("run").agg(F.max("idx").alias("last"))
    times = ends.select("run", F.explode(F.expr(f"sequence({t0}L, {t0}L + last * {step} - 1, {every}L)")).alias("t_us"))
    return segment_join(times, knots, t0, step)
