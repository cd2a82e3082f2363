"""Spatial joins, voxel aggregates, plane residuals and changes of the point map."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftline.functions import scalars as S
from driftline.operators import space
from driftline.plans.lenses import bulk, cloud, oracle
from driftline.plans.registry import query

R2 = f"{space.RADIUS!r}e0 * {space.RADIUS!r}e0"


def scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sensors that look."""
    return cloud(spark, sf_dir).where("sensor < 5")


def world(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sensors whose points are the map."""
    return cloud(spark, sf_dir).where("sensor >= 5")


def boxes(spark: SparkSession, sf_dir: str, margin: float = 2.0) -> DataFrame:
    """One box per sensor: its extent, less a margin on each side."""
    ends = [F.expr(f"min({c}) + {margin}D").alias(f"lo_{c}") for c in "xyz"] + [F.expr(f"max({c}) - {margin}D").alias(f"hi_{c}") for c in "xyz"]
    return cloud(spark, sf_dir).groupBy(F.col("sensor").alias("box_id")).agg(*ends)


def _boxes_sql(margin: float = 2.0) -> str:
    ends = ", ".join(f"min({c}) + {margin}::DOUBLE AS lo_{c}, max({c}) - {margin}::DOUBLE AS hi_{c}" for c in "xyz")
    return f"boxes AS (SELECT sensor AS box_id, {ends} FROM l1 GROUP BY sensor)"


INSIDE = " AND ".join(f"p.{c} >= b.lo_{c} AND p.{c} < b.hi_{c}" for c in "xyz")
PAIRS = f"""pairs AS (SELECT * FROM (SELECT q.id AS qid, q.x AS qx, q.y AS qy, q.z AS qz, p.id, p.x, p.y, p.z,
  (q.x-p.x)*(q.x-p.x) + (q.y-p.y)*(q.y-p.y) + (q.z-p.z)*(q.z-p.z) AS d2 FROM l1 q, l1 p WHERE q.sensor < 5 AND p.sensor >= 5) WHERE d2 <= {R2})"""
NEAR = f"{PAIRS}, nn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d2, x, id) AS rn FROM pairs) WHERE rn <= {{}})"


@query(oracle("SELECT qid, id, round(d2, 6)+0e0 AS d2, rn FROM nn", NEAR.format(5)))
def join_knn_radius(spark, sf_dir):
    found = space.nearest(scan(spark, sf_dir), world(spark, sf_dir))
    return found.select("qid", "id", *S.rounded(6, d2="d2"), F.col("rn").cast("long").alias("rn"))


@query(oracle("SELECT qid, id, round(d2, 6)+0e0 AS d2 FROM pairs", PAIRS))
def join_radius(spark, sf_dir):
    return space.within_radius(scan(spark, sf_dir), world(spark, sf_dir)).select("qid", "id", *S.rounded(6, d2="d2"))


@query(oracle(f"SELECT b.box_id, p.id FROM l1 p JOIN boxes b ON {INSIDE}", _boxes_sql()))
def join_box_range(spark, sf_dir):
    return space.box_join(cloud(spark, sf_dir), boxes(spark, sf_dir), 4.0).select("box_id", "id")


@query(oracle(f"SELECT p.id FROM l1 p WHERE NOT EXISTS (SELECT 1 FROM boxes b WHERE {INSIDE})", _boxes_sql(2.5)))
def join_box_anti(spark, sf_dir):
    return space.box_join(cloud(spark, sf_dir), boxes(spark, sf_dir, 2.5), 4.0, "left_anti").select("id")


VOX = ", ".join(f"floor({c} / {{0}})::BIGINT AS c{c}" for c in "xyz")


@query(oracle("SELECT a.id FROM (SELECT *, " + VOX.format("1e0") + " FROM l1 WHERE sensor < 5) a WHERE NOT EXISTS (SELECT 1 FROM (SELECT *, " + VOX.format("1e0") + " FROM l1 WHERE sensor >= 5) b WHERE a.cx = b.cx AND a.cy = b.cy AND a.cz = b.cz)"))
def join_voxel_anti(spark, sf_dir):
    new = scan(spark, sf_dir).select("id", *space.cell(1.0))
    return new.join(world(spark, sf_dir).select(*space.cell(1.0)).distinct(), ["cx", "cy", "cz"], "left_anti").select("id")


def _centroid_sql(leaf: str, source: str = "l1", key: str = "sensor, ") -> str:
    return f"SELECT {key}cx, cy, cz, count(*) AS n, round(avg(x), 6)+0e0 AS x, round(avg(y), 6)+0e0 AS y, round(avg(z), 6)+0e0 AS z FROM (SELECT *, {VOX.format(leaf)} FROM {source}) GROUP BY {key}cx, cy, cz"


@query(oracle(_centroid_sql("2e0")))
def agg_voxel_centroid(spark, sf_dir):
    return space.voxel_centroid(cloud(spark, sf_dir), 2.0, ["sensor"], ["x", "y", "z"]).select("sensor", "cx", "cy", "cz", "n", *S.rounded(6, x="x", y="y", z="z"))


@query(oracle(_centroid_sql("0.2e0")))
def agg_voxel_centroid_visual(spark, sf_dir):
    return space.voxel_centroid(cloud(spark, sf_dir), 0.2, ["sensor"], ["x", "y", "z"]).select("sensor", "cx", "cy", "cz", "n", *S.rounded(6, x="x", y="y", z="z"))


@query(oracle("SELECT cx, cy, cz, count(*) AS n, CAST(sum(CAST(round(x) AS BIGINT)) AS BIGINT) AS sx FROM (SELECT *, " + VOX.format("10e0") + " FROM l6) GROUP BY cx, cy, cz"))
def bulk_voxel_counts(spark, sf_dir):
    return bulk(spark, sf_dir).groupBy(*space.cell(10.0)).agg(F.count("*").alias("n"), F.sum(F.round("x").cast("long")).alias("sx"))


CENTER_D2 = " + ".join(f"({c} - (floor({c}/{{0}})*{{0}} + {{0}}/2))*({c} - (floor({c}/{{0}})*{{0}} + {{0}}/2))" for c in "xyz")


@query(oracle("SELECT cx, cy, cz, id FROM (SELECT *, row_number() OVER (PARTITION BY cx, cy, cz ORDER BY " + CENTER_D2.format("2e0") + ", id DESC) AS rn FROM (SELECT *, " + VOX.format("2e0") + " FROM l1)) WHERE rn = 1"))
def agg_voxel_argmin(spark, sf_dir):
    return space.voxel_argmin(cloud(spark, sf_dir).withColumn("seq", F.col("id")), 2.0).select("cx", "cy", "cz", "id")


@query(oracle("""SELECT id FROM (SELECT *, row_number() OVER (PARTITION BY cx, cy, cz ORDER BY """ + CENTER_D2.format("2e0") + """, seq DESC) AS rn FROM v
  WHERE (cx, cy, cz) IN (SELECT (cx, cy, cz) FROM v WHERE seq = 1)) WHERE rn = 1
  UNION ALL SELECT id FROM v WHERE seq = 0 AND (cx, cy, cz) NOT IN (SELECT (cx, cy, cz) FROM v WHERE seq = 1)""",
  "v AS (SELECT *, CASE WHEN sensor < 5 THEN 1 ELSE 0 END AS seq, " + VOX.format("2e0") + " FROM l1)"))
def dml_append_voxel(spark, sf_dir):
    return space.insert_downsampled(world(spark, sf_dir), scan(spark, sf_dir), 2.0).select("id")


_SUMS = ", ".join(f"{e} AS {n}" for n, e in space.plane_sums().items())
_WIDE = ", ".join(f"max(CASE WHEN rn = {i} THEN {c} END) AS {c}{i}" for i in range(1, 6) for c in "xyz")
PLANE = f"""{NEAR.format(5)}, wide AS (SELECT qid, qx, qy, qz, {_WIDE} FROM nn GROUP BY qid, qx, qy, qz HAVING count(*) >= 5),
  sums AS (SELECT *, {_SUMS} FROM wide),
  dets AS (SELECT *, sxx*(syy*szz - syz*syz) - sxy*(sxy*szz - syz*sxz) + sxz*(sxy*syz - syy*sxz) AS det FROM sums),
  sol AS (SELECT *,
    -(sx*(syy*szz - syz*syz) - sxy*(sy*szz - syz*sz) + sxz*(sy*syz - syy*sz)) / det AS ux,
    -(sxx*(sy*szz - syz*sz) - sx*(sxy*szz - syz*sxz) + sxz*(sxy*sz - sy*sxz)) / det AS uy,
    -(sxx*(syy*sz - sy*syz) - sxy*(sxy*sz - sy*sxz) + sx*(sxy*syz - syy*sxz)) / det AS uz FROM dets WHERE abs(det) > 1e-12),
  plane AS (SELECT *, ux/un AS nx, uy/un AS ny, uz/un AS nz, 1e0/un AS d FROM (SELECT *, sqrt(ux*ux + uy*uy + uz*uz) AS un FROM sol)),
  res AS (SELECT *, nx*qx + ny*qy + nz*qz + d AS r, sqrt(qx*qx + qy*qy + qz*qz) AS rng FROM plane)"""


def planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planes through the neighbours of each scan point, with residual r and range."""
    found = space.plane_of(space.nearest(scan(spark, sf_dir), world(spark, sf_dir)))
    return found.selectExpr("*", "nx*qx + ny*qy + nz*qz + d AS r", "sqrt(qx*qx + qy*qy + qz*qz) AS rng")


@query(oracle("SELECT qid, " + S.rounded_sql(5, nx="nx", ny="ny", nz="nz", d="d") + " FROM plane", PLANE))
def agg_plane_fit(spark, sf_dir):
    return planes(spark, sf_dir).select("qid", *S.rounded(5, nx="nx", ny="ny", nz="nz", d="d"))


@query(oracle("SELECT qid, round(r, 5)+0e0 AS r FROM res", PLANE))
def fn_plane_residual(spark, sf_dir):
    return planes(spark, sf_dir).select("qid", *S.rounded(5, r="r"))


@query(oracle("SELECT qid, count(*) AS n, round(max(d2), 6)+0e0 AS far FROM nn GROUP BY qid HAVING count(*) >= 5 AND max(d2) < 5e0", NEAR.format(5)))
def flt_knn_gate(spark, sf_dir):
    found = space.nearest(scan(spark, sf_dir), world(spark, sf_dir)).groupBy("qid").agg(F.count("*").alias("n"), F.max("d2").alias("far"))
    return found.where("n >= 5 AND far < 5e0").select("qid", "n", *S.rounded(6, far="far"))


def inlier(limit: str) -> str:
    return " AND ".join(f"abs(nx*x{i} + ny*y{i} + nz*z{i} + d) <= {limit}" for i in range(1, 6))


@query(oracle(f"SELECT qid FROM plane WHERE {inlier('0.4e0')}", PLANE))
def flt_planeinlier(spark, sf_dir):
    return planes(spark, sf_dir).where(inlier("0.4e0")).select("qid")


@query(oracle("SELECT qid, round(r, 5)+0e0 AS r FROM res WHERE rng > 81e0 * r * r", PLANE))
def flt_residual_gate(spark, sf_dir):
    return planes(spark, sf_dir).where("rng > 81e0 * r * r").select("qid", *S.rounded(5, r="r"))


ARM = "(ny*qz - nz*qy)*(ny*qz - nz*qy) + (nz*qx - nx*qz)*(nz*qx - nx*qz) + (nx*qy - ny*qx)*(nx*qy - ny*qx)"


@query(oracle(f"SELECT qid, (abs(r) < 0.5e0 OR 0.02e0*(1e0 + {ARM}) + 0.01e0 < 0.01e0*5e0) AS accepted FROM res", PLANE))
def flt_innovation_gate(spark, sf_dir):
    """H = (n, n x p), P = 0.02 I, R = 0.01, coefficient 5, threshold 0.5."""
    return planes(spark, sf_dir).select("qid", F.expr(f"abs(r) < 0.5e0 OR 0.02e0*(1e0 + {ARM}) + 0.01e0 < 0.01e0*5e0").alias("accepted"))


@query(oracle("SELECT count(*) AS n, count(*) FILTER (WHERE rng > 81e0 * r * r) AS valid FROM res", PLANE))
def agg_count_valid(spark, sf_dir):
    return planes(spark, sf_dir).agg(F.count("*").alias("n"), F.count_if(F.expr("rng > 81e0 * r * r")).alias("valid"))


@query(oracle("SELECT " + ", ".join(f"min({c}) AS lo_{c}, max({c}) AS hi_{c}" for c in "xyz") + " FROM l1"))
def agg_bbox(spark, sf_dir):
    return cloud(spark, sf_dir).agg(*[f(c).alias(f"{n}_{c}") for c in "xyz" for f, n in ((F.min, "lo"), (F.max, "hi"))])


@query(oracle("SELECT sensor, " + ", ".join(f"min({c}) AS lo_{c}, max({c}) AS hi_{c}" for c in "xyz") + " FROM l1 GROUP BY sensor"))
def agg_sensor_extent(spark, sf_dir):
    return cloud(spark, sf_dir).groupBy("sensor").agg(*[f(c).alias(f"{n}_{c}") for c in "xyz" for f, n in ((F.min, "lo"), (F.max, "hi"))])


def flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The map with tombstones: `deleted` by the boxes of sensors 0 to 5, `ds_deleted` if not its voxel's point."""
    pts = cloud(spark, sf_dir)
    gone = space.box_join(pts, boxes(spark, sf_dir, 1.5).where("box_id < 6"), 4.0, "left_semi").select("id", F.lit(True).alias("deleted"))
    stays = space.voxel_argmin(pts.withColumn("seq", F.col("id")), 1.0).select("id", F.lit(False).alias("ds_deleted"))
    return pts.join(gone, "id", "left").join(stays, "id", "left").fillna({"deleted": False, "ds_deleted": True})


FLAGGED = f"""{_boxes_sql(1.5)}, won AS (SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY floor(x), floor(y), floor(z) ORDER BY {CENTER_D2.format('1e0')}, id DESC) AS rn FROM l1) WHERE rn = 1),
  flagged AS (SELECT p.*, EXISTS (SELECT 1 FROM boxes b WHERE box_id < 6 AND {INSIDE}) AS deleted, p.id NOT IN (SELECT id FROM won) AS ds_deleted FROM l1 p)"""


@query(oracle("SELECT count(*) AS total, count(*) FILTER (WHERE NOT deleted AND NOT ds_deleted) AS live FROM flagged", FLAGGED))
def agg_map_counts(spark, sf_dir):
    return flagged(spark, sf_dir).agg(F.count("*").alias("total"), F.count_if(~F.col("deleted") & ~F.col("ds_deleted")).alias("live"))


@query(oracle("SELECT id FROM flagged WHERE deleted AND NOT ds_deleted", FLAGGED))
def dml_removed_audit(spark, sf_dir):
    return flagged(spark, sf_dir).where("deleted AND NOT ds_deleted").select("id")


@query(oracle("SELECT id FROM flagged WHERE NOT deleted", FLAGGED))
def dml_delete_boxes(spark, sf_dir):
    pts = cloud(spark, sf_dir)
    return space.box_join(pts, boxes(spark, sf_dir, 1.5).where("box_id < 6"), 4.0, "left_anti").select("id")


@query(oracle(f"SELECT id, deleted AND NOT (NOT ds_deleted AND EXISTS (SELECT 1 FROM boxes b WHERE box_id >= 4 AND {INSIDE})) AS deleted FROM flagged p", FLAGGED))
def dml_undelete_boxes(spark, sf_dir):
    df = flagged(spark, sf_dir)
    back = space.box_join(df.select("id", "x", "y", "z"), boxes(spark, sf_dir, 1.5).where("box_id >= 4"), 4.0, "left_semi").select("id", F.lit(True).alias("back"))
    return df.join(back, "id", "left").select("id", F.expr("deleted AND NOT (NOT ds_deleted AND coalesce(back, false))").alias("deleted"))


@query(oracle("SELECT cx, cy, cz, count(*) AS n, min(id) AS first_id FROM (SELECT *, " + VOX.format("4e0") + " FROM l1) GROUP BY cx, cy, cz"))
def dml_build(spark, sf_dir):
    """The map by cell, as it would be laid out."""
    return cloud(spark, sf_dir).groupBy(*space.cell(4.0)).agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


@query(oracle("SELECT id, round(x, 6)+0e0 AS x FROM l1 WHERE sensor >= 5 UNION ALL SELECT id, round(x, 6)+0e0 AS x FROM l1 WHERE sensor < 5"))
def dml_append(spark, sf_dir):
    return world(spark, sf_dir).unionByName(scan(spark, sf_dir)).select("id", *S.rounded(6, x="x"))


@query(oracle("SELECT p.id FROM l1 p WHERE NOT EXISTS (SELECT 1 FROM l1 g WHERE g.sensor IN (1, 3) AND abs(p.x - (g.x + 5e-7)) < 1e-6 AND abs(p.y - g.y) < 1e-6 AND abs(p.z - g.z) < 1e-6)"))
def dml_delete_points(spark, sf_dir):
    pts = cloud(spark, sf_dir)
    return space.delete_points(pts, pts.where("sensor IN (1, 3)").withColumn("x", F.expr("x + 5e-7"))).select("id")


@query(oracle("SELECT id, abs(x - round(x, 6)) < 1e-6 AND abs(y - round(y, 6)) < 1e-6 AND abs(z - round(z, 5)) < 1e-6 AS same FROM l1"))
def fn_same_point(spark, sf_dir):
    return cloud(spark, sf_dir).select("id", F.expr("abs(x - round(x, 6)) < 1e-6 AND abs(y - round(y, 6)) < 1e-6 AND abs(z - round(z, 5)) < 1e-6").alias("same"))


BOX_D2 = " + ".join(f"greatest(greatest(lo_{c} - {c}, {c} - hi_{c}), 0e0)*greatest(greatest(lo_{c} - {c}, {c} - hi_{c}), 0e0)" for c in "xyz")


@query(oracle(f"SELECT id, round({BOX_D2}, 6)+0e0 AS d2 FROM l1 p JOIN boxes b ON (p.sensor + 1) % 10 = b.box_id", _boxes_sql()))
def fn_box_dist(spark, sf_dir):
    """From each point to the box of the next sensor."""
    pts = cloud(spark, sf_dir).withColumn("box_id", F.expr("(sensor + 1) % 10"))
    return pts.join(boxes(spark, sf_dir), "box_id").select("id", *S.rounded(6, d2=BOX_D2))


CENTERS = {f"c{c}": f"floor({c} / 0.5e0) * 0.5e0 + 0.25e0" for c in "xyz"}


@query(oracle("SELECT id, " + S.rounded_sql(6, **CENTERS) + " FROM l1"))
def fn_voxel_center(spark, sf_dir):
    return cloud(spark, sf_dir).select("id", *S.rounded(6, **CENTERS))


@query(oracle("SELECT sensor, id, rn FROM (SELECT sensor, id, row_number() OVER (PARTITION BY sensor ORDER BY x*x + y*y + z*z, id) AS rn FROM l1) WHERE rn <= 10"))
def srt_topk(spark, sf_dir):
    order = Window.partitionBy("sensor").orderBy(F.expr("x*x + y*y + z*z"), "id")
    return cloud(spark, sf_dir).select("sensor", "id", F.row_number().over(order).cast("long").alias("rn")).where("rn <= 10")


CENTER = {c: f"(floor(q{c}) + 0.5e0)" for c in "xyz"}
OFF_CENTER = " OR ".join(f"abs({c} - {CENTER[c]}) > 0.866e0" for c in "xyz")
SAME_VOXEL = " AND ".join(f"abs({c} - {CENTER[c]}) < 0.5e0" for c in "xyz")
ACTION = "CASE WHEN n IS NULL OR far THEN 'raw' WHEN taken THEN 'skip' ELSE 'downsample' END"


@query(oracle(f"""SELECT q.id, {ACTION} AS action FROM l1 q LEFT JOIN (SELECT qid, count(*) AS n, bool_or(rn = 1 AND ({OFF_CENTER})) AS far, bool_or({SAME_VOXEL}) AS taken
  FROM nn GROUP BY qid) g ON q.id = g.qid WHERE q.sensor < 5""", NEAR.format(5)))
def str_map_insert(spark, sf_dir):
    """What happens to each new point: inserted raw or with downsampling, or skipped."""
    new = scan(spark, sf_dir)
    near = space.nearest(new, world(spark, sf_dir)).groupBy(F.col("qid").alias("id")).agg(
        F.count("*").alias("n"), F.bool_or(F.expr(f"rn = 1 AND ({OFF_CENTER})")).alias("far"), F.bool_or(F.expr(SAME_VOXEL)).alias("taken")
    )
    return new.join(near, "id", "left").select("id", F.expr(ACTION).alias("action"))


EDGE, MOVE = 1.5, 2.25
MOVES = {f"m{c}": f"CASE WHEN {c}lo - lo_{c} < {EDGE}e0 THEN -{MOVE}e0 WHEN hi_{c} - {c}hi < {EDGE}e0 THEN {MOVE}e0 ELSE 0e0 END" for c in "xyz"}


@query(oracle("SELECT sensor, " + ", ".join(f"{e} AS {n}" for n, e in MOVES.items()) + " FROM ext e, cube",
  "ext AS (SELECT sensor, " + ", ".join(f"min({c}) AS {c}lo, max({c}) AS {c}hi" for c in "xyz") + " FROM l1 GROUP BY sensor), cube AS (SELECT "
  + ", ".join(f"{c}lo - 2e0 AS lo_{c}, {c}hi + 2e0 AS hi_{c}" for c in "xyz") + " FROM ext WHERE sensor = 0)"))
def str_fov_boxes(spark, sf_dir):
    """How far the local map's box, set about sensor 0, would move for each sensor's extent."""
    ext = cloud(spark, sf_dir).groupBy("sensor").agg(*[f(c).alias(f"{c}{n}") for c in "xyz" for f, n in ((F.min, "lo"), (F.max, "hi"))])
    cube = ext.where("sensor = 0").selectExpr(*[f"{c}lo - 2e0 AS lo_{c}" for c in "xyz"], *[f"{c}hi + 2e0 AS hi_{c}" for c in "xyz"])
    return ext.join(F.broadcast(cube)).selectExpr("sensor", *[f"{e} AS {n}" for n, e in MOVES.items()])
