"""Joins and aggregates over points in space, planned as equi-joins on grid cells.

Points come as x, y, z. A radius or box predicate becomes a join on the cell key with
the exact predicate behind it, so no plan holds a nested loop or a cross join.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.functions.scalars import voxel
from driftline.operators import neighbours

RADIUS = 2.236
BLOCK = 2048  # rows of either side of a cell that meet in one key of the radius join


def cell(leaf: float, prefix: str = "") -> list[Column]:
    return [F.expr(voxel(f"{prefix}{c}", leaf)).alias(f"c{c}") for c in "xyz"]


def dist2(a: str = "q", b: str = "") -> str:
    return " + ".join(f"({a}{c} - {b}{c})*({a}{c} - {b}{c})" for c in "xyz")


def within_radius(queries: DataFrame, points: DataFrame, radius: float = RADIUS) -> DataFrame:
    """Pairs (qid, qx, qy, qz, id, x, y, z, d2) with d2 <= radius squared.

    Each query looks into the 27 cells around it. Cells with many rows are cut into
    blocks, so a key makes a bounded number of pairs and a few dense cells fill all tasks.
    """
    step = F.explode(F.array(*[F.lit(i) for i in (-1, 0, 1)]))
    q = queries.select(F.col("id").alias("qid"), *[F.col(c).alias(f"q{c}") for c in "xyz"])
    q = q.select("*", step.alias("i")).select("*", step.alias("j")).select("*", step.alias("k"))
    q = q.selectExpr("qid", "qx", "qy", "qz", *[f"{voxel(f'q{c}', radius)} + {s} AS c{c}" for c, s in zip("xyz", "ijk", strict=True)])
    q, p = in_blocks(q, points.select("id", "x", "y", "z", *cell(radius)), BLOCK)
    return q.hint("merge").join(p, KEY).withColumn("d2", F.expr(dist2())).where(f"d2 <= {radius!r}e0 * {radius!r}e0").drop(*KEY)


KEY = ["cx", "cy", "cz", "bq", "bp"]


def in_blocks(q: DataFrame, p: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """Both sides of a join on cells with the blocks bq, bp, so that each pair of a cell meets in exactly one KEY.

    A row's own block follows from its values; it goes to all blocks of the other side. Only
    cells with over `block` rows of a side are cut, and only those are broadcast. Both sides
    are dealt by KEY here, as the engine would merge partitions that are small before they are joined.
    """
    at = KEY[:3]
    both = q.selectExpr(*at, "1 AS q", "0 AS p").unionByName(p.selectExpr(*at, "0 AS q", "1 AS p"))
    cut = both.groupBy(*at).agg(*[F.expr(f"CAST(ceil(sum({s}) / {block}) AS INT)").alias(f"n{s}") for s in "qp"])
    cut = F.broadcast(cut.where("nq > 0 AND np > 0 AND nq + np > 2"))
    n = int(q.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def dealt(df: DataFrame, own: str, other: str) -> DataFrame:
        row = ", ".join(c for c in df.columns if c not in at)
        own_block = f"CAST(pmod(xxhash64({row}), coalesce(n{own}, 1)) AS INT) AS b{own}"
        every = f"explode(sequence(0, coalesce(n{other}, 1) - 1)) AS b{other}"
        return df.join(cut, at, "left").selectExpr(*df.columns, own_block, every).repartition(n, *KEY)

    return dealt(q, "q", "p"), dealt(p, "p", "q")


def nearest(queries: DataFrame, points: DataFrame, k: int = 5, radius: float = RADIUS) -> DataFrame:
    """within_radius() with rank rn, the k nearest only; ties by x, then id. No pairs beyond them are made."""
    return neighbours.nearest(queries, points, k, radius)


def in_box(lo: str = "lo_", hi: str = "hi_") -> Column:
    """Half-open on every axis."""
    return reduce(and_, [(F.col(c) >= F.col(f"{lo}{c}")) & (F.col(c) < F.col(f"{hi}{c}")) for c in "xyz"])


def box_join(points: DataFrame, boxes: DataFrame, edge: float, how: str = "inner") -> DataFrame:
    """points joined (inner, left_semi, left_anti) to boxes (box_id, lo_x .. hi_z).

    A box is dealt to the cells it touches, so edge should be near the size of a box.
    """
    b = boxes
    for c in "xyz":
        b = b.withColumn(f"c{c}", F.expr(f"explode(sequence({voxel(f'lo_{c}', edge)}, {voxel(f'hi_{c}', edge)}))"))
    p = points.select("*", *cell(edge))
    same = reduce(and_, [p[f"c{c}"] == b[f"c{c}"] for c in "xyz"])
    joined = p.join(b, same & in_box(), how)
    return joined.drop(*[p[f"c{c}"] for c in "xyz"], *([b[f"c{c}"] for c in "xyz"] if how == "inner" else []))


def voxel_centroid(points: DataFrame, leaf: float, keys: list[str], values: list[str]) -> DataFrame:
    """Mean of every value per voxel (and key), with the number of points."""
    return points.groupBy(*keys, *cell(leaf)).agg(*[F.avg(v).alias(v) for v in values], F.count("*").alias("n"))


def voxel_argmin(points: DataFrame, leaf: float) -> DataFrame:
    """The point of each voxel that is nearest its centre; of equals the latest seq."""
    d2 = " + ".join(f"({c} - (floor({c}/{leaf}e0)*{leaf}e0 + {leaf / 2}e0))*({c} - (floor({c}/{leaf}e0)*{leaf}e0 + {leaf / 2}e0))" for c in "xyz")
    return (
        points.withColumn("d2", F.expr(d2))
        .groupBy(*cell(leaf))
        .agg(F.min_by(F.struct("id", "x", "y", "z", "seq"), F.struct(F.col("d2"), -F.col("seq"))).alias("p"))
        .select("cx", "cy", "cz", "p.*")
    )


def insert_downsampled(current: DataFrame, new: DataFrame, leaf: float) -> DataFrame:
    """The map after inserting new points: touched voxels keep one point, others stay."""
    touched = new.select(*cell(leaf)).distinct()
    old = current.select("*", *cell(leaf))
    free = old.join(touched, ["cx", "cy", "cz"], "left_anti").select("id", "x", "y", "z")
    rivals = old.join(touched, ["cx", "cy", "cz"], "left_semi").select("id", "x", "y", "z", F.lit(0).alias("seq"))
    return free.unionByName(voxel_argmin(rivals.unionByName(new.select("id", "x", "y", "z", F.lit(1).alias("seq"))), leaf).select("id", "x", "y", "z"))


def delete_points(current: DataFrame, gone: DataFrame, tol: float = 1e-6) -> DataFrame:
    """current without the points within tol on every axis of one of gone."""
    g = gone.select(*[F.col(c).alias(f"g{c}") for c in "xyz"])
    edge = 1.0
    for c in "xyz":  # both cells where the point lies within tol of a border
        g = g.withColumn(f"c{c}", F.explode(F.array_distinct(F.array(F.expr(voxel(f"(g{c} - {tol}D)", edge)), F.expr(voxel(f"(g{c} + {tol}D)", edge))))))
    p = current.select("*", *cell(edge))
    near = reduce(and_, [F.abs(p[c] - g[f"g{c}"]) < tol for c in "xyz"] + [p[f"c{c}"] == g[f"c{c}"] for c in "xyz"])
    return p.join(g, near, "left_anti").drop("cx", "cy", "cz")


def plane_of(neighbours: DataFrame) -> DataFrame:
    """Per qid the plane (nx, ny, nz, d) through its 5 nearest points, by least squares.

    Solves A n = -1 by the normal equations and Cramer's rule, then scales n to unit
    length; d is 1 / |n|. Queries with fewer than 5 neighbours and singular systems
    (planes through the origin) have no plane. Columns x1 .. z5 stay.
    """
    picks = [F.max(F.when(F.col("rn") == i, F.col(c))).alias(f"{c}{i}") for i in range(1, 6) for c in "xyz"]
    wide = neighbours.where("rn <= 5").groupBy("qid", "qx", "qy", "qz").agg(*picks, F.max("rn").alias("n")).where("n >= 5")
    sums = settled(settled(wide, plane_sums()), plane_minors()).where("abs(det) > 1e-12")
    return settled(settled(sums, plane_solution()), {"un": "sqrt(ux*ux + uy*uy + uz*uz)"}).selectExpr(
        "*", "ux/un AS nx", "uy/un AS ny", "uz/un AS nz", "1e0/un AS d"
    )


def settled(df: DataFrame, made: dict[str, str]) -> DataFrame:
    """df with the named expressions, as columns that later ones refer to and don't repeat.

    The optimizer would else write each expression out wherever its name is used, and
    a filter on a plane's residual would hold thousands of copies.
    """
    row = "named_struct(" + ", ".join(f"'{n}', {e}" for n, e in made.items()) + ")"
    return df.selectExpr("*", f"inline(array({row}))")


def plane_sums() -> dict[str, str]:
    names = {"sxx": "xx", "sxy": "xy", "sxz": "xz", "syy": "yy", "syz": "yz", "szz": "zz"}
    out = {n: "(" + " + ".join(f"{a}{i}*{b}{i}" for i in range(1, 6)) + ")" for n, (a, b) in names.items()}
    return out | {f"s{c}": "(" + " + ".join(f"{c}{i}" for i in range(1, 6)) + ")" for c in "xyz"}


def plane_minors() -> dict[str, str]:
    return {"det": "(sxx*(syy*szz - syz*syz) - sxy*(sxy*szz - syz*sxz) + sxz*(sxy*syz - syy*sxz))"}


def plane_solution() -> dict[str, str]:
    ux = "(-(sx*(syy*szz - syz*syz) - sxy*(sy*szz - syz*sz) + sxz*(sy*syz - syy*sz)) / det)"
    uy = "(-(sxx*(sy*szz - syz*sz) - sx*(sxy*szz - syz*sxz) + sxz*(sxy*sz - sy*sxz)) / det)"
    uz = "(-(sxx*(syy*sz - sy*syz) - sxy*(sxy*sz - sy*sxz) + sx*(sxy*syz - syy*sxz)) / det)"
    return {"ux": ux, "uy": uy, "uz": uz}
