"""Scalar expressions as text that Spark SQL (and any SQL with the same functions) reads.

A quaternion or vector is a tuple of expression texts. Everything stays in generated code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Q = tuple[str, str, str, str]
V = tuple[str, str, str]


def vec(p: str, names: str = "xyz") -> V:
    return tuple(f"{p}{c}" for c in names)


def quat(p: str) -> Q:
    return tuple(f"{p}{c}" for c in "wxyz")


def quat_mul(a: Q, b: Q) -> Q:
    (aw, ax, ay, az), (bw, bx, by, bz) = a, b
    return (
        f"({aw}*{bw} - {ax}*{bx} - {ay}*{by} - {az}*{bz})",
        f"({aw}*{bx} + {ax}*{bw} + {ay}*{bz} - {az}*{by})",
        f"({aw}*{by} - {ax}*{bz} + {ay}*{bw} + {az}*{bx})",
        f"({aw}*{bz} + {ax}*{by} - {ay}*{bx} + {az}*{bw})",
    )


def quat_exp(v: V) -> Q:
    """Of a half-angle vector: (cos n, sin n / n v)."""
    n = "sqrt(" + " + ".join(f"({c})*({c})" for c in v) + ")"
    sinc = f"(CASE WHEN {n} = 0 THEN 1e0 ELSE sin({n}) / {n} END)"
    return (f"cos({n})", *(f"({sinc}*({c}))" for c in v))


def quat_positive(q: Q) -> Q:
    """The same rotation with w >= 0."""
    return tuple(f"(CASE WHEN {q[0]} < 0 THEN -({c}) ELSE {c} END)" for c in q)


def rotate(q: Q, v: V) -> V:
    """R(q) v for a unit quaternion."""
    w, x, y, z = q
    a, b, c = v
    tx, ty, tz = f"(2e0*({y}*({c}) - {z}*({b})))", f"(2e0*({z}*({a}) - {x}*({c})))", f"(2e0*({x}*({b}) - {y}*({a})))"
    return (
        f"(({a}) + {w}*{tx} + {y}*{tz} - {z}*{ty})",
        f"(({b}) + {w}*{ty} + {z}*{tx} - {x}*{tz})",
        f"(({c}) + {w}*{tz} + {x}*{ty} - {y}*{tx})",
    )


#: Cubic uniform B-spline blending, times 6: rows are control points, columns powers of u.
BLEND = ((1, -3, 3, -1), (4, 0, -6, 3), (1, 3, 3, -3), (0, 0, 0, 1))
CUMULATIVE = ((6, 0, 0, 0), (5, 3, -3, 1), (1, 3, 3, -2), (0, 0, 0, 1))


def weight(row: tuple[int, ...], u: str, order: int = 0) -> str:
    """A blending polynomial or its order-th derivative in u."""
    terms = []
    for p, c in enumerate(row):
        for d in range(order):
            c *= p - d
        if c:
            terms.append(f"{c}e0" + f"*{u}" * (p - order))
    return "((" + " + ".join(terms or ["0e0"]) + ") / 6e0)"


def spline(points: list[str], u: str, order: int = 0, step_s: float = 1.0) -> str:
    """Value (or derivative per second) at u of the four control values."""
    total = " + ".join(f"{weight(r, u, order)}*{p}" for r, p in zip(BLEND, points, strict=True))
    return f"(({total}) / {step_s**order!r}e0)" if order else f"({total})"


def voxel(c: str, leaf: float) -> str:
    return f"CAST(floor({c} / {leaf}e0) AS BIGINT)"


def with_quat(df: DataFrame, name: str, q: Q) -> DataFrame:
    return df.withColumns({f"{name}{c}": F.expr(e) for c, e in zip("wxyz", q, strict=True)})


def offset_ms(ns: str) -> str:
    """ns as float32 milliseconds, rounded once.

    Adding a float32 zero keeps the optimizer from dropping the cast to float32.
    """
    return f"CAST(CAST(CAST({ns} AS FLOAT) + CAST(0 AS FLOAT) AS DOUBLE) / 1e6 AS FLOAT)"


def ms_to_ns(ms: str) -> Column:
    """float32 product, cut to whole ns."""
    return F.expr(f"CAST(CAST({ms} AS FLOAT) * CAST(1e6 AS FLOAT) AS BIGINT)")


def gravity_rotation(g: V) -> Q:
    """The shortest rotation of g to +z, with w >= 0; for g = -z, half a turn about x.

    It has no turn about z of its own, so the heading stays.
    """
    n = "sqrt(" + " + ".join(f"{c}*{c}" for c in g) + ")"
    s = f"(1e0 + {g[2]}/{n})"
    m = f"sqrt({s}*{s} + ({g[0]}*{g[0]} + {g[1]}*{g[1]})/({n}*{n}))"
    flip = f"{s} < 1e-12"
    return (
        f"(CASE WHEN {flip} THEN 0e0 ELSE {s}/{m} END)",
        f"(CASE WHEN {flip} THEN 1e0 ELSE ({g[1]}/{n})/{m} END)",
        f"(CASE WHEN {flip} THEN 0e0 ELSE (-({g[0]})/{n})/{m} END)",
        "0e0",
    )


def yaw_pitch_roll(q: Q) -> V:
    """Degrees, for R = Rz(yaw) Ry(pitch) Rx(roll)."""
    w, x, y, z = q
    return (
        f"degrees(atan2(2e0*({x}*{y} + {w}*{z}), {w}*{w} + {x}*{x} - {y}*{y} - {z}*{z}))",
        f"degrees(asin(greatest(-1e0, least(1e0, 2e0*({w}*{y} - {x}*{z})))))",
        f"degrees(atan2(2e0*({y}*{z} + {w}*{x}), {w}*{w} - {x}*{x} - {y}*{y} + {z}*{z}))",
    )


def rounded(digits: int, **expr: str) -> list[Column]:
    """Named columns, rounded; adding zero turns -0.0 into 0.0."""
    return [F.expr(f"round({e}, {digits}) + 0e0").alias(n) for n, e in expr.items()]


def rounded_sql(digits: int, **expr: str) -> str:
    return ", ".join(f"round({e}, {digits}) + 0e0 AS {n}" for n, e in expr.items())
