"""Recursive spline estimator: an iterated Kalman filter over the last four control points.

The only inherently sequential operator. Runs are independent: rows are dealt by run,
sorted by time, and each task reads its runs in a stream, some hundreds at a time. Their
filters go on side by side, each an update a round, as arrays over runs: an update is a few
small products, and one by one the calls would cost far more than the numbers. What is
held is bounded by RUNS and ROWS, and many runs scale out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from driftline.functions.scalars import BLEND, CUMULATIVE

B, C = np.array(BLEND, float) / 6, np.array(CUMULATIVE, float) / 6
RUNS, ROWS = 2048, 1 << 18  # runs or rows a task reads before it updates them
SLOPES = 1 << 15  # rows of slopes made at once (240 bytes each)


def quat_mul(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    aw, ax, ay, az = (a[..., i] for i in range(4))
    bw, bx, by, bz = (b[..., i] for i in range(4))
    return np.stack([
        aw * bw - ax * bx - ay * by - az * bz, aw * bx + ax * bw + ay * bz - az * by,
        aw * by - ax * bz + ay * bw + az * bx, aw * bz + ax * by - ay * bx + az * bw,
    ], -1)


def quat_exp(v: np.ndarray) -> np.ndarray:
    """Of half-angle vectors."""
    n = np.sqrt(dot(v, v))[..., None]
    return np.concatenate([np.cos(n), np.sinc(n / np.pi) * v], -1)


def dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a[..., 0] * b[..., 0] + a[..., 1] * b[..., 1] + a[..., 2] * b[..., 2]


def cross(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """np.cross() without its checks, which cost more than the few rows of an update."""
    ax, ay, az = (a[..., i] for i in range(3))
    bx, by, bz = (b[..., i] for i in range(3))
    out = np.empty(np.broadcast_shapes(a.shape, b.shape))
    out[..., 0], out[..., 1], out[..., 2] = ay * bz - az * by, az * bx - ax * bz, ax * by - ay * bx
    return out


def rotate(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    u = q[..., 1:]
    t = 2 * cross(u, v)
    return v + q[..., :1] * t + cross(u, t)


def powers(u: np.ndarray, order: int = 0) -> np.ndarray:
    """Rows of the order-th derivative of 1, u, u^2, u^3."""
    out = np.zeros((*u.shape, 4))
    for p in range(order, 4):
        c = np.prod([p - d for d in range(order)]) if order else 1
        out[..., p] = c * u ** (p - order)
    return out


def rotation(q: np.ndarray) -> np.ndarray:
    """Matrices of unit quaternions."""
    return np.stack([rotate(q, np.broadcast_to(e, (*q.shape[:-1], 3))) for e in np.eye(3)], -1)


def skew(v: np.ndarray) -> np.ndarray:
    x, y, z = (v[..., i] for i in range(3))
    out = np.zeros((*v.shape, 3))
    out[..., 0, 1], out[..., 0, 2], out[..., 1, 0], out[..., 1, 2], out[..., 2, 0], out[..., 2, 1] = -z, y, z, -x, -y, x
    return out


def jacobian_terms(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """a, b of the right Jacobian I - a [v] + b [v][v] of a rotation vector v."""
    t2 = dot(v, v)
    t, small = np.sqrt(t2), t2 < 1e-10
    safe, safe2 = np.where(small, 1.0, t), np.where(small, 1.0, t2)
    a = np.where(small, 0.5 - t2 / 24, (1 - np.cos(safe)) / safe2)
    return a, np.where(small, 1 / 6 - t2 / 120, (safe - np.sin(safe)) / (safe2 * safe))


def right_jacobian(v: np.ndarray) -> np.ndarray:
    """J with exp(v + e) = exp(v) exp(J e) for rotation vectors v and small e; the limit near zero."""
    a, b = (c[..., None, None] for c in jacobian_terms(v))
    k = skew(v)
    return np.eye(3) - a * k + b * (k @ k)


@dataclass
class Window:
    """Four control points x (positions and rotation deltas, row by row), q before them.

    Leading axes are runs; sums run along other axes, so a run's numbers don't depend on
    the runs beside it.
    """

    x: np.ndarray  # 4 x 6 values, then biases if inertial
    q0: np.ndarray = field(default_factory=lambda: np.array([1.0, 0, 0, 0]))

    def at(self, x: np.ndarray, u: np.ndarray, dt: float) -> tuple[np.ndarray, ...]:
        """Position, orientation, acceleration and body rate at u in the last segment.

        x holds a state per row; results are indexed by state, then u.
        """
        k, (c, each) = knots(x), self.turns(x, u)
        acc, dc = powers(u, 2) @ B.T / dt**2 @ k[..., :3], powers(u, 1) @ C.T / dt
        omega = np.zeros((*each[0].shape[:-1], 3))
        for i in range(1, 4):
            omega = rotate(each[i] * INVERSE, omega) + 2 * dc[..., i : i + 1] * k[..., None, i, 3:]
        return *self.pose(x, u, each), acc, omega

    def pose(self, x: np.ndarray, u: np.ndarray, each: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Position and orientation alone."""
        q = self.q0[..., None, :]
        for turn in each or self.turns(x, u)[1]:
            q = quat_mul(q, turn)
        norm = np.sqrt(q[..., 0] * q[..., 0] + dot(q[..., 1:], q[..., 1:]))[..., None]
        return powers(u) @ B.T @ knots(x)[..., :3], q / norm

    def turns(self, x: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Weights of the control points and the rotation that each adds."""
        k, c = knots(x), powers(u) @ C.T
        return c, [quat_exp(c[..., i : i + 1] * k[..., None, i, 3:]) for i in range(4)]

    def point_rows(self, x: np.ndarray, u: np.ndarray, body: np.ndarray, normal: np.ndarray) -> np.ndarray:
        """d(normal . (R body + p))/dx, a row of 24 per point.

        For delta k with the rotation A up to it and D behind it this is
        (D body x A' normal) J, where J is of the right Jacobian.
        """
        k, (c, each) = knots(x), self.turns(x, u)
        behind = [body]
        for turn in each[:0:-1]:
            behind.insert(0, rotate(turn, behind[0]))
        out, w = np.empty((*normal.shape[:-1], 4, 6)), powers(u) @ B.T
        seen = rotate(unit(self.q0)[..., None, :] * INVERSE, normal)
        for i in range(4):
            seen = rotate(each[i] * INVERSE, seen)
            v, row = 2 * c[..., i : i + 1] * k[..., None, i, 3:], cross(behind[i], seen)
            (a, b), turned = jacobian_terms(v), cross(v, row)
            out[..., i, :3] = w[..., i : i + 1] * normal
            out[..., i, 3:] = 2 * c[..., i : i + 1] * (row + a[..., None] * turned + b[..., None] * cross(v, turned))
        return out.reshape(*normal.shape[:-1], 24)

    def inertial_rows(self, x: np.ndarray, u: np.ndarray, dt: float, up: np.ndarray) -> np.ndarray:
        """d(R' (acceleration + up))/dx and d(body rate)/dx (2 x m x 3 x 24; runs, if any, come second)."""
        k, (c, turns) = knots(x), self.turns(x, u)
        each = [rotation(q) for q in turns]
        dc, ddw = powers(u, 1) @ C.T / dt, powers(u, 2) @ B.T / dt**2
        jac = [right_jacobian(2 * c[..., i : i + 1] * k[..., None, i, 3:]) * 2 * c[..., i, None, None] for i in range(4)]
        behind = [np.eye(3)]
        for turn in each[:0:-1]:
            behind.insert(0, turn @ behind[0])
        seen = rotate(unit(self.q0)[..., None, :] * INVERSE, ddw @ k[..., :3] + up)
        out = np.zeros((2, *each[0].shape[:-2], 3, 4, 6))
        back = np.swapaxes(rotation(unit(self.q0))[..., None, :, :] @ each[0] @ behind[0], -1, -2)
        omega = np.zeros(seen.shape)
        for i in range(4):
            seen = rotate(turns[i] * INVERSE, seen)
            out[0, ..., i, :3] = ddw[..., i, None, None] * back
            out[0, ..., i, 3:] = np.swapaxes(behind[i], -1, -2) @ skew(seen) @ jac[i]
            if i:
                inverse = np.swapaxes(each[i], -1, -2)
                omega = rotate(turns[i] * INVERSE, omega)
                for j in range(1, i):
                    out[1, ..., j, 3:] = inverse @ out[1, ..., j, 3:]
                out[1, ..., i, 3:] = skew(omega) @ jac[i] + 2 * dc[..., i, None, None] * np.eye(3)
                omega = omega + 2 * dc[..., i : i + 1] * k[..., None, i, 3:]
        return out.reshape(*out.shape[:-2], 24)


INVERSE = np.array([1.0, -1, -1, -1])


def knots(x: np.ndarray) -> np.ndarray:
    return x[..., :24].reshape(*x.shape[:-1], 4, 6)


def unit(q: np.ndarray) -> np.ndarray:
    return q / np.sqrt(q[..., 0] * q[..., 0] + dot(q[..., 1:], q[..., 1:]))[..., None]


@dataclass
class Settings:
    dt: float = 1.0
    cov_start: float = 0.02
    cov_old: float = 0.1
    cov_new: float = 1.0
    std_pos: float = 0.2
    std_rot: float = 0.1
    point_threshold: float = 0.5
    coeff_cov: float = 10.0
    cov_acc: float = 1.0
    cov_gyro: float = 0.1
    cov_bias: float = 0.2
    iterations: int = 5
    gravity: float = 9.81


class Filters:
    """Propagation, gating and iterated update of runs side by side; `who` are indices of runs."""

    def __init__(self, s: Settings, inertial: bool, runs: int):
        n = 30 if inertial else 24
        self.s, self.n = s, n
        self.x, self.q0, self.knots = np.zeros((runs, n)), np.tile([1.0, 0, 0, 0], (runs, 1)), np.full(runs, 4)
        self.cov = np.empty((runs, n, n))
        self.cov[:] = np.diag(np.concatenate([np.full(24, s.cov_start * s.dt**2), np.full(n - 24, s.cov_bias)]))
        std = np.tile([s.std_pos**2] * 3 + [s.std_rot**2] * 3, 4) * s.dt**2
        old = np.repeat([s.cov_old] * 3 + [s.cov_new], 6)
        self.noise = np.diag(np.concatenate([old * std, np.zeros(n - 24)]))

    def state(self, run: int) -> tuple:
        return tuple(a[run].copy() for a in (self.x, self.q0, self.knots, self.cov))

    def resume(self, run: int, state: tuple) -> None:
        self.x[run], self.q0[run], self.knots[run], self.cov[run] = state

    def propagate(self, who: np.ndarray, segment: np.ndarray) -> None:
        """Adds knots until the last segment is `segment`; noise alone if it is already."""
        here = who[segment <= self.knots[who] - 4]
        self.cov[here] += self.noise
        who, left = who[segment > self.knots[who] - 4], (segment - self.knots[who] + 4)[segment > self.knots[who] - 4]
        while len(who):
            x, cov = self.x[who], self.cov[who]
            self.q0[who] = quat_mul(self.q0[who], quat_exp(x[:, 3:6]))
            self.x[who] = shifted(x)
            # Along one axis, then along the other.
            self.cov[who] = np.swapaxes(shifted(np.swapaxes(shifted(cov), 1, 2)), 1, 2) + self.noise
            self.knots[who] += 1
            who, left = who[left > 1], left[left > 1] - 1

    def pose(self, who: np.ndarray) -> np.ndarray:
        """px, py, pz, qw, qx, qy, qz at the end of the last segment."""
        p, q = Window(self.x[who], self.q0[who]).pose(self.x[who], np.ones((len(who), 1)))
        return np.concatenate([p[:, 0], q[:, 0]], 1)

    def update(self, who, wide, real, u, body, normal, offset, w_pt, real_imu=None, imu_u=None, imu=None) -> np.ndarray:
        """Point-to-plane rows normal . (R p + t) + offset, and inertial rows; returns rows used of each run.

        Arrays are indexed by run, then row; rows that aren't real count for nothing.
        wide: there are more rows than values of a state.
        """
        s, n, m = self.s, self.n, u.shape[1]
        k = imu_u.shape[1] if imu is not None else 0
        up = np.array([0, 0, s.gravity])
        noise, count = np.where(real, w_pt, 1.0), np.zeros(len(who), np.int64)
        held = {"at": np.arange(len(who)), "x": self.x[who], "x0": self.x[who], "q0": self.q0[who], "p0": self.cov[who], "settled": np.zeros(len(who), np.int64)}
        held |= {"real": real, "u": u, "body": body, "normal": normal, "offset": offset, "w_pt": w_pt}
        if k:
            held |= {"real_imu": np.repeat(real_imu, 3, 1), "imu_u": imu_u, "acc": imu[..., :3].reshape(len(who), -1), "gyro": imu[..., 3:].reshape(len(who), -1)}
            noise = np.concatenate([noise, np.where(held["real_imu"], s.cov_acc, 1.0), np.where(held["real_imu"], s.cov_gyro, 1.0)], 1)
        held["noise"] = noise
        if wide:
            held["inverse"] = np.linalg.inv(held["p0"])
        for i in range(s.iterations):
            g = SimpleNamespace(**held)
            window = Window(g.x, g.q0)
            p, q = window.pose(g.x, g.u)
            z = -(dot(g.normal, rotate(q, g.body) + p) + g.offset)
            h = np.zeros((len(z), m + 6 * k, n))
            h[:, :m, :24] = window.point_rows(g.x, g.u, g.body, g.normal)
            ph = h @ g.p0  # p0 is symmetric
            gate = g.real & ((np.abs(z) < s.point_threshold) | ((ph[:, :m] * h[:, :m]).sum(-1) + g.w_pt < g.w_pt * s.coeff_cov))
            drop, used = ~gate, gate.sum(1)
            if k:
                _, q, acc, omega = window.at(g.x, g.imu_u, s.dt)
                force = rotate(q * INVERSE, acc + up) + g.x[:, None, 24:27]
                za, zg = g.acc - force.reshape(len(z), -1), g.gyro - (omega + g.x[:, None, 27:30]).reshape(len(z), -1)
                rows = window.inertial_rows(g.x, g.imu_u, s.dt, up).reshape(2, len(z), 3 * k, 24)
                h[:, m : m + 3 * k, :24], h[:, m + 3 * k :, :24] = rows
                h[:, m : m + 3 * k, 24:27] = h[:, m + 3 * k :, 27:30] = np.tile(np.eye(3), (k, 1))
                ph[:, m:] = h[:, m:] @ g.p0
                drop = np.concatenate([drop, ~g.real_imu | (np.abs(za) > 10), ~g.real_imu | (np.abs(zg) > 5)], 1)
                z = np.concatenate([z, za, zg], 1)
            z[drop], h[drop], ph[drop] = 0, 0, 0
            back = g.x - g.x0
            z += (h @ back[..., None])[..., 0]
            if wide:  # information form
                hw = np.swapaxes(h / g.noise[..., None], 1, 2)
                seen = hw @ h
                inverse = np.linalg.inv(seen + g.inverse)
                step = (inverse @ (hw @ z[..., None]))[..., 0] - back
            else:
                inverse = h @ np.swapaxes(ph, 1, 2)
                inverse[:, np.arange(m + 6 * k), np.arange(m + 6 * k)] += g.noise
                inverse = np.linalg.inv(inverse) if m + 6 * k > 1 else 1 / inverse
                step = (np.swapaxes(ph, 1, 2) @ (inverse @ z[..., None]))[..., 0] - back
            some = used > 0
            held["x"] = x = np.where(some[:, None], g.x + step, g.x)
            held["settled"] = g.settled + (np.sqrt((step * step).sum(1)) <= 0.1)
            done = ~some | (held["settled"] > 1) | (i == s.iterations - 1)
            count[g.at], self.x[who[g.at[done]]] = used, x[done]
            last = done & some
            if last.any():
                cov, part, ph = g.p0[last], inverse[last], ph[last]
                cov = cov - (part @ seen[last] @ cov if wide else np.swapaxes(ph, 1, 2) @ (part @ ph))
                self.cov[who[g.at[last]]] = (cov + np.swapaxes(cov, 1, 2)) / 2
            if done.all():
                break
            if done.any():
                held = {c: v[~done] for c, v in held.items()}
        return count


def shifted(a: np.ndarray) -> np.ndarray:
    """The states (axis 1) after one more knot: its position goes on from the two before the last, its turn is the third's."""
    out = np.empty_like(a, order="C")
    out[:, :18], out[:, 24:] = a[:, 6:24], a[:, 24:]
    out[:, 18:21], out[:, 21:24] = 2 * a[:, 12:15] - a[:, 0:3], a[:, 9:12]
    return out


POSES = T.StructType(
    [T.StructField("run", T.StringType()), T.StructField("segment", T.LongType()), T.StructField("n", T.LongType()), T.StructField("used", T.LongType())]
    + [T.StructField(c, T.DoubleType()) for c in ("px", "py", "pz", "qw", "qx", "qy", "qz")]
)


def estimate(measurements: DataFrame, settings: Settings, inertial: bool = False, cap: int = 300) -> DataFrame:
    """Poses at the end of each segment of every run.

    measurements: run, segment (long, from 0), u, kind (0 inertial, 1 point), then for
    points bx..bz (body), nx..nz, d, w_pt and for inertial rows ax..az, gx..gz. At most
    `cap` rows of a segment make one update; more make several. A run is read in order
    of segment, u, kind, id; a task holds the filters of about RUNS runs and about ROWS rows.
    A segment goes on across batches, so results don't depend on where they end, nor on
    which runs are updated together.
    """
    cols = ["run", "segment", "u", "kind", "id", *POINT, *INERTIAL]
    # A stated number, as few small rows still mean much work.
    tasks = int(measurements.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = measurements.select(*cols).repartition(tasks, "run").sortWithinPartitions("run", "segment", "u", "kind", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, held, runs = Stream(settings, inertial, cap), [], 0
        for b in batches:
            held.append(b)
            runs += len(pc.run_end_encode(b.column("run")).values)
            if runs >= RUNS or sum(h.num_rows for h in held) >= ROWS:
                out, rest = stream.feed(pa.Table.from_batches(held), False)
                held, runs = rest.to_batches(), 0
                yield from out.to_batches()
        if held or stream.open:
            yield from stream.feed(pa.Table.from_batches(held, stream.schema), True)[0].to_batches()

    return ordered.mapInArrow(run, POSES)


POINT, INERTIAL = ["bx", "by", "bz", "nx", "ny", "nz", "d", "w_pt"], ["ax", "ay", "az", "gx", "gy", "gz"]


@dataclass
class Open:
    """The last run read and its last segment, of which more may come."""

    run: str | None
    segment: int
    state: tuple
    started: bool  # propagated to the segment
    n: int
    used: int


class Stream:
    """Updates of sorted rows, as they come."""

    def __init__(self, settings: Settings, inertial: bool, cap: int):
        self.settings, self.inertial, self.cap = settings, inertial, cap
        self.open: Open | None = None
        self.schema: pa.Schema | None = None

    def feed(self, rows: pa.Table, end: bool) -> tuple[pa.Table, pa.Table]:
        """Poses of the segments that are over, and rows of the open one that wait for more."""
        self.schema, before, out = rows.schema, self.open, []
        rows = rows.combine_chunks()
        names = pc.run_end_encode(rows.column("run").combine_chunks())
        ends, runs = names.run_ends.to_numpy(), names.values
        segment = rows.column("segment").to_numpy()
        same_run = before is not None and len(runs) > 0 and runs[0].as_py() == before.run
        goes_on = same_run and segment[0] == before.segment
        filters = Filters(self.settings, self.inertial, max(len(runs), 1))
        if before is not None and not goes_on:  # it ended where the rows did
            closing = Filters(self.settings, self.inertial, 1)
            closing.resume(0, before.state)
            out.append(framed(pa.array([before.run], runs.type), [before.segment], [before.n], [before.used], closing.pose(np.array([0]))))
        if same_run:
            filters.resume(0, before.state)
        if not len(rows):
            self.open = None
            return pa.concat_tables(out), rows
        run_of = np.repeat(np.arange(len(runs)), np.diff(ends, prepend=0))
        begin = np.concatenate([[0], np.nonzero((np.diff(segment) != 0) | (np.diff(run_of) != 0))[0] + 1])
        size = np.diff(begin, append=len(rows))
        over = np.full(len(begin), True)
        over[-1] = end
        n, used, started = size.copy(), np.zeros(len(begin), np.int64), np.zeros(len(begin), bool)
        if goes_on:
            n[0], used[0], started[0] = n[0] + before.n, before.used, before.started
        # A step is an update of at most cap rows of a segment; round by round each run makes its next one.
        steps = np.where(over, -(-size // self.cap), size // self.cap)
        of = np.repeat(np.arange(len(begin)), steps)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(steps) - steps, steps)
        lo = begin[of] + nth * self.cap
        hi = np.minimum(lo + self.cap, (begin + size)[of])
        first, last, who = (nth == 0) & ~started[of], (nth == steps[of] - 1) & over[of], run_of[begin[of]]
        turn = np.arange(len(of)) - np.searchsorted(who, who)
        order = np.argsort(turn, kind="stable")
        poses, values = np.empty((len(begin), 7)), Values(rows, self.inertial)
        for step in np.split(order, np.cumsum(np.bincount(turn))[:-1]) if len(order) else ():
            new, closed = step[first[step]], step[last[step]]
            filters.propagate(who[new], segment[lo[new]])
            used[of[step]] += values.update(filters, who[step], lo[step], hi[step])
            poses[of[closed]] = filters.pose(who[closed])
        done = np.nonzero(over)[0]
        out.append(framed(runs.take(pa.array(run_of[begin[done]])), segment[begin[done]], n[done], used[done], poses[done]))
        rest = rows.slice(begin[-1] + steps[-1] * self.cap) if not end else rows.slice(0, 0)
        self.open = None
        if not end:
            started = bool(started[-1] or steps[-1])
            self.open = Open(runs[-1].as_py(), int(segment[-1]), filters.state(len(runs) - 1), started, int(n[-1]) - len(rest), int(used[-1]))
        return pa.concat_tables(out), rest


class Values:
    """Numbers of the rows: those of points and inertial ones apart."""

    def __init__(self, rows: pa.Table, inertial: bool):
        kind, self.inertial = rows.column("kind").to_numpy(), inertial
        self.points, self.imu = ((np.concatenate([[0], np.cumsum(kind == k)]), self._numbers(rows, kind == k, names)) for k, names in ((1, POINT), (0, INERTIAL)))

    @staticmethod
    def _numbers(rows: pa.Table, which: np.ndarray, names: list[str]) -> np.ndarray:
        return np.stack([rows.column(c).to_numpy()[which] for c in ("u", *names)], 1)

    @staticmethod
    def _rows(values: np.ndarray, at: np.ndarray, count: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """width rows from each of `at`; those past count aren't real and zero."""
        real = np.arange(width) < count[:, None]
        out = np.zeros((*real.shape, values.shape[1]))
        out[real] = values[(at[:, None] + np.arange(width))[real]]
        return real, out

    def update(self, filters: Filters, who: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Updates by rows lo to hi; returns how many of each are used."""
        (cp, points), (ci, imu), used = self.points, self.imu, np.zeros(len(who), np.int64)
        m, k = cp[hi] - cp[lo], ci[hi] - ci[lo]
        if not self.inertial:
            k = np.zeros_like(k)
        # Runs with like numbers of rows go together; how a run is filled up depends on its own rows only.
        kinds = np.stack([ceil2(m), ceil2(k), m + 6 * k > filters.n], 1)[m > 0]
        groups, of = np.unique(kinds, axis=0, return_inverse=True)
        for i, (width, width_imu, wide) in enumerate(groups):
            like = np.nonzero(m > 0)[0][of.ravel() == i]
            for at in np.array_split(like, -(-len(like) * (width + 6 * width_imu) // SLOPES)):
                real, p = self._rows(points, cp[lo[at]], m[at], width)
                rows = [real, p[..., 0], p[..., 1:4], p[..., 4:7], p[..., 7], p[..., 8]]
                if width_imu:
                    real, a = self._rows(imu, ci[lo[at]], k[at], width_imu)
                    rows += [real, a[..., 0], a[..., 1:]]
                used[at] = filters.update(who[at], bool(wide), *rows)
        return used


def ceil2(n: np.ndarray) -> np.ndarray:
    """The next power of two; 0 of 0."""
    return np.where(n > 0, 1 << np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64), 0)


def framed(run: pa.Array, segment, n, used, poses: np.ndarray) -> pa.Table:
    return pa.Table.from_arrays([run, *(pa.array(np.asarray(c, np.int64)) for c in (segment, n, used)), *map(pa.array, np.ascontiguousarray(poses.T))], POSES.fieldNames())
