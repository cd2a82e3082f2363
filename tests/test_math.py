"""Numeric properties of the spline, the filter and the late mark."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from driftline.functions import scalars as S
from driftline.operators import neighbours, space, trajectory
from driftline.sources import messages
from driftline.sources.config import RunConfig, Sensor
from driftline.streaming import estimator, late, windows


def test_blending_is_a_partition_of_unity():
    u = np.linspace(0, 1, 11)
    w = estimator.powers(u) @ estimator.B.T
    assert np.allclose(w.sum(1), 1) and np.allclose((estimator.powers(u, 1) @ estimator.B.T).sum(1), 0)
    cumulative = np.cumsum(w[:, ::-1], 1)[:, ::-1]
    assert np.allclose(cumulative, estimator.powers(u) @ estimator.C.T)


def test_derivatives_and_body_rate_by_finite_differences():
    rng = np.random.default_rng(0)
    win = estimator.Window(np.zeros(24), np.array([0.8, 0.6, 0, 0]))
    x, dt, e = rng.normal(size=(1, 24)) * 0.3, 0.5, 1e-5
    at = lambda u: win.at(x, np.array([u]), dt)
    (p0, q0, _, _), (p1, q1, acc, omega), (p2, q2, _, _) = at(0.4 - e), at(0.4), at(0.4 + e)
    assert np.allclose((p2 - 2 * p1 + p0) / (e * dt) ** 2, acc, atol=1e-3)
    rate = 2 * estimator.quat_mul(q1 * np.array([1, -1, -1, -1]), (q2 - q0) / (2 * e * dt))
    assert np.allclose(rate[..., 1:], omega, atol=1e-5)


@pytest.mark.parametrize("scale", [0.0, 1e-7, 0.3, 1.5])
def test_slopes_equal_finite_differences(scale):
    rng, dt, up = np.random.default_rng(7), 0.5, np.array([0, 0, 9.81])
    win = estimator.Window(np.zeros(24), np.array([0.8, 0.6, 0, 0]))
    x, u = rng.normal(size=24), np.array([0.0, 0.2, 0.9, 1.0])
    x.reshape(4, 6)[:, 3:] *= scale
    body, normal = rng.normal(size=(4, 3)), rng.normal(size=(4, 3))
    inverse = np.array([1, -1, -1, -1])

    def seen(x):
        p, q, acc, omega = win.at(x, u, dt)
        return np.concatenate([np.sum(normal * (estimator.rotate(q, body) + p), -1), estimator.rotate(q * inverse, acc + up).reshape(len(x), -1), omega.reshape(len(x), -1)], 1)

    e = np.eye(24) * 1e-6
    want = (seen(x + e) - seen(x - e)).T / 2e-6
    got = np.concatenate([win.point_rows(x, u, body, normal), win.inertial_rows(x, u, dt, up).reshape(-1, 24)])
    assert np.allclose(got, want, atol=1e-5 * max(1, np.abs(want).max()))


def test_products_of_vectors_equal_numpy():
    rng = np.random.default_rng(13)
    a, b = rng.normal(size=(2, 4, 5, 3))
    assert np.array_equal(estimator.cross(a, b), np.cross(a, b)) and np.array_equal(estimator.cross(a[:1, :1], b), np.cross(a[:1, :1], b))
    assert np.array_equal(np.einsum("mnij,mnj->mni", estimator.skew(a), b), np.cross(a, b))


def test_expressions_equal_numpy(spark):
    rng = np.random.default_rng(1)
    rows = rng.normal(size=(20, 11)).tolist()
    names = ["aw", "ax", "ay", "az", "bw", "bx", "by", "bz", "vx", "vy", "vz"]
    df = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names))
    mul, exp, rot = S.quat_mul(S.quat("a"), S.quat("b")), S.quat_exp(S.vec("v")), S.rotate(S.quat("a"), S.vec("v"))
    got = np.array([list(r) for r in df.selectExpr(*mul, *exp, *rot).collect()])
    r = np.array(rows)
    assert np.allclose(got[:, :4], estimator.quat_mul(r[:, :4], r[:, 4:8]))
    assert np.allclose(got[:, 4:8], estimator.quat_exp(r[:, 8:]))
    assert np.allclose(got[:, 8:], estimator.rotate(r[:, :4], r[:, 8:]))


def test_gravity_rotation_points_up(spark):
    df = spark.createDataFrame([(0.1, -3.0, 9.0), (0.0, 0.0, -9.81), (5.0, 1.0, -2.0)], "gx double, gy double, gz double")
    q = S.gravity_rotation(S.vec("g"))
    for r in df.selectExpr("gx", "gy", "gz", *q).collect():
        v = estimator.rotate(np.array(r[3:]), np.array(r[:3]))
        assert np.allclose(v, [0, 0, np.linalg.norm(r[:3])], atol=1e-9) and r[3] >= 0


def test_body_frame_inverts_the_sensor_frame():
    s = Sensor("a", "HAP360", 4, q_lb=(0.9, 0.1, -0.3, 0.2), t_lb=(1.0, -2.0, 0.5))
    q, t = (np.array(v) for v in s.body_frame())
    unit = np.array(s.q_lb) / np.linalg.norm(s.q_lb)
    assert np.allclose(estimator.rotate(unit, t), [-1.0, 2.0, -0.5])
    assert np.allclose(estimator.quat_mul(q, np.array(s.q_lb)), [1, 0, 0, 0])


def test_config_rejects_unknown_and_repeated():
    base = {"sensors": [{"name": "a", "kind": "Hesai", "scan_line": 4}], "lidar_only": True, "point_filter_num": 1, "scan_voxel": 0.5, "map_voxel": 0.5}
    assert RunConfig.from_dict(base).coeff_cov == 10.0
    with pytest.raises(ValueError):
        RunConfig.from_dict(base | {"nonsense": 1})
    with pytest.raises(ValueError):
        RunConfig.from_dict(base | {"sensors": base["sensors"] * 2})
    with pytest.raises(TypeError):
        RunConfig.from_dict({k: v for k, v in base.items() if k != "scan_voxel"})


def test_nested_messages_flatten(spark):
    rows = [("a", 0, 10, [(0, 1.0, 2.0, 3.0, 4, 16, 0), (5, 1.0, 2.0, 3.0, 4, 32, 1)]), ("a", 1, 20, [])]
    flat = messages.flatten(spark.createDataFrame(rows, messages.message(messages.LIVOX_POINT)))
    assert [(r.pos, r.offset_time, r.tag) for r in flat.orderBy("pos").collect()] == [(0, 0, 16), (1, 5, 32)]
    with pytest.raises(ValueError):
        messages.decode(flat, "Radar")


def test_late_mark_may_go_back(spark):
    rng = np.random.default_rng(2)
    rows, begin = [], 0
    for m in range(60):
        begin += int(rng.integers(-60, 90))
        rows += [(s, m, begin, begin + int(rng.integers(0, 100)), i) for s in ("a", "b") for i in range(int(rng.integers(1, 5)))]
    df = spark.createDataFrame(rows, "sensor string, msg bigint, begin_ns bigint, t_ns bigint, id bigint")
    want = set()
    for s in ("a", "b"):
        last = None
        for m in range(60):
            own = [r for r in rows if r[0] == s and r[1] == m]
            last = own[0][2] if last is None else last
            kept = [r for r in own if r[3] > last]
            want |= {(s, m, r[3], r[4]) for r in kept}
            last = max(r[3] for r in kept) if kept else own[0][2]
    assert {(r.sensor, r.msg, r.t_ns, r.id) for r in late.drop_late(df).collect()} == want


def test_filter_follows_a_known_motion(spark):
    rng = np.random.default_rng(3)
    rows = []
    for run in ("a", "b"):
        for i in range(1200):
            t = i / 40
            seg, u = int(t), t - int(t)
            body = rng.normal(size=3)
            axis = i % 3
            normal = np.eye(3)[axis]
            world = np.array([0.2 * t, 1.0 - 0.1 * t, 0.05 * t]) + body
            rows.append((run, seg, u, 1, i, *body.tolist(), *normal.tolist(), float(-world[axis]), 1e-4, *[0.0] * 6))
    ddl = "run string, segment bigint, u double, kind int, id bigint, " + ", ".join(f"{c} double" for c in "bx by bz nx ny nz d w_pt ax ay az gx gy gz".split())
    settings = estimator.Settings(cov_start=1.0, coeff_cov=1e6, std_rot=0.01)
    got = estimator.estimate(spark.createDataFrame(rows, ddl), settings, cap=50).where("segment = 29").collect()
    assert len(got) == 2
    for r in got:
        assert np.allclose([r.px, r.py, r.pz], [6.0, -2.0, 1.5], atol=0.05) and r.qw > 0.999


def test_poses_do_not_depend_on_batches(spark):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(700):  # one long segment, then short ones
        seg, u = (0, i / 600) if i < 600 else (1 + (i - 600) // 20, (i - 600) % 20 / 20)
        normal = np.eye(3)[i % 3]
        rows.append(("a", seg, u, 1, i, *rng.normal(size=3).tolist(), *normal.tolist(), float(rng.normal() * 0.1), 1e-2, *[0.0] * 6))
    ddl = "run string, segment bigint, u double, kind int, id bigint, " + ", ".join(f"{c} double" for c in "bx by bz nx ny nz d w_pt ax ay az gx gy gz".split())
    df, name, found = spark.createDataFrame(rows, ddl), "spark.sql.execution.arrow.maxRecordsPerBatch", []
    before = spark.conf.get(name)
    try:
        for size in ("10000", "150", "7"):
            spark.conf.set(name, size)
            found.append(sorted(estimator.estimate(df, estimator.Settings(), cap=6).collect()))
    finally:
        spark.conf.set(name, before)
    assert [(r.segment, r.n) for r in found[0]] == [(0, 600), *[(s, 20) for s in range(1, 6)]]
    assert found[1] == found[0] and found[2] == found[0]


def plain_filter(rows, s, inertial, cap):
    """Poses of one run, an update at a time, with whole matrices and slopes by finite differences."""
    n = 30 if inertial else 24
    win, knots, found, up = estimator.Window(np.zeros(n)), 4, [], np.array([0, 0, s.gravity])
    cov = np.diag([s.cov_start * s.dt**2] * 24 + [s.cov_bias] * (n - 24))
    noise = np.zeros((n, n))
    noise[:24, :24] = np.diag(np.repeat([s.cov_old] * 3 + [s.cov_new], 6) * np.tile([s.std_pos**2] * 3 + [s.std_rot**2] * 3, 4) * s.dt**2)
    a = np.eye(n)
    a[:24, :24] = np.eye(24, k=6)
    a[18:21, 12:15], a[18:21, 0:3], a[21:24, 9:12] = 2 * np.eye(3), -np.eye(3), np.eye(3)
    for segment in sorted({r[1] for r in rows}):
        own = sorted((r for r in rows if r[1] == segment), key=lambda r: r[2:5])
        if segment <= knots - 4:
            cov = cov + noise
        while segment > knots - 4:
            win.q0 = estimator.quat_mul(win.q0, estimator.quat_exp(win.x[3:6]))
            win.x, cov, knots = a @ win.x, a @ cov @ a.T + noise, knots + 1
        used = 0
        for i in range(0, len(own), cap):
            p, m = (np.array([[r[2], *r[5:]] for r in own[i : i + cap] if r[3] == kind]).reshape(-1, 15) for kind in (1, 0))
            if not len(p):
                continue
            m = m if inertial else m[:0]

            def seen(x, p=p, m=m):
                pos, q, _, _ = win.at(x, p[:, 0], s.dt)
                out = [np.sum(p[:, 4:7] * (estimator.rotate(q, p[:, 1:4]) + pos), -1) + p[:, 7]]
                _, q, acc, omega = win.at(x, m[:, 0], s.dt)
                if len(m):
                    out.append((estimator.rotate(q * np.array([1, -1, -1, -1]), acc + up) + x[:, None, 24:27]).reshape(len(x), -1))
                    out.append((omega + x[:, None, 27:30]).reshape(len(x), -1))
                return np.concatenate(out, 1)

            x0, x, e, settled, gain = win.x, win.x, np.eye(n) * 1e-6, 0, None
            r = np.concatenate([p[:, 8], [s.cov_acc] * 3 * len(m), [s.cov_gyro] * 3 * len(m)])
            for _ in range(s.iterations):
                h = (seen(x + e) - seen(x - e)).T / 2e-6
                z = np.concatenate([np.zeros(len(p)), m[:, 9:12].ravel(), m[:, 12:15].ravel()]) - seen(x[None])[0]
                gate = (np.abs(z) < s.point_threshold) | (np.einsum("ij,jk,ik->i", h, cov, h) + r < r * s.coeff_cov)
                gate[len(p) :] = np.abs(z[len(p) :]) <= np.repeat([10, 5], 3 * len(m))
                z, h, of_points = np.where(gate, z, 0), np.where(gate[:, None], h, 0), int(gate[: len(p)].sum())
                if not of_points:
                    break
                if len(r) > n:
                    gain = np.linalg.inv((h.T / r) @ h + np.linalg.inv(cov)) @ (h.T / r)
                else:
                    gain = cov @ h.T @ np.linalg.inv(h @ cov @ h.T + np.diag(r))
                step = gain @ (h @ (x - x0) + z) - (x - x0)
                x, settled = x + step, settled + (np.linalg.norm(step) <= 0.1)
                if settled > 1:
                    break
            win.x, used = x, used + of_points
            if of_points and gain is not None:
                cov = (np.eye(n) - gain @ h) @ cov
                cov = (cov + cov.T) / 2
        pos, q, _, _ = win.at(win.x[None], np.array([1.0]), s.dt)
        found.append((segment, len(own), used, *pos[0, 0], *q[0, 0]))
    return found


def many_runs(runs, seed, big=0):
    """Rows of runs with gaps, segments without points, and every tenth run longer than the others; of one run a segment of `big` rows."""
    rng, rows = np.random.default_rng(seed), []
    for run in range(runs):
        for segment in np.flatnonzero(rng.random(40 if run % 10 == 0 else 8) < 0.5):
            for _ in range(big if big and run == 1 and segment < 4 else rng.integers(1, 5)):
                point = float(rng.random() < 0.7)
                normal = rng.normal(size=3)
                normal /= np.linalg.norm(normal)
                values = [*rng.normal(size=3), *normal, rng.normal() * 0.3, 0.01, *[0.0] * 6] if point else [*[0.0] * 8, *rng.normal(size=2) * 0.3, 9.81, *rng.normal(size=3) * 0.2]
                rows.append((f"r{run}", int(segment), float(rng.random()), int(point), len(rows), *map(float, values)))
    return rows


@pytest.mark.parametrize("inertial", [False, True])
def test_runs_side_by_side_equal_a_plain_filter(spark, inertial):
    rows, s, cap = many_runs(30, 5, big=45), estimator.Settings(), 36
    ddl = "run string, segment bigint, u double, kind int, id bigint, " + ", ".join(f"{c} double" for c in "bx by bz nx ny nz d w_pt ax ay az gx gy gz".split())
    got = {(r.run, r.segment): r[2:] for r in estimator.estimate(spark.createDataFrame(rows, ddl), s, inertial, cap).collect()}
    want = {(run, f[0]): f[1:] for run in sorted({r[0] for r in rows}) for f in plain_filter([r for r in rows if r[0] == run], s, inertial, cap)}
    assert got.keys() == want.keys()
    for key, w in want.items():
        assert got[key][:2] == w[:2] and np.allclose(got[key][2:], w[2:], atol=1e-5), key


@pytest.mark.parametrize("inertial", [False, True])
def test_updates_are_made_for_many_runs_at_once(monkeypatch, inertial):
    """One call for all runs with like rows; one for each segment took 6 ms of a core for a point or two. Results don't depend on the company."""
    names = ["run", "segment", "u", "kind", "id", *estimator.POINT, *estimator.INERTIAL]
    rows = sorted(many_runs(200, 6))
    table = pa.table([list(c) for c in zip(*rows, strict=True)], names)
    calls, update = [], estimator.Filters.update
    monkeypatch.setattr(estimator.Filters, "update", lambda self, who, *a: calls.append(len(who)) or update(self, who, *a))
    together = estimator.Stream(estimator.Settings(), inertial, 300).feed(table, True)[0].to_pylist()
    assert len(together) == len({r[:2] for r in rows}) > 1000 and sum(calls) > 800 and len(calls) < 250
    stream, apart, rest = estimator.Stream(estimator.Settings(), inertial, 300), [], table.slice(0, 0)
    for i in range(0, len(table), 37):
        done, rest = stream.feed(pa.concat_tables([rest, table.slice(i, 37)]), False)
        apart += done.to_pylist()
    assert apart + stream.feed(rest, True)[0].to_pylist() == together


def test_slopes_made_at_once_are_bounded(monkeypatch):
    """Runs with many rows of a segment each go in parts: 800 with 300 rows took 2 GB."""
    names = ["run", "segment", "u", "kind", "id", *estimator.POINT, *estimator.INERTIAL]
    table = pa.table([list(c) for c in zip(*sorted(many_runs(60, 9)), strict=True)], names)
    whole = estimator.Stream(estimator.Settings(), True, 300).feed(table, True)[0].to_pylist()
    sizes, update = [], estimator.Filters.update
    monkeypatch.setattr(estimator, "SLOPES", 64)
    monkeypatch.setattr(estimator.Filters, "update", lambda self, who, wide, real, *a: sizes.append(len(who) * (real.shape[1] + 6 * (a[6].shape[1] if len(a) > 5 else 0))) or update(self, who, wide, real, *a))
    assert estimator.Stream(estimator.Settings(), True, 300).feed(table, True)[0].to_pylist() == whole
    assert max(sizes) < 64 + 32


def test_gain_and_information_forms_agree():
    rng = np.random.default_rng(4)
    h, p, r, z = rng.normal(size=(40, 6)), np.eye(6) * 0.3, np.full(40, 0.2), rng.normal(size=40)
    gain = p @ h.T @ np.linalg.inv(h @ p @ h.T + np.diag(r)) @ z
    info = np.linalg.inv((h.T / r) @ h + np.linalg.inv(p)) @ ((h.T / r) @ z)
    assert np.allclose(gain, info)


def test_insert_downsampled_is_idempotent(spark):
    rng = np.random.default_rng(5)
    pts = lambda k, n: spark.createDataFrame([(k + i, *map(float, rng.normal(size=3))) for i in range(n)], "id bigint, x double, y double, z double")
    new = pts(1000, 80).cache()
    once = space.insert_downsampled(pts(0, 80), new, 0.7).cache()
    twice = space.insert_downsampled(once, new, 0.7)
    assert {r.id for r in once.collect()} == {r.id for r in twice.collect()}
    assert once.select(*space.cell(0.7)).join(new.select(*space.cell(0.7)).distinct(), ["cx", "cy", "cz"]).groupBy("cx", "cy", "cz").count().where("count > 1").count() == 0


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").orderBy("ts")
    parts = events.withColumn("part", F.ntile(3).over(Window.orderBy("ts"))).cache()
    for i in (1, 2, 3):
        parts.where(f"part = {i}").drop("part").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    query = (
        windows.tumbling(windows.read_stream(spark, str(tmp_path / "in")), "1 hour", "60 days")
        .writeStream.format("memory").queryName("tumbling").outputMode("complete").option("checkpointLocation", str(tmp_path / "c"))
        .trigger(availableNow=True).start()
    )
    query.awaitTermination(120)
    want = {tuple(r) for r in windows.tumbling(events, "1 hour", "60 days").collect()}
    assert {tuple(r) for r in spark.table("tumbling").collect()} == want


def test_plane_fit_equals_least_squares(spark):
    rng = np.random.default_rng(4)
    rows, want = [], {}
    for q in range(40):
        pts = rng.normal(size=(6, 3)) * 0.3 + rng.normal(size=3) * 4
        rows += [(q, 0.0, 0.0, 0.0, i + 1, *map(float, p)) for i, p in enumerate(pts[: 4 if q == 39 else 6])]
        n = np.linalg.lstsq(pts[:5], -np.ones(5), rcond=None)[0]
        want[q] = [*(n / np.linalg.norm(n)), 1 / np.linalg.norm(n)]
    rows += [(50, 0.0, 0.0, 0.0, i + 1, float(i), float(i * i), 0.0) for i in range(5)]
    near = spark.createDataFrame(rows, "qid int, qx double, qy double, qz double, rn int, x double, y double, z double")
    got = {r.qid: [r.nx, r.ny, r.nz, r.d] for r in space.plane_of(near).collect()}
    assert sorted(got) == list(range(39))
    assert all(np.allclose(got[q], want[q], rtol=1e-6, atol=1e-7) for q in got)


def test_rotation_prefix_over_many_blocks(spark):
    rng, n = np.random.default_rng(11), 900
    deltas = rng.normal(size=(n, 3)) * 0.2
    df = spark.createDataFrame([("a", k, 0.0, 0.0, 0.0, *d) for k, d in enumerate(deltas.tolist())] + [("b", 5, 0.0, 0.0, 0.0, 0.1, 0.2, 0.3)], "run string, idx long, px double, py double, pz double, dx double, dy double, dz double")
    got = {(r.run, r.idx): [r.qw, r.qx, r.qy, r.qz] for r in trajectory.rotation_prefix(df.repartition(5), block=8).collect()}
    q = np.array([1.0, 0, 0, 0])
    for k, d in enumerate(deltas):
        q = estimator.quat_mul(q, estimator.quat_exp(d))
        assert np.allclose(got["a", k], q, atol=1e-9)
    assert np.allclose(got["b", 5], estimator.quat_exp(np.array([0.1, 0.2, 0.3]))) and len(got) == n + 1


def test_frames_over_many_blocks(spark):
    df = spark.createDataFrame([("a", k, float(k), 2.0 * k, 0.0, 0.1 * k, 0.0, 0.0) for k in range(50)], "run string, idx long, px double, py double, pz double, dx double, dy double, dz double")
    got = {r.idx: r for r in trajectory.frames(df, block=8).collect()}
    assert set(got) == set(range(-3, 50))
    for k in range(50):
        want = [max(0.0, float(i)) if i < 50 else None for i in (k - 2, k - 1, k, k + 1)]
        assert [got[k].px0, got[k].px1, got[k].px2, got[k].px3] == want and got[k].dx0 == pytest.approx(max(0.0, 0.1 * (k - 2)))
    plan = trajectory.frames(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(run" in plan and "windowspecdefinition(run#" in plan and "block#" in plan.split("windowspecdefinition(")[1].split(",")[1]


def test_knots_grow_in_linear_time(spark):
    df = spark.range(300_000).selectExpr("'a' AS run", "id AS idx", *[f"0e0 AS {c}" for c in ("px", "py", "pz", "dx", "dy")], "1e-3 AS dz")
    last = trajectory.rotation_prefix(df).where("idx = 299999").first()
    assert np.allclose([last.qw, last.qz], [np.cos(300.0), np.sin(300.0)], atol=1e-6)


def test_increments_as_a_stream_equal_the_batch(spark, tmp_path):
    rows = [("a", v, v * 10 + k, float(v * 100 + k), *[0.0] * 5) for v in range(4) for k in range(-3, 10) if v * 10 + k >= 0]
    flat = spark.createDataFrame(rows, "run string, version long, idx long, px double, py double, pz double, dx double, dy double, dz double")
    sent = flat.groupBy("run", "version").agg(F.sort_array(F.collect_list(F.struct("idx", *trajectory.NAMES))).alias("knots"))
    for v in range(4):
        sent.where(f"version = {v}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    incoming = spark.readStream.schema(sent.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = trajectory.apply_increments(incoming).writeStream.outputMode("complete").format("memory").queryName("rebuilt").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "state")).start()
    run.awaitTermination()
    pick = lambda df: sorted((r.idx, r.version, r.px) for r in df.collect())
    assert pick(spark.table("rebuilt")) == pick(trajectory.apply_increments(sent))


def test_nearest_equals_brute_force_and_makes_few_pairs(spark):
    """A dense ball, clusters, far queries, equal distances on a grid, copies of a place and what is not finite."""
    rng, k, radius = np.random.default_rng(12), 5, 2.236
    grid = np.stack(np.meshgrid(*[np.arange(9.0) * 0.25 + 20] * 3), -1).reshape(-1, 3)
    pts = np.concatenate([rng.normal(size=(6000, 3)) * 0.5, rng.normal(size=(500, 3)) * 1e-4 + 5, grid, np.tile([[-3.0, 0, 0]], (1500, 1)), rng.uniform(-4000, 4000, (20, 3))])
    pts = pts[rng.permutation(len(pts))]
    asks = np.concatenate([rng.normal(size=(300, 3)), rng.normal(size=(100, 3)) * 3, grid[::7] + 0.125, grid[::11], np.tile([[-3.0, 1.0, 0]], (50, 1)), pts[:200], [[5.0, 5, 5], [90.0, 0, 0]]])
    rows = lambda a: [(i, *map(float, v)) for i, v in enumerate(a)]
    odd = [(10**6, float("nan"), 0.0, 0.0), (10**6 + 1, None, 0.0, 0.0), (10**6 + 2, float("inf"), 0.0, 0.0)]
    ddl = "id long, x double, y double, z double"
    new, points = spark.createDataFrame(rows(asks) + odd, ddl), spark.createDataFrame(rows(pts) + odd, ddl).repartition(3)
    want = set()
    for i, q in enumerate(asks):
        dx, dy, dz = (q - pts).T
        d2 = dx * dx + dy * dy + dz * dz
        order = np.lexsort((np.arange(len(pts)), pts[:, 0], d2))[:k]
        want |= {(i, int(j), float(d2[j]), r + 1) for r, j in enumerate(order) if d2[j] <= radius * radius}
    found = space.nearest(new, points, k, radius)
    assert {(r.qid, r.id, r.d2, r.rn) for r in found.collect()} == want
    assert space.nearest(new, points.where("id < 0"), k, radius).count() == 0 and space.nearest(new.where("id < 0"), points, k, radius).count() == 0
    assert len(want) <= neighbours.candidates(new, points, k, radius).count() < 3 * len(want)


def test_radius_pairs_of_one_dense_cell_fill_all_tasks(spark, monkeypatch):
    """One cell has most rows and no side is broadcast, as with large tables: pairs equal brute force, copies included, and no task makes most of them."""
    rng, radius = np.random.default_rng(7), 2.236
    make = lambda n: np.concatenate([rng.uniform(0.2, 2.0, (n, 3)), rng.normal(size=(60, 3)) * 6, np.tile([[1.0, 1, 1]], (40, 1))])
    asks, pts = make(200), make(300)
    ddl, rows = "id long, x double, y double, z double", lambda a: [(i, *map(float, v)) for i, v in enumerate(a)] + [(10**6, float("nan"), 0.0, 0.0), (10**6 + 1, None, 0.0, 0.0)]
    want = set()
    for i, q in enumerate(asks):
        dx, dy, dz = (q - pts).T
        d2 = dx * dx + dy * dy + dz * dz
        want |= {(i, int(j), float(d2[j])) for j in np.flatnonzero(d2 <= radius * radius)}
    monkeypatch.setattr(space, "BLOCK", 32, raising=False)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        found = space.within_radius(spark.createDataFrame(rows(asks), ddl), spark.createDataFrame(rows(pts), ddl)).select("qid", "id", "d2", F.spark_partition_id().alias("task")).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(found) == len(want) and {(r.qid, r.id, r.d2) for r in found} == want
    tasks = np.bincount([r.task for r in found], minlength=4)
    assert tasks.max() < 0.5 * len(found) and (tasks > 0).all()
