"""Settings of a run and the dimension table of its sensors."""

from __future__ import annotations

from dataclasses import dataclass, field, fields

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Sensor:
    """q_lb (w, x, y, z) and t_lb map the body frame to the sensor's."""

    name: str
    kind: str
    scan_line: int
    blind: float = 0.5
    q_lb: tuple[float, float, float, float] = (1.0, 0.0, 0.0, 0.0)
    t_lb: tuple[float, float, float] = (0.0, 0.0, 0.0)
    w_pt: float = 0.01

    def body_frame(self) -> tuple[tuple[float, ...], tuple[float, ...]]:
        """q_bl and t_bl: the inverse, exact for quaternions of any length."""
        w, x, y, z = self.q_lb
        n = w * w + x * x + y * y + z * z
        q = (w / n, -x / n, -y / n, -z / n)
        u = (w / n**0.5, -x / n**0.5, -y / n**0.5, -z / n**0.5)
        a, b, c = (-t for t in self.t_lb)
        tx, ty, tz = 2 * (u[2] * c - u[3] * b), 2 * (u[3] * a - u[1] * c), 2 * (u[1] * b - u[2] * a)
        t = (a + u[0] * tx + u[2] * tz - u[3] * ty, b + u[0] * ty + u[3] * tx - u[1] * tz, c + u[0] * tz + u[1] * ty - u[2] * tx)
        return q, t


@dataclass(frozen=True)
class RunConfig:
    """Values without a default are required."""

    sensors: tuple[Sensor, ...]
    lidar_only: bool
    point_filter_num: int
    scan_voxel: float
    map_voxel: float
    knot_hz: int = 100
    num_nn: int = 5
    coeff_cov: float = 10.0
    nn_thresh: float = 0.5
    n_iter: int = 1
    batch_cap: int = 300
    lidar_time_offset: float = 0.0
    cube: float = 1000.0
    acc_ratio: bool = False
    gravity: float = field(default=9.81)

    @classmethod
    def from_dict(cls, values: dict) -> RunConfig:
        known = {f.name for f in fields(cls)}
        if unknown := set(values) - known:
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        sensors = tuple(s if isinstance(s, Sensor) else Sensor(**s) for s in values["sensors"])
        if len({s.name for s in sensors}) != len(sensors):
            raise ValueError("sensor names must differ")
        return cls(**{**values, "sensors": sensors})


def sensor_table(spark: SparkSession, sensors: tuple[Sensor, ...]) -> DataFrame:
    """One row per sensor; a configuration names a handful, so joins may broadcast it."""
    rows = [(s.name, s.kind, s.scan_line, s.blind, s.w_pt, *s.body_frame()[0], *s.body_frame()[1]) for s in sensors]
    schema = "sensor string, kind string, scan_line int, blind double, w_pt double, rw double, rx double, ry double, rz double, tx double, ty double, tz double"
    return spark.createDataFrame(rows, schema)
