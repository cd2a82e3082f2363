"""The k nearest points within a radius, exactly, with work that follows rows and not pairs.

Points are laid out along a Z-order curve and cut into blocks of about BLOCK; the
driver gets one box per block. A query first asks one block near to it, which
bounds how far its k-th neighbour is, then all blocks within that distance.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 256  # points of a block, about
FAN = 8  # children of a node of the tree over the blocks
SALTS = 8  # parts of a block's queries, so that a block many ask isn't one task's
CHUNK = 2048  # queries at a time
FINE = 1024  # cells of the curve along a radius
BOX = "code long, n long, lx double, ly double, lz double, hx double, hy double, hz double"


def code(xyz: np.ndarray, radius: float) -> np.ndarray:
    """Places on the curve, from 21 bits an axis. Cells repeat every 2048 radii; boxes tell them apart."""
    out = np.zeros(len(xyz), np.int64)
    for i in range(3):
        v = np.mod(np.floor(xyz[:, i] / (radius / FINE)), 2.0**21).astype(np.int64) ^ (1 << 20)
        for shift, mask in ((32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249)):
            v = (v | v << shift) & mask
        out |= v << i
    return out


def cut(codes: np.ndarray, xyz: np.ndarray, end: bool) -> tuple[list[tuple], int]:
    """Blocks (first code, n, box) of sorted points, and how many points they hold; without end the last ones stay.

    A block ends between half and one and a half BLOCK, where the highest bit of the
    code changes, as such blocks are nearly cubes; never within one code.
    """
    out, i = [], 0
    turn = codes[1:] ^ codes[:-1]  # between i and i + 1
    ends = np.append(np.nonzero(turn)[0] + 1, len(codes))
    while i < len(codes):
        lo, hi = i + BLOCK // 2, i + BLOCK + BLOCK // 2
        if hi >= len(codes):
            if not end:
                break
            j = len(codes)
        else:
            j = lo + 1 + int(np.argmax(turn[lo:hi]))
            if not turn[j - 1]:  # one code all along
                j = int(ends[np.searchsorted(ends, j)])
                if j == len(codes) and not end:
                    break
        box = xyz[i:j]
        out.append((int(codes[i]), j - i, *map(float, box.min(0)), *map(float, box.max(0))))
        i = j
    return out, i


def _numbers(batch: pa.RecordBatch, names: tuple[str, ...]) -> np.ndarray:
    return np.stack([batch.column(n).to_numpy(zero_copy_only=False) for n in names], 1)


@dataclass
class Blocks:
    """Where the blocks begin on the curve, and levels (lo, hi, n) of boxes from the blocks up."""

    begins: np.ndarray
    levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]

    @classmethod
    def of(cls, rows: list) -> Blocks:
        a = sorted(tuple(r) for r in rows)
        n, box = np.array([r[1] for r in a], np.int64), np.array([r[2:] for r in a], float).reshape(-1, 6)
        levels = [(box[:, :3], box[:, 3:], n)]
        while len(levels[-1][2]) > FAN:
            lo, hi, n = levels[-1]
            at = np.arange(0, len(n), FAN)
            levels.append((np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at), np.add.reduceat(n, at)))
        return cls(np.array([r[0] for r in a], np.int64), levels)

    def home(self, q: np.ndarray, radius: float, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Indices of queries that may have neighbours, and a block near to each: a start, not surely the nearest.

        It is the one at their place on the curve, or where this lies apart, that with the
        nearest farthest corner.
        """
        node = np.maximum(np.searchsorted(self.begins, code(q, radius), "right") - 1, 0)
        lo, hi, _ = self.levels[0]
        gap = np.maximum(np.maximum(lo[node] - q, q - hi[node]), 0.0)
        apart = np.nonzero((gap * gap).sum(1) * 4 > ((hi - lo) ** 2).sum(1)[node])[0]
        qi, block, _ = self.near(q[apart], np.full(len(apart), radius * radius), k)
        reach = np.maximum(hi[block] - q[apart][qi], q[apart][qi] - lo[block])
        order = np.lexsort(((reach * reach).sum(1), qi))
        qi, first = np.unique(qi[order], return_index=True)
        node[apart] = -1
        node[apart[qi]] = block[order][first]
        return np.nonzero(node >= 0)[0], node[node >= 0]

    def near(self, q: np.ndarray, far: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Indices of queries, blocks whose boxes lie within far (squared) of them, and far.

        far comes down to what surely holds k points. Sums are rounded in the order
        of the points' own d2, so a box is never farther than a point in it.
        """
        far, top = far.copy(), len(self.levels[-1][2])
        qi, node = np.repeat(np.arange(len(q)), top), np.tile(np.arange(top), len(q))
        for depth in range(len(self.levels) - 1, -1, -1):
            lo, hi, n = (v[node] for v in self.levels[depth])
            under, over = lo - q[qi], q[qi] - hi
            gap = np.maximum(np.maximum(under, over), 0.0)
            least = gap[:, 0] * gap[:, 0] + gap[:, 1] * gap[:, 1] + gap[:, 2] * gap[:, 2]
            reach = np.maximum(-under, -over)
            most = reach[:, 0] * reach[:, 0] + reach[:, 1] * reach[:, 1] + reach[:, 2] * reach[:, 2]
            np.minimum.at(far, qi, np.where(n >= k, most, np.inf))
            keep = least <= far[qi]
            qi, node = qi[keep], node[keep]
            if depth:
                below = len(self.levels[depth - 1][2])
                qi, node = np.repeat(qi, FAN), (node[:, None] * FAN + np.arange(FAN)).ravel()
                qi, node = qi[node < below], node[node < below]
        return qi, node, far


def least(q: np.ndarray, p: np.ndarray, far: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (query, point, d2) of each query's k nearest within far (squared); of equals the first in p."""
    dx, dy, dz = (q[:, i, None] - p[None, :, i] for i in range(3))
    d2 = dx * dx + dy * dy + dz * dz
    last = np.minimum(far, np.partition(d2, k - 1, 1)[:, k - 1]) if len(p) > k else far
    qi, pj = np.nonzero(d2 <= last[:, None])
    for i in np.nonzero(np.bincount(qi, minlength=len(q)) > k)[0]:  # equals at the k-th place
        best = np.argsort(d2[i], kind="stable")[:k]
        qi, pj = np.concatenate([qi[qi != i], np.full(k, i)]), np.concatenate([pj[qi != i], best])
    return qi, pj, d2[qi, pj]


def nearest(queries: DataFrame, points: DataFrame, k: int, radius: float) -> DataFrame:
    """(qid, qx, qy, qz, id, x, y, z, d2, rn): see space.nearest()."""
    order = Window.partitionBy("qid").orderBy("d2", "x", "id")
    return candidates(queries, points, k, radius).withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= k)


def candidates(queries: DataFrame, points: DataFrame, k: int, radius: float) -> DataFrame:
    """Pairs among which each query's k nearest are: at most k from each block it asks."""
    spark = queries.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    finite = " AND ".join(f"abs({c}) < double('infinity')" for c in "xyz")  # nothing is near what isn't
    xyz = [F.col(c).cast("double").alias(c) for c in "xyz"]
    p = points.select("id", *xyz).where(finite)
    # Of points in one place only the k first by id can be among the nearest.
    p = p.withColumn("rn", F.row_number().over(Window.partitionBy("x", "y", "z").orderBy("id"))).where(F.col("rn") <= k).drop("rn")
    q = queries.select(F.col("id").alias("qid"), *xyz).where(finite).selectExpr("qid", "x AS qx", "y AS qy", "z AS qz")
    q_type, p_type = q.schema["qid"].dataType.simpleString(), p.schema["id"].dataType.simpleString()

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = _numbers(b, ("x", "y", "z"))
            yield pa.RecordBatch.from_arrays([pa.array(code(at, radius)), *map(pa.array, at.T)], ["code", "x", "y", "z"])

    def boxed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row per block of what is sorted along the curve."""
        codes, at = np.empty(0, np.int64), np.empty((0, 3))
        for b in batches:
            codes, at = np.append(codes, b.column("code").to_numpy()), np.concatenate([at, _numbers(b, ("x", "y", "z"))])
            rows, done = cut(codes, at, False)
            codes, at = codes[done:], at[done:]
            if rows:
                yield framed(rows)
        rows, _ = cut(codes, at, True)
        if rows:
            yield framed(rows)

    def framed(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*rows, strict=True)], [t.split()[0] for t in BOX.split(", ")])

    along = p.mapInArrow(coded, "code long, x double, y double, z double").repartitionByRange("code").sortWithinPartitions("code")
    blocks = Blocks.of(along.mapInArrow(boxed, BOX).collect())
    sent = spark.sparkContext.broadcast(blocks)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Points with their block."""
        for b in batches:
            block = np.searchsorted(sent.value.begins, code(_numbers(b, ("x", "y", "z")), radius), "right") - 1
            yield pa.RecordBatch.from_arrays([pa.array(block), *b.columns], ["block", *b.schema.names])

    def asked(qid: pa.Array, at: np.ndarray, far: np.ndarray, block: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(block), qid, *map(pa.array, at.T), pa.array(far)], ["block", "qid", "qx", "qy", "qz", "far"])

    def asking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows if len(sent.value.begins) else 0, CHUNK):
                part = b.slice(i, CHUNK)
                at = _numbers(part, ("qx", "qy", "qz"))
                qi, block = sent.value.home(at, radius, k)
                yield asked(part.column("qid").take(pa.array(qi)), at[qi], np.full(len(qi), radius * radius), block)

    def matched(first: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Rows come by block and part, its points before its queries."""
            now, held, own, at = None, [], None, None
            for b in batches:
                block, salt, kind = (b.column(c).to_numpy() for c in ("block", "salt", "kind"))
                cuts = np.concatenate([[0], np.nonzero(np.diff(block) | np.diff(salt) | np.diff(kind))[0] + 1, [b.num_rows]])
                for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                    part = b.slice(i, j - i)
                    if (block[i], salt[i]) != now:
                        now, held, own = (block[i], salt[i]), [], None
                    if kind[i] == 0:
                        held.append(part.select(["id", "x", "y", "z"]))
                        continue
                    if own is None:
                        own = pa.Table.from_batches(held).sort_by([("x", "ascending"), ("id", "ascending")]).combine_chunks().to_batches()[0]
                        at, held = _numbers(own, ("x", "y", "z")), []
                    step = max(1, min(CHUNK, (1 << 21) // len(at)))
                    for s in range(0, part.num_rows, step):
                        yield answer(part.slice(s, step), own, at)

        def answer(part: pa.RecordBatch, own: pa.RecordBatch, at: np.ndarray) -> pa.RecordBatch:
            where, far = _numbers(part, ("qx", "qy", "qz")), part.column("far").to_numpy().copy()
            qi, pj, d2 = least(where, at, far, k)
            if first:
                worst = np.zeros(len(far))
                np.maximum.at(worst, qi, d2)
                far = np.where(np.bincount(qi, minlength=len(far)) >= k, worst, far)
                qi, block, far = sent.value.near(where, far, k)
                return asked(part.column("qid").take(pa.array(qi)), where[qi], far[qi], block)
            qi, pj = pa.array(qi), pa.array(pj)
            cols = [part.column(c).take(qi) for c in ("qid", "qx", "qy", "qz")] + [own.column(c).take(pj) for c in ("id", "x", "y", "z")]
            return pa.RecordBatch.from_arrays([*cols, pa.array(d2)], ["qid", "qx", "qy", "qz", "id", "x", "y", "z", "d2"])

        return run

    place = p.mapInArrow(dealt, f"block long, id {p_type}, x double, y double, z double").select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), F.lit(0).alias("kind"))
    asks = f"block long, qid {q_type}, qx double, qy double, qz double, far double"

    def meet(who: DataFrame, first: bool, schema: str) -> DataFrame:
        who = who.select("*", F.expr(f"CAST(pmod(xxhash64(qid), {SALTS}) AS INT) AS salt"), F.lit(1).alias("kind"))
        rows = place.unionByName(who, allowMissingColumns=True).repartition(tasks, "block", "salt").sortWithinPartitions("block", "salt", "kind")
        return rows.mapInArrow(matched(first), schema)

    again = meet(q.mapInArrow(asking, asks), True, asks)
    return meet(again, False, f"qid {q_type}, qx double, qy double, qz double, id {p_type}, x double, y double, z double, d2 double")
